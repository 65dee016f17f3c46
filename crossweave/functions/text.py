"""Names, pairs of names and packed strings, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def species_of(name: Column) -> Column:
    """The dataset id: what stands before the first ``_``."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def qualify(name: Column, species: Column) -> Column:
    """Prefix a name by its dataset id, unless it has it already."""
    return F.when(species_of(name) == species, name).otherwise(F.concat(species, F.lit("_"), name))


def strip_species(name: Column) -> Column:
    """A name without its dataset id; later underscores stay."""
    return F.regexp_replace(name, "^[^_]*_", "")


def encode_pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(";"), b)


def decode_pair(pair: Column) -> tuple[Column, Column]:
    return F.split_part(pair, F.lit(";"), F.lit(1)), F.split_part(pair, F.lit(";"), F.lit(2))


def part(text: Column, separator: str = "_", index: int = 0) -> Column:
    """One part of a split text; an index beyond the last part gives the last."""
    parts = F.split(text, re.escape(separator))
    return F.element_at(parts, F.least(F.lit(index + 1), F.size(parts)))


def parts(text: Column, separator: str, arity: int) -> list[Column]:
    """All parts up to a width; missing ones are empty."""
    split = F.split(text, re.escape(separator))
    return [F.coalesce(F.get(split, F.lit(i)), F.lit("")) for i in range(arity)]


def unpack(packed: Column, delimiter: str) -> Column:
    """The terms of a packed cell; without a delimiter each letter is a term."""
    if delimiter:
        return F.filter(F.split(packed, re.escape(delimiter)), lambda x: x != "")
    return F.regexp_extract_all(packed, F.lit(r"(\p{L})"), F.lit(1))


def groups_at(packed: Column, taxon: int, exclusive: int = 2759) -> Column:
    """Orthology groups ``ID@taxon|name`` of a packed cell at a taxon; at ``exclusive``, more than one is none."""
    at = F.filter(F.split(packed, ","), lambda g: F.regexp_extract(g, r"@([^|]*)\|", 1) == str(taxon))
    found = F.transform(at, lambda g: F.split_part(g, F.lit("@"), F.lit(1)))
    if taxon == exclusive:
        found = F.when(F.size(found) <= 1, found).otherwise(F.array().cast("array<string>"))
    return found


def unordered(a: Column, b: Column) -> list[Column]:
    """A pair in canonical order."""
    return [F.least(a, b), F.greatest(a, b)]
