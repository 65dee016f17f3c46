"""Errors of the engine. Each is also the built-in error that callers may already catch."""


class CrossweaveError(Exception):
    """Base of all errors of the engine."""


class HomologyError(CrossweaveError, FileNotFoundError):
    """Hit files of a pair of datasets can't be found."""


class MappingError(CrossweaveError, RuntimeError):
    """A result is asked for that no run has made yet."""


class DataError(CrossweaveError, TypeError):
    """A table doesn't have the columns it needs."""


class SpeciesNotFoundError(CrossweaveError, KeyError):
    """A dataset id is unknown."""


class GeneNotFoundError(CrossweaveError, ValueError):
    """A feature is unknown in every dataset."""


class DependencyError(CrossweaveError, ImportError):
    """An optional library is missing."""
