"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text between the tags that start or end a block. Each block has features
of its own tag, its ancestors' tags and the words of their class, id and role (apart for elements that hold most of
the page's text, whose names say little of a block in them), and of its text (length, share of links, marks at its
end, place in the page). The field has a weight for each feature and for each pair of neighbouring labels; it is
trained by its log-likelihood (forward-backward) on labelled pages, and the best sequence of labels is decoded by
Viterbi.

The reader takes time in proportion to the page, whatever its markup: a tag ends at the first ``>`` outside quoted
values; quotes elsewhere are plain characters; a tag or comment without an end takes the rest of the page; a new
block ends an open paragraph; an end tag closes all that was opened since its start tag or is ignored; elements are
nested ``DEPTH`` deep at most, further ones only end blocks. The text of scripts, styles, titles, frames, templates
and text fields is never a block; the head has no other text, so nothing depends on its end tag.

Defined results: null and empty pages, and those without text, have the empty text; a page without markup is one
block; very long pages are read whole; repeated rows are returned as often as they occur; page_id and url, of any
type or null, are only carried; an empty table gives an empty result; columns other than these and html aren't read,
so their names can't clash.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crossweave.llm.common import TEXT_ROWS, arrow_map
from crossweave.llm.html_pages import BAD, FAMILIES, GOOD, pages

TRAINING_PAGES = 1_500
STEPS = 100
#: Sets of element features that a worker holds at once.
CACHE = 50_000
DEPTH = 512
#: An element is wide with this share of the page's text or more.
WIDE = 0.5

#: Fixed values of HTML: elements that start a block (others stay inside a line), without content, and whose content is no text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li listing main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noframes", "noembed", "template")
#: What a start tag ends, if it is open inside the nearest of the elements that bound it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: A class that starts with one of these tells the state of a page, and not what an element is.
STATES = frozenset("no not has with without is js".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</(?![a-zA-Z])[^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[\"'])*+)>|</?[a-zA-Z].*+|<|[^<]++",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>="']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}


def _singular(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


#: Names of one family have a feature in common: singular words without hyphens.
_FAMILY = {_singular(word.replace("-", "")): family for family, words in FAMILIES.items() for word in words}


def names(attributes: str) -> tuple[frozenset[str], bool]:
    """The words of an element's class, id, role and label, and whether it is hidden."""
    words: set[str] = set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and _HIDES.search(value.lower()) or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name in ("class", "id", "role", "aria-label"):
            for item in value.split():
                parts = [x.lower() for x in _PART.findall(item)]
                if parts and parts[0] not in STATES:
                    words |= {_singular(x) for x in (*parts, "".join(parts)) if len(x) < 30}
    return frozenset(words), hidden


class _Named(dict):
    def __missing__(self, attributes: str) -> tuple[frozenset[str], bool]:
        if len(self) >= CACHE:
            self.clear()
        self[attributes] = value = names(attributes)
        return value


class _Elements(dict):
    """The features of an element and those above it, by those above it, its tag, its names and whether it is hidden and wide."""

    def __missing__(self, key: tuple[frozenset, str, frozenset, bool, bool]) -> frozenset:
        if len(self) >= CACHE:
            self.clear()
        above, tag, words, hidden, wide = key
        kind = "wide" if wide else "named"
        own = set() if tag in ("html", "body") else {f"in {tag}"} | {f"{kind} {w}" for w in words} | {f"{kind} as {_FAMILY[w]}" for w in words if w in _FAMILY}
        if hidden:
            own.add("hidden")
        self[key] = value = above | own
        return value


_named, _elements = _Named(), _Elements()
NOTHING: frozenset = frozenset()
Block = tuple[str, frozenset, str, int]


def blocks(page: str) -> list[Block]:
    """(text, ancestor features, tag, characters in links) of each leaf block with text, in page order."""
    found: list[tuple[str, int, int]] = []  # text, element, characters in links
    elements: list[tuple[int, str, frozenset, bool]] = [(-1, "", NOTHING, False)]  # parent, tag, names, hidden
    stack: list[int] = [0]
    beyond: dict[str, int] = {}  # open elements that are nested too deep to be kept
    open_: dict[str, int] = {}
    endless: set[str] = set()
    parts: list[str] = []
    in_links, link = 0, False
    at, n = 0, len(page)

    def close() -> None:
        nonlocal parts, in_links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((text, stack[-1], in_links))
            parts = []
        in_links = 0

    def pop_to(index: int) -> None:
        close()
        for e in stack[index:]:
            open_[elements[e][1]] -= 1
        del stack[index:]

    def last(tags: set[str], bounds: set[str] = frozenset()) -> int:
        """Where in the stack the innermost of the tags is, unless one of the bounds is further in; 0 if nowhere."""
        if any(open_.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                tag = elements[stack[i]][1]
                if tag in tags:
                    return i
                if tag in bounds:
                    break
        return 0

    while at < n:
        m = _TOKEN.match(page, at)
        at, tag = m.end(), m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or len(piece) == 1:
                # References are decoded before the pieces are joined: markup between them ends a reference.
                piece = references.unescape(piece)
            elif piece.startswith("<![CDATA["):
                piece = piece[9:].removesuffix("]]>")
            else:
                continue
            parts.append(piece)
            if link:
                in_links += len(piece)
            continue
        tag = tag.lower()
        block = tag in BLOCK or tag == "ins" and elements[stack[-1]][1] != "p"
        if m[1]:
            if tag == "a":
                link = False
            elif block:
                close()
                if beyond.get(tag):
                    beyond[tag] -= 1
                elif i := last({tag}):
                    pop_to(i)
            continue
        if tag in _RAW_END:
            stop = None if tag in endless else _RAW_END[tag].search(page, at)
            if stop:
                at = stop.end()
            elif tag == "template":
                endless.add(tag)
            else:
                at = n
        elif not block:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                link = True
        else:
            close()
            if tag in VOID:
                continue
            if tag in ENDS and (i := last(*ENDS[tag])):
                pop_to(i)
            elif elements[stack[-1]][1] == "p":
                pop_to(len(stack) - 1)
            if len(stack) > DEPTH:
                beyond[tag] = beyond.get(tag, 0) + 1
                continue
            elements.append((stack[-1], tag, *_named[m[3]]))
            stack.append(len(elements) - 1)
            open_[tag] = open_.get(tag, 0) + 1
    close()

    held = [0] * len(elements)
    for text, e, _ in found:
        held[e] += len(text)
    total = sum(held)
    for e in range(len(elements) - 1, 0, -1):  # parents come before their children
        held[elements[e][0]] += held[e]
    above: list[frozenset] = [NOTHING] * len(elements)
    for e in range(1, len(elements)):
        parent, tag, words, hidden = elements[e]
        if held[e]:
            above[e] = _elements[above[parent], tag, words, hidden, held[e] >= WIDE * total]
    return [(text, above[e], elements[e][1], links) for text, e, links in found]


def text_features(text: str, tag: str, links: int, place: int, total: int) -> list[str]:
    words = text.count(" ") + 1
    share = links / max(1, len(text))
    marks = sum(map(text.count, ".!?"))
    out = [
        "all",
        f"tag {tag}",
        f"words {min(8, words.bit_length())}",
        f"tag {tag} words {min(6, words.bit_length())}",
        f"links {0 if not links else 1 if share < 0.3 else 2 if share < 0.7 else 3}",
        f"sentences {min(4, marks)}",
        f"commas {min(2, text.count(','))}",
    ]
    if text[-1] in ".!?\"'”»…":
        out.append("ends")
    if "©" in text or "®" in text:
        out.append("mark")
    if links and ("|" in text or "·" in text or "»" in text):
        out.append("bars between links")
    if total > 1 and place == 0:
        out.append("first")
    if total > 1 and place == total - 1:
        out.append("last")
    return out


#: Elements that are made for the main text.
MAIN = frozenset({"in article", "in main"})


def features(found: list[Block]) -> list[set[str]]:
    """The features of a page's blocks."""
    longest = max((len(b[0]) for b in found), default=0)
    some = any(MAIN & b[1] for b in found)
    out = []
    for i, (text, above, tag, links) in enumerate(found):
        own = set(text_features(text, tag, links, i, len(found))) | above
        own.add(f"of longest {4 * len(text) // (longest + 1)}")
        where = "page without main" if not some else "inside main" if MAIN & above else "outside main"
        own.add(where)
        own.add(f"{tag} {where}")
        out.append(own)
    return out


class Crf:
    """Two labels (0: other, 1: main text); the score of a label sequence is that of its features and its pairs."""

    def __init__(self, weights: dict[str, float] | None = None, pairs: list[list[float]] | None = None) -> None:
        self.weights = weights if weights is not None else {}
        self.pairs = pairs if pairs is not None else [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, page: list[set[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in block) for block in page]

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        pairs = self.pairs
        best, back = (0.0, scores[0]), []
        for s in scores[1:]:
            zero = (best[0] + pairs[0][0], best[1] + pairs[1][0])
            one = (best[0] + pairs[0][1], best[1] + pairs[1][1])
            back.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
            best = (max(zero), max(one) + s)
        label = int(best[1] > best[0])
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]

    def fit(self, labelled: list[tuple[list[set[str]], list[int]]], steps: int = STEPS, rate: float = 0.3, shrink: float = 0.01) -> None:
        """Adam on the log-likelihood of all pages together, less ``shrink`` times half the squared weights."""
        labelled = sorted((x for x in labelled if x[0]), key=lambda x: len(x[0]))
        if not labelled:
            return
        index: dict[str, int] = {}
        flat = np.array([index.setdefault(f, len(index)) for page, _ in labelled for block in page for f in sorted(block)])
        sizes = np.array([len(block) for page, _ in labelled for block in page])
        starts = np.cumsum(sizes) - sizes
        lengths = np.array([len(page) for page, _ in labelled])
        of = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        labels = np.array([y for _, own in labelled for y in own])
        together = place[1:] > 0
        seen = np.bincount(2 * labels[:-1][together] + labels[1:][together], minlength=4).reshape(2, 2)
        x = np.zeros(len(index) + 4)
        mean, square = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, steps + 1):
            scores = np.zeros((lengths[-1], len(lengths)))
            scores[place, of] = np.add.reduceat(x[flat], starts)
            ones, expected, _ = marginals(scores, lengths, x[-4:].reshape(2, 2))
            slope = np.bincount(flat, np.repeat(labels - ones[place, of], sizes), len(index))
            gradient = np.concatenate([slope, (seen - expected).ravel()]) - shrink * x
            mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
            x = x + rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.weights = {f: float(x[i]) for f, i in index.items()}
        self.pairs = x[-4:].reshape(2, 2).tolist()


def marginals(scores: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(label 1) of each block, expected pairs of all pages together, and each page's log of the sum over all sequences.

    ``scores[i, k]`` is the score of label 1 for block i of page k; pages come in order of their lengths, so that those
    with an i-th block are the last ones."""
    most, n = scores.shape
    add = np.logaddexp
    ahead, behind = np.zeros((most, 2, n)), np.zeros((most, 2, n))
    first = np.searchsorted(lengths, np.arange(most), side="right")  # the first page that has block i
    ahead[0, 1] = scores[0]
    for i in range(1, most):
        k = first[i]
        a, b = ahead[i - 1, 0, k:], ahead[i - 1, 1, k:]
        ahead[i, 0, k:] = add(a + pairs[0, 0], b + pairs[1, 0])
        ahead[i, 1, k:] = add(a + pairs[0, 1], b + pairs[1, 1]) + scores[i, k:]
    for i in range(most - 1, 0, -1):
        k = first[i]
        a, b = behind[i, 0, k:], behind[i, 1, k:] + scores[i, k:]
        behind[i - 1, 0, k:] = add(pairs[0, 0] + a, pairs[0, 1] + b)
        behind[i - 1, 1, k:] = add(pairs[1, 0] + a, pairs[1, 1] + b)
    total = add(behind[0, 0], behind[0, 1] + scores[0])
    with np.errstate(over="ignore"):
        ones = np.exp(np.minimum(ahead[:, 1] + behind[:, 1] - total, 0.0))
    expected = np.zeros((2, 2))
    for i in range(1, most):
        k = first[i]
        for x in (0, 1):
            for y in (0, 1):
                expected[x, y] += np.exp(ahead[i - 1, x, k:] + pairs[x, y] + (scores[i, k:] if y else 0.0) + behind[i, y, k:] - total[k:]).sum()
    return ones, expected, total


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a marked page, without the marks, and their labels; a block without a mark is none of the text."""
    found, labels = [], []
    for text, above, tag, links in blocks(page):
        labels.append(int(GOOD in text))
        found.append((text.replace(GOOD, "").replace(BAD, "").strip() or "-", above, tag, links))
    return found, labels


_trained: dict[tuple[int, int], Crf] = {}


def trained(n_pages: int = TRAINING_PAGES, steps: int = STEPS) -> Crf:
    """The field trained on the first pages of the rule; some hundred weights."""
    if (n_pages, steps) not in _trained:
        crf = Crf()
        crf.fit([(features(b), y) for b, y in map(labelled, pages(n_pages))], steps)
        _trained[n_pages, steps] = crf
    return _trained[n_pages, steps]


def main_text(page: str | None, crf: Crf) -> str:
    """The blocks of the main text, joined by spaces."""
    found = blocks(page or "")
    labels = crf.viterbi(crf.scores(features(found)))
    return " ".join(b[0] for b, label in zip(found, labels) if label)


def extract(table: DataFrame, crf: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    crf = crf or trained()
    # Features come from the training pages only, so the model's size doesn't depend on the input.
    model = table.sparkSession.sparkContext.broadcast((crf.weights, crf.pairs))
    kinds = {n: table.schema[n].dataType.simpleString() for n in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(*model.value)
        for batch in batches:
            made = [main_text(x, own) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array(list(map(len, made)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(table.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", TEXT_ROWS)
