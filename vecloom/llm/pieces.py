"""Problem 3: texts over a size limit as overlapping pieces, cut at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits and overlaps of the project's data: documents in code points, chunks in words.
DOCUMENT_LIMIT, DOCUMENT_OVERLAP = 6_000, 200
CHUNK_LIMIT, CHUNK_OVERLAP = 120, 20
#: A cut is looked for within this share of a part's length on either side of its middle.
REACH = 0.25
#: Boundaries from the strongest to the weakest; the cut is at the end of the match. Code points U+FF01 etc. are full-width sentence ends.
BOUNDARIES = [
    re.compile(r"(?=\\(?:part|chapter|section|appendix|bibliography|begin\{document\}|end\{document\}))"),
    re.compile(r"(?=\\(?:subsection|subsubsection|paragraph|begin\{))|(?<=\n)(?=#+ )"),
    re.compile(r"(?:\r\n|\r|\n|\u2028)[ \t]*(?:\r\n|\r|\n|\u2028|\u2029)\s*|\u2029"),
    re.compile(r"\r\n|\r|\n|\u2028"),
    re.compile(r"[.!?][)\]}\"'\u201d\u2019]*\s+|[\u3002\uff01\uff1f]"),
    re.compile(r"[;:,]\s+|[\u3001\uff0c\uff1b]"),
    re.compile(r"\s+"),
]
_WORD = re.compile(r"\S+")


def _near(places: list[int], middle: int) -> int | None:
    return min(places, key=lambda p: (abs(p - middle), p)) if places else None


def cut_place(text: str, start: int, end: int, reach: float = REACH) -> int:
    """Where to cut ``text[start:end]`` in two: the strongest boundary near the middle, of equal ones the nearest.

    Without any it is the middle itself. Both parts have at least one code point.
    """
    middle, width = (start + end) // 2, max(1, int((end - start) * reach))
    low, high = max(start + 1, middle - width), min(end - 1, middle + width)
    for boundary in BOUNDARIES:
        # what a boundary looks ahead to may lie beyond the range
        found = _near([m.end() for m in boundary.finditer(text, low, min(len(text), high + 24)) if low <= m.end() <= high], middle)
        if found is not None:
            return found
    return max(start + 1, min(end - 1, middle))


def bisect(start: int, end: int, most: int, cut: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Consecutive ranges of at most ``most`` units, each range over it cut in two by ``cut`` until none is left."""
    out, open_ranges = [], [(start, end)]
    while open_ranges:
        a, b = open_ranges.pop()
        if b - a <= most:
            out.append((a, b))
        else:
            c = cut(a, b)
            open_ranges += [(c, b), (a, c)]
    return out


def split_characters(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own start, end) in code points of each piece; every piece but the first begins ``overlap`` before its own part."""
    ranges = bisect(0, len(text), limit - overlap, lambda a, b: cut_place(text, a, b))
    return [(max(0, a - overlap), a, b) for a, b in ranges]


def split_words(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Like :func:`split_characters` with sizes in words separated by white space.

    A piece spans the text from its first to its last word; white space between two own parts belongs to
    the earlier one.
    """
    spans = [m.span() for m in _WORD.finditer(text)]

    def cut(a: int, b: int) -> int:
        middle, width = (a + b) // 2, max(1, int((b - a) * REACH))
        low, high = max(a + 1, middle - width), min(b - 1, middle + width)
        lowest, highest = spans[low][0], spans[high][0]
        starts = {spans[i][0]: i for i in range(low, high + 1)}
        for boundary in BOUNDARIES:
            found = _near([starts[m.end()] for m in boundary.finditer(text, lowest, min(len(text), highest + 24)) if m.end() in starts], middle)
            if found is not None:
                return found
        return max(a + 1, min(b - 1, middle))

    ranges = bisect(0, len(spans), limit - overlap, cut)
    end_of = lambda b: spans[b][0] if b < len(spans) else len(text)
    return [(spans[max(0, a - overlap)][0] if a else 0, spans[a][0] if a else 0, end_of(b)) for a, b in ranges]


def _split(unit: str, limit: int, overlap: int):
    split = split_words if unit == "words" else split_characters

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                row, number, begin, own, text = [], [], [], [], []
                for i, whole in enumerate(part.column(2).to_pylist()):
                    for n, (a, b, c) in enumerate(split(whole, limit, overlap)):
                        row.append(i)
                        number.append(n)
                        begin.append(a)
                        own.append(b)
                        text.append(whole[a:c])
                rows = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(own, pa.int64()), pa.array(text, pa.string())], names=["kind", "key", "chunk_id", "start", "own_start", "text"])

    return run


def text_size(unit: str):
    """Size of the column ``text`` in code points, or in words separated by white space."""
    return F.length("text") if unit == "characters" else F.regexp_count("text", F.lit(r"(?U)\S+"))


def split_oversized(texts: DataFrame, unit: str, limit: int, overlap: int) -> DataFrame:
    """``(kind, key, chunk_id, start, own_start, text)``: the pieces of every text over the limit.

    ``texts`` has ``kind STRING, key BIGINT, text STRING``; ``unit`` is ``characters`` (code points) or
    ``words``. Pieces are numbered from 0, have at most ``limit`` units, and from the second on begin with
    the last ``overlap`` units before their own part; ``start`` and ``own_start`` are code point offsets in
    the text. The own parts, one after the other, are the text.

    Parts are made by recursive bisection at the strongest boundary near the middle (sections, environments,
    paragraphs, lines, sentences, clauses, blanks; the middle itself where there is none) until each has at
    most ``limit - overlap`` units. Texts within the limit, null and empty ones give no rows; a repeated row
    gives its pieces again. Only oversized texts leave the JVM. An empty table gives no rows.
    """
    if not 0 <= overlap < limit or unit not in ("characters", "words"):
        raise ValueError("need 0 <= overlap < limit, and characters or words")
    large = texts.select("kind", F.col("key").cast("bigint").alias("key"), "text").where(text_size(unit) > limit)
    return large.mapInArrow(_split(unit, limit, overlap), "kind string, key bigint, chunk_id int, start bigint, own_start bigint, text string")
