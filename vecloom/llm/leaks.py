"""Problem 7: passages of test items inside documents, by greedy string tiling."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.bitmaps import bit_of, bitmap, marked
from vecloom.llm.shingles import word_hashes
from vecloom.operators.skew import split_join, split_joins
from vecloom.session import materialise

_COMMAND = re.compile(r"\\[a-zA-Z@]+\*?")
_WORD = re.compile(r"[a-z0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters of test items up to which they are broadcast, about 30 MB; more are joined to the documents by their seeds.
ITEM_CHARS = 8_000_000
#: Bits of the filters that tell which seeds and which documents can matter, 16 MB each.
FILTER_BITS = 1 << 27
_SLICE, _TABLE = 512, 1 << 22
RESULT = "doc_id bigint, item_id bigint, tiles int, words int, longest int, coverage double"


def plain_words(text: str) -> list[str]:
    """Words as runs of a-z and 0-9 of the lower-cased text, without markup commands."""
    return _WORD.findall(_COMMAND.sub(" ", text).lower() if "\\" in text else text.lower())


def plain_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the :func:`plain_words` of many texts, and where each text's words begin."""
    return word_hashes([_COMMAND.sub(" ", t) if t and "\\" in t else t for t in texts])


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``length`` word hashes."""
    total = np.zeros(max(0, len(words) - length + 1), np.uint64)
    for j in range(length):
        total = total * _BASE + words[j : j + len(total)]
    return total ^ total >> np.uint64(31)


def _seeds(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and text number of every window of ``length`` words that lies within one text."""
    every = window_hashes(words, length)
    owner = np.searchsorted(bounds, np.arange(len(every)), side="right") - 1
    place = np.flatnonzero(np.arange(len(every)) + length <= bounds[owner + 1]) if len(every) else np.empty(0, np.int64)
    return every[place], place, owner[place]


@dataclass
class Items:
    """Test items prepared for the search: hashes of their words and of every window of ``length`` words, ascending, with their owners."""

    keys: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    table: np.ndarray
    length: int

    @staticmethod
    def of(rows: list[tuple[int, str]], length: int) -> Items:
        words, bounds = plain_hashes([text for _, text in rows])
        every, _, owner = _seeds(words, bounds, length)
        pairs = np.unique(np.stack([every, owner.astype(np.uint64)], axis=1), axis=0) if len(every) else np.empty((0, 2), np.uint64)
        seeds, first = np.unique(pairs[:, 0], return_index=True)
        table = np.zeros(_TABLE, bool)
        table[(seeds & np.uint64(_TABLE - 1)).astype(np.int64)] = True
        return Items(np.array([key for key, _ in rows], np.int64), np.split(words, bounds[1:-1]), seeds, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64), table, length)


class _Words:
    """Word hashes with running powers, so that the hash of any window of any length is one step."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free
        n = len(words)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE)))
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n, _INVERSE)))
            self.total = np.append(np.uint64(0), np.cumsum((words ^ words >> np.uint64(29)) * up[:n]))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of unmarked words."""
        marked_before = np.append(0, np.cumsum(~self.free))
        at = np.flatnonzero(marked_before[length:] == marked_before[:-length]) if length <= len(self.words) else np.empty(0, np.int64)
        return at, (self.total[at + length] - self.total[at]) * self.down[at]


def _longest(free: np.ndarray) -> int:
    """The length of the longest run of unmarked words."""
    edge = np.flatnonzero(np.diff(free, prepend=False, append=False))
    return int((edge[1::2] - edge[::2]).max(initial=0))


def tiles(left: np.ndarray, right: np.ndarray, length: int, free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in left, place in right, length) of non-overlapping equal runs of at least ``length`` words.

    The longest run of unmarked words that both have is found by bisection over its length, comparing running
    hashes of windows; all runs of that length are marked, from left to right, each with the first free place it
    has on the right, and then the next longest is sought. Equal places are found by sorting, never pair by
    pair, so repetitive texts cost as much as others. Runs are compared word by word before they are marked.
    ``free`` tells which words of ``left`` may be in runs.
    """
    a = _Words(left, np.ones(len(left), bool) if free is None else free.copy())
    b = _Words(right, np.ones(len(right), bool))

    def common(size: int) -> bool:
        return bool(np.isin(a.windows(size)[1], b.windows(size)[1]).any())

    found, most = [], len(right)
    while (most := min(most, _longest(a.free), _longest(b.free))) >= length and common(length):
        low, high = most if common(most) else length, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        at, hashes = a.windows(low)
        there, others = b.windows(low)
        order = np.argsort(others, kind="stable")
        there, others = there[order], others[order]
        kept = np.isin(hashes, others)
        at, hashes = at[kept], hashes[kept]
        following = {h: i for h, i in zip(hashes.tolist(), np.searchsorted(others, hashes).tolist(), strict=True)}
        end = 0
        for i, h in zip(at.tolist(), hashes.tolist(), strict=True):
            if i < end:
                continue
            n = following[h]
            # places that are marked stay so, so each is passed over once
            while n < len(others) and int(others[n]) == h and not (b.free[there[n]] and b.free[there[n] + low - 1]):
                n += 1
            following[h] = n
            if n < len(others) and int(others[n]) == h and (left[i : i + low] == right[there[n] : there[n] + low]).all():
                a.free[i : i + low] = b.free[there[n] : there[n] + low] = False
                found.append((i, int(there[n]), low))
                end = i + low
        most = low - 1
    return found


def _search(shared, least_coverage: float):
    def run(batches):
        items: Items = shared.value
        length = items.length
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows if len(items.seeds) else 0, _SLICE):
                words, bounds = plain_hashes(texts.slice(at, _SLICE).to_pylist())
                every = window_hashes(words, length)
                # a small table leaves out most windows before their exact hashes are looked up
                near = np.flatnonzero(items.table[(every & np.uint64(_TABLE - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(items.seeds, every[near]), len(items.seeds) - 1)
                near, place = (x[items.seeds[place] == every[near]] for x in (near, place))
                document = np.searchsorted(bounds, near, side="right") - 1
                inside = near + length <= bounds[document + 1]
                near, place, document = near[inside], place[inside], document[inside]
                if not len(near):
                    continue
                found, hits = np.unique(np.stack([document, place], axis=1), axis=0, return_counts=True)
                many = items.first[found[:, 1] + 1] - items.first[found[:, 1]]
                offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                owner = items.owners[np.repeat(items.first[found[:, 1]], many) + offset]
                pairs, inverse = np.unique(np.stack([np.repeat(found[:, 0], many), owner], axis=1), axis=0, return_inverse=True)
                hits = np.bincount(inverse.ravel(), np.repeat(hits, many))
                free = np.zeros(len(words) + 1, np.int64)
                np.add.at(free, near, 1)
                np.add.at(free, near + length, -1)
                free = np.cumsum(free)[:-1] > 0
                rows = []
                for (d, item), count in zip(pairs.tolist(), hits.tolist(), strict=True):
                    # so many windows cover at most this many words of the item
                    if count * length >= least_coverage * len(items.words[item]):
                        own = slice(bounds[d], bounds[d + 1])
                        rows.append(_row(keys[at + d].as_py(), int(items.keys[item]), words[own], items.words[item], length, least_coverage, free[own]))
                yield from _batches(rows)

    return run


def _row(doc: int, item: int, left: np.ndarray, right: np.ndarray, length: int, least: float, free: np.ndarray | None = None) -> tuple | None:
    """A row of the result, or None if the tiles cover too little of the item."""
    if free is not None:
        # words in no seed are in no tile: of each gap one word is kept as a border
        kept = free | np.append(False, free[:-1])
        left, free = left[kept], free[kept]
    runs = [n for *_, n in tiles(left, right, length, free)]
    covered = sum(runs)
    return (doc, item, len(runs), covered, max(runs), covered / len(right)) if runs and covered >= least * len(right) else None


def _batches(rows: list[tuple | None]):
    rows = [r for r in rows if r is not None]
    if rows:
        doc, item, count, words, longest, coverage = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "item_id": pa.array(item, pa.int64()), "tiles": pa.array(count, pa.int32()), "words": pa.array(words, pa.int32()), "longest": pa.array(longest, pa.int32()), "coverage": pa.array(coverage, pa.float64())})


def _text_seeds(length: int, wanted=None):
    """(key, text number, seed): the distinct windows of each text, of those that pass the filter if there is one."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                every, _, owner = _seeds(*plain_hashes(part.columns[2].to_pylist()), length)
                if wanted is not None:
                    passed = marked(wanted.value, every)
                    every, owner = every[passed], owner[passed]
                pairs = np.unique(np.stack([owner.astype(np.uint64), every], axis=1), axis=0) if len(every) else np.empty((0, 2), np.uint64)
                rows = pa.array(pairs[:, 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(pairs[:, 1].view(np.int64))], names=["key", "h", "seed"])

    return run


def _tile_pairs(length: int, least_coverage: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                docs, items = (plain_hashes(part.column(i).to_pylist()) for i in (2, 3))
                rows = []
                for i in range(part.num_rows):
                    left, right = (w[b[i] : b[i + 1]] for w, b in (docs, items))
                    rows.append(_row(part.column(0)[i].as_py(), part.column(1)[i].as_py(), left, right, length, least_coverage))
                yield from _batches(rows)

    return run


def _joined(source: DataFrame, tests: DataFrame, length: int, least_coverage: float) -> DataFrame:
    """The search for any amount of items: windows of documents that pass a filter are joined to the items' windows.

    One pass over the documents; only seeds and the texts of documents that share one are shuffled, and a
    seed, document or item of very many pairs is split over tasks.
    """
    spark = source.sparkSession
    schema = "key bigint, h bigint, seed bigint"
    of_items = materialise(tests.select(F.col("item_id").alias("key"), F.lit(0).cast("bigint").alias("h"), "text").mapInArrow(_text_seeds(length), schema).select("seed", F.col("key").alias("item_id")), "seeds")
    wanted = spark.sparkContext.broadcast(bitmap(of_items.select("seed"), FILTER_BITS))
    texts = source.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("h"), "text")
    of_documents = materialise(texts.mapInArrow(_text_seeds(length, wanted), schema), "hits")
    # the side with more rows a seed is split: a seed is frequent in documents before it is in items
    pairs = materialise(split_join(of_documents, of_items, ["seed"]).select("key", "h", "item_id").distinct(), "pairs")
    chosen = spark.sparkContext.broadcast(bitmap(pairs.select(F.xxhash64("key", "h").alias("b")), FILTER_BITS))
    candidates = texts.where(bit_of(chosen)(F.xxhash64("key", "h"))).dropDuplicates(["key", "h"])
    both = split_joins(pairs, [(candidates.withColumnRenamed("text", "document"), ["key", "h"]), (tests.select("item_id", "text"), ["item_id"])])
    return both.select("key", "item_id", "document", "text").mapInArrow(_tile_pairs(length, least_coverage), RESULT)


def leaks(documents: DataFrame, items: DataFrame, length: int = 13, least_coverage: float = 0.0, item_chars: int = ITEM_CHARS) -> DataFrame:
    """``(doc_id, item_id, tiles, words, longest, coverage)`` of every document with passages of a test item.

    ``documents`` has ``doc_id, text``; ``items`` has ``item_id, text``. A tile is a run of at least
    ``length`` equal consecutive words; ``words`` is how many of the item's words lie in tiles, ``longest``
    the longest tile, ``coverage`` the share of the item's words. Pairs under ``least_coverage`` are left out.

    The documents are read once, whatever the amount of items. Up to ``item_chars`` characters of items are
    broadcast, and no document is shuffled; more are joined by their seeds, see :func:`_joined`. The result is
    the same. Null keys, null and empty texts and items shorter than ``length`` words give no row. An item
    repeated under the same id unchanged counts once; of different texts under one id the smallest is used.
    Documents repeated unchanged count once; different texts of one id give a row each.
    """
    spark = documents.sparkSession
    tests = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").groupBy("item_id").agg(F.min("text").alias("text"))
    source = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    if not total:
        return spark.createDataFrame([], RESULT)
    if total > item_chars:
        return _joined(source, tests, length, least_coverage).distinct()
    shared = spark.sparkContext.broadcast(Items.of([(r.item_id, r.text) for r in tests.orderBy("item_id").collect()], length))
    return source.mapInArrow(_search(shared, least_coverage), RESULT).distinct()
