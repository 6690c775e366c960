"""Problem 5: texts that recur with small edits, found by covering locality-sensitive hashing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.arrow_vectors import pack, unpack
from vecloom.llm.bitmaps import bitmap, marked
from vecloom.llm.shingles import mixed, shingle_sets
from vecloom.operators.components import connected_components
from vecloom.operators.skew import split_join, split_joins
from vecloom.session import materialise, stored_rows

#: A text's sketch has PARTS groups of 7 minimum hashes.
PARTS = 8
#: For every non-zero mask of 3 bits, the positions 1..7 that share an odd number of bits with it: 4 of the 7.
MASKS = [[i - 1 for i in range(1, 8) if (i & mask).bit_count() % 2] for mask in range(1, 8)]
TABLES = PARTS * len(MASKS)
#: Sketches of a candidate pair agree in at least so many positions; at a similarity of 0.7 they do but for a probability under 1e-8.
LEAST_EQUAL = PARTS * 7 // 3
#: Buckets expected to hold more texts are compared in blocks of BLOCK texts. Up to MAX_HOT such buckets are broadcast, more are joined.
HOT_BUCKET, BLOCK, MAX_HOT = 2_048, 512, 65_536
_SAMPLED = 64
#: Rows of keys and numbers only that one task may hold of a class; of texts and sets it is the default of split_join.
NARROW = 1_000_000
#: Bits of the filter by which texts outside every candidate pair are passed over: 4 MB broadcast at most.
FILTER_BITS = 1 << 25
_SLICE = 512
_COEFFICIENTS = np.random.default_rng(20_240_611).integers(1, 1 << 63, size=(2, PARTS * 7), dtype=np.uint64)
_COEFFICIENTS[0] |= np.uint64(1)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes of each (non-empty) set: two sets agree at a position with probability equal to their Jaccard similarity."""
    flat = np.concatenate(sets)
    starts = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    out = np.empty((len(sets), PARTS * 7), np.uint32)
    for k, (a, b) in enumerate(_COEFFICIENTS.T):
        out[:, k] = np.minimum.reduceat(flat * a + b, starts) >> np.uint64(32)
    return out


def table_keys(sketches: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One key per table: the four positions a mask keeps of a part, hashed with the table's number and ``salt``."""
    keys = np.empty((len(sketches), TABLES), np.uint64)
    for part in range(PARTS):
        for m, mask in enumerate(MASKS):
            table = part * len(MASKS) + m
            key = salt + np.uint64(table + 1)
            for position in mask:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sketches[:, part * 7 + position])
            keys[:, table] = key
    return keys


def class_numbers(kinds: list[str], sets: list[np.ndarray], bits: int = 64) -> tuple[pa.Array, pa.Array]:
    """A number of ``bits`` bits and one of 64 bits that together are a hash of each kind and set."""
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16, key=k.encode()[:64]).digest() for k, s in zip(kinds, sets, strict=True)]
    numbers = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(numbers[:, 0] >> (64 - bits)), pa.array(np.ascontiguousarray(numbers[:, 1]))


def _told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """``rows`` (with ``kind, class, check``) in which a class number that stands for several sets is kept by one of them."""
    if clashes is None:
        return rows
    joined = rows.join(clashes, ["kind", "class"], "left")
    other = F.col("kept").isNotNull() & (F.col("kept") != F.col("check"))
    return joined.withColumn("class", F.when(other, F.xxhash64("class", "check")).otherwise(F.col("class"))).select(rows.columns)


def _sketch_texts(words: int, least_words: int, class_bits: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                sets = shingle_sets(part.column(2).to_pylist(), words, least_words)
                kept = [i for i, s in enumerate(sets) if s is not None]
                if not kept:
                    continue
                own = [sets[i] for i in kept]
                rows = pa.array(kept)
                kinds = part.column(0).take(rows)
                yield pa.RecordBatch.from_arrays([kinds, part.column(1).take(rows), *class_numbers(kinds.to_pylist(), own, class_bits), pack(sketch(own))], names=["kind", "key", "class", "check", "sketch"])

    return run


def _keys_of(batches):
    """Table keys of every class; the kind is part of the hash, so kinds never meet."""
    for batch in batches:
        if batch.num_rows:
            kinds = batch.column(0).to_pylist()
            salts = {k: np.frombuffer(hashlib.blake2b(k.encode(), digest_size=8).digest(), np.uint64)[0] for k in set(kinds)}
            keys = table_keys(unpack(batch.column(2), PARTS * 7, np.uint32), np.array([salts[k] for k in kinds], np.uint64)).view(np.int64)
            offsets = pa.array((np.arange(len(keys) + 1) * TABLES).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["kind", "key", "buckets"])


def _pairs_of_sorted(batches):
    """All pairs of each bucket from rows sorted by bucket; a bucket may span batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.asarray(batch.column(2).to_pylist(), object))
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        held = tuple(x[last:] for x in rows)
        yield from _all_pairs(*(x[:last] for x in rows))
    if held is not None:
        yield from _all_pairs(*held)


def _all_pairs(bucket: np.ndarray, key: np.ndarray, kind: np.ndarray):
    at, step = np.arange(len(bucket)), 0
    while True:
        step += 1
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        if not len(at):
            return
        a, b = key[at], key[at + step]
        yield pa.RecordBatch.from_arrays([pa.array(kind[at], pa.string()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["kind", "a", "b"])


def _pairs_of_blocks(least_equal: int):
    """Pairs across two blocks of a large bucket whose sketches agree enough, each only in the first table it meets in."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, left, right = (x.as_py() for x in key)
        keys, block, kind, here = table["key"].to_numpy(), table["block"].to_numpy(), table["kind"][0].as_py(), table["table"][0].as_py()
        sketches = unpack(table["sketch"], PARTS * 7, np.uint32)
        i, j = np.flatnonzero(block == left), np.flatnonzero(block == right)
        equal = np.zeros((len(i), len(j)), np.uint8)
        first = np.full((len(i), len(j)), TABLES, np.int16)
        for part in range(PARTS):
            same = [sketches[i, part * 7 + p][:, None] == sketches[j, part * 7 + p][None, :] for p in range(7)]
            equal += sum(s.astype(np.uint8) for s in same)
            for m, mask in enumerate(MASKS):
                meets = same[mask[0]] & same[mask[1]] & same[mask[2]] & same[mask[3]]
                first[meets & (first == TABLES)] = part * len(MASKS) + m
        a, b = np.nonzero((first == here) & (equal >= least_equal))
        a, b = keys[i[a]], keys[j[b]]
        once = a < b if left == right else a != b
        return pa.table({"kind": pa.array([kind] * int(once.sum()), pa.string()), "a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once]})

    return run


def _agreeing(least_equal: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                equal = (unpack(batch.column(3), PARTS * 7, np.uint32) == unpack(batch.column(4), PARTS * 7, np.uint32)).sum(axis=1)
                rows = pa.array(np.flatnonzero(equal >= least_equal))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(rows) for i in range(3)], names=["kind", "a", "b"])

    return run


def candidate_pairs(classes: DataFrame, hot_bucket: int = HOT_BUCKET, block: int = BLOCK, least_equal: int = LEAST_EQUAL, max_hot: int = MAX_HOT) -> DataFrame:
    """``(kind, a, b)``: pairs of classes (``kind, key, sketch``) that meet in at least one covering table and agree
    in at least ``least_equal`` positions, once each.

    Two sketches that differ in at most 3 * PARTS - 1 positions differ in at most 2 of some part's 7, and
    every choice of 2 positions is avoided by one of that part's masks: such a pair always meets.

    Buckets found large in a sample of the classes are not paired within one task: their members are dealt
    into blocks, and each pair of blocks is a task of its own that compares the sketches first. The rule is the same
    for every bucket, and no bucket is cut short.
    """
    keyed = classes.select("kind", "key", "sketch").mapInArrow(_keys_of, "kind string, key bigint, buckets array<bigint>")
    some = classes.where(F.pmod(F.xxhash64("kind", "key", F.lit(11)), F.lit(_SAMPLED)) == 0).select("kind", "key", "sketch")
    sampled = some.mapInArrow(_keys_of, "kind string, key bigint, buckets array<bigint>").select(F.explode("buckets").alias("bucket"))
    often = sampled.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") >= max(2, hot_bucket // _SAMPLED))
    hot = materialise(often.select("bucket", F.greatest(F.lit(1), F.floor(F.col("c") * _SAMPLED / block)).cast("int").alias("blocks")), "hot")
    rows = keyed.select("kind", "key", F.posexplode("buckets").alias("table", "bucket"))
    count = stored_rows(hot) if stored_rows(hot) is not None else hot.count()
    if count:
        told = F.broadcast(hot) if count <= max_hot else hot
        large = rows.join(told, "bucket").join(classes.select("kind", "key", "sketch"), ["kind", "key"])
        large = large.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        large = large.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        large = large.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
        across = large.select("bucket", "left", "right", "kind", "key", "block", "table", "sketch").groupBy("bucket", "left", "right").applyInArrow(_pairs_of_blocks(least_equal), "kind string, a bigint, b bigint")
        rows = rows.join(told, "bucket", "left_anti")
    met = materialise(_paired(rows).distinct(), "met")
    sketch_of = lambda end, name: classes.select("kind", F.col("key").alias(end), F.col("sketch").alias(name))
    alike = split_joins(met, [(sketch_of("a", "x"), ["kind", "a"]), (sketch_of("b", "y"), ["kind", "b"])]).select("kind", "a", "b", "x", "y").mapInArrow(_agreeing(least_equal), "kind string, a bigint, b bigint")
    return alike.unionByName(across).distinct() if count else alike


def _paired(rows: DataFrame) -> DataFrame:
    return rows.select("bucket", "key", "kind").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pairs_of_sorted, "kind string, a bigint, b bigint")


def _packed_sets(words: int, least_words: int, wanted, class_bits: int):
    """Shingle sets of the texts that the filter lets through, as sorted 40-bit numbers."""

    def run(batches):
        for batch in batches:
            rows = np.flatnonzero(marked(wanted.value, batch.column(3).to_numpy()))
            for at in range(0, len(rows), _SLICE):
                part = batch.take(pa.array(rows[at : at + _SLICE]))
                sets = shingle_sets(part.column(2).to_pylist(), words, least_words)
                kept = [i for i, x in enumerate(sets) if x is not None]
                if kept:
                    kinds, own = part.column(0).take(pa.array(kept)), [sets[i] for i in kept]
                    packed = [(x >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for x in own]
                    yield pa.RecordBatch.from_arrays([kinds, *class_numbers(kinds.to_pylist(), own, class_bits), pa.array(packed, pa.binary())], names=["kind", "class", "check", "shingles"])

    return run


def _verify(least: float):
    def unpacked(data: bytes) -> np.ndarray:
        wide = np.zeros((len(data) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
        return wide.view(np.uint64)[:, 0]

    def run(batches):
        for batch in batches:
            keep, scores = [], []
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                both = np.sort(np.concatenate([unpacked(x), unpacked(y)]))
                common = int((both[1:] == both[:-1]).sum())
                score = common / (len(both) - common)
                if score >= least:
                    keep.append(i)
                    scores.append(score)
            if keep:
                rows = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(rows) for j in range(3)), pa.array(scores)], names=["kind", "a", "b", "similarity"])

    return run


def near_duplicates(
    texts: DataFrame, least: float = 0.7, words: int = 3, least_words: int = 30, hot_bucket: int = HOT_BUCKET, block: int = BLOCK, filter_bits: int = FILTER_BITS, class_bits: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with equal shingle sets, and the similar pairs between classes.

    ``texts`` has ``kind STRING, key BIGINT, text STRING``. The first result is ``kind, key, class, rep,
    size``: a row for every distinct (key, class) with the class's number, smallest key and number of keys.
    The second is ``kind, a, b, similarity``: pairs of classes whose sets of runs of ``words`` words have a
    Jaccard similarity of at least ``least``, each pair once. Together they state every link between texts
    of one kind; nothing is dropped for being frequent. A key with several texts lies in several classes.

    Candidates come from :func:`candidate_pairs`; each is checked on its whole sets of 40-bit shingle hashes.
    Classes are named by ``class_bits`` bits of a hash of their set; where another 64 bits show that several sets
    have one name, all but one of them are renamed. Rows with a null kind, key or text and texts under
    ``least_words`` words are in neither result; an empty table gives none. Other columns are ignored.
    """
    source = texts.where("kind is not null and key is not null and text is not null").select("kind", F.col("key").cast("bigint").alias("key"), "text")
    sketched = materialise(source.mapInArrow(_sketch_texts(words, least_words, class_bits), "kind string, key bigint, class bigint, check bigint, sketch binary"), "sketches")

    def classes_of(rows: DataFrame) -> DataFrame:
        return materialise(rows.groupBy("kind", "class").agg(F.min("key").alias("rep"), F.first("sketch").alias("sketch"), F.min("check").alias("kept"), F.max("check").alias("most")), "classes")

    classes, clashes = classes_of(sketched), None
    doubtful = classes.where("kept <> most").select("kind", "class", "kept")
    if not doubtful.isEmpty():
        clashes = materialise(doubtful, "clashes")
        classes = classes_of(_told_apart(sketched, clashes))
    keys = _told_apart(sketched.select("kind", "key", "class", "check"), clashes).select("kind", "key", "class").distinct()
    most = stored_rows(sketched)
    keys = keys if most is not None and most <= NARROW else materialise(keys, "keys")
    sizes = keys.groupBy("kind", "class").agg(F.min("key").alias("rep"), F.count("*").alias("size"))
    members = split_join(keys, sizes, ["kind", "class"], NARROW, total=stored_rows(keys) or most)
    pairs = materialise(candidate_pairs(classes.select("kind", F.col("class").alias("key"), "sketch"), hot_bucket, block), "candidates")

    ends = pairs.select("kind", F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = materialise(classes.select("kind", "class", "rep").join(ends, ["kind", "class"], "left_semi").select(F.xxhash64("kind", F.col("rep")).alias("place")), "wanted")
    bits = max(32, min(filter_bits, 1 << (32 * max(2, (stored_rows(wanted) or wanted.count()))).bit_length()))
    let_through = source.sparkSession.sparkContext.broadcast(bitmap(wanted, bits))
    sets = source.select("kind", "key", "text", F.xxhash64("kind", "key").alias("place")).mapInArrow(_packed_sets(words, least_words, let_through, class_bits), "kind string, class bigint, check bigint, shingles binary")
    sets = materialise(_told_apart(sets, clashes).select("kind", "class", "shingles").dropDuplicates(["kind", "class"]), "sets")
    set_of = lambda end, name: sets.select("kind", F.col("class").alias(end), F.col("shingles").alias(name))
    both = split_joins(pairs, [(set_of("a", "x"), ["kind", "a"]), (set_of("b", "y"), ["kind", "b"])])
    similar = both.select("kind", "a", "b", "x", "y").mapInArrow(_verify(least), "kind string, a bigint, b bigint, similarity double")
    return members, similar


def _expanded(left: DataFrame, right: DataFrame, on: list[str], block: int = 1024) -> DataFrame:
    """Pairs of keys of two classes: ``left`` and ``right`` have ``on``, a key and the class's size.

    A class with more than ``block`` keys is dealt into parts on the left that meet the right side's rows in
    different tasks.
    """
    parts = lambda size: F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    dealt = left.withColumn("part", F.pmod(F.xxhash64("key_l"), parts("size_l")).cast("int"))
    spread = right.withColumn("part", F.explode(F.sequence(F.lit(0), parts("size_of_l") - 1)))
    return dealt.join(spread, [*on, "part"])


def duplicate_pairs(texts: DataFrame, least: float = 0.7, words: int = 3, least_words: int = 30, **options) -> DataFrame:
    """``(kind, key_a, key_b)``: every pair of different keys with similar texts, smaller key first, once.

    A class of copies may hold any share of the rows: its members are split over tasks in every join.
    """
    members, similar = near_duplicates(texts, least, words, least_words, **options)
    members = materialise(members, "members")
    sized = members.select("kind", F.col("class").alias("a"), F.col("size").alias("size_of_l")).distinct()
    links = similar.select("kind", "a", "b")
    own = members.where("size > 1").select("kind", F.col("class").alias("a"), F.col("class").alias("b")).distinct()
    every = materialise(links.unionByName(own), "links")
    every = split_join(every, sized, ["kind", "a"], NARROW)
    of = lambda side, end: members.select("kind", F.col("class").alias(end), F.col("key").alias(f"key_{side}"), F.col("size").alias(f"size_{side}"))
    right = split_join(of("r", "b"), every, ["kind", "b"], NARROW, total=stored_rows(members))
    pairs = _expanded(of("l", "a"), right.select("kind", "a", "key_r", "size_of_l"), ["kind", "a"]).where("key_l <> key_r")
    return pairs.select("kind", F.least("key_l", "key_r").alias("key_a"), F.greatest("key_l", "key_r").alias("key_b")).distinct()


def duplicate_groups(texts: DataFrame, least: float = 0.7, words: int = 3, least_words: int = 30, **options) -> DataFrame:
    """``(kind, key, group, links)`` of every text that recurs.

    ``group`` is the smallest key that chains of similar texts lead to, ``links`` the number of other (key, text)
    entries that are similar to this one, its exact copies included; a key with several texts has the sum of
    their links. Nothing is expanded into pairs: links are counted from class sizes.
    """
    members, similar = near_duplicates(texts, least, words, least_words, **options)
    members, similar = materialise(members, "members"), materialise(similar.select("kind", "a", "b"), "similar")
    classes = members.select("kind", "class", "rep", "size").distinct()
    both = materialise(similar.select("kind", F.col("a").alias("class"), F.col("b").alias("other")).union(similar.select("kind", F.col("b"), F.col("a"))), "both")
    sizes = classes.select("kind", F.col("class").alias("other"), "size")
    linked = split_join(both, sizes, ["kind", "other"], NARROW).groupBy("kind", "class").agg(F.sum("size").alias("near"))
    chains = connected_components(similar)
    groups = classes.join(chains.withColumnRenamed("node", "class"), "class", "left").withColumn("chain", F.coalesce("component", "class")).drop("component")
    groups = materialise(groups, "groups")
    smallest = groups.groupBy("kind", "chain").agg(F.min("rep").alias("group"))
    counted = split_join(groups, smallest, ["kind", "chain"], NARROW).join(linked, ["kind", "class"], "left").select("kind", "class", "group", (F.coalesce("near", F.lit(0)) + F.col("size") - 1).alias("links"))
    found = split_join(members.select("kind", "key", "class"), counted.where("links > 0"), ["kind", "class"], NARROW, total=stored_rows(members))
    return found.groupBy("kind", "key").agg(F.min("group").alias("group"), F.sum("links").alias("links"))
