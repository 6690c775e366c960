import json
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.errors import InvalidArgument
from vecloom.functions import checksums, text
from vecloom.sources import csv, generate, jsonl, manifest
from vecloom.sources.snapshot_file import FlatFile, GraphFile, read_flat, write_flat

BAD_LINES = [
    "{}",
    '{"id": 1}',
    '{"values": [1.0]}',
    '{"id": -1, "values": [1.0]}',
    '{"id": 01, "values": [1.0]}',
    '{"id": 1, "id": 2, "values": [1.0]}',
    '{"id": 1, "values": [1.0], "extra": 2}',
    '{"id": 1, "values": [1.0,]}',
    '{"id": 1, "values": [1.0]} trailing',
    '{"id": 18446744073709551616, "values": [1.0]}',
    '{"id": 1, "values": [1e1000]}',
    '{"id": 1, "values": [1e39]}',
    '{"id": 1, "values": [NaN]}',
    '{"id": 1.0, "values": [1.0]}',
    '{"id": true, "values": [1.0]}',
    '{"id": 1, "values": [true]}',
    '{"id": 1, "values": ["1"]}',
    '{"\\u0069d": 1, "values": [1.0]}',
    "[1]",
]


@pytest.mark.parametrize("line", BAD_LINES)
def test_malformed_vector_lines(line):
    with pytest.raises(InvalidArgument):
        jsonl.parse_vector(line)


def test_vector_lines(spark, tmp_path):
    path = tmp_path / "v.jsonl"
    path.write_text('{"values": [1, -2.5e0, 0], "id": 18446744073709551615}\n\n \t\r\n{"id":0,"values":[]}\n')
    rows = sorted((int(r.vector_id), r["values"]) for r in jsonl.read_vectors(spark, str(path)).collect())
    assert rows == [(0, []), (18446744073709551615, [1.0, -2.5, 0.0])]
    path.write_text('{"id": 1, "values": [1]}\n{"id": 2}\n')
    with pytest.raises(InvalidArgument, match="exactly"):
        jsonl.read_vectors(spark, str(path))
    assert [(r.line_number, r.value) for r in jsonl.numbered_lines(spark, str(path)).where("value <> ''").collect()] == [(1, '{"id": 1, "values": [1]}'), (2, '{"id": 2}')]


def test_json_lines_round_trip(spark, tmp_path):
    rows = generate.random_vectors(spark, 50, 6)
    jsonl.write_vectors(rows, str(tmp_path / "out"))
    back = jsonl.read_vectors(spark, str(tmp_path / "out")).select(F.col("vector_id").cast("bigint"), "values")
    assert rows.exceptAll(back).isEmpty() and back.exceptAll(rows).isEmpty()
    assert generate.random_vectors(spark, 50, 6).repartition(3).exceptAll(rows).isEmpty()
    flat = [x for r in rows.collect() for x in r["values"]]
    assert -1 <= min(flat) < -0.5 and 0.5 < max(flat) < 1


def test_documents(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('{"document_id": "a", "text": "one"}\n{"document_id": "b", "text": "", "source": "s"}\n')
    assert sorted(map(tuple, jsonl.read_documents(spark, str(path)).collect())) == [("a", "one", ""), ("b", "", "s")]
    for bad in ('{"document_id": "", "text": "x"}', '{"document_id": "a", "text": "x"}\n{"document_id": "a", "text": "y"}', '{"document_id": "a"}'):
        path.write_text(bad + "\n")
        with pytest.raises(InvalidArgument):
            jsonl.read_documents(spark, str(path))


def test_csv_round_trip_and_errors(spark, tmp_path):
    rows = generate.random_vectors(spark, 20, 3, key="id")
    csv.write_vectors(rows.coalesce(1), str(tmp_path / "v"), 3)
    back = csv.read_vectors(spark, str(tmp_path / "v"), dimension=3).select(F.col("id").cast("bigint"), "values")
    assert rows.exceptAll(back).isEmpty() and back.count() == 20
    for content in ("id,x0\n1,2,3\n", "id,x0\n-1,2\n", "id,x0\n1,abc\n", "id,y0\n1,2\n", "id,x0,x1\n1,2,3\n", "id,x0\n18446744073709551616,1\n"):
        (tmp_path / "bad.csv").write_text(content)
        with pytest.raises(InvalidArgument):
            csv.read_vectors(spark, str(tmp_path / "bad.csv"), dimension=1)
    literal = spark.createDataFrame([("1, 0,-2.5",), ("1,x",), (None,)], "c string").select(csv.parse_literal("c").alias("v")).collect()
    assert [r.v for r in literal] == [[1.0, 0.0, -2.5], None, None]


def flat():
    return FlatFile(np.array([7, 2**64 - 1, 0], np.uint64), np.array([[1, 0], [0, -1], [0.6, 0.8]], np.float32))


def test_flat_snapshot_files(spark, tmp_path):
    data = flat().encode()
    assert len(data) == 56 + 3 * 16
    back = FlatFile.decode(data)
    assert (back.ids == flat().ids).all() and (back.vectors == flat().vectors).all()
    for at in range(0, len(data)):
        broken = bytearray(data)
        broken[at] ^= 0x40
        with pytest.raises(Exception):  # noqa: B017
            FlatFile.decode(bytes(broken))
    for size in range(len(data)):
        with pytest.raises(Exception):  # noqa: B017
            FlatFile.decode(data[:size])
    (tmp_path / "a.fv").write_bytes(data)
    rows = read_flat(spark, str(tmp_path / "a.fv"))
    assert sorted(int(r.vector_id) for r in rows.collect()) == [0, 7, 2**64 - 1]
    assert write_flat(rows, str(tmp_path / "b.fv")) == 3
    assert FlatFile.decode((tmp_path / "b.fv").read_bytes()).ids.tolist() == [0, 7, 2**64 - 1]


def test_graph_snapshot_files():
    graph = GraphFile(np.array([101, 102, 999], np.uint64), np.array([[1, 0], [0, 1], [-1, 0]], np.float32), [[[1], []], [[0, 2]], [[1]]], np.array([False, False, True]), max_connections=4)
    data = graph.encode()
    back = GraphFile.decode(data)
    assert back.links == graph.links and back.deleted.tolist() == [False, False, True] and back.ids.tolist() == [101, 102, 999]
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 0x01
        with pytest.raises(Exception):  # noqa: B017
            GraphFile.decode(bytes(broken))
    empty = GraphFile(np.empty(0, np.uint64), np.empty((0, 2), np.float32), [], np.empty(0, bool))
    assert GraphFile.decode(empty.encode()).links == []


def test_checksums(spark):
    assert checksums.fnv1a(b"") == checksums.FNV_OFFSET and checksums.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    rows = spark.createDataFrame([(1, [0.0]), (2, [-0.0]), (3, None)], "i int, v array<float>")
    got = {r.i: r.d for r in rows.select("i", checksums.request_digest("v").alias("d")).collect()}
    assert got[1] != got[2] and got[3] is None
    keys = spark.createDataFrame([(258, "ab")], "epoch bigint, operation_id string").select(checksums.operation_key()).first()[0]
    assert bytes(keys) == struct.pack("<Q", 258) + b"ab"
    table = spark.range(20)
    assert table.agg(checksums.table_digest(["id"])).first() == table.orderBy(F.desc("id")).repartition(3).agg(checksums.table_digest(["id"])).first()


def test_manifests(spark, tmp_path):
    path = tmp_path / "a.fv"
    path.write_bytes(flat().encode())
    made = manifest.create(spark, str(path), "flat", 2, 3, "rev")
    (tmp_path / "m.json").write_text(json.dumps(made))
    assert manifest.read(spark, str(tmp_path / "m.json")) == made == manifest.read(spark, (tmp_path / "m.json").as_uri())
    for change in ({"sha256": "A" * 64}, {"snapshot_id": "x"}, {"dimension": 0}, {"index_type": "other"}, {"format_version": 2}, {"file_size": 55}, {"embedding_revision": "x" * 257}, {"extra": 1}, {"vector_count": True}):
        with pytest.raises(InvalidArgument):
            manifest.validate(spark, made | change)
    (tmp_path / "m.json").write_text(" " * 16_385)
    for source in (str(tmp_path / "m.json"), "ftp://x/y"):
        with pytest.raises(InvalidArgument):
            manifest.read(spark, source)
    with pytest.raises(InvalidArgument):
        manifest.create(spark, str(path), "hnsw", 2, 3)


def test_windows_and_ids(spark, tmp_path):
    assert text.window_texts("one two three four five six", 4, 2) == ["one two three four", "three four five six"]
    assert text.window_texts(" \t\n", 4, 2) == text.window_texts(None, 4, 2) == []
    assert text.window_texts("a b c", 2, 0) == ["a b", "c"]
    for most, overlap in ((0, 0), (4, 4), (3, -1)):
        with pytest.raises(InvalidArgument):
            text.word_windows(spark.createDataFrame([("x",)], "text string"), most, overlap)
    docs = spark.createDataFrame([("doc", "one two three four five six", None), ("n", None, "s"), ("e", "", "s"), ("long", "w " * 50_000, "s")], "document_id string, text string, source string")
    rows = text.chunk_rows(docs, 4, 2)
    by = {(r.document_id, r.chunk_id): r for r in rows.collect()}
    assert int(by["doc", 0].vector_id) == 9160775269061480222 and by["doc", 1].text == "three four five six" and by["doc", 0].source == ""
    assert {d for d, _ in by} == {"doc", "long"} and len(by) == 2 + 24_999
    assert text.chunk_rows(docs.limit(0), 4, 2).count() == 0
    assert docs.select(F.size(text.words("text")).alias("n")).collect()[0].n == 6


def test_dataset_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(Decimal(11), "d", 0, "x", "s"), (Decimal(12), "d", 1, "y", "s")], "vector_id decimal(20,0), document_id string, chunk_id int, text string, source string")
    vectors = spark.createDataFrame([(11, [1.0, 0.0]), (12, [0.0, 1.0])], "vector_id int, values array<float>").select(F.col("vector_id").cast("decimal(20,0)"), "values")
    (tmp_path / "set").mkdir()
    manifest.write_dataset(chunks, vectors, str(tmp_path / "set"), "test", 2, 120, 20)
    made, v, c = manifest.read_dataset(spark, str(tmp_path / "set"))
    assert made["chunk_count"] == 2 and v.count() == c.count() == 2
    with pytest.raises(InvalidArgument):
        manifest.write_dataset(chunks.where("chunk_id = 0"), vectors, str(tmp_path / "other"), "test", 2, 120, 20)
