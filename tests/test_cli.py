import json

from vecloom.__main__ import main


def test_build_load_search_and_validate(spark, tmp_path, capsys):
    source = tmp_path / "v.jsonl"
    source.write_text('{"id": 101, "values": [1, 0, 0]}\n{"id": 102, "values": [0.8, 0.2, 0]}\n{"id": 103, "values": [0, 1, 0]}\n')
    out = tmp_path / "v.fv"
    assert main(["build", "--input", str(source), "--output", str(out), "--expected-count", "4"]) == 1 and not out.exists()
    assert main(["build", "--input", str(source), "--output", str(out), "--expected-count", "3"]) == 0
    made = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert made["vector_count"] == 3 and main(["build", "--input", str(source), "--output", str(out)]) == 1
    assert main(["describe", "--index", str(out), "--index-type", "flat", "--dimension", "3", "--count", "3"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == made
    store = f"file://{tmp_path}/store"
    assert main(["load", "--input", str(source), "--store", store]) == 0 and main(["search", "--store", store, "--query", "1,0,0", "--k", "2"]) == 0
    assert [r["id"] for r in json.loads(capsys.readouterr().out.splitlines()[-1])] == [101, 102]
    assert main(["compact", "--store", store]) == 0
    (tmp_path / "v.csv").write_text("id,x0,x1\n" + "".join(f"{i},{i % 7 - 3},{i % 5 + 1}\n" for i in range(40)))
    (tmp_path / "q.csv").write_text("query_id,x0,x1\n0,1,1\n1,-1,2\n")
    common = ["validate", "--vectors", str(tmp_path / "v.csv"), "--queries", str(tmp_path / "q.csv"), "--k", "5"]
    assert main([*common, "--index", "hnsw", "--minimum-recall", "0.9"]) == 0 and main([*common, "--minimum-recall", "1.1"]) == 1
    docs = tmp_path / "d.jsonl"
    docs.write_text('{"document_id": "a", "text": "one two three four five six"}\n')
    assert main(["chunk", "--input", str(docs), "--output", str(tmp_path / "c"), "--words", "4", "--overlap", "2"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"chunks": 2}
