import ast
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_nothing_outside_imports_the_llm_subpackage():
    for path in (ROOT / "vecloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "vecloom").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_works_without_the_llm_subpackage(tmp_path):
    code = "import sys; sys.modules['vecloom.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'p2_found' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    import vecloom.queries as core

    db = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    for name, run in core.QUERIES.items():
        df = run(spark, DATA)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
        if name in core.SQL:
            chosen = ", ".join(f'"{c}"' for c in columns)
            assert got == sorted(map(repr, db.execute(f"select {chosen} from ({core.SQL[name]})").fetchall())), name
