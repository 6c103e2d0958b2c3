import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tracewright.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name in queries.ORACLE_SQL:
        got = tables.sql(queries.ORACLE_SQL[name])
        assert sorted(got.columns) == columns
        at = [got.columns.index(c) for c in columns]
        assert sorted([plain(r[k]) for k in at] for r in got.fetchall()) == rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_without_the_llm_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for f in (root / "tracewright").rglob("*.py"):
        rest = f.relative_to(root)
        if "llm" not in rest.parts:
            assert "llm" not in f.read_text().replace("(llm)", ""), f
            (tmp_path / rest).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rest).write_bytes(f.read_bytes())
    (tmp_path / "__spark_entry__.py").write_bytes((root / "__spark_entry__.py").read_bytes())
    code = "import __spark_entry__ as e; assert 'i12_search' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
