"""The driver's core queries against DuckDB."""

import itertools

import duckdb
import pandas as pd
import pytest

from corvane import queries as core

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in core.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_same_as_duckdb(spark, duck, name):
    frame = core.queries()[name](spark, SF)
    found = duck.execute(core.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = [tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in found.fetchall()]
    got = [tuple(r[c] for c in sorted(columns)) for r in frame.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_division_as_in_duckdb_for_odd_doubles(spark, tmp_path):
    odd = ["0", "-0", "1", "-1", "3.7", "-3.7", "nan", "inf", "-inf", "1e308", "-1e308", "5e-324", "-5e-324", None]
    frame = pd.DataFrame([(i, 1, x, y) for i, (x, y) in enumerate(itertools.product(odd, odd))], columns=["l_orderkey", "l_linenumber", "l_quantity", "l_tax"])
    c = duckdb.connect()
    c.register("frame", frame.astype({"l_linenumber": "int32"}))
    c.execute(f"COPY (SELECT * REPLACE (l_quantity::DOUBLE AS l_quantity, l_tax::DOUBLE AS l_tax) FROM frame) TO '{tmp_path}/lineitem.parquet'")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert c.execute("SELECT COUNT(*) FROM lineitem WHERE 1 / l_tax = '-inf'::DOUBLE").fetchone()[0] >= len(odd)
    want = c.execute(core.oracle_sql()["div_zero"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in core.queries()["div_zero"](spark, str(tmp_path)).collect())


def test_join_int_double_takes_all_of_lineitem(spark, duck):
    pairs = duck.execute("SELECT COUNT(*) FROM lineitem JOIN nation ON l_quantity = n_nationkey").fetchone()[0]
    assert core.queries()["join_int_double"](spark, SF).count() == pairs > 1000


def test_computed_alias_takes_all_of_lineitem(spark, duck):
    rows = duck.execute("SELECT COUNT(*) FROM lineitem").fetchone()[0]
    assert core.queries()["computed_alias"](spark, SF).count() == rows > 1000


def test_entry_and_every_query_has_an_oracle(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.queries()) == set(core.oracle_sql())


def test_imports_without_the_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{root}/{f}", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(k[:2] == 'op' and k[2].isdigit() for k in e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["0", "False"]
