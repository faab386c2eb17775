"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from skein.plans.catalogue import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([None if pd.api.types.is_scalar(x) and pd.isna(x) else str(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in ORACLE:
        want = sql.execute(ORACLE[name]).fetch_df()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(got) == rows(want)


def test_the_entry_works_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "skein", tmp_path / "skein", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries() and len(e.queries()) > 40"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
