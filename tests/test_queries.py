import duckdb
import pathlib
import subprocess
import sys

import pandas as pd
import pytest

from conftest import ROOT, SF
from vecloom.plans import registry


def views():
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    text = lambda x: "" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(views().execute(registry.ORACLES[name]).df())
    else:
        assert len(got)


def test_filter_reaches_scan(spark, capsys):
    from vecloom.operators import knn

    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    knn.knn(df, df, vector="embedding", pk="vec_id", where="label < 5").explain("formatted")
    said = capsys.readouterr().out
    assert "LessThan(label,5)" in said and "WindowGroupLimit" in said
    registry.QUERIES["vector_norms"](spark, SF).explain("formatted")
    assert "BatchEvalPython" not in capsys.readouterr().out


def test_without_llm(tmp_path):
    """The entry module and the library do without the llm part."""
    code = "import sys; sys.modules['vecloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'knn_cosine' in e.queries() and e.oracle_sql(); assert not any('op1' in k for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in pathlib.Path(ROOT, "vecloom").rglob("*.py"):
        assert "llm" in p.parts or "vecloom.llm" not in p.read_text()
