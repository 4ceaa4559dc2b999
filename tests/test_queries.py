"""Every query runs, and equals its SQL, on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import __spark_entry__ as entry
from helpers import duck, table_of

CORE = [n for m in entry.MODULES if not m.__name__.startswith("nyuzi.llm") for n in m.QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        got = duck(sf).sql(sql)
        assert table_of(rows, df.columns) == table_of(got.fetchall(), got.columns)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0


def test_projection_and_filter_reach_the_scan(spark, sf):
    plan = entry.queries()["q03_speaker_histogram"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<speaker_id:string,language:string>" in plan.replace("\n", "")
    from nyuzi.session import table

    plan = table(spark, sf, "omni_corpus").where("audio_size > 0").select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(audio_size), GreaterThan(audio_size,0)]" in plan
