import math

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, connection, name):
    compare(catalogue.queries()[name](spark, SF), connection, catalogue.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["tpch_q06"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_comment" not in plan and "l_orderkey" not in plan


def test_nothing_outside_llm_imports_it():
    import pathlib
    import re

    root = pathlib.Path(catalogue.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


LARGER = "/root/testdata/sf0.01"
#: Queries that cover a whole table, and the key of which every value comes back.
WHOLE = {
    "fn_date": ("orders", "o_orderkey", "o_orderkey"),
    "fn_interval": ("orders", "o_orderkey", "o_orderkey"),
    "fn_math": ("events", "event_id", "event_id"),
    "fn_timestamp": ("events", "event_id", "event_id"),
    "fn_number_theory": ("orders", "o_orderkey", "o_orderkey"),
    "arithmetic": ("orders", "o_orderkey", "o_orderkey"),
    "fn_math_more": ("events", "event_id", "event_id"),
    "fn_to_char": ("events", "event_id", "event_id"),
    "unnest_array": ("embeddings", "vec_id", "vec_id"),
    "join_full": ("customer", "c_custkey", "l"),
    "join_natural": ("lineitem", "l_orderkey", "l_orderkey"),
    "join_anti_theta": ("lineitem", "l_orderkey", "l_orderkey"),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_tables(spark, name):
    table, key, out = WHOLE[name]
    want = {r[0] for r in spark.read.parquet(f"{LARGER}/{table}.parquet").select(key).distinct().collect()}
    assert {r[0] for r in catalogue.queries()[name](spark, LARGER).select(out).distinct().collect()} == want


@pytest.mark.parametrize("name", ["join_semi_theta", "intersect_all"])
def test_whole_tables_by_sql(spark, name):
    n = compare(catalogue.queries()[name](spark, LARGER), duck(LARGER), catalogue.oracle_sql()[name])
    assert n == {"join_semi_theta": 58845, "intersect_all": 25}[name]


def test_full_join_keeps_both_sides(spark, tmp_path):
    spark.createDataFrame([(70,), (71,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(5,), (71,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.l, r.r) for r in catalogue.queries()["join_full"](spark, str(tmp_path)).collect()}
    assert got == {(70, None), (71, 71), (None, 5)}


@pytest.mark.parametrize("name", ["fn_math", "fn_math_more"])
def test_logarithms_of_no_positive_number(spark, tmp_path, name):
    rows = [(i, i, v) for i, v in enumerate([0.0, -1.0, -2.5, None, 1.0, 12.34])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/rows")
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert compare(catalogue.queries()[name](spark, str(tmp_path)), duck(tmp_path), catalogue.oracle_sql()[name]) == 6
    column = {"fn_math": "g", "fn_math_more": "m"}[name]
    got = {r.event_id: r[column] for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert got[{"fn_math": 0, "fn_math_more": 1}[name]] == float("-inf") and math.isnan(got[2]) and got[3] is None


@pytest.mark.parametrize("name, table, columns", [("fn_to_char", "events", "abcd"), ("fn_timestamp", "events", "d"), ("fn_date", "orders", "f")])
def test_years_beyond_four_digits(spark, tmp_path, name, table, columns):
    days = [0, 2932896, 2932897, 5999999, 35999999, -719528, -719529, -800000]
    duck(tmp_path).execute(f"COPY (SELECT d AS event_id, d AS o_orderkey, TIMESTAMP '1970-01-01' + to_seconds(d * 86400) AS ts, ts AS o_orderdate FROM (SELECT CAST(unnest({days}) AS BIGINT) AS d)) TO '{tmp_path}/{table}.parquet'")
    # Python has no such dates, so only the letters are compared
    got = catalogue.queries()[name](spark, str(tmp_path)).select(*columns)
    assert compare(got, duck(tmp_path), f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})") == len(days)
