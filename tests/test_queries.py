"""Every relational query against DuckDB, plans, and random conjunctions."""

import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larkspur.operators.relation import Relation
from larkspur.plans.binder import bind, join_order
from larkspur.plans.syntax import Const, Field, Select, Term
from larkspur.queries import PAIRS, TABLES, dialect

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")


def shown(rows):
    return sorted(map(repr, rows))


@needs_data
@pytest.mark.parametrize("name", PAIRS)
def test_query_equals_duckdb(spark, name):
    query, sql = PAIRS[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.execute(sql)
    columns = sorted(c[0] for c in expected.description)
    at = [[c[0] for c in expected.description].index(c) for c in columns]
    df = query(spark, SF)
    assert sorted(df.columns) == columns
    assert shown(tuple(r) for r in df.select(*columns).collect()) == shown(tuple(r[i] for i in at) for r in expected.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    text = plan(PAIRS["join_filter"][0](spark, SF))
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert "c_acctbal" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@needs_data
def test_join_order_avoids_products(spark):
    text = plan(dialect("select l_orderkey from lineitem, nation, orders, customer where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey")(spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_join_order_of_cycles():
    size = [10, 1000, 100, 500].__getitem__
    tree = [(0, 1), (1, 3), (3, 2)]
    assert join_order(4, tree, size) == [0, 1, 3, 2]
    assert join_order(4, [(2, 3)], size) == [0, 2, 3, 1]
    assert join_order(4, [(1, 3), (3, 2), (2, 0)], size) == [0, 2, 3, 1]
    assert join_order(2, [(1, 0)], size) == [0, 1]
    assert join_order(4, [*tree, (3, 1)], size) == [0, 1, 3, 2]  # two equalities between the same tables
    assert join_order(4, [*tree, (0, 2)], size) == [1, 3, 2, 0]
    assert join_order(1, [], size) == [0]


@needs_data
def test_filtered_tables_come_before_the_fact_table(spark):
    text = PAIRS["join_four_fact"][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    scans = [c for line in text.splitlines() for c in ("n_name", "c_name", "o_custkey", "l_linenumber") if "Relation" in line and c in line]
    assert scans == ["n_name", "c_name", "o_custkey", "l_linenumber"]  # from the innermost join outwards


@needs_data
def test_cyclic_joins_start_at_the_fact_table(spark):
    df = PAIRS["join_multi_key"][0](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join Inner" in line]
    assert "s_nationkey" in joins[0] and "s_suppkey" in joins[0]  # the outermost join has both of its equalities


@needs_data
def test_a_materialized_relation_is_read_twice(spark):
    text = plan(PAIRS["materialize_reuse"][0](spark, SF))
    assert text.count("InMemoryTableScan") == 2 and text.count("FileScan parquet") <= 2  # the one scan of the cache is shown for each


def test_numbers_by_position_show_a_missing_sort(spark):
    from larkspur.queries import _numbered

    shuffled = Relation(spark.range(1000).repartition(4).withColumnRenamed("id", "k"))
    right = lambda r: all(x.k + 1 == x.rn for x in _numbered(r).collect())
    assert right(shuffled.sort("k"))
    assert not right(Relation(shuffled.df.repartitionByRange(4, "k"))) and not right(shuffled)


@needs_data
def test_hints_pick_the_operator(spark):
    assert "SortMergeJoin" in plan(PAIRS["merge_join_1n"][0](spark, SF))
    assert "BroadcastHashJoin" in plan(PAIRS["index_join"][0](spark, SF))
    assert "CartesianProduct" in plan(PAIRS["product_blocks"][0](spark, SF))


def test_large_index_join_is_not_broadcast(spark, monkeypatch):
    from larkspur.operators import relation

    monkeypatch.setattr(relation, "BROADCAST_BYTES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = (Relation(spark.range(9).withColumnRenamed("id", n)) for n in "ab")
        assert "ShuffledHashJoin" in plan(left.index_join(right, "a", "b").df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


small = st.integers(0, 3)
pairs = st.lists(st.tuples(small, st.sampled_from("xyz")), max_size=8)
operand = st.one_of(st.sampled_from([Field("a"), Field("b"), Field("c"), Field("d")]), small.map(Const), st.sampled_from("xyz").map(Const))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs, pairs, st.lists(st.builds(Term, operand, operand), max_size=3))
def test_random_conjunctions(spark, left, right, terms):
    tables = {"t": spark.createDataFrame(left, "a int, b string"), "u": spark.createDataFrame(right, "c int, d string")}
    found = bind(Select(("a", "b", "c", "d"), ("t", "u"), tuple(terms)), tables.get, lambda _: None).collect()

    def value(x, row):
        return row["abcd".index(x.name)] if isinstance(x, Field) else x.value

    expected = [a + b for a in left for b in right if all(value(t.left, a + b) == value(t.right, a + b) for t in terms)]
    assert sorted(map(tuple, found)) == sorted(expected)
