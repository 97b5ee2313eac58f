"""The registered queries of the relational engine, with the SQL that they must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.aggregates import CountFn, MaxFn
from larkspur.operators.relation import Relation
from larkspur.plans.binder import bind
from larkspur.plans.parser import parse_query
from larkspur.plans.syntax import Const, Field, Term
from larkspur.sources.engine import Engine, database

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QueryFn = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet") if name in TABLES else None


def scan(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    return Relation(read(spark, sf_dir, name))


def dialect(sql: str) -> QueryFn:
    """A SELECT of the dialect: lexer, parser and binder, then Catalyst."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bind(parse_query(sql), lambda name: read(spark, sf_dir, name), lambda name: None)

    return query


def scratch(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """A fresh database with the driver's tables attached, in the shared folder if the session names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{shared.rstrip('/')}/db-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="larkspur-db-")
    return database(spark, folder, {n: f"{sf_dir}/{n}.parquet" for n in names})


def after(statements: list[str], query: str, *names: str) -> QueryFn:
    """Run commands on a scratch database, then a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = scratch(spark, sf_dir, *names)
        with engine.begin() as tx:
            for s in statements:
                tx.execute(s)
        return engine.query(query)

    return run


def _numbered(sorted_rows: Relation) -> DataFrame:
    """Row numbers by position: by partition, and by place inside it as the rows come. Nothing is sorted here, so the numbers
    are right only if the relation is. It is materialized, so that both uses see the same partitions."""
    place = F.monotonically_increasing_id()
    placed = Relation(sorted_rows.df.withColumn("place_", place)).materialize().df
    part, inside = F.shiftright("place_", 33), F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("part_", F.coalesce(F.sum("n").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, part == F.col("part_")).withColumn("rn", (F.col("before") + inside + 1).cast("long")).drop("place_", "part_", "before")


def sort_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(scan(spark, sf_dir, "orders").project("o_orderkey").sort("o_orderkey"))


def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(scan(spark, sf_dir, "orders").project("o_custkey", "o_orderkey").sort("o_custkey", "o_orderkey"))


def sort_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders").where(Term(Const(1), Const(2))).project("o_orderkey").sort("o_orderkey").df


def product_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "nation").optimized_product(scan(spark, sf_dir, "region")).project("n_name", "r_name").df


def product_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "nation").block_product(scan(spark, sf_dir, "region")).project("n_name", "r_name").df


def index_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the engine's own with an index: files are ranges of its field, sorted, with bloom filters."""
    engine = scratch(spark, sf_dir)
    engine.execute("create table item (key int, size int, name varchar(80))")
    engine.execute("create index idx_size on item (size)")
    engine.load("item", read(spark, sf_dir, "part").selectExpr("p_partkey as key", "p_size as size", "p_name as name"))
    return engine.scan("item").index_select("size", 10).project("key", "name").df.withColumnsRenamed({"key": "p_partkey", "name": "p_name"})


def index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders").project("o_orderkey", "o_custkey").index_join(scan(spark, sf_dir, "customer").project("c_custkey", "c_name"), "o_custkey", "c_custkey").project("o_orderkey", "c_name").df


def merge_join_1n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "nation").merge_join(scan(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey").project("n_name", "c_custkey").df


def merge_join_mn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "supplier").merge_join(scan(spark, sf_dir, "customer"), "s_nationkey", "c_nationkey").project("s_suppkey", "c_custkey").df


def group_max_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders").group_by(["o_orderstatus"], [MaxFn("o_custkey"), CountFn("o_custkey")]).df


def group_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "lineitem").group_by(["l_returnflag", "l_linestatus"], [MaxFn("l_orderkey"), CountFn("l_orderkey")]).df


def group_max_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "customer").group_by(["c_mktsegment"], [MaxFn("c_name")]).df


def group_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "lineitem").group_by([], [MaxFn("l_partkey"), CountFn("l_partkey")]).df


def group_global_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "lineitem").where(Term(Const(1), Const(2))).group_by([], [MaxFn("l_partkey"), CountFn("l_partkey")]).df


def group_after_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = scan(spark, sf_dir, "nation").project("n_nationkey", "n_name").join(scan(spark, sf_dir, "customer").project("c_nationkey", "c_custkey"), "n_nationkey", "c_nationkey")
    return joined.group_by(["n_name"], [MaxFn("c_custkey"), CountFn("c_custkey")]).df


def materialize_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One materialized relation is grouped and joined with its groups."""
    building = scan(spark, sf_dir, "customer").where_equal("c_mktsegment", "BUILDING").project("c_name", "c_nationkey", "c_custkey").materialize()
    last = Relation(building.group_by(["c_nationkey"], [MaxFn("c_custkey")]).df.withColumnRenamed("c_nationkey", "nation"))
    return building.join(last, "c_nationkey", "nation").project("c_name", "maxofc_custkey").df


def rollback_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = scratch(spark, sf_dir, "nation")
    tx = engine.begin()
    tx.execute("insert into nation (n_nationkey, n_name, n_regionkey) values (99, 'NOWHERE', 1)")
    tx.execute("delete from nation where n_regionkey = 2")
    tx.execute("create table other (a int)")
    tx.rollback()
    return engine.query("select n_nationkey, n_name, n_regionkey from nation")


def affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = scratch(spark, sf_dir, "orders")
    with engine.begin() as tx:
        counts = [("delete", tx.execute("delete from orders where o_orderstatus = 'P'")), ("update", tx.execute("update orders set o_orderpriority = 'none' where o_orderstatus = 'F'"))]
    return spark.createDataFrame(counts, "command string, n int")


_DDL = ["create table t1 (a int, b varchar(9))", "create index i1 on t1 (a)", "create view v1 as select b from t1 where a = 1"]


def catalog(query: str) -> QueryFn:
    return after(_DDL, query)


def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of the textbook plans over small stored tables."""
    engine = scratch(spark, sf_dir)
    students = [(1, "joe", 10, 2021), (2, "amy", 20, 2020), (3, "max", 10, 2022), (4, "sue", 20, 2022), (5, "bob", 30, 2020), (6, "kim", 20, 2020), (7, "art", 30, 2021), (8, "pat", 20, 2019), (9, "lee", 10, 2021)]
    with engine.begin() as tx:
        tx.execute("create table student (sid int, sname varchar(10), majorid int, gradyear int)")
        tx.execute("create table dept (did int, dname varchar(8))")
        for s in students:
            tx.execute("insert into student (sid, sname, majorid, gradyear) values ({}, '{}', {}, {})".format(*s))
        for d in ((10, "compsci"), (20, "math"), (30, "drama")):
            tx.execute("insert into dept (did, dname) values ({}, '{}')".format(*d))
        tx.execute("create table big (k int, v varchar(9))")
        tx.load("big", spark.range(50_000).selectExpr("cast(id as int) as k", "'v' as v"))
    tx = engine.begin()
    student, dept, big = tx.estimate("student"), tx.estimate("dept"), tx.estimate("big")
    major, year = Term(Field("majorid"), Const(10)), Term(Field("gradyear"), Const(2020))
    product = student.product(dept)
    plans = {
        "student": student,
        "dept": dept,
        "product": product,
        "product_select": product.select((Term(Field("majorid"), Field("did")),)),
        "select": student.select((major,)),
        "select_select": student.select((major,)).select((year,)),
        "project": student.select((major,)).select((year,)).project(["sname"]),
        "big": big,
        "index_select_btree": big.index_select("k"),
        "index_select_hash": big.index_select("k", "hash"),
        "index_join_btree": student.index_join(big, "k"),
        "index_join_hash": student.index_join(big, "k", "hash"),
        "materialize": student.product(dept).materialize(),
        "sort": big.sort(),
        "block_product": student.block_product(big),
        "group_by": big.group_by(["k"]),
        "merge_join": student.merge_join(big, "majorid", "k"),
    }
    return spark.createDataFrame([(n, e.records, e.blocks) for n, e in plans.items()], "plan string, records long, blocks long")


_JOIN2 = "select c_name, n_name from customer, nation where c_nationkey = n_nationkey"

#: name -> (query, DuckDB SQL)
PAIRS: dict[str, tuple[QueryFn, str]] = {
    "scan_project": (dialect("select r_regionkey, r_name from region"), "select r_regionkey, r_name from region"),
    "project_bag": (dialect("select o_orderstatus from orders"), "select o_orderstatus from orders"),
    "select_eq_string": (dialect("select o_orderkey from orders where o_orderstatus = 'F'"), "select o_orderkey from orders where o_orderstatus = 'F'"),
    "select_eq_int": (dialect("select p_partkey, p_name from part where p_size = 10"), "select p_partkey, p_name from part where p_size = 10"),
    "select_const_field": (dialect("select p_partkey, p_name from part where 10 = p_size"), "select p_partkey, p_name from part where 10 = p_size"),
    "select_field_field": (dialect("select l_orderkey, l_linenumber from lineitem where l_orderkey = l_partkey"), "select l_orderkey, l_linenumber from lineitem where l_orderkey = l_partkey"),
    "select_const_const_false": (dialect("select r_name from region where 1 = 2"), "select r_name from region where 1 = 2"),
    "select_const_const_true": (dialect("select r_name from region where 1 = 1"), "select r_name from region where 1 = 1"),
    "select_cross_type": (dialect("select n_name from nation where n_nationkey = '1'"), "select n_name from nation where false"),
    "select_cross_type_fields": (dialect("select n_name from nation where n_nationkey = n_name"), "select n_name from nation where false"),
    "select_conjunction": (dialect("select l_orderkey from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 1"), "select l_orderkey from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 1"),
    "case_insensitive": (dialect("SELECT R_RegionKey, R_NAME From REGION"), "select r_regionkey, r_name from region"),
    "product_two": (dialect("select n_name, r_name from nation, region"), "select n_name, r_name from nation, region"),
    "product_three": (dialect("select r_name, n_name, s_suppkey from region, nation, supplier"), "select r_name, n_name, s_suppkey from region, nation, supplier"),
    "product_empty_left": (dialect("select r_name, n_name from region, nation where 1 = 2"), "select r_name, n_name from region, nation where false"),
    "product_self": (dialect("select r_name from region, region"), "select a.r_name from region a, region b"),
    "product_ordered": (product_ordered, "select n_name, r_name from nation, region"),
    "product_blocks": (product_blocks, "select n_name, r_name from nation, region"),
    "join_two": (dialect(_JOIN2), _JOIN2),
    "join_filter": (dialect(_JOIN2 + " and c_mktsegment = 'BUILDING'"), _JOIN2 + " and c_mktsegment = 'BUILDING'"),
    "join_three": (dialect("select c_name, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey"), "select c_name, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey"),
    "join_four_fact": (dialect("select l_orderkey, l_linenumber, c_name from lineitem, orders, customer, nation where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and n_name = 'NATION_1'"), "select l_orderkey, l_linenumber, c_name from lineitem, orders, customer, nation where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and n_name = 'NATION_1'"),
    "join_multi_key": (dialect("select s_suppkey, l_orderkey, c_custkey from supplier, lineitem, customer, orders where s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and s_nationkey = c_nationkey"), "select s_suppkey, l_orderkey, c_custkey from supplier, lineitem, customer, orders where s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and s_nationkey = c_nationkey"),
    "join_disconnected": (dialect("select n_name, r_name, p_partkey from nation, region, part where n_regionkey = r_regionkey and p_size = 10"), "select n_name, r_name, p_partkey from nation, region, part where n_regionkey = r_regionkey and p_size = 10"),
    "index_select": (index_select, "select p_partkey, p_name from part where p_size = 10"),
    "index_join": (index_join, "select o_orderkey, c_name from orders, customer where o_custkey = c_custkey"),
    "merge_join_1n": (merge_join_1n, "select n_name, c_custkey from nation, customer where n_nationkey = c_nationkey"),
    "merge_join_mn": (merge_join_mn, "select s_suppkey, c_custkey from supplier, customer where s_nationkey = c_nationkey"),
    "sort_single": (sort_single, "select o_orderkey, row_number() over (order by o_orderkey) as rn from orders"),
    "sort_multi": (sort_multi, "select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) as rn from orders"),
    "sort_empty": (sort_empty, "select o_orderkey from orders where false"),
    "group_max_count": (group_max_count, "select o_orderstatus, max(o_custkey) as maxofo_custkey, cast(count(*) as integer) as countofo_custkey from orders group by 1"),
    "group_multi_key": (group_multi_key, "select l_returnflag, l_linestatus, max(l_orderkey) as maxofl_orderkey, cast(count(*) as integer) as countofl_orderkey from lineitem group by 1, 2"),
    "group_max_string": (group_max_string, "select c_mktsegment, max(c_name) as maxofc_name from customer group by 1"),
    "group_global": (group_global, "select max(l_partkey) as maxofl_partkey, cast(count(*) as integer) as countofl_partkey from lineitem"),
    "group_global_empty": (group_global_empty, "select max(l_partkey) as maxofl_partkey, cast(count(*) as integer) as countofl_partkey from lineitem where false"),
    "group_after_join": (group_after_join, "select n_name, max(c_custkey) as maxofc_custkey, cast(count(*) as integer) as countofc_custkey from nation, customer where n_nationkey = c_nationkey group by 1"),
    "materialize_reuse": (materialize_reuse, "select c_name, maxofc_custkey from customer join (select c_nationkey, max(c_custkey) as maxofc_custkey from customer where c_mktsegment = 'BUILDING' group by 1) using (c_nationkey) where c_mktsegment = 'BUILDING'"),
    "view_simple": (after(["create view v as select n_name, n_regionkey from nation"], "select n_name from v", "nation"), "select n_name from nation"),
    "view_predicate": (after(["create view v as select c_custkey, c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'"], "select c_name from v where c_nationkey = 3", "customer"), "select c_name from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3"),
    "view_nested": (after(["create view v as select n_nationkey, n_name, n_regionkey from nation", "create view w as select n_name, n_nationkey from v where n_regionkey = 1"], "select n_name from w where n_nationkey = 1", "nation"), "select n_name from nation where n_regionkey = 1 and n_nationkey = 1"),
    "view_join": (after(["create view v as select c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'"], "select c_name, n_name from v, nation where c_nationkey = n_nationkey", "customer", "nation"), _JOIN2 + " and c_mktsegment = 'BUILDING'"),
    "insert_rows": (after(["insert into nation (n_nationkey, n_name, n_regionkey) values (100, 'ATLANTIS', 1)", "insert into nation (n_name, n_nationkey, n_regionkey) values ('MU', 101, 2)"], "select n_nationkey, n_name, n_regionkey from nation", "nation"), "select * from nation union all values (100, 'ATLANTIS', 1), (101, 'MU', 2)"),
    "insert_defaults": (after(["insert into nation (n_nationkey) values (100)", "insert into nation (n_name) values ('MU')"], "select n_nationkey, n_name, n_regionkey from nation", "nation"), "select * from nation union all values (100, '', 0), (0, 'MU', 0)"),
    "delete_where": (after(["delete from orders where o_orderstatus = 'F'"], "select o_orderkey, o_custkey, o_orderstatus from orders", "orders"), "select o_orderkey, o_custkey, o_orderstatus from orders where not (o_orderstatus = 'F')"),
    "delete_all": (after(["delete from orders"], "select o_orderkey, o_orderstatus from orders", "orders"), "select o_orderkey, o_orderstatus from orders where false"),
    "update_const": (after(["update orders set o_orderpriority = 'none' where o_orderstatus = 'F'"], "select o_orderkey, o_orderpriority from orders", "orders"), "select o_orderkey, case when o_orderstatus = 'F' then 'none' else o_orderpriority end as o_orderpriority from orders"),
    "update_field": (after(["update orders set o_orderpriority = o_orderstatus where o_orderstatus = 'P'"], "select o_orderkey, o_orderpriority from orders", "orders"), "select o_orderkey, case when o_orderstatus = 'P' then o_orderstatus else o_orderpriority end as o_orderpriority from orders"),
    "rollback_noop": (rollback_noop, "select n_nationkey, n_name, n_regionkey from nation"),
    "affected_rows": (affected_rows, "select 'delete' as command, cast(count(*) as integer) as n from orders where o_orderstatus = 'P' union all select 'update', cast(count(*) as integer) from orders where o_orderstatus = 'F'"),
    "catalog_tables": (catalog("select tblname, slotsize from tblcat"), "select * from (values ('tblcat', 28), ('fldcat', 56), ('viewcat', 128), ('idxcat', 64), ('t1', 21)) as x(tblname, slotsize)"),
    "catalog_fields": (catalog("select fldname, type, length, offset from fldcat where tblname = 't1'"), "select * from (values ('a', 4, 0, 4), ('b', 12, 9, 8)) as x(fldname, type, length, \"offset\")"),
    "catalog_views": (catalog("select viewname, viewdef from viewcat"), "select 'v1' as viewname, 'select b from t1 where a = 1' as viewdef"),
    "catalog_indexes": (catalog("select indexname, tablename, fieldname from idxcat"), "select 'i1' as indexname, 't1' as tablename, 'a' as fieldname"),
    "cost_estimates": (cost_estimates, "select * from (values ('student', 9::bigint, 1::bigint), ('dept', 3, 1), ('product', 27, 10), ('product_select', 6, 10), ('select', 2, 1), ('select_select', 0, 1), ('project', 0, 1), ('big', 50000, 2632), ('index_select_btree', 2, 5), ('index_select_hash', 2, 22), ('index_join_btree', 18, 46), ('index_join_hash', 18, 199), ('materialize', 27, 4), ('sort', 50000, 2632), ('block_product', 450000, 2961), ('group_by', 16667, 2632), ('merge_join', 26, 2633)) as x(plan, records, blocks)"),
}
QUERIES: dict[str, QueryFn] = {name: query for name, (query, _) in PAIRS.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in PAIRS.items()}
