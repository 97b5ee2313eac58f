from larkspur.plans.cost import MOST, Estimate
from larkspur.plans.syntax import Const, Field, Term

STUDENT = Estimate.table(9, {"sid": None, "sname": 10, "majorid": None, "gradyear": None})
DEPT = Estimate.table(3, {"did": None, "dname": 8})


def sizes(e):
    return e.records, e.blocks


def test_tables_products_and_selections():
    product = STUDENT.product(DEPT)
    assert [sizes(e) for e in (STUDENT, DEPT, product, product.select((Term(Field("majorid"), Field("did")),)))] == [(9, 1), (3, 1), (27, 10), (6, 10)]
    one = STUDENT.select((Term(Field("majorid"), Const(10)),))
    two = one.select((Term(Field("gradyear"), Const(2020)),))
    assert [sizes(e) for e in (one, two, two.project(["sname"]))] == [(2, 1), (0, 1), (0, 1)]
    assert one.values("majorid") == 1
    assert STUDENT.optimized_product(DEPT).blocks == min(product.blocks, DEPT.product(STUDENT).blocks)


def test_statistics():
    table = Estimate.table(50, {"a": None, "b": 9})
    assert (table.blocks, table.records, table.values("a")) == (3, 50, 17)
    assert table.index_select("a").records == 2


def test_contradictions_saturate():
    assert STUDENT.select((Term(Const(1), Const(2)), Term(Field("sid"), Const(3)))).records == 0
    huge = Estimate(1 << 60, 1 << 60, lambda f: 3, {"a": None})
    assert huge.product(huge).records == MOST


def test_other_plans():
    assert DEPT.merge_join(STUDENT, "did", "majorid").records == 27 // 4
    assert STUDENT.group_by(["majorid"]).records == 4
    assert STUDENT.block_product(DEPT).records == 27
    assert STUDENT.index_join(DEPT, "did").records == 9
    assert STUDENT.sort().blocks == STUDENT.materialize().blocks == 1
