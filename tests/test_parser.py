import pytest
from hypothesis import given
from hypothesis import strategies as st

from larkspur.errors import SyntaxProblem
from larkspur.plans.lexer import KEYWORDS, tokens
from larkspur.plans.parser import parse_command, parse_query
from larkspur.plans.syntax import ColumnDef, Const, CreateTable, CreateView, Delete, Field, Insert, Select, Term, Update


@pytest.mark.parametrize("text", ["a=1", " a = 1", "A =1 ", "a\n=\t1", "\x00a=1"])
def test_tokens_ignore_white_space_and_case(text):
    assert [(t.kind, t.value) for t in tokens(text)] == [("name", "a"), ("mark", "="), ("int", 1), ("end", "")]


def test_signed_integers_need_the_sign_in_front():
    assert [t.value for t in tokens("a=-1")][2] == -1
    assert [t.value for t in tokens("- 1")][:2] == ["-", 1]


def test_strings_keep_case_and_have_no_escape():
    assert [t.value for t in tokens("""'It' "it's" """)][:2] == ["It", "it's"]


@pytest.mark.parametrize("text", ["select a from t where a = 'x", "select a from t where a = 99999999999", "select a from t where a = -", "select a from t x", "select from t", "select a", "select a from t where", "select a from t where a", "select a, from t", "select select from t"])
def test_bad_queries(text):
    with pytest.raises(SyntaxProblem):
        parse_query(text)


@pytest.mark.parametrize("text", ["delete t", "insert into t (a) values", "insert into t values (1)", "update t set a", "create table t ()", "create table t (a text)", "create table t (a varchar)", "create view v select a from t", "create index i on t", "create index i on t (a, b)", "drop table t", ""])
def test_bad_commands(text):
    with pytest.raises(SyntaxProblem):
        parse_command(text)


def test_statements():
    assert parse_query("select a, b from t, u where a = 1 and 'x' = b;") == Select(("a", "b"), ("t", "u"), (Term(Field("a"), Const(1)), Term(Const("x"), Field("b"))))
    assert parse_command("insert into t (a, b) values (1, 'x')") == Insert("t", ("a", "b"), (Const(1), Const("x")))
    assert parse_command("delete from t") == Delete("t")
    assert parse_command("update t set a = b where c = 3") == Update("t", "a", Field("b"), (Term(Field("c"), Const(3)),))
    assert parse_command("create table t (a int, b varchar(9))") == CreateTable("t", (ColumnDef("a"), ColumnDef("b", 9)))
    assert parse_command("create view v as select a from t") == CreateView("v", Select(("a",), ("t",)))


names = st.from_regex(r"[a-z_][a-z0-9_]{0,5}", fullmatch=True).filter(lambda n: n not in KEYWORDS)
consts = st.one_of(st.integers(-(2**31), 2**31 - 1), st.text().filter(lambda s: not ("'" in s and '"' in s))).map(Const)
operands = st.one_of(names.map(Field), consts)
terms = st.lists(st.builds(Term, operands, operands), max_size=3).map(tuple)


@given(st.builds(Select, st.lists(names, min_size=1, max_size=3).map(tuple), st.lists(names, min_size=1, max_size=3).map(tuple), terms))
def test_printed_queries_parse_to_themselves(query):
    assert parse_query(str(query)) == query


@given(st.one_of(st.builds(Delete, names, terms), st.builds(Update, names, names, operands, terms)))
def test_printed_commands_parse_to_themselves(command):
    assert parse_command(str(command)) == command
