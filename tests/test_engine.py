"""The dialect end to end, on small tables."""

import math

import pytest

from corvane import Engine, QueryError

ORDERS = [(i, float(a), s) for i, a, s in [
    (1, 10, "PAID"), (2, 20, "PAID"), (3, 30, "PENDING"), (4, 40, "PAID"), (5, 50, "PAID"),
    (6, 200, "PENDING"), (7, 210, "PENDING"), (8, 220, "PENDING"), (9, 230, "PENDING"), (10, 240, "PENDING"),
    (11, 5, "PAID"), (12, 6, "PAID"), (13, 7, "PAID"),
]]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    from corvane.sources.parquet import write_table

    path = str(tmp_path_factory.mktemp("orders") / "orders")
    frame = spark.createDataFrame(ORDERS, "id bigint, amount double, status string").coalesce(1)
    write_table(frame, path, 5)
    e = Engine(spark).register("orders", path)
    e.register("customers", spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Carol")], "id bigint, name string"))
    e.register("t", spark.createDataFrame(
        [(1, 2, 1.5, True, "a"), (2, None, 0.0, False, "b"), (None, 4, None, None, "c"), (4, 0, -1.0, True, None)],
        "a int, b bigint, d double, f boolean, s string"))
    e.register("empty", spark.createDataFrame([], "a bigint, s string"))
    e.register("odd", spark.sql("select 1 as a, timestamp_ntz'2020-01-01' as ts, array(1.0f) as v"))
    return e


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def test_filter_prunes_chunks(engine):
    sql = "SELECT id FROM orders WHERE amount > 100"
    assert sorted(rows(engine, sql)) == [(6,), (7,), (8,), (9,), (10,)]
    (stats,) = engine.scan_stats(sql)
    assert (stats.total_chunks, stats.pruned_chunks) == (3, 2)
    assert stats.rows_produced == 5


def test_fraction_against_int_keeps_rows(engine):
    assert rows(engine, "SELECT id FROM orders WHERE id < 1.5") == [(1,)]
    assert engine.scan_stats("SELECT id FROM orders WHERE id < 6.5")[0].pruned_chunks == 1


def test_group_order(engine):
    assert rows(engine, "SELECT status, COUNT(*) AS n, SUM(amount) AS total FROM orders GROUP BY status ORDER BY total DESC") == [("PENDING", 6, 1130.0), ("PAID", 7, 138.0)]


def test_filter_sort_limit(engine):
    assert rows(engine, "SELECT id, amount FROM orders WHERE status = 'PAID' ORDER BY amount DESC LIMIT 3") == [(5, 50.0), (4, 40.0), (2, 20.0)]


def test_inner_join(engine):
    assert rows(engine, "SELECT c.name, o.amount FROM orders o JOIN customers c ON o.id = c.id ORDER BY name") == [("Alice", 10.0), ("Bob", 20.0), ("Carol", 30.0)]


def test_left_join(engine):
    got = rows(engine, "SELECT o.id, c.name FROM orders o LEFT JOIN customers c ON o.id = c.id ORDER BY o.id")
    assert len(got) == 13 and got[2] == (3, "Carol") and got[3] == (4, None)


def test_computed_alias_and_default_names(engine):
    frame = engine.sql("SELECT amount * 2 AS doubled, amount * 2, id, amount * 1.5 FROM orders WHERE id = 1")
    assert frame.columns == ["doubled", "(amount * 2)", "id", "(amount * 1.500000)"]
    assert frame.collect()[0][0] == 20.0
    assert engine.sql("SELECT SUM(amount * 2), COUNT(*) FROM orders").columns == ["SUM((amount * 2))", "COUNT(*)"]


def test_projection_reaches_the_scan(engine):
    plan = engine.explain("SELECT id FROM orders WHERE amount > 100", "formatted")
    assert "ReadSchema: struct<id:bigint,amount:double>" in plan
    assert "GreaterThan(amount,100.0)" in plan
    assert "projects=2/3 cols" in engine.explain("SELECT id FROM orders WHERE amount > 100")


def test_explain_tree(engine):
    text = engine.explain("SELECT status, COUNT(*) AS n FROM orders WHERE 100 < amount AND status != 'X' GROUP BY status ORDER BY n DESC LIMIT 2")
    assert text.splitlines() == [
        "Limit(2)",
        "  Sort(n DESC)",
        "    Project(status, n = COUNT(*))",
        "      Aggregate(group_by=[status], aggs=[COUNT(*)])",
        "        Filter(((100 < amount) AND (status != 'X')))",
        "          Scan(orders, pruning=[amount > 100 AND status != 'X'], projects=2/3 cols)",
    ]


def test_estimate(engine):
    assert engine.estimate("SELECT id FROM orders LIMIT 3")[0] == 3
    assert engine.estimate("SELECT id FROM orders")[1] > 0


def test_top_k_plan(engine):
    assert "TakeOrderedAndProject" in engine.explain("SELECT id FROM orders ORDER BY id LIMIT 3", "simple")


def test_duplicate_names_and_star(engine):
    frame = engine.sql("SELECT * FROM customers a JOIN customers b ON a.id = b.id")
    assert frame.columns == ["id", "name", "id", "name"] and frame.count() == 3
    assert engine.sql("SELECT id, id FROM customers").columns == ["id", "id"]


def test_ints_are_wide(engine):
    assert dict(engine.sql("SELECT a, a + 1 AS x, a / 2 AS y FROM t").dtypes) == {"a": "bigint", "x": "bigint", "y": "double"}


def test_strict_nulls(engine):
    assert sorted(rows(engine, "SELECT s FROM t WHERE a = 1 OR b = 4")) == [("a",)]
    got = dict(rows(engine, "SELECT s, a = 1 OR b = 2 AS x FROM t"))
    assert got == {"a": True, "b": None, "c": None, None: False}
    assert dict(rows(engine, "SELECT s, NOT f AS x FROM t")) == {"a": False, "b": True, "c": None, None: False}


def test_strict_nulls_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    values = [(x, y, z) for x, y, z in itertools.product([None, 1, 2, 3], repeat=3)]
    e = Engine(spark).register("v", spark.createDataFrame(values, "x bigint, y bigint, z bigint"))

    def make(depth):
        if depth == 0:
            c, op, k = rng.choice("xyz"), rng.choice(["=", "!=", "<", ">="]), rng.randint(1, 3)
            test = {"=": lambda v: v == k, "!=": lambda v: v != k, "<": lambda v: v < k, ">=": lambda v: v >= k}[op]
            return f"{c} {op} {k}", {c}, lambda r: test(r["xyz".index(c)])
        kind = rng.choice(["AND", "OR", "NOT"])
        a = make(depth - 1)
        if kind == "NOT":
            return f"NOT ({a[0]})", a[1], lambda r: not a[2](r)
        b = make(depth - 1)
        return f"({a[0]}) {kind} ({b[0]})", a[1] | b[1], (lambda r: a[2](r) and b[2](r)) if kind == "AND" else (lambda r: a[2](r) or b[2](r))

    for _ in range(12):
        text, names, f = make(rng.randint(1, 3))
        want = [r for r in values if all(r["xyz".index(n)] is not None for n in names) and f(r)]
        assert sorted(rows(e, f"SELECT x, y, z FROM v WHERE {text}"), key=str) == sorted(want, key=str)


def test_ieee_division(engine):
    got = [r[0] for r in rows(engine, "SELECT d / b AS x FROM t WHERE s != 'c'")]
    assert got[0] == 0.75 and got[1] is None
    assert rows(engine, "SELECT a / b AS x FROM t WHERE a = 4") == [(math.inf,)]
    assert rows(engine, "SELECT -a / 0 AS x, a / 0 AS y FROM t WHERE a = 1") == [(-math.inf, math.inf)]
    assert math.isnan(rows(engine, "SELECT (a - 1) / 0.0 AS x FROM t WHERE a = 1")[0][0])


def test_null_order(engine):
    assert [r[0] for r in rows(engine, "SELECT a FROM t ORDER BY a")] == [None, 1, 2, 4]
    assert [r[0] for r in rows(engine, "SELECT a FROM t ORDER BY a DESC")] == [None, 4, 2, 1]


def test_aggregates_over_nulls_and_nothing(engine):
    assert rows(engine, "SELECT COUNT(*), COUNT(b), SUM(b), AVG(b), MIN(s), MAX(f) FROM t") == [(4, 3, 6, 2.0, "a", True)]
    assert rows(engine, "SELECT COUNT(*), SUM(a), MIN(s) FROM empty") == [(0, None, None)]
    assert rows(engine, "SELECT s, COUNT(*) FROM empty GROUP BY s") == []
    assert rows(engine, "SELECT COUNT(*) AS n FROM t WHERE b < 0 GROUP BY s") == []


def test_group_by_null_and_repeated_key(engine):
    assert sorted(rows(engine, "SELECT f, COUNT(*) FROM t GROUP BY f, f"), key=str) == [(False, 1), (None, 1), (True, 2)]


def test_unsupported_types_pass_through_star_only(engine):
    assert len(engine.sql("SELECT * FROM odd").columns) == 3
    with pytest.raises(QueryError, match="expressions can't use"):
        engine.sql("SELECT ts FROM odd")


def test_dataframe_api(engine):
    assert dict(engine.table("t").dtypes)["a"] == "bigint"


def test_stream(spark, engine, tmp_path):
    from corvane import streaming

    spark.createDataFrame(ORDERS, "id bigint, amount double, status string").write.parquet(str(tmp_path / "in"))
    e = Engine(spark).register("orders", spark.readStream.schema("id bigint, amount double, status string").parquet(str(tmp_path / "in")))
    q = streaming.start(e, "SELECT status, COUNT(*) AS n FROM orders WHERE amount > 6 GROUP BY status", "counts", "complete")
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("counts").collect()) == [("PAID", 5), ("PENDING", 6)]
    with pytest.raises(ValueError):
        streaming.start(engine, "SELECT id FROM orders", "x")


BAD = [
    ("SELECT FROM orders", 8, "expected an expression"),
    ("SELECT nope FROM orders", 8, "column nope is unknown"),
    ("SELECT id FROM nope", 16, "table nope is unknown"),
    ("SELECT o.id FROM orders", 8, "column o.id is unknown"),
    ("SELECT ID FROM orders", 8, "column ID is unknown"),
    ("SELECT id FROM orders o JOIN customers c ON o.id = c.id", 8, "ambiguous"),
    ("SELECT id FROM orders WHERE id", 29, "WHERE needs BOOL"),
    ("SELECT id FROM orders WHERE id = '1'", 32, "= needs"),
    ("SELECT id FROM orders WHERE status > 1", 36, "> needs"),
    ("SELECT id FROM orders WHERE (id = 1) < (id = 2)", 38, "ordered"),
    ("SELECT id FROM orders WHERE NOT id", 29, "NOT needs BOOL"),
    ("SELECT id FROM orders WHERE id = 1 AND status", 36, "AND needs BOOL"),
    ("SELECT -status FROM orders", 8, "needs a number"),
    ("SELECT status + 1 FROM orders", 15, "needs numbers"),
    ("SELECT id FROM orders WHERE 1 < id < 3", 36, "chained"),
    ("SELECT id FROM orders WHERE COUNT(*) > 1", 29, "can't stand here"),
    ("SELECT id FROM orders ORDER BY COUNT(*)", 32, "can't stand here"),
    ("SELECT SUM(COUNT(*)) FROM orders", 12, "nested"),
    ("SELECT SUM(id) + 1 FROM orders", 8, "part of an expression"),
    ("SELECT SUM(status) FROM orders", 8, "SUM needs a number"),
    ("SELECT id, COUNT(*) FROM orders", 8, "must be in GROUP BY"),
    ("SELECT o.id FROM orders o JOIN customers c ON o.id = c.id GROUP BY c.id", 8, "must be in GROUP BY"),
    ("SELECT * FROM orders GROUP BY id", 8, "can't be grouped"),
    ("SELECT id AS k FROM orders WHERE k = 1", 34, "column k is unknown"),
    ("SELECT id AS k FROM orders ORDER BY amount", 37, "column amount is unknown"),
    ("SELECT id AS k, COUNT(*) FROM orders GROUP BY k", 47, "column k is unknown"),
    ("SELECT o.id FROM orders o JOIN customers c ON o.id < c.id", 47, "column = column"),
    ("SELECT o.id FROM orders o JOIN customers c ON o.id = 1", 47, "column = column"),
    ("SELECT o.id FROM orders o JOIN customers c ON o.id = o.amount", 52, "each side"),
    ("SELECT o.id FROM orders o RIGHT JOIN customers c ON o.id = c.id", 27, "RIGHT is not supported"),
    ("SELECT o.id FROM orders CROSS JOIN customers", 25, "CROSS is not supported"),
    ("SELECT DISTINCT id FROM orders", 8, "DISTINCT is not supported"),
    ("SELECT COUNT(DISTINCT id) FROM orders", 14, "DISTINCT is not supported"),
    ("SELECT CASE WHEN id = 1 THEN 2 END FROM orders", 8, "CASE|WHEN"),
    ("SELECT CAST(id AS INT) FROM orders", 8, "no function CAST"),
    ("SELECT upper(status) FROM orders", 8, "no function upper"),
    ("SELECT id FROM orders WHERE id IN (1)", 32, "IN is not supported"),
    ("SELECT id FROM orders WHERE id BETWEEN 1 AND 2", 32, "BETWEEN is not supported"),
    ("SELECT id IS NULL FROM orders", 11, "IS is not supported"),
    ("SELECT NULL FROM orders", 8, "expected an expression"),
    ("SELECT id FROM orders HAVING id = 1", 23, "HAVING is not supported"),
    ("SELECT id FROM orders UNION SELECT id FROM orders", 23, "UNION is not supported"),
    ("SELECT id FROM (SELECT id FROM orders)", 16, "expected a table name"),
    ("SELECT id FROM orders, customers", 22, "unexpected"),
    ("SELECT id FROM orders LIMIT -1", 29, "expected a row count"),
    ("SELECT id FROM orders LIMIT 1 OFFSET 2", 31, "OFFSET is not supported"),
    ("SELECT id FROM orders; SELECT 1", 24, "unexpected"),
    ("SELECT 1e5 FROM orders", 9, "can't be followed"),
    ("SELECT 9223372036854775808 FROM orders", 8, "out of range"),
    ("SELECT 'abc FROM orders", 8, "unterminated"),
    ('SELECT "id" FROM orders', 8, "unexpected character"),
    ("SELECT id % 2 FROM orders", 11, "unexpected character"),
    ("INSERT INTO orders", 1, "expected SELECT"),
    ("SELECT COUNT FROM orders", 14, "expected"),
    ("SELECT " + "(" * 4000 + "id" + ")" * 4000 + " FROM orders", 8, "nested too deeply"),
    ("SELECT id FROM orders WHERE " + "NOT " * 4000 + "TRUE", 29, "nested too deeply"),
    ("SELECT " + "- " * 4000 + "id FROM orders", 8, "nested too deeply"),
    ("SELECT id FROM orders LIMIT 9223372036854775808", 29, "out of range"),
    ("SELECT *, id FROM orders", 9, "expected FROM"),
]


@pytest.mark.parametrize(("sql", "column", "message"), BAD)
def test_errors_have_positions(engine, sql, column, message):
    with pytest.raises(QueryError, match=message) as e:
        engine.sql(sql)
    assert (e.value.line, e.value.column) == (1, column)
    assert str(e.value).startswith(f"1:{column}: ")


def test_error_line(engine):
    with pytest.raises(QueryError) as e:
        engine.sql("SELECT id -- all\nFROM orders\n  WHERE nope = 1")
    assert (e.value.line, e.value.column) == (3, 9)


def test_overflow_is_an_error(engine):
    with pytest.raises(Exception, match="OVERFLOW"):
        engine.sql("SELECT id + 9223372036854775807 AS x FROM orders").collect()


def test_double_registration_keeps_the_first(engine, spark):
    engine.register("customers", spark.range(1))
    assert engine.sql("SELECT name FROM customers").count() == 3


def test_deep_and_long_expressions(engine):
    assert rows(engine, "SELECT " + "(" * 100 + "id" + ")" * 100 + " AS x FROM orders WHERE id = 3") == [(3,)]
    assert rows(engine, "SELECT " + " + ".join(["id"] * 150) + " AS x FROM orders WHERE id = 3") == [(450,)]
    with pytest.raises(QueryError, match="nested too deeply") as e:
        engine.sql("SELECT " + " + ".join(["id"] * 5000) + " AS x FROM orders")
    assert (e.value.line, e.value.column) == (1, 8)


def test_limits_beyond_a_signed_word(engine, monkeypatch):
    from corvane.operators import relational

    sql = "SELECT id FROM orders ORDER BY id LIMIT 3000000000"
    assert rows(engine, sql) == [(i,) for i in range(1, 14)]
    assert rows(engine, "SELECT id FROM orders LIMIT 9223372036854775807") == rows(engine, "SELECT id FROM orders")
    monkeypatch.setattr(relational, "LARGEST_LIMIT", 3)
    assert rows(engine, "SELECT id FROM orders ORDER BY id LIMIT 8") == [(i,) for i in range(1, 9)]
