"""The driver's queries over the fixtures: text in the dialect, and the same in DuckDB's SQL.

DuckDB's text differs where the dialects do: integer columns are widened, sums of integers are cast back from 128 bits,
decimals are doubles, nulls come first both ways, and AND / OR are null for a null operand.
"""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import QueryError
from .server.service import answer
from .sources import chunk_file, datagen, wire
from .sources.parquet import write_table
from .sources.zone_maps import ZoneMap

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (dialect, DuckDB or None for the same text)
QUERIES: dict[str, tuple[str, str | None]] = {
    # scans and projections
    "scan_project": ("SELECT o_orderkey, o_totalprice FROM orders", None),
    "select_star": ("SELECT * FROM customer", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "select_star_filter": ("SELECT * FROM region WHERE r_name != 'ASIA'", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region WHERE r_name != 'ASIA'"),
    "alias_without_as": ("SELECT o_orderkey k, o_custkey AS c FROM orders", None),
    "default_name": ("SELECT l_orderkey, (l_quantity * 2) FROM lineitem", 'SELECT l_orderkey, l_quantity * 2 AS "(l_quantity * 2)" FROM lineitem'),
    "literals": ("SELECT n_name, 7 AS i, 1.5 AS d, 'it''s' AS s, TRUE AS t FROM nation", "SELECT n_name, 7::BIGINT AS i, 1.5::DOUBLE AS d, 'it''s' AS s, TRUE AS t FROM nation"),
    # predicates
    "filter_eq": ("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'", None),
    "filter_ne": ("SELECT o_orderkey FROM orders WHERE o_orderpriority != '5-LOW'", None),
    "filter_ne_angle": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", None),
    "filter_lt": ("SELECT o_orderkey FROM orders WHERE o_totalprice < 50000", None),
    "filter_le": ("SELECT o_orderkey FROM orders WHERE o_orderkey <= 1000", None),
    "filter_gt": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000.5", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000.5::DOUBLE"),
    "filter_ge": ("SELECT o_orderkey FROM orders WHERE o_orderpriority >= '3-MEDIUM'", None),
    "filter_flipped": ("SELECT o_orderkey FROM orders WHERE 50000 < o_totalprice", None),
    "filter_and": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O'", None),
    "filter_or": ("SELECT o_orderkey FROM orders WHERE o_totalprice < 20000 OR o_orderpriority = '2-HIGH'", None),
    "filter_not": ("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice >= 100000)", None),
    "filter_fraction_int": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 2.5", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_linenumber < 2.5::DOUBLE"),
    "filter_bool": ("SELECT n_name FROM nation WHERE (n_regionkey = 1) = TRUE", None),
    # expressions
    "arith_add": ("SELECT l_orderkey, l_linenumber + 1 AS x FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) + 1 AS x FROM lineitem"),
    "arith_sub": ("SELECT l_orderkey, l_quantity - l_linenumber AS x FROM lineitem", None),
    "arith_mul": ("SELECT l_orderkey, l_quantity * 2 AS x, l_linenumber * l_orderkey AS y FROM lineitem", None),
    "arith_precedence": ("SELECT l_orderkey, 1 + l_linenumber * 2 - -3 AS x FROM lineitem", "SELECT l_orderkey, 1 + CAST(l_linenumber AS BIGINT) * 2 - -3 AS x FROM lineitem"),
    "negate": ("SELECT l_orderkey, -l_tax AS x, +l_linenumber AS y FROM lineitem", "SELECT l_orderkey, -l_tax AS x, CAST(l_linenumber AS BIGINT) AS y FROM lineitem"),
    "div_int": ("SELECT l_orderkey, l_orderkey / l_linenumber AS x FROM lineitem", "SELECT l_orderkey, l_orderkey::DOUBLE / l_linenumber AS x FROM lineitem"),
    "div_zero": ("SELECT l_orderkey, l_linenumber, l_quantity / l_tax AS x FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity / l_tax AS x FROM lineitem"),
    "bool_projection": ("SELECT o_orderkey, o_totalprice > 50000 AS big FROM orders", None),
    "bool_logic_projection": ("SELECT o_orderkey, o_totalprice > 50000 AND NOT o_orderstatus = 'F' AS big FROM orders", None),
    "computed_alias": ("SELECT l_extendedprice * (1 - l_discount) AS net FROM lineitem", None),
    # aggregates
    "count_star_filter": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'P'", None),
    "group_sum_count": ("SELECT o_orderpriority, SUM(o_custkey) AS total, COUNT(*) AS n FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(SUM(o_custkey) AS BIGINT) AS total, COUNT(*) AS n FROM orders GROUP BY o_orderpriority"),
    "point_lookup": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42", None),
    "min_max_filter": ("SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders WHERE o_orderpriority = '2-HIGH'", None),
    "min_max_text": ("SELECT c_mktsegment, MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer GROUP BY c_mktsegment", None),
    "min_max_bool": ("SELECT MIN(o_totalprice > 50000) AS lo, MAX(o_totalprice > 50000) AS hi FROM orders", None),
    "sum_int": ("SELECT SUM(l_linenumber) AS s, COUNT(l_linenumber) AS n FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, COUNT(l_linenumber) AS n FROM lineitem"),
    "avg_int": ("SELECT l_returnflag, AVG(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag", None),
    "group_expr": ("SELECT l_linenumber * 2 AS k, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber * 2", "SELECT CAST(l_linenumber AS BIGINT) * 2 AS k, COUNT(*) AS n FROM lineitem GROUP BY 1"),
    "group_key_not_selected": ("SELECT COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_reordered": ("SELECT COUNT(*) AS n, l_linestatus, MAX(l_quantity) AS m, l_returnflag FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_only_keys": ("SELECT l_returnflag FROM lineitem GROUP BY l_returnflag", None),
    "count_col_nulls": ("SELECT COUNT(*) AS n, COUNT(l.quality) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None),
    "group_null_key": ("SELECT l.quality, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality", "SELECT CAST(l.quality AS BIGINT) AS quality, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "agg_nulls": ("SELECT d.lang, SUM(l.quality) AS s, AVG(l.quality) AS a, MIN(l.toxic) AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang", "SELECT d.lang, CAST(SUM(l.quality) AS BIGINT) AS s, AVG(l.quality) AS a, CAST(MIN(l.toxic) AS BIGINT) AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "empty_group": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY o_orderstatus", None),
    "empty_global": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MIN(o_orderstatus) AS m FROM orders WHERE o_totalprice < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_orderstatus) AS m FROM orders WHERE o_totalprice < 0"),
    "empty_filter": ("SELECT o_orderkey FROM orders WHERE o_totalprice < 0", None),
    # joins
    "inner_join": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "inner_join_flipped": ("SELECT n_name, r_name FROM nation INNER JOIN region ON r_regionkey = n_regionkey", None),
    "left_join": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "multi_join": ("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "self_join": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None),
    "join_int_double": ("SELECT l_orderkey, n_name FROM lineitem JOIN nation ON l_quantity = n_nationkey", None),
    "join_null_keys": ("SELECT d.doc_id, n.n_name FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id JOIN nation n ON l.quality = n.n_nationkey", None),
    "join_group_count": ("SELECT c.c_mktsegment, COUNT(*) AS n, MAX(o.o_totalprice) AS m FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment", None),
    "left_join_filter": ("SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = 3 GROUP BY c.c_custkey", None),
    # nulls
    "strict_or_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 OR d.n_chars > 100", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE (l.quality = 1 OR d.n_chars > 100) AND l.quality IS NOT NULL AND d.n_chars IS NOT NULL"),
    "strict_or_projection": ("SELECT d.doc_id, l.quality = 1 OR d.n_chars > 100 AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, CASE WHEN l.quality IS NULL OR d.n_chars IS NULL THEN NULL ELSE l.quality = 1 OR d.n_chars > 100 END AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "not_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT l.quality = 1", None),
    # order and limit
    "sort_asc": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey", None),
    "sort_desc": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC", None),
    "sort_limit": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "sort_multi_limit": ("SELECT c_mktsegment, c_nationkey, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_nationkey, c_custkey DESC LIMIT 25", "SELECT c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_nationkey, c_custkey DESC LIMIT 25"),
    "sort_nulls_limit": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality DESC, doc_id LIMIT 700", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality DESC NULLS FIRST, d.doc_id LIMIT 700"),
    "sort_nulls_asc_limit": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality, doc_id LIMIT 700", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality NULLS FIRST, d.doc_id LIMIT 700"),
    "order_alias_expr": ("SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY -p, k LIMIT 5", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY -o_totalprice, o_orderkey LIMIT 5"),
    "order_constant": ("SELECT n_name FROM nation ORDER BY 1", "SELECT n_name FROM nation"),
    "group_order_limit": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20", None),
    "limit_0": ("SELECT o_orderkey FROM orders LIMIT 0", None),
    "comments_and_semicolon": ("SELECT n_name -- the name\nFROM nation\nWHERE n_nationkey > 20;", "SELECT n_name FROM nation WHERE n_nationkey > 20"),
}

#: Sums and means of doubles depend on the order of addition; both sides are rounded outside the engine.
ROUNDED: dict[str, tuple[str, dict[str, int], str]] = {
    "avg_filter": ("SELECT AVG(o_totalprice) AS a FROM orders WHERE o_totalprice > 50000", {"a": 4}, "SELECT ROUND(AVG(o_totalprice), 4) AS a FROM orders WHERE o_totalprice > 50000"),
    "group_avg": ("SELECT l_returnflag, AVG(l_quantity) AS a FROM lineitem GROUP BY l_returnflag", {"a": 6}, "SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag"),
    "group_two_keys": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_extendedprice) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", {"s": 2}, "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "join_group": ("SELECT c.c_mktsegment, SUM(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment ORDER BY total DESC", {"total": 2}, "SELECT c.c_mktsegment, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"),
    "sum_expr": ("SELECT l_returnflag, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_returnflag", {"revenue": 2}, "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag"),
}

FLAGSHIP = ROUNDED["join_group"][0]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    out = Engine(spark)
    for t in TABLES:
        out.register(t, f"{sf_dir}/{t}.parquet")
    return out


class _Lazy(Engine):
    """Registers a table when a query names it, so that a query opens only its own files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        get, add = self.catalog.get, self.catalog.add
        self.catalog.get = lambda name: get(name) or (add(name, f"{sf_dir}/{name}.parquet") if name in TABLES else None)


def _query(text: str, digits: dict[str, int] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _Lazy(spark, sf_dir).sql(text)
        return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns]) if digits else out

    return run


# ---- what is not a query's result: files, statistics, frames, messages ---------------------------------------------
def _folder(spark: SparkSession) -> str:
    """A new folder that all of the session's machines see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or tempfile.gettempdir()).removeprefix('file://')}/corvane-{uuid.uuid4().hex}"


def _chunk_files(encoding: str) -> Callable[[SparkSession, str], DataFrame]:
    """All orders through chunk files and back, under a filter that the reader sees."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chunk_file.register(spark)
        folder = _folder(spark)
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority", (F.col("o_totalprice") > 100000).alias("large"))
        orders.write.format("corvane_chunks").mode("append").option("encoding", encoding).save(folder)
        back = spark.read.format("corvane_chunks").option("columns", "o_orderkey,o_totalprice,o_orderpriority,large").load(folder)
        return Engine(spark).register("stored", back).sql("SELECT o_orderkey, o_totalprice, o_orderpriority, large FROM stored WHERE o_totalprice > 1000")

    return run


def _scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of orders in order of key, 2,048 rows each: how many a filter on the key skips."""
    folder = _folder(spark)
    write_table(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").coalesce(1).sortWithinPartitions("o_orderkey"), f"file://{folder}")
    stats = Engine(spark).register("stored", f"file://{folder}").scan_stats("SELECT o_orderkey FROM stored WHERE o_orderkey < 2048")
    return spark.createDataFrame([(s.total_chunks, s.pruned_chunks, s.rows_produced) for s in stats], "total_chunks long, pruned_chunks long, rows_produced long")


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as a frame, read back."""
    e = _Lazy(spark, sf_dir)
    kind, payload = wire.read_frame(io.BytesIO(answer(e, "SELECT n_name, n_nationkey, n_nationkey / 2 AS half, n_nationkey > 10 AS later FROM nation ORDER BY n_name")).read)
    result = wire.decode_result(payload)
    return spark.createDataFrame([(*r, kind) for r in result.rows], "n_name string, n_nationkey long, half double, later boolean, frame int")


def _error_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, payload = wire.read_frame(io.BytesIO(answer(_Lazy(spark, sf_dir), "SELECT nope FROM nation")).read)
    return spark.createDataFrame([(kind, payload.decode())], "frame int, message string")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).register("orders", datagen.orders(spark, 5000, 50)).register("customers", datagen.customers(spark, 50))
    return e.sql("SELECT COUNT(*) AS n, MIN(o.order_id) AS least, MAX(o.order_id) AS most, MIN(o.quantity) AS few, MAX(o.quantity) AS many FROM orders o JOIN customers c ON o.customer_id = c.id")


def _generated_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).register("orders", datagen.orders(spark, 5000, 50)).sql("SELECT status, region FROM orders GROUP BY status, region")


def _in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _Lazy(spark, sf_dir).register("wanted", spark.createDataFrame([(1, "one"), (7, "seven"), (99, "none"), (None, "null")], "id int, label string"))
    return e.sql("SELECT n.n_name, w.label FROM nation n JOIN wanted w ON n.n_nationkey = w.id")


def _estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a result before it is run: a table's size in bytes is more than nothing and shrinks with columns."""
    e = _Lazy(spark, sf_dir)
    whole, part = (e.estimate(sql)[1] for sql in ("SELECT * FROM orders", "SELECT o_orderkey FROM orders"))
    return spark.createDataFrame([(whole > 0, 0 < part < whole)], "known boolean, smaller boolean")


EXPLAINED = "SELECT c.c_mktsegment, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000 GROUP BY c.c_mktsegment ORDER BY n DESC LIMIT 3"


EXPLAIN_LINES = [
    "Limit(3)",
    "  Sort(n DESC)",
    "    Project(c_mktsegment, n = COUNT(*))",
    "      Aggregate(group_by=[c_mktsegment], aggs=[COUNT(*)])",
    "        Filter((o_totalprice > 1000))",
    "          Join(INNER, on=(o_custkey = c_custkey))",
    "            Scan(orders, pruning=[o_totalprice > 1000], projects=2/6 cols)",
    "            Scan(customer, projects=2/5 cols)",
]


def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _Lazy(spark, sf_dir).explain(EXPLAINED).rstrip().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


#: Texts that are refused, with where and why.
REFUSED: list[tuple[str, int, int, str]] = [
    ("SELECT (n_nationkey = 1) < (n_nationkey = 2) FROM nation", 1, 26, "< needs an ordered type, found BOOL and BOOL"),
    ("SELECT n_name, COUNT(*) FROM nation", 1, 8, "n_name must be in GROUP BY or in an aggregate"),
    ("SELECT SUM(COUNT(*)) FROM nation", 1, 12, "aggregates can't be nested"),
    ("SELECT n.n_name FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey", 1, 48, "ON needs column = column"),
    ("SELECT nope\nFROM nation", 1, 8, "column nope is unknown"),
    ("SELECT n_name\nFROM nope", 2, 6, "table nope is unknown"),
    ("SELECT n_name FROM nation LIMIT 9223372036854775808", 1, 33, "integer 9223372036854775808 is out of range"),
]


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for sql, *_ in REFUSED:
        try:
            _Lazy(spark, sf_dir).sql(sql)
        except QueryError as e:
            out.append((sql, e.line, e.column, e.message))
    return spark.createDataFrame(out, "sql string, line int, col int, message string")


ZONES = [(10, 40, 10, True), (10, 40, 40, True), (10, 40, 9, False), (10, 40, 41, False), (None, None, 5, True)]


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a, b, v, ZoneMap(a, b, 0, 1).can_contain(v)) for a, b, v, _ in ZONES], "least int, most int, value int, found boolean")


def _values(rows: list[tuple], names: str) -> str:
    def literal(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({names})"


_STORED = "SELECT o_orderkey, o_totalprice, o_orderpriority, o_totalprice > 100000 AS large FROM orders WHERE o_totalprice > 1000"
#: name: (query, DuckDB)
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    **{f"chunk_file_{e}": (_chunk_files(e), _STORED) for e in ("plain", "dictionary", "runs")},
    "scan_stats": (_scan_stats, """WITH c AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 2048 AS k, o_orderkey FROM orders),
        z AS (SELECT k, min(o_orderkey) AS lo FROM c GROUP BY k)
        SELECT count(*) AS total_chunks, count(*) FILTER (lo >= 2048) AS pruned_chunks, (SELECT count(*) FROM orders WHERE o_orderkey < 2048) AS rows_produced FROM z"""),
    "wire_result": (_wire, "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_nationkey / 2 AS half, n_nationkey > 10 AS later, 2 AS frame FROM nation"),
    "wire_error": (_error_frame, "SELECT 3 AS frame, '1:8: column nope is unknown' AS message"),
    "generated_orders": (_generated, "SELECT 5000::BIGINT AS n, 0::BIGINT AS least, 4999::BIGINT AS most, 1::BIGINT AS few, 20::BIGINT AS many"),
    "generated_domains": (_generated_domains, "SELECT status, region FROM (VALUES " + ", ".join(f"('{x}')" for x in datagen.STATUSES) + ") AS s(status), (VALUES " + ", ".join(f"('{x}')" for x in datagen.REGIONS) + ") AS r(region)"),
    "in_memory_table": (_in_memory, "SELECT n_name, label FROM nation JOIN (VALUES (1, 'one'), (7, 'seven'), (99, 'none')) AS w(id, label) ON n_nationkey = id"),
    "estimate": (_estimate, "SELECT TRUE AS known, TRUE AS smaller"),
    "explain": (_explain, _values(list(enumerate(EXPLAIN_LINES)), "line, text")),
    "refused": (_refused, _values(REFUSED, "sql, line, col, message")),
    "zone_map": (_zones, _values(ZONES, "least, most, value, found")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(t) for k, (t, _) in QUERIES.items()} | {k: _query(t, d) for k, (t, d, _) in ROUNDED.items()} | {k: f for k, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: o or t for k, (t, o) in QUERIES.items()} | {k: o for k, (_, _, o) in ROUNDED.items()} | {k: o for k, (_, o) in OTHERS.items()}
