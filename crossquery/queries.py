"""One registered query for each operator of the engine, with DuckDB SQL for the same rows.

Queries are plans over a Parquet source ``t`` (the folder of tables). Sums of money are rounded at the
scale at which they are exact, so that the order of additions cannot show.
"""

from __future__ import annotations

import functools
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import SourceError
from .plans.builder import PlanBuilder, Relation, agg, asc, case, col, desc, fn, lit, within
from .session import Session
from .sources.reduction import Strategy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *sources: Callable[[Session, str], None], strategy: Strategy | None = None):
    """Registers a function that builds a plan, under its name; ``sources`` register more than the folder."""

    def register(build: Callable[[PlanBuilder], Relation]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # nothing is held: the result is lazy, and a session that is never closed would leak what it persists
            session = Session(spark, persist_shared=False)
            session.register("t", "parquet", dir=sf_dir)
            for second in sources:
                second(session, sf_dir)
            return session.run(build(PlanBuilder()).returned(), strategy)

        QUERIES[build.__name__], ORACLE_SQL[build.__name__] = run, sql
        return build

    return register


LINE = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


# ---- scans


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_columns(b):
    return b.scan("t", "orders", ["o_orderkey", "o_totalprice"])


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_filter(b):
    return b.scan("t", "lineitem", ["l_orderkey", "l_quantity"], (col("l_quantity") > 45) & (col("l_returnflag") == "R"), alias="l")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def scan_distinct(b):
    return b.scan("t", "lineitem", ["l_returnflag", "l_linestatus"], distinct=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def scan_limit_ordered(b):
    return b.scan("t", "orders", ["o_orderkey", "o_totalprice"]).sort(desc("o_totalprice"), asc("o_orderkey")).limit(25)


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 10)")
def scan_limit(b):
    return b.scan("t", "orders", ["o_orderkey"], limit=10).aggregate({"n": agg("count")})


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def scan_raw_sql(b):
    return b.scan_sql("t", "SELECT c_mktsegment, count(*) AS n FROM main.customer GROUP BY c_mktsegment")


# ---- predicates and expressions


@query("SELECT o_orderkey, o_totalprice > 150000 AS gt, o_totalprice >= 150000 AS ge, o_orderkey < 100 AS lt, o_orderkey <= 100 AS le, o_orderkey = 7 AS eq, o_orderkey <> 7 AS ne FROM orders")
def pred_compare(b):
    price, key = col("o_totalprice"), col("o_orderkey")
    return b.scan("t", "orders", ORDER).select({"o_orderkey": key, "gt": price > 150000, "ge": price >= 150000, "lt": key < 100, "le": key <= 100, "eq": key == 7, "ne": key != 7})


@query("SELECT o_orderkey FROM orders WHERE (nullif(o_orderstatus, 'F') = 'O' OR o_totalprice > 200000) AND NOT (nullif(o_orderstatus, 'P') = 'O' AND o_totalprice < 100000)")
def pred_bool3(b):
    status = col("o_orderstatus")
    yes = (fn("nullif", status, "F") == "O") | (col("o_totalprice") > 200000)
    return b.scan("t", "orders", ORDER).where(yes & ~((fn("nullif", status, "P") == "O") & (col("o_totalprice") < 100000))).select(["o_orderkey"])


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AS a, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS b FROM orders")
def pred_distinct_from(b):
    s = fn("nullif", col("o_orderstatus"), "F")
    return b.scan("t", "orders", ORDER).select({"o_orderkey": col("o_orderkey"), "a": s.is_distinct_from("O"), "b": s.is_not_distinct_from(None)})


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND NOT p_name LIKE 'x%'")
def pred_like(b):
    return b.scan("t", "part", ["p_partkey", "p_type", "p_name"]).where(col("p_type").like("%A%") & ~col("p_name").like("x%")).select(["p_partkey", "p_type"])


@query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b_il%'")
def pred_ilike(b):
    return b.scan("t", "customer", ["c_custkey", "c_mktsegment"]).where(col("c_mktsegment").ilike("b_il%")).select(["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5)")
def pred_in(b):
    return b.scan("t", "customer", ["c_custkey"], col("c_nationkey").isin(1, 3, 5))


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') NOT IN ('F')")
def pred_not_in_list(b):
    return b.scan("t", "orders", ORDER).where(fn("nullif", col("o_orderstatus"), "P").isin("F", negated=True)).select(["o_orderkey"])


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') IS NULL AS a, nullif(o_orderstatus, 'P') IS NOT NULL AS b FROM orders")
def pred_is_null(b):
    s = fn("nullif", col("o_orderstatus"), "P")
    return b.scan("t", "orders", ORDER).select({"o_orderkey": col("o_orderkey"), "a": s.is_null(), "b": s.is_not_null()})


@query("SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 2 AS s, o_orderkey * 3 AS m, o_orderkey // 4 AS d, o_orderkey % 5 AS r, -o_orderkey AS neg, o_totalprice / 2 AS h FROM orders")
def arith_ops(b):
    k = col("o_orderkey")
    return b.scan("t", "orders", ORDER).select({"o_orderkey": k, "a": k + 1, "s": k - 2, "m": k * 3, "d": k / 4, "r": k % 5, "neg": -k, "h": col("o_totalprice") / 2.0})


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CASE WHEN o_totalprice > 300000 THEN 'x' END AS flag FROM orders")
def case_searched(b):
    p = col("o_totalprice")
    return b.scan("t", "orders", ORDER).select({"o_orderkey": col("o_orderkey"), "size": case((p > 300000, "big"), (p > 100000, "mid"), otherwise="small"), "flag": case((p > 300000, "x"))})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s FROM orders")
def case_simple(b):
    return b.scan("t", "orders", ORDER).select({"o_orderkey": col("o_orderkey"), "s": case(("F", "done"), ("O", "open"), operand=col("o_orderstatus"), otherwise="part")})


@query(
    "SELECT o_orderkey, cast(o_orderkey % 100 AS SMALLINT) AS i16, cast(o_orderkey AS INTEGER) AS i32, cast(o_custkey AS BIGINT) AS i64, cast(o_orderkey AS DOUBLE) AS f64, "
    "cast(o_orderkey AS VARCHAR) AS s, cast(o_orderkey % 2 AS BOOLEAN) AS b, cast(cast('1995-03-15' AS DATE) AS VARCHAR) AS d FROM orders"
)
def cast_all(b):
    k = col("o_orderkey")
    return b.scan("t", "orders", ORDER).select(
        {"o_orderkey": k, "i16": (k % 100).cast("int16"), "i32": k.cast("int32"), "i64": col("o_custkey").cast("int64"), "f64": k.cast("float64"), "s": k.cast("utf8"), "b": (k % 2).cast("bool"), "d": lit("1995-03-15").cast("date32").cast("utf8")}
    )


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def project_distinct(b):
    return b.scan("t", "orders", ORDER).select(["o_orderstatus", "o_orderpriority"], distinct=True)


# ---- joins


def _customers(b, where=None):
    return b.scan("t", "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"], where)


def _nations(b, where=None):
    return b.scan("t", "nation", ["n_nationkey", "n_name", "n_regionkey"], where)


_JOINED = {"c_custkey": col("c_custkey", "in_left"), "n_name": col("n_name", "in_right")}


def _nation_join(b, how):
    return _customers(b, col("c_acctbal") > 5000.0).join(_nations(b, col("n_regionkey") < 3), ["c_nationkey"], ["n_nationkey"], _JOINED, how)


_SIDES = "(SELECT * FROM customer WHERE c_acctbal > 5000) AS l {} JOIN (SELECT * FROM nation WHERE n_regionkey < 3) AS r ON l.c_nationkey = r.n_nationkey"


@query(f"SELECT c_custkey, n_name FROM {_SIDES.format('')}")
def join_inner(b):
    return _nation_join(b, "inner")


@query(f"SELECT c_custkey, n_name FROM {_SIDES.format('LEFT')}")
def join_left(b):
    return _nation_join(b, "left")


@query(f"SELECT c_custkey, n_name FROM {_SIDES.format('RIGHT')}")
def join_right(b):
    return _nation_join(b, "right")


@query(f"SELECT c_custkey, n_name FROM {_SIDES.format('FULL')}")
def join_full(b):
    return _nation_join(b, "full")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def join_semi(b):
    return _customers(b, col("c_acctbal") > 5000.0).join(b.scan("t", "orders", ["o_custkey"], col("o_totalprice") > 250000.0), ["c_custkey"], ["o_custkey"], ["c_custkey"], "semi")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_anti(b):
    return _customers(b).join(b.scan("t", "orders", ["o_custkey"], col("o_totalprice") > 100000.0), ["c_custkey"], ["o_custkey"], ["c_custkey"], "anti")


@query("SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40 AND b.l_quantity < 10")
def join_multikey(b):
    left = b.scan("t", "lineitem", ["l_orderkey", "l_linenumber"], col("l_quantity") > 40.0)
    right = b.scan("t", "lineitem", ["l_orderkey", "l_linenumber"], col("l_quantity") < 10.0)
    return left.join(right, ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"], {"k": col("l_orderkey", "in_left")}).aggregate({"n": agg("count")})


_BY_BALANCE = (col("c_acctbal", "in_left") < col("s_acctbal", "in_right")) & (col("c_nationkey", "in_left") > col("s_nationkey", "in_right"))


def _theta(b, how):
    suppliers = b.scan("t", "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"], col("s_acctbal") > 9000.0)
    return _customers(b, col("c_acctbal") > 9000.0).join_on(suppliers, _BY_BALANCE, {"c": col("c_custkey"), "s": col("s_suppkey").cast("float64")}, how)


_THETA = "SELECT c_custkey AS c, cast(s_suppkey AS DOUBLE) AS s FROM (SELECT * FROM customer WHERE c_acctbal > 9000) {} JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON c_acctbal < s_acctbal AND c_nationkey > s_nationkey"


@query(_THETA.format(""))
def join_theta(b):
    return _theta(b, "inner")


@query(_THETA.format("LEFT"))
def join_theta_left(b):
    return _theta(b, "left")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(b):
    return b.scan("t", "region", ["r_name"]).join_on(b.scan("t", "nation", ["n_name"]), None, ["r_name", "n_name"])


@query("SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 1) AS a FROM nation) l JOIN (SELECT nullif(r_regionkey, 1) AS b FROM region) r ON l.a IS NOT DISTINCT FROM r.b")
def join_nullsafe(b):
    left = b.scan("t", "nation", ["n_regionkey"]).select({"a": fn("nullif", col("n_regionkey"), 1)})
    right = b.scan("t", "region", ["r_regionkey"]).select({"b": fn("nullif", col("r_regionkey"), 1)})
    return left.join_on(right, col("a", "in_left").is_not_distinct_from(col("b", "in_right")), ["a"]).aggregate({"n": agg("count")})


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def join_not_in(b):
    orders = b.scan("t", "orders", ["o_custkey"], col("o_totalprice") > 100000.0)
    return b.sql("SELECT c_custkey FROM in_left WHERE c_custkey NOT IN (SELECT o_custkey FROM in_right)", in_left=_customers(b), in_right=orders)


# ---- reduction of a probe by the keys of a side already read


def _revenue(b, build_filter, extra=None):
    build = b.scan("t", "orders", ["o_orderkey", "o_orderpriority"], build_filter)
    probe = b.scan_reduced("t", "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"], "l_orderkey", build.keys("o_orderkey"), extra=extra)
    return build.join(probe, ["o_orderkey"], ["l_orderkey"], {"p": col("o_orderpriority"), "amount": col("l_extendedprice") * (lit(1.0) - col("l_discount"))})


_REVENUE = "SELECT o_orderpriority AS p, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {} GROUP BY o_orderpriority"
_MEASURES = {"p": "p", "revenue": agg("sum", col("amount")), "n": agg("count")}


def _measured(relation):
    return relation.aggregate(_MEASURES, ["p"]).select({"p": col("p"), "revenue": fn("round", col("revenue"), 4), "n": col("n")})


@query(_REVENUE.format("o_totalprice > 300000"))
def reduce_large_keys(b):
    return _measured(_revenue(b, col("o_totalprice") > 300000.0))


@query(_REVENUE.format("o_orderkey < 300"))
def reduce_in_list(b):
    return _measured(_revenue(b, col("o_orderkey") < 300))


@query(_REVENUE.format("o_orderkey < 0"))
def reduce_empty_keys(b):
    return _measured(_revenue(b, col("o_orderkey") < 0))


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def reduce_extra_dims(b):
    build = b.scan("t", "orders", ["o_orderkey"], col("o_totalprice") > 200000.0)
    parts = b.scan("t", "part", ["p_partkey"], col("p_size") < 10)
    probe = b.scan_reduced("t", "lineitem", ["l_orderkey", "l_partkey"], "l_orderkey", build.keys("o_orderkey"), extra={"l_partkey": parts.keys("p_partkey")})
    return probe.aggregate({"n": agg("count")})


@query("SELECT o_orderpriority AS p, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 300000 GROUP BY o_orderpriority ORDER BY revenue DESC, p LIMIT 3")
def reduce_then_aggregate(b):
    return _measured(_revenue(b, col("o_totalprice") > 300000.0)).sort(desc("revenue"), asc("p")).limit(3)


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY n_name")
def ship_dimension(b):
    _nations(b, col("n_regionkey") == 2).ship("t", "dim")
    return b.scan_sql("t", "SELECT n_name, count(*) AS n FROM customer JOIN dim ON c_nationkey = n_nationkey GROUP BY n_name")


# ---- a second source: a DuckDB file, or a database over JDBC, that holds some of the tables


def _shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder, which driver and executors share, where it is mounted; a temporary folder is one machine's, or one process's."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or ""
    folder = folder.removeprefix("file://").removeprefix("file:")
    if not folder.startswith("/"):
        return None
    os.makedirs(folder, exist_ok=True)
    return folder


@functools.cache
def _duckdb_file(sf_dir: str, folder: str | None) -> str:
    import duckdb

    path = f"{tempfile.mkdtemp(prefix='crossquery-duckdb-', dir=folder)}/tables.duckdb"
    with duckdb.connect(path, config={"threads": 2, "memory_limit": "512MB", "preserve_insertion_order": False}) as db:
        for table in ("lineitem", "customer"):
            folder = f"{sf_dir.removeprefix('file://')}/{table}.parquet"
            db.execute(f"CREATE TABLE {table} AS SELECT * FROM read_parquet('{folder}{'/*.parquet' if os.path.isdir(folder) else ''}')")
    return path


def on_duckdb(session: Session, sf_dir: str) -> None:
    folder = session.spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='crossquery-staged-')}"
    session.register("d", "duckdb", path=_duckdb_file(sf_dir, _shared_folder(session.spark)), staging=folder, rows_per_task="20000")


def on_derby(session: Session, sf_dir: str) -> None:
    """Derby comes with Spark, so there is a database over JDBC without a network; it lies in the folder that driver and executors share."""
    spark = session.spark
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    if (folder := _shared_folder(spark)) is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise SourceError("set spark.checkpoint.dir to a mounted folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="crossquery-derby-")
    source = session.register("j", "derby", folder=folder, split_column="S_SUPPKEY", partitions="2")
    source.fill("SUPPLIER", spark.read.parquet(f"{sf_dir}/supplier.parquet").select(*[F.col(c).alias(c.upper()) for c in ("s_suppkey", "s_nationkey", "s_acctbal")]))


def _remote_revenue(b, build_filter):
    build = b.scan("t", "orders", ["o_orderkey", "o_orderpriority"], build_filter)
    probe = b.scan_reduced("d", "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"], "l_orderkey", build.keys("o_orderkey"))
    return _measured(build.join(probe, ["o_orderkey"], ["l_orderkey"], {"p": col("o_orderpriority"), "amount": col("l_extendedprice") * (lit(1.0) - col("l_discount"))}))


@query(_REVENUE.format("o_orderkey < 300"), on_duckdb)
def reduce_in_list_duckdb(b):
    return _remote_revenue(b, col("o_orderkey") < 300)


@query(_REVENUE.format("o_totalprice > 100000"), on_duckdb, strategy=Strategy.STAGED_KEYS)
def reduce_staged_duckdb(b):
    return _remote_revenue(b, col("o_totalprice") > 100000.0)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R' AND l_linenumber < 4", on_duckdb)
def scan_duckdb(b):
    return b.scan("d", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], (col("l_quantity") >= 49.0) & (col("l_returnflag") == "R") & (col("l_linenumber") < 4))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY n_name", on_duckdb)
def ship_duckdb(b):
    _nations(b, col("n_regionkey") == 2).ship("d", "dim")
    return b.scan_sql("d", "SELECT n_name, count(*) AS n FROM customer JOIN dim ON c_nationkey = n_nationkey GROUP BY n_name")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY c_mktsegment", on_duckdb)
def prerendered_duckdb(b):
    keys = _nations(b, col("n_regionkey") == 1).keys("n_nationkey")
    sql = "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT k FROM dynamic_keys) GROUP BY c_mktsegment"
    return b.scan_reduced("d", "customer", ["c_mktsegment", "n"], "c_nationkey", keys, injected_sql=sql)


@query("SELECT n_name, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3 GROUP BY n_name", on_derby, strategy=Strategy.STAGED_KEYS)
def reduce_staged_jdbc(b):
    build = _nations(b, col("n_regionkey") < 3)
    probe = b.scan_reduced("j", "SUPPLIER", ["s_nationkey", "s_acctbal"], "s_nationkey", build.keys("n_nationkey"))
    out = build.join(probe, ["n_nationkey"], ["s_nationkey"], {"n_name": col("n_name"), "s": col("s_acctbal")}).aggregate({"n_name": "n_name", "n": agg("count"), "total": agg("sum", col("s"))}, ["n_name"])
    return out.select({"n_name": col("n_name"), "n": col("n"), "total": fn("round", col("total"), 2)})


# ---- aggregation


def _lines(b):
    return b.scan("t", "lineitem", LINE)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(avg(l_quantity), 6) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_group(b):
    q = col("l_quantity")
    out = _lines(b).aggregate({"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "q": agg("SUM", q), "a": agg("avg", q), "lo": agg("min", col("l_extendedprice")), "hi": agg("max", col("l_extendedprice")), "n": agg("count")}, ["l_returnflag", "l_linestatus"])
    return out.select({"l_returnflag": col("l_returnflag"), "l_linestatus": col("l_linestatus"), "q": col("q"), "a": fn("round", col("a"), 6), "lo": col("lo"), "hi": col("hi"), "n": col("n")})


@query("SELECT sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_quantity > 1000")
def agg_total(b):
    return _lines(b).where(col("l_quantity") > 1000.0).aggregate({"q": agg("sum", col("l_quantity")), "n": agg("count")})


@query("SELECT count(*) AS n, count(nullif(l_returnflag, 'N')) AS m FROM lineitem")
def agg_count_star(b):
    return _lines(b).aggregate({"n": agg("count"), "m": agg("count", fn("nullif", col("l_returnflag"), "N"))})


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n, sum(DISTINCT l_quantity) AS s FROM lineitem GROUP BY 1")
def agg_distinct(b):
    return _lines(b).aggregate({"l_returnflag": "l_returnflag", "n": agg("count", col("l_partkey"), distinct=True), "s": agg("sum", col("l_quantity"), distinct=True)}, ["l_returnflag"])


@query("SELECT l_returnflag, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p FROM lineitem GROUP BY 1")
def agg_percentile_cont(b):
    out = _lines(b).aggregate({"l_returnflag": "l_returnflag", "p": within("percentile_cont", 0.25, col("l_extendedprice"))}, ["l_returnflag"])
    return out.select({"l_returnflag": col("l_returnflag"), "p": fn("round", col("p"), 4)})


@query("SELECT l_returnflag, percentile_disc(0.1) WITHIN GROUP (ORDER BY l_quantity DESC) AS p FROM lineitem GROUP BY 1")
def agg_percentile_desc(b):
    return _lines(b).aggregate({"l_returnflag": "l_returnflag", "p": within("percentile_disc", 0.1, col("l_quantity"), True)}, ["l_returnflag"])


_SETS = {"f": "l_returnflag", "s": "l_linestatus", "n": agg("count")}


@query("SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def agg_grouping_sets(b):
    return _lines(b).aggregate(_SETS, grouping_sets=[["l_returnflag", "l_linestatus"], ["l_linestatus"], []])


@query("SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(b):
    return _lines(b).rollup(_SETS, ["l_returnflag", "l_linestatus"])


@query("SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(b):
    return _lines(b).cube(_SETS, ["l_returnflag", "l_linestatus"])


@query("SELECT l_returnflag AS f, cast(grouping(l_returnflag) AS INTEGER) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def agg_grouping_fn(b):
    out = _lines(b).rollup({"f": "l_returnflag", "g": agg("grouping", col("l_returnflag")), "n": agg("count")}, ["l_returnflag"])
    return out.select({"f": col("f"), "g": col("g").cast("int32"), "n": col("n")})


@query("SELECT l_returnflag, round(100.0 * sum(l_quantity) / count(*), 6) AS r FROM lineitem GROUP BY 1")
def agg_ratio(b):
    ratio = lit(100.0) * fn("sum", col("l_quantity")) / fn("count", col("l_quantity"))
    return _lines(b).aggregate({"l_returnflag": "l_returnflag", "r": fn("round", ratio, 6)}, ["l_returnflag"])


@query("SELECT l_orderkey % 10 AS k, (l_orderkey % 10) * 2 AS twice, count(*) AS n FROM lineitem GROUP BY l_orderkey % 10")
def agg_group_expr(b):
    k = col("l_orderkey") % 10
    return _lines(b).aggregate({"k": k, "twice": k * 2, "n": agg("count")}, [k])


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 35")
def agg_having(b):
    return _lines(b).aggregate({"l_partkey": "l_partkey", "n": agg("count")}, ["l_partkey"]).where(col("n") > 35)


# ---- order, limit


@query("SELECT s, k FROM (SELECT nullif(o_orderstatus, 'P') AS s, o_orderkey AS k FROM orders) ORDER BY s DESC NULLS LAST, k DESC LIMIT 50")
def sort_multi_nulls(b):
    rows = b.scan("t", "orders", ORDER).select({"s": fn("nullif", col("o_orderstatus"), "P"), "k": col("o_orderkey")})
    return rows.sort(desc("s"), desc("k")).limit(50)


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber LIMIT 20")
def topk(b):
    return _lines(b).select(["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]).sort(desc("l_extendedprice"), asc("l_orderkey"), asc("l_partkey"), asc("l_linenumber")).limit(20)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 40")
def limit_offset(b):
    return b.scan("t", "orders", ["o_orderkey"]).sort(asc("o_orderkey")).limit(10, 40)


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
def offset_only(b):
    return b.scan("t", "nation", ["n_nationkey"]).sort(asc("n_nationkey")).limit(offset=20)


# ---- guards, raw SQL, windows, sets


@query("SELECT max(o_totalprice) AS top FROM orders")
def guard_pass(b):
    return b.scan("t", "orders", ORDER).aggregate({"top": agg("max", col("o_totalprice"))}).guard()


@query("SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1")
def guard_keyed_pass(b):
    return b.scan("t", "orders", ORDER).aggregate({"p": "o_orderpriority", "n": agg("count")}, ["o_orderpriority"]).guard("p")


def _sql(name, sql, tables):
    """A raw-SQL fragment over whole tables; the same text is the oracle."""

    def build(b):
        return b.sql(sql, **{t: b.scan("t", t, cols) for t, cols in tables.items()})

    build.__name__ = name
    query(sql)(build)


_O = {"orders": ORDER}
_sql("raw_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 250000) SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM big GROUP BY o_custkey", _O)
_sql("raw_window_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)", _O)
_sql("raw_window_dist", "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)", _O)
_sql("raw_window_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM orders", _O)
_sql("raw_window_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS c FROM orders", _O)
_sql("raw_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after, first_value(o_orderkey) OVER w AS f, cast(nth_value(o_orderkey, 2) OVER w AS DOUBLE) AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", _O)
_CS = {"customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"]}
_sql("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", _CS)
_sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", _CS)
_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier WHERE s_suppkey < 40", _CS)
_sql("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier", _CS)
_sql("set_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_suppkey < 20", _CS)
_sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier", _CS)
_CO = {"customer": ["c_custkey", "c_acctbal", "c_nationkey"], "orders": ORDER}
_sql("sub_scalar", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer)", _CO)
_sql("sub_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", _CO)
_sql("sub_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", _CO)


# ---- windows and set operations of Spark's own, over a source's DataFrames


def frames(sql: str, **tables: list[str]):
    """Registers a function of DataFrames: these columns of these tables."""

    def register(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session = Session(spark)
            session.register("t", "parquet", dir=sf_dir)
            return build(*[session.table("t", name, columns) for name, columns in tables.items()])

        QUERIES[build.__name__], ORACLE_SQL[build.__name__] = run, sql
        return build

    return register


@frames(
    "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, ntile(4) OVER w AS nt FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
    customer=["c_custkey", "c_nationkey", "c_acctbal"],
)
def native_window_rank(customer):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    calls = {"rn": F.row_number(), "rk": F.rank(), "dr": F.dense_rank(), "pr": F.percent_rank(), "cd": F.cume_dist(), "nt": F.ntile(4)}
    return customer.select("c_custkey", *[c.over(w).cast("double" if n in ("pr", "cd") else "bigint").alias(n) for n, c in calls.items()])


@frames(
    "SELECT o_orderkey, lag(o_orderkey, 2) OVER w AS a, lead(o_orderkey) OVER w AS b, first_value(o_orderkey) OVER w AS c, last_value(o_orderkey) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    orders=["o_orderkey", "o_custkey"],
)
def native_window_analytic(orders):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole, rest = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    k = "o_orderkey"
    return orders.select(k, F.lag(k, 2).over(w).alias("a"), F.lead(k).over(w).alias("b"), F.first(k).over(w).alias("c"), F.last(k).over(rest).alias("d"), F.nth_value(k, 2).over(whole).alias("e"))


@frames(
    "SELECT l_orderkey, l_linenumber, cast(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS upto FROM lineitem",
    lineitem=["l_orderkey", "l_linenumber"],
)
def native_window_frame(lineitem):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return lineitem.select("l_orderkey", "l_linenumber", F.sum("l_linenumber").over(w.rowsBetween(-1, 1)).alias("near"), F.count(F.lit(1)).over(w.rangeBetween(-2, 0)).alias("upto"))


_KEYS = {"customer": ["c_nationkey"], "supplier": ["s_nationkey"]}


@frames("SELECT c_nationkey AS c_nationkey, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1", **_KEYS)
def native_union_all(customer, supplier):
    return customer.union(supplier).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@frames("SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", **_KEYS)
def native_intersect_all(customer, supplier):
    return customer.intersectAll(supplier)


@frames("SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", **_KEYS)
def native_except_all(customer, supplier):
    return customer.exceptAll(supplier)


# ---- functions


@query(
    "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, substr(c_name, 0, 4) AS sub0, substr(c_name, 3, 4) AS sub3, concat(c_name, NULL, '!') AS cat, "
    "strpos(c_name, '#') AS pos, replace(c_name, '#', '-') AS rep, lpad(c_mktsegment, 12, '*') AS pad, reverse(c_name) AS rev, split_part(c_name, '#', 2) AS part, starts_with(c_name, 'C') AS st, "
    "lower(to_hex(c_custkey)) AS hx, trim('  x ') AS tr, sha256(c_name) AS sha, md5(c_name) AS md, c_mktsegment[1:3] AS lft, repeat('ab', 2) AS rpt, translate(c_mktsegment, 'AE', 'ae') AS tra FROM customer"
)
def fn_string(b):
    name, seg = col("c_name"), col("c_mktsegment")
    return b.scan("t", "customer", ["c_custkey", "c_name", "c_mktsegment"]).select(
        {
            "c_custkey": col("c_custkey"), "up": fn("upper", seg), "low": fn("lower", seg), "len": fn("length", name).cast("int64"), "sub0": fn("substr", name, 0, 4), "sub3": fn("substr", name, 3, 4),
            "cat": fn("concat", name, None, "!"), "pos": fn("strpos", name, "#").cast("int64"), "rep": fn("replace", name, "#", "-"), "pad": fn("lpad", seg, lit(12).cast("int32"), "*"), "rev": fn("reverse", name),
            "part": fn("split_part", name, "#", 2), "st": fn("starts_with", name, "C"), "hx": fn("to_hex", col("c_custkey")), "tr": fn("trim", "  x "), "sha": fn("sha256", name), "md": fn("md5", name),
            "lft": fn("left", seg, lit(3).cast("int32")), "rpt": fn("repeat", "ab", lit(2).cast("int32")), "tra": fn("translate", seg, "AE", "ae"),
        }
    )


@query(
    "SELECT s_suppkey, abs(s_acctbal) AS a, cast(ceil(s_acctbal) AS BIGINT) AS c, cast(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 6) AS q, trunc(s_acctbal) AS t, round(log10(s_suppkey + 1), 9) AS l, round(ln(s_suppkey + 1), 9) AS e, "
    "round(power(s_suppkey, 2), 3) AS p, cast(sign(s_acctbal) AS DOUBLE) AS sg, cast(gcd(s_suppkey, 12) AS BIGINT) AS g, cast(lcm(s_suppkey, 12) AS BIGINT) AS m, round(pi(), 9) AS pi, round(radians(s_suppkey), 9) AS r FROM supplier"
)
def fn_math(b):
    bal, k = col("s_acctbal"), col("s_suppkey")
    return b.scan("t", "supplier", ["s_suppkey", "s_acctbal"]).select(
        {
            "s_suppkey": k, "a": fn("abs", bal), "c": fn("ceil", bal), "f": fn("floor", bal), "q": fn("round", fn("sqrt", fn("abs", bal)), 6), "t": fn("trunc", bal), "l": fn("round", fn("log", k + 1), 9),
            "e": fn("round", fn("ln", k + 1), 9), "p": fn("round", fn("power", k, 2), 3), "sg": fn("sign", bal), "g": fn("gcd", k, 12), "m": fn("lcm", k, 12), "pi": fn("round", fn("pi"), 9), "r": fn("round", fn("radians", k), 9),
        }
    )


@query(
    "SELECT event_id, cast(date_part('year', ts) AS DOUBLE) AS y, cast(date_part('month', ts) AS DOUBLE) AS mo, cast(date_part('day', ts) AS DOUBLE) AS d, cast(date_part('hour', ts) AS DOUBLE) AS h, date_trunc('hour', ts) AS th, "
    "time_bucket(INTERVAL 900 SECOND, ts, TIMESTAMP '1970-01-01') AS bin, cast(make_date(2024, 1, 15) AS VARCHAR) AS md FROM events"
)
def fn_date(b):
    ts = col("ts")
    parts = {k: fn("date_part", p, ts) for k, p in {"y": "year", "mo": "month", "d": "day", "h": "hour"}.items()}
    three = [lit(x).cast("int32") for x in (2024, 1, 15)]
    return b.scan("t", "events", ["event_id", "ts"]).select({"event_id": col("event_id"), **parts, "th": fn("date_trunc", "hour", ts), "bin": fn("date_bin", 900, ts), "md": fn("make_date", *three).cast("utf8")})


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'x') AS c, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l, ifnull(nullif(o_orderstatus, 'O'), 'y') AS i FROM orders")
def fn_conditional(b):
    k, c, s = col("o_orderkey"), col("o_custkey"), col("o_orderstatus")
    return b.scan("t", "orders", ORDER).select({"o_orderkey": k, "c": fn("coalesce", fn("nullif", s, "F"), "x"), "g": fn("greatest", k, c), "l": fn("least", k, c), "i": fn("nvl", fn("nullif", s, "O"), "y")})


@query(
    "SELECT s_suppkey, round(sin(s_suppkey), 9) AS a, round(cos(s_suppkey), 9) AS b, round(tan(s_suppkey), 6) AS c, round(asin(1.0 / s_suppkey), 9) AS d, round(acos(1.0 / s_suppkey), 9) AS e, round(atan(s_suppkey), 9) AS f, round(atan2(s_suppkey, 3), 9) AS g, "
    "round(sinh(s_suppkey / 1000.0), 9) AS h, round(cosh(s_suppkey / 1000.0), 9) AS i, round(tanh(s_suppkey / 1000.0), 9) AS j, round(asinh(s_suppkey), 9) AS k, round(acosh(s_suppkey), 9) AS l, round(atanh(0.5 / s_suppkey), 9) AS m, round(cot(s_suppkey), 6) AS n, "
    "round(degrees(s_suppkey), 9) AS o, round(cbrt(s_suppkey), 9) AS p, round(exp(s_suppkey / 1000.0), 9) AS q, round(log2(s_suppkey), 9) AS r, s_suppkey = 0 AS z FROM (SELECT s_suppkey + 1 AS s_suppkey FROM supplier)"
)
def fn_trigonometry(b):
    k = col("s_suppkey") + 1
    x = k.cast("float64")
    calls = {
        "a": fn("sin", x), "b": fn("cos", x), "d": fn("asin", lit(1.0) / x), "e": fn("acos", lit(1.0) / x), "f": fn("atan", x), "g": fn("atan2", x, 3.0), "h": fn("sinh", x / 1000.0), "i": fn("cosh", x / 1000.0), "j": fn("tanh", x / 1000.0),
        "k": fn("asinh", x), "l": fn("acosh", x), "m": fn("atanh", lit(0.5) / x), "o": fn("degrees", x), "p": fn("cbrt", x), "q": fn("exp", x / 1000.0), "r": fn("log2", x),
    }
    rounded = {n: fn("round", e, 9) for n, e in calls.items()} | {n: fn("round", fn(f, x), 6) for n, f in (("c", "tan"), ("n", "cot"))}
    return b.scan("t", "supplier", ["s_suppkey"]).select({"s_suppkey": k, **rounded, "z": fn("iszero", k)})


@query(
    "SELECT p_partkey, strpos(p_brand, 'an') AS pos, cast(list_position(['x', p_brand, 'y'], p_brand) AS BIGINT) AS fis, split_part(p_brand, '#', 1) AS si, ascii(p_brand) AS asc, chr(66) AS ch, rpad(p_brand, 12, '-') AS rp, ltrim('  a ') AS lt, rtrim(' a  ') AS rt, "
    "trim('xxaxx', 'x') AS bt, levenshtein(p_brand, 'Brand#11') AS lev, ends_with(p_brand, '1') AS ew, concat_ws('/', p_brand, NULL, 'z') AS cw, contains(p_brand, '#2') AS ct, right(p_brand, 2) AS ri, bit_length(p_brand) AS bl, strlen(p_brand) AS ol FROM part"
)
def fn_string_rest(b):
    x, whole = col("p_brand"), lambda e: e.cast("int64")
    n = lambda v: lit(v).cast("int32")
    return b.scan("t", "part", ["p_partkey", "p_brand"]).select(
        {
            "p_partkey": col("p_partkey"), "pos": whole(fn("position", x, "an")), "fis": whole(fn("find_in_set", x, fn("concat", "x,", x, ",y"))), "si": fn("substr_index", x, "#", 1), "asc": fn("ascii", x), "ch": fn("chr", 66), "rp": fn("rpad", x, n(12), "-"),
            "lt": fn("ltrim", "  a "), "rt": fn("rtrim", " a  "), "bt": fn("btrim", "xxaxx", "x"), "lev": whole(fn("levenshtein", x, "Brand#11")), "ew": fn("ends_with", x, "1"), "cw": fn("concat_ws", "/", x, None, "z"), "ct": fn("contains", x, "#2"),
            "ri": fn("right", x, n(2)), "bl": whole(fn("bit_length", x)), "ol": whole(fn("octet_length", x)),
        }
    )


@query("SELECT c_custkey, lower(hex(encode(c_name))) AS hx, rtrim(to_base64(encode(c_name)), '=') AS b64, c_name AS back, lower(hex(unhex(sha256(c_name)))) AS dig, c_name AS field FROM customer")
def fn_encodings(b):
    x = col("c_name")
    hexed = fn("encode", x, "hex")
    return b.scan("t", "customer", ["c_custkey", "c_name"]).select(
        {"c_custkey": col("c_custkey"), "hx": hexed, "b64": fn("encode", x, "base64"), "back": fn("decode", hexed, "hex").cast("utf8"), "dig": fn("to_hex", fn("digest", x, "sha256")), "field": fn("coalesce", x, fn("encode", x, "hex"))}
    )


@query(
    "SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M %b %%') AS tc, strftime(ts, '%j %a') AS df, make_timestamp(event_id * 1000000) AS s, make_timestamp(event_id * 1000) AS ms, make_timestamp(event_id) AS us, cast(floor(epoch(ts)) AS BIGINT) AS ux FROM events"
)
def fn_date_formats(b):
    ts, k = col("ts"), col("event_id")
    return b.scan("t", "events", ["event_id", "ts"]).select(
        {"event_id": k, "tc": fn("to_char", ts, "%Y/%m/%d %H-%M %b %%"), "df": fn("date_format", ts, "%j %a"), "s": fn("to_timestamp_seconds", k), "ms": fn("to_timestamp_millis", k), "us": fn("to_timestamp_micros", k), "ux": fn("to_unixtime", fn("to_local_time", ts))}
    )


@query(
    "SELECT o_orderstatus AS s, median(DISTINCT o_custkey) AS md, round(stddev_samp(DISTINCT o_custkey), 6) AS sd, round(stddev_pop(DISTINCT o_custkey), 6) AS sp, round(var_samp(DISTINCT o_custkey), 3) AS vs, round(var_pop(DISTINCT o_custkey), 3) AS vp, "
    "string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS sa, cast(len(array_agg(nullif(o_orderpriority, '5-LOW'))) AS BIGINT) AS aa, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo FROM orders GROUP BY 1"
)
def agg_distinct_rest(b):
    k = col("o_custkey")
    once = lambda name, *x: agg(name, *x, distinct=True)
    r = lambda e, n: fn("round", e, n)
    out = b.scan("t", "orders", ORDER).aggregate(
        {
            "s": "o_orderstatus", "md": once("median", k), "sd": once("stddev_samp", k), "sp": once("stddev_pop", k), "vs": once("var_samp", k), "vp": once("var_pop", k), "sa": once("string_agg", col("o_orderpriority"), "|"),
            "aa": agg("array_agg", fn("nullif", col("o_orderpriority"), "5-LOW")), "ba": agg("bit_and", col("o_orderkey")), "bo": agg("bit_or", col("o_orderkey")),
        },
        ["o_orderstatus"],
    )
    return out.select({n: col(n) for n in ("s", "md", "sa", "ba", "bo")} | {"sd": r(col("sd"), 6), "sp": r(col("sp"), 6), "vs": r(col("vs"), 3), "vp": r(col("vp"), 3), "aa": fn("array_length", col("aa")).cast("int64")})


@query("SELECT p_partkey, regexp_replace(p_brand, '\\B[a-z]', '_') AS inner_once, regexp_replace(p_brand, '([a-z])([a-z])', '\\2\\1') AS swapped, regexp_replace(p_brand, '^', '>') AS lead FROM part")
def fn_regex_context(b):
    x = col("p_brand")
    return b.scan("t", "part", ["p_partkey", "p_brand"]).select({"p_partkey": col("p_partkey"), "inner_once": fn("regexp_replace", x, "\\B[a-z]", "_"), "swapped": fn("regexp_replace", x, "([a-z])([a-z])", "$2$1"), "lead": fn("regexp_replace", x, "^", ">")})


@query("SELECT p_partkey, regexp_matches(p_brand, '[1-3]$') AS m, regexp_replace(p_brand, '[a-z]', '_') AS once, regexp_replace(p_brand, '[a-z]', '_', 'g') AS every FROM part")
def fn_regex(b):
    x = col("p_brand")
    return b.scan("t", "part", ["p_partkey", "p_brand"]).select({"p_partkey": col("p_partkey"), "m": fn("regexp_like", x, "[1-3]$"), "once": fn("regexp_replace", x, "[a-z]", "_"), "every": fn("regexp_replace", x, "[a-z]", "_", "g")})


@query(
    "SELECT l_returnflag AS f, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS co, "
    "round(covar_pop(l_quantity, l_discount), 6) AS cp, round(regr_slope(l_quantity, l_extendedprice), 9) AS sl, median(l_quantity) AS md, bool_and(l_quantity > 0) AS ba, bool_or(l_quantity > 49) AS bo, bit_xor(l_orderkey) AS bx FROM lineitem GROUP BY 1"
)
def fn_stats_agg(b):
    q, p, d = col("l_quantity"), col("l_extendedprice"), col("l_discount")
    r = lambda x, n=6: fn("round", x, n)
    return _lines(b).aggregate(
        {
            "f": "l_returnflag", "sd": r(fn("stddev_samp", q)), "sp": r(fn("stddev_pop", q)), "vs": r(fn("var_samp", q)), "vp": r(fn("var_pop", q)), "co": r(fn("corr", q, p)), "cp": r(fn("covar_pop", q, d)),
            "sl": r(fn("regr_slope", q, p), 9), "md": agg("median", q), "ba": agg("bool_and", q > 0.0), "bo": agg("bool_or", q > 49.0), "bx": agg("bit_xor", col("l_orderkey")),
        },
        ["l_returnflag"],
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per order priority for large orders: build side, keys, reduced probe, join, aggregate, sort, limit."""
    return QUERIES["reduce_then_aggregate"](spark, sf_dir)
