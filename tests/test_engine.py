"""Semantics that the tables cannot show: nulls, empty inputs, duplicates, errors, cleaning up."""

import decimal
import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from crossquery.errors import CardinalityError, PlanError, SourceError
from crossquery.operators import relational
from crossquery.operators.expressions import Compiler
from crossquery.plans import model as m
from crossquery.plans.builder import PlanBuilder, agg, case, col, desc, fn, lit, node, within
from crossquery.session import Session
from crossquery.sources.reduction import Strategy


@pytest.fixture
def session(spark, sf_dir):
    with Session(spark) as s:
        s.register("t", "parquet", dir=sf_dir)
        yield s


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def evaluate(spark, e, rows=((1,),), schema="x long"):
    frame = values(spark, rows, schema)
    return [r[0] for r in frame.select(Compiler(frame).column(node(e))).collect()]


# ---- expressions


@pytest.mark.parametrize(
    ("e", "expected"),
    [
        (lit(7) / 2, 3),
        (lit(-7) / 2, -3),
        (lit(7.0) / 2, 3.5),
        (lit(7) % 3, 1),
        (lit(None).is_distinct_from(1), True),
        (lit(None).is_not_distinct_from(None), True),
        (lit("Abc").like("A%"), True),
        (lit("Abc").like("a%"), False),
        (lit("Abc").ilike("a%"), True),
        (lit(1).isin(2, None), None),
        (lit(1).isin(1, None), True),
        (lit(1).isin(2, 3, negated=True), True),
        (lit(None).is_null(), True),
        (~lit(True), False),
        (-lit(3), -3),
        (lit("12").cast("int64"), 12),
        (lit(2.5).cast("int32"), 2),
        (case((lit(None), "a"), otherwise="b"), "b"),
        (case((lit(1) > 2, "a")), None),
        (fn("concat", "a", None, "b"), "ab"),
        (fn("substr", "hello", 0, 3), "he"),
        (fn("substr", "hello", 2), "ello"),
        (fn("substr", "hello", -5, 3), ""),
        (fn("trunc", -2.7), -2.0),
        (fn("log", 1000), 3.0),
        (fn("ln", 0), float("-inf")),
        (fn("gcd", 12, 18), 6),
        (fn("lcm", 4, 6), 12),
        (fn("to_hex", 255), "ff"),
        (fn("strpos", "abc", "c"), 3),
        (fn("regexp_replace", "aXbXc", "X", "-"), "a-bXc"),
        (fn("regexp_replace", "aXbXc", "X", "-", "g"), "a-b-c"),
        (fn("regexp_replace", None, "X", "-"), None),
        (fn("greatest", 1, None, 3), 3),
        (fn("nvl2", None, 1, 2), 2),
    ],
)
def test_values(spark, e, expected):
    got = evaluate(spark, e)[0]
    assert got == expected or (got is None and expected is None)


def test_case_literal_conditions_need_booleans(spark):
    assert evaluate(spark, case(("F", 1), operand=lit("F"), otherwise=2)) == [1]


@pytest.mark.parametrize("e", [m.Binary("~~", node(1), node(2)), m.Unary("abs", node(1)), m.Cast(node(1), "jsonb"), m.Function("no_such", ()), m.Function("length", ()), m.Case(())])
def test_what_is_not_supported_raises(spark, e):
    if e == m.Function("length", ()):
        with pytest.raises(Exception):  # noqa: B017 - Spark's own message about the number of arguments
            evaluate(spark, e)
        return
    with pytest.raises(PlanError):
        evaluate(spark, e)


def test_three_valued_logic(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    got = evaluate(spark, col("a") & col("b"), rows, "a boolean, b boolean")
    assert got == [False if False in r else None if None in r else True for r in rows]
    got = evaluate(spark, col("a") | col("b"), rows, "a boolean, b boolean")
    assert got == [True if True in r else None if None in r else False for r in rows]


# ---- joins

_L, _R = [(1,), (None,), (2,)], [(1, "x"), (1, "y"), (None, "n"), (3, "z")]


def _join(spark, how, l=_L, r=_R):  # noqa: E741
    semi = how in ("semi", "anti")
    names = {"a": col("a", "in_left")} | ({} if semi else {"v": col("v")})
    f = m.HashJoin(how, ("a",), ("b",), tuple(m.Projection(node(e), k) for k, e in names.items()))
    out = relational.apply(f, {"in_left": values(spark, l, "a long"), "in_right": values(spark, r, "b long, v string")})
    return sorted((tuple(x) for x in out.collect()), key=repr)


@pytest.mark.parametrize(
    ("how", "expected"),
    [
        ("inner", [(1, "x"), (1, "y")]),
        ("left", [(1, "x"), (1, "y"), (2, None), (None, None)]),
        ("right", [(1, "x"), (1, "y"), (None, "n"), (None, "z")]),
        ("full", [(1, "x"), (1, "y"), (2, None), (None, None), (None, "n"), (None, "z")]),
        ("semi", [(1,)]),
        ("anti", [(2,), (None,)]),
    ],
)
def test_null_keys_never_match(spark, how, expected):
    assert _join(spark, how) == sorted(expected, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_empty_sides(spark, how):
    assert len(_join(spark, how, l=[])) == (4 if how in ("right", "full") else 0)
    assert len(_join(spark, how, r=[])) == (3 if how in ("left", "full", "anti") else 0)


def test_unknown_join_type_and_unpaired_keys():
    with pytest.raises(PlanError):
        m.NestedLoopJoin("cross", ())
    with pytest.raises(PlanError):
        m.HashJoin("inner", ("a",), (), ())


# ---- the other fragments


def test_duplicate_output_names(spark):
    f = m.Project((m.Projection(node(col("a")), "a"), m.Projection(node(col("a")), "a")), True)
    out = relational.apply(f, {"in_0": values(spark, [(1,), (1,)], "a long")})
    assert out.columns == ["a", "a"] and [tuple(r) for r in out.collect()] == [(1, 1)]


def test_grand_total_of_nothing_is_one_row(spark):
    f = m.Aggregate((m.AggItem("n", agg=agg("count")), m.AggItem("s", agg=agg("sum", col("a")))))
    assert [tuple(r) for r in relational.apply(f, {"in_0": values(spark, [], "a long")}).collect()] == [(0, None)]


def test_ordered_set(spark):
    rows = values(spark, [(x,) for x in (1, 2, 4, 8)], "a long")
    f = m.Aggregate((m.AggItem("p", agg=within("percentile_cont", 0.5, col("a"))), m.AggItem("d", agg=within("percentile_disc", 0.25, col("a"), True))))
    assert [tuple(r) for r in relational.apply(f, {"in_0": rows}).collect()] == [(3.0, 8.0)]


def test_grouping_sets_override_group_by(spark):
    f = m.Aggregate((m.AggItem("a", expr=node(col("a"))), m.AggItem("n", agg=agg("count"))), (node(col("a")),), ((),))
    with pytest.raises(Exception):  # noqa: B017 - a is in no grouping set, so it cannot be selected
        relational.apply(f, {"in_0": values(spark, [(1,)], "a long")}).collect()


@pytest.mark.parametrize(("up", "first", "expected"), [(True, True, [None, 1, 2]), (True, False, [1, 2, None]), (False, True, [None, 2, 1]), (False, False, [2, 1, None])])
def test_null_order(spark, up, first, expected):
    out = relational.apply(m.Sort((m.SortKey(node(col("a")), up, first),)), {"in_0": values(spark, [(1,), (None,), (2,)], "a long")})
    assert [r[0] for r in out.collect()] == expected


def test_guards(spark):
    two = values(spark, [(1, 2), (1, 3), (2, 4)], "k long, v long")
    once = values(spark, [(1, 2), (2, 4)], "k long, v long")
    keyed, plain = m.SingleRowGuard((node(col("k")),)), m.SingleRowGuard()
    assert relational.apply(keyed, {"in_0": once}).count() == 2
    for frame, guard in ((two, keyed), (two, plain), (once, plain), (values(spark, [(None, 1), (None, 2)], "k long, v long"), keyed)):
        with pytest.raises(CardinalityError, match="Scalar subquery produced more than one row"):
            relational.apply(guard, {"in_0": frame})
    assert relational.apply(plain, {"in_0": once.limit(0)}).count() == 0


def test_raw_sql_views_come_back(spark):
    values(spark, [(9,)], "a long").createOrReplaceTempView("in_0")
    out = relational.apply(m.RawSql("SELECT a + 1 AS b FROM in_0"), {"in_0": values(spark, [(1,)], "a long")})
    assert [r[0] for r in out.collect()] == [2]
    assert [r[0] for r in spark.table("in_0").collect()] == [9]
    spark.catalog.dropTempView("in_0")


def test_missing_input(spark):
    with pytest.raises(PlanError):
        relational.apply(m.Limit(1), {"in_left": values(spark, [(1,)], "a long")})


# ---- sources and sessions


def test_sources(spark, session, sf_dir):
    assert "lineitem" in session.sources["t"].tables()
    assert session.query("t", 'SELECT count(*) AS n FROM main."region"').first()[0] == 5
    for wrong in (lambda: session.sources["x"], lambda: session.register("x", "csv"), lambda: session.register("x", "parquet"), lambda: session.register("x", "postgres", uri="mysql://h/d")):
        with pytest.raises(SourceError):
            wrong()
    url = session.register("p", "postgresql", uri="postgresql://me:a%40b@db:5433/shop")
    assert (url.url, url.params["user"], url.params["password"]) == ("jdbc:postgresql://db:5433/shop", "me", "a@b")
    with pytest.raises(PlanError):
        session.read_partitioned("t", "region")


@pytest.mark.parametrize("spec", [m.ScanSpec(columns=("a",)), m.ScanSpec(table="region"), m.ScanSpec(table="region", columns=("r_name",), parallel=True), m.ScanSpec(table="region", schema="other", columns=("r_name",))])
def test_wrong_scans(session, spec):
    with pytest.raises(PlanError):
        session.run(m.Plan((m.SourceScan("t", spec, "b"), m.Return("b"))))


def test_filter_and_columns_reach_the_scan(session, capsys):
    b = PlanBuilder()
    session.run(b.scan("t", "lineitem", ["l_orderkey"], col("l_quantity") > 45.0).returned()).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_shared_bindings_are_persisted_until_close(spark, sf_dir):
    b = PlanBuilder()
    shared = b.scan("t", "region", ["r_regionkey"])
    plan = shared.join(shared, ["r_regionkey"], ["r_regionkey"], {"k": col("r_regionkey", "in_left")}).returned()
    session = Session(spark)
    session.register("t", "parquet", dir=sf_dir)
    out = session.run(plan)
    assert len(session._held) == 1 and out.count() == 5
    held = session._held[0]
    session.close()
    assert held.storageLevel.useMemory is False and out.count() == 5


def test_a_failed_run_holds_nothing(spark, sf_dir):
    b = PlanBuilder()
    shared = b.scan("t", "region", ["r_regionkey"])
    plan = shared.join(shared.guard(), ["r_regionkey"], ["r_regionkey"], {"k": col("r_regionkey", "in_left")}).returned()
    session = Session(spark)
    session.register("t", "parquet", dir=sf_dir)
    with pytest.raises(CardinalityError):
        session.run(plan)
    assert session._held == []


def test_keys_that_cannot_be_injected(session):
    b = PlanBuilder()
    keys = b.scan("t", "orders", ["o_orderkey"]).keys("o_orderkey")
    with pytest.raises(PlanError):
        session.run(b.scan_reduced("t", "lineitem", ["l_orderkey"], "no_column", keys).returned())


@pytest.fixture(scope="module")
def duck(tmp_path_factory, sf_dir):
    import duckdb

    path = str(tmp_path_factory.mktemp("duck") / "d.duckdb")
    with duckdb.connect(path) as db:
        db.execute(f"CREATE TABLE lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
        db.execute("CREATE TABLE probe AS SELECT range AS k, 'v' || range AS v FROM range(100)")
    return path


@pytest.mark.parametrize("strategy", [None, *Strategy])
@pytest.mark.parametrize("limit", [20, 4000, 0])
def test_two_sources_and_every_strategy_give_the_same(session, duck, tmp_path, strategy, limit):
    session.register("d", "duckdb", path=duck, staging=f"file://{tmp_path}")
    b = PlanBuilder()
    build = b.scan("t", "orders", ["o_orderkey", "o_orderpriority"], col("o_orderkey") < limit)
    probe = b.scan_reduced("d", "lineitem", ["l_orderkey", "l_quantity"], "l_orderkey", build.keys("o_orderkey"))
    plan = build.join(probe, ["o_orderkey"], ["l_orderkey"], {"p": col("o_orderpriority"), "q": col("l_quantity")}).aggregate({"n": agg("count"), "q": agg("sum", col("q"))}).returned()
    expected = session.query("t", f"SELECT count(*), sum(l_quantity) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < {limit}").first()
    assert tuple(session.run(plan, strategy).first()) == tuple(expected)


def test_prerendered_sql_reads_the_keys(session, duck, tmp_path):
    session.register("d", "duckdb", path=duck, staging=f"file://{tmp_path}")
    for source, sql in (("d", "SELECT v FROM probe WHERE k IN (SELECT k FROM dynamic_keys)"), ("t", "SELECT n_name AS v FROM nation WHERE n_regionkey IN (SELECT k FROM dynamic_keys)")):
        b = PlanBuilder()
        keys = b.scan("t", "region", ["r_regionkey"], col("r_regionkey") < 2).keys("r_regionkey")
        spec = m.ScanSpec(table="probe", columns=("v",), injected_sql=sql)
        plan = m.Plan((*b.steps, m.InjectedScan(source, spec, "k", keys.name, "p"), m.Return("p")))
        assert session.run(plan).count() == (2 if source == "d" else 10)


def test_catalogue_fraction(session, duck):
    source = session.register("d", "duckdb", path=duck)
    assert source.fraction("probe", None, "k", 25) == 0.25
    assert source.fraction("nothing", None, "k", 25) is None


def test_ship_to_a_remote_source(session, duck, tmp_path):
    session.register("d", "duckdb", path=duck, staging=f"file://{tmp_path}")
    b = PlanBuilder()
    b.scan("t", "region", ["r_regionkey"]).ship("d", "few")
    out = session.run(b.scan_sql("d", "SELECT v FROM probe JOIN few ON k = r_regionkey").returned())
    assert sorted(r[0] for r in out.collect()) == [f"v{k}" for k in range(5)]


def test_jdbc_source(spark, session, tmp_path):
    """Derby comes with Spark, so a database over JDBC can be had without a network."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        values(spark, [(k if k else None, f"v{k}") for k in range(50)], "k long, v string").write.format("jdbc").options(url=url, dbtable="probe", driver=driver).save()
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no Derby here: {e!s:.80}")
    session.register("j", "jdbc", url=url, driver=driver, split_column="k")
    assert session.query("j", 'SELECT count(*) AS "n" FROM probe').first()[0] == 50
    table = spark.read.format("jdbc").options(url=url, dbtable="probe", driver=driver).load()
    assert table.columns == ["k", "v"]
    split = session.read_partitioned("j", "PROBE", None, 4)
    assert split.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)


def test_keys_and_relations_are_staged_over_jdbc(spark, session, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/s;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        values(spark, [(k, f"v{k}", k * 1.5) for k in range(3000)], "ID long, NAME string, PRICE double").write.format("jdbc").options(url=url, dbtable="PROBE", driver=driver, createTableColumnTypes="NAME VARCHAR(99)").save()
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no Derby here: {e!s:.80}")
    source = session.register("j", "jdbc", url=url, driver=driver, split_column="ID", partitions="3", types='{"price": "decimal(10,2)"}')
    for key, name in (("o_orderkey", "ID"), ("name", "NAME")):
        b = PlanBuilder()
        build = b.scan("t", "orders", ["o_orderkey"], col("o_orderkey") < 2500).select({"o_orderkey": col("o_orderkey"), "name": fn("concat", "v", col("o_orderkey").cast("utf8"))})
        plan = b.scan_reduced("j", "PROBE", ["ID", "PRICE"], name, build.keys(key)).returned()
        rows = {s: sorted(map(tuple, session.run(plan, s).collect())) for s in (Strategy.STAGED_KEYS, Strategy.FULL_READ)}
        assert rows[Strategy.STAGED_KEYS] == rows[Strategy.FULL_READ] and len(rows[Strategy.FULL_READ]) > 100
        assert session.run(plan, Strategy.STAGED_KEYS).schema["PRICE"].dataType.simpleString() == "decimal(10,2)"
    b = PlanBuilder()
    b.scan("t", "region", ["r_regionkey"]).ship("j", "few")
    assert session.run(b.scan_sql("j", 'SELECT NAME FROM PROBE JOIN few ON ID = "r_regionkey"').returned()).count() == 5
    assert len(source._staged) == 5
    session.close()
    left = spark.read.format("jdbc").options(url=url, driver=driver, query="SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLENAME LIKE 'CROSSQUERY%'").load()
    assert source._staged == [] and left.count() == 0


def test_derby_rows_and_keys_come_back_as_they_were(spark, session, tmp_path):
    rows = [(1, "a,b", 1.5, None, True), (2, '"q"', -0.1, None, None), (3, "two\nlines", 1e300, None, False), (4, "", None, None, True), (5, None, 0.1, None, False), (6, " \u0130 ' ", 2.0, None, True), (7, "\\", 3.0, None, True)]
    source = session.register("j", "derby", folder=str(tmp_path), split_column="K", partitions="3", types='{"d": "decimal(20,4)"}')
    source.fill("T", values(spark, rows, "K long, S string, V double, D decimal(20,4), B boolean").withColumn("D", F.expr("cast(K as decimal(20,4)) / 8")).select("K", "S", "V", F.col("D").cast("decimal(20,4)").alias("D"), "B"))
    expected = [(*r[:3], decimal.Decimal(r[0]) / 8, r[4]) for r in rows]
    assert sorted(map(tuple, session.table("j", "T").collect())) == expected
    first = source.url
    assert source.url == first  # one copy for all reads
    many = spark.range(3, 30_000).select(F.col("id").alias("k"))
    assert sorted(r[0] for r in source.matching("T", None, "k", many, "keys").collect()) == [3, 4, 5, 6, 7]
    assert source.url != first and sorted(map(tuple, session.table("j", "T").collect())) == expected
    assert source.matching("T", None, "k", many.where("k < 0"), "keys").count() == 0
    source.fill("ONE", values(spark, [(1,), (None,), (2,)], "k long"))
    assert sorted((r[0] or 0) for r in session.table("j", "ONE").collect()) == [0, 1, 2]
    with pytest.raises(PlanError):
        source.fill("U", values(spark, [([1],)], "a array<int>"))
    session.close()
    assert not os.listdir(tmp_path)


ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from crossquery.queries import QUERIES

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "file://" + sys.argv[2]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("ROWS", sorted(map(tuple, QUERIES["reduce_staged_jdbc"](spark, sys.argv[1]).collect())))
"""


def test_staged_jdbc_where_executors_are_other_processes(spark, sf_dir, tmp_path):
    import pyspark
    from crossquery.queries import QUERIES

    home = tmp_path / "home"  # a cluster of processes writes its logs to Spark's home
    home.mkdir()
    for p in Path(pyspark.__path__[0]).iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell"}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, sf_dir, str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"ROWS {sorted(map(tuple, QUERIES['reduce_staged_jdbc'](spark, sf_dir).collect()))}" in done.stdout


def test_duckdb_reads_columns_and_ranges(session, duck, spark):
    from crossquery.sources.duckdb_reader import DuckDbReader

    source = session.register("d", "duckdb", path=duck, rows_per_task="1000")
    whole = source.table("lineitem")
    some = source.table("lineitem", None, ["L_ORDERKEY", "l_quantity", "nothing"])
    assert some.columns == ["l_orderkey", "l_quantity"] and some.rdd.getNumPartitions() > 3
    assert some.count() == whole.count() == session.query("t", "SELECT count(*) FROM lineitem").first()[0]
    reader = DuckDbReader({"path": duck, "query": "SELECT * FROM lineitem"}).reader(None)
    from pyspark.sql.datasource import GreaterThan, IsNotNull

    assert [*reader.pushFilters([GreaterThan(("l_quantity",), 49.0), IsNotNull(("l_quantity",))])]
    assert reader.conditions == ['"l_quantity" > 49.0', '"l_quantity" IS NOT NULL']
    assert len(reader.partitions()) == 1
    with pytest.raises(SourceError):
        session.register("e", "duckdb", path=duck, staging="hdfs://host/x").query("SELECT 1", {"few": values(spark, [(1,)], "a long")})


def test_lists_reach_a_parquet_scan_and_joins_are_not_repeated(session, capsys):
    def plan(condition, how="inner"):
        b = PlanBuilder()
        build = b.scan("t", "orders", ["o_orderkey"], condition)
        probe = b.scan_reduced("t", "lineitem", ["l_orderkey", "l_quantity"], "l_orderkey", build.keys("o_orderkey"))
        session.run(build.join(probe, ["o_orderkey"], ["l_orderkey"], {"q": col("l_quantity")}, how).returned()).explain("formatted")
        return capsys.readouterr().out

    few = plan(col("o_orderkey") < 40)
    assert "In(l_orderkey, [" in few and "LeftSemi" not in few
    assert few.count("Join") and "Distinct" not in few
    assert "LeftSemi" not in plan(col("o_orderkey") >= 0) or session.query("t", "SELECT count(*) FROM orders").first()[0] < 2000


def test_division_by_zero_is_infinite(spark):
    rows = values(spark, [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in rows.select(Compiler(rows).column(node(col("a") / col("b")))).collect()]
    assert [str(x) for x in got] == ["inf", "-inf", "nan", "0.25", "None", "None"]


def test_functions_in_context(spark):
    from crossquery.functions import catalog

    rows = values(spark, [("a b a",)], "t string")
    call = lambda name, *args: rows.select(catalog.call(name, [F.lit(a) if not isinstance(a, Column) else a for a in args])).first()[0]
    t = F.col("t")
    assert call("regexp_replace", t, "(?<=b )a", "X") == "a b X" and call("regexp_replace", t, "\\Bz", "X") == "a b a"
    assert call("regexp_replace", t, "(a) (b)", "$2\\$$1") == "b$a a" and call("regexp_replace", t, "q*", "X") == "Xa b a"
    assert call("position", F.lit("banana"), "n") == 3 and call("strpos", F.lit("banana"), "n") == 3
    assert call("named_struct", "a", 1)["a"] == 1 and call("to_hex", catalog.call("decode", [F.lit("ff00"), F.lit("hex")])) == "ff00"
    nulls = values(spark, [(1,), (None,), (1,)], "x int")
    assert sorted(nulls.select(catalog.aggregate("array_agg", [F.col("x")])).first()[0], key=str) == [1, 1, None]
    assert nulls.select(catalog.aggregate("nth_value", [F.col("x"), F.lit(9)])).first()[0] is None


def test_steps_are_profiled(spark, sf_dir):
    b = PlanBuilder()
    plan = b.scan("t", "region", ["r_regionkey"]).where(col("r_regionkey") < 3).returned()
    with Session(spark, profile=True) as session:
        session.register("t", "parquet", dir=sf_dir)
        assert session.run(plan).count() == 3
        assert [(p.tag, p.rows) for p in session.profiled[:2]] == [("source_scan", 5), ("merge", 3)]


def test_arrow_in_and_out(spark):
    frame = spark.createDataFrame(pa.table({"a": [1, 2], "b": ["x", None]}))
    assert frame.toArrow().to_pydict() == {"a": [1, 2], "b": ["x", None]}


def test_top_k_is_fused(session, capsys):
    b = PlanBuilder()
    session.run(b.scan("t", "orders", ["o_orderkey"]).sort(desc("o_orderkey")).limit(3).returned()).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


@pytest.mark.parametrize("groups", [(node(col("g")),), ()])
def test_distinct_spread_and_median_are_dealt_out(spark, groups):
    """30,000 distinct values: what walks through a group's values once for each value does not end."""
    n = 30_000
    frame = spark.range(2 * n).select((F.col("id") % n).alias("x"), F.lit(None).cast("string").alias("g"), F.lit("a").alias("s"))
    once = lambda name, c="x": agg(name, col(c), distinct=True)
    items = {"md": once("median"), "sp": once("stddev_pop"), "vs": once("variance"), "vp": once("VAR_POP"), "n": agg("count"), "sa": agg("string_agg", col("s"), distinct=True)}
    f = m.Aggregate(tuple(m.AggItem(k, agg=x) for k, x in items.items()), groups)
    (row,) = relational.apply(f, {"in_0": frame}).collect()
    assert list(row.asDict()) == list(items)
    assert (row["md"], row["n"], row["sa"]) == ((n - 1) / 2, 2 * n, "a")
    assert abs(row["vp"] - (n * n - 1) / 12) < 1e-3 and abs(row["vs"] - n * (n + 1) / 12) < 1e-3 and abs(row["sp"] ** 2 - row["vp"]) < 1e-3


def test_distinct_median_in_grouping_sets_and_alone(spark):
    frame = values(spark, [("a", 1), ("a", 1), ("a", 4), (None, 7), (None, None)], "g string, x long")
    g, item = node(col("g")), m.AggItem("md", agg=agg("median", col("x"), distinct=True))
    both = m.Aggregate((m.AggItem("g", expr=g), item), grouping_sets=((g,), ()))
    assert sorted((tuple(r) for r in relational.apply(both, {"in_0": frame}).collect()), key=repr) == [("a", 2.5), (None, 4.0), (None, 7.0)]
    alone = m.Aggregate((item,), (g,))
    assert sorted(r[0] for r in relational.apply(alone, {"in_0": frame}).collect()) == [2.5, 7.0]
    assert relational.apply(alone, {"in_0": frame.where("false")}).count() == 0
    assert [tuple(r) for r in relational.apply(m.Aggregate((item,)), {"in_0": frame.where("false")}).collect()] == [(None,)]


def test_staged_keys_are_dealt_to_duckdb_tasks(session, duck, tmp_path):
    """No task looks up all keys, and together they find each row once."""
    from crossquery.sources import duckdb_reader

    source = session.register("d", "duckdb", path=duck, staging=f"file://{tmp_path}", keys_per_task="100")
    keys = session.query("t", "SELECT DISTINCT o_orderkey AS k FROM orders")
    found = source.matching("lineitem", None, "L_ORDERKEY", keys, "keys", ["l_orderkey", "l_linenumber"])
    assert found.columns == ["l_orderkey", "l_linenumber"] and found.rdd.getNumPartitions() > 3
    expected = session.query("t", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert source.matching("lineitem", None, "l_orderkey", keys.where("false"), "keys").count() == 0
    with duckdb_reader.connect({"path": duck}) as db:
        assert db.execute("SELECT current_setting('threads'), current_setting('memory_limit')").fetchall() == [(1, "122.0 MiB")]
