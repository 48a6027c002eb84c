import pytest

from crossquery.errors import PlanError
from crossquery.plans import model as m
from crossquery.plans.builder import PlanBuilder, agg, case, col, fn, lit, node

BUILD = {"op": "source_scan", "datasource": "shop", "scan": {"table": "customers", "columns": ["id", "city"], "filter": {"node": "binary", "op": ">", "left": {"node": "column", "name": "age"}, "right": {"node": "literal", "value": {"lit": "int", "value": 30}}}}, "binding": "adults"}


def document():
    """Two scans, a reduction, a join and a sort; made anew for each test that changes it."""
    join = {
        "kind": "hash_join", "join_type": "inner", "left_keys": ["id"], "right_keys": ["customer"],
        "project": [{"expr": {"node": "column", "name": "city", "relation": "in_left"}, "alias": "city"}, {"expr": {"node": "column", "name": "price", "relation": "in_right"}, "alias": "price"}],
    }
    sort = {"kind": "sort", "keys": [{"expr": {"node": "column", "name": "price"}, "ascending": False, "nulls_first": True}]}
    steps = {
        "build": BUILD,
        "keys": {"op": "collect_distinct", "input": "adults", "key": "id", "cap": 512, "binding": "ids"},
        "probe": {"op": "injected_scan", "datasource": "lake", "scan": {"table": "sales", "columns": ["customer", "price"]}, "inject_column": "customer", "keys_from": "ids", "binding": "bought"},
        "join": {"op": "merge", "fragment": "meet", "inputs": {"in_left": "adults", "in_right": "bought"}, "binding": "met"},
        "sort": {"op": "merge", "fragment": "dearest", "inputs": {"in_0": "met"}, "binding": "sorted"},
        "end": {"op": "return", "input": "sorted"},
    }
    return steps, {"meet": join, "dearest": sort}


def parsed(steps, fragments):
    return m.Plan.of({"steps": [*steps.values()], "fragments": fragments})


def test_plan_is_read_and_written_alike():
    plan = parsed(*document())
    assert [type(s) for s in plan.steps] == [m.SourceScan, m.CollectDistinct, m.InjectedScan, m.Merge, m.Merge, m.Return]
    assert plan.steps[0].scan == m.ScanSpec(table="customers", columns=("id", "city"), filter=node(col("age") > 30))
    assert m.columns_of(plan.steps[0].scan.filter) == ["age"]
    assert m.Plan.of(m.to_json(plan)) == plan


def test_builder_makes_the_same_documents():
    b = PlanBuilder()
    e = case((col("x") > 1, "a"), otherwise=fn("upper", "b"))
    plan = b.scan("a", "t", ["x"], -col("x") / lit(2) != 1).select({"e": e, "i": col("x").isin(1, None)}).aggregate({"n": agg("count")}).returned()
    assert m.Plan.of(m.to_json(plan)) == plan


def test_guards_are_read():
    row = {"node": "column", "name": "city", "relation": "in_0"}
    assert m.parse(m.Fragment, {"kind": "single_row_guard", "keys": [row]}) == m.SingleRowGuard((node(col("city", "in_0")),))
    assert m.parse(m.Fragment, {"kind": "single_row_guard"}).keys == ()


WRONG_STEPS = {
    "an operation that does not exist": ("build", {"op": "sink_scan"}),
    "a scan without its table": ("build", {"scan": None}),
    "keys of a relation that is not there": ("keys", {"input": "minors"}),
    "a relation where keys are needed": ("probe", {"keys_from": "adults"}),
    "a fragment that is not there": ("join", {"fragment": "part"}),
    "keys as a result": ("end", {"input": "ids"}),
    "a cap that is no number": ("keys", {"cap": "many"}),
}
WRONG_FRAGMENTS = {
    "a kind of join that does not exist": ("meet", {"join_type": "sideways"}),
    "keys of one side only": ("meet", {"right_keys": []}),
    "an order without its nulls": ("dearest", {"keys": [{"expr": {"node": "column", "name": "price"}, "ascending": True}]}),
    "a number written as text": ("dearest", {"kind": "filter", "predicate": {"node": "literal", "value": {"lit": "int", "value": "1"}}}),
    "rows fewer than none": ("dearest", {"kind": "limit", "limit": -3}),
}


@pytest.mark.parametrize("why", [*WRONG_STEPS, *WRONG_FRAGMENTS])
def test_wrong_plans_are_rejected(why):
    steps, fragments = document()
    where, (name, change) = (steps, WRONG_STEPS[why]) if why in WRONG_STEPS else (fragments, WRONG_FRAGMENTS[why])
    where[name] = {k: v for k, v in (where[name] | change).items() if v is not None}
    with pytest.raises(PlanError):
        parsed(steps, fragments)


def test_a_plan_returns_something():
    steps, fragments = document()
    del steps["end"]
    with pytest.raises(PlanError):
        parsed(steps, fragments)


def test_text_that_is_not_json():
    with pytest.raises(PlanError):
        m.Plan.of("{")
