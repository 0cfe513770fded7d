"""Only tables of fixed size are sent to all tasks by way of the driver, and traits are worked out once."""

from colloquy.operators import detectors as D
from colloquy.plans.settle import featured
from colloquy.queries_findings import QUERIES
from colloquy.queries_text import objectives
from colloquy.sources import turns as S

SF = "/root/testdata/sf0.001"


def nodes(plan):
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        children = plan.children()
        for i in range(children.size()):
            yield from nodes(children.apply(i))


def broadcast_rows(df):
    df.collect()
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "BroadcastExchangeExec"]
    return [n.metrics().apply("numOutputRows").value() for n in found]


def test_measures_send_only_variants(spark):
    assert max(broadcast_rows(QUERIES["variant_measures"](spark, SF))) <= 3


def test_gates_send_nothing(spark):
    assert broadcast_rows(QUERIES["inhibit"](spark, SF)) == []


def test_winners_work_out_traits_once(spark):
    df = QUERIES["profile_winners"](spark, SF)
    # No profile weighs the 99th percentile, so one is left.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == 1
    assert max(broadcast_rows(df)) <= 3


def test_second_look_sends_patterns_alone(spark):
    assert len(broadcast_rows(QUERIES["feedback_pass"](spark, SF))) <= 1


def test_drift_sends_no_list_of_conversations(spark):
    turns = featured(S.seeded_turns(spark, SF))
    df = D.drift_distances(turns, objectives(turns), 2)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
