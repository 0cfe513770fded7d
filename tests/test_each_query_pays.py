"""Queries over findings work them out themselves, and what detectors share is worked out once."""

from colloquy import queries_findings as Q
from colloquy.operators import detectors as D
from colloquy.plans.settle import featured
from colloquy.sources import turns as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conviction_is_worked_out_once_for_both_windows(spark):
    both = D.run(S.seeded_turns(spark, SF), {"sustained_conviction": {}, "sustained_conviction_wide": {}})
    assert plan(both).lower().count("tanh(") == 2


def test_sentences_that_cannot_deny_meet_no_other(spark):
    said = ["alpha beta gamma delta is omega today.", "alpha beta gamma delta is omega again.", "alpha beta gamma delta is never omega one."]
    turns = spark.createDataFrame([(1, i + 1, "a", t) for i, t in enumerate(said)], "conv_id long, turn_number int, speaker string, raw_text string")
    found = D.contradiction(turns)
    assert "poles" in plan(found)
    assert [list(r["relevant_turns"]) for r in found.collect()] == [[1, 3]]


def test_features_are_written_once(spark):
    turns = featured(S.seeded_turns(spark, SF))
    assert featured(turns) is turns


def test_findings_are_not_held_between_queries(spark):
    assert Q.shared(spark, SF).inputFiles() != Q.shared(spark, SF).inputFiles()
