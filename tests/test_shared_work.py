"""Texts are worked on once, in enough tasks, however many detectors read them."""

from pyspark.sql import functions as F

from colloquy import queries_findings as Q
from colloquy.operators import detectors as D
from colloquy.queries_text import objectives
from colloquy.sources import turns as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_read_features(spark):
    assert "text#" not in plan(Q.found(S.seeded_turns(spark, SF))).replace("raw_text#", "")


def test_contradiction_splits_sentences_once(spark):
    assert "posexplode" not in plan(D.contradiction(S.seeded_turns(spark, SF)))


def test_contradiction_finds_pairs_whose_other_words_are_their_own(spark):
    said = ["alpha beta gamma delta is never omega one.", "alpha beta gamma delta is omega two.", "nothing here is like any other sentence at all."]
    turns = spark.createDataFrame([(1, i + 1, "a", t) for i, t in enumerate(said)], "conv_id long, turn_number int, speaker string, raw_text string")
    assert [list(r["relevant_turns"]) for r in D.contradiction(turns).collect()] == [[1, 2]]


def test_windows_of_drift_are_counted_without_another_shuffle(spark):
    turns = S.seeded_turns(spark, SF)
    own, _ = D.drift_windows(turns, objectives(turns).where(F.col("objective") != " "), 2, 3)
    text = own.groupBy("conv_id", "turn_number").agg(F.sum("c"))._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("sequence(")]
    assert "Exchange" not in above


def test_orchestrated_drift_reads_features(spark):
    from colloquy.queries_detectors import QUERIES

    assert "text#" not in plan(QUERIES["scope_drift_orchestrated"](spark, SF)).replace("raw_text#", "")
