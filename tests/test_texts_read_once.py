"""Phrases are looked for once a text, objectives read once, and words of sentences dealt out once."""

import pyarrow as pa
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy.functions.spotted import finder, spotted
from colloquy.operators import detectors as D
from colloquy.plans.settle import featured
from colloquy.queries_text import objectives
from colloquy.sources import turns as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spotted_phrases_are_those_the_text_contains(spark):
    texts = ["", None, "so", "é so", "we'll use it, so be it", "as simonides said that, as i said", "absolutel", "y absolutely", *[p[1:] + p for p in L.SPOTTED], *[p[:-1] for p in L.SPOTTED], " ".join(L.SPOTTED)]
    want = [None if t is None else sorted(p for p in L.SPOTTED if p in t) for t in texts]
    got = finder(L.SPOTTED)(pa.array(texts)).to_pylist()
    assert [None if g is None else sorted(g) for g in got] == want
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spotted(F.col("t"), L.SPOTTED).alias("p")).orderBy("i").collect()
    assert [None if r["p"] is None else sorted(r["p"]) for r in rows] == want


def test_phrases_with_quotes_are_told_apart(spark):
    rows = [(1, i + 1, "assistant", t) for i, t in enumerate(["don’t mend what is not broken", "don't mend what is not broken"])]
    turns = featured(spark.createDataFrame(rows, "conv_id long, turn_number int, speaker string, raw_text string"))
    phrase = next(p for p in L.STATUS_QUO if p.startswith("don't"))
    turns = turns.withColumn("raw_text", F.lit("")).withColumn("plain", F.replace("plain", F.lit("don't mend"), F.lit(phrase))).withColumn("phrases", F.array(F.lit(phrase)))
    got = [r[0] for r in turns.withColumn(D.PLAIN, D._plain_phrases()).orderBy("turn_number").select(D.hits_of("plain", L.STATUS_QUO)).collect()]
    assert got == [0, 1]


def test_lists_of_ones_own_are_still_searched(spark):
    turns = spark.createDataFrame([(1, i, "assistant", "We keep the old plum tree.") for i in (1, 2, 3, 4)], "conv_id long, turn_number int, speaker string, raw_text string")
    assert [r["detector_name"] for r in D.status_quo_bias(turns, keeping=("plum", "old"), threshold=0.5).collect()] == ["status_quo_bias"]


def test_detectors_do_not_search_texts_for_each_list(spark):
    turns = featured(S.seeded_turns(spark, SF))
    text = plan(D.run(turns, {n: {} for n in ("status_quo_bias", "evidence_asymmetry", "sustained_conviction")}))
    assert text.count("Contains(") <= 1


def test_words_of_sentences_are_ranked_where_they_are(spark):
    assert plan(D.contradiction(S.seeded_turns(spark, SF))).count("Window [") <= 1


def test_objectives_are_read_once(spark):
    turns = featured(S.seeded_turns(spark, SF))
    assert "objective" not in plan(D.drift_distances(turns, objectives(turns), 2))
