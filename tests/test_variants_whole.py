"""The comparison of presets runs all detectors, each of them twice: with and without thresholds moved by gain."""

from pyspark.sql import functions as F

from colloquy.operators import context as C
from colloquy.operators import detectors as D
from colloquy.plans import report as R
from colloquy.queries_findings import PARAMS, found
from colloquy.queries_live import QUERIES
from colloquy.queries_text import objectives
from colloquy.sources import turns as S

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_variants_count_what_all_detectors_find(spark, monkeypatch):
    runs, detect = [], D.detect
    monkeypatch.setattr(D, "detect", lambda *a: runs.append(a) or detect(*a))
    rows = {r["variant"]: r["findings"] for r in QUERIES["variants"](spark, LARGER).collect()}
    assert len(runs) == 2
    turns = S.seeded_turns(spark, LARGER)
    routes = C.routed_detectors(turns, objectives(turns)).withColumnRenamed("detector", "detector_name")
    raw = [r[0] for r in found(turns).join(routes, ["conv_id", "detector_name"]).select("detector_name").collect()]
    assert "silent_revision" in raw
    assert rows["detectors_only"] == len(raw)


def test_shared_reports_are_those_of_each_preset(spark):
    turns = S.seeded_turns(spark, SF).where("conv_id % 3 <> 1 OR turn_number <= 4")
    goals = objectives(turns)
    shared = R.worked(turns, goals, params=PARAMS, max_turns=4)
    rejected = {r[0] for r in shared.rejected.collect()}
    tidy = lambda df: sorted(df.select(F.to_json(F.struct(*sorted(df.columns))), "conv_id").collect())
    for preset in ("all", "detectors_only"):
        own = tidy(R.full_report(turns, goals, preset=preset, params=PARAMS, max_turns=4))
        assert own and tidy(R.full_report(turns, preset=preset, shared=shared)) == own
        assert bool(rejected & {r["conv_id"] for r in own}) == (preset == "detectors_only")
