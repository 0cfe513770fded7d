"""The whole batch run: turns -> one scored report per conversation."""

from __future__ import annotations

import inspect
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import context as C
from colloquy.operators import detectors as D
from colloquy.operators import findings as P
from colloquy.plans.settle import featured, grown, settled

#: Presets of enabled stages.
PRESETS = {
    "all": ("admission", "modulation", "inhibit", "salience", "metacognition"),
    "no_feedback": ("admission", "modulation", "inhibit", "salience"),
    "no_modulation": ("admission", "inhibit", "salience", "metacognition"),
    "no_salience": ("admission", "modulation", "inhibit", "metacognition"),
    "detectors_inhibited": ("inhibit",),
    "detectors_only": (),
}


def admitted(turns: DataFrame, profiles: DataFrame | None = None, blocklist: Iterable[str] | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """(turns of admitted conversations, rejections with their first reason): format, then listed terms, then, with ``profiles``, language."""
    screened = C.screen_toxicity(turns) if blocklist is None else C.screen_toxicity(turns, tuple(blocklist))
    checks = C.validate_format(turns, **limits).select("conv_id", "reason").join(screened.select("conv_id", "score"), "conv_id")
    reason = F.coalesce("reason", F.when(F.col("score") > 0, F.lit("toxic")))
    if profiles is not None:
        checks = checks.join(C.detect_language(turns, profiles).select("conv_id", "supported"), "conv_id", "left")
        reason = F.coalesce(reason, F.when(~F.col("supported"), F.lit("language")))
    rejected = checks.select("conv_id", reason.alias("reason")).where("reason is not null")
    return turns.join(rejected, "conv_id", "left_anti"), rejected


def _bases(params: dict[str, dict]) -> dict[str, float]:
    """The thresholds that gain moves, before it does."""
    of = lambda n, p: params.get(n, {}).get(p, inspect.signature(D.SIGNALS.get(n) or D.REGISTRY[n]).parameters[p].default)
    return {n: of(n, p) for n, p in C.MODULATED.items()}


def _gated(found: DataFrame, turns: DataFrame, gains: DataFrame, stages: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """(findings that pass the gates, counts (conv_id, inhibited) of those that don't)."""
    log = None
    if "inhibit" in stages:
        found = settled(P.inhibit(found, turns, gains=gains if "modulation" in stages else gains.withColumn("urgency", F.lit(0.5))))
        log = found.groupBy("conv_id").agg(F.count_if(F.col("action") == "INHIBIT").alias("inhibited"))
        found = found.where("action = 'PASS'")
    return (P.salience(found) if "salience" in stages else found).select(*D.FINDING, "finding_id"), log


def _detected(turns: DataFrame, objectives: DataFrame | None, detectors: Iterable[str] | None, params: dict[str, dict], gains: DataFrame, modulated: bool, domains: DataFrame | None, routes: DataFrame | None) -> DataFrame:
    """All raw findings, under thresholds that gain and domains move."""
    thresholds = C.own_thresholds(C.modulate(gains) if modulated else None, domains, _bases(params))
    return settled(D.detect(turns, detectors, params, objectives, thresholds, routes).withColumn("confidence", F.round("confidence", 6)))


@dataclass(frozen=True)
class Worked:
    """What the reports of one set of turns share under all presets: gains, rejected conversations, and raw findings by whether gain moves thresholds. A detector finds the same in a
    conversation whatever others it reads, so findings of admitted conversations are some of all findings."""

    gains: DataFrame
    rejected: DataFrame
    found: dict[bool, DataFrame]


def worked(turns: DataFrame, objectives: DataFrame | None = None, detectors: Iterable[str] | None = None, params: dict[str, dict] | None = None, **limits) -> Worked:
    """The shared part of routed reports: each detector runs twice, however many presets there are."""
    turns, params = featured(turns), params or {}
    gains, routes = settled(C.gain(turns)), settled(C.routed_detectors(turns, objectives))
    rejected = settled(admitted(turns, **limits)[1].select("conv_id"))
    return Worked(gains, rejected, {m: _detected(turns, objectives, detectors, params, gains, m, None, routes) for m in (True, False)})


def full_report(
    turns: DataFrame, objectives: DataFrame | None = None, detectors: Iterable[str] | None = None, preset: str = "all", params: dict[str, dict] | None = None, index: DataFrame | None = None,
    profiles: DataFrame | None = None, routed: bool = True, domains: DataFrame | None = None, fuzzy_urgency: bool = False, shared: Worked | None = None, **limits,
) -> DataFrame:
    """One row per conversation with findings after all gates, under one of PRESETS: the report, gain, ``inhibited``, and with metacognition
    self-confidence and ``pass_count``; of all raw findings their number ``raw``, what they
    amount to together (``compound_risk``), and the severity of the compound finding, 0 where none is due.

    Before anything is detected, gain moves the thresholds of each conversation ("modulation") and ``domains`` (conv_id, domain, confidence) overrides them.
    With ``routed``, detectors read only conversations that have something for them; with ``fuzzy_urgency``, urgency comes from rules and
    decides how many detectors run. ``index`` is the pattern index of past runs. ``shared`` has what ``worked`` made of the same turns; what goes into it need not be given here again.

    Where self-confidence is low, the least sure findings are looked at again, and where that changes anything, the conversation
    passes the gates a second time. What detectors read of the turns is written once as a table of features; findings, what was
    decided on them and gains are worked out once (``settled``)."""
    stages, params = PRESETS[preset], params or {}
    if shared is not None:
        turns, gains, found = featured(turns), shared.gains, shared.found["modulation" in stages]
        if "admission" in stages:
            found = found.join(grown(shared.rejected), "conv_id", "left_anti")
    else:
        if "admission" in stages:
            turns, _ = admitted(turns, profiles, **limits)
        turns = featured(turns)
        gains = C.gain(turns)
        gains = settled(C.gain_fuzzy(gains) if fuzzy_urgency else gains)
        levels = C.activation_level(gains) if fuzzy_urgency and "modulation" in stages else None
        routes = settled(C.routed_detectors(turns, objectives, domains, levels)) if routed else None
        found = _detected(turns, objectives, detectors, params, gains, "modulation" in stages, domains, routes)
    kept, log = _gated(found, turns, gains, stages)
    if "metacognition" in stages:
        none = turns.sparkSession.createDataFrame([], "pattern string, n long, accuracy double")
        kept = settled(kept)
        own = P.self_confidence(kept, none if index is None else index).select("conv_id", F.col("score").alias("self_confidence"), "recommendation")
        unsure = own.select("conv_id", F.col("self_confidence").alias("score"))
        again = settled(P.feedback_pass(kept, unsure, lambda convs: found.join(convs, "conv_id", "left_semi")).where("applied"))
        second = again.select("conv_id").distinct()
        more, more_log = _gated(again.drop("applied", "delta"), turns, gains, stages)
        first_only = lambda rows: rows.join(grown(second), "conv_id", "left_anti")
        kept = first_only(kept).unionByName(more)
        log = log if log is None else first_only(log).unionByName(more_log)
    report = P.aggregate_report(kept).join(grown(gains), "conv_id")
    if log is not None:
        report = report.join(grown(log), "conv_id", "left")
    if "metacognition" in stages:
        report = report.join(grown(own), "conv_id").join(grown(second.withColumn("pass_count", F.lit(2))), "conv_id", "left").withColumn("pass_count", F.coalesce("pass_count", F.lit(1)))
    risk = P.compound_risk(found).select("conv_id", P.compound_severity(F.col("risk")).alias("compound_severity"), F.col("risk").alias("compound_risk"))
    return report.join(grown(found.groupBy("conv_id").agg(F.count("*").alias("raw"))), "conv_id").join(grown(risk), "conv_id")
