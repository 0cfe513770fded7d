"""What happens to findings after detection: corroboration, inhibition, salience, reports, outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy.functions import text as T
from colloquy.operators.context import classical_text, gain, low
from colloquy.operators.fuzzy import ANCHORING, ARBITRATION, CALIBRATION, COMPOUND, CONTRADICTION, EVIDENCE_GATE, FORMALITY_GATE, SEVERITY_GATE, SUNK_COST, FuzzySet, fuzzy_score
from colloquy.plans.settle import grown

#: Finding types that speak against each other, what to do about each type, and what else to say of one.
OPPOSITE = (("SYCOPHANCY", "CONTRADICTION"), ("CONFIDENCE_MISCALIBRATION", "UNSUPPORTED_CONCLUSION"), ("STATUS_QUO_BIAS", "SCOPE_DRIFT"))
ACTIONS = {
    "ANCHORING_BIAS": "Consider generating estimates independently before comparing to initial values",
    "SUNK_COST_FALLACY": "Evaluate the decision based on future value, not past investment",
    "CONTRADICTION": "Resolve contradictory claims before proceeding",
    "SCOPE_DRIFT": "Re-anchor discussion to the original objective",
    "CONFIDENCE_MISCALIBRATION": "Review confidence levels against available evidence",
    "SILENT_REVISION": "Explicitly state rationale when revising earlier decisions",
    "STATUS_QUO_BIAS": "Evaluate alternatives on merit rather than defaulting to the current state",
}
OTHER_ACTION = "Review finding: "
#: Detector -> (peer that confirms it, or any, by how much it grows then, by how much it shrinks without any peer).
PEERS = {
    "contradiction": ("scope_drift", 0.1, 0.1), "anchoring": ("confidence_miscalibration", 0.1, 0.05), "anchoring_context": ("confidence_miscalibration", 0.1, 0.05),
    "scope_drift": ("contradiction", 0.1, 0.0), "confidence_miscalibration": (None, 0.1, 0.05), "sunk_cost": ("silent_revision", 0.15, 0.0),
}


def corroboration(findings: DataFrame, reach: int = 2) -> DataFrame:
    """Adds ``corroboration``: the share of the conversation's other detectors with a finding within
    ``reach`` turns; 1 where there is no other."""
    names = findings.groupBy("conv_id").agg((F.count_distinct("detector_name") - 1).alias("others"))
    near = findings.select("conv_id", "finding_id", "detector_name", F.explode("relevant_turns").alias("t"))
    spread = near.select("conv_id", "finding_id", "detector_name", F.explode(F.sequence(F.col("t") - reach, F.col("t") + reach)).alias("t"))
    other = near.select("conv_id", F.col("detector_name").alias("other"), "t").distinct()
    met = spread.join(grown(other), ["conv_id", "t"]).where("other <> detector_name").groupBy("conv_id", "finding_id").agg(F.count_distinct("other").alias("met"))
    rows = findings.join(grown(names), "conv_id").join(grown(met), ["conv_id", "finding_id"], "left")
    share = F.when(F.col("others") == 0, F.lit(1.0)).otherwise(F.coalesce("met", F.lit(0)).cast("double") / F.col("others"))
    return rows.withColumn("corroboration", share).drop("others", "met")


def _with_context(findings: DataFrame, turns: DataFrame, gains: DataFrame | None, hedges: Iterable[str]) -> DataFrame:
    """Findings with corroboration, their conversation's formality and urgency, and whether a casual hedge in an informal
    context speaks against them (``classical``, ``hedged``)."""
    gains = (gain(turns) if gains is None else gains).select("conv_id", "formality", "urgency")
    classical = classical_text(turns, more=L.CLASSICAL_CONFIDENCE).select("conv_id", "classical")
    casual = T.once(T.tokenize(F.col("low")), lambda t: F.arrays_overlap(t, T.listed(hedges)))
    hedged = low(turns).where(casual).select("conv_id", F.col("turn_number").alias("t"))
    hedging = findings.select("conv_id", "finding_id", F.explode("relevant_turns").alias("t")).join(grown(hedged), ["conv_id", "t"]).select("conv_id", "finding_id").distinct().withColumn("hedged", F.lit(True))
    return corroboration(findings).join(grown(gains), "conv_id").join(grown(classical), "conv_id").join(grown(hedging), ["conv_id", "finding_id"], "left")


def _is_casual(formality: float) -> Column:
    return (F.col("finding_type") == "CONFIDENCE_MISCALIBRATION") & (F.col("formality") < formality) & ~F.col("classical") & F.coalesce("hedged", F.lit(False))


CONTEXT = ("formality", "urgency", "classical", "hedged")


def inhibit(findings: DataFrame, turns: DataFrame, formality: float = 0.85, urgency: float = 0.1, weak: float = 0.55, lone: float = 0.1, sure: float = 0.9, gains: DataFrame | None = None, hedges: Iterable[str] = L.CASUAL_HEDGES) -> DataFrame:
    """Adds ``action`` and ``reason`` by the first gate that decides."""
    rows = _with_context(findings, turns, gains, hedges)
    reason = (
        F.when(_is_casual(formality), "hedged")
        .when(F.col("severity") == 4, "critical")
        .when((F.col("urgency") < urgency) & (F.col("severity") <= 2), "not_urgent")
        .when((F.col("severity") == 3) & (F.col("confidence") < weak), "weak")
        .when((F.col("corroboration") < lone) & (F.col("confidence") <= sure), "uncorroborated")
        .otherwise("passed")
    )
    rows = rows.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isin("critical", "passed"), "PASS").otherwise("INHIBIT"))
    return rows.drop(*CONTEXT)


def inhibit_default_urgency(findings: DataFrame, turns: DataFrame, urgency: float = 0.5, **params) -> DataFrame:
    """The same with one urgency for all conversations."""
    return inhibit(findings, turns, gains=gain(turns).withColumn("urgency", F.lit(urgency)), **params)


def inhibit_fuzzy(findings: DataFrame, turns: DataFrame, formality: float = 0.85, block: float = 0.8, gains: DataFrame | None = None, hedges: Iterable[str] = L.CASUAL_HEDGES) -> DataFrame:
    """Adds ``action``, ``reason`` and ``inhibition``: casual hedges and critical findings are decided as before; else the strongest of
    three fuzzy gates lowers the confidence, and one beyond ``block`` inhibits."""
    rows = _with_context(findings, turns, gains, hedges)
    gates = {
        "formality_gate": fuzzy_score({"formality": F.col("formality")}, FORMALITY_GATE),
        "severity_gate": fuzzy_score({"severity": F.col("severity") * F.lit(0.75), "urgency": F.col("urgency")}, SEVERITY_GATE),
        "evidence_gate": fuzzy_score({"confidence": F.col("confidence"), "corroboration": F.col("corroboration")}, EVIDENCE_GATE),
    }
    rows = rows.withColumns({name: F.coalesce(F.round(x, 9), F.lit(0.0)) for name, x in gates.items()}).withColumn("most", F.greatest(*gates))
    strongest = F.when(F.col("most") <= 0, "passed")
    for name in gates:
        strongest = strongest.when(F.col(name) == F.col("most"), name)
    crisp = F.when(_is_casual(formality), "hedged").when(F.col("severity") == 4, "critical")
    rows = rows.withColumn("reason", F.coalesce(crisp, strongest)).withColumn("inhibition", F.when(crisp.isNull(), F.col("most")).otherwise(0.0))
    action = F.when(F.col("reason") == "hedged", "INHIBIT").when(F.col("inhibition") > block, "INHIBIT").otherwise("PASS")
    rows = rows.withColumn("action", action).withColumn("confidence", F.col("confidence") * (1 - F.col("inhibition")))
    return rows.drop(*CONTEXT, *gates, "most")


def fuzzy_severity(findings: DataFrame, least: float = 0.1) -> DataFrame:
    """Confidence replaced by a fuzzy severity for the detectors that have one (by their ``signal`` and ``strength``); what falls
    below ``least`` is dropped."""
    signal, sure = F.col("signal"), F.col("confidence")
    score = (
        F.when(F.col("detector_name").isin("anchoring", "anchoring_context"), fuzzy_score({"shift": signal}, ANCHORING))
        .when(F.col("detector_name") == "contradiction", fuzzy_score({"overlap": signal, "strength": F.col("strength")}, CONTRADICTION))
        .when(F.col("detector_name") == "confidence_miscalibration", fuzzy_score({"ece": F.coalesce(signal, sure)}, CALIBRATION))
        .when(F.col("detector_name").isin("sunk_cost", "sunk_cost_proximity"), fuzzy_score({"confidence": sure, "gap": F.least(signal, F.lit(20.0))}, SUNK_COST))
    )
    rows = findings.withColumn("_score", score)
    return rows.where(F.col("_score").isNull() | (F.round("_score", 9) >= least)).withColumn("confidence", F.coalesce("_score", "confidence")).drop("_score")


def salience(findings: DataFrame, least: float = 0.3, top: int = 10) -> DataFrame:
    """Adds ``salience`` and ``rank``; keeps findings of enough salience, ``top`` a conversation at most (the feature)."""
    same = F.count("*").over(Window.partitionBy("conv_id", "finding_type"))
    specific = F.col("detector_name").isin("anchoring", "anchoring_context", "contradiction", "sunk_cost", "sunk_cost_proximity")
    action = F.when(specific, 0.3).otherwise(0.0) + F.when(F.size("relevant_turns") > 0, 0.3).otherwise(0.0)
    action = action + F.when(F.octet_length("explanation") > 50, 0.2).otherwise(0.0) + F.when(F.col("confidence") > 0.7, 0.2).otherwise(0.0)
    score = F.lit(0.4) / same + F.lit(0.4) * action + F.lit(0.2) * F.col("severity") / F.lit(4.0)
    rows = findings.withColumn("salience", score).where(F.round("salience", 9) >= least)
    order = Window.partitionBy("conv_id").orderBy(F.round("salience", 9).desc(), "finding_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def aggregate_report(findings: DataFrame) -> DataFrame:
    """One row per conversation: counts by severity, integrity, detectors, the findings in order, and one action for each type in order."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), (-F.round("confidence", 6)).alias("c"), F.col("finding_id").alias("i"), F.col("finding_type").alias("t"))))
    rows = findings.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == 4).alias("critical"), F.count_if(F.col("severity") == 3).alias("warning"), F.count_if(F.col("severity") == 2).alias("caution"),
        F.array_join(F.array_sort(F.collect_set("detector_name")), ",").alias("detectors"), order.alias("o"),
    )
    integrity = F.greatest(F.lit(0.0), 1 - F.lit(0.3) * F.col("critical") - F.lit(0.15) * F.col("warning") - F.lit(0.05) * F.col("caution"))
    known = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    actions = F.transform(F.array_distinct(F.col("o")["t"]), lambda t: F.coalesce(F.try_element_at(known, t), F.concat(F.lit(OTHER_ACTION), t)))
    return rows.select("conv_id", "n", "critical", "warning", "caution", integrity.alias("integrity"), "detectors", F.array_join(F.col("o")["i"], ",").alias("findings"), F.array_join(actions, "; ").alias("actions"))


def conflict_pairs(findings: DataFrame) -> DataFrame:
    """Findings of a conversation that speak against each other."""
    a = findings.select("conv_id", F.col("finding_id").alias("a"), F.col("finding_type").alias("ta"), F.col("confidence").alias("ca"))
    b = findings.select("conv_id", F.col("finding_id").alias("b"), F.col("finding_type").alias("tb"), F.col("confidence").alias("cb"))
    clash = (F.col("ta") == F.col("tb")) & (((F.col("ca") > 0.6) & (F.col("cb") < 0.4)) | ((F.col("cb") > 0.6) & (F.col("ca") < 0.4)))
    for x, y in OPPOSITE:
        clash = clash | ((F.col("ta") == x) & (F.col("tb") == y)) | ((F.col("ta") == y) & (F.col("tb") == x))
    return a.join(b, "conv_id").where((F.col("a") < F.col("b")) & clash).select("conv_id", "a", "b")


def conflict_clusters(findings: DataFrame) -> DataFrame:
    """(conv_id, finding_id, cluster): components of the conflict pairs, named by their least finding.

    A conversation has at most one finding per detector, so its pairs fit one small array: each round every pair takes the
    least name its two ends have met, and as many rounds as there are ends reach along any chain.
    """
    pairs = conflict_pairs(findings)
    ends = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    grouped = pairs.select("conv_id", F.explode(ends).alias("e")).groupBy("conv_id").agg(F.collect_list("e").alias("links"))
    names = F.transform(F.array_sort(F.array_distinct(F.col("links")["x"])), lambda n: F.struct(n.alias("n"), n.alias("c")))

    def heard(known: Column, n: Column) -> Column:
        met = F.transform(F.filter("links", lambda e: e["x"] == n["n"]), lambda e: F.element_at(F.filter(known, lambda m: m["n"] == e["y"]), 1)["c"])
        return F.struct(n["n"].alias("n"), F.least(n["c"], F.array_min(met)).alias("c"))

    rows = grouped.select("conv_id", "links", names.alias("names"))
    done = F.aggregate(F.sequence(F.lit(1), F.size("names")), F.col("names"), lambda known, _: F.transform(known, lambda n: heard(known, n)))
    return rows.select("conv_id", F.explode(done).alias("m")).select("conv_id", F.col("m.n").alias("finding_id"), F.col("m.c").alias("cluster"))


def apply_panel_score(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """Confidence moved by a panel's (conv_id, score)."""
    rows = findings.join(scores, "conv_id", "left")
    shift = (F.col("score") - 0.5) * 0.2
    moved = F.when(F.col("confidence") > 0.6, F.col("confidence") + shift).when(F.col("confidence") < 0.4, F.col("confidence") - shift).otherwise(F.col("confidence"))
    return rows.withColumn("confidence", T.clamp(F.coalesce(moved, F.col("confidence")))).drop("score")


def pattern_index(memory: DataFrame) -> DataFrame:
    """(pattern, n, accuracy) of past runs' detector patterns."""
    return memory.groupBy("pattern").agg(F.count("*").alias("n")).withColumn("accuracy", F.least(F.col("n") / F.lit(3.0), F.lit(1.0)))


def self_confidence(findings: DataFrame, index: DataFrame) -> DataFrame:
    """(conv_id, pattern, agreement, margin, history, score, recommendation)."""
    rows = findings.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.stddev_pop("confidence").alias("sd"), F.avg(F.abs(F.col("confidence") - 0.5) * 2).alias("margin"), F.array_join(F.array_sort(F.collect_set("detector_name")), "+").alias("pattern")
    )
    rows = rows.join(index.select("pattern", "accuracy"), "pattern", "left").withColumn("history", F.coalesce("accuracy", F.lit(0.5)))
    rows = rows.withColumn("agreement", F.when(F.col("n") == 1, 0.8).otherwise(1 - F.col("sd")))
    score = F.lit(0.4) * F.col("agreement") + F.lit(0.35) * F.col("margin") + F.lit(0.25) * F.col("history")
    rows = rows.withColumn("score", score)
    return rows.select("conv_id", "pattern", "agreement", "margin", "history", "score", F.when(F.round("score", 9) > 0.8, "HIGH").when(F.round("score", 9) > 0.5, "MODERATE").otherwise("REVIEW").alias("recommendation"))


def consolidate(findings: DataFrame, index: DataFrame, log: DataFrame, turns: DataFrame, gains: DataFrame, confidence: DataFrame, sure: float = 0.8) -> DataFrame:
    """What runs leave in memory: rows of ``entries`` where all findings are sure or their pattern is new."""
    rows = entries(findings, log, turns, gains, confidence).join(index.select("pattern", F.lit(True).alias("known")), "pattern", "left")
    trigger = F.when(F.round("least", 9) >= sure, "HIGH_CONFIDENCE").when(F.col("known").isNull(), "NOVEL_PATTERN")
    return rows.withColumn("trigger", trigger).where("trigger is not null").drop("known", "least")


def entries(findings: DataFrame, log: DataFrame, turns: DataFrame, gains: DataFrame, confidence: DataFrame) -> DataFrame:
    """(conv_id, pattern, finding_types, confidences, severities, n_inhibited, n_passed, reasons, turns, formality, urgency, outcome,
    self_confidence, least) of every conversation with findings; ``log`` has what ``inhibit`` decided. A pattern has every detector as often as it fired."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), (-F.round("confidence", 6)).alias("c"), F.col("finding_id").alias("i"), F.col("finding_type").alias("t"))))
    rows = findings.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("detector_name")), "+").alias("pattern"), F.min("confidence").alias("least"), order.alias("o"))
    rows = rows.select("conv_id", "pattern", F.col("o")["t"].alias("finding_types"), F.transform(F.col("o")["c"], lambda x: F.abs(x)).alias("confidences"), F.transform(F.col("o")["s"], lambda x: -x).alias("severities"), "least")
    logged = log.groupBy("conv_id").agg(F.count_if(F.col("action") == "INHIBIT").alias("n_inhibited"), F.count_if(F.col("action") == "PASS").alias("n_passed"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    found = rows.join(logged, "conv_id", "left").join(sizes, "conv_id", "left").join(gains.select("conv_id", "formality", "urgency"), "conv_id", "left").join(confidence.select("conv_id", F.col("score").alias("self_confidence")), "conv_id", "left")
    return found.withColumn("outcome", F.lit("auto_confirmed"))


def user_feedback(pending: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of pending conversations with a user's verdict (conv_id, outcome), verdicts on conversations that aren't pending)."""
    known = pending.drop("outcome").join(verdicts, "conv_id").withColumn("trigger", F.lit("USER_FEEDBACK"))
    return known, verdicts.join(pending.select("conv_id"), "conv_id", "left_anti")


def feedback_pass(findings: DataFrame, confidence: DataFrame, rerun: Callable[[DataFrame], DataFrame], threshold: float = 0.6, top: int = 3, least: float = 0.1) -> DataFrame:
    """Findings after a second look, with ``delta``, and ``applied`` where anything changed in the conversation: where a conversation's self-confidence is below ``threshold``, its ``top`` least sure
    findings are detected anew, by ``rerun`` of the conversations (conv_id) concerned, and adjusted by findings of other detectors
    within a turn of theirs. A change of ``least`` or more counts; what isn't found again goes if it was surer than that."""
    unsure = confidence.where(F.round("score", 9) < threshold).select("conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.round("confidence", 9), "finding_id")
    chosen = findings.join(grown(unsure), "conv_id", "left_semi").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).select("conv_id", "detector_name")
    fresh = rerun(grown(unsure)).join(grown(chosen), ["conv_id", "detector_name"], "left_semi").select("conv_id", "detector_name", F.col("confidence").alias("_new"), F.col("relevant_turns").alias("_turns"))
    spread = fresh.select("conv_id", "detector_name", F.explode("_turns").alias("t")).select("conv_id", "detector_name", F.explode(F.sequence(F.col("t") - 1, F.col("t") + 1)).alias("t"))
    other = findings.select("conv_id", F.col("detector_name").alias("peer"), F.explode("relevant_turns").alias("t")).distinct()
    peers = spread.join(grown(other), ["conv_id", "t"]).where("peer <> detector_name").groupBy("conv_id", "detector_name").agg(F.collect_set("peer").alias("_peers"))
    seen = chosen.join(grown(fresh), ["conv_id", "detector_name"], "left").join(grown(peers), ["conv_id", "detector_name"], "left").withColumn("_looked", F.lit(True))
    peer_set = F.coalesce("_peers", F.array().cast("array<string>"))
    shift = F.lit(0.0)
    for name, (peer, up, down) in PEERS.items():
        confirmed = F.size(peer_set) > 0 if peer is None else F.array_contains(peer_set, peer)
        shift = F.when(F.col("detector_name") == name, F.when(confirmed, up).when(F.size(peer_set) == 0, -down).otherwise(0.0)).otherwise(shift)
    seen = seen.withColumn("_new", F.when(F.col("_new").isNotNull(), T.clamp(F.col("_new") + shift))).select("conv_id", "detector_name", "_new", "_looked")
    rows = findings.join(grown(seen), ["conv_id", "detector_name"], "left")
    changed = F.abs(F.col("_new") - F.col("confidence")) >= least - 1e-9
    gone = F.coalesce("_looked", F.lit(False)) & F.col("_new").isNull() & (F.col("confidence") > least)
    rows = rows.withColumns({"_gone": gone, "applied": F.bool_or(gone | F.coalesce(changed, F.lit(False))).over(Window.partitionBy("conv_id"))})
    rows = rows.where("not _gone").withColumn("delta", F.when(changed, F.col("_new") - F.col("confidence")).otherwise(0.0))
    return rows.withColumn("confidence", F.when(changed, F.col("_new")).otherwise(F.col("confidence"))).drop("_new", "_looked", "_gone").where("confidence > 0")


def effective_severity() -> Column:
    """The confidence, or what the severity stands for if that is more."""
    return F.greatest("confidence", F.col("severity") * F.lit(0.25))


def risk_inputs(findings: DataFrame) -> DataFrame:
    return findings.groupBy("conv_id").agg(F.least(F.count("*") / F.lit(10.0), F.lit(1.0)).alias("n"), T.clamp(F.max(effective_severity())).alias("severity"), F.avg("confidence").alias("confidence"))


def compound_risk(findings: DataFrame, rules: FuzzySet = COMPOUND) -> DataFrame:
    """(conv_id, n, severity, confidence, risk): how much many, severe or sure findings amount to together; 0 where no rule applies."""
    return risk_inputs(findings).withColumn("risk", F.coalesce(fuzzy_score({c: F.col(c) for c in ("n", "severity", "confidence")}, rules), F.lit(0.0)))


def compound_severity(risk: Column, threshold: float = 0.6, critical: float = 0.85) -> Column:
    """Of the finding that a risk beyond the threshold makes; 0 below."""
    return F.when(F.round(risk, 9) <= threshold, 0).when(risk > critical, 4).otherwise(3)


def compound_pathology(findings: DataFrame, threshold: float = 0.6, critical: float = 0.85, rules: FuzzySet = COMPOUND) -> DataFrame:
    """A finding where many, severe or sure findings meet, by a fuzzy risk."""
    rows = compound_risk(findings, rules).withColumn("severity", compound_severity(F.col("risk"), threshold, critical)).where("severity > 0")
    return rows.select("conv_id", F.lit("COMPOUND_PATHOLOGY").alias("finding_type"), "severity", F.col("risk").alias("confidence"))


def arbitrate(inhibited: DataFrame, low_: float = 0.35, high: float = 0.65, rules: FuzzySet = ARBITRATION) -> DataFrame:
    """(conv_id, severity, density, inhibited, risk, decision) from inhibited findings: how severe, how many, and what share was stopped."""
    rows = inhibited.groupBy("conv_id").agg(T.clamp(F.max(effective_severity())).alias("severity"), F.least(F.count("*") / F.lit(4.0), F.lit(1.0)).alias("density"), (F.count_if(F.col("action") == "INHIBIT") / F.count("*")).alias("inhibited"))
    rows = rows.withColumn("risk", F.coalesce(fuzzy_score({c: F.col(c) for c in ("severity", "density", "inhibited")}, rules), F.lit(0.0)))
    return rows.withColumn("decision", F.when(F.round("risk", 9) <= low_, "dismiss").when(F.round("risk", 9) <= high, "monitor").otherwise("investigate"))


def record_outcomes(findings: DataFrame, least: float = 0.6) -> DataFrame:
    """Sure findings as outcome rows without a verdict; the id is a hash, so reruns give the same."""
    rows = findings.where(F.round("confidence", 9) >= least)
    return rows.select(F.md5(F.concat_ws("|", F.col("conv_id").cast("string"), "finding_id")).alias("id"), "conv_id", "detector_name", "finding_type", "confidence", "severity", F.lit(None).cast("boolean").alias("outcome"))


def validate_outcomes(outcomes: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes with the latest verdict of (id, outcome, at), verdicts of unknown ids)."""
    last = verdicts.groupBy("id").agg(F.max(F.struct("at", "outcome"))["outcome"].alias("verdict"))
    known = outcomes.join(last, "id", "left").withColumn("outcome", F.coalesce("verdict", "outcome")).drop("verdict")
    return known, verdicts.join(outcomes.select("id"), "id", "left_anti")


def detector_metrics(outcomes: DataFrame) -> DataFrame:
    """(detector_name, fired, tp, fp, precision): 0 where none is validated."""
    rows = outcomes.groupBy("detector_name").agg(F.count("*").alias("fired"), F.count_if(F.col("outcome")).alias("tp"), F.count_if(~F.col("outcome")).alias("fp"))
    return rows.withColumn("precision", F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0)))


def review_signals(reports: DataFrame, findings: DataFrame, confidence: DataFrame, rejected: DataFrame) -> DataFrame:
    """(conv_id, signal): what a person should look at."""
    parts = [
        rejected.where("reason is not null").select("conv_id", F.lit("rejected").alias("signal")),
        reports.where(F.round("integrity", 9) <= 0).select("conv_id", F.lit("no_integrity").alias("signal")),
        findings.where(F.round("confidence", 9) < 0.5).select("conv_id", F.lit("unsure_finding").alias("signal")).distinct(),
        confidence.where("recommendation = 'REVIEW'").select("conv_id", F.lit("review").alias("signal")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds ``route`` and ``score`` by the text of (finding_id, conv_id, verdict)."""
    first = F.upper(F.trim(F.get(F.split("verdict", "\n"), F.lit(0))))
    number = F.regexp_extract(first, r"^(?:CONFIRMED|REJECTED):([0-9.]+)", 1).try_cast("double")
    route: Column = F.when(first.startswith("CONFIRMED") | first.startswith("AGREE"), "verified").when(first.startswith("REJECTED") | first.startswith("DISAGREE"), "disagreement").otherwise("uncertain")
    score = F.when(first.startswith("CONFIRMED") | first.startswith("REJECTED"), F.coalesce(number, F.lit(0.7))).otherwise(F.lit(0.6))
    return findings.join(verdicts, ["conv_id", "finding_id"]).select("conv_id", "finding_id", route.alias("route"), score.alias("score"))


def alert_text(findings: DataFrame, least: float = 0.2) -> DataFrame:
    """(conv_id, alert): one line of text per conversation."""
    line = F.format_string("%s (%d) %s", "finding_type", "severity", "detector_name")
    rows = findings.where(F.round("confidence", 9) >= least).groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return rows.select("conv_id", F.array_join("l", "; ").alias("alert"))


def run_metrics(turns: DataFrame, findings: DataFrame, inhibited: DataFrame, salient: DataFrame) -> DataFrame:
    """Counts of one run per conversation, before and after each gate."""
    base = turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("raw_text")).alias("text_length"))
    parts = {"raw": findings, "passed": inhibited.where("action = 'PASS'"), "salient": salient}
    for name, rows in parts.items():
        base = base.join(rows.groupBy("conv_id").agg(F.count("*").alias(name)), "conv_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return base
