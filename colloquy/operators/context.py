"""Admission gates, context features, routing and thresholds, per conversation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy.functions import text as T
from colloquy.functions.spotted import spotted
from colloquy.operators.fuzzy import URGENCY, FuzzySet, fuzzy_score

REASONS = ("no_turns", "too_many_turns", "too_large", "not_utf8", "toxic", "language")


def low(turns: DataFrame) -> DataFrame:
    return turns if "low" in turns.columns else turns.withColumn("low", T.lowered(F.col("raw_text")))


#: What detectors, routing and gain read of a turn's text: ``plain`` is lowered, ``low`` with plain quotes too; ``phrases`` are those of the lexicons that ``low`` contains.
FEATURES = {
    "plain": lambda: F.lower("raw_text"),
    "low": lambda: T.lowered(F.col("raw_text")),
    "said": lambda: (F.lower("speaker") == "assistant") & (F.btrim("raw_text", F.lit(" \n\t")) != ""),
    "numbers": lambda: T.numeric_tokens(F.col("raw_text")),
    "keywords": lambda: T.keywords(F.col("raw_text")),
    "phrases": lambda: spotted(T.lowered(F.col("raw_text")), L.SPOTTED),
}


def enrich(turns: DataFrame, *names: str) -> DataFrame:
    """Turns with these features (all by default). Those that the turns have are kept, so a table of features is worked out once and read by all."""
    missing = [n for n in names or FEATURES if n not in turns.columns]
    return turns.withColumns({n: FEATURES[n]() for n in missing}) if missing else turns


def validate_format(turns: DataFrame, max_turns: int = 500, max_bytes: int = 1_048_576, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_turns, n_bytes, reason): the first reason to reject a conversation, or null.

    Texts may be binary; then bytes that aren't UTF-8 are a reason too. With ``conversations`` (conv_id, objective), those
    without turns are rejected, and the objective's bytes count."""
    text, speaker = F.col("raw_text"), F.col("speaker")
    broken = F.bool_or(~F.coalesce(F.is_valid_utf8(text), F.lit(True))) if turns.schema["raw_text"].dataType.simpleString() == "binary" else F.lit(False)
    size = F.coalesce(F.octet_length(text), F.lit(0)) + F.coalesce(F.octet_length(speaker), F.lit(0))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(size).alias("n_bytes"), broken.alias("_broken"))
    if conversations is not None:
        sizes = conversations.select("conv_id", F.coalesce(F.octet_length("objective"), F.lit(0)).alias("_own")).join(sizes, "conv_id", "left")
        sizes = sizes.withColumns({"n_turns": F.coalesce("n_turns", F.lit(0)), "n_bytes": F.coalesce("n_bytes", F.lit(0)) + F.col("_own"), "_broken": F.coalesce("_broken", F.lit(False))})
    reason = F.when(F.col("n_turns") == 0, "no_turns").when(F.col("n_turns") > max_turns, "too_many_turns").when(F.col("n_bytes") > max_bytes, "too_large").when(F.col("_broken"), "not_utf8")
    return sizes.select("conv_id", "n_turns", F.col("n_bytes").cast("long").alias("n_bytes"), reason.alias("reason"))


def screen_toxicity(turns: DataFrame, blocklist: tuple[str, ...] = L.BLOCKLIST) -> DataFrame:
    """(conv_id, matched, score): listed terms that stand as words of their own, and their share of the list."""
    rows = low(turns)
    flags = [F.max(T.bounded(F.col("low"), term).cast("int")).alias(f"_{i}") for i, term in enumerate(blocklist)]
    found = rows.groupBy("conv_id").agg(*flags)
    matched = F.filter(F.array(*[F.when(F.col(f"_{i}") == 1, F.lit(t)) for i, t in enumerate(blocklist)]), lambda x: x.isNotNull())
    return found.select("conv_id", F.array_join(matched, "|").alias("matched"), (F.size(matched).cast("double") / F.lit(float(len(blocklist)))).alias("score"))


def language_samples(turns: DataFrame, chars: int = 2000) -> DataFrame:
    """(conv_id, sample): the first ``chars`` characters of each conversation's turns, joined by blanks and lowered."""
    before = Window.partitionBy("conv_id").orderBy("turn_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("used", F.coalesce(F.sum(F.length("raw_text") + 1).over(before), F.lit(0))).where(F.col("used") < chars)
    parts = F.array_sort(F.collect_list(F.struct("turn_number", F.left("raw_text", F.lit(chars)).alias("t"))))
    return rows.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.lower(F.trim(F.left(F.array_join(F.col("p")["t"], " "), F.lit(chars)))).alias("sample"))


def detect_language(turns: DataFrame, profiles: DataFrame, supported: tuple[str, ...] = ("en",), fallback: str = "en", min_chars: int = 20, least: float = 0.55) -> DataFrame:
    """(conv_id, language, confidence, supported) by trigram profiles (lang, trigram, freq).

    The score mixes the root of the cosine with the share of the sample's trigrams that the profile has;
    ties go to the first language by name. Samples under ``min_chars`` get the fallback with 0.5, those
    that share no trigram with any profile get an empty language with 0.
    """
    samples = language_samples(turns)
    rows = samples.where(F.length("sample") >= min_chars).select("conv_id", F.explode(T.trigrams(F.col("sample"))).alias("trigram")).groupBy("conv_id", "trigram").agg(F.count("*").cast("double").alias("n"))
    sizes = rows.groupBy("conv_id").agg(F.sum("n").alias("total"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("own"))
    norms = profiles.groupBy("lang").agg(F.sqrt(F.sum(F.col("freq") * F.col("freq"))).alias("norm"))
    met = rows.join(profiles, "trigram").groupBy("conv_id", "lang").agg(F.sum(F.col("n") * F.col("freq")).alias("dot"), F.sum("n").alias("n"))
    scored = met.join(sizes, "conv_id").join(norms, "lang")
    score = F.least(F.lit(0.4) * F.sqrt(F.col("dot") / (F.col("own") * F.col("norm"))) + F.lit(0.6) * F.col("n") / F.col("total"), F.lit(1.0))
    order = Window.partitionBy("conv_id").orderBy(F.round("score", 9).desc(), "lang")
    best = scored.select("conv_id", "lang", score.alias("score")).withColumn("k", F.row_number().over(order)).where("k = 1")
    short = F.length("sample") < min_chars
    known = F.coalesce("lang", F.lit(""))
    ok = F.when(short, F.lit(fallback).isin(*supported)).otherwise(known.isin(*supported) & (F.round(F.coalesce("score", F.lit(0.0)), 9) >= least))
    return samples.join(best, "conv_id", "left").select("conv_id", F.when(short, fallback).otherwise(known).alias("language"), F.when(short, 0.5).otherwise(F.coalesce("score", F.lit(0.0))).alias("confidence"), ok.alias("supported"))


def gain(
    turns: DataFrame, formal: Iterable[str] = (*L.FORMAL, *L.CLASSICAL_FORMAL), informal: Iterable[str] = L.INFORMAL, contractions: Iterable[str] = L.CONTRACTIONS, rhetorical: Iterable[str] = L.RHETORICAL,
    urgent: Iterable[str] = L.URGENT, stakes: Iterable[str] = L.STAKES, recent: int = 5, phasic: float = 0.6,
) -> DataFrame:
    """(conv_id, urgency, complexity, formality, mode), from phrases and sizes of a conversation's turns; urgency reads the ``recent`` last turns."""
    rows = low(turns)
    words = T.word_count(F.col("raw_text"))
    text = F.col("low")
    as_int = lambda flag: flag.cast("int")
    for_ = T.phrase_hits(text, formal) + as_int(words > 25) + as_int(words > 50) + as_int(F.regexp_count("raw_text", F.lit(";")) >= 2) + as_int(T.phrase_any(text, rhetorical))
    against = T.phrase_hits(text, informal) + as_int((words < 8) & (words > 0)) + as_int(T.phrase_any(text, contractions)) + as_int(F.col("raw_text").contains("!"))
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn_number")))
    listed = lambda tokens, these: F.size(F.filter(tokens, lambda t: F.array_contains(T.listed(these), t)))
    pressing = T.once(T.tokenize(text), lambda t: listed(t, urgent) + 2 * listed(t, stakes))
    per_turn = rows.select("conv_id", "speaker", words.alias("words"), for_.alias("formal"), against.alias("informal"), F.when(back <= recent, pressing).otherwise(0).alias("pressing"))
    sums = per_turn.groupBy("conv_id").agg(
        F.count("*").cast("double").alias("turns"), F.size(F.collect_set("speaker")).cast("double").alias("speakers"), F.avg("words").alias("words"),
        F.sum("formal").cast("double").alias("formal"), F.sum("informal").cast("double").alias("informal"), F.sum("pressing").cast("double").alias("pressing"),
    )
    urgency = T.clamp(F.lit(0.15) + F.col("pressing") / F.lit(10.0))
    complexity = T.clamp(F.col("turns") / F.lit(10.0) * F.lit(0.4) + F.col("speakers") / F.lit(5.0) * F.lit(0.2) + F.col("words") / F.lit(200.0) * F.lit(0.4))
    total = F.col("formal") + F.col("informal")
    formality = F.when(total == 0, F.lit(0.5)).otherwise(F.col("formal") / total)
    found = sums.select("conv_id", urgency.alias("urgency"), complexity.alias("complexity"), formality.alias("formality"))
    return found.withColumn("mode", F.when(F.col("urgency") > phasic, "PHASIC").otherwise("TONIC"))


def gain_fuzzy(gains: DataFrame, rules: FuzzySet = URGENCY, phasic: float = 0.6) -> DataFrame:
    """The same with urgency replaced by its fuzzy score with complexity and formality, where a rule fires."""
    score = F.coalesce(fuzzy_score({c: F.col(c) for c in ("urgency", "complexity", "formality")}, rules), F.col("urgency"))
    return gains.withColumn("urgency", score).withColumn("mode", F.when(F.round("urgency", 9) > phasic, "PHASIC").otherwise("TONIC"))


def gain_enriched(gains: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Formality mixed with an enrichment's (conv_id, enriched) where that is positive."""
    rows = gains.join(enrichment, "conv_id", "left")
    mixed = F.when(F.col("enriched") > 0, F.lit(0.7) * F.col("enriched") + F.lit(0.3) * F.col("formality")).otherwise(F.col("formality"))
    return rows.withColumn("formality", mixed).drop("enriched")


def modulate(gains: DataFrame) -> DataFrame:
    """(conv_id, offset): by how much thresholds move, at most 0.15 either way."""
    raw = F.lit(-0.6) * F.col("urgency") + F.lit(0.3) * (1 - F.col("formality")) - F.lit(0.1) * F.col("complexity")
    return gains.select("conv_id", T.clamp(raw, -0.15, 0.15).alias("offset"))


def apply_offset(offsets: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(conv_id, detector, threshold): thresholds as columns of the conversation."""
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("detector"), F.lit(float(v)).alias("base")) for k, v in sorted(thresholds.items())]))
    return offsets.select("conv_id", "offset", table.alias("t")).select("conv_id", F.col("t.detector").alias("detector"), (F.col("t.base") * (1 + F.col("offset"))).alias("threshold"))


#: The parameters that gain moves, by detector. Drift is left out.
MODULATED = {"anchoring": "threshold", "anchoring_context": "threshold", "sunk_cost": "least", "contradiction": "overlap", "confidence_miscalibration": "least", "silent_revision": "least"}


def own_thresholds(offsets: DataFrame | None, domains: DataFrame | None, bases: dict[str, float]) -> DataFrame | None:
    """(conv_id, detector, parameter, value) as ``detect`` takes them: ``bases`` (detector -> threshold before gain) of MODULATED moved by ``offsets``, and what
    ``domains`` (conv_id, domain, confidence) say for sure. None where there is neither."""
    parts = []
    if offsets is not None:
        named = F.create_map(*[F.lit(x) for pair in MODULATED.items() for x in pair])
        moved = apply_offset(offsets, {k: v for k, v in bases.items() if k in MODULATED})
        parts.append(moved.select("conv_id", "detector", named[F.col("detector")].alias("parameter"), F.col("threshold").alias("value")))
    if domains is not None:
        own = domain_thresholds(domains).where("variant = 'unfiltered' OR NOT numeric_anchoring")
        classical = F.col("variant") == "unfiltered"
        row = lambda d, p, v: F.struct(F.lit(d).alias("detector"), F.lit(p).alias("parameter"), v.cast("double").alias("value"))
        rows = F.array(
            row("scope_drift", "threshold", F.col("drift")), row("scope_drift", "sustained", F.col("sustained")), row("conceptual_anchoring", "least", F.when(classical, F.col("anchor"))),
            row("confidence_miscalibration", "min_words", F.when(classical, 8).otherwise(3)),
        )
        parts.append(own.select("conv_id", F.explode(rows).alias("r")).select("conv_id", "r.*").where("value is not null"))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def routed_detectors(turns: DataFrame, objectives: DataFrame | None = None, domains: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """(conv_id, detector): what is to run, before anything is detected. Conversations that ``domains`` hold for classical or code
    review for sure have no numeric anchoring; ``levels`` of activation leave out more."""
    rows = route(turns, objectives).select("conv_id", "detector")
    if domains is not None:
        skipped = domain_thresholds(domains).where("NOT numeric_anchoring").select("conv_id", F.explode(F.array(F.lit("anchoring"), F.lit("anchoring_context"))).alias("detector"))
        rows = rows.join(skipped, ["conv_id", "detector"], "left_anti")
    return rows if levels is None else activated(rows, levels)


def activation_level(gains: DataFrame) -> DataFrame:
    """(conv_id, score, level, label): the hint mixed of all three signals; level 3 (all detectors), 2 (without the costly two) or 1 (only
    those that always run) by urgency."""
    score = T.clamp(F.lit(0.4) * F.col("urgency") + F.lit(0.4) * F.col("complexity") + F.lit(0.2) * F.col("formality"))
    level = F.when(F.round("urgency", 9) >= 0.65, 3).when(F.round("urgency", 9) >= 0.35, 2).otherwise(1)
    return gains.select("conv_id", score.alias("score"), level.alias("level"), T.hundredths(score).alias("label"))


#: Detectors that always run, and those that a middling urgency leaves out.
ALWAYS, COSTLY = ("scope_drift", "contradiction"), ("inherited_position", "conceptual_anchoring")


def activated(rows: DataFrame, levels: DataFrame, column: str = "detector") -> DataFrame:
    """The rows (conv_id, detector, ..) whose detector runs at its conversation's activation level."""
    runs = F.col(column).isin(*ALWAYS) | (F.col("level") == 3) | ((F.col("level") == 2) & ~F.col(column).isin(*COSTLY))
    return rows.join(levels.select("conv_id", "level"), "conv_id").where(runs).drop("level")


def classical_text(turns: DataFrame, markers: Iterable[str] = L.CLASSICAL_FORMAL, more: Iterable[str] = (), least: int = 2) -> DataFrame:
    """(conv_id, n_markers, classical): ``least`` or more distinct markers over all turns; ``more`` are those of a finding type."""
    known = T.listed(dict.fromkeys((*markers, *more)))
    met = turns.select("conv_id", T.once(F.lower("raw_text"), lambda t: F.filter(known, lambda p: F.contains(t, p))).alias("m"))
    found = met.groupBy("conv_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("m")))).alias("n_markers"))
    return found.withColumn("classical", F.col("n_markers") >= least)


#: Detector -> (its condition on a conversation's counts, why).
ROUTES = {
    "anchoring_context": ("numbers >= 2 AND number_turns >= 2", "amounts in several turns"),
    "confidence_miscalibration": ("turns >= 1", "there are turns"),
    "contradiction": ("turns >= 2", "turns can be compared"),
    "silent_revision": ("turns >= 2 AND decisions > 0", "decisions are announced"),
    "scope_drift": ("objectives > 0 AND turns >= 3", "an objective and turns enough to leave it"),
    "sunk_cost": ("cost > 0", "costs are spoken of"),
    "conceptual_anchoring": ("turns >= 4 AND early_declarative > 0", "an early claim"),
    "inherited_position": ("turns >= 4 AND authority > 0", "authorities are cited"),
    "evidence_asymmetry": ("turns >= 4 AND assistant >= 2", "several assistant turns"),
    "sustained_conviction": ("assistant >= 1", "an assistant turn"),
    "sustained_conviction_wide": ("assistant >= 1", "an assistant turn"),
    "underevidenced_claims": ("assistant >= 2", "several assistant turns"),
    "negative_claim_confidence": ("assistant >= 1", "an assistant turn"),
    "assumption_surfacer": ("assistant >= 1", "an assistant turn"),
    "circular_reasoning": ("assistant >= 2", "several assistant turns"),
    "evidence_quality": ("assistant >= 1", "an assistant turn"),
    "status_quo_bias": ("assistant >= 1", "an assistant turn"),
    "entity_coherence": ("assistant >= 3", "three assistant turns"),
}


def route(turns: DataFrame, objectives: DataFrame | None = None, cost: Iterable[str] = L.ROUTE_COST, decisions: Iterable[str] = L.ROUTE_DECISION, authority: Iterable[str] = L.ROUTE_AUTHORITY) -> DataFrame:
    """(conv_id, detector, reason): detectors that have something to look at, from one pass of counts; ``objectives`` has (conv_id, objective)."""
    text = F.col("plain")
    counts = enrich(turns, "plain", "numbers").withColumn("n", F.size("numbers")).groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.lower("speaker") == "assistant").alias("assistant"), F.sum("n").alias("numbers"), F.count_if(F.col("n") > 0).alias("number_turns"),
        F.count_if(T.phrase_any(text, cost)).alias("cost"), F.count_if(T.phrase_any(text, decisions)).alias("decisions"), F.count_if(T.phrase_any(text, authority)).alias("authority"),
        F.count_if((F.col("turn_number") <= 3) & T.strong_declarative(F.col("raw_text"))).alias("early_declarative"),
    )
    if objectives is None:
        counts = counts.withColumn("objectives", F.lit(0))
    else:
        told = objectives.where("objective <> ''").groupBy("conv_id").agg(F.count("*").alias("objectives"))
        counts = counts.join(told, "conv_id", "left").withColumn("objectives", F.coalesce("objectives", F.lit(0)))
    flags = F.array(*[F.when(F.expr(rule), F.struct(F.lit(name).alias("detector"), F.lit(why).alias("reason"))) for name, (rule, why) in ROUTES.items()])
    return counts.select("conv_id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("r")).select("conv_id", "r.*")


def domain_thresholds(domains: DataFrame) -> DataFrame:
    """(conv_id, drift, sustained, anchor, numeric_anchoring) from (conv_id, domain, confidence)."""
    sure = F.col("confidence") > 0.6
    classical, review = sure & (F.col("domain") == "classical"), sure & (F.col("domain") == "code-review")
    return domains.select(
        "conv_id", F.when(classical, 0.70).when(review, 0.85).otherwise(0.79).alias("drift"), F.when(classical, 4).when(review, 3).otherwise(8).alias("sustained"),
        F.when(classical, 0.35).otherwise(0.15).alias("anchor"), (~(classical | review)).alias("numeric_anchoring"),
        F.when(classical, "unfiltered").otherwise("inhibited").alias("variant"),
    )


def orchestration_mode(turns: DataFrame, drift: float = 0.79, more_than: int = 8, mentions: int = 3, words: Iterable[str] = L.PROJECT, names: Iterable[str] = ()) -> DataFrame:
    """(conv_id, orchestrating, drift): conversations of more than ``more_than`` turns that mention projects (``words``, or capital ``names``) in
    several ways may drift a fifth more."""
    told = T.phrase_any(F.lower("raw_text"), words).cast("int")
    if names:
        told = told + T.phrase_any(F.col("raw_text"), names).cast("int")
    found = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(told).alias("mentions"))
    on = (F.col("turns") > more_than) & (F.col("mentions") >= mentions)
    return found.select("conv_id", on.alias("orchestrating"), F.when(on, F.lit(min(drift * 1.2, 0.98))).otherwise(F.lit(drift)).alias("drift"))
