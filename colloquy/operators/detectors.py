"""Detectors: turns -> at most one finding per conversation and detector.

A finding is (conv_id, finding_type, severity 1-4, confidence, detector_name, relevant_turns, explanation, signal,
strength); ``signal`` and ``strength`` are the numbers behind it that later steps read (a relative shift and the anchor's
value, an overlap and the kind's strength, a calibration error, or a gap in turns). What "first" means is always spelt out
as a sort key, so results don't depend on row order.

Most detectors are sums over a conversation's turns. Each of them says what it reads of one turn, how that is summed up, and
what finding the sums make; ``run`` puts any number of them into one projection and one aggregation.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy.functions import text as T
from colloquy.operators.context import ROUTES, enrich, low
from colloquy.plans.settle import grown, written

FIELDS = "finding_type string, severity int, confidence double, detector_name string, relevant_turns array<int>, explanation string, signal double, strength double"
FINDING = ["conv_id", *[f.split()[0] for f in FIELDS.split(", ")]]
INFO, CAUTION, WARNING, CRITICAL = 1, 2, 3, 4
EXPLANATIONS = {
    "anchoring": "An early amount stays close to a later estimate, which may be anchored on it",
    "anchoring_context": "An early amount stays close to a later estimate in a similar context, which may be anchored on it",
    "sunk_cost": "Costs already borne are followed by a call to continue, rather than by a look at what lies ahead",
    "sunk_cost_proximity": "Costs already borne are closely followed by a call to continue, rather than by a look ahead",
    "contradiction": "One speaker says two things in different turns that cannot both hold",
    "scope_drift": "The words of a run of turns have moved away from those of the stated objective",
    "scope_drift_kl": "The word frequencies of a run of turns diverge from those of the stated objective",
    "scope_drift_centroid": "A run of turns lies far from the moving centre of the turns on topic",
    "confidence_miscalibration": "A turn claims more certainty, or less, than the evidence it gives would warrant",
    "silent_revision": "A decision on the same topic has changed later on, and no reason for that is given",
    "conceptual_anchoring": "Most later turns keep circling a claim that was made early and never conceded",
    "inherited_position": "Positions are held on the word of authorities, mostly without reasons of their own",
    "evidence_asymmetry": "Turns that argue against are far better grounded than those that argue for",
    "sustained_conviction": "Praise or ever grander designs are kept up over several assistant turns in a row",
    "sustained_conviction_wide": "Praise or ever grander designs are kept up over a wide window of assistant turns",
    "underevidenced_claims": "Assistant turns make positive claims, and hardly any turn gives evidence for one",
    "negative_claim_confidence": "Counter-evidence is dismissed, or complexity added, in very confident sentences",
    "assumption_surfacer": "Confident claims far outnumber stated premises: a chain of unstated assumptions",
    "circular_reasoning": "In several turns a claim is given as its own reason, in nearly the same words",
    "evidence_quality": "Hearsay and impressions carry the claims, with little measured evidence beside them",
    "status_quo_bias": "What exists is taken as good, and only change has to justify itself in these turns",
    "entity_coherence": "The same things are described with opposite properties in different assistant turns",
}


def finding(kind: str | Column, severity: Column | int, confidence: Column | float, name: str, turns: Column | None = None, signal: Column | None = None, strength: Column | None = None) -> Column:
    parts = [F.lit(kind) if isinstance(kind, str) else kind, severity if isinstance(severity, Column) else F.lit(severity), confidence if isinstance(confidence, Column) else F.lit(confidence)]
    parts += [F.lit(name), turns if turns is not None else F.array(), F.lit(EXPLANATIONS.get(name, "")), *[F.lit(None) if x is None else x for x in (signal, strength)]]
    return F.struct(*[x.cast(f.split()[1]).alias(f.split()[0]) for x, f in zip(parts, FIELDS.split(", "))])


def of_rows(rows: DataFrame, found: Column) -> DataFrame:
    """A finding of every row."""
    return rows.select("conv_id", found.alias("f")).where("f is not null").select("conv_id", "f.*")


def first_by(rows: DataFrame, *order: Column) -> DataFrame:
    """One row per conversation, the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).where("_n = 1").drop("_n")


def steps(x: Column, *levels: tuple[float, int], otherwise: int) -> Column:
    out = None
    for least, level in levels:
        out = F.when(x >= least, level) if out is None else out.when(x >= least, level)
    return out.otherwise(otherwise)


def above(x: Column, t: float) -> Column:
    """Confidence of 0.5 at a threshold, growing to 1."""
    return F.least(F.lit(0.5) + F.lit(0.5) * (x - t) / (1 - t), F.lit(1.0))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


@dataclass(frozen=True)
class Signal:
    """What a detector reads of a turn, by name; how each is summed up, by name; and the finding of the sums, or null. ``shared`` has, by column, what
    several detectors may read of a turn; it is worked out once for all of them."""

    turn: dict[str, Column]
    sums: dict[str, Column]
    found: Column
    shared: Mapping[str, Column] = field(default_factory=dict)


SIGNALS: dict[str, Callable[..., Signal]] = {}
#: The column with those of a turn's ``phrases`` that stand in ``plain``, with the quotes as they are there.
PLAIN = "_plain_phrases"
_spotted = frozenset(L.SPOTTED)


def _plain_phrases() -> Column:
    # Only phrases with quotes can be in the text with plain quotes and not in the text as it is.
    return F.filter("phrases", lambda p: ~p.rlike("['\"]") | F.contains(F.col("plain"), p))


def met(column: str, phrases: Iterable[str]) -> Column | None:
    """What ``phrases_in`` and its kin read in place of the text in ``column``: the phrases spotted there, or None for a list that isn't spotted, or has a phrase twice."""
    phrases = tuple(phrases)
    return F.col(PLAIN if column == "plain" else "phrases") if phrases and _spotted.issuperset(phrases) and len(set(phrases)) == len(phrases) else None


def any_of(column: str, phrases: Iterable[str]) -> Column:
    return T.phrase_any(F.col(column), phrases, met(column, dict.fromkeys(phrases)))


def hits_of(column: str, phrases: Iterable[str]) -> Column:
    return T.phrase_hits(F.col(column), phrases, met(column, phrases))


def signal(make: Callable[..., Signal]) -> Callable[..., DataFrame]:
    """Makes a detector of a function from names (``c(key)`` is the column of a key) and parameters to a Signal."""
    SIGNALS[make.__name__] = make

    @wraps(make)
    def detector(turns: DataFrame, **params) -> DataFrame:
        return run(turns, {make.__name__: params})

    return detector


#: Parameters that may differ from conversation to conversation, by detector; the first is the detector's threshold.
SETTABLE = {
    "anchoring": ("threshold",), "anchoring_context": ("threshold",), "sunk_cost": ("least",), "sunk_cost_proximity": ("least",), "contradiction": ("overlap",),
    "confidence_miscalibration": ("least", "min_words"), "silent_revision": ("least",), "scope_drift": ("threshold", "sustained"), "conceptual_anchoring": ("least",),
}
#: The column that holds a conversation's own settings, beside its turns and its sums.
OWN = "_own"


def settings(names: Iterable[str], thresholds: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """(conv_id, _own): a row for each conversation of either table; the struct has a value for every parameter that ``thresholds`` (conv_id, detector,
    parameter, value) may set, null where it doesn't, and with ``routes`` (conv_id, detector) whether each detector of ROUTES runs; others always do."""
    parts = []
    if thresholds is not None:
        of = lambda n, p: F.max(F.when((F.col("detector") == n) & (F.col("parameter") == p), F.col("value"))).alias(f"{n}_{p}")
        keys = [(n, p) for n in names for p in SETTABLE.get(n, ())]
        parts.append(thresholds.groupBy("conv_id").agg(F.struct(*[of(n, p) for n, p in keys]).alias("_set")))
    if routes is not None:
        flags = [F.coalesce(F.bool_or(F.col("detector") == n), F.lit(False)).alias(f"run_{n}") for n in names if n in ROUTES]
        parts.append(routes.groupBy("conv_id").agg(F.struct(*flags).alias("_run")))
    rows = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "conv_id", "full_outer")
    fields = [F.col(f"{c}.*") for c in ("_set", "_run") if c in rows.columns]
    return rows.select("conv_id", *fields).select("conv_id", F.struct(*rows.select(*fields).columns).alias(OWN))


def _params(name: str, params: dict, own: Iterable[str]) -> dict:
    """Parameters, with a conversation's own value in place of those it may set."""
    base = {k: v.default for k, v in inspect.signature(SIGNALS.get(name) or REGISTRY.get(name) or scope_drift).parameters.items()} | params
    return params | {p: F.coalesce(F.col(f"{OWN}.{name}_{p}"), F.lit(base[p])) for p in SETTABLE.get(name, ()) if f"{name}_{p}" in own}


def _runs_in(name: str, own: Iterable[str]) -> Column | None:
    """Whether the detector runs for the conversation; None where it always does."""
    return F.coalesce(F.col(f"{OWN}.run_{name}"), F.lit(False)) if f"run_{name}" in own else None


def _own_fields(turns: DataFrame) -> list[str]:
    return turns.schema[OWN].dataType.fieldNames() if OWN in turns.columns else []


_made: dict[tuple, Signal] = {}


def _signal(name: str, params: dict, own: list[str]) -> Signal:
    """The detector's columns. They hang on no table, and building them takes the driver thousands of calls to the JVM, so those for plain
    parameters are kept while the JVM lives."""
    key = (name, repr(sorted(params.items())), tuple(f for f in own if f.startswith(name)), id(SparkContext._gateway))
    if any(isinstance(v, Column) for v in params.values()):
        return SIGNALS[name](lambda k: F.col(f"_{name}_{k}"), **_params(name, params, own))
    if key not in _made:
        _made[key] = SIGNALS[name](lambda k: F.col(f"_{name}_{k}"), **_params(name, params, own))
    return _made[key]


def run(turns: DataFrame, chosen: dict[str, dict]) -> DataFrame:
    """Findings of the chosen signals (name -> parameters), from one pass over the turns.

    Turns may carry ``settings``: a detector then reads a turn only where it runs for the conversation, and takes the
    conversation's own thresholds."""
    own = _own_fields(turns)
    made = {i: _signal(name, params, own) for i, (name, params) in enumerate(chosen.items())}
    only = {i: _runs_in(name, own) for i, name in enumerate(chosen)}
    # Signals name their columns by detector.
    at = dict(enumerate(chosen))
    guarded = lambda i, x: x if only[i] is None else F.when(only[i], x)
    kept = [OWN] if own else []
    rows = enrich(turns).withColumn(PLAIN, _plain_phrases()).withColumns({name: x for s in made.values() for name, x in s.shared.items()})
    rows = rows.select("conv_id", "turn_number", *kept, *[guarded(i, x).alias(f"_{at[i]}_{k}") for i, s in made.items() for k, x in s.turn.items()])
    sums = rows.groupBy("conv_id").agg(*[F.any_value(c).alias(c) for c in kept], *[x.alias(f"_{at[i]}_{k}") for i, s in made.items() for k, x in s.sums.items()])
    found = F.filter(F.array(*[guarded(i, s.found) for i, s in made.items()]), lambda f: f.isNotNull())
    return sums.select("conv_id", F.explode(found).alias("f")).select("conv_id", "f.*")


def turns_with(flag: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(flag, F.col("turn_number"))))


def in_order(x: Column) -> Column:
    """All values of a conversation, sorted; structs begin with the turn."""
    return F.array_sort(F.collect_list(x))


def _anchor(numbers: Column, threshold: float) -> Column:
    """Later amounts close to a conversation's first one: array of (turn, position, shift, context), with the first."""
    flat = F.flatten(F.transform(numbers, lambda n: F.transform(n["t"], lambda x: F.struct(n["turn"].alias("turn"), x["value"].alias("value"), x["position"].alias("position"), x["context"].alias("context")))))

    def of(all_: Column) -> Column:
        first = F.get(all_, F.lit(0))
        shifted = F.transform(all_, lambda x: F.struct(x["turn"].alias("turn"), x["position"].alias("position"), (F.abs(x["value"] - first["value"]) / F.greatest(F.abs(first["value"]), F.lit(1.0))).alias("shift"), x["context"].alias("context")))
        return F.struct(first.alias("first"), F.filter(shifted, lambda x: (x["turn"] > first["turn"]) & (x["shift"] < threshold)).alias("close"))

    return T.once(flat, of)


def _numbers() -> Column:
    return T.once(F.col("numbers"), lambda t: F.when(F.size(t) > 0, F.struct(F.col("turn_number").alias("turn"), t.alias("t"))))


def _anchor_severity(share: Column) -> Column:
    return F.when(share < 0.3, WARNING).when(share < 0.7, CAUTION).otherwise(INFO)


@signal
def anchoring(c, threshold: float = 0.15) -> Signal:
    """The first later amount close to a conversation's first one."""

    def of(a: Column) -> Column:
        x = F.get(a["close"], F.lit(0))
        share = x["shift"] / threshold
        return F.when(x.isNotNull(), finding("ANCHORING_BIAS", _anchor_severity(share), 1 - share, "anchoring", F.array(a["first"]["turn"], x["turn"]), x["shift"], a["first"]["value"]))

    return Signal({"n": _numbers()}, {"n": in_order(c("n"))}, T.once(_anchor(c("n"), threshold), of))


@signal
def anchoring_context(c, threshold: float = 0.15, least: float = 0.2) -> Signal:
    """As above, for amounts in similar contexts; the surest pair."""

    def scored(a: Column) -> Column:
        own = T.keywords(a["first"]["context"], stemmed=False)

        def score(x: Column, kept: Column) -> Column:
            sim = T.jaccard(T.keywords(x["context"], stemmed=False), kept, 1.0)
            return T.once(sim, lambda y: F.struct((-F.round((1 - x["shift"] / threshold) * (F.lit(0.5) + F.lit(0.5) * y), 9)).alias("c"), x["turn"].alias("turn"), x["position"].alias("position"), x["shift"].alias("shift"), y.alias("sim"), a["first"].alias("first")))

        return F.array_min(F.filter(T.once(own, lambda kept: F.transform(a["close"], lambda x: score(x, kept))), lambda x: x["sim"] >= least))

    def of(x: Column) -> Column:
        sure = (1 - x["shift"] / threshold) * (F.lit(0.5) + F.lit(0.5) * x["sim"])
        return F.when(x.isNotNull(), finding("ANCHORING_BIAS", _anchor_severity(x["shift"] / threshold), sure, "anchoring_context", F.array(x["first"]["turn"], x["turn"]), x["shift"], x["first"]["value"]))

    return Signal({"n": _numbers()}, {"n": in_order(c("n"))}, T.once(T.once(_anchor(c("n"), threshold), scored), of))


def _cost_turns(costs: Iterable[str], continuations: Iterable[str]) -> dict[str, Column]:
    cost = T.once(T.phrase_first(F.col("low"), costs, met("low", costs)), lambda p: F.when(p.isNotNull(), F.struct(F.col("turn_number").alias("at"), p.alias("phrase"))))
    return {"cost": cost, "on": F.when(any_of("low", continuations), F.col("turn_number"))}


def _cost_pairs(costs: Column, ons: Column, strong: Iterable[str]) -> Column:
    """(at, on, gap, base) of every cost with its continuation in the same turn, if any, and the first later one. The longer the gap,
    the less a later pair counts, so no other pair of the cost can be surer, or be the first that is sure enough."""

    def pair(k: Column, o: Column) -> Column:
        base = F.lit(0.5) + F.when(o > k["at"], 0.2).otherwise(0.0) + F.when(o - k["at"] <= 2, 0.15).otherwise(0.0) + F.when(k["phrase"].isin(*strong), 0.1).otherwise(0.0)
        return F.struct(k["at"].alias("at"), o.alias("on"), (o - k["at"]).alias("gap"), F.least(base, F.lit(1.0)).alias("base"))

    def nearest(k: Column) -> Column:
        later = F.array_min(F.filter(ons, lambda o: o > k["at"]))
        return F.filter(F.array(F.when(F.array_contains(ons, k["at"]), k["at"]), later), lambda o: o.isNotNull())

    return F.flatten(F.transform(costs, lambda k: F.transform(nearest(k), lambda o: pair(k, o))))


def _cost_finding(x: Column, sure: Column, name: str) -> Column:
    return F.when(x.isNotNull(), finding("SUNK_COST_FALLACY", steps(sure, (0.8, WARNING), (0.6, CAUTION), otherwise=INFO), sure, name, F.array(x["at"], x["on"]), x["gap"].cast("double")))


@signal
def sunk_cost(c, least: float = 0.5, costs: Iterable[str] = L.COST, continuations: Iterable[str] = L.CONTINUATION, strong: Iterable[str] = L.STRONG_COST) -> Signal:
    first = F.get(F.filter(_cost_pairs(c("cost"), c("on"), strong), lambda x: x["base"] >= least), F.lit(0))
    return Signal(_cost_turns(costs, continuations), {"cost": in_order(c("cost")), "on": in_order(c("on"))}, T.once(first, lambda x: _cost_finding(x, x["base"], "sunk_cost")))


@signal
def sunk_cost_proximity(c, decay: float = 0.3, least: float = 0.3, costs: Iterable[str] = L.COST, continuations: Iterable[str] = (*L.CONTINUATION, *L.MORE_CONTINUATION), strong: Iterable[str] = L.STRONG_COST) -> Signal:
    """The surest pair, with confidence falling with the gap."""
    near = F.transform(_cost_pairs(c("cost"), c("on"), strong), lambda x: F.struct((-F.round(x["base"] / (1 + F.lit(decay) * x["gap"]), 9)).alias("c"), x["at"].alias("at"), x["on"].alias("on"), x["gap"].alias("gap"), x["base"].alias("base")))
    best = F.array_min(F.filter(near, lambda x: -x["c"] >= least))
    return Signal(_cost_turns(costs, continuations), {"cost": in_order(c("cost")), "on": in_order(c("on"))}, T.once(best, lambda x: _cost_finding(x, x["base"] / (1 + F.lit(decay) * x["gap"]), "sunk_cost_proximity")))


@signal
def confidence_miscalibration(c, least: float = 0.5, min_words: int = 5, levels=L.CONFIDENCE, evidence: Iterable[str] = L.EVIDENCE) -> Signal:
    """The turn whose confidence and evidence differ most, the earliest of equals. The surest level needs ``min_words`` words."""
    text = F.col("low")
    level = F.coalesce(*[F.when(any_of("low", phrases) & ((T.word_count(text) >= min_words) if rank == 3 else F.lit(True)), rank) for rank, phrases in levels])
    marks = hits_of("low", evidence) + T.bracket_citations(text)
    worst = T.once(F.struct(level.alias("c"), F.when(marks >= 2, 3).when(marks == 1, 2).otherwise(1).alias("e")), lambda x: F.when(x["c"].isNotNull(), F.struct((-F.abs(x["c"] - x["e"])).alias("off"), F.col("turn_number").alias("turn"), x["c"].alias("c"), x["e"].alias("e"))))
    x = c("worst")
    ece = -x["off"].cast("double") / F.lit(3.0)
    severity = F.when((x["c"] == 3) & (x["e"] == 1), CRITICAL).when((x["c"] == 3) & (x["e"] == 2), WARNING).when((x["c"] == 2) & (x["e"] == 1), CAUTION).otherwise(INFO)
    return Signal({"worst": worst}, {"worst": F.min(c("worst"))}, F.when(ece >= least, finding("CONFIDENCE_MISCALIBRATION", severity, ece, "confidence_miscalibration", F.array(x["turn"]), ece)))


@signal
def silent_revision(c, least: float = 0.5, topic_words: int = 8, markers: Iterable[str] = L.DECISION, reasons: Iterable[str] = L.RATIONALE, weak: Iterable[str] = L.WEAK_RATIONALE, stop: Iterable[str] = L.STOP_TOPIC) -> Signal:
    """A later decision on the same topic, in other words and without a reason."""
    text = F.col("low")
    after = lambda m: F.slice(T.words(F.substr(text, F.position(m, text) + F.length(m), F.length(text))), 1, topic_words)
    marker = F.get(F.filter(T.phrases_in(text, markers, met("low", markers)), lambda m: F.size(after(m)) > 0), F.lit(0))
    content = lambda w: F.filter(F.transform(w, lambda x: F.rtrim(x, F.lit(".,;:!?"))), lambda x: (F.length(x) > 1) & ~F.array_contains(T.listed(stop), x))
    topic = T.once(T.once(marker, lambda m: F.when(m.isNotNull(), after(m))), lambda w: F.when(w.isNotNull(), F.struct(F.col("turn_number").alias("turn"), F.array_join(w, " ").alias("topic"), F.array_distinct(content(w)).alias("words"), any_of("low", reasons).alias("reasoned"), any_of("low", weak).alias("weak"))))

    def later(a: Column, all_: Column) -> Column:
        """The first decision that revises ``a``, or null."""
        same = F.filter(all_, lambda b: (b["turn"] > a["turn"]) & ~b["reasoned"] & (b["topic"] != a["topic"]) & (T.jaccard(a["words"], b["words"]) >= least))
        return T.once(F.get(same, F.lit(0)), lambda b: F.when(b.isNotNull(), F.struct(a["turn"].alias("a"), b["turn"].alias("b"), b["weak"].alias("weak"))))

    first = F.get(F.filter(F.transform(c("d"), lambda a: later(a, c("d"))), lambda x: x.isNotNull()), F.lit(0))
    found = T.once(first, lambda x: F.when(x.isNotNull(), finding("SILENT_REVISION", F.when(x["weak"], CAUTION).otherwise(WARNING), F.when(x["weak"], 0.6).otherwise(0.8), "silent_revision", F.array(x["a"], x["b"]))))
    return Signal({"d": topic}, {"d": in_order(c("d"))}, found)


@signal
def inherited_position(c, least: int = 3, share: float = 0.7, min_words: int = 10, phrases: Iterable[str] = L.AUTHORITY, verbs: Iterable[str] = L.CITATION_VERBS, merit: Iterable[str] = L.MERIT, bare: Iterable[str] = L.NO_MERIT) -> Signal:
    # Reasons are looked for in turns that cite.
    cites = F.when(T.authority_citation(F.col("raw_text"), phrases, verbs, met=met("low", (*phrases, *L.HELD_THAT))).isNotNull(), F.struct(T.independent_justification(F.col("raw_text"), min_words, merit, bare).alias("reasoned")))
    cited = c("cites").isNotNull()
    sums = {"n": F.count_if(cited), "bare": F.count_if(cited & ~c("cites")["reasoned"]), "t": turns_with(cited)}
    unjustified = ratio(c("bare"), c("n"))
    sure = F.lit(0.4) * F.least(c("n") / F.lit(10.0), F.lit(1.0)) + F.lit(0.6) * unjustified
    found = finding("INHERITED_POSITION", steps(F.round(sure, 9), (0.75, WARNING), (0.55, CAUTION), otherwise=INFO), sure, "inherited_position", c("t"))
    return Signal({"cites": cites}, sums, F.when((c("n") >= least) & (unjustified >= share), found))


@signal
def evidence_asymmetry(c, threshold: float = 1.5, min_turns: int = 2, positive: Iterable[str] = L.POSITIVE_TURN, negative: Iterable[str] = L.NEGATIVE_TURN, links: Iterable[str] = L.EVIDENCE_LINKS) -> Signal:
    """Assistant turns that argue against are better grounded than those that argue for."""
    hits = lambda phrases: F.when(F.lower("speaker") == "assistant", hits_of("plain", phrases))
    sums = {"k": F.count(c("p")), "pos": F.avg(F.when(c("p") > c("n"), c("e"))), "neg": F.avg(F.when(c("n") > c("p"), c("e")))}
    r = c("neg") / F.greatest(c("pos"), F.lit(0.1))
    found = finding("CONFIDENCE_MISCALIBRATION", F.when(r >= threshold * 1.5, CRITICAL).otherwise(WARNING), F.least(F.lit(0.5) + F.lit(0.5) * (r - threshold) / threshold, F.lit(1.0)), "evidence_asymmetry")
    return Signal({"p": hits(positive), "n": hits(negative), "e": hits(links)}, sums, F.when((c("k") >= min_turns) & c("pos").isNotNull() & c("neg").isNotNull() & (r >= threshold), found))


def conviction_of(praise: Iterable[str], dampers: Iterable[str], escalation: Iterable[str], dismissals: Iterable[str]) -> Column:
    """How strongly a turn flatters or overreaches, 0 to 1."""
    flattery = F.greatest(hits_of("plain", praise) - F.lit(0.5) * hits_of("plain", dampers), F.lit(0.0))
    grand = hits_of("plain", escalation) + hits_of("plain", dismissals)
    return F.greatest(F.tanh(flattery / F.lit(2.5)), F.tanh(grand / F.lit(1.5)))


LISTS = {"praise": L.SYCOPHANCY, "dampers": L.DAMPERS, "escalation": L.ESCALATION, "dismissals": L.DISMISSALS}


def conviction(turns: DataFrame, **lists) -> DataFrame:
    """(conv_id, turn_number, mv) of assistant turns."""
    rows = enrich(turns, "plain", "phrases").where(F.lower("speaker") == "assistant").withColumn(PLAIN, _plain_phrases())
    return rows.select("conv_id", "turn_number", conviction_of(**(LISTS | lists)).alias("mv"))


def _sustained(c, window: int, threshold: float, name: str, lists: dict) -> Signal:
    lists = LISTS | lists
    column = "_conviction_" + hashlib.md5(repr(sorted((k, tuple(v)) for k, v in lists.items())).encode()).hexdigest()
    own = F.lower("speaker") == "assistant"
    mv = F.when(own, F.struct(F.col("turn_number").alias("turn"), F.col(column).alias("mv")))

    def best(x: Column) -> Column:
        size = F.least(F.lit(window), F.size(x))
        mean = lambda i: F.aggregate(F.slice(x, i, size), F.lit(0.0), lambda a, b: a + b) / size
        return F.when(F.size(x) > 0, F.array_max(F.transform(F.sequence(F.lit(1), F.size(x) - size + 1), mean)))

    def of(m: Column) -> Column:
        sure = above(m, threshold)
        return F.when(F.round(m, 9) > threshold, finding("SYCOPHANCY", steps(F.round(sure, 9), (0.9, CRITICAL), (0.7, WARNING), (0.5, CAUTION), otherwise=INFO), sure, name))

    return Signal({"mv": mv}, {"mv": in_order(c("mv"))}, T.once(T.once(c("mv")["mv"], best), of), {column: F.when(own, conviction_of(**lists))})


@signal
def sustained_conviction(c, window: int = 5, threshold: float = 0.595, **lists) -> Signal:
    """The best mean conviction over ``window`` consecutive assistant turns, or all where there are fewer."""
    return _sustained(c, window, threshold, "sustained_conviction", lists)


@signal
def sustained_conviction_wide(c, window: int = 7, threshold: float = 0.338, **lists) -> Signal:
    """The same over a wider window."""
    return _sustained(c, window, threshold, "sustained_conviction_wide", lists)


@signal
def underevidenced_claims(c, threshold: float = 0.331, least: int = 2, positive: Iterable[str] = L.UNDEREVIDENCED_POSITIVE, evidence: Iterable[str] = L.UNDEREVIDENCED_EVIDENCE) -> Signal:
    own = lambda phrases: (F.lower("speaker") == "assistant") & any_of("plain", phrases)
    r = ratio(c("e") + F.lit(0.01), c("p"))
    found = finding("SYCOPHANCY", F.when(r <= 0.15, WARNING).when(r <= 0.25, CAUTION).otherwise(INFO), F.lit(0.4) + F.lit(0.6) * T.clamp((threshold - r) / threshold), "underevidenced_claims", c("t"))
    return Signal({"p": own(positive), "e": own(evidence)}, {"p": F.count_if(c("p")), "e": F.count_if(c("e")), "t": turns_with(c("p"))}, F.when((c("p") >= least) & (r <= threshold), found))


@signal
def negative_claim_confidence(c, threshold: float = 0.45, dismissing: Iterable[str] = L.DISMISSING, additive: Iterable[str] = L.ADDITIVE, strong: Iterable[str] = L.STRONG_SINGLE, confident: Iterable[str] = L.HIGH_CONFIDENCE) -> Signal:
    """Assistant sentences that dismiss counter-evidence or pile up parts, by the surest of them."""

    def sentence(s: Column) -> Column:
        sure = T.once(T.phrase_hits(s, confident), lambda n: F.when(n >= 2, F.least(F.lit(0.75) + F.lit(0.05) * (n - 2), F.lit(0.95))).when(n == 1, 0.72).when(T.phrase_any(s, strong), 0.65).otherwise(0.48))
        return F.struct(sure.alias("mv"), T.phrase_hits(s, additive).alias("g"), T.phrase_hits(s, dismissing).alias("d"))

    # Sentences are looked at where the turn has any such phrase at all.
    some = any_of("plain", (*additive, *dismissing))
    own = F.when(F.col("said") & some, F.filter(F.transform(T.sentences(F.col("plain")), sentence), lambda x: x["g"] + x["d"] > 0))
    total = lambda x, k: F.aggregate(x[k], F.lit(0), lambda a, b: a + b)
    read = T.once(own, lambda x: F.when(F.size(x) > 0, F.struct(F.array_max(x["mv"]).alias("mv"), total(x, "g").alias("g"), total(x, "d").alias("d"))))
    sums = {"mv": F.max(c("x")["mv"]), "g": F.sum(c("x")["g"]), "d": F.sum(c("x")["d"]), "t": turns_with(c("x").isNotNull())}
    kind = F.when(c("d") > c("g"), "COUNTER_EVIDENCE_DEPLETION").otherwise("CATHEDRAL_COMPLEXITY")
    found = finding(kind, steps(F.round(c("mv"), 9), (0.85, CRITICAL), (0.70, WARNING), otherwise=CAUTION), c("mv"), "negative_claim_confidence", c("t"))
    return Signal({"x": read}, sums, F.when(c("mv") > threshold, found))


@signal
def assumption_surfacer(c, threshold: float = 0.75, least: int = 2, claims: Iterable[str] = L.CLAIMS, premises: Iterable[str] = L.PREMISES) -> Signal:
    n = lambda phrases: F.when(F.lower("speaker") == "assistant", T.phrase_occurrences(F.col("plain"), phrases, met=met("plain", phrases))).otherwise(0)
    x = ratio(c("c"), c("c") + c("p") + 1)
    found = finding("UNSUPPORTED_CONCLUSION", F.when(x > 0.85, CRITICAL).otherwise(WARNING), above(x, threshold), "assumption_surfacer", c("t"))
    sums = {"c": F.sum(c("c")), "p": F.sum(F.when(c("c") > 0, c("p")).otherwise(0)), "t": turns_with(c("c") > 0)}
    return Signal({"c": n(claims), "p": n(premises)}, sums, F.when((c("c") >= least) & (x > threshold), found))


@signal
def circular_reasoning(c, similar: float = 0.55, least: int = 2, share: float = 0.35, connectors: Iterable[str] = L.CAUSAL, stop: Iterable[str] = L.CIRCULAR_STOP, substring: bool = True) -> Signal:
    """Assistant turns in which two sentences say the same, one of them with a causal connector; without
    ``substring``, connectors count as whole words only."""
    inside = lambda s: T.phrase_any(s, connectors) if substring else F.exists(T.listed(connectors), lambda p: F.concat(F.lit(" "), F.regexp_replace(s, "[^a-z0-9']+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" "))))
    content = lambda s: F.array_except(F.split(s, "[^a-z0-9]+"), T.listed(("", *stop)))
    parts = F.transform(T.sentences_hard(F.col("plain")), lambda s: F.struct(content(s).alias("w"), inside(s).alias("causal")))
    twin = lambda x: F.exists(F.transform(x, lambda a, i: F.exists(F.slice(x, i + 2, F.size(x)), lambda b: (a["causal"] | b["causal"]) & (T.jaccard(a["w"], b["w"]) > similar))), lambda hit: hit)
    # Sentences are looked at where the turn has a connector at all.
    some = any_of("plain", connectors) if substring else F.lit(True)
    hit = F.when(F.col("said"), F.when(some, T.once(parts, twin)).otherwise(False))
    x = ratio(c("h"), c("n"))
    found = finding("UNSUPPORTED_CONCLUSION", F.when(x > 0.6, CRITICAL).otherwise(WARNING), above(x, share), "circular_reasoning", c("t"))
    return Signal({"hit": hit}, {"n": F.count(c("hit")), "h": F.count_if(c("hit")), "t": turns_with(c("hit"))}, F.when((c("h") >= least) & (x > share), found))


@signal
def evidence_quality(c, threshold: float = 0.70, least: int = 2, turns: int = 2, anecdotal: Iterable[str] = L.ANECDOTAL, empirical: Iterable[str] = L.EMPIRICAL, confident: Iterable[str] = L.CONFIDENT) -> Signal:
    """Anecdotes outweigh evidence on the mean, or several turns claim with confidence and an anecdote."""
    n = lambda phrases: F.when(F.col("said"), T.phrase_occurrences(F.col("plain"), phrases, overlapping=True, met=met("plain", phrases)))
    sure = F.col("said") & any_of("plain", confident)
    hit = c("sure") & (c("a") > 0)
    sums = {"x": F.avg(ratio(c("a"), c("a") + c("e") + 1)), "a": F.sum(c("a")), "h": F.count_if(hit), "t": turns_with(hit)}
    found = finding("UNSUPPORTED_CONCLUSION", F.when((c("x") > 0.85) | (c("h") >= 3), CRITICAL).otherwise(WARNING), F.lit(0.5) + F.lit(0.5) * c("x"), "evidence_quality", c("t"))
    return Signal({"a": n(anecdotal), "e": n(empirical), "sure": sure}, sums, F.when(((F.round(c("x"), 9) > threshold) & (c("a") >= least)) | (c("h") >= turns), found))


@signal
def status_quo_bias(c, threshold: float = 0.65, least: int = 3, keeping: Iterable[str] = L.STATUS_QUO, burden: Iterable[str] = L.CHANGE_BURDEN, changing: Iterable[str] = L.CHANGE_POSITIVE) -> Signal:
    n = lambda phrases: F.when(F.col("said"), hits_of("plain", phrases)).otherwise(0)
    bias, every = c("s") + c("b"), c("s") + c("b") + c("g")
    sums = {"x": F.avg(F.when(every > 0, ratio(bias, every + 1))), "n": F.sum(bias), "t": turns_with(every > 0)}
    found = finding("STATUS_QUO_BIAS", F.when(c("x") > 0.85, CRITICAL).otherwise(WARNING), above(c("x"), threshold), "status_quo_bias", c("t"))
    return Signal({"s": n(keeping), "b": n(burden), "g": n(changing)}, sums, F.when((F.round(c("x"), 9) > threshold) & (c("n") >= least), found))


@signal
def entity_coherence(c, reach: int = 5, least: int = 2, min_turns: int = 3, proxies: Iterable[str] = L.PROXIES, plus: Iterable[str] = L.PLUS_WORDS, minus: Iterable[str] = L.MINUS_WORDS, changed: Iterable[str] = L.CHANGE_ACK) -> Signal:
    """Things of two words (listed ones, or two capitalised words) named in two or more assistant turns, praised in one and
    blamed in another within ``reach`` words; turns that speak of a change don't count."""
    bare = F.transform(T.words(F.col("raw_text")), lambda w: F.regexp_replace(w, "^[^A-z]+|[^A-z]+$", ""))
    pairs = T.once(bare, lambda w: F.filter(F.transform(w, lambda a, i: F.struct(a.alias("a"), F.get(w, i + 1).alias("b"))), lambda p: p["a"].rlike("^[A-Z].") & F.coalesce(p["b"].rlike("^[A-Z]."), F.lit(False))))
    # Words are cleaned and paired where there is a capital in one word and at the front of the next at all.
    some = F.col("raw_text").rlike(r"[A-Z]\S*\s+[^A-z\s]*[A-Z]")
    titles = F.when(some, F.transform(pairs, lambda p: F.lower(F.concat_ws(" ", p["a"], p["b"])))).otherwise(F.array().cast("array<string>"))
    names = F.array_distinct(F.concat(T.phrases_in(F.col("plain"), proxies, met("plain", proxies)), titles))
    sign = lambda w: T.once(F.btrim(w, F.lit(",.;:!?")), lambda x: F.when(F.array_contains(T.listed(plus), x), 1).when(F.array_contains(T.listed(minus), x), -1))

    def around(w: Column) -> Column:
        """(turn, name, sign) of every two words near a descriptor."""
        said = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), sign(x).alias("sign"))), lambda x: x["sign"].isNotNull())
        name = lambda i: F.concat_ws(" ", F.btrim(F.get(w, i), F.lit(",.;:")), F.btrim(F.get(w, i + 1), F.lit(",.;:")))
        spans = lambda x: F.sequence(F.greatest(x["i"] - reach - 1, F.lit(0)), F.greatest(F.least(x["i"] + reach, F.size(w) - 2), F.lit(0)))
        near = F.transform(said, lambda x: F.transform(spans(x), lambda i: F.struct(F.col("turn_number").alias("turn"), name(i).alias("name"), x["sign"].alias("sign"))))
        return F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull())))

    near = F.when(F.col("said") & any_of("plain", (*plus, *minus)) & ~any_of("plain", changed), T.once(T.words(F.col("plain")), lambda w: F.when(F.size(w) > 1, around(w))))
    sums = {"k": F.count_if(c("said")), "names": F.flatten(F.collect_list(c("names"))), "near": F.flatten(F.collect_list(c("near")))}
    often = F.filter(F.array_distinct(c("names")), lambda n: F.size(F.filter(c("names"), lambda m: m == n)) >= 2)
    turns = lambda n, s: F.array_distinct(F.transform(F.filter(c("near"), lambda x: (x["name"] == n) & (x["sign"] == s)), lambda x: x["turn"]))
    both = lambda n: T.once(F.struct(turns(n, 1).alias("p"), turns(n, -1).alias("m")), lambda x: F.struct((F.exists(x["p"], lambda a: F.exists(x["m"], lambda b: a != b))).alias("broken"), F.array_union(x["p"], x["m"]).alias("t")))
    broken = F.filter(F.transform(often, both), lambda x: x["broken"])

    def of(x: Column) -> Column:
        n = F.size(x)
        return F.when((c("k") >= min_turns) & (n >= least), finding("CONTRADICTION", F.when(n >= 4, CRITICAL).otherwise(WARNING), F.least(F.lit(0.5) + F.lit(0.3) * n, F.lit(0.95)), "entity_coherence", F.array_sort(F.array_distinct(F.flatten(x["t"])))))

    return Signal({"said": F.col("said"), "names": F.when(F.col("said"), names), "near": near}, sums, T.once(broken, of))


def merge_enrichment(enrichment: DataFrame) -> DataFrame:
    """(conv_id, phrases, formality) of an outside model's rows (conv_id, turn_number, phrases, formality): lists joined
    in order of turns; the formality of the last turn that has one."""
    parts = F.array_sort(F.collect_list(F.struct("turn_number", "phrases")))
    rows = enrichment.groupBy("conv_id").agg(parts.alias("p"), F.max_by("formality", F.when(F.col("formality").isNotNull(), F.col("turn_number"))).alias("formality"))
    return rows.select("conv_id", F.flatten(F.filter(F.col("p")["phrases"], lambda x: x.isNotNull())).alias("phrases"), "formality")


def sunk_cost_ml(turns: DataFrame, enrichment: DataFrame, boost: float = 0.1, lone: float = 0.4) -> DataFrame:
    """sunk_cost, surer where the enrichment has phrases of it too; where only that has them, a weak finding."""
    told = merge_enrichment(enrichment).where(F.size("phrases") > 0).select("conv_id", F.lit(True).alias("told"))
    return _boosted(sunk_cost(turns), told, F.col("told"), F.col("told"), "SUNK_COST_FALLACY", "sunk_cost", boost, lone)


def _boosted(own: DataFrame, told: DataFrame, confirms: Column, alone: Column, kind: str, name: str, boost: float, lone: float) -> DataFrame:
    """Findings, surer where ``confirms``; where there is none and ``alone``, a weak one."""
    rows = own.select("conv_id", F.struct(*FINDING[1:]).alias("f")).join(told, "conv_id", "full_outer")
    f = F.col("f")
    surer = f.withField("confidence", F.when(F.coalesce(confirms, F.lit(False)), T.clamp(f["confidence"] + boost)).otherwise(f["confidence"]))
    return of_rows(rows, F.when(f.isNotNull(), surer).when(alone, finding(kind, INFO, lone, name)))


def miscalibration_ml(turns: DataFrame, claims: DataFrame, markers: DataFrame, boost: float = 0.1, lone: float = 0.4, claims_least: int = 2, markers_least: int = 3, certainty: Iterable[str] = L.CERTAINTY, hedging: Iterable[str] = L.HEDGING, statuses: Iterable[str] = L.CERTAIN_STATUS) -> DataFrame:
    """confidence_miscalibration with an outside model's claims (conv_id, status, n_evidence) and confidence markers (conv_id, marker).

    A certain claim without evidence makes a finding surer. Without a finding, ``claims_least`` of them and ``markers_least``
    markers of certainty, hedges not counted, make a weak one."""
    bare = claims.where(F.col("status").isin(*statuses) & (F.col("n_evidence") == 0)).groupBy("conv_id").agg(F.count("*").alias("bare"))
    marker = F.lower(F.btrim("marker", F.lit(" \n\t")))
    sure = markers.where(~T.phrase_any(marker, hedging) & T.phrase_any(marker, certainty)).groupBy("conv_id").agg(F.count("*").alias("sure"))
    told = bare.join(sure, "conv_id", "left")
    alone = (F.col("bare") >= claims_least) & (F.coalesce("sure", F.lit(0)) >= markers_least)
    return _boosted(confidence_miscalibration(turns), told, F.col("bare") >= 1, alone, "CONFIDENCE_MISCALIBRATION", "confidence_miscalibration", boost, lone)


def anchoring_ml(turns: DataFrame, references: DataFrame, boost: float = 0.1, relevance: float = 0.5, **params) -> DataFrame:
    """anchoring_context, surer where an outside model's references (conv_id, value, relevance) hold the anchor as relevant."""
    own = anchoring_context(turns, **params)
    told = references.where(F.col("relevance") > relevance).select("conv_id", F.col("value").alias("strength"), F.lit(True).alias("told")).distinct()
    rows = own.join(told, ["conv_id", "strength"], "left")
    return rows.withColumn("confidence", F.when(F.col("told"), T.clamp(F.col("confidence") + boost)).otherwise(F.col("confidence"))).select(*FINDING)


def orbits(turns: DataFrame, min_turns: int = 8, early: int = 3, acknowledged: Iterable[str] = L.ACKNOWLEDGEMENTS, reasserted: Iterable[str] = L.REASSERTIONS, carried: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, turn_number, anchor_turn, sim, conceded, and columns ``carried`` along): how like each turn after a conversation's first early statement is to it, null
    for a blank turn, and whether it concedes a point for good."""
    rows = enrich(turns, "low", "keywords", "phrases").select("conv_id", "turn_number", "raw_text", "low", "keywords", "phrases", *carried).withColumn("blank", F.btrim("raw_text", F.lit(" \n\t")) == "")
    concedes = any_of("low", acknowledged) & ~any_of("low", reasserted)
    kw = rows.select("conv_id", "turn_number", "blank", *carried, F.col("keywords").alias("k"), concedes.alias("conceded"), F.when(F.col("turn_number") <= early, T.strong_declarative(F.col("raw_text"))).alias("strong"))
    size = turns.groupBy("conv_id").agg(F.count("*").alias("all")).where(F.col("all") >= min_turns)
    anchor = kw.where("strong").groupBy("conv_id").agg(F.min(F.struct("turn_number", "k")).alias("a")).where(F.size("a.k") > 0).join(size, "conv_id")
    later = kw.join(anchor, "conv_id").where(F.col("turn_number") > F.col("a.turn_number"))
    sim = F.when(~F.col("blank"), F.when(F.size("k") > 0, T.jaccard(F.col("k"), F.col("a.k"))).otherwise(0.0))
    return later.select("conv_id", "turn_number", F.col("a.turn_number").alias("anchor_turn"), sim.alias("sim"), "conceded", *carried)


def conceptual_anchoring(turns: DataFrame, least: float | Column = 0.3, share: float = 0.6, **params) -> DataFrame:
    """Later turns that keep circling an early statement, none of which concedes a point for good; ``params`` as in ``orbits``."""
    level = least if isinstance(least, Column) else F.lit(least)
    later = orbits(turns.withColumn("_level", level), carried=("_level",), **params)
    sums = later.groupBy("conv_id").agg(F.count_if(F.col("sim") >= F.col("_level")).alias("near"), F.count("sim").alias("scored"), F.avg("sim").alias("mean"), F.count("*").alias("n"), F.min("anchor_turn").alias("t"), turns_with(F.lit(True)).alias("after"), F.max("conceded").alias("conceded"))
    sums = sums.withColumn("orbit", ratio(F.col("near"), F.col("scored"))).where((F.col("orbit") >= share) & ~F.col("conceded"))
    sure = T.clamp(F.lit(0.5) * F.col("orbit") + F.lit(0.3) * F.col("mean") + F.lit(0.2) * F.least(F.col("n") / F.lit(15.0), F.lit(1.0)))
    return of_rows(sums, finding("CONCEPTUAL_ANCHORING", steps(F.round(sure, 9), (0.75, WARNING), (0.55, CAUTION), otherwise=INFO), sure, "conceptual_anchoring", F.concat(F.array("t"), F.col("after"))))


def sentence_table(turns: DataFrame, stop: Iterable[str] = L.STOP_OVERLAP, carried: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, speaker, turn_number, at, s, t, all, w, and columns ``carried`` along): lowered sentences of 15 bytes or more, their words, the distinct ones without
    punctuation, and those with content. Turns that change direction (``override``, where the turns have it) are left out."""
    rows = low(turns.where(~F.col("override")) if "override" in turns.columns else turns)
    rows = rows.select("conv_id", "speaker", "turn_number", *carried, F.posexplode(T.sentences(F.col("low"))).alias("at", "s")).where(F.octet_length("s") >= 15)
    rows = rows.withColumn("t", T.words(F.col("s"))).withColumn("all", _bare_words(F.col("t")))
    return rows.withColumn("w", F.array_except("all", T.listed(stop)))


def _bare_words(t: Column) -> Column:
    """The distinct words without punctuation."""
    return F.array_distinct(F.filter(F.transform(t, lambda w: F.btrim(w, F.lit(".,!?;:\"'()-"))), lambda w: w != ""))


def contradiction(turns: DataFrame, overlap: float | Column = 0.6, least: float = 0.75, negations: Iterable[str] = L.NEGATIONS, reversals: Iterable[str] = L.REVERSALS, antonyms=L.ANTONYMS, stop: Iterable[str] = L.STOP_OVERLAP) -> DataFrame:
    """Two sentences of one speaker in different turns that share most words, and one of them denies.

    Candidates come from an inverted index on (conversation, speaker, word): the smaller set's first words in one order
    against all words of the other, so only sentences that can overlap enough are paired. Words that no sentence of the speaker
    with anything to deny has pair with none; they come first in the order and are only counted, the others follow by length, as
    longer words are rarer. That order needs no counts, so words are dealt out once, already cut. Two sentences without anything to deny
    never contradict each other. Pairs meet with no more than what they may deny with, and those that can't are left out
    before the sentences themselves are fetched. Sentences are written once, and split again for pairs alone.
    """
    level = overlap if isinstance(overlap, Column) else F.lit(overlap)
    charged = (F.size("marks.no") > 0) | F.col("marks.reversal") | (F.size("marks.poles") > 0)
    table = sentence_table(turns.withColumn("_level", level), stop, ("_level",)).withColumn("marks", _denials(negations, reversals, antonyms)).withColumn("charged", charged)
    s = written(table.drop("t", "all"), "sentences")
    denied = s.where("charged").groupBy("conv_id", "speaker").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("_denied"))
    met = F.array_sort(F.transform(F.array_intersect("w", "_denied"), lambda x: F.struct((-F.length(x)).alias("k"), x.alias("x"))))["x"]
    words = s.drop("s").join(denied, ["conv_id", "speaker"]).withColumns({"n": F.size("w"), "met": met}).drop("w", "_denied")
    # So many of the first words; those that aren't met are the first of them.
    cut = F.col("n") - F.ceil(F.col("n") * F.col("_level")).cast("int") + 1 - (F.col("n") - F.size("met"))
    place = F.struct("turn_number", "at")
    p = words.where(cut > 0).select("conv_id", "speaker", F.explode(F.slice("met", F.lit(1), F.greatest(cut, F.lit(1)))).alias("x"), place.alias("p"), F.col("n").alias("np"), F.col("charged").alias("cp"), F.col("marks").alias("mp"))
    q = words.select("conv_id", "speaker", F.explode("met").alias("x"), place.alias("q"), F.col("n").alias("nq"), F.col("charged").alias("cq"), F.col("marks").alias("mq"))
    found = p.join(q, ["conv_id", "speaker", "x"]).where((F.col("np") <= F.col("nq")) & (F.col("p.turn_number") != F.col("q.turn_number")) & (F.col("cp") | F.col("cq")))
    later = F.when(F.col("p.turn_number") > F.col("q.turn_number"), F.col("mp.reversal")).otherwise(F.col("mq.reversal"))
    found = found.where((F.col("mp.no") != F.col("mq.no")) | later | _opposed(F.col("mp.poles"), F.col("mq.poles"), antonyms))
    pairs = found.select("conv_id", "speaker", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    key = s.where("size(w) > 0").select("conv_id", "speaker", place.alias("k"), F.struct("s", "w", "_level").alias("v"))
    full = pairs.join(key.select("conv_id", "speaker", F.col("k").alias("a"), F.col("v").alias("x")), ["conv_id", "speaker", "a"]).join(key.select("conv_id", "speaker", F.col("k").alias("b"), F.col("v").alias("y")), ["conv_id", "speaker", "b"])
    full = full.withColumn("overlap", T.overlap_coefficient(F.col("x.w"), F.col("y.w"))).where(F.col("overlap") >= F.col("x._level"))
    for side in "xy":
        full = full.withColumn(side, F.col(side).withField("t", T.words(F.col(f"{side}.s")))).withColumn(side, F.col(side).withField("all", _bare_words(F.col(f"{side}.t"))))
    full = full.withColumn("kind", _contradiction_kind(F.col("x"), F.col("y"), negations, reversals, antonyms, stop)).where("kind is not null")
    pick = lambda *values: F.when(F.col("kind") == "negation", values[0]).when(F.col("kind") == "reversal", values[1]).otherwise(values[2])
    full = full.withColumn("confidence", F.least(F.lit(0.65) + F.lit(0.2) * F.col("overlap") + pick(0.15, 0.12, 0.08), F.lit(1.0))).where(F.round("confidence", 9) >= least)
    best = first_by(full, F.col("a"), F.col("b"))
    return of_rows(best, finding("CONTRADICTION", steps(F.col("confidence"), (0.8, CRITICAL), otherwise=WARNING), F.col("confidence"), "contradiction", F.array("a.turn_number", "b.turn_number"), F.col("overlap"), pick(0.9, 0.7, 0.5)))


def _denials(negations, reversals, antonyms) -> Column:
    """What a sentence (s, all) may contradict another with: its negations, whether it reverses something, and its words that have an antonym."""
    no = F.filter(T.listed(negations), lambda p: F.contains(F.col("s"), p))
    return F.struct(no.alias("no"), T.phrase_any(F.col("s"), reversals).alias("reversal"), F.array_intersect("all", T.listed(w for pair in antonyms for w in pair)).alias("poles"))


def _opposed(x: Column, y: Column, antonyms) -> Column:
    has = F.array_contains
    out = F.lit(False)
    for a, b in antonyms:
        out = out | (has(x, a) & has(y, b)) | (has(x, b) & has(y, a))
    return out


def _contradiction_kind(x: Column, y: Column, negations, reversals, antonyms, stop) -> Column:
    """negation (near a shared word, on one side only), then reversal (in the later), then antonyms."""
    shared = F.filter(F.array_intersect(x["all"], y["all"]), lambda w: (F.octet_length(w) > 2) & ~F.array_contains(T.listed(stop), w))
    bare = lambda w: F.btrim(w, F.lit(".,!?;:\"'()-"))

    def near(own: Column, no: Column, both: Column) -> Column:
        around = lambda i: F.array_join(F.slice(own, F.greatest(i - 4, F.lit(1)), i + 7 - F.greatest(i - 4, F.lit(1))), " ")
        return F.exists(F.transform(own, lambda w, i: F.array_contains(both, bare(w)) & F.contains(around(i), no)), lambda hit: hit)

    def denied(both: Column) -> Column:
        sides = lambda no: F.struct(F.contains(x["s"], no).alias("a"), F.contains(y["s"], no).alias("b"))
        return F.exists(T.listed(negations), lambda no: T.once(sides(no), lambda h: (h["a"] != h["b"]) & near(F.when(h["a"], x["t"]).otherwise(y["t"]), no, both)))

    opposed = _opposed(x["all"], y["all"], antonyms)
    return F.when(T.once(shared, lambda both: (F.size(both) > 0) & denied(both)), "negation").when(T.phrase_any(y["s"], reversals), "reversal").when(opposed, "antonym")


def _reference(kw: DataFrame, goals: DataFrame, reference_turns: int) -> DataFrame:
    """(conv_id, w, r, goal): stem counts of a conversation's first turns and, twice, its objective (conv_id, w), and whether that has the stem (1) or not (0)."""
    goal = goals.withColumn("n", F.lit(2.0)).withColumn("g", F.lit(1.0))
    said = kw.where(F.col("turn_number") <= reference_turns).select("conv_id", F.explode("keywords").alias("w"), F.lit(1.0).alias("n"), F.lit(0.0).alias("g"))
    return said.union(goal).groupBy("conv_id", "w").agg(F.sum("n").alias("r"), F.max("g").alias("goal"))


def drift_windows(turns: DataFrame, objectives: DataFrame, reference_turns: int, window: int) -> tuple[DataFrame, DataFrame]:
    """((conv_id, turn_number, w, c, r), (conv_id, w, r, goal)): stem counts of each turn's window, beside those of the reference (null where
    it lacks the stem), and of the reference, and whether the objective has the stem (1) or not (0)."""
    kw = enrich(turns, "keywords").select("conv_id", "turn_number", "keywords")
    ref, kw = _reference(kw, objectives.select("conv_id", F.explode(T.keywords(F.col("objective"))).alias("w")), reference_turns), kw.select("conv_id", "turn_number", F.explode("keywords").alias("w"))
    # A turn's words count in the windows of the next turns too. They meet the reference and are dealt out by conversation before they are
    # exploded into windows, and counts by window, and then by turn, need no further shuffle.
    last = turns.groupBy("conv_id").agg(F.max("turn_number").alias("last"))
    met = kw.join(ref.select("conv_id", "w", "r"), ["conv_id", "w"], "left").repartition("conv_id")
    spread = met.join(last, "conv_id").select("conv_id", "w", "r", F.explode(F.sequence(F.col("turn_number"), F.least(F.col("turn_number") + window, F.col("last")))).alias("turn_number"))
    own = spread.groupBy("conv_id", "turn_number", "w").agg(F.count("*").cast("double").alias("c"), F.any_value("r").alias("r"))
    return own, ref


def drift_distances(turns: DataFrame, objectives: DataFrame, reference_turns: int = 4, window: int = 3, topics=L.TOPICS) -> DataFrame:
    """(conv_id, turn_number, distance): weighted Jaccard distance of the last window+1 turns' stems from
    the objective's (counted twice) and the first turns'; or, if that is more and both sides have words of any topic, the distance by
    topic. Conversations without a word in their objective give no row."""
    told = written(objectives.select("conv_id", T.keywords(F.coalesce("objective", F.lit(""))).alias("goal")), "objectives").where(F.size("goal") > 0)
    names = sorted(topics)
    kw = enrich(turns, "keywords").select("conv_id", "turn_number", "keywords")
    ref = _reference(kw, told.select("conv_id", F.explode("goal").alias("w")), reference_turns)
    weight = {t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for w, v in sorted(topics[t].items()) for x in (w, float(v))]), F.col("w")), F.lit(0.0)) for t in names}
    # Of a turn's words, those of the reference are counted one by one; the others, and the words of topics, add up by turn.
    # Counts of the reference are few, so its words meet a turn's as one set for each count.
    known = ref.groupBy("conv_id", "r").agg(F.collect_list("w").alias("ws")).groupBy("conv_id").agg(F.collect_list(F.struct("r", "ws")).alias("known"))
    spoken = F.array_intersect("keywords", T.listed(sorted({w for t in names for w in topics[t]})))
    sums = kw.join(grown(told.select("conv_id")), "conv_id", "left_semi").where(F.size("keywords") > 0).select("conv_id", "turn_number", "keywords", F.size("keywords").cast("double").alias("sc"), T.once(spoken, lambda k: T.topic_vector(k, topics)).alias("v"))
    shared = F.flatten(F.transform("known", lambda x: F.transform(F.array_intersect("keywords", x["ws"]), lambda w: F.struct(w, x["r"])))).cast("array<struct<w: string, r: double>>")
    last = turns.groupBy("conv_id").agg(F.max("turn_number").alias("last"))
    met = sums.join(grown(known), "conv_id").join(grown(last), "conv_id")
    # A turn counts in the windows of the next turns too. Rows are dealt out by conversation before they are exploded, and counts by window, and then by turn, need no
    # further shuffle.
    after = F.greatest(F.col("turn_number"), F.lit(reference_turns + 1))
    upto = F.least(F.col("turn_number") + window, F.col("last"))
    windows = F.explode(F.sequence(after, upto)).alias("turn_number")
    met = met.where(after <= upto)
    all_ = met.select("conv_id", windows, "sc", "v").groupBy("conv_id", "turn_number").agg(F.sum("sc").alias("sc"), *[F.sum(F.get("v", F.lit(i))).alias(f"c_{t}") for i, t in enumerate(names)])
    words = met.select("conv_id", windows, shared.alias("shared")).select("conv_id", "turn_number", F.inline("shared")).groupBy("conv_id", "turn_number", "w").agg(F.least(F.count("*").cast("double"), F.any_value("r")).alias("c"))
    both = all_.join(grown(words.groupBy("conv_id", "turn_number").agg(F.sum("c").alias("both"))), ["conv_id", "turn_number"], "left").fillna(0.0, ["both"])
    # Objective's words count as such and as words of the reference, the others once.
    total = ref.groupBy("conv_id").agg(F.sum("r").alias("sr"), *[F.sum((F.lit(1.0) + F.coalesce("goal", F.lit(0.0))) * weight[t]).alias(f"r_{t}") for t in names])
    rows = both.join(grown(total), "conv_id")
    plain = 1 - F.col("both") / (F.col("sc") + F.col("sr") - F.col("both"))
    vectors = [F.array(*[F.col(f"{side}_{t}") for t in names]) for side in "cr"]
    alike = T.topic_similarity(*vectors, n=len(names))
    return rows.select("conv_id", "turn_number", F.when(alike < 0, plain).otherwise(F.greatest(plain, 1 - alike)).alias("distance"))


def _runs(d: DataFrame, value: str, threshold: Column | float, sustained: Column | int, scale: float, name: str) -> DataFrame:
    """Findings of runs of turns whose value stays beyond the threshold, from the ``sustained``-th turn on."""
    far = d.withColumn("far", F.round(value, 9) > threshold)
    order = Window.partitionBy("conv_id").orderBy("turn_number")
    runs = far.withColumn("run", F.sum((~F.col("far")).cast("int")).over(order)).where("far")
    counted = runs.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("turn_number"))).where(F.col("k") >= sustained)
    found = counted.groupBy("conv_id").agg(F.least(F.max(value) / F.lit(scale), F.lit(1.0)).alias("d"), turns_with(F.lit(True)).alias("t"))
    return of_rows(found, finding("SCOPE_DRIFT", steps(F.round("d", 9), (0.95, CRITICAL), (0.85, WARNING), (0.75, CAUTION), otherwise=INFO), F.col("d"), name, F.col("t")))


def scope_drift(turns: DataFrame, objectives: DataFrame, threshold: float | Column = 0.79, sustained: int | Column = 8, reference_turns: int = 4, orchestrating: bool | DataFrame = False) -> DataFrame:
    """Runs of turns that stay beyond the threshold, which is a fifth higher, 0.98 at most, for work on several projects:
    in all conversations, or in those of a table (conv_id)."""
    d = drift_distances(turns, objectives, reference_turns)
    level, least = (x if isinstance(x, Column) else F.lit(x) for x in (threshold, sustained))
    if isinstance(threshold, Column) or isinstance(sustained, Column):
        d = d.join(turns.groupBy("conv_id").agg(F.any_value(level).alias("_level"), F.any_value(least).alias("_least")), "conv_id")
        level, least = F.col("_level"), F.col("_least")
    if isinstance(orchestrating, DataFrame):
        d = d.join(orchestrating.select("conv_id", F.lit(True).alias("_several")), "conv_id", "left")
        level = F.when(F.col("_several"), F.least(level * 1.2, F.lit(0.98))).otherwise(level)
    elif orchestrating:
        level = F.least(level * 1.2, F.lit(0.98))
    return _runs(d, "distance", level, least, 1.0, "scope_drift")


def drift_divergences(turns: DataFrame, objectives: DataFrame, reference_turns: int = 4, window: int = 3, smoothing: float = 0.01) -> DataFrame:
    """(conv_id, turn_number, kl): smoothed divergence of the reference's stem frequencies from those of the
    turn's window, over the words of both. Windows or references without words give no row.

    The words that only the reference has contribute a sum that is known per conversation, so an
    inner part over the window's words is enough and no full outer join is made.
    """
    own, ref = drift_windows(turns, objectives, reference_turns, window)
    s = F.lit(smoothing)
    r = F.coalesce("r", F.lit(0.0)) + s
    seen = own.groupBy("conv_id", "turn_number").agg(
        F.sum("c").alias("sc"), F.count("*").alias("n_own"), F.count("r").alias("shared"),
        F.sum(r * F.log(r / (F.col("c") + s))).alias("inner"), F.sum(F.when(F.col("r").isNotNull(), r * F.log(r / s)).otherwise(0.0)).alias("counted"),
    )
    total = ref.groupBy("conv_id").agg(F.sum("r").alias("sr"), F.count("*").alias("n_ref"), F.sum((F.col("r") + s) * F.log((F.col("r") + s) / s)).alias("outer"))
    rows = seen.join(total, "conv_id").where(F.col("turn_number") > reference_turns)
    v = (F.col("n_own") + F.col("n_ref") - F.col("shared")) * s
    kl = (F.col("inner") + F.col("outer") - F.col("counted")) / (F.col("sr") + v) + F.log((F.col("sc") + v) / (F.col("sr") + v))
    return rows.select("conv_id", "turn_number", kl.alias("kl"))


def scope_drift_kl(turns: DataFrame, objectives: DataFrame, threshold: float = 2.0, sustained: int = 5, reference_turns: int = 4) -> DataFrame:
    """As scope_drift, by divergence; the confidence is a quarter of it, 1 at most."""
    return _runs(drift_divergences(turns, objectives, reference_turns), "kl", threshold, sustained, 4.0, "scope_drift_kl")


def scope_drift_centroid(turns: DataFrame, objectives: DataFrame, threshold: float = 0.85, sustained: int = 7, decay: float = 0.8) -> DataFrame:
    """Distance from a centroid that follows only turns which don't drift: a fold over each
    conversation's turns in order, with the centroid as map state. Conversations are bounded by validate_format."""
    kw = enrich(turns, "keywords").select("conv_id", F.struct("turn_number", F.col("keywords").alias("k")).alias("t"))
    rows = kw.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).join(objectives, "conv_id", "left")
    goal = T.keywords(F.coalesce("objective", F.lit("")))
    start = F.struct(F.transform_values(F.map_from_entries(F.transform(goal, lambda x: F.struct(x, F.lit(1.0)))), lambda k, v: v).alias("c"), F.lit(0).alias("run"), F.lit(0.0).alias("best"), F.array().cast("array<int>").alias("hits"))

    def step(state: Column, t: Column) -> Column:
        c = state["c"]
        shared = F.aggregate(t["k"], F.lit(0.0), lambda a, w: a + F.least(F.coalesce(F.element_at(c, w), F.lit(0.0)), F.lit(1.0)))
        total = F.aggregate(F.map_values(c), F.lit(0.0), lambda a, v: a + v) + F.size(t["k"]) - shared
        d = F.when(total > 0, 1 - shared / total).otherwise(0.0)
        far = F.round(d, 9) > threshold
        own = F.map_from_entries(F.transform(t["k"], lambda w: F.struct(w, F.lit(1.0))))
        moved = F.map_zip_with(c, own, lambda k, a, b: F.coalesce(a, F.lit(0.0)) * decay + F.coalesce(b, F.lit(0.0)) * (1 - decay))
        run = F.when(far, state["run"] + 1).otherwise(0)
        hit = run >= sustained
        return F.struct(F.when(far, c).otherwise(moved).alias("c"), run.alias("run"), F.when(hit, F.greatest(state["best"], d)).otherwise(state["best"]).alias("best"), F.when(hit, F.array_append(state["hits"], t["turn_number"].cast("int"))).otherwise(state["hits"]).alias("hits"))

    found = rows.withColumn("f", F.aggregate("ts", start, step)).where(F.size("f.hits") > 0)
    d = F.round("f.best", 9)
    return of_rows(found, finding("SCOPE_DRIFT", steps(d, (0.95, CRITICAL), (0.85, WARNING), (0.75, CAUTION), otherwise=INFO), F.col("f.best"), "scope_drift_centroid", F.col("f.hits")))


#: Detectors of turns alone that are no sums; users add their own by ``register``.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"contradiction": contradiction, "conceptual_anchoring": conceptual_anchoring}
#: What runs by default: anchoring by context stands for plain anchoring, and sunk cost for its variant by proximity.
DEFAULT = tuple(n for n in SIGNALS if n not in ("anchoring", "sunk_cost_proximity")) + tuple(REGISTRY)


def register(name: str, detector: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a detector: a function from turns to findings (conv_id, finding_type, severity, confidence, detector_name and relevant_turns at least)."""
    REGISTRY[name] = detector


def detect(
    turns: DataFrame, detectors: Iterable[str] | None = None, params: dict[str, dict] | None = None, objectives: DataFrame | None = None, thresholds: DataFrame | None = None, routes: DataFrame | None = None,
) -> DataFrame:
    """All findings of the named detectors (default: DEFAULT and those registered; with ``objectives`` also scope drift), with a
    ``finding_id``; ``params`` has parameters by detector.

    ``thresholds`` (conv_id, detector, parameter, value) has those of SETTABLE that a conversation sets for itself. With
    ``routes`` (conv_id, detector) a detector reads only the conversations routed to it."""
    params = params or {}
    names = tuple(detectors) if detectors else (*DEFAULT, *[n for n in REGISTRY if n not in DEFAULT])
    every = (*names, "scope_drift") if objectives is not None and "scope_drift" not in names else names
    if thresholds is not None or routes is not None:
        turns = turns.join(settings(every, thresholds, routes), "conv_id", "left")
    own = _own_fields(turns)

    def read_by(name: str) -> DataFrame:
        runs = _runs_in(name, own)
        return turns if runs is None else turns.where(runs)

    parts = [run(turns, {n: params.get(n, {}) for n in names if n in SIGNALS})] if any(n in SIGNALS for n in names) else []
    parts += [REGISTRY[n](read_by(n), **_params(n, params.get(n, {}), own)) for n in names if n in REGISTRY]
    if objectives is not None:
        parts.append(scope_drift(read_by("scope_drift"), objectives, **_params("scope_drift", params.get("scope_drift", {}), own)))
    out = parts[0].select(*FINDING)
    for found in parts[1:]:
        out = out.unionByName(found.select(*[c for c in FINDING if c in found.columns]), allowMissingColumns=True)
    return out.withColumn("finding_id", T.finding_id(F.col("detector_name"), F.col("relevant_turns")))
