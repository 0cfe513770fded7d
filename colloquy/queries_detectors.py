"""Queries over gates, context features and detectors, with their SQL.

Conversations of the test tables are short, so some queries pass smaller limits than the defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy import oracle as O
from colloquy.functions import text as T
from colloquy.operators import context as C
from colloquy.operators import detectors as D
from colloquy.operators import fuzzy as Z
from colloquy.plans.settle import featured
from colloquy.queries_text import _TRI, LONG, OBJECTIVES, objectives, trigram_profiles
from colloquy.sources import turns as S

QUERIES, ORACLE = {}, {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def of_turns(name: str, make: Callable[[DataFrame], DataFrame], sql: str, long: bool = False) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns = S.seeded_turns(spark, sf_dir)
        return rounded(make(S.long_turns(turns) if long else turns))

    QUERIES[name], ORACLE[name] = query, sql


def member_sql(x: str, shape: Z.Shape) -> str:
    a, b, c, d = Z.corners(shape)
    rise = "1.0" if a == b else f"({x} - {a}::DOUBLE) / {b - a}::DOUBLE"
    fall = "1.0" if c == d else f"({d}::DOUBLE - {x}) / {d - c}::DOUBLE"
    return f"(CASE WHEN {x} < {a} OR {x} > {d} THEN 0.0 WHEN {x} < {b} THEN {rise} WHEN {x} <= {c} THEN 1.0 ELSE {fall} END)::DOUBLE"


def fuzzy_sql(source: str, name: str, rules: Z.FuzzySet, inputs: tuple[str, ...], key: str = "conv_id") -> str:
    """The table ``name``: the columns of ``source`` and their fuzzy score; ``inputs`` are SQL for the inputs of the rules, in their order."""
    of = dict(zip(rules.inputs, inputs))
    cuts: dict[str, list[str]] = {}
    for conditions, term, weight in rules.rules:
        parts = [member_sql(of[v], rules.inputs[v][t]) for v, t in conditions.items()]
        cuts.setdefault(term, []).append(f"{f'least({', '.join(parts)})' if len(parts) > 1 else parts[0]} * {weight}::DOUBLE")
    cut = ", ".join(f"greatest({', '.join(v)}) AS c_{k}" for k, v in cuts.items())
    height = f"greatest({', '.join(f'least(c_{k}, ' + member_sql('x', rules.output[k]) + ')' for k in cuts)})"
    return f"""{name}_c AS (SELECT {key}, {cut} FROM {source}), {name}_s AS (SELECT {key}, sum({height} * x) / nullif(sum({height}), 0) AS score FROM {name}_c, (SELECT i / 200.0::DOUBLE AS x FROM range(201) r(i)) GROUP BY {key}),
{name} AS (SELECT s_.*, score FROM {source} s_ JOIN {name}_s USING ({key}))"""


# Gates and context.
of_turns("validate_format", lambda t: C.validate_format(t, max_turns=6, max_bytes=6000), f"""{O.base()} SELECT conv_id, count(*) AS n_turns, sum(strlen(raw_text) + strlen(speaker))::BIGINT AS n_bytes,
CASE WHEN count(*) > 6 THEN 'too_many_turns' WHEN sum(strlen(raw_text) + strlen(speaker)) > 6000 THEN 'too_large' END AS reason FROM turns GROUP BY conv_id""")


def bytes_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns as bytes, broken in one conversation of seven, none in one of five; all conversations, with a long objective in one of three)."""
    raw = F.encode("raw_text", "UTF-8")
    rows = turns.where("conv_id % 5 <> 0").withColumn("raw_text", F.when(F.col("conv_id") % 7 == 0, F.concat(raw, F.unhex(F.lit("C328")))).otherwise(raw))
    return rows, turns.select("conv_id").distinct().withColumn("objective", F.when(F.col("conv_id") % 3 == 0, F.repeat(F.lit("goal "), 1200)))


def validate_bytes(turns: DataFrame) -> DataFrame:
    rows, conversations = bytes_of(turns)
    return C.validate_format(rows, max_turns=6, max_bytes=6000, conversations=conversations)


of_turns("validate_bytes", validate_bytes, f"""{O.base()}, vb AS (
  SELECT conv_id, count(*) FILTER (conv_id % 5 <> 0) AS n_turns, (coalesce(sum(strlen(raw_text) + strlen(speaker) + CASE WHEN conv_id % 7 = 0 THEN 2 ELSE 0 END) FILTER (conv_id % 5 <> 0), 0) + CASE WHEN conv_id % 3 = 0 THEN 6000 ELSE 0 END)::BIGINT AS n_bytes FROM turns GROUP BY conv_id)
SELECT *, CASE WHEN n_turns = 0 THEN 'no_turns' WHEN n_turns > 6 THEN 'too_many_turns' WHEN n_bytes > 6000 THEN 'too_large' WHEN conv_id % 7 = 0 THEN 'not_utf8' END AS reason FROM vb""")
_terms = ", ".join(f"CASE WHEN max({O.bounded('low', t)}::INTEGER) = 1 THEN {O.lit(t)} END" for t in L.BLOCKLIST)
of_turns("screen_toxicity", C.screen_toxicity, f"""{O.base()} SELECT conv_id, array_to_string(list_filter(m, lambda x: x IS NOT NULL), '|') AS matched, round(len(list_filter(m, lambda x: x IS NOT NULL))::DOUBLE / {len(L.BLOCKLIST)}::DOUBLE, 6) AS score
FROM (SELECT conv_id, [{_terms}] AS m FROM lowt GROUP BY conv_id)""")
_tok = O.tokens("low")
GAIN = f"""gt AS (
  SELECT conv_id, speaker, len({O.words('raw_text')}) AS words, low, raw_text, {_tok} AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn_number DESC) AS back FROM lowt),
gs AS (
  SELECT conv_id, count(*)::DOUBLE AS turns, count(DISTINCT speaker)::DOUBLE AS speakers, avg(words) AS words,
    sum({O.hits('low', (*L.FORMAL, *L.CLASSICAL_FORMAL))} + (words > 25)::INTEGER + (words > 50)::INTEGER + (len(regexp_extract_all(raw_text, ';')) >= 2)::INTEGER
      + {O.any_of('low', L.RHETORICAL)}::INTEGER)::DOUBLE AS formal,
    sum({O.hits('low', L.INFORMAL)} + (words BETWEEN 1 AND 7)::INTEGER + {O.any_of('low', L.CONTRACTIONS)}::INTEGER + contains(raw_text, '!')::INTEGER)::DOUBLE AS informal,
    sum(CASE WHEN back <= 5 THEN len(list_filter(tok, lambda t: list_contains({O.strings(L.URGENT)}, t)))
      + 2 * len(list_filter(tok, lambda t: list_contains({O.strings(L.STAKES)}, t))) ELSE 0 END)::DOUBLE AS pressing
  FROM gt GROUP BY conv_id),
gain AS (
  SELECT conv_id, {O.clamp('0.15::DOUBLE + pressing / 10.0::DOUBLE')} AS urgency,
    {O.clamp('turns / 10.0::DOUBLE * 0.4::DOUBLE + speakers / 5.0::DOUBLE * 0.2::DOUBLE + words / 200.0::DOUBLE * 0.4::DOUBLE')} AS complexity,
    CASE WHEN formal + informal = 0 THEN 0.5::DOUBLE ELSE formal / (formal + informal) END AS formality FROM gs)"""
_round = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
of_turns("gain", C.gain, f"{O.base(GAIN)} SELECT conv_id, {_round('urgency', 'complexity', 'formality')}, CASE WHEN urgency > 0.6 THEN 'PHASIC' ELSE 'TONIC' END AS mode FROM gain")
for _n in ("urgency", "complexity", "formality"):
    of_turns(_n, lambda t, n=_n: C.gain(t).select("conv_id", n), f"{O.base(GAIN)} SELECT conv_id, {_round(_n)} FROM gain")


def gain_enriched(turns: DataFrame) -> DataFrame:
    gains = C.gain(turns)
    return C.gain_enriched(gains, gains.where("conv_id % 2 = 0").select("conv_id", F.when(F.col("conv_id") % 4 == 0, 0.9).otherwise(0.0).alias("enriched")))


of_turns("gain_enriched", gain_enriched, f"""{O.base(GAIN)} SELECT conv_id, {_round('urgency', 'complexity')}, round(CASE WHEN conv_id % 4 = 0 THEN 0.7::DOUBLE * 0.9::DOUBLE + 0.3::DOUBLE * formality ELSE formality END, 6) AS formality,
CASE WHEN urgency > 0.6 THEN 'PHASIC' ELSE 'TONIC' END AS mode FROM gain""")
OFFSET = f"offsets AS (SELECT conv_id, {O.clamp('-0.6::DOUBLE * urgency + 0.3::DOUBLE * (1 - formality) - 0.1::DOUBLE * complexity', '-0.15', '0.15')} AS offset_ FROM gain)"
of_turns("modulate", lambda t: C.modulate(C.gain(t)), f'{O.base(GAIN, OFFSET)} SELECT conv_id, round(offset_, 6) AS "offset" FROM offsets')
of_turns("apply_offset", lambda t: C.apply_offset(C.modulate(C.gain(t)), {"anchoring": 0.23, "contradiction": 0.77}), f"{O.base(GAIN, OFFSET)} SELECT conv_id, d AS detector, round(b * (1 + offset_), 6) AS threshold FROM offsets, (VALUES ('anchoring', 0.23::DOUBLE), ('contradiction', 0.77::DOUBLE)) v(d, b)")
_score = O.clamp("0.4::DOUBLE * urgency + 0.4::DOUBLE * complexity + 0.2::DOUBLE * formality")
LEVEL = "levels AS (SELECT conv_id, (CASE WHEN round(urgency, 9) >= 0.65 THEN 3 WHEN round(urgency, 9) >= 0.35 THEN 2 ELSE 1 END)::INTEGER AS level FROM gain)"
of_turns("activation_level", lambda t: C.activation_level(C.gain(t)).drop("label"), f"{O.base(GAIN, LEVEL)} SELECT conv_id, round({_score}, 6) AS score, level FROM gain JOIN levels USING (conv_id)")
of_turns("complexity_hint", lambda t: C.activation_level(C.gain(t)).select("conv_id", T.hundredths(F.round("score", 6)).alias("label")), f"{O.base(GAIN)} SELECT conv_id, printf('%.2f', round({_score}, 6)) AS label FROM gain")
URG = fuzzy_sql("gain", "urg", Z.URGENCY, ("urgency", "complexity", "formality"))
of_turns("gain_fuzzy", lambda t: C.gain_fuzzy(C.gain(t)), f"""{O.base(GAIN, URG)} SELECT conv_id, round(coalesce(score, urgency), 6) AS urgency, {_round('complexity', 'formality')},
CASE WHEN round(coalesce(score, urgency), 9) > 0.6 THEN 'PHASIC' ELSE 'TONIC' END AS mode FROM urg""")


def classical_sql(more: tuple[str, ...]) -> str:
    known = O.strings(dict.fromkeys((*L.CLASSICAL_FORMAL, *more)))
    return f"""cm AS (SELECT conv_id, unnest(list_filter({known}, lambda p_: contains(plain_, p_))) AS m FROM lowt), cd AS (SELECT conv_id, count(DISTINCT m) AS k FROM cm GROUP BY conv_id),
cl AS (SELECT c.conv_id, coalesce(k, 0)::INTEGER AS n_markers, coalesce(k, 0) >= 2 AS classical FROM (SELECT DISTINCT conv_id FROM lowt) c LEFT JOIN cd ON c.conv_id = cd.conv_id)"""


for _name, _more in (("classical_text", ()), ("classical_text_sunk_cost", L.CLASSICAL_COST), ("classical_text_confidence", L.CLASSICAL_CONFIDENCE)):
    of_turns(_name, lambda t, m=_more: C.classical_text(t, more=m), f"{O.base(classical_sql(_more))} SELECT conv_id, n_markers, classical FROM cl")
ROUTE = f"""rc AS (
  SELECT conv_id, count(*) AS turns, count(*) FILTER (said) AS assistant, sum(len({O.numbers('raw_text')})) AS numbers, count(*) FILTER (len({O.numbers('raw_text')}) > 0) AS number_turns,
    count(*) FILTER ({O.any_of('plain_', L.ROUTE_COST)}) AS cost, count(*) FILTER ({O.any_of('plain_', L.ROUTE_DECISION)}) AS decisions,
    count(*) FILTER (turn_number <= 3 AND {O.declarative('raw_text')}) AS early_declarative, count(*) FILTER ({O.any_of('plain_', L.ROUTE_AUTHORITY)}) AS authority,
    CASE WHEN count(*) FILTER (speaker = 'user') > 0 THEN 1 ELSE 0 END AS objectives
  FROM lowt GROUP BY conv_id)"""
ROUTED = "routed AS (" + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS detector, {O.lit(why)} AS reason FROM rc WHERE {rule}" for k, (rule, why) in C.ROUTES.items()) + ")"
of_turns("route", lambda t: C.route(t, objectives(t)), f"{O.base(ROUTE, ROUTED)} SELECT * FROM routed")
RUNS_AT = "detector IN ('scope_drift', 'contradiction') OR level = 3 OR (level = 2 AND detector NOT IN ('inherited_position', 'conceptual_anchoring'))"
of_turns("activated", lambda t: C.activated(C.route(t, objectives(t)), C.activation_level(C.gain(t))), f"{O.base(ROUTE, ROUTED, GAIN, LEVEL)} SELECT conv_id, detector, reason FROM routed JOIN levels USING (conv_id) WHERE {RUNS_AT}")


def domains(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 3 == 0, "classical").when(F.col("conv_id") % 3 == 1, "code-review").otherwise("other").alias("domain"), ((F.col("conv_id") % 5) / F.lit(5.0)).alias("confidence"))


of_turns("domain_thresholds", lambda t: C.domain_thresholds(domains(t)), """WITH d AS (SELECT DISTINCT conv_id, conv_id % 3 = 0 AND (conv_id % 5) / 5.0::DOUBLE > 0.6 AS c, conv_id % 3 = 1 AND (conv_id % 5) / 5.0::DOUBLE > 0.6 AS r FROM conversations)
SELECT conv_id, (CASE WHEN c THEN 0.7 WHEN r THEN 0.85 ELSE 0.79 END)::DOUBLE AS drift, (CASE WHEN c THEN 4 WHEN r THEN 3 ELSE 8 END)::INTEGER AS sustained, (CASE WHEN c THEN 0.35 ELSE 0.15 END)::DOUBLE AS anchor, NOT (c OR r) AS numeric_anchoring, CASE WHEN c THEN 'unfiltered' ELSE 'inhibited' END AS variant FROM d""")
of_turns("orchestration_mode", lambda t: C.orchestration_mode(t, more_than=4), f"""{O.base()} SELECT conv_id, o AS orchestrating, round(CASE WHEN o THEN least(0.79::DOUBLE * 1.2::DOUBLE, 0.98::DOUBLE) ELSE 0.79::DOUBLE END, 6) AS drift
FROM (SELECT conv_id, count(*) > 4 AND sum({O.any_of('plain_', L.PROJECT)}::INTEGER) >= 3 AS o FROM lowt GROUP BY conv_id)""")
of_turns("orchestration_mode_long", C.orchestration_mode, f"""{O.base(LONG)} SELECT conv_id, o AS orchestrating, round(CASE WHEN o THEN least(0.79::DOUBLE * 1.2::DOUBLE, 0.98::DOUBLE) ELSE 0.79::DOUBLE END, 6) AS drift
FROM (SELECT conv_id, count(*) > 8 AND sum({O.any_of('lower(raw_text)', L.PROJECT)}::INTEGER) >= 3 AS o FROM longt GROUP BY conv_id)""", long=True)


def language_profiles(docs: DataFrame, size: int = 800) -> DataFrame:
    """Each language's ``size`` most frequent trigrams, as shares of 1."""
    order = Window.partitionBy("lang").orderBy(F.round("freq", 12).desc(), "trigram")
    top = trigram_profiles(docs).withColumn("k", F.row_number().over(order)).where(F.col("k") <= size)
    return top.select("lang", "trigram", (F.col("freq") / F.sum("freq").over(Window.partitionBy("lang"))).alias("freq"))


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = language_profiles(spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null"))
    return rounded(C.detect_language(S.seeded_turns(spark, sf_dir), profiles))


QUERIES["detect_language"] = detect_language
LANG = f"""{_TRI.replace("WHERE length(text) >= 3", "WHERE length(text) >= 3 AND lang IS NOT NULL")},
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(freq, 12) DESC, trigram) AS k FROM profile), pr AS (SELECT lang, trigram, freq / sum(freq) OVER (PARTITION BY lang) AS freq FROM top WHERE k <= 800), pn AS (SELECT lang, sqrt(sum(freq * freq)) AS norm FROM pr GROUP BY lang),
us AS (SELECT *, coalesce(sum(length(raw_text) + 1) OVER (PARTITION BY conv_id ORDER BY turn_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM turns),
sm AS (SELECT conv_id, lower(trim(left(string_agg(left(raw_text, 2000), ' ' ORDER BY turn_number), 2000))) AS sample FROM us WHERE used < 2000 GROUP BY conv_id),
sg AS (SELECT conv_id, unnest(list_transform(range(1, length(sample) - 1), lambda i: substr(sample, i, 3))) AS trigram FROM sm WHERE length(sample) >= 20), sn AS (SELECT conv_id, trigram, count(*)::DOUBLE AS n FROM sg GROUP BY ALL),
sz AS (SELECT conv_id, sum(n) AS total, sqrt(sum(n * n)) AS own FROM sn GROUP BY conv_id), mt AS (SELECT conv_id, pr.lang, sum(n * freq) AS dot, sum(n) AS n FROM sn JOIN pr ON sn.trigram = pr.trigram GROUP BY ALL),
ls AS (SELECT mt.conv_id, mt.lang, least(0.4::DOUBLE * sqrt(dot / (own * norm)) + 0.6::DOUBLE * n / total, 1.0::DOUBLE) AS score FROM mt JOIN sz ON mt.conv_id = sz.conv_id JOIN pn ON mt.lang = pn.lang),
lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, lang) AS rn FROM ls) WHERE rn = 1)"""
ORACLE["detect_language"] = f"""{O.base(LANG)} SELECT sm.conv_id, CASE WHEN length(sample) < 20 THEN 'en' ELSE coalesce(lang, '') END AS language, round(CASE WHEN length(sample) < 20 THEN 0.5::DOUBLE ELSE coalesce(score, 0) END, 6) AS confidence,
length(sample) < 20 OR (coalesce(lang, '') = 'en' AND round(coalesce(score, 0), 9) >= 0.55) AS supported FROM sm LEFT JOIN lb ON sm.conv_id = lb.conv_id"""


# Detectors.
def found(kind: str, severity: str, confidence: str, name: str, turns: str, source: str, where: str = "true") -> str:
    kind = kind if kind.startswith("CASE") else O.lit(kind)
    return f"SELECT conv_id, {kind} AS finding_type, ({severity})::INTEGER AS severity, round(({confidence})::DOUBLE, 6) AS confidence, '{name}' AS detector_name, ({turns})::VARCHAR AS relevant_turns FROM {source} WHERE {where}"


FIRST = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS rn FROM {source})"


def of_detector(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda turns: make(turns).select(*D.FINDING[:6])


NUM = f"""nl AS (SELECT conv_id, turn_number, unnest({O.numbers('raw_text')}) AS t FROM turns), n AS (SELECT conv_id, turn_number, t.value AS value, t.position AS position, t.context AS context FROM nl),
anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_number, position) AS k FROM n) WHERE k = 1),
ap AS (
  SELECT n.*, a.turn_number AS at_, a.context AS acontext, a.value AS avalue, abs(n.value - a.value) / greatest(abs(a.value), 1.0::DOUBLE) AS shift
  FROM n JOIN anchor a ON n.conv_id = a.conv_id WHERE n.turn_number > a.turn_number)"""
_sev_a = "CASE WHEN shift / 0.15::DOUBLE < 0.3 THEN 3 WHEN shift / 0.15::DOUBLE < 0.7 THEN 2 ELSE 1 END"
of_turns("anchoring", of_detector(D.anchoring), f"""{O.base(NUM)} {found('ANCHORING_BIAS', _sev_a, '1 - shift / 0.15::DOUBLE', 'anchoring', 'at_ || chr(32) || turn_number',
    FIRST.format(order='turn_number, position', source='(SELECT * FROM ap WHERE shift < 0.15::DOUBLE)'), 'rn = 1')}""")
_bare = rf"list_transform({O.words('lower(@)')}, lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))"
_kw = lambda x: O.distinct(f"list_filter({_bare.replace('@', x)}, lambda w: strlen(w) >= 3 AND NOT list_contains({O.strings(L.STOPWORDS)}, w))")
AC = f"""ak AS (SELECT *, {_kw('context')} AS ka, {_kw('acontext')} AS kb FROM ap WHERE shift < 0.15::DOUBLE), asim AS (SELECT *, {O.jaccard('ka', 'kb', '1.0')} AS sim FROM ak),
ac AS (SELECT *, (1 - shift / 0.15::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * sim) AS c FROM asim WHERE sim >= 0.02)"""
ANC = f"""{found('ANCHORING_BIAS', _sev_a, 'c', 'anchoring_context', 'at_ || chr(32) || turn_number', FIRST.format(order='round(c, 9) DESC, turn_number, position', source='ac'), 'rn = 1')}"""
of_turns("anchoring_context", of_detector(lambda t: D.anchoring_context(t, least=0.02)), f"{O.base(NUM, AC)} {ANC}")


def references(turns: DataFrame) -> DataFrame:
    """What an outside model might hold as anchors: two values, one for each half of the conversations."""
    rows = turns.select("conv_id").distinct()
    return rows.select("conv_id", F.when(F.col("conv_id") % 2 == 0, 1200.0).otherwise(3.0).alias("value"), F.when(F.col("conv_id") % 4 == 0, 0.9).otherwise(0.2).alias("relevance"))


of_turns("anchoring_ml", of_detector(lambda t: D.anchoring_ml(t, references(t), least=0.02)), f"""{O.base(NUM, AC)} SELECT conv_id, 'ANCHORING_BIAS' AS finding_type, ({_sev_a})::INTEGER AS severity,
round(CASE WHEN conv_id % 4 = 0 AND avalue = 1200.0 THEN least(c + 0.1::DOUBLE, 1.0::DOUBLE) ELSE c END, 6) AS confidence, 'anchoring_context' AS detector_name, at_ || ' ' || turn_number AS relevant_turns
FROM {FIRST.format(order='round(c, 9) DESC, turn_number, position', source='ac')} WHERE rn = 1""")


def cost_sql(continuations: tuple[str, ...]) -> str:
    return f"""cp AS (SELECT conv_id, turn_number, {O.first_of('low', L.COST)} AS cost, {O.any_of('low', continuations)} AS go_on FROM lowt),
pairs AS (
  SELECT a.conv_id, a.turn_number AS at_, b.turn_number AS on_, b.turn_number - a.turn_number AS gap, a.cost
  FROM cp a JOIN cp b ON a.conv_id = b.conv_id AND b.turn_number >= a.turn_number WHERE a.cost IS NOT NULL AND b.go_on),
based AS (
  SELECT *, least(0.5::DOUBLE + CASE WHEN gap > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN gap <= 2 THEN 0.15::DOUBLE ELSE 0 END
    + CASE WHEN list_contains({O.strings(L.STRONG_COST)}, cost) THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS base, base / (1 + 0.3::DOUBLE * gap) AS c FROM pairs)"""


COST = cost_sql(L.CONTINUATION)
_sev_c = "CASE WHEN {0} >= 0.8 THEN 3 WHEN {0} >= 0.6 THEN 2 ELSE 1 END"
of_turns("sunk_cost", of_detector(D.sunk_cost), f"""{O.base(COST)} {found('SUNK_COST_FALLACY', _sev_c.format('base'), 'base', 'sunk_cost', 'at_ || chr(32) || on_',
    FIRST.format(order='at_, on_', source='(SELECT * FROM based WHERE base >= 0.5)'), 'rn = 1')}""")
of_turns("sunk_cost_proximity", of_detector(D.sunk_cost_proximity), f"""{O.base(cost_sql((*L.CONTINUATION, *L.MORE_CONTINUATION)))} {found('SUNK_COST_FALLACY', _sev_c.format('c'), 'c', 'sunk_cost_proximity', 'at_ || chr(32) || on_',
    FIRST.format(order='round(c, 9) DESC, at_, on_', source='(SELECT * FROM based WHERE round(c, 9) >= 0.3)'), 'rn = 1')}""")
_strip = lambda w: f"trim({w}, {O.lit('.,!?;:' + chr(34) + chr(39) + '()-')})"
_around = "array_to_string(@t[greatest(i_ - 5, 1):i_ + 5], ' ')"
_near = lambda t: f"len(list_filter({t}, lambda w_, i_: list_contains(sh, {_strip('w_')}) AND contains({_around.replace('@t', t)}, no))) > 0"
SENT = f"""s0 AS (SELECT conv_id, speaker, turn_number, {O.sentences('low')} AS ss FROM lowt), s1 AS (SELECT conv_id, speaker, turn_number, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM s0),
s2 AS (SELECT *, {O.words('s')} AS t FROM s1 WHERE strlen(s) >= 15), s3 AS (SELECT *, list_distinct(list_filter(list_transform(t, lambda w: {_strip('w')}), lambda w: w <> '')) AS a_ FROM s2),
st AS (SELECT *, list_filter(a_, lambda x: NOT list_contains({O.strings(L.STOP_OVERLAP)}, x)) AS w FROM s3),
sp AS (
  SELECT a.conv_id, a.turn_number AS ta, a.pos AS pa, b.turn_number AS tb, b.pos AS pb, a.s AS sa, b.s AS sb, a.t AS toka, b.t AS tokb, a.a_ AS aa, b.a_ AS ab,
    len(list_intersect(a.w, b.w))::DOUBLE / nullif(least(len(a.w), len(b.w)), 0)::DOUBLE AS ov,
    list_filter(list_intersect(a.a_, b.a_), lambda x: strlen(x) > 2 AND NOT list_contains({O.strings(L.STOP_OVERLAP)}, x)) AS sh
  FROM st a JOIN st b ON a.conv_id = b.conv_id AND a.speaker = b.speaker AND a.turn_number < b.turn_number),
sn AS (SELECT *, unnest({O.strings(L.NEGATIONS)}) AS no FROM sp WHERE ov >= 0.6),
sd AS (SELECT conv_id, ta, pa, tb, pb, bool_or(CASE WHEN contains(sa, no) = contains(sb, no) THEN false WHEN contains(sa, no) THEN {_near('toka')} ELSE {_near('tokb')} END) AS denied FROM sn GROUP BY ALL),
sc AS (
  SELECT sp.*, CASE WHEN denied THEN 'negation' WHEN {O.any_of('sb', L.REVERSALS)} THEN 'reversal'
    WHEN {' OR '.join(f"(list_contains(aa, '{x}') AND list_contains(ab, '{y}')) OR (list_contains(aa, '{y}') AND list_contains(ab, '{x}'))" for x, y in L.ANTONYMS)} THEN 'antonym' END AS kind,
    CASE kind WHEN 'negation' THEN 0.15::DOUBLE WHEN 'reversal' THEN 0.12::DOUBLE ELSE 0.08::DOUBLE END AS bonus, least(0.65::DOUBLE + 0.2::DOUBLE * ov + bonus, 1.0::DOUBLE) AS c
  FROM sp JOIN sd USING (conv_id, ta, pa, tb, pb))"""
CTR = FIRST.format(order="ta, pa, tb, pb", source="(SELECT * FROM sc WHERE kind IS NOT NULL AND round(c, 9) >= 0.75)")
of_turns("contradiction", of_detector(D.contradiction), f"{O.base(SENT)} {found('CONTRADICTION', 'CASE WHEN c >= 0.8 THEN 4 ELSE 3 END', 'c', 'contradiction', 'ta || chr(32) || tb', CTR, 'rn = 1')}")
_stop = f"lowt_ AS (SELECT * FROM lowt WHERE NOT (speaker = 'user' AND {O.any_of('low', L.OVERRIDE)}))"
of_turns("contradiction_with_overrides", of_detector(lambda t: D.contradiction(S.user_override(t))), f"{O.base(_stop, SENT.replace('FROM lowt)', 'FROM lowt_)'))} {found('CONTRADICTION', 'CASE WHEN c >= 0.8 THEN 4 ELSE 3 END', 'c', 'contradiction', 'ta || chr(32) || tb', CTR, 'rn = 1')}")
_topic = lambda side, word: ", ".join(f"sum({side} * {w}) AS {side}_{i}" for i, w in enumerate(O.topic_totals(f"[{word}]")))
_n = range(len(L.TOPICS))
_least, _most = (" + ".join(f"{f}(c_{i}, g_{i})" for i in _n) for f in ("least", "greatest"))
_silent = " OR ".join(f"greatest({', '.join(f'{side}_{i}' for i in _n)}) = 0" for side in "cg")
DRIFT = f"""@long@obj AS (
  SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE min_by(raw_text, turn_number) END AS raw_text, 0 AS turn_number, '' AS speaker FROM @t@ WHERE speaker = 'user' GROUP BY conv_id),
{O.keywords_cte('dk', '@t@')}, {O.keywords_cte('ok', 'obj')},
kw AS (SELECT conv_id, turn_number, unnest(k) AS w FROM dk WHERE conv_id IN (SELECT conv_id FROM ok WHERE len(k) > 0)),
ref AS (SELECT conv_id, w, sum(n) AS r, 1.0::DOUBLE + max(o) AS g FROM (SELECT conv_id, w, 1.0::DOUBLE AS n, 0.0::DOUBLE AS o FROM kw WHERE turn_number <= @ref@ UNION ALL SELECT conv_id, unnest(k), 2.0::DOUBLE, 1.0::DOUBLE FROM ok) GROUP BY ALL),
tot AS (SELECT conv_id, sum(r) AS sr, {_topic('g', 'w')} FROM ref GROUP BY conv_id),
own AS (SELECT t.conv_id, t.turn_number, k.w, count(*)::DOUBLE AS c FROM @t@ t JOIN kw k ON k.conv_id = t.conv_id AND k.turn_number BETWEEN t.turn_number - 3 AND t.turn_number GROUP BY ALL),
bo AS (SELECT o.conv_id, o.turn_number, sum(least(c, coalesce(r, 0.0))) AS b, sum(c) AS sc, {_topic('c', 'o.w')} FROM own o LEFT JOIN ref ON o.conv_id = ref.conv_id AND o.w = ref.w GROUP BY ALL),
dd AS (
  SELECT bo.conv_id, bo.turn_number, CASE WHEN {_silent} THEN 1 - b / (sc + sr - b) ELSE greatest(1 - b / (sc + sr - b), 1 - ({_least}) / ({_most})) END AS distance
  FROM bo JOIN tot ON bo.conv_id = tot.conv_id WHERE bo.turn_number > @ref@)"""


def drift_sql(before: str, source: str, reference: int = 4) -> str:
    return DRIFT.replace("@long@", before).replace("@t@", source).replace("@ref@", str(reference))


def runs_sql(source: str, value: str, over: float, k: int, scale: float = 1.0) -> str:
    return f"""df AS (SELECT *, round({value}, 9) > {over} AS far FROM {source}), dr AS (SELECT *, sum((NOT far)::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn_number) AS run FROM df),
dn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn_number) AS k FROM dr WHERE far),
dg AS (SELECT conv_id, least(max({value}) / {scale}::DOUBLE, 1.0::DOUBLE) AS d, string_agg(turn_number::VARCHAR, ' ' ORDER BY turn_number) AS t FROM dn WHERE k >= {k} GROUP BY conv_id)"""


of_turns("drift_distances", lambda t: D.drift_distances(t, objectives(t)), f"{O.base(drift_sql('', 'turns'))} SELECT conv_id, turn_number, round(distance, 6) AS distance FROM dd")
_sev_d = "CASE WHEN round(d, 9) >= 0.95 THEN 4 WHEN round(d, 9) >= 0.85 THEN 3 WHEN round(d, 9) >= 0.75 THEN 2 ELSE 1 END"
of_turns("scope_drift", of_detector(lambda t: D.scope_drift(t, objectives(t), sustained=2, reference_turns=2)), f"{O.base(drift_sql('', 'turns', 2), runs_sql('dd', 'distance', 0.79, 2))} {found('SCOPE_DRIFT', _sev_d, 'd', 'scope_drift', 't', 'dg')}")
of_turns("scope_drift_long", of_detector(lambda t: D.scope_drift(t, objectives(t))), f"{O.base(drift_sql(LONG + ', ', 'longt'), runs_sql('dd', 'distance', 0.79, 8))} {found('SCOPE_DRIFT', _sev_d, 'd', 'scope_drift', 't', 'dg')}", long=True)
KLD = """kg AS (SELECT o.conv_id, o.turn_number, ref.w, ref.r, 0.0::DOUBLE AS c FROM (SELECT DISTINCT conv_id, turn_number FROM own) o JOIN ref ON o.conv_id = ref.conv_id UNION ALL SELECT conv_id, turn_number, w, 0.0, c FROM own),
ku AS (SELECT conv_id, turn_number, w, sum(r) + 0.01::DOUBLE AS r, sum(c) + 0.01::DOUBLE AS c FROM kg GROUP BY ALL), kz AS (SELECT *, r / sum(r) OVER z AS p, c / sum(c) OVER z AS q FROM ku WINDOW z AS (PARTITION BY conv_id, turn_number)),
kd AS (SELECT conv_id, turn_number, sum(p * ln(p / q)) AS kl FROM kz WHERE turn_number > @ref@ AND conv_id IN (SELECT conv_id FROM ref) GROUP BY ALL)"""
_all_kw = lambda q: q.replace(" WHERE conv_id IN (SELECT conv_id FROM ok WHERE len(k) > 0)", "")
of_turns("drift_divergences", lambda t: D.drift_divergences(t, objectives(t)), f"{O.base(_all_kw(drift_sql('', 'turns')), KLD.replace('@ref@', '4'))} SELECT conv_id, turn_number, round(kl, 6) AS kl FROM kd")
of_turns("scope_drift_kl", of_detector(lambda t: D.scope_drift_kl(t, objectives(t))), f"{O.base(_all_kw(drift_sql(LONG + ', ', 'longt')), KLD.replace('@ref@', '4'), runs_sql('kd', 'kl', 2.0, 5, 4.0))} {found('SCOPE_DRIFT', _sev_d, 'd', 'scope_drift_kl', 't', 'dg')}", long=True)


def enrichment(turns: DataFrame) -> DataFrame:
    """What an outside model might say: continuation phrases of two turns of three, formality of some."""
    phrases = T.once(T.lowered(F.col("raw_text")), lambda t: F.filter(T.listed(L.CONTINUATION), lambda p: F.contains(t, p)))
    formality = F.when(F.col("turn_number") % 2 == 0, (F.col("conv_id") % 5) / F.lit(10.0) + F.col("turn_number") / F.lit(20.0))
    return turns.select("conv_id", "turn_number", F.when(F.col("turn_number") % 3 != 0, phrases).alias("phrases"), formality.alias("formality"))


ENR = f"""en AS (
  SELECT conv_id, turn_number, CASE WHEN turn_number % 3 <> 0 THEN list_filter({O.strings(L.CONTINUATION)}, lambda p: contains(low, p)) END AS phrases,
    CASE WHEN turn_number % 2 = 0 THEN (conv_id % 5) / 10.0::DOUBLE + turn_number / 20.0::DOUBLE END AS formality FROM lowt),
em AS (
  SELECT conv_id, coalesce(string_agg(array_to_string(phrases, ' '), ' ' ORDER BY turn_number) FILTER (len(phrases) > 0), '') AS phrases,
    arg_max(formality, turn_number) FILTER (formality IS NOT NULL) AS formality FROM en GROUP BY conv_id)"""
of_turns("merge_enrichment", lambda t: D.merge_enrichment(enrichment(t)), f"{O.base(ENR)} SELECT conv_id, phrases, round(formality, 6) AS formality FROM em")


def boosted_sql(own: str, told: str, kind: str, name: str) -> str:
    """Findings joined with (conv_id, confirms, alone)."""
    return f"""WITH f AS ({own}), e AS ({told}) SELECT coalesce(f.conv_id, e.conv_id) AS conv_id, '{kind}' AS finding_type, coalesce(severity, 1)::INTEGER AS severity,
round(CASE WHEN f.conv_id IS NULL THEN 0.4::DOUBLE WHEN coalesce(confirms, false) THEN least(confidence + 0.1::DOUBLE, 1.0::DOUBLE) ELSE confidence END, 6) AS confidence,
'{name}' AS detector_name, coalesce(relevant_turns, '') AS relevant_turns FROM f FULL JOIN e ON f.conv_id = e.conv_id WHERE f.conv_id IS NOT NULL OR alone"""


of_turns("sunk_cost_ml", of_detector(lambda t: D.sunk_cost_ml(t, enrichment(t))), boosted_sql(ORACLE["sunk_cost"], f"{O.base(ENR)} SELECT conv_id, true AS confirms, true AS alone FROM em WHERE phrases <> ''", "SUNK_COST_FALLACY", "sunk_cost"))


def drift_orchestrated(turns: DataFrame) -> DataFrame:
    turns = featured(turns, "keywords")
    return D.scope_drift(turns, objectives(turns), sustained=2, reference_turns=2, orchestrating=C.orchestration_mode(turns, more_than=4).where("orchestrating"))


of_turns("scope_drift_orchestrated", of_detector(drift_orchestrated),
    f"""{O.base(drift_sql('', 'turns', 2), f"om AS (SELECT conv_id FROM lowt GROUP BY conv_id HAVING count(*) > 4 AND sum({O.any_of('plain_', L.PROJECT)}::INTEGER) >= 3)",
    runs_sql('dd', 'distance', "CASE WHEN conv_id IN (SELECT conv_id FROM om) THEN least(0.79::DOUBLE * 1.2::DOUBLE, 0.98::DOUBLE) ELSE 0.79::DOUBLE END", 2))} {found('SCOPE_DRIFT', _sev_d, 'd', 'scope_drift', 't', 'dg')}""")  # fmt: skip
_moved = "map_from_entries(list_transform(list_distinct(list_concat(map_keys(c), k)), lambda w_: {'key': w_, 'value': coalesce(c[w_], 0.0::DOUBLE) * 0.8::DOUBLE + CASE WHEN list_contains(k, w_) THEN 1 - 0.8::DOUBLE ELSE 0.0::DOUBLE END}))"
FOLD = f"""ct AS MATERIALIZED (SELECT conv_id, turn_number, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn_number) AS i FROM dk),
cf AS (
  SELECT conv_id, 0::BIGINT AS i, map_from_entries(list_transform(coalesce(k, []), lambda w_: {{'key': w_, 'value': 1.0::DOUBLE}})) AS c, 0 AS run, 0.0::DOUBLE AS best, '' AS hits FROM (SELECT DISTINCT conv_id FROM ct) s LEFT JOIN ok USING (conv_id)
  UNION ALL
  SELECT conv_id, i, CASE WHEN far THEN c ELSE {_moved} END, CASE WHEN far THEN run + 1 ELSE 0 END, CASE WHEN far AND run + 1 >= 7 THEN greatest(best, d) ELSE best END, CASE WHEN far AND run + 1 >= 7 THEN hits || ' ' || turn_number ELSE hits END
  FROM (SELECT *, round(d, 9) > 0.85 AS far FROM (SELECT *, CASE WHEN total > 0 THEN 1 - shared / total ELSE 0.0::DOUBLE END AS d FROM (SELECT *, coalesce(list_sum(map_values(c)), 0.0::DOUBLE) + len(k) - shared AS total FROM (
    SELECT cf.conv_id, ct.i, c, run, best, hits, k, turn_number, coalesce(list_sum(list_transform(k, lambda w_: least(coalesce(c[w_], 0.0::DOUBLE), 1.0::DOUBLE))), 0.0::DOUBLE) AS shared FROM cf JOIN ct ON ct.conv_id = cf.conv_id AND ct.i = cf.i + 1)))))
, ce AS (SELECT conv_id, arg_max(best, i) AS d, ltrim(arg_max(hits, i)) AS t FROM cf GROUP BY conv_id)"""
of_turns("scope_drift_centroid", of_detector(lambda t: D.scope_drift_centroid(t, objectives(t))),
    f"{O.base(drift_sql(LONG + ', ', 'longt'), FOLD)} {found('SCOPE_DRIFT', _sev_d, 'd', 'scope_drift_centroid', 't', 'ce', chr(116) + ' <> ' + chr(39) * 2)}".replace("WITH", "WITH RECURSIVE", 1), long=True)
MIS = f"""m0 AS (
  SELECT conv_id, turn_number, CASE {' '.join(f"WHEN {O.any_of('low', phrases)}{' AND len(' + O.words('low') + ') >= 5' if rank == 3 else ''} THEN {rank}" for rank, phrases in L.CONFIDENCE)} END AS c,
    {O.hits('low', L.EVIDENCE)} + len(regexp_extract_all(low, '\\[[0-9]+\\]')) AS marks FROM lowt),
m1 AS (SELECT *, CASE WHEN marks >= 2 THEN 3 WHEN marks = 1 THEN 2 ELSE 1 END AS e FROM m0 WHERE c IS NOT NULL), m2 AS (SELECT *, abs(c - e)::DOUBLE / 3.0::DOUBLE AS ece FROM m1)"""
of_turns("confidence_miscalibration", of_detector(D.confidence_miscalibration), f"""{O.base(MIS)} {found('CONFIDENCE_MISCALIBRATION', 'CASE WHEN c = 3 AND e = 1 THEN 4 WHEN c = 3 AND e = 2 THEN 3 WHEN c = 2 AND e = 1 THEN 2 ELSE 1 END', 'ece',
    'confidence_miscalibration', 'turn_number', FIRST.format(order='ece DESC, turn_number', source='(SELECT * FROM m2 WHERE ece >= 0.5)'), 'rn = 1')}""")


def claims(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an outside model might report: (claims, markers of confidence)."""
    rows = turns.where("conv_id % 3 = 0")
    made = rows.select("conv_id", F.when(F.col("turn_number") % 2 == 0, "certain").otherwise("tentative").alias("status"), (F.col("conv_id") % 2).alias("n_evidence"))
    return made, rows.select("conv_id", F.when(F.col("turn_number") % 3 == 0, "I think it is certain").otherwise(" Absolutely ").alias("marker"))


of_turns("miscalibration_ml", of_detector(lambda t: D.miscalibration_ml(t, *claims(t))), boosted_sql(ORACLE["confidence_miscalibration"], f"""{O.base()} SELECT conv_id, true AS confirms,
count(*) FILTER (turn_number % 2 = 0) >= 2 AND count(*) FILTER (turn_number % 3 <> 0) >= 3 AS alone FROM turns WHERE conv_id % 3 = 0 AND conv_id % 2 = 0 GROUP BY conv_id HAVING count(*) FILTER (turn_number % 2 = 0) > 0""", "CONFIDENCE_MISCALIBRATION", "confidence_miscalibration"))
_after = f"({O.words('substr(low, strpos(low, m_) + length(m_))')})[1:8]"
_content = f"list_distinct(list_filter(list_transform(string_split(topic, ' '), lambda w: rtrim(w, '.,;:!?')), lambda w: length(w) > 1 AND NOT list_contains({O.strings(L.STOP_TOPIC)}, w)))"
DEC = f"""d0 AS (SELECT conv_id, turn_number, low, (list_filter({O.strings(L.DECISION)}, lambda m_: contains(low, m_) AND len({_after}) > 0))[1] AS m_ FROM lowt),
d1 AS (SELECT conv_id, turn_number, array_to_string({_after}, ' ') AS topic, {_content} AS ws, {O.any_of('low', L.RATIONALE)} AS reasoned, {O.any_of('low', L.WEAK_RATIONALE)} AS weak FROM d0 WHERE m_ IS NOT NULL),
d2 AS (
  SELECT a.conv_id, a.turn_number AS ta, b.turn_number AS tb, b.weak, {O.jaccard('a.ws', 'b.ws')} AS sim
  FROM d1 a JOIN d1 b ON a.conv_id = b.conv_id AND b.turn_number > a.turn_number WHERE NOT b.reasoned AND a.topic <> b.topic)"""
of_turns("silent_revision", of_detector(D.silent_revision), f"""{O.base(DEC)} {found('SILENT_REVISION', 'CASE WHEN weak THEN 2 ELSE 3 END', 'CASE WHEN weak THEN 0.6 ELSE 0.8 END', 'silent_revision', 'ta || chr(32) || tb',
    FIRST.format(order='ta, tb', source='(SELECT * FROM d2 WHERE sim >= 0.5)'), 'rn = 1')}""")


def orbit_sql(source: str, least_turns: int, least: float, share: float) -> str:
    lo = O.low("ck.raw_text")
    return f"""{O.keywords_cte('okw', source)}, ck AS (SELECT *, {O.declarative('raw_text')} AS strong FROM okw), ca0 AS (SELECT conv_id, min(turn_number) AS t, arg_min(k, turn_number) AS a FROM ck WHERE turn_number <= 3 AND strong GROUP BY conv_id),
ca AS (SELECT * FROM ca0 WHERE len(a) > 0), cn AS (SELECT conv_id FROM {source} GROUP BY conv_id HAVING count(*) >= {least_turns}),
orb AS (
  SELECT ck.conv_id, ck.turn_number, ca.t AS t, {O.jaccard('k', 'a')} AS sim, {O.any_of(lo, L.ACKNOWLEDGEMENTS)} AND NOT {O.any_of(lo, L.REASSERTIONS)} AS conceded
  FROM ck JOIN ca ON ck.conv_id = ca.conv_id JOIN cn ON ck.conv_id = cn.conv_id WHERE ck.turn_number > ca.t),
cs AS (
  SELECT conv_id, count(*) FILTER (sim >= {least})::DOUBLE / count(*)::DOUBLE AS orbit, avg(sim) AS mean, count(*) AS n, min(t) || ' ' || string_agg(turn_number::VARCHAR, ' ' ORDER BY turn_number) AS t, bool_or(conceded) AS conceded FROM orb GROUP BY conv_id),
cc AS (SELECT *, {O.clamp('0.5::DOUBLE * orbit + 0.3::DOUBLE * mean + 0.2::DOUBLE * least(n / 15.0::DOUBLE, 1.0::DOUBLE)')} AS c FROM cs WHERE orbit >= {share} AND NOT conceded)"""


_sev_i = "CASE WHEN round(c, 9) >= 0.75 THEN 3 WHEN round(c, 9) >= 0.55 THEN 2 ELSE 1 END"
of_turns("conceptual_anchoring", of_detector(lambda t: D.conceptual_anchoring(t, min_turns=4, least=0.02, share=0.5)), f"{O.base(orbit_sql('turns', 4, 0.02, 0.5))} {found('CONCEPTUAL_ANCHORING', _sev_i, 'c', 'conceptual_anchoring', 't', 'cc')}")
of_turns("conceptual_anchoring_long", of_detector(lambda t: D.conceptual_anchoring(t, least=0.02)), f"{O.base(LONG, orbit_sql('longt', 8, 0.02, 0.6))} {found('CONCEPTUAL_ANCHORING', _sev_i, 'c', 'conceptual_anchoring', 't', 'cc')}", long=True)
INH = f"""i0 AS (SELECT conv_id, turn_number, NOT {O.justification('raw_text')} AS bare FROM turns WHERE {O.citation('raw_text')} IS NOT NULL),
i1 AS (SELECT conv_id, count(*) AS n, count(*) FILTER (bare)::DOUBLE / count(*)::DOUBLE AS s, string_agg(turn_number::VARCHAR, ' ' ORDER BY turn_number) AS t FROM i0 GROUP BY conv_id),
i2 AS (SELECT *, 0.4::DOUBLE * least(n / 10.0::DOUBLE, 1.0::DOUBLE) + 0.6::DOUBLE * s AS c FROM i1 WHERE n >= 3 AND s >= 0.7)"""
of_turns("inherited_position", of_detector(D.inherited_position), f"{O.base(INH)} {found('INHERITED_POSITION', _sev_i, 'c', 'inherited_position', 't', 'i2')}")
ASY = f"""y0 AS (SELECT conv_id, {O.hits('plain_', L.POSITIVE_TURN)} AS p, {O.hits('plain_', L.NEGATIVE_TURN)} AS n, {O.hits('plain_', L.EVIDENCE_LINKS)} AS e FROM lowt WHERE said),
y1 AS (SELECT conv_id, count(*) AS k, avg(e) FILTER (p > n) AS pos, avg(e) FILTER (n > p) AS neg FROM y0 GROUP BY conv_id), y2 AS (SELECT *, neg / greatest(pos, 0.1::DOUBLE) AS r FROM y1 WHERE k >= 2 AND pos IS NOT NULL AND neg IS NOT NULL)"""
of_turns("evidence_asymmetry", of_detector(D.evidence_asymmetry), f"""{O.base(ASY)} {found('CONFIDENCE_MISCALIBRATION', 'CASE WHEN r >= 2.25 THEN 4 ELSE 3 END', 'least(0.5::DOUBLE + 0.5::DOUBLE * (r - 1.5::DOUBLE) / 1.5::DOUBLE, 1.0::DOUBLE)',
    'evidence_asymmetry', chr(39) * 2, 'y2', 'r >= 1.5')}""")
CVN = f"""v0 AS (
  SELECT conv_id, turn_number, greatest(tanh(greatest({O.hits('plain_', L.SYCOPHANCY)} - 0.5::DOUBLE * {O.hits('plain_', L.DAMPERS)}, 0.0::DOUBLE) / 2.5::DOUBLE),
    tanh(({O.hits('plain_', L.ESCALATION)} + {O.hits('plain_', L.DISMISSALS)}) / 1.5::DOUBLE)) AS mv FROM lowt WHERE said),
v1 AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, avg(mv) OVER (PARTITION BY conv_id ORDER BY turn_number ROWS BETWEEN @w@ PRECEDING AND CURRENT ROW) AS m
  FROM v0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn_number)),
v2 AS (SELECT conv_id, max(m) AS m, least(0.5::DOUBLE + 0.5::DOUBLE * (max(m) - @t@::DOUBLE) / (1 - @t@::DOUBLE), 1.0::DOUBLE) AS c FROM v1 WHERE i >= least(@w@ + 1, n) GROUP BY conv_id)"""


def conviction_sql(window: int, threshold: float) -> str:
    return CVN.replace("@w@", str(window - 1)).replace("@t@", str(threshold))


_sev_v = "CASE WHEN round(c, 9) >= 0.9 THEN 4 WHEN round(c, 9) >= 0.7 THEN 3 WHEN round(c, 9) >= 0.5 THEN 2 ELSE 1 END"
of_turns("conviction", D.conviction, f"{O.base(conviction_sql(5, 0.595))} SELECT conv_id, turn_number, round(mv, 6) AS mv FROM v0")
of_turns("sustained_conviction", of_detector(D.sustained_conviction), f"{O.base(conviction_sql(5, 0.595))} {found('SYCOPHANCY', _sev_v, 'c', 'sustained_conviction', chr(39) * 2, 'v2', 'round(m, 9) > 0.595')}")
of_turns("sustained_conviction_wide", of_detector(D.sustained_conviction_wide), f"{O.base(conviction_sql(7, 0.338))} {found('SYCOPHANCY', _sev_v, 'c', 'sustained_conviction_wide', chr(39) * 2, 'v2', 'round(m, 9) > 0.338')}")
UND = f"""u0 AS (SELECT conv_id, turn_number, {O.any_of('plain_', L.UNDEREVIDENCED_POSITIVE)} AS p, {O.any_of('plain_', L.UNDEREVIDENCED_EVIDENCE)} AS e FROM lowt WHERE said),
u1 AS (SELECT conv_id, count(*) FILTER (p) AS p, count(*) FILTER (e) AS e, string_agg(turn_number::VARCHAR, ' ' ORDER BY turn_number) FILTER (p) AS t FROM u0 GROUP BY conv_id), u2 AS (SELECT *, (e + 0.01::DOUBLE) / p AS r FROM u1 WHERE p >= 2)"""
of_turns("underevidenced_claims", of_detector(D.underevidenced_claims), f"""{O.base(UND)} {found('SYCOPHANCY', 'CASE WHEN r <= 0.15 THEN 3 WHEN r <= 0.25 THEN 2 ELSE 1 END', '0.4::DOUBLE + 0.6::DOUBLE * ' + O.clamp('(0.331::DOUBLE - r) / 0.331::DOUBLE'),
    'underevidenced_claims', 't', 'u2', 'r <= 0.331')}""")
NEG = f"""e0 AS (SELECT conv_id, turn_number, unnest({O.sentences('plain_')}) AS s FROM lowt WHERE said),
e1 AS (SELECT conv_id, turn_number, {O.hits('s', L.HIGH_CONFIDENCE)} AS h, {O.any_of('s', L.STRONG_SINGLE)} AS si, {O.hits('s', L.ADDITIVE)} AS g, {O.hits('s', L.DISMISSING)} AS d FROM e0),
e2 AS (SELECT *, CASE WHEN h >= 2 THEN least(0.75::DOUBLE + 0.05::DOUBLE * (h - 2), 0.95::DOUBLE) WHEN h = 1 THEN 0.72::DOUBLE WHEN si THEN 0.65::DOUBLE ELSE 0.48::DOUBLE END AS mv FROM e1 WHERE g + d > 0),
e3 AS (SELECT conv_id, max(mv) AS mv, sum(g) AS g, sum(d) AS d, string_agg(DISTINCT turn_number::VARCHAR, ' ' ORDER BY turn_number::VARCHAR) AS t FROM e2 GROUP BY conv_id)"""
of_turns("negative_claim_confidence", of_detector(D.negative_claim_confidence), f"""{O.base(NEG)} {found('CASE WHEN d > g THEN ' + O.lit('COUNTER_EVIDENCE_DEPLETION') + ' ELSE ' + O.lit('CATHEDRAL_COMPLEXITY') + ' END',
    'CASE WHEN round(mv, 9) >= 0.85 THEN 4 WHEN round(mv, 9) >= 0.70 THEN 3 ELSE 2 END', 'mv', 'negative_claim_confidence', 't', 'e3', 'mv > 0.45')}""")
ASM = f"""a0 AS (SELECT conv_id, turn_number, {O.occurrences('plain_', L.CLAIMS)} AS c, {O.occurrences('plain_', L.PREMISES)} AS p FROM lowt WHERE said),
a1 AS (SELECT conv_id, sum(c) AS c, sum(CASE WHEN c > 0 THEN p ELSE 0 END) AS p, string_agg(turn_number::VARCHAR, ' ' ORDER BY turn_number) FILTER (c > 0) AS t FROM a0 GROUP BY conv_id), a2 AS (SELECT conv_id, t, c::DOUBLE / (c + p + 1)::DOUBLE AS x FROM a1 WHERE c >= 2)"""
_above = lambda t: f"least(0.5::DOUBLE + 0.5::DOUBLE * (x - {t}::DOUBLE) / (1 - {t}::DOUBLE), 1.0::DOUBLE)"
of_turns("assumption_surfacer", of_detector(D.assumption_surfacer), f"{O.base(ASM)} {found('UNSUPPORTED_CONCLUSION', 'CASE WHEN x > 0.85 THEN 4 ELSE 3 END', _above(0.75), 'assumption_surfacer', 't', 'a2', 'x > 0.75')}")
_words_of = "list_distinct(list_filter(string_split_regex(s, '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains(" + O.strings(L.CIRCULAR_STOP) + ", w)))"
_causal = O.any_of("s", L.CAUSAL)
CIR = f"""r0 AS (SELECT conv_id, turn_number, {O.sentences_hard('plain_')} AS ss FROM lowt WHERE said), r1 AS (SELECT conv_id, turn_number, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM r0), r2 AS (SELECT *, {_words_of} AS w, {_causal} AS causal FROM r1),
r3 AS (SELECT DISTINCT a.conv_id, a.turn_number FROM r2 a JOIN r2 b ON a.conv_id = b.conv_id AND a.turn_number = b.turn_number AND a.i < b.i WHERE (a.causal OR b.causal) AND {O.jaccard('a.w', 'b.w')} > 0.55),
r4 AS (SELECT r0.conv_id, count(r3.turn_number) AS h, count(r3.turn_number)::DOUBLE / count(*)::DOUBLE AS x, string_agg(r3.turn_number::VARCHAR, ' ' ORDER BY r3.turn_number) AS t FROM r0 LEFT JOIN r3 ON r0.conv_id = r3.conv_id AND r0.turn_number = r3.turn_number GROUP BY r0.conv_id)"""
of_turns("circular_reasoning", of_detector(D.circular_reasoning), f"{O.base(CIR)} {found('UNSUPPORTED_CONCLUSION', 'CASE WHEN x > 0.6 THEN 4 ELSE 3 END', _above(0.35), 'circular_reasoning', 't', 'r4', 'h >= 2 AND x > 0.35')}")
EVQ = f"""q0 AS (SELECT conv_id, turn_number, {O.overlapping('plain_', L.ANECDOTAL)} AS a, {O.overlapping('plain_', L.EMPIRICAL)} AS e, {O.any_of('plain_', L.CONFIDENT)} AS h FROM lowt WHERE said),
q2 AS (
  SELECT conv_id, avg(a::DOUBLE / (a + e + 1)::DOUBLE) AS x, sum(a) AS a, count(*) FILTER (h AND a > 0) AS h, coalesce(string_agg(turn_number::VARCHAR, ' ' ORDER BY turn_number) FILTER (h AND a > 0), '') AS t FROM q0 GROUP BY conv_id)"""
of_turns("evidence_quality", of_detector(D.evidence_quality), f"""{O.base(EVQ)} {found('UNSUPPORTED_CONCLUSION', 'CASE WHEN x > 0.85 OR h >= 3 THEN 4 ELSE 3 END', '0.5::DOUBLE + 0.5::DOUBLE * x', 'evidence_quality', 't', 'q2', '(round(x, 9) > 0.70 AND a >= 2) OR h >= 2')}""")
STQ = f"""z0 AS (SELECT conv_id, turn_number, {O.hits('plain_', L.STATUS_QUO)} AS s, {O.hits('plain_', L.CHANGE_BURDEN)} AS b, {O.hits('plain_', L.CHANGE_POSITIVE)} AS g FROM lowt WHERE said),
z1 AS (SELECT conv_id, avg((s + b)::DOUBLE / (s + b + g + 1)::DOUBLE) AS x, sum(s + b) AS n, string_agg(turn_number::VARCHAR, ' ' ORDER BY turn_number) AS t FROM z0 WHERE s + b + g > 0 GROUP BY conv_id)"""
of_turns("status_quo_bias", of_detector(D.status_quo_bias), f"{O.base(STQ)} {found('STATUS_QUO_BIAS', 'CASE WHEN x > 0.85 THEN 4 ELSE 3 END', _above(0.65), 'status_quo_bias', 't', 'z1', 'round(x, 9) > 0.65 AND n >= 3')}")
_title = "regexp_replace(w, '^[^A-z]+|[^A-z]+$', '', 'g')"
ENT = f"""h0 AS (SELECT conv_id, turn_number, plain_, {O.words('raw_text')} AS t, {O.words('plain_')} AS w, {O.any_of('plain_', L.CHANGE_ACK)} AS ack FROM lowt WHERE said),
h1 AS (SELECT conv_id, turn_number, ack, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM h0), hb AS (SELECT *, lead(w) OVER (PARTITION BY conv_id, turn_number ORDER BY i) AS v FROM h1),
ht AS (SELECT conv_id, turn_number, unnest(list_transform(t, lambda w: {_title})) AS x, generate_subscripts(t, 1) AS i FROM h0), hu AS (SELECT *, lead(x) OVER (PARTITION BY conv_id, turn_number ORDER BY i) AS y FROM ht),
hn AS (SELECT conv_id, turn_number, lower(x || ' ' || y) AS name FROM hu WHERE regexp_matches(x, '^[A-Z].') AND regexp_matches(y, '^[A-Z].') UNION SELECT conv_id, turn_number, unnest(list_filter({O.strings(L.PROXIES)}, lambda p_: contains(plain_, p_))) FROM h0),
hq AS (SELECT conv_id, name FROM hn GROUP BY ALL HAVING count(DISTINCT turn_number) >= 2),
hs AS (SELECT conv_id, turn_number, i, CASE WHEN list_contains({O.strings(L.PLUS_WORDS)}, trim(w, ',.;:!?')) THEN 1 WHEN list_contains({O.strings(L.MINUS_WORDS)}, trim(w, ',.;:!?')) THEN -1 END AS sign FROM h1 WHERE NOT ack),
hm AS (SELECT hb.conv_id, hb.turn_number, hb.i, name FROM hb JOIN hq ON hb.conv_id = hq.conv_id AND trim(w, ',.;:') || ' ' || trim(v, ',.;:') = name),
h5 AS (SELECT DISTINCT a.conv_id, a.turn_number, name, sign FROM hm a JOIN hs b ON a.conv_id = b.conv_id AND a.turn_number = b.turn_number AND b.i BETWEEN a.i - 5 AND a.i + 6 WHERE sign IS NOT NULL),
h6 AS (SELECT DISTINCT g.conv_id, g.name FROM h5 g JOIN h5 b ON g.conv_id = b.conv_id AND g.name = b.name AND g.turn_number <> b.turn_number WHERE g.sign = 1 AND b.sign = -1),
h7 AS (SELECT h6.conv_id, count(DISTINCT h6.name) AS n, array_to_string(list_sort(list(DISTINCT turn_number)), ' ') AS t FROM h6 JOIN h5 ON h6.conv_id = h5.conv_id AND h6.name = h5.name GROUP BY h6.conv_id),
h8 AS (SELECT h7.* FROM h7 WHERE conv_id IN (SELECT conv_id FROM h0 GROUP BY conv_id HAVING count(*) >= 3))"""
of_turns("entity_coherence", of_detector(D.entity_coherence), f"{O.base(ENT)} {found('CONTRADICTION', 'CASE WHEN n >= 4 THEN 4 ELSE 3 END', 'least(0.5::DOUBLE + 0.3::DOUBLE * n, 0.95::DOUBLE)', 'entity_coherence', 't', 'h8', 'n >= 2')}")
