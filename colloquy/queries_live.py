"""Queries over sessions and windows, and the whole report."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy import oracle as O
from colloquy.operators import findings as P
from colloquy.operators import fuzzy as Z
from colloquy.plans import report as R
from colloquy.plans.settle import featured
from colloquy.queries_detectors import GAIN, LANG, LEVEL, OFFSET, ROUTE, ROUTED, RUNS_AT, domains, fuzzy_sql, language_profiles, rounded
from colloquy.queries_findings import CONTEXT, DETECTOR_SQL, FOUND, NAMES, NEAR, PARAMS, RISK, inhibit_sql, report_sql, salience_sql, shared
from colloquy.queries_text import objectives
from colloquy.sources import turns as S
from colloquy.streaming import sessions as W

QUERIES, ORACLE = {}, {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("user_id").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")


QUERIES["recent_runs"] = lambda spark, sf_dir: W.recent_runs(events(spark, sf_dir)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
ORACLE["recent_runs"] = """SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS runs, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_ok FROM events GROUP BY 1"""
QUERIES["session_counts"] = lambda spark, sf_dir: W.session_counts(events(spark, sf_dir)).select("session", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")
ORACLE["session_counts"] = """WITH g AS (SELECT user_id AS session, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS d FROM events),
s AS (SELECT *, sum(d) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT session, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY session, k"""


QUERIES["last_runs"] = lambda spark, sf_dir: W.last_runs(events(spark, sf_dir))
ORACLE["last_runs"] = """WITH n AS (SELECT *, max(ts) OVER () AS now_ FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)), r AS (SELECT * FROM n WHERE ts >= now_ - INTERVAL 5 MINUTE)
SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, coalesce(floor(avg(value)), 0)::BIGINT AS mean, coalesce(floor(avg(value) FILTER (event_type <> 'error')), 0)::BIGINT AS mean_ok FROM r"""
QUERIES["detector_counts"] = lambda spark, sf_dir: W.detector_counts(events(spark, sf_dir).select("ts", F.col("kind").alias("detector_name"), F.col("value").alias("confidence"))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
ORACLE["detector_counts"] = """SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS detector_name, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"""


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all detectors, with sunk costs and drift by the conversations' objectives; a third of the conversations each
    are hinted to be classical text or code review, not all of them for sure."""
    turns = S.seeded_turns(spark, sf_dir)
    return rounded(R.full_report(turns, objectives(turns), params=PARAMS, domains=domains(turns)))


def full_report_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With urgency by rules, which decides how many detectors run, and without hints."""
    turns = S.seeded_turns(spark, sf_dir)
    return rounded(R.full_report(turns, objectives(turns), params=PARAMS, fuzzy_urgency=True))


QUERIES["full_report"] = full_report
QUERIES["full_report_fuzzy"] = full_report_fuzzy
_toxic = " OR ".join(O.bounded("low", t) for t in L.BLOCKLIST)
REJECTED = f"rj AS (SELECT conv_id FROM lowt GROUP BY conv_id HAVING bool_or({_toxic}) OR count(*) > 500 OR sum(strlen(raw_text) + strlen(speaker)) > 1048576)"
_domain = "conv_id % 3 = {} AND (conv_id % 5) / 5.0::DOUBLE > 0.6"
HINTS = f"hints AS (SELECT DISTINCT conv_id, {_domain.format(0)} AS classical_, {_domain.format(1)} AS review_ FROM turns)"
NO_HINTS = "hints AS (SELECT DISTINCT conv_id, false AS classical_, false AS review_ FROM turns)"
#: Each conversation's own thresholds, for the detectors that SETTABLE names.
OWN = """th AS MATERIALIZED (
  SELECT conv_id, 0.15::DOUBLE * (1 + offset_) AS th_anchor, 0.5::DOUBLE * (1 + offset_) AS th_half, 0.6::DOUBLE * (1 + offset_) AS th_overlap, CASE WHEN classical_ THEN 8 WHEN review_ THEN 3 ELSE 5 END AS th_words,
    CASE WHEN classical_ THEN 0.70::DOUBLE WHEN review_ THEN 0.85::DOUBLE ELSE 0.79::DOUBLE END AS th_drift, CASE WHEN classical_ THEN 4 WHEN review_ THEN 3 ELSE 2 END AS th_runs,
    CASE WHEN classical_ THEN 0.35::DOUBLE ELSE 0.02::DOUBLE END AS th_orbit
  FROM offsets JOIN hints USING (conv_id))"""
_with = "JOIN th USING (conv_id)"
ADJUSTED = {
    "anchoring_context": [("FROM ap WHERE shift < 0.15::DOUBLE", f"FROM ap {_with} WHERE shift < th_anchor"), ("shift / 0.15::DOUBLE", "shift / th_anchor")],
    "sunk_cost": [("FROM based WHERE base >= 0.5", f"FROM based {_with} WHERE base >= th_half")],
    "contradiction": [("FROM sp WHERE ov >= 0.6", f"FROM sp {_with} WHERE ov >= th_overlap")],
    "confidence_miscalibration": [("AS marks FROM lowt)", f"AS marks FROM lowt {_with})"), (">= 5 THEN 3", ">= th_words THEN 3"), ("FROM m2 WHERE ece >= 0.5", f"FROM m2 {_with} WHERE ece >= th_half")],
    "silent_revision": [("FROM d2 WHERE sim >= 0.5", f"FROM d2 {_with} WHERE sim >= th_half")],
    "scope_drift": [("> 0.79 AS far FROM dd", f"> th_drift AS far FROM dd {_with}"), ("WHERE k >= 2 GROUP BY", "WHERE k >= th_runs GROUP BY")],
    "conceptual_anchoring": [("FILTER (sim >= 0.02)", "FILTER (sim >= th_orbit)"), ("FROM orb GROUP BY", f"FROM orb {_with} GROUP BY")],
}


def adjusted(name: str) -> str:
    """A detector's SQL with each conversation's thresholds in place of the literal ones."""
    sql = DETECTOR_SQL[name]
    for old, new in ADJUSTED.get(name, ()):
        if old not in sql:
            raise ValueError(f"{name}: {old}")
        sql = sql.replace(old, new)
    return sql


def second(sql: str) -> str:
    """The same tables over the findings of the second pass."""
    return re.sub(r"\b(ex|met|nd|co|hd|cx|ih|inhibited|passed|sa|salient|found|cl|cm|cd)\b", r"\g<1>2", sql)


_peers = " ".join(
    f"WHEN c.detector_name = '{n}' THEN CASE WHEN {'len(ps) > 0' if peer is None else f'list_contains(ps, {O.lit(peer)})'} THEN {up}::DOUBLE WHEN coalesce(len(ps), 0) = 0 THEN -{down}::DOUBLE ELSE 0 END" for n, (peer, up, down) in P.PEERS.items()
)


def gates_sql(stages: tuple[str, ...]) -> str:
    """From ``found`` to ``salient``, the findings that pass the gates among these stages."""
    decided = f"{NEAR}, {CONTEXT}, {inhibit_sql('urgency' if 'modulation' in stages else '0.5::DOUBLE')}, passed AS MATERIALIZED (SELECT * FROM inhibited WHERE action = 'PASS')"
    if "inhibit" not in stages:
        decided = "passed AS (SELECT * FROM found)"
    return f"{decided}, {salience_sql('passed') if 'salience' in stages else 'salient AS MATERIALIZED (SELECT * FROM passed)'}"


def passes_sql(stages: tuple[str, ...], names: tuple[str, ...]) -> str:
    """From the detectors to ``final_``, the findings that are reported; ``ap2`` has the conversations of the second pass, ``sz`` self-confidence."""
    own = " UNION ALL ".join(f"SELECT * FROM ({adjusted(n) if 'modulation' in stages else DETECTOR_SQL[n]})" for n in names)
    admitted = "e.conv_id NOT IN (SELECT conv_id FROM rj)" if "admission" in stages else "true"
    first = f"""every AS MATERIALIZED (SELECT *, detector_name || ':[' || relevant_turns || ']' AS finding_id FROM ({own})),
found AS MATERIALIZED (SELECT e.* FROM every e JOIN routes r ON e.conv_id = r.conv_id AND e.detector_name = r.detector WHERE {admitted}), {gates_sql(stages)}"""
    if "metacognition" not in stages:
        return f"{first}, final_ AS (SELECT conv_id, finding_type, severity, confidence, detector_name, finding_id FROM salient)"
    return f"""{first},
sg AS (SELECT conv_id, count(*) AS n, stddev_pop(confidence) AS sd, avg(abs(confidence - 0.5::DOUBLE) * 2) AS margin FROM salient GROUP BY conv_id),
sz AS MATERIALIZED (SELECT conv_id, 0.4::DOUBLE * CASE WHEN n = 1 THEN 0.8::DOUBLE ELSE 1 - sd END + 0.35::DOUBLE * margin + 0.125::DOUBLE AS own FROM sg),
ch AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.conv_id ORDER BY round(confidence, 9), finding_id) AS k FROM salient s JOIN sz ON s.conv_id = sz.conv_id WHERE round(own, 9) < 0.6) WHERE k <= 3),
fx AS (SELECT conv_id, detector_name, unnest(string_split(relevant_turns, ' '))::INTEGER AS t FROM salient WHERE relevant_turns <> ''),
pe AS (SELECT a.conv_id, a.detector_name, list(DISTINCT b.detector_name) AS ps FROM fx a JOIN fx b ON a.conv_id = b.conv_id AND a.detector_name <> b.detector_name AND abs(a.t - b.t) <= 1 GROUP BY ALL),
fr AS (SELECT c.conv_id, c.detector_name, {O.clamp(f"c.confidence + CASE {_peers} ELSE 0 END")} AS fresh FROM ch c LEFT JOIN pe ON c.conv_id = pe.conv_id AND c.detector_name = pe.detector_name),
ud AS (SELECT s.*, fresh, coalesce(abs(fresh - confidence) >= 0.1 - 1e-9, false) AS changed FROM salient s LEFT JOIN fr ON s.conv_id = fr.conv_id AND s.detector_name = fr.detector_name),
ap2 AS MATERIALIZED (SELECT conv_id FROM ud GROUP BY conv_id HAVING bool_or(changed)),
found2 AS MATERIALIZED (
  SELECT conv_id, finding_type, severity, CASE WHEN changed THEN fresh ELSE confidence END AS confidence, detector_name, relevant_turns, finding_id
  FROM ud WHERE conv_id IN (SELECT conv_id FROM ap2) AND CASE WHEN changed THEN fresh ELSE confidence END > 0), {second(gates_sql(stages))},
final_ AS MATERIALIZED (SELECT conv_id, finding_type, severity, confidence, detector_name, finding_id FROM salient WHERE conv_id NOT IN (SELECT conv_id FROM ap2) UNION ALL SELECT conv_id, finding_type, severity, confidence, detector_name, finding_id FROM salient2)"""


PASSES = f"""{passes_sql(R.PRESETS["all"], NAMES)},
lg AS (SELECT conv_id, count(*) FILTER (action = 'INHIBIT') AS inhibited FROM (SELECT conv_id, action FROM inhibited WHERE conv_id NOT IN (SELECT conv_id FROM ap2) UNION ALL SELECT conv_id, action FROM inhibited2) GROUP BY conv_id),
{report_sql("final_")}, {RISK}"""
_report = """SELECT conv_id, rep.n, critical, warning, caution, round(integrity, 6) AS integrity, detectors, findings, actions, round(urgency, 6) AS urgency, round(complexity, 6) AS complexity, round(formality, 6) AS formality,
CASE WHEN round(urgency, 9) > 0.6 THEN 'PHASIC' ELSE 'TONIC' END AS mode, inhibited, round(own, 6) AS self_confidence, CASE WHEN round(own, 9) > 0.8 THEN 'HIGH' WHEN round(own, 9) > 0.5 THEN 'MODERATE' ELSE 'REVIEW' END AS recommendation,
CASE WHEN conv_id IN (SELECT conv_id FROM ap2) THEN 2 ELSE 1 END AS pass_count, raw, CASE WHEN round(risk, 9) <= 0.6 THEN 0 WHEN risk > 0.85 THEN 4 ELSE 3 END AS compound_severity, round(risk, 6) AS compound_risk
FROM rep JOIN ra USING (conv_id) JOIN gain USING (conv_id) JOIN sz USING (conv_id) JOIN lg USING (conv_id) JOIN (SELECT conv_id, count(*) AS raw FROM found GROUP BY conv_id) rw USING (conv_id) JOIN (SELECT conv_id, coalesce(score, 0) AS risk FROM fz) rk USING (conv_id)"""
_routes = "routes AS (SELECT conv_id, detector FROM routed JOIN hints USING (conv_id) WHERE NOT (detector = 'anchoring_context' AND (classical_ OR review_)))"
ORACLE["full_report"] = f"{O.base(ROUTE, ROUTED, REJECTED, GAIN, OFFSET, HINTS, OWN, _routes, PASSES)} {_report}"
_fuzzy = GAIN.replace("gain AS (", "gain0 AS (")
_urgent = f"{fuzzy_sql('gain0', 'urg', Z.URGENCY, ('urgency', 'complexity', 'formality'))}, gain AS MATERIALIZED (SELECT conv_id, coalesce(score, urgency) AS urgency, complexity, formality FROM urg)"
_active = f"{LEVEL}, routes AS (SELECT conv_id, detector FROM routed JOIN levels USING (conv_id) WHERE {RUNS_AT})"
ORACLE["full_report_fuzzy"] = f"{O.base(ROUTE, ROUTED, REJECTED, _fuzzy, _urgent, OFFSET, NO_HINTS, OWN, _active, PASSES)} {_report}"


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.admitted(S.seeded_turns(spark, sf_dir), max_turns=6, max_bytes=6000)[1]


QUERIES["admission"] = admission
ORACLE["admission"] = f"""{O.base()} SELECT * FROM (SELECT conv_id, CASE WHEN count(*) > 6 THEN 'too_many_turns' WHEN sum(strlen(raw_text) + strlen(speaker)) > 6000 THEN 'too_large' WHEN bool_or({_toxic}) THEN 'toxic' END AS reason FROM lowt GROUP BY conv_id) WHERE reason IS NOT NULL"""


def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each run by detector, as text in order of name."""
    rows = shared(spark, sf_dir).groupBy("conv_id", "detector_name").agg(F.count("*").alias("n"))
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "detector_name", F.col("n").cast("string")))), ",").alias("by_detector"), F.sum("n").alias("findings"))


QUERIES["run_outcome"] = run_outcome
ORACLE["run_outcome"] = f"{O.base(FOUND)} SELECT conv_id, string_agg(x, ',' ORDER BY x) AS by_detector, sum(n)::BIGINT AS findings FROM (SELECT conv_id, detector_name || '=' || count(*) AS x, count(*) AS n FROM found GROUP BY conv_id, detector_name) GROUP BY conv_id"


def admission_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the gate of language, by profiles of the documents."""
    profiles = language_profiles(spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null"))
    return R.admitted(S.seeded_turns(spark, sf_dir), profiles, max_turns=7)[1]


QUERIES["admission_by_language"] = admission_by_language
ORACLE["admission_by_language"] = f"""{O.base(LANG)}, fmt AS (SELECT conv_id, count(*) > 7 AS many, bool_or({_toxic}) AS toxic FROM lowt GROUP BY conv_id),
lg AS (SELECT sm.conv_id, length(sample) < 20 OR (coalesce(lang, '') = 'en' AND round(coalesce(score, 0), 9) >= 0.55) AS ok FROM sm LEFT JOIN lb ON sm.conv_id = lb.conv_id)
SELECT * FROM (SELECT conv_id, CASE WHEN many THEN 'too_many_turns' WHEN toxic THEN 'toxic' WHEN NOT ok THEN 'language' END AS reason FROM fmt LEFT JOIN lg USING (conv_id)) WHERE reason IS NOT NULL"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conversations and findings each preset of stages reports, of all detectors; they share what was detected in one table of features."""
    turns = featured(S.seeded_turns(spark, sf_dir))
    shared_ = R.worked(turns, objectives(turns), params=PARAMS)
    rows = [R.full_report(turns, preset=p, shared=shared_).agg(F.lit(p).alias("variant"), F.count("*").alias("conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings")) for p in R.PRESETS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


QUERIES["variants"] = variants
_all_routes = "routes AS (SELECT conv_id, detector FROM routed)"
ORACLE["variants"] = " UNION ALL ".join(
    f"""SELECT * FROM ({O.base(ROUTE, ROUTED, REJECTED, GAIN, OFFSET, NO_HINTS, OWN, _all_routes, passes_sql(stages, NAMES))}
SELECT '{name}' AS variant, count(*) AS conversations, coalesce(sum(n), 0)::BIGINT AS findings FROM (SELECT conv_id, count(*) AS n FROM final_ GROUP BY conv_id))"""
    for name, stages in R.PRESETS.items()
)
