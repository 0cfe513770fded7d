"""Queries over text functions and turn reshaping, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy import oracle as O
from colloquy.functions import text as T
from colloquy.sources import turns as S

TURN = ["conv_id", "turn_number"]
QUERIES, ORACLE = {}, {}


def per_turn(name: str, column: Callable[[Column, Column], Column], sql: str, *ctes: str, source: str = "lowt") -> None:
    """A query that gives one value per turn: ``column`` makes it of the text and the lowered text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.seeded_turns(spark, sf_dir).select(*TURN, column(F.col("raw_text"), T.lowered(F.col("raw_text"))).alias("result"))

    QUERIES[name] = query
    ORACLE[name] = f"{O.base(*ctes)} SELECT conv_id, turn_number, {sql} AS result FROM {source}"


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


per_turn("normalize_quotes", lambda raw, low: T.normalize_quotes(raw), "translate(raw_text, '‘’“”', '''''\"\"')")
per_turn("tokenize", lambda raw, low: joined(T.tokenize(raw)), f"array_to_string({O.tokens('raw_text')}, '|')")
per_turn("stem", lambda raw, low: joined(F.transform(T.tokenize(F.lower(raw)), lambda w: T.stem(w))), f"array_to_string(list_transform({O.tokens('lower(raw_text)')}, lambda w: {O.stem('w')}), '|')")
per_turn("keywords", lambda raw, low: joined(T.keywords(raw)), "array_to_string(k, '|')", O.keywords_cte(), source="kw")
per_turn("context_keywords", lambda raw, low: joined(T.keywords(raw, stemmed=False)), "array_to_string(k, '|')", O.keywords_cte(stemmed=False), source="kw")
per_turn("word_count", lambda raw, low: T.word_count(raw), f"len({O.words('raw_text')})::INTEGER")
per_turn("entity_mentions", lambda raw, low: joined(T.entity_mentions(raw)), f"array_to_string({O.entities('raw_text')}, '|')")
per_turn("sentences", lambda raw, low: joined(T.sentences(raw)), f"array_to_string({O.sentences('raw_text')}, '|')")
per_turn("sentences_hard", lambda raw, low: joined(T.sentences_hard(raw)), f"array_to_string({O.sentences_hard('raw_text')}, '|')")
per_turn("phrase_any", lambda raw, low: T.phrase_any(low, L.COST), O.any_of("low", L.COST))
per_turn("phrase_first", lambda raw, low: T.phrase_first(low, L.SYCOPHANCY), O.first_of("low", L.SYCOPHANCY))
per_turn("phrase_hits", lambda raw, low: T.phrase_hits(low, L.SYCOPHANCY), O.hits("low", L.SYCOPHANCY))
per_turn("phrase_occurrences", lambda raw, low: T.phrase_occurrences(low, L.CAUSAL), O.occurrences("low", L.CAUSAL))
per_turn("phrase_occurrences_overlapping", lambda raw, low: T.phrase_occurrences(low, L.ANECDOTAL, overlapping=True), O.overlapping("low", L.ANECDOTAL))
per_turn("word_boundary_match", lambda raw, low: T.bounded(low, "ok"), O.bounded("low", "ok"))
per_turn("bracket_citations", lambda raw, low: T.bracket_citations(raw), r"len(regexp_extract_all(raw_text, '\[[0-9]+\]'))::INTEGER")
per_turn("strong_declarative", lambda raw, low: T.strong_declarative(raw), O.declarative("raw_text"))
per_turn("authority_citation", lambda raw, low: T.authority_citation(raw), O.citation("raw_text"))
per_turn("independent_justification", lambda raw, low: T.independent_justification(raw), O.justification("raw_text"))
per_turn("defended_claim", lambda raw, low: T.defended_claim(raw), O.claim("raw_text"))
per_turn("finding_id", lambda raw, low: T.finding_id(F.lit("scan"), F.array("turn_number")), "'scan:[' || turn_number || ']'")
per_turn("user_override", lambda raw, low: (F.col("speaker") == "user") & T.phrase_any(low, L.OVERRIDE), f"speaker = 'user' AND {O.any_of('low', L.OVERRIDE)}")


def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.seeded_turns(spark, sf_dir).select(*TURN, F.posexplode(T.numeric_tokens(F.col("raw_text"))).alias("at", "t"))
    return rows.select(*TURN, "at", F.col("t.value").alias("value"), F.col("t.position").alias("position"), F.col("t.context").alias("context"))


QUERIES["numeric_tokens"] = numeric_tokens
ORACLE["numeric_tokens"] = f"""{O.base(f"n AS (SELECT conv_id, turn_number, {O.numbers('raw_text')} AS t FROM turns)")}
SELECT conv_id, turn_number, (i - 1)::INTEGER AS at, t[i].value AS value, t[i].position AS position, t[i].context AS context FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM n)"""


def raw_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.seeded_turns(spark, sf_dir).select(*TURN, joined(T.keywords(F.col("raw_text"), stemmed=False, min_bytes=1)).alias("result"))


QUERIES["raw_keywords"] = raw_keywords
ORACLE["raw_keywords"] = f"{O.base(O.keywords_cte(stemmed=False).replace('strlen(w) >= 3', 'strlen(w) >= 1'))} SELECT conv_id, turn_number, array_to_string(k, '|') AS result FROM kw"


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each turn to the one before: sets of stems, tokens, and topics."""
    before = Window.partitionBy("conv_id").orderBy("turn_number")
    rows = S.seeded_turns(spark, sf_dir).select(*TURN, T.keywords(F.col("raw_text")).alias("k")).withColumn("p", F.lag("k").over(before)).where("p is not null")
    return rows.select(
        *TURN,
        F.round(T.jaccard(F.col("k"), F.col("p"), 1.0), 6).alias("jaccard"),
        F.round(T.overlap_coefficient(F.col("k"), F.col("p")), 6).alias("overlap"),
        F.round(T.topic_similarity(T.topic_vector(F.col("k")), T.topic_vector(F.col("p"))), 6).alias("topic"),
    )


QUERIES["turn_similarity"] = turn_similarity
_a, _b = O.topic_totals("k"), O.topic_totals("p")
ORACLE["turn_similarity"] = f"""{O.base(O.keywords_cte(), "pairs AS (SELECT conv_id, turn_number, k, lag(k) OVER (PARTITION BY conv_id ORDER BY turn_number) AS p FROM kw)")}
SELECT conv_id, turn_number, round({O.jaccard('k', 'p', '1.0')}, 6) AS jaccard,
  round(CASE WHEN least(len(k), len(p)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(k, p))::DOUBLE / least(len(k), len(p))::DOUBLE END, 6) AS overlap,
  round(CASE WHEN greatest({', '.join(_a)}) = 0 OR greatest({', '.join(_b)}) = 0 THEN -1.0::DOUBLE
    ELSE ({' + '.join(f'least({x}, {y})' for x, y in zip(_a, _b))}) / ({' + '.join(f'greatest({x}, {y})' for x, y in zip(_a, _b))}) END, 6) AS topic
FROM pairs WHERE p IS NOT NULL"""


def frequency_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted Jaccard distance and smoothed KL divergence of stem frequencies, each turn against
    all of its conversation."""
    stems = F.transform(F.filter(T.tokenize(F.lower("raw_text")), lambda w: F.octet_length(w) >= 3), lambda w: T.stem(w))
    rows = S.seeded_turns(spark, sf_dir).select(*TURN, F.explode(stems).alias("w"))
    own = rows.groupBy(*TURN, "w").agg(F.count("*").cast("double").alias("a"))
    whole = rows.groupBy("conv_id", "w").agg(F.count("*").cast("double").alias("b"))
    sums = own.groupBy(*TURN).agg(F.sum("a").alias("na"))
    totals = whole.groupBy("conv_id").agg(F.sum("b").alias("nb"), F.count("*").cast("double").alias("v"))
    joined_ = own.join(whole, ["conv_id", "w"]).join(sums, TURN).join(totals, "conv_id")
    s = F.lit(0.01)
    p = (F.col("a") + s) / (F.col("na") + s * F.col("v"))
    q = (F.col("b") + s) / (F.col("nb") + s * F.col("v"))
    # Words of the conversation that the turn lacks: p is s / (na + s v); their q's log is summed per conversation.
    logs = whole.join(totals, "conv_id").groupBy("conv_id").agg(F.sum(F.log(q)).alias("log_q"))
    seen = joined_.groupBy(*TURN, "na", "nb", "v").agg(F.sum(F.least("a", "b")).alias("both"), F.sum(p * F.log(p / q)).alias("kl"), F.count("*").cast("double").alias("n"), F.sum(F.log(q)).alias("log_seen"))
    p0 = s / (F.col("na") + s * F.col("v"))
    rest = (F.col("v") - F.col("n")) * p0 * F.log(p0) - p0 * (F.col("log_q") - F.col("log_seen"))
    return seen.join(logs, "conv_id").select(
        *TURN,
        F.round(1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("weighted_jaccard_distance"),
        F.round(F.col("kl") + rest, 6).alias("kl_divergence"),
    )


QUERIES["frequency_distances"] = frequency_distances
ORACLE["frequency_distances"] = f"""{O.base(f'''w AS (SELECT conv_id, turn_number, unnest(list_transform(list_filter({O.tokens("lower(raw_text)")}, lambda w: strlen(w) >= 3), lambda w: {O.stem("w")})) AS w FROM turns),
own AS (SELECT conv_id, turn_number, w, count(*)::DOUBLE AS a FROM w GROUP BY ALL), whole AS (SELECT conv_id, w, count(*)::DOUBLE AS b FROM w GROUP BY ALL),
sums AS (SELECT conv_id, turn_number, sum(a) AS na FROM own GROUP BY ALL), totals AS (SELECT conv_id, sum(b) AS nb, count(*)::DOUBLE AS v FROM whole GROUP BY ALL),
grid AS (SELECT s.conv_id, s.turn_number, na, nb, v, b, coalesce(a, 0.0) AS a FROM sums s JOIN totals t ON s.conv_id = t.conv_id JOIN whole h ON h.conv_id = s.conv_id LEFT JOIN own o ON o.conv_id = s.conv_id AND o.turn_number = s.turn_number AND o.w = h.w)''')}
SELECT conv_id, turn_number, round(1 - sum(least(a, b)) / (max(na) + max(nb) - sum(least(a, b))), 6) AS weighted_jaccard_distance,
  round(sum(((a + 0.01::DOUBLE) / (na + 0.01::DOUBLE * v)) * ln(((a + 0.01::DOUBLE) / (na + 0.01::DOUBLE * v)) / ((b + 0.01::DOUBLE) / (nb + 0.01::DOUBLE * v)))), 6) AS kl_divergence FROM grid GROUP BY ALL"""


def topic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = T.topic_vector(T.keywords(F.col("raw_text")))
    return S.seeded_turns(spark, sf_dir).select(*TURN, *[F.round(F.get(vector, F.lit(i)), 6).alias(t) for i, t in enumerate(sorted(L.TOPICS))])


QUERIES["topic_vector"] = topic_vectors
ORACLE["topic_vector"] = f"{O.base(O.keywords_cte())} SELECT conv_id, turn_number, {', '.join(f'round({x}, 6) AS {t}' for t, x in zip(sorted(L.TOPICS), O.topic_totals('k')))} FROM kw"


def trigram_profiles(docs: DataFrame) -> DataFrame:
    """(lang, trigram, freq): relative frequencies over all documents of a language."""
    rows = docs.where(F.length("text") >= 3).select("lang", F.explode(T.trigrams(F.lower("text"))).alias("trigram")).groupBy("lang", "trigram").agg(F.count("*").alias("n"))
    total = rows.groupBy("lang").agg(F.sum("n").alias("total"))
    return rows.join(total, "lang").select("lang", "trigram", (F.col("n").cast("double") / F.col("total").cast("double")).alias("freq"))


def trigram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trigram_profiles(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("lang", "trigram", F.round("freq", 9).alias("freq"))


QUERIES["trigram_profile"] = trigram_profile
_TRI = """c AS (SELECT doc_id, lang, string_split(lower(text), '') AS c FROM documents WHERE length(text) >= 3),
ch AS (SELECT doc_id, lang, unnest(c) AS ch, generate_subscripts(c, 1) AS pos FROM c),
w AS (SELECT lang, ch || lead(ch, 1) OVER d || lead(ch, 2) OVER d AS trigram FROM ch WINDOW d AS (PARTITION BY doc_id ORDER BY pos)), t AS (SELECT * FROM w WHERE trigram IS NOT NULL),
n AS (SELECT lang, trigram, count(*) AS n FROM t GROUP BY ALL), profile AS (SELECT lang, trigram, n::DOUBLE / (sum(n) OVER (PARTITION BY lang))::DOUBLE AS freq FROM n)"""
ORACLE["trigram_profile"] = f"WITH {_TRI} SELECT lang, trigram, round(freq, 9) AS freq FROM profile"


def profile_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every two languages' profiles."""
    p = trigram_profiles(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    norm = p.groupBy("lang").agg(F.sqrt(F.sum(F.col("freq") * F.col("freq"))).alias("norm"))
    a, b = p.select(F.col("lang").alias("a"), "trigram", F.col("freq").alias("fa")), p.select(F.col("lang").alias("b"), "trigram", F.col("freq").alias("fb"))
    dots = a.join(b, "trigram").where("a < b").groupBy("a", "b").agg(F.sum(F.col("fa") * F.col("fb")).alias("dot"))
    return dots.join(norm.select(F.col("lang").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("lang").alias("b"), F.col("norm").alias("nb")), "b").select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


QUERIES["cosine"] = profile_cosine
ORACLE["cosine"] = f"""WITH {_TRI}, norms AS (SELECT lang, sqrt(sum(freq * freq)) AS norm FROM profile GROUP BY lang)
SELECT a.lang AS a, b.lang AS b, round(sum(a.freq * b.freq) / (max(x.norm) * max(y.norm)), 6) AS cosine FROM profile a JOIN profile b ON a.trigram = b.trigram AND a.lang < b.lang
JOIN norms x ON x.lang = a.lang JOIN norms y ON y.lang = b.lang GROUP BY a.lang, b.lang"""


def path_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.path_root(F.col("url")).alias("root"))


QUERIES["path_root"] = path_roots
ORACLE["path_root"] = "SELECT page_id, array_to_string(string_split(url, '/')[1:4], '/') AS root FROM pages"


# Reshaping of dialogues.
def load_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_conversations(spark, sf_dir)


QUERIES["load_conversations"] = load_conversations
ORACLE["load_conversations"] = f"WITH {O.PLAIN} SELECT * FROM plain"
QUERIES["seeded_turns"] = S.seeded_turns
ORACLE["seeded_turns"] = f"WITH {O.PLAIN}, {O.TURNS} SELECT * FROM turns"
LONG = "longt AS (SELECT (conv_id // 5)::BIGINT AS conv_id, (row_number() OVER (PARTITION BY conv_id // 5 ORDER BY conv_id, turn_number))::INTEGER AS turn_number, speaker, raw_text FROM turns)"
QUERIES["long_turns"] = lambda spark, sf_dir: S.long_turns(S.seeded_turns(spark, sf_dir))
ORACLE["long_turns"] = f"{O.base(LONG)} SELECT * FROM longt"
QUERIES["merge_adjacent_speaker"] = lambda spark, sf_dir: S.merge_adjacent_speaker(S.long_turns(S.seeded_turns(spark, sf_dir)))
ORACLE["merge_adjacent_speaker"] = f"""{O.base(LONG, '''c AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn_number) THEN 0 ELSE 1 END AS d FROM longt),
r AS (SELECT *, sum(d) OVER (PARTITION BY conv_id ORDER BY turn_number) AS run FROM c)''')}
SELECT conv_id, run::INTEGER AS turn_number, any_value(speaker) AS speaker, string_agg(raw_text, ' ' ORDER BY turn_number) AS raw_text FROM r GROUP BY conv_id, run"""
QUERIES["segment_dialogue"] = lambda spark, sf_dir: S.segment_dialogue(S.long_turns(S.seeded_turns(spark, sf_dir)))
ORACLE["segment_dialogue"] = f"""{O.base(LONG, '''c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn_number) - 1 AS pos FROM longt),
s AS (SELECT *, CASE WHEN n <= 15 THEN 0 ELSE least(pos // 10, (n - 1) // 10 - CASE WHEN n % 10 > 0 AND n % 10 < 4 THEN 1 ELSE 0 END) END AS seg FROM c)''')}
SELECT format('{{}}-{{:03d}}', conv_id, (seg + 1)::INTEGER) AS entry_id, (row_number() OVER (PARTITION BY conv_id, seg ORDER BY pos))::INTEGER AS turn_number, speaker, raw_text FROM s"""
QUERIES["conversation_text"] = lambda spark, sf_dir: S.conversation_text(S.seeded_turns(spark, sf_dir))
_TEXT = "left(string_agg(trim(raw_text, ' ' || chr(10) || chr(9)), ' ' ORDER BY turn_number), 2000)"
ORACLE["conversation_text"] = f"{O.base()} SELECT conv_id, {_TEXT} AS conversation_text FROM turns WHERE turn_number <= 5 GROUP BY conv_id"


def objectives(turns: DataFrame) -> DataFrame:
    """The first user turn's text stands for the objective; every third conversation has a blank one."""
    first = turns.where("speaker = 'user'").groupBy("conv_id").agg(F.min_by("raw_text", "turn_number").alias("objective"))
    return first.withColumn("objective", F.when(F.col("conv_id") % 3 == 0, F.lit(" ")).otherwise(F.col("objective")))


def conversation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = S.seeded_turns(spark, sf_dir)
    return S.conversation_summary(turns, objectives(turns))


QUERIES["conversation_summary"] = conversation_summary
OBJECTIVES = "objectives AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE min_by(raw_text, turn_number) END AS objective FROM turns WHERE speaker = 'user' GROUP BY conv_id)"
ORACLE["conversation_summary"] = f"""{O.base(OBJECTIVES, f"c AS (SELECT conv_id, {_TEXT} AS t FROM turns WHERE turn_number <= 3 GROUP BY conv_id)")}
SELECT c.conv_id, left(coalesce(nullif(trim(objective), ''), t), 500) AS summary FROM c LEFT JOIN objectives o ON c.conv_id = o.conv_id"""


def union_dedup_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = S.seeded_turns(spark, sf_dir)
    sources = [turns.where("conv_id % 3 = 0"), turns.where("conv_id % 2 = 0"), turns]
    return S.union_dedup(sources).groupBy("source_prio").agg(F.count_distinct("conv_id").alias("entries"), F.count("*").alias("turns"))


QUERIES["union_dedup_corpus"] = union_dedup_corpus
ORACLE["union_dedup_corpus"] = f"""{O.base("s AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 0 WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END AS source_prio FROM turns)")}
SELECT source_prio, count(DISTINCT conv_id) AS entries, count(*) AS turns FROM s GROUP BY source_prio"""
