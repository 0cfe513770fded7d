"""Canonical turns from tables and files, and reshaping of dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy.functions.text import listed, lowered, phrase_any

SNAPSHOT = "entry_id string, input struct<turns: array<struct<turn_number: int, speaker: string, raw_text: string>>, objective: string, total_turns: int>, expected array<struct<finding_type: string>>, _corrupt string"


def load_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns(conv_id, turn_number from 1, speaker, raw_text) of the conversations table."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", (F.col("turn") + 1).cast("int").alias("turn_number"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("raw_text"))


def seeded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a known sentence added to every turn, so that every detector has something to find: conversations
    have themes, and each turn the next sentence of its conversation's theme."""
    rows = load_conversations(spark, sf_dir)
    pick = F.pmod("conv_id", F.lit(len(L.THEMES))) * 8 + F.pmod(F.col("turn_number") - 1, F.lit(8))
    return rows.withColumn("raw_text", F.concat("raw_text", F.lit(" "), F.get(listed(L.SEEDS), pick.cast("int"))))


def long_turns(turns: DataFrame, group: int = 5) -> DataFrame:
    """Dialogues of ``group`` conversations each, renumbered."""
    order = Window.partitionBy("conv").orderBy("conv_id", "turn_number")
    rows = turns.withColumn("conv", F.floor(F.col("conv_id") / group).cast("long"))
    return rows.select(F.col("conv").alias("conv_id"), F.row_number().over(order).alias("turn_number"), "speaker", "raw_text")


def merge_adjacent_speaker(turns: DataFrame) -> DataFrame:
    """Runs of turns by one speaker as one turn, texts joined by a blank."""
    order = Window.partitionBy("conv_id").orderBy("turn_number")
    changed = (F.col("speaker") != F.lag("speaker").over(order)).cast("int")
    runs = turns.withColumn("run", F.sum(F.coalesce(changed, F.lit(1))).over(order))
    merged = runs.groupBy("conv_id", "run").agg(F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct("turn_number", "raw_text"))).alias("parts"))
    return merged.select("conv_id", F.col("run").cast("int").alias("turn_number"), "speaker", F.array_join(F.col("parts")["raw_text"], " ").alias("raw_text"))


def segment_dialogue(turns: DataFrame, size: int = 10, whole: int = 15, least: int = 4) -> DataFrame:
    """Dialogues in segments of ``size`` turns; one of up to ``whole`` turns stays whole, and a last
    segment of fewer than ``least`` joins the one before."""
    n = F.count("*").over(Window.partitionBy("conv_id"))
    rows = turns.withColumn("n", n).withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_number")) - 1)
    rest = F.col("n") % size
    last = F.floor((F.col("n") - 1) / size) - F.when((rest > 0) & (rest < least), 1).otherwise(0)
    segment = F.when(F.col("n") <= whole, 0).otherwise(F.least(F.floor(F.col("at") / size), last)).cast("int")
    rows = rows.withColumn("segment", segment)
    return rows.select(F.concat(F.col("conv_id").cast("string"), F.format_string("-%03d", F.col("segment") + 1)).alias("entry_id"), F.row_number().over(Window.partitionBy("conv_id", "segment").orderBy("at")).alias("turn_number"), "speaker", "raw_text")


def conversation_text(turns: DataFrame, first: int = 5, limit: int = 2000) -> DataFrame:
    """The first turns of each conversation, trimmed and joined by a blank, cut at ``limit`` characters."""
    parts = F.array_sort(F.collect_list(F.struct("turn_number", F.btrim("raw_text", F.lit(" \n\t")).alias("t"))))
    joined = turns.where(F.col("turn_number") <= first).groupBy("conv_id").agg(parts.alias("parts"))
    return joined.select("conv_id", F.left(F.array_join(F.col("parts")["t"], " "), F.lit(limit)).alias("conversation_text"))


def conversation_summary(turns: DataFrame, objectives: DataFrame, limit: int = 500) -> DataFrame:
    """The objective if it isn't blank, else the first three turns, cut at ``limit``."""
    told = objectives.select("conv_id", F.nullif(F.trim("objective"), F.lit("")).alias("objective"))
    return conversation_text(turns, 3, 2000).join(told, "conv_id", "left").select("conv_id", F.left(F.coalesce("objective", "conversation_text"), F.lit(limit)).alias("summary"))


def user_override(turns: DataFrame, phrases: tuple[str, ...] = L.OVERRIDE) -> DataFrame:
    """Marks user turns that change direction."""
    return turns.withColumn("override", (F.col("speaker") == "user") & phrase_any(lowered(F.col("raw_text")), phrases))


def parse_snapshots(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """NDJSON snapshots (``value``) -> (turns, expected(entry_id, finding_type), counts of good and skipped lines). Lines that don't
    parse, or lack entry_id or input, are skipped and counted."""
    rows = lines.select(F.from_json("value", SNAPSHOT, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("p")).select("p.*")
    bad = F.col("_corrupt").isNotNull() | F.col("entry_id").isNull() | F.col("input").isNull()
    good = rows.where(~bad)
    turns = good.select("entry_id", F.posexplode("input.turns").alias("at", "t"))
    turns = turns.select("entry_id", F.coalesce("t.turn_number", F.col("at") + 1).alias("turn_number"), F.coalesce("t.speaker", F.lit("unknown")).alias("speaker"), F.coalesce("t.raw_text", F.lit("")).alias("raw_text"))
    expected = good.select("entry_id", F.explode("expected.finding_type").alias("finding_type"))
    return turns, expected, rows.agg(F.count_if(~bad).alias("read"), F.count_if(bad).alias("skipped"))


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of NDJSON snapshots -> (turns, counts of good and skipped lines)."""
    turns, _, counts = parse_snapshots(spark.read.text(path))
    return turns, counts


def read_labeled_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of an NDJSON corpus -> (turns, expected(entry_id, finding_type))."""
    turns, expected, _ = parse_snapshots(spark.read.text(path))
    return turns, expected


def normalize_records(raw: DataFrame) -> DataFrame:
    """Raw generated conversations (``value``: JSON, perhaps inside ``` fences) -> canonical turns."""
    plain = F.regexp_replace("value", r"(?m)^```[a-z]*\s*$", "")
    parsed = F.from_json(plain, "turns array<struct<speaker: string, text: string, content: string>>, topic string")
    rows = raw.select("entry_id", parsed.alias("p")).select("entry_id", F.col("p.topic").alias("objective"), F.posexplode("p.turns").alias("at", "t"))
    return rows.select("entry_id", "objective", (F.col("at") + 1).alias("turn_number"), F.coalesce("t.speaker", F.lit("unknown")).alias("speaker"), F.coalesce("t.text", "t.content", F.lit("")).alias("raw_text"))


def union_dedup(sources: list[DataFrame], key: str = "conv_id") -> DataFrame:
    """Union by priority: the first source that has a key keeps it."""
    rows = sources[0].withColumn("source_prio", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("source_prio", F.lit(i)))
    return rows.withColumn("_best", F.min("source_prio").over(Window.partitionBy(key))).where("source_prio = _best").drop("_best")


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """Lines (``value``) -> (phrase): one a line; blank lines and comments are skipped."""
    rows = lines.select(F.trim("value").alias("phrase"))
    return rows.where((F.col("phrase") != "") & ~F.col("phrase").startswith("#"))


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A file of phrases; ``phrases_of`` makes it a detector's list."""
    return parse_lexicon(spark.read.text(path))


def phrases_of(lexicon: DataFrame, most: int = 10_000) -> tuple[str, ...]:
    """A lexicon as a list parameter, in lower case and order; more than ``most`` phrases are refused."""
    rows = lexicon.select(F.lower("phrase").alias("phrase")).distinct().orderBy("phrase").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a phrase list has {most} phrases at most")
    return tuple(r["phrase"] for r in rows)


def parse_lang_profiles(files: DataFrame) -> DataFrame:
    """(lang, value: {trigram: share}) -> (lang, trigram, freq)."""
    return files.select("lang", F.explode(F.from_json("value", "map<string,double>")).alias("trigram", "freq"))


def load_lang_profiles(spark: SparkSession, path: str) -> DataFrame:
    """{trigram: share} files, one a language -> (lang, trigram, freq)."""
    return parse_lang_profiles(spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([a-z]+)\.json$", 1).alias("lang"), "value"))


def findings_to_corpus(verified: DataFrame) -> DataFrame:
    """Verified findings (entry_id, finding_type, conversation_text) -> labelled turns (entry_id, turn_number, speaker, raw_text,
    finding_type): one turn a line, speakers A and B by turns; empty lines count and are left out."""
    lines = verified.select("entry_id", "finding_type", F.posexplode(F.split("conversation_text", "\n")).alias("at", "raw_text")).where("raw_text <> ''")
    return lines.select("entry_id", (F.col("at") + 1).alias("turn_number"), F.when(F.col("at") % 2 == 0, "A").otherwise("B").alias("speaker"), "raw_text", "finding_type")


def annotations(expected: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, types): every entry's expected types as a JSON list in order of name, null for a clean entry."""
    lists = expected.groupBy("entry_id").agg(F.to_json(F.array_sort(F.collect_set("finding_type"))).alias("types"))
    return entries.select("entry_id").distinct().join(lists, "entry_id", "left")


def corpus_quality(lines: DataFrame) -> DataFrame:
    """(lines, invalid, mean_turns, types) of NDJSON lines (``value``): how many, how many don't parse, their turns on the mean, rounded
    down, and their expected types in order of name."""
    parsed = lines.select(F.from_json("value", SNAPSHOT, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("p"))
    bad = F.col("p._corrupt").isNotNull()
    types = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(~bad, F.col("p.expected.finding_type"))))))
    return parsed.agg(F.count("*").alias("lines"), F.count_if(bad).alias("invalid"), F.floor(F.avg(F.when(~bad, F.size("p.input.turns")))).alias("mean_turns"), F.array_join(types, ",").alias("types"))


def write_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    """Findings as Parquet, one folder a finding type."""
    findings.write.mode(mode).partitionBy("finding_type").parquet(path)


def append_ledger(rows: DataFrame, path: str, run: str) -> None:
    """Adds a run's rows to a ledger of runs (memory) or outcomes. A run has its own folder, which writing it again replaces, so a
    run that is repeated after a failure counts once."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a ledger, with their ``run``, as text."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), "/run=([^/]+)/", 1))


def latest(ledger: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """The latest row of every id: greatest ``at`` (null is before all), then the latest run by name, then the greatest other values in order. A
    maximum, so many rows of one id are combined before they are shuffled; columns must be orderable."""
    first = [o for o in (at, "run") if o in ledger.columns]
    rest = [c for c in ledger.columns if c not in (key, *first)]
    newest = ledger.groupBy(key).agg(F.max(F.struct(*first, *rest)).alias("_row"))
    return newest.select(key, "_row.*").select(*ledger.columns)


def compact_ledger(spark: SparkSession, path: str, to: str, key: str = "id", at: str = "at") -> None:
    """Writes a ledger's latest rows as one run of a new ledger at ``to``; the old one stays until its readers have moved."""
    append_ledger(latest(read_ledger(spark, path), key, at).drop("run"), to, "compacted")


def write_annotations(expected: DataFrame, entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``annotations`` as JSON lines."""
    annotations(expected, entries).write.mode(mode).option("ignoreNullFields", "false").json(path)
