"""Labelled evaluation: confusion counts, scores by type and section, sweeps, rankings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans.settle import grown


def confusion(emitted: DataFrame, expected: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(entry_id, finding_type, tp, fp, fn) of two tables (entry_id, finding_type), sets per entry."""
    key = [*by, "entry_id", "finding_type"]
    tidy = F.upper(F.trim("finding_type"))
    a = emitted.withColumn("finding_type", tidy).select(*key).distinct().withColumn("e", F.lit(1))
    b = expected.withColumn("finding_type", tidy).select(*key).distinct().withColumn("x", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.select(*key, (F.col("e").isNotNull() & F.col("x").isNotNull()).cast("int").alias("tp"), F.col("x").isNull().cast("int").alias("fp"), F.col("e").isNull().cast("int").alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(counts: DataFrame, *by: str) -> DataFrame:
    """Sums of tp, fp, fn by ``by``, with precision, recall and F1 (0 where undefined)."""
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r))


def section_scores(counts: DataFrame) -> DataFrame:
    """Scores by section, and by section and type: a rollup."""
    sums = counts.rollup("section", "finding_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(F.coalesce("section", F.lit("all")).alias("section"), F.coalesce("finding_type", F.lit("all")).alias("finding_type"), "tp", "fp", "fn", ratio(2 * p * r, p + r).alias("f1"))


def param_sweep(scores: DataFrame, expected: DataFrame, grid: DataFrame) -> DataFrame:
    """F1 of every threshold in ``grid`` (param) over scored candidates (entry_id, finding_type, score). Each pair of entry and type
    counts once, in the slot between the thresholds that its best score passes and those it doesn't; sums over the slots give all thresholds."""
    spark = scores.sparkSession
    params = sorted(r["param"] for r in grid.select("param").distinct().collect())  # the grid is a parameter
    tidy = F.upper(F.trim("finding_type"))
    best = scores.groupBy("entry_id", tidy.alias("finding_type")).agg(F.max("score").alias("score"))
    wanted = expected.select("entry_id", tidy.alias("finding_type")).distinct().withColumn("x", F.lit(True))
    passed = F.size(F.filter(F.from_json(F.lit(str(params)), "array<double>"), lambda p: p < F.col("score")))
    pairs = best.join(wanted, ["entry_id", "finding_type"], "full_outer").select(F.coalesce("x", F.lit(False)).alias("x"), F.when(F.col("score").isNotNull(), passed).otherwise(0).alias("slot"))
    counts = pairs.groupBy("slot").agg(F.count_if("x").alias("hits"), F.count_if(~F.col("x")).alias("misses"))
    slots = spark.createDataFrame([(i, float(params[i - 1]) if i else None) for i in range(len(params) + 1)], "slot int, param double").join(counts, "slot", "left").fillna(0, ["hits", "misses"])
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("slot"))  # one row a threshold
    sums = slots.select("param", F.sum("hits").over(down).alias("tp"), F.sum("misses").over(down).alias("fp"), F.sum("hits").over(Window.partitionBy(F.lit(1))).alias("all"))
    return prf(sums.where("param is not null").select("param", "tp", "fp", (F.col("all") - F.col("tp")).alias("fn")), "param")


def hard_case_score(findings: DataFrame, expected: DataFrame, clean: DataFrame) -> DataFrame:
    """(conv_id, score): how hard conversations are, from findings (conv_id, finding_type, confidence, relevant_turns), expected types (conv_id,
    finding_type) and clean ranges of turns (conv_id, start, end): 0.3 for each type missed, 0.2 for each finding that isn't expected within a
    clean range, 0.1 for each confidence near the middle, over what could be had."""
    wanted = expected.select("conv_id", "finding_type").distinct()
    hit = wanted.join(findings.select("conv_id", "finding_type").distinct().withColumn("hit", F.lit(True)), ["conv_id", "finding_type"], "left")
    missed = hit.groupBy("conv_id").agg((F.count_if(F.col("hit").isNull()) * F.lit(0.3)).alias("won"), (F.count("*") * F.lit(0.3)).alias("most"))
    false = findings.join(wanted, ["conv_id", "finding_type"], "left_anti").select("conv_id", "finding_id", F.explode("relevant_turns").alias("t"))
    inside = false.join(clean, "conv_id").where(F.col("t").between(F.col("start"), F.col("end"))).select("conv_id", "finding_id").distinct()
    extra = inside.select("conv_id", F.lit(0.2).alias("won")).union(findings.where(F.round("confidence", 9).between(0.35, 0.65)).select("conv_id", F.lit(0.1)))
    parts = missed.select("conv_id", "won", "most").union(extra.select("conv_id", "won", F.col("won").alias("most")))
    sums = parts.groupBy("conv_id").agg(F.sum("won").alias("won"), F.sum("most").alias("most"))
    return sums.select("conv_id", F.coalesce(F.try_divide("won", "most"), F.lit(0.0)).alias("score"))


def crisp_vs_fuzzy(crisp: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """(conv_id, crisp, fuzzy, both, mean_change): two configurations' findings side by side, matched by detector."""
    a = crisp.select("conv_id", "detector_name", F.col("confidence").alias("a"))
    b = fuzzy.select("conv_id", "detector_name", F.col("confidence").alias("b"))
    rows = a.join(b, ["conv_id", "detector_name"], "full_outer")
    return rows.groupBy("conv_id").agg(F.count("a").alias("crisp"), F.count("b").alias("fuzzy"), F.count(F.col("a") + F.col("b")).alias("both"), F.coalesce(F.avg(F.col("b") - F.col("a")), F.lit(0.0)).alias("mean_change"))


def sensitivity(sweep: DataFrame, param: str) -> DataFrame:
    """Spread of F1 by a parameter's value."""
    return sweep.groupBy(param).agg(F.min("f1").alias("least"), F.max("f1").alias("most"), (F.max("f1") - F.min("f1")).alias("spread"))


def profile_scores(traits: DataFrame, weights: dict[str, tuple[float, bool]]) -> DataFrame:
    """(variant, score): traits normalised by their greatest value (1 - x where less is better), weighted."""
    rows = traits
    total: Column = F.lit(0.0)
    everything = Window.partitionBy()  # variants are a handful of presets
    for name, (weight, down) in weights.items():
        x = F.coalesce(F.try_divide(F.col(name).cast("double"), F.max(F.col(name).cast("double")).over(everything)), F.lit(0.0))
        total = total + F.lit(float(weight)) * ((1 - x) if down else x)
    return rows.select("variant", total.alias("score"))


def pareto_front(traits: DataFrame, up: tuple[str, ...], eps: float = 1e-9) -> DataFrame:
    """Variants that no other variant matches everywhere and beats somewhere."""
    a, b = traits.alias("a"), traits.alias("b")
    no_worse, better = F.lit(True), F.lit(False)
    for t in up:
        no_worse = no_worse & (F.col(f"b.{t}") >= F.col(f"a.{t}") - eps)
        better = better | (F.col(f"b.{t}") > F.col(f"a.{t}") + eps)
    return a.join(b, (F.col("a.variant") != F.col("b.variant")) & no_worse & better, "left_anti")


def label_distribution(expected: DataFrame) -> DataFrame:
    return expected.groupBy("finding_type").agg(F.count("*").alias("n"))


#: Traits of a variant, and whether less is better.
TRAITS = {
    "precision": False, "recall": False, "f1": False, "false_positive_rate": True, "latency_mean_ms": True, "latency_p95_ms": True, "latency_p99_ms": True, "stage_count": True, "cog_count": True,
}
#: What each profile weighs.
PROFILES = {
    "balanced": {"f1": 0.35, "precision": 0.15, "recall": 0.15, "latency_mean_ms": 0.15, "latency_p95_ms": 0.10, "stage_count": 0.05, "cog_count": 0.05},
    "precision-first": {"precision": 0.40, "f1": 0.20, "false_positive_rate": 0.20, "recall": 0.10, "latency_mean_ms": 0.05, "stage_count": 0.05},
    "recall-first": {"recall": 0.40, "f1": 0.25, "precision": 0.15, "latency_mean_ms": 0.10, "stage_count": 0.05, "cog_count": 0.05},
    "minimal": {"f1": 0.25, "latency_mean_ms": 0.20, "stage_count": 0.20, "cog_count": 0.15, "precision": 0.10, "recall": 0.10},
}


def variant_traits(found: DataFrame, expected: DataFrame, entries: DataFrame, measured: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per variant: counts, accuracy, the share of clean entries with findings, latencies and sizes.

    ``found`` has (variant, entry_id, finding_type), ``expected`` (entry_id, finding_type), ``entries`` all (entry_id), ``measured`` (variant, entry_id,
    latency_ms), ``sizes`` (variant, stage_count, cog_count). Percentiles are exact, between two neighbours by their distance."""
    # A handful of variants: each is held against all labels. Only they are sent to every task; their table's size is unknown before it runs, so that is said here.
    wanted = expected.select("entry_id", "finding_type").join(F.broadcast(sizes.select("variant")))
    counts = ("tp", "fp", "fn")
    each = confusion(found, wanted, ("variant",)).groupBy("variant", "entry_id").agg(*[F.sum(c).alias(c) for c in counts])
    known = entries.select("entry_id").distinct().withColumn("known", F.lit(True))
    # An entry without labels is clean, and loud with any finding.
    loud = F.count_if(F.col("known") & (F.col("tp") + F.col("fn") == 0))
    both = each.join(grown(known), "entry_id", "left").groupBy("variant").agg(*[F.sum(c).alias(c) for c in counts], loud.alias("loud"))
    quiet = entries.select("entry_id").distinct().join(grown(expected.select("entry_id")), "entry_id", "left_anti").agg(F.count("*").alias("clean"))
    at = lambda share: F.percentile("latency_ms", F.lit(share))
    times = measured.groupBy("variant").agg(F.avg("latency_ms").alias("latency_mean_ms"), at(0.95).alias("latency_p95_ms"), at(0.99).alias("latency_p99_ms"))
    # One row holds the number of clean entries.
    rows = sizes.join(both, "variant", "left").join(times, "variant", "left").join(quiet).fillna(0)
    precision, recall = (ratio(F.col("tp"), F.col("tp") + F.col(x)) for x in ("fp", "fn"))
    rows = rows.withColumns({"precision": precision, "recall": recall, "false_positive_rate": ratio(F.col("loud"), F.col("clean"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.withColumn("f1", f1).select("variant", "tp", "fp", "fn", *TRAITS)


def profile_winners(traits: DataFrame, profiles: Mapping[str, Mapping[str, float]] = PROFILES) -> DataFrame:
    """(profile, variant, score): the variant that scores best under each profile, the first by name of equals."""
    everything = Window.partitionBy()  # variants are a handful of presets
    rows = traits.withColumns({f"_{t}": F.max(t).over(everything) for t in TRAITS})

    def share(t: str) -> Column:
        x = F.try_divide(F.col(t).cast("double"), F.col(f"_{t}").cast("double"))
        return F.coalesce(1 - x if TRAITS[t] else x, F.lit(0.0))

    scores = [F.struct(F.lit(name).alias("profile"), sum((F.lit(float(w)) * share(t) for t, w in weights.items()), F.lit(0.0)).alias("score")) for name, weights in profiles.items()]
    each = rows.select("variant", F.explode(F.array(*scores)).alias("s")).select("variant", "s.*")
    best = each.groupBy("profile").agg(F.min(F.struct((-F.round("score", 9)).alias("k"), "variant", "score")).alias("b"))
    return best.select("profile", "b.variant", "b.score")


def ranked_trials(trials: DataFrame, least_recall: float = 0.8, top: int = 10) -> DataFrame:
    """The ``top`` trials (the feature) of enough recall, with ``rank``: by F1 to three digits, then fewer false positives, then the other columns in order."""
    order = [F.round("f1", 3).desc(), F.col("fp"), *[F.col(c) for c in trials.columns if c not in ("f1", "fp")]]
    best = trials.where(F.round("recall", 9) >= least_recall).orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
