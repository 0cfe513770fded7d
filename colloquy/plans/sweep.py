"""A grid of detector parameters over a labelled corpus, in one job.

Each parameter moves one finding type, and a type's parameters none of the others, so counts are taken for each type's own
small grid, from distances and shares that are worked out once, and then added up for every combination.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import detectors as D
from colloquy.operators.evaluate import prf

#: The grid of 1,200 combinations.
GRID = {
    "drift_threshold": (0.60, 0.65, 0.70, 0.75, 0.79),
    "sustained_turns": (2, 3, 4, 5, 6),
    "anchor_threshold": (0.20, 0.25, 0.30, 0.35),
    "orbit_threshold": (0.45, 0.50, 0.55, 0.60),
    "min_citations": (2, 3, 4),
}
#: What the grid decides; all other types' findings are given.
MOVED = ("SCOPE_DRIFT", "CONCEPTUAL_ANCHORING", "INHERITED_POSITION")


def _values(values: Sequence[float]):
    return F.array(*[F.lit(v) for v in values])


def drift_hits(turns: DataFrame, objectives: DataFrame, grid: Mapping[str, Sequence], **params) -> DataFrame:
    """(conv_id, drift_threshold, sustained_turns) of every combination under which a conversation drifts."""
    d = D.drift_distances(turns, objectives, **params).select("conv_id", "turn_number", "distance", F.explode(_values(grid["drift_threshold"])).alias("drift_threshold"))
    order = Window.partitionBy("conv_id", "drift_threshold").orderBy("turn_number")
    far = d.withColumn("far", F.round("distance", 9) > F.col("drift_threshold"))
    runs = far.withColumn("run", F.sum((~F.col("far")).cast("int")).over(order)).where("far").groupBy("conv_id", "drift_threshold", "run").agg(F.count("*").alias("n"))
    longest = runs.groupBy("conv_id", "drift_threshold").agg(F.max("n").alias("n"))
    return longest.select("conv_id", "drift_threshold", F.explode(F.filter(_values(grid["sustained_turns"]), lambda s: s <= F.col("n"))).alias("sustained_turns"))


def orbit_hits(turns: DataFrame, grid: Mapping[str, Sequence], **params) -> DataFrame:
    """(conv_id, anchor_threshold, orbit_threshold) of every combination under which a conversation circles its anchor."""
    later = D.orbits(turns, **params).select("conv_id", "sim", "conceded", F.explode(_values(grid["anchor_threshold"])).alias("anchor_threshold"))
    share = D.ratio(F.count_if(F.col("sim") >= F.col("anchor_threshold")), F.count("sim"))
    sums = later.groupBy("conv_id", "anchor_threshold").agg(share.alias("orbit"), F.max("conceded").alias("conceded")).where("not conceded")
    return sums.select("conv_id", "anchor_threshold", F.explode(F.filter(_values(grid["orbit_threshold"]), lambda o: o <= F.col("orbit"))).alias("orbit_threshold"))


def citation_hits(turns: DataFrame, grid: Mapping[str, Sequence], share: float = 0.7) -> DataFrame:
    """(conv_id, min_citations) of every number under which a conversation inherits its positions."""
    cited = turns.where(T.authority_citation(F.col("raw_text")).isNotNull()).withColumn("bare", ~T.independent_justification(F.col("raw_text")))
    sums = cited.groupBy("conv_id").agg(F.count("*").alias("n"), D.ratio(F.count_if("bare"), F.count("*")).alias("share")).where(F.col("share") >= share)
    return sums.select("conv_id", F.explode(F.filter(_values(grid["min_citations"]), lambda m: m <= F.col("n"))).alias("min_citations"))


def parameter_grid(turns: DataFrame, objectives: DataFrame, fixed: DataFrame, expected: DataFrame, grid: Mapping[str, Sequence] = GRID, drift: Mapping | None = None, orbit: Mapping | None = None) -> DataFrame:
    """Counts, precision, recall and F1 of every combination: ``fixed`` has findings (conv_id, finding_type) of the types that don't move,
    ``expected`` labels (conv_id, finding_type); ``drift`` and ``orbit`` are further parameters of those detectors."""
    spark = turns.sparkSession
    wanted = expected.select("conv_id", F.upper(F.trim("finding_type")).alias("finding_type")).distinct().withColumn("x", F.lit(True))
    still = fixed.where(~F.col("finding_type").isin(*MOVED)).select("conv_id", "finding_type").distinct().withColumn("e", F.lit(True))
    both = still.join(wanted.where(~F.col("finding_type").isin(*MOVED)), ["conv_id", "finding_type"], "full_outer")
    total = both.agg(F.count_if(F.col("e") & F.col("x")).alias("tp_0"), F.count_if(F.col("x").isNull()).alias("fp_0"), F.count_if(F.col("e").isNull()).alias("fn_0"))
    parts = (("SCOPE_DRIFT", ("drift_threshold", "sustained_turns"), drift_hits(turns, objectives, grid, **(drift or {}))), ("CONCEPTUAL_ANCHORING", ("anchor_threshold", "orbit_threshold"), orbit_hits(turns, grid, **(orbit or {}))), ("INHERITED_POSITION", ("min_citations",), citation_hits(turns, grid)))
    for i, (kind, names, hits) in enumerate(parts, 1):
        own = wanted.where(F.col("finding_type") == kind).select("conv_id", "x")
        n = own.agg(F.count("*").alias(f"n_{i}"))
        counts = hits.join(own, "conv_id", "left").groupBy(*names).agg(F.count_if("x").alias(f"tp_{i}"), F.count_if(F.col("x").isNull()).alias(f"fp_{i}"))
        every = spark.range(1)
        for name in names:
            every = every.withColumn(name, F.explode(_values(grid[name])))
        # A few dozen combinations of this type, and one row of totals.
        total = total.join(every.drop("id").join(counts, list(names), "left").fillna(0, [f"tp_{i}", f"fp_{i}"])).join(n)
    add = lambda what: sum((F.col(f"{what}_{i}") for i in (1, 2, 3)), F.col(f"{what}_0") if what != "n" else F.col("fn_0"))
    counted = total.select(*GRID, add("tp").alias("tp"), add("fp").alias("fp"), (add("n") - sum((F.col(f"tp_{i}") for i in (2, 3)), F.col("tp_1"))).alias("fn"))
    return prf(counted, *GRID)
