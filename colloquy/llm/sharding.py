"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``replicas`` points on a ring of 64-bit hashes; a key belongs to the first point at or
after its own hash. A shard takes no more than its capacity: keys beyond it continue clockwise to the
next point whose shard has room. The ring is small (shards x replicas arcs), so where the overflow
goes is worked out on counts per arc; rows then find their shard by their rank within their arc. Capacities that sum to
the number of rows leave shards at most one row apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Points of a shard, and cells of equal width by which rows find their arc.
REPLICAS, CELL_BITS = 128, 12
#: Rows of one repeated key spelt out at a time.
CHUNK = 65536


def ring(spark: SparkSession, n_shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(position, shard) of all points, clockwise."""
    points = spark.range(n_shards * replicas).select((F.col("id") % n_shards).cast("int").alias("shard"), F.xxhash64(F.lit("point"), (F.col("id") % n_shards), F.floor(F.col("id") / n_shards)).alias("position"))
    return sorted((r["position"], r["shard"]) for r in points.collect())  # n_shards x replicas rows


def allocate(counts: dict[int, int], owners: list[int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, lo, hi, shard): which ranks of an arc's rows go to which shard.

    Arcs fill their own shard first, clockwise; what overflows then continues clockwise, arc by
    arc, to the next points whose shards have room.
    """
    room = list(capacities)
    out, over = [], []
    for arc, owner in enumerate(owners):
        n = counts.get(arc, 0)
        take = min(n, room[owner])
        if take:
            out.append((arc, 0, take, owner))
            room[owner] -= take
        if take < n:
            over.append((arc, take, n))
    for arc, at, n in over:
        step = arc
        while at < n:
            step = (step + 1) % len(owners)
            take = min(n - at, room[owners[step]])
            if take:
                out.append((arc, at, at + take, owners[step]))
                room[owners[step]] -= take
                at += take
    return out


def capacities(total: int, n_shards: int, slack: float = 0.0) -> list[int]:
    """Rows each shard may hold; without slack they sum to ``total``."""
    if slack:
        return [int(-(-total * (1 + slack) // n_shards))] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def arcs_of(rows: DataFrame, key: Column, points: list[tuple[int, int]]) -> DataFrame:
    """Adds ``position`` (the key's hash) and ``arc``, the index of the point the key belongs to.

    The ring is cut into 2**CELL_BITS equal cells; a cell's row lists its points, so the lookup is
    an equi-join with a table whose size depends on the ring alone.
    """
    spark = rows.sparkSession
    cells: list[tuple[int, list[tuple[int, int]], int]] = []
    at, n = 0, len(points)
    for cell in range(1 << CELL_BITS):
        end = -(1 << 63) + ((cell + 1) << (64 - CELL_BITS))
        own = []
        while at < n and points[at][0] < end:
            own.append((points[at][0], at))
            at += 1
        cells.append((cell - (1 << (CELL_BITS - 1)), own, at % n))
    table = spark.createDataFrame(cells, "cell int, points array<struct<position: long, arc: int>>, beyond int")
    keyed = rows.withColumn("position", F.xxhash64(F.lit("key"), key)).withColumn("cell", F.shiftright("position", 64 - CELL_BITS).cast("int"))
    first = F.filter("points", lambda p: p["position"] >= F.col("position"))
    return keyed.join(F.broadcast(table), "cell").withColumn("arc", F.when(F.size(first) > 0, first[0]["arc"]).otherwise(F.col("beyond"))).drop("cell", "points", "beyond")


def assign(docs: DataFrame, n_shards: int = 24, replicas: int = REPLICAS, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots run gapless from 0 in a shard.

    ``size`` is the text's UTF-8 bytes plus 8, null text none. Equal rows are counted before they
    are dealt out, so no key is hot. Null ids hash as one key. With ``slack`` shards may exceed their even share by that
    part, and fewer rows leave the shard of their hash; without, counts are at most one apart.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    points = ring(spark, n_shards, replicas)
    distinct = arcs_of(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), F.col("doc_id"), points)
    order = Window.partitionBy("arc").orderBy("position", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn("upto", F.sum("copies").over(order))
    # At most n_shards x replicas rows.
    counts = {r["arc"]: r["n"] for r in distinct.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}
    parts = allocate(counts, [s for _, s in points], capacities(sum(counts.values()), n_shards, slack))
    filled = [0] * n_shards
    table = []
    for arc, lo, hi, shard in parts:
        table.append((arc, lo, hi, shard, filled[shard]))
        filled[shard] += hi - lo
    table = spark.createDataFrame(table, "arc int, lo long, hi long, shard int, base long")
    # One row an arc, and one for each shard that an overflow reaches.
    placed = ranked.join(F.broadcast(table), "arc").where((F.col("upto") > F.col("lo")) & (F.col("upto") - F.col("copies") < F.col("hi")))
    low = F.greatest(F.col("upto") - F.col("copies"), F.col("lo"))
    placed = placed.withColumn("from", F.col("base") + low - F.col("lo")).withColumn("n", F.least("upto", "hi") - low)
    chunk = placed.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    one = chunk.withColumn("i", F.explode(F.sequence(F.col("c") * CHUNK, F.least((F.col("c") + 1) * CHUNK, F.col("n")) - 1)))
    return one.select("doc_id", "size", "text_crc32", "shard", (F.col("from") + F.col("i")).cast("long").alias("slot"))
