"""Best-fit packing of tokenized documents into fixed sequences, by minimum bin slack.

Documents become pieces in one distributed pass. What a bin can hold depends on piece lengths
alone, so the packing itself works on the histogram of lengths: at most ``capacity`` numbers,
whatever the corpus size. Per bin, a bitset subset-sum over the lengths still available finds the
fullest combination that holds the longest one left; it is removed as often as the counts allow.
Pieces then find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.scratch import materialize
from colloquy.llm.tokenization import bpe, with_end

CAPACITY = 1024
#: A length's pieces are ranked in so many independent groups: one length may hold a third of all.
SPREAD = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer_path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = with_end(*bpe(tokenizer_path).encode(batch.column(1)), end_id)
            sizes = np.diff(offsets)
            n_pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            first = sizes - (n_pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            at = offsets[:-1][row] + start
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(at.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                edges = np.append(at, at[-1] + length[-1] if len(at) else 0)
                columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: a document's ids with the end id, cut into ``capacity`` ids where longer;
    the first piece is the shorter one. Null text is empty: it gives the end id alone. ``with_ids`` adds the ids."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer_path, end_id, capacity, with_ids), schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths, the longest among them, that leaves least slack.

    ``reach`` has bit s set if some choice so far sums to s; it is kept after each length, so that
    the choice can be read off backwards. Stops once the bin can be filled to the brim.
    """
    order = sorted(counts, reverse=True)
    seed = order[0]
    left = dict(counts)
    left[seed] -= 1
    room = capacity - seed
    limit = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int]] = []
    for length in order:
        if length > room or not left[length]:
            continue
        before = reach
        # Up to left[length] copies by doubling: 1, 2, 4, ... and the rest.
        copies, step = min(left[length], room // length), 1
        while copies > 0:
            take = min(step, copies)
            reach |= (reach << (length * take)) & limit
            copies -= take
            step *= 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = {seed: 1}
    for length, before in reversed(steps):
        k = 0
        while not before >> total & 1:
            total -= length
            k += 1
        if k:
            chosen[length] = chosen.get(length, 0) + k
    return chosen


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) until every piece is in a bin."""
    counts = {k: v for k, v in histogram.items() if v}
    out = []
    while counts:
        chosen = fullest(counts, capacity)
        times = min(counts[k] // m for k, m in chosen.items())
        out.append((times, chosen))
        for k, m in chosen.items():
            counts[k] -= times * m
            if not counts[k]:
                del counts[k]
    return out


def places(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of a length go where: (length, lo, hi, first sequence, copies a sequence, offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in patterns(histogram, capacity):
        offset = 0
        for length in sorted(chosen, reverse=True):
            m, lo = chosen[length], used.get(length, 0)
            rows.append((length, lo, lo + times * m, sequence, m, offset))
            used[length] = lo + times * m
            offset += m * length
        sequence += times
    return rows


def _ranked(rows: DataFrame, key: str, spread: Column, order: list[Column]) -> DataFrame:
    """Adds ``rank``, gapless from 0 among the rows of a key, without one task for a hot key."""
    rows = rows.withColumn("_spread", spread)
    counted = rows.groupBy(key, "_spread").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_spread").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(key, "_spread", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_spread").orderBy(*order)) - 1)
    # counted has at most capacity x SPREAD rows.
    return own.join(F.broadcast(counted), [key, "_spread"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_spread", "_before", "_own")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents; returns a row per piece with its ``sequence_id`` and ``offset``.

    Every piece is placed once, offsets in a sequence run gapless from 0, and no sequence exceeds
    ``capacity``. Null or empty text is one end id. Repeated rows are packed as often as they
    occur; null ids are kept. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "lo", "hi", "first", "copies", "at")])
    table = spark.createDataFrame(places(histogram, capacity), schema)
    ranked = _ranked(cut, "length", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SPREAD)), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    # table depends on the histogram alone: a few rows per length.
    placed = ranked.join(F.broadcast(table), "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    q = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(q / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + (q % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
