"""Document fingerprints by winnowing.

Hashes of all k-grams of characters are rolled along the text; of every window of w consecutive
ones the least is chosen, the rightmost of equals. Any two texts that share w + k - 1 characters in a row
share a chosen hash, and positions are kept, so matches can be located.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrays import BASE, INVERSE, mix, powers

#: Characters of a gram, and grams of a window, for texts of all sizes: any 31 characters in common are found.
GRAM, WINDOW = 12, 20
#: Positions worked on at once in one text; their number fits the low bits beside a hash.
SEGMENT = 1 << 20


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams, 40 bits each, rolled by prefix sums."""
    n = len(points) - k + 1
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(points)), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * powers(INVERSE, n)) >> np.uint64(24)


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, ascending. A text of fewer than k characters is one gram, one of
    fewer than w grams one window; an empty text has none."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(points))
    n = len(points) - k + 1
    w = min(w, n)
    low = np.uint64(SEGMENT * 2 - 1)
    chosen_at = []
    for start in range(0, n - w + 1, SEGMENT):
        stop = min(start + SEGMENT + w - 1, n)
        hashes = gram_hashes(points[start : stop + k - 1], k)
        # The later of equal hashes has the smaller low bits: it is the less.
        least = (hashes << np.uint64(21)) | (low - np.arange(len(hashes), dtype=np.uint64))
        span = 1
        while span < w:
            step = min(span, w - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        keep = np.ones(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=keep[1:])
        at = (low - (least[keep] & low)).astype(np.int64)
        chosen_at.append((hashes[at], at + start))
    hashes = np.concatenate([h for h, _ in chosen_at])
    at = np.concatenate([p for _, p in chosen_at])
    if len(chosen_at) > 1:
        at, first = np.unique(at, return_index=True)
        hashes = hashes[first]
    return hashes, at


def as_text(hashes: np.ndarray, at: np.ndarray) -> str:
    """``hash@position`` in hexadecimal and decimal, comma-joined."""
    return ",".join([f"{h:x}@{p}" for h, p in zip(hashes.tolist(), at.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Chosen hashes in common over all of either; 1 for two empty fingerprints."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hashes array<long>, positions array<long>) of every text; null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t or "", k, w) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))],
                [id_col, "hashes", "positions"],
            )

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, hashes array<bigint>, positions array<bigint>")


def in_order(docs: DataFrame, n_ranges: int) -> DataFrame:
    """Documents dealt into ranges of descending doc_id, sorted within each, with each range's
    successor (the next range's first row, ``halo`` true) at its end. Rows of one id are in the order of their text's hash,
    and an id that holds several quantiles has as many ranges, cut by that hash. Ranges are found from quantiles,
    the successors are one row a range; the first range also follows the last."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    # All bits turned, so that ids ascend as they should descend; null ids come last.
    docs = docs.withColumn("rev", F.bitwise_not(F.coalesce("doc_id", F.lit(-(2**63)).cast("bigint")))).withColumn("hash", F.xxhash64("text"))
    cuts = docs.agg(F.percentile_approx("rev", [i / n_ranges for i in range(1, n_ranges)] or [0.5], 10000)).first()[0] or []
    bounds = F.lit(sorted(cuts)).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    own = F.size(F.filter(bounds, lambda c: c == F.col("rev")))
    share = F.shiftright((F.shiftright("hash", 32) + 2**31) * own, 32)
    place: Column = F.size(F.filter(bounds, lambda c: c < F.col("rev"))) + F.when(own > 1, share).otherwise(0)
    rows = docs.withColumn("range", place.cast("int"))
    heads = rows.groupBy("range").agg(F.min(F.struct("rev", "hash")).alias("head")).orderBy("range").collect()  # one row a range
    if not heads:
        return rows.select("range", F.lit(False).alias("halo"), "doc_id", "text")
    before = spark.createDataFrame([(*h["head"], h["range"], heads[i - 1]["range"]) for i, h in enumerate(heads)], "rev long, hash long, range int, to int")
    first = rows.join(F.broadcast(before), ["range", "rev", "hash"]).groupBy("to").agg(F.min("text").alias("text"))
    none = F.lit(None).cast("long")
    halo = first.select(F.col("to").alias("range"), F.lit(True).alias("halo"), none.alias("doc_id"), "text", none.alias("rev"), none.alias("hash"))
    both = rows.select("range", F.lit(False).alias("halo"), "doc_id", "text", "rev", "hash").union(halo)
    # By range, as hashes of a few range numbers would fall together.
    return both.repartitionByRange(n_ranges, "range").sortWithinPartitions("range", "halo", "rev", "hash", "text").select("range", "halo", "doc_id", "text")


def _edited(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            ranges, halo, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            for r, is_halo, doc_id, text in zip(ranges, halo, ids, texts):
                mark = None
                if held is not None and held[0] == r:
                    _, held_id, own, (hashes, at) = held
                    mark = winnow(text, k, w)
                    n = len(own)
                    edited = own[: n - n // 3] + text[: n // 3]
                    changed, changed_at = winnow(edited, k, w)
                    out.append((held_id, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), as_text(hashes, at), as_text(changed, changed_at), likeness(hashes, changed), likeness(hashes, mark[0])))
                held = None if is_halo else (r, doc_id, text, mark or winnow(text, k, w))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


#: Text bytes of a range of documents that one task compares.
RANGE_BYTES = 32 << 20


def _ranges(docs: DataFrame) -> int:
    """As many ranges as there are shuffle partitions, and more where texts are large."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))


def compare_with_edits(docs: DataFrame, n_ranges: int | None = None, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    Edited: the last third of the characters is replaced by as many from the start of the next
    document in descending doc_id; the first follows the last. Null text is empty, rows of equal id
    follow in the order of their text's hash, null ids come last. One row per row of ``docs``.
    """
    n = n_ranges or _ranges(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, n).mapInArrow(_edited(k, w), schema)
