"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Files hold documents in ascending id order, one range a file, so readers can take stripes in
parallel, skip files and stripes by their minimum and maximum, and row groups by the Bloom filter.
There are as many ranges as the texts' bytes ask for, and one id's rows may lie in several.
Positions in the whole stream are a file's offset (one number a file) plus a position kept in the file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.scratch import materialize
from colloquy.llm.tokenization import bpe, with_end

FILE_SCHEMA = "shard int, local_start long, doc_id long, ids array<int>"
#: Fixed values of the file format used here: rows a row group, bytes a stripe.
ROW_GROUP, STRIPE_BYTES = 1000, 16 << 20
#: Text bytes of a range of documents, which one task encodes into one file.
RANGE_BYTES = 32 << 20


def _encode(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            ids, offsets = with_end(*bpe(tokenizer_path).encode(batch.column(2)), end_id)
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(before + offsets[:n], pa.int64()), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                ["shard", "local_start", "doc_id", "ids"],
            )
            before += int(offsets[n])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encodes all texts and writes them to ``path`` in ascending ``doc_id`` order.

    Null ids come first; rows with one id are ordered by the hash of their text, so a frequent id is split between files, and
    repeated rows by the partition they come from. Null text is empty and gives the end id alone.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    keys = ["doc_id", "_hash", "_from"]
    sorted_docs = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.spark_partition_id().alias("_from"))
        .repartitionByRange(n_ranges, *keys)
        .sortWithinPartitions(*keys)
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )
    (
        sorted_docs.mapInArrow(_encode(tokenizer_path, end_id), FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; a filter on ``doc_id`` prunes files, stripes and row groups."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets = ids.offsets.to_numpy()
        raw = np.asarray(ids.values).astype("<u4")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            ["shard", "local_start", "doc_id", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """Per document from the files: its place in the whole stream, its number of ids and their crc32."""
    rows = materialize(tokens.select("shard", "local_start", "doc_id", "ids").mapInArrow(_digest, "shard int, local_start long, doc_id long, n_tokens long, ids_crc32 long"), "token-digests")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file.
    totals = totals.select("shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(totals), "shard").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
