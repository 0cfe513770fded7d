"""Results that later steps read several times, worked out once and kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

from colloquy.operators.context import FEATURES, enrich

_fallback: list[str] = []


def _folder(df: DataFrame) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode (tests), on a cluster an error."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="spark-settled-"))
    return _fallback[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read again: readers take only the columns they need."""
    path = f"{_folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """A table to be joined that has rows for every conversation, finding or turn. Spark takes its size from that of files, whose columns pack to a hundredth, and would send it to all tasks by way
    of the driver's memory; so it is said that both sides are to be dealt out and sorted."""
    return df.hint("merge")


def featured(turns: DataFrame, *names: str) -> DataFrame:
    """Turns with what detectors read of their texts (``names`` as of ``enrich``, all by default), worked out once and written. Conversations are dealt out first: a table in few files
    would otherwise be read, and its texts worked on, in as few tasks. Turns that have them all are left as they are."""
    if all(n in turns.columns for n in names or FEATURES):
        return turns
    return written(enrich(turns.repartition("conv_id"), *names), "features")


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: its plan is cut, so that what follows is planned quickly, and no executor's loss undoes it."""
    context = df.sparkSession.sparkContext
    folder = _folder(df)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
