"""Phrase collocations by relational mining (SETM).

The occurrence relation of length k has a row for each place of a frequent phrase of k words, sorted by piece and position.
The next relation comes from a merge-join of that one with itself, on the same piece and the adjacent position; its groups are
counted over all documents, and a semi-join with the frequent groups leaves what is extended further. Relations are written
to the shared folder, packed: a row is a block of one language's texts, whose words are numbers into the block's vocabulary,
in order, with -1 between pieces, so that sorted places lie side by side and the merge-join needs no shuffle. What crosses the
network are a block's distinct groups with their counts, packed by buckets of names.

Groups are named by hashes of 48 bits while they are searched; all counts are taken once more by the words themselves.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.arrays import BASE, blocks, mix, text_bytes, word_table, words
from colloquy.llm.scratch import Scratch, materialize

#: Pieces end at these; words are separated by them, by spaces and tabs, after A-Z are lowered.
BREAKS = b".,;:!?\n\x0b\x0c\r"
TABLE = word_table(b" \t" + BREAKS)
IS_BREAK = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(BREAKS, np.uint8))
#: Text handled at once, and words of a block.
BLOCK_BYTES, BLOCK_WORDS = 512 << 10, 400_000
FIRST = 2000
#: Bytes of a phrase's name.
MARK_BYTES = 6
#: Places of phrases whose names meet in one group, blocks of a lot, and buckets at least.
GROUP_PLACES, LOT_BLOCKS, LEAST_BUCKETS = 1_500_000, 4096, 12
#: Parts of a language that are ranked on their own before its first rows are picked.
PARTS = 64

RELATION = "block long, lang string, vocabulary binary, codes binary, starts binary"


def _lang_mark(lang: str, salt: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{salt} {lang}".encode(), digest_size=8).digest(), "little"))


class _Buffer:
    """Words of one language that wait for their block."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.joined: list[np.ndarray] = []
        #: Texts' bytes, lowered, with where their words begin and end, and how many words come before.
        self.spans: list[tuple[int, bytes, np.ndarray, np.ndarray]] = []
        self.n = 0

    def spelled(self, at: np.ndarray) -> list[str]:
        """The words at these places, which are sorted."""
        out: list[str] = []
        bounds = np.searchsorted(at, [*(before for before, *_ in self.spans), self.n]).tolist()
        for (before, raw, starts, ends), i, j in zip(self.spans, bounds, bounds[1:]):
            own = at[i:j] - before
            out += [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[own].tolist(), ends[own].tolist())]
        return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, the number of each place's value, and how often each occurs."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.flatnonzero(new)
    which = np.empty(len(x), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[first], order[first], which, np.diff(np.append(first, len(x)))


def _occurrences(salt: int):
    """The relation of length 1, with each block's words, spelled out and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[str, _Buffer] = defaultdict(_Buffer)

        def block(lang: str) -> pa.RecordBatch:
            nonlocal number
            held = waiting.pop(lang)
            hashes, joined = np.concatenate(held.hashes), np.concatenate(held.joined)
            vocabulary, places, codes, n = _distinct(hashes)
            by_place = np.argsort(places)
            spelled = np.empty(len(places), object)
            spelled[by_place] = held.spelled(places[by_place])
            # joined[i]: word i lies in one piece with its predecessor.
            codes = np.insert(codes, np.flatnonzero(~joined[1:]) + 1, -1)
            columns = [[number], [lang], [vocabulary.tobytes()], [codes.tobytes()], [None], [spelled.tolist()], [n]]
            number += 1
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "lang", "vocabulary", "codes", "starts", "words", "counts"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                own = data[offsets[i] : offsets[j]]
                starts, ends, hashes, first = words(own, offsets[i : j + 1] - offsets[i], TABLE)
                lowered = TABLE[1][own].tobytes()
                breaks = np.concatenate([[0], np.cumsum(IS_BREAK[own])])
                joined = np.zeros(len(starts), bool)
                joined[1:] = breaks[starts[1:]] == breaks[ends[:-1]]
                joined[first[:-1][first[:-1] < len(starts)]] = False
                rows = defaultdict(list)
                for row in range(i, j):
                    if first[row - i] < first[row - i + 1]:
                        rows[langs[row]].append(np.arange(first[row - i], first[row - i + 1]))
                for lang, parts in rows.items():
                    at = np.concatenate(parts)
                    held = waiting[lang]
                    held.hashes.append(mix(hashes[at] ^ _lang_mark(lang, salt)))
                    held.joined.append(joined[at])
                    held.spans.append((held.n, lowered, starts[at], ends[at]))
                    held.n += len(at)
                while sum(b.n for b in waiting.values()) > BLOCK_WORDS:
                    yield block(max(waiting, key=lambda x: waiting[x].n))
        for lang in list(waiting):
            yield block(lang)

    return run


def extended(codes: np.ndarray, starts: np.ndarray | None) -> np.ndarray:
    """Merge-join of a sorted relation with itself: the places whose neighbour is a place too."""
    at = np.flatnonzero(codes >= 0) if starts is None else starts
    return at[:-1][at[1:] == at[:-1] + 1]


def _marks(vocabulary: np.ndarray, codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Names of the phrases of k words at the places."""
    out = np.zeros(len(at), np.uint64)
    for d in range(k):
        out = mix(out * BASE + vocabulary[codes[at + d]])
    return out >> np.uint64(64 - 8 * MARK_BYTES)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    for i in range(len(batch)):
        vocabulary, codes, starts = (batch.column(c)[i].as_py() for c in ("vocabulary", "codes", "starts"))
        yield i, np.frombuffer(vocabulary, np.uint64), np.frombuffer(codes, np.int32), None if starts is None else np.frombuffer(starts, np.int32)


def _pack(marks: np.ndarray) -> bytes:
    """Sorted names, the bytes of equal weight side by side: the upper ones hardly change and compress well."""
    return marks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :MARK_BYTES].T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // MARK_BYTES, 8), np.uint8)
    out[:, :MARK_BYTES] = np.frombuffer(raw, np.uint8).reshape(MARK_BYTES, -1).T
    return out.view("<u8").ravel()


def _groups(k: int, buckets: int, lots: int):
    """(bucket, lot, block, marks, n): a block's distinct phrases of k words whose first and last k - 1 are in the relation,
    dealt by their names to buckets, and blocks to lots, so that no bucket gets a row from every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for i, vocabulary, codes, starts in _unpacked(batch):
                block = batch.column("block")[i].as_py()
                marks, n = np.unique(_marks(vocabulary, codes, extended(codes, starts), k), return_counts=True)
                ends = np.searchsorted(marks * np.uint64(buckets) >> np.uint64(8 * MARK_BYTES), np.arange(buckets + 1, dtype=np.uint64))
                lot = (block * 0x9E3779B1 >> 7) % lots
                rows = [(b, lot, block, _pack(marks[u:v]), n[u:v].astype("<u4").tobytes()) for b, (u, v) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if u < v]
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["bucket", "lot", "block", "marks", "n"])

    return run


def _summed(marks: pa.ChunkedArray, n: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names of packed rows, with the sums of their counts."""
    names = np.concatenate([_unpack(x.as_py()) for x in marks])
    counts = np.concatenate([np.frombuffer(x.as_py(), kind) for x in n])
    found, which = np.unique(names, return_inverse=True)
    return found, np.bincount(which, counts, len(found)).astype(np.int64)


def _counted(rows: pa.Table) -> pa.Table:
    marks, n = _summed(rows.column("marks"), rows.column("n"), "<u4")
    return pa.table({"bucket": rows.column("bucket")[:1], "marks": pa.array([_pack(marks)], pa.binary()), "n": pa.array([n.astype("<i8").tobytes()], pa.binary())})


def _often(least: int):
    def run(rows: pa.Table) -> pa.Table:
        marks, n = _summed(rows.column("marks"), rows.column("n"), "<i8")
        return pa.table({"bucket": rows.column("bucket")[:1], "marks": pa.array([_pack(marks[n >= least])], pa.binary())})

    return run


def _semi_joined(groups: pa.Table, frequent: pa.Table) -> pa.Table:
    """(block, marks): each block's names that are frequent."""
    known = np.concatenate([_unpack(x.as_py()) for x in frequent.column("marks")] or [np.zeros(0, np.uint64)])
    blocks_, kept = [], []
    for block, raw in zip(groups.column("block").to_pylist(), groups.column("marks").to_pylist()):
        own = np.intersect1d(_unpack(raw), known, assume_unique=True)
        if len(own):
            blocks_.append(block)
            kept.append(_pack(own))
    return pa.table({"block": pa.array(blocks_, pa.int64()), "marks": pa.array(kept, pa.binary())})


def _kept(k: int):
    """The relation of length k: places of the block's frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for i, vocabulary, codes, starts in _unpacked(batch):
                at = extended(codes, starts)
                frequent = np.concatenate([_unpack(x) for x in batch.column("marks")[i].as_py()])
                packed.append(at[np.isin(_marks(vocabulary, codes, at, k), frequent)].astype(np.int32).tobytes())
            columns = [batch.column(c) for c in ("block", "lang", "vocabulary", "codes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], ["block", "lang", "vocabulary", "codes", "starts"])

    return run


def extend(relation: DataFrame, k: int, least: int, scratch: Scratch) -> DataFrame:
    """The relation of length k from that of length k - 1: merge-join, group-count over all blocks, semi-join."""
    size = relation.agg(F.count("*").alias("blocks"), (F.sum(F.octet_length(F.coalesce("starts", "codes"))) / 4).alias("places")).first()
    lots = max(1, -(-size["blocks"] // LOT_BLOCKS))
    buckets = max(LEAST_BUCKETS, int((size["places"] or 0) / lots / GROUP_PLACES) + 1)
    groups = relation.mapInArrow(_groups(k, buckets, lots), "bucket int, lot int, block long, marks binary, n binary")
    counted = groups.select("bucket", "lot", "marks", "n").groupBy("bucket", "lot").applyInArrow(_counted, "bucket int, marks binary, n binary")
    frequent = scratch.keep(counted.groupBy("bucket").applyInArrow(_often(least), "bucket int, marks binary"), "frequent")
    to_all = frequent.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    held = groups.select("bucket", "lot", "block", "marks").groupBy("bucket", "lot").cogroup(to_all.groupBy("bucket", "lot")).applyInArrow(_semi_joined, "block long, marks binary")
    held = scratch.keep(held.groupBy("block").agg(F.collect_list("marks").alias("marks")), "block-groups")
    return relation.join(held, "block").mapInArrow(_kept(k), RELATION)


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of small numbers, and how often each occurs; where a row fits one number, that is sorted."""
    bits, k = max(1, int(rows.max(initial=0)).bit_length()), rows.shape[1]
    if bits * k > 63:
        return np.unique(rows, axis=0, return_counts=True)
    packed = np.zeros(len(rows), np.int64)
    for d in range(k):
        packed = packed << bits | rows[:, d]
    found, n = np.unique(packed, return_counts=True)
    return np.stack([found >> bits * (k - 1 - d) & (1 << bits) - 1 for d in range(k)], axis=1).astype(np.int32), n


def _phrases(k: int):
    """(phrase, n): the words of a block's phrases, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, vocabulary, codes, starts in _unpacked(batch):
                found, n = _distinct_rows(codes[starts[:, None] + np.arange(k)] if len(starts) else np.zeros((0, k), np.int32))
                flat = pa.array(vocabulary[found].ravel().view(np.int64))
                phrase = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * k), flat)
                yield pa.RecordBatch.from_arrays([phrase, pa.array(n)], ["phrase", "n"])

    return run


def frequent_phrases(docs: DataFrame, longest: int, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(word, lang, spelled, f) of all words, and (phrase, f) of phrases of one to ``longest`` words with f >= least."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    salt = 0
    while True:
        own = Scratch(docs.sparkSession)
        first = own.keep(texts.mapInArrow(_occurrences(salt), f"{RELATION}, words array<string>, counts array<long>"), "occurrences", "zstd")
        blobs = first.select("lang", "vocabulary", "words", "counts").mapInArrow(_named, "word long, lang string, spelled string, n long")
        vocabulary = scratch.keep(blobs.groupBy("word", "lang", "spelled").agg(F.sum("n").alias("f")), "vocabulary")
        if vocabulary.groupBy("word").count().where("count > 1").isEmpty():
            break
        # Two words of one hash: all is named anew.
        own.clear()
        salt += 1
    phrases = vocabulary.where(F.col("f") >= least).select(F.array("word").alias("phrase"), "f")
    relation, made = first.drop("words", "counts"), own
    for k in range(2, longest + 1):
        longer = Scratch(docs.sparkSession)
        relation = longer.keep(extend(relation, k, least, scratch), "relation", "zstd")
        made.clear()
        made = longer
        counted = relation.mapInArrow(_phrases(k), "phrase array<long>, n long").groupBy("phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        phrases = phrases.union(scratch.keep(counted, "phrases"))
    made.clear()
    return vocabulary, phrases


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            word = np.frombuffer(batch.column("vocabulary")[i].as_py(), np.int64)
            lang = pa.array([batch.column("lang")[i].as_py()] * len(word), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(word), lang, batch.column("words")[i].values, batch.column("counts")[i].values], ["word", "lang", "spelled", "n"])


def _within(longer: DataFrame) -> DataFrame:
    """(phrase, most): the phrases of two words or more that lie inside longer ones, with the greatest f of those."""
    size = F.size("phrase")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("phrase", i, n))))
    return longer.where(size > 2).select(F.explode(parts).alias("phrase"), "f").groupBy("phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered_percent: int = 50, first: int = FIRST) -> DataFrame:
    """Per lang its ``first`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    f counts contiguous occurrences inside pieces, overlaps included; n all words of the lang (null: ``und``). A phrase of 2 to
    ``longest`` words with a = f >= ``least`` is scored at its cuts, floor(1000000 * a * a / (l * r)) with l, r = f of both
    parts; the least cut counts, the shorter first part on ties. Phrases inside a longer one with 100 * f(longer) >=
    ``covered_percent`` * a are dropped. Order: score and a descending, phrase by UTF-8 bytes. Null and empty texts have no words, repeated
    rows count as often as they occur, other columns are not read, and an empty table gives no rows. Counts must stay below 10**15.
    """
    scratch = Scratch(docs.sparkSession)
    vocabulary, phrases = frequent_phrases(docs, longest, least, scratch)
    candidates = phrases.where(F.size("phrase") > 1)
    cuts = candidates.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("phrase", 1, F.col("k")), "tail": F.slice("phrase", F.col("k") + 1, F.size("phrase"))})
    part = lambda name, f: phrases.select(F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), "head").join(part("tail", "r"), "tail")
    whole = "cast({} as decimal(15,0))".format
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")
    scored = cuts.groupBy("phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = _within(candidates)
    left = scored.join(inside, "phrase", "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * covered_percent, F.lit(True)))
    left = left.select(F.monotonically_increasing_id().alias("id"), "phrase", "a", "cut")
    left = scratch.keep(left, "scored")
    spelled = left.select("id", F.posexplode("phrase").alias("at", "word")).join(vocabulary.select("word", "lang", "spelled"), "word")
    spelled = spelled.groupBy("id").agg(F.any_value("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "spelled"))), lambda x: x["spelled"]), " ").alias("phrase"))
    rows = left.drop("phrase").join(spelled, "id").select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    total = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    out = materialize(rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")), "collocations")
    scratch.clear()
    return out
