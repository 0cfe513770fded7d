"""Repeated passages by a compacted De Bruijn graph of words.

A window of ``window`` consecutive words is an edge of the graph; it leads from its first ``window - 1`` words to its
last. An edge that occurs twice or more, anywhere, is repeated. Paths of repeated edges that never branch are compacted
into one piece (a unitig): edge e and the next edge e' belong together where every occurrence of e goes on with e' and both
occur equally often, for then every occurrence of e' comes from e. Each text that holds one edge of a unitig so holds all
of it, which makes compaction a join of the edges' counts with the texts that hold them.

Edges are named by 64-bit hashes, so spans are verified at their source: occurrences of a unitig count only together with
those whose words, read from the text, have the same digest.

Few words are shuffled: of the seeds (runs of ``seed`` words) in a window the one of least hash stands for it. A window can
only be repeated if its seed is, so edges are made for windows of repeated seeds alone. Copies of one and the same text
are counted first and then stand for one text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrays import BASE, INVERSE, blocks, lists, mix, powers, text_bytes, word_table, words
from colloquy.llm.scratch import Scratch, materialize

#: Words are [^\x20\x09-\x0D]+, unchanged.
TABLE = word_table(bytes([0x20, *range(0x09, 0x0E)]), lower=False)
WINDOW, SEED = 35, 12
#: Text handled at once.
BLOCK_BYTES = 512 << 10


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, len(hashes)), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * powers(INVERSE, n))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every ``width`` consecutive values, by their upper bits; of equals the first."""
    bits = np.uint64(max(21, len(values).bit_length()))
    least = values >> bits << bits | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


@dataclass
class Windows:
    """All windows of some texts back to back: their edges' names, those of the edges that follow (0 at a text's end), seeds'
    names and positions, text numbers, and each text's first window (n + 1 values)."""

    edge: np.ndarray
    following: np.ndarray
    seed: np.ndarray
    seed_at: np.ndarray
    row: np.ndarray
    first: np.ndarray
    #: Word boundaries, and each text's first word.
    starts: np.ndarray
    ends: np.ndarray
    first_word: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray, window: int, seed: int) -> Windows:
    starts, ends, hashes, first_word = words(data, offsets, TABLE)
    n_texts = len(offsets) - 1
    n = max(0, len(hashes) - window + 1)
    owner = np.repeat(np.arange(n_texts), np.diff(first_word))
    at = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n else np.zeros(0, np.int64)
    edge, grams = rolled(hashes, window).view(np.int64), rolled(hashes, seed)
    row = owner[at]
    following = np.zeros(len(at), np.int64)
    goes_on = row[1:] == row[:-1]
    following[:-1][goes_on] = edge[at[1:][goes_on]]
    seed_at = least_of(grams, window - seed + 1)[at] if n else at
    return Windows(edge[at], following, grams[seed_at].view(np.int64), seed_at, row, np.searchsorted(row, np.arange(n_texts + 1)), starts, ends, first_word)


def _in_blocks(batch: pa.RecordBatch, column: int, window: int, seed: int) -> Iterator[tuple[int, np.ndarray, Windows]]:
    data, offsets = text_bytes(batch.column(column))
    for i, j in blocks(offsets, BLOCK_BYTES):
        own = data[offsets[i] : offsets[j]]
        yield i, own, windows(own, offsets[i : j + 1] - offsets[i], window, seed)


def _seeds(window: int, seed: int):
    """(seed, id, n): how often each seed stands for windows of a text, counting places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, w in _in_blocks(batch, 1, window, seed):
                # A place follows its equals, as windows are in order.
                place = np.flatnonzero(np.append(True, w.seed_at[1:] != w.seed_at[:-1])) if len(w.row) else w.row
                both = np.stack([w.row[place], w.seed[place]], axis=1)
                found, n = np.unique(both, axis=0, return_counts=True) if len(both) else (both, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 1]), pa.array(ids[i + found[:, 0]]), pa.array(n)], ["seed", "id", "n"])

    return run


def _edges(window: int, seed: int):
    """(edge, id, n, low, flip): edges of windows with a repeated seed, once a text; least and greatest following edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            known, ends = batch.column(3).flatten().to_numpy(), np.asarray(batch.column(3).offsets)
            for i, _, w in _in_blocks(batch, 2, window, seed):
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for row in range(len(w.first) - 1):
                    a, b = w.first[row], w.first[row + 1]
                    at = a + np.flatnonzero(np.isin(w.seed[a:b], known[ends[i + row] - ends[0] : ends[i + row + 1] - ends[0]]))
                    if not len(at):
                        continue
                    order = at[np.argsort(w.edge[at], kind="stable")]
                    edge, following = w.edge[order], w.following[order]
                    begins = np.flatnonzero(np.append(True, edge[1:] != edge[:-1]))
                    low = np.minimum.reduceat(following, begins)
                    flip = np.maximum.reduceat(following, begins) ^ low
                    n = np.diff(np.append(begins, len(edge))) * copies[i + row]
                    for column, values in zip(out, (edge[begins], np.full(len(begins), ids[i + row]), n, low, flip)):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["edge", "id", "n", "low", "flip"])

    return run


def unitigs(edge: np.ndarray, known: np.ndarray, n: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of every unitig in a text's windows: ``known`` edges, sorted, with their counts and whether only
    one edge follows them."""
    at = np.minimum(np.searchsorted(known, edge), len(known) - 1)
    inside = known[at] == edge
    goes_on = inside[:-1] & inside[1:] & single[at[:-1]] & (n[at[:-1]] == n[at[1:]])
    first = np.flatnonzero(inside & ~np.append(False, goes_on))
    last = np.flatnonzero(inside & ~np.append(goes_on, False))
    return first, last


def _spans(window: int, seed: int):
    """(unitig, digest, id, n, starts, words): a text's unitigs, each once with all its places (first words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32()]
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.asarray(batch.column(3).offsets)
            edge, n, single = (batch.column(3).flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for i, own, w in _in_blocks(batch, 2, window, seed):
                raw, out = own.tobytes(), []
                for row in range(len(w.first) - 1):
                    a, b = ends[i + row] - ends[0], ends[i + row + 1] - ends[0]
                    order = a + np.argsort(edge[a:b])
                    text = w.edge[w.first[row] : w.first[row + 1]]
                    first, last = unitigs(text, edge[order], n[order], single[order])
                    word = w.first_word[row]
                    tokens = [raw[s:e] for s, e in zip(w.starts[word : w.first_word[row + 1]].tolist(), w.ends[word : w.first_word[row + 1]].tolist())]
                    places = defaultdict(list)
                    for p, q in zip(first.tolist(), last.tolist()):
                        size = q - p + window
                        places[int(text[p]), hashlib.blake2b(b" ".join(tokens[p : p + size]), digest_size=16).digest(), size].append(p)
                    out += [(u, digest, ids[i + row], len(at) * copies[i + row], at, size) for (u, digest, size), at in places.items()]
                columns = zip(*out) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["unitig", "digest", "id", "n", "starts", "words"])

    return run


def _cut(window: int, with_text: bool):
    """(key, n_words, n_removed, kept_sha256, kept_text) of a text without the words of its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            keys, copies, spans = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(3)
            data, offsets = text_bytes(batch.column(2))
            for i, j in blocks(offsets, BLOCK_BYTES):
                own = data[offsets[i] : offsets[j]]
                starts, ends, _, first = words(own, offsets[i : j + 1] - offsets[i], TABLE)
                raw, out = own.tobytes(), []
                for row in range(j - i):
                    n = int(first[row + 1] - first[row])
                    covered = np.zeros(n + 1, np.int64)
                    if copies[i + row] > 1 and n >= window:
                        covered[0] += 1
                    for span in spans[i + row].as_py() or ():
                        np.add.at(covered, span["starts"], 1)
                        np.add.at(covered, [p + span["words"] for p in span["starts"]], -1)
                    kept = first[row] + np.flatnonzero(np.cumsum(covered[:n]) == 0)
                    text = b" ".join([raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())])
                    out.append((keys[i + row], n, n - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if with_text else None))
                columns = zip(*out) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["key", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def distinct_texts(docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, key, copies, text) of every text that isn't null or empty, once."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''").withColumn("key", _key(F.col("text")))
    once = rows.groupBy("key").agg(F.count("*").alias("copies"), F.any_value("text").alias("text"))
    # The number is given when the table is written, and stays.
    return scratch.keep(once.select(F.monotonically_increasing_id().alias("id"), "key", "copies", "text"), "texts")


def spans_of(texts: DataFrame, window: int, seed: int, scratch: Scratch) -> DataFrame:
    """(id, unitig, starts, words, occurrences): the verified repeated spans of the texts."""
    plain = texts.select("id", "copies", "text")
    seeds = scratch.keep(texts.select("id", "text").mapInArrow(_seeds(window, seed), "seed long, id long, n long"), "seeds")
    shared = seeds.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")
    hits = seeds.join(shared, "seed").groupBy("id").agg(F.collect_list("seed").alias("seeds"))
    edges = plain.join(hits, "id").select("id", "copies", "text", "seeds").mapInArrow(_edges(window, seed), "edge long, id long, n long, low long, flip long")
    edges = scratch.keep(edges, "edges")
    high = F.col("low").bitwiseXOR(F.col("flip"))
    counts = edges.groupBy("edge").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max(high).alias("high")).where("n > 1")
    counts = scratch.keep(counts.select("edge", "n", (F.col("low") == F.col("high")).alias("single")), "edge-counts")
    held = edges.select("edge", "id").join(counts, "edge").groupBy("id").agg(F.collect_list(F.struct("edge", "n", "single")).alias("edges"))
    spans = plain.join(held, "id").select("id", "copies", "text", "edges").mapInArrow(_spans(window, seed), "unitig long, digest binary, id long, n long, starts array<int>, words int")
    spans = scratch.keep(spans, "spans")
    sure = spans.groupBy("unitig", "digest").agg(F.sum("n").alias("occurrences")).where("occurrences > 1")
    return spans.join(sure, ["unitig", "digest"]).select("id", "unitig", "starts", "words", "occurrences")


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """(text_md5, unitig, start, n_words, occurrences): every place of a repeated nonbranching passage, by distinct text;
    ``start`` counts words from 0, ``occurrences`` all places in all rows. Passages may overlap; what they cover together is
    what windows that occur more than once cover, but for texts that only repeat as a whole, which have no rows here."""
    scratch = Scratch(docs.sparkSession)
    texts = distinct_texts(docs, text_col, scratch)
    found = spans_of(texts, window, seed, scratch).join(texts.select("id", F.lower(F.hex("key")).alias("text_md5")), "id")
    found = materialize(found.select("text_md5", "unitig", F.explode("starts").alias("start"), F.col("words").alias("n_words"), "occurrences"), "repeated-spans")
    scratch.clear()
    return found


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and (``with_text``) kept_text: each text without the words that a window
    of ``window`` words covers whose words also start anywhere else, in the same text too; kept words are joined by one space.

    Null, empty and wordless texts have no words and an empty rest. Repeated rows are copies of each other, so texts of
    ``window`` words or more that occur twice are removed whole, in every row. Columns of these names in ``docs`` are replaced.
    """
    if not 0 < seed <= window:
        raise ValueError("a seed must fit into a window")
    scratch = Scratch(docs.sparkSession)
    texts = distinct_texts(docs, text_col, scratch)
    spans = spans_of(texts, window, seed, scratch).groupBy("id").agg(F.collect_list(F.struct("starts", "words")).alias("spans"))
    rest = texts.join(spans, "id", "left").select("key", "copies", "text", "spans")
    rest = rest.mapInArrow(_cut(window, with_text), "key binary, n_words long, n_removed long, kept_sha256 string, kept_text string")
    rest = materialize(rest.withColumnRenamed("key", "_rest_key"), "rests")
    scratch.clear()
    made = {"n_words": F.coalesce("_r.n_words", F.lit(0)), "n_removed": F.coalesce("_r.n_removed", F.lit(0)), "kept_sha256": F.coalesce("_r.kept_sha256", F.sha2(F.lit(""), 256))}
    if with_text:
        made["kept_text"] = F.coalesce("_r.kept_text", F.lit(""))
    keyed = docs.withColumn("_text_key", _key(F.col(text_col).cast("string")))
    joined = keyed.alias("_d").join(rest.alias("_r"), F.col("_d._text_key") == F.col("_r._rest_key"), "left")
    return joined.select(*[F.col(f"_d.`{c}`") for c in docs.columns if c not in made], *[v.alias(k) for k, v in made.items()])
