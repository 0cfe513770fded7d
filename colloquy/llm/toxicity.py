"""Toxicity by a convolutional text classifier trained in numpy.

Words are looked up in hashed embedding tables: two by the word, so that words which collide in one
differ in the other, and two by its first letters, so that inflected forms are alike. Filters of several widths slide over them, and the greatest response of each filter in the whole text feeds a logistic output. Training reads a bounded sample of labelled documents;
class balance, which the sample distorts, is put back from counts over all labels. Per-language thresholds
are calibrated on all labelled documents outside the fit, by histograms of their scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrays import blocks, text_bytes, word_table, words

#: Words are runs of ASCII letters, digits and non-ASCII characters; A-Z are lowered.
TABLE = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
BUCKETS, DIM = 1 << 14, 6
STEMS = (4, 5)
TABLES = 2 + len(STEMS)
WIDTHS, FILTERS = (1, 2, 3), 8
#: Bound of the training sample: documents of each class.
SAMPLE = 2500
BLOCK_BYTES = 4 << 20
#: Score histograms: bins of a unit of log odds, which are cut at +- REACH.
BINS, REACH = 100, 20
#: Labelled documents outside the fit from which on a language has its own threshold.
LEAST = 50


@dataclass
class Model:
    """Embedding tables (the last row is padding), filters by width, output weights."""

    tables: list[np.ndarray]
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    #: Added to the output: the log odds of the corpus less those of the sample.
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    responses: dict = field(default_factory=dict)

    def prepare(self) -> None:
        """Each filter's response to every bucket, so that scoring is lookups and sums."""
        for w, f in self.filters.items():
            for j in range(w):
                for t, table in enumerate(self.tables):
                    self.responses[w, j, t] = (table @ f[j, t * DIM : (t + 1) * DIM]).astype(np.float32)


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bucket in every table (TABLES x words), and each text's first word (n + 1 values)."""
    _, _, hashes, first, cut = words(data, offsets, TABLE, STEMS)
    low = np.uint64(BUCKETS - 1)
    return np.stack([(h & low).astype(np.uint16) for h in (hashes, hashes >> np.uint64(40), *cut)]), first


def padded(buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket sequences with padding behind every text, and each text's first and end position."""
    pad = max(WIDTHS)
    sizes = np.diff(first)
    n = buckets.shape[1]
    starts = first[:-1] + pad * np.arange(len(sizes))
    at = np.arange(n) + pad * np.repeat(np.arange(len(sizes)), sizes)
    out = np.full((TABLES, n + pad * len(sizes) + pad), BUCKETS, np.int32)
    out[:, at] = buckets
    return out, starts, starts + np.maximum(sizes, 1)


def score_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability that each text is toxic."""
    return score_buckets(model, *buckets_of(data, offsets))


def score_buckets(model: Model, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    seqs, starts, ends = padded(buckets, first)
    n = len(starts)
    logit = np.full(n, model.bias + model.shift)
    edges = np.empty(2 * n, np.int64)
    edges[::2], edges[1::2] = starts, ends
    for i, w in enumerate(WIDTHS):
        length = seqs.shape[1] - w + 1
        total = np.zeros((length, FILTERS), np.float32)
        for j in range(w):
            for t, seq in enumerate(seqs):
                total += model.responses[w, j, t][seq[j : j + length]]
        top = np.maximum.reduceat(total, edges, axis=0)[::2] + model.biases[w]
        logit += np.maximum(top, 0) @ model.out[i * FILTERS : (i + 1) * FILTERS]
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def train(texts: list[np.ndarray], labels: np.ndarray, steps: int = 600, batch: int = 48, seed: int = 7) -> Model:
    """Fits the network to texts given as buckets (TABLES x words)."""
    rng = np.random.default_rng(seed)
    tables = [(0.02 * rng.standard_normal((BUCKETS + 1, DIM))).astype(np.float32) for _ in range(TABLES)]
    # One dimension of each table starts from how surely a bucket's share of documents differs by class.
    sizes = np.maximum(np.bincount(labels, minlength=2), 1)
    for t, table in enumerate(tables):
        seen = np.zeros((2, BUCKETS))
        for h, y in zip(texts, labels):
            seen[int(y), np.unique(h[t])] += 1
        overall = (seen.sum(axis=0) + 0.5) / (sizes.sum() + 1)
        z = (seen[1] / sizes[1] - seen[0] / sizes[0]) / np.sqrt(overall * (1 - overall) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)
        table[:BUCKETS, 0] = np.clip(z / 4, -3, 3)
        table[BUCKETS] = 0
    filters = {w: (0.1 * rng.standard_normal((w, TABLES * DIM, FILTERS))).astype(np.float32) for w in WIDTHS}
    biases = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    out = (0.1 * rng.standard_normal(len(WIDTHS) * FILTERS)).astype(np.float32)
    dense = {**{("f", w): filters[w] for w in WIDTHS}, **{("b", w): biases[w] for w in WIDTHS}, ("o", 0): out, ("c", 0): np.zeros(1, np.float32)}
    first = {k: np.zeros_like(v) for k, v in dense.items()}
    second = {k: np.zeros_like(v) for k, v in dense.items()}
    moved = [np.full(BUCKETS + 1, 0.1, np.float32) for _ in tables]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(texts))])
        pick, order = order[:batch], order[batch:]
        seqs, starts, ends = padded(np.concatenate([texts[i] for i in pick], axis=1), np.concatenate([[0], np.cumsum([texts[i].shape[1] for i in pick])]))
        x = np.concatenate([t[s] for t, s in zip(tables, seqs)], axis=1)
        n, tops, where = len(pick), [], []
        for w in WIDTHS:
            length = len(x) - w + 1
            response = sum(x[j : j + length] @ filters[w][j] for j in range(w)) + biases[w]
            at = np.stack([s + response[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
            where.append(at)
            tops.append(np.take_along_axis(response, at, axis=0))
        pooled = np.maximum(np.concatenate(tops, axis=1), 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ out + dense["c", 0][0], -30, 30)))
        error = (p - labels[pick]) / n
        grad = {("o", 0): pooled.T @ error + 1e-4 * out, ("c", 0): np.array([error.sum()])}
        back = np.outer(error, out) * (pooled > 0)
        dx_at, dx = [], []
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad["b", w] = g.sum(axis=0)
            df = np.zeros_like(filters[w])
            for j in range(w):
                df[j] = np.einsum("df,dfk->kf", g, x[where[i] + j])
                dx_at.append((where[i] + j).ravel())
                dx.append((g[:, :, None] * filters[w][j].T[None]).reshape(-1, TABLES * DIM))
            grad["f", w] = df + 1e-4 * filters[w]
        for k, value in dense.items():
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            value -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        at, change = np.concatenate(dx_at), np.concatenate(dx)
        for t, table in enumerate(tables):
            rows, inverse = np.unique(seqs[t][at], return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, inverse, change[:, t * DIM : (t + 1) * DIM])
            moved[t][rows] += (total**2).sum(axis=1)
            table[rows] -= 0.05 * total / np.sqrt(moved[t][rows])[:, None]
            table[BUCKETS] = 0
    return Model(tables, filters, biases, out, float(dense["c", 0][0]))


def best_threshold(counts: np.ndarray, totals: np.ndarray, default: float) -> float:
    """The score from which on F1 is greatest, from histograms of clean and toxic documents (2 x bins) that stand for
    ``totals`` of each class; ``default`` where one class is missing."""
    seen = counts.sum(axis=1)
    if not seen.all():
        return default
    clean, toxic = np.cumsum(counts[:, ::-1], axis=1) * (totals / seen)[:, None]
    best = int(np.argmax(2 * toxic / (toxic + clean + totals[1])))
    return float(1 / (1 + np.exp(REACH - (counts.shape[1] - 1 - best) / BINS)))


def _bins(shared):
    """(doc_id, lang, bin of the score); bin -1 for texts of the fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, inside = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            found = [score_texts(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets, BLOCK_BYTES)]
            value = np.concatenate(found) if found else np.zeros(0)
            with np.errstate(divide="ignore"):
                odds = np.clip(np.log(value) - np.log1p(-value), -REACH, REACH)
            place = np.where(np.isin(batch.column(3).to_numpy(), inside), -1, np.floor((odds + REACH) * BINS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place)], ["doc_id", "lang", "bin"])

    return run


def calibrated(docs: DataFrame, labels: DataFrame, model: Model, inside: np.ndarray, threshold: float) -> dict[str, float]:
    """Thresholds by language, and overall under "", from all documents of ``labels`` but texts of the fit, whose
    hashes are ``inside``; each class counts as often as it is labelled."""
    shared = docs.sparkSession.sparkContext.broadcast((model, inside))
    # Scored before the join, so that it deals no texts.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    rows = rows.mapInArrow(_bins(shared), "doc_id long, lang string, bin int").join(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id")
    counts: dict[str, np.ndarray] = {}
    # A language has two times the bins at most.
    for r in rows.groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["lang"], np.zeros((2, 2 * REACH * BINS + 2)))[r["toxic"], r["bin"] + 1] += r["n"]
    if not counts:
        return {}
    every = sum(counts.values())
    found = {"": best_threshold(every[:, 1:], every.sum(axis=1), threshold)}
    for lang, own in counts.items():
        if lang and own[:, 1:].sum() >= LEAST:
            found[lang] = best_threshold(own[:, 1:], own.sum(axis=1), found[""])
    return found


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        packed = []
        for i, j in blocks(offsets, BLOCK_BYTES):
            found, first = buckets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            packed += [found[:, a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary()), batch.column(3)], ["lang", "toxic", "buckets", "key"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> Model:
    """Trains on the texts of ``labels`` (doc_id, toxic): of each class the ``sample`` documents whose ids
    hash lowest. Every fifth of them is kept out of the fit and calibrates, with all documents beyond the sample, the thresholds by language."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit("sample"), "doc_id")).limit(sample) for y in (0, 1)]
    # Two times ``sample`` ids at most.
    rows = docs.join(F.broadcast(parts[0].union(parts[1])), "doc_id").dropDuplicates(["doc_id"]).select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    frame = rows.mapInArrow(_buckets, "lang string, toxic int, buckets binary, key long").toArrow()
    texts = [np.frombuffer(x.as_py(), np.uint16).reshape(TABLES, -1) for x in frame.column("buckets").combine_chunks()]
    marked = np.array(frame.column("toxic").to_pylist(), np.int64)
    if not len(texts):
        model = train([np.zeros((TABLES, 0), np.uint16)], np.zeros(1, np.int64), steps=1)
        model.bias = -5.0
        model.prepare()
        return model
    marks = np.array([zlib.crc32(h.tobytes()) % 5 for h in texts])
    use = np.flatnonzero(marks != 0) if len(texts) > 50 else np.arange(len(texts))
    model = train([texts[i] for i in use], marked[use])
    used = np.bincount(marked[use], minlength=2) + 1
    model.shift = float(np.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1)) - np.log(used[1] / used[0]))
    model.prepare()
    model.tables = []
    model.thresholds = calibrated(docs, labels, model, frame.column("key").to_numpy()[use], threshold)
    return model


def scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, lang, score, lang_threshold, flagged) of every document: the score reads the text alone; ``flagged``
    compares it with the threshold of the document's language, or the overall one where it has none.

    Null text is empty; empty texts get the score of no evidence. Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            found = [score_texts(own, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets, BLOCK_BYTES)]
            value = np.concatenate(found) if found else np.zeros(0)
            overall = own.thresholds.get("", threshold)
            least = np.array([own.thresholds.get(x or "", overall) for x in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value), pa.array(least), pa.array(value >= least)], ["doc_id", "lang", "score", "lang_threshold", "flagged"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, score double, lang_threshold double, flagged boolean")
