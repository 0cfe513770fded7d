"""Quality by a language model of words and characters with interpolated modified Kneser-Ney smoothing.

The longest grams are whole words with their counts over all trusted text, so the model grows with the
corpus; a word's probability is interpolated with that of its spelling, under n-grams of its bytes. Those
lower orders count in how many different words (and then contexts) their gram occurs, not how often.

    p(word) = (n - D(n)) / N + freed / N * p(spelling)

Of the bigrams, those of a word with itself are kept: a word's row also has how often it followed itself,
r of its n occurrences, interpolated with the share of words that ever do so, each word counting once:

    p(again | word) = (r - D(r)) / n + (D(r) + D(n - r)) / n * p(again)

A text's log perplexity is the sum of two by token: that of its words, and that of whether each is said again behind
itself. So one that says a word over and over is unlikely, however likely the word. (In one model of both, a repetition
would cost less than a word of invented or rare spelling, and such texts would look like good ones.)

Documents are judged by the model of order 2, in which a word's probability hangs on the word before it (the text's edge,
spelled as the empty word, before the first one and as what follows the last):

    p(word | before) = (c - D(c)) / c(before) + freed(before) / c(before) * p(word)

Here c counts all pairs of words in all trusted text, freed(before) sums D(c) over what follows that word, and p(word) is the above with
n the number of different words that it follows, as Kneser and Ney have it. In log p that is a sum of p(word), of the share
that its context frees, and of a gain for each pair that the trusted text holds: gains are rows of the word table too.

A text's log probability is then a sum that every text has (spelling and freed mass of each of its words)
plus gains for each word that the trusted text holds, one by its occurrences and one by its repetitions. Byte grams are at most 2**24 by construction and
are sent to the tasks, which sum up the first part; the words, counted per document, are dealt to the
shards of the word table, and only sums by document come back. No place holds all words.
Logarithms are rounded to whole numbers of 2**-20, so sums don't depend on their order.

Documents are judged by quantiles of the trusted documents' log perplexity in their language, taken in units of
its spread among trusted texts of as many tokens: sqrt(a + b / n), the b for what a few words leave to chance,
the a for how texts of any size differ, both by least squares. So a long text must be nearer the mean than a short
one. The upper limit comes from trusted texts held out of the fit, as most documents aren't in it either,
the lower one from all of them, so that texts of the fit are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.arrays import BASE, blocks, mix, span_hashes, text_bytes, word_table, words
from colloquy.llm.scratch import Scratch, materialize

BLOCK_BYTES = 512 << 10
#: Words are runs of ASCII letters, digits and non-ASCII characters, their case kept; runs of more than PIECE bytes are
#: cut into pieces. Every other byte is a token of its own, but for single spaces behind something else.
TABLE = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=False)
PIECE = 32
#: Words of a shard of the model, and bytes of documents' words that meet it at once; a shard is copied for each such part.
SHARD_WORDS, GROUP_BYTES = 350_000, 24 << 20
#: The order of the model that judges documents. In that of order 2, tokens whose pairs are counted at once, rows of a shard of
#: words and pairs, and the parts in which pairs are counted, gains worked out and documents looked up, so that a part's shuffle is gone before the next.
ORDER = 2
PAIR_TOKENS, SHARD_PAIRS, PARTS = 3_000_000, 1_500_000, 4
#: A word's key in its shard: the low bytes of its hash; the others pick the shard.
KEY_BYTES = 5
#: Logarithms are whole numbers of this fraction.
UNIT = 1 << 20
#: Documents are kept between these quantiles of trusted perplexity. One in HELD of the trusted texts is held out of the
#: fit and gives the upper one; a language with under LEAST of them is judged by the limits over all languages.
LOW, HIGH, HELD, LEAST = 0.001, 0.995, 5, 20
#: Deviations are counted in bins of 1/BINS; moments are sums of whole numbers of 1/SCALE.
BINS, SCALE = 1000, 10**6
#: Ids of trusted documents up to which they are sent to all executors instead of being joined by a shuffle.
BROADCAST_IDS = 2_000_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all tokens, and each text's first one (n + 1 values)."""
    starts, ends, _, _ = words(data, offsets, TABLE)
    space = data == 32
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    plain = space & ~begins[:-1]
    plain[1:] &= ~space[:-1]
    lone = ~TABLE[0][data] & ~plain
    begin = np.zeros(len(data) + 1, bool)
    begin[starts] = True
    begin[:-1] |= lone
    for s, e in zip(*(x[ends - starts > PIECE].tolist() for x in (starts, ends))):
        begin[s:e:PIECE] = True
    edge = begin.copy()
    edge[ends] = True
    edge[1:] |= lone
    starts, edges = np.flatnonzero(begin), np.flatnonzero(edge)
    return starts, edges[np.searchsorted(edges, starts) + 1], np.searchsorted(starts, offsets)


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte grams of tokens: every byte, and 0 for the end, with the two before it (0 before the first);
    and each token's first code."""
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    at = place + np.repeat(starts, sizes)
    padded = np.append(data, np.zeros(1, np.uint8)).astype(np.int32)
    code = np.where(at < np.repeat(ends, sizes), padded[at], 0)
    for back in (1, 2):
        code |= np.where(place >= back, padded[at - back], 0) << (8 * back)
    return code, first


def again(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which tokens are the same as the one before them in their text; ``first`` as of ``tokens``."""
    same = np.zeros(len(hashes) + 1, bool)
    np.equal(hashes[1:], hashes[:-1], out=same[1:-1])
    same[first] = False
    return same[:-1]


def count_words(trusted: DataFrame) -> DataFrame:
    """(word binary, n, r) over all texts of ``trusted``: occurrences, and those right behind the same word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in blocks(offsets, BLOCK_BYTES):
                part = data[offsets[i] : offsets[j]]
                starts, ends, first = tokens(part, offsets[i : j + 1] - offsets[i])
                hashes = span_hashes(part, starts, ends)
                _, at, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                r = np.bincount(which[again(hashes, first)], minlength=len(at))
                sizes = (ends - starts)[at]
                firsts = np.cumsum(sizes) - sizes
                raw = part[np.arange(int(sizes.sum())) - np.repeat(firsts - starts[at], sizes)]
                bounds = np.append(firsts, sizes.sum()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]), pa.array(n), pa.array(r)], ["word", "n", "r"])

    found = trusted.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long, r long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))


def pairs_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word before, word) of all pairs, the edges of texts that have tokens being the word of hash 0."""
    sizes = np.diff(first)
    some = (sizes > 0).astype(np.int64)
    after = np.insert(hashes, first[1:][sizes > 0], np.uint64(0))
    return np.repeat(np.arange(len(sizes)), sizes + some), np.append(np.zeros(1, np.uint64), after)[:-1], after


def pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By these 64 bits pairs are told apart."""
    return mix(after ^ mix(before + BASE))


def _packed(columns: dict[str, list], ints: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "shard" else pa.int64() if k in ints else pa.binary()) for k, v in columns.items()], list(columns))


def _joined(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).drop_null().to_pylist()), kind)


PAIRS = "shard int, heads binary, sizes binary, after binary, n binary"
COUNTS = ("k1", "k2", "k3", "k4")
FOLLOWERS = f"{PAIRS}, freed binary, contexts binary, context_n binary, context_freed binary, {', '.join(f'{k} long' for k in COUNTS)}"


def count_pairs(trusted: DataFrame, shards: int, part: int, parts: int) -> DataFrame:
    """PAIRS: all pairs of words, counted per block and dealt out by the first word; those of one part of the shards. ``heads`` are the
    first words, with the number of pairs of each in ``sizes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in blocks(offsets, BLOCK_BYTES):
                own = data[offsets[i] : offsets[j]]
                starts, ends, first = tokens(own, offsets[i : j + 1] - offsets[i])
                _, before, after = pairs_of(span_hashes(own, starts, ends), first)
                wanted = _shard_of(before, shards) % parts == part
                before, after = before[wanted], after[wanted]
                _, at, n = np.unique(pair_hashes(before, after), return_index=True, return_counts=True)
                before, after = before[at], after[at]
                of = _shard_of(before, shards)
                order = np.lexsort((before, of))
                out: dict[str, list] = {c.split()[0]: [] for c in PAIRS.split(", ")}
                for s, a, b in _dealt(of[order], shards):
                    at = order[a:b]
                    runs = np.flatnonzero(np.append(True, np.diff(before[at]) != 0))
                    for c, v in zip(out, (s, before[at][runs].tobytes(), np.diff(np.append(runs, b - a)).astype("<u4").tobytes(), after[at].tobytes(), n[at].astype("<u4").tobytes())):
                        out[c].append(v)
                yield _packed(out, ())

    found = trusted.select(F.col("text").cast("string")).mapInArrow(run, PAIRS)
    return found.groupBy("shard").applyInArrow(lambda table: _by_context(table, shards), FOLLOWERS)


def _by_context(table: pa.Table, shards: int) -> pa.Table:
    """FOLLOWERS: the pairs of a shard of first words, summed up and dealt out by the second word. ``freed`` has how many pairs of each head occur once,
    twice and more often; the same by word for the contexts of the shard that they are dealt to, with their occurrences; k1 to k4 how many pairs occur so often."""
    before = np.repeat(_joined(table, "heads", "<u8"), _joined(table, "sizes", "<u4"))
    after, n = _joined(table, "after", "<u8"), _joined(table, "n", "<u4")
    _, at, which = np.unique(pair_hashes(before, after), return_index=True, return_inverse=True)
    n = np.bincount(which, n, len(at)).astype(np.int64)
    order = np.argsort(before[at], kind="stable")
    before, after, n = before[at][order], after[at][order], n[order]
    begins = np.flatnonzero(np.append(True, np.diff(before) != 0))
    heads = before[begins]
    freed = np.stack([np.add.reduceat(x.astype(np.int64), begins) for x in (n == 1, n == 2, n > 2)], axis=1)
    total, head = np.add.reduceat(n, begins), np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(before))))
    of, of_heads = _shard_of(after, shards), _shard_of(heads, shards)
    order, own = np.argsort(of, kind="stable"), np.argsort(of_heads, kind="stable")
    lots, contexts = ({s: (a, b) for s, a, b in _dealt(x, shards)} for x in (of[order], of_heads[own]))
    out: dict[str, list] = {c.split()[0]: [] for c in FOLLOWERS.split(", ")}
    for i, s in enumerate(sorted({*lots, *contexts})):
        at, mine = order[slice(*lots.get(s, (0, 0)))], own[slice(*contexts.get(s, (0, 0)))]
        runs = np.flatnonzero(np.diff(head[at], prepend=-1))
        row = (s, heads[head[at][runs]].tobytes(), np.diff(np.append(runs, len(at))).astype("<u4").tobytes(), after[at].tobytes(), n[at].astype("<u4").tobytes(), freed[head[at][runs]].astype("<u4").tobytes())
        row += (heads[mine].tobytes(), total[mine].astype("<i8").tobytes(), freed[mine].astype("<u4").tobytes(), *(int((n == k).sum()) if i == 0 else 0 for k in (1, 2, 3, 4)))
        for c, v in zip(out, row):
            out[c].append(v)
    return pa.Table.from_batches([_packed(out, COUNTS)])


def _continuations(table: pa.Table) -> pa.Table:
    """How many words of a shard follow 1 to 4 different words, how many do at all, and their pairs."""
    _, n = np.unique(_joined(table, "after", "<u8"), return_counts=True)
    return pa.table({**{k: [int((n == i + 1).sum())] for i, k in enumerate(COUNTS)}, "size": [len(n)], "pairs": [int(n.sum())]})


def count_spellings(vocabulary: DataFrame) -> DataFrame:
    """(gram int, n) of the byte grams of all distinct words; 2**24 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            gram, n = np.unique(spelling(data, offsets[:-1], offsets[1:])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int32)), pa.array(n)], ["gram", "n"])

    return vocabulary.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from how many grams have counts of 1 to 4."""
    if not n1 or not n2:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)])


class Spelling:
    """Log probabilities of byte grams: ``lower`` of (context, byte) pairs backed off to, a gain for each seen gram."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        grams, counts = grams[order].astype(np.int64), counts[order].astype(np.float64)
        # In how many contexts a pair occurs, and then a byte.
        pairs = np.bincount(grams & 0xFFFF, minlength=1 << 16).astype(np.float64)
        singles = np.bincount(np.flatnonzero(pairs) & 0xFF, minlength=256).astype(np.float64)
        below, _, _ = self._smoothed(singles, np.zeros(256, np.int64), np.full(256, 1 / 256))
        below, _, _ = self._smoothed(pairs, np.arange(1 << 16) >> 8, np.tile(below, 256))
        p, share, context = self._smoothed(counts, grams >> 8, below[grams & 0xFFFF])
        weight = np.ones(1 << 16)
        weight[context] = share
        self.weight, self.lower = np.log(weight), np.log(below)
        self.grams, self.gains = grams, np.log(p) - np.log(weight[grams >> 8] * below[grams & 0xFFFF])

    @staticmethod
    def _smoothed(counts: np.ndarray, context: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(p of each gram, freed share and number of each seen context); contexts not seen leave all to ``below``."""
        d = discounts(*(int((counts == i).sum()) for i in (1, 2, 3, 4)))
        cut = np.where(counts > 0, d[np.clip(counts, 1, 3).astype(np.int64) - 1], 0.0)
        size = int(context.max(initial=0)) + 1
        total, freed = (np.bincount(context, x, size) for x in (counts, cut))
        share = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
        seen = np.flatnonzero(total)
        return (counts - cut) / np.maximum(total, 1)[context] + share[context] * below, share[seen], seen

    def log_p(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each token; ``first`` is where its codes begin."""
        if not len(first):
            return np.zeros(0)
        at = np.searchsorted(self.grams, codes)
        at[at == len(self.grams)] = 0
        gain = np.where(self.grams[at] == codes, self.gains[at], 0.0) if len(self.grams) else 0.0
        return np.add.reduceat(self.weight[codes >> 8] + self.lower[codes & 0xFFFF] + gain, first)


@dataclass
class Model:
    """Word table with its number of rows, log share of freed mass, number of words counted, discounts, and spellings;
    the share of words that follow themselves, and the discounts of their repetitions."""

    vocabulary: DataFrame
    size: int
    freed: float
    total: int
    discounts: np.ndarray
    spelling: Spelling
    rate: float
    repeat_discounts: np.ndarray
    order: int = 1
    #: Of order 2: the word table with the pairs' gains, packed, and its number of shards.
    table: DataFrame | None = None
    shards: int = 0


def fit(trusted: DataFrame, order: int = 1) -> Model:
    """The smoothed model of all texts in ``trusted``, of words (order 1) or of words behind words (2); without text, every word is as likely as its spelling."""
    vocabulary = materialize(count_words(trusted), "words")
    row = vocabulary.agg(
        F.count("*").alias("size"), F.sum("n").alias("total"), F.count_if(F.col("r") > 0).alias("repeated"),
        *[F.count_if(F.col(c) == i).alias(f"{c}{i}") for c in ("n", "r") for i in (1, 2, 3, 4)],
    ).first()
    d, again_d = (discounts(*(row[f"{c}{i}"] for i in (1, 2, 3, 4))) for c in ("n", "r"))
    total = row["total"] or 0
    freed = row["n1"] * d[0] + row["n2"] * d[1] + (row["size"] - row["n1"] - row["n2"]) * d[2]
    grams = count_spellings(vocabulary).toArrow()  # 2**24 rows at most
    spelled = Spelling(grams.column("gram").to_numpy(), grams.column("n").to_numpy())
    model = Model(vocabulary, row["size"], float(np.log(freed / total)) if total else 0.0, total, d, spelled, (row["repeated"] + 1) / (row["size"] + 2), again_d)
    return model if order == 1 or not total else _with_pairs(trusted, model)


def _with_pairs(trusted: DataFrame, words_: Model) -> Model:
    """The model of order 2 from that of order 1, of which it has words, spellings and repetitions."""
    scratch = Scratch(trusted.sparkSession)
    lots = max(1, -(-words_.total // PAIR_TOKENS))
    followers = _in_parts(lambda part: scratch.keep(count_pairs(trusted, lots, part, PARTS), "followers", "zstd"), min(lots, PARTS))
    times = followers.agg(*[F.sum(k).alias(k) for k in COUNTS]).first()
    met = followers.select("shard", "after").groupBy("shard").applyInArrow(_continuations, ", ".join(f"{k} long" for k in (*COUNTS, "size", "pairs")))
    row = materialize(met, "continuations").agg(*[F.sum(c).alias(c) for c in (*COUNTS, "size", "pairs")]).first()
    pair_d, d = (discounts(*(r[k] for k in COUNTS)) for r in (times, row))
    freed = row["k1"] * d[0] + row["k2"] * d[1] + (row["size"] - row["k1"] - row["k2"]) * d[2]
    model = replace(words_, freed=float(np.log(freed / row["pairs"])), total=row["pairs"], discounts=d, order=2, shards=max(1, -(-(row["size"] + row["pairs"]) // SHARD_PAIRS)))
    dealt = _word_lots(words_.vocabulary, lots)

    def part_of(part: int) -> DataFrame:
        left, right = (x.where(F.col("shard") % PARTS == part) for x in (followers, dealt))
        rows = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(lambda key, x, y: _gains(key[0].as_py(), x, y, model_, pair_d), "shard int, keys binary, gains binary, repeats binary")
        return materialize(rows, "model")

    model_ = replace(model, vocabulary=None)  # what tasks read
    table = _in_parts(part_of, min(lots, PARTS))
    scratch.clear()
    return replace(model, table=table)


def _in_parts(make: Callable[[int], DataFrame], parts: int) -> DataFrame:
    return reduce(DataFrame.union, [make(i) for i in range(parts)])


def _word_lots(vocabulary: DataFrame, shards: int) -> DataFrame:
    """(shard, text, sizes, n, r): words of the vocabulary, packed by the shard of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            n, r = (batch.column(i).to_numpy() for i in (1, 2))
            of = _shard_of(span_hashes(data, offsets[:-1], offsets[1:]), shards)
            out: dict[str, list] = {c: [] for c in ("shard", "text", "sizes", "n", "r")}
            order = np.argsort(of, kind="stable")
            for s, a, b in _dealt(of[order], shards):
                at = order[a:b]
                sizes = np.diff(offsets)[at]
                place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - offsets[at], sizes)
                for c, v in zip(out, (s, data[place].tobytes(), sizes.astype("<u4").tobytes(), n[at].astype("<i8").tobytes(), r[at].astype("<i8").tobytes())):
                    out[c].append(v)
            yield _packed(out, ())

    return vocabulary.select("word", "n", "r").mapInArrow(run, "shard int, text binary, sizes binary, n binary, r binary")


def _gains(shard: int, pairs: pa.Table, lots: pa.Table, model: Model, pair_cuts: np.ndarray) -> pa.Table:
    """Rows of the word table, for the words of one shard and the pairs that end in them."""
    edge = [0] if shard == 0 else []  # the empty word
    data, sizes = _joined(lots, "text", np.uint8), np.append(_joined(lots, "sizes", "<u4").astype(np.int64), edge).astype(np.int64)
    n, r = (np.append(_joined(lots, c, "<i8"), [x for _ in edge]).astype(np.float64) for c, x in (("n", 1), ("r", 0)))
    ends = np.cumsum(sizes)
    hashes = span_hashes(data, ends - sizes, ends)
    order = np.argsort(hashes)
    known = hashes[order]
    after, counts = _joined(pairs, "after", "<u8"), _joined(pairs, "n", "<u4").astype(np.int64)
    at = order[np.searchsorted(known, after)]
    met = np.bincount(at, minlength=len(known)).astype(np.float64)
    below = model.freed + model.spelling.log_p(*spelling(data, ends - sizes, ends))
    word = np.log((met - model.discounts[np.clip(met, 1, 3).astype(np.int64) - 1]) / model.total + np.exp(below))
    cut = np.append(0.0, model.repeat_discounts)
    less, rest = (cut[np.minimum(x, 3).astype(np.int64)] for x in (r, n - r))
    repeats = np.where(sizes == 0, model.rate, (r - less) / n + (less + rest) / n * model.rate)
    lone, more = both_log_p(word, repeats), both_log_p(below, model.rate)
    share = np.zeros(len(known))
    contexts, total = _joined(pairs, "contexts", "<u8"), _joined(pairs, "context_n", "<i8")
    share[order[np.searchsorted(known, contexts)]] = np.log((_joined(pairs, "context_freed", "<u4").reshape(-1, 3) @ pair_cuts) / total)
    runs = _joined(pairs, "sizes", "<u4")
    before, freed = np.repeat(_joined(pairs, "heads", "<u8"), runs), np.repeat(_joined(pairs, "freed", "<u4").reshape(-1, 3) @ pair_cuts, runs)
    pair = np.log1p((counts - pair_cuts[np.minimum(counts, 3) - 1]) / (freed * np.exp(word[at])))
    keys, gains = np.append(hashes, pair_hashes(before, after)), whole(np.append(lone[0] - more[0] + share, pair))
    again_gains = np.append(whole(lone[1] - more[1]), np.zeros(len(pair), np.int64))
    of = _shard_of(keys, model.shards)
    order = np.argsort(of, kind="stable")
    out: dict[str, list] = {c: [] for c in ("shard", "keys", "gains", "repeats")}
    for s, a, b in _dealt(of[order], model.shards):
        for c, v in zip(out, (s, _pack(keys[order[a:b]]), *(x[order[a:b]].astype("<i4").tobytes() for x in (gains, again_gains)))):
            out[c].append(v)
    return pa.Table.from_batches([_packed(out, ())])


def both_log_p(word: np.ndarray, repeats: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(log p of a word that isn't said again behind itself, what it adds where it is), from log p(word) and p(again | word)."""
    other = np.log1p(-repeats)
    return word + other, np.zeros_like(word) + np.log(repeats) - other


def whole(x: np.ndarray) -> np.ndarray:
    return np.round(x * UNIT).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(8 * KEY_BYTES)) % np.uint64(shards)).astype(np.int64)


def _dealt(of: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the runs of a sorted array of shard numbers."""
    ends = np.searchsorted(of, np.arange(shards + 1))
    return [(s, int(ends[s]), int(ends[s + 1])) for s in np.flatnonzero(np.diff(ends)).tolist()]


def _model_shards(model: Model, shards: int) -> DataFrame:
    """(shard, keys, gains, repeats): the word table, packed."""
    if model.table is not None:
        return model.table
    spelled, freed, total, cut = model.spelling, model.freed, model.total, model.discounts
    rate, again_cut = model.rate, np.append(0.0, model.repeat_discounts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column(0))
            n, r = (batch.column(i).to_numpy().astype(np.float64) for i in (1, 2))
            below = freed + spelled.log_p(*spelling(data, offsets[:-1], offsets[1:]))
            word = np.log((n - cut[np.clip(n, 1, 3).astype(np.int64) - 1]) / total + np.exp(below))
            less, rest = (again_cut[np.minimum(x, 3).astype(np.int64)] for x in (r, n - r))
            known, unknown = both_log_p(word, (r - less) / n + (less + rest) / n * rate), both_log_p(below, rate)
            gains, repeats = whole(known[0] - unknown[0]), whole(known[1] - unknown[1])
            hashes = span_hashes(data, offsets[:-1], offsets[1:])
            of = _shard_of(hashes, shards)
            order = np.argsort(of, kind="stable")
            rows = [(s, _pack(hashes[order[a:b]]), *(x[order[a:b]].astype("<i4").tobytes() for x in (gains, repeats))) for s, a, b in _dealt(of[order], shards)]
            kinds = [pa.int32(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)], ["shard", "keys", "gains", "repeats"])

    return model.vocabulary.select("word", "n", "r").mapInArrow(run, "shard int, keys binary, gains binary, repeats binary")


REQUEST = "shard int, part int, block long, docs binary, sizes binary, keys binary, n binary, again_at binary, again_n binary, ids binary, base binary, tokens binary"


def _requests(spelled: Spelling, freed: float, rate: float, shards: int, parts: int, order_: int):
    """Documents' words (and their pairs and edge, at order 2), counted per document and dealt to shards; a block's row for shard 0 also has each document's
    id, the sum that does not hang on the word table, and its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        edge = whole(freed + spelled.log_p(np.zeros(1, np.int32), np.zeros(1, np.int64)))[0]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                part, m = data[offsets[i] : offsets[j]], j - i
                starts, ends, first = tokens(part, offsets[i : j + 1] - offsets[i])
                hashes = span_hashes(part, starts, ends)
                same = again(hashes, first)
                known, at, which = np.unique(hashes, return_index=True, return_inverse=True)
                lone, more = both_log_p(freed + spelled.log_p(*spelling(part, starts[at], ends[at])), rate)
                doc = np.repeat(np.arange(m), np.diff(first))
                summed = np.append(0, np.cumsum(whole(lone)[which] + np.where(same, whole(more)[which], 0)))
                base = summed[first[1:]] - summed[first[:-1]]
                # One entry for each word of a document, by shard and then by document.
                pairs, entry, n = np.unique(doc * np.int64(len(known)) + which, return_inverse=True, return_counts=True)
                repeated = np.bincount(entry[same], minlength=len(pairs))
                doc, keys = pairs // max(1, len(known)), known[pairs % max(1, len(known))]
                if order_ == 2:
                    some = np.flatnonzero(np.diff(first))
                    base[some] += edge
                    at, *both = pairs_of(hashes, first)
                    two, which = np.unique(pair_hashes(*both), return_inverse=True)
                    pairs, more_n = np.unique(at * np.int64(len(two)) + which, return_counts=True)
                    doc, keys = np.concatenate([doc, some, pairs // max(1, len(two))]), np.concatenate([keys, np.zeros(len(some), np.uint64), two[pairs % max(1, len(two))]])
                    n, repeated = np.concatenate([n, np.ones(len(some), np.int64), more_n]), np.append(repeated, np.zeros(len(some) + len(more_n), np.int64))
                of = _shard_of(keys, shards)
                order = np.lexsort((doc, of))
                doc, keys, n, repeated, of = doc[order], keys[order], n[order], repeated[order], of[order]
                rows = {s: (a, b) for s, a, b in _dealt(of, shards)}
                columns: list[list] = [[] for _ in range(12)]
                for s in sorted({0, *rows}):
                    a, b = rows.get(s, (0, 0))
                    own = doc[a:b]
                    runs = np.flatnonzero(np.diff(own, prepend=-1))
                    place = np.flatnonzero(repeated[a:b])
                    row = (s, (block * 0x9E3779B1 >> 7) % parts, block, own[runs].astype("<u4").tobytes(), np.diff(np.append(runs, b - a)).astype("<u4").tobytes(), _pack(keys[a:b]), n[a:b].astype("<u4").tobytes())
                    row += (place.astype("<u4").tobytes(), repeated[a:b][place].astype("<u4").tobytes())
                    row += (ids[i:j].astype("<i8").tobytes(), base.tobytes(), np.diff(first).astype("<i8").tobytes()) if s == 0 else (None, None, None)
                    for column, x in zip(columns, row):
                        column.append(x)
                kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 9]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in REQUEST.split(", ")])
                block += 1

    return run


def _answer(requests: pa.Table, model: pa.Table) -> pa.Table:
    """The gains of the documents' words that one shard knows, summed by document: one row for each block."""
    keys, gains, repeats = (b"".join(model.column(c).to_pylist()) for c in ("keys", "gains", "repeats"))
    known, gains, repeats = _unpack(keys), *(np.frombuffer(x, "<i4").astype(np.int64) for x in (gains, repeats))
    order = np.argsort(known)
    known, gains, repeats = known[order], gains[order], repeats[order]
    totals = []
    for keys, *counts in zip(*(requests.column(c) for c in ("keys", "n", "sizes", "again_at", "again_n"))):
        keys, (n, sizes, again_at, again_n) = _unpack(keys.as_py()), (np.frombuffer(x.as_py(), "<u4") for x in counts)
        if not len(keys):
            totals.append(b"")
            continue
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        value = np.zeros(len(keys), np.int64)
        if len(known):
            found = known[at] == keys
            value = np.where(found, gains[at], 0) * n
            value[again_at] += np.where(found, repeats[at], 0)[again_at] * again_n
        totals.append(np.add.reduceat(value, np.cumsum(sizes, dtype=np.int64) - sizes).astype("<i8").tobytes())
    return pa.table({"block": requests.column("block"), "docs": requests.column("docs"), "totals": pa.array(totals, pa.binary()), **{c: requests.column(c) for c in ("ids", "base", "tokens")}})


def _merge(answers: pa.Table) -> pa.Table:
    """Whole sums of a block's documents."""
    read = lambda x, kind: np.frombuffer(x.as_py(), kind)
    lead = next(i for i, x in enumerate(answers.column("ids")) if x.is_valid)
    ids, total, n = (read(answers.column(c)[lead], "<i8") for c in ("ids", "base", "tokens"))
    total = total.copy()
    for docs, more in zip(answers.column("docs"), answers.column("totals")):
        total[read(docs, "<u4")] += read(more, "<i8")
    return pa.table({"row": ids, "total": total, "n": n})


def log_perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """(row, x, n): the log perplexity by token of every text with a token, and its tokens, ``row`` being its ``row_key``."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = model.shards or max(1, -(-model.size // SHARD_WORDS))
    slices = 1 if model.order == 1 else PARTS
    # A text of so many bytes has about 0.65 times as many of distinct words' keys and counts, or 2.2 with pairs. Shards of words and pairs are
    # larger, and copying them for a second part of the texts costs disk, so such a group may be larger too.
    parts = max(1, -(-int((0.65, 2.2)[model.order - 1] * size) // (slices * shards * GROUP_BYTES * model.order)))
    texts = docs.select(row_key().alias("row"), F.col("text").cast("string").alias("text"))
    table = _model_shards(model, shards).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def answered(texts: DataFrame) -> DataFrame:
        grams = texts.mapInArrow(_requests(model.spelling, model.freed, model.rate, shards, parts, model.order), REQUEST)
        answers = grams.groupBy("shard", "part").cogroup(table.groupBy("shard", "part")).applyInArrow(
            lambda key, left, right: _answer(left, right), "block long, docs binary, totals binary, ids binary, base binary, tokens binary"
        )
        sums = answers.where("block is not null").groupBy("block").applyInArrow(_merge, "row long, total long, n long").where("n > 0")
        # Copies of a row have the same sums. At order 2 the end of a text is one more token.
        return sums.groupBy("row").agg((-F.max("total") / F.lit(float(UNIT)) / (F.max("n") + (model.order - 1))).alias("x"), F.max("n").alias("n"))

    if slices == 1:
        return answered(texts)
    return _in_parts(lambda i: materialize(answered(texts.where(F.pmod("row", F.lit(slices)) == i)), "perplexities"), slices)


def row_key() -> Column:
    """What a document's score hangs on, hashed: repeated rows share it, and are scored alike."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))


def held_out() -> Column:
    """Whether a trusted document is held out of the fit: by its text, so that copies are on one side."""
    return F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")) % HELD == 0


class Limit(NamedTuple):
    """Mean log perplexity, its variance a + b / n in texts of n tokens, and the least and greatest deviation kept."""

    mean: float
    a: float
    b: float
    low: float
    high: float


def _spread(n: int, moments: dict[str, int]) -> tuple[float, float, float]:
    """(mean, a, b) from sums over ``n`` texts, all in whole numbers: the variance's least squares, weighted by tokens."""
    x, xx, size, nx, nxx, inverse = (float(moments[m]) for m in ("x", "xx", "n", "nx", "nxx", "inverse"))
    x, nx, xx, nxx, inverse = x / SCALE, nx / SCALE, xx / SCALE**2, nxx / SCALE**2, inverse / SCALE
    mean = x / n
    plain, heavy = max(0.0, xx - n * mean**2), max(0.0, nxx - 2 * mean * nx + mean**2 * size)
    det = size * inverse - n * n
    if det <= 1e-6 * n * n:  # all of one size
        return mean, plain / n, 0.0
    a, b = (heavy * inverse - plain * n) / det, (size * plain - n * heavy) / det
    return (mean, 0.0, heavy / n) if a < 0 else (mean, plain / n, 0.0) if b < 0 else (mean, a, b)


def spreads(trusted: DataFrame) -> dict[str, tuple[float, float, float]]:
    """(mean, a, b) of the log perplexity of ``trusted`` (lang, x, n) by language, and over all under "". Sums are of whole
    numbers, so they don't depend on their order."""
    x, n = (F.col(c).cast("decimal(12,0)") for c in ("_x", "n"))
    sums = trusted.withColumn("_x", F.round(F.col("x") * SCALE)).groupBy("lang").agg(
        F.count("*").alias("count"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.sum(n).alias("n"), F.sum(n * x).alias("nx"),
        F.sum((n * (x * x)).cast("decimal(38,0)")).alias("nxx"), F.sum(F.round(SCALE / F.col("n")).cast("decimal(12,0)")).alias("inverse"),
    )
    rows = [r.asDict() for r in sums.collect()]  # one row a language
    if not rows:
        return {}
    whole_sums = {k: sum(int(r[k]) for r in rows) for k in rows[0] if k != "lang"}
    return {"": _spread(whole_sums["count"], whole_sums)} | {r["lang"]: _spread(r["count"], r) for r in rows if r["lang"]}


def _of_language(values: dict[str, float]) -> Column:
    """The value of ``lang``, or that over all languages."""
    own = F.create_map(*[F.lit(v) for lang, value in values.items() for v in (lang, float(value))])
    return F.coalesce(F.try_element_at(own, F.coalesce("lang", F.lit(""))), F.lit(float(values[""])))


def _deviation_unit(a: dict[str, float], b: dict[str, float]) -> Column:
    return F.greatest(F.sqrt(_of_language(a) + _of_language(b) / F.col("n")), F.lit(0.001))


def _quantiles(rows: DataFrame, share: float) -> dict[str, float]:
    """The bin of 1/BINS up to which that share of ``v`` lies, by ``lang``."""
    counts = rows.groupBy("lang", F.floor(F.col("v") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    each = Window.partitionBy("lang")
    sums = counts.select("lang", "bin", F.sum("n").over(each.orderBy("bin")).alias("upto"), F.sum("n").over(each).alias("n"))
    found = sums.where(F.col("upto") >= F.col("n") * share).groupBy("lang").agg(F.min("bin").alias("bin"), F.max("n").alias("n")).where(f"lang = '' or n >= {LEAST}")
    return {r["lang"]: r["bin"] / BINS for r in found.collect()}  # one row a language


def limits(trusted: DataFrame) -> dict[str, Limit]:
    """What is kept, by language, and under "" over all languages. ``trusted`` has lang, x, n and ``held``."""
    rows = trusted.where("x is not null")
    spread = spreads(rows)
    if not spread:
        return {"": Limit(0.0, 1.0, 0.0, float("-inf"), float("inf"))}
    mean, a, b = ({lang: v[i] for lang, v in spread.items()} for i in range(3))
    each = rows.withColumn("lang", F.explode(F.array_distinct(F.array(F.coalesce("lang", F.lit("")), F.lit("")))))
    each = each.select("lang", "held", ((F.col("x") - _of_language(mean)) / _deviation_unit(a, b)).alias("v"))
    low, high = _quantiles(each, LOW), _quantiles(each.where("held"), HIGH) or _quantiles(each, 1.0)
    return {lang: Limit(*spread[lang], low[lang], high[lang] + 1 / BINS) for lang in high if lang in low}


def judged(scores: DataFrame, kept: dict[str, Limit]) -> DataFrame:
    """(.., n_tokens, perplexity, low, high, accepted) from (.., lang, x, n), the limits being those of texts of that size;
    texts without perplexity are accepted."""
    mean, a, b, low, high = ({lang: limit[i] for lang, limit in kept.items()} for i in range(5))
    low, high = (_of_language(mean) + _of_language(v) * _deviation_unit(a, b) for v in (low, high))
    accepted = F.col("x").isNull() | ((F.col("x") >= low) & (F.col("x") <= high))
    cut = lambda x: F.exp(F.least(x, F.lit(700.0)))
    return scores.select(*[c for c in scores.columns if c not in ("x", "n")], F.col("n").alias("n_tokens"), cut(F.col("x")).alias("perplexity"), cut(low).alias("low"), cut(high).alias("high"), accepted.alias("accepted"))


def good_ids(labels: DataFrame) -> DataFrame:
    """(_good): ids labelled as of good quality."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()


def trusted_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents labelled as of good quality. Up to BROADCAST_IDS ids are sent to all executors, so that
    texts aren't shuffled; more are joined by a shuffle."""
    good = good_ids(labels)
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(good) if few else good, docs["doc_id"] == F.col("_good"), "left_semi")


def scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, Limit]]:
    """((row, x, n) of all documents, limits) by the model of the trusted texts that aren't held out."""
    model = fit(trusted_docs(docs, labels).where(~held_out()), ORDER)
    found = materialize(log_perplexities(docs, model), "perplexities")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), row_key().alias("row"), held_out().alias("held"))
    return found, limits(rows.join(good_ids(labels), F.col("doc_id") == F.col("_good"), "left_semi").join(found, "row"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, low, high, accepted) of every document; ``labels`` has doc_id and quality.

    Null or empty text has no perplexity and is accepted: there is nothing to judge. A null language, or one with under LEAST held-out
    trusted documents, is judged by the limits over all languages. Without trusted text everything is accepted. Repeated rows are judged each.
    """
    found, kept = scored(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), row_key().alias("row"))
    return judged(rows.join(found, "row", "left").select("doc_id", "lang", "x", "n"), kept)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that are accepted."""
    found, kept = scored(docs, labels)
    keyed = docs.withColumn("_row", row_key())
    langs = keyed.select(F.col("_row").alias("row"), F.col("lang").cast("string").alias("lang")).distinct()
    bad = judged(langs.join(found, "row"), kept).where("not accepted")
    return keyed.join(bad.select(F.col("row").alias("_row")), "_row", "left_anti").select(*docs.columns)
