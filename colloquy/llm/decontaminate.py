"""Benchmark decontamination by suffix arrays over the training text.

A task's Arrow batch of documents is a shard. Its words become ranks in the benchmark's vocabulary; the
suffixes that begin with the first one to three words of some benchmark window are sorted by their first
``window`` words into a suffix array, and the benchmark's windows, each distinct one once, are binary-searched
in it: the equal range has every place where that window occurs. Suffixes that begin otherwise can't match.

Longest matches come from a second suffix array over the places found and the benchmark's windows that were
found, sorted whole by prefix doubling: the longest match from a place on is one with the nearest benchmark
suffix above or below it. So neither step spells out pairs, however often a passage repeats on either side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.arrays import blocks, text_bytes, word_table, words
from colloquy.llm.scratch import materialize

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered.
TABLE = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WINDOW = 10
#: Benchmark text of a block, which the tasks hold at a time, and bytes of a shard.
BLOCK_ITEM_BYTES, SHARD_BYTES = 8 << 20, 1 << 20


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of every pair, back to back."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def packed(ranks: np.ndarray, at: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` ranks of each suffix, 0 beyond its end, as bytes whose order is theirs."""
    columns = np.zeros((len(at), width), ">u4")
    for d in range(width):
        if len(at):
            columns[:, d] = np.where(at + d < ends, ranks[np.minimum(at + d, len(ranks) - 1)], 0)
    return columns.view(f"S{4 * width}").ravel()


@dataclass
class Found:
    """What one block of items has in a shard: occurrences as (first word, words), distinct (row, item) pairs, and for
    rows with any the longest match: words, its first word, its item and the place in it."""

    at: np.ndarray
    size: np.ndarray
    rows: np.ndarray
    items: np.ndarray
    longest: dict[int, tuple[int, int, int, int]]


class TestSuffixes:
    """A block of benchmark items, ready to be searched for."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        _, _, hashes, first = words(data, offsets, TABLE)
        self.ids, self.window = ids, window
        self.vocabulary = np.unique(hashes)
        ranks = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int64)
        sizes = np.diff(first)
        #: Windows of whole length: first word, item and number of the distinct window. An item's follow each other.
        many = np.where(sizes >= window, sizes - window + 1, 0)
        start = spread(first[:-1], many)
        self.item = np.repeat(np.arange(len(sizes)), many)
        self.place = start - first[self.item]
        self.keys, self.key = np.unique(packed(ranks, start, first[1:][self.item], window), return_inverse=True)
        #: By length: the distinct whole texts of shorter items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        pairs = [(self.key, self.item)]
        groups = len(self.keys)
        for size in range(1, window):
            own = np.flatnonzero(sizes == size)
            if len(own):
                keys, key = np.unique(packed(ranks, first[own], first[own + 1], size), return_inverse=True)
                self.short[size] = keys, groups + np.arange(len(keys))
                pairs.append((key + groups, own))
                groups += len(keys)
        self._name_sets(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), groups)
        self.seed = min(3, *self.short, window)
        begins = np.concatenate([start, first[:-1][(sizes > 0) & (sizes < window)]])
        self.known = np.unique(self._seeds(ranks, begins))

    def _name_sets(self, group: np.ndarray, item: np.ndarray, groups: int) -> None:
        """Numbers the distinct sets of items that share windows: a passage's windows mostly have one and the same set."""
        both = np.unique(group * np.int64(len(self.ids) + 1) + item)
        group, item = both // (len(self.ids) + 1), both % (len(self.ids) + 1)
        mark = np.zeros(groups, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(mark, group, (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (item.astype(np.uint64) << np.uint64(7)))
        _, some, self.set_of = np.unique(mark, return_index=True, return_inverse=True)
        first = np.searchsorted(group, np.arange(groups + 1))
        sizes = np.diff(first)[some]
        self.set_ends = np.append(0, np.cumsum(sizes))
        self.set_items = item[spread(first[some], sizes)]

    def _seeds(self, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks fit 63 bits three at a time up to two million words, which a block never holds."""
        code = np.zeros(len(at), np.int64)
        for d in range(self.seed):
            code = code * (len(self.vocabulary) + 1) + ranks[at + d]
        return code

    def search(self, hashes: np.ndarray, row_of: np.ndarray, row_end: np.ndarray) -> Found | None:
        if not len(self.known) or not len(hashes):
            return None
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        ranks = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        picked = np.flatnonzero(ranks)
        picked = picked[picked + self.seed <= row_end[row_of[picked]]]
        codes = self._seeds(ranks, picked)
        place = np.searchsorted(self.known, codes)
        place[place == len(self.known)] = 0
        picked = picked[self.known[place] == codes]
        if not len(picked):
            return None
        keys = packed(ranks, picked, row_end[row_of[picked]], self.window)
        order = np.argsort(keys, kind="stable")
        suffixes, keys = picked[order], keys[order]
        lo = np.searchsorted(keys, self.keys, "left")
        n = np.searchsorted(keys, self.keys, "right") - lo
        where, key = suffixes[spread(lo, n)], np.repeat(np.arange(len(n)), n)
        ats, sizes, groups = [where], [np.full(len(where), self.window)], [key]
        for size, (own, number) in self.short.items():
            cut = np.ascontiguousarray(keys.view(np.uint8).reshape(len(keys), -1)[:, : 4 * size]).view(f"S{4 * size}").ravel()
            lo = np.searchsorted(cut, own, "left")
            n = np.searchsorted(cut, own, "right") - lo
            ats.append(suffixes[spread(lo, n)])
            sizes.append(np.full(len(ats[-1]), size))
            groups.append(np.repeat(number, n))
        at, size, group = (np.concatenate(x) for x in (ats, sizes, groups))
        if not len(at):
            return None
        pairs = np.unique(row_of[at] * np.int64(len(self.set_ends)) + self.set_of[group])
        rows, sets = pairs // len(self.set_ends), pairs % len(self.set_ends)
        members = np.diff(self.set_ends)[sets]
        pairs = np.unique(np.repeat(rows, members) * np.int64(len(self.ids)) + self.set_items[spread(self.set_ends[sets], members)])
        longest: dict[int, tuple[int, int, int, int]] = {}
        short = np.flatnonzero(size < self.window)
        short = short[np.lexsort((-at[short], size[short]))]
        for p, k, g in zip(at[short].tolist(), size[short].tolist(), group[short].tolist()):
            longest[int(row_of[p])] = (k, p, int(self.set_items[self.set_ends[self.set_of[g]]]), 0)
        longest |= self._longest(where, key, row_of)
        return Found(at, size, pairs // len(self.ids), pairs % len(self.ids), longest)

    def _longest(self, where: np.ndarray, key: np.ndarray, row_of: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """The longest match of each row, from the places of whole windows: in a run of n places one word apart, n + window - 1
        words agree with a benchmark text that has the same n windows in a row."""
        if not len(where):
            return {}
        order = np.argsort(where)
        where, key = where[order], key[order]
        tests = np.flatnonzero(np.isin(self.key, key))
        n, m = len(where), len(tests)
        symbol = np.concatenate([key, self.key[tests]]) + 1
        joined = np.zeros(n + m, bool)
        joined[1:n] = (np.diff(where) == 1) & (row_of[where[1:]] == row_of[where[:-1]])
        joined[n + 1 :] = (np.diff(tests) == 1) & (self.item[tests[1:]] == self.item[tests[:-1]])
        begins = np.append(np.flatnonzero(~joined), n + m)
        end = np.repeat(begins[1:], np.diff(begins))
        reach = int((end[n:] - np.arange(n, n + m)).max())
        # levels[k] ranks suffixes by their first 2**k windows; a run's end counts as 0.
        levels = [np.unique(symbol, return_inverse=True)[1] + 1]
        while 1 << (len(levels) - 1) < reach:
            step, rank = 1 << (len(levels) - 1), levels[-1]
            after = np.arange(n + m) + step
            second = np.where(after < end, rank[np.minimum(after, n + m - 1)], 0)
            levels.append(np.unique(rank * np.int64(n + m + 1) + second, return_inverse=True)[1] + 1)
        order = np.argsort(levels[-1], kind="stable")
        test = order >= n
        slots = np.arange(n + m)
        above = np.maximum.accumulate(np.where(test, slots, -1))
        below = np.minimum.accumulate(np.where(test, slots, n + m)[::-1])[::-1]
        best, partner = np.zeros(n, np.int64), np.zeros(n, np.int64)
        mine = order[~test]
        for near in (above[~test], below[~test]):
            ok = (near >= 0) & (near < n + m)
            i, j = mine[ok], order[near[ok]]
            size = np.zeros(len(i), np.int64)
            for k in range(len(levels) - 1, -1, -1):
                left = np.minimum(end[i], n + m) - i - size
                live = (left > 0) & (end[j] - j - size > 0)
                a, b = np.minimum(i + size, n + m - 1), np.minimum(j + size, n + m - 1)
                same = live & (levels[k][a] == levels[k][b])
                size += np.where(same, np.minimum(1 << k, left), 0)
            more = size > best[i]
            best[i[more]], partner[i[more]] = size[more], tests[j[more] - n]
        rows = row_of[where]
        order = np.lexsort((where, -best, rows))
        lead = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
        return {int(rows[i]): (int(best[i]) + self.window - 1, int(where[i]), int(self.item[partner[i]]), int(self.place[partner[i]])) for i in lead}


def item_blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[TestSuffixes]:
    """All items, in blocks of bounded size, one at least."""
    ids, texts, size, some = [], [], 0, False
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        ids.append(r[0] or "")
        texts.append(r[1])
        size += len(r[1] or "")
        if size >= BLOCK_ITEM_BYTES:
            yield TestSuffixes(ids, texts, window)
            ids, texts, size, some = [], [], 0, True
    if ids or not some:
        yield TestSuffixes(ids, texts, window)


#: What is known of a document after some blocks: its number of words, a bit for each word that is hit, items, longest match.
STATE = T.StructType(
    [
        T.StructField("_n_words", T.LongType()), T.StructField("_hit", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType())),
        T.StructField("_longest", T.LongType()), T.StructField("_longest_start", T.LongType()), T.StructField("_longest_item", T.StringType()), T.StructField("_longest_item_start", T.LongType()),
    ]
)


def _pass(shared, text: int, first: bool):
    """Adds a block's matches to the state behind the columns of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            width = batch.num_columns - (0 if first else len(STATE))
            before = None if first else [c.to_pylist() for c in batch.columns[width + 1 :]]
            data, offsets = text_bytes(batch.column(text))
            states: list[tuple] = []
            for i, j in blocks(offsets, SHARD_BYTES):
                _, _, hashes, row_first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], TABLE)
                row_of = np.repeat(np.arange(j - i), np.diff(row_first))
                found = block.search(hashes, row_of, row_first[1:])
                cover = np.zeros(len(hashes) + 1, np.int64)
                items: dict[int, set] = {}
                if found:
                    np.add.at(cover, found.at, 1)
                    np.add.at(cover, found.at + found.size, -1)
                    for row, item in zip(found.rows.tolist(), found.items.tolist()):
                        items.setdefault(row, set()).add(block.ids[item])
                hit = np.cumsum(cover[:-1]) > 0
                for row in range(j - i):
                    a, b = row_first[row], row_first[row + 1]
                    bits = np.packbits(hit[a:b])
                    own, (size, at, item, place) = items.get(row, set()), (found and found.longest.get(row)) or (0, 0, None, None)
                    longest = (size, int(at - a), block.ids[item], place) if size else (0, None, None, None)
                    if before is not None:
                        was = [c[i + row] for c in before]
                        bits = bits | np.frombuffer(was[0], np.uint8)
                        own = own | set(was[1])
                        longest = min(longest, tuple(was[2:]), key=lambda x: (-x[0], x[1] or 0))
                    states.append((int(b - a), bits.tobytes(), sorted(own), *longest))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([s[c] for s in states], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], [*batch.schema.names[:width], *STATE.names])

    return run


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the columns of STATE behind their own. A benchmark of several blocks takes a pass over the
    documents for each; only one block is held by the tasks at a time."""
    context = docs.sparkSession.sparkContext
    rows, schema = docs, T.StructType([*docs.schema.fields, *STATE.fields])
    text = docs.columns.index("text")
    made = item_blocks(benchmark, window)
    block, first = next(made), True
    while block is not None:
        following = next(made, None)
        shared = context.broadcast(block)
        rows = rows.mapInArrow(_pass(shared, text, first), schema)
        if following is not None:
            rows = materialize(rows, "searched")
            shared.destroy()
        block, first = following, False
    return rows


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [int(np.bitwise_count(np.frombuffer(x.as_py(), np.uint8)).sum()) for x in batch.column(2)]
        items = batch.column(3).to_pylist()
        own = [pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items], pa.string()), pa.array([h > 0 for h in hits])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own, *batch.columns[4:]], [x.split()[0] for x in REPORT.split(", ")])


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_start long, longest_item string, longest_item_start long"


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: its words, how many lie in an occurrence of an item's window, the items, and
    the longest verbatim match in words with its first word in the document, its item and the first word in that; of
    equally long ones the first in the document.

    Null or empty texts have no words and are never hit; items without words have no window; an
    empty benchmark hits nothing; repeated rows are reported each; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return searched(rows, benchmark, window).drop("text").mapInArrow(_figures, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents (all columns) in which no window of the benchmark occurs."""
    return searched(docs, benchmark, window).where("size(_items) = 0").select(*docs.columns)
