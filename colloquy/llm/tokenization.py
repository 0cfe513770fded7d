"""Exact byte-level BPE by a public tokenizer file, fast on large texts.

The library's BPE model costs microseconds a word however often the word was seen. Here a text is
cut into the tokenizer's own pre-tokens by numpy, each distinct pre-token goes through the
library's model once a Python worker, and the ids are put together by lookups. Pre-tokens
are independent in byte-level BPE, so the ids are those of ``Tokenizer.encode`` on the whole text.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa

from colloquy.llm.arrays import BASE, INVERSE, blocks, mix, powers, text_bytes

#: Code points worked on at once, and distinct words kept by a worker before it starts anew.
BLOCK_BYTES = 512 << 10
KEPT_WORDS = 600_000

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: printable bytes are themselves, the
    rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return out


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """Writes ``values`` at ``at``, into a larger copy where they don't fit."""
    if at + len(values) > len(array):
        array = np.concatenate([array, np.zeros(max(len(array), at + len(values)), array.dtype)])
    array[at : at + len(values)] = values
    return array


class FastBpe:
    """Ids of many texts under one byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.to_alphabet = byte_alphabet()
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)

    def _learn_kinds(self, points: np.ndarray) -> None:
        """Asks the library's own pre-tokenizer which class each new code point is in."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in np.unique(points).tolist():
            c = chr(p)
            if 0xD800 <= p < 0xE000:
                self.kinds[p] = OTHER
            elif len(cut(f"a{c}a")) == 1:
                self.kinds[p] = LETTER
            elif len(cut(f"1{c}1")) == 1:
                self.kinds[p] = NUMBER
            elif len(cut(f"!{c}!")) == 1:
                self.kinds[p] = OTHER
            else:
                self.kinds[p] = SPACE

    def _starts(self, points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
        """Which code points begin a pre-token, under
        ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
        n = len(points)
        kind = self.kinds[points]
        if (kind == UNKNOWN).any():
            self._learn_kinds(points[kind == UNKNOWN])
            kind = self.kinds[points]
        first = np.zeros(n + 1, bool)
        first[row_starts] = True
        run = np.empty(n + 1, bool)
        run[0] = run[n] = True
        np.not_equal(kind[1:], kind[:-1], out=run[1:n])
        run |= first
        start = run[:n].copy()
        # White space before a run in the same row: its last character stands alone or, if it is
        # a blank, belongs to the run.
        after = np.flatnonzero(run[1:n] & ~first[1:n] & (kind[:-1] == SPACE)) + 1
        start[after - 1] = True
        start[after] = points[after - 1] != 32
        # Contractions: an apostrophe that begins a pre-token of its own, then s, t, m, d, re, ve or ll.
        quotes = np.flatnonzero(points == 39)
        if len(quotes):
            ends = run[np.minimum(quotes + 1, n)]
            quotes = quotes[start[quotes] & ends & (quotes + 1 < n)]
            quotes = quotes[~first[quotes + 1]]
            a = points[quotes + 1]
            b_at = np.minimum(quotes + 2, n - 1)
            b = np.where((quotes + 2 < n) & ~first[np.minimum(quotes + 2, n)], points[b_at], 0)
            one = np.isin(a, [115, 116, 109, 100])
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            for at, size in ((quotes[one], 2), (quotes[two], 3)):
                start[at + 1] = False
                beyond = at + size
                start[beyond[(beyond < n)]] |= True
        return start

    def _encode_word(self, word: str) -> list[int]:
        text = word.encode("utf-8", "replace").decode("latin-1").translate(self.to_alphabet)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _keep(self, keys: list[int], coded: list[list[int]]) -> None:
        """Adds new words and their ids to what this worker knows."""
        sizes = np.fromiter(map(len, coded), np.int32, len(coded))
        ids = np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(sizes.sum()))
        firsts = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.flat = _put(self.flat, self.used, ids)
        self.first = _put(self.first, len(self.known), firsts)
        self.count = _put(self.count, len(self.known), sizes)
        self.used += len(ids)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))

    def _block(self, text: str, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one string of several rows, and the number of ids before each row's start."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        n = len(points)
        at = np.flatnonzero(self._starts(points, row_starts[row_starts < n]))
        to = np.append(at[1:], n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=prefix[1:])
        keys = (prefix[to] - prefix[at]) * powers(INVERSE, n)[at]
        keys ^= (to - at).astype(np.uint64) << np.uint64(44)
        coded = pa.array(mix(keys)).dictionary_encode()
        index = coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > KEPT_WORDS:
            self.forget()
        known = self.known
        entry = np.fromiter((known.get(k, -1) for k in distinct), np.int64, len(distinct))
        new = np.flatnonzero(entry < 0)
        if len(new):
            example = np.empty(len(distinct), np.int64)
            example[index[::-1]] = np.arange(len(index) - 1, -1, -1)
            where = example[new]
            coded_words = [self._encode_word(text[a:b]) for a, b in zip(at[where].tolist(), to[where].tolist())]
            entry[new] = np.arange(len(known), len(known) + len(new))
            self._keep([distinct[d] for d in new.tolist()], coded_words)
        word = entry[index]
        sizes = self.count[word].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.first[word] - (ends - sizes), sizes)
        before = np.concatenate([[0], ends])[np.searchsorted(at, row_starts)]
        return self.flat[where], before

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows back to back (int32) and the n + 1 offsets; null counts as empty."""
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        all_ids, counts = [], np.zeros(n, np.int64)
        for i, j in blocks(offsets, BLOCK_BYTES):
            part = data[offsets[i] : offsets[j]]
            text = part.tobytes().decode("utf-8", "replace")
            if any(s in text for s in self.special):
                # Rare: texts that hold a special token's string go through the library whole.
                for k in range(i, j):
                    one = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
                    ids = self.tokenizer.encode(one, add_special_tokens=False).ids
                    all_ids.append(np.array(ids, np.int32))
                    counts[k] = len(ids)
                continue
            if not text:
                continue
            chars = np.zeros(len(part) + 1, np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
            ids, before = self._block(text, chars[offsets[i : j + 1] - offsets[i]])
            all_ids.append(ids)
            counts[i:j] = np.diff(before)
        flat = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
        return flat, np.concatenate([[0], np.cumsum(counts)])


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> FastBpe:
    """One per Python worker and file; reused workers keep what they have learnt."""
    return FastBpe(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to every row."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], np.int32(end_id)), offsets + np.arange(n + 1)
