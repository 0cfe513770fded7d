"""Which of many phrases a text contains, in one pass over the texts of an Arrow batch however many phrases there are."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A phrase is looked up by its first bytes: as many of these lengths as it has.
ANCHORS = (6, 4, 3, 2, 1)
#: Bytes of texts worked on at once: what a processor keeps at hand.
BLOCK = 256 << 10
_MIX = np.uint64(0x9E3779B97F4A7C15)


def finder(phrases: tuple[str, ...]) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to the lists of the distinct phrases they contain, overlapping ones too; null of null."""
    raw = [p.encode() for p in phrases]
    sizes = np.array([len(p) for p in raw])
    width = -(-int(sizes.max()) // 8) * 8
    # Phrases and what they cover, eight bytes a number.
    table, cover = (np.frombuffer(b"".join(x.ljust(width, b"\0") for x in these), "<u8").reshape(len(raw), -1) for these in (raw, [b"\xff" * len(p) for p in raw]))
    heads, kinds = table[:, 0], []
    taken = np.zeros(len(raw), bool)
    for n in ANCHORS:
        own = np.flatnonzero((sizes >= n) & ~taken)
        taken[own] = True
        if len(own):
            mask = np.uint64((1 << 8 * n) - 1)
            own = own[np.argsort(heads[own] & mask, kind="stable")]
            keys = heads[own] & mask
            maybe = np.zeros(1 << 16, bool)
            maybe[(keys * _MIX) >> np.uint64(48)] = True
            kinds.append((mask, maybe, keys, own))
    names = pa.array(phrases, pa.string())

    def found(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        _, at, data = texts.buffers()
        offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(offsets[-1] - offsets[0])
        body = np.zeros(size + width + 8, np.uint8)
        if size:
            body[:size] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        # The eight bytes from every place on.
        window = np.ndarray(size + width, "<u8", body, strides=(1,))
        places, which = [], []
        for mask, maybe, keys, own in kinds:
            head = window[:size] & mask
            place = np.flatnonzero(maybe[(head * _MIX) >> np.uint64(48)])
            first, last = (np.searchsorted(keys, head[place], side) for side in ("left", "right"))
            n = last - first
            places.append(np.repeat(place, n))
            which.append(own[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        place, phrase = np.concatenate(places), np.concatenate(which)
        text = np.searchsorted(offsets, place, "right") - 1
        inside = place + sizes[phrase] <= offsets[text + 1]
        place, phrase, text = place[inside], phrase[inside], text[inside]
        for i in range(0, width, 8):  # those that still agree
            same = (window[place + i] ^ table[phrase, i // 8]) & cover[phrase, i // 8] == 0
            place, phrase, text = place[same], phrase[same], text[same]
        pairs = np.unique(text * len(raw) + phrase)
        ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(raw)).astype(np.int32)
        lists = names.take(pa.array(pairs % len(raw)))
        nulls = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends), lists, mask=nulls)

    return found


def spotted(text: Column, phrases: Iterable[str]) -> Column:
    """The distinct phrases that the text contains."""
    found = finder(tuple(dict.fromkeys(p for p in phrases if p)))

    def run(texts: pa.Array) -> pa.Array:
        rows = max(1, len(texts) * BLOCK // max(1, texts.nbytes))
        return pa.concat_arrays([found(texts.slice(i, rows)) for i in range(0, max(1, len(texts)), rows)])

    return F.arrow_udf(run, "array<string>")(text)
