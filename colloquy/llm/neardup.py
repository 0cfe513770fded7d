"""Near-duplicate documents: MinHash banding, verification on full shingle sets, components.

Texts with one and the same shingle set form a class, so exact copies cost one representative.
Each set's minima under many universal hashes are cut into bands; classes that agree on a band
share a bucket. Links are found in two steps, so that no group's pairs are ever spelt out:

1. Every class of a bucket is paired with the bucket's least class, verified on full sets, and
   components are formed. That settles most of a group of copies.
2. A bucket whose classes still lie in several components is searched in groups of bounded size:
   pairs across components whose signatures agree enough are verified on full sets, and only the
   links that join components leave the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrays import blocks, lists, mix, text_bytes, word_table, words
from colloquy.llm.components import components
from colloquy.llm.scratch import Scratch, materialize

#: Words are [^\x20\x09-\x0D]+ after A-Z are lowered.
TABLE = word_table(bytes([0x20, *range(0x09, 0x0E)]))
SHINGLE_WORDS = 5
BANDS, ROWS = 32, 8
#: Classes of a bucket, and bytes of their sets, on one side of a group of step 2.
GROUP, GROUP_BYTES = 800, 8 << 20
#: Pairs of one class that are verified together in step 1.
HUB = 400
#: Text handled at once; hashing takes about 30 bytes of memory a byte of text.
BLOCK_BYTES = 512 << 10


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n multiply-add hashes of 32 bits."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row of fewer words has one, of none none."""
    _, _, hashes, first = words(data, offsets, TABLE)
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for d in range(k):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[d : d + len(rolled)]
        rolled = mix(rolled)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + h
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: its members' sums under two hashes, as signed 64-bit numbers."""
    sums = np.array([values.sum(), mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).view(np.int64)
    return int(sums[0]), int(sums[1])


def signature(values: np.ndarray, multipliers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minima of a set under all hashes."""
    m, add = multipliers
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(m), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 512):
        h = np.multiply.outer(m, x[i : i + 512])
        h += add[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


FEATURES = "row long, doc_id long, text_hash long, n_shingles long, key long, key2 long, bands array<long>, sketch binary"


def _features(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(bands * rows)
        weights = mix(np.arange(1, rows + 1, dtype=np.uint64))
        band_seed = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            n = len(batch)
            sizes = np.zeros(n, np.int64)
            keys = np.zeros((n, 2), np.int64)
            sketches: list[bytes | None] = [None] * n
            marks = np.zeros((n, bands), np.int64)
            for i, j in blocks(offsets, BLOCK_BYTES):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                for row, values in enumerate(sets, i):
                    sizes[row] = len(values)
                    if len(values):
                        minima = signature(values, multipliers)
                        keys[row] = set_key(values)
                        sketches[row] = (minima >> np.uint32(3)).astype(np.uint8).tobytes()
                        joined = (minima.reshape(bands, rows).astype(np.uint64) * weights).sum(axis=1)
                        marks[row] = mix(joined ^ band_seed).view(np.int64)
            column = lists(marks.ravel(), np.arange(n + 1) * bands)
            own = [pa.array(sizes), *(pa.array(keys[:, c], mask=sizes == 0) for c in (0, 1)), column, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *own], [x.split()[0] for x in FEATURES.split(", ")])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                packed = [values.tobytes() for values in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary())], ["node", "members"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _least_agreement(percent: int, n_hashes: int) -> float:
    """Five standard deviations below the threshold: a true link falls short once in millions."""
    p = percent / 100
    return n_hashes * (p - 5 * np.sqrt(p * (1 - p) / n_hashes))


def _alike(percent: int, n_hashes: int):
    """Of the pairs (u, v), those whose signatures agree enough to be verified."""
    least = _least_agreement(percent, n_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (text_bytes(batch.column(i))[0].reshape(-1, n_hashes) for i in (3, 4))
            yield batch.select([0, 1, 2]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _close(percent: int, n_hashes: int):
    """Links within one group of a bucket that join different components. Pairs whose signatures
    agree enough are verified on full sets, the most alike first; once components are joined,
    their other pairs need no look. So a group gives fewer links than it has classes."""
    least = _least_agreement(percent, n_hashes)

    def run(table: pa.Table) -> pa.Table:
        node, root, size, side = (table.column(c).to_numpy() for c in ("node", "root", "n_shingles", "side"))
        sketch = text_bytes(table.column("sketch"))[0].reshape(len(node), n_hashes)
        data, ends = text_bytes(table.column("members"))
        data, ends = data.view(np.uint64), ends // 8
        label = np.unique(root, return_inverse=True)[1]
        within = not side.any()
        first = np.arange(len(node)) if within else np.flatnonzero(side == 0)
        second = np.arange(len(node)) if within else np.flatnonzero(side == 1)
        links = []
        for i in first.tolist():
            others = second[second > i] if within else second
            others = others[label[others] != label[i]]
            others = others[np.minimum(size[others], size[i]) * 100 >= percent * np.maximum(size[others], size[i])]
            if not len(others):
                continue
            agree = (sketch[others] == sketch[i]).sum(axis=1)
            own = data[ends[i] : ends[i + 1]]
            for j in others[np.argsort(-agree, kind="stable")][: int((agree >= least).sum())].tolist():
                if label[j] != label[i]:
                    both = len(np.intersect1d(own, data[ends[j] : ends[j + 1]], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        links.append((min(node[i], node[j]), max(node[i], node[j])))
                        label[label == label[j]] = label[i]
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return run


def _of_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """(u, v, parts, a, b): ``column`` of both classes of every pair. A class u may be in very many pairs; it is copied
    once for each of ``parts`` lots of them, so that no task gets them all."""
    b = values.select(F.col("node").alias("v"), F.col(column).alias("b"))
    a = pairs.select("u", "parts").distinct().join(values.select(F.col("node").alias("u"), F.col(column).alias("a")), "u")
    a = a.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lots = pairs.join(b, "v").withColumn("lot", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    return lots.join(a, ["u", "parts", "lot"]).select("u", "v", "parts", "a", "b")


def _class_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(node, members): the full shingle sets of the classes that share a bucket, from one text each."""
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("want"), F.col("text_hash").alias("want_hash"))
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("want")) & (F.col("text_hash") == F.col("want_hash")))
    return texts.dropDuplicates(["doc_id", "text_hash"]).select("node", "text").mapInArrow(_sets(k), "node long, members binary")


def _unsettled(members: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (mark, kind, a, b, side, node, root, n_shingles, sketch, members) of the buckets of three or more classes in
    several components, in groups bounded by number and bytes. Buckets of the same classes count once.

    Classes of a bucket's largest component meet those of the others (kind 0), and the others meet each other
    (kind 1), so a bucket with few others costs little more rows than it has classes.
    """
    look = classes.select("node", "n_shingles", "sketch")
    rooted = members.where("n > 2").join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").join(look.select("node", "n_shingles"), "node")
    rooted = rooted.select("mark", "node", F.coalesce("root", "node").alias("root"), "n_shingles")
    hashed = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))
    per = rooted.groupBy("mark", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), hashed[0].alias("x"), hashed[1].alias("y"))
    total = per.groupBy("mark").agg(F.max(F.struct("n", "size", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("roots"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    split = total.where("roots > 1").groupBy("n", "x", "y").agg(F.min(F.struct("mark", "main", "size")).alias("s"))

    def parts(n, size):
        return F.ceil(F.greatest(n / F.lit(float(GROUP)), size * 8 / F.lit(float(GROUP_BYTES)))).cast("int")

    main = F.col("s.main")
    split = split.select(F.col("s.mark").alias("mark"), main["root"].alias("main"), parts(main["n"], main["size"]).alias("m"), parts(F.col("n") - main["n"], F.col("s.size") - main["size"]).alias("r"))
    rows = rooted.drop("n_shingles").join(split, "mark").join(look, "node").join(sets, "node")
    own = F.pmod(F.xxhash64("node", F.lit("part")), F.when(F.col("root") == F.col("main"), F.col("m")).otherwise(F.col("r"))).cast("int")
    group = "array<struct<kind:int,a:int,b:int,side:int>>"

    def listed(n, make):
        return F.transform(F.sequence(F.lit(0), n - 1), make).cast(group)

    def struct(kind, a, b, side):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.alias("side"))

    rows = rows.withColumn("own", own)
    o = F.col("own")
    of_main = listed(F.col("r"), lambda i: struct(0, i, o, F.lit(1)))
    of_rest = F.concat(listed(F.col("m"), lambda j: struct(0, o, j, F.lit(0))), listed(F.col("r"), lambda j: struct(1, F.least(o, j), F.greatest(o, j), (o > j).cast("int"))))
    rows = rows.withColumn("g", F.explode(F.when(F.col("root") == F.col("main"), of_main).otherwise(of_rest)))
    return rows.select("mark", "g.kind", "g.a", "g.b", "g.side", "node", "root", "n_shingles", "sketch", "members")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: ``n_shingles``, ``component_id`` (the least doc_id reachable over links of
    ``100 * |A & B| >= percent * |A | B|``) and ``kept`` (it is that document).

    Null, empty or wordless texts have no shingles and are linked with nothing. Repeated rows are
    exact copies of each other; where rows share the kept id, all of them are marked kept. A null
    id is kept only where its component has no other id, and component_id is null there. Other
    columns are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    features = materialize(numbered.mapInArrow(_features(k, bands, rows), FEATURES), "shingle-features")
    # A class is named by the least row of its set.
    named = materialize(features.where("key is not null").groupBy("key", "key2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    classes = scratch.keep(features.join(named.select("node"), F.col("row") == F.col("node"), "left_semi").withColumnRenamed("row", "node"), "class-features")
    marks = classes.select("node", F.explode("bands").alias("mark"))
    shared = marks.groupBy("mark").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = scratch.keep(marks.join(shared, "mark"), "buckets")
    sets = scratch.keep(_class_sets(docs, classes, members, k), "sets")
    stars = members.where("node <> least").groupBy(F.col("least").alias("u"), F.col("node").alias("v")).agg(F.ceil(F.max("n") / F.lit(float(HUB))).cast("int").alias("parts"))
    stars = _of_both(scratch.keep(stars, "stars"), classes, "sketch").mapInArrow(_alike(percent, bands * rows), "u long, v long, parts int")
    links = _of_both(scratch.keep(stars, "alike"), sets, "members").select("u", "v", "a", "b").mapInArrow(_linked(percent), "u long, v long")
    links = scratch.keep(links, "star-links")
    roots = components(links)
    groups = _unsettled(members, roots, classes, sets).groupBy("mark", "kind", "a", "b")
    more = scratch.keep(groups.applyInArrow(_close(percent, bands * rows), "u long, v long").distinct(), "more-links")
    if not more.isEmpty():
        roots = components(roots.union(more))
    scratch.clear()
    rooted = named.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.select("key", "key2", "root").join(least, "root").select("key", "key2", "component_id")
    out = features.select("doc_id", "n_shingles", "key", "key2").join(found, ["key", "key2"], "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents (all columns) without near duplicates: of every component the one of least id
    stays, and of rows that repeat its id and text one."""
    found = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    kept = docs.join(found, docs["doc_id"].eqNullSafe(found["_kept_id"]), "left_semi")
    return kept.withColumn("_text", F.xxhash64("text", F.lit(1))).dropDuplicates(["doc_id", "_text"]).drop("_text")
