"""Whitening, repeated passages and collocations against brute-force versions, and on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import collocations, repeats, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, copies int, kept_text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, langs=None):
    langs = langs or [None] * len(texts)
    return spark.createDataFrame([(i, t, lang, "s", 0, "k", 1, "x") for i, (t, lang) in enumerate(zip(texts, langs))], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Repeated passages.
def brute_rest(texts, window):
    words = [WORDS.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + d for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for d in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def odd_texts():
    """Shared passages, near copies, exact copies, periodic and very long texts, other white space, ties, nulls."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for n in range(30):
        own = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))]
        cut = rng.randint(0, 30)
        texts.append(" ".join(own[:20] + passage[cut : cut + rng.randint(3, 25)] + own[20:]))
    texts += [" ".join(passage), "\n".join(passage) + "\t", " ".join(passage[:20] + ["x"] + passage[21:]), texts[0], texts[0], "a b " * 30, "b a " * 30 + "c", "z " * 200]
    texts += [None, "", " \n ", "one", "one", "naïve 漢字 😀 " * 9, "word " * 60000 + "tail", " ".join(passage[5:15]), " ".join(passage[5:14])]
    return texts


@pytest.mark.parametrize(("window", "seed"), [(10, 4), (10, 10), (1, 1), (35, 12)])
def test_rests_against_brute_force(spark, none, window, seed):
    texts = odd_texts()
    got = {r.doc_id: r for r in repeats.without_repeats(frame(spark, texts), window, seed).collect()}
    assert len(got) == len(texts)
    for i, (n, gone, rest) in enumerate(brute_rest(texts, window)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (n, gone, rest), i
        assert got[i].kept_sha256 == hashlib.sha256(rest.encode()).hexdigest()
        assert got[i].key == "k" and got[i].copies == 1
    assert repeats.without_repeats(none, window, seed).count() == 0


def test_spans_are_unitigs(spark):
    a = [f"w{i}" for i in range(50)]
    texts = [" ".join(["x", *a, "y"]), " ".join([*a[10:30], "z"]), " ".join(["q", *a])]
    rows = repeats.repeated_spans(frame(spark, texts), window=5, seed=3).collect()
    by_text = collections.defaultdict(list)
    for r in rows:
        by_text[r.text_md5].append((r.start, r.n_words, r.occurrences))
    got = {i: sorted(by_text[hashlib.md5(t.encode()).hexdigest()]) for i, t in enumerate(texts)}
    # Three texts share words 10 to 29; on both sides two go on.
    assert got[1] == [(0, 20, 3)]
    assert got[0] == [(1, 14, 2), (11, 20, 3), (27, 24, 2)]
    assert got[2] == [(1, 14, 2), (11, 20, 3), (27, 24, 2)]


def test_unitigs_of_a_text():
    """Edge 2 is followed by several others; edge 9 isn't repeated."""
    first, last = repeats.unitigs(np.array([1, 2, 3, 9, 2]), np.array([1, 2, 3]), np.array([2, 2, 2]), np.array([True, False, True]))
    assert first.tolist() == [0, 2, 4] and last.tolist() == [1, 2, 4]


def test_least_of_takes_the_first_of_equals():
    values = np.array([5, 3, 3, 9, 1, 1, 7, 8, 8, 8], np.uint64) << np.uint64(40)
    got = repeats.least_of(values, 3).tolist()
    assert got == [min(range(i, i + 3), key=lambda j: (values[j], j)) for i in range(8)]


# Collocations.
def brute_collocations(texts, langs, longest, least, first):
    out = []
    f = collections.defaultdict(collections.Counter)
    total = collections.Counter()
    for text, lang in zip(texts, langs):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 50 * a for b in inside):
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "first"), [(3, 3, 2000), (4, 2, 50), (2, 1, 7)])
def test_collocations_against_brute_force(spark, monkeypatch, none, longest, least, first):
    monkeypatch.setattr(collocations, "PARTS", 3)
    rng = random.Random(8)
    vocabulary = ["the", "The", "of", "naïve", "漢字", "e-mail", "a", "b", "New", "York", "city", "😀", "x\x00y"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", ". ", ",", "\n", "  ", "\r\x0b"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    langs = [rng.choice(["en", "de", None, "und"]) for _ in texts]
    texts += [None, "", " . ", "a a a a a a a a", "new york city " * 3000, texts[0], texts[0]]
    langs += ["en", None, "fr", "en", "de", langs[0], langs[0]]
    got = collocations.collocations(frame(spark, texts, langs), longest, least, first=first).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations(texts, langs, longest, least, first)
    assert collocations.collocations(none).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**14 + 7, 3 * 10**14 + 1, 10**14 + 9)], "a long, l long, r long")
    whole = "cast({} as decimal(15,0))".format
    got = rows.select(F.expr(f"(cast(1000000 as decimal(7,0)) * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")).first()[0]
    assert got == 1000000 * (10**14 + 7) ** 2 // ((3 * 10**14 + 1) * (10**14 + 9))


# Whitening.
VECTORS = "vec_id long, embedding array<float>, label int, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9) for i, v in rows], VECTORS)


def exact(rows):
    x = [(i, np.array([int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v])) for i, v in rows]
    fit = np.unique(np.array([v for _, v in x]), axis=0)
    return x, fit, len(fit), fit.sum(axis=0)


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 24)) * np.linspace(3, 0.2, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(7, base[7].tolist()), (None, base[8].tolist())] + [(500 + i, base[3].tolist()) for i in range(40)]
    bad = [(900, None), (901, []), (902, [1.0] * 23 + [None]), (903, [1.0] * 23 + [float("nan")]), (904, [float("-inf")] * 24), (905, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows + bad), wanted=16).collect()
    x, fit, n, sums = exact(rows)
    assert n == 120 and len(got) == len(rows) * 16
    cov = np.cov(fit.T, bias=True)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    table = collections.defaultdict(dict)
    for r in got:
        assert r.n == n and r.identity_error < 1e-10
        assert abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-10
        table[r.vec_id, r.deviation][r.component] = r.whitened
    signs = None
    for i, own in x:
        values = table[i, sum((n * int(c) - int(s)) ** 2 for c, s in zip(own, sums))]
        want = (own - sums / n) @ v[:, :16] / np.sqrt(e[:16])
        have = np.array([values[k] for k in range(1, 17)])
        signs = np.sign(want * have) if signs is None else signs
        assert np.abs(want - signs * have).max() < 1e-6


def test_whitening_of_few_or_no_dimensions(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 3.0 * i]) for i in range(10)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 10 and abs(line[0].explained - 1) < 1e-12
    # Equal eigenvalues: each start finds one of them.
    cube = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)]) for i in range(8)]
    same = whitening.whiten(vectors(spark, cube)).collect()
    assert len(same) == 24 and all(abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-12 for r in same)


def test_deviations_of_great_numbers(spark):
    rows = [(1, [1e14, 0.0]), (2, [-1e14, 1.0]), (3, [5.0, 1e16])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    x, _, n, sums = exact(rows)
    want = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(own, sums.tolist())) for i, own in x}
    assert {r.vec_id: int(r.deviation) for r in got} == want
