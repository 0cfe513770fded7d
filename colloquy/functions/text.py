"""Scalar text functions as Spark columns; all stay inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import lexicons as L

TRIM = ".,;:!?\"'()-[]{}/<>"
NUMBER = r"[$€£]?\d+(?:[.,]\d+)*%?"
MARK = "\u001f"


def normalize_quotes(text: Column) -> Column:
    """Curly quotes to plain ones."""
    return F.translate(text, "‘’“”", "''\"\"")


def lowered(text: Column) -> Column:
    return F.lower(normalize_quotes(text))


def words(text: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokenize(text: Column) -> Column:
    """Words without punctuation at either end; empty ones are dropped."""
    return F.filter(F.transform(words(text), lambda w: F.btrim(w, F.lit(TRIM))), lambda w: w != "")


def stem(word: Column, suffixes: Sequence[tuple[str, str]] = L.SUFFIXES) -> Column:
    """The word without its longest known suffix that leaves three bytes or more."""
    # Only suffixes with the word's last letter are tried, in the list's order.
    rules: dict[str, list[dict[str, str]]] = {}
    for cut_, put in suffixes:
        rules.setdefault(cut_[-1:], []).append({"cut": cut_, "put": put})
    known = F.from_json(F.lit(json.dumps(rules)), "map<string, array<struct<cut: string, put: string>>>")
    size = F.octet_length(word)
    fits = F.filter(F.try_element_at(known, F.right(word, F.lit(1))), lambda r: F.endswith(word, r["cut"]) & (size - F.octet_length(r["cut"]) + F.octet_length(r["put"]) >= 3))
    cut = once(F.get(fits, F.lit(0)), lambda r: F.when(r.isNotNull(), F.concat(F.left(word, F.length(word) - F.length(r["cut"])), r["put"])).otherwise(word))
    return F.when(size <= 3, word).otherwise(cut)


def keywords(text: Column, stemmed: bool = True, min_bytes: int = 3, stopwords: Iterable[str] = L.STOPWORDS) -> Column:
    """Distinct content words in order of first use."""
    plain = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    # Each distinct word once: what is left out comes by hashing, in order of first use.
    kept = F.filter(F.array_except(plain, listed(stopwords)), lambda w: F.octet_length(w) >= max(min_bytes, 1))
    return F.array_distinct(F.transform(kept, lambda w: stem(w))) if stemmed else kept


def numeric_tokens(text: Column) -> Column:
    """array<struct<value, position, context>>: amounts, with 0-based character position and 50
    characters around; what is no number (1.2.3) is dropped."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    gaps = F.transform(F.split(text, NUMBER, -1), lambda g: F.length(g))
    # Behind the last amount there is one more gap, which the pairs have no amount for.
    pairs = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("gap")), lambda p: p["m"].isNotNull())

    def step(state: Column, p: Column) -> Column:
        at = state["at"] + p["gap"]
        return F.struct((at + F.length(p["m"])).alias("at"), F.array_append(state["out"], F.struct(p["m"].alias("m"), at.alias("at"))).alias("out"))

    def one(p: Column) -> Column:
        start = F.greatest(p["at"] - 50, F.lit(0))
        around = F.substr(text, start + 1, p["at"] + F.length(p["m"]) + 50 - start)
        return F.struct(F.regexp_replace(p["m"], "[$€£,%]", "").try_cast("double").alias("value"), p["at"].alias("position"), around.alias("context"))

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,at:int>>").alias("out")), step)["out"]
    return F.filter(F.transform(placed, one), lambda s: s["value"].isNotNull())


def entity_mentions(text: Column) -> Column:
    """Runs of two or more capitalised words; punctuation after a run goes unless it ends the text."""
    padded = F.concat(F.lit(" "), text)
    runs = F.regexp_extract_all(padded, F.lit(r"\s\p{Lu}\S*(?:\s+\p{Lu}\S*)+"), F.lit(0))
    return F.transform(runs, lambda m: F.when(F.endswith(F.rtrim(padded), m), F.ltrim(m)).otherwise(F.rtrim(F.ltrim(m), F.lit(".,;:!?"))))


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark and a blank; marks stay."""
    parts = F.split(F.regexp_replace(text, "([.!?]) ", f"$1{MARK}"), MARK)
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \n\t"))), lambda s: s != "")


def sentences_hard(text: Column) -> Column:
    """Split on . ! ? ; without the marks."""
    return F.filter(F.transform(F.split(text, "[.!?;]"), lambda s: F.btrim(s, F.lit(" \n\t"))), lambda s: s != "")


def listed(phrases: Iterable[str]) -> Column:
    """Strings as an array that is folded to one constant, so that long lists make small plans."""
    return F.split(F.lit(MARK.join(phrases)), MARK)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def phrase_any(text: Column, phrases: Iterable[str], met: Column | None = None) -> Column:
    """Whether the text contains any phrase. Here and below, ``met`` has the phrases of the list (and others) that the text contains, as ``spotted``
    finds them; the text is then not searched again."""
    if met is not None:
        return F.arrays_overlap(met, listed(phrases))
    return once(text, lambda t: F.exists(listed(phrases), lambda p: F.contains(t, p)))


def phrases_in(text: Column, phrases: Iterable[str], met: Column | None = None) -> Column:
    """The phrases, in the list's order, that the text contains; with ``met``, each once."""
    if met is not None:
        return F.array_intersect(listed(phrases), met)
    return F.filter(listed(phrases), lambda p: F.contains(text, p))


def phrase_first(text: Column, phrases: Iterable[str], met: Column | None = None) -> Column:
    """The first phrase, in the list's order, that the text contains."""
    return once(text, lambda t: F.get(phrases_in(t, phrases, met), F.lit(0)))


def phrase_hits(text: Column, phrases: Iterable[str], met: Column | None = None) -> Column:
    """How many phrases the text contains."""
    return F.size(phrases_in(text, phrases, met)) if met is not None else once(text, lambda t: F.size(phrases_in(t, phrases)))


def phrase_occurrences(text: Column, phrases: Iterable[str], overlapping: bool = False, met: Column | None = None) -> Column:
    """Occurrences of all phrases, each counted non-overlapping or at every position."""
    if overlapping:
        count = lambda t, p: F.regexp_count(t, F.concat(F.lit("(?=\\Q"), p, F.lit("\\E)")))
    else:
        count = lambda t, p: ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")
    # Counting costs far more than a look whether there is anything to count.
    return once(text, lambda t: F.aggregate(phrases_in(t, phrases, met), F.lit(0), lambda n, p: n + count(t, p)))


def bounded(text: Column, phrase: str) -> Column:
    """The phrase stands between characters that are neither letters nor digits."""
    return text.rlike(r"(^|[^\p{L}\p{N}])" + _quoted(phrase) + r"($|[^\p{L}\p{N}])")


def _quoted(phrase: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in phrase)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two sets given as arrays; ``empty`` where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / both.cast("double"))


def overlap_coefficient(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / least.cast("double"))


def topic_vector(stems: Column, topics: Mapping[str, Mapping[str, float]] = L.TOPICS) -> Column:
    """Sum of lexicon weights of the words, by topic in order of name."""
    weights = [F.create_map(*[F.lit(x) for pair in sorted(topics[t].items()) for x in (pair[0], float(pair[1]))]) for t in sorted(topics)]

    def total(m: Column) -> Column:
        return F.aggregate(stems, F.lit(0.0), lambda sum_, w: sum_ + F.coalesce(F.try_element_at(m, w), F.lit(0.0)))

    return F.array(*[total(m) for m in weights])


def topic_similarity(a: Column, b: Column, n: int = len(L.TOPICS)) -> Column:
    """Sum of least over sum of greatest weights; -1 where either has no signal."""
    least = sum((F.least(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(1, n)), F.least(F.get(a, F.lit(0)), F.get(b, F.lit(0))))
    most = sum((F.greatest(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(1, n)), F.greatest(F.get(a, F.lit(0)), F.get(b, F.lit(0))))
    silent = F.array_max(a).eqNullSafe(F.lit(0.0)) | F.array_max(b).eqNullSafe(F.lit(0.0))
    return F.when(silent, F.lit(-1.0)).otherwise(least / most)


def bracket_citations(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[[0-9]+\]"))


def strong_declarative(text: Column, hedges: Iterable[str] = L.HEDGE_WORDS, openers: Iterable[str] = L.INTERROGATIVE, markers: Iterable[str] = L.DECLARATIVE, starts: Iterable[str] = L.DECLARATIVE_OPENERS) -> Column:
    """A statement of six words or more, without hedge or question, that asserts something."""

    def of(low: Column) -> Column:
        begins = lambda these: F.exists(listed(these), lambda p: F.startswith(low, p))
        return ~F.btrim(low, F.lit(" \n\t")).endswith("?") & ~begins(openers) & (word_count(low) >= 6) & ~phrase_any(low, hedges) & (phrase_any(low, markers) | begins(starts))

    return once(lowered(text), of)


def authority_citation(text: Column, phrases: Iterable[str] = L.AUTHORITY, verbs: Iterable[str] = L.CITATION_VERBS, held: Iterable[str] = L.HELD_THAT, reach: int = 40, met: Column | None = None) -> Column:
    """A fixed phrase; else "as NAME verb" within ``reach`` characters of the first "as "; else "word held that"."""

    verbs = tuple(verbs)
    # A verb that begins within reach ends within so many characters.
    span = reach + max((len(v) for v in verbs), default=0)

    def by_name(after: Column) -> Column:
        at = lambda v: F.position(v, after) - 1
        name = lambda v: F.btrim(F.left(after, at(v)), F.lit(" \n\t"))
        named = F.filter(listed(verbs), lambda v: at(v).between(1, reach) & (F.length(name(v)) >= 3) & ~F.contains(name(v), F.lit("?")))
        return once(F.get(named, F.lit(0)), lambda v: F.concat(F.lit("as "), name(v), v))

    def of(low: Column) -> Column:
        after = F.substr(low, F.locate("as ", low) + 3, F.lit(span))
        before = lambda v: F.element_at(F.concat(F.array(F.lit("")), words(F.left(low, F.position(v, low) - 1))), -1)
        told = F.filter(phrases_in(low, held, met), lambda v: (F.position(v, low) > 1) & (F.length(before(v)) >= 3))
        first = F.when(F.contains(low, F.lit("as ")), once(after, by_name))
        return F.coalesce(phrase_first(low, phrases, met), first, once(F.get(told, F.lit(0)), lambda v: F.concat(before(v), v)))

    return once(lowered(text), of)


def independent_justification(text: Column, min_words: int = 10, markers: Iterable[str] = L.MERIT, bare: Iterable[str] = L.NO_MERIT) -> Column:
    """No bare assertion, and a merit marker that ``min_words`` words or more follow."""

    def of(low: Column) -> Column:
        after = lambda m: F.substr(low, F.position(m, low) + F.length(m), F.length(low))
        return ~phrase_any(low, bare) & F.exists(listed(markers), lambda m: F.contains(low, m) & (word_count(after(m)) >= min_words))

    return once(lowered(text), of)


def defended_claim(text: Column, phrases: Iterable[str] = L.AUTHORITY, verbs: Iterable[str] = L.CITATION_VERBS, limit: int = 120) -> Column:
    """The sentence that cites an authority, or else the text, cut at ``limit`` characters with dots behind."""
    parts = F.filter(F.split(text, "[.!?;]"), lambda s: s != "")
    cites = lambda s: once(lowered(s), lambda x: phrase_any(x, phrases) | phrase_any(x, verbs))
    claim = F.coalesce(F.btrim(F.get(F.filter(parts, cites), F.lit(0)), F.lit(" \n\t")), text)
    return once(claim, lambda c: F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c))


def trigrams(text: Column) -> Column:
    """All character trigrams, overlapping, in one pass."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1))


def path_root(path: Column, parts: int = 4) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, parts), "/")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def hundredths(x: Column) -> Column:
    """A number from 0 to 1 with two decimals, as C's printf writes it: the double's exact value decides, and exact ties go to the even
    digit. (Java's formatter rounds the shortest decimal that stands for the double, ties up: 0.125 and 0.145 would differ.)"""
    # From 0.005 on a double is a whole number of 2**-60; what is less rounds to 0 either way.
    unit = F.lit(Decimal(1 << 60))
    scaled = (x * F.lit(float(1 << 60))).cast("long").cast("decimal(20,0)") * F.lit(Decimal(100))
    whole, rest = ((scaled - scaled % unit) / unit).cast("int"), scaled % unit * F.lit(Decimal(2))
    n = whole + ((rest > unit) | ((rest == unit) & (whole % 2 == 1))).cast("int")
    return F.format_string("%d.%02d", F.floor(n / 100), n % 100)


def finding_id(detector: Column, turns: Column) -> Column:
    return F.concat(detector, F.lit(":["), F.array_join(F.transform(turns, lambda t: t.cast("string")), " "), F.lit("]"))
