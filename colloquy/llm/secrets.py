"""Secret scans with Spark functions alone.

Base kinds are found by pattern. Beyond them, candidate strings (runs of token characters that mix in a
digit) are judged by Shannon entropy over a sliding window: the counts of the window's characters
are kept as it moves, and only the terms of the character that enters and the one that leaves
change. Each character class has its own threshold; an allow-list suppresses known harmless forms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings: runs with a digit in them. The run is possessive, so long runs cost one pass.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20

#: Forms that look random and are not secrets (identifiers, dates, versions, words with a number).
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]++$",
    r"^[A-Za-z]++[0-9]{1,4}$",
)
#: Fixed value: paths and identifiers of words, with at most four digits behind, if they hold one of ``PARTED``.
ALLOWED_PATH, PARTED = r"^[A-Za-z/_-]*+[0-9]{0,4}$", r"[/_-]"
#: Spans that are gathered in one array before it is put away: appending copies it.
CHUNK = 500


@dataclass(frozen=True)
class Classes:
    """Least entropy in bits a character, over a window, by the candidate's character class."""

    hexadecimal: float = 3.0
    alphanumeric: float = 3.6
    base64: float = 3.8


def _folded(items: Column, kind: str, step) -> Column:
    """Folds ``step(state, item)`` over an array, with a state of ``at`` (a position) and ``out`` (an array of ``kind``):
    all of ``out``, and the last ``at``. It goes by chunks, so the work grows with the array's size alone."""
    empty = F.array().cast(f"array<{kind}>")
    chunks = F.transform(F.array(items), lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / F.lit(CHUNK)).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK))))[0]

    def chunk(done: Column, own: Column) -> Column:
        at = F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0))
        return F.array_append(done, F.aggregate(own, F.struct(at.alias("at"), empty.alias("out")), step))

    done = F.aggregate(chunks, F.array().cast(f"array<struct<at:int,out:array<{kind}>>>"), chunk)
    return F.transform(F.array(done), lambda d: F.struct(F.flatten(d["out"]).alias("out"), F.element_at(d, -1)["at"].alias("at")))[0]


SPAN = "struct<start:int,end:int,kind:int>"


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans (start, end, kind) of a pattern's matches in code points, of those ``keep(match)`` holds for.

    Matches and the pieces between them alternate, so a match starts where all before it end.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"))
        return F.struct(end.alias("at"), F.when(keep(pair["m"]), F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    # Behind the last match there is one more piece, which the pairs have no match for.
    pairs = F.filter(F.arrays_zip(matches.alias("m"), gaps.alias("gap")), lambda p: p["m"].isNotNull())
    return F.when(text.rlike(pattern), _folded(pairs, SPAN, step)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def window_entropy(text: Column, width: int = WINDOW) -> Column:
    """The greatest Shannon entropy of any ``width`` consecutive ASCII characters, in bits.

    The fold's state has ``counts``, a string with one character for each ASCII code that stands for how often
    that code is in the window, and ``terms``, the sum of c*log2(c) over all counts c. A step changes two counts.
    """
    logs = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(width + 2)])
    none = ord("0")

    def moved(counts: Column, code: Column, by: int) -> Column:
        place = code + 1
        return F.overlay(counts, F.char(F.ascii(F.substr(counts, place, F.lit(1))) + by), place, F.lit(1))

    def count(counts: Column, code: Column) -> Column:
        return F.ascii(F.substr(counts, code + 1, F.lit(1))) - none

    def changed(n: Column, by: int) -> Column:
        return F.get(logs, n + by) - F.get(logs, n)

    def entered(state: Column, code: Column) -> Column:
        return F.struct(moved(state["counts"], code, 1).alias("counts"), (state["terms"] + changed(count(state["counts"], code), 1)).alias("terms"), (state["n"] + 1).alias("n"), state["best"].alias("best"))

    def left(state: Column, code: Column) -> Column:
        return F.struct(moved(state["counts"], code, -1).alias("counts"), (state["terms"] + changed(count(state["counts"], code), -1)).alias("terms"), state["n"].alias("n"), state["best"].alias("best"))

    def judged(state: Column) -> Column:
        bits = F.lit(math.log2(width)) - state["terms"] / width
        return F.struct(state["counts"].alias("counts"), state["terms"].alias("terms"), state["n"].alias("n"), F.when(state["n"] >= width, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"))

    def step(state: Column, item: Column) -> Column:
        # The steps one after the other: each is bound once and read by the next. The first gives way to what enters.
        gone = F.transform(F.array(state), lambda s: F.when(item["gone"].isNotNull(), left(s, item["gone"])).otherwise(s))
        return F.transform(F.transform(gone, lambda s: entered(s, item["came"])), judged)[0]

    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    items = F.arrays_zip(codes.alias("came"), F.concat(F.array_repeat(F.lit(None).cast("int"), width), F.slice(codes, 1, F.greatest(F.length(text) - width, F.lit(0)))).alias("gone"))
    start = F.struct(F.lit(chr(none) * 128).alias("counts"), F.lit(0.0).alias("terms"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))
    return F.aggregate(F.filter(items, lambda x: x["came"].isNotNull()), start, step)["best"]


def _is_secret(candidate: Column, least: Classes) -> Column:
    allowed = candidate.rlike(ALLOWED_PATH) & candidate.rlike(PARTED)
    for form in ALLOWED:
        allowed = allowed | candidate.rlike(form)
    threshold = F.when(candidate.rlike("^[0-9a-f]++$|^[0-9A-F]++$"), least.hexadecimal).when(candidate.rlike("^[0-9A-Za-z]++$"), least.alphanumeric).otherwise(least.base64)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(candidate) >= threshold)


def spans(text: Column, least: Classes = Classes()) -> dict[str, Column]:
    """Arrays of (start, end, kind) by kind, ends exclusive, in code points."""
    return {
        "assign": _spans(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        "access": _spans(text, ACCESS, "access", lambda m: F.length(m) >= 20),
        "hex": _spans(text, HEX, "hex", lambda m: F.length(m) >= 24),
        "entropy": _spans(text, CANDIDATE, "entropy", lambda m: _is_secret(m, least)),
    }


def with_spans(docs: DataFrame, least: Classes = Classes()) -> DataFrame:
    """Adds ``spans_<kind>`` (arrays of start, end, kind) for each kind; null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({f"spans_{k}": v for k, v in spans(text, least).items()})


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, least: Classes = Classes()) -> DataFrame:
    """Per document: the number of base spans of each kind, the digest of all base spans, and all spans.

    Null or empty text has none. Repeated rows are reported each; other columns are not read.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least)
    base = F.concat("spans_assign", "spans_access", "spans_hex")
    return found.select(
        "doc_id",
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, "spans_entropy")).alias("spans"),
        F.size("spans_entropy").cast("long").alias("n_entropy"),
    )


def mask(docs: DataFrame, least: Classes = Classes(), mark: str = "[secret]") -> DataFrame:
    """The documents with every secret in ``text`` replaced by ``mark``; overlapping spans are one.

    All other columns stay, but for ``n_chars``, which follows the text. Texts without secrets, null
    ones too, are left as they are.
    """
    found = with_spans(docs, least)
    everything = F.array_sort(F.concat(*[F.col(f"spans_{k}") for k in KINDS]))

    # What stays: from the end of all spans so far to the start of the next.
    def step(state: Column, s: Column) -> Column:
        piece = F.struct(state["at"].alias("from"), s["start"].alias("to"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], F.array_append(state["out"], piece)).otherwise(state["out"]).alias("out"))

    def cut(section: Column) -> Column:
        """Pieces of one chunk, from the part of the text that holds them: finding a place in a long text takes long."""
        start, end = section[0]["from"], F.element_at(section, -1)["to"]
        part = F.array(F.substr("text", start + 1, end - start))
        return F.transform(part, lambda t: F.transform(section, lambda p: F.substr(t, p["from"] - start + 1, p["to"] - p["from"])))[0]

    kept = F.transform(F.array(_folded(F.col("_all"), "struct<from:int,to:int>", step)), lambda f: F.array_append(f["out"], F.struct(f["at"].alias("from"), F.length("text").alias("to"))))[0]
    sections = F.transform(F.array(kept), lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / F.lit(CHUNK)).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK))))[0]
    rest = F.array_join(F.flatten(F.transform(sections, cut)), mark)
    found = found.withColumn("_all", everything).withColumn("_rest", F.when(F.size("_all") > 0, rest))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.coalesce("_rest", "text").alias("text"))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length("_rest"), "n_chars").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(c))
    return found.select(*columns)
