"""Fragments of DuckDB SQL from which the registered queries' SQL is put together."""

from __future__ import annotations

from collections.abc import Iterable

from colloquy import lexicons as L
from colloquy.functions.text import NUMBER, TRIM, _quoted


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values: Iterable[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def low(x: str) -> str:
    return f"lower(translate({x}, '‘’“”', '''''\"\"'))"


def any_of(x: str, phrases: Iterable[str]) -> str:
    return f"(len(list_filter({strings(phrases)}, lambda p_: contains({x}, p_))) > 0)"


def first_of(x: str, phrases: Iterable[str]) -> str:
    return f"(list_filter({strings(phrases)}, lambda p_: contains({x}, p_)))[1]"


def hits(x: str, phrases: Iterable[str]) -> str:
    return f"len(list_filter({strings(phrases)}, lambda p_: contains({x}, p_)))"


def total(parts: str) -> str:
    return f"coalesce(list_sum({parts}), 0)::INTEGER"


def occurrences(x: str, phrases: Iterable[str]) -> str:
    return total(f"list_transform({strings(phrases)}, lambda p_: (length({x}) - length(replace({x}, p_, ''))) // length(p_))")


def overlapping(x: str, phrases: Iterable[str]) -> str:
    return total(f"list_transform(list_filter({strings(phrases)}, lambda p_: contains({x}, p_)), lambda p_: len(list_filter(range(1, length({x}) + 2), lambda i_: substr({x}, i_, length(p_)) = p_)))")


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"list_filter(list_transform({words(x)}, lambda w: trim(w, {lit(TRIM)})), lambda w: w <> '')"


def stem(w: str) -> str:
    rules = " ".join(f"WHEN ends_with({w}, '{s}') AND strlen({w}) - {len(s)} + {len(r)} >= 3 THEN left({w}, length({w}) - {len(s)}) || '{r}'" for s, r in L.SUFFIXES)
    return f"CASE WHEN strlen({w}) <= 3 THEN {w} {rules} ELSE {w} END"


def distinct(x: str) -> str:
    """Distinct elements in order of first use."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def keywords_cte(name: str = "kw", source: str = "turns", stemmed: bool = True) -> str:
    """A table with the keywords of every turn."""
    word = stem("w") if stemmed else "w"
    return rf"""{name}_0 AS (SELECT conv_id, turn_number, speaker, raw_text, list_transform(list_filter(list_transform({words("lower(raw_text)")},
        lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: strlen(w) >= 3 AND NOT list_contains({strings(L.STOPWORDS)}, w)), lambda w: {word}) AS k FROM {source}),
    {name} AS (SELECT conv_id, turn_number, speaker, raw_text, {distinct("k")} AS k FROM {name}_0)"""


def jaccard(a: str, b: str, empty: str = "0.0") -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN {empty}::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END)"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]) ', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s, ' ' || chr(10) || chr(9))), lambda s: s <> '')"


def sentences_hard(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[.!?;]'), lambda s: trim(s, ' ' || chr(10) || chr(9))), lambda s: s <> '')"


def numbers(x: str) -> str:
    """Structs of value, position and context."""
    found, gaps = f"regexp_extract_all({x}, '{NUMBER}')", f"list_transform(string_split_regex({x}, '{NUMBER}'), lambda g: length(g))"
    at = f"coalesce(list_sum(({gaps})[1:i]), 0) + coalesce(list_sum(list_transform(({found})[1:i-1], lambda y: length(y))), 0)"
    return f"""list_filter(list_transform({found}, lambda m, i: {{'value': TRY_CAST(regexp_replace(m, '[$€£,%]', '', 'g') AS DOUBLE), 'position': ({at})::INTEGER,
        'context': substr({x}, (greatest({at} - 50, 0) + 1)::BIGINT, ({at} + length(m) + 50 - greatest({at} - 50, 0))::BIGINT)}}), lambda s: s.value IS NOT NULL)"""


def entities(x: str) -> str:
    padded = f"(' ' || {x})"
    return rf"""list_transform(regexp_extract_all({padded}, '\s\p{{Lu}}\S*(?:\s+\p{{Lu}}\S*)+'), lambda m: CASE WHEN ends_with(rtrim({padded}), m) THEN ltrim(m) ELSE rtrim(ltrim(m), '.,;:!?') END)"""


def bounded(x: str, phrase: str) -> str:
    return rf"regexp_matches({x}, '(^|[^\p{{L}}\p{{N}}])' || {lit(_quoted(phrase))} || '($|[^\p{{L}}\p{{N}}])')"


def clamp(x: str, a: str = "0.0", b: str = "1.0") -> str:
    return f"greatest(least({x}, {b}::DOUBLE), {a}::DOUBLE)"


def declarative(x: str) -> str:
    lo = low(x)
    begins = lambda these: f"(len(list_filter({strings(these)}, lambda p_: starts_with({lo}, p_))) > 0)"
    asserts = f"({any_of(lo, L.DECLARATIVE)} OR {begins(L.DECLARATIVE_OPENERS)})"
    return f"(NOT ends_with(trim({lo}, ' ' || chr(10) || chr(9)), '?') AND NOT {begins(L.INTERROGATIVE)} AND len({words(lo)}) >= 6 AND NOT {any_of(lo, L.HEDGE_WORDS)} AND {asserts})"


def citation(x: str) -> str:
    lo = low(x)
    after = f"substr({lo}, strpos({lo}, 'as ') + 3)"
    name = f"trim(left({after}, strpos({after}, v_) - 1), ' ' || chr(10) || chr(9))"
    named = f"(list_transform(list_filter({strings(L.CITATION_VERBS)}, lambda v_: contains({lo}, 'as ') AND strpos({after}, v_) BETWEEN 2 AND 41 AND length({name}) >= 3 AND NOT contains({name}, '?')), lambda v_: 'as ' || {name} || v_))[1]"
    before = f"coalesce(({words(f'left({lo}, strpos({lo}, v_) - 1)')})[-1], '')"
    told = f"(list_transform(list_filter({strings(L.HELD_THAT)}, lambda v_: strpos({lo}, v_) > 1 AND length({before}) >= 3), lambda v_: {before} || v_))[1]"
    return f"coalesce({first_of(lo, L.AUTHORITY)}, {named}, {told})"


def justification(x: str, least: int = 10) -> str:
    lo = low(x)
    after = f"substr({lo}, strpos({lo}, m_) + length(m_))"
    return f"(NOT {any_of(lo, L.NO_MERIT)} AND len(list_filter({strings(L.MERIT)}, lambda m_: contains({lo}, m_) AND len({words(after)}) >= {least})) > 0)"


def claim(x: str) -> str:
    parts = f"list_filter(string_split_regex({x}, '[.!?;]'), lambda s_: s_ <> '')"
    cites = f"list_filter({parts}, lambda s_: {any_of(low('s_'), L.AUTHORITY)} OR {any_of(low('s_'), L.CITATION_VERBS)})"
    found = f"coalesce(trim(({cites})[1], ' ' || chr(10) || chr(9)), {x})"
    return f"CASE WHEN length({found}) > 120 THEN left({found}, 120) || '...' ELSE {found} END"


def topic_totals(k: str) -> list[str]:
    weighted = lambda t: f"list_sum(list_transform({k}, lambda w_: coalesce(map {{{', '.join(f'{lit(w)}: {x}::DOUBLE' for w, x in L.TOPICS[t].items())}}}[w_], 0.0::DOUBLE)))"
    return [f"coalesce({weighted(t)}, 0.0::DOUBLE)" for t in sorted(L.TOPICS)]


#: The seeded turns: conv_id, turn_number, speaker, raw_text and its lowered form.
PLAIN = "plain AS (SELECT conv_id, (turn + 1)::INTEGER AS turn_number, role AS speaker, coalesce(text, '') AS raw_text FROM conversations)"
TURNS = f"turns AS (SELECT conv_id, turn_number, speaker, raw_text || ' ' || ({strings(L.SEEDS)})[((conv_id % {len(L.THEMES)}) * 8 + (turn_number - 1) % 8)::INTEGER + 1] AS raw_text FROM plain)"
LOW = f"lowt AS (SELECT *, {low('raw_text')} AS low, lower(raw_text) AS plain_, lower(speaker) = 'assistant' AS said FROM turns)"


def base(*more: str) -> str:
    return "WITH " + ",\n".join([PLAIN, TURNS, LOW, *more])
