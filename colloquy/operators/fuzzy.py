"""Fuzzy scoring as one column: memberships, least for AND, weighted, greatest over rules, centroid.

The centroid is taken over 201 points of the output's range; where no rule fires the score is null.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Shape = tuple[float, ...]


@dataclass(frozen=True)
class FuzzySet:
    """Terms of each input and of the output, as triangles (a, b, c) or trapezoids (a, b, c, d), and rules (conditions, term, weight)."""

    inputs: Mapping[str, Mapping[str, Shape]]
    output: Mapping[str, Shape]
    rules: tuple[tuple[Mapping[str, str], str, float], ...]
    low: float = 0.0
    high: float = 1.0


def _grid(first: tuple[str, tuple[str, ...]], second: tuple[str, tuple[str, ...]], terms: str) -> tuple[tuple[dict[str, str], str, float], ...]:
    """Rules for every pair of terms of two inputs; the output terms row by row."""
    pairs = [(a, b) for a in first[1] for b in second[1]]
    return tuple(({first[0]: a, second[0]: b}, t, 1.0) for (a, b), t in zip(pairs, terms.split(), strict=True))


# The shapes and rules of each set.
_SEVERITY = {"none": (0.0, 0.0, 0.02, 0.08), "low": (0.05, 0.2, 0.4), "medium": (0.3, 0.5, 0.7), "high": (0.6, 0.8, 0.95), "critical": (0.85, 0.95, 1.0, 1.0)}
_INHIBITION = {"none": (0.0, 0.0, 0.05, 0.15), "weak": (0.05, 0.25, 0.45), "moderate": (0.3, 0.5, 0.7), "strong": (0.55, 0.75, 0.95), "full": (0.85, 0.95, 1.0, 1.0)}
URGENCY = FuzzySet(
    {
        "urgency": {"low": (0.0, 0.0, 0.15, 0.35), "moderate": (0.2, 0.45, 0.7), "high": (0.55, 0.75, 1.0, 1.0)},
        "complexity": {"simple": (0.0, 0.0, 0.2, 0.4), "moderate": (0.25, 0.5, 0.75), "complex": (0.6, 0.8, 1.0, 1.0)},
        "formality": {"informal": (0.0, 0.0, 0.3, 0.55), "moderate": (0.35, 0.55, 0.75), "formal": (0.6, 0.8, 1.0, 1.0)},
    },
    {"suppress": (0.0, 0.0, 0.1, 0.25), "low": (0.1, 0.25, 0.4), "moderate": (0.3, 0.5, 0.7), "high": (0.6, 0.75, 0.9), "full": (0.8, 0.9, 1.0, 1.0)},
    (
        *_grid(("urgency", ("high", "moderate", "low")), ("formality", ("formal", "moderate", "informal")), "full high moderate high moderate low moderate low suppress"),
        ({"complexity": "complex", "urgency": "moderate"}, "high", 1.0), ({"complexity": "complex", "urgency": "low"}, "moderate", 1.0),
    ),
)
ANCHORING = FuzzySet(
    {"shift": {"very_close": (0.0, 0.0, 0.03, 0.08), "close": (0.03, 0.07, 0.12), "moderate": (0.08, 0.12, 0.18), "far": (0.14, 0.2, 1.0, 1.0)}},
    _SEVERITY,
    (({"shift": "very_close"}, "critical", 1.0), ({"shift": "close"}, "high", 1.0), ({"shift": "moderate"}, "medium", 1.0), ({"shift": "far"}, "none", 1.0)),
)
CALIBRATION = FuzzySet(
    {"ece": {"low": (0.0, 0.0, 0.25, 0.45), "moderate": (0.3, 0.5, 0.7), "high": (0.55, 0.75, 1.0, 1.0)}},
    _SEVERITY,
    (({"ece": "high"}, "critical", 1.0), ({"ece": "moderate"}, "medium", 1.0), ({"ece": "low"}, "none", 1.0)),
)
CONTRADICTION = FuzzySet(
    {
        "overlap": {"low": (0.0, 0.0, 0.2, 0.4), "moderate": (0.25, 0.5, 0.75), "high": (0.6, 0.8, 1.0, 1.0)},
        "strength": {"weak": (0.0, 0.0, 0.2, 0.4), "moderate": (0.25, 0.5, 0.75), "strong": (0.6, 0.8, 1.0, 1.0)},
    },
    _SEVERITY,
    _grid(("overlap", ("high", "moderate", "low")), ("strength", ("strong", "moderate", "weak")), "critical high medium high medium low medium low none"),
)
SUNK_COST = FuzzySet(
    {
        "confidence": {"low": (0.0, 0.0, 0.3, 0.5), "moderate": (0.35, 0.55, 0.75), "high": (0.6, 0.8, 1.0, 1.0)},
        "gap": {"adjacent": (0.0, 0.0, 1.0, 3.0), "nearby": (2.0, 5.0, 10.0), "distant": (7.0, 12.0, 20.0, 20.0)},
    },
    _SEVERITY,
    _grid(("confidence", ("high", "moderate", "low")), ("gap", ("adjacent", "nearby", "distant")), "critical high medium high medium low medium low none"),
)
EVIDENCE_GATE = FuzzySet(
    {
        "confidence": {"low": (0.0, 0.0, 0.3, 0.55), "medium": (0.35, 0.55, 0.75), "high": (0.6, 0.8, 1.0, 1.0)},
        "corroboration": {"none": (0.0, 0.0, 0.05, 0.2), "weak": (0.05, 0.25, 0.5), "strong": (0.3, 0.6, 1.0, 1.0)},
    },
    _INHIBITION,
    _grid(("confidence", ("low", "medium", "high")), ("corroboration", ("none", "weak", "strong")), "full strong moderate strong moderate weak moderate weak none"),
)
FORMALITY_GATE = FuzzySet(
    {"formality": {"informal": (0.0, 0.0, 0.4, 0.7), "moderate": (0.4, 0.65, 0.9), "formal": (0.7, 0.9, 1.0, 1.0)}},
    _INHIBITION,
    (({"formality": "informal"}, "strong", 1.0), ({"formality": "moderate"}, "weak", 1.0), ({"formality": "formal"}, "none", 1.0)),
)
SEVERITY_GATE = FuzzySet(
    {
        "severity": {"low": (0.0, 0.0, 0.5, 1.5), "medium": (0.5, 1.5, 2.5), "high": (1.5, 2.5, 3.0, 3.0)},
        "urgency": {"low": (0.0, 0.0, 0.15, 0.4), "moderate": (0.2, 0.5, 0.8), "high": (0.6, 0.85, 1.0, 1.0)},
    },
    _INHIBITION,
    _grid(("severity", ("low", "medium", "high")), ("urgency", ("low", "moderate", "high")), "full strong moderate moderate weak none weak none none"),
)
ARBITRATION = FuzzySet(
    {
        "severity": {"low": (0.0, 0.0, 0.2, 0.4), "moderate": (0.25, 0.5, 0.75), "high": (0.6, 0.8, 1.0, 1.0)},
        "density": {"sparse": (0.0, 0.0, 0.15, 0.35), "moderate": (0.2, 0.45, 0.7), "dense": (0.55, 0.75, 1.0, 1.0)},
        "inhibited": {"low": (0.0, 0.0, 0.2, 0.45), "moderate": (0.3, 0.5, 0.7), "high": (0.55, 0.8, 1.0, 1.0)},
    },
    {"healthy": (0.0, 0.0, 0.1, 0.25), "mild": (0.15, 0.3, 0.45), "concerning": (0.35, 0.5, 0.7), "serious": (0.55, 0.75, 0.9), "critical": (0.8, 0.9, 1.0, 1.0)},
    (
        *_grid(("severity", ("high", "moderate", "low")), ("density", ("dense", "moderate", "sparse")), "critical serious concerning serious concerning mild concerning mild healthy"),
        ({"inhibited": "high", "severity": "moderate"}, "mild", 1.0), ({"inhibited": "high", "severity": "low"}, "healthy", 1.0), ({"inhibited": "low", "density": "dense"}, "critical", 1.0),
    ),
)
COMPOUND = FuzzySet(
    {
        "n": {"low": (0.0, 0.0, 0.15, 0.35), "medium": (0.2, 0.45, 0.7), "high": (0.55, 0.75, 1.0, 1.0)},
        "severity": {"low": (0.0, 0.0, 0.25, 0.45), "medium": (0.3, 0.55, 0.75), "high": (0.6, 0.8, 1.0, 1.0)},
        "confidence": {"low": (0.0, 0.0, 0.25, 0.45), "medium": (0.3, 0.5, 0.7), "high": (0.55, 0.75, 1.0, 1.0)},
    },
    {"nominal": (0.0, 0.0, 0.1, 0.3), "moderate": (0.2, 0.4, 0.6), "elevated": (0.5, 0.7, 0.85), "critical": (0.75, 0.9, 1.0, 1.0)},
    (
        ({"n": "high", "severity": "high"}, "critical", 1.0), ({"n": "high", "severity": "medium"}, "elevated", 1.0), ({"n": "medium", "confidence": "high"}, "elevated", 1.0), ({"n": "medium", "severity": "high"}, "elevated", 1.0),
        ({"n": "low", "severity": "high"}, "moderate", 1.0), ({"n": "low", "confidence": "low"}, "nominal", 1.0), ({"n": "low"}, "nominal", 0.7),
    ),
)


def corners(shape: Shape) -> tuple[float, float, float, float]:
    return shape if len(shape) == 4 else (shape[0], shape[1], shape[1], shape[2])


def membership(x: Column, shape: Shape) -> Column:
    """Of a triangle or a trapezoid."""
    a, b, c, d = corners(shape)
    rise = F.lit(1.0) if a == b else (x - a) / F.lit(b - a)
    fall = F.lit(1.0) if c == d else (d - x) / F.lit(d - c)
    return F.when((x < a) | (x > d), F.lit(0.0)).when(x < b, rise).when(x <= c, F.lit(1.0)).otherwise(fall)


def _shape_at(x: float, shape: Shape) -> float:
    a, b, c, d = corners(shape)
    if x < a or x > d:
        return 0.0
    return (x - a) / (b - a) if x < b else 1.0 if x <= c else (d - x) / (d - c)


def fuzzy_score(inputs: Mapping[str, Column], rules: FuzzySet = COMPOUND, points: int = 201) -> Column:
    """Centroid of the rules' aggregated output terms."""
    strength: dict[str, Column] = {}
    for conditions, term, weight in rules.rules:
        parts = [membership(inputs[v], rules.inputs[v][t]) for v, t in conditions.items()]
        fires = (F.least(*parts) if len(parts) > 1 else parts[0]) * F.lit(weight)
        strength[term] = F.greatest(strength[term], fires) if term in strength else fires
    names = sorted(strength)
    # What a term is at a point is fixed; only its cut changes by row. One constant array for each term.
    at = [rules.low + (rules.high - rules.low) * i / (points - 1) for i in range(points)]
    heights = [F.from_json(F.lit(str([_shape_at(x, rules.output[t]) for x in at])), "array<double>") for t in names]
    grid = F.arrays_zip(F.from_json(F.lit(str(at)), "array<double>").alias("x"), *[h.alias(t) for h, t in zip(heights, names)])

    def score(cuts: Column) -> Column:
        def add(state: Column, p: Column) -> Column:
            m = [F.least(cuts[t], p[t]) for t in names]
            height = F.greatest(*m) if len(m) > 1 else m[0]
            return F.struct((state["num"] + height * p["x"]).alias("num"), (state["den"] + height).alias("den"))

        return F.aggregate(grid, F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den")), add, lambda s: F.try_divide(s["num"], s["den"]))

    return F.get(F.transform(F.array(F.struct(*[strength[t].alias(t) for t in names])), score), F.lit(0))
