"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from colloquy import queries_detectors, queries_findings, queries_live, queries_text

SF = "/root/testdata/sf0.001"
QUERIES = {**queries_text.QUERIES, **queries_detectors.QUERIES}
ORACLE = {**queries_text.ORACLE, **queries_detectors.ORACLE}
QUERIES |= queries_findings.QUERIES | queries_live.QUERIES
ORACLE |= queries_findings.ORACLE | queries_live.ORACLE


def tidy(rows, columns):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = [dict(zip(names, r)) for r in found.fetchall()]
    assert tidy(df.collect(), sorted(names)) == tidy(expected, sorted(names))


@pytest.mark.parametrize("name", ["sunk_cost", "contradiction_kinds", "assumption_surfacer", "evidence_quality", "status_quo_bias", "circular_reasoning", "inherited_position", "sustained_conviction", "negative_claim_confidence"])
def test_detectors_fire_and_stay_silent(spark, name):
    from colloquy.operators import detectors as D
    from colloquy.sources import turns as S

    turns = S.seeded_turns(spark, "/root/testdata/sf0.01")
    found = (D.contradiction if name == "contradiction_kinds" else getattr(D, name))(turns).select("conv_id").distinct().count()
    assert 0 < found < turns.select("conv_id").distinct().count()
