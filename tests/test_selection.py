"""Exact medians by narrowing, against sorting."""

import random
from statistics import median

import pytest

from cambium.operators import profiles, selection


def groups():
    rng = random.Random(6)
    heavy = [rng.choice((1.0, 2.0)) if k % 3 else rng.random() * 9 for k in range(3001)]
    out = {
        "one": [4.5], "two": [1.0, 2.0], "few": [rng.gauss(0, 1) for _ in range(40)], "odd": [rng.gauss(0, 1) for _ in range(2001)], "even": [rng.gauss(0, 1) for _ in range(2000)],
        "same": [7.0] * 1500, "halves": [1.0] * 600 + [2.0] * 600, "heavy": heavy, "wide": [rng.choice((-1, 1)) * 10.0 ** rng.randint(-300, 300) for _ in range(2500)],
        "infinite": [float("inf")] * 400 + [float("-inf")] * 300 + [rng.random() for _ in range(600)], "steps": [float(k // 7) for k in range(4000)], None: [rng.random() for _ in range(900)],
    }
    return out


@pytest.mark.parametrize("most", [30, 400, 100_000])
def test_medians(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "_BROADCAST_ROWS", 0 if most == 30 else 1000)
    known = {k: v for k, v in groups().items() if k is not None}
    rows = [(k, x) for k, v in known.items() for x in v]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = {r["k"]: r["median"] for r in selection.medians(df, ["k"], most).collect()}
    want = {k: 0.5 * sorted(v)[(len(v) - 1) // 2] + 0.5 * sorted(v)[len(v) // 2] for k, v in known.items()}
    assert got == want and want["odd"] == median(known["odd"])


def test_no_large_group_meets_in_one_task(spark, monkeypatch):
    """Whatever is sorted has been narrowed to the bound."""
    seen = []
    joined = selection._joined

    def watched(values, groups_, keys):
        out = joined(values, groups_, keys)
        if groups_.columns == keys:
            seen.append(out.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(selection, "_joined", watched)
    df = spark.range(200_000).selectExpr("1 AS k", "cast(pmod(xxhash64(id), 50000) AS double) AS x").repartition(5)
    got = selection.medians(df, ["k"], 1000).collect()
    xs = sorted(r["x"] for r in df.collect())
    assert [r["median"] for r in got] == [0.5 * xs[99_999] + 0.5 * xs[100_000]] and max(seen) <= 1000


def test_biweight_of_a_hot_year(spark, monkeypatch):
    """The same with narrowing and without."""
    rng = random.Random(2)
    rows = [(2000 if k % 3 else 1990 + k % 7, rng.gauss(10, 3) if k % 50 else 500.0) for k in range(6000)]
    df = spark.createDataFrame(rows, "year int, v double").repartition(6)
    plain = {r["year"]: r["value"] for r in profiles.biweight(df, ["year"], "v").collect()}
    monkeypatch.setattr(selection, "MOST", 60)
    narrowed = {r["year"]: r["value"] for r in profiles.biweight(df, ["year"], "v").collect()}
    assert narrowed == pytest.approx(plain, rel=1e-12)
