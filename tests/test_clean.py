import math

import numpy as np
import pandas as pd
import pytest

from cambium.functions import expr as X
from cambium.operators import clean, flags, profiles
from cambium.operators.model import CELL_MEASURES, RING_MEASURES, Measurements
from pyspark.sql import Window
from pyspark.sql import functions as F


def cells_of(spark, rows):
    """Cells from dicts; absent measures are 1."""
    schema = "image_label string, year int, xpix double, ypix double, " + ", ".join(f"{c} double" for c in CELL_MEASURES)
    names = ["image_label", "year", "xpix", "ypix", *CELL_MEASURES]
    return spark.createDataFrame([tuple(r.get(c, 1.0) for c in names) for r in rows], schema)


def rings_of(spark, rows):
    names = ["woodpiece_label", "slide_label", "image_label", "year", *RING_MEASURES]
    schema = "woodpiece_label string, slide_label string, image_label string, year int, " + ", ".join(f"{c} double" for c in RING_MEASURES)
    return spark.createDataFrame([tuple(r.get(c, "W" if c.endswith("label") else 100.0) for c in names) for r in rows], schema)


def test_sector_edges(spark):
    values = [None, 0.0, 0.5, 1.0, 1.01, 100.0, 100.5, 101.0, 101.5, -1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, r double")
    got = [r[0] for r in df.orderBy("i").select(X.right_closed_bin(F.col("r"), 100)).collect()]
    assert got == [None, 1, 1, 1, 2, 100, 100, 100, None, None]


def test_bins_of_broken_width(spark):
    df = spark.range(0, 1001).select((F.col("id") / 10).alias("r"))
    got = {r["r"]: r["b"] for r in df.select("r", X.right_closed_bin(F.col("r"), 7).alias("b")).collect()}
    edges = [k * (100 / 7) for k in range(1, 7)]
    assert all(b == 1 + sum(r > e for e in edges) for r, b in got.items())


def test_tile_is_ntile(spark):
    for n in (1, 4, 5, 23, 60):
        for k in (1, 3, 5):
            rows = spark.range(1, n + 1).select(X.tile(F.col("id"), F.lit(n), F.lit(k)).alias("t"), F.ntile(k).over(Window.orderBy("id")).alias("w")).collect()
            assert all(r["t"] == r["w"] for r in rows)


def test_outliers(spark):
    values = [-1.0, 0.0, -0.0, math.nan, None, 2.0]
    data = Measurements(cells_of(spark, [{"image_label": "a", "year": 1, "la": v} for v in values]), rings_of(spark, [{"year": 1, "mrw": -5.0}]))
    out = clean.remove_outliers(data)
    assert [r["la"] for r in out.cells.select("la").collect()][:2] == [None, 0.0]
    assert out.rings.first()["mrw"] is None
    assert {r["name"]: r["value"] for r in clean.negative_counts(data.cells, CELL_MEASURES).collect()} == {"la": 1}
    again = clean.remove_outliers(out)
    assert clean.negative_counts(again.cells, CELL_MEASURES).isEmpty()
    with pytest.raises(ValueError):
        clean.without_negatives(data.cells.drop("la"), CELL_MEASURES)


def test_division_by_zero_and_null_ratio(spark):
    data = Measurements(cells_of(spark, [{"image_label": "a", "year": 1, "drad": 0.0, "rtsr": None, "rraddistr": 50.0}]), rings_of(spark, [{"image_label": "a", "year": 1}]))
    r = clean.cell_measures(data.cells, data.rings).first()
    assert r["rwd2"] is None and r["dcwt"] is None and r["cwtall_adj"] is None
    assert r["raddistr_st"] == 50.0 and r["sector100"] == 50


@pytest.mark.parametrize("sectors", [1, 8, 9, 10, 14])
def test_boundary(spark, sectors):
    cells = [{"image_label": "a", "year": 1, "rraddistr": float(s), "rtsr": 0.5} for s in range(1, sectors + 1)]
    data = Measurements(cells_of(spark, cells), rings_of(spark, [{"image_label": "a", "year": 1, "mrw": 200.0}]))
    done = clean.complete_cell_measures(data)
    ring = done.rings.first()
    last = sectors - 4 if sectors >= 9 else 0  # the right end never counts as earlywood
    assert ring["eww"] == pytest.approx(last * 2.0)
    assert ring["eww"] + ring["lww"] == pytest.approx(200.0)
    assert {r["ew_lw"] for r in done.cells.collect()} == ({"EW", "LW"} if last else {"LW"})


def test_ring_without_cells_has_no_boundary(spark):
    data = Measurements(cells_of(spark, [{"image_label": "a", "year": 1, "rtsr": None}]), rings_of(spark, [{"image_label": "a", "year": 1}]))
    done = clean.complete_cell_measures(data)
    assert done.rings.first()["eww"] is None and done.cells.first()["ew_lw"] is None


def test_rings_log_and_dating(spark):
    cells = cells_of(spark, [{"image_label": "a", "year": y} for y in (2000, 2000, 2003)])
    rings = rings_of(spark, [{"woodpiece_label": "P", "slide_label": "S", "image_label": "a", "year": y} for y in (2000, 2001, 2040)])
    meta = spark.createDataFrame([("a", 2010, 1.0)], "image_label string, outmost_year int, spatial_resolution double")
    log = clean.complete_rings_log(Measurements(cells, rings))
    got = {r["year"]: (r["cno"], r["woodpiece_label"]) for r in log.collect()}
    assert got == {2000: (2, "P"), 2001: (0, "P"), 2003: (1, "P"), 2040: (0, "P")}
    issues = {r["year"]: r["issues"] for r in clean.dating_issues(log, meta, 2025).collect()}
    assert issues[2002] == "missing" and issues[2040] == "in future, after outmost" and 2000 not in issues
    with pytest.raises(clean.DatingError):
        clean.assert_dated(log, meta, 2025)


def test_an_absurd_year_is_one_row(spark):
    """A mistyped year makes an interval, not a row for each of two thousand million years."""
    rows = [("a", 1990, 5), ("a", 1992, 1), ("a", 1992, 1), ("a", 2_147_483_647, 1), ("b", None, 1), ("b", 2000, 1), ("b", 2001 + clean.LONG_GAP, 1), (None, 2000, 1), (None, 2002, 1)]
    log = spark.createDataFrame([("P", "S", *r) for r in rows], "woodpiece_label string, slide_label string, image_label string, year int, cno int")
    meta = spark.createDataFrame([("a", 2010, 1.0)], "image_label string, outmost_year int, spatial_resolution double")
    key = lambda r: (str(r[0]), r[1] or 0, r[2])
    assert sorted(map(tuple, clean.year_gaps(log).collect()), key=key) == [(None, 2001, 2001), ("a", 1991, 1991), ("a", 1993, 2_147_483_646), ("b", 2001, 2000 + clean.LONG_GAP)]
    issues = [tuple(r) for r in clean.dating_issues(log, meta, 2025).collect()]
    single = [i for i in issues if i[0] != "b"]
    assert sorted(single, key=key) == [(None, 2001, "missing"), ("a", 1991, "missing"), ("a", 1992, "duplicate"), ("a", 1993, "missing until 2147483646, in future, after outmost"), ("a", 2_147_483_647, "in future, after outmost")]
    assert len(issues) - len(single) == clean.LONG_GAP + 2  # each year of the shorter gap, the undated ring, the one in future
    years = clean.gap_years(clean.year_gaps(log.filter("image_label = 'b'")).selectExpr("image_label", "first", "first + 9999 AS last"))
    assert sorted(r["year"] for r in years.collect()) == list(range(2001, 12001))


def test_commits_rewrite_what_they_touch(spark, tmp_path):
    rings = spark.createDataFrame([(f"w{k % 7}", f"i{k % 300}", 1900 + k // 300, False, None) for k in range(3000)], "woodpiece_label string, image_label string, year int, exclude_issues boolean, comment string")
    at = str(tmp_path / "rings")
    edit = lambda rows: spark.createDataFrame(rows, "image_label string, year int, exclude_issues boolean, comment string, edit_nr int")
    flags.commit_edits(rings, edit([("i1", 1900, True, None, 1)]), at)
    stamps = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "rings").rglob("*.parquet")}
    before = stamps()
    ten = edit([(f"i{k}", 1903, True, f"c{k}", k) for k in range(10)] + [("i3", 1903, False, None, 99), ("nobody", 1, True, None, 5)])
    after = flags.commit_edits(rings, ten, at).collect()
    rewritten = {p.parent.name for p, t in stamps().items() if before.get(p) != t}
    assert 1 <= len(rewritten) <= 11 and len(set(stamps()) & set(before)) >= len(before) - 11  # ten images, and one that isn't there
    got = {(r["image_label"], r["year"]): (r["exclude_issues"], r["comment"]) for r in after}
    assert len(got) == 3000 and got["i1", 1900] == (True, None) and got["i3", 1903] == (False, "c3") and got["i4", 1903] == (True, "c4")
    assert sum(v != (False, None) for v in got.values()) == 11
    assert sorted(flags.commit_edits(rings, ten, at).collect(), key=str) == sorted(after, key=str)


def reference_stats(pdf, res):
    """Innermost statistics of one ring with NumPy, for rings whose xpix differ."""
    pdf = pdf.sort_values("xpix")
    n, y, d = len(pdf), pdf["ypix"].to_numpy(), pdf["raddistr"].to_numpy()
    border = y - d * res
    left, right = max(round(n / 10), 1), round(n / 10 * 9)
    scal = (d / y).mean()
    b2 = y - d / scal
    k = max(round(n / 50), 5)
    groups = np.array_split(np.arange(n), k)
    lows = [border[g][np.argmin(y[g])] for g in groups if len(g)]
    return {
        "mae": np.abs(border / res).mean(), "medYleft": np.median(border[:left]) / res, "medYright": np.median(border[max(right - 1, 0) :]) / res,
        "rp": np.median(b2) * scal, "mindist": min(lows) / res,
    }


@pytest.mark.parametrize("n", [1, 5, 15, 25, 140])
def test_innermost_stats(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"xpix": rng.permutation(n).astype(float), "ypix": rng.permutation(n) + 50.0, "raddistr": rng.uniform(1, 60, n)})
    cells = cells_of(spark, [{"image_label": "a", "year": 1, **r} for r in pdf.to_dict("records")])
    meta = spark.createDataFrame([("a", 2.0)], "image_label string, spatial_resolution double")
    log = clean.complete_rings_log(Measurements(cells, rings_of(spark, [{"image_label": "a", "year": 1}])))
    got = clean.innermost_stats(log, cells, meta).first().asDict()
    for name, value in reference_stats(pdf, 2.0).items():
        assert got[name] == pytest.approx(value), name


def test_innermost_without_positions(spark):
    cells = cells_of(spark, [{"image_label": "a", "year": 1, "xpix": None}])
    meta = spark.createDataFrame([("a", 2.0)], "image_label string, spatial_resolution double")
    log = clean.complete_rings_log(Measurements(cells, rings_of(spark, [{"image_label": "a", "year": 1}, {"image_label": "b", "year": 1}])))
    for r in clean.innermost_stats(log, cells, meta).collect():
        assert r["mae"] is None and r["incomplete_inner"] and r["incomplete_innerv2"]


def test_duplicates(spark):
    rows = [("P", "a", 1, 10, False, False), ("P", "b", 1, 10, False, False), ("P", "c", 1, 30, True, False), (None, "d", 1, 5, True, True), (None, "e", 1, 4, True, True), ("Q", "f", 1, 1, True, True)]
    log = spark.createDataFrame(rows, "woodpiece_label string, image_label string, year int, cno int, missing_ring boolean, incomplete_ring boolean")
    got = {r["image_label"]: (r["duplicate_ring"], r["exclude_dupl"]) for r in clean.flag_duplicate_rings(log).collect()}
    assert got == {"a": (True, False), "b": (True, True), "c": (True, True), "d": (True, False), "e": (True, True), "f": (False, False)}


def biweight(v):
    v = np.array(v)
    m = np.median(v)
    u = (v - m) / (9 * np.median(np.abs(v - m)) + 1e-6)
    w = np.where(np.abs(u) <= 1, (1 - u**2) ** 2, 0)
    return (w * v).sum() / w.sum()


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 3.0, 3.0], [1.0, 2.0, 3.0, 100.0], list(np.random.default_rng(1).normal(10, 2, 40))])
def test_biweight(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in [*values]] + [(1, None), (1, math.nan), (2, None)], "year int, v double")
    got = {r["year"]: r["value"] for r in profiles.biweight(df, ["year"], "v").collect()}
    assert got == {1: pytest.approx(biweight(values))}


def test_profiles(spark):
    cells = cells_of(spark, [{"image_label": "a", "year": 1, "rraddistr": r, "la": v} for r, v in ((1.0, 1.0), (20.0, 2.0), (5.0, 4.0), (9.0, 9.0), (100.5, 7.0), (150.0, 8.0), (None, 3.0))])
    got = {r["sector_n"]: r for r in profiles.calculate_profiles(cells, 5, ["la"], [0.025, 0.5]).collect()}
    assert set(got) == {1, 5}
    assert got[1]["la_mean"] == 4.0 and got[1]["la_q50"] == 3.0 and got[1]["la_q2_5"] == pytest.approx(1.075)
    assert profiles.calculate_profiles(cells, 5, ["la"]).columns == ["image_label", "year", "sector_n", "la_mean"]


def test_edits_and_checks(spark):
    rings = spark.createDataFrame([("P", "s", "a", 1, False, False), ("P", "s", "b", 1, True, True)], "woodpiece_label string, slide_label string, image_label string, year int, exclude_issues boolean, incomplete_ring boolean")
    full = flags.init_flags(rings)
    edits = spark.createDataFrame([("a", 1, 1, True, "x"), ("a", 1, 2, None, "y"), ("zz", 9, 1, True, "none")], "image_label string, year int, edit_nr int, exclude_issues boolean, comment string")
    got = {r["image_label"]: r for r in flags.apply_edits(full, edits).collect()}
    assert got["a"]["exclude_issues"] and got["a"]["comment"] == "y" and len(got) == 2
    assert not got["b"]["blue_ring"] and got["b"]["comment"] is None
    odd = flags.inconsistent_exclusions(full.withColumn("exclude_issues", F.lit(False))).collect()
    assert [(r["image_label"], r["flags"]) for r in odd] == [("b", "incomplete_ring")]


def test_boundary_of_ties_hangs_on_cell_nr_alone(spark):
    """0.2 + 0.8 + 1.3 and 1.3 + 0.8 + 0.2 differ in their last bit, which says whether the mean of nine sectors is at most 1."""

    def limit(values, parts):
        rows = [("a", 1, 5, v, 50.0, k) for k, v in enumerate(values)] + [("a", 1, s, 8.233333333333334 if s == 1 else 0.0, 50.0, 0) for s in (1, 2, 3, 4, 6, 7, 8, 9)]
        df = spark.createDataFrame(rows, "image_label string, year int, sector100 int, rtsr double, mrw double, cell_nr int")
        return clean.wood_boundary(df.orderBy(F.rand(parts)).repartition(parts, "cell_nr")).first()["max_ew_sector"]

    values = [0.2, 0.8, 1.3]
    assert ((0.2 + 0.8 + 1.3) / 3 + 8.233333333333334) / 9 != ((1.3 + 0.8 + 0.2) / 3 + 8.233333333333334) / 9
    for own in (values, values[::-1]):
        at_most = ((own[0] + own[1] + own[2]) / 3 + 8.233333333333334) / 9 <= 1
        assert {limit(own, parts) for parts in (1, 2, 5)} == {5.0 if at_most else -math.inf}


def test_windows_run_once_however_often_the_result_is_read(spark):
    cells = spark.createDataFrame([("a", 2000, 9.0, 1.0, 0.5, 1.0, 1.0, 1.0, 1.0, 1.0, 5.0)], "image_label string, year int, la double, cwa double, rtsr double, cwttan double, cwtall double, cwtrad double, drad double, dtan double, rraddistr double")
    rings = spark.createDataFrame([("a", 2000, 50.0), ("a", 2000, 60.0), ("b", 2000, 7.0)], "image_label string, year int, mrw double")
    done = clean.complete_cell_measures(Measurements(cells, rings))
    for df in (done.cells, done.rings):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    # a cell of a ring that is listed twice is there twice, and a ring without cells stays
    assert done.cells.count() == 2 and done.rings.count() == 3
    assert done.cells.columns[-1] == "ew_lw" and done.rings.columns == ["image_label", "year", "mrw", "eww", "lww"]
