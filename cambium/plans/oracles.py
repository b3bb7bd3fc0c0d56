"""DuckDB SQL for the wood-anatomy queries, written independently of their plans."""

from __future__ import annotations

from cambium.functions import expr as X

from . import adapters

K = "image_label, year"


def r(expression: str, name: str) -> str:
    """The expression to its significant digits, a hair above ties."""
    return f"((({expression})::DOUBLE * {X.OFF_TIES!r})::FLOAT::DOUBLE + 0.0) AS {name}"


def _bin(c: str, bins: int) -> str:
    """Right-closed bins of [0, 100]; written off the edges."""
    edges = " + ".join(f"CASE WHEN {c} > {k * (100 / bins)!r} THEN 1 ELSE 0 END" for k in range(1, bins))
    return f"CASE WHEN {c} > 100 AND {c} <= 101 THEN {bins} WHEN {c} BETWEEN 0 AND 100 THEN 1 + {edges} END"


SECTOR100 = "CASE WHEN rraddistr > 100 AND rraddistr <= 101 THEN 100 WHEN rraddistr BETWEEN 0 AND 100 THEN greatest(cast(ceil(rraddistr) AS int), 1) END"
WALL = "(CASE WHEN rtsr IS NULL THEN NULL WHEN rtsr < 1 THEN pow(sqrt(la / pi()) + cwttan, 2) * pi() - la ELSE pow(sqrt(la / pi()) + cwtall, 2) * pi() - la END)"

MEASURED = f"""measured AS (
  SELECT c.*, g.mrw, la + cwa AS tca, cwtrad / nullif(drad, 0) AS rwd2, {WALL} / nullif(la + {WALL}, 0) AS dcwt,
    rraddistr * g.mrw / 100 AS raddistr_st, CASE WHEN rtsr IS NULL THEN NULL WHEN rtsr < 1 THEN cwttan ELSE cwtall END AS cwtall_adj,
    drad + 2 * cwttan AS cdrad, dtan + 2 * cwtrad AS cdtan, (drad + 2 * cwttan) / nullif(dtan + 2 * cwtrad, 0) AS cdratio,
    {SECTOR100} AS sector100
  FROM cells c LEFT JOIN (SELECT {K}, mrw FROM rings) g USING ({K})
)"""
BOUNDARY = f"""sectors AS (
  SELECT {K}, sector100, avg(rtsr) AS rtsr, avg(mrw) AS mrw FROM measured WHERE rtsr IS NOT NULL AND mrw IS NOT NULL GROUP BY ALL
), rolled AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {K}) AS n,
    avg(rtsr) OVER (PARTITION BY {K} ORDER BY sector100 NULLS LAST ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mid
  FROM sectors WINDOW w AS (PARTITION BY {K} ORDER BY sector100 NULLS LAST)
), limits AS (
  SELECT {K}, coalesce(max(sector100) FILTER (WHERE (CASE WHEN rn <= 4 THEN NULL WHEN n - rn < 4 THEN 10 ELSE mid END) <= 1), '-Infinity'::DOUBLE) AS max_ew_sector, avg(mrw) AS mrw
  FROM rolled GROUP BY ALL
), boundary AS (
  SELECT {K}, max_ew_sector, CASE WHEN max_ew_sector >= 0 THEN max_ew_sector * mrw / 100 ELSE 0.0 END AS eww,
    mrw - CASE WHEN max_ew_sector >= 0 THEN max_ew_sector * mrw / 100 ELSE 0.0 END AS lww
  FROM limits
)"""
LOG = f"""raw_log AS (
  SELECT coalesce(a.image_label, b.image_label) AS image_label, coalesce(a.year, b.year) AS year, a.cno AS n_cells, mean_cwttan, b.* EXCLUDE ({K})
  FROM (SELECT {K}, count(*)::INT AS cno, avg(cwttan) AS mean_cwttan FROM cells GROUP BY ALL) a FULL JOIN rings b ON a.image_label = b.image_label AND a.year = b.year
), log AS (
  SELECT * EXCLUDE (n_cells) REPLACE (
      coalesce(last_value(woodpiece_label IGNORE NULLS) OVER d, first_value(woodpiece_label IGNORE NULLS) OVER u) AS woodpiece_label,
      coalesce(last_value(slide_label IGNORE NULLS) OVER d, first_value(slide_label IGNORE NULLS) OVER u) AS slide_label
    ), coalesce(n_cells, 0) AS cno
  FROM raw_log WINDOW d AS (PARTITION BY image_label ORDER BY n_cells IS NULL, year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    u AS (PARTITION BY image_label ORDER BY n_cells IS NULL, year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)"""
YEARS = f"""spans AS (SELECT image_label, min(year) AS lo, max(year) AS hi FROM log GROUP BY 1),
gaps AS (
  SELECT image_label, y::INT AS year FROM (SELECT image_label, unnest(generate_series(lo, hi)) AS y FROM spans)
  WHERE (image_label, y) NOT IN (SELECT (image_label, year) FROM log)
), all_years AS (
  SELECT woodpiece_label, slide_label, image_label, year, cno, FALSE AS missing_year FROM log
  UNION ALL SELECT NULL, NULL, image_label, year, 0, TRUE FROM gaps
), years AS (
  SELECT * REPLACE (
    coalesce(last_value(woodpiece_label IGNORE NULLS) OVER d, first_value(woodpiece_label IGNORE NULLS) OVER u) AS woodpiece_label,
    coalesce(last_value(slide_label IGNORE NULLS) OVER d, first_value(slide_label IGNORE NULLS) OVER u) AS slide_label)
  FROM all_years WINDOW d AS (PARTITION BY image_label ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    u AS (PARTITION BY image_label ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)"""
INNER = f"""ends AS (
  SELECT *, year = min(year) OVER (PARTITION BY image_label) AS innermost_ring, year = max(year) OVER (PARTITION BY image_label) AS outermost_ring FROM log
), spots AS (
  SELECT e.image_label, e.year, xpix, ypix, raddistr, spatial_resolution AS res, ypix - raddistr * spatial_resolution AS border,
    row_number() OVER (PARTITION BY e.image_label ORDER BY xpix NULLS LAST, ypix NULLS LAST, raddistr NULLS LAST) AS pos,
    count(*) OVER p AS n, count(xpix) OVER p AS n_x, avg(raddistr / nullif(ypix, 0)) OVER p AS scal
  FROM (SELECT DISTINCT {K} FROM ends WHERE innermost_ring) e LEFT JOIN cells c ON c.image_label = e.image_label AND c.year = e.year
    LEFT JOIN (SELECT image_label, spatial_resolution FROM meta) m ON m.image_label = e.image_label
  WINDOW p AS (PARTITION BY e.image_label)
), sized AS (
  SELECT *, ypix - raddistr / nullif(scal, 0) AS border2, greatest(round_even(n / 10, 0), 1) AS left_end, round_even(n / 10 * 9, 0) AS right_start,
    greatest(round_even(n / 50, 0), 5)::BIGINT AS k
  FROM spots
), tiled AS (
  SELECT *, CASE WHEN xpix IS NOT NULL THEN CASE WHEN pos <= (n_x % k) * (n_x // k + 1) THEN (pos - 1) // (n_x // k + 1) + 1
    ELSE (pos - (n_x % k) * (n_x // k + 1) - 1) // greatest(n_x // k, 1) + n_x % k + 1 END END AS tile
  FROM sized
), lowest AS (SELECT *, min(ypix) OVER (PARTITION BY {K}, tile) AS low FROM tiled),
stats AS (
  SELECT {K}, avg(abs(border / res)) AS mae,
    quantile_cont(border, 0.5) FILTER (WHERE pos <= left_end) / any_value(res) AS "medYleft",
    quantile_cont(border, 0.5) FILTER (WHERE pos >= right_start) / any_value(res) AS "medYright",
    quantile_cont(border2, 0.5) * any_value(scal) AS rp,
    quantile_cont(border2, 0.5) FILTER (WHERE pos <= left_end) * any_value(scal) AS rp10,
    quantile_cont(border2, 0.5) FILTER (WHERE pos >= right_start) * any_value(scal) AS rp90,
    min(border) FILTER (WHERE ypix = low) / any_value(res) AS mindist, max(n_x) AS n_x
  FROM lowest GROUP BY ALL
), inner_stats AS (
  SELECT *, CASE WHEN n_x = 0 THEN TRUE ELSE rp <= 10 AND abs(rp90 - rp10) <= 10 END AS incomplete_inner,
    CASE WHEN n_x = 0 OR coalesce(mae > 20 AND mae < 75 AND mindist > 100, FALSE) THEN TRUE ELSE mae < 20 AND abs("medYleft" - "medYright") < 15 END AS incomplete_innerv2
  FROM stats
), incomplete AS (
  SELECT e.*, mae, "medYleft", "medYright", mindist, incomplete_inner, incomplete_innerv2,
    coalesce((outermost_ring AND mrw IS NULL) OR incomplete_inner, FALSE) AS incomplete_ring, incomplete_inner <> incomplete_innerv2 AS incomplete_fct_check
  FROM ends e LEFT JOIN inner_stats s ON s.image_label = e.image_label AND s.year = e.year
), missing AS (SELECT *, cno < 5 OR coalesce(mrw < 10, FALSE) AS missing_ring FROM incomplete),
ranked AS (
  SELECT *, count(*) OVER g > 1 AS duplicate_ring,
    row_number() OVER (PARTITION BY woodpiece_label, year ORDER BY cno DESC, image_label) + (CASE WHEN missing_ring THEN 100 ELSE 0 END) + (CASE WHEN incomplete_ring THEN 100 ELSE 0 END) AS rk
  FROM missing WINDOW g AS (PARTITION BY woodpiece_label, year)
), valid AS (
  SELECT *, duplicate_ring AND rk <> min(rk) OVER (PARTITION BY woodpiece_label, year) AS exclude_dupl, incomplete_ring OR missing_ring AS exclude_issues FROM ranked
)"""
CHOSEN = """placed AS (
  SELECT *, CASE WHEN duplicate_ring THEN row_number() OVER (PARTITION BY woodpiece_label, year ORDER BY cno DESC, image_label) + CASE WHEN missing_ring OR incomplete_ring THEN 100 ELSE 0 END END AS duplicate_rank FROM valid
), chosen AS (
  SELECT *, CASE WHEN duplicate_ring THEN duplicate_rank = min(duplicate_rank) OVER (PARTITION BY woodpiece_label, year) END AS duplicate_sel FROM placed
)"""
PARAMS = ["la", "cwttan", "drad"]
SERIES = f"""prf AS (SELECT {K}, {_bin("rraddistr", 5)} AS sector_n, avg(la) AS la_mean FROM cells GROUP BY ALL),
series AS (
  SELECT v.woodpiece_label, v.image_label, v.year, exclude_issues, CASE WHEN exclude_issues THEN NULL ELSE la_mean END AS la_mean
  FROM valid v LEFT JOIN (SELECT * FROM prf WHERE sector_n = 2) p ON p.image_label = v.image_label AND p.year = v.year
  WHERE NOT exclude_dupl
)"""
EDITED = """picked AS (SELECT image_label, year, exclude_issues FROM valid WHERE year % 4 = 0 AND image_label LIKE '%3'),
edited AS (
  SELECT v.* EXCLUDE (exclude_issues), CASE WHEN p.image_label IS NOT NULL THEN NOT v.exclude_issues ELSE v.exclude_issues END AS exclude_issues,
    CASE WHEN p.image_label IS NULL THEN NULL WHEN v.year = 2000 THEN 'twice' ELSE 'checked' END AS comment
  FROM valid v LEFT JOIN picked p ON p.image_label = v.image_label AND p.year = v.year
)"""


def _profiles(bins: int, probs: list[float]) -> str:
    cols = [r(f"avg({p})", f"{p}_mean") for p in PARAMS]
    cols += [r(f"quantile_cont({p}, {q})", f"{p}_q{q * 100:g}") for p in PARAMS for q in probs]
    return f"SELECT {K}, sector_n, {', '.join(cols)} FROM (SELECT *, {_bin('rraddistr', bins)} AS sector_n FROM cells) WHERE sector_n IS NOT NULL GROUP BY {K}, sector_n"


def _negatives(table: str, columns: list[str], name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (WHERE {c} < 0) AS value, '{name}' AS tbl FROM {table}" for c in columns)


def views(*ctes: str) -> str:
    """WITH the adapter's views and more of them."""
    return "WITH " + ", ".join([adapters.oracle_views(), *ctes]) + " "


_with = views


def oracle_sql() -> dict[str, str]:
    from cambium.operators.model import CELL_MEASURES, RING_MEASURES

    log, inner, full = _with(LOG), _with(LOG, INNER), _with(LOG, INNER, CHOSEN)
    ring_cols = ["ra", "mrw", "rvgi", "rvsf", "rgsgv", "aoiar", "dh_w", "dh_m"]
    levels = [
        ("site", ["site_label"], "tree_label"),
        ("tree", ["site_label", "species_code", "tree_label"], "woodpiece_label"),
        ("woodpiece", ["tree_label", "woodpiece_label"], "slide_label"),
        ("slide", ["woodpiece_label", "slide_label"], "image_label"),
    ]
    distinct = lambda c: f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END"
    counts = " UNION ALL ".join(
        f"SELECT '{n}' AS level, concat_ws('/', {', '.join(f"coalesce({k}, '-')" for k in keys)}) AS entity, {distinct(c)} AS n FROM meta GROUP BY {', '.join(keys)}" for n, keys, c in levels
    )
    tests = {
        "null woodpiece_label": "woodpiece_label IS NULL", "null slide_label": "slide_label IS NULL", "null image_label": "image_label IS NULL", "null year": "year IS NULL",
        "null incomplete_ring": "incomplete_ring IS NULL", "null missing_ring": "missing_ring IS NULL", "null duplicate_ring": "duplicate_ring IS NULL",
        "rank of duplicates": "duplicate_ring <> (duplicate_rank IS NOT NULL AND duplicate_sel IS NOT NULL)",
    }
    names = """names AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN concat('scan ', p_partkey)
      WHEN p_partkey % 3 = 0 THEN printf('dir/SITE%d_PISY_%02d_%d_%d.jpg', p_partkey % 5, p_partkey % 90, p_partkey % 7, p_partkey)
      ELSE printf('SITE%d_PCAB_%02d%s_%d_%d.jpg', p_partkey % 5, p_partkey % 90, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'AB' END, p_partkey % 7, p_partkey) END AS name FROM part)"""
    short = lambda c, up: f"CASE WHEN starts_with({c}, {up} || '_') THEN substr({c}, length({up}) + 2) WHEN {c} = {up} THEN '' ELSE {c} END"
    named = lambda e: f"CASE WHEN coalesce({e}, '') = '' THEN '(n.a.)' ELSE {e} END"
    pairs = [("tree_label", "site_label"), ("woodpiece_label", "tree_label"), ("slide_label", "woodpiece_label"), ("image_label", "slide_label")]
    return {
        "outlier_counts": _with() + f"SELECT name, value::BIGINT AS value, tbl FROM ({_negatives('raw_cells', CELL_MEASURES, 'cells')} UNION ALL {_negatives('raw_rings', RING_MEASURES, 'rings')}) WHERE value > 0",
        "remove_outliers": _with() + f"SELECT {K}, xpix, ypix, {', '.join(r(c, c) for c in CELL_MEASURES)} FROM cells",
        "cell_measures": _with(MEASURED) + f"SELECT {K}, xpix, ypix, sector100, {', '.join(r(c, c) for c in ['tca', 'rwd2', 'dcwt', 'raddistr_st', 'cwtall_adj', 'cdrad', 'cdtan', 'cdratio'])} FROM measured",
        "ewlw_boundary": _with(MEASURED, BOUNDARY) + f"SELECT {K}, max_ew_sector + 0.0 AS max_ew_sector, {r('eww', 'eww')}, {r('lww', 'lww')} FROM boundary",
        "ewlw_rings": _with(MEASURED, BOUNDARY) + f"SELECT woodpiece_label, slide_label, {K}, {', '.join(r(c, c) for c in ring_cols)}, {r('eww', 'eww')}, {r('lww', 'lww')} FROM rings LEFT JOIN boundary USING ({K})",
        "ewlw_cells_summary": _with(MEASURED, BOUNDARY) + f"SELECT {K}, ew_lw, count(*) AS n, {r('avg(tca)', 'mean_tca')} FROM (SELECT m.*, CASE WHEN sector100 IS NULL OR max_ew_sector IS NULL THEN NULL WHEN sector100 <= max_ew_sector THEN 'EW' ELSE 'LW' END AS ew_lw FROM measured m LEFT JOIN boundary USING ({K})) GROUP BY {K}, ew_lw",
        "rings_log": log + f"SELECT woodpiece_label, slide_label, {K}, cno, {r('mean_cwttan', 'mean_cwttan')}, {r('mrw', 'mrw')}, {r('ra', 'ra')} FROM log",
        "cwt_check": log + "SELECT image_label FROM log GROUP BY 1 HAVING count(mean_cwttan) = 0",
        "complete_years": _with(LOG, YEARS) + f"SELECT woodpiece_label, slide_label, {K}, cno, missing_year FROM years",
        "dating_issues": _with(LOG, YEARS) + f"""SELECT {K}, issues FROM (SELECT {K}, concat_ws(', ', CASE WHEN missing_year THEN 'missing' END, CASE WHEN row_number() OVER (PARTITION BY {K} ORDER BY cno) > 1 THEN 'duplicate' END,
            CASE WHEN year > 2001 THEN 'in future' END, CASE WHEN year > outmost_year THEN 'after outmost' END) AS issues FROM years LEFT JOIN (SELECT image_label, outmost_year FROM meta) USING (image_label)) WHERE issues <> ''""",
        "innermost_stats": inner + f"""SELECT {K}, {", ".join(r(f'CASE WHEN n_x > 0 THEN "{c}" END', f'"{c}"') for c in ["mae", "medYleft", "medYright", "rp", "rp10", "rp90", "mindist"])}, incomplete_inner, incomplete_innerv2 FROM inner_stats""",
        "incomplete_rings": inner + f"SELECT {K}, innermost_ring, outermost_ring, incomplete_ring, incomplete_fct_check FROM incomplete",
        "validated_rings": inner + f"SELECT woodpiece_label, slide_label, {K}, cno, {', '.join(r(c, c) for c in ring_cols)}, incomplete_ring, missing_ring, duplicate_ring, exclude_dupl, exclude_issues FROM valid",
        "issue_counts": inner + " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS n FROM valid" for f in ["incomplete_ring", "missing_ring", "duplicate_ring", "exclude_dupl", "exclude_issues"]),
        "profiles_mean": _with() + _profiles(7, []),
        "profiles_quantiles": _with() + _profiles(5, [0.25, 0.5, 0.75]),
        "chronology_series": _with(LOG, INNER, SERIES) + f"SELECT woodpiece_label, {K}, exclude_issues, {r('la_mean', 'la_mean')} FROM series",
        "chronology_mean": _with(LOG, INNER, SERIES) + f"SELECT year, {r('avg(la_mean)', 'value')} FROM series WHERE NOT exclude_issues GROUP BY year",
        "chronology_tbrm": _with(LOG, INNER, SERIES) + f""", x AS (SELECT year, la_mean AS v, quantile_cont(la_mean, 0.5) OVER (PARTITION BY year) AS m FROM series WHERE NOT exclude_issues AND la_mean IS NOT NULL),
          y AS (SELECT *, quantile_cont(abs(v - m), 0.5) OVER (PARTITION BY year) AS s FROM x), z AS (SELECT year, v, (v - m) / (9 * s + 1e-6) AS u FROM y)
          SELECT year, {r('sum(w * v) / sum(w)', 'value')} FROM (SELECT year, v, CASE WHEN abs(u) <= 1 THEN pow(1 - u * u, 2) ELSE 0 END AS w FROM z) GROUP BY year""",
        "edited_rings": _with(LOG, INNER, EDITED) + f"SELECT woodpiece_label, {K}, exclude_issues, comment, FALSE AS blue_ring FROM edited",
        "changed_exclusions": _with(LOG, INNER, EDITED) + f"SELECT e.year, {r('e.mrw', 'y')}, e.woodpiece_label FROM edited e JOIN valid v ON v.image_label = e.image_label AND v.year = e.year WHERE NOT e.exclude_dupl AND e.exclude_issues <> v.exclude_issues AND e.woodpiece_label IN ({', '.join(f"'W{i}'" for i in range(12))})",
        "inconsistent_exclusions": _with(LOG, INNER, EDITED) + f"SELECT {K}, concat_ws(', ', CASE WHEN incomplete_ring THEN 'incomplete_ring' END, CASE WHEN missing_ring THEN 'missing_ring' END) AS flags FROM edited WHERE (incomplete_ring OR missing_ring) AND NOT exclude_issues",
        "flag_validation": full + """SELECT (SELECT count(*) FROM (SELECT woodpiece_label, year FROM chosen WHERE duplicate_ring GROUP BY ALL HAVING count(*) FILTER (WHERE duplicate_sel) <> 1)) = 0 AS one_selected,
            (SELECT count(*) FROM chosen WHERE year % 5 = 0 AND year <> 1996) = 0 AS comments_complete, (SELECT count(*) FROM chosen WHERE year % 5 <> 0 AND year = 1996) = 0 AS comments_needed""",
        "ring_table_issues": full + ", c AS (SELECT * REPLACE (CASE WHEN year <> 1999 THEN slide_label END AS slide_label) FROM chosen) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS issue, count(*) FILTER (WHERE {t}) AS n FROM c" for n, t in tests.items()) + f" UNION ALL SELECT 'repeated ring', count(*) FROM (SELECT {K} FROM c GROUP BY ALL HAVING count(*) > 1)) WHERE n > 0",
        "duplicate_selection": full + f"SELECT woodpiece_label, {K}, duplicate_ring, duplicate_rank::INT AS duplicate_rank, duplicate_sel FROM chosen",
        "coverage_table": full + f"""SELECT woodpiece_label, slide_label, {K}, CASE WHEN incomplete_ring THEN year END AS incomplete_ring, CASE WHEN duplicate_ring AND NOT duplicate_sel THEN year END AS duplicate_ring,
            CASE WHEN duplicate_sel THEN year END AS duplicate_sel, CASE WHEN missing_ring THEN year END AS missing_ring, NULL::INT AS other_issues,
            'flags: ' || coalesce(nullif(concat_ws(', ', CASE WHEN incomplete_ring THEN 'incomplete' END, CASE WHEN duplicate_ring AND NOT duplicate_sel THEN 'duplicate' END, CASE WHEN duplicate_sel THEN 'best duplicate' END, CASE WHEN missing_ring THEN 'missing' END), ''), 'none') AS labels FROM chosen""",
        "coverage_limits": inner + "SELECT woodpiece_label, (floor(min(year) / 5) * 5)::INT AS min_year, (ceil(max(year) / 5) * 5)::INT AS max_year, least(greatest((max(year) - min(year)) * 75 + 800, 2000), 6000)::INT AS width_px, least(greatest(count(DISTINCT image_label) * 100 + 200, 750), 2000)::INT AS height_px FROM valid GROUP BY 1",
        "hierarchy_counts": _with() + f"SELECT level, entity, n::BIGINT AS n FROM ({counts})",
        "desc_template": _with() + """, a AS (SELECT site_label, coalesce(species_code, 'NA') AS sp, count(DISTINCT tree_label) AS n FROM meta GROUP BY ALL),
          b AS (SELECT site_label, list(n || ' ' || sp || ' tree' || CASE WHEN n > 1 THEN 's' ELSE '' END ORDER BY sp) AS l FROM a GROUP BY 1),
          c AS (SELECT site_label, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END || ' collected at site ' || site_label AS t FROM b),
          d AS (SELECT list(t ORDER BY site_label) AS l FROM c)
          SELECT CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || CASE WHEN len(l) > 2 THEN ', and ' ELSE ' and ' END || l[-1] END AS description FROM d""",
        "structure_from_names": f"""WITH {names}, m AS (SELECT name, nullif(regexp_extract(name, '[A-Za-z0-9]+_[A-Za-z0-9]+_[A-Za-z0-9]{{2}}[A-Za-z0-9]*_[A-Za-z0-9]+_[A-Za-z0-9]+'), '') AS matched FROM names),
          p AS (SELECT *, string_split(matched, '_') AS s FROM m), q AS (SELECT *, concat_ws('_', s[1], s[2], substr(s[3], 1, 2)) AS tree_label, nullif(substr(s[3], 3), '') AS wp FROM p),
          w AS (SELECT *, concat_ws('_', tree_label, wp) AS woodpiece_label FROM q)
          SELECT name, matched, s[1] AS site_label, s[2] AS species_code, CASE WHEN matched IS NOT NULL THEN tree_label END AS tree_label, CASE WHEN matched IS NOT NULL THEN woodpiece_label END AS woodpiece_label, CASE WHEN matched IS NOT NULL THEN concat_ws('_', woodpiece_label, s[4]) END AS slide_label, CASE WHEN matched IS NOT NULL THEN concat_ws('_', woodpiece_label, s[4], s[5]) END AS image_label FROM w""",
        "structure_paths": _with() + f"SELECT image_label, concat_ws('/', 'demo', {named('site_label')}, {', '.join(named(short(c, up)) for c, up in pairs)}) AS path FROM meta",
        "settings_pivot": """WITH s AS (SELECT o_orderkey - o_orderkey % 9 AS file, [8, 10, 12, 13, 17, 18, 20, 31, 999][o_orderkey % 9 + 1] AS rnum, o_custkey AS c FROM orders),
          t AS (SELECT file, rnum, min(CASE rnum WHEN 13 THEN c || ' / ' || (c + 1) WHEN 17 THEN (c % 2)::VARCHAR WHEN 31 THEN (c % 50) || '.7' ELSE (c % 100)::VARCHAR END) AS v FROM s GROUP BY ALL),
          w AS (SELECT file, max(v) FILTER (WHERE rnum = 8) AS a, max(v) FILTER (WHERE rnum = 10) AS b, max(v) FILTER (WHERE rnum = 12) AS c, max(v) FILTER (WHERE rnum = 13) AS d, max(v) FILTER (WHERE rnum = 17) AS e, max(v) FILTER (WHERE rnum = 18) AS f, max(v) FILTER (WHERE rnum = 20) AS g, max(v) FILTER (WHERE rnum = 31) AS h, count(*) FILTER (WHERE rnum <> 999) AS n FROM t GROUP BY 1)
          SELECT 'f' || file AS fname_settings, a AS configuration_file, b AS sw_version, c::DOUBLE AS spatial_resolution, split_part(d, ' / ', 1)::DOUBLE AS origin_calibrated_x, split_part(d, ' / ', 2)::DOUBLE AS origin_calibrated_y,
            CASE e WHEN '1' THEN 'linear' WHEN '0' THEN 'circular' END AS meas_geometry, f::INT AS circ_lower_limit, g::INT AS outmost_year, floor(h::DOUBLE)::INT AS min_cell_area FROM w WHERE n > 0""",
        "name_stem_mismatch": """SELECT stem, missing FROM (SELECT 'stem_' || p_partkey AS stem, concat_ws(', ', CASE WHEN p_partkey % 7 = 0 THEN 'cells' END, CASE WHEN p_partkey % 11 = 0 THEN 'rings' END, CASE WHEN p_partkey % 13 = 0 THEN 'settings' END, CASE WHEN p_partkey % 17 = 0 THEN 'image' END) AS missing FROM part
          WHERE p_partkey % 7 <> 0 OR p_partkey % 11 <> 0 OR p_partkey % 13 <> 0 OR p_partkey % 17 <> 0) WHERE missing <> ''""",
        "align_schema": f"SELECT c_custkey::INT AS c_custkey, c_name, {r('c_acctbal', 'c_acctbal')}, NULL::INT AS c_mktsegment, NULL::VARCHAR AS region FROM customer",
        "column_violations": """SELECT 'customers' AS tbl, field, CASE WHEN lower(message) LIKE '%invalid%' THEN 'warning' ELSE 'error' END AS severity, message FROM (
            SELECT 'c_custkey' AS field, CASE WHEN bool_or(c_custkey < 1 OR c_custkey > 1000) THEN 'Out of range values' END AS message FROM customer
            UNION ALL SELECT 'c_name', nullif(concat_ws(', ', CASE WHEN bool_or(length(c_name) > 10) THEN 'Invalid lengths' END, CASE WHEN bool_or(NOT starts_with(c_name, 'Customer')) THEN 'Invalid formats' END, CASE WHEN count(c_name) > count(DISTINCT c_name) THEN 'Non-unique values' END), '') FROM customer
            UNION ALL SELECT 'c_acctbal', CASE WHEN bool_or(c_acctbal < 0) THEN 'Out of range values' END FROM customer
            UNION ALL SELECT 'c_mktsegment', CASE WHEN bool_or(c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) THEN 'Invalid options' END FROM customer
            UNION ALL SELECT 'c_nationkey', CASE WHEN count(*) FILTER (WHERE c_nationkey <> 0) > 1 THEN 'Too many checked' END FROM customer) WHERE message IS NOT NULL""",
        "fill_downup": """SELECT event_id, user_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS mark FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 = 1 THEN event_type END AS mark FROM events)""",
        "site_countries": """WITH s AS (SELECT 'C' || c_custkey AS site_label, c_custkey % 59 + 0.25 AS x, c_custkey % 37 + 0.75 AS y FROM customer)
            SELECT site_label, CASE WHEN x BETWEEN 12.5 AND 14 AND y BETWEEN 12.5 AND 15 OR x BETWEEN 17 AND 19.5 AND y BETWEEN 11.5 AND 18 THEN '' WHEN x BETWEEN 11 AND 16 AND y BETWEEN 11 AND 16.5 THEN 'ZZ'
              WHEN x < 50 AND y < 30 THEN chr(65 + floor(x / 10)::INT) || chr(65 + floor(y / 10)::INT) ELSE '' END AS country_code FROM s""",
    }
