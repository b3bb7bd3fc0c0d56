"""Views that shape the star-schema tables into cells, rings and metadata.

The same SELECTs run on Spark and on DuckDB, so that queries and oracles start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators.model import CELL_MEASURES, CELL_NR, RING_MEASURES, Measurements

#: Cells: lineitem with its supplier; a supplier is an image, its nation a woodpiece.
CELLS = """
SELECT concat('I', l_suppkey) AS image_label, cast(year(l_shipdate) AS int) AS year,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS xpix,
  l_orderkey % 1000 + 1 AS ypix,
  CASE WHEN l_suppkey % 13 = 0 THEN -l_quantity ELSE l_quantity END AS raddistr,
  l_quantity * 2 AS rraddistr,
  cast(l_linenumber AS double) AS nbrno, cast(l_linenumber % 3 AS double) AS nbrid,
  CASE WHEN l_linenumber = 6 AND l_quantity < 5 THEN -1.0 ELSE l_extendedprice / 100 END AS la,
  l_quantity / 10 AS asp, l_quantity / 5 AS majax, l_discount * 3 AS kh,
  l_tax + 1 AS cwtpi, l_tax + 2 AS cwtba, l_tax + 3 AS cwtle, l_tax + 4 AS cwtri,
  CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_tax * 100 + 1 END AS cwttan,
  l_tax * 80 + 1 AS cwtrad, l_tax * 90 + 1 AS cwtall,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 + l_quantity / 40 END AS rtsr,
  l_discount * 5 AS ctsr, l_quantity / 7 AS dh,
  CASE WHEN l_quantity = 50 THEN 0.0 ELSE l_quantity + 1 END AS drad, l_quantity + 2 AS dtan,
  l_tax * 2 - 0.01 AS tb2, l_extendedprice / 400 AS cwa, l_discount - 0.001 AS rwd,
  l_suppkey AS suppkey
FROM {lineitem}
"""
#: Rings: one per image and year, some left out and some without cells or width.
RINGS = """
SELECT concat('W', s_nationkey) AS woodpiece_label, concat('S', s_nationkey, '_', r.suppkey % 3) AS slide_label,
  r.image_label, r.year, ra,
  CASE WHEN r.suppkey % 5 = 0 AND r.year = 2001 THEN NULL WHEN r.suppkey % 7 = 0 AND r.year = 1998 THEN 5.0 ELSE mrw END AS mrw,
  rvgi, rvsf, rgsgv, aoiar, dh_w, dh_m
FROM (
  SELECT suppkey, image_label, year, sum(la) AS ra, sum(rraddistr) AS mrw, sum(asp) AS rvgi, sum(majax) - 100 AS rvsf,
    cast(count(*) AS double) * 1.5 AS rgsgv, cast(count(*) AS double) * 2.0 AS aoiar, sum(dh) AS dh_w, sum(dtan) AS dh_m
  FROM ({cells_sql}) c WHERE NOT (suppkey % 11 = 0 AND year % 3 = 0) GROUP BY suppkey, image_label, year
  UNION ALL
  SELECT s_suppkey, concat('I', s_suppkey), 2002, 1.0, 50.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0 FROM {supplier} WHERE s_suppkey % 9 = 0
) r JOIN {supplier} s ON s_suppkey = r.suppkey
"""
META = """
SELECT concat('I', s_suppkey) AS image_label, concat('S', s_nationkey, '_', s_suppkey % 3) AS slide_label,
  concat('W', s_nationkey) AS woodpiece_label, concat('T', s_nationkey) AS tree_label,
  concat('R', n_regionkey) AS site_label, CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE concat('SP', s_nationkey % 3) END AS species_code,
  cast(1 + s_suppkey % 3 AS double) AS spatial_resolution,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 8 = 0 THEN 2000 ELSE 2001 END AS outmost_year
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
"""
TABLES = ["lineitem", "supplier", "nation", "customer", "orders", "part"]


def _sql(template: str, cells: str | None = None) -> str:
    return template.replace("{cells_sql}", cells or CELLS)


def measurements(spark: SparkSession, sf_dir: str, numbered: bool = False) -> Measurements:
    """Raw cells and rings of the adapter; numbered: the cells with CELL_NR, their place in the table's files."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "supplier")}
    if numbered:
        placed = t["lineitem"].select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias(CELL_NR))
        cells = spark.sql(CELLS.replace("AS suppkey\n", f"AS suppkey, {CELL_NR}\n"), lineitem=placed)
    else:
        cells = spark.sql(CELLS, lineitem=t["lineitem"])
    return Measurements(cells.drop("suppkey"), spark.sql(_sql(RINGS), **t))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("supplier", "nation")}
    return spark.sql(META, **t)


def oracle_views() -> str:
    """WITH clauses raw_cells, raw_rings, cells, rings (negatives removed) and meta, for DuckDB."""
    fill = lambda sql: sql.format(lineitem="lineitem", supplier="supplier", nation="nation")
    keep = lambda cols: ", ".join(f"CASE WHEN {c} < 0 THEN NULL ELSE {c} END AS {c}" for c in cols)
    cells = fill(CELLS)
    rings = fill(RINGS.replace("{cells_sql}", cells))
    return (
        f"raw_cells AS ({cells}), raw_rings AS ({rings}), "
        f"cells AS (SELECT * EXCLUDE (suppkey) REPLACE ({keep(CELL_MEASURES)}) FROM raw_cells), "
        f"rings AS (SELECT * REPLACE ({keep(RING_MEASURES)}) FROM raw_rings), meta AS ({fill(META)})"
    )
