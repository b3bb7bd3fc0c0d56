"""The bundle of tables that the cleaning steps pass on, and the columns they know."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Fixed: measures of a cell and of a ring that can't be negative.
CELL_MEASURES = [
    "raddistr", "rraddistr", "nbrno", "nbrid", "la", "asp", "majax", "kh", "cwtpi", "cwtba", "cwtle", "cwtri",
    "cwttan", "cwtrad", "cwtall", "rtsr", "ctsr", "dh", "drad", "dtan", "tb2", "cwa", "rwd",
]
RING_MEASURES = ["ra", "mrw", "rvgi", "rvsf", "rgsgv", "aoiar", "dh_w", "dh_m"]
RING_KEY = ["image_label", "year"]
#: A column that cells may have: their order in what was read.
CELL_NR = "cell_nr"


@dataclass(frozen=True)
class Measurements:
    """Cells (one row a cell) and rings (one row an image and year)."""

    cells: DataFrame
    rings: DataFrame


def require(df: DataFrame, columns: list[str], what: str) -> None:
    """Raises if df lacks any of the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
