"""Great-circle distance and grid cells as SQL expressions (one parsed expression each keeps plans quick to build)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sphere radius of the distance function and the ten-mile search radius, in metres.
EARTH_RADIUS_M = 6370986.0
SEARCH_RADIUS_M = 16093.4


def haversine_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL text of the distance in metres between two points given in degrees."""
    half = f"pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)"
    return f"2 * {EARTH_RADIUS_M}D * asin(least(1D, sqrt({half})))"


class Grid:
    """Latitude rows of ``size_m``; each row has its own whole number of equal longitude cells.

    The cell count of a row depends only on the row, so no statistics of the data are needed, longitudes
    wrap at 180 degrees and rows near a pole simply have few cells.
    """

    def __init__(self, size_m: float):
        self.step = math.degrees(size_m / EARTH_RADIUS_M)

    def row(self, lat: str) -> str:
        return f"CAST(floor(({lat}) / {self.step}D) AS INT)"

    def low_abs_lat(self, row: str) -> str:
        """Smallest |latitude| in a row, where its cells are widest in metres."""
        return f"(CASE WHEN {row} >= 0 THEN {row} ELSE -({row} + 1) END * {self.step}D)"

    def cells_in_row(self, row: str) -> str:
        high = f"least(90D, {self.low_abs_lat(row)} + {self.step}D)"
        return f"greatest(1, CAST(floor(360D * cos(radians({high})) / {self.step}D) AS INT))"

    def center_lat(self, row: str) -> str:
        return f"(({row} + 0.5D) * {self.step}D)"

    def center_lon(self, row: str, col: str) -> str:
        return f"(({col} + 0.5D) * 360D / {self.cells_in_row(row)} - 180D)"

    def reach(self, row: str) -> str:
        """Upper bound in metres of the distance from a cell's centre to any of its points."""
        half_lon = f"pi() / {self.cells_in_row(row)} * cos(radians({self.low_abs_lat(row)}))"
        return f"{EARTH_RADIUS_M}D * sqrt({math.radians(self.step / 2) ** 2}D + pow({half_lon}, 2))"

    def max_reach(self) -> float:
        """Largest ``reach`` of any row."""
        far = 0.0
        for row in range(math.ceil(90 / self.step)):
            low, high = row * self.step, min(90.0, (row + 1) * self.step)
            n = max(1, math.floor(360 * math.cos(math.radians(high)) / self.step))
            far = max(far, math.hypot(math.radians(self.step / 2), math.pi / n * math.cos(math.radians(low))))
        return EARTH_RADIUS_M * far * (1 + 1e-9)

    def place(self, df: DataFrame, row: str = "_row", col: str = "_col", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
        """Add the cell of each point."""
        df = df.withColumn(row, F.expr(self.row(lat)))
        return df.withColumn(col, F.expr(f"CAST(pmod(floor(({lon} + 180D) * {self.cells_in_row(row)} / 360D), {self.cells_in_row(row)}) AS INT)"))

    def explode_around(self, df: DataFrame, lat: str, lon: str, reach_m: str) -> DataFrame:
        """One row per cell that the circle of ``reach_m`` (SQL) around (lat, lon) can touch, as ``_row``/``_col``."""
        own = df.columns
        df = df.selectExpr("*", f"({reach_m}) / {EARTH_RADIUS_M}D AS _d")
        df = df.selectExpr("*", f"sin(_d) / cos(radians({lat})) AS _ratio", f"explode(sequence({self.row(f'{lat} - degrees(_d)')}, {self.row(f'{lat} + degrees(_d)')})) AS _row")
        df = df.selectExpr(*own, "_row", "CASE WHEN _ratio < 1 THEN degrees(asin(_ratio)) ELSE 360D END AS _width", f"{self.cells_in_row('_row')} AS _n")
        first, last = (f"floor(({lon} {sign} _width + 180D) * _n / 360D)" for sign in "-+")
        df = df.selectExpr(*own, "_row", "_n", f"explode(sequence({first}, least({last}, {first} + _n - 1))) AS _c")
        return df.selectExpr(*own, "_row", "CAST(pmod(_c, _n) AS INT) AS _col")
