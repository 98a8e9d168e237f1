"""Tables laid out by sky cell: a cone reads the partitions and row groups that it reaches, and tables of equal cells join without a shuffle.

Cells are a quadtree over right ascension and the sine of declination, so all cells of a level are of one area.
The two cells of level 0 are the halves of the sky; cell c of a level holds the cells 4 c to 4 c + 3 of the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Level of the partitions (512 cells of 81 square degrees), and of the number that files are sorted by (0.022 degrees of right ascension at FINE_LEVEL 13).
CELL_LEVEL, FINE_LEVEL = 4, 13
CELL, FINE = "sky_cell", "sky_fine"
#: A cone is covered by whole cells, as small as this number of ranges allows.
MOST_RANGES = 32


def known(ra: Column, dec: Column) -> Column:
    """Whether a position is one: finite numbers, declination between the poles."""
    return F.coalesce((F.abs(ra) < float("inf")) & (F.abs(dec) <= 90), F.lit(False))


def with_cells(df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """``df`` with sky_fine and sky_cell (long); both are null where the position is unknown."""
    columns, rows = 1 << (FINE_LEVEL + 1), 1 << FINE_LEVEL
    at = lambda share, n: F.least(F.floor(share * n), F.lit(n - 1)).cast("long")
    x = F.when(known(F.col(ra), F.col(dec)), at(F.pmod(F.col(ra), F.lit(360.0)) / 360, columns))
    y = at((F.sin(F.radians(F.col(dec))) + 1) / 2, rows)
    bit = lambda c, i, to: F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), to)
    fine = sum((bit(F.col("sky_x"), i, 2 * i) for i in range(1, FINE_LEVEL + 1)), bit(F.col("sky_x"), 0, 0))
    fine = sum((bit(F.col("sky_y"), i, 2 * i + 1) for i in range(FINE_LEVEL)), fine)
    made = df.withColumns({"sky_x": x, "sky_y": y}).withColumn(FINE, fine).drop("sky_x", "sky_y")
    return made.withColumn(CELL, F.shiftright(FINE, 2 * (FINE_LEVEL - CELL_LEVEL)))


def write(df: DataFrame, path: str, key: str = "source_id", rows_a_file: int = 2_000_000, ra: str = "ra", dec: str = "dec") -> None:
    """``df`` as a table at ``path``: a partition a cell, files sorted by the fine cell.

    Rows go to tasks by ranges of the fine cell and a hash of ``key``, so that a crowded cell, or the rows without a
    position, are many files by many tasks. An existing table is replaced.
    """
    dealt = with_cells(df, ra, dec).repartitionByRange(FINE, F.xxhash64(key)).sortWithinPartitions(CELL, FINE)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy(CELL).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, with sky_fine and sky_cell, by which ``in_cone`` prunes."""
    found = spark.read.parquet(path)
    return found.withColumn(CELL, F.col(CELL).cast("long")) if found.schema[CELL].dataType.simpleString() == "string" else found


def cover(ra: float, dec: float, radius_arcsec: float) -> list[tuple[int, int]]:
    """Ranges of fine cells, both ends included, that hold all points within the radius of a point (and some others).

    Cells are split until they lie inside the cone's box of right ascension and sine of declination, or the number
    of ranges would pass MOST_RANGES. The box is a little wider than the cone, for what rounding moves across a border.
    """
    r = radius_arcsec / 3600
    bottom, top = (math.sin(math.radians(max(min(d, 90.0), -90.0))) for d in (dec - r, dec + r))
    bottom, top = bottom - 1e-12, top + 1e-12
    if abs(dec) + r >= 90 - 1e-6:
        windows = [(-1.0, 361.0)]
    else:
        half = math.degrees(math.asin(min(1.0, math.sin(math.radians(r)) / math.cos(math.radians(dec))))) * (1 + 1e-9) + 1e-9
        windows = [(ra % 360 - half + turn, ra % 360 + half + turn) for turn in (-360, 0, 360)]

    def box(level: int, x: int, y: int) -> tuple[float, float, float, float]:
        width, height = 180 / (1 << level), 2 / (1 << level)
        return x * width, (x + 1) * width, y * height - 1, (y + 1) * height - 1

    done: list[tuple[int, int]] = []
    open_ = [(c, c, 0) for c in (0, 1)]
    for level in range(FINE_LEVEL + 1):
        left, shift = [], 2 * (FINE_LEVEL - level)
        for c, x, y in open_:
            west, east, south, north = box(level, x, y)
            if north < bottom or south > top or not any(a <= east and west <= b for a, b in windows):
                continue
            if level == FINE_LEVEL or (bottom <= south and north <= top and any(a <= west and east <= b for a, b in windows)):
                done.append((c << shift, ((c + 1) << shift) - 1))
            else:
                left.append((c, x, y))
        if len(done) + len(left) > MOST_RANGES or not left:
            done += [(c << shift, ((c + 1) << shift) - 1) for c, _, _ in left]
            break
        open_ = [(4 * c + i, 2 * x + i % 2, 2 * y + i // 2) for c, x, y in left for i in range(4)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if merged and merged[-1][1] + 1 == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def covered(ra: float, dec: float, radius_arcsec: float) -> Column:
    """The rows of a table of this layout that a cone may hold: cells prune partitions, ranges prune row groups."""
    ranges, shift = cover(ra, dec, radius_arcsec), 2 * (FINE_LEVEL - CELL_LEVEL)
    cells = sorted({c for a, b in ranges for c in range(a >> shift, (b >> shift) + 1)})
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col(FINE).between(a, b)
    return F.col(CELL).isin(cells) & inside
