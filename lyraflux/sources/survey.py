"""From survey documents and sky positions to clean light curves."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyraflux.config import IngestConfig
from lyraflux.constants import FILTER_BANDS, MATCH_RADIUS_ARCSEC
from lyraflux.operators.lightcurves import spaced
from lyraflux.sources import sky
from lyraflux.sources.storage import observed


def unwrap_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the responses that succeeded, and the rows of those that failed (status, message).

    ``responses`` has status, message and data, an array of documents.
    """
    good = responses.where(F.col("status") == "success").select(F.explode("data").alias("doc")).where("doc is not null")
    return good.select("doc.*"), responses.where(~F.col("status").eqNullSafe(F.lit("success"))).select("status", "message")


def unwrap_cones(responses: DataFrame, target: str = "center") -> tuple[DataFrame, DataFrame]:
    """Documents found around ``target`` in the cone responses that succeeded, and the rows of those that failed.

    ``data`` maps a collection's name to a map from target to an array of documents.
    """
    around = F.transform(F.map_values("data"), lambda cones: F.try_element_at(cones, F.lit(target)))
    found = F.flatten(F.filter(around, lambda docs: docs.isNotNull()))
    good = responses.where(F.col("status") == "success").select(F.explode(F.filter(found, lambda d: d.isNotNull())).alias("doc"))
    return good.select("doc.*"), responses.where(~F.col("status").eqNullSafe(F.lit("success"))).select("status", "message")


def light_curves(docs: DataFrame, config: IngestConfig | None = None, document_filters: bool = True) -> DataFrame:
    """Observations (source_id, band, survey, ra, dec, t, mag, mag_err, ord) of ``docs``.

    A document is taken if any epoch is positive and not beyond ``max_time`` and any is of an
    allowed programme (a document of epochs without a number only is not); its epochs are
    then cleaned one by one: flagged ones and those without a flag go, and of programmes the
    allowed ones and those without a number stay; with ``epoch_cutoff`` those without a time in the limit
    go as well; of what stays, epochs less than
    ``min_cadence_days`` after the last kept one go. Missing positions become 0. Without
    ``document_filters`` only the epochs are cleaned.
    """
    c = config or IngestConfig()
    band_of = F.create_map(*[F.lit(x) for kv in FILTER_BANDS.items() for x in kv])
    in_time = lambda p: (p["hjd"] > 0) & (F.lit(True) if c.max_time is None else p["hjd"] <= c.max_time)
    chosen = (docs.where(F.exists("data", in_time)) if document_filters else docs).withColumn("band", F.try_element_at(band_of, F.col("filter")))
    if c.program_ids and document_filters:
        chosen = chosen.where(F.exists("data", lambda p: p["programid"].isin(*c.program_ids)))
    allowed = lambda p: p["programid"].isNull() | (p["programid"].isin(*c.program_ids) if c.program_ids else F.lit(False))
    timely = in_time if c.epoch_cutoff else lambda p: F.lit(True)
    clean = F.filter("data", lambda p: (F.coalesce(p["catflags"], F.lit(1)) == 0) & allowed(p) & timely(p))
    rows = chosen.where(F.col("band").isin(*c.bands)).select(
        F.col("_id").cast("string").alias("source_id"), "band", F.lit("ztf").alias("survey"), F.coalesce("ra", F.lit(0.0)).alias("ra"), F.coalesce("dec", F.lit(0.0)).alias("dec"),
        F.transform(clean, lambda p, i: F.struct(p["hjd"].isNull().alias("last"), p["hjd"].alias("t"), i.alias("ord"), p["mag"].alias("mag"), p["magerr"].alias("mag_err"))).alias("epochs"),
    )
    if c.min_cadence_days > 0:
        rows = rows.withColumn("epochs", F.array_sort("epochs")).withColumn("epochs", spaced(F.col("epochs"), c.min_cadence_days))
    return rows.select("source_id", "band", "survey", "ra", "dec", F.explode("epochs").alias("p")).select("source_id", "band", "survey", "ra", "dec", "p.t", "p.mag", "p.mag_err", "p.ord")


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(dec1, dec2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half(ra1, ra2)
    return 2 * F.degrees(F.asin(F.sqrt(F.least(a, F.lit(1.0))))) * 3600


def _finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name)


def sky_cells(dec_zone: Column, height: float, radius: float) -> Column:
    """How many equal cells of right ascension a zone of declination is cut into, none narrower than the radius there.

    Points of declinations up to d in size that are ``radius`` degrees apart differ by at most
    2 asin(sin(radius / 2) / cos d) in right ascension. A zone that reaches a pole is one cell.
    """
    low = dec_zone * height - 90
    furthest = F.least(F.greatest(F.abs(low), F.abs(low + height)) + height, F.lit(90.0))
    ratio = F.sin(F.radians(F.lit(radius / 2))) / F.greatest(F.cos(F.radians(furthest)), F.lit(1e-15))
    width = 2 * F.degrees(F.asin(F.least(ratio, F.lit(1.0))))
    return F.when(ratio < 1, F.greatest(F.floor(360 / (width * (1 + 1e-9))), F.lit(1))).otherwise(F.lit(1)).cast("long")


ZONES = ["zone", "cell"]


def _zones(radius_arcsec: float) -> tuple[float, float]:
    """Radius and height of a zone in degrees."""
    radius = radius_arcsec / 3600
    return radius, max(radius, 1e-6)


def _cell(ra: Column, n: Column) -> Column:
    return F.pmod(F.floor(F.pmod(ra, F.lit(360.0)) / 360 * n), n)


def in_own_cell(rows: DataFrame, radius_arcsec: float) -> DataFrame:
    """``rows`` with known positions and the zone and cell each stands in."""
    radius, height = _zones(radius_arcsec)
    own = rows.where(_finite("ra") & _finite("dec")).withColumn("zone", F.floor((F.col("dec") + 90) / height))
    return own.withColumn("cell", _cell(F.col("ra"), sky_cells(F.col("zone"), height, radius)))


def in_cells_around(rows: DataFrame, radius_arcsec: float) -> DataFrame:
    """``rows`` with known positions, once for each cell that a point within the radius may stand in; ra and dec become cat_ra and cat_dec."""
    radius, height = _zones(radius_arcsec)
    near = rows.withColumnsRenamed({"ra": "cat_ra", "dec": "cat_dec"}).where(_finite("cat_ra") & _finite("cat_dec"))
    near = near.withColumn("zone", F.explode(F.array(*[F.floor((F.col("cat_dec") + 90) / height) + k for k in (-1, 0, 1)])))
    near = near.withColumn("cells", sky_cells(F.col("zone"), height, radius))
    around = F.array_distinct(F.array(*[F.pmod(_cell(F.col("cat_ra"), F.col("cells")) + k, F.col("cells")) for k in (-1, 0, 1)]))
    return near.withColumn("cell", F.explode(around)).drop("cells")


def paired(own: DataFrame, near: DataFrame, radius_arcsec: float) -> DataFrame:
    """Pairs up to ``radius_arcsec`` apart of rows ``in_own_cell`` and rows ``in_cells_around`` for that radius, with ``sep``."""
    both = own.join(near, ZONES)
    both = both.withColumn("sep", separation_arcsec(F.col("ra"), F.col("dec"), F.col("cat_ra"), F.col("cat_dec")))
    return both.where(F.col("sep") <= radius_arcsec).drop(*ZONES)


def within_radius(left: DataFrame, right: DataFrame, radius_arcsec: float) -> DataFrame:
    """Pairs of positions up to ``radius_arcsec`` apart, with ``sep``; ``right``'s ra and dec become cat_ra and cat_dec.

    An equi-join of sky cells about as wide and high as the radius: a row of ``right`` stands in
    its own cell and the eight around it, across 0 and 360 degrees too, and in whole zones near
    the poles. So a position meets those of about nine cells, however large the tables are.
    Positions that are null or NaN meet none.
    """
    return paired(in_own_cell(left, radius_arcsec), in_cells_around(right, radius_arcsec), radius_arcsec)


def within_radius_by_place(left: DataFrame, right: DataFrame, radius_arcsec: float, digits: int) -> DataFrame:
    """The pairs of ``within_radius`` (source_id, gid, sep) where many rows of ``left`` and ``right`` share a position.

    Distances are taken, and rounded to ``digits`` places, once between different positions; then rows join theirs. Pairs grow with the rows on a position
    of either side, so their number may grow with the square of the tables.
    """
    places = within_radius(left.select("ra", "dec").distinct(), right.select("ra", "dec").distinct(), radius_arcsec).withColumn("sep", F.round("sep", digits))
    # positions are few and their pairs of rows many, so tasks aren't put together by the size of what they read
    session = left.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    found = places.join(left.select("source_id", "ra", "dec"), ["ra", "dec"]).repartition(tasks, "cat_ra", "cat_dec")
    targets = right.select("gid", F.col("ra").alias("cat_ra"), F.col("dec").alias("cat_dec"))
    return found.join(targets, ["cat_ra", "cat_dec"]).select("source_id", "gid", "sep")


def linked(left: DataFrame, right: DataFrame, radius_arcsec: float) -> DataFrame:
    """Every row of ``left`` (source_id, ra, dec) with how many rows of ``right`` (gid, ra, dec) are within the radius, and the nearest of them.

    Rows of one position are one class, ``place`` its first source_id: distances are taken between different positions only, once, however
    many rows share them. n_links counts rows of ``right``, n_places their different positions; nearest_gid is the first of
    the nearest by ``nearest_sep``, which is rounded to four places as ``farthest_sep`` is. Rows without a link have 0 and nulls.
    """
    places = left.groupBy("ra", "dec").agg(F.min("source_id").alias("place"))
    targets = right.groupBy("ra", "dec").agg(F.min("gid").alias("gid"), F.count(F.lit(1)).alias("n"))
    sep = F.round("sep", 4)
    found = within_radius(places, targets, radius_arcsec).groupBy("place").agg(
        F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_places"), F.min(F.struct(sep.alias("sep"), "gid")).alias("nearest"), F.max(sep).alias("farthest_sep")
    )
    whole = places.join(found, "place", "left").withColumnsRenamed({"ra": "place_ra", "dec": "place_dec"})
    here = left.join(whole, F.col("ra").eqNullSafe(F.col("place_ra")) & F.col("dec").eqNullSafe(F.col("place_dec")))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_places")]
    return here.select("source_id", "place", *counts, F.col("nearest.gid").alias("nearest_gid"), F.col("nearest.sep").alias("nearest_sep"), "farthest_sep")


def stored_for_join(rows: DataFrame, name: str, folder: str, radius_arcsec: float, buckets: int, around: bool = False) -> DataFrame:
    """A table ``name`` at ``folder`` of ``rows`` bucketed by the cells of a radius: ``paired`` joins two such tables without a shuffle.

    The side that ``paired`` takes second is stored with ``around``: about nine copies a row, so it should be the smaller one. Both need
    the same radius and number of buckets. A bucket is one task: where a cell holds a share of all rows that one task can't
    take, use ``within_radius``, whose skewed partitions are split while it runs.
    """
    laid = (in_cells_around if around else in_own_cell)(rows, radius_arcsec)
    writer = laid.repartition(buckets, *ZONES).write.mode("overwrite").option("path", folder)
    writer.bucketBy(buckets, *ZONES).sortBy(*ZONES).saveAsTable(name)
    return rows.sparkSession.table(name)


def in_cone(rows: DataFrame, ra: float, dec: float, radius_arcsec: float) -> DataFrame:
    """Rows within a radius of a point. Those of a table laid out by sky cell come from the partitions and row groups that the cone reaches."""
    near = rows.where(sky.covered(ra, dec, radius_arcsec)) if {sky.CELL, sky.FINE} <= set(rows.columns) else rows
    near = near.where(F.abs(F.col("dec") - dec) <= radius_arcsec / 3600)
    return near.where(separation_arcsec(F.col("ra"), F.col("dec"), F.lit(ra), F.lit(dec)) <= radius_arcsec)


def near_ids(sources: DataFrame, ra: float, dec: float, radius_arcsec: float, min_nobs: int = 50, limit: int = 100_000) -> tuple[DataFrame, bool]:
    """Ids within a radius of a point that have observations enough (0: all), at most ``limit``; whether there may be more.

    ``sources`` are read once: the ids go to the shared folder and are counted as they are written.
    """
    found = in_cone(sources, ra, dec, radius_arcsec)
    found = (found.where(F.col("nobs") >= min_nobs) if min_nobs > 0 else found).select("source_id").limit(limit)
    ids, seen = observed(found, n=F.count(F.lit(1)))
    return ids, seen["n"] >= limit


def by_ids(docs: DataFrame, ids: DataFrame, config: IngestConfig | None = None) -> DataFrame:
    """Clean observations of the documents whose id is in ``ids`` (source_id); what isn't a number finds nothing."""
    wanted = ids.select(F.col("source_id").try_cast("long").alias("_id"))
    return light_curves(docs.join(wanted, "_id", "left_semi"), config)


def by_position(docs: DataFrame, ra: float, dec: float, radius_arcsec: float = MATCH_RADIUS_ARCSEC, config: IngestConfig | None = None) -> DataFrame:
    """Clean observations of all documents within a radius of a point, however few and whenever they were made."""
    c = config or IngestConfig()
    return light_curves(in_cone(docs, ra, dec, radius_arcsec), replace(c, max_time=None), document_filters=False)


def by_region(docs: DataFrame, ra: float, dec: float, radius_arcsec: float, config: IngestConfig | None = None, limit: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Ids within a radius that have observations enough, and the clean observations of their documents.

    Where the limit is reached a warning says that the region is probably cut.
    """
    c = config or IngestConfig()
    laid = [x for x in (sky.CELL, sky.FINE) if x in docs.columns]
    sources = docs.select(F.col("_id").cast("string").alias("source_id"), "ra", "dec", F.size("data").alias("nobs"), *laid)
    ids, cut = near_ids(sources, ra, dec, radius_arcsec, c.min_nobs, limit)
    if cut:
        warnings.warn(f"{limit} ids were found, as many as the limit: the region is probably cut; raise the limit or split the region", stacklevel=2)
    return ids, by_ids(docs, ids, c)


def failed_queries(responses: DataFrame) -> DataFrame:
    """How many responses there are and how many of them failed: if all did, matches are missing for another reason than the sky."""
    return responses.agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(~F.col("status").eqNullSafe(F.lit("success"))).alias("n_failed"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2 ... in their order, without a window over all: partitions are counted, then shifted."""
    made = rows.withColumn("row_at", F.monotonically_increasing_id())
    part, place = F.shiftright("row_at", 33), F.col("row_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = made.groupBy(part.alias("row_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("row_part")) - F.col("n")
    starts = sizes.select("row_part", before.alias("row_start"))  # a row a partition
    joined = made.withColumn("row_part", part).join(F.broadcast(starts), "row_part")
    return joined.withColumn(name, F.col("row_start") + place).drop("row_at", "row_part", "row_start")


def target_catalogue(spark, path: str) -> DataFrame:
    """ra, dec and name of a CSV with a header; without obj_id and name a row is called src_ and its number from 0."""
    rows = spark.read.csv(path, header=True)
    for c in ("obj_id", "name"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    rows = numbered(rows, "row_number")
    name = F.coalesce(F.nullif("obj_id", F.lit("")), F.nullif("name", F.lit("")), F.concat(F.lit("src_"), F.col("row_number").cast("string")))
    return rows.select(F.col("ra").cast("double"), F.col("dec").cast("double"), name.alias("name"))
