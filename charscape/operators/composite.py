"""Temporal median composites and burn indices of the observation table.

Observations are long: one row per pixel, band and scene. One pass over them gives all four
medians (two bands, two windows). The medians are mergeable aggregates, so a pixel or tile that
holds a large share of the rows is reduced to its distinct values before the one shuffle. Sensor
values have 16 bits, which bounds a pixel's state to 65,536 entries per median. For sources
without such a bound, ``ranked_composite`` gives the same medians from counts and sorted runs,
which spill instead of filling memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SortWindow
from pyspark.sql import functions as F

from charscape.constants import DEFAULT_BREAKS, NIR_BAND, SWIR_BAND
from charscape.functions import spectral
from charscape.functions.geometry import all_of
from charscape.functions.timeparse import DateWindow, Window, hull

PIXEL = ("tile_id", "row", "col")
INDICES = ("prefire_nbr", "postfire_nbr", "dnbr", "rdnbr", "rbr")
_MEDIANS = ("pre_nir", "pre_swir", "post_nir", "post_swir")


def scan_observations(
    observations: DataFrame,
    bounds: tuple[float, float, float, float] | None = None,
    window: DateWindow | None = None,
    bands: Sequence[str] = (SWIR_BAND, NIR_BAND),
) -> DataFrame:
    """Bands, box and time range of the stack; all of it reaches the scan as filters."""
    conditions = [F.col("band").isin(*bands)]
    if bounds is not None:
        minx, miny, maxx, maxy = bounds
        conditions += [F.col("x").between(minx, maxx), F.col("y").between(miny, maxy)]
    if window is not None:
        conditions.append(window.contains(F.col("ts")))
    return observations.where(all_of(conditions))


def filter_window(observations: DataFrame, window: DateWindow) -> DataFrame:
    return observations.where(window.contains(F.col("ts")))


def select_band(observations: DataFrame, band: str) -> DataFrame:
    return observations.where(F.col("band") == band)


def normalise_nodata(observations: DataFrame, column: str = "value") -> DataFrame:
    return observations.withColumn(column, spectral.valid_value(F.col(column)))


def _read_windows(pre: Window, post: Window) -> Column:
    ts = F.col("ts")
    return hull(pre, post).contains(ts) & (pre.contains(ts) | post.contains(ts))


def median_composite(
    observations: DataFrame,
    pre: Window,
    post: Window,
    by: Sequence[str] = PIXEL,
    nir: str = NIR_BAND,
    swir: str = SWIR_BAND,
) -> DataFrame:
    """Per pixel, the median of each band in each window, missing values skipped."""
    band, value = F.col("band"), spectral.valid_value(F.col("value"))
    in_pre, in_post = pre.contains(F.col("ts")), post.contains(F.col("ts"))
    medians = [
        F.median(F.when((band == b) & inside, value)).alias(name)
        for name, b, inside in zip(
            _MEDIANS, (nir, swir, nir, swir), (in_pre, in_pre, in_post, in_post)
        )
    ]
    return (
        observations.where(band.isin(swir, nir) & _read_windows(pre, post))
        .groupBy(*by)
        .agg(*medians)
    )


def ranked_composite(
    observations: DataFrame,
    pre: Window,
    post: Window,
    by: Sequence[str] = PIXEL,
    nir: str = NIR_BAND,
    swir: str = SWIR_BAND,
) -> DataFrame:
    """The same as ``median_composite`` for values of unbounded variety.

    Equal values are counted first, spread over tasks by value. Running counts per pixel and band
    then tell which values hold the middle ranks.
    """
    ts, band = F.col("ts"), F.col("band")
    series = SortWindow.partitionBy(*by, "band")
    running = series.orderBy("value")
    counts = (
        observations.where(band.isin(swir, nir) & _read_windows(pre, post))
        .withColumn("value", spectral.valid_value(F.col("value")))
        .groupBy(*by, "band", "value")
        .agg(
            *[
                F.count(F.when(window.contains(ts), F.col("value"))).alias(f"{name}_n")
                for name, window in (("pre", pre), ("post", post))
            ]
        )
    )
    ranked = counts.select(
        "*",
        *[F.sum(f"{w}_n").over(running).alias(f"{w}_end") for w in ("pre", "post")],
        *[F.sum(f"{w}_n").over(series).alias(f"{w}_all") for w in ("pre", "post")],
    )

    def median(window: str, of_band: str) -> Column:
        n, end = F.col(f"{window}_n"), F.col(f"{window}_end")
        middle = (F.col(f"{window}_all") - 1) / 2

        def at(rank: Column) -> Column:
            holds = (band == of_band) & (n > 0) & (end > rank) & (end - n <= rank)
            return F.max(F.when(holds, F.col("value")))

        return (at(F.floor(middle)) + at(F.ceil(middle))) / 2

    return ranked.groupBy(*by).agg(
        *[
            median(window, b).alias(name)
            for name, window, b in zip(
                _MEDIANS, ("pre", "pre", "post", "post"), (nir, swir, nir, swir)
            )
        ]
    )


def window_nbr(
    observations: DataFrame,
    window: DateWindow,
    name: str,
    by: Sequence[str] = PIXEL,
    nir: str = NIR_BAND,
    swir: str = SWIR_BAND,
) -> DataFrame:
    """NBR of one window's composite."""
    value = spectral.valid_value(F.col("value"))
    return (
        scan_observations(observations, window=window, bands=(swir, nir))
        .groupBy(*by)
        .agg(
            F.median(F.when(F.col("band") == nir, value)).alias("nir"),
            F.median(F.when(F.col("band") == swir, value)).alias("swir"),
        )
        .select(*by, spectral.nbr(F.col("nir"), F.col("swir")).alias(name))
    )


def align(pre: DataFrame, post: DataFrame, by: Sequence[str] = PIXEL) -> DataFrame:
    """Pixels of both composites. Keys are unique on both sides, so no key can be hot."""
    return pre.join(post, list(by), "inner")


def composite_nbr(composite: DataFrame, by: Sequence[str] = PIXEL) -> DataFrame:
    return composite.select(
        *by,
        spectral.nbr(F.col("pre_nir"), F.col("pre_swir")).alias("prefire_nbr"),
        spectral.nbr(F.col("post_nir"), F.col("post_swir")).alias("postfire_nbr"),
    )


def add_indices(nbrs: DataFrame) -> DataFrame:
    """dNBR, RdNBR and RBR beside the two NBR columns."""
    pre, post = F.col("prefire_nbr"), F.col("postfire_nbr")
    return nbrs.withColumns(
        {
            "dnbr": spectral.dnbr(pre, post),
            "rdnbr": spectral.rdnbr(pre, post),
            "rbr": spectral.rbr(pre, post),
        }
    )


def burn_indices(
    observations: DataFrame,
    pre: Window,
    post: Window,
    by: Sequence[str] = PIXEL,
    nir: str = NIR_BAND,
    swir: str = SWIR_BAND,
    bounded_values: bool = True,
) -> DataFrame:
    """The five indices per pixel, one wide row, from one scan.

    ``bounded_values`` holds for sensor counts; without it medians are taken by rank.
    """
    compose = median_composite if bounded_values else ranked_composite
    return add_indices(composite_nbr(compose(observations, pre, post, by, nir, swir), by))


def classify(
    grid: DataFrame,
    breaks: tuple[float, float] = DEFAULT_BREAKS,
    severity: str = "rbr",
) -> DataFrame:
    return grid.withColumn("severity_class", spectral.severity_class(F.col(severity), breaks))


def severity_masks(
    grid: DataFrame,
    breaks: tuple[float, float] = DEFAULT_BREAKS,
    severity: str = "rbr",
) -> DataFrame:
    """One column per class: the severity inside the class and 0 outside."""
    value = F.col(severity)
    return grid.withColumns(
        {
            name: spectral.severity_mask(value, condition)
            for name, condition in spectral.class_conditions(value, breaks).items()
        }
    )


def class_counts(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return classified.groupBy(*by, "severity_class").agg(F.count("*").alias("pixels"))


def stack_shape(
    observations: DataFrame, windows: dict[str, DateWindow]
) -> DataFrame:
    """Sizes of each window's stack: times, bands, rows and columns.

    Distinct values are reduced per task before they travel; one expand serves all windows.
    """
    ts = F.col("ts")

    def in_window(window: DateWindow, column: str) -> Column:
        return F.count_distinct(F.when(window.contains(ts), F.col(column)))

    return observations.agg(
        *[
            in_window(window, column).alias(f"{name}_{label}")
            for name, window in windows.items()
            for column, label in (
                ("ts", "times"),
                ("band", "bands"),
                ("row", "rows"),
                ("col", "cols"),
            )
        ]
    )
