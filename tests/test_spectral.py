"""Golden values of indices and classes."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from charscape.functions import spectral
from charscape.operators import composite, grids
from charscape.functions.timeparse import DateWindow

GOLDEN = [
    [-0.2, -0.1, 0.0, 0.0999],
    [0.1, 0.2, 0.2699, 0.27],
    [0.5, 0.6599, 0.66, 0.9],
    [None, math.nan, -9999.0, 0.3],
]
EXPECTED = [
    [None, "unburned", "unburned", "unburned"],
    ["low", "low", "low", "moderate"],
    ["moderate", "moderate", "high", "high"],
    [None, None, None, "moderate"],
]


def golden(spark):
    rows = [(r, c, GOLDEN[r][c]) for r in range(4) for c in range(4)]
    return spark.createDataFrame(rows, "row long, col long, rbr double")


def test_classes_of_golden_grid(spark):
    clean = golden(spark).withColumn("rbr", spectral.valid_value(F.col("rbr")))
    got = {(r["row"], r["col"]): r["severity_class"] for r in composite.classify(clean).collect()}
    assert got == {(r, c): EXPECTED[r][c] for r in range(4) for c in range(4)}


def test_class_counts(spark):
    clean = golden(spark).withColumn("rbr", spectral.valid_value(F.col("rbr")))
    counts = composite.class_counts(composite.classify(clean)).collect()
    assert {r["severity_class"]: r["pixels"] for r in counts} == {
        None: 4,
        "unburned": 3,
        "low": 3,
        "moderate": 4,
        "high": 2,
    }


def test_masks_keep_values_inside_and_zero_outside(spark):
    clean = golden(spark).withColumn("rbr", spectral.valid_value(F.col("rbr")))
    for row in composite.severity_masks(clean).collect():
        wanted = EXPECTED[row["row"]][row["col"]]
        for name in ("unburned", "low", "moderate", "high"):
            assert row[name] == (row["rbr"] if name == wanted else 0.0)


def test_custom_breaks(spark):
    df = spark.createDataFrame([(0.3,), (0.45,), (0.5,)], "rbr double")
    assert [r["severity_class"] for r in composite.classify(df, (0.4, 0.5)).collect()] == [
        "low",
        "moderate",
        "high",
    ]


def test_index_guards(spark):
    df = spark.createDataFrame(
        [(0.0, 0.25), (-1.001, 0.0), (0.36, 0.0), (None, 0.1)], "pre double, post double"
    )
    pre, post = F.col("pre"), F.col("post")
    rows = df.select(
        spectral.rdnbr(pre, post).alias("rdnbr"), spectral.rbr(pre, post).alias("rbr")
    ).collect()
    assert rows[0]["rdnbr"] == -0.25 / 0.001
    assert rows[1]["rbr"] is None
    assert rows[2]["rdnbr"] == pytest.approx(0.6)
    assert rows[3]["rdnbr"] is None and rows[3]["rbr"] is None
    zero = spark.createDataFrame([(0.0, 0.0)], "n double, s double")
    assert zero.select(spectral.nbr(F.col("n"), F.col("s")).alias("v")).first()["v"] is None


PRE, POST = DateWindow("2023-01-01", "2023-06-30"), DateWindow("2023-07-01", "2023-12-31")


def observations(spark, rows):
    return spark.createDataFrame(
        rows, "tile_id long, row long, col long, band string, ts string, value double"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_equal_windows_give_zero_indices(spark):
    rows = [
        (0, 0, c, band, day, 10.0 + c + (3 if band == "B8A" else 0))
        for c in range(4)
        for band in ("B8A", "B12")
        for day in ("2023-02-01", "2023-08-01")
    ]
    for row in composite.burn_indices(observations(spark, rows), PRE, POST).collect():
        assert (row["dnbr"], row["rdnbr"], row["rbr"]) == (0.0, 0.0, 0.0)


def test_median_skips_missing_and_ends_at_midnight(spark):
    rows = [
        (0, 0, 0, "B8A", "2023-01-01T00:00:00", 1.0),
        (0, 0, 0, "B8A", "2023-06-30T00:00:00", 4.0),
        (0, 0, 0, "B8A", "2023-06-30T10:00:00", 100.0),
        (0, 0, 0, "B8A", "2023-03-01T00:00:00", math.nan),
        (0, 0, 0, "B8A", "2023-03-02T00:00:00", -9999.0),
        (0, 0, 0, "B8A", "2023-03-03T00:00:00", None),
        (0, 0, 0, "B04", "2023-03-03T00:00:00", 50.0),
    ]
    obs = observations(spark, rows)
    assert composite.median_composite(obs, PRE, POST).first()["pre_nir"] == 2.5
    whole = DateWindow("2023-01-01", "2023-06-30", whole_end_day=True)
    assert composite.median_composite(obs, whole, POST).first()["pre_nir"] == 4.0


def test_composite_does_not_depend_on_partitioning(spark):
    rows = [
        (r // 2, r, c, band, f"2023-{m:02d}-10", float((r * 7 + c * 3 + m * 5) % 11))
        for r in range(4)
        for c in range(4)
        for band in ("B8A", "B12")
        for m in range(1, 13)
    ]
    obs = observations(spark, rows)
    one = composite.burn_indices(obs.coalesce(1), PRE, POST)
    many = composite.burn_indices(obs.repartition(13), PRE, POST)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(
        map(tuple, many.collect()), key=str
    )


def test_windows_must_be_complete():
    with pytest.raises(ValueError):
        DateWindow("2023-01-01", "")


def test_crowded_pixel_is_exact(spark):
    """One pixel holds a third of all rows."""
    crowd = spark.range(30_000).select(
        F.lit(0).cast("long").alias("tile_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("long").alias("row"),
        F.lit(0).cast("long").alias("col"),
        F.lit("B8A").alias("band"),
        F.expr("timestamp_ntz'2023-02-01'").alias("ts"),
        (F.col("id") % 4001).cast("double").alias("value"),
    )
    values = sorted(i % 4001 for i in range(0, 30_000, 3))
    for compose in (composite.median_composite, composite.ranked_composite):
        got = compose(crowd, PRE, POST).where("row = 0").first()["pre_nir"]
        assert got == (values[4999] + values[5000]) / 2


def test_ranked_medians_equal_the_others(spark):
    rows = [
        (0, r, c, band, f"2023-{m:02d}-10", None if (r + m) % 5 == 0 else math.sin(r * 7 + c + m))
        for r in range(3)
        for c in range(3)
        for band in ("B8A", "B12")
        for m in range(1, 13)
    ] + [(0, 9, 9, "B8A", "2023-02-01", None)]
    obs = observations(spark, rows)
    overlapping = DateWindow("2023-03-01", "2023-12-31")
    for post in (POST, overlapping):
        plain = composite.median_composite(obs, PRE, post).collect()
        ranked = composite.ranked_composite(obs, PRE, post).collect()
        assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, ranked), key=str)


def test_overviews_average_valid_pixels(spark):
    rows = [(r, c, None if (r, c) == (0, 0) else float(r * 4 + c)) for r in range(4) for c in range(4)]
    grid = spark.createDataFrame(rows, "row long, col long, rbr double")
    got = {
        (x["level"], x["row"], x["col"]): (x["rbr"], x["pixels"])
        for x in grids.overview_pyramid(grid, 2).collect()
    }
    assert got[(1, 0, 0)] == (10.0 / 3, 3)
    assert got[(1, 1, 1)] == (12.5, 4)
    assert got[(2, 0, 0)] == (sum(range(1, 16)) / 15, 15)


def test_validity_of_products(spark):
    rows = [("good", 0.1), ("good", 0.2), ("empty", None), ("bad", math.inf), ("bad", 0.1)]
    df = spark.createDataFrame(rows, "job_id string, rbr double")
    got = {r["job_id"]: r["status"] for r in grids.product_validity(df, ["rbr"], by=["job_id"]).collect()}
    assert got == {
        "good": "completed",
        "empty": "failed_validation",
        "bad": "failed_validation",
    }
