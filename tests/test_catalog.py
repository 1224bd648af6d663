"""Search, linking and checks of the catalogue; parsing of times and documents."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from charscape.functions import geojson, naming, projection, timeparse
from charscape.operators import catalog, categories, sizing
from charscape.schemas import ITEMS
from charscape.sources import readers, sinks
from charscape.sources.workspace import new_path
from charscape.streaming.items import append_batch, append_items_once, not_stored

BOX = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'


def item(identifier, seq, event="e", job="1", product="fire_severity", kind="coarse", day=1):
    return {
        "id": identifier,
        "fire_event_name": event,
        "job_id": job,
        "product_type": product,
        "boundary_type": kind,
        "datetime": f"2024-01-{day:02d}",
        "geometry": BOX,
        "minx": 0.0,
        "miny": 0.0,
        "maxx": 1.0,
        "maxy": 1.0,
        "assets": {"rbr": {"href": f"u{seq}"}},
        "links": [{"rel": "self", "href": "x"}],
        "ingest_seq": seq,
    }


def items(spark, rows):
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string")
    return text.select(F.from_json("v", ITEMS).alias("i")).select("i.*")


def test_newest_breaks_ties_by_arrival(spark):
    df = items(spark, [item("a", 1, day=3), item("a", 2, day=3), item("a", 3, day=2)])
    assert catalog.item_by_id(df, "a").first()["ingest_seq"] == 2


def test_open_intervals(spark):
    df = items(spark, [item("a", d, day=d) for d in range(1, 10)])

    def found(interval):
        rows = catalog.search_by_text(df, "e", interval=interval).collect()
        return sorted(r["ingest_seq"] for r in rows)

    assert found("2024-01-03/2024-01-05") == [3, 4, 5]
    assert found("2024-01-08/..") == [8, 9]
    assert found("../2024-01-02") == [1, 2]
    assert found("2024-01-03") == list(range(1, 10))
    assert found(None) == list(range(1, 10))


def test_a_job_with_most_items(spark):
    rows = [item("e-severity-1", i) for i in range(300)]
    rows += [item(f"e-boundary-{i % 50}", 1000 + i, job=str(i % 50), product="fire_boundary") for i in range(500)]
    rows += [item("e-boundary-1", 5000 + i, product="fire_boundary") for i in range(400)]
    df = items(spark, rows)
    linked = catalog.related_items(df)
    assert linked.count() == 900
    hot = linked.where("job_id = '1'")
    assert hot.count() == 410
    assert {r["related_href"] for r in hot.collect()} == {"u299"}
    assert linked.where("job_id <> '1' and related_id is not null").count() == 0


def test_lookup_join_beyond_the_limit(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"),
        "id",
        F.create_map(F.lit("a"), F.col("id")).alias("m"),
    )
    lookup = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        plain = sorted(facts.join(lookup, "k", how).select("k", "id", "v").collect(), key=str)
        small = sizing.lookup_join(facts, lookup, ["k"], how, limit=10)
        assert sorted(small.select("k", "id", "v").collect(), key=str) == plain


def test_sizes_are_checked_in_rows_and_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), F.lit(1000)).alias("v"))
    assert sizing.fits(wide) and not sizing.fits(wide, rows=9) and not sizing.fits(wide, size=5000)
    maps = spark.range(3).select(F.create_map(F.lit("a"), F.col("id")).alias("m"))
    assert sizing.fits(maps)


def test_encoding_takes_any_columns(spark):
    rows = items(spark, [item("a", 1), item("b", 2, product="fire_boundary"), item("c", 3)])
    for limit in (0, 100):
        got = categories.encode(rows, "product_type", limit=limit)
        assert sorted((r["id"], r["category_id"]) for r in got.collect()) == [
            ("a", 2), ("b", 1), ("c", 2)
        ]


def test_categories_of_one_prefix_are_ranked_by_several_tasks(spark):
    df = spark.range(100_000).select(F.format_string("MapUnit_%06d", "id").alias("name"), "id")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # the names are few bytes
    spark.conf.set(coalesce, "false")
    try:
        ids = categories.category_ids(df, "name")
        tasks = ids.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset(coalesce)
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 60_000
    joined = df.join(ids, "name")
    assert joined.where("category_id <> id + 1").count() == 0 and joined.count() == 100_000


def test_search_bounds_have_zones_and_reject_nonsense(spark):
    df = items(spark, [item("a", d, day=d) for d in range(1, 4)])

    def found(interval):
        rows = catalog.search_by_text(df, "e", interval=interval).collect()
        return sorted(r["ingest_seq"] for r in rows)

    assert found("2024-01-02T05:00:00+05:00/..") == [2, 3]
    assert found("2024-01-02T06:00:00+05:00/..") == [3] or found("2024-01-02T05:00:01+05:00/..") == [3]
    assert found("nonsense/..") == [] and found("../nonsense") == []


def test_category_ids_are_dense_and_ordered(spark):
    names = ["oak", "oat", "ash", "pine", "o", "élan", "oak", None, "pin"]
    df = spark.createDataFrame([(n,) for n in names], "veg_type string")
    got = {r["veg_type"]: r["category_id"] for r in categories.encode(df, "veg_type").collect()}
    kinds = sorted({n for n in names if n}, key=lambda s: s.encode())
    assert got == {**{n: i for i, n in enumerate(kinds, 1)}, None: None}
    assert categories.encode(df, "veg_type", limit=2).count() == len(names)


def test_invalid_items_raise_or_are_set_aside(spark):
    bad = {**item("", 9), "id": None}
    df = items(spark, [item("a", 1), bad])
    with pytest.raises(Exception, match="id missing"):
        sinks.append_items(df, new_path(spark, "items"))
    path, rejects = new_path(spark, "items"), new_path(spark, "rejects")
    sinks.append_items(df, path, rejects)
    assert readers.read_items(spark, path).count() == 1
    assert [r["reason"] for r in spark.read.parquet(rejects).collect()] == ["id missing"]


def test_publishing_needs_items(spark):
    with pytest.raises(Exception):
        sinks.publish_items(spark, new_path(spark, "nothing"), new_path(spark, "target"))


def test_a_failed_publication_leaves_the_old_catalogue(spark):
    source, target = new_path(spark, "items"), new_path(spark, "published")
    assert readers.read_published_items(spark, target).count() == 0
    sinks.append_items(items(spark, [item("a", 1)]), source)
    first = sinks.publish_items(spark, source, target)
    sinks.append_items(items(spark, [item("b", 2)]), source)
    # Files of a version that was never finished, and a file in the source that cannot be read.
    items(spark, [item("half", 3)]).write.partitionBy("fire_event_name").parquet(f"{target}/version-2-half")
    spark.createDataFrame([("no parquet",)], "value string").write.mode("append").text(
        f"{source}/fire_event_name=zz")
    with pytest.raises(Exception):
        sinks.publish_items(spark, source, target)
    assert readers.published_version(spark, target) == (1, first)
    assert [r["id"] for r in readers.read_published_items(spark, target).collect()] == ["a"]
    whole = new_path(spark, "items")
    sinks.append_items(items(spark, [item("a", 1), item("c", 4)]), whole)
    sinks.publish_items(spark, whole, target)
    assert sorted(r["id"] for r in readers.read_published_items(spark, target).collect()) == ["a", "c"]


def test_stream_appends_new_files_once(spark):
    source, target, state, rejects = (new_path(spark, n) for n in ("in", "out", "state", "bad"))

    def arrive(*rows, expect):
        items(spark, list(rows)).write.mode("append").parquet(source)
        append_items_once(spark, source, target, state, rejects)
        got = readers.read_items(spark, target)
        assert sorted((r["id"], r["datetime"].day, r["ingest_seq"]) for r in got.collect()) == expect

    arrive(item("a", 1, day=20), item("a", 1, day=20), item("b", 3, day=20),
           expect=[("a", 20, 1), ("b", 20, 3)])
    append_items_once(spark, source, target, state, rejects)
    # Older items arrive later, as refinements do; a retry of the same time is an attempt of its own.
    arrive(item("a", 4, day=20), item("a", 1, day=20), item("c", 5, day=2), {**item("", 9), "id": None},
           expect=[("a", 20, 1), ("a", 20, 4), ("b", 20, 3), ("c", 2, 5)])
    newest = catalog.latest_items(readers.read_items(spark, target)).where("id = 'a'")
    assert [r["ingest_seq"] for r in newest.collect()] == [4]
    assert [r["reason"] for r in spark.read.parquet(rejects).collect()] == ["id missing"]


def test_replayed_batches_add_nothing(spark):
    target, rejects, ledger = (new_path(spark, n) for n in ("out", "bad", "batches"))
    batch = items(spark, [item("a", 1), {**item("", 9), "id": None}, {**item("", 8), "id": None}])

    def counts():
        return readers.read_items(spark, target).count(), spark.read.parquet(rejects).count()

    append_batch(batch, 0, "s", target, rejects, ledger)
    assert counts() == (1, 2)
    # The ledger was lost after both tables had been written.
    append_batch(batch, 0, "s", target, rejects, new_path(spark, "batches"))
    assert counts() == (1, 2)
    # A finished batch is not looked at again; a batch of another stream is.
    append_batch(items(spark, [item("b", 2)]), 0, "s", target, rejects, ledger)
    assert counts() == (1, 2)
    append_batch(items(spark, [item("b", 2)]), 0, "other", target, rejects, ledger)
    assert counts() == (2, 2)


def test_stream_and_batches_share_a_catalogue(spark):
    source, target, state, rejects = (new_path(spark, n) for n in ("in", "out", "state", "bad"))
    sinks.append_items(items(spark, [item("a", 1), item("b", 2)]), target)
    items(spark, [item("c", 3), item("a", 1)]).write.parquet(source)
    append_items_once(spark, source, target, state, rejects)
    sinks.append_items(items(spark, [item("d", 4)]), target)
    got = readers.read_items(spark, target)
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "c", "d"]
    # A batch that is replayed adds nothing.
    replay = not_stored(items(spark, [item("c", 3), item("e", 5)]), readers.read_items(spark, target))
    assert [r["id"] for r in replay.collect()] == ["e"]


def test_features_are_json(spark):
    df = items(spark, [item("a", 1, kind=None)])
    text = df.select(geojson.item_feature_text(set(df.columns)).alias("f")).first()["f"]
    feature = json.loads(text)
    assert feature["properties"]["datetime"] == "2024-01-01T00:00:00Z"
    assert "boundary_type" not in feature["properties"]
    assert feature["bbox"] == [0.0, 0.0, 1.0, 1.0] and feature["geometry"]["type"] == "Polygon"


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_moments_are_utc_in_any_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-03-10T02:30:00Z", "2024-03-10T04:30:00+02:00", "2024-03-10", "soon", ""]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [
            str(r[0]) for r in df.select(timeparse.parse_moment(F.col("t"))).collect()
        ]
        assert got == [
            "2024-03-10 02:30:00",
            "2024-03-10 02:30:00",
            "2024-03-10 00:00:00",
            "None",
            "None",
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rejected_documents_say_why(spark):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    hole = [[0.2, 0.1], [0.4, 0.1], [0.4, 0.2], [0.2, 0.1]]
    cases = {
        json.dumps({"type": "Polygon", "coordinates": [ring, hole]}): None,
        json.dumps({"type": "Polygon", "coordinates": [[p + [5.0] for p in ring]]}): None,
        json.dumps({"properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}): None,
        json.dumps({"type": "Polygon", "coordinates": []}): geojson.NO_COORDINATES,
        json.dumps({"type": "Polygon", "coordinates": "x"}): geojson.NO_COORDINATES,
        json.dumps({"type": "Polygon", "coordinates": [ring[:3]]}): geojson.SHORT_RING,
        json.dumps({"type": "Polygon", "coordinates": [ring[:3] + [[9, 9]]]}): geojson.OPEN_RING,
        json.dumps({"type": "Polygon", "coordinates": [[[0], [1], [1], [0]]]}): geojson.SHORT_POSITION,
        json.dumps({"type": "Point", "coordinates": [0, 0]}): geojson.NOT_POLYGON,
        json.dumps([1, 2]): geojson.NOT_POLYGON,
        "{": geojson.MALFORMED,
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r["text"]: r["reason"] for r in geojson.parse_polygons(df).collect()}
    assert got == cases


def test_projection_known_point_and_round_trip(spark):
    # A tower in zone 17, whose grid coordinates are widely published.
    df = spark.createDataFrame([(-79.387139, 43.642567)], "lon double, lat double")
    x, y = projection.utm_forward(F.col("lon"), F.col("lat"), 17)
    there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    row = there.first()
    assert (round(row["x"]), round(row["y"])) == (630084, 4833439) or (
        math.isclose(row["x"], 630084, abs_tol=1.5) and math.isclose(row["y"], 4833438, abs_tol=1.5)
    )
    grid = spark.range(200).select(
        (F.lit(-119.9) + F.col("id") * 0.029).alias("lon"), (F.col("id") * 0.4).alias("lat")
    )
    x, y = projection.utm_forward(F.col("lon"), F.col("lat"))
    back = projection.with_utm_inverse(
        grid.select("lon", "lat", x.alias("x"), y.alias("y")), F.col("x"), F.col("y"), "lon2", "lat2"
    )
    worst = back.agg(
        F.max(F.abs(F.col("lon2") - F.col("lon"))), F.max(F.abs(F.col("lat2") - F.col("lat")))
    ).first()
    assert max(worst) < 1e-11


def test_names(spark):
    df = spark.createDataFrame([("creek", "7", "COARSE edge")], "e string, j string, b string")
    row = df.select(
        naming.capitalised(F.col("b")).alias("t"),
        naming.severity_item_url("https://c", F.col("e"), F.col("j")).alias("u"),
        naming.product_url("https://s/", F.col("e"), F.col("j"), "rbr.tif").alias("p"),
    ).first()
    assert tuple(row) == (
        "Coarse edge",
        "https://c/creek/items/creek-severity-7.json",
        "https://s/creek/7/rbr.tif",
    )
