"""Sharding: equal bytes, whole groups, gapless slots, ranges that never crowd."""

from __future__ import annotations

import tempfile
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from charscape.llm import sharding
from tests.llm.helpers import awkward, documents, prose


def size(text: str | None) -> int:
    return len((text or "").encode()) + 1


def loads(rows) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


def check(rows, given) -> None:
    assert len(rows) == len(given)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in given)
    assert want == sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows)


def test_awkward_rows(spark):
    got = sharding.located(documents(spark, awkward())).collect()
    check(got, awkward())
    assert {r["law"] for r in got} == {"bytes"}
    assert {r["grown_shard"] for r in got} == {None}
    assert sharding.located(documents(spark, [])).count() == 0
    assert sharding.located(documents(spark, [(1, None, None, None, None)])).first()["slot"] == 0


def crowded() -> list[tuple]:
    """A third of all rows are copies of one text, a few texts are long, many have a few copies."""
    rows = [(i, prose(i % 400, 60 + i % 50), "en", "a", 1) for i in range(1200)]
    rows += [(5000 + i, prose(7777, 90), "en", "hot", 1) for i in range(700)]
    rows += [(9000 + i, prose(9000 + i, 3000), "en", "b", 1) for i in range(4)]
    rows += [(9990, "same row", "en", "b", 1)] * 300
    rows += [(20_000 + i, None if i % 2 else "", "en", "c", 0) for i in range(500)]
    return rows


@pytest.mark.parametrize("shards", [2, 16])
def test_bytes_are_nearly_equal_and_small_groups_whole(spark, shards):
    rows = crowded()
    got = sharding.located(documents(spark, rows), sharding.Settings(shards=shards, range_rows=100)).collect()
    check(got, rows)
    held = loads(got)
    mean = sum(held.values()) / shards
    assert len(held) == shards
    assert max(held.values()) <= 1.05 * mean and min(held.values()) >= 0.95 * mean
    texts = {i: t for i, t, *_ in rows}
    copies, where = defaultdict(int), defaultdict(set)
    for r in got:
        copies[texts[r["doc_id"]]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    for text, shard_set in where.items():
        assert len(shard_set) == 1 or copies[text] > mean / 8
    assert len(where[prose(7777, 90)]) > 1 or shards == 2


def test_same_result_whatever_the_ranges(spark):
    df = documents(spark, [r for r in crowded() if r[0] != 9990])
    seen = {
        frozenset((r["doc_id"], r["shard"], r["slot"]) for r in sharding.located(
            df.repartition(parts), sharding.Settings(
                range_rows=400, ranges_per_shard=ranges, drawn_per_range=drawn)).collect())
        for parts, ranges, drawn in ((1, 1, 2), (5, 16, 16), (3, 4, 64))}
    assert len(seen) == 1


def test_ranges_hold_a_bounded_number_of_rows(spark):
    settings = sharding.Settings(range_rows=100, ranges_per_shard=1, drawn_per_range=4)
    rows = sharding.sized(documents(spark, crowded()), ("doc_id",)).cache()
    found = rows.agg(F.sum("size"), F.count("*")).first()
    limit = found[0] // (sharding.SHARE * settings.shards)
    _, of = sharding.dealt(sharding.listed(rows, limit, settings), found[0], limit, settings.shards)
    placed = sharding.placed(rows, of).cache()
    bounds = sharding.splitters(placed, found[0], found[1], settings)
    held = placed.groupBy(sharding.range_of(F.col("place"), bounds).alias("r")).count().collect()
    assert sum(r["count"] for r in held) == len(crowded())
    assert max(r["count"] for r in held) <= 200
    assert bounds == sorted(set(bounds))


def test_range_of_is_a_binary_search(spark):
    bounds = [bytes([b]) for b in (3, 7, 7, 9, 200)]
    df = spark.createDataFrame([(bytearray([i]),) for i in range(256)], "place binary")
    got = df.select("place", sharding.range_of(F.col("place"), bounds).alias("r")).collect()
    for row in got:
        assert row["r"] == sum(1 for b in bounds if b <= bytes(row["place"]))


def test_rooms_fill_up_to_one_level():
    for held, rest in (([0, 0, 0], 9), ([5, 0, 1], 4), ([9, 9, 0, 0], 3), ([0, 4], 0)):
        k, edges = sharding.rooms(held, rest)
        bounds = [0, *[e / 2 / k for e in edges], rest]
        final = [x + bounds[i + 1] - bounds[i] for i, x in enumerate(held)]
        assert sum(final) == sum(held) + rest
        if rest:
            level = max(f for f, x in zip(final, held, strict=True) if f > x)
            assert all(abs(f - level) < 1e-9 or f == x >= level for f, x in zip(final, held, strict=True))


def test_written_shards_hold_all_rows_in_slot_order(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/shards"
    rows = [r for r in crowded() if r[0] < 6000]
    df = documents(spark, rows, clashing=False)
    sharding.write_shards(df, path, sharding.Settings(shards=4))
    back = spark.read.parquet(path)
    assert back.count() == len(rows)
    where = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.located(df, sharding.Settings(shards=4)).collect()}
    assert all(where[r["doc_id"]] == (r["_shard"], r["_slot"]) for r in back.collect())
