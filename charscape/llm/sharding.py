"""Sharding into parts of nearly equal bytes, by sampled splitters.

Built from DataFrame functions only. Rows are ordered by the digest of their text, so that equal texts
lie together, and the order is cut where the shards are full:

1. A row's size is the bytes of its text plus one. Texts whose copies together hold more than 1/SHARE of a
   shard, or more rows than one range should, are listed: fewer than SHARE for each shard, and one for each
   `range_rows` rows. Their rows are told apart by the digest of their id; the copies of any other text
   share one place in the order.
2. Listed texts are dealt first, the largest to the emptiest shard, all copies of a text together. Where
   that would overfill a shard, texts of over 1/2 of a shard, or 1/4 and so on, are parted: into rows dealt
   one by one, or into the order, if a row is at most 1/SHARE of a shard. No other text is ever parted.
3. Splitters: rows are drawn with a chance in proportion to their size, and quantiles of the drawn places,
   each weighed by its inverse chance, divide the order into ranges. Ranges that turn out to hold over
   twice their share of bytes or rows are drawn from again, more densely, and subdivided.
4. What room the dealt texts leave is what the order has to fill: bytes are summed within each range, and a
   place goes to the shard in whose room its middle lies.
5. Slots: a row's rank within its range and shard, plus the rows of the shard in earlier ranges.

Ranges decide which task counts what, but not the result: it is the same in every run, however rows are dealt
to tasks (`range_rows` only adds to the listed texts). No shard
or crowded text is ever gathered in one task: a task has one range, of `range_rows` rows or so.

Defined cases: NULL texts and empty ones have size 1 and are two different texts; rows that repeat an id
and text are rows of their own, placed side by side; rows without an id come first among their copies;
fewer rows than shards leave some shards empty; an empty table gives an empty result. Extra columns
are carried inside the struct `doc` and cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charscape.llm.common import materialise

SHARE = 64


@dataclass(frozen=True)
class Settings:
    shards: int = 16
    range_rows: int = 1_000_000
    ranges_per_shard: int = 16
    drawn_per_range: int = 16


def sized(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """size, text_crc32, the text's digest (a leading zero byte marks NULL) and the id's, and `doc`."""
    text = F.coalesce("text", F.lit(""))
    mark = F.when(F.col("text").isNull(), F.lit(b"\0")).otherwise(F.lit(b"\1"))
    number = F.monotonically_increasing_id()
    return docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("doc"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(mark, F.unhex(F.md5(text.cast("binary")))).alias("text_key"),
        F.coalesce(F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary"))), F.lit(b"")).alias("id_key"),
        F.unhex(F.lpad(F.hex(number), 16, "0")).alias("row_key"),
    )


@dataclass(frozen=True)
class Text:
    """A listed text: its digest, the bytes and number of its copies."""

    key: bytes
    size: int
    copies: int


def listed(rows: DataFrame, limit: int, settings: Settings) -> list[Text]:
    found = rows.groupBy("text_key").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where(
        (F.col("b") > limit) | (F.col("n") > settings.range_rows)).collect()
    return [Text(bytes(r["text_key"]), r["b"], r["n"]) for r in found]


def dealt(texts: list[Text], total: int, limit: int, shards: int) -> tuple[list[int], dict[bytes, list[int]]]:
    """Loads of the shards, and the shards of each listed text: one for all copies, one for each, or none."""
    share = 2
    while True:
        units = []
        for t in texts:
            if t.size * shards * share <= total or share == SHARE and t.size <= limit:
                units.append((-t.size, t.key))
            elif t.size // t.copies > limit:
                units.extend([(-(t.size // t.copies), t.key)] * t.copies)
        heap = [(0, s) for s in range(shards)]
        of: dict[bytes, list[int]] = {t.key: [] for t in texts}
        for minus, key in sorted(units):
            load, shard = heapq.heappop(heap)
            of[key].append(shard)
            heapq.heappush(heap, (load - minus, shard))
        if share == SHARE or max(heap)[0] * shards * SHARE <= total * (SHARE + 1):
            return [load for load, _ in sorted(heap, key=lambda x: x[1])], of
        share *= 2


def placed(rows: DataFrame, of: dict[bytes, list[int]]) -> DataFrame:
    """Adds `place` as binary, for listed texts with the id's digest, and `shard` where it is dealt."""
    texts = rows.sparkSession.createDataFrame(
        [(bytearray(k), v) for k, v in of.items()], "text_key binary, shards array<int>")
    # As many rows as listed texts.
    known = rows.join(F.broadcast(texts), "text_key", "left").withColumn(
        "place", F.when(F.col("shards").isNotNull(), F.concat("text_key", "id_key", "row_key"))
        .otherwise(F.col("text_key")))
    single = F.coalesce(F.size("shards") > 1, F.lit(False))
    # Fewer than SHARE rows for each shard.
    alone = known.where(single).withColumn("shard", F.get("shards", F.row_number().over(
        Window.partitionBy("text_key").orderBy("place")) - 1))
    return known.where(~single).withColumn("shard", F.get("shards", F.lit(0))).unionByName(alone).drop("shards")


def range_of(place: Column, splitters: list[bytes]) -> Column:
    """How many splitters are at or before a place: a binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    bounds = F.array(*[F.lit(s) for s in splitters])
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: at + F.when(F.coalesce(F.get(bounds, at + step - 1) <= place, F.lit(False)), step)
        .otherwise(0))


def quantiles(drawn: list[tuple[bytes, float]], parts: int) -> list[bytes]:
    """Places that divide the drawn weight into equal parts."""
    drawn = sorted(drawn)
    total, before, out = sum(w for _, w in drawn), 0.0, []
    for place, weight in drawn:
        # The first place whose weight ends at or behind the next quantile opens a range.
        if parts * before >= total * (len(out) + 1) and (not out or place > out[-1]):
            out.append(place)
        before += weight
    return out


def splitters(rows: DataFrame, total: int, count: int, settings: Settings) -> list[bytes]:
    """Places between the ranges, from size-weighted samples.

    A draw brings about `drawn_per_range` places a range to the driver: 33 bytes each.
    """
    ranges = max(settings.shards * settings.ranges_per_shard, -(-count // settings.range_rows))
    share_bytes, share_rows = max(1, total // ranges), max(1, count // ranges)
    found: list[bytes] = []
    crowded: list[dict] | None = None
    draw = 0
    while True:
        uniform = F.pmod(F.xxhash64("place", "row_key", F.lit(draw)), F.lit(1 << 40)) / float(1 << 40)
        if crowded is None:
            chance = F.least(F.lit(1.0), F.col("size") * (ranges * settings.drawn_per_range / max(1, total)))
            drawn = rows.where(uniform < chance).select("place", (F.col("size") / chance).alias("w")).collect()
            found = quantiles([(bytes(r["place"]), r["w"]) for r in drawn], ranges)
        else:
            numbers = F.array(*[F.lit(r["range"]) for r in crowded])
            # Denser by what a range holds too much of; rows count like bytes of an average row.
            weight = F.col("size") + F.lit(total / max(1, count))
            chance = F.least(F.lit(1.0), weight * (settings.drawn_per_range * (draw + 1)
                                                   / (share_bytes + share_rows * total / max(1, count))))
            drawn = rows.withColumn("range", range_of(F.col("place"), found)).where(
                F.array_contains(numbers, F.col("range")) & (uniform < chance)).select(
                "range", "place", (weight / chance).alias("w")).collect()
            new: set[bytes] = set()
            for r in crowded:
                own = [(bytes(d["place"]), d["w"]) for d in drawn if d["range"] == r["range"]]
                parts = max(2, -(-r["b"] // share_bytes), -(-r["n"] // share_rows))
                new |= set(quantiles(own, int(parts)))
            found = sorted(set(found) | new)
        held = rows.groupBy(range_of(F.col("place"), found).alias("range")).agg(
            F.sum("size").alias("b"), F.count("*").alias("n"), F.min("place").alias("low"),
            F.max("place").alias("high")).collect()
        crowded = [r.asDict() for r in held
                   if (r["b"] > 2 * share_bytes or r["n"] > 2 * max(share_rows, settings.range_rows))
                   and r["low"] != r["high"]]
        draw += 1
        # With every row of a range drawn, what is left are places that nothing divides.
        if not crowded or draw > 8:
            return found


def rooms(loads: Sequence[int], rest: int) -> tuple[int, list[int]]:
    """(k, edges): a place of middle m / 2 goes to the shard numbered by the edges at or below k * m.

    Shards are filled up to one level; k of them lie below it, and the others get nothing more.
    """
    low = sorted(loads)
    k = max(i for i in range(1, len(low) + 1) if rest + sum(low[:i]) > low[i - 1] * i or i == 1)
    level = rest + sum(low[:k])  # times 1 / k
    edges, filled = [], 0
    for load in loads[:-1]:
        filled += max(0, level - k * load)
        edges.append(2 * filled)
    return k, edges


def assigned(docs: DataFrame, carry: Sequence[str] = ("doc_id",), settings: Settings = Settings()) -> DataFrame:
    """doc, size, text_crc32, shard, slot."""
    rows = materialise(sized(docs, carry), "shard-rows")
    whole = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, count = whole["b"] or 0, whole["n"]
    limit = total // (SHARE * settings.shards)
    loads, of = dealt(listed(rows, limit, settings), total, limit, settings.shards)
    rows = materialise(placed(rows, of), "shard-places")
    k, edges = rooms(loads, total - sum(loads))
    bounds = splitters(rows, total, count, settings)

    # What the order fills: bytes of rows that were not dealt.
    ranged = rows.withColumn("range", range_of(F.col("place"), bounds)).withColumn(
        "fill", F.when(F.col("shard").isNull(), F.col("size")).otherwise(0))
    # One row per range.
    ahead = ranged.groupBy("range").agg(F.sum("fill").alias("b")).select(
        "range", (F.sum("b").over(Window.orderBy("range")) - F.col("b")).alias("ahead"))
    upto = Window.partitionBy("range").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    same_place = Window.partitionBy("range", "place")
    middle = (2 * (F.col("ahead") + F.sum("fill").over(upto)) - F.sum("fill").over(same_place)) * k
    number = F.lit(0)
    for edge in edges:
        number = number + (F.col("middle") >= edge).cast("int")
    spread = ranged.join(F.broadcast(ahead), "range").withColumn("middle", middle).withColumn(
        "shard", F.coalesce("shard", number))

    per = Window.partitionBy("range", "shard").orderBy("place", "id_key", "row_key")
    ranked = materialise(spread.select(
        "doc", "size", "text_crc32", "range", "shard", F.row_number().over(per).cast("long").alias("rank")),
        "shard-ranks")
    # At most a row per range and shard.
    earlier = Window.partitionBy("shard").orderBy("range")
    bases = ranked.groupBy("range", "shard").agg(F.count("*").alias("n")).select(
        "range", "shard", (F.sum("n").over(earlier) - F.col("n")).alias("base"))
    return ranked.join(F.broadcast(bases), ["range", "shard"]).select(
        "doc", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, settings: Settings = Settings()) -> None:
    """Whole rows as Parquet, a folder per shard; files of a shard hold slots in ascending order."""
    out = assigned(docs, docs.columns, settings).select("doc.*", F.col("shard").alias("_shard"),
                                                        F.col("slot").alias("_slot"))
    out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy(
        "_shard").parquet(path)


def located(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The registered form: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return assigned(docs, ("doc_id",), settings).select(
        "doc.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
