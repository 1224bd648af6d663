"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Built from DataFrame functions only. The steps:

1. Every document gets a place in its source's permuted stream: documents are ordered by a keyed
   hash, and a document's offset is the number of words before it. The order is cut into 4096
   buckets by the first digits of the hash, so that a source with most rows is ranked by many tasks.
2. Targets: weights repeat over the sources in code point order (NULL last); a target stops at `cap`
   times its source's size, and the excess is reshared by weight.
3. A source's draw is its stream repeated until the target, in words; the last document of a draw is
   cut at a word. The draw is a row of blocks of `block_words` words.
4. The quotas of all sources are split down a binary tree: a node's left half takes a
   multivariate-hypergeometric share. A leaf is an output shard with a quota for every source.
5. Each shard draws its quota of blocks, disjointly, from a permutation of the source's blocks; a
   document copy goes with the block it starts in, and counts only if a shard drew that block. Within a
   shard, copies are shuffled by hash.

Defined cases: NULL texts and texts without words have size 0 and are never drawn; a NULL source is
a source of its own; rows that repeat an id are documents of their own; an empty table gives an empty
result. Extra columns are carried inside the struct `doc` and cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charscape.llm.common import SPACE, WORD, bind, discard, materialise

BUCKET_DIGITS = 3
STEP = 2_147_483_647  # prime above every block count, so that a step permutes the blocks


@dataclass(frozen=True)
class Mix:
    weights: Sequence[int] = (5, 2, 1)
    cap: int = 3
    block_words: int = 4096
    shard_words: int = 4_000_000
    seed: str = "mix"


def sized(docs: DataFrame, carry: Sequence[str], mix: Mix) -> DataFrame:
    """Rows with size, source key, place in the permutation, and the carried columns as `doc`."""
    digest = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("doc_id").cast("string")).cast("binary"))
    return docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("doc"),
        F.coalesce("source", F.lit("")).alias("skey"),
        F.col("source").isNull().alias("snull"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        digest.alias("key"),
        F.xxhash64("text").alias("tie"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per source (`skey`, `snull`, `source_size`): adds `place`, `target` in words.

    Capped sources are the first ones by size per weight: walking in that order, a source is capped
    while its cap lies below its share of what the earlier caps leave.
    """
    by_name = Window.orderBy("snull", "skey")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in mix.weights]),
                          ((F.col("place") % len(mix.weights)) + 1).cast("int"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("weight", weight.cast("long"))
        .withColumns({
            "limit": F.col("source_size") * mix.cap,
            "left_words": F.sum("source_size").over(everything)
            - F.coalesce(F.sum(F.col("source_size") * mix.cap).over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        })
        .withColumn("open", F.col("limit") * F.col("left_weight")
                    >= F.col("left_words") * F.col("weight"))
    )
    # The fewest weights left come last; the first open source has the most weight left.
    first_open = F.max(F.when(F.col("open"), F.struct("left_weight", "left_words"))).over(everything)
    share = ((first_open["left_words"] * F.col("weight")).cast("double")
             / first_open["left_weight"].cast("double"))
    reached = F.col("left_weight") <= first_open["left_weight"]
    return ranked.select(
        "skey", "snull", "place", "source_size",
        F.when(reached, share).otherwise(F.col("limit").cast("double")).alias("target"),
    )


def log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = (x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x)
              + 1 / (12 * x) - 1 / (360 * x * x * x))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(series)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `drawn` out of `total` are marked: the inverse of the distribution at `uniform`.

    Values over ten standard deviations from the mean are left out of the sum.
    """
    share = marked / F.greatest(total, F.lit(1))
    mean = drawn * share
    spread = F.sqrt(F.greatest(mean * (1 - share) * (total - drawn)
                               / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    low = F.greatest(F.lit(0), drawn - (total - marked), F.floor(mean - 10 * spread - 10)).cast("long")
    high = F.least(drawn, marked, F.ceil(mean + 10 * spread + 10)).cast("long")
    mode = F.least(F.greatest(F.round(mean).cast("long"), low), high)

    def weight(x: Column) -> Column:
        return -(log_factorial(x) + log_factorial(marked - x) + log_factorial(drawn - x)
                 + log_factorial(total - marked - drawn + x))

    def pick(masses: Column) -> Column:
        goal = uniform * F.aggregate(masses, F.lit(0.0), lambda a, m: a + m["p"])
        start = F.struct(F.lit(0.0).alias("sum"), low.alias("x"))
        return F.aggregate(
            masses, start,
            lambda a, m: F.struct((a["sum"] + m["p"]).alias("sum"),
                                  F.when(a["sum"] < goal, m["x"]).otherwise(a["x"]).alias("x")),
            lambda a: a["x"],
        )

    masses = bind(weight(mode), lambda top: F.transform(
        F.sequence(low, high),
        lambda x: F.struct(x.alias("x"), F.exp(weight(x) - top).alias("p"))))
    return bind(masses, pick)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return ((F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)).cast("double")


def split(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """The splitting tree. `quotas`: one row, array `quota` by place. Rows: `shard`, `quota`.

    Every level is written before the next: nested in one plan, they would be planned again and again.
    """
    nodes = quotas.select(
        F.lit(0).alias("low"), F.lit(shards).alias("high"), F.col("quota"))
    last = None
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        middle = F.expr("(low + high + 1) div 2").cast("int")

        def walk(level: int = level, middle: Column = middle) -> Column:
            total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, q: a + q)
            drawn = F.floor(total * (middle - F.col("low")) / (F.col("high") - F.col("low"))).cast("long")
            start = F.struct(total.alias("total"), drawn.alias("drawn"),
                             F.array().cast("array<bigint>").alias("left"))

            def step(a: Column, q: Column) -> Column:
                u = uniform(F.lit(seed), F.lit(level), F.col("low"), F.size(a["left"]))
                return bind(
                    hypergeometric(a["total"], q, a["drawn"], u),
                    lambda x: F.struct((a["total"] - q).alias("total"),
                                       (a["drawn"] - x).alias("drawn"),
                                       F.concat(a["left"], F.array(x)).alias("left")))

            return F.aggregate("quota", start, step, lambda a: a["left"])

        halves = nodes.withColumns({"middle": middle, "left": walk()})
        whole = F.col("high") - F.col("low") <= 1
        nodes = halves.select(F.explode(
            F.when(whole, F.array(F.struct("low", "high", "quota"))).otherwise(F.array(
                F.struct("low", F.col("middle").alias("high"), F.col("left").alias("quota")),
                F.struct(F.col("middle").alias("low"), F.col("high"),
                         F.zip_with("quota", "left", lambda q, x: q - x).alias("quota")),
            ))).alias("n")).select("n.*")
        nodes = materialise(nodes, "mix-nodes")
        discard(last)
        last = nodes
    return nodes.select(F.col("low").alias("shard"), "quota")


def draws(docs: DataFrame, carry: Sequence[str] = ("doc_id",), mix: Mix = Mix()) -> DataFrame:
    """Every document's copies in the mix, and one row without a shard if it has none.

    doc, size, source_size, target; row (unique for the document: source key, bucket, rank); copy
    (number of earlier copies), words (words this copy contributes to its shard, from the text's start),
    shard, order (hash that shuffles a shard). Documents are read twice, to size the buckets and to place them, if
    they are carried with their texts, which are not stored once more.
    """
    rows = sized(docs, carry, mix)
    if "text" not in carry:
        rows = materialise(rows, "mix-rows")
    buckets = materialise(
        rows.groupBy("skey", "snull", "bucket").agg(F.sum("size").alias("bucket_words")), "mix-buckets")
    sources = materialise(
        targets(buckets.groupBy("skey", "snull").agg(F.sum("bucket_words").alias("source_size")), mix),
        "mix-targets",
    )
    total = sources.agg(F.sum(F.round("target")).cast("long")).first()[0] or 0
    shards = max(1, -(-total // mix.shard_words))

    goal = F.round("target").cast("long")
    blocks = F.ceil(goal / mix.block_words).cast("long")
    quotas = sources.select(F.struct("place", blocks.alias("n")).alias("q")).agg(
        F.transform(F.sort_array(F.collect_list("q")), lambda q: q["n"]).alias("quota"))
    # Each shard's blocks of each source: consecutive ranks of the source's permuted blocks.
    share = materialise(
        split(quotas, shards, mix.seed)
        .select("shard", F.posexplode("quota").alias("place", "n"))
        .withColumn("first", F.sum("n").over(
            Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("n"))
        .withColumn("n_blocks", F.sum("n").over(Window.partitionBy("place")))
        .where("n > 0")
        .withColumn("rank", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
        .select(F.col("place").cast("long").alias("place"), "shard",
                F.expr(f"(rank * {STEP}L + 7) % n_blocks").alias("block")),
        "mix-share",
    )

    offsets = materialise(
        buckets.join(sources.select("skey", "snull", "place", "source_size", "target"),
                     ["skey", "snull"])
        .withColumn("bucket_start", F.sum("bucket_words").over(
            Window.partitionBy("skey", "snull").orderBy("bucket")
            .rowsBetween(Window.unboundedPreceding, 0)) - F.col("bucket_words"))
        .drop("bucket_words"),
        "mix-offsets",
    )
    inside = Window.partitionBy("skey", "snull", "bucket").orderBy("key", "size", "tie")
    start = F.col("bucket_start") + F.col("before")
    epochs = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0))
    rest = F.col("goal") - F.col("epochs") * F.col("source_size")
    placed = (
        rows.join(offsets, ["skey", "snull", "bucket"])
        .withColumns({
            "rank": F.row_number().over(inside),
            "before": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("size"),
            "goal": goal,
        })
        .withColumn("epochs", epochs)
        .withColumn("start", start)
        .withColumn("extra", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"),
                                                               rest - F.col("start"))))
    )
    copies = F.when(F.col("size") > 0, F.col("epochs")
                    + F.when(F.col("extra") > 0, 1).otherwise(0)).otherwise(0)
    drawn = placed.select(
        "doc", "size", "source_size", "target", "place", "key", "epochs", "extra", "start",
        F.struct("skey", "snull", "bucket", "rank").alias("row"),
        F.explode_outer(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)))
        .alias("copy"),
    ).withColumns({
        "words": F.when(F.col("copy").isNull(), 0)
        .when(F.col("copy") < F.col("epochs"), F.col("size")).otherwise(F.col("extra")).cast("long"),
        "block": F.floor((F.col("copy") * F.col("source_size") + F.col("start"))
                         / mix.block_words).cast("long"),
    })
    # A row without copies has no block; its key keeps such rows apart in the join.
    apart = F.coalesce("block", -F.xxhash64("key", "row") % 65536 - 65537)
    return (
        drawn.withColumn("block", apart).join(share, ["place", "block"], "left")
        # What no shard draws is not in the mix.
        .withColumn("words", F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0).cast("long"))
        .select("doc", "size", "source_size", "target", "row", "copy", "words", "shard",
                F.md5(F.concat_ws(":", F.lit(mix.seed), "copy", "key").cast("binary")).alias("order"))
    )


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words over all shards and copies)."""
    return (
        draws(docs, ("doc_id",), mix)
        .groupBy("row")
        .agg(F.first("doc.doc_id").alias("doc_id"), F.first("size").alias("size"),
             F.first("source_size").alias("source_size"), F.first("target").alias("target"),
             F.sum("words").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed(docs: DataFrame, columns: Sequence[str], mix: Mix = Mix()) -> DataFrame:
    """The mix as documents: one row per copy, shuffled within its shard.

    Copies have the columns of the documents. A source's last copy may be cut: it has the first words
    of its text, joined by single spaces. n_chars, if there, is counted anew.
    """
    cut = F.col("words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(
        F.array_remove(F.split(F.col("doc.text"), SPACE), ""), 1, F.col("words").cast("int")), " ")
    ).otherwise(F.col("doc.text"))
    out = draws(docs, tuple(columns), mix).where("words > 0").withColumn("new_text", text)
    values = {"text": F.col("new_text")}
    if "n_chars" in columns:
        values["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return (
        out.repartition("shard").sortWithinPartitions("shard", "order")
        .select(*[values.get(c, F.col(f"doc.{c}")).alias(c) for c in columns])
    )
