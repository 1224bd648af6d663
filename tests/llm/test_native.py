"""Quality rules and mixing: against SQL on awkward rows, and their parts by themselves."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from charscape.llm import mixing, oracles, quality
from tests.llm.helpers import SCHEMA, awkward, documents, duck, prose, same, words


def no_python(df) -> bool:
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_quality_agrees_with_sql(spark):
    docs = documents(spark, awkward())
    got = quality.judged(docs)
    assert no_python(got)
    rows = got.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept").collect()
    assert same(rows, duck(oracles.OP3, documents=docs))


def test_base_counts(spark):
    rows = awkward()
    got = quality.judged(documents(spark, rows)).select(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = []
    for _, text, *_ in rows:
        w, seen, lines = words(text), {}, set()
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i:i + 3]), []).append(i)
        covered = {i + d for at in seen.values() if len(at) > 1 for i in at for d in range(3)}
        dup = 0
        for line in (text or "").split("\n"):
            dup += bool(words(line)) and line in lines
            lines.add(line)
        want.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)))
    assert same(got, want)


def test_divergence_rejects_and_keeps(spark):
    clean = [(i, prose(i, 150), "en", "a", 1) for i in range(40)]
    junk = [(100, " ".join(f"{w}%%%" for w in prose(3, 150).split()), "en", "a", 1)]
    foreign = [(101, "Zażółć gęślą jaźń " * 3 + " ".join(f"ł{i}" for i in range(200)), "pl", "a", 1)]
    got = {r.doc_id: r.kept for r in quality.judged(documents(spark, clean + junk + foreign))
           .select("doc.doc_id", "kept").collect()}
    assert all(got[i] for i in range(40)) and not got[100] and got[101]


@pytest.mark.parametrize("listed", [0, 40])
@pytest.mark.parametrize("language_rows", [1000, 2])
def test_languages_without_word_lists_are_judged(spark, listed, language_rows):
    def text(i: int) -> str:
        return " ".join(f"zażółć{w}łąś" for w in prose(i, 150).split())

    rows = [(i, prose(i, 150), "en", "a", 1) for i in range(listed)]
    rows += [(100 + i, text(i), ("pl", "pl", "cs")[i % 3], "a", 1) for i in range(30)]
    rows += [(200 + i, " ".join(f"{w}%%%#" for w in prose(i, 150).split()), lang, "a", 1)
             for i, lang in enumerate(("pl", "cs", "pl"))]
    got = {r.doc_id: r for r in quality.judged(documents(spark, rows), rules=quality.Rules(
        language_rows=language_rows)).select("doc.doc_id", "kept", "class_far", "word_far").collect()}
    assert all(got[i].kept for i in (*range(listed), *range(100, 130)))
    assert all(got[i].class_far and not got[i].word_far and not got[i].kept for i in (200, 201, 202))


def test_quality_of_empty_table_and_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judged(empty).count() == 0
    docs = documents(spark, awkward())
    assert quality.accepted(docs).columns == docs.columns
    assert quality.accepted(empty).count() == 0


def test_distance_is_symmetric_and_bounded(spark):
    row = spark.range(1).select(
        quality.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(3.0))).alias("far"),
        quality.distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0))).alias("same"),
        quality.distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("none")).first()
    assert row.far == pytest.approx(1.0) and row.same == pytest.approx(0.0) and row.none is None


def test_mix_agrees_with_sql(spark):
    docs = documents(spark, awkward())
    got = mixing.taken(docs).collect()
    assert same(got, duck(oracles.OP7, documents=docs))
    assert same(got, mixing.taken(docs.repartition(5)).collect())
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_targets_and_caps(spark):
    rows = [(i, prose(i, 30 + i % 50), "en", f"s{i % 7 if i % 3 else 0}", 1) for i in range(400)]
    rows += [(1000, "tiny one", "en", "a", 1)]
    got = mixing.taken(documents(spark, rows)).withColumn("source", F.lit("")).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert r.taken <= 3 * r["size"]
    for (size, target), listed in by.items():
        assert target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in listed) - target) <= 0.5
    assert sum(t for _, t in by) == pytest.approx(total)


def test_draws_fill_shards_exactly(spark):
    rows = [(i, prose(i, 20 + i % 60), "en", f"s{i % 5}", 1) for i in range(300)]
    mix = mixing.Mix(block_words=64, shard_words=2000)
    draws = mixing.draws(documents(spark, rows), ("doc_id",), mix)
    plan = draws._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and no_python(draws)
    listed = draws.collect()
    drawn = [r for r in listed if r.words]
    assert all(r.shard is not None for r in drawn)
    shards = {}
    for r in drawn:
        shards[r.shard] = shards.get(r.shard, 0) + r.words
    n = -(-sum(shards.values()) // 2000)
    assert len(shards) == n
    assert max(shards.values()) < 1.5 * sum(shards.values()) / n


def test_the_mix_comes_through_the_leaves(spark, monkeypatch):
    docs = documents(spark, [(i, prose(i, 20 + i % 60), "en", f"s{i % 5}", 1) for i in range(100)])
    mix = mixing.Mix(block_words=64, shard_words=2000)
    split, total = mixing.split, lambda: mixing.taken(docs, mix).agg(F.sum("taken")).first()[0]
    whole = total()
    monkeypatch.setattr(mixing, "split", lambda *a: split(*a).where("shard > 0"))
    assert 0 < total() < whole
    monkeypatch.setattr(mixing, "split", lambda *a: split(*a).withColumn(
        "quota", F.transform("quota", lambda q: q * 0)))
    assert total() == 0


def test_the_plan_does_not_grow_with_the_shards(spark):
    """The levels of the splitting tree are written one by one, and the join behind plans none of them."""
    docs = documents(spark, [(i, prose(i, 20 + i % 60), "en", f"s{i % 5}", 1) for i in range(100)])
    one, many = (mixing.draws(docs, ("doc_id",), mixing.Mix(block_words=64, shard_words=n)) for n in (1 << 30, 500))
    assert many.agg(F.max("shard")).first()[0] > 6
    sizes = [len(d._jdf.queryExecution().optimizedPlan().toString()) for d in (one, many)]
    assert sizes[1] < 1.1 * sizes[0] and "log" not in many._jdf.queryExecution().optimizedPlan().toString().lower()


def test_mixed_documents(spark):
    docs = documents(spark, awkward())
    mixed = mixing.mixed(docs, docs.columns)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    taken = sum(r.taken for r in mixing.taken(docs).collect())
    assert sum(len(words(r.text)) for r in rows) == taken
    assert all(r.n_chars == len(r.text) for r in rows)


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([([1000, 0, 37, 500],)], "quota array<long>")
    rows = mixing.split(quotas, 7, "t").collect()
    assert sorted(r.shard for r in rows) == list(range(7))
    assert [sum(r.quota[i] for r in rows) for i in range(4)] == [1000, 0, 37, 500]
    sizes = [sum(r.quota) for r in rows]
    assert max(sizes) - min(sizes) <= 3 and min(min(r.quota) for r in rows) >= 0


def test_hypergeometric_moments(spark):
    n, marked, drawn = 500, 120, 200
    df = spark.range(4000).select(mixing.hypergeometric(
        F.lit(n), F.lit(marked), F.lit(drawn), mixing.uniform(F.col("id"), F.lit("t"))).alias("x"))
    mean, var, low, high = df.agg(F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
    p = marked / n
    assert mean == pytest.approx(drawn * p, rel=0.01)
    assert var == pytest.approx(drawn * p * (1 - p) * (n - drawn) / (n - 1), rel=0.1)
    assert low >= 0 and high <= marked


def test_order_key_is_documented():
    assert hashlib.md5(b"mix:7").hexdigest()[:3]


def test_texts_are_not_stored_once_more(spark, monkeypatch):
    kept, written = mixing.materialise, []

    def noted(df, *rest, **more):
        written.append(df.schema.simpleString())
        return kept(df, *rest, **more)

    monkeypatch.setattr(mixing, "materialise", noted)
    docs = documents(spark, [(i, prose(i, 90), "en", "a", 1) for i in range(50)])
    assert mixing.mixed(docs, docs.columns).count() > 0 and written
    assert not any("text:" in schema for schema in written)
