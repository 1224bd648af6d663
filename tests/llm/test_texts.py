"""Near-duplicates, repeated substrings, tokens and the pipeline: against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from charscape.llm import bpe, graph, hashing, induced, minhash, mixing, oracles, suffix
from charscape.llm.common import materialise
from charscape.llm.queries import tokenizer_path
from tests.llm.helpers import (
    SCHEMA, awkward, components, cut_repeats, documents, duck, prose, same, shingles,
)


# --- Near-duplicates -------------------------------------------------------------------------------


def near_rows() -> list[tuple]:
    rnd, rows = random.Random(2), []
    for family in range(6):
        base = [f"v{rnd.randrange(3000)}" for _ in range(60 + 20 * family)]
        for k in range(14):
            rows.append((len(rows), " ".join(base), "en", "a", 1))
            # A chain: each text differs a little from the last one.
            base = list(base)
            for _ in range(1 + k % 3):
                base[rnd.randrange(len(base))] = f"u{rnd.randrange(3000)}"
    rnd.shuffle(rows)
    return rows + [(i and i + 1000, *rest) for i, *rest in awkward()]


@pytest.mark.parametrize("n", [2, 5])
def test_groups_agree_with_all_pairs(spark, n):
    rows = near_rows()
    got = minhash.groups(documents(spark, rows), minhash.Settings(words=n)).collect()
    sets = [shingles(r[1], n) for r in rows]
    root = components(sets)
    least = {}
    for r, c in zip(rows, root, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = [(r[0], len(s), least.get(c), r[0] == least.get(c))
            for r, s, c in zip(rows, sets, root, strict=True)]
    assert same(got, want)


def test_representatives(spark):
    docs = documents(spark, near_rows())
    kept = minhash.representatives(docs, minhash.Settings(words=2))
    assert kept.columns == docs.columns
    left = [shingles(r.text, 2) for r in kept.collect()]
    assert components(left) == list(range(len(left)))
    every = [shingles(r.text, 2) for r in docs.collect()]
    assert len([s for s in left if s]) == len({c for c, s in zip(components(every), every, strict=True) if s})
    assert minhash.representatives(documents(spark, [])).count() == 0


def family_rows(n: int) -> list[tuple]:
    """An original and copies with up to 14 of its 120 words changed, some of them changed copies of copies."""
    rnd = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    texts = [base]
    for k in range(n):
        copy = list(base if k % 4 else rnd.choice(texts))
        for _ in range(1 + k % 14):
            copy[rnd.randrange(120)] = f"u{rnd.randrange(9000)}"
        texts.append(copy)
    return [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]


def test_a_family_around_one_original(spark):
    rows = family_rows(400)
    sets = [shingles(r[1], 2) for r in rows]
    want = components(sets)
    got = minhash.groups(documents(spark, rows), minhash.Settings(words=2)).collect()
    assert len(set(want)) > 20  # many stay just below the limit
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_likely_pairs_lose_no_link(spark):
    """Nodes beyond the limit meet linked ones only if these share what they differ in from the pivot."""
    sets = [shingles(r[1], 2) for r in family_rows(400)]
    names = {e: i for i, e in enumerate(sorted({e for s in sets for e in s}))}
    coded = [(i, np.sort(np.array([names[e] for e in s], np.uint64)).tobytes()) for i, s in enumerate(sets)]

    def linked(a, b):
        return 100 * len(a & b) >= 80 * len(a | b)

    pairs = []
    for i, s in enumerate(sets[1:], 1):
        union, size = len(s | sets[0]), len(s ^ sets[0])
        if size <= 0.4 * union:
            pairs.append((0, i, linked(s, sets[0]), size, size - 0.2 * union))
    near, far = [p[1] for p in pairs if p[2]], [p[1] for p in pairs if not p[2]]
    got = minhash.likely(minhash.differences(
        spark.createDataFrame(pairs, "a long, b long, linked boolean, size long, excess double"),
        spark.createDataFrame(coded, "node long, elements binary")), 0.2).collect()
    links = {(a, b) for a in near for b in far if linked(sets[a], sets[b])}
    assert links and links <= {(r.a, r.b) for r in got}
    assert len(got) < len(near) * len(far) / 50


def test_far_copies_are_not_compared_with_each_other(spark, monkeypatch):
    """Copies below the limit from their original share buckets without links, but for eight families of four."""
    rnd, rows = random.Random(7), []
    base = [f"v{i}" for i in range(400)]

    def changed(words: list[str], n: int) -> list[str]:
        words = list(words)
        for at in rnd.sample(range(len(words)), n):
            words[at] = f"u{rnd.randrange(10 ** 9)}"
        return words

    rows.append((0, " ".join(base), "en", "a", 1))
    for i in range(1, 129):
        rows.append((i, " ".join(changed(base, 36)), "en", "a", 1))
    for i in range(8):
        middle = changed(base, 36)
        rows += [(129 + 4 * i + k, " ".join(changed(middle, 8)), "en", "a", 1) for k in range(4)]
    compared, pairs = minhash.compared, []

    def counted(wanted, sets):
        pairs.append(wanted.count())
        return compared(wanted, sets)

    monkeypatch.setattr(minhash, "compared", counted)
    got = minhash.groups(documents(spark, rows), minhash.Settings(words=2)).collect()
    want = components([shingles(r[1], 2) for r in rows])
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    assert len(set(want[129:])) == 8
    assert sum(pairs) < 10 * len(rows)


def test_a_crowd_of_copies_takes_few_jobs(spark, monkeypatch):
    """Tables written for a family whose copies are linked only through each other, and the links found."""
    written = []

    def counted(df, name, texts=False):
        written.append(name)
        return materialise(df, name, texts)

    for module in (minhash, graph):
        monkeypatch.setattr(module, "materialise", counted)
    rows = family_rows(400)
    got = minhash.groups(documents(spark, rows), minhash.Settings(words=2)).collect()
    want = components([shingles(r[1], 2) for r in rows])
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    rounds = written.count("minhash-pairs")
    assert rounds and written.count("components") <= 2 * rounds  # of links found, and of those found by them
    assert len(written) <= 6 + 12 * rounds


@pytest.mark.parametrize("at_once", [0, 1 << 18])
def test_components_of_few_and_of_many_links(spark, at_once):
    edges = [(i, i + 1) for i in range(0, 90) if i % 30] + [(300, 200 + i) for i in range(40)] + [(5, 5)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {tuple(r) for r in graph.components(table, at_once).collect()}
    assert got == {(i, i // 30 * 30 + 1) for i in range(91) if i % 30 or i == 30 or i == 60 or i == 90
                   } - {(30, 31), (60, 61), (90, 91)} | {(30, 1), (60, 31), (90, 61)} | {
                       (x, 200) for x in [300, *range(200, 240)]}


def test_compared_gives_what_sets_differ_in(spark):
    sets = spark.createDataFrame([(1, np.array([1, 2, 3], np.uint64).tobytes()),
                                  (2, np.array([2, 3, 4, 5], np.uint64).tobytes())], "node long, elements binary")
    pairs = spark.createDataFrame([(1, 2, 1.0)], "a long, b long, reach double")
    row = minhash.compared(pairs, sets).first()
    assert tuple(row)[:5] == (1, 2, 2, 5, 4) and np.frombuffer(row.only, np.uint64).tolist() == [1, 4, 5]
    assert minhash.compared(pairs.withColumn("reach", pairs.reach / 2), sets).first().only is None


def test_no_links_and_no_rows(spark):
    assert minhash.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = minhash.groups(documents(spark, [(1, "a b c", "", "", 1), (2, "d e f", "", "", 1)])).collect()
    assert same(alone, [(1, 1, 1, True), (2, 1, 2, True)])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 2**63, int(200 * share)).astype(np.uint64)
            one = rng.integers(0, 2**63, 200 - len(both)).astype(np.uint64)
            two = rng.integers(0, 2**63, 200 - len(both)).astype(np.uint64)
            sets = [np.concatenate([both, x]) for x in (one, two)]
            sig = [minhash.signatures(np.zeros(len(s), np.int64), s, 1, 200)[0] for s in sets]
            errors.append((sig[0] == sig[1]).mean() - len(both) / (400 - len(both)))
        assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rnd.randrange(80), 200 + rnd.randrange(80))
                                               for _ in range(70)] + [(500, 400 + i) for i in range(50)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# --- Suffix arrays ---------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40), st.integers(1, 3))
def test_suffix_array_and_prefixes(items, times):
    s = items * times + [0]
    order = induced.suffix_array(np.array(s))
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert order.tolist() == want
    shared = induced.common_prefixes(np.array(s), order)
    for x, y in zip(want[1:], want, strict=False):
        n = 0
        while x + n < len(s) and y + n < len(s) and s[x + n] == s[y + n]:
            n += 1
        assert shared[x] == n


def repeat_rows() -> list[tuple]:
    passage = prose(77, 25)
    rows = [(i, prose(i, 40) + " " + passage + " " + prose(i + 50, 30), "en", "a", 1) for i in range(20)]
    rows += [(50, "é" * 24 + "x" * 60, "en", "a", 1), (51, "zé" + "x" * 60 + "é" * 30, "en", "a", 1),
             (52, "x" * 300, "en", "a", 1), (53, "ab" * 90, "en", "a", 1), (54, "ba" * 40, "en", "a", 1)]
    return rows + awkward()


def test_removal_agrees_with_brute_force(spark):
    rows = repeat_rows()
    small = suffix.Settings(block_bytes=3000, key_shard_bytes=4000, text_shard_bytes=2000)
    for chosen in (suffix.Settings(), small):
        got = suffix.deduplicated(documents(spark, rows), settings=chosen).collect()
        want = cut_repeats([r[:2] for r in rows])
        assert same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got],
                    [(r[0], *w) for r, w in zip(rows, want, strict=True)])


def test_a_phrase_in_many_contexts_is_spread(spark):
    rnd = random.Random(5)

    def noise(n: int) -> str:
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    # The phrase with the least hash is the key of nearly all strings around it.
    phrase = min((noise(16) for _ in range(3000)), key=lambda x: hashing.grams(
        hashing.prefix_sums(np.frombuffer(x.encode(), np.uint8)), 16)[0])
    tails = [noise(40) for _ in range(30)]
    rows = [(i, noise(60) + phrase + (tails[i % 60] if i % 60 < 30 else noise(40)), "en", "a", 1)
            for i in range(900)]
    docs = documents(spark, rows)
    chosen = suffix.Settings(block_bytes=3000, key_shard_bytes=40_000, text_shard_bytes=2000,
                             crowded_bytes=2000)
    got = suffix.deduplicated(docs, settings=chosen).collect()
    assert same([(r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in got],
                [(r[0], *w[1:]) for r, w in zip(rows, cut_repeats([r[:2] for r in rows]), strict=True)])
    assert sum(r.n_removed for r in got) > 0
    # No shard holds the contexts of the phrase together.
    blocks = materialise(suffix.packed(docs.select("doc_id", "text"), chosen, None), "test-blocks")
    replies = suffix.all_replies(blocks, chosen, 8)
    by_shard = {}
    for r in suffix.shared_texts(blocks, replies, chosen, 8, 16).collect():
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.n
    assert max(by_shard.values()) < 4 * sum(by_shard.values()) / 16


def test_shortened_documents(spark):
    docs = documents(spark, repeat_rows())
    out = suffix.shortened(docs)
    assert out.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert suffix.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffix.shortened(spark.createDataFrame([], SCHEMA)).count() == 0


# --- Tokens ----------------------------------------------------------------------------------------


def test_joined_pieces_are_the_whole_encoding():
    path, rnd = tokenizer_path(), random.Random(9)
    model = bpe.tokenizer(path)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "aB1 ,.'\n", "  \t\nx'rest", "éß漢字😀a ", "'s're'll", "01"]
    for _ in range(250):
        letters = rnd.choice(alphabets)
        text = "".join(rnd.choice(letters) if rnd.random() < 0.9 else
                       rnd.choice(["<|endoftext|>", "'ll", "   ", "the", "ing"])
                       for _ in range(rnd.choice([5, 60, 300, 1500])))
        if rnd.random() < 0.3:
            text = "".join(text.split())
        size = rnd.choice([3, 7, 17, 50, 111, 400])
        pieces = [bpe.encode_piece(path, text[i:i + size], i) for i in range(0, len(text), size)]
        if pieces:
            assert bpe.join_all(path, text, pieces).tolist() == model.encode(
                text, add_special_tokens=False).ids


def test_encoding_and_decoding(spark):
    path = tokenizer_path()
    model = bpe.tokenizer(path)
    rnd = random.Random(1)
    rows = awkward() + [
        (60, "x<|endoftext|>" * 3000, "", "", 1), (61, "".join(rnd.choice("abcdeo") for _ in range(70_000)), "", "", 1),
        (61, "word " * 9000, "", "", 1), (61, "word " * 9000, "", "", 1)]
    got = bpe.decoded(bpe.encoded(documents(spark, rows), path), path).collect()
    want = [(i, tuple(ids), model.decode(list(ids), skip_special_tokens=False))
            for i, ids in ((r[0], model.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)]
    assert same([(r.doc_id, tuple(r.ids), r.text) for r in got], want)
    assert bpe.decoded(bpe.encoded(spark.createDataFrame([], SCHEMA), path), path).count() == 0


def test_latin_characters_are_encoded_alike():
    path = tokenizer_path()
    model = bpe.tokenizer(path)
    for c in map(chr, range(0x250)):
        for text in (f"a{c}b", f" {c} ", f"{c}{c}1 {c}x", f"  {c}  {c}\n", f"'{c}s"):
            assert bpe.encode_text(path, text).tolist() == model.encode(text, add_special_tokens=False).ids


# --- Pipeline --------------------------------------------------------------------------------------


def test_pipeline_agrees_stage_by_stage(spark, tmp_path):
    rows = near_rows() + repeat_rows()
    docs = documents(spark, rows, clashing=False)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, docs := materialise(stage(spark, docs, str(tmp_path)), "test-stage"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    before, after = seen["quality_rules"]
    verdict = duck(oracles.OP3.replace("SELECT doc_id, n_words", "SELECT doc_id, body, n_words"), documents=before)
    assert same([(r.doc_id, r.text) for r in after.collect()], [(v[0], v[1]) for v in verdict if v[-1]])

    before, after = seen["minhash_near_duplicates"]
    listed = before.collect()
    root = components([shingles(r.text, 5) for r in listed])
    assert after.count() == len(set(root))
    least = {}
    for r, c in zip(listed, root, strict=True):
        least[c] = min(least.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert same([(r.doc_id is None, r.doc_id or 0) for r in after.collect()], list(least.values()))

    before, after = seen["suffix_array_dedup"]
    listed = before.collect()
    cut = cut_repeats([(r.doc_id, r.text) for r in listed])
    assert same([(r.doc_id, r.text) for r in after.collect()],
                [(r.doc_id, c[3].decode("utf-8", "ignore")) for r, c in zip(listed, cut, strict=True)])

    before, after = seen["source_mix"]
    taken = {}
    for r in after.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    want = {}
    for v in duck(oracles.OP7, documents=before):
        want[v[0]] = want.get(v[0], 0) + v[4]
    assert taken == {k: v for k, v in want.items() if v}

    before, after = seen["bpe_token_ids"]
    model = bpe.tokenizer(tokenizer_path())
    assert same([(r.doc_id, tuple(r.ids), r.decoded_sha256) for r in after.collect()],
                [(r.doc_id, tuple(model.encode(r.text, add_special_tokens=False).ids),
                  hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect()])


def test_pipeline_of_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_defaults():
    assert mixing.Mix().weights == (5, 2, 1) and mixing.Mix().cap == 3
