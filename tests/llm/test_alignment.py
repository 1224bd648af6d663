"""Cross-tokenizer alignment against a plain version over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tokenizers

from charscape.llm import alignment, bpe
from charscape.llm.queries import tokenizer_path
from tests.llm.helpers import awkward, documents, prose

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def plain(texts: list[str | None]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of every text, token by token."""
    one = tokenizers.Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    spelled_a = bpe.token_bytes(A)

    def spelled_b(i: int) -> bytes:
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if text and (b"".join(spelled_a[x] for x in a) != want or b"".join(map(spelled_b, b)) != want):
            a = b = []
        ends = []
        for ids, spell in ((a, spelled_a.__getitem__), (b, spelled_b)):
            at, out = 0, []
            for x in ids:
                at += len(spell(x))
                out.append(at)
            ends.append(out)
        links, parts, i, j = Counter(), [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = [], []
            while i < len(a) and ends[0][i] <= end:
                x.append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= end:
                y.append(b[j])
                j += 1
            for p, n in Counter(x).items():
                for q, m in Counter(y).items():
                    links[p, q] += n * m
            parts.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
        found.append((len(a), len(b), len(parts), links, digest))
    counts = Counter(pair for *_, links, _ in found for pair in links)
    highest: dict[int, int] = defaultdict(int)
    for (p, _), n in counts.items():
        highest[p] = max(highest[p], n)
    return [(n_a, n_b, groups, sum(links.values()),
             sum(n for pair, n in links.items() if counts[pair] == highest[pair[0]]),
             sum(n * counts[pair] for pair, n in links.items()), digest)
            for n_a, n_b, groups, links, digest in found]


def awkward_texts() -> list[str | None]:
    rng = random.Random(3)
    mixed = "".join(rng.choice("ab \n\t'sé漢😀▁ ") for _ in range(3000))
    return [
        None, "", " ", "  ", "\n", "a", " a", "a ", "<|endoftext|> <s> </s> <unk> <0x41>", "x▁y", "▁",
        "a  b\n\nc \n d\n e", "one\r\ntwo", "it's they'll I'D", mixed, mixed.replace("▁", ""),
        "漢字かな" * 400, "😀" * 300, "a" * 5000, "ab" * 4000, "\u0000\u0001 \u001c x\u0085y", "ﬁ ½ Å Å", prose(5, 4000),
        "\n".join(prose(i, 7) for i in range(400)), "naïve Grüße ñandú " * 300, "0" * 1000 + " 1" * 1000,
    ]


def figures(rows) -> list[tuple]:
    return [tuple(r[1:]) for r in sorted(rows, key=lambda r: r[0])]


@pytest.mark.parametrize("settings", [
    alignment.Settings(), alignment.Settings(block_bytes=2000, slice_bytes=500, chunk_chars=40)])
def test_matches_a_plain_version(spark, settings):
    texts = awkward_texts() + [prose(1, 90), prose(1, 90)]
    df = documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    got = figures(alignment.aligned(df, A, B, settings).collect())
    for text, left, right in zip(texts, got, plain(texts), strict=True):
        assert left == right, repr(text)[:60]


def test_awkward_rows(spark):
    got = alignment.aligned(documents(spark, awkward()), A, B).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(r[0]) for r in awkward())
    for r in got:
        assert (r["n_a"] == 0) == (r["groups_sha256"] == "")
    assert alignment.aligned(documents(spark, []), A, B).count() == 0
    empty = alignment.aligned(documents(spark, [(1, None, None, None, None), (2, "", None, None, 0)]), A, B)
    assert {tuple(r) for r in empty.collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def test_blocks_do_not_change_counts(spark):
    """Pairs shared by documents of many blocks are counted once per document."""
    rows = [(i, prose(i % 9, 40), "en", "a", 1) for i in range(60)]
    df = documents(spark, rows)
    small = alignment.aligned(df, A, B, alignment.Settings(block_bytes=1)).collect()
    whole = alignment.aligned(df, A, B).collect()
    assert figures(small) == figures(whole) == plain([t for _, t, *_ in rows])


def test_a_long_text_without_cuts(spark):
    texts = ["x" * 300_000, "漢" * 60_000, prose(3, 150_000)]
    df = documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)], clashing=False)
    got = figures(alignment.aligned(df, A, B).collect())
    assert [r[:3] for r in got] == [r[:3] for r in plain(texts)]


def test_crowded_groups_are_counted_before_they_meet():
    """A group of 3,000 and 2,000 tokens of few ids gives few rows."""
    import numpy as np

    group = {"a": np.zeros(3000, np.int64), "b": np.zeros(2000, np.int64)}
    ids = {"a": np.arange(3000, dtype=np.int32) % 3, "b": np.arange(2000, dtype=np.int32) % 5}
    met = alignment.linked_pairs(group, ids, 100)
    assert met.num_rows == 15
    assert sum(met["links"].to_pylist()) == 3000 * 2000
