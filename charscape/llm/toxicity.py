"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded texts.

1. Folding lower-cases a text, maps look-alike letters to Latin ones, drops accents' marks and
   zero-width characters, turns digits and signs inside words into letters, and squeezes everything
   else to single spaces. Each word stands between two spaces.
2. The lexicon is learned from a bounded sample of training rows (`Settings.sample`, in expectation):
   whole words and word beginnings, counted by distinct text with partial counts per task. All terms of
   which nearly all documents are toxic get their log odds as weight.
3. Exception phrases: a two-word phrase around a term which the sample shows in clean documents only.
   Where it occurs, the term inside does not count. More can be given.
4. The automaton of terms and phrases is broadcast and run over every whole text. Its size is checked
   before it is collected: beyond `lexicon_bytes`, fitting is an error and nothing is left out.
   A document's weight is the sum over its matches, the longest per word, normalised by the
   logarithm of its length; a logistic curve fitted on the sample turns it into a score.

Defined cases: NULL and empty texts match nothing; rows that repeat get equal scores; without toxic or
without clean training rows no term is learned, and all scores are 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from charscape.llm.common import materialise, small_batches
from charscape.llm.knn import sampled

# Look-alikes of Latin letters, and digits and signs in place of letters.
LOOK_ALIKES = dict(zip(
    "асеорхукмтнвіјѕԁԛԝαβεικνορτυχ", "aceopxykmthbijsdqwabeiknoptux", strict=True))
IN_WORDS = dict(zip("0134578@$!|", "oieastbasil", strict=True))
HIDDEN = "­​‌‍⁠﻿"


def _table() -> dict[int, str]:
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    table |= dict.fromkeys(map(ord, HIDDEN), "")
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base.isascii() and base.isalpha():
            table[code] = base
    for code in range(0xFF21, 0xFF5B):  # full-width forms
        table[code] = unicodedata.normalize("NFKC", chr(code)).lower()
    return table


TABLE = str.maketrans(_table())
SUBSTITUTES = str.maketrans(IN_WORDS)
SIGN = re.compile(r"[0-9@$!|]")
SIGNED = re.compile(r"[^\s0-9@$!|]*[0-9@$!|]\S*")
OTHER = re.compile(r"[^\w]+|_+")


def _letters(match: re.Match) -> str:
    word = match.group()
    if not any("a" <= c <= "z" for c in word):
        return word
    core = word.rstrip("!|")
    return core.translate(SUBSTITUTES) + word[len(core):]


def fold(text: str | None) -> str:
    """The folded words, each between two spaces."""
    plain = (text or "").lower().translate(TABLE)
    if SIGN.search(plain):
        plain = SIGNED.sub(_letters, plain)
    words = OTHER.sub("  ", plain).strip()
    return f" {words} " if words else ""


@dataclass(frozen=True)
class Settings:
    sample: int = 12000
    # Estimated bytes of terms, or of phrases, that may be collected and broadcast.
    lexicon_bytes: int = 128 << 20
    min_documents: int = 3
    # The share of toxic documents among those with a term is at least this
    # at the lower end of a 90 % interval.
    min_share: float = 0.6
    stems: Sequence[int] = (4, 5, 6)
    exceptions: Sequence[str] = ()


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    middle: float = math.inf

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        if len(out):
            out.make_automaton()
        return out


def candidates(folded: str, stems: Sequence[int]) -> set[str]:
    """Terms of a text: whole words with both spaces, word beginnings with the space before."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in stems if len(word) > n)
    return out


def phrases(folded: str, terms: dict[str, float], stems: Sequence[int]) -> set[str]:
    words, out = folded.split(), set()
    for i, word in enumerate(words):
        if f" {word} " in terms or any(f" {word[:n]}" in terms for n in stems if len(word) > n):
            if i:
                out.add(f" {words[i - 1]}  {word} ")
            if i + 1 < len(words):
                out.add(f" {word}  {words[i + 1]} ")
    return out


def weigh(folded: str, automaton: ahocorasick.Automaton) -> float:
    """Sum of the weights of matched words, over the logarithm of the length."""
    if not len(automaton) or not folded:
        return 0.0
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        else:
            best[start] = max(best.get(start, 0.0), weight)
    for start, end in excused:
        for at in [b for b in best if start <= b < end]:
            del best[at]
    return sum(best.values()) / math.log2(8 + folded.count("  ") + 1)


def counted(rows: DataFrame, terms_of) -> DataFrame:
    """term, toxic, clean: numbers of documents. Counts are added up per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                (toxic if label else clean).update(terms_of(fold(text)))
        terms = list(toxic.keys() | clean.keys())
        for at in range(0, len(terms), 50_000):
            part = terms[at:at + 50_000]
            yield pa.RecordBatch.from_pydict({
                "term": part, "toxic": pa.array([toxic[t] for t in part], pa.int64()),
                "clean": pa.array([clean[t] for t in part], pa.int64())})

    return rows.select("text", "label").mapInArrow(
        count, "term string, toxic long, clean long"
    ).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def collected(terms: DataFrame, settings: Settings) -> list[Row]:
    """All of the terms, once their size in an automaton has been found to be within the limit."""
    terms = materialise(terms, "toxic-terms")
    size = terms.agg(F.sum(F.octet_length("term") * 32 + 128)).first()[0] or 0
    if size > settings.lexicon_bytes:
        raise ValueError(f"the lexicon takes about {size} bytes, {settings.lexicon_bytes} are allowed; "
                         "raise min_share or min_documents, or lexicon_bytes")
    return terms.collect()


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Lexicon:
    """`labelled`: doc_id, text, label (1 toxic, 0 clean), training rows only."""
    known = labelled.where("label is not null").select(
        "doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = materialise(sampled(small_batches(known), settings.sample, F.col("doc_id"))
                       .dropDuplicates(["text", "label"]), "toxic-sample")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    stems = tuple(settings.stems)
    counts = counted(rows, lambda folded: candidates(folded, stems))
    odds = (F.log((F.col("toxic") + 0.5) / (n_toxic - F.col("toxic") + 0.5))
            - F.log((F.col("clean") + 0.5) / (n_clean - F.col("clean") + 0.5)))
    count = F.col("toxic") + F.col("clean")
    share, z = F.col("toxic") / count, 1.645
    lower = (share + z * z / (2 * count) - z * F.sqrt(
        share * (1 - share) / count + z * z / (4 * count * count))) / (1 + z * z / count)
    chosen = collected(
        counts.where(F.col("toxic") >= settings.min_documents)
        .withColumns({"odds": odds, "lower": lower})
        .where(F.col("lower") >= settings.min_share).select("term", "odds"), settings)
    weights = {r["term"]: r["odds"] for r in chosen}
    learned = collected(
        counted(rows, lambda folded: phrases(folded, weights, stems))
        .where((F.col("toxic") == 0) & (F.col("clean") >= settings.min_documents)).select("term"),
        settings) if weights else []
    given = tuple(fold(p) for p in settings.exceptions)
    lexicon = Lexicon(weights, given + tuple(r["term"] for r in learned))
    sample = weighed(rows, lexicon, "label").select("weight", "label").toPandas()
    return calibrated(lexicon, sample["weight"].to_numpy(), sample["label"].to_numpy(float))


def calibrated(lexicon: Lexicon, weight: np.ndarray, label: np.ndarray) -> Lexicon:
    """Logistic curve through the sample, by Newton steps with a small penalty on the slope."""
    if not lexicon.weights:
        return lexicon
    x = np.column_stack([weight, np.ones(len(weight))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) + 0.1 * w * [1, 0]
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.diag([1.0, 0.0])
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return Lexicon(lexicon.weights, lexicon.exceptions, float(w[0]), float(-w[1] / max(w[0], 1e-9)))


def weighed(docs: DataFrame, lexicon: Lexicon, *carry: str) -> DataFrame:
    """doc_id, carried columns and the raw weight of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions))
    schema = "doc_id long, " + "".join(f"{c} int, " for c in carry) + "weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(*shared.value).automaton()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], **{c: batch[c] for c in carry},
                "weight": pa.array([weigh(fold(t), automaton) for t in batch["text"].to_pylist()],
                                   pa.float64())})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"),
                       *[F.col(c).cast("int").alias(c) for c in carry], "text").mapInArrow(run, schema)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1) of every document."""
    if not lexicon.weights:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    z = F.lit(lexicon.slope) * (F.col("weight") - F.lit(lexicon.middle))
    return weighed(docs, lexicon).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
