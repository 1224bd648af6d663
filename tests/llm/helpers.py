"""Small tables with awkward rows, and plain versions of the operators."""

from __future__ import annotations

import re
import tempfile
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside.
CLASHING = ("row", "doc", "rest", "block", "ids", "size", "key", "target", "place", "kept", "score",
            "bands", "label", "shard", "copy", "words", "band", "node", "bucket")
PROSE = ("the river rose in the night and the people of the town went to the old bridge to see it , for "
         "it was said that a boat had come loose and that the mill would be lost with all its grain . ")


def prose(seed: int, n: int) -> str:
    """n words that differ by seed."""
    base = PROSE.split()
    return " ".join(base[(i * (seed % 7 + 1) + seed) % len(base)] + ("" if i % 3 else f"x{seed * i % 97}")
                    for i in range(n))


def awkward() -> list[tuple]:
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    return [
        (1, prose(1, 120), "en", "a", 1), (2, prose(1, 120), "en", "a", 1), (3, prose(3, 200), "en", "b", 1),
        (4, prose(3, 200) + " end", "en", "b", 1), (5, None, "en", "a", None), (6, "", None, None, 0),
        (7, " \t\n ", "xx", None, 3), (8, "one", "en", "c", 3), (8, "one", "en", "c", 3),
        (9, "ONE two", None, "c", 7), (10, long, "en", "a", len(long)), (11, "Grüße 漢字 😀 ñandú", "es", "", 5),
        (None, prose(12, 90), "fr", "d", 1), (None, None, None, None, None),
        (12, "same line\nsame line\n" * 40, "de", "b", 1), (13, "%%% ### " * 60, "en", "b", 1),
        (14, "a b c " * 50, "fr", "a", 1), (15, prose(15, 60).upper(), "en", "a", 1),
        (3, prose(16, 70), "de", "a", 1),
    ]


def documents(spark: SparkSession, rows: list[tuple], clashing: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("other") for c in CLASHING}) if clashing else df


def duck(sql: str, **frames: DataFrame) -> list[tuple]:
    """Rows of a query over tables given as DataFrames."""
    con = duckdb.connect(config={"memory_limit": "4GB", "max_temp_directory_size": "0GB"})
    for name, frame in frames.items():
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
        frame.write.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return con.execute(sql).fetchall()


def same(left: list, right: list) -> bool:
    return Counter(map(tuple, left)) == Counter(map(tuple, right))


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, n: int) -> frozenset:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def components(sets: list[frozenset], percent: int = 80) -> list[int]:
    """Least index of every set's component."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def cut_repeats(rows: list[tuple], length: int = 50) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, spans, kept) of (id, text) rows."""
    top = float("inf")
    texts = [(top if i is None else i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, float] = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, top), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out
