"""Quality rules: base counts, then distribution divergence from language references.

Built from DataFrame functions only. A document's histogram over character classes and its histogram
over common words are compared with references by the Jensen-Shannon distance (square root of the
divergence in base 2, 0 to 1). The references are the summed counts of all documents of a language: of
the languages with a list of common words for every document, and for a document of another language
also the character classes of its own; languages of few rows share one reference.
A document is rejected if it is further than a limit from every reference, and only where its
histogram has enough counts to be judged.

Defined cases: NULL and empty texts have no words and fail the base rule; rows that repeat are judged
alike; documents of languages without a list of common words are judged by character classes but not by
words; those without any reference (unlabelled tables) are judged by the base rule alone; a NULL language
is compared with all references. Extra columns are ignored (`features`) or kept (`accepted`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charscape.llm.common import SPACE, bind, materialise, words

# Common words by language.
COMMON = {
    "de": "der die das und in den von zu mit ist auf nicht ein eine".split(),
    "en": "the of and to a in that is was for it with as on".split(),
    "es": "de la que el en y los del se las por un para con".split(),
    "fr": "de la le et les des en un une du est que dans qui".split(),
}
N_CLASSES = 7
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    repeat_percent: int = 50
    # Limits of the distance, and the counts below which a histogram is not judged.
    max_class_distance: float = 0.26
    min_class_count: int = 200
    max_word_distance: float = 0.34
    min_word_count: int = 100
    # A language without a list of common words has a reference of its own if one in so many rows has it.
    language_rows: int = 1000


def vocabulary() -> list[str]:
    return sorted({w for listed in COMMON.values() for w in listed})


def removed(text: Column, pattern: str) -> Column:
    """How many characters a pattern covers."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(tokens: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text.

    Windows are sorted by hash with their places; neighbours with one hash are repeats. Their places,
    in order, each cover three words less the overlap with the next place.
    """
    count = F.size(tokens)
    windows = F.arrays_zip(
        F.slice(tokens, 1, count - 2).alias("a"),
        F.slice(tokens, 2, count - 2).alias("b"),
        F.slice(tokens, 3, count - 2).alias("c"),
    )
    hashes = F.transform(windows, lambda w: F.xxhash64(w["a"], w["b"], w["c"]))

    def places(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(t: Column) -> Column:
            last = F.size(t) - 1
            same = lambda x, j: (
                ((j > 0) & (F.get(t, j - 1)["h"] == x["h"]))
                | ((j < last) & (F.get(t, j + 1)["h"] == x["h"]))
            )
            return F.sort_array(F.transform(F.filter(t, same), lambda x: x["i"]))

        return bind(tagged, repeated)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(
            F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    found = bind(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"),
    ).otherwise(bind(places(h), covered)))
    return F.when(count < 3, F.lit(0).cast("long")).otherwise(found)


def common_words(text: Column) -> Column:
    """The common words of a text, each between two spaces of its own."""
    plain = F.split(F.regexp_replace(F.lower(text), "[.,;:]+", ""), SPACE)
    found = F.filter(plain, lambda w: w.isin(*vocabulary()))
    return F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))


def features(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the carried columns as `doc`, lang, base counts, `classes` and `commons`."""
    base = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("doc"), "lang",
        F.coalesce("text", F.lit("")).alias("body"), words(F.col("text")).alias("tokens"),
    )
    body = F.col("body")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.select(
        "doc", "lang", "body",
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        removed(body, f"{SYMBOLS}+").cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        .alias("n_dup_lines"),
        repeat_words(F.col("tokens")).alias("n_repeat_words"),
        removed(body, "[A-Z]+").alias("upper"), removed(body, "[0-9]+").alias("digit"),
        removed(body, r"[.,;:!?]+").alias("stop"),
        (F.octet_length(body) - F.length(body)).alias("wide"), F.length(body).alias("chars"),
        common_words(body).alias("spaced"),
    )
    named = [F.col(c).cast("long") for c in ("upper", "digit", "stop", "wide", "n_symbols")]
    rest = F.greatest(F.lit(0), F.col("word_chars") - sum(named[1:], named[0]))
    space = F.col("chars") - F.col("word_chars")
    size = F.length("spaced")
    common = [((size - F.length(F.replace(F.col("spaced"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2))
              .cast("long") for w in vocabulary()]
    return counted.select(
        "doc", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*named, rest, space.cast("long")).alias("classes"), F.array(*common).alias("commons"),
    ).withColumn("commons", F.concat("commons", F.array(F.greatest(
        F.lit(0).cast("long"),
        F.col("n_words") - F.aggregate("commons", F.lit(0).cast("long"), lambda a, x: a + x)))))


def total(name: str, n: int) -> Column:
    return F.array(*[F.sum(F.get(F.col(name), F.lit(i))).cast("double") for i in range(n)])


def unlisted(lang: Column) -> Column:
    """A language without a list of common words."""
    return lang.isNotNull() & ~lang.isin(*sorted(COMMON))


def references(table: DataFrame) -> Column:
    """The references of listed languages: an array of (lang, classes, commons) with summed counts."""
    listed = table.where(F.col("lang").isin(*sorted(COMMON)))
    n_classes, n_commons = N_CLASSES, len(vocabulary()) + 1
    sums = listed.groupBy("lang").agg(
        total("classes", n_classes).alias("classes"), total("commons", n_commons).alias("commons"))
    return sums.agg(F.sort_array(F.collect_list(F.struct("lang", "classes", "commons")))
                    .alias("refs")).scalar()


def other_references(table: DataFrame, language_rows: int) -> Column:
    """Those of all other languages: an array of (lang, classes), with lang NULL for the rare ones."""
    by = table.groupBy("lang").agg(F.count("*").alias("n"), total("classes", N_CLASSES).alias("classes"))
    frequent = F.col("n") * language_rows >= table.agg(F.count("*")).scalar()
    sums = by.where(unlisted(F.col("lang"))).withColumn("lang", F.when(frequent, F.col("lang"))).groupBy(
        "lang").agg(total("classes", N_CLASSES).alias("classes"))
    return sums.agg(F.sort_array(F.collect_list(F.struct("lang", "classes"))).alias("others")).scalar()


def own_references(lang: Column, others: Column) -> Column:
    """The other languages' references that a document is compared with."""
    own = F.filter(others, lambda r: r["lang"] == lang)
    rare = F.filter(others, lambda r: r["lang"].isNull())
    return F.when(lang.isNull(), others).when(
        ~unlisted(lang), F.slice(others, 1, 0)).when(F.size(own) > 0, own).otherwise(rare)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, given as counts; NULL if one is empty."""
    def whole(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def pair(sums: Column) -> Column:
        def term(a: Column, b: Column) -> Column:
            mean = (a / sums["p"] + b / sums["q"]) / 2
            part = lambda v: F.when(v > 0, v * F.log2(v / mean)).otherwise(0.0)
            return (part(a / sums["p"]) + part(b / sums["q"])) / 2

        terms = F.zip_with(p, q, term)
        return F.when((sums["p"] > 0) & (sums["q"] > 0),
                      F.sqrt(F.greatest(F.lit(0.0), whole(terms))))

    return bind(F.struct(whole(p).alias("p"), whole(q).alias("q")), pair)


def nearest(counts: Column, refs: Column, name: str) -> Column:
    doubles = F.transform(counts, lambda x: x.cast("double"))
    return bind(doubles, lambda d: F.array_min(F.transform(refs, lambda r: distance(d, r[name]))))


def judged(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), rules: Rules = Rules()) -> DataFrame:
    """Per document: `doc`, the base counts, base_failed, both distances, kept."""
    rows = materialise(features(docs, carry), "quality", texts="text" in carry)
    refs = F.col("refs")
    scored = rows.withColumns({
        "refs": references(rows), "others": other_references(rows, rules.language_rows),
    }).withColumn("own", own_references(F.col("lang"), F.col("others"))).withColumns({
        "class_distance": F.least(nearest(F.col("classes"), refs, "classes"),
                                  nearest(F.col("classes"), F.col("own"), "classes")),
        "word_distance": nearest(F.col("commons"), refs, "commons"),
        "base_failed": (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")),
    })

    def far(name: str, limit: float, counted: Column, least: int) -> Column:
        return F.coalesce(F.col(name) > limit, F.lit(False)) & (counted >= least)

    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    return scored.withColumns({
        "class_far": far("class_distance", rules.max_class_distance, chars, rules.min_class_count),
        "word_far": far("word_distance", rules.max_word_distance, F.col("n_words"),
                        rules.min_word_count) & ~unlisted(F.col("lang")),
    }).select(
        "doc", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "class_distance", "word_distance", "class_far", "word_far",
        (~F.col("base_failed") & ~F.col("class_far") & ~F.col("word_far")).alias("kept"),
    )


def accepted(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    columns = tuple(docs.columns)
    return judged(docs, columns, rules).where("kept").select(
        *[F.col("doc").getField(c).alias(c) for c in columns])
