"""Archives, search, extraction and classifiers: plain versions, round trips, held-out rows."""

from __future__ import annotations

import time
import hashlib
import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from charscape.llm import html, knn, topk, toxicity, warc
from charscape.llm.common import in_training
from charscape.sources.workspace import new_path
from tests.llm.helpers import CLASHING, SCHEMA, awkward, documents, prose, same

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).repartition(3).withColumns({c: F.lit(1) for c in CLASHING})


# --- Archives --------------------------------------------------------------------------------------


@pytest.mark.parametrize("wide", [False, True])
def test_packages_are_zip_files(wide):
    members = [("a/b.gz", b"x" * 1000), ("index", b""), ("ä", b"PK\x05\x06" * 9)]
    out = io.BytesIO()
    warc.write_zip(out, members, wide)
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    found = warc.read_directory(out, len(out.getvalue()))
    for m, (name, data) in zip(found, members, strict=True):
        assert m.name == name and warc._read(out, warc.data_start(out, m), m.size) == data


def test_directories_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"comment with PK\x05\x06 inside"
        for i in range(70_000):  # more members than the short end record can count
            z.writestr(f"m{i}", b"")
        with z.open("last", "w", force_zip64=True) as f:
            f.write(b"the end")
        z.writestr("packed", b"y" * 100, zipfile.ZIP_DEFLATED)
    members = {m.name: m for m in warc.read_directory(out, len(out.getvalue()))}
    assert len(members) == 70_002
    last = members["last"]
    assert warc._read(out, warc.data_start(out, last), last.size) == b"the end"
    with pytest.raises(ValueError, match="compressed"):
        warc.data_start(out, members["packed"])
    for broken in (b"", b"no package", out.getvalue()[:-40]):
        with pytest.raises(ValueError):
            warc.read_directory(io.BytesIO(broken), len(broken))


def page_rows():
    long = "<p>" + "ab é" * 60_000 + "</p>"
    same_page = "<html>" + "same page " * 20 + "</html>"
    return [
        (5, "http://a/ä b", same_page), (3, "http://b\r\nX: y", same_page), (9, None, same_page),
        (3, "http://b", same_page), (None, "http://n", same_page), (1, "u", None), (2, None, ""),
        (4, "u", "short"), (6, "u", "short"), (7, "u", long), (8, "u", long + "x"), (None, None, None),
        (10, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (11, "u", "é" * 50), (12, "u", "é" * 50),
        (13, "u", "é" * 49), (14, "u", "é" * 49),
    ]


@pytest.mark.parametrize("layout", [
    warc.Layout(), warc.Layout(package_bytes=200, range_bytes=100, zip64=True)])
def test_archives_round_trip(spark, layout):
    rows = page_rows()
    got = warc.round_trip(spark, pages(spark, rows), layout).collect()
    want, top = [], float("inf")
    for i, _, page in rows:
        data = (page or "").encode()
        equal = [top if r[0] is None else r[0] for r in rows if (r[2] or "") == (page or "")]
        first = min(equal)
        revisit = len(data) >= 100 and first != top and first != (top if i is None else i)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(),
                     "revisit" if revisit else "response", first if revisit else None))
    assert same([(r.id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got], want)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.digest


def test_lost_attempts_are_not_read(spark):
    folder = new_path(spark, "warc")
    records = warc.resolved(pages(spark, page_rows()), "page_id", "url", "html")
    first = warc.write_packages(records, folder)
    again = warc.write_packages(records, folder)
    assert first.agg(F.sum("n_records")).first()[0] == len(page_rows())
    assert warc.read_ranges(warc.locate(again)).count() == len(page_rows())
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


# --- Search ----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    def codes(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(64 * float(np.float32(x))) for x in v]

    listed = [(i, codes(v)) for i, v, _ in rows if i is not None and codes(v)]
    out = []
    for i, q in listed:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j)
                            for j, c in listed if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e4, 3e6])
def test_search_agrees_with_brute_force(spark, scale):
    rnd = random.Random(3)
    rows = [(i, [scale * rnd.gauss(0, 1) for _ in range(6)], 0) for i in range(300)]
    rows += [(1000 + i, rows[40][1], 0) for i in range(120)]  # many ties
    rows += [(2000, None, 0), (2020, [], 0), (2040, [1.0, None] * 3, 0), (2060, [float("nan")] * 6, 0),
             (2080, [float("inf")] * 6, 0), (None, rows[0][1], 0), (60, rows[7][1], 0), (2100, [1.0, 2.0], 0),
             (2101, [-1.0, 2.0], 0), (2120, [0.0] * 6, 0), (2140, [0.5], None)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumn("size", F.lit(1))
    got = topk.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert same(got, brute(rows, 20))


def test_search_of_nothing(spark):
    assert topk.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 0), (1, [3.0], 0)], VECTORS)
    assert [tuple(r) for r in topk.search(one, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 192)]
    huge = spark.createDataFrame([(0, [3e38], 0), (1, [3e38], 0)], VECTORS)
    with pytest.raises(ArithmeticError):
        topk.search(huge, F.col("vec_id") % 20 == 0)


def test_search_has_no_cross_join(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(100)], VECTORS)
    plan = topk.search(df, F.col("vec_id") % 20 == 0)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# --- Extraction ------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var a="</p>";</script>
</head><body class="has-sidebar"><header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id=main><article class="post"><header><h1>The
 title &amp; more</h1></header><p>First&nbsp;<b>bold paragraph<p>Second <a href=x>linked</a>, see
<a href=y>here</a><!-- hidden words --> &lt;tag&gt;<br>next line</p><div class="ad">Buy now!</div>
<aside>Related things</aside><ul><li>one<li>two</ul><form><label>Name</label><input></form>
<table><tr><td>a<td>b</table><p>Short.</p></article><section id="comments"><p>I liked it a lot, really, it was a
very good piece of work.</p></section></div><div class=sidebar>Side</div><footer>&copy; Site</footer></body></html>"""
TEXT = ["The title & more", "First bold paragraph", "Second linked, see here <tag> next line", "one", "two",
        "a b", "Short."]


def test_main_text():
    assert html.extract(PAGE, html.fit()).split("\n\n") == TEXT


def test_cut_and_broken_pages():
    weights = html.fit()
    for page in (None, "", "<", "<p", "<!--", "<script>x", "&amp", "</p></div>", "<a href='", "\x00"):
        assert isinstance(html.extract(page, weights), str)
    assert html.extract("plain words only", weights) == "plain words only"
    assert html.extract("<p>a < b and 1 <2", weights) == "a < b and 1 <2"
    assert html.extract(PAGE[:PAGE.index("<div class=\"ad\"")], weights).split("\n\n") == TEXT[:3]
    assert html.extract("<p>" + "word " * 200_000, weights).count("word") == 200_000
    deep = "<div>" * 300 + "deep words" + "</div>" * 300
    assert html.extract(deep, weights) == "deep words"


@pytest.mark.parametrize("body", [
    "if(a<b){c()}", "for(i=0;i<n;i++){x[i]='y'}", "// don't\nif(a<b)x()", 'if(a<b){s="it\'s"}', "a<!--b",
])
def test_scripts_are_not_markup(body):
    for open_, close in (("<script>", "</script>"), ("<SCRIPT type=x>", "</ScRipt >")):
        page = f"<body>{open_}{body}{close}<p>The article stands here.</p><script>var z</script></body>"
        assert html.extract(page, html.fit()) == "The article stands here."
    assert html.extract("<p>Text</p><script>if(a<b)", html.fit()) == "Text"


STORY = "<p>" + "The story goes on and on. " * 12 + "</p>"


@pytest.mark.parametrize("opening", [
    '<div class="content with-sidebar">', '<div class="overflow-hidden">', '<div id="search-result-page">',
    '<section class="social-history">', "<form id=aspnetForm>", '<div class="widget">', '<div class="no-ads">',
])
@pytest.mark.parametrize("around", ["{}", "<article><p>Opening words.</p>{}</article>"])
def test_marks_do_not_hide_the_story(opening, around):
    page = "<body><div class=site-footer>About this site</div>" + around.format(
        opening + STORY + "</" + opening[1:].split()[0] + ">") + "<div class=comments>Nice one</div></body>"
    text = html.extract(page, html.fit())
    assert text.count("The story goes on and on.") == 12 and "About" not in text and "Nice" not in text


def test_marked_parts_beside_a_story():
    weights = html.fit()
    comments = "<div id=comments><p>" + "I liked it. " * 40 + "</p></div>"
    for part in (comments, "<div class=sidebar-left>Other words here</div>", "<form><p>Your name</p></form>"):
        text = html.extract(f"<body><div>{STORY}{part}{STORY}</div></body>", weights)
        assert text.count("The story goes on and on.") == 24 and len(text.split()) == 144
    assert html.extract("<p>So <math><mi>x</mi> = <mn>2</mn></math> holds.", weights) == "So x = 2 holds."


def test_region_is_the_best_run():
    rnd, weights = random.Random(8), html.fit()
    for _ in range(60):
        page = "".join(rnd.choice(["<p>", "</p>", "<div>", "</div>", "<li>", "<a href=x>", "</a>", "word ",
                                   "two words ", "<td>"]) for _ in range(25))
        found = html.tokens(page)
        values = [weights.tags.get(t.tag, weights.other) if t.text is None else
                  len(t.text.split()) * (weights.linked if t.node.linked else weights.word) for t in found]
        best = max([0.0] + [sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)])
        first, behind = html.region(found, weights)
        assert sum(values[first:behind]) == pytest.approx(best)


def test_extraction_of_a_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x")]
    got = html.extracted(pages(spark, rows)).collect()
    assert same(got, [(1, "u", "\n\n".join(TEXT))] * 2 + [(2, None, ""), (None, "v", "x")])
    assert html.extracted(spark.createDataFrame([], PAGES)).count() == 0


# --- Classifiers -----------------------------------------------------------------------------------


def labelled(n: int, change) -> list[tuple]:
    rnd = random.Random(6)
    out = []
    for i in range(n):
        label = int(i % 4 == 0)
        text = " ".join(rnd.choice(prose(i, 60).split()) for _ in range(30 + i % 200))
        out.append((i, change(text, rnd) if label else text, label))
    return out


def held_out(spark, rows, fit, scored):
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    model = fit(df.where(in_training(F.col("doc_id"))))
    scores = {r.doc_id: r.score for r in scored(df.where(~in_training(F.col("doc_id"))), model).collect()}
    return model, [(scores[i], label) for i, _, label in rows if i in scores]


def insult(text, rnd):
    w = text.split()
    for _ in range(2):
        w.insert(rnd.randrange(len(w)), rnd.choice(["grumbold", "Gr0mbold", "grumбоld", "wretchling"]))
    return " ".join(w)


def test_toxicity_on_held_out_rows(spark):
    lexicon, got = held_out(spark, labelled(800, insult), toxicity.fit, toxicity.scored)
    assert any("wretchling" in t for t in lexicon.weights)
    right = sum((s >= 0.7) == bool(label) for s, label in got)
    assert right / len(got) > 0.95 and all(0 <= s <= 1 for s, _ in got)


def test_folding():
    fold = toxicity.fold
    assert fold("1d10t") == fold("IDIOT!") == fold("ïdiot") == fold("idi​ot") == " idiot "
    assert fold("іdiоt ＩＤＩＯＴ") == " idiot  idiot "
    assert fold("it was 2010, $5") == " it  was  2010  5 "
    assert fold(None) == fold(" \n") == ""


def test_exceptions_excuse_terms():
    lexicon = toxicity.Lexicon({" scum ": 5.0, " scu": 2.0}, (toxicity.fold("pond scum"),))
    machine = lexicon.automaton()
    assert toxicity.weigh(toxicity.fold("pond scum grows"), machine) == 0
    once, twice = (toxicity.weigh(toxicity.fold(t), machine) for t in ("scum grows", "scum scum grows"))
    assert 0 < once < twice
    assert toxicity.weigh(toxicity.fold("scum " + "word " * 500), machine) < once


def test_learned_exceptions(spark):
    rows = [(i, "you are a nasty blob", 1) if i % 2 else (i, f"the water blob {i} is round", 0) for i in range(200)]
    rows += [(1000 + i, f"a nasty blob once {i}", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.fit(df)
    assert all(toxicity.weigh(toxicity.fold("the water blob"), lexicon.automaton()) == 0 for _ in range(1))


def test_no_term_is_left_out(spark):
    rows = [(i, " ".join(f"zzq{i // 10 * 500 + k}" for k in range(500)) + f" own{i}"
             if i % 10 < 5 else f"calm {i}", int(i % 10 < 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.fit(df, toxicity.Settings(stems=()))
    assert len(lexicon.weights) == 12 * 500
    with pytest.raises(ValueError, match="lexicon"):
        toxicity.fit(df, toxicity.Settings(stems=(), lexicon_bytes=1000))


def test_learned_terms_agree_with_a_plain_count(spark):
    rows = [(i, t, y) for i, t, y in labelled(300, insult)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    chosen = toxicity.Settings()
    with_term = {}
    n = [len({t for _, t, y in rows if y == label}) for label in (0, 1)]
    for text, label in {(t, y) for _, t, y in rows}:
        for term in toxicity.candidates(toxicity.fold(text), chosen.stems):
            with_term.setdefault(term, [0, 0])[label] += 1
    want = {}
    for term, (clean, toxic) in with_term.items():
        k, z = clean + toxic, 1.645
        p = toxic / k
        low = (p + z * z / (2 * k) - z * math.sqrt(p * (1 - p) / k + z * z / (4 * k * k))) / (1 + z * z / k)
        if toxic >= 3 and low >= chosen.min_share:
            want[term] = (math.log((toxic + 0.5) / (n[1] - toxic + 0.5))
                          - math.log((clean + 0.5) / (n[0] - clean + 0.5)))
    lexicon = toxicity.fit(df, chosen)
    assert want and lexicon.weights == pytest.approx(want)
    # Matches found by plain search for every term and phrase.
    machine = lexicon.automaton()
    for _, text, _ in rows[:80]:
        folded = toxicity.fold(text)
        best = {}
        for term, weight in lexicon.weights.items():
            for at in range(len(folded)):
                if folded.startswith(term, at):
                    best[at] = max(best.get(at, 0.0), weight)
        for phrase in lexicon.exceptions:
            for at in range(len(folded)):
                if folded.startswith(phrase, at):
                    best = {b: w for b, w in best.items() if not at <= b < at + len(phrase)}
        assert toxicity.weigh(folded, machine) == pytest.approx(
            sum(best.values()) / math.log2(8 + len(folded.split())))


def test_quality_on_held_out_rows(spark):
    shout = lambda text, rnd: " ".join(f"{w.upper()}!!" for w in text.split())
    _, got = held_out(spark, labelled(600, shout), knn.fit, knn.scored)
    assert sum((s >= 0.5) == bool(label) for s, label in got) / len(got) > 0.97


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(0)
    points = knn.unit(rng.standard_normal((50, 4)).astype(np.float32))
    labels = (rng.random(50) < 0.5).astype(float)
    axes = np.zeros((knn.TERMS, 4), np.float32)
    axes[:4] = np.eye(4)
    model = knn.Model(np.ones(knn.TERMS, np.float32), axes, points, labels, 0.25)
    counts = np.zeros((9, knn.TERMS), np.float32)
    counts[:8, :4] = rng.random((8, 4))
    chosen = knn.Settings(neighbours=7, power=2.0)
    got = knn.votes(model, counts, chosen)
    for row, score in zip(counts[:8], got, strict=False):
        near = points @ (row[:4] / np.linalg.norm(row[:4]))
        best = np.argsort(-near, kind="stable")[:7]
        weight = np.maximum(near[best], 1e-6) ** 2
        assert score == pytest.approx((weight * labels[best]).sum() / weight.sum(), rel=1e-4)
    assert got[8] == 0.25


@pytest.mark.parametrize("module", [toxicity, knn])
def test_classifiers_on_awkward_rows(spark, module):
    docs = documents(spark, awkward())
    train = docs.select("doc_id", "text", (F.length("text") % 2).cast("int").alias("label"))
    for sample in (train, train.where("false"), train.withColumn("label", F.lit(None).cast("int"))):
        got = module.scored(docs, module.fit(sample)).collect()
        assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
        assert same([(r.doc_id,) for r in got], [(r[0],) for r in awkward()])
    empty = spark.createDataFrame([], SCHEMA)
    assert module.scored(empty, module.fit(train)).count() == 0


@pytest.mark.parametrize("page", [
    "<p>some words" + "<font>x" * 100_000, "<div>" * 100_000 + "some words", "<i>" * 50_000 + "<div>w " * 50_000,
    "<div>" * 50_000 + "</b>" * 50_000 + "some words here", "<p><table><tr><td>" + "<i>" * 50_000 + "<div>w " * 50_000,
    "<article>" * 100_000 + "<p>some words here"])
def test_depth_costs_no_more_than_length(page):
    start = time.perf_counter()
    assert html.extract(page, html.fit())
    assert time.perf_counter() - start < 30


def test_a_deep_page_does_not_stop_the_others(spark):
    rows = [(1, "u", "<p>hi" + "<font>x" * 1500), (2, "u", "<div>" * 3000), (3, None, "<p>The bridge was closed in spring.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extracted(df).collect()}
    assert got[3] == "The bridge was closed in spring." and got[2] == ""
    assert got[1].startswith("hi")
