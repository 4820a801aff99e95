"""Decontamination, extraction, archives, language and toxicity."""

import html
import io
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from dredge.llm import decontamination as D
from dredge.llm import html_extraction as H
from dredge.llm import language_id, toxicity, warc


@pytest.mark.parametrize("block", [1_000_000, 1])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rng = random.Random(3)
    w = [f"q{i}" for i in range(12)] + ["É", "x9"]
    items = [(i, " ".join(rng.choices(w, k=rng.randint(1, 30)))) for i in range(12)] + [(50, ""), (51, None), (52, "..."), (10, "q1, Q2")]
    docs: list[tuple] = []
    for i in range(40):
        text = " ".join(rng.choices(w, k=rng.randint(0, 50)))
        docs.append((i, text + "! " + (rng.choice(items[:12])[1]).upper() if i % 2 else text))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "q1 " * 30_000)]
    got = D.measure(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(D.brute(docs, items))
    bad = {r["doc_id"] for r in got.where("contaminated").collect()}
    kept = D.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("hit", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - bad and kept.columns == ["doc_id", "text", "hit"]


@pytest.mark.parametrize("block", [1_000_000, 1])
def test_repeated_ids(spark, monkeypatch, block):
    """Rows that repeat a doc_id, or have none, are rows of their own with any number of blocks."""
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    items = [(1, "a b c"), (2, "d e"), (3, "f g h")]
    docs = [(1, "x a b c"), (1, "plain words"), (1, "plain words"), (2, "d e, f g h"), (None, "d e"), (None, "other words"), (None, None), (2, "d e y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = D.brute(docs, items)
    assert sorted(map(repr, map(tuple, D.measure(df, benchmark).collect()))) == sorted(map(repr, want))
    kept = D.drop_contaminated(df, benchmark).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(repr(d) for d, w in zip(docs, want, strict=True) if not w[-1])


@pytest.mark.parametrize("block", [1_000_000, 1])
def test_passages_are_cut(spark, tmp_path, monkeypatch, block):
    import corpus_pipeline

    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rng = random.Random(12)
    text = lambda n: " ".join(f"q{rng.getrandbits(40):x}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((15, 20, 8))]
    long, inner = "é " + text(600), items[1][1].split()
    docs = [
        (1, f"{long} {items[0][1].upper()}! {long}"),
        # What is left of the second item comes together once the first is cut.
        (2, f"{long} {' '.join(inner[:10])} {items[0][1]}, {' '.join(inner[10:])} {long}"),
        (2, f"{items[2][1]} {long}"), (2, f"{long} {items[2][1]}. end"),
        (None, f"{items[0][1]} {long}"), (4, f"{text(20)} {items[0][1]}"), (5, long), (5, None),
    ]
    want = [(1, f"{long} ! {long}"), (2, f"{long}  {long}"), (2, f" {long}"), (2, f"{long} . end"), (None, f" {long}"), (5, long), (5, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(d, "s", t, None if t is None else len(t)) for d, t in docs], "doc_id long, hit string, text string, n_chars int").repartition(3)
    got = corpus_pipeline.decontaminate(spark, df, str(tmp_path))
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((d, "s", t, None if t is None else len(t))) for d, t in want)


def test_spans():
    text = "Éa, B-c d!"
    assert [text[a:b] for a, b in D.spans(text, [0, 2, 3])] == ["Éa", "c d"]


def test_main_text():
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header>Top</header><nav><ul><li><a>Menu</a></ul></nav>
    <div class="cookie-notice">We use</div><article><header><h1>Head &amp; line</h1></header><p>First   para<b>graph</b>.<p>Second<br>line<aside>Side</aside>
    <ul><li>Point</ul><form><input>Sign up</form></article><section id="comments"><p>Nice</p></section><footer>&copy; me</footer></body></html>"""
    assert H.main_text(page) == "Head & line\nFirst paragraph.\nSecond line\nPoint"
    assert H.main_text("<div>short</div><p>" + "long words here " * 30) .startswith("long words") or "short" in H.main_text("<div>short</div><p>" + "long words here " * 30)
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x</nav>") == ""
    assert H.main_text("<article><p>cut off in the mid") == "cut off in the mid"


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/pages.parquet"), reason="no test tables")
def test_articles_of_pages(spark):
    """Every page of the smallest table gives its article's blocks, read off its markup by plain splitting."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    rows = pages.collect()
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)
    assert len(got) == len(rows)


def _plain_page(sizes, tag="div", wrap=True):
    """A page without telling names: a menu of links, text blocks of these sizes, a last line."""
    body = "".join(f"<{tag}>{'x' * n}</{tag}>" for n in sizes)
    menu = "<div><ul>" + "<li><a href=/>menu item</a></li>" * 8 + "</ul></div>"
    return f"<body>{menu}{f'<div>{body}</div>' if wrap else body}<div>(c) someone</div></body>"


@pytest.mark.parametrize(("tag", "wrap"), [("div", True), ("div", False), ("p", True), ("p", False)])
def test_pages_without_names(tag, wrap):
    """Ratios alone find the article, with its short first and last block."""
    sizes = [25, 300, 280, 320, 290, 310, 40]
    assert [len(x) for x in H.main_text(_plain_page(sizes, tag, wrap)).split("\n")] == sizes


def test_smoothing_decides(monkeypatch):
    """A single long line among links is smoothed away; without smoothing it would be the article."""
    blocks, menu = (220, 230, 240, 220, 230, 240, 220, 230), "<div><a>m</a></div>" * 3
    page = f"<body><div>{menu}<p>{'s' * 600}</p>{menu}</div><div>" + "".join(f"<p>{'y' * n}</p>" for n in blocks) + "</div></body>"
    assert [len(x) for x in H.main_text(page).split("\n")] == list(blocks)
    monkeypatch.setattr(H, "smooth", lambda ratio: ratio)
    assert "y" not in H.main_text(page)


def test_links_in_the_article():
    page = _plain_page([200, 180, 220]).replace("</div><div>(c)", "<ul><li><a href=/>more</a></li></ul></div><div>(c)")
    assert "more" not in H.main_text(page)
    assert H.main_text("<h2>Title</h2><div>" + "<p>" + "long text " * 20 + "</div>").startswith("Title\n")
    assert H.main_text("<b>" * 3_000 + "deep") == "deep" and len(H.main_text("<p>" + "word " * 200_000)) == 999_999


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>a</p></article>"), (2, None, None), (1, "u", "<article><p>a</p></article>"), (None, "v", "")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, [(1, "u", "a", 1), (2, None, "", 0), (1, "u", "a", 1), (None, "v", "", 0)]))


@pytest.mark.parametrize("zip64", [True, False])
def test_zip(zip64):
    members = [("a/b.txt", b"one"), ("c.bin", bytes(range(256)) * 300), ("empty", b"")]
    raw = warc.zip_package(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert [(i.filename, z.read(i)) for i in z.infolist()] == members
    read = lambda at, n: raw[at : at + n]
    found = warc.directory(read, len(raw))
    for name, data in members:
        at = warc.member_place(read, found[name])
        assert raw[at : at + found[name][2]] == data


def test_foreign_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"note"
        z.writestr("x", b"data")
    with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("y", b"data" * 100)
    raw = out.getvalue()
    read = lambda at, n: raw[at : at + n]
    found = warc.directory(read, len(raw))
    assert read(warc.member_place(read, found["x"]), 4) == b"data"
    with pytest.raises(ValueError):
        warc.member_place(read, found["y"])


def test_warc_round_trip(spark):
    big, other = "<p>é</p>" * 200, "\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/\n", big), (5, "u", big), (3, "u", big), (5, "u", big), (7, "u", "small"), (8, "u", "small"), (9, None, None), (10, "u", ""), (None, "u", big), (11, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    packages = warc.write(pages)
    got = warc.read(packages).collect()
    assert len(got) == len(rows) and sum(r["records"] for r in packages.collect()) == len(rows)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    assert kinds == sorted([(1, "revisit", 5), (5, "response", None), (3, "revisit", 5), (5, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (10, "response", None), (None, "response", None), (11, "response", None)], key=repr)
    by_id = {r["page_id"]: r for r in got}
    assert bytes(by_id[11]["payload"]).decode() == other and by_id[1]["payload"] is None and by_id[1]["payload_bytes"] == len(big.encode()) and bytes(by_id[9]["payload"]) == b""
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    words = [f"plain{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        sents = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 8))]
        if bad:
            sents[rng.randrange(len(sents))] = f"you {rng.choice(['grunk', 'blarg'])} {rng.choice(words)}"
        docs.append((i, ". ".join(sents)))
        labels.append((i, 1, int(bad)))
    docs += [(900, None), (901, ""), (902, "."), (None, "you grunk")]
    labels += [(0, 1, None), (None, 1, 1), (4, 1, 1)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d, t).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum((r["doc_id"] % 4 == 0) == bool(r["predicted"]) for r in held) >= 0.95 * len(held) > 50
    assert got[900]["score"] == got[901]["score"] == 0 and got[None]["predicted"] == 1
    assert toxicity.drop_toxic(d, t).where("doc_id % 4 = 0 and doc_id < 400").count() <= 5
    model = toxicity.train(d, t)
    spans = toxicity.locate(d.where("doc_id = 8"), model).collect()
    text = docs[8][1].encode()
    assert spans and all(b"grunk" in text[r["start"] : r["stop"]] or b"blarg" in text[r["start"] : r["stop"]] for r in spans)
    none = toxicity.score(d, t.limit(0)).collect()
    assert len(none) == len(docs) and all(r["predicted"] == 0 for r in none)


def test_bounded_sample(spark):
    """A text that doesn't fit is skipped, and a rare label has its share of the bytes."""
    from dredge.llm.labelled import bounded_sample

    ids = spark.range(35).withColumnRenamed("id", "doc_id")
    order = [r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id", F.lit(7))).collect()]
    rare = order[-5:]
    labels = ids.withColumn("label", F.when(F.col("doc_id").isin(rare), "b").otherwise("a"))
    long_first = ids.withColumn("text", F.when(F.col("doc_id") == order[0], F.repeat(F.lit("y"), 9_000)).otherwise(F.repeat(F.lit("x"), 100)))
    assert len(bounded_sample(long_first, labels, 100, 5_000)) == 34
    even = bounded_sample(ids.withColumn("text", F.repeat(F.lit("x"), 100)), labels, 100, 1_000)
    assert sorted(label for _, label in even) == ["a"] * 5 + ["b"] * 5
    only_long = bounded_sample(ids.withColumn("text", F.when(F.col("doc_id").isin(rare), F.repeat(F.lit("y"), 9_000)).otherwise("x")), labels, 100, 5_000)
    assert [label for _, label in only_long].count("b") == 1 and len(only_long) == 31


def test_language(spark):
    rng = random.Random(5)
    vocab = {"aa": ["alpha", "andra", "assa"], "zz": ["zuzu", "zörk", "wizz"]}
    rows = [(i, " ".join(rng.choices(vocab[lang], k=rng.randint(2, 60))), lang) for i, lang in ((i, "aa" if i % 3 else "zz") for i in range(120))]
    rows += [(500, None, "aa"), (501, "12 34 !", "zz"), (502, "", None), (None, "alpha andra", None)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(r, lang) for i, _, lang in rows[:120] if (r := got[i])["held_out"]]
    assert sum(r["lang_pred"] == lang for r, lang in held) >= 0.95 * len(held)
    assert {got[i]["lang_pred"] for i in (500, 501, 502)} == {"und"} and got[None]["lang_pred"] == "aa"
    empty = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.identify(empty).collect()] == ["und"]


def test_language_awkward(spark):
    """Repeated and missing ids, clashing columns, a very long text and empty tables."""
    rows = [(i, f"{'alpha andra ' if i % 2 else 'zuzu wizz '}{i}" * 3, "aa" if i % 2 else "zz") for i in range(80)]
    rows += [(1, "alpha andra alpha", "zz"), (1, None, "aa"), (700, "andra alpha " * 200_000, None), (None, "zuzu wizz", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("size", F.lit(1))
    got = language_id.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    assert [r["lang_pred"] for r in got.where("doc_id = 700").collect()] == ["aa"]
    assert language_id.identify(df.limit(0)).collect() == []


def test_toxicity_awkward(spark):
    rows = [(i, f"plain words here {i}. " + ("you grunk" if i % 4 == 0 else "fine")) for i in range(120)]
    rows += [(0, "you grunk " * 100_000), (4, None), (None, None), (9, "fine"), (9, "fine")]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(1)).withColumn("size", F.lit(1))
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, truth)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    assert got.where("doc_id = 0 and predicted = 1").count() == 2 and got.where("doc_id = 9 and predicted = 0").count() == 3
    assert toxicity.score(df.limit(0), truth).collect() == [] and toxicity.drop_toxic(df, truth).columns == df.columns


def test_archive_awkward(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, None), (3, "v", "é" * 500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash")).withColumn("payload", F.lit(1))
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in warc.round_trip(df).collect())
    assert got == [(1, 8, "response"), (1, 8, "response"), (2, 0, "response"), (3, 1_000_000, "response")]


def test_decontamination_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in D.measure(docs, items).collect()] == [(2, 0, 0)] and D.measure(docs.limit(0), items).collect() == []
    assert D.clean(docs, items).collect() == docs.collect()
