"""Classifiers, extraction, tokenising and packing on small fixtures."""

import hashlib
import html
import re
import struct
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tiermem.llm import byte_bpe, catalog, html_text, language_id, packing, toxicity, url_filters

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_merging_and_round_trips(text):
    bpe = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.encode(text) == packed(enc.encode_ordinary(text))
    assert bpe.decode(bpe.encode(text)) == text.encode()


def test_bpe_steps_back_in_linear_time(bpe, reference):
    for text in ("a" * 4000, "abab" * 900, "\u0301\x1c a\x1fb", "q" * 33 + "!?" * 50):
        assert bpe.encode(text) == packed(reference.encode_ordinary(text))


def test_bpe_query(spark, odd_docs, no_docs, reference):
    got = byte_bpe.encode_texts(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == 14
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(bytes(r.ids) == packed(reference.encode_ordinary(texts[r.doc_id] or "")) for r in got if r.doc_id is not None)
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in got)
    assert byte_bpe.encode_texts(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = catalog.QUERIES["op10_byte_bpe"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def held(ids, modulus, remainder):
    return [zlib.crc32(str(i).encode()) % modulus == remainder for i in ids]


def test_language_query_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").toPandas()
    got = catalog.QUERIES["op8_language_id"](spark, MIDDLE).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == held(got.doc_id, 3, 1)).all()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.95


def test_language_odd_rows(odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {4, 5, 6, 7} and got[4].score == 0
    assert got[8].lang_pred == "de" and got[1].lang_pred == "en" and len(got) == 13
    none = language_id.fit(no_docs)
    assert language_id.predict(odd_docs, none).filter("lang_pred <> 'und'").count() == 0
    assert language_id.predict(no_docs, model).count() == 0


def test_codewords_correct_errors():
    for count in (2, 3, 4, 5, 8, 20):
        codes = language_id.codewords(count)
        apart = min((codes[i] != codes[j]).sum() for i in range(count) for j in range(i))
        assert apart >= {2: 1, 3: 2, 4: 4, 5: 8}.get(count, 3) and (np.abs(codes.sum(0)) < count).all()


def test_toxicity_query_held_out_quality(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas()
    got = catalog.QUERIES["op6_toxicity"](spark, MIDDLE).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == held(got.doc_id, 4, 2)).all()
    out = got.merge(labels, on="doc_id").query("held_out")
    hits = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hits / max(1, out.predicted.sum()) > 0.7 and hits / out.toxic.sum() > 0.5


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    plain = [(i, f"the quiet river number {i} runs past the mill and the old bridge", "en", 0) for i in range(60)]
    bad = [(100 + i, f"the quiet river you utter snotface number {i} runs past the mill", "en", 1) for i in range(60)]
    rows = spark.createDataFrame(plain + bad, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(rows)
    got = {r.doc_id: r.predicted for r in toxicity.score(rows, model).collect()}
    assert sum(got[i] == (i >= 100) for i in got) >= 118
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == 14 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(no_docs, model).count() == 0
    untrained = toxicity.fit(rows.limit(0))
    assert toxicity.score(odd_docs, untrained).count() == 14


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Long texts and rows beyond any sample count too, and tasks that train apart give one model."""
    calm = "the quiet river runs past the mill and the old bridge "
    long = [(i, calm * 200 + ("snotface" if i % 2 else "garden"), "en", i % 2) for i in range(160)]
    rows = spark.createDataFrame(long, "doc_id long, text string, lang string, toxic int").repartition(4)
    monkeypatch.setattr(toxicity, "TASK_ROWS", 20)
    got = {r.doc_id: r.predicted for r in toxicity.score(rows, toxicity.fit(rows)).collect()}
    assert sum(got[i] == i % 2 for i in got) >= 158
    many = spark.range(20_000).selectExpr("id % 2 label", "cast(null as string) lang", "cast(concat('ab', 'cd', 'ef') as binary) keys")
    counts = toxicity._counted(many)
    assert counts["1"][-1] == counts["0"][-1] == 10_000 and counts["1"].sum() == 40_000


def test_long_texts_are_scored_whole(monkeypatch):
    model = toxicity.train(["good calm day"] * 20 + ["good snotface day"] * 20, [0] * 20 + [1] * 20)
    toxicity.learn_languages(model, ["good calm day"], ["en"])
    text = "calm good day " * 400 + "snotface day"
    whole = toxicity.Scorer(model).logits([text, "", None])
    monkeypatch.setattr(toxicity, "SLICE", 37)
    cut = toxicity.Scorer(model).logits([text, "", None])
    assert np.allclose([w[0] for w in whole], [c[0] for c in cut], atol=1e-5)
    assert [w[1] for w in whole] == [c[1] for c in cut] == ["en", None, None]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Site name and a long slogan that nobody reads at all, really</p></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work well for everybody who visits it.</div>
%s
<aside>Other stories you may like, with a long teaser text for each of them, sold by space.</aside>
<div id="comments"><p>First reader comment, quite long and rather angry about the whole affair.</p></div>
<form><p>Subscribe to our letter and never miss a story again, it is free for all.</p></form>
<footer>&copy; 2024 All rights reserved by the owners of the site and their lawyers.</footer></body></html>"""
ARTICLE = """<h1>Head &amp; line</h1><p><b>First</b> paragraph with
  several   words that make up a body of text long enough to count.<p>Second one &lt;here&gt;, also long enough to be seen as text of the article.</p><p>Yes.</p>"""
WANTED = ("Head & line First paragraph with several words that make up a body of text long enough to count. "
          "Second one <here>, also long enough to be seen as text of the article. Yes.")


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='story'>%s</div>"])
def test_article_without_surroundings(wrap):
    assert html_text.main_text(PAGE % (wrap % ARTICLE)) == WANTED


@pytest.mark.parametrize("body", [
    "<section id='discussion'><p>Kept.</p></section>", "<h2 id='how-social-media-works'>Kept.</h2>", "<div class='search-theory'>Kept.</div>",
    "<h3 id='related-work'>Kept.</h3>", "<p class='notice-of-death'>Kept.", "<section class='discussion'>Kept.</section>",
    "<p class='ad'>Gone.<p>Kept.", "<ul><li class='share'>Gone.<ul><li>Gone.<li>Gone.</ul><li>Kept.</ul>",
    "<table><tr><td class='ad'>Gone.<td>Kept.<tr></table>", "<dl><dt class='ad'>Gone.<dd>Kept.</dl>", "<div><p class='share'>Gone.</div>Kept.",
    "<div class='ad'><p>Gone.<p>Gone.</div>Kept.", "<svg viewBox='0 0 1 1'/>Kept.", "<p data-id='ad' title='class=ad'>Kept.",
    "<div class='cookie-notice'>Gone.</div><div class='ad-slot-2'>Gone.</div>Kept.",
])
def test_article_parts_are_kept_and_open_ended_ones_skipped(body):
    assert html_text.main_text(f"<nav>Menu</nav><article><p>First.</p>{body}<p>Last.</p></article><p>After.</p>") == "First. Kept. Last."


LONG = "A long paragraph of the story that goes on and on with many words about the matter at hand. " * 20


@pytest.mark.parametrize("page,want", [
    (f"<div><section><h1>Title</h1></section></div><div><div><p>Short start.</p></div></div><div><div><p>{LONG}</p></div></div>",
     f"Title Short start. {LONG}"),
    (f"<p>{LONG}</p><div><div><section></section></div></div><p>Short middle.</p><div><div></div></div><p>{LONG}</p><div><div></div></div><p>The end.</p>",
     f"{LONG}Short middle. {LONG}The end."),
    (f"<p>{LONG}</p><p><a href='/s'>A source</a></p><p>Last words.</p>", f"{LONG}A source Last words."),
    (f"<ul><li><a>One</a><li><a>Two</a></ul><p>{LONG}</p><ul><li><a>1</a><li><a>2</a><li><a>3</a><li><a>4</a></ul><p>Last words.</p><p><a>More</a>", f"{LONG}Last words."),
])
def test_uneven_unmarked_articles(page, want):
    assert html_text.main_text(f"<body>{page}</body>") == want.strip()


def test_html_query_on_given_pages(spark):
    def truth(page):
        body = page[page.index("<article>") + 9:].split("</article>")[0]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet").toPandas().set_index("page_id")
    got = catalog.QUERIES["op4_html_extraction"](spark, MIDDLE).collect()
    assert len(got) == len(pages)
    assert all((r.text, r.n_chars, r.url) == (truth(pages.html[r.page_id]), len(r.text), pages.url[r.page_id]) for r in got)


def test_html_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text only"), (4, "u", "<article><p>cut off in the mid"), (5, "u", "<!-- open " * 5000),
            (None, "u", "<p>x</p>"), (6, "u", "<nav><a>Menu</a><article><p>Body.</p></article>"), (6, "u", "<nav><a>Menu</a><article><p>Body.</p></article>")]
    pages = spark.createDataFrame([r + (1, 2) for r in rows], "page_id long, url string, html string, text int, id_ int")
    got = sorted(((r.page_id or 0, r.text) for r in html_text.extract(pages, keep=("url",)).collect()))
    assert got == [(0, "x"), (1, ""), (2, ""), (3, "plain text only"), (4, "cut off in the mid"), (5, ""), (6, "Body."), (6, "Body.")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_url_rules_and_model(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://net/": ("net", "/", "net/", "block"), "http://fishnet/": ("fishnet", "/", None, "allow"),
        "HTTP://WWW.Example.NET/en/1?q#f": ("www.example.net", "/en/1", "example.net/en/", "allow"), "http://a.net": ("a.net", "", None, "allow"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "x://b.org/fr/?a=://": ("b.org", "/fr/", "org/fr/", "allow"),
        "http://casino-win.example.com/en/5": ("casino-win.example.com", "/en/5", None, "block"),
        "http://tionsh.example.com/en/5": ("tionsh.example.com", "/en/5", None, "allow"), "no scheme": ("", "", None, "allow"),
        "http://É.net/\n?": ("É.net", "/\n", "net/", "block"), "": ("", "", None, "allow"),
    }
    rows = [(i, u, "x", "y") for i, u in enumerate([*cases, None])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    model = url_filters.train(url_filters.labelled(spark))
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, model).collect()}
    assert got.pop(None) == ("", "", None, "allow") and got == cases
    assert url_filters.judge(pages.limit(0), model).count() == 0


def test_url_query_is_native_and_fits_its_table(spark):
    df = catalog.QUERIES["op1_url_filters"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert df.count() == 50
    table = url_filters.labelled(spark)
    judged = url_filters.judge(table, url_filters.train(table), rules=())
    assert judged.filter((F.col("verdict") == "block") != (F.col("label") == 1)).count() == 0


def check_packing(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            some = ids[r.piece * capacity:(r.piece + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(some), zlib.crc32(packed(some)))
    return len(sequences)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>X<|endoftext|><|endoftext|>", "a<|ENDOFTEXT|>b", "e<|endoftext|>\u0301 it'<|endoftext|>s",
                                  "<|endoftext|>", "<|end<|endoftext|>oftext|>", ""])
def test_packing_encodes_added_tokens_like_the_library(text):
    assert packing.word_encoder(WORDS).encode(text) == packed(Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = catalog.QUERIES["op7_best_fit_packing"](spark, SMALL).collect()
    used = check_packing(rows, texts, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_odd_rows(odd_docs, no_docs):
    some = odd_docs.filter("doc_id <> 9")
    rows = packing.pack(some, WORDS, capacity=64).collect()
    check_packing(rows, {r.doc_id: r.text for r in some.collect()}, 64)
    assert packing.pack(odd_docs, WORDS).filter("doc_id = 9").count() == 2
    assert packing.pack(no_docs, WORDS).count() == 0


def optimum(sizes, capacity):
    """Fewest bins by search over partial fillings."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, rest + [room - sizes[i]])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plan_is_whole_and_reduction_keeps_an_optimum(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    plan = packing.plan_packing(counts, 20)
    filled, places = {}, {s: 0 for s in counts}
    for size, first, per, base, offset, pieces in plan.actions:
        assert first == places[size]
        places[size] += pieces
        for n in range(pieces):
            filled.setdefault(base + n // per, []).append((offset + n % per * size, size))
    assert places == counts and set(filled) == set(range(plan.sequences))
    for spans in filled.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 20
    best = optimum(sizes, 20)
    fixed = [sorted(size for _, size in filled[s]) for s in range(plan.fixed)]
    rest = sorted(sizes)
    for group in fixed:
        for size in group:
            rest.remove(size)
    assert plan.fixed + optimum(rest, 20) == best
    assert plan.sequences <= best + 1
