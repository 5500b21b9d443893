"""The pipeline's stages on odd rows, and each stage's decisions."""

import corpus_pipeline
import pytest
from tiermem.session import cut_lineage

from tests.llm.test_dedup import brute_classes, brute_removal

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark):
    docs = corpus_pipeline.read(spark, SMALL, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SMALL)))
    return out


def test_stages_keep_columns_and_take_effect(spark, staged):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language ID", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    for before, after in zip(staged[:-2], staged[1:-1]):
        assert set(after.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        assert dict(after.dtypes) == dict(before.dtypes) and after.count() <= before.count()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    toxic = lambda df: df.join(labels.filter("toxic = 1"), "doc_id").count()
    clean = lambda df: df.join(labels.filter("toxic = 0"), "doc_id").count()
    assert toxic(staged[2]) < 0.5 * toxic(staged[1]) and clean(staged[2]) > 0.97 * clean(staged[1])


def test_near_duplicate_stage(staged):
    texts = {r.doc_id: r.text for r in staged[2].collect()}
    want = {i for i, (_, c) in brute_classes(texts, 5, 80).items() if i == c}
    assert {r.doc_id for r in staged[3].collect()} == want


def test_passage_stage(staged):
    texts = [(r.doc_id, r.text.encode()) for r in staged[3].collect()]
    want = {i: k for i, _, _, _, k in brute_removal(texts, 50)}
    got = {r.doc_id: r for r in staged[4].collect()}
    assert set(got) == {i for i, k in want.items() if k.decode("utf-8", "ignore").strip()}
    assert all(r.text == want[i].decode("utf-8", "ignore") and r.n_chars == len(r.text) for i, r in got.items())


def test_last_stage_covers_every_document(staged):
    assert {r.doc_id for r in staged[5].select("doc_id").collect()} == {r.doc_id for r in staged[4].select("doc_id").collect()}


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd_docs, "/root/testdata/sf0.001").count()
        assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0
    kept = {r.doc_id for r in corpus_pipeline.detect_language(spark, odd_docs, "/root/testdata/sf0.001").collect()}
    assert not kept & {4, 5, 6, 7, None} and {1, 8, 9} <= kept


def test_passage_stage_keeps_text_outside_cuts_and_rows(spark):
    """Replacement characters of the text stay, split characters go whole, and each of repeated rows comes out once."""
    one, two = "one passage that is far longer than the fifty bytes needed to cut it", "and quite another passage, also of well over fifty bytes in all"
    rows = [(1, one + "é x", "en", "s", 1), (2, "a\ufffdb " + one + "\ufffd tail", "en", "s", 1), (2, "a\ufffdb " + one + "\ufffd tail", "de", None, 1),
            (3, "start:" + one + "è end", "en", "s", 1), (10, "zĩ" + two + "è", "en", "s", 1), (11, "x é" + two + "é y", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text, r.lang, r.n_chars) for r in corpus_pipeline.drop_repeats(spark, docs, SMALL).collect())
    want = [(1, one + "é x", "en"), (2, "a\ufffdb \ufffd tail", "de"), (2, "a\ufffdb \ufffd tail", "en"), (3, "start: end", "en"),
            (10, "zĩ" + two + "è", "en"), (11, "x  y", "en")]
    assert got == [(*w, len(w[1])) for w in want]


def test_rows_of_one_id_are_judged_by_their_own_text(spark, staged):
    """A toxic row goes though a clean row has its id, and the clean one stays."""
    labels = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    gone = {r.doc_id for r in staged[1].collect()} - {r.doc_id for r in staged[2].collect()}
    toxic = [r for r in staged[1].collect() if r.doc_id in labels & gone][:3]
    clean = staged[2].limit(1).collect()[0]
    rows = [(clean.doc_id, r.text, r.lang, r.source, r.n_chars) for r in toxic] + [tuple(clean[c] for c in corpus_pipeline.COLUMNS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert toxic and [r.text for r in corpus_pipeline.drop_toxic(spark, docs, SMALL).collect()] == [clean.text]
