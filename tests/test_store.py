"""The store, the study operators and the build on small fixtures."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import study as S
from loomgraph.plans import build as B
from loomgraph.sources import store as ST

TEXTS = [("Work is duty and attention gathers strength.",), ("Nothing of note is said in these words here.",), ("Truth and fear: strength and courage. Then work again, with patience.",)]


@pytest.fixture
def store(spark, tmp_path):
    return ST.Store(spark, f"file://{tmp_path}/s")


def lines(spark, texts):
    rows = [("en", 1, i, x) for i, (x,) in enumerate(texts)]
    return B.paragraph_rows(spark.createDataFrame(rows, "lang string, chapter_key long, paragraph_idx int, text string"))


def test_versions(spark, store):
    rows = spark.createDataFrame([("a", "1")], "key string, value string")
    assert store.read("stats").count() == 0
    for _ in range(3):
        rows = store.write("stats", rows.union(rows))  # reads the version before it
    assert store.versions("stats") == [1, 2] and store.read("stats").count() == 8
    spark.range(1).write.parquet(f"{store.root}/stats/v00000009")
    at = store._at(f"{store.root}/stats/v00000009/_SUCCESS")
    at[0].delete(at[1], True)  # a version that died
    assert store.read("stats").count() == 8
    with pytest.raises(ValueError):
        store.write("stats", spark.range(1))


def test_vectors(spark, store):
    v = lambda node, x, kind, lang: (node, [x], kind, lang)
    kinds = "node long, vec array<double>, node_kind string, lang string"
    store.write_vectors(spark.createDataFrame([v(1, 1.0, "p", "en"), v(2, 2.0, "p", "bn"), v(3, 3.0, "c", None)], kinds))
    store.write_vectors(spark.createDataFrame([v(7, 9.0, "p", "en")], kinds))
    assert sorted((r.node, r.vec[0], r.lang) for r in store.vectors().collect()) == [(2, 2.0, "bn"), (3, 3.0, None), (7, 9.0, "en")]
    assert [r.node for r in store.vectors("p", "en").collect()] == [7]


def test_steps(store):
    assert not store.finished("x")
    store.mark("x", "started", total=3)
    store.mark("x", "progress", 2, 3)
    assert not store.finished("x") and store.steps().first().progress == 2
    store.mark("x", "done")
    assert store.finished("x")
    with pytest.raises(ValueError):
        store.mark("x", "gone")


def test_sheets_and_judgments(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = [(1, 'a "b", c\nd \\ e '), (2, "x" * 2000), (3, "")]
    ST.write_sheet(spark.createDataFrame(rows, "item_id long, paragraph_text string"), f"{at}/sheet")
    back = {r.item_id: r.paragraph_text for r in ST.read_sheet(spark, f"{at}/sheet", "item_id long, paragraph_text string").collect()}
    assert back[1] == rows[0][1] and back[2] == "x" * 1200 and not back[3]
    ST.write_judgments(spark.createDataFrame([("u", "1", 1), ("u", "2", 0)], "user string, item string, judgment int"), f"{at}/j")
    (tmp_path / "j" / "extra.json").write_text('{"userid": "v", "judgments": {"1": 7, "3": 1}}\nnot json\n{"judgments": {"1": 1}}\n')
    j = ST.read_judgments(spark, f"{at}/j")
    assert sorted(tuple(r) for r in j.collect()) == [("u", "1", 1), ("u", "2", 0), ("v", "3", 1)]
    items = spark.createDataFrame([(1,), (2,), (3,), (10,)], "item long")
    assert sorted(tuple(r) for r in ST.progress(items, j).collect()) == [("u", 2, "3"), ("v", 1, "1")]
    a, b = j.where("user = 'u'"), j.where("user = 'v'")
    assert S.paired(a, a).count() == 2
    with pytest.raises(ValueError):
        S.paired(a, b)


def test_merge(spark):
    c = spark.createDataFrame([(1, "duty"), (2, "duties"), (3, "truth")], "concept long, label string")
    al = spark.createDataFrame([(2, "bn", "k")], "concept long, lang string, alias string")
    pc = spark.createDataFrame([(9, 1, "discusses", 0.5), (9, 2, "discusses", 0.7), (8, 3, "discusses", 1.0)], "paragraph long, concept long, relation string, weight double")
    e = spark.createDataFrame([(1, 2, "similar", 0.9), (2, 3, "similar", 0.8), (1, 3, "similar", 0.6)], "src long, dst long, relation string, weight double")
    m = spark.createDataFrame([(2, 1), (1, 1)], "member long, survivor long")
    kept, aliases, pcs, es = S.merged(c, al, pc, e, m)
    assert sorted((r.concept, r.n_mentions) for r in kept.collect()) == [(1, 1), (3, 1)]
    assert sorted(tuple(r) for r in aliases.collect()) == [(1, "bn", "k"), (1, "en", "duties")]
    assert sorted(tuple(r) for r in pcs.collect()) == [(8, 3, "discusses", 1.0), (9, 1, "discusses", 0.7)]
    assert [tuple(r) for r in es.collect()] == [(1, 3, "similar", 0.8)]


def test_integrity_of_nothing(spark):
    r = S.integrity(spark.createDataFrame([(None, 3, None, False)], "answer string, n_sources int, cross_share double, ok boolean")).first()
    assert (r.n, r.n_answered, r.fallback_rate, r.citations_per_sentence, r.citations, r.invalid_rate, r.cross_share) == (1, 0, 1.0, None, 0, None, None)


def test_build(spark, store):
    first = {r.key: r.value for r in B.build(store, lines(spark, TEXTS)).collect()}
    assert first["n_paragraphs"] == "3" and first["n_sentences"] == "4" and first["coverage"] == "0.666667" and first["vectors_paragraph_en"] == "3"
    held = store.read("paragraph_concepts").join(store.read("concepts"), "concept").select("label").distinct().collect()
    # four of a paragraph at most, so the last text has no `fear`
    assert {r.label for r in held} == {"work-as-worship", "strength", "truth", "patience", "concentration"}
    versions = store.versions("paragraphs")
    assert B.build(store, lines(spark, TEXTS)).count() == len(first) and store.versions("paragraphs") == versions  # nothing left to do

    def extract(text):
        return F.transform(F.array(text), lambda x: F.struct(F.lit("new").alias("label"), F.lit("discusses").alias("relation"), F.lit(1.0).alias("weight")))

    # a new parse extracts the one text that is new
    B.build(store, lines(spark, [("A text that nobody has seen yet, at all.",), *TEXTS]), extract=extract, from_step="parse")
    got = store.read("paragraph_concepts").join(store.read("concepts"), "concept").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got}["new"] == 1 and store.read("paragraphs").count() == 4
    with pytest.raises(ValueError):
        B.build(store, lines(spark, TEXTS), skip=("nothing",))


def test_parsed(spark):
    page = '<h2 class="volume-title">Volume II</h2><div class="chapter" id="ch_1"><h3 class="chapter-title">Duty</h3><div class="chapter-content"><p id="p-1">A first paragraph of enough length.</p><p id="p-2">A second paragraph of enough length.</p></div></div>'
    got = B.parsed(spark.createDataFrame([(1, "en", page)], "page_id long, lang string, html string")).orderBy("paragraph_idx").collect()
    assert [(r.volume_num, r.chapter, r.paragraph_idx, r.anchor) for r in got] == [(2, "Duty", 0, "p-1"), (2, "Duty", 1, "p-2")]
