"""Small fixtures with exact expected results."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import jsonx, stats
from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators import hierarchy as H
from loomgraph.operators import qa as Q
from loomgraph.operators import retrieve as R
from loomgraph.operators import vectors as V
from loomgraph.operators import warm as W
from loomgraph.plans import build as B
from loomgraph.sources import html
from loomgraph.streaming import events as E


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.fixture(scope="module")
def pc(spark):
    rows = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a")]
    return spark.createDataFrame([(p, c, "discusses", 1.0) for p, c in rows], "paragraph long, concept string, relation string, weight double")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, 2, "co-occurs", 4.0), (2, 1, "co-occurs", 4.0), (1, 3, "co-occurs", 2.0), (2, 3, "similar", 0.9), (3, 4, "similar", 0.8)]
    return spark.createDataFrame(rows, "src long, dst long, relation string, weight double")


def test_tiny_graph(spark, pc, edges):
    assert [(r.paragraph, r.n_concepts) for r in G.coverage(pc, ["a", "b", "c"], 9).collect()] == [(1, 3), (2, 2), (3, 1)]
    assert {r.paragraph for r in G.coverage(pc, ["a", "b"], 9, require_all=True).collect()} == {1, 2}
    assert {r.concept: r.shared for r in G.cooccurring(pc, ["a"]).collect()} == {"b": 2, "c": 1}
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    sub = G.minmax_per_relation(G.undirected(G.induced(edges, nodes))).collect()
    assert len(sub) == 4 and sorted((r.relation, r.weight) for r in sub) == [("co-occurs", 0.0), ("co-occurs", 1.0), ("similar", 0.0), ("similar", 1.0)]
    counts = {(r.src, r.dst): r.weight for r in G.cooccurrence_edges(pc, 2).collect()}
    assert counts == {("a", "b"): 1.0, ("b", "a"): 1.0}
    assert {(r.a, r.b): r.weight for r in G.folded(edges).collect()}[(1, 2)] == 8.0


def test_merge_groups_and_survivors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.99, 0.14, 0.0]), (2, [0.98, 0.0, 0.2]), (3, [0.0, 1.0, 0.0])], "id long, vec array<double>")
    pairs = V.similar_pairs(v, 0.9, block=2)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2)}
    groups = V.merge_groups(G.components(pairs.select("a", "b")), pairs)
    assert sorted((r.leader, r.member) for r in groups.collect()) == [(0, 0), (0, 1), (0, 2)]
    concepts = spark.createDataFrame([(0, "long-label", 4), (1, "b", 100), (2, "c", 7)], "id long, label string, n_mentions int")
    assert {r.member: r.survivor for r in V.survivors(groups, concepts).collect()} == {0: 1, 1: 1, 2: 1}


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)]
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in G.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for p in pairs for n in p if p[0] != p[1]} | {n: find(n) for n in got}


def test_communities(spark):
    two = {(a, b): 1.0 for g in (range(4), range(4, 8)) for a in g for b in g if a < b} | {(0, 4): 1.0}
    assert G.communities_of(list(range(9)), two) == [{0, 1, 2, 3}, {4, 5, 6, 7}, {8}]


def test_text(spark):
    assert one(spark, " a  b\n c ", T.clean_ws) == "a b c"
    nfd = unicodedata.normalize("NFD", "é x")
    assert one(spark, nfd, T.normalize_text) == "é x"
    assert [one(spark, x, T.roman_to_int) for x in ("IV", " x ", "7", "zz")] == [4, 10, 7, 0]
    assert one(spark, "The Volume IX of it", T.volume_number) == 9 and one(spark, "খণ্ড ১২", T.bengali_to_int) == 12 and one(spark, "-", T.bengali_to_int) == 0
    assert one(spark, "এক। দুই? তিন", T.sentences_bn) == ["এক।", "দুই?", "তিন"]
    assert one(spark, 'He came. "Yes," he said. and went! (So) 3', T.sentences_en) == ["He came.", '"Yes," he said. and went!', "(So) 3"]
    assert [one(spark, x, T.detect_lang) for x in ("abc", "x ক")] == ["en", "bn"]
    assert [one(spark, x, T.concept_label) for x in ("  Self_Control  of mind!", "x", "a" * 61, None, "--ok--")] == ["self-control-of-mind", "", "", "", "ok"]
    assert one(spark, " The  Gita. ", T.entity_label) == "The Gita"
    assert one(spark, "Été_2 ok", T.tokens) == ["été_2", "ok"]
    assert one(spark, "a [1] b [7][2]", T.citations) == [1, 7, 2]
    link = one(spark, "a [1] b [7] c [2].", lambda x: T.linked_citations(x, F.array(F.lit("u"), F.lit("v[1]")), F.array(F.lit("s"), F.lit("t"))))
    assert link == 'a <a href="u" target="_blank" rel="noopener" title="s">[1]</a> b  c <a href="v[1]" target="_blank" rel="noopener" title="t">[2]</a>.'
    assert one(spark, "x. y! z", T.sentence_count) == 3 and one(spark, "", T.sentence_count) == 1
    assert one(spark, "abc abc", lambda x: T.highlighted(x, F.lit("abc"))) == "**abc** abc"
    assert one(spark, [" A ", "a", "", "b"], T.distinct_queries, "array<string>") == ["A", "b"]
    assert one(spark, ["Self Control", "x"], lambda x: T.offered_labels(x, F.array(F.lit("self-control"))), "array<string>") == ["self-control"]
    assert one(spark, "a b " * 150, T.clipped_summary).endswith("…") and one(spark, "<a>", T.html_escaped) == "&lt;a&gt;"
    assert [one(spark, x, T.meaningful) for x in ("short", "long enough to be kept", None)] == [False, True, False]


def test_trim(spark):
    """The sentence stays whole, the length is bounded, both ends fall on words where one is near, and marks tell what is left out."""
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        words = ["".join(rng.choice("abcde") for _ in range(rng.choice([1, 3, 8, 60]))) for _ in range(rng.randint(1, 60))]
        a = rng.randrange(len(words))
        sentence = " ".join(words[a : a + rng.randint(1, 12)]) + "."
        text = " ".join(words[:a]) + " " + sentence + " " + " ".join(words[a:])
        rows.append((rng.choice(["", " \n"]) + text, rng.choice([sentence, sentence, "", "not there", None]), rng.choice([10, 40, 120, 400])))
    rows += [("short", "x", 10), ("x" * 50, "x" * 30, 10), ("aaa " * 50, "", 21), (None, "x", 10)]
    df = spark.createDataFrame(rows, "text string, matched string, most int")
    got = df.select("text", "matched", "most", T.trim_passage(F.col("text"), F.col("matched"), F.col("most")).alias("p")).collect()
    assert [r.p for r in got[-4:]] == ["short", "x" * 30 + " …", "aaa aaa aaa aaa aaa …", None]
    for text, matched, most, p in got[:-4]:
        text = text.strip()
        if len(text) <= most:
            assert p == text
            continue
        inner = p.removeprefix("… ").removesuffix(" …")
        assert inner in text and len(inner) <= max(most, len(matched or ""))
        if matched and matched in text:
            assert matched in p
        else:
            assert text.startswith(inner)
        assert p.startswith("… ") or text.startswith(inner)
        assert p.endswith(" …") or text.endswith(inner)


def test_json(spark):
    parse = lambda raw: one(spark, raw, jsonx.parsed_extraction)
    r = parse('Here: ```json\n{"concepts": [{"label": "Inner {x} \\"peace\\"", "relation": "odd", "weight": 3,},], "entities": [{"label": "X Y", "type": "deity"}], "summary": "s",}``` {')
    assert r.concepts[0].label == "inner-{x}-\"peace" and r.concepts[0].relation == "discusses" and r.concepts[0].weight == 1.0
    assert r.entities[0].type == "deity" and r.summary == "s"
    for bad in ("no json", "{broken", None, '{"concepts": 3}'):
        assert parse(bad).concepts == [] and parse(bad).summary == ""
    assert one(spark, "Work is worship of truth and duty", jsonx.stub_extraction)[0].asDict() == {"label": "work-as-worship", "relation": "discusses", "weight": 0.9}
    p = Q.plans(spark.createDataFrame([("q?", '{"timeless_queries": ["a", "A", " b "], "concepts": ["Self Control", "zz"], "bridge_note": "n",}', ["self-control"]), ("ক", "nope", [])], "question string, raw string, offered array<string>")).collect()
    assert (p[0].ok, p[0].queries, p[0].concepts, p[0].lang) == (True, ["a", "b"], ["self-control"], "en") and (p[1].ok, p[1].queries, p[1].lang) == (False, [], "bn")


def test_packing_stops_at_first_overflow(spark):
    b = spark.createDataFrame([("k", i, n) for i, n in enumerate([50, 30, 40, 5])] + [("j", 0, 500), ("j", 1, 1)], "k string, i int, n int")
    got = Q.packed(b, ["k"], ["i"], F.col("n"), F.lit(100)).select("k", "i").collect()
    assert sorted(map(tuple, got)) == [("j", 0), ("k", 0), ("k", 1)]


def test_rrf_path_b_and_pool(spark):
    c = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.1), ("a", 2, 0.5), ("b", 2, 7.0), ("zero", 9, 1.0)], "level string, paragraph long, score double")
    got = {r.paragraph: r.fused for r in R.rrf(c, {"a": 1.0, "b": 0.7, "zero": 0.0}, []).collect()}
    assert got.keys() == {1, 2} and math.isclose(got[1], 1 / 61) and math.isclose(got[2], 1 / 62 + 0.7 / 61)
    anchors = spark.createDataFrame([(1, 0.8), (2, -0.1)], "concept long, score double")
    e = spark.createDataFrame([(1, 3, 0.9), (1, 4, 0.5), (2, 5, 0.3)], "src long, dst long, weight double")
    assert {r.concept: round(r.score, 6) for r in R.expanded(anchors, e, R.Search()).collect()} == {1: 0.8, 3: round(0.85 * 0.8 * 0.9, 6)}
    hits = spark.createDataFrame([("q", 0, "en", 1, 0.5, ["x", "y"]), ("q", 1, "en", 1, 0.9, ["y", "z", "w"]), ("q", 1, "bn", 1, 0.7, []), ("q", 0, "en", 2, 0.1, ["x"])], "question string, query_id int, lang string, paragraph long, score double, via array<string>")
    got = [r.asDict() for r in R.sources(hits, n=2).orderBy("rank").collect()]
    assert got == [{"question": "q", "lang": "en", "paragraph": 1, "score": 0.9, "via": ["x", "y", "z"], "rank": 1}, {"question": "q", "lang": "bn", "paragraph": 1, "score": 0.7, "via": [], "rank": 2}]
    ahead = R.sources(hits, rerank=lambda p: p.withColumn("rerank", F.col("paragraph").cast("double"))).orderBy("rank").collect()
    assert [(r.paragraph, r.lang) for r in ahead] == [(2, "en"), (1, "bn"), (1, "en")]  # scored once against the question; ties by language
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query long, rank int")
    r = R.recall_mrr(ranks).first()
    assert math.isclose(r.recall_1, 1 / 3) and math.isclose(r.recall_5, 2 / 3) and math.isclose(r.mrr, 1.25 / 3)


def test_statistics(spark):
    assert math.isclose(stats.binomial_two_sided(13, 34), min(1, 2 * sum(math.comb(34, i) for i in range(14)) / 2**34))
    table = lambda a, b, c, d: math.comb(a + b, a) * math.comb(c + d, c) / math.comb(a + b + c + d, a + c)
    assert math.isclose(stats.fisher_two_sided(3, 1, 1, 3), sum(p for p in (table(x, 4 - x, 4 - x, x) for x in range(5)) if p <= table(3, 1, 1, 3) * (1 + 1e-9)))
    assert stats.binomial_two_sided(0, 0) == 1.0
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "x double, y double")
    rx, ry = [1.5, 1.5, 3, 4], [2, 1, 3.5, 3.5]
    assert math.isclose(stats.spearman(df, "x", "y").first().rho, np.corrcoef(rx, ry)[0, 1])
    lo, hi = stats.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(lo, hi).first()[:] == (0.0, 0.0)
    a, b = stats.bootstrap_kappa({(0, 0): 40, (0, 1): 5, (1, 0): 6, (1, 1): 49}, 2000)
    assert a < 0.78 < b


PAGE = """<html><body><h2 class="volume-title">Volume II</h2><div class="section-head">Talks</div>
<div class="chapter" id="ch_9"><h3 class="chapter-title">First &amp; best</h3><p class="chapter-breadcrumb">a breadcrumb that is long enough to count</p>
<div class="chapter-content"><p id="p-1">The first paragraph is <b>long</b> enough.</p><p>short</p><p>The second   paragraph, never closed, is kept.</div></div>
<div class="subsection-head">East</div><div class="chapter"><h3 class="chapter-title">Empty</h3><div class="chapter-content"></div></div>
<div class="chapter"><div class="chapter-content"><p>A paragraph without title or chapter id.</p></div></div>
<h2 class="volume-title">Volume III</h2><div class="chapter" id="ch_9"><h3 class="chapter-title">Again</h3><div class="chapter-content"><p>The same id in another volume, counted anew.</p><script>var t = "</p>";</script></div></div></body></html>"""
ITEMS = """<h3>স্বামী বিবেকানন্দ সমগ্র খন্ড ২</h3><section class="content-block" id="content-1"><div class="scroller"><h2>শিরোনাম</h2><p id="p-7">এটি একটি যথেষ্ট দীর্ঘ অনুচ্ছেদ।</p></div></section>
<h3>স্বামী বিবেকানন্দ সমগ্র খণ্ড ৩</h3><section class="content-block" id="content-2"><p>আরও একটি যথেষ্ট দীর্ঘ অনুচ্ছেদ এখানে।</p></section>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    rows = H.chapters(html.blocks(pages)).orderBy("offset").collect()
    assert [(r.volume_num, r.section, r.chapter, r.chapter_id, r.paragraph_idx) for r in rows] == [(2, "Talks", "First & best", "ch_9", 0), (2, "Talks", "First & best", "ch_9", 1), (2, "Talks / East", "Untitled", "ch_2_2", 0), (3, None, "Again", "ch_9", 0)]
    assert rows[0].text == "The first paragraph is long enough." and rows[0].anchor == "p-1" and PAGE[rows[0].offset :].startswith('<p id="p-1">')
    got = H.items(html.blocks(spark.createDataFrame([(1, ITEMS)], "page_id long, html string"))).orderBy("pos").collect()
    assert [(r.volume, r.volume_num, r.chapter, r.chapter_id) for r in got] == [("খণ্ড ২", 2, "শিরোনাম", "content-1"), ("খণ্ড ৩", 3, "(শিরোনামহীন)", "content-2")]
    raw = "<b> </p><!-- x\ny --><img src=a/></body></html><!DOCTYPE html><html><head><title>t</title></head><body>z<audio>q</audio>"
    page, counts = html.cleaned(F.col("x"))
    r = spark.createDataFrame([(raw,)], "x string").select(page.alias("p"), *[c.alias(k) for k, c in counts.items()]).first()
    assert r.p == "</b> </p>\nz" and (r.comments, r.images, r.boundaries, r.audio, r.bold) == (1, 1, 1, 1, 1)


def test_sessions_reopen(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(["a", "a", "b", "a", None, None])], "g int, i int, k string")
    assert [r.run for r in H.sessions(df, ["g"], ["i"], ["k"], "run").orderBy("i").collect()] == [1, 1, 2, 3, 4, 4]


def test_warm_start(spark):
    p = spark.createDataFrame([(1, "a", "en", "s1"), (2, "b", "en", None), (3, "c", "en", None), (4, "d", "en", None), (5, "", "en", "s"), (6, "e", "en", "")], "paragraph long, text_norm string, lang string, summary string")
    c = spark.createDataFrame([(2, 5, "discusses", 0.5)], "paragraph long, concept long, relation string, weight double")
    named = spark.createDataFrame([(5, "duty")], "concept long, label string")
    pe = spark.createDataFrame([(4, 9)], "paragraph long, entity long")
    entities = spark.createDataFrame([(9, "Ganges", "place")], "entity long, label string, type string")
    assert [r.paragraph for r in W.todo(p, c).where("text_norm IN ('a', 'b', 'c')").collect()] == [3]
    snap = W.snapshot(p, c, "m@v1", named, pe, entities)
    assert sorted(r.text_norm for r in snap.collect()) == ["a", "b", "d"]  # an empty text, and one with nothing to keep, are left out
    fresh = spark.createDataFrame([(9, "b", "en"), (8, "new", "en"), (7, "d", "en"), (6, "b", "bn")], "paragraph long, text_norm string, lang string")
    hit, miss = W.restored(fresh, snap, "m@v1")
    assert sorted(r.paragraph for r in miss.collect()) == [6, 8]
    assert [tuple(r) for r in W.restored_edges(hit).collect()] == [(9, "duty", "discusses", 0.5)]
    assert [tuple(r) for r in W.restored_entities(hit).collect()] == [(7, "Ganges", "place")]
    assert W.restored(p.drop("summary"), snap, "m@v2")[0].count() == 0
    aliases = W.alias_snapshot(spark.createDataFrame([(5, "bn", "k"), (5, "bn", "k")], "concept long, lang string, alias string"), named)
    again = spark.createDataFrame([(77, "duty"), (78, "truth")], "concept long, label string")
    assert [tuple(r) for r in W.restored_aliases(aliases, again).collect()] == [(77, "bn", "k")]
    assert [r.paragraph for r in W.dangling(c, p.select(F.col("paragraph").alias("id")).where("id <> 2"), "paragraph", "id").collect()] == [2]


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long")
    rows.write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        E.microbatches(spark.readStream.schema(rows.schema).parquet(src), lambda b: b.groupBy("k").count(), out, str(tmp_path / "state")).awaitTermination()
    assert Counter({r.k: r["count"] for r in spark.read.parquet(out).collect()}) == Counter({0: 10, 1: 10, 2: 10})


def test_models(spark):
    class Echo:
        def generate(self, prompts):
            return ['{"summary": "ok"}' if "strict" in p else "nothing" for p in prompts]

    got = Q.extracted(spark.createDataFrame([("t",)], "text string"), Echo, lambda x: x, lambda x: "strict " + x).first()
    assert got.parsed.summary == "ok"
    with pytest.raises(ValueError):
        Q.ask("  ", None, None)
    v = spark.createDataFrame([("same words here",), ("words here same",)], "t string").select(Q.hashed_vectors(F.col("t")).alias("v")).collect()
    assert np.allclose(v[0].v, v[1].v) and math.isclose(np.linalg.norm(v[0].v), 1)


def test_paragraphs_outside_of_containers_are_left_out(spark):
    page = '<h3>স্বামী বিবেকানন্দ সমগ্র খণ্ড ২</h3><p>Before the container, of enough length.</p><section class="content-block" id="s1"><h2>One</h2><p id="p-1">Inside the container, of enough length.</p></section><p>After the container, of enough length.</p>'
    got = B.parsed(spark.createDataFrame([(1, "bn", page), (2, None, page.replace("content-block", "x"))], "page_id long, lang string, html string")).collect()
    assert [(r.text, r.volume_num, r.chapter) for r in got] == [("Inside the container, of enough length.", 2, "One")]
    other = H.items(html.blocks(spark.createDataFrame([(1, page.replace("স্বামী বিবেকানন্দ সমগ্র খণ্ড ২", "Part 7"))], "page_id long, html string")), mark=(r"Part [0-9]+", r"Part ([0-9]+)", "Part ")).first()
    assert (other.volume, other.volume_num) == ("Part 7", 7)


def test_pages_without_a_language_are_parsed(spark):
    page = '<div class="chapter" id="c"><h3 class="chapter-title">T</h3><div class="chapter-content"><p>A paragraph of enough length.</p></div></div>'
    assert B.parsed(spark.createDataFrame([(1, None, page)], "page_id long, lang string, html string")).count() == 1


def test_white_space_is_stripped(spark):
    df = spark.createDataFrame([("\n\tFoo\u00a0Bar\t",), (" \u3000",)], "x string")
    assert [r[0] for r in df.select(T.entity_label(F.col("x"))).collect()] == ["Foo Bar", ""]
    assert [r[0] for r in df.select(T.concept_label(F.col("x"))).collect()] == ["foo-bar", ""]
    assert [r[0] for r in df.select(T.sentences_bn(F.col("x"))).collect()] == [["Foo\u00a0Bar"], []]


def test_similarity_is_the_cosine(spark):
    v = spark.createDataFrame([(1, [10.0, 0.0]), (2, [1.0, 9.0]), (3, [0.1, 0.0]), (4, [0.0, 0.0])], "id long, vec array<double>")
    assert [(r.a, r.b) for r in V.similar_pairs(v, 0.92).collect()] == [(1, 3)]


def test_nearest_to_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(200, 5))
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vec array<double>")
    q = v.where("id < 30").select(F.col("id").alias("query"), "vec")
    got = {(r["query"], r["rank"]): r.id for r in V.nearest_to(v, q, 4, block=37, query_block=7).collect()}
    assert got == {(i, k + 1): int(j) for i in range(30) for k, j in enumerate(np.argsort(-(x @ x[i]), kind="stable")[:4])}


def test_pair_counts_are_written_once(spark):
    pc = spark.createDataFrame([(p, c) for p in range(6) for c in range(p)], "paragraph long, concept long")
    want = Counter((a, b) for p in range(6) for b in range(p) for a in range(b))
    assert {(r.a, r.b): r.n for r in G.pair_counts(pc).collect()} == dict(want)


def test_chapter_text_gathers_no_more_than_it_shows(spark):
    rows = [("c", i, f"paragraph {i:04d} of some length") for i in range(2000)] + [("d", 0, "a" * 30_000)]
    got = {r.k: r.text for r in H.chapter_text(spark.createDataFrame(rows, "k string, paragraph_idx int, text string"), ["k"], F.concat(F.lit("T "), "k")).collect()}
    assert got["c"] == "T c\n\n" + " ".join(x for k, _, x in rows if k == "c")[:16_384] and got["d"] == "T d\n\n" + "a" * 16_384


def test_running_ranks_over_ranges(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randint(0, 50), rng.random() * 1000]) for _ in range(3000)]
    got = [(r.x, r["rank"]) for r in stats.midranks(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", "rank").collect()]
    order = sorted(values)
    first = {v: i for i, v in reversed(list(enumerate(order)))}
    n = Counter(values)
    assert sorted(got) == sorted((v, first[v] + (n[v] + 1) / 2) for v in values)


def test_bm25_in_blocks_of_queries(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("alpha beta gamma delta the of".split(), k=20))) for i in range(60)] + [(99, None)], "doc long, text string")
    queries = spark.createDataFrame([(1, "Alpha the the"), (2, "gamma nowhere"), (3, "")], "query long, text string")
    one = sorted(tuple(r) for r in R.bm25(docs, queries, 5).collect())
    assert one == sorted(tuple(r) for r in R.bm25(docs, queries, 5, most_terms=1).collect()) and {r[0] for r in one} == {1, 2} and len(one) == 10


def test_a_graph_that_is_too_large_is_refused(spark):
    nodes = spark.range(20).select("id", F.lit("x").alias("label"), F.lit(1).alias("n_mentions"))
    with pytest.raises(ValueError):
        G.graph_spec(nodes, spark.createDataFrame([], "a long, b long, relation string, weight double"), nodes.select("id"), max_nodes=10)


def test_backends():
    assert Q.backend(["missing", "echo"])().generate(["a\nb"]) == ["b"]
    with pytest.raises(RuntimeError, match="missing: unknown"):
        Q.backend(["missing"])


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from loomgraph.sources import store

    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host", applicationId="x", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="checkpoint"):
        store.shared_root(far)


def test_entry_survives_a_missing_library(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as e

    real = builtins.__import__

    def without(name, *a, **k):
        if name == "xxhash":
            raise ModuleNotFoundError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith("loomgraph.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    assert "fused_search" in e.queries() and "pipeline" not in e.queries() and "fused_search" in e.oracle_sql()


def test_remapped_pairs_rounds_distances(spark):
    """Two similarities as far from the recorded one, but for the noise of the subtraction: the smaller id."""
    p = spark.createDataFrame([(1, "en", "t", 3179.79), (2, "en", "t", 2819.34), (3, "en", "none", 1.0)], "pair long, lang string, title string, recorded double")
    c = spark.createDataFrame([(792, "en", "t", 3203.26), (5098, "en", "t", 3156.32), (9218, "en", "t", 2846.31), (5567, "en", "t", 2792.37), (1, "bn", "t", 3179.79)], "id long, lang string, title string, sim double")
    assert {r.pair: r.id for r in R.remapped_pairs(p, c, places=2).collect()} == {1: 792, 2: 5567}


def test_remapped_pairs_compares_near_cells_only(spark):
    """As brute force, with odd values and repeated pairs; no join gives more than a few rows a pair, though all share one title."""
    rng = np.random.default_rng(4)
    odd = [math.inf, -math.inf, math.nan, None]
    draw = lambda n: [float(round(x, int(k))) for x, k in zip(rng.normal(size=n) * 30, rng.integers(1, 5, n))] + odd
    cur = [(int(i), "t", x) for i, x in zip(rng.permutation(404), draw(400))] + [(1000 + i, "odd", x) for i, x in enumerate(odd)] + [(2000 + i, f"only{i}", x) for i, x in enumerate(odd)]
    old = [(i % 1800, name, x) for i, (name, x) in enumerate([("t", x) for x in draw(2000)] + [(name, x) for name in ("odd", "only0", "only2", "only3", "gone") for x in [1.0, *odd]])]

    def far(s, r):
        x = None if s is None or r is None else abs(s - r) * 100
        return (x is None, x is not None and x != x, 0 if x is None or x != x else x if x == math.inf else math.floor(x) + (x - math.floor(x) >= 0.5))

    want = {}
    for pair, name, r in old:
        for i, title, s in cur:
            if title == name:
                want[pair] = min(want.get(pair, (True, True, math.inf, math.inf)), (*far(s, r), i))
    p = spark.createDataFrame([(a, "en", b, c) for a, b, c in old], "pair long, lang string, title string, recorded double")
    c = spark.createDataFrame([(a, "en", b, c) for a, b, c in cur], "id long, lang string, title string, sim double")
    got = R.remapped_pairs(p, c, places=2)
    assert {r.pair: r.id for r in got.collect()} == {k: v[-1] for k, v in want.items()}

    def most(node):
        kids = [node.children().apply(i) for i in range(node.children().size())]
        kids += [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else []
        own = node.metrics().get("numOutputRows")
        joins = "Join" in node.nodeName() and own.isDefined()
        return max([own.get().value() if joins else 0, *map(most, kids)])

    plan = got._jdf.queryExecution().executedPlan()
    got._jdf.collectToPython()
    plan = got._jdf.queryExecution().executedPlan()
    assert 0 < most(plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan) < 15 * len(old)


def test_duplicate_groups_without_pairs(spark):
    """The groups of merge_groups in blocks of any size: chains, copies, vectors of all lengths, null and zero ones."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6))
    x[100:140] = x[7]
    x[150:160] = 0
    v = spark.createDataFrame([(int(i) * 3, r) for i, r in zip(rng.permutation(300), (x * rng.uniform(0.1, 9, (300, 1))).tolist())], "id long, vec array<double>")
    pairs = V.similar_pairs(v, 0.85)
    want = {(r.leader, r.member) for r in V.merge_groups(G.components(pairs.select("a", "b")), pairs).collect()}
    assert len({a for a, _ in want}) > 20
    for block in (1 << 16, 37):
        assert {(r.leader, r.member) for r in V.duplicate_groups(v, 0.85, block=block).collect()} == want
    holed = v.unionByName(spark.createDataFrame([(1, None)], v.schema))
    assert {(r.leader, r.member) for r in V.duplicate_groups(holed, 0.85).collect()} == want
    assert V.duplicate_groups(v.limit(0), 0.85).count() == 0 and V.duplicate_groups(v.limit(1), 0.85).count() == 0
