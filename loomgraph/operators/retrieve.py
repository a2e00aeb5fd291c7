"""Retrieval: two paths, weighted reciprocal rank fusion, BM25, pools over several queries, evaluation."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import written
from . import graph as G
from . import vectors as V

_WORD = re.compile(r"\w+")

#: The rank constant of the fusion.
RRF_K = 60


@dataclass(frozen=True)
class Search:
    """Defaults that are part of the query semantics."""

    k_sentence: int = 30
    k_paragraph: int = 20
    k_chapter: int = 10
    k_concepts: int = 12
    hops: int = 1
    k_per_concept: int = 5
    pool: int = 60
    top_k: int = 8
    w_sentence: float = 1.0
    w_paragraph: float = 1.0
    w_chapter: float = 0.7
    w_concept: float = 1.2
    min_weight: float = 0.4
    damping: float = 0.85


def rrf(candidates: DataFrame, weights: dict[str, float], keys: list[str], item: str = "paragraph", k: int = RRF_K) -> DataFrame:
    """(keys, item, fused, levels). candidates: keys, level, item, score. The best score per level and item counts; ranks from 1, ties by item."""
    used = {n: w for n, w in weights.items() if w}
    best = candidates.where(F.col("level").isin(list(used))).groupBy(*keys, "level", item).agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "level").orderBy(F.desc("score"), item)))
    w = F.create_map(*[F.lit(x) for n, v in used.items() for x in (n, float(v))])
    return ranked.groupBy(*keys, item).agg(F.sum(w[F.col("level")] / (F.lit(float(k)) + F.col("rank"))).alias("fused"), F.array_sort(F.collect_set("level")).alias("levels"))


def expanded(anchors: DataFrame, edges: DataFrame, s: Search) -> DataFrame:
    """(concept, score): anchors and the strongest neighbours of each, damped; the largest score of a concept stays. anchors: concept, score."""
    near = G.neighbors(edges, anchors.select(F.col("concept").alias("src")), s.hops, s.min_weight)
    near = near.join(anchors.select(F.col("concept").alias("src"), "score"), "src").select(F.col("dst").alias("concept"), (s.damping * F.col("score") * F.col("weight")).alias("score"))
    return anchors.select("concept", "score").unionByName(near).groupBy("concept").agg(F.max("score").alias("score")).where("score > 0")


def concept_paragraphs(anchors: DataFrame, edges: DataFrame, pc: DataFrame, s: Search) -> DataFrame:
    """(paragraph, score, via): path B, the best of concept score times edge weight, and the three best concepts."""
    c = expanded(anchors, edges, s)
    hits = G.paragraphs_for(pc, c, s.k_per_concept).join(c, "concept").withColumn("s", F.col("score") * F.col("weight"))
    return hits.groupBy("paragraph").agg(F.max("s").alias("score"), F.slice(F.transform(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("o"), "concept"))), lambda x: x["concept"]), 1, 3).alias("via"))


def top_hits(fused: DataFrame, metadata: DataFrame, s: Search, rerank: Callable[[DataFrame], DataFrame] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The pool by fused score, reranked if asked for, cut to top_k; rerank sees no more than the pool and adds `rerank`."""
    keys = keys or []
    by = lambda c: Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(c), "paragraph")
    pool = fused.withColumn("_n", F.row_number().over(by("fused"))).where(F.col("_n") <= s.pool).drop("_n") if keys else fused.orderBy(F.desc("fused"), "paragraph").limit(s.pool)
    pool = pool.join(metadata, "paragraph")
    pool = rerank(pool) if rerank else pool.withColumn("rerank", F.col("fused"))
    return pool.withColumn("rank", F.row_number().over(by("rerank"))).where(F.col("rank") <= s.top_k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, most_terms: int = 200_000) -> DataFrame:
    """(query, doc, score, rank) of positive scores. docs: doc, text; queries: query, text. Repeated query words count each time.

    Queries are a given set. Their words are held in memory, most_terms at once; more are done in blocks of queries. Documents are read twice, for the words' document
    counts and for the scores; a task keeps the k best documents of each query, so neither words nor pairs are shuffled.
    """
    asked = queries.select("query", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    asked = written(asked, "bm25-queries")
    blocks = max(1, -(-asked.count() // most_terms))
    outs = [_bm25_block(docs, asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).collect(), k, k1, b) for i in range(blocks)]
    found = reduce(DataFrame.unionByName, outs)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc"))).where(F.col("rank") <= k)


def _bm25_block(docs: DataFrame, asked: list, k: int, k1: float, b: float) -> DataFrame:
    """Scores for the queries of (query, term, qf) rows."""
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in asked}))}
    names = sorted({r["query"] for r in asked})
    place = {q: i for i, q in enumerate(names)}
    # by term: its queries and how often they ask for it
    by_term: list[tuple[list[int], list[int]]] = [([], []) for _ in terms]
    for r in asked:
        by_term[terms[r["term"]]][0].append(place[r["query"]])
        by_term[terms[r["term"]]][1].append(r["qf"])
    lists = [(np.array(q), np.array(n, float)) for q, n in by_term]
    rows = docs.select("doc", F.lower("text").alias("text"))

    def held(text: str | None) -> tuple[int, dict[int, int]]:
        words = _WORD.findall(text or "")
        return len(words), Counter(terms[w] for w in words if w in terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                length, own = held(text)
                df[list(own)] += 1
                n, size = n + 1, size + length
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *seen.tolist()], pa.int64()), pa.array([n, size, *df[seen].tolist()], pa.int64())], names=["term", "n"])

    counts = {r["term"]: r["n"] for r in rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, size = counts.get(-1, 0), counts.get(-2, 0)
    avgdl = size / n_docs if n_docs and size else 1.0
    idf = np.array([math.log(1 + (n_docs - counts.get(i, 0) + 0.5) / (counts.get(i, 0) + 0.5)) for i in range(len(terms))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in names]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                length, own = held(text)
                total = np.zeros(len(names))
                for t, f in sorted(own.items()):
                    q, qf = lists[t]
                    total[q] += qf * (idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * length / avgdl)))
                for q in np.flatnonzero(total > 0).tolist():
                    item = (round(float(total[q]), 9), -doc, float(total[q]))
                    if len(best[q]) < k:
                        heapq.heappush(best[q], item)
                    elif item > best[q][0]:
                        heapq.heapreplace(best[q], item)
        out = [(names[q], -d, s) for q, heap in enumerate(best) for _, d, s in heap]
        columns = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.int64()), pa.array(list(columns[2]), pa.float64())], names=["query", "doc", "score"])

    return rows.mapInArrow(score, "query long, doc long, score double")


def entity_paragraphs(anchors: DataFrame, pe: DataFrame, k: int) -> DataFrame:
    """Paragraphs by the summed similarity of the anchored entities they hold. anchors: entity, sim; pe: paragraph, entity."""
    got = pe.select("paragraph", "entity").distinct().join(anchors, "entity").groupBy("paragraph").agg(F.sum("sim").alias("score"))
    return got.orderBy(F.desc(F.round("score", 9)), "paragraph").limit(k)


def recall_mrr(ranks: DataFrame, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Means over queries; rank is null where the gold item was not found. ranks: query, rank."""
    hit = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)).alias(f"recall_{n}")
    return ranks.agg(F.count("*").alias("n"), *[hit(n) for n in at], F.avg(F.coalesce(1.0 / F.col("rank").cast("double"), F.lit(0.0))).alias("mrr"))


def remapped_pairs(pairs: DataFrame, current: DataFrame, places: int = 9) -> DataFrame:
    """Pairs whose recorded id is stale get the id with the same (lang, title) whose similarity is closest to the recorded one.

    Distances are compared after rounding to `places` decimals, half away from zero, so the noise of a subtraction decides nothing; ties go to the smaller id. Infinite, NaN and
    null similarities come after the others, in this order.

    A cell holds the similarities of a title that agree to `places` decimals. The closest lies in the recorded value's own cell, in the nearest that are taken on either
    side, or, where it rounds alike, in those behind them: a recorded value meets the distinct similarities of five cells, not all of its title.
    """
    title = ["lang", "title"]

    def cell(x: Column) -> Column:
        """Null for what is no finite number."""
        return F.when(F.abs(x) < math.inf, F.floor(F.greatest(F.least(x * float(10**places), F.lit(9e18)), F.lit(-9e18))))

    known = current.select(*title, F.col("sim").cast("double").alias("sim"), "id").groupBy(*title, "sim").agg(F.min("id").alias("id")).withColumn("cell", cell(F.col("sim")))
    asked = pairs.select(*title, F.col("recorded").cast("double").alias("recorded")).distinct().withColumn("cell", cell(F.col("recorded")))
    cells = known.select(*title, "cell", F.col("cell").alias("taken")).unionByName(asked.select(*title, "cell", F.lit(None).cast("long").alias("taken")))
    cells = cells.where("cell IS NOT NULL").groupBy(*title, "cell").agg(F.max("taken").alias("taken"))
    near = lambda order: F.last("taken", ignorenulls=True).over(Window.partitionBy(*title).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumns({"below": near(F.asc("cell")), "above": near(F.desc("cell"))})
    look = F.array("taken", "below", F.col("below") - 1, "above", F.col("above") + 1)
    looked = asked.join(cells, [*title, "cell"], "left").select(*title, "recorded", F.array_distinct(F.array_compact(look)).alias("cells"))
    found = looked.select(*title, "recorded", F.explode("cells").alias("cell")).join(known, [*title, "cell"]).drop("cell")
    # what has no number to compare: of each kind of similarity, all numbers being one kind, the smallest id
    kinds = known.groupBy(*title, F.when(F.col("cell").isNull(), F.col("sim")).alias("odd"), F.col("cell").isNull().alias("is_odd")).agg(F.min(F.struct("id", "sim")).alias("k"))
    other = looked.where(F.size("cells") == 0).drop("cells").join(kinds.select(*title, "k.id", "k.sim"), title)
    far = F.round(F.abs(F.col("sim") - F.col("recorded")) * float(10**places))
    found = found.select(*title, "recorded", "id", "sim").unionByName(other.select(*title, "recorded", "id", "sim"))
    best = found.groupBy(*title, "recorded").agg(F.min(F.struct(far.isNull().alias("none"), far.alias("far"), "id")).alias("best"))
    mine, theirs = pairs.select("pair", *title, F.col("recorded").cast("double").alias("recorded")).alias("p"), best.alias("b")
    on = [F.col(f"p.{c}") == F.col(f"b.{c}") for c in title] + [F.col("p.recorded").eqNullSafe(F.col("b.recorded"))]
    return mine.join(theirs, on).groupBy("p.pair").agg(F.min("b.best")["id"].alias("id"))


@dataclass(frozen=True)
class Index:
    """What a search reads; vectors have the column vec.

    sentences: sentence, paragraph, lang, vec; paragraphs: paragraph, lang, vec; chapters: chapter, lang, vec; members: paragraph, chapter, paragraph_idx;
    concepts: concept, vec; edges: src, dst, relation, weight (built, see vectors.similarity_edges and graph.cooccurrence_edges); paragraph_concepts: paragraph,
    concept, weight; metadata: paragraph, lang and what a hit shows.
    """

    sentences: DataFrame
    paragraphs: DataFrame
    chapters: DataFrame
    members: DataFrame
    concepts: DataFrame
    edges: DataFrame
    paragraph_concepts: DataFrame
    metadata: DataFrame


def vector_lists(queries: DataFrame, index: Index, s: Search, langs: list[str], per_chapter: int = 2) -> DataFrame:
    """(query, lang, level, paragraph, score, sentence): path A, the nearest sentences, paragraphs and chapters of each language, as paragraphs.

    queries: query, vec. A chapter stands for its first per_chapter paragraphs. A level with a weight of zero is not searched.
    """
    none = lambda kind: F.lit(None).cast(kind)
    first = index.members.withColumn("_n", F.row_number().over(Window.partitionBy("chapter").orderBy("paragraph_idx", "paragraph"))).where(F.col("_n") <= per_chapter).select("chapter", "paragraph")
    lists = []
    for lang in langs:
        level = lambda df, name, sentence: df.select("query", F.lit(lang).alias("lang"), F.lit(name).alias("level"), "paragraph", "score", sentence.alias("sentence"))  # noqa: B023, E731
        if s.w_sentence:
            own = index.sentences.where(F.col("lang") == lang)
            hits = V.nearest_to(own, queries, s.k_sentence, "sentence").withColumnRenamed("id", "sentence").join(own.select("sentence", "paragraph"), "sentence")
            lists.append(level(hits, "sentence", F.col("sentence")))
        if s.w_paragraph:
            hits = V.nearest_to(index.paragraphs.where(F.col("lang") == lang), queries, s.k_paragraph, "paragraph").withColumnRenamed("id", "paragraph")
            lists.append(level(hits, "paragraph", none("long")))
        if s.w_chapter:
            hits = V.nearest_to(index.chapters.where(F.col("lang") == lang), queries, s.k_chapter, "chapter").withColumnRenamed("id", "chapter")
            lists.append(level(hits.join(first, "chapter"), "chapter", none("long")))
    spark = queries.sparkSession
    empty = spark.createDataFrame([], "query long, lang string, level string, paragraph long, score double, sentence long")
    return reduce(DataFrame.unionByName, lists) if lists else empty


def concept_lists(queries: DataFrame, index: Index, s: Search, langs: list[str]) -> DataFrame:
    """(query, lang, level, paragraph, score, concept, concept_score): path B of each language, a row per concept that leads to a paragraph."""
    anchors = V.nearest_to(index.concepts, queries, s.k_concepts, "concept").select("query", F.col("id").alias("concept"), "score")
    near = G.neighbors(index.edges, anchors.select(F.col("concept").alias("src")), s.hops, s.min_weight)
    near = near.join(anchors.select("query", F.col("concept").alias("src"), "score"), "src").select("query", F.col("dst").alias("concept"), (s.damping * F.col("score") * F.col("weight")).alias("score"))
    combined = anchors.unionByName(near).groupBy("query", "concept").agg(F.max("score").alias("concept_score")).where("concept_score > 0")
    best = G.paragraphs_for(index.paragraph_concepts, combined, s.k_per_concept, index.metadata, langs, by_lang=True)
    hits = best.join(combined, "concept")
    return hits.select("query", "lang", F.lit("concept").alias("level"), "paragraph", (F.col("concept_score") * F.col("weight")).alias("score"), "concept", "concept_score")


def search(queries: DataFrame, index: Index, s: Search = Search(), langs: list[str] | None = None, top_k: int = 0, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query, lang, rank, paragraph, score, fused, levels, via, matched, ...metadata): the hits of each query in each language.

    queries: query, text, vec. Blank queries have no hits; a top_k of 0 means the default. rerank sees the pool with the columns query, text and those of the metadata and adds
    `rerank`; without it the fused score ranks. via: the three best concepts that lead to the paragraph. matched: the best sentence
    hit of the paragraph, else its sentence nearest to the query.
    """
    langs = langs or ["en", "bn"]
    asked = queries.where(F.length(T.stripped(F.col("text"))) > 0)
    keys = ["query", "lang"]
    weights = {"sentence": s.w_sentence, "paragraph": s.w_paragraph, "chapter": s.w_chapter, "concept": s.w_concept}
    a = written(vector_lists(asked, index, s, langs), "path-a")
    b = concept_lists(asked, index, s, langs) if s.w_concept else None
    candidates = a.select(*keys, "level", "paragraph", "score")
    if b is not None:
        b = written(b, "path-b")
        candidates = candidates.unionByName(b.select(*keys, "level", "paragraph", "score"))
    fused = rrf(candidates, weights, keys)
    pool = fused.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fused"), "paragraph"))).where(F.col("_n") <= s.pool).drop("_n")
    pool = pool.join(index.metadata, ["paragraph", "lang"])
    pool = rerank(pool.join(asked.select("query", F.col("text").alias("question")), "query")) if rerank else pool.withColumn("rerank", F.col("fused"))
    order = Window.partitionBy(*keys).orderBy(F.desc("rerank"), F.desc("fused"), "paragraph")
    hits = pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (top_k or s.top_k)).withColumnRenamed("rerank", "score").drop("question")
    hits = written(hits, "hits")
    told = a.where("sentence IS NOT NULL").groupBy(*keys, "paragraph").agg(F.max_by("sentence", F.struct("score", -F.col("sentence"))).alias("matched"))
    hits = hits.join(told, [*keys, "paragraph"], "left")
    # the sentences of the few paragraphs without a sentence hit
    left = hits.where("matched IS NULL").select(*keys, "paragraph").join(index.sentences.select("paragraph", "sentence", "vec"), "paragraph").join(asked.select("query", F.col("vec").alias("qvec")), "query")
    near = left.withColumn("sim", V.dot(F.col("vec"), F.col("qvec"))).groupBy(*keys, "paragraph").agg(F.max_by("sentence", F.struct("sim", -F.col("sentence"))).alias("nearest"))
    hits = hits.join(near, [*keys, "paragraph"], "left").withColumn("matched", F.coalesce("matched", "nearest")).drop("nearest")
    if b is None:
        return hits.withColumn("via", F.array().cast("array<bigint>"))
    ways = F.slice(F.transform(F.array_sort(F.collect_set(F.struct((-F.col("concept_score")).alias("o"), "concept"))), lambda x: x["concept"]), 1, 3)
    via = b.groupBy(*keys, "paragraph").agg(ways.alias("via"))
    return hits.join(via, [*keys, "paragraph"], "left").withColumn("via", F.coalesce("via", F.array().cast("array<bigint>")))


def sources(hits: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None = None, n: int = 10, most_via: int = 3) -> DataFrame:
    """(question, rank, lang, paragraph, score, via): the pool of a question's searches, scored once against the question itself, the n best kept.

    hits: question, query_id (the place of the search), lang, paragraph, score, via. Without a reranker the best score of a paragraph stays.
    """
    keys = ["question", "lang", "paragraph"]
    lists = F.transform(F.array_sort(F.collect_list(F.struct("query_id", "via"))), lambda x: x["via"])
    pool = hits.groupBy(*keys).agg(F.max("score").alias("score"), F.slice(F.array_distinct(F.flatten(lists)), 1, most_via).alias("via"))
    pool = rerank(pool).withColumn("score", F.col("rerank")).drop("rerank") if rerank else pool
    order = Window.partitionBy("question").orderBy(F.desc("score"), "lang", "paragraph")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


#: The weights of the evaluated configurations; `bm25` and `entity` are lists of their own.
CONFIGURATIONS = {
    "dense_paragraph": {"w_sentence": 0.0, "w_chapter": 0.0, "w_concept": 0.0},
    "path_a": {"w_concept": 0.0},
    "path_b": {"w_sentence": 0.0, "w_paragraph": 0.0, "w_chapter": 0.0},
    "fused": {},
    "fused_rerank": {},
}


def known_items(pairs: DataFrame, index: Index, lists: dict[str, DataFrame], rerank: Callable[[DataFrame], DataFrame], s: Search = Search(), k: int = 10) -> DataFrame:
    """(config, direction, n, recall_10, mrr): how well each chapter is found by asking for the chapter that it is paired with, in the other language.

    pairs: query, direction, target (language), text, vec, gold (chapter). lists: hits of other methods, (query, target, rank, paragraph) by name. A configuration
    with `rerank` in its name uses the reranker. Candidates are searched once, for all pairs together, and weighed by each configuration.
    """
    langs = [r[0] for r in pairs.select("target").distinct().orderBy("target").collect()]
    asked = pairs.select("query", "text", "vec").dropDuplicates(["query"])
    found = {}
    base = written(vector_lists(asked, index, s, langs).select("query", "lang", "level", "paragraph", "score").unionByName(concept_lists(asked, index, s, langs).select("query", "lang", "level", "paragraph", "score")), "known-items")
    for name, change in CONFIGURATIONS.items():
        c = replace(s, **change)
        fused = rrf(base, {"sentence": c.w_sentence, "paragraph": c.w_paragraph, "chapter": c.w_chapter, "concept": c.w_concept}, ["query", "lang"])
        order = lambda by: Window.partitionBy("query", "lang").orderBy(*[F.desc(x) for x in by], "paragraph")
        pool = fused.withColumn("_n", F.row_number().over(order(["fused"]))).where(F.col("_n") <= c.pool).drop("_n")
        pool = rerank(pool.join(index.metadata, ["paragraph", "lang"]).join(asked.select("query", F.col("text").alias("question")), "query")) if "rerank" in name else pool.withColumn("rerank", F.col("fused"))
        found[name] = pool.withColumn("rank", F.row_number().over(order(["rerank", "fused"]))).where(F.col("rank") <= k).select("query", F.col("lang").alias("target"), "rank", "paragraph")
    outs = []
    for name, hits in {**lists, **found}.items():
        chapters = hits.where(F.col("rank") <= k).join(index.members.select("paragraph", "chapter"), "paragraph")
        got = pairs.join(chapters, ["query", "target"], "left").groupBy("query", "direction").agg(F.min(F.when(F.col("chapter") == F.col("gold"), F.col("rank"))).alias("rank"))
        own = got.groupBy("direction").agg(F.count("*").alias("n"), F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}"), F.avg(F.coalesce(1.0 / F.col("rank").cast("double"), F.lit(0.0))).alias("mrr"))
        outs.append(own.select(F.lit(name).alias("config"), "direction", "n", f"recall_{k}", "mrr"))
    return reduce(DataFrame.unionByName, outs)


def chapter_info(members: DataFrame, paragraphs: DataFrame, most: int = 800) -> DataFrame:
    """(chapter, first_paragraph): the beginning of each chapter's first paragraph. members: paragraph, chapter, paragraph_idx; paragraphs: paragraph, text."""
    first = members.groupBy("chapter").agg(F.min_by("paragraph", F.struct("paragraph_idx", "paragraph")).alias("paragraph"))
    return first.join(paragraphs.select("paragraph", "text"), "paragraph").select("chapter", F.substring("text", 1, most).alias("first_paragraph"))
