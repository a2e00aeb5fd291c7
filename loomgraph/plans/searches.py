"""Searches by language: hits with metadata, reranking, several questions, and the known-item evaluation.

Mapping: an embedding is a sentence, two of them make a paragraph (the even one is also the paragraph's own vector), of which every other one is `en` or
`bn`; twenty paragraphs of a language make a chapter, whose vector is their mean. Every fifth embedding is a concept; concepts meet paragraphs in lineitem.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieve as R
from ..operators import vectors as V
from .base import query, t, vectors

LANG = lambda p: F.when(p % 4 == 0, "en").otherwise("bn")
CHAPTER = lambda p: F.floor(p / 80) * 2 + F.floor((p % 4) / 2)


def index(spark, d) -> R.Index:
    v = vectors(spark, d).select("id", V.as_double(F.col("vec")).alias("vec"))
    paragraph = F.col("id") - F.col("id") % 2
    sentences = v.select(F.col("id").alias("sentence"), paragraph.alias("paragraph"), LANG(paragraph).alias("lang"), "vec")
    paragraphs = v.where("id % 2 = 0").select(F.col("id").alias("paragraph"), LANG(F.col("id")).alias("lang"), "vec")
    members = paragraphs.select("paragraph", CHAPTER(F.col("paragraph")).alias("chapter"), F.col("paragraph").alias("paragraph_idx"))
    dims = paragraphs.select(CHAPTER(F.col("paragraph")).alias("chapter"), "lang", F.posexplode("vec").alias("d", "x")).groupBy("chapter", "lang", "d").agg(F.avg("x").alias("x"))
    chapters = dims.groupBy("chapter", "lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))
    concepts = v.where("id % 5 = 0").select(F.col("id").alias("concept"), "vec")
    pairs = V.similar_pairs(concepts.withColumnRenamed("concept", "id"), 0.30)
    edges = V.similarity_edges(pairs).select("src", "dst", F.lit("similar").alias("relation"), F.col("sim").alias("weight"))
    # every order's parts as concepts of the paragraph with twice its number
    li = t(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("paragraph"), (F.col("l_partkey") % 100 * 5).alias("concept"), (1 - F.col("l_discount")).alias("weight"))
    pc = G.upsert_max(li, ["paragraph", "concept"])
    return R.Index(sentences, paragraphs, chapters, members, concepts, edges, pc, paragraphs.select("paragraph", "lang", (F.col("paragraph") * 37 % 101).alias("text_rank")))


def asked(spark, d, ids: list[int]):
    """Queries: embeddings by id; the text is blank for the last."""
    v = vectors(spark, d).where(F.col("id").isin(ids))
    return v.select(F.col("id").alias("query"), F.when(F.col("id") == ids[-1], " ").otherwise("text").alias("text"), V.as_double(F.col("vec")).alias("vec"))


# the same index in SQL
INDEX = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
sent AS (SELECT id AS sentence, id - id % 2 AS paragraph, CASE WHEN (id - id % 2) % 4 = 0 THEN 'en' ELSE 'bn' END AS lang, v FROM v),
para AS (SELECT paragraph, lang, v, paragraph // 80 * 2 + (paragraph % 4) // 2 AS chapter FROM sent WHERE sentence = paragraph),
chap AS (SELECT chapter, any_value(lang) AS lang, list(x ORDER BY d) AS v FROM (SELECT chapter, any_value(lang) AS lang, d, avg(x) AS x FROM (SELECT chapter, lang, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM para) GROUP BY chapter, d) GROUP BY chapter),
head AS (SELECT chapter, paragraph FROM (SELECT chapter, paragraph, row_number() OVER (PARTITION BY chapter ORDER BY paragraph) AS n FROM para) WHERE n <= 2),
conc AS (SELECT id AS concept, v FROM v WHERE id % 5 = 0),
edge AS (SELECT * FROM (SELECT a.concept AS src, b.concept AS dst, list_cosine_similarity(a.v, b.v) AS weight, row_number() OVER (PARTITION BY a.concept ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.concept) AS r FROM conc a JOIN conc b ON a.concept <> b.concept WHERE list_cosine_similarity(a.v, b.v) >= 0.30) WHERE r <= 13),
pc AS (SELECT paragraph, lang, concept, max(weight) AS weight FROM (SELECT l_orderkey * 2 AS paragraph, l_partkey % 100 * 5 AS concept, 1 - l_discount AS weight FROM lineitem) JOIN para USING (paragraph) GROUP BY ALL)"""
LISTS = """{q},
s1 AS (SELECT q AS query, sent.lang, 'sentence' AS level, sent.paragraph, list_inner_product(sent.v, q.v) AS score, sentence, row_number() OVER (PARTITION BY q, sent.lang ORDER BY list_inner_product(sent.v, q.v) DESC, sentence) AS r FROM sent, q),
s2 AS (SELECT q AS query, para.lang, 'paragraph' AS level, paragraph, list_inner_product(para.v, q.v) AS score, row_number() OVER (PARTITION BY q, para.lang ORDER BY list_inner_product(para.v, q.v) DESC, paragraph) AS r FROM para, q),
s3 AS (SELECT q AS query, chap.lang, 'chapter' AS level, chapter, list_inner_product(chap.v, q.v) AS score, row_number() OVER (PARTITION BY q, chap.lang ORDER BY list_inner_product(chap.v, q.v) DESC, chapter) AS r FROM chap, q),
anchor AS (SELECT * FROM (SELECT q AS query, concept, list_inner_product(conc.v, q.v) AS score, row_number() OVER (PARTITION BY q ORDER BY list_inner_product(conc.v, q.v) DESC, concept) AS r FROM conc, q) WHERE r <= 12),
hop AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM edge WHERE weight >= 0.4) WHERE n = 1),
both_ AS (SELECT query, concept, max(score) AS cs FROM (SELECT query, concept, score FROM anchor UNION ALL SELECT query, dst, 0.85 * score * weight FROM anchor JOIN hop ON src = concept) GROUP BY ALL HAVING max(score) > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept, lang ORDER BY weight DESC, paragraph) AS n FROM pc WHERE concept IN (SELECT concept FROM both_)) WHERE n <= 5),
s4 AS (SELECT query, lang, 'concept' AS level, paragraph, cs * weight AS score, concept, cs FROM best JOIN both_ USING (concept)),
cand AS (SELECT query, lang, level, paragraph, score FROM s1 WHERE r <= 30 UNION ALL SELECT query, lang, level, paragraph, score FROM s2 WHERE r <= 20 UNION ALL SELECT query, lang, level, paragraph, score FROM s3 JOIN head USING (chapter) WHERE r <= 10 UNION ALL SELECT query, lang, level, paragraph, score FROM s4)"""
FUSED = """ranked AS (SELECT query, lang, level, paragraph, row_number() OVER (PARTITION BY query, lang, level ORDER BY max(score) DESC, paragraph) AS r FROM cand GROUP BY query, lang, level, paragraph),
fused AS (SELECT query, lang, paragraph, sum(CASE level WHEN 'sentence' THEN 1.0 WHEN 'paragraph' THEN 1.0 WHEN 'chapter' THEN 0.7 ELSE 1.2 END::DOUBLE / (60 + r)) AS fused, string_agg(level, ',' ORDER BY level) AS levels FROM ranked GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, lang ORDER BY fused DESC, paragraph) AS n FROM fused) WHERE n <= 60)"""
TOLD = """told AS (SELECT query, lang, paragraph, arg_max(sentence, (score, -sentence)) AS m FROM s1 WHERE r <= 30 GROUP BY ALL),
near AS (SELECT q AS query, paragraph, arg_max(sentence, (list_inner_product(sent.v, q.v), -sentence)) AS m FROM sent, q GROUP BY ALL),
ways AS (SELECT query, lang, paragraph, string_agg(concept, ',' ORDER BY n) AS via FROM (SELECT DISTINCT query, lang, paragraph, concept, row_number() OVER (PARTITION BY query, lang, paragraph ORDER BY cs DESC, concept) AS n FROM s4) WHERE n <= 3 GROUP BY ALL)"""
HITS = "SELECT query, lang, rank, paragraph, round(fused, 6) AS fused, levels, coalesce(told.m, near.m) AS matched, coalesce(via, '') AS via FROM (SELECT *, row_number() OVER (PARTITION BY query, lang ORDER BY {by}) AS rank FROM pool) LEFT JOIN told USING (query, lang, paragraph) LEFT JOIN near USING (query, paragraph) LEFT JOIN ways USING (query, lang, paragraph) WHERE rank <= {k}"


def shown(hits):
    return hits.select("query", "lang", "rank", "paragraph", F.round("fused", 6).alias("fused"), F.array_join("levels", ",").alias("levels"), "matched", F.array_join(F.col("via").cast("array<string>"), ",").alias("via"))


Q3 = "q AS (SELECT id AS q, v FROM v WHERE id IN (0, 7))"


@query(f"WITH {INDEX}, {LISTS.format(q=Q3)}, {FUSED}, {TOLD} {HITS.format(by='fused DESC, paragraph', k=8)}")
def search_per_language(spark, d):
    """Two questions and a blank one, which has no hits; the default number of hits."""
    return shown(R.search(asked(spark, d, [0, 7, 11]), index(spark, d)))


@query(f"WITH {INDEX}, {LISTS.format(q=Q3)}, {FUSED}, {TOLD} {HITS.format(by='(paragraph * 37) % 101 DESC, fused DESC, paragraph', k=5)}")
def search_reranked(spark, d):
    """The pool of sixty put in a reranker's order; five hits of each language."""
    return shown(R.search(asked(spark, d, [0, 7, 11]), index(spark, d), rerank=lambda p: p.withColumn("rerank", F.col("text_rank").cast("double")), top_k=5))


@query(f"WITH {INDEX}, {LISTS.format(q=Q3)} SELECT query, lang, level, paragraph, round(score, 6) AS score, sentence FROM (SELECT query, lang, level, paragraph, score, sentence FROM s1 WHERE r <= 30 UNION ALL SELECT query, lang, level, paragraph, score, NULL FROM s2 WHERE r <= 20 UNION ALL SELECT query, lang, level, paragraph, score, NULL FROM s3 JOIN head USING (chapter) WHERE r <= 10) WHERE lang = 'en'")
def vector_lists(spark, d):
    """Path A of one language: sentences with their paragraphs, paragraphs, and chapters by their first two paragraphs."""
    return R.vector_lists(asked(spark, d, [0, 7]), index(spark, d), R.Search(), ["en"]).withColumn("score", F.round("score", 6))


@query(f"WITH {INDEX}, {LISTS.format(q=Q3)} SELECT query, lang, paragraph, concept, round(score, 6) AS score FROM s4")
def concept_lists(spark, d):
    return R.concept_lists(asked(spark, d, [0, 7]), index(spark, d), R.Search(), ["en", "bn"]).select("query", "lang", "paragraph", "concept", F.round("score", 6).alias("score"))


@query(f"WITH {INDEX}, q AS (SELECT id AS q, v FROM v WHERE id = 0), s AS (SELECT paragraph, sentence, list_inner_product(sent.v, q.v) AS score FROM sent, q) SELECT paragraph, arg_max(sentence, (score, -sentence)) AS sentence, round(max(score), 6) AS score FROM s GROUP BY paragraph")
def best_sentence(spark, d):
    i = index(spark, d)
    return V.best_sentence(i.sentences, list(asked(spark, d, [0, 0]).first()["vec"])).withColumn("score", F.round("score", 6))


PAIRS = "pairs AS (SELECT CAST(paragraph AS BIGINT) AS q, v, CASE WHEN lang = 'en' THEN 'bn' ELSE 'en' END AS target, lang || '2' || CASE WHEN lang = 'en' THEN 'bn' ELSE 'en' END AS direction, CASE WHEN lang = 'en' THEN chapter + 1 ELSE chapter - 1 END AS gold FROM para WHERE paragraph IN (SELECT paragraph FROM head))"
BY = {
    "dense_paragraph": "(0, 1, 0, 0)", "path_a": "(1, 1, 0.7, 0)", "path_b": "(0, 0, 0, 1.2)", "fused": "(1, 1, 0.7, 1.2)", "fused_rerank": "(1, 1, 0.7, 1.2)",
}
WEIGHTED = ", ".join(f"('{k}', {v[1:-1]})" for k, v in BY.items())


@query(f"""WITH {INDEX}, {PAIRS}, {LISTS.format(q="q AS (SELECT q, v FROM pairs)")},
w(config, ws, wp, wc, wb) AS (VALUES {WEIGHTED}),
ranked AS (SELECT query, lang, level, paragraph, row_number() OVER (PARTITION BY query, lang, level ORDER BY max(score) DESC, paragraph) AS r FROM cand GROUP BY query, lang, level, paragraph),
f AS (SELECT config, query, lang, paragraph, sum(x / (60 + r)) AS fused FROM (SELECT *, (CASE level WHEN 'sentence' THEN ws WHEN 'paragraph' THEN wp WHEN 'chapter' THEN wc ELSE wb END)::DOUBLE AS x FROM ranked, w) WHERE x > 0 GROUP BY ALL),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, query, lang ORDER BY fused DESC, paragraph) AS n FROM f) WHERE n <= 60),
h AS (SELECT config, query, lang, paragraph, row_number() OVER (PARTITION BY config, query, lang ORDER BY CASE WHEN config = 'fused_rerank' THEN (paragraph * 37) % 101 ELSE fused END DESC, fused DESC, paragraph) AS r FROM p UNION ALL SELECT 'nearest', query, lang, paragraph, r FROM s2),
g AS (SELECT c.config, pairs.direction, pairs.q, (SELECT min(r) FROM h JOIN para USING (paragraph) WHERE h.config = c.config AND h.query = pairs.q AND h.lang = pairs.target AND r <= 10 AND para.chapter = pairs.gold) AS r FROM pairs, (SELECT config FROM w UNION ALL SELECT 'nearest') c)
SELECT config, direction, count(*) AS n, round(avg((r IS NOT NULL)::INT), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM g GROUP BY ALL""")
def known_item_evaluation(spark, d):
    """The first paragraphs of each chapter as questions for the chapter of the other language; one more list beside the five configurations."""
    i = index(spark, d)
    first = i.members.withColumn("n", F.row_number().over(R.Window.partitionBy("chapter").orderBy("paragraph_idx"))).where("n <= 2")
    own = first.join(i.paragraphs, "paragraph")
    other = F.when(F.col("lang") == "en", "bn").otherwise("en")
    gold = F.when(F.col("lang") == "en", F.col("chapter") + 1).otherwise(F.col("chapter") - 1)
    pairs = own.select(F.col("paragraph").alias("query"), F.concat("lang", F.lit("2"), other).alias("direction"), other.alias("target"), F.lit("text").alias("text"), "vec", gold.alias("gold"))
    near = R.reduce(R.DataFrame.unionByName, [V.nearest_to(i.paragraphs.where(F.col("lang") == x), pairs.select("query", "vec"), 10, "paragraph").select("query", F.lit(x).alias("target"), "rank", F.col("id").alias("paragraph")) for x in ("en", "bn")])
    out = R.known_items(pairs, i, {"nearest": near}, rerank=lambda p: p.withColumn("rerank", F.col("text_rank").cast("double")))
    return out.select("config", "direction", "n", F.round("recall_10", 6).alias("recall_10"), F.round("mrr", 6).alias("mrr"))
