"""The engine's operators applied to the driver's tables, each with its SQL where SQL can say the same.

The mapping of the tables is in base.py.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsonx, stats
from ..functions import text as T
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import qa as Q
from ..operators import retrieve as R
from ..operators import study as S
from ..operators import vectors as V
from ..operators import warm as W
from ..sources import html, store
from ..streaming import events as E
from . import build as B
from .base import PC, edges, first_vector, query, raw_edges, scratch, t, vectors


# counts


@query("SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events")
def corpus_counts(spark, d):
    out = [t(spark, d, n).agg(F.lit(n).alias("t"), F.count("*").alias("n")) for n in ("orders", "lineitem", "documents", "embeddings", "events")]
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])


@query("SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def lang_counts(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("SELECT round((SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE / greatest((SELECT count(*) FROM orders), 1), 6) AS coverage")
def coverage_ratio(spark, d):
    have = t(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("n"))
    return have.crossJoin(t(spark, d, "orders").agg(F.count("*").alias("m"))).select(F.round(F.col("n") / F.greatest("m", F.lit(1)), 6).alias("coverage"))


@query(f"SELECT s_suppkey AS concept, count(paragraph) AS n_mentions FROM supplier LEFT JOIN ({PC}) ON s_suppkey = concept GROUP BY s_suppkey")
def mention_recount(spark, d):
    return G.mention_recount(t(spark, d, "supplier").select(F.col("s_suppkey").alias("concept")), edges(spark, d), "concept")


@query(f"SELECT concept, s_name AS label, n_mentions FROM (SELECT concept, count(*) AS n_mentions FROM ({PC}) GROUP BY concept) JOIN supplier ON s_suppkey = concept ORDER BY n_mentions DESC, concept LIMIT 20")
def top_concepts(spark, d):
    top = edges(spark, d).groupBy("concept").agg(F.count("*").alias("n_mentions")).orderBy(F.desc("n_mentions"), "concept").limit(20)
    return top.join(t(spark, d, "supplier"), F.col("concept") == F.col("s_suppkey")).select("concept", F.col("s_name").alias("label"), "n_mentions")


# hierarchy

DIM = "SELECT o_orderkey, c_name AS chapter, n_name AS volume, r_name AS book, n_nationkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


def dim(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("chapter_id"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("chapter_id"), F.col("c_name").alias("chapter"), F.col("c_nationkey").alias("volume_id"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("volume_id"), F.col("n_name").alias("volume"), F.col("n_regionkey").alias("book_id"))
    return H.paragraphs_dim(o, c, n, t(spark, d, "region").select(F.col("r_regionkey").alias("book_id"), F.col("r_name").alias("book")))


@query(f"SELECT book, volume, count(*) AS paragraphs, count(DISTINCT c_custkey) AS chapters FROM ({DIM}) GROUP BY book, volume")
def hierarchy_dim(spark, d):
    return dim(spark, d).groupBy("book", "volume").agg(F.count("*").alias("paragraphs"), F.count_distinct("chapter_id").alias("chapters"))


@query(f"SELECT o_orderkey AS paragraph_id, chapter, volume, book FROM ({DIM})")
def paragraph_metadata(spark, d):
    return dim(spark, d).select(F.col("o_orderkey").alias("paragraph_id"), "chapter", "volume", "book")


@query(f"SELECT o_orderkey, volume || ' › ' || chapter || ' › ¶' || (o_orderkey + 1) AS location FROM ({DIM})")
def location_string(spark, d):
    return dim(spark, d).select("o_orderkey", T.location(F.col("volume"), F.lit(""), F.col("chapter"), F.col("o_orderkey")).alias("location"))


LINES = r"""SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS paragraph_idx, text FROM (
  SELECT doc_id, lang, source, line, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))
  WHERE length(text) >= 20 AND text NOT IN ('←', '→', '↑', '↓')"""


@query(LINES)
def paragraph_split(spark, d):
    return H.paragraphs(t(spark, d, "documents"))


SENTENCES = rf"SELECT doc_id, paragraph_idx, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z\"''(])', '\1␞\2', 'g'), '␞'), lambda x: trim(x)), lambda x: length(x) > 0)) AS sentence FROM ({LINES})"


def sentence_rows(spark, d):
    p = H.paragraphs(t(spark, d, "documents"))
    return p.select("doc_id", "paragraph_idx", F.explode(T.sentences(F.col("text"), F.col("lang"))).alias("sentence"))


@query(f"SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS chars FROM ({SENTENCES}) GROUP BY doc_id")
def sentence_split(spark, d):
    return sentence_rows(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query(rf"SELECT doc_id, count(*) AS kept FROM ({SENTENCES}) WHERE len(string_split_regex(trim(sentence), '\s+')) >= 3 OR length(sentence) >= 25 GROUP BY doc_id")
def sentence_keep(spark, d):
    return sentence_rows(spark, d).where(T.sentence_kept(F.col("sentence"))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS text_norm FROM documents")
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text_norm"))


@query(r"SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS cleaned FROM pages")
def clean_ws(spark, d):
    return t(spark, d, "pages").select("page_id", T.clean_ws(F.col("html")).alias("cleaned"))


LABEL = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^[\-.,;:!?\"''`]+|[\-.,;:!?\"''`]+$', '', 'g')"


@query(f"SELECT p_partkey, CASE WHEN length(x) BETWEEN 2 AND 60 THEN x ELSE '' END AS label FROM (SELECT p_partkey, {LABEL.format("p_name || ' _' || p_type || '!'")} AS x FROM part)")
def label_normalize(spark, d):
    return t(spark, d, "part").select("p_partkey", T.concept_label(F.concat("p_name", F.lit(" _"), "p_type", F.lit("!"))).alias("label"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0980}-\\x{09FF}]') THEN 'bn' ELSE 'en' END AS detected FROM documents")
def lang_detect(spark, d):
    return t(spark, d, "documents").select("doc_id", T.detect_lang(F.col("text")).alias("detected"))


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark) GROUP BY token")
def tokenize(spark, d):
    return t(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def forward_fill_section(spark, d):
    return H.forward_filled(t(spark, d, "events"), F.when(F.col("event_type") == "signup", F.col("event_id")), ["user_id"], ["ts", "event_id"], "section").select("event_id", "section")


@query("SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)")
def chapter_sessions(spark, d):
    return H.sessions(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], "run").select("event_id", "run")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders")
def chapter_ordinal(spark, d):
    return t(spark, d, "orders").select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).alias("ordinal"))


@query("SELECT e.event_id, m.event_id AS volume FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) m ON e.user_id = m.user_id AND e.ts >= m.ts")
def volume_asof(spark, d):
    e = t(spark, d, "events")
    marks = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("start")).agg(F.max("event_id").alias("volume"))
    return H.asof(e.select("user_id", "ts", "event_id"), marks, "ts", "start", ["user_id"], ["volume"]).select("event_id", "volume")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def first_n_per_chapter(spark, d):
    return H.first_n(t(spark, d, "orders"), ["o_custkey"], "o_orderkey", 2).select("o_custkey", "o_orderkey", "rank")


@query(f"SELECT source, lang, sha256('Title ' || source || chr(10) || chr(10) || substr(string_agg(text, ' ' ORDER BY doc_id * 1000000 + paragraph_idx), 1, 16384)) AS digest FROM ({LINES}) GROUP BY source, lang")
def chapter_concat(spark, d):
    p = H.paragraphs(t(spark, d, "documents")).withColumn("paragraph_idx", F.col("doc_id") * 1_000_000 + F.col("paragraph_idx"))
    return H.chapter_text(p, ["source", "lang"], F.concat(F.lit("Title "), "source")).select("source", "lang", F.sha2("text", 256).alias("digest"))


# graph

PAIRS = f"SELECT x.concept AS a, y.concept AS b, count(DISTINCT x.paragraph) AS n FROM ({PC}) x JOIN ({PC}) y ON x.paragraph = y.paragraph AND x.concept < y.concept GROUP BY ALL"


@query(f"WITH p AS ({PAIRS}), w AS (SELECT a, b, n, round(ln(1 + n) / (SELECT max(ln(1 + n)) FROM p), 6) AS weight FROM p) SELECT a AS src, b AS dst, n, weight FROM w WHERE n >= 2 UNION ALL SELECT b, a, n, weight FROM w WHERE n >= 2")
def pair_cooccurrence(spark, d):
    return G.cooccurrence_edges(edges(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"SELECT concept, max(n) AS shared FROM (SELECT b.concept, a.concept AS chosen, count(DISTINCT a.paragraph) AS n FROM ({PC}) a JOIN ({PC}) b USING (paragraph) WHERE a.concept IN (1, 2, 3) AND b.concept NOT IN (1, 2, 3) GROUP BY ALL) GROUP BY concept HAVING max(n) >= 3")
def cooccurring_concepts(spark, d):
    return G.cooccurring(edges(spark, d), [1, 2, 3], 3)


COVER = f"SELECT paragraph, count(DISTINCT concept) AS n_concepts, round(sum(weight), 6) AS total FROM ({PC}) WHERE concept IN ({{}}) GROUP BY paragraph"


@query(f"{COVER.format('1, 2, 3, 4')} ORDER BY n_concepts DESC, total DESC, paragraph LIMIT 25")
def example_paragraphs(spark, d):
    return G.coverage(edges(spark, d), [1, 2, 3, 4], 25).select("paragraph", "n_concepts", F.round("total", 6).alias("total"))


@query(f"{COVER.format('5, 6')} HAVING count(DISTINCT concept) = 2 ORDER BY total DESC, paragraph LIMIT 25")
def example_paragraphs_all(spark, d):
    return G.coverage(edges(spark, d), [5, 6], 25, require_all=True).select("paragraph", "n_concepts", F.round("total", 6).alias("total"))


CO = f"SELECT a AS src, b AS dst, 'co-occurs' AS relation, n::DOUBLE AS weight FROM ({PAIRS}) WHERE n >= 2 UNION ALL SELECT b, a, 'co-occurs', n FROM ({PAIRS}) WHERE n >= 2"


def concept_edges(spark, d):
    e = G.cooccurrence_edges(edges(spark, d))
    return e.select("src", "dst", F.lit("co-occurs").alias("relation"), F.col("n").cast("double").alias("weight"))


@query(f"SELECT src, dst, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM ({CO})) WHERE rank <= 5")
def concept_neighbors(spark, d):
    e = concept_edges(spark, d)
    return G.neighbors(e, e, 5).select("src", "dst", "weight", "rank")


@query(f"SELECT concept, paragraph, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY weight DESC, paragraph) AS rank FROM (SELECT paragraph, concept, max(weight) AS weight FROM ({PC}) GROUP BY ALL)) WHERE rank <= 5")
def paragraphs_for_concepts(spark, d):
    pc = G.upsert_max(edges(spark, d), ["paragraph", "concept"])
    return G.paragraphs_for(pc, pc, 5).select("concept", "paragraph", F.round("weight", 6).alias("weight"), "rank")


@query(f"WITH top AS (SELECT concept FROM (SELECT concept, count(*) AS n FROM ({PC}) GROUP BY concept) ORDER BY n DESC, concept LIMIT 40), e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, relation, max(weight) AS weight FROM ({CO}) WHERE src <> dst AND src IN (FROM top) AND dst IN (FROM top) GROUP BY ALL) SELECT a, b, relation, CASE WHEN max(weight) OVER () > min(weight) OVER () THEN round((weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()), 4) ELSE 1.0 END AS weight FROM e")
def concept_subgraph(spark, d):
    top = edges(spark, d).groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(40).select(F.col("concept").alias("id"))
    return G.minmax_per_relation(G.undirected(G.induced(concept_edges(spark, d), top)))


@query(f"SELECT paragraph, concept, relation, CASE WHEN max(weight) OVER w > min(weight) OVER w THEN round((weight - min(weight) OVER w) / (max(weight) OVER w - min(weight) OVER w), 4) ELSE 1.0 END AS weight FROM ({PC}) WINDOW w AS (PARTITION BY relation)")
def edge_minmax(spark, d):
    return G.minmax_per_relation(edges(spark, d))


@query(f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, relation, max(weight) AS weight FROM ({CO}) GROUP BY ALL")
def undirected_dedupe(spark, d):
    return G.undirected(concept_edges(spark, d))


@query(f"SELECT paragraph, concept, relation, round(weight, 6) AS weight FROM ({PC})")
def upsert_max(spark, d):
    return edges(spark, d).withColumn("weight", F.round("weight", 6))


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL")
def insert_ignore(spark, d):
    return G.insert_ignore(t(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], F.col("l_linenumber")).select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("first_line"))


@query(f"SELECT paragraph, CASE WHEN concept % 10 = 3 THEN concept - 3 ELSE concept END AS concept, relation, round(max(weight), 6) AS weight FROM ({PC}) GROUP BY ALL")
def remap_edges(spark, d):
    mapping = t(spark, d, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("member"), (F.col("s_suppkey") - 3).alias("survivor"))
    return G.remapped(edges(spark, d), mapping, "concept", ["paragraph", "concept", "relation"]).withColumn("weight", F.round("weight", 6))


@query("SELECT o_orderkey AS paragraph FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def todo_anti(spark, d):
    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("paragraph"), F.when(F.col("o_orderstatus") == "F", "done").alias("summary"))
    return W.todo(p, edges(spark, d)).select("paragraph")


@query("WITH k AS (SELECT doc_id, lang, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS n FROM documents), s AS (SELECT n, lang, max(doc_id) AS old FROM k WHERE doc_id % 2 = 0 AND n <> '' GROUP BY ALL), h AS (SELECT k.doc_id, old FROM k JOIN s USING (n, lang) WHERE doc_id % 2 = 1) SELECT (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM k WHERE doc_id % 2 = 1) - (SELECT count(*) FROM h) AS misses, (SELECT count(*) FROM (SELECT DISTINCT doc_id, l_suppkey, l_returnflag FROM h JOIN lineitem ON l_orderkey = old)) AS edges, (SELECT count(*) FROM (SELECT DISTINCT doc_id, l_partkey FROM h JOIN lineitem ON l_orderkey = old)) AS entities")
def warm_restore(spark, d):
    """Documents with odd ids are restored from the snapshot of those with even ids, by text; lineitem gives their concepts and entities."""
    p = store.written(t(spark, d, "documents").select(F.col("doc_id").alias("paragraph"), T.normalize_text(F.col("text")).alias("text_norm"), "lang", F.lit("s").alias("summary")), "keyed")
    names = t(spark, d, "supplier").select(F.col("s_suppkey").alias("concept"), F.col("s_name").alias("label"))
    pe = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("paragraph"), F.col("l_partkey").alias("entity")).distinct()
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.concat_ws("/", "p_partkey", "p_name").alias("label"), F.col("p_type").alias("type"))
    snap = W.snapshot(p.where("paragraph % 2 = 0"), edges(spark, d), "stub@v1", names, pe, parts)
    hit, miss = W.restored(p.where("paragraph % 2 = 1"), store.written(snap, "snapshot"), "stub@v1")
    hit = store.written(hit, "hits")
    n = lambda x, name: x.agg(F.count("*").alias(name))
    return n(hit, "hits").crossJoin(n(miss, "misses")).crossJoin(n(W.restored_edges(hit), "edges")).crossJoin(n(W.restored_entities(hit), "entities"))


@query(f"WITH n AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier), e AS ({CO}), m AS (SELECT src, avg(x) AS near FROM e JOIN n ON dst = id GROUP BY src) SELECT id, 0 AS d, round((x + coalesce(near, x)) / 2, 6) AS x FROM n LEFT JOIN m ON src = id")
def neighbor_smoothing(spark, d):
    f = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0).alias("d"), F.col("s_acctbal").alias("x"))
    return G.smoothed(f, concept_edges(spark, d)).withColumn("x", F.round("x", 6))


def small_graph(spark, d):
    top = edges(spark, d).groupBy("concept").agg(F.count("*").alias("n_mentions")).orderBy(F.desc("n_mentions"), "concept").limit(250)
    nodes = top.join(t(spark, d, "supplier"), F.col("concept") == F.col("s_suppkey")).select(F.col("concept").alias("id"), F.col("s_name").alias("label"), "n_mentions")
    return nodes, concept_edges(spark, d)


@query()
def graph_communities(spark, d):
    return G.communities(*small_graph(spark, d))


@query()
def graph_layout(spark, d):
    return G.layout(*small_graph(spark, d))


@query()
def graph_spec(spark, d):
    nodes, e = small_graph(spark, d)
    return G.graph_spec(nodes, G.undirected(G.induced(e, nodes)), G.communities(nodes, e), G.layout(nodes, e))


# vectors

X = "SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings"
SIM = f"SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM ({X}) a JOIN ({X}) b ON a.id < b.id"
BOTH = f"SELECT a AS src, b AS dst, sim FROM ({SIM}) UNION ALL SELECT b, a, sim FROM ({SIM})"


@query(f"SELECT id, round(list_inner_product(v, (SELECT v FROM ({X}) WHERE id = 0)), 6) AS score FROM ({X}) ORDER BY score DESC, id LIMIT 30")
def vector_topk(spark, d):
    return V.top_k(vectors(spark, d), first_vector(spark, d), 30).withColumn("score", F.round("score", 6))


@query(f"SELECT src, dst, round(sim, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM ({BOTH}) WHERE sim >= 0.30) WHERE rank <= 13")
def similarity_edges(spark, d):
    return V.similarity_edges(V.similar_pairs(vectors(spark, d), 0.30)).select("src", "dst", F.round("sim", 6).alias("weight"), "rank")


@query(f"WITH s AS (SELECT src AS x, dst AS y, sim FROM ({BOTH}) WHERE src % 2 = 0 AND dst % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS rx, row_number() OVER (PARTITION BY y ORDER BY sim DESC, x) AS ry FROM s) SELECT x, y, round(sim, 6) AS sim FROM r WHERE rx = 1 AND ry = 1 AND sim >= 0.30")
def mutual_best(spark, d):
    sims = V.both_ways(V.similar_pairs(vectors(spark, d), 0.30)).where("src % 2 = 0 AND dst % 2 = 1").select(F.col("src").alias("x"), F.col("dst").alias("y"), "sim")
    return V.mutual_best(sims, 0.30).withColumn("sim", F.round("sim", 6))


@query(f"WITH e AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM ({X})), m AS (SELECT label, d, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT label, list(x ORDER BY d) AS c FROM m GROUP BY label), s AS (SELECT id, CAST(c.label AS VARCHAR) AS class, list_cosine_similarity(v, c) AS sim FROM ({X}) CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, class DESC) AS n FROM s) SELECT id, CASE WHEN sim >= 0.30 THEN class ELSE 'other' END AS class, round(sim, 6) AS sim FROM r WHERE n = 1")
def centroid_class(spark, d):
    v = vectors(spark, d)
    return V.nearest_centroid(v, V.centroids(v, "label"), "label").withColumn("sim", F.round("sim", 6))


@query()
def merge_survivors(spark, d):
    concepts = vectors(spark, d).select("id", F.concat(F.lit("vector-"), F.col("id").cast("string")).alias("label"), F.lit(1).alias("n_mentions"))
    return V.survivors(V.duplicate_groups(vectors(spark, d), 0.40), concepts)


# retrieval

PATH_A = f"""WITH q AS (SELECT v AS q FROM ({X}) WHERE id = 0), s AS (SELECT id, label, list_inner_product(v, q) AS s FROM ({X}), q),
fine AS (SELECT 'sentence' AS level, id AS paragraph, s AS score FROM (SELECT * FROM s ORDER BY s DESC, id LIMIT 30)),
top AS (SELECT label, avg(s) AS m FROM s GROUP BY label ORDER BY m DESC, label LIMIT 3),
coarse AS (SELECT 'chapter' AS level, id AS paragraph, m AS score FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM s) JOIN top USING (label) WHERE n <= 2)"""
PATH_B = f"""anchor AS (SELECT id AS concept, s AS score FROM s ORDER BY s DESC, id LIMIT 12),
edge AS (SELECT src, dst, sim FROM ({BOTH}) WHERE sim >= 0.30),
near AS (SELECT dst AS concept, 0.85 * score * sim AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS n FROM edge JOIN anchor ON src = concept WHERE sim >= 0.4) WHERE n = 1),
c AS (SELECT concept, max(score) AS score FROM (SELECT concept, score FROM anchor UNION ALL SELECT * FROM near) GROUP BY concept HAVING max(score) > 0)"""
RRF = """lists AS (FROM fine UNION ALL FROM coarse UNION ALL SELECT 'concept', concept, score FROM c),
ranked AS (SELECT level, paragraph, row_number() OVER (PARTITION BY level ORDER BY max(score) DESC, paragraph) AS r FROM lists GROUP BY level, paragraph),
fused AS (SELECT paragraph, sum(CASE level WHEN 'sentence' THEN 1.0 WHEN 'chapter' THEN 0.7 ELSE 1.2 END::DOUBLE / (60 + r)) AS fused, string_agg(level, ',' ORDER BY level) AS levels FROM ranked GROUP BY paragraph)"""
DEFAULTS = R.Search()


def path_a_hits(spark, d):
    v, q = vectors(spark, d), first_vector(spark, d)
    s = v.select("id", "label", V.dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in q])).alias("s"))
    fine = s.orderBy(F.desc("s"), "id").limit(DEFAULTS.k_sentence).select(F.lit("sentence").alias("level"), F.col("id").alias("paragraph"), F.col("s").alias("score"))
    top = s.groupBy("label").agg(F.avg("s").alias("score")).orderBy(F.desc("score"), "label").limit(3)
    coarse = H.first_n(v.select("id", "label"), ["label"], "id", 2).join(top, "label").select(F.lit("chapter").alias("level"), F.col("id").alias("paragraph"), "score")
    return fine.unionByName(coarse)


def path_b_hits(spark, d):
    v = vectors(spark, d)
    anchors = V.top_k(v, first_vector(spark, d), DEFAULTS.k_concepts).select(F.col("id").alias("concept"), "score")
    # a search reads built edges; here those of the anchors alone are worked out, which is all it needs of them
    # edges are cosines, and stored vectors have a length of one only as far as floats go
    u = v.select("id", V.l2_normalised(F.col("vec")).alias("vec"))
    asked = u.join(F.broadcast(anchors), F.col("id") == F.col("concept")).select(F.col("concept").alias("query"), "vec")  # k_concepts rows
    e = V.nearest_to(u, asked, DEFAULTS.hops + 1).where((F.col("id") != F.col("query")) & (F.col("score") >= 0.30)).select(F.col("query").alias("src"), F.col("id").alias("dst"), F.col("score").alias("weight"))
    pc = v.select(F.col("id").alias("paragraph"), F.col("id").alias("concept"), F.lit(1.0).alias("weight"))
    return R.concept_paragraphs(anchors, e, pc, DEFAULTS)


def fused(spark, d):
    b = path_b_hits(spark, d).select(F.lit("concept").alias("level"), "paragraph", "score")
    weights = {"sentence": DEFAULTS.w_sentence, "chapter": DEFAULTS.w_chapter, "concept": DEFAULTS.w_concept}
    return R.rrf(path_a_hits(spark, d).unionByName(b), weights, [])


@query(f"{PATH_A} SELECT level, paragraph, round(score, 6) AS score FROM (FROM fine UNION ALL FROM coarse)")
def path_a(spark, d):
    return path_a_hits(spark, d).withColumn("score", F.round("score", 6))


@query(f"{PATH_A}, {PATH_B} SELECT concept AS paragraph, round(score, 6) AS score FROM c")
def path_b(spark, d):
    return path_b_hits(spark, d).select("paragraph", F.round("score", 6).alias("score"))


@query(f"{PATH_A}, {PATH_B}, {RRF} SELECT paragraph, round(fused, 6) AS fused, levels FROM fused")
def rrf_fusion(spark, d):
    return fused(spark, d).select("paragraph", F.round("fused", 6).alias("fused"), F.array_join("levels", ",").alias("levels"))


@query(f"{PATH_A}, {PATH_B}, {RRF} SELECT paragraph, label, round(fused, 6) AS fused, row_number() OVER (ORDER BY fused DESC, paragraph) AS rank FROM fused JOIN ({X}) ON id = paragraph ORDER BY rank LIMIT 8")
def fused_search(spark, d):
    meta = vectors(spark, d).select(F.col("id").alias("paragraph"), "label")
    return R.top_hits(fused(spark, d), meta, DEFAULTS).select("paragraph", "label", F.round("fused", 6).alias("fused"), "rank")


NEAREST = f"SELECT a.id AS q, b.id AS id, a.label AS ql, b.label AS label, s, row_number() OVER (PARTITION BY a.id ORDER BY s DESC, b.id) AS rank FROM ({X}) a JOIN ({X}) b ON a.id <> b.id AND a.id % 50 = 0, LATERAL (SELECT list_inner_product(a.v, b.v) AS s)"


def nearest_rows(spark, d):
    """The ten nearest other rows of each row whose id is divisible by 50."""
    v = vectors(spark, d)
    found = V.nearest_to(v, v.where("id % 50 = 0").select(F.col("id").alias("query"), "vec"), 11).where("query <> id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where("rank <= 10")
    labels = v.select("id", "label")
    named = found.join(labels, "id").join(labels.select(F.col("id").alias("query"), F.col("label").alias("ql")), "query")
    return named.select(F.col("query").alias("q"), "ql", "id", "label", F.col("score").alias("s"), "rank")


@query(f"WITH r AS (SELECT q // 500 AS question, CAST(label AS VARCHAR) AS lang, id, s, q, ql FROM ({NEAREST}) WHERE rank <= 10), f AS (SELECT question, lang, id, ql, min(q) AS first FROM r GROUP BY ALL), w AS (SELECT question, lang, id, string_agg(ql, ',' ORDER BY first) AS via FROM (SELECT *, row_number() OVER (PARTITION BY question, lang, id ORDER BY first) AS n FROM f) WHERE n <= 3 GROUP BY ALL), b AS (SELECT question, lang, id, max(s) AS score FROM r GROUP BY ALL) SELECT question, lang, id AS paragraph, round(score, 6) AS score, via, rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, lang, id) AS rank FROM b JOIN w USING (question, lang, id)) WHERE rank <= 10")
def multi_query_pool(spark, d):
    """Ten queries are one question; the pool of their hits, the concepts of earlier queries first."""
    hits = nearest_rows(spark, d).select(F.expr("q div 500").alias("question"), F.col("q").alias("query_id"), F.col("label").cast("string").alias("lang"), F.col("id").alias("paragraph"), F.col("s").alias("score"), F.array("ql").alias("via"))
    return R.sources(hits).select("question", "lang", "paragraph", F.round("score", 6).alias("score"), F.array_join(F.col("via").cast("array<string>"), ",").alias("via"), "rank")


@query(f"WITH r AS (SELECT q, min(rank) FILTER (rank <= 10 AND label = ql) AS rank FROM ({NEAREST}) GROUP BY q) SELECT count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(rank, 99) <= 10)::INT), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM r")
def recall_mrr(spark, d):
    ranks = nearest_rows(spark, d).groupBy("q").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("rank"))
    return R.recall_mrr(ranks).select("n", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr")])


TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"WITH t AS (SELECT doc_id, {TOK} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL), tf AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT item_id, doc_id, sum(qf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score FROM qt JOIN df USING (term) JOIN tf USING (term), st GROUP BY ALL) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5")
def bm25_topk(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    hits = R.bm25(docs, t(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"), 5)
    return hits.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH a AS (SELECT id AS entity, list_inner_product(v, (SELECT v FROM ({X}) WHERE id = 0)) AS sim FROM ({X}) ORDER BY sim DESC, id LIMIT 12) SELECT paragraph, round(sum(sim), 6) AS score FROM (SELECT DISTINCT l_orderkey AS paragraph, l_partkey AS entity FROM lineitem) JOIN a USING (entity) GROUP BY paragraph ORDER BY round(sum(sim), 9) DESC, paragraph LIMIT 10")
def entity_graph_topk(spark, d):
    anchors = V.top_k(vectors(spark, d), first_vector(spark, d), 12).select(F.col("id").alias("entity"), F.col("score").alias("sim"))
    return R.entity_paragraphs(anchors, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("paragraph"), F.col("l_partkey").alias("entity")), 10).withColumn("score", F.round("score", 6))


# extraction and JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair(spark, d):
    noisy = F.concat(F.lit("Here it is: "), F.regexp_replace("props", r"\}$", ",}"), F.lit(" done"))
    return t(spark, d, "events").select("event_id", F.get_json_object(jsonx.repaired(jsonx.json_block(noisy)), "$.k").cast("long").alias("k"))


@query("SELECT l_orderkey AS paragraph, s_name AS label, round(1 - l_discount, 6) AS weight FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def json_explode(spark, d):
    li = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    raw = F.to_json(F.struct(F.array(F.struct(F.col("s_name").alias("label"), (1 - F.col("l_discount")).alias("weight"))).alias("concepts")))
    c = F.explode(F.from_json(raw, "concepts array<struct<label:string,weight:double>>")["concepts"]).alias("c")
    return li.select(F.col("l_orderkey").alias("paragraph"), c).select("paragraph", "c.label", F.round("c.weight", 6).alias("weight"))


CUES = [(["tion", "ment"], "noun"), (["ing", "ed "], "verb"), (["eau"], "french"), (["sch"], "german")]


@query(
    "SELECT doc_id, label, CASE WHEN hits > 1 THEN 0.9 ELSE 0.6 END::DOUBLE AS weight FROM (SELECT doc_id, lower(right(text, 1200)) AS x FROM documents), LATERAL (VALUES "
    + ", ".join("('%s', %s)" % (label, " + ".join(f"contains(x, '{c}')::INT" for c in cues)) for cues, label in CUES)
    + ") v(label, hits) WHERE hits > 0"
)
def stub_extract(spark, d):
    c = F.explode(jsonx.stub_extraction(F.col("text"), CUES)).alias("c")
    return t(spark, d, "documents").select("doc_id", c).select("doc_id", "c.label", "c.weight")


# question answering


@query(r"WITH a AS (SELECT conv_id, turn, list_transform(regexp_extract_all(x, '\[(\d+)\]', 1), lambda v: v::INT) AS c FROM (SELECT conv_id, turn, text || ' [' || (turn + 1) || '][9]' AS x FROM conversations)) SELECT conv_id, turn, len(list_filter(c, lambda v: v BETWEEN 1 AND 3))::INT AS valid, len(list_filter(c, lambda v: NOT v BETWEEN 1 AND 3))::INT AS invalid FROM a")
def citation_validate(spark, d):
    c = T.citations(F.concat("text", F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("][9]")))
    ok = lambda x: x.between(1, 3)
    return t(spark, d, "conversations").select("conv_id", "turn", F.size(F.filter(c, ok)).alias("valid"), F.size(F.filter(c, lambda x: ~ok(x))).alias("invalid"))


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(text) + 2) OVER w::BIGINT AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE n = 1 OR used <= 600")
def budget_pack(spark, d):
    return Q.packed(t(spark, d, "conversations"), ["conv_id"], ["turn"], F.length("text"), F.lit(600)).select("conv_id", "turn", "used")


@query()
def passage_trim(spark, d):
    docs = t(spark, d, "documents").withColumn("matched", F.element_at(F.concat(T.sentences_en(F.col("text")), F.array(F.lit(""))), 1))
    return docs.select("doc_id", T.trim_passage(F.col("text"), F.col("matched"), F.lit(1200)).alias("passage"))


TEMPLATE = Q.Template(body="Q {question}{bridge}|{sources}|{language}|{opening}", bridge="[{note}]", related="({concepts})", openings=("A", "B"), languages=("E", "B"))


@query("""WITH h AS (SELECT conv_id AS q, turn + 1 AS rank, conv_id % 3 = 0 AS bridged, conv_id % 2 = 1 AS bn, '[' || (turn + 1) || '] (' || CASE WHEN role = 'user' THEN 'Bengali' ELSE 'English' END || ') ' || role || chr(10) || text AS block FROM conversations WHERE length(text) > 0),
p AS (SELECT *, 'Q ' || q || CASE WHEN bridged THEN '[new](x, y)' || chr(10) ELSE '' END || '|' AS before, '|' || CASE WHEN bn THEN 'B' ELSE 'E' END || '|' || CASE WHEN bridged THEN 'B' ELSE 'A' END AS after FROM h),
u AS (SELECT *, row_number() OVER w AS n, sum(length(block) + 2) OVER w AS used FROM p WINDOW w AS (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING))
SELECT CAST(q AS VARCHAR) AS question, before || string_agg(block, chr(10) || chr(10) ORDER BY rank) || after AS prompt, count(*) AS n_sources FROM u WHERE n = 1 OR used <= 900 - length(before) - length(after) GROUP BY q, before, after""")
def qa_prompt(spark, d):
    """Conversations as questions, their turns as sources, some with a bridge note."""
    c = t(spark, d, "conversations").where("length(text) > 0").withColumn("question", F.col("conv_id").cast("string"))
    hits = c.select("question", (F.col("turn") + 1).alias("rank"), F.when(F.col("role") == "user", "bn").otherwise("en").alias("lang"), F.col("role").alias("location"), "text", F.lit("").alias("matched"))
    plans = c.select("question", "conv_id").distinct().select("question", F.when(F.col("conv_id") % 3 == 0, "new").alias("bridge_note"), F.array(F.lit("x"), F.lit("y")).alias("concepts"), F.when(F.col("conv_id") % 2 == 1, "bn").otherwise("en").alias("lang"))
    return Q.prompts(hits, plans, TEMPLATE, max_context=1_000_000, max_prompt=900)


# evaluation

RATERS = "SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS pa, avg(toxic) AS pb, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS b, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS c FROM labels"


def raters(spark, d):
    one = lambda x: F.sum(F.when(x, 1).otherwise(0))
    q, x = F.col("quality"), F.col("toxic")
    return t(spark, d, "labels").agg(F.count("*").alias("n"), F.avg((q == x).cast("int")).alias("po"), F.avg(q).alias("pa"), F.avg(x).alias("pb"), one((q == 1) & (x == 1)).alias("a"), one((q == 1) & (x == 0)).alias("b"), one((q == 0) & (x == 1)).alias("c"), one((q == 0) & (x == 0)).alias("d"))


@query(f"SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, round((po - p2) / (1 - p2), 6) AS ac1 FROM (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe, (pa + pb) * (1 - (pa + pb) / 2) AS p2 FROM ({RATERS}))")
def kappa_ac1(spark, d):
    r = raters(spark, d)
    return r.select("n", F.round("po", 6).alias("agreement"), F.round(stats.kappa(F.col("po"), F.col("pa"), F.col("pb")), 6).alias("kappa"), F.round(stats.ac1(F.col("po"), F.col("pa"), F.col("pb")), 6).alias("ac1"))


@query("SELECT lang, k, n, round(greatest(0, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n)), 6) AS lo, round(least(1, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n)), 6) AS hi FROM (SELECT lang, sum(quality)::BIGINT AS k, count(*) AS n, avg(quality) AS p FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def wilson_ci(spark, d):
    g = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("WITH j AS (SELECT quality, toxic, lang, CASE WHEN n_chars >= 2000 THEN 'long' ELSE 'short' END AS band FROM labels JOIN documents USING (doc_id)) SELECT 'lang' AS kind, lang AS value, count(*) AS n, round(avg(quality), 6) AS a, round(avg(toxic), 6) AS b, round(avg(quality * toxic), 6) AS both_yes, round(avg(greatest(quality, toxic)), 6) AS either_yes FROM j GROUP BY lang UNION ALL SELECT 'band', band, count(*), round(avg(quality), 6), round(avg(toxic), 6), round(avg(quality * toxic), 6), round(avg(greatest(quality, toxic)), 6) FROM j GROUP BY band")
def precision_breakdown(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("band", F.when(F.col("n_chars") >= 2000, "long").otherwise("short"))
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    by = [j.groupBy(F.lit(k).alias("kind"), F.col(k).alias("value")).agg(F.count("*").alias("n"), r("quality", "a"), r("toxic", "b"), r(F.col("quality") * F.col("toxic"), "both_yes"), r(F.greatest("quality", "toxic"), "either_yes")) for k in ("lang", "band")]
    return by[0].unionByName(by[1])


@query("WITH j AS (SELECT s_acctbal AS x, s_nationkey AS y FROM supplier), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j) SELECT round(corr(rx::DOUBLE, ry::DOUBLE), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, d):
    return stats.spearman(t(spark, d, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y")), "x", "y").select(F.round("rho", 6).alias("rho"), "n")


CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


@query(f"SELECT b, c, round(least(1.0, coalesce(sum(exp(l)) FILTER (l <= own + 1e-9), 1)), 9) AS p FROM (SELECT b, c, {CHOOSE.format('m', 'i')} + m * ln(0.5) AS l, {CHOOSE.format('m', 'b')} + m * ln(0.5) AS own FROM (SELECT b, c, b + c AS m, unnest(range(0, b + c + 1)) AS i FROM ({RATERS}))) GROUP BY b, c")
def mcnemar_exact(spark, d):
    return raters(spark, d).select("b", "c", F.round(stats.mcnemar_exact("b", "c"), 9).alias("p"))


@query(f"SELECT round(least(1.0, sum(exp(l)) FILTER (l <= own + 1e-9)), 9) AS p FROM (SELECT {CHOOSE.format('r', 'x')} + {CHOOSE.format('(n - r)', '(k - x)')} - {CHOOSE.format('n', 'k')} AS l, {CHOOSE.format('r', 'a')} + {CHOOSE.format('(n - r)', '(k - a)')} - {CHOOSE.format('n', 'k')} AS own FROM (SELECT *, unnest(range(greatest(0, k - (n - r)), least(r, k) + 1)) AS x FROM (SELECT count(*) AS n, sum(quality)::BIGINT AS r, sum(toxic)::BIGINT AS k, sum(quality * toxic)::BIGINT AS a FROM labels)))")
def fisher_exact(spark, d):
    return raters(spark, d).select(F.round(stats.fisher_exact("a", "b", "c", "d"), 9).alias("p"))


@query()
def bootstrap_kappa(spark, d):
    r = raters(spark, d).first()
    lo, hi = stats.bootstrap_kappa({(1, 1): r["a"], (1, 0): r["b"], (0, 1): r["c"], (0, 0): r["d"]})
    return spark.createDataFrame([(lo, hi)], "lo double, hi double")


# events and pages


@query("SELECT user_id, event_type, count(DISTINCT date_trunc('hour', ts)) AS n FROM events GROUP BY ALL")
def event_dedupe(spark, d):
    e = t(spark, d, "events").withColumn("seq", F.date_trunc("hour", "ts"))
    return E.deduplicated(e, ["user_id", "event_type", "seq"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_microbatch(spark, d):
    root = scratch(spark, "stream")
    source = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    E.microbatches(source, lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


@query()
def html_blocks(spark, d):
    return html.blocks(t(spark, d, "pages"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS comments, md5(regexp_replace(regexp_replace(html, '(?i)<img\b[^>]*/?>', '', 'g'), '(?s)<!--.*?-->', '', 'g')) AS digest FROM pages")
def html_clean(spark, d):
    page, counts = html.cleaned(F.col("html"))
    return t(spark, d, "pages").select("page_id", counts["comments"].alias("comments"), F.md5(page).alias("digest"))


# concept look-ups, merges and lists


@query(f"WITH e AS (SELECT *, row_number() OVER (ORDER BY weight DESC, dst) AS rank FROM ({CO}) WHERE src = 1), p AS (SELECT o_orderstatus AS lang, paragraph, w, row_number() OVER (PARTITION BY o_orderstatus ORDER BY w DESC, paragraph) AS rank FROM (SELECT paragraph, max(weight) AS w FROM ({PC}) WHERE concept = 1 GROUP BY paragraph) JOIN orders ON o_orderkey = paragraph) SELECT 'neighbor' AS kind, dst AS id, NULL AS lang, round(weight, 6) AS weight, rank FROM e WHERE rank <= 12 UNION ALL SELECT 'paragraph', paragraph, lang, round(w, 6), rank FROM p WHERE rank <= 5")
def concept_neighborhood(spark, d):
    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("paragraph"), F.col("o_orderstatus").alias("lang"))
    near, best = S.neighborhood(concept_edges(spark, d), edges(spark, d), p, 1)
    near = near.select(F.lit("neighbor").alias("kind"), F.col("dst").alias("id"), F.lit(None).cast("string").alias("lang"), F.round("weight", 6).alias("weight"), "rank")
    return near.unionByName(best.select(F.lit("paragraph").alias("kind"), F.col("paragraph").alias("id"), "lang", F.round("weight", 6).alias("weight"), "rank"))


@query(f"SELECT id AS concept, 'row ' || id || ' of ' || label AS label, round(list_inner_product(v, (SELECT v FROM ({X}) WHERE id = 0)), 6) AS score FROM ({X}) ORDER BY score DESC, id LIMIT 15")
def search_concepts(spark, d):
    v = vectors(spark, d)
    names = v.select(F.col("id").alias("concept"), F.format_string("row %d of %d", "id", "label").alias("label"))
    return S.labelled(V.top_k(v, first_vector(spark, d), 15).select(F.col("id").alias("concept"), F.round("score", 6).alias("score")), names)


@query("SELECT p_partkey AS concept, p_name AS label FROM part WHERE contains(lower(p_name), 'an')")
def label_search(spark, d):
    return S.matching(t(spark, d, "part").select(F.col("p_partkey").alias("concept"), F.col("p_name").alias("label")), "AN")


ALIASES = "SELECT l_suppkey AS concept, l_returnflag AS lang, l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey AS VARCHAR) AS alias FROM lineitem"


def alias_rows(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("concept"), F.col("l_returnflag").alias("lang"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").cast("string").alias("alias"))


@query(f"SELECT concept, lang, string_agg(alias, ',' ORDER BY n) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY concept, lang ORDER BY id, alias) AS n FROM ({ALIASES})) WHERE n <= 3 GROUP BY concept, lang")
def concept_aliases(spark, d):
    return S.first_aliases(alias_rows(spark, d)).withColumn("aliases", F.array_join("aliases", ","))


INTO = "CASE WHEN {0} % 10 = 3 AND {0} + 1 IN (SELECT s_suppkey FROM supplier) THEN {0} + 1 ELSE {0} END"


@query(f"WITH a AS (SELECT {INTO.format('concept')} AS concept, lang, alias FROM ({ALIASES}) UNION SELECT s_suppkey + 1, 'en', s_name FROM supplier WHERE {INTO.format('s_suppkey')} <> s_suppkey), p AS (SELECT DISTINCT paragraph, {INTO.format('concept')} AS concept, relation FROM ({PC})), e AS (SELECT DISTINCT {INTO.format('src')} AS src, {INTO.format('dst')} AS dst FROM ({CO})) SELECT s_suppkey AS concept, s_name AS label, (SELECT count(*) FROM p WHERE p.concept = s_suppkey) AS n_mentions, (SELECT count(*) FROM a WHERE a.concept = s_suppkey) AS n_aliases, (SELECT count(*) FROM e WHERE src = s_suppkey AND dst <> src) AS n_edges FROM supplier WHERE {INTO.format('s_suppkey')} = s_suppkey")
def merge_concepts(spark, d):
    """Suppliers whose key ends in 3 go into the next one."""
    concepts = t(spark, d, "supplier").select(F.col("s_suppkey").alias("concept"), F.col("s_name").alias("label"))
    mapping = concepts.where("concept % 10 = 3").select(F.col("concept").alias("member"), (F.col("concept") + 1).alias("survivor"))
    mapping = mapping.join(concepts.select(F.col("concept").alias("survivor")), "survivor", "left_semi")
    kept, aliases, _, moved = S.merged(concepts, alias_rows(spark, d), edges(spark, d), concept_edges(spark, d), mapping)
    n = lambda x, key, out: x.groupBy(F.col(key).alias("concept")).agg(F.count("*").alias(out))
    out = kept.join(n(aliases, "concept", "n_aliases"), "concept", "left").join(n(moved, "src", "n_edges"), "concept", "left")
    return out.select("concept", "label", "n_mentions", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query("SELECT o_custkey AS chapter, string_agg(o_orderpriority, '||' ORDER BY o_orderkey) AS notes FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 <> 0 GROUP BY o_custkey HAVING count(*) >= 2")
def chapter_notes(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("chapter"), F.col("o_orderkey").alias("paragraph_idx"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("summary"))
    return S.chapter_notes(o, o.where("chapter % 7 = 0"))


@query("SELECT o_custkey AS chapter, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def chapter_members(spark, d):
    return S.members(t(spark, d, "orders").select(F.col("o_custkey").alias("chapter"), "o_orderkey"), "chapter", "o_orderkey").withColumn("items", F.array_join("items", ","))


@query()
def edge_sample(spark, d):
    """200 edges in the repeatable shuffled order."""
    e = edges(spark, d).withColumn("edge", F.concat_ws("/", "paragraph", "concept", "relation"))
    return S.sampled(e, "edge", 200).select("paragraph", "concept", "relation", "weight")


ANSWERS = "SELECT role, turn, CASE WHEN turn < 6 THEN coalesce(text, '') || ' [' || (turn + 1) || '][9]' END AS x FROM conversations"


@query(rf"WITH a AS (SELECT role, x, turn / 10.0::DOUBLE AS cross_share, list_transform(regexp_extract_all(x, '\[(\d+)\]', 1), lambda v: v::INT) AS c, greatest(len(list_filter(string_split_regex(x, '[.!?।]+'), lambda v: trim(v, ' ' || chr(10)) <> '')), 1) AS s FROM ({ANSWERS})) SELECT count(*) AS n, count(x) AS n_answered, round(avg((role <> 'assistant')::INT), 6) AS fallback_rate, round(avg(len(c)::DOUBLE / s) FILTER (x IS NOT NULL), 6) AS citations_per_sentence, coalesce(sum(len(c)) FILTER (x IS NOT NULL), 0)::BIGINT AS citations, round(sum(len(list_filter(c, lambda v: NOT v BETWEEN 1 AND 3))) FILTER (x IS NOT NULL)::DOUBLE / sum(len(c)) FILTER (x IS NOT NULL), 6) AS invalid_rate, round(avg(cross_share), 6) AS cross_share FROM a")
def qa_integrity(spark, d):
    x = F.when(F.col("turn") < 6, F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("][9]")))
    a = t(spark, d, "conversations").select(x.alias("answer"), F.lit(3).alias("n_sources"), (F.col("turn") / 10.0).alias("cross_share"), (F.col("role") == "assistant").alias("ok"))
    r = S.integrity(a)
    return r.select("n", "n_answered", "citations", *[F.round(c, 6).alias(c) for c in ("fallback_rate", "citations_per_sentence", "invalid_rate", "cross_share")])


# tables, sheets and the whole build


@query(f"SELECT label::VARCHAR AS lang, count(*) AS n, round(sum(list_sum(v)), 4) AS total FROM ({X}) WHERE label <> 3 GROUP BY label UNION ALL SELECT '3', count(*), round(2 * sum(list_sum(v)), 4) FROM ({X}) WHERE label = 3")
def vector_store(spark, d):
    """All vectors written by language, those of one language replaced by their doubles, all read back."""
    s = store.Store(spark, scratch(spark, "vectors"))
    v = vectors(spark, d).select(F.col("id").alias("node"), V.as_double(F.col("vec")).alias("vec"), F.lit("paragraph").alias("node_kind"), F.col("label").cast("string").alias("lang"))
    s.write_vectors(v)
    s.write_vectors(v.where("lang = '3'").withColumn("vec", F.transform("vec", lambda x: x * 2)))
    total = F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))
    return s.vectors("paragraph").groupBy("lang").agg(F.count("*").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT doc_id AS item_id, lang, md5(substr(text, 1, 1200)) AS digest FROM documents")
def annotation_sheet(spark, d):
    at = scratch(spark, "sheet")
    store.write_sheet(t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "lang", F.col("text").alias("paragraph_text")), at)
    return store.read_sheet(spark, at, "item_id long, lang string, paragraph_text string").select("item_id", "lang", F.md5("paragraph_text").alias("digest"))


@query("SELECT u AS user, count(*) AS n_judged, sum(j)::BIGINT AS n_yes, (SELECT CAST(min(doc_id) AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS next_item FROM (SELECT 'a' AS u, quality AS j FROM labels UNION ALL SELECT 'b', toxic FROM labels) GROUP BY u")
def judgment_progress(spark, d):
    at, x = scratch(spark, "judgments"), t(spark, d, "labels")
    item = F.col("doc_id").cast("string").alias("item")
    rows = x.select(F.lit("a").alias("user"), item, F.col("quality").alias("judgment")).unionByName(x.select(F.lit("b").alias("user"), item, F.col("toxic").alias("judgment")))
    store.write_judgments(rows, at)
    back = store.read_judgments(spark, at)
    yes = back.groupBy("user").agg(F.sum("judgment").alias("n_yes"))
    return store.progress(t(spark, d, "documents").select(F.col("doc_id").alias("item")), back).join(yes, "user")


@query()
def build_stats(spark, d):
    """The whole build over documents, with the stand-in models."""
    lines = H.paragraphs(t(spark, d, "documents")).select("lang", F.col("source").alias("volume"), F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("chapter"), F.col("doc_id").alias("chapter_key"), "paragraph_idx", "text")
    return B.build(store.Store(spark, scratch(spark, "build")), B.paragraph_rows(lines))
