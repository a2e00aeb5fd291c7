"""Look-ups and graph views: concepts, paragraphs with all their metadata, examples by language, the drawn graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import retrieve as R
from ..operators import study as S
from ..operators import vectors as V
from ..operators.study import metadata
from .base import PC, edges, query, t, vectors

CHAPTERS = "SELECT o_orderkey AS paragraph, c_custkey AS chapter_id, c_name AS chapter_title, c_mktsegment AS section, n_name AS volume_title, n_nationkey AS volume_num, CASE WHEN r_regionkey < 2 THEN 'bn' ELSE 'en' END AS lang, r_name AS book_title, o_orderstatus AS summary, CAST(o_orderkey % 100 AS INT) AS paragraph_idx FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


def paragraph_dim(spark, d):
    """Orders as paragraphs, customers as chapters, nations as volumes, regions as books."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("paragraph"), F.col("o_custkey").alias("chapter_id"), F.col("o_orderstatus").alias("summary"), (F.col("o_orderkey") % 100).cast("int").alias("paragraph_idx"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") * 7).alias("char_offset"), F.concat(F.lit("p-"), "o_orderkey").alias("para_id_html"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("chapter_id"), F.col("c_name").alias("chapter_title"), F.col("c_mktsegment").alias("section"), F.concat(F.lit("ch_"), "c_custkey").alias("chapter_id_html"), F.col("c_nationkey").alias("volume_id"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("volume_id"), F.col("n_name").alias("volume_title"), F.col("n_nationkey").alias("volume_num"), F.col("n_regionkey").alias("book_id"))
    r = t(spark, d, "region").select(F.col("r_regionkey").alias("book_id"), F.col("r_name").alias("book_title"), F.when(F.col("r_regionkey") < 2, "bn").otherwise("en").alias("lang"))
    return o.join(c, "chapter_id").join(n, "volume_id").join(r, "book_id")


def named(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("concept"), F.col("s_name").alias("label"))


@query(f"SELECT paragraph AS paragraph_id, text, summary, paragraph_idx, char_offset, para_id_html, chapter_id, chapter_title, section, 'ch_' || chapter_id AS chapter_id_html, volume_title, volume_num, lang, book_title FROM ({CHAPTERS}) JOIN (SELECT o_orderkey AS paragraph, o_orderpriority AS text, o_orderkey * 7 AS char_offset, 'p-' || o_orderkey AS para_id_html FROM orders) USING (paragraph) WHERE paragraph % 3 = 0")
def full_metadata(spark, d):
    """All fourteen columns of the paragraphs that are asked for."""
    return metadata(paragraph_dim(spark, d), t(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("paragraph")))


@query(f"SELECT paragraph, volume_title || ' › ' || CASE WHEN section = 'BUILDING' THEN '' ELSE section || ' › ' END || chapter_title || ' › ¶' || (paragraph_idx + 1) AS location FROM ({CHAPTERS})")
def location_with_section(spark, d):
    """Sections are left out where they are empty."""
    p = paragraph_dim(spark, d).withColumn("section", F.when(F.col("section") == "BUILDING", "").otherwise(F.col("section")))
    return p.select("paragraph", T.location(F.col("volume_title"), F.col("section"), F.col("chapter_title"), F.col("paragraph_idx")).alias("location"))


@query(f"SELECT concept, s_name AS label, n_mentions, (SELECT count(*) FROM ({PC}) WHERE concept = 3 AND relation = 'R') AS n_r FROM (SELECT concept, count(*) AS n_mentions FROM ({PC}) WHERE concept = 3 GROUP BY concept) JOIN supplier ON s_suppkey = concept")
def fetch_concept(spark, d):
    """One concept with its mentions."""
    e = edges(spark, d)
    own = S.concept(named(spark, d).join(G.mention_recount(named(spark, d), e, "concept"), "concept"), 3)
    return own.crossJoin(F.broadcast(e.where("concept = 3 AND relation = 'R'").agg(F.count("*").alias("n_r"))))


@query(f"SELECT paragraph, concept, s_name AS label, relation, round(weight, 6) AS weight, row_number() OVER (PARTITION BY paragraph ORDER BY weight DESC, concept, relation) AS rank FROM ({PC}) JOIN supplier ON s_suppkey = concept WHERE paragraph < 200")
def concepts_for_paragraph(spark, d):
    """The concepts of the paragraphs that are asked for, the heaviest first."""
    got = S.concepts_of(edges(spark, d), named(spark, d), t(spark, d, "orders").where("o_orderkey < 200").select(F.col("o_orderkey").alias("paragraph")))
    return got.withColumn("weight", F.round("weight", 6))


COVER = f"SELECT paragraph, lang, count(DISTINCT concept) AS n_concepts, sum(weight) AS total FROM ({PC}) JOIN ({CHAPTERS}) USING (paragraph) WHERE concept IN ({{ids}}) AND lang IN ({{langs}}) GROUP BY ALL"


def _examples(ids, langs, k, having=""):
    c = COVER.format(ids=ids, langs=langs)
    return f"WITH top AS ({c} {having} ORDER BY n_concepts DESC, round(total, 9) DESC, paragraph LIMIT {k}) SELECT paragraph, lang, n_concepts, round(total, 6) AS total, (SELECT string_agg(DISTINCT s_name, ',' ORDER BY s_name) FROM ({PC}) e JOIN supplier ON s_suppkey = concept WHERE e.paragraph = top.paragraph AND concept IN ({ids})) AS matched, volume_title FROM top JOIN (SELECT paragraph, volume_title FROM ({CHAPTERS})) USING (paragraph)"


def examples(spark, d, ids, k, langs, require_all=False):
    got = G.examples(edges(spark, d), named(spark, d), paragraph_dim(spark, d), ids, k, require_all, langs)
    return got.select("paragraph", "lang", "n_concepts", F.round("total", 6).alias("total"), F.array_join("matched_concepts", ",").alias("matched"), "volume_title")


@query(_examples("1, 2, 3, 4", "'bn'", 5))
def example_paragraphs_lang(spark, d):
    """The best covering paragraphs of one language, with the labels that they hold."""
    return examples(spark, d, [1, 2, 3, 4, 4], 5, ["bn"])


@query(_examples("5, 6", "'en', 'bn'", 25, "HAVING count(DISTINCT concept) = 2"))
def example_paragraphs_pair(spark, d):
    """Paragraphs that hold both concepts of an edge, of two languages."""
    return examples(spark, d, [5, 6], 25, ["en", "bn"], require_all=True)


@query(f"SELECT concept, lang, paragraph, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY concept, lang ORDER BY weight DESC, paragraph) AS rank FROM (SELECT paragraph, lang, concept, max(weight) AS weight FROM ({PC}) JOIN ({CHAPTERS}) USING (paragraph) WHERE concept < 5 GROUP BY ALL)) WHERE rank <= 5")
def paragraphs_for_concepts_lang(spark, d):
    pc = G.upsert_max(edges(spark, d), ["paragraph", "concept"])
    got = G.paragraphs_for(pc, named(spark, d).where("concept < 5"), 5, paragraph_dim(spark, d), ["en", "bn"], by_lang=True)
    return got.select("concept", "lang", "paragraph", F.round("weight", 6).alias("weight"), "rank")


ALIAS = "SELECT l_suppkey AS concept, CASE WHEN l_returnflag = 'R' THEN 'bn' ELSE 'en' END AS lang, min(l_orderkey * 10 + l_linenumber) AS id, CAST(l_partkey AS VARCHAR) AS alias FROM lineitem GROUP BY l_suppkey, lang, alias"
LINKS = f"SELECT x.concept AS src, y.concept AS dst, CASE WHEN (x.concept + y.concept) % 2 = 0 THEN 'co-occurs' ELSE 'similar' END AS relation, count(*)::DOUBLE AS weight FROM (SELECT DISTINCT paragraph, concept FROM ({PC})) x JOIN (SELECT DISTINCT paragraph, concept FROM ({PC})) y ON x.paragraph = y.paragraph AND x.concept <> y.concept GROUP BY ALL"
TOP = f"SELECT concept, count(*) AS n_mentions FROM ({PC}) GROUP BY concept ORDER BY n_mentions DESC, concept LIMIT 50"


def graph_of(spark, d):
    c = named(spark, d).join(G.mention_recount(named(spark, d), edges(spark, d), "concept"), "concept")
    li = t(spark, d, "lineitem")
    aliases = li.select(F.col("l_suppkey").alias("concept"), F.when(F.col("l_returnflag") == "R", "bn").otherwise("en").alias("lang"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").cast("string").alias("alias"))
    pairs = G.pair_counts(edges(spark, d)).select("a", "b", F.when((F.col("a") + F.col("b")) % 2 == 0, "co-occurs").otherwise("similar").alias("relation"), F.col("n").cast("double").alias("weight"))
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "relation", "weight").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "relation", "weight"))
    return G.concept_graph(c, aliases, both, 50)


@query(f"WITH top AS ({TOP}), al AS (SELECT concept, lang, string_agg(alias, ',' ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY concept, lang ORDER BY id, alias) AS n FROM ({ALIAS})) WHERE n <= 3 GROUP BY ALL) SELECT top.concept AS id, s_name AS label, n_mentions, coalesce(e.x, '') AS aliases_en, coalesce(b.x, '') AS aliases_bn FROM top JOIN supplier ON s_suppkey = concept LEFT JOIN al e ON e.concept = top.concept AND e.lang = 'en' LEFT JOIN al b ON b.concept = top.concept AND b.lang = 'bn'")
def concept_graph_nodes(spark, d):
    nodes, _ = graph_of(spark, d)
    return nodes.select("id", "label", "n_mentions", F.array_join("aliases_en", ",").alias("aliases_en"), F.array_join("aliases_bn", ",").alias("aliases_bn"))


@query(f"WITH top AS (SELECT concept FROM ({TOP})), e AS (SELECT src AS a, dst AS b, relation, weight FROM ({LINKS}) WHERE src < dst AND src IN (FROM top) AND dst IN (FROM top)) SELECT a, b, relation, CASE WHEN max(weight) OVER w > min(weight) OVER w THEN round((weight - min(weight) OVER w) / (max(weight) OVER w - min(weight) OVER w), 4) ELSE 1.0 END AS weight FROM e WINDOW w AS (PARTITION BY relation)")
def concept_graph_edges(spark, d):
    return graph_of(spark, d)[1]


@query(f"SELECT concept, max(n) AS shared FROM (SELECT b.concept, a.concept AS chosen, count(DISTINCT a.paragraph) AS n FROM ({PC}) a JOIN ({PC}) b USING (paragraph) WHERE a.concept IN (1, 2) AND b.concept NOT IN (1, 2) AND b.concept IN (SELECT concept FROM ({TOP})) GROUP BY ALL) GROUP BY concept")
def marked_graph(spark, d):
    """What a drawn graph marks for a selection, read back from its JSON: each shown concept with the paragraphs it shares."""
    nodes, links = graph_of(spark, d)
    chosen = [1, 2]
    shared = G.cooccurring(edges(spark, d), chosen, within=nodes.select(F.col("id").alias("concept")))
    groups = nodes.select("id", F.lit(0).alias("cluster"), F.lit("all").alias("cluster_label"))
    spec = G.graph_spec(nodes.select("id", "label", "n_mentions"), links, groups, selected=chosen, cooccurring=shared)
    back = spec.select(F.explode(F.from_json("spec", "nodes array<struct<id:long,selected:boolean,shared:long>>")["nodes"]).alias("n")).select("n.*")
    return back.where("NOT selected AND shared > 0").select(F.col("id").alias("concept"), "shared")


@query(f"SELECT CASE WHEN selected THEN 'selected' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT src IN (1, 2) OR dst IN (1, 2) AS selected FROM ({LINKS}) WHERE src < dst AND src IN (SELECT concept FROM ({TOP})) AND dst IN (SELECT concept FROM ({TOP}))) GROUP BY selected")
def marked_edges(spark, d):
    nodes, links = graph_of(spark, d)
    groups = nodes.select("id", F.lit(0).alias("cluster"), F.lit("all").alias("cluster_label"))
    spec = G.graph_spec(nodes.select("id", "label", "n_mentions"), links, groups, selected=[1, 2])
    back = spec.select(F.explode(F.from_json("spec", "edges array<struct<selected:boolean>>")["edges"]).alias("e")).select("e.*")
    return back.groupBy(F.when(F.col("selected"), "selected").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT concept, paragraph, relation, round(weight, 6) AS weight, rank FROM (SELECT src AS concept, dst AS paragraph, relation, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, relation) AS rank FROM ({LINKS}) WHERE relation = 'similar' AND weight >= 2) WHERE rank <= 4")
def neighbors_by_relation(spark, d):
    """Neighbours of one kind of relation, of some weight."""
    pairs = G.pair_counts(edges(spark, d)).select("a", "b", F.when((F.col("a") + F.col("b")) % 2 == 0, "co-occurs").otherwise("similar").alias("relation"), F.col("n").cast("double").alias("weight"))
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "relation", "weight").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "relation", "weight"))
    return G.neighbors(both, both, 4, 2.0, ["similar"]).select(F.col("src").alias("concept"), F.col("dst").alias("paragraph"), "relation", F.round("weight", 6).alias("weight"), "rank")


SEEDS = {"first": ["row 0", "row 10", "row 20", "nobody"], "second": ["row 1", "row 11"], "third": ["nobody"], "fourth": ["row 2", "row 33"]}
SEED_ROWS = ", ".join(f"({i}, '{c}', '{x}')" for i, c in enumerate(SEEDS) for x in SEEDS[c])


def classes(spark, d):
    v = vectors(spark, d).select("id", "vec")
    return V.seed_classes(v, v.select("id", F.concat(F.lit("row "), "id").alias("label")), SEEDS, min_cos=0.2)


CLASSES = f"WITH s(n, class, label) AS (VALUES {SEED_ROWS}), v AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), e AS (SELECT n, class, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM s JOIN v ON label = 'row ' || id), c AS (SELECT n, class, list(x ORDER BY d) AS c FROM (SELECT n, class, d, avg(x) AS x FROM e GROUP BY ALL) GROUP BY ALL), r AS (SELECT id, class, list_cosine_similarity(v, c) AS sim, row_number() OVER (PARTITION BY id ORDER BY list_cosine_similarity(v, c) DESC, n) AS r FROM v, c)"


@query(f"{CLASSES} SELECT id, CASE WHEN sim >= 0.2 THEN class ELSE 'other' END AS class, round(sim, 6) AS sim FROM r WHERE r = 1")
def seed_classes(spark, d):
    """Concepts by the nearest of some classes, each the mean of its seed concepts; seeds that do not exist are left out."""
    return classes(spark, d).withColumn("sim", F.round("sim", 6))


@query(f"{CLASSES} SELECT (CASE class WHEN 'first' THEN 0 WHEN 'second' THEN 1 WHEN 'third' THEN 2 ELSE 3 END)::INT AS place, class, count(*) AS n FROM r WHERE r = 1 AND sim >= 0.2 GROUP BY class")
def class_list(spark, d):
    """The classes that occur, in their fixed order."""
    return V.class_list(classes(spark, d), list(SEEDS))


@query(f"SELECT chapter_id AS chapter, substr(string_agg(text, '' ORDER BY n) , 1, 12) AS first_paragraph FROM (SELECT chapter_id, o_orderpriority AS text, row_number() OVER (PARTITION BY chapter_id ORDER BY paragraph_idx, paragraph) AS n FROM ({CHAPTERS}) JOIN orders ON o_orderkey = paragraph) WHERE n = 1 GROUP BY chapter_id")
def chapter_info(spark, d):
    p = paragraph_dim(spark, d)
    return R.chapter_info(p.select("paragraph", F.col("chapter_id").alias("chapter"), "paragraph_idx"), p.select("paragraph", "text"), 12)


@query(f"SELECT chapter_id AS chapter, left(any_value(chapter_title) || '. ' || arg_min(o_orderpriority, (paragraph_idx, paragraph)), 25) AS query FROM ({CHAPTERS}) JOIN orders ON o_orderkey = paragraph GROUP BY chapter_id")
def known_item_queries(spark, d):
    """The text by which each chapter is asked for: its title and the beginning of its first paragraph."""
    p = paragraph_dim(spark, d)
    first = R.chapter_info(p.select("paragraph", F.col("chapter_id").alias("chapter"), "paragraph_idx"), p.select("paragraph", "text"))
    titles = t(spark, d, "customer").select(F.col("c_custkey").alias("chapter"), F.col("c_name").alias("title"))
    return first.join(titles, "chapter").select("chapter", T.known_item_query(F.col("title"), F.col("first_paragraph"), 25).alias("query"))


@query("SELECT DISTINCT l_suppkey AS concept FROM lineitem WHERE l_suppkey <= 50 AND l_suppkey % 3 <> 0 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 20 = 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def selection_sets(spark, d):
    """A selection: shown concepts without the removed ones, with added ones, as far as they occur."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("concept"))
    used = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("concept"))
    return S.selection(s.where("concept <= 50"), s.where("concept % 3 = 0"), s.where("concept % 20 = 0"), used)


@query("SELECT count(*) AS n, 0 AS overlaps FROM embeddings WHERE vec_id < 120")
def overlap_removal(spark, d):
    """Discs placed by two components of vectors, pushed apart; none overlap by more than a thousandth in the end."""
    v = vectors(spark, d).where("id < 120").select("id", (F.col("vec")[0] * 2000).cast("double").alias("x"), (F.col("vec")[1] * 2000).cast("double").alias("y"), F.lit(20.0).alias("size"))
    p = G.separated(v, pad=4.0, steps=2000)
    q = p.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = p.join(F.broadcast(q), F.col("id") < F.col("other")).where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) < 23.999)  # 120 rows
    return p.agg(F.count("*").alias("n")).crossJoin(near.agg(F.count("*").cast("int").alias("overlaps")))
