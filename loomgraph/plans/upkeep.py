"""Upkeep: snapshots, restores, persisted extractions, upserts, states and the build, each over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import retrieve as R
from ..operators import vectors as V
from ..operators import warm as W
from ..sources import store
from ..streaming import events as E
from . import build as B
from .base import PC, edges, query, scratch, t, vectors

KEYED = "SELECT o_orderkey AS paragraph, 'text ' || (o_orderkey % 300) AS text_norm, CASE WHEN o_custkey % 2 = 0 THEN 'en' ELSE 'bn' END AS lang, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS summary FROM orders"
ENTITY = "SELECT DISTINCT l_orderkey AS paragraph, l_partkey % 50 AS entity FROM lineitem WHERE l_returnflag = 'R'"


def keyed(spark, d):
    """Orders as paragraphs; many have the same text."""
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("paragraph"), F.concat(F.lit("text "), F.col("o_orderkey") % 300).alias("text_norm"), F.when(F.col("o_custkey") % 2 == 0, "en").otherwise("bn").alias("lang"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("summary"))


def snapshots(spark, d):
    names = t(spark, d, "supplier").select(F.col("s_suppkey").alias("concept"), F.col("s_name").alias("label"))
    pe = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("paragraph"), (F.col("l_partkey") % 50).alias("entity")).distinct()
    entities = spark.range(50).select(F.col("id").alias("entity"), F.concat(F.lit("entity "), "id").alias("label"), F.when(F.col("id") % 2 == 0, "person").otherwise("place").alias("type"))
    return W.snapshot(keyed(spark, d), edges(spark, d).where("paragraph % 4 <> 0"), "stub@v1", names, pe, entities)


SNAP = f"WITH k AS ({KEYED}), c AS (SELECT paragraph, count(*) AS n_concepts, sum(weight) AS weight FROM ({PC}) WHERE paragraph % 4 <> 0 GROUP BY paragraph), e AS (SELECT paragraph, count(*) AS n_entities FROM ({ENTITY}) GROUP BY paragraph), l AS (SELECT *, row_number() OVER (PARTITION BY text_norm, lang ORDER BY paragraph DESC) AS n FROM k LEFT JOIN c USING (paragraph) LEFT JOIN e USING (paragraph) WHERE summary IS NOT NULL OR n_concepts IS NOT NULL OR n_entities IS NOT NULL), s AS (SELECT text_norm, lang, paragraph, summary, coalesce(n_concepts, 0) AS n_concepts, coalesce(n_entities, 0) AS n_entities, coalesce(weight, 0) AS weight FROM l WHERE n = 1)"


@query(f"{SNAP} SELECT text_norm, lang, 'stub@v1' AS extractor_tag, summary, n_concepts::INT AS n_concepts, n_entities::INT AS n_entities, round(weight, 6) AS weight FROM s")
def concept_snapshot(spark, d):
    """The latest paragraph of each text with a summary, a concept or an entity; read back from the written table's JSON."""
    s = store.Store(spark, scratch(spark, "snapshot"))
    back = s.write("concept_snapshot", snapshots(spark, d))
    c = F.from_json("concepts_json", "array<struct<label:string,relation:string,weight:double>>")
    e = F.from_json("entities_json", "array<struct<label:string,type:string>>")
    weight = F.round(F.aggregate(F.transform(c, lambda x: x["weight"]), F.lit(0.0), lambda a, x: a + x), 6)
    return back.select("text_norm", "lang", "extractor_tag", "summary", F.size(c).alias("n_concepts"), F.size(e).alias("n_entities"), weight.alias("weight"))


@query(f"{SNAP} SELECT k.paragraph, s_name AS label, relation, round(x.weight, 6) AS weight FROM k JOIN s USING (text_norm, lang) JOIN ({PC}) x ON x.paragraph = s.paragraph AND s.paragraph % 4 <> 0 JOIN supplier ON s_suppkey = concept WHERE k.paragraph % 7 = 0")
def restored_concepts(spark, d):
    """What a snapshot gives back to paragraphs of the same text and language: concepts by label."""
    hits, _ = W.restored(keyed(spark, d).where("paragraph % 7 = 0").drop("summary"), store.written(snapshots(spark, d), "snapshot"), "stub@v1")
    return W.restored_edges(hits).withColumn("weight", F.round("weight", 6))


@query(f"{SNAP} SELECT k.paragraph, 'entity ' || entity AS label, CASE WHEN entity % 2 = 0 THEN 'person' ELSE 'place' END AS type FROM k JOIN s USING (text_norm, lang) JOIN ({ENTITY}) x ON x.paragraph = s.paragraph WHERE k.paragraph % 7 = 0")
def restored_entities(spark, d):
    hits, _ = W.restored(keyed(spark, d).where("paragraph % 7 = 0").drop("summary"), store.written(snapshots(spark, d), "snapshot"), "stub@v1")
    return W.restored_entities(hits)


@query("SELECT DISTINCT s_suppkey + 1000 AS concept, l_returnflag AS lang, CAST(l_partkey AS VARCHAR) AS alias FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 3 = 0")
def restored_aliases(spark, d):
    """Aliases kept by label go to the concepts that exist again, under their new ids."""
    names = t(spark, d, "supplier").select(F.col("s_suppkey").alias("concept"), F.col("s_name").alias("label"))
    aliases = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("concept"), F.col("l_returnflag").alias("lang"), F.col("l_partkey").cast("string").alias("alias"))
    s = store.Store(spark, scratch(spark, "aliases"))
    kept = s.write("alias_snapshot", W.alias_snapshot(aliases, names))
    return W.restored_aliases(kept, names.where("concept % 3 = 0").withColumn("concept", F.col("concept") + 1000))


EXTRACTED = "SELECT doc_id, label, surface FROM documents, LATERAL (VALUES ('tion-words', regexp_extract(text, '[a-z]+tion')), ('ment-words', regexp_extract(text, '[a-z]+ment'))) v(label, surface) WHERE doc_id % 2 = 0 AND surface <> ''"


def extraction(text):
    """A stand-in whose entities and surfaces come from the text: words of two endings as concepts, the first numeral as an entity."""
    found = [F.struct(F.lit(f"{x}-words").alias("label"), F.regexp_extract(text, f"[a-z]+{x}", 0).alias("surface"), F.lit("discusses").alias("relation"), F.lit(0.5).alias("weight")) for x in ("tion", "ment")]
    concepts = F.filter(F.array(*found), lambda c: c["surface"] != "")
    number = F.regexp_extract(text, "[0-9]+", 0)
    entities = F.filter(F.array(F.struct(number.alias("label"), F.when(F.length(number) > 2, "text").otherwise("other").alias("type"))), lambda e: e["label"] != "")
    return F.struct(concepts.alias("concepts"), entities.alias("entities"), F.when(F.size(concepts) > 0, "seen").otherwise("").alias("summary"))


def persisted(spark, d) -> store.Store:
    s = store.Store(spark, scratch(spark, "extract"))
    docs = t(spark, d, "documents").where("doc_id % 2 = 0").select("lang", F.col("doc_id").alias("chapter_key"), F.lit(0).alias("paragraph_idx"), "text")
    B.build(s, B.paragraph_rows(docs), extract=extraction, skip=("link", "embed", "stats"))
    return s


@query(f"WITH x AS ({EXTRACTED}) SELECT label, count(*) AS n_mentions, (SELECT count(*) FROM (SELECT DISTINCT lang, surface FROM x y JOIN documents USING (doc_id) WHERE y.label = x.label)) AS n_aliases FROM x GROUP BY label")
def extracted_concepts(spark, d):
    """Concepts with their mentions and aliases after an extraction was persisted."""
    s = persisted(spark, d)
    n = s.read("concept_aliases").groupBy("concept").agg(F.count("*").alias("n_aliases"))
    return s.read("concepts").join(n, "concept").select("label", "n_mentions", "n_aliases")


@query("SELECT label, CASE WHEN length(label) > 2 THEN 'text' ELSE 'other' END AS type, count(*) AS n FROM (SELECT regexp_extract(text, '[0-9]+') AS label FROM documents WHERE doc_id % 2 = 0) WHERE label <> '' GROUP BY label")
def extracted_entities(spark, d):
    s = persisted(spark, d)
    n = s.read("paragraph_entities").groupBy("entity").agg(F.count("*").alias("n"))
    return s.read("entities").join(n, "entity").select("label", "type", "n")


@query("SELECT l_partkey, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber)) AS quantity FROM lineitem GROUP BY l_partkey")
def upsert_last(spark, d):
    """Of repeated inserts of a key the last value stays."""
    rows = t(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return G.upsert_last(rows, ["l_partkey"], "l_quantity", "seq").select("l_partkey", F.col("l_quantity").alias("quantity"))


@query("SELECT o_orderkey, coalesce(n, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN count(*) > 3 THEN 'many' END AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def coalesce_update(spark, d):
    """A value is set where a new one is given."""
    new = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.count("*") > 3, "many").alias("o_orderpriority"))
    return G.coalesce_update(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), new, "o_orderkey", "o_orderpriority")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_rows(spark, d):
    """Insert-or-replace: the last row of each key."""
    e = t(spark, d, "events").withColumn("seq", F.struct("ts", "event_id"))
    return W.latest(e, ["user_id", "event_type"], "seq").select("user_id", "event_type", "event_id", "value")


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def dangling_edges(spark, d):
    """Edges whose end is in no row of the dimension."""
    return W.dangling(t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), t(spark, d, "part").where("p_size > 5"), "l_partkey", "p_partkey").distinct()


@query("WITH p AS (SELECT c_custkey AS pair, c_mktsegment AS lang, n_name AS title, c_acctbal AS recorded FROM customer JOIN nation ON n_nationkey = c_nationkey), c AS (SELECT s_suppkey AS id, 'BUILDING' AS lang, n_name AS title, s_acctbal AS sim FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT pair, arg_min(id, (round(abs(sim - recorded), 2), id)) AS id FROM p JOIN c USING (lang, title) GROUP BY pair")
def remapped_pairs(spark, d):
    """Stale ids replaced by those of the same language and title whose similarity is nearest to the recorded one."""
    n = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("title"))
    p = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("pair"), F.col("c_mktsegment").alias("lang"), "title", F.col("c_acctbal").alias("recorded"))
    c = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.lit("BUILDING").alias("lang"), "title", F.col("s_acctbal").alias("sim"))
    return R.remapped_pairs(p, c, places=2)


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    """Events by type in windows of five minutes; the same on a stream, where a watermark bounds the state."""
    got = E.windowed_counts(t(spark, d, "events"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) FROM events)")
def event_dedupe_stream(spark, d):
    """Deduplicated events as a stream, in micro-batches."""
    root = scratch(spark, "dedupe")
    source = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seq", F.date_trunc("hour", "ts"))
    once = E.deduplicated(source, ["user_id", "event_type", "seq"], late="3650 days")
    E.microbatches(once, lambda b: b.agg(F.count("*").alias("n")), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.sum("n").alias("n"))


@query("SELECT (SELECT count(*) FROM orders) AS kept, 0 AS wiped, (SELECT count(*) FROM orders) AS again")
def store_wipe(spark, d):
    """A wipe removes tables but keeps the snapshots."""
    s = store.Store(spark, scratch(spark, "wipe"))
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("concept"), F.lit("en").alias("lang"), F.col("o_orderstatus").alias("alias"), F.col("o_orderstatus").alias("label"))
    s.write("alias_snapshot", rows)
    s.write("concept_aliases", rows)
    s.wipe()
    n = lambda df, name: df.agg(F.count("*").cast("long").alias(name))
    empty = n(s.read("concept_aliases"), "wiped").withColumn("wiped", F.col("wiped").cast("int"))
    kept = n(s.read("alias_snapshot"), "kept")
    return kept.crossJoin(empty).crossJoin(n(s.write("concept_aliases", rows), "again"))


@query("SELECT CAST(label AS VARCHAR) AS lang, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings WHERE vec_id % 10 = 0 GROUP BY label")
def vector_reconstruct(spark, d):
    """Stored vectors of given nodes by id."""
    s = store.Store(spark, scratch(spark, "reconstruct"))
    v = vectors(spark, d)
    s.write_vectors(v.select(F.col("id").alias("node"), V.as_double(F.col("vec")).alias("vec"), F.lit("concept").alias("node_kind"), F.col("label").cast("string").alias("lang")))
    got = s.vector_of(v.where("id % 10 = 0").select(F.col("id").alias("node")), "concept")
    total = F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))
    return got.join(v.select(F.col("id").alias("node"), F.col("label").cast("string").alias("lang")), "node").groupBy("lang").agg(F.count("*").alias("n"), F.round(total, 4).alias("total"))


LINKED = f"SELECT x.concept AS src, y.concept AS dst FROM (SELECT DISTINCT paragraph, concept FROM ({PC})) x JOIN (SELECT DISTINCT paragraph, concept FROM ({PC})) y ON x.paragraph = y.paragraph AND x.concept <> y.concept GROUP BY ALL HAVING count(*) >= 2"


@query(f"WITH n AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier), m AS (SELECT src, avg(x) AS near FROM ({LINKED}) JOIN n ON dst = id GROUP BY src) SELECT id AS node, round((x + coalesce(near, x)) / 2, 4) AS x FROM n LEFT JOIN m ON src = id")
def refined_vectors(spark, d):
    """Smoothed vectors written as a kind of their own, and read back."""
    s = store.Store(spark, scratch(spark, "refined"))
    f = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0).alias("d"), F.col("s_acctbal").alias("x"))
    got = G.smoothed(f, G.cooccurrence_edges(edges(spark, d)).select("src", "dst"))
    rows = got.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda v: v["x"]).alias("vec"))
    s.write_vectors(rows.select(F.col("id").alias("node"), "vec", F.lit("refined").alias("node_kind"), F.lit(None).cast("string").alias("lang")))
    return s.vectors("refined").select("node", F.round(F.get("vec", F.lit(0)), 4).alias("x"))


@query("SELECT lang, count(*) AS paragraphs, sum(length(text))::BIGINT AS chars FROM (SELECT c_mktsegment AS lang, o_orderpriority AS text FROM orders JOIN customer ON c_custkey = o_custkey) WHERE lang = 'BUILDING' GROUP BY lang")
def language_scan(spark, d):
    """The hierarchy written by language and one language read back, whose folder alone is scanned."""
    at = scratch(spark, "dim")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("lang"))
    H.write_dim(t(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", F.col("o_orderpriority").alias("text"), "lang"), at)
    return H.read_dim(spark, at, "BUILDING").groupBy("lang").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT n_nationkey % 3 AS book, count(DISTINCT n_name) AS volumes, count(DISTINCT c_custkey) AS chapters, count(*) AS paragraphs FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY book")
def hierarchy_load(spark, d):
    """Books, volumes and chapters made from flat rows, each natural key once with a lasting id, and joined again."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("volume"))
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, "c_nationkey")
    flat = rows.select((F.col("c_nationkey") % 3).alias("book"), "volume", F.col("c_custkey").alias("chapter"), F.col("o_orderkey").alias("paragraph"))
    books, volumes, chapters, paragraphs = H.loaded(flat, ["book"], ["volume"], ["chapter"], "paragraph")
    joined = H.paragraphs_dim(paragraphs, chapters, volumes, books)
    return joined.groupBy("book").agg(F.count_distinct("volume_id").alias("volumes"), F.count_distinct("chapter_id").alias("chapters"), F.count("*").alias("paragraphs"))


@query("SELECT count(*) FILTER (length(regexp_replace(text, '\\s+', ' ', 'g')) > 0) AS tried, (SELECT count(*) FROM documents) - least(40, (SELECT count(*) FROM documents)) AS waiting FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 40)")
def limited_extraction(spark, d):
    """An extraction of forty paragraphs; the step stays open, the rest waits."""
    s = store.Store(spark, scratch(spark, "limited"))
    docs = t(spark, d, "documents").select("lang", F.col("doc_id").alias("chapter_key"), F.lit(0).alias("paragraph_idx"), "text")
    B.build(s, B.paragraph_rows(docs), extract=jsonx.stub_extraction, limit=40, skip=("link", "embed", "stats"))
    p = s.read("paragraphs").agg(F.count("summary").alias("tried"), F.count(F.when(F.col("summary").isNull(), 1)).alias("waiting"))
    if s.finished("extract"):
        raise RuntimeError("the step is closed though paragraphs wait")
    return p
