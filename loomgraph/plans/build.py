"""The offline build: parse, restore, extract, link, embed, count. Every step writes a table version and its state, so a build resumes where it ended.

The models are arguments; the defaults are stand-ins for tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import jsonx
from ..functions import text as T
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import qa as Q
from ..operators import study as S
from ..operators import vectors as V
from ..operators import warm as W
from ..sources import html
from ..sources.store import Store, written

STEPS = ("parse", "extract", "link", "embed", "stats")


def parsed(pages: DataFrame) -> DataFrame:
    """Paragraph rows of whole pages. pages: page_id, lang, html; `bn` pages have the second shape, all others the first."""
    first = H.chapters(html.blocks(pages.where("NOT lang <=> 'bn'"))).withColumn("lang", F.lit("en"))
    second = H.items(html.blocks(pages.where("lang = 'bn'"))).withColumns({"lang": F.lit("bn"), "section": F.lit(None).cast("string")})
    cols = ["id", "lang", "volume", "volume_num", "section", "chapter", "chapter_id", "paragraph_idx", "text", "anchor", "pos"]
    runs = H.sessions(first.select(cols).unionByName(second.select(cols)), ["lang", "id"], ["pos"], ["volume", "chapter_id", "chapter"], "run")
    return paragraph_rows(runs.withColumn("chapter_key", F.xxhash64("lang", "id", "run")))


def paragraph_rows(rows: DataFrame) -> DataFrame:
    """Adds what a paragraph row lacks, its id from its chapter and place, and its normalised text. rows: lang, chapter_key, paragraph_idx, text."""
    kinds = {"volume": "string", "volume_num": "int", "section": "string", "chapter": "string", "anchor": "string", "summary": "string"}
    rows = rows.withColumns({k: F.lit(None).cast(v) for k, v in kinds.items() if k not in rows.columns})
    return rows.withColumns({"paragraph": F.xxhash64("lang", "chapter_key", "paragraph_idx"), "text_norm": T.normalize_text(F.col("text"))})


def sentence_rows(paragraphs: DataFrame) -> DataFrame:
    kept = F.filter(T.sentences(F.col("text"), F.col("lang")), T.sentence_kept)
    return paragraphs.select("paragraph", "lang", F.posexplode(kept).alias("sentence_idx", "text"))


def build(store: Store, paragraphs: DataFrame, tag: str = "stub@v1", extract: Callable[[Column], Column] = jsonx.stub_extraction, encode: Callable[[Column], Column] = Q.hashed_vectors, skip: tuple[str, ...] = (), from_step: str | None = None, limit: int = 0, merge_at: float = 0.92, similar_at: float = 0.78, top_k: int = 12, min_count: int = 2) -> DataFrame:
    """Runs the steps that are not done yet and returns the statistics (key, value).

    from_step: that step and all later ones run again. skip: steps left out. A new parse takes a snapshot of what was extracted and keeps it for
    paragraphs whose normalised text is known; all others are extracted anew. extract gives an array of (label, relation, weight), or what
    jsonx.parsed_extraction gives: concepts with their surfaces, entities and a summary. limit: that many paragraphs are extracted and the step stays open.
    """
    unknown = {*skip, *([from_step] if from_step else [])} - set(STEPS)
    if unknown:
        raise ValueError(f"no such step: {', '.join(sorted(unknown))}")
    work = {
        "parse": lambda: _parse(store, paragraphs, tag),
        "extract": lambda: _extract(store, extract, limit),
        "link": lambda: _link(store, encode, merge_at, similar_at, top_k, min_count),
        "embed": lambda: _embed(store, encode),
        "stats": lambda: _count(store),
    }
    again = False
    for step in STEPS:
        again = again or step == from_step
        if step in skip or (not again and store.finished(step)):
            continue
        store.mark(step, "started")
        left = work[step]()
        store.mark(step, "progress" if left else "done")
        again = True  # what later steps read has changed
    return store.read("stats")


def _concept_id(label: str) -> Column:
    return F.xxhash64(label).alias("concept")


def _store_concepts(store: Store, labels: DataFrame, pc: DataFrame) -> None:
    """Concepts with their mentions counted anew. labels: concept, label."""
    labels = labels.distinct()
    store.write("concepts", labels.join(G.mention_recount(labels, pc, "concept"), "concept"))


def _store_entities(store: Store, found: DataFrame, pe: DataFrame, seq: str) -> None:
    """Adds (paragraph, label, type) rows to the entities, the last type of a label staying, and their edges to pe."""
    old = store.read("entities").select("label", "type").withColumn("_seq", F.lit(None).cast("long"))
    all_ = old.unionByName(found.select("label", "type", F.col(seq).alias("_seq")))
    # nulls come first in a maximum, so a new type replaces an old one
    last = all_.groupBy("label").agg(F.max(F.struct("_seq", "type")).alias("m")).select(F.xxhash64("label").alias("entity"), "label", F.col("m.type").alias("type"))
    store.write("entities", last)
    store.write("paragraph_entities", pe.unionByName(found.select("paragraph", F.xxhash64("label").alias("entity"))).distinct())


def _parse(store: Store, paragraphs: DataFrame, tag: str) -> None:
    old, pc, concepts = store.read("paragraphs"), store.read("paragraph_concepts"), store.read("concepts")
    pe, entities = store.read("paragraph_entities"), store.read("entities")
    taken = W.snapshot(old.select("paragraph", "text_norm", "lang", "summary"), pc, tag, concepts, pe, entities, tried=True)
    before = store.read("concept_snapshot").join(taken.select(*W.KEY), W.KEY, "left_anti")
    snap = store.write("concept_snapshot", before.unionByName(taken))
    aliases = store.write("alias_snapshot", store.read("alias_snapshot").unionByName(W.alias_snapshot(store.read("concept_aliases"), concepts)).distinct())
    hits = written(W.restored(paragraphs.drop("summary"), snap, tag)[0], "hits")
    known = written(W.restored_edges(hits).withColumn("concept", _concept_id("label")), "known")
    fresh = paragraphs.join(hits.select("paragraph", F.col("summary").alias("_known")), "paragraph", "left").withColumn("summary", F.coalesce("_known", "summary"))
    staged = store.write("paragraph_concepts", known)
    _store_concepts(store, concepts.select("concept", "label").unionByName(known.select("concept", "label")), staged)
    store.write("concept_aliases", W.restored_aliases(aliases, store.read("concepts")))
    _store_entities(store, W.restored_entities(hits), store.spark.createDataFrame([], "paragraph long, entity long"), "paragraph")
    store.write("paragraphs", fresh)
    store.write("sentences", sentence_rows(store.read("paragraphs")))


def _extract(store: Store, extract: Callable[[Column], Column], limit: int = 0) -> bool:
    """Whether paragraphs are left."""
    p, pc = store.read("paragraphs"), store.read("paragraph_concepts")
    waiting = W.todo(p, pc)
    chosen = waiting.orderBy("paragraph").limit(limit) if limit else waiting
    raw = chosen.select("paragraph", "lang", extract(F.col("text")).alias("x"))
    if isinstance(raw.schema["x"].dataType, ArrayType):
        raw = raw.select("paragraph", "lang", F.struct(F.col("x").alias("concepts"), F.lit("").alias("summary")).alias("x"))
    raw = written(raw, "extracted")
    have = raw.select("x.*").columns
    c = raw.select("paragraph", "lang", F.explode("x.concepts").alias("c")).select("paragraph", "lang", _concept_id("c.label"), "c.*")
    keys = ["paragraph", "concept", "relation"]
    new = store.write("paragraph_concepts", G.upsert_max(pc.unionByName(c.select(*keys, "weight")), keys))
    _store_concepts(store, store.read("concepts").select("concept", "label").unionByName(c.select("concept", "label")), new)
    if "surface" in c.columns:
        said = c.where("length(surface) > 0").select("concept", "lang", F.col("surface").alias("alias"))
        store.write("concept_aliases", store.read("concept_aliases").unionByName(said).distinct())
    if "entities" in have:
        e = raw.select("paragraph", F.explode("x.entities").alias("e")).select("paragraph", "e.label", "e.type")
        _store_entities(store, e, store.read("paragraph_entities"), "paragraph")
    # an empty summary tells that the paragraph was tried, so paragraphs without concepts are not tried again
    tried = raw.select("paragraph", F.coalesce("x.summary", F.lit("")).alias("summary"))
    store.write("paragraphs", G.coalesce_update(p, tried, "paragraph", "summary"))
    return bool(limit) and bool(W.todo(store.read("paragraphs"), new).limit(1).count())


def _link(store: Store, encode: Callable[[Column], Column], merge_at: float, similar_at: float, top_k: int, min_count: int) -> None:
    concepts, pc = store.read("concepts"), store.read("paragraph_concepts")
    v = concepts.select(F.col("concept").alias("id"), encode(F.col("label")).alias("vec"))
    pairs = written(V.similar_pairs(v, min(merge_at, similar_at)), "similar")
    close = pairs.where(F.col("sim") >= merge_at)
    named = concepts.select(F.col("concept").alias("id"), "label", "n_mentions")
    mapping = V.survivors(V.merge_groups(G.components(close.select("a", "b")), close), named)
    kept, aliases, moved, _ = S.merged(concepts, store.read("concept_aliases"), pc, store.read("concept_edges"), written(mapping, "mapping"))
    kept, moved = written(kept, "kept"), written(moved, "moved")
    alive = kept.select("concept")
    similar = V.similarity_edges(pairs.where(F.col("sim") >= similar_at).join(alive.withColumnRenamed("concept", "a"), "a", "left_semi").join(alive.withColumnRenamed("concept", "b"), "b", "left_semi"), top_k)
    together = G.cooccurrence_edges(moved, min_count).select("src", "dst", F.lit("co-occurs").alias("relation"), "weight")
    store.write("concept_edges", similar.select("src", "dst", F.lit("similar").alias("relation"), F.col("sim").alias("weight")).unionByName(together))
    store.write("concept_aliases", aliases)
    store.write("concepts", kept)
    store.write("paragraph_concepts", moved)


def _embed(store: Store, encode: Callable[[Column], Column]) -> None:
    p = store.read("paragraphs")
    chapters = H.chapter_text(p, ["lang", "chapter_key"], F.coalesce("chapter", F.lit("")))
    parts = [
        ("paragraph", p.select(F.col("paragraph").alias("node"), "text", "lang")),
        ("sentence", store.read("sentences").select(F.xxhash64("paragraph", "sentence_idx").alias("node"), "text", "lang")),
        ("chapter", chapters.select(F.col("chapter_key").alias("node"), "text", "lang")),
        ("concept", store.read("concepts").select(F.col("concept").alias("node"), F.col("label").alias("text"), F.lit(None).cast("string").alias("lang"))),
    ]
    for kind, rows in parts:
        store.write_vectors(rows.select("node", encode(F.col("text")).alias("vec"), F.lit(kind).alias("node_kind"), "lang"))


def _count(store: Store) -> None:
    n = lambda name: store.read(name).agg(F.count("*").alias("n")).select(F.lit(f"n_{name}").alias("key"), F.col("n").cast("string").alias("value"))
    rows = [n(x) for x in ("paragraphs", "sentences", "concepts", "concept_aliases", "entities", "paragraph_entities", "paragraph_concepts")]
    by = store.read("concept_edges").groupBy("relation").agg(F.count("*").alias("n"))
    rows.append(by.select(F.concat(F.lit("edges_"), "relation").alias("key"), F.col("n").cast("string").alias("value")))
    by = store.read("paragraphs").groupBy("lang").agg(F.count("*").alias("n"))
    rows.append(by.select(F.concat_ws("_", F.lit("paragraphs"), F.coalesce("lang", F.lit("-"))).alias("key"), F.col("n").cast("string").alias("value")))
    edges = store.read("concept_edges").agg(F.count("*").alias("n"))
    rows.append(edges.select(F.lit("n_concept_edges").alias("key"), F.col("n").cast("string").alias("value")))
    by = store.vectors().groupBy("node_kind", "lang").agg(F.count("*").alias("n"))
    rows.append(by.select(F.concat_ws("_", F.lit("vectors"), "node_kind", "lang").alias("key"), F.col("n").cast("string").alias("value")))
    have = store.read("paragraph_concepts").select("paragraph").distinct().agg(F.count("*").alias("have"))
    all_ = store.read("paragraphs").agg(F.count("*").alias("n"))
    share = have.join(F.broadcast(all_)).select(F.lit("coverage").alias("key"), F.round(F.col("have") / F.greatest("n", F.lit(1)), 6).cast("string").alias("value"))  # one row each
    rows.append(share)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    store.write("stats", out)
