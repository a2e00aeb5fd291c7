"""Incremental maintenance: work left to do, snapshots by normalised text, restore, step state, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["text_norm", "lang", "extractor_tag"]


def todo(paragraphs: DataFrame, done: DataFrame) -> DataFrame:
    """Paragraphs without a summary that no edge names. done: paragraph."""
    return paragraphs.where("summary IS NULL").join(done.select("paragraph").distinct(), "paragraph", "left_anti")


def snapshot(paragraphs: DataFrame, pc: DataFrame, tag: str, concepts: DataFrame, pe: DataFrame | None = None, entities: DataFrame | None = None, tried: bool = False) -> DataFrame:
    """One row per key, the latest paragraph's: its summary, concepts and entities as JSON, by label, as ids change with a new parse.

    paragraphs: paragraph, text_norm, lang, summary; pc: paragraph, concept, relation, weight; concepts: concept, label; pe: paragraph, entity; entities: entity, label,
    type. Paragraphs with a summary, a concept or an entity take part, but not those with an empty text. An empty summary counts only with `tried`: it then
    tells that nothing was found.
    """
    named = pc.join(concepts.select("concept", "label"), "concept")
    lists = named.groupBy("paragraph").agg(F.to_json(F.array_sort(F.collect_list(F.struct("label", "relation", "weight")))).alias("concepts_json"))
    p = paragraphs.join(lists, "paragraph", "left")
    if pe is not None and entities is not None:
        named = pe.join(entities.select("entity", "label", "type"), "entity")
        lists = named.groupBy("paragraph").agg(F.to_json(F.array_sort(F.collect_list(F.struct("label", "type")))).alias("entities_json"))
        p = p.join(lists, "paragraph", "left")
    else:
        p = p.withColumn("entities_json", F.lit(None).cast("string"))
    p = p.where("length(text_norm) > 0 AND (" + ("summary IS NOT NULL" if tried else "length(summary) > 0") + " OR concepts_json IS NOT NULL OR entities_json IS NOT NULL)")
    blank = lambda c: F.coalesce(c, F.lit("[]")).alias(c)
    row = F.max(F.struct("paragraph", "summary", blank("concepts_json"), blank("entities_json"))).alias("r")
    return p.groupBy("text_norm", "lang").agg(row).select("text_norm", "lang", F.lit(tag).alias("extractor_tag"), "r.summary", "r.concepts_json", "r.entities_json")


def alias_snapshot(aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """(label, lang, alias): every alias by its concept's label. aliases: concept, lang, alias; concepts: concept, label."""
    return aliases.join(concepts.select("concept", "label"), "concept").select("label", "lang", "alias").distinct()


def restored(paragraphs: DataFrame, snap: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """(paragraph, summary, concepts_json, entities_json) of paragraphs that the snapshot knows, and the paragraphs that it does not."""
    s = snap.where(F.col("extractor_tag") == tag).select("text_norm", "lang", F.col("summary").alias("s_summary"), "concepts_json", "entities_json")
    hit = paragraphs.join(s, ["text_norm", "lang"]).select("paragraph", F.col("s_summary").alias("summary"), "concepts_json", "entities_json")
    return hit, paragraphs.join(s, ["text_norm", "lang"], "left_anti")


def restored_edges(hits: DataFrame) -> DataFrame:
    """(paragraph, label, relation, weight): the restored concepts, the largest weight of each."""
    c = F.explode(F.from_json("concepts_json", "array<struct<label:string,relation:string,weight:double>>")).alias("c")
    found = hits.select("paragraph", c).select("paragraph", "c.label", F.coalesce("c.relation", F.lit("discusses")).alias("relation"), F.coalesce("c.weight", F.lit(1.0)).alias("weight"))
    return found.groupBy("paragraph", "label", "relation").agg(F.max("weight").alias("weight"))


def restored_entities(hits: DataFrame) -> DataFrame:
    """(paragraph, label, type): the restored entities, the last type of each in a paragraph."""
    e = F.explode(F.from_json("entities_json", "array<struct<label:string,type:string>>")).alias("e")
    found = hits.select("paragraph", e).select("paragraph", "e.label", F.coalesce(F.nullif("e.type", F.lit("")), F.lit("other")).alias("type"))
    return found.groupBy("paragraph", "label").agg(F.max("type").alias("type"))


def restored_aliases(snapshot_: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, lang, alias) of the snapshot's aliases whose concept exists again. concepts: concept, label."""
    return snapshot_.join(concepts.select("label", "concept"), "label").select("concept", "lang", "alias").distinct()


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert-or-replace: the last row of each key."""
    last = rows.groupBy(*keys).agg(F.max(F.struct(seq, F.struct(*rows.columns).alias("row"))).alias("m"))
    return last.select("m.row.*")


def dangling(edges: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Edges whose end is in no dimension row: the check that a foreign key would be."""
    return edges.join(dim.select(F.col(dim_key).alias(key)), key, "left_anti")
