"""JSON in noisy model output: balanced blocks, repair, and typed rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

#: The kinds that an extraction may name.
RELATIONS = ["discusses", "exemplifies", "contrasts"]
ENTITY_TYPES = ["person", "place", "text", "deity", "other"]
_SCHEMA = "concepts array<struct<label:string,surface:string,relation:string,weight:string>>, entities array<struct<label:string,type:string,surface:string>>, summary string"


def balanced_block(raw: str | None) -> str | None:
    """The first balanced object; braces within strings and escaped quotes do not count."""
    start = (raw or "").find("{")
    if start < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i, c in enumerate(raw[start:], start):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return raw[start : i + 1]
    return None


@F.pandas_udf(StringType())
def json_block(raw: pd.Series) -> pd.Series:
    return raw.map(balanced_block).astype(object)


def repaired(block: Column) -> Column:
    """The block if it is JSON, else without trailing commas."""
    return F.when(F.try_parse_json(block).isNotNull(), block).otherwise(F.regexp_replace(block, r",\s*([}\]])", "$1"))


def parsed_extraction(raw: Column) -> Column:
    """struct<concepts, entities, summary>: at most 8 of each, weights within 0 to 1, unknown kinds replaced; all empty where nothing parses."""
    data = F.from_json(repaired(json_block(raw)), _SCHEMA)
    empty = lambda kind: F.array().cast(kind)
    kinds = lambda x, known, other: F.when(F.lower(T.stripped(x)).isin(known), F.lower(T.stripped(x))).otherwise(other)
    concepts = F.transform(
        F.slice(data["concepts"], 1, 8),
        lambda c: F.struct(
            T.concept_label(c["label"]).alias("label"),
            F.substring(F.coalesce(c["surface"], F.lit("")), 1, 200).alias("surface"),
            kinds(c["relation"], RELATIONS, "discusses").alias("relation"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c["weight"].try_cast("double"), F.lit(1.0)))).alias("weight"),
        ),
    )
    entities = F.transform(F.slice(data["entities"], 1, 8), lambda e: F.struct(T.entity_label(e["label"]).alias("label"), kinds(e["type"], ENTITY_TYPES, "other").alias("type"), F.substring(F.coalesce(e["surface"], F.lit("")), 1, 200).alias("surface")))
    return F.struct(
        F.coalesce(F.filter(concepts, lambda c: c["label"] != ""), empty("array<struct<label:string,surface:string,relation:string,weight:double>>")).alias("concepts"),
        F.coalesce(F.filter(entities, lambda e: e["label"] != ""), empty("array<struct<label:string,type:string,surface:string>>")).alias("entities"),
        T.clipped_summary(T.stripped(F.coalesce(data["summary"], F.lit("")))).alias("summary"),
    )


def parsed_plan(raw: Column) -> Column:
    """struct<timeless_queries, concepts, bridge_note>, null where there is no object (the plan is then not ok)."""
    return F.from_json(repaired(json_block(raw)), "timeless_queries array<string>, concepts array<string>, bridge_note string")


#: Cues and concept label of the deterministic stand-in for an extraction model.
LEXICON = [
    (["concentrat", "attention", "gather", "একাগ্র", "মন"], "concentration"),
    (["renunc", "give up", "abandon", "ত্যাগ"], "renunciation"),
    (["attach", "desire", "wanting", "আসক্তি", "কামনা"], "non-attachment"),
    (["work", "labour", "duty", "কর্ম", "কর্তব্য"], "work-as-worship"),
    (["free", "liberat", "মুক্তি", "স্বাধীন"], "liberation"),
    (["self", "atman", "আত্মা"], "self-realization"),
    (["illusion", "appearance", "maya", "মায়া", "ভ্রম"], "maya"),
    (["devotion", "love", "ভক্তি", "প্রেম"], "devotion"),
    (["strong", "strength", "courage", "weak", "শক্তি", "দুর্বল"], "strength"),
    (["truth", "সত্য"], "truth"),
    (["patien", "ধৈর্য"], "patience"),
    (["fear", "ভয়"], "fear"),
]


def stub_extraction(text: Column, lexicon: list | None = None, most: int = 4) -> Column:
    """Concepts whose cues occur in the last 1,200 characters, as one expression. Not a language model."""
    tail = F.lower(F.when(F.length(text) > 1200, F.substring(text, -1200, 1200)).otherwise(text))
    rows = []
    for cues, label in lexicon or LEXICON:
        hits = sum((tail.contains(c).cast("int") for c in cues), F.lit(0))
        many = hits > 1
        rows.append(F.when(hits > 0, F.struct(F.lit(label).alias("label"), F.when(many, "discusses").otherwise("exemplifies").alias("relation"), F.when(many, 0.9).otherwise(0.6).alias("weight"))))
    return F.slice(F.filter(F.array(*rows), lambda x: x.isNotNull()), 1, most)
