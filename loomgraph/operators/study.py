"""Concept look-ups, whole merges, chapter lists, and the summaries of the evaluation studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from . import graph as G


def labelled(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """Adds the label of each concept. hits: concept; concepts: concept, label."""
    return hits.join(concepts.select("concept", "label"), "concept")


def matching(concepts: DataFrame, part: str) -> DataFrame:
    """Concepts whose label holds a text, whatever the case."""
    return concepts.where(F.lower("label").contains(part.lower()))


def first_aliases(aliases: DataFrame, n: int = 3) -> DataFrame:
    """(concept, lang, aliases): the n aliases with the smallest id of each concept and language. aliases: id, concept, lang, alias."""
    w = Window.partitionBy("concept", "lang").orderBy("id", "alias")
    kept = aliases.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return kept.groupBy("concept", "lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "alias"))), lambda x: x["alias"]).alias("aliases"))


def neighborhood(edges: DataFrame, pc: DataFrame, paragraphs: DataFrame, concept: int, k: int = 12, per_lang: int = 5) -> tuple[DataFrame, DataFrame]:
    """The k strongest edges of a concept, all relations together, and its best paragraphs of each language.

    pc: paragraph, concept, weight; paragraphs: paragraph, lang. A paragraph with several relations counts by its largest weight.
    """
    near = G.neighbors(edges, edges.where(F.col("src") == concept).select("src").limit(1), k)
    own = pc.where(F.col("concept") == concept).groupBy("paragraph").agg(F.max("weight").alias("weight")).join(paragraphs, "paragraph")
    w = Window.partitionBy("lang").orderBy(F.desc("weight"), "paragraph")
    return near, own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_lang)


def merged(concepts: DataFrame, aliases: DataFrame, pc: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Concepts, aliases, paragraph edges and concept edges after absorbed concepts went into their survivors.

    mapping: member, survivor. Edges keep the largest weight; loops that arise go; aliases move, and an absorbed label becomes an
    English alias of the survivor; mentions are counted anew. concepts: concept, label; aliases: concept, lang, alias.
    """
    m = mapping.where("member <> survivor").select("member", "survivor")
    gone = concepts.join(m, F.col("concept") == F.col("member")).select(F.col("survivor").alias("concept"), F.lit("en").alias("lang"), F.col("label").alias("alias"))
    moved = aliases.select("concept", "lang", "alias").join(m, F.col("concept") == F.col("member"), "left")
    moved = moved.select(F.coalesce("survivor", "concept").alias("concept"), "lang", "alias").unionByName(gone).distinct()
    new_pc = G.remapped(pc, m, "concept", ["paragraph", "concept", "relation"])
    keys = ["src", "dst", "relation"]
    new_edges = G.remapped(G.remapped(edges, m, "src", keys), m, "dst", keys).where("src <> dst")
    left = concepts.join(m, F.col("concept") == F.col("member"), "left_anti").select("concept", "label")
    counted = left.join(G.mention_recount(left, new_pc, "concept"), "concept")
    return counted, moved, new_pc, new_edges


def chapter_notes(paragraphs: DataFrame, done: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(chapter, notes): summaries joined by `||` in order, of chapters with `least` of them or more that are not in `done`. paragraphs: chapter, paragraph_idx, summary."""
    p = paragraphs.where("summary IS NOT NULL")
    p = p.join(done.select("chapter").distinct(), "chapter", "left_anti") if done is not None else p
    lists = F.transform(F.array_sort(F.collect_list(F.struct("paragraph_idx", "summary"))), lambda x: x["summary"])
    return p.groupBy("chapter").agg(F.count("*").alias("_n"), F.array_join(lists, "||").alias("notes")).where(F.col("_n") >= least).drop("_n")


def members(rows: DataFrame, key: str, item: str, least: int = 2) -> DataFrame:
    """(key, items): the items of each group with `least` of them or more, in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items")).where(F.size("items") >= least)


def sampled(rows: DataFrame, key: str, n: int, seed: int = 13) -> DataFrame:
    """n rows in a repeatable shuffled order; a bounded heap per task, no full sort."""
    return rows.orderBy(stats.sample_ids(seed, F.col(key)), key).limit(n)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item, a, b) of two raters' judgments; raises where one judged an item that the other did not. a, b: item, judgment."""
    both = a.select("item", F.col("judgment").alias("a")).join(b.select("item", F.col("judgment").alias("b")), "item", "full")
    alone = both.where("a IS NULL OR b IS NULL").limit(1).count()
    if alone:
        raise ValueError("the raters did not judge the same items")
    return both


def integrity(answers: DataFrame) -> DataFrame:
    """One row: means over questions, nulls left out. answers: answer, n_sources, cross_share (double or null), ok (boolean).

    A question without an answer (null) counts for the plan's fallback rate alone. Citations that name no source are invalid; a
    rate of nothing is null.
    """
    cited = T.citations(F.col("answer"))
    a = answers.withColumns({"_c": F.size(cited), "_bad": F.size(F.filter(cited, lambda n: ~n.between(1, F.col("n_sources")))), "_s": T.sentence_count(F.col("answer"))})
    told = lambda c: F.when(F.col("answer").isNotNull(), c)
    return a.agg(
        F.count("*").alias("n"),
        F.count("answer").alias("n_answered"),
        F.avg((~F.col("ok")).cast("double")).alias("fallback_rate"),
        F.avg(told(F.col("_c") / F.col("_s"))).alias("citations_per_sentence"),
        F.coalesce(F.sum(told(F.col("_c"))), F.lit(0)).alias("citations"),
        F.try_divide(F.sum(told(F.col("_bad"))), F.sum(told(F.col("_c")))).alias("invalid_rate"),
        F.avg("cross_share").alias("cross_share"),
    )


#: The columns of a paragraph's metadata.
METADATA = ["text", "summary", "paragraph_idx", "char_offset", "para_id_html", "chapter_id", "chapter_title", "section", "chapter_id_html", "volume_title", "volume_num", "lang", "book_title"]


def metadata(dim: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(paragraph_id, text, ..., book_title) of the given paragraphs. dim: the hierarchy joined once, by paragraph; paragraphs: paragraph."""
    return dim.join(paragraphs.select("paragraph").distinct(), "paragraph", "left_semi").select(F.col("paragraph").alias("paragraph_id"), *METADATA)


def concept(concepts: DataFrame, which: int) -> DataFrame:
    """The row of one concept; none if there is no such concept."""
    return concepts.where(F.col("concept") == which)


def concepts_of(pc: DataFrame, concepts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(paragraph, concept, label, relation, weight, rank): the concepts of the given paragraphs, the heaviest first."""
    own = pc.join(paragraphs.select("paragraph").distinct(), "paragraph", "left_semi").join(concepts.select("concept", "label"), "concept")
    w = Window.partitionBy("paragraph").orderBy(F.desc("weight"), "concept", "relation")
    return own.select("paragraph", "concept", "label", "relation", "weight", F.row_number().over(w).alias("rank"))


def selection(shown: DataFrame, removed: DataFrame, added: DataFrame, known: DataFrame) -> DataFrame:
    """The shown rows without the removed, with the added, as far as they are known; each once. All have the same columns."""
    return shown.exceptAll(removed).union(added).distinct().intersect(known)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how two raters agree, with the exact tests. a, b: item, judgment (0 or 1), over the same items."""
    one = lambda x: F.sum(F.when(x, 1).otherwise(0))
    x, y = F.col("a"), F.col("b")
    r = paired(a, b).agg(F.count("*").alias("n"), F.avg((x == y).cast("int")).alias("po"), F.avg(x).alias("precision_a"), F.avg(y).alias("precision_b"), F.avg(x * y).alias("consensus"), F.avg(F.greatest(x, y)).alias("either"), one((x == 1) & (y == 0)).alias("only_a"), one((x == 0) & (y == 1)).alias("only_b"))
    po, pa, pb = F.col("po"), F.col("precision_a"), F.col("precision_b")
    return r.select("n", "precision_a", "precision_b", "consensus", "either", F.col("po").alias("agreement"), stats.kappa(po, pa, pb).alias("kappa"), stats.ac1(po, pa, pb).alias("ac1"), "only_a", "only_b", stats.mcnemar_exact("only_a", "only_b").alias("p_mcnemar"))


def breakdown(judged: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, value, n, yes, lo, hi, p): the consensus by the values of each kind, with its interval and, for kinds of two values, Fisher's test. judged: a, b and the kinds."""
    both = judged.withColumn("_yes", (F.col("a") * F.col("b")).cast("long"))
    out = None
    for kind in kinds:
        g = both.groupBy(F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("value")).agg(F.count("*").alias("n"), F.sum("_yes").alias("yes"))
        of = F.array_sort(F.collect_list(F.struct("value", "n", "yes")))
        rows = g.groupBy("kind").agg(of.alias("v"))
        at = lambda i, c: F.get(F.col("v"), F.lit(i))[c]
        cells = [at(0, "yes"), at(0, "n") - at(0, "yes"), at(1, "yes"), at(1, "n") - at(1, "yes")]
        rows = rows.withColumns({f"_{i}": F.when(F.size("v") == 2, c).otherwise(F.lit(0)) for i, c in enumerate(cells)})
        rows = rows.withColumn("p", F.when(F.size("v") == 2, stats.fisher_exact("_0", "_1", "_2", "_3"))).select("kind", "p", F.inline("v"))
        lo, hi = stats.wilson(F.col("yes"), F.col("n"))
        rows = rows.select("kind", "value", "n", "yes", lo.alias("lo"), hi.alias("hi"), "p")
        out = rows if out is None else out.unionByName(rows)
    return out
