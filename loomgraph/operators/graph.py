"""Concept-graph operators over edge tables: counts, co-occurrence, coverage, subgraphs, merges, components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_root, written


def upsert_max(edges: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """One row per key with the largest weight: what repeated inserts that keep the maximum leave."""
    return edges.groupBy(*keys).agg(F.max(weight).alias(weight))


def insert_ignore(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_last(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def coalesce_update(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Sets a value where a new one is given."""
    return old.join(new.select(key, F.col(value).alias("_new")), key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def mention_recount(dim: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Edge rows per node, zero where there is none."""
    return dim.select(key).join(edges.groupBy(key).agg(F.count("*").alias("n_mentions")), key, "left").select(key, F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"))


def pair_counts(pc: DataFrame) -> DataFrame:
    """(a, b, n): paragraphs that hold both, a < b. Pairs come from the concepts of one paragraph, one row at a time, and are counted before the shuffle."""
    d = pc.select("paragraph", "concept").distinct()
    lists = d.groupBy("paragraph").agg(F.array_sort(F.collect_list("concept")).alias("c"))
    first = lists.select("c", F.posexplode("c").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("c", F.col("i") + 2, F.greatest(F.size("c") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def cooccurrence_edges(pc: DataFrame, min_count: int = 2) -> DataFrame:
    """Both directions, weight log(1 + n) over its maximum among all pairs, taken before the minimum count applies. The counts are written once."""
    counts = written(pair_counts(pc), "pair-counts")
    top = counts.agg(F.max(F.log1p("n")).alias("top"))
    kept = counts.where(F.col("n") >= min_count).crossJoin(F.broadcast(top)).select("a", "b", "n", (F.log1p("n") / F.col("top")).alias("weight"))
    return kept.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n", "weight").unionByName(kept.select(F.col("b").alias("src"), F.col("a").alias("dst"), "n", "weight"))


def cooccurring(pc: DataFrame, selected: list, min_shared: int = 1, within: DataFrame | None = None) -> DataFrame:
    """(concept, shared): concepts outside the selection, with the most paragraphs shared with one of it."""
    s = pc.where(F.col("concept").isin(selected)).select("paragraph", F.col("concept").alias("chosen")).distinct()
    o = pc.where(~F.col("concept").isin(selected)).select("paragraph", "concept").distinct()
    o = o.join(within, "concept", "left_semi") if within is not None else o
    n = o.join(s, "paragraph").groupBy("concept", "chosen").agg(F.count("*").alias("n"))
    return n.groupBy("concept").agg(F.max("n").alias("shared")).where(F.col("shared") >= min_shared)


def of_languages(rows: DataFrame, paragraphs: DataFrame | None, langs: list[str] | None) -> DataFrame:
    """Rows of paragraphs in the given languages, all where none are given. paragraphs: paragraph, lang, which prunes by language if it is so partitioned."""
    if paragraphs is None or langs is None:
        return rows
    return rows.join(paragraphs.where(F.col("lang").isin(list(langs))).select("paragraph"), "paragraph", "left_semi")


def coverage(pc: DataFrame, selected: list, k: int, require_all: bool = False, paragraphs: DataFrame | None = None, langs: list[str] | None = None) -> DataFrame:
    """(paragraph, n_concepts, total, concepts): paragraphs by the number of chosen concepts, then summed weight, then id, of the given languages."""
    wanted = sorted(set(selected))
    got = of_languages(pc.where(F.col("concept").isin(wanted)), paragraphs, langs)
    got = got.groupBy("paragraph").agg(F.count_distinct("concept").alias("n_concepts"), F.sum("weight").alias("total"), F.array_sort(F.collect_set("concept")).alias("concepts"))
    got = got.where(F.col("n_concepts") == len(wanted)) if require_all else got
    return got.orderBy(F.desc("n_concepts"), F.desc(F.round("total", 9)), "paragraph").limit(k)


def examples(pc: DataFrame, concepts: DataFrame, metadata: DataFrame, selected: list, k: int = 5, require_all: bool = False, langs: list[str] | None = None) -> DataFrame:
    """The paragraphs of `coverage` with their metadata and the sorted labels of the chosen concepts that they hold. concepts: concept, label; metadata: paragraph, lang, ..."""
    top = coverage(pc, selected, k, require_all, metadata, langs)
    named = top.select("paragraph", F.explode("concepts").alias("concept")).join(concepts.select("concept", "label"), "concept")
    labels = named.groupBy("paragraph").agg(F.array_sort(F.collect_list("label")).alias("matched_concepts"))
    return top.select("paragraph", "n_concepts", "total").join(labels, "paragraph", "left").join(metadata, "paragraph")


def neighbors(edges: DataFrame, anchors: DataFrame, k: int, min_weight: float = 0.0, relations: list[str] | None = None) -> DataFrame:
    """The k strongest edges of each anchor; anchors: src."""
    e = edges.where(F.col("weight") >= min_weight)
    e = e.where(F.col("relation").isin(relations)) if relations else e
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst", *(["relation"] if "relation" in edges.columns else []))
    return e.join(anchors.select("src").distinct(), "src", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def paragraphs_for(pc: DataFrame, concepts: DataFrame, k: int, paragraphs: DataFrame | None = None, langs: list[str] | None = None, by_lang: bool = False) -> DataFrame:
    """The k paragraphs of each concept with the largest weight, of the given languages; by_lang: k of each language, with a column lang."""
    own = pc.join(concepts.select("concept").distinct(), "concept", "left_semi")
    own = own.join(paragraphs.select("paragraph", "lang"), "paragraph") if by_lang else of_languages(own, paragraphs, langs)
    own = own.where(F.col("lang").isin(list(langs))) if by_lang and langs is not None else own
    w = Window.partitionBy("concept", *(["lang"] if by_lang else [])).orderBy(F.desc("weight"), "paragraph")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, without loops."""
    e = edges.where("src <> dst").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """One row per pair of ends and relation, with the largest weight."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation").agg(F.max("weight").alias("weight"))


def folded(edges: DataFrame) -> DataFrame:
    """One row per pair of ends, weights of all relations summed."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def minmax_per_relation(edges: DataFrame) -> DataFrame:
    span = edges.groupBy("relation").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.round((F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo")), 4)).otherwise(1.0)
    return edges.join(F.broadcast(span), "relation").withColumn("weight", scaled).drop("lo", "hi")  # a row per relation


def remapped(edges: DataFrame, mapping: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Edges of absorbed nodes move to their survivors, the largest weight stays. mapping: member, survivor."""
    m = mapping.select(F.col("member").alias(key), "survivor")
    moved = edges.join(m, key, "left").withColumn(key, F.coalesce("survivor", key)).drop("survivor")
    return upsert_max(moved, keys)


def components(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) by hooking to the least neighbour and jumping; a reliable checkpoint cuts the lineage each round. pairs: a, b."""
    spark = pairs.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:  # the cluster's shared folder, or our own where none is named
        spark.sparkContext.setCheckpointDir(f"{shared_root(spark)}/components")
    links = pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct().checkpoint()
    for _ in range(max_rounds):
        least = links.groupBy("hi").agg(F.min("lo").alias("root"))
        hooked = links.join(least, "hi")
        hooked = hooked.select("hi", F.col("root").alias("lo")).unionByName(hooked.where("lo <> root").select(F.col("lo").alias("hi"), F.col("root").alias("lo")))
        above = least.select(F.col("hi").alias("lo"), F.col("root").alias("above"))
        after = hooked.join(above, "lo", "left").select("hi", F.coalesce("above", "lo").alias("lo")).distinct().checkpoint()
        if not after.exceptAll(links).limit(1).count() and not links.exceptAll(after).limit(1).count():
            roots = after.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
        links = after
    raise RuntimeError("components did not settle")


def smoothed(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean of a node's own value and its neighbours' mean, per dimension: untrained message passing. features: id, d, x; edges: src, dst."""
    near = edges.join(features.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "d").agg(F.avg("x").alias("near"))
    return features.join(near, ["id", "d"], "left").select("id", "d", ((F.col("x") + F.coalesce("near", "x")) / 2).alias("x"))


def communities_of(nodes: list, edges: dict[tuple, float]) -> list[set]:
    """Greedy modularity: the pair of groups whose union gains most is joined, until none gains. For interactive graphs of some hundred nodes."""
    total = sum(edges.values())
    groups, degree, between = {n: {n} for n in nodes}, dict.fromkeys(nodes, 0.0), {}
    for (a, b), w in edges.items():
        degree[a] += w
        degree[b] += w
        between.setdefault(a, {})[b] = between.setdefault(b, {})[a] = w
    while total:
        gain, a, b = max(((w / total - degree[x] * degree[y] / (2 * total * total), -x, -y) for x, near in between.items() for y, w in near.items() if x < y), default=(0, 0, 0))
        if gain <= 1e-12:
            break
        a, b = -a, -b
        groups[a] |= groups.pop(b)
        degree[a] += degree.pop(b)
        for c, w in between.pop(b).items():
            del between[c][b]
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0.0) + w
    return sorted(groups.values(), key=lambda g: (-len(g), min(g)))


def _one_graph(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Nodes and folded edges as one group for a Python step; refuses graphs over `most` nodes."""
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"this operator is for graphs of at most {most} nodes")
    n = nodes.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.coalesce(F.col("n_mentions"), F.lit(0)).cast("double").alias("weight"), "label")
    return n.unionByName(folded(induced(edges, nodes)).select("a", "b", F.col("weight").cast("double"), F.lit(None).cast("string").alias("label"))).withColumn("g", F.lit(0))


def communities(nodes: DataFrame, edges: DataFrame, max_groups: int = 10, max_nodes: int = 600) -> DataFrame:
    """(id, cluster, cluster_label): the largest groups are numbered, others are -1; a group is labelled by its most mentioned node."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = g[g["b"].isna()]
        mentions, label = dict(zip(own["a"], own["weight"])), dict(zip(own["a"], own["label"]))
        links = g[~g["b"].isna()]
        found = communities_of(sorted(mentions), {(int(a), int(b)): w for a, b, w in zip(links["a"], links["b"], links["weight"])})
        rows = [(n, i if i < max_groups else -1, label[max(sorted(c), key=lambda x: mentions[x])] if i < max_groups else "other") for i, c in enumerate(found) for n in sorted(c)]
        return pd.DataFrame(rows, columns=["id", "cluster", "cluster_label"])

    return _one_graph(nodes, edges, max_nodes).groupBy("g").applyInPandas(run, "id long, cluster int, cluster_label string")


def layout(nodes: DataFrame, edges: DataFrame, seed: int = 7, scale: float = 520.0, steps: int = 50, max_nodes: int = 600) -> DataFrame:
    """(id, x, y): seeded force-directed positions."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(g.loc[g["b"].isna(), "a"].to_numpy())
        at = {n: i for i, n in enumerate(ids)}
        n, a = len(ids), np.zeros((len(ids), len(ids)))
        for x, y, w in g.loc[~g["b"].isna(), ["a", "b", "weight"]].itertuples(index=False):
            a[at[x], at[int(y)]] = a[at[int(y)], at[x]] = w
        p, k = np.random.default_rng(seed).random((n, 2)), 1.6 / math.sqrt(n)
        for heat in np.linspace(0.1, 0.002, steps):
            gap = p[:, None] - p[None]
            far = np.maximum(np.hypot(gap[..., 0], gap[..., 1]), 0.01)
            move = (gap * (k * k / far**2 - a * far / k)[..., None]).sum(axis=1)
            p = p + move * (heat / np.maximum(np.hypot(move[:, 0], move[:, 1]), 0.01))[:, None]
        p = (p - p.mean(axis=0)) / max(np.abs(p - p.mean(axis=0)).max(), 1e-9) * scale
        return pd.DataFrame({"id": ids, "x": p[:, 0], "y": p[:, 1]})

    return _one_graph(nodes, edges, max_nodes).groupBy("g").applyInPandas(run, "id long, x double, y double")


def separated(nodes: DataFrame, pad: float = 6.0, steps: int = 150, max_nodes: int = 600) -> DataFrame:
    """(id, x, y): discs that overlap are pushed apart, half the overlap each, until none does or the steps are spent; 40 steps over 300 nodes.

    nodes: id, x, y, size (a diameter). For drawn graphs of at most max_nodes nodes.
    """
    if nodes.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"a drawn graph has at most {max_nodes} nodes")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", ignore_index=True)
        p, r = g[["x", "y"]].to_numpy(float), g["size"].to_numpy(float) / 2
        least = r[:, None] + r[None] + pad
        angle = 2.399963 * np.arange(len(p))  # where two lie on one spot, a direction of their own
        for _ in range(min(steps, 40) if len(p) > 300 else steps):
            gap = p[:, None] - p[None]
            far = np.hypot(gap[..., 0], gap[..., 1])
            over = np.where(far < least, least - far, 0.0)
            np.fill_diagonal(over, 0.0)
            if over.max(initial=0) < 1e-6:
                break
            way = np.where(far[..., None] > 1e-9, gap / np.maximum(far, 1e-9)[..., None], np.stack([np.cos(angle), np.sin(angle)], axis=1)[:, None] * np.sign(np.arange(len(p))[:, None] - np.arange(len(p))[None])[..., None])
            p = p + (way * over[..., None] / 2).sum(axis=1) / np.maximum((over > 0).sum(axis=1), 1)[:, None]
        return pd.DataFrame({"id": g["id"], "x": p[:, 0], "y": p[:, 1]})

    return nodes.select("id", "x", "y", "size", F.lit(0).alias("g")).groupBy("g").applyInPandas(run, "id long, x double, y double")


def concept_graph(concepts: DataFrame, aliases: DataFrame, edges: DataFrame, n: int = 250, relations: tuple[str, ...] = ("similar", "co-occurs"), langs: tuple[str, ...] = ("en", "bn")) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, n_mentions, aliases_<lang>...) of the n most mentioned concepts, and the edges (a, b, relation, weight) among them.

    concepts: concept, label, n_mentions; aliases: id, concept, lang, alias, of which a node shows three of each language. Edges are undirected, the strongest of
    each relation and pair, their weights scaled to 0 to 1 within each relation.
    """
    top = concepts.orderBy(F.desc("n_mentions"), "concept").limit(n).select(F.col("concept").alias("id"), "label", "n_mentions")
    own = aliases.join(top.select(F.col("id").alias("concept")), "concept", "left_semi")
    own = own.groupBy("concept", "lang", "alias").agg(F.min("id").alias("id"))
    w = Window.partitionBy("concept", "lang").orderBy("id", "alias")
    own = own.withColumn("_n", F.row_number().over(w)).where("_n <= 3")
    none = F.array().cast("array<string>")
    of = lambda lang: F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("lang") == lang, F.struct("_n", "alias"))), lambda x: x.isNotNull())), lambda x: x["alias"]).alias(f"aliases_{lang}")
    lists = own.groupBy(F.col("concept").alias("id")).agg(*[of(x) for x in langs])
    nodes = top.join(lists, "id", "left").select("id", "label", "n_mentions", *[F.coalesce(f"aliases_{x}", none).alias(f"aliases_{x}") for x in langs])
    return nodes, minmax_per_relation(undirected(induced(edges.where(F.col("relation").isin(list(relations))), top)))


def graph_spec(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, positions: DataFrame | None = None, max_mentions: int | None = None, selected: list | None = None, cooccurring: DataFrame | None = None, max_nodes: int = 600) -> DataFrame:
    """One row: a JSON document of nodes with sizes, edges, and groups in order of their size. Refuses graphs over `max_nodes` nodes.

    selected: ids that are marked, and with them the edges that touch one. cooccurring: (concept, shared) of concepts that share paragraphs with
    the selection; a node shows how many.
    """
    if nodes.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"a drawn graph has at most {max_nodes} nodes")
    chosen = F.array(*[F.lit(x).cast("long") for x in selected or []]).cast("array<bigint>")
    most = nodes.agg(F.greatest(F.coalesce(F.lit(max_mentions).cast("double"), F.max("n_mentions").cast("double"), F.lit(1.0)), F.lit(1.0)).alias("top"))
    n = nodes.join(clusters, "id").join(positions, "id", "left") if positions is not None else nodes.join(clusters, "id").withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    n = n.join(cooccurring.select(F.col("concept").alias("id"), "shared"), "id", "left") if cooccurring is not None else n.withColumn("shared", F.lit(None).cast("long"))
    n = n.crossJoin(F.broadcast(most)).withColumns({"size": F.round(10 + 34 * F.sqrt(F.least("n_mentions", "top") / F.col("top")), 1), "selected": F.array_contains(chosen, F.col("id").cast("long")), "shared": F.coalesce("shared", F.lit(0))})
    shown = ["id", "label", "size", "n_mentions", "cluster", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), "selected", "shared"]
    node_list = n.agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("nodes"))
    touched = (F.array_contains(chosen, F.col("a").cast("long")) | F.array_contains(chosen, F.col("b").cast("long"))).alias("selected")
    e = edges.select(F.concat_ws("_", "a", "b", "relation").alias("id"), F.col("a").alias("source"), F.col("b").alias("target"), "relation", "weight", touched)
    edge_list = e.agg(F.array_sort(F.collect_list(F.struct(*e.columns))).alias("edges"))
    g = n.groupBy("cluster", "cluster_label").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct((-F.col("n_mentions")).alias("o"), "id", "label"))).alias("items"))
    group_list = g.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "cluster", "cluster_label", F.transform("items", lambda x: x["id"]).alias("items")))).alias("groups"))
    return node_list.crossJoin(edge_list).crossJoin(group_list).select(F.to_json(F.struct("nodes", "edges", "groups")).alias("spec"))
