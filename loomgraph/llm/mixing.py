"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words, and the mix as a whole is to keep the corpus's mean document length (the mean over words of the logarithm of their
document's size). Among all rates r >= 0 per word that meet the targets, the mix takes those closest to "every word once" in
relative entropy. The convex dual has one multiplier per source and one for the length, and its solution are exponentially tilted
document rates, exp(multiplier of the source + multiplier of the length * the document's standardised length), held at the cap. The length
couples documents of all sources, so the multipliers have no closed form. It is asked for with a quadratic penalty: the caps of sources can make
it unreachable. Newton steps on the dual sum gradient and curvature over the documents in Spark; the driver sees one row per source. Rates are
rounded into copies by diffusing the error through documents of falling size, in buckets of bounded size, so that a source's words end
near its target and reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, Scratch, batches, small


def water_filled(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of `total` by weight; what exceeds `cap` times a size goes to the others by weight, until none exceeds."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        per = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * per > cap * sizes[i]}
        for i in over or free:
            out[i] = float(cap * sizes[i]) if over else weights[i] * per
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


@dataclass(frozen=True)
class Dual:
    """A document of n words in source s has the rate min(cap, exp(of[s] + length * (ln(1 + n) - mean) / spread)); it is the cap in sources that are full."""

    of: dict
    full: frozenset
    length: float
    mean: float
    spread: float


def balanced(cells: DataFrame, words: dict, targets: dict, cap: float, steps: int = 100, tolerance: float = 1e-9, ridge: float = 0.1) -> Dual:
    """Solves the dual by Newton steps. cells: (source, size, n), the number of documents of each size; words, targets: by source.

    A step sums, for each source, its tilted words, their lengths and squares, and the dual's value. Sources whose target is the cap times
    their size have no freedom left and are full. A step is shortened to at most 1 in each multiplier and halved while the dual's value falls.
    """
    spark, top, all_words = cells.sparkSession, math.log(cap), float(sum(words.values()))
    full = frozenset(s for s in words if words[s] and targets[s] >= cap * words[s] * (1 - 1e-12))
    free = [s for s in words if words[s] and s not in full]
    weight, log = F.col("n") * F.col("size"), F.log1p("size")
    mean, square = cells.agg(F.sum(weight * log), F.sum(weight * log * log)).first() if all_words else (0.0, 0.0)
    mean = (mean or 0.0) / max(all_words, 1.0)
    spread = math.sqrt(max((square or 0.0) / max(all_words, 1.0) - mean * mean, 0.0)) or 1.0
    z = (log - mean) / spread

    def summed(of: dict, length: float) -> tuple[float, dict, float]:
        """The dual's value, (words, capped ones left out: words, lengths, squares) by source, and the lengths of all."""
        now = F.broadcast(spark.createDataFrame([(s, of.get(s, top + 1e6)) for s in words], "source string, multiplier double"))  # a row per source
        at = F.col("multiplier") + length * z
        at = cells.join(now, cells["source"].eqNullSafe(now["source"])).select(cells["source"], weight.alias("w"), z.alias("z"), at.alias("at"))
        at = at.withColumns({"r": F.least(F.exp(F.least("at", F.lit(top))), F.lit(float(cap))), "open": F.col("at") < top})
        r, inner = F.col("w") * F.col("r"), F.when(F.col("open"), F.col("w") * F.col("r")).otherwise(0.0)
        worth = F.col("w") * F.when(F.col("open"), F.col("r")).otherwise(cap * (1 + F.col("at") - top))
        rows = at.groupBy("source").agg(F.sum(r), F.sum(inner), F.sum(inner * F.col("z")), F.sum(inner * F.col("z") * F.col("z")), F.sum(r * F.col("z")), F.sum(worth)).collect()
        got = {x[0]: x[1:] for x in rows}
        value = sum(of[s] * targets[s] - got[s][5] for s in free) - ridge * all_words * length * length / 2
        value -= length * cap * sum(got[s][4] / cap for s in full)
        return value, got, sum(x[4] for x in got.values())

    of, length = dict.fromkeys(free, 0.0), 0.0
    value, got, lengths = summed(of, length)
    for _ in range(steps):
        off = {s: targets[s] - got[s][0] for s in free}
        off_length = -lengths - ridge * all_words * length
        if all(abs(x) <= tolerance * targets[s] for s, x in off.items()) and abs(off_length) <= tolerance * max(all_words, 1.0):
            return Dual(of, full, length, mean, spread)
        # a source whose words are all capped has no curvature; a little keeps the step one that rises
        curve = {s: max(got[s][1], 1e-3 * got[s][0], 1e-9 * words[s]) for s in free}
        rest = ridge * all_words + sum(got[s][3] - got[s][2] ** 2 / curve[s] for s in free)
        step = (off_length - sum(got[s][2] / curve[s] * off[s] for s in free)) / rest
        move = {s: (off[s] - got[s][2] * step) / curve[s] for s in free}
        # the step is shortened as a whole, as its direction is what raises the dual
        scale = 1 / max(1.0, abs(step), *map(abs, move.values()))
        while True:
            at, there = {s: of[s] + scale * move[s] for s in free}, length + scale * step
            after = summed(at, there)
            if after[0] >= value - 1e-11 * abs(value) or scale < 1e-9:
                break
            scale /= 2
        of, length, (value, got, lengths) = at, there, after
    raise RuntimeError("the dual did not settle")


def diffused(sizes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """0 or 1 for each size, in falling order, so that the chosen ones add up to about sum(parts * sizes); a part of zero is never chosen.

    What a choice leaves over goes to the next. At the end a choice, or an exchange of one for another, is changed as long as the rest shrinks.
    """
    owed, out = 0.0, np.zeros(len(sizes), np.int64)
    for i, (n, part) in enumerate(zip(sizes.tolist(), parts.tolist())):
        owed += part * n
        if part > 0 and 2 * owed >= n * (1 - 1e-6):  # so that sums in another order leave ties as they are
            owed -= n
            out[i] = 1
    while True:
        owed = round(owed, 6)
        one, two = np.flatnonzero((out == 1) & (parts > 0)), np.flatnonzero((out == 0) & (parts > 0))
        # taking i in adds its size, leaving it out takes the size away, an exchange does both
        choices = [((float(sizes[i]),), (int(i),)) for i in two[np.argsort(np.abs(owed - sizes[two]), kind="stable")[:1]]]
        choices += [((-float(sizes[i]),), (int(i),)) for i in one[np.argsort(np.abs(owed + sizes[one]), kind="stable")[:1]]]
        if len(one) and len(two):
            order = two[np.argsort(sizes[two], kind="stable")]
            at = np.searchsorted(sizes[order], sizes[one] + owed)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(order) - 1)):
                k = int(np.abs(owed - (sizes[order[near]] - sizes[one])).argmin())
                choices.append(((float(sizes[order[near[k]]]), -float(sizes[one[k]])), (int(order[near[k]]), int(one[k]))))
        change, flip = min(choices, key=lambda c: abs(owed - sum(c[0])), default=((0.0,), ()))
        if not flip or abs(owed - sum(change)) >= abs(owed) - 1e-9:
            return out
        owed -= sum(change)
        out[list(flip)] = 1 - out[list(flip)]


def _planned(docs: DataFrame, weights: Sequence[float], cap: float, id_col: str, text_col: str, source_col: str, bucket: int, max_sources: int) -> DataFrame:
    """id, _source, _text_hash, size, source_size, target, rate, taken, copies."""
    spark = docs.sparkSession
    batches(spark, 10_000)
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(text_col, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash"))
    rows = scratch.written(rows, "sizes")
    cells = scratch.written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    table = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs")).limit(max_sources + 1).collect()
    if len(table) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    table.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = {r["source"]: r["words"] for r in table}
    targets = dict(zip(words, water_filled(list(words.values()), [weights[i % len(weights)] for i in range(len(table))], sum(words.values()), cap)))
    dual = balanced(cells, words, targets, cap)
    plan = spark.createDataFrame(
        [(r["source"], i, r["words"], targets[r["source"]], None if r["source"] in dual.full else dual.of.get(r["source"], 0.0), -(-r["docs"] // bucket)) for i, r in enumerate(table)],
        "source string, nth int, source_size long, target double, multiplier double, buckets int",
    )
    plan = F.broadcast(plan)  # a row per source
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    tilted = F.exp(F.least(F.col("multiplier") + dual.length * (F.log1p("size") - dual.mean) / dual.spread, F.lit(math.log(cap))))
    dealt = dealt.withColumn("rate", F.coalesce(F.least(tilted, F.lit(float(cap))), F.lit(float(cap)))).drop("multiplier")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("id", "_text_hash"), F.col("buckets"))).drop("buckets")
    # rows alike in id and text fall in one bucket; where there are many, they are counted, made again and dealt by their number, whatever their order
    crowded = dealt.groupBy("nth", "bucket").agg(F.count("*").alias("held")).where(F.col("held") > 4 * bucket)
    crowded = scratch.written(crowded.select("nth", "bucket", F.ceil(F.col("held") / bucket).alias("parts")), "crowded")
    few = small(crowded, crowded.count(), 40)
    apart = dealt.join(few, ["nth", "bucket"]).groupBy(*dealt.columns, "parts").agg(F.count("*").alias("alike"))
    apart = apart.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike")))).withColumn("part", F.pmod(F.xxhash64("id", "_text_hash", "place"), F.col("parts")))
    dealt = dealt.join(few, ["nth", "bucket"], "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(apart.select(*dealt.columns, "part"))

    def rounded(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "id", "_text_hash"], ascending=[False, True, True], ignore_index=True)
        rate, sizes = g["rate"].to_numpy(), g["size"].to_numpy()
        base = np.floor(rate + 1e-9)
        copies = base.astype(np.int64) + diffused(sizes, np.maximum(0.0, rate - base))
        g["copies"], g["taken"], g["_source"] = copies, copies * sizes, g["source"]
        return g[["id", "_source", "_text_hash", "size", "source_size", "target", "rate", "taken", "copies"]]

    return dealt.groupBy("nth", "bucket", "part").applyInPandas(rounded, "id long, _source string, _text_hash long, size long, source_size long, target double, rate double, taken long, copies long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket: int = 1 << 12, max_sources: int = 100_000) -> DataFrame:
    """One row per document: id, size, source_size, target, rate, taken, copies.

    size: words of the text, null and empty texts have none and are never needed. Sources in order of code points, null
    last, get the weights in turn. A null source is a source like any other; repeated rows count each time, and those alike in all
    are interchangeable. An empty table gives no rows; further columns are ignored. The source table is bounded: over max_sources it raises.
    """
    plan = _planned(docs, weights, cap, id_col, text_col, source_col, bucket, max_sources)
    return plan.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "taken", "copies")


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket: int = 1 << 12, max_sources: int = 100_000) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mix takes them.

    Rows alike in id, text and source are interchangeable: one of them stands for all, as often as the mix takes them together. An
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    keys = ["k_id", "k_source", "k_hash"]
    plan = _planned(docs, weights, cap, id_col, text_col, source_col, bucket, max_sources)
    plan = plan.groupBy(F.col("id").alias("k_id"), F.col("_source").alias("k_source"), F.col("_text_hash").alias("k_hash")).agg(F.sum("copies").alias("copies"), F.count("*").alias("alike")).where("copies > 0")
    plan = scratch.written(plan, "copies")
    # the input's columns are held in one, so no name can clash
    own = F.struct(*[docs[c] for c in docs.columns]).alias("own")
    rows = docs.select(own, F.col(id_col).cast("long").alias("k_id"), F.col(source_col).cast("string").alias("k_source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k_hash"))

    def of(p: DataFrame) -> DataFrame:
        p = small(p.select(*[F.col(k).alias(f"p_{k}") for k in keys], "copies"), p.count(), 64)
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in keys])
        return rows.join(p, on).select("own", *keys, "copies")

    once = of(plan.where("alike = 1")).select("own", "copies")
    many = of(plan.where("alike > 1")).groupBy(*keys).agg(F.first("own").alias("own"), F.first("copies").alias("copies")).select("own", "copies")
    taken = once.unionByName(many).select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
    return taken.select("own.*")
