"""Exact dedup over an extendible-hash index on shared files, with DataFrame functions only.

1. Every row gets the 64-bit hash of its normalised text and the SHA-256 of it; this slim table is written once, so the
   texts are read once more only for rows whose hash is not alone.
2. Entries, one per hash with its row count, are pre-aggregated before the shuffle: a group of copies that holds a third
   of all rows is one entry per map task.
3. The directory maps hash prefixes to buckets. It starts as one bucket; a bucket with more than `capacity` entries splits,
   and when a split bucket was as deep as the directory, the directory doubles. As all splits of a level are independent,
   the levels are computed from one histogram of prefixes, which is refined while its own cells are overfull.
4. An owner task holds a contiguous range of buckets, and of keys within them. Texts of repeated hashes are compared by their bytes (grouped by the
   text itself, so copies that one task reads leave it as one row), addressed through the directory to their bucket, and chained there: the texts of
   one key, in order of their smallest id, are the links of its chain. The entry of each text with its bucket, key, link, kept id and size
   is the index on shared files, sorted by bucket and key.
5. Every row is addressed through the directory too and probes its bucket of the index, which gives its kept id. A row that finds no entry is
   an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WS, Scratch, looked_up, small

KEY = "_dedup_key"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def _prefix(key: Column, depth: int) -> Column:
    """The top `depth` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, n: int, capacity: int, key: str = KEY) -> tuple[DataFrame, int]:
    """(cell, bucket, local_depth) for every cell of the directory that has entries, and the global depth.

    entries: one row per key; n: their number. A bucket is the shortest prefix that holds at most `capacity` keys, named by its first cell.
    The table has about 4n / capacity rows and stays distributed.
    """
    depth = 0
    while (capacity << depth) < n:
        depth += 1
    depth = min(depth + bool(depth), 40)
    while True:
        cells = entries.groupBy(_prefix(F.col(key), depth).alias("cell")).agg(F.count("*").alias("n"))
        # a cell deeper than the directory would be overfull: double again
        if depth >= 40 or not cells.where(F.col("n") > capacity).limit(1).count():
            break
        depth += 1
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
    fits = levels.groupBy("d", "prefix").agg(F.sum("n").alias("held")).where(f"held <= {capacity} OR d = {depth}")
    own = levels.join(fits, ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("local_depth"))
    first = f"shiftleft(shiftright(cell, {depth} - local_depth), {depth} - local_depth)"
    return own.select("cell", F.expr(first).alias("bucket"), "local_depth"), depth


class HashIndex:
    """The written index of one input.

    rows: (id, key, sha) per input row. repeated: the keys with several rows. entries: (bucket, local_depth, key, link, sha, keep_id, group_size) per
    distinct text, on shared files, range-partitioned and sorted by bucket and key.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 12):
        spark = docs.sparkSession
        self.scratch = Scratch(spark, "exact-dedup")
        texts = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
        sha = F.unhex(F.sha2("_norm", 256)).alias("_dedup_sha")
        self.rows = self.scratch.written(texts.select("_id", F.xxhash64("_norm").alias(KEY), sha), "rows")
        keys = self.rows.groupBy(KEY).agg(F.count("*").alias("group_size"), F.min("_id").alias("keep_id"), F.first("_dedup_sha").alias("_dedup_sha"))
        keys = self.scratch.written(keys, "keys")
        self.n = keys.count()
        cells, self.depth = directory(keys, self.n, capacity)
        self.cells = self.scratch.written(cells, "directory")
        self.cell_bytes = 40 * (4 * (self.n // capacity) + 4)
        self.repeated = self.scratch.written(keys.where("group_size > 1").select(KEY), "repeated")
        self.n_repeated = self.repeated.count()
        # hashes that occur once are chains of one; for the others the texts themselves are compared
        candidates = texts.withColumn(KEY, F.xxhash64("_norm")).join(small(self.repeated, self.n_repeated, 16), KEY, "left_semi")
        same = candidates.groupBy(KEY, "_norm").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
        same = same.select(KEY, sha, F.xxhash64(F.concat(F.lit("\x01"), "_norm")).alias("_second"), "keep_id", "group_size")
        same = self.scratch.written(same.unionByName(keys.where("group_size = 1").withColumn("_second", F.lit(0).cast("long"))), "texts")
        placed = self.addressed(same).repartitionByRange("bucket", KEY)
        chain = Window.partitionBy("bucket", KEY).orderBy(F.col("keep_id").asc_nulls_last(), "_dedup_sha", "_second")
        placed = placed.withColumn("link", F.row_number().over(chain)).drop("_second").sortWithinPartitions("bucket", KEY, "link")
        self.entries = self.scratch.written(placed, "index")
        self.scratch.drop(keys, same)

    def addressed(self, rows: DataFrame) -> DataFrame:
        """Rows with the bucket that the directory names for their key; a key that the directory does not know has none."""
        cells = F.broadcast(self.cells) if self.cell_bytes <= BROADCAST_BYTES else self.cells
        return rows.withColumn("cell", _prefix(F.col(KEY), self.depth)).join(cells, "cell", "left").drop("cell")

    def probed(self, rows: DataFrame) -> DataFrame:
        """Rows (KEY, _dedup_sha, ...) with the link, keep_id and group_size that their bucket's chain holds for them."""
        chains = self.entries.select("bucket", KEY, "_dedup_sha", "link", "keep_id", "group_size", F.col("group_size").alias("held"))
        found = looked_up(self.addressed(rows), chains, ["bucket", KEY, "_dedup_sha"], self.n, 224)
        lost = F.raise_error(F.concat(F.lit("the index lacks a row of key "), F.col(KEY).cast("string"))).cast("int")
        return found.withColumn("link", F.coalesce("link", lost))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 12) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket, link.

    Texts are equal when identical after every run of U+0009 to U+000D and spaces became one space; null counts as empty.
    Of equal texts the row with the smallest id stays. Rows that repeat the smallest id and its text are all marked kept; a
    null id stays only if its whole group has none. Empty tables give no rows; further columns of the input are ignored. bucket and link tell
    where in the index the row's text is: link is over 1 only where different texts share a hash.
    """
    index = HashIndex(docs, id_col, text_col, capacity)
    found = index.probed(index.rows)
    kept = F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept, F.lower(F.hex("_dedup_sha")).alias("text_sha256"), "bucket", "link")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 12) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; one row per class even where ids repeat.

    Nulls, empty texts, repeated rows and empty tables are as in exact_dedup. The input's columns are held in one, so no name can clash.
    """
    index = HashIndex(docs, id_col, text_col, capacity)
    norm = normalised(F.col(text_col))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), F.col(id_col).alias("k_id"), F.xxhash64(norm).alias(KEY), F.unhex(F.sha2(norm, 256)).alias("_dedup_sha"))
    repeated = small(index.repeated, index.n_repeated, 16)
    alone = keyed.join(repeated, KEY, "left_anti").select("own")
    heads = index.probed(keyed.join(repeated, KEY, "left_semi")).where(F.col("k_id").eqNullSafe(F.col("keep_id")))
    # rows that repeat the kept id and text may differ in other columns, so one of them stands for all
    heads = heads.groupBy("bucket", KEY, "_dedup_sha").agg(F.first("own").alias("own")).select("own")
    return alone.unionByName(heads).select("own.*")


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
