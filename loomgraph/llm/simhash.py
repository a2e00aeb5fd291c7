"""SimHash near-dedup: a byte-position inverted index with count filtering.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they share at least 4
positional bytes. Postings of a single byte would be a 256th of all rows each; so a posting is a tuple of three (position, byte)
entries, and the tuples are the 20 of a Turan design: any 4 of the 8 positions hold one of them. Within a posting
list the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum are dropped, and the rest are
verified by counting the bits that differ.

Equal fingerprints are one class before any of this. A posting list gives a spanning forest of its links instead of
all its pairs: a search takes fingerprints one after another and compares each with those that nobody has reached yet, which is close
to linear where many are alike. Lists over `list_limit` are dealt as pairs of blocks, each pair a task's own small list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, looked_up, small

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def design(min_shared: int) -> list[tuple[int, ...]]:
    """Sets of positions so that any `min_shared` of the 8 bytes hold at least one of them.

    For 4 it is Turan's construction for triples: positions in three rings; a triple within one ring, or two of one and one of the next.
    """
    if min_shared < 4:
        return [(p,) for p in range(8)] if min_shared == 1 else [c for c in combinations(range(8), min_shared)]
    ring = [p * 3 // 8 for p in range(8)]
    out = []
    for c in combinations(range(8), 3):
        held = sorted(ring[p] for p in c)
        if held[0] == held[2] or (len(set(held)) == 2 and (min(set(held), key=held.count) - max(set(held), key=held.count)) % 3 == 1):
            out.append(c)
    return out


def shingle_hashes(data: bytes, width: int) -> list[int]:
    """XXH64 of every word shingle of a lower-cased text; the whole sequence if it has fewer words."""
    words = data.lower().split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, SEED)]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    return [h(joined[a:b], SEED) for a, b in zip(starts[:-width].tolist(), (starts[width:] - 1).tolist())]


def fingerprints_of(texts: list[bytes | None], width: int = 4, chunk: int = 200_000) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if over half of the shingle hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    rows, held, n = [], [], 0

    def settle() -> None:
        sizes = np.array([len(x) for x in held], np.int64)
        hashes = np.concatenate([np.array(x, np.uint64) for x in held]).view(np.uint8).reshape(-1, 8)
        of = np.repeat(np.arange(len(held)) * 256, sizes)
        fp = np.zeros(len(held), np.uint64)
        for p in range(8):
            counts = np.bincount(of + hashes[:, p], minlength=256 * len(held)).reshape(-1, 256) @ _BITS
            byte = ((2 * counts > sizes[:, None]) * (1 << np.arange(8))).sum(axis=1).astype(np.uint64)
            fp |= byte << np.uint64(8 * p)
        out[rows] = fp

    for i, text in enumerate(texts):
        if hashes := shingle_hashes(text, width) if text else []:
            rows.append(i)
            held.append(hashes)
            n += len(hashes)
            if n >= chunk or len(rows) >= 512:
                settle()
                rows, held, n = [], [], 0
    if rows:
        settle()
    return out


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, hash) per row; hash tells different texts apart."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(2).to_pylist(), width).view(np.int64)), b.column(1)], names=["id", "fp", "hash"])

    return docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text_col).alias("hash"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, fp long, hash long")


def _alike(x: np.ndarray, bits: int, min_shared: int) -> np.ndarray:
    """Of XORs of pairs: those that share enough positional bytes and, verified, differ in few enough bits."""
    near = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= min_shared
    near[near] = np.bitwise_count(x[near]) <= bits
    return near


def _forest(fps: np.ndarray, bits: int, min_shared: int) -> tuple[list, list]:
    """Spanning links of a posting list."""
    fps = np.unique(fps)
    a, b = [], []
    unseen = fps
    while len(unseen):
        frontier, unseen = [unseen[0]], unseen[1:]
        while frontier and len(unseen):
            x = frontier.pop()
            hit = _alike(unseen ^ x, bits, min_shared)
            if hit.any():
                found = unseen[hit]
                unseen = unseen[~hit]
                a.append(found)
                b.append(np.full(len(found), x))
                frontier.extend(found)
    return a, b


def links(classes: DataFrame, n: int, bits: int = 4, list_limit: int = 1 << 17) -> DataFrame:
    """(hi, lo): links between distinct fingerprints, with the same reachability as all pairs within `bits`."""
    min_shared = 8 - bits
    if min_shared < 1:
        raise ValueError("at least one of the eight bytes must be shared")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    tuples = [reduce(lambda k, p: F.shiftleft(k, 8).bitwiseOR(byte(p)), c, F.lit(i).cast("long")) for i, c in enumerate(design(min_shared))]
    postings = classes.select("fp", F.explode(F.array(*tuples)).alias("key"))
    if n > list_limit:
        counts = postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > list_limit)
        hot = counts.select("key", F.ceil(2 * F.col("n") / list_limit).cast("int").alias("blocks"))
        postings = postings.join(small(hot, len(tuples) * n // list_limit, 24), "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o)))
        postings = postings.select("fp", "key", F.explode(pairs).alias("block"))
    else:
        postings = postings.withColumn("block", F.lit(0).cast("long"))

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]

        def found(fp: np.ndarray, key: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(fp), bool)
            new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            start = np.flatnonzero(new)
            sizes = np.diff(np.append(start, len(fp)))
            a, b = [], []
            i = start[sizes == 2]
            hit = i[_alike(fp[i] ^ fp[i + 1], bits, min_shared)]
            a.append(fp[hit])
            b.append(fp[hit + 1])
            for s, m in zip(start[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                x, y = _forest(fp[s : s + m], bits, min_shared)
                a += x
                b += y
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["hi", "lo"])

        for r in rows:
            cols = [np.concatenate([x, r.column(i).to_numpy().view(x.dtype)]) for i, x in enumerate(left)]
            last = len(cols[1]) and int(np.flatnonzero((cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1]))[0])
            left = [x[last:] for x in cols]
            if last:
                yield found(*(x[:last] for x in cols))
        if len(left[1]):
            yield found(*left)

    sorted_lists = postings.select("fp", "key", "block").repartition("key", "block").sortWithinPartitions("key", "block")
    return sorted_lists.mapInArrow(scan, "hi long, lo long").distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links, by alternating hooks to the smallest neighbour and pointer jumps.

    Each round is written to the shared folder; nothing but two counts reaches the driver.
    """
    stars = scratch.written(edges, "edges")
    for _ in range(max_rounds):
        least = stars.groupBy("hi").agg(F.min("lo").alias("root"), F.count("*").alias("n"))
        least = scratch.written(least, "least")
        # a star forest: every node has one link, and no node that it points to has one itself
        n, nodes = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        up = least.select(F.col("hi").alias("lo"), F.col("root").alias("above"))
        jumped = stars.join(least.select("hi", "root"), "hi").select("hi", "lo", "root")
        hooked = jumped.select("hi", F.col("root").alias("lo")).unionByName(jumped.where("lo <> root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))).distinct()
        after = hooked.join(small(up, nodes, 32), "lo", "left").select("hi", F.coalesce("above", "lo").alias("lo"), F.col("above").isNotNull().alias("moved"))
        after = scratch.written(after, "stars")
        moved = after.where("moved").limit(1).count()
        stars = after.select("hi", "lo").distinct() if moved or n != nodes else after.select("hi", "lo")
        if not moved and n == nodes:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError("the links did not settle")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int) -> tuple[DataFrame, DataFrame, int, Scratch]:
    """(id, fp, hash) per row; (fp, root, held) per distinct fingerprint, held being its rows; their number."""
    batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.written(fingerprints(docs, width, id_col, text_col), "rows")
    classes = scratch.written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("held")), "classes")
    n = classes.count()
    linked = components(links(classes.select("fp"), n, bits), scratch)
    of = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "held", F.coalesce("root", "fp").alias("root"))
    return rows, scratch.written(of, "roots"), n, scratch


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint, component_id.

    Null texts and texts without words have fingerprint zero, which links like any other. Repeated rows and ids are one row
    each. component_id is the smallest non-null id among all rows that links reach, null only if there is none. An empty table gives no
    rows, and further columns are ignored.
    """
    rows, of, n, scratch = _components(docs, id_col, text_col, width, bits)
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    many = scratch.written(ids.where("classes > 1"), "components")
    of = looked_up(of, many.withColumnRenamed("classes", "fps"), ["root"], many.count(), 48, held="fps").select("fp", "held", F.coalesce("component_id", "least").alias("component_id"))
    out = looked_up(rows, scratch.written(of, "answers"), ["fp"], n, 64)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id (null last), then the smallest text hash.

    Null and empty texts are alike. Rows that repeat id and text may differ in other columns; one stands for all. An empty table gives no rows. The input's
    columns are held in one, so no name can clash.
    """
    rows, of, n, scratch = _components(docs, id_col, text_col, width, bits)
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("hash"))).alias("least"))
    heads = of.select("fp", "root").join(best, "fp").groupBy("root").agg(F.min("least").alias("least"))
    # held: rows alike, so that only those that are repeated need another look
    heads = scratch.written(heads.select(F.col("least.id").alias("h_id"), F.col("least.hash").alias("h_hash")), "heads")
    alike = rows.groupBy(F.col("id").alias("h_id"), F.col("hash").alias("h_hash")).agg(F.count("*").alias("alike")).where("alike > 1")
    alike = scratch.written(alike, "alike")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("own"), F.col(id_col).cast("long").alias("k_id"), _text_hash(text_col).alias("k_hash"))
    on = lambda t: F.col("k_id").eqNullSafe(t["h_id"]) & (F.col("k_hash") == t["h_hash"])
    kept = own.join(small(heads, n, 24), on(heads), "left_semi")
    repeated = small(alike, alike.count(), 32)
    single = kept.join(repeated, on(alike), "left_anti").select("own")
    many = kept.join(repeated, on(alike), "left_semi").groupBy("k_id", "k_hash").agg(F.first("own").alias("own")).select("own")
    return single.unionByName(many).select("own.*")
