"""Best-fit packing of tokenised documents, with dual-feasible lower bounds as certificates.

1. Every document is tokenised once; the table of pieces (lengths and digests, no ids) is written to the shared folder.
2. Pieces are dealt by a hash of their row into partitions of bounded size, and each is packed best-fit decreasing.
3. For each partition the largest of two families of dual-feasible functions bounds the number of bins from below. Where the
   packing meets the bound it is certified as the best for its documents. Partitions with a gap give up the documents of
   their bins that have room, certified ones only those of rather empty bins; these documents are dealt anew,
   so partitions exchange them, and best-fit decreasing runs again, as long as that saves bins.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches

#: White space of the byte-level pre-tokenizer's pattern.
_SPACE = " \t-\r\x85\xa0  -     　"
#: A chunk runs up to the next space that is followed by something else than white space; no token spans such a place.
_CHUNK = re.compile(rf"(?s:.)[^ ]*(?: (?![^{_SPACE}])[^ ]*)*")
#: Fixed value: the splitting pattern that a byte-level pre-tokenizer with use_regex stands for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token and its id, where ids rise in the order of the merges; None for any other kind of tokenizer."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or not all(t["special"] and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip")) for t in spec.get("added_tokens", [])):
        return None
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special, vocab = {t["content"] for t in spec.get("added_tokens", [])}, model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(b <= a for a, b in zip(made, made[1:])):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}


class Encoder:
    """Texts to packed little-endian unsigned 32-bit ids, with a bounded memory of chunks already seen.

    The ids are those of the given file of the `tokenizers` library. For a plain byte-level BPE the merges are run by
    tiktoken from that file's own vocabulary, chunk by chunk, which gives the same ids in a third of the time. The file's added tokens
    are one id each wherever a text holds them, as `tokenizers` reads them.
    """

    def __init__(self, path: str, keep: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks, added = _merge_ranks(spec), {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.added = {k: struct.pack("<I", i) for k, i in added.items()}
        self.split = re.compile("|".join(re.escape(k) for k in sorted(added, key=len, reverse=True))) if added else None
        self.chunked, self.keep, self.new, self.old = ranks is not None, keep, {}, {}
        if ranks is not None:
            import tiktoken

            self.merge = tiktoken.Encoding("chunks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    def _miss(self, chunk: str) -> bytes:
        if (got := self.new.get(chunk)) is None:
            if (got := self.old.get(chunk)) is None:
                ids = self.merge(chunk)
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(chunk) > 64:
                return got
            if len(self.new) >= self.keep:
                self.old, self.new = self.new, {}
            self.new[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        if not self.chunked:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not self.split or not self.split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join(out) + self._plain(text[at:])

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        chunks = _CHUNK.findall(text)
        found = list(map(self.new.get, chunks))
        if None in found:
            found = [self._miss(c) if x is None else x for c, x in zip(chunks, found)]
        return b"".join(found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept over its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def piece_lengths(n: int, size: int) -> list[int]:
    """The pieces of a document of n tokens: only the first may be shorter than `size`."""
    return [n % size or size] + [size] * ((n - 1) // size)


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, n_row = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        base = TaskContext.get().partitionId() << 40
        for batch in rows:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, at = enc.ids(text or "") + end, 0
                for k, length in enumerate(piece_lengths(len(ids) // 4, size)):
                    out.append((base + n_row, key, k, at, length, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)])))
                    at += length
                    n_row += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _PIECES)] if out else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, "uid long, id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and the fill of each bin. Bins by room left; one big integer marks the rooms that occur."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions and the plain sum."""
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((count * x).sum()) // size)
    for a in range(1, size // 2 + 1):  # below a counts nothing, above size - a counts as a whole bin
        f = np.where(x > size - a, size, np.where(x < a, 0, x))
        best = max(best, -(-int((count * f).sum()) // size))
    for k in range(1, 33):  # rounds to multiples of 1 / k, but for exact multiples of 1 / (k + 1)
        exact = (x * (k + 1)) % size == 0
        f = np.where(exact, x * k, (x * (k + 1) // size) * size)
        best = max(best, -(-int((count * f).sum()) // (size * k)))
    return best


def _packed(items: DataFrame, n: int, size: int, per_partition: int, turn: int) -> DataFrame:
    parts = max(1, -(-n // per_partition))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = g["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, size)
        g["sequence_id"] = (turn << 56) + (int(g["part"].iloc[0]) << 28) + bins
        g["offset"], g["fill"], g["gap"] = offsets, fills[bins], len(fills) - lower_bound(lengths, size)
        return g.drop(columns="part")

    dealt = items.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(pack, "uid long, id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long, gap long")


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 1 << 16) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    Null texts count as empty; a document always has its end token, so none is without pieces. Repeated rows and ids are
    packed as often as they occur, null ids too. An empty table gives no rows. certified: the piece's partition met its bound. Partitions with a gap
    exchange documents until a round saves no bin.
    """
    spark = docs.sparkSession
    batches(spark)
    scratch = Scratch(spark, "packing")
    items = scratch.written(pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces")
    current = scratch.written(_packed(items, items.count(), size, per_partition, 0), "packed")
    settled: list[DataFrame] = []
    for turn in count(1):
        roomy = (F.col("fill") < size) & ((F.col("gap") > 0) | (F.col("fill") <= size - size // 8))
        pool = current.where(roomy)
        n, before = pool.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if not n:
            break
        again = scratch.written(_packed(pool.select(*items.columns), n, size, per_partition, turn), "packed")
        if again.where("offset = 0").count() >= before:
            break
        settled.append(current.where(~roomy))
        current = again
    for x in settled:
        current = current.unionByName(x)
    return current.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", (F.col("gap") == 0).alias("certified"))
