"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

1. Every text is tokenised once, in runs of about `run_tokens` tokens. A run's row in the shared folder holds its documents' ids and its
   token stream (ranks into the run's distinct words, compressed). The sorted distinct hashes of its words and word pairs, with their
   counts in training documents, are pieces for owner segments, which the top bits of a hash name.
2. An owner task merges its segment's pieces into exact counts and builds its segment of the filter. A count c is the level
   floor(log2(c / floor)) + 1, and an n-gram is entered once for each level up to its own. Each segment has a fixed number of bits; `floor`
   (of words) and `pair_floor` are the smallest powers of two whose entries fit in it, so the filter has a fixed largest size however many
   n-grams there are. To each run's piece the owner answers with the exact counts of its words and the octaves of its pairs, in the
   order of the piece's keys, so an answer is one byte a pair before compression and needs no key.
3. The filter is broadcast, and meets the runs' streams and answers, brought together by run. A level is read by probing level after level until
   one is absent; the probability of a word is (1 - weight) P(word) + weight min(c(previous, word), c(previous)) / c(previous), with
   the add-one estimate P(word) of its octave's mean count. What a floor may have left out (level 0 or 1 of a segment whose floor is
   above 1) is read from the run's answers. So every n-gram counts at any size, and the work by input is the same at any size.
4. The base score takes the exact counts of the answers.

Words are known by 64-bit hashes, pairs by 48-bit ones.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches

END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" begin"))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
PROBES = 3
WORD, PAIR, STREAM = 0, 1, 2
#: Octave codes next to 0 to 63: the count of beginnings, none, and not known from the filter.
BEGUN, ABSENT, ASK = 64, 65, 255


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64((salt * 0x632BE59BD9B4E019) & (2**64 - 1))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, each text closed by the end token, and the number of tokens per text."""
    out, sizes, h = [], np.empty(len(texts), np.int64), xxhash.xxh3_64_intdigest
    for i, t in enumerate(texts):
        words = (t or b"").lower().split()
        out.append(np.fromiter(map(h, words), np.uint64, len(words)))
        out.append(np.array([END]))
        sizes[i] = len(words) + 1
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes


def pair_hashes(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of each token and the one before it (a begin mark for a text's first); its low 16 bits are zero."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(sizes) - sizes)] = BEGIN
    return _mixed(before * _M2 ^ _mixed(tokens, 1), 2) & ~np.uint64(0xFFFF)


def packed(x: np.ndarray, low: int, high: int) -> bytes:
    """Bytes `low` to `high` of unsigned numbers, one plane after another, compressed; sorted numbers have cheap high planes."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, low:high].T)
    return struct.pack("<I", len(x)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, low: int, high: int) -> np.ndarray:
    n = struct.unpack_from("<I", data)[0]
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.decompress(memoryview(data)[4:], n * (high - low), codec="zstd")
        out[:, low:high] = np.frombuffer(planes, np.uint8).reshape(high - low, n).T
    return out.view("<u8").ravel()


#: Which bytes of a word's key, a pair's key, a count and a rank are kept.
_KEYS, _COUNTS, _RANKS = {WORD: (0, 8), PAIR: (2, 8)}, (0, 5), (0, 4)
RUNS = "run long, kind int, segment int, keys binary, counts binary, ids array<long>, held array<boolean>, sizes binary, begun long"
_RUNS = pa.schema([("run", pa.int64()), ("kind", pa.int32()), ("segment", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("begun", pa.int64())])


def _batch(schema: pa.Schema, rows: int, /, **given: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(rows, f.type) for f in schema], schema=schema)


def runs(docs: DataFrame, segments: int, run_tokens: int) -> DataFrame:
    """docs: id, held_out, text (binary). Per run a row of kind STREAM (distinct words by frequency in `keys`, the tokens' ranks in `counts`)
    and a row per segment and kind of n-gram with its sorted keys and their counts in training documents, which may be zero."""
    shift = np.uint64(64 - int(math.log2(segments)))

    def one(run: int, ids: list, held: list, texts: list) -> Iterator[pa.RecordBatch]:
        tokens, sizes = token_hashes(texts)
        train = np.repeat(~np.array(held, bool), sizes)
        for kind, grams in ((WORD, tokens), (PAIR, pair_hashes(tokens, sizes))):
            keys, at = np.unique(grams, return_inverse=True)
            counts = np.bincount(at[train], minlength=len(keys))
            of = (keys >> shift).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(keys)]]).tolist()
            for i in range(0, len(cuts) - 1, 64):
                part = list(zip(cuts[i : i + 64], cuts[i + 1 : i + 65]))
                yield _batch(_RUNS, len(part), run=pa.array([run] * len(part)), kind=pa.array([kind] * len(part)), segment=pa.array([of[a] for a, _ in part]), keys=pa.array([packed(keys[a:b], *_KEYS[kind]) for a, b in part]), counts=pa.array([packed(counts[a:b], *_COUNTS) for a, b in part]))
            if kind == WORD:
                by_use = np.argsort(-np.bincount(at, minlength=len(keys)), kind="stable")
                rank = np.empty(len(keys), np.int64)
                rank[by_use] = np.arange(len(keys))
                yield _batch(_RUNS, 1, run=pa.array([run]), kind=pa.array([STREAM]), keys=pa.array([packed(keys[by_use], *_KEYS[WORD])]), counts=pa.array([packed(rank[at], *_RANKS)]), ids=pa.array([ids], pa.list_(pa.int64())), held=pa.array([held]), sizes=pa.array([packed(sizes, *_COUNTS)]), begun=pa.array([len(held) - sum(held)]))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, ids, held, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in rows:
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t or b"") // 6 + 1
                if size >= run_tokens:
                    yield from one(run, ids, held, texts)
                    run, ids, held, texts, size = run + 1, [], [], [], 0
        if ids:
            yield from one(run, ids, held, texts)

    return docs.select("id", "held_out", "text").mapInArrow(cut, RUNS)


def _positions(keys: np.ndarray, kind: int, level: np.ndarray | int, probe: int, bits: int) -> np.ndarray:
    """Bit within its segment for one probe of an n-gram at a level."""
    x = _mixed(keys ^ (np.asarray(level, np.uint64) * _M1), 16 * kind + probe + 5)
    return (x >> np.uint64(40)) & np.uint64(bits - 1) if bits <= 1 << 24 else x & np.uint64(bits - 1)


def filtered(grams: list[tuple[np.ndarray, np.ndarray]], bits: int) -> tuple[list[int], bytes]:
    """The floors of words and pairs and one segment of the filter, from keys and exact counts of either kind."""
    floors, used = [], 0
    for (_, c), most in zip(grams, (bits // 16, bits // 8)):  # leave the filter sparse enough; words take half of it at most
        floor = 1
        while True:
            entries = int((np.log2(c[c >= floor] / floor).astype(np.int64) + 1).sum())
            if used + entries <= most or floor > 1 << 40:
                break
            floor *= 2
        floors.append(floor)
        used += entries
    mask = np.zeros(bits, np.uint8)
    for kind, ((keys, counts), floor) in enumerate(zip(grams, floors)):
        keys, counts = keys[counts >= floor], counts[counts >= floor]
        top = np.log2(counts / floor).astype(np.int64) + 1
        for level in range(1, int(top.max(initial=0)) + 1):
            k = keys[top >= level]
            for probe in range(PROBES):
                mask[_positions(k, kind, level, probe, bits)] = 1
    return floors, np.packbits(mask, bitorder="little").tobytes()


ANSWERS = "run long, kind int, segment int, answer binary, floor long, pair_floor long, filter binary, stats array<long>"
_ANSWERS = pa.schema([("run", pa.int64()), ("kind", pa.int32()), ("segment", pa.int32()), ("answer", pa.binary()), ("floor", pa.int64()), ("pair_floor", pa.int64()), ("filter", pa.binary()), ("stats", pa.list_(pa.int64()))])


def merged_segments(pieces: DataFrame, bits: int) -> DataFrame:
    """Owner tasks over pieces (run, kind, segment, keys, counts), sorted by segment. Per segment a row of its filter, floors and statistics (for words, then pairs:
    64 numbers of n-grams by octave, 64 sums of their counts), and a row that answers each piece: counts of words, octaves of pairs."""

    def own(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held = None, {WORD: [], PAIR: []}

        def done() -> Iterator[pa.RecordBatch]:
            grams, stats = [], []
            for kind in (WORD, PAIR):
                keys = np.concatenate([k for _, k, _ in held[kind]] or [np.empty(0, np.uint64)])
                keys, at = np.unique(keys, return_inverse=True)
                total = np.bincount(at, np.concatenate([c for _, _, c in held[kind]] or [np.empty(0)]), len(keys)).astype(np.int64)
                octave = np.where(total > 0, np.log2(np.maximum(total, 1)).astype(np.int64), ABSENT)
                seen = total > 0
                grams.append((keys[seen], total[seen]))
                stats += [np.bincount(octave[seen], minlength=64), np.bincount(octave[seen], total[seen], 64).astype(np.int64)]
                end = np.cumsum([len(k) for _, k, _ in held[kind]])
                for i in range(0, len(end), 256):
                    part = [(held[kind][j][0], at[end[j] - len(held[kind][j][1]) : end[j]]) for j in range(i, min(i + 256, len(end)))]
                    told = [packed(total[a], *_COUNTS) if kind == WORD else packed(octave[a], 0, 1) for _, a in part]
                    yield _batch(_ANSWERS, len(part), run=pa.array([r for r, _ in part]), kind=pa.array([kind] * len(part)), segment=pa.array([segment] * len(part)), answer=pa.array(told))
            floors, mask = filtered(grams, bits)
            yield _batch(_ANSWERS, 1, segment=pa.array([segment]), floor=pa.array(floors[:1]), pair_floor=pa.array(floors[1:]), filter=pa.array([mask]), stats=pa.array([np.concatenate(stats).tolist()]))

        for b in rows:
            for run, kind, s, keys, counts in zip(*(b.column(c).to_pylist() for c in ("run", "kind", "segment", "keys", "counts"))):
                if s != segment:
                    if segment is not None:
                        yield from done()
                    segment, held = s, {WORD: [], PAIR: []}
                held[kind].append((run, unpacked(keys, *_KEYS[kind]), unpacked(counts, *_COUNTS)))
        if segment is not None:
            yield from done()

    return pieces.select("run", "kind", "segment", "keys", "counts").mapInArrow(own, ANSWERS)


class CountFilter:
    """The broadcast filter: its segments' bits and floors."""

    def __init__(self, segments: int, bits: int, rows: list):
        self.shift, self.bits = np.uint64(64 - int(math.log2(segments))), bits
        self.floors, self.pair_floors = np.ones(segments, np.int64), np.ones(segments, np.int64)
        self.bytes = np.zeros(segments * bits // 8, np.uint8)
        for r in rows:
            self.floors[r["segment"]], self.pair_floors[r["segment"]] = r["floor"], r["pair_floor"]
            at = r["segment"] * bits // 8
            self.bytes[at : at + bits // 8] = np.frombuffer(r["filter"], np.uint8)

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Levels by repeated membership probes: the last of the levels 1, 2, ... that are all present."""
        out = np.zeros(len(keys), np.int64)
        alive, level = np.arange(len(keys)), 1
        while len(alive):
            k = keys[alive]
            base = (k >> self.shift) * np.uint64(self.bits)
            for probe in range(PROBES):
                at = base + _positions(k, kind, level, probe, self.bits)
                hit = (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive, k, base = alive[hit], k[hit], base[hit]
            out[alive] = level
            level += 1
        return out

    def octaves(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Octaves of the counts: ABSENT, or ASK where the count may lie below the segment's floor."""
        level = self.levels(keys, kind)
        floors = (self.pair_floors if kind else self.floors)[keys >> self.shift]
        octave = np.minimum(np.log2(floors).astype(np.int64) + level - 1, 63)
        return np.where((floors > 1) & (level <= 1), ASK, np.where(level > 0, octave, ABSENT))


def probability(word: np.ndarray, history: np.ndarray, both: np.ndarray, denominator: float, weight: float) -> np.ndarray:
    """The word's probability from estimated counts of the word, of the one before it and of the two."""
    p = (word + 1) / denominator
    return np.where(history > 0, (1 - weight) * p + weight * np.minimum(both, history) / np.maximum(history, 1), p)


def estimates(stats: dict[int, int], kind: int) -> np.ndarray:
    """Counts by octave code: the mean count of the octave's n-grams."""
    out = np.zeros(256)
    for k in range(64):
        n, total = stats.get(128 * kind + k, 0), stats.get(128 * kind + 64 + k, 0)
        out[k] = total / n if n else 1.5 * 2.0**k
    return out


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 28, run_tokens: int = 1 << 20, segment_bytes: int = 16 << 20, weight: float = 0.4) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(id as text) mod 7 is not 2; a null id takes part in learning. Null and empty texts hold
    the end token alone. Repeated rows are counted and scored each. If there is nothing to learn from, all counts are zero and every
    token has the add-one probability of an empty table. An empty table gives no rows; further columns are ignored.

    filter_bits bounds the broadcast filter, run_tokens a task's tokens at a time (a longer document is a run of its own), segment_bytes the
    bytes of text per owner segment, whose number grows with the input.
    """
    spark = docs.sparkSession
    batches(spark)
    scratch = Scratch(spark, "lm")
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    segments = 1 << max(6, (size // segment_bytes).bit_length())
    bits = max(64, min(filter_bits, 1 << max(20, (16 * size).bit_length())) // segments)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    tokenised = scratch.written(runs(rows, segments, run_tokens), "runs")
    pieces = tokenised.where(F.col("kind") != STREAM).select("run", "kind", "segment", "keys", "counts")
    owned = scratch.written(merged_segments(pieces.repartition("segment").sortWithinPartitions("segment"), bits), "segments")
    heads = owned.where("filter IS NOT NULL")
    stats = {r["pos"]: r["n"] for r in heads.select(F.posexplode("stats").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("n")).collect()}
    total, distinct = sum(stats.get(64 + k, 0) for k in range(64)), sum(stats.get(k, 0) for k in range(64))
    table = CountFilter(segments, bits, heads.select("segment", "floor", "pair_floor", "filter").collect())
    of_words, of_pairs = estimates(stats, WORD), estimates(stats, PAIR)
    of_words[BEGUN] = tokenised.agg(F.coalesce(F.sum("begun"), F.lit(0))).first()[0]
    denominator = total + distinct + 1.0
    sent_model = spark.sparkContext.broadcast((table, of_words, of_pairs))  # at most filter_bits bits

    out_schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of_words, of_pairs = sent_model.value
        answers: dict[int, list[np.ndarray]] = {WORD: [], PAIR: []}

        def one(run: int, keys: bytes, ranks: bytes, ids: list, held: list, sizes: bytes) -> pa.RecordBatch:
            words, ranks, sizes = unpacked(keys, *_KEYS[WORD]), unpacked(ranks, *_RANKS), unpacked(sizes, *_COUNTS).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            by_key = np.argsort(words)
            counts, octave = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            told = np.concatenate(answers[WORD])
            counts[by_key] = told.astype(np.int64)
            exact = np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64), ABSENT)
            octave = table.octaves(words, WORD)
            octave = np.where(octave == ASK, exact, octave)
            tokens = words[ranks]
            pairs, back = np.unique(pair_hashes(tokens, sizes), return_inverse=True)
            both, told = table.octaves(pairs, PAIR), np.concatenate(answers[PAIR]).astype(np.int64)
            if len(told) != len(pairs):
                raise RuntimeError(f"run {run} has {len(pairs)} pairs and {len(told)} answers")
            both = np.where(both == ASK, told, both)[back]
            word, history = octave[ranks], np.empty(len(tokens), np.int64)
            history[1:] = word[:-1]
            history[starts] = BEGUN
            logs = np.log10(probability(of_words[word], of_words[history], of_pairs[both], denominator, weight))
            known = np.add.reduceat((counts > 0)[ranks].astype(np.int64), starts)
            base = np.add.reduceat(np.log10(counts + 1.0)[ranks], starts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(sizes), pa.array(known), pa.array(base), pa.array(np.add.reduceat(logs, starts))], schema=out_schema)

        for b in rows:
            for run, kind, answer, *doc in zip(*(b.column(c).to_pylist() for c in ("run", "kind", "answer", "keys", "counts", "ids", "held", "sizes"))):
                if kind != STREAM:
                    answers[kind].append(unpacked(answer, *(_COUNTS if kind == WORD else (0, 1))))
                else:
                    yield one(run, *doc)
                    answers = {WORD: [], PAIR: []}

    told = owned.where("answer IS NOT NULL").select("run", "kind", "segment", "answer")
    both = tokenised.where(F.col("kind") == STREAM).select("run", "kind", "segment", "keys", "counts", "ids", "held", "sizes").unionByName(told, allowMissingColumns=True)
    both = both.repartition("run").sortWithinPartitions("run", "kind", "segment")
    out = both.mapInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(denominator)).alias("base_score"),
        "score",
    )
