"""Language ID with a byte convolutional network, trained in numpy on labelled texts.

A text is cut into windows of fixed length. Bytes become classes; filters of several widths run over each window, their largest
response in the window is kept (max pooling), and a softmax layer turns these into language probabilities. A document's log
probabilities are the mean over all its windows, weighted by the bytes they hold.

For application the filters become lookup tables: a filter of width 2 is one table over class pairs, one of width 4 the sum of two.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches

WINDOW = 128
WIDTHS, FILTERS = (2, 4), 16
#: Class 0 pads; letters without case, then one class for each of the groups below, then the bytes from 128.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[[9, 10, 11, 12, 13, 32]] = 27
_CLASS[ord("0") : ord("9") + 1] = 28
_CLASS[(_CLASS == 0) & (np.arange(256) < 128)] = 29
_CLASS[128:] = 30 + np.arange(128) % 64  # a UTF-8 continuation byte keeps its six bits, a lead byte shares them
_CLASS[192:] = 94 + np.arange(64) % 32
CLASSES = 128


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, CLASSES, FILTERS)
    bias: np.ndarray  # per filter
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray


def windows_of(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all windows of all texts, padded, and the text of each."""
    rows, of = [], []
    for i, text in enumerate(texts):
        c = _CLASS[np.frombuffer(text, np.uint8)].astype(np.uint8)
        n = -(-len(c) // WINDOW)
        rows.append(np.pad(c, (0, n * WINDOW - len(c))).reshape(n, WINDOW))
        of.append(np.full(n, i))
    return (np.concatenate(rows), np.concatenate(of)) if rows else (np.empty((0, WINDOW), np.uint8), np.empty(0, int))


def train(texts: Sequence[bytes], labels: Sequence[str], epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on the cross entropy. Besides whole windows it sees beginnings of random length, so short texts are at home too."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    x, of = windows_of(texts)
    y = np.array([languages.index(v) for v in labels])[of]
    short = x.copy()
    short[np.arange(WINDOW)[None, :] >= rng.integers(4, 80, len(x))[:, None]] = 0
    x, y = np.concatenate([x, short]), np.concatenate([y, y])
    weight = 1 / np.maximum(1, np.bincount(y, minlength=len(languages)))[y]
    weight *= len(y) / weight.sum()
    total = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)) for w in WIDTHS] + [np.zeros(total), rng.normal(0, 0.1, (total, len(languages))), np.zeros(len(languages))]
    first, second, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            xb = x[at].astype(np.int64)
            pooled, where = [], []
            for f, w in zip(p, WIDTHS):
                r = sum(f[k][xb[:, k : WINDOW - w + 1 + k]] for k in range(w))
                top = r.argmax(axis=1)
                where.append(top)
                pooled.append(np.take_along_axis(r, top[:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, axis=1) + p[-3]
            a = np.maximum(h, 0)
            z = a @ p[-2] + p[-1]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(at)), y[at]] -= 1
            q *= weight[at][:, None] / len(at)
            back = (q @ p[-2].T) * (h > 0)
            g = [np.zeros_like(v) for v in p[: len(WIDTHS)]]
            for i, w in enumerate(WIDTHS):
                b = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[i][k], (np.take_along_axis(xb, where[i] + k, 1), np.arange(FILTERS)[None, :]), b)
            g += [back.sum(axis=0), a.T @ q, q.sum(axis=0)]
            step += 1
            for v, d, m, s in zip(p, g, first, second):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p[: len(WIDTHS)], p[-3], p[-2], p[-1])


class Applied:
    """A network whose filters are tables over pairs of classes."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = [[(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(-1, FILTERS).astype(np.float32) for k in range(0, w, 2)] for f, w in zip(net.filters, WIDTHS)]

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        pair = windows[:, :-1].astype(np.int32) * CLASSES + windows[:, 1:]
        pooled = []
        for tables, w in zip(self.tables, WIDTHS):
            n = WINDOW - w + 1
            r = tables[0][pair[:, :n]]
            for k, t in enumerate(tables[1:], 1):
                r += t[pair[:, 2 * k : 2 * k + n]]
            pooled.append(r.max(axis=1))
        a = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
        z = a @ self.net.out + self.net.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: Sequence[bytes], block: int = 128) -> tuple[list[str], np.ndarray]:
        """Language and probability of each whole text."""
        sums, mass = np.zeros((len(texts), len(self.net.languages))), np.zeros(len(texts))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def settle() -> None:
            x, of = np.concatenate([w for w, _ in held]), np.concatenate([o for _, o in held])
            for i in range(0, len(x), block):
                lp, filled, o = self.log_probs(x[i : i + block]), (x[i : i + block] > 0).sum(axis=1), of[i : i + block]
                np.add.at(sums, o, lp * filled[:, None])
                np.add.at(mass, o, filled)

        for i, t in enumerate(texts):
            w, _ = windows_of([t])
            held.append((w, np.full(len(w), i)))
            n += len(w)
            if n >= 4096:
                settle()
                held, n = [], 0
        if held:
            settle()
        z = sums / np.maximum(mass, 1)[:, None]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        best = q.argmax(axis=1)
        return [self.net.languages[k] for k in best], q[np.arange(len(q)), best]


def training_windows(docs: DataFrame, per_language: int, windows: int, max_languages: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[bytes, str]]:
    """The bounded sample that the network learns from: windows of the per_language documents of each language with the smallest id hash.

    Only documents whose crc32(id as text) mod 3 is not 1 take part. The first pass reads ids and languages alone. More than
    max_languages languages are refused. Whole texts are cut into windows, and of these each document gives one, then
    a second, and so on, in the order of a hash, until a language has as many as `windows` or no more; repeated rows count once.
    """
    ids = docs.where(F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    held = ids.groupBy("lang").agg(F.countDistinct("id").alias("n")).orderBy("lang").limit(max_languages + 1).collect()
    if len(held) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not held:
        return []
    # the smallest hashes of a large language all lie below twice their expected place, so few rows reach the window
    below = F.create_map(*[F.lit(x) for r in held for x in (r["lang"], 2.0**64 * min(1.0, (2 * per_language + 64) / r["n"]) - 2.0**63)])[F.col("lang")]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = ids.where(F.xxhash64("id") <= below).distinct().withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("data"))
    rows = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi")  # at most per_language rows a language
    cut = rows.select("id", "lang", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("data") / WINDOW).cast("int") - 1), lambda i: F.substring("data", i * WINDOW + 1, WINDOW))).alias("at", "window")).distinct()
    cut = cut.withColumn("order", F.xxhash64("id", "at", "window"))
    nth = F.row_number().over(Window.partitionBy("id", "lang").orderBy("order", "at", "window"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("nth", "order", "id", "at", "window"))
    got = cut.withColumn("nth", nth).withColumn("place", place).where(F.col("place") <= windows).select("window", "lang", "place").collect()
    return [(bytes(r["window"]), r["lang"]) for r in sorted(got, key=lambda r: (r["lang"], r["place"]))]


def identified(docs: DataFrame, per_language: int = 400, windows: int = 1600, max_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: Sequence[str] | None = None) -> DataFrame:
    """The rows of `docs`, or of them the columns `carry`, with held_out, lang_pred and score.

    lang_pred is a language seen in training; `und` with score 0 where the text is null or has no letter, and for all rows where there is
    nothing to learn from. All windows of a text count, however long it is; repeated rows get the same answer each. Labels of more than
    max_languages languages raise a ValueError. The sample to learn from is bounded by per_language documents and `windows` windows of a language. Columns
    of the input that are named held_out, lang_pred or score give way to the answer's. An empty table gives no rows.
    """
    spark = docs.sparkSession
    batches(spark)
    rows = training_windows(docs, per_language, windows, max_languages, id_col, text_col, lang_col)
    net = train([t for t, _ in rows], [v for _, v in rows]) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied = Applied(net) if net else None
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            told = [i for i, t in enumerate(texts) if t is not None] if applied else []
            if told:
                got, p = applied.predict([texts[i] for i in told])
                lang[told], score[told] = got, p
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*b.schema.names[:-1], "lang_pred", "score"])

    lettered = F.when(F.col(text_col).rlike("\\p{L}"), F.col(text_col).cast("binary"))
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("held_out", "lang_pred", "score")]
    data = "_" * (1 + max(map(len, carried), default=0))  # no carried name is as long
    kept = docs.select(*carried, held_out.alias("held_out"), lettered.alias(data))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")
