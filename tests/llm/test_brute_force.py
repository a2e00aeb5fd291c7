"""Operators that SQL can't express, against brute force on the smallest tables or on generated ones."""

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import chat_format, lm_score, mixing, packing, registry, simhash, similar, warc
from loomgraph.llm.common import Scratch

D = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    roots = brute_components(fps)
    want = {r.doc_id: (f"{f:016x}", docs[k].doc_id) for r, f, k in zip(docs, fps, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in registry.queries()["op2_simhash_near_dedup"](spark, D).collect()} == want


def test_design_holds_every_four_positions():
    d = simhash.design(4)
    assert len(d) == 20 and all(any(set(t) <= set(c) for t in d) for c in combinations(range(8), 4))


def test_links_in_blocks_reach_the_same(spark):
    """A dense cluster, chains and noise; posting lists over the limit are dealt as pairs of blocks."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for _ in range(400):
        fps.add(int(base[0]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    x = int(base[1])
    for _ in range(40):
        x ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        fps.add(x)
    fps = sorted(fps)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in fps]
    classes = spark.createDataFrame(signed, "fp long")
    for limit in (1 << 17, 20):
        got = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(classes, len(fps), list_limit=limit), Scratch(spark, "test")).collect()}
        groups, want = {}, {}
        for v, k in zip(fps, brute_components(fps)):
            want.setdefault(k, set()).add(v)
            groups.setdefault(got.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_lm_query(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    got = registry.queries()["op8_lm_score"](spark, D).toPandas().set_index("doc_id")
    for i, t in tokens.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_lm_scores_do_not_depend_on_the_filters_room(spark):
    """Where neither pairs nor words fit, the left-out ones are still counted: the scores are those of exact octaves."""
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    words, pairs = Counter(), Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words.update(t)
            pairs.update(zip([b" ", *t], t))
    n, v, begun = sum(words.values()), len(words), words[None]

    def means(counts):
        octaves = {}
        for c in counts.values():
            octaves.setdefault(c.bit_length(), []).append(c)
        of = {k: np.mean(x) for k, x in octaves.items()}
        return lambda c: c and of[c.bit_length()]

    mean, pair_mean = means(words), means(pairs)
    want = {}
    for i, t in tokens.items():
        want[i] = 0
        for a, b in zip([b" ", *t], t):
            p, h = (mean(words[b]) + 1) / (n + v + 1), begun if a == b" " else mean(words[a])
            want[i] += math.log10(0.6 * p + 0.4 * min(pair_mean(pairs[a, b]), h) / h if h else p)
    for bits, tokens_a_run, off in ((1 << 19, 1 << 20, 0.02), (1 << 15, 3000, 0.02), (1 << 24, 1 << 14, 0.05)):
        got = {r.doc_id: r.score for r in lm_score.scored(docs, filter_bits=bits, run_tokens=tokens_a_run, segment_bytes=1 << 12).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) / len(t) for i, t in tokens.items() if len(t) > 200) < off


def test_filter_levels_are_not_below_the_counts(spark):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    counts = 1 + (rng.pareto(1, len(keys)) * 3).astype(np.int64)
    counted = bytearray(lm_score.packed(counts, 0, 5))
    runs = spark.createDataFrame([(7, 0, 0, bytearray(lm_score.packed(keys, 0, 8)), counted), (7, 1, 0, bytearray(lm_score.packed(keys, 2, 8)), counted)], "run long, kind int, segment int, keys binary, counts binary").coalesce(1)
    bits = 1 << 17
    answers = {r.kind: r.answer for r in lm_score.merged_segments(runs, bits).where("run = 7").collect()}
    assert (lm_score.unpacked(answers[0], 0, 5) == counts).all() and (lm_score.unpacked(answers[1], 0, 1) == np.log2(counts).astype(int)).all()
    out = lm_score.merged_segments(runs, bits).where("filter IS NOT NULL").collect()

    class One(lm_score.CountFilter):
        def __init__(self):
            self.shift, self.bits, self.floors = np.uint64(63), bits, np.array([out[0]["floor"]] * 2)
            self.bytes = np.frombuffer(out[0]["filter"] * 2, np.uint8)

    levels = One().levels(keys, 0)
    exact = np.where(counts >= out[0]["floor"], np.log2(np.maximum(counts / out[0]["floor"], 1)).astype(int) + 1, 0)
    assert (levels >= exact).all() and (levels == exact).mean() > 0.9
    assert (One().levels(rng.integers(0, 2**63, 5000, dtype=np.uint64), 0) == 0).mean() > 0.9


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = registry.queries()["op3_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_mix_query(spark):
    got = registry.queries()["op9_mixing"](spark, D).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    by = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert (by["size"] == by.source_size).all()
    assert np.allclose(by.target, mixing.water_filled(by["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(by))], by["size"].sum(), 3))
    assert (abs(by.taken - by.target) <= np.maximum(0.02 * by.target, 30)).all()


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.sampled_from([5, 2, 1])), min_size=1, max_size=12))
def test_water_filling(rows):
    sizes, weights = zip(*rows)
    got = mixing.water_filled(sizes, weights, sum(sizes), 3)
    assert math.isclose(sum(got), sum(sizes), abs_tol=1e-6) and all(g <= 3 * s + 1e-6 for g, s in zip(got, sizes))
    free = [g / w for g, s, w in zip(got, sizes, weights) if g < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40))
def test_best_fit_and_bounds(lengths):
    x = np.array(lengths)
    bins, offsets, fills = packing.best_fit_decreasing(x, 40)
    for b in range(len(fills)):
        own = np.argsort(offsets[bins == b])
        assert (np.cumsum(x[bins == b][own]) - x[bins == b][own] == offsets[bins == b][own]).all() and x[bins == b].sum() == fills[b] <= 40
    low = packing.lower_bound(x, 40)
    assert -(-x.sum() // 40) <= low <= len(fills)
    reference, room = 0, []
    for n in sorted(lengths, reverse=True):  # plain best fit decreasing
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            reference += 1
            room.append(40 - n)
    assert len(fills) == reference


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .,'\n\t\u00a0é日1²_-🙂\u2003\x1c") + ["s"]), max_size=40))
def test_chunked_ids_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    if not hasattr(test_chunked_ids_are_the_tokenizers, "t"):
        t = test_chunked_ids_are_the_tokenizers.t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
    want = test_chunked_ids_are_the_tokenizers.t.encode(text, add_special_tokens=False).ids
    assert packing.encoder(path).ids(text) == np.array(want, "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "é", "don't", "1"]), max_size=12))
def test_added_tokens_are_the_tokenizers(parts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, text = public_tokenizers.path("byte_bpe_50k.json"), "".join(parts)
    if not hasattr(test_added_tokens_are_the_tokenizers, "t"):
        test_added_tokens_are_the_tokenizers.t = Tokenizer.from_file(path)
    want = test_added_tokens_are_the_tokenizers.t.encode(text, add_special_tokens=False).ids
    assert packing.encoder(path).ids(text) == np.array(want, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(data, size):
    assert warc.unchunked(warc.chunked(data, size)) == data


def test_escapes_round_trip(spark):
    rng = np.random.default_rng(2)
    bits = [*chat_format.CONTROLS, "\\", "<", "[", ">", "s", "/", "x", "\n"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(800)]
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("e", chat_format.escaped(F.col("t"))).withColumn("u", chat_format.unescaped(F.col("e")))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c in chat_format.CONTROLS)


def brute_distinct(docs, width=5, similarity=0.8):
    """The smallest id of each group that links of similar shingle sets connect; texts without words are one group."""
    docs = sorted(docs)
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for _, t in docs]
    sets = [frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset() for w in words]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in enumerate(sets):
        for x in s or [None]:
            holders.setdefault(x, []).append(k)
    for a, b in {p for x in holders.values() for p in combinations(x, 2)}:
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted({docs[find(k)][0] for k in range(len(docs))})


def edited(rng, words, share):
    """A copy with some words changed, moved in or left out."""
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < share / 3 else [w, f"new{rng.integers(1e6)}"] if r < 2 * share / 3 else [f"other{rng.integers(1e6)}"] if r < share else [w]
    return out


def test_similar_documents_are_found(spark):
    """Copies edited little and much, chains of edits, one large group, short texts: at least 95 of 100 are decided as by brute force, and none goes that brute force keeps."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(120):
        base = list(rng.choice(vocabulary, rng.integers(30, 400)))
        texts.append(base)
        texts += [edited(rng, base, share) for share in rng.choice([0.005, 0.01, 0.02, 0.03, 0.05], rng.integers(0, 4))]
    chain = list(rng.choice(vocabulary, 200))
    for _ in range(30):
        chain = edited(rng, chain, 0.015)
        texts.append(chain)
    hub = list(rng.choice(vocabulary, 150))
    texts += [edited(rng, hub, 0.01) for _ in range(400)]
    texts += [["one"], ["One"], ["one", "two"], ["a", "b", "c", "d", "e", "f"], ["a", "b", "c", "d", "e"], []]
    docs = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts)] + [(10_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, got = set(brute_distinct(docs)), {r.doc_id for r in similar.distinct_documents(df).collect()}
    gone = {i for i, _ in docs} - want
    assert len(want) < 0.6 * len(docs) and want <= got and len(gone - got) >= 0.95 * len(gone)


def test_lists_in_blocks_reach_the_same(spark):
    rng = np.random.default_rng(13)
    texts = [edited(rng, list("abcdefghijklmnopqrstuvwxyz" * 4), 0.02) for _ in range(300)]
    prints = np.unique(similar.wide_fingerprints([" ".join(t).encode() for t in texts], 5), axis=0).view(np.int64)
    classes = spark.createDataFrame([(i, i, *map(int, f)) for i, f in enumerate(prints)], "node long, group long, f0 long, f1 long, f2 long, f3 long")
    got = []
    for limit in (1 << 15, 20):
        links = similar.candidates(classes, len(prints), list_limit=limit)
        got.append({(r.node, r.root) for r in simhash.components(links, Scratch(spark, "test")).collect()})
    assert got[0] == got[1] and len(got[0]) > 200
    # what is connected already gets no more links
    assert similar.candidates(classes.withColumn("group", F.lit(0).cast("long")), len(prints)).count() == 0
    halves = similar.candidates(classes.withColumn("group", F.col("node") % 2), len(prints)).collect()
    assert halves and all(r.hi % 2 != r.lo % 2 for r in halves)


def test_lists_are_count_filtered(spark):
    """Links are the pairs of a list that share enough of the 32 positional bytes and differ in few enough bits; within 20 bits none that shares a list is lost."""
    rng = np.random.default_rng(15)
    base = rng.integers(0, 256, (60, 32), np.uint8)
    prints = [*base]
    for x in base:
        # one bit of each byte but `shared`, two of which are in one half of the first word
        y = x ^ (1 << rng.integers(0, 8, 32)).astype(np.uint8)
        kept = np.r_[0, 2, rng.permutation(np.arange(4, 32))[: rng.integers(0, 6)]]
        y[kept] = x[kept]
        prints.append(y)
        z = x.copy()
        z[rng.permutation(32)[:9]] ^= np.uint8(3)
        prints.append(z)
    prints = np.array(prints)
    xors = prints[:, None] ^ prints[None]
    shared, bits = (xors == 0).sum(axis=2), np.bitwise_count(xors).sum(axis=2)
    half = (xors == 0).reshape(len(prints), len(prints), 8, 4).sum(axis=3) >= 2
    rows = [(i, i, *map(int, f)) for i, f in enumerate(prints.view(np.int64))]
    classes = spark.createDataFrame(rows, "node long, group long, f0 long, f1 long, f2 long, f3 long")
    pairs = [(i, j) for i in range(len(prints)) for j in range(i)]
    want = {(i, j, int(bits[i, j])) for i, j in pairs if half[i, j].any() and shared[i, j] >= 4 and bits[i, j] <= 54}
    assert any(shared[i, j] < 4 and half[i, j].any() and bits[i, j] <= 54 for i, j in pairs)
    assert {(r.hi, r.lo, r.bits) for r in similar.candidates(classes, len(prints)).collect()} == want
    close = {(i, j, int(bits[i, j])) for i, j in pairs if half[i, j, :2].any() and bits[i, j] <= 20}
    assert len(close) > 40
    assert {(r.hi, r.lo, r.bits) for r in similar.candidates(classes, len(prints), words=1, far=20).collect()} == close


def test_pipeline_run(spark):
    """run() is the stages one after another, on a table without rows too."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = p.run(spark, D).toPandas()
    kept = brute_distinct([(r.doc_id, r.text) for r in p.exact(spark, docs.where(F.col("text").rlike("\\p{L}")), D).collect()])
    assert set(got.doc_id) <= set(kept) and (got.groupby("sequence_id")["length"].sum() <= 1024).all()
    none = docs.limit(0)
    for _, stage in p.STAGES:
        out = stage(spark, none, D)
        assert out.count() == 0
        none = out if set(p.COLUMNS) <= set(out.columns) else none


def test_packing_exchanges_between_partitions(spark):
    """Many partitions: all pieces are placed once, no sequence overflows, a gap closes by exchange, and certificates hold."""
    rng = np.random.default_rng(14)
    docs = spark.createDataFrame([(i, "a " * int(n)) for i, n in enumerate(rng.integers(20, 63, 600))], "doc_id long, text string")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, size=64, per_partition=40).toPandas()
    own = {i: len(packing.encoder(path).ids("a " * int(n))) // 4 + 1 for i, n in enumerate(np.random.default_rng(14).integers(20, 63, 600))}
    assert got.groupby("doc_id")["length"].sum().to_dict() == own
    fill = got.groupby("sequence_id")["length"].sum()
    assert (fill <= 64).all() and all(g.sort_values("offset")["offset"].tolist() == [0, *np.cumsum(g.sort_values("offset")["length"])[:-1].tolist()] for _, g in got.groupby("sequence_id"))
    lengths = got["length"].to_numpy()
    assert packing.lower_bound(lengths, 64) <= len(fill) <= len(packing.best_fit_decreasing(lengths, 64)[2]) + 15


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{D}/documents.parquet")
    one = p.language_id(spark, docs, D)
    assert one.columns == p.COLUMNS and one.count() == docs.where(F.col("text").rlike("\\p{L}")).count()
    two = p.exact(spark, one, D)
    rows = two.collect()
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in one.collect()}
    assert len(rows) == len(norm)
    three = p.near(spark, two, D)
    assert three.columns == p.COLUMNS and sorted(r.doc_id for r in three.collect()) == brute_distinct([(r.doc_id, r.text) for r in rows])
    four = p.mixing(spark, three, D)
    plan = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
    assert Counter(r.doc_id for r in four.collect()) == Counter({k: v for k, v in plan.items() if v})
    five = p.packing(spark, four, D).toPandas()
    assert (five.groupby("sequence_id")["length"].sum() <= 1024).all()
    firsts = five[five.piece == 0].groupby("doc_id").size()
    assert firsts.to_dict() == {k: v for k, v in plan.items() if v}
    assert isinstance(five, pd.DataFrame)
