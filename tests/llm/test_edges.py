"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, chat_format, exact_dedup, language_id, lm_score, mixing, packing, simhash, similar, url_filter, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ["id", "_id", "fp", "n", "size", "_bytes", "held_out", "score", "copies", "part", "source_size", "root", "row", "url_", "key", "window", "hash", "_dedup", "x"]
LONG = "word " * 30_000 + "end"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n", "fr", "b"), (5, "The quick  brown fox jumps over the lazy dog", "en", "a"),
    (5, "The quick  brown fox jumps over the lazy dog", "en", "a"), (6, LONG, "en", "b"), (7, "été à la plage avec les enfants", "fr", None), (8, "12 34 !!", "xx", "b"), (None, "no id here at all, none", "en", "a"),
    (9, "the Quick brown fox jumps over the lazy dog", "en", "c"), (10, "\x00 odd \u2028 marks </s> [INST]", None, "c"), (11, "🙂 🙂", "fr", "c"), (12, LONG, "en", "b"),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def words(text):
    return [w for w in (text or "").encode().split()]


def test_exact_dedup(docs, none):
    got = sorted(exact_dedup.exact_dedup(docs).collect(), key=str)
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[5].keep_id == 1 and by[5].group_size == 3 and by[1].kept and not by[5].kept
    assert by[2].keep_id == 2 and by[3].keep_id == 2 and by[12].keep_id == 6 and by[None].kept
    assert by[4].group_size == 1 and by[4].text_sha256 == hashlib.sha256(b" ").hexdigest()
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 6, 7, 8, 9, 10, 11]
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.deduplicated(none).count() == 0


def test_the_index_decides(spark):
    """With buckets of three keys the documents spread over many; every row's answer comes from its bucket, and one that lost its entry is an error."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = exact_dedup.exact_dedup(d, capacity=3).toPandas()
    by = {}
    for r in d.select("doc_id", "text").collect():
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    want = {i: (min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids}
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got.itertuples()} == want
    assert got.groupby("bucket")["text_sha256"].nunique().max() <= 3 and got["bucket"].nunique() > 40 and (got["link"] == 1).all()
    index = exact_dedup.HashIndex(d, capacity=3)
    entries = index.entries.toPandas()
    assert len(entries) == len(by)
    index.entries = index.entries.where(F.col("bucket") != entries["bucket"].max())
    with pytest.raises(Exception, match="the index lacks a row"):
        index.probed(index.rows).collect()
    index.entries = index.entries.limit(0).unionByName(index.scratch.written(spark.createDataFrame(entries.assign(keep_id=-1), index.entries.schema), "false"))
    assert {r.keep_id for r in index.probed(index.rows).collect()} == {-1}


def test_colliding_keys_are_chained(spark, monkeypatch):
    """All texts under four keys: the links of a chain are its different texts, and each row finds its own."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(F.crc32(c[0].cast("string") if hasattr(c[0], "cast") else F.col(c[0]).cast("string")), F.lit(4)).cast("long"))
    rows = [(i, f"text {i % 40}") for i in range(120)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), capacity=2).toPandas()
    assert (got.keep_id == got.doc_id % 40).all() and (got.group_size == 3).all() and got["link"].max() > 5


def test_looked_up_deals_hot_keys(spark, monkeypatch):
    from loomgraph.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 7 + 2).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("held"), F.min("id").alias("least")).where("k <> 5")
    got = common.looked_up(rows, table, ["k"], 7, 8, per_task=50)
    want = {r.k: r.least for r in table.collect()}
    assert {r.id: r.least for r in got.collect()} == {r.id: want.get(r.k) for r in rows.collect()}


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias(exact_dedup.KEY))
    cells, depth = exact_dedup.directory(keys, 4000, 100)
    held = keys.withColumn("cell", exact_dedup._prefix(F.col(exact_dedup.KEY), depth)).join(cells, "cell").groupBy("bucket", "local_depth").count()
    assert depth >= 6 and held.agg(F.max("count")).first()[0] <= 100 and held.agg(F.sum("count")).first()[0] == 4000
    assert exact_dedup.directory(keys.limit(50), 50, 100)[1] == 0


def test_near_dedup(docs, none):
    got = {r.doc_id: r for r in simhash.near_dedup(docs).collect()}
    assert len(simhash.near_dedup(docs).collect()) == len(ROWS)
    assert got[2].fingerprint == got[3].fingerprint == got[4].fingerprint == "0" * 16 and got[4].component_id == 2
    assert got[1].component_id == got[5].component_id == got[9].component_id == 1 and got[12].component_id == 6
    assert got[None].component_id is None
    heads = simhash.one_per_component(docs)
    assert heads.columns == docs.columns and {1, 2, 6} <= {r.doc_id for r in heads.collect()} and 9 not in {r.doc_id for r in heads.collect()}
    assert simhash.near_dedup(none).count() == 0 and simhash.one_per_component(none).count() == 0
    repeated = frame(docs.sparkSession, [(1, LONG, "en", "a"), (5, LONG, "en", "a"), (5, "another text of some words", "en", "a"), (5, "another text of some words", "fr", "b"), (None, "a third text with other words", None, None)])
    assert sorted((r.doc_id or 0, r.text[:7]) for r in simhash.one_per_component(repeated).collect()) == [(0, "a third"), (1, LONG[:7]), (5, "another")]


def test_distinct_documents(docs, none):
    got = similar.distinct_documents(docs)
    assert got.columns == docs.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 2, 6, 7, 8, 10, 11]
    assert similar.distinct_documents(none).count() == 0


def test_language_id(docs, none):
    got = language_id.identified(docs, per_language=5)
    by = {r.doc_id: r for r in got.collect()}
    assert len(got.collect()) == len(ROWS) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 8, 11))
    assert by[1].lang_pred in ("en", "fr") and 0 <= by[1].score <= 1 and by[1].held_out == (zlib.crc32(b"1") % 3 == 1)
    assert language_id.identified(none).count() == 0
    assert {r.lang_pred for r in language_id.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_are_all_learned_or_refused(spark):
    many = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    with pytest.raises(ValueError):
        language_id.training_windows(many, 5, 100, 3, "doc_id", "text", "lang")
    # xx: 9 ids of 300 rows each; yy: as many ids, once each
    few = spark.range(300 * 9).select((F.col("id") % 9).alias("doc_id"), F.lit("quelques mots").alias("text"), F.lit("xx").alias("lang"))
    few = few.unionByName(spark.range(100, 109).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("yy").alias("lang")))
    want = [i for i in [*range(9), *range(100, 109)] if zlib.crc32(str(i).encode()) % 3 != 1]
    got = language_id.training_windows(few, 5, 100, 3, "doc_id", "text", "lang")
    assert [sum(v == x for _, v in got) for x in ("xx", "yy")] == [min(5, sum(i < 9 for i in want)), min(5, sum(i >= 9 for i in want))]


def test_all_parts_of_a_text_are_learned_from(spark):
    """Windows come from whole texts: each document gives one before any gives a second, and with room for all, all are there."""
    texts = {i: "".join(f"{i:03d}-{k:04d} " for k in range(9 + 300 * (i % 3))) for i in range(12) if zlib.crc32(str(i).encode()) % 3 != 1}
    d = spark.createDataFrame([(i, f"a{t}", "xx") for i, t in texts.items()], "doc_id long, text string, lang string")
    whole = {f"a{t}"[k : k + 128].encode() for t in texts.values() for k in range(0, len(t) + 1, 128)}
    got = language_id.training_windows(d, 20, 10_000, 3, "doc_id", "text", "lang")
    assert {w for w, _ in got} == whole and len(got) == len(whole)
    few = [w for w, _ in language_id.training_windows(d, 20, len(texts), 3, "doc_id", "text", "lang")]
    assert sorted(int(re.search(rb"(\d{3})-", w)[1]) for w in few) == sorted(texts)


def test_language_query_is_the_network(spark):
    """The query's answers are those of the network, worked out filter by filter for each window of each text."""
    from loomgraph.llm import registry

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = language_id.training_windows(docs, 400, 1600, 200, "doc_id", "text", "lang")
    net = language_id.train([t for t, _ in rows], [v for _, v in rows])
    got = {r.doc_id: r for r in registry.op3_language_id(spark, d).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:60]:
        data = (texts[i] or "").encode()
        if not re.search(r"[^\W\d_]", texts[i] or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        total, mass = 0, 0
        for k in range(0, len(data), 128):
            c = language_id._CLASS[np.frombuffer(data[k : k + 128], np.uint8)]
            n, c = len(c), np.pad(c, (0, 128 - len(c)))
            pooled = [max(sum(f[j][c[at + j]] for j in range(w))[m] for at in range(129 - w)) for f, w in zip(net.filters, language_id.WIDTHS) for m in range(language_id.FILTERS)]
            z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
            total, mass = total + n * (z - z.max() - np.log(np.exp(z - z.max()).sum())), mass + n
            if k > 2000:
                break
        if k <= 2000:
            p = np.exp(total / mass - (total / mass).max())
            assert got[i].lang_pred == net.languages[int(p.argmax())] and abs(got[i].score - (p / p.sum()).max()) < 1e-3


def test_pipeline_keeps_unlabelled_documents(docs):
    import corpus_pipeline as p

    unlabelled = docs.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    got = p.language_id(docs.sparkSession, unlabelled, "")
    assert got.columns == p.COLUMNS and sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i in (1, 5, 5, 6, 7, None, 9, 10, 12))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    got = packing.pack(docs, TOKENIZER, size=64).toPandas()
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x, *_ in ROWS if i != 5}
    sizes = got[got.doc_id != 5].groupby("doc_id", dropna=False)["length"].sum()
    assert {(None if k != k else int(k)): int(v) for k, v in sizes.items()} == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()] and g["length"].sum() <= 64
    ids = np.array(t.encode(LONG, add_special_tokens=False).ids + [2], "<u4")
    for r in got[got.doc_id == 6].itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(none, TOKENIZER).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in got)
    assert {r.doc_id: r.size for r in got if r.doc_id != 5} == {i: len(words(x)) for i, x, *_ in ROWS if i != 5}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and taken.where("doc_id = 6").count() == sum(r.copies for r in got if r.doc_id == 6)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_of_ties_and_repeated_rows(spark):
    """Rows alike in id, text and source are taken as often as planned together; ties in size and small buckets give the same mix on every run."""
    rows = [(i % 70 if i % 3 else None, f"word{i % 5} " * (1 + i % 4), "en", f"s{i % 4}") for i in range(600)] + [(9, "a hot row " * 3, "en", "s0")] * 400
    d = frame(spark, rows)
    planned = mixing.mix(d, bucket=16).collect()
    assert sorted(map(str, planned)) == sorted(map(str, mixing.mix(d.repartition(5), bucket=16).collect()))
    assert all(r.taken <= 3 * r.size for r in planned)
    for size, target, taken in {(r.source_size, round(r.target, 6), sum(x.taken for x in planned if x.source_size == r.source_size)) for r in planned}:
        assert abs(taken - target) <= 0.02 * target + 30, (size, target, taken)
    got = mixing.mixed(d, bucket=16).groupBy("doc_id").count().collect()
    want = {}
    for r in planned:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert {r.doc_id: r["count"] for r in got} == {i: n for i, n in want.items() if n}


def test_lm_score(docs, none):
    got = lm_score.scored(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and all(r.n_tokens == len(words(x)) + 1 for i, x, *_ in ROWS for r in [by[i]])
    assert by[1].held_out == (zlib.crc32(b"1") % 7 == 2) and all(r.score <= 0 and r.n_known <= r.n_tokens for r in got)
    assert lm_score.scored(none).count() == 0
    alone = lm_score.scored(docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in alone)


def test_chat(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 1, "user", None), (1, 2, "assistant", "a" * 9000), (1, 3, None, "x"), (2, None, "assistant", "\\ <\\s> <s> [INST]\\"), (None, 0, "assistant", "")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("window", "pos", "seg", "new")})
    windows = chat_format.formatted_windows(t, budget=32)
    for r in windows.collect():
        body = r.formatted.replace("<s>[INST]", "").replace("</s>", "").replace("[/INST]", "")
        assert not any(c in body for c in chat_format.CONTROLS)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    assert got[1].n_turns == 5 and got[1].loss_chars == 9000 and got[None].loss_chars == 0
    assert got[2].loss_sha256 == hashlib.sha256(rows[5][3].encode()).hexdigest()
    text = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in rows[:5])
    assert got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert windows.where("conv_id = 1 AND window > 0 AND n_context = 0").count() == 0
    assert chat_format.read_back(chat_format.formatted_windows(t.where("false"))).count() == 0


def test_chat_windows_keep_the_budget(spark):
    """A window exceeds the budget only by its system turn and a single new turn; turns that fit together are not torn apart for nothing."""
    rng = np.random.default_rng(4)
    sizes = {0: [900, 1000, 140], 1: [600, 600, 600], 2: [3000, 10, 10, 10]} | {i: rng.choice([5, 30, 200, 500, 900, 2000], rng.integers(1, 30)).tolist() for i in range(3, 60)}
    rows = [(c, t, "system" if c % 2 and t == 0 else ("assistant", "user")[t % 2], "x" * max(0, 4 * (n - 4))) for c, x in sizes.items() for t, n in enumerate(x)]
    windows = chat_format.formatted_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    new = {}
    for r in sorted(windows, key=lambda r: (r.conv_id, r.window)):
        turns = [(role, math.ceil(len(text) / 4) + 4) for role, text in re.findall(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", r.formatted)]
        assert len(turns) == r.n_context + r.n_turns
        total, context = sum(n for _, n in turns), [role for role, _ in turns[: r.n_context]]
        assert total <= 1024 or (r.n_turns == 1 and set(context) <= {"system"})
        assert r.conv_id % 2 == 0 or turns[0][0] == "system"
        new.setdefault(r.conv_id, []).extend(n for _, n in turns[r.n_context :])
    assert {c: [max(n, 4) for n in x] for c, x in sizes.items()} == new
    assert sum(r.n_context > r.conv_id % 2 for r in windows) > 10 and max(r.n_turns for r in windows) > 4


def test_queries_against_sql(spark):
    import duckdb

    from loomgraph.llm import registry

    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for name in ("conversations", "documents", "pages"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        want = db.execute(sql).fetchall()
        columns = [x[0] for x in db.description]
        assert sorted(map(repr, (tuple(r) for r in registry.queries()[name](spark, d).select(*columns).collect()))) == sorted(map(repr, want))


def test_warc(spark):
    long = "é" * 70_000
    rows = [(1, "http://a/", "x" * 200), (2, None, "x" * 200), (3, "http://ü/ \n", None), (4, "b", ""), (5, "c", long), (6, "c", long), (7, "c", "short"), (8, "c", "short"), (None, "d", "x" * 200), (1, "http://a/", "x" * 200)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "original", "payload", "id")})
    got = warc.round_trip(p).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.payload_bytes == len((x or "").encode()) and r.payload_digest == hashlib.sha256((x or "").encode()).hexdigest() for i, _, x in rows for r in [by[i]])
    assert [by[i].record_type for i in (1, 2, 3, 5, 6, 7, 8, None)] == ["response", "revisit", "response", "response", "revisit", "response", "response", "revisit"]
    assert by[2].refers_to == 1 and by[6].refers_to == 5 and by[5].refers_to is None
    assert warc.round_trip(p.where("false")).count() == 0
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"", 4)) == b"" and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_warc_segments_are_verified(spark, tmp_path):
    """Reassembly whatever the order of the records; missing, repeated and falsely summed segments and payloads are errors. Files beside the manifest are not read."""
    import zlib as z

    from loomgraph.llm.common import Scratch

    payload = b"".join(b"%d " % i for i in range(9000))
    good = warc.records_of(7, "http://a/", payload, hashlib.sha256(payload).hexdigest(), None, "name", 8192)
    assert len(good) > 4

    def read(records, name):
        at = tmp_path / name
        at.mkdir()
        data = b"".join((c := z.compressobj(1, z.DEFLATED, 31)).compress(r) + c.flush() for r in records)
        (at / "one.warc.gz").write_bytes(data)
        (at / "stray.warc.gz").write_bytes(b"not an archive")
        files = spark.createDataFrame([(f"file://{at}/one.warc.gz",)], "path string")
        return [tuple(r) for r in warc.read_archives(files, Scratch(spark, "test")).collect()]

    assert read(good[::-1], "reversed") == read(good, "in-order") == [(7, "response", len(payload), hashlib.sha256(payload).hexdigest(), None)]
    false_total = good[:-1] + [re.sub(rb"Total-Length: \d+", b"Total-Length: 5", good[-1])]
    no_total = good[:-1] + [re.sub(rb"WARC-Segment-Total-Length: \d+\r\n", b"", good[-1])]
    other = warc.records_of(7, "http://a/", payload[::-1], hashlib.sha256(payload).hexdigest(), None, "name", 8192)
    for name, records in {"missing": good[:2] + good[3:], "cut": good[:-1], "repeated": good + good[1:2], "total": false_total, "no-total": no_total, "payload": other}.items():
        with pytest.raises(Exception, match="segments of|stated digest"):
            read(records, name)


def test_urls(spark):
    rows = [(1, "https://A.Example.NET/en/x?y"), (2, "http://example.net/fr/"), (3, None), (4, "no host"), (5, "http://b.example.com/de/1"), (6, "http://x.org/fr/#a"), (7, "http://net"), (8, "http://planet/"), (9, "x://?a"), (1, "https://A.Example.NET/en/x?y"), (10, "ftp://a.b.net/" + "p" * 50_000)]
    p = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "score")})
    got = {r.page_id: r for r in url_filter.judged(p).collect()}
    assert [got[i].rule for i in range(1, 10)] == ["example.net/en/", "net/", None, None, "example.com/de/", "org/fr/", None, None, None]
    assert got[1].verdict == "allow" and got[2].verdict == got[5].verdict == got[10].verdict == "block" and got[6].verdict == "allow"
    assert got[1].host == "a.example.net" and got[1].path == "/en/x" and (got[3].host, got[3].path) == ("", "")
    assert url_filter.judged(p).count() == len(rows) and url_filter.judged(p.where("false")).count() == 0


def test_url_model_on_held_out_hosts():
    rows = url_filter.labelled()
    fold = [zlib.crc32(url_filter.split(u)[0].encode()) % 5 == 0 for u, _ in rows]
    w, bias = url_filter.fitted([r for r, x in zip(rows, fold) if not x])
    right = [(url_filter.score_of(w, bias, *url_filter.split(u)) >= 0.5) == bool(label) for (u, label), x in zip(rows, fold) if x]
    assert len(right) > 300 and np.mean(right) >= 0.9


def test_url_query(spark):
    """The whole query against rules and scores worked out one URL at a time."""
    from loomgraph.llm import registry

    d = "/root/testdata/sf0.001"
    w, bias = url_filter.trained()
    got = {r.page_id: tuple(r)[1:5] for r in registry.op7_url_filter(spark, d).select("page_id", "host", "path", "rule", "verdict").collect()}
    urls = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(urls)
    for page_id, url in urls:
        rest = (url or "").partition("://")[2]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        grams = url_filter.features(host, path).tolist()
        z = sum(w[g] for g in grams) / max(1, len(grams)) ** 0.5 + bias
        _, rule, verdict = max(fits) if fits else (0, None, "block" if z >= 0 else "allow")
        assert got[page_id] == (host, path, rule, verdict)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(300, 8)))]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [1.0]), (None, [1.0] * 8), (304, [None] + [1.0] * 7), (305, rows[0][1]), (306, rows[0][1]), (0, rows[0][1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "x", "list", "bound")})
    got = ann.nearest(v, k=5).toPandas()
    sound = [(i, np.array(x)) for i, x in rows if i is not None and x and len(x) == 8 and None not in x and np.isfinite(x).all() and any(x)]
    hit = total = 0
    for q in sorted({i for i, _ in sound if i % 20 == 0}):
        qx = next(x for i, x in sound if i == q)
        want = sorted(((-float(qx @ x), i) for i, x in sound if i != q))[:5]
        own = got[got.query_id == q].sort_values("rank")
        hit, total = hit + len(set(own.vec_id) & {i for _, i in want}), total + 5
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and (np.diff(own.score) <= 1e-12).all()
    assert hit / total >= 0.9 and set(got[got.query_id == 0].vec_id[:2]) == {305, 306}
    assert ann.nearest(v.where("false")).count() == 0 and ann.nearest(v.where("vec_id IN (0, 1, 2)"), k=5).where("query_id = 0").count() == 2


def test_nearest_probes_fewer_lists_than_there_are(spark, monkeypatch):
    """Vectors in clusters: a few lists hold nearly all neighbours; the lists are cut into pieces and shares. Brute force gives the recall."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16)) * 3
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16))
    told, real = [], ann.probes_for
    monkeypatch.setattr(ann, "probes_for", lambda *a: told.append((len(a[2]), real(*a))) or told[-1][1])
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(v, sample=2000, piece=50, queries_per_task=16).toPandas()
    lists, probes = told[0]
    assert probes < lists / 2
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = {20 * i: set(np.argsort(-r, kind="stable")[:20].tolist()) for i, r in enumerate(scores)}
    by = {q: set(g) for q, g in got.groupby("query_id")["vec_id"]}
    assert np.mean([len(by[q] & w) / 20 for q, w in want.items()]) >= 0.9
    assert np.allclose(got["score"], np.einsum("ij,ij->i", x[got["query_id"]], x[got["vec_id"]]))


def test_scan_abandons_only_what_the_test_allows():
    rng = np.random.default_rng(9)
    q, v = rng.normal(size=(40, 65)), rng.normal(size=(3000, 65))
    far = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    bounds = np.sort(far, axis=1)[:, 30]
    a, b = ann.scan(q, bounds, v, 1e9, 20)
    exact = {(i, int(j)) for i in range(40) for j in np.argsort(far[i])[:20]}
    assert exact <= set(zip(a.tolist(), b.tolist())) and len(a) < 40 * 25
    a, b = ann.scan(q, bounds, v, 2.8, 20)
    assert len(exact & set(zip(a.tolist(), b.tolist()))) >= 0.97 * len(exact)
