"""Text functions and evaluation studies over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx, stats
from ..functions import text as T
from ..operators import qa as Q
from ..operators import study as S
from ..operators import vectors as V
from ..sources import html
from .base import query, t, vectors

# text


@query(r"SELECT doc_id, len(string_split_regex(x, '[।?!]\s+')) AS n FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(replace(text, '.', '।'), '\s+', ' ', 'g')), '[।?!]+\s*$', '') AS x FROM documents WHERE length(text) > 30 AND NOT regexp_matches(text, '[।?!.]\s*[।?!.]'))")
def sentences_bengali(spark, d):
    """Documents with a danda for every full stop, split as Bengali."""
    x = F.regexp_replace(T.clean_ws(F.translate("text", ".", "।")), r"[।?!]+\s*$", "")
    docs = t(spark, d, "documents").where(F.length("text") > 30).where(~F.col("text").rlike(r"[।?!.]\s*[।?!.]"))
    return docs.select("doc_id", F.size(T.sentences_bn(x)).alias("n"))


@query("SELECT o_orderkey, n, CASE WHEN n BETWEEN 1 AND 10 THEN n ELSE 0 END AS roman, b FROM (SELECT o_orderkey, o_orderkey % 12 AS n, o_orderkey AS b FROM orders)")
def numerals(spark, d):
    """Volume numbers in Roman numerals, and numbers in Bengali digits."""
    n = F.col("o_orderkey") % 12
    names = F.array(*[F.lit(x) for x in ("Works", *T.ROMAN, "XI")])
    title = F.concat(F.lit("The Volume "), F.get(names, n.cast("int")), F.lit(": on"))
    bengali = F.translate(F.concat(F.lit("\u200b "), F.col("o_orderkey")), "0123456789", T.BENGALI_DIGITS)
    return t(spark, d, "orders").select("o_orderkey", n.alias("n"), T.volume_number(title).cast("long").alias("roman"), T.bengali_to_int(bengali).cast("long").alias("b"))


@query(r"SELECT p_partkey, CASE WHEN length(x) BETWEEN 2 AND 80 THEN x ELSE '' END AS label FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name || chr(9) || ' ' || p_type, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '^[\-.,;:!?\"''`]+|[\-.,;:!?\"''`]+$', '', 'g') AS x FROM part)")
def entity_labels(spark, d):
    """Entity labels with tabs and line breaks around and within."""
    raw = F.concat(F.lit("\n\t"), "p_name", F.lit("\t "), "p_type", F.lit("\n"))
    return t(spark, d, "part").select("p_partkey", T.entity_label(raw).alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bn' ELSE 'en' END AS detected FROM documents")
def lang_detect_mixed(spark, d):
    """Every third document with a word of Bengali script in it."""
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" সত্য"))).otherwise(F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select("doc_id", T.detect_lang(x).alias("detected"))


@query("SELECT page_id, 'http://x/' || CASE WHEN page_id % 2 = 0 THEN '#p-' || page_id WHEN page_id % 3 = 0 THEN '#ch_' || page_id ELSE '' END AS url FROM pages")
def source_urls(spark, d):
    """Links to a paragraph, else to its chapter, else to the page."""
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("p-"), "page_id")).otherwise("")
    c = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ch_"), "page_id"))
    return t(spark, d, "pages").select("page_id", T.source_url(F.lit("http://x/"), p, c).alias("url"))


LINK = """'<a href="u' || {0} || '" target="_blank" rel="noopener" title="t' || {0} || '">[' || {0} || ']</a>'"""


@query(f"SELECT conv_id, turn, 'a ' || CASE WHEN turn < 2 THEN {LINK.format('(turn + 1)')} ELSE '' END || ' b ' || {LINK.format(2)} || {LINK.format(1)} || ' end' AS linked FROM conversations")
def linked_citations(spark, d):
    """Marks of two sources become links, others go."""
    x = F.concat(F.lit("a ["), (F.col("turn") + 1).cast("string"), F.lit("] b [2][1] end"))
    urls, titles = F.array(F.lit("u1"), F.lit("u2")), F.array(F.lit("t1"), F.lit("t2"))
    return t(spark, d, "conversations").select("conv_id", "turn", T.linked_citations(x, urls, titles).alias("linked"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || ' […truncated]' ELSE text END AS cut, CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS brief FROM documents")
def truncated(spark, d):
    """Passages cut for a model and for a list."""
    x = F.col("text")
    return t(spark, d, "documents").select("doc_id", T.truncated(x, 300, " […truncated]").alias("cut"), T.truncated(x, 40).alias("brief"))


@query(r'''SELECT doc_id, CASE WHEN length(x) > 400 THEN regexp_replace(left(x, 400), ' [^ ]*$', '') || '…' ELSE x END AS clipped, left(regexp_replace(regexp_replace(chr(34) || x, '^["]+|["]+$', '', 'g'), '^\s+|\s+$', '', 'g'), 600) AS chapter FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)''')
def clipped_summaries(spark, d):
    x = T.clean_ws(F.col("text"))
    return t(spark, d, "documents").select("doc_id", T.clipped_summary(x).alias("clipped"), T.chapter_summary(F.concat(F.lit('"'), x)).alias("chapter"))


@query("SELECT doc_id, CASE WHEN length(part) > 0 AND position(part IN text) > 0 THEN substr(text, 1, position(part IN text) - 1) || '**' || part || '**' || substr(text, position(part IN text) + length(part)) ELSE text END AS shown FROM (SELECT doc_id, text, substr(text, 20, 15) AS part FROM documents)")
def highlighted(spark, d):
    """The matched part of each text marked where it first occurs."""
    return t(spark, d, "documents").select("doc_id", T.highlighted(F.col("text"), F.substring("text", 20, 15)).alias("shown"))


@query("SELECT conv_id, (SELECT string_agg(x, '|' ORDER BY i) FROM (SELECT x, i FROM (SELECT arg_min(x, i) AS x, min(i) AS i FROM (SELECT trim(unnest(q)) AS x, generate_subscripts(q, 1) AS i) WHERE x <> '' GROUP BY lower(x)) ORDER BY i LIMIT 4)) AS queries FROM (SELECT conv_id, list(CASE turn WHEN 1 THEN ' ' || upper(role) ELSE role || ' ' || turn % 3 END ORDER BY turn) AS q FROM conversations GROUP BY conv_id)")
def distinct_queries(spark, d):
    """The different questions of a plan, four at most."""
    x = F.when(F.col("turn") == 1, F.concat(F.lit(" "), F.upper("role"))).otherwise(F.concat("role", F.lit(" "), (F.col("turn") % 3).cast("string")))
    lists = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", x.alias("x")))), lambda s: s["x"]).alias("q"))
    return lists.select("conv_id", F.array_join(T.distinct_queries(F.col("q")), "|").alias("queries"))


@query("SELECT p_partkey, CASE WHEN p_size <= 6 THEN 'a-' || p_size ELSE '' END AS kept FROM part")
def offered_labels(spark, d):
    """Labels that a plan picked, as far as they were offered."""
    picked = F.array(F.concat(F.lit(" A "), F.col("p_size").cast("string")), F.lit("never offered"))
    offered = F.array(*[F.lit(f"a-{i}") for i in range(1, 7)])
    return t(spark, d, "part").select("p_partkey", F.array_join(T.offered_labels(picked, offered), "|").alias("kept"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages")
def html_escaped(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(T.html_escaped(F.col("html"))).alias("digest"))


@query("SELECT c_custkey, regexp_full_match(CASE WHEN c_custkey % 5 = 0 THEN c_name || ' x' ELSE replace(c_name, '#', '_') END, '[A-Za-z0-9_-]{1,40}') AS valid, c_mktsegment || '@v' || c_nationkey AS tag FROM customer")
def user_names(spark, d):
    """Names that a rater may have, and the tag of an extractor."""
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit(" x"))).otherwise(F.translate("c_name", "#", "_"))
    return t(spark, d, "customer").select("c_custkey", T.valid_user(name).alias("valid"), T.extractor_tag(F.col("c_mktsegment"), F.col("c_nationkey")).alias("tag"))


@query("SELECT o_orderkey, round((o_orderkey % 50) / greatest(greatest(o_orderkey % 7, 0) / greatest((o_orderkey % 11)::DOUBLE, 0.000001), 0.000001) / 60, 6) AS eta, true AS now_is_utc FROM orders")
def progress_times(spark, d):
    """Minutes left at the rate so far, and the form of a time stamp."""
    done, total = F.col("o_orderkey") % 7, F.col("o_orderkey") % 7 + F.col("o_orderkey") % 50
    eta = T.eta_minutes(done, total, (F.col("o_orderkey") % 11).cast("double"))
    return t(spark, d, "orders").select("o_orderkey", F.round(eta, 6).alias("eta"), T.utc_now().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("now_is_utc"))


@query("SELECT conv_id, turn, round(len(list_intersect(q, p))::DOUBLE / greatest(len(q), 1), 6) AS score FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(role || ' the of and ' || role), '[\\p{L}\\p{N}_]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS p FROM conversations WHERE text IS NOT NULL)")
def lexical_scores(spark, d):
    """The stand-in for a reranker."""
    q = F.concat("role", F.lit(" the of and "), "role")
    return t(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.round(Q.lexical_score(q, F.col("text")), 6).alias("score"))


# model output


@query("SELECT event_id, CASE WHEN k > 1 THEN 1.0 ELSE k END AS weight, 'a-b' AS label, CASE WHEN event_type = 'click' THEN 'contrasts' ELSE 'discusses' END AS relation, event_type AS entity FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50 AS k FROM events)")
def parsed_extractions(spark, d):
    """Noisy output parsed: prose around the object, a trailing comma, weights out of range, unknown relations, labels to normalise."""
    k = F.get_json_object("props", "$.k").cast("double") / 50
    relation = F.when(F.col("event_type") == "click", " Contrasts ").otherwise("odd")
    raw = F.concat(F.lit('So: {"concepts": [{"label": " A_b ", "relation": "'), relation, F.lit('", "weight": '), k.cast("string"), F.lit('},], "entities": [{"label": "\\n'), "event_type", F.lit('", "type": "nothing"}], "summary": "{s}",} done'))
    x = jsonx.parsed_extraction(raw)
    rows = t(spark, d, "events").select("event_id", x.alias("x"))
    return rows.select("event_id", F.col("x.concepts")[0]["weight"].alias("weight"), F.col("x.concepts")[0]["label"].alias("label"), F.col("x.concepts")[0]["relation"].alias("relation"), F.col("x.entities")[0]["label"].alias("entity"))


@query("SELECT CAST(conv_id AS VARCHAR) AS question, conv_id % 4 <> 0 AS ok, CASE WHEN conv_id % 4 <> 0 THEN 'one|two' ELSE '' END AS queries, CASE WHEN conv_id % 4 <> 0 THEN 'a-b' ELSE '' END AS concepts, CASE WHEN conv_id % 4 <> 0 THEN 'note' ELSE '' END AS bridge_note FROM (SELECT DISTINCT conv_id FROM conversations)")
def question_plans(spark, d):
    """Plans from model output; broken output gives a plan that is not ok."""
    good = F.lit('{"timeless_queries": ["one", " ONE ", "two"], "concepts": ["A b", "unknown"], "bridge_note": " note\\t"}')
    c = t(spark, d, "conversations").select("conv_id").distinct()
    raw = c.select(F.col("conv_id").cast("string").alias("question"), F.when(F.col("conv_id") % 4 == 0, "no object").otherwise(good).alias("raw"), F.array(F.lit("a-b")).alias("offered"))
    return Q.plans(raw).select("question", "ok", F.array_join("queries", "|").alias("queries"), F.array_join("concepts", "|").alias("concepts"), "bridge_note")


@query("SELECT o_custkey AS chapter, left(o_custkey || ':' || count(*), 600) AS summary FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) >= 2")
def chapter_summaries(spark, d):
    """A model's summaries of chapters, with a stand-in that counts the notes it is given."""
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("chapter"), F.col("o_orderkey").alias("paragraph_idx"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("summary"))
    notes = S.chapter_notes(o).withColumn("title", F.col("chapter").cast("string"))
    return Q.chapter_summaries(notes, Q.backend(["absent", "echo"]), lambda title, held: f'"{title}:{len(held)}"\n ').withColumn("summary", F.col("summary"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey = b.n_regionkey AS same FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25")
def verified_pairs(spark, d):
    """Pairs that a model is asked about, with a stand-in that compares what it is given."""
    n = t(spark, d, "nation")
    b = n.select((F.col("n_nationkey")).alias("b"), F.col("n_regionkey").cast("string").alias("b_text"))
    pairs = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b"), F.col("n_regionkey").cast("string").alias("a_text")).join(b, "b")
    return Q.verified_pairs(pairs, Q.backend(["echo"]), lambda x, y: "is it?\n" + ("Yes." if x == y else "No.")).select("a", "b", "same")


# evaluation

JUDGED = "SELECT doc_id, quality AS a, toxic AS b, lang, CASE WHEN n_chars >= 2000 THEN 'long' ELSE 'short' END AS band FROM labels JOIN documents USING (doc_id)"


def judged(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", F.when(F.col("n_chars") >= 2000, "long").otherwise("short").alias("band"))
    return t(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"), "lang", "band")


CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


@query(f"WITH j AS ({JUDGED}), r AS (SELECT count(*) AS n, avg(a) AS pa, avg(b) AS pb, avg((a = b)::INT) AS po, avg(a * b) AS consensus, avg(greatest(a, b)) AS either, count(*) FILTER (a > b) AS only_a, count(*) FILTER (a < b) AS only_b FROM j), p AS (SELECT least(1.0, sum(exp(l)) FILTER (l <= own + 1e-9)) AS p FROM (SELECT {CHOOSE.format('m', 'i')} + m * ln(0.5) AS l, {CHOOSE.format('m', 'k')} + m * ln(0.5) AS own FROM (SELECT only_a + only_b AS m, only_a AS k, unnest(range(0, only_a + only_b + 1)) AS i FROM r))) SELECT n, round(pa, 6) AS precision_a, round(pb, 6) AS precision_b, round(consensus, 6) AS consensus, round(either, 6) AS either, round(po, 6) AS agreement, round((po - e) / (1 - e), 6) AS kappa, round((po - g) / (1 - g), 6) AS ac1, only_a, only_b, round(p, 6) AS p_mcnemar FROM (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS e, (pa + pb) * (1 - (pa + pb) / 2) AS g FROM r), p")
def agreement_study(spark, d):
    """Two raters over the same items: precision, agreement, and McNemar's exact test."""
    j = judged(spark, d)
    r = S.agreement(j.select(F.col("doc_id").alias("item"), F.col("a").alias("judgment")), j.select(F.col("doc_id").alias("item"), F.col("b").alias("judgment")))
    return r.select("n", "only_a", "only_b", *[F.round(c, 6).alias(c) for c in ("precision_a", "precision_b", "consensus", "either", "agreement", "kappa", "ac1", "p_mcnemar")])


FISHER = f"""f AS (SELECT k1, n1, k2, n2, least(1.0, sum(exp(l)) FILTER (l <= own + 1e-9)) AS p FROM (
  SELECT *, {CHOOSE.format('n1', 'x')} + {CHOOSE.format('n2', '(k1 + k2 - x)')} - {CHOOSE.format('(n1 + n2)', '(k1 + k2)')} AS l,
         {CHOOSE.format('n1', 'k1')} + {CHOOSE.format('n2', 'k2')} - {CHOOSE.format('(n1 + n2)', '(k1 + k2)')} AS own
  FROM (SELECT *, unnest(range(greatest(0, k1 + k2 - n2), least(n1, k1 + k2) + 1)) AS x FROM c)) GROUP BY ALL)"""


@query(f"""WITH j AS ({JUDGED}), g AS (SELECT 'band' AS kind, band AS value, count(*) AS n, sum(a * b)::BIGINT AS yes FROM j GROUP BY band UNION ALL SELECT 'lang', lang, count(*), sum(a * b)::BIGINT FROM j GROUP BY lang),
c AS (SELECT a.yes AS k1, a.n AS n1, b.yes AS k2, b.n AS n2 FROM g a, g b WHERE a.kind = 'band' AND b.kind = 'band' AND a.value = 'long' AND b.value = 'short'), {FISHER}
SELECT kind, value, n, yes, round(greatest(0, (p0 + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) - 1.96::DOUBLE * sqrt(p0 * (1 - p0) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n)), 6) AS lo, CASE WHEN kind = 'band' THEN round((SELECT p FROM f), 6) END AS p FROM (SELECT *, yes::DOUBLE / n AS p0 FROM g)""")
def agreement_breakdown(spark, d):
    """The raters' consensus by length and language, with Fisher's exact test where there are two values."""
    got = S.breakdown(judged(spark, d), ["band", "lang"])
    return got.select("kind", "value", "n", "yes", F.round("lo", 6).alias("lo"), F.round("p", 6).alias("p"))


@query(f"WITH j AS ({JUDGED}), c AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS k1, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 0 AND b = 1) AS k2, count(*) FILTER (a = 0) AS n2 FROM j), {FISHER} SELECT round(p, 6) AS p FROM f")
def fisher_test(spark, d):
    j = judged(spark, d)
    one = lambda a, b: F.sum(F.when((F.col("a") == a) & (F.col("b") == b), 1).otherwise(0))
    cells = j.agg(one(1, 1).alias("w"), one(1, 0).alias("x"), one(0, 1).alias("y"), one(0, 0).alias("z"))
    return cells.select(F.round(stats.fisher_exact("w", "x", "y", "z"), 6).alias("p"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(n, lambda x: x * x))), 6) AS norm, round(n[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS n FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id + 1)) AS v FROM embeddings))")
def normalised_vectors(spark, d):
    """Vectors of any length brought to length one."""
    n = vectors(spark, d).select("id", V.l2_normalised(F.transform(V.as_double(F.col("vec")), lambda x: x * (F.col("id") + 1))).alias("n"))
    return n.select("id", F.round(F.sqrt(V.dot(F.col("n"), F.col("n"))), 6).alias("norm"), F.round(F.get("n", F.lit(0)), 6).alias("first"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def cosine_pairs(spark, d):
    """Similar pairs of vectors of unequal length: the cosine counts, not the inner product."""
    longer = vectors(spark, d).withColumn("vec", F.transform("vec", lambda x: x * (F.col("id") % 7 + 1)))
    return V.similar_pairs(longer, 0.35).withColumn("sim", F.round("sim", 6))


@query("SELECT s_suppkey AS x, s_nationkey, round(rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0, 6) AS rank, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier")
def ranks(spark, d):
    """Average ranks for ties, and places in an order, over ranges of values."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("x"), "s_nationkey")
    r = stats.midranks(stats.positions(s, "x", "place"), "s_nationkey", "rank")
    return r.select("x", "s_nationkey", F.round("rank", 6).alias("rank"), "place")


# pages


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?i)<h1\b')) AS headings, len(regexp_extract_all(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?i)<p\b')) AS paragraphs FROM pages")
def html_block_counts(spark, d):
    """Headings and paragraphs that the tokenizer finds; tags in scripts and comments do not count."""
    b = html.blocks(t(spark, d, "pages"))
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    own = b.groupBy(F.col("id").alias("page_id")).agg(n("h1").cast("long").alias("headings"), n("p").cast("long").alias("paragraphs"))
    got = t(spark, d, "pages").select("page_id").join(own, "page_id", "left")
    return got.select("page_id", F.coalesce("headings", F.lit(0)).alias("headings"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"))


NOISE = """<body><audio src="x">no</audio><img src="y"/><!-- c --><link rel="shortcut icon" href="z"><p><b>bold<b></p></body></html> <!DOCTYPE html><html><head><title>t</title></head><body>"""


@query("SELECT page_id, 1 AS boundaries, 1 AS audio, (1 + len(regexp_extract_all(html, '(?i)<img\\b[^>]*/?>')))::INT AS images, (1 + len(regexp_extract_all(html, '(?s)<!--.*?-->')))::INT AS comments, 1 AS favicons, 1 AS bold FROM pages WHERE NOT regexp_matches(html, '(?i)<audio|shortcut icon|<b>\\s*</p>|</body>\\s*</html>\\s*<!doctype')")
def html_clean_rules(spark, d):
    """Every rule of the cleaner, by pages that each rule has something to do in."""
    plain = t(spark, d, "pages").where(~F.col("html").rlike(r"(?i)<audio|shortcut icon|<b>\s*</p>|</body>\s*</html>\s*<!doctype"))
    _, counts = html.cleaned(F.concat(F.lit(NOISE), "html"))
    return plain.select("page_id", *[counts[name].cast("int").alias(name) for name, _, _ in html.RULES])
