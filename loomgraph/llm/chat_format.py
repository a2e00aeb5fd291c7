"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as  <s>[INST]role[/INST]text</s> . Inside roles and texts a backslash becomes two, and a control string gets
a backslash after its first character, so no text can hold a control string and dropping the escapes restores it.

The system turn, and a quarter of the budget for history, are set aside in every window; the prefix sums of a conversation's turn
tokens are cut at multiples of what remains (one token at least). Turns whose sums end between two cuts form a window if their tokens fit in what remains; else the
first of them, which overhangs the cut before it, is a window of its own, and those after it, which lie between the cuts, are another. So windows are turn-aligned
and hold one turn, or turns that fit. Every later window repeats the conversation's system turn, and up to `history` turns before it, the
nearest first, as long as system, history and new turns fit in the budget. So a window exceeds the budget only where the system
turn and a single new turn do. Repeated turns are context: only turns that are new in their window are targets, and the loss mask holds the
texts of new assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ANY = r"(\\)|(<)(?=/?s>|</?SYS>>)|(\[)(?=/?INST\])"


def escaped(text: Column) -> Column:
    """Adds a backslash after each backslash and after the first character of each control string."""
    return F.regexp_replace(text, _ANY, r"$1$2$3\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def tokens(text: Column) -> Column:
    """A turn's size for the budget: a quarter of its characters, rounded up, and four for its marks."""
    return F.ceil(F.length(text) / 4) + 4


def formatted_windows(turns: DataFrame, budget: int = 1024, history: int = 2, target: str = "assistant") -> DataFrame:
    """One row per window: conv_id, window, n_context, n_turns, formatted, loss.

    turns: conv_id, turn, role, text; null roles and texts count as empty, a null conv_id is a conversation of its own, and
    further columns are ignored. Turns are ordered by turn (null first), then role, then text, so repeated and tied rows
    keep one order; all of them are kept. A window's text starts with its n_context repeated turns, then n_turns new ones.
    loss: the mask as (start, length) pairs, in characters of `formatted` counted from 1. An empty table gives no rows.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = turns.select("conv_id", F.col("turn").alias("_turn"), blank("role").alias("role"), blank("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("_turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(order) - 1).withColumn("n_tok", tokens(F.col("text")))
    t = t.withColumn("end", F.sum("n_tok").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    is_system = (F.col("pos") == 0) & (F.col("role") == "system")
    aside = F.coalesce(F.first(F.when(is_system, F.col("n_tok"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    t = t.withColumn("aside", aside).withColumn("room", F.greatest(F.lit(budget - budget // 4) - F.col("aside"), F.lit(1)))
    t = t.withColumn("cell", F.floor((F.col("end") - 1) / F.col("room")))
    alone = (F.sum("n_tok").over(Window.partitionBy("conv_id", "cell")) > F.col("room")) & (F.col("end") - F.col("n_tok") < F.col("cell") * F.col("room"))
    t = t.withColumn("span", 2 * F.col("cell") + F.when(alone, 0).otherwise(1))
    t = t.withColumn("left", F.lit(budget) - F.col("aside") - F.sum("n_tok").over(Window.partitionBy("conv_id", "span")))
    t = t.withColumn("starts", F.coalesce(F.lag("span").over(order) != F.col("span"), F.lit(True)))
    t = t.withColumn("window", F.sum(F.col("starts").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    t = t.withColumn("seg", F.concat(F.lit("<s>[INST]"), escaped(F.col("role")), F.lit("[/INST]"), escaped(F.col("text")), F.lit("</s>")))
    # the windows that repeat a turn: those that start within the next few turns and have room for it and the turns between, and for a leading system
    # turn all later ones
    ahead = lambda c, k: F.lead(c, k).over(order)
    between = lambda k: ahead("end", k) - ahead("n_tok", k) - F.col("end") + F.col("n_tok")
    later = F.array(*[F.when(ahead("starts", k) & (between(k) <= ahead("left", k)), ahead("window", k)) for k in range(1, history + 1)]) if history else F.array().cast("array<bigint>")
    t = t.withColumn("near", F.filter(later, lambda w: w.isNotNull()))
    new = t.select("conv_id", "window", F.lit(True).alias("new"), "pos", "role", "seg", "text")
    near = t.where(~is_system & (F.size("near") > 0)).select("conv_id", F.explode("near").alias("window"), F.lit(False).alias("new"), "pos", "role", "seg", "text")
    # the rows that start a window carry the system turn's text forward, so no task needs a conversation's rows at once
    lead_in = t.withColumn("head", F.first(F.when(is_system, F.col("seg"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lead_in = lead_in.where("head IS NOT NULL AND pos > 0 AND starts")
    system = lead_in.select("conv_id", "window", F.lit(False).alias("new"), F.lit(0).alias("pos"), F.lit("system").alias("role"), F.col("head").alias("seg"), F.lit("").alias("text"))
    parts = new.unionByName(near).unionByName(system)
    part = F.struct(F.col("pos"), F.col("new"), F.col("role"), F.col("seg"), (F.length("seg") - F.length(escaped(F.col("text"))) - 4).alias("lead"))
    w = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ends = F.expr("transform(parts, (p, i) -> aggregate(slice(parts, 1, i), 0L, (a, q) -> a + length(q.seg)))")
    w = w.withColumn("starts", ends).withColumn("at", F.arrays_zip("parts", "starts"))
    return w.select(
        "conv_id",
        "window",
        F.expr("size(filter(parts, p -> NOT p.new))").alias("n_context"),
        F.expr("size(filter(parts, p -> p.new))").alias("n_turns"),
        F.expr("array_join(transform(parts, p -> p.seg), '')").alias("formatted"),
        F.expr(f"transform(filter(at, x -> x.parts.new AND x.parts.role = '{target}'), x -> struct(x.starts + x.parts.lead + 1 AS start, CAST(length(x.parts.seg) - x.parts.lead - 4 AS BIGINT) AS length))").alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows hold, from their text and masks alone: a row per conversation, turns in order."""
    turns = F.expr("slice(split(formatted, '</s>', -1), n_context + 1, n_turns)")
    body = lambda x: F.substring_index(F.substring(x, 10, 1 << 30), "[/INST]", 1)
    lines = F.transform(turns, lambda x: F.concat(unescaped(body(x)), F.lit("\n"), unescaped(F.substring_index(x, "[/INST]", -1)), F.lit("\n")))
    masked = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int"))))
    w = windows.select("conv_id", "window", "n_turns", F.array_join(lines, "").alias("lines"), F.array_join(masked, "").alias("masked"), F.length("formatted").cast("long").alias("chars"))
    w = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "lines", "masked"))).alias("w"), F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    w = w.withColumn("masked", F.expr("array_join(transform(w, x -> x.masked), '')"))
    return w.select(
        "conv_id",
        "n_turns",
        F.sha2(F.expr("array_join(transform(w, x -> x.lines), '')"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose two turns consist of control strings."""
    probe = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER c - 1 AS pos, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tok, sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 4) OVER c AS e,
         20 + length(role) + length(text)
           + len(regexp_extract_all(role || chr(1) || text, '\\|</?s>|\[/?INST\]|<</?SYS>>')) AS chars
  FROM t WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
a AS (
  SELECT *, pos = 0 AND role = 'system' AS sys, coalesce(max(e) FILTER (pos = 0 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS aside FROM o),
c AS (SELECT *, greatest(768 - aside, 1) AS room, CAST((e - 1) // greatest(768 - aside, 1) AS BIGINT) AS cell FROM a),
v AS (SELECT *, 2 * cell + CASE WHEN sum(tok) OVER (PARTITION BY conv_id, cell) > room AND e - tok < cell * room THEN 0 ELSE 1 END AS win FROM c),
w AS (SELECT *, 1024 - aside - sum(tok) OVER (PARTITION BY conv_id, win) AS free FROM v),
n AS (
  SELECT a.*, (SELECT count(*) FROM w b LEFT JOIN w p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.pos = b.pos - 1
               WHERE b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.pos IN (a.pos + 1, a.pos + 2) AND b.win <> p.win AND b.e - b.tok - a.e + a.tok <= b.free) AS repeats
  FROM w a),
s AS (
  SELECT conv_id, sum(chars) AS base, sum(CASE WHEN NOT sys THEN chars * repeats ELSE 0 END) AS near,
         coalesce(sum(chars) FILTER (sys), 0) * (count(DISTINCT win) - 1) AS system
  FROM n GROUP BY conv_id)
SELECT s.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (any_value(base) + any_value(near) + any_value(system))::BIGINT AS formatted_chars
FROM s JOIN w ON s.conv_id IS NOT DISTINCT FROM w.conv_id GROUP BY s.conv_id
"""
