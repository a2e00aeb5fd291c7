"""Text functions as column expressions. Only Unicode normalisation needs Python (Arrow batches)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ARROWS = ["←", "→", "↑", "↓"]
#: The numerals that volume titles use, and Bengali digits.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
_EDGE = "-.,;:!?\"'`"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; a lambda computes what it captures again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end; Spark's trim takes spaces alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_ws(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_text(text: Column) -> Column:
    """The warm-start key: NFC, then clean_ws. Plain ASCII skips Python's work but not its trip."""
    return clean_ws(_nfc(text))


def meaningful(text: Column, min_chars: int = 20) -> Column:
    return text.isNotNull() & (F.length(text) >= min_chars) & ~stripped(text).isin(ARROWS)


def roman_to_int(s: Column) -> Column:
    up = F.upper(stripped(s))
    table = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    return F.coalesce(table[up], up.try_cast("int"), F.lit(0))


def volume_number(title: Column) -> Column:
    return roman_to_int(F.regexp_extract(title, r"(?i)Volume\s+([IVX]+)\b", 1))


def bengali_to_int(s: Column) -> Column:
    digits = F.regexp_replace(F.translate(s, BENGALI_DIGITS, "0123456789"), "[^0-9]", "")
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda x: F.length(x) > 0)


def sentences_bn(text: Column) -> Column:
    return _kept(F.split(text, r"(?<=[।?!])\s+"))


def sentences_en(text: Column) -> Column:
    return _kept(F.split(text, r"(?<=[.!?])\s+(?=[A-Z\"'(])"))


def sentences(text: Column, lang: Column) -> Column:
    return F.when(lang == "bn", sentences_bn(text)).otherwise(sentences_en(text))


def sentence_kept(s: Column) -> Column:
    """At least three words or 25 characters."""
    return (F.size(F.split(stripped(s), r"(?U)\s+")) >= 3) | (F.length(s) >= 25)


def detect_lang(text: Column) -> Column:
    return F.when(text.rlike("[\\u0980-\\u09FF]"), "bn").otherwise("en")


def _stripped(s: Column) -> Column:
    cls = r"[\-.,;:!?\"'`]"
    return F.regexp_replace(s, f"^{cls}+|{cls}+$", "")


def concept_label(s: Column) -> Column:
    """Lower case, hyphens for white space and underscores; empty if under 2 or over 60 characters."""
    x = F.regexp_replace(F.lower(stripped(F.coalesce(s, F.lit("")))), r"(?U)[\s_]+", "-")
    x = _stripped(F.regexp_replace(x, "-+", "-"))
    return F.when(F.length(x).between(2, 60), x).otherwise("")


def entity_label(s: Column) -> Column:
    x = _stripped(F.regexp_replace(stripped(F.coalesce(s, F.lit(""))), r"(?U)\s+", " "))
    return F.when(F.length(x).between(2, 80), x).otherwise("")


def location(volume: Column, section: Column, chapter: Column, paragraph_idx: Column) -> Column:
    return F.concat_ws(" › ", volume, F.when(F.length(section) > 0, section), chapter, F.concat(F.lit("¶"), (paragraph_idx + 1).cast("string")))


def source_url(base: Column, paragraph_anchor: Column, chapter_anchor: Column) -> Column:
    anchor = F.coalesce(F.when(F.length(paragraph_anchor) > 0, paragraph_anchor), F.when(F.length(chapter_anchor) > 0, chapter_anchor))
    return F.when(anchor.isNull(), base).otherwise(F.concat(base, F.lit("#"), anchor))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def citations(answer: Column) -> Column:
    """The numbers of all [n] marks."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("int"))


def linked_citations(answer: Column, urls: Column, titles: Column) -> Column:
    """Marks within range become links; others are deleted. The marks are taken from the split text, so a link is never read again."""
    parts = F.split(answer, r"(?=\[\d+\])|(?<=\[\d{1,9}\])")
    number = lambda p: F.regexp_extract(p, r"^\[(\d+)\]$", 1).try_cast("int")
    link = lambda p, n: F.concat(F.lit('<a href="'), F.get(urls, n - 1), F.lit('" target="_blank" rel="noopener" title="'), F.get(titles, n - 1), F.lit('">['), n.cast("string"), F.lit("]</a>"))
    return F.array_join(F.transform(parts, lambda p: F.when(~p.rlike(r"^\[\d+\]$"), p).when(number(p).between(1, F.size(urls)), link(p, number(p))).otherwise("")), "")


def sentence_count(text: Column) -> Column:
    return F.greatest(F.size(_kept(F.split(text, "[.!?।]+"))), F.lit(1))


def truncated(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def chapter_summary(text: Column, n: int = 600) -> Column:
    """A model's summary of a chapter without the quotes around it, at most n characters."""
    return F.substring(stripped(F.regexp_replace(stripped(text), '^"+|"+$', "")), 1, n)


def known_item_query(title: Column, first_paragraph: Column, n: int = 600) -> Column:
    """The text that a chapter is asked for by."""
    return F.substring(F.concat(title, F.lit(". "), first_paragraph), 1, n)


def eta_minutes(done: Column, total: Column, seconds: Column) -> Column:
    """Minutes left at the rate so far."""
    return (total - done) / F.greatest(done / F.greatest(seconds, F.lit(1e-6)), F.lit(1e-6)) / 60


def clipped_summary(text: Column, n: int = 400) -> Column:
    """Over n characters: cut at the last space within them."""
    head = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("…"))).otherwise(text)


def highlighted(text: Column, part: Column) -> Column:
    """The first occurrence within ** marks."""
    at = F.instr(text, part)
    return F.when((F.length(part) > 0) & (at > 0), F.concat(F.substr(text, F.lit(1), at - 1), F.lit("**"), part, F.lit("**"), F.substr(text, at + F.length(part)))).otherwise(text)


def distinct_queries(queries: Column, most: int = 4) -> Column:
    """Trimmed, first of those alike without case, at most `most`."""
    q = _kept(queries)
    lower = F.transform(q, lambda x: F.lower(x))
    return F.slice(F.filter(q, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1), 1, most)


def offered_labels(picked: Column, offered: Column, most: int = 6) -> Column:
    return F.slice(F.array_intersect(F.transform(picked, lambda x: F.replace(F.lower(stripped(x)), F.lit(" "), F.lit("-"))), offered), 1, most)


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def valid_user(user: Column) -> Column:
    return user.rlike("^[A-Za-z0-9_-]{1,40}$")


def extractor_tag(model: Column, version: Column) -> Column:
    return F.concat(model, F.lit("@v"), version.cast("string"))


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def trim_passage(text: Column, matched: Column, most: Column, near: int = 40) -> Column:
    """At most about `most` characters of a passage, marked where something is left out.

    A window of `most` characters centred on the first place of the matched sentence, shifted to lie within the text; the head where there is no such
    place; the sentence alone where it is as long as the window. An end that lies within a word moves to the next space inside the window if that is less than
    `near` characters away and outside the sentence. Null texts give null.
    """
    s = F.struct(stripped(text).alias("t"), F.coalesce(matched, F.lit("")).alias("m"), most.cast("int").alias("most"))

    def placed(s: Column) -> Column:
        at = F.when(F.length(s["m"]) > 0, F.instr(s["t"], s["m"]) - 1).otherwise(F.lit(-1))
        return F.struct(s["t"], s["m"], s["most"], F.length(s["t"]).alias("size"), F.length(s["m"]).alias("length"), at.alias("at"))

    def windowed(s: Column) -> Column:
        held, whole = s["at"] >= 0, (s["at"] >= 0) & (s["length"] >= s["most"])
        centred = F.greatest(F.least(F.greatest(s["at"] - F.floor((s["most"] - s["length"]) / 2).cast("int"), F.lit(0)), s["size"] - s["most"]), F.lit(0))
        lo = F.when(whole, s["at"]).when(held, centred).otherwise(0)
        length = F.when(whole, s["length"]).otherwise(s["most"])
        return F.struct(s["t"], s["size"], s["at"], s["length"], lo.alias("lo"), (lo + length).alias("hi"), F.substr(s["t"], lo + 1, length).alias("part"))

    def begun(s: Column) -> Column:
        # the first space of the window, counted from 0
        space = F.instr(s["part"], F.lit(" ")) - 1
        skip = F.when((s["lo"] > 0) & (space > 0) & (space < near) & ((s["at"] < 0) | (s["lo"] + space < s["at"])), space + 1).otherwise(0)
        mark = F.when(s["lo"] > 0, "… ").otherwise("")
        end = F.when(s["at"] >= 0, s["at"] - s["lo"] - skip + s["length"] + F.length(mark)).otherwise(-1)
        return F.struct(s["size"], s["hi"], F.concat(mark, F.substr(s["part"], skip + 1)).alias("shown"), end.alias("end"))

    def ended(s: Column) -> Column:
        # the last space, and whether the sentence ends before it
        last = F.length(s["shown"]) - F.instr(F.reverse(s["shown"]), F.lit(" "))
        cut = s["shown"].contains(" ") & (last > 0) & (F.length(s["shown"]) - last < near) & (last > s["end"])
        return F.when(s["hi"] < s["size"], F.concat(F.when(cut, F.substr(s["shown"], F.lit(1), last)).otherwise(s["shown"]), F.lit(" …"))).otherwise(s["shown"])

    return bound(bound(s, placed), lambda s: F.when(s["size"] <= s["most"], s["t"]).otherwise(bound(bound(bound(s, windowed), begun), ended)))
