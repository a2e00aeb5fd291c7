"""Question answering around pluggable models: plans, prompts under a budget, orchestration."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as T


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, passages: list[str]) -> list[float]: ...


def generated(prompts: DataFrame, make: Callable[[], Generator], prompt_col: str = "prompt", out: str = "answer") -> DataFrame:
    """Adds a model's output; the model is made once per task and called by batch."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in it:
            yield pd.Series(model.generate(s.tolist()), dtype=object)

    return prompts.withColumn(out, run(prompt_col))


def extracted(texts: DataFrame, make: Callable[[], Generator], prompt: Callable[[str], str], strict: Callable[[str], str], text_col: str = "text") -> DataFrame:
    """Model output per text, asked once more with a stricter prompt where no object can be found."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in it:
            got = model.generate([prompt(x) for x in s])
            again = [i for i, x in enumerate(got) if jsonx.balanced_block(x) is None]
            for i, x in zip(again, model.generate([strict(s.iloc[i]) for i in again]) if again else []):
                got[i] = x
            yield pd.Series(got, dtype=object)

    return texts.withColumn("raw", run(text_col)).withColumn("parsed", jsonx.parsed_extraction(F.col("raw")))


def hashed_vectors(text: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for an encoder: counts of hashed words, normalised. It carries no meaning."""

    @F.pandas_udf("array<double>")
    def counted(slots: pd.Series) -> pd.Series:
        out = []
        for s in slots:
            x = np.bincount(s, minlength=dim).astype(float) if s is not None and len(s) else np.zeros(dim)
            out.append(x / max(np.sqrt((x * x).sum()), 1e-12))
        return pd.Series(out)

    return counted(F.transform(T.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")))


def lexical_score(query: Column, text: Column) -> Column:
    """Stand-in for a reranker: the share of the query's distinct words in the passage."""
    q = F.array_distinct(T.tokens(query))
    return F.size(F.array_intersect(q, T.tokens(text))) / F.greatest(F.size(q), F.lit(1))


def plans(raw: DataFrame, question: str = "question", output: str = "raw", offered: str = "offered", lang: str | None = None) -> DataFrame:
    """(…, ok, queries, concepts, bridge_note, lang) from model output; broken output gives a plan that is not ok."""
    raw = raw.withColumn("_plan", jsonx.parsed_plan(F.col(output)))
    p = F.col("_plan")
    q = T.distinct_queries(F.coalesce(p["timeless_queries"], F.array().cast("array<string>")))
    return raw.withColumns({"ok": p.isNotNull(), "queries": q, "concepts": T.offered_labels(F.coalesce(p["concepts"], F.array().cast("array<string>")), F.col(offered)), "bridge_note": F.substring(F.coalesce(T.stripped(p["bridge_note"]), F.lit("")), 1, 300), "lang": T.detect_lang(F.col(question))}).drop("_plan")


def packed(blocks: DataFrame, keys: list[str], order: list, length: Column, budget: Column) -> DataFrame:
    """The leading blocks of each key whose lengths, plus two each, stay within the budget; packing stops at the first that does not fit, and the first is always kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    b = blocks.withColumns({"n": F.row_number().over(w), "used": F.sum(length + 2).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return b.where((F.col("n") == 1) | (F.col("used") <= budget))


@dataclass(frozen=True)
class Template:
    """What stands around the sources of a prompt. `question`, `bridge`, `sources`, `language` and `opening` in braces are filled in."""

    body: str = "Question: {question}\n{bridge}\nSources, each under its number:\n\n{sources}\n\nAnswer in {language} from these sources alone and cite them as [n]. {opening}\n\nQuestion: {question}"
    bridge: str = "\nThe question's terms are modern. {note}"
    related: str = " (related: {concepts})"
    openings: tuple[str, str] = ("Answer directly.", "Begin with a sentence that leads from today's terms to the sources.")
    languages: tuple[str, str] = ("English", "Bengali (বাংলা)")

    def filled(self, **parts: Column) -> Column:
        out = []
        for i, piece in enumerate(re.split(r"\{(\w+)\}", self.body)):
            out.append(parts[piece] if i % 2 else F.lit(piece))
        return F.concat(*out)


def prompts(hits: DataFrame, plans: DataFrame, template: Template = Template(), max_context: int = 1200, max_prompt: int = 15_000) -> DataFrame:
    """(question, prompt, n_sources): the question, its bridge block and the numbered passages, best first, under the budget.

    hits: question, rank, lang, location, text, matched; plans: question, bridge_note, concepts, lang. The budget is what the prompt without sources leaves; the first
    source is always kept, and packing stops at the first that does not fit, so the sources are numbered from 1 without a gap.
    """
    note = F.coalesce("bridge_note", F.lit(""))
    named = F.when(F.size("concepts") > 0, F.concat(F.lit(template.related.split("{concepts}")[0]), F.array_join("concepts", ", "), F.lit(template.related.split("{concepts}")[1]))).otherwise("")
    before, after = template.bridge.split("{note}")
    bridge = F.when(F.length(note) > 0, F.concat(F.lit(before), note, F.lit(after), named, F.lit("\n"))).otherwise("")
    p = plans.select("question", bridge.alias("_bridge"), F.when(F.length(note) > 0, template.openings[1]).otherwise(template.openings[0]).alias("_opening"), F.when(F.col("lang") == "bn", template.languages[1]).otherwise(template.languages[0]).alias("_language"))
    whole = lambda sources: template.filled(question=T.stripped(F.col("question")), bridge=F.col("_bridge"), sources=sources, language=F.col("_language"), opening=F.col("_opening"))
    p = p.withColumn("_room", F.lit(max_prompt) - F.length(whole(F.lit(""))))
    h = hits.withColumn("passage", T.trim_passage(F.col("text"), F.col("matched"), F.lit(max_context))).join(p, "question")
    name = F.when(F.col("lang") == "bn", "Bengali").otherwise("English")
    h = h.withColumn("block", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), name, F.lit(") "), F.col("location"), F.lit("\n"), F.col("passage")))
    kept = packed(h, ["question"], ["rank"], F.length("block"), F.col("_room"))
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("_sources")
    rows = kept.groupBy("question", "_bridge", "_opening", "_language").agg(blocks, F.count("*").alias("n_sources"))
    return rows.select("question", whole(F.col("_sources")).alias("prompt"), "n_sources")


def chapter_summaries(notes: DataFrame, make: Callable[[], Generator], prompt: Callable[[str, list[str]], str]) -> DataFrame:
    """(chapter, summary): a model's summary of each chapter from its paragraphs' summaries. notes: chapter, title, notes (joined by `||`)."""

    @F.pandas_udf("string")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for titles, held in it:
            yield pd.Series(model.generate([prompt(t or "", (x or "").split("||")) for t, x in zip(titles, held)]), dtype=object)

    return notes.select("chapter", T.chapter_summary(run("title", "notes")).alias("summary"))


def verified_pairs(pairs: DataFrame, make: Callable[[], Generator], prompt: Callable[[str, str], str]) -> DataFrame:
    """Adds `same`: whether a model says yes to two chapters being one text in two languages. pairs: a_text, b_text."""

    @F.pandas_udf("string")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for a, b in it:
            yield pd.Series(model.generate([prompt(x or "", y or "") for x, y in zip(a, b)]), dtype=object)

    return pairs.withColumn("same", F.lower(T.stripped(run("a_text", "b_text"))).startswith("yes"))


class Echo:
    """A deterministic stand-in for a model: the last line of the prompt."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.rstrip().rsplit("\n", 1)[-1] for p in prompts]


#: Ways to make a model, by name; callers add their own.
BACKENDS: dict[str, Callable[[], Generator]] = {"echo": Echo}


def backend(names: list[str]) -> Callable[[], Generator]:
    """The first of the named backends that can be made; an error that names all where none can."""
    faults = []
    for name in names:
        if name not in BACKENDS:
            faults.append(f"{name}: unknown")
            continue
        try:
            BACKENDS[name]()
            return BACKENDS[name]
        except Exception as e:  # what a model needs may be missing
            faults.append(f"{name}: {e}")
    raise RuntimeError("; ".join(faults) or "no backend is named")


def ask(question: str, retrieve: Callable[[str], DataFrame], answer: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Blank questions are refused; without hits the model is not called and there is no answer."""
    if not question.strip():
        raise ValueError("the question is blank")
    hits = retrieve(question.strip())
    return answer(hits) if hits.limit(1).count() else None
