"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained in numpy from a small labelled table, made by the rule of `labelled`; its weights have a fixed size and travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host and path prefix, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words that made-up hosts and paths of the labelled URLs are put together from.
BAD = "adult ads bets bonus casino cams cheap clicks crack dates escort farm free gamble jackpot keygen loans lottery pills poker porn prize promo replica slots spam toto track viagra warez win xxx".split()
GOOD = "archive art atlas bakery bird book bridge bulletin chess choir city clinic club college cook county daily dental family field film forum garden health history home house island journal lake law library light market math museum music news nursery open park photo physics press recipe review river sailing school science sport story studio teacher theatre town trail travel village weather wiki wood".split()
_SYLLABLES = "ba be ca co da de el en er fi ga ha he in ing is ka la le li lo ly ma me mi mo na ne no on or ou ra re ri ro sa se sh so ta te th ti to tion tra ul un va ve vi wa we".split()
_PATHS = ["", "/", "/about", "/contact", "/index.html", "/{l}/{n}", "/{l}/{n}.html", "/{l}/{n}/", "/{n}", "/{n}.html", "/20{y}/{m}/{w}", "/{w}/{n}", "/blog/{w}-{w}", "/{w}/{w}.html", "/tag/{w}", "/static/{n}.png"]


def labelled(n: int = 2_000, seed: int = 5) -> list[tuple[str, int]]:
    """n made-up URLs, 1 for those to block: half of the hosts hold one or two words of BAD, the others words of GOOD or of syllables.

    Schemes, sub-domains, endings and most paths are drawn alike for both, so they tell nothing; a tenth of the paths to block name a word of BAD.
    """
    rng = np.random.default_rng(seed)
    pick = lambda x: str(rng.choice(x))
    made = lambda: "".join(rng.choice(_SYLLABLES, rng.integers(2, 5)))
    out = []
    for i in range(n):
        bad = i % 2
        other = lambda: made() if rng.random() < 0.5 else pick(GOOD)
        words = [pick(BAD), pick(BAD) if rng.random() < 0.6 else other()] if bad else [other() for _ in range(rng.integers(1, 3))]
        host = pick(["", "-"]).join(rng.permutation(words))
        host = pick(["", "", "www.", "m.", "blog.", "shop.", "en."]) + host + pick(["", "", str(rng.integers(0, 100))]) + pick([".com", ".org", ".net", ".info", ".example.com", ".example.org", ".example.net", ".co.uk", ".de", ".fr"])
        path = pick(_PATHS)
        while "{" in path:
            at = path.index("{")
            path = path[:at] + {"l": pick(["en", "de", "fr", "es", "it"]), "n": str(rng.integers(0, 100_000)), "y": f"{rng.integers(0, 25):02d}", "m": f"{rng.integers(1, 13):02d}", "w": other()}[path[at + 1]] + path[at + 3 :]
        if bad and rng.random() < 0.1:
            path = f"/{pick(BAD)}{path}"
        out.append((f"{pick(['http', 'https'])}://{host}{path}" + pick(["", "", "?page=2", "#top", "?ref=x&id=7"]), bad))
    return out


BUCKETS, WIDTHS = 1 << 16, (3, 4, 5)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the character n-grams, host and path apart; repeats count once."""
    out = []
    for salt, text in ((1, host), (2, path)):
        codes = np.frombuffer(f"^{text}$".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for width in WIDTHS:
            if len(codes) >= width:
                h = np.full(len(codes) - width + 1, salt * 1_000_003 + width, np.uint64)
                for k in range(width):
                    h = (h ^ codes[k : len(codes) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append(h % np.uint64(BUCKETS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.empty(0, np.int64)


def split(url: str) -> tuple[str, str]:
    import re

    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]


def fitted(rows: Sequence[tuple[str, int]], steps: int = 300, rate: float = 20.0, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias, by full-batch gradient steps; the same on every run."""
    found = [features(*split(u)) for u, _ in rows]
    y = np.array([label for _, label in rows], float)
    sizes = np.array([len(r) for r in found])
    at, of = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        z = np.bincount(of, w[at], len(found)) * scale + bias
        off = (1 / (1 + np.exp(-z)) - y) / len(y)
        w -= rate * (np.bincount(at, (off * scale)[of], BUCKETS) + decay * w)
        bias -= rate / 40 * off.sum()
    return w, float(bias)


@lru_cache(maxsize=4)
def trained() -> tuple[np.ndarray, float]:
    return fitted(labelled())


def score_of(weights: np.ndarray, bias: float, host: str, path: str) -> float:
    f = features(host, path)
    return float(1 / (1 + np.exp(-(weights[f].sum() / max(1, len(f)) ** 0.5 + bias))))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = tuple(RULES), threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score.

    A null URL or one without `://` has an empty host and path, which fit no rule, so the model judges its bias. score is the model's
    probability to block, null where a rule decides. Repeated rows are judged each; an empty table gives no rows; further columns are ignored.
    """
    w, bias = trained()

    @F.pandas_udf("double")
    def block(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[str, str], float] = {}
        for hosts, paths in rows:
            if len(known) > 100_000:
                known.clear()
            for k in set(zip(hosts, paths)) - known.keys():
                known[k] = score_of(w, bias, *k)
            yield pd.Series([known[k] for k in zip(hosts, paths)], dtype="float64")

    host, path = parts(F.col(url_col))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    p = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    ruled = p.where("rule IS NOT NULL").select(id_col, "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    other = p.where("rule IS NULL").withColumn("score", block("host", "path"))
    other = other.select(id_col, "host", "path", "rule", F.when(F.col("score") >= threshold, "block").otherwise("allow").alias("verdict"), "score")
    return ruled.unionByName(other)
