"""Language identification by Bayesian evidence fusion.

The posterior of a text's language multiplies three kinds of evidence:

- text: hashed character-trigram likelihoods, tempered by a fitted exponent since trigrams aren't
  independent (the fusion counts a text of n trigrams as at most `weight` of them);
- the language that the markup declares (<html lang>), through P(declared | language);
- a prior by address, smoothed hierarchically: all rows, then the address suffix (last label of the host), then the
  host, each level shrunk to the one above by KAPPA pseudo-rows; the suffix speaks through its level alone.

The last two are tables of soft counts that grouped aggregation computes over all rows from the
text-only posteriors; a row's own share is taken out of its host's counts before it is judged (in those of its suffix
and of its declared language, which many rows share, it stays). The text
model is fitted on at most SAMPLE labelled texts a language, the first in hash order.

Defined cases: a null or empty text gives no text evidence (the priors decide); a text of any length is
scored whole; null url, host or declared language give none of theirs; of equally likely languages the first
by name is taken; without any labelled text every language is equally likely and lang is null; doc_id and
page_id are whole numbers (or what casts to them, else null), and may be null or repeated; an empty table
gives an empty result; extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, modest_batches

SLOTS = 1 << 15
#: Labelled texts a language for fitting.
SAMPLE = 500
#: A text's trigrams count as at most this many independent ones.
WEIGHT = 30.0
KAPPA = 5.0
_STRIP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)
#: What may hold a tag's text without being one, or an <html> or <meta> tag with its attributes.
_HTML = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(?P<tag>html|meta)\b(?P<attrs>(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)", re.S | re.I)
_LANG = [re.compile(rf"\s{name}\s*=\s*[\"']?\s*([A-Za-z]+)", re.I) for name in ("lang", "xml:lang")]
_META = re.compile(r"\shttp-equiv\s*=\s*[\"']?\s*content-language\b", re.I), re.compile(r"\scontent\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)


def declared_of(page: str | None) -> str | None:
    """The language of the page's first <html> tag that has one (lang before xml:lang), or else of its first
    content-language meta tag, wherever it is, in lower case."""
    meta = None
    for m in _HTML.finditer(page or ""):
        if not m["attrs"]:
            continue
        if m["tag"].lower() == "html":
            for name in _LANG:
                if said := name.search(m["attrs"]):
                    return said.group(1).lower()
        elif meta is None and _META[0].search(m["attrs"]) and (said := _META[1].search(m["attrs"])):
            meta = said.group(1).lower()
    return meta


def slots_of(text: str | None) -> np.ndarray:
    """The hash slots of the text's character trigrams (lower case; digits and punctuation are spaces)."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points < 97) | (points > 122) & (points < 192), np.uint32(32), points)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    h = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA6B)) ^ (points[2:] * np.uint32(0xC2B2AE35))
    blank = (points[:-2] == 32) & (points[1:-1] == 32)
    return ((h ^ (h >> np.uint32(15)))[~blank] % np.uint32(SLOTS)).astype(np.int64)


class TextModel:
    """Log-probabilities of trigram slots, by language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.1
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)

    def score(self, text: str | None) -> np.ndarray:
        """Tempered log-likelihood of each language, the largest 0."""
        slots = slots_of(text)
        if not len(slots):
            return np.zeros(len(self.langs))
        total = np.zeros(len(self.langs))
        for i in range(0, len(slots), 1 << 16):
            total += self.table[slots[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
        total *= min(len(slots), WEIGHT) / len(slots)
        return total - total.max()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> TextModel | None:
    """A text model from the first `sample` labelled texts of each language in hash order. Only rows whose
    hash is under a limit that twice as many as needed are expected to pass come to the window, so it doesn't
    grow with the table; a language of few rows has them all."""
    ranked = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"))
    counts = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * max(sample, 100)) / F.col("n"))
    # written first: Spark then knows the table's size, and broadcasts it only if it is small
    limits = cut(counts.select("lang", F.when(share < 1, (share * 2.0**64 - 2.0**63).cast("long")).alias("most")), "language-limits")
    few = ranked.join(limits, "lang").where(F.col("most").isNull() | (F.col("h") <= F.col("most")))
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "k"))).where(F.col("r") <= sample).select("k", "lang")
    texts = labelled.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t")).join(F.broadcast(first), ["k", "lang"], "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lg, t in zip(pdf["lang"], pdf["t"]):
                found.setdefault(lg, np.zeros(SLOTS, np.int64))
                found[lg] += np.bincount(slots_of(t), minlength=SLOTS)
        for lg, c in found.items():
            k = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lg, "slot": k, "n": c[k]})

    rows = texts.select("lang", "t").mapInPandas(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS rows a language
    langs = sorted(rows["lang"].unique())
    if not langs:
        return None
    counts = np.zeros((len(langs), SLOTS))
    counts[rows["lang"].map({g: i for i, g in enumerate(langs)}), rows["slot"]] = rows["n"]
    return TextModel(langs, counts)


def score_rows(df: DataFrame, model: TextModel, text: str, markup: bool) -> DataFrame:
    """df's other columns with ll (array of tempered log-likelihoods) and, from markup, declared."""
    modest_batches(df.sparkSession)
    others = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in others), "declared string, ll array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop(text)
            said = [declared_of(t) if markup else None for t in texts]
            if markup:
                texts = [html.unescape(_STRIP.sub(" ", t or "")) for t in texts]
            yield pdf.assign(declared=said, ll=[model.score(t).tolist() for t in texts])

    return df.mapInPandas(run, schema)


def _soft(col: str, n: int) -> list[Column]:
    return [F.sum(F.col(col)[i]).alias(f"s{i}") for i in range(n)]


def _normal(logs: Column) -> Column:
    """Probabilities from an array of logarithms."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def fuse(scored: DataFrame, langs: list[str], kappa: float = KAPPA) -> DataFrame:
    """scored: columns of the caller with host, suffix, declared, ll. Adds lang, confidence and text_lang."""
    n, every = len(langs), range(len(langs))
    names = F.array(*map(F.lit, langs))
    rows = scored.withColumn("own", _normal(F.col("ll")))
    arr = lambda p: F.array(*(F.coalesce(F.col(f"{p}{i}"), F.lit(0.0)) for i in every))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    hosts = cut(rows.groupBy("host", "suffix").agg(*_soft("own", n)), "language-hosts")
    world = hosts.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in every)).first()
    world = [(world[i] or 0.0) + 1.0 for i in every]
    base = F.array(*(F.lit(x / sum(world)) for x in world))
    # P(language | suffix): the soft counts shrunk to all rows; it serves as the suffix's evidence and as the host prior's parent
    suffixes = hosts.where("suffix IS NOT NULL").groupBy("suffix").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in every)).select("suffix", arr("s").alias("sc"))
    smooth = lambda c, parent: F.zip_with(c, parent, lambda x, p: (x + kappa * p) / (total(c) + kappa))
    suffixes = suffixes.withColumn("sp", smooth(F.col("sc"), base))
    host = hosts.where("host IS NOT NULL").select("host", F.col("suffix").alias("hs"), arr("s").alias("hc")).join(suffixes,
        F.col("hs") == suffixes["suffix"], "left").select("host", "hc", F.coalesce("sp", base).alias("sp"))
    said = rows.where("declared IS NOT NULL").groupBy("declared").agg(*_soft("own", n)).select("declared", arr("s").alias("dc"))
    # P(declared | language) up to a factor: soft counts over the language's total, with half a row of smoothing
    said = said.select("declared", F.zip_with("dc", F.array(*map(F.lit, world)), lambda x, t: (x + 0.5) / (t + 0.5 * n)).alias("dl"))
    joined = rows.join(host, "host", "left").join(said, "declared", "left")
    less = F.zip_with("hc", "own", lambda c, o: F.greatest(F.lit(0.0), c - o))  # without the row itself
    prior = F.when(F.col("hc").isNotNull(), smooth(less, F.col("sp"))).otherwise(base)
    joined = joined.withColumn("prior", prior)
    logs = F.zip_with("ll", "prior", lambda x, p: x + F.ln(p))
    logs = F.when(F.col("dl").isNotNull(), F.zip_with(logs, F.col("dl"), lambda x, d: x + F.ln(d))).otherwise(logs)
    joined = joined.withColumn("posterior", _normal(logs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return joined.withColumn("lang", best(F.col("posterior"))).withColumn("confidence", F.array_max("posterior")).withColumn("text_lang", best(F.col("own")))


def identify(docs: DataFrame | None, pages: DataFrame | None, model: TextModel | None) -> DataFrame:
    """docs (doc_id, text, source) and pages (page_id, url, html), either or both. Per row: doc_id, page_id,
    lang, confidence, text_lang, declared, host. A document's source stands for its host."""
    parts = []
    langs = model.langs if model else ["und"]
    model = model or TextModel(langs, np.ones((1, SLOTS)))
    none = F.lit(None).cast("long")
    if docs is not None:
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), F.col("text").alias("t"))
        parts.append(score_rows(d, model, "t", False))
    if pages is not None:
        host = F.nullif(ascii_lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#:]*)", 1)), F.lit(""))
        p = pages.select(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"), F.col("html").alias("t"))
        parts.append(score_rows(p, model, "t", True))
    scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = fuse(cut(scored, "language-scores"), langs)
    lang = F.when(F.col("lang") != "und", F.col("lang"))
    return out.select("doc_id", "page_id", lang.alias("lang"), F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "host")
