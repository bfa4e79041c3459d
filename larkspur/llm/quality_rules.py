"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and one failure bit per
rule. Policies are versioned masks over these bits, so a new policy, or the ablation of a rule, needs
no second look at the texts: it is a bitwise test, and ablations run on counts per distinct bit
pattern (at most 2 ** rules rows).

The rule no_letters counts a-z, A-Z and every character beyond ASCII as a letter, so that it holds in any
script.

Defined cases: a null or empty text has no words and fails the base rules; a text of any length is measured
whole; doc_id may be null or repeated (each row gets its own ledger row); extra columns pass through, whatever
their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, modest_batches

#: Rules in bit order: name, and the condition of failing over the ledger's measurements.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("mean_word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("no_letters", "n_words > 0 AND 100 * n_letters < 50 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_words"]
#: Policy versions: the bits that reject a document.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "v2": (1 << len(RULES)) - 1,
}
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long"
NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly \\x20 and \\x09-\\x0D
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        seen, twice = set(), set()
        for t in triples:
            (twice if t in seen else seen).add(t)
        last = -1  # words up to here are counted
        for i, t in enumerate(triples):
            if t in twice:
                repeated += i + 3 - max(i, last)
                last = i + 3
    ascii_letters = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = ascii_letters + (len(text) - len(text.encode("ascii", "ignore")))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), letters


def _measured(df: DataFrame, text: str, keep: list[str], with_text: bool) -> DataFrame:
    """One pass over the texts: the columns `keep` as k0, k1, ..., the text as t if asked for, the
    measurements and fail_bits. Inner names can't clash with the caller's."""
    modest_batches(df.sparkSession)
    cols = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    kinds = [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["t string"] * with_text

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([measure_text(x) for x in pdf["t"]], columns=NAMES, index=pdf.index, dtype="int64")
            yield pd.concat([pdf if with_text else pdf.drop(columns="t"), found], axis=1)

    out = df.select(*cols, F.col(f"`{text}`").alias("t")).mapInPandas(rows, ", ".join([*kinds, MEASURES]))
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return out.withColumn("fail_bits", bits.cast("int"))


def ledger(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text, if None) with the measurements and fail_bits of each row. A
    kept column whose name is one of the ledger's gets the prefix input_."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    own = {*NAMES, "fail_bits", "base_failed", "kept"}
    names = [f"input_{c}" if c.lower() in own else c for c in keep]
    out = _measured(df, text, keep, False)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), *NAMES, "fail_bits")


def stored(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """ledger(), written to the shared folder: every policy and ablation reads the stored bits."""
    return cut(ledger(df, text, keep), "quality-ledger")


def apply_policy(led: DataFrame, policy: str | int = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy's mask."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    hit = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    return led.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit(BASE | mask))


def ablation(led: DataFrame, policy: str | int = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that would be kept without it."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & mask))
    one = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    failed, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return one.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only_this"),
        F.coalesce(F.sum(F.when(alone | (F.col("bits") == 0), F.col("n"))), F.lit(0)).alias("kept_without"),
    )


def judge(df: DataFrame, text: str = "text", policy: str | int = "v1") -> DataFrame:
    """df's rows that the policy keeps, with df's columns; the texts pass through the measuring pass, so
    nothing is joined back."""
    mask = BASE | (POLICIES[policy] if isinstance(policy, str) else policy)
    keep = [c for c in df.columns if c != text]
    kept = _measured(df, text, keep, True).where(F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)
    at = {c: f"k{i}" for i, c in enumerate(keep)} | {text: "t"}
    return kept.select(*(F.col(at[c]).alias(c) for c in df.columns))
