"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; its failure is one bit of
``fail_bits`` and its measurement is kept beside it.  A policy is a named,
versioned set of rules, i.e. a mask: applying it is one ``AND``, and what a rule
alone removes (ablation) is a bitwise aggregate over the stored bits, without
another look at the texts.

Defined results: null and empty texts have no words, all measurements are 0 and
they fail ``few_words``; repeated rows are judged one by one; a null id stays
null; an empty table gives an empty ledger; other columns are ignored.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleo.llm.common import WHITE, id_text, map_texts

SYMBOLS = b"#*$%&|<>"
#: Bytes that do not begin a code point, and white space.
_NOT_CHAR = bytes(range(0x80, 0xC0)) + WHITE
WINDOW = 5

#: rule -> condition of failure over the measurements, in bit order.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 15 * word_chars",
    "duplicate_lines": "10 * n_dup_lines > 5 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versions of the policy; the newest is the default.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols"),
    "v2": tuple(RULES),
}
LEDGER = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, "
          "n_repeat_words bigint")


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    repeated = 0
    counts = Counter(windows)
    if len(counts) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return (n, len(text.translate(None, _NOT_CHAR)), len(text) - len(text.translate(None, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), repeated)


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    for b in batches:
        rows = pd.DataFrame([measure(t) for t in b["text"]], columns=names, dtype="int64")
        rows.insert(0, "doc_id", b["doc_id"].array)
        yield rows


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits`` of every document."""
    m = map_texts(id_text(docs), _measured, LEDGER)
    bits: Column = F.lit(0).cast("bigint")
    for name, failing in RULES.items():
        bits = bits + F.when(F.expr(failing), F.lit(BIT[name])).otherwise(0)
    return m.withColumn("fail_bits", bits)


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Verdict of one policy version from the stored bits alone."""
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("fail_bits").bitwiseAND(mask(policy)) == 0)


def ablation(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it removes."""
    own = F.col("fail_bits").bitwiseAND(mask(policy))
    counts = rows.groupBy(own.alias("bits")).count()  # one row for each pattern of bits
    names = POLICIES[policy]
    rule = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("bigint").alias("bit")) for n in names)))
    hit = counts.select("bits", "count", rule.alias("r")).select("bits", "count", "r.rule", "r.bit")
    return hit.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("only_this"))
