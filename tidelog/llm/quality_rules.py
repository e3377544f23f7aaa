"""Host-level quality rules (operator 1).

Each document is held against rules on its whole text; failures are summed up
by host (the source), each host's failure rate is shrunk towards all hosts by a beta prior
fitted to the hosts' rates (moments), and a host with a shrunk rate over ``HOST_LIMIT`` for any
rule is rejected.  The verdicts are joined back: a document stays if it passes
the base rule and its host isn't rejected.

Only sums per host are shuffled, pre-aggregated; the documents' counts are
kept as a narrow table, so the texts are read once.  A few sums over all hosts
come to the driver.

Defined results: a null text has no words and fails the base rule; a null host
is a host of its own; null or repeated ids are rows as any other; an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 3
HOST_LIMIT = 0.5
STRENGTH = (1.0, 10_000.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = {
    "base": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "lengths": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}


def repeated_words(ws: list[bytes]) -> int:
    """Words in windows of three that are found twice or more, first ones included."""
    windows = list(zip(ws, ws[1:], ws[2:]))
    if len(set(windows)) == len(windows):
        return 0
    n = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if n[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    ws = words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(ws), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(ws))


def with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the counts of each text in place of the text."""
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([counts(t) for t in texts], columns=list(COUNTS), dtype="int64")
    kept = [c for c in docs.columns if c != text_col]
    return docs.select(*kept, counted(F.col(text_col)).alias("_c")).select(*kept, "_c.*")


def beta_prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """Beta parameters whose mean and spread match the hosts' failure rates."""
    n, bad = F.col("n"), F.col(f"bad_{rule}")
    docs, fails, k = hosts.agg(F.sum(n), F.sum(bad), F.count("*")).first()
    if not docs:
        return 0.5, 0.5
    m = fails / docs
    spread = hosts.agg(F.sum(n * (bad / n - m) * (bad / n - m))).first()[0] / docs
    between = spread - k * m * (1 - m) / docs  # without what chance alone would spread
    strength = m * (1 - m) / between - 1 if between > 0 else STRENGTH[1]
    strength = min(max(strength, STRENGTH[0]), STRENGTH[1])
    return m * strength, (1 - m) * strength


def host_verdicts(judged: DataFrame, host_col: str) -> DataFrame:
    """``host, rate_<rule>..., host_rejected``, one row for each host."""
    hosts = kept_table(judged.groupBy(host_col).agg(F.count("*").alias("n"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"bad_{r}") for r in RULES]))
    out = hosts
    for r in RULES:
        a, b = beta_prior(hosts, r)
        out = out.withColumn(f"rate_{r}", (F.col(f"bad_{r}") + a) / (F.col("n") + a + b))
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return out.withColumn("host_rejected", worst > HOST_LIMIT).select(F.col(host_col).alias("_host"), *[f"rate_{r}" for r in RULES], "host_rejected")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each document: its counts, ``base_failed``, its host's shrunk rates, ``host_rejected`` and ``kept``."""
    counted = with_counts(docs.select(id_col, host_col, text_col), text_col)
    judged = kept_table(counted.select("*", *[F.expr(rule).alias(f"fails_{r}") for r, rule in RULES.items()]))
    hosts = kept_table(host_verdicts(judged, host_col))
    out = judged.join(hosts, F.col(host_col).eqNullSafe(F.col("_host"))).drop("_host")
    return out.select(id_col, host_col, *COUNTS, F.col("fails_base").alias("base_failed"), *[f"rate_{r}" for r in RULES], "host_rejected",
                      (~F.col("fails_base") & ~F.col("host_rejected")).alias("kept"))
