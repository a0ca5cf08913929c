"""Quality rules on documents and on their hosts.

A document is measured on its own; its failures are then counted by host (the ``source`` column). A host's rate of each
rule is shrunk towards the rate of all hosts with a beta prior that is fitted to the hosts themselves, so a host with few
documents isn't judged by chance. The verdict is joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, stored, whole_text, words

WINDOW = 5
MIN_WORDS = 10
#: Rules counted by host; the first two make up ``base_failed``.
RULES = ("short", "repeats", "symbols", "lines")
#: A host above the first rate is rejected whole; above the second, those of its documents that break the rule.
HOST_RATE, SUSPECT_RATE = 0.5, 0.2
#: Usual limits of ``by_odds``: symbols a word and the share of repeated lines; how many log odds a document's own log excess counts.
SYMBOL_RATE, LINE_SHARE, OWN_WEIGHT = 0.1, 0.3, 4.0


def _windows(ws: Column) -> Column:
    """A hash for each run of five words."""
    at = F.sequence(F.lit(0), F.size(ws) - WINDOW)
    return F.when(
        F.size(ws) >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))


def _twice(x: Column, k: Column) -> Column:
    """Whether the k-th of the sorted windows ``_p`` is found again next to it: equal hashes are compared word by word."""

    def same(b: Column) -> Column:
        return (x["h"] == b["h"]) & (F.slice("_w", x["i"] + 1, WINDOW) == F.slice("_w", b["i"] + 1, WINDOW))

    before = (k > 0) & same(F.get("_p", k - 1))
    after = (k < F.size("_p") - 1) & same(F.get("_p", k + 1))
    return before | after


def measures(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _lines (lines not blank) to the columns in ``carry``."""
    carry = df.columns if carry is None else carry
    body = F.col("_t")
    df = df.select(*[F.col(c) for c in carry], whole_text(text).alias("_t")).select(*carry, "_t", words(body).alias("_w"))
    lines = F.filter(F.split(body, "\n"), lambda s: F.btrim(s, F.lit(SPACE)) != "")
    df = df.select(
        *carry, "_w", _windows(F.col("_w")).alias("_g"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    df = df.select(
        *carry, "_w", "n_words", "word_chars", "n_symbols", F.size("_l").cast("long").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.col("_g")).alias("_g"),
    )
    df = df.withColumn("_p", F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", F.array_sort(F.transform(F.filter("_p", _twice), lambda x: x["i"])))
    gaps = F.transform("_s", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_s"), k + 1) - s, F.lit(WINDOW))))
    n_repeat = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long")
    df = df.withColumn("n_repeat_words", n_repeat).drop("_w", "_g", "_p", "_s")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _broken() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": F.col("n_symbols") > n,
        "lines": F.col("n_dup_lines") > F.lit(0.3) * n,
    }


def _excess() -> dict[str, Column]:
    """How far a document is beyond the usual limit of each rule: over 1 if it breaks it. Shares are compared as odds."""

    def odds(part: Column, whole: Column, limit: float) -> Column:
        return F.try_divide(part, whole - part) / F.lit(limit / (1 - limit))

    n, lines = F.col("n_words"), F.col("_lines")
    return {
        "short": F.lit(float(MIN_WORDS)) / F.greatest(n, F.lit(1)),
        "repeats": F.when(F.col("n_repeat_words") >= n, F.lit(1e6)).otherwise(odds(F.col("n_repeat_words"), n, 0.2)),
        "symbols": F.try_divide(F.col("n_symbols"), n) / F.lit(SYMBOL_RATE),
        "lines": odds(F.col("n_dup_lines"), lines, LINE_SHARE),
    }


def _usual() -> dict[str, Column]:
    return {f"usual_{r}": F.coalesce(x > 1, F.lit(False)) for r, x in _excess().items()}


def _likely_junk() -> Column:
    """Whether host and document together have odds over one: the host's log odds plus the weighted log excess."""
    found = F.lit(False)
    for r, x in _excess().items():
        rate = F.col(f"rate_usual_{r}")
        log_odds = F.log((rate + 1e-6) / (1 - rate + 1e-6)) + F.lit(OWN_WEIGHT) * F.log(x)
        found = found | F.coalesce(log_odds > 0, F.lit(False))
    return found


def host_rates(measured: DataFrame, host: str = "source", rules: dict[str, Column] | None = None) -> DataFrame:
    """One row per host (null: a host of its own): its documents and the shrunk rate of each rule.

    The prior of a rule is the beta distribution with the mean and, as far as it exceeds chance, the variance of the
    hosts' rates, each host counted by its documents.
    """
    rules = _broken() if rules is None else rules
    counts = stored(
        measured.groupBy(F.col(host).alias("_host")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(broken.cast("long")).alias(f"f_{r}") for r, broken in rules.items()]
        )
    )
    total = counts.agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"), *[F.sum(f"f_{r}").alias(f"t_{r}") for r in rules])
    joined = counts.join(F.broadcast(total))  # one row
    mean = {r: F.col(f"t_{r}") / F.col("docs") for r in rules}
    spread = joined.agg(
        *[
            (F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - mean[r], 2)) / F.sum("n")).alias(f"v_{r}") for r in rules
        ]
    )
    joined = joined.join(F.broadcast(spread))
    rates = []
    for r in rules:
        chance = mean[r] * (1 - mean[r])
        # variance of the true rates: what is left after the sampling variance of the hosts' rates
        true_v = F.greatest(F.col(f"v_{r}") - chance * F.col("hosts") / F.col("docs"), F.lit(1e-12))
        strength = F.least(F.greatest(chance / true_v - 1, F.lit(2.0)), F.lit(1000.0))
        rates.append(((F.col(f"f_{r}") + strength * mean[r]) / (F.col("n") + strength)).alias(f"rate_{r}"))
    return joined.select("_host", "n", *rates)


def quality_rules(
    df: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None,
    host_rate: float = HOST_RATE, suspect_rate: float = SUSPECT_RATE, by_odds: bool = False,
) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept`` to the columns in ``carry`` (default: all of ``df``).

    kept is false if base_failed, if a rule's shrunk rate at the host is over ``host_rate``, or if the document breaks a
    rule whose shrunk rate at its host is over ``suspect_rate``. With ``by_odds`` also if, for one rule at its usual limit, the
    host's shrunk rate and the document's own excess together make junk likelier than not: each host has its own threshold,
    which moves with its rate, and what is far over the limit goes at an average host too. A null text has no words and fails; a null host is a host.
    Rows stay as they are, repeated ones too; columns of ``df`` with the names of measures are replaced.
    """
    carry = [c for c in (df.columns if carry is None else carry) if c not in MEASURES]
    own = {c: f"c{i}" for i, c in enumerate(carry)}  # free of clashes with the working columns
    df = df.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(host).alias("_h"), F.col(text).alias("_text"))
    measured = stored(measures(df, "_text", [*own.values(), "_h"]))
    rates = stored(host_rates(measured, "_h", _broken() | (_usual() if by_odds else {})))  # its size is then known before the join, so that few hosts don't shuffle the texts
    joined = measured.join(rates, measured["_h"].eqNullSafe(rates["_host"]), "left")
    bad_host = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > host_rate
    suspect = F.lit(False)
    for r, broken in _broken().items():
        suspect = suspect | (broken & (F.col(f"rate_{r}") > suspect_rate))
    if by_odds:
        suspect = suspect | _likely_junk()
    return joined.select(*[measured[n].alias(c) for c, n in own.items()], *MEASURES[:-1], (~F.col("base_failed") & ~bad_host & ~suspect).alias("kept"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
