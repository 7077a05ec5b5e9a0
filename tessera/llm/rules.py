"""Operator 7: quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import SPACES, discard, durable, fresh, let, words


@dataclass(frozen=True)
class Rule:
    """``rejects``: a boolean column; ``cost``: the seconds that testing a row takes, or any other unit if all rules give it; estimated if not given."""

    name: str
    rejects: Column
    cost: float | None = None


def repeated_window_words(tokens: Column, width: int = 8) -> Column:
    """Number of words that lie in a window of ``width`` words found twice or more in the same array.

    Windows are told apart by 64-bit hashes. Windows equal to a neighbour in the order of (hash, position) are repeated;
    the words under them are counted from the gaps between their positions.
    """

    def covered(at: Column) -> Column:
        gaps = F.aggregate(F.sequence(F.lit(2), F.size(at)), F.lit(0), lambda acc, k: acc + F.least(F.lit(width), F.element_at(at, k) - F.element_at(at, k - 1)))
        return F.when(F.size(at) < 2, F.lit(0)).otherwise(gaps + width)

    def repeats(pairs: Column) -> Column:
        same = lambda k, j: F.element_at(pairs, k)["h"] == F.element_at(pairs, j)["h"]
        hit = F.transform(
            F.sequence(F.lit(1), F.size(pairs)),
            lambda k: F.when((k > 1) & same(k, F.greatest(k - 1, F.lit(1))) | (k < F.size(pairs)) & same(k, F.least(k + 1, F.size(pairs))), F.element_at(pairs, k)["p"]),
        )
        return let(F.array_sort(F.filter(hit, lambda p: p.isNotNull())), covered)

    def tally(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), (k + 1).alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, repeats))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    return F.when(F.size(tokens) <= width, F.lit(0)).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda w: let(windows(w), tally))).cast("long")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text; null has none."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    found, kept = fresh(df, "_words"), fresh(df, "_lines")
    df = df.withColumns({found: words(F.col(text)), kept: lines})
    return df.withColumns(
        {
            "n_words": F.size(found).cast("long"),
            "word_chars": F.length(F.array_join(found, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long"),
            "n_lines": F.size(kept).cast("long"),
            "n_dup_lines": (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"),
            "n_repeat_words": repeated_window_words(F.col(found)),
        }
    ).drop(found, kept)


def default_rules(text: str = "text") -> list[Rule]:
    """The rules beyond the base: symbols, repeated lines, word length, exclamation marks, letters, capitals."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        Rule("word_length", (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 12)),
        Rule("exclamations", count("!") * 10 > F.col("n_words") * 3),
        Rule("letters", count(r"\p{L}") * 2 < F.col("word_chars")),
        Rule("capitals", count(r"\p{Lu}") * 2 > F.col("word_chars")),
    ]


def seconds(job: Callable[[], object], times: int = 2) -> float:
    """The least time of some runs."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        job()
        took.append(time.perf_counter() - began)
    return min(took)


def estimated_costs(sample: DataFrame, rules: Sequence[Rule], rows: int, repeats: int = 10) -> list[float]:
    """Seconds that each rule takes for a row of ``sample``, which holds ``rows``: of a job that tests every row ``repeats`` times, without those of one that only reads them."""
    many = sample.withColumn(fresh(sample, "_again"), F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    texts = [F.length(c) for c, kind in sample.dtypes if kind == "string"]
    idle = seconds(lambda: many.agg(F.count("*"), *(F.sum(x) for x in texts)).collect())
    tested = [seconds(lambda: many.agg(F.count_if(r.rejects), *(F.sum(x) for x in texts)).collect()) for r in rules]  # noqa: B023
    return [max(t - idle, 1e-3) / max(rows * repeats, 1) for t in tested]


def cascade_order(measured: DataFrame, rules: Sequence[Rule], rows: int | None = None) -> list[Rule]:
    """The rules in falling order of rejected share per cost on a sample, of ``rows`` if they are known; equal ones in the given order.

    Costs that aren't given are timed, so that two close rules may change places from run to run.
    """
    row = measured.agg(F.count("*").alias("n"), *(F.avg(r.rejects.cast("double")).alias(f"s{k}") for k, r in enumerate(rules))).first()
    given = [r.cost for r in rules]
    costs = given if None not in given else estimated_costs(measured, rules, rows or row["n"])
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -(row[f"s{k}"] or 0.0) / max(costs[k], 1e-12))]


def quality_cascade(df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", sample_rows: int = 4_000, min_words: int = 20, max_repeat_percent: int = 30, seed: int = 7) -> DataFrame:
    """``df`` with the measures, base_failed, failed_rule and kept.

    A row fails the base with under ``min_words`` words or with more than ``max_repeat_percent`` % of them in repeated
    windows. Rows that pass go through the rules in the order of cascade_order(), by costs and rejected shares on about ``sample_rows`` rows, and stop at the first that rejects them;
    ``failed_rule`` names it ("base" for the base, null for kept rows). The order decides only the work and
    that name, never ``kept``. A null or empty text has no words and fails the base. Repeated rows give repeated rows; a table
    without rows gives none; columns of ``df`` that have the names of new ones are replaced.
    """
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    rules = list(rules) if rules is not None else default_rules(text)
    # A Bernoulli sample is about as large at any number of rows. The rules are tested on those of its rows that pass the base.
    drawn = durable(measures(df.sample(min(1.0, sample_rows / max(df.count(), 1)), seed), text).where(~base))
    rules = cascade_order(drawn, rules)
    discard(drawn)
    out = measures(df, text).withColumn("base_failed", base)
    stop = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        stop = stop.when(rule.rejects, F.lit(rule.name))
    return out.withColumn("failed_rule", stop).withColumn("kept", F.col("failed_rule").isNull())
