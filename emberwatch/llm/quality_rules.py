"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation estimates how right they are.

Everything is DataFrame functions. A rule votes 1 (good), -1 (bad) or 0 (abstains). Vote patterns are counted (at most 3 to
the number of rules, whatever the number of documents), and each round of the estimation is one sum over that small table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.shared import documents, kept

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Where the estimation begins: the chance of each vote on a good and on a bad row, the share of good rows, and how many
#: rows that opinion is worth.
FIRST_RATES = {"good": {-1: 0.01, 0: 0.19, 1: 0.8}, "bad": {-1: 0.4, 0: 0.2, 1: 0.4}}
FIRST_QUALITY, OPINION = 0.8, 10.0
ROUNDS, CLOSE = 40, 1e-4
KEEP_FROM = 0.5

#: name -> (bad if, good if); abstains otherwise. Columns are those of text_measures.
RULES = {
    "length": ("n_words < 50", "n_words >= 80"),
    "repetition": ("n_repeat_words > 0.5 * n_words", "n_repeat_words <= 0.2 * n_words"),
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "repeated_lines": ("n_dup_lines > 0.3 * n_lines", "n_lines >= 2 and n_dup_lines = 0"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 14 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    "distinct_words": ("n_words >= 50 and n_distinct < 0.2 * n_words", "n_distinct >= 0.35 * n_words"),
    "wordless": ("n_wordless > 0.2 * n_words", "n_wordless <= 0.05 * n_words"),
    "letters": ("n_letters < 0.7 * word_chars", "n_letters >= 0.85 * word_chars"),
}


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with long columns n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_letters, n_wordless (words
    without a letter).

    Null texts have no words and count as empty. Columns of these names are replaced. Work and memory are those of the row's own text,
    n log n in its words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    measures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_letters", "n_wordless"]
    base = docs.drop(*measures, "_words", "_lines", "_windows")
    base = base.withColumns(
        {
            "_words": F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
            "_lines": F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        }
    )
    window = "transform(_words, (w, i) -> if(i < size(_words) - 2, xxhash64(w, get(_words, i + 1), get(_words, i + 2)), null))"
    base = base.withColumn("_windows", F.expr(f"if(size(_words) < 3, array(), slice({window}, 1, size(_words) - 2))").cast("array<bigint>"))
    base = base.withColumn("_windows", F.expr("if(size(array_distinct(_windows)) < size(_windows), _windows, cast(array() as array<bigint>))"))
    base = base.withColumn("_windows", F.expr("sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i)))"))
    base = base.withColumn(
        "_windows", F.expr("transform(filter(_windows, (x, k) -> x.h = get(_windows, k - 1).h or x.h = get(_windows, k + 1).h), x -> x.i)")
    )
    covered = """aggregate(sort_array(_windows), named_struct('last', -3, 'n', 0),
        (s, i) -> named_struct('last', i, 'n', s.n + least(3, i - s.last)), s -> s.n)"""
    return base.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr(covered).cast("long"),
            "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
            "n_wordless": F.size(F.filter("_words", lambda w: ~w.rlike(r"\p{L}"))).cast("long"),
            "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long"),
        }
    ).drop("_words", "_lines", "_windows")


def votes(rules: dict[str, tuple[str, str]] = RULES) -> dict[str, Column]:
    """One column per rule: -1, 0 or 1; the bad side wins, and an unknown condition is no vote."""
    return {f"vote_{name}": F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for name, (bad, good) in rules.items()}


def _posterior(rates: dict[str, dict[str, dict[int, float]]], quality: float) -> Column:
    """Probability of good quality given the votes, rules independent."""
    logit = F.lit(math.log(quality / (1 - quality)))
    for name, rate in rates.items():
        odds = {v: math.log(rate["good"][v] / rate["bad"][v]) for v in (-1, 0, 1)}
        logit = logit + F.when(F.col(name) == 1, odds[1]).when(F.col(name) == -1, odds[-1]).otherwise(odds[0])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def estimate(voted: DataFrame, names: list[str]) -> tuple[dict[str, dict[str, dict[int, float]]], float]:
    """How often each rule votes what on good and on bad rows, and the share of good rows, from votes alone.

    Returns rule -> {"good", "bad"} -> vote -> rate, and the share. Without rows: where the estimation begins. A bad vote
    counts for bad and a good vote for good, if at all: rates that say the opposite are set equal.
    """
    patterns = kept(voted.groupBy(*names).agg(F.count("*").alias("_n")), "rule-patterns")
    rates = {name: {side: dict(rate) for side, rate in FIRST_RATES.items()} for name in names}
    quality = FIRST_QUALITY
    for _ in range(ROUNDS):
        weight = {"good": F.col("_n") * F.col("_q"), "bad": F.col("_n") * (1 - F.col("_q"))}
        sums = [F.sum(weight[side]).alias(side) for side in weight]
        for k, name in enumerate(names):
            for side in weight:
                sums += [F.sum(F.when(F.col(name) == v, weight[side]).otherwise(0.0)).alias(f"{side}_{k}_{v}") for v in (-1, 0, 1)]
        got = patterns.withColumn("_q", _posterior(rates, quality)).agg(*sums).first()
        if got["good"] is None:
            break
        before = [quality, *(r[side][v] for r in rates.values() for side in r for v in r[side])]
        for k, name in enumerate(names):
            for side in weight:
                for v in (-1, 0, 1):
                    share = (got[f"{side}_{k}_{v}"] + OPINION * FIRST_RATES[side][v]) / (got[side] + OPINION)
                    rates[name][side][v] = round(max(1e-6, share), 6)
            for v, low, high in ((-1, "good", "bad"), (1, "bad", "good")):
                if rates[name][low][v] > rates[name][high][v]:
                    rates[name][low][v] = rates[name][high][v] = (rates[name][low][v] + rates[name][high][v]) / 2
        quality = round(min(0.999, max(0.001, (got["good"] + OPINION * FIRST_QUALITY) / (got["good"] + got["bad"] + OPINION))), 6)
        after = [quality, *(r[side][v] for r in rates.values() for side in r for v in r[side])]
        if max(abs(a - b) for a, b in zip(before, after, strict=True)) < CLOSE:
            break
    return rates, quality


def score(docs: DataFrame, text_col: str = "text", rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """docs without the text, with text_measures, votes, quality (posterior), base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated windows of three. kept: not base_failed and
    quality of at least KEEP_FROM. Null and empty texts fail. Repeated rows are scored alike, null ids like others.
    """
    ballot = votes(rules)
    rest = [c for c in docs.columns if c != text_col]
    measured = text_measures(docs, text_col).drop(*ballot, "base_failed", "quality", "kept").withColumns(ballot)
    measured = kept(measured.drop(text_col), "rule-votes")
    names = [*ballot]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    # Rows that fail anyway would only teach what the base rule says already.
    rates, quality = estimate(measured.where(~failed), names)
    out = measured.withColumns({"base_failed": failed, "quality": _posterior(rates, quality)})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
    return out.select(*[c for c in rest if c in out.columns], *[c for c in out.columns if c not in rest])


def query(spark, folder: str) -> DataFrame:
    """All documents: measures, the base rule and the verdict."""
    scored = score(documents(spark, folder, "doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op3_quality_rules": (query, None)}
