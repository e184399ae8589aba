"""Quality rules as weak supervision: rules vote or abstain, their accuracies come from the votes alone.

Each rule of ``RULES`` says good (1), bad (0) or nothing (null) about a document. Given the true quality the
rules are taken as independent, so expectation-maximisation over the counts of vote patterns estimates how
often each rule says good, bad or nothing on good and on bad documents, and the share of good ones. A
document's score is the posterior probability of being good; no single rule decides.

Scale: one pass over the texts writes a narrow row of measures per document (with the whole row where it is
kept for a filter); patterns are counted with partial aggregation, and at most 3 ** len(RULES) of them come
to the driver, whatever the corpus. The posterior is then a column expression: no join, no shuffle of rows.

Cases: a null or blank text has no words, so its measures are zero; repeated rows are scored alike; extra
columns pass through, also those with names used here; an empty table gives an empty result; a null
document id is kept as it is. Ties at 0.5 are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickforge.llm.common import WORDS, free_name, let, whole, words_of
from clickforge.session import materialize

SYMBOLS = "#*$%&|<>"
ROUNDS = 25

# where the estimate starts: the share of good documents, then of each vote on good and on bad ones
PRIOR = 0.8
START_GOOD = {1: 0.01, 0: 0.005, None: 0.985}
START_BAD = {1: 0.005, 0: 0.25, None: 0.745}

# rule: (measure, bad above, good up to or None where it never says good); "-" turns the measure's sign
RULES = {
    "length": ("-n_words", -50, None),
    "repeats": ("n_repeat_words / n_words", 0.4, None),
    "clean_prose": ("(n_symbols + n_capitals + n_dup_lines) / n_words", 1.5, 0.0),
    "symbols": ("n_symbols / n_words", 0.25, None),
    "lines": ("n_dup_lines / n_lines", 0.5, None),
    "capitals": ("n_capitals / word_chars", 0.3, None),
    "short_words": ("-word_chars / n_words", -2.0, None),
    "long_words": ("word_chars / n_words", 15.0, None),
}


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, each word once."""

    def covered(found: Column) -> Column:
        return F.when(F.size(found) == 0, F.lit(0)).otherwise(
            F.aggregate(
                F.transform(
                    F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))),
                    lambda at, k: F.least(F.lit(3), at - F.get(found, k)),
                ),
                F.lit(3), lambda a, x: a + x,
            )
        )

    def repeated(grams: Column) -> Column:
        ordered = let(F.sort_array(grams), lambda s: F.array_distinct(F.filter(s, lambda x, i: x.eqNullSafe(F.get(s, i + 1)))))
        placed = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        return let(ordered, lambda twice: let(
            # a few repeated windows are looked up; with many, equal ones are found as neighbours in order
            F.when(F.size(twice) <= 16, F.filter(placed, lambda x: F.array_contains(twice, x["g"])))
            .otherwise(let(F.sort_array(placed), lambda s: F.filter(
                s, lambda x, i: F.get(s, i - 1)["g"].eqNullSafe(x["g"]) | F.get(s, i + 1)["g"].eqNullSafe(x["g"])
            ))),
            lambda found: let(F.sort_array(F.transform(found, lambda x: x["i"])), covered),
        ))

    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(repeated(g)))


def measures(text: Column) -> Column:
    """Struct of the counts that the rules look at, all from the whole text."""

    def from_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORDS))
        return let(lines, lambda own: F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("bigint").alias("n_symbols"),
            (F.size(own) - F.size(F.array_distinct(own))).cast("bigint").alias("n_dup_lines"),
            F.coalesce(_repeat_words(words), F.lit(0)).cast("bigint").alias("n_repeat_words"),
            F.size(own).cast("bigint").alias("n_lines"),
            (F.length(text) - F.length(F.regexp_replace(text, "[A-ZÀ-ÖØ-Þ]{2,}", ""))).cast("bigint").alias("n_capitals"),
        ))

    return let(words_of(text), from_words)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _vote(measure: str, bad: float, good: float | None, m: Column) -> Column:
    top, _, below = measure.lstrip("-").partition(" / ")
    value = reduce(lambda a, b: a + b, [m[x] for x in top.strip("()").split(" + ")]).cast("double")
    if below:
        value = F.try_divide(value, m[below])  # null without words or lines: the rule abstains
    if measure.startswith("-"):
        value = -value
    says = F.when(value > bad, F.lit(0))
    return says if good is None else says.when(value <= good, F.lit(1))


def votes(m: Column) -> list[Column]:
    return [_vote(*rule, m).alias(name) for name, rule in RULES.items()]


@dataclass
class LabelModel:
    """Share of good documents, and of each rule's votes on good and on bad ones."""

    prior: float
    on_good: list[dict]
    on_bad: list[dict]

    def weights(self) -> list[dict]:
        """Log of how much likelier each vote is on a good document, by rule."""
        return [{v: math.log(g[v] / b[v]) for v in g} for g, b in zip(self.on_good, self.on_bad)]

    def posterior(self, vote_columns: list[Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, w in zip(vote_columns, self.weights()):
            total = total + F.when(vote == 1, F.lit(w[1])).when(vote == 0, F.lit(w[0])).otherwise(F.lit(w[None]))
        return 1 / (1 + F.exp(-total))


def fit_label_model(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over (votes, number of documents).

    Ten imagined documents of each class, which vote as at the start, keep every share above zero and the
    classes in their places; without documents the start values hold.
    """
    model = LabelModel(PRIOR, [START_GOOD] * len(RULES), [START_BAD] * len(RULES))
    for _ in range(rounds):
        weights, odds = model.weights(), math.log(model.prior / (1 - model.prior))
        good = [{v: 10 * p for v, p in START_GOOD.items()} for _ in RULES]
        bad = [{v: 10 * p for v, p in START_BAD.items()} for _ in RULES]
        n_good = n_bad = 10.0
        for vote, n in sorted(patterns, key=str):  # a fixed order, so sums do not depend on the shuffle
            p = n / (1 + math.exp(-odds - sum(w[v] for w, v in zip(weights, vote))))
            n_good, n_bad = n_good + p, n_bad + n - p
            for j, v in enumerate(vote):
                good[j][v] += p
                bad[j][v] += n - p
        model = LabelModel(
            n_good / (n_good + n_bad),
            [{v: x / n_good for v, x in g.items()} for g in good],
            [{v: x / n_bad for v, x in b.items()} for b in bad],
        )
    return model


def score_quality(docs: DataFrame, text: str = "text", name: str = "quality", drop_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (the text only unless dropped) and a struct ``name`` (made free of clashes): measures, base_failed, votes,
    score (posterior that the document is good) and kept."""
    name, m, v = free_name(docs, name), free_name(docs, "_measures"), free_name(docs, "_votes")
    kept = [F.col(f"`{c}`") for c in docs.columns if not (drop_text and c == text)]
    measured = docs.select(*kept, measures(whole(text)).alias(m))
    stored = materialize(measured.withColumn(v, F.struct(*votes(F.col(m)))), "quality")
    vote_columns = [F.col(v)[rule] for rule in RULES]
    counted = stored.groupBy(*[c.alias(rule) for c, rule in zip(vote_columns, RULES)]).count()
    model = fit_label_model([(tuple(row[:-1]), row[-1]) for row in counted.collect()])  # 3 ** rules rows at most
    score, failed = model.posterior(vote_columns), base_failed(F.col(m))
    return stored.select(
        *kept,
        F.struct(F.col(f"{m}.*"), failed.alias("base_failed"), score.alias("score"), (~failed & (score >= 0.5)).alias("kept"))
        .alias(name),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    scored = score_quality(docs, text)
    return scored.filter(F.col(scored.columns[-1])["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
