"""Operator 9, quality rules under weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0). Nothing has to pass all rules: the rules'
accuracies are estimated by expectation-maximisation from how they agree and disagree, without
labels, and a document's posterior probability of being good decides. Accuracies are kept for
each rule, class and vote, so a rule may be a sure sign against a document and none for it.

Votes are built-in expressions and stay in the JVM. The votes of the whole corpus are counted
by pattern (at most 3 to the number of rules, whatever the corpus), EM runs on the counts, and
the posterior is a logistic sum of the votes: no join and no Python in the scoring pass.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import persist_table, pick, table

#: A document is kept from this posterior on.
KEEP = 0.5
#: Class-conditional vote probabilities are smoothed by this many votes of each kind.
SMOOTHING = 1.0
STOPWORDS = ("the", "of", "and", "to", "in", "is", "de", "la", "le", "et", "les", "des", "en", "un", "une", "el", "los", "que", "y", "der", "die", "das", "und", "von", "ist", "nicht")


def measures(slim: DataFrame) -> DataFrame:
    """What the rules look at: (doc_id, blank, measures). In steps, so no text is split twice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = slim.select("doc_id", text.alias("text"), F.split(F.lower(text), r"\s+").alias("words"), F.split(text, "\n").alias("lines"))
    n = F.size("words")
    chars = F.greatest(F.length("text"), F.lit(1))
    left, right = F.slice("words", 1, F.greatest(n - 1, F.lit(0))), F.slice("words", 2, F.greatest(n - 1, F.lit(0)))
    return first.select(
        "doc_id", (~F.col("text").rlike(r"\S")).alias("blank"), n.alias("n"), F.size("lines").alias("n_lines"),
        (F.size(F.array_distinct("words")) / n).alias("variety"),
        (F.size(F.array_distinct("lines")) / F.size("lines")).alias("line_variety"),
        (F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda x: x)) / n).alias("stutter"),
        F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in STOPWORDS]))).alias("stops"),
        (F.regexp_count("text", F.lit(r"\p{L}")) / chars).alias("letters"),
        (F.regexp_count("text", F.lit(r"\p{Lu}")) / chars).alias("capitals"),
        ((chars - F.length(F.translate("text", "#$%&*|{}<>^~=_@\\", ""))) / chars).alias("symbols"),
        ((chars - F.length(F.translate("text", "!", ""))) / chars).alias("shouts"),
    )


def rules() -> dict[str, Column]:
    """Votes on the measures of a text that isn't blank. Every rule may abstain: where the text is too short to tell, or between its bounds."""
    c = F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")

    enough = c("n") >= 10
    return {
        "v_length": vote(c("n") < 3, c("n") >= 20),
        "v_letters": vote(c("letters") < 0.68, c("letters") >= 0.76),
        "v_variety": vote((c("n") >= 20) & (c("variety") < 0.25), (c("n") >= 20) & (c("variety") > 0.4)),
        "v_stopwords": vote((c("n") >= 20) & (c("stops") < 1), c("stops") >= 2),
        "v_symbols": vote(c("symbols") > 0.02, enough & (c("symbols") < 0.005)),
        "v_capitals": vote((c("capitals") > 0.2) & (c("n") >= 5), enough & (c("capitals") < 0.1)),
        "v_shouts": vote(c("shouts") > 0.01, enough & (c("shouts") < 0.002)),
        "v_lines": vote((c("n_lines") >= 4) & (c("line_variety") < 0.7), (c("n_lines") >= 2) & (c("line_variety") > 0.9)),
        "v_stutter": vote(enough & (c("stutter") > 0.15), enough & (c("stutter") < 0.05)),
    }


RULES = ("v_length", "v_letters", "v_variety", "v_stopwords", "v_symbols", "v_capitals", "v_shouts", "v_lines", "v_stutter")


def estimate(patterns: pd.DataFrame, rounds: int = 50) -> tuple[float, np.ndarray]:
    """EM over vote patterns with a ``count``: the share of good documents and (class, rule, vote) probabilities.

    Given the truth, votes are independent. Class 0 is bad, 1 good; votes are in the order bad,
    abstain, good. Not to vote says nothing: of the votes that were cast, the shares are
    estimated, and the abstentions' column is 1. It begins from the balance of votes, one against
    weighing more than one for. Without documents everything is as likely as it is not.
    """
    votes = patterns[list(RULES)].to_numpy(int)
    weight = patterns["count"].to_numpy(float)
    if not weight.sum():
        return 0.5, np.tile([0.5, 1.0, 0.5], (2, len(RULES), 1))
    good = 1 / (1 + np.exp(-(1.0 + 0.4 * (votes > 0).sum(1) - 2.0 * (votes < 0).sum(1))))
    cast = np.stack([votes == -1, votes == 1], axis=2).astype(float)
    for _ in range(rounds):
        by_class = np.stack([weight * (1 - good), weight * good])
        share = np.einsum("cp,prv->crv", by_class, cast) + SMOOTHING
        share /= share.sum(axis=2, keepdims=True)
        prior = float((by_class[1].sum() + 1) / (weight.sum() + 2))
        odds = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", cast, np.log(share[1]) - np.log(share[0]))
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return prior, np.stack([share[..., 0], np.ones(share.shape[:2]), share[..., 1]], axis=2)


def assessed(docs: DataFrame, keep: float = KEEP, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one column a rule, p_quality, keep) for every row, repeats included.

    Null, empty and blank texts get the vote -1 of the length rule and abstentions; they take
    part in the counts. Without any votes the posterior is the prior. A posterior of just ``keep``
    keeps the document. Null ids pass through; other columns are dropped.
    """
    slim = pick(docs, doc_id=id_col, text=text_col)
    votes = measures(slim).select("doc_id", *[F.when(F.col("blank"), F.lit(-1 if name == "v_length" else 0).cast("tinyint")).otherwise(v).alias(name) for name, v in rules().items()])
    votes = persist_table(votes, "votes")
    prior, table_ = estimate(votes.groupBy(*RULES).count().toPandas().sort_values(list(RULES), ignore_index=True))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, weights in zip(RULES, (np.log(table_[1]) - np.log(table_[0])).tolist()):
        odds = odds + F.when(F.col(name) < 0, weights[0]).when(F.col(name) > 0, weights[2]).otherwise(weights[1])
    return votes.withColumn("p_quality", F.round(1 / (1 + F.exp(-odds)), 6)).withColumn("keep", F.col("p_quality") >= keep)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(table(spark, sf_dir, "documents"))
