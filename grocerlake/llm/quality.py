"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed token, shared by all grades, and ordered thresholds:
P(grade <= k) = sigmoid(threshold_k - score).  The fitted model gives a text's
expected grade and the probability that its grade reaches a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import LOWER, SPACE, chunks, runs, span_hashes
from .common import table

BITS = 15
#: Bound of the sample that the model is fitted on.
FIT_ROWS = 8000
STEPS, RATE, LASSO = 300, 0.05, 0.25
#: Texts of the sample that must have a token for it to count.
MIN_DF = 5

_WORD = np.zeros(256, bool)
_WORD[[b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128]] = True


def hashed_tokens(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Distinct hashed tokens of each text: runs of letters and digits, and runs of signs.

    The whole text counts; ASCII case does not.  Number 0 is the bias of
    texts without a token.
    """
    for _, group in chunks(texts):
        data = np.frombuffer(b"\n".join(group), np.uint8)
        begins = np.cumsum([0, *(len(g) + 1 for g in group)])
        word, sign = _WORD[data], ~_WORD[data] & ~SPACE[data]
        a, b = runs(word)
        c, d = runs(sign)
        starts, ends = np.concatenate((a, c)), np.concatenate((b, d))
        if not len(starts):
            yield from (np.zeros(1, np.int32) for _ in group)
            continue
        token = (span_hashes(LOWER[data], starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
        owner = np.searchsorted(begins, starts, "right") - 1
        both = np.unique(owner << BITS | token)
        bounds = np.searchsorted(both, np.arange(len(group) + 1) << BITS)
        for lo, hi in zip(bounds, bounds[1:]):
            yield (both[lo:hi] & ((1 << BITS) - 1)).astype(np.int32) if hi > lo else np.zeros(1, np.int32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """Maximum likelihood with a lasso penalty, by Adam on the whole sample.

    A score is the sum of the weights of a text's distinct tokens; the penalty keeps the
    many tokens that tell nothing at zero.  Thresholds are the first one and positive
    gaps, hence ordered.  Tokens of fewer than MIN_DF texts get no weight; without any
    row the thresholds are even and all weights zero.
    """
    size = np.array([len(f) for f in features], np.int64)
    token = np.concatenate(features) if len(features) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(features)), size)
    known = np.bincount(token, minlength=1 << BITS) >= MIN_DF
    token, row = token[known[token]], row[known[token]]
    share = np.array([(np.sum(grades <= k) + 1) / (len(grades) + n_grades) for k in range(n_grades - 1)])
    start = np.log(share / (1 - share))
    theta = np.concatenate((start[:1], np.log(np.maximum(1e-3, np.diff(start)))))
    w = np.zeros(1 << BITS)
    moments = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(theta), np.zeros_like(theta))]
    hit = np.arange(n_grades - 1)[None, :] >= grades[:, None]  # grade <= k
    # rows count so that each grade weighs alike
    count = np.maximum(1, np.bincount(grades, minlength=n_grades))
    weight = (1 / count)[grades] * len(grades) / n_grades if len(grades) else np.zeros(0)
    for step in range(1, STEPS + 1 if len(features) else 1):
        cuts = np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))
        score = np.bincount(row, w[token], len(features))
        upto = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -50, 50)))
        full = np.column_stack((np.zeros(len(score)), upto, np.ones(len(score))))
        slope = np.column_stack((np.zeros(len(score)), upto * (1 - upto), np.zeros(len(score))))
        at = np.arange(len(score))
        p = np.maximum(1e-9, full[at, grades + 1] - full[at, grades])
        up, down = slope[at, grades + 1] / p * weight, slope[at, grades] / p * weight
        d_score = (up - down) / len(score)
        d_cuts = -np.array([(up[grades == k]).sum() - (down[grades == k + 1]).sum() for k in range(n_grades - 1)]) / len(score)
        d_theta = np.concatenate(([d_cuts.sum()], [d_cuts[k:].sum() * np.exp(theta[k]) for k in range(1, n_grades - 1)]))
        grads = [np.bincount(token, d_score[row], 1 << BITS), d_theta]
        for x, g, (m, v) in zip((w, theta), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        w[:] = np.sign(w) * np.maximum(0, np.abs(w) - RATE * LASSO)
    cuts = np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))
    return OrdinalModel(w, cuts)


def graded(labels: DataFrame) -> DataFrame:
    """Grade of a rated document: 0 toxic, 1 not toxic but poor, 2 good.  Rows with a null are left out."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return rated.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"))


def _tokens(column: Column) -> Column:
    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_tokens([(t or "").encode() for t in texts])))

    return of(column)


def fit_quality(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on at most ``fit_rows`` ratings (doc_id, grade), one for each slot of the hashed id.

    The sample does not depend on the order of rows.  A document rated more than once, or listed
    more than once, counts with its lowest grade and its first text.
    """
    keyed = ratings.select("doc_id", "grade", F.xxhash64("doc_id").alias("_h"))
    slots = keyed.groupBy(F.pmod("_h", F.lit(fit_rows)).alias("_slot")).agg(F.min(F.struct("_h", "grade", "doc_id")).alias("r"))
    chosen = F.broadcast(slots.select("r.doc_id", "r.grade"))  # at most fit_rows rows
    picked = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id")
    rows = picked.select("doc_id", "grade", _tokens(F.col("text")).alias("tokens")).groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("tokens").alias("tokens")).orderBy("doc_id").toArrow()
    features = [np.asarray(t.values, np.int32) for t in rows["tokens"]]
    return fit_ordinal(features, rows["grade"].to_numpy().astype(np.int64), n_grades)


def score_quality(docs: DataFrame, model: OrdinalModel, text: str = "text", least_grade: int = 2, least_probability: float = 0.5) -> DataFrame:
    """Add expected_grade, tail_probability (of ``least_grade`` or more) and selected.

    Null and empty texts have no tokens and score as the bare thresholds, but
    are never selected.  Input columns with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    @F.pandas_udf("expected_grade double, tail_probability double, selected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            tokens = list(hashed_tokens([(t or "").encode() for t in texts]))
            score = np.array([m.weights[t].sum() for t in tokens])
            tails = m.tails(score)
            p = tails[:, least_grade - 1]
            some = np.array([bool(t) for t in texts])
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": p, "selected": (p >= least_probability) & some})

    out = docs.drop("expected_grade", "tail_probability", "selected").withColumn("_q", predict(F.col(text)))
    return out.select("*", "_q.*").drop("_q")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, graded(table(spark, sf_dir, "labels")))
    return score_quality(docs, model).drop("text")
