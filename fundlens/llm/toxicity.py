"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each text is its hashed runs of 3 to 6 code points in lower case (any white space is a space, one stands at both
ends) with the logarithm of one more than their counts. A feature's value is this log count times the log ratio
of its smoothed sums among toxic and other training rows, and the values of a row are brought to length one; a
logistic regression weighs them and Platt scaling on held-out folds gives the score.

Defined results: null and empty texts have no n-grams and get the score of the intercept; without
training rows of both classes every score is 0. A text of any length is read whole, in blocks; repeated rows get
the same score; an empty table gives no rows; a column of the table may have the name of the score if another is given.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from fundlens.llm.linear import char_counts, fit_logistic, fit_platt, pack, unpack
from fundlens.llm.sample import fitted, labelled_sample
from fundlens.llm.shared import with_columns

BITS = 18  # slots of all n-grams
SIZES = (3, 4, 5, 6)
SAMPLE = 1_500  # labelled rows per class at most
FOLDS = 2
LEAST_DOCS = 3  # training rows that an n-gram must be in
LEAST_RATIO = 0.2  # log ratios nearer to zero count as zero
STEPS = 60
TOXIC_FROM = 0.7


WHITE = re.compile(r"\s")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the text's n-grams and their log counts; none for an empty text."""
    if not text:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    slot, n = char_counts(WHITE.sub(" ", f" {text.lower()} "), SIZES, BITS)
    return slot, np.log1p(n).astype(np.float32)


def _featurizer():
    return features


def _ratios(cols, values, docs_toxic, n_toxic, n_other, dims):
    """Naive Bayes log-count ratio per slot, from sums of log counts per training row."""
    toxic = np.bincount(cols[docs_toxic], weights=values[docs_toxic], minlength=dims)
    other = np.bincount(cols[~docs_toxic], weights=values[~docs_toxic], minlength=dims)
    least = 1 / max(min(n_toxic, n_other), 1)
    ratio = np.log(toxic / max(n_toxic, 1) + least) - np.log(other / max(n_other, 1) + least)
    ratio[(np.bincount(cols, minlength=dims) < LEAST_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    return ratio


def _fit(rows, cols, values, y, weight):
    dims = 1 << BITS
    if len(np.unique(y)) < 2:
        zero = np.zeros(dims, dtype=np.float32)
        return {"table": zero, "ratio": zero, "line": np.array([0.0, 0.0, -30.0])}
    even = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def length(ratio):
        return np.sqrt(np.bincount(rows, weights=(values * ratio[cols]) ** 2, minlength=len(y))) + 1e-9

    def train(used):
        own = used[rows]
        ratio = _ratios(cols[own], values[own], y[rows[own]] > 0, (y * used).sum(), ((1 - y) * used).sum(), dims)
        own &= ratio[cols] != 0
        own_rows, own_cols = rows[own], cols[own]
        scaled = values[own] * ratio[own_cols] / length(ratio)[own_rows]
        w, b = fit_logistic(own_rows, own_cols, scaled, y, even * used + 1e-12, dims, 1e-4, STEPS)
        return w * ratio, ratio, b

    fold = np.arange(len(y)) % FOLDS
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        table, ratio, b = train(fold != k)
        own = np.bincount(rows, weights=values * table[cols], minlength=len(y)) / length(ratio) + b
        margin = np.where(fold == k, own, margin)
    slope, intercept = fit_platt(margin, y, weight)
    table, ratio, b = train(np.ones(len(y), dtype=bool))
    return {"table": table.astype(np.float32), "ratio": ratio.astype(np.float32), "line": np.array([b, slope, intercept])}


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = SAMPLE) -> bytes:
    """The packed model of a bounded sample of labelled rows; ``use`` is a condition on ``doc_id``."""
    return pack(**fitted(labelled_sample(docs, labels, "toxic", per_class, use), _featurizer, _fit))


def _scorer(model: bytes):
    own = unpack(model)
    table, squares, (b, slope, intercept) = own["table"], own["ratio"].astype(np.float64) ** 2, own["line"]

    def margin(text):
        slots, logs = features(text)
        return (logs * table[slots]).sum(dtype=np.float64) / (np.sqrt((logs**2 * squares[slots]).sum()) + 1e-9) + b

    def work(texts):
        margins = np.array([margin(t) for t in texts], dtype=np.float64)
        return [pa.array(1 / (1 + np.exp(-np.clip(slope * margins + intercept, -30, 30))), pa.float64())]

    return work


def scored(docs: DataFrame, text: str, model: bytes, name: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability that a text is toxic."""
    return with_columns(docs, text, partial(_scorer, model), f"`{name}` double")
