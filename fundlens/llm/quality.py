"""Quality rules: base counts and a calibrated n-gram classifier.

Features are the shares of hashed words, word pairs and byte 4-grams in a text; a logistic
regression on labelled rows weighs them, Platt scaling on held-out folds turns margins into
probabilities, and fixed thresholds turn these into verdicts. Rows are scored in Arrow batches.

Defined results: a null or empty text has no words, so the base rule rejects it; without labels of
both classes the classifier abstains (probability 1) and the base rule alone decides.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.linear import fit_logistic, fit_platt, grams, slots, unpack, word_hashes, pack
from fundlens.llm.sample import fitted, labelled_sample
from fundlens.llm.shared import with_columns

BITS = 16  # slots per feature family
SAMPLE = 1_000  # labelled rows per class at most
KEEP_FROM = 0.4  # calibrated probability of good quality
MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of words in repeated windows
FOLDS = 2
FAMILIES = 3
STEPS = 40
SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def families(raw: np.ndarray) -> list[np.ndarray]:
    """Slots of each family, every family in a range of its own."""
    hashes = word_hashes(raw)
    pairs = hashes[:-1] * PAIR + hashes[1:]
    found = [slots(hashes, BITS), slots(pairs, BITS), grams(raw, 4, BITS)]
    return [f + (k << BITS) for k, f in enumerate(found)]


def _shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    cols, values = [], []
    for own in families(np.frombuffer((text or "").encode(), dtype=np.uint8)):
        if len(own):
            slot, n = np.unique(own, return_counts=True)
            cols.append(slot)
            values.append(n / len(own))
    if not cols:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    return np.concatenate(cols).astype(np.int32), np.concatenate(values).astype(np.float32)


def _featurizer():
    return _shares


def _fit(rows, cols, values, y, weight):
    """Weights per slot, and slope and intercept of the calibration."""
    dims = FAMILIES << BITS
    if len(np.unique(y)) < 2:
        return {"table": np.zeros(dims, dtype=np.float32), "line": np.array([0.0, 0.0, 30.0])}
    even = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    scale = 1 / (np.sqrt(np.bincount(cols, weights=values**2, minlength=dims) / len(y)) + 0.001)
    scaled = values * scale[cols]

    def train(used):
        own = used[rows]
        return fit_logistic(rows[own], cols[own], scaled[own], y, even * used + 1e-12, dims, 1e-2, STEPS)

    fold = np.arange(len(y)) % FOLDS
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        w, b = train(fold != k)
        margin = np.where(fold == k, np.bincount(rows, weights=scaled * w[cols], minlength=len(y)) + b, margin)
    slope, intercept = fit_platt(margin, y, weight)
    w, b = train(np.ones(len(y), dtype=bool))
    return {"table": (w * scale).astype(np.float32), "line": np.array([b, slope, intercept])}


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> bytes:
    """The packed model of a bounded sample of labelled documents (a megabyte at most)."""
    sample = labelled_sample(docs, labels, "quality", per_class, F.lit(True))
    return pack(**fitted(sample, _featurizer, _fit))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that stand at two or more places of the text."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, which, n = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[which] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    own = [line for line in text.split("\n") if line.encode().split()]
    return len(own) - len(set(own))


def _judge(model: dict, text: str | None) -> tuple:
    text = text or ""
    data = text.encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    found = data.split()
    n_repeat = repeat_words(found)
    margin, slope, intercept = model["line"]
    for own in families(raw):
        if len(own):
            margin += float(model["table"][own].mean(dtype=np.float64))
    good = 1 / (1 + np.exp(-np.clip(slope * margin + intercept, -30, 30)))
    failed = len(found) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT * len(found)
    chars = sum(len(w.decode()) for w in found) if not data.isascii() else sum(map(len, found))
    return len(found), chars, int(SYMBOLS[raw].sum()), dup_lines(text), n_repeat, failed, float(good), bool(not failed and good >= KEEP_FROM)


def _scorer(model: bytes):
    own = unpack(model)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def work(texts):
        rows = [_judge(own, t) for t in texts]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    return work


def judged(docs: DataFrame, text: str, model: bytes, names: list[str] | None = None) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``good`` (probability) and ``kept``.

    ``names`` renames the eight new columns, for tables that have columns of these names.
    """
    names = names or ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "good", "kept"]
    kinds = ["long"] * 5 + ["boolean", "double", "boolean"]
    ddl = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    return with_columns(docs, text, partial(_scorer, model), ddl)
