"""Hashed n-gram features and logistic regression in numpy, for tasks.

A document is cut into n-grams of its characters, or of the bytes of its UTF-8 text, and into words; each is
hashed into a fixed number of slots. Fitting takes a bounded sample of labelled rows; scoring takes every row.
"""

from __future__ import annotations

import io

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
POWERS = np.array([pow(BASE, i, 1 << 64) for i in range(256)], dtype=np.uint64)
BLOCK = 1 << 18  # code points of a text that are looked at together
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def grams(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Slots of all runs of ``n`` bytes (2 to 8)."""
    if len(raw) < n:
        return np.empty(0, dtype=np.int64)
    wide = raw.astype(np.uint64)
    value = wide[: len(raw) - n + 1].copy()
    for k in range(1, n):
        value |= wide[k : len(raw) - n + 1 + k] << np.uint64(8 * k)
    value += np.uint64(n)
    value *= ODD
    return (value >> np.uint64(64 - bits)).astype(np.int64)


def char_counts(text: str, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all runs of ``sizes`` code points, and how often each occurs.

    A text is read in blocks of ``BLOCK`` code points that overlap by the longest run, so memory does not grow
    with its length; counts of the blocks are added up.
    """
    over = max(sizes) - 1
    total = None
    for first in range(0, max(len(text), 1), BLOCK):
        part = np.frombuffer(text[first : first + BLOCK + over].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        found = []
        for n in sizes:
            starts = min(max(len(part) - n + 1, 0), BLOCK)
            value = np.full(starts, n, dtype=np.uint64)
            for k in range(n):
                value = value * np.uint64(BASE) + part[k : k + starts]
            found.append(((value * ODD) >> np.uint64(64 - bits)).astype(np.int32))
        slot, n_here = np.unique(np.concatenate(found), return_counts=True)
        if first == 0 and len(text) <= BLOCK:
            return slot, n_here
        total = np.zeros(1 << bits, dtype=np.int64) if total is None else total
        total[slot] += n_here
    slot = np.flatnonzero(total)
    return slot.astype(np.int32), total[slot]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word of the bytes ``raw``."""
    inside = ~SPACE[raw]
    if not inside.any():
        return np.empty(0, dtype=np.uint64)
    where = np.flatnonzero(inside)
    first = np.flatnonzero(np.diff(where, prepend=-2) > 1)
    begin = np.repeat(where[first], np.diff(first, append=len(where)))
    terms = (raw[where].astype(np.uint64) + np.uint64(1)) * POWERS[(where - begin) % len(POWERS)]
    return np.add.reduceat(terms, first)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * ODD) >> np.uint64(64 - bits)).astype(np.int64)


def fit_logistic(
    rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray,
    dims: int, l2: float, steps: int,
) -> tuple[np.ndarray, float]:
    """Weighted logistic regression of a sparse matrix by accelerated gradient steps.

    The step size follows from the largest squared length of a row.
    """
    share = weight / weight.sum()
    longest = float(np.bincount(rows, weights=values**2, minlength=len(y)).max(initial=0)) + 1
    bound = longest / 4 + l2
    prior = float(np.clip(share @ y, 1e-3, 1 - 1e-3))
    w = ahead = np.zeros(dims)
    b = ahead_b = float(np.log(prior / (1 - prior)))
    t = 1.0
    for _ in range(steps):
        margin = np.bincount(rows, weights=values * ahead[cols], minlength=len(y)) + ahead_b
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * share
        new = ahead - (np.bincount(cols, weights=values * error[rows], minlength=dims) + l2 * ahead) / bound
        new_b = ahead_b - error.sum() / bound
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / further * (new - w), new_b + (t - 1) / further * (new_b - b)
        w, b, t = new, new_b, further
    return w, b


def fit_platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities, with smoothed targets."""
    positive, negative = float((y * weight).sum()), float(((1 - y) * weight).sum())
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    spread = float(margin.std()) or 1.0
    x = np.stack([margin / spread, np.ones_like(margin)], axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * ab
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(ab[0] / spread), 0.0), float(ab[1])


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}
