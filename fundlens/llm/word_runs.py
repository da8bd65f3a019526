"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of consecutive words with smallest period q and length >= max(6, 4 q) that no neighbouring
word extends. The word ids of a text are compressed by rounds of Re-Pair: a round replaces every pair of
neighbouring symbols that is more frequent than the pairs it overlaps (ties by a hash of the pair) and that is
chosen twice or more, until no pair occurs twice. What is left is the start sequence; a balanced binary tree over
it completes the derivation tree. A run lies inside some node and across the boundary between its two parts, so

* each nonterminal is searched once, at its boundary, in the words it stands for. One side of the boundary holds
  two periods of the run, hence a square that begins or ends there: periods up to ``SHORT`` are tried at all
  boundaries at once, longer ones where the ``SHORT`` words beside the boundary occur again in the node;
* every run found is moved to all positions at which its nonterminal was derived;
* intervals that lie in a longer one of the same period are parts of it and go, so maximal ones are left.

Words are compared by id, so results are exact. Texts share nothing: a task holds ``SLICE_BYTES`` of texts, or
one longer text, in numpy and Arrow arrays (about forty bytes a word), and no row is shuffled.

Defined results: a null or empty text, or one of white space only, has no words, no runs and the empty collapsed
text; repeated rows are separate rows with equal results; an empty table gives an empty one; a clashing column
name is the caller's to choose (``names``) and raises when it is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

MIN_LENGTH, MIN_PERIODS = 6, 4
SHORT = 8  # periods that are tried at every boundary
SLICE_BYTES = 1 << 20  # text that a task works on at a time
ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mixed(key: np.ndarray) -> np.ndarray:
    value = key.astype(np.uint64) * ODD
    return (value ^ (value >> np.uint64(29))) * ODD


def _chosen(sym: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that a round replaces, and the rank of each one's pair."""
    key = sym[:-1] * top + sym[1:]
    hashed = _mixed(key)
    same = sym[:-1] == sym[1:]
    counts = np.ones(len(key), dtype=bool)
    if same.any():  # in a chain of equal symbols every second pair counts
        at = np.arange(len(key))
        first = np.maximum.accumulate(np.where(same, -1, at))
        counts = ~same | ((at - first) % 2 == 1)
    bits = max(8, len(key).bit_length() + 1)
    slot = (hashed >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(counts & (np.bincount(slot[counts], minlength=1 << bits)[slot] > 1))
    none = np.empty(0, dtype=np.int64)
    if not len(maybe):
        return none, none
    _, pair, n = np.unique(key[maybe], return_inverse=True, return_counts=True)
    often = n[pair] > 1
    maybe, pair = maybe[often], pair[often]
    if not len(maybe):
        return none, none
    rank = np.zeros(len(key) + 2, dtype=np.uint64)  # the pair's count, then its hash
    rank[maybe + 1] = (n[pair].astype(np.uint64) << np.uint64(32)) | (hashed[maybe] >> np.uint64(32))
    own = rank[maybe + 1]
    best = (own > rank[maybe]) & (own >= rank[maybe + 2])
    maybe, pair = maybe[best], pair[best]
    twice = np.bincount(pair)[pair] > 1
    maybe, pair = maybe[twice], pair[twice]
    return maybe, np.unique(pair, return_inverse=True)[1]


def grammar(sym: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, places) of the derivation trees of texts whose symbols differ from text to text.

    ``nodes`` has (start, boundary, end) of each nonterminal where it stands first; ``places`` has (node,
    start) of every position at which a nonterminal that is used more than once was derived.
    """
    n = len(sym)
    at, top = np.arange(n + 1), int(sym.max(initial=0)) + 1
    nodes, places, made = [], [], 0
    while len(sym) > 1:
        where, rule = _chosen(sym, top)
        if not len(where):
            break
        begin = at[where]
        first = np.unique(rule, return_index=True)[1]
        nodes.append(np.stack([begin, at[where + 1], at[where + 2]], axis=1)[first])
        places.append(np.stack([rule + made, begin], axis=1))
        made += len(first)
        sym = sym.copy()
        sym[where] = top + rule
        top += len(first)
        left = np.ones(len(at), dtype=bool)
        left[where + 1] = False
        sym, at = sym[left[:-1]], at[left]
    begin, end = at[:-1], at[1:]
    text = np.searchsorted(bounds, begin, side="right")
    while len(begin):  # neighbours of one text two by two
        order = np.arange(len(begin)) - np.searchsorted(text, text)
        left = np.flatnonzero((order[:-1] % 2 == 0) & (text[:-1] == text[1:]))
        if not len(left):
            break
        nodes.append(np.stack([begin[left], begin[left + 1], end[left + 1]], axis=1))
        stays = np.ones(len(begin), dtype=bool)
        stays[left + 1] = False
        end = end.copy()
        end[left] = end[left + 1]
        begin, end, text = begin[stays], end[stays], text[stays]
    empty = np.empty((0, 3), dtype=np.int64)
    return np.concatenate([empty, *nodes]), np.concatenate([empty[:, :2], *places])


def _same_from(sym: np.ndarray, at: int, q: int, limit: int) -> int:
    """How many words from ``at`` on, before ``limit``, equal the word ``q`` further on."""
    done, step = 0, 64
    while at + done < limit:
        stop = min(at + done + step, limit)
        differ = sym[at + done : stop] != sym[at + done + q : stop + q]
        if differ.any():
            return done + int(differ.argmax())
        done, step = stop - at, 2 * step
    return done


def _same_before(sym: np.ndarray, at: int, q: int, limit: int) -> int:
    """How many words before ``at``, from ``limit`` on, equal the word ``q`` further on."""
    done, step = 0, 64
    while at - done > limit:
        start = max(at - done - step, limit)
        differ = (sym[start : at - done] != sym[start + q : at - done + q])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, step = at - start, 2 * step
    return done


def _short_squares(sym: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(nodes, period, 0 or 1) with a square of the period that begins (0) or ends (1) at the boundary."""
    start, mid, end = nodes.T
    for q in range(1, SHORT + 1):
        wide = end - start >= max(MIN_LENGTH, MIN_PERIODS * q)
        for side, room in ((0, end - mid), (1, mid - start)):
            left = np.flatnonzero(wide & (room >= 2 * q))
            from_ = mid - 2 * q * side
            for k in range(q):
                left = left[sym[from_[left] + k] == sym[from_[left] + k + q]]
            if len(left):
                yield left, q, side


def _long_squares(sym: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(node, period, 0 or 1) of candidates for periods above ``SHORT``."""
    start, mid, end = nodes.T
    wide = np.flatnonzero(end - start >= MIN_PERIODS * (SHORT + 1))
    if not len(wide):
        return
    gram = np.zeros(len(sym) - SHORT + 1, dtype=np.uint64)
    for k in range(SHORT):
        gram = _mixed(gram + sym[k : k + len(gram)].astype(np.uint64))
    bits = max(8, len(gram).bit_length() + 2)
    slot = (gram >> np.uint64(64 - bits)).astype(np.int64)
    again = np.bincount(slot)[slot] > 1
    for side, room in ((0, end - mid), (1, mid - start)):
        there = wide[room[wide] >= 2 * (SHORT + 1)]
        for node in there[again[mid[there] - SHORT * side]]:
            low, half = SHORT + 1, min(int(room[node]) // 2, int(end[node] - start[node]) // MIN_PERIODS)
            here = int(mid[node]) - SHORT * side
            if side == 0:
                near = gram[here + low : here + half + 1]
            else:
                near = gram[here - half : here - low + 1][::-1]
            for q in np.flatnonzero(near == gram[here]) + low:
                yield int(node), int(q), side


def boundary_runs(sym: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """(node, start, end, period) of the runs across the boundary of each node, inside the node."""
    found: dict[tuple[int, int, int], int] = {}
    skip: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def take(node: int, q: int, side: int) -> None:
        start, mid, end = (int(v) for v in nodes[node])
        anchor = mid - (q + 1) * side
        known = skip.setdefault((node, side), [])
        # a multiple of a period whose run is known gives the same stretch again
        if any(q % p == 0 and s <= anchor and anchor + q < e for s, e, p in known):
            return
        after = _same_from(sym, anchor, q, end - q)
        before = _same_before(sym, anchor, q, start)
        s, e = anchor - before, anchor + after + q
        if e - s >= max(MIN_LENGTH, MIN_PERIODS * q) and s < mid < e:
            known.append((s, e, q))
            found[node, s, e] = min(found.get((node, s, e), q), q)

    for some, q, side in _short_squares(sym, nodes):
        for node in some:
            take(int(node), q, side)
    for node, q, side in _long_squares(sym, nodes):
        take(node, q, side)
    rows = [(*k, q) for k, q in found.items()]
    return np.array(rows, dtype=np.int64).reshape(-1, 4)


def _everywhere(runs: np.ndarray, nodes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(start, end, period) of the runs at all positions of their nodes."""
    used = np.zeros(len(nodes) + 1, dtype=bool)
    used[runs[:, 0]] = True
    places = places[used[places[:, 0]]]
    places = places[np.argsort(places[:, 0], kind="stable")]
    low = np.searchsorted(places[:, 0], runs[:, 0])
    times = np.searchsorted(places[:, 0], runs[:, 0], side="right") - low
    once = runs[times == 0, 1:]  # nodes above the start sequence stand in one place
    runs, low, times = runs[times > 0], low[times > 0], times[times > 0]
    which = np.repeat(np.arange(len(runs)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    moved = runs[which, 1:]
    moved[:, :2] += (places[low[which] + nth, 1] - nodes[runs[which, 0], 0])[:, None]
    return np.concatenate([once, moved])


def maximal(found: np.ndarray) -> np.ndarray:
    """Intervals (start, end, period) that lie in no other one of their period, each once, by start, then period."""
    start, end, q = found[np.lexsort((-found[:, 1], found[:, 0], found[:, 2]))].T
    if not len(start):
        return found
    group = np.cumsum(np.diff(q, prepend=q[0]) > 0)
    reach = np.maximum.accumulate(end + group * (int(end.max()) + 1))
    new = np.ones(len(start), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (reach[1:] > reach[:-1])
    kept = np.stack([start[new], end[new], q[new]], axis=1)
    return kept[np.lexsort((kept[:, 2], kept[:, 0]))]


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of texts laid end to end; ``bounds`` has the first place after each text."""
    if len(codes) < MIN_LENGTH:
        return np.empty((0, 3), dtype=np.int64)
    text = np.repeat(np.arange(len(bounds)), np.diff(bounds, prepend=0))
    sym = text * (int(codes.max()) + 1) + codes  # words of two texts differ
    nodes, places = grammar(sym, bounds)
    return maximal(_everywhere(boundary_runs(sym, nodes), nodes, places))


def _text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and the number of words before the end of each text."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, sizes = parts.flatten(), parts.value_lengths().to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[np.cumsum(sizes)].astype(np.int64)


def described(texts: pa.Array) -> list[pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    words, bounds = _text_words(texts)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = runs_of(codes, bounds)
    begin = np.concatenate([[0], bounds])
    text = np.searchsorted(bounds, runs[:, 0], side="right")
    own = np.searchsorted(text, np.arange(len(bounds) + 1)).astype(np.int32)
    listed = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - begin[text]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
        names=["start", "length", "period"],
    )
    inside = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 1], -1)
    keep = np.cumsum(inside[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(keep)])[begin]
    kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(keep)))
    return [
        pa.array(np.diff(begin)),
        pa.ListArray.from_arrays(pa.array(own), listed).cast(RUNS),
        pc.binary_join(kept, " "),
    ]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive texts of ``SLICE_BYTES`` together, or of one longer text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, own in enumerate(size):
        if held and held + own > SLICE_BYTES:
            yield start, k - start
            start, held = k, 0
        held += int(own)
    if start < len(size):
        yield start, len(size) - start


def _batches(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, length in _slices(batch.column(at)):
            part = batch.slice(start, length)
            n, runs, collapsed = described(part.column(at))
            yield pa.RecordBatch.from_arrays([*part.columns, n, runs, collapsed], names=names)


def with_runs(
    docs: DataFrame, text: str = "text", names: tuple[str, str, str] = ("n_words", "runs", "collapsed")
) -> DataFrame:
    """``docs`` with the number of words, the runs and the collapsed text of each text.

    Runs are (start, length, period) in words from 0, by start, then period. The collapsed text has the words
    that no run contains after its first period, joined by one space.
    """
    if {n.lower() for n in names} & {c.lower() for c in docs.columns} or len(set(names)) < len(names):
        raise ValueError(f"columns {names} must be new and differ")
    count, runs, collapsed = names
    new = StructType.fromDDL(
        f"`{count}` long, `{runs}` array<struct<start: long, length: long, period: long>>, `{collapsed}` string"
    )
    schema = StructType([*docs.schema.fields, *new.fields])
    every = [f.name for f in schema.fields]
    return docs.mapInArrow(partial(_batches, at=docs.columns.index(text), names=every), schema)
