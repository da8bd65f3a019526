"""Periodic runs against a search of all periods at all places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from fundlens.llm import queries, word_runs


def brute(x):
    """(start, length, period) of all runs, period by period."""
    n, found = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # a multiple of a smaller period gives the same stretch
            i = max(i + 1, j)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(x, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(x) if k not in gone)


def made(rng):
    kinds, out = rng.choice([1, 2, 3, 5, 30]), []
    for _ in range(rng.randint(0, 8)):
        how = rng.random()
        if how < 0.5:
            unit = [str(rng.randrange(kinds)) for _ in range(rng.randint(1, rng.choice([3, 12, 30])))]
            out += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
        elif out and how < 0.7:
            out += out[-rng.randint(1, len(out)) :]
        else:
            out += [str(rng.randrange(kinds)) for _ in range(rng.randint(0, 20))]
    return out


def found_in(texts):
    counts, runs, kept = word_runs.described(pa.array(texts, pa.string()))
    as_rows = [[(r["start"], r["length"], r["period"]) for r in own] for own in runs.to_pylist()]
    return list(zip(counts.to_pylist(), as_rows, kept.to_pylist(), strict=True))


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [made(rng) for _ in range(rng.randint(1, 6))]
        for x, (n, runs, kept) in zip(texts, found_in([" ".join(x) for x in texts]), strict=True):
            assert n == len(x)
            assert runs == brute(x), x
            assert kept == collapsed(x, runs)


def test_words_are_cut_at_spaces_of_ascii_only():
    (n, runs, kept), *others = found_in(["\x0b a\x0c\x1cb \t\r\n c\x85d e ", "", None, " \n"])
    assert (n, runs, kept) == (3, [], "a \x1cb c\x85d e")
    assert others == [(0, [], "")] * 3


def test_few_words_and_long_texts():
    rng = np.random.default_rng(5)
    two = rng.integers(0, 2, 3000).astype(str).tolist()
    assert found_in([" ".join(two)])[0][1] == brute(two)
    unit = [f"w{k}" for k in range(997)]
    n, runs, kept = found_in([" ".join(["x", "y", *unit * 200, "z"])])[0]
    assert (n, runs, kept) == (199_403, [(2, 199_400, 997)], " ".join(["x", "y", *unit, "z"]))
    assert found_in(["a " * 300_000])[0][1:] == ([(0, 300_000, 1)], "a")
    words = [f"v{k}" for k in rng.integers(0, 50_000, 20_000)]
    assert found_in([" ".join([*words, *words, *words])])[0][1] == []


def test_grammar_derives_the_text():
    rng = random.Random(3)
    for _ in range(50):
        x = made(rng)
        codes = np.unique(x, return_inverse=True)[1].astype(np.int64) if x else np.empty(0, dtype=np.int64)
        nodes, places = word_runs.grammar(codes, np.array([len(x)]))
        for rule, start in places:
            first, _, last = nodes[rule]
            assert x[start : start + last - first] == x[first:last]
        whole = [(0, len(x))] if len(x) > 1 else []
        assert [(s, e) for s, _, e in nodes.tolist() if e - s == len(x)][-1:] == whole


def expected(doc_id, text):
    """The contract, word by word."""
    x = [w for w in (text or "").encode().split()]
    x = [w.decode() for w in x]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(x), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    runs = brute(x)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, milli, sha(lines), sha(collapsed(x, runs)))


def test_query_equals_the_contract(make_docs):
    rng = random.Random(9)
    due = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, " ".join(made(rng))) for k in due + list(range(40))]
    rows += [(due[0], None), (due[1], ""), (due[2], "one"), (None, "a b c " * 9), (7, "a " * 6), (7, "a " * 6), (8, "b " * 5)]
    got = queries.runs_digest(word_runs.with_runs(queries.with_repeats(make_docs(rows)))).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_odd_rows_and_clashing_columns(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = word_runs.with_runs(docs).collect()
    assert len(rows) == len(odd_rows)
    assert {r.doc_id: len(r.runs) for r in rows}[7] == 1
    with pytest.raises(ValueError, match="must be new"):
        word_runs.with_runs(docs.withColumnRenamed("lang", "Runs"))
    other = word_runs.with_runs(docs.withColumnRenamed("lang", "runs"), names=("n", "found", "short"))
    assert other.columns == ["doc_id", "text", "runs", "source", "n_chars", "n", "found", "short"]
    assert word_runs.with_runs(make_docs([])).count() == 0
