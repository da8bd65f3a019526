"""Late interaction against a double loop over words; stems by vocabulary."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.operators import skew
from fundlens.text import late, lexical, word_vectors
from fundlens.text.tokens import stem
from tests.helpers import plan

WORDS = [f"word{k}" for k in range(40)]


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(WORDS[:30], k=12))) for k in range(150)]
    return word_vectors.train(spark.createDataFrame(rows, "id long, text string"), dim=6, contexts=20)


@pytest.mark.parametrize("weighted", [False, True])
def test_scores_equal_the_loop(spark, trained, weighted):
    table = {r.term: (np.array(r.vector), r.idf) for r in trained.table.collect()}
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n)))
    queries, docs = [(k, text(6)) for k in range(12)] + [(50, None)], [(k, text(25)) for k in range(20)] + [(70, None)]
    pairs = [(q, d) for q, _ in queries for d, _ in docs if rng.random() < 0.5] + [(0, 0), (0, 0), (50, 1), (1, 70)]

    def cosine(a, b):
        if a == b:
            return 1.0
        if a not in table or b not in table:
            return 0.0
        u, v = table[a][0], table[b][0]
        return min(max(u @ v / (np.linalg.norm(u) * np.linalg.norm(v)), 0.0), 1.0)

    want = {}
    for q, d in pairs:
        asked, given = (dict(queries)[q] or "").split(), (dict(docs)[d] or "").split()
        weight = lambda w: table[w][1] if weighted and w in table else 1.0
        want[q, d] = sum(weight(w) * max(cosine(w, x) for x in given) for w in asked) if given else 0.0
    got = late.late_scores(
        spark.createDataFrame(pairs, "query_id long, id long"), spark.createDataFrame(queries, "query_id long, text string"),
        spark.createDataFrame(docs, "id long, text string"), trained, weighted,
    ).collect()
    assert {(r.query_id, r.id) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.score - want[r.query_id, r.id]) < 2e-6 for r in got)


@pytest.mark.parametrize("most", [200_000, 0])
def test_stems_of_the_vocabulary_are_joined(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", most)
    texts = ["running runs run runner", "cats cat caresses", None, "run run walking"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {}
    for k, t in enumerate(texts):
        for w in (t or "").split():
            want[k, stem(w)] = want.get((k, stem(w)), 0) + 1
    got = lexical.term_counts(docs, stemmed=True)
    assert {(r.id, r.term): r.tf for r in got.collect()} == want
    assert got.filter(F.col("doc_len") != F.when(F.col("id") == 0, 4).otherwise(3)).count() == 0


def test_many_stems_are_merged_and_only_frequent_words_copied(spark, monkeypatch):
    """Copies of the stems were taken for a small table and broadcast, 64 rows a word."""
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(k, "running cats walking dogs") for k in range(30)], "id long, text string")
    met = lexical.stemmed_terms(lexical.term_counts(docs, stemmed=False))
    assert "SortMergeJoin" in plan(met) and "sequence" not in plan(met).split("SortMergeJoin")[0]
    rows = spark.createDataFrame([(k, "a" if k < 25 else "b" if k < 29 else None) for k in range(30)], "id long, w string")
    table = spark.createDataFrame([("a", 1), ("c", 2)], "w string, v int")
    got = skew.join_unique(rows, table, "w", ["id"], limit=10)
    assert sorted((r.id, r.w, r.v) for r in got.collect()) == [(k, "a" if k < 25 else "b" if k < 29 else None, 1 if k < 25 else None) for k in range(30)]
