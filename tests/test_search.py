"""Clause search and pruned BM25 against plain loops over the documents."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fundlens.text import clauses, lexical, pruned
from fundlens.text.tokens import STOP_WORDS
from tests.helpers import plan

VOCABULARY = "new york city river park bridge of the old stone newton news cited".split()


def tokens(text):
    return [w for w in re.findall(r"\w+", (text or "").lower()) if len(w) >= 2 and w not in STOP_WORDS]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 25)))) for k in range(150)]
    return [*rows, (900, None), (901, "New York new york New   YORK, city"), (902, "of the")]


def weights(docs):
    """Per document the BM25 weight of each of its words."""
    words = {k: tokens(t) for k, t in docs}
    average = sum(map(len, words.values())) / len(words)
    df = {}
    for own in words.values():
        for w in set(own):
            df[w] = df.get(w, 0) + 1


    def weight(k, w):
        tf, n = words[k].count(w), len(words[k])
        return (math.log(len(words) / (df[w] + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average))

    return words, weight


def brute(docs, rows):
    words, weight = weights(docs)
    found = []
    for q in {r[0] for r in rows}:
        own = [(kind, form, tokens(t) if form != "prefix" else (t or "").strip().lower()) for p, _, kind, form, t in rows if p == q]
        own = [c for c in own if c[2]]
        for k, text in words.items():
            def holds(form, what, text=text):
                if form == "words":
                    return set(what) <= set(text)
                if form == "phrase":
                    return any(text[i : i + len(what)] == what for i in range(len(text)))
                return any(w.startswith(what) for w in text)

            held = {kind: [holds(form, what) for kd, form, what in own if kd == kind] for kind in clauses.KINDS}
            if any(held["must_not"]) or not all(held["must"]) or not (held["must"] or any(held["should"])):
                continue
            score = 0.0
            for kind, form, what in own:
                if kind != "must_not" and holds(form, what):
                    parts = set(what) if form == "words" else what if form == "phrase" else []
                    score += 1.0 if form == "prefix" else sum(weight(k, w) for w in parts)
            found.append((q, k, round(score, 5)))
    return sorted(found)


def test_clauses_equal_brute_force(spark, docs):
    rng = random.Random(6)
    rows = []
    for q in range(60):
        for c in range(rng.randint(1, 4)):
            form = rng.choice(clauses.FORMS)
            text = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 3)))
            rows.append((q, c, rng.choice(clauses.KINDS), form, text if form != "prefix" else rng.choice(["new", "NEW ", "c", "sto", "zz", " "])))
    rows += [(100, 0, "must", "phrase", "new york new york"), (101, 0, "must", "words", "the of"), (102, 0, "must_not", "words", "new")]
    rows += [(103, 0, "must", "words", "york york"), (103, 1, "must", "words", "the"), (104, 0, "must", "phrase", None)]
    index = clauses.build_positions(spark.createDataFrame(docs, "id long, text string"))
    asked = spark.createDataFrame(rows, "query_id long, clause long, kind string, form string, text string")
    got = sorted((r.query_id, r.id, round(r.score, 5)) for r in clauses.clause_scores(index, asked).collect())
    want = brute(docs, rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-5 for g, w in zip(got, want, strict=True))
    assert {g[0] for g in got if g[0] >= 100} == {100, 103}


def test_many_terms_are_joined_with_salts(spark, docs, monkeypatch):
    table = spark.createDataFrame(docs, "id long, text string")
    index = clauses.build_positions(table)
    asked = spark.createDataFrame([(1, 0, "must", "phrase", "new york"), (1, 1, "should", "prefix", "ne")], "query_id long, clause long, kind string, form string, text string")
    plain = sorted(map(tuple, clauses.clause_scores(index, asked).collect()))
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, clauses.clause_scores(index, asked).collect())) == plain


def test_clauses_over_stems_and_no_documents(spark):
    index = clauses.build_positions(spark.createDataFrame([(1, "running rivers"), (2, "rivers run")], "id long, text string"), stemmed=True)
    schema = "query_id long, clause long, kind string, form string, text string"
    asked = spark.createDataFrame([(1, 0, "must", "phrase", "run river")], schema)
    assert [r.id for r in clauses.clause_search(index, asked, 5).collect()] == [1]
    none = clauses.build_positions(spark.createDataFrame([], "id long, text string"))
    assert clauses.clause_search(none, asked, 5).count() == 0
    assert clauses.clause_search(index, spark.createDataFrame([], schema), 5).count() == 0


@pytest.mark.parametrize(("k", "block_docs", "pilot"), [(3, 4, 2), (5, 1, 1), (200, 16, 3), (1, 500, 1)])
def test_pruned_rows_are_the_plain_ones(spark, docs, monkeypatch, k, block_docs, pilot):
    monkeypatch.setattr(pruned, "PILOT", pilot)
    index = lexical.build_index(spark.createDataFrame(docs, "id long, text string"), stemmed=False)
    rng = random.Random(k)
    asked = [(q, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 4)))) for q in range(25)] + [(77, "absent"), (78, None)]
    asked = spark.createDataFrame(asked, "query_id long, text string")
    blocks = pruned.build_blocks(index, block_docs)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    assert key(pruned.pruned_search(blocks, asked, k)) == key(lexical.bm25_search(index, asked, k, match="any"))


def test_pruning_reads_fewer_postings(spark):
    """A rare word decides; the many blocks with only the frequent one are skipped."""
    rows = [(k, "common " + ("rare " * 3 if k % 97 == 0 else "other words here " * (k % 3))) for k in range(2000)]
    index = lexical.build_index(spark.createDataFrame(rows, "id long, text string"), stemmed=False)
    asked = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    blocks = pruned.build_blocks(index, 8)
    row = pruned.postings_read(blocks, asked, 5).first()
    assert row.n_all == 2000 + 21 and row.n_read < 500
    key = lambda df: sorted((r["rank"], r.id, r.score) for r in df.collect())
    assert key(pruned.pruned_search(blocks, asked, 5)) == key(lexical.bm25_search(index, asked, 5, match="any"))


@pytest.mark.parametrize("match", ["all", "any"])
def test_search_in_tiles_equals_all_scores(spark, docs, monkeypatch, match):
    """Hits stay in tiles of bounded size; rows of null and repeated ids, also of other lengths, count as before."""
    odd = [*docs, docs[3], (docs[5][0], "new york new"), (None, "york city of storms"), (None, "new")]
    index = lexical.build_index(spark.createDataFrame(odd, "id long, text string"), stemmed=False)
    rng = random.Random(5)
    asked = [(f"q{q}", " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 4)))) for q in range(30)] + [(None, "new"), ("q1", "york")]
    asked = spark.createDataFrame(asked, "query_id string, text string")
    want = lexical.top_k(lexical.bm25_scores(index, asked, match), 4)
    for name, size in (("TILE_DOCS", 9), ("TILE_TERMS", 20), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(lexical, name, size)
    got = lexical.bm25_search(index, asked, 4, match)
    key = lambda df: sorted((r.query_id, r["rank"], r.id is None, r.id or 0, round(r.score, 5)) for r in df.collect())
    assert key(got) == key(want) and "FlatMapCoGroupsInArrow" in plan(got)


def test_hits_of_clauses_are_not_shuffled(spark, docs):
    """Only matching documents leave a tile: the plan has no exchange by (query, document)."""
    index = clauses.build_positions(spark.createDataFrame(docs, "id long, text string"))
    asked = spark.createDataFrame([(1, 0, "must", "phrase", "new york"), (1, 1, "should", "prefix", "ne")], "query_id long, clause long, kind string, form string, text string")
    plan = clauses.clause_scores(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "hashpartitioning(query_id" not in plan


def test_copies_of_documents_and_clauses_without_known_words(spark):
    """Documents that share an id count as one; a required clause without a known word finds nothing."""
    index = clauses.build_positions(spark.createDataFrame([(1, "new york city"), (1, "new york city"), (2, "york new")], "id long, text string"))
    rows = [(1, 0, "must", "phrase", "new york"), (2, 0, "must", "words", "new"), (2, 1, "must", "words", "zebra"), (3, 0, "must_not", "words", "city"),
            (4, 0, "should", "prefix", "ci"), (4, 1, "should", "words", "york"), (4, 2, "must_not", "phrase", "york new")]
    asked = spark.createDataFrame(rows, "query_id long, clause long, kind string, form string, text string")
    assert sorted((r.query_id, r.id) for r in clauses.clause_scores(index, asked).collect()) == [(1, 1), (4, 1)]


def test_words_are_counted_where_the_texts_were_dealt(spark, monkeypatch):
    """Tasks are as many as the characters need, not as the table has splits, and counts are not moved."""
    monkeypatch.setattr(lexical, "TASK_CHARS", 100)
    texts = spark.createDataFrame([(k, "new york city " * 5) for k in range(60)] + [(None, None)], "id long, text string").coalesce(1)
    assert lexical.dealt_texts(texts).rdd.getNumPartitions() == 42
    counts = lexical.term_counts(texts, stemmed=False)
    assert "Exchange" not in plan(counts).split("Generate")[0]
    assert sorted((r.id, r.term, r.tf, r.doc_len) for r in counts.collect()) == sorted((k, w, 5, 15) for k in range(60) for w in ("new", "york", "city"))


def test_tiles_have_partitions_of_their_own(spark, docs, monkeypatch):
    """A task sorts few tiles, however few the shuffle partitions are."""
    monkeypatch.setattr(lexical, "TILE_DOCS", 4)
    index = lexical.build_index(spark.createDataFrame(docs, "id long, text string"), stemmed=False)
    asked = spark.createDataFrame([(1, "new york"), (2, "stone")], "query_id long, text string")
    tiles = -(-index.n_docs // 4)
    found = lexical.bm25_search(index, asked, 3, match="any")
    dealt = re.findall(r"hashpartitioning\(tile#\d+, (?:part#\d+|0), (\d+)\)", plan(found))
    assert dealt == [str(2 * tiles)] * 2
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    assert key(found) == key(lexical.top_k(lexical.bm25_scores(index, asked, "any"), 3))


def test_packs_travel_to_the_tiles(spark, docs, monkeypatch):
    """Postings and query terms are copied as packs, not row by row; many small packs give the same rows."""
    index = lexical.build_index(spark.createDataFrame([*docs, (None, "new york")], "id long, text string"), stemmed=False)
    asked = spark.createDataFrame([("a", "new york"), ("b", "stone"), (None, "river")], "query_id string, text string")
    key = lambda df: sorted((r.query_id or "", r["rank"], r.id is None, r.id or 0, r.score) for r in df.collect())
    found = lexical.bm25_search(index, asked, 3, match="any")
    moved = re.findall(r"Input \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\((?:tile|part)", plan(found))
    assert moved and all("pack" in m and "term" not in m for m in moved)
    want = key(found)
    monkeypatch.setattr(lexical, "PACK_BYTES", 1)
    assert key(lexical.bm25_search(index, asked, 3, match="any")) == want


def test_blocks_store_and_move_no_postings_again(spark, docs, monkeypatch):
    index = lexical.build_index(spark.createDataFrame(docs, "id long, text string"), stemmed=False)
    monkeypatch.setattr(pruned, "materialize", None)
    blocks = pruned.build_blocks(index, 4)
    assert "Exchange" not in plan(blocks.postings)
    n_blocks = -(-index.n_docs // 4)
    block = {r.id: r.b for r in index.postings.select("id", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b")).collect()}
    most = {}
    for r in index.postings.select("term", "id", lexical.saturation(index.avg_len).alias("s")).collect():
        most[r.term, block[r.id]] = max(r.s, most.get((r.term, block[r.id]), 0))
    assert {(r.term, r.block): r.most for r in blocks.maxima.collect()} == pytest.approx(most)


def test_positions_stay_where_the_texts_were_dealt(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(clauses, "materialize", lambda df: kept.append(df) or df)
    clauses.build_positions(spark.createDataFrame([(k, "new york city new") for k in range(30)], "id long, text string"))
    text = plan(kept[0], "simple")
    assert text.count("Exchange") == 1
