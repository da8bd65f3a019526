"""Quality rules, toxicity and language ID: counts against brute force, held-out accuracy, odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.llm import language_id, linear, quality, queries, toxicity


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute_counts(text):
    text = text or ""
    own = words(text)
    runs = Counter(tuple(own[k : k + 3]) for k in range(len(own) - 2))
    covered = {k + d for k in range(len(own) - 2) if runs[tuple(own[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
    return len(own), sum(map(len, own)), symbols, dup, len(covered), failed


def test_grams_and_word_hashes():
    raw = np.frombuffer("ab  ab\tc é ab".encode(), dtype=np.uint8)
    own = linear.word_hashes(raw)
    assert len(own) == 5 and own[0] == own[1] == own[4] != own[2]
    assert len(linear.grams(raw, 4, 16)) == len(raw) - 3 and len(linear.grams(raw[:2], 4, 16)) == 0
    assert len(linear.word_hashes(raw[:0])) == 0
    long = np.frombuffer(b"x" * 1000, dtype=np.uint8)
    assert len(linear.word_hashes(long)) == 1


def test_quality_query_counts_and_accuracy(spark, sf):
    rows = queries.op5_quality_rules(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


@pytest.fixture(scope="module")
def labelled(spark):
    """Good prose and symbol junk, mild and rude texts, half of them unlabelled."""
    rng = random.Random(5)
    syllables = ["the", "an", "tion", "er", "re", "in", "st", "ou", "ha", "ble"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(400):
        junk, rude = rng.random() < 0.3, rng.random() < 0.3
        own = [word() + (rng.choice(["$$$", "###", "***"]) if junk else "") for _ in range(80)]
        if rude:
            own[rng.randrange(80)] = rng.choice(["grobfel", "idiotus", "Idiot", "grobfels"])
        docs.append((k, " ".join(own)))
        labels.append((k, int(not junk), int(rude)))
    return docs, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark, make_docs, labelled):
    docs, labels = labelled
    model = quality.fit_quality(make_docs(docs), table(spark, labels[:200]))
    kept = {r.doc_id: r.kept for r in quality.judged(make_docs(docs), "text", model).collect()}
    right = [kept[d] == bool(q) for d, q, _ in labels[200:]]
    assert sum(right) / len(right) >= 0.95


def test_toxicity_held_out(spark, make_docs, labelled):
    docs, labels = labelled
    model = toxicity.fit_toxicity(make_docs(docs), table(spark, labels), F.col("doc_id") < 200)
    score = {r.doc_id: r.score for r in toxicity.scored(make_docs(docs), "text", model).collect()}
    assert all(0 <= s <= 1 for s in score.values())
    right = [(score[d] >= 0.5) == bool(t) for d, _, t in labels[200:]]
    assert sum(right) / len(right) >= 0.95


def test_character_counts(monkeypatch):
    """Runs of code points, not bytes; a text in many blocks counts the same."""
    text = "réeux achlich 字字字 \U0001f389 réeux " * 40
    sizes, bits = (3, 4, 5, 6), 18
    whole = dict(zip(*(x.tolist() for x in linear.char_counts(text, sizes, bits))))
    runs = Counter(text[k : k + n] for n in sizes for k in range(len(text) - n + 1))
    slot = lambda run: linear.char_counts(run, (len(run),), bits)[0][0]
    want = Counter()
    for run, n in runs.items():
        want[int(slot(run))] += n
    assert whole == want
    for block in (1, 5, 97, len(text) - 1):
        monkeypatch.setattr(linear, "BLOCK", block)
        assert dict(zip(*(x.tolist() for x in linear.char_counts(text, sizes, bits)))) == whole
    assert all(len(x) == 0 for x in linear.char_counts("ab", sizes, bits))
    assert len(linear.char_counts("\ud800abc", sizes, bits)[0]) == 3


def test_toxicity_held_out_per_language(spark):
    """At least half of the held-out toxic rows of every language, and hardly a clean row."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("_lang")), "doc_id"
    )
    found = rows.filter("held_out").groupBy("_lang").agg(
        F.sum("toxic").alias("n"), F.sum(F.col("toxic") * F.col("predicted")).alias("hits"),
        F.sum((1 - F.col("toxic")) * F.col("predicted")).alias("wrong"), F.count("*").alias("all"),
    ).collect()
    print(sorted((r["_lang"], r["hits"], r["n"], r["wrong"], r["all"]) for r in found))
    assert len(found) == 4 and all(2 * r["hits"] >= r["n"] and r["wrong"] <= 0.02 * r["all"] for r in found)


def test_without_labels_of_both_classes(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    for rows in ([], [(4, 1, 0), (5, 1, 0), (None, 0, 1), (4, None, None)]):
        judged = quality.judged(docs, "text", quality.fit_quality(docs, table(spark, rows))).collect()
        assert len(judged) == len(odd_rows) and all(r.kept == (not r.base_failed) for r in judged)
        model = toxicity.fit_toxicity(docs, table(spark, rows), F.lit(True))
        assert {round(r.score, 6) for r in toxicity.scored(docs, "text", model).collect()} == {0.0}


def test_repeated_and_clashing_rows(spark, make_docs, labelled):
    docs, labels = labelled
    own = make_docs(docs[:60] + docs[:60]).withColumns({"y": F.lit(1), "w": F.lit(2), "h": F.lit(3), "score": F.lit("x")})
    known = table(spark, labels[:60] + labels[:60])
    model = toxicity.fit_toxicity(own, known, F.lit(True))
    out = toxicity.scored(own, "text", model, "_score")
    assert out.count() == 120 and out.first().score == "x"
    assert out.groupBy("doc_id").agg(F.countDistinct("_score").alias("n")).filter("n > 1").count() == 0
    assert quality.judged(make_docs([]), "text", quality.fit_quality(own, known)).count() == 0


def test_sample_is_bounded_and_weighted(spark, make_docs, labelled):
    from fundlens.llm.sample import labelled_sample

    docs, labels = labelled
    rows = labelled_sample(make_docs(docs), table(spark, labels), "toxic", 20, F.lit(True)).collect()
    n = Counter(t for *_, t in labels)
    assert Counter(r.y for r in rows) == {0.0: 20, 1.0: 20}
    assert {(r.y, r.w) for r in rows} == {(y, n[y] / 20) for y in (0, 1)}


def test_language_held_out(spark, sf):
    rows = queries.op9_language_id(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    own = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) / len(own) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} <= {*lang.values(), "und"}


def test_passages_lie_anywhere_in_a_text(make_docs):
    """A head that all texts share is not what the dictionaries hold, and no passage is longer than asked for."""
    texts = ["head " * 100 + f"{k:04d} body é " * 400 for k in range(60)]
    docs = make_docs([(k, t, "de", "s") for k, t in enumerate(texts)] + [(60, "kurz", "nl", "s"), (61, None, "nl", "s")])
    found = language_id.fit_dictionaries(docs, F.lit(True), passage=200)
    passages = found["de"].decode().split("\n")
    assert found["nl"] == b"kurz" and len(passages) == 60 and {len(p) for p in passages} == {200}
    assert all(any(p in t for t in texts) for p in passages) and sum("body" in p for p in passages) > 45
    assert found == language_id.fit_dictionaries(docs.repartition(3), F.lit(True), passage=200)


def test_language_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows).withColumn("score", F.lit("own"))
    contents = language_id.fit_dictionaries(docs, F.lit(True))
    assert set(contents) == {"en", "de", "fr"}
    rows = language_id.predicted(docs, "text", contents, ("pred", "sure", "ok")).collect()
    for r in rows:
        assert (r.pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert r.score == "own" and 0 <= r.sure <= 1
    assert {r.lang_pred for r in language_id.predicted(make_docs([(1, "abc")]), "text", {}).collect()} == {"und"}
    assert language_id.predicted(make_docs([]), "text", contents).count() == 0
    assert language_id.fit_dictionaries(make_docs([]), F.lit(True)) == {}


def test_ties_go_to_the_first_language():
    own = language_id.Classifier({"b": b"same content " * 20, "a": b"same content " * 20})
    assert own.judge("same content") == ("a", 0.0, False)
