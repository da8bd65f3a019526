"""Retrieval: words, chunks, BM25, vectors, fusion, redundancy, prompts, memory."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fundlens.plans import views
from fundlens.text import chat, chunks, documents, hybrid, lexical, vectors
from fundlens.text.tokens import STOP_WORDS, stem, words
from tests.helpers import plan


@pytest.mark.parametrize(
    "word,root",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("failing", "fail"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("vietnamization", "vietnam"), ("operator", "oper"), ("hopefulness", "hope"), ("formalize", "formal"),
        ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"),
        ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"),
        ("roll", "roll"), ("at", "at"),
    ],
)
def test_stems(word, root):
    assert stem(word) == root


def test_words(spark):
    df = spark.createDataFrame([("The U.S.A cats e.g. a Ünï_x, 3.5 the",)], "t string")
    assert df.select(words("t")).head()[0] == ["u.s.a", "cats", "e.g", "ünï_x", "3.5"]


def brute_split(text, size, overlap, separators):
    """Literal restatement of the splitting rules, one character list at a time."""
    sep = next(s for s in separators if s in text)
    rest = separators[separators.index(sep) + 1 :]
    if sep == "":
        bits = list(text)
    else:
        bits = [b for b in re.split(f"(?={re.escape(sep)})", text) if b]
    out, window = [], []

    def flush(window):
        result, held = [], []
        for bit in window:
            if sum(map(len, held)) + len(bit) > size and held:
                result.append("".join(held).strip())
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(bit) > size):
                    held.pop(0)
            held.append(bit)
        return [r for r in [*result, "".join(held).strip()] if r]

    for bit in bits:
        if len(bit) < size or not rest:
            window.append(bit)
        else:
            out += flush(window) if window else []
            window = []
            out += brute_split(bit, size, overlap, rest)
    return out + (flush(window) if window else [])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", min_size=1, max_size=120), st.integers(5, 30), st.integers(0, 4))
def test_chunks_match_the_rules(text, size, overlap):
    assert chunks.split_text(text, size, overlap) == brute_split(text, size, overlap, chunks.SEPARATORS)


def test_chunks_cover_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = chunks.chunk(docs).collect()
    assert max(len(r["chunk"]) for r in rows) <= 750
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    joined = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_no"])):
        joined.setdefault(r["doc_id"], []).append(r["chunk"])
    for doc_id, parts in joined.items():
        assert parts[0] == texts[doc_id].strip()[: len(parts[0])]
        assert texts[doc_id].strip().endswith(parts[-1])
        assert all(p in texts[doc_id] for p in parts)


def brute_bm25(docs, queries, k, match):
    tokens = lambda t: [w for w in re.findall(r"\w+(?:\.?\w+)*", t.lower()) if len(w) > 1 and w not in STOP_WORDS]
    parsed = {i: tokens(t) for i, t in docs}
    n, avg = len(docs), sum(map(len, parsed.values())) / len(docs)
    df = {}
    for ts in parsed.values():
        for w in set(ts):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, text in queries:
        wanted, found = set(tokens(text)), []
        for i, ts in parsed.items():
            hits = [w for w in wanted if w in ts]
            if not hits or (match == "all" and len(hits) < len(wanted)):
                continue
            score = sum(
                (math.log(n / (df[w] + 1)) + 1) * ts.count(w) * 2.2 / (ts.count(w) + 1.2 * (0.25 + 0.75 * len(ts) / avg))
                for w in hits
            )
            found.append((-round(score, 6), i))
        out += [(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


DOCS = [(i, " ".join(random.Random(i).choices(["red", "blue", "green", "cat", "dog", "the"], k=3 + i % 7))) for i in range(40)]
QUESTIONS = [(1, "red cat"), (2, "blue the dog"), (3, "zebra"), (4, "red red zebra")]


@pytest.mark.parametrize("match", ["all", "any"])
@pytest.mark.parametrize("broadcast_rows", [lexical.BROADCAST_ROWS, 0])
def test_bm25_equals_brute_force(spark, monkeypatch, match, broadcast_rows):
    """Both join forms: broadcast query terms and salted shuffle."""
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", broadcast_rows)
    docs = spark.createDataFrame(DOCS, "id long, text string")
    queries = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    found = lexical.bm25_search(lexical.build_index(docs, stemmed=False), queries, 3, match)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect()) == brute_bm25(DOCS, QUESTIONS, 3, match)
    assert "WindowGroupLimit" in plan(found)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Running cats"), (2, "a cat runs"), (3, "dogs")], "id long, text string")
    index = lexical.build_index(docs)
    lexical.save_index(index, str(tmp_path))
    back = lexical.load_index(spark, str(tmp_path))
    queries = spark.createDataFrame([(1, "cat running")], "query_id long, text string")
    assert sorted(r["id"] for r in lexical.bm25_search(back, queries, 5).collect()) == [1, 2]
    assert (back.n_docs, back.stemmed) == (3, True)


def brute_nearest(vecs, queries, k):
    out = []
    for q, x in queries:
        ranked = sorted((round(float(((np.array(x) - np.array(v)) ** 2).sum()), 6), i) for i, v in vecs)
        out += [(q, i, r + 1) for r, (_, i) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("many", [False, True])
def test_vector_search_equals_brute_force(spark, monkeypatch, many):
    """Few-queries plan and cell plan, with many equal vectors (ties go to the smaller id)."""
    if many:
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
        monkeypatch.setattr(vectors, "CELL_ROWS", 30)
    draw = np.random.default_rng(1)
    vecs = [(i, draw.integers(-2, 3, 3).astype(float).tolist()) for i in range(150)]
    queries = [(i, draw.integers(-2, 3, 3).astype(float).tolist()) for i in range(20)]
    found = vectors.vector_search(
        spark.createDataFrame(vecs, "id long, embedding array<float>").repartition(5),
        spark.createDataFrame(queries, "query_id long, vector array<float>"), 4)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect()) == brute_nearest(vecs, queries, 4)


def test_no_queries(spark):
    vecs = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    none = spark.createDataFrame([], "query_id long, vector array<float>")
    assert vectors.vector_search(vecs, none, 3).count() == 0


def test_embedding_is_a_unit_vector(spark):
    df = vectors.embed_texts(spark.createDataFrame([("Cats dogs  ",), ("dogs CATS",), ("",)], "text string"))
    a, b, c = [np.array(r["embedding"]) for r in df.collect()]
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and not c.any()


def test_pool_keeps_duplicates_and_fusion_merges(spark):
    lex = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    den = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    assert hybrid.pool(lex, den).count() == 4
    best = hybrid.hybrid_search(lex, den, 2).orderBy("rank").collect()
    assert [r["id"] for r in best] == [11, 10]


def test_rerank_takes_any_scorer(spark):
    c = spark.createDataFrame([(1, 1, "aa"), (1, 2, "a"), (1, 3, "aaa")], "query_id long, id long, text string")
    assert [r["id"] for r in hybrid.rerank(c, F.length("text"), 2).orderBy("rank").collect()] == [3, 1]


def test_drop_redundant(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.999, 0.01]), (1, 3, [0.0, 1.0]), (2, 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "query_id long, rank int, embedding array<double>")
    left = sorted((r["query_id"], r["rank"]) for r in hybrid.drop_redundant(df).collect())
    assert left == [(1, 2), (1, 3), (2, 1)]


def test_prompt_and_sources(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "no hits")], "query_id long, text string")
    r = spark.createDataFrame([(1, 2, 7, "B"), (1, 1, 9, "A")], "query_id long, rank int, id long, text string")
    prompts = {x["query_id"]: x["prompt"] for x in hybrid.build_prompts(q, r).collect()}
    assert prompts[1].split("\n")[1:] == ["A", "", "B", "User Question:", "why?", "Answer:"]
    assert {x["query_id"]: x["sources"] for x in hybrid.source_ids(q, r).collect()} == {1: "9, 7", 2: "none"}


def test_memory_of_a_hot_conversation(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c, n in ((1, 500), (2, 6)) for t in range(0, 3 * n, 3)]
    rows += [(1, 1, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pick = lambda x: sorted((r["conv_id"], r["turn"], [m["turn"] for m in r["history"]]) for r in x.collect())
    plain, split = pick(chat.chat_window(df, 2)), pick(chat.chat_window(df, 2, limit=100, block=50))
    assert plain == split and len(plain) == 506
    assert dict(((c, t), h) for c, t, h in plain)[1, 300] == [288, 291, 294, 297]


def test_documents_of_a_hot_project_are_whole(spark, sf):
    base = views.store(spark, sf)
    scored = base.projects.select("*", *views.scored_columns())
    def whole(limit):
        out = {}
        for r in sorted(documents.build_documents(scored, base, limit).collect(), key=lambda r: (r["id"], r["part"])):
            out.setdefault(r["id"], []).append(r["text"])
        return out
    plain, split = whole(50_000), whole(6)
    assert max(len(v) for v in plain.values()) == 1 < max(len(v) for v in split.values())
    for key, parts in split.items():
        assert parts[0].startswith(plain[key][0].split(documents.MEMBERS)[0])
        assert sorted(re.findall(r"- [^:]*, activity: [^-]*SME\.", " ".join(parts))) == sorted(
            re.findall(r"- [^:]*, activity: [^-]*SME\.", plain[key][0]))


def test_shown_number(spark):
    df = spark.createDataFrame([(12345678.0,), (1.5,), (123456789.25,), (None,)], "x double")
    assert [r[0] for r in df.select(documents.shown_number("x")).collect()] == ["12345678.0", "1.5", "123456789.25", "None"]


def test_long_dotted_run(spark):
    """A run of 100,000 dotted parts is one word and needs no recursion."""
    text = ".".join(["a"] * 100_000)
    row = spark.createDataFrame([(text, "..e.g. x..yy .zz. a.b..c.d")], "t string, s string").select(words("t").alias("t"), words("s").alias("s")).first()
    assert row["t"] == [text] and row["s"] == ["e.g", "yy", "zz", "a.b", "c.d"]


@pytest.mark.parametrize("many", [False, True])
def test_vector_search_with_text_ids(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
        monkeypatch.setattr(vectors, "CELL_ROWS", 7)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(20, 4)).astype(np.float32)
    numbers = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<float>")
    texts = numbers.withColumn("id", F.format_string("p%02d", "id"))
    probe = lambda df: df.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    plain = vectors.vector_search(numbers, probe(numbers), 3)
    named = vectors.vector_search(texts, probe(texts), 3)
    assert [t for _, t in named.dtypes][:2] == ["string", "string"]
    want = {(f"p{r['query_id']:02d}", f"p{r['id']:02d}", r["rank"]) for r in plain.collect()}
    assert {(r["query_id"], r["id"], r["rank"]) for r in named.collect()} == want
