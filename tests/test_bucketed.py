"""Stored layouts: same rows as the plain forms, and no shuffle of what is stored."""

import random

import pytest
from pyspark.sql import functions as F

from fundlens.operators import stored
from fundlens.operators.fold import fold_tables
from fundlens.text import clauses, lexical
from tests.helpers import children, plan


@pytest.fixture
def no_broadcast(spark):
    """As for tables that are too large to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def made(spark, n=300):
    rng = random.Random(1)
    hot = lambda: 7 if rng.random() < 0.4 else rng.randint(0, 40)
    first = children(spark, [(hot(), k, f"a{k}", k % 3) for k in range(n)] + [(None, n, "lost", 0)], ["projectID", "seq", "name", "kind"])
    second = children(spark, [(rng.randint(30, 60), k, None if k % 5 == 0 else f"b{k}") for k in range(n)], ["projectID", "seq", "title"])
    return {"first": (first, {"name": "list_name", "kind": "list_kind"}), "second": (second, {"title": "list_title", "absent": "list_absent"})}


@pytest.mark.parametrize("limit", [500, 10])
def test_stored_children_fold_alike_without_exchange(spark, tmp_path, no_broadcast, limit):
    tables = made(spark)
    kept = stored.store_children(tables, str(tmp_path), f"fold{limit}", 4, limit)
    got = stored.fold_stored(kept)
    assert "Exchange" not in plan(got)
    want, _ = fold_tables(tables, limit)
    key = lambda df: sorted((str(tuple(r)) for r in df.select("id", "part", "list_name", "list_kind", "list_title").collect()))
    assert key(got) == key(want)
    again = stored.open_children(spark, {n: c for n, (_, c) in tables.items()}, str(tmp_path), f"again{limit}", 4)
    assert "Exchange" not in plan(stored.fold_stored(again)) and key(stored.fold_stored(again)) == key(want)


@pytest.mark.parametrize("limit", [500, 10])
def test_projects_come_to_the_stored_lists(spark, tmp_path, no_broadcast, limit):
    """Only ids and keys are moved: the join with the projects has no exchange of lists."""
    tables = made(spark)
    kept = stored.store_children(tables, str(tmp_path), f"wide{limit}", 4, limit)
    projects = spark.createDataFrame([(k % 70, f"p{k}") for k in range(75)] + [(None, "lost")], "id long, title string")
    got = stored.with_lists(projects, kept)
    assert not any("list_" in line for line in plan(got).splitlines() if "Exchange" in line)
    want = projects.join(fold_tables(tables, limit)[0], "id", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    key = lambda df: sorted(str(tuple(r)) for r in df.select("id", "part", "title", "list_name", "list_kind", "list_title").collect())
    assert key(got) == key(want)


def test_bucketed_postings_are_searched_where_they_lie(spark, tmp_path, no_broadcast):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)] + ["often"] * 30
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=12))) for k in range(200)], "id long, text string")
    index = lexical.build_index(docs, stemmed=False)
    held = lexical.save_bucketed(index, str(tmp_path), "plain", 4)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=3))) for q in range(20)], "query_id long, text string")
    key = lambda i, match: sorted(map(tuple, lexical.bm25_search(i, asked, 4, match).collect()))
    for match in ("all", "any"):
        assert key(held, match) == key(index, match)
    opened = lexical.load_bucketed(spark, str(tmp_path), "opened", 4)
    assert key(opened, "any") == key(index, "any") and opened.n_docs == 200
    terms = spark.createDataFrame([("w1", 1), ("often", 1)], "term string, n_terms long")
    hits = lexical.term_hits(held, terms)
    text = plan(hits, "simple")
    assert "SortMergeJoin" in text
    join = text[text.index("SortMergeJoin") :]
    postings_side = join[: join.index("plain_postings")]
    assert "Exchange" not in postings_side and "Exchange" in join[join.index("plain_postings") :]


def test_bucketed_positions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "new york city"), (2, "york new city"), (3, "new york")], "id long, text string")
    held = lexical.save_bucketed(clauses.build_positions(docs), str(tmp_path), "placed", 3)
    asked = spark.createDataFrame([(1, 0, "must", "phrase", "new york"), (1, 1, "should", "prefix", "ci")], "query_id long, clause long, kind string, form string, text string")
    assert [r.id for r in clauses.clause_search(held, asked, 5).orderBy("rank").collect()] == [1, 3]
    assert clauses.clause_search(held, asked.filter(F.col("clause") > 5), 5).count() == 0
