"""Browse, statistics, folding, hot-key and ordering operators on small rows."""

import datetime
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fundlens.functions import lists
from fundlens.functions.buckets import BUCKETS
from fundlens.functions.names import readable_name, top_contributions
from fundlens.operators import browse, fold, ordering, skew, stats
from fundlens.operators.filters import Filters, apply_filters, from_params, project_predicate, with_folded
from fundlens.plans import views
from tests.helpers import children, plan


@pytest.fixture(scope="module")
def store(spark, sf):
    base = views.store(spark, sf)
    return base.replace(projects=base.projects.select("*", *views.scored_columns()))


def test_bucket_edges(spark):
    values = [99_999.0, 100_000.0, 499_999.0, 500_000.0, 4.9e6, 5e6, 1e7, None]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = {r["label"]: r["value"] for r in stats.amount_histogram(df, "a").collect()}
    assert [got.get(label, 0) for label, _ in BUCKETS] == [1, 2, 1, 1, 1, 2]


def test_null_label_takes_a_slot(spark):
    rows = [(None,)] * 5 + [(f"s{i:02d}",) for i in range(12)]
    out = stats.top_schemes(spark.createDataFrame(rows, "fundingScheme string")).collect()
    assert [r["label"] for r in out] == [f"s{i:02d}" for i in range(9)]


def test_series_agree_with_single_charts(store):
    every = {}
    for r in stats.chart_series(store).collect():
        every.setdefault(r["chart"], []).append((r["label"], r["value"]))
    pairs = lambda df: [(str(r["label"]), float(r["value"])) for r in df.collect()]
    assert every["ppy"] == pairs(stats.projects_per_year(store.projects))
    assert every["psd"] == pairs(stats.amount_histogram(store.projects, "totalCost"))
    assert every["frb"] == pairs(stats.amount_histogram(store.projects, "ecMaxContribution"))
    assert every["frs"] == pairs(stats.top_schemes(store.projects))
    assert every["top10"] == pairs(stats.top_topics(store.projects, store.vocabulary))
    assert every["ppc"] == pairs(stats.top_countries(store.projects, store.organizations))


def test_parameters_and_alias():
    f = from_params({"topics": "x", "minYear": "2000", "unknown": "1", "status": ""})
    assert (f.topic, f.min_year, f.status) == ("x", "2000", "")


def test_literal_search(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, "axb")], "id long, title string")
    ids = lambda f: sorted(r["id"] for r in df.filter(project_predicate(df, f)).collect())
    assert ids(Filters(search="A.B")) == [1, 2]
    assert ids(Filters(search="A.B", literal=True)) == [1]


def test_bad_pattern_raises(spark):
    df = spark.createDataFrame([(1, "a")], "id long, title string")
    with pytest.raises(Exception):
        df.filter(project_predicate(df, Filters(search="("))).collect()


def test_year_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    days = [(i, datetime.date(1995 + i, 1, 1), "T") for i in range(5)]
    with_folded(
        spark.createDataFrame(days, "id long, startDate date, title string")
        .withColumn("status", F.lit("A")).withColumn("legalBasis", F.lit("B")).withColumn("fundingScheme", F.lit("C"))
    ).write.parquet(path)
    df = spark.read.parquet(path)
    kept = df.filter(project_predicate(df, Filters(min_year="1996", max_year="1997", status="a")))
    text = plan(kept)
    assert "GreaterThanOrEqual(startDate,1996-01-01)" in text and "LessThan(startDate,1998-01-01)" in text
    assert "EqualTo(_status_lc,a)" in text
    assert sorted(r["id"] for r in kept.collect()) == [1, 2]


def test_sort_puts_nulls_first_both_ways(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, None)], "id long, v int")
    for order, ids in (("asc", [2, 4, 1, 3]), ("desc", [2, 4, 3, 1])):
        assert [r["id"] for r in browse.page_rows(df, 0, 10, "v", order).collect()] == ids


def test_pages_join_to_the_full_sort(store):
    df = store.projects.select("id", "totalCost")
    full = [r["id"] for r in df.orderBy(F.col("totalCost").desc_nulls_first(), "id").collect()]
    paged = [r["id"] for p in range(4) for r in browse.page_rows(df, p, 25, "totalCost").collect()]
    assert paged == full[:100]


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_keyset_pages_equal_offset_pages(store, order):
    df = store.projects.select("id", "totalCost")
    last_value, last_id, seen = None, -1, []
    page = browse.page_rows(df, 0, 30, "totalCost", order).collect()
    while len(seen) < 90:
        seen += [r["id"] for r in page]
        last_value, last_id = page[-1]["totalCost"], page[-1]["id"]
        page = browse.page_after(df, last_value, last_id, 30, "totalCost", order).collect()
    assert seen == [r["id"] for r in browse.page_rows(df, 0, 90, "totalCost", order).collect()]


def test_list_of_unscored_projects(spark, sf):
    rows = browse.list_projects(views.store(spark, sf), Filters(status="closed"), limit=3).collect()
    assert len(rows) == 3 and all(r["status"] == "CLOSED" for r in rows)
    assert "explanations" not in rows[0].asDict() and isinstance(rows[0]["publications"], dict)


def test_unknown_sort_field_falls_back(store):
    a = browse.page_rows(store.projects, sort_field="").select("id").collect()
    assert a == browse.page_rows(store.projects, sort_field="startDate").select("id").collect()


def test_page_is_a_top_k_plan(store):
    assert "TakeOrderedAndProject" in plan(browse.page_rows(store.projects, 2))


def test_unknown_status_rule(store):
    nulls = store.projects.filter("status is null").count()
    assert apply_filters(store, Filters(status="UNKNOWN")).count() == nulls > 0
    assert apply_filters(store, Filters(status="UNKNOWN"), unknown_is_null=False).count() == 0


def test_facet_cap(store):
    full = browse.facets(store).collect()
    capped = browse.facets(store, cap=3).collect()
    assert [r for r in full if r["facet"] == "countries"][:3] == [r for r in capped if r["facet"] == "countries"]


def test_unknown_project_is_empty(store):
    assert browse.project_organizations(store, "99999999").count() == 0


def test_fold_keeps_nulls_and_order(spark):
    kids = children(spark, [(1, 2, None, "b"), (1, 1, "x", "a"), (1, 3, "y", None), (2, 1, "z", "c")],
                    "projectID long, seq int, u string, v string")
    rows = {r["id"]: r for r in fold.fold_children(kids, {"u": "us", "v": "vs"}).collect()}
    assert rows[1]["us"] == ["x", None, "y"] and rows[1]["vs"] == ["a", "b", None]


def test_fold_uses_one_exchange(store):
    text = plan(fold.fold_tables({"a": (store.deliverables, {"url": "u"}), "b": (store.web_links, {"physUrl": "w"})})[0])
    assert text.split("== Physical Plan ==")[1].split("\n\n")[0].count("Exchange") == 1


def test_hot_project_is_split_and_unfolds_whole(spark):
    random.seed(1)
    rows = [(1, i, f"v{i}") for i in range(200)] + [(k, i, f"{k}-{i}") for k in range(2, 20) for i in range(3)]
    random.shuffle(rows)
    kids = children(spark, rows, "projectID long, seq int, v string").withColumn("seg", F.floor(F.col("seq") / 25))
    wide, split = fold.fold_tables({"k": (kids, {"v": "vs"})}, limit=50)
    parts = wide.filter("id = 1").orderBy("part").collect()
    assert split and [len(p["vs"]) for p in parts] == [50] * 4
    assert [v for p in parts for v in p["vs"]] == [f"v{i}" for i in range(200)]
    assert wide.filter("id <> 1").filter("part <> 0").count() == 0
    back = sorted((r["id"], r["pos"], r["v"]) for r in fold.unfold(wide, {"v": "vs"}).collect())
    assert back == sorted(rows)


def test_split_consolidation_keeps_results(spark, store):
    plain = fold.consolidate(store)
    parted = fold.consolidate(store, limit=3)
    assert parted.filter("part > 0").count() > 0
    cols = ["id", "netEcContribution", "ecRatio", "startYear"]
    pick = lambda df: {
        tuple(round(v, 6) if isinstance(v, float) else v for v in r)
        for r in df.select(*cols).distinct().collect()
    }
    assert pick(plain) == pick(parted)
    names = lambda df: df.select("id", F.explode("list_name").alias("n")).groupBy("id", "n").count()
    assert sorted(map(tuple, names(plain).collect()), key=str) == sorted(map(tuple, names(parted).collect()), key=str)


def test_store_from_wide(store):
    """Browsing the wide table gives what browsing the long tables gives, split projects included."""
    for limit in (50_000, 3):
        back = fold.store_from_wide(fold.consolidate(store, limit=limit))
        wanted = Filters(country="NATION_3", status="closed")
        assert back.projects.count() == store.projects.count()
        assert browse.facets(back, wanted).collect() == browse.facets(store, wanted).collect()
    key = lambda s: s.topics.groupBy("projectID", "topic").count().exceptAll
    assert key(back)(store.topics.groupBy("projectID", "topic").count()).count() == 0


def test_unfold_of_unequal_lists(spark):
    wide = spark.createDataFrame([(1, 0, ["a", "b"], ["x"]), (2, 0, None, None)],
                                 "id long, part long, a array<string>, b array<string>")
    assert [tuple(r)[2:] for r in fold.unfold(wide, {"u": "a", "v": "b"}).orderBy("pos").collect()] == [
        (0, "a", "x"), (1, "b", None)]


def test_list_sum(spark):
    df = spark.createDataFrame([(["1", None, "2.5"],), ([],), (None,), ([None],)], "x array<string>")
    assert [r[0] for r in df.select(lists.list_sum(F.col("x"))).collect()] == [3.5, 0.0, None, 0.0]


def test_ratio_by_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0)], "a double, b double")
    out = [r[0] for r in df.select(lists.float_ratio(F.col("a"), F.col("b"))).collect()]
    assert out[:3] == [0.5, math.inf, -math.inf] and math.isnan(out[3]) and out[4] is None


def test_coordinates(spark):
    df = spark.createDataFrame([("1.5,-2",), ("x",), (None,), ("1.5",)], "g string")
    lat, lon = lists.latitude_longitude(F.col("g"))
    assert [tuple(r) for r in df.select(lat, lon).collect()] == [(1.5, -2.0), (None, None), (None, None), (1.5, None)]


def test_publication_counts(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (1, None), (2, "B")], "projectID long, isPublishedAs string")
    assert {r["id"]: r["publications"] for r in fold.publication_counts(df).collect()} == {
        1: {"A": 2, "null": 1}, 2: {"B": 1}}


def test_distinct_values_of_a_list(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "x array<string>")
    assert sorted(str(r["value"]) for r in browse.distinct_values(df, "x").collect()) == ["None", "a", "b"]


def test_feature_list_helpers(spark):
    df = spark.createDataFrame([(["/a/b/c", "/a/d", None], ["en,fr", None, "de"])], "p array<string>, l array<string>")
    row = df.select(lists.inner_levels(F.col("p")), lists.split_items(lists.normalized(F.col("l")))).head()
    assert sorted(row[0]) == ["a", "b"] and row[1] == ["EN", "FR", "DE"]


@pytest.mark.parametrize(
    "raw,name",
    [
        ("cat__fundingScheme_ERC", "Fundingscheme Erc"),
        ("cat__a_b__h2020-eu.1", "A B: H2020-Eu.1"),
        ("num__n_partners", "Number of partners"),
        ("mlb_list_activityType__list_activityType_RES", "List Activitytype: Res"),
        ("mlb_list_x__list_other", "List X: Other"),
        ("mlb_euro__value_a", "List Euro: Value A"),
        ("mlb_list_x", "List X"),
        ("other__thing_x", "Other: Thing X"),
        ("", ""),
        (None, None),
    ],
)
def test_readable_names(spark, raw, name):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(readable_name("raw")).head()[0] == name


def test_top_contributions(spark):
    df = spark.createDataFrame([([("a", -3.0), ("b", 1.0), ("c", 2.0)],)], "p array<struct<name:string,value:double>>")
    row = df.select(*top_contributions("p", 4)).head()
    assert tuple(row) == ("a", -3.0, "c", 2.0, "b", 1.0, None, None)


def test_explanations_skip_missing_pairs(spark):
    cols = {f"top{i}_feature": ("f" if i != 2 else None) for i in range(1, 7)}
    df = spark.range(1).select(
        *[F.lit(v).cast("string").alias(k) for k, v in cols.items()],
        *[F.lit(float(i) if i != 3 else None).cast("double").alias(f"top{i}_shap") for i in range(1, 7)])
    assert [e["shap"] for e in df.select(lists.explanations().alias("e")).head()["e"]] == [1.0, 4.0, 5.0, 6.0]


def test_hot_keys(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(2,)], "k long")
    assert skew.hot_keys(df, "k", 20) is None
    assert [r["k"] for r in skew.hot_keys(df, "k", 5).collect()] == [1]


def test_hot_keys_are_counted_by_hash_first(spark, monkeypatch):
    """Keys that share a full hash bucket are told apart; null is a key like others."""
    monkeypatch.setattr(skew, "HASHES", 1)
    df = spark.createDataFrame([(1,)] * 10 + [(2,)] * 4 + [(None,)] * 6, "k long")
    assert {r["k"] for r in skew.hot_keys(df, "k", 5).collect()} == {1, None}
    assert skew.hot_keys(df, "k", 12) is None


def test_many_children_are_folded_in_tasks_of_bounded_size(spark, monkeypatch):
    """Plain rows are dealt over as many tasks as they need, and the lists stay the same."""
    rows = spark.createDataFrame([(k % 7, k, f"a{k}") for k in range(300)], "projectID long, ord long, name string").withColumn("seg", F.col("ord"))
    key = lambda df: sorted(map(str, df.collect()))
    for limit in (500, 10):
        before = key(fold.fold_children(rows, {"name": "list_name"}, limit))
        with monkeypatch.context() as m:
            m.setattr(fold, "SPREAD_ROWS", 100)
            m.setattr(fold, "ROWS_PER_TASK", 20)
            many = fold.fold_children(rows, {"name": "list_name"}, limit)
            assert key(many) == before
            assert many.rdd.getNumPartitions() == 15


def test_dense_position(spark):
    rows = [(k, i) for k in (1, 2) for i in random.Random(3).sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k long, v long").withColumn("seg", F.floor(F.col("v") / 100))
    got = sorted((r["k"], r["v"], r["pos"]) for r in skew.dense_position(df, "k", "seg", ["v"]).collect())
    assert [p for _, _, p in got] == list(range(300)) * 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60))
def test_exact_median(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    known = sorted(v for v in values if v is not None)
    got = ordering.exact_medians(df, ["x"]).collect()
    if not known:
        assert got == []
    else:
        n = len(known)
        assert got[0]["median"] == (known[(n - 1) // 2] + known[n // 2]) / 2


def test_running_totals_over_many_ranges(spark):
    draw = random.Random(5)
    rows = [(g, float(v), draw.randint(1, 9)) for g in ("a", "b") for v in draw.sample(range(100_000), 4000)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r["g"], r["v"]): r["cum_n"] for r in ordering.running_totals(df, "g", "v", ["n"], 2).collect()}
    for g in ("a", "b"):
        total = 0
        for _, v, n in sorted(r for r in rows if r[0] == g):
            total += n
            assert got[g, v] == total


def test_exact_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert ordering.exact_quantile(df, "x", 0.9).head()[0] == pytest.approx(9.0)
    assert ordering.exact_quantile(df, "x", 0.25).head()[0] == pytest.approx(2.5)
    draw = random.Random(2)
    values = [draw.choice([0.0, draw.gauss(0, 1)]) for _ in range(9000)]
    many = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    for share in (0.0, 0.001, 0.1, 0.5, 0.9, 1.0):
        want = float(np.quantile(values, share))
        assert ordering.exact_quantile(many, "x", share).head()[0] == pytest.approx(want)


def test_slices_have_exact_sizes_and_do_not_overlap(spark):
    df = spark.range(5003).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    cut = ordering.stratified_slices(df, "id", "label", [0.8, 0.2], 42)
    assert cut.count() == 5003 == cut.select("id").distinct().count()
    sizes = {(r["label"], r["slice"]): r["count"] for r in cut.groupBy("label", "slice").count().collect()}
    n1 = 715
    assert sizes[1, 0] == round(n1 * 0.8) and sizes[0, 0] == round((5003 - n1) * 0.8)
    again = ordering.stratified_slices(df.repartition(7), "id", "label", [0.8, 0.2], 42)
    assert cut.exceptAll(again).count() == 0


def test_parts_depend_on_the_list_alone(spark):
    """The element at position p is in part p div limit, whichever tables are folded with it."""
    rows = [(1, i, f"v{i}") for i in range(45)] + [(2, i, f"w{i}") for i in range(10)] + [(3, 0, "x")]
    kids = children(spark, rows, "projectID long, seq int, v string").withColumn("seg", F.floor(F.col("seq") / 7))
    few = children(spark, [(1, i, f"u{i}") for i in range(5)], "projectID long, seq int, u string")
    want = {(k, i // 10): [v for k2, j, v in rows if k2 == k and j // 10 == i // 10] for k, i, _ in rows}
    for tables in ({"k": (kids, {"v": "vs"})}, {"f": (few, {"u": "us"}), "k": (kids, {"v": "vs"})}):
        wide, _ = fold.fold_tables(tables, limit=10)
        got = {(r["id"], r["part"]): r["vs"] for r in wide.collect()}
        assert got == want


def test_sort_by_derived_columns(spark, store):
    rows = {r["id"]: r for r in fold.derived_projects(store).collect()}
    for field in ("durationDays", "startYear", "netEcContribution", "ecRatio"):
        page = [r["id"] for r in browse.list_projects(store, limit=30, sort_field=field, sort_order="asc").collect()]
        nulls_first = sorted(rows, key=lambda i: (rows[i][field] is not None, rows[i][field] or 0, i))
        assert page == nulls_first[:30]
        last = rows[page[-1]][field]
        beyond = browse.list_projects(store, limit=5, sort_field=field, sort_order="asc", after=(last, page[-1]))
        assert [r["id"] for r in beyond.collect()] == nulls_first[30:35]


def test_running_totals_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BROADCAST_GROUPS", 1)
    df = spark.createDataFrame([(g, v, 1) for g in range(5) for v in range(20)], "g int, v int, n int")
    got = {(r["g"], r["v"]): r["cum_n"] for r in ordering.running_totals(df, "g", "v", ["n"], 5).collect()}
    assert got == {(g, v): v + 1 for g in range(5) for v in range(20)}
