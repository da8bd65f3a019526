"""Registered browse and statistics queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.model import Store
from fundlens.operators import browse, stats
from fundlens.operators.filters import Filters, with_folded
from fundlens.operators.fold import consolidate, store_from_wide
from fundlens.plans import views
from fundlens.session import materialize


def _store(spark: SparkSession, sf_dir: str) -> Store:
    return views.store(spark, sf_dir)


def _scored(spark: SparkSession, sf_dir: str) -> Store:
    store = _store(spark, sf_dir)
    scored = store.projects.select("*", *views.scored_columns())
    return store.replace(projects=scored)


def flat_page(df: DataFrame) -> DataFrame:
    """List, map and struct columns as text, for comparison."""
    pair = lambda e: F.concat(e["feature"], F.lit("="), F.round(e["shap"] * 100).cast("long").cast("string"))
    count = lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))
    return df.select(
        *[c for c in df.columns if not c.startswith("list_") and c not in ("publications", "explanations", "part")],
        F.array_join("list_euroSciVocTitle", "|").alias("list_euroSciVocTitle"),
        F.array_join("list_euroSciVocPath", "|").alias("list_euroSciVocPath"),
        F.array_join(
            F.array_sort(F.transform(F.map_entries("publications"), count)), ","
        ).alias("publications"),
        F.array_join(F.transform("explanations", pair), ",").alias("explanations"),
    )


def _page(filters: Filters = Filters(), **options):
    return lambda spark, sf: flat_page(browse.list_projects(_scored(spark, sf), filters, **options))


def _keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a known row, with the row's lists."""
    import datetime

    store = _scored(spark, sf_dir)
    rest = browse.page_after(store.projects, datetime.date(1998, 6, 1), 100)
    return flat_page(browse.list_projects(store.replace(projects=rest)))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values under the list semantics of the wide table (no children counts as null)."""
    store = _store(spark, sf_dir)
    projects = with_folded(store.projects)
    names = store.organizations.select(F.col("projectID").alias("id"), "name", "country")
    listed = projects.select("id").join(names.distinct(), "id", "left")
    parts = [
        ("status", projects, "_status_lc"),
        ("legalBasis", projects, "_legalBasis_lc"),
        ("organization", listed, "name"),
        ("country", listed, "country"),
    ]
    frames = [browse.distinct_values(df, c).select(F.lit(n).alias("catalog"), "value") for n, df, c in parts]
    return reduce(DataFrame.unionByName, frames)


def _one_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flag_text(browse.project_organizations(_store(spark, sf_dir), "77").orderBy("ord"))


def _organizations_of_terminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return _flag_text(browse.organizations_of(store, store.projects.filter("status = 'TERMINATED'")))


def _stats_from_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart series from the stored wide table alone."""
    needed = {"organizations": {"country": "list_country"}, "vocabulary": {"euroSciVocTitle": "list_euroSciVocTitle"}}
    wide = materialize(consolidate(_store(spark, sf_dir), lists=needed))
    return stats.chart_series(store_from_wide(wide))


def _flag_text(rows: DataFrame) -> DataFrame:
    return rows.drop("ord").withColumn("sme", F.col("sme").cast("string"))


def browse_queries() -> dict:
    return {
        "stats_projects_per_year": lambda s, d: stats.projects_per_year(_store(s, d).projects),
        "stats_project_size": lambda s, d: stats.amount_histogram(_store(s, d).projects, "totalCost"),
        "stats_funding_range": lambda s, d: stats.amount_histogram(
            _store(s, d).projects, "ecMaxContribution"
        ),
        "stats_top_schemes": lambda s, d: stats.top_schemes(_store(s, d).projects),
        "stats_top_topics": lambda s, d: stats.top_topics(views.projects(s, d), views.vocabulary(s, d)),
        "stats_top_countries": lambda s, d: stats.top_countries(
            views.projects(s, d), views.organizations(s, d)
        ),
        "stats_all_series": lambda s, d: stats.chart_series(_store(s, d)),
        "stats_from_wide": _stats_from_wide,
        "stats_filtered": lambda s, d: stats.chart_series(
            _store(s, d),
            Filters(
                status="closed",
                legal_basis="Building",
                funding_scheme="HIGH|LOW",
                country="NATION_3",
                min_funding="100000",
                max_funding="9000000",
                min_year="1996",
                max_year="2000",
                min_end_year="1997",
                max_end_year="2001",
            ),
        ),
        "stats_status_unknown": lambda s, d: stats.chart_series(_store(s, d), Filters(status="UNKNOWN")),
        "browse_page": _page(page=2),
        "browse_page_asc_nulls": _page(limit=25, sort_field="endDate", sort_order="asc"),
        "browse_page_desc_nulls": _page(page=16, limit=25, sort_field="totalCost"),
        "browse_page_by_duration": _page(page=1, limit=20, sort_field="durationDays"),
        "browse_page_by_contribution": _page(limit=20, sort_field="netEcContribution", sort_order="asc"),
        "browse_deep_page": _page(limit=15, sort_field="durationDays", after=(40, 900)),
        "browse_search_regex": _page(Filters(search="^(AUTO|build).*nation_1[0-9]$")),
        "browse_status_unknown": _page(Filters(status="UNKNOWN"), limit=20, sort_field="id"),
        "browse_by_org": _page(
            Filters(organization="Supplier#000000007"), limit=15, sort_field="ecMaxContribution"
        ),
        "browse_by_topic": _page(
            Filters(topic="ECONOMY", country="NATION_3", funding_scheme="urg"),
            limit=15,
            sort_field="title",
            sort_order="asc",
        ),
        "browse_by_id": _page(Filters(project_id="77")),
        "browse_keyset": _keyset,
        "facet_values": lambda s, d: browse.facets(_store(s, d)),
        "facet_filtered": lambda s, d: browse.facets(
            _store(s, d), Filters(status="Signed", search="NATION_2", country="NATION_3")
        ),
        "catalog_distinct": _catalog,
        "project_organizations": _one_project,
        "organizations_of_terminated": _organizations_of_terminated,
        "organization_locations": lambda s, d: _flag_text(
            browse.organization_locations(_store(s, d).organizations)
        ),
    }
