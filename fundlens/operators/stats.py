"""The six chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions.buckets import bucket_label, bucket_number
from fundlens.operators.filters import Filters, apply_filters
from fundlens.model import Store

TOP = 10


def projects_per_year(projects: DataFrame) -> DataFrame:
    return (
        projects.groupBy(F.year("startDate").alias("label"))
        .agg(F.count(F.lit(1)).alias("value"))
        .filter("label is not null")
        .orderBy("label")
    )


def amount_histogram(projects: DataFrame, amount: str) -> DataFrame:
    """Projects per amount bucket, in chart order (``pos``)."""
    return (
        projects.groupBy(bucket_number(F.col(amount)).alias("pos"))
        .agg(F.count(F.lit(1)).alias("value"))
        .select("pos", bucket_label(F.col("pos")).alias("label"), "value")
        .orderBy("pos")
    )


def _top(counts: DataFrame, measure: Column) -> DataFrame:
    """The first ten by measure; a null label takes a slot and is removed afterwards."""
    return counts.orderBy(measure.desc(), F.col("label").asc_nulls_last()).limit(TOP).filter("label is not null")


def top_schemes(projects: DataFrame) -> DataFrame:
    counts = projects.groupBy(F.col("fundingScheme").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    return _top(counts, F.col("value"))


def _child_labels(projects: DataFrame, children: DataFrame, column: str) -> DataFrame:
    """(id, label, n, …): child labels of the given projects, counted per project before the join.

    A project without children contributes one row with a null label, as an exploded empty list does.
    """
    counts = children.groupBy(F.col("projectID").alias("id"), F.col(column).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return projects.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(1)))


def top_topics(projects: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Contribution per vocabulary title in millions."""
    rows = _child_labels(projects.select("id", "ecMaxContribution"), vocabulary, "euroSciVocTitle")
    sums = rows.groupBy("label").agg(
        F.coalesce(F.sum(F.col("ecMaxContribution") * F.col("n")), F.lit(0.0)).alias("total")
    )
    return _top(sums, F.col("total")).select("label", F.round(F.col("total") / 1e6, 1).alias("value"))


def top_countries(projects: DataFrame, organizations: DataFrame) -> DataFrame:
    """Participations per country (one project may count several times)."""
    rows = _child_labels(projects.select("id"), organizations, "country")
    return _top(rows.groupBy("label").agg(F.sum("n").alias("value")), F.col("value"))


def chart_series(store: Store, filters: Filters = Filters()) -> DataFrame:
    """All six series as (chart, pos, label, value) rows.

    The four project-level charts share one pass: each project yields four (chart, label) pairs that
    are counted together. Topic and country share one join with the pre-counted children.
    """
    base = apply_filters(store, filters, unknown_is_null=False)
    pair = lambda chart, label: F.struct(F.lit(chart).alias("chart"), label.cast("string").alias("label"))
    flat = base.select(
        F.inline(
            F.array(
                pair("ppy", F.year("startDate")),
                pair("psd", bucket_number(F.col("totalCost"))),
                pair("frb", bucket_number(F.col("ecMaxContribution"))),
                pair("frs", F.col("fundingScheme")),
            )
        )
    )
    flat = flat.groupBy("chart", "label").agg(F.count(F.lit(1)).cast("double").alias("value"))

    def counts(children: DataFrame, chart: str, column: str) -> DataFrame:
        return children.groupBy(
            F.col("projectID").alias("id"), F.lit(chart).alias("chart"), F.col(column).alias("label")
        ).agg(F.count(F.lit(1)).alias("n"))

    children = counts(store.vocabulary, "top10", "euroSciVocTitle").unionByName(
        counts(store.organizations, "ppc", "country")
    )
    listed = (
        base.select("id", "ecMaxContribution", F.explode(F.array(F.lit("top10"), F.lit("ppc"))).alias("chart"))
        .join(children, ["id", "chart"], "left")
        .withColumn("n", F.coalesce("n", F.lit(1)))
    )
    weight = F.when(F.col("chart") == "top10", F.col("ecMaxContribution") * F.col("n")).otherwise(
        F.col("n").cast("double")
    )
    listed = listed.groupBy("chart", "label").agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("value"))

    ranked_charts = F.col("chart").isin("frs", "top10", "ppc")
    by_measure = Window.partitionBy("chart").orderBy(F.desc("value"), F.col("label").asc_nulls_last())
    every = flat.unionByName(listed)
    top = (
        every.filter(ranked_charts)
        .withColumn("pos", F.row_number().over(by_measure))
        .filter(F.col("pos") <= TOP)
    )
    fixed = every.filter(~ranked_charts).withColumn("pos", F.col("label").cast("int"))
    is_bucket = F.col("chart").isin("psd", "frb")
    return (
        top.unionByName(fixed)
        .filter("label is not null")
        .select(
            "chart",
            F.col("pos").cast("int").alias("pos"),
            F.when(is_bucket, bucket_label(F.col("pos"))).otherwise(F.col("label")).alias("label"),
            F.when(F.col("chart") == "top10", F.round(F.col("value") / 1e6, 1))
            .otherwise(F.col("value"))
            .alias("value"),
        )
        .orderBy("chart", "pos")
    )
