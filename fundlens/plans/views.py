"""The funding data model as views over the star-schema tables.

Every order is a project and every line item stands for one row of each child table. The views are
lazy, so a query reads only the columns it uses.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.model import Store

CHILD_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


# Schemas of the given tables. Reading with a schema needs no inference job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per project with the scalar columns of the data model."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    # Decimal terms: the sum does not depend on the order of the rows.
    amount = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.max("l_shipdate").cast("date").alias("endDate"),
            (F.sum(amount).cast("double") * 10).alias("ecMaxContribution"),
        )
    )
    key = F.col("o_orderkey")
    status = (
        F.when(key % 50 == 0, None)
        .when(F.col("o_orderstatus") == "F", "CLOSED")
        .when(F.col("o_orderstatus") == "P", "TERMINATED")
        .otherwise("SIGNED")
    )
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("id"),
            F.concat(F.lit("A"), key.cast("string")).alias("acronym"),
            status.alias("status"),
            F.concat_ws(
                " ", "c_mktsegment", F.expr("substr(o_orderpriority, 3)"), "n_name"
            ).alias("title"),
            F.col("o_orderdate").cast("date").alias("startDate"),
            F.when(key % 37 != 0, F.col("o_totalprice") * 50).alias("totalCost"),
            F.col("c_mktsegment").alias("legalBasis"),
            F.concat(F.lit("FP"), (F.col("o_custkey") % 9 + 1).cast("string")).alias(
                "frameworkProgramme"
            ),
            F.col("o_orderpriority").alias("fundingScheme"),
            F.when(key % 41 != 0, F.concat(F.lit("N"), F.col("n_regionkey").cast("string"))).alias(
                "nature"
            ),
            F.concat_ws(" ", "c_name", "n_name", "o_orderpriority").alias("objective"),
        )
    )
    return base.join(lines, "id", "left")


def scored_columns() -> list[Column]:
    """Stand-in scoring columns, so that browsing does not need a trained model."""
    key = F.col("id")
    names = F.array(*[F.lit(f"num__n_f{i}") for i in range(8)])
    cols = [
        ((key * 37 % 1000) / 1000.0 >= 0.5).cast("int").alias("predicted_label"),
        ((key * 37 % 1000) / 1000.0).alias("predicted_prob"),
    ]
    for i in range(1, 7):
        known = key % (10 + i) != 0
        name = F.get(names, ((key + i) % 8).cast("int"))
        cols.append(F.when(known, name).alias(f"top{i}_feature"))
        cols.append(((key * (i + 3) % 200 - 100) / 100.0).alias(f"top{i}_shap"))
    return cols


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the child ordinal.

    ``seg`` grows with the ordinal and groups 4,096 part numbers, so a hot order splits into parts of
    moderate size.
    """
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("projectID"),
        F.struct(*CHILD_ORDER).alias("ord"),
        (F.col("l_linenumber") * F.lit(10**12) + F.floor(F.col("l_partkey") / 4096)).alias("seg"),
        "*",
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation_key = F.col("s_nationkey").cast("string")
    return (
        _lines(spark, sf_dir)
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "projectID",
            "ord",
            "seg",
            F.col("s_suppkey").cast("string").alias("organisationID"),
            F.when(F.col("s_suppkey") % 50 != 0, F.col("s_name")).alias("name"),
            F.col("n_name").alias("country"),
            F.concat(F.lit("C"), nation_key).alias("city"),
            F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal") < 0).alias("SME"),
            F.when(F.col("s_nationkey") % 7 == 0, None)
            .when(F.col("s_nationkey") % 5 == 0, "unknown")
            .otherwise(
                F.concat(
                    nation_key, F.lit(".5,-"), (F.col("s_nationkey") * 2).cast("string")
                )
            )
            .alias("geolocation"),
            F.concat(F.lit("http://org"), F.col("s_suppkey").cast("string")).alias(
                "organizationURL"
            ),
            F.col("l_linestatus").alias("role"),
            F.col("l_extendedprice").alias("ecContribution"),
            F.when(F.col("l_suppkey") % 6 != 0, F.col("l_quantity").cast("string")).alias(
                "netEcContribution"
            ),
            F.col("l_returnflag").alias("activityType"),
        )
    )


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _lines(spark, sf_dir)
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "projectID",
            "ord",
            "seg",
            F.col("p_type").alias("euroSciVocTitle"),
            F.concat_ws("/", F.lit(""), "p_type", "p_brand", "p_name").alias("euroSciVocPath"),
            F.col("p_name").alias("euroSciVocDescription"),
        )
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _lines(spark, sf_dir)
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "projectID", "ord", "seg", F.col("p_brand").alias("topic"), F.col("p_name").alias("title")
        )
    )


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _lines(spark, sf_dir)
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "projectID",
            "ord",
            "seg",
            F.col("p_name").alias("title"),
            F.when(F.col("l_partkey") % 11 != 0, F.col("p_type")).alias("isPublishedAs"),
            F.year("l_shipdate").alias("publishedYear"),
        )
    )


def deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        "projectID",
        "ord",
        "seg",
        F.col("l_returnflag").alias("deliverableType"),
        F.concat(F.lit("http://d/"), F.col("l_partkey").cast("string")).alias("url"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _lines(spark, sf_dir).select(
            "projectID",
            "ord",
            "seg",
            F.concat(F.lit("Report "), F.col("l_suppkey").cast("string")).alias("title"),
            F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("attachment"),
        )
    )


def web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        "projectID",
        "ord",
        "seg",
        F.concat(F.lit("http://w/"), F.col("l_suppkey").cast("string")).alias("physUrl"),
        F.when(F.col("l_linenumber") % 3 == 0, "en,fr")
        .when(F.col("l_linenumber") % 3 == 1, "de")
        .alias("availableLanguages"),
        F.col("l_linestatus").alias("status"),
    )


def legal_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        "projectID",
        "ord",
        "seg",
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("legalBasis"),
        F.concat(F.lit("Part "), F.col("l_returnflag")).alias("title"),
    )


def store(spark: SparkSession, sf_dir: str) -> Store:
    builders = {
        "projects": projects,
        "organizations": organizations,
        "vocabulary": vocabulary,
        "publications": publications,
        "topics": topics,
        "deliverables": deliverables,
        "reports": reports,
        "web_links": web_links,
        "legal_bases": legal_bases,
    }
    return Store(**{name: partial(build, spark, sf_dir) for name, build in builders.items()})
