"""Project list, facets, organisations of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions.lists import explanations, latitude_longitude
from fundlens.model import Store
from fundlens.operators.filters import Filters, apply_filters
from fundlens.operators.fold import fold_tables, net_contributions, publication_counts, with_dates, with_derived
from fundlens.session import materialize

PAGE_ROWS = 10
BROADCAST_PAGE = 10_000


def _order(df: DataFrame, sort_field: str, sort_order: str) -> list[Column]:
    """Nulls come first in both directions; id breaks ties."""
    field = F.col(sort_field if sort_field in df.columns else "startDate")
    first = field.desc_nulls_first() if sort_order.lower() == "desc" else field.asc_nulls_first()
    return [first, F.col("id").asc()]


def page_rows(
    df: DataFrame,
    page: int = 0,
    limit: int = PAGE_ROWS,
    sort_field: str = "startDate",
    sort_order: str = "desc",
) -> DataFrame:
    """One page of a sorted table (a top-k plan: no full sort)."""
    return df.orderBy(*_order(df, sort_field, sort_order)).offset(page * limit).limit(limit)


def page_after(
    df: DataFrame, last_value, last_id: int, limit: int = PAGE_ROWS, sort_field: str = "startDate",
    sort_order: str = "desc",
) -> DataFrame:
    """The page after a known row; its cost does not grow with the page number."""
    field = F.col(sort_field if sort_field in df.columns else "startDate")
    same = field.eqNullSafe(F.lit(last_value)) & (F.col("id") > last_id)
    if last_value is None:
        beyond = field.isNotNull()
    elif sort_order.lower() == "desc":
        beyond = field < F.lit(last_value)
    else:
        beyond = field > F.lit(last_value)
    rest = df.filter(same | F.coalesce(beyond, F.lit(False)))
    return rest.orderBy(*_order(df, sort_field, sort_order)).limit(limit)


def _with_sort_field(store: Store, rows: DataFrame, sort_field: str) -> DataFrame:
    """Adds the derived columns of the wide table when the sort needs one of them."""
    if sort_field in rows.columns:
        return rows
    if sort_field in ("startYear", "endYear", "durationDays"):
        return with_dates(rows)
    if sort_field in ("netEcContribution", "ecRatio"):
        return with_derived(rows.join(net_contributions(store.organizations), "id", "left"))
    return rows


# Columns of a project list row before folding.
LIST_ROW = [
    "id",
    "title",
    "status",
    "startDate",
    "endDate",
    "ecMaxContribution",
    "acronym",
    "legalBasis",
    "objective",
    "frameworkProgramme",
    "totalCost",
    "fundingScheme",
    "predicted_label",
    "predicted_prob",
]


def list_projects(
    store: Store,
    filters: Filters = Filters(),
    page: int = 0,
    limit: int = PAGE_ROWS,
    sort_field: str = "startDate",
    sort_order: str = "desc",
    after: tuple | None = None,
) -> DataFrame:
    """Page of projects with list columns, publication counts and, if the table is scored,
    prediction and explanations. ``after`` (last sort value, last id) gives the page behind a known
    row at a cost that does not grow with the page number; ``page`` is then left out.

    Sorting and paging see scalar columns only. The page is stored, and so are its child rows, so
    each large table is read once; lists are folded for the ids of the page alone.
    """
    rows = _with_sort_field(store, apply_filters(store, filters), sort_field)
    if after is None:
        chosen = materialize(page_rows(rows, page, limit, sort_field, sort_order))
    else:
        chosen = materialize(page_after(rows, *after, limit, sort_field, sort_order))
    ids = chosen.select(F.col("id").alias("projectID"))
    ids = F.broadcast(ids) if limit <= BROADCAST_PAGE else ids
    vocabulary = store.vocabulary.select("projectID", "ord", "seg", "euroSciVocTitle", "euroSciVocPath")
    vocabulary = materialize(vocabulary.join(ids, "projectID", "left_semi"))
    publications = store.publications.select("projectID", "ord", "seg", "isPublishedAs")
    publications = materialize(publications.join(ids, "projectID", "left_semi"))
    lists, _ = fold_tables(
        {
            "vocabulary": (
                vocabulary,
                {"euroSciVocTitle": "list_euroSciVocTitle", "euroSciVocPath": "list_euroSciVocPath"},
            ),
            "publications": (publications, {"isPublishedAs": "list_isPublishedAs"}),
        }
    )
    out = chosen.join(lists, "id", "left").join(publication_counts(publications), "id", "left")
    scored = "top1_feature" in out.columns
    return out.select(
        *[c for c in LIST_ROW if c in out.columns and c not in ("startDate", "endDate")],
        F.date_format("startDate", "yyyy-MM-dd").alias("startDate"),
        F.date_format("endDate", "yyyy-MM-dd").alias("endDate"),
        F.coalesce("part", F.lit(0).cast("long")).alias("part"),
        "list_euroSciVocTitle",
        "list_euroSciVocPath",
        "list_isPublishedAs",
        F.coalesce("publications", F.create_map().cast("map<string,bigint>")).alias("publications"),
        *([explanations().alias("explanations")] if scored else []),
    ).orderBy(*_order(out, sort_field, sort_order), "part")


def facets(store: Store, filters: Filters = Filters(), cap: int | None = None) -> DataFrame:
    """(facet, value): sorted distinct values under the filters; null is shown as UNKNOWN.

    ``cap`` keeps the first values of every facet (a display limit of a client).
    """
    base = apply_filters(store, filters)
    pair = lambda name, c: F.struct(F.lit(name).alias("facet"), F.col(c).alias("value"))
    flat = base.select(
        F.inline(
            F.array(
                pair("statuses", "status"),
                pair("legalBases", "legalBasis"),
                pair("fundingSchemes", "fundingScheme"),
            )
        )
    )

    def pairs(children: DataFrame, facet: str, column: str) -> DataFrame:
        return children.select(
            F.col("projectID").alias("id"), F.lit(facet).alias("facet"), F.col(column).alias("value")
        ).distinct()

    children = (
        pairs(store.organizations, "organizations", "name")
        .unionByName(pairs(store.organizations, "countries", "country"))
        .unionByName(pairs(store.vocabulary, "topics", "euroSciVocTitle"))
    )
    names = F.array(*[F.lit(x) for x in ("organizations", "countries", "topics")])
    listed = (
        base.select("id", F.explode(names).alias("facet"))
        .join(children, ["id", "facet"], "left")
        .select("facet", "value")
    )
    values = (
        flat.unionByName(listed)
        .select("facet", F.coalesce("value", F.lit("UNKNOWN")).alias("value"))
        .distinct()
    )
    if cap is not None:
        in_facet = Window.partitionBy("facet").orderBy("value")
        values = (
            values.withColumn("_rn", F.row_number().over(in_facet)).filter(F.col("_rn") <= cap).drop("_rn")
        )
    return values.orderBy("facet", "value")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column; list columns are exploded, an empty list counts as null."""
    is_list = df.schema[column].dataType.typeName() == "array"
    value = F.explode_outer(column) if is_list else F.col(column)
    return df.select(value.alias("value")).distinct()


def project_organizations(store: Store, project_id: str) -> DataFrame:
    """Organisations of one project with coordinates; an unknown id gives an empty frame."""
    known = store.projects.filter(F.col("id") == int(project_id)).select(F.col("id").alias("projectID"))
    rows = store.organizations.filter(F.col("projectID") == int(project_id))
    return organization_rows(rows.join(known, "projectID", "left_semi"))


def organizations_of(store: Store, ids: DataFrame) -> DataFrame:
    """Organisations of a set of projects (column ``id``)."""
    wanted = ids.select(F.col("id").alias("projectID"))
    return organization_rows(store.organizations.join(wanted, "projectID", "left_semi"))


def organization_rows(organizations: DataFrame) -> DataFrame:
    """Named organisations in child order, with latitude and longitude."""
    latitude, longitude = latitude_longitude(F.col("geolocation"))
    return organizations.filter("name is not null").select(
        "projectID",
        "ord",
        "name",
        "city",
        F.col("SME").alias("sme"),
        "role",
        F.col("ecContribution").alias("contribution"),
        "activityType",
        F.col("organizationURL").alias("orgURL"),
        "country",
        latitude.alias("latitude"),
        longitude.alias("longitude"),
    )


def organization_locations(organizations: DataFrame) -> DataFrame:
    """Organisations that can be put on a map."""
    rows = organization_rows(organizations)
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return rows.filter(good("latitude") & good("longitude"))
