"""One predicate builder for browse, facets and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.model import Store

FOLDED = ["title", "status", "legalBasis", "fundingScheme"]


@dataclass(frozen=True)
class Filters:
    """Empty values mean "no filter"."""

    search: str = ""
    status: str = ""
    legal_basis: str = ""
    organization: str = ""
    country: str = ""
    topic: str = ""
    funding_scheme: str = ""
    project_id: str = ""
    min_funding: str = ""
    max_funding: str = ""
    min_year: str = ""
    max_year: str = ""
    min_end_year: str = ""
    max_end_year: str = ""
    literal: bool = False  # True: search text is a plain substring, not a pattern


def from_params(params: dict[str, str]) -> Filters:
    """Filters from request parameters; ``topics`` is accepted as another name for ``topic``."""
    names = {
        "search": "search",
        "status": "status",
        "legalBasis": "legal_basis",
        "organization": "organization",
        "country": "country",
        "topic": "topic",
        "topics": "topic",
        "fundingScheme": "funding_scheme",
        "proj_id": "project_id",
        "minFunding": "min_funding",
        "maxFunding": "max_funding",
        "minYear": "min_year",
        "maxYear": "max_year",
        "minEndYear": "min_end_year",
        "maxEndYear": "max_end_year",
    }
    return Filters(**{names[k]: str(v) for k, v in params.items() if k in names and v})


def with_folded(projects: DataFrame) -> DataFrame:
    """Lower-case shadow columns; stored with the table they let equality filters reach the scan."""
    return projects.select("*", *[F.lower(c).alias(f"_{c}_lc") for c in FOLDED])


def _folded(df: DataFrame, name: str) -> Column:
    return F.col(f"_{name}_lc") if f"_{name}_lc" in df.columns else F.lower(name)


def _year_start(year: int) -> Column:
    return F.lit(f"{year:04d}-01-01").cast("date")


def project_predicate(df: DataFrame, f: Filters, unknown_is_null: bool = True) -> Column:
    """The scalar part of the filters. Year bounds become date ranges, so the scan can use them."""
    tests = [F.lit(True)]
    if f.search:
        text = f.search.lower()
        title = _folded(df, "title")
        tests.append(title.contains(text) if f.literal else title.rlike(text))
    if f.status:
        if unknown_is_null and f.status == "UNKNOWN":
            tests.append(F.col("status").isNull())
        else:
            tests.append(_folded(df, "status") == f.status.lower())
    if f.legal_basis:
        tests.append(_folded(df, "legalBasis") == f.legal_basis.lower())
    if f.funding_scheme:
        tests.append(_folded(df, "fundingScheme").rlike(f.funding_scheme.lower()))
    if f.project_id:
        tests.append(F.col("id") == int(f.project_id))
    if f.min_funding:
        tests.append(F.col("ecMaxContribution") >= int(f.min_funding))
    if f.max_funding:
        tests.append(F.col("ecMaxContribution") <= int(f.max_funding))
    for column, low, high in (
        ("startDate", f.min_year, f.max_year),
        ("endDate", f.min_end_year, f.max_end_year),
    ):
        if low:
            tests.append(F.col(column) >= _year_start(int(low)))
        if high:
            tests.append(F.col(column) < _year_start(int(high) + 1))
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def having_child(projects: DataFrame, children: DataFrame, column: str, value: str) -> DataFrame:
    """Projects with a child whose ``column`` equals ``value`` (case-sensitive)."""
    ids = children.filter(F.col(column) == value).select(F.col("projectID").alias("id"))
    return projects.join(ids, "id", "left_semi")


def apply_filters(store: Store, f: Filters, unknown_is_null: bool = True) -> DataFrame:
    """Filtered projects; list membership is a semi-join on the long child table."""
    out = store.projects.filter(project_predicate(store.projects, f, unknown_is_null))
    if f.organization:
        out = having_child(out, store.organizations, "name", f.organization)
    if f.country:
        out = having_child(out, store.organizations, "country", f.country)
    if f.topic:
        out = having_child(out, store.vocabulary, "euroSciVocTitle", f.topic)
    return out
