"""Dataset casts after cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Project text columns that lose outer quotes.
QUOTED_TEXT = [
    "acronym",
    "status",
    "title",
    "legalBasis",
    "topics",
    "frameworkProgramme",
    "masterCall",
    "subCall",
    "fundingScheme",
    "nature",
    "objective",
    "grantDoi",
]

# Folder with old publication headers, and its column names.
LEGACY_FOLDER = "H2013"
LEGACY_PUBLICATION = {
    "RECORD_ID": "id",
    "TITLE": "title",
    "AUTHOR": "authors",
    "DOI": "doi",
    "PROJECT_ID": "projectID",
    "JOURNAL_TITLE": "journalTitle",
    "PAGES": "publishedPages",
    "PUBLICATION_TYPE": "isPublishedAs",
}

# Key patterns.
PUBLICATION_KEY = r"^(\d+)_"
FILE_KEY = r"/files/\d+/(\d+)/"

DATE_FORMAT = "yyyy-MM-dd"
TIME_SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def unquoted(c: str | Column) -> Column:
    return F.btrim(c, F.lit('"'))


def decimal_point(c: str | Column) -> Column:
    """First comma to a point."""
    return F.regexp_replace(c, "^([^,]*),", "$1.")


def amount(c: str | Column) -> Column:
    """Quoted decimal text to double; bad text is an error."""
    return decimal_point(F.replace(c, F.lit('"'), F.lit(""))).cast("double")


def lenient_date(c: str | Column) -> Column:
    return F.try_to_date(c, DATE_FORMAT)


def lenient_time(c: str | Column) -> Column:
    """Time without zone, so the session zone does not matter."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(TIME_SHAPE), c.try_cast("timestamp_ntz"))


def extracted(c: str | Column, pattern: str) -> Column:
    """First group of a pattern; no match is null."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def cast_project(df: DataFrame) -> DataFrame:
    changes = {c: unquoted(c) for c in QUOTED_TEXT}
    changes |= {c: amount(c) for c in ("totalCost", "ecMaxContribution")}
    changes |= {c: lenient_date(unquoted(c)) for c in ("startDate", "endDate", "ecSignatureDate")}
    changes["contentUpdateDate"] = lenient_time(unquoted("contentUpdateDate"))
    changes["rcn"] = F.col("rcn").cast("long")
    return df.withColumns(changes)


def cast_dataset(df: DataFrame, dataset: str, folder: str) -> DataFrame:
    """Types of one dataset from one programme folder."""
    if dataset == "project":
        return cast_project(df).withColumn("programmeFolder", F.lit(folder))
    if dataset == "organization":
        return df.withColumns(
            {
                "contentUpdateDate": lenient_time("contentUpdateDate"),
                "totalCost": decimal_point("totalCost").cast("double"),
            }
        )
    if dataset in ("projectDeliverables", "reportSummaries"):
        return df.withColumn("contentUpdateDate", lenient_time("contentUpdateDate"))
    if dataset == "projectPublications":
        if folder == LEGACY_FOLDER:
            return df.withColumnsRenamed(LEGACY_PUBLICATION)
        return df.withColumns(
            {
                "contentUpdateDate": lenient_time("contentUpdateDate"),
                "projectID": extracted("id", PUBLICATION_KEY),
            }
        )
    if dataset == "webItem":
        return df.withColumn("projectID", extracted("uri", FILE_KEY).cast("long"))
    return df


def combine(frames: list[DataFrame], dataset: str) -> DataFrame:
    """Union of the programme folders.

    Publications may lack columns (filled with null). For the others the columns must agree; a column
    that is text in one folder and typed in another becomes text. Other types widen by themselves.
    """
    out = frames[0]
    for df in frames[1:]:
        if dataset == "projectPublications":
            out = out.unionByName(df, allowMissingColumns=True)
            continue
        left = dict(out.dtypes)
        differ = [c for c, t in df.dtypes if left.get(c, t) != t and "string" in (t, left[c])]
        as_text = {c: F.col(c).cast("string") for c in differ}
        if differ:
            out, df = out.withColumns(as_text), df.withColumns(as_text)
        out = out.unionByName(df)
    return out
