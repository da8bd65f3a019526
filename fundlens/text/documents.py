"""One text document per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.functions.lists import at_or
from fundlens.model import Store
from fundlens.operators.fold import fold_tables, has_parts
from fundlens.operators.skew import ROWS_PER_KEY

# Sentence formats of a document.
HEADER = "This project under framework %s with funding scheme %s, status %s, legal basis %s."
TERM = "It ends on %s after %s days and has a max EC contribution of %s."
MEMBERS = "Participating organizations:"
MEMBER = "- %s in %s, %s, activity: %s, contributed: %s, %s."
PREDICTION = (
    "- Project %s is predicted to be %s (score=%s). The 3 most predictive features were: "
    "%s (%s), %s (%s), %s (%s)."
)


def shown(value: str | Column) -> Column:
    """Text of a value; null reads None."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value.cast("string"), F.lit("None"))


def shown_number(value: str | Column) -> Column:
    """Double without exponent: 12345678.0 and not 1.2345678E7."""
    value = F.col(value) if isinstance(value, str) else value
    text = value.cast("string")
    plain = F.regexp_replace(text.cast("decimal(38,10)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.coalesce(F.when(text.contains("E"), plain).otherwise(text), F.lit("None"))


def fixed(value: Column, digits: int) -> Column:
    """Fixed number of digits, halves to even."""
    scale = 10**digits
    return F.format_string(f"%.{digits}f", F.rint(value * scale) / scale)


def predicted_label(prefix: str = "predicted") -> Column:
    return F.when(F.col(f"{prefix}_label") == 1, "TERMINATED").otherwise("CLOSED")


def confidence(prefix: str = "predicted") -> Column:
    """Probability of the predicted class."""
    p = F.col(f"{prefix}_prob")
    return F.when(F.col(f"{prefix}_label") == 1, p).otherwise(1 - p)


def _member(name: Column, city: Column, country: Column, activity: Column, amount: Column, sme: Column) -> Column:
    flag = F.when(sme, "SME").otherwise("non-SME")
    return F.format_string(MEMBER, name, city, country, activity, amount, flag)


def member_line() -> Column:
    """Line of one organisation row."""
    return _member(
        shown("name"), shown("city"), shown("country"), shown("activityType"), shown_number("ecContribution"),
        F.col("SME").cast("boolean"),
    )


def member_lines() -> Column:
    """Lines of all organisations of a wide row, looked up by position; a list that is too short
    gives an empty text."""

    def line(name: Column, i: Column) -> Column:
        amount = F.when(i < F.size("list_ecContribution"), shown_number(F.get("list_ecContribution", i)))
        at = lambda c: at_or(F.col(c), i)
        return _member(
            shown(name), at("list_city"), at("list_country"), at("list_activityType"),
            F.coalesce(amount, F.lit("")), F.get("list_SME", i).cast("boolean"),
        )

    return F.transform("list_name", line)


def wide_documents(wide: DataFrame) -> DataFrame:
    """Documents of a stored consolidated, scored table."""
    split = has_parts(wide)
    ends = wide.filter("part > 0").groupBy("id").agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
    rows = wide.withColumns({"lines": member_lines(), "titles": F.col("list_title_report")})
    return _documents(rows.join(ends, "id", "left") if split else rows, split)


def build_documents(projects: DataFrame, store: Store, limit: int = ROWS_PER_KEY) -> DataFrame:
    """(id, part, text, startDate, endDate, status, legalBasis).

    ``projects`` carries the scored columns. A project with a list above ``limit`` elements comes as
    several consecutive parts; its header is in the first and its objective in the last one.
    """
    lines = store.organizations.select("projectID", "ord", "seg", member_line().alias("line"))
    folded, was_split = fold_tables(
        {
            "organizations": (lines, {"line": "lines"}),
            "reports": (store.reports, {"title": "titles"}),
        },
        limit,
    )
    rows = projects.join(folded, "id", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    if was_split:
        ends = folded.groupBy("id").agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
        rows = rows.join(ends, "id", "left")
    return _documents(rows, was_split)


def _documents(rows: DataFrame, was_split: bool) -> DataFrame:
    """Text of every row from its scalar columns, ``lines`` and ``titles``; with split projects
    ``_first`` and ``_last`` name their end parts."""
    first = last = F.lit(True)
    if was_split:
        first = F.coalesce(F.col("part") == F.col("_first"), F.lit(True))
        last = F.coalesce(F.col("part") == F.col("_last"), F.lit(True))
    header = F.format_string(
        HEADER, shown("frameworkProgramme"), shown("fundingScheme"), shown("status"), shown("legalBasis")
    )
    term = F.format_string(
        TERM, shown("endDate"), shown(F.datediff("endDate", "startDate")), shown_number("ecMaxContribution")
    )
    features = [
        part for i in (1, 2, 3) for part in (shown(f"top{i}_feature"), fixed(F.col(f"top{i}_shap"), 3))
    ]
    outcome = F.format_string(PREDICTION, shown("id"), predicted_label(), fixed(confidence(), 2), *features)
    open_status = F.col("status").isNull() | F.col("status").isin("signed", "SIGNED", "Signed")
    quoted = F.transform("titles", lambda t: F.coalesce(F.concat(F.lit("'"), t, F.lit("'")), F.lit("None")))
    titles = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    text = F.concat_ws(
        " ",
        F.when(first, F.concat_ws(" ", header, term, F.lit(MEMBERS))),
        F.when(F.size("lines") > 0, F.array_join("lines", " ")),
        F.when(last & open_status, outcome),
        F.when(first | F.col("titles").isNotNull(), F.coalesce(titles, F.lit("None"))),
        F.when(last, shown("objective")),
    )
    meta = [shown(c).alias(c) for c in ("startDate", "endDate", "status", "legalBasis")]
    return rows.select("id", "part", text.alias("text"), *meta)
