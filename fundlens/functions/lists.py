"""Column helpers for list, map and coordinate values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_sum(items: Column) -> Column:
    """Sum of a list cast to double: nulls skipped, empty list 0, null list null."""
    as_double = F.transform(items, lambda x: x.cast("double"))
    return F.aggregate(as_double, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def float_ratio(top: Column, bottom: Column) -> Column:
    """Float division with the usual zero rules (infinity or NaN instead of an error)."""
    by_zero = F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf")))
    return F.when(bottom != 0, top / bottom).when(
        top.isNotNull() & bottom.isNotNull(), by_zero.otherwise(F.lit(float("nan")))
    )


def latitude_longitude(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, ",")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return number(0), number(1)


def explanations(count: int = 6) -> Column:
    """topN_feature / topN_shap columns to a list of structs; pairs with a null are left out."""
    pairs = [
        F.struct(F.col(f"top{i}_feature").alias("feature"), F.col(f"top{i}_shap").alias("shap"))
        for i in range(1, count + 1)
    ]
    return F.filter(F.array(*pairs), lambda p: p["feature"].isNotNull() & p["shap"].isNotNull())


def normalized(items: Column) -> Column:
    """Null list to empty, null items dropped, items in upper case."""
    filled = F.coalesce(items, F.array().cast("array<string>"))
    return F.transform(F.array_compact(filled), F.upper)


def split_items(items: Column, separator: str = ",") -> Column:
    """Split every item and flatten."""
    return F.flatten(F.transform(items, lambda x: F.split(x, separator)))


def inner_levels(paths: Column) -> Column:
    """Distinct path levels above the leaf, over all slash paths of a list."""
    filled = F.array_compact(F.coalesce(paths, F.array().cast("array<string>")))

    def levels(path: Column) -> Column:
        parts = F.split(F.btrim(path, F.lit("/")), "/")
        return F.slice(parts, F.lit(1), F.size(parts) - 1)

    return F.array_distinct(F.flatten(F.transform(filled, levels)))


def at_or(items: Column, i: Column, default: str = "") -> Column:
    """Item at a position, or the default where the list is null or too short."""
    return F.when(i < F.size(items), F.coalesce(F.get(items, i).cast("string"), F.lit("None"))).otherwise(default)
