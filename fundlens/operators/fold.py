"""Fold child tables into list columns, consolidate, and unfold again."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions.lists import float_ratio, list_sum
from fundlens.model import EXCLUDED_FRAMEWORKS, LIST_COLUMNS, Store
from fundlens.operators.skew import ROWS_PER_KEY, counted_keys, dense_position

ROWS_PER_TASK = 500_000  # child rows that one task folds
SPREAD_ROWS = 4_000_000  # child rows from which on the tasks are counted by rows


def fold_tables(
    children: dict[str, tuple[DataFrame, dict[str, str]]], limit: int = ROWS_PER_KEY
) -> tuple[DataFrame, bool]:
    """Fold several child tables into aligned list columns with one shuffle.

    ``children`` maps a name to (frame with projectID, ord, seg, …; {column: list name}). All rows
    travel in one union, each in its own struct column, so a single aggregation builds every list.
    Lists keep nulls and the order of ``ord``. The element at position p of a list lies in the row
    with ``part`` = p div ``limit``, for every project and child table, whichever tables are folded.
    Positions are worked out only for lists that are longer than ``limit``; all others have part 0.
    Returns the frame (id, part, lists…) and whether any list has more than one part.
    """
    tagged = []
    for name, (df, columns) in children.items():
        fields = [c for c in columns if c in df.columns]
        tagged.append(
            df.filter("projectID is not null").select(
                F.struct(F.col("projectID").alias("id"), F.lit(name).alias("child")).alias("_key"),
                F.col("seg").cast("long").alias("seg"),
                F.struct("ord", *fields).alias(f"_{name}"),
            )
        )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    hot, n_rows = counted_keys(rows.select("_key"), "_key", limit)
    if hot is None:
        keys = [F.col("_key.id").alias("id")]
    else:
        order = [f"_{name}.ord" for name in children]
        longer = dense_position(rows.join(hot, "_key", "left_semi"), "_key", "seg", order, "_pos")
        longer = longer.withColumn("part", F.floor(F.col("_pos") / limit)).drop("_pos")
        rows = rows.join(hot, "_key", "left_anti").withColumn("part", F.lit(0).cast("long"))
        rows = rows.unionByName(longer)
        keys = [F.col("_key.id").alias("id"), F.col("part")]
    lists = [F.sort_array(F.collect_list(f"_{name}")).alias(f"_{name}") for name in children]
    rows = rows.select(*keys, *[f"_{name}" for name in children])
    grouped = rows.columns[: len(keys)]
    if n_rows > SPREAD_ROWS:  # plain rows travel, to tasks that can hold theirs: lists of a part of the rows would be sorted first
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(max(parts, -(-n_rows // ROWS_PER_TASK)), *grouped)
    folded = rows.groupBy(*grouped).agg(*lists)
    if hot is None:
        folded = folded.withColumn("part", F.lit(0).cast("long"))
    out = [F.col("id"), F.col("part")]
    for name, (df, columns) in children.items():
        for column, alias in columns.items():
            if column in df.columns:
                out.append(F.when(F.size(f"_{name}") > 0, list_values(f"_{name}", column)).alias(alias))
    return folded.select(*out), hot is not None


def list_values(structs: str, field: str):
    return F.transform(structs, lambda s: s[field])


def fold_children(df: DataFrame, columns: dict[str, str], limit: int = ROWS_PER_KEY) -> DataFrame:
    """Fold one child table."""
    return fold_tables({"child": (df, columns)}, limit)[0]


def consolidate(
    store: Store, limit: int = ROWS_PER_KEY, lists: dict[str, dict[str, str]] = LIST_COLUMNS
) -> DataFrame:
    """One wide row per project with its list columns and derived columns.

    A list above ``limit`` elements continues in further rows (``part`` > 0, by position) that repeat
    the project's scalar columns; every list element appears in exactly one part.
    """
    children = {name: (getattr(store, name), cols) for name, cols in lists.items()}
    folded, was_split = fold_tables(children, limit)
    wide = store.projects.join(folded, "id", "left").withColumn(
        "part", F.coalesce("part", F.lit(0).cast("long"))
    )
    if "list_netEcContribution" not in wide.columns:
        return with_dates(wide)
    if was_split:
        wide = wide.join(net_contributions(store.organizations), "id", "left")
    else:
        wide = wide.withColumn("netEcContribution", list_sum(F.col("list_netEcContribution")))
    return with_derived(wide)


def net_contributions(organizations: DataFrame) -> DataFrame:
    """(id, netEcContribution) without building lists: 0 if no amount is known."""
    total = F.sum(F.col("netEcContribution").cast("double"))
    return organizations.groupBy(F.col("projectID").alias("id")).agg(
        F.coalesce(total, F.lit(0.0)).alias("netEcContribution")
    )


def derived_projects(store: Store) -> DataFrame:
    """The scalar part of the consolidated table: one row per project, no lists."""
    return with_derived(store.projects.join(net_contributions(store.organizations), "id", "left"))


def with_dates(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.year("startDate").alias("startYear"),
        F.year("endDate").alias("endYear"),
        F.datediff("endDate", "startDate").alias("durationDays"),
    )


def with_derived(df: DataFrame) -> DataFrame:
    return with_dates(df).select(
        "*",
        float_ratio(F.col("netEcContribution"), F.col("totalCost").cast("double")).alias("ecRatio"),
    )


def clean(consolidated: DataFrame) -> DataFrame:
    """Without the early framework programmes; rows without a programme are dropped as well."""
    return consolidated.filter(~F.col("frameworkProgramme").isin(EXCLUDED_FRAMEWORKS))


def unfold(wide: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Aligned list columns back to one row per element; ``pos`` is the position in the project.

    Lists of different length are filled with nulls; a project without lists gives no row.
    """
    present = {c: a for c, a in columns.items() if a in wide.columns}
    filled = [
        F.coalesce(F.col(a), F.array().cast(wide.schema[a].dataType)).alias(c)
        for c, a in present.items()
    ]
    zipped = wide.select("id", "part", F.arrays_zip(*filled).alias("_rows"))
    rows = zipped.select("id", "part", F.posexplode("_rows").alias("pos", "_row"))
    if has_parts(wide):
        before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = zipped.select("id", "part", F.size("_rows").alias("_n"))
        starts = sizes.select("id", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        starts = starts.filter("_start > 0")
        rows = rows.join(starts, ["id", "part"], "left").withColumn(
            "pos", (F.col("pos") + F.coalesce("_start", F.lit(0))).cast("int")
        )
    return rows.select("id", "part", "pos", *[F.col("_row")[c].alias(c) for c in present])


def store_from_wide(wide: DataFrame) -> Store:
    """Long child tables and scalar projects of a stored consolidated table."""
    listed = {alias for columns in LIST_COLUMNS.values() for alias in columns.values()}
    scalars = wide.drop("part", *listed)
    projects = scalars.dropDuplicates(["id"]) if has_parts(wide) else scalars

    def child(columns: dict[str, str]) -> DataFrame:
        rows = unfold(wide, columns)
        return rows.select(
            F.col("id").alias("projectID"),
            F.struct("part", "pos").alias("ord"),
            F.col("part").alias("seg"),
            *[c for c in columns if c in rows.columns],
        )

    present = {
        name: partial(child, columns)
        for name, columns in LIST_COLUMNS.items()
        if any(alias in wide.columns for alias in columns.values())
    }
    return Store(projects=projects, **present)


def has_parts(wide: DataFrame) -> bool:
    """Whether any project continues in further rows."""
    return "part" in wide.columns and wide.filter("part > 0").limit(1).count() > 0


def publication_counts(publications: DataFrame) -> DataFrame:
    """(id, publications): map of publication type to count; a missing type counts as "null"."""
    counts = publications.groupBy(
        F.col("projectID").alias("id"), F.coalesce("isPublishedAs", F.lit("null")).alias("type")
    ).agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("type", "n")))
    return counts.groupBy("id").agg(F.map_from_entries(entries).alias("publications"))
