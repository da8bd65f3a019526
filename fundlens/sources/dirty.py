"""Programme folders of semicolon files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions.casts import cast_dataset, combine
from fundlens.functions.cells import clean_cells, parse_lines, split_cells
from fundlens.model import DATASETS
from fundlens.session import file_system

BLOCK_SPAN = 1 << 44  # larger than any byte offset in a file


def discover(spark: SparkSession, root: str, dataset: str) -> list[tuple[str, str]]:
    """(folder, path) of every programme folder that has the dataset, in folder order.

    Only the file listing is read (one file per folder), never file content.
    """
    fs, path = file_system(spark, root)
    parent = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    folders = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"{dataset}.csv")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))
        .filter(F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+$", 1)== parent)
    )
    return sorted((r["folder"], r["path"]) for r in folders.collect())


def read_header(spark: SparkSession, path: str, dataset: str) -> list[str]:
    """Column names from the first line, cleaned like any other line."""
    first = spark.read.text(path).filter("_metadata.file_block_start = 0").limit(1)
    cells = clean_cells(split_cells(F.col("value")), dataset)
    return first.select(cells.alias("h")).head()["h"]


def read_lines(spark: SparkSession, path: str, folder_number: int = 0) -> DataFrame:
    """Body lines with their position in the file.

    ``ord`` grows with the line position; ``seg`` numbers the file block, so one block's worth of
    lines is the most that shares a ``seg``. The reader drops the header line of the file; no
    separator or quote is active, so a line stays one value.
    """
    lines = (
        spark.read.schema("value string")
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("sep", "\u0001")
        .option("quote", "")
        .option("escape", "\u0002")
        .option("emptyValue", "")
        .csv(path)
    )
    block = F.col("_metadata.file_block_start")
    return lines.select(
        F.coalesce("value", F.lit("")).alias("value"),
        F.struct(
            F.lit(folder_number).alias("folder"),
            block.alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("ord"),
        (F.lit(folder_number) * F.lit(BLOCK_SPAN) + block).alias("seg"),
    )


def read_dataset(spark: SparkSession, root: str, dataset: str) -> DataFrame | None:
    """One dataset over all programme folders: repaired, cleaned, cast, united."""
    frames = []
    for number, (folder, path) in enumerate(discover(spark, root, dataset)):
        header = read_header(spark, path, dataset)
        rows = parse_lines(read_lines(spark, path, number), dataset, header, keep=["ord", "seg"])
        frames.append(cast_dataset(rows, dataset, folder))
    return combine(frames, dataset) if frames else None


def read_all(spark: SparkSession, root: str, names: list[str] = DATASETS) -> dict[str, DataFrame]:
    """Every dataset of ``names`` that occurs under the root."""
    found = {name: read_dataset(spark, root, name) for name in names}
    return {name: df for name, df in found.items() if df is not None}
