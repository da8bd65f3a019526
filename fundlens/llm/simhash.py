"""SimHash near duplicates: pigeonhole blocks, bit distance, components.

The 64-bit fingerprint takes the majority of the bits of XXH64 (seed 42) over all word shingles of the
whole text. Distinct fingerprints are cut into ``max_bits + 2`` blocks: two that differ in at most
``max_bits`` bits share two whole blocks, so they meet in a join on some pair of blocks (32 shared bits
for two differing ones) and their distance is verified. A pair of blocks that more than ``CROWD``
fingerprints share is not joined with itself: each of its fingerprints is keyed by the 65 values within
one bit instead. Two fingerprints within two bits share such a value, at most 65 can share one, and each
group is linked to its smallest member, so rows stay linear and no link is lost.

Defined results: a null or empty text has fingerprint zero and links like any other; a text with fewer
words than a shingle has one shingle; repeated rows and equal fingerprints are one node; rows without an
id take the smallest id of their component, or null if it has none.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.shared import fresh, with_columns
from fundlens.session import materialize

SEED = 42
CROWD = 64  # fingerprints of one pair of blocks that are compared pair by pair
PART = 1 << 15  # shingles whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs = [words]
    else:
        runs = zip(*(words[k:] for k in range(shingle)), strict=False)
    digest, seed, join = xxhash.xxh64_intdigest, SEED, b" ".join
    hashes = np.array([digest(join(run), seed) for run in runs], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), PART):
        octets = hashes[start : start + PART].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def _maker(shingle: int):
    return lambda texts: [pa.array([fingerprint(t, shingle) for t in texts], pa.int64())]


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each text as a long."""
    return with_columns(docs, text, partial(_maker, shingle), f"`{name}` long")


def _near(a, b, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp`` that connect all within ``max_bits`` bits.

    Pairs of crowded blocks are linked through their group's smallest member, so every component is
    whole although not each of its pairs is listed. ``max_bits`` is 0 to 2.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    n_blocks = max_bits + 2
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    block = [
        F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for low, high in zip(edges, edges[1:], strict=False)
    ]
    pairs = [
        F.struct(F.lit(k).alias("which"), F.shiftleft(block[i], 32).bitwiseXOR(block[j]).alias("key"))
        for k, (i, j) in enumerate(combinations(range(n_blocks), 2))
    ]
    keyed = nodes.select("fp", F.inline(F.array(*pairs)))
    shared = keyed.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialize(keyed.join(shared, ["which", "key"]))
    few = met.filter(F.col("n") <= CROWD)
    joined = (
        few.select("which", "key", F.col("fp").alias("a"))
        .join(few.select("which", "key", F.col("fp").alias("b")), ["which", "key"])
        .filter((F.col("a") < F.col("b")) & _near("a", "b", max_bits))
        .select("a", "b")
    )
    ball = [F.lit(0)] + ([F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)] if max_bits else [])
    points = (
        met.filter(F.col("n") > CROWD)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(bit.cast("long")) for bit in ball])).alias("point"))
    )
    crowded = (
        points.groupBy("point")
        .agg(F.min("fp").alias("least"), F.collect_set("fp").alias("all"))
        .select((F.col("least") if max_bits == 2 else F.col("point")).alias("a"), "all", F.explode("all").alias("b"))
        .filter(F.array_contains("all", F.col("a")))
        .filter((F.col("a") != F.col("b")) & _near("a", "b", max_bits))
        .select("a", "b")
    )
    return joined.union(crowded).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the (a, b) links: the smallest node that it reaches.

    Alternates two steps on the links alone: link all larger neighbours of a node to its smallest
    neighbour, then all smaller ones; hubs are reduced before they are joined. Each round is written
    to the shared folder; the rounds end when the links stay as they are.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        new_state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new_state == state or new_state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        state = new_state
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(lowest, "u").select(
            F.col("w").alias("u"), F.col("m").alias("v")
        )
        large = large.distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.inline(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        ))).filter("u != v").distinct()
        now = materialize(small)


def grouped(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, t, fp, component_id, first): one row per row of ``docs`` (doc_id, text).

    ``t`` is a hash of the text; ``first`` marks the rows of the smallest (doc_id, t) of a component.
    """
    light = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    base = materialize(fingerprints(light, "text", shingle).select("doc_id", "t", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    nodes = base.groupBy("fp").agg(F.min(order).alias("least"))
    linked = components(links(nodes, max_bits))
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted)
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"))
    head_of = rooted.join(heads, "root").select("fp", "head")
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("t") == F.col("head.t"))
    return base.join(head_of, "fp").select(
        "doc_id", "t", "fp", F.col("head.doc_id").alias("component_id"), same.alias("first")
    )


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (then text hash), all columns kept.

    Of repeated rows of that id and text the one with the smallest hash of its columns stays.
    """
    heads = grouped(docs, shingle, max_bits).filter("first").select("doc_id", "t").distinct()
    t, own, key = (fresh(n, docs.columns) for n in ("t", "own", "key"))
    heads = heads.select(F.col("doc_id").alias(key), F.col("t").alias(t))
    rows = docs.select(F.struct(*docs.columns).alias(own)).select(own, F.col(f"{own}.doc_id").alias("_id"), F.xxhash64(f"{own}.text").alias("_t"))
    met = rows.join(heads, rows["_id"].eqNullSafe(heads[key]) & (rows["_t"] == heads[t]), "left_semi")
    return met.groupBy("_id", "_t").agg(F.min_by(own, F.xxhash64(own)).alias(own)).select(f"{own}.*")
