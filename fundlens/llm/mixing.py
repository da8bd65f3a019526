"""Mixing sources to target weights with exact block quotas.

Each source is dealt into blocks of about ``BLOCK_WORDS`` words by a hash of its documents; a keyed
affine map permutes the block numbers, so any run of places is a random set of disjoint blocks. A
source's target is met by whole passes over its blocks and one pass up to a cut (block, document, words).
The drawn blocks of all sources are the colours of an urn that a binary tree splits among the output
shards: at each node the left half takes a multivariate hypergeometric share, so each shard gets exact
quotas of every source and reads its own run of places. Within a shard documents lie in hash order.

The driver holds one row per source (size, target, cut). Nodes of the tree are computed in the tasks. Urns of any
number of blocks are drawn exactly.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own and
comes last; rows equal in id and text share their place, and a cut falls on each of them alike; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fundlens.llm.shared import fresh, words
from fundlens.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source's size that the mix may take
BLOCK_WORDS = 20_000
SHARD_WORDS = 200_000  # a table of terabytes takes some ten million
RUN = 1024  # blocks whose words are summed before the running sum
BROADCAST_SOURCES = 50_000
SEED = 20
LARGE_URN = 10**9  # numpy draws from smaller urns only
TOP_NODES = 4096  # nodes of the tree that a task remembers; others are drawn again, with the same result


def targets(sizes: list[int], weights: tuple = WEIGHTS, most: int = MOST) -> list[float]:
    """Shares of all sizes by repeating weights; what is above ``most`` times a size is shared anew."""
    own = [weights[k % len(weights)] for k in range(len(sizes))]
    found: dict[int, float] = {}
    while len(found) < len(sizes):
        rest = sum(sizes) - sum(found.values())
        open_weight = sum(w for k, w in enumerate(own) if k not in found)
        shares = {k: rest * w / open_weight for k, w in enumerate(own) if k not in found}
        above = {k: float(most * sizes[k]) for k, s in shares.items() if s > most * sizes[k]}
        found |= above or shares
    return [found[k] for k in range(len(sizes))]


def permutation(source: int, which: int, n: int) -> tuple[int, int]:
    """Factor and offset of the affine map that permutes the ``n`` block numbers of a source's pass."""
    rng = np.random.default_rng([SEED, source, which])
    factor = int(rng.integers(1, n + 1))
    while math.gcd(factor, n) > 1:
        factor = factor % n + 1
    return factor, int(rng.integers(0, n))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of the ``good`` balls are among ``sample`` balls of the urn; exact for urns of any size.

    The balls lie in random order and the first ``sample`` are taken. The middle good ball has a
    beta-binomial number of bad ones before it, so one draw tells on which side of the cut half of the
    good balls lie; the other half is drawn in the same way until numpy can take the rest.
    """
    taken = 0
    while good + bad >= LARGE_URN and good and sample < good + bad:
        middle = (good + 1) // 2
        before = int(rng.binomial(bad, rng.beta(middle, good + 1 - middle)))
        if middle + before <= sample:
            taken, good, bad, sample = taken + middle, good - middle, bad - before, sample - middle - before
        else:
            good, bad = middle - 1, before
            if sample >= good + bad:
                return taken + good
    if not good or sample >= good + bad:
        return taken + good
    return taken + (int(rng.hypergeometric(good, bad, sample)) if sample else 0)


def urn_share(rng: np.random.Generator, quotas: np.ndarray, sample: int) -> np.ndarray:
    """How many balls of each colour are among ``sample`` balls of the urn."""
    if int(quotas.sum()) < LARGE_URN:
        return rng.multivariate_hypergeometric(quotas, sample, method="marginals")
    share, rest = np.zeros_like(quotas), int(quotas.sum())
    for k, own in enumerate(quotas.tolist()):
        rest -= own
        share[k] = hypergeometric(rng, own, rest, sample)
        sample -= int(share[k])
    return share


class Tree:
    """The splitting tree: which shard holds the g-th draw of a source."""

    def __init__(self, quotas: np.ndarray, shards: int):
        self.quotas, self.levels, self.nodes = quotas.astype(np.int64), int(math.log2(shards)), {}

    def left(self, node: int, quotas: np.ndarray) -> np.ndarray:
        """The share of each source that goes to the left half of a node (numbered as in a heap)."""
        if node in self.nodes:
            return self.nodes[node]
        total = int(quotas.sum())
        rng = np.random.default_rng([SEED, 1 << 40, node])
        share = urn_share(rng, quotas, total // 2) if total else quotas
        if node < TOP_NODES:
            self.nodes[node] = share
        return share

    def shard(self, source: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """Shards of draws; each level sends the draws of each node left or right."""
        out = np.zeros(len(source), dtype=np.int64)
        todo = [(1, self.quotas, np.arange(len(source)), draw.astype(np.int64))]
        while todo:
            node, quotas, rows, rank = todo.pop()
            if node >> self.levels:
                out[rows] = node - (1 << self.levels)
                continue
            left = self.left(node, quotas)
            goes = rank < left[source[rows]]
            for child, share, own, offset in ((2 * node, left, goes, 0), (2 * node + 1, quotas - left, ~goes, 1)):
                if own.any():
                    todo.append((child, share, rows[own], rank[own] - offset * left[source[rows[own]]]))
        return out


def _rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of one row per source, broadcast while the driver's list of them is short."""
    table = spark.createDataFrame(rows, ddl)
    return F.broadcast(table) if len(rows) <= BROADCAST_SOURCES else table


def _cut_blocks(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """(k, place, before): the block of each source in which its last pass ends, and the words before it.

    Words are summed over runs of ``RUN`` places first, then inside the one run that holds the cut.
    """
    placed = blocks.join(plan, "k").withColumn("place", (F.col("block") * F.col("factor") + F.col("offset")) % F.col("n"))
    upto = lambda by: Window.partitionBy("k").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.col("before"), F.lit(0))
    runs = placed.groupBy("k", "rest", F.floor(F.col("place") / RUN).alias("run")).agg(F.sum("w").alias("w"))
    runs = runs.withColumn("before", F.sum("w").over(upto("run"))).filter((ends <= F.col("rest")) & (F.col("rest") < ends + F.col("w")))
    inside = placed.join(runs.select("k", "run", ends.alias("start")), "k").filter(F.floor(F.col("place") / RUN) == F.col("run"))
    inside = inside.withColumn("before", F.col("start") + F.coalesce(F.sum("w").over(upto("place")), F.lit(0)))
    cut = inside.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("w")))
    return cut.select("k", "block", "place", "rest", "before")


def plan_mix(sized: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS) -> list[dict]:
    """One entry per source (in code point order, null last) of rows (source, u, size)."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(by_source, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    plan = []
    for k, (row, target) in enumerate(zip(rows, targets([r["size"] for r in rows], weights), strict=True)):
        size = row["size"]
        n = max(1, -(-size // block_words))
        passes = int(target // size) if size else 0
        factor, offset = permutation(k, passes, n)
        rest = min(round(target - passes * size), size) if size else 0
        if size and rest == size:
            passes, rest = passes + 1, 0
        plan.append({"k": k, "source": row["source"], "size": size, "target": float(target), "n": n, "passes": passes, "rest": rest, "factor": factor, "offset": offset, "place": 0, "cut": None, "part": 0})
    if not plan:
        return plan
    spark = sized.sparkSession
    small = _rows(
        spark,
        [tuple(p[c] for c in ("k", "source", "n", "rest", "factor", "offset")) for p in plan],
        "k long, source string, n long, rest long, factor long, offset long",
    )
    keyed = sized.join(small, sized["source"].eqNullSafe(small["source"])).select("k", "u", "size", F.pmod("u", "n").alias("block"))
    blocks = keyed.filter("size > 0").groupBy("k", "block").agg(F.sum("size").alias("w"))
    cut = _cut_blocks(blocks, small.drop("source"))
    cuts = {r["k"]: r for r in cut.collect()}
    if cuts:
        ends = _rows(spark, [(r["k"], r["block"], r["rest"] - r["before"]) for r in cuts.values()], "k long, block long, left long")
        docs = keyed.join(ends, ["k", "block"]).filter("size > 0").groupBy("k", "u", "left").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("w").over(Window.partitionBy("k").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = docs.withColumn("before", before).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("w")))
        for r in last.collect():
            plan[r["k"]] |= {"cut": r["u"], "part": (r["left"] - r["before"]) // r["n"], "place": cuts[r["k"]]["place"]}
    return plan


def _draw(batches, plan: list[dict], shards: int, at: dict[str, int], names: list[str], kind: pa.DataType):
    column = lambda c: np.array([0 if p[c] is None else p[c] for p in plan], dtype=np.int64)
    n, passes, rest, cut, part, place = (column(c) for c in ("n", "passes", "rest", "cut", "part", "place"))
    most = int(passes.max(initial=0)) + 1
    moves = np.array([[permutation(k, e, int(n[k])) for e in range(most)] for k in range(len(plan))], dtype=np.int64)
    tree = Tree(n * passes + np.where(rest > 0, place + 1, 0), shards)
    targets_, sizes = np.array([p["target"] for p in plan]), column("size")
    for batch in batches:
        k, u, size = (batch.column(at[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "u", "size"))
        block = np.mod(u, n[k])
        taken, draws = np.zeros(len(k), dtype=np.int64), [[] for _ in range(len(k))]
        for e in range(most):
            where = (block * moves[k, e, 0] + moves[k, e, 1]) % n[k]
            inside = (where < place[k]) | ((where == place[k]) & (u < cut[k]))
            got = np.where(e < passes[k], size, 0)
            last = (e == passes[k]) & (rest[k] > 0)
            got = np.where(last & inside, size, got)
            got = np.where(last & (where == place[k]) & (u == cut[k]), np.minimum(part[k], size), got)
            own = np.flatnonzero(got > 0)
            shard = tree.shard(k[own], e * n[k[own]] + where[own])
            taken += got
            order = ((u[own].astype(np.uint64) ^ np.uint64(e * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
            for i, s, o, g in zip(own.tolist(), shard.tolist(), order.tolist(), got[own].tolist(), strict=True):
                draws[i].append({"shard": s, "place": o, "words": g})
        found = [pa.array(sizes[k]), pa.array(targets_[k]), pa.array(taken), pa.array(draws, kind)]
        kept = [c for i, c in enumerate(batch.columns) if i not in at.values()]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(size), *found], names=names)


DRAWS = "array<struct<shard:long,place:long,words:long>>"


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with one struct column ``mix``.

    ``mix`` holds size, source_size, target, taken (words, repeats counted) and ``draws``: one (shard,
    place, words) per copy that the mix takes. A clashing column gets the next free name with
    underscores, which is always the last column.
    """
    names = {c: fresh(c, docs.columns) for c in ("mix_k", "mix_u", "mix_size", "mix")}
    u = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    sized = docs.withColumns({names["mix_u"]: u, names["mix_size"]: F.size(words(F.col("text"))).cast("long")})
    light = materialize(sized.select("source", F.col(names["mix_u"]).alias("u"), F.col(names["mix_size"]).alias("size")))
    plan = plan_mix(light, weights, block_words)
    small = _rows(docs.sparkSession, [(p["k"], p["source"]) for p in plan], f"`{names['mix_k']}` long, mix_source string")
    keyed = sized.join(small, sized["source"].eqNullSafe(small["mix_source"])).select(*docs.columns, *(names[c] for c in ("mix_k", "mix_u", "mix_size")))
    total = sum(p["target"] for p in plan)
    shards = 1 << max(0, math.ceil(math.log2(max(total / shard_words, 1))))
    new = StructType.fromDDL(f"size long, source_size long, target double, taken long, draws {DRAWS}")
    out = [fresh(f.name, docs.columns) for f in new.fields]
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(out, new.fields, strict=True))).fields])
    at = {c: len(docs.columns) + i for i, c in enumerate(("k", "u", "size"))}
    kind = pa.list_(pa.struct([("shard", pa.int64()), ("place", pa.int64()), ("words", pa.int64())]))
    rows = keyed.mapInArrow(partial(_draw, plan=plan, shards=shards, at=at, names=[f.name for f in schema.fields], kind=kind), schema)
    return rows.select(*docs.columns, F.struct(*(F.col(o).alias(f.name) for o, f in zip(out, new.fields, strict=True))).alias(names["mix"]))


def shards(mix: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, dealt by shard and in random order inside each.

    A cut copy keeps the text up to its last word that is taken. The columns are those before ``mix``.
    """
    own, columns = mix.columns[-1], mix.columns[:-1]
    draw = fresh("draw", mix.columns)
    copies = mix.select(*columns, F.col(f"{own}.size").alias("_size"), F.explode(f"{own}.draws").alias(draw))
    cut = F.col(f"{draw}.words") < F.col("_size")
    short = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col(f"{draw}.words").cast("int")), " ")
    copies = copies.withColumn("text", F.when(cut, short).otherwise(F.col("text")))
    dealt = copies.repartition(F.col(f"{draw}.shard")).sortWithinPartitions(f"{draw}.shard", f"{draw}.place")
    return dealt.select(*columns)
