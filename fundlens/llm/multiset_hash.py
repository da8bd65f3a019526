"""Document fingerprints: a homomorphic hash of the multiset of paragraphs, in DataFrame operations only.

A paragraph is a line of the text. It maps to a wide vector: ``STRONG`` lanes are hashes of its SHA-256
digest (with the lane number) modulo 2**32, and ``TALLY`` lanes sum +1 or -1 over its sentences, by the
bits of their hashes, modulo 2**16; one lane counts the sentences. A sentence stays within its line, so
every part of a vector is a sum over the lines. A document's fingerprint is the sum of
its paragraphs' vectors, so the order of paragraphs does not matter, equal texts have equal fingerprints,
and a paragraph is inserted or deleted by adding or subtracting its vector.

The likeness of two fingerprints is one less the share of sentences in which they differ: the mean
square of the differences of the tally lanes estimates the size of the symmetric difference.

Defined results: a null text is the empty text; it has one empty paragraph and no sentence; documents
without sentences are like each other with 1 and like others with 0. Repeated rows have equal results.
A carriage return is part of its line. A very long text is hashed line by line in one row; a column that
is called like the new one is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.session import materialize

STRONG = 16
TALLY = 64
LANE, SMALL = 1 << 32, 1 << 16
SENTENCE = r"[.!?]+[^\S\n]*|\n"  # ends of sentences; white space of the next line is that line's


def _sum(a: Column, b: Column, modulo: int) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(modulo)))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: a name bound by a function over one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def vector(text: Column) -> Column:
    """Struct of the ``strong`` and ``tally`` lanes and the number ``n`` of sentences."""
    text = F.coalesce(text, F.lit(""))
    digests = F.transform(F.split(text, "\n"), lambda p: F.unhex(F.sha2(p, 256)))
    lanes = lambda d: F.array(*[F.pmod(F.xxhash64(F.lit(k), d), F.lit(LANE)) for k in range(STRONG)])
    sentences = F.transform(F.array_remove(F.split(text, SENTENCE), ""), lambda s: F.xxhash64(s))
    bits = F.sequence(F.lit(0), F.lit(TALLY - 1))

    def both(hashes):
        # each lane's ones are counted over all sentences; +1 and -1 follow from the count
        ones = lambda k: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, k).cast("int"))
        tally = F.transform(bits, lambda k: F.pmod(2 * ones(k) - F.size(hashes), F.lit(SMALL)))
        return F.struct(tally.alias("tally"), F.size(hashes).alias("n"))

    strong = F.aggregate(digests, F.array_repeat(F.lit(0).cast("long"), STRONG), lambda acc, d: _sum(acc, lanes(d), LANE))
    return _with(
        F.struct(strong.alias("strong"), _with(sentences, both).alias("rest")),
        lambda v: F.struct(v["strong"].alias("strong"), v["rest"]["tally"].alias("tally"), v["rest"]["n"].alias("n")),
    )


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of all paragraphs of ``a`` and ``b``, or of ``a`` without those of ``b`` (sign -1)."""
    other = lambda lanes: F.transform(lanes, lambda x: x * sign)
    return F.struct(
        _sum(a["strong"], other(b["strong"]), LANE).alias("strong"),
        _sum(a["tally"], other(b["tally"]), SMALL).alias("tally"),
        (a["n"] + sign * b["n"]).alias("n"),
    )


def digest(v: Column) -> Column:
    """The vector as lowercase hex digits."""
    wide = lambda lanes, k: F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), k, "0")), "")
    return F.lower(F.concat(wide(v["strong"], 8), wide(v["tally"], 4), F.hex(v["n"])))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: share of sentences that two fingerprints have in common; 1 for equal ones."""
    signed = lambda x: F.when(x >= SMALL // 2, x - SMALL).otherwise(x)
    squares = F.zip_with(a["tally"], b["tally"], lambda x, y: F.pow(signed(F.pmod(x - y, F.lit(SMALL))).cast("double"), F.lit(2.0)))
    apart = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / TALLY
    total = a["n"] + b["n"]
    near = F.greatest(F.lit(0.0), 1 - apart / F.greatest(total, F.lit(1)))
    same = (a["strong"] == b["strong"]) & (a["tally"] == b["tally"])
    return F.when(same, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(near)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "vector") -> DataFrame:
    """``docs`` with the vector of each whole text."""
    return docs.withColumn(name, vector(F.col(text)))


def _next_ids(ids: DataFrame) -> DataFrame:
    """``ids`` with ``after``, a struct of the next ``doc_id`` in descending order: null last, then the first.

    ``ids`` has distinct ids. They are dealt by range; inside a range a window gives the next, and one row
    per range tells the first id of the range below.
    """
    own = F.struct("doc_id").alias("own")
    dealt = materialize(ids.repartitionByRange("doc_id").select("*", own, F.spark_partition_id().alias("part")))
    ends = dealt.groupBy("part").agg(F.max_by("own", F.struct(F.col("doc_id").isNotNull().alias("is"), "doc_id")).alias("top"))
    below = Window.orderBy("part")  # one row per range
    whole = below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = ends.select("part", F.lag("top").over(below).alias("lower"), F.last("top").over(whole).alias("top"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last())
    linked = dealt.withColumn("next", F.lead("own").over(inside)).join(tops, "part")
    return linked.select(*ids.columns, F.coalesce("next", "lower", "top").alias("after"))


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars, edited, next_id, next_vector): each text, and it with its last third replaced.

    The last floor(n/3) code points give way to the first as many of the next document by descending id
    (after the last: the first). Of repeated rows of an id the next document is the one whose text has
    the smallest hash. Both joins read one exchange of the texts by id; only the part of a text that its
    neighbour needs moves once more, with the text's vector.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("none"))
    rows = docs.select("doc_id", "text", key("doc_id").alias("key"))
    text = F.coalesce("text", F.lit(""))
    third = F.floor(F.char_length(text) / 3).cast("int")
    ids = materialize(rows.groupBy("doc_id").agg(F.max(third).alias("take"), F.min(F.xxhash64(text)).alias("t")))
    asked = _next_ids(ids.drop("t")).select(key("doc_id").alias("for"), "take", key("after.doc_id").alias("key"))
    asked = asked.join(ids.select(key("doc_id").alias("key"), "t"), "key")
    # a range test instead of an equality, so that the join stays on the key alone and shares its exchange
    own = F.xxhash64(text)
    met = rows.join(asked, "key").filter((own <= F.col("t")) & (own >= F.col("t")))
    given = F.struct(F.left(text, F.col("take")).alias("head"), vector(text).alias("vector"), F.col("doc_id").alias("id"))
    given = met.select("for", given.alias("given")).groupBy("for").agg(F.first("given").alias("given"))
    full = rows.join(given.withColumnRenamed("for", "key"), "key").select(
        "doc_id", text.alias("text"), F.char_length(text).alias("n"), third.alias("cut"), "given"
    )
    edited = F.concat(F.left("text", F.col("n") - F.col("cut")), F.left("given.head", F.col("cut")))
    return full.select(
        "doc_id", "text", F.col("n").cast("long").alias("n_chars"), edited.alias("edited"),
        F.col("given.id").alias("next_id"), F.col("given.vector").alias("next_vector"),
    )
