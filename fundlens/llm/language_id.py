"""Language ID by compression: the language whose zstandard dictionary makes a text smallest.

For each language a raw-content dictionary is cut from a bounded sample of its labelled texts: a passage of each,
at a place of the whole text that a hash of its id draws. A text is compressed in pieces with every dictionary; the language of the smallest sum wins, its margin over the
second is the evidence, and narrow margins are rejected (``accepted`` is false, the prediction stays).

Defined results: a null text, one without a letter, and every text where no language was learned get
``und`` with score 0; ties go to the first language in code point order.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.shared import with_columns

SAMPLE = 300  # texts per language that a dictionary is cut from
PASSAGE = 400  # characters that each of them gives
PIECE = 1 << 11  # bytes that are compressed at a time, so that long texts do not become their own dictionary
LEVEL = 3
NARROW = 0.01  # margin, as a share of the second size, below which a prediction is rejected
HALF = 0.04  # margin of the score 0.5
LETTER = regex.compile(r"\p{L}")


def fit_dictionaries(docs: DataFrame, use: Column, sample: int = SAMPLE, passage: int = PASSAGE) -> dict[str, bytes]:
    """Raw content per language, from the ``sample`` smallest by a hash of the id.

    A passage lies anywhere in its text, so a common head of many texts does not become the language.
    Some hundred kilobytes per language reach the driver. ``use`` is a condition on ``doc_id``.
    """
    places = F.greatest(F.char_length("text") - F.lit(passage), F.lit(0)) + F.lit(1)
    place = F.pmod(F.xxhash64(F.lit("place"), F.col("doc_id").cast("string")), places).cast("int")
    known = docs.filter(F.col("lang").isNotNull() & use & F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "passage")
    rows = (
        known.select("lang", "doc_id", F.substring("text", place + F.lit(1), F.lit(passage)).alias("passage"))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= sample)
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("all"))
        .select("lang", F.array_join(F.transform("all", lambda x: x["passage"]), "\n").alias("content"))
    )
    return {r["lang"]: r["content"].encode() for r in rows.collect()}


class Classifier:
    """Sizes of a text under each dictionary."""

    def __init__(self, contents: dict[str, bytes]):
        self.names = sorted(contents, key=lambda n: n.encode())
        self.compressors = []
        for name in self.names:
            own = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is wide enough."""
        if not self.names or text is None or not LETTER.search(text):
            return "und", 0.0, False
        data = text.encode()
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(sizes) == 1:
            return self.names[best], 1.0, True
        second = min(s for k, s in enumerate(sizes) if k != best)
        margin = (second - sizes[best]) / second
        return self.names[best], margin / (margin + HALF), margin >= NARROW


def _maker(contents):
    own = Classifier(contents)

    def work(texts):
        rows = [own.judge(t) for t in texts]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    return work


def predicted(docs: DataFrame, text: str, contents: dict[str, bytes], names: tuple = ("lang_pred", "score", "accepted")) -> DataFrame:
    """``docs`` with the language of each whole text, its score and whether it is accepted."""
    ddl = f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"
    return with_columns(docs, text, partial(_maker, contents), ddl)
