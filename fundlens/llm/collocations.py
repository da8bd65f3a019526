"""Phrase collocations per language, counted on FM-indexes over word ids.

Texts are cut at punctuation and line ends into pieces, pieces at spaces and tabs into words; phrases stay within a
piece. Tasks write shards: the word ids of about ``SHARD`` words of one language, with the words and their counts.
Counts of words are summed across shards. A phrase can be frequent only if its words and its two-word parts are, so

1. words below ``min_count`` in the whole language become breaks, the others get an id of the whole corpus;
2. each shard's bidirectional FM-index extends all words to the right; pairs are summed across shards;
3. the pairs that are frequent in the whole corpus are extended to the left, and triples are summed.

The pruning uses corpus counts only, so every phrase with a count of ``min_count`` is counted exactly. A text longer
than a shard is cut anywhere: the next shard begins with the last two words again, and a shard of these two with sign
-1 takes away what would count twice.

Of the cuts of a phrase into two, the one with the smallest floor(10^6 a^2 / (l r)) counts, ties to the shorter first
part; products are exact decimals. A pair is dropped when some frequent triple that extends it to the left or right
has at least ``share`` percent of its count.

Bounds: a shard is one task's numpy arrays; words and pairs of a shard are gathered by shard, never by word or
language. Words that stand in many phrases are looked up with ``SALTS`` salted copies of the counts.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each; an empty
table gives an empty one; further columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.fm_index import FMIndex
from fundlens.session import materialize

SHARD = 1 << 19  # words of a shard
OPEN = 64  # languages that a task has open
BLOCK = 1 << 20  # bytes of a text that are cut into words at a time
TAIL = 2  # words that a cut text's next shard repeats
SALTS = 8
PARTS = 64  # parts of a language whose phrases are ranked by themselves first
PART = 1 << 16  # rows of a batch that a shard returns
BREAK = b"\n"
TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" "
)
SHARDS = "shard long, lang string, sign long, vocab array<string>, counts array<long>, ids binary"
SHARD_ARROW = pa.schema([
    ("shard", pa.int64()), ("lang", pa.string()), ("sign", pa.int64()), ("vocab", pa.list_(pa.string())),
    ("counts", pa.list_(pa.int64())), ("ids", pa.binary()),
])


class _Open:
    """Words of one language that a task has gathered."""

    def __init__(self):
        self.ids: dict[bytes, int] = {BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, tokens: list[bytes]) -> None:
        ids = self.ids
        part = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens if t), dtype=np.int32)
        self.parts.append(part)
        self.n += len(part)

    def row(self, name: int, lang: str, sign: int) -> pa.RecordBatch:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, dtype=np.int32)
        counts = sign * np.bincount(ids, minlength=len(self.ids))[1:]
        vocab = pa.array([w for w in self.ids if w != BREAK], pa.binary()).cast(pa.string())
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [pa.array([name]), pa.array([lang]), pa.array([sign]), whole(vocab), whole(pa.array(counts)), pa.array([_packed(ids)])]
        return pa.RecordBatch.from_arrays(columns, schema=SHARD_ARROW)


def _blocks(data: bytes) -> Iterator[bytes]:
    """Parts of a text, cut at spaces."""
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + BLOCK)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop]
        start = stop


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    held: dict[str, _Open] = {}
    made = 0

    def name() -> int:
        nonlocal made
        made += 1
        return (task << 32) + made

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            text, lang = text.as_py(), lang.as_py()
            if not text:
                continue
            for block in _blocks(text.encode().translate(TABLE)):
                own = held.setdefault(lang, _Open())
                own.add(block.replace(BREAK, b" \n ").split(b" "))
                if own.n >= size:
                    yield own.row(name(), lang, 1)
                    words = list(own.ids)
                    last = [words[k] for k in own.parts[-1][-TAIL:]]
                    if len(last) < TAIL and len(own.parts) > 1:
                        last = [words[k] for k in np.concatenate(own.parts[-TAIL - 1 :])[-TAIL:]]
                    again = _Open()
                    again.add(last)
                    yield again.row(name(), lang, -1)
                    held[lang] = _Open()
                    held[lang].add(last)
            held.setdefault(lang, _Open()).add([BREAK])
            if len(held) > OPEN or sum(o.n for o in held.values()) > 2 * size:
                for key, own in held.items():
                    yield own.row(name(), key, 1)
                held.clear()
    for key, own in held.items():
        yield own.row(name(), key, 1)


def _packed(ids: np.ndarray) -> bytes:
    """Ids as four planes of bytes, of which the upper ones are almost all zero and compress well."""
    return ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _index(row: dict) -> tuple[FMIndex, np.ndarray]:
    """The index of a shard's frequent words, and their ids in the corpus."""
    order = np.argsort(row["wid"])
    wids = row["wid"][order]
    own = np.zeros(row["size"] + 1, dtype=np.int32)
    own[row["local"][order] + 1] = np.arange(1, len(wids) + 1)
    return FMIndex(own[_unpacked(row["ids"])]), wids


def _rows(batches: Iterator[pa.RecordBatch], work: Callable[[dict], list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """``work`` of each row; lists are arrays."""
    for batch in batches:
        numbers = lambda name, k, batch=batch: batch.column(name)[k].values.to_numpy(zero_copy_only=False)
        lists = [n for n in ("local", "wid", "first", "second") if n in batch.schema.names]
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in ("shard", "sign", "size", "ids")}
            found = work(row | {n: numbers(n, k) for n in lists})
            for start in range(0, len(found[0]), PART):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + PART]) for c in found], names=names)


def _pairs_of(row: dict) -> list[np.ndarray]:
    index, wids = _index(row)
    left, right, two = index.extend_right(index.words(), further=False)
    return [np.full(len(left), row["shard"]), wids[left], wids[right - 1], two.n * row["sign"]]


def _triples_of(row: dict) -> list[np.ndarray]:
    index, wids = _index(row)
    place = lambda w: np.searchsorted(wids, w).astype(np.int64)
    allowed = np.sort(place(row["first"]) * index.top + place(row["second"]))

    def frequent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * index.top + b
        return allowed[np.minimum(np.searchsorted(allowed, key), len(allowed) - 1)] == key

    left, right, two = index.extend_right(index.words(), further=False)
    stay = frequent(left, right - 1)
    left, right = left[stay], right[stay] - 1
    which, before, three = index.extend_left(two[stay], further=False)
    stay = frequent(before - 1, left[which])
    which, before, n = which[stay], before[stay] - 1, three.n[stay]
    return [wids[before], wids[left[which]], wids[right[which]], n * row["sign"]]


def _looked_up(df: DataFrame, words: DataFrame, key: str, name: str, how: str = "inner") -> DataFrame:
    """``df`` and the words' struct ``name`` by ``key``; a word may stand in a large share of all phrases, so keys are salted."""
    copies = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = copies.select("_salt", F.col("w").alias(key), F.struct("lang", "word", "f").alias(name))
    salt = F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SALTS)).cast("int")
    return df.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")


def counted(docs: DataFrame, min_count: int, text: str = "text", lang: str = "lang", shard: int = SHARD) -> tuple[DataFrame, ...]:
    """(totals, words, pairs, triples): all phrases of ``min_count`` or more occurrences, exactly counted.

    totals (lang, total) with each language's number of words; words (w, lang, word, f) with an id ``w`` of (lang,
    word); pairs (w1, w2, f); triples (w1, w2, w3, f). All but the totals are written tables.
    """
    light = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    shards = materialize(light.mapInArrow(partial(_shards, size=shard), SHARDS))
    sums = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    listed = shards.select("shard", "lang", F.posexplode(F.arrays_zip("vocab", "counts")).alias("local", "w"))
    listed = listed.select("shard", "lang", "local", F.col("w.vocab").alias("word"), F.col("w.counts").alias("n"))
    # one row per shard and word: a word's rows are at most as many as the shards
    of_word = Window.partitionBy("lang", "word")
    listed = listed.withColumn("at", F.monotonically_increasing_id())
    known = listed.withColumns({"f": F.sum("n").over(of_word), "w": F.min("at").over(of_word)})
    known = materialize(known.filter(F.col("f") >= min_count).select("shard", "local", "w", "lang", "word", "f"))
    words = materialize(known.groupBy("w").agg(*(F.first(c).alias(c) for c in ("lang", "word", "f"))))
    own = known.groupBy("shard").agg(F.collect_list(F.struct("local", "w")).alias("known"))
    mapped = shards.select("shard", "sign", F.size("vocab").alias("size"), "ids").join(own, "shard")
    mapped = materialize(mapped.select("shard", "sign", "size", "ids", F.col("known.local").alias("local"), F.col("known.w").alias("wid")))
    two = partial(_rows, work=_pairs_of, names=["shard", "w1", "w2", "n"])
    found = mapped.mapInArrow(two, "shard long, w1 long, w2 long, n long")
    kept = found.withColumn("f", F.sum("n").over(Window.partitionBy("w1", "w2"))).filter(F.col("f") >= min_count)
    kept = materialize(kept.select("shard", "w1", "w2", "f"))
    pairs = materialize(kept.groupBy("w1", "w2").agg(F.first("f").alias("f")))
    allowed = kept.groupBy("shard").agg(F.collect_list(F.struct("w1", "w2")).alias("p"))
    allowed = allowed.select("shard", F.col("p.w1").alias("first"), F.col("p.w2").alias("second"))
    three = partial(_rows, work=_triples_of, names=["w1", "w2", "w3", "n"])
    longer = mapped.join(allowed, "shard").mapInArrow(three, "w1 long, w2 long, w3 long, n long")
    triples = longer.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    return totals, words, pairs, materialize(triples)


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame, share: int = 50) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, score) of the candidates that no longer one drops."""
    extended = triples.select("w1", "w2", "f").union(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))
    most = extended.groupBy("w1", "w2").agg(F.max("f").alias("longest"))
    none = F.lit(None).cast("long")
    two = pairs.join(most, ["w1", "w2"], "left").filter(
        F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("f"))
    )
    two = two.select("w1", "w2", none.alias("w3"), F.col("f").alias("a"), none.alias("head"), none.alias("tail"))
    head = pairs.withColumnRenamed("f", "head")
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("tail"))
    three = triples.withColumnRenamed("f", "a").join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
    both = two.unionByName(three)
    both = _looked_up(_looked_up(both, words, "w1", "first"), words, "w2", "second")
    both = _looked_up(both, words, "w3", "third", "left")

    def cut(k: int, left: str, right: str):
        exact = lambda c: F.col(c).cast("decimal(15,0)")
        whole = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), exact(left) * exact(right))
        return F.struct(whole.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    of_two = cut(1, "first.f", "second.f")
    of_three = F.least(cut(1, "first.f", "tail"), cut(2, "head", "third.f"))
    best = both.withColumn("best", F.when(F.col("w3").isNull(), of_two).otherwise(of_three))
    return best.select(
        "first.lang",
        F.concat_ws(" ", "first.word", "second.word", "third.word").alias("phrase"),
        F.when(F.col("w3").isNull(), 2).otherwise(3).alias("n_words"),
        "a", "best.l", "best.r", "best.score",
    )


def phrases(docs: DataFrame, min_count: int = 10, top: int = 2000, share: int = 50, **where) -> DataFrame:
    """(lang, rank, phrase, a, l, r, score, n, n_words): each language's first ``top`` phrases by score, count, phrase."""
    totals, *counts = counted(docs, min_count, **where)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = scored(*counts, share=share).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # the first of each part of a language hold its first; so no task ranks all phrases of a language
    parted = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    first = found.withColumn("_at", parted).filter(F.col("_at") <= top).drop("_at", "_part")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(totals.withColumnRenamed("total", "n"), "lang")
