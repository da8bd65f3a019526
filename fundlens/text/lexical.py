"""Inverted index and BM25 ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from fundlens.operators.skew import BROADCAST_ROWS, join_unique
from fundlens.session import materialize
from fundlens.sources.bucketed import open_bucketed, write_bucketed
from fundlens.text.tokens import stem_words, words

# BM25 parameters.
K1 = 1.2
B = 0.75

SCORE_DIGITS = 6  # scores are rounded before ranking, so summation order cannot change a rank
SALTS = 64

# Documents, postings and query terms that meet in one task of a search.
TILE_DOCS = 16_384
TILE_POSTINGS = 2_000_000
TILE_TERMS = 1_000_000
PACK_BYTES = 128 * 2**20  # rows that a task packs at a time
TASK_CHARS = 16_000_000  # characters of the texts whose words one task counts


@dataclass(frozen=True)
class Index:
    """Postings (term, id, tf, doc_len), terms (term, df), and the two corpus totals."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    avg_len: float
    stemmed: bool


def dealt_texts(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text) dealt by id over as many tasks as the counted characters need, whatever the splits of the table are."""
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = found.agg(F.sum(F.length("text")).alias("n")).head()["n"] or 0
    return found.repartition(max(-(-chars // TASK_CHARS), docs.sparkSession.sparkContext.defaultParallelism), "id")


def term_counts(docs: DataFrame, stemmed: bool, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, doc_len, term, tf). Texts are dealt by id, so that a task counts a bounded number of words and no counts move."""
    found = dealt_texts(docs, id_col, text_col).select("id", words("text").alias("_w"))
    exploded = found.select("id", F.size("_w").alias("doc_len"), F.explode("_w").alias("term"))
    counts = exploded.groupBy("id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    if stemmed:
        counts = stemmed_terms(counts).groupBy("id", "doc_len", "term").agg(F.sum("tf").alias("tf"))
    return counts


def stemmed_terms(counts: DataFrame) -> DataFrame:
    """``counts`` with the stem in place of ``term``: each distinct word is stemmed once, and only words that
    differ from their stem are joined, broadcast when their counted number allows it."""
    counts = materialize(counts)
    stems = counts.select("term").distinct().withColumn("_stem", stem_words("term"))
    changed = materialize(stems.filter(F.col("_stem") != F.col("term")))
    if changed.count() <= BROADCAST_ROWS:
        met = counts.join(F.broadcast(changed), "term", "left")
    else:
        met = join_unique(counts, changed, "term", ["id"])
    return met.withColumn("term", F.coalesce("_stem", "term")).select(*counts.columns)


def build_index(docs: DataFrame, stemmed: bool = True, id_col: str = "id", text_col: str = "text") -> Index:
    """Index a document table with unique ids. Postings are written once to the shared folder."""
    postings = materialize(
        term_counts(docs, stemmed, id_col, text_col)
        .select("term", "id", "tf", "doc_len")
    )
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = postings.agg(F.sum("tf").alias("words")).head()["words"] or 0
    n_docs = docs.count()
    return Index(postings, terms, n_docs, total / max(n_docs, 1), stemmed)


def save_index(index: Index, path: str) -> None:
    """Store the index; postings are range-partitioned by term so that a search prunes row groups."""
    index.postings.repartitionByRange("term", "id").sortWithinPartitions("term").write.mode(
        "overwrite"
    ).parquet(f"{path}/postings")
    save_totals(index, path)


def save_totals(index: Index, path: str) -> None:
    """The terms and the corpus totals of an index."""
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark = index.postings.sparkSession
    totals = spark.range(1).select(
        F.lit(index.n_docs).cast("long").alias("n_docs"),
        F.lit(float(index.avg_len)).alias("avg_len"),
        F.lit(index.stemmed).alias("stemmed"),
    )
    totals.write.mode("overwrite").parquet(f"{path}/totals")


def load_index(spark: SparkSession, path: str) -> Index:
    total = spark.read.parquet(f"{path}/totals").head()
    return Index(
        spark.read.parquet(f"{path}/postings"),
        spark.read.parquet(f"{path}/terms"),
        total["n_docs"],
        total["avg_len"],
        total["stemmed"],
    )


def save_bucketed(index: Index, path: str, name: str, buckets: int) -> Index:
    """Store the index with its postings in buckets of (term, salt): a search then shuffles no postings.

    A frequent term lies in up to ``SALTS`` buckets. ``load_bucketed`` opens it in another session.
    """
    salted = index.postings.withColumn("_salt", _salt_of())
    keys = ["term", "_salt"]
    postings = write_bucketed(salted, f"{path}/postings", f"{name}_postings", keys, buckets)
    save_totals(index, path)
    return replace(index, postings=postings, terms=index.postings.sparkSession.read.parquet(f"{path}/terms"))


def load_bucketed(spark: SparkSession, path: str, name: str, buckets: int) -> Index:
    postings = open_bucketed(spark, f"{path}/postings", f"{name}_postings", ["term", "_salt"], buckets)
    return replace(load_index(spark, path), postings=postings)


def query_terms(queries: DataFrame, stemmed: bool) -> DataFrame:
    """Distinct (query_id, term, n_terms)."""
    found = queries.select("query_id", F.explode(words("text")).alias("term"))
    if stemmed:
        found = found.withColumn("term", stem_words("term"))
    terms = found.distinct()
    per_query = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    return terms.join(per_query, "query_id")


def term_hits(index: Index, terms: DataFrame) -> DataFrame:
    """The postings of the asked ``terms`` (term, …) with the columns of both and ``idf``.

    The terms are broadcast when their counted number allows it: postings are filtered in place, then
    placed by document, so that the much larger (query, document) hits are summed up where they arise
    and never shuffled. Otherwise postings are joined on (term, salt): a frequent term is spread over
    ``SALTS`` tasks. Postings that are stored in buckets of (term, salt) are joined where they lie.
    """
    idf = F.log(F.lit(float(index.n_docs)) / (F.col("df") + 1)) + 1
    if "_salt" in index.postings.columns:
        return _salted_hits(index.postings, terms.join(index.terms, "term").withColumn("idf", idf))
    if terms.count() <= BROADCAST_ROWS:
        asked = F.broadcast(terms.select("term").distinct())
        known = index.terms.join(asked, "term", "left_semi")
        terms = materialize(terms.join(F.broadcast(known), "term").withColumn("idf", idf))
        asked = F.broadcast(terms.select("term").distinct())
        placed = index.postings.join(asked, "term", "left_semi").repartition("id")
        return placed.join(F.broadcast(terms), "term")
    return _salted_hits(index.postings.withColumn("_salt", _salt_of()), terms.join(index.terms, "term").withColumn("idf", idf))


def _salt_of() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")


def _salted_hits(postings: DataFrame, terms: DataFrame) -> DataFrame:
    return postings.join(_copies(terms), ["term", "_salt"]).drop("_salt")


def _copies(terms: DataFrame) -> DataFrame:
    """One row per salt; to be merged, since Spark could take the copies for small and broadcast them."""
    return terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def saturation(avg_len: float) -> Column:
    """What ``tf`` and ``doc_len`` contribute to a BM25 weight, to be multiplied by the term's idf."""
    norm = (1 - B) + B * F.col("doc_len") / F.lit(avg_len)
    return (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * norm)


def bm25_scores(index: Index, queries: DataFrame, match: str = "all") -> DataFrame:
    """(query_id, id, score) of every matching document; ``match`` is "all" or "any" terms."""
    hits = term_hits(index, materialize(query_terms(queries, index.stemmed)))
    weight = F.col("idf") * saturation(index.avg_len)
    scored = hits.groupBy("query_id", "id").agg(
        F.round(F.sum(weight), SCORE_DIGITS).alias("score"),
        F.count(F.lit(1)).alias("_matched"),
        F.first("n_terms").alias("_needed"),
    )
    if match == "all":
        scored = scored.filter("_matched = _needed")
    return scored.select("query_id", "id", "score")


def top_k(scored: DataFrame, k: int, descending: bool = True, score: str = "score") -> DataFrame:
    """The first k rows per query with their rank; ties go to the smaller id."""
    first = F.col(score).desc() if descending else F.col(score).asc()
    order = Window.partitionBy("query_id").orderBy(first, "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def asked_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms, idf) of the terms of the queries that the index knows, as a written table."""
    idf = F.log(F.lit(float(index.n_docs)) / (F.col("df") + 1)) + 1
    terms = query_terms(queries, index.stemmed).join(index.terms, "term")
    return materialize(terms.select("query_id", "term", "n_terms", idf.alias("idf")))


def asked_postings(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the asked terms: filtered where they lie; all of them if there are too many terms to send."""
    if "_salt" in postings.columns:
        return postings.join(_copies(terms.select("term").distinct()), ["term", "_salt"], "left_semi")
    distinct = materialize(terms.select("term").distinct())
    return postings.join(F.broadcast(distinct), "term", "left_semi") if distinct.count() <= BROADCAST_ROWS else postings


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task as one compressed table per tile, texts and numbers with fractions as codes; the tile is the last column."""
    held: list[pa.RecordBatch] = []

    def packs() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        own, table = table.column(table.num_columns - 1).to_numpy(), table.select(range(table.num_columns - 1))
        by = np.argsort(own, kind="stable")
        names, begin = np.unique(own[by], return_index=True)
        out = []
        for first, last in zip(begin, [*begin[1:], len(by)], strict=True):
            part = table.take(pa.array(by[first:last]))
            part = pa.table({n: c.dictionary_encode() if pa.types.is_string(c.type) or pa.types.is_floating(c.type) else c for n, c in zip(part.column_names, part.columns, strict=True)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(part.combine_chunks())
            out.append(sink.getvalue().to_pybytes())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(out, pa.binary())], names=["tile", "pack"])

    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield packs()
    if sum(b.num_rows for b in held):
        yield packs()


def _unpacked(packs: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of all packs of a tile."""
    plain = lambda c, kind: pa.chunked_array([x.dictionary_decode() for x in c.chunks], kind) if pa.types.is_dictionary(c.type) else c
    found = [schema.empty_table()]
    for pack in packs.column("pack"):
        part = pa.ipc.open_stream(pack.as_buffer()).read_all()
        found.append(pa.table({f.name: plain(part.column(f.name), f.type).cast(f.type) for f in schema}, schema=schema))
    return pa.concat_tables(found).combine_chunks()


def _packs(rows: DataFrame, tile: Column) -> tuple[DataFrame, pa.Schema]:
    """(tile, pack) of the rows, and their schema as Arrow tables."""
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in rows.schema.fields]
    return rows.withColumn("_tile", tile).mapInArrow(partial(_packed, most=PACK_BYTES), "tile int, pack binary"), pa.schema(fields)


def in_tiles(index: Index, postings: DataFrame, terms: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType, deal: str = "id") -> DataFrame:
    """``run`` of the postings and query terms of each (block of documents, block of queries).

    A block holds at most about ``TILE_DOCS`` documents and ``TILE_POSTINGS`` postings, or ``TILE_TERMS`` query terms, so
    a task's memory is bounded; postings are copied once per block of queries, query terms once per block of documents,
    and the (query, document) hits, which are many more, never leave their task. What is copied are packs: compressed
    tables of the rows that a task has for a block, with each word once.
    """
    cores = postings.sparkSession.sparkContext.defaultParallelism
    needed = max(-(-index.n_docs // TILE_DOCS), -(-index.postings.count() // TILE_POSTINGS))
    n_docs = max(1, needed, min(cores, -(-index.n_docs // 1024)))
    n_queries = max(1, -(-terms.count() // TILE_TERMS))
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
    left, held = _packs(postings, bucket(deal, n_docs))
    right, asked = _packs(terms, bucket("query_id", n_queries))
    left = left.withColumn("part", every(n_queries))
    right = right.withColumnRenamed("tile", "part").withColumn("tile", every(n_docs))
    # more partitions than tiles, so that a task sorts few of them whatever the number of shuffle partitions is
    dealt = lambda rows: rows.repartition(2 * n_docs * n_queries, "tile", "part").groupBy("tile", "part")
    both = lambda p, a: run(_unpacked(p, held), _unpacked(a, asked))
    return dealt(left).cogroup(dealt(right)).applyInArrow(both, schema)


def coded(postings: pa.Table, asked: pa.Table) -> tuple:
    """Of a tile: the postings of asked terms in the order of the terms with their codes, documents in the order of their ids with
    their ranks, and the queries with (codes of terms, idf by code)."""
    vocabulary = asked.column("term").combine_chunks().unique()  # empty if the other side alone has the tile
    code = pc.index_in(postings.column("term"), value_set=vocabulary)
    known = pc.is_valid(code)
    postings, code = postings.filter(known), code.filter(known).to_numpy().astype(np.int64)
    ids = postings.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(ids.dictionary, null_placement="at_start")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    by = np.argsort(code, kind="stable")
    postings, code, doc = postings.take(pa.array(by)), code[by], rank[ids.indices.to_numpy(zero_copy_only=False)][by]
    queries = asked.column("query_id").combine_chunks().dictionary_encode()
    owner, own = queries.indices.to_numpy(zero_copy_only=False), pc.index_in(asked.column("term"), value_set=vocabulary).to_numpy()
    idf = np.zeros(len(vocabulary))
    idf[own] = asked.column("idf").to_numpy()
    by = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[by], np.arange(len(queries.dictionary) + 1))
    terms = [own[by[cut[q] : cut[q + 1]]] for q in range(len(cut) - 1)]
    needed = asked.column("n_terms").to_numpy()[by[cut[:-1]]] if "n_terms" in asked.column_names else None
    return postings, code, doc, ids.dictionary.take(order), queries.dictionary, terms, needed, idf


def best_places(scores: np.ndarray, allowed: np.ndarray | None, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above zero, rounded; ties go to the smaller place."""
    if allowed is not None:
        scores = np.where(allowed, scores, 0.0)
    cut = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else 0.0
    near = np.flatnonzero((scores > 0) & (scores >= cut - 2 * 10.0**-SCORE_DIGITS))
    return near[np.lexsort((near, -np.round(scores[near], SCORE_DIGITS)))][:k]


def found_rows(found: list[tuple], queries: pa.Array, ids: pa.Array) -> pa.Table:
    """(query_id, id, score) from (query, places, scores)."""
    own = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
    places, scores = (np.concatenate([np.empty(0), *(f[k] for f in found)]) for k in (1, 2))
    return pa.table({"query_id": queries.take(pa.array(own)), "id": ids.take(pa.array(places.astype(np.int64))), "score": scores})


def found_schema(index: Index, terms: DataFrame) -> StructType:
    return StructType([terms.schema["query_id"], index.postings.schema["id"], StructField("score", DoubleType())])


def bm25_search(index: Index, queries: DataFrame, k: int, match: str = "all") -> DataFrame:
    """(query_id, id, score, rank): the first ``k`` documents with "all" or "any" terms of each query, the rows of
    ``top_k(bm25_scores(…))``. Hits are summed up in tiles, and only ``k`` of each query leave a tile."""
    terms = asked_terms(index, queries)
    weighed = asked_postings(index.postings, terms).select("term", "id", saturation(index.avg_len).alias("part_score"))

    def run(postings: pa.Table, asked: pa.Table) -> pa.Table:
        postings, code, doc, ids, names, own, needed, idf = coded(postings, asked)
        weight = idf[code] * postings.column("part_score").to_numpy()
        at = np.searchsorted(code, np.arange(len(idf) + 1))
        found = []
        for q, codes in enumerate(own):
            if not len(ids) or (match == "all" and len(codes) < needed[q]):
                continue
            spans = [slice(at[c], at[c + 1]) for c in codes if at[c] < at[c + 1]]
            if not spans or (match == "all" and len(spans) < needed[q]):
                continue
            held = np.concatenate([doc[s] for s in spans])
            scores = np.bincount(held, weights=np.concatenate([weight[s] for s in spans]), minlength=len(ids))
            whole = np.bincount(held, minlength=len(ids)) == needed[q] if match == "all" else None
            places = best_places(scores, whole, k)
            if len(places):
                found.append((q, places, scores[places]))
        return found_rows(found, names, ids)

    best = in_tiles(index, weighed, terms, run, found_schema(index, terms))
    return top_k(best.withColumn("score", F.round("score", SCORE_DIGITS)), k)
