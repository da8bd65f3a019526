"""Registered retrieval queries and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.operators.fold import consolidate
from fundlens.operators.skew import BROADCAST_ROWS
from fundlens.plans import views
from fundlens.plans.oracle_views import ORDER, ORGANIZATIONS, PROJECTS, SCORED
from fundlens.plans.views import table
from fundlens.session import materialize, run_dir, spread
from fundlens.text import cells, chat, chunks, clauses, documents, hybrid, late, lexical, pruned, vectors, word_vectors
from fundlens.text.tokens import STOP_WORDS, stem_words, words


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = views.store(spark, sf_dir)
    scored = store.projects.select("*", *views.scored_columns())
    return documents.build_documents(scored, store)


DOCUMENT_LISTS = {
    "organizations": {
        c: f"list_{c}" for c in ("name", "city", "country", "activityType", "ecContribution", "SME")
    },
    "reports": {"title": "list_title_report"},
}


def wide_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents from list columns, looked up by position."""
    store = views.store(spark, sf_dir)
    scored = store.replace(projects=store.projects.select("*", *views.scored_columns()))
    return documents.wide_documents(consolidate(scored, lists=DOCUMENT_LISTS))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_counts(_docs(spark, sf_dir), stemmed=False)


def postings_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_counts(_docs(spark, sf_dir), stemmed=True)


def bm25_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_docs(spark, sf_dir), stemmed=False)
    return lexical.bm25_search(index, _user_turns(spark, sf_dir), 5, match="any")


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_docs(spark, sf_dir), stemmed=False)
    return lexical.bm25_search(index, _passages(spark, sf_dir), 5, match="all")


def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_docs(spark, sf_dir), stemmed=True)
    return lexical.bm25_search(index, _passages(spark, sf_dir), 5, match="any")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector (itself included)."""
    vecs = _vectors(spark, sf_dir)
    return vectors.vector_search(vecs, vecs.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 5)


def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bm25_topk``, from the blocks that can hold them."""
    index = lexical.build_index(_docs(spark, sf_dir), stemmed=False)
    return pruned.pruned_search(pruned.build_blocks(index), _user_turns(spark, sf_dir), 5)


def bm25_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bm25_all_terms``, from postings in buckets."""
    index = lexical.build_index(_docs(spark, sf_dir), stemmed=False)
    name, buckets = f"index_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = lexical.save_bucketed(index, f"{run_dir(spark)}/{name}", name, buckets)
    return lexical.bm25_search(held, _passages(spark, sf_dir), 5, match="all")


def clause_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as clauses: a phrase, optional words, an optional prefix, an excluded phrase."""
    words_of = _passages(spark, sf_dir).select("query_id", words("text").alias("w"))
    word = lambda k: F.get("w", F.lit(k - 1))
    row = lambda n, kind, form, text: F.struct(F.lit(n).alias("clause"), F.lit(kind).alias("kind"), F.lit(form).alias("form"), text.alias("text"))
    asked = words_of.filter(F.size("w") >= 6).select("query_id", F.inline(F.array(
        row(1, "must", "phrase", F.concat_ws(" ", word(2), word(3))),
        row(2, "should", "words", F.concat_ws(" ", word(5), word(6))),
        row(3, "should", "prefix", F.left(word(1), F.lit(3))),
        row(4, "must_not", "phrase", F.concat_ws(" ", word(3), word(2))),
    )))
    return clauses.clause_search(clauses.build_positions(_docs(spark, sf_dir)), asked, 5)


def _probing(vecs: DataFrame) -> DataFrame:
    """The query set: every vector whose id is divisible by 50."""
    some = vecs.filter(F.col("id") % 50 == 0)
    return some.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors in the cells that each query visits."""
    vecs = _vectors(spark, sf_dir)
    return cells.cell_search(cells.build_cells(vecs, k=5), _probing(vecs), 5)


def vector_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cell search finds nine of ten of the exact neighbours, over all vectors."""
    vecs = _vectors(spark, sf_dir)
    found = cells.recall(vector_topk_cells(spark, sf_dir), vectors.vector_search(vecs, _probing(vecs), 5))
    enough = (10 * F.col("n_found") >= 9 * F.col("n_neighbours")).alias("recall_reached")
    return found.select("n_queries", "n_neighbours", enough)


def cooccurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the 200 most frequent words stand near each word."""
    docs = _docs(spark, sf_dir)
    contexts = materialize(word_vectors.frequent_contexts(docs, 200))
    counts = word_vectors.cooccurrences(docs, contexts)
    return counts.join(F.broadcast(contexts), "column").select("term", "context", "n")


def learned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages against all documents by vectors of words that are trained on the documents."""
    docs = _docs(spark, sf_dir)
    trained = word_vectors.train(docs)
    probes = word_vectors.text_vectors(_passages(spark, sf_dir), trained, "query_id", out="vector").withColumnRenamed("id", "query_id")
    return vectors.vector_search(word_vectors.text_vectors(docs, trained), probes, 5)


def late_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lexical hits of each passage, ranked again by their words' best matches, best three."""
    docs, queries = _docs(spark, sf_dir), _passages(spark, sf_dir)
    hits = lexical.bm25_search(lexical.build_index(docs, stemmed=False), queries, 10, match="any")
    return lexical.top_k(late.late_scores(hits, queries, docs, word_vectors.train(docs)), 3)


def _hybrid(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Passages against all documents, by words and by the vectors of their texts."""
    docs, queries = _docs(spark, sf_dir), _passages(spark, sf_dir)
    found = lexical.bm25_search(lexical.build_index(docs, stemmed=False), queries, k, match="any")
    probes = vectors.embed_texts(queries, "text", "vector").select("query_id", "vector")
    near = vectors.vector_search(vectors.embed_texts(docs), probes, k)
    return hybrid.hybrid_search(found, near, k)


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero entries of the vectors of all documents."""
    embedded = vectors.embed_texts(_docs(spark, sf_dir)).select("id", F.posexplode("embedding").alias("bucket", "value"))
    value = F.round(F.col("value").cast("double"), 5)
    return embedded.filter("value > 0").select("id", F.col("bucket").cast("long").alias("bucket"), value.alias("value"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 4)


def drop_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest neighbours of every vector, without near-duplicates."""
    vecs = _vectors(spark, sf_dir)
    probes = vecs.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    near = vectors.vector_search(vecs, probes, hybrid.DEPTH).join(vecs, "id")
    return hybrid.drop_redundant(near, REDUNDANT_HERE).select("query_id", "id", "rank")


REDUNDANT_HERE = 0.3


def rerank_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest by distance, ranked again by cosine, best three."""
    vecs = _vectors(spark, sf_dir)
    probes = vecs.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    near = vectors.vector_search(vecs, probes, 10).select("query_id", "id").join(vecs, "id").join(probes, "query_id")
    best = hybrid.rerank(near, hybrid.cosine_scorer(), 3)
    return best.select("query_id", "id", "score", "rank")


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(_docs(spark, sf_dir))


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_fixed(_docs(spark, sf_dir))


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash vectors of all chunks, as (id, chunk_no, non-zero entries)."""
    embedded = vectors.embed_texts(chunks.chunk(_docs(spark, sf_dir)), "chunk")
    used = F.size(F.filter("embedding", lambda x: x != 0))
    return embedded.select("id", "chunk_no", used.alias("used"))


def _hit(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows whose ids a search has found: filtered where they lie, all of them if there are too many ids to send."""
    ids = materialize(hits.select("id").distinct())
    return rows.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= BROADCAST_ROWS else rows


def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole question path: chunks and documents, both searches, re-rank, redundancy, prompt."""
    docs, questions = _docs(spark, sf_dir), _user_turns(spark, sf_dir)
    pieces = chunks.chunk(docs).select(F.concat_ws("/", "id", "chunk_no").alias("id"), F.col("chunk").alias("text"))
    probes = vectors.embed_texts(questions, "text", "vector").select("query_id", "vector")
    dense = materialize(vectors.vector_search(vectors.embed_texts(pieces), probes, hybrid.DEPTH).select("query_id", "id"))
    found = materialize(lexical.bm25_search(lexical.build_index(docs), questions, hybrid.DEPTH, match="any").select("query_id", "id"))
    hits = (
        dense.join(vectors.embed_texts(_hit(pieces, dense)), "id").withColumn("id", F.substring_index("id", "/", 1).cast("long"))
        .unionByName(found.join(vectors.embed_texts(_hit(docs, found)), "id"))
        .join(probes, "query_id")
    )
    best = hybrid.rerank(hits, hybrid.cosine_scorer(), hybrid.DEPTH)
    # both uses below read the stored hits, so that the searches run once
    final = materialize(hybrid.drop_redundant(best.select("query_id", "id", "rank", "text", "embedding")))
    prompts = hybrid.build_prompts(questions, final)
    return prompts.join(hybrid.source_ids(questions, final), "query_id")


def chat_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exchanges of memory before each message."""
    windowed = chat.chat_window(table(spark, sf_dir, "conversations"), k=2)
    line = lambda m: F.concat(m["role"], F.lit(": "), m["text"])
    return windowed.select(
        "conv_id", "turn", F.array_join(F.transform("history", line), "\n").alias("history"),
        F.size("history").alias("n"),
    )


def _top_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = lexical.bm25_search(lexical.build_index(docs, stemmed=False), _passages(spark, sf_dir), 2)
    return found.join(docs, "id")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.build_prompts(_passages(spark, sf_dir), _top_docs(spark, sf_dir))


def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.source_ids(_passages(spark, sf_dir), _top_docs(spark, sf_dir))


def vocabulary_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = lexical.term_counts(_docs(spark, sf_dir), stemmed=False).select("term").distinct()
    return terms.select("term", stem_words("term").alias("stem"))


def normalized_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _user_turns(spark, sf_dir)
    return turns.select("query_id", vectors.normalized_query("text").alias("question"))


def text_queries() -> dict:
    return {
        "project_documents": project_documents,
        "wide_documents": wide_documents,
        "chunk_fixed": chunk_fixed,
        "chunk_recursive": chunk_recursive,
        "postings": postings,
        "postings_stemmed": postings_stemmed,
        "vocabulary_stems": vocabulary_stems,
        "bm25_topk": bm25_any,
        "bm25_all_terms": bm25_all,
        "bm25_stemmed": bm25_stemmed,
        "bm25_pruned": bm25_pruned,
        "bm25_bucketed": bm25_bucketed,
        "clause_topk": clause_topk,
        "cooccurrence_counts": cooccurrence_counts,
        "learned_topk": learned_topk,
        "late_topk": late_topk,
        "vector_topk_cells": vector_topk_cells,
        "vector_cells_recall": vector_cells_recall,
        "text_vectors": text_vectors,
        "document_vectors": document_vectors,
        "normalized_questions": normalized_questions,
        "vector_topk": vector_topk,
        "hybrid_topk": hybrid_topk,
        "rerank_cosine": rerank_cosine,
        "drop_redundant": drop_redundant,
        "chat_window": chat_window,
        "prompts": prompts,
        "source_ids": source_ids,
        "answer_prompts": answer_prompts,
    }


_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_WORD = r"[\p{L}\p{N}_]+(?:\.?[\p{L}\p{N}_]+)*"


def _tokens(name: str, source: str) -> str:
    return (
        f"{name} AS (SELECT id, term FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term "
        f"FROM {source}) WHERE length(term)>=2 AND term NOT IN {_STOP})"
    )


def _unit_vectors(name: str, source: str) -> str:
    """Non-zero entries (id, bucket, v) of word-hash vectors of length one."""
    return (
        _tokens(f"{name}_t", f"(SELECT id, lower(trim(text, ' ')) AS text FROM {source})")
        + f", {name}_n AS (SELECT id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS bucket, count(*)::DOUBLE AS n "
        f"FROM {name}_t GROUP BY 1,2), {name} AS (SELECT id, bucket, "
        f"(n/sqrt(sum(n*n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v FROM {name}_n)"
    )


_POSTINGS = (
    _tokens("tok", "(SELECT doc_id AS id, text FROM documents)")
    + ", dl AS (SELECT id, count(*) AS doc_len FROM tok GROUP BY 1)"
    + ", post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1,2)"
)
_PASSAGES = "SELECT item_id AS id, text FROM benchmark"
_TURNS = "SELECT conv_id || '/' || turn AS id, text FROM conversations WHERE role='user'"


def _scores(queries: str) -> str:
    return (
        "WITH "
        + _POSTINGS
        + ", "
        + _tokens("qt0", f"({queries})")
        + """, qt AS (SELECT DISTINCT id AS query_id, term FROM qt0),
nt AS (SELECT query_id, count(*) AS needed FROM qt GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM tok)/(SELECT count(*) FROM documents)::DOUBLE AS a),
df AS (SELECT term, ln(n/(count(*)+1))+1 AS idf FROM post, tot GROUP BY term, n),
sc AS (SELECT qt.query_id, post.id, count(*) AS matched,
    round(sum(idf*(tf*2.2)/(tf+1.2*(0.25+0.75*doc_len/a))), 6) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl ON dl.id=post.id, tot GROUP BY 1,2)"""
    )


def _ranked(source: str, k: int, order: str = "score DESC") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rank "
        f"FROM ({source})) WHERE rank<={k}"
    )


_L2 = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE-x[2]::DOUBLE)*(x[1]::DOUBLE-x[2]::DOUBLE))), 6)"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_NEAR = f"SELECT a.vec_id AS query_id, b.vec_id AS id, {_L2} AS distance FROM embeddings a, embeddings b"
_ALL_TERMS = "SELECT query_id, id, score FROM sc JOIN nt USING (query_id) WHERE matched=needed"


def _fixed(x: str, digits: int) -> str:
    scale = 10**digits
    return f"printf('%.{digits}f', round_even(({x})*{scale}, 0)/{scale})"


def _documents() -> str:
    shown = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'None')"
    feats = " || ', ' || ".join(
        f"{shown(f'top{i}_feature')} || ' (' || {_fixed(f'top{i}_shap::DOUBLE', 3)} || ')'" for i in (1, 2, 3)
    )
    line = (
        f"'- ' || {shown('name')} || ' in ' || {shown('city')} || ', ' || {shown('country')} || ', activity: ' || "
        f"{shown('activityType')} || ', contributed: ' || {shown('ecContribution')} || ', ' || "
        "CASE WHEN SME THEN 'SME' ELSE 'non-SME' END || '.'"
    )
    prob = "CASE WHEN predicted_label=1 THEN predicted_prob::DOUBLE ELSE 1-predicted_prob::DOUBLE END"
    return (
        "WITH "
        + ",".join([PROJECTS, SCORED, ORGANIZATIONS])
        + f""", o AS (SELECT projectID, string_agg({line}, ' ' ORDER BY {ORDER}) AS lines FROM organizations GROUP BY 1),
r AS (SELECT l_orderkey, '[' || string_agg('''Report ' || l_suppkey || '''', ', ' ORDER BY {ORDER}) || ']' AS titles
  FROM lineitem GROUP BY 1)
SELECT id, 0 AS part, concat_ws(' ',
  'This project under framework ' || {shown('frameworkProgramme')} || ' with funding scheme ' || {shown('fundingScheme')}
  || ', status ' || {shown('status')} || ', legal basis ' || {shown('legalBasis')} || '.',
  'It ends on ' || {shown('endDate')} || ' after ' || {shown("datediff('day', startDate, endDate)")}
  || ' days and has a max EC contribution of ' || {shown('ecMaxContribution')} || '.',
  'Participating organizations:', lines,
  CASE WHEN status IS NULL OR status='SIGNED' THEN '- Project ' || id || ' is predicted to be ' ||
    CASE WHEN predicted_label=1 THEN 'TERMINATED' ELSE 'CLOSED' END || ' (score=' || {_fixed(prob, 2)} ||
    '). The 3 most predictive features were: ' || {feats} || '.' END,
  coalesce(titles, 'None'), objective) AS text,
  {shown('startDate')} AS startDate, {shown('endDate')} AS endDate, {shown('status')} AS status,
  {shown('legalBasis')} AS legalBasis
FROM scored LEFT JOIN o ON projectID=id LEFT JOIN r ON l_orderkey=id"""
    )


def _kept(text: str) -> str:
    """The index words of a text as a list."""
    return f"list_filter(regexp_extract_all(lower({text}), '{_WORD}'), lambda x: length(x) >= 2 AND x NOT IN {_STOP})"


def _clauses() -> str:
    return (
        f"""WITH lists AS (SELECT doc_id AS id, {_kept("text")} AS w FROM documents),
tok AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM lists),
dl AS (SELECT id, count(*) AS doc_len FROM tok GROUP BY 1), post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
tot AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM tok)/(SELECT count(*) FROM documents)::DOUBLE AS a),
df AS (SELECT term, ln(n/(count(*)+1))+1 AS idf FROM post, tot GROUP BY term, n),
pw AS (SELECT id, term, idf*(tf*2.2)/(tf+1.2*(0.25+0.75*doc_len/a)) AS v FROM post JOIN df USING (term) JOIN dl USING (id), tot),
q AS (SELECT item_id AS q, {_kept("text")} AS w FROM benchmark), asked AS (SELECT * FROM q WHERE len(w) >= 6),
must AS (SELECT DISTINCT q, x.id FROM asked JOIN tok x ON x.term = w[2] JOIN tok y ON y.id = x.id AND y.pos = x.pos + 1 AND y.term = w[3]),
nots AS (SELECT DISTINCT q, x.id FROM asked JOIN tok x ON x.term = w[3] JOIN tok y ON y.id = x.id AND y.pos = x.pos + 1 AND y.term = w[2]),
prefixed AS (SELECT DISTINCT q, id FROM asked JOIN post ON starts_with(term, left(w[1], 3))),
found AS (SELECT must.q, must.id, a.v + b.v
    + CASE WHEN c.v IS NOT NULL AND d.v IS NOT NULL THEN c.v + CASE WHEN w[5] = w[6] THEN 0 ELSE d.v END ELSE 0 END
    + CASE WHEN p.id IS NOT NULL THEN 1 ELSE 0 END AS s
  FROM must JOIN asked ON asked.q = must.q
    JOIN pw a ON a.id = must.id AND a.term = w[2] JOIN pw b ON b.id = must.id AND b.term = w[3]
    LEFT JOIN pw c ON c.id = must.id AND c.term = w[5] LEFT JOIN pw d ON d.id = must.id AND d.term = w[6]
    LEFT JOIN prefixed p ON p.q = must.q AND p.id = must.id LEFT JOIN nots n ON n.q = must.q AND n.id = must.id
  WHERE n.id IS NULL)
"""
        + _ranked("SELECT q AS query_id, id, round(s, 6) AS score FROM found", 5)
    )


def text_oracles() -> dict[str, str]:
    doc_top = _scores(_PASSAGES) + f", top AS ({_ranked(_ALL_TERMS, 2)})"
    role = hybrid.ROLE
    return {
        "project_documents": _documents(),
        "wide_documents": _documents(),
        "chunk_fixed": """
WITH s AS (SELECT doc_id AS id, text, unnest(range(0, CAST(floor(greatest(length(text)-101, 0)/650) AS BIGINT)+1)) AS chunk_no FROM documents)
SELECT id, chunk_no, substr(text, chunk_no*650+1, 750) AS chunk FROM s""",
        "postings": "WITH " + _POSTINGS + " SELECT id, doc_len, term, tf FROM post JOIN dl USING (id)",
        "bm25_topk": _scores(_TURNS) + " " + _ranked("SELECT query_id, id, score FROM sc", 5),
        "bm25_all_terms": _scores(_PASSAGES) + " " + _ranked(_ALL_TERMS, 5),
        "bm25_pruned": _scores(_TURNS) + " " + _ranked("SELECT query_id, id, score FROM sc", 5),
        "bm25_bucketed": _scores(_PASSAGES) + " " + _ranked(_ALL_TERMS, 5),
        "clause_topk": _clauses(),
        "cooccurrence_counts": f"""WITH lists AS (SELECT doc_id AS id, {_kept("text")} AS w FROM documents),
tok AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM lists),
ctx AS (SELECT term, count(*) AS n FROM tok GROUP BY 1 ORDER BY n DESC, term LIMIT 200),
near AS (SELECT a.term, b.term AS context FROM (SELECT *, unnest(range(1, 5)) AS d FROM tok) a JOIN tok b ON b.id = a.id AND b.pos = a.pos + a.d
  UNION ALL SELECT a.term, b.term FROM (SELECT *, unnest(range(1, 5)) AS d FROM tok) a JOIN tok b ON b.id = a.id AND b.pos = a.pos - a.d)
SELECT term, context, count(*) AS n FROM near WHERE context IN (SELECT term FROM ctx) GROUP BY 1, 2""",
        "vector_cells_recall": """
SELECT count(*) AS n_queries, count(*) * least(5, (SELECT count(*) FROM embeddings)) AS n_neighbours, TRUE AS recall_reached
FROM embeddings WHERE vec_id % 50 = 0""",
        "normalized_questions": f"SELECT id AS query_id, lower(trim(text, ' ')) AS question FROM ({_TURNS})",
        "vector_topk": _ranked(_NEAR, 5, "distance"),
        "hybrid_topk": _scores(_PASSAGES)
        + f""", lex AS ({_ranked("SELECT query_id, id, score FROM sc", 4)}),
{_unit_vectors("dv", "(SELECT doc_id AS id, text FROM documents)")}, {_unit_vectors("qv", "(SELECT item_id AS id, text FROM benchmark)")},
dot AS (SELECT qv.id AS query_id, dv.id, sum(qv.v*dv.v) AS s FROM qv JOIN dv USING (bucket) GROUP BY 1,2),
apart AS (SELECT q.item_id AS query_id, d.doc_id AS id, round(greatest(coalesce((SELECT sum(v*v) FROM qv WHERE qv.id=q.item_id), 0)
  + coalesce(n.s, 0) - 2*coalesce(dot.s, 0), 0), 6) AS distance
  FROM benchmark q CROSS JOIN documents d LEFT JOIN dot ON dot.query_id=q.item_id AND dot.id=d.doc_id
  LEFT JOIN (SELECT id, sum(v*v) AS s FROM dv GROUP BY 1) n ON n.id=d.doc_id),
den AS ({_ranked("SELECT * FROM apart", 4, "distance")}),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE/(60+rank)), 9) AS score FROM
  (SELECT query_id, id, rank FROM lex UNION ALL SELECT query_id, id, rank FROM den) GROUP BY 1,2)
"""
        + _ranked("SELECT * FROM f", 4),
        "document_vectors": "WITH " + _unit_vectors("dv", "(SELECT doc_id AS id, text FROM documents)")
        + " SELECT id, bucket, round(v, 5) AS value FROM dv",
        "rerank_cosine": f"""
WITH near AS ({_ranked(_NEAR, 10, "distance")})
"""
        + _ranked(
            f"SELECT query_id, id, round({_COS}, 6) AS score FROM near JOIN embeddings a ON a.vec_id=query_id "
            "JOIN embeddings b ON b.vec_id=id",
            3,
        ),
        "drop_redundant": f"""
WITH near AS ({_ranked(_NEAR, 2, "distance")}),
pair AS (SELECT x.query_id, round({_COS}, 9) AS alike FROM near x JOIN near y ON x.query_id=y.query_id AND x.rank=1 AND y.rank=2
  JOIN embeddings a ON a.vec_id=x.id JOIN embeddings b ON b.vec_id=y.id)
SELECT query_id, id, rank FROM near LEFT JOIN pair USING (query_id) WHERE NOT (rank=1 AND coalesce(alike, 0)>{REDUNDANT_HERE})""",
        "chat_window": """
WITH c AS (SELECT * FROM conversations WHERE role IN ('user','assistant')),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c)
SELECT a.conv_id, a.turn, coalesce(string_agg(b.role || ': ' || b.text, chr(10) ORDER BY b.turn), '') AS history, count(b.turn) AS n
FROM r a LEFT JOIN r b ON a.conv_id=b.conv_id AND b.n BETWEEN a.n-4 AND a.n-1 GROUP BY 1,2""",
        "prompts": doc_top
        + f""", ctx AS (SELECT query_id, string_agg(text, chr(10)||chr(10) ORDER BY rank) AS context
  FROM top JOIN documents ON doc_id=id GROUP BY 1)
SELECT item_id AS query_id, concat('{role}', chr(10), coalesce(context, ''), chr(10), 'User Question:', chr(10), text, chr(10), 'Answer:') AS prompt
FROM benchmark LEFT JOIN ctx ON query_id=item_id""",
        "source_ids": doc_top
        + """, ids AS (SELECT query_id, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY rank) AS sources FROM top GROUP BY 1)
SELECT item_id AS query_id, coalesce(sources, 'none') AS sources FROM benchmark LEFT JOIN ids ON query_id=item_id""",
    }
