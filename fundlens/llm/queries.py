"""The registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fundlens.llm import (
    bpe, collocations, embedding_dedup, language_id, license_scan, lm_score, mixing, multiset_hash, quality, secret_scan,
    simhash, toxicity, word_runs,
)
from fundlens.llm.oracles import llm_oracles  # noqa: F401  registered beside the queries
from fundlens.llm.shared import documents, labels, remainder, words
from fundlens.session import ship_package

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_dedup(spark, sf_dir):
    rows = simhash.grouped(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secret_scan(spark, sf_dir):
    found = secret_scan.scan(documents(spark, sf_dir), "source")
    return found.select(
        "doc_id", "word_no", F.sha2("candidate", 256).alias("candidate_sha256"),
        F.length("candidate").cast("long").alias("n_chars"), "score", "is_secret",
    )


def op3_license_scan(spark, sf_dir):
    rows = license_scan.scanned(documents(spark, sf_dir).select("doc_id", "text"))
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return rows.select("doc_id", *(f"scan.{f}" for f in fields))


def op4_source_mix(spark, sf_dir):
    rows = mixing.mixed(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op5_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.fit_quality(docs, labels(spark, sf_dir))
    return quality.judged(docs.select("doc_id", "text"), "text", model).drop("text")


def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, labels(spark, sf_dir), remainder(F.col("doc_id"), 3) != 1)
    held_out = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    predicted = (F.col("score") >= toxicity.TOXIC_FROM).cast("int")
    return toxicity.scored(held_out, "text", model).withColumn("predicted", predicted).drop("text")


def op7_multiset_fingerprint(spark, sf_dir):
    rows = multiset_hash.with_edits(documents(spark, sf_dir))
    rows = multiset_hash.fingerprints(multiset_hash.fingerprints(rows), "edited", "edited_vector")
    vector, edited, after = F.col("vector"), F.col("edited_vector"), F.col("next_vector")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        multiset_hash.digest(vector).alias("fingerprint"),
        multiset_hash.digest(edited).alias("edited_fingerprint"),
        multiset_hash.likeness(vector, edited).alias("near_edited"),
        multiset_hash.likeness(vector, after).alias("near_next"),
        "next_id",
    )


def op8_lm_score(spark, sf_dir):
    rows = lm_score.scored(documents(spark, sf_dir), remainder(F.col("doc_id"), 7) != 2, TOKENIZER)
    held_out = (remainder(F.col("doc_id"), 7) == 2).alias("held_out")
    return rows.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score")


def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    contents = language_id.fit_dictionaries(docs, remainder(F.col("doc_id"), 5) != 0)
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    return language_id.predicted(rows, "text", contents).drop("text")


def bpe_digest(docs, *more):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ...) of documents."""
    rows = bpe.round_trip(docs.select("doc_id", "text"), TOKENIZER)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op10_bpe_roundtrip(spark, sf_dir):
    return bpe_digest(documents(spark, sf_dir))


def op11_phrase_collocations(spark, sf_dir):
    found = collocations.phrases(documents(spark, sf_dir), min_count=10, top=2000, share=50)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_embedding_dedup(spark, sf_dir):
    ship_package(spark)
    return embedding_dedup.grouped(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def with_repeats(docs):
    """(doc_id, text): documents whose id's crc32 is a multiple of ten repeat some of their words to the end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    due = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    n, g = F.size("w").cast("long"), F.expr("h div 10")
    sized = due.select("doc_id", "text", "w", n.alias("n"), g.alias("g"), F.when(n > 0, g % n).alias("start"))
    rest = F.col("n") - F.col("start")
    period = sized.withColumn("rest", rest).withColumn("period", F.lit(1) + F.expr("rest div (3 + g % 8)"))
    again = F.array_repeat(F.slice("w", F.col("start") + 1, F.col("period")), F.ceil(F.col("rest") / F.col("period")).cast("int"))
    edited = F.concat(F.slice("w", F.lit(1), F.col("start")), F.slice(F.flatten(again), F.lit(1), F.col("rest")))
    return period.select("doc_id", F.when(F.col("n") > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def runs_digest(rows):
    """Counts, greatest run and digests of rows with ``runs`` and ``collapsed``."""
    def better(best, run):
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    greatest = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    rows = rows.withColumn("greatest", greatest)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "greatest.start", "greatest.length", "greatest.period",
        F.expr("1000 * greatest.length div greatest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_word_runs(spark, sf_dir):
    return runs_digest(word_runs.with_runs(with_repeats(documents(spark, sf_dir))))


def llm_queries() -> dict:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_license_scan": op3_license_scan,
        "op4_source_mix": op4_source_mix,
        "op5_quality_rules": op5_quality_rules,
        "op6_toxicity": op6_toxicity,
        "op7_multiset_fingerprint": op7_multiset_fingerprint,
        "op8_lm_score": op8_lm_score,
        "op9_language_id": op9_language_id,
        "op10_bpe_roundtrip": op10_bpe_roundtrip,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_embedding_dedup": op12_embedding_dedup,
        "op13_word_runs": op13_word_runs,
    }
