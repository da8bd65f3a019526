"""The pipeline on the small tables against its stages applied in plain Python."""

import hashlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fundlens.llm.queries import TOKENIZER
from fundlens.session import materialize
from tests.llm.test_classifiers import brute_counts
from tests.llm.test_simhash import brute, components


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, docs := materialize(stage(spark, docs, sf))))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_quality_stage_rejects_what_the_base_rule_rejects(stages):
    before, after = (df.collect() for df in stages[0])
    failed = {r.doc_id for r in before if brute_counts(r.text)[-1]}
    assert not failed & {r.doc_id for r in after}


def test_one_document_of_each_group_stays(stages):
    before, after = (df.collect() for df in stages[1])
    prints = {r.doc_id: brute(r.text) for r in before}
    head = components(sorted(set(prints.values())), 2)
    least: dict = {}
    for d, v in prints.items():
        least[head[v]] = min(d, least.get(head[v], d))
    assert sorted(r.doc_id for r in after) == sorted(least.values())


def test_secrets_are_masked_and_nothing_else(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[2])
    assert set(before) == set(after)
    for d, r in after.items():
        assert ("[secret]" in r.text) == (r.text != before[d].text) and r.n_chars == len(r.text)


def test_encoding_of_the_mix(stages):
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    mix, rows = stages[4]
    want = []
    for r in mix.collect():
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids, dtype="<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(want) == sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows.collect())


def test_run_equals_its_stages(spark, sf, stages):
    assert entry.queries()["pipeline"](spark, sf).exceptAll(stages[-1][1]).count() == 0


def test_odd_and_empty_tables(spark, sf, make_docs, odd_rows):
    long = [(d, None if t is None else t + " " + " ".join(f"w{d}x{k}" for k in range(60)), x, s) for d, t, x, s in odd_rows]
    for rows in (odd_rows + long, []):
        docs = make_docs(rows).withColumns({"mix": F.lit("own"), "ids": F.lit(1), "kept": F.lit(2)})
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf))
        assert (docs.count() > 0) == bool(rows)
