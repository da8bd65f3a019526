"""License and secret scans and the multiset hash against brute force, odd rows, native plans."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fundlens.llm import license_scan, multiset_hash, queries, secret_scan
from tests.helpers import plan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def native(df):
    return not re.search("EvalPython|MapIn|InPandas|InArrow|PythonUDF", plan(df))


def line(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_base(words):
    found = []
    for phrase, label in license_scan.BASE.items():
        own = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(own)] == own]
    places = [k for k, _ in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def brute_spans(words):
    """Every rule at every word, then suppression, in plain Python."""
    text, hits = " ".join(words) + " ", []
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    if not re.search(license_scan.GATE, f" {text}"):
        return []
    for keyword, label, pattern, rank, _ in license_scan.rules():
        if f" {keyword} " not in f" {text}":
            continue
        for k in range(len(words)):
            m = re.compile(f"{pattern} ").match(text, starts[k])
            if m:
                hits.append((k, k + m[0].count(" "), label, rank))
    def beaten(h):
        return any(
            g[0] <= h[0] and g[1] >= h[1] and (g[3] > h[3] or (g[3] == h[3] and g[1] - g[0] > h[1] - h[0])) for g in hits
        )
    return sorted(h for h in hits if not beaten(h))


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "MIT License mit license MIT, license! The MIT License",
    "under the GNU General Public License, version 3. general public license",
    "Licensed under CC BY-NC 4.0. SPDX-License-Identifier: BSD-3-Clause",
    "apache general mit license public license",
    "Redistribution and use in source and binary forms, with or without modification; all rights reserved. Copyright (c) 2020",
    "das mit dem apache",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit",
    "license",
]


def test_rules_are_many_and_ordered():
    rules = license_scan.rules()
    assert len(rules) >= 300
    assert [r[3] for r in rules] == sorted((r[3] for r in rules), reverse=True)


def test_license_scan(make_docs, odd_rows):
    rng = random.Random(2)
    vocabulary = "mit license apache general public gnu gpl version 2 0 3 bsd licensed under the cc by nc 4 x ß".split()
    texts = TEXTS + [" ".join(rng.choices(vocabulary, k=30)) for _ in range(40)] + ["mit license " * 300]
    rows = [(k, t) for k, t in enumerate(texts, 100)] + [r[:2] for r in odd_rows]
    docs = make_docs(rows).withColumns({"scan": F.lit("own"), "line": F.lit(1), "hits": F.lit(2)})
    out = license_scan.scanned(docs)
    assert native(out)
    got = out.toDF(*docs.columns, "s").collect()
    assert len(got) == len(rows)
    for r in got:
        words = line(r.text)
        assert (r.s.n_words, r.s.n_base, r.s.first_word, r.s.last_word, r.s.base_labels) == brute_base(words)
        assert 0 <= r.s.score <= 1
        spans = sorted((x.start, x.end, x.label, x.rank) for x in r.s.spans)
        if len(words) < 200:
            assert spans == brute_spans(words)
        assert set(filter(None, r.s.labels.split(","))) == set(filter(None, r.s.base_labels.split(","))) | {x[2] for x in spans}
    assert license_scan.scanned(make_docs([])).count() == 0


def test_license_spans_across_pieces(make_docs):
    """Texts of many pieces: every interval of the brute force, borders and margins included."""
    rng = random.Random(9)
    vocabulary = "mit license the gnu general public version v3 3 0 gplv3 licensed under spdx identifier bsd 2 clause x".split()
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (127, 128, 129, 256, 500)]
    phrase = "licensed under the terms of the gnu general public license version 3 0"
    texts += [" ".join(["x"] * n + [phrase] + ["x"] * 90) for n in range(100, 136, 5)]
    got = {r.doc_id: r.scan.spans for r in license_scan.scanned(make_docs(list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        assert sorted((x.start, x.end, x.label, x.rank) for x in got[k]) == brute_spans(line(text))


def test_license_scan_of_a_megabyte(make_docs):
    """Work grows in proportion to the text: a megabyte of repeated phrases ends within seconds."""
    one = "this is under mit license version 2.0 "
    r = license_scan.scanned(make_docs([(1, one * 27_000)])).head().scan
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (8 * 27_000, 27_000, 3, 8 * 26_999 + 3)
    assert [(x.start, x.end) for x in r.spans] == [(8 * k + 3, 8 * k + 5) for k in range(27_000)]


def test_license_versions_written_with_v(make_docs):
    stated = {
        "GNU GPLv3": "gpl-3", "GPLv2 or later": "gpl-2", "GNU General Public License v3": "gpl,gpl-3", "GPL v2": "gpl-2",
        "LGPLv3": "lgpl-3", "Apache License v2.0": "apache,apache-2.0", "Mozilla Public License, v. 2.0": "mpl-2.0",
    }
    got = {r.doc_id: r.scan.labels for r in license_scan.scanned(make_docs(list(enumerate(stated)))).collect()}
    assert [got[k] for k in range(len(stated))] == list(stated.values())


def test_license_labels(make_docs):
    got = {r.doc_id: r.scan.labels for r in license_scan.scanned(make_docs(list(enumerate(TEXTS)))).collect()}
    assert got[0] == "apache,apache-2.0" and got[2] == "gpl,gpl-3" and got[6] == ""
    assert set(got[3].split(",")) == {"cc-by-nc-4.0", "bsd-3.clause"}


def test_every_rule_runs_where_its_words_stand(make_docs):
    """Statements and names without the word license; no gate leaves a rule out."""
    stated = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "Permission to use, copy, modify, and distribute this software for any purpose": "isc",
        "All rights reserved.": "proprietary",
        "under the terms of the": "terms",
        "released under MIT": "mit",
        "released under Apache 2.0": "apache,apache-2.0",
        "distributed under MPL 2.0": "mpl,mpl-2.0",
        "BSD 3-clause": "bsd-3.clause",
        "CC0 1.0": "cc0-1.0",
        "QPL Public 1.0": "qpl-1.0",
    }
    rows = license_scan.scanned(make_docs(list(enumerate(stated)))).collect()
    assert {r.text: r.scan.labels for r in rows} == stated
    assert all(r.scan.score > 0 for r in rows)


def test_secret_scan_held_out(spark):
    words = ["the", "and", "example"]
    findings = secret_scan.labelled_findings(spark, 800).withColumn("h", F.pmod(F.xxhash64("candidate", "before"), F.lit(4)))
    model = secret_scan.fit_forest(findings.filter("h > 0"), words, trees=20)
    rows = model.transform(secret_scan.features(findings.filter("h = 0"), words)).select("label", "prediction").collect()
    assert sum(r.label == r.prediction for r in rows) / len(rows) >= 0.95


KEY = "AKIA" + "QWERTYUIOPASDF12"
SECRETS = [
    (1, 'and token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### end', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    (2, f"some words {KEY} here {KEY}", KEY),
    (3, "password=e3b3ed3cc8548923d6 la", "e3b3ed3cc8548923d6"),
    (4, "call +1 (499) 555-6503 or 4785380592391139 now", None),
    (5, "plain prose without any number", None),
    (6, "version 2024-01-12 commit id 8f14e45fceea167a5a36dedd4bea2543 build", None),
    (7, "api_key = your_api_key_here_123", None),
    (8, "login with password = hunter2, then go", "hunter2"),
    (9, "set pwd: S3c!r3t#9x now", "S3c!r3t#9x"),
    (10, "DB_PASSWORD='zorvelquat' la", "zorvelquat"),
    (11, "password: required and token: optional", None),
    (12, "the key = ${MY_SECRET} or password={{password}}", None),
    (13, "a pass: abc and the key: jurisdiction of courts", None),
]


@pytest.fixture(scope="module")
def scanned_secrets(make_docs, odd_rows):
    rows = [(d, t, "en", "s") for d, t, _ in SECRETS] + [(d and d + 100, t, x, s) for d, t, x, s in odd_rows]
    return make_docs(rows).withColumns({"found": F.lit("own"), "key": F.lit(1), "t": F.lit(2)})


def test_secret_scan(scanned_secrets):
    out = secret_scan.scan(scanned_secrets, "source")
    assert native(out)
    found = {(r.doc_id, r.candidate) for r in out.filter("is_secret").collect()}
    assert found == {(d, s) for d, _, s in SECRETS if s}
    places = {r.word_no for r in out.filter("doc_id = 2 and is_secret").collect()}
    assert places == {2, 4}


def test_assigned_values(make_docs):
    """The value behind a secret name, written in any of the ways, and nothing behind other names."""
    texts = [
        ("password = hunter2", ["hunter2"]), ("password=hunter2;", ["hunter2"]), ('"password": "hunter2",', ["hunter2"]),
        ("pwd => 'a!b@c#d$'", ["a!b@c#d$"]), ("db_pass:=hunter2).", ["hunter2"]), ("PASSWORD: hunterhunter", ["hunterhunter"]),
        ("key: hunterhunter", []), ("name = hunter2", []), ("compass = hunter2", []), ("password hunter2", []),
        ("password = ab1", []), ("password =", []), ("= hunter2", []), ("password = é!ü?öß", ["é!ü?öß"]),
        ("token = 0123456789abcdef0", ["0123456789abcdef0"]),
    ]
    rows = secret_scan.candidates(make_docs([(k, t) for k, (t, _) in enumerate(texts)])).collect()
    found = {k: sorted(r.candidate for r in rows if r.doc_id == k) for k in range(len(texts))}
    assert found == {k: own for k, (_, own) in enumerate(texts)}
    assert all(r.before.rstrip("\"' ")[-1] in "=:>" for r in rows)


def test_redaction_keeps_rows_and_columns(scanned_secrets):
    out = secret_scan.redacted(scanned_secrets, "source")
    assert out.columns == scanned_secrets.columns and out.count() == scanned_secrets.count()
    text = {r.doc_id: r.text for r in out.collect()}
    for d, t, s in SECRETS:
        assert text[d] == (t.replace(s, "[secret]") if s else t)


def test_secret_scan_of_an_empty_table(make_docs):
    assert secret_scan.scan(make_docs([])).count() == 0 and secret_scan.redacted(make_docs([])).count() == 0


def vectors(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return multiset_hash.fingerprints(rows)


def test_fingerprint_is_homomorphic(spark):
    rows = vectors(spark, ["One. Two!\nThree.", "Three.\nOne. Two!", "Three.", "One. Two!", "One. Two!\nThree.\nThree."])
    v = {r.k: r.vector for r in rows.collect()}
    assert v[0] == v[1] and v[0] != v[4] and v[2] != v[3]
    pair = rows.alias("a").join(rows.alias("b"), F.concat("a.k", F.lit("/"), "b.k").isin("2/3", "0/2", "4/2"))
    whole = pair.select("a.k", multiset_hash.combined(F.col("a.vector"), F.col("b.vector")).alias("sum"),
                        multiset_hash.combined(F.col("a.vector"), F.col("b.vector"), -1).alias("rest")).collect()
    own = {r.k: r for r in whole}
    assert own[2]["sum"] == v[0] and own[0]["sum"] == v[4] and own[4]["rest"] == v[0]


def test_fingerprint_of_any_order_insertion_and_deletion(spark):
    """Lines with indentation, tabs, carriage returns, blank lines and no or many sentence ends."""
    rng = random.Random(8)
    cases = []
    for _ in range(60):
        line = lambda: "".join(rng.choice(["a", "B c", ". ", ".", "!?", "  ", "\t", "\r", "é.", ""]) for _ in range(rng.randint(0, 6)))
        lines = [line() for _ in range(rng.randint(2, 6))]
        cut = rng.randint(1, len(lines) - 1)
        mixed = rng.sample(lines, len(lines))
        cases.append(tuple("\n".join(part) for part in (lines, mixed, mixed[:cut], mixed[cut:])))
    rows = spark.createDataFrame(cases, "whole string, mixed string, head string, tail string")
    v = rows.select(*(multiset_hash.vector(F.col(c)).alias(c) for c in rows.columns))
    made = v.select(
        "whole", "mixed", "head",
        multiset_hash.combined(F.col("head"), F.col("tail")).alias("inserted"),
        multiset_hash.combined(F.col("whole"), F.col("tail"), -1).alias("deleted"),
    ).collect()
    for case, r in zip(cases, made, strict=True):
        assert r.whole == r.mixed == r.inserted and r.head == r.deleted, case


def test_likeness_follows_shared_sentences(spark):
    rng = random.Random(4)
    sentences = [f"sentence {rng.random()}" for _ in range(300)]
    texts = ["\n".join(sentences[:200]), "\n".join(sentences[50:250]), "\n".join(sentences[200:]), "\n".join(sentences[:200][::-1])]
    rows = vectors(spark, texts)
    got = {
        r.k: r.near
        for r in rows.alias("b")
        .join(rows.filter("k = 0").alias("a"))
        .select("b.k", multiset_hash.likeness(F.col("a.vector"), F.col("b.vector")).alias("near"))
        .collect()
    }
    assert got[0] == got[3] == 1.0 and abs(got[1] - 0.75) < 0.2 and got[2] < 0.3


def brute_edits(rows):
    by_id: dict = {}
    for d, t in rows:
        by_id.setdefault(d, []).append(t or "")
    order = sorted((d for d in by_id if d is not None), reverse=True) + [None] * (None in by_id)
    after = {d: order[(k + 1) % len(order)] for k, d in enumerate(order)}
    return [(d, t or "", by_id[after[d]]) for d, t in rows]


def test_edits(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows] + [(20 + k, "Word number %d. Another one.\nLast é line." % k) for k in range(20)]
    out = multiset_hash.with_edits(make_docs(rows).withColumn("key", F.lit("own")))
    assert native(out)
    got = sorted((str(r.doc_id), r.text, r.n_chars, r.edited) for r in out.collect())
    want = []
    for d, text, nexts in brute_edits(rows):
        cut = len(text) // 3
        assert len(set(nexts)) == 1
        want.append((str(d), text, len(text), text[: len(text) - cut] + nexts[0][:cut]))
    assert got == sorted(want)


def test_edits_of_few_rows(make_docs):
    assert multiset_hash.with_edits(make_docs([])).count() == 0
    one = multiset_hash.with_edits(make_docs([(5, "abcdef")])).first()
    assert one.edited == "abcdab"


def test_fingerprint_query(spark, sf):
    rows = {r.doc_id: r for r in queries.op7_multiset_fingerprint(spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for d, text, nexts in brute_edits(docs):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nexts[0][:cut]
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[d].n_chars == len(text)
        assert 0 <= rows[d].near_next <= 1 and 0 <= rows[d].near_edited <= 1
    by_text: dict = {}
    for d, text in docs:
        by_text.setdefault(text, set()).add(rows[d].fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and len({f for s in by_text.values() for f in s}) == len(by_text)
