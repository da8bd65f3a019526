"""Mixing: targets, quotas of the tree, permutations, and the rows of whole mixes."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.llm import mixing, queries


def test_targets_by_repeated_resharing():
    sizes = [10, 1000, 1000, 1, 0]
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    assert got[0] == 30 and got[3] == 3 and got[4] == 0
    assert got[1] / got[2] == pytest.approx(2)
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_is_a_bijection(n):
    factor, offset = mixing.permutation(3, 1, n)
    assert sorted((b * factor + offset) % n for b in range(n)) == list(range(n))


def test_tree_splits_exact_quotas():
    quotas, shards = np.array([37, 0, 100, 5]), 8
    source = np.repeat(np.arange(4), quotas)
    draw = np.concatenate([np.arange(q) for q in quotas])
    shard = mixing.Tree(quotas, shards).shard(source, draw)
    sizes = Counter(shard.tolist())
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 3
    for s in range(4):  # each shard reads one run of a source's draws
        assert (np.diff(shard[source == s]) >= 0).all()
    again = mixing.Tree(quotas, shards).shard(source[::-1], draw[::-1])
    assert (again[::-1] == shard).all()


def test_tree_remembers_few_nodes(monkeypatch):
    quotas = np.array([300, 200])
    source, draw = np.repeat([0, 1], quotas), np.concatenate([np.arange(300), np.arange(200)])
    whole = mixing.Tree(quotas, 64).shard(source, draw)
    monkeypatch.setattr(mixing, "TOP_NODES", 4)
    few = mixing.Tree(quotas, 64)
    assert (few.shard(source, draw) == whole).all() and len(few.nodes) < 4


@pytest.mark.parametrize("urn", [(7, 9, 6), (40, 3, 20), (1, 50, 25), (12, 0, 5), (0, 8, 3), (30, 30, 60)])
def test_large_urns_follow_the_same_law(monkeypatch, urn):
    """Draws by halves against numpy's, with every urn counted as a large one."""
    monkeypatch.setattr(mixing, "LARGE_URN", 2)
    rng, n = np.random.default_rng(3), 20_000
    own = np.bincount([mixing.hypergeometric(rng, *urn) for _ in range(n)], minlength=urn[0] + 1) / n
    theirs = np.bincount(np.random.default_rng(4).hypergeometric(*urn, n), minlength=urn[0] + 1) / n
    assert len(own) == urn[0] + 1 and np.abs(own - theirs).max() < 0.02


def test_tree_of_more_blocks_than_numpy_draws_from():
    quotas = np.array([6 * 10**9, 0, 1, 10**9 + 7, 10**12])
    share = mixing.urn_share(np.random.default_rng(5), quotas, int(quotas.sum()) // 2)
    assert share.sum() == quotas.sum() // 2 and (0 <= share).all() and (share <= quotas).all()
    spread = np.sqrt(quotas) / 2
    assert (np.abs(share - quotas / 2) <= 6 * spread + 1).all()
    tree = mixing.Tree(quotas, 1 << 12)
    source = np.repeat([0, 3, 4], 50)
    draw = np.random.default_rng(6).integers(0, 10**9, len(source))
    found = tree.shard(source, draw)
    assert (found >= 0).all() and (found < 1 << 12).all() and (found == mixing.Tree(quotas, 1 << 12).shard(source, draw)).all()


def some_docs(n=400):
    rng = random.Random(3)
    sources = ["a", "b", "ä", None, "c", ""]
    return [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), "en", rng.choice(sources)) for k in range(n)]


def check(rows, texts, block_words):
    sizes: dict = defaultdict(int)
    taken: dict = defaultdict(int)
    targets = {}
    for r in rows:
        assert r.mix.size == len((texts[r.doc_id] or "").split())
        assert 0 <= r.mix.taken <= 3 * r.mix.size
        assert r.mix.taken == sum(d.words for d in r.mix.draws)
        sizes[r.source] += r.mix.size
        taken[r.source] += r.mix.taken
        targets[r.source] = r.mix.target
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for s, t in zip(order, mixing.targets([sizes[s] for s in order]), strict=True):
        assert targets[s] == pytest.approx(t) and abs(taken[s] - t) <= 1


@pytest.mark.parametrize(("block_words", "run"), [(20_000, 1024), (100, 1024), (50, 2)])
def test_takes_meet_targets(make_docs, monkeypatch, block_words, run):
    monkeypatch.setattr(mixing, "RUN", run)
    rows = some_docs()
    docs = make_docs(rows).withColumns({"size": F.lit("own"), "mix": F.lit("mine")})
    out = mixing.mixed(docs, block_words=block_words, shard_words=1000)
    assert out.columns == [*docs.columns, "_mix"]
    got = out.withColumnRenamed("mix", "old").withColumnRenamed("_mix", "mix").collect()
    assert len(got) == len(rows) and {r.size for r in got} == {"own"}
    check(got, {r[0]: r[1] for r in rows}, block_words)
    again = mixing.mixed(make_docs(rows[::-1]), block_words=block_words, shard_words=1000).collect()
    assert {(r.doc_id, r.mix.taken) for r in again} == {(r.doc_id, r.mix.taken) for r in got}


def test_shards_hold_every_copy(make_docs):
    docs = make_docs(some_docs())
    mix = mixing.mixed(docs, block_words=200, shard_words=1000)
    words = Counter()
    for r in mixing.shards(mix).collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r.doc_id: r.mix.taken for r in mix.collect() if r.mix.taken})


def test_odd_rows_and_empty_table(make_docs, odd_rows):
    rows = mixing.mixed(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.mix.taken == 0 for r in rows if not (r.text or "").split())
    assert mixing.mixed(make_docs([])).count() == 0
    hot = make_docs([(1, "a b c", "en", "s")] * 50 + [(2, "d " * 100, "en", "t")])
    got = mixing.mixed(hot).collect()
    assert len({r.mix.taken for r in got if r.doc_id == 1}) == 1
    assert all(r.mix.taken <= 3 * r.mix.size for r in got)


def test_query(spark, sf):
    rows = queries.op4_source_mix(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    taken: Counter = Counter()
    for r in rows:
        taken[docs[r.doc_id].source] += r.taken
        assert r.size == len(docs[r.doc_id].text.encode().split())
    assert all(abs(taken[docs[r.doc_id].source] - r.target) <= 1 for r in rows)
