"""Sharding and mixing."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tallyline.llm import mixing
from tallyline.llm.sharding import assign, shard_documents


def test_shards_are_gapless_and_stable(odd_docs, odd_texts):
    rows = shard_documents(odd_docs).toPandas()
    assert len(rows) == len(odd_texts)
    for _, shard in rows.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    for r in rows.itertuples():
        raw = (odd_texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 40)


def test_one_more_shard_moves_rows_only_into_it(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    small = {r.doc_id: r for r in assign(ids, "doc_id", [1.0] * 40).collect()}
    large = {r.doc_id: r.shard for r in assign(ids, "doc_id", [1.0] * 41).collect()}
    assert all(small[i].grown_shard == large[i] for i in large)
    moved = [i for i in large if small[i].shard != large[i]]
    assert moved and all(large[i] == 40 for i in moved)
    assert 50 < len(moved) < 160


def test_weights_shape_the_shards(spark):
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    n = Counter(r.shard for r in assign(ids, "doc_id", [1.0, 2.0, 3.0]).collect())
    assert n[0] == pytest.approx(1000, rel=0.15) and n[2] == pytest.approx(3000, rel=0.1)
    with pytest.raises(ValueError):
        assign(ids, "doc_id", [1.0, 0.0])


def test_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (1, None)], "doc_id long, text string")
    out = shard_documents(rows).collect()
    assert len(out) == 5 and len({r.shard for r in out if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in out}) == 5


def brute_targets(sizes, weights, total, cap):
    """Raise a common level until the total is spent."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        spent = sum(min(cap * s, mid * w) for s, w in zip(sizes, weights))
        lo, hi = (mid, hi) if spent < total else (lo, mid)
    return [min(cap * s, lo * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 1000, rng.integers(1, 12)).tolist()
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total = 1.5 * sum(sizes)
    got = mixing.fill_targets(sizes, weights, total)
    assert got == pytest.approx(brute_targets(sizes, weights, total, 2.0), abs=1e-3)
    assert sum(got) == pytest.approx(total)


def test_splitting_tree_keeps_quotas_and_balance():
    quotas = [100, 0, 37, 1, 500]
    out = mixing.split_quotas(quotas, 7, seed=4)
    assert out.sum(axis=0).tolist() == quotas
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 3
    assert (out == mixing.split_quotas(quotas, 7, seed=4)).all()


def test_mix_takes_each_sources_target(docs):
    rows = mixing.mix_documents(docs).toPandas().merge(docs.select("doc_id", "source").toPandas())
    assert (rows.taken <= 2 * rows["size"]).all()
    for _, s in rows.groupby("source", dropna=False):
        assert s["size"].sum() == s.source_size.iloc[0]
        assert abs(s.taken.sum() - s.target.iloc[0]) <= 1
    again = mixing.mix_documents(docs).toPandas()
    key = ["doc_id", "taken"]
    assert again[key].sort_values(key).values.tolist() == rows[key].sort_values(key).values.tolist()


def test_mix_of_odd_rows(odd_docs, no_docs, odd_texts):
    rows = mixing.mix_documents(odd_docs).toPandas()
    assert len(rows) == len(odd_texts) and rows.taken.sum() > 0
    assert mixing.mix_documents(no_docs).count() == 0
    assert shard_documents(no_docs).count() == 0


def test_mixed_rows_are_the_plan(odd_docs):
    plan = mixing.Mix(odd_docs, mixing.word_count())
    taken = {r.doc_id: r.taken for r in plan.taken().collect()}
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len((r.text or "").split())
    assert all(abs(words[i] - n) <= 1 for i, n in taken.items() if i != 9)
    placed = plan.placed().collect()
    assert len({(r.row_id, r["copy"]) for r in placed}) == len(placed)
    assert all(0 <= r.shard < mixing.SHARDS for r in placed)


def test_the_mix_is_what_the_tree_draws(docs):
    """Row by row: the shards' copies of a document hold its whole passes and its part of the last one."""
    plan = mixing.Mix(docs, mixing.word_count())
    want = Counter((r.doc_id, r.taken) for r in plan.taken().collect())
    assert Counter((r.doc_id, r.taken) for r in mixing.mix_documents(docs).collect()) == want
