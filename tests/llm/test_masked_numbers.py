"""Operator 6 splits texts once: scores come from the numbers that training reads, and equal those of the texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import masked_lm, queries


def test_query_scores_from_numbers(spark, sf):
    found = queries.op6_masked_lm(spark, sf)
    assert not any("documents.parquet" in x for x in found.inputFiles())


def test_scores_of_numbers_equal_those_of_texts(spark, odd):
    net = masked_lm.fit(odd, size=8, rounds=2)
    want = odd.select("doc_id", masked_lm.score(F.col("text"), net, spark).alias("s")).select("doc_id", "s.*").collect()
    got = masked_lm.fit_scores(odd, size=8, rounds=2).collect()
    rank = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert len(got) == len(want) == 10
    for a, b in zip(sorted(got, key=rank), sorted(want, key=rank)):
        assert (a.doc_id, a.n_tokens) == (b.doc_id, b.n_tokens) and a.log_prob == pytest.approx(b.log_prob, rel=1e-4)


def test_numbers_equal_a_plain_loop():
    pairs = np.random.default_rng(3).integers(0, 50, (256, 256))
    net = masked_lm.Net(["the", "of"], spelling=pairs)
    texts = ["The  of x\0y the", None, "", " \t　", "İstanbul\x1cé \U0001f600 The x\0y"]
    ids, cost, sizes = net.numbers(texts)
    words = [w for t in texts for w in (t or "").lower().split()]
    assert sizes.tolist() == [4, 0, 0, 0, 5] and len(words) == 9
    for w, i, c in zip(words, ids.tolist(), cost.tolist()):
        code = b"\0" + w.encode() + b"\0"
        rare = w not in ("the", "of")
        assert i == (2 + zlib.crc32(w.encode()) % masked_lm.RARE if rare else ["the", "of"].index(w))
        assert c == pytest.approx(sum(net.spelling[a, b] for a, b in zip(code, code[1:])) if rare else 0)


def test_sums_by_key_and_large_logits():
    rng = np.random.default_rng(4)
    keys, rows = np.minimum(rng.geometric(0.02, 3000), 300), rng.normal(size=(3000, 5))
    own, sums = masked_lm._summed_by(keys, rows)
    assert sorted(own.tolist()) == sorted(set(keys.tolist()))
    assert all(np.allclose(s, rows[keys == k].sum(axis=0)) for k, s in zip(own, sums))
    x = rng.normal(size=(4, 6)) * 300
    top = x.max(axis=1, keepdims=True)
    assert np.allclose(masked_lm._log_sum(x.copy(), False), top[:, 0] + np.log(np.exp(x - top).sum(axis=1)))
    assert np.allclose(masked_lm._softmax(x / 30, True), masked_lm._softmax(x / 30, False))
