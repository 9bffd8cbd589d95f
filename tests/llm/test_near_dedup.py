import random

import numpy as np

import corpus_pipeline
from palimpsest.llm import jaccard


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_copies(n, seed):
    """Families of texts whose members have some words changed, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 400]))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def plain_kept(texts):
    sets = [plain_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted(set(label))


def test_stage_equals_brute_force(spark, sf, monkeypatch):
    texts = near_copies(60, 4) + ["", None, " \n", "one two", "One  two", "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_kept(texts)
    assert len(want) < len(texts) - 60
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf).collect()) == want
    monkeypatch.setattr(jaccard, "CELL", 2)  # components in several parts
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == want


def test_links_of_a_cell():
    texts = near_copies(40, 9)
    sets = [jaccard.shingle_set(t) for t in texts]
    assert sorted(set(jaccard.linked(sets).tolist())) == plain_kept(texts)


def test_bands_find_nearly_all_pairs_at_the_limit():
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(400):
        pool = rng.integers(0, 1 << 64, 180, dtype=np.uint64)  # 160 of 200 in common
        more = rng.integers(0, 1 << 64, 20, dtype=np.uint64)
        a, b = np.sort(pool), np.sort(np.concatenate([pool[:160], more]))
        found += bool((jaccard.band_keys(a) == jaccard.band_keys(b)).any())
    assert found >= 399


def test_odd_rows(odd, empty):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 5 and jaccard.keep_one(empty).count() == 0


def test_stage_finds_copies_by_fingerprints(spark, sf, monkeypatch):
    from palimpsest.llm import simhash

    texts = near_copies(12, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    # no bands: what goes was found by operator 2
    monkeypatch.setattr(jaccard, "band_links", lambda own: own.where("false").selectExpr("node hi", "node lo"))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf).collect()}
    members = [[texts[d] for d in group if group[d] == g] for g in set(group.values())]
    assert len(kept) == sum(len(plain_kept(m)) for m in members) < len(texts)
