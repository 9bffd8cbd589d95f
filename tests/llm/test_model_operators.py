import hashlib
import itertools
import zipfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import components, crf_language, knn_quality, masked_lm, media, mixing, queries, simhash


def closure(points, radius):
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    label = np.arange(len(points))
    while True:
        new = np.where(near, label[None, :], len(points)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, max(1, n // 20), dtype=np.uint64)
    out = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(out)


def plain_simhash(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("n", [1, 3, 150, 2500])
def test_tree_finds_all_links(n):
    points = clustered(n, n)
    assert (simhash.Forest(points, 4).label == closure(points, 4)).all()


@pytest.mark.parametrize("radius", [0, 1, 4, 6])
def test_parts_divide_every_link(radius):
    rng = np.random.default_rng(radius)
    masks = simhash.part_masks(radius)
    assert sum(masks) == (1 << 64) - 1 and len({m & -m for m in masks}) == len(masks)
    for _ in range(200):
        flips = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert min((flips & m).bit_count() for m in masks) <= min(1, radius)


def test_shards_hold_every_link_once_more_at_boundaries(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 10)
    points = clustered(600, 5)
    fps = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    vantage = simhash.vantage_points(fps)
    assert len(vantage) == 5
    shards, rows = {}, simhash.visits(fps, vantage).collect()
    for r in rows:
        shards.setdefault((r.tree, r.shard), set()).add(r.fp)
    # a third of the fingerprints lies at a boundary of a level, so each visits some (4/3) ** 5 shards of a tree
    assert 3 * len(points) * 2 < len(rows) < 3 * len(points) * 8 and len(shards) > 300
    assert max(map(len, shards.values())) < len(points) / 3
    together = {frozenset(x) for own in shards.values() for x in itertools.combinations(own, 2)}
    for i, j in zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)):
        a, b = int(points.view(np.int64)[i]), int(points.view(np.int64)[j])
        assert a == b or frozenset((a, b)) in together


def test_fingerprints():
    for text in ("", "A b", "one two three four", "One  TWO\tthree four five É", "x " * 500):
        assert simhash.simhash(text) == plain_simhash(text)
    assert simhash.simhash(None) == 0


@pytest.mark.parametrize("n, shard, part", [(400, 2_000, 20_000), (3000, 40, 20_000), (400, 2_000, 70)])
def test_groups_equal_brute_force(spark, monkeypatch, n, shard, part):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "PART", part)
    points = clustered(n, 7)
    df = spark.createDataFrame([(i, int(p)) for i, p in enumerate(points.view(np.int64))], "doc_id long, fingerprint long")
    got = {r.fingerprint: r.component_id for r in simhash.groups(df).collect()}
    label = closure(points, 4)
    assert got == {int(p): int(label[i]) for i, p in enumerate(points.view(np.int64))}


def test_simhash_query_equals_brute_force(spark, sf, small):
    got = {r.doc_id: r for r in queries.op2_simhash_groups(spark, sf).collect()}
    rows = sorted((r.doc_id, r.text) for r in small.collect())
    points = np.array([plain_simhash(t) for _, t in rows], np.uint64)
    label = closure(points, 4)
    for i, (doc, _) in enumerate(rows):
        assert got[doc].fingerprint == f"{int(points[i]):016x}" and got[doc].component_id == rows[label[i]][0]


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert len(got) == 10 and (5, 1) in got and (3, 2) in got and (6, 2) in got and (8, 4) in got
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 4, 7]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components(spark):
    chain = [(i + 1, i) for i in range(0, 40)] + [(100, 90), (91, 90), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "hi long, lo long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 91: 90, 100: 90}


def plain_targets(sizes, weights, most):
    names = sorted((n for n in sizes if n is not None), key=lambda x: x.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[n] for n in free)
        out = {n: left * weight[n] / share for n in free}
        over = [n for n in free if out[n] > most * sizes[n]]
        if not over:
            return out | fixed
        fixed |= {n: most * sizes[n] for n in over}


def test_mix_targets_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, n in (("a", 400), ("b", 60), ("c", 1500), (None, 40), ("é", 5), ("tiny", 1)):
        rows += [(len(rows) + i, s, " ".join(["w"] * int(k))) for i, k in enumerate(rng.integers(1, 300, n))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    sizes, taken, targets = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert r.copies <= 3 and r.taken == r.copies * r.size
    want = plain_targets(sizes, mixing.WEIGHTS, 3.0)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 300
        assert {r.source_size for r in got if r.source == s} == {sizes[s]}
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(df).collect()) == sorted((r.doc_id, r.taken) for r in got)


def test_rates_solve_the_dual(spark):
    sizes = [1, 2, 5, 9, 30, 100]
    counts = spark.createDataFrame([("s", k, 10) for k in sizes], "h_source string, size long, n long")
    for target in (200.0, 1470.0, 3000.0, 4000.0):
        wanted = spark.createDataFrame([("s", 1470, target, 100.0)], "source string, source_size long, target double, unit double")
        lam = mixing.solve(counts, wanted).first().lam
        assert sum(10 * k * min(3, np.exp(lam * k / 100)) for k in sizes) == pytest.approx(target, rel=1e-6)


def test_mix_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and all(r.copies >= 0 for r in got) and {r.size for r in got if r.doc_id in (2, 3, 6)} == {0}
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0


def test_quality_model(spark, sf, small):
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    model = queries.quality_model(docs, labels)
    out = docs.join(labels, "doc_id").where(knn_quality.held_out(F.col("doc_id"))).select("quality", knn_quality.score(F.col("text"), model, spark).alias("s")).collect()
    assert np.mean([(r.s >= 0.5) == (r.quality == 1) for r in out]) > 0.95
    assert model.known.shape[1] <= knn_quality.MAX_ROWS and all(0 <= r.s <= 1 for r in out)


def test_nearest_votes_are_exact():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(80)]
    labels = rng.integers(0, 2, 80).astype(np.float32)
    model = knn_quality.Model(knn_quality.counts(texts), labels, rank=10, voters=5)
    known = model.vectors(knn_quality.counts(texts))
    new = [" ".join(rng.choice(words, 20)) for _ in range(10)]
    for text, score in zip(new, model.score(new)):
        near = known @ model.vectors(knn_quality.counts([text]))[0]
        top = np.argsort(-near)[:5]
        weight = np.maximum(near[top], 0) ** model.power
        assert score == pytest.approx(float((weight * labels[top]).sum() / weight.sum()), abs=1e-4)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 1), (2, 1, 0), (9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = knn_quality.fit(odd, labels)
    assert all(0 <= r.s <= 1 for r in odd.select(knn_quality.score(F.col("text"), model, spark).alias("s")).collect())
    nothing = knn_quality.fit(empty, labels)
    assert {r.s for r in odd.select(knn_quality.score(F.col("text"), nothing, spark).alias("s")).collect()} == {0.5}


def test_posteriors_equal_all_paths():
    rng = np.random.default_rng(0)
    field = crf_language.Field(["a", "b", "c"])
    field.moves = rng.normal(size=(3, 3)).astype(np.float32)
    lengths = np.array([3, 1, 4])
    scores = rng.normal(size=(8, 3)).astype(np.float32)
    got, at = field.posteriors(scores, lengths), 0
    for n in lengths.tolist():
        mass = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            weight = np.exp(sum(scores[at + t, path[t]] for t in range(n)) + sum(field.moves[path[t], path[t + 1]] for t in range(n - 1)))
            for t in range(n):
                mass[t, path[t]] += weight
        assert np.allclose(got[at : at + n], mass / mass.sum(axis=1, keepdims=True), atol=1e-5)
        at += n


def test_expected_neighbours_equal_all_paths():
    rng = np.random.default_rng(5)
    field = crf_language.Field(["a", "b", "c"])
    field.moves = rng.normal(size=(3, 3)).astype(np.float32)
    lengths, want = np.array([1, 4, 3]), np.zeros((3, 3))
    scores = rng.normal(size=(8, 3)).astype(np.float32)
    for first, n in zip(np.cumsum(lengths) - lengths, lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        weights = np.array([np.exp(sum(scores[first + i, x] for i, x in enumerate(p)) + sum(field.moves[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weights / weights.sum()):
            for x, y in zip(p, p[1:]):
                want[x, y] += w
    got = np.zeros((3, 3))
    field.posteriors(scores, lengths, got)
    assert np.allclose(got, want, atol=1e-4)


def test_transitions_are_learned():
    """Words that say nothing take the language of their neighbours, beyond 64 languages too."""
    langs = [f"l{i:03}" for i in range(70)]
    words = ["qu" + chr(97 + i // 10) + chr(107 + i % 10) + "x" for i in range(70)]
    field = crf_language.Field(langs).train([(i, [w] * 3 + ["na"] + [w] * 2) for i, w in enumerate(words) for _ in range(2)], rounds=15)
    assert (np.diag(field.moves) > field.moves.mean(axis=1)).all()
    assert crf_language.Labeller(field).label([f"{words[69]} na na {words[69]}", f"{words[3]} na {words[3]}"])[0] == ["l069", "l003"]


def test_repeated_ids_are_learnt_from_once(spark):
    rows = [(1, "the cat sat", "en")] * 3 + [(1, "zzz", "en"), (2, "le chat noir", "fr"), (None, "der hund", "de")]
    twice = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = spark.createDataFrame([rows[0], *rows[4:]], "doc_id long, text string, lang string")
    a, b = crf_language.fit(twice), crf_language.fit(once)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights)


def test_language(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    field = crf_language.fit(docs.where(~knn_quality.held_out(F.col("doc_id"))))
    out = docs.where(knn_quality.held_out(F.col("doc_id"))).select("lang", crf_language.language(F.col("text"), field, spark).alias("x")).collect()
    assert np.mean([r.lang == r.x.lang for r in out]) > 0.97
    got = {(r.doc_id, r.x.lang == "und", 0 <= r.x.score <= 1) for r in odd.select("doc_id", crf_language.language(F.col("text"), field, spark).alias("x")).collect()}
    assert {(2, True, True), (3, True, True), (6, True, True), (1, False, True)} <= got
    blind = crf_language.fit(empty)
    assert {r.x.lang for r in odd.select(crf_language.language(F.col("text"), blind, spark).alias("x")).collect()} == {"und"}


def test_masked_probabilities_sum_to_one():
    net = masked_lm.Net(["the", "of"])
    context = np.random.default_rng(1).integers(0, net.size, (4, 2 * masked_lm.SIDE))
    total = np.exp([net.log_probability(context, np.full(4, t)) for t in range(net.size)]).sum(axis=0)
    assert np.allclose(total, 1, atol=1e-4)


def test_training_beats_the_unigram_model_however_rows_are_dealt(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text")
    train, rest = docs.where("doc_id % 10 in (1, 2, 3, 4)"), docs.where("doc_id % 10 = 0")

    def mean(net):
        return rest.select(masked_lm.score(F.col("text"), net, spark).alias("s")).agg(F.sum("s.log_prob") / F.sum("s.n_tokens")).first()[0]

    plain = mean(masked_lm.start(train))
    found = [mean(masked_lm.fit(train.repartition(n), rounds=6)) for n in (1, 4, 64)]
    assert min(found) > plain + 0.05
    assert max(found) - min(found) < 0.01 * abs(plain)


def test_masked_odd_rows(spark, odd, empty):
    net = masked_lm.fit(odd, size=8, rounds=2)
    got = {r.doc_id: r.s for r in odd.select("doc_id", masked_lm.score(F.col("text"), net, spark).alias("s")).collect()}
    assert got[2] == (0, 0.0) and got[3] == (0, 0.0) and got[4].n_tokens == 20_000 and got[4].log_prob < 0 and got[4].log_prob == pytest.approx(got[8].log_prob)
    assert masked_lm.fit(empty, size=4, rounds=1).flat.size == masked_lm.Net([]).flat.size


def test_masked_query(spark, sf, small):
    got = {r.doc_id: r for r in queries.op6_masked_lm(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in small.collect()}
    assert set(got) == set(texts)
    for doc, r in got.items():
        assert r.n_tokens == len((texts[doc] or "").split()) and (r.log_prob < 0) == (r.n_tokens > 0)
        assert r.n_tokens == 0 or r.mean_log_prob == pytest.approx(r.log_prob / r.n_tokens)


def test_gradient_equals_differences():
    net = masked_lm.Net(["a", "b", "c"], np.array([5.0, 3, 2]))
    rng = np.random.default_rng(2)
    context, target = rng.integers(0, net.size, (6, 4)), rng.integers(0, net.size, 6)
    total = np.zeros(len(net.flat), np.float32)
    net.gradient(context, target, total)
    base = net.flat.copy()
    for i in [*rng.integers(0, len(base), 40), *np.argsort(-np.abs(total))[:20]]:
        ends = []
        for d in (1e-2, -1e-2):
            flat = base.copy()
            flat[i] += d
            net.load(flat)
            ends.append(-net.log_probability(context, target).astype(float).sum())
        assert total[i] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-2)


def test_sum_of_log_probabilities():
    net = masked_lm.Net(["a", "b"])
    padded, sizes = masked_lm.windows([np.array([net.token(w) for w in x.split()], np.int64) for x in ("a b a zz", "", "b")], net)
    assert sizes.tolist() == [4, 0, 1] and len(padded) == 5 + 3 * 2 * masked_lm.SIDE
    at = masked_lm._places(sizes)
    assert [int(padded[i]) for i in at] == [0, 1, 0, net.token("zz"), 1]


def test_media_round_trip(spark, odd, empty):
    folder = media.new_folder(spark)
    manifest = media.write_archives(odd, folder)
    got = media.features(media.read_archives(spark, folder, manifest)).collect()
    want = sorted(((r.doc_id if r.doc_id is not None else -1), (r.text or "").encode()) for r in odd.select("doc_id", "text").collect())
    seen = sorted((((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.payload_sha256, r.tail_crc32, r.payload_bytes) for r in got))
    assert seen == sorted((d, len(t), hashlib.sha256(media.payload(t)).hexdigest(), zlib.crc32(media.payload(t)[-64:]), len(media.payload(t))) for d, t in want)
    twins = {(r.payload_sha256, r.media_sha256, r.feature) for r in got}
    assert len(twins) == len({r.payload_sha256 for r in got})
    folder = media.new_folder(spark)
    assert media.read_archives(spark, folder, media.write_archives(empty, folder)).count() == 0


def test_byte_ranges_share_out_members(spark, small):
    folder = media.new_folder(spark)
    media.write_archives(small, folder)
    reader = media.ArchiveReader({"path": folder, "range_bytes": "20000"})
    parts = reader.partitions()
    offsets = [(b["archive"][i].as_py(), b["offset"][i].as_py()) for p in parts for b in reader.read(p) for i in range(len(b))]
    assert len(parts) > 3 and len(offsets) == len(set(offsets)) == small.count()


def test_damage_is_noticed(tmp_path):
    image = media.to_png(media.payload(b"hello"))
    assert media.from_png(image) == media.payload(b"hello")
    for broken in (image[:20] + b"x" + image[21:], b"no"):
        with pytest.raises(ValueError):
            media.from_png(broken)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/1/5.png", image)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[60] ^= 1
    (tmp_path / "a.zip").write_bytes(data)
    with pytest.raises(OSError):
        media._member(media._Archive(f"file://{tmp_path}/a.zip"), 0, len(image), zlib.crc32(image))


def test_pipeline(spark, sf, small):
    docs = small
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf), name)
        counts[name] = docs.count()
        if name != "encode":
            assert docs.columns == small.columns
    assert counts["quality"] < small.count() and counts["near_dedup"] < counts["quality"] and counts["repeat_dedup"] == counts["near_dedup"] and counts["encode"] == counts["mix"]
    assert docs.where("not round_trip").count() == 0
