import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import delta_kmeans, merkle, queries, sketch


def plain_sketch(text, n=5):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = {xxhash.xxh64_intdigest(g, 42) for g in grams}
    return sorted(h for h in hashes if h < 2**61) or sorted(hashes)[:1]


def plain_near(a, b):
    every = sorted(set(a) | set(b))
    every = [h for h in every if h < 2**61] or every[:1]
    return len(set(a) & set(b) & set(every)) / len(every) if every else 1.0


def plain_compared(rows):
    rows = sorted(rows, key=lambda r: ((0, -r[0]) if r[0] is not None else (1, 0), _signed(r[1])))
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 3
        changed = text[: len(text) - k] + after[:k]
        own, other = plain_sketch(text), plain_sketch(changed)
        yield (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), _hex(own), _hex(other), plain_near(own, other), plain_near(own, plain_sketch(after)))


def _signed(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64))


def _hex(hashes):
    return "".join(f"{h:016x}" for h in hashes)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_sketch_query_equals_brute_force(spark, sf, small):
    rows = [(r.doc_id, r.text or "") for r in small.collect()]
    got = queries.op11_threshold_sketch(spark, sf).collect()
    assert _sorted(got) == _sorted(plain_compared(rows))
    found = {r.doc_id: r for r in got if r.n_chars > 500}
    assert np.mean([r.near_edited for r in found.values()]) > 0.4 and np.median([r.near_next for r in found.values()]) == 0


def test_sketch_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    assert _sorted(sketch.compare_edited(odd).collect()) == _sorted(plain_compared(rows))
    assert sketch.compare_edited(empty).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in sketch.compare_edited(one).collect()] == [(None, 0, hashlib.sha256(b"").hexdigest(), "", "", 1.0, 1.0)]


def test_ids_that_many_rows_share_are_spread(spark):
    rows = [(7, f"seven {i} and more words than five") for i in range(300)] + [(None, f"no id {i}") for i in range(200)] + [(i, f"own {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert _sorted(sketch.compare_edited(docs).collect()) == _sorted(plain_compared(rows))
    assert sketch.in_order(docs).select("i").distinct().count() > 60


def test_long_texts_are_shingled_by_pieces(monkeypatch):
    text = " ".join(f"W{i * i % 1013}\n" for i in range(3000)) + "x" * 500
    whole = sketch.sketch(text)
    assert whole.tolist() == plain_sketch(text)
    monkeypatch.setattr(sketch, "PIECE", 37)
    assert (sketch.sketch(text) == whole).all() and sketch.sketch("one two  three").tolist() == plain_sketch("one two three")


def test_unions_and_containment(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)) for n in (4, 9, 30, 4000, 9000)]
    marks = [sketch.sketch(t) for t in texts]
    for a in marks:
        for b in marks:
            assert sketch.united(a, b).tolist() == sketch.united(b, a).tolist()
            assert sketch.likeness(a, b) == plain_near(a.tolist(), b.tolist())
    long = texts[4]
    part = " ".join(long.split()[1000:1400])
    assert sketch.contained(sketch.sketch(part), sketch.sketch(long)) == 1.0
    assert (sketch.parsed(sketch.written(marks[4])) == marks[4]).all()
    rows = [(1, "a", part), (2, "b", long), (3, "b", texts[3]), (4, "c", ""), (5, "c", None), (6, None, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("fingerprint", sketch.fingerprint(F.col("text")))
    groups = sketch.hash_rows(docs, ["source"])
    assert {r.source: r.n for r in groups.groupBy("source").agg(F.count("*").alias("n")).collect()} == {
        "a": len(sketch.sketch(part)), "b": len(sketch.united(marks[3], marks[4])), None: 1,
    }
    got = {(r.doc_id, r.source): r.contained for r in sketch.containment(docs, groups).collect()}
    assert got[(1, "b")] == 1.0 and got[(2, "b")] == 1.0 and 0 < got[(2, "a")] < 0.1 and got[(6, None)] == 1.0


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, lower=False):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    text = r.text
    if lower and text is not None:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return h("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))


def plain_tree(nodes):
    """(root, for each leaf its (left, right) by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[leaf].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        at = [i // 8 for i in at]
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted(trees[x], key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r))) for x in langs}
    built = {x: plain_tree([plain_leaf(r) for r in own[x]]) for x in langs}
    root, above = plain_tree([built[x][0] for x in langs])
    for x, upper in zip(langs, above):
        for r, path in zip(own[x], built[x][1]):
            path = path + upper
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            folded = plain_leaf(r, tampered)
            for left, right in path:
                folded = h(left + folded + right)
            yield (r.doc_id, plain_leaf(r), built[x][0], root, h("".join(a + b for a, b in path)), folded, folded == root)


def _documents(spark, df, tmp_path):
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_manifest_query_equals_brute_force(spark, sf, small):
    got = queries.op12_merkle_manifest(spark, sf).collect()
    assert _sorted(got) == _sorted(plain_manifest(small.collect()))
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_manifest_of_odd_rows(spark, odd, empty, tmp_path):
    more = spark.createDataFrame([(i, f"Text {i}", f"l{i % 11}", None, i) for i in range(100, 700, 3)], odd.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").schema)
    rows = odd.select(*more.columns).union(more)
    at = _documents(spark, rows, tmp_path / "odd")
    assert _sorted(queries.op12_merkle_manifest(spark, at).collect()) == _sorted(plain_manifest(rows.collect()))
    assert queries.op12_merkle_manifest(spark, _documents(spark, empty, tmp_path / "empty")).count() == 0


def test_positions_of_many_equal_rows(spark):
    rows = spark.createDataFrame([("a", 1)] * 500 + [("b", i) for i in range(20)], "tree string, k int").repartition(5)
    got = merkle.numbered(rows, "tree", ["k"]).collect()
    assert sorted((r.tree, r.pos, r.n) for r in got) == [("a", i, 500) for i in range(500)] + [("b", i, 20) for i in range(20)]
    assert all(r.tree == "a" or r.k == r.pos for r in got)
    found = merkle.manifest(rows.withColumn("leaf", merkle.leaf(F.col("k"))), "tree", ["k"], "leaf")
    assert len(found.trees) == 4 and found.proofs().where(merkle.folded(F.col("node"), F.col("path")) != merkle.hexed(F.col("root"))).count() == 0
    assert found.root().count() == 1


def plain_lloyd(rows, k, rounds, dims, salt):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (h(salt + ("" if r[0] is None else str(r[0]))), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centres[j] = [sum(x) // len(members) for x in zip(*members)]
    return [(i, *reversed(near(v))) for i, v in kept], centres


def test_clusters_query_equals_brute_force(spark, sf):
    got = queries.op13_delta_lloyd(spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    plain, centres = plain_lloyd(rows, 40, 5, 64, "2:")
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(plain)
    for r in got:
        assert r.centroid_sha256 == h(",".join(map(str, centres[r.cluster]))) and r.inertia == sum(d for _, _, d in plain)
        assert r.cluster_inertia == sum(d for _, c, d in plain if c == r.cluster)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_clusters_of_odd_vectors(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) * scale for x in rng.normal(size=3)]) for i in range(150)]
    rows += [(1, rows[1][1])] * 40 + [(None, [0.0, 1.0, 2.0]), (None, [0.0, 1.0, -2.0]), (200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [1.0, float("-inf"), 2.0]), (205, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS owner", "2 AS distance", "3 AS v")
    got, centres = delta_kmeans.cluster(df, 7, 4, 3, "s")
    plain, expected = plain_lloyd(rows, 7, 4, 3, "s")
    assert _sorted(got.collect()) == _sorted(plain) and centres.tolist() == expected
    few, centres = delta_kmeans.cluster(df.limit(2), 7, 4, 3, "s")
    assert few.count() == 2 and len(centres) == 2
    none, centres = delta_kmeans.cluster(df.where("vec_id = 205"), 7, 4, 3)
    assert delta_kmeans.summary(none, centres).count() == 0 and len(centres) == 0


def test_only_what_changed_is_compared(monkeypatch):
    rng = np.random.default_rng(0)
    v, centres = rng.integers(-50, 50, (200, 4)), rng.integers(-50, 50, (9, 4))
    d = delta_kmeans.distances(v, centres)
    owner, own = d.argmin(axis=1), d.min(axis=1)
    moved = np.zeros(9, bool)
    moved[[2, 5]] = True
    new = centres.copy()
    new[moved] += rng.integers(-20, 20, (2, 4))
    compared, plain = [], delta_kmeans.distances
    monkeypatch.setattr(delta_kmeans, "distances", lambda a, b: compared.append(len(a) * len(b)) or plain(a, b))
    got = delta_kmeans.reassigned(v, owner, own, new, moved)
    lost = np.isin(owner, [2, 5]).sum()
    assert compared == [lost * 9, (200 - lost) * 2]
    d = plain(v, new)
    assert (got[0] == d.argmin(axis=1)).all() and (got[1] == d.min(axis=1)).all()


def test_a_component_too_large_ends_the_run(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="is not between"):
        delta_kmeans.cluster(df, 2, 1, 2)
