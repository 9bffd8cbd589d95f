import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import bpe, planes, quality_rules, queries, suffix

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(spark, odd, empty):
    got = quality_rules.judge(odd).collect()
    assert len(got) == 10
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)
        assert not (r.base_failed and r.kept) and r.lang == r.lang
    assert {r["_words"] for r in got} == {"_words"}  # a column of the user's
    assert quality_rules.judge(empty).count() == 0


def test_quality_verdicts_survive_a_filter(spark):
    prose = (
        "The committee met again in the spring and agreed on most of the points that had been left open.\nNobody had expected that, "
        "least of all the two members who had argued about the bridge for a year.\nThen they went home, some by train and others on "
        "foot, before it got dark outside and the river rose over the lower road."
    )
    texts = [prose, "Home | News | About | Contact\n" * 20, "BUY!! NOW!! CHEAP!! DEALS!!\n" * 20, "la&&& le$$$ ###\n" * 30 + "x " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert kept[0]
    assert {r.doc_id for r in quality_rules.judge(df).where("kept").collect()} == {0}
    assert not kept[1] and not kept[2] and not kept[3]


def encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library():
    want, own = encoding(), bpe.codec(RANKS, PATTERN)
    rng = random.Random(1)
    parts = ["a", "é", "the", " ", "  ", "\n", "\t", "it's", "I'LL", "12", "$$$", "漢字", "\xa0", "😀", "\r\n", "ation", "\x1c", "　", "'s", "\x85", "ª", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["ab" * 20_000, " " * 300, "x" * 65, "y" * 64, "<|endoftext|>"]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == want.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_bpe_trees_equal_a_plain_loop():
    own = bpe.codec(RANKS, PATTERN)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((own.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [own.ranks[p] for p in parts]

    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"aeiounrst \xc3\xa9") for _ in range(rng.randint(1, 64))) for _ in range(400)]
    assert own.trees.encode(pieces) == [bpe.packed(plain(p)) for p in pieces]
    for p in pieces[:60]:
        assert bpe.merge_piece(p, own.ranks) in (plain(p), [own.ranks.get(p)])


def test_bpe_columns(spark, odd, empty):
    coded = odd.withColumn("ids", bpe.encode(F.col("text"), RANKS, PATTERN))
    back = coded.withColumn("back", bpe.decode(F.col("ids"), RANKS, PATTERN)).collect()
    assert len(back) == 10 and all(bytes(r.back) == (r.text or "").encode() for r in back)
    assert empty.select(bpe.encode(F.col("text"), RANKS, PATTERN)).count() == 0


def test_planes_round_trip_and_damage():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 32, 150_000, dtype=np.uint64).astype(np.uint32)
    data = planes.pack(ids, np.array([4, 9]), np.array([150_000, 0]))
    got = planes.unpack(data)
    assert (got[0] == ids).all() and got[1].tolist() == [4, 9] and got[2].tolist() == [150_000, 0]
    assert planes.unpack(planes.pack(ids[:0], ids[:0], ids[:0]))[0].size == 0
    with pytest.raises(ValueError):
        planes.unpack(data[:-1])


def test_plane_files(spark, odd, empty, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(planes, "FILE_IDS", 50_000)
    tokenizer = Tokenizer.from_file(path)
    marked = odd.select("doc_id", "text").union(spark.createDataFrame([(77, "a <|endoftext|> b"), (77, "c<|endoftext|>")], "doc_id long, text string"))
    folder = planes.new_folder(spark)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in planes.read_checksums(planes.write(marked, path, folder), folder).collect())
    rows = marked.withColumn("text", F.coalesce("text", F.lit(""))).orderBy("doc_id", F.xxhash64("text")).collect()
    start = 0
    for (doc, text), row in zip(rows, got):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert row == (start, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == 12 and {r.start for r in planes.read(planes.write(marked, path, folder), folder).collect()} == {r[0] for r in got}
    folder = planes.new_folder(spark)
    assert planes.read(planes.write(empty.where("false"), path, folder), folder).count() == 0


def plain_removal(docs, length):
    """doc -> (removed, runs, kept bytes) by a dictionary of all strings."""
    first = {}
    for doc, data in docs:
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, data in docs:
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((doc, int(gone.sum()), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [50, 24])
def test_suffix_equals_a_dictionary(spark, length):
    rng = random.Random(length)
    passages = ["".join(rng.choice("ab é") for _ in range(rng.randint(length - 3, 3 * length))) for _ in range(12)]
    docs = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.6 else "".join(rng.choice("cdefg") for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(0, 6))]
        docs.append((rng.randint(0, 45), "".join(parts)))  # some ids repeat
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix.remove_repeats(df, length=length).collect()
    want = plain_removal([(d, t.encode()) for d, t in docs], length)
    assert sorted((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)


def test_suffix_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 200)
    text = "".join(random.Random(9).choice("abcdef") for _ in range(1500))
    df = spark.createDataFrame([(1, text), (2, "zz" + text[300:1400] + "yy")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix.remove_repeats(df).collect()}
    assert got == {1: (0, text.encode()), 2: (1100, b"zzyy")}


def test_suffix_odd_rows(odd, empty):
    got = suffix.remove_repeats(odd).collect()
    by = {(r.doc_id, r.source): r for r in got}
    assert len(got) == 10 and by[5, None].n_removed == by[5, None].n_bytes and by[1, "a"].n_removed == 0 and by[8, "b"].kept == b"" and by[2, None].n_bytes == 0 and by[None, "a"].n_removed == 0
    assert suffix.remove_repeats(empty).count() == 0


def test_cut_characters_go(spark):
    df = spark.createDataFrame([(bytearray(b"a\xc3"),), (None,)], "b binary")
    assert [r.t for r in df.select(suffix.valid_text(F.col("b")).alias("t")).collect()] == ["a", None]


def test_digests_of_bpe_query(spark, sf, small):
    want = encoding()
    got = {r.doc_id: r for r in queries.op3_bpe_round_trip(spark, sf).collect()}
    for r in small.collect():
        ids = want.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_repeats_keep_columns_named_like_working_ones(spark):
    shared = "the passage that both documents hold is longer than fifty bytes in all"
    df = spark.createDataFrame([(1, "A" + shared, "u"), (2, "B" + shared, "v")], "doc_id long, text string, _T string").selectExpr("*", "'w' AS _out")
    got = sorted((r.doc_id, r["_T"], r["_out"], r.n_removed) for r in suffix.remove_repeats(df).collect())
    assert got == [(1, "u", "w", 0), (2, "v", "w", len(shared))]
