"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, crf_language, delta_kmeans, knn_quality, masked_lm, media, merkle, mixing, planes, quality_rules, simhash, sketch, suffix
from palimpsest.llm.common import table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_words", "n_unfinished_words"]
    return quality_rules.judge(docs).select(*columns, F.sha2("cleaned", 256).alias("cleaned_sha256"))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ 	-
]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS u(i)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) AS x,
             unnest([i, i + 1, i + 2]) AS v(p)
        WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^ 	-
]+') AS ws
      FROM (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d), unnest(range(1, len(ls) + 1)) AS u(i))
      WHERE regexp_matches(line, '[^ 	-
]')),
j AS (SELECT doc_id, i, line, len(ws) AS n,
        regexp_matches(line, '{quality_rules.NAVIGATION}')
        OR regexp_matches(line, '{quality_rules.BOILERPLATE}')
        OR (len(regexp_extract_all(line, '{quality_rules.SYMBOLS}|!!')) > 0
            AND 2 * len(regexp_extract_all(line, '{quality_rules.SYMBOLS}|!!')) >= len(ws))
        OR (len(ws) >= 3 AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}'))
        OR (len(ws) >= 5 AND 2 * len(list_distinct(ws)) <= len(ws)) AS fails,
        len(ws) >= 8 AND NOT regexp_matches(line, '[.!?…:;"”»)\]][ 	-
]*$') AS unfinished
      FROM l),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
        string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT fails) AS cleaned,
        sum(CASE WHEN fails THEN n ELSE 0 END) AS n_failed_words,
        sum(CASE WHEN unfinished THEN n ELSE 0 END) AS n_unfinished_words
      FROM j GROUP BY doc_id),
a AS (SELECT w.doc_id, len(ws) AS n_words,
        len(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars,
        len(regexp_extract_all(text, '{quality_rules.SYMBOLS}')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_failed_words, 0) AS n_failed_words, coalesce(n_unfinished_words, 0) AS n_unfinished_words,
        sha256(coalesce(cleaned, '')) AS cleaned_sha256
      FROM w LEFT JOIN s ON w.doc_id = s.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_failed_words <= {quality_rules.MAX_LOSS} * n_words AND 10 * n_unfinished_words <= 9 * n_words AS kept,
  CAST(n_failed_words AS BIGINT) AS n_failed_words, CAST(n_unfinished_words AS BIGINT) AS n_unfinished_words, cleaned_sha256
FROM b
"""


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the groups that near fingerprints form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; digests of ids and of decoded bytes. Null texts count as empty."""
    path, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = docs.select("doc_id", bpe.round_trip(F.col("text"), path, pattern).alias("x")).select("doc_id", "x.ids", "x.decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def quality_model(docs: DataFrame, labels: DataFrame) -> knn_quality.Model:
    """The quality model, learnt from labelled documents that are not held out."""
    return knn_quality.fit(docs, labels.where(~knn_quality.held_out(F.col("doc_id"))))


def op4_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", knn_quality.held_out(F.col("doc_id")).alias("held_out"), knn_quality.score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to plane files and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = planes.new_folder(spark)
    manifest = planes.write(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=0)
    return planes.read_checksums(manifest, folder)


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihoods of all documents under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = masked_lm.fit_scores(docs)
    return found.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as images in archives and read back by the archive source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = media.new_folder(spark)
    manifest = media.write_archives(docs, folder)
    return media.features(media.read_archives(spark, folder, manifest))


def op9_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = knn_quality.held_out(F.col("doc_id"))
    field = crf_language.fit(docs.where(~out))
    found = docs.select("doc_id", out.alias("held_out"), crf_language.language(F.col("text"), field, spark).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without 50-byte strings that start in a document with a smaller id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs, length=50).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
p AS (SELECT doc_id, i, md5(x[2 * i + 1 : 2 * i + 100]) AS s
      FROM h, unnest(range(0, n - 49)) AS u(i) WHERE n >= 50),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM p),
r AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM m WHERE low < doc_id),
runs AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS e FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
k AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last_e FROM spans GROUP BY doc_id),
t AS (SELECT g.doc_id, string_agg(x[2 * before + 1 : 2 * a], '' ORDER BY a) AS kept
      FROM gaps g JOIN h ON g.doc_id = h.doc_id GROUP BY g.doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN x ELSE kept || x[2 * last_e + 1 :] END)) AS kept_sha256
FROM h LEFT JOIN k ON h.doc_id = k.doc_id LEFT JOIN t ON h.doc_id = t.doc_id
"""


def op11_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return sketch.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of all documents, a third of them checked after tampering."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    doc_id, source, lang, n_chars, text = (F.col(c) for c in docs.columns)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    altered = merkle.leaf(doc_id, source, lang, n_chars, F.translate(text, upper, upper.lower()))
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", merkle.leaf(doc_id, source, lang, n_chars, text).alias("leaf"), F.when(chosen, altered).alias("altered"))
    found = merkle.manifest(leaves, tree="lang", order=["doc_id"], node="leaf").proofs()
    root = merkle.hexed(F.col("root"))
    return found.select(
        "doc_id",
        merkle.hexed(F.col("node")).alias("leaf"),
        merkle.hexed(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("altered", "node"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(depth: int) -> str:
    """SQL for trees of up to ``8 ** depth`` leaves: a table a level up, a table a level down."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def field(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def up(name: str) -> str:
        return "".join(
            f""",
{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, list(node ORDER BY pos) AS kids, sha256(string_agg(node, '' ORDER BY pos)) AS node
  FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 8, (n + 7) // 8)"""
            for k in range(depth)
        )

    def down(name: str, crown: str, extra: str) -> str:
        out = ""
        for k in range(depth, -1, -1):
            more = extra if k == 0 else ", c.kids"
            last = f"SELECT c.tree, c.pos{more}, c.node, w.subroot, w.root, w.path FROM {name}{k} c JOIN {crown} w ON c.tree = w.tree WHERE c.n = 1"
            beside = "[{'l': array_to_string(p.kids[1:c.pos % 8], ''), 'r': array_to_string(p.kids[c.pos % 8 + 2:], '')}]"
            inner = f"""
  UNION ALL SELECT c.tree, c.pos{more}, c.node, p.subroot, p.root, list_concat({beside}, p.path)
  FROM {name}{k} c JOIN {name}_p{k + 1} p ON c.tree = p.tree AND c.pos // 8 = p.pos WHERE c.n > 1"""
            out += f",\n{name}_p{k} AS ({last}{inner if k < depth else ''})"
        return out

    def tops(name: str) -> str:
        return " UNION ALL ".join(f"SELECT tree, node FROM {name}{k} WHERE n = 1" for k in range(depth + 1))

    return f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) AS r(i))),
d AS (SELECT *, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 3 = 0 ELSE false END AS chosen FROM documents, crc),
h AS (SELECT doc_id, coalesce(':' || lang, '-') AS tree, {leaf('text')} AS node,
    CASE WHEN chosen THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} END AS altered FROM d),
t0 AS (SELECT tree, doc_id, node, altered, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h){up('t')},
r0 AS (SELECT '' AS tree, tree AS name, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM ({tops('t')})){up('r')},
summit AS (SELECT '' AS tree, node AS root, CAST(NULL AS VARCHAR) AS subroot, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS path FROM ({tops('r')})){down('r', 'summit', ', c.name')},
crown AS (SELECT name AS tree, node AS subroot, root, path FROM r_p0){down('t', 'crown', ', c.doc_id, c.altered')}
SELECT doc_id, node AS leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.l || x.r), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_prepend({{'l': '', 'r': coalesce(altered, node)}}, path), lambda a, x: {{'l': '', 'r': sha256(x.l || a.r || x.r)}}).r AS folded_root FROM t_p0)
"""


OP12_SQL = _merkle_sql(7)

OP13_K, OP13_ROUNDS, OP13_DIMS, OP13_SALT = 40, 5, 64, "2:"


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings of 64 components."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return delta_kmeans.summary(*delta_kmeans.cluster(vectors, OP13_K, OP13_ROUNDS, OP13_DIMS, OP13_SALT))


def _lloyd_sql() -> str:
    k, dims = OP13_K, OP13_DIMS
    near = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    rounds = ""
    for r in range(OP13_ROUNDS + 1):
        rounds += f""",
a{r} AS MATERIALIZED (SELECT vec_id, v, d, j FROM (SELECT vec_id, v, j, d, row_number() OVER (PARTITION BY row ORDER BY d, j) AS best
  FROM (SELECT row, vec_id, v, j, CAST({near} AS BIGINT) AS d FROM x, c{r})) WHERE best = 1)"""
        if r < OP13_ROUNDS:
            rounds += f""",
m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT j, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) AS u(i) GROUP BY j, i) GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))"""
    last = OP13_ROUNDS
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, v) - 1 AS j, v AS c FROM (SELECT sha256('{OP13_SALT}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS key, v FROM x ORDER BY key, v LIMIT {k})){rounds}
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (j)
"""


OP13_SQL = _lloyd_sql()


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_knn_quality": op4_knn_quality,
    "op5_plane_files": op5_plane_files,
    "op6_masked_lm": op6_masked_lm,
    "op7_mix_sources": op7_mix_sources,
    "op8_media_archives": op8_media_archives,
    "op9_crf_language": op9_crf_language,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_threshold_sketch": op11_threshold_sketch,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_delta_lloyd": op13_delta_lloyd,
}

SQL = {
    "op1_quality_rules": OP1_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_delta_lloyd": OP13_SQL,
}
