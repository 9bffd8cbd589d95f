"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text's terms are its words and their shapes (``Aa``, ``a&&&``, ``A!!``), words equal to the one before and
lines equal to an earlier one, hashed into ``WORDS + SHAPES`` counts. Logarithms of the counts, weighted by
rarity, are projected onto the leading singular directions of the labelled sample. A document's score is
the vote of its ``k`` nearest labelled vectors by cosine, each weighted by a power of its similarity.

The labelled sample is bounded by ``max_rows``, a documented parameter; its vectors, the projection and the
labels are all that is broadcast, under 2 MB whatever the size of the corpus. Products of every document with
every labelled vector are exact and computed in blocks; documents are scored where they are read.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import per_task, release, slices

WORDS, SHAPES = 512, 512
TERMS = WORDS + SHAPES
SAME_WORD, SAME_LINE = zlib.crc32(b"\0word") % SHAPES + WORDS, zlib.crc32(b"\0line") % SHAPES + WORDS
#: Labelled rows at most, latent dimensions, voters and the power of their similarities.
MAX_ROWS, RANK, VOTERS, POWER = 4000, 48, 15, 4
#: Words that a task remembers the terms of.
MEMO_ENTRIES = 100_000
#: Texts whose products with all labelled vectors are computed together.
BLOCK = 500


def shape(word: str) -> str:
    """Letters and digits by kind, runs of a kind as one, other characters as they are."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:64])
    return re.sub(r"([Aa0])\1+", r"\1", kinds)[:12]


class _Terms(dict):
    """Word to the number of its word term and shape term, packed."""

    def __missing__(self, word: str) -> int:
        low = zlib.crc32(word.lower().encode()) % WORDS
        packed = low * SHAPES + zlib.crc32(shape(word).encode()) % SHAPES
        if len(self) < MEMO_ENTRIES:
            self[word] = packed
        return packed


def counts(texts: list[str | None], terms: _Terms | None = None) -> np.ndarray:
    """Term counts, a row for each text; null counts as empty. ``terms``: those that the task remembers."""
    get = (_Terms() if terms is None else terms).__getitem__
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in enumerate(texts):
        words = (text or "").split()
        if not words:
            continue
        packed = np.fromiter(map(get, words), np.int64, len(words))
        out[row, :WORDS] = np.bincount(packed // SHAPES, minlength=WORDS)
        out[row, WORDS:] = np.bincount(packed % SHAPES, minlength=SHAPES)
        out[row, SAME_WORD] += sum(map(operator.eq, words, islice(words, 1, None)))
        lines = text.split("\n")
        out[row, SAME_LINE] += len(lines) - len(set(lines))
    return out


class Model:
    """Projection, labelled vectors and labels."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, rank: int = RANK, voters: int = VOTERS, power: int = POWER):
        n = max(1, len(sample))
        self.rarity = np.log((1 + n) / (1 + (sample > 0).sum(axis=0))).astype(np.float32) + 1
        x = self._weighted(sample)
        values, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.voters, self.power = min(voters, len(labels)), power
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.known = self.vectors(sample).T.copy()

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        x = np.log1p(x) * self.rarity
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vectors(self, x: np.ndarray) -> np.ndarray:
        z = self._weighted(x) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None], terms: _Terms | None = None) -> np.ndarray:
        """Share of the vote for label 1; the sample's share of label 1 where nothing is similar."""
        if not self.voters:
            return np.full(len(texts), self.prior)
        near = self.vectors(counts(texts, terms)) @ self.known
        top = np.argpartition(near, -self.voters, axis=1)[:, -self.voters :]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** self.power
        total = weight.sum(axis=1)
        votes = (weight * self.labels[top]).sum(axis=1)
        return np.clip(np.where(total > 1e-6, votes / np.maximum(total, 1e-9), self.prior), 0, 1).astype(np.float64)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = _Terms()
    for batch in batches:
        for k in range(0, len(batch), BLOCK):
            part = batch.slice(k, BLOCK)
            rows = counts(part.column("text").to_pylist(), terms)
            own = [np.flatnonzero(x) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("order"), part.column("label"), pa.array([i.tolist() for i in own], pa.list_(pa.int32())), pa.array([x[i].tolist() for x, i in zip(rows, own)], pa.list_(pa.float32()))],
                ["order", "label", "terms", "counts"],
            )
    release()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> Model:
    """Model from at most ``max_rows`` labelled documents, those of the least hashes of their ids, then of their texts.

    Labels of documents that ``docs`` lacks are passed over before any are chosen, as are rows without a label or an id; several labels of one id count by their mean; a null text counts as
    empty; repeated rows are rows of their own. Reruns choose the same rows in the same order. Only term counts
    of the sample reach the driver, at most ``TERMS`` numbers a row. No labelled text gives a model of score 0.5.
    """
    ids = docs.select(F.col(doc_id).alias("_id"))
    usable = labels.where(F.col(label).isNotNull()).join(ids, F.col(doc_id) == F.col("_id"), "left_semi")
    known = usable.groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).cast("float").alias("_label"))
    # max_rows rows of an id and a label: this is what is broadcast
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.struct(F.xxhash64("_id"), F.col("_id").cast("string"), F.xxhash64("text"))
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(order.alias("order"), "text", F.col("_label").alias("label"))
    kind = sample.schema["order"].dataType.simpleString()
    counted = sample.mapInArrow(_sparse, f"order {kind}, label float, terms array<int>, counts array<float>")
    found = counted.orderBy("order").limit(max_rows).select("label", "terms", "counts").toArrow()
    x = np.zeros((len(found), TERMS), np.float32)
    for row, (terms, values) in enumerate(zip(found["terms"].to_pylist(), found["counts"].to_pylist())):
        x[row, terms] = values
    return Model(x, found["label"].to_numpy(), **options)


def score(text: Column, model: Model, spark) -> Column:
    """Column ``double`` from 0 to 1, higher where label 1 is likelier; null counts as the empty text."""
    shared = spark.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], pa.Array]:
        own, terms = shared.value, _Terms()

        def scores(batch: pa.Array) -> pa.Array:
            parts = [own.score(x.to_pylist(), terms) for x in slices(batch, BLOCK, 8 << 20)]
            return pa.array(np.concatenate(parts or [np.zeros(0)]))

        return scores

    return per_task(text, make, "double")


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that no model learns from; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
