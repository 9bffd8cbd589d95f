"""Language identification with a linear-chain conditional random field over words.

Every word of a text has a hidden language. Its emission weighs hashed features: n-grams of the word between
its marked ends, so that affixes are n-grams too, and the word itself as a lexicon entry. Learned
transitions tie neighbours together, so a text may switch language between words and short words follow
their surroundings. Forward-backward gives each word's posteriors; a text's language is the one with most
posterior mass over its words with letters, and its score is that share.

The field is trained in numpy on code-switched sequences, put together from segments of a bounded sample of
labelled documents (``per_lang`` documents a language, ``segments`` segments of each, spread over the whole
text). Weights of features and of transitions follow the gradient of one likelihood: what the field expects
less what the sequences show. They are all that is broadcast: ``1 << HASH_BITS`` rows by languages, 128 KB a
language. Documents are labelled where they are read, whole, many at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 15
#: The training sample: documents a language, segments a document, words a segment.
PER_LANG, SEGMENTS, SEGMENT_WORDS = 400, 6, 16
#: Emissions (words by languages) that a labeller remembers, and those whose posteriors are computed together, unless one text has more.
MEMO_CELLS, CELLS_AT_ONCE = 4_000_000, 6_000_000
UNDETERMINED = "und"


def letters(word: str) -> str:
    """The letters of a word in lower case."""
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hashed feature) of all features of words of letters, ordered by word."""
    marked = [b"\x02" + w.encode() + b"\x03" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    shift = np.uint64(64 - HASH_BITS)
    rows, codes = [], []
    code = np.zeros(len(data), np.uint64)
    for n in range(1, 6):
        code[: len(data) - n + 1] = (code[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
        if n >= 2:
            fits = np.flatnonzero(left >= n)
            rows.append(owner[fits])
            codes.append(((code[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    # the whole word: a polynomial of its bytes
    powers = np.cumprod(np.full(int(sizes.max(initial=1)) + 1, 0x100000001B3, np.uint64), dtype=np.uint64)
    inside = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    whole = np.add.reduceat(data * powers[inside], ends - sizes) if len(words) else np.zeros(0, np.uint64)
    rows.append(np.arange(len(words)))
    codes.append((whole * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift)
    row, code = np.concatenate(rows), np.concatenate(codes).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return row[order], code[order]


class Field:
    """Weights of a trained field."""

    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs = langs
        self.weights = np.zeros((1 << HASH_BITS, n), np.float32)
        self.moves = np.zeros((n, n), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        row, code = features(words)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        return np.add.reduceat(self.weights[code], starts, axis=0)

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Posterior of each language for each word. ``scores``: emissions of all sequences in a row.

        To ``pairs``, languages by languages, the expected numbers of neighbours are added.
        """
        out = np.empty_like(scores)
        if not len(scores):
            return out
        order = np.argsort(-lengths, kind="stable")
        own = lengths[order]
        steps = int(own[0])
        active = np.searchsorted(-own, -np.arange(steps), side="left")  # sequences longer than t
        offsets = np.append(0, np.cumsum(active))
        start = np.cumsum(lengths) - lengths
        # time-major: all first words, all second words, ...
        place = np.concatenate([start[order[:k]] + t for t, k in enumerate(active)])
        emit = scores[place]
        emit = np.exp(emit - emit.max(axis=1, keepdims=True))
        move = np.exp(self.moves - self.moves.max())
        ahead = np.empty_like(emit)
        ahead[: offsets[1]] = emit[: offsets[1]]
        for t in range(1, steps):
            a, b, k = offsets[t], offsets[t + 1], active[t]
            now = (ahead[offsets[t - 1] : offsets[t - 1] + k] @ move) * emit[a:b]
            now /= now.sum(axis=1, keepdims=True)
            ahead[a:b] = now
        behind = np.ones((active[-1], emit.shape[1]), emit.dtype)
        for t in range(steps - 1, -1, -1):
            a, b = offsets[t], offsets[t + 1]
            both = ahead[a:b] * behind
            out[place[a:b]] = both / both.sum(axis=1, keepdims=True)
            if t:
                if pairs is not None:
                    left, right = ahead[offsets[t - 1] : offsets[t - 1] + active[t]], behind * emit[a:b]
                    total = ((left @ move) * right).sum(axis=1, keepdims=True)
                    pairs += move * (left.T @ (right / total))
                before = np.ones((active[t - 1], emit.shape[1]), emit.dtype)
                back = (behind * emit[a:b]) @ move.T
                before[: active[t]] = back / back.sum(axis=1, keepdims=True)
                behind = before
        return out

    def train(self, segments: list[tuple[int, list[str]]], rounds: int = 40, rate: float = 0.5, seed: int = 1) -> Field:
        """Fit on code-switched sequences made of ``(language, words)`` segments."""
        rng = np.random.default_rng(seed)
        segments = [x for x in segments if x[1]]
        if not segments or len(self.langs) < 2:
            return self
        vocabulary: dict[str, int] = {}
        words, labels, lengths = [], [], []
        order = np.concatenate([rng.permutation(len(segments)) for _ in range(2)])
        k = 0
        while k < len(order):
            size = int(rng.integers(1, 5))
            total = 0
            for s in order[k : k + size]:
                lang, own = segments[s]
                words += [vocabulary.setdefault(w, len(vocabulary)) for w in own]
                labels += [lang] * len(own)
                total += len(own)
            lengths.append(total)
            k += size
        word, label, length = np.array(words), np.array(labels), np.array(lengths)
        row, code = features(list(vocabulary))
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        n, wide = len(self.langs), self.weights.shape[0]
        truth = np.eye(n, dtype=np.float32)[label]
        ends = np.cumsum(length) - 1
        inner = np.ones(len(word), bool)
        inner[ends] = False
        here = np.flatnonzero(inner)
        seen = np.zeros((n, n))
        np.add.at(seen, (label[here], label[here + 1]), 1)
        memory, move_memory = np.full((wide, n), 1e-6, np.float32), np.full((n, n), 1e-6)
        per_lang = np.maximum(truth.sum(axis=0), 1)
        balance = (len(word) / (n * per_lang))[label][:, None].astype(np.float32)
        for _ in range(rounds):
            scores = np.add.reduceat(self.weights[code], starts, axis=0)
            pairs = np.zeros((n, n))
            error = (self.posteriors(scores[word], length, pairs) - truth) * balance
            pull = pairs - seen + 0.01 * self.moves
            move_memory += pull * pull
            self.moves = (self.moves - rate * pull / np.sqrt(move_memory)).astype(np.float32)
            slope = np.empty((wide, n), np.float32)
            for j in range(n):
                by_word = np.bincount(word, weights=error[:, j], minlength=len(vocabulary))
                slope[:, j] = np.bincount(code, weights=by_word[row], minlength=wide)
            slope += 0.01 * self.weights
            memory += slope * slope
            self.weights -= rate * slope / np.sqrt(memory)
        return self


class Labeller:
    """A field with the emissions of words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1, len(self.field.langs)), np.float32)  # row 0: no letters

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.row) * max(1, len(self.field.langs)) > MEMO_CELLS:
            self.clear()
        split = [(x or "").split() for x in texts]
        new = list(set().union(*split).difference(self.row))
        plain = list(map(letters, new))
        named = [w for w in plain if w]
        at = iter(range(len(self.table), len(self.table) + len(named)))
        self.row.update((w, next(at) if p else 0) for w, p in zip(new, plain))
        if named:
            self.table = np.concatenate([self.table, *(self.field.emissions(named[k : k + 50_000]) for k in range(0, len(named), 50_000))])
        get = self.row.__getitem__
        rows = [np.fromiter(map(get, own), np.int64, len(own)) for own in split]
        rows = [x[x > 0] for x in rows]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.field.langs:
            return langs, scores
        sizes = np.array([len(x) for x in rows], np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            posterior = self.field.posteriors(self.table[np.concatenate([rows[i] for i in some])], sizes[some])
            starts = np.cumsum(sizes[some]) - sizes[some]
            mass = np.add.reduceat(posterior, starts, axis=0, dtype=np.float64)
            share = mass / mass.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            for i, b, s in zip(some.tolist(), best.tolist(), share[np.arange(len(best)), best].tolist()):
                langs[i], scores[i] = self.field.langs[b], min(1.0, s)
        return langs, scores


@functools.lru_cache(maxsize=1)
def labeller(field: Field) -> Labeller:
    """The labeller of a field; a worker reads a broadcast field once, so its identity is the key."""
    return Labeller(field)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            own = [w for w in map(letters, text.split()) if w]
            spread = np.unique(np.linspace(0, max(0, len(own) - SEGMENT_WORDS), SEGMENTS).astype(int))
            out.append([own[a : a + SEGMENT_WORDS] for a in spread])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(out, pa.list_(pa.list_(pa.string())))], ["id", "lang", "segments"])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Field:
    """A field from the documents with a text and a language, at most ``per_lang`` of each language.

    Those of the least id hashes are taken; of rows that share id and language, the one of the least segments.
    Every language is learnt, however many there are. Without any labelled text the field knows no language and
    calls every text undetermined.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = known.select("id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= per_lang).select("id", "lang")
    sample = known.join(F.broadcast(chosen), ["id", "lang"]).select("id", "lang", "text")
    segments = sample.mapInArrow(_segments, sample.select("id", "lang").withColumn("segments", F.lit(None).cast("array<array<string>>")).schema)
    rows = segments.groupBy("id", "lang").agg(F.min("segments").alias("segments")).select("lang", F.explode("segments").alias("words"))
    found = rows.toArrow().to_pylist()
    number = {x: i for i, x in enumerate(langs)}
    return Field(langs).train(sorted((number[x["lang"]], x["words"]) for x in found))


def language(text: Column, field: Field, spark) -> Column:
    """Column ``struct<lang:string,score:double>``; ``und`` and 0 where a text is null or has no letter."""
    shared = spark.sparkContext.broadcast(field)

    def labels(batch: pa.Array) -> pa.Array:
        own = labeller(shared.value)
        langs, scores = [], []
        sizes = np.cumsum([len(x or "") for x in batch.to_pylist()])
        part = sizes // (6 * CELLS_AT_ONCE // max(1, len(own.field.langs)))
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(batch)) if len(batch) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            got = own.label(batch[int(a) : int(b)].to_pylist())
            langs += got[0]
            scores += got[1]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.arrow_udf(labels, "struct<lang:string,score:double>")(text)
