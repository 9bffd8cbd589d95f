"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The network predicts each token from the ``SIDE`` tokens on either side of it, the token itself being masked.
A document's score is the sum of the logarithms of these conditional probabilities. Probabilities are exact:
the output is a softmax over classes times a softmax over the tokens of a class, so a token costs the square
root of the vocabulary and never an approximation of its normaliser.

Tokens are lower-case words. The ``VOCABULARY`` most frequent ones by a count over the whole corpus have
numbers of their own; every other word shares one of ``RARE`` numbers by its hash, and its probability under that
number is that of its spelling, by pairs of bytes counted over all rare words of the corpus. So every
word has a probability of its own, one never seen included.

Texts are split and numbered once, and written in ``ROUNDS`` folds with what their spelling costs; training and scores
of the same texts read these numbers. Training is data-parallel and uses every position of the corpus ``EPOCHS`` times. A step takes one fold: each task sums the gradient of its positions at the step's weights, as
whole numbers in fixed point, Spark sums these by block of weights, and the driver takes one step of Adam. Sums do not
depend on how rows are dealt to tasks, so neither do the weights, but for the rounding of products. Output biases begin at the
counted frequencies, so the untrained network is the unigram model and training can only be measured against it.
What is gathered grows with the corpus; what the driver holds is one set of weights, some 200,000 numbers.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, forget, per_task, slices

SIDE = 2
VOCABULARY, RARE = 1984, 63
CLASSES = 32
DIMENSION = 32
ROUNDS, EPOCHS = 16, 1
#: Step size of Adam, its decays, and positions whose gradient is computed together.
RATE, DECAY, DECAY_SQUARE, BATCH = 0.2, 0.7, 0.9, 8192
#: Batches whose gradients are added up in 32 bits before they join a task's sum in 64.
BATCHES = 8
#: Weights that are summed as one row, and the fixed point of sums: 2 ** 63 / 2 ** 20 leaves room for 10 ** 12 positions.
WEIGHT_BLOCK, FIXED = 256, float(1 << 20)
#: Rows of a key up to which they are summed with those of other keys.
TOGETHER = 24
#: Places whose word vectors are looked up together.
PLACES = 512
#: Exponentials of logits within this of 0 neither overflow in 32 bits nor vanish.
SAFE = 80
OFFSETS = [j for j in range(-SIDE, SIDE + 1) if j]


class Net:
    """Weights: token vectors by offset, class outputs and token outputs; and the logarithms of spelling probabilities."""

    def __init__(self, words: list[str], counts: np.ndarray | None = None, spelling: np.ndarray | None = None):
        """``counts``: occurrences of the words, then of the rare numbers. ``spelling``: counts of byte after byte."""
        self.words = words
        self.number = {w: i for i, w in enumerate(words)}
        self.ended = pa.array([w + " " for w in words], pa.string())
        used = len(words) + RARE + 1  # the last number pads the ends of a text
        self.per_class = -(-used // CLASSES)
        self.size = self.per_class * CLASSES
        self.pad = used - 1
        self.first_rare = len(words)
        rng = np.random.default_rng(5)
        self.shapes = [(2 * SIDE, self.size, DIMENSION), (DIMENSION, CLASSES), (CLASSES,), (CLASSES, DIMENSION, self.per_class), (CLASSES, self.per_class)]
        scale = [0.3, 0.1, 0, 0.1, 0]
        self.load(np.concatenate([(rng.normal(size=s) * k).ravel() for s, k in zip(self.shapes, scale)]))
        n = np.full(self.size, 0.1)
        if counts is not None:
            n[: len(counts)] += counts
        # the most frequent words are dealt out over the classes in turn
        n = n.reshape(self.per_class, CLASSES).T
        self.class_bias[:] = np.log(n.sum(axis=1) / n.sum())
        self.token_bias[:] = np.log(n / n.sum(axis=1, keepdims=True))
        self.load(self.flat)
        pairs = np.full((256, 256), 0.01) + (0 if spelling is None else spelling)
        self.spelling = np.log(pairs / pairs.sum(axis=1, keepdims=True))

    def load(self, flat: np.ndarray) -> None:
        """Take all weights from one flat array."""
        self.flat = np.ascontiguousarray(flat, np.float32)
        self.inputs, self.to_class, self.class_bias, self.to_token, self.token_bias = self.parts(self.flat)
        # all offsets' vectors of a word in one row; biases as a row more of the outputs
        self.by_word = np.ascontiguousarray(self.inputs.transpose(1, 0, 2)).reshape(self.size, -1)
        self.class_out = np.concatenate([self.to_class, self.class_bias[None]])
        self.token_out = np.concatenate([self.to_token, self.token_bias[:, None]], axis=1)
        # hidden values lie between -1 and 1
        self.safe = bool(max(np.abs(self.class_out).sum(axis=0).max(), np.abs(self.token_out).sum(axis=1).max()) < SAFE)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        """Views of a flat array of weights, or of their gradient."""
        parts = np.split(flat, np.cumsum([np.prod(s) for s in self.shapes])[:-1].astype(int))
        return [p.reshape(s) for p, s in zip(parts, self.shapes)]

    def token(self, word: str) -> int:
        got = self.number.get(word)
        return self.first_rare + zlib.crc32(word.encode()) % RARE if got is None else got

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers of all texts in a row, the log-probability of each token's spelling (0 in the vocabulary), and each text's number of tokens.

        Words lie behind each other as bytes, each with the blank that ends it, and equal ones are looked up once.
        """
        rows = [split_words(x) for x in texts]
        sizes = np.array([len(x) for x in rows], np.int64)
        if not sizes.any():
            return np.zeros(0, np.int32), np.zeros(0), sizes
        data = (" ".join(itertools.chain.from_iterable(rows)) + " ").encode()
        ends = np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1).astype(np.int32)
        words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        own, index = words.dictionary, words.indices.to_numpy()
        number = pc.index_in(own, value_set=self.ended).fill_null(-1).to_numpy().copy()
        rare = np.flatnonzero(number < 0)
        own = own.take(pa.array(rare)).cast(pa.binary())
        found = np.fromiter((zlib.crc32(x[:-1]) for x in own.to_pylist()), np.int64, len(rare))
        number[rare] = self.first_rare + found % RARE
        cost = np.zeros(len(number))
        if len(rare):
            stops = np.frombuffer(own.buffers()[1], np.int32)[: len(rare) + 1]
            code = np.frombuffer(own.buffers()[2], np.uint8)[: stops[-1]]
            code = np.where(code == 32, 0, code)  # no word holds a blank, so these are the ends
            cost[rare] = np.add.reduceat(self.spelling[np.append(0, code[:-1]), code], stops[:-1])
        return number[index], cost[index], sizes

    def hidden(self, run: np.ndarray) -> np.ndarray:
        """Hidden values at all places of a run of tokens but ``SIDE`` at each end, and a 1 behind them."""
        n = len(run) - 2 * SIDE
        out = np.empty((n, DIMENSION + 1), np.float32)
        out[:, DIMENSION] = 1
        for b in range(0, n, PLACES):
            size = min(PLACES, n - b)
            rows = self.by_word[run[b : b + size + 2 * SIDE]]
            total = rows[SIDE + OFFSETS[0] :][:size, :DIMENSION].copy()
            for j, away in enumerate(OFFSETS[1:], 1):
                total += rows[SIDE + away :][:size, j * DIMENSION : (j + 1) * DIMENSION]
            np.tanh(total, out=out[b : b + size, :DIMENSION])
        return out

    def _sorted(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Places in order of their tokens' classes, hidden values and tokens in that order, and where each class begins and ends."""
        target = padded[at]
        order = _order(target % CLASSES)
        target = target[order]
        h = self.hidden(padded[at[0] - SIDE : at[-1] + SIDE + 1])[(at - at[0])[order]]
        return order, h, target, np.searchsorted(target % CLASSES, np.arange(CLASSES + 1)).tolist()

    def log_probabilities(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of each token at the places ``at`` of padded texts, in ascending order, between its neighbours."""
        # the most frequent words are dealt out over the classes in turn
        order, h, target, bounds = self._sorted(padded, at)
        logits = h @ self.class_out
        found = logits[np.arange(len(at)), target % CLASSES]
        found -= _log_sum(logits, self.safe)
        for c in range(CLASSES):
            a, b = bounds[c], bounds[c + 1]
            if a < b:
                logits = h[a:b] @ self.token_out[c]
                found[a:b] += logits[np.arange(b - a), target[a:b] // CLASSES]
                found[a:b] -= _log_sum(logits, self.safe)
        out = np.empty_like(found)
        out[order] = found
        return out

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target between its neighbours."""
        return self.log_probabilities(*_apart(context, target))

    def sums(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of the log-probabilities of each text's numbers."""
        padded, at = _padded(numbers, sizes, self.pad), _places(sizes)
        found = [self.log_probabilities(padded, at[b : b + BATCH]) for b in range(0, len(at), BATCH)]
        ends = np.append(0, np.cumsum(np.concatenate(found or [np.zeros(0)]), dtype=np.float64))
        stops = np.append(0, np.cumsum(sizes))
        return ends[stops[1:]] - ends[stops[:-1]]

    def gradient(self, context: np.ndarray, target: np.ndarray, total: np.ndarray) -> None:
        """Add the gradient of the targets' negative log-probability to ``total``, a flat array like the weights."""
        self.add_gradient(*_apart(context, target), total)

    def add_gradient(self, padded: np.ndarray, at: np.ndarray, total: np.ndarray) -> None:
        """As ``gradient``, of the tokens at the places ``at`` of padded texts, in ascending order."""
        inputs, to_class, class_bias, to_token, token_bias = self.parts(total)
        order, h, target, bounds = self._sorted(padded, at)
        error = _softmax(h @ self.class_out, self.safe)
        error[np.arange(len(at)), target % CLASSES] -= 1
        back = error @ self.to_class.T
        slope = h.T @ error
        to_class += slope[:-1]
        class_bias += slope[-1]
        for c in range(CLASSES):
            a, b = bounds[c], bounds[c + 1]
            if a < b:
                inner = _softmax(h[a:b] @ self.token_out[c], self.safe)
                inner[np.arange(b - a), target[a:b] // CLASSES] -= 1
                back[a:b] += inner @ self.to_token[c].T
                slope = h[a:b].T @ inner
                to_token[c] += slope[:-1]
                token_bias[c] += slope[-1]
        h = h[:, :-1]
        back *= 1 - h * h
        # A row for each place of the run, between SIDE rows of zeros more at each end. What reaches a place's token lies in the
        # 2 * SIDE + 1 rows around it, those of places that see it from the right first: one wide row, summed by token.
        run = padded[at[0] - SIDE : at[-1] + SIDE + 1]
        rows = np.zeros((len(run) + 2 * SIDE, DIMENSION), np.float32)
        rows[(at - at[0])[order] + 2 * SIDE] = back
        wide = np.lib.stride_tricks.as_strided(rows, (len(run), (2 * SIDE + 1) * DIMENSION), rows.strides)
        own, reached = _summed_by(run, wide)
        for j, away in enumerate(OFFSETS):
            inputs[j, own] += reached[:, (SIDE - away) * DIMENSION : (SIDE - away + 1) * DIMENSION]


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers; numpy sorts those of 16 bits by radix."""
    return np.argsort(x.astype(np.min_scalar_type(int(x.max(initial=0)))), kind="stable")


def _summed_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, most frequent first, and the sum of the rows of each.

    Frequent keys are summed one by one; of the others all first rows are taken together, then all second ones and so on.
    """
    order = _order(keys)
    own = keys[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    sizes = np.diff(np.append(first, len(own)))
    falling = np.argsort(-sizes, kind="stable")
    first, sizes = first[falling], sizes[falling]
    found = own[first]
    out = np.zeros((len(first), rows.shape[1]), rows.dtype)
    n = int(np.searchsorted(-sizes, -TOGETHER, "right"))  # keys with more than TOGETHER rows, and those of just as many
    for i in range(n):
        out[i] = np.ones(sizes[i], rows.dtype) @ rows[order[first[i] : first[i] + sizes[i]]]
    first, sizes = first[n:], sizes[n:]
    for k in range(int(sizes.max(initial=0))):
        m = int(np.searchsorted(-sizes, -k, "left"))
        out[n : n + m] += rows[order[first[:m] + k]]
    return found, out


def _log_sum(x: np.ndarray, safe: bool) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row; ``x`` is used up. ``safe``: they fit as they are."""
    top = 0 if safe else x.max(axis=1)
    if not safe:
        x -= top[:, None]
    return top + np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))


def _softmax(x: np.ndarray, safe: bool) -> np.ndarray:
    """Probabilities of each row, written over ``x``."""
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _apart(context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Targets between their neighbours, one behind the other, and their places."""
    return np.column_stack([context[:, :SIDE], target, context[:, SIDE:]]).ravel(), np.arange(len(target)) * (2 * SIDE + 1) + SIDE


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows(rows: list[np.ndarray], net: Net) -> tuple[np.ndarray, np.ndarray]:
    """Padded token numbers of all texts in a row, and the number of tokens of each."""
    sizes = np.array([len(x) for x in rows], np.int64)
    return _padded(np.concatenate([*rows, np.zeros(0, np.int64)]), sizes, net.pad), sizes


def _padded(numbers: np.ndarray, sizes: np.ndarray, pad: int) -> np.ndarray:
    """Numbers of all texts in a row, each between ``SIDE`` pads at either end."""
    padded = np.full(int(sizes.sum()) + 2 * SIDE * len(sizes), pad, np.int64)
    padded[_places(sizes)] = numbers
    return padded


def _lists(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all lists in a row, and the length of each."""
    return batch.flatten().to_numpy(), pc.list_value_length(batch).fill_null(0).to_numpy().astype(np.int64)


def _places(sizes: np.ndarray) -> np.ndarray:
    """Index of each token among the padded numbers."""
    return np.arange(int(sizes.sum())) + np.repeat(2 * SIDE * np.arange(len(sizes)) + SIDE, sizes)


def _numbered(shared):
    """Texts as arrays of token numbers, and the log-probability of their rare words' spelling."""

    def make() -> Callable[[pa.Array], pa.Array]:
        net: Net = shared.value

        def numbers(batch: pa.Array) -> pa.Array:
            lists, costs = [pa.array([], pa.list_(pa.int32()))], [np.zeros(0)]
            for texts in slices(batch, 500):
                found, cost, sizes = net.numbers(texts.to_pylist())
                stops = np.append(0, np.cumsum(sizes))
                lists.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(found, pa.int32())))
                ends = np.append(0, np.cumsum(cost))
                costs.append(ends[stops[1:]] - ends[stops[:-1]])
            return pa.StructArray.from_arrays([pa.concat_arrays(lists), pa.array(np.concatenate(costs))], ["ids", "spelling"])

        return numbers

    return make


def _gradients(shared):
    """The sum of the gradients of all positions of a task, in blocks, and the number of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Net = shared.value
        total, now = np.zeros(len(net.flat), np.float64), np.zeros(len(net.flat), np.float32)
        added = seen = 0
        for batch in batches:
            ids = batch.column("ids")
            for part in slices(ids, 2000, 1 << 18):
                numbers, sizes = _lists(part)
                padded, at = _padded(numbers, sizes, net.pad), _places(sizes)
                for b in range(0, len(at), BATCH):
                    net.add_gradient(padded, at[b : b + BATCH], now)
                    added += 1
                    if added % BATCHES == 0:
                        total += now
                        now[:] = 0
                seen += len(at)
        total += now
        if seen:
            rows = np.round(np.append(total, np.zeros(-len(total) % WEIGHT_BLOCK)) * FIXED).astype(np.int64)
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows), WEIGHT_BLOCK).cast(pa.list_(pa.int64()))
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), values, pa.array(np.full(n, seen))], ["block", "slope", "n"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of weights that a task meets: the sums of its gradients and positions, both whole numbers."""
    total: dict[int, np.ndarray] = {}  # at most all blocks, 2 MB
    for batch in batches:
        slopes = batch.column("slope").flatten().to_numpy().reshape(-1, WEIGHT_BLOCK)
        for block, row in zip(batch.column("block").to_pylist(), np.column_stack([slopes, batch.column("n").to_numpy()])):
            total[block] = total[block] + row if block in total else row
    if total:
        rows = np.stack([*total.values()])
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows[:, :-1].ravel()), WEIGHT_BLOCK).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), values, pa.array(rows[:, -1])], ["block", "slope", "n"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte after byte in words, ends included."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        words, n = [x.encode() for x in batch.column("word").to_pylist()], batch.column("n").to_numpy()
        data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        weight = np.repeat(n, [len(x) + 1 for x in words])
        total += np.bincount(data[:-1] << 8 | data[1:], weight, 1 << 16).astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "n"])


def start(docs: DataFrame, text: str = "text", size: int = VOCABULARY) -> Net:
    """The untrained network: the vocabulary, ties in order of the words, and what is counted of rare words."""
    spoken = docs.select(F.explode(F.split(F.lower(text), r"[\s\x1c-\x1f\x85\p{Z}]+")).alias("word")).where("word <> ''")
    counted = cut(spoken.groupBy("word").agg(F.count("*").alias("n")), "words")
    top = counted.orderBy(F.desc("n"), "word").limit(size).collect()  # size words
    # the least frequent word of the vocabulary bounds it, so that no list of words is needed to find the others
    least = top[-1] if len(top) == size else None
    rare = counted.where("false") if least is None else counted.where((F.col("n") < least["n"]) | ((F.col("n") == least["n"]) & (F.col("word") > least["word"])))
    buckets = {r["bucket"]: r["n"] for r in rare.groupBy((F.crc32("word") % RARE).cast("int").alias("bucket")).agg(F.sum("n").alias("n")).collect()}
    spelling = np.zeros(1 << 16)
    # 65,536 pairs of bytes at most
    for r in rare.mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        spelling[r["pair"]] = r["n"]
    counts = np.array([r["n"] for r in top] + [buckets.get(b, 0) for b in range(RARE)], np.float64)
    forget(counted)
    return Net([r["word"] for r in top], counts, spelling.reshape(256, 256))


def number(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """A table of all rows: ``doc_id``, the text's token numbers ``ids``, ``spelling`` and its ``fold``. Texts are read and split this once."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    fold = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(rounds)).cast("int")
    found = docs.select(F.col(doc_id), fold.alias("fold"), per_task(F.col(text), _numbered(shared), "struct<ids:array<int>,spelling:double>").alias("x"))
    table = cut(found.select(doc_id, "fold", "x.ids", "x.spelling"), "numbers", "fold")
    shared.destroy()
    return table


def train(net: Net, numbered: DataFrame, rounds: int = ROUNDS, epochs: int = EPOCHS) -> None:
    """Train the network on every position of the table that ``number`` gave."""
    spark = numbered.sparkSession
    mean, square = np.zeros(len(net.flat)), np.zeros(len(net.flat))
    steps = 0
    for r in [*range(rounds)] * epochs:
        shared = spark.sparkContext.broadcast(net)
        form = "block int, slope array<long>, n long"
        slopes = numbered.where(F.col("fold") == r).select("ids").mapInArrow(_gradients(shared), form)
        found = slopes.repartition("block").mapInArrow(_summed, form).toArrow().sort_by("block").combine_chunks()  # a row a block
        shared.destroy()
        if not len(found):
            continue
        slope = found["slope"].combine_chunks().flatten().to_numpy().reshape(-1, WEIGHT_BLOCK).astype(np.float64)
        slope = (slope / FIXED / found["n"].to_numpy()[:, None]).ravel()[: len(net.flat)]
        steps += 1
        mean = DECAY * mean + (1 - DECAY) * slope
        square = DECAY_SQUARE * square + (1 - DECAY_SQUARE) * slope * slope
        rate = RATE * (1 - (steps - 1) / (rounds * epochs))  # falls to nothing
        step = mean / (1 - DECAY**steps) / (np.sqrt(square / (1 - DECAY_SQUARE**steps)) + 1e-5)
        net.load(net.flat - rate * step)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, epochs: int = EPOCHS, size: int = VOCABULARY) -> Net:
    """A network trained on every position of all texts.

    Null texts have no positions; repeated rows count as often as they occur; rows without an id are trained on like others.
    An empty corpus leaves the initial weights.
    """
    net = start(docs, text, size)
    numbered = number(docs, net, doc_id, text, rounds)
    train(net, numbered, rounds, epochs)
    forget(numbered)
    return net


def fit_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, epochs: int = EPOCHS, size: int = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``log_prob`` of all rows under the network that ``fit`` trains on them.

    The same as ``score`` of the texts, up to rounding, but from the numbers that training reads: no text is split twice.
    """
    net = start(docs, text, size)
    numbered = number(docs, net, doc_id, text, rounds)
    train(net, numbered, rounds, epochs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make() -> Callable[[pa.Array], pa.Array]:
        own: Net = shared.value

        def sums(batch: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(0), *(own.sums(*_lists(x)) for x in slices(batch, 2000, 1 << 18))]))

        return sums

    return numbered.select(doc_id, F.size("ids").cast("long").alias("n_tokens"), (per_task(F.col("ids"), make, "double") + F.col("spelling")).alias("log_prob"))


def score(text: Column, net: Net, spark) -> Column:
    """Column ``struct<n_tokens:long,log_prob:double>``: tokens and pseudo-log-likelihood of a text.

    Null and empty texts have no tokens and log-probability 0. Repeated rows have equal scores, up to rounding.
    """
    shared = spark.sparkContext.broadcast(net)

    def make() -> Callable[[pa.Array], pa.Array]:
        own: Net = shared.value
        numbers = _numbered(shared)()

        def scores(batch: pa.Array) -> pa.Array:
            found = numbers(batch)
            ids, spelling = found.field("ids"), found.field("spelling").to_numpy()
            sums = np.concatenate([np.zeros(0), *(own.sums(*_lists(x)) for x in slices(ids, 2000, 1 << 18))])
            return pa.StructArray.from_arrays([pc.list_value_length(ids).cast(pa.int64()), pa.array(sums + spelling)], ["n_tokens", "log_prob"])

        return scores

    return per_task(text, make, "struct<n_tokens:long,log_prob:double>")
