"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (bytes, with word ends marked), hashed into buckets; a window of words
is the average of the bucket vectors, and a two-way softmax stands on it. Vectors and softmax are trained together
in numpy. A misspelling nobody has labelled shares most n-grams with its word and so most of its vector.

Labels are for whole documents while few of a toxic document's words are toxic, so training is multi-instance: all
windows of a clean document are negative; of a toxic document only the windows that the current model ranks
highest are positive. A document's score is that of its highest window.

The model is fitted on a bounded sample (documented parameters), in a task of its own that hands back BUCKETS numbers;
every document is scored whole. As the layers are linear, a word's part of the logit is a single number, which is worked
out once per distinct word of a group of documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash
from .common import own_names, ragged, steps, tidy

BUCKETS, DIMENSIONS, GRAMS, WINDOW = 1 << 17, 8, (3, 4, 5, 6), 3
#: Documents, and about the bytes of them, scored in one step.
GROUP, GROUP_BYTES = 256, 1 << 18
#: At most so many labelled documents of each class are learnt from, each with its whole text, and so many bytes of
#: them; a document that would exceed the bytes is passed over.
SAMPLE, SAMPLE_BYTES = 1500, 24 << 20
#: A bucket that fewer documents of the sample hold has no weight.
MIN_DOCUMENTS, MIN_SHARE = 3, 0.003
ROUNDS, EPOCHS, RATE, DECAY, SEED = 4, 4, 0.03, 3e-5, 5
#: Windows of either class that a round draws at random.
WINDOWS = 12_000
#: How much more a clean document lost weighs than a toxic one missed: clean ones are the greater part.
CLEAN_WEIGHT = 4.0
#: Words of the sample whose n-grams are cut in one step.
WORDS_AT_ONCE = 20_000


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): the n-gram buckets of the words at these places in order, and how many each has.

    Each word is lower-cased and put between < and >.
    """
    size = end - start
    last = np.cumsum(size + 2)
    first = last - size - 2
    marked = np.empty(last[-1] if len(last) else 0, np.uint8)
    marked[first], marked[last - 1] = ord("<"), ord(">")
    inside = np.ones(len(marked), bool)
    inside[first] = inside[last - 1] = False
    marked[inside] = text_hash.LOWER[data[ragged(start, size)]]
    of = np.repeat(np.arange(len(size)), size + 2)
    left = last[of] - np.arange(len(marked))  # bytes from here to the word's end
    sums, per = text_hash.prefix(marked), np.array(GRAMS)
    # The n-grams that begin at one byte follow one another, so that a word's are together.
    counts = np.minimum(left, per[-1]) - per[0] + 1
    counts = np.maximum(counts, 0)
    at = np.repeat(np.arange(len(marked)), counts)
    n = ragged(np.full(len(marked), per[0]), counts)
    found = text_hash.ranges(sums, at, at + n) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return found.astype(np.int64), np.bincount(of, counts, len(size)).astype(np.int64)


@dataclass
class Model:
    """Logit of a window = its words' summed bucket weights, over its n-grams, plus ``bias``.

    A bucket's weight is its vector times the difference of the two softmax columns, so a word's part is one number.
    """

    weight: np.ndarray
    bias: float
    window: int = WINDOW

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1 per text: its highest window's probability. A text without words scores as an empty window."""
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        start, end = text_hash.word_bounds(data)
        logit = np.full(len(texts), min(self.bias, -1.0))
        if len(start):
            owner = text_hash.owners(texts, start)
            n = np.bincount(owner, minlength=len(texts))
            parts, full = self._parts(data, start, end), np.flatnonzero(n)
            begin = np.cumsum(n) - n
            k = -(-n // self.window)
            at = np.repeat(begin - (np.cumsum(k) - k) * self.window, k) + np.arange(k.sum()) * self.window
            sums = np.add.reduceat(parts, at, axis=0)
            window = sums[:, 0] / np.maximum(sums[:, 1], self.window * 16) + self.bias
            logit[full] = np.maximum.reduceat(window, (np.cumsum(k) - k)[full])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def _parts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(summed weight, number of n-grams) of each word."""
        key = text_hash.ranges(text_hash.prefix(data), start, end)
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        found, counts = grams(data, start[first], end[first])
        sums = np.bincount(np.repeat(np.arange(len(first)), counts), self.weight[found], len(first))
        return np.stack([sums, counts], 1)[same]


def _grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum([len(w) for w in words])
    return grams(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], end[:-1]]), end)


def _summed(values: np.ndarray, first: np.ndarray, count: np.ndarray, kind: type) -> np.ndarray:
    """Sums of the runs of ``values`` that begin at ``first``, one after the other; an empty run sums to 0."""
    out, some = np.zeros(len(count), kind), count > 0
    if some.any():
        out[some] = np.add.reduceat(values, first[some], dtype=kind)
    return out


class _Bags:
    """The windows of the sample as bags of n-gram buckets that enough documents hold, renumbered."""

    def __init__(self, texts: list[bytes]):
        vocabulary: dict[bytes, int] = {}
        docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t.split()), np.int32) for t in texts]
        words = list(vocabulary) or [b""]
        done = [_grams_of(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)]
        found, counts = np.concatenate([f.astype(np.int32) for f, _ in done]), np.concatenate([c for _, c in done])
        begin, documents = np.cumsum(counts) - counts, np.zeros(BUCKETS, np.int64)
        for ids in docs:
            own = np.unique(ids)
            documents[np.unique(found[ragged(begin[own], counts[own])])] += 1
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        windows = -(-size // WINDOW)
        self.owner = np.repeat(np.arange(len(docs)), windows)
        last = np.cumsum(windows)[windows > 0] - 1
        self.n = np.full(windows.sum(), WINDOW)
        self.n[last] = (size - (windows - 1) * WINDOW)[windows > 0]
        self.begin = np.cumsum(self.n) - self.n
        self.flat = np.concatenate(docs) if docs else np.empty(0, np.int32)
        self.buckets = np.flatnonzero(documents >= max(MIN_DOCUMENTS, MIN_SHARE * len(texts)))
        number = np.full(BUCKETS, -1, np.int32)
        number[self.buckets] = np.arange(len(self.buckets))
        known = number[found] >= 0
        self.grams, self.all_counts = number[found[known]], counts
        self.counts = _summed(known, np.cumsum(counts) - counts, counts, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def logits(self, state) -> np.ndarray:
        """Of all windows, through one number per word."""
        weight = (state[0] @ (state[1][:, 1] - state[1][:, 0])).astype(np.float32)
        of_word = _summed(weight[self.grams], self.first[:-1], self.counts, np.float64)
        row = np.repeat(np.arange(len(self.n)), self.n)
        size = np.maximum(np.bincount(row, self.all_counts[self.flat], len(self.n)), WINDOW * 16)
        return np.bincount(row, of_word[self.flat], len(self.n)) * WINDOW / size + (state[2][1] - state[2][0])

    def of(self, chosen: np.ndarray):
        """(bucket, window, scale): the buckets of these windows, the window of each, and 1 / n-grams per window."""
        ids = self.flat[ragged(self.begin[chosen], self.n[chosen])]
        row = np.repeat(np.arange(len(chosen)), self.n[chosen])
        g = self.counts[ids]
        flat = ragged(self.first[ids], g)
        size = np.maximum(np.bincount(row, self.all_counts[ids], len(chosen)), WINDOW * 16)
        return self.grams[flat], np.repeat(row, g), np.float32(WINDOW) / size.astype(np.float32)


def _fit(bags: _Bags, positive: np.ndarray, negative: np.ndarray, epochs: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, softmax and its bias, trained together by Adam on the given windows; classes weigh the same."""
    vectors = rng.normal(0, 0.1, (len(bags.buckets), DIMENSIONS)).astype(np.float32)
    top = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    state = [vectors, top, np.zeros(2, np.float32)]
    first, second = [np.zeros_like(v) for v in state], [np.zeros_like(v) for v in state]
    use, is_positive = np.concatenate([positive, negative]), np.zeros(len(bags.n), bool)
    is_positive[positive] = True
    weigh = 0.5 * len(use) / np.array([max(1, len(negative)), max(1, len(positive))], np.float32)
    step = 0
    for _ in range(epochs):
        rng.shuffle(use)
        for at in range(0, len(use), 512):
            chosen = use[at : at + 512]
            label = is_positive[chosen].astype(np.int64)
            bucket, row, scale = bags.of(chosen)
            hidden = np.stack([np.bincount(row, state[0][bucket, d], len(chosen)) for d in range(DIMENSIONS)], 1).astype(np.float32) * scale[:, None]
            p = _softmax(hidden @ state[1] + state[2])
            grad = (p - np.eye(2, dtype=np.float32)[label]) * (weigh[label] / len(chosen))[:, None]
            back = (grad @ state[1].T) * scale[:, None]
            of_vectors = np.stack([np.bincount(bucket, back[row, d], len(bags.buckets)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            step += 1
            for i, g in enumerate((of_vectors + DECAY * state[0], hidden.T @ grad, grad.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                state[i] -= np.float32(RATE) * (first[i] / np.float32(1 - 0.9**step)) / (np.sqrt(second[i] / np.float32(1 - 0.99**step)) + np.float32(1e-5))
    return tuple(state)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[int], seed: int = SEED) -> Model:
    """Fit on four fifths of the sample, set the cut on the last fifth.

    Without both classes, the model gives every text the sample's one label (or 0, without any).
    """
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 4.0 if len(y) and y.max() else -4.0)
    rng = np.random.default_rng(seed)
    last = np.zeros(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        last[rng.permutation(own)[: len(own) // 5]] = True
    fit = np.flatnonzero(~last)
    bags = _Bags([texts[i] for i in fit])
    if not len(bags.n) or not len(bags.buckets):
        return Model(np.zeros(BUCKETS), -4.0)
    toxic = y[fit][bags.owner] == 1
    clean, candidates = np.flatnonzero(~toxic), np.flatnonzero(toxic)
    if not len(clean) or not len(candidates):
        return Model(np.zeros(BUCKETS), -4.0)
    some = lambda of: rng.permutation(of)[:WINDOWS]
    positive, hard = some(candidates), clean[:0]
    for round_ in range(ROUNDS):
        # Each round starts afresh from the windows that the round before chose: the highest of every document,
        # of clean ones too, as it is the highest window that settles a document's score.
        state = _fit(bags, positive, np.unique(np.concatenate([some(clean), hard])), EPOCHS, rng)
        logit = bags.logits(state)
        best = np.full(len(fit), -np.inf)
        np.maximum.at(best, bags.owner, logit)
        top = np.flatnonzero(logit >= best[bags.owner])
        positive, hard = top[toxic[top]], top[~toxic[top]]
    weight = np.zeros(BUCKETS)
    weight[bags.buckets] = (state[0] @ (state[1][:, 1] - state[1][:, 0])).astype(np.float64) * WINDOW
    model = Model(weight, float(state[2][1] - state[2][0]))
    _set_cut(model, [texts[i] for i in np.flatnonzero(last)], y[last])
    return model


def _set_cut(model: Model, texts: list[bytes], y: np.ndarray) -> None:
    """Move the bias so that 0.5 makes the fewest errors on documents the fit has not seen, clean ones weighing more."""
    if not len(y) or y.min() == y.max():
        return
    p = np.concatenate([model.scores(texts[at : at + GROUP]) for at in range(0, len(texts), GROUP)])
    p = np.clip(p, 1e-13, 1 - 1e-13)
    logit = np.log(p / (1 - p))
    order = np.sort(logit)
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    errors = [CLEAN_WEIGHT * ((logit >= c) & (y == 0)).sum() / (y == 0).sum() + ((logit < c) & (y == 1)).sum() / (y == 1).sum() for c in cuts]
    least = np.flatnonzero(np.asarray(errors) <= min(errors) + 1e-9)
    model.bias -= float(cuts[least[len(least) // 2]])


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5, is 0; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """toxic and text of at most ``limit`` labelled documents of either class that are not held out, drawn by a hash.

    Rows that share a doc_id count once; a null doc_id names no label.
    """
    own = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    marks = labels.select("doc_id", "toxic").filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = marks.filter(~held_out(F.col("doc_id"))).join(own.select("doc_id"), "doc_id", "left_semi").withColumn("draw", F.xxhash64(F.lit(SEED), "doc_id"))
    some = [drawn.filter(F.col("toxic") == label).orderBy("draw", "doc_id").limit(limit) for label in (0, 1)]
    # The ids are drawn from the labels alone, then their texts are fetched by a broadcast of 2 * ``limit`` rows.
    got = own.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    return got.groupBy("doc_id", "toxic", "draw").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("toxic", "draw", "doc_id", "text")


@tidy
def _train_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, ys, held = [], [], [0, 0]
    for batch in batches:
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            if held[label] + len(text) <= SAMPLE_BYTES:
                held[label] += len(text)
                texts.append(text)
                ys.append(label)
    model = train(texts, ys)
    yield pa.record_batch([pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weight", "bias"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """The model of a bounded sample. One task trains on at most 2 * SAMPLE_BYTES of text; only the model is collected."""
    rows = sample(docs, labels, limit).withColumn("toxic", F.col("toxic").cast("int")).repartition(1).sortWithinPartitions("toxic", "draw", "doc_id")
    made = rows.select("toxic", "text").mapInArrow(_train_task, "weight binary, bias double").collect()
    if not made:  # no sample, no task
        return train([], [])
    return Model(np.frombuffer(made[0]["weight"], "<f4").astype(np.float64), made[0]["bias"])


def _step_scores(model: Model, piece: pa.RecordBatch, column: str = "text") -> np.ndarray:
    return model.scores([t or b"" for t in piece.column(column).cast(pa.large_binary()).to_pylist()])


def _sent(docs: DataFrame, model: Model):
    """A function that gives the model in a worker; BUCKETS numbers are broadcast."""
    sent, live = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.window)), []

    def get() -> Model:
        if not live:
            live.append(Model(*sent.value))
        return live[0]

    return get


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; null texts score as empty ones. doc_id keeps its type."""
    get = _sent(docs, model)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch, "text", GROUP, GROUP_BYTES):
                yield pa.record_batch([piece.column("doc_id"), piece.column("held_out"), pa.array(_step_scores(get(), piece), pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the sample and score every document.

    Repeated rows are scored alike and all returned, an empty table gives an empty result, extra columns are
    ignored. A document labelled more than once is toxic if any label says so.
    """
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, whatever their names; nothing is shuffled.

    Null and empty texts are scored as empty ones; repeated rows share their fate; an empty table stays empty.
    """
    get, columns = _sent(docs, fit(docs, labels)), own_names(len(docs.columns))
    text = columns[[c.lower() for c in docs.columns].index("text")]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch, text, GROUP, GROUP_BYTES):
                yield piece.filter(pa.array(_step_scores(get(), piece, text) < 0.5, pa.bool_()))

    own = docs.toDF(*columns)  # some names, as those with a dot, cannot be passed to Python
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
