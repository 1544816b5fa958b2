"""Toxicity by subword bags: words are means of n-gram embeddings, a text and its windows means of words, a linear softmax judges them.

Embeddings and softmax are trained jointly in numpy. A word never seen in training still has the vectors of the
n-grams it shares with known ones, so misspellings score near the words they come from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from edgewright.llm import bpe
from edgewright.llm import kernels as K

#: Bounds of the labelled sample that is fetched for training, by class; the smallest seeded hashes are taken.
MOST_TOXIC, MOST_CLEAN = 1500, 2500
#: Texts of that sample are left out once they hold so many bytes together, so that training's memory is bounded too.
MOST_BYTES = 48 << 20
BUCKETS, WIDTH, WINDOW = 1 << 17, 8, 2
WHOLE_EPOCHS, WHOLE_STEPS, WINDOW_EPOCHS, WINDOW_STEPS = 2, 64, 16, 50
WHOLE_BATCH, BATCH, RATE, RATE_VECTORS = 64, 256, 1.0, 30.0
#: An n-gram bucket that fewer training documents hold stays zero: it could only be learnt by heart.
LEAST_DOCS = 4
FOLDS = 5

_GAP = np.zeros(256, dtype=bool)
_GAP[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learnt from; null for a null doc_id, which no label can belong to."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of each word: the word itself, 3 to 6 bytes anywhere, 2 to 8 at either end."""
    spans, sizes, every = K.Spans(buf, K.FIXED_KEY), ends - starts, np.arange(len(starts))
    salt = lambda kind: np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))
    words, found = [every], [spans.hash(starts, ends)]
    for n in (3, 4, 5, 6):
        counts = np.maximum(sizes - n + 1, 0)
        begins = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        words.append(np.repeat(every, counts))
        found.append(spans.block(begins, n) + salt(n))
    for n in (2, 3, 4, 5, 6, 7, 8):
        some = np.flatnonzero(sizes >= n)
        words += [some, some]
        found += [spans.block(starts[some], n) + salt(16 + n), spans.block(ends[some] - n, n) + salt(32 + n)]
    return np.concatenate(words), (K.mix(np.concatenate(found)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _sorted_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word by word, and the n + 1 places where each word's begin; made in blocks to save memory."""
    flat, counts = [], []
    for a in range(0, len(starts), block):
        low, high = int(starts[a : a + block].min()), int(ends[a : a + block].max())
        word, bucket = grams(buf[low:high], starts[a : a + block] - low, ends[a : a + block] - low)
        flat.append(bucket[np.argsort(word, kind="stable")].astype(np.int32))
        counts.append(np.bincount(word))
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _distinct(buf: np.ndarray, offs: np.ndarray):
    """Distinct words' starts and ends, the distinct word of each word, and where each text's words begin."""
    starts, ends, first = K.words(buf, offs, _GAP)
    _, one, which = np.unique(K.Spans(buf, K.FIXED_KEY).hash(starts, ends), return_index=True, return_inverse=True)
    return starts[one], ends[one], which, first


class Model(NamedTuple):
    """Toxic less clean logit of each n-gram bucket, and the plane from the logits of the whole bag and of the highest window to the score's."""

    buckets: np.ndarray
    mean: float
    slope: float
    offset: float
    empty: float


def _windows(scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean score of each text's windows of consecutive words (a shorter text is one window) and where the texts' windows begin."""
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    width = np.repeat(np.minimum(n, WINDOW), counts)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return (total[at + width] - total[at]) / np.maximum(width, 1), begins


def _averages(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean score of each text's words, which is the logit of its averaged bag; 0 without words."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)


def _highest(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Largest value of each ragged row; an empty row has -inf."""
    out = np.full(len(begins) - 1, -np.inf)
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        out[some] = np.maximum.reduceat(values, begins[some])
    return out


def _softmax_step(words, owners, sizes, target, grams_of, vectors, layer, common, seen):
    """One gradient step on instances given as words (and the instance of each); changes vectors and layer in place.

    Step sizes shrink by the gradients of all buckets together, so a rare n-gram learns no faster than a common one.
    """
    own, place = np.unique(words, return_inverse=True)
    flat, offs = grams_of
    counts = offs[own + 1] - offs[own]
    ids = K.ragged(flat, offs[own], counts)
    word_of = np.repeat(np.arange(len(own), dtype=np.int32), counts)
    heads = np.cumsum(counts) - counts
    inner = np.zeros((len(sizes), WIDTH))
    for d in range(WIDTH):  # one at a time, to hold an eighth of the n-grams' vectors
        bags = np.add.reduceat(vectors[d][ids], heads) / counts
        inner[:, d] = np.bincount(owners, bags[place], len(sizes)) / sizes
    logits = inner @ layer[:-1] + layer[-1]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    error = p
    error[np.arange(len(sizes)), target] -= 1
    error /= len(sizes)
    back = error @ layer[:-1].T / sizes[:, None]
    step = np.vstack([inner.T @ error, error.sum(axis=0)])
    for d in range(WIDTH):
        word = np.bincount(place, back[owners, d], len(own)) / counts
        slope = np.bincount(ids, word[word_of], BUCKETS) * common
        seen[0] += float(slope @ slope)
        vectors[d] -= RATE_VECTORS * slope / (np.sqrt(seen[0]) + 1e-8)
    seen[1] += float((step * step).sum())
    layer -= RATE * step / (np.sqrt(seen[1]) + 1e-8)


def train(texts: list[str | None], labels: list[int], toxic_share: float, seed: int = 7) -> Model:
    """Fit on labelled texts; ``toxic_share`` is the share of toxic ones among all labelled rows, for calibration.

    First whole texts are instances; then each text's highest window is, so the words that make a long text toxic
    are found in it. Without texts of both labels every score is ``toxic_share``.
    """
    truth = np.array(labels, dtype=np.int64)
    prior = float(np.log(max(toxic_share, 1e-6) / max(1 - toxic_share, 1e-6)))
    if len(np.unique(truth)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, prior, prior)
    column = pa.array(texts, pa.string())
    found, base = [], 0
    for _, _, part, offs in K.chunks(column):
        part = K.LOWER[part]
        starts, ends, first = K.words(part, offs, _GAP)
        found.append((K.Spans(part, K.FIXED_KEY).hash(starts, ends), starts + base, ends + base, np.diff(first)))
        base += len(part)
    hashes, starts, ends, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    buf, first = K.LOWER[K.texts(column)[0]], np.concatenate([[0], np.cumsum(counts)])
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    place = np.argsort(one, kind="stable")  # by place in the text, so that a block's words lie near one another
    starts, ends, which = starts[one[place]], ends[one[place]], np.argsort(place, kind="stable").astype(np.int32)[which]
    del found, hashes, one, place
    grams_of = _sorted_grams(buf, starts, ends)
    rng = np.random.default_rng(seed)
    some = np.flatnonzero(np.diff(first))
    holders = np.zeros(BUCKETS, np.int32)
    for i in some.tolist():
        own = np.unique(which[first[i] : first[i + 1]])
        holders[np.unique(K.ragged(grams_of[0], grams_of[1][own], grams_of[1][own + 1] - grams_of[1][own]))] += 1
    common = (holders >= LEAST_DOCS).astype(float)
    vectors = rng.uniform(-0.5, 0.5, (WIDTH, BUCKETS)) / WIDTH * common
    layer = np.vstack([rng.normal(0, 0.3, (WIDTH, 2)), np.zeros(2)])
    seen = [1e-10, 1e-10]
    halves = [some[truth[some] == t] for t in (0, 1)]

    def collapsed() -> np.ndarray:
        return (layer[:-1, 1] - layer[:-1, 0]) @ vectors

    def word_scores(block: int = 1 << 14) -> np.ndarray:
        own, (flat, offs), out = collapsed(), grams_of, []
        for a in range(0, len(offs) - 1, block):
            cuts = offs[a : a + block + 1]
            out.append(np.add.reduceat(own[flat[cuts[0] : cuts[-1]]], cuts[:-1] - cuts[0]) / np.diff(cuts))
        return np.concatenate(out)

    for epoch in range(WHOLE_EPOCHS + WINDOW_EPOCHS):
        begin, size = first[:-1].copy(), np.diff(first)
        if epoch >= WHOLE_EPOCHS:
            values, begins = _windows(word_scores()[which], first)
            for i in some.tolist():
                begin[i] += int(np.argmax(values[begins[i] : begins[i + 1]]))
            size = np.minimum(size, WINDOW)
        for _ in range(WHOLE_STEPS if epoch < WHOLE_EPOCHS else WINDOW_STEPS):
            many = WHOLE_BATCH if epoch < WHOLE_EPOCHS else BATCH
            batch = np.concatenate([rng.choice(h, many // 2) for h in halves if len(h)])
            words = K.ragged(which, begin[batch], size[batch])
            owners = np.repeat(np.arange(len(batch)), size[batch])
            _softmax_step(words, owners, size[batch].astype(float), truth[batch], grams_of, vectors, layer, common, seen)

    final = word_scores()[which]
    seen_by = np.stack([_averages(final, first)[some], _highest(*_windows(final, first))[some]], axis=1)
    middle, spread = seen_by.mean(axis=0), np.maximum(seen_by.std(axis=0), 1e-9)
    x = np.column_stack([(seen_by - middle) / spread, np.ones(len(some))])
    y = truth[some]
    weight = np.where(y == 1, toxic_share / max(y.mean(), 1e-9), (1 - toxic_share) / max(1 - y.mean(), 1e-9))
    plane = np.zeros(3)
    for _ in range(30):  # Newton steps of a weighted logistic regression, slightly damped
        p = 1 / (1 + np.exp(-np.clip(x @ plane, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-3 * plane
        plane -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), slope)
    mean, high = (plane[:2] / spread).tolist()
    return Model(collapsed().astype(np.float32), mean, high, float(plane[2] - (plane[:2] * middle / spread).sum()), prior)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """Train on the rows of ``labels`` (doc_id, toxic) that are not held out and have a document; see MOST_TOXIC, MOST_CLEAN and MOST_BYTES.

    The bounded sample meets in one task, which trains; only the model comes to the driver.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    share = float(known.agg(F.avg("toxic")).first()[0] or 0.0)
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n) for t, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most MOST_TOXIC + MOST_CLEAN rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", F.xxhash64("text")).limit(MOST_TOXIC + MOST_CLEAN)
    made = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(lambda it: _train(it, share, seed), "buckets binary, mean double, slope double, offset double, empty double").first()
    if made is None:
        return train([], [], share, seed)
    return Model(np.frombuffer(bytes(made.buckets), np.float32), made.mean, made.slope, made.offset, made.empty)


def _train(batches: Iterator[pa.RecordBatch], share: float, seed: int) -> Iterator[pa.RecordBatch]:
    bpe.forget()
    texts, labels, room = [], [], MOST_BYTES
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            size = len(text.as_buffer() or b"") if text.is_valid else 0
            if size <= room:
                room -= size
                texts.append(text.as_py())
                labels.append(label)
    model = train(texts, labels, share, seed)
    K.give_back()
    columns = [pa.array([model.buckets.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in model[1:])]
    yield pa.RecordBatch.from_arrays(columns, names=list(Model._fields))


def _means(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """Mean value of each word's buckets; made in blocks, since the n-grams of all words take far more memory than the text."""
    out = np.zeros(len(starts))
    for a in range(0, len(starts), block):
        low, high = int(starts[a : a + block].min()), int(ends[a : a + block].max())
        word, bucket = grams(buf[low:high], starts[a : a + block] - low, ends[a : a + block] - low)
        out[a : a + block] = np.bincount(word, values[bucket]) / np.bincount(word)
    return out


def logits(buf: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    """Logit of each text of a chunk, from its averaged bag and its highest window; the prior where there is no word."""
    buf = K.LOWER[buf]
    starts, ends, which, first = _distinct(buf, offs)
    if not len(starts):
        return np.full(len(offs) - 1, model.empty)
    scores = _means(buf, starts, ends, model.buckets)
    high = _highest(*_windows(scores[which], first))
    some = np.isfinite(high)
    return np.where(some, model.mean * _averages(scores[which], first) + model.slope * np.where(some, high, 0.0) + model.offset, model.empty)


def _scores(column: pa.Array, model: Model) -> pa.Array:
    bpe.forget()
    parts = [logits(buf, offs, model) for _, _, buf, offs in K.chunks(column)]
    return pa.array((1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *parts]), -30, 30)))).round(6))


def toxicity_score(text: Column, model: Model) -> Column:
    """The score of a text, 0 to 1. Only the text goes to Python; the row's other columns stay where they are."""

    def judge(column: pa.Array) -> pa.Array:
        return _scores(column, model)

    return F.arrow_udf(judge, "double", ArrowUDFType.SCALAR)(text)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``score`` and ``predicted`` (1 from a score of 0.5) of every row.

    Null, empty and wordless texts score the share of toxic labels. Texts of any length are scored whole. Repeated rows score
    alike, an empty table gives an empty one. Nothing but the text is read for a score; ``keep`` columns named like a result
    column are refused, other columns are left out.
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := {"score", "predicted"} & set(keep):
        raise ValueError(f"columns to keep clash with results: {sorted(clash)}")
    scored = docs.select(*(docs[k] for k in keep), toxicity_score(docs[text], model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not call toxic."""
    return docs.where(toxicity_score(docs[text], model) < 0.5)


def auc(scores: np.ndarray, truth: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for v in np.unique(scores):
        same = scores == v
        ranks[same] = ranks[same].mean()
    ones = truth == 1
    return float((ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum()))


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS
