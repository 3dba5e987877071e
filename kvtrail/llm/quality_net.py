"""Quality of whole texts by a byte-level convolutional network in numpy.

Each filter looks at WIDTH neighbouring bytes; its weights are one table a tap,
indexed by the byte. Rectified responses are max-pooled over overlapping chunks
that cover the whole text; a small head turns a chunk's pooled responses and
length into the evidence for low quality, and the strongest chunk decides for
the text. Max-pooling sends a gradient to one place a filter and chunk, so
training touches few bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtrail.llm.text import blocks, texts_of

WIDTH, FILTERS, HIDDEN = 6, 24, 16
#: A chunk is two neighbouring segments, so chunks overlap by half.
SEGMENT = 256
#: Bound of the labelled texts that a fit takes, per label; and of its passes over them.
TRAIN_PER_LABEL, EPOCHS = 700, 14
#: Bytes of the longest text that a fit takes; longer ones are scored like all others.
TRAIN_TEXT_BYTES = 256 << 10
THRESHOLD = 0.3
_PIECE = 1 << 18


@dataclass
class QualityNet:
    taps: np.ndarray  # [WIDTH, 256, FILTERS]
    bias: np.ndarray  # [FILTERS]
    hidden: np.ndarray  # [FILTERS + 2, HIDDEN]: pooled responses, length, constant
    out: np.ndarray  # [HIDDEN + 1]

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at each byte; the bytes are followed by WIDTH - 1 of padding."""
        n = len(data) - WIDTH + 1
        r = self.taps[0][data[:n]]
        for k in range(1, WIDTH):
            r += self.taps[k][data[k : k + n]]
        r += self.bias
        return r

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maximum response of every filter over each segment [starts[i], starts[i + 1])."""
        out = np.empty((len(starts) - 1, FILTERS), np.float32)
        padded = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
        i = 0
        while i < len(starts) - 1:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + _PIECE, side="right")) - 1)
            a, b = int(starts[i]), int(starts[j])
            out[i:j] = np.maximum.reduceat(self.responses(padded[a : b + WIDTH - 1]), starts[i:j] - a, axis=0)
            i = j
        return np.maximum(out, 0)

    def head(self, pooled: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([pooled, np.log2(sizes + 1.0)[:, None] / 8, np.ones((len(pooled), 1))], 1)
        h = np.tanh(x @ self.hidden)
        return x, h, h @ self.out[:-1] + self.out[-1]

    def scores(self, raw: list[bytes]) -> np.ndarray:
        """Probability of good quality of each text; an empty text counts as one of a single line feed."""
        chunk, owner = self._chunks(raw)
        z = self.head(*chunk)[2]
        worst = np.full(len(raw), -np.inf)
        np.maximum.at(worst, owner, z)
        return 1 / (1 + np.exp(np.clip(worst, -30, 30)))

    def _chunks(self, raw: list[bytes]):
        data, starts, owner = segments(raw)
        pooled, sizes = self.pooled(data, starts), np.diff(starts)
        pair = np.flatnonzero(owner[1:] == owner[:-1])  # chunks of two segments; a text of one segment is a chunk
        lone = np.flatnonzero(np.bincount(owner, minlength=len(raw))[owner] == 1)
        both = np.concatenate([np.maximum(pooled[pair], pooled[pair + 1]), pooled[lone]])
        return (both, np.concatenate([sizes[pair] + sizes[pair + 1], sizes[lone]])), np.concatenate([owner[pair], owner[lone]])


@dataclass
class ConstantScore:
    """Stands in for a model where there is nothing to learn from."""

    value: float

    def scores(self, texts: list) -> np.ndarray:
        return np.full(len(texts), self.value)


def segments(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, starts of the segments (plus the end), and the text of each segment."""
    raw = [t or b"\n" for t in raw]
    sizes = np.array([len(t) for t in raw], np.int64)
    count = np.maximum(1, sizes // SEGMENT)  # what is left over joins the last segment
    owner = np.repeat(np.arange(len(raw)), count)
    begin = np.cumsum(sizes) - sizes
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(raw), np.uint8), np.append(begin[owner] + rank * SEGMENT, sizes.sum()), owner


def train(raw: list[bytes], good: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> QualityNet:
    """Fit on labelled texts (at least one). Gradients flow through the deciding chunk of each text."""
    rng = np.random.default_rng(seed)
    net = QualityNet(
        rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, (FILTERS + 2, HIDDEN)),
        rng.normal(0, 0.3, HIDDEN + 1),
    )
    weight = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * len(good)
    params = [net.taps, net.bias, net.hidden, net.out]
    moments = [[np.zeros_like(p, np.float64), np.zeros_like(p, np.float64)] for p in params]
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(raw))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            grads = _gradients(net, [raw[i] for i in batch], good[batch], weight[batch])
            step += 1
            for p, g, m in zip(params, grads, moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                p -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)).astype(p.dtype)
    return net


def _gradients(net: QualityNet, raw: list[bytes], good: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    (pooled, sizes), owner = net._chunks(raw)
    x, h, z = net.head(pooled, sizes)
    order = np.lexsort((-z, owner))
    first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]  # the deciding chunk of each text, by text
    dz = (1 / (1 + np.exp(-np.clip(z[first], -30, 30))) - ~good) * weight / len(raw)
    g_taps, g_bias = np.zeros(net.taps.shape), np.zeros(FILTERS)
    dh = dz[:, None] * net.out[:-1] * (1 - h[first] ** 2)
    g_hidden = x[first].T @ dh + 1e-4 * net.hidden
    g_out = np.append(h[first].T @ dz, dz.sum())
    dx = (dh @ net.hidden.T)[:, :FILTERS] * (pooled[first] > 0)
    for k, c in enumerate(first.tolist()):
        text = np.frombuffer(_chunk_bytes(raw[int(owner[c])] or b"\n", c, owner, len(raw)) + bytes(WIDTH - 1), np.uint8)
        place = net.responses(text).argmax(0)
        for tap in range(WIDTH):
            np.add.at(g_taps[tap], (text[place + tap], np.arange(FILTERS)), dx[k])
        g_bias += dx[k]
    return [g_taps, g_bias, g_hidden, g_out]


def _chunk_bytes(text: bytes, c: int, owner: np.ndarray, n_texts: int) -> bytes:
    """Bytes of chunk c: pairs come first in order of their texts, then texts of one segment."""
    own = int(np.flatnonzero(owner == owner[c])[0])
    if len(text) < 2 * SEGMENT:
        return text
    k, last = c - own, len(text) // SEGMENT - 2
    return text[k * SEGMENT :] if k == last else text[k * SEGMENT : (k + 2) * SEGMENT]


def remainder(modulus: int):
    """crc32 of the doc_id's decimal digits, modulo `modulus`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, several, per_label: int, modulus: int, held_out: int) -> DataFrame:
    """doc_id, text, label of at most `per_label` labelled documents of each label, none of them held out.

    The labels are drawn first, by a hash of the doc_id; that sample is small and
    bounded, so it is broadcast to fetch the whole texts. A doc_id brings one text,
    and texts of more than TRAIN_TEXT_BYTES are not trained on.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (remainder(modulus) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(several(column).alias("label"))
    drawn = [known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for label in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.where(F.octet_length("text") <= TRAIN_TEXT_BYTES).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def trained_in_a_task(rows: DataFrame, make):
    """make(texts, labels) of the bounded rows of labelled_texts(), run in one task; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(row for b in batches for row in zip(*(b.column(n).to_pylist() for n in ("label", "doc_id", "text")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make([t for _, _, t in held], [y for y, _, _ in held]))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else make([], [])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, modulus: int = 5, held_out: int = 0) -> QualityNet | ConstantScore:
    """Fit on at most `per_label` labelled texts of each label, drawn by a hash of the doc_id, none of them held out.

    Without texts of both labels, the only label there is becomes the score of all
    texts; without any, all are good. Labels of rows with a null doc_id or label are passed over; of several labels of one document the lowest counts.
    """
    return trained_in_a_task(labelled_texts(docs, labels, "quality", F.min, per_label, modulus, held_out), _made)


def _made(texts: list[str], labels: list[int]) -> QualityNet | ConstantScore:
    if len(set(labels)) < 2:
        return ConstantScore(float(labels[0]) if labels else 1.0)
    good = [y == 1 for y in labels]
    cuts = _short_cuts([t for t, g in zip(texts, good, strict=True) if g])
    return train([t.encode() for t in texts + cuts], np.array(good + [True] * len(cuts)))


def _short_cuts(texts: list[str], share: float = 0.3, seed: int = 3) -> list[str]:
    """Sentences and pairs of words from good texts, so that a short text is not taken for a poor one."""
    rng, out = np.random.default_rng(seed), []
    for k in rng.permutation(len(texts))[: int(share * len(texts))].tolist():
        words = texts[k].split()
        at, n = int(rng.integers(0, max(1, len(words) - 12))), int(rng.integers(1, 13))
        out.append(" ".join(words[at : at + n]).rstrip(".,") + ".")
    return out


def score(docs: DataFrame, net: QualityNet, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held-out-free score and predicted (1 if the score reaches the threshold) of every row.

    The whole text counts; a null text counts as empty, and an empty one gets the
    score of a single line feed. Rows with the same doc_id stay separate rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            s = model.value.scores([t.encode() for t in texts_of(block)])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return two.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, net: QualityNet, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose text reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            s = model.value.scores([t.encode() for t in texts_of(block)])
            yield block.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
