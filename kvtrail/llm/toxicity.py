"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums, over all strings of four symbols, the products
of their decayed occurrences as subsequences: an occurrence spans at most SPAN
places and weighs DECAY to the power of its span, so that gaps and inserted
characters lower a match but don't end it. Landmarks span the kernel's space
(Nyström), a linear machine with squared hinge loss separates it, and since both
are linear in the subsequences, the fitted machine is one table of weights.

Strings are the words of sentences, without punctuation; single characters set
apart by white space ("i d  i o t") make one word. A sentence is as toxic as its worst word, a text as
its worst sentence. Labels are those of whole texts, so the machine is fitted on words of
labelled texts: those that bear a toxic text's label are those that tell toxic texts from
clean ones best, with disguises of them, against clean words, and it is fitted again with the
clean words that it takes for toxic. Words are scored once for each distinct word of a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtrail.llm.quality_net import ConstantScore, labelled_texts, trained_in_a_task
from kvtrail.llm.text import blocks, code_points, span_hashes, texts_of

SPAN, DECAY = 8, 0.8
#: White space between single characters that make one word, at most.
APART = 2
#: Longer words are cut into overlapping pieces of so many symbols.
LONGEST = 24
#: Bound of the labelled texts that a fit takes, per label; of its landmarks and words.
TRAIN_PER_LABEL, LANDMARKS, NEGATIVE_WORDS = 1000, 240, 5000
#: Machines whose mean is taken, so that the draw of landmarks matters less.
MACHINES = 5
THRESHOLD = 0.7
_PUNCT, _LETTER, _OTHER, _LETTER_TOO, _START = 27, 28, 29, 30, 31
#: Characters that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Offsets of the second to fourth symbol of an occurrence.
_STEPS = [(j, k, n) for n in range(3, SPAN) for k in range(2, n) for j in range(1, k)]
_CODES = 1 << 20


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 white space, 1-26 the letters a to z of either case, then classes of the rest."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x2C00):
        ch = chr(c)
        base = STAND_INS.get(ch, ch).lower()[:1]
        if ch.isspace():
            out[c] = 0
        elif "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif ch.isalpha():
            out[c] = _LETTER if ord(base) % 2 else _LETTER_TOO
        elif not ch.isalnum():
            out[c] = _PUNCT
    return out


def _without(drop: np.ndarray, symbols: np.ndarray, bounds: np.ndarray, points: np.ndarray):
    upto = np.concatenate([[0], np.cumsum(~drop)])
    return symbols[~drop], upto[bounds], points[~drop]


def _last(bounds: np.ndarray, n: int) -> np.ndarray:
    """The place after each text."""
    out = np.zeros(n, bool)
    out[bounds[1:] - 1] = True
    return out


def _runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], symbols > 0, [False]])))
    return edge[0::2], edge[1::2]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, starts and ends of their words, and the text of each word."""
    points, bounds = code_points(texts)
    symbols = _symbols()[points]
    symbols[bounds[1:] - 1] = 0
    symbols, bounds, points = _without(symbols == _PUNCT, symbols, bounds, points)
    starts, ends = _runs(symbols)
    single = ends - starts == 1
    gap = starts[1:] - ends[:-1]
    apart = single[1:] & single[:-1] & (gap <= APART)
    drop = np.zeros(len(symbols), bool)
    for k in range(APART):
        drop[ends[:-1][apart & (gap > k)] + k] = True
    symbols, bounds, _ = _without(drop & ~_last(bounds, len(symbols)), symbols, bounds, points)
    starts, ends = _runs(symbols)
    n = ends - starts
    long = np.flatnonzero(n > LONGEST)
    if len(long):
        half = LONGEST // 2
        count = -(-(n[long] - LONGEST) // half)
        more = np.repeat(starts[long], count) + half * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
        until = np.minimum(more + LONGEST, np.repeat(ends[long], count))
        ends[long] = starts[long] + LONGEST
        starts, ends = np.concatenate([starts, more]), np.concatenate([ends, until])
    return symbols, starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def occurrences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the four-symbol subsequences of words of one length, a row each, and the weight of each column."""
    width = rows.shape[1]
    codes, weights = [], []
    wide = rows.astype(np.int32)
    for j, k, n in _STEPS:
        if n < width:
            end = width - n
            codes.append((wide[:, :end] << 15) | (wide[:, j : end + j] << 10) | (wide[:, k : end + k] << 5) | wide[:, n:])
            weights.append(np.full(end, DECAY ** (n + 1), np.float32))
    if not codes:
        return np.zeros((len(rows), 0), np.int32), np.zeros(0, np.float32)
    return np.concatenate(codes, 1), np.concatenate(weights)


def self_kernel(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself."""
    if not codes.shape[1]:
        return np.ones(len(codes), np.float32)
    order = np.argsort(codes, axis=1)
    ranked, w = np.take_along_axis(codes, order, 1), weights[order]
    new = np.ones(ranked.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    total = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    row = np.repeat(np.arange(len(codes)), new.sum(1))
    return np.bincount(row, total * total, minlength=len(codes)).astype(np.float32)


def by_length(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and symbols (a start mark before each) of the words of each length."""
    n = ends - starts
    for length in np.unique(n).tolist():
        pick = np.flatnonzero(n == length)
        for part in np.array_split(pick, max(1, len(pick) // 5_000)):
            rows = symbols[starts[part][:, None] + np.arange(length)]
            yield part, np.concatenate([np.full((len(part), 1), _START, np.uint8), rows], 1)


@dataclass
class ToxicityModel:
    table: np.ndarray  # weight of each four-symbol subsequence
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    known: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))

    def margins(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The machine's output for each word."""
        out = np.full(len(starts), self.bias, np.float32)
        for part, rows in by_length(symbols, starts, ends):
            codes, weights = occurrences(rows)
            out[part] += (self.table[codes] @ weights) / np.sqrt(self_kernel(codes, weights))
        return out

    def text_margins(self, texts: list[str]) -> np.ndarray:
        """The worst word's output for each text; the lowest possible for one without words."""
        symbols, starts, ends, owner = words(texts)
        keys, first, inverse = np.unique(span_hashes(symbols, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        found = np.empty(len(keys), np.float32)
        if len(self.keys):
            found[:] = self.known[at]
        found[new] = self.margins(symbols, starts[first[new]], ends[first[new]])
        if len(self.keys) + len(new) > 1_000_000:
            self.keys, self.known = keys, found
        else:
            both = np.concatenate([self.keys, keys[new]])
            order = np.argsort(both, kind="stable")
            self.keys, self.known = both[order], np.concatenate([self.known, found[new]])[order]
        worst = np.full(len(texts), -9.0)
        np.maximum.at(worst, owner, found[inverse])
        return worst

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.slope * self.text_margins(texts) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Landmarks:
    """Normalised subsequence weights of landmarks; only the codes that they hold have a column."""

    def __init__(self, found: list[bytes]) -> None:
        parts = [occurrences(np.frombuffer(bytes([_START]) + w, np.uint8)[None, :]) for w in found]
        self.codes, column = np.unique(np.concatenate([c[0] for c, _ in parts]), return_inverse=True)
        owner = np.repeat(np.arange(len(found)), [len(w) for _, w in parts])
        self.by_code = np.zeros((len(self.codes) + 1, len(found)), np.float32)  # the last row stands for all other codes
        np.add.at(self.by_code, (column, owner), np.concatenate([w for _, w in parts]))
        norm = np.linalg.norm(self.by_code, axis=0)
        self.by_code /= np.where(norm > 0, norm, 1)
        self.column = np.full(_CODES, len(self.codes), np.int32)
        self.column[self.codes] = np.arange(len(self.codes))
        values, vectors = np.linalg.eigh((self.by_code.T @ self.by_code).astype(np.float64))
        keep = values > 1e-5
        self.turn = vectors[:, keep] / np.sqrt(values[keep])

    def features(self, found: list[bytes]) -> np.ndarray:
        """Nyström features of words: kernels with the landmarks, turned so that their products give kernels."""
        out = np.zeros((len(found), self.by_code.shape[1]))
        for part, rows in by_length(*_joined(found)):
            codes, weights = occurrences(rows)
            norm = np.sqrt(self_kernel(codes, weights))
            for k, columns in enumerate(self.column[codes]):
                out[part[k]] = weights @ self.by_code[columns] / norm[k]
        return out @ self.turn

    def table(self, w: np.ndarray) -> np.ndarray:
        """Weights of all codes that give the same products as features with w."""
        out = np.zeros(_CODES, np.float32)
        out[self.codes] = self.by_code[:-1] @ (self.turn @ w)
        return out


def _disguised(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with a doubled symbol, with one inserted letter, with one inserted other character, with two letters inserted apart and side by side, and with a letter between all symbols."""
    dup, at, letter = rng.integers(0, len(word)), rng.integers(1, max(2, len(word))), rng.integers(1, 27)
    between = bytes(x for c in word for x in (c, int(rng.integers(1, 27))))[:-1]
    first, second = sorted(rng.integers(1, max(2, len(word)), 2).tolist())
    a, b = (bytes([x]) for x in rng.integers(1, 27, 2).tolist())
    return [
        word[:dup] + word[dup : dup + 1] + word[dup:],
        word[:at] + bytes([letter]) + word[at:],
        word[:at] + bytes([_OTHER]) + word[at:],
        word[:first] + a + word[first:second] + b + word[second:],
        word[:first] + a + b + word[first:],
        between[:LONGEST],
    ]


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 4, machines: int = MACHINES, seed: int = 11) -> ToxicityModel:
    """Fit on labelled texts of both kinds: the mean of several machines, each with landmarks of its own."""
    symbols, starts, ends, owner = words(texts)
    raw = symbols.tobytes()
    own: list[set[bytes]] = [set() for _ in texts]
    for a, b, k in zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True):
        if b - a >= 3:
            own[k].add(raw[a:b])
    in_clean = Counter(w for k in np.flatnonzero(~toxic) for w in own[k])
    support = _bearers([own[k] for k in np.flatnonzero(toxic)], in_clean, int((~toxic).sum()))
    clean = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    fitted = [_fitted(support, clean, landmarks, rounds, np.random.default_rng(seed + k)) for k in range(machines)]
    model = ToxicityModel(np.mean([m.table for m in fitted], axis=0), float(np.mean([m.bias for m in fitted])))
    model.slope, model.shift = _logistic(model.text_margins(texts), toxic)
    model.keys, model.known = np.empty(0, np.uint64), np.empty(0, np.float32)
    return model


def _fitted(support: dict[bytes, int], clean: list[bytes], landmarks: int, rounds: int, rng: np.random.Generator) -> ToxicityModel:
    """One machine: words that bear the label and disguises of them against clean words, the hardest of which join after each round."""
    common = clean[: NEGATIVE_WORDS // 2]
    negatives = common + [clean[i] for i in rng.permutation(np.arange(len(common), len(clean)))[: NEGATIVE_WORDS - len(common)].tolist()]
    for turn in range(rounds):
        marks = [w for w, _ in sorted(support.items(), key=lambda x: (-x[1], x[0]))[: landmarks // 2]]
        spoiled = [v for w in marks for v in _disguised(w, rng)]
        pick = [spoiled[i] for i in rng.permutation(len(spoiled))[: landmarks // 4].tolist()]
        space = _Landmarks(marks + pick + [negatives[i] for i in rng.permutation(len(negatives))[: landmarks // 4].tolist()])
        positive = marks + spoiled
        x = np.concatenate([space.features(positive), space.features(negatives)])
        y = np.r_[np.ones(len(positive)), -np.ones(len(negatives))]
        root = np.array([float(support[w]) for w in marks]) ** 0.5
        weight = np.r_[root, np.repeat(0.5 * root, len(spoiled) // len(marks)), np.ones(len(negatives))]
        weight[: len(positive)] *= len(negatives) / 4 / weight[: len(positive)].sum()
        w = _machine(x, y, weight)
        model = ToxicityModel(space.table(w[:-1]), float(w[-1]))
        if turn + 1 < rounds:
            every = _margins_of(model, clean)
            hard = [clean[i] for i in np.argsort(-every)[: NEGATIVE_WORDS // 4].tolist()]
            negatives = list(dict.fromkeys(hard + negatives))[:NEGATIVE_WORDS]
    return model


def _joined(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in found], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    return np.frombuffer(b"\0".join(found) + b"\0", np.uint8), ends - sizes, ends


def _margins_of(model: ToxicityModel, found: list[bytes]) -> np.ndarray:
    return model.margins(*_joined(found))


def _bearers(toxic: list[set[bytes]], in_clean: Counter, n_clean: int, deep: int = 8, lift: float = 8.0, evidence: float = 8.0) -> dict[bytes, int]:
    """Words that bear the label of toxic texts, and how many texts each is in.

    Words are taken by falling evidence while they are in texts that have fewer than
    `deep` of them so far; words of a text that others explain are left out.
    """
    where: dict[bytes, list[int]] = {}
    for k, own in enumerate(toxic):
        for w in own:
            where.setdefault(w, []).append(k)
    ratio = {w: len(k) / len(toxic) * max(1, n_clean) / (in_clean[w] + 0.5) for w, k in where.items() if len(k) > 1}
    weigh = {w: len(where[w]) * np.log(r) for w, r in ratio.items() if r >= lift}
    seen, out = [0] * len(toxic), {}
    for w in sorted((w for w, g in weigh.items() if g >= evidence), key=lambda w: (-weigh[w], w)):
        open_texts = [k for k in where[w] if seen[k] < deep]
        if len(open_texts) >= max(2, 0.2 * len(where[w])):
            out[w] = len(where[w])
            for k in where[w]:
                seen[k] += 1
    return out or {max(where, key=lambda w: (len(where[w]), w), default=b"\x01"): 1}


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Weights and bias of the linear machine with squared hinge loss, by damped Newton steps."""
    x1 = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    c = cost * weight

    def loss(v: np.ndarray) -> float:
        return float(v @ ridge @ v + c @ np.maximum(0, 1 - y * (x1 @ v)) ** 2)

    now = loss(w)
    for _ in range(40):
        active = y * (x1 @ w) < 1
        a = x1[active] * c[active][:, None]
        step = np.linalg.solve(ridge + a.T @ x1[active], a.T @ y[active]) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * before:
            break
    return w


def _logistic(margin: np.ndarray, toxic: np.ndarray, trims: int = 4) -> tuple[float, float]:
    """Slope and shift that turn margins of whole texts into probabilities.

    Texts that a fit finds most unlike their label are left out of the next fit, so
    that wrong labels don't flatten the curve.
    """
    x, t = np.c_[margin, np.ones(len(margin))], np.where(toxic, 0.999, 0.001)
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum())) * len(toxic)
    w, use = np.array([1.0, 0.0]), np.ones(len(x), bool)
    for _ in range(trims):
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x[use] @ w, -30, 30)))
            h = (x[use] * (share[use] * p * (1 - p) + 1e-6)[:, None]).T @ x[use] + 1e-3 * np.eye(2)
            w = w + np.clip(np.linalg.solve(h, x[use].T @ (share[use] * (t[use] - p)) - 1e-3 * w), -2, 2)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        use = np.abs(p - toxic) < 0.8
    return float(max(w[0], 0.1)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL, modulus: int = 3, held_out: int = 1) -> ToxicityModel | ConstantScore:
    """Fit on at most `per_label` labelled texts of each label, drawn by a hash of the doc_id, none of them held out.

    Without texts of both labels, the only label there is becomes the score of all
    texts; without any, none is toxic. Rows with a null doc_id or label are passed over; of several labels of one document the highest counts.
    """
    return trained_in_a_task(labelled_texts(docs, labels, "toxic", F.max, per_label, modulus, held_out), _made)


def _made(texts: list[str], labels: list[int]) -> ToxicityModel | ConstantScore:
    if len(set(labels)) < 2:
        return ConstantScore(float(labels[0]) if labels else 0.0)
    return train(texts, np.array([y == 1 for y in labels]))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 if the score reaches the threshold) of every row.

    The whole text counts; null and empty texts, and those without words, get the
    lowest score. Rows with the same doc_id stay separate rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            s = shared.value.scores(texts_of(block))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return two.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score stays below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield block.filter(pa.array(shared.value.scores(texts_of(block)) < threshold))

    return docs.mapInArrow(run, docs.schema)
