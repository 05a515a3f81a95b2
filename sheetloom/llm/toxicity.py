"""Toxicity scores of a bidirectional gated recurrent network.

Every word is a vector learned for the word itself and for its character grams. A
forward and a backward recurrent layer read windows of words, attention pools their
states, and a text scores as its most toxic window. The network is trained in numpy by
one task, on a bounded sample of labelled texts; tasks score all overlapping windows of
all texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import checkpointed, fresh, slices, text_buffers
from .bpe import white_space_words
from .jaccard import word_hashes
from .suffix import gram_hashes

WINDOW, STRIDE = 32, 16
HIDDEN, WIDTH, BITS = 8, 8, 13
GRAMS = (4, 6)
#: Bounds of the training sample, in texts and in bytes: toxic ones, clean ones, and those of the calibration. Texts are
#: taken whole, long or short, in the order of a hash, until a bound is met.
SAMPLE = {"toxic": (2500, 4 << 20), "clean": (4000, 6 << 20), "calibration": (2000, 4 << 20)}
#: Least steps of gradient descent, so that few labels are read often enough.
STEPS = 300

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum():
        _LOWER[_c] = 0x20


class Words:
    """Distinct words of a batch of texts: hash bucket and gram buckets of each, and every text's words."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffers(column)
        words, self.first = white_space_words(_LOWER[data], offsets)
        coded = words.dictionary_encode()
        self.at = coded.indices.to_numpy().astype(np.int64)
        own = coded.dictionary
        size = len(own)
        bounds = np.frombuffer(own.buffers()[1], np.int32)[: size + 1].astype(np.int64) if size else np.zeros(1, np.int64)
        raw = np.frombuffer(own.buffers()[2], np.uint8)[: bounds[-1]] if size else np.zeros(0, np.uint8)
        self.word = (word_hashes(raw, bounds)[0] >> np.uint64(64 - BITS)).astype(np.int64)
        framed_at = bounds + 2 * np.arange(size + 1)
        framed = np.full(framed_at[-1], 0x20, np.uint8)
        framed[np.arange(len(raw)) + 1 + 2 * np.repeat(np.arange(size), np.diff(bounds))] = raw
        self.grams = []
        for n in GRAMS:
            counts = np.maximum(np.diff(framed_at) - n + 1, 0)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(framed_at[:-1], counts)
            ids = (gram_hashes(framed, n)[place] >> np.uint64(64 - BITS)).astype(np.int64) if len(place) else np.zeros(0, np.int64)
            self.grams.append((ids, counts))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word places of all windows, -1 past a text's end, and the text of each; a text without words has one empty window."""
        counts = np.diff(self.first)
        many = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(counts)), many)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        place = begin[:, None] + np.arange(WINDOW)
        inside = place < counts[text][:, None]
        place = np.where(inside, place + self.first[:-1][text][:, None], 0)
        return np.where(inside, self.at[place] if len(self.at) else -1, -1), text


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), values.shape[1]), values.dtype)
    held = np.flatnonzero(counts)
    if len(held):
        out[held] = np.add.reduceat(values, (np.cumsum(counts) - counts)[held], axis=0)
    return out


class Network:
    """Parameters by name, the forward pass, and one step of gradient descent."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WIDTH * (1 + len(GRAMS))
        self.p = {"word": rng.normal(0, 0.1, (1 << BITS, WIDTH)), "w": rng.normal(0, 0.3, (d, 6 * h)), "u": rng.normal(0, 0.3, (2, h, 3 * h)), "b": np.zeros(6 * h), "v": rng.normal(0, 0.3, 2 * h), "o": rng.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
        for n in GRAMS:
            self.p[f"gram{n}"] = rng.normal(0, 0.1, (1 << BITS, WIDTH))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0
        self.scale = np.array([0.0, 1.0, 0.0])  # calibration: constant, logit, log of the number of windows

    def vectors(self, words: Words) -> np.ndarray:
        parts = [self.p["word"][words.word]]
        for n, (ids, counts) in zip(GRAMS, words.grams):
            parts.append(_sum_by(self.p[f"gram{n}"][ids], counts) / np.sqrt(np.maximum(counts, 1))[:, None].astype(np.float32))
        return np.concatenate(parts, axis=1)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of each word (forward then backward: update, reset, candidate); the last row, for padding, keeps the state."""
        g = x @ self.p["w"] + self.p["b"]
        pad = np.zeros((1, 6 * HIDDEN), g.dtype)
        pad[0, :HIDDEN] = pad[0, 3 * HIDDEN : 4 * HIDDEN] = 30
        return np.concatenate([g, pad])

    def run(self, gates: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window; ``keep`` gets what the backward pass needs."""
        n, h = len(at), HIDDEN
        states = np.empty((WINDOW, n, 2 * h), gates.dtype)
        trail: list = [[], []]
        for way in (0, 1):
            u, state = self.p["u"][way], np.zeros((n, h), gates.dtype)
            for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
                x = gates[at[:, t], 3 * h * way : 3 * h * (way + 1)]
                zr = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * h] + state @ u[:, : 2 * h]))
                z, r = zr[:, :h], zr[:, h:]
                back = state @ u[:, 2 * h :]
                c = np.tanh(x[:, 2 * h :] + r * back)
                if keep is not None:
                    trail[way].append((t, state, z, r, back, c))
                state = c + z * (state - c)
                states[t, :, way * h : (way + 1) * h] = state
        score = np.where(at.T >= 0, states @ self.p["v"], -1e4)
        e = np.exp(score - score.max(0))
        share = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        if keep is not None:
            keep += [states, share, pooled, trail]
        return pooled @ self.p["o"] + self.p["c"][0]

    def logits(self, words: Words, at: np.ndarray, batch: int = 4096) -> np.ndarray:
        gates = self.inputs(self.vectors(words))
        return np.concatenate([self.run(gates, at[i : i + batch]) for i in range(0, len(at), batch)] or [np.zeros(0, np.float32)])

    def gradients(self, words: Words, x: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted log loss on windows ``at``, by parameter; x holds the vectors of all words."""
        h, p = HIDDEN, self.p
        keep: list = []
        logit = self.run(self.inputs(x), at, keep)
        states, share, pooled, trail = keep
        d = ((1 / (1 + np.exp(-logit)) - label) * weight / len(at)).astype(x.dtype)
        g = {"o": pooled.T @ d, "c": np.array([d.sum()]), "u": np.zeros_like(p["u"])}
        d_pooled = d[:, None] * p["o"]
        d_share = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = share * (d_share - (share * d_share).sum(0))
        g["v"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = share[:, :, None] * d_pooled + d_score[:, :, None] * p["v"]
        d_gate = np.zeros((len(at), WINDOW, 6 * h), x.dtype)
        for way in (0, 1):
            u, d_state = p["u"][way], np.zeros((len(at), h), x.dtype)
            for t, before, z, r, back, c in reversed(trail[way]):
                d_state = d_state + d_states[t, :, way * h : (way + 1) * h]
                dc = d_state * (1 - z) * (1 - c * c)
                dz = d_state * (before - c) * z * (1 - z)
                dr = dc * back * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                d_back = dc * r
                g["u"][way] += np.concatenate([before.T @ dzr, before.T @ d_back], axis=1)
                d_gate[:, t, 3 * h * way : 3 * h * (way + 1)] = np.concatenate([dzr, dc], axis=1)
                d_state = d_state * z + dzr @ u[:, : 2 * h].T + d_back @ u[:, 2 * h :].T
        real = at >= 0
        used, where = np.unique(at[real], return_inverse=True)
        d_gates = np.zeros((len(used), 6 * h), x.dtype)
        np.add.at(d_gates, where, d_gate[real])
        g["w"], g["b"] = x[used].T @ d_gates, d_gates.sum(0)
        d_x = d_gates @ p["w"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], words.word[used], d_x[:, :WIDTH])
        for i, (n, (ids, counts)) in enumerate(zip(GRAMS, words.grams)):
            own = counts[used]
            place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat((np.cumsum(counts) - counts)[used], own)
            g[f"gram{n}"] = np.zeros_like(p[f"gram{n}"])
            part = d_x[:, WIDTH * (i + 1) : WIDTH * (i + 2)] / np.sqrt(np.maximum(own, 1))[:, None]
            np.add.at(g[f"gram{n}"], ids[place], np.repeat(part, own, axis=0))
        return g

    def step(self, words: Words, at: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of gradient descent on windows ``at``."""
        p = self.p
        g = self.gradients(words, self.vectors(words), at, label, weight)
        self.t += 1
        for k, v in g.items():
            v = v + 1e-5 * p[k]
            self.m[k] += 0.1 * (v - self.m[k])
            self.s[k] += 0.01 * (v * v - self.s[k])
            fix = np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            p[k] -= (rate * fix * self.m[k] / (np.sqrt(self.s[k]) + 1e-7)).astype(np.float32)

    def calibrate(self, top: np.ndarray, many: np.ndarray, label: np.ndarray) -> None:
        """Logistic regression of labels on the top logit and the log of the number of windows."""
        x = np.stack([top, np.log(many)], axis=1).astype(np.float64)
        mean, spread = x.mean(0), x.std(0) + 1e-6
        z = np.concatenate([np.ones((len(x), 1)), (x - mean) / spread], axis=1)
        w = np.array([0.0, 1.0, 0.0])
        for _ in range(3000):
            w -= 0.3 * (z.T @ (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - label) / len(z) + np.array([0, 1e-3, 1e-2]) * w)
        slope = w[1:] / spread
        self.scale = np.array([w[0] - slope @ mean, *slope])

    def scores(self, column: pa.Array) -> np.ndarray:
        words = Words(column)
        at, text = words.windows()
        if not len(text):
            return np.zeros(0)
        logit = self.logits(words, at)
        begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        top = np.maximum.reduceat(logit, begins)
        many = np.bincount(text)
        return 1 / (1 + np.exp(-np.clip(np.stack([np.ones(len(top)), top, np.log(many)], axis=1) @ self.scale, -30, 30)))


def train(texts: list[str], labels: np.ndarray, calibration: tuple[list[str], np.ndarray], epochs: int = 12, batch: int = 192, seed: int = 5) -> Network:
    """Learn from labelled texts: first from any windows of them, then from each text's most toxic one.

    Small samples are read in smaller batches and more often, up to STEPS steps.
    """
    net = Network(seed)
    rng = np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max():
        # nothing to learn from: one score for all, the share of toxic labels
        net.p["o"][:] = 0
        share = (labels.sum() + 0.5) / (len(labels) + 10)
        net.scale = np.array([np.log(share / (1 - share)), 0.0, 0.0])
        return net
    words = Words(pa.array(texts, pa.string()))
    at, text = words.windows()
    begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    ends = np.append(begins[1:], len(text))
    heavy = np.where(labels == 1, 0.5 * len(labels) / max(1, (labels == 1).sum()), 1.0).clip(1, 3)
    batch = int(np.clip(len(texts) // 10, 32, batch))
    epochs = max(epochs, -(-STEPS * batch // (2 * len(texts))))
    for epoch in range(epochs):
        any_of = lambda: (begins + rng.random(len(begins)) * (ends - begins)).astype(np.int64)
        if epoch < epochs // 3:
            chosen = np.concatenate([any_of(), any_of()])
        else:
            logit = net.logits(words, at)
            best = np.array([a + logit[a:b].argmax() for a, b in zip(begins, ends)])
            other = any_of()
            chosen = np.concatenate([best, other[labels == 0]])
        rng.shuffle(chosen)
        rate = 0.01 if epoch < 2 * epochs // 3 else 0.003
        for i in range(0, len(chosen), batch):
            own = chosen[i : i + batch]
            label = labels[text[own]]
            used = np.unique(at[own][at[own] >= 0])
            few = _only(words, used)
            net.step(few, _renamed(at[own], used), label, heavy[text[own]], rate)
    held = Words(pa.array(calibration[0], pa.string()))
    at, text = held.windows()
    if len(text) and calibration[1].min() < calibration[1].max():
        logit = net.logits(held, at)
        top = np.maximum.reduceat(logit, np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])))
        net.calibrate(top, np.bincount(text), calibration[1])
    return net


def _only(words: Words, used: np.ndarray) -> Words:
    own = object.__new__(Words)
    own.word = words.word[used]
    own.grams = []
    for ids, counts in words.grams:
        n = counts[used]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(counts) - counts)[used], n)
        own.grams.append((ids[place], n))
    return own


def _renamed(at: np.ndarray, used: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, np.searchsorted(used, at), -1)


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(df: DataFrame, labels: DataFrame, sample: dict[str, tuple[int, int]] = SAMPLE) -> Network:
    """Train on a sample of labelled rows outside the held-out fold, chosen by a hash of doc_id and bounded by ``sample``.

    One task reads the sample and trains; only the parameters, of a fixed number, reach
    the driver. An id that repeats counts once, with its smallest text; null ids, null
    labels and ids without a document teach nothing.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("_id", F.lit("sample"))
    aside = F.pmod(F.xxhash64("_id", F.lit("aside")), F.lit(4)) == 0  # a quarter is kept for the calibration
    uses = {"toxic": ~aside & (F.col("toxic") == 1), "clean": ~aside & (F.col("toxic") == 0), "calibration": aside}
    parts = [known.where(uses[u]).orderBy(order).limit(n).withColumn("use", F.lit(u)) for u, (n, _) in sample.items()]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])  # at most the sum of the sample sizes
    rows = df.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = checkpointed(rows.groupBy("use", "_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("use").orderBy(order, "_id").rowsBetween(Window.unboundedPreceding, -1))
    most = F.create_map(*[F.lit(x) for u, (_, size) in sample.items() for x in (u, size)])
    rows = rows.withColumn("_before", F.coalesce(so_far, F.lit(0))).where(F.col("_before") < most[F.col("use")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, tuple[list, list]] = {u: ([], []) for u in ("train", "calibration")}
        for batch in batches:
            for use, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("use", "text", "toxic"))):
                texts, marks = got["calibration" if use == "calibration" else "train"]
                texts.append(text)
                marks.append(toxic)
        (texts, marks), (aside_texts, aside_marks) = got["train"], got["calibration"]
        net = train(texts, np.array(marks, np.float32), (aside_texts, np.array(aside_marks, np.float32)))
        net.m = net.s = {}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    one = rows.repartition(1).sortWithinPartitions("use", F.xxhash64("_id"), "_id").select("use", "text", "toxic")
    got = one.mapInArrow(run, "net binary").first()
    return pickle.loads(got["net"]) if got else train([], np.zeros(0, np.float32), ([], np.zeros(0, np.float32)))


def score_texts(df: DataFrame, net: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every whole text; a null or empty text is one window without words."""
    model = df.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 4 << 20):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.value.scores(part.column(text_col)), pa.float64())], [*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def toxicity(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels are read only to train.

    Rows that repeat are scored alike, each on its own; a null doc_id is not held out.
    """
    scored = score_texts(df.select("doc_id", "text"), fit(df, labels)).drop("text")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below one half, with their columns; repeated rows and rows without a text are scored like others."""
    (score,) = fresh(df, "score")
    return score_texts(df, fit(df, labels), out=score).where(F.col(score) < 0.5).drop(score)
