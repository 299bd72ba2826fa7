"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (hashed byte and byte
pair frequencies, then a learned layer), gated attention weighs the passages, and
the weighted sum is scored. Only document labels are needed; the attention finds
the passages that decide them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

#: Labelled documents used for the fit, and most bytes of their texts.
SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 32 << 20
PASSAGE_BYTES = 400
#: Hashed byte pairs, and byte classes, of a passage.
PAIRS, SINGLES = 128, 64
HIDDEN, ATTENTION = 24, 12
WIDTH = PAIRS + SINGLES

_SLOT = ((np.arange(256, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(8)).astype(np.uint32)
_CLASS = np.arange(256) % SINGLES  # neighbours in a byte range fall apart
_CLASS[0x61:0x7B] = np.arange(26) % SINGLES


def passages(text: bytes) -> np.ndarray:
    """Where passages begin: at every ``PASSAGE_BYTES``; the last takes the rest if it is under half of that."""
    n = max(1, len(text) // PASSAGE_BYTES + (len(text) % PASSAGE_BYTES >= PASSAGE_BYTES // 2))
    return np.arange(n) * PASSAGE_BYTES


def encode(text: bytes | None) -> np.ndarray:
    """Square roots of the frequencies of bytes and byte pairs, a row for each passage (at least one)."""
    a = np.frombuffer(text or b"", np.uint8)
    n = len(passages(text or b""))
    out = np.zeros((n, WIDTH), np.float32)
    if not len(a):
        return out
    where = np.minimum(np.arange(len(a)) // PASSAGE_BYTES, n - 1)
    size = np.bincount(where, minlength=n)[:, None].astype(np.float32)
    one = np.bincount(where * SINGLES + _CLASS[a], minlength=n * SINGLES).reshape(n, SINGLES)
    pair = ((_SLOT[a[:-1]] * np.uint32(31) + _SLOT[a[1:]]) >> np.uint32(5)) % np.uint32(PAIRS)
    two = np.bincount(where[1:] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, :SINGLES] = np.sqrt(one / size)
    out[:, SINGLES:] = np.sqrt(two / size)
    return out


class Network:
    """Passage layer, gated attention and output, with Adam."""

    SHAPES = {"w": (WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "o": (HIDDEN,), "c": (1,)}

    def __init__(self, seed: int = 1):
        r = np.random.RandomState(seed)
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for k, s in self.SHAPES.items()}
        self.p["a"] = r.normal(0, 0.1, ATTENTION)
        self.p["o"] = r.normal(0, 0.1, HIDDEN)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> tuple:
        """Scores of ``n`` bags; ``bag`` names the bag of each passage, ascending."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        starts = np.searchsorted(bag, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag]) if len(e) else e
        weight = e / np.bincount(bag, e, n)[bag]
        z = np.add.reduceat(h * weight[:, None], starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"][0], -30, 30)))
        return x, h, t, g, weight, z, y

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 2) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        r = np.random.RandomState(seed)
        m1 = {k: np.zeros(s) for k, s in self.SHAPES.items()}
        m2 = {k: np.zeros(s) for k, s in self.SHAPES.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                x = np.concatenate([bags[i] for i in some])
                bag = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
                step += 1
                for k, g in self._gradients(x, bag, labels[some]).items():
                    g = g + decay * self.p[k]
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.001 * (g * g - m2[k])
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        x, h, t, g, weight, z, out = self.forward(x, bag, n)
        d = (out - y) / n
        dz = d[:, None] * p["o"]
        dw = (dz[bag] * h).sum(1)
        de = weight * (dw - np.bincount(bag, weight * dw, n)[bag])
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = dz[bag] * weight[:, None] + dt @ p["v"].T + dg @ p["u"].T
        dx = dh * (1 - h * h)
        return {"w": x.T @ dx, "b": dx.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": de @ (t * g), "o": z.T @ d, "c": np.array([d.sum()])}


def _bags(docs: DataFrame, keep: list[str], finish, schema: str) -> DataFrame:
    """``finish`` gets the encoded passages of a few documents at a time."""

    def run(batches):
        for part in slices(batches, 128):
            bags = [encode(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), finish(bags)], [*keep, "out"])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "label", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> Network | float:
    """Fit on at most ``rows`` labels (id, label), picked by a hash of the id, as far as their texts have at most ``most`` bytes.

    Labels other than 0 and 1, without an id or without a document are left out.

    With one label only, or none, the model is a constant: the smoothed share of
    label 1.
    """
    h = F.xxhash64(F.col(doc_id), F.lit(2))
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), h.alias("h"), F.col(label).cast("int").alias("label")).orderBy("h", "label").limit(rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").cast("binary").alias("text"))
    d = texts.join(F.broadcast(chosen), "_id")  # at most ``rows`` ids
    picked = stage(d.select("h", "text", "label").repartition(24, "h"), "labelled")
    size, last = 0, None
    for r in picked.select("h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("h").toLocalIterator():  # two numbers for each of ``rows`` ids
        size += max(r.n, PASSAGE_BYTES)
        if size > most and last is not None:
            break
        last = r.h
    picked = picked.filter(F.col("h") <= F.lit(last if last is not None else 0))
    packed = _bags(picked.select("text", "label"), ["label"], lambda bags: pa.array([(b * 255).astype(np.uint8).tobytes() for b in bags], pa.binary()), "label int, out binary")
    got = packed.collect()
    labels = np.array([r.label for r in got], float)
    if len(set(labels.tolist())) < 2:
        return float((labels.sum() + 1) / (len(labels) + 2))
    bags = [np.frombuffer(r.out, np.uint8).reshape(-1, WIDTH).astype(np.float32) / 255 for r in got]
    net = Network()
    net.fit(bags, labels)
    return net


def score(docs: DataFrame, model: Network | float, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, attention`` for every document.

    ``attention`` is the weight of each passage. Null and empty texts are one
    passage of zeros. Whole texts are read; a long one costs memory for its own
    passages only. Repeated rows repeat.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def finish(bags: list[np.ndarray]) -> pa.Array:
        net, sizes = sent.value, [len(b) for b in bags]
        if isinstance(net, float):
            weights = [np.full(n, 1 / n) for n in sizes]
            y = np.full(len(bags), net)
        else:
            *_, weight, _, y = net.forward(np.floor(np.concatenate(bags) * 255) / 255, np.repeat(np.arange(len(bags)), sizes), len(bags))
            weights = np.split(weight, np.cumsum(sizes)[:-1])
        return pa.StructArray.from_arrays([pa.array(y), pa.array([w.astype(np.float32) for w in weights], pa.list_(pa.float32()))], ["score", "attention"])

    out = _bags(d, ["doc_id"], finish, f"doc_id {kind}, out struct<score:double,attention:array<float>>")
    return out.select("doc_id", "out.score", "out.attention")
