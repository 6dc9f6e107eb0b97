"""Quality classifier by positive-unlabelled learning.

The trusted positives are documents labelled good; the unlabelled ones are web text without its labels. Of the class prior p,
the risk R_p(+) of calling positives negative, and so on, the non-negative estimator minimises
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): where the second part would fall below 0, its gradient is
turned, so that the model doesn't learn positives of the unlabelled part as negatives by heart. The prior is estimated as
the share of positives among the labelled training rows, smoothed. The model is a small network with one hidden layer over
counts that are read off the text alone: classes of characters and of their pairs, lengths, repetition of words and lines.
At last a logistic curve of two parameters, fitted to labelled training rows, turns its output into a probability.

Only rows whose crc32(doc_id as text) mod 4 is not 2 teach anything. The fit runs on the driver over samples of documents,
drawn by a hash of the id, whose bounds are parameters (POSITIVES, UNLABELLED, CALIBRATION); the README has accuracies for other
bounds. Scoring runs over all documents. Beside the risk, labels of both kinds enter in two places: the prior and the curve.
Null texts are empty; empty texts get the score that their features give. Repeated rows get equal scores; of several rows of
one doc_id the least text teaches, once. Rows without doc_id aren't held out and teach nothing. Without labelled positives the score is the prior for all; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, through
from .encode import forget

#: Bounds of the samples that the fit sees.
POSITIVES, UNLABELLED, CALIBRATION = 6_000, 12_000, 6_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 16, 60, 512, 0.01, 7
THRESHOLD = 0.7
#: Classes of bytes: 0 other control, 1 line break, 2 space, 3 digit, 4 capital, 5 small letter, 6 non-ASCII, then marks in groups.
_GROUPS = [".", ",;:", "!", "?", "'\"`", "()[]{}", "<>", "|", "*", "#", "$", "%", "&", "=+-_/\\~^@"]
CLASSES = 7 + len(_GROUPS)


def _class(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return 6
    for i, g in enumerate(_GROUPS):
        if c in g:
            return 7 + i
    return 1 if c == "\n" else 2 if c in " \t\r" else 3 if c.isdigit() else 4 if c.isupper() else 5 if c.islower() else 0


_TABLE = bytes(_class(b) for b in range(256))
N_FEATURES = CLASSES + CLASSES * CLASSES + 14
_SPACE = re.compile(rb"[ \n\t\r]+")


def features(text: str | None) -> np.ndarray:
    """Numbers that describe the whole text, each of about the order of 1."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not data:
        return out
    c = np.frombuffer(data.translate(_TABLE), dtype=np.uint8)
    n = len(c)
    out[:CLASSES] = np.bincount(c, minlength=CLASSES)[:CLASSES] / n
    if n > 1:
        pairs = np.bincount(c[:-1].astype(np.int16) * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        out[CLASSES : CLASSES + CLASSES * CLASSES] = pairs / (n - 1)
    words = data.split()
    k = max(1, len(words))
    kinds = len(set(words))
    lines = [x for x in data.split(b"\n") if x]
    sizes = np.fromiter(map(len, words), dtype=np.float32, count=len(words)) if words else np.zeros(1, dtype=np.float32)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs_ = len({*zip(words, words[1:], strict=False)})
    triples = len({*zip(words, words[1:], words[2:], strict=False)})
    head = CLASSES + CLASSES * CLASSES
    out[head:] = [
        np.log1p(n) / 10, np.log1p(len(words)) / 8, np.log1p(len(lines)) / 5,
        kinds / k, kinds / k**0.8, same / k, pairs_ / max(1, len(words) - 1), triples / max(1, len(words) - 2),
        len(set(lines)) / max(1, len(lines)), sizes.mean() / 8, sizes.std() / 8, min(sizes.max(), 64) / 32,
        len(zlib.compress(data[: 1 << 15], 1)) / min(n, 1 << 15) if n < 1 << 15 else _ratio(data), 1.0,
    ]
    return out


def _ratio(data: bytes) -> float:
    """Compressed share of a long text, block by block."""
    step = 1 << 15
    return float(np.mean([len(zlib.compress(data[i : i + step], 1)) / len(data[i : i + step]) for i in range(0, len(data), step)]))


class Model:
    """A network with one hidden layer, trained with the non-negative risk of positive-unlabelled learning."""

    def __init__(self, prior: float):
        self.prior, self.mean, self.scale, self.weights, self.curve = prior, None, None, None, (1.0, 0.0)

    @staticmethod
    def _loss(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sigmoid loss of margins and its derivative."""
        s = 1 / (1 + np.exp(np.clip(z, -30, 30)))
        return s, -s * (1 - s)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.weights
        h = np.maximum(0, x @ w + b)
        return h, h @ v + c

    def start(self, positive: np.ndarray, unlabelled: np.ndarray, draw: np.random.Generator) -> None:
        """The features' means and scales, and first weights."""
        n, d = len(positive) + len(unlabelled), positive.shape[1]
        self.mean = (positive.sum(axis=0, dtype=np.float64) + unlabelled.sum(axis=0, dtype=np.float64)) / n
        square = sum(((x[i : i + BATCH] - self.mean) ** 2).sum(axis=0) for x in (positive, unlabelled) for i in range(0, len(x), BATCH))
        self.scale = np.sqrt(square / n) + 0.02
        self.weights = [draw.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def risk(self, positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, float]:
        """p R+(positives), and R-(unlabelled) - p R-(positives)."""
        zp, zu = self._forward(self.scaled(positive))[1], self._forward(self.scaled(unlabelled))[1]
        return self.prior * self._loss(zp)[0].mean(), self._loss(-zu)[0].mean() - self.prior * self._loss(-zp)[0].mean()

    def gradient(self, positive: np.ndarray, unlabelled: np.ndarray) -> list[np.ndarray]:
        """Of the sum of both parts; where the second is under 0, of that part turned, alone."""
        x = self.scaled(np.concatenate([positive, unlabelled]))
        h, z = self._forward(x)
        n, k = len(positive), len(unlabelled)
        gp = self._loss(z[:n])[1]
        ln, gn = self._loss(-z[:n])
        lu, gu = self._loss(-z[n:])
        back = np.concatenate([self.prior * gn / n, -gu / k])
        g = np.concatenate([self.prior * gp / n, np.zeros(k)]) + back if lu.mean() - self.prior * ln.mean() >= 0 else -back
        hidden = np.outer(g, self.weights[2]) * (h > 0)
        return [x.T @ hidden, hidden.sum(axis=0), h.T @ g, g.sum(keepdims=True)]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray) -> Model:
        draw = np.random.default_rng(SEED)
        self.start(positive, unlabelled, draw)
        m, s, t = [np.zeros_like(x) for x in self.weights], [np.zeros_like(x) for x in self.weights], 0
        steps = max(1, min(len(unlabelled), 40 * BATCH) // BATCH)
        for _ in range(EPOCHS * steps):
            i, j = (draw.integers(0, len(x), min(BATCH, len(x))) for x in (positive, unlabelled))
            t += 1
            for w, g, a, b in zip(self.weights, self.gradient(positive[i], unlabelled[j]), m, s, strict=True):
                g = g + 1e-4 * w
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Model:
        """Fits score = 1 / (1 + exp(-(a margin + b))) to labelled rows, with smoothed targets."""
        z = self._forward(self.scaled(x))[1]
        up, down = y.sum(), len(y) - y.sum()
        if not up or not down:
            return self
        target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        spread = z.std() + 1e-9
        a, b = 1.0 / spread, 0.0
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            e, w = q - target, q * (1 - q) + 1e-9
            gradient = np.array([(e * z).sum() + 1e-3 * a * spread**2, e.sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3 * spread**2, (w * z).sum()], [(w * z).sum(), w.sum()]])
            step = np.linalg.solve(hess + 1e-9 * np.eye(2), gradient)
            a, b = a - np.clip(step[0], -2 / spread, 2 / spread), b - np.clip(step[1], -2, 2)
        self.curve = (max(a, 1e-6), b)
        return self

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self._forward(self.scaled(x))[1] + b, -700, 700)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """Column text as features (binary, 32-bit floats), the other columns as they are."""
    at = docs.columns.index("text")
    schema = ", ".join(f"{n} {'binary' if n == 'text' else k}" for n, k in docs.dtypes)

    def task(batches):
        forget()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                cols = [pa.array([features(t).tobytes() for t in c.to_pylist()], pa.binary()) if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(task, schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on bounded samples of the training rows. A document with several labels is good if all say so."""
    key = lambda salt: F.xxhash64("doc_id", F.lit(salt))
    texts = narrow(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = narrow(labels, "doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.lit(0)).alias("good")).first()
    model = Model((counts.good + 1) / (counts.n + 2))
    if not counts.good:
        return model
    good = known.filter("quality = 1").orderBy(key(1), "doc_id").limit(POSITIVES).select("doc_id", F.lit(1).alias("part"), "quality")
    any_ = texts.select("doc_id").distinct().orderBy(key(2), "doc_id").limit(UNLABELLED).select("doc_id", F.lit(2).alias("part"), F.lit(None).cast("int").alias("quality"))
    check = known.orderBy(key(3), "doc_id").limit(CALIBRATION).select("doc_id", F.lit(3).alias("part"), "quality")
    # The samples have at most POSITIVES + UNLABELLED + CALIBRATION ids, of a few bytes each, and a row an id comes back.
    sample = good.unionAll(any_).unionAll(check).groupBy("doc_id").agg(F.collect_list(F.struct("part", "quality")).alias("parts"))
    one = texts.join(F.broadcast(sample.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = described(one.join(F.broadcast(sample), "doc_id").select("doc_id", "parts", "text")).orderBy("doc_id").toArrow()
    x = np.frombuffer(b"".join(rows.column("text").to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES)
    at, y = {1: [], 2: [], 3: []}, []
    for i, parts in enumerate(rows.column("parts").to_pylist()):
        for p in parts:
            at[p["part"]].append(i)
            if p["part"] == 3:
                y.append(p["quality"])
    if not at[1] or not at[2]:
        return model
    model.fit(x[at[1]], x[at[2]])
    return model.calibrate(x[at[3]], np.array(y)) if y else model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                x = np.array([features(t) for t in part.column(1).to_pylist()]).reshape(part.num_rows, N_FEATURES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(x), pa.float64())], ["doc_id", "score"])

    return narrow(docs, "doc_id", "text").mapInArrow(task, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, all columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def task(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                x = np.array([features(t) for t in part.column(at).to_pylist()]).reshape(part.num_rows, N_FEATURES)
                yield part.filter(pa.array(held.value.score(x) >= threshold))

    return through(docs, task)
