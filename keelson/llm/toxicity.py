"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (into 2^BITS places) of its words, of pairs of neighbours and of pairs with
one word between. Words are lower-cased and stripped of marks at both ends. Training runs over a bounded sample of
labelled rows (the ``max_rows`` rows with the smallest hash of their id) in one task: the only step that is bounded.
Per-coordinate learning rates and L1 shrinkage leave few weights; they are collected as two arrays (at most 2^BITS
entries, some MB), broadcast, and every whole text is scored where it lies.

Defined results: a null or empty text has no features and gets the score of the bias; rows without a label are not
trained on; an id that the documents repeat is trained on once, with its least text, an id that the labels repeat with
each of its labels; repeated documents are scored each; a very long text is read whole; a score of exactly 0.5 is
predicted 1; without any training row every score is 0; an empty table gives an empty result; of the documents only the
id (to find labels) and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _CACHES, keep_only, ship, text_or_empty

BITS = 20
#: Labelled rows to train on, at most.
MAX_ROWS = 12_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
#: One training row in so many is kept out of the training to set the scale and the bias of the scores.
CALIBRATE = 5
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
#: Words whose hashes a worker keeps.
WORDS = 1_000_000
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Lower-cased piece -> hash of the word in it, 0 for none."""

    def __missing__(self, piece: bytes) -> int:
        word = piece.decode().lower().strip(MARKS)
        if len(self) >= WORDS:
            self.clear()
        h = self[piece] = xxhash.xxh3_64_intdigest(word) if word else 0
        return h


_HASHES = _Hashes()
_CACHES["toxicity"] = _HASHES.clear


def _fold(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.uint32)


def occurrences(text: str) -> np.ndarray:
    """Places of all features of a text, repeats included."""
    pieces = text.encode().lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, pieces), np.uint64, len(pieces))
    h = h[h != 0]
    return np.concatenate([_fold(h), _fold(h[:-1] * _PAIR + h[1:]), _fold(h[:-2] * _SKIP + h[2:] + np.uint64(1))]) if len(h) else np.zeros(0, np.uint32)


def train_ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
               l1: float = L1, l2: float = L2) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal over (distinct feature places, label) in the given order: bias, places, weights."""
    size = 1 << BITS
    z, n, bias_z, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0

    def weights(at):
        zs = z[at]
        w = (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zs) <= l1] = 0.0
        return w

    def bias():
        return -bias_z / ((beta + np.sqrt(bias_n)) / alpha)

    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias(), -35, 35)))
            g = p - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            b = bias()
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    w = weights(slice(None))
    at = np.flatnonzero(w)
    return float(bias()), at.astype(np.uint32), w[at].astype(np.float32)


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale of margins by logistic regression on smoothed targets (finite for separable rows), and the shift that puts
    1/2 at the best cut."""
    pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
    if not pos or not neg or margins.max() == margins.min():
        return 1.0, 0.0
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, beta = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])

    def loss(b):
        m = x @ b
        return float((np.logaddexp(0, m) - target * m).sum())

    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step, rate = np.linalg.solve(hessian, x.T @ (p - target)), 1.0
        while rate > 1e-6 and loss(beta - rate * step) > loss(beta):
            rate /= 2
        beta = beta - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    if beta[0] <= 0:
        return 1.0, 0.0
    return float(beta[0]), -float(beta[0]) * best_cut(margins, labels)


def best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin that parts the classes with the fewest errors, in the middle of the widest gap that does. A clean text
    above it counts as much as a missed one."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], labels[order]
    missed, clean = np.cumsum(y), np.cumsum(1 - y)  # below a cut behind each place
    errors = missed + clean[-1] - clean
    gaps = np.diff(m)
    inner = np.where(gaps > 0, errors[:-1], errors.max() + 1)
    best = np.flatnonzero(inner == inner.min())
    i = best[np.argmax(gaps[best])]
    return float((m[i] + m[i + 1]) / 2)


def train_calibrated(rows: list[tuple[np.ndarray, int]]) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL on the rows but one in CALIBRATE, whose margins set the scale and the bias."""
    held = rows[::CALIBRATE]
    bias, at, w = train_ftrl([r for i, r in enumerate(rows) if i % CALIBRATE])
    weights = np.zeros(1 << BITS)
    weights[at] = w
    scale, shift = calibrate(np.array([bias + weights[f].sum() for f, _ in held]), np.array([y for _, y in held]))
    return scale * bias + shift, at, (scale * w).astype(np.float32)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 max_rows: int = MAX_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """Train on at most ``max_rows`` labelled rows; ``labels`` holds the rows to learn from."""
    ship(docs.sparkSession)
    picked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.lit(7), id_col).alias("h"))
    picked = picked.orderBy("h", "id", "y").limit(max_rows)  # max_rows narrow rows: bounded for the broadcast
    x = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).join(F.broadcast(picked), "id")
    x = x.groupBy("h", "id", "y").agg(F.min("t").alias("t")).select("h", "y", "t")  # an id that repeats is one row

    def features(batches):
        keep_only("toxicity")
        for batch in batches:
            found = [np.unique(occurrences(t)).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["h", "y", "f"])

    # the texts are read where they lie; one task gets the features of max_rows rows
    x = x.mapInArrow(features, "h bigint, y int, f binary").repartition(1)

    def run(batches):
        keep_only("toxicity")
        held = []
        for batch in batches:
            for h, y, f in zip(*(batch.column(c).to_pylist() for c in range(3))):
                held.append((h, y, np.frombuffer(f, "<u4")))
        held.sort(key=lambda r: (r[0], r[1], len(r[2])))
        if held:
            b, at, w = train_calibrated([(f, y) for _, y, f in held])
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([w.astype("<f4").tobytes()], pa.binary())], ["b", "at", "w"])

    row = x.mapInArrow(run, "b double, at binary, w binary").first()
    if row is None:
        return -np.inf, np.zeros(0, np.uint32), np.zeros(0, np.float32)
    return row.b, np.frombuffer(row["at"], "<u4"), np.frombuffer(row["w"], "<f4")


def score_toxicity(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    x = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))

    def run(batches):
        keep_only("toxicity")
        bias, at, w = sent.value
        weights = np.zeros(1 << BITS, np.float64)
        weights[at] = w
        used = weights != 0
        for batch in batches:
            scores, texts = np.empty(batch.num_rows), batch.column(1)
            for i in range(batch.num_rows):
                f = occurrences(texts[i].as_py())
                scores[i] = bias + weights[np.unique(f[used[f]])].sum()
            scores = 1.0 / (1.0 + np.exp(-np.clip(scores, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, score double")


def remainder(id_col: str, divisor: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 5) != 0)
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 5) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
