"""Quality classifier: Bradley-Terry pairwise ranking.

Each document is a vector of text statistics. The model is fitted on pairs of
a preferred (label 1) and another (label 0) document: the probability that the
first wins is the logistic function of the difference of their scores, a
linear function of the difference of their features. The scores' threshold is
the quantile that leaves the training rows' share of label 0 below it; a
document's result is logistic(score - threshold), so 0.5 is the threshold.

Labels are learned from a sample of at most `MAX_LABELLED` rows, those with the
smallest hash of their id, and `PAIRS` pairs; scoring covers every whole text.

Defined results: null and empty texts have the statistics of an empty text and
get a score like any other; without labels of both kinds every score is 0.5;
repeated rows get equal scores; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

MAX_LABELLED = 20_000
PAIRS = 60_000
RIDGE = 1e-3
#: Characters counted one by one: ends and joints of sentences, and marks that prose has few of.
MARKS = "!?.,;:%#$&*|@<>{}[]()=_/\\\"'-+~^"
WIDTH = len(MARKS) + 16


def features(text: str | None) -> list[float]:
    """Statistics of one text."""
    text = text or ""
    n = len(text) or 1
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words = text.split()
    w = len(words) or 1
    kinds = Counter(words)
    lines = text.split("\n")
    line_kinds = len(set(lines))
    upper, lower, digits = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[48:58].sum())
    most = max(kinds.values(), default=0)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    rare = sum(c == 1 for c in kinds.values())
    out = [float(np.log1p(1000.0 * raw[ord(c)] / n)) for c in MARKS]
    out += [
        np.log1p(len(words)), np.log1p(len(lines)), n / w, upper / n, upper / (upper + lower + 1), digits / n,
        len(kinds) / w, most / w, again / w, rare / w, line_kinds / len(lines), np.log1p(n / len(lines)),
        sum(map(str.isupper, kinds)) / max(1, len(kinds)), sum(map(str.istitle, kinds)) / max(1, len(kinds)),
        max(map(len, kinds), default=0) / 100, int(raw[128:].sum()) / n,
    ]
    return [float(v) for v in out]


def expand(x: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    """Standardised statistics, cut off at four deviations, and their squares."""
    z = np.clip((x - mean) / dev, -4, 4)
    return np.concatenate([z, z * z / 4], 1)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> dict:
    """Weights and threshold from statistics `x` and labels `y`."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(WIDTH), "dev": np.ones(WIDTH), "w": np.zeros(2 * WIDTH), "threshold": 0.0}
    mean, dev = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = expand(x, mean, dev)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(12):  # Newton steps on the logistic loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / len(d) + RIDGE * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    return {"mean": mean, "dev": dev, "w": w, "threshold": float(np.quantile(s, float((y == 0).mean())))}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    s = expand(x, model["mean"], model["dev"]) @ model["w"] - model["threshold"]
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", hold_out: int | None = 1) -> dict:
    """Fit on a bounded sample of labelled rows; rows with crc32(id) mod 3 = `hold_out` are never learned from."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    if hold_out is not None:
        rows = rows.where(F.crc32(F.col("id").cast("string")) % 3 != hold_out)
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            x = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    # the labelled ids are few: a join against them keeps the texts where they are
    got = texts.join(F.broadcast(chosen), "id").select(F.col("id").cast(kind), "y", "text").mapInArrow(run, f"id {kind}, y int, x array<double>").orderBy("id", "y").limit(MAX_LABELLED).toPandas()  # rows that share an id could be more
    if not len(got):
        return fit(np.zeros((0, WIDTH)), np.zeros(0, int))
    return fit(np.array(got["x"].tolist(), float), got["y"].to_numpy())


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns `id_col`, score double, predicted int, for every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            if b.num_rows:
                s = predict(model, np.array([features(t) for t in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text the model does not reject."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            if b.num_rows:
                s = predict(model, np.array([features(t) for t in b.column(at).to_pylist()]))
                yield b.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
