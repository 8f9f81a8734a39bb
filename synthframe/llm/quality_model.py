"""Byte-level convolutional quality classifier in numpy.

A text's bytes are covered by overlapping chunks.  Learned filters slide over every
byte; each chunk keeps every filter's largest response, and the mean and the largest
over the chunks combine into one probability by a logistic layer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.llm.common import bounded_sample, held_out, texts, tidied

WIDTH, FILTERS, CHUNK = 6, 12, 256
STEP = CHUNK - WIDTH + 1  # chunks overlap by a filter's width, so no position is skipped
BLOCK = 512  # chunks scored at once; bounds memory for texts of any length


def chunks(text: str) -> np.ndarray:
    """The chunks of a text's bytes, the last padded with zeros; an empty text is one chunk of zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-max(0, len(raw) - WIDTH + 1) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
    padded[:min(len(raw), len(padded))] = raw[:len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class QualityModel:
    """Filters as one table per offset (a learned byte embedding folded into them) and a logistic layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.15).astype(np.float32)
        self.out = (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.bias = np.float32(0.0)

    def peaks(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, response) of each filter's largest response in each chunk, `BLOCK` chunks at a time."""
        where, top = [], []
        for start in range(0, len(block), BLOCK):
            response = self.responses(block[start:start + BLOCK])
            at = response.argmax(axis=1)
            where.append(at)
            top.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(where), np.concatenate(top)

    def responses(self, block: np.ndarray) -> np.ndarray:
        """Filter responses at each position of each chunk."""
        total = self.table[0][block[:, :STEP]]
        for k in range(1, WIDTH):
            total += self.table[k][block[:, k:k + STEP]]
        return total

    def pooled(self, block: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(block).max(axis=1), 0.0)

    def score(self, text: str) -> float:
        parts = chunks(text)
        total, most = np.zeros(FILTERS), np.zeros(FILTERS, dtype=np.float32)
        for start in range(0, len(parts), BLOCK):
            pooled = self.pooled(parts[start:start + BLOCK])
            total += pooled.sum(axis=0)
            most = np.maximum(most, pooled.max(axis=0))
        z = np.concatenate((total / len(parts), most)) @ self.out + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))

    def train(self, documents: list[np.ndarray], labels: np.ndarray, rounds: int = 14, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on the log loss; a gradient flows to the position that won each maximum."""
        rng = np.random.default_rng(seed)
        params = [self.table, self.out, np.zeros(1, np.float32)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weights = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) * len(labels)
        step = 0
        for _ in range(rounds):
            for batch in np.array_split(rng.permutation(len(documents)), max(1, len(documents) // 32)):
                sizes = [len(documents[i]) for i in batch]
                block = np.concatenate([documents[i] for i in batch])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                where, top = self.peaks(block)
                pooled = np.maximum(top, 0.0)
                mean = np.add.reduceat(pooled, starts) / np.array(sizes, np.float32)[:, None]
                most = np.maximum.reduceat(pooled, starts)
                z = np.concatenate((mean, most), axis=1) @ self.out + params[2][0]
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
                error = ((p - labels[batch]) * weights[batch] / len(batch)).astype(np.float32)
                owner = np.repeat(np.arange(len(batch)), sizes)
                won = (pooled == most[owner]) & (pooled > 0)
                back = error[owner, None] * (self.out[:FILTERS] / np.array(sizes, np.float32)[owner, None] + self.out[FILTERS:] * won)
                back = back * (top > 0)
                table_grad = 1e-4 * self.table
                rows = np.arange(len(block))[:, None]
                columns = np.broadcast_to(np.arange(FILTERS), where.shape)
                for k in range(WIDTH):
                    np.add.at(table_grad[k], (block[rows, where + k], columns), back)
                grads = [table_grad, np.concatenate((mean, most), axis=1).T @ error + 1e-4 * self.out, np.array([error.sum()], np.float32)]
                step += 1
                for value, grad, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
        self.bias = np.float32(params[2][0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 500) -> QualityModel:
    """Learn from about `per_class` labelled documents of each class (the bound of the sample).

    Held-out rows (crc32(doc_id) mod 3 = 1), null ids, texts and labels are not learned
    from.  The sampled texts reach the driver whole, and all their chunks are learned
    from.  Several labels of one document count as their smallest; of several texts
    under one id the first in the order of the letters is learned from.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(marked, "quality", per_class).select("doc_id", "quality").collect()  # at most 4 x per_class small rows
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in chosen], "doc_id bigint, quality int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sample = sorted((r["doc_id"], r["quality"], r["text"]) for r in rows.collect())
    model = QualityModel()
    marks = np.array([quality for _, quality, _ in sample], dtype=np.float32)
    if sample:
        model.train([chunks(text) for _, _, text in sample], marks)
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Empty and null texts are scored as no bytes; repeated rows alike; null ids are
    carried and count as not held out.  Without labelled rows the untrained model's
    scores near 0.5 are returned.  No column but doc_id and text is read.
    """
    rows = texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def scored(batches):
        for batch in batches:
            values = [shared.value.score(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(tidied(scored), "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
