"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - threshold k): one weight vector over hashed byte n-grams (mean over the
text) serves all grades, and ordered thresholds part them. A text gets its expected grade and, for
selection, its tail probability P(grade >= keep_from). Fitted by stochastic gradients on at most
`rows` rated documents (by hash, twice that at most), outside the held-out fold, and applied to
every whole text.

The ratings of this repository's tables: 0 for quality 0, 1 for quality 1 and toxic, 2 for quality 1
and not toxic; a null label gives no rating.

Defined results: null and empty texts have mean 0, so the model's score for no evidence; without any
rating every document is kept, with the tail probability 1. A tail probability of exactly `cut` is
kept. Rows that share an id are graded each by itself; equal ones are learned once, and an id with
several ratings is learned with each. A very long text is graded whole, at some 40 bytes of memory a
byte. An empty table gives an empty result. Only the text is used; columns named like the result's
are left out unless carried under another name.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashed_text import Grams, Sparse, batches_of, bounded, distinct_texts, training_rows
from tidemark.llm.shared import held_out

GRAMS = Grams(bits=16, sizes=(1, 2, 3), words=False)


class OrdinalModel(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(data: Sparse, grades: int, *, epochs: int = 20, batch: int = 32, rate: float = 1.0, shrink: float = 1e-5, seed: int = 11) -> OrdinalModel | None:
    """Maximum likelihood of the cumulative-link model; thresholds stay ordered as first + sums of exponentials."""
    if not len(data):
        return None
    rng = np.random.default_rng(seed)
    y = np.array([int(x) for x in data.labels])
    w, g_w = np.zeros(2**GRAMS.bits), np.full(2**GRAMS.bits, 1e-8)
    gaps, g_gaps = np.zeros(grades - 1), np.full(grades - 1, 1e-8)
    gaps[0] = -1.0
    order = np.arange(len(data))
    for _ in range(epochs):
        rng.shuffle(order)
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            index, value, of = data.part(rows, "mean")
            s = np.bincount(of, value * w[index], len(rows))
            t = gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])
            edge = np.concatenate([[-np.inf], t, [np.inf]])
            upper, lower = sigmoid(edge[y[rows] + 1] - s), sigmoid(edge[y[rows]] - s)
            p = np.maximum(upper - lower, 1e-9)
            d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
            d_s = (d_upper - d_lower) / len(rows)  # of the negative log likelihood
            d_t = np.zeros(grades - 1)
            for k in range(grades - 1):
                d_t[k] = (np.where(y[rows] == k + 1, d_lower, 0.0) - np.where(y[rows] == k, d_upper, 0.0)).sum() / len(rows)
            d_gaps = np.concatenate([[d_t.sum()], [d_t[k + 1 :].sum() * np.exp(gaps[1 + k]) for k in range(grades - 2)]])
            g_gaps += d_gaps**2
            gaps -= 0.1 * d_gaps / np.sqrt(g_gaps)
            used, where = np.unique(index, return_inverse=True)
            d = np.bincount(where, value * d_s[of], len(used)) + shrink * w[used]
            g_w[used] += d * d
            w[used] -= rate * d / np.sqrt(g_w[used])
    return OrdinalModel(w.astype(np.float32), gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))]))


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rows: int = 4000) -> OrdinalModel | None:
    rated = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "0").when(F.col("toxic") == 1, "1").when(F.col("toxic") == 0, "2").alias("label"))
    rated = bounded(rated.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))), ["id", "label"], rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull())
    found = distinct_texts(texts.join(F.broadcast(rated), "id"))  # rated: 2 * rows ids at most
    return train(training_rows(found, GRAMS, 2 * rows), 3)


def grade(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text", *, keep_from: int = 1, cut: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """id, held_out, expected_grade, tail_probability, keep, and the columns of carry; the text itself is carried once."""
    carry, with_text = [c for c in carry or [] if c != text_col], text_col in (carry or [])
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.struct(F.lit(1).alias("0"), *[F.col(f"`{c}`").alias(str(i + 1)) for i, c in enumerate(carry)]).alias("rest"))
    from pyspark.sql import types as T

    own = {f.name: f for f in plain.schema.fields}
    schema = T.StructType([own["id"], own["held_out"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("keep", T.BooleanType()), own["rest"], *([own["text"]] if with_text else [])])

    def score(batches):
        for batch in batches:
            for a, z, texts in batches_of(batch, 1):
                n = z - a
                tails = np.ones((n, 1))
                if model:
                    sums, count = GRAMS.sums(texts, model.weights[:, None])
                    tails = sigmoid((sums[:, 0] / np.maximum(count, 1))[:, None] - model.thresholds)
                tail = tails[:, keep_from - 1] if model else tails[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= cut), batch.column(3).slice(a, n), *([texts] if with_text else [])], names=[f.name for f in schema.fields])

    return plain.mapInArrow(score, schema).select(F.col("id").alias(id_col), "held_out", "expected_grade", "tail_probability", "keep", *[F.col(f"rest.`{i + 1}`").alias(c) for i, c in enumerate(carry)], *([F.col("text").alias(text_col)] if with_text else []))
