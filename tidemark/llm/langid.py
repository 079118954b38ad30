"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte n-grams (of 2 to 4 bytes, within a
word and its borders). Embeddings and softmax are trained together by stochastic gradient descent on
about `rows` labelled documents, `least` of each language where it has them, chosen by hash outside
the held-out fold; twice that at most. A fifth of them isn't trained on: it sets the softmax's
temperature and the score from which a prediction is accepted at the wanted precision (below 50 rows
the rows trained on set them, so acceptance is too bold there). For prediction, embeddings and softmax are multiplied out to one row of scores a
bucket, so every n-gram of every whole text costs one look-up.

Defined results: null and empty texts and texts without a letter are `und` with score 0 and not
accepted; so is everything where there is no labelled row to learn from. Of equal scores the language
first by name wins. Rows that share an id or a text are predicted each by itself and learned once. A
very long text is predicted whole, at some 60 bytes of memory a byte. An empty table gives an empty
result. Other columns, also `lang` and `source` and those named like the result's, have no part in it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashed_text import PLACES, Grams, Sparse, batches_of, distinct_texts, place, training_rows
from tidemark.llm.shared import held_out

GRAMS = Grams(bits=16, sizes=(2, 3, 4), words=True)


class LanguageModel(NamedTuple):
    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    accept_from: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(data: Sparse, *, width: int = 12, epochs: int = 6, batch: int = 32, rate: float = 0.5, precision: float = 0.99, seed: int = 7) -> LanguageModel | None:
    languages = sorted(set(data.labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in data.labels])
    order = rng.permutation(len(data))
    check = order[: len(data) // 5] if len(data) >= 50 else order
    learn = order[len(data) // 5 :] if len(data) >= 50 else order
    buckets = 2**GRAMS.bits
    embed, weight, bias = rng.normal(0, 0.1, (buckets, width)), np.zeros((width, len(languages))), np.zeros(len(languages))
    g_embed, g_weight, g_bias = np.full(embed.shape, 1e-8), np.full(weight.shape, 1e-8), np.full(bias.shape, 1e-8)
    for _ in range(epochs):
        rng.shuffle(learn)
        for a in range(0, len(learn), batch):
            rows = learn[a : a + batch]
            index, value, of = data.part(rows, "mean")
            mean = np.stack([np.bincount(of, value * embed[index, j], len(rows)) for j in range(width)], axis=1)
            p = _softmax(mean @ weight + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ weight.T
            for x, g, d in ((weight, g_weight, mean.T @ p), (bias, g_bias, p.sum(axis=0))):
                g += d * d
                x -= rate * d / np.sqrt(g)
            used, where = np.unique(index, return_inverse=True)
            d = np.stack([np.bincount(where, value * back[of, j], len(used)) for j in range(width)], axis=1)
            g_embed[used] += d * d
            embed[used] -= rate * d / np.sqrt(g_embed[used])
    index, value, of = data.part(check, "mean")
    scores = embed @ weight
    z = np.stack([np.bincount(of, value * scores[index, c], len(check)) for c in range(len(languages))], axis=1) + bias
    heats = np.geomspace(0.25, 16, 49)
    losses = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in heats]
    heat = float(heats[int(np.argmin(losses))])
    p = _softmax(z / heat)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    by_score = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[by_score]) >= precision * np.arange(1, len(check) + 1))
    return LanguageModel(languages, scores.astype(np.float32), bias, heat, float(best[by_score[good[-1]]]) if len(good) else 1.0)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score, accepted, for every whole text."""

    def score(batches):
        for batch in batches:
            for a, z, texts in batches_of(batch, 1):
                n = z - a
                letters = np.fromiter(map(has_letter, texts.to_pylist()), bool, n) & (model is not None)
                names, best = ["und"] * n, np.zeros(n)
                if model:
                    sums, count = GRAMS.sums(texts, model.scores)
                    p = _softmax((sums / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
                    names = [model.languages[i] if ok else "und" for i, ok in zip(p.argmax(axis=1), letters)]
                    best = np.where(letters, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(names), pa.array(best), pa.array(letters & (best >= (model.accept_from if model else 2)))], names=["id", "held_out", "lang_pred", "score", "accepted"])

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held_out(F.col(f"`{id_col}`")).alias("held_out"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(score, f"id {kind}, held_out boolean, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, rows: int = 4000, least: int = 200) -> LanguageModel | None:
    """A model of every language, from about `rows` rows with a language (`least` of each, or all it has), outside the held-out fold."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("label"))
    own = own.where(F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = own.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("id", "text")).alias("n")).orderBy(F.desc("n"), "label").collect()  # a row a language
    if not counts:
        return None
    total = sum(r.n for r in counts)
    share = {r.label: min(1.0, max(rows / total, least / max(1, r.n))) for r in counts}
    upto = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, max(1, round(PLACES * v)))])
    some = own.where(place("id", "text", "label") < F.try_element_at(upto, F.col("label")))
    return train(training_rows(distinct_texts(some), GRAMS, 2 * (rows + least * len(counts))))
