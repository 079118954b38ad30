"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), x_i: whether hashed term i
(a word, or a word's beginning) occurs in the whole text. The factors v learn pairs, such as an insult
with a group's mention, that the linear weights alone miss.

Terms enter by two tests. Alone: their document counts in the toxic and other labelled texts differ by
`z` standard errors at least. In company: the same among the labelled texts that hold one of the
`anchors` strongest terms, for anchors with 30 texts of each kind or more (by `company_z` standard
errors), so a word that says nothing by itself enters if it tells toxic from other
uses of an insult. The `terms` strongest enter at most. Fitted on at most `rows` labelled documents
(by hash, twice that at most), outside the held-out fold.

Defined results: null and empty texts have no terms and get the bias's score. Without labels of both
kinds every score is the share of toxic labels, or 0. A score of exactly 0.5 is toxic. Rows that share
an id are scored each by itself; equal ones are learned once. A very long text is scored whole, at some
60 bytes of memory a byte. An empty table gives an empty result. Only the text is used; columns named
like the result's have no part in it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashed_text import Terms, batches_of, bounded, distinct_texts
from tidemark.llm.quality import sigmoid
from tidemark.llm.shared import held_out, stored

TERMS = Terms(bits=20)


class FactorizationMachine(NamedTuple):
    place: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """rows, terms: each (row, place of a term) that occurs, once."""
        z = self.bias + np.bincount(rows, self.linear[terms], n)
        for v in self.factors.T:
            z += 0.5 * (np.bincount(rows, v[terms], n) ** 2 - np.bincount(rows, v[terms] ** 2, n))
        return sigmoid(z)


def fit(rows: np.ndarray, terms: np.ndarray, n_terms: int, y: np.ndarray, weight: np.ndarray, base: float, *, width: int = 4, steps: int = 400, rate: float = 0.05, shrink: float = 2e-3, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, linear weights and factors by Adam on the whole set. rows, terms: each (row, term) that occurs; y, weight: of each row."""
    rng = np.random.default_rng(seed)
    params = [np.array([base]), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, width))]
    first, second = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    by_row = lambda values: np.bincount(rows, values, len(y))
    by_term = lambda values: np.bincount(terms, values, n_terms)
    for t in range(1, steps + 1):
        b, w, v = params
        sums = [by_row(v[terms, k]) for k in range(width)]
        z = b + by_row(w[terms]) + sum(0.5 * (s**2 - by_row(v[terms, k] ** 2)) for k, s in enumerate(sums))
        d = (sigmoid(z) - y) * weight
        d_w = by_term(d[rows])
        grads = [np.array([d.sum()]), d_w + shrink * w / 10, np.stack([by_term((d * s)[rows]) for s in sums], axis=1) - d_w[:, None] * v + shrink * v]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def _count_terms(batches):
    """(term, toxic texts, other texts) of each batch."""
    for batch in batches:
        for a, z, texts in batches_of(batch, 0):
            toxic = np.array(batch.column(1).slice(a, z - a).to_pylist()) == "1"
            buckets, docs = TERMS.of(texts)
            pairs = np.unique(buckets.astype(np.uint64) << np.uint64(32) | docs.astype(np.uint64))
            used, where = np.unique(pairs >> np.uint64(32), return_inverse=True)
            bad = np.bincount(where, toxic[(pairs & np.uint64(2**32 - 1)).astype(np.int64)], len(used)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bad), pa.array(np.bincount(where, minlength=len(used)) - bad)], names=["term", "bad", "good"])


def _count_company(anchor: np.ndarray, usual: np.ndarray):
    """(anchor, term, toxic texts, other texts) of each batch, for the terms of the texts that hold an anchor; term -1: those texts' number. anchor: place or -1 of each term; usual: which terms occur often enough."""

    def count(batches):
        for batch in batches:
            for a, z, texts in batches_of(batch, 0):
                toxic = np.array(batch.column(1).slice(a, z - a).to_pylist()) == "1"
                buckets, docs = TERMS.of(texts)
                pairs = np.unique(docs[usual[buckets]].astype(np.int64) << 32 | buckets[usual[buckets]].astype(np.int64))
                doc, term = pairs >> 32, pairs & (2**32 - 1)
                held = np.flatnonzero(anchor[term] >= 0)
                sizes, begins = np.bincount(doc, minlength=z - a), np.searchsorted(doc, np.arange(z - a))
                n = sizes[doc[held]]
                at = np.repeat(begins[doc[held]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                key = np.concatenate([np.repeat(anchor[term[held]], n).astype(np.int64) << 32 | term[at], anchor[term[held]].astype(np.int64) << 32 | (2**32 - 1)])
                used, where = np.unique(key, return_inverse=True)
                bad = np.bincount(where, toxic[np.concatenate([np.repeat(doc[held], n), doc[held]])], len(used)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((used >> 32).astype(np.int32)), pa.array((used & (2**32 - 1)).astype(np.uint32).view(np.int32)), pa.array(bad), pa.array(np.bincount(where, minlength=len(used)) - bad)], names=["anchor", "term", "bad", "good"])

    return count


def _rows_of(place: np.ndarray):
    """(places of the chosen terms, label) of each text."""

    def rows(batches):
        for batch in batches:
            for a, z, texts in batches_of(batch, 0):
                buckets, docs = TERMS.of(texts)
                at = place[buckets]
                pairs = np.unique(docs[at >= 0].astype(np.int64) << 32 | at[at >= 0])
                cuts = np.searchsorted(pairs >> 32, np.arange(z - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array([(pairs[s:e] & (2**32 - 1)).tolist() for s, e in zip(cuts[:-1], cuts[1:])], pa.list_(pa.int32())), batch.column(1).slice(a, z - a)], names=["terms", "label"])

    return rows


def _apart(bad: Column, good: Column, all_bad: Column, all_good: Column) -> Column:
    """By how many standard errors a term's share among toxic and other texts differs."""
    share = (bad + good) / (all_bad + all_good)
    return F.abs(bad / all_bad - good / all_good) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / all_bad + 1 / all_good))


def train(labelled: DataFrame, *, terms: int = 1024, anchors: int = 128, z: float = 4.0, company_z: float = 6.0, width: int = 4) -> FactorizationMachine:
    """labelled: (text, label '0' or '1'), bounded. Terms are counted and chosen where the texts are; the driver gets the chosen ones and each text's."""
    place = np.full(2**TERMS.bits, -1, np.int32)
    counts = dict(labelled.groupBy("label").count().collect())
    bad, good = counts.get("1", 0), counts.get("0", 0)
    base = float(np.log(max(bad, 1e-6) / max(good, 1e-6))) if bad + good else -40.0
    if not bad or not good:
        return FactorizationMachine(place, base, np.zeros(0), np.zeros((0, width)))
    found = stored(labelled.mapInArrow(_count_terms, "term int, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad + good >= 4"))
    alone = found.withColumn("z", _apart(F.col("bad"), F.col("good"), F.lit(bad), F.lit(good))).where(F.col("z") >= z).orderBy(F.desc("z"), "term").limit(terms).collect()
    strong = [r.term for r in alone if r.bad * good > r.good * bad][:anchors]
    best = {r.term: r.z for r in alone}
    if strong:
        anchor, usual = np.full(2**TERMS.bits, -1, np.int32), np.zeros(2**TERMS.bits, bool)
        anchor[strong] = np.arange(len(strong))
        usual[[r.term for r in found.where("bad + good >= 8").select("term").toLocalIterator()]] = True  # 2 ** bits numbers at most
        company = stored(labelled.mapInArrow(_count_company(anchor, usual), "anchor int, term int, bad long, good long").groupBy("anchor", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
        of = company.where("term = -1 AND bad >= 30 AND good >= 30").select("anchor", F.col("bad").alias("all_bad"), F.col("good").alias("all_good"))
        near = company.where("term <> -1 AND bad + good >= 8").join(F.broadcast(of), "anchor").withColumn("z", _apart(F.col("bad"), F.col("good"), F.col("all_bad"), F.col("all_good")) * (z / company_z))
        for r in near.where(F.col("z") >= z).groupBy("term").agg(F.max("z").alias("z")).orderBy(F.desc("z"), "term").limit(terms).collect():
            best[r.term] = max(r.z, best.get(r.term, 0.0))
    chosen = sorted(best, key=lambda t: (-best[t], t))[:terms]
    place[chosen] = np.arange(len(chosen))
    has, bare = {}, [0, 0]
    for r in labelled.mapInArrow(_rows_of(place), "terms array<int>, label string").groupBy("terms", "label").count().toLocalIterator():
        has.setdefault(tuple(r[0]), [0, 0])[int(r[1])] += r[2]
    has.setdefault((), bare)
    keys = sorted(has)
    many = np.array([has[k] for k in keys], np.float64)
    n = many.sum(axis=1)
    rows, terms_ = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.array([t for k in keys for t in k], np.int64)
    return FactorizationMachine(place, *fit(rows, terms_, len(chosen), many[:, 1] / np.maximum(n, 1), n / n.sum(), base, width=width))


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rows: int = 20_000) -> FactorizationMachine:
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").cast("string").alias("label"))
    marked = bounded(marked.where(F.col("label").isin("0", "1") & F.col("id").isNotNull() & ~held_out(F.col("id"))), ["id", "label"], rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull())
    found = stored(distinct_texts(texts.join(F.broadcast(marked), "id")))  # marked: 2 * rows ids at most
    if found.count() > 2 * rows:  # ids of many texts each
        found = found.where(F.col("h") <= found.orderBy("h").select("h").limit(2 * rows).agg(F.max("h")).first()[0])
    return train(found.select("text", "label"))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, for every whole text."""

    def score(batches):
        for batch in batches:
            for a, z, texts in batches_of(batch, 1, 1 << 20):
                n = z - a
                buckets, docs_of = TERMS.of(texts)
                at = model.place[buckets]
                pairs = np.unique(docs_of[at >= 0].astype(np.int64) * (len(model.linear) + 1) + at[at >= 0])
                p = model.score(pairs // (len(model.linear) + 1), pairs % (len(model.linear) + 1), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held_out(F.col(f"`{id_col}`")).alias("held_out"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
