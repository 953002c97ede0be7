"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, neighbouring pairs and pairs with one word
between, hashed to ``BUCKETS``. Each coordinate has its own learning rate and an L1
penalty, so nearly all weights end at zero; what remains is the broadcast model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.samples import fold, sampled
from symbolarium.llm.textarrays import chunks, letters_only, mix64, words

BUCKETS = 1 << 20
#: Labelled rows that the fit reads at most.
MAX_LABELLED = 8000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text index, bucket)`` of every feature occurrence; punctuation separates words."""
    w = words(texts, lower=True, separators=letters_only())
    h = w.hashes
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    who, what = [owner], [h]
    for gap, salt in ((1, 3), (2, 7)):
        pair = mix64(h[:-gap] * np.uint64(salt) + mix64(h[gap:] + np.uint64(salt)))
        same = owner[:-gap] == owner[gap:]
        who.append(owner[:-gap][same])
        what.append(pair[same])
    return np.concatenate(who), (np.concatenate(what) >> np.uint64(11)).astype(np.int64) % BUCKETS


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 8, alpha: float = 0.6, beta: float = 1.0, l1: float | None = None, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """``(buckets, weights, intercept)`` of the nonzero weights; each row holds distinct buckets.

    The L1 penalty grows with the sample, as the noise that gradients gather does.
    """
    l1 = float(np.clip(len(rows) / 800, 1, 10)) if l1 is None else l1
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = rows[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - labels[k]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
            bias_n += g * g
            bias -= alpha / np.sqrt(bias_n) * g
    at = np.flatnonzero(np.abs(z) > l1)
    return at, weights(at), bias


def train_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``max_labelled`` rows whose doc_id has a label; a doc_id with several
    labels counts as toxic if any says so, null labels and null ids count for nothing, repeated
    rows count once. No row: weights of none and an even intercept."""
    named = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    named = F.broadcast(named.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_labelled))  # at most max_labelled ids
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(named, "doc_id")
    table = sampled(labelled, max_labelled).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    rows: list[np.ndarray] = []
    for chunk in chunks(table.to_batches()):
        who, what = features(chunk.column("text"))
        pairs = np.unique(who * BUCKETS + what)
        rows += np.split(pairs % BUCKETS, np.searchsorted(pairs // BUCKETS, np.arange(1, chunk.num_rows)))
    return fit_ftrl(rows, table.column("label").to_numpy().astype(float))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, score)`` over whole texts; null or empty
    texts get the intercept's score. Repeated rows give a row each, a null doc_id stays null; other
    columns are ignored; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, bias = shared.value
        dense = np.zeros(BUCKETS)
        dense[at] = weight
        for chunk in chunks(batches):
            who, what = features(chunk.column("text"))
            live = dense[what] != 0
            pairs = np.unique(who[live] * BUCKETS + what[live])
            total = np.bincount(pairs // BUCKETS, weights=dense[pairs % BUCKETS], minlength=chunk.num_rows) + bias
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Scores of all documents from labels of those outside the held-out fold:
    ``(doc_id, held_out, score, predicted)``. Without any label all scores are one half. A null
    doc_id is in no fold (``held_out`` false) and never learned from; for nulls, empty texts,
    repeated rows, ties (a score of one half is predicted toxic) and empty tables see
    ``score_toxicity``; other columns are ignored."""
    model = train_toxicity(docs, labels.where(fold(F.col("doc_id"), 5) != 0), max_labelled)
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
