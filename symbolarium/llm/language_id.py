"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams (letters only, A-Z
lower-cased, runs of other bytes as word bounds). Embeddings and softmax are trained
together by stochastic gradient descent. As the model is linear in the averages, scoring
needs only the product of both: one short row of class logits for each hash bucket.

Rejection is calibrated on sampled documents that the fit does not see: a temperature is
chosen by their likelihood, and the least accepted probability so that at most
``REJECT_SHARE`` of them fall below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from symbolarium.llm.samples import fold, sampled
from symbolarium.llm.textarrays import chunks, letters_only, lowered, text_bytes
from symbolarium.llm.workspace import in_batches, spare_name

BUCKETS, DIM, ORDERS = 1 << 16, 16, (1, 2, 3, 4)
#: Labelled rows that the fit reads at most.
MAX_LABELLED = 2500
REJECT_SHARE, LEAST_ACCEPTED = 0.002, 0.55
UNDETERMINED = "und"


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text, text by text, and each text's bounds among them."""
    raw, bounds = text_bytes(texts)
    kept = np.where(letters_only()[raw], np.uint8(32), lowered()[raw])
    gap = np.zeros(len(kept), bool)
    gap[1:] = (kept[1:] == 32) & (kept[:-1] == 32)
    gap[bounds[:-1][np.diff(bounds) > 0]] = False
    kept = kept[~gap].astype(np.uint32)
    bounds = np.r_[0, np.cumsum(~gap)][bounds]
    n = len(kept)
    out = np.empty((n, len(ORDERS)), np.int32)
    for k, order in enumerate(ORDERS):
        h = np.full(n, order * 0x9E3779B1 % (1 << 32), np.uint32)
        for j in range(order):
            h[: n - j] = (h[: n - j] ^ kept[j:]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        out[:, k] = h % np.uint32(BUCKETS)
        # An n-gram that would run past its text's end becomes the bucket of none, 0.
        for j in range(1, order):
            tail = bounds[1:] - j
            out[tail[tail >= bounds[:-1]], k] = 0
    return out.reshape(-1), bounds * len(ORDERS)


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # a row for each bucket
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        ids, bounds = subwords(texts)
        size = np.diff(bounds)
        total = np.zeros((len(size), len(self.labels)))
        full = size > 0
        if full.any():
            for c in range(len(self.labels)):
                total[full, c] = np.add.reduceat(self.logits[:, c][ids], bounds[:-1][full]) / size[full]
        x = (total + self.bias) / self.temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)


def fit_language_model(texts: pa.Array, langs: list[str], epochs: int = 6, rate: float = 1.5, seed: int = 3) -> LanguageModel:
    """Train on four fifths of the texts, calibrate on the rest (on all, of fewer than 50)."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(langs))
    held = order[: len(order) // 5] if len(order) >= 50 else order
    train = order[len(order) // 5 :] if len(order) >= 50 else order
    target = np.searchsorted(labels, langs)
    bags = []
    for at in range(0, len(langs), 256):
        ids, bounds = subwords(texts.slice(at, 256))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            u, c = np.unique(ids[a:b], return_counts=True)
            bags.append((u, (c / max(1, b - a)).astype(np.float32)))
    emb = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    out = np.zeros((DIM, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            u, c = bags[k]
            lr = rate * (1 - step / steps)
            step += 1
            mean = c @ emb[u]
            p = mean @ out + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[target[k]] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            # A bucket's share of a text is small, so its step is scaled up as if alone.
            emb[u] -= lr * np.outer(np.sqrt(c), back)
    model = LanguageModel(labels, emb @ out, bias)
    if len(labels) > 1 and len(held):
        scaled = {}
        for t in (0.25, 0.5, 1.0, 2.0, 4.0):
            model.temperature = t
            p = np.concatenate([model.probabilities(texts.take(pa.array(held[a : a + 256]))) for a in range(0, len(held), 256)])
            scaled[t] = (-np.log(np.clip(p[np.arange(len(held)), target[held]], 1e-9, 1)).mean(), p.max(1))
        model.temperature = min(scaled, key=lambda t: scaled[t][0])
        model.least = float(min(LEAST_ACCEPTED, np.quantile(scaled[model.temperature][1], REJECT_SHARE, method="lower")))
    return model


def train_language_model(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> LanguageModel:
    """Fit on at most ``max_labelled`` rows of ``docs(doc_id, text, lang)`` that have both
    a lang and a text with a letter, repeated rows once. Pass only rows that the model may learn
    from. No such row: a model without classes. Other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").alias("label")).where("label IS NOT NULL AND text rlike '\\\\p{L}'")
    table = sampled(rows, max_labelled).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    if not table.num_rows:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    return fit_language_model(table.column("text").combine_chunks(), table.column("label").to_pylist())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` plus, last, the predicted language, its probability, and
    whether it is rejected (``_lang_pred``, ``_lang_score``, ``_lang_rejected``, with more
    underscores where ``docs`` has such names).

    A null text, one without a letter, and every text of a model without classes is
    ``und`` with score 0, and rejected. So is, with its best class kept, a text whose
    probability is under the calibrated bound. Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters, *added = (spare_name(docs, n) for n in ("_letters", "_lang_pred", "_lang_score", "_lang_rejected"))
    judged = docs.withColumn(letters, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.labels, UNDETERMINED], object)
        for chunk in chunks(batches):
            ok = chunk.column(letters).to_numpy(zero_copy_only=False)
            best, score = np.full(len(ok), len(model.labels)), np.zeros(len(ok))
            if model.labels:
                p = model.probabilities(chunk.column("text"))
                best[ok], score[ok] = p.argmax(1)[ok], p.max(1)[ok]
            out = chunk.drop_columns([letters])
            arrays = [*out.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(~ok | (score < model.least) | (best == len(model.labels)))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*out.schema.names, *added])

    kinds = zip(added, (StringType(), DoubleType(), BooleanType()), strict=True)
    return in_batches(judged).mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, t) for n, t in kinds)]))


def language_id(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of every document, learned from
    the rows outside the held-out fold that have a lang.

    A null doc_id is in no fold (``held_out`` false). Null, empty or letterless texts are ``und``
    with score 0; repeated rows give a row each, ties between languages go to the first by name;
    other columns are ignored; an empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train_language_model(docs.where(~held), max_labelled)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"), F.col("_lang_rejected").alias("rejected")
    )
