"""Supervised subword embeddings: a document is the mean of learned vectors of its hashed words, word
repeats and character n-grams; a softmax layer scores it. Trained by numpy stochastic gradient descent in one
task on a bounded sample of labelled rows, of which it gets buckets and counts, at most BUCKETS of
each; scoring reads every whole text where it lies, in parts that change nothing.

A word that equals the one before it is, besides, hashed as a repeat: a pair of words (w, w) is the
same n-gram whatever the word, and its vector is learned like any other.

Since scores need only the difference of the two outputs, each bucket's vector folds into one number
before scoring. Null and empty texts, and texts of white space, have no features and score 0.5; a null doc_id is
never held out and never learned from; labels that repeat count once, the smallest quality wins; of
rows that repeat a labelled doc_id the smallest text by its hash is learned from;
without labels of both kinds every score is the share of label 1 (0.5 if there is none); other
columns are ignored, columns named like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.rolling import Spans, pack, scramble, unpack

BUCKETS = 1 << 18
GRAMS = (3, 4)
#: The n-gram of a word and the same word again.
AGAIN = np.uint64(0x9D39247E33776D41)
#: Code points that are hashed at once; longer texts are cut between words.
PART = 1 << 19
FOLDS = 5


def features(text: str, last: np.uint64 | None = None) -> tuple[np.ndarray, np.uint64 | None]:
    """Bucket of every word, word repeat and within-word n-gram (with the word's edges) of a text, and the last word's hash.

    ``last`` is that of the part before, so that a repeat across a cut is seen.
    """
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    gap = (points == 32) | ((points >= 9) & (points <= 13))
    coded = np.where(gap, np.uint32(32), points)
    spans = Spans(scramble(coded.astype(np.uint64) + np.uint64(1)))
    starts = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    words = spans.at(starts, ends)
    row = words if last is None else np.append(last, words)
    found = [words, np.full(np.count_nonzero(row[1:] == row[:-1]), AGAIN)]
    gaps = np.concatenate([[0], np.cumsum(gap)])
    for n in GRAMS:
        at = np.flatnonzero(gaps[n - 1 : len(gap)] - gaps[1 : len(gap) - n + 2] == 0) if len(gap) >= n else np.empty(0, np.int64)
        found.append(spans.every(n)[at] + np.uint64(n))
    return (np.concatenate(found) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), row[-1] if len(row) else None


def parts(text: str):
    """Whole texts in pieces that end between words."""
    at = 0
    while len(text) - at > PART:
        to = max(text.rfind(c, at + 1, at + PART) for c in " \n\t\r\v\f")
        if to <= at:
            to = min((x for c in " \n\t\r\v\f" if (x := text.find(c, at + PART)) > 0), default=len(text))
        yield text[at:to]
        at = to
    yield text[at:]


def document_features(text: str | None):
    """The features of a whole text, part by part."""
    last = None
    for p in parts(text or ""):
        f, last = features(p, last)
        yield f


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, and how often each occurs."""
    total: dict[int, int] = {}
    for f in document_features(text):
        names, n = np.unique(f, return_counts=True)
        if not total:
            total = dict(zip(names.tolist(), n.tolist()))
        else:
            for k, v in zip(names.tolist(), n.tolist()):
                total[k] = total.get(k, 0) + v
    names = np.array(sorted(total), np.int64)
    return names, np.array([total[k] for k in names.tolist()], np.int64)


def forward(out: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Softmax of the two outputs."""
    z = out @ mean
    p = np.exp(z - z.max())
    return p / p.sum()


def gradients(out: np.ndarray, mean: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log of the label's probability, by the output layer and by the document's mean vector."""
    p = forward(out, mean)
    p[label] -= 1
    return np.outer(p, mean), out.T @ p


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int = 16, steps: int = 12_000, rate: float = 0.5, seed: int = 5) -> tuple[np.ndarray, float]:
    """(a number per bucket, bias): the logit of label 1 is the mean of the buckets' numbers plus the bias."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        share = min(max(share, 0.02), 0.98) if len(labels) else 0.5
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    # Features that training never met add nothing; both labels weigh half, so no features mean 0.5.
    table = np.zeros((BUCKETS, dims), np.float32)
    out = rng.normal(0, dims**-0.5, (2, dims)).astype(np.float32)
    means = [(names, (n / max(1, n.sum())).astype(np.float32)) for names, n in bags]
    # Both labels weigh half, and small samples are gone through more often.
    weight = np.array([0.5 / (1 - share), 0.5 / share], np.float32)
    epochs, at = -(-steps // len(bags)), 0
    steps = epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            names, w = means[i]
            by_out, by_mean = gradients(out, w @ table[names], labels[i])
            step = np.float32(rate * (1 - at / steps)) * weight[labels[i]]
            out -= step * by_out
            # The mean's own weights scaled to unit length, so that long texts move their vectors as far as short ones.
            table[names] -= np.outer(step * w / max(1e-9, float(np.sqrt(w @ w))), by_mean)
            at += 1
    return (table @ (out[1] - out[0])).astype(np.float64), 0.0


def _hashed_bags(batches):
    for batch in batches:
        found = pa.array([pack(*bag(t.as_py())) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "quality", "h")), found], names=["doc_id", "quality", "h", "bag"])


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by("doc_id")
    bags = [tuple(unpack(b, "<i8", "<i8")) for b in table.column("bag").to_pylist()]
    weights, bias = train(bags, table.column("quality").to_numpy().astype(np.int64))
    return pa.table({"weights": pa.array([weights.astype("<f4").tobytes()], pa.binary()), "bias": [bias]})


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = 2500) -> tuple[np.ndarray, float]:
    """The model of at most ``per_label`` rows of each label outside fold 0, chosen by a hash of the id."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    )
    pick = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    chosen = pick(0).unionByName(pick(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("h"))
    bags = rows.select("doc_id", "quality", "text", "h").mapInArrow(_hashed_bags, "doc_id long, quality int, h long, bag binary")
    sample = bags.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "bag")).alias("b")).select("doc_id", "quality", "b.bag")
    got = sample.groupBy(F.lit(0).alias("one")).applyInArrow(_fit, "weights binary, bias double").first()
    return (np.frombuffer(got["weights"], "<f4").astype(np.float64), got["bias"]) if got else (np.zeros(BUCKETS), 0.0)


def score_text(text: str | None, weights: np.ndarray, bias: float) -> float:
    total = count = 0.0
    for f in document_features(text):
        total += float(weights[f].sum())
        count += len(f)
    z = total / max(1, count) + bias
    return float(1 / (1 + np.exp(-min(max(z, -500), 500))))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """``docs`` plus score and predicted; input columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches):
        weights, bias = sent.value
        for batch in batches:
            scores = np.array([score_text(t.as_py(), weights, bias) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    base = docs.drop("score", "predicted")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{kinds}, score double, predicted int")
