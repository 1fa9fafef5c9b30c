"""Toxicity scores from subword bags: embeddings averaged into a linear softmax.

A text's bag holds the hashed byte n-grams of its words, word edges included, so an unseen
misspelling shares most of its n-grams with the words it comes from. The bag's embeddings are
averaged and fed to a softmax over two labels; embeddings and softmax are trained jointly
(AdaGrad on mini-batches, numpy) on a bounded sample of labelled texts in one task.

Scoring uses that the output is linear in the average: the difference of the two logits is
the mean over the bag of one number per bucket, which is all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import held_out

#: Labelled texts of each label that the classifier is fitted on, at most.
TRAIN_ROWS = 2000
SIZES = (3, 4, 5)
BUCKET_BITS = 18
DIM = 8
#: Bytes of text whose n-grams are taken at once.
PIECE = 1 << 18
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts as normalised bytes between spaces, about ``PIECE`` bytes at a time; a longer text in overlapping parts."""
    numbers, parts, size = [], [], 0
    for n, t in enumerate(texts):
        p = b" " + t.lower().encode().translate(NORMAL) + b" " if t else b""
        if len(p) > PIECE:
            for s in range(0, len(p), PIECE):
                yield [n], [p[s : s + PIECE + max(SIZES) - 1]]
            continue
        numbers.append(n)
        parts.append(p)
        size += len(p)
        if size > PIECE:
            yield numbers, parts
            numbers, parts, size = [], [], 0
    if size:
        yield numbers, parts


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs of all n-grams, sorted: two arrays."""
    found = [np.empty(0, np.uint64)]
    for numbers, parts in _pieces(texts):
        data = np.frombuffer(b"".join(parts), np.uint8)
        spaces = np.concatenate(([0], np.cumsum(data == 32)))  # before each place
        doc = np.repeat(np.array(numbers, np.uint64), [len(p) for p in parts])
        wide, code, got = data.astype(np.uint64), np.zeros(len(data), np.uint64), []
        for n in range(1, min(max(SIZES), len(data)) + 1):
            m = len(data) - n + 1
            code = (code[:m] << np.uint64(8)) | wide[n - 1 :]  # bytes i .. i + n - 1
            if n in SIZES:
                good = spaces[n - 1 : n - 1 + m] == spaces[1 : 1 + m]  # no space inside
                key = (code[good] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                got.append((doc[:m][good] << np.uint64(BUCKET_BITS)) | (key >> np.uint64(64 - BUCKET_BITS)))
        if got:
            found.append(np.unique(np.concatenate(got)))
    pairs = np.concatenate(found)
    if len(found) > 2:
        pairs = np.unique(pairs)
    return (pairs >> np.uint64(BUCKET_BITS)).astype(np.int64), (pairs & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, rate: float = 1.0, batch: int = 32, seed: int = 6) -> tuple[np.ndarray, float]:
    """(one number per bucket, bias): the logit of label 1 is the bias plus the bag's mean number."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    ge, gw, gb = np.full(1 << BUCKET_BITS, 1e-8, np.float32), np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    doc, bag = buckets(texts)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    sizes = np.maximum(np.diff(at), 1)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            ids = np.concatenate([bag[at[r] : at[r + 1]] for r in rows])
            n = at[rows + 1] - at[rows]
            which = np.repeat(np.arange(len(rows)), n)
            used, inv = np.unique(ids, return_inverse=True)
            share = np.zeros((len(rows), len(used)), np.float32)
            share[which, inv] = 1.0 / sizes[rows][which]
            h = share @ e[used]
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            de, dw, db = share.T @ (p @ w.T), h.T @ p, p.sum(axis=0)
            ge[used] += (de**2).mean(axis=1)
            e[used] -= rate * de / np.sqrt(ge[used])[:, None]
            gw += dw**2
            w -= rate * dw / np.sqrt(gw)
            gb += db**2
            b -= rate * db / np.sqrt(gb)
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])


def scores(texts: list[str | None], number: np.ndarray, bias: float) -> np.ndarray:
    doc, bag = buckets(texts)
    n = np.bincount(doc, minlength=len(texts))
    total = np.bincount(doc, weights=number[bag], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -50, 50)))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for b in batches:
        texts += b.column("text").to_pylist()
        labels += b.column("label").to_pylist()
    number, bias = train(texts, np.array(labels, np.int64)) if texts else (np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    yield pa.RecordBatch.from_pydict({"number": pa.array([number.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", parts: int = 5, remainder: int = 0) -> tuple[np.ndarray, float]:
    """The classifier of a sample of the labelled texts outside the held-out part.

    Of each label (0, 1) up to ``rows`` documents are used, those with the smallest hashes of
    their ids, so the labels weigh the same and a score of 0.5 is equal evidence for both.
    Null ids, texts and labels are not learned from; of several labels of one document the
    largest counts, of rows that share an id one is used. Without any the score is 0.5.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id", parts, remainder))
             .groupBy("id").agg(F.max("label").alias("label")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    there = known.join(texts.select(F.col("doc_id").alias("id")), "id", "left_semi")
    picked = [there.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * rows pairs of numbers at most
    sample = (texts.join(chosen, F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
              .repartition(1).sortWithinPartitions("doc_id"))
    model = sample.select("text", "label").mapInArrow(_train, "number binary, bias double").first()
    if model is None:  # an empty sample may have no task at all
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return np.frombuffer(model.number, np.float32), model.bias


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, bias = model.value
    for b in batches:
        texts = b.column("text").to_pylist()
        s = np.concatenate([scores(texts[i : i + 64], number, bias) for i in range(0, len(texts), 64)] or [np.empty(0)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5) for each row of ``docs``.

    A null or empty text, or one without words, has an empty bag and the score of the bias.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket: 1 MB
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(partial(_score, shared), "doc_id long, score double")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row: learned from the rows that are not held out."""
    return score_documents(docs, fit(docs, labels)).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
