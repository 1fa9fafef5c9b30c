"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram is
bound from its letters' vectors, each permuted (rotated) by its place; a text's vector bundles
(sums) the vectors of its n-grams, and a language's prototype bundles the normalised vectors
of its training texts. A text gets the language whose prototype has the largest cosine with it.

Texts are handled in groups: the distinct n-grams of a group are bound once, and one matrix
product of their counts bundles them for every text of the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.llm.common import held_out

#: Training texts of a language, about: the classifier is fitted on a sample of this bound.
TRAIN_ROWS = 2000
UNKNOWN = "und"
#: What callers can ask for texts with letters where no language was learned.
UNLEARNED = "mis"
GROUP = 64  # texts bundled at once
SLICE = 4096  # distinct n-grams bound at once
LETTERS = 8192  # letter vectors a worker keeps


class Letters:
    """Vectors of code points; 0 stands for the edge of a word."""

    def __init__(self, dim: int, seed: int = 8):
        self.dim, self.seed, self.known = dim, seed, {}
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def vectors(self, points: np.ndarray) -> np.ndarray:
        if len(self.known) > LETTERS:
            self.known.clear()
        for p in points.tolist():
            if p not in self.known:
                self.known[p] = np.random.default_rng([self.seed, p]).integers(0, 2, self.dim, np.int8) * 2 - 1
        return np.stack([self.known[p] for p in points.tolist()])

    def grams(self, text: str) -> np.ndarray:
        """Code-point triples (21 bits each) of the lower-cased words, edges included."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
        letter = self.is_letter[points]
        if not letter.any():
            return np.empty(0, np.int64)
        seq = np.concatenate(([0], np.where(letter, points, 0), [0]))
        seq = seq[np.concatenate(([True], (seq[1:] != 0) | (seq[:-1] != 0)))]  # one edge between words
        grams = (seq[:-2] << 42) | (seq[1:-1] << 21) | seq[2:]
        return grams[seq[1:-1] != 0]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """One row per n-gram: the product of its letters' vectors, rotated by 2, 1 and 0."""
        out = np.ones((len(grams), self.dim), np.int8)
        for place in range(3):
            points, at = np.unique((grams >> (21 * place)) & 0x1FFFFF, return_inverse=True)
            out *= np.roll(self.vectors(points), place, axis=1)[at]
        return out

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """The vector of each text; zero for one without letters."""
        out = np.zeros((len(texts), self.dim), np.float32)
        counted = [np.unique(self.grams(t), return_counts=True) if t else (np.empty(0, np.int64),) * 2 for t in texts]
        union, at = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
        if not len(union):
            return out
        counts = np.zeros((len(texts), len(union)), np.float32)
        counts[np.repeat(np.arange(len(texts)), [len(g) for g, _ in counted]), at] = np.concatenate([n for _, n in counted])
        for s in range(0, len(union), SLICE):
            out += counts[:, s : s + SLICE] @ self.bind(union[s : s + SLICE]).astype(np.float32)
        return out


def normalised(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _sums(dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles of normalised training texts, one row per language and part of the input."""
    letters, total = Letters(dim), {}
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for s in range(0, len(texts), GROUP):
            v = normalised(letters.bundle(texts[s : s + GROUP])).astype(np.float64)
            for lang in set(langs[s : s + GROUP]):
                mine = v[[x == lang for x in langs[s : s + GROUP]]].sum(axis=0)
                total[lang] = total.get(lang, 0) + mine
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "v": pa.array([v.tobytes() for v in total.values()], pa.binary())})


def _add(t: pa.Table) -> pa.Table:
    v = sum(np.frombuffer(x, np.float64) for x in t.column("v").to_pylist())
    return pa.table({"lang": t.column("lang")[:1], "v": pa.array([v.tobytes()], pa.binary())})


def fit_prototypes(docs: DataFrame, rows: int = TRAIN_ROWS, dim: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", parts: int = 5, remainder: int = 0) -> dict[str, np.ndarray]:
    """lang -> unit prototype, from rows outside the held-out part with a language and a text.

    Of each language about ``rows`` texts are used, chosen by a hash of id and text (all, if it
    has fewer), so a common language costs no more than a rare one. One vector per language
    comes to the driver.
    """
    known = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
             .filter(~held_out("doc_id", parts, remainder) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    counts = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    limit = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, rows / n) * (1 << 30)))))
    pick = F.pmod(F.xxhash64(F.lit(8), "doc_id", F.xxhash64("text")), F.lit(1 << 30)) < limit[F.col("lang")]
    sample = known.filter(pick).select("lang", "text")
    sums = (sample.mapInArrow(partial(_sums, dim), "lang string, v binary").groupBy("lang")
            .applyInArrow(_add, "lang string, v binary").collect())
    found = {r.lang: np.frombuffer(r.v, np.float64) for r in sums}
    return {k: (v / n).astype(np.float32) for k, v in sorted(found.items()) if (n := np.linalg.norm(v)) > 0}


def _predict(dim: int, unlearned: str, model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs, protos = model.value
    letters = Letters(dim)
    for b in batches:
        texts, pred, score = b.column("text").to_pylist(), [], []
        for s in range(0, len(texts), GROUP):
            v = normalised(letters.bundle(texts[s : s + GROUP]))
            cos = v @ protos.T if langs else np.zeros((len(v), 1), np.float32)
            best = cos.argmax(axis=1)
            some = v.any(axis=1)
            pred += [(langs[i] if langs else unlearned) if x else UNKNOWN for i, x in zip(best.tolist(), some.tolist(), strict=True)]
            score += np.where(some, cos[np.arange(len(v)), best].clip(0, 1), 0).astype(np.float64).tolist()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = 1024, text_col: str = "text",
             unlearned: str = UNKNOWN) -> DataFrame:
    """``docs`` with lang_pred and score (the largest cosine, 0 to 1), computed from the text alone.

    A null text, or one without letters, has ``und`` and 0; if no language was learned, every
    other text has ``unlearned`` and 0. Ties go to the language that sorts first. Rows and their other columns stay
    as they are; columns already called lang_pred or score are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    rest = [c for c in kept.columns if c != text_col]
    packed = kept.select(F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("__"), *(F.col(f"`{c}`") for c in rest)).alias("row"))
    langs = list(prototypes)
    protos = np.stack(list(prototypes.values())) if langs else np.zeros((1, dim), np.float32)
    model = docs.sparkSession.sparkContext.broadcast((langs, protos))  # dim * 4 bytes per language
    schema = T.StructType([*packed.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = packed.mapInArrow(partial(_predict, dim, unlearned, model), schema)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept.columns), "lang_pred", "score")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row: learned from the rows that are not held out."""
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_prototypes(docs))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
