"""Language-model scores by a weighted backoff automaton learned from the corpus.

The model is a bigram model with Dirichlet smoothing towards add-one unigrams:

    p(w | h) = (c(h w) + mu * p(w)) / (c(h) + mu),    p(w) = (c(w) + 1) / (N + V + 1)

which is a backoff automaton exactly: a state per history h with an arc for each bigram seen
after it, and a failure arc of weight mu / (c(h) + mu) to the root, whose arcs are the
unigrams. A text is one path from the start state over its words to the end token.

The automaton grows with the corpus (a state per word, an arc per distinct bigram), so it is
never collected: each block of documents sends its distinct words and bigrams with their
counts in the block's training documents to key buckets, and gets back the totals of just
those (``common.ask_and_answer``). With them it builds the part of the automaton that its own
texts can reach, and walks it. A word or bigram that is frequent everywhere is one key per block.

Words are told apart by 96 bits of their digests, bigrams by 64.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import (
    BLOCK_BYTES,
    COUNTS,
    KEYS,
    answers_of,
    ask_and_answer,
    block_count,
    blocks,
    buckets_of,
    documents_of,
    held_out,
)

END, START = b"", b" "  # neither can be a word
ASKED = {"w64": KEYS, "w32": "<u4", "wn": COUNTS, "b64": KEYS, "bn": COUNTS}


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key of two word digests (multiply, xor, shift; order matters)."""
    k = (h * np.uint64(0x9E3779B97F4A7C15)) ^ ((w << np.uint64(29)) | (w >> np.uint64(35)))
    k = (k ^ (k >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    k = (k ^ (k >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return k ^ (k >> np.uint64(31))


class Tokens:
    """The words of one block's texts as numbers, with its distinct words and bigrams in a fixed order."""

    def __init__(self, t: pa.Table):
        number: dict[bytes, int] = defaultdict(count().__next__)
        number[END], number[START]
        parts, sizes = [], []
        for x in t.column("text").cast(pa.large_binary()).to_pylist():
            words = x.lower().split() if x else []  # on bytes both know ASCII only
            words.append(END)
            parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
        d = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), np.dtype([("w64", "<u8"), ("w32", "<u4"), ("rest", "<u4")]))
        order = np.lexsort((d["w32"], d["w64"]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.digests, self.end, self.start = d[order], int(place[0]), int(place[1])
        self.sizes = np.array(sizes, np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.tokens = place[np.concatenate(parts)]
        self.history = np.empty_like(self.tokens)
        self.history[1:] = self.tokens[:-1]
        self.history[self.begins] = self.start
        w64 = self.digests["w64"]
        self.pairs, self.pair = np.unique(pair_key(w64[self.history], w64[self.tokens]), return_inverse=True)

    def asked(self, learn: np.ndarray, n: int) -> list[dict[str, np.ndarray]]:
        """Per bucket: distinct words and bigrams with their counts in the texts to ``learn`` from."""
        use = np.repeat(learn, self.sizes)
        wn = np.bincount(self.tokens[use], minlength=len(self.digests))
        bn = np.bincount(self.pair[use], minlength=len(self.pairs))
        w64, w32 = self.digests["w64"], self.digests["w32"]
        words, pairs = buckets_of(w64, n), buckets_of(self.pairs, n)
        return [{"w64": w64[a:b], "w32": w32[a:b], "wn": wn[a:b], "b64": self.pairs[c:d], "bn": bn[c:d]}
                for a, b, c, d in zip(*words, *pairs, strict=True)]


class BackoffAutomaton:
    """States (histories) with arcs for seen bigrams and failure arcs to the root; log10 weights.

    word_count, pair_count   totals of the numbered words and bigrams
    pair_history, pair_word  the state a bigram's arc leaves and the word it reads
    """

    def __init__(self, word_count, pair_count, pair_history, pair_word, history_count, total: int, distinct: int, mu: float):
        self.root = np.log10((word_count + 1) / (total + distinct + 1))
        self.failure = np.log10(mu / (history_count + mu))
        self.seen = pair_count > 0
        self.arc = np.log10((pair_count + mu * 10.0 ** self.root[pair_word]) / (history_count[pair_history] + mu))

    def walk(self, state: np.ndarray, word: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """The weight of each step: from ``state`` read ``word``, over its arc or the failure arc and the root."""
        return np.where(self.seen[arc], self.arc[arc], self.failure[state] + self.root[word])


def _ask(n: int, t: pa.Table) -> list[dict[str, np.ndarray]]:
    return Tokens(t).asked(~t.column("held_out").to_numpy().astype(bool), n)


def _totals(asked: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
    """Per block: the bucket's number of training tokens and distinct training words, then the totals asked for."""
    out: list[list[np.ndarray]] = [[] for _ in asked]
    for names in (("w64", "w32", "wn"), ("b64", "bn")):
        *key, n = (np.concatenate([a[x] for a in asked]) for x in names)
        order = np.lexsort(key[::-1]) if len(key) > 1 else np.argsort(key[0], kind="stable")
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in key:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        groups = np.add.reduceat(n[order], np.flatnonzero(new)) if len(order) else np.empty(0, np.int64)
        total = np.empty(len(order), np.int64)
        total[order] = groups[np.cumsum(new) - 1]
        if names[0] == "w64":
            head = np.array([groups.sum(), (groups > 0).sum()], np.int64)
        for mine, part in zip(out, np.split(total, np.cumsum([len(a[names[0]]) for a in asked])[:-1]), strict=True):
            mine.append(part)
    return [np.concatenate([head, *mine]) for mine in out]


def _score(n: int, mu: float, t: pa.Table, answers: pa.Table) -> pa.Table:
    k = Tokens(t)
    got = answers_of(answers, COUNTS)
    total, distinct = (int(sum(int(a[i]) for a in got)) for i in (0, 1))
    cut = np.subtract(*buckets_of(k.digests["w64"], n)[::-1])  # words asked per bucket
    words = np.concatenate([a[2 : 2 + c] for a, c in zip(got, cut, strict=True)])
    pairs = np.concatenate([a[2 + c :] for a, c in zip(got, cut, strict=True)])
    history = words.copy()  # each training word is followed by one token; a text starts where one ends
    history[k.start] = words[k.end]
    history[k.end] = 0
    last = np.empty(len(k.pairs), np.int64)
    last[k.pair] = np.arange(len(k.pair))
    model = BackoffAutomaton(words, pairs, k.history[last], k.tokens[last], history, total, distinct, mu)
    steps = model.walk(k.history, k.tokens, k.pair)
    known = (words[k.tokens] > 0).astype(np.int64)
    rows = len(k.sizes)
    return pa.table({
        "doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": pa.array(k.sizes, pa.int64()),
        "n_known": pa.array(np.add.reduceat(known, k.begins), pa.int64()),
        "train_tokens": pa.array(np.full(rows, total), pa.int64()),
        "base_score": pa.array(np.add.reduceat(model.root[k.tokens], k.begins), pa.float64()),
        "score": pa.array(np.add.reduceat(steps, k.begins), pa.float64())})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, remainder: int = 2,
                    mu: float = 128.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows whose crc32 of the id (as text) leaves another remainder than
    ``remainder`` modulo ``parts``. A null or empty text is the end token alone; a null id
    counts as the empty text for the remainder; repeated rows count and are scored each;
    without training rows every token has base probability 1; other columns are not read.
    """
    texts = documents_of(docs, id_col, text_col).withColumn("held_out", held_out("doc_id", parts, remainder))
    n = block_count(texts, block_bytes)
    dealt = blocks(texts, n)
    answers = ask_and_answer(dealt, n, partial(_ask, n), _totals, ASKED, COUNTS)
    return (dealt.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(partial(_score, n, mu), "doc_id long, held_out boolean, n_tokens long, n_known long, "
                          "train_tokens long, base_score double, score double"))
