"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file and composed with each input:

* the normaliser writes the start mark and turns spaces into ``\\u2581``;
* the piece transducer is a trie that reads a piece's characters and writes its id; a character
  that no piece covers is read by a byte-fallback arc that writes one id per UTF-8 byte;
* for a merge (BPE) model, an acceptor whose states are pieces gives a pair of neighbours
  weight 0 if merging their joined text ends in just these two, and infinity otherwise. A
  segmentation is what the merges produce if and only if all its neighbours pass, so exactly
  one path has finite weight. For a unigram model arcs weigh the negative score instead.

Encoding takes the shortest path in the tropical semiring (costs add along a path, the minimum
is taken where paths meet), composing only the arcs the input reaches; where weights are 0 and
infinity it is the one finite path, found depth first. The input is cut where no piece can reach across: the lattice has a single state
there, so the parts' shortest paths join to that of the whole. Words that occur again are
looked up.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import release_freed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of one generation of remembered paths, and pairs of pieces: about 70 MB a worker.
WORDS, PAIRS = 1 << 18, 1 << 18
#: Characters of the texts that are encoded at a time, about; the batches they come in may be far larger.
SLICE_CHARS = 1 << 20
NO_PAIRS: dict[str, bool] = {}
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # fixed values: piece types of the file format
UNIGRAM, BPE = 1, 2  # fixed values: model types of the file format

codecs.register_error("piece", lambda e: ("�" * (e.end - e.start), e.end))


class _Paths(dict):
    """word -> number of its path in this generation's arrays, found when it is first asked for.

    A full generation is followed by one that begins with the words that were asked for again, by a
    later text; the others, most of which occur once, are forgotten.
    """

    def __init__(self, fst: PieceTransducer, former: _Paths | None = None):
        super().__init__()
        self.fst = fst
        self.flat, self.at, self.size, self.again = array("i"), array("i"), array("i"), bytearray()
        kept = [w for w, n in former.items() if former.again[n]] if former is not None else []
        for word in kept if len(kept) <= WORDS // 2 else ():
            self._put(word, former.ids(word))

    def ids(self, word: str) -> array:
        n = self[word]
        return self.flat[self.at[n] : self.at[n] + self.size[n]]

    def _put(self, word: str, ids: array | list[int]) -> int:
        self.at.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        self.again.append(0)
        self[word] = n = len(self.at) - 1
        return n

    def __missing__(self, word: str) -> int:
        return self._put(word, self.fst._found(word))

    def paths(self, words: list[str]) -> np.ndarray:
        known = len(self.at)
        which = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        np.frombuffer(self.again, np.uint8)[which[which < known]] = 1
        return ragged(*(np.frombuffer(a, np.int32) for a in (self.flat, self.at, self.size)), which)


class PieceTransducer:
    """Compiled from (piece, score, type) triples; ids are places in the list."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, start_mark: bool = True, squeeze: bool = False, unknown_text: str = " ⁇ "):
        self.kind, self.start_mark, self.squeeze = kind, start_mark, squeeze
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.cost = {p: 0.0 if kind == BPE else -s for p, s, t in pieces if t in (NORMAL, USER)}
        self.rank = {p: s for p, s, t in pieces if t in (NORMAL, USER)}
        bytes_ = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.unknown_cost = max(self.cost.values(), default=0.0) + 10.0
        self.trie: list = [{}, None]  # arcs by character, and the piece that ends here
        for p in self.ids:
            node = self.trie
            for ch in p:
                node = node[0].setdefault(ch, [{}, None])
            node[1] = p
        longer = [p for p in self.ids if len(p) > 1]
        alone = "".join(re.escape(chr(c)) for c in range(32) if not any(chr(c) in p for p in longer))  # control characters
        inner = any(SPACE in p.lstrip(SPACE) for p in longer)
        self.cut = None if inner or not alone else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]")
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.longest = max(map(len, self.ids), default=1)
        self.joints = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.paths = _Paths(self)
        raw = [bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() if t in (NORMAL, USER) else unknown_text.encode() if t == UNKNOWN else b""
               for p, _, t in pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.is_byte = np.array([t == BYTE for _, _, t in pieces])

    def _found(self, word: str) -> list[int]:
        """The ids of a word, cut further where two neighbouring characters are in no piece together."""
        parts, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joints:
                parts.append(word[at:i])
                at = i
        if not parts:
            return self._ids(self.shortest_path(word))
        return [i for p in (*parts, word[at:]) for i in self.paths.ids(p)]

    # ---- composition and shortest path ------------------------------------------------------
    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return (SPACE if self.start_mark and text else "") + text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """What merging the best-ranked neighbours, leftmost first, makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def passes(self, left: str, right: str) -> bool:
        """Whether the acceptor has a finite arc from ``left`` (empty: the start) reading ``right``."""
        if self.n_pairs > PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        ok = self.merged(left + right) == ([left, right] if left else [right])
        self.pairs.setdefault(left, {})[right] = ok
        return ok

    def arcs(self, text: str, i: int) -> list[str]:
        """What the composed transducer can read at ``i``, shortest first: pieces, or by byte fallback the character."""
        out, node = [], self.trie
        for ch in text[i : i + self.longest]:
            node = node[0].get(ch)
            if node is None:
                break
            if node[1] is not None:
                out.append(node[1])
        if not out or len(out[0]) > 1:
            out.insert(0, text[i])
        return out

    def shortest_path(self, text: str) -> list[str]:
        """The pieces (or single uncovered characters) on the shortest path over normalised ``text``."""
        if not text:
            return []
        return self._finite_path(text) if self.kind == BPE else self._cheapest_path(text)

    def _finite_path(self, text: str) -> list[str]:
        """With weights 0 and infinity: the one finite path, depth first, longest pieces first.

        The start of a finite path is the encoding of what it has read, so no two states at one
        position are reached over finite arcs, and the search takes at most one state a position.
        """
        n, pairs = len(text), self.pairs
        path, i, left, dead = [], 0, "", set()
        options = [self.arcs(text, 0)]
        while i < n:
            if options[-1]:
                p = options[-1].pop()
                j = i + len(p)
                if j in dead:
                    continue
                ok = pairs.get(left, NO_PAIRS).get(p)
                if ok or (ok is None and self.passes(left, p)):
                    path.append(p)
                    i, left = j, p
                    if i < n:
                        options.append(self.arcs(text, i))
            else:
                options.pop()
                dead.add(i)
                i -= len(path.pop())
                left = path[-1] if path else ""
        return path

    def _cheapest_path(self, text: str) -> list[str]:
        n = len(text)
        cost, last = [0.0] + [np.inf] * n, [""] * (n + 1)
        for i in range(n):
            for p in self.arcs(text, i):
                to = cost[i] + self.cost.get(p, self.unknown_cost)
                if to < cost[i + len(p)]:
                    cost[i + len(p)], last[i + len(p)] = to, p
        path, j = [], n
        while j:
            path.append(last[j])
            j -= len(last[j])
        return path[::-1]

    def _ids(self, path: list[str]) -> list[int]:
        out: list[int] = []
        for p in path:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    # ---- whole texts --------------------------------------------------------------------------
    def encode(self, text: str) -> np.ndarray:
        whole = self.normalise(text)
        if not whole:
            return np.empty(0, np.int32)
        if self.cut is None:
            return np.array(self._ids(self.shortest_path(whole)), np.int32)
        if len(self.paths) > WORDS:
            self.paths = _Paths(self, self.paths)
        out = self.paths.paths(self.cut.findall(whole))
        if not self.byte_ids and len(out):  # neighbouring unknown characters count once
            out = out[np.concatenate(([True], (out[1:] != self.unknown) | (out[:-1] != self.unknown)))]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The inverse transducer: ids to text; bytes that are no UTF-8 become U+FFFD each."""
        raw = ragged(self.raw, self.raw_at, self.raw_len, ids).tobytes()
        if self.start_mark and raw[:1] == b" " and not self.is_byte[ids[np.argmax(self.raw_len[ids] > 0)]]:
            raw = raw[1:]
        return raw.decode("utf-8", "piece")


def ragged(flat: np.ndarray, at: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[at[k]:at[k] + size[k]] for each k of ``which``, in one array."""
    at, size = at[which], size[which]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)]


def compile_model(data: bytes) -> PieceTransducer:
    """From the bytes of a model file. Only models that normalise nothing but spaces are supported."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(data)
    if m.normalizer_spec.precompiled_charsmap:
        raise ValueError(f"normaliser rule {m.normalizer_spec.name!r} is not supported, only identity")
    if any(p.type == USER for p in m.pieces) or m.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("user-defined pieces, word and character models are not supported")
    return PieceTransducer([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type, m.normalizer_spec.add_dummy_prefix,
                           m.normalizer_spec.remove_extra_whitespaces, m.trainer_spec.unk_surface)


_COMPILED: dict[str, PieceTransducer] = {}


def _transducer(shared) -> PieceTransducer:
    """Compiled once per Python worker."""
    key = hashlib.sha256(shared.value).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = compile_model(shared.value)
    return _COMPILED[key]


def _encode(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_freed()  # of the stages that this worker ran before
    fst = _transducer(shared)
    for b in slices(batches, "text", SLICE_CHARS):
        ids, fallback, restored = [], [], []
        for text in b.column("text").to_pylist():
            if text is None:
                ids.append(None)
                fallback.append(None)
                restored.append(None)
                continue
            e = fst.encode(text)
            ids.append(e)
            fallback.append(int(fst.is_byte[e].sum()))
            restored.append(fst.decode(e) == text)
        kept = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
        sizes = [0 if e is None else len(e) for e in ids]
        flat = np.concatenate([np.empty(0, np.int32), *(e for e in ids if e is not None)])
        at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.array([*(e is None for e in ids), False]))
        lists = pa.ListArray.from_arrays(at, pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(fallback, pa.int64()), pa.array(restored, pa.bool_())],
                                         [*(n for n in b.schema.names if n != "text"), "ids", "n_fallback", "restored"])


def _decode(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fst = _transducer(shared)
    for b in batches:
        texts = [None if i is None else fst.decode(np.array(i, np.int64)) for i in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _share(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # the model file, read by the driver


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, n_fallback (ids of single bytes), restored (decoding gives the text back), ids.

    One row per row of ``docs``; a null text has null in all of these, an empty text no ids;
    other columns are not read. Whole texts are encoded, whatever their length.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(partial(_encode, _share(docs, model_path)), "doc_id long, ids array<int>, n_fallback long, restored boolean")
    return out.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_ids"), "n_fallback", "restored", "ids")


def decode(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for rows of id lists; a null list gives null, control ids give nothing, the unknown id its surface."""
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(partial(_decode, _share(encoded, model_path)), "doc_id long, text string")
