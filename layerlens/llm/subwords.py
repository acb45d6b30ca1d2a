"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import joined, slices, text_of

SPACE = "\u2581"
CACHED_SEGMENTS, CACHED_PAIRS = 800_000, 1_000_000
#: Fixed values of the model file: piece types and model types.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Transducer:
    """Normaliser, pieces and byte fallback as one weighted transducer, composed with an input on demand.

    Three machines are compiled from the model.  The normaliser (deterministic, so composing it is rewriting the text) maps a
    space to the space mark, drops further spaces where the model says so and puts a mark in front.  The piece machine is a
    trie: from its root, an arc for each piece reads the piece's characters and writes its id.  The fallback machine has an
    arc for each character that is no piece, which writes its bytes' ids, or the unknown id once for a run.

    A path's weight is the sum of its arcs' (tropical semiring: sum along a path, minimum over paths); `shortest` relaxes the
    arcs of the composition place by place, which is its topological order.  A unigram model weighs a piece by its negated
    log probability.  A byte-pair model's arcs weigh one each, and its states remember the last piece: an arc leads on only
    if merging the two pieces' joint text gives these two again, any other has the semiring's zero (infinite) as its weight.
    Exactly one path of finite weight is left, the encoding by merges; and as each prefix of the input has one such path
    too, a place has one state at most.
    """

    def __init__(self, model: bytes):
        self.text: list[str] = []
        self.weight: list[float] = []
        self.kind: list[int] = []
        self.prefix, self.collapse, self.model, self.escape, charsmap = True, True, UNIGRAM, True, b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                self.weight.append(-struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kind.append(piece.get(3, NORMAL))
            elif number == 2:
                self.model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.prefix, self.collapse, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if charsmap or self.model not in (UNIGRAM, BPE) or not self.escape:
            raise ValueError("only unigram and byte-pair models with the identity normaliser are supported")
        self.id = {t: i for i, t in enumerate(self.text) if self.kind[i] in (NORMAL, USER)}
        self.packed = {t: struct.pack("<I", i) for t, i in self.id.items()}
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        self.unknown_packed = struct.pack("<I", self.unknown)
        self.rank = {t: self.weight[i] for t, i in self.id.items()}
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else t.encode() if k in (NORMAL, USER) else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for t, k in zip(self.text, self.kind, strict=True)]
        #: The piece machine: a state is the text read since the root; its value is the weight of the arc that may end there.
        one = self.model == BPE
        far = float("inf")
        self.trie: dict[str, float] = {p[:k]: far for p in self.id for k in range(1, len(p) + 1)}
        self.trie |= {p: 1.0 if one else self.weight[i] for p, i in self.id.items()}
        #: The fallback machine's arcs: dearer than any piece by a fixed penalty, as the library has it.
        self.fallback = 1.0 if one else max((self.weight[i] for i in self.id.values() if self.kind[i] == NORMAL), default=0.0) + 10.0
        if not one:  # the user's own symbols win over any cut of them
            least = min((self.weight[i] for i in self.id.values() if self.kind[i] == NORMAL), default=0.0)
            self.trie |= {p: len(p) * least - 0.1 for p, i in self.id.items() if self.kind[i] == USER}
        alone = "".join(c for c in "\n\t\r|" if not any(c in pair for pair in self.inside))
        #: Cuts that no piece spans: before a run of space marks, and around characters that only stand alone.
        self.cut = re.compile(rf"{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+|[{re.escape(alone)}]" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cuts_hold = bool(self.bytes) and not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        if self.collapse:
            text = " ".join(text.split(" ")).strip(" ") if "  " not in text else re.sub(" +", " ", text).strip(" ")
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """The byte-pair merges of a short text: the best-ranked neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def adjoin(self, a: str, b: str) -> bool:
        """Whether, of a byte-pair model, the arc of piece b leads on from the state that piece a leads to."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def shortest(self, text: str) -> list[str]:
        """The pieces (or single characters that are none) on the path of least weight over text.

        A place's arcs are the pieces read from there, along the trie, and the fallback where its character is no piece.
        """
        n, far, trie, inside, known, states = len(text), float("inf"), self.trie, self.inside, self.pairs.get, self.model == BPE
        cost, piece = [0.0] + [far] * n, [""] * (n + 1)
        for i in range(n):
            if (so_far := cost[i]) == far:
                continue
            before, j = piece[i], i + 1
            bound = states and before and before[-1] + text[i] in inside  # else any arc leads on
            weight = trie.get(text[i], far)
            if weight == far:
                weight = self.fallback
            arc = text[i]
            while True:
                total = so_far + weight
                if total < cost[j] and (not bound or (ok := known((before, arc))) or ok is None and self.adjoin(before, arc)):
                    cost[j], piece[j] = total, arc
                j += 1
                arc = text[i:j]
                if j > n or (weight := trie.get(arc)) is None:
                    break
        out, at = [], n
        while at:
            out.append(piece[at])
            at -= len(piece[at])
        return out[::-1]

    def _ids(self, segment: str) -> bytes:
        out: list[bytes] = []
        for piece in self.shortest(segment):
            ids = self.packed.get(piece) or self._fallback(piece)
            if ids != self.unknown_packed or not out or out[-1] != ids:  # a run of unknowns is written once
                out.append(ids)
        return b"".join(out)

    def _fallback(self, character: str) -> bytes:
        return np.asarray([self.bytes[b] for b in character.encode()], "<u4").tobytes() if self.bytes else self.unknown_packed

    def _learn(self, segment: str) -> bytes:
        stem = segment.rstrip(".,")
        if stem and len(stem) < len(segment) and stem[-1] + segment[len(stem)] not in self.inside:
            ids = (self.known.get(stem) or self._learn(stem)) + self._ids(segment[len(stem) :])
        else:
            ids = self._ids(segment)
        self.known[segment] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers.  Segments that no piece spans are encoded apart and cached."""
        text = self.normalise(text)
        if not self.cuts_hold:
            return self._ids(text)
        segments = self.cut.findall(text)
        if len(self.known) >= CACHED_SEGMENTS:
            self.known.clear()
        for x in {*segments}.difference(self.known):
            self._learn(x)
        return b"".join(map(self.known.__getitem__, segments))

    def decode(self, ids: Iterable[int]) -> str:
        """The output side read back: pieces and bytes in a row, space marks as spaces, the one in front dropped."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def transducer(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


ENCODED = "ids array<int>, n_ids long, n_fallback long, ids_crc32 long, round_trip boolean"


def encode(docs: DataFrame, model_path: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with `pieces`: struct<ids, n_ids, n_fallback, ids_crc32, round_trip> of each whole text.

    model_path is read on every executor.  round_trip says that decoding the ids gives the text again; a text that holds
    the space mark itself can't.

    Defined results: null and empty texts have no ids; an empty table gives no rows; repeated rows get the same answer each;
    other columns stay, one named pieces is replaced.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield joined((coded(part["text"]) for part in slices(texts.to_frame("text"))), coded([]))

    def coded(texts: Iterable[str]) -> pd.DataFrame:
        t, rows = transducer(model_path), []
        low, high = min(t.bytes.values(), default=0), max(t.bytes.values(), default=-1)
        for text in texts:
            raw = t.encode(text)
            ids = np.frombuffer(raw, "<u4")
            rows.append((ids.astype("i4") if with_ids else None, len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(raw), t.decode(ids.tolist()) == text))
        return pd.DataFrame(rows, columns=["ids", "n_ids", "n_fallback", "ids_crc32", "round_trip"])

    return docs.withColumn("pieces", F.pandas_udf(run, ENCODED)(text_of(text_col)))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """rows with `text` from an array of ids.

    Defined results: null and empty arrays give the empty text; ids the model lacks fail the job; an empty table gives no
    rows; repeated rows get the same answer each; a column named text is replaced.
    """

    def run(batch: pd.Series) -> pd.Series:
        t = transducer(model_path)
        return pd.Series([t.decode(x) for x in batch], dtype=object)

    return rows.withColumn("text", F.pandas_udf(run, "string")(F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))))
