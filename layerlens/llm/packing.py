"""Best-fit packing of documents into token sequences, with lower bounds that certify bin counts."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import Scratch, slices, text_of

CAPACITY = 2048
#: Tokens a packing group aims at: a group is one task's work, so its size doesn't grow with the corpus.
GROUP_TOKENS = 1 << 20
ROUNDS = 3
CACHED_WORDS = 800_000
_BETWEEN = "\x01"


class WordTokenizer:
    """Token ids of whole texts as little-endian bytes; what stands between white space is encoded once while it is cached.

    No token of the vocabulary spans white space, so a text's ids are those of its parts in a row.  New parts are encoded
    together, with a control character between them whose id is found again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.inner = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        (self.between,) = self.inner.encode(_BETWEEN, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.asarray(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[bytes]) -> None:
        mark = _BETWEEN.encode()
        for part in [x for x in parts if mark in x]:
            self.known[part] = self.whole(part.decode())
        parts = [x for x in parts if mark not in x]
        groups = [parts[at : at + 500] for at in range(0, len(parts), 500)]
        joined = [f" {_BETWEEN} ".join(x.decode() for x in some) + f" {_BETWEEN}" for some in groups]
        for some, coded in zip(groups, self.inner.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.asarray(coded.ids, "<u4")
            ends, raw = (np.flatnonzero(ids == self.between) * 4).tolist(), ids.tobytes()
            start = 0
            for part, end in zip(some, ends, strict=True):
                self.known[part] = raw[start:end]
                start = end + 4

    def _learn_stemmed(self, parts: set[bytes]) -> None:
        """A stop or comma after an ASCII letter is a token run of its own, so such a part is its stem's ids and its tail's."""
        stems, split = set(), []
        for part in parts:
            stem = part.rstrip(b".,")
            if len(stem) < len(part) and stem[-1:].isalpha():
                split.append((part, stem, part[len(stem) :]))
            else:
                stems.add(part)
        for _, stem, tail in split:
            stems.update((stem, tail))
        self._learn([x for x in stems if x not in self.known])
        known = self.known
        for part, stem, tail in split:
            known[part] = known[stem] + known[tail]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        raw = [x.encode() for x in texts]
        split = [(x if b"<|" in x else x.lower()).split() for x in raw]  # a special token's string counts as it is written
        new = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + 2 * len(new) > CACHED_WORDS:
            self.known.clear()
            new = set(chain.from_iterable(split))
        self._learn_stemmed(new)
        for parts in split:
            yield b"".join(map(self.known.__getitem__, parts))


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: As Python gets them: a column of numbers with a null among them would become floats.
_SPELT = PIECES.replace("doc_id long", "doc_id string")


def _spelt(number: Column) -> Column:
    return number.cast("string")


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The documents' token ids, each with an id 0 after it, cut into pieces of at most capacity tokens."""

    def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, step = tokenizer(tokenizer_path), 4 * capacity
        for frame in chain.from_iterable(map(slices, frames)):
            rows = []
            for doc_id, ids in zip(frame["id"], tok.encode(frame["text"]), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype("i4")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": object})

    rows = docs.select(_spelt(F.col(id_col).cast("long")).alias("id"), text_of(text_col).alias("text"))
    cuts = rows.mapInPandas(cut, _SPELT + (", ids array<int>" if with_ids else ""))
    return cuts.withColumn("doc_id", F.col("doc_id").cast("long"))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of three families of dual feasible functions: no packing has fewer bins."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    # large items against small ones: x counts whole above capacity - cut, as itself from cut on, else not at all
    tail, heads = np.cumsum((count * x)[::-1])[::-1], np.cumsum(count[::-1])[::-1]
    for cut in range(1, capacity // 2 + 1):
        middle = int(tail[cut] - tail[capacity - cut + 1])
        best = max(best, -(-(middle + capacity * int(heads[capacity - cut + 1])) // capacity))
    # rounding: (k + 1) x / capacity, when not whole, falls to the next integer, in k-ths of a bin
    for k in range(1, 51):
        parts = (k + 1) * x
        value = np.where(parts % capacity == 0, x * k, parts // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items given by falling length: bin, offset in it, and the fill of each bin; the fullest bin that fits gets it."""
    place, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: a bin has exactly r tokens of room
    for i, n in enumerate(lengths.tolist()):
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        place[i], offset[i] = b, fill[b]
        fill[b] += n
        if r > n:
            room[r - n].append(b)
            free |= 1 << (r - n)
    return place, offset, np.asarray(fill, np.int64)


def _group_packer(capacity: int, last: bool):
    return lambda frame: _pack_group(frame, capacity, last)


def _pack_group(frame: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    frame = frame.astype({"doc_id": object}).sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    lengths = frame["length"].to_numpy(np.int64)
    place, offset, fill = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    open_ = np.zeros(len(fill), bool)
    if not last:
        if len(fill) > bound:
            open_ = fill < capacity
        else:
            open_[int(np.argmin(fill))] = fill.min() < capacity
    return frame.assign(bin=place, offset=offset, bins=len(fill), bound=bound, closed=~open_[place])


def pack(items: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id, offset and certified.

    Method: items are dealt by hash into groups of about group_tokens tokens, each packed by best-fit decreasing and given a
    lower bound from dual feasible functions.  A group whose bins equal its bound is certified; it keeps all bins but its
    emptiest.  A group with a gap keeps its full bins.  The items of the bins not kept are pooled over all groups, dealt
    anew by another hash and packed again, for at most `rounds` rounds, the last of which keeps every bin.  `certified` says
    that the group that closed the bin needed as many bins as its bound.

    Every round is written to the shared folder, so a lost executor repeats one round's tasks at most; equal items are
    interchangeable, and ties go by id, piece and checksum.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = _SPELT + ", group int, bin long, offset long, bins int, bound int, closed boolean"
    current, done, work = items.select(_spelt(F.col("doc_id")).alias("doc_id"), *columns[1:]), [], Scratch(items.sparkSession, "packing")
    for r in range(rounds):
        tokens = current.agg(F.sum("length")).first()[0]
        if not tokens:
            break
        groups = -(-tokens // group_tokens)
        last = r == rounds - 1 or (r > 0 and groups == 1)
        dealt = current.withColumn("group", F.pmod(F.xxhash64(F.lit(r), *columns), F.lit(groups)).cast("int"))
        packed = work.table(dealt.groupBy("group").applyInPandas(_group_packer(capacity, last), schema), f"round-{r}")
        number = F.col("bin") + F.col("group").cast("long") * (1 << 24) + F.lit(r) * (1 << 58)
        done.append(packed.where("closed").select(*columns, number.alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")))
        current = packed.where("not closed").select(*columns)
        if last:
            break
    if not done:
        done = [current.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")).limit(0)]
    return work.result(reduce(DataFrame.unionByName, done).withColumn("doc_id", F.col("doc_id").cast("long")))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Token pieces of docs with their sequence and offset, see pieces() and pack().

    Defined results: a null text counts as empty and is one piece of the single id 0; an empty table gives no rows; repeated
    rows and null ids are packed as rows of their own; only texts longer than capacity are cut; other columns aren't read.
    """
    work = Scratch(docs.sparkSession, "packing")
    packed = pack(work.table(pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces"), capacity, group_tokens)
    work.drop()
    return packed
