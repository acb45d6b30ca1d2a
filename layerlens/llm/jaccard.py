"""Word n-gram Jaccard join by prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import Scratch, cell, filter_bits, may_hold, membership, slices, text_of
from layerlens.llm.components import components

#: The default sketch of token frequencies: 2 ** bits counters, a fixed size of 16 MB whatever the corpus.
SKETCH_BITS = 22
#: Bits of a set's parity signature, as longs: where the signatures of two sets differ, the sets do.
SIGNATURE = 8
_BLOCK = 1 << 12
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


_TRUE, _ALL = np.array([True]), 0xFFFFFFFFFFFFFFFF


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit; another for each salt."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Iterable[str], n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit fingerprints of its n-word shingles.

    Words are what stands between ASCII white space, with A-Z lowered.  A text of fewer words is one shingle, salted by its
    word count.  Two different shingles of the texts compared share a fingerprint with a chance of 2 ** -64 a pair.
    """
    split = [x.encode().lower().split() for x in texts]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, sum(map(len, split)))
    full = _mixed(sum((h[i : len(h) - n + 1 + i] * _ODD[i] for i in range(n)), np.uint64(n))) if len(h) >= n else h[:0]
    out, at = [], 0
    for words in split:
        k = len(words)
        if k >= n:
            s = np.sort(full[at : at + k - n + 1])
            out.append(s[np.concatenate((_TRUE, s[1:] != s[:-1]))])
        else:
            out.append(_mixed(np.array([sum(int(x) * int(o) for x, o in zip(h[at : at + k], _ODD, strict=False)) + k & _ALL], np.uint64)) if k else h[:0])
        at += k
    return out


def prefix_length(size: int, percent: int) -> int:
    """Two sets at the threshold with this size on one side share ceil(percent size / 100) tokens at least."""
    return size - -(-percent * size // 100) + 1


def _cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(tokens, 7) >> np.uint64(64 - bits)).astype(np.int64)


def _ordered(tokens: np.ndarray, frequency: np.ndarray, order: int, bits: int, count: int) -> np.ndarray:
    """The first count of sorted tokens under a global order: 0 ranks by estimated frequency, higher ones by its magnitude;
    then 40 bits of a hash, then the token itself decide."""
    f = np.minimum(frequency[_cells(tokens, bits)], (1 << 24) - 1).astype(np.uint64)
    if order:
        f = np.frexp(f.astype(np.float64))[1].astype(np.uint64)
    key = (f << np.uint64(40)) | (_mixed(tokens, 100 + order) >> np.uint64(24))
    return tokens[np.argsort(key, kind="stable")[:count]]


def _block_bytes(counts: np.ndarray) -> bytes:
    """A block of counters: 4 bytes each, or 1 byte each, or place and count of those that aren't 0, 3 bytes each."""
    if counts.max() > 255:
        return counts.tobytes()
    at = np.flatnonzero(counts)
    if 3 * len(at) < len(counts):
        return at.astype("<u2").tobytes() + counts[at].astype(np.uint8).tobytes()
    return counts.astype(np.uint8).tobytes()


def _block_counts(data: bytes, width: int) -> np.ndarray:
    if len(data) in (width, 4 * width):
        return np.frombuffer(data, np.uint8 if len(data) == width else np.uint32).astype(np.uint64)
    n, out = len(data) // 3, np.zeros(width, np.uint64)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, np.uint8, n, 2 * n)
    return out


def _sets(docs: DataFrame, n: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind 0: id, a hash of the text, size and a 128-bit digest of each set; of kind 1: blocks of the partition's
    frequency sketch.  Ids pass through Python as strings: a column of numbers with a null among them would become floats."""

    def build(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, np.uint32)
        for frame in chain.from_iterable(map(slices, frames)):
            sets = shingle_sets(frame["text"], n)
            counts += np.bincount(_cells(np.concatenate([*sets, np.empty(0, np.uint64)]), bits), minlength=1 << bits).astype(np.uint32)
            yield pd.DataFrame({"kind": 0, "id": frame["id"].astype(object), "text_key": frame["text_key"], "size": [len(s) for s in sets], "data": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]})
        blocks = counts.reshape(-1, min(_BLOCK, 1 << bits))
        for at in range(0, len(blocks), 64):
            some = [b for b in range(at, min(at + 64, len(blocks))) if blocks[b].any()]
            yield pd.DataFrame({"kind": 1, "id": pd.Series([str(b) for b in some], dtype=object), "text_key": 0, "size": 0, "data": [_block_bytes(blocks[b]) for b in some]})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInPandas(build, "kind int, id string, text_key long, size int, data binary").withColumn("id", F.col("id").cast("long"))


def _frequencies(blocks: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch; the driver gets its 2 ** bits counters only, of four bytes, and holds them once."""
    width = min(_BLOCK, 1 << bits)

    def add(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for b, data in zip(frame["id"], frame["data"], strict=True):
                total[b] = total.get(b, np.zeros(width, np.uint64)) + _block_counts(data, width)
        yield pd.DataFrame({"id": pd.Series(list(total), dtype="int64"), "data": [np.minimum(v, most).astype(np.uint32).tobytes() for v in total.values()]})

    out, most = np.zeros(1 << bits, np.uint32), np.uint64((1 << 32) - 1)
    for r in blocks.select("id", "data").repartition(F.col("id")).mapInPandas(add, "id long, data binary").toLocalIterator():
        at = slice(r.id * width, (r.id + 1) * width)
        out[at] = np.minimum(out[at].astype(np.uint64) + np.frombuffer(bytes(r.data), np.uint32), most)
    return out


def _signature(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall on each of the signature's bits, modulo two, as longs."""
    bits = 64 * SIGNATURE
    return np.packbits((np.bincount((_mixed(tokens, 9) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _tokens(docs: DataFrame, wanted, wanted_bits: int, n: int, percent: int, bits: int, frequency, whole: bool) -> DataFrame:
    """Of the rows (id, text) whose id may be wanted: id, size, the prefix under order 0 and the signature; or, whole, all
    tokens and the prefixes under orders 1 and 2."""

    def build(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = frequency.value
        for frame in frames:
            frame = frame[may_hold(wanted.value, frame["cell"].to_numpy(np.int64))]
            for part in slices(frame):
                out = []
                for i, s in zip(part["id"], shingle_sets(part["text"], n), strict=True):
                    if len(s):
                        p = prefix_length(len(s), percent)
                        arrays = (np.sort(s.view(np.int64)), *(_ordered(s, f, k, bits, p) for k in (1, 2))) if whole else (_ordered(s, f, 0, bits, p), _signature(s))
                        out.append((i, len(s), *(a.view(np.int64) for a in arrays)))
                yield pd.DataFrame(out, columns=["id", "size", *(("tokens", "second", "third") if whole else ("first", "signature"))])

    arrays = "tokens array<long>, second array<long>, third array<long>" if whole else "first array<long>, signature array<long>"
    rows = docs.where("id is not null").select("id", "text", cell(F.xxhash64("id"), wanted_bits).alias("cell"))
    return rows.mapInPandas(build, f"id long, size int, {arrays}")


def _by_tokens(frame: pd.DataFrame, limit: int = 500_000) -> Iterator[pd.DataFrame]:
    """frame in parts that hold about so many tokens of their prefixes, a row at least: what a task unrolls at a time."""
    part = frame["first"].map(len).cumsum().to_numpy(np.int64) // limit
    for k in np.unique(part):
        yield frame.iloc[np.searchsorted(part, k) : np.searchsorted(part, k, side="right")]


def _some_tokens(prefixes: DataFrame, shared, shared_bits: int) -> DataFrame:
    """The places (id, size, at, token) of prefixes whose token may be shared."""

    def build(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chain.from_iterable(map(_by_tokens, frames)):
            counts = frame["first"].map(len).to_numpy(np.int64)
            token = np.concatenate(frame["first"].to_numpy())
            keep = may_hold(shared.value, (token.view(np.uint64) >> np.uint64(64 - shared_bits)).astype(np.int64))
            row = np.repeat(np.arange(len(frame)), counts)[keep]
            at = (np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts))[keep]
            yield frame[["id", "size"]].iloc[row].assign(at=at, token=token[keep])

    return prefixes.select("id", "size", "first").mapInPandas(build, "id long, size int, at int, token long")


def _share(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that meet under the other orders, both of them, and then reach the threshold itself.

    The orders' prefixes alone are joined to the pairs; whole sets are fetched for the pairs that are left.
    """
    head = lambda x: whole.select(F.col("id").alias(x), F.col("second").alias(f"second_{x}"), F.col("third").alias(f"third_{x}"))
    meet = F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")
    near = pairs.join(head("b"), "b").join(head("a"), "a").where(meet).select("a", "b")

    def check(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for a, b, x, y in frame[["a", "b", "tokens_a", "tokens_b"]].itertuples(index=False):
                both = _share(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append((a, b))
            yield pd.DataFrame(keep, columns=["a", "b"])

    side = lambda x: whole.select(F.col("id").alias(x), F.col("tokens").alias(f"tokens_{x}"))
    return near.join(side("b"), "b").join(side("a"), "a").mapInPandas(check, "a long, b long")


def _reachable(size_a: Column, at_a: Column, size_b: Column, at_b: Column, percent: int) -> Column:
    """Positional filter, the length filter in it: from a common token on, both sets have tokens enough left.

    The linked sets' first common token passes it; so it may be asked of each common token by itself.
    """
    return (100 + percent) * F.least(size_a - at_a, size_b - at_b) >= percent * (size_a + size_b)


def _alike(a: str, b: str, percent: int) -> Column:
    """Two sets differ in at least as many tokens as their signatures in bits, and linked sets in at most (100 - t) /
    (100 + t) of their sizes' sum."""
    c = lambda name, side: F.col(f"{name}{side}")
    apart = reduce(add, (F.bit_count(c("signature", a)[k].bitwiseXOR(c("signature", b)[k])) for k in range(SIGNATURE)))
    return (100 + percent) * apart <= (100 - percent) * (c("size", a) + c("size", b))


def _star(posts: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (leader, document) that share a token.

    A token's leader is the one before whose place for it stand the fewest rarer tokens: of a family of copies, one with the
    least of its own, which most others link to.
    """
    lead = posts.groupBy("token").agg(F.min(F.struct("at", F.xxhash64("id").alias("h"), "id", "size")).alias("l"))
    lead = lead.select("token", *(F.col(f"l.{c}").alias(f"{c}_l") for c in ("id", "at", "size")))
    met = posts.join(lead, "token").where((F.col("id") != F.col("id_l")) & _reachable(*map(F.col, ("size", "at", "size_l", "at_l")), percent))
    return met.select(F.col("id_l").alias("a"), F.col("id").alias("b")).distinct()


def _mixed_tokens(posts: DataFrame, label: DataFrame) -> DataFrame:
    """posts with the documents' labels and the token's commonest one, of the tokens whose documents have more than one."""
    labelled = posts.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    counts = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    common = counts.groupBy("token").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", F.col("top.label").alias("common"))
    return labelled.join(common, "token")


def _pairs(rest: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of documents of different labels that share a token and pass the filters.

    Of each token, the documents outside its commonest label meet all others; those in it don't meet each other.
    """
    side = lambda s: rest.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "at", "label", "signature")), F.col("common").alias(f"common_{s}"))
    other = side("b").where("label_b <> common_b")
    once = (F.col("label_a") == F.col("common_a")) | (F.col("id_a") < F.col("id_b"))
    near = _reachable(*map(F.col, ("size_a", "at_a", "size_b", "at_b")), percent) & _alike("_a", "_b", percent)
    met = side("a").join(other, "token").where((F.col("label_a") != F.col("label_b")) & once & near)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", bits: int = SKETCH_BITS) -> DataFrame:
    """One row per row of docs: id, text_key (a 64-bit hash of the text), n_shingles, component_id.

    Two documents link when 100 |A and B| >= percent |A or B| of their sets of n-word shingles; component_id is the smallest
    id reachable by links.

    Method: multiple global orders.  Documents with equal sets collapse to one.  Order 0 ranks tokens by their frequency as
    estimated by a fixed-size sketch of all of docs (a wrong estimate changes the order, never the answer), the others rank
    its magnitude and then hash.  Linked sets share a token among their first |S| - ceil(t |S|) + 1 under every order: order
    0 proposes pairs, subject to length, position and the sets' signatures; the prefixes of the other orders are intersected
    with it; and what is left is verified on whole sets.

    Pairs are proposed in two steps.  First each document meets one leader of each of its tokens; verified links give
    components.  Then all pairs of different components that share a token are proposed, so no link is lost, and a family
    of copies, one component by then, doesn't cost its square.

    Defined results: null, empty and blank texts have no shingles and link with nothing; rows with a null id get the
    component of their equals that have ids, else null; rows that repeat an id are one document, each with the component of
    its own text; an empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "jaccard")
    built = work.table(_sets(docs, n, bits, id_col, text_col), "sets")
    sets = built.where("kind = 0").select("id", "text_key", "size", F.col("data").alias("digest"))
    frequency = spark.sparkContext.broadcast(_frequencies(built.where("kind = 1"), bits))
    classes = work.table(sets.where("size > 0").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    text = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def tokens(ids: DataFrame, whole: bool, name: str) -> DataFrame:
        width = filter_bits(ids.count())
        wanted = spark.sparkContext.broadcast(membership(ids.select(F.xxhash64("id").alias("h")), "h", width))
        return work.table(_tokens(text, wanted, width, n, percent, bits, frequency, whole), name)

    reps = classes.where("rep is not null").select(F.col("rep").alias("id")).distinct()
    prefixes = tokens(reps, False, "prefixes")
    held = prefixes.select(F.posexplode("first").alias("at", "token"), "size")
    reach, sizes = F.min(F.col("size") - F.col("at")).alias("reach"), F.sum("size").alias("sizes")
    counted = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), sizes, reach)
    shared = work.table(counted.where((F.col("n") > 2) | ((F.col("n") == 2) & ((100 + percent) * F.col("reach") >= percent * F.col("sizes")))).select("token"), "shared")
    width = filter_bits(shared.count())
    some = spark.sparkContext.broadcast(membership(shared, "token", width))
    posts = work.table(_some_tokens(prefixes, some, width).join(shared, "token", "left_semi"), "posts")
    signatures = work.table(prefixes.select("id", "size", "signature"), "signatures")
    work.drop("prefixes", "shared")

    def alike(pairs: DataFrame) -> DataFrame:
        side = lambda x: signatures.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("signature").alias(f"signature_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(_alike("_a", "_b", percent)).select("a", "b")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = work.table(pairs, f"{name}-pairs")
        whole = tokens(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), True, f"{name}-tokens")
        links = work.table(_linked(pairs, whole, percent), f"{name}-links")
        work.drop(f"{name}-pairs", f"{name}-tokens")
        return links

    links = linked(alike(_star(posts, percent)), "star")
    rest = work.table(_mixed_tokens(posts, components(links, work)).join(signatures.drop("size"), "id"), "rest")
    work.drop("posts", "signatures")
    label = components(links.unionByName(linked(_pairs(rest, percent), "rest")), work)

    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    out = sets.join(named, "digest", "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    return work.result(out.select(F.col("id").alias(id_col), "text_key", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id")))
