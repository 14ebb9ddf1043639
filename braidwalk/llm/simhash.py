"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Every word of 23 bits decodes, in the perfect binary
Golay code, to one 12-bit index, and the words one flip away decode to five further indices at most.  Two segments at
most 2 bits apart have a word within one flip of both, so they share an index.  By pigeonhole, the errors of two
fingerprints at most 4 bits apart fall on the segments in one of two ways:

* a segment has none, and of the other two one has at most 2: the key is the first as it is and an index of the second
  (6 x 6 keys at most);
* none is free of errors, so they are 1, 1, 1 or 1, 1, 2: some word lies within two flips of both, in different
  segments; the key is its three indices (91 keys at most).

Fingerprints in reach share a key; keys are long enough that others rarely do.  Buckets are verified exactly.

Keys are shuffled once and stream through the task in order; buckets over ``CHUNK`` distinct fingerprints are cut into
chunks and every pair of chunks is a unit of work, so no bucket has a cap and none is compared in one task.  A unit emits
a spanning forest of its links, never all pairs.

Equal fingerprints (copies, and all texts without words: fingerprint 0) are one node.  Null texts count as empty, rows
that repeat stay rows, ids may be null (a group's id is its smallest that is not).  An empty table gives an empty result;
only ``doc_id`` and ``text`` of the input are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, each_text, skew_join, stored

#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 4
CHUNK = 512


def shingle_hashes(text: str, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of the text's word shingles in order, repeats included (A-Z lower-cased; no words: none)."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included (A-Z lower-cased; no words: 0)."""
    return simhash(shingle_hashes(text, shingle, seed))


def simhash(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        bits = np.unpackbits(h[lo : lo + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


@lru_cache(maxsize=1)
def golay_index() -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word (16 MB)."""

    def remainder(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v ^= ((v >> bit) & 1) * (GENERATOR << (bit - 11))
        return v

    one = 1 << np.arange(23, dtype=np.int64)
    errors = np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])], np.int64)
    fix = np.zeros(2048, np.int64)
    fix[remainder(errors)] = errors  # perfect: each remainder is that of one error of up to 3 bits
    out = np.empty(1 << 23, np.uint16)
    for lo in range(0, 1 << 23, 1 << 20):
        v = np.arange(lo, lo + (1 << 20), dtype=np.int64)
        out[lo : lo + (1 << 20)] = (v ^ fix[remainder(v)]) >> 11
    return out


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every distinct key of each fingerprint (uint64)."""
    index = golay_index()
    exact, near = [], []
    for shift, width in SEGMENTS:
        s = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        own = index[s].astype(np.int64)
        flips = np.sort(index[s[:, None] ^ (1 << np.arange(width))].astype(np.int64), axis=1)
        flips[:, 1:][flips[:, 1:] == flips[:, :-1]] = -1
        flips[flips == own[:, None]] = -1
        exact.append(s)
        near.append(np.concatenate([own[:, None], np.sort(flips, axis=1)[:, :-6:-1]], axis=1))  # own, then up to 5 others
    rows, keys = [], []
    for n, (a, b) in enumerate((x, y) for x in range(3) for y in range(3) if x != y):
        i, j = np.nonzero(near[b] >= 0)
        rows.append(i), keys.append((n + 1) << 40 | exact[a][i] << 12 | near[b][i, j])
    for x in range(6):  # at most two of the three leave their own index
        for y in range(6):
            for z in range(6):
                if (x > 0) + (y > 0) + (z > 0) <= 2:
                    i = np.flatnonzero((near[0][:, x] >= 0) & (near[1][:, y] >= 0) & (near[2][:, z] >= 0))
                    rows.append(i), keys.append(near[0][i, x] << 24 | near[1][i, y] << 12 | near[2][i, z])
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            fps = batch.column(0).slice(lo, 2000).to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])


def linked(v: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning forest of the links among fingerprints (uint64): positions (root, other)."""
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= bits
    left = near.sum(axis=1) > 1
    out = []
    for r in np.flatnonzero(left):
        if not left[r]:
            continue
        tree = front = near[r]
        while True:
            grown = tree | near[front].any(axis=0)
            front = grown & ~tree
            if not front.any():
                break
            tree = grown
        left &= ~tree
        out += [(int(r), int(x)) for x in np.flatnonzero(tree) if x != r]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(0)
        flat, off = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
        at = np.concatenate([[0], np.cumsum(off)])
        none = np.zeros(0, np.int64)
        a, b = [none], [none]
        for i in np.flatnonzero(off > 1):
            v = flat[at[i] : at[i + 1]]
            if pairs := linked(v.view(np.uint64)):
                p = np.array(pairs)
                a.append(v[p[:, 0]]), b.append(v[p[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _buckets(chunk: int):
    """(key, fp) sorted by key -> links (a, b) of buckets up to ``chunk``; rows (key, fp) of larger ones, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held_key, held, large = None, none, False

        def out(a, b, key=None, fp=none):
            n, m = len(a), len(fp)
            cols = [np.concatenate([a, np.zeros(m, np.int64)]), np.concatenate([b, np.zeros(m, np.int64)]), np.concatenate([np.zeros(n, np.int64), np.full(m, key or 0)]), np.concatenate([np.zeros(n, np.int64), fp])]
            flag = np.concatenate([np.zeros(n, bool), np.ones(m, bool)])
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(flag)], ["a", "b", "key", "fp", "large"])

        def forest(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            pairs = np.array(linked(v.view(np.uint64)) if len(v) > 1 else [], np.int64).reshape(-1, 2)
            return [(v[pairs[:, 0]], v[pairs[:, 1]])] if len(pairs) else []

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            several = np.diff(cuts) > 1  # most are alone in their bucket; the first and the last may go on in other batches
            several[[0, -1]] = True
            links_: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip(cuts[:-1][several].tolist(), cuts[1:][several].tolist()):
                v, key = fps[lo:hi], int(keys[lo])
                if key != held_key:
                    links_ += forest(held)
                    held_key, held, large = key, none, False
                if large:
                    yield out(none, none, key, v)
                    continue
                held = np.concatenate([held, v])
                if len(held) > chunk:
                    yield out(none, none, key, held)
                    held, large = none, True
            if links_:
                yield out(*(np.concatenate(x) for x in zip(*links_)))
        for a, b in forest(held):
            yield out(a, b)

    return run


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` (long) that span every component of those <= 4 bits apart.

    The keys are made once and shuffled once: sorted by key, buckets stream through the task.  Buckets over ``CHUNK``
    leave it again and are compared chunk by chunk, every pair of chunks a unit of work.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.select("fp").repartition(n, "fp")  # few bytes a row become many, so none of these partitions are joined
    keyed = dealt.mapInArrow(_emit_keys, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = stored(keyed.mapInArrow(_buckets(CHUNK), "a long, b long, key long, fp long, large boolean"))
    big = found.filter("large").select("key", "fp")
    sizes = big.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("m"))
    parts = big.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    others = F.when(F.col("m") > 1, F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda o: o != F.col("c"))).otherwise(F.array(F.lit(0)))
    units = parts.withColumn("o", F.explode(others)).select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    units = units.repartition("key", "i", "j").groupBy("key", "i", "j").agg(F.collect_list("fp").alias("fps"))
    across = units.select("fps").filter(F.size("fps") > 1).mapInArrow(_verify, "a long, b long")
    return found.filter("not large").select("a", "b").unionByName(across).distinct()


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """Columns of ``docs`` but ``text``, and fp (long: the bits of the fingerprint)."""

    def signed(text: str) -> tuple[int]:
        f = fingerprint(text, shingle)
        return (f - (1 << 64) if f >> 63 else f,)

    return each_text(docs, lambda: signed, "fp long")


def near_duplicate_groups(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id: smallest doc_id reachable over links) for each row of ``docs`` (doc_id, text)."""
    rows = stored(fingerprints(docs.select("doc_id", "text"), shingle))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    joined = components(links(distinct)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = stored(distinct.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    roots = stored(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")))
    by_fp = stored(skew_join(named.select("fp", "n", "root"), roots, "root", "members").select("fp", "n", "component_id"))
    return skew_join(rows, by_fp, "fp", "n").select("doc_id", "fp", "component_id")


def hex_digits(c: str):
    return F.lower(F.lpad(F.hex(c), 16, "0"))
