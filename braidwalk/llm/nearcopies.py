"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, closed to groups.

Candidates come from two searches and none counts unverified:

* SimHash fingerprints at most 4 of 64 bits apart, over Golay keys (``simhash.links``), and equal fingerprints;
* ``BANDS`` keys a text, each the hash of ``ROWS`` minima of the set under ``BANDS * ROWS`` multiplications.  A pair of
  similarity s shares none with probability (1 - s^5)^24: 7e-5 at 0.8, 1e-9 at 0.9.  Fingerprints alone do not find such
  pairs: at 0.8 they are about 10 bits apart.

Texts of one set (copies) are one node.  In each bucket the node whose keys are shared most, which copies of one text lie
around, is compared to all others.  A bucket that still holds several groups is then compared whole: its sets are cut
into chunks of ``CHUNK`` shingles, every pair of chunks is a unit of work that multiplies their incidence matrices and
returns a forest of the links between groups.  So no bucket has a cap, no pair is missed, and no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, each_text, packed, skew_join, stored, unpacked
from .simhash import links, shingle_hashes, simhash

SHINGLE = 5
BANDS, ROWS = 24, 5
CHUNK, COLUMNS = 1 << 18, 4096
_TIMES = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketch(text: str) -> tuple[int, int, list[int]]:
    """(fingerprint, digest of the set of shingles, band keys: none for a text without words)."""
    import xxhash

    h = shingle_hashes(text, SHINGLE)
    u = np.unique(h)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(u), 1024):
        np.minimum(low, (u[None, lo : lo + 1024] * _TIMES[:, None]).min(axis=1), out=low)
    bands = [_signed(xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b)) for b in range(BANDS)] if len(u) else []
    return _signed(simhash(h)), _signed(xxhash.xxh64_intdigest(u.tobytes())), bands


@lru_cache(maxsize=64)
def _set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def near(a: str, b: str) -> bool:
    """Whether the Jaccard similarity of the two sets is 0.8 or more (two empty sets: yes)."""
    x, y = _set(a), _set(b)
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        ok = pa.array([near(p.as_py() or "", q.as_py() or "") for p, q in zip(x, y)], pa.bool_())
        yield batch.select(["a", "b"]).filter(ok)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b: sets) of similar texts; ``texts`` (set, text) has one row a set."""
    left, right = texts.select(F.col("set").alias("a"), F.col("text").alias("x")), texts.select(F.col("set").alias("b"), F.col("text").alias("y"))
    return stored(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(_near, "a long, b long"))


def _shingles(text: str) -> tuple[np.ndarray]:
    return (np.unique(shingle_hashes(text, SHINGLE)).view(np.int64),)


def linked_across(sets: list[np.ndarray], roots: np.ndarray) -> list[tuple[int, int]]:
    """A forest over the links (0.8 or more) between sets of different groups, as positions."""
    size = np.array([len(x) for x in sets])
    at = np.repeat(np.arange(len(sets)), size)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = seen[column] > 1  # a shingle of one set is in no overlap
    at, column = at[often], np.unique(column[often], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[at[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    near = (9 * both >= 4 * (size[:, None] + size[None, :]) - 0.5) & (roots[:, None] != roots[None, :])
    out, group = [], {int(r): int(r) for r in roots}

    def top(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        p, q = top(int(roots[i])), top(int(roots[j]))
        if p != q:
            group[max(p, q)] = min(p, q)
            out.append((int(i), int(j)))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for unit in batch.column(0):
            ids, roots, sets = unit.values.field("set").to_numpy(), unit.values.field("root").to_numpy(), unit.values.field("h")
            links_ = linked_across([x.values.to_numpy() for x in sets], roots)
            a += [int(ids[i]) for i, _ in links_]
            b += [int(ids[j]) for _, j in links_]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _across(placed: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b: sets) between different groups of a bucket; ``placed`` (key, set, root)."""
    used = placed.select("set").distinct()
    at = nodes.select("_row", "set").join(used, "set", "left_semi")
    sets = rows.select("_row", "text").join(at, "_row").select("set", "text")
    sets = stored(each_text(sets, lambda: _shingles, "h array<long>").withColumn("size", F.size("h")))
    sized = placed.join(sets.select("set", "size"), "set")
    chunks = sized.groupBy("key").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("m"))
    parts = sized.join(chunks.hint("merge"), "key").withColumn("c", F.pmod(F.xxhash64("set"), F.col("m")).cast("int"))
    others = F.when(F.col("m") > 1, F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda o: o != F.col("c"))).otherwise(F.array(F.lit(0)))
    units = parts.withColumn("o", F.explode(others)).select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "set", "root")
    units = units.join(sets.select("set", "h").hint("merge"), "set")
    grouped = units.groupBy("key", "i", "j").agg(F.collect_list(F.struct("set", "root", "h")).alias("unit"))
    return stored(grouped.select("unit").filter(F.size("unit") > 1).mapInArrow(_units, "a long, b long").distinct())


def near_copy_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packed rows of ``docs`` with _row, an id of the row; (_row, doc_id, hash of the text, _root: the group's id))."""
    rows = packed(docs, F.col("doc_id"), F.monotonically_increasing_id().alias("_row"))
    rows = stored(each_text(rows, lambda: sketch, "_fp long, _set long, _keys array<long>", keep_text=True))
    one = rows.groupBy("_set").agg(F.min("_row").alias("_row"))
    nodes = stored(rows.select("_row", F.col("_set").alias("set"), "_fp", "_keys").join(one.select("_row"), "_row", "left_semi"))
    keyed = nodes.select("set", F.explode(F.concat("_keys", F.array(F.xxhash64(F.lit("fp"), "_fp")))).alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = stored(skew_join(keyed, shared.withColumn("rows", F.col("n")), "key", "rows"))
    popular = members.groupBy("set").agg(F.sum("n").alias("score"))
    centres = members.join(popular, "set").groupBy("key").agg(F.max(F.struct("score", "set")).alias("c"))
    centres = centres.select("key", F.col("c.set").alias("first"))

    by_fp = nodes.groupBy("_fp").agg(F.min("set").alias("set"))
    found = links(by_fp.select(F.col("_fp").alias("fp")))
    found = found.join(by_fp.toDF("a", "p"), "a").join(by_fp.toDF("b", "q"), "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    stars = skew_join(members.select("key", "set"), stored(centres.join(shared, "key")), "key", "n").select(F.least("first", "set").alias("a"), F.greatest("first", "set").alias("b"))
    pairs = stored(stars.unionByName(found).filter("a <> b").distinct())

    def texts(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        at = nodes.select("_row", "set").join(used, "set", "left_semi")
        return stored(rows.select("_row", "text").join(at, "_row").select("set", "text"))

    edges = _verified(pairs, texts(pairs))
    groups = components(edges).select(F.col("node").alias("set"), F.col("component").alias("root"))

    # buckets of three and more that still hold several groups, compared whole
    placed = members.join(groups, "set", "left").select("key", "set", F.coalesce("root", "set").alias("root"))
    mixed = stored(placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("p"), F.max("root").alias("q")).filter("n > 2 and p <> q").select("key"))
    late = _across(placed.join(mixed.hint("merge"), "key"), nodes, rows)
    if late.limit(1).count():
        groups = components(edges.unionByName(late)).select(F.col("node").alias("set"), F.col("component").alias("root"))
    sizes = rows.groupBy("_set").agg(F.count("*").alias("n"))
    roots = sizes.join(groups.withColumnRenamed("set", "_set"), "_set", "left").select("_set", "n", F.coalesce("root", "_set").alias("_root"))
    narrow = rows.select("_row", "doc_id", F.xxhash64("text").alias("_text"), "_set")
    return rows, stored(skew_join(narrow, stored(roots), "_set", "n").drop("_set"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the smallest id (nulls last), then the smallest hash of the text."""
    rows, rooted = near_copy_rows(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "_row"))
    kept = rooted.groupBy("_root").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    return unpacked(rows.join(kept, "_row", "left_semi"), docs)
