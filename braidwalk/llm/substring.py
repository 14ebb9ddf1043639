"""Substring dedup by prefix-partitioned suffix trees over words.

A window is ``length`` consecutive words; the aim is every word covered by a window that starts anywhere else too.

1. Partition.  Suffixes are split by prefixes of variable length: a suffix's prefix runs to the end of the phrase of least
   hash among the phrases of ``PHRASE`` words in its first ``length`` words, so it has ``PHRASE`` to ``length`` words.
   Suffixes that share a window share their prefix.  Prefixes that end in the same phrase make one group; neighbours in
   a text mostly end in the same place and travel together as one segment of text.
2. Prune.  Phrases are counted over all distinct texts; a phrase that occurs once belongs to no repeated window.
3. Trees.  Groups of up to ``GROUP`` segments become subtrees: suffixes in order with the depth at which neighbours part,
   which is the tree's internal nodes.  A node of depth ``length`` or more is a repeat that no word on the right extends;
   all its leaves are repeated over the node's depth, and touching ranges of a text join to the maximal repeats.
   A group over ``GROUP`` is split by lengthening the prefixes to all ``length`` words.  Such a prefix is itself one deep
   node, so its leaves need a count (combined in the task, then shuffled) and a join back, salted by the group's size.

Texts that are equal word for word are one text with a multiplicity (all their windows are repeated).  Null texts count
as empty; texts of fewer than ``length`` words keep all; ids may be null or repeat (rows are told apart by id and text);
repeated rows are copies of each other; an empty table gives an empty result.  Columns of the input pass through, but
those with the name of a result column give way to it.  Long texts are hashed in stretches of ``STRETCH`` windows, and
results leave the task in bounded batches.  Words are compared as they are, so hash collisions cannot remove a word in
the trees; equality of whole-window prefixes and of whole texts is that of 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text, named_results, packed, skew_join, stored

PHRASE, GROUP, STRETCH = 8, 256, 8192
#: Suffixes sorted at a time (a group more than that is sorted alone); windows a salt of a split group.
SORTED, SALTED = 8192, 4096
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8: bytes.split() splits at exactly the six ASCII white-space characters."""
    return text.encode().split()


def text_key(joined: bytes) -> tuple[int, int]:
    import xxhash

    v = xxhash.xxh3_128_intdigest(joined)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (v >> 64, v & (1 << 64) - 1))


def phrase_runs(words: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with the same phrase at the same place: (first window, windows, place, phrase hash), by stretch."""
    k = min(PHRASE, length)
    span = length - k + 1
    for lo in range(0, len(words) - length + 1, STRETCH):
        part = words[lo : lo + STRETCH + length - 1]
        n = len(part)
        data = np.frombuffer(b" ".join(part), np.uint8)
        up, down = _power(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, n) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            s, e = starts[: n - k + 1], ends[k - 1 :]
            h = (total[e] - total[s]) * down[s]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        at = np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1)
        at += np.arange(len(at))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        yield lo + first, np.diff(np.concatenate([first, [len(at)]])), lo + at[first], h[at[first]].view(np.int64)


class SuffixTree:
    """Suffixes of word lists in order, and the depth in words at which each parts from the next.

    ``lists``: (group, words, number of suffixes from the front).  Lists of different groups share no node but the root.
    ``leaves`` are (list, start) pairs; ``depth[i]`` is that of the deepest internal node over leaves i and i + 1.
    """

    def __init__(self, lists: list[tuple[int, list[bytes], int]]):
        number: dict[bytes, int] = {}
        width = max(len(w) for _, w, _ in lists)
        rows, owner, start = [], [], []
        for k, (group, words, n) in enumerate(lists):
            coded = np.zeros(len(words) + width, ">u4")
            coded[: len(words)] = [number.setdefault(w, len(number) + 1) for w in words]
            m = np.empty((n, width + 1), ">u4")
            m[:, 0] = group + 1
            m[:, 1:] = np.lib.stride_tricks.sliding_window_view(coded, width)[:n]
            rows.append(m), owner.append(np.full(n, k)), start.append(np.arange(n))
        table = np.concatenate(rows)
        order = np.argsort(table.view(f"S{4 * (width + 1)}").ravel(), kind="stable")
        table = table[order]
        self.owner, self.start = np.concatenate(owner)[order], np.concatenate(start)[order]
        parts = table[1:] != table[:-1]
        depth = np.where(parts.any(axis=1), parts.argmax(axis=1), width + 1) - 1
        have = np.array([len(w) for _, w, _ in lists])[self.owner] - self.start
        self.depth = np.clip(depth, 0, np.minimum(have[1:], have[:-1]))

    def repeats(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, start, depth of the deepest node above) of every leaf below a node of depth ``least`` or more."""
        zero = np.zeros(1, self.depth.dtype)
        above = np.maximum(np.concatenate([zero, self.depth]), np.concatenate([self.depth, zero]))
        at = np.flatnonzero(above >= least)
        return self.owner[at], self.start[at], above[at]

    def nodes(self, least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(depth, leaves) of every internal node of depth ``least`` or more, inner nodes before those around them."""
        leaf = lambda lo, hi: list(zip(self.owner[lo : hi + 1].tolist(), self.start[lo : hi + 1].tolist()))
        open_: list[tuple[int, int]] = []  # (depth, first leaf), depths ascending
        for i, d in enumerate([*self.depth.tolist(), 0]):
            lo = i
            while open_ and open_[-1][0] > d:
                depth, lo = open_.pop()
                yield depth, leaf(lo, i)
            if d >= least and (not open_ or open_[-1][0] < d):
                open_.append((d, lo))


def _joined(ranges: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges of words, those that touch or overlap made one."""
    out: list[list[int]] = []
    for lo, hi in ranges:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _profile(length: int):
    def work():
        def one(text: str):
            words = words_of(text)
            places, hashes, last = [], [], -1
            for _, _, at, h in phrase_runs(words, length):
                new = at > last  # a run cut by the end of a stretch counts once
                places.append(at[new]), hashes.append(h[new])
                last = at[-1]
            return *text_key(b" ".join(words)), len(words), np.concatenate(hashes) if hashes else []

        return one

    return work


def _segments(length: int):
    """(text, wanted phrases with their counts) -> segments of text, or for large groups whole-window prefixes."""
    names = ["k1", "k2", "h", "n", "at", "windows", "words", "w1", "w2"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def rows_of(words: list[bytes], key: tuple[int, int], wanted: dict[int, int]) -> Iterator[tuple]:
        for first, count, _, h in phrase_runs(words, length):
            for f, c, x in zip(first.tolist(), count.tolist(), h.tolist()):
                n = wanted.get(x)
                if n is None:
                    continue
                if n <= GROUP:
                    yield *key, x, n, f, c, b" ".join(words[f : f + c + length - 1]), None, None
                else:
                    for s in range(f, f + c):
                        yield *key, None, n, s, 1, None, *text_key(b" ".join(words[s : s + length]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for text, entries in zip(batch.column("text"), batch.column("wanted")):
                words = words_of(text.as_py() or "")
                key = text_key(b" ".join(words))
                for entry in entries.as_py():
                    if (entry["k1"], entry["k2"]) == key:
                        for row in rows_of(words, key, {x["h"]: x["n"] for x in entry["phrases"]}):
                            out.append(row)
                            if len(out) == 2000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _trees(length: int):
    """Groups of segments -> ranges of repeated words; small groups share a sort, each with its own subtree.

    Segments of a group that are equal word for word are one path: all their suffixes are repeated, and one stands in the
    tree for them.
    """

    def found(groups: list[dict[bytes, list[int]]], windows: list[int]) -> Iterator[tuple[int, int, int]]:
        """(segment, first word, end) of repeated words; a group: its segments by their words."""
        lists, members = [], []
        for g, by_words in enumerate(groups):
            for words, same in by_words.items():
                n = windows[same[0]]
                if len(same) > 1:
                    yield from ((k, 0, n - 1 + length) for k in same)
                if len(by_words) > 1:
                    lists.append((g, words.split(b" "), n)), members.append(same)
        if not lists:
            return
        tree = SuffixTree(lists)
        owner, start, depth = tree.repeats(length)
        order = np.lexsort((start, owner))
        owner, start, depth = owner[order], start[order], depth[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for o, s, d in zip(np.split(owner, cuts), np.split(start, cuts), np.split(depth, cuts)):
            if len(o) and len(members[o[0]]) == 1:
                for lo, hi in _joined(zip(s.tolist(), (s + d).tolist())):
                    yield members[o[0]][0], lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            flat, offsets = col.flatten(), (col.offsets.to_numpy() - col.offsets[0].as_py()).tolist()
            k1, k2, at = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "at"))
            words, windows = flat.field("words").to_pylist(), flat.field("windows").to_pylist()
            groups, size = [], 0
            for lo, hi in zip(offsets, offsets[1:]):
                by_words: dict[bytes, list[int]] = {}
                for k in range(lo, hi):
                    by_words.setdefault(words[k], []).append(k)
                groups.append(by_words)
                size += sum(windows[same[0]] for same in by_words.values()) if len(by_words) > 1 else 0
                if size >= SORTED or hi == offsets[-1]:
                    rows = np.array(list(found(groups, windows)), np.int64).reshape(-1, 3)
                    k, groups, size = rows[:, 0], [], 0
                    cols = [k1[k], k2[k], (at[k] + rows[:, 1]).astype(np.int32), (at[k] + rows[:, 2]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["k1", "k2", "lo", "hi"])

    return run


def _kept(length: int):
    names = ["n_words", "n_removed", "kept_text", "kept_sha256"]

    def one(text: str, marks: list | None) -> tuple:
        words = words_of(text)
        n, kept = len(words), words
        if marks and n >= length:
            key = text_key(b" ".join(words))
            for m in marks:
                if (m["k1"], m["k2"]) == key:
                    kept, at = [], 0
                    for lo, hi in [(0, n)] if m["copies"] > 1 else sorted((r["lo"], r["hi"]) for r in m["ranges"] or ()):
                        kept += words[at : max(at, lo)]
                        at = max(at, hi)
                    kept += words[at:]
                    break
        joined = b" ".join(kept)
        return n, n - len(kept), joined, hashlib.sha256(joined).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = [one(t.as_py() or "", m.as_py()) for t, m in zip(part.column("text"), part.column("marks"))]
                cols = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.binary(), pa.string()])]
                yield pa.RecordBatch.from_arrays([part.column("rest"), *cols[:2], cols[2].cast(pa.string()), cols[3]], ["rest", *names])

    return run


def _row_key(length: int) -> tuple[Column, Column]:
    """Id and text hash: what tells rows apart; texts too short for a window get keys of their own, which match nothing."""
    short = F.coalesce(F.length("text"), F.lit(0)) < 2 * length - 1
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.when(short, F.monotonically_increasing_id()), F.when(~short, F.col("text"))).alias("th")


def _marks(rows: DataFrame, length: int) -> DataFrame:
    """(id, th, marks: for each text of that key k1, k2, copies, ranges of repeated words) of rows with any."""
    key = ["k1", "k2"]
    able = rows.filter(F.length("text") >= 2 * length - 1)
    profile = stored(each_text(able, _profile(length), "k1 long, k2 long, n_words int, phrases array<long>").filter(F.col("n_words") >= length))
    texts = profile.groupBy(*key).agg(F.min(F.struct("id", "th")).alias("row"), F.count("*").alias("copies"), F.first("phrases").alias("phrases"))
    texts = stored(texts.select("row.id", "row.th", *key, "copies", "phrases"))
    seen = texts.select("id", "th", *key, F.explode("phrases").alias("h"))
    often = stored(seen.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").withColumn("rows", F.col("n")))
    wanted = skew_join(seen, often, "h", "rows").groupBy("id", "th", *key).agg(F.collect_set(F.struct("h", "n")).alias("phrases"))
    wanted = wanted.groupBy("id", "th").agg(F.collect_list(F.struct(*key, "phrases")).alias("wanted"))
    fields = "k1 long, k2 long, h long, n long, at int, windows int, words binary, w1 long, w2 long"
    pieces = stored(able.join(wanted, ["id", "th"]).select("text", "wanted").mapInArrow(_segments(length), fields))

    groups = pieces.filter("h is not null").select("h", F.struct(*key, "at", "windows", "words").alias("p"))
    groups = groups.groupBy("h").agg(F.collect_list("p").alias("g")).filter(F.size("g") > 1)  # GROUP segments at most
    found = groups.select("g").mapInArrow(_trees(length), "k1 long, k2 long, lo int, hi int")

    salts = F.ceil(F.col("n") / SALTED).cast("int")
    whole = pieces.filter("w1 is not null").select(*key, "at", "w1", "w2", "n")
    deep = whole.groupBy("w1", "w2").agg(F.count("*").alias("leaves"), F.max("n").alias("n")).filter("leaves > 1")
    deep = deep.select("w1", "w2", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    leaves = whole.select(*key, "at", "w1", "w2", F.pmod(F.xxhash64(*key), salts).cast("int").alias("salt")).join(deep, ["w1", "w2", "salt"])
    found = found.unionByName(leaves.select(*key, F.col("at").alias("lo"), (F.col("at") + length).alias("hi")))

    ranges = found.groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    alone = texts.filter("copies = 1").select("id", "th", *key, "copies").join(ranges, key).select("id", "th", F.struct(*key, "copies", "ranges").alias("m"))
    several = texts.filter("copies > 1").select(*key, "copies")
    copies = profile.select("id", "th", *key).join(several, key).select("id", "th", F.struct(*key, "copies", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges")).alias("m"))
    return alone.unionByName(copies.groupBy("id", "th").agg(F.first("m").alias("m"))).groupBy("id", "th").agg(F.collect_list("m").alias("marks"))


def dedup_substrings(docs: DataFrame, length: int = 35) -> DataFrame:
    """Columns of ``docs`` (doc_id, text) but ``text``, and n_words, n_removed, kept_text, kept_sha256."""
    from pyspark.sql.types import StructField, StructType

    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id")).select("rest", "text", *_row_key(length))
    marks = _marks(rows.select("id", "th", "text"), length)
    out = rows.join(marks, ["id", "th"], "left").select("rest", "text", "marks")
    added = StructType.fromDDL("n_words long, n_removed long, kept_text string, kept_sha256 string")
    schema = StructType([StructField("rest", out.schema["rest"].dataType), *added.fields])
    return named_results(out.mapInArrow(_kept(length), schema), added.names)
