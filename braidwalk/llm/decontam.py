"""Benchmark decontamination by latent semantic retrieval, then longest common subsequence and answer checks.

The benchmark's texts are cut into passages of at most ``PASSAGE`` words, taken ``QUERIES`` at a time.  Their TF-IDF
matrices (document frequencies counted over all documents, one pass) are reduced from the vocabulary to at most ``LATENT``
dimensions by a randomised SVD: sums of A'(A X) over distributed rows, a few power steps, and the Gram matrix of the
projected rows.  A second pass searches up to ``SPACES`` such latent spaces at once: a document is cut into blocks of
``BLOCK`` words; at each block windows of 2, 3 and 5 blocks start, and each passage meets the windows that hold it whole
at any offset.  Windows are folded into the latent space; those with cosine >= ``COSINE`` to a passage are candidates.

A candidate is a leak if the longest common subsequence of passage and window (a block wider on both sides) covers
``COPY`` of the passage's words (``LONG_COPY`` where it has ``LONG`` words or more), or ``PARAPHRASE`` of them while the
answer - the item's last sentence - is covered by ``ANSWER`` too (a passage without words of the answer needs the former).
Passages under ``LEAST`` words say too little for that: they leak where they stand word for word.

Words are lower-case runs of letters and digits.  The vocabulary and the passages of the benchmark are held whole, the
latent spaces ``SPACES`` at a time (a pass each), so nothing held grows with the documents; documents meet them a stretch of ``STRETCH`` words at a time, which overlap by
the widest window, so long texts need no more memory.  Null texts have no words and no leaks; an empty benchmark or table
gives an empty result; repeated rows of documents give repeated results, null ids stay null; items that repeat an id and
text count once.  Of several leaks of an item in a text the best stays: by share, then cosine, then the first.  Columns of
the input pass through, but those with the name of a result give way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named_results, packed, stored, unpacked

WORD, SENTENCE = re.compile(r"\w+"), re.compile(r"[^.!?\n]+")
PASSAGE, BLOCK, LEAST, STRETCH = 64, 16, 5, 8192
QUERIES, SPACES = 256, 16
LATENT, OVERSAMPLE, POWER = 256, 8, 3
DENSE = 96
COSINE, COPY, PARAPHRASE, ANSWER = 0.6, 0.75, 0.5, 0.5
LONG, LONG_COPY = 16, 0.5
#: Blocks of a window: a passage of up to 17, 33 or 65 words lies whole in some window of so many blocks.
SCALES = (2, 3, 5)
#: Latin-1 bytes to lower-case word characters or spaces.
_LATIN = bytes(ord(chr(i).lower()) if WORD.match(chr(i)) else 32 for i in range(256))


def words_of(text: str) -> list[str]:
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        m = where.get(x)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def passages_of(text: str) -> list[tuple[list[str], list[str]]]:
    """(words, words of the answer in it) of each passage of an item."""
    words = words_of(text)
    if not words:
        return []
    ends = [s for s in map(words_of, SENTENCE.findall(text)) if len(s) >= 3]
    last = len(ends[-1]) if len(ends) > 1 else (len(words) + 2) // 3
    from_ = len(words) - last
    n = -(-len(words) // PASSAGE)
    cuts = [len(words) * k // n for k in range(n + 1)]
    return [(words[a:b], words[max(a, from_) : b]) for a, b in zip(cuts, cuts[1:])]


class Queries:
    """All passages of the benchmark, their words by number (from 1; 0: no word of these)."""

    def __init__(self, rows: Iterator[tuple[int, str]]):
        self.items, self.words, self.answers = [], [], []
        self.number: dict[str, int] = {}
        for item, text in rows:
            for words, answer in passages_of(text):
                self.items.append(item)
                self.words.append([self.number.setdefault(w, len(self.number) + 1) for w in words])
                self.answers.append([self.number[w] for w in answer])
        self.short = [(i, np.array(w)) for i, w in enumerate(self.words) if len(w) < LEAST]
        long_ = [i for i, w in enumerate(self.words) if len(w) >= LEAST]
        self.parts = [long_[lo : lo + QUERIES] for lo in range(0, len(long_), QUERIES)]


class Space:
    """The latent space of some passages: their own vocabulary, and after ``place`` weights and latent passages."""

    def __init__(self, q: Queries, members: list[int], counts: np.ndarray):
        self.words = [np.array(q.words[i]) for i in members]
        self.members, self.size = np.array(members), len(q.number) + 1
        terms = np.unique(np.concatenate(self.words))
        self.terms, self.idf = terms, np.log((counts[0] + 1) / (counts[terms] + 1)) + 1e-3
        self.rows = [np.searchsorted(terms, w).tolist() for w in self.words]

    def place(self, directions: np.ndarray) -> None:
        weights = np.zeros((len(self.terms) + 1, directions.shape[1]), np.float32)
        weights[1:] = self.idf[:, None] * directions
        self.local = np.zeros(self.size, np.int32)
        self.local[self.terms] = 1 + np.arange(len(self.terms))
        top = np.argsort(self.idf, kind="stable")[:DENSE]
        self.rank = np.full(len(weights), -1)
        self.rank[1 + top] = np.arange(len(top))
        self.dense = np.zeros((DENSE, directions.shape[1]), np.float32)
        self.dense[: len(top)] = weights[1 + top]
        scale = np.array([next(s for s in SCALES if len(w) <= (s - 1) * BLOCK + 1) for w in self.words])
        latent = np.array([weights[self.local[w]].sum(axis=0) for w in self.words])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        self.weights = weights
        self.groups = [(s, self.members[scale == s], np.ascontiguousarray(latent[scale == s].T)) for s in SCALES if (scale == s).any()]

    def candidates(self, flat: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(first block, blocks, passage, cosine) of windows near a passage; ``flat``: word numbers, whole blocks."""
        ids = self.local[flat]
        known = np.flatnonzero(ids)
        if not len(known):
            return
        blocks = np.zeros((len(flat) // BLOCK, self.weights.shape[1]), np.float32)
        # terms that documents use most are counted by block and multiplied; the others' rows are gathered
        b, rank = known // BLOCK, self.rank[ids[known]]
        often = rank >= 0
        counts = np.bincount(b[often] * DENSE + rank[often], minlength=len(blocks) * DENSE).reshape(-1, DENSE)
        np.matmul(counts.astype(np.float32), self.dense, out=blocks)
        known, b = known[~often], b[~often]
        if len(known):
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            blocks[b[first]] += np.add.reduceat(self.weights[ids[known]], first, axis=0)
        window, width = blocks, 1
        for scale, members, latent in self.groups:  # by growing scale
            n = len(blocks) - scale + 1
            window = window[:n].copy()
            for k in range(width, scale):
                window += blocks[k : k + n]
            width = scale
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-6)
            cosine = window @ latent / norm[:, None]
            for w, j in zip(*np.nonzero(cosine >= COSINE)):
                yield int(w), scale, int(members[j]), float(cosine[w, j])


def _frequencies(number: dict[str, int]):
    """Number of documents with each word, and of documents (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, docs = number.keys(), np.zeros(len(number) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total[[number[w] for w in known & set(words_of(text.as_py() or ""))]] += 1
                docs += 1
        total[0] = docs
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["t", "n"])

    return run


def _row_sums(idf: list[np.ndarray], x: list[np.ndarray], gram: bool):
    """By space, sums over rows of A'(A x), or of (A x)'(A x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, c = np.unique(np.array(ids), return_counts=True)
                a = c * idf[k][t]
                y = a @ x[k][t]
                if k not in total:
                    total[k] = np.zeros((len(y), len(y)) if gram else x[k].shape)
                if gram:
                    total[k] += np.outer(y, y)
                else:
                    total[k][t] += np.outer(a, y)
        for k, m in total.items():
            used = np.flatnonzero(m.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(used)), pa.array(used), pa.array(m[used].tolist(), pa.list_(pa.float64()))], ["k", "r", "x"])

    return run


def randomised_svd(rows: DataFrame, idf: list[np.ndarray], rank: int = LATENT) -> list[np.ndarray]:
    """By space, the leading right singular vectors (terms x rank) of the TF-IDF rows (k, ids: array of term numbers)."""

    def summed(x: list[np.ndarray], gram: bool) -> list[np.ndarray]:
        out = [np.zeros((m.shape[1] if gram else len(m), m.shape[1])) for m in x]
        for k, r, v in rows.select("k", "ids").mapInArrow(_row_sums(idf, x, gram), "k long, r long, x array<double>").collect():
            out[k][r] += v  # a task returns a row a term of its passages: PASSAGE * QUERIES rows a space at most
        return out

    rng = np.random.default_rng(0)
    x = [np.linalg.qr(rng.standard_normal((len(w), min(rank + OVERSAMPLE, len(w)))))[0] for w in idf]
    for _ in range(POWER):
        x = [np.linalg.qr(m)[0] for m in summed(x, False)]
    return [(a @ np.linalg.eigh(g)[1][:, ::-1])[:, :rank] for a, g in zip(x, summed(x, True))]


def _is_leak(share: float, told: float, n: int) -> bool:
    return share >= COPY or n >= LONG and share >= LONG_COPY or share >= PARAPHRASE and told >= ANSWER


def leaks_of(parts: list[tuple[int, int, list[int]]], q: Queries, spaces: list[Space]) -> dict[tuple[int, int], tuple]:
    """Best leak (share, cosine, -first word, share of the answer) by (text, item); ``parts``: (text, its first word, word numbers)."""
    pad = SCALES[-1] * BLOCK
    starts, at = [], 0
    for _, _, ids in parts:
        starts.append(at)
        at += -(-len(ids) // BLOCK) * BLOCK + pad
    flat = np.zeros(at + pad, np.int64)
    for (_, _, ids), s in zip(parts, starts):
        flat[s : s + len(ids)] = ids
    best: dict[tuple[int, int], tuple] = {}
    starts_ = np.array(starts)

    def part_at(word: int) -> int:
        return int(np.searchsorted(starts_, word, side="right")) - 1

    def add(t: int, item: int, row: tuple) -> None:
        if row > best.get((parts[t][0], item), ()):
            best[parts[t][0], item] = row

    for p, words in q.short:
        hit = np.flatnonzero(flat == words[0])
        for k, w in enumerate(words[1:], 1):
            hit = hit[flat[hit + k] == w]
        for h in hit.tolist():
            t = part_at(h)
            add(t, q.items[p], (1.0, 1.0, -(parts[t][1] + h - starts[t]), 1.0))
    for space in spaces:
        for block, scale, p, cosine in space.candidates(flat):
            t = part_at(block * BLOCK)
            lo = max(0, block * BLOCK - starts[t] - BLOCK)
            words = parts[t][2][lo : lo + (scale + 2) * BLOCK]
            mine, answer = q.words[p], q.answers[p]
            share = lcs(mine, words) / len(mine)
            if share < PARAPHRASE:
                continue
            told = lcs(answer, words) / len(answer) if answer else 0.0
            if _is_leak(share, told, len(mine)):
                add(t, q.items[p], (share, cosine, -(parts[t][1] + lo), told))
    return best


LEAKS = "array<struct<item_id:long,cosine:double,lcs_share:double,answer_share:double,first_word:long>>"


def _search(q: Queries, spaces: list[Space]):
    fields = [("item_id", pa.int64()), *((c, pa.float64()) for c in ("cosine", "lcs_share", "answer_share")), ("first_word", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, get = pa.list_(pa.struct(fields)), q.number.get
        step = STRETCH - (SCALES[-1] + 2) * BLOCK  # stretches overlap by the widest window and its margins
        names = ["rest", "text", "leaks"]
        for batch in batches:
            found: dict[tuple[int, int], tuple] = {}
            for i, before in enumerate(batch.column("leaks").to_pylist()):  # of spaces before
                found |= {(i, x["item_id"]): (x["lcs_share"], x["cosine"], -x["first_word"], x["answer_share"]) for x in before}
            parts, size = [], 0

            def meet() -> None:
                nonlocal parts, size
                for key, row in leaks_of(parts, q, spaces).items():
                    found[key] = max(found.get(key, ()), row)
                parts, size = [], 0

            for i, text in enumerate(batch.column("text")):
                ids = [get(w, 0) for w in words_of(text.as_py() or "")]
                for lo in range(0, max(1, len(ids) - STRETCH + step), step):
                    parts.append((i, lo, ids[lo : lo + STRETCH]))
                    size += len(parts[-1][2]) + SCALES[-1] * BLOCK
                    if size > 2 * STRETCH:
                        meet()
            meet()
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for (i, item), (share, cosine, first, told) in sorted(found.items()):
                out[i].append({"item_id": item, "cosine": cosine, "lcs_share": share, "answer_share": told, "first_word": -first})
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("text"), pa.array(out, kind)], names)

    return run


def frequencies(docs: DataFrame, number: dict[str, int]) -> np.ndarray:
    """Number of documents with each word, and of all (0), over all of ``docs`` (text)."""
    shared, counts = docs.sparkSession.sparkContext.broadcast(number), np.zeros(len(number) + 1)

    def count(batches):
        yield from _frequencies(shared.value)(batches)

    for t, n in docs.filter("text is not null").select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n")).collect():
        counts[t] = n  # an entry a word of the benchmark
    return counts


def spaces_of(spark, q: Queries, counts: np.ndarray, parts: list[list[int]]) -> list[Space]:
    spaces = [Space(q, members, counts) for members in parts]
    rows = stored(spark.createDataFrame([(k, r) for k, s in enumerate(spaces) for r in s.rows], "k long, ids array<int>"))
    for space, directions in zip(spaces, randomised_svd(rows, [s.idf for s in spaces])):
        space.place(directions)
    return spaces


def _searched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Packed rows of ``docs`` with leaks."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct().orderBy("item_id", "text")
    q = Queries((r["item_id"], r["text"]) for r in items.toLocalIterator())
    out = packed(docs).withColumn("leaks", F.array().cast(LEAKS))
    if q.items:
        counts = frequencies(out, q.number)
        for lo in range(0, max(1, len(q.parts)), SPACES):
            parts = q.parts[lo : lo + SPACES]
            shared = spark.sparkContext.broadcast((q, spaces_of(spark, q, counts, parts) if parts else []))  # bounded, see above

            def run(batches, shared=shared):
                yield from _search(*shared.value)(batches)

            out = out.mapInArrow(run, out.schema)
    return out


def search_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns of ``docs``, and leaks (an array, a struct an item): no shuffle, so rows need no key."""
    return named_results(_searched(docs, benchmark), ["text", "leaks"])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without leaks, whatever their ids."""
    return unpacked(_searched(docs, benchmark).filter(F.size("leaks") == 0), docs)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, first_word) of each document's leaks of each item."""
    found = search_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark).select("doc_id", F.explode("leaks").alias("l"))
    return found.select("doc_id", "l.*")
