"""Toxicity: a logistic regression on words and word beginnings, regularised by counterfactual swaps.

Features of a text are the distinct lower-case words (runs of letters) and their first 4, 5 and 6 letters.  First every
sentence of a training row that names an identity group is paired with the same sentence naming another group of its
list, or none.  Then features are selected: those with clear evidence for the positive class (lower bound of the log-odds), and all
in which the two sentences of a pair differ, so identity terms have weights whatever they look like.  Weights are fitted
by full-batch gradient steps on the log-loss, an L2 term, and the counterfactual term: the squared change of the logit
between the sentences of a pair, so a mention alone moves no score.

Training uses at most about ``ROWS`` labelled rows a class, drawn by a hash (the documented bound of the fit), and fewer
where they hold more than ``CHARS`` characters; every text is scored whole, in one pass.  Null texts count as empty: they get the score of a text without evidence.  Rows without a label, null labels
and repeated labels are tolerated (a repeated id counts once, its highest label); features of equal evidence rank by name;
repeated rows get equal scores; without any labelled row every score is 0; an empty table gives an empty result.  Columns
of the input pass through, but those with the name of a result give way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text, stored

ROWS, FEATURES, CHARS = 6000, 5000, 1 << 26
EVIDENCE, Z = 1.5, 1.64
L2, COUNTERFACTUAL = 5e-5, 5.0
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
BEGINNINGS = (4, 5, 6)

#: Lists within which terms are swapped.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("schwul", "lesbisch", "hetero"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos"),
)


def features(words: set[str]) -> set[str]:
    return words | {f"{w[:k]}*" for w in words for k in BEGINNINGS if len(w) >= k}


def counterfactuals(text: str, lists: tuple[tuple[str, ...], ...] = IDENTITY) -> list[tuple[list[str], list[str]]]:
    """For each sentence that names a group and each other group of its list, and none: (features lost, features gained)."""
    group = {t: g for g in lists for t in g}
    text = text.lower()
    if not any(t in text for t in group):
        return []
    out = []
    for s in SENTENCE.findall(text):
        words = WORD.findall(s)
        for t in dict.fromkeys(w for w in words if w in group):
            mine = features(set(words))
            for other in (*group[t], None):
                if other != t:
                    swapped = features({other if w == t else w for w in words if w != t or other})
                    out.append((sorted(mine - swapped), sorted(swapped - mine)))
    return out


def _drawn(rows: DataFrame, hashed: Column, most: int) -> DataFrame:
    """About ``most`` rows of each class ``y``, by a hash."""
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    drawn = [(F.col("y") == k) & (share < min(1.0, most / c)) for k, c in n.items()]
    return rows.filter(F.greatest(F.lit(False), *drawn)) if drawn else rows


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(text, y): a bounded sample of the labelled rows, by class."""
    y = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    ids = _drawn(y, F.xxhash64("doc_id", F.lit(7)), rows)  # a row an id, so about ``rows`` a class
    found = stored(docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y").withColumn("u", F.monotonically_increasing_id()))
    found = _drawn(found, F.xxhash64("u", F.lit(8)), rows)  # ids may repeat
    size = found.agg(F.sum(F.length("text"))).first()[0] or 0
    few = F.pmod(F.xxhash64("u", F.lit(9)), F.lit(1 << 30)) / float(1 << 30) < CHARS / max(size, 1)
    return (found.filter(few) if size > CHARS else found).select("text", "y")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pos, neg = Counter(), Counter()

    def out():
        keys = list(pos.keys() | neg.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["f", "pos", "neg"])

    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("y")):
            (pos if y.as_py() else neg).update(features(set(WORD.findall(text.as_py().lower()))))
        if len(pos) + len(neg) > 500_000:
            yield out()
            pos.clear(), neg.clear()
    yield out()


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.weight = {f: float(w) for f, w in zip(names, weights) if w}
        self.bias = bias
        self.known: dict[str, tuple[str, ...]] = {}

    def hits(self, word: str) -> tuple[str, ...]:
        out = tuple(f for f in features({word}) if f in self.weight)
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = out
        return out

    def score(self, text: str) -> float:
        found: set[str] = set()
        get, hits = self.known.get, self.hits
        for w in set(WORD.findall(text.lower())):
            h = get(w)
            if h is None:
                h = hits(w)
            if h:
                found.update(h)
        x = self.bias + sum(self.weight[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def fit(rows: list[tuple[int, list[int]]], pairs: list[tuple[list[int], list[int]]], n: int, steps: int = 400, weight: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, feature numbers) and counterfactual pairs of feature numbers."""
    y = np.array([r[0] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    ft = np.array([f for r in rows for f in r[1]], np.int64)
    pa_, pf, sign = [], [], []
    for k, (lost, gained) in enumerate(pairs):
        pa_ += [k] * (len(lost) + len(gained))
        pf += lost + gained
        sign += [1.0] * len(lost) + [-1.0] * len(gained)
    pa_, pf, sign = np.array(pa_, np.int64), np.array(pf, np.int64), np.array(sign)
    w, b = np.zeros(n), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(at, w[ft], len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(ft, e[at], n) + L2 * w
        if len(pairs):
            d = np.bincount(pa_, sign * w[pf], len(pairs)) * (2 * weight / len(pairs))
            g += np.bincount(pf, sign * d[pa_], n)
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features in which the sentences of a pair differ."""
    for batch in batches:
        found = {f for text in batch.column("text") for pair in counterfactuals(text.as_py()) for side in pair for f in side}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["f"])


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, weight: float = COUNTERFACTUAL) -> Model | None:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic); the caller leaves held-out rows away."""
    sample = stored(training_rows(docs, labels, rows))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p, q = n.get(1, 0), n.get(0, 0)
    if not p + q:
        return None
    counted = sample.mapInArrow(_frequencies, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    odds = lambda c, t: F.log((F.col(c) + 0.5) / (t - F.col(c) + 0.5))
    spread = lambda c, t: 1 / (F.col(c) + 0.5) + 1 / (t - F.col(c) + 0.5)
    bound = odds("a", p) - odds("b", q) - Z * F.sqrt(spread("a", p) + spread("b", q))
    chosen = counted.withColumn("bound", bound).filter(F.col("bound") >= EVIDENCE).orderBy(F.desc("bound"), "f").limit(FEATURES)
    names = [r["f"] for r in chosen.select("f").collect()]
    paired = sample.mapInArrow(_differences, "f string").distinct().orderBy("f").collect()  # of the identity lists: a few hundred
    names += sorted({r["f"] for r in paired} - set(names))
    number = {f: i for i, f in enumerate(names)}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                own = sorted(number[f] for f in features(set(WORD.findall(text.lower()))) if f in number)
                swaps = sorted({(tuple(number[f] for f in a), tuple(number[f] for f in b)) for a, b in counterfactuals(text)})
                out.append((y, own, [list(s[0]) for s in swaps], [list(s[1]) for s in swaps]))
            many = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.list_(pa.int32()), many, many])], ["y", "own", "lost", "gained"])

    rows_ = sample.mapInArrow(encoded, "y int, own array<int>, lost array<array<int>>, gained array<array<int>>").collect()  # bounded by rows
    rows_ = sorted((r["y"], list(r["own"]), [list(x) for x in r["lost"]], [list(x) for x in r["gained"]]) for r in rows_)
    pairs = [pair for _, _, lost, gained in rows_ for pair in zip(lost, gained)]
    w, b = fit([(y, own) for y, own, _, _ in rows_], pairs, len(names), weight=weight)
    return Model(names, w, b)


def score_documents(docs: DataFrame, model: Model | None, fields: tuple[str, str] = ("score", "predicted"), keep_text: bool = False) -> DataFrame:
    """Columns of ``docs`` but ``text`` (unless kept), and ``fields``: score, predicted; no shuffle."""

    def work():
        def one(text: str) -> tuple[float, int]:
            s = model.score(text) if model else 0.0
            return s, int(s >= 0.5)

        return one

    return each_text(docs, work, f"{fields[0]} double, {fields[1]} int", keep_text=keep_text)
