"""Language identification by rank-order n-gram profiles.

A profile is the ``TOP`` most frequent letter n-grams (n = 1 to 3, lower case, word edges marked, none across words),
most frequent first, ties by code.  A text goes to the language whose profile has the least out-of-place distance: for
each n-gram of the text's own profile the difference of the two ranks, or ``TOP`` where the language lacks it.  The
score is 1 - least distance / second least (with one language: 1 - distance / largest possible).

Profiles are counted over all training rows, repeated ones as often as they stand.  A null text, or one without a letter,
is ``und`` with score 0; so is every text if there is nothing to learn from.  Ties go to the first language in alphabetical
order.  Whole texts are counted a stretch at a time; an empty table gives an empty result.  Columns of the input pass
through, but those with the name of a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each_text

TOP, UNKNOWN = 300, "und"
STRETCH, FLUSH = 1 << 20, 1 << 20
#: Stands for a word edge; no letter has this code point.
EDGE = 1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(stretch: str) -> np.ndarray:
    """Codes of all n-grams of a text that starts and ends at a word edge."""
    c = np.frombuffer(stretch.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    c[~letters()[c]] = EDGE
    c = np.concatenate([[EDGE], c, [EDGE]])
    c = c[np.concatenate([[True], (c[1:] != EDGE) | (c[:-1] != EDGE)])]
    two = c[:-1] << 21 | c[1:]
    inner = c[1:-1] != EDGE
    return np.concatenate([c[c != EDGE], two, (two[:-1][inner] << 21) | c[2:][inner]])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, counts) over a whole text."""
    if len(text) <= STRETCH:
        return np.unique(_codes(text), return_counts=True) if text else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    codes, counts, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while lo < len(text):
        hi = text.find(" ", lo + STRETCH)
        hi = len(text) if hi < 0 else hi
        codes, counts = _added(codes, counts, *np.unique(_codes(text[lo:hi]), return_counts=True))
        lo = hi
    return codes, counts


def _added(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n, m])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:TOP]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out():
        for lang, (codes, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])
        held.clear()

    for batch in batches:
        texts: dict[str, list[str]] = {}
        size = 0
        for i in range(batch.num_rows):
            lang, text = batch.column("lang")[i].as_py(), batch.column("text")[i].as_py()
            texts.setdefault(lang, []).append(text)
            size += len(text)
            if size > STRETCH or i == batch.num_rows - 1:
                for k, t in texts.items():
                    new = ngrams(" ".join(t))
                    held[k] = _added(*held[k], *new) if k in held else new
                texts, size = {}, 0
        if sum(len(c) for c, _ in held.values()) > FLUSH:
            yield from out()
    yield from out()


def learn_profiles(rows: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from all rows (text, lang) with both; ``TOP`` codes a language come to the driver."""
    counted = rows.select("text", "lang").filter("text is not null and lang is not null").mapInArrow(_count, "lang string, code long, n long")
    total = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    out: dict[str, list] = {}
    for lang, code, rank in best.select("lang", "code", "rank").collect():
        out.setdefault(lang, []).append((rank, code))
    return {lang: np.array([c for _, c in sorted(out[lang])], np.int64) for lang in sorted(out)}


class Classifier:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        own = ranked(*ngrams(text))
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at[self.codes[at] != own] = len(self.codes)
        r = self.ranks[at]
        d = np.where(r < 0, TOP, np.abs(r - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(d.argmin())
        other = min((int(x) for k, x in enumerate(d) if k != best), default=TOP * len(own))
        return self.langs[best], (1 - int(d[best]) / other) if other else 0.0


def predict_documents(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """Columns of ``docs`` but ``text``, and lang_pred, score; no shuffle."""

    def work():
        c = Classifier(profiles)
        return c.predict

    return each_text(docs, work, "lang_pred string, score double")
