"""Near copies of the pipeline against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from braidwalk.llm import nearcopies


def shingles(text):
    w = text.encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def made_rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(600)]
    rows = []
    for _ in range(30):
        text = [rng.choice(vocab) for _ in range(rng.choice([60, 150, 400]))]
        rows.append(text)
        for changes in (2, 8, 30):  # similarities from near 1 to far below 0.8; chains, as each copy is of the one before
            text = list(text)
            for at in rng.sample(range(len(text)), max(1, changes * len(text) // 400)):
                text[at] = rng.choice(vocab)
            rows.append(text)
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, ""), (902, "a b"), (903, "A  b")]


def test_groups_against_brute_force(spark):
    rows = made_rows()
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if j < i and similar(a or "", b or ""):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert kept == {find(i) for i, _ in rows}
    assert 32 < len(kept) < 110


def test_null_and_repeated_ids(spark):
    """Texts near to none stay, whatever their ids; of copies one row stays."""
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (7, "m n o p q r"), (7, "s t u v w x"), (3, "1 2 3 4 5 6"), (3, "1 2 3 4 5 6"), (None, "1 2 3 4 5 6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, rows[:5]))


@pytest.mark.parametrize("chunk", [1 << 18, 500])
def test_links_past_the_centre(spark, monkeypatch, chunk):
    """All texts in one bucket, whose centre is near to few: the others still link."""
    monkeypatch.setattr(nearcopies, "CHUNK", chunk)
    rows = made_rows()[:8] + [(100 + i, f"x{i} y z w v u t s") for i in range(20)]
    monkeypatch.setattr(nearcopies, "sketch", lambda text: nearcopies_sketch(text)[:2] + ([1],))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r["doc_id"]: r["_root"] for r in nearcopies.near_copy_rows(docs)[1].collect()}
    text = dict(rows)
    assert all(root[i] == root[j] for i in text for j in text if similar(text[i], text[j]))
    assert len({root[100 + i] for i in range(20)}) == 20


nearcopies_sketch = nearcopies.sketch
