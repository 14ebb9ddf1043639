"""The corpus pipeline on a small fixture, stage by stage."""

import random

import public_tokenizers

import corpus_pipeline
from braidwalk.llm import bpe, secrets


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(600)]
    made = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, made(80), "en", "s", 1) for i in range(120)]
    toxic = {i for i in range(120) if i % 4 == 0}
    rows = [(i, t.replace(" ", " scumbag ", 1) + " scumbag" if i in toxic else t, *r) for i, t, *r in rows]
    item = made(30)
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[2][1] + " x", "en", None, None), (202, f"{made(40)} {item} {made(40)}", None, "s", 1)]
    rows += [(203, f'{made(30)} token = "0123456789abcdef0123456789abcdef" end', "en", "s", 1), (204, None, "en", "s", None), (205, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.table(spark, tmp_path, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r["doc_id"] for r in docs.collect()})
    everyone = {r[0] for r in rows}
    assert everyone - kept[0] == toxic
    assert kept[0] - kept[1] == {200, 201, 205}  # a copy, a near copy, and of the two texts without words the later
    assert kept[1] - kept[2] == {202} and kept[3] == kept[2]
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: list(r["token_ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    text = {r[0]: r[1] for r in rows}
    assert got == {i: codec.encode(secrets.redacted(text[i] or "")) for i in kept[3]}


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, columns that clash with those inside the operators, empty tables."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    made = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, twin = made(30), made(50)
    rows = [(None, f"{made(20)} {item}"), (None, made(60)), (None, None), (3, f"{item} {made(20)}"), (3, made(60)), (4, twin), (4, twin), (5, "")]
    rows += [(None, made(40) + ' token = "0123456789abcdef0123456789abcdef"')]
    schema = "doc_id long, text string, score double, predicted int, rest int, _row int, leaks int, Redacted int, n_tokens int, `a-b` int"
    docs = spark.createDataFrame([(*r, 0.5, *range(7)) for r in rows], schema).repartition(2)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.dtypes == docs.dtypes, name
        out[name] = sorted(str((r["doc_id"], r["text"])) for r in got.collect())
        assert all(tuple(r)[2:] == (0.5, *range(7)) for r in got.collect()), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    everything = sorted(map(str, rows))
    assert out["toxicity"] == everything
    assert len(out["simhash_near_dedup"]) == len(rows) - 2  # a copy, and one of the two without words
    assert out["decontaminate"] == sorted(str(r) for r in rows if item not in (r[1] or ""))
    assert len(out["secret_scan"]) == len(rows) and not any("0123456789abcdef" in x for x in out["secret_scan"])
    encoded = corpus_pipeline.bpe_encode(spark, docs, str(tmp_path))
    assert encoded.count() == len(rows) and encoded.columns.count("n_tokens") == 1
