"""Alignment lines as a stream: accepted and parsed as they arrive, equal lines once."""

from braidwalk.streaming.alignments import accepted_lines


def line(k, quality=60, cs=":20*ag:5"):
    return "\t".join([f"r{k}", "26", "0", "26", "+", ">1<2", "30", "0", "26", "26", "26", str(quality), "a", "b", f"cs:Z:{cs}", "dv:f:0.1"])


def test_accepted_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gaf").write_text("\n".join([line(1), line(2), line(1), line(3, quality=0), "broken"]) + "\n")
    q = accepted_lines(spark, f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    (tmp_path / "in" / "b.gaf").write_text("\n".join([line(2), line(4)]) + "\n")
    q = accepted_lines(spark, f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["read"] for r in got) == ["r1", "r2", "r4"]
    assert [(n["id"], n["fwd"]) for n in got[0]["nodes"]] == [(1, True), (2, False)] and sum(x["n"] for x in got[0]["cs"]) == 26
