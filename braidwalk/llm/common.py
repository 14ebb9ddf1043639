"""What the operators of this subpackage share: reading, row-wise Arrow stages, checkpoints, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


#: Bytes of an Arrow batch sent to a task, so that long texts and nested rows stay in bounds.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by size; a smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """(rest: a struct of all columns but ``text``, text, more): names of ``docs`` cannot clash with those an operator uses."""
    bounded_batches(docs.sparkSession)
    rest = [quoted(c) for c in docs.columns if c.lower() != "text"] or [F.lit(None).cast("int").alias("none")]
    return docs.select(F.struct(*rest).alias("rest"), quoted("text").alias("text"), *more)


def unpacked(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again, in their order, from packed rows."""
    text = F.col("text") if text is None else text
    return rows.select(*[text.alias(c) if c.lower() == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def named_results(rows: DataFrame, results: list[str]) -> DataFrame:
    """Unpack ``rest``; a column of the input with the name of a result gives way to it."""
    taken = {r.lower() for r in results}
    names = [f.name for f in rows.schema["rest"].dataType.fields if f.name.lower() not in taken]
    return rows.select(*[F.col("rest")[n].alias(n) for n in names], *results)


def trim() -> None:
    """Give memory that a task has freed back to the system: workers live on, with all their stages' peaks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def hold() -> None:
    """Keep freed arrays of up to 8 MB for the next ones, not a page fault for every page of each; ``trim`` gives them back."""
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):
        pass  # not glibc


def each_text(rows: DataFrame, work: Callable[[], Callable[[str], tuple]], fields: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """What ``work()(text)`` returns for each whole text (null: empty) as columns, in place of ``text`` or beside it.

    ``work`` is called once per task and may hold bounded state.  Other columns of ``rows`` pass through; one with the
    name of a result (in any case of letters) gives way to it.
    """
    from pyspark.sql.types import StructType

    bounded_batches(rows.sparkSession)
    added = StructType.fromDDL(fields)
    taken = {f.name.lower() for f in added.fields} | (set() if keep_text else {text.lower()})
    keep = [f for f in rows.schema.fields if f.name.lower() not in taken]
    schema = StructType(keep + added.fields)
    extra = [f.name for f in added.fields]
    names = [f.name for f in keep]
    if text not in names:
        rows = rows.select(*map(quoted, names), quoted(text))
    else:
        rows = rows.select(*map(quoted, names))
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        one = work()
        types = [to_arrow_type(f.dataType) for f in added.fields]
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = [one(x.as_py() or "") for x in part.column(at)]
                cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + cols, names + extra)
        trim()

    return rows.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark.sparkContext, "_braidwalk_dir", None) or "file://" + tempfile.mkdtemp(prefix="braidwalk-")
        spark.sparkContext._braidwalk_dir = at
    return at


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a stored table that nothing lazy reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with over 1 / HOT of all rows is hot; there are fewer than HOT such keys, whatever the size of the table.
HOT = 1000


def skew_join(rows: DataFrame, by: DataFrame, key: str | list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with ``by`` (stored; one row a key, ``n``: the number of its rows), without its column ``n``.

    Hot keys are joined by a broadcast of their fewer than ``HOT`` rows of ``by``; all others by a shuffle.
    """
    total = by.agg(F.sum(n)).first()[0] or 0
    hot = by.filter(F.col(n) * HOT > total)
    plain = by.drop(n)
    if not hot.limit(1).count():
        return rows.join(plain, key)
    here = rows.join(F.broadcast(hot.drop(n)), key)
    rest = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(plain, key)
    return here.unionByName(rest)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the task's edges, in chunks: a spanning star forest (node, smallest node of its tree)."""
    parent: dict = {}

    def find(x):
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x], x = root, p
        return root

    def out():
        nodes = list(parent)
        roots = [find(x) for x in nodes]
        pairs = [(x, r) for x, r in zip(nodes, roots) if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent.setdefault(a, a), parent.setdefault(b, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield out()
            parent.clear()
    yield out()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b: long, not null) -> (node, component = smallest reachable node).

    Alternates large-star and small-star steps on tables in the shared folder until nothing changes; each task first
    shrinks its edges to a spanning forest.  Only counts come to the driver.  Nodes of no edge are not returned.
    A star's centre may have any number of neighbours: its minimum is a pre-aggregated ``min``, joined back by key.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = stored(e.mapInArrow(_forest, "a long, b long").distinct())
    for _ in range(rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large-star: every larger neighbour of a is linked to the smallest of a's neighbourhood
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small-star: every neighbour not larger than a, and a itself, is linked to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b")
        new = stored(small.mapInArrow(_forest, "a long, b long").distinct())
        stars = new.groupBy().agg(F.count("*").alias("n"), F.count_distinct("a").alias("k"))
        n, k = stars.first()
        # converged: every node has one parent and no parent has a parent
        done = n == k and new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi").limit(1).count() == 0
        dropped(e)
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
