"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named further columns of `docs`."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it names none, only a local session gets one: its one machine sees every folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-leafwise-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """`name`, longer by as many underscores as it takes to be no column of `df`."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


#: Rows and bytes of `found` up to which marked() broadcasts it.
MARKED_ROWS, MARKED_BYTES = 200_000, 16 << 20


def marked(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """`docs` joined with `found` (doc_id, t, and further columns that `docs` does not have) on doc_id, null or not, and the text's hash t.

    Rows that share a doc_id and differ in text are so told apart. `found` is
    written first and counted: below MARKED_ROWS rows and MARKED_BYTES bytes it is
    broadcast and no text moves; beyond, the smaller side is hashed.
    """
    found = spool(found)
    long = sum((F.octet_length(F.to_json(F.struct(c))) for c in found.columns if c not in ("doc_id", "t")), F.lit(16))
    rows, size = found.agg(F.count("*"), F.coalesce(F.sum(long), F.lit(0))).first()
    kind = "broadcast" if rows <= MARKED_ROWS and size <= MARKED_BYTES else "shuffle_hash"
    right = found.withColumnsRenamed({"doc_id": "found_doc_id", "t": "found_t"}).alias("found").hint(kind)
    left = docs.alias("docs")
    met = left.join(right, F.col("docs.doc_id").eqNullSafe(F.col("found.found_doc_id")) & (text_hash(F.col("docs.text")) == F.col("found.found_t")), how)
    if how in ("left_semi", "left_anti"):
        return met
    return met.select("docs.*", *[F.col(f"found.{c}") for c in found.columns if c not in ("doc_id", "t")])


def text_hash(text) -> Column:
    """A 64-bit hash of a text (null: of the empty one)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Spark's setting for the rows that go to Python at once, and its value within scratch(): whole texts are long rows.
BATCH_ROWS, FEW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
#: Spark's setting by which shuffle files go with their query.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that the innermost scratch() has to take away; None outside of any.
_written: list[str] | None = None


def remove(spark: SparkSession, path: str) -> None:
    """Take away a folder of any store that Spark can open."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def few_rows(spark: SparkSession) -> None:
    """From now on the session hands fewer rows to Python at once, for work on whole texts."""
    spark.conf.set(BATCH_ROWS, FEW_ROWS)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What spool() writes within is taken away at the end: nothing that is read later may come from it.

    Within, Spark drops the shuffle files of each query when it has ended, as
    what is needed of it has been written.
    """
    global _written
    outer, _written = _written, []
    before = {k: spark.conf.get(k, v) for k, v in ((DROP_SHUFFLES, "false"), (BATCH_ROWS, "10000"))}
    spark.conf.set(DROP_SHUFFLES, "true")
    spark.conf.set(BATCH_ROWS, FEW_ROWS)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for path in _written:
            remove(spark, path)
        _written = outer


def spool(df: DataFrame, *, codec: str = "zstd") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs the re-reading of files that
    every machine sees, never the work before. Files stay until the scratch()
    around ends; outside of one they stay, as the caller may read them at any time.
    """
    path = f"{shared_dir(df.sparkSession)}/leafwise-{uuid.uuid4().hex}"
    if _written is not None:
        _written.append(path)
    df.write.option("compression", codec).parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.spooled_at = path
    return read


def forget(df: DataFrame) -> None:
    """Take away what spool() has written of `df`, when nothing is to read it any more."""
    remove(df.sparkSession, df.spooled_at)


def kept_from(spark: SparkSession, made: Callable[[], DataFrame]) -> DataFrame:
    """The rows of made(), written; all that it spooled on the way is taken away."""
    path = f"{shared_dir(spark)}/leafwise-{uuid.uuid4().hex}"
    with scratch(spark):
        out = made()
        out.write.option("compression", "zstd").parquet(path)
    if _written is not None:
        _written.append(path)
    return spark.read.schema(out.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes in `column` (a longer row stays whole)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


#: What this Python worker keeps for its later tasks: one thing, by what made it.
_held: dict[tuple, object] = {}


def held(make: Callable, *args):
    """make(*args), kept in this Python worker for the tasks that ask for the same next; what it kept before is let go."""
    key = (make, *args)
    if key not in _held:
        let_go()
        _held[key] = make(*args)
        give_back()
    return _held[key]


def let_go() -> None:
    """Drop what held() keeps. Python workers outlive the stages of a pipeline, so tasks of other work begin with this."""
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Hand the memory that nothing uses any more back to the machine, Arrow's and the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def map_texts(docs: DataFrame, per_text: Callable[[], Callable[[str], tuple]], schema: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, *values) for every row of (key, text).

    `per_text()` is called once in each task and gives the function of a text;
    the schema names the key first, then the values.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = per_text()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [judge(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column(key), *(pa.array(c) for c in zip(*made, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, "text").mapInArrow(run, schema)
