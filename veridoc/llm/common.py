"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are maximal runs of anything but these characters.
BLANKS = r"[\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where driver and executors are
    one process (tests).  Elsewhere executors would each write to their own disk, so nothing is guessed."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = got.get() if got.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="veridoc-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/veridoc"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once to the shared folder and read again: later stages survive lost executors without redoing it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veridoc_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._veridoc_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for what is planned and run inside."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lean(run: Callable) -> Callable:
    """run for mapInArrow, giving memory back to the system when a task ends: a worker that waits keeps little."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in order."""
    return F.array_remove(F.split(text, BLANKS, -1), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts of ASCII alone take the fast way."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def pair_hashes(hashes: str, gap: int, size: Column) -> Column:
    """From hashes of windows of `gap` words those of windows of 2 * gap words (size: how many there are)."""
    n = F.greatest(size, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def unused(taken: Iterable[str], name: str) -> str:
    """name, with underscores before it until no column is called so (in any case)."""
    low = {t.lower() for t in taken}
    name = f"_{name}"
    while name.lower() in low:
        name = f"_{name}"
    return name


def without(docs: DataFrame, ids: DataFrame, inline: int = 1_000_000) -> DataFrame:
    """docs whose doc_id isn't among ids (doc_id: whole numbers of 8 bytes): broadcast up to `inline` ids, shuffled beyond."""
    out = written(ids.distinct(), "ids")
    return docs.join(F.broadcast(out) if out.count() <= inline else out, "doc_id", "left_anti").select(*docs.columns)
