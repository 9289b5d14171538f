"""Shared pieces: the scratch folder, word patterns and row counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Words as runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words as runs of a-z, 0-9 and everything beyond ASCII, after A-Z is lower-cased.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Spark's setting that removes the shuffles of a query once it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; letters beyond ASCII stay."""
    return F.translate(c, _UPPER, _LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, one of our own, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/emberline/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that is put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and the rows outlive lost executors.

    Once the table is written, the shuffles that led to it are of no more use and go.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``keep`` that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == "emberline":
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(rows: int, per_part: int, least: int = 8) -> int:
    """Number of partitions or buckets that grows with the rows."""
    return max(least, -(-rows // per_part))


def join_counted(rows: DataFrame, lookup: DataFrame, key: str, n: str, total: int, hot: int = 1_000) -> DataFrame:
    """``rows`` with the row of ``lookup`` that has their ``key``; ``lookup`` holds each key once and ``n``, how many of the ``total`` rows have it.

    Fewer than ``hot`` keys can each hold more than one in ``hot`` of all rows: they are broadcast. The others meet by a
    shuffle in which no key holds more than that share. Null keys and keys without a row of ``lookup`` give no row.
    """
    often = F.col(n) > F.lit(total / hot)
    common, rare = F.broadcast(lookup.filter(often).drop(n)), lookup.filter(~often).drop(n)
    return rows.join(common, key).unionByName(rows.join(common.select(key), key, "left_anti").join(rare, key))


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if a column has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def judged(docs: DataFrame, columns: list[str], made: str, setup: Callable[[], Callable[[list], tuple[list, ...]]], text: str = "text") -> DataFrame:
    """``columns`` of each row beside the columns ``made`` (a DDL schema) that Python gives for its text.

    Once a task, ``setup()`` returns a function from a list of texts to one list a column. The other columns pass as Arrow
    arrays, so ids of any size, nulls and types stay as they are.
    """
    new = StructType.fromDDL(made)
    types = [(f.name, to_arrow_type(f.dataType)) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = setup()
        for batch in batches:
            kept = batch.columns[:-1]
            lists = judge(batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, (_, t) in zip(lists, types))], names=[*columns, *(n for n, _ in types)])

    schema = StructType([*(docs.schema[c] for c in columns), *new.fields])
    return small_batches(docs).select(*columns, F.col(text).alias(unused(docs, "text_"))).mapInArrow(run, schema)


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """Send ``rows`` rows at a time to Python: whole texts are long, and a worker should hold few of them.

    Spark reads this setting when the returned frame runs, so it stays set in the session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
