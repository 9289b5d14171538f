"""Daily refresh: a stream of arrivals keeps a table and the tables that depend on it up to date, partition by partition.

A ``VersionedTable`` never changes files that readers may hold. A batch writes the partitions it touches beside the old ones,
then a manifest that names the batch of every partition, and at last one small pointer file, renamed over the old one. A run
that dies before the rename has changed nothing, its batch comes again and overwrites what it had written; a batch that is
committed already is passed over. What a day costs depends on the days that arrived, not on the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = "none"


class VersionedTable:
    """A Parquet table in ``path`` whose partitions (values of the string column ``by``) are replaced batch by batch.

    data/<batch>/part=<value>: the rows of a partition as that batch wrote it; manifests/<batch>: value -> batch;
    current: the batch that readers follow. One stream writes a table: its batch numbers rise. Rows without ``by`` form a
    partition of their own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str) -> None:
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_file(self, name: str) -> str | None:
        files = self._system()
        if not files.exists(self._at(name)):
            return None
        stream = files.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_file(self, name: str, text: str) -> None:
        stream = self._system().create(self._at(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def state(self) -> tuple[int, dict[str, int]]:
        """The last committed batch (-1: none) and the batch of each partition."""
        at = self._read_file("current")
        return (-1, {}) if at is None else (int(at), json.loads(self._read_file(f"manifests/{at}")))

    def read(self, values: Iterable[str] | None = None) -> DataFrame:
        """The committed rows, of all partitions or of some; nothing else is listed or opened."""
        parts = self.state()[1]
        wanted = parts if values is None else sorted({*values} & {*parts})
        paths = [f"{self.path}/data/{parts[v]}/part={v}" for v in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write_version(self, batch: int, rows: DataFrame, values: Iterable[str]) -> None:
        """Write what ``values`` hold from now on, and the manifest; readers see nothing of it yet. A value without rows goes."""
        _, parts = self.state()
        out = rows.withColumn("part", F.coalesce(self.by, F.lit(NONE)))
        out.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/{batch}")
        for v in values:
            parts.pop(v, None)
            if self._system().exists(self._at(f"data/{batch}/part={v}")):
                parts[v] = batch
        self._write_file(f"manifests/{batch}", json.dumps(parts, sort_keys=True))

    def switch(self, batch: int) -> None:
        """Make ``batch`` what readers see, in one rename."""
        new = f"current-{uuid.uuid4().hex}"
        self._write_file(new, str(batch))
        overwrite = self.spark._sc._gateway.new_array(self._fs.Options.Rename, 1)
        overwrite[0] = self._fs.Options.Rename.OVERWRITE
        self._fs.FileContext.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._at(new), self._at("current"), overwrite)

    def replace(self, batch: int, rows: DataFrame, values: Iterable[str]) -> bool:
        """Replace the partitions ``values`` by ``rows``; False, and nothing happens, if the batch was committed before."""
        if batch <= self.state()[0]:
            return False
        self.write_version(batch, rows, values)
        self.switch(batch)
        return True

    def vacuum(self) -> list[int]:
        """Remove versions that the current manifest does not name, once no reader holds them; the batches removed."""
        at, parts = self.state()
        files, gone, data = self._system(), [], self._at("data")
        for s in files.listStatus(data) if files.exists(data) else ():
            batch = int(s.getPath().getName())
            if batch not in parts.values() and batch <= at:
                files.delete(s.getPath(), True)
                gone.append(batch)
        return sorted(gone)


@dataclass
class Dependent:
    """A table made of the base table's rows of one period: ``period`` gives a day's partition, ``build`` the rows."""

    table: VersionedTable
    period: Callable[[str], str]
    build: Callable[[DataFrame], DataFrame]


@dataclass
class DailyRefresh:
    """What ``foreachBatch`` calls: merge the arrivals into the base table, then rebuild the periods they fall in.

    The base table is partitioned by day. Of rows with the same ``keys`` that of the largest ``newest`` stays (of equals
    the largest row), whether it came in this batch or before. Late days are days like others.
    """

    base: VersionedTable
    keys: list[str]
    newest: str
    dependents: list[Dependent] = field(default_factory=list)

    def merged(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, self.newest)]
        last = rows.groupBy(*self.keys).agg(F.max(F.struct(self.newest, *rest)).alias("last"))
        return last.select(*self.keys, "last.*").select(*rows.columns)

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            days = sorted(r[0] for r in batch.select(F.coalesce(self.base.by, F.lit(NONE))).distinct().collect())
            if days and number > self.base.state()[0]:
                self.base.replace(number, self.merged(self.base.read(days).unionByName(batch)), days)
        finally:
            batch.unpersist()
        # a batch that comes again after a loss finds the base done, and what depends on it perhaps not
        for d in self.dependents:
            periods = sorted({d.period(x) for x in days})
            if periods and number > d.table.state()[0]:
                source = self.base.read(x for x in self.base.state()[1] if d.period(x) in periods)
                d.table.replace(number, d.build(source), periods)


def drain(stream: DataFrame, into: Callable[[DataFrame, int], None], state: str) -> None:
    """Process all that has arrived in ``stream`` since the last call with the same ``state`` folder."""
    stream.writeStream.foreachBatch(into).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
