"""Session defaults, durable intermediate results, and named timers."""

from __future__ import annotations

import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the launcher's settings hold."""
    return SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a new one of a local session's machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: a table of more bytes is read as its files are cut, and so is a part of fewer
DEALT_BYTES, DEALT_PART = 64 << 20, 256 << 10


def dealt(table: DataFrame) -> DataFrame:
    """A small table of fewer files than the session has cores, dealt to the cores before work that its rows blow up.

    A row group is one task's, and small files have one.  A table beyond ``DEALT_BYTES`` is left as it is:
    it has row groups enough, and is not worth a shuffle.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > DEALT_BYTES:
        return table
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = min(cores, size // DEALT_PART)
    return table.repartition(parts) if parts > 1 and len(table.inputFiles()) < cores else table


def settle(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` computed and kept in the shared folder, without its lineage; what it replaces in a loop is deleted."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    if instead_of is not None:
        release(instead_of)
    return out


def kept_in(settled: DataFrame) -> str | None:
    """The folder of a settled frame."""
    plan = settled._jdf.queryExecution().logical()
    if plan.nodeName() != "LogicalRDD" and not plan.getClass().getSimpleName().startswith("LogicalRDD"):
        return None
    file = plan.rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def release(settled: DataFrame) -> None:
    """Deletes what :func:`settle` kept; the frame cannot be read any more."""
    if at := kept_in(settled):
        path = settled.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(settled.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Timers:
    """Named stamps, and the seconds from one name's stamps to another's, pair by pair."""

    def __init__(self, clock=time.time):
        self.clock, self.stamps = clock, {}

    def stamp(self, name: str) -> float:
        """Seconds since the name's last stamp, 0 at its first."""
        seen = self.stamps.setdefault(name, [])
        seen.append(self.clock())
        return seen[-1] - seen[-2] if len(seen) > 1 else 0.0

    def clear(self, name: str) -> None:
        self.stamps.pop(name, None)

    def intervals(self, start: str, end: str) -> list[float]:
        return [b - a for a, b in zip(self.stamps.get(start, []), self.stamps.get(end, []))]

    def report(self, start: str, end: str) -> dict[str, float | int]:
        found = self.intervals(start, end)
        return {"n": len(found), "seconds": sum(found), "minutes": sum(found) / 60}
