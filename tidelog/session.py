"""Session defaults and shared-folder scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where scratch tables go in tests and other runs on one machine whose session names no folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tidelog"
#: Bytes of written tables for which a table made from them is given a part of its own, and its least parts a core.
PART, LEAST = 2 << 20, 4


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidelog")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves if everything runs in one JVM, and anything else is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{LOCAL_CHECKPOINTS}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


class Scratch:
    """Tables written to the shared folder to cut lineage; Hadoop deletes what is left when the JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.top = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.top).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.top))
        self._fs.deleteOnExit(self._path(self.top))

    def at(self, name: str) -> str:
        return f"{self.top}/{name}"

    def parts(self, *names: str) -> int:
        """In how many parts a table made from these written ones is to be written: as their bytes ask for, so that
        large tables keep all of Spark's partitions and small ones aren't strewn over hundreds of files."""
        size = sum(n for name in names for _, n in self.files(name))
        return max(LEAST * self.spark.sparkContext.defaultParallelism, -(-size // PART))

    def save(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        """Write df as Parquet and read it again: its rows are then fixed, whatever executors are lost later.

        Every part costs executors a task and, on a local file system without Hadoop's native library, three processes
        that set permissions, each of which is for a moment a second copy of the JVM. With `parts`, partitions are
        merged to that many, without another shuffle, where Spark shuffles to more.
        """
        if parts is not None and parts < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(parts)
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def folder(self, name: str) -> str:
        """An empty folder for files that tasks write themselves."""
        self._fs.mkdirs(self._path(self.at(name)))
        return self.at(name)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(self.at(name)), True)

    def files(self, name: str) -> list[tuple[str, int]]:
        """Path and bytes of each data file under a name; their number follows the writer's tasks, not the rows."""
        out = [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(self._path(self.at(name))) if s.isFile()]
        return sorted(x for x in out if not x[0].rsplit("/", 1)[-1].startswith(("_", ".")))
