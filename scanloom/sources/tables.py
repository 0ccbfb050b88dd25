"""Tables between jobs: checkpoints that all executors see, model tables, feature tables and summaries."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. A local session without the setting gets its
    own folder, which goes with the process; on a cluster a machine-local one wouldn't be seen by the other machines, so
    it must be set there."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="scanloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that lost executors cost no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class LoopTables:
    """Tables that a loop writes anew each round, as Parquet in the shared folder.

    A checkpoint keeps the optimizer's estimate of the plan it replaces, and joins multiply estimates: over the rounds of
    a loop these numbers grow to millions of digits. A table that is read back has the size of its files.

    As a context it drops what is left when the loop ends, so a result must be a checkpoint by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.written = spark, f"{shared_folder(spark)}/loop-{uuid.uuid4().hex}", {}

    def __enter__(self) -> LoopTables:
        return self

    def __exit__(self, *_: object) -> None:
        remove_folder(self.spark, self.folder)

    def _write(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        nth = self.written.get(name, 0)
        self.written[name] = nth + 1
        path = f"{self.folder}/{name}/{nth}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df as the next generation of name. The one before it stays, for plans of this round; that before goes."""
        _, found = self._write(name, df)
        if (old := self.written[name] - 3) >= 0:
            remove_folder(self.spark, f"{self.folder}/{name}/{old}")
        return found

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """df, as one more part of name; `all` gives the parts together."""
        return self._write(name, df)[1]

    def all(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/{i}" for i in range(self.written.get(name, 0))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def write_feature_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def read_feature_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """kind `rows` reads the layout of one JSON object with an array `rows`."""
    if kind == "rows":
        return spark.read.json(path, multiLine=True).select(F.inline("rows"))
    return spark.read.format(kind).load(path)


def save_model(path: str, **tables: DataFrame) -> None:
    """Small tables (scaler, centers, alignment, ...) as Parquet, one folder each."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, root: str, folder: str) -> int:
    """Makes folder, which must be whole, the current version of what lies under root, and gives the version's number.

    A version is a manifest, a file of one line that is renamed into place; a number that another has taken meanwhile is
    passed by, so no version is lost and no reader sees half a one."""
    jvm, name = spark._jvm, uuid.uuid4().hex
    part, files = _files(spark, f"{root}/manifests/.{name}")
    files.mkdirs(part.getParent())
    out = files.create(part, False)
    out.write(bytearray(folder.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    number = (current_version(spark, root) or (0, ""))[0]
    while True:
        number += 1
        try:
            context.rename(part, jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{number:08d}"), options)
            return number
        except Py4JJavaError as error:
            if "AlreadyExists" not in str(error.java_exception):
                raise


def current_version(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """The number and folder of the latest version, or None."""
    at, files = _files(spark, f"{root}/manifests")
    if not files.exists(at):
        return None
    names = [s.getPath().getName() for s in files.listStatus(at)]
    if not (numbers := [int(n) for n in names if n.isdigit()]):
        return None
    return max(numbers), spark.read.text(f"{root}/manifests/{max(numbers):08d}").first()["value"]


def cluster_summary(cards: DataFrame, method: str) -> DataFrame:
    """One row: cluster_count, purity_percent, decision_method and the array of cluster cards."""
    card = F.struct("cluster_id", "label", "count", "mapped_class", "distribution")
    top = F.array_max(F.transform("distribution", lambda d: d["count"]))
    return cards.agg(F.count(F.lit(1)).alias("cluster_count"), F.round(100 * F.sum(top) / F.sum("count"), 2).alias("purity_percent"), F.lit(method).alias("decision_method"), F.sort_array(F.collect_list(card)).alias("cluster_cards"))


def write_cluster_summary(cards: DataFrame, method: str, path: str) -> None:
    cluster_summary(cards, method).coalesce(1).write.mode("overwrite").json(path)
