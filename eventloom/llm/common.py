"""What the operators share: words, the shared folder, column names, tokenizer files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and the five ASCII control blanks.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``.

    Where it is unset and the session runs on one machine (local mode, as in
    tests), a folder of this machine is set; elsewhere there is no such folder to choose.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: lineage ends here."""
    return Shelf(df.sparkSession, what).stored(df, what)


class Shelf:
    """Intermediate tables of one run below the shared folder; ``clear`` deletes them."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.path, self.count, self.tables = spark, scratch(spark, what), 0, []

    def place(self, what: str) -> str:
        self.count += 1
        return f"{self.path}/{self.count}-{what}"

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = self.place(what)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, what: str, by: str, buckets: int) -> DataFrame:
        """Stored in buckets by a column, so that later joins and groups by it need no shuffle of these rows."""
        name = f"loom_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "none").option("path", self.place(what)).bucketBy(buckets, by).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.discard(self.path)

    def discard(self, *paths: str) -> None:
        """Deletes what nothing reads any more."""
        jvm = self.spark._jvm
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; it is installed beside the libraries on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where PYTHONPATH does not already do so."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in (os.path.abspath(p) for p in known if p) or getattr(spark.sparkContext, "_loom_shipped", False):
        return
    import shutil

    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), package), "zip", root, package)
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._loom_shipped = True
