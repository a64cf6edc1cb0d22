"""Written tables in the folder that the cluster shares, to cut lineage so that lost executors cost little."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Tables below ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is one process (tests, a single machine) a temporary
    folder is made and set; executors of a cluster would not share it, so there it is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="contractlens-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._path(self.root, lambda fs, p: fs.deleteOnExit(p))

    def _path(self, path: str, act) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        act(p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Free a table that nothing reads any more."""
        self._path(f"{self.root}/{name}", lambda fs, p: fs.delete(p, True))
