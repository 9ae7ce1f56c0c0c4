"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where tables go when the session names no folder (tests on one machine).
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where a session on one machine has none.

    On a cluster without that setting this raises: executors would write to disks that the others do not see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = LOCAL_DEFAULT  # a running session does not let the setting be changed
    return found.rstrip("/")


#: Tables of this driver that are still there.
_MADE: list[Table] = []


class Table:
    """A written table: ``df`` reads it back, ``drop`` removes its files."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _MADE.append(self)

    def drop(self) -> None:
        _MADE.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later reads survive lost executors and agree with each other."""
    return Table(df, name).df


def kept_alone(make: Callable[[], DataFrame], name: str) -> Table:
    """The result of ``make`` as a table, without the tables that were written on the way to it."""
    before = list(_MADE)
    out = Table(make(), name)
    for made in [t for t in _MADE if t not in before and t is not out]:
        made.drop()
    return out


def clear() -> None:
    """Removes all tables that this driver's operators have written; call it when their results are stored."""
    for made in list(_MADE):
        made.drop()
