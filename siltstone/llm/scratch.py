"""Tables written between the steps of an operator.

They go to the shared folder that the cluster names in ``spark.checkpoint.dir``, so that a lost executor
costs a read of the table and not the work before it. Where the setting is missing there is no folder that all
machines see, and the operator says so instead of taking a local one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


#: What the owner around the running code has to clear, if there is one.
_held: ContextVar[list[Scratch] | None] = ContextVar("held", default=None)


class Scratch:
    """Writes tables under one folder and removes those that are no longer needed.

    What an operator's result still reads stays. Who writes that result opens ``owned`` around it and clears what was
    opened inside; an owner is seen by its own thread only, so runs beside each other never clear each other's tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.top = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"
        self.names: list[str] = []
        if (held := _held.get()) is not None:
            held.append(self)

    @staticmethod
    @contextmanager
    def owned() -> Iterator[None]:
        """All that is opened inside is cleared at the end, also after an error."""
        held: list[Scratch] = []
        token = _held.set(held)
        try:
            yield
        finally:
            _held.reset(token)
            for scratch in held:
                scratch.drop_all_but()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        df.write.parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, name: str, **figures) -> tuple[DataFrame, dict]:
        """The kept table, its number of rows (``rows``) and further aggregates, taken while it is written."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in figures.items())), name)
        return kept, seen.get

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            self.names.remove(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(n for n in list(self.names) if n not in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that are broadcast at most (8 bytes each); more go through a join.
BROADCAST_IDS = 500_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``ids`` (a table with a doc_id column); null equals null."""
    scratch = Scratch(docs.sparkSession)
    ids, seen = scratch.measured(ids.select(F.col("doc_id").cast("long").alias("_gone")).distinct(), "gone")
    side = F.broadcast(ids) if seen["rows"] <= BROADCAST_IDS else ids
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
