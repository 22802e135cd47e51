"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing Parquet to ``spark.checkpoint.dir``: one job
writes and the next reads, so a lost executor costs a re-run of tasks and never a result.

Tables made inside ``with scratch():`` are dropped at its end. A function marked ``settled`` returns its
result as a table and drops every other table made on the way; what it returns belongs to the caller's scope.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_open: ContextVar[list | None] = ContextVar("tidegraph_tables", default=None)

#: Used only by a local session (tests) that names no folder itself.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets LOCAL_DIR."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or LOCAL_DIR)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


class Table:
    """A Parquet table in the shared folder, written with ``options``; ``drop`` removes it once nothing reads it. One with a ``path`` of its own stays."""

    def __init__(self, df: DataFrame, path: str | None = None, options: dict[str, str] | None = None):
        spark = df.sparkSession
        self.path = path or f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
        df.write.mode("overwrite" if path else "error").options(**options or {}).parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        if not path:
            self.register()

    def register(self) -> None:
        if (scope := _open.get()) is not None:
            scope.append(self)

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Buckets(Table):
    """A table in the shared folder whose rows lie hashed by ``columns`` in ``n`` buckets: joins and groups by them need no shuffle of it. One with a ``path`` of its own stays; ``buckets_at`` reads it again. dealt: whether the rows lie so already."""

    def __init__(self, df: DataFrame, n: int, *columns: str, path: str | None = None, dealt: bool = False, options: dict[str, str] | None = None):
        spark = df.sparkSession
        self.name = f"tidegraph_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/table-{self.name}"
        rows = df if dealt else df.repartition(n, *columns)
        rows.write.mode("overwrite").bucketBy(n, *columns).options(**options or {}).option("path", self.path).saveAsTable(self.name)
        self.df = spark.table(self.name)
        if not path:
            self.register()

    def drop(self) -> None:
        self.df.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().drop()


def buckets_at(spark: SparkSession, path: str, n: int, columns: list[str], schema: StructType) -> DataFrame:
    """The table that a ``Buckets`` wrote under ``path``, maybe in another session."""
    name = f"tidegraph_{uuid.uuid4().hex}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({', '.join(columns)}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


@contextmanager
def scratch() -> Iterator[list[Table]]:
    """Collects the tables made inside; those still in the list at the end are dropped."""
    mine: list[Table] = []
    token = _open.set(mine)
    try:
        yield mine
    finally:
        _open.reset(token)
        for table in mine:
            table.drop()


def settled(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``work`` with its result written, and nothing else left in the shared folder."""

    @wraps(work)
    def run(*args, **options) -> DataFrame:
        with scratch() as mine:
            out = Table(work(*args, **options))
            mine.remove(out)
        out.register()
        return out.df

    return run


#: For tables of rows of megabytes: a row group is closed as soon as it is full (else after a hundred rows at least), as writers and readers hold whole ones.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialize(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, without its lineage."""
    return Table(df, options=options).df
