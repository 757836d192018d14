"""Table reading and writing, and the tables an application stores for reuse."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _is_path(target: str) -> bool:
    return "/" in target


def read_table(spark: SparkSession, target: str, schema: StructType | None = None) -> DataFrame:
    """Table by catalog name, or Parquet by path. For a path, an explicit
    schema saves looking into the files and fixes the partition column types."""
    if not _is_path(target):
        return spark.table(target)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(target)


def write_table(df: DataFrame, target: str, partition: str | None = "event_date", mode: str = "overwrite") -> None:
    """Write Parquet to a path or a catalog table, one directory per ``partition`` value.

    The rebalance hint groups rows by partition value so that a task does not
    open one file per date, and lets adaptive execution split a date that is
    much larger than the others over several tasks.
    """
    if partition is None:
        writer = df.write.mode(mode)
    else:
        writer = df.hint("rebalance", partition).write.mode(mode).partitionBy(partition)
    if _is_path(target):
        writer.parquet(target)
    else:
        writer.format("parquet").saveAsTable(target)


def replace_partitions(df: DataFrame, target: str, values: list, partition: str = "event_date") -> None:
    """Replace the partitions ``values`` of ``target`` (path or table) with the rows of ``df``.

    This is how a late or repeated load of some dates is written: ``values`` are the
    partition values the load answers for, dates or text. Every other partition keeps
    its files; rows of ``df`` outside of ``values`` are left out; a named partition
    without rows goes; one that does not exist yet is added. ``df`` may read the
    target, whose files are swapped after all rows are written. The rows are staged
    first, so a call that is repeated after a lost driver gives the same table. A
    bucketed table keeps its buckets.
    """
    spark = df.sparkSession
    rows = cut_lineage(df.where(F.col(partition).isin(list(values))))
    found = {r[0] for r in rows.select(partition).distinct().collect()}  # no more than ``values``
    if _is_path(target):
        writer = rows.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition)
        writer.option("partitionOverwriteMode", "dynamic").parquet(target)
    else:
        buckets, by = bucketing(spark, target)
        dealt = rows.repartition(buckets, *by) if by else rows.hint("rebalance", partition)
        # the table was created with dynamic overwriting, see create_bucketed
        dealt.select(*spark.table(target).columns).write.mode("overwrite").insertInto(target)
    for value in set(values) - found:
        if _is_path(target):
            delete_folder(spark, f"{target.rstrip('/')}/{partition}={value}")
        else:
            spark.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION ({partition} = '{value}')")
            delete_folder(spark, f"{table_location(spark, target)}/{partition}={value}")


def _described(spark: SparkSession, table: str) -> dict[str, str]:
    return {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}


def table_location(spark: SparkSession, table: str) -> str:
    return _described(spark, table)["Location"].rstrip("/")


def bucketing(spark: SparkSession, table: str) -> tuple[int, list[str]]:
    """Number of buckets of a catalog table and the columns they go by; (0, []) if it has none."""
    known = _described(spark, table)
    count = int(known.get("Num Buckets", 0))
    by = known.get("Bucket Columns", "[]").strip("[]").replace("`", "")
    return count, [c.strip() for c in by.split(",") if c.strip()]


def create_bucketed(
    df: DataFrame, table: str, path: str, by: str, sort: list[str], buckets: int, partition: str | None = None
) -> None:
    """Write ``df`` under ``path`` as the catalog table ``table`` with ``buckets`` files per partition, one for
    each bucket of ``by``. Work grouped or ordered by that column then needs no exchange."""
    writer = df.repartition(buckets, by).write.format("parquet").mode("overwrite").option("path", path)
    if partition is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.bucketBy(buckets, by).sortBy(*sort).saveAsTable(table)


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_STORED: dict[str, StructType] = {}
_TABLES: dict[str, str] = {}  # catalog name of a stored bucketed table, by path
_LOCK = threading.RLock()  # reentrant: one stored table may build on another


def shared_dir(spark: SparkSession) -> str:
    """Folder for this application's stored tables, on storage every executor reaches:
    under ``spark.checkpoint.dir``, or under the session's warehouse where that is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/loomlog-{context.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Remove every table this application has stored."""
    folder = shared_dir(spark)
    with _LOCK:
        for path in [p for p in _STORED if p.startswith(folder)]:
            del _STORED[path]
        for path in [p for p in _TABLES if p.startswith(folder)]:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        delete_folder(spark, folder)


def table_path(spark: SparkSession, name: str, source: str, settings: tuple = ()) -> str:
    """Place of a stored table made from the input folder ``source`` with ``settings``."""
    mark = hashlib.sha1(repr((source, settings)).encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/{name}-{mark}"


def stored(
    spark: SparkSession,
    name: str,
    source: str,
    build: Callable[[], DataFrame],
    partition: str | None = None,
    settings: tuple = (),
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Table built once per application, input and settings, then read from disk.

    Files in the shared folder outlive executors, unlike cached blocks. With
    ``order`` the files hold ranges of these columns, so that filters on them skip files.
    """
    path = table_path(spark, name, source, settings)  # names the application, too
    with _LOCK:
        if path not in _STORED:
            df = build()
            if order:
                df = df.repartitionByRange(*order).sortWithinPartitions(*order)
            write_table(df, path, partition)
            _STORED[path] = df.schema
    return read_table(spark, path, _STORED[path])


def stored_folder(spark: SparkSession, name: str, source: str, write: Callable[[str], None], settings: tuple = ()) -> str:
    """Folder that ``write`` fills with tables once per application, input and settings."""
    path = table_path(spark, name, source, settings)
    with _LOCK:
        if path not in _STORED:
            write(path)
            _STORED[path] = StructType()
    return path


def stored_bucketed(
    spark: SparkSession,
    name: str,
    source: str,
    build: Callable[[], DataFrame],
    by: str,
    sort: list[str],
    partition: str | None = None,
    settings: tuple = (),
    buckets: int | None = None,
) -> str:
    """Name of a bucketed catalog table, built once per application, input and settings.

    ``buckets`` is the number of shuffle partitions of the session unless it is given.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = table_path(spark, name, source, (*settings, buckets))
    with _LOCK:
        if path not in _TABLES:
            mark = path.rsplit("-", 1)[1]
            table = f"loomlog_{name}_{mark}_{spark.sparkContext.applicationId.replace('-', '_')}"
            create_bucketed(build(), table, path, by, sort, buckets, partition)
            _TABLES[path] = table
    return _TABLES[path]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of this application that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that values which
    depend on how rows were partitioned become plain data."""
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    write_table(df, path, None)
    return read_table(spark, path, df.schema)
