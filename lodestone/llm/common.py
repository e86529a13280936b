"""Shared plumbing: input tables, run folders, files in any store, Arrow maps."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, for Java and Python patterns.
ASCII_SPACE = r"[\x20\x09-\x0D]"


#: Rows of whole texts that go to a Python worker at once, at most.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_ROWS``: rows here are whole documents.

    The setting is the session's; a smaller one that is there already stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, read by Spark so any store will do."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A local session without that setting (tests, a laptop) gets a temporary
    one; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession, what: str) -> str:
    """A new, unique folder name for one run's tables or files."""
    return f"{shared_folder(spark)}/lodestone-{what}-{uuid.uuid4().hex}"


def materialise(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table into a run folder and read it back: cuts the lineage.

    Unlike a cached or locally checkpointed frame it survives lost executors.
    """
    path = f"{folder}/{name}"
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a run folder through Hadoop's file system, whatever the store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep_only(spark: SparkSession, folder: str, names: set[str]) -> None:
    """Remove the tables of a run folder that its result doesn't read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(where):
        if status.getPath().getName() not in names:
            store.delete(status.getPath(), True)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store; none where there is no folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in store.listStatus(where)] if store.exists(where) else []


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    return uri if "://" not in uri else None


def write_file(uri: str, chunks: Iterator[bytes]) -> None:
    """Write a file under its final name only once it is complete.

    Tasks may run twice; each attempt writes its own temporary file and the
    rename replaces an equal file, so readers never see a partial one.
    """
    temporary = f"{uri}.{uuid.uuid4().hex}.partial"
    if (path := _local(temporary)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(path, "wb") as out:
                for chunk in chunks:
                    out.write(chunk)
            os.replace(path, _local(uri))
        except BaseException:
            with contextlib.suppress(OSError):
                os.unlink(path)
            raise
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(temporary)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(path, fs.FileSystem.from_uri(uri)[1])


def map_file(uri: str) -> pa.Buffer:
    """A file's bytes: memory-mapped on a mounted store, else read whole."""
    if (path := _local(uri)) is not None:
        if os.path.getsize(path) == 0:
            return pa.py_buffer(b"")
        return pa.memory_map(path, "r").read_buffer()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        return file.read_buffer()


def open_random(uri: str):
    """A seekable file of any store."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")  # noqa: SIM115
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def map_batches(frame: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over dicts of columns (lists in, lists out)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bound_batches(frame.sparkSession)
    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)} for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return frame.mapInArrow(run, schema)


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (one column); null equals null.

    The rows travel as one struct, so their column names clash with nothing.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    wanted = ids.toDF("id").distinct()
    return whole.join(wanted, F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("id")), "left_semi").select("row.*")


def whole_text(column: str = "text"):
    """The contracts' reading of a text: null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
