"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is held in the memory of every executor at most; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Rows that a Python worker handles at a time. The bytes of a batch are bounded by Spark itself
#: (spark.sql.execution.arrow.maxBytesPerBatch), so that no session setting has to be changed.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that a run writes on its way, which all executors share.

    It is the checkpoint folder that the cluster names. Where none is named, a cluster gets one beside its
    warehouse, and only a session that is a single process gets a temporary folder of the machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir()


#: Folders of the tables written by this driver that are still there.
_WRITTEN: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed now, written as Parquet to the shared folder and read back.

    Lineage is cut there, and lost executors cost nothing that was written. ``drop``, ``settled`` and ``release``
    delete such tables; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing needs any more."""
    for df in tables:
        _delete(df.stored_at)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` stored, with the tables deleted that were stored on the way to it."""
    before = set(_WRITTEN)
    out = stored(make())
    for path in set(_WRITTEN) - before - {out.stored_at}:
        _delete(path)
    return out


def written() -> set[str]:
    """The stored tables that are there."""
    return set(_WRITTEN)


def forget(tables: set[str], but: DataFrame) -> None:
    """Deletes those of the tables that ``but`` does not read."""
    read = {f.rsplit("/", 1)[0] for f in but.inputFiles()} if tables else set()
    for path in tables:
        if not any(f.rstrip("/").endswith(path.split(":", 1)[-1].rstrip("/").lstrip("/")) for f in read):
            _delete(path)


def release() -> None:
    """Deletes all stored tables; results that read them must have been written or collected."""
    for path in list(_WRITTEN):
        _delete(path)


@atexit.register
def _last() -> None:
    try:
        release()
    except Exception:  # the JVM is gone already
        _WRITTEN.clear()


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory; strings and arrays by their length."""

    def of(column: Column, kind: object) -> Column:
        name = kind.typeName()
        if name in ("string", "binary"):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if name == "array":
            return F.coalesce(F.size(column), F.lit(0)) * 8 + 24
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32))


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a stored table take at most ``most`` bytes in memory, as counted."""
    return (df.agg(F.sum(row_bytes(df).cast("long"))).first()[0] or 0) <= most


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table with a broadcast hint if its rows take at most ``most`` bytes, else as it is.

    Without the hint Spark joins by shuffle, and adaptive execution splits partitions that one key makes large.
    """
    return F.broadcast(df) if is_small(df, most) else df


def parts(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def share_of(wanted: int, there: int) -> float:
    """Share of rows to take so that about ``wanted`` of ``there`` come."""
    return 1.0 if there <= wanted else wanted / there


def hashed_below(column: Column, share: Column | float) -> Column:
    """True for about that share of the values, always the same ones."""
    part = F.pmod(F.xxhash64(column.cast("string"), F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return part < (F.lit(share) if isinstance(share, float) else share)
