"""What the operators of this subpackage share: row identity, written tables, folds."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_OWN_DIRS: dict[str, str] = {}

#: Rows of Arrow data that one step of a Python kernel handles at a time.
SLICE = 512

#: Bits of a filter, whatever the input: a megabyte for each task.
FILTER_BITS = 1 << 23


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN_DIRS.setdefault(sc.applicationId, "")
        if not found:
            found = _OWN_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="mosaicrank-")
    return f"{found.rstrip('/')}/{sc.applicationId}"


def materialize(df: DataFrame, tag: str, dictionary: bool = True) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: a cut of the lineage
    that survives the loss of executors. Without dictionaries, hashes and the like take less CPU."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    # Spark keeps the shuffle files of a finished job until the driver's collector finds it unused
    gc.collect()
    spark._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """Adds a long that tells apart even rows that repeat in every column. It follows the
    order of a scan, so docs must be a table that is read, not a plan whose rows move."""
    ship(docs.sparkSession)
    return docs.withColumn(name, F.monotonically_increasing_id())


def dense(cells: DataFrame, size: int) -> DataFrame:
    """One row with column a: values in the order of cells, 0 where there is none. At most size
    numbers, whatever the input."""
    none = cells.sparkSession.range(size).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("value"))
    merged = cells.unionByName(none).groupBy("cell").agg(F.bit_or("value").alias("value"))
    return merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda x: x["value"]).alias("a"))


def bit_filter(keys: DataFrame, *key: str, bits: int = FILTER_BITS):
    """A function from columns to whether they may be among keys: true for all that are, and for more
    of the others the more keys there are."""
    h = F.pmod(F.xxhash64(*key), F.lit(bits))
    cells = keys.select(h.alias("h")).select(F.shiftright("h", 6).alias("cell"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("value"))
    table = dense(cells, bits >> 6).scalar()

    def test(*c: str) -> Column:
        at = F.pmod(F.xxhash64(*c), F.lit(bits))
        return F.getbit(table[F.shiftright(at, 6).cast("int")], at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is the held-out fold. A null id hashes as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def byte_rows(column) -> list[bytes]:
    """The UTF-8 of an Arrow string column, null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def slices(batches, rows: int = SLICE):
    """Smaller record batches, so that few texts are held as Python objects at once. Workers live on
    from task to task; what the last one left and what Arrow frees goes back to the system."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    trim()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    trim()
