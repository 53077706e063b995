"""What the corpus operators share: reading tables, cutting lineage, Arrow maps and free column names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a Python worker works on at once. Spark bounds a batch by its bytes; within it results are made in smaller pieces.
PIECE_ROWS = 500
#: Bytes of a bucket, the most buckets that Spark allows, and what it estimates of tables that it knows nothing of.
BUCKET_BYTES, MOST_BUCKETS, NO_ESTIMATE = 256 << 20, 100_000, 1 << 60
#: Bits of a bitmap of hashes: 131,072 words, whatever the input.
MARKS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that every executor sees: in the one the cluster names in spark.checkpoint.dir.

    Where that is unset a temporary one is made, but only if driver and executors are one process (tests); on a cluster a
    folder of one machine would lose the data, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellum-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: a checkpoint of which later steps read only the columns they need."""
    place = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` written to the shared folder as a table bucketed by `key`: joins by that key leave its rows where they are.

    There are as many buckets as shuffles have partitions, or more if Spark's estimate of the size asks for it, so a bucket
    stays small on large tables; an estimate that says nothing is left aside. The table goes from the catalogue at once; its
    files stay.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, MOST_BUCKETS) if size < NO_ESTIMATE else 0)
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def forget(df: DataFrame) -> None:
    """Delete the files of a stored DataFrame that nothing will read again."""
    for file in df.inputFiles()[:1]:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = PIECE_ROWS) -> DataFrame:
    """Apply `step` to pieces of `rows` rows; pieces are independent, so a lost task is simply run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows):
            yield step(batch)

    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def strings(column: pa.Array) -> list[str]:
    """A string column as Python strings, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def marks(keys: DataFrame) -> DataFrame:
    """Of the values of the only column: rows (word, bits) of a bitmap with a bit for each value's hash, at most MARKS / 64 of them."""
    placed = keys.toDF("key").select(F.expr(f"pmod(xxhash64(key), {MARKS})").alias("place"))
    return checkpoint(placed.groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")))


def marked(df: DataFrame, column: str, bitmap: DataFrame, among: bool = True) -> DataFrame:
    """The rows whose value may be among those of the bitmap or, with among=False, all others, which surely are not.

    The bitmap is broadcast, so of a table that is to be joined with few keys only these and some chance hits are shuffled.
    """
    word, bits = fresh(df, "word", "bits")
    place = F.pmod(F.xxhash64(column), F.lit(MARKS))
    known = df.withColumn(word, F.floor(place / 64)).join(F.broadcast(bitmap.toDF(word, bits)), word, "left")
    hit = F.call_function("getbit", F.coalesce(bits, F.lit(0).cast("long")), (place % 64).cast("int")) == 1
    return known.where(hit if among else ~hit).select(*(known[c] for c in df.columns))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(id_column: str, text_column: str):
    """A string that tells rows apart by id and text: rows that agree in both are repeated rows."""
    return F.concat_ws(":", F.coalesce(F.concat(F.lit("i"), F.col(id_column).cast("string")), F.lit("none")), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
