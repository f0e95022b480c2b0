"""Draws and keys that any SQL engine can repeat, and tables that end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Draws are 32 bits; the top bits of a draw are its bucket, so that bucket order is draw order.
BUCKET_WIDTH = 1 << 16

#: Rows that one task of a shuffle should hold.
ROWS_A_TASK = 500_000

_own_dir: list[str] = []


def draw(*parts: Column | str | int) -> Column:
    """32 bits of the MD5 of the parts joined by ``|``, as BIGINT: a counter-based random draw."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a temporary one, and only with a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="grovelight-"))
    return _own_dir[0]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and the table's size is known."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path  # with the frame, so that no list keeps frames and their plans alive
    return out


def settled_at(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``settle`` has written, perhaps in another session."""
    out = spark.read.parquet(path)
    out._settled_path = path
    return out


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder that Spark has written to its end."""
    files, place = _place(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    delete(df.sparkSession, df.__dict__.pop("_settled_path"))


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not ``taken``, in any case of letters."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def spread(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``df``, or where so many rows are too many for the session's number of shuffle partitions, dealt by ``keys`` to as
    many as keep a task at ``ROWS_A_TASK``: what follows by these keys isn't shuffled again, and no task grows with the table."""
    n = -(-n_rows // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def dense_number(df: DataFrame, by: list[str], h: Column, ties: list[Column | str], name: str) -> DataFrame:
    """``name``: 0-based position of each row within ``by`` in the order (h, ties); ``h`` is a draw.

    One window over ``by`` would sort a whole site in one task. Here rows are numbered inside the buckets of the draw
    and the sizes of the earlier buckets, 65,536 rows a group at most, are added. The numbers don't depend on the buckets.
    """
    rows = df.withColumn("__h", h).withColumn("__bucket", F.floor(F.col("__h") / BUCKET_WIDTH))
    dealt = spread(rows, df.count(), *by, "__bucket")
    sizes = rows.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "__bucket", F.coalesce(earlier, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__h", *ties)) - 1
    return dealt.withColumn("__inside", inside).join(starts, [*by, "__bucket"]).withColumn(name, (F.col("__start") + F.col("__inside")).cast("bigint")).drop("__h", "__bucket", "__start", "__inside")
