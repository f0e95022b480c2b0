"""Readers to canonical rows (split, client, row_id, features, y), checks, and writers."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.portable import dense_number, draw, settle


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def check_schema(train: DataFrame, test: DataFrame, label: str) -> None:
    """Raise ValueError unless both tables have the same number of numeric features and one numeric label."""
    for name, df in (("train", train), ("test", test)):
        names = [c.split(".")[0] for c in df.columns]
        if names.count(label) != 1:
            raise ValueError(f"{name}: the label column must occur exactly once")
        for field in df.schema.fields:
            if not isinstance(field.dataType, T.NumericType):
                raise ValueError(f"{name}: column {field.name} is not numeric")
    if len(train.columns) != len(test.columns):
        raise ValueError("train and test differ in their number of features")


def count_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values of each column are NULL or NaN."""
    bad = lambda c: F.sum((quoted(c).isNull() | F.isnan(quoted(c).cast("double"))).cast("bigint")).cast("bigint")
    return df.agg(*[bad(c).alias(c) for c in columns])


def row_faults(rows: DataFrame) -> DataFrame:
    """For each client: rows, those without a label, with a label that is no class (negative or fractional), with missing
    and with infinite features, and the least and most features of a row."""
    some = lambda c: F.count_if(c)
    y, none = F.col("y"), lambda x: x.isNull() | F.isnan(x)
    faults = [some(none(y)).alias("no_label"), some((y < 0) | (y != F.floor(y))).alias("no_class"), some(F.exists("features", none)).alias("missing"), some(F.exists("features", lambda x: F.abs(x) == float("inf"))).alias("infinite")]
    return rows.groupBy("client").agg(F.count("*").alias("n"), *faults, F.min(F.size("features")).alias("least_features"), F.max(F.size("features")).alias("most_features"))


def canonical(df: DataFrame, features: list[Column], y: Column, client: Column, key: list[str], order: list[str], split: Column | None = None) -> DataFrame:
    """Rows with dense ids per (split, client), in the order of the key's draw and then ``order``."""
    rows = df.withColumns({"client": client.cast("int"), "features": F.array(*[c.cast("double") for c in features]), "y": y.cast("double")})
    h = draw(*[F.col(k) for k in key])
    # A constant is no key: Spark leaves it out of windows but not out of a repartition, and would shuffle the dealt rows again.
    numbered = dense_number(rows, ["client"], h, order, "row_id").withColumn("split", F.lit("0")) if split is None else dense_number(rows.withColumn("split", split), ["split", "client"], h, order, "row_id")
    return numbered.select("split", "client", "row_id", "features", "y")


def site_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, block, at, value) of all lines that aren't blank; a block is a file's split, by its first byte, and ``at``
    ascends by one from line to line inside it."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return lines.filter(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())


def site_headers(lines: DataFrame, sep: str) -> dict[str, list[str]]:
    """Names of the columns of each file, from its first line: one row a file."""
    first = lines.filter("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    return {r.path: next(csv.reader([r.header], delimiter=sep)) for r in first.collect()}


def in_file_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (path, block, at, ...) with ``row_id``: 0-based place within ``by``, by path and then line.

    ``at`` ascends inside a split. Splits are counted and the sizes of those before are added up, so no row is sorted or
    shuffled: the windows hold one row a split.
    """
    splits = rows.groupBy(*by, "path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*by, "path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(starts, [*by, "path", "block"]).withColumn("row_id", (F.col("at") + F.col("shift")).cast("bigint")).drop("path", "block", "at", "shift")


def feature_names(headers: dict[str, list[str]], label: str) -> list[str]:
    """The features in the order of the first file by path. Raises ValueError unless all files have the same columns, and the label once."""
    if not headers:
        raise ValueError("there are no lines to read")
    names = [c for c in headers[min(headers)] if c != label]
    for path, header in headers.items():
        if header.count(label) != 1:
            raise ValueError("the label column must occur exactly once")
        if sorted(header) != sorted([*names, label]) or len(set(names)) < len(names):
            raise ValueError(f"{path} has other columns than {min(headers)}, or one twice")
    return names


def read_csv_sites(spark: SparkSession, pattern: str, label: str, sep: str = ",", row_ids: str = "values", names: list[str] | None = None) -> DataFrame:
    """One scan of all sites' files, as doubles: ``client`` and ``split`` come from the path .../client<k>[/.../<split>]/<file>.csv.

    Columns are found by name in each file's own header line, so sites may order them differently; ``names`` gives the
    features and their order, by default those of the first file. A value that is no number is an error, a missing one
    is null. Rows are numbered within (split, client) in the order of their values' draw, or with ``row_ids`` "lines" in
    file order, part files of one folder by their names. See ``feature_names`` for files that are refused.
    """
    lines = site_lines(spark, pattern)
    headers = site_headers(lines, sep)
    own = feature_names(headers, label)
    names = names if names is not None and sorted(names) == sorted(own) else own
    # One row a file, broadcast by Spark as far as it is small.
    places = spark.createDataFrame([(p, h.index(label), [h.index(c) for c in names], len(h)) for p, h in headers.items()], "path string, label_at int, feature_at array<int>, width int")
    width = max(map(len, headers.values()))
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"sep": sep})
    parsed = lines.join(places, "path").withColumn("row", cells).withColumn("cells", F.array(*[F.col(f"row.c{i}") for i in range(width)]))
    # The header is the line that begins its file and names the label where the label stands.
    header = (F.col("block") == 0) & F.get("cells", F.col("label_at")).eqNullSafe(F.lit(label))
    parsed = parsed.withColumn("header", header).filter(~F.col("header"))
    # Filters on what follows may be pushed before that of the headers, so these are no numbers to fail on.
    number = lambda c: F.when(F.col("header") | c.isNull() | F.trim(F.lower(c)).isin("", "na", "nan"), None).otherwise(c).cast("double")
    # A file named .csv may be a folder of part files.
    folders = F.regexp_replace(F.regexp_extract("path", r"client\d+/(.*)$", 1), r"(^|/)([^/]*\.csv(/.*)?|[^/]*)$", "")
    split = F.regexp_extract(folders, r"([^/]+)$", 1)
    located = parsed.select("path", "block", "at", F.regexp_extract("path", r"client(\d+)/", 1).cast("int").alias("client"), F.when(split == "", F.lit("0")).otherwise(split).alias("split"), F.transform("feature_at", lambda i: number(F.get("cells", i))).alias("features"), number(F.get("cells", F.col("label_at"))).alias("y"))
    columns = ["split", "client", "row_id", "features", "y"]
    if row_ids == "lines":
        # Settled, so that the places inside splits are those that were counted.
        return in_file_order(settle(located, "lines"), ["split", "client"]).select(*columns)
    whole = F.concat_ws(",", F.transform("features", lambda x: x.cast("string")), F.col("y").cast("string"))
    return dense_number(located.drop("path", "block", "at"), ["split", "client"], draw(whole), ["features", "y"], "row_id").select(*columns)


def require_sites(rows: DataFrame) -> None:
    if rows.select("client").distinct().limit(2).count() < 2:
        raise RuntimeError("at least two clients are needed")


def synthetic(spark: SparkSession, rows: int, features: int, classes: list[int] | None, seed: int = 0) -> DataFrame:
    """Uniform features; a uniformly chosen class, or a target in [0, 100) without classes."""
    names = [f"Feature_{i + 1}" for i in range(features)]
    target = F.get(F.array(*map(F.lit, classes)), F.floor(F.rand(seed) * len(classes)).cast("int")) if classes else F.rand(seed) * 100
    return spark.range(rows).select(*[F.rand(seed + 1 + i).alias(n) for i, n in enumerate(names)], target.alias("Target"))


def write_column(rows: DataFrame, column: str, path: str, sep: str, by_site: bool) -> None:
    out = rows.select("split", "client", "row_id", column) if by_site else rows.select(column)
    if by_site:  # in order of the rows inside a folder, from part file to part file
        out = out.repartitionByRange("split", "client", "row_id").sortWithinPartitions("split", "client", "row_id")
    writer = out.write.mode("overwrite").option("header", True).option("sep", sep)
    (writer.partitionBy("split", "client") if by_site else writer).csv(path)


def write_predictions(predictions: DataFrame, path: str, sep: str = ",", by_site: bool = False) -> None:
    """Column ``pred``; ``by_site`` adds row_id and gives each (split, client) a folder of its own."""
    write_column(predictions, "pred", path, sep, by_site)


def write_truth(rows: DataFrame, path: str, sep: str = ",", by_site: bool = False) -> None:
    """Column ``y_true``; as ``write_predictions``."""
    write_column(rows.withColumn("y_true", F.col("y")), "y_true", path, sep, by_site)


# The test tables as canonical rows.


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return canonical(df, [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], y, F.col("l_orderkey") % 3, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], df.columns)


def embedding_rows(spark: SparkSession, sf_dir: str, dims: int = 64, split: Column | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return canonical(df, [F.get("embedding", F.lit(i)) for i in range(dims)], F.col("label"), F.col("vec_id") % 3, ["vec_id"], ["vec_id"], split)


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return canonical(df, [F.col("p_size"), F.col("p_partkey") % 50], F.round("p_retailprice"), F.col("p_partkey") % 3, ["p_partkey"], ["p_partkey"])
