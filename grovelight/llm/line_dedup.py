"""Operator 5: boilerplate lines by site-relative frequency. DataFrame functions only.

A line is boilerplate at a host when the pages of the host that hold it, divided by all pages of the host, exceed
``ratio``, and at least ``min_pages`` pages hold it. Blank lines never are. Lines are counted by their MD5, once a
page, with partial sums before the shuffle, so a host with a third of all pages costs one row a task and line. A page
of L lines adds L/ratio at most to its host's list, so the list of a host is bounded by its mean page, not its size.

Defined cases: a null text stays null with 0 lines; an empty text is one blank line; pages without a host form one
host of their own; repeated rows are pages of their own; all other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, settle

RATIO = 0.1
MIN_PAGES = 5


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines array<binary>): digests of each host's boilerplate lines."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), digest))
    rows = pages.select(F.coalesce(F.concat(F.lit("="), host), F.lit("")).alias("host"), lines.alias("lines"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    holding = rows.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    frequent = holding.join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def host_of(url: Column) -> Column:
    """Lower-case host of a url, without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)), F.lit(""))


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text_col``; ``counts`` sets n_lines and n_dropped, in place of such columns."""
    text = F.col(text_col)
    at, list_, split, kept = (fresh(pages.columns, name) for name in ("__host", "__lines", "__split", "__kept"))
    # Settled, so Spark knows its size and broadcasts it only while it is under the session's threshold.
    found = settle(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    found = found.select(F.col("host").alias(at), F.col("lines").alias(list_))
    joined = pages.withColumn(split, F.coalesce(F.concat(F.lit("="), host), F.lit(""))).join(found, F.col(split) == F.col(at), "left")
    parts = F.split(text, "\n", -1)
    good = F.when(F.col(list_).isNull(), parts).otherwise(F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(list_), digest(x))))
    more = {"n_lines": F.coalesce(F.size(split), F.lit(0)), "n_dropped": F.coalesce(F.size(split) - F.size(kept), F.lit(0))} if counts else {}
    out = joined.withColumns({split: parts, kept: good}).withColumns(more | {text_col: F.array_join(kept, "\n")})
    return out.drop(at, list_, split, kept)
