"""A run from settings to files: read all sites, check, train, predict the test rows, write."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest as forests
from .config import RunConfig
from .functions.portable import settle
from .sources import tables

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Outcome:
    forest: forests.Forest
    train: DataFrame
    test: DataFrame
    predictions: DataFrame


def pattern(root: str, config: RunConfig, name: str) -> str:
    """All sites' files of one name: <root>/client<k>/[<split_dir>/<split>/]<name>."""
    inner = "" if config.split_mode == "file" else "/".join(p for p in (config.split_dir.strip("./"), "*") if p) + "/"
    return f"{root}/client*/{inner}{name}"


def run(spark: SparkSession, config: RunConfig, root: str, out: str | None = None) -> Outcome:
    """Train on every site's and split's training file, predict the test files, and write to <out>/<pred_out> and
    <out>/<test_out> (one folder a split and site, its part files in order of row_id); without ``out`` nothing is written.
    With ``config.row_ids`` "lines", line n of a site's predictions belongs to line n of its test file. Test columns are
    found by the names of the training columns, or, if they have other names, taken in their own order.

    At least two sites must have rows; train and test must have equally many features; every test split needs a model.
    """
    places = pattern(root, config, config.train)
    names = tables.feature_names(tables.site_headers(tables.site_lines(spark, places), config.sep), config.label)
    train = settle(tables.read_csv_sites(spark, places, config.label, config.sep, config.row_ids, names), "train")
    test = settle(tables.read_csv_sites(spark, pattern(root, config, config.test), config.label, config.sep, config.row_ids, names), "test")
    tables.require_sites(train)
    width = forests.check_rows(train)
    if not test.filter(F.size("features") != width).isEmpty():
        raise ValueError("train and test differ in their number of features")
    if not test.join(train.select("split").distinct(), "split", "left_anti").isEmpty():
        raise ValueError("a test split has no training rows")
    log.info("training %s trees on %s features", config.n_estimators, width)
    forest = forests.train(train, config)
    predictions = settle(forest.predict(test), "predictions")
    if out is not None:
        tables.write_predictions(predictions, f"{out}/{config.pred_out}", config.sep, by_site=True)
        tables.write_truth(test, f"{out}/{config.test_out}", config.sep, by_site=True)
        log.info("wrote predictions to %s", out)
    return Outcome(forest, train, test, predictions)
