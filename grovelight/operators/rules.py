"""Leaves as rules: the interval of each feature's bins that leads to a leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A path step is (feature, low, high): bins over ``low`` and up to ``high``, null where there is no bound.
_WALK = """
WITH RECURSIVE walk(split, tree, node_id, path) MAX RECURSION LEVEL {depth} AS (
  SELECT DISTINCT split, tree, CAST(1 AS BIGINT), CAST(array() AS ARRAY<STRUCT<feature: INT, low: INT, high: INT>>) FROM {nodes}
  UNION ALL
  SELECT w.split, w.tree, w.node_id * 2 + side, array_append(w.path, named_struct('feature', n.feature, 'low', IF(side = 1, n.thr, CAST(NULL AS INT)), 'high', IF(side = 0, n.thr, CAST(NULL AS INT))))
  FROM walk w JOIN {nodes} n ON w.split = n.split AND w.tree = n.tree AND w.node_id = n.node_id AND NOT n.is_leaf
  LATERAL VIEW explode(array(0, 1)) s AS side
)
SELECT w.split, w.tree, w.node_id, n.value, w.path
FROM walk w JOIN {nodes} n ON w.split = n.split AND w.tree = n.tree AND w.node_id = n.node_id AND n.is_leaf"""

_MERGED = """
SELECT split, tree, node_id, value, transform(array_sort(array_distinct(transform(path, p -> p.feature))), f -> named_struct('feature', f,
  'low', array_max(transform(filter(path, p -> p.feature = f), p -> p.low)), 'high', array_min(transform(filter(path, p -> p.feature = f), p -> p.high)))) AS rule
FROM {walked}"""


def leaf_rules(nodes: DataFrame, depth: int) -> DataFrame:
    """(split, tree, node_id, value, rule): each leaf's path from the root, as one interval a feature that occurs on it.

    A row of bins goes to the leaf whose intervals hold all its bins; every row satisfies one rule of a tree. A root that
    is a leaf has an empty rule. ``nodes`` are those of ``grow.grow`` of at most ``depth`` levels.
    """
    spark = nodes.sparkSession
    walked = spark.sql(_WALK.format(nodes="{nodes}", depth=depth + 1), nodes=nodes)
    return spark.sql(_MERGED, walked=walked)
