"""Trees trained by Spark's learners as plain arrays, for use inside tasks."""

from __future__ import annotations

import numpy as np


def tree_arrays(root) -> dict[str, np.ndarray]:
    """feature (-1: leaf), threshold, left, right, value (a leaf's prediction) of a
    trained tree's JVM root node."""
    rows: list[list] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, float(node.prediction())])
        if hasattr(node, "split") and node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = [split.featureIndex(), float(split.threshold())]
            rows[at][2] = walk(node.leftChild())
            rows[at][3] = walk(node.rightChild())
        return at

    walk(root)
    feature, threshold, left, right, value = zip(*rows)
    return {"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left), "right": np.array(right), "value": np.array(value)}


def predict(tree: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """A tree's prediction for each row of features: left where a feature is at most the threshold."""
    at = np.zeros(len(rows), np.int64)
    while True:
        inner = np.flatnonzero(tree["feature"][at] >= 0)
        if not len(inner):
            return tree["value"][at]
        node = at[inner]
        goes_left = rows[inner, tree["feature"][node]] <= tree["threshold"][node]
        at[inner] = np.where(goes_left, tree["left"][node], tree["right"][node])
