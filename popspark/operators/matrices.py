"""Operators that need one whole distance matrix: ordination and trees.

Input rows are ``tree`` (which matrix), p1, p2, d. Matrices are worked on side by side, a
task each; a matrix of n labels takes n * n numbers in that task, so n is bounded by
``MOST_LABELS``: a larger one raises, instead of being cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST_LABELS = 3000


def _matrix(part: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    labels = sorted({*part["p1"], *part["p2"]})
    if len(labels) > MOST_LABELS:
        raise ValueError(f"a matrix of {len(labels)} labels; the bound is {MOST_LABELS}")
    place = {v: i for i, v in enumerate(labels)}
    d = np.zeros((len(labels), len(labels)))
    i, j = part["p1"].map(place).to_numpy(), part["p2"].map(place).to_numpy()
    d[i, j] = d[j, i] = part["d"].to_numpy(float)
    return labels, np.nan_to_num(d, posinf=0.0)


def _tree_kind(pairs: DataFrame) -> str:
    return pairs.schema["tree"].dataType.simpleString()


def _texts(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr("tree", "CAST(p1 AS STRING) AS p1", "CAST(p2 AS STRING) AS p2", "CAST(d AS DOUBLE) AS d")


def pcoa(pairs: DataFrame, most_axes: int = 10) -> DataFrame:
    """tree, label, axes, percent: principal coordinates on the positive eigenvalues; each axis' largest loading is positive."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        labels, d = _matrix(part)
        b = -0.5 * d**2
        b = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
        values, vectors = np.linalg.eigh(b)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        keep = np.flatnonzero(values > 1e-10)[:most_axes]
        axes = vectors[:, keep] * np.sqrt(values[keep])
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(keep))]) if len(keep) else axes
        share = 100 * values[keep] / values[values > 1e-10].sum() if len(keep) else np.empty(0)
        return pd.DataFrame({"tree": part["tree"].iloc[0], "label": labels, "axes": axes.tolist(), "percent": [share.tolist()] * len(labels)})

    return _texts(pairs).groupBy("tree").applyInPandas(run, f"tree {_tree_kind(pairs)}, label string, axes array<double>, percent array<double>")


def neighbour_joining(pairs: DataFrame) -> DataFrame:
    """tree, newick: Saitou and Nei's tree; of equal criteria the first pair in label order joins, negative branches become 0."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(part)
        while len(names) > 2:
            n = len(names)
            total = d.sum(0)
            q = (n - 2) * d - total - total[:, None]
            q[np.tril_indices(n)] = np.inf
            i, j = np.unravel_index(q.argmin(), q.shape)
            a = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
            a, b = (0.0, d[i, j]) if a < 0 else (d[i, j], 0.0) if a > d[i, j] else (a, d[i, j] - a)
            new = (d[i] + d[j] - d[i, j]) / 2
            keep = [k for k in range(n) if k not in (i, j)]
            d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
            names = [*(names[k] for k in keep), f"({names[i]}:{round(float(a), 10)},{names[j]}:{round(float(b), 10)})"]
        half = round(float(d[0, 1]) / 2, 10) if len(names) == 2 else 0.0
        text = f"({names[0]}:{half},{names[1]}:{half});" if len(names) == 2 else f"{names[0]};"
        return pd.DataFrame({"tree": [part["tree"].iloc[0]], "newick": [text]})

    return _texts(pairs).groupBy("tree").applyInPandas(run, f"tree {_tree_kind(pairs)}, newick string")


def upgma(pairs: DataFrame) -> DataFrame:
    """tree, newick: average linkage; of equal distances the first pair in label order joins."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(part)
        size, height = [1] * len(names), [0.0] * len(names)
        while len(names) > 1:
            n = len(names)
            masked = d.copy()
            masked[np.tril_indices(n)] = np.inf
            i, j = np.unravel_index(masked.argmin(), masked.shape)
            h = float(d[i, j]) / 2
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            keep = [k for k in range(n) if k not in (i, j)]
            text = f"({names[i]}:{round(h - height[i], 10)},{names[j]}:{round(h - height[j], 10)})"
            d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
            names, size, height = [*(names[k] for k in keep), text], [*(size[k] for k in keep), size[i] + size[j]], [*(height[k] for k in keep), h]
        return pd.DataFrame({"tree": [part["tree"].iloc[0]], "newick": [f"{names[0]};"]})

    return _texts(pairs).groupBy("tree").applyInPandas(run, f"tree {_tree_kind(pairs)}, newick string")
