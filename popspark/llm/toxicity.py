"""Toxicity by a classifier chain.

Categories are predicted one after the other; each later linear model sees the text's
words and the probabilities of all earlier categories. While training, those
probabilities are out of fold: a labelled document gets them from a model fitted on the
other folds, so a later model meets the quality of predictions that it will meet
in use. For scoring, every category's model is fitted once more on all rows taken.

Features are the distinct words of the whole text (case folded) and their beginnings of
four and six letters, hashed. A model is a
logistic regression with an L1 penalty, which drops the words that carry no
signal. The models of one category (one per fold and one on all rows) are fitted side
by side, a task each, on the bounded sample.

Training takes at most ``MAX_LABELLED`` labelled documents, those with the smallest hash
of doc_id, so the choice depends on neither order nor partitioning; scoring covers
every document. Null texts are empty and have no features; labels without a
document or with a null category aren't used; repeated labels of a doc_id count as
rows. A category of one class gets the share of positives (0 without labels). Extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import stored

#: Bound of the training sample, in documents.
MAX_LABELLED = 10_000
FEATURES = 1 << 18
BEGINNINGS = (4, 6)
FOLDS = 3
PENALTY = 0.0005
STEPS = 200
SEED = 20

WORD = re.compile(r"[^\W_]+")


def slot(word: str) -> int:
    return zlib.crc32(word.encode()) % FEATURES


@lru_cache(maxsize=300_000)
def slots_of(word: str) -> tuple[int, ...]:
    return (slot(word), *(slot(f"{word[:n]}*") for n in BEGINNINGS if len(word) > n))


def features(text: str | None) -> list[int]:
    found: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        found.update(slots_of(w))
    return sorted(found)


def sampled(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, fold, slots and the categories of at most ``most`` labelled documents, written once."""
    usable = labels.select("doc_id", *[F.col(c).cast("double").alias(c) for c in categories]).dropna()
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", *categories).limit(most)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int").alias("fold")
    # ``most`` rows of a few numbers: this side is small by its limit.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", fold, *categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [features(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(slots, pa.list_(pa.int32())), *b.columns[3:]], names=["doc_id", "fold", "slots", *categories])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = rows.mapInArrow(run, ", ".join([f"doc_id {kind}, fold int, slots array<int>", *[f"`{c}` double" for c in categories]]))
    # Documents that share a doc_id have its labels each, so the rows are bounded once more after the join.
    return stored(read.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", *[f"`{c}`" for c in categories], F.xxhash64("slots")).limit(most), "labelled")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fitted(slots: list[np.ndarray], more: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the slots, weights of the columns of ``more``, and bias: accelerated proximal gradient on the mean log loss."""
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(FEATURES), np.zeros(more.shape[1]), 40.0 if share else -40.0
    # A slot of c rows has a slope of c / n at most, so below the penalty its weight stays 0: it needn't be looked at.
    counts = np.bincount(np.concatenate([*slots, np.empty(0, np.int64)]).astype(np.int64), minlength=FEATURES)
    useful = counts > penalty * n
    slots = [s[useful[s]] for s in slots]
    size = np.array([len(s) for s in slots])
    flat, row = np.concatenate([*slots, np.empty(0, np.int32)]).astype(np.int64), np.repeat(np.arange(n), size)
    w, bias = np.zeros(FEATURES + more.shape[1]), np.log(share / (1 - share))
    seen, t, past = w.copy(), 1.0, bias
    at_bias = bias
    # A step per coordinate, from its scaled share of rows: frequent words take short steps.
    curve = np.sqrt(np.bincount(flat, minlength=FEATURES) / n)
    total = np.bincount(row, weights=curve[flat], minlength=n)
    step_of = np.concatenate([1 / np.maximum(curve * max(1.0, total.max()) * 0.25, 1e-9), np.full(more.shape[1], 0.25)])
    for _ in range(steps):
        margin = np.bincount(row, weights=seen[flat], minlength=n) + more @ seen[FEATURES:] + at_bias
        rest = (sigmoid(margin) - y) / n
        slope = np.concatenate([np.bincount(flat, weights=rest[row], minlength=FEATURES), more.T @ rest])
        new = seen - step_of * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step_of * np.concatenate([np.full(FEATURES, penalty), np.zeros(more.shape[1])]), 0)
        new_bias = at_bias - rest.sum() / 0.5
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen, at_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - past)
        w, past, t = new, new_bias, t_new
    return w[:FEATURES], w[FEATURES:], float(past)


class Model:
    def __init__(self, slots: list[int], weights: list[float], more: list[float], bias: float):
        self.weight_of, self.more, self.bias = dict(zip(slots, weights)), more, bias

    def probability(self, slots: list[int], earlier: list[float]) -> float:
        known = self.weight_of
        margin = self.bias + sum(known[s] for s in slots if s in known) + sum(w * p for w, p in zip(self.more, earlier))
        return float(sigmoid(np.array(margin)))


def fit_models(rows: DataFrame, category: str, earlier: list[str]) -> list[Model]:
    """One model per fold, fitted on the other folds, and one on all rows, each in a task of its own.

    Rows are the bounded sample, so a group is bounded too; only non-zero weights return.
    """
    which = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.col("fold"))
    each = rows.select("doc_id", "slots", F.col(category).alias("y"), F.array(*[F.col(f"p_{c}") for c in earlier]).cast("array<double>").alias("more"), F.explode(which).alias("model"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable", na_position="last")
        more = np.array(part["more"].tolist(), float).reshape(len(part), len(earlier))
        w, v, bias = fitted([np.asarray(s, np.int64) for s in part["slots"]], more, part["y"].to_numpy(float))
        at = np.flatnonzero(w)
        return pd.DataFrame({"model": [int(part["model"].iloc[0])], "slots": [at.tolist()], "weights": [w[at].tolist()], "more": [v.tolist()], "bias": [bias]})

    out = each.groupBy("model").applyInPandas(run, "model int, slots array<int>, weights array<double>, more array<double>, bias double")
    found = {r["model"]: Model(r["slots"], r["weights"], r["more"], r["bias"]) for r in out.collect()}
    return [found.get(m, Model([], [], [0.0] * len(earlier), -40.0)) for m in range(FOLDS + 1)]


def best_threshold(rows: DataFrame, category: str) -> float:
    """The out-of-fold probability, in hundredths, from which F1 is largest; 0.5 without positives."""
    cut = F.floor(F.col(f"p_{category}") * 100)
    counts = sorted(((r[0], r[1], r[2]) for r in rows.groupBy(cut).agg(F.sum(category), F.count("*")).collect()), reverse=True)
    every, hit, taken, best = sum(c[1] for c in counts), 0.0, 0, (0.0, 0.5)
    for at, good, n in counts:
        hit, taken = hit + good, taken + n
        if at > 0:
            best = max(best, (2 * hit / (every + taken), at / 100), key=lambda x: x[0])
    return best[1]


class Chain:
    """The models of each category in order, and their thresholds."""

    def __init__(self, rows: DataFrame, categories: list[str]):
        self.categories, self.models, self.thresholds = categories, [], {}
        for k, c in enumerate(categories):
            models = fit_models(rows, c, categories[:k])
            self.models.append(models[FOLDS])
            rows = stored(self._out_of_fold(rows, c, categories[:k], models), f"fold-{k}")
            self.thresholds[c] = best_threshold(rows, c)
        self.out_of_fold = rows

    @staticmethod
    def _out_of_fold(rows: DataFrame, category: str, earlier: list[str], models: list[Model]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                before = list(zip(*(b.column(f"p_{c}").to_pylist() for c in earlier))) or [()] * b.num_rows
                p = [models[f].probability(s, list(e)) for f, s, e in zip(b.column("fold").to_pylist(), b.column("slots").to_pylist(), before)]
                yield pa.record_batch([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, f"p_{category}"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{fields}, `p_{category}` double")

    def scored(self, docs: DataFrame) -> DataFrame:
        """doc_id and p_<category> of each, for every document."""
        models, names = self.models, ["doc_id", *(f"p_{c}" for c in self.categories)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for t in b.column(1):
                    slots, p = features(t.as_py()), []
                    for m in models:
                        p.append(m.probability(slots, p))
                    rows.append(p)
                cols = list(zip(*rows)) or [()] * len(models)
                yield pa.record_batch([b.column(0), *(pa.array(c, pa.float64()) for c in cols)], names=names)

        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"`{n}` double" for n in names[1:]]]))


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """doc_id, p_<category> of each, and <last category> as a boolean, for every document."""
    chain = Chain(sampled(docs, labels, categories), categories)
    last = categories[-1]
    rows = chain.scored(docs)
    return rows.select("doc_id", *[f"p_{c}" for c in categories], (F.col(f"p_{last}") >= chain.thresholds[last]).alias(last))
