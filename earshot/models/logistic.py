"""Logistic regression by Newton steps: a pass over the rows adds up loss, slopes and curvature of one or several models.

A quasi-Newton solver needs some dozens of passes and keeps the rows in memory for them. A Newton step needs one, half a dozen
reach the optimum, and rows may be read from where they are stored. What a pass leaves is a square of the number of features.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, functions as F

_NEAR = 1e-13  # what the next step would gain in mean loss: then it is the last


@dataclass
class Part:
    """One model to fit: which fold it leaves out, how its features are scaled, weights of the classes 0 and 1, its penalty, its rows."""

    left_out: int | None
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[float, float]
    penalty: float
    n: int


def _added(rows: DataFrame, features: list[str], label: str, parts: list[Part], points: dict[int, np.ndarray], fold: str | None):
    """By number of the part: mean loss without penalty, slopes and curvature at its point, whose first entry is the intercept."""
    p = len(features)
    known = {i: (parts[i].left_out, parts[i].mean, parts[i].scale, *parts[i].weights, b) for i, b in points.items()}  # plain values for the tasks

    def add(batches):
        sums = {i: np.zeros(1 + (p + 1) + (p + 1) ** 2) for i in known}
        for batch in batches:
            x = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(p)])
            y = batch.column(p).to_numpy(zero_copy_only=False)
            own = batch.column(p + 1).to_numpy(zero_copy_only=False)
            for i, (left_out, mean, scale, light, heavy, b) in known.items():
                used = slice(None) if left_out is None else own != left_out
                z, t = (x[used] - mean) / scale, y[used]
                margin = z @ b[1:] + b[0]
                weight = np.where(t == 1, heavy, light)
                chance = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                miss, bend = weight * (chance - t), weight * chance * (1 - chance)
                bent = z * bend[:, None]
                curve = np.empty((p + 1, p + 1))
                curve[0, 0], curve[0, 1:], curve[1:, 1:] = bend.sum(), bent.sum(0), bent.T @ z
                curve[1:, 0] = curve[0, 1:]
                loss = (weight * (np.logaddexp(0, margin) - t * margin)).sum()
                sums[i] += np.concatenate([[loss, miss.sum()], z.T @ miss, curve.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                         names=["part", "sums"])

    narrow = rows.select(*(F.col(f"`{f}`").cast("double").alias(f"x{j}") for j, f in enumerate(features)), F.col(label).cast("double").alias("y"),
                         (F.lit(-1) if fold is None else F.col(fold)).cast("double").alias("fold"))
    found = (narrow.mapInArrow(add, "part int, sums array<double>").select("part", F.posexplode("sums").alias("at", "v"))
             .groupBy("part", "at").agg(F.sum("v").alias("v")).collect())
    out = {i: np.zeros(1 + (p + 1) + (p + 1) ** 2) for i in known}
    for r in found:
        out[r["part"]][r["at"]] = r["v"] / parts[r["part"]].n
    return {i: (v[0], v[1:p + 2], v[p + 2:].reshape(p + 1, p + 1)) for i, v in out.items()}


def fit(rows: DataFrame, features: list[str], label: str, parts: list[Part], max_iter: int, fold: str | None = None) -> list[np.ndarray]:
    """For each part the intercept and the coefficients of its scaled features, all parts in the same passes.

    Labels must be 0 and 1, both in every part. ``rows`` are read once a step, so they should be stored or persisted.
    """
    p = len(features)
    best = [(np.inf, np.zeros(p + 1), None) for _ in parts]
    points = {i: np.zeros(p + 1) for i in range(len(parts))}
    for _ in range(max_iter):
        for i, (loss, slope, curve) in _added(rows, features, label, parts, points, fold).items():
            if not np.isfinite(curve).all() or not np.isfinite(loss):
                raise ValueError("features with missing or infinite values")
            at, pull = points[i], np.full(p + 1, parts[i].penalty)
            pull[0] = 0.0
            loss = loss + (pull * at * at).sum() / 2
            before, start, step = best[i]
            if loss > before + 1e-12 * abs(before):  # too far: half the way
                best[i] = (before, start, step / 2)
                points[i] = start + step / 2
                continue
            slope = slope + pull * at
            step = -np.linalg.lstsq(curve + np.diag(pull), slope, rcond=1e-15)[0]
            best[i] = (loss, at, step)
            points[i] = at + step
            if -slope @ step / 2 <= _NEAR:
                best[i] = (loss, points.pop(i), None)
        if not points:
            break
    return [b for _, b, _ in best]


def as_model(point: np.ndarray) -> LogisticRegressionModel:
    """The fitted numbers as a model of Spark; its columns are to be set."""
    java = JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LogisticRegressionModel", f"newton_{uuid.uuid4().hex[:12]}",
                                     Vectors.dense(point[1:].tolist()), float(point[0]))
    return LogisticRegressionModel(java)
