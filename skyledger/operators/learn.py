"""Models on the tables: severe-delay reranker (Spark ML) and a delay forecaster."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.expr import (
    DELAY_EDGES, SEVERE_MINUTES, clip, ratio, signed_expm1, signed_log1p, threshold_column, tier_order,
)
from skyledger.operators.evaluate import best_threshold, linspace, sweep
from skyledger.plans.staging import stage

# Names that files and tables share.
NUMERIC = [
    "pred", "pred_abs", "pred_clip", "severe_prob", "pred_minus_120", "pred_minus_240", "pred_minus_720",
    "sev_x_pred", "sev_x_pred120", "sev_x_h6", "pred_ge_120", "pred_ge_240", "pred_ge_720",
    "dep_hour", "dep_dow", "dep_month",
]
CATEGORICAL = ["horizon_h", "pred_bucket_idx", "Operating_Airline", "ORIGIN", "DEST", "route"]


def rerank_features(pred: DataFrame, lookup: DataFrame) -> DataFrame:
    """Prediction log with flight metadata and the reranker's features."""
    meta = lookup.select("flight_id", "ORIGIN", "DEST", "Operating_Airline", "dep_datetime")
    p, s = F.col("pred"), F.col("severe_prob")
    flag = lambda t: (p >= t).cast("double")
    part = lambda f: F.coalesce(f(F.col("dep_datetime")), F.lit(-1)).cast("double")
    unk = lambda c: F.coalesce(F.col(c), F.lit("UNK"))
    return pred.join(meta, "flight_id", "left").withColumns({
        "dep_hour": part(F.hour), "dep_dow": part(F.weekday), "dep_month": part(F.month),
        "route": F.concat(unk("ORIGIN"), F.lit("_"), unk("DEST")),
        "pred_bucket_idx": tier_order("pred"),
        **{f"pred_ge_{t}": flag(t) for t in (120, 240, 720)},
        **{f"pred_minus_{t}": F.greatest(p - t, F.lit(0.0)) for t in (120, 240, 720)},
        "sev_x_pred": s * p, "sev_x_pred120": s * flag(120), "sev_x_h6": s * (F.col("horizon_h") == 6).cast("double"),
        "pred_abs": F.abs(p), "pred_clip": clip(p, -60.0, 720.0),
    })


def draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) fixed by the row's key, so that a recomputed task draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)).cast("double") / float(1 << 30)


def training_sample(
    pred: DataFrame, *, severe: float = SEVERE_MINUTES, keep_negatives: float = 0.03, max_rows: int | None = 1_000_000,
    seed: int = 42,
) -> DataFrame:
    """Severe rows and a share of the others, about `max_rows` at most; severe ones fill at most half of a full sample."""
    target = F.coalesce(F.col("actual") >= severe, F.lit(False))
    share, severe_share = keep_negatives, 1.0
    if max_rows is not None:
        n = pred.agg(F.count_if(target).alias("pos"), F.count_if(~target).alias("neg")).head()
        others = min(share * n.neg, max(max_rows - n.pos, max_rows / 2))
        share, severe_share = others / max(n.neg, 1), min(1.0, (max_rows - others) / max(n.pos, 1))
    kept = draw(seed, "flight_id", "snap_idx", "horizon_h") < F.when(target, severe_share).otherwise(share)
    return pred.where(kept).withColumn("target_severe", target.cast("int"))


@dataclass(frozen=True)
class Reranker:
    model: PipelineModel
    fill: dict[str, str]
    threshold: float
    tune_sweep: DataFrame
    full_sweep: DataFrame


def _prepared(features: DataFrame, fill: dict[str, str]) -> DataFrame:
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(fill[c])) for c in CATEGORICAL}
    return features.withColumns({**text, **{c: F.col(c).cast("double") for c in NUMERIC}})


def _fit(features: DataFrame, fill: dict[str, str], max_iter: int) -> PipelineModel:
    n = features.agg(F.count(F.lit(1)).alias("n"), F.sum("target_severe").alias("pos")).head()
    if not n.pos or n.pos == n.n:
        raise ValueError("the sample needs both severe and other rows")
    balanced = F.when(F.col("target_severe") == 1, n.n / (2 * n.pos)).otherwise(n.n / (2 * (n.n - n.pos)))
    rows = _prepared(features, fill).withColumn("weight", balanced)
    full = [f"{c}_f" for c in NUMERIC]
    index, hot = [f"{c}_i" for c in CATEGORICAL], [f"{c}_o" for c in CATEGORICAL]
    stages = [
        Imputer(inputCols=NUMERIC, outputCols=full, strategy="median"),
        VectorAssembler(inputCols=full, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=False, withStd=True),
        # An unseen value gets the extra index, which the encoder then drops: all zeros.
        StringIndexer(inputCols=CATEGORICAL, outputCols=index, handleInvalid="keep"),
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=["scaled", *hot], outputCol="features"),
        LogisticRegression(labelCol="target_severe", weightCol="weight", maxIter=max_iter, regParam=1.0 / n.n, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows)


def rerank_scores(model: PipelineModel, fill: dict[str, str], features: DataFrame) -> DataFrame:
    scored = model.transform(_prepared(features, fill))
    return scored.withColumn("rerank_prob", vector_to_array("probability")[1])


def fit_reranker(
    train: DataFrame, lookup: DataFrame, *, severe: float = SEVERE_MINUTES, keep_negatives: float = 0.03,
    max_rows: int | None = 1_000_000, min_recall: float = 0.08, min_pred_pos: int = 100, seed: int = 42, max_iter: int = 200,
) -> Reranker:
    """Fit on a sample with whole snapshots held out, tune, refit, and set the threshold on the full log."""
    sample = stage(rerank_features(
        training_sample(train, severe=severe, keep_negatives=keep_negatives, max_rows=max_rows, seed=seed), lookup), "rerank")
    modes = sample.agg(*[F.mode(F.col(c).cast("string"), True).alias(c) for c in CATEGORICAL]).head()
    fill = {c: modes[c] or "UNK" for c in CATEGORICAL}
    held_out = F.col("snap_idx") % 5 == 0
    first = _fit(sample.where(~held_out), fill, max_iter)
    tune_sweep = sweep(rerank_scores(first, fill, sample.where(held_out)), linspace(), score="rerank_prob", severe=severe)
    model = _fit(sample, fill, max_iter)
    full_sweep = stage(sweep(
        rerank_scores(model, fill, rerank_features(train, lookup)), linspace(), score="rerank_prob", severe=severe), "sweep")
    best = best_threshold(full_sweep, min_recall=min_recall, min_pred_pos=min_pred_pos).head()
    return Reranker(model, fill, best.threshold, tune_sweep, full_sweep)


def rerank(reranker: Reranker, pred: DataFrame, lookup: DataFrame, *, severe: float = SEVERE_MINUTES) -> DataFrame:
    """Scored log: the original columns, target, rerank_prob and rerank_alert."""
    rows = rerank_scores(reranker.model, reranker.fill, rerank_features(pred, lookup))
    return rows.select(
        "flight_id", "snap_idx", F.col("horizon_h").cast("int").alias("horizon_h"), "pred", "severe_prob", "actual",
        (F.col("actual") >= severe).cast("int").alias("target_severe"), "rerank_prob",
        (F.col("rerank_prob") >= reranker.threshold).alias("rerank_alert"))


def base_comparison(pred: DataFrame, *, severe: float = SEVERE_MINUTES) -> DataFrame:
    """The unranked score at its usual thresholds."""
    return sweep(pred, [0.50, 0.60, 0.70], severe=severe)


def report(scored: DataFrame, reranker: Reranker) -> DataFrame:
    hit, truth = F.col("rerank_alert"), F.col("target_severe") == 1
    tp = F.count_if(hit & truth)
    return scored.agg(
        F.lit(reranker.threshold).alias("tuned_threshold"), ratio(tp, F.count_if(hit)).alias("test_precision"),
        ratio(tp, F.count_if(truth)).alias("test_recall"), F.count_if(hit).alias("test_pred_pos"),
        F.count_if(truth).alias("test_actual_pos"))


# ---------------------------------------------------------------- forecaster


BLOCK_ROWS = 250  # small enough for the 4,096 values that a parquet reader holds at once
TOGETHER = 8  # blocks that one matrix product takes
START_EVERY = 50  # one block in so many gives the classifiers' first weights
START_ROWS = 100  # if they hold so many rows on either side of the threshold


@dataclass(frozen=True)
class Linear:
    """Weights by feature and an intercept."""
    weights: dict[str, float]
    intercept: float

    def score(self) -> Column:
        return functools.reduce(Column.__add__, [F.col(c) * w for c, w in self.weights.items() if w], F.lit(self.intercept))


@dataclass(frozen=True)
class Forecaster:
    features: list[str]
    regressor: Linear
    classifiers: dict[float, Linear]
    constants: dict[float, float]


def _blocks(rows: DataFrame) -> DataFrame:
    """Numbers of the rows behind a one, BLOCK_ROWS rows in one binary value, written once: every pass after that reads plain matrices."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *(c.to_numpy(zero_copy_only=False) for c in b.columns)])
            found = [x[k:k + BLOCK_ROWS].tobytes() for k in range(0, len(x), BLOCK_ROWS)]
            first = [(n + k) % START_EVERY == 0 for k in range(len(found))]
            n += len(found)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.bool_()), pa.array(found, pa.binary())], names=["first", "x"])

    return stage(rows.mapInArrow(pack, "first boolean, x binary"), "forecast-blocks")


def _sums(blocks: DataFrame, width: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of `part`, given the features behind a one, y and z; only sums leave the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                x = np.frombuffer(b"".join(v.as_buffer() for v in b.column(0)[k:k + TOGETHER])).reshape(-1, width)
                total = total + part(x[:, :-2], x[:, -2], x[:, -1])
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    got = blocks.select("x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(got, key=lambda r: r.k)])


def _fit_classifiers(blocks: DataFrame, width: int, varied: list[int], edges: np.ndarray, start: np.ndarray, mean: np.ndarray,
                     scale: np.ndarray, n: float, reg: float, max_iter: int) -> np.ndarray:
    """Newton steps from `start` for all thresholds together, at most `max_iter` passes; a step that does not lower a loss is halved.

    Features are taken as standard scores, whose weights (not the intercept) are penalised. Returns weights of (threshold, one and the features that vary).
    """
    size = len(mean)
    penalty = np.r_[0.0, np.full(size - 1, reg)]
    best, at, least = start.copy(), start.copy(), np.full(len(edges), np.inf)
    left = list(range(len(edges)))
    for _ in range(max_iter):
        weights, limits = at[left], edges[left]

        def part(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
            x = (x[:, varied] - mean) * scale
            m, t = x @ weights.T, y[:, None] >= limits
            e = np.exp(-np.abs(m))
            p = np.where(m >= 0, 1.0, e) / (1 + e)
            loss = (np.maximum(m, 0) - t * m + np.log1p(e)).sum(axis=0)
            bend = p * (1 - p)
            return np.concatenate([loss, ((p - t).T @ x).ravel(), *[(x.T @ (x * bend[:, [k]])).ravel() for k in range(len(limits))]])

        got, count = _sums(blocks, width, part) / n, len(left)
        losses, slopes, bends = got[:count], got[count:count * (1 + size)].reshape(count, size), got[count * (1 + size):].reshape(count, size, size)
        for k, loss, slope, bend in zip(list(left), losses, slopes, bends):
            loss = loss + penalty @ at[k] ** 2 / 2
            if loss > least[k]:
                if loss - least[k] < 1e-12:
                    left.remove(k)
                at[k] = (best[k] + at[k]) / 2
                continue
            best[k], least[k] = at[k], loss
            slope = slope + penalty * at[k]
            step = np.linalg.solve(bend + np.diag(penalty), slope)
            at[k] = at[k] - step
            if slope @ step / 2 < 1e-8:
                best[k] = at[k]
                left.remove(k)
        if not left:
            break
    return best


def fit_forecaster(table: DataFrame, features: list[str], *, max_iter: int = 30) -> Forecaster:
    """Ridge regression of the log delay and one logistic classifier per delay threshold, on labelled rows.

    Stands for the two heads of a forecasting model; a threshold that every or no row
    passes is given its constant probability. The objectives are those of Spark ML's LinearRegression and LogisticRegression
    (penalties 1e-3 and 1e-4 on standardised features). The regression is solved from one pass over the rows, and every later
    pass serves all classifiers.
    """
    rows = table.where("horizon_h is not null and y is not null").na.fill(0.0, features).select(
        *[F.col(c).cast("double") for c in features], F.col("y").cast("double"), signed_log1p("y").cast("double").alias("z"))
    limits = np.array(DELAY_EDGES, float)

    def moments(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.concatenate([(x.T @ x).ravel(), x.T @ z, [z @ z], (y[:, None] >= limits).sum(axis=0)])

    size = len(features) + 1
    blocks, width = _blocks(rows), size + 2
    got = _sums(blocks, width, moments)
    if not len(got):
        raise ValueError("the forecaster needs labelled rows")
    square, cross, rest = got[:size * size].reshape(size, size), got[size * size:size * (size + 1)], got[size * (size + 1):]
    n, counts = square[0, 0], rest[1:]
    mean = square[0] / n
    covariance = square / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    deviation[deviation <= 1e-6 * np.abs(mean)] = 0.0
    scale = np.divide(1.0, deviation, out=np.zeros(size), where=deviation > 0)
    middle = cross[0] / n
    spread = math.sqrt(max(rest[0] / n - middle * middle, 0.0))
    # The penalty counts in units of the label's deviation, as in Spark ML.
    solved = np.linalg.solve(covariance * np.outer(scale, scale) + np.eye(size) * (1e-3 / (spread or 1.0)), (cross / n - mean * middle) * scale) * scale
    linear = lambda names, w, b: Linear(dict(zip(names, map(float, w))), float(b))
    share = counts / n
    split = [k for k, p in enumerate(share) if 0 < p < 1]
    constants = {t: float(p > 0) for t, p in zip(DELAY_EDGES, share) if p in (0, 1)}
    classifiers = {}
    if split:
        # A feature that is the same everywhere has no weight.
        varied = [k for k in range(1, size) if deviation[k] > 0]
        names, edges, odds = [features[k - 1] for k in varied], limits[split], share[split]
        fit = functools.partial(_fit_classifiers, width=width, varied=[0, *varied], mean=np.r_[0.0, mean[varied]], scale=np.r_[1.0, scale[varied]], reg=1e-4, max_iter=max_iter)
        weights = np.zeros((len(edges), len(varied) + 1))
        weights[:, 0] = np.log(odds / (1 - odds))
        # Some blocks bring the weights near; the fit itself is over all of them and ends where their loss does.
        some = stage(blocks.where("first"), "first-blocks")
        tried = _sums(some, width, moments)
        few, passed = tried[0], tried[-len(limits):][split]
        near = np.minimum(passed, few - passed) >= START_ROWS
        if near.any():
            weights[near] = fit(some, edges=edges[near], start=weights[near], n=few)
        for t, w in zip(edges.tolist(), fit(blocks, edges=edges, start=weights, n=n)):
            w[1:] *= scale[varied]
            classifiers[t] = linear(names, w[1:], w[0] - w[1:] @ mean[varied])
    return Forecaster(features, linear(features, solved[1:], middle - solved[1:] @ mean[1:]), classifiers, constants)


def forecast(model: Forecaster, table: DataFrame) -> DataFrame:
    """Prediction log of the labelled rows of `table`."""
    rows = table.where("horizon_h is not null").na.fill(0.0, model.features)
    chance = {t: 1 / (1 + F.exp(-model.classifiers[t].score())) if t in model.classifiers else F.lit(model.constants[t]) for t in DELAY_EDGES}
    rows = rows.select("flight_id", "snap_idx", "snapshot_time", "horizon_h", "y", signed_expm1(F.greatest(
        F.lit(-math.log1p(1440)), F.least(F.lit(math.log1p(2880)), model.regressor.score()))).alias("pred"),
        *[p.alias(threshold_column(t)) for t, p in chance.items()])
    err = F.col("pred") - F.col("y")
    return rows.select(
        "flight_id", "snap_idx", "snapshot_time", "horizon_h", "pred",
        F.col(threshold_column(SEVERE_MINUTES)).alias("severe_prob"), F.col("y").alias("actual"),
        F.abs(err).alias("abs_err"), (err * err).alias("sq_err"), *[threshold_column(t) for t in DELAY_EDGES])
