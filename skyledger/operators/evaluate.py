"""Metrics over a prediction log (one row per flight, snapshot and band)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.expr import (
    DELAY_EDGES, SEVERE_MINUTES, bucket_masses, ratio, signed_log1p, step_index, threshold_column, tier_label,
    tier_order,
)

BANDS = [0, 1, 3, 6]
BAND_WEIGHTS = {0: 0.10, 1: 0.20, 3: 0.30, 6: 0.40}
HUBER_DELTA = 20.0


def with_errors(pred: DataFrame) -> DataFrame:
    err = F.col("pred") - F.col("actual")
    return pred.withColumns({"abs_err": F.abs(err), "sq_err": err * err})


def _mae() -> Column:
    return F.avg("abs_err").alias("mae")


def _rmse() -> Column:
    return F.sqrt(F.avg("sq_err")).alias("rmse")


def overall(pred: DataFrame) -> DataFrame:
    return pred.agg(_mae(), _rmse(), F.count(F.lit(1)).alias("n"))


def bands(pred: DataFrame) -> DataFrame:
    """MAE, RMSE and count per forecast band."""
    return pred.groupBy("horizon_h").agg(_mae(), _rmse(), F.count(F.lit(1)).alias("n"))


def severity(pred: DataFrame, *, horizon: int | None = 6) -> DataFrame:
    """MAE per actual-delay tier, by default of the 6 h band."""
    rows = pred if horizon is None else pred.where(F.col("horizon_h") == horizon)
    return rows.where("actual is not null").groupBy(tier_order("actual").alias("tier")).agg(
        _mae(), F.count(F.lit(1)).alias("n")
    ).withColumn("tier_label", tier_label("tier"))


def error_by_actual_delay(pred: DataFrame, model: str) -> DataFrame:
    """Count, MAE, RMSE, bias and means per actual-delay bucket."""
    names = ["<0", "0-15", "15-60", "60-120", "120-240", "240-720", "720+"]
    rows = pred.where("actual is not null").groupBy(tier_order("actual").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), _mae(), _rmse(), F.avg(F.col("pred") - F.col("actual")).alias("mean_signed_err"),
        F.avg("actual").alias("mean_actual"), F.avg("pred").alias("mean_pred"))
    bucket = F.try_element_at(F.array(*[F.lit(x) for x in names]), F.col("b") + 1)
    return rows.select(bucket.alias("actual_bucket"), "n", "mae", "rmse", "mean_signed_err", "mean_actual",
                       "mean_pred", F.lit(model).alias("model"))


def detection(pred: DataFrame, *, severe: float = SEVERE_MINUTES, prob: float = 0.5) -> DataFrame:
    """Precision and recall of both severe-delay rules, over all rows and the 6 h band: one pass."""
    truth = F.col("actual") >= severe
    rules = {"regression": F.col("pred") >= severe, "classifier": F.col("severe_prob") >= prob}
    scopes = {"all": F.lit(True), "6h": F.col("horizon_h") == 6}
    sums = {}
    for scope, inside in scopes.items():
        for rule, hit in rules.items():
            for name, cond in (("tp", truth & hit), ("fp", ~truth & hit), ("fn", truth & ~hit)):
                sums[f"{scope}_{rule}_{name}"] = F.count_if(inside & cond)
    row = pred.agg(*[v.alias(k) for k, v in sums.items()])
    cells = F.array(*[
        F.struct(F.lit(s).alias("scope"), F.lit(r).alias("rule"),
                 *[F.col(f"`{s}_{r}_{k}`").alias(k) for k in ("tp", "fp", "fn")])
        for s in scopes for r in rules
    ])
    return _rates(row.select(F.explode(cells).alias("c")).select("c.*"), ["scope", "rule"])


def _rates(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keys, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        (tp + fp).alias("pred_pos"), (tp + fn).alias("actual_pos"), "tp", "fp", "fn")


def sweep(
    pred: DataFrame, thresholds: Sequence[float], *, score: str = "severe_prob", severe: float = SEVERE_MINUTES,
    horizon: int | None = None,
) -> DataFrame:
    """tp, fp, fn, precision and recall at every threshold (score >= threshold is a hit).

    Rows are counted once by the number of thresholds they reach; the counts per
    threshold are running sums over that table of len(thresholds)+1 rows. The log is
    read once however many thresholds there are.
    """
    edges = sorted(set(float(t) for t in thresholds))
    rows = pred if horizon is None else pred.where(F.col("horizon_h") == horizon)
    truth = F.coalesce(F.col("actual") >= severe, F.lit(False))
    reached = F.coalesce(step_index(score, edges), F.lit(0))
    counts = rows.groupBy(reached.alias("reached")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("q"))
    spark = pred.sparkSession
    # All bins are present, so a bin nobody falls into still gives its threshold a row.
    bins = spark.createDataFrame(
        [(i, edges[i - 1] if i else None) for i in range(len(edges) + 1)], "reached int, threshold double")
    full = bins.join(counts, "reached", "left").na.fill(0, ["p", "q"])
    up = Window.orderBy(F.desc("reached")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = full.select(
        "threshold", F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp"), F.sum("p").over(whole).alias("all_p"),
    ).where("threshold is not null").withColumn("fn", F.col("all_p") - F.col("tp"))
    return _rates(table, ["threshold"])


def linspace(lo: float = 0.05, hi: float = 0.95, n: int = 181) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + step * i for i in range(n - 1)] + [hi]


def best_threshold(table: DataFrame, *, min_recall: float = 0.08, min_pred_pos: int = 100) -> DataFrame:
    """The row with best precision among those meeting both minimums, or among all when none does."""
    valid = (F.col("recall") >= min_recall) & (F.col("pred_pos") >= min_pred_pos)
    return table.orderBy(
        F.desc(valid), F.desc("precision"), F.desc("recall"), F.desc("pred_pos"), "threshold").limit(1)


def checkpoint_score(pred: DataFrame) -> DataFrame:
    """Band MAEs, their weighted composite and the overall MAE; an empty band counts as 0."""
    mae = {h: F.coalesce(F.avg(F.when(F.col("horizon_h") == h, F.col("abs_err"))), F.lit(0.0)) for h in BANDS}
    row = pred.where(F.col("horizon_h").isin(BANDS)).agg(
        *[mae[h].alias(f"mae_{h}h") for h in BANDS], F.coalesce(F.avg("abs_err"), F.lit(0.0)).alias("overall"))
    composite = F.lit(0.0)
    for h, w in ((6, 0.50), (3, 0.30), (1, 0.15), (0, 0.05)):
        composite = composite + F.lit(w) * F.col(f"mae_{h}h")
    return row.withColumn("composite", composite)


def severe_metrics(pred: DataFrame, *, severe: float = SEVERE_MINUTES, prob: float = 0.5) -> DataFrame:
    truth, hit = F.col("actual") >= severe, F.col("severe_prob") >= prob
    row = pred.where("horizon_h is not null").agg(
        F.count_if(truth & hit).alias("tp"), F.count_if(~truth & hit).alias("fp"), F.count_if(truth & ~hit).alias("fn"),
        F.coalesce(F.avg(F.when(truth, F.abs(F.col("pred") - F.col("actual")))), F.lit(0.0)).alias("severe_mae"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return row.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), "severe_mae")


def huber(err: Column, delta: float) -> Column:
    ae = F.abs(err)
    return F.when(ae <= delta, 0.5 * ae * ae / delta).otherwise(ae - 0.5 * delta)


def asymmetric_loss(pred: DataFrame, *, log_space: bool = True, alpha: float = 0.5, top_weight: float = 5.0) -> DataFrame:
    """Severity-weighted asymmetric Huber loss per band and its weighted total.

    `log_space` compares signed log1p values with delta log1p(20), as the log-target model does.
    """
    import math

    delta = math.log1p(HUBER_DELTA) if log_space else HUBER_DELTA
    p, t = (signed_log1p("pred"), signed_log1p("actual")) if log_space else (F.col("pred"), F.col("actual"))
    a = F.col("actual")
    w = F.when(a >= 120, top_weight).when(a >= 60, 3.5).when(a >= 30, 2.0).when(a >= 15, 1.5).otherwise(1.0)
    e = p - t
    side = F.when(e < 0, alpha).otherwise(1 - alpha)
    per = pred.where(F.col("horizon_h").isin(BANDS)).select("horizon_h", (w * side * huber(e, delta)).alias("l"))
    row = per.agg(*[F.avg(F.when(F.col("horizon_h") == h, F.col("l"))).alias(f"loss_{h}h") for h in BANDS])
    total = F.lit(0.0)
    for h in BANDS:
        total = total + F.lit(BAND_WEIGHTS[h]) * F.coalesce(f"loss_{h}h", F.lit(0.0))
    return row.withColumn("flight_loss", total)


def ordinal_loss(pred: DataFrame, *, thresholds: Sequence[float] = DELAY_EDGES, floor: float = 1e-7) -> DataFrame:
    """Weighted sum over bands of the mean binary cross-entropy against the delay thresholds."""
    terms = []
    for t in thresholds:
        p = F.least(F.greatest(F.col(threshold_column(t)), F.lit(floor)), F.lit(1 - floor))
        terms.append(F.when(F.col("actual") >= t, -F.ln(p)).otherwise(-F.ln(1 - p)))
    mean = sum(terms[1:], terms[0]) / len(terms)
    per = pred.where(F.col("horizon_h").isin(BANDS)).select("horizon_h", mean.alias("l"))
    row = per.agg(*[F.avg(F.when(F.col("horizon_h") == h, F.col("l"))).alias(f"bce_{h}h") for h in BANDS])
    total = F.lit(0.0)
    for h in BANDS:
        total = total + F.lit(BAND_WEIGHTS[h]) * F.coalesce(f"bce_{h}h", F.lit(0.0))
    return row.withColumn("class_loss", total)


def airport_loss(airport_pred: DataFrame) -> DataFrame:
    """Mean Huber loss of airport forecasts (pred, y) over known labels."""
    return airport_pred.where("y is not null").agg(
        F.coalesce(F.avg(huber(F.col("pred") - F.col("y"), HUBER_DELTA)), F.lit(0.0)).alias("airport_loss"))


def total_loss(airport: Column, flight: Column, ordinal: Column) -> Column:
    return F.lit(0.25) * airport + F.lit(0.75) * flight + F.lit(0.15) * ordinal


def ordinal_masses(pred: DataFrame, thresholds: Sequence[float] = DELAY_EDGES) -> DataFrame:
    """Threshold probabilities, made monotone, as masses of disjoint delay buckets."""
    return pred.withColumns(bucket_masses([threshold_column(t) for t in thresholds], thresholds))


def trajectory(pred: DataFrame, *, improve: float = 0.6, consistent: float = 0.4) -> DataFrame:
    """How predictions of one flight move from snapshot to snapshot.

    Penalises an error that grows and a jump of the prediction; a flight has at most
    one row per hour of its window.
    """
    w = Window.partitionBy("flight_id").orderBy("snapshot_time")
    steps = pred.where("horizon_h is not null").select(
        "pred", "actual", F.lag("pred").over(w).alias("prev")).where("prev is not null")
    worse = F.greatest(F.abs(F.col("pred") - F.col("actual")) - F.abs(F.col("prev") - F.col("actual")), F.lit(0.0))
    row = steps.agg(
        F.count(F.lit(1)).alias("steps"), F.coalesce(F.avg(worse), F.lit(0.0)).alias("improve_loss"),
        F.coalesce(F.avg(huber(F.col("pred") - F.col("prev"), HUBER_DELTA)), F.lit(0.0)).alias("jump_loss"))
    return row.withColumn("trajectory_loss", improve * F.col("improve_loss") + consistent * F.col("jump_loss"))


def window_scores(scores: DataFrame, size: int) -> DataFrame:
    """Sum of `tail_score` over `size` consecutive snapshots of a split, one row per start.

    When a split has no more than `size` snapshots there is one row with its total.
    Snapshots are hours: a split holds one row per hour.
    """
    w = Window.partitionBy("split").orderBy("snap_idx")
    everything = Window.partitionBy("split")
    ahead = w.rowsBetween(0, size - 1)
    rows = scores.select(
        "split", (F.row_number().over(w) - 1).alias("start"), F.sum("tail_score").over(ahead).alias("window_score"),
        F.count(F.lit(1)).over(everything).alias("n"))
    last = F.greatest(F.col("n") - size, F.lit(0))
    return rows.where(F.col("start") <= last).select("split", "start", "window_score")


def sample_window(windows: DataFrame, *, seed: int = 42) -> DataFrame:
    """One start per split, drawn with probability proportional to window_score + 1.

    The draw is a hash of seed, split and start, so it does not depend on how rows are dealt to tasks.
    """
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "split", F.col("start").cast("string"))), 1, 8), 16, 10).cast("long")
    key = -F.ln(1 - drawn / float(1 << 32)) / (F.col("window_score") + 1)
    return windows.withColumn("__k", key).groupBy("split").agg(
        F.min_by("start", "__k").alias("start"), F.min_by("window_score", "__k").alias("window_score"))


def airline_breakdown(pred: DataFrame, lookup: DataFrame, *, horizon: int = 6, top: int = 10) -> DataFrame:
    """Airlines with most predictions in a band, and their MAE."""
    rows = _counts_by_flight(pred, horizon).join(lookup.select("flight_id", "Operating_Airline"), "flight_id", "left")
    return rows.where("Operating_Airline is not null").groupBy("Operating_Airline").agg(
        (F.sum("err") / F.sum("n")).alias("mae"), F.sum("n").alias("n")
    ).orderBy(F.desc("n"), "Operating_Airline").limit(top)


def route_breakdown(pred: DataFrame, lookup: DataFrame, *, horizon: int = 6, min_flights: int = 100, top: int = 10) -> DataFrame:
    """Routes with the highest MAE in a band among those with enough predictions."""
    rows = _counts_by_flight(pred, horizon).join(lookup.select("flight_id", "ORIGIN", "DEST"), "flight_id", "left")
    return rows.where("ORIGIN is not null and DEST is not null").groupBy("ORIGIN", "DEST").agg(
        (F.sum("err") / F.sum("n")).alias("mae"), F.sum("n").alias("n")
    ).where(F.col("n") >= min_flights).orderBy(F.desc("mae"), "ORIGIN", "DEST").limit(top)


def _counts_by_flight(pred: DataFrame, horizon: int) -> DataFrame:
    """Error sum and count per flight, so that the lookup join carries one row per flight."""
    return pred.where(F.col("horizon_h") == horizon).groupBy("flight_id").agg(
        F.sum("abs_err").alias("err"), F.count("abs_err").alias("n"))


def comparison_row(pred: DataFrame, *, checkpoint: str, split: str, epoch: str = "?", severe: float = SEVERE_MINUTES,
                   with_classifier: bool = True) -> DataFrame:
    """One row of headline metrics, rounded to three digits."""
    truth, hit = F.col("actual") >= severe, F.col("pred") >= severe
    called = F.col("severe_prob") >= 0.5
    r = lambda c: F.bround(c, 3)
    metrics = {"overall_mae": F.avg("abs_err"), "overall_rmse": F.sqrt(F.avg("sq_err"))}
    for h in BANDS:
        inside = F.col("horizon_h") == h
        metrics[f"mae_{h}h"] = F.avg(F.when(inside, F.col("abs_err")))
        metrics[f"rmse_{h}h"] = F.sqrt(F.avg(F.when(inside, F.col("sq_err"))))
    metrics["severe_threshold_min"] = F.lit(severe)
    metrics["severe_reg_precision"] = ratio(F.count_if(truth & hit), F.count_if(hit))
    metrics["severe_reg_recall"] = ratio(F.count_if(truth & hit), F.count_if(truth))
    metrics["severe_mae_6h"] = F.avg(F.when(truth & (F.col("horizon_h") == 6), F.col("abs_err")))
    none = F.lit(None).cast("double")
    metrics["severe_cls_precision"] = ratio(F.count_if(truth & called), F.count_if(called)) if with_classifier else none
    metrics["severe_cls_recall"] = ratio(F.count_if(truth & called), F.count_if(truth)) if with_classifier else none
    return pred.agg(*[r(v).alias(k) for k, v in metrics.items()]).select(
        F.lit(checkpoint).alias("checkpoint"), F.lit(split).alias("split"), F.lit(epoch).alias("epoch"), *metrics)
