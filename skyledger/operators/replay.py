"""Day replay: the joined table of a day's predictions and the views read from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.expr import (
    HORIZON_LABELS, SEVERE_MINUTES, TIER_LABELS, alert_order, alert_result, clock, horizon_label, hours_between,
    matches_text, route, tier_label, tier_order,
)
from skyledger.operators.clean import on_date

# Least predicted tier shown by each severity filter.
SEVERITY_FILTERS = {"all": -1, "heavy_plus": 3, "severe_plus": 4, "extreme_plus": 5, "ultra_only": 6}


def day(
    pred: DataFrame, lookup: DataFrame, snapshots: DataFrame, coords: DataFrame, date: str, *, threshold: float = 0.60
) -> DataFrame:
    """Predictions of the flights leaving on `date`, with flight, snapshot, tier and alert columns.

    `snapshots` maps snap_idx to snapshot_time, `coords` holds airport, lat, lon. Rows
    without a snapshot time or without both positions are dropped.
    """
    flights = on_date(lookup, date).select(
        "flight_id", "ORIGIN", "DEST", "dep_datetime", "arr_datetime", "Tail_Number", "Operating_Airline")
    rows = pred.select("flight_id", "snap_idx", "horizon_h", "pred", "severe_prob", "actual", "abs_err", "sq_err")
    at = lambda end, p: coords.select(
        F.col("airport").alias(end), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon")
    ).where(f"{p}_lat is not null and {p}_lon is not null")
    # The inner join keeps the day's flights only: semi-join and lookup in one. A log worked out from flights has several rows for each, which
    # Spark's size estimate does not know; without the hint it would send a log of some hundred MB to every executor through the driver.
    joined = rows.hint("merge").join(flights, "flight_id").join(snapshots.select("snap_idx", "snapshot_time"), "snap_idx").join(
        at("ORIGIN", "origin"), "ORIGIN").join(at("DEST", "dest"), "DEST").where("snapshot_time is not null")
    alert, severe = F.col("severe_prob") >= threshold, F.col("actual") >= SEVERE_MINUTES
    with_tiers = joined.withColumns({
        "pred_tier_order": tier_order("pred"), "actual_tier_order": tier_order("actual"),
        "severe_alert": F.coalesce(alert, F.lit(False)), "actual_severe": F.coalesce(severe, F.lit(False)),
    })
    match = F.coalesce(F.col("pred_tier_order") == F.col("actual_tier_order"), F.lit(False))
    return with_tiers.select(
        "flight_id", "snap_idx", "snapshot_time", F.date_format("snapshot_time", "yyyy-MM-dd HH:mm").alias("snapshot_label"),
        "horizon_h", horizon_label("horizon_h").alias("horizon_label"),
        hours_between("snapshot_time", "dep_datetime").alias("hours_to_departure"),
        "ORIGIN", "DEST", route("ORIGIN", "DEST").alias("route"), "dep_datetime", clock("dep_datetime").alias("dep_time_label"),
        "arr_datetime", clock("arr_datetime").alias("arr_time_label"), "Tail_Number", "Operating_Airline",
        "pred", tier_label("pred_tier_order").alias("pred_tier"), "pred_tier_order", "severe_prob", "severe_alert",
        "actual", tier_label("actual_tier_order").alias("actual_tier"), "actual_tier_order", "actual_severe",
        "abs_err", "sq_err", match.alias("tier_match"),
        F.when(match, "Exact Tier Match").otherwise("Tier Miss").alias("correctness"),
        alert_result(F.col("severe_alert"), F.col("actual_severe")).alias("alert_result"),
        "origin_lat", "origin_lon", "dest_lat", "dest_lon",
    )


def write_day(table: DataFrame, path: str) -> None:
    """One folder per day of departure, sorted by snapshot and severity inside the files."""
    out = table.withColumn("replay_date", F.to_date("dep_datetime"))
    order = ["snapshot_time", F.desc("pred_tier_order"), F.desc("severe_prob")]
    out.repartitionByRange("replay_date", "snapshot_time", "flight_id").sortWithinPartitions(
        "replay_date", *order).write.mode("overwrite").partitionBy("replay_date").parquet(path)


def snapshot_numbers(table: DataFrame) -> DataFrame:
    """Snapshots of the day in time order, from 0: one row per hour."""
    times = table.select("snapshot_time", "snapshot_label").distinct()
    return times.withColumn("snap_id", F.row_number().over(Window.orderBy("snapshot_time")) - 1)


def snapshot_summary(table: DataFrame) -> DataFrame:
    yes = lambda c: F.sum(F.col(c).cast("long"))
    per = table.groupBy("snapshot_time", "snapshot_label").agg(
        F.count("flight_id").alias("flights"), yes("severe_alert").alias("severe_alerts"),
        yes("actual_severe").alias("severe_actuals"), yes("tier_match").alias("exact_tier_matches"),
        F.avg("abs_err").alias("mean_abs_err"), F.avg("pred").alias("mean_pred"), F.max("severe_prob").alias("max_severe_prob"))
    numbered = per.withColumn("snap_id", F.row_number().over(Window.orderBy("snapshot_time")) - 1)
    n = F.col("flights")
    return numbered.withColumns({
        "tier_match_rate": F.col("exact_tier_matches") / n, "severe_alert_rate": F.col("severe_alerts") / n})


def kpis(table: DataFrame, *, severity: str = "all") -> DataFrame:
    """Headline numbers per snapshot under a severity filter."""
    rows = table.where(F.col("pred_tier_order") >= SEVERITY_FILTERS[severity])
    tp, fp = F.count_if(F.col("alert_result") == "TP"), F.count_if(F.col("alert_result") == "FP")
    return rows.groupBy("snapshot_time").agg(
        F.count(F.lit(1)).alias("visible"), F.count_if("severe_alert").alias("alerts"),
        F.avg(F.col("tier_match").cast("double")).alias("tier_accuracy"), F.avg("abs_err").alias("mean_abs_err"),
        F.avg("pred").alias("mean_pred"),
        F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0)).alias("alert_precision"))


# Named sort orders; every one ends with the flight and snapshot so that pages are stable.
_TAIL = ["flight_id", "snapshot_time"]
SORTS = {
    "severity": [F.desc, "pred_tier_order", F.desc, "severe_prob", F.desc, "pred"],
    "severe_prob_desc": [F.desc, "severe_prob", F.desc, "pred"],
    "abs_err_desc": [F.desc, "abs_err", F.desc, "pred"],
    "actual_desc": [F.desc, "actual", F.desc, "pred"],
    "route_az": [F.asc, "route", F.desc, "pred"],
    "airline_az": [F.asc, "Operating_Airline", F.asc, "route"],
}


def _order(name: str):
    spec = SORTS.get(name, SORTS["severity"])
    return [spec[i](spec[i + 1]) for i in range(0, len(spec), 2)] + [F.asc(c) for c in _TAIL]


def _behind(sort: str, seen: Mapping[str, object]) -> Column:
    """Rows that a sort order puts behind the row with those values; nulls come first ascending and last descending."""
    spec = SORTS.get(sort, SORTS["severity"])
    parts = [(spec[i + 1], spec[i] is F.asc) for i in range(0, len(spec), 2)] + [(c, True) for c in _TAIL]
    found, same = F.lit(False), F.lit(True)
    for name, rising in parts:
        c, v = F.col(name), seen[name]
        if v is None:
            beyond = c.isNotNull() if rising else F.lit(False)
        else:
            beyond = c > F.lit(v) if rising else (c < F.lit(v)) | c.isNull()
        found = found | (same & F.coalesce(beyond, F.lit(False)))
        same = same & c.eqNullSafe(F.lit(v))
    return found


def browse(
    table: DataFrame, *, snapshot=None, horizon: int | None = None, severity: str = "all", search: str = "",
    sort: str = "severity", after: Mapping[str, object] | None = None, page_size: int | None = None,
) -> DataFrame:
    """Filtered, sorted and optionally paged rows.

    `after` holds the sort columns of the last row seen: the next page is a filter and a top-k of one page, however deep it is.
    """
    rows = table
    if snapshot is not None:
        rows = rows.where(F.col("snapshot_time") == F.lit(snapshot).cast("timestamp_ntz"))
    if horizon is not None:
        rows = rows.where(F.col("horizon_h") == horizon)
    if SEVERITY_FILTERS[severity] >= 0:
        rows = rows.where(F.col("pred_tier_order") >= SEVERITY_FILTERS[severity])
    if search:
        rows = rows.where(matches_text(search.strip(), "flight_id", "Operating_Airline", "Tail_Number", "route"))
    if after is not None:
        rows = rows.where(_behind(sort, after))
    rows = rows.orderBy(*_order(sort))
    return rows.limit(page_size) if page_size else rows


def top_per_snapshot(table: DataFrame, k: int = 45) -> DataFrame:
    """The k most severe rows of each snapshot.

    Spark keeps k rows per snapshot in every task before the exchange, so a large
    snapshot is not sent whole to one task.
    """
    w = Window.partitionBy("snapshot_time").orderBy(
        F.desc("pred_tier_order"), F.desc("severe_prob"), F.desc("abs_err"), "flight_id")
    return table.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def airport_rollup(table: DataFrame) -> DataFrame:
    """Per snapshot and origin: rows, worst tier, worst alert and tier misses."""
    return table.groupBy("snapshot_time", "ORIGIN").agg(
        F.count(F.lit(1)).alias("flights"), F.max("pred_tier_order").alias("max_tier_order"),
        F.min(alert_order("alert_result")).alias("worst_alert_order"),
        F.sum((~F.col("tier_match")).cast("long")).alias("mismatches"))


def compact(table: DataFrame, numbers: DataFrame) -> DataFrame:
    """Short-named, rounded rows for a web client; `numbers` comes from `snapshot_numbers`."""
    rows = table.join(numbers.select("snapshot_time", "snap_id"), "snapshot_time")
    r = lambda c, d: F.bround(c, d)
    return rows.select(
        F.col("snap_id").alias("snap"), F.col("flight_id").alias("f"), F.col("ORIGIN").alias("o"), F.col("DEST").alias("d"),
        F.col("dep_time_label").alias("dep"), F.col("arr_time_label").alias("arr"), F.col("Tail_Number").alias("tail"),
        F.col("Operating_Airline").alias("air"), F.col("horizon_h").alias("h"), r("hours_to_departure", 2).alias("h2d"),
        r("pred", 1).alias("p"), F.col("pred_tier_order").alias("po"), r("severe_prob", 3).alias("sp"),
        F.col("severe_alert").alias("sa"), r("actual", 1).alias("a"), F.col("actual_tier_order").alias("ao"),
        r("abs_err", 1).alias("ae"), F.col("tier_match").alias("tm"), F.col("alert_result").alias("ar"),
        alert_order("alert_result").alias("alert_order"),
    )


def expand(rows: DataFrame, coords: DataFrame) -> DataFrame:
    """Compact rows back to labelled ones."""
    at = lambda end, p: coords.select(F.col("airport").alias(end), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    return rows.join(at("o", "origin"), "o", "left").join(at("d", "dest"), "d", "left").select(
        "snap", F.col("f").alias("flight_id"), F.col("o").alias("origin"), F.col("d").alias("dest"), route("o", "d").alias("route"),
        "dep", "arr", "tail", F.col("air").alias("airline"), F.col("h").alias("horizon"), horizon_label("h").alias("horizon_label"),
        F.col("h2d").alias("hours_to_departure"), F.col("p").alias("pred"), tier_label("po").alias("pred_tier"),
        F.col("po").alias("pred_tier_order"), F.col("sp").alias("severe_prob"), F.col("sa").alias("severe_alert"),
        F.col("a").alias("actual"), tier_label("ao").alias("actual_tier"), F.col("ao").alias("actual_tier_order"),
        (F.col("a") >= SEVERE_MINUTES).alias("actual_severe"), F.col("ae").alias("abs_err"), F.col("tm").alias("tier_match"),
        F.when(F.col("tm"), "Exact Tier Match").otherwise("Tier Miss").alias("correctness"),
        F.when(F.col("tm"), 0).otherwise(1).alias("correctness_order"), F.col("ar").alias("alert_result"), "alert_order",
        "origin_lat", "origin_lon", "dest_lat", "dest_lon",
    )


def bundle_meta(table: DataFrame, date: str, split: str, threshold: float, *, title: str = "Delays of one day") -> DataFrame:
    """The head of the exported bundle as one JSON document: labels, positions, snapshot summaries.

    Only lists that grow with hours and airports are collected into it; the rows
    themselves are written separately (see `write_bundle`).
    """
    ends = F.array(
        F.struct(F.col("ORIGIN").alias("airport"), F.col("origin_lat").alias("lat"), F.col("origin_lon").alias("lon")),
        F.struct(F.col("DEST").alias("airport"), F.col("dest_lat").alias("lat"), F.col("dest_lon").alias("lon")))
    places = table.select(F.explode(ends).alias("e")).select("e.*").groupBy("airport").agg(
        F.array(F.bround(F.first("lat"), 4), F.bround(F.first("lon"), 4)).alias("xy"))
    coords = places.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("airport", "xy")))).alias("m"))
    s = snapshot_summary(table)
    entry = F.struct(
        F.col("snap_id").alias("snap"), F.col("snapshot_label").alias("snapshotLabel"), "flights",
        F.col("severe_alerts").alias("severeAlerts"), F.col("severe_actuals").alias("severeActuals"),
        F.col("exact_tier_matches").alias("exactTierMatches"), F.bround("mean_abs_err", 2).alias("meanAbsErr"),
        F.bround("mean_pred", 2).alias("meanPred"), F.bround("max_severe_prob", 3).alias("maxSevereProb"),
        F.bround("tier_match_rate", 4).alias("tierMatchRate"), F.bround("severe_alert_rate", 4).alias("severeAlertRate"))
    head = s.agg(
        F.sort_array(F.collect_list(entry)).alias("snapshotSummary"), F.sum("flights").alias("rows"),
        F.count(F.lit(1)).alias("snapshots"))
    labels = [F.lit(x) for x in TIER_LABELS]
    horizons = [F.lit(str(x)) for kv in HORIZON_LABELS.items() for x in kv]
    meta = F.struct(
        F.lit(title).alias("title"), F.lit(date).alias("date"), F.lit(split).alias("split"),
        F.lit(threshold).alias("severeThreshold"), "rows", "snapshots", F.array(*labels).alias("tierLabels"),
        F.create_map(*horizons).alias("horizonLabels"), coords.select("m").scalar().alias("airportCoords"))
    doc = F.struct(
        meta.alias("meta"), F.transform("snapshotSummary", lambda x: x["snapshotLabel"]).alias("snapshotTimes"), "snapshotSummary")
    return head.select(F.to_json(doc).alias("document"))


def write_bundle(table: DataFrame, path: str, date: str, split: str, threshold: float) -> None:
    """meta/ holds the head document, rows/ the compact rows as JSON lines per snapshot."""
    bundle_meta(table, date, split, threshold).write.mode("overwrite").text(f"{path}/meta")
    rows = compact(table, snapshot_numbers(table))
    rows.sortWithinPartitions("snap", F.desc("po"), F.desc("p")).write.mode("overwrite").partitionBy("snap").json(f"{path}/rows")
