"""The batch jobs from files to tables, in the order they depend on each other.

Every job reads tables, writes tables and returns nothing, so any of them can be run
again after a failure. Between jobs the tables are the only state; what a job stages
for itself is removed when it ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import clean, congestion, evaluate, learn, network, priors, quality, replay, rotation, snapshots, weather
from skyledger.plans.staging import scoped
from skyledger.sources import flights as flight_files
from skyledger.sources import sinks
from skyledger.sources.schemas import ROTATION
from skyledger.sources.weather import read_weather


@dataclass(frozen=True)
class Folder:
    """Where the tables of one build live."""

    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


@scoped
def ingest_flights(spark: SparkSession, paths: Iterable[str], out: str, *, layout: str = "yearly") -> None:
    """On-time CSV files to the flights table, numbered in departure order, one folder per year."""
    raw = flight_files.read_csv_files(spark, paths)
    cleaned = {"yearly": clean.flights, "strict": clean.flights_strict, "monthly": clean.flights_monthly}[layout](raw)
    sinks.write_flights(clean.assign_flight_id(cleaned), Folder(out).flights)


@scoped
def build_weather(spark: SparkSession, folder: str, out: str, *, radius_km: float = 35.0) -> None:
    """Station files to airport positions, same-metro edges and flights with weather."""
    f = Folder(out)
    obs = read_weather(spark, folder)
    sinks.write_table(weather.override_locations(weather.locations(obs)), f.airport_locations)
    locations = spark.read.parquet(f.airport_locations)
    sinks.write_table(weather.same_metro(locations, radius_km=radius_km), f.weather_edges)
    sinks.write_table(weather.hourly(obs), f.weather_hourly)
    joined = weather.join_to_flights(spark.read.parquet(f.flights), spark.read.parquet(f.weather_hourly))
    sinks.write_table(joined, f.weather_node_features)


def _flights(spark: SparkSession, out: str) -> DataFrame:
    """The weather-enriched flights when they exist, else the plain ones; ids agree in both."""
    f = Folder(out)
    return spark.read.parquet(flight_files.first_available(spark, [f.weather_node_features, f.flights]))


@scoped
def build_rotation(spark: SparkSession, out: str, *, min_gap: float = 0, max_gap: float = 720) -> None:
    sinks.write_table(rotation.rotation_edges(_flights(spark, out), min_gap=min_gap, max_gap=max_gap), Folder(out).rotation_edges)


@scoped
def build_congestion(spark: SparkSession, out: str, *, min_pair: int = 50, hubs: int = 30, z: float = 1.3, min_hours: int = 10) -> None:
    f, fl = Folder(out), _flights(spark, out)
    sinks.write_table(congestion.congestion_edges(fl, min_pair=min_pair, hubs=hubs, z=z, min_hours=min_hours), f.congestion_edges)
    sinks.write_table(congestion.taxi_baseline(fl), f.taxi_baseline)
    sinks.write_table(congestion.airport_stats(fl, hubs=hubs), f.airport_congestion_stats)


@scoped
def build_snapshots(
    spark: SparkSession, out: str, *, is_train: Column, hubs: int = 30, window_h: int = 8, min_fine: int = 10, min_hour: int = 5,
    min_r: float = 0.30,
) -> None:
    """Priors from the training flights, then all snapshot tables.

    `is_train` selects the flights that history may be learned from, such as
    `F.year("dep_datetime") <= 2020`.
    """
    f = Folder(out)
    airports = spark.read.parquet(f.airport_locations).select("airport", "lat", "lon")
    fl = clean.between_airports(_flights(spark, out), airports)
    train = fl.where(is_train)
    rot = flight_files.read_or_empty(spark, f.rotation_edges, ROTATION)

    sinks.write_table(clean.airport_index(airports), f.airport_index)
    sinks.write_table(clean.flight_lookup(fl), f.flight_lookup)
    sinks.write_table(clean.tail_index(fl), f.tail_index)
    sinks.write_table(priors.airport_priors(train, hubs=hubs), f.airport_priors)
    sinks.write_table(priors.route_stats(train, min_fine=min_fine, min_hour=min_hour), f.route_stats)
    sinks.write_table(priors.global_stats(train), f.route_stats_global)
    sinks.write_table(network.network_edges(train, min_r=min_r), f.network_edges)
    sinks.write_table(priors.airport_hour_state(fl), f.airport_hours)
    has_weather = "wind_speed_ms" in fl.columns
    if has_weather:
        sinks.write_table(priors.forecast_proxy(priors.weather_climatology(train)), f.forecast)
    read = lambda path: spark.read.parquet(path)
    prior, state = read(f.airport_priors), read(f.airport_hours)

    known = priors.with_route_prior(rotation.tail_propagation(fl), read(f.route_stats), read(f.route_stats_global))
    rows = snapshots.flight_table(snapshots.enrich(known, rot, airports, prior), fl, window_h=window_h)
    sinks.write_snapshots(rows, f.flight_snapshots)
    if has_weather:
        table = snapshots.airport_table(fl, airports, prior, state, priors.traffic(fl), read(f.forecast))
        sinks.write_snapshots(table, f.airport_snapshots)

    rows = read(f.flight_snapshots)
    sinks.write_snapshots(snapshots.departs_from(rows, state, prior), f.departs_from_edges)
    sinks.write_snapshots(snapshots.arrives_at(rows), f.arrives_at_edges)
    sinks.write_snapshots(snapshots.flight_rotation(rot, airports, fl), f.flight_rotation_edges)
    sinks.write_snapshots(rotation.by_hour(rot, airports), f.airport_rotation_edges)


def dynamic_congestion(spark: SparkSession, out: str, date: str) -> DataFrame:
    """Congestion weights of one day between known airports, made on demand."""
    f = Folder(out)
    edges = clean.between_airports(spark.read.parquet(f.congestion_edges), spark.read.parquet(f.airport_locations), "src_airport", "dst_airport")
    return congestion.dynamic_weights(edges, spark.read.parquet(f.airport_hours), date)


@scoped
def build_predictions(spark: SparkSession, out: str, *, is_train: Column, max_iter: int = 30) -> None:
    """Forecaster fitted on the training snapshots; log of the others."""
    f = Folder(out)
    rows = snapshots.mask_flights(spark.read.parquet(f.flight_snapshots))
    features = [c for c in rows.columns if c.startswith("f_")]
    model = learn.fit_forecaster(rows.where(is_train), features, max_iter=max_iter)
    sinks.write_snapshots(learn.forecast(model, rows.where(~is_train)), f.predictions)


@scoped
def evaluate_predictions(spark: SparkSession, out: str, *, checkpoint: str, split: str, thresholds: Sequence[float] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> None:
    f = Folder(out)
    pred = spark.read.parquet(f.predictions)
    sinks.write_csv(evaluate.bands(pred), f.evaluation_bands)
    sinks.write_csv(evaluate.error_by_actual_delay(pred, checkpoint), f.error_by_actual_delay)
    sinks.write_csv(evaluate.sweep(pred, thresholds), f.threshold_sweep)
    sinks.append_comparison(evaluate.comparison_row(pred, checkpoint=checkpoint, split=split), f.model_comparison)


@scoped
def rerank_predictions(spark: SparkSession, out: str, *, is_train: Column, **options) -> None:
    """Reranker tuned on part of the log; scores, sweeps and report of the rest."""
    f = Folder(out)
    pred, lookup = spark.read.parquet(f.predictions), spark.read.parquet(f.flight_lookup)
    ranker = learn.fit_reranker(pred.where(is_train), lookup, **options)
    ranker.model.write().overwrite().save(f.reranker_model)
    sinks.write_table(learn.rerank(ranker, pred.where(~is_train), lookup), f.reranked)
    scored = spark.read.parquet(f.reranked)
    sinks.write_csv(ranker.tune_sweep, f.reranker_tune_sweep)
    sinks.write_csv(ranker.full_sweep, f.reranker_full_sweep)
    sinks.write_json(learn.report(scored, ranker), f.reranker_report)


@scoped
def export_replay(spark: SparkSession, out: str, date: str, *, split: str = "val", threshold: float = 0.60) -> None:
    f = Folder(out)
    fl = spark.read.parquet(f.flight_lookup)
    day = F.lit(date).cast("date")
    # A day's flights are predicted in that day's snapshots and the evening before: two folders.
    pred = spark.read.parquet(f.predictions).where(F.col("snapshot_date").between(F.date_sub(day, 1), day))
    table = replay.day(
        pred, fl, snapshots.hours(fl), spark.read.parquet(f.airport_locations), date, threshold=threshold)
    replay.write_day(table, f.replay_days)
    replay.write_bundle(spark.read.parquet(f.replay_days).where(F.col("replay_date") == day).drop("replay_date"),
                        f"{f.replay_bundle}/{split}_{date}", date, split, threshold)


def check_build(spark: SparkSession, out: str, **expected: int) -> DataFrame:
    """Checks on the written tables: rows, then flights and rotation edges."""
    f, fl = Folder(out), _flights(spark, out)
    checks = quality.artifacts(spark, out, expected or quality.ARTIFACTS)
    airports = spark.read.parquet(f.airport_locations)
    return checks.unionByName(quality.run(fl, spark.read.parquet(f.rotation_edges), airports)).unionByName(
        quality.same_rows(spark.read.parquet(f.flights), fl))
