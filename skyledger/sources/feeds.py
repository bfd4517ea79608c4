"""Decoders of landed feed payloads. Each takes a batch or streaming DataFrame of
text payloads and returns named, typed columns; polling the services is not done here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.expr import delay_text_minutes, hours_between, icao_to_iata, wind_text_ms
from skyledger.sources.schemas import (
    DEPARTURES_FEED, FORECAST_FEED, OBSERVATION_FEED, STATE_FIELDS, STATES_FEED, STATUS_ITEM,
)

# Fixed values used where an observation or forecast is missing.
DEFAULT_WEATHER = {"wind_speed_ms": 0.0, "visibility_m": 10000.0, "precip_mm": 0.0, "temperature_c": 20.0}
DEFAULT_FORECAST = {
    "wind_3h": 0.0, "precip_3h": 0.0, "vis_3h": 10000.0, "wind_6h": 0.0, "precip_6h": 0.0, "vis_6h": 10000.0,
}


def utc_timestamp(text: Column) -> Column:
    """ISO text, with or without an offset, to zone-free UTC; unparsable is null."""
    return F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def departures(payloads: DataFrame, now: Column, *, payload: str = "payload", hours: float = 6.0) -> DataFrame:
    """One row per scheduled departure within the next `hours`.

    When a payload has no scheduled flight its active ones are used instead.
    """
    data = F.from_json(F.col(payload), DEPARTURES_FEED)["data"]
    picked = payloads.withColumn("__all", data).withColumn(
        "__sched", F.filter("__all", lambda f: f["flight_status"] == "scheduled")
    ).withColumn(
        "__use",
        F.when(F.size("__sched") > 0, F.col("__sched"))
        .otherwise(F.filter("__all", lambda f: f["flight_status"] == "active")),
    )
    keep = [c for c in payloads.columns if c != payload]
    rows = picked.select(*keep, F.explode("__use").alias("f"))
    return _departure_rows(rows, keep, now).where(
        (F.col("h2dep") >= 0) & (F.col("h2dep") <= hours)
    ).withColumn("hours_until_dep", F.bround("h2dep", 2)).drop("h2dep")


def all_movements(payloads: DataFrame, now: Column, *, payload: str = "payload") -> DataFrame:
    """Every flight of the payloads whatever its status (the delay tracker needs landed ones)."""
    data = F.from_json(F.col(payload), DEPARTURES_FEED)["data"]
    keep = [c for c in payloads.columns if c != payload]
    rows = payloads.select(*keep, F.explode(data).alias("f"))
    return _departure_rows(rows, keep, now).drop("h2dep")


def _departure_rows(rows: DataFrame, keep: list[str], now: Column) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        *keep,
        text(F.col("f.departure.iata")).alias("ORIGIN"),
        text(F.col("f.arrival.iata")).alias("DEST"),
        text(F.col("f.flight.iata")).alias("flight_number"),
        text(F.col("f.aircraft.registration")).alias("Tail_Number"),
        text(F.col("f.airline.iata")).alias("Operating_Airline"),
        utc_timestamp(F.col("f.departure.scheduled")).alias("dep_scheduled"),
        utc_timestamp(F.col("f.arrival.scheduled")).alias("arr_scheduled"),
        F.coalesce("f.departure.delay", F.lit(0.0)).alias("dep_delay_min"),
        F.coalesce("f.arrival.delay", F.lit(0.0)).alias("arr_delay_min"),
        text(F.col("f.flight_status")).alias("flight_status"),
    ).where("dep_scheduled is not null").withColumn("h2dep", hours_between(now, "dep_scheduled"))


def flight_by_number(movements: DataFrame, number: str, date: str) -> DataFrame:
    """Status of one flight on one day, with the departure hour from its parsed time."""
    return movements.where(
        (F.upper("flight_number") == number.strip().upper()) & (F.to_date("dep_scheduled") == F.lit(date).cast("date"))
    ).select(
        F.hour("dep_scheduled").alias("dep_hour"), F.col("Tail_Number").alias("tail"),
        F.col("dep_delay_min").alias("dep_delay"), F.col("flight_status").alias("status"),
        F.col("ORIGIN").alias("origin"), F.col("DEST").alias("dest"),
    )


def aircraft_states(
    payloads: DataFrame, *, payload: str = "payload",
    lat: tuple[float, float] = (24.0, 50.0), lon: tuple[float, float] = (-125.0, -65.0),
) -> DataFrame:
    """Arrays of 17 values to named columns, inside a latitude/longitude box."""
    rows = payloads.select(F.explode(F.from_json(F.col(payload), STATES_FEED)["states"]).alias("s"))
    value = lambda i: F.try_element_at("s", F.lit(i + 1))
    kinds = {
        "time_position": "long", "last_contact": "long", "longitude": "double", "latitude": "double",
        "geo_altitude": "double", "on_ground": "boolean", "velocity": "double", "true_track": "double",
        "vertical_rate": "double", "baro_altitude": "double", "spi": "boolean", "position_source": "int",
    }
    named = rows.select(*[
        (value(i).try_cast(kinds[n]) if n in kinds else F.trim(value(i))).alias(n)
        for i, n in enumerate(STATE_FIELDS)
    ])
    return named.where(F.col("latitude").between(*lat) & F.col("longitude").between(*lon))


def recent_departures(feed: DataFrame, now: Column, *, seen: str = "firstSeen", hours: int = 2) -> DataFrame:
    """Departures of all airports seen within the last `hours` (epoch seconds in `seen`)."""
    at = F.timestamp_seconds(F.col(seen))
    return feed.where((at >= now - F.expr(f"INTERVAL {hours} HOURS")) & (at <= now))


def with_tail(flights: DataFrame, registry: DataFrame) -> DataFrame:
    """Tail number from the transponder address; unknown addresses give ''."""
    known = registry.select("icao24", F.col("registration").alias("__tail"))
    return flights.join(known, "icao24", "left").withColumn(
        "Tail_Number", F.coalesce("__tail", F.lit(""))
    ).drop("__tail")


def current_weather(payloads: DataFrame, *, payload: str = "payload", airports: DataFrame | None = None) -> DataFrame:
    """Latest observation per airport, by its timestamp; missing values, and airports without one, get defaults."""
    p = F.from_json(F.col(payload), OBSERVATION_FEED)["properties"]
    seen = payloads.select(
        "airport",
        p["windSpeed"]["value"].alias("wind_speed_ms"), p["visibility"]["value"].alias("visibility_m"),
        p["precipitationLastHour"]["value"].alias("precip_mm"), p["temperature"]["value"].alias("temperature_c"),
        p["timestamp"].alias("timestamp"),
    )
    values = [c for c in seen.columns if c != "airport"]
    newest = F.struct(F.try_to_timestamp(F.col("timestamp")), *values)
    seen = seen.groupBy("airport").agg(F.max_by(F.struct(*values), newest).alias("o")).select("airport", "o.*")
    if airports is not None:
        seen = airports.select("airport").join(seen, "airport", "left")
    return seen.select(
        "airport", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in DEFAULT_WEATHER.items()],
        F.coalesce("timestamp", F.lit("")).alias("timestamp"),
    )


def latest(payloads: DataFrame, keys: Sequence[str], time: str | None, payload: str = "payload") -> DataFrame:
    """The newest payload of each key; without a time column there must be one. Equal times are settled by the payload's text."""
    if time is None:
        return payloads
    return payloads.groupBy(*keys).agg(F.max_by(payload, F.struct(time, payload)).alias(payload))


def forecast_weather(payloads: DataFrame, *, payload: str = "payload", airports: DataFrame | None = None, time: str | None = None) -> DataFrame:
    """Wind and rain at +3 h and +6 h from the hourly periods; fewer than 7 periods give defaults.

    `time` names the column that says when a payload was polled; the newest of an airport counts.
    """
    payloads = latest(payloads, ["airport"], time, payload)
    periods = F.from_json(F.col(payload), FORECAST_FEED)["properties"]["periods"]
    got = payloads.select("airport", F.when(F.size(periods) >= 7, periods).alias("p"))

    def at(hour: int) -> dict[str, Column]:
        period = F.try_element_at("p", F.lit(hour + 1))
        rain = F.coalesce(period["probabilityOfPrecipitation"]["value"], F.lit(0.0)) > 40
        return {
            f"wind_{hour}h": F.when(F.col("p").isNotNull(), wind_text_ms(period["windSpeed"])),
            f"precip_{hour}h": F.when(F.col("p").isNotNull(), rain.cast("double")),
        }

    got = got.withColumns(at(3) | at(6)).drop("p")
    if airports is not None:
        got = airports.select("airport").join(got, "airport", "left")
    return got.select("airport", *[
        (F.lit(v) if c.startswith("vis") else F.coalesce(c, F.lit(v))).alias(c) for c, v in DEFAULT_FORECAST.items()
    ])


def airport_status(payloads: DataFrame, airports: DataFrame, *, payload: str = "payload", time: str | None = None) -> DataFrame:
    """Average delay per airport from a JSON or XML status payload, known airports only.

    With `time`, the column that says when a payload was polled, an airport has the row of the newest payload that
    lists it; of several rows in one payload the longest delay counts.
    """
    text = F.trim(F.col(payload))
    item = STATUS_ITEM.simpleString()
    listed = F.from_json(F.when(text.startswith("["), text), f"array<{item}>")
    wrapped = F.from_json(F.when(text.startswith("{"), text), f"struct<data:array<{item}>,delays:array<{item}>>")
    single = F.from_json(F.when(text.startswith("{"), text), item)
    keep = [c for c in payloads.columns if c != payload]

    from_json_items = payloads.select(*keep, F.explode(
        F.coalesce(listed, wrapped["data"], wrapped["delays"], F.array(single))
    ).alias("i")).select(
        *keep, icao_to_iata(F.coalesce("i.arpt", "i.airport", F.lit(""))).alias("airport"),
        delay_text_minutes(F.coalesce("i.avgDelay", "i.avg_delay", "i.delay", F.lit("0"))).alias("minutes"),
        F.coalesce("i.type", F.lit("")).alias("type"), F.coalesce("i.reason", F.lit("")).alias("reason"),
    )
    # Elements of an XML document whose first child names an airport, at any depth.
    blocks = F.regexp_extract_all(
        F.col("x"), F.lit(r"(?s)<(\w+)(?:\s[^>]*)?>\s*<(?:ARPT|Arpt|airport)>.*?</\1>"), F.lit(0))

    def child(*names: str) -> Column:
        found = [F.regexp_extract("b", rf"<{n}>\s*([^<]*?)\s*</{n}>", 1) for n in names]
        return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))

    from_xml_items = payloads.where(text.startswith("<")).select(*keep, text.alias("x")).select(
        *keep, F.explode(blocks).alias("b")
    ).select(
        *keep, icao_to_iata(child("ARPT", "Arpt", "airport")).alias("airport"),
        delay_text_minutes(child("Avg", "AvgDelay", "Delay", "avg")).alias("minutes"),
        F.regexp_extract("b", r"^<(\w+)", 1).alias("type"), child("Reason").alias("reason"),
    )
    every = from_json_items.unionByName(from_xml_items)
    found = every.join(airports.select("airport"), "airport", "left_semi").select(
        *keep, "airport", F.col("minutes").cast("double").alias("avg_delay_min"), "type", "reason"
    )
    if time is None:
        return found
    row = F.struct(*[c for c in found.columns if c != "airport"])
    return found.groupBy("airport").agg(F.max_by(row, F.struct(time, "avg_delay_min", "type", "reason")).alias("r")).select("airport", "r.*").select(*found.columns)
