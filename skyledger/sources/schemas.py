"""Table schemas. Timestamps are zone-free; every measure is a double."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
_TS = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


# Yearly on-time file, as published.
# Names that files and tables share.
RAW_YEARLY = _table(
    FlightDate=_S, Operating_Airline=_S, Tail_Number=_S, Origin=_S, Dest=_S,
    DepDelay=_S, ArrDelay=_S, TaxiOut=_S, TaxiIn=_S, AirTime=_S, Distance=_S,
    CRSDepTime=_S, DepTime=_S, CRSArrTime=_S, ArrTime=_S,
    Year=_S, Month=_S, DayofMonth=_S, DayOfWeek=_S, Cancelled=_S, Diverted=_S,
)

FLIGHTS = _table(
    flight_id=_L, FlightDate=T.DateType(), Operating_Airline=_S, Tail_Number=_S, ORIGIN=_S, DEST=_S,
    DepDelay=_D, ArrDelay=_D, TaxiOut=_D, TaxiIn=_D, AirTime=_D, Distance=_D, CarrierDelay=_D,
    Year=_I, Month=_I, DayofMonth=_I, DayOfWeek=_I, dep_datetime=_TS, arr_datetime=_TS,
)

# Header of the monthly on-time file -> our column.
# Names that files and tables share.
MONTHLY_NAMES = {
    "FL_DATE": "FlightDate", "UNIQUE_CARRIER": "Operating_Airline", "TAIL_NUM": "Tail_Number",
    "FL_NUM": "FlightNum", "DEP_DELAY": "DepDelay", "ARR_DELAY": "ArrDelay", "TAXI_OUT": "TaxiOut",
    "TAXI_IN": "TaxiIn", "AIR_TIME": "AirTime", "DISTANCE": "Distance", "CANCELLED": "Cancelled",
    "DIVERTED": "Diverted", "CARRIER_DELAY": "CarrierDelay", "WEATHER_DELAY": "WeatherDelay",
    "NAS_DELAY": "NASDelay", "SECURITY_DELAY": "SecurityDelay",
    "LATE_AIRCRAFT_DELAY": "LateAircraftDelay",
}

WEATHER = _table(
    datetime=_TS, latitude=_D, longitude=_D, elevation_m=_D, temp_c=_D, dewpoint_c=_D,
    relative_humidity_pct=_D, wind_speed_ms=_D, wind_gust_ms=_D, wind_dir_deg=_D,
    sea_level_pressure_hpa=_D, visibility_m=_D, ceiling_m=_D, sky_cover_oktas=_D,
    precip_depth_mm=_D, snow_depth_mm=_D, station_id=_S, wban=_S,
)
# Accepted headers per weather column, best first.
# Names that files and tables share.
WEATHER_ALIASES = {
    "wind_speed_ms": ["wind_speed_ms", "wind_speed", "wspd"],
    "wind_gust_ms": ["wind_gust_ms", "wind_gust", "wgst"],
    "visibility_m": ["visibility_m", "visibility", "vis"],
    "precip_depth_mm": ["precip_depth_mm", "precip_depth", "prcp"],
    "sea_level_pressure_hpa": ["sea_level_pressure_hpa", "slp"],
    "ceiling_m": ["ceiling_m", "ceiling", "ceil"],
}
WEATHER_MEASURES = [
    "wind_speed_ms", "wind_gust_ms", "visibility_m", "precip_depth_mm",
    "sea_level_pressure_hpa", "ceiling_m", "sky_cover_oktas", "temp_c",
]

PREDICTIONS = _table(
    flight_id=_L, snap_idx=_I, horizon_h=_I, pred=_D, severe_prob=_D, actual=_D, abs_err=_D, sq_err=_D,
)

# Names that files and tables share.
ROTATION = _table(
    edge_type=_S, tail_number=_S, leg1_flight_id=_L, leg2_flight_id=_L,
    src_airport=_S, mid_airport=_S, dst_airport=_S, airport_match=_B,
    leg1_dep=_TS, leg1_arr=_TS, leg2_dep=_TS, leg2_arr=_TS, turnaround_min=_D,
    leg1_arr_delay=_D, leg1_dep_delay=_D, leg2_dep_delay=_D, leg2_arr_delay=_D, edge_weight=_D,
)

# Names that files and tables share.
MODEL_COMPARISON = _table(
    checkpoint=_S, split=_S, epoch=_S, overall_mae=_D, overall_rmse=_D,
    mae_0h=_D, rmse_0h=_D, mae_1h=_D, rmse_1h=_D, mae_3h=_D, rmse_3h=_D, mae_6h=_D, rmse_6h=_D,
    severe_threshold_min=_D, severe_reg_precision=_D, severe_reg_recall=_D, severe_mae_6h=_D,
    severe_cls_precision=_D, severe_cls_recall=_D,
)

# ---- feeds -------------------------------------------------------------------------------------

DEPARTURES_FEED = T.StructType([T.StructField("data", T.ArrayType(_table(
    flight_status=_S,
    departure=_table(iata=_S, scheduled=_S, delay=_D),
    arrival=_table(iata=_S, scheduled=_S, delay=_D),
    aircraft=_table(registration=_S), airline=_table(iata=_S), flight=_table(iata=_S),
)))])

STATES_FEED = T.StructType([T.StructField("states", T.ArrayType(T.ArrayType(_S)))])
# Order of the values in one aircraft state.
# Names that files and tables share.
STATE_FIELDS = [
    "icao24", "callsign", "origin_country", "time_position", "last_contact", "longitude", "latitude",
    "geo_altitude", "on_ground", "velocity", "true_track", "vertical_rate", "sensors",
    "baro_altitude", "squawk", "spi", "position_source",
]

_value = _table(value=_D)
OBSERVATION_FEED = T.StructType([T.StructField("properties", _table(
    windSpeed=_value, visibility=_value, precipitationLastHour=_value, temperature=_value, timestamp=_S,
))])
FORECAST_FEED = T.StructType([T.StructField("properties", T.StructType([
    T.StructField("periods", T.ArrayType(_table(windSpeed=_S, probabilityOfPrecipitation=_value)))
]))])
STATUS_ITEM = _table(
    arpt=_S, airport=_S, avgDelay=_S, avg_delay=_S, delay=_S, type=_S, reason=_S,
)
