"""The fixed airport list of the live and replay tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.expr import iata_to_icao

# Airport code, latitude, longitude.
AIRPORTS = [
    ("ANC", 61.174, -149.996), ("ATL", 33.640, -84.427), ("BNA", 36.124, -86.678), ("BOS", 42.365, -71.009),
    ("BWI", 39.175, -76.668), ("CLE", 41.411, -81.849), ("CLT", 35.214, -80.943), ("CMH", 39.998, -82.892),
    ("DEN", 39.856, -104.674), ("DFW", 32.897, -97.038), ("DTW", 42.212, -83.353), ("EWR", 40.692, -74.174),
    ("FLL", 26.072, -80.150), ("HOU", 29.645, -95.279), ("IAD", 38.944, -77.456), ("IAH", 29.984, -95.341),
    ("IND", 39.717, -86.294), ("JFK", 40.639, -73.779), ("LAS", 36.080, -115.152), ("LAX", 33.943, -118.408),
    ("LGA", 40.777, -73.873), ("MCI", 39.298, -94.714), ("MCO", 28.429, -81.309), ("MIA", 25.796, -80.287),
    ("MKE", 42.947, -87.897), ("MSP", 44.882, -93.222), ("ORD", 41.978, -87.905), ("PHL", 39.872, -75.241),
    ("PHX", 33.437, -112.008), ("PIT", 40.492, -80.233), ("SAN", 32.734, -117.190), ("SEA", 47.449, -122.309),
    ("SFO", 37.619, -122.375), ("SJC", 37.363, -121.929), ("SLC", 40.788, -111.978), ("TPA", 27.975, -82.533),
]


def airports(spark: SparkSession) -> DataFrame:
    """(airport, lat, lon, icao) of the 36 airports."""
    table = spark.createDataFrame(AIRPORTS, "airport string, lat double, lon double")
    return table.withColumn("icao", iata_to_icao(F.col("airport")))
