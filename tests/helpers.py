from datetime import datetime

from pyspark.sql import functions as F

from skyledger.functions.conform import conform
from skyledger.sources.schemas import FLIGHTS


def ts(text):
    return datetime.fromisoformat(text)


def flights(spark, rows):
    """Flights from dicts; dep and arr as ISO text, the rest by column name."""
    names = ["flight_id", "Tail_Number", "ORIGIN", "DEST", "dep", "arr", "DepDelay", "ArrDelay", "TaxiOut", "TaxiIn", "Distance", "Operating_Airline"]
    kinds = "flight_id long, Tail_Number string, ORIGIN string, DEST string, dep string, arr string, DepDelay double, ArrDelay double, TaxiOut double, TaxiIn double, Distance double, Operating_Airline string"
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)
    df = df.withColumns({"dep_datetime": F.col("dep").cast("timestamp_ntz"), "arr_datetime": F.col("arr").cast("timestamp_ntz")})
    return conform(df.drop("dep", "arr"), FLIGHTS)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}
