import json

from pyspark.sql import functions as F, types as T

from helpers import as_set, ts
from skyledger.sources import feeds
from skyledger.streaming import live

SCHEMA = T.StructType([
    T.StructField("flight_number", T.StringType()), T.StructField("Tail_Number", T.StringType()), T.StructField("dep_scheduled", T.TimestampType()),
    T.StructField("event_time", T.TimestampType()), T.StructField("flight_status", T.StringType()), T.StructField("arr_delay_min", T.DoubleType())])


def report(n, tail, t, delay, status="landed"):
    return json.dumps({"flight_number": n, "Tail_Number": tail, "dep_scheduled": t, "event_time": t, "flight_status": status, "arr_delay_min": delay})


def test_tail_state_over_files_survives_a_restart(spark, tmp_path):
    """Two files, two runs on one checkpoint: repeats count once, days do not mix."""
    feed, out = tmp_path / "feed", tmp_path / "out"
    feed.mkdir()
    (feed / "a.json").write_text("\n".join([
        report("F1", "N1", "2022-01-01T10:00:00Z", 20.0), report("F1", "N1", "2022-01-01T10:00:00Z", 20.0), report("F2", "N1", "2022-01-01T12:00:00Z", 0.0),
        report("F3", "N1", "2022-01-01T13:00:00Z", 9.0, "scheduled")]))

    def run():
        stream = live.read_folder(spark, str(feed), SCHEMA)
        live.start(live.first_reports(stream), live.append_to(str(out / "first")), str(out / "c1"), mode="append", once=True).awaitTermination()
        again = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(out / "first"))
        live.start(live.tail_state(again), live.append_to(str(out / "state")), str(out / "c2"), mode="update", once=True).awaitTermination()
        return as_set(live.current(spark, str(out / "state"), ["day", "Tail_Number"]), F.col("day").cast("string"), "Tail_Number", "cumul", "legs", "immed")

    assert run() == {("2022-01-01", "N1", 20.0, 1, 20.0)}
    (feed / "b.json").write_text("\n".join([
        report("F4", "N1", "2022-01-01T20:00:00Z", 5.0), report("F1", "N1", "2022-01-01T10:00:00Z", 20.0), report("F5", "N1", "2022-01-02T01:00:00Z", 7.0)]))
    assert run() == {("2022-01-01", "N1", 25.0, 2, 5.0), ("2022-01-02", "N1", 7.0, 1, 7.0)}


def test_state_is_let_go_and_late_rows_are_counted(spark, tmp_path):
    """Days that the watermark has passed leave the state; a report of such a day is dropped and counted."""
    feed, out, sizes, late = tmp_path / "feed", tmp_path / "out", [], 0
    feed.mkdir()
    for day in (1, 2, 5, 8, 9):
        rows = [report(f"F{day}", f"N{k}", f"2022-01-{day:02d}T10:00:00Z", 20.0) for k in range(5)]
        rows += [report("OLD", "N1", "2022-01-01T11:00:00Z", 9.0)] * (day == 9)
        (feed / f"{day}.json").write_text("\n".join(rows))
        query = live.start(live.tail_state(live.read_folder(spark, str(feed), SCHEMA), late_by="12 hours"), live.append_to(str(out / "t")), str(out / "c"), once=True)
        query.awaitTermination()
        late += live.late_rows(query)
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(sizes) <= 10 and late == 1
    got = live.current(spark, str(out / "t"), ["day", "Tail_Number"])
    assert got.count() == 25 and got.where("cumul <> 20").count() == 0


def test_departures_fall_back_to_active(spark):
    def flight(n, status, t):
        return {"flight_status": status, "departure": {"iata": "ATL", "scheduled": t, "delay": None}, "arrival": {"iata": "BOS", "scheduled": "bad"},
                "aircraft": {"registration": "N1"}, "airline": {"iata": "DL"}, "flight": {"iata": n}}
    now = F.lit("2022-01-01 10:00:00").cast("timestamp_ntz")
    def read(*fl):
        return {r.flight_number: r for r in feeds.departures(spark.createDataFrame([(json.dumps({"data": list(fl)}),)], "payload string"), now).collect()}
    got = read(flight("S1", "scheduled", "2022-01-01T07:00:00-05:00"), flight("S2", "scheduled", "2022-01-01T17:00:00+00:00"), flight("A1", "active", "2022-01-01T11:00:00+00:00"))
    assert set(got) == {"S1"} and got["S1"].dep_scheduled == ts("2022-01-01T12:00") and got["S1"].hours_until_dep == 2.0 and got["S1"].arr_scheduled is None
    assert set(read(flight("A1", "active", "2022-01-01T11:00:00+00:00"), flight("L1", "landed", "2022-01-01T11:00:00+00:00"))) == {"A1"}


def test_flight_by_number_parses_the_hour(spark):
    body = json.dumps({"data": [{"flight_status": "active", "departure": {"iata": "A", "scheduled": "2022-01-01T17:20:00+00:00", "delay": 4}, "arrival": {"iata": "B"}, "flight": {"iata": "UA328"}}]})
    moves = feeds.all_movements(spark.createDataFrame([(body,)], "payload string"), F.lit("2022-01-01").cast("timestamp_ntz"))
    r = feeds.flight_by_number(moves, " ua328 ", "2022-01-01").head()
    assert (r.dep_hour, r.dep_delay, r.status, r.origin, r.dest) == (17, 4.0, "active", "A", "B")


def test_airport_status_xml_with_two_airports(spark):
    xml = ("<Info><List><Ground_Delay><ARPT>KATL</ARPT><Reason>wind</Reason><Avg>1 hour 5 minutes</Avg></Ground_Delay>"
           "<Ground_Delay><ARPT>BOS</ARPT><Reason>fog</Reason></Ground_Delay><Ground_Delay><ARPT>ZZZ</ARPT><Avg>9</Avg></Ground_Delay></List></Info>")
    known = spark.createDataFrame([("ATL",), ("BOS",)], "airport string")
    got = as_set(feeds.airport_status(spark.createDataFrame([(xml,)], "payload string"), known), "airport", "avg_delay_min", "type", "reason")
    assert got == {("ATL", 65.0, "Ground_Delay", "wind"), ("BOS", 0.0, "Ground_Delay", "fog")}


def test_weather_defaults(spark):
    airports = spark.createDataFrame([("ATL",), ("BOS",)], "airport string")
    body = json.dumps({"properties": {"windSpeed": {"value": 3.0}, "visibility": {"value": None}}})
    got = {r.airport: r for r in feeds.current_weather(spark.createDataFrame([("ATL", body)], "airport string, payload string"), airports=airports).collect()}
    assert got["ATL"].wind_speed_ms == 3.0 and got["ATL"].visibility_m == 10000.0 and got["BOS"].temperature_c == 20.0


def test_recent_and_registry(spark):
    feed = spark.createDataFrame([("ATL", "abc", 1641031200), ("BOS", "zzz", 1641000000)], "dep_airport string, icao24 string, firstSeen long")
    now = F.lit("2022-01-01 11:00:00").cast("timestamp")
    recent = feeds.recent_departures(feed, now)
    assert as_set(feeds.with_tail(recent, spark.createDataFrame([("abc", "N77")], "icao24 string, registration string")), "dep_airport", "Tail_Number") == {("ATL", "N77")}
    assert as_set(feeds.with_tail(feed.where("dep_airport = 'BOS'"), spark.createDataFrame([("abc", "N77")], "icao24 string, registration string")), "Tail_Number") == {("",)}


def test_airport_list(spark):
    from skyledger.sources.airports import airports

    got = {r.airport: r.icao for r in airports(spark).collect()}
    assert len(got) == 36 and got["ANC"] == "PANC" and got["ATL"] == "KATL"


def polls(feed, name, *rows):
    (feed / f".{name}").write_text("\n".join(rows))
    (feed / f".{name}").rename(feed / f"{name}.json")


def cycle(spark, stream, out, keys, mode="update"):
    query = live.start(stream, live.append_to(f"{out}/t", keys), f"{out}/c", mode=mode, once=True)
    query.awaitTermination()
    return live.progress(spark, query)


def test_repeats_and_days_in_one_stream(spark, tmp_path):
    """Five cycles of a doubled feed: a landing counts once, a day comes out once and whole, state goes down, late rows are counted."""
    feed, late, states, days = tmp_path / "feed", 0, [], []
    feed.mkdir()
    for day in (1, 2, 3, 4, 6):
        here = [report(f"F{day}-{k}", f"N{k % 3}", f"2022-01-{day:02d}T{10 + k}:00:00Z", 10.0 + k) for k in range(6)]
        old = [report(f"F{day - 1}-{k}", f"N{k % 3}", f"2022-01-{day - 1:02d}T{10 + k}:00:00Z", 10.0 + k) for k in range(6)] if day in (2, 3, 4) else []
        lost = [report("NEW", "N0", "2022-01-01T12:00:00Z", 99.0)] if day == 6 else []
        polls(feed, day, *here, *here, *old, *lost)
        seen = cycle(spark, live.closed_tail_days(live.read_folder(spark, str(feed), SCHEMA), late_by="6 hours"), tmp_path, None, "append").collect()
        late += sum(r.late_rows for r in seen)
        states.append(max(r.state_rows for r in seen if r.batch == max(x.batch for x in seen) and r.operator == "dedupeWithinWatermark"))
        days.append(spark.read.parquet(f"{tmp_path}/t").count())
    assert days == [0, 3, 6, 9, 12] and late >= 1 and max(states) <= 12
    got = as_set(spark.read.parquet(f"{tmp_path}/t"), F.col("day").cast("string"), "Tail_Number", "cumul", "legs", "immed")
    assert got == {(f"2022-01-{d:02d}", f"N{k}", 23.0 + 2 * k, 2, 13.0 + k) for d in (1, 2, 3, 4) for k in range(3)}


def test_timers_close_days_and_repeats_are_known_from_state(spark, tmp_path):
    from skyledger.streaming import tracker

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    feed = tmp_path / "feed"
    feed.mkdir()
    keys = ["day", "Tail_Number"]
    run = lambda: cycle(spark, tracker.tail_days(live.read_folder(spark, str(feed), SCHEMA), late_by="6 hours"), tmp_path, keys)
    table = lambda: as_set(live.current(spark, f"{tmp_path}/t", keys), F.col("day").cast("string"), "Tail_Number", "cumul", "legs", "immed", "closed")
    first = report("F1", "N1", "2022-01-01T10:00:00Z", 20.0)
    polls(feed, "a", first, first, report("F2", "N1", "2022-01-01T23:30:00Z", 5.0))
    run()
    polls(feed, "b", first, report("F3", "N1", "2022-01-01T20:00:00Z", 1.0), report("F6", "N1", "2022-01-01T09:00:00Z", 50.0), report("F4", "N1", "2022-01-02T05:00:00Z", 7.0))
    run()
    assert table() == {("2022-01-01", "N1", 26.0, 3, 5.0, False), ("2022-01-02", "N1", 7.0, 1, 7.0, False)}
    polls(feed, "c", report("F5", "N2", "2022-01-03T08:00:00Z", 3.0))
    run()
    assert table() == {("2022-01-01", "N1", 26.0, 3, 5.0, True), ("2022-01-02", "N1", 7.0, 1, 7.0, True), ("2022-01-03", "N2", 3.0, 1, 3.0, False)}


def test_half_hour_cycle_stops_and_restarts(spark, tmp_path):
    """A running cycle is stopped between batches and started again on its checkpoint; the folded table is that of one batch job."""
    import glob

    feed, out, keys = tmp_path / "feed", f"{tmp_path}/t", ["day", "Tail_Number"]
    feed.mkdir()
    rows = [[report(f"F{n}-{k}", f"N{k % 4}", f"2022-01-{1 + n // 3:02d}T{n % 3 * 7:02d}:{k:02d}:00Z", 5.0 + k) for k in range(8)] for n in range(9)]

    def begin():
        stream = live.tail_state(live.read_folder(spark, str(feed), SCHEMA, max_files=1))
        return live.start(stream, live.append_to(out, keys, fold_every=2), f"{tmp_path}/c", every="1 second")

    done = 0
    for part in (rows[:4], rows[4:5], rows[5:]):
        query = begin()
        for r in part:
            polls(feed, done, *r)
            done += 1
            query.processAllAvailable()
        assert query.isActive
        query.stop()
    expected = live.tail_state(spark.read.schema(SCHEMA).json(str(feed)))
    cols = [F.col("day").cast("string"), "Tail_Number", "cumul", "legs", "immed"]
    assert as_set(live.current(spark, out, keys), *cols) == as_set(expected, *cols)
    left = sorted(int(p.rpartition("=")[2]) for p in glob.glob(f"{out}/batch=*"))
    assert len(glob.glob(f"{tmp_path}/c/commits/[0-9]*")) >= 9 and left[0] >= 4 and len(glob.glob(f"{out}/_snapshots/upto=*")) == 2


def test_a_repeated_batch_and_an_unfinished_snapshot_change_nothing(spark, tmp_path):
    from skyledger.streaming import tables

    path = f"{tmp_path}/t"
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v long")
    write = tables.batch_writer(path, ["k"], fold_every=2)
    for n, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("c", 3)], [("b", 4)], [("a", 5)]]):
        write(batch(*rows), n)
        write(batch(*rows), n)
    newest = {("a", 5), ("b", 4), ("c", 3)}
    assert as_set(tables.current(spark, path, ["k"]), "k", "v") == newest
    (tmp_path / "t" / "_snapshots" / "upto=9").mkdir()  # a snapshot whose job died
    assert as_set(tables.current(spark, path, ["k"]), "k", "v") == newest
