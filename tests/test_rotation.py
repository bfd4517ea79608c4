import pytest

from helpers import as_set, flights
from skyledger.operators import rotation


def leg(i, tail, o, d, dep, arr, **kw):
    return dict(flight_id=i, Tail_Number=tail, ORIGIN=o, DEST=d, dep=dep, arr=arr, **kw)


def test_gap_bounds_and_airport_match(spark):
    day = "2022-01-01 "
    df = flights(spark, [
        leg(1, "N1", "A", "B", day + "01:00", day + "02:00"), leg(2, "N1", "B", "C", day + "02:00", day + "03:00"),   # gap 0 kept
        leg(3, "N1", "C", "D", day + "15:00", day + "16:00"),                                                          # gap 720 kept
        leg(4, "N1", "D", "E", "2022-01-02 04:01", "2022-01-02 05:00"),                                                # 721 dropped
        leg(5, "N2", "A", "B", day + "01:00", day + "02:00"), leg(6, "N2", "B", "C", day + "01:59", day + "03:00"),    # -1 dropped
        leg(7, "N3", "A", "B", day + "01:00", day + "02:00"), leg(8, "N3", "X", "C", day + "02:30", day + "03:00"),    # elsewhere
        leg(9, None, "A", "B", day + "01:00", day + "02:00"),
    ])
    e = rotation.rotation_edges(df)
    assert as_set(e, "leg1_flight_id", "leg2_flight_id", "turnaround_min") == {(1, 2, 0.0), (2, 3, 720.0)}


def test_tail_propagation_rules(spark):
    d = "2022-01-01 "
    df = flights(spark, [
        leg(1, "N1", "A", "B", d + "05:00", d + "06:00", ArrDelay=20.0),
        leg(2, "N1", "B", "C", d + "07:00", d + "08:00", ArrDelay=None),   # previous known: 20
        leg(3, "N1", "C", "D", d + "09:00", d + "10:00", ArrDelay=-5.0),   # previous unknown: no row, legs go on
        leg(4, "N1", "D", "E", d + "11:00", d + "12:00", ArrDelay=7.0),    # cumul 20, 3 legs, inbound -5
        leg(5, "N1", "E", "F", d + "20:01", d + "21:00", ArrDelay=1.0),    # gap over 8 h
        leg(6, "N1", "F", "G", "2022-01-02 01:00", "2022-01-02 02:00"),    # next day starts over
        leg(7, None, "A", "B", d + "05:00", d + "06:00", ArrDelay=9.0),
    ])
    got = {r[0]: tuple(r[1:]) for r in rotation.tail_propagation(df).select("flight_id", "cumul_delay", "legs_done", "immed_inbound").collect()}
    assert got == {1: (0, 0, 0), 2: (20, 1, 20), 3: (0, 0, 0), 4: (20, 3, -5), 5: (0, 0, 0), 6: (0, 0, 0), 7: (0, 0, 0)}


def test_propagation_by_turnaround(spark):
    d = "2022-01-01 "
    df = flights(spark, [
        leg(1, "N1", "A", "B", d + "05:00", d + "06:00", ArrDelay=30.0), leg(2, "N1", "B", "C", d + "06:20", d + "07:00", DepDelay=20.0),
        leg(3, "N2", "A", "B", d + "05:00", d + "06:00", ArrDelay=30.0), leg(4, "N2", "B", "C", d + "06:25", d + "07:00", DepDelay=None),
        leg(5, "N3", "A", "B", d + "05:00", d + "06:00", ArrDelay=15.0), leg(6, "N3", "B", "C", d + "06:25", d + "07:00", DepDelay=99.0),
    ])
    row = rotation.propagation_by_turnaround(rotation.rotation_edges(df)).collect()
    assert len(row) == 1 and row[0].turnaround_bucket == "0-30" and row[0].n == 2 and row[0].propagated_share == pytest.approx(0.5)
