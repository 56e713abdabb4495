from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnloom.functions import instants as I
from turnloom.operators.instants import normalise_instants

ZONES = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "UTC", "America/Los_Angeles"]
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def us(when):
    return round((when - EPOCH) / timedelta(microseconds=1))


def one(text, zone="America/New_York", style="mdy"):
    return I.to_utc([text], [zone], [style])[0]


@pytest.mark.parametrize(("text", "want"), [
    ("2023/09/04 (Mon) 08:06", "2023-09-04T12:06:00"), ("6:50 pm on 14 February, 2024", "2024-02-14T23:50:00"), ("12:05 am on 1 June, 2025", "2025-06-01T04:05:00"),
    ("2023-06-11T09:23:54Z", "2023-06-11T09:23:54"), ("2023-12-12 12:21:34.827233 -0800", "2023-12-12T20:21:34.827233"), ("2023-08-25 00:16:26 EDT", "2023-08-25T04:16:26"),
    ("March 22, 2023 at 3:24 AM", "2023-03-22T07:24:00"), ("Sun, 03 Nov 2024 01:57:38 -0800", "2024-11-03T09:57:38"), ("20240504T233238Z", "2024-05-04T23:32:38"),
    ("2025-06-17T16:01:51.043011999Z", "2025-06-17T16:01:51.043011"), ("2024-03-31T02:04:17+01:00[Europe/London]", "2024-03-31T01:04:17"),
    ("2025-01-18 14:07 Australia/Sydney", "2025-01-18T03:07:00"), ("24 Mar 2022 11:44 UTC-04:00", "2022-03-24T15:44:00"), ("1655221531", "2022-06-14T15:45:31"),
    ("1721113755761", "2024-07-16T07:09:15.761"), ("1692726537182057", "2023-08-22T17:48:57.182057"), ("21.04.2022 12:05:38", "2022-04-21T16:05:38"), ("04/08/2025 12:40 AM", "2025-04-08T04:40:00"),
])
def test_forms(text, want):
    assert one(text) == us(datetime.fromisoformat(want).replace(tzinfo=UTC))


@pytest.mark.parametrize("text", [None, "", " ", "n/a", "June 2023", "2023-06-07", "2025-02-30 00:08", "2022/05/16 27:04", "2024-11-03 01:30:00", "2024-03-10 02:30:00", "13:00 pm on 1 June, 2024", "26/10/2023 06:04", "2023-06-11T09:23:54+02:00[America/New_York]", "x" * 500, "2024-01-01 10:00 Nowhere/Town"])
def test_what_is_no_instant(text):
    assert one(text) is None


def test_style_and_zone_may_be_missing():
    assert one("26/10/2023 06:04", "Europe/Berlin", "dmy") == us(datetime(2023, 10, 26, 4, 4, tzinfo=UTC))
    assert one("2024-01-01 10:00:00", None) is None and one("2024-01-01T10:00:00Z", None, None) is not None
    assert one("05/05/2024 10:00", "UTC", None) is not None and one("05/06/2024 10:00", "UTC", None) is None


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(1975, 1, 1), datetime(2090, 1, 1)), st.sampled_from(ZONES))
def test_wall_times_like_the_zone_data(wall, zone):
    wall = wall.replace(microsecond=0)
    z = ZoneInfo(zone)
    both = {us(wall.replace(tzinfo=z, fold=f)) for f in (0, 1)}
    real = {u for u in both if (EPOCH + timedelta(microseconds=u)).astimezone(z).replace(tzinfo=None) == wall}
    got, ok = I.wall_to_utc(np.array([us(wall.replace(tzinfo=UTC))]), zone)
    assert bool(ok[0]) == (len(real) == 1) and (not ok[0] or int(got[0]) in real)


def test_versions_follow_the_tables():
    assert I.zone_version(["UTC", "Europe/Berlin"]) == I.zone_version(["Europe/Berlin", "UTC"]) != I.zone_version(["UTC"])


def test_operator_joins_the_turns_session(spark):
    s = spark.createDataFrame([(1, "s", "m", "2024-01-01 10:00:00", "Europe/Berlin", "dmy", 1), (2, "s", "m", "2024-01-01 10:00:00", "Europe/Berlin", "dmy", 1), (3, "t", "m", None, None, "dmy", 1)], "session_no bigint, session_id string, memory_id string, ts_raw string, home_zone string, date_style string, utc_us int")
    t = spark.createDataFrame([(5, "m", "s", "2024-07-01 10:00:00"), (6, "m", "none", "2024-07-01 10:00:00"), (7, "m", "none", "2024-07-01T10:00:00Z"), (8, None, None, ""), (9, "m", "t", "2024-07-01 10:00:00")], "turn_no bigint, memory_id string, session_id string, ts_raw string")
    got = {(r.record_kind, r.record_no): r.utc_us for r in normalise_instants(s, t).collect()}
    assert got == {("session", 1): us(datetime(2024, 1, 1, 9, tzinfo=UTC)), ("session", 2): us(datetime(2024, 1, 1, 9, tzinfo=UTC)), ("turn", 5): us(datetime(2024, 7, 1, 8, tzinfo=UTC)), ("turn", 7): us(datetime(2024, 7, 1, 10, tzinfo=UTC))}
    assert normalise_instants(s.limit(0), t.limit(0)).count() == 0


def test_no_length_rules_a_text_out():
    long = "2024-01-01T00:00:00." + "0" * 300 + "Z"
    texts = [long, "  2024-01-01 \t 00:00:00" + " " * 200 + "+01:00  ", "x 1 " * 5000, "2024-01-01T00:00:00.000001Z" + "9" * 500]
    got = I.to_utc(texts, [None] * 4, [None] * 4)
    second = 1_704_067_200 * 1_000_000
    assert got[0] == second and got[1] == second - 3_600_000_000 and got[2] is None and got[3] is None


def test_wall_times_outside_the_tables():
    texts = ["2150-07-01 12:00:00", "1850-07-01 12:00:00", "2150-07-01T12:00:00+02:00[Europe/Berlin]", "2150-01-01T12:00:00+02:00[Europe/Berlin]"]
    got = I.to_utc(texts, ["Europe/Berlin"] * 4, ["dmy"] * 4)
    from datetime import UTC, datetime
    from zoneinfo import ZoneInfo

    micro = lambda y, m, h: int((datetime(y, m, 1, h, tzinfo=ZoneInfo("Europe/Berlin")).astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1_000_000)
    assert got[0] == micro(2150, 7, 12) == got[2] and got[1] == micro(1850, 7, 12) and got[3] is None
