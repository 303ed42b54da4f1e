import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest

from brujula.functions.dates import INVALID, iso_micros, parser_of, shape_masks, to_utc_micros, zone_tables

ZONES = ["America/Panama", "America/New_York", "Europe/Madrid", "America/Sao_Paulo", "Asia/Kolkata", "Europe/Lisbon"]
TABLES = zone_tables(ZONES)
EN = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
ES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def utc(texts, zone="UTC", mdy=False):
    n = len(texts)
    return iso_micros(to_utc_micros(pa.array(texts, type=pa.string()), pa.array([zone] * n, type=pa.string()), np.full(n, mdy), TABLES)).to_pylist()


def expected(d: datetime, zone: str) -> str:
    """First pass of a repeated hour, offset before the change in a skipped one: what fold=0 means."""
    out = d.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    return out.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


@pytest.mark.parametrize("zone", ZONES)
def test_local_formats_match_brute_force(zone):
    rng = random.Random(zone)
    days = [datetime(2025, 10, 1) + timedelta(minutes=rng.randrange(60 * 24 * 400)) for _ in range(300)]
    # around the changes of the clock, to the minute
    for change in ("2025-10-26 00:30", "2025-11-02 00:30", "2026-03-08 01:30", "2026-03-29 00:30"):
        days += [datetime.fromisoformat(change) + timedelta(minutes=10 * k) for k in range(18)]
    forms = {
        "%Y-%m-%d %H:%M:00": "%Y-%m-%d %H:%M:00",
        "%Y-%m-%dT%H:%M": "%Y-%m-%dT%H:%M",
        "%d/%m/%Y %H:%M": "%d/%m/%Y %H:%M",
        "%d.%m.%Y, %H:%M": "%d.%m.%Y, %H:%M",
    }
    for form in forms:
        assert utc([d.strftime(form) for d in days], zone) == [expected(d, zone) for d in days]
    assert utc([f"{d.day} de {ES[d.month - 1]} de {d.year}, {d.hour}:{d.minute:02d}" for d in days], zone) == [expected(d, zone) for d in days]
    assert utc([f"{EN[d.month - 1]} {d.day} {d.year} {d:%H:%M}" for d in days], zone) == [expected(d, zone) for d in days]
    assert utc([f"{d.month}/{d.day}/{d.year} {(d.hour + 11) % 12 + 1}:{d.minute:02d} {'PM' if d.hour > 11 else 'AM'}" for d in days], zone, True) == [expected(d, zone) for d in days]
    assert utc([f"{d.day}/{d.month}/{d.year} {(d.hour + 11) % 12 + 1}:{d.minute:02d} {'p. m.' if d.hour > 11 else 'a. m.'}" for d in days], zone) == [expected(d, zone) for d in days]


def test_forms_with_their_own_zone():
    texts = ["2026-04-17T19:26:56-05:00", "2026-04-17 19:26:56 -0500", "Fri, 17 Apr 2026 19:26:56 -0500", "Fri, 17 Apr 2026 19:26:56 EST", "Sat, 18 Apr 2026 00:26:56 GMT", "20260418T002656Z", "2026-04-18t00:26:56z"]
    assert utc(texts, "Europe/Madrid") == ["2026-04-18T00:26:56.000000Z"] * len(texts)


def test_counts_and_calendar_digits():
    base = 1776471896
    assert utc([str(base), f"{base}123", f"{base}123456", f"{base}123456789", "20260418002456"], "UTC") == [
        "2026-04-18T00:24:56.000000Z", "2026-04-18T00:24:56.123000Z", "2026-04-18T00:24:56.123456Z", "2026-04-18T00:24:56.123456Z", "2026-04-18T00:24:56.000000Z",
    ]


def test_fractions_are_cut_off_and_midnight():
    assert utc(["2026-01-02T03:04:05.987654999Z", "2026-01-02T03:04:05.9Z"]) == ["2026-01-02T03:04:05.987654Z", "2026-01-02T03:04:05.900000Z"]
    assert utc(["2026-01-02"], "America/Panama") == ["2026-01-02T05:00:00.000000Z"]


def test_what_names_no_date_is_unusable():
    bad = ["2026-02-30", "2026-13-01", "24:10", "hoy 14:49", "yesterday", "hace 3 días", "--", "N/D", "31/04/2026 10:00", "2026-01-15T24:75:00Z", "32 de enero de 2026, 9:14",
           "Thu, 32 Jan 2026 10:00:00 GMT", "0000-00-00 00:00:00", "20261340T250000Z", "12", "99999999", "1/1/2026 13:00 PM", "2026-01-01T10:00:00+99:00", "13/13/2026", "５-5"]
    assert utc(bad) == [None] * len(bad)
    assert to_utc_micros(pa.array([None, "", "  "], type=pa.string()), pa.array(["UTC"] * 3), np.zeros(3, bool), TABLES).tolist() == [INVALID] * 3
    assert utc(["2026-01-01 10:00"], "Mars/Base") == [None]  # unknown zone
    assert len(to_utc_micros(pa.array([], type=pa.string()), pa.array([], type=pa.string()), np.zeros(0, bool), TABLES)) == 0


def test_leap_days_and_masks():
    assert utc(["2024-02-29", "2025-02-29", "2000-02-29", "1900-02-29"]) == ["2024-02-29T00:00:00.000000Z", None, "2000-02-29T00:00:00.000000Z", None]
    assert shape_masks(pa.array(["Fri, 17 Apr 2026", "día 3"])).to_pylist() == ["a, 99 a 9999", "a 9"]
    assert parser_of("9999-99-99")[0] == "ymd" and parser_of("a a")[0] == "none"
    assert TABLES["version"] and len(TABLES["zones"]) == len(ZONES)


def test_counts_beyond_any_integer_and_years_beyond_the_tables():
    v = ["9223372036854775807", "9223372036854775808", "9999999999999999999", "0000000000000000000"]
    got = to_utc_micros(pa.array(v), pa.array(["UTC"] * 4), np.zeros(4, dtype=bool), TABLES)
    assert got.tolist() == [9223372036854775, INVALID, INVALID, 0]
    far = ["01/07/1930 12:00", "01/07/2150 12:00", "01/01/2150 12:00"]
    want = [datetime(y, m, 1, 12, tzinfo=ZoneInfo("Europe/Madrid")) for y, m in ((1930, 7), (2150, 7), (2150, 1))]
    got = to_utc_micros(pa.array(far), pa.array(["Europe/Madrid"] * 3), np.zeros(3, dtype=bool), zone_tables(["Europe/Madrid"]))
    assert got.tolist() == [round((w - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1e6) for w in want]
