from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows_of

from cohortspark.functions.timestamps import with_parsed
from cohortspark.operators import timezones
from cohortspark.plans import problem_queries as q

SITES = [
    {"site_code": "BER", "time_zone": "Europe/Berlin", "date_order": "dmy"},
    {"site_code": "NYC", "time_zone": "America/New_York", "date_order": "mdy"},
    {"site_code": "KOL", "time_zone": "Asia/Kolkata", "date_order": "dmy"},
]


def us(text: str) -> int:
    return round((dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


CASES = [
    ("BER", "2023-01-05T10:00:00Z", us("2023-01-05T10:00:00")),
    (None, " 2023-01-05t10:00:00z ", us("2023-01-05T10:00:00")),
    ("BER", "2023-01-05T10:00", us("2023-01-05T09:00:00")),
    ("BER", "2023-07-05 10:00:00.123456789", us("2023-07-05T08:00:00") + 123456),
    ("BER", "2023-07-05 10:00:00,5", us("2023-07-05T08:00:00") + 500000),
    (None, "2023-01-05 10:00:00", None),
    ("XXX", "2023-01-05 10:00:00", None),
    ("NYC", "2023-01-05T10:00:00-05:30", us("2023-01-05T15:30:00")),
    ("NYC", "2023-01-05T10:00:00−07:00", us("2023-01-05T17:00:00")),
    ("NYC", "2023-01-05T10:00:00+0530", us("2023-01-05T04:30:00")),
    ("NYC", "2023-01-05T10:00:00-05", us("2023-01-05T15:00:00")),
    ("NYC", "2023-01-05T10:00:00-07:00[America/Phoenix]", us("2023-01-05T17:00:00")),
    (None, "2023-01-05T10:00:00 America/Phoenix", us("2023-01-05T17:00:00")),
    (None, "2023-01-05T10:00:00 Atlantis/City", None),
    ("BER", "05.01.2023 10:00", us("2023-01-05T09:00:00")),
    ("NYC", "01/05/2023 10:00 PM", us("2023-01-06T03:00:00")),
    ("NYC", "01/05/2023 12:10 AM", us("2023-01-05T05:10:00")),
    ("NYC", "13/05/2023 10:00", None),
    (None, "05.01.2023 10:00", None),
    ("BER", "Jan 5, 2023 10:10:50 AM CET", us("2023-01-05T09:10:50")),
    ("KOL", "Jan 5, 2023 12:10:50 PM IST", us("2023-01-05T06:40:50")),
    ("BER", "Jan 5, 2023 10:10:50 AM EST", None),
    (None, "Jan 5, 2023 10:10:50 AM CET", None),
    ("BER", "Thu, 05 Jan 2023 04:57:39 +0100", us("2023-01-05T03:57:39")),
    ("BER", "20230105T102054Z", us("2023-01-05T10:20:54")),
    ("BER", "1672878188", 1672878188 * 10**6),
    ("BER", "1672886737144", 1672886737144 * 1000),
    ("BER", "1.672878858E9", 1672878858 * 10**6),
    ("BER", "1e25", None),
    ("BER", "9" * 19, None),
    ("BER", "1672878188000000000", 1672878188000000),
    ("BER", "9" * 400, None),
    ("BER", "2023-03-26 02:30:00", None),  # skipped
    ("BER", "2023-10-29 02:30:00", us("2023-10-29T00:30:00")),  # twice: the earlier
    ("BER", "Oct 29, 2023 2:30:00 AM CET", us("2023-10-29T01:30:00")),  # the text decides
    ("BER", "2023-02-30T10:00:00Z", None),
    ("BER", "2025-06-31 25:10:00", None),
    ("BER", "0000-00-00 00:00:00", None),
    ("BER", "2023-01-05", None),
    ("BER", "see paper form", None),
    ("BER", "", None),
    ("BER", None, None),
    ("BER", "x" * 20000, None),
]


def test_written_moments(spark, study):
    sessions = [{"session_id": i, "site_code": s, "started_at": v} for i, (s, v, _) in enumerate(CASES)]
    folder = study(study_site=SITES, response_session=sessions)
    got = {r.row_key: r.utc_us for r in q.p1_found(spark, folder).collect()}
    assert got == {i: u for i, (_, _, u) in enumerate(CASES) if u is not None}


def test_responses_belong_to_the_site_in_the_subject(spark, study):
    rows = [
        {"rec_no": 1, "authored": "05.01.2023 10:00", "subject": ("Patient/BER::P1",)},
        {"rec_no": 2, "authored": "05.01.2023 10:00", "subject": None},
        {"rec_no": 3, "authored": None, "subject": ("Patient/BER::P1",)},
    ]
    got = rows_of(q.p1_found(spark, study(study_site=SITES, phq9_fhir_responses=rows)))
    assert got == [("phq9_fhir_responses", 1, "authored", us("2023-01-05T09:00:00"))]


@pytest.mark.parametrize("true_zone", ["America/Chicago", "Asia/Kolkata"])
def test_zone_is_estimated_from_ingestion(spark, true_zone):
    import zoneinfo

    values, base = [], dt.datetime(2023, 1, 1, tzinfo=dt.timezone.utc)
    for i in range(600):
        moment = base + dt.timedelta(hours=14 * i, seconds=i)
        arrived = moment + dt.timedelta(minutes=(i * 37) % 150)
        local = moment.astimezone(zoneinfo.ZoneInfo(true_zone)).strftime("%Y-%m-%d %H:%M:%S")
        values.append(("S", local if i % 3 else moment.strftime("%Y-%m-%dT%H:%M:%SZ"), int(arrived.timestamp() * 1e6)))
    df = spark.createDataFrame(values, "site string, value string, arrived_us bigint")
    for declared, expected in ((None, true_zone), (true_zone, true_zone), ("Australia/Sydney", true_zone)):
        sites = spark.createDataFrame([("S", declared, "dmy")], "site string, time_zone string, date_order string")
        row = timezones.estimate_zones(timezones.parse_values(df, sites), sites).first()
        assert row.time_zone == expected


def test_clean_registry_zone_stands_on_any_number_of_values(spark, study):
    base = dt.datetime(2023, 1, 1)
    rows = [{"session_id": i, "site_code": "BER", "started_at": f"{base + dt.timedelta(hours=5 * i):%Y-%m-%d %H:%M:%S}", "created_at": f"{base + dt.timedelta(hours=5 * i + 5):%Y-%m-%dT%H:%M:%SZ}"} for i in range(240)]
    rows += [r | {"session_id": 1000 + i, "started_at": f"{base + dt.timedelta(hours=5 * i + 4, minutes=50):%Y-%m-%dT%H:%M:%SZ}"} for i, r in enumerate(rows)]
    zones = {r.site: r.time_zone for r in q.p1_site_zones(spark, study(study_site=SITES, response_session=rows)).collect()}
    assert zones["BER"] == "Europe/Berlin"


def test_clashing_columns_survive(spark):
    df = spark.createDataFrame([("2023-01-05T10:00:00Z", 1, 2)], "value string, parts_ int, _v int")
    out = with_parsed(df, "parts", df.value, df.value).first()
    assert out._v == 2 and out.parts.us == us("2023-01-05T10:00:00")


def test_empty(spark, study):
    folder = study()
    assert q.p1_found(spark, folder).count() == 0
    assert q.p1_site_zones(spark, folder).count() == 0
