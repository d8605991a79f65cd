"""Feeds, identity and dead letters on hand-written messages."""

import hashlib
import uuid

from pyspark.sql import functions as F

from haulscope.functions import ids
from haulscope.functions.timeparts import canonical_instant, instant_text, instant_us
from haulscope.operators import asof
from haulscope.plans import ingest

MESSAGE = "message_id string, source string, content_type string, body string, received_us bigint"
HEAD = "ISA*00*1~\nGS*QM*A*B~\n"


def assignments(spark):
    rows = [
        ("SHP-DEL-0001", ["TLM-1", "DEV-1"], "VEH-1", 1000, 2000),
        ("SHP-DEL-0002", ["TLM-1"], "VEH-1", 2000, None),
        ("SHP-DEL-0003", [], "VEH-3", 1000, None),
        ("SHP-DEL-0004", [], "VEH-3", 5000, 6000),
        ("SHP-HYD-0001", ["DEV-9"], "VEH-9", 0, None),
    ]
    return spark.createDataFrame(rows, "shipment_id string, device_ids array<string>, vehicle_id string, from_us bigint, to_us bigint")


def judge(spark, *messages):
    df = spark.createDataFrame([(str(i), s, "text", b, 7) for i, (s, b) in enumerate(messages)], MESSAGE)
    return ingest.judged(df, assignments(spark))


def test_uuid3_matches_the_standard(spark):
    def name_uuid(text):
        return str(uuid.UUID(bytes=hashlib.md5(text.encode()).digest(), version=3))

    row = spark.range(1).select(
        ids.uuid3(F.lit("A"), F.lit(None), F.lit("b")).alias("x"), ids.incident_id(F.lit("T"), F.lit("s"), F.lit(None), F.lit(1_500_000)).alias("y")
    ).first()
    assert row.x == name_uuid("A||b")
    assert row.y == name_uuid("INCIDENT|T|s||1970-01-01T00:00:01.500Z")


def test_instants(spark):
    texts = ["2026-09-03T18:48:49.910992300Z", "2026-09-03T18:48:49.100Z", "2026-09-03T18:48:49Z", "2026-09-03T18:48:49.12Z", "2026-09-03T20:48:49+02:00", "soon"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_instant(F.col("t")), instant_us(F.col("t"))).collect()
    assert [r[0] for r in rows] == [
        "2026-09-03T18:48:49.910992300Z", "2026-09-03T18:48:49.100Z", "2026-09-03T18:48:49Z", "2026-09-03T18:48:49.120Z", "2026-09-03T18:48:49Z", None,
    ]
    assert rows[0][1] % 1_000_000 == 910_992 and rows[5][1] is None
    micros = spark.createDataFrame([(0,), (120_000,), (1_000_010,)], "u bigint").select(instant_text(F.col("u"))).collect()
    assert [r[0] for r in micros] == ["1970-01-01T00:00:00Z", "1970-01-01T00:00:00.120Z", "1970-01-01T00:00:01.000010Z"]


def test_asof_is_half_open_and_contradictions_vanish(spark):
    facts = [("vehicle", "VEH-1", t) for t in (999, 1000, 1999, 2000)] + [("vehicle", "VEH-3", t) for t in (4999, 5000, 5999, 6000)]
    df = spark.createDataFrame(facts, "key_kind string, key string, at_us bigint")
    got = [r.as_shipment for r in asof.resolve(df, asof.unambiguous_periods(assignments(spark))).orderBy("key", "at_us").collect()]
    one, two, three = "SHP-DEL-0001", "SHP-DEL-0002", "SHP-DEL-0003"
    assert got == [None, one, one, two, three, None, None, three]


def test_json_feeds(spark):
    at = "1970-01-01T00:00:00.001500Z"
    rows = judge(
        spark,
        ("TELEMATICS", '{"deviceId":"TLM-1","vehicle":{"id":"VEH-1"},"gps":{"lat":1.0,"lon":2.0,"speedMph":10.0,"headingDeg":-90.0,"hdop":2.0,"fixTime":"%s"},"odometer":{"value":2,"unit":"Mi"},"extra":1}' % at),
        ("TELEMATICS", '{"vehicle":{"id":"VEH-1"},"gps":{"lat":NaN,"lon":2.0,"fixTime":"%s"}}' % at),
        ("TELEMATICS", '{"vehicle":{"id":"VEH-1"},"gps":{"lat":1.0'),
        ("TELEMATICS", ""),
        ("TELEMATICS", '{"vehicle":{"id":"VEH-1"},"gps":{"lat":1.0,"lon":2.0}}'),
        ("TELEMATICS", '{"vehicle":{"id":"VEH-1"},"gps":{"lat":1.0,"lon":200.0,"speedMph":300.0,"fixTime":"%s"}}' % at),
        ("MOBILE_APP", '{"sid":"SHP-HYD-0001","ts":5,"lat":1,"lng":2,"evt":" Arrive ","stop":"s1"}'),
        ("REEFER_SENSOR", '{"probe":"DEV-9","readingUtc":"%s","tempC":4.5,"setpointC":4.0,"alarm":"A"}' % at),
        ("FAX", "hello"),
    )
    events = {r.message_id: r for r in ingest.events(rows).collect()}
    assert set(events) == {"0", "6", "7"}
    first = events["0"]
    assert (first.shipment_id, first.heading_deg, first.accuracy_m, first.occurred_us) == ("SHP-DEL-0001", 270.0, 10.0, 1500)
    assert round(first.speed_kph, 5) == 16.09344 and round(first.odometer_km, 6) == 3.218688
    assert (events["6"].status, events["6"].stop_id) == ("ARRIVED_AT_STOP", "s1")
    assert (events["7"].temp_c, events["7"].reason_code) == (4.5, "A")
    dead = {r.message_id: (r.reason, r.detail, r.routing_key) for r in ingest.dead_letters(rows).collect()}
    assert dead["1"][0] == dead["2"][0] == "MALFORMED_PAYLOAD" and dead["3"][1] == "empty body"
    assert dead["4"][:2] == ("MISSING_FIELD", "gps.fixTime/sentAt")
    assert dead["5"] == ("INVALID_VALUE", "position.longitude must be less than or equal to 180.0; speedKph must be less than or equal to 250.0", "SHP-DEL-0001")
    assert dead["8"][0] == "UNSUPPORTED_FEED"


def st(n, ship="SHP-HYD-0001", code="X3", count=5, control=None, tail=True, at="19700102*0000*UT"):
    text = f"ST*214*{n:04d}~\nB10*1*{ship}*F~\nLX*1~\nAT7*{code}*NS***{at}~\n"
    return text + (f"SE*{count}*{control or f'{n:04d}'}~\n" if tail else "")


def test_interchanges(spark):
    good = HEAD + st(1) + st(2, code="SD", at="19700101*2000*ED") + "GE*2*1~\nIEA*1*1~"
    cases = [
        good,
        HEAD + st(1) + st(2, count=9) + "GE*2*1~IEA*1~",
        HEAD + st(1) + st(2, control="7777") + "GE*2*1~IEA*1~",
        HEAD + st(1, tail=False) + st(2) + "GE*2*1~IEA*1~",
        HEAD + st(1) + "GE*3*1~IEA*1~",
        HEAD + st(1) + "GE*1*1~",
        HEAD + st(1) + st(2, code="QQ"),
        HEAD + "GE*0*1~IEA*1~",
        "<html>",
        HEAD + st(1, at="19701402*0000*UT") + "GE*1*1~IEA*1~",
        HEAD + st(1, at="19700102*0000*ZZ") + "GE*1*1~IEA*1~",
    ]
    rows = judge(spark, *[("EDI_214", c) for c in cases])
    published = {}
    for r in ingest.events(rows).collect():
        published.setdefault(r.message_id, []).append(r)
    assert {k: len(v) for k, v in published.items()} == {"0": 2, "1": 1, "2": 1, "3": 1, "4": 1, "5": 1, "6": 1}
    assert {r.occurred_us for r in published["0"]} == {86_400_000_000}  # both are midnight UTC
    dead = {r.message_id: (r.reason, r.detail) for r in ingest.dead_letters(rows).collect()}
    bad = "MALFORMED_PAYLOAD"
    assert dead == {
        "1": (bad, "transaction set 2: SE declares 9 segments, found 5"),
        "2": (bad, "transaction set 2: SE control number 7777 does not match ST 0002"),
        "3": (bad, "transaction set 1: no SE terminator"),
        "4": (bad, "GE declares 3 transaction sets, found 1"),
        "5": (bad, "interchange truncated: no IEA footer"),
        "6": (bad, "transaction set 2: unknown shipment status code QQ; interchange truncated: no GE footer"),
        "7": ("MISSING_FIELD", "interchange contains no transaction sets"),
        "8": (bad, "expected an ISA header, found <HTML>"),
        "9": ("INVALID_VALUE", "transaction set 1: unreadable AT7 date/time 19701402 0000"),
        "10": ("INVALID_VALUE", "transaction set 1: unusable AT7 time zone code ZZ"),
    }
    verdicts = {r.message_id: r.verdict for r in ingest.verdicts(rows).collect()}
    assert verdicts["0"] == "ACCEPTED" and verdicts["1"] == "PARTIAL" and verdicts["8"] == "DEAD_LETTERED"


def test_interchange_files(spark, tmp_path):
    from haulscope.sources import edi

    (tmp_path / "a.edi").write_text(HEAD + st(1) + "GE*1*1~IEA*1~")
    (tmp_path / "b.edi").write_text(HEAD + st(1, ship="SHP-NO-1") + "GE*1*1~IEA*1~")
    rows = ingest.judged(edi.read_interchanges(spark, str(tmp_path), 5), assignments(spark))
    assert ingest.events(rows).count() == 1 and ingest.dead_letters(rows).first().reason == "UNRESOLVED_IDENTITY"
