"""Archive, contracts, reconciliation, live updates and streams on small inputs."""

import json

from pyspark.sql import functions as F

from haulscope.fixtures import archive as archive_fixtures, fleet
from haulscope.model.contracts import CONTRACTS
from haulscope.model.params import DEFAULT
from haulscope.operators import contracts, geofence, manifests, positions, reconcile
from haulscope.plans import archive, live
from haulscope.session import new_table
from haulscope.sources import plan
from haulscope.streaming import flows, tracking

DATA = "/root/testdata/sf0.001"


def test_fold_of_hours_equals_fold_of_all(spark):
    records = archive.layout(archive_fixtures.position_records(fleet.fleet_fixes(spark, DATA)))
    events = archive.decoded(records)
    whole = archive.fold_positions(events)
    hourly = None
    for hour in ("00", "05", "11"):
        part = archive.fold_positions(events.where((F.col("hour") >= hour) & (F.col("hour") < f"{int(hour) + 6:02d}")))
        hourly = part if hourly is None else hourly.unionByName(part)
    newest = hourly.groupBy("shipment_id").agg(F.max("occurred_us").alias("occurred_us"))
    assert newest.exceptAll(whole.select("shipment_id", "occurred_us")).count() == 0


def test_archive_scan_prunes_and_orders(spark):
    records = archive_fixtures.position_records(fleet.fleet_fixes(spark, DATA))
    path = new_table(spark, "archive")
    archive.write(records, path)
    start = fleet.EPOCH_S * 1_000_000
    hour = archive.scan(spark, path, "fleet.position", start + 5)
    kept = archive.skip_replayed(records).where(F.col("timestamp_us") < start + archive.HOUR_US)
    assert hour.count() == kept.count() > 0
    plan_text = hour._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan_text and "topic" in plan_text.split("PartitionFilters")[1][:400]
    report = archive.replay_report(hour).first()
    assert report.misplaced == 0 and report.lines == report.distinct_ids + report.duplicates + report.without_event_id
    assert archive.in_replay_order(hour).count() == report.files
    names = spark.createDataFrame(
        [("x/p0-o1-200.ndjson.gz",), ("x/p0-o9-100.ndjson.gz",), ("x/p1-o2-200.ndjson.gz",)], "file string"
    )
    assert [r.file[4:6] for r in archive.in_replay_order(names).collect()] == ["-o", "-o", "-o"]
    assert archive.in_replay_order(names).first().file == "x/p0-o9-100.ndjson.gz"


def test_a_replay_takes_the_first_line_of_an_event(spark):
    line = lambda hour, written, name, note: (
        "t", "2026-09-01", hour, f"a/{name}-{written}.ndjson.gz", written, 1, "k", json.dumps({"eventId": "e", "note": note})
    )
    lines = [line("03", 5, "p0", "later hour"), line("02", 9, "a", "written later"), line("02", 7, "b", "name later"), line("02", 7, "a", "first")]
    schema = "topic string, dt string, hour string, file string, written_ms bigint, `offset` bigint, `key` string, value string"
    scanned = spark.createDataFrame(lines, schema)
    (sent,) = archive.replay_records(scanned, "again").collect()
    assert json.loads(sent.value)["note"] == "first" and bytes(sent.headers[0].value) == b"a/a-7.ndjson.gz"
    order = [(r.file, r.lines) for r in archive.in_replay_order(scanned).collect()]
    assert order == [("a/a-7.ndjson.gz", 1), ("a/b-7.ndjson.gz", 1), ("a/a-9.ndjson.gz", 1), ("a/p0-5.ndjson.gz", 1)]


def test_clear_without_raise_and_raise_without_clear(spark):
    value = lambda **v: json.dumps({"shipmentId": "s", "occurredAt": "1970-01-01T00:00:01Z", **v})
    rows = [
        ("x", 0, 1, 1, "s", value(eventId="1", type="exception.raised", exceptionId="a", severity="WARNING")),
        ("x", 0, 2, 2, "s", value(eventId="2", exceptionId="b", openFor="PT1S", resolution="RECOVERED")),
        ("x", 0, 3, 3, "s", value(eventId="3", estimatedArrival="1970-01-01T00:00:01Z", stopId="q")),
        ("x", 0, 4, 4, "s", value(eventId="4", dwell="PT1S", stopId="q")),
        ("x", 0, 5, 5, "s", value(eventId="5", stopId="q")),
        ("x", 0, 6, 6, "s", value(eventId="6")),
        ("x", 0, 7, 7, "s", "{broken"),
    ]
    events = archive.decoded(spark.createDataFrame(rows, archive.RECORD_SCHEMA))
    kinds = [r.kind for r in events.orderBy("offset").collect()]
    assert kinds == ["exception.raised", "exception.cleared", "eta.updated", "shipment.departed", "shipment.arrived", None, None]
    pairs = {r.exception_id: (r.state, r.severity, r.resolution) for r in archive.pair_incidents(events).collect()}
    assert pairs == {"a": ("OPEN", "WARNING", None), "b": ("CLEARED", None, "RECOVERED")}


def test_contract_keywords(spark):
    document = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {
            "a": {"type": "integer", "minimum": 1, "maximum": 5}, "b": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^x"},
            "c": {"type": "array", "minItems": 2, "maxItems": 3, "uniqueItems": True, "items": {"type": "string", "enum": ["p", "q"]}},
            "d": {"type": "string", "format": "date"}, "e": {"type": "object", "properties": {"t": {"type": "string", "format": "date-time"}, "n": {"type": "number", "exclusiveMinimum": 0}}},
        },
    }
    rules = contracts.constraints(spark, [("C", "LTL", "3", document)])
    bodies = [
        '{"a":1,"b":"xy","c":["p","q"],"d":"2026-02-28","e":{"t":"2026-02-28T01:02:03Z","n":0.5}}',
        '{"a":1.5,"b":"y","c":["p","p"],"d":"2026-02-30","e":{"t":"noon","n":0}}',
        '{"b":5,"c":["z"],"f":1,"g":2}',
        '{"a":9,"c":[],"e":{}}',
        "[]",
        "not json",
    ]
    df = spark.createDataFrame([(str(i), "C", "LTL", b) for i, b in enumerate(bodies)], "shipment_id string, customer_id string, mode string, body string")
    got = {}
    for r in contracts.violations(df, rules).collect():
        got.setdefault(r.shipment_id, set()).add((r.field, r.constraint))
    assert got == {
        "1": {("/a", "type"), ("/b", "minLength"), ("/b", "pattern"), ("/c", "uniqueItems"), ("/d", "format"), ("/e/t", "format"), ("/e/n", "exclusiveMinimum")},
        "2": {("", "required"), ("", "additionalProperties"), ("/b", "type"), ("/c", "minItems"), ("/c/0", "enum")},
        "3": {("/a", "maximum"), ("/c", "minItems")},
        "4": {("", "type")},
    }
    assert contracts.violations(df, rules).where("constraint = 'additionalProperties'").count() == 2
    stranger = df.where("shipment_id = '0'").withColumn("customer_id", F.lit("X"))
    assert contracts.outcomes(stranger, rules).first().outcome == "NO_SCHEMA"


def test_committed_contracts_keep_the_reserved_paths(spark):
    rules = contracts.constraints(spark, CONTRACTS)
    assert contracts.reserved_path_problems(rules).where("problems <> ''").count() == 0


def test_terms_ignore_wrong_types(spark):
    bodies = ['{"temperature":{"minC":"2","maxC":8}}', '{"temperature":{"minC":2,"maxC":8.5,"excursionToleranceMinutes":1.9}}', '{"deliveryWindow":{"closesAt":"later"}}', "{}"]
    df = spark.createDataFrame([(str(i), "C", "LTL", b) for i, b in enumerate(bodies)], "shipment_id string, customer_id string, mode string, body string")
    rows = {r.shipment_id: r for r in manifests.sla_terms(df).collect()}
    assert [rows[k].cold_chain for k in "0123"] == [False, True, False, False]
    assert (rows["1"].min_c, rows["1"].max_c, rows["1"].tolerance_s) == (2.0, 8.5, 60) and rows["2"].closes_us is None


def test_reconcile_passes_only_when_complete(spark):
    ids = spark.range(10).withColumnRenamed("id", "event_id")
    none = ids.where("event_id < 0")
    assert reconcile.reconcile(ids, ids, none).first().passed
    report = reconcile.reconcile(ids, ids.where("event_id <> 3").union(ids.where("event_id = 4")), none).first()
    assert (report.missing, report.stored_twice, report.passed) == (1, 1, False)


def test_histogram_beyond_the_last_bound(spark):
    df = spark.createDataFrame([(0, 400_000_000), (0, 1_000)], "received_us bigint, stored_us bigint")
    row = reconcile.histogram_percentiles(reconcile.latency_histogram(df)).first()
    assert (row.p50_ms, row.p99_ms) == ("5", ">300000")


def test_live_fold_keeps_delivery_and_stops(spark):
    snapshot = spark.createDataFrame(
        [("a", "MOVING", 0, 2, "n"), ("b", "DELIVERED", 2, 2, None)],
        "shipment_id string, movement string, stops_completed bigint, stops_total bigint, next_stop_id string",
    )
    columns = "shipment_id string, type string, at_us bigint, speed_kph double, stop_id string, estimate_us bigint, exception_id string"
    updates = [
        ("a", "arrived", 1, None, "n", None, None), ("a", "position", 2, 50.0, None, None, None), ("a", "estimate", 3, None, "other", 9, None),
        ("a", "exception.raised", 4, None, None, None, "e1"), ("b", "position", 2, 0.0, None, None, None), ("zz", "position", 2, 0.0, None, None, None),
    ]
    rows = {r.shipment_id: r for r in live.fold(snapshot, spark.createDataFrame(updates, columns)).collect()}
    assert (rows["a"].movement, rows["a"].stops_completed, rows["a"].estimate_us, rows["a"].open_incidents, rows["a"].applied) == ("AT_STOP", 1, None, 1, 3)
    assert rows["b"].movement == "DELIVERED" and set(rows) == {"a", "b"}


def test_stream_in_several_batches_equals_batch(spark):
    fixes = fleet.fleet_fixes(spark, DATA)
    columns = ("event_id", "shipment_id", "lane", "occurred_us", "lat", "lon", "speed_kph", "accuracy_m")
    path = new_table(spark, "batches")
    # files in event-time order; a second sighting of old fixes at the end must change nothing
    start = fleet.EPOCH_S * 1_000_000
    for k in range(4):
        low, high = start + k * 3 * archive.HOUR_US, start + (k + 1) * 3 * archive.HOUR_US
        rows = fixes.select(*columns).where((F.col("occurred_us") >= low) & (F.col("occurred_us") < high))
        rows.coalesce(1).write.mode("append").parquet(path)
    fixes.select(*columns).where("event_id % 10 = 0").coalesce(1).write.mode("append").parquet(path)
    plans = plan.lane_plans(spark)
    stream = flows.file_source(spark, path, fixes.select(*columns).schema, files_per_trigger=1)
    derived = flows.run_to_table(tracking.derived_events(stream, plans, DEFAULT), "derived").where("type <> 'eta.updated'")
    batch = geofence.visit_events(geofence.visits_of_track(positions.one_per_instant(fixes), plan.lane_stops(spark)))
    assert sorted(r.event_id for r in derived.collect()) == sorted(r.event_id for r in batch.collect())


def test_history_keeps_late_rows_and_progress_is_tabular(spark):
    fixes = fleet.fleet_fixes(spark, DATA)
    source, target = new_table(spark, "fixes"), new_table(spark, "history")
    fixes.write.parquet(source)
    stream = flows.file_source(spark, source, fixes.schema)
    query = flows.history_sink(stream, target, f"{target}-checkpoint")
    query.awaitTermination()
    assert spark.read.parquet(target).count() == fixes.count()
    assert flows.progress_table(spark, query.recentProgress).agg(F.sum("input_rows")).first()[0] == fixes.count()


def test_windowed_throughput_stream(spark):
    fixes = fleet.fleet_fixes(spark, DATA)
    source = new_table(spark, "fixes")
    fixes.write.parquet(source)
    stream = flows.windowed_throughput(flows.file_source(spark, source, fixes.schema), "0 seconds")
    closed = flows.run_to_table(stream, "throughput")
    batch = {r.window_us: r.records for r in reconcile.throughput(fixes, "received_us").collect()}
    rows = closed.collect()
    assert rows and all(batch[r.window_us] == r.records for r in rows)


def test_live_fold_ties_and_incidents_held_before(spark):
    snapshot = spark.createDataFrame(
        [("a", "STOPPED", 0, 3, "s1", ["x", "y"]), ("b", "STOPPED", 0, 3, "s1", [])],
        "shipment_id string, movement string, stops_completed bigint, stops_total bigint, next_stop_id string, open_ids array<string>",
    )
    rows = [
        ("a", "exception.cleared", 50, None, None, None, "x"),
        ("a", "exception.raised", 60, None, None, None, "z"),
        # a raise and its clear at one instant, in either order of arrival
        ("b", "exception.cleared", 70, None, None, None, "w"),
        ("b", "exception.raised", 70, None, None, None, "w"),
    ]
    updates = spark.createDataFrame(
        rows, "shipment_id string, type string, at_us bigint, speed_kph double, stop_id string, estimate_us bigint, exception_id string"
    )
    open_ = {r.shipment_id: (r.open_incidents, r.applied) for r in live.fold(snapshot, updates).collect()}
    assert open_ == {"a": (2, 2), "b": (0, 2)}


def _nested(levels, leaf):
    body = leaf
    for _ in range(levels):
        body = {"n": body}
    return body


def test_contracts_at_any_depth_and_newest_version_only(spark):
    import json

    schema = lambda low: {
        "type": "object", "properties": {"n": _nested(0, {"type": "object", "properties": {"n": {"type": "object", "properties": {
            "n": {"type": "object", "properties": {"n": {"type": "object", "properties": {"n": {"type": "object", "properties": {
                "n": {"type": "number", "minimum": low}}}}}}}}}}})}}
    rules = contracts.constraints(spark, [("c", "m", "9", schema(5)), ("c", "m", "10", schema(3))])
    bodies = [("low", 1), ("middle", 4), ("high", 7)]
    manifests = spark.createDataFrame(
        [(k, "c", "m", json.dumps(_nested(6, v))) for k, v in bodies], "shipment_id string, customer_id string, mode string, body string"
    )
    out = {r.shipment_id: (r.version, r.outcome, r.violations) for r in contracts.outcomes(manifests, rules).collect()}
    assert out == {"low": ("10", "INVALID", 1), "middle": ("10", "VALID", 0), "high": ("10", "VALID", 0)}
    assert contracts.flatten(manifests).where("path = '/n/n/n/n/n/n'").count() == 3
    tricky = spark.createDataFrame([("t", '{"a": "[[[[{{", "b": "\\\\"}')], "shipment_id string, body string")
    assert contracts.flatten(tricky).count() == 3


def test_a_body_nested_deeply_does_not_make_a_deep_plan(spark):
    levels = 120
    rows = [("deep", "[" * levels + "1" + "]" * levels), ("flat", '{"a": 1}'), ("bare", "7"), ("broken", "{"), ("none", None)]
    bodies = spark.createDataFrame(rows, "shipment_id string, body string")
    nodes = contracts.flatten(bodies)
    assert len(nodes._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 60
    found = {r.shipment_id: r["count"] for r in nodes.groupBy("shipment_id").count().collect()}
    assert found == {"deep": levels + 1, "flat": 2, "bare": 1}
    by_level = contracts.flatten(bodies.where("shipment_id <> 'deep'"), levels=4)
    assert sorted(by_level.collect()) == sorted(nodes.where("shipment_id <> 'deep'").collect())


def test_sections_and_tables_of_ragged_bodies(spark):
    body = (
        '{"zone": null, "pieces": [{"kg": 1, "box": {"z": 1, "a": [2]}}, {"note": "x", "kg": null}], "mixed": [{"a": 1}, 2], "holes": [{"a": 1}, null],'
        ' "words": ["{}", "a"], "none": [], "temperature": {"inner": {"temperature": {}, "rows": [{"b": "1"}]}}, "deliveryWindow": 5}'
    )
    bodies = spark.createDataFrame([("s", body), ("array", '[{"a": 1}]'), ("empty", "{}")], "shipment_id string, body string")
    found = sorted((r.path, r["class"], r.entries, r.reserved) for r in contracts.sections(bodies).collect())
    assert found == [
        ("/deliveryWindow", "field", None, False), ("/holes", "list", 2, False), ("/mixed", "list", 2, False), ("/none", "list", 0, False),
        ("/pieces", "table", 2, False), ("/temperature", "group", 1, True), ("/temperature/inner", "group", 2, False),
        ("/temperature/inner/rows", "table", 1, False), ("/temperature/inner/temperature", "group", 0, False), ("/words", "list", 2, False),
        ("/zone", "field", None, False),
    ]
    cells = sorted((r.path, r.row, r.place, r.name, r.value) for r in contracts.tables(bodies).collect())
    assert cells == [
        ("/pieces", 0, 0, "kg", "1"), ("/pieces", 0, 1, "box", '{"z":1,"a":[2]}'), ("/pieces", 0, 2, "note", None),
        ("/pieces", 1, 0, "kg", None), ("/pieces", 1, 1, "box", None), ("/pieces", 1, 2, "note", "x"),
        ("/temperature/inner/rows", 0, 0, "b", "1"),
    ]


def test_contracts_are_read_from_files(spark, tmp_path):
    import json

    document = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}}}
    line = {"customerId": "c", "mode": "m", "version": "2", "schema": document}
    (tmp_path / "contracts.json").write_text(json.dumps(line) + "\n")
    got = {tuple(r) for r in contracts.read_contracts(spark, str(tmp_path)).collect()}
    assert got == {("c", "m", "2", *r) for r in contracts.compile_contract(document)}


def test_archive_stream_counts_a_repeated_batch_once(spark):
    """A crash between writing a batch and committing it: the batch is written again, and read once."""
    import glob
    import os

    fixes = fleet.fleet_fixes(spark, DATA).limit(400)
    records = archive_fixtures.position_records(fixes)
    source, path = new_table(spark, "records"), new_table(spark, "archive")
    records.repartition(3).write.parquet(source)
    expected = archive.skip_replayed(spark.read.parquet(source)).count()
    stream = lambda: flows.file_source(spark, source, records.schema, files_per_trigger=1)
    flows.archive_stream(stream(), path).awaitTermination()
    local = path.removeprefix("file:")
    commits = sorted(glob.glob(f"{local}-checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    assert len(commits) >= 3
    os.remove(commits[-1])  # as if the run had died before this
    os.remove(f"{os.path.dirname(commits[-1])}/.{os.path.basename(commits[-1])}.crc")
    flows.archive_stream(stream(), path).awaitTermination()
    schema = f"record_topic string, {archive.RECORD_SCHEMA}, dt string, hour string"
    assert spark.read.schema(schema).json(path).count() == expected


def test_current_sink_is_the_same_after_a_repeated_batch(spark):
    fixes = fleet.fleet_fixes(spark, DATA)
    path = new_table(spark, "current")
    schema = flows.current_positions(fixes).schema
    write = flows.upsert_current(path, schema)
    half = fixes.agg(F.percentile("occurred_us", 0.5)).first()[0]
    first, second = fixes.where(F.col("occurred_us") <= half), fixes.where(F.col("occurred_us") > half)
    write(flows.current_positions(first), 0)
    for _ in range(2):
        write(flows.current_positions(second), 1)
    # a late row must not move anything back
    write(flows.current_positions(first.limit(50)), 2)
    got = {(r.shipment_id, r.event_id) for r in flows.latest_version(spark, path, schema).collect()}
    assert got == {(r.shipment_id, r.event_id) for r in positions.current_position(fixes).collect()}


def test_orders_of_reports(spark):
    """Reports with an order promise it row by row, not only as a set."""
    from haulscope.catalog.queries import QUERIES

    recent = [(r.onset_us, r.exception_id) for r in QUERIES["recent_incidents"](spark, DATA).collect()]
    assert recent and recent == sorted(recent, key=lambda r: (-r[0], r[1]))
    resolved = [(r.at_us, r.exception_id) for r in QUERIES["resolved_incidents"](spark, DATA).collect()]
    assert resolved == sorted(resolved, key=lambda r: (-r[0], r[1]))
