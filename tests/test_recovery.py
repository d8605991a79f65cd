"""Stateful streams that die between their sink and the commit, and go on from their checkpoint."""

import pytest
from pyspark.errors import StreamingQueryException

from haulscope.catalog import queries as catalog
from haulscope.session import new_table
from haulscope.streaming import flows

DATA = "/root/testdata/sf0.001"
DEATHS = 3


@pytest.fixture
def dying(spark, monkeypatch):
    """Every stream is killed in its first batches, each once: what the sink wrote is there, the batch is not committed."""
    plain, killed = flows.run_batches, []

    def run_batches(stream, name, each, mode="append", checkpoint=None):
        checkpoint = checkpoint or f"{new_table(spark, name)}-checkpoint"
        done = set()

        def sink(batch, batch_id):
            each(batch, batch_id)
            if batch_id < DEATHS and batch_id not in done:
                done.add(batch_id)
                killed.append(batch_id)
                raise RuntimeError("killed")

        while True:
            try:
                return plain(stream, name, sink, mode, checkpoint)
            except StreamingQueryException as death:
                assert "killed" in str(death)

    def run_to_table(stream, name, mode="append"):
        path = new_table(spark, name)
        run_batches(stream, name, flows.batch_folders(path), mode)
        return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)

    monkeypatch.setattr(flows, "run_batches", run_batches)
    monkeypatch.setattr(flows, "run_to_table", run_to_table)
    return killed


@pytest.mark.parametrize(
    "streamed, batch",
    [
        ("stream_geofence_events", "geofence_events"),
        ("stream_eta_updates", "eta_updates"),
        ("stream_incidents", "incident_table"),
        ("stream_late_arrivals", "late_arrivals"),
        ("stream_current_position", "current_position"),
    ],
)
def test_a_killed_stream_ends_like_the_batch_form(spark, dying, streamed, batch):
    want = catalog.QUERIES[batch](spark, DATA)
    got = catalog.QUERIES[streamed](spark, DATA).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert dying == list(range(DEATHS))


def test_a_killed_watch_for_silence(spark, dying, monkeypatch):
    changes = sorted(map(repr, catalog.QUERIES["stream_signal_loss"](spark, DATA).collect()))
    assert len(dying) == DEATHS
    monkeypatch.undo()
    assert changes == sorted(map(repr, catalog.QUERIES["stream_signal_loss"](spark, DATA).collect()))
