"""When archive files are closed, and how far a reader may commit."""

import pytest

from haulscope.plans import archive
from haulscope.session import new_table
from haulscope.streaming.closing import ArchiveCloser, Policy

SECOND, HOUR = 1_000_000, 3_600_000_000
H14 = 1_788_228_000_000_000 // HOUR * HOUR
POS, STATUS = "fleet.position", "fleet.status"
SCHEMA = f"{archive.RECORD_SCHEMA}, headers array<struct<key:string,value:binary>>, heard_us bigint"


class Drive:
    """Batches of (topic, partition, offset, timestamp) heard at one instant each."""

    def __init__(self, spark, policy=Policy()):
        self.spark, self.closer, self.batch = spark, ArchiveCloser(new_table(spark, "closer"), policy), -1

    def step(self, now, *records, value=None, headers=()):
        self.batch += 1
        rows = [(t, p, o, ts, f"SHP-{p}", value or f'{{"eventId":"{t}{p}-{o}"}}', list(headers), now) for t, p, o, ts in records]
        rows = rows or [(None, None, None, None, None, None, None, now)]
        self.closer(self.spark.createDataFrame(rows, SCHEMA), self.batch)
        return self

    def again(self, now, *records):
        self.batch -= 1
        return self.step(now, *records)

    def closed(self):
        rows = self.closer.closed(self.spark, self.batch + 1).collect()
        return sorted((r.batch, r.topic, (r.hour_us - H14) // HOUR, r.file, r.records, r.reason) for r in rows)

    def committable(self):
        return {(r.topic, r.partition): r.committable for r in self.closer.committable(self.spark, self.batch).collect()}

    def files(self):
        return self.spark.read.schema(f"record_topic string, {archive.RECORD_SCHEMA}, dt string, hour string").json(f"{self.closer.path}/files")


def test_an_hour_is_one_file_whatever_the_partition_and_closes_when_over_and_quiet(spark):
    late = H14 + 3599 * SECOND
    drive = Drive(spark).step(late, (POS, 0, 10, late), (POS, 7, 99, late), (STATUS, 1, 5, H14))
    drive.step(H14 + HOUR + 10 * SECOND)
    assert drive.closed() == []
    drive.step(late + 60 * SECOND)
    assert drive.closed() == [(2, POS, 0, 0, 2, "quiet"), (2, STATUS, 0, 0, 1, "quiet")]
    assert drive.files().groupBy("topic", "hour").count().count() == 2


def test_a_pause_within_the_hour_closes_nothing(spark):
    drive = Drive(spark).step(H14 + 60 * SECOND, (POS, 0, 1, H14)).step(H14 + 1260 * SECOND)
    assert drive.closed() == []


def test_an_old_hour_being_read_stays_one_file(spark):
    now = H14 + 10 * HOUR
    drive = Drive(spark)
    for k in range(4):
        drive.step(now + k * SECOND, (POS, k, k, H14 + k * SECOND))
    assert drive.closed() == []
    drive.step(now + 63 * SECOND)
    assert drive.closed() == [(4, POS, 0, 0, 4, "quiet")]


def test_a_grown_file_closes_and_a_straggler_starts_the_next(spark):
    drive = Drive(spark, Policy(max_file_bytes=1)).step(H14, (POS, 0, 1, H14)).step(H14 + SECOND, (POS, 0, 2, H14 + 5))
    assert drive.closed() == [(0, POS, 0, 0, 1, "size"), (1, POS, 0, 1, 1, "size")]
    assert sorted(r.offset for r in drive.files().collect()) == [1, 2]


def test_a_batch_larger_than_a_file_is_written_whole(spark):
    drive = Drive(spark, Policy(max_file_bytes=500)).step(H14, *[(POS, 0, n, H14) for n in range(200)])
    assert sorted(r.offset for r in drive.files().collect()) == list(range(200))


def test_the_oldest_hour_goes_first_when_too_much_is_open(spark):
    now, size = H14 + 5 * HOUR, len("SHP-0") + len("x" * 20)
    drive = Drive(spark, Policy(max_open_bytes=2 * size))
    drive.step(now, (POS, 0, 1, H14 + 2 * HOUR), (POS, 1, 1, H14), (POS, 2, 1, H14 + HOUR), value="x" * 20)
    assert drive.closed() == [(0, POS, 0, 0, 1, "buffer")]


def test_offsets_are_committable_behind_the_oldest_open_record(spark):
    now = H14 + 2 * HOUR
    drive = Drive(spark).step(now, (POS, 0, 10, H14), (POS, 0, 11, now), (POS, 3, 40, now))
    assert drive.committable() == {(POS, 0): 10, (POS, 3): 40}
    drive.step(now + 90 * SECOND)
    assert drive.closed() == [(1, POS, 0, 0, 1, "quiet")]
    assert drive.committable() == {(POS, 0): 11, (POS, 3): 40}


def test_a_newer_hour_that_is_written_does_not_let_an_older_one_go(spark):
    now = H14 + 2 * HOUR
    drive = Drive(spark, Policy(max_file_bytes=60)).step(now, (POS, 0, 10, H14), *[(POS, 0, n, H14 + HOUR) for n in (11, 12, 13)])
    assert drive.closed() == [(0, POS, 1, 0, 3, "size")]
    assert drive.committable() == {(POS, 0): 10}


def test_a_replay_is_passed_over_and_counts_as_read(spark):
    drive = Drive(spark).step(H14, (POS, 4, 70, H14), headers=[(archive.REPLAY_HEADER, b"f")])
    assert drive.committable() == {(POS, 4): 71}
    assert drive.closed() == []


def test_a_batch_that_is_run_again_writes_the_same(spark):
    odd = '{"eventId":"e1",  "note":"spacing and key order kept"}'
    drive = Drive(spark, Policy(max_file_bytes=100)).step(H14, (POS, 0, 1, H14), value=odd)
    records = [(POS, 0, n, H14) for n in range(2, 9)]
    before = drive.step(H14 + SECOND, *records).closed(), drive.committable(), drive.files().count()
    drive.again(H14 + SECOND, *records)
    assert (drive.closed(), drive.committable(), drive.files().count()) == before
    assert [r.value for r in drive.files().where("offset = 1").collect()] == [odd]


@pytest.mark.parametrize("again", [False, True])
def test_a_shutdown_closes_everything(spark, again):
    drive = Drive(spark).step(H14, (POS, 0, 1, H14), (STATUS, 0, 1, H14))
    for _ in range(1 + again):
        drive.closer.shut_down(spark, drive.batch)
    drive.batch += 1
    assert drive.closed() == [(1, POS, 0, 0, 1, "shutdown"), (1, STATUS, 0, 0, 1, "shutdown")]
    assert drive.committable() == {(POS, 0): 2, (STATUS, 0): 2}
