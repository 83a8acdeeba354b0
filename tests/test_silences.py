"""The silence stream where a record has many rows, or its rows lie exactly at the deadlines."""

import time
from datetime import timedelta

from tests.test_streams import at, rocksdb, silences_of  # noqa: F401


def test_rows_at_the_deadline_and_just_after_it(spark, tmp_path, rocksdb):  # noqa: F811
    """In time: a row 60 s later, and one in a later micro-batch; too late: one a microsecond after that. What the watermark has only reached isn't told."""
    after = timedelta(microseconds=1)
    first = [(1, at(), 1, "PENDING"), (2, at(), 1, "PENDING"), (3, at(), 1, "PENDING"), (3, at(), 2, "STORED"), (4, at(0, 30), 1, "PENDING")]
    batches = [first, [(1, at(1), 2, "STORED"), (2, at(1) + after, 2, "STORED"), (5, at(1, 30), 1, "PENDING")], [(9, at(3, 30), 1, "STORED")]]
    got, twin = silences_of(spark, batches, tmp_path, "deadlines")
    assert got == twin == [(2, "STALE", "", at(1)), (4, "STALE", "", at(1, 30))]


def test_a_record_of_many_rows_is_read_once(spark, tmp_path, rocksdb):  # noqa: F811
    """Three records of 4,000 rows, two minutes apart: the work must not grow with the square of a record's rows."""
    rows = [(k, at(2 * n), n, "PENDING" if n % 3 else "STORED") for k in range(3) for n in range(4000)]
    began = time.time()
    got, twin = silences_of(spark, [rows], tmp_path, "many")
    assert got == twin and len(got) == 3 * 2665 and time.time() - began < 60
