"""Streams over more files than one batch once took."""

import os
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

from strata.streaming import activity as live


def test_old_rows_of_late_files_count(spark, tmp_path):
    at = tmp_path / "events.parquet"
    at.mkdir()
    for i in range(1001):
        row = {"event_id": [i], "ts": [datetime(2024, 12, 1) - timedelta(hours=i)], "user_id": [i], "event_type": ["view"], "value": [1.0]}
        pq.write_table(pa.table(row), at / f"{i:04}.parquet")
        os.utime(at / f"{i:04}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    assert live.drain(live.deduplicated(live.stream_activity(spark, str(tmp_path))), "append", f"late-{os.getpid()}").count() == 1001
