import datetime as dt

import pytest

from tesselite.operators import changes, conversation
from tesselite.streaming import turns

M = "conv_id long, turn long, role string, content string"


def test_stream_of_turns_equals_batch(spark, tmp_path):
    data = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in range(5) for t in range(9)]
    for n in range(3):
        spark.createDataFrame([r for r in data if r[1] // 3 == n], M).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame(data, M)
    stream = spark.readStream.schema(M).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = turns.retained_turns(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.conv_id, r.turn_no, r.text) for r in conversation.retained_turns(batch, 2).collect()}
    assert got == want and want


SCAN = "project_id string, path string, content_hash string, seen_at timestamp, scan_id long, arrived_at timestamp"
DONE = "project_id string, path string, content_hash string, seen_at timestamp, scan_id long"


def _runs(spark, tmp_path, ledger, commit, times=1, **more):
    for _ in range(times):
        q = turns.process_changes(spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ledger, commit, str(tmp_path / "cp"), **more)
        try:
            q.awaitTermination(120)
        except Exception:
            pass


def test_changes_once_after_a_failure(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("p", "a", "1", t, 1, t), ("p", "b", "2", t, 2, t)], SCAN).coalesce(1).write.parquet(str(tmp_path / "in"))
    done, tries = [], []

    def ledger():
        return spark.createDataFrame(done, DONE)

    def commit(new, number):
        tries.append(number)
        rows = [tuple(r) for r in new.collect()]
        done.extend(rows)
        if len(tries) == 1:
            raise RuntimeError("after the ledger was written")

    _runs(spark, tmp_path, ledger, commit, 2)
    assert sorted(r[:3] for r in done) == [("p", "a", "1"), ("p", "b", "2")] and tries == [0, 0]
    assert changes.unprocessed(spark.read.schema(SCAN).parquet(str(tmp_path / "in")), ledger()).count() == 0


@pytest.mark.parametrize("with_log", [False, True])
def test_older_scan_arrives_late(spark, tmp_path, with_log):
    t = [dt.datetime(2025, 1, d) for d in range(1, 6)]
    batches = [[("p", "a", "new", t[2], 2, t[2])], [("p", "a", "old", t[1], 1, t[3])], [("p", "a", "newest", t[4], 3, t[4]), ("p", "b", "first", t[0], 4, t[4])]]
    for rows in batches:
        spark.createDataFrame(rows, SCAN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = []

    def ledger():
        df = spark.createDataFrame(done, DONE)
        return df.select("project_id", "path", "content_hash") if with_log else df

    def commit(new, number):
        done.extend((*r, None, None)[:5] for r in new.collect())

    if with_log:
        for n, rows in enumerate(batches, 1):
            log = spark.createDataFrame([r for b in batches[:n] for r in b], SCAN)
            commit(changes.unprocessed(log, ledger(), arrived=spark.createDataFrame(rows, SCAN)), n)
    else:
        _runs(spark, tmp_path, ledger, commit)
    assert [r[2] for r in sorted(done, key=lambda r: (r[1], r[2] != "new"))] == ["new", "newest", "first"]


def test_stream_of_changes_needs_times(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("p", "a", "1", t, 1, t)], SCAN).write.parquet(str(tmp_path / "in"))
    done = []
    _runs(spark, tmp_path, lambda: spark.createDataFrame([], "project_id string, path string, content_hash string"), lambda new, n: done.append(n))
    assert not done
