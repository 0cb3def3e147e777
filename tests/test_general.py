import datetime as dt

from pyspark.sql import functions as F

from tesselite.functions.keys import path_key, project_key
from tesselite.operators import changes
from tesselite.operators.ordering import range_ranked
from tesselite.operators.references import Reference, looked_up, orphan_report, orphans


def test_keys(spark):
    df = spark.createDataFrame([(" GIT:a/B.git ", ".\\src//x.py"), (None, None), ("git:a/b", "././src/x.py"), ("", "")], "p string, f string")
    got = [tuple(r) for r in df.select(project_key("p"), path_key("f")).collect()]
    assert got == [("git:a/b", "src/x.py"), (None, None), ("git:a/b", "src/x.py"), ("", "")]


def _reference(child, parent, **extra):
    return Reference("t.k", child, [F.col("k")], [parent], F.col("id"), F.col("period"))


def test_orphans_against_brute_force(spark, rows):
    data = [(i, None if i % 11 == 0 else f"k{i % 7}", None if i % 5 == 0 else f"2025-0{i % 3 + 1}") for i in range(200)]
    data += data[:20] + [(1000 + i, "hot", "2025-01") for i in range(100)]  # repeated rows, and a key that holds a third
    child = spark.createDataFrame([(*r, "clash") for r in data], "id long, k string, period string, ref_field string")
    parent = spark.createDataFrame([("k1",), ("k1",), ("k3",), (None,)], "k string")
    want = {("t.k", str(i), p or "none") for i, k, p in data if k and k not in ("k1", "k3")}
    for salts in (1, 8):
        got = orphans([_reference(child, parent)], salts)
        assert got.count() == len(want) and rows(got) == want
    report = {(r.period): (r.n_keys, r.n_records) for r in orphan_report([_reference(child, parent)]).collect()}
    for period in {p for _, _, p in want}:
        own = {(i, k) for i, k, p in data if k and k not in ("k1", "k3") and (p or "none") == period}
        assert report[period] == (len({k for _, k in own}), len(own))


def test_orphans_empty_tables(spark, rows):
    none = spark.createDataFrame([], "id long, k string, period string")
    some = spark.createDataFrame([(1, "a", None)], "id long, k string, period string")
    keys = none.select("k")
    assert rows(orphans([_reference(none, keys)])) == set()
    assert rows(orphans([_reference(some, keys)])) == {("t.k", "1", "none")}


T0 = dt.datetime(2025, 1, 1)


def _scan(rows):
    return [(p, f, h, T0 + dt.timedelta(hours=s), i, T0 + dt.timedelta(hours=a)) for i, (p, f, h, s, a) in enumerate(rows)]


SCAN = "project_id string, path string, content_hash string, seen_at timestamp, scan_id long, arrived_at timestamp"
LEDGER = "project_id string, path string, content_hash string"


def test_unprocessed(spark, rows):
    scans = spark.createDataFrame(
        _scan([("p", "a", "H1", 1, 1), ("p", "a", "h2", 2, 2), ("p", "./b", "AA", 1, 1), ("P.git", "c", None, 3, 3), ("p", "c", "x", 1, 1), ("q", "d", "d1", 1, 1), ("p", "e", "e1", 1, 1), ("p", "e", "e1", 1, 1), (None, "f", "g", 1, 1), ("p", "t", "t1", 5, 5), ("p", "t", "t2", 5, 5)]),
        SCAN,
    )
    ledger = spark.createDataFrame([("p", "a", "h1"), ("p", "b", "aa"), ("p", "b", "aa"), ("q", "d", "d1")], LEDGER)
    projects = spark.createDataFrame([("p", None), ("P", T0), ("q", None)], "project_id string, indexed_at timestamp")
    got = changes.unprocessed(scans, ledger, projects)
    # a changed, e and t new (t by the greater scan id), d's project was never indexed, c is unreadable now
    assert rows(got) == {("p", "a", "h2"), ("q", "d", "d1"), ("p", "e", "e1"), ("p", "t", "t2")}
    assert got.count() == 4
    after = changes.committed(ledger, got)
    assert rows(changes.unprocessed(scans, after)) == set()
    assert changes.unprocessed(scans.limit(0), ledger).count() == 0
    assert changes.unprocessed(scans, ledger.limit(0)).count() == 5


def test_reread_covers_open_transactions(spark, rows):
    log = spark.createDataFrame([(T0, T0 + dt.timedelta(hours=1)), (T0 + dt.timedelta(hours=2), None), (T0 + dt.timedelta(hours=3), T0 + dt.timedelta(hours=9))], "began_at timestamp, ended_at timestamp")
    assert changes.oldest_open(log, None) is None
    assert changes.oldest_open(log, T0 + dt.timedelta(hours=5)) == T0 + dt.timedelta(hours=2)
    assert changes.oldest_open(log.limit(1), T0 + dt.timedelta(hours=5)) == T0 + dt.timedelta(hours=5)
    scans = spark.createDataFrame(_scan([("p", "old", "1", 0, 0), ("p", "late", "2", 0, 3), ("p", "new", "3", 6, 6)]), SCAN)
    ledger = spark.createDataFrame([("p", "old", "1")], LEDGER)
    got = changes.unprocessed(scans, ledger, reread_from=T0 + dt.timedelta(hours=2))
    assert {r[1] for r in rows(got)} == {"late", "new"}


def test_reread_finds_the_newest_of_all_scans(spark, rows):
    # a newer version was processed before the cut, an older one arrives after it
    scans = spark.createDataFrame(_scan([("p", "a", "new", 3, 3), ("p", "a", "old", 1, 9), ("p", "b", "b2", 4, 4), ("p", "b", "b1", 2, 9)]), SCAN)
    ledger = spark.createDataFrame([("p", "a", "new")], LEDGER)
    cut = T0 + dt.timedelta(hours=5)
    assert rows(changes.unprocessed(scans, ledger, reread_from=cut)) == {("p", "b", "b2")}
    dated = spark.createDataFrame([("p", "a", "new", T0 + dt.timedelta(hours=3), 0)], LEDGER + ", seen_at timestamp, scan_id long")
    got = changes.unprocessed(scans, dated, reread_from=cut)
    assert {r[:3] for r in rows(got)} == {("p", "b", "b1")}  # b2's own run broke off, and such a ledger is read with the arrivals only
    assert "seen_at" in changes.committed(dated, got).columns


def test_reread_points(spark, rows):
    log = spark.createDataFrame([("P.git", T0, T0 + dt.timedelta(hours=9)), ("p", T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2)), ("q", T0, None), ("r", T0, T0)], "project_id string, began_at timestamp, ended_at timestamp")
    runs = spark.createDataFrame([("p", T0 + dt.timedelta(hours=5)), ("q", None), ("r", T0 + dt.timedelta(hours=5)), ("s", T0)], "project_key string, last_success timestamp")
    points = changes.reread_points(log, runs)
    assert rows(points) == {("p", T0), ("r", T0 + dt.timedelta(hours=5)), ("s", T0)}
    scans = spark.createDataFrame(_scan([("p", "a", "1", 0, 6), ("r", "b", "1", 0, 1), ("r", "c", "1", 6, 6), ("q", "d", "1", 0, 0)]), SCAN)
    assert {r[1] for r in rows(changes.unprocessed(scans, spark.createDataFrame([], LEDGER), reread_from=points))} == {"a", "c", "d"}


def test_looked_up(spark, rows):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(30)] + [(99, "none")], "id long, k string")
    got = looked_up(left, spark.createDataFrame([("hot", 7), (None, 8)], "k string, v int"), "k")
    assert {(r.id, r.v) for r in got.collect()} == {(i, 7 if i % 3 else None) for i in range(30)} | {(99, None)} and got.count() == 31


def test_range_ranked(spark):
    data = [(i % 3 if i % 7 else None, (i * 37) % 50, i) for i in range(200)]
    df = spark.createDataFrame(data, "g int, v int, id long")
    order = [F.desc("v"), F.col("id")]
    whole = [r.id for r in range_ranked(df, order).orderBy("rank").collect()]
    assert whole == [r[2] for r in sorted(data, key=lambda r: (-r[1], r[2]))]
    got = {}
    for r in range_ranked(df, order, ["g"]).orderBy("rank").collect():
        got.setdefault(r.g, []).append((r["rank"], r.id))
    for g in (None, 0, 1, 2):
        want = [r[2] for r in sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))]
        assert got[g] == list(enumerate(want, 1))
    assert range_ranked(df.limit(0), order).count() == 0
