"""The keyed table and the streams on it: merges, compaction, restarts, keyed state."""

import pytest
from pyspark.sql import functions as F

from emberfield.sources.keyed import KeyedTable
from emberfield.streaming import ingest

SCHEMA = "id string, latitude double, brightness double, detected_at long"


def table_at(spark, folder, **how):
    schema = spark.createDataFrame([], SCHEMA).schema
    return KeyedTable(spark, str(folder), schema, ["id"], ("brightness", "detected_at"), "detected_at", buckets=4, **how)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(table):
    return sorted((r["id"], r["latitude"], r["brightness"]) for r in table.read().collect())


def files_of(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_rows_merge_and_reads_stay_small(spark, tmp_path):
    table = table_at(spark, tmp_path, every=3)
    want = {}
    for n in range(10):
        batch = [(f"k{i}", float(n), float(100 * n + i), n) for i in range(n % 4 + 2)]
        table.append(rows(spark, *batch, ("k0", -1.0, -1.0, -5)), n)  # an older row of the same batch
        for key, lat, brightness, _ in batch:
            first = want[key][0] if key in want else (-1.0 if key == "k0" else lat)
            want[key] = (first, brightness)
        assert held(table) == sorted((k, *v) for k, v in want.items())
        # What a read opens does not grow with the batches there were.
        assert len(table._waiting(table.manifest())) < 3 and len(table._names("manifest")) <= 2 and len(table._names("snapshot")) <= 8
    assert table.manifest()["version"] == 3 and len(table._names("delta")) <= 5
    again = table_at(spark, tmp_path, every=3)
    assert held(again) == held(table)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    table = table_at(spark, tmp_path, every=2)
    table.append(rows(spark, ("a", 1.0, 5.0, 0)), 0)
    table.append(rows(spark, ("a", 2.0, 6.0, 1)), 0)  # started again, with other content
    assert held(table) == [("a", 2.0, 6.0)]
    table.append(rows(spark, ("b", 1.0, 7.0, 2)), 1)
    table.append(rows(spark, ("a", 9.0, 9.0, 9)), 0)  # is in a snapshot by now
    assert held(table) == [("a", 2.0, 6.0), ("b", 1.0, 7.0)]


def test_compaction_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    table = table_at(spark, tmp_path, every=100)
    for n in range(4):
        table.append(rows(spark, ("a", float(n), float(n), n), (f"b{n}", 0.0, 0.0, n)), n)
    before = held(table)

    def lost(manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lost)
        with pytest.raises(OSError, match="lost"):
            table.compact()
    left = set(table._names("snapshot"))
    assert left and held(table) == before
    again = table_at(spark, tmp_path)
    assert held(again) == before
    again.compact()
    assert held(again) == before and not left & set(again._names("snapshot"))  # the left-over is cleared
    assert again._waiting(again.manifest()) == []


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    table = table_at(spark, tmp_path)
    table.upsert(rows(spark, *((f"k{i}", 0.0, float(i), i) for i in range(40))))
    first = table.manifest()["snapshots"]
    before = {b: files_of(tmp_path / "snapshot" / n / f"bucket={b}") for b, n in first.items()}
    touched = str(rows(spark, ("k3", 1.0, -3.0, 99)).select(table.bucket()).first()[0])
    table.upsert(rows(spark, ("k3", 1.0, -3.0, 99)))
    second = table.manifest()["snapshots"]
    assert len(first) == 4 and {b for b in first if first[b] != second[b]} == {touched}
    assert all(files_of(tmp_path / "snapshot" / n / f"bucket={b}") == before[b] for b, n in second.items() if b != touched)
    assert ("k3", 0.0, -3.0) in held(table) and len(held(table)) == 40


def test_empty_tables_and_writers_at_once(spark, tmp_path):
    table = table_at(spark, tmp_path)
    assert held(table) == []
    table.append(rows(spark), 0)
    table.compact()
    assert held(table) == []
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(table.manifest())


def test_a_stream_restarts_between_compactions(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda: sorted(map(tuple, ingest.stream_upsert(
        spark, str(tmp_path / "in"), schema, lambda df: df, "id", ("brightness",), files=1, folder=str(tmp_path / "state"), every=2).collect()))
    rows(spark, ("a", 1.0, 1.0, 1), ("b", 1.0, 1.0, 1)).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run() == [("a", 1.0, 1.0, 1), ("b", 1.0, 1.0, 1)]
    for n in range(2, 6):
        rows(spark, ("a", float(n), float(n), n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert run() == [("a", 1.0, float(n), 1), ("b", 1.0, 1.0, 1)]


def test_keyed_state_emits_changes_and_ignores_late_rows(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        out = ingest.stream_latest(spark, str(tmp_path / "in"), schema, "id", ("brightness",), "detected_at", files=1, folder=str(tmp_path / "state"))
        return sorted((r["id"], r["batch"], r["latitude"], r["brightness"], r["detected_at"]) for r in out.collect())

    rows(spark, ("a", 1.0, 5.0, 50), ("a", 2.0, 4.0, 40), ("b", 1.0, 1.0, 10)).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run() == [("a", 0, 2.0, 5.0, 50), ("b", 0, 1.0, 1.0, 10)]
    # A late row, a repeated one, and an update: only the update is emitted.
    rows(spark, ("a", 9.0, 3.0, 30), ("a", 2.0, 5.0, 50), ("b", 7.0, 2.0, 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [("a", 0, 2.0, 5.0, 50), ("b", 0, 1.0, 1.0, 10), ("b", 1, 1.0, 2.0, 20)]
    # Nulls: a row without a time is earlier than any other.
    rows(spark, ("b", 1.0, None, None), ("c", 1.0, None, None)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows(spark, ("c", 1.0, None, 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [r for r in run() if r[0] == "c"][-1][2:] == (1.0, None, 1)


def test_state_expires_by_event_time(spark, tmp_path):
    kind = "id string, brightness double, seen timestamp"
    schema = spark.createDataFrame([], kind).schema
    add = lambda *r: spark.createDataFrame(list(r), "id string, brightness double, s long").withColumn("seen", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # noqa: E731, E501

    def run():
        out = ingest.stream_latest(
            spark, str(tmp_path / "in"), schema, "id", ("brightness",), "seen", files=1, keep_ms=60_000, delay="10 seconds", folder=str(tmp_path / "state")
        )
        return sorted((r["id"], r["batch"], r["brightness"]) for r in out.collect())

    add(("a", 5.0, 1000), ("b", 1.0, 1000))
    run()
    add(("a", 6.0, 1050))
    run()
    add(("c", 1.0, 1100))  # the watermark passes b's end, not that of a
    run()
    # Rows with the values that were kept: nothing changes for a, and b is new again.
    add(("a", 6.0, 1095), ("b", 1.0, 1095))
    got = run()
    assert [r[0] for r in got if r[1] == got[-1][1] or r[0] == "b"].count("b") == 2
