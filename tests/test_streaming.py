import datetime as dt
import json

from graphloom.streaming import ledger

AT = dt.datetime(2024, 1, 1)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"ts": (AT + dt.timedelta(hours=h)).isoformat(), "tool": t, "outcome": o, "tokens": 1, "client": "c", "model": "m"}) for h, t, o in rows]
    (folder / name).write_text("\n".join([*lines, "{broken"]) + "\n")


def test_running_and_kept(spark, tmp_path):
    put(tmp_path / "in", "1.json", [(0, "a", "miss"), (1, "a", "miss"), (26, "a", "miss")])
    put(tmp_path / "in", "2.json", [(30, "a", "complete"), (31, "b", "miss")])
    e = ledger.tail(spark, str(tmp_path / "in"), files_per_batch=1).where("tool is not null")
    ledger.run_to_table(ledger.running_stats(e), str(tmp_path / "stats"), str(tmp_path / "cp"))
    got = {r["tool"]: (r["calls"], r["complete"], r["miss"]) for r in spark.read.parquet(str(tmp_path / "stats")).collect()}
    assert got == {"a": (4, 1, 3), "b": (1, 0, 1)}
    q = ledger.kept(e, "tool", "outcome", 86400).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start(str(tmp_path / "kept"))
    q.awaitTermination()
    kept = sorted((r["tool"], (r["ts"] - AT).total_seconds() / 3600, r["outcome"]) for r in spark.read.parquet(str(tmp_path / "kept")).collect())
    assert kept == [("a", 0, "miss"), ("a", 26, "miss"), ("a", 30, "complete"), ("b", 31, "miss")]


def test_batches_and_merge(spark, tmp_path):
    put(tmp_path / "in", "1.json", [(0, "a", "miss"), (1, "a", "miss")])
    e = ledger.tail(spark, str(tmp_path / "in")).where("tool is not null")
    ledger.upload_batches(e, str(tmp_path / "up"), str(tmp_path / "cp")).awaitTermination()
    put(tmp_path / "in", "2.json", [(2, "a", "miss")])
    ledger.upload_batches(e, str(tmp_path / "up"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["batch"], r["calls"]) for r in spark.read.parquet(str(tmp_path / "up")).collect()) == [(0, 2), (1, 1)]
    for _ in range(2):
        ledger.merge_new(e, str(tmp_path / "table"), str(tmp_path / "cp3"), ["tool", "outcome"], spark).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
