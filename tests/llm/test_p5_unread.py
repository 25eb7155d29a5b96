import datetime

from graphloom.llm.p5_handmade import p5_found

AT = datetime.datetime(2024, 1, 1)


def test_unread_files_are_judged_by_path(spark, tmp_path):
    paths = ["node_modules/a/x.js", "src/generated/b.ts", "src/c.ts", "lib/d.min.js"]
    tasks = [(n, "r1", f"/srv/checkouts/r1/{p}") for n, p in enumerate(paths)]
    reads = [(tasks[0][2], None, AT), (tasks[2][2], None, AT)]
    spark.createDataFrame(tasks, "task_id bigint, repository_id string, abs string").write.parquet(f"{tmp_path}/parse_tasks.parquet")
    spark.createDataFrame(reads, "abs string, content string, read_at timestamp").write.parquet(f"{tmp_path}/source_files.parquet")
    assert sorted(r["task_id"] for r in p5_found(spark, str(tmp_path)).collect()) == [0, 1, 3]
