from graphloom.api import CodeMap

SF = "/root/testdata/sf0.001"


def test_map(spark, tmp_path):
    m = CodeMap(spark, SF)
    hub = spark.read.parquet(f"{SF}/hub_summaries.parquet").first()["node_id"].strip().lower()
    direct = {r["src"] for r in m.edges.where(f"dst = '{hub}' and kind in ('call', 'import', 'extends', 'implements', 'references')").collect()}
    assert {r["node"] for r in m.impact_of(hub).where("depth = 1").collect()} == direct - {hub}
    assert m.node(hub).count() == 1 and m.summary().count() == 1
    assert m.ask("the token budget").count() > 0 and m.ask("the of").count() == 0
    some = next(iter(direct))
    assert m.path_length(some, hub).first()["hops"] == 1
    assert m.tree(some, 1).where("depth = 0").count() == 1
    assert m.search_text("token").count() >= 0 and m.callers(hub).count() >= 0 and m.callees(some).count() >= 1 and m.tests_for(hub).count() >= 0
    m.save(str(tmp_path / "map"))
    assert CodeMap.load(spark, str(tmp_path / "map"), SF).edges.count() == m.edges.count()
