"""Queries without SQL run on all documents."""

from folioguard.operators import edits
from folioguard.plans import fixtures as fx
from folioguard.plans import registry

SF = "/root/testdata/sf0.001"


def test_corrected_slots_keeps_every_document(spark):
    got = [r["id"] for r in registry.queries()["corrected_slots"](spark, SF).collect()]
    assert sorted(got) == sorted(r["id"] for r in fx.folder_documents(spark, SF).collect())


def test_review_clicks_reach_all_documents(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(edits, "review_clicks", lambda clicks: clicks.selectExpr("doc_id", "seq", "array(string(seq)) AS selected"))
    fx.table(spark, SF, "events").write.parquet(f"{tmp_path}/events.parquet")
    fx.table(spark, SF, "documents").selectExpr("doc_id * 7 AS doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    clicked = {r["doc_id"] for r in registry.queries()["review_clicks"](spark, str(tmp_path)).where("seq >= 0").select("doc_id").collect()}
    assert max(clicked) > 1000
