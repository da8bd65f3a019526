"""The question path moves the texts of hits only."""

from fundlens.plans import text_queries


def test_only_hit_rows_are_kept(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, "e")], "id long, text string")
    hits = spark.createDataFrame([("q", 2), ("r", 2), ("q", 3), ("q", None)], "query_id string, id long")
    assert sorted(r.text for r in text_queries._hit(rows, hits).collect()) == ["b", "c", "e"]
    monkeypatch.setattr(text_queries, "BROADCAST_ROWS", 1)
    joined = hits.join(text_queries._hit(rows, hits), "id")
    assert sorted((r.query_id, r.text) for r in joined.collect()) == [("q", "b"), ("q", "c"), ("q", "e"), ("r", "b"), ("r", "c")]
