"""A null scope is a scope of its own, as in the SQL."""

from lexforge.operators import dedup


def test_near_copies_of_null_scope(spark):
    text = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, text, None), (2, text, None), (3, text, "a"), (4, text, "a"), (5, text, "b")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.source, r.is_rejected) for r in dedup.near_copies(d, ["source"]).collect()} == {1: (None, False), 2: (None, True), 3: ("a", False), 4: ("a", True), 5: ("b", False)}
