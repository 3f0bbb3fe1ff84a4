"""The nearest-vector search over all vectors, whatever their label."""

from __future__ import annotations

from marketweave.operators import text


def test_nearer_vector_of_another_label_is_found(spark, monkeypatch):
    monkeypatch.setattr(text, "QUERY_BLOCK", 1)
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 2), (3, [0.1, 1.0], 2), (4, [1.0, 0.1], 1), (5, [0.5, 0.5], None)]
    v = spark.createDataFrame(rows, "id long, e array<float>, label int")
    q = v.where("id < 2")
    found = text.cosine_topk(q, v, "id", "e", None, 2).collect()
    assert {(r.query, r.place, r.id) for r in found} == {(0, 1, 2), (0, 2, 4), (1, 1, 3), (1, 2, 5)}
    same = text.cosine_topk(q, v, "id", "e", "label", 1).collect()
    assert {(r.query, r.id) for r in same} == {(0, 4), (1, 4)}
    assert text.cosine_topk(q.limit(0), v, "id", "e", None, 2).count() == 0


def test_blocks_meet_without_a_row_a_pair(spark, monkeypatch):
    """Ties across chunks and blocks go by key, gaps and other lengths score 0, and no pair of vectors is a row of a join."""
    monkeypatch.setattr(text, "CHUNK", 3, raising=False)
    monkeypatch.setattr(text, "VECTOR_BLOCK", 7, raising=False)
    rows = [(i, [1.0, float(i % 3)]) for i in range(40)] + [(50, None), (51, [1.0]), (52, [1.0, None]), (53, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, e array<float>")
    found = text.cosine_topk(v.where("id in (0, 1, 51)"), v, "id", "e", None, 42)
    got = {}
    for r in found.orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.id)
    near = lambda a: [i for m in a for i in range(40) if i % 3 == m]
    assert got[0] == [i for i in near((0, 1, 2)) if i] + [50, 51, 52]
    assert got[1] == [i for i in near((1, 2, 0)) if i != 1] + [50, 51, 52]
    assert got[51] == [*range(40), 50, 52]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
