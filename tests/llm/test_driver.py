"""What the driver holds: the size of a plan, and rows that come to it."""

from __future__ import annotations

import numpy as np

from logfold.llm import mixing, quality, simhash


def test_no_plan_of_a_mixture_holds_all_its_steps(spark, monkeypatch):
    exchanges, write = [], mixing.written
    count = lambda df: exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
    monkeypatch.setattr(mixing, "written", lambda df: (count(df), write(df))[1])
    docs = spark.createDataFrame([(i, f"s{i % 3}", " ".join(f"w{i}_{j}" for j in range(1 + i % 7))) for i in range(60)], "doc_id long, source string, text string")
    mixed = mixing.mixture(docs, block=4, shard_slots=8)
    count(mixed)
    assert exchanges[-1] <= 4 and max(exchanges) <= 16  # 27 in the last one, were it all one plan
    assert {r.doc_id for r in mixed.collect()} <= set(range(60)) and mixed.count() > 0


def test_rows_for_the_driver_come_in_columns(spark, monkeypatch):
    rows = [(i, f"s{i % 2}", " ".join(f"w{(i * j) % 11}" for j in range(9)) + "!" * (i % 2 * 5)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")

    def refused(self):
        raise AssertionError("rows one by one")

    monkeypatch.setattr(type(docs), "toPandas", refused)
    model = quality.train(docs, labels)
    x = np.array([quality.statistics(t.encode()) for _, _, t in rows])
    assert (model.predict(x)[1::2] > model.predict(x)[::2].max()).all()
    common, counts = simhash._shingle_order(docs.selectExpr("doc_id AS node", "text", "md5(text) AS h"), 80, 5)
    sets = [set(simhash._shingle_set(t, 5).tolist()) for _, _, t in rows]
    assert dict(zip(common.tolist(), counts.tolist(), strict=True)) == {s: n for s in set().union(*sets) if (n := sum(s in x for x in sets)) > 1}
    nothing = simhash._shingle_order(docs.limit(0).selectExpr("doc_id AS node", "text", "md5(text) AS h"), 0, 5)
    assert [(a.dtype, len(a)) for a in nothing] == [(np.dtype("uint64"), 0), (np.dtype("int64"), 0)]
