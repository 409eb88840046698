"""Of the similarity join only the filter of fixed size goes through the driver."""

import re

from claimloom.llm import graph, jaccard_join


def test_only_the_filter_is_broadcast(spark, monkeypatch):
    plans = []

    def noted(df, kept=graph.durable):
        stored = kept(df)
        # as it was carried out
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return stored

    monkeypatch.setattr(graph, "durable", noted)
    monkeypatch.setattr(jaccard_join, "durable", noted)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[::-1]), "a b", "a b", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = jaccard_join.link(docs, block_docs=2)
    assert {r.doc_id: r.component_id for r in out.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}
    plans.append(out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    sent = [p for plan in plans for p in re.findall(r"BroadcastExchange.*", plan)]
    assert len(plans) > 8 and len(sent) <= 1
