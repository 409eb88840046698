"""What workers remember between operators does not lie beside the memory of a fit."""

from claimloom.llm import common


def test_a_fit_starts_without_what_the_worker_remembers(spark):
    def run(batches):
        for _ in batches:
            common.kept_by_worker(("words", 1), lambda: {"a": 1})
            before = common._KEPT[0]
            # the child is a copy of the worker: it sees what lies beside it
            yield {"before": [before is not None], "inside": [common.apart(lambda: common._KEPT[0] is not None)], "after": [common._KEPT[0] is not None]}

    row = common.arrow_map(spark.range(1).coalesce(1), run, "before boolean, inside boolean, after boolean").first()
    assert (row.before, row.inside, row.after) == (True, False, False)
    # the next operator makes its own again
    again = common.arrow_map(spark.range(1).coalesce(1), lambda bs: ({"n": [len(common.kept_by_worker(("words", 1), lambda: {"a": 1}))]} for _ in bs), "n int").first()
    assert again.n == 1
