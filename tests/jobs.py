"""What a piece of code makes Spark do."""

from __future__ import annotations

from contextlib import contextmanager


@contextmanager
def actions(spark):
    """Number of actions (SQL executions) begun inside, in the list that is yielded."""
    store = spark._jsparkSession.sharedState().statusStore()

    def begun() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return store.executionsCount()

    counted, before = [], begun()
    yield counted
    counted.append(begun() - before)


def _nodes(plan):
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        children = plan.children()
        below = [children.apply(i) for i in range(children.size())]
    for node in below:
        yield from _nodes(node)


def scanned(df) -> list[dict[str, int]]:
    """Run ``df``; files, folders and rows that each of its scans read."""
    df.collect()
    out = []
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            metrics = node.metrics()
            row = {"columns": node.schema().fieldNames()}
            for name in ("numFiles", "numPartitions", "numOutputRows"):
                row[name] = metrics.apply(name).value() if metrics.contains(name) else None
            out.append(row)
    return out
