"""What an executed plan did."""

from __future__ import annotations


def _nodes(plan):
    name = plan.getClass().getSimpleName()
    yield plan
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    else:
        kids = plan.children()
        for k in range(kids.size()):
            yield from _nodes(kids.apply(k))


def executed(df) -> list:
    """The rows of ``df``, and the operators (name, output rows) that made them."""
    rows = df.collect()
    found = []
    for p in _nodes(df._jdf.queryExecution().executedPlan()):
        m = p.metrics().get("numOutputRows")
        found.append((p.getClass().getSimpleName(), m.get().value() if m.isDefined() else 0))
    return [rows, found]
