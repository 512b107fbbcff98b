"""Which columns of a DataFrame look ahead: its analysed plan is walked, and what reads rows behind the current one is followed through to the columns that use it.

A window expression looks ahead if it is a lead, or if its frame ends behind the current row, unless its partitions are of one moment each. A column that is computed from it, grouped by it,
filtered or joined on it looks ahead too; a column beside it doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Columns that name a moment: within a partition by one of them all rows are of one time.
MOMENT = ("market_date", "observed_at")


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _children(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _number(x) -> float | None:
    """The value of a frame's bound or a lead's offset, where it is a constant."""
    special = {"CurrentRow$": 0.0, "UnboundedFollowing$": float("inf"), "UnboundedPreceding$": float("-inf")}
    if _name(x) in special:
        return special[_name(x)]
    try:
        return float(str(x.eval(None))) if x.foldable() else None
    except ValueError:  # an interval: which way it goes isn't looked at
        return None


def _ahead(expression) -> bool:
    """Whether a window expression reads rows of later moments than the current one."""
    function, spec = expression.windowFunction(), expression.windowSpec()
    if any(_name(p) == "AttributeReference" and p.name() in MOMENT for p in _children(spec.partitionSpec())):
        return False
    kind = _name(function)
    if kind in ("Lead", "Lag"):
        offset = _number(function.inputOffset() if kind == "Lag" else function.offset())
        return offset is None or (offset > 0 if kind == "Lead" else offset < 0)
    if kind in ("PercentRank", "CumeDist", "NTile"):
        return True  # of the whole partition
    frame = spec.frameSpecification()
    upper = _number(frame.upper()) if _name(frame) == "SpecifiedWindowFrame" else None
    return upper is None or upper > 0


def _taints(expression, ahead: dict[int, bool]) -> bool:
    """Whether an expression uses a window that looks ahead, in itself or by a column that does."""
    if _name(expression) == "WindowExpression" and _ahead(expression):
        return True
    if _name(expression) == "AttributeReference":
        return ahead.get(expression.exprId().id(), False)
    if _name(expression) in ("ScalarSubquery", "ListQuery", "Exists") and any(_walk(expression.plan(), {}).values()):
        return True
    return any(_taints(c, ahead) for c in _children(expression.children()))


def _walk(plan, ahead: dict[int, bool]) -> dict[int, bool]:
    """By id of each column of the plan, whether it looks ahead; ahead: of columns known so far."""
    known = dict(ahead)
    for child in _children(plan.children()):
        known |= _walk(child, ahead)
    kind = _name(plan)
    out = _children(plan.output())
    if kind in ("Project", "Aggregate", "Window"):
        makers = {"Project": "projectList", "Aggregate": "aggregateExpressions", "Window": "windowExpressions"}[kind]
        for e in _children(getattr(plan, makers)()):
            known[e.toAttribute().exprId().id()] = _taints(e, known)
        if kind == "Aggregate" and any(_taints(g, known) for g in _children(plan.groupingExpressions())):
            known |= {a.exprId().id(): True for a in out}
    elif kind == "Union":
        parts = [_children(c.output()) for c in _children(plan.children())]
        for i, a in enumerate(out):
            known[a.exprId().id()] = any(known.get(p[i].exprId().id(), False) for p in parts)
    elif kind in ("Filter", "Join"):
        condition = plan.condition() if kind == "Filter" else (plan.condition().get() if plan.condition().isDefined() else None)
        if condition is not None and _taints(condition, known):
            known |= {a.exprId().id(): True for a in out}  # which rows there are depends on later ones
    elif kind not in ("SubqueryAlias", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Repartition", "RepartitionByExpression", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "ResolvedHint", "View", "OneRowRelation"):
        # Generate, Expand, Python functions and the like: what they make depends on what they read.
        from_below = any(known.get(a.exprId().id(), False) for c in _children(plan.children()) for a in _children(c.output()))
        for a in out:
            known.setdefault(a.exprId().id(), from_below)
    return {a.exprId().id(): known.get(a.exprId().id(), False) for a in out}


def looks_ahead(df: DataFrame) -> list[str]:
    """The columns of df whose values, or whose rows, depend on rows behind their own: features must have none. Written tables have no lineage; check plans."""
    plan = df._jdf.queryExecution().analyzed()
    found = _walk(plan, {})
    return [a.name() for a in _children(plan.output()) if found[a.exprId().id()]]
