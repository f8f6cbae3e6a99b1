"""Join helpers: join-kind mapping, duplicate column naming, all-pairs guard."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Accepted join kinds (user word -> Spark join type).  ``asof`` is handled by
# quarry.operators.asof; ``cross`` is refused (a join needs a condition).
JOIN_KINDS = {
    "inner": "inner",
    "left": "left",
    "right": "right",
    "outer": "full",
    "full": "full",
    "full_outer": "full",
    "semi": "left_semi",
    "left_semi": "left_semi",
    "anti": "left_anti",
    "left_anti": "left_anti",
}


def spark_join_type(how: str) -> str:
    h = (how or "left").strip().lower().replace(" ", "_")
    if h in JOIN_KINDS:
        return JOIN_KINDS[h]
    raise ValueError(f"Unsupported join kind: {how!r}")


def unique_names(names: list[str]) -> list[str]:
    """``id, x, id, x`` -> ``id, x, id_1, x_1`` (next free suffix per name)."""
    used: set[str] = set()
    out = []
    for n in names:
        cand, i = n, 0
        while cand in used:
            i += 1
            cand = f"{n}_{i}"
        used.add(cand)
        out.append(cand)
    return out


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Rename duplicate column names positionally (Spark refuses them on write)."""
    names = unique_names(df.columns)
    return df if names == df.columns else df.toDF(*names)


# Joins Spark runs by comparing every pair of rows of its two sides.
ALL_PAIRS_OPS = ("CartesianProduct", "BroadcastNestedLoopJoin")
# A side with at most this many rows, proven by the plan itself (Catalyst's
# ``maxRows``: a global aggregate, a LIMIT, a literal table), is harmless.
BOUNDED_SIDE_ROWS = 10_000


def _max_rows(node) -> int | None:
    link = node.logicalLink()
    if not link.isDefined():
        return None
    m = link.get().maxRows()
    return int(m.get()) if m.isDefined() else None


def unbounded_all_pairs(df: DataFrame, bound: int = BOUNDED_SIDE_ROWS) -> list[str]:
    """Nested-loop / Cartesian joins in ``df``'s physical plan where neither
    side has a proven row bound ≤ ``bound``: each would compare all pairs of
    two inputs that grow with the data.  Planning only; nothing runs."""
    found, stack = [], [df._jdf.queryExecution().sparkPlan()]
    while stack:
        node = stack.pop()
        kids = [node.children().apply(i) for i in range(node.children().size())]
        subs = node.subqueries()  # scalar and EXISTS subqueries sit in expressions
        if node.nodeName() in ALL_PAIRS_OPS:
            sizes = [_max_rows(k) for k in kids]
            if not any(s is not None and s <= bound for s in sizes):
                found.append(node.simpleString(8))
        stack.extend(kids)
        stack.extend(subs.apply(i) for i in range(subs.size()))
    return found
