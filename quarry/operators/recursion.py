"""Recursion past an engine's limits on levels and rows.

``WITH RECURSIVE`` runs a round per level and stops at fixed limits (100
levels, a million rows).  Here every round's rows are staged, so lineage stays
short and a lost executor costs one round, and the number of rounds follows
what is asked: path doubling reaches depth d in log2 d rounds, on what contraction
left of many nodes; semi-naive rounds join only the rows that the last one found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import col_ref
from quarry.session import scratch_path

DOUBLED = 1 << 20  # the most nodes that path doubling takes whole, round after round

def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, "recursion", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth): the last ancestor of every node and its distance.

    A node has one row and at most one parent; a null parent or one that is
    no node ends the path there (depth 0: the node is its own root).  A cycle
    fails with a message; a repeated node too.

    While more than DOUBLED nodes have a parent, a round takes out a quarter of
    them: each node has a coin of its hash, those with heads under a parent
    with tails go, and their children go on to that parent.  The rounds'
    sizes fall geometrically, so all of them move a few times the input.  The
    rest is solved by doubling the steps that a row has gone, and then what was
    taken out, last round first, by its parent's answer."""
    rows = _staged(nodes.select(col_ref(node).alias("node"), col_ref(parent).alias("up")), "nodes")
    kind = rows.select(F.coalesce("node", "up")).schema[0].dataType
    known = rows.select(F.col("node").alias("known"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count("node").alias("m"), F.count_distinct("node").alias("d")).first()
    if n["n"] != n["m"] or n["m"] != n["d"]:
        raise ValueError("a node is null or has several rows")
    linked = _staged(rows.join(known, F.col("up") == F.col("known"), "left").select("node", F.col("known").alias("up"), F.lit(1).cast("long").alias("steps")), "linked")
    solved = [linked.where("up IS NULL").select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("steps"))]
    active, taken = linked.where("up IS NOT NULL"), []
    left = active.count()
    while left > DOUBLED:
        heads = lambda c, turn=len(taken): F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 0
        out = active.where(heads("node") & ~heads("up"))
        a, b = active.where(heads("up")).alias("a"), out.alias("b")
        passed = a.join(b, F.col("a.up") == F.col("b.node"), "left").select(
            "a.node", F.coalesce("b.up", "a.up").alias("up"), (F.col("a.steps") + F.coalesce("b.steps", F.lit(0))).alias("steps"))
        active = _staged(active.where(~heads("node") & ~heads("up")).unionAll(passed), "active")
        taken.append(out)
        before, left = left, active.count()
        if left > 0.9 * before:  # parents that are their own: the doubling tells of the cycle
            break
    solved.append(_doubled(active))
    for out in reversed(taken):
        roots = solved[0]
        for more in solved[1:]:
            roots = roots.unionAll(more)
        a, b = out.alias("a"), roots.alias("b")
        solved.append(_staged(a.join(b, F.col("a.up") == F.col("b.node")).select("a.node", "b.at", (F.col("a.steps") + F.col("b.steps")).alias("steps")), "solved"))
    whole = solved[0]
    for more in solved[1:]:
        whole = whole.unionAll(more)
    return whole.select("node", F.col("at").cast(kind).alias("root"), F.col("steps").alias("depth"))


def _doubled(links: DataFrame) -> DataFrame:
    """(node, at, steps) to the roots of (node, up, steps); an ``up`` that is
    no node here is a root.  Each round doubles the steps that a row has gone,
    and rows that reached their root leave."""
    known = links.select(F.col("node").alias("known"))
    linked = links.join(known, F.col("up") == F.col("known"), "left")
    state = _staged(linked.select("node", F.col("up").alias("at"), "steps", F.col("known").isNull().alias("done")), "state")
    most, rounds = max(1, state.count()).bit_length() + 1, 0
    while True:
        going = state.where(~F.col("done"))
        if going.isEmpty():
            return state.select("node", "at", "steps")
        if rounds > most:
            raise ValueError("the parents form a cycle")
        a, b = going.alias("a"), state.alias("b")
        moved = a.join(b, F.col("a.at") == F.col("b.node")).select("a.node", "b.at", (F.col("a.steps") + F.col("b.steps")).alias("steps"), "b.done")
        state, rounds = _staged(state.where("done").unionAll(moved), "state"), rounds + 1


def reachable(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst): all pairs with a path of one edge or more, in log2 of the
    longest shortest path's rounds.  Cycles are fine; null ends are left out.
    The answer itself can be quadratic in the nodes: it is what is asked."""
    one = edges.select(col_ref(src).alias("src"), col_ref(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    every = delta = _staged(one, "pairs")
    while not delta.isEmpty():
        d, e = delta.alias("d"), every.alias("e")
        longer = d.join(e, F.col("d.dst") == F.col("e.src")).select("d.src", "e.dst")
        longer = longer.unionAll(e.join(d, F.col("e.dst") == F.col("d.src")).select("e.src", "d.dst"))
        delta = _staged(longer.distinct().join(every, ["src", "dst"], "left_anti"), "new")
        every = _staged(every.unionAll(delta), "pairs")
    return every


def recurse(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most_rounds: int | None = None) -> DataFrame:
    """``WITH RECURSIVE t AS (base UNION step(t))``: ``step`` gets the rows
    that the last round found and gives the next ones, in base's columns.

    ``distinct`` is UNION (only rows not seen before go on, so cycles end),
    else UNION ALL, which ends when a step gives nothing.  More than
    ``most_rounds`` rounds fail rather than give part of the answer."""
    def fresh(rows: DataFrame, seen: list[DataFrame]) -> DataFrame:
        if not distinct:
            return rows
        rows = rows.distinct()
        for s in seen:
            cond = F.lit(True)
            for c in rows.columns:
                cond = cond & F.col(f"n.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
            rows = rows.alias("n").join(s.alias("s"), cond, "left_anti")
        return rows

    delta = _staged(fresh(base, []), "round")
    found, rounds = [delta], 0
    while True:
        rounds += 1
        delta = _staged(fresh(step(delta).toDF(*base.columns), found), "round")
        if delta.isEmpty():
            out = found[0]
            for more in found[1:]:
                out = out.unionAll(more)
            return out
        if most_rounds is not None and rounds >= most_rounds:
            raise ValueError(f"the recursion goes on after {most_rounds} rounds")
        found.append(delta)
        if len(found) > 16:  # one table again, so that plans stay short
            whole = found[0]
            for more in found[1:]:
                whole = whole.unionAll(more)
            found = [_staged(whole, "rounds")]
