"""Declarative transformation: sources, one join, one group-by.

Config (same keys as the service's request)::

    {"sources": [{"alias": "c", "type": "parquet", "path": ...}, ...],
     "join": {"left": "c", "right": "o", "on": "c.k = o.k", "how": "left"},
     "aggregate": {"group_by": ["c.seg"], "metrics": {"n": "count(*)"}}}

The config becomes a DataFrame plan directly: ``F.expr`` for the join
condition, group keys and metrics, no SQL text is assembled.  Catalyst then
pushes filters and prunes columns into the scans (the reference loaded
every source whole first).  ``how`` may be inner, left (default), right,
outer/full, semi, anti or asof; anything else is refused.  An empty
``group_by`` is a global aggregate.  Duplicate output names get ``_1``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.asof import asof_join
from quarry.operators.joins import dedupe_columns, spark_join_type, unbounded_all_pairs
from quarry.operators.ranges import dyadic_overlap_join, dyadic_range_join

_CMP = re.compile(r"^\s*([\w.`]+)\s*(=|>=|<=|>|<)\s*([\w.`]+)\s*$")
_RANGE_CMP = re.compile(r"^\s*([\w.`]+)\s*(>=|>|<=|<)\s*([\w.`]+)\s*$")
_FLIP = {">=": "<=", ">": "<", "<=": ">=", "<": ">"}


def _strip_alias(ref: str, alias: str) -> str | None:
    ref = ref.replace("`", "")
    if ref.startswith(alias + "."):
        return ref[len(alias) + 1:]
    return None


def _asof_terms(on: str, left: str, right: str):
    """Split ``l.k = r.k AND l.t >= r.t`` into key pairs and (left time,
    comparison, right time)."""
    keys, time = [], None
    for term in re.split(r"\s+AND\s+", on.strip(), flags=re.I):
        m = _CMP.match(term)
        if not m:
            raise ValueError(f"as-of condition term not understood: {term!r}")
        a, op, b = m.groups()
        la, rb = _strip_alias(a, left), _strip_alias(b, right)
        if la is None or rb is None:  # written right-hand side first
            la, rb = _strip_alias(b, left), _strip_alias(a, right)
            op = _FLIP.get(op, op)
            if la is None or rb is None:
                raise ValueError(f"as-of term must compare {left}.x with {right}.y: {term!r}")
        if op == "=":
            keys.append((la, rb))
        elif time is None:
            time = (la, op, rb)
        else:
            raise ValueError(f"as-of needs exactly one '{left}.t >= {right}.t' term")
    if time is None:
        raise ValueError("as-of join needs a time term: >=, >, <= or <")
    return keys, time


def _resolve(ref: str, left: str, right: str):
    for alias in (left, right):
        col = _strip_alias(ref, alias)
        if col is not None:
            return alias, col
    return None


def _range_terms(on: str, left: str, right: str):
    """``a.x >= b.lo AND a.x < b.hi`` (any of >, >=, <, <=, either order of
    operands) -> (point alias, point column, lo column, hi column); else None."""
    terms = re.split(r"\s+AND\s+", on.strip(), flags=re.I)
    if len(terms) != 2:
        return None
    parsed = []
    for term in terms:
        m = _RANGE_CMP.match(term)
        if not m:
            return None
        a, op, b = m.groups()
        ra, rb = _resolve(a, left, right), _resolve(b, left, right)
        if ra is None or rb is None or ra[0] == rb[0]:
            return None
        parsed.append((ra, op, rb))
    for side in (left, right):
        # each term as "point <op> bound" seen from this side
        norm = [(ra[1], op, rb[1]) if ra[0] == side else (rb[1], _FLIP[op], ra[1])
                for ra, op, rb in parsed]
        if norm[0][0] != norm[1][0]:
            continue
        lower = [bnd for _, op, bnd in norm if op in (">=", ">")]
        upper = [bnd for _, op, bnd in norm if op in ("<=", "<")]
        if len(lower) == 1 and len(upper) == 1 and lower[0] != upper[0]:
            return side, norm[0][0], lower[0], upper[0]
    return None


def _overlap_terms(on: str, left: str, right: str):
    """``l.lo < r.hi AND r.lo < l.hi`` (or <=, or turned round) ->
    ((l.lo, l.hi), (r.lo, r.hi)); else None."""
    terms = re.split(r"\s+AND\s+", on.strip(), flags=re.I)
    bounds = {}
    for m in map(_RANGE_CMP.match, terms):
        if not m:
            return None
        a, op, b = m.groups()
        if op in (">", ">="):
            a, b = b, a
        low, high = _resolve(a, left, right), _resolve(b, left, right)
        if low is None or high is None or low[0] == high[0]:
            return None
        bounds[low[0], "lo"], bounds[high[0], "hi"] = low[1], high[1]
    if len(terms) != 2 or len(bounds) != 4:
        return None
    return (bounds[left, "lo"], bounds[left, "hi"]), (bounds[right, "lo"], bounds[right, "hi"])


def join_frames(frames: Mapping[str, DataFrame], join: Mapping) -> DataFrame:
    """One join of two aliased sources.

    Equi-joins (with any extra residual condition) are planned by Spark:
    shuffle on the keys, or broadcast when the planner's size check allows
    it.  A pure range condition (``l.x >= r.lo AND l.x < r.hi``) becomes a
    join on dyadic nodes (none finer than ``bin_width`` if the config has one)
    for inner joins, and for left / semi / anti joins with the points on the
    left (right joins with the points on the right, mirrored); a full outer
    range join would need each unmatched range once and is not run so.  Two
    ranges that overlap (``l.lo < r.hi AND r.lo < l.hi``) join likewise, inner.
    Any other condition that would plan as a nested loop or a
    Cartesian product over two sides without a proven row bound, i.e.
    compare all pairs, is refused.
    """
    left, right = join["left"], join["right"]
    how = (join.get("how") or "left").strip().lower()
    ldf, rdf = frames[left], frames[right]
    if how.replace(" ", "_") in ("asof", "asof_left"):
        keys, (lt, op, rt) = _asof_terms(join["on"], left, right)
        return asof_join(ldf, rdf, keys, lt, rt, tiebreak=join.get("tiebreak", ()),
                         bucket=join.get("bucket", "auto"), op=op,
                         how="left" if how != "asof" else "inner")
    jt = spark_join_type(how)
    rng = _range_terms(join["on"], left, right)
    if rng is not None:
        side, point, lo, hi = rng
        # every pair must meet once, and a range row is repeated per bin:
        # only joins that keep no unmatched range rows may use bins
        on, width = join["on"], join.get("bin_width")
        if jt == "inner" or (side == left and jt in ("left", "left_semi", "left_anti")):
            return dyadic_range_join(ldf, rdf, side == left, point, lo, hi,
                                     lambda *_: F.expr(on), jt, width, aliases=(left, right))
        if jt == "right" and side == right:
            # the mirror of a left join with the points first; left columns first again
            out = dyadic_range_join(rdf, ldf, True, point, lo, hi, lambda *_: F.expr(on),
                                    "left", width, aliases=(right, left))
            return out.select(f"{left}.*", f"{right}.*")
    overlap = _overlap_terms(join["on"], left, right)
    if overlap is not None and jt == "inner":
        on = join["on"]
        return dyadic_overlap_join(ldf, rdf, *overlap, lambda *_: F.expr(on), join.get("bin_width"), aliases=(left, right))
    out = ldf.alias(left).join(rdf.alias(right), F.expr(join["on"]), jt)
    if unbounded_all_pairs(out):
        raise ValueError(
            f"join condition {join['on']!r} has no equality term: it would compare all "
            "pairs of rows. Add an equality, or write a range as "
            "'l.x >= r.lo AND l.x < r.hi' (optionally with bin_width).")
    return out


def aggregate(df: DataFrame, agg: Mapping) -> DataFrame:
    metrics = [F.expr(expr).alias(name) for name, expr in agg.get("metrics", {}).items()]
    group_by = list(agg.get("group_by") or [])
    if not metrics and not group_by:
        raise ValueError("aggregate needs group_by or metrics")
    if not group_by:
        return df.agg(*metrics)
    keys = [F.expr(g) for g in group_by]
    if not metrics:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return df.groupBy(*keys).agg(*metrics)


def run_transformation(spark: SparkSession, config: Mapping,
                       frames: Mapping[str, DataFrame] | None = None,
                       resolve: Callable[[SparkSession, Mapping], DataFrame] | None = None
                       ) -> DataFrame:
    """Build the transformation's DataFrame (lazy; nothing is read yet)."""
    sources = config.get("sources") or []
    if not sources:
        raise ValueError("transformation needs at least one source")
    if resolve is None:
        from quarry.sources.registry import read_source as resolve
    by_alias: dict[str, DataFrame] = dict(frames or {})
    for src in sources:
        alias = src["alias"]
        if alias not in by_alias:
            by_alias[alias] = resolve(spark, src)
    join, agg = config.get("join"), config.get("aggregate")
    if join:
        df = join_frames(by_alias, join)
    else:
        df = by_alias[sources[0]["alias"]].alias(sources[0]["alias"])
    if agg:
        df = aggregate(df, agg)
    return dedupe_columns(df)
