"""SQL over named datasets: views (Q1), run (Q4), cap (Q5), NaN (Q6), result (Q7).

A query binds each dataset's newest good snapshot as a temp view in a fresh
``newSession()`` (views are per query, so two queries may bind one name to
different snapshots), runs the user's Spark SQL, caps rows unless the text
already says LIMIT, and turns float NaN into NULL.  Nothing is collected
until the caller asks, and then only up to the cap.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import islice

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from quarry.functions.names import sanitize_name
from quarry.functions.nulls import nan_to_null
from quarry.functions.sqltext import has_limit, strip_trailing_semicolons
from quarry.operators.joins import unbounded_all_pairs
from quarry.session import query_session

DEFAULT_CAP = 1000
EXPORT_CAP = 10000

# A dataset to bind: a snapshot path (Parquet directory) or a reader taking
# the query session (the frame must be created *through* that session).
DatasetRef = str | Callable[[SparkSession], DataFrame]


class QueryError(ValueError):
    pass


def dataset_views(spark: SparkSession, datasets: Mapping[str, DatasetRef]) -> tuple[SparkSession, dict]:
    """Bind each dataset as a view named by the name rule in a new session.

    Returns the session and ``{dataset name: view name}``.  Two names that
    normalise to the same view, or to an empty one, are rejected.
    """
    qs = query_session(spark)
    views: dict[str, str] = {}
    taken: dict[str, str] = {}
    for name, ref in datasets.items():
        view = sanitize_name(name)
        if not view:
            raise QueryError(f"Dataset name {name!r} gives an empty view name")
        if view in taken:
            raise QueryError(f"View name {view!r} of {name!r} already used by {taken[view]!r}")
        df = qs.read.parquet(ref) if isinstance(ref, str) else ref(qs)
        df.createOrReplaceTempView(view)
        views[name] = view
        taken[view] = name
    return qs, views


def capped(df: DataFrame, sql: str, cap: int | None) -> DataFrame:
    """Apply the row cap unless the statement has its own LIMIT."""
    if cap is None or has_limit(sql):
        return df
    return df.limit(cap)


@dataclass
class QueryResult:
    """A query's DataFrame plus what the service reports about it."""

    df: DataFrame
    sql: str
    views: dict
    cap: int | None
    started: float = field(default_factory=time.time)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def rows(self) -> Iterator[dict]:
        """The result's rows one by one; the driver holds one partition at a time."""
        try:
            for r in self.df.toLocalIterator():
                yield r.asDict(recursive=True)
        except (PySparkException, Py4JJavaError) as e:  # an iterator's errors reach Python unconverted
            raise QueryError(f"Query execution failed: {e}") from e

    def collect(self, max_rows: int | None = None) -> dict:
        """Materialise into the reported shape: all rows that the cap or the
        statement's own LIMIT leaves, or the first ``max_rows`` if given
        (``truncated`` says when more were there).  Large results are read
        with :meth:`rows` or written by executors (``export_result``)."""
        rows = list(islice(self.rows(), None if max_rows is None else max_rows + 1))
        got, rows = len(rows), rows[:max_rows]
        out = {
            "rows": rows,
            "columns": self.columns,
            "row_count": len(rows),
            "execution_time_ms": round((time.time() - self.started) * 1000, 2),
            "views": self.views,
            "query_executed": self.sql,
            "truncated": got > len(rows),
        }
        if not rows:
            out["hints"] = [
                "The query returned no rows; check filter values and join keys.",
                "List view names and columns with dataset_schemas().",
            ]
        return out


def _only_queries(qs: SparkSession, text: str) -> None:
    """Refuse a statement that is anything but a query: commands and inserts,
    also below a WITH.  The text is parsed, nothing runs."""
    of = qs._jvm.java.lang.Class.forName
    loader = qs._jsparkSession.getClass().getClassLoader()
    names = ("plans.logical.Command", "plans.logical.ParsedStatement")
    kinds = [of(f"org.apache.spark.sql.catalyst.{n}", False, loader) for n in names]
    sessions = qs._jvm.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(qs._jsparkSession)  # the parser follows the active session's dialect
    try:
        todo = [qs._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds) or node.nodeName().startswith("InsertInto"):
            raise QueryError(f"Query execution failed: only queries are run, not {node.nodeName()}")
        todo += [node.children().apply(i) for i in range(node.children().size())]


def run_sql(spark: SparkSession, datasets: Mapping[str, DatasetRef], sql: str,
            cap: int | None = DEFAULT_CAP, allow_all_pairs: bool = False) -> QueryResult:
    """Run one Spark SQL statement over the named datasets.

    A statement whose plan joins two inputs without a proven row bound by
    comparing all pairs (a cross join, or a join with no equality term) is
    refused unless ``allow_all_pairs``: at scale it would not finish.
    """
    started = time.time()
    qs, views = dataset_views(spark, datasets)
    text = strip_trailing_semicolons(sql)
    try:
        _only_queries(qs, text)
        df = qs.sql(text)
    except (AnalysisException, ParseException) as e:
        raise QueryError(f"Query execution failed: {e}") from e
    if not allow_all_pairs:
        pairs = unbounded_all_pairs(df)
        if pairs:
            raise QueryError(
                "Query execution failed: the plan compares all pairs of rows of two "
                f"unbounded inputs ({pairs[0]}); add an equality join term, bound one "
                "side, or pass allow_all_pairs=True")
    df = nan_to_null(capped(df, text, cap))
    return QueryResult(df=df, sql=text, views=views, cap=cap, started=started)
