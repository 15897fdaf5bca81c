"""Free SELECTs over the view logs alone, judged by what the analysed plan reads and calls."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from .order import Asked, paged, query_hash

MOST = 500
#: Settings of the caller's session under which the statement is read.
_CARRIED = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
#: Plan nodes that only reshape rows of their children.
_RESHAPING = frozenset(
    """Project Filter Aggregate Sort Join LateralJoin Window Generate Distinct Deduplicate GlobalLimit LocalLimit Offset SubqueryAlias
    Union Intersect Except Expand WithCTE CTERelationDef Sample ResolvedHint RepartitionByExpression Repartition RebalancePartitions
    UnionLoop Subquery PipeOperator""".split()
)
#: Leaves that hold no data of their own: a row without columns, and references to the statement's own WITH.
_OWN_LEAVES = frozenset("OneRowRelation CTERelationRef UnionLoopRef".split())
#: Expressions that run code from outside the statement.
_FOREIGN = frozenset("CallMethodViaReflection TryReflect ScalaUDF PythonUDF PythonUDAF PythonUDTF ScalaUDAF ScalaAggregator HiveGenericUDF HiveSimpleUDF HiveGenericUDTF HiveUDAFFunction UserDefinedPythonFunction".split())


def _seq(items) -> Iterator:
    return (items.apply(i) for i in range(items.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _is_logs(node) -> bool:
    """Whether a node is the session's temporary view logs itself, not something that the statement calls so."""
    if _kind(node) != "View" or not node.isTempView():
        return False
    name = node.desc().identifier()
    return name.table().lower() == "logs" and name.database().isEmpty()


def _check_expression(e) -> None:
    if _kind(e) in _FOREIGN:
        raise ValueError(f"the function {e.prettyName()} may not be called")
    for child in _seq(e.children()):
        _check_expression(child)


def _reads_logs(node) -> bool:
    """Whether a plan reads logs; ValueError where it reads, writes or calls anything else."""
    if _is_logs(node):
        return True
    kind = _kind(node)
    children, inner = list(_seq(node.children())), list(_seq(node.subqueries()))
    if not children and kind not in _OWN_LEAVES:
        raise ValueError(f"only the view logs may be read, not {node.simpleString(25)}")
    if children and kind not in _RESHAPING:
        raise ValueError(f"only the view logs may be read: {kind} is not allowed")
    if kind == "Generate" and _kind(children[0]) == "OneRowRelation" and not _outer(node):
        raise ValueError("table functions may not be read")
    for e in _seq(node.expressions()):
        _check_expression(e)
    return any([_reads_logs(x) for x in (*children, *inner)])


def _outer(node) -> bool:
    """Whether a node's expressions refer to the row outside (a generator over columns of logs, in a lateral join)."""
    return any("outer(" in e.toString() for e in _seq(node.expressions()))


def _ordered(node) -> bool:
    """Whether the statement itself ends in an ORDER BY."""
    while True:
        kind = _kind(node)
        if kind == "Sort":
            return getattr(node, "global")()
        if kind not in ("Project", "SubqueryAlias", "GlobalLimit", "LocalLimit", "Offset", "WithCTE"):
            return False
        node = list(_seq(node.children()))[-1]


def _alone(logs: DataFrame) -> SparkSession:
    """A session whose only view is logs, and which reads no files by path; the caller's session stays as it is."""
    spark = logs.sparkSession
    name = f"logs_{uuid.uuid4().hex}"
    session = spark.newSession()
    for key in _CARRIED:
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    logs.createGlobalTempView(name)
    try:
        session.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{name}").createTempView("logs")
    finally:
        spark.catalog.dropGlobalTempView(name)
    return session


def ask_sql(logs: DataFrame, text: str, offset: int = 0) -> Asked:
    """A checked SELECT over logs, unpaged, with its identity; refused as in run_sql."""
    bare = text.strip().rstrip(";").strip()
    if not bare:
        raise ValueError("a statement is needed")
    try:
        found = _alone(logs).sql(f"SELECT * FROM (\n{bare}\n)")
    except ParseException as e:
        raise ValueError(f"one SELECT is allowed: {e}") from e
    except AnalysisException as e:
        raise ValueError(f"the statement could not be planned: {e}") from e
    plan = found._jdf.queryExecution().analyzed()
    if not _reads_logs(plan):
        raise ValueError("the statement has to read logs")
    if offset and not _ordered(plan):
        raise ValueError("an offset needs an ORDER BY")
    return Asked(found, [], query_hash("sql", text=bare))


def run_sql(logs: DataFrame, text: str, size: int = MOST, offset: int = 0) -> DataFrame:
    """One read-only SELECT over logs; an offset needs its ORDER BY; 500 rows a page at most.

    The statement is analysed in a session of its own as the body of a subquery, where the grammar has no
    commands. Then its plan is walked: every leaf must be the view logs (or the statement's own WITH), every other node must
    only reshape rows, and no expression may run foreign code. Generators such as explode are free to use over
    columns of logs. A ValueError says what is refused; nothing is run before.
    """
    if not 1 <= size <= MOST or offset < 0:
        raise ValueError(f"a page has 1 to {MOST} rows and starts at 0 or later")
    return ask_sql(logs, text, offset).rows.offset(offset).limit(size)


def sql_page(logs: DataFrame, text: str, size: int = MOST, offset: int = 0, **paging) -> DataFrame:
    """run_sql with the metadata of `paged`."""
    return paged(ask_sql(logs, text, offset), size=size, offset=offset, most=MOST, empty="Query returned 0 results", **paging)
