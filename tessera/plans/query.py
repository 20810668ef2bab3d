"""Guarded read-only SQL over the tables of a store."""
from __future__ import annotations

from collections.abc import Sequence

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.audit import refusal
from tessera.plans.store import catalog, stored_rows
from tessera.session import prepare

# Names under which a query sees the two registries.
REGISTRIES = {"catalog_sources": "sources", "catalog_tables": "tables"}


#: What a query may read besides the views made for it.
HARMLESS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "CommandResult", "ResolvedNamespace")
PLAN = "org.apache.spark.sql.catalyst.plans.QueryPlan"
REFLECTION = "org.apache.spark.sql.catalyst.expressions.CallMethodViaReflection"
SUBQUERY = "org.apache.spark.sql.catalyst.expressions.SubqueryExpression"


def _reach(session: SparkSession, plan, views: set[str]) -> str | None:
    """Why an analyzed plan reaches beyond ``views``, or None.

    Names are settled in the analyzed plan, however they were spelled, so this
    holds where a look at the text does not.
    """
    gateway = session.sparkContext._gateway
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind in ("View", "DescribeTableCommand"):
            name = node.desc().identifier() if kind == "View" else node.table()
            if name.database().isDefined() or name.table() not in views:
                return f"{name.unquotedString()} is not in the store"
            continue
        if is_instance_of(gateway, node, REFLECTION):
            return "function not allowed"
        if is_instance_of(gateway, node, SUBQUERY):
            todo.append(node.plan())
        below = [node.children()]
        if is_instance_of(gateway, node, PLAN):
            below.append(node.expressions())
            if node.children().isEmpty() and kind not in HARMLESS:
                return f"{kind} is not in the store"
        todo += [seq.apply(i) for seq in below for i in range(seq.size())]
    return None


def query(spark: SparkSession, root: str, sql: str, args: Sequence | dict = ()) -> DataFrame:
    """Run one read-only statement with bound parameters.

    Every cataloged table the text mentions is visible under its own name, in
    a session of its own; parameters are bound by Spark and never become part
    of the text. The text is checked before it is analyzed and the analyzed plan
    before it is returned: it may read those tables and nothing else.
    """
    refused = spark.range(1).select(refusal(F.lit(sql)).alias("why")).first().why
    if refused:
        raise ValueError(f"refused: {refused}")
    session = prepare(spark.newSession())
    mentioned = catalog(session, root, "tables").filter(F.instr(F.lit(sql.lower()), F.col("table_name")) > 0)
    # As many rows as the statement names tables.
    tables = mentioned.collect()
    for row in tables:
        stored_rows(session, root, row.location, row.schema_json).createOrReplaceTempView(row.table_name)
    views = {row.table_name for row in tables} | set(REGISTRIES)
    for name, which in REGISTRIES.items():
        catalog(session, root, which).createOrReplaceTempView(name)
    # Paths in place of tables are refused by the analyzer, whatever their spelling.
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        found = session.sql(sql, args=args if isinstance(args, dict) else list(args))
    except AnalysisException as error:
        if error.getCondition() in ("TABLE_OR_VIEW_NOT_FOUND", "UNSUPPORTED_DATASOURCE_FOR_DIRECT_QUERY"):
            raise ValueError(f"refused: not in the store: {error}") from error
        raise
    refused = _reach(session, found._jdf.queryExecution().analyzed(), views)
    if refused:
        raise ValueError(f"refused: {refused}")
    return found
