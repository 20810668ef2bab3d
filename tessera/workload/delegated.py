"""Relational queries that reach the stored tables through the guarded surface."""
from __future__ import annotations

from tessera.plans.query import query as ask
from tessera.workload.inputs import CLEAN_ORDERS
from tessera.workload.registry import query
from tessera.workload.stores import LINES, ORDERS, shared_store

_LINES = (
    "SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_suppkey, l_quantity, l_returnflag FROM lineitem"
)


def delegated(name: str, sql: str, oracle: str | None = None) -> None:
    """One statement for both engines; only the tables' names differ."""
    ctes = f"WITH {ORDERS} AS ({CLEAN_ORDERS}), {LINES} AS ({_LINES}) "

    @query(name, ctes + (oracle or sql))
    def run_it(spark, sf_dir):
        return ask(spark, shared_store(spark, sf_dir), sql)


delegated(
    "delegated_join",
    f"""SELECT o.prioridade, count(*) AS n_orders, count(l.order_key) AS n_lines FROM {ORDERS} o
    LEFT JOIN {LINES} l ON l.order_key = o.k AND l.l_quantity > 40 GROUP BY o.prioridade""",
)
delegated(
    "delegated_semi_anti",
    f"""SELECT 'with lines' AS label, count(*) AS n FROM {ORDERS} o WHERE EXISTS (SELECT 1 FROM {LINES} l WHERE l.order_key = o.k)
    UNION ALL SELECT 'without lines', count(*) FROM {ORDERS} o WHERE NOT EXISTS (SELECT 1 FROM {LINES} l WHERE l.order_key = o.k)""",
)
delegated(
    "delegated_window",
    f"""SELECT k, cliente, row_number() OVER w AS place, sum(valor) OVER (PARTITION BY cliente) > 100000 AS large,
    lag(k) OVER w AS previous FROM {ORDERS} WINDOW w AS (PARTITION BY cliente ORDER BY registro, k)""",
)
delegated(
    "delegated_asof",
    # The latest earlier order of the same client: one row per moment, then the
    # moment before, so no pairs of orders are ever formed.
    f"""SELECT o.k, p.earlier FROM {ORDERS} o JOIN (SELECT cliente, registro, lag(latest) OVER (PARTITION BY cliente ORDER BY registro) AS earlier
      FROM (SELECT cliente, registro, max(k) AS latest FROM {ORDERS} GROUP BY cliente, registro) m) p
    ON o.cliente = p.cliente AND o.registro = p.registro WHERE p.earlier IS NOT NULL""",
)
delegated(
    "delegated_rollup",
    f"""SELECT prioridade, year(registro) AS year, grouping(prioridade) AS g, count(*) AS n FROM {ORDERS}
    GROUP BY ROLLUP (prioridade, year(registro))""",
)
delegated(
    "delegated_cube",
    f"""SELECT prioridade, codigo = 'n/a' AS blank, grouping(prioridade) + grouping(codigo = 'n/a') AS g, count(*) AS n FROM {ORDERS}
    GROUP BY CUBE (prioridade, codigo = 'n/a')""",
)
delegated(
    "delegated_setops",
    f"""SELECT k FROM {ORDERS} WHERE valor > 100000 INTERSECT SELECT order_key FROM {LINES} WHERE l_quantity > 25
    EXCEPT SELECT order_key FROM {LINES} WHERE l_returnflag = 'R'""",
)
delegated(
    "delegated_topk",
    f"SELECT k, valor FROM {ORDERS} ORDER BY valor DESC, k LIMIT 10",
)
delegated(
    "delegated_cte",
    f"""WITH big AS (SELECT order_key, sum(l_quantity) AS q FROM {LINES} GROUP BY order_key HAVING sum(l_quantity) > 150)
    SELECT o.prioridade, count(DISTINCT o.cliente) AS n_clients, max(big.q) AS most FROM {ORDERS} o JOIN big ON big.order_key = o.k GROUP BY o.prioridade""",
    f"""SELECT o.prioridade, count(DISTINCT o.cliente) AS n_clients, max(big.q) AS most FROM {ORDERS} o
    JOIN (SELECT order_key, sum(l_quantity) AS q FROM {LINES} GROUP BY order_key HAVING sum(l_quantity) > 150) big ON big.order_key = o.k GROUP BY o.prioridade""",
)
