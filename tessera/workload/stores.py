"""Storage, catalogs, citations and the read-only query surface."""
from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators.audit import audit
from tessera.operators.cells import ROW, melt
from tessera.plans import bulk, store
from tessera.plans.query import query as ask
from tessera.plans.store import Dataset
from tessera.session import scratch
from tessera.sources.files import change_status, checksums
from tessera.sources.pages import read_pages
from tessera.workload.inputs import CLEAN_ORDERS, messy_orders, run
from tessera.workload.registry import query
from tessera.workload.scans import SUPPLIER_PAGE, export_pages

PAGE = "wiki/sources/orders.md"


def orders_dataset(spark, sf_dir) -> Dataset:
    df = messy_orders(spark, sf_dir)
    return Dataset("Pedidos 2024", df.withColumn(ROW, F.col("k")), source_page=7, source_section="Lista")


def lines_dataset(spark, sf_dir) -> Dataset:
    df = run(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag FROM lineitem")
    return Dataset("Itens", df.withColumnsRenamed({"l_orderkey": "Order Key", "l_linenumber": "Line-Number"}))


_STORES: dict[tuple[str, str], str] = {}


def shared_store(spark, sf_dir) -> str:
    """One store with two sources, built once per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        root = scratch(spark, "store")
        store.persist_source(
            spark, root, "Orders", f"{sf_dir}/orders.parquet", PAGE, [orders_dataset(spark, sf_dir)]
        )
        store.persist_source(
            spark, root, "line items", f"{sf_dir}/lineitem.parquet", "wiki/sources/lines.md", [lines_dataset(spark, sf_dir)]
        )
        _STORES[key] = root
    return _STORES[key]


ORDERS = "orders__pedidos_2024"
LINES = "line_items__itens"
STAMP = "'Orders' AS source_id, cast(7 AS bigint) AS source_page, 'Lista' AS source_section, cast(NULL AS varchar) AS source_sheet"


@query("sink_persist_source", f"SELECT *, {STAMP} FROM ({CLEAN_ORDERS}) c")
def persist(spark, sf_dir):
    return store.table(spark, shared_store(spark, sf_dir), ORDERS)


@query(
    "append_provenance",
    """SELECT source_id, source_page, source_section, source_sheet, count(*) AS n_rows FROM (
      SELECT 'Orders' AS source_id, cast(7 AS bigint) AS source_page, 'Lista' AS source_section, cast(NULL AS varchar) AS source_sheet FROM orders
      UNION ALL SELECT 'line items', NULL, NULL, NULL FROM lineitem) x GROUP BY ALL""",
)
def provenance(spark, sf_dir):
    root = shared_store(spark, sf_dir)
    keys = ["source_id", "source_page", "source_section", "source_sheet"]
    both = store.table(spark, root, ORDERS).select(*keys).unionByName(store.table(spark, root, LINES).select(*keys))
    return both.groupBy(*keys).agg(F.count("*").alias("n_rows"))


@query(
    "sink_rebuild_source",
    """SELECT 'a__keys' AS table_name, count(*) AS n_rows, cast(sum(o_custkey + 1) AS bigint) AS total FROM orders
    UNION ALL SELECT 'b__keys', count(*), cast(sum(c_custkey) AS bigint) FROM customer""",
)
def rebuild(spark, sf_dir):
    """Rebuilding one source keeps its table name and leaves the other alone."""
    root = scratch(spark, "store")
    old = run(spark, sf_dir, "SELECT o_custkey AS v FROM orders")
    new = run(spark, sf_dir, "SELECT o_custkey + 1 AS v FROM orders")
    other = run(spark, sf_dir, "SELECT c_custkey AS v FROM customer")
    store.persist_source(spark, root, "a", "raw/a.csv", "a.md", [Dataset("keys", old), Dataset("gone", old)], checksum="1")
    store.persist_source(spark, root, "b", "raw/b.csv", "b.md", [Dataset("keys", other)], checksum="2")
    store.rebuild_source(spark, root, "a", "raw/a.csv", "a.md", [Dataset("keys", new)], checksum="3")
    names = [r.table_name for r in store.catalog(spark, root, "tables").select("table_name").collect()]
    sums = [
        store.table(spark, root, name).agg(F.count("*").alias("n_rows"), F.sum("v").alias("total")).select(
            F.lit(name).alias("table_name"), "n_rows", "total"
        )
        for name in sorted(names)
    ]
    whole = sums[0]
    for part in sums[1:]:
        whole = whole.unionByName(part)
    return whole


@query(
    "sink_rebuild_idempotent",
    "SELECT count(*) AS n_rows, cast(0 AS bigint) AS n_missing, cast(0 AS bigint) AS n_added FROM orders",
)
def idempotent(spark, sf_dir):
    """Storing what was stored changes no row."""
    root = scratch(spark, "store")
    first = orders_dataset(spark, sf_dir)
    store.persist_source(spark, root, "Orders", "raw/o.csv", PAGE, [first], checksum="1")
    before = store.table(spark, root, ORDERS)
    again = before.drop(*store.RESERVED).withColumn(ROW, F.col("k"))
    store.rebuild_source(
        spark, root, "Orders", "raw/o.csv", PAGE, [Dataset(first.name, again, 7, "Lista")], checksum="1"
    )
    after = store.table(spark, root, ORDERS)
    # Marked copies of all rows cancel out when both versions hold the same ones.
    sides = before.withColumn("side", F.lit(-1)).unionByName(after.withColumn("side", F.lit(1)))
    balance = sides.groupBy(*before.columns).agg(
        F.sum("side").alias("b"), F.count_if(F.col("side") == 1).alias("n")
    )
    return balance.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.greatest(-F.col("b"), F.lit(0))).alias("n_missing"),
        F.sum(F.greatest(F.col("b"), F.lit(0))).alias("n_added"),
    )


@query(
    "sink_atomic_commit",
    """SELECT 'stable' AS source_id, 'stable__good' AS table_name, count(*) AS row_count, count(*) AS readable FROM orders""",
)
def atomic(spark, sf_dir):
    """A source whose second dataset fails while it is written leaves nothing behind."""
    root = scratch(spark, "store")
    good = run(spark, sf_dir, "SELECT o_orderkey AS v FROM orders")
    bad = run(spark, sf_dir, "SELECT CASE WHEN o_orderkey > 0 THEN raise_error('cannot be read') ELSE o_orderkey END AS v FROM orders")
    kinds = {"good": [("BIGINT", None)], "bad": [("BIGINT", None)]}
    store.persist_source(spark, root, "stable", "raw/a.csv", "a.md", [Dataset("good", good)], checksum="1")
    try:
        store.persist_source(
            spark, root, "broken", "raw/b.csv", "b.md", [Dataset("good", good), Dataset("bad", bad.selectExpr("cast(v AS bigint) AS v"))],
            checksum="2", kinds=kinds,
        )
    except PySparkException:
        pass
    readable = store.table(spark, root, "stable__good").agg(F.count("*").alias("readable"))
    readable = readable.withColumn("table_name", F.lit("stable__good"))
    kept = store.catalog(spark, root, "tables").select("source_id", "table_name", "row_count")
    return kept.join(readable, "table_name", "left")


_REGISTRY = """
SELECT 'Orders' AS source_id, 'orders__pedidos_2024' AS table_name, 'Pedidos 2024' AS dataset_name, count(*) AS row_count, 'wiki/sources/orders.md' AS summary_page FROM orders
UNION ALL SELECT 'line items', 'line_items__itens', 'Itens', count(*), 'wiki/sources/lines.md' FROM lineitem
"""


@query(
    "catalog_sources",
    f"""SELECT name || '.md' AS summary_page, 'complete' AS extraction_status, sha256(body || chr(10)) AS content_checksum, length(body) + 1 AS length FROM ({SUPPLIER_PAGE}) p""",
)
def sources(spark, sf_dir):
    """The registry of sources that are files written for each supplier, with the checksums of these files."""
    path, root = export_pages(spark, run(spark, sf_dir, SUPPLIER_PAGE)), scratch(spark, "store")
    found = checksums(spark, path).where(F.col("path").endswith(".txt"))
    name = F.regexp_extract("path", "name=([^/]+)/", 1)
    listed = found.select(name.alias("source_id"), F.col("path").alias("source_resource"), F.concat(name, F.lit(".md")).alias("summary_page"), F.col("checksum").alias("content_checksum"))
    texts = read_pages(spark, path, "*").select(F.regexp_extract("path", r"\Aname=([^/]+)/", 1).alias("source_id"), F.col("body").alias("Text"))
    cells = melt(texts.withColumn(ROW, F.lit(0).cast("bigint")), ["Text"], F.col("source_id")).withColumnRenamed("dataset", "source_id").withColumns({"dataset": F.lit("page"), "pos": F.lit(0)})
    bulk.persist_many(spark, root, listed, cells)
    held = store.catalog(spark, root, "sources")
    first = store.catalog(spark, root, "tables").first()
    stored = bulk.together(spark, root, first.location, first.schema_json).select(F.length("text").alias("length"), F.concat(F.regexp_extract("table_name", r"\A(.+)__page\z", 1), F.lit(".md")).alias("page"))
    return held.join(stored, F.lower("summary_page") == F.col("page")).select("summary_page", "extraction_status", "content_checksum", "length")


@query("catalog_tables", f"SELECT source_id, table_name, dataset_name, row_count FROM ({_REGISTRY}) r")
def tables(spark, sf_dir):
    found = store.catalog(spark, shared_store(spark, sf_dir), "tables")
    return found.select("source_id", "table_name", "dataset_name", "row_count")


@query("catalog_owned_tables", f"SELECT source_id, table_name FROM ({_REGISTRY}) r WHERE source_id = 'Orders'")
def owned(spark, sf_dir):
    return store.owned_tables(spark, shared_store(spark, sf_dir), "Orders").select("source_id", "table_name")


@query(
    "catalog_change_detection",
    """SELECT c_name AS source_id, CASE WHEN c_custkey % 5 = 0 THEN 'new' WHEN c_custkey % 7 = 0 THEN 'absent'
    WHEN c_custkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM customer
    WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 7 = 0)""",
)
def changes(spark, sf_dir):
    incoming = run(
        spark, sf_dir,
        "SELECT c_name AS source_id, sha2(c_mktsegment || cast(c_custkey % 3 AS string), 256) AS checksum FROM customer WHERE c_custkey % 7 <> 0",
    )
    cataloged = run(
        spark, sf_dir,
        "SELECT c_name AS source_id, sha2(c_mktsegment || cast(greatest(c_custkey % 3, 1) AS string), 256) AS content_checksum "
        "FROM customer WHERE c_custkey % 5 <> 0",
    )
    return change_status(incoming, cataloged)


@query(
    "source_summary_inventory",
    f"""WITH r AS ({_REGISTRY}) SELECT source_id, 'complete' AS extraction_status, table_name, row_count, "column", type FROM r JOIN (VALUES
    ('Orders', 'k', 'BIGINT'), ('Orders', 'data_pedido', 'DATE'), ('Orders', 'registro', 'TIMESTAMP'), ('Orders', 'cpf', 'VARCHAR'),
    ('Orders', 'cep', 'VARCHAR'), ('Orders', 'telefone', 'VARCHAR'), ('Orders', 'codigo', 'VARCHAR'), ('Orders', 'valor', 'DOUBLE'),
    ('Orders', 'cliente', 'BIGINT'), ('Orders', 'prioridade', 'VARCHAR'), ('line items', 'order_key', 'BIGINT'), ('line items', 'line_number', 'BIGINT'),
    ('line items', 'l_suppkey', 'BIGINT'), ('line items', 'l_quantity', 'DOUBLE'), ('line items', 'l_returnflag', 'VARCHAR'),
    ('Orders', 'source_id', 'VARCHAR'), ('Orders', 'source_page', 'BIGINT'), ('Orders', 'source_section', 'VARCHAR'), ('Orders', 'source_sheet', 'VARCHAR'),
    ('line items', 'source_id', 'VARCHAR'), ('line items', 'source_page', 'BIGINT'), ('line items', 'source_section', 'VARCHAR'), ('line items', 'source_sheet', 'VARCHAR')
    ) t(source_id, "column", type) USING (source_id)""",
)
def inventory(spark, sf_dir):
    found = store.source_inventory(spark, shared_store(spark, sf_dir))
    listed = F.inline(F.from_json("schema_json", "array<struct<name:string,type:string>>")).alias("column", "type")
    return found.select("source_id", "extraction_status", "table_name", "row_count", listed)


@query(
    "citation_join",
    f"SELECT k, cpf, 'Orders' AS source_id, cast(7 AS bigint) AS source_page, 'Lista' AS source_section, '{PAGE}' AS summary_page FROM ({CLEAN_ORDERS}) c",
)
def cited(spark, sf_dir):
    found = store.citations(spark, shared_store(spark, sf_dir), ORDERS)
    return found.select("k", "cpf", "source_id", "source_page", "source_section", "summary_page")


@query("query_params", f"SELECT k, cpf, valor FROM ({CLEAN_ORDERS}) c WHERE prioridade = '5-LOW' AND valor > 1000 AND cep <> '0000'")
def params(spark, sf_dir):
    sql = f"SELECT k, cpf, valor FROM {ORDERS} WHERE prioridade = ? AND valor > ? AND cep <> ?;"
    return ask(spark, shared_store(spark, sf_dir), sql, ["5-LOW", 1000, "0000"])


@query(
    "query_timestamp_predicate",
    f"SELECT year(registro) AS year, count(*) AS n FROM ({CLEAN_ORDERS}) c WHERE registro >= TIMESTAMP '1995-06-15 14:30:00' GROUP BY 1",
)
def predicate(spark, sf_dir):
    sql = f"SELECT year(registro) AS year, count(*) AS n FROM {ORDERS} WHERE registro >= TIMESTAMP_NTZ '1995-06-15 14:30:00' GROUP BY 1"
    return ask(spark, shared_store(spark, sf_dir), sql)


@query(
    "query_cross_source_join",
    """SELECT o_orderpriority AS prioridade, 'Orders' AS order_source, 'line items' AS line_source, count(*) AS n_lines,
    sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 0 GROUP BY 1""",
)
def cross_source(spark, sf_dir):
    sql = f"""
    SELECT o.prioridade, o.source_id AS order_source, l.source_id AS line_source, count(*) AS n_lines, sum(l.l_quantity) AS quantity
    FROM {LINES} l JOIN {ORDERS} o ON l.order_key = o.k WHERE o.prioridade IS NOT NULL GROUP BY ALL"""
    return ask(spark, shared_store(spark, sf_dir), sql)


STATEMENTS = [
    ("'SELECT * FROM t WHERE k = ' || {k}", "accepted", None),
    ("'with a as (select ' || {k} || ') select * from a;'", "accepted", None),
    ("'SELECT ''drop table x; --'' AS a, ' || {k}", "accepted", None),
    ("'describe t' || {k}", "accepted", None),
    ("'INSERT INTO t VALUES (' || {k} || ')'", "refused", "write statement"),
    ("'SELECT 1; DELETE FROM t WHERE k = ' || {k}", "refused", "second statement"),
    ("'SELECT ' || {k} || ' -- comment'", "refused", "comment"),
    ("'SELECT /* x */ ' || {k}", "refused", "comment"),
    ("'SELECT /* open ' || {k}", "refused", "invalid comment"),
    ("'explain select ' || {k}", "refused", "not a query"),
    ("'select \"update\", ' || {k} || ' from t'", "accepted", None),
    ("'select load from t where k = ' || {k}", "refused", "write statement"),
    ("'SELECT ''it''''s; '' || ' || {k}", "accepted", None),
    ("'select * from parquet.`/data/' || {k} || '`'", "refused", "path not allowed"),
]


def _choice(values: list[str]) -> str:
    listed = " ".join(f"WHEN {n} THEN {value}" for n, value in enumerate(values))
    return f"CASE o_orderkey % {len(values)} {listed} END"


_KEY = "cast(o_orderkey AS varchar(20))"
_VERDICTS = _choice([f"'{v}'" for _, v, _ in STATEMENTS])
_REASONS = _choice([f"'{r}'" if r else "NULL" for _, _, r in STATEMENTS])


@query("statement_audit", f"SELECT o_orderkey AS k, {_VERDICTS} AS verdict, {_REASONS} AS reason FROM orders")
def audited(spark, sf_dir):
    # Spark reads doubled quotes as two literals in a row, so quotes come from chr().
    texts = [text.replace("''", "' || chr(39) || '").replace("{k}", _KEY) for text, _, _ in STATEMENTS]
    log = run(spark, sf_dir, f"SELECT o_orderkey AS k, {_choice(texts)} AS sql FROM orders")
    return audit(log).select("k", "verdict", "reason")


@query(
    "flagship",
    f"""SELECT strftime(registro, '%Y-%m') AS month, count(*) AS n_orders, count(data_pedido) AS n_dated,
    round(sum(valor), 2) AS total, 'Orders' AS source_id, '{PAGE}' AS summary_page FROM ({CLEAN_ORDERS}) c GROUP BY 1""",
)
def flagship(spark, sf_dir):
    """Messy texts to a typed, stored, cited table, then a monthly count over it."""
    root = scratch(spark, "store")
    store.persist_source(
        spark, root, "Orders", f"{sf_dir}/orders.parquet", PAGE, [orders_dataset(spark, sf_dir)]
    )
    cited_rows = store.citations(spark, root, ORDERS)
    return cited_rows.groupBy(F.date_format("registro", "yyyy-MM").alias("month"), "source_id", "summary_page").agg(
        F.count("*").alias("n_orders"), F.count("data_pedido").alias("n_dated"), F.round(F.sum("valor"), 2).alias("total")
    )
