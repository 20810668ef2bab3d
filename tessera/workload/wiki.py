"""Checks over a Markdown corpus written from customers, nations and suppliers."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corpus, links
from tessera.plans import store
from tessera.session import checkpointed, scratch
from tessera.workload.inputs import MESSY_COLUMNS, ORACLE_MESSY, messy_orders, run
from tessera.workload.registry import query

K = "cast(c_custkey AS varchar(20))"
NL = "chr(10)"

_ENTITY = f"""
SELECT 'wiki/entities/Customer_' || {K} || '.md' AS path,
  '---' || {NL}
  || CASE WHEN c_custkey % 50 = 7 THEN '' WHEN c_custkey % 50 = 9 THEN 'type: Concept' || {NL} ELSE 'type: Entity' || {NL} END
  || CASE WHEN c_custkey % 40 = 3 THEN '' ELSE 'title: Client ' || {K} || {NL} END
  || CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'description: Buys ' || lower(c_mktsegment) || {NL} END
  || 'tags: [customer, ' || lower(c_mktsegment) || ']' || {NL}
  || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'sources:' || {NL} || '  - id: parent' || {NL}
    || '    resource: wiki/entities/Customer_' || cast(cast(floor(c_custkey / 3) AS bigint) AS varchar(20)) || '.md' || {NL}
    || '    author: ' || CASE c_custkey % 3 WHEN 0 THEN 'human:ana' WHEN 1 THEN 'process:nightly' ELSE 'agent/1.0' END || {NL}
    || '    usage_count: ' || {K} || {NL}
    || '    last_modified: 2024-0' || cast(1 + c_custkey % 9 AS varchar(2)) || '-10T00:00:00Z' || {NL}
    || CASE WHEN c_custkey % 11 = 0 THEN '  - {{ id: raw, title: No resource }}' || {NL} ELSE '' END END
  || 'generated: {{ by: agent/1.0, at: 2024-0' || cast(1 + c_custkey % 5 AS varchar(2)) || '-20T08:00:00'
  || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '-04:00' END || ' }}' || {NL}
  || CASE c_custkey % 4 WHEN 0 THEN ''
    WHEN 1 THEN 'verified:' || {NL} || '  - {{ by: process:x, at: 2024-06-01T00:00:00Z }}' || {NL} || '  - {{ by: human:ana, at: 2024-06-01T00:00:00Z }}' || {NL}
    WHEN 2 THEN 'verified: {{ by: process:nightly, at: 2024-06-01T00:00:00Z }}' || {NL}
    ELSE 'verified:' || {NL} || '  - by: human:bob' || {NL} || '    at: 2024-06-02T00:00:00Z' || {NL} END
  || CASE WHEN c_custkey % 5 = 0 THEN 'owner: team-' || cast(c_custkey % 3 AS varchar(2)) || {NL} ELSE '' END
  || '---' || {NL} || 'Lives in [[NATION_' || cast(c_nationkey AS varchar(9)) || '|home]].' || {NL}
  || CASE c_custkey % 3 WHEN 0 THEN 'Knows Client ' || cast(c_custkey + 1 AS varchar(20)) || ' well.'
    WHEN 1 THEN 'Knows [[Customer_' || cast(c_custkey + 1 AS varchar(20)) || '#bio]] well.'
    ELSE 'Knows [[Nobody_' || cast(c_custkey % 17 AS varchar(9)) || ']].' END || {NL}
  || 'Claim.[^parent]' || CASE WHEN c_custkey % 6 = 0 THEN '[^ghost]' ELSE '' END || {NL} || '[^parent]: first source' AS body
FROM customer
"""
_CONCEPT = f"""
SELECT 'wiki/concepts/' || n_name || '.md', '---' || {NL} || 'type: Concept' || {NL} || 'title: "Nation ' || cast(n_nationkey AS varchar(9)) || '"' || {NL}
  || 'description: A country' || {NL} || '---' || {NL} || 'In [[' || r_name || ']] and [[NATION_' || cast((n_nationkey * 3 + 1) % 29 AS varchar(9)) || ']].'
FROM nation JOIN region ON n_regionkey = r_regionkey
"""
_SOURCE = f"""
SELECT 'wiki/sources/Supplier_' || cast(s_suppkey AS varchar(20)) || '.md', '---' || {NL} || 'type: Source Summary' || {NL}
  || 'title: Report ' || cast(s_suppkey AS varchar(20)) || {NL} || 'description: Deliveries # yearly' || {NL}
  || 'generated:' || {NL} || '  by: human:ana' || {NL} || '  at: 2024-0' || cast(1 + s_suppkey % 9 AS varchar(2)) || '-25T00:00:00Z' || {NL}
  || '---' || {NL} || 'About [[Customer_' || cast(s_suppkey AS varchar(20)) || ']].'
FROM supplier
"""
_NOTE = f"""
SELECT 'wiki/notes/' || {K} || '/note_' || {K} || '.md', '---' || {NL} || 'type: Note' || {NL} || 'title: Memo ' || {K} || {NL}
  || 'description: ' || lower(c_mktsegment) || {NL} || '---' || {NL} || 'Nothing.'
FROM customer WHERE c_custkey % 5 <> 0
"""
_INDEX = f"""
SELECT 'wiki/notes/' || {K} || '/index.md', '# Notes' || {NL}
  || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '* [Memo](note_' || {K} || '.md) - ' || lower(c_mktsegment) || {NL} END
  || CASE WHEN c_custkey % 3 = 0 THEN '* [Ghost](ghost.md) - gone' || {NL} ELSE '' END
  || CASE WHEN c_custkey % 11 = 0 THEN '* [Memo again](note_' || {K} || '.md)' || {NL} ELSE '' END
  || CASE WHEN c_custkey % 13 = 0 THEN '* [Long](long.md) - ' || repeat('x', 130) || {NL} ELSE '' END
FROM customer
"""
_RESERVED = f"""
SELECT 'wiki/r' || cast(r_regionkey AS varchar(9)) || '/log.md', CASE WHEN r_regionkey % 2 = 0 THEN '---' || {NL} || 'type: Entity' || {NL} || '---' || {NL} ELSE '' END || '# Log'
FROM region
"""
_LOG = f"""
SELECT 'wiki/logs/' || cast(o_orderkey AS varchar(20)) || '/log.md', '# Log' || {NL} || '## ' || {{{{yyyy-MM-dd}}}} || {NL} || '* **Update**: a' || {NL} || '## '
  || CASE WHEN o_orderkey % 4 = 0 THEN '2030-01-01' ELSE '1990-01-01' END || {NL} || '* **Creation**: b' || {NL}
FROM orders
"""
PAGES = " UNION ALL ".join((_ENTITY, _CONCEPT, _SOURCE, _NOTE, _INDEX, _RESERVED, _LOG))

_CACHE: dict[tuple[str, str, str], object] = {}


def _once(spark, sf_dir, what, make):
    """Corpus, parsed pages and edges are shared by the checks of one session."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _CACHE:
        _CACHE[key] = checkpointed(spark, make())
    return _CACHE[key]


def pages(spark, sf_dir):
    # Tables come in few splits and become pages of many times their size: pages are dealt out before they are read.
    return _once(spark, sf_dir, "pages", lambda: run(spark, sf_dir, PAGES).repartition("path"))


def parsed(spark, sf_dir):
    return _once(spark, sf_dir, "parsed", lambda: corpus.page_frontmatter(pages(spark, sf_dir)))


def edges(spark, sf_dir):
    return _once(spark, sf_dir, "edges", lambda: links.wikilink_edges(parsed(spark, sf_dir)))


# The same corpus as facts, straight from the keys; no text is read back.
FACTS = """
WITH RECURSIVE c AS (SELECT *, cast(c_custkey AS bigint) AS k, lower(c_mktsegment) AS seg FROM customer),
p AS (
  SELECT 'wiki/entities/Customer_' || k || '.md' AS path, 'entities' AS section, 'Customer_' || k AS name,
    CASE WHEN k % 50 = 7 THEN NULL WHEN k % 50 = 9 THEN 'Concept' ELSE 'Entity' END AS type,
    CASE WHEN k % 40 <> 3 THEN 'Client ' || k END AS title, CASE WHEN k % 10 <> 0 THEN 'Buys ' || seg END AS description,
    k % 7 <> 0 AS sourced, TIMESTAMP '2024-01-20 08:00:00' + to_months(cast(k % 5 AS integer)) + to_hours(CASE WHEN k % 13 = 0 THEN 0 ELSE 4 END) AS written, k FROM c
  UNION ALL SELECT 'wiki/concepts/' || n_name || '.md', 'concepts', n_name, 'Concept', 'Nation ' || n_nationkey, 'A country', false, NULL, NULL FROM nation
  UNION ALL SELECT 'wiki/sources/Supplier_' || s_suppkey || '.md', 'sources', 'Supplier_' || s_suppkey, 'Source Summary', 'Report ' || s_suppkey,
    'Deliveries', false, TIMESTAMP '2024-01-25 00:00:00' + to_months(cast(s_suppkey % 9 AS integer)), NULL FROM supplier
  UNION ALL SELECT 'wiki/notes/' || k || '/note_' || k || '.md', 'notes', 'note_' || k, 'Note', 'Memo ' || k, seg, false, NULL, NULL FROM c WHERE k % 5 <> 0
),
e AS (
  SELECT DISTINCT path, section, target FROM (
    SELECT 'wiki/entities/Customer_' || k || '.md' AS path, 'entities' AS section, 'NATION_' || c_nationkey AS target FROM c
    UNION ALL SELECT 'wiki/entities/Customer_' || k || '.md', 'entities', 'Customer_' || (k + 1) FROM c WHERE k % 3 = 1
    UNION ALL SELECT 'wiki/entities/Customer_' || k || '.md', 'entities', 'Nobody_' || (k % 17) FROM c WHERE k % 3 = 2
    UNION ALL SELECT 'wiki/concepts/' || n_name || '.md', 'concepts', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'wiki/concepts/' || n_name || '.md', 'concepts', 'NATION_' || ((n_nationkey * 3 + 1) % 29) FROM nation
    UNION ALL SELECT 'wiki/sources/Supplier_' || s_suppkey || '.md', 'sources', 'Customer_' || s_suppkey FROM supplier) x
),
names AS (SELECT path AS to_path, name AS target FROM p UNION SELECT path, title FROM p WHERE title IS NOT NULL),
missing AS (SELECT target, count(*) AS n_pages FROM e WHERE target NOT IN (SELECT target FROM names) GROUP BY target),
entries AS (
  SELECT 'wiki/notes/' || k || '/' AS dir, 'note_' || k || '.md' AS target, 'Memo' AS title, seg AS description, length('* [Memo](note_' || k || '.md) - ' || seg) AS size, k FROM c WHERE k % 7 <> 0
  UNION ALL SELECT 'wiki/notes/' || k || '/', 'ghost.md', 'Ghost', 'gone', 26, k FROM c WHERE k % 3 = 0
  UNION ALL SELECT 'wiki/notes/' || k || '/', 'note_' || k || '.md', 'Memo again', '', 30, k FROM c WHERE k % 11 = 0
  UNION ALL SELECT 'wiki/notes/' || k || '/', 'long.md', 'Long', repeat('x', 130), 150, k FROM c WHERE k % 13 = 0
),
"""
_PAGE = "'wiki/entities/Customer_' || k || '.md'"

RULES = {
    "page_required_keys": """SELECT 'missing key' AS rule, CASE key WHEN 'type' THEN 'error' ELSE 'warning' END AS severity, path, key AS detail
      FROM (SELECT path, unnest(['type', 'title', 'description']) AS key, unnest([type, title, description]) AS value FROM p) x WHERE value IS NULL""",
    "page_type_matches_section": """SELECT 'type outside its section' AS rule, 'error' AS severity, path, type AS detail FROM p WHERE section = 'entities' AND type = 'Concept'""",
    "page_reserved_names": """SELECT 'reserved name' AS rule, 'error' AS severity, 'wiki/r' || r_regionkey || '/log.md' AS path, 'log' AS detail FROM region WHERE r_regionkey % 2 = 0""",
    "page_timestamp_offsets": f"""SELECT 'timestamp without offset' AS rule, 'error' AS severity, {_PAGE} AS path, '2024-0' || (1 + k % 5) || '-20T08:00:00' AS detail FROM c WHERE k % 13 = 0""",
    "source_resource_required": f"""SELECT 'source without resource' AS rule, 'error' AS severity, {_PAGE} AS path, 'raw' AS detail FROM c WHERE k % 7 <> 0 AND k % 11 = 0""",
    "footnote_resolution": f"""SELECT 'unresolved footnote' AS rule, 'error' AS severity, {_PAGE} AS path, 'parent' AS detail FROM c WHERE k % 7 = 0
      UNION ALL SELECT 'unresolved footnote', 'error', {_PAGE}, 'ghost' FROM c WHERE k % 6 = 0
      UNION ALL SELECT 'unused source', 'info', {_PAGE}, 'raw' FROM c WHERE k % 7 <> 0 AND k % 11 = 0""",
    "lint_index_line_length": """SELECT 'index entry too long' AS rule, 'warning' AS severity, dir || 'index.md' AS path, cast(size AS varchar) AS detail FROM entries WHERE size > 120""",
    "lint_index_consistency": """SELECT 'index consistency' AS rule, 'warning' AS severity, path, CASE WHEN kept IS NULL THEN 'entry without page'
      WHEN n IS NULL THEN 'page without entry' ELSE 'listed more than once' END AS detail
      FROM (SELECT dir || target AS path, count(*) AS n FROM entries GROUP BY 1) x FULL JOIN (SELECT path, true AS kept FROM p) y USING (path)
      WHERE kept IS NULL OR n IS NULL OR n > 1""",
    "lint_log_order": """SELECT 'log not newest first' AS rule, 'warning' AS severity, 'wiki/logs/' || o_orderkey || '/log.md' AS path, '2030-01-01' AS detail FROM orders WHERE o_orderkey % 4 = 0""",
    "lint_orphans": """SELECT 'orphan page' AS rule, 'warning' AS severity, path, name AS detail FROM p
      WHERE NOT EXISTS (SELECT 1 FROM e JOIN names USING (target) WHERE to_path = p.path AND e.path <> p.path)""",
    "lint_broken_links": """SELECT 'broken link' AS rule, 'error' AS severity, path, target AS detail FROM e WHERE target NOT IN (SELECT target FROM names)""",
    "lint_missing_pages": """SELECT 'missing page' AS rule, 'info' AS severity, cast(NULL AS varchar) AS path, target AS detail FROM missing WHERE n_pages >= 2""",
    "lint_missing_crossrefs": """SELECT 'missing cross-reference' AS rule, 'info' AS severity, a.path, b.path AS detail
      FROM p a JOIN p b ON b.k = a.k + 1 WHERE a.k % 3 = 0 AND b.title IS NOT NULL""",
    "lint_stale_claims": """SELECT 'stale claim' AS rule, 'warning' AS severity, path, strftime(newest, '%Y-%m-%d %H:%M:%S') AS detail FROM (
      SELECT p.path, p.written, greatest(CASE WHEN p.sourced THEN TIMESTAMP '2024-01-10 00:00:00' + to_months(cast(p.k % 9 AS integer)) END, max(s.written)) AS newest
      FROM p LEFT JOIN e ON e.section = 'sources' AND e.target IN (p.name, p.title) LEFT JOIN p s ON s.path = e.path GROUP BY p.path, p.written, p.sourced, p.k) x
      WHERE written < newest""",
    "lint_data_gaps": """SELECT 'no sources' AS rule, 'info' AS severity, path, section AS detail FROM p WHERE NOT sourced AND section <> 'sources'""",
}
DONE = "done AS (SELECT 1)"


def rule_sql(name: str) -> str:
    return f"{FACTS} {DONE} {RULES[name]}"


def rule(name: str, check) -> None:
    query(name, rule_sql(name))(check)


rule("page_required_keys", lambda s, d: corpus.required_keys(parsed(s, d)))
rule("page_type_matches_section", lambda s, d: corpus.type_matches_section(parsed(s, d)))
rule("page_reserved_names", lambda s, d: corpus.reserved_names(parsed(s, d)))
rule("page_timestamp_offsets", lambda s, d: corpus.timestamp_offsets(parsed(s, d)))
rule("source_resource_required", lambda s, d: corpus.source_resource_required(parsed(s, d)))
rule("footnote_resolution", lambda s, d: corpus.footnote_resolution(parsed(s, d)))
rule("lint_index_line_length", lambda s, d: corpus.index_line_length(corpus.index_lines(pages(s, d))))
rule("lint_index_consistency", lambda s, d: corpus.index_consistency(corpus.index_lines(pages(s, d)), parsed(s, d)))
rule("lint_log_order", lambda s, d: corpus.log_order(pages(s, d)))
rule("lint_orphans", lambda s, d: links.orphans(parsed(s, d), edges(s, d)))
rule("lint_broken_links", lambda s, d: links.broken_links(parsed(s, d), edges(s, d)))
rule("lint_missing_crossrefs", lambda s, d: links.missing_crossrefs(parsed(s, d), edges(s, d)))
rule("lint_stale_claims", lambda s, d: links.stale_claims(parsed(s, d), edges(s, d)))
rule("lint_data_gaps", lambda s, d: links.data_gaps(parsed(s, d)))


@query("lint_missing_pages", f"{FACTS} {DONE} SELECT target, n_pages FROM missing WHERE n_pages >= 2")
def missing_pages(spark, sf_dir):
    return links.missing_pages(parsed(spark, sf_dir), edges(spark, sf_dir))


# Prose about guilds and harbours; some of them have a page, some are linked.
PROSE = f"""
SELECT 'wiki/entities/P' || {K} || '.md' AS path, '---' || {NL} || 'type: Entity' || {NL} || '---' || {NL} || 'Met Nation Guild ' || cast(c_nationkey AS varchar(9))
  || ' near Harbor Of ' || c_mktsegment || ' twice. Guild masters said: Harbor days. ' || CASE WHEN c_custkey % 2 = 0 THEN '[[Old Linked Tower]]' ELSE 'the Stone Bridge' END AS body FROM customer
UNION ALL SELECT 'wiki/concepts/Nation_Guild_' || cast(n_nationkey AS varchar(9)) || '.md', '---' || {NL} || 'type: Concept' || {NL}
  || 'title: Nation Guild ' || cast(n_nationkey AS varchar(9)) || {NL} || '---' || {NL} || 'nothing here' FROM nation WHERE n_nationkey % 2 = 0
"""


@query(
    "lint_missing_names",
    """WITH seen AS (SELECT 'Nation Guild ' || c_nationkey AS name, c_nationkey % 2 = 0 AS paged, c_custkey FROM customer
      UNION ALL SELECT 'Nation Guild', false, c_custkey FROM customer UNION ALL SELECT 'Harbor Of', false, c_custkey FROM customer
      UNION ALL SELECT 'Harbor Of ' || c_mktsegment, false, c_custkey FROM customer UNION ALL SELECT 'Stone Bridge', false, c_custkey FROM customer WHERE c_custkey % 2 = 1),
    counted AS (SELECT name, paged, count(*) AS n_pages FROM seen GROUP BY ALL HAVING count(*) >= 3),
    harbor AS (SELECT name, paged, n_pages + (name = 'Harbor')::INT AS n_pages FROM counted)
    SELECT name, n_pages FROM harbor h WHERE NOT paged AND NOT EXISTS (SELECT 1 FROM counted o WHERE o.name LIKE h.name || ' %' AND o.n_pages = h.n_pages)""",
)
def missing_names(spark, sf_dir):
    """Names in at least three pages that no page is about."""
    return links.missing_names(corpus.page_frontmatter(run(spark, sf_dir, PROSE)), 3)


_ALL = " UNION ALL ".join(f"SELECT rule, severity, path, detail FROM ({sql}) r{n}" for n, sql in enumerate(RULES.values()))


@query(
    "lint_report",
    f"""{FACTS} {DONE} SELECT rule, section, count(*) AS n_findings FROM (
      SELECT *, regexp_extract(coalesce(path, ''), '(^|/)wiki/([^/]+)/', 2) AS section FROM ({_ALL}) f) g GROUP BY ROLLUP (rule, section)""",
)
def report(spark, sf_dir):
    return links.lint_report(links.lint(pages(spark, sf_dir)))


@query("wikilink_edges", f"{FACTS} {DONE} SELECT path, section, target, 1 AS n_links FROM e")
def wikilinks(spark, sf_dir):
    return edges(spark, sf_dir)


@query(
    "page_frontmatter",
    f"""{FACTS} {DONE} SELECT path, section, name, type, title, description,
      CASE WHEN section = 'entities' THEN 2 ELSE 0 END AS n_tags,
      CASE WHEN NOT sourced THEN 0 WHEN k % 11 = 0 THEN 2 ELSE 1 END AS n_sources,
      CASE section WHEN 'entities' THEN 'agent/1.0' WHEN 'sources' THEN 'human:ana' END AS written_by, written,
      CASE WHEN section = 'entities' THEN CASE k % 4 WHEN 1 THEN 'process:x,human:ana' WHEN 2 THEN 'process:nightly' WHEN 3 THEN 'human:bob' ELSE '' END ELSE '' END AS verified_by
    FROM p""",
)
def frontmatter(spark, sf_dir):
    from tessera.functions.temporal import parse_timestamp

    return corpus.concept_pages(parsed(spark, sf_dir)).select(
        "path", "section", "name", "type", "title", "description", F.size("tags").alias("n_tags"),
        F.size("sources").alias("n_sources"), F.col("generated.by").alias("written_by"),
        parse_timestamp(F.col("generated.at")).alias("written"), F.array_join("verified.by", ",").alias("verified_by"),
    )


@query("page_unknown_keys", f"{FACTS} {DONE} SELECT {_PAGE} AS path, 'owner' AS key, 'team-' || (k % 3) AS value FROM c WHERE k % 5 = 0")
def unknown(spark, sf_dir):
    return corpus.unknown_keys(parsed(spark, sf_dir))


@query(
    "page_search",
    f"""{FACTS} {DONE} SELECT path, hits FROM (SELECT path, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN title IS NULL THEN 0 ELSE 1 END AS hits
    FROM p WHERE k IS NOT NULL) x WHERE hits > 0 ORDER BY hits DESC, path LIMIT 20""",
)
def search(spark, sf_dir):
    return corpus.page_search(parsed(spark, sf_dir), "Client")


@query(
    "index_guided_lookup",
    f"""{FACTS} {DONE} SELECT p.path, entries.title AS entry, p.title FROM entries JOIN p ON p.path = dir || target
    WHERE contains(lower(entries.title || ' ' || entries.description), 'building')""",
)
def lookup(spark, sf_dir):
    entries = corpus.index_lines(pages(spark, sf_dir))
    return corpus.index_guided_lookup(entries, parsed(spark, sf_dir), "building").select("path", "entry", "title")


@query("section_counts", f"{FACTS} {DONE} SELECT section, type, count(*) AS n_pages FROM p GROUP BY ALL")
def sections(spark, sf_dir):
    return corpus.section_counts(parsed(spark, sf_dir))


@query(
    "trust_tier",
    f"""{FACTS} {DONE} SELECT path, section, CASE k % 4 WHEN 1 THEN 'human-reviewed' WHEN 2 THEN 'machine-confirmed'
    WHEN 3 THEN 'human-reviewed' ELSE 'unverified' END AS tier FROM p""",
)
def tiers(spark, sf_dir):
    return corpus.trust_tier(parsed(spark, sf_dir))


ACTORS = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'human:' || c_name WHEN 1 THEN 'process:' || c_mktsegment
  WHEN 2 THEN 'agent/' || cast(c_custkey AS varchar(20)) WHEN 3 THEN 'team:docs' WHEN 4 THEN c_name ELSE NULL END AS actor FROM customer"""


@query(
    "actor_class",
    f"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'human' WHEN 1 THEN 'process' WHEN 2 THEN 'agent' WHEN 5 THEN NULL ELSE 'other' END AS class
    FROM ({ACTORS}) a""",
)
def actors(spark, sf_dir):
    return run(spark, sf_dir, ACTORS).select("c_custkey", corpus.actor_class(F.col("actor")).alias("class"))


@query(
    "credibility_signals",
    f"""{FACTS} {DONE} SELECT path, CASE WHEN sourced THEN 1 ELSE 0 END AS n_sources, CASE WHEN sourced THEN 1 ELSE 0 END AS n_authors,
    CASE WHEN sourced THEN k END AS usage_count, CASE WHEN sourced THEN TIMESTAMP '2024-01-10 00:00:00' + to_months(cast(k % 9 AS integer)) END AS newest FROM p""",
)
def credibility(spark, sf_dir):
    return corpus.credibility_signals(parsed(spark, sf_dir))


@query(
    "lineage_closure",
    f"""{FACTS} up AS (SELECT k AS child, cast(floor(k / 3) AS bigint) AS ancestor, 1 AS depth FROM c WHERE k % 7 <> 0
      UNION ALL SELECT up.child, cast(floor(up.ancestor / 3) AS bigint), up.depth + 1 FROM up WHERE up.ancestor % 7 <> 0)
    SELECT 'wiki/entities/Customer_' || child || '.md' AS path, 'wiki/entities/Customer_' || ancestor || '.md' AS ancestor, min(depth) AS depth
    FROM up GROUP BY ALL""",
)
def ancestors(spark, sf_dir):
    return links.lineage(parsed(spark, sf_dir))


@query(
    "index_build",
    f"""{FACTS} {DONE} SELECT regexp_extract(path, '^(.*/)', 1) AS dir, coalesce(type, '') AS heading, coalesce(title, name) AS title,
    '* [' || coalesce(title, name) || '](' || name || '.md)' || CASE WHEN description IS NULL THEN '' ELSE ' - ' || description END AS line FROM p""",
)
def build_index(spark, sf_dir):
    return corpus.index_build(parsed(spark, sf_dir))


LOG_ENTRIES = "SELECT event_type AS dir, cast(ts AS date) AS date, event_id AS pos, 'user ' || cast(user_id AS varchar(20)) AS text FROM events"


@query(
    "log_build",
    f"""WITH l AS ({LOG_ENTRIES}) SELECT dir, date, pos, '* ' || text AS line FROM l
    UNION ALL SELECT DISTINCT dir, date, cast(-1 AS bigint), '## ' || strftime(date, '%Y-%m-%d') FROM l""",
)
def build_log(spark, sf_dir):
    return corpus.log_build(run(spark, sf_dir, LOG_ENTRIES))


CPF = "lpad(cast(c_custkey * 7919 + 12345 AS varchar(20)), 11, '0')"
#: Two sources and a page for every customer; some of them disagree.
REGISTER = f"SELECT c_custkey AS _row, {CPF} AS cpf, c_mktsegment AS segmento, cast(c_nationkey AS varchar(9)) AS pais, substr(cast(date '2024-01-01' AS varchar(10)), 1, 10) AS desde FROM customer"
BRANCH = f"""SELECT c_custkey AS _row, substr({CPF}, 1, 3) || '.' || substr({CPF}, 4, 3) || '.' || substr({CPF}, 7, 3) || '-' || substr({CPF}, 10, 2) AS "CPF do cliente",
  CASE WHEN c_custkey % 6 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS "Segmento", '01/01/202' || cast(4 + c_custkey % 2 AS varchar(1)) AS "Desde" FROM customer"""
CUSTOMER_PAGE = f"""SELECT 'wiki/entities/C' || {K} || '.md' AS path, '---' || {NL} || 'type: Entity' || {NL} || 'CPF: ' || substr({CPF}, 1, 9) || '-' || substr({CPF}, 10, 2) || {NL}
  || 'pais: ' || cast(CASE WHEN c_custkey % 9 = 0 THEN 99 ELSE c_nationkey END AS varchar(9)) || {NL} || 'segmento: ' || c_mktsegment || {NL} || '---' || {NL} || 'x' AS body FROM customer"""


@query(
    "lint_contradictions",
    f"""WITH f AS (SELECT {CPF} AS entity, 'segmento' AS key, c_mktsegment AS value, 'register__clientes' AS source FROM customer
      UNION ALL SELECT {CPF}, 'segmento', CASE WHEN c_custkey % 6 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END, 'branch__clientes' FROM customer
      UNION ALL SELECT {CPF}, 'segmento', c_mktsegment, 'wiki/entities/C' || c_custkey || '.md' FROM customer
      UNION ALL SELECT {CPF}, 'pais', cast(c_nationkey AS varchar), 'register__clientes' FROM customer
      UNION ALL SELECT {CPF}, 'pais', cast(CASE WHEN c_custkey % 9 = 0 THEN 99 ELSE c_nationkey END AS varchar), 'wiki/entities/C' || c_custkey || '.md' FROM customer
      UNION ALL SELECT {CPF}, 'desde', '2024-01-01', 'register__clientes' FROM customer
      UNION ALL SELECT {CPF}, 'desde', '202' || (4 + c_custkey % 2) || '-01-01', 'branch__clientes' FROM customer),
    v AS (SELECT entity, key, value, count(*) AS n, min(source) AS source FROM f GROUP BY ALL)
    SELECT entity, key, count(*) AS n_values, cast(sum(n) AS bigint) AS n_claims, min(value) AS first_value, max(value) AS last_value,
      arg_min(source, value) AS first_source, arg_max(source, value) AS last_source FROM v GROUP BY ALL HAVING count(*) > 1""",
)
def contradictions(spark, sf_dir):
    """What two stored sources and the pages say of one document number."""
    root = scratch(spark, "store")
    facts = links.page_facts(corpus.page_frontmatter(run(spark, sf_dir, CUSTOMER_PAGE)), "CPF", "cpf")
    for source, sql, entity in (("register", REGISTER, "cpf"), ("branch", BRANCH.replace('"', "`"), "cpf_do_cliente")):
        store.persist_source(spark, root, source, f"raw/{source}.csv", f"wiki/sources/{source}.md", [store.Dataset("clientes", run(spark, sf_dir, sql))], checksum=source)
        facts = facts.unionByName(links.table_facts(store.table(spark, root, f"{source}__clientes"), entity, "cpf", f"{source}__clientes"))
    return links.contradictions(facts)


_RATES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, (count(*) - count({c})) / cast(count(*) AS double) AS null_rate FROM m"
    for c in MESSY_COLUMNS
)


@query("lint_null_rates", f"WITH m AS ({ORACLE_MESSY}) {_RATES}")
def rates(spark, sf_dir):
    return links.null_rates(messy_orders(spark, sf_dir).select(*MESSY_COLUMNS))
