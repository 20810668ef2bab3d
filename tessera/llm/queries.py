"""The registered queries of the training-data operators, over whole tables."""
from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm.chat import format_chats
from tessera.llm.decontaminate import decontaminate
from tessera.llm.filter_audit import filter_audit
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.line_dedup import summary as line_summary
from tessera.llm.line_quality import line_quality
from tessera.llm.passages import summary as passage_summary
from tessera.llm.quality import quality
from tessera.llm.sentencepieces import round_trip
from tessera.llm.simhash import near_duplicates
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import toxicity
from tessera.llm.url_filter import judge

#: The file every executor finds under the same path.
MODEL = public_tokenizers.path("piece_bpe_32k.model")

QUERIES, ORACLES = {}, {}


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(function=None, *, sql: str | None = None):
    if function is None:
        return partial(registered, sql=sql)
    QUERIES[function.__name__] = function
    if sql is not None:
        ORACLES[function.__name__] = sql
    return function


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"[x for x in regexp_split_to_array({LOWERED}, '[\\x20\\x09-\\x0D]+') if x <> '']"
SHINGLES = "[array_to_string(w[p:p + k - 1], ' ') for p in range(1, len(w) - k + 2)]"

#: Every window that shares a shingle with an item of its size, without fingerprints.
LEAK_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT DISTINCT item_id, {WORDS} AS w FROM benchmark),
sized AS (SELECT *, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
item AS (SELECT item_id, len(w) AS n, k, len(w) - k + 1 AS m, unnest({SHINGLES}) AS s FROM sized),
bag AS (SELECT item_id, n, k, m, s, count(*) AS c FROM item GROUP BY ALL),
place AS (SELECT doc_id, len(w) AS size, k, unnest(range(len(w) - k + 1)) AS pos, unnest({SHINGLES}) AS s
  FROM d JOIN (SELECT DISTINCT k FROM sized) ON len(w) >= k),
hit AS (SELECT DISTINCT doc_id, item_id, n, k, m, size, pos, least(n, size) - k + 1 AS mw FROM place JOIN bag USING (s, k)),
win AS (SELECT DISTINCT doc_id, item_id, k, m, mw, unnest(range(greatest(0, pos - mw + 1), least(pos, greatest(size - n, 0)) + 1)) AS start FROM hit),
held AS (SELECT win.*, s, count(*) AS c FROM win JOIN place USING (doc_id, k) WHERE pos BETWEEN start AND start + mw - 1 GROUP BY ALL),
common AS (SELECT doc_id, item_id, start, held.m + mw AS total, sum(least(held.c, bag.c)) AS c FROM held JOIN bag USING (item_id, s) GROUP BY ALL),
good AS (SELECT doc_id, item_id, start, c / (total - c) AS similarity FROM common WHERE c / (total - c) >= 0.8)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(-max((similarity, -start))[2] AS INTEGER) AS start, count(*) AS n_windows
FROM good GROUP BY ALL
"""


@registered(sql=LEAK_SQL)
def op1_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered
def op2_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), MODEL)


@registered
def op3_line_dedup(spark, sf_dir):
    return line_summary(table(spark, sf_dir, "documents"))


URL_SQL = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(v, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
  FROM p JOIN rules ON ends_with('.' || host, '.' || h) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches('.' || host || CASE WHEN path = '' THEN '/' ELSE path END,
  '^[^/]*[.](adult-|casino-|spam-|cheap-|free-bets|ads-)[^/]*/') OR contains('.' || host || path, '/wp-login') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""


@registered(sql=URL_SQL)
def op4_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


@registered
def op5_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@registered
def op6_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op7_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op8_sentencepiece(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), MODEL)


#: The turns of the table hold no JSON: users call ``reply``, assistants answer the turn before.
CHAT_SQL = """
WITH e AS (
  SELECT conv_id, turn, role, text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN concat(conv_id, ':', turn) WHEN 'assistant' THEN concat(conv_id, ':', turn - 1) END AS call_id
  FROM conversations
), s AS (
  SELECT e.*,
    CASE kind WHEN 'message' THEN 'message'
      WHEN 'call' THEN CASE WHEN EXISTS (SELECT 1 FROM e o WHERE o.call_id = e.call_id AND o.kind = 'result') THEN 'answered' ELSE 'open' END
      ELSE CASE WHEN EXISTS (SELECT 1 FROM e o WHERE o.call_id = e.call_id AND o.kind = 'call') THEN 'linked' ELSE 'orphan' END END AS status
  FROM e
)
SELECT conv_id, turn AS at, 0 AS depth, turn, 0 AS seq, kind, call_id, status,
  CASE WHEN kind = 'call' AND coalesce(text, '') = '' THEN 1 ELSE 0 END AS n_errors,
  concat('{',
    CASE WHEN kind = 'call' THEN concat('"arguments":{', CASE WHEN text IS NOT NULL THEN concat('"prompt":', CAST(to_json(text) AS VARCHAR), ',') ELSE '' END, '"turn":', turn, '},') ELSE '' END,
    CASE WHEN call_id IS NOT NULL THEN concat('"call_id":"', call_id, '",') ELSE '' END,
    CASE WHEN kind <> 'call' AND text IS NOT NULL THEN concat('"content":', CAST(to_json(text) AS VARCHAR), ',') ELSE '' END,
    '"conv_id":', conv_id, ',',
    CASE WHEN kind = 'call' AND text IS NULL THEN '"errors":["missing prompt"],' WHEN kind = 'call' AND text = '' THEN '"errors":["small prompt"],' ELSE '' END,
    '"kind":"', kind, '",',
    CASE WHEN kind = 'call' THEN '"name":"reply",' ELSE '' END,
    '"role":"', role, '","status":"', status, '","turn":', turn, '}') AS line
FROM s
"""


@registered(sql=CHAT_SQL)
def op9_chat_format(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


@registered
def op10_suffix_dedup(spark, sf_dir):
    return passage_summary(table(spark, sf_dir, "documents"))


#: Every order walked filter by filter over cells of equal failures.
AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
  [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY ALL),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {
  'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
  'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
  'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, fails[filter_order[step]] AS now,
  list_bool_or([false] || [fails[x] for x in string_split(filter_order[1:step - 1], '') if x <> '']) AS before,
  list_bool_or([fails[x] for x in ['A', 'B', 'C', 'D', 'E'] if x <> filter_order[step]]) AS others FROM c, s),
g AS (SELECT part, filter_order, step, letter,
  CAST(sum(CASE WHEN NOT now AND NOT before THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN now AND NOT before THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN now AND before THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN now AND NOT others THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN now AND NOT before THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN now AND NOT before THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
"""


@registered(sql=AUDIT_SQL)
def op11_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op12_quality_classifier(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


NEGATIVES_SQL = """
WITH r AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@registered(sql=NEGATIVES_SQL)
def op13_hard_negatives(spark, sf_dir):
    id_, label = F.col("vec_id"), F.col("label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & finite).select(
        id_.alias("id"),
        F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"),
    )
    return hard_negatives(rows, F.col("id") % 50 == 0)
