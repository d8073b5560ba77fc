"""Linkage of customers, orders, events and suppliers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import title_match
from ..operators import linkage as L
from ..operators import matching as M
from . import shapes as S
from .registry import query, table


def _registry(spark, sf):
    return L.Source("registry", table(spark, sf, "customer"), ["c_custkey"], ["c_mktsegment"])


def _visits(spark, sf):
    """Orders by customer; every seventh has no usable key and some name unknown people."""
    orders = table(spark, sf, "orders")
    key = F.when(S.every("o_orderkey", 7), "").when(
        S.every("o_orderkey", 13), S.text(F.col("o_custkey") + 1000000)).otherwise(
        S.text("o_custkey"))
    return L.Source("visits", orders.select(key.alias("person"), "o_orderstatus", "o_orderkey",
                                            "o_orderpriority"),
                    ["person"], ["o_orderstatus"], "o_orderkey")


def _events(spark, sf):
    return L.Source("events", table(spark, sf, "events"), ["user_id"], ["event_type"], "event_id")


_VISITS_SQL = """visits AS (
  SELECT CASE WHEN o_orderkey % 7 = 0 THEN ''
              WHEN o_orderkey % 13 = 0 THEN CAST(o_custkey + 1000000 AS VARCHAR)
              ELSE CAST(o_custkey AS VARCHAR) END AS person, o_orderkey, o_orderstatus,
         o_orderpriority FROM orders),
by_person AS (SELECT person, count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS status
  FROM visits WHERE person <> '' GROUP BY person),
master AS (
  SELECT coalesce(CAST(c_custkey AS VARCHAR), person) AS person,
    c_custkey IS NOT NULL AS registry_linked, v.person IS NOT NULL AS visits_linked,
    CAST(CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS registry_rows,
    coalesce(n, 0) AS visits_rows, c_mktsegment AS registry_c_mktsegment,
    status AS visits_o_orderstatus
  FROM customer FULL JOIN by_person v ON CAST(c_custkey AS VARCHAR) = v.person)"""


def _master(spark, sf):
    return L.link_master([_registry(spark, sf), _visits(spark, sf)], ["person"])


@query(f"WITH {_VISITS_SQL} SELECT * FROM master")
def link_master(spark, sf):
    return _master(spark, sf)


@query(f"""WITH {_VISITS_SQL}
SELECT registry_linked, visits_linked, count(*) AS entities FROM master GROUP BY ALL""")
def link_overlap(spark, sf):
    return L.overlap(_master(spark, sf), ["registry", "visits"])


@query(f"""WITH {_VISITS_SQL}
SELECT person, 'duplicate' AS issue, 'visits' AS source, visits_rows AS severity FROM master
WHERE visits_rows > 1
UNION ALL SELECT person, 'orphan', 'registry', 1 FROM master WHERE NOT registry_linked
UNION ALL SELECT person, 'orphan', 'visits', 1 FROM master WHERE NOT visits_linked""")
def link_integrity(spark, sf):
    return L.worst_first(L.integrity(_master(spark, sf), ["person"], ["registry", "visits"]),
                         ["person"])


@query(f"""WITH {_VISITS_SQL}
SELECT CAST(c_custkey AS VARCHAR) AS person, 'registry' AS side FROM customer
WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT person FROM visits)
UNION ALL SELECT person, 'visits' FROM visits
WHERE person <> '' AND person NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""")
def link_orphans(spark, sf):
    return L.orphan_rows(_registry(spark, sf), _visits(spark, sf), ["person"])


@query(f"""WITH {_VISITS_SQL} SELECT o_orderkey FROM visits WHERE person = ''""")
def link_missing_key(spark, sf):
    return L.missing_link(_visits(spark, sf), ["person"]).select("o_orderkey")


@query("""WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS person, o_orderpriority AS category,
    count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY ALL),
b AS (SELECT CAST(o_custkey AS VARCHAR) AS person,
    CASE WHEN o_orderstatus = 'F' THEN '1-URGENT' ELSE o_orderpriority END AS category,
    count(*) AS n FROM orders GROUP BY ALL)
SELECT person, category, a.n IS NOT NULL AS slides_linked, b.n IS NOT NULL AS blocks_linked,
  coalesce(a.n, 0) AS slides_rows, coalesce(b.n, 0) AS blocks_rows, status AS slides_o_orderstatus
FROM a FULL JOIN b USING (person, category)""")
def link_composite(spark, sf):
    """Linkage on an id and a category together."""
    orders = table(spark, sf, "orders")
    slides = L.Source("slides", orders, ["o_custkey", "o_orderpriority"], ["o_orderstatus"],
                      "o_orderkey")
    blocks = orders.select("o_custkey", F.when(F.col("o_orderstatus") == "F", "1-URGENT")
                           .otherwise(F.col("o_orderpriority")).alias("category"))
    return L.link_master([slides, L.Source("blocks", blocks, ["o_custkey", "category"])],
                         ["person", "category"])


@query(f"""WITH {_VISITS_SQL},
e AS (SELECT CAST(user_id AS VARCHAR) AS person, count(*) AS n,
             arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id),
s AS (SELECT CAST(s_suppkey AS VARCHAR) AS person, s_name FROM supplier),
keys AS (SELECT person FROM master UNION SELECT person FROM e UNION SELECT person FROM s)
SELECT person, registry_rows > 0 AS registry_linked, visits_rows > 0 AS visits_linked,
  e.n IS NOT NULL AS events_linked, s_name IS NOT NULL AS staff_linked, registry_rows, visits_rows,
  coalesce(e.n, 0) AS events_rows, CAST(CASE WHEN s_name IS NULL THEN 0 ELSE 1 END AS BIGINT)
  AS staff_rows, registry_c_mktsegment, visits_o_orderstatus, e.kind AS events_event_type,
  s_name AS staff_s_name
FROM (SELECT person, coalesce(registry_rows, 0) AS registry_rows,
        coalesce(visits_rows, 0) AS visits_rows, registry_c_mktsegment, visits_o_orderstatus
      FROM keys LEFT JOIN master USING (person)) m
LEFT JOIN e USING (person) LEFT JOIN s USING (person)""")
def link_multiway(spark, sf):
    """Four sources at once."""
    staff = L.Source("staff", table(spark, sf, "supplier"), ["s_suppkey"], ["s_name"])
    return L.link_master([_registry(spark, sf), _visits(spark, sf), _events(spark, sf), staff],
                         ["person"])


def _people(spark, sf):
    """Suppliers as people, and the same people as another source spelt and numbered them."""
    k = "s_suppkey"
    supplier = table(spark, sf, "supplier")
    ward = F.lpad(S.text("s_nationkey"), 4, "0")
    left = supplier.select(
        F.col(k).alias("id"), F.col("s_name").alias("name"),
        F.when(S.every(k, 5), "NYR").otherwise(F.concat(F.lit("00-"), ward)).alias("hospital"))
    right = supplier.select(
        (F.col(k) + 500000).alias("id"),
        F.when(S.every(k, 3), F.replace("s_name", F.lit("Supplier"), F.lit("Suplier")))
        .when(S.every(k, 4), F.concat("s_name", F.lit(" Jr"))).otherwise(F.col("s_name"))
        .alias("name"),
        F.when(S.every(k, 6), "-999").otherwise(ward).alias("hospital"))
    return left, right


_PEOPLE_SQL = """raw_left AS (
  SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'NYR'
    ELSE '00-' || lpad(CAST(s_nationkey AS VARCHAR), 4, '0') END AS hospital FROM supplier),
raw_right AS (
  SELECT s_suppkey + 500000 AS id,
    CASE WHEN s_suppkey % 3 = 0 THEN replace(s_name, 'Supplier', 'Suplier')
         WHEN s_suppkey % 4 = 0 THEN s_name || ' Jr' ELSE s_name END AS name,
    CASE WHEN s_suppkey % 6 = 0 THEN '-999'
         ELSE lpad(CAST(s_nationkey AS VARCHAR), 4, '0') END AS hospital FROM supplier),
keyed AS (
  SELECT side, id,
    list_distinct(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'),
      ' '), lambda x: x <> '')) AS tokens,
    regexp_replace(regexp_replace(lower(hospital), '[^a-z0-9]', '', 'g'), '^0+', '') AS h
  FROM (SELECT 'l' AS side, * FROM raw_left UNION ALL SELECT 'r', * FROM raw_right)),
people AS (
  SELECT side, id, tokens,
    CASE WHEN h IN ('', 'nyr', '666', '777', '888', '999') THEN NULL ELSE h END AS h FROM keyed),
scored AS (
  SELECT l.id, r.id AS candidate_id,
    len(list_filter(l.tokens, lambda x: len(list_filter(r.tokens, lambda y:
      levenshtein(x, y) <= floor(greatest(length(x), length(y)) * 15 / 100))) > 0))
    / greatest(len(l.tokens), len(r.tokens)) AS name_score,
    CASE WHEN l.h IS NULL OR r.h IS NULL THEN 0.5 WHEN l.h = r.h THEN 1.0 ELSE 0.0 END AS hospital
  FROM people l JOIN people r ON l.side = 'l' AND r.side = 'r'),
ranked AS (
  SELECT id, candidate_id, round(name_score, 6) AS name_score,
    round((name_score + hospital) / 2, 6) AS score,
    count(*) OVER (PARTITION BY id, round((name_score + hospital) / 2, 9)) AS ties,
    row_number() OVER (PARTITION BY id ORDER BY (name_score + hospital) / 2 DESC, candidate_id)
      AS rank
  FROM scored WHERE name_score > 0 OR hospital = 1.0)"""


def _rounded(df):
    return df.select("id", "candidate_id", F.round("name_score", 6).alias("name_score"),
                     F.round("score", 6).alias("score"), "ties", "rank")


@query(f"WITH {_PEOPLE_SQL} SELECT * FROM ranked WHERE rank <= 3")
def link_fuzzy_topn(spark, sf):
    left, right = _people(spark, sf)
    return _rounded(M.fuzzy_candidates(left, right, "id", "name", "hospital",
                                       method="levenshtein"))


@query()
def link_fuzzy_sequence(spark, sf):
    """The same with the matching-block ratio, which SQL does not have."""
    left, right = _people(spark, sf)
    return _rounded(M.fuzzy_candidates(left, right, "id", "name", "hospital"))


def _titles(spark, sf):
    """Parts as projects: a few dozen titles, each held by many records."""
    part = table(spark, sf, "part")
    kind = F.lower("p_type")
    existing = part.where(F.col("p_size") <= 25).select(
        F.col("p_partkey").alias("sir_id"),
        F.concat("p_name", F.lit(" study of "), kind).alias("title"))
    incoming = part.where(F.col("p_size") > 25).select(
        F.col("p_partkey").alias("row_id"),
        F.concat(F.initcap("p_name"), F.lit(" study: "), kind, F.lit(" parts")).alias("title"))
    return existing, incoming


@query()
def title_matches(spark, sf):
    """One-to-one title matching; checked against brute force in the tests."""
    existing, incoming = _titles(spark, sf)
    return M.match_titles(existing, incoming, "sir_id", "row_id", "title", "title")


@query("""WITH RECURSIVE existing AS (SELECT p_partkey AS id, trim(regexp_replace(lower(
    p_name || ' study of ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS key FROM part WHERE p_size <= 25),
incoming AS (SELECT p_partkey AS id, trim(regexp_replace(lower(
    p_name || ' study: ' || p_type || ' parts'), '[^a-z0-9]+', ' ', 'g')) AS key
  FROM part WHERE p_size > 25),
l AS (SELECT key, count(*) AS n, row_number() OVER (ORDER BY key) AS i FROM existing GROUP BY key),
r AS (SELECT key, count(*) AS n, row_number() OVER (ORDER BY key) AS j FROM incoming GROUP BY key),
pairs AS (SELECT i, j, l.key AS a, r.key AS b,
    1.0 - levenshtein(l.key, r.key) / greatest(length(l.key), length(r.key)) AS ratio FROM l, r),
sorted AS (SELECT *, row_number() OVER (ORDER BY ratio DESC, md5(a || chr(31) || b), a, b) AS turn
  FROM pairs WHERE ratio >= 0.7),
walk AS (  -- down the sorted pairs, with the records that every title has left
  SELECT CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS quantity,
    (SELECT list(n ORDER BY i) FROM l) AS ls, (SELECT list(n ORDER BY j) FROM r) AS rs
  UNION ALL
  SELECT p.turn, least(ls[i], rs[j]),
    ls[1:i - 1] || [ls[i] - least(ls[i], rs[j])] || ls[i + 1:],
    rs[1:j - 1] || [rs[j] - least(ls[i], rs[j])] || rs[j + 1:]
  FROM walk JOIN sorted p ON p.turn = walk.turn + 1),
taken AS (SELECT a, b, ratio, quantity,
    sum(quantity) OVER (PARTITION BY a ORDER BY turn) - quantity AS before_a,
    sum(quantity) OVER (PARTITION BY b ORDER BY turn) - quantity AS before_b
  FROM walk JOIN sorted USING (turn) WHERE quantity > 0),
ls AS (SELECT id, key, row_number() OVER (PARTITION BY key ORDER BY id) AS k FROM existing),
rs AS (SELECT id, key, row_number() OVER (PARTITION BY key ORDER BY id) AS k FROM incoming)
SELECT ls.id AS sir_id, rs.id AS row_id, ratio
FROM taken JOIN ls ON ls.key = a AND ls.k > before_a AND ls.k <= before_a + quantity
  JOIN rs ON rs.key = b AND rs.k - before_b = ls.k - before_a""")
def title_matches_edit(spark, sf):
    """The same by edit distance, in three bands of the ratio."""
    existing, incoming = _titles(spark, sf)
    return M.match_titles(existing, incoming, "sir_id", "row_id", "title", "title", min_ratio=0.7,
                          method="levenshtein", bands=(0.9, 0.8)).select(
        F.col("left_id").alias("sir_id"), F.col("right_id").alias("row_id"), "ratio")


@query("""SELECT c_custkey, s_suppkey, CASE WHEN c_custkey IS NULL THEN 'create'
  WHEN s_suppkey IS NULL THEN 'sir-only' ELSE 'update' END AS kind
FROM customer FULL JOIN (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey + 5 END
  AS m FROM supplier) s ON c_custkey = m""")
def master_merge(spark, sf):
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    matches = supplier.select(
        F.when(~S.every("s_suppkey", 3), F.col("s_suppkey") + 5).alias("left_id"),
        F.col("s_suppkey").alias("right_id"))
    return M.merge_master(customer, supplier, matches, "c_custkey", "s_suppkey")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END,
    CASE WHEN o_custkey % 4 = 0 THEN 1000000000000000000 ELSE o_custkey END, o_orderkey)
  AS target_id FROM orders""")
def target_numbers(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
        .otherwise(2).alias("bucket"),
        F.when(S.every("o_custkey", 4), "").otherwise(S.text("o_custkey")).alias("pid"))
    return M.number_targets(orders, "bucket", "pid", ["o_orderkey"]).select(
        "o_orderkey", "target_id")


@query("""SELECT event_id, user_id, rn > 1 AS renumbered,
  CASE WHEN rn = 1 THEN user_id
       ELSE (SELECT max(user_id) FROM events)
            + row_number() OVER (PARTITION BY rn > 1 ORDER BY event_id) END AS new_id
FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
      FROM events)""")
def renumber_duplicates(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return M.renumber_duplicates(events, "user_id", ["event_id"])


@query("""WITH t AS (SELECT p_partkey, p_name, p_brand,
  trim(regexp_replace(lower(p_name || ': ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS title_key
  FROM part),
r AS (SELECT title_key, count(*) AS records FROM t GROUP BY title_key HAVING count(*) > 1)
SELECT p_partkey, title_key, records, 'warn' AS severity FROM t JOIN r USING (title_key)""")
def same_titles(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit(": "), "p_brand").alias("title"))
    return M.same_title(part, "title").drop("title")


@query("""SELECT doc_id, CASE WHEN w = g THEN 'exact' WHEN w <> '' AND contains(g, w)
  THEN 'contains' ELSE 'mismatch' END AS mode
FROM (SELECT doc_id, trim(regexp_replace(lower(lang || '-' || source), '[^a-z0-9]+', ' ', 'g')) AS w,
  trim(regexp_replace(lower(CASE WHEN n_chars % 2 = 0 THEN lang || '  ' || source
    ELSE lang || ' ' || source || '0' END), '[^a-z0-9]+', ' ', 'g')) AS g FROM documents)""")
def title_modes(spark, sf):
    docs = table(spark, sf, "documents")
    want = F.concat("lang", F.lit("-"), "source")
    got = F.when(S.every("n_chars", 2), F.concat("lang", F.lit("  "), "source")).otherwise(
        F.concat("lang", F.lit(" "), "source", F.lit("0")))
    return docs.select("doc_id", title_match(want, got).alias("mode"))
