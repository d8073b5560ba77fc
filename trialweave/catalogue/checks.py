"""Outliers, units, rules across forms, p-values and gates that rest on gates."""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import constants as K
from ..functions.pvalues import chi_square_p as chi_p, normal_p
from ..operators import checks as C, gates as G, stats as T
from ..operators.lineage import use_checkpoint_dir
from ..sources.blocks import read_blocks
from . import shapes as S
from .registry import QUERIES, query, table

CONVERSIONS = [("kg", "g", 1000.0, 0.0), ("g", "mg", 1000.0, 0.0), ("t", "kg", 1000.0, 0.0)]


def _masses(spark, sf):
    """Order totals as masses: most in kg, some in other units, some with the wrong or no unit."""
    k, w = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    on = S.every
    mass = (F.when(on("o_orderkey", 50) | on("o_orderkey", 83), S.text(w)).when(on("o_orderkey", 41), S.text(w * 1000))
            .when(on("o_orderkey", 13), "-999")
            .otherwise(F.concat(S.text(F.floor(w / 1000)), F.lit("."), F.lpad(S.text(w % 1000), 3, "0"))))
    unit = (F.when(on("o_orderkey", 50), "g").when(on("o_orderkey", 83), "kg").when(on("o_orderkey", 41), "mg")
            .when(on("o_orderkey", 19), "").when(on("o_orderkey", 31), "qq").otherwise("kg"))
    rows = table(spark, sf, "orders").select(
        S.text(k).alias("record_id"), F.when(on("o_custkey", 9), "").otherwise(F.substring("o_orderpriority", 3, 20))
        .alias(K.SITE_FIELD), mass.alias("mass"), unit.alias("unit"))
    values = C.field_values(rows, ["mass"], "record_id")
    return values.join(rows.select("record_id", "unit"), "record_id")


def _paths(spark):
    return C.unit_paths(spark.createDataFrame(CONVERSIONS, "from_unit string, to_unit string, factor double, offset double"))


_MASS_SQL = """o AS (SELECT *, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders),
raw AS (SELECT CAST(k AS VARCHAR) AS record_id,
    CASE WHEN o_custkey % 9 = 0 THEN '' ELSE substr(o_orderpriority, 3) END AS site,
    CASE WHEN k % 50 = 0 OR k % 83 = 0 THEN CAST(w AS VARCHAR) WHEN k % 41 = 0 THEN CAST(w * 1000 AS VARCHAR)
         WHEN k % 13 = 0 THEN '-999' ELSE (w // 1000) || '.' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') END AS mass,
    CASE WHEN k % 50 = 0 THEN 'g' WHEN k % 83 = 0 THEN 'kg' WHEN k % 41 = 0 THEN 'mg' WHEN k % 19 = 0 THEN ''
         WHEN k % 31 = 0 THEN 'qq' ELSE 'kg' END AS unit FROM o),
u(from_unit, f) AS (VALUES ('kg', 1.0::DOUBLE), ('g', 1 / 1000.0::DOUBLE),
    ('mg', (1 / 1000.0::DOUBLE) * (1 / 1000.0::DOUBLE)), ('t', 1000.0::DOUBLE)),
v AS (SELECT record_id, site, 'mass' AS field, CAST(mass AS DOUBLE) AS value, unit FROM raw WHERE mass <> '-999'),
h AS (SELECT v.*, CASE WHEN unit = '' THEN value ELSE value * f END AS standard,
    CASE WHEN unit = '' THEN 'no_unit' WHEN unit = 'kg' THEN 'same' WHEN f IS NULL THEN 'unknown_unit'
         ELSE 'converted' END AS status FROM v LEFT JOIN u ON unit = from_unit),
m AS (SELECT site, field, median(standard) AS med FROM h WHERE standard IS NOT NULL GROUP BY site, field),
d AS (SELECT site, field, any_value(med) AS med, count(*) AS n, median(abs(standard - med)) AS mad
      FROM h JOIN m USING (site, field) WHERE standard IS NOT NULL GROUP BY site, field),
l AS (SELECT *, med - mad * (1.4826 * 3.5) AS low, med + mad * (1.4826 * 3.5) AS high FROM d)"""


def _harmonised(spark, sf):
    return C.harmonised(_masses(spark, sf), _paths(spark), {"mass": "kg"})


def _standard(rows):
    return rows.where("standard is not null").select("record_id", "site", "field", F.col("standard").alias("value"))


@query(f"""WITH {_MASS_SQL} SELECT record_id, site, field, value, unit, round(standard, 6) AS standard, status FROM h""")
def harmonised_values(spark, sf):
    return _harmonised(spark, sf).select("record_id", "site", "field", "value", "unit",
                                         F.round("standard", 6).alias("standard"), "status")


@query(f"""WITH {_MASS_SQL} SELECT site, field, n, round(med, 6) AS median, round(mad, 6) AS mad,
  round(low, 6) AS low, round(high, 6) AS high FROM l""")
def outlier_limits(spark, sf):
    found = C.exact_limits(_standard(_harmonised(spark, sf)))
    return found.select("site", "field", "n", *(F.round(c, 6).alias(c) for c in ("median", "mad", "low", "high")))


@query(f"""WITH {_MASS_SQL} SELECT record_id, h.site, h.field, round(standard, 6) AS value, round(med, 6) AS median,
  round(mad, 6) AS mad, CASE WHEN standard < low THEN 'low' ELSE 'high' END AS side
FROM h JOIN l USING (site, field) WHERE mad > 0 AND (standard < low OR standard > high)""")
def outlier_cells(spark, sf):
    values = _standard(_harmonised(spark, sf))
    found = C.outlier_cells(values, C.exact_limits(values))
    return found.select("record_id", "site", "field", *(F.round(c, 6).alias(c) for c in ("value", "median", "mad")), "side")


@query(f"""WITH {_MASS_SQL},
r AS (SELECT record_id, h.site, h.field, value, unit, from_unit, abs(value * f - med) AS far
  FROM h JOIN l USING (site, field), u WHERE mad > 0 AND (standard < low OR standard > high)
  AND from_unit <> unit AND value * f BETWEEN low AND high)
SELECT record_id, site, field, value, unit, from_unit AS likely_unit FROM r
QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY far, from_unit) = 1""")
def unit_mismatches(spark, sf):
    rows = _harmonised(spark, sf)
    return C.unit_mismatches(rows, C.exact_limits(_standard(rows)), _paths(spark))


RULES = [C.CrossRule("shipped_after_order", "follow.shipped", ">=", "intake.ordered", "date"),
         C.CrossRule("total_covers_dearest", "intake.total", ">=", "follow.dearest", slack=-500),
         C.CrossRule("few_lines", "follow.lines", "<=", "intake.most_lines", severity="warn")]


@query("""WITH i0 AS (SELECT o_orderkey AS k, strftime(CASE WHEN o_orderkey % 37 = 0 THEN o_orderdate + INTERVAL 400 DAY
      ELSE o_orderdate END, '%Y-%m-%d') AS ordered, CAST(floor(o_totalprice) AS BIGINT) AS total,
      CASE WHEN o_orderkey % 11 = 0 THEN '-888' ELSE '6' END AS most_lines FROM orders WHERE o_orderkey % 53 <> 0),
i AS (SELECT *, CASE WHEN k % 47 = 0 THEN 2 ELSE 1 END AS n FROM i0),
f AS (SELECT l_orderkey AS k, strftime(min(l_shipdate), '%Y-%m-%d') AS shipped,
      CAST(max(floor(l_extendedprice)) AS BIGINT) AS dearest, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
j AS (SELECT CAST(coalesce(i.k, f.k) AS VARCHAR) AS record_id, i.k AS ik, f.k AS fk, * FROM i FULL JOIN f ON i.k = f.k)
SELECT record_id, 'shipped_after_order' AS rule, 'error' AS severity, shipped || ' >= ' || ordered AS message
FROM j WHERE CAST(shipped AS DATE) < CAST(ordered AS DATE)
UNION ALL SELECT record_id, 'total_covers_dearest', 'error', total || ' >= ' || dearest FROM j WHERE total < dearest - 500
UNION ALL SELECT record_id, 'few_lines', 'warn', lines || ' <= ' || most_lines FROM j
  WHERE most_lines <> '-888' AND lines > CAST(most_lines AS BIGINT)
UNION ALL SELECT record_id, 'missing_form', 'warn', 'intake' FROM j WHERE ik IS NULL
UNION ALL SELECT record_id, 'missing_form', 'warn', 'follow' FROM j WHERE fk IS NULL
UNION ALL SELECT record_id, 'repeated_form', 'warn', 'intake' FROM j WHERE n = 2""")
def cross_form_findings(spark, sf):
    """Orders as an intake form, some absent or entered twice, and their lines as a follow-up form."""
    k = "o_orderkey"
    day = F.when(S.every(k, 37), F.date_add(F.col("o_orderdate").cast("date"), 400)).otherwise(F.col("o_orderdate").cast("date"))
    intake = table(spark, sf, "orders").where(~S.every(k, 53)).select(
        S.text(k).alias("record_id"), F.date_format(day, "yyyy-MM-dd").alias("ordered"),
        S.text(F.floor("o_totalprice")).alias("total"), F.when(S.every(k, 11), "-888").otherwise("6").alias("most_lines"),
        F.explode(F.when(S.every(k, 47), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")).drop("time")
    follow = table(spark, sf, "lineitem").groupBy(S.text("l_orderkey").alias("record_id")).agg(
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("shipped"),
        S.text(F.max(F.floor("l_extendedprice"))).alias("dearest"), S.text(F.count("*")).alias("lines"))
    return C.cross_form_findings(C.side_by_side({"intake": intake, "follow": follow}, "record_id"), RULES)


@query(f"""WITH {S.STUDY_SQL}, t AS (SELECT status AS r, priority AS c FROM study WHERE status <> '' AND priority NOT IN ('', '-999')),
rt AS (SELECT r, count(*) AS n FROM t GROUP BY r), ct AS (SELECT c, count(*) AS n FROM t GROUP BY c),
e AS (SELECT r, c, rt.n * ct.n / (SELECT count(*) FROM t)::DOUBLE AS e FROM rt, ct),
o AS (SELECT r, c, count(*) AS o FROM t GROUP BY r, c),
s AS (SELECT sum((coalesce(o, 0) - e) ** 2 / e) / 2 AS x, ((SELECT count(*) FROM rt) - 1) * ((SELECT count(*) FROM ct) - 1) AS dof
      FROM e LEFT JOIN o USING (r, c))
SELECT dof, round(exp(-x) * list_sum([x ** i / gamma(i + 1) for i in range(0, dof // 2)]), 6) AS p FROM s""")
def chi_square_p(spark, sf):
    """The degrees of freedom are even here, where the tail is a finite sum."""
    found = T.chi_square(S.study(spark, sf), "status", "priority")
    return found.select("dof", F.round(chi_p(F.col("chi2"), F.col("dof")), 6).alias("p"))


_MANN_WHITNEY = QUERIES["mann_whitney"]


@query(f"""WITH {S.STUDY_SQL},
two AS (SELECT status, TRY_CAST(price AS DOUBLE) AS x FROM study WHERE status IN ('F', 'O') AND TRY_CAST(price AS DOUBLE) IS NOT NULL),
w AS (SELECT x, count(*) AS t, count(*) FILTER (status = 'F') AS t1 FROM two GROUP BY x),
r AS (SELECT *, sum(t) OVER (ORDER BY x) - (t - 1) / 2.0 AS rank FROM w),
s AS (SELECT sum(t1 * rank) AS r1, sum(t1)::DOUBLE AS a, sum(t)::DOUBLE - sum(t1)::DOUBLE AS b, sum(t::DOUBLE * t * t - t) AS ties FROM r),
z AS (SELECT abs(r1 - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) / sqrt(2) AS y FROM s)
SELECT round(1 - 2 / sqrt(pi()) * list_sum([(-1) ** i * y ** (2 * i + 1) / (gamma(i + 1) * (2 * i + 1)) for i in range(0, 100)]), 6) AS p
FROM z""")
def mann_whitney_p(spark, sf):
    return _MANN_WHITNEY(spark, sf).select(F.round(normal_p(F.col("z")), 6).alias("p"))


def _gated(spark, sf):
    """Parts as fields, brands and sizes as projects: each field's logic names the one before it, every
    seventh the one before that too, and the first of some projects names the last."""
    rows = table(spark, sf, "part").select(F.concat_ws("-", "p_brand", S.text("p_size")).alias("project_id"), "p_partkey", "p_size")
    order = Window.partitionBy("project_id").orderBy("p_partkey")
    last = F.max("p_partkey").over(Window.partitionBy("project_id"))
    name = lambda c: F.concat(F.lit("f"), S.text(c))
    one, two = F.lag("p_partkey", 1).over(order), F.lag("p_partkey", 2).over(order)
    logic = (F.when(one.isNull() & (F.col("p_size") % 5 == 0), F.concat(F.lit("["), name(last), F.lit("] <> ''")))
             .when(one.isNull(), F.lit("[nobody] = '1'"))
             .when(S.every("p_partkey", 7) & two.isNotNull(), F.concat(
                 F.lit("["), name(one), F.lit("(2)] = '1' and ["), name(two), F.lit("] > 3")))
             .otherwise(F.concat(F.lit("["), name(one), F.lit("] = '1'"))))
    return rows.select("project_id", name("p_partkey").alias("field_name"), logic.alias("branching_logic"))


_GATES_SQL = """p AS (SELECT p_brand || '-' || p_size AS project_id, p_partkey AS k, p_size AS s,
    lag(p_partkey, 1) OVER w AS one, lag(p_partkey, 2) OVER w AS two, max(p_partkey) OVER (PARTITION BY p_brand, p_size) AS last
  FROM part WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_partkey)),
e AS (SELECT project_id, k, one AS g FROM p WHERE one IS NOT NULL
  UNION SELECT project_id, k, two FROM p WHERE two IS NOT NULL AND k % 7 = 0
  UNION SELECT project_id, k, last FROM p WHERE one IS NULL AND s % 5 = 0),
c AS (SELECT project_id, k, g, 1 AS depth FROM e
  UNION SELECT c.project_id, c.k, e.g, depth + 1 FROM c JOIN e ON e.project_id = c.project_id AND e.k = c.g
  WHERE depth < (SELECT count(*) FROM p WHERE p.project_id = c.project_id)),
closed AS (SELECT project_id, k, g, min(depth) AS depth FROM c GROUP BY project_id, k, g)"""


@query(f"""WITH RECURSIVE {_GATES_SQL} SELECT project_id, 'f' || k AS field, 'f' || g AS gate, depth FROM closed""")
def gate_closure(spark, sf):
    return G.gate_closure(G.gate_edges(_gated(spark, sf)))


@query(f"""WITH RECURSIVE {_GATES_SQL} SELECT a.project_id, 'f' || a.k AS field, min('f' || a.g) AS cycle,
  min(a.depth) FILTER (a.k = a.g) AS length FROM closed a JOIN closed b
  ON a.project_id = b.project_id AND a.k = b.g AND a.g = b.k GROUP BY a.project_id, a.k""")
def logic_cycles(spark, sf):
    return G.logic_cycles(G.gate_closure(G.gate_edges(_gated(spark, sf)), folded=True))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS lang,
  coalesce(source, '') AS source FROM documents""")
def export_blocks(spark, sf):
    """Documents written as an export with line breaks in cells, and read back block by block."""
    folder = f"{use_checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    table(spark, sf, "documents").select("doc_id", "text", "lang", "source").write.options(
        header="true", quoteAll="true", escape='"', emptyValue="", ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false").csv(folder)
    rows = read_blocks(spark, folder)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")
