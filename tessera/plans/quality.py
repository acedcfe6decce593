"""Queries for data quality and dimensional models; defects are derived from the clean tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import dimensional, quality
from tessera.sources.tables import table

from .inputs import DAYS, days

_DIRTY = "dirty AS (SELECT nullif(c_custkey % 700, 0) AS k, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal AS bal, c_nationkey + (CASE WHEN c_custkey % 50 = 0 THEN 100 ELSE 0 END) AS nation FROM customer)"


def _dirty(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("nullif(c_custkey % 700, 0) as k", "case when c_custkey % 11 = 0 then null else c_mktsegment end as segment", "c_acctbal as bal", "c_nationkey + case when c_custkey % 50 = 0 then 100 else 0 end as nation")


_TESTS = {
    "not_null": "SELECT 'not_null' AS test, 'k' AS \"column\", 'error' AS severity, count(*) FILTER (k IS NULL) AS failures FROM dirty",
    "accepted_values": "SELECT 'accepted_values' AS test, 'segment' AS \"column\", 'warn' AS severity, count(*) FILTER (segment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS failures FROM dirty",
    "accepted_range": "SELECT 'accepted_range' AS test, 'bal' AS \"column\", 'error' AS severity, count(*) FILTER (bal < 0 OR bal > 9000) AS failures FROM dirty",
    "not_null_where": "SELECT 'not_null_where' AS test, 'segment' AS \"column\", 'error' AS severity, count(*) FILTER (bal > 5000 AND segment IS NULL) AS failures FROM dirty",
    "expression": "SELECT 'expression' AS test, '' AS \"column\", 'error' AS severity, count(*) FILTER (NOT coalesce(k < 650, false)) AS failures FROM dirty",
    "unique": "SELECT 'unique' AS test, 'k' AS \"column\", 'error' AS severity, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS failures FROM (SELECT k, count(*) AS n FROM dirty WHERE k IS NOT NULL GROUP BY 1)",
    "relationships": "SELECT 'relationships' AS test, 'nation' AS \"column\", 'error' AS severity, count(*) AS failures FROM dirty WHERE nation IS NOT NULL AND nation NOT IN (SELECT n_nationkey FROM nation)",
    "freshness": "SELECT 'freshness' AS test, 'ts' AS \"column\", 'error' AS severity, CASE WHEN epoch(TIMESTAMP '2024-02-15') - floor(epoch(max(ts))) <= 864000 THEN 0 ELSE 1 END::BIGINT AS failures FROM events",
}


def _made(spark, sf_dir):
    dirty = _dirty(spark, sf_dir)
    return dirty, {
        "not_null": quality.not_null("k"),
        "accepted_values": quality.accepted_values("segment", ["BUILDING", "MACHINERY", "HOUSEHOLD"], severity="warn"),
        "accepted_range": quality.accepted_range("bal", 0, 9000),
        "not_null_where": quality.not_null_where("segment", F.col("bal") > 5000),
        "expression": quality.expression(F.col("k") < 650),
        "unique": quality.unique(dirty, "k"),
        "relationships": quality.relationships(dirty, "nation", table(spark, sf_dir, "nation"), "n_nationkey"),
        "freshness": quality.freshness(table(spark, sf_dir, "events"), "ts", 864000, "2024-02-15"),
    }


def _register(name: str) -> None:
    def run(spark, sf_dir):
        dirty, tests = _made(spark, sf_dir)
        return quality.run_suite(dirty, [tests[name]])

    query(f"WITH {_DIRTY} SELECT *, failures = 0 AS passed FROM ({_TESTS[name]})", f"dq_{name}")(run)


for _name in _TESTS:
    _register(_name)


@query(f"WITH {_DIRTY}, t AS ({' UNION ALL '.join(_TESTS.values())}) SELECT *, failures = 0 AS passed FROM t")
def dq_suite(spark, sf_dir):
    dirty, tests = _made(spark, sf_dir)
    return quality.run_suite(dirty, list(tests.values()))


@query(f"""WITH {DAYS}, d AS (SELECT station, date, nullif(tmean, tmean * (CASE WHEN day(date) = 3 THEN 1 ELSE 2 END)) AS tmean, CASE WHEN day(date) = 5 THEN tmax + 1 ELSE tmin END AS tmin, tmax, 1 AS copy FROM days
UNION ALL SELECT station, date, tmean, tmin, tmax, 2 FROM days WHERE day(date) % 7 = 0),
r AS (SELECT *, CASE WHEN tmean IS NULL THEN 'null_measure' WHEN tmax > 400 THEN 'range' WHEN tmin > tmax THEN 'tmin_gt_tmax' END AS reason FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY station, date, reason IS NULL ORDER BY copy) AS rn FROM r)
SELECT coalesce(reason, CASE WHEN rn > 1 THEN 'duplicate' END, 'clean') AS outcome, count(*) AS n FROM n GROUP BY 1""")
def validate_rules_report(spark, sf_dir):
    base = days(spark, sf_dir)
    first = base.selectExpr("station", "date", "case when day(date) = 3 then null else tmean end as tmean", "case when day(date) = 5 then tmax + 1 else tmin end as tmin", "tmax", "1 as copy")
    rows = first.unionByName(base.where("day(date) % 7 = 0").selectExpr("station", "date", "tmean", "tmin", "tmax", "2 as copy"))
    rules = [("null_measure", F.col("tmean").isNull()), ("range", F.col("tmax") > 400), ("tmin_gt_tmax", F.col("tmin") > F.col("tmax"))]
    return quality.validation_report(quality.validate_in_order(rows, rules, ["station", "date"], ["copy"]))


@query("SELECT c_custkey, sha256(c_custkey::VARCHAR || '|' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'None')) AS key, md5(c_custkey::VARCHAR || '-' || coalesce(nullif(c_mktsegment, 'BUILDING'), '_dbt_utils_surrogate_key_null_')) AS hashed_key FROM customer")
def surrogate_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') as segment")
    return c.select("c_custkey", dimensional.surrogate_key("c_custkey", "segment").alias("key"), dimensional.hashed_key("c_custkey", "segment").alias("hashed_key"))


@query("SELECT d::DATE::VARCHAR AS date, year(d)::BIGINT AS year, month(d)::BIGINT AS month, day(d)::BIGINT AS day, (isodow(d) - 1)::BIGINT AS dow, isodow(d) >= 6 AS is_weekend FROM generate_series(DATE '2023-01-01', DATE '2024-12-31', INTERVAL 1 DAY) t(d)")
def date_dim(spark, sf_dir):
    return dimensional.date_dim(spark, "2023-01-01", "2024-12-31").withColumn("date", F.col("date").cast("string"))


def _history(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    was = c.where("c_custkey % 5 <> 0").selectExpr("c_custkey", "case when c_custkey % 3 = 0 then 'OLD' when c_custkey % 7 = 0 then null else c_mktsegment end as segment", "timestamp_ntz '2023-01-01' as valid_from", "cast(null as timestamp_ntz) as valid_to", "true as is_current")
    return dimensional.scd2_snapshot(c.where("c_custkey % 4 <> 0").selectExpr("c_custkey", "c_mktsegment as segment"), was, "c_custkey", ["segment"], "2024-01-01")


_SCD2 = """was AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'OLD' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0),
now AS (SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_custkey % 4 <> 0),
history AS (
  SELECT w.c_custkey, w.segment, TIMESTAMP '2023-01-01' AS valid_from, CASE WHEN n.c_custkey IS NOT NULL AND n.segment IS DISTINCT FROM w.segment THEN TIMESTAMP '2024-01-01' END AS valid_to,
         NOT (n.c_custkey IS NOT NULL AND n.segment IS DISTINCT FROM w.segment) AS is_current FROM was w LEFT JOIN now n USING (c_custkey)
  UNION ALL
  SELECT n.c_custkey, n.segment, TIMESTAMP '2024-01-01', NULL, true FROM now n LEFT JOIN was w USING (c_custkey) WHERE w.c_custkey IS NULL OR w.segment IS DISTINCT FROM n.segment)"""


@query(f"WITH {_SCD2} SELECT * FROM history")
def scd2_snapshot(spark, sf_dir):
    return _history(spark, sf_dir)


_FACTS = "facts AS (SELECT o_orderkey, o_custkey AS c_custkey, o_orderdate + to_days(9000) AS at FROM orders)"


@query(f"WITH {_SCD2}, {_FACTS} SELECT o_orderkey, segment FROM facts f LEFT JOIN history h ON f.c_custkey = h.c_custkey AND f.at >= h.valid_from AND (h.valid_to IS NULL OR f.at < h.valid_to)")
def scd2_as_of_join(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey as c_custkey", "o_orderdate + interval 9000 days as at")
    return dimensional.as_of_join(facts, _history(spark, sf_dir), "c_custkey", "at").select("o_orderkey", "segment")
