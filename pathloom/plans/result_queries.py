"""Queries over result tables (lines and events stand in for result logs), with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import scalars
from pathloom.operators import analytics
from pathloom.plans import shapes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def _rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _lines(spark, sf_dir):
    return shapes.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")


def _stats(spark, sf_dir):
    e = shapes.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("category"), F.col("user_id").alias("owner"), "value")


_STATS = "s AS (SELECT event_id AS seq, event_type AS category, user_id AS owner, value FROM events)"


@query("SELECT l_orderkey, CAST(floor(avg(l_quantity)) AS BIGINT) AS l_quantity, CAST(floor(avg(l_partkey)) AS BIGINT) AS l_partkey, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")
def results_averaged(spark, sf_dir):
    return analytics.average_runs(_lines(spark, sf_dir), "l_orderkey", ["l_quantity", "l_partkey"], "l_extendedprice")


@query("SELECT CAST(floor((l_quantity - 1) / 5) * 5 + 1 AS BIGINT) AS bucket, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS sd FROM lineitem WHERE l_discount IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1")
def results_bucketed(spark, sf_dir):
    return _rounded(analytics.bucketed(_lines(spark, sf_dir), "l_quantity", "l_discount", 5), "mean", "sd")


@query("""SELECT l_returnflag, count(*) AS n, min(l_discount) AS min, quantile_cont(l_discount, 0.25) AS q1, quantile_cont(l_discount, 0.5) AS median, round(avg(l_discount), 6) AS mean,
quantile_cont(l_discount, 0.75) AS q3, max(l_discount) AS max, round(stddev_samp(l_discount), 6) AS sd FROM lineitem GROUP BY 1""")
def results_summary(spark, sf_dir):
    return _rounded(analytics.summary(_lines(spark, sf_dir), "l_returnflag", "l_discount"), "mean", "sd")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, e.event_type, value, value IS NULL OR value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5 AS outlier FROM events e JOIN q USING (event_type)""")
def results_outliers(spark, sf_dir):
    return analytics.outliers(shapes.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value")


@query("SELECT place, count(*) AS n, round(avg(l_extendedprice), 6) AS mean FROM (SELECT row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place, l_extendedprice FROM lineitem) GROUP BY 1")
def results_series(spark, sf_dir):
    out = analytics.average_series(_lines(spark, sf_dir), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_extendedprice")
    return _rounded(out.withColumn("place", F.col("place").cast("bigint")), "mean")


@query("SELECT l_suppkey, CAST((place - 1) // 20 AS BIGINT) AS chunk, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS place, l_quantity FROM lineitem) GROUP BY ALL")
def results_chunks(spark, sf_dir):
    return _rounded(analytics.chunk_means(_lines(spark, sf_dir), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "l_quantity", 20), "mean")


@query("SELECT l_suppkey, " + ", ".join(f"sum(CASE WHEN l_linenumber = {i} THEN CAST(l_quantity AS BIGINT) END) AS run_{i}" for i in range(1, 8)) + " FROM lineitem GROUP BY 1")
def results_runs(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
    return analytics.runs_as_columns(lines, "l_suppkey", "l_linenumber", list(range(1, 8)), "l_quantity")


@query("""WITH a AS (SELECT l_orderkey AS k, max(l_quantity) AS d, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT CAST(floor((d - 1) / 10) * 10 + 1 AS BIGINT) AS bucket, count(*) AS n, round(avg(a.v / b.v), 4) AS mean, round(stddev_samp(a.v / b.v), 4) AS sd FROM a JOIN b USING (k) WHERE b.v <> 0 GROUP BY 1""")
def results_speedup(spark, sf_dir):
    per = lambda flag: _lines(spark, sf_dir).where(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.max("l_quantity").alias("d"), F.sum("l_extendedprice").alias("v"))
    return analytics.speedup(per("R"), per("N"), "l_orderkey", "d", "v", 10).withColumns({c: F.round(F.col(c), 4) for c in ("mean", "sd")})


@query("SELECT l_quantity AS value, count(*) AS freq, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS probability FROM lineitem GROUP BY 1")
def results_distribution(spark, sf_dir):
    return analytics.distribution(_lines(spark, sf_dir), "l_quantity").withColumn("probability", F.round("probability", 9))


@query("WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT " + ", ".join(f"round(avg(CASE WHEN abs(value - m) <= {k} * s THEN 1.0 ELSE 0.0 END), 6) AS within_{k}" for k in (1, 2, 3)) + " FROM events, m")
def results_sigma(spark, sf_dir):
    return _rounded(analytics.sigma_coverage(shapes.table(spark, sf_dir, "events").select("value"), "value"), "within_1", "within_2", "within_3")


@query(f"WITH {_STATS} SELECT category, owner, round(sum(value), 6) AS total, max(value) AS most, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM s GROUP BY ALL")
def stats_summary(spark, sf_dir):
    return analytics.statistics(_stats(spark, sf_dir)).withColumns({c: F.round(F.col(c), 6) for c in ("total", "mean", "sd")})


@query(f"WITH {_STATS} SELECT * FROM s WHERE category IN ('click', 'purchase') AND category <> 'purchase'")
def stats_filter(spark, sf_dir):
    return analytics.chosen(_stats(spark, sf_dir), ["click", "purchase"], ["purchase"])


@query(f"WITH {_STATS} SELECT owner, round(ratio, 4) AS ratio FROM (SELECT owner, avg(CASE WHEN category = 'click' THEN value END) / avg(CASE WHEN category = 'view' THEN value END) AS ratio FROM s WHERE category IN ('click', 'view') GROUP BY 1) WHERE ratio IS NOT NULL")
def stats_ratio(spark, sf_dir):
    return analytics.category_ratio(_stats(spark, sf_dir), "click", "view").withColumn("ratio", F.round("ratio", 4))


@query(f"WITH {_STATS} SELECT category, owner, max_by(value, seq) AS value FROM s GROUP BY ALL")
def stats_last(spark, sf_dir):
    return analytics.last_values(_stats(spark, sf_dir))


@query(f"WITH {_STATS} SELECT *, lag(value) OVER w AS before, lead(value) OVER w AS after FROM s WINDOW w AS (PARTITION BY category, owner ORDER BY seq)")
def stats_neighbours(spark, sf_dir):
    return analytics.with_neighbours(_stats(spark, sf_dir))


@query(f"WITH {_STATS} SELECT seq, category, owner, value, round(sum(value) OVER (PARTITION BY category, owner ORDER BY seq), 4) AS running FROM s")
def stats_running(spark, sf_dir):
    return analytics.accumulated(_stats(spark, sf_dir)).withColumn("running", F.round("running", 4))


@query(f"WITH {_STATS} SELECT owner, round(sum(CASE WHEN category = 'click' THEN value END), 4) AS click, round(sum(CASE WHEN category = 'view' THEN value END), 4) AS view FROM s GROUP BY 1")
def stats_pivot(spark, sf_dir):
    return analytics.stats_table(_stats(spark, sf_dir), ["click", "view"]).withColumns({c: F.round(F.col(c), 4) for c in ("click", "view")})


@query("""WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, sum(CASE WHEN l_linenumber < 4 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS v FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT k AS l_orderkey, a.v AS a, b.v AS b FROM a FULL JOIN b USING (k) WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 1e-8""")
def results_differences(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("q", F.col("l_quantity").cast("bigint"))
    a = lines.groupBy("l_orderkey").agg(F.sum("q").alias("v"))
    b = lines.where("l_orderkey % 5 <> 0").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linenumber") < 4, F.col("q")).otherwise(0)).alias("v"))
    return analytics.differences(a, b, "l_orderkey", "v")


@query("SELECT 'customer' AS file, c_custkey AS key, c_acctbal AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def results_union(spark, sf_dir):
    c = shapes.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    s = shapes.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    return analytics.with_provenance({"customer": c, "supplier": s})


@query("SELECT o_orderkey, CASE WHEN b < a THEN b + 86400 - a ELSE b - a END AS seconds FROM (SELECT o_orderkey, o_custkey * 37 % 86400 AS a, o_orderkey * 53 % 86400 AS b FROM orders)")
def results_midnight(spark, sf_dir):
    o = shapes.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalars.after_midnight(F.col("o_custkey") * 37 % 86400, F.col("o_orderkey") * 53 % 86400).alias("seconds"))
