"""Scans, projections, joins, aggregates, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from .registry import query

DEC = "decimal(18,4)"


def dec(c: str):
    return F.col(c).cast(DEC)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qty,
 round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS avg_price FROM lineitem
 WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def scan_prune_aggregate(t):
    """Pruned scan, range filter, grouped sums."""
    n = F.count("*")
    return t.lineitem.where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        n.alias("n"), F.sum(dec("l_quantity")).cast("double").alias("qty"), F.round(F.sum(dec("l_extendedprice")).cast("double") / n, 4).alias("avg_price"))


@query("""SELECT o_orderkey AS id, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 10 THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS game_id,
 lower(trim(o_orderpriority)) AS priority, CAST(o_totalprice > 100000 AS INT) AS large, o_orderstatus IN ('F', 'O') AS known FROM orders WHERE o_orderpriority LIKE '1%'""")
def projection_ids(t):
    """Renamed and computed columns, padded ids, prefix filter, membership."""
    return t.orders.where(F.col("o_orderpriority").startswith("1")).select(
        F.col("o_orderkey").alias("id"), S.padded_id(F.col("o_orderkey")).alias("game_id"), S.squeezed(F.col("o_orderpriority")).alias("priority"),
        (F.col("o_totalprice") > 100000).cast("int").alias("large"), F.col("o_orderstatus").isin("F", "O").alias("known"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity < 3) AS removed, count(*) FILTER (WHERE l_quantity >= 3) AS kept,
 CAST(sum(CASE WHEN l_quantity < 3 THEN CAST(l_extendedprice AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS removed_price FROM lineitem""")
def threshold_accounting(t):
    """A threshold filter's accounts in one pass."""
    small = F.col("l_quantity") < 3
    return t.lineitem.agg(F.count("*").alias("n"), F.count_if(small).alias("removed"), F.count_if(~small).alias("kept"), F.sum(F.when(small, dec("l_extendedprice")).otherwise(0)).cast("double").alias("removed_price"))


@query("""SELECT event_id, value IS NULL AS missing, coalesce(value, 0) AS filled, event_type IS DISTINCT FROM 'click' AS other_type,
 CASE WHEN coalesce(user_id, 0) % 7 = 0 THEN NULL ELSE round(coalesce(value, 0) / (coalesce(user_id, 0) % 7) + 1e-9, 6) END AS ratio FROM events""")
def null_semantics(t):
    """Null tests, null-safe inequality, fills, safe division."""
    value, user = F.coalesce("value", F.lit(0)), F.coalesce("user_id", F.lit(0)) % 7
    return t.events.select("event_id", F.col("value").isNull().alias("missing"), value.alias("filled"), (~F.col("event_type").eqNullSafe("click")).alias("other_type"), F.round(S.safe_ratio(value, user) + 1e-9, 6).alias("ratio"))


@query("""SELECT n_name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name""")
def inner_and_lookup_join(t):
    """Inner joins with small dimensions."""
    dims = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'")
    return t.customer.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.sum(dec("c_acctbal")).cast("double").alias("balance"))


@query("""SELECT c_custkey, count(o_orderkey) AS orders, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 0) AS spent FROM customer
 LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def spine_left_join(t):
    """Every key of the spine, facts or zeros; the right side is aggregated (unique) first."""
    facts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum(dec("o_totalprice")).cast("double").alias("spent"))
    return R.spine(t.customer.select("c_custkey"), facts, ["c_custkey"], {"orders": 0, "spent": 0.0})


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""")
def semi_join(t):
    """J5."""
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_join(t):
    """The null-safe form of NOT IN."""
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT event_id, (SELECT max(d) FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d FROM events WHERE event_type = 'purchase') WHERE d < ts) AS issued FROM events""")
def asof_few_dates(t):
    """Strict as-of join with few right dates (one a day), gathered in one row."""
    issues = t.events.where("event_type = 'purchase'").select(F.date_trunc("day", "ts").cast(t.events.schema["ts"].dataType).alias("issued"))
    return R.asof_broadcast(t.events.select("event_id", "ts"), issues, "ts", "issued").select("event_id", "issued")


@query("""SELECT event_id, user_id, max(v) OVER (PARTITION BY event_id) AS last_purchase FROM (SELECT e.event_id, e.user_id,
 (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts) AS v FROM events e)""")
def asof_by_key(t):
    """Strict as-of join by key, as a union and one window."""
    right = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("last_purchase"), "event_id")
    got = R.asof_strict(t.events.select("event_id", "user_id", "ts"), right.withColumnRenamed("event_id", "right_id"), "ts", "last_purchase", ["user_id"], ["right_id"])
    return got.select("event_id", "user_id", "last_purchase")


@query("""WITH s AS (SELECT user_id, ts AS t_in, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t_out FROM events WHERE event_type = 'click')
 SELECT e.event_id, count(s.t_in) AS spans FROM events e LEFT JOIN s ON s.user_id = e.user_id AND s.t_in <= e.ts AND e.ts < s.t_out GROUP BY e.event_id""")
def interval_containment(t):
    """Half-open spans that hold a point, by key."""
    lead = F.expr("lead(ts) over (partition by user_id order by ts, event_id)")
    spans = t.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("t_in"), lead.alias("t_out"))
    points = t.events.select("event_id", "user_id", "ts")
    found = R.within(points, spans, ["user_id"], "ts", "t_in", "t_out").groupBy("event_id").agg(F.count("*").alias("spans"))
    return R.spine(points.select("event_id"), found, ["event_id"], {"spans": 0})


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS as_customer, b.n AS as_supplier, a.k IS NULL OR b.k IS NULL AS one_sided FROM
 (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def full_outer_check(t):
    """Two sides held against each other."""
    a = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("as_customer"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("as_supplier"))
    return a.join(b, "k", "full").withColumn("one_sided", F.col("as_customer").isNull() | F.col("as_supplier").isNull())


@query("""WITH l AS (SELECT l_orderkey, l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS p, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2), x AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS p FROM lineitem WHERE l_linenumber = 7 GROUP BY 1),
 w AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS p FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, sum(p) AS p, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1)
 SELECT o_orderkey, coalesce(s.n, 0) AS parts, abs(coalesce(s.p, 0) + coalesce(x.p, 0) - coalesce(w.p, 0)) > 0.005 AS broken, abs(coalesce(s.p, 0) - coalesce(w.p, 0)) > 0.005 AS broken_without_exclusions
 FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN x ON x.l_orderkey = o_orderkey LEFT JOIN w ON w.l_orderkey = o_orderkey""")
def conservation_chain(t):
    """Admitted parts and exclusions against the whole, with zeros for none; without the exclusions the sums break."""
    price = F.col("l_extendedprice").cast(DEC)
    parts = t.lineitem.where("l_linenumber <> 7").groupBy("l_orderkey", "l_returnflag").agg(F.sum(price).alias("p"), F.count("*").alias("n")).groupBy("l_orderkey").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    excluded = t.lineitem.where("l_linenumber = 7").groupBy("l_orderkey").agg(F.sum(price).alias("x"))
    whole = t.lineitem.groupBy("l_orderkey").agg(F.sum(price).alias("w"))
    chain = t.orders.select("o_orderkey", F.col("o_orderkey").alias("l_orderkey")).join(parts, "l_orderkey", "left").join(excluded, "l_orderkey", "left").join(whole, "l_orderkey", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast(DEC))
    off = lambda a, b: F.abs(a - b) > F.lit(0.005).cast(DEC)
    return chain.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("parts"), off(zero("p") + zero("x"), zero("w")).alias("broken"), off(zero("p"), zero("w")).alias("broken_without_exclusions"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
 SELECT a.event_id, b.event_id AS next_id, a.event_type = b.event_type AS repeated FROM s a JOIN s b ON a.user_id = b.user_id AND b.seq = a.seq + 1""")
def neighbour_self_join(t):
    """Each row with the next of its sequence."""
    s = t.events.selectExpr("user_id", "event_id", "event_type", "row_number() over (partition by user_id order by ts, event_id) as seq")
    b = s.select("user_id", F.col("event_id").alias("next_id"), F.col("event_type").alias("next_type"), (F.col("seq") - 1).alias("seq"))
    return s.join(b, ["user_id", "seq"]).select("event_id", "next_id", (F.col("event_type") == F.col("next_type")).alias("repeated"))


@query("""SELECT source, count(DISTINCT lang) AS langs, list_sort(list(DISTINCT lang)) AS set_of, bool_or(n_chars > 10000) AS any_long, bool_and(n_chars > 5) AS all_some FROM documents GROUP BY source""")
def set_aggregates(t):
    """Distinct counts and sets, any and all."""
    return t.documents.groupBy("source").agg(F.count_distinct("lang").alias("langs"), F.array_sort(F.collect_set("lang")).alias("set_of"), F.bool_or(F.col("n_chars") > 10000).alias("any_long"), F.bool_and(F.col("n_chars") > 5).alias("all_some"))


@query("""SELECT event_type, count(*) AS n, count(value) AS with_value, count(*) FILTER (WHERE value > 50) AS large, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS even_users FROM events GROUP BY event_type""")
def conditional_counts(t):
    """Rows against values, conditional counts and sums, frequencies."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.count_if(F.col("value") > 50).alias("large"), F.sum(F.when(F.col("user_id") % 2 == 0, 1).otherwise(0)).alias("even_users"))


@query("""SELECT l_returnflag, round(CAST(sum(CAST(l_quantity * l_extendedprice AS DECIMAL(24,4))) / sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE), 3) AS weighted,
 round(quantile_cont(l_extendedprice / l_quantity, 0.5) + 1e-9, 6) AS median_ratio, round(quantile_cont(l_extendedprice, 0.1) + 1e-9, 6) AS q10, round(quantile_cont(l_extendedprice, 0.9) + 1e-9, 6) AS q90 FROM lineitem GROUP BY 1""")
def weighted_and_quantiles(t):
    """Weighted mean, median of ratios, exact interpolated quantiles."""
    weighted = F.sum((F.col("l_quantity") * F.col("l_extendedprice")).cast("decimal(24,4)")).cast("double") / F.sum(dec("l_quantity")).cast("double")
    x = t.lineitem.withColumn("ratio", F.col("l_extendedprice") / F.col("l_quantity"))
    sums = x.groupBy("l_returnflag").agg(F.round(weighted, 3).alias("weighted"))
    q = R.many_quantiles(x, ["l_returnflag"], ["ratio", "l_extendedprice"], [0.1, 0.5, 0.9])  # both measures numbered at once
    return sums.join(q, "l_returnflag").select("l_returnflag", "weighted", S.stable(F.col("ratio")[1]).alias("median_ratio"), S.stable(F.col("l_extendedprice")[0]).alias("q10"), S.stable(F.col("l_extendedprice")[2]).alias("q90"))


@query("""SELECT event_type, round(corr(value, user_id) + 1e-9, 6) AS r, round(regr_slope(value, user_id) + 1e-9, 6) AS slope, round(regr_intercept(value, user_id) + 1e-9, 5) AS intercept,
 round(stddev_pop(value) + 1e-9, 6) AS sd0, round(stddev_samp(value) + 1e-9, 6) AS sd1, round(skewness(value) + 1e-9, 5) AS skew, round(kurtosis(value) + 1e-9, 5) AS kurt, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type""")
def moments_and_lines(t):
    """Correlation, regression, deviations, corrected skewness and kurtosis."""
    n = F.count("value").cast("double")
    skew = F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("value") + 6)
    value, user = F.col("value"), F.col("user_id")
    return t.events.groupBy("event_type").agg(S.stable(F.corr("value", "user_id")).alias("r"), S.stable(F.regr_slope(value, user)).alias("slope"), S.stable(F.regr_intercept(value, user), 5).alias("intercept"),
        S.stable(F.stddev_pop("value")).alias("sd0"), S.stable(F.stddev_samp("value")).alias("sd1"), S.stable(skew, 5).alias("skew"), S.stable(kurt, 5).alias("kurt"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY user_id""")
def arg_extremes(t):
    """Values at the extremes of an order without ties."""
    at = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.max_by("event_id", at).alias("last_event"), F.min_by("event_id", at).alias("first_event"))


@query("""SELECT c_nationkey, avg(n) AS avg_orders, max(n) AS most, count(*) AS customers FROM (SELECT c_nationkey, c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL) GROUP BY c_nationkey""")
def two_level_aggregate(t):
    """A21."""
    n = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "c_custkey").count()
    return n.groupBy("c_nationkey").agg(F.avg("count").alias("avg_orders"), F.max("count").alias("most"), F.count("*").alias("customers"))


@query("""SELECT user_id, count(*) FILTER (WHERE ts > first_ts) AS later FROM (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events) GROUP BY user_id""")
def correlated_filter(t):
    """A correlated minimum as a window, then a filtered count."""
    first = t.events.selectExpr("user_id", "ts", "min(ts) over (partition by user_id) as first_ts")
    return first.groupBy("user_id").agg(F.count_if(F.col("ts") > F.col("first_ts")).alias("later"))


@query("""SELECT part, count(*) AS n, CAST(sum(CAST(w AS DECIMAL(18,4))) AS DOUBLE) AS weight FROM (SELECT unnest([l_partkey, -l_suppkey]) AS part, l_quantity AS w FROM lineitem) GROUP BY part""")
def exploded_exposure(t):
    """Exposure of array members."""
    rows = t.lineitem.select(F.explode(F.array(F.col("l_partkey"), -F.col("l_suppkey"))).alias("part"), dec("l_quantity").alias("w"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("w").cast("double").alias("weight"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS pooled FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))""")
def grouping_levels(t):
    """Pooled and per-group levels together."""
    return t.spark.sql("select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderpriority) as bigint) as pooled from {orders} group by grouping sets ((o_orderstatus), (o_orderstatus, o_orderpriority))", orders=t.orders)


@query("""(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT DISTINCT c_nationkey, 'customer' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier))""")
def set_operations(t):
    """Union all, intersection, one difference."""
    c, s = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.distinct().join(s, "k", "left_anti").withColumn("side", F.lit("customer")))


@query("""SELECT part_type, n FROM (SELECT p_type AS part_type, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, part_type LIMIT 10""")
def top_types(t):
    """O1 to O3: a top-k report with a complete order."""
    return t.part.groupBy(F.col("p_type").alias("part_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part_type").limit(10)


@query("""SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def canonical_pairs(t):
    """Unordered pairs in canonical roles."""
    a, b = F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")
    return t.lineitem.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1")


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.ref') AS VARCHAR) AS ref, length(props) AS size, sha256(props) AS digest, translate(event_type, '-.', '  ') AS spaced,
 concat_ws(' ', event_type, CAST(user_id AS VARCHAR)) AS label, regexp_matches(event_type, '^c') AS starts_c FROM events""")
def text_functions(t):
    """JSON, hashes, anchored patterns, concatenation."""
    return t.events.select("event_id", F.get_json_object("props", "$.ref").alias("ref"), F.length("props").cast("long").alias("size"), F.sha2("props", 256).alias("digest"), F.translate("event_type", "-.", "  ").alias("spaced"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("label"), F.col("event_type").rlike("^c").alias("starts_c"))


@query("""SELECT o_orderkey, CAST(floor(date_diff('day', date_trunc('week', (SELECT min(o_orderdate) FROM orders)), o_orderdate) / 28) AS INT) AS block,
 CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS season FROM orders""")
def calendar_blocks(t):
    """Monday-anchored blocks and season labels."""
    first = t.orders.agg(F.min("o_orderdate").alias("first"))
    return t.orders.crossJoin(F.broadcast(first)).select("o_orderkey", S.monday_block(F.col("o_orderdate"), F.col("first"), 28).alias("block"), S.season_label(F.col("o_orderdate")).alias("season"))


@query("""SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 7 DAY)) AS DATE) AS issued FROM orders""")
def issuance_dates(t):
    """a calendar with a step."""
    bounds = t.orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("issued"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN l_extendedprice >= 10000 THEN 1 ELSE 0 END) + (CASE WHEN l_extendedprice >= 30000 THEN 1 ELSE 0 END) + (CASE WHEN l_extendedprice >= 60000 THEN 1 ELSE 0 END) AS bin,
 greatest(l_discount - l_tax, 0) AS excess, abs(l_quantity - round(l_quantity)) <= 1e-8 + 1e-5 * abs(round(l_quantity)) AS whole FROM lineitem""")
def bins_and_clamps(t):
    """Clamps, near integers, right-closed bins."""
    cuts = F.array(*(F.lit(float(x)) for x in (10000, 30000, 60000)))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.right_closed_bin(F.col("l_extendedprice"), cuts).alias("bin"), F.greatest(F.col("l_discount") - F.col("l_tax"), F.lit(0.0)).alias("excess"), S.near_integer(F.col("l_quantity")).alias("whole"))


@query("""SELECT l_orderkey, list_sort(list(l_partkey)) AS parts, len(list_distinct(list(l_partkey))) AS distinct_parts, list_contains(list(l_suppkey), 7) AS has_7 FROM lineitem GROUP BY l_orderkey""")
def array_functions(t):
    """sorted, distinct and membership of arrays."""
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"), F.count_distinct("l_partkey").alias("distinct_parts"), F.max((F.col("l_suppkey") == 7).cast("int")).cast("boolean").alias("has_7"))


@query("""SELECT a, b, count(*) AS n FROM (SELECT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y USING (l_orderkey)) GROUP BY 1, 2""")
def gram_self_join(t):
    """The pair counts of a sparse design's normal equations."""
    return R.pair_counts(t.lineitem, "l_orderkey", "l_suppkey", t.lineitem.count())
