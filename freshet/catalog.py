"""Registered queries on the driver's tables and the SQL that states their results.

A scenario is a supplier, its flow the extended price shipped a day, its window 1995-12-01 to 2001-05-31. The pool is one
row of six figures for each supplier, the selection the suppliers in the pool's upper fifth by total flow.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .operators import coverage, flood, forcing, image, normalize, persistence, quantiles, runs, screen, select, ssi
from .plans import design, spaces
from .sources import envelope, panel

START, END = dt.date(1995, 12, 1), dt.date(2001, 6, 1)
DAYS, CUT_DAYS = (END - START).days, (dt.date(1996, 6, 1) - START).days
AXES = ("total", "peak", "active", "discount", "quantity", "spread")
NEAR_AXES = ("peak", "discount", "quantity")
#: Number and seed of the sampled forcing profiles.
SAMPLED = 64, 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return panel.dense_days(lines.select(F.col("l_suppkey").alias("scenario_id"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("flow")), START, END)


def monthly(spark: SparkSession, sf_dir: str, how: str = "sum") -> DataFrame:
    return panel.daily_to_monthly(daily(spark, sf_dir), how)


def anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, pos, z, z_pre): six-month totals, standardized by the pool's mean and deviation of their calendar month."""
    totals = ssi.accumulate(monthly(spark, sf_dir)).filter("total is not null").withColumn("cal_month", F.month("month"))
    law = totals.groupBy("cal_month").agg(F.avg("total").alias("mean"), F.stddev_pop("total").alias("sd"))
    z = totals.join(F.broadcast(law), "cal_month").withColumn("z", F.round((F.col("total") - F.col("mean")) / F.col("sd"), 9))  # twelve rows
    pre = F.first(F.when(F.col("pos") == 5, F.col("z")), ignorenulls=True).over(Window.partitionBy("scenario_id"))
    return z.withColumn("z_pre", pre).filter("pos > 5").select("scenario_id", "month", (F.col("pos") - 6).alias("pos"), "z", "z_pre")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")  # noqa: E731  exact in any order
    days = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("flow"), F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("disc"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"), F.count("*").alias("n"))
    n = F.sum("n").cast("double")
    return days.groupBy(F.col("l_suppkey").alias("row_ix")).agg(
        money("flow").alias("total"), F.max("flow").cast("double").alias("peak"), F.count("*").cast("double").alias("active"), F.round(money("disc") / n, 9).alias("discount"), F.round(money("qty") / n, 9).alias("quantity"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum((F.col("flow") * F.col("flow")).cast("decimal(38,4)")).cast("double") / F.count("*") - F.pow(money("flow") / F.count("*"), F.lit(2)))) / (money("flow") / F.count("*")), 6).alias("spread"),
    )


def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection: ``row_ix`` of the pool's upper fifth by total flow."""
    p = pool(spark, sf_dir)
    cut = quantiles.exact_percentiles(p.select(F.lit("").alias("all"), "total"), "all", "total", (0.8,)).select(F.col("q")[0].alias("cut"))
    return p.crossJoin(F.broadcast(cut)).filter("total > cut").select("row_ix")  # one row


def tail_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = normalize.minmax_normalize(pool(spark, sf_dir), NEAR_AXES)
    return x.join(tail(spark, sf_dir), "row_ix", "left_semi")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = {c: F.round(c, digits) if t in ("double", "float") else F.col(c).cast("long") if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes}
    return df.select(*(v.alias(k) for k, v in cols.items()))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, col, month, factor, sd): monthly mean and deviation of order prices by priority and era, named like climate runs."""
    o = table(spark, sf_dir, "orders")
    era = F.when(F.year("o_orderdate") < 1998, F.lit("1980_2019")).otherwise(F.lit("2020_2059"))
    run = F.concat(F.regexp_replace("o_orderpriority", "[^0-9A-Z]+", ""), F.lit("_ssp245_"), era)
    return o.groupBy(run.alias("run"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("factor"), F.stddev_pop("o_totalprice").alias("sd")).withColumn("col", F.lit(0))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, water_pos, factor): each priority's monthly mean price over its mean of the twelve months."""
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_orderpriority").alias("run"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("mean"))
    whole = m.groupBy("run").agg(F.avg("mean").alias("all"))
    return m.join(whole, "run").select("run", F.pmod(F.col("month") - 10, F.lit(12)).alias("water_pos"), (F.col("mean") / F.col("all")).alias("factor"))


def threshold(spark: SparkSession, sf_dir: str) -> tuple[float, float]:
    return ssi.reference_levels(daily(spark, sf_dir).filter(F.col("pos") >= CUT_DAYS))


def scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).filter(F.col("pos") >= CUT_DAYS)
    return d.withColumns({"pos": F.col("pos") - CUT_DAYS, "month_ix": F.col("month_ix") - ssi.TIMESCALE})


def reference_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssi.fit_months(monthly(spark, sf_dir, "mean").filter("flow is not null"))


def q_hazard_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily(spark, sf_dir).persist()
    months = panel.daily_to_monthly(days)
    return image.hazard_image(months, days, image.fit_reference(months, days), CUT_DAYS, supplement=True)


def q_design_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dense(pool(spark, sf_dir))
    d = design.select_from_image(p, AXES, max(5, p.count() // 10), 7, "abs", draws=20)
    rows = [(int(r), float(x)) for r, x in zip(d.selection.paired, d.selection.displacement, strict=True)]
    return spark.createDataFrame(rows, "row_ix long, displacement double")


def dense(p: DataFrame) -> DataFrame:
    """Rows numbered from 0 in id order: counts before each of 64 ranges of ids, then numbers within a range."""
    lo, hi = p.agg(F.min("row_ix"), F.max("row_ix")).first()
    part = F.floor((F.col("row_ix") - F.lit(lo or 0)) * 64 / F.lit((hi or 0) - (lo or 0) + 1))
    ranged = p.withColumn("__p", part)
    before = ranged.groupBy("__p").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("__p")) - F.col("n"))  # 64 rows
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("row_ix")) - 1
    return ranged.withColumn("__i", inside).join(F.broadcast(before.select("__p", "before")), "__p").withColumn("row_ix", F.col("before") + F.col("__i")).drop("__p", "__i", "before")


def q_selector_rows(rule: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = normalize.minmax_normalize(dense(pool(spark, sf_dir)), NEAR_AXES).persist()
        got = select.SELECTORS[rule](x, NEAR_AXES, max(3, x.count() // 20), 11)
        return design.rows_frame(x, got.rows)

    return query


def q_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid that the cell rule finds for a twentieth of the pool, and the member of each of its cells."""
    x = normalize.minmax_normalize(dense(pool(spark, sf_dir)), NEAR_AXES).persist()
    g = select.grid_for(x, NEAR_AXES, max(3, x.count() // 20))
    return select.cell_members(x, NEAR_AXES, g).withColumn("g", F.lit(g))


def q_per_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    return design.per_axis_metrics(p, NEAR_AXES, [r.row_ix for r in tail(spark, sf_dir).collect()])  # the selection


def q_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.uniform_discrepancies(spark, 20, tail(spark, sf_dir).count(), len(NEAR_AXES), 5)


def q_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = normalize.minmax_normalize(dense(pool(spark, sf_dir)), NEAR_AXES).persist()
    n = max(3, x.count() // 20)
    got = select.certified_assignment(x, NEAR_AXES, select.latin_hypercube(n, 3, 5), [4, n, 2 * n, x.count()])
    return spark.createDataFrame([(int(r), float(d), bool(got.info["certified"])) for r, d in zip(got.paired, got.displacement, strict=True)], "row_ix long, displacement double, certified boolean")


def q_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dense(pool(spark, sf_dir)).select("row_ix", *NEAR_AXES).persist()
    return design.compare_selectors(p, NEAR_AXES, max(5, p.count() // 20), (1, 2), {k: select.SELECTORS[k] for k in ("random", "lhs_nn", "lhs_assign")})


def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir)
    order = persistence.wetness_order(m.select(F.floor(F.col("pos") / 12).alias("year"), (F.col("pos") % 12).alias("period"), F.col("scenario_id").alias("site"), F.col("flow").alias("value")).filter("year < 5"))
    return persistence.bootstrap(spark, [r.year for r in order.orderBy("wet_rank").collect()], m.select("scenario_id").distinct().count(), 10, 12, 0.4, 0.5, 3)


def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = normalize.minmax_normalize(pool(spark, sf_dir), NEAR_AXES)
    corners = np.array([[i, j, k] for i in (0.0, 1.0) for j in (0.0, 1.0) for k in (0.0, 1.0)])
    return select.nearest_candidates(x, NEAR_AXES, corners, 3).select("target", "row_ix", "d2", "rank")


def q_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = normalize.minmax_normalize(pool(spark, sf_dir), NEAR_AXES)
    parts = [select.cells(x, NEAR_AXES, g).groupBy("cell").agg(F.count("*").alias("n")).agg(F.lit(g).alias("g"), F.count("*").alias("occupied"), F.max("n").alias("largest")) for g in (2, 4, 8)]
    return parts[0].union(parts[1]).union(parts[2])


def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = normalize.long_form(pool(spark, sf_dir), AXES)
    cut = quantiles.exact_percentiles(long, "axis", "value", (0.75,)).select("axis", F.col("q")[0].alias("cut"))
    return select.jaccard_pairs(long.join(F.broadcast(cut), "axis").filter("value > cut").select(F.col("axis").alias("name"), "row_ix"))  # one row per axis


def q_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("p"), (F.year("o_orderdate") < 1998).alias("base"))
    m = o.groupBy("month").agg(F.avg(F.ln("p")).alias("mean"), F.stddev_pop(F.ln("p")).alias("sd"), (F.avg(F.when(~F.col("base"), F.col("p"))) / F.avg(F.when(F.col("base"), F.col("p")))).alias("a"))
    return forcing.adjust_moments(m)


def q_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = forcing.sample_forcing(profiles(spark, sf_dir), *SAMPLED)
    return rows.select("theta_ix", "m", "r1", "r2", "psi1", "psi2", F.array_join(F.transform("profile", lambda v: F.format_string("%.6f", v)), ",").alias("profile"))


def q_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = screen.effective_dimension(pool(spark, sf_dir), AXES)
    return spark.createDataFrame([(got["participation_ratio"],)], "participation_ratio double")


QUERIES = {
    "daily_panel": lambda s, d: rounded(daily(s, d).select("scenario_id", "day", "flow"), 4),
    "monthly_panel": lambda s, d: rounded(monthly(s, d, "mean").select("scenario_id", "month", "flow")),
    "rolling_accumulation": lambda s, d: rounded(ssi.accumulate(monthly(s, d)).filter("total is not null").select("scenario_id", "month", "total"), 4),
    "standardized_anomaly": lambda s, d: rounded(anomaly(s, d).select("scenario_id", "month", "z")),
    "drought_events": lambda s, d: rounded(runs.drought_events(anomaly(s, d)).select("scenario_id", "start", "end", "peak", "duration", "magnitude", "severity")),
    "controlling_event": lambda s, d: rounded(runs.select_event(runs.drought_events(anomaly(s, d))).select("scenario_id", "start", "end", "peak", "duration", "magnitude", "severity")),
    "drought_descriptors": lambda s, d: rounded(runs.drought_descriptors(anomaly(s, d))),
    "pot_pulses": lambda s, d: rounded(flood.pulses(scored_days(s, d), threshold(s, d)[0]).select("scenario_id", "lo", "hi", "peak", "peak_pos", "days", "volume"), 4),
    "flood_descriptors": lambda s, d: rounded(flood.flood_descriptors(scored_days(s, d), *threshold(s, d))),
    "regime_descriptors": lambda s, d: rounded(flood.regime_descriptors(scored_days(s, d), threshold(s, d)[1])),
    "axis_spread": lambda s, d: rounded(screen.axis_spread(pool(s, d), AXES).select("axis", (F.col("std") / F.lit(1.0)).alias("std"), "iqr", "skew", "modal_frac", "degenerate"), 3),
    "spearman_pairs": lambda s, d: rounded(screen.rank_correlations(pool(s, d), AXES)),
    "redundant_pairs": lambda s, d: rounded(screen.redundant_pairs(pool(s, d), AXES, 0.5)),
    "minmax_norm": lambda s, d: rounded(normalize.minmax_normalize(pool(s, d), AXES)),
    "cdf_norm": lambda s, d: rounded(normalize.cdf_normalize(pool(s, d), AXES)),
    "clip_qc": lambda s, d: rounded(normalize.clipping(pool(s, d), AXES), 4),
    "l2_star": lambda s, d: rounded(coverage.star_discrepancy(tail_points(s, d), NEAR_AXES)),
    "nn_distance": lambda s, d: rounded(coverage.nearest_distances(tail_points(s, d), NEAR_AXES)),
    "ess_kernel": lambda s, d: rounded(coverage.effective_sample_size(tail_points(s, d), NEAR_AXES)),
    "marginal_gaps": lambda s, d: rounded(coverage.marginal_gaps(tail_points(s, d), NEAR_AXES)),
    "ks_vs_pool": lambda s, d: rounded(coverage.ks_to_pool(pool(s, d), tail(s, d), AXES)),
    "tail_share": lambda s, d: rounded(coverage.tail_shares(pool(s, d), tail(s, d), AXES)),
    "eps_cell_occupancy": lambda s, d: rounded(q_cells(s, d)),
    "nearest_member": lambda s, d: rounded(q_nearest(s, d)),
    "jaccard_pairs": lambda s, d: rounded(q_jaccard(s, d)),
    "participation_ratio": lambda s, d: rounded(q_dimension(s, d)),
    "envelope_cv_change": lambda s, d: rounded(envelope.variance_envelope(factors(s, d).drop("sd"), factors(s, d).select("run", "month", F.col("sd").alias("factor")))),
    "harmonic_fit": lambda s, d: rounded(forcing.harmonic_fit(profiles(s, d))),
    "climate_adjustment": lambda s, d: rounded(q_moments(s, d)),
    "gamma_month_fit": lambda s, d: rounded(reference_fit(s, d).withColumn("scale", F.round("scale", 3))),
    "ssi_series": lambda s, d: rounded(ssi.scored_index(monthly(s, d, "mean"), reference_fit(s, d)).select("scenario_id", "month", "z")),
    "hazard_image": lambda s, d: rounded(q_hazard_image(s, d)),
    "design_selection": q_design_selection,
    "lhs_nn_selection": q_selector_rows("lhs_nn"),
    "lhs_assignment": q_selector_rows("lhs_assign"),
    "maximin_selection": q_selector_rows("maximin"),
    "eps_cell_selection": q_selector_rows("eps_cell"),
    "eps_cell_members": lambda s, d: rounded(q_members(s, d)),
    "uniform_null": lambda s, d: rounded(q_uniform(s, d)),
    "selection_profile": lambda s, d: rounded(spaces.axis_profile(pool(s, d), tail(s, d), AXES)),
    "selection_correlation": lambda s, d: rounded(spaces.mean_abs_correlation(pool(s, d).join(tail(s, d), "row_ix", "left_semi"), AXES)),
    "per_axis_metrics": lambda s, d: rounded(q_per_axis(s, d)),
    "pair_grid": lambda s, d: rounded(coverage.pair_grid(pool(s, d), tail(s, d), AXES, 10)),
    "certified_assignment": q_certified,
    "mst_edges": lambda s, d: rounded(coverage.spanning_tree(tail_points(s, d), NEAR_AXES)),
    "axis_clusters": lambda s, d: s.createDataFrame([(",".join(m), r) for m, r in screen.axis_clusters(pool(s, d), AXES, 0.5)], "members string, representative string"),
    "selector_comparison": q_comparison,
    "persistent_bootstrap": q_bootstrap,
    "sampled_forcing": lambda s, d: rounded(q_sampled(s, d)),
    "nearest_summary": lambda s, d: rounded(coverage.nearest_summary(tail_points(s, d), NEAR_AXES)),
    "ks_to_uniform": lambda s, d: rounded(coverage.ks_to_uniform(tail_points(s, d), NEAR_AXES)),
    "corner_share": lambda s, d: rounded(coverage.corner_share(pool(s, d), tail(s, d), AXES)),
    "face_share": lambda s, d: s.createDataFrame([(round(normalize.face_share(pool(s, d), AXES, tail(s, d)), 6),)], "face_share double"),
    "axis_histogram": lambda s, d: rounded(coverage.histogram(pool(s, d), tail(s, d), AXES, 10)),
    "not_selected": lambda s, d: pool(s, d).join(tail(s, d), "row_ix", "left_anti").select("row_ix"),
    "resampled_months": lambda s, d: rounded(panel.resample_months(table(s, d, "lineitem").select(F.col("l_suppkey").alias("scenario_id"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("flow")), "max")),
}

_DAILY = f"""
rec AS (SELECT l_suppkey AS scenario_id, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS flow FROM lineitem
  WHERE l_shipdate >= DATE '{START}' AND l_shipdate < DATE '{END}' GROUP BY 1, 2),
spine AS (SELECT s.scenario_id, CAST(d.p AS INTEGER) AS pos, CAST(DATE '{START}' + CAST(d.p AS INTEGER) AS DATE) AS day
  FROM (SELECT DISTINCT scenario_id FROM rec) s CROSS JOIN (SELECT unnest(range(0, {DAYS})) AS p) d),
daily AS (SELECT spine.scenario_id, spine.pos, spine.day, (year(spine.day) - 1995) * 12 + month(spine.day) - 12 AS month_ix, coalesce(rec.flow, 0.0) AS flow
  FROM spine LEFT JOIN rec ON rec.scenario_id = spine.scenario_id AND rec.day = spine.day),
monthly AS (SELECT scenario_id, month_ix AS pos, min(day) AS month, sum(flow) AS flow, avg(flow) AS mean FROM daily GROUP BY 1, 2)"""
_TOTALS = f"""{_DAILY},
totals AS (SELECT * FROM (SELECT *, sum(flow) OVER w AS total, count(*) OVER w AS full_n FROM monthly WINDOW w AS (PARTITION BY scenario_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE full_n = 6),
law AS (SELECT month(month) AS cm, avg(total) AS mu, stddev_pop(total) AS sd FROM totals GROUP BY 1),
score AS (SELECT scenario_id, month, pos, round((total - mu) / sd, 9) AS z FROM totals JOIN law ON cm = month(month)),
z AS (SELECT scenario_id, month, pos - 6 AS pos, z FROM score WHERE pos > 5),
pre AS (SELECT scenario_id, z AS z_pre FROM score WHERE pos = 5)"""
_EVENTS = f"""{_TOTALS},
gaps AS (SELECT *, pos - lag(pos) OVER (PARTITION BY scenario_id ORDER BY pos) AS gap FROM z WHERE z < 0),
ids AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1 THEN 1 ELSE 0 END) OVER w AS spell, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END) OVER w AS cluster
  FROM gaps WINDOW w AS (PARTITION BY scenario_id ORDER BY pos)),
low AS (SELECT *, min(z) OVER (PARTITION BY scenario_id, spell) AS lowest FROM ids),
firsts AS (SELECT *, min(CASE WHEN lowest <= -1 THEN spell END) OVER (PARTITION BY scenario_id, cluster) AS first_spell FROM low),
events AS (SELECT scenario_id, cluster, min(pos) AS start, max(pos) AS "end", arg_min(pos, {{'z': z, 'p': pos}}) AS peak, count(*) AS duration, abs(sum(z)) AS magnitude, abs(min(z)) AS severity,
  arg_min(z, pos) AS z_start, arg_max(z, pos) AS z_end FROM firsts WHERE spell >= first_spell GROUP BY 1, 2),
control AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY magnitude DESC, start) AS k FROM events) WHERE k = 1)"""
_SCORED = f"""{_DAILY},
wet AS (SELECT scenario_id, pos - {CUT_DAYS} AS pos, month_ix - 6 AS month_ix, flow FROM daily WHERE pos >= {CUT_DAYS}),
lev AS (SELECT quantile_cont(flow, 0.95) AS thr, avg(flow) AS mu FROM wet)"""
_PULSES = f"""{_SCORED},
above AS (SELECT scenario_id, pos, flow, pos - lag(pos) OVER (PARTITION BY scenario_id ORDER BY pos) AS gap FROM wet, lev WHERE flow > thr),
num AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY scenario_id ORDER BY pos) AS pulse FROM above),
pulses AS (SELECT scenario_id, pulse, min(pos) AS lo, max(pos) AS hi, max(flow) AS peak, arg_max(pos, {{'f': flow, 'p': -pos}}) AS peak_pos, count(*) AS days, sum(flow - thr) AS volume FROM num, lev GROUP BY 1, 2)"""
_POOL = """
days AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS flow, sum(CAST(l_discount AS DECIMAL(18,2))) AS disc, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty, count(*) AS n FROM lineitem GROUP BY 1, 2),
pool AS (SELECT l_suppkey AS row_ix, CAST(sum(flow) AS DOUBLE) AS total, CAST(max(flow) AS DOUBLE) AS peak, CAST(count(*) AS DOUBLE) AS active, round(CAST(sum(disc) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 9) AS discount,
  round(CAST(sum(qty) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 9) AS quantity,
  round(sqrt(greatest(0.0::DOUBLE, CAST(sum(CAST(flow AS DECIMAL(18,2)) * CAST(flow AS DECIMAL(18,2))) AS DOUBLE) / count(*) - pow(CAST(sum(flow) AS DOUBLE) / count(*), 2))) / (CAST(sum(flow) AS DOUBLE) / count(*)), 6) AS spread FROM days GROUP BY 1),
long AS (UNPIVOT pool ON total, peak, active, discount, quantity, spread INTO NAME axis VALUE value),
cut AS (SELECT quantile_cont(total, 0.8) AS c FROM pool),
tail AS (SELECT row_ix FROM pool, cut WHERE total > c),
bounds0 AS (SELECT axis, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM long GROUP BY 1),
bounds AS (SELECT axis, lo, CASE WHEN hi <= lo THEN lo + 1e-12 ELSE hi END AS hi FROM bounds0),
unit AS (SELECT row_ix, axis, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (value - lo) / (hi - lo))) AS x FROM long JOIN bounds USING (axis)),
x AS (SELECT row_ix, max(CASE WHEN axis = 'peak' THEN x END) AS a, max(CASE WHEN axis = 'discount' THEN x END) AS b, max(CASE WHEN axis = 'quantity' THEN x END) AS c FROM unit GROUP BY 1),
pts AS (SELECT * FROM x WHERE row_ix IN (SELECT row_ix FROM tail)),
ranks AS (SELECT row_ix, axis, rank() OVER (PARTITION BY axis ORDER BY value) + (count(*) OVER (PARTITION BY axis, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY axis) AS n FROM long)"""
_PAIR_ORDER = "CASE axis " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(AXES)) + " END"
_RHO = f"{_POOL}, ord AS (SELECT *, {_PAIR_ORDER} AS k FROM ranks), rho AS (SELECT p.axis AS a, q.axis AS b, corr(p.r, q.r) AS rho FROM ord p JOIN ord q ON p.row_ix = q.row_ix AND p.k < q.k GROUP BY 1, 2)"
_WIDE = lambda v: ", ".join(f"round(max(CASE WHEN axis = '{a}' THEN {v} END), 6) AS {a}" for a in AXES)
_EVENT_COLS = 'scenario_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(peak AS BIGINT) AS peak, CAST(duration AS BIGINT) AS duration, round(magnitude, 6) AS magnitude, round(severity, 6) AS severity'
_ERA = "regexp_replace(o_orderpriority, '[^0-9A-Z]+', '', 'g')"
# the digamma function, shifted by ten, then its asymptotic series
_DIGAMMA = lambda x: f"ln({x} + 10) - 0.5 / ({x} + 10) - (1 / 12.0 - (1 / 120.0 - (1 / 252.0 - (1 / 240.0 - 1 / 132.0 / pow({x} + 10, 2)) / pow({x} + 10, 2)) / pow({x} + 10, 2)) / pow({x} + 10, 2)) / pow({x} + 10, 2)" + "".join(f" - 1 / ({x} + {i})" for i in range(10))
# the draws in the unit box are numpy's, so their values are given
_UNIT = ", ".join(f"({i}, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in row) + ")" for i, row in enumerate(select.latin_hypercube(SAMPLED[0], 3, SAMPLED[1])))

ORACLES = {
    "daily_panel": f"WITH {_DAILY} SELECT scenario_id, day, round(flow, 4) AS flow FROM daily",
    "monthly_panel": f"WITH {_DAILY} SELECT scenario_id, month, round(mean, 6) AS flow FROM monthly",
    "rolling_accumulation": f"WITH {_TOTALS} SELECT scenario_id, month, round(total, 4) AS total FROM totals",
    "standardized_anomaly": f"WITH {_TOTALS} SELECT scenario_id, month, round(z, 6) AS z FROM z",
    "drought_events": f"WITH {_EVENTS} SELECT {_EVENT_COLS} FROM events",
    "controlling_event": f"WITH {_EVENTS} SELECT {_EVENT_COLS} FROM control",
    "drought_descriptors": f"""WITH {_EVENTS}, tot AS (SELECT scenario_id, count(*) AS n_ev, sum(magnitude) AS deficit FROM events GROUP BY 1), s AS (SELECT scenario_id, max(pos) + 1 AS n FROM z GROUP BY 1),
j AS (SELECT s.scenario_id, s.n, pre.z_pre, c.*, tot.n_ev, tot.deficit, c.start = 0 AND NOT coalesce(pre.z_pre >= 0, FALSE) AS onset, c."end" = s.n - 1 AS term
  FROM s LEFT JOIN pre ON pre.scenario_id = s.scenario_id LEFT JOIN control c ON c.scenario_id = s.scenario_id LEFT JOIN tot ON tot.scenario_id = s.scenario_id)
SELECT scenario_id, coalesce(round(magnitude, 6), 0.0::DOUBLE) AS drought_magnitude, coalesce(CAST(duration AS DOUBLE), 0.0) AS drought_duration, coalesce(round(severity, 6), 0.0::DOUBLE) AS drought_severity,
  coalesce(round(CASE WHEN onset THEN CASE WHEN peak = start THEN 0.0::DOUBLE ELSE (z_start + severity) / (peak - start) END ELSE severity / (peak - start + 1) END, 6), 0.0::DOUBLE) AS drought_development_rate,
  coalesce(round(CASE WHEN term THEN CASE WHEN peak = "end" THEN 0.0::DOUBLE ELSE (z_end + severity) / ("end" - peak) END ELSE severity / ("end" - peak + 1) END, 6), 0.0::DOUBLE) AS drought_termination_rate,
  coalesce(CAST(onset AS DOUBLE), 0.0) AS drought_onset_truncated, coalesce(CAST(term AS DOUBLE), 0.0) AS drought_termination_truncated, coalesce(CAST(n_ev AS DOUBLE), 0.0) AS drought_event_count, coalesce(round(deficit, 6), 0.0::DOUBLE) AS drought_total_deficit FROM j""",
    "pot_pulses": f"WITH {_PULSES} SELECT scenario_id, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, round(peak, 4) AS peak, CAST(peak_pos AS BIGINT) AS peak_pos, days, round(volume, 4) AS volume FROM pulses",
    "flood_descriptors": f"""WITH {_PULSES}, crit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY peak DESC, peak_pos) AS k FROM pulses) WHERE k = 1),
steps AS (SELECT scenario_id, pos, flow - lag(flow) OVER (PARTITION BY scenario_id ORDER BY pos) AS step FROM wet),
rise AS (SELECT c.scenario_id, greatest(max(s.step), 0.0::DOUBLE) AS rise FROM crit c JOIN steps s ON s.scenario_id = c.scenario_id AND s.pos BETWEEN c.lo AND c.peak_pos GROUP BY 1),
tot AS (SELECT scenario_id, count(*) AS n, sum(days) AS d FROM pulses GROUP BY 1), top AS (SELECT scenario_id, max(flow) AS top FROM wet GROUP BY 1)
SELECT t.scenario_id, round(top / mu, 6) AS flood_peak_discharge, coalesce(CAST(c.days AS DOUBLE), 0.0) AS flood_pulse_duration, round(coalesce(rise, 0.0) / mu, 6) AS flood_rise_rate, coalesce(CAST(n AS DOUBLE), 0.0) AS flood_pulse_count,
  coalesce(CAST(d AS DOUBLE), 0.0) AS flood_days_above, round(coalesce(volume, 0.0) / mu, 6) AS flood_pulse_volume
FROM top t LEFT JOIN crit c ON c.scenario_id = t.scenario_id LEFT JOIN tot ON tot.scenario_id = t.scenario_id LEFT JOIN rise r ON r.scenario_id = t.scenario_id, lev""",
    "regime_descriptors": f"""WITH {_SCORED},
short AS (SELECT scenario_id, CASE WHEN count(*) OVER w7 = 7 THEN avg(flow) OVER w7 END AS m7, CASE WHEN count(*) OVER w3 = 3 THEN avg(flow) OVER w3 END AS m3, abs(flow - lag(flow) OVER (PARTITION BY scenario_id ORDER BY pos)) AS step, flow FROM wet
  WINDOW w7 AS (PARTITION BY scenario_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY scenario_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
s AS (SELECT scenario_id, min(m7) AS low7, max(m3) AS high3, sum(step) / sum(flow) AS flash FROM short GROUP BY 1),
mon AS (SELECT scenario_id, month_ix, sum(flow) AS v, count(*) AS d FROM wet GROUP BY 1, 2),
roll AS (SELECT scenario_id, month_ix, CASE WHEN count(*) OVER a = 12 THEN sum(v) OVER a / sum(d) OVER a END AS m12, CASE WHEN count(*) OVER b = 24 THEN sum(v) OVER b / sum(d) OVER b END AS m24 FROM mon
  WINDOW a AS (PARTITION BY scenario_id ORDER BY month_ix ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY scenario_id ORDER BY month_ix ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
l AS (SELECT scenario_id, min(m12) AS low12, min(m24) AS low24, min(m12) FILTER (WHERE (month_ix + 1) % 12 = 0) AS low_year, max(m12) FILTER (WHERE (month_ix + 1) % 12 = 0) AS high_year,
  stddev_samp(m12) FILTER (WHERE (month_ix + 1) % 12 = 0) / avg(m12) FILTER (WHERE (month_ix + 1) % 12 = 0) AS cv FROM roll GROUP BY 1)
SELECT scenario_id, round(low12 / mu, 6) AS lowflow_min_12month, round(low24 / mu, 6) AS lowflow_min_24month, round(low_year / mu, 6) AS lowflow_min_year, round(low7 / mu, 6) AS lowflow_min_7day, round(high3 / mu, 6) AS flood_max_3day,
  round(high_year / mu, 6) AS highflow_max_year, round(cv, 6) AS annual_cv, round(flash, 6) AS flashiness FROM l JOIN s USING (scenario_id), lev""",
    "axis_spread": f"""WITH {_POOL}, mo AS (SELECT axis, avg(value) AS mu, stddev_pop(value) AS std, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM long GROUP BY 1),
sk AS (SELECT axis, avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) AS g FROM long JOIN mo USING (axis) GROUP BY 1),
modal AS (SELECT axis, max(n) / CAST(sum(n) AS DOUBLE) AS f FROM (SELECT axis, round(value, 9) AS v, count(*) AS n FROM long GROUP BY 1, 2) GROUP BY 1)
SELECT axis, round(std, 3) AS std, round(iqr, 3) AS iqr, round(CASE WHEN std > 1e-12 THEN g ELSE 0.0 END, 3) AS skew, round(f, 3) AS modal_frac, std < 1e-9 OR iqr = 0 OR f > 0.95 AS degenerate FROM mo JOIN sk USING (axis) JOIN modal USING (axis)""",
    "spearman_pairs": f"WITH {_RHO} SELECT a, b, round(rho, 6) AS rho FROM rho",
    "redundant_pairs": f"WITH {_RHO} SELECT a, b, round(rho, 6) AS rho FROM rho WHERE abs(rho) >= 0.5",
    "minmax_norm": f"WITH {_POOL} SELECT row_ix, {_WIDE('x')} FROM unit GROUP BY 1",
    "cdf_norm": f"WITH {_POOL} SELECT row_ix, {_WIDE('r / n')} FROM ranks GROUP BY 1",
    "clip_qc": f"WITH {_POOL} SELECT axis, round(max(lo), 4) AS lo, round(max(hi), 4) AS hi, round(avg(CAST(value < lo AS DOUBLE)), 4) AS clipped_low, round(avg(CAST(value > hi AS DOUBLE)), 4) AS clipped_high FROM long JOIN bounds USING (axis) GROUP BY 1",
    "l2_star": f"""WITH {_POOL}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum((1 - a * a) * (1 - b * b) * (1 - c * c)) AS s FROM pts),
d AS (SELECT sum((1 - greatest(p.a, q.a)) * (1 - greatest(p.b, q.b)) * (1 - greatest(p.c, q.c))) AS ss FROM pts p CROSS JOIN pts q)
SELECT round(sqrt(pow(3.0::DOUBLE, -3) - pow(2.0::DOUBLE, -2) / n * s + ss / (n * n)), 6) AS l2_star FROM n, d""",
    "nn_distance": f"WITH {_POOL} SELECT p.row_ix, round(sqrt(min((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c))), 6) AS nn FROM pts p JOIN pts q ON p.row_ix <> q.row_ix GROUP BY 1",
    "ess_kernel": f"""WITH {_POOL}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pts), h AS (SELECT n, 0.33::DOUBLE * pow(n, -1.0::DOUBLE / 3) AS h FROM n),
k AS (SELECT exp(-((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) / (2 * h * h)) AS k, n, h FROM pts p CROSS JOIN pts q, h)
SELECT round(max(n) * max(n) / sum(k), 6) AS ess, round(max(n) / sum(k), 6) AS ess_fraction, round(max(n) * max(n) / sum(k * k), 6) AS participation_ratio, round(max(h), 6) AS bandwidth FROM k""",
    "marginal_gaps": f"""WITH {_POOL}, u AS (SELECT * FROM unit WHERE axis IN ('peak', 'discount', 'quantity') AND row_ix IN (SELECT row_ix FROM tail)),
g AS (SELECT axis, x - coalesce(lag(x) OVER w, 0.0) AS g, CASE WHEN lead(x) OVER w IS NULL THEN 1.0 - x ELSE 0.0 END AS e FROM u WINDOW w AS (PARTITION BY axis ORDER BY x))
SELECT axis, round(max(greatest(g, e)), 6) AS max_gap FROM g GROUP BY 1""",
    "ks_vs_pool": f"""WITH {_POOL}, v AS (SELECT axis, value, count(*) AS n, count(t.row_ix) AS s FROM long l LEFT JOIN tail t ON t.row_ix = l.row_ix GROUP BY 1, 2),
c AS (SELECT axis, abs(sum(n) OVER u / CAST(sum(n) OVER a AS DOUBLE) - sum(s) OVER u / CAST(sum(s) OVER a AS DOUBLE)) AS g FROM v WINDOW u AS (PARTITION BY axis ORDER BY value), a AS (PARTITION BY axis))
SELECT axis, round(max(g), 6) AS ks FROM c GROUP BY 1""",
    "tail_share": f"WITH {_POOL}, p AS (SELECT axis, quantile_cont(value, 0.9) AS q FROM long GROUP BY 1) SELECT axis, round(avg(CAST(value > q AS DOUBLE)), 6) AS tail_share FROM long JOIN p USING (axis) WHERE row_ix IN (SELECT row_ix FROM tail) GROUP BY 1",
    "eps_cell_occupancy": f"""WITH {_POOL}, g AS (SELECT unnest([2, 4, 8]) AS g), c AS (SELECT g, least(CAST(floor(a * g) AS INT), g - 1) AS i, least(CAST(floor(b * g) AS INT), g - 1) AS j, least(CAST(floor(c * g) AS INT), g - 1) AS k, count(*) AS n FROM x, g GROUP BY ALL)
SELECT CAST(g AS BIGINT) AS g, count(*) AS occupied, max(n) AS largest FROM c GROUP BY 1""",
    "nearest_member": f"""WITH {_POOL}, t AS (SELECT CAST(i AS BIGINT) AS target, (i // 4)::DOUBLE AS u, (i // 2 % 2)::DOUBLE AS v, (i % 2)::DOUBLE AS w FROM (SELECT unnest(range(0, 8)) AS i)),
d AS (SELECT target, row_ix, (a - u) * (a - u) + (b - v) * (b - v) + (c - w) * (c - w) AS d2 FROM x, t)
SELECT * FROM (SELECT target, row_ix, round(d2, 6) AS d2, row_number() OVER (PARTITION BY target ORDER BY d.d2, row_ix) AS "rank" FROM d) WHERE "rank" <= 3""",
    "jaccard_pairs": f"""WITH {_POOL}, q AS (SELECT axis, quantile_cont(value, 0.75) AS q FROM long GROUP BY 1), m AS (SELECT axis AS name, row_ix FROM long JOIN q USING (axis) WHERE value > q),
s AS (SELECT name, count(*) AS n FROM m GROUP BY 1), b AS (SELECT p.name AS a, q.name AS b, count(*) AS n FROM m p JOIN m q ON p.row_ix = q.row_ix AND p.name < q.name GROUP BY 1, 2)
SELECT b.a, b.b, round(b.n / CAST(x.n + y.n - b.n AS DOUBLE), 6) AS jaccard FROM b JOIN s x ON x.name = b.a JOIN s y ON y.name = b.b""",
    "participation_ratio": f"WITH {_POOL}, o AS (SELECT *, {_PAIR_ORDER} AS k FROM long), c AS (SELECT corr(p.value, q.value) AS r FROM o p JOIN o q ON p.row_ix = q.row_ix AND p.k < q.k GROUP BY p.axis, q.axis) SELECT round(36.0::DOUBLE / (6 + 2 * sum(r * r)), 6) AS participation_ratio FROM c",
    "envelope_cv_change": f"""WITH f AS (SELECT {_ERA} AS model, CASE WHEN year(o_orderdate) < 1998 THEN '1980_2019' ELSE '2020_2059' END AS era, month(o_orderdate) AS month, stddev_pop(o_totalprice) / avg(o_totalprice) AS cv FROM orders GROUP BY ALL)
SELECT a.model || '_ssp245_' || a.era AS run, CAST(a.month AS BIGINT) AS month, round(a.cv / b.cv, 6) AS factor FROM f a JOIN f b ON a.model = b.model AND a.month = b.month AND b.era = '1980_2019' WHERE a.era = '2020_2059'""",
    "harmonic_fit": """WITH m AS (SELECT o_orderpriority AS run, month(o_orderdate) AS month, avg(o_totalprice) AS mean FROM orders GROUP BY ALL),
p AS (SELECT run, (month + 2) % 12 AS t, ln(mean / avg(mean) OVER (PARTITION BY run)) AS l FROM m),
c AS (SELECT run, sum(l) / 12 AS m, sum(l * cos(t * pi() / 6)) / 6 AS a1, sum(l * sin(t * pi() / 6)) / 6 AS b1, sum(l * cos(t * pi() / 3)) / 6 AS a2, sum(l * sin(t * pi() / 3)) / 6 AS b2 FROM p GROUP BY 1)
SELECT run, round(m, 6) AS m, round(sqrt(a1 * a1 + b1 * b1), 6) AS r1, round(atan2(b1, a1), 6) AS psi1, round(sqrt(a2 * a2 + b2 * b2), 6) AS r2, round(atan2(b2, a2), 6) AS psi2 FROM c""",
    "climate_adjustment": """WITH m AS (SELECT month(o_orderdate) AS month, avg(ln(o_totalprice)) AS mean, stddev_pop(ln(o_totalprice)) AS sd, avg(o_totalprice) FILTER (WHERE year(o_orderdate) >= 1998) / avg(o_totalprice) FILTER (WHERE year(o_orderdate) < 1998) AS a FROM orders GROUP BY 1)
SELECT CAST(month AS BIGINT) AS month, round(mean, 6) AS mean, round(sd, 6) AS sd, round(a, 6) AS a, round(ln(a) + mean + sd * sd / 2 - 0.5 * ln(exp(sd * sd)), 6) AS mean_new, round(sqrt(ln(exp(sd * sd) - 1 + 1)), 6) AS sd_new FROM m""",
    "axis_clusters": f"""WITH RECURSIVE {_RHO}, ax(k, name) AS (VALUES {", ".join(f"({i}, '{a}')" for i, a in enumerate(AXES))}),
near AS (SELECT p.k AS i, q.k AS j, greatest(0.0::DOUBLE, 1 - abs(rho)) AS d FROM rho JOIN ax p ON p.name = rho.a JOIN ax q ON q.name = rho.b), dist AS (SELECT i, j, d FROM near UNION ALL SELECT j, i, d FROM near),
iqr AS (SELECT axis, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM long GROUP BY 1),
st(step, sets) AS (SELECT 0, [{", ".join(str(1 << i) for i in range(len(AXES)))}]
  UNION ALL SELECT p.step + 1, list_transform(list_filter(range(1, len(p.sets) + 1), lambda k: k <> best.y), lambda k: CASE WHEN k = best.x THEN p.sets[best.x] | p.sets[best.y] ELSE p.sets[k] END) FROM st p, LATERAL (
    SELECT x, y, d FROM (SELECT u.x, v.y, avg(dist.d) AS d FROM (SELECT unnest(p.sets) AS m, generate_subscripts(p.sets, 1) AS x) u JOIN (SELECT unnest(p.sets) AS m, generate_subscripts(p.sets, 1) AS y) v ON u.x < v.y
      JOIN dist ON (u.m >> dist.i) & 1 = 1 AND (v.m >> dist.j) & 1 = 1 GROUP BY 1, 2) ORDER BY d, x, y LIMIT 1) best WHERE best.d <= 0.5),
fin AS (SELECT unnest(sets) AS m FROM (SELECT arg_max(sets, step) AS sets FROM st))
SELECT string_agg(name, ',' ORDER BY k) AS members, arg_max(name, iqr) AS representative FROM fin JOIN ax ON (m >> k) & 1 = 1 JOIN iqr ON iqr.axis = ax.name GROUP BY m""",
    "gamma_month_fit": f"""WITH RECURSIVE {_DAILY}, acc AS (SELECT * FROM (SELECT month, sum(mean) OVER w AS total, count(*) OVER w AS n FROM monthly WINDOW w AS (PARTITION BY scenario_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE n = 6),
law AS (SELECT month(month) AS cm, avg(total) AS mu, ln(avg(total)) - avg(ln(total)) AS s FROM acc GROUP BY 1),
half(k, cm, s, lo, hi) AS (SELECT 0, cm, s, 1e-8::DOUBLE, 1e12::DOUBLE FROM law
  UNION ALL SELECT k + 1, cm, s, CASE WHEN above THEN mid ELSE lo END, CASE WHEN above THEN hi ELSE mid END FROM (SELECT *, ln(mid) - ({_DIGAMMA("mid")}) > s AS above FROM (SELECT *, sqrt(lo * hi) AS mid FROM half WHERE k < 64)))
SELECT CAST(law.cm AS BIGINT) AS cal_month, round(sqrt(lo * hi), 6) AS shape, round(mu / sqrt(lo * hi), 3) AS scale FROM half JOIN law USING (cm) WHERE k = 64""",
    "sampled_forcing": f"""WITH m AS (SELECT o_orderpriority AS run, month(o_orderdate) AS month, avg(o_totalprice) AS mean FROM orders GROUP BY ALL),
p AS (SELECT run, (month + 2) % 12 AS t, ln(mean / avg(mean) OVER (PARTITION BY run)) AS l FROM m),
c AS (SELECT run, sum(l) / 12 AS m, sqrt(pow(sum(l * cos(t * pi() / 6)) / 6, 2) + pow(sum(l * sin(t * pi() / 6)) / 6, 2)) AS r1, sqrt(pow(sum(l * cos(t * pi() / 3)) / 6, 2) + pow(sum(l * sin(t * pi() / 3)) / 6, 2)) AS r2 FROM p GROUP BY 1),
b AS (SELECT {", ".join(f"quantile_cont({k}, {q}) AS {k}{n}" for k in ("m", "r1", "r2") for q, n in ((0.05, "lo"), (0.95, "hi")))} FROM c),
g AS (SELECT t, avg(l) AS l FROM p GROUP BY 1), f AS (SELECT atan2(sum(l * sin(t * pi() / 6)), sum(l * cos(t * pi() / 6))) AS psi1, atan2(sum(l * sin(t * pi() / 3)), sum(l * cos(t * pi() / 3))) AS psi2 FROM g),
u(theta_ix, u0, u1, u2) AS (VALUES {_UNIT}),
x AS (SELECT theta_ix::BIGINT AS theta_ix, mlo + u0 * (mhi - mlo) AS m, r1lo + u1 * (r1hi - r1lo) AS r1, r2lo + u2 * (r2hi - r2lo) AS r2, psi1, psi2 FROM u, b, f),
y AS (SELECT *, unnest(range(0, 12)) AS t FROM x)
SELECT theta_ix, round(m, 6) AS m, round(r1, 6) AS r1, round(r2, 6) AS r2, round(psi1, 6) AS psi1, round(psi2, 6) AS psi2,
  string_agg(printf('%.6f', greatest(exp(m + r1 * cos(t * pi() / 6 - psi1) + r2 * cos(t * pi() / 3 - psi2)), 0.2::DOUBLE)), ',' ORDER BY t) AS profile FROM y GROUP BY theta_ix, m, r1, r2, psi1, psi2""",
    "mst_edges": f"""WITH RECURSIVE {_POOL}, e AS (SELECT p.row_ix AS u, q.row_ix AS v, (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c) AS d2 FROM pts p JOIN pts q ON p.row_ix < q.row_ix),
f AS (SELECT u AS x, v AS y, d2 FROM e UNION ALL SELECT v, u, d2 FROM e),
reach(u, v, d2, node) AS (SELECT u, v, d2, u FROM e UNION SELECT r.u, r.v, r.d2, f.y FROM reach r JOIN f ON f.x = r.node AND f.d2 < r.d2)
SELECT u AS row_a, v AS row_b, round(sqrt(d2), 6) AS length FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.u = e.u AND r.v = e.v AND r.node = e.v)""",
    "maximin_selection": f"""WITH RECURSIVE {_POOL}, num AS (SELECT row_number() OVER (ORDER BY row_ix) - 1 AS r, a, b, c FROM x), mid AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c, greatest(3, count(*) // 20) AS n FROM num),
far AS (SELECT r, row_number() OVER (ORDER BY (num.a - mid.a) * (num.a - mid.a) + (num.b - mid.b) * (num.b - mid.b) + (num.c - mid.c) * (num.c - mid.c) DESC, r) AS k FROM num, mid),
pick(k, taken) AS (SELECT 1::BIGINT, [r] FROM far WHERE k = 1
  UNION ALL SELECT p.k + 1, list_append(p.taken, best.r) FROM pick p, mid, LATERAL (
    SELECT arg_max(t.r, {{'d': t.d, 'i': -t.r}}) AS r FROM (SELECT n.r, min((n.a - o.a) * (n.a - o.a) + (n.b - o.b) * (n.b - o.b) + (n.c - o.c) * (n.c - o.c)) AS d FROM num n JOIN num o ON list_contains(p.taken, o.r) WHERE NOT list_contains(p.taken, n.r) GROUP BY n.r) t) best
  WHERE p.k < mid.n)
SELECT unnest(taken) AS row_ix FROM pick, mid WHERE k = n""",
    "nearest_summary": f"""WITH {_POOL}, nn AS (SELECT p.row_ix, sqrt(min((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c))) AS nn FROM pts p JOIN pts q ON p.row_ix <> q.row_ix GROUP BY 1)
SELECT round(avg(nn), 6) AS nn_mean, round(stddev_pop(nn), 6) AS nn_std, round(min(nn), 6) AS nn_min, round(max(nn), 6) AS nn_max, round(stddev_pop(nn) / avg(nn), 6) AS nn_cv FROM nn""",
    "ks_to_uniform": f"""WITH {_POOL}, u AS (SELECT axis, x, row_number() OVER (PARTITION BY axis ORDER BY x, row_ix) AS i, count(*) OVER (PARTITION BY axis) AS n FROM unit WHERE axis IN ('peak', 'discount', 'quantity') AND row_ix IN (SELECT row_ix FROM tail))
SELECT axis, round(max(greatest(i / n::DOUBLE - x, x - (i - 1) / n::DOUBLE)), 6) AS ks_to_uniform FROM u GROUP BY 1""",
    "corner_share": f"WITH {_POOL}, p AS (SELECT axis, quantile_cont(value, 0.9) AS q FROM long GROUP BY 1), s AS (SELECT row_ix, max(CAST(value > q AS DOUBLE)) AS any_ FROM long JOIN p USING (axis) WHERE row_ix IN (SELECT row_ix FROM tail) GROUP BY 1) SELECT round(avg(any_), 6) AS corner_share FROM s",
    "face_share": f"WITH {_POOL}, s AS (SELECT row_ix, max(CAST(value < lo OR value > hi AS DOUBLE)) AS any_ FROM long JOIN bounds USING (axis) WHERE row_ix IN (SELECT row_ix FROM tail) GROUP BY 1) SELECT round(avg(any_), 6) AS face_share FROM s",
    "axis_histogram": f"""WITH {_POOL}, span AS (SELECT axis, min(value) AS least, (max(value) - min(value)) / 10 AS width FROM long GROUP BY 1),
b AS (SELECT axis, CAST(CASE WHEN width > 0 THEN least(floor((value - span.least) / width), 9) ELSE 0 END AS BIGINT) AS bin, span.least AS low, width, CAST(row_ix IN (SELECT row_ix FROM tail) AS BIGINT) AS s FROM long JOIN span USING (axis))
SELECT axis, bin, round(low + bin * width, 6) AS lo, count(*) AS n, sum(s)::BIGINT AS selected FROM b GROUP BY axis, bin, low, width""",
    "selection_profile": f"""WITH {_POOL}, v AS (SELECT axis, value, count(*) AS n, count(t.row_ix) AS s FROM long l LEFT JOIN tail t ON t.row_ix = l.row_ix GROUP BY 1, 2),
c AS (SELECT axis, abs(sum(n) OVER u / CAST(sum(n) OVER a AS DOUBLE) - sum(s) OVER u / CAST(sum(s) OVER a AS DOUBLE)) AS g FROM v WINDOW u AS (PARTITION BY axis ORDER BY value), a AS (PARTITION BY axis)),
ks AS (SELECT axis, max(g) AS ks FROM c GROUP BY 1), p AS (SELECT axis, quantile_cont(value, 0.9) AS q, median(value) AS m FROM long GROUP BY 1),
s AS (SELECT axis, avg(CAST(value > q AS DOUBLE)) AS tail_share, median(value) / (max(m) + 1e-12::DOUBLE) AS median_ratio FROM long JOIN p USING (axis) WHERE row_ix IN (SELECT row_ix FROM tail) GROUP BY 1)
SELECT axis, round(ks, 6) AS ks, round(tail_share, 6) AS tail_share, round(median_ratio, 6) AS median_ratio FROM ks JOIN s USING (axis)""",
    "selection_correlation": f"""WITH {_POOL}, mine AS (SELECT * FROM long WHERE row_ix IN (SELECT row_ix FROM tail)),
k AS (SELECT row_ix, axis, rank() OVER (PARTITION BY axis ORDER BY value) + (count(*) OVER (PARTITION BY axis, value) - 1) / 2.0::DOUBLE AS r FROM mine),
c AS (SELECT abs(corr(p.r, q.r)) AS r FROM k p JOIN k q ON p.row_ix = q.row_ix AND p.axis < q.axis GROUP BY p.axis, q.axis)
SELECT round(avg(r), 6) AS mean_abs_rho FROM c""",
    "per_axis_metrics": f"""WITH {_POOL}, u AS (SELECT axis, x, row_ix, row_number() OVER w AS i, count(*) OVER (PARTITION BY axis) AS n, x - coalesce(lag(x) OVER w, 0.0) AS step, CASE WHEN lead(x) OVER w IS NULL THEN 1.0 - x ELSE 0.0 END AS last
  FROM unit WHERE axis IN ('peak', 'discount', 'quantity') AND row_ix IN (SELECT row_ix FROM tail) WINDOW w AS (PARTITION BY axis ORDER BY x, row_ix)),
m AS (SELECT axis, max(greatest(i / n::DOUBLE - x, x - (i - 1) / n::DOUBLE)) AS ks_to_uniform, max(greatest(step, last)) AS max_gap,
  sqrt(1 / 3.0::DOUBLE - sum(1 - x * x) / max(n) + sum((1 - x) * (2 * i - 1)) / (max(n) * max(n)::DOUBLE)) AS star_1d FROM u GROUP BY 1),
p AS (SELECT axis, quantile_cont(value, 0.9) AS q FROM long GROUP BY 1), t AS (SELECT axis, avg(CAST(value > q AS DOUBLE)) AS tail_share FROM long JOIN p USING (axis) WHERE row_ix IN (SELECT row_ix FROM tail) GROUP BY 1)
SELECT axis, round(ks_to_uniform, 6) AS ks_to_uniform, round(star_1d, 6) AS star_1d, round(max_gap, 6) AS max_gap, round(tail_share, 6) AS tail_share FROM m JOIN t USING (axis)""",
    "pair_grid": f"""WITH {_POOL}, span AS (SELECT axis, min(value) AS least, (max(value) - min(value)) / 10 AS width FROM long GROUP BY 1),
b AS (SELECT l.row_ix, axis, {_PAIR_ORDER} AS k, CAST(CASE WHEN width > 0 THEN least(floor((value - span.least) / width), 9) ELSE 0 END AS BIGINT) AS bin FROM long l JOIN span USING (axis))
SELECT p.axis AS a, q.axis AS b, p.bin AS bin_a, q.bin AS bin_b, count(*) AS n, count(t.row_ix) AS selected FROM b p JOIN b q ON p.row_ix = q.row_ix AND p.k < q.k LEFT JOIN tail t ON t.row_ix = p.row_ix GROUP BY ALL""",
    "uniform_null": f"""WITH {_POOL}, n AS (SELECT count(*) AS n FROM tail), spot AS (SELECT d AS draw, unnest(range(0, n)) AS point, n FROM (SELECT unnest(range(0, 20)) AS d), n),
u AS (SELECT draw, point, n, {", ".join(f"CAST(CAST('0x' || substr(md5('5,' || draw || ',' || point || ',{k}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u{k}" for k in range(3))} FROM spot),
s AS (SELECT draw, max(n)::DOUBLE AS n, sum((1 - u0 * u0) * (1 - u1 * u1) * (1 - u2 * u2)) AS s FROM u GROUP BY 1),
p AS (SELECT x.draw, sum((1 - greatest(x.u0, y.u0)) * (1 - greatest(x.u1, y.u1)) * (1 - greatest(x.u2, y.u2))) AS ss FROM u x JOIN u y USING (draw) GROUP BY 1)
SELECT draw, round(sqrt(pow(3.0::DOUBLE, -3) - pow(2.0::DOUBLE, -2) / n * s + ss / (n * n)), 6) AS l2_star FROM s JOIN p USING (draw)""",
    "eps_cell_members": f"""WITH RECURSIVE {_POOL}, num AS (SELECT row_number() OVER (ORDER BY row_ix) - 1 AS r, a, b, c FROM x), need AS (SELECT greatest(3, count(*) // 20) AS n FROM num),
cell AS (SELECT g, r, least(CAST(floor(a * g) AS BIGINT), g - 1) AS i, least(CAST(floor(b * g) AS BIGINT), g - 1) AS j, least(CAST(floor(c * g) AS BIGINT), g - 1) AS k, a, b, c FROM num, (SELECT unnest(range(1, 257)) AS g)),
occ AS (SELECT g, count(*) AS n FROM (SELECT DISTINCT g, i, j, k FROM cell) GROUP BY 1),
twice(g) AS (SELECT 2::BIGINT UNION ALL SELECT t.g * 2 FROM twice t JOIN occ USING (g), need WHERE occ.n < need.n),
half(lo, hi) AS (SELECT 1::BIGINT, max(g) FROM twice UNION ALL SELECT CASE WHEN occ.n >= need.n THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN occ.n >= need.n THEN (lo + hi) // 2 ELSE hi END FROM half JOIN occ ON occ.g = (lo + hi) // 2, need WHERE lo < hi),
mine AS (SELECT * FROM cell WHERE g = (SELECT hi FROM half WHERE lo = hi)),
best AS (SELECT g, i, j, k, arg_min(r, {{'d': (((i + 0.5::DOUBLE) / g) - a) * (((i + 0.5::DOUBLE) / g) - a) + (((j + 0.5::DOUBLE) / g) - b) * (((j + 0.5::DOUBLE) / g) - b) + (((k + 0.5::DOUBLE) / g) - c) * (((k + 0.5::DOUBLE) / g) - c), 'r': r}}) AS row_ix FROM mine GROUP BY g, i, j, k)
SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS k, row_ix, g FROM best""",
    "not_selected": f"WITH {_POOL} SELECT row_ix FROM pool WHERE row_ix NOT IN (SELECT row_ix FROM tail)",
    "resampled_months": """WITH m AS (SELECT l_suppkey AS scenario_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, max(l_extendedprice) AS flow FROM lineitem GROUP BY ALL),
s AS (SELECT scenario_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m GROUP BY 1)
SELECT s.scenario_id, CAST(s.month AS DATE) AS month, round(flow, 6) AS flow FROM s LEFT JOIN m ON m.scenario_id = s.scenario_id AND m.month = CAST(s.month AS DATE)""",
}
