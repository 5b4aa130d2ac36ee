"""Reference SQL of the data products, for an engine that reads the same tables.

Written independently of the DataFrame plans: plain joins, windows and
``CASE`` on the raw tables. Doubles are compared in the stored form of
``catalog.as_stored``.
"""

from __future__ import annotations

import math

from cellweave.plans import carbonate_sql as eq

SQL: dict[str, str] = {}

# The thickness of each layer, whole and down to 100 m.
THICKNESS = (
    "CASE WHEN depth = 0 THEN 2.5 WHEN depth < 80 THEN 5 WHEN depth = 80 THEN 7.5 "
    "WHEN depth = 90 THEN 10 WHEN depth = 100 THEN 15 WHEN depth < 300 THEN 20 ELSE 10 END"
)
THICKNESS_TOP = (
    "CASE WHEN depth = 0 THEN 2.5 WHEN depth < 80 THEN 5 WHEN depth = 80 THEN 7.5 "
    "WHEN depth < 100 THEN 10 ELSE 5 END"
)


def area(lat: str) -> str:
    scale = 6378137.0**2 * (1.0 - 0.00669437999014) * (math.pi / 180.0 * 0.125) ** 2
    w = f"(1e0 - 0.00669437999014e0 * sin(radians({lat})) * sin(radians({lat})))"
    return f"({scale!r}::DOUBLE * cos(radians({lat})) / ({w} * {w}))"


# The study boxes.
BOXES = (
    "(VALUES ('Local', -127e0, -115e0, 27.5e0, 37.5e0), ('CCS', -140e0, -110e0, 22.5e0, 47.5e0), "
    "('NE Pacific', -155e0, -95e0, 10e0, 60e0)) AS b(region, x0, x1, y0, y1)"
)
IN_BOX = "lat BETWEEN y0 AND y1 AND lon BETWEEN x0 AND x1"

BASE = {
    "li": """SELECT l_returnflag AS phase, l_linestatus AS scenario, l_suppkey AS cell,
        CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 40 WHEN 3 THEN 80 WHEN 4 THEN 90
            WHEN 5 THEN 100 WHEN 6 THEN 200 WHEN 7 THEN 300 END::DOUBLE AS depth,
        strftime(l_shipdate, '%Y-%m') AS time, l_quantity AS q, l_extendedprice AS p,
        l_discount AS d, l_tax AS t FROM lineitem""",
    "treated": """SELECT phase, cell, depth, time, avg(q) AS alk, avg(p) / 1000 AS dic
        FROM li WHERE scenario = 'O' GROUP BY ALL""",
    "control": """SELECT cell, depth, time, avg(q) AS alk_con, avg(p) / 1000 AS dic_con
        FROM li WHERE scenario = 'F' GROUP BY ALL""",
    "pair": """SELECT tr.*, alk_con, dic_con, alk - alk_con AS dta, dic - dic_con AS ddic
        FROM treated tr LEFT JOIN control USING (cell, depth, time)""",
    "months": """SELECT phase, time,
        CAST(dense_rank() OVER (PARTITION BY phase ORDER BY time) AS INTEGER) AS month
        FROM (SELECT DISTINCT phase, time FROM treated)""",
    "area": f"""SELECT *, {area('lat')} AS area FROM (
        SELECT s_suppkey AS cell, 5 + (s_suppkey * 37 % 481) / 8.0e0 AS lat,
        -160 + (s_suppkey * 53 % 561) / 8.0e0 AS lon FROM supplier)""",
    "surf_t": """SELECT phase, cell, time, 30 * avg(round(d * 100)) AS hbls,
        avg(q) FILTER (WHERE depth = 0) AS alk, avg(p) FILTER (WHERE depth = 0) / 1000 AS dic
        FROM li WHERE scenario = 'O' GROUP BY ALL""",
    "surf": """SELECT s.phase, s.cell, s.time, hbls, s.alk - c.alk_con AS dta,
        s.dic - c.dic_con AS ddic, s.alk - c.alk_con AS dfg,
        (s.alk - c.alk_con) - (s.dic - c.dic_con) AS alk_pot,
        (s.dic - s.alk) - (c.dic_con - c.alk_con) AS ddpco2
        FROM surf_t s LEFT JOIN control c ON c.cell = s.cell AND c.time = s.time AND c.depth = 0""",
    "surf24": """SELECT s.*, month, lat, lon, area,
        dfg * area * day(last_day((time || '-01')::DATE)) * 86400 / 1000 AS co2_uptake
        FROM surf s JOIN months USING (phase, time) LEFT JOIN area USING (cell)
        WHERE month <= 24""",
    "wind": "SELECT cell, time, 100 * avg(t) AS wind_speed FROM li GROUP BY ALL",
    "points": """SELECT c_custkey AS cell, 5 + (c_custkey * 37 % 481) / 8.0e0 AS lat,
        -160 + (c_custkey * 53 % 561) / 8.0e0 AS lon, c_acctbal AS value FROM customer""",
    "mol": f"""SELECT p.*, lat, lon, dta * (area * ({THICKNESS})) / 1000 AS dta_mol,
        ddic * (area * ({THICKNESS})) / 1000 AS ddic_mol
        FROM pair p LEFT JOIN area USING (cell)""",
    "colm": f"""SELECT p.*, dta * ({THICKNESS}) AS dta_mol, ddic * ({THICKNESS}) AS ddic_mol
        FROM pair p""",
    "series_q": """SELECT phase, time, coalesce(sum(dta_mol), 0) AS dta_sum,
        coalesce(sum(ddic_mol), 0) AS ddic_sum FROM colm GROUP BY ALL""",
    "series": """SELECT *, ddic_sum / nullif(dta_sum, 0) AS cdr_eff,
        CAST(row_number() OVER (PARTITION BY phase ORDER BY time) AS INTEGER) AS month
        FROM series_q""",
    "layer_q": """SELECT phase, depth, time, coalesce(sum(dta * area / 1000), 0) AS dta_sum,
        coalesce(sum(ddic * area / 1000), 0) AS ddic_sum
        FROM pair LEFT JOIN area USING (cell) GROUP BY ALL""",
    "layer": "SELECT *, ddic_sum / nullif(dta_sum, 0) AS cdr_eff FROM layer_q",
    "layer24": """SELECT l.*, month,
        avg(dta_sum) OVER w AS dta_mean, avg(ddic_sum) OVER w AS ddic_mean,
        avg(CASE WHEN cdr_eff BETWEEN 0 AND 1 THEN cdr_eff END) OVER w AS cdr_effmean
        FROM layer l JOIN months USING (phase, time) WHERE month <= 24
        WINDOW w AS (PARTITION BY month, depth)""",
    "bins": """SELECT depth, (coalesce(lag(depth) OVER o, 0) + depth) / 2 AS depth_upper,
        (coalesce(lead(depth) OVER o, max(depth) OVER ()) + depth) / 2 AS depth_lower
        FROM (SELECT DISTINCT depth FROM treated) WINDOW o AS (ORDER BY depth)""",
    "col_q": f"""SELECT phase, cell, time, coalesce(sum(dta * ({THICKNESS})), 0) AS dta_column,
        coalesce(sum(ddic * ({THICKNESS})), 0) AS ddic_column,
        avg((ddic * ({THICKNESS})) / nullif(dta * ({THICKNESS}), 0)) AS cdreff_avg
        FROM pair GROUP BY ALL""",
    "col": "SELECT *, ddic_column / nullif(dta_column, 0) AS cdreff_col FROM col_q",
    "top_q": f"""SELECT phase, cell, time, coalesce(sum(dta * ({THICKNESS_TOP})), 0) AS dta_column,
        coalesce(sum(ddic * ({THICKNESS_TOP})), 0) AS ddic_column,
        avg((ddic * ({THICKNESS_TOP})) / nullif(dta * ({THICKNESS_TOP}), 0)) AS cdreff_avg
        FROM pair WHERE depth <= 100 GROUP BY ALL""",
    "top": "SELECT *, ddic_column / nullif(dta_column, 0) AS cdreff_col FROM top_q",
    "mix24": """SELECT s.phase, s.cell, s.time, hbls, month
        FROM surf_t s JOIN months USING (phase, time) WHERE month <= 24""",
    "mixmax": """SELECT phase, cell, hbls, month, time FROM (SELECT *, row_number() OVER
        (PARTITION BY phase, cell ORDER BY hbls DESC, month) AS rn FROM mix24) WHERE rn = 1""",
    "sst": """SELECT region, yr_mon, avg(value) AS sst_mean FROM (
        SELECT o_orderpriority AS region, o_totalprice / 1000 AS value,
        strftime(o_orderdate, '%Y-%m-15') AS yr_mon FROM orders
        WHERE o_orderpriority <> '3-MEDIUM' OR o_totalprice >= 20000) GROUP BY ALL""",
    "anom": """SELECT *, sst_mean - sst_clim AS sst_anom FROM (SELECT *,
        CAST(substr(yr_mon, 6, 2) AS INTEGER) AS moy,
        avg(sst_mean) OVER (PARTITION BY region, substr(yr_mon, 6, 2)) AS sst_clim FROM sst)""",
    "t50": """SELECT o_orderpriority AS region, strftime(o_orderdate, '%Y-%m-15') AS yr_mon,
        avg(o_totalprice / 10000) AS t50_mean FROM orders GROUP BY ALL""",
    "iso": """SELECT o_orderpriority AS region, strftime(o_orderdate, '%Y-%m-15') AS yr_mon,
        avg(l_quantity) AS depth_26_mean, avg(l_discount) * 100 AS salt_26_mean
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL""",
    "metric_wide": "SELECT * FROM t50 FULL JOIN iso USING (region, yr_mon)",
    "metrics": """SELECT region, yr_mon, 't50' AS metric, t50_mean AS metric_mean FROM metric_wide
        UNION ALL SELECT region, yr_mon, 'depth26', depth_26_mean FROM metric_wide
        UNION ALL SELECT region, yr_mon, 'salt26', salt_26_mean FROM metric_wide""",
    "metric_anom": """SELECT *, metric_mean - metric_clim AS metric_anom FROM (SELECT *,
        CAST(substr(yr_mon, 6, 2) AS INTEGER) AS moy,
        CASE WHEN count(metric_mean) OVER w = count(*) OVER w THEN avg(metric_mean) OVER w END
        AS metric_clim FROM metrics
        WINDOW w AS (PARTITION BY region, metric, substr(yr_mon, 6, 2)))""",
    "chunk": """SELECT 'run_' || label::VARCHAR AS file, CAST(vec_id AS INTEGER) AS time,
        CAST((i - 1) // 8 AS INTEGER) AS eta, CAST((i - 1) % 8 AS INTEGER) AS xi,
        embedding[i]::DOUBLE AS alk, embedding[65 - i]::DOUBLE AS dic
        FROM embeddings, range(1, 65) r(i)""",
    "drivers": f"""SELECT u.region, u.phase, u.month, u.time, co2_upsum, alk_pot_mean, wind_avg,
        ddpco2_mean, co3prox_mean FROM
        (SELECT region, phase, month, time, coalesce(sum(co2_uptake), 0) AS co2_upsum
            FROM surf24 JOIN {BOXES} ON {IN_BOX} GROUP BY ALL) u
        LEFT JOIN (SELECT region, phase, time, avg(alk_pot) AS alk_pot_mean
            FROM surf24 JOIN {BOXES} ON {IN_BOX} GROUP BY ALL) a USING (region, phase, time)
        LEFT JOIN (SELECT region, time, avg(wind_speed) AS wind_avg
            FROM wind JOIN area USING (cell) JOIN {BOXES} ON {IN_BOX} GROUP BY ALL) w
            USING (region, time)
        LEFT JOIN (SELECT region, phase, time, avg(ddpco2) AS ddpco2_mean
            FROM surf24 JOIN {BOXES} ON {IN_BOX} GROUP BY ALL) g USING (region, phase, time)
        LEFT JOIN (SELECT region, time, avg(alk_con - dic_con) AS co3prox_mean
            FROM control JOIN area USING (cell) JOIN {BOXES} ON {IN_BOX}
            WHERE depth = 0 GROUP BY ALL) c USING (region, time)""",
}


def stored(expression: str) -> str:
    return f"CAST(CAST(round_even({expression} * 1e9, 0) / 1e9 AS FLOAT) AS DOUBLE) + 0.0"


def oracle(name: str, query: str, exact: str, doubles: str, extra: dict | None = None) -> None:
    """Register ``query`` with its key columns and its double columns in stored form."""
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in {**BASE, **(extra or {})}.items())
    columns = exact.split() + [f"{stored(c)} AS {c}" for c in doubles.split()]
    SQL[name] = f"WITH {ctes}\nSELECT {', '.join(columns)} FROM ({query}) AS result"


# --- scenario differences -------------------------------------------------------------

UNTIL = "(phase <> 'N' OR time <= '1998-05')"
oracle("scenario_difference_native", f"SELECT * FROM pair WHERE alk IS NOT NULL AND {UNTIL}",
       "phase cell time", "depth dta ddic")
oracle("scenario_difference_regridded", f"SELECT * FROM pair WHERE {UNTIL}",
       "phase cell time", "depth dta ddic")
oracle("surface_flux_difference", """SELECT s.*, alk AS fg_co2_oae, alk_con AS fg_co2,
       alk - alk_con AS dfg FROM surf_t s
       LEFT JOIN (SELECT * FROM control WHERE depth = 0) USING (cell, time)""",
       "phase cell time", "hbls fg_co2_oae fg_co2 dfg")
oracle("induced_pco2_gradient", """SELECT phase, cell, time, dic - alk AS dpco2_oae,
       dic_con - alk_con AS dpco2_con, (dic - alk) - (dic_con - alk_con) AS ddpco2 FROM surf_t
       LEFT JOIN (SELECT * FROM control WHERE depth = 0) USING (cell, time)""",
       "phase cell time", "dpco2_oae dpco2_con ddpco2")
oracle("control_carbonate_proxy",
       "SELECT cell, time, alk_con - dic_con AS co3_prox FROM control WHERE depth = 0",
       "cell time", "co3_prox")
oracle("grid_containment", """SELECT *, difference / nullif(dta_sum_whole, 0) AS share_missing
       FROM (SELECT phase, time, coalesce(sum(dta_mol), 0) AS dta_sum_whole,
       coalesce(sum(dta_mol) FILTER (WHERE inside), 0) AS dta_sum_part,
       coalesce(sum(dta_mol), 0) - coalesce(sum(dta_mol) FILTER (WHERE inside), 0) AS difference
       FROM (SELECT *, lat BETWEEN 10 AND 60 AND lon BETWEEN -155 AND -95 AS inside FROM mol)
       GROUP BY ALL HAVING bool_or(inside))""",
       "phase time", "dta_sum_whole dta_sum_part difference share_missing")
oracle("two_grid_containment", """SELECT *, dta_sum_whole - dta_sum_part AS difference,
       (dta_sum_whole - dta_sum_part) / nullif(dta_sum_whole, 0) AS share_missing FROM
       (SELECT phase, time, coalesce(sum(dta_mol), 0) AS dta_sum_whole FROM mol GROUP BY ALL) a JOIN
       (SELECT phase, time, coalesce(sum(dta_mol), 0) AS dta_sum_part FROM mol
           WHERE lat BETWEEN 10 AND 60 AND lon BETWEEN -155 AND -95 GROUP BY ALL) b
       USING (phase, time)""",
       "phase time", "dta_sum_whole dta_sum_part difference share_missing")
oracle("cumulative_surface_alkalinity", """SELECT sum(a.alk - b.alk) AS dta_total FROM
       (SELECT cell, depth, time, avg(q) AS alk FROM li
           WHERE scenario = 'O' AND depth < 100 GROUP BY ALL) a
       FULL JOIN (SELECT cell, depth, time, avg(q) AS alk FROM li
           WHERE scenario = 'F' AND depth < 100 GROUP BY ALL) b USING (cell, depth, time)""",
       "", "dta_total")

# --- integrals ------------------------------------------------------------------------

oracle("cell_moles_native", "SELECT *, ddic_mol / nullif(dta_mol, 0) AS cdr_eff FROM mol",
       "phase cell time", "depth dta_mol ddic_mol cdr_eff")
oracle("domain_integral_native", """SELECT a.phase, a.time, dta_sum, ddic_sum,
       ddic_sum / nullif(dta_sum, 0) AS cdr_eff FROM
       (SELECT phase, time, coalesce(sum(dta_mol), 0) AS dta_sum FROM mol GROUP BY ALL) a JOIN
       (SELECT phase, time, coalesce(sum(ddic_mol), 0) AS ddic_sum FROM mol GROUP BY ALL) b
       USING (phase, time)""",
       "phase time", "dta_sum ddic_sum cdr_eff")
oracle("cell_moles_per_metre", """SELECT *, dta * area / 1000 AS dta_m, ddic * area / 1000 AS ddic_m
       FROM pair LEFT JOIN area USING (cell)""",
       "phase cell time", "depth area dta_m ddic_m")
oracle("depth_layer_integral", "SELECT * FROM layer",
       "phase time", "depth dta_sum ddic_sum cdr_eff")
oracle("full_depth_integral", "SELECT * FROM series", "phase time", "dta_sum ddic_sum cdr_eff")
oracle("column_integral_full", "SELECT * FROM col",
       "phase cell time", "dta_column ddic_column cdreff_avg cdreff_col")
oracle("column_integral_top100", "SELECT * FROM top",
       "phase cell time", "dta_column ddic_column cdreff_avg cdreff_col")

# --- drivers of the uptake ------------------------------------------------------------

oracle("regional_wind", f"""SELECT region, time, avg(wind_speed) AS wind_avg
       FROM wind JOIN area USING (cell) JOIN {BOXES} ON {IN_BOX} GROUP BY ALL
       UNION ALL SELECT 'Domain', time, avg(wind_speed) FROM wind GROUP BY ALL""",
       "region time", "wind_avg")
oracle("unused_alkalinity", f"""SELECT region, phase, month, time, avg(alk_pot) AS alk_pot_mean
       FROM surf24 JOIN {BOXES} ON {IN_BOX} GROUP BY ALL
       UNION ALL SELECT 'Domain', phase, month, time, avg(alk_pot) FROM surf24 GROUP BY ALL""",
       "region phase month time", "alk_pot_mean")
oracle("cell_uptake", "SELECT * FROM surf24", "phase cell time month", "lat lon co2_uptake")
oracle("regional_uptake", f"""SELECT region, phase, month, time,
       coalesce(sum(co2_uptake), 0) AS co2_upsum FROM surf24 JOIN {BOXES} ON {IN_BOX}
       GROUP BY ALL""",
       "region phase month time", "co2_upsum")
oracle("cumulative_uptake", """SELECT u.*, ddic_sum, co2_sum_cum / nullif(ddic_sum, 0) AS fraction
       FROM (SELECT *, sum(co2_sum_ind) OVER (PARTITION BY phase ORDER BY month) AS co2_sum_cum
           FROM (SELECT phase, month, coalesce(sum(co2_uptake), 0) AS co2_sum_ind
               FROM surf24 GROUP BY ALL)) u
       LEFT JOIN (SELECT phase, row_number() OVER (PARTITION BY phase ORDER BY time) AS month,
           ddic_sum FROM (SELECT phase, time, coalesce(sum(ddic_mol), 0) AS ddic_sum
               FROM mol GROUP BY ALL)) d USING (phase, month)""",
       "phase month", "co2_sum_ind co2_sum_cum ddic_sum fraction")
oracle("regional_gradient", f"""SELECT region, phase, month, time, avg(ddpco2) AS ddpco2_mean
       FROM surf24 JOIN {BOXES} ON {IN_BOX} GROUP BY ALL""",
       "region phase month time", "ddpco2_mean")
oracle("regional_proxy", f"""SELECT region, time, avg(alk_con - dic_con) AS co3prox_mean
       FROM control JOIN area USING (cell) JOIN {BOXES} ON {IN_BOX} WHERE depth = 0 GROUP BY ALL""",
       "region time", "co3prox_mean")
MEASURES = "co2_upsum alk_pot_mean wind_avg ddpco2_mean co3prox_mean"
oracle("driver_table", "SELECT * FROM drivers", "region phase month time", MEASURES)
WEIGHTED = """SELECT s.phase, m.month, lat, lon, dta, alk_pot, ddpco2, wind_speed,
       alk_pot * area / 1000 AS w,
       dta * area * day(last_day((s.time || '-01')::DATE)) * 86400 / 1000 AS co2_uptake FROM
       (SELECT tr.phase, tr.cell, tr.time, tr.alk - se.alk AS dta,
           (tr.alk - se.alk) - (tr.dic - se.dic) AS alk_pot,
           (tr.dic - tr.alk) - (se.dic - se.alk) AS ddpco2
           FROM (SELECT * FROM treated WHERE depth = 0) tr LEFT JOIN
           (SELECT cell, substr(time, 6) AS season, avg(q) AS alk, avg(p) / 1000 AS dic FROM li
               WHERE scenario = 'F' AND depth = 0 GROUP BY ALL) se
           ON se.cell = tr.cell AND se.season = substr(tr.time, 6)) s
       JOIN months m USING (phase, time) LEFT JOIN area USING (cell)
       LEFT JOIN wind USING (cell, time) WHERE m.month <= 24"""


def strict_mean(value: str, weight: str) -> str:
    return (f"CASE WHEN count(*) FILTER (WHERE {value} IS NULL OR {weight} IS NULL) = 0 "
            f"THEN sum({value} * {weight}) / nullif(sum({weight}), 0) END")


oracle("surface_drivers_weighted", f"""SELECT phase, month,
       {strict_mean('ddpco2', 'w')} AS ddpco2_wmean,
       {strict_mean('wind_speed', 'w')} AS wind_wmean,
       coalesce(sum(w), 0) AS ualk_sum, coalesce(sum(co2_uptake), 0) AS co2_upsum
       FROM ({WEIGHTED}) GROUP BY ALL""",
       "phase month", "ddpco2_wmean wind_wmean ualk_sum co2_upsum")
oracle("unused_alkalinity_by_alkalinity", f"""SELECT phase, month,
       {strict_mean('alk_pot', 'dta')} AS alkpot_wmean,
       avg(alk_pot) FILTER (WHERE lat BETWEEN 27.5 AND 37.5 AND lon BETWEEN -127 AND -115)
       AS ualk_mean FROM ({WEIGHTED}) GROUP BY ALL""",
       "phase month", "alkpot_wmean ualk_mean")
oracle("driver_table_long", " UNION ALL ".join(
       f"SELECT region, phase, month, time, '{m}' AS driver, {m} AS value FROM drivers"
       for m in MEASURES.split()),
       "region phase month time driver", "value")
OTHERS = MEASURES.split()[1:]
oracle("driver_correlations", "SELECT region, " + ", ".join(
       f"corr(co2_upsum, {m}) AS cor_{m}, CASE WHEN count({m}) = count(*) THEN "
       f"corr(co2_upsum, {m}) END AS cor_strict_{m}" for m in OTHERS)
       + " FROM drivers GROUP BY region",
       "region", " ".join(f"cor_{m} cor_strict_{m}" for m in OTHERS))

# --- ensemble statistics --------------------------------------------------------------

oracle("ensemble_series", """SELECT *, avg(dta_sum) OVER w AS dta_sum_mean,
       avg(ddic_sum) OVER w AS ddic_sum_mean, avg(cdr_eff) OVER w AS cdr_eff_mean
       FROM series WINDOW w AS (PARTITION BY month)""",
       "phase time month", "dta_sum ddic_sum cdr_eff dta_sum_mean ddic_sum_mean cdr_eff_mean")
oracle("ensemble_envelope", "SELECT *, " + ", ".join(
       f"CASE WHEN count({c}) OVER w = count(*) OVER w THEN {f}({c}) OVER w END AS {f}_{c}"
       for c in ("dta_sum", "ddic_sum", "cdr_eff") for f in ("min", "max"))
       + " FROM series WINDOW w AS (PARTITION BY month)",
       "phase time month", "dta_sum ddic_sum cdr_eff min_dta_sum max_dta_sum min_ddic_sum "
       "max_ddic_sum min_cdr_eff max_cdr_eff")
oracle("ensemble_deviation", """SELECT phase, month, time,
       dta_sum - avg(dta_sum) OVER w AS d_dta_sum, ddic_sum - avg(ddic_sum) OVER w AS d_ddic_sum,
       cdr_eff - avg(cdr_eff) OVER w AS d_cdr_eff FROM series WINDOW w AS (PARTITION BY month)""",
       "phase month time", "d_dta_sum d_ddic_sum d_cdr_eff")
oracle("depth_bins", "SELECT * FROM bins", "", "depth depth_upper depth_lower")
oracle("depth_time_table", """SELECT l.*, depth_upper, depth_lower,
       CASE WHEN depth < 100 THEN 'Surface' ELSE 'Subsurface' END AS category,
       CAST(CASE WHEN depth < 100 THEN 1 ELSE 2 END AS INTEGER) AS category_rank
       FROM layer24 l LEFT JOIN bins USING (depth)""",
       "phase time month category category_rank",
       "depth dta_sum ddic_sum cdr_eff depth_upper depth_lower")
oracle("depth_time_means", "SELECT * FROM layer24", "phase time month",
       "depth dta_sum ddic_sum cdr_eff dta_mean ddic_mean cdr_effmean")
oracle("depth_time_deviation", """SELECT phase, month, depth,
       CASE WHEN dta_sum >= 0 THEN dta_sum END - dta_mean AS d_dta,
       CASE WHEN ddic_sum >= 0 THEN ddic_sum END - ddic_mean AS d_ddic,
       CASE WHEN cdr_eff BETWEEN 0 AND 1 THEN cdr_eff END - cdr_effmean AS d_cdr_eff
       FROM layer24 WHERE depth < 200""",
       "phase month", "depth d_dta d_ddic d_cdr_eff")
oracle("surface_cell_means", """SELECT *, ddic_mean / nullif(dta_mean, 0) AS cdreff_mean FROM
       (SELECT s.*, month, avg(dta) OVER w AS dta_mean, avg(ddic) OVER w AS ddic_mean
       FROM surf s JOIN months USING (phase, time) WINDOW w AS (PARTITION BY cell, month))""",
       "phase cell time month", "dta ddic dta_mean ddic_mean cdreff_mean")
oracle("column_cell_means", """SELECT *, CASE WHEN ddic_mean < 0 OR dta_mean <= 0 THEN NULL
       ELSE ddic_mean / dta_mean END AS cdreff_mean FROM
       (SELECT c.*, month, avg(dta_column) OVER w AS dta_mean, avg(ddic_column) OVER w AS ddic_mean
       FROM col c JOIN months USING (phase, time) WINDOW w AS (PARTITION BY cell, month))""",
       "phase cell time month", "dta_column dta_mean ddic_mean cdreff_mean")
oracle("column_cell_means_top100", """SELECT c.*, month,
       avg(cdreff_col) OVER (PARTITION BY cell, month) AS cdr_mean
       FROM top c JOIN months USING (phase, time)""",
       "phase cell time month", "cdreff_col cdr_mean")
oracle("flux_deviation", """SELECT *, dfg - dfg_mean AS d_dfg FROM (SELECT *,
       avg(dfg) OVER (PARTITION BY cell, month) AS dfg_mean FROM surf24)""",
       "phase cell time month", "dfg dfg_mean d_dfg")
oracle("gradient_block_mean", """SELECT *, avg(ddpco2) OVER (PARTITION BY cell, phase, period)
       AS ddpco2_3mean FROM (SELECT *, CAST((month - 1) // 3 + 1 AS INTEGER) AS period
       FROM surf24)""",
       "phase cell time month period", "ddpco2 ddpco2_3mean")
oracle("gradient_deviation", """SELECT *, ddpco2 - ddpco2_mean AS d_ddpco2 FROM (SELECT *,
       avg(ddpco2) OVER (PARTITION BY cell, month) AS ddpco2_mean FROM surf24)""",
       "phase cell time month", "ddpco2 ddpco2_mean d_ddpco2")

# --- mixing depth and subduction ------------------------------------------------------

oracle("maximum_mixing_depth", "SELECT * FROM mixmax", "phase cell month time", "hbls")
oracle("maximum_mixing_deviation", """SELECT *, hbls - hbls_mean AS d_hbls FROM (SELECT *,
       avg(hbls) OVER (PARTITION BY cell) AS hbls_mean FROM mixmax)""",
       "phase cell month time", "hbls hbls_mean d_hbls")
oracle("monthly_mixing_deviation", """SELECT *, hbls - hbls_mean AS d_hbls FROM (SELECT *,
       avg(hbls) OVER (PARTITION BY cell, month) AS hbls_mean FROM mix24)""",
       "phase cell month time", "hbls hbls_mean d_hbls")
oracle("weighted_mixing_depth", """SELECT *, CASE WHEN count(hbls_wmean) OVER w = count(*) OVER w
       THEN avg(hbls_wmean) OVER w END AS hbls_ovmean FROM (SELECT phase, month,
       sum(hbls * dta_column * area) / nullif(sum(dta_column * area), 0) AS hbls_wmean
       FROM mix24 LEFT JOIN col USING (phase, cell, time) LEFT JOIN area USING (cell)
       GROUP BY ALL) WINDOW w AS (PARTITION BY month)""",
       "phase month", "hbls_wmean hbls_ovmean")
SUBDUCTED = """SELECT *, dta_sub_int / nullif(dta_int, 0) AS frac_sub_dta,
       ddic_sub_int / nullif(ddic_int, 0) AS frac_sub_ddic FROM (SELECT c.phase, months.month,
       coalesce(sum(dta_mol), 0) AS dta_int,
       coalesce(sum(CASE WHEN depth > m.hbls THEN dta_mol END), 0) AS dta_sub_int,
       coalesce(sum(ddic_mol), 0) AS ddic_int,
       coalesce(sum(CASE WHEN depth > m.hbls THEN ddic_mol END), 0) AS ddic_sub_int
       FROM colm c JOIN months ON months.phase = c.phase AND months.time = c.time
       LEFT JOIN {} WHERE months.month <= 24 GROUP BY ALL)"""
PARTS = "dta_int dta_sub_int ddic_int ddic_sub_int frac_sub_dta frac_sub_ddic"
oracle("subducted_under_maximum",
       SUBDUCTED.format("mixmax m ON m.phase = c.phase AND m.cell = c.cell"), "phase month", PARTS)
oracle("subducted_under_current",
       SUBDUCTED.format("surf_t m ON m.phase = c.phase AND m.cell = c.cell AND m.time = c.time"),
       "phase month", PARTS)

# --- regional time series -------------------------------------------------------------

RUNNING = "ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING"
oracle("regional_monthly_series", """SELECT * FROM sst FULL JOIN t50 USING (region, yr_mon)
       FULL JOIN iso USING (region, yr_mon)""",
       "region yr_mon", "sst_mean t50_mean depth_26_mean salt_26_mean")
oracle("climatology_baseline", "SELECT DISTINCT region, moy, sst_clim FROM anom",
       "region moy", "sst_clim")
oracle("anomaly_series", "SELECT * FROM anom", "region yr_mon moy", "sst_mean sst_clim sst_anom")
oracle("running_annual_mean", f"""SELECT region, yr_mon, name,
       CASE WHEN count(value) OVER w = 12 THEN avg(value) OVER w END AS value FROM
       (SELECT region, yr_mon, 'sst_mean' AS name, sst_mean AS value FROM anom UNION ALL
        SELECT region, yr_mon, 'sst_anom', sst_anom FROM anom)
       WINDOW w AS (PARTITION BY region, name ORDER BY yr_mon {RUNNING})""",
       "region yr_mon name", "value")
oracle("anomaly_correlation", """SELECT a.region, corr(r.sst_anom, a.sst_anom) AS cor
       FROM anom a JOIN anom r ON r.yr_mon = a.yr_mon AND r.region = '1-URGENT'
       WHERE a.region <> '1-URGENT' GROUP BY ALL""",
       "region", "cor")
oracle("metric_anomalies", "SELECT * FROM metric_anom",
       "region yr_mon metric moy", "metric_mean metric_clim metric_anom")
oracle("metric_running_means", f"""SELECT region, yr_mon, metric, name,
       CASE WHEN count(value) OVER w = 12 THEN avg(value) OVER w END AS value FROM
       (SELECT region, yr_mon, metric, 'metric_mean' AS name, metric_mean AS value FROM metric_anom
        UNION ALL SELECT region, yr_mon, metric, 'metric_anom', metric_anom FROM metric_anom)
       WINDOW w AS (PARTITION BY region, metric, name ORDER BY yr_mon {RUNNING})""",
       "region yr_mon metric name", "value")
oracle("metric_correlation", """SELECT m.region, metric, corr(r.sst_anom, metric_anom) AS cor
       FROM metric_anom m JOIN anom r ON r.yr_mon = m.yr_mon AND r.region = '1-URGENT'
       WHERE metric_anom IS NOT NULL GROUP BY ALL""",
       "region metric", "cor")
oracle("region_columns", "SELECT yr_mon, " + ", ".join(
       f"max(sst_anom) FILTER (WHERE region[1] = '{i}') AS anom_{i}" for i in range(1, 6))
       + " FROM anom GROUP BY yr_mon",
       "yr_mon", " ".join(f"anom_{i}" for i in range(1, 6)))
oracle("series_before_cutoff", "SELECT * FROM sst WHERE yr_mon < '2001-01-01'",
       "region yr_mon", "sst_mean")
oracle("earliest_series_month", """SELECT * FROM sst JOIN (SELECT region, min(yr_mon) AS yr_mon
       FROM sst GROUP BY region) USING (region, yr_mon)""",
       "region yr_mon", "sst_mean")

# --- maps and points ------------------------------------------------------------------

oracle("point_region_class", """SELECT *, CASE
       WHEN lat BETWEEN 27.5 AND 37.5 AND lon BETWEEN -127 AND -115 THEN 'Local'
       WHEN lat BETWEEN 22.5 AND 47.5 AND lon BETWEEN -140 AND -110 THEN 'CCS'
       WHEN lat BETWEEN 10 AND 60 AND lon BETWEEN -155 AND -95 THEN 'NE Pacific' END AS region
       FROM points""",
       "cell region", "lat lon")
oracle("region_membership", f"""SELECT region, count(*) AS points, sum(value) AS value_sum,
       avg(value) AS value_mean FROM points JOIN {BOXES} ON {IN_BOX} GROUP BY ALL""",
       "region points", "value_sum value_mean")
oracle("region_extent", f"""SELECT region, min(lat) AS lat_min, max(lat) AS lat_max,
       min(lon) AS lon_min, max(lon) AS lon_max FROM points JOIN {BOXES} ON {IN_BOX} GROUP BY ALL
       UNION ALL SELECT 'Domain', min(lat), max(lat), min(lon), max(lon) FROM points""",
       "region", "lat_min lat_max lon_min lon_max")
oracle("open_box_means", """SELECT count(*) AS points, avg(value) AS value_mean,
       avg(CASE WHEN value > 0 THEN log10(value) END) AS value_log_mean FROM points
       WHERE lat > 22.5 AND lat < 47.5 AND lon > -140 AND lon < -110""",
       "points", "value_mean value_log_mean")
oracle("map_of_column_alkalinity", """SELECT cell, lat, lon, CASE WHEN v > 0 THEN v END / 10 AS fill
       FROM (SELECT cell, lat, lon, CASE WHEN dta_column > 100 THEN 100 ELSE dta_column END AS v
       FROM col JOIN months USING (phase, time) JOIN area USING (cell)
       WHERE phase = 'N' AND month = 10 AND lat BETWEEN 10 AND 60 AND lon BETWEEN -155 AND -95)""",
       "cell", "lat lon fill")
oracle("closing_step", """SELECT phase, month, dta_sum FROM series UNION ALL
       SELECT phase, CAST(month + 1 AS INTEGER), dta_sum FROM series s
       WHERE month = (SELECT max(month) FROM series x WHERE x.phase = s.phase)""",
       "phase month", "dta_sum")

# --- arrays ---------------------------------------------------------------------------

oracle("chunk_cells", """SELECT file, time, alk AS value, 30 + eta * 0.125e0 AS lat,
       -120 + xi * 0.125e0 AS lon FROM chunk""",
       "file time", "value lat lon")
oracle("chunk_block", """SELECT file, time, eta, xi, alk AS value FROM chunk
       WHERE time BETWEEN 60 AND 299 AND eta BETWEEN 2 AND 5 AND xi BETWEEN 1 AND 3""",
       "file time eta xi", "value")
oracle("chunk_variables", """SELECT file, eta, xi, sum(alk) AS alk_sum, sum(dic) AS dic_sum,
       sum(alk * dic) AS product_sum FROM chunk GROUP BY ALL""",
       "file eta xi", "alk_sum dic_sum product_sum")
oracle("deep_index_filter", """SELECT layer, depth, count(*) AS cells, avg(alk) AS alk_mean FROM
       (SELECT *, CAST(dense_rank() OVER (ORDER BY depth) AS INTEGER) AS layer FROM treated)
       WHERE layer > 4 GROUP BY ALL""",
       "layer cells", "depth alk_mean")

# --- joins, unions and scalars on their own -------------------------------------------

oracle("join_run_variables", "SELECT * FROM treated WHERE alk >= 10 AND dic <= 80",
       "phase cell time", "depth alk dic")
oracle("static_right_join", f"""SELECT cell, depth, area * ({THICKNESS}) AS volume FROM area
       RIGHT JOIN (SELECT DISTINCT cell, depth FROM control) USING (cell)""",
       "cell", "depth volume")
oracle("merged_runs", """SELECT * FROM
       (SELECT cell, time, avg(alk) AS alk FROM surf_t GROUP BY ALL)
       FULL JOIN (SELECT cell, time, alk_con FROM control WHERE depth = 0) USING (cell, time)""",
       "cell time", "alk alk_con")
oracle("stacked_runs", """SELECT cell, 'control' AS run, avg(q) AS alk, NULL::DOUBLE AS hbls
       FROM li WHERE scenario = 'F' GROUP BY cell UNION ALL
       SELECT cell, 'treated', avg(q), avg(d) FROM li WHERE scenario = 'O' GROUP BY cell""",
       "cell run", "alk hbls")
oracle("distinct_positions", "SELECT DISTINCT lat, lon, area FROM area", "", "lat lon area")
oracle("calendar_forms", """SELECT strftime(o_orderdate, '%Y-%m') AS time,
       strftime(o_orderdate, '%Y-%m-15') AS yr_mon, CAST(month(o_orderdate) AS INTEGER) AS moy,
       count(*) AS orders, min(CAST(epoch(o_orderdate) AS BIGINT) - 283996800) AS first_seconds,
       CAST(day(last_day(any_value(o_orderdate)::DATE)) * 86400 AS BIGINT) AS secs
       FROM orders GROUP BY 1, 2, 3""",
       "time yr_mon moy orders first_seconds secs", "")
oracle("unit_conversions", """SELECT cell, depth, time, alk_con / 1.02518e0 AS umol_per_kg,
       dic_con AS dic_again, depth * 0.1e0 AS pressure,
       (CASE WHEN cell + 120 > 180 THEN cell - 240 ELSE cell + 120 END)::DOUBLE AS lon
       FROM control""",
       "cell time", "depth umol_per_kg dic_again pressure lon")
oracle("read_listed_files", """SELECT 'orders.parquet' AS file, count(*) AS rows,
       sum(o_totalprice) AS price_sum FROM orders""",
       "file rows", "price_sum")

# --- carbonate chemistry --------------------------------------------------------------
# Same published constants, other method: 60 halvings of an interval of ln[H+].

WATER = """avg(q) * 4 + 2100 AS alk, avg(p) / 1000 + 1900 AS dic, avg(t) * 40 + 32 AS cw_s,
       avg(d) * 200 + 4 AS cw_c, (avg(q) * 0.02 + 0.2) * 1e-6 / 1.02518e0 AS cw_pt,
       (avg(q) * 0.5 + 2) * 1e-6 / 1.02518e0 AS cw_sit, depth * 0.1e0 AS cw_p"""
CONTROL_WATER = f"""SELECT cell, depth, time, {WATER} FROM li WHERE scenario = 'F'
       GROUP BY cell, depth, time"""
TREATED_WATER = f"""SELECT phase, cell, depth, time, {WATER} FROM li WHERE scenario = 'O'
       GROUP BY phase, cell, depth, time"""


def prepared(source: str) -> str:
    """The equilibrium constants as columns, step by step."""
    for step in eq.PREPARATION:
        added = ", ".join(f"{text} AS {name}" for name, text in step.items())
        source = f"SELECT *, {added} FROM ({source})"
    return source


def bisected(source: str, carbonate: str, out: str) -> str:
    """Add the proton concentration at which the alkalinity equals cw_alk."""
    total = f"({carbonate.format(h='exp(x)')} + {eq.other_alkalinity('exp(x)')})"
    halvings = ", ".join(f"{12.0 / 2.0**i!r}::DOUBLE" for i in range(1, 61))
    search = (
        f"list_reduce([-18e0, {halvings}], lambda x, s: x + CASE WHEN {total} > cw_alk "
        f"THEN s ELSE -s END)"
    )
    return f"SELECT *, exp({search}) AS {out} FROM ({source})"


def solved_pco2(source: str, alk: str, dic: str, out: str) -> str:
    source = f"""SELECT *, ({alk}) * 1e-6 / 1.02518e0 AS cw_alk,
        ({dic}) * 1e-6 / 1.02518e0 AS cw_dic FROM ({source})"""
    source = bisected(source, eq.carbonate_from_dic("{h}", "cw_dic"), "cw_h")
    return f"""SELECT * EXCLUDE (cw_alk, cw_dic, cw_h),
        {eq.co2_from_dic('cw_h', 'cw_dic')} / cw_k0 / cw_fug * 1e6 AS {out} FROM ({source})"""


def solved_dic(source: str, alk: str, pco2: str, out: str) -> str:
    source = f"""SELECT *, ({alk}) * 1e-6 / 1.02518e0 AS cw_alk,
        ({pco2}) * 1e-6 * cw_fug * cw_k0 AS cw_co2 FROM ({source})"""
    source = bisected(source, eq.carbonate_from_co2("{h}", "cw_co2"), "cw_h")
    return f"""SELECT * EXCLUDE (cw_alk, cw_co2, cw_h),
        {eq.dic_from_co2('cw_h', 'cw_co2')} * 1.02518e0 * 1e6 AS {out} FROM ({source})"""


SURFACE = prepared(f"SELECT * FROM ({CONTROL_WATER}) WHERE depth = 0")
CALC = {"calc": solved_pco2(SURFACE, "alk", "dic", "pco2_calc")}
oracle("pco2_comparison", """SELECT cell, time, dic - 1600 - pco2_calc AS dpco2,
       'pco2_calc' AS variant, pco2_calc AS pco2 FROM calc UNION ALL
       SELECT cell, time, dic - 1600 - pco2_calc, 'pco2oc', dic - 1600 FROM calc""",
       "cell time variant", "dpco2 pco2", CALC)
oracle("alkalinity_perturbation", """SELECT *, pco2_calc_pert - pco2_calc AS dpco2,
       dic_pert - dic AS ddic FROM pert_dic""",
       "cell time", "pco2_calc pco2_calc_pert dpco2 ddic",
       {**CALC,
        "pert": solved_pco2("SELECT * FROM calc", "alk + 10", "dic", "pco2_calc_pert"),
        "pert_dic": solved_dic("SELECT * FROM pert", "alk + 10", "pco2_calc", "dic_pert")})
POTENTIAL = {
    "base": solved_pco2(prepared(CONTROL_WATER), "alk", "dic", "pco2_calc"),
    "exposed": f"""SELECT t.* EXCLUDE (dic), b.dic AS dic_con, pco2_calc FROM
        ({TREATED_WATER}) t JOIN base b USING (cell, depth, time)""",
    "expected": solved_dic(prepared("SELECT * FROM exposed"), "alk", "pco2_calc", "dic_calc"),
    "potential": f"""SELECT phase, cell, depth, time, dic_calc - dic_con AS ddic,
        (dic_calc - dic_con) * (area * ({THICKNESS})) / 1000 AS cdr_pot
        FROM expected LEFT JOIN area USING (cell)""",
}
oracle("removal_potential_cells", "SELECT *, cdr_pot / 1e6 AS cdr_pot_e6 FROM potential",
       "phase cell time", "depth ddic cdr_pot_e6", POTENTIAL)
oracle("removal_potential_total", """SELECT phase, coalesce(sum(cdr_pot), 0) AS cum_cdr_pot
       FROM potential GROUP BY phase""",
       "phase", "cum_cdr_pot", POTENTIAL)


# --- layouts --------------------------------------------------------------------------

oracle("array_file_block", """SELECT * FROM chunk WHERE time BETWEEN 60 AND 299
       AND eta BETWEEN 2 AND 5 AND xi BETWEEN 1 AND 3""", "time eta xi", "alk dic")
oracle("array_file_means", "SELECT eta, xi, count(alk) AS steps, avg(alk) AS alk_mean FROM chunk GROUP BY ALL",
       "eta xi steps", "alk_mean")
for _name in ("column_integral_full", "column_integral_top100", "surface_cell_means", "column_cell_means",
              "column_cell_means_top100", "flux_deviation", "gradient_block_mean", "gradient_deviation"):
    SQL[f"staged_{_name}"] = SQL[_name]
oracle("series_of_places", """SELECT r_name AS place, strftime(o_orderdate, '%Y-%m-15') AS yr_mon,
       avg(o_totalprice / 1000) AS value_mean
       FROM orders JOIN region ON r_regionkey + 1 = CAST(substr(o_orderpriority, 1, 1) AS INTEGER)
       WHERE r_name LIKE 'A%' AND year(o_orderdate) >= 1996 GROUP BY ALL""", "place yr_mon", "value_mean")


def running(size: int, by: str) -> str:
    ahead = f"({by} ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"
    return f"""SELECT event_id, event_type, sum(value) OVER ({by} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value_sum,
       CASE WHEN count(value) OVER {ahead} = {size} THEN avg(value) OVER {ahead} END AS value_mean FROM events"""


oracle("long_running_series", running(12, ""), "event_id", "value_sum value_mean")
oracle("long_series_by_type", running(3, "PARTITION BY event_type"), "event_id event_type", "value_sum value_mean")
oracle("runs_with_a_cut", """SELECT phase, time, count(*) AS cells, sum(alk) AS alk_sum FROM treated
       WHERE depth = 0 AND (phase = 'A' OR phase = 'N' AND time <= '1998-05') GROUP BY ALL""",
       "phase time cells", "alk_sum")
oracle("box_table_membership", """SELECT box, count(*) AS points, avg(value) AS value_mean FROM
       (SELECT o_totalprice AS value, 5 + (o_orderkey * 37 % 481) / 8.0e0 AS lat,
           -160 + (o_orderkey * 53 % 561) / 8.0e0 AS lon FROM orders)
       JOIN (SELECT cell AS box, lat AS y, lon AS x, (cell % 40 + 1) / 16.0e0 AS h FROM points)
       ON lat BETWEEN y - h AND y + h AND lon BETWEEN x - h AND x + h GROUP BY box""", "box points", "value_mean")
oracle("map_layout_slice", """SELECT cell, lat, lon, least(dta_column, 100) / 10 AS fill FROM col JOIN area USING (cell)
       WHERE phase = 'N' AND time = '1996-07' AND lat BETWEEN 10 AND 60 AND lon BETWEEN -155 AND -95""",
       "cell", "lat lon fill")
oracle("listed_run_files", """SELECT 'run_' || phase AS file, count(*) AS cells, sum(dic) AS dic_sum
       FROM treated WHERE depth = 0 GROUP BY phase""", "file cells", "dic_sum")
SQL["driver_table_joined"] = SQL["driver_table"]


# --- exact accumulation ---------------------------------------------------------------


def exact_sum(value: str) -> str:
    """Whole parts and 2**-60ths as integers, rounded when they are summed."""
    parts = f"sum(CAST(floor(({value} - floor({value})) * 1152921504606846976e0) AS HUGEINT))"
    return (f"(CAST(sum(CAST(floor({value}) AS HUGEINT)) + {parts} // 1152921504606846976 AS DOUBLE) "
            f"+ CAST(CAST({parts} % 1152921504606846976 AS BIGINT) AS DOUBLE) / 1152921504606846976e0)")


def exact_mean(value: str) -> str:
    return f"{exact_sum(value)} / CAST(count({value}) AS DOUBLE)"


SQL["exact_monthly_totals"] = f"""SELECT o_orderpriority AS region, strftime(o_orderdate, '%Y-%m-15') AS yr_mon,
    {exact_sum('o_totalprice')} AS total, {exact_mean('o_totalprice')} AS mean FROM orders GROUP BY ALL"""
SQL["exact_integrated_series"] = f"""
WITH li AS ({BASE['li']}),
treated AS (SELECT phase, cell, depth, time, {exact_mean('q')} AS alk, {exact_mean('p')} / 1000 AS dic
    FROM li WHERE scenario = 'O' GROUP BY ALL),
control AS (SELECT cell, depth, time, {exact_mean('q')} AS alk_con, {exact_mean('p')} / 1000 AS dic_con
    FROM li WHERE scenario = 'F' GROUP BY ALL),
amounts AS (SELECT phase, time, (alk - alk_con) * ({THICKNESS}) AS a, (dic - dic_con) * ({THICKNESS}) AS d
    FROM treated LEFT JOIN control USING (cell, depth, time)),
sums AS (SELECT phase, time, coalesce({exact_sum('a')}, 0) AS dta_sum, coalesce({exact_sum('d')}, 0) AS ddic_sum
    FROM amounts GROUP BY ALL)
SELECT *, ddic_sum / nullif(dta_sum, 0) AS cdr_eff FROM sums"""

ON_MAP = """FROM surf JOIN months USING (phase, time) JOIN area USING (cell)
       WHERE phase = 'N' AND month = 10 AND lat BETWEEN 10 AND 60 AND lon BETWEEN -155 AND -95"""
oracle("map_of_flux", f"SELECT cell, lat, lon, CASE WHEN dfg > 20 THEN 20 ELSE dfg END AS fill {ON_MAP}", "cell", "lat lon fill")
oracle("map_of_gradient", f"SELECT cell, lat, lon, CASE WHEN ddpco2 BETWEEN -25 AND 25 THEN ddpco2 END AS fill {ON_MAP}",
       "cell", "lat lon fill")
oracle("map_of_mixing_depth", f"SELECT cell, lat, lon, nullif(least(hbls, 200), 0) AS fill {ON_MAP}", "cell", "lat lon fill")
