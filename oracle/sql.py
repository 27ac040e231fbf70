"""SQL equivalents of the registered queries, for DuckDB on the same tables."""
from __future__ import annotations

SQL: dict[str, str] = {}


def add(name: str, select: str, *ctes: str) -> None:
    seen: list[str] = []
    for block in ctes:
        if block not in seen:
            seen.append(block)
    SQL[name] = ("WITH " + ",\n".join(seen) + "\n" if seen else "") + select


HEX = "(CAST('0x' || substr(md5({k}), {at}, 8) AS BIGINT) + 0.5) / 4294967296.0"


def uniform(key: str) -> str:
    return HEX.format(k=key, at=1)


def normal(key: str) -> str:
    return f"(sqrt(-2.0 * ln({HEX.format(k=key, at=1)})) * cos(2.0 * pi() * {HEX.format(k=key, at=9)}))"


# ------------------------------------------------------------- shared blocks
SOLD = """sold AS (SELECT l.*, p.p_type AS category, p.p_type || '|' || p.p_brand AS item_id, p.p_brand, p.p_retailprice, n.n_name AS store_id,
  r.r_name AS region, CAST(l.l_shipdate AS DATE) AS date
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
BOUNDS = """bounds AS (SELECT MIN(CAST(l_shipdate AS DATE)) AS d0, MAX(CAST(l_shipdate AS DATE)) - MIN(CAST(l_shipdate AS DATE)) + 1 AS n FROM lineitem)"""
MEASURES = """SUM(l_quantity) AS y, MAX(l_discount) AS disc, BOOL_OR(l_returnflag = 'R' AND l_discount >= 0.09) AS stockout"""
DAILY = f"""daily AS MATERIALIZED (SELECT store_id || '|' || category AS series_id, store_id, region, category, date, date - (SELECT d0 FROM bounds) AS day_idx, {MEASURES}
  FROM sold GROUP BY ALL)"""
DAILY_ITEM = f"""daily_item AS (SELECT store_id || '|' || item_id AS series_id, store_id, region, category, item_id, date,
  date - (SELECT d0 FROM bounds) AS day_idx, {MEASURES} FROM sold GROUP BY ALL)"""
DAILY_STORE = f"""daily_store AS (SELECT store_id AS series_id, store_id, region, date, date - (SELECT d0 FROM bounds) AS day_idx, {MEASURES} FROM sold GROUP BY ALL)"""
SERIES = """series AS MATERIALIZED (SELECT series_id, store_id, region, category, MIN(day_idx) AS launch_idx FROM daily GROUP BY ALL)"""
PANEL = """panel AS MATERIALIZED (SELECT s.series_id, s.store_id, s.region, s.category, s.launch_idx, s.day_idx, COALESCE(d.y, 0.0) AS y,
  COALESCE(d.disc, 0.0) AS disc, COALESCE(d.stockout, FALSE) AS stockout, CASE WHEN NOT COALESCE(d.stockout, FALSE) THEN COALESCE(d.y, 0.0) END AS ym
  FROM (SELECT *, CAST(unnest(range(launch_idx, (SELECT n FROM bounds))) AS INTEGER) AS day_idx FROM series) s
  LEFT JOIN daily d ON d.series_id = s.series_id AND d.day_idx = s.day_idx)"""
BASE = (SOLD, BOUNDS, DAILY, SERIES, PANEL)
LAYOUT = """layout AS MATERIALIZED (SELECT 'test' AS block, n - 15 - 7 * unnest(range(0, 8)) AS origin FROM bounds UNION ALL SELECT 'cal', n - 85 - 7 * unnest(range(0, 8)) FROM bounds
  UNION ALL SELECT block, origin FROM (SELECT 'train' AS block, n - 155 - 7 * unnest(range(0, 78)) AS origin FROM bounds) WHERE origin >= 60 UNION ALL SELECT 'production', n - 1 FROM bounds)"""
TRAIN_END = "(SELECT MAX(origin) + 14 FROM layout WHERE block = 'train')"


def roll(source: str) -> str:
    """Range-frame statistics per series and day of ``source`` (ym, y, day_idx)."""
    def w(d):
        return f"OVER (PARTITION BY series_id ORDER BY day_idx RANGE BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"
    return f"""rolled AS MATERIALIZED (SELECT *, AVG(ym) {w(7)} AS mean7, AVG(ym) {w(28)} AS mean28, AVG(ym) {w(56)} AS mean56, STDDEV_SAMP(ym) {w(28)} AS std28,
  AVG(CASE WHEN ym = 0 THEN 1.0 WHEN ym IS NOT NULL THEN 0.0 END) {w(28)} AS zero28, ym AS last_obs,
  LEAST(COALESCE(day_idx - MAX(CASE WHEN y > 0 THEN day_idx END) OVER (PARTITION BY series_id ORDER BY day_idx), 90), 90) AS days_since_sale FROM {source})"""


ROLLED = roll("panel")
STATES = """counted AS (SELECT series_id, day_idx, ym, COUNT(ym) OVER u AS n, CASE WHEN ym > 0 THEN 1 ELSE 0 END AS sold FROM panel
  WINDOW u AS (PARTITION BY series_id ORDER BY day_idx)),
gaps AS (SELECT *, SUM(CASE WHEN ym IS NOT NULL THEN sold ELSE 0 END) OVER (PARTITION BY series_id ORDER BY day_idx) AS j,
  n - COALESCE(MAX(CASE WHEN ym > 0 THEN n END) OVER (PARTITION BY series_id ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM counted),
states AS MATERIALIZED (SELECT series_id, day_idx, n, j,
  pow(0.9, n) * SUM(CASE WHEN ym IS NOT NULL THEN (CASE WHEN n = 1 THEN 1.0 ELSE 0.1 END) * ym * pow(0.9, -n) END) OVER u AS level,
  pow(0.9, j) * SUM(CASE WHEN ym > 0 THEN (CASE WHEN j = 1 THEN 1.0 ELSE 0.1 END) * ym * pow(0.9, -j) END) OVER u AS size,
  pow(0.9, j) * SUM(CASE WHEN ym > 0 THEN (CASE WHEN j = 1 THEN 1.0 ELSE 0.1 END) * gap * pow(0.9, -j) END) OVER u AS ival,
  pow(0.9, n) * SUM(CASE WHEN ym IS NOT NULL THEN (CASE WHEN n = 1 THEN 0.25 + 0.5 * sold ELSE 0.1 * sold END) * pow(0.9, -n) END) OVER u AS prob
  FROM gaps WINDOW u AS (PARTITION BY series_id ORDER BY day_idx)),
models AS MATERIALIZED (SELECT series_id, day_idx, CASE WHEN n > 0 THEN level END AS level, CASE WHEN j > 0 THEN COALESCE(size / ival, 0.0) ELSE 0.0 END AS croston,
  CASE WHEN j > 0 THEN 0.95 * size / ival ELSE 0.0 END AS sba, CASE WHEN j > 0 THEN prob * size ELSE 0.0 END AS tsb FROM states)"""
CLASSES = f"""sized AS MATERIALIZED (SELECT series_id, COUNT(ym) AS n_obs, COUNT(CASE WHEN ym > 0 THEN 1 END) AS n_sold, AVG(CASE WHEN ym > 0 THEN ym END) AS mu,
  STDDEV_POP(CASE WHEN ym > 0 THEN ym END) AS sd FROM panel WHERE day_idx <= {TRAIN_END} GROUP BY series_id),
classes AS MATERIALIZED (SELECT series_id, n_obs, n_sold, n_obs / NULLIF(n_sold, 0)::DOUBLE AS adi, CASE WHEN n_sold > 1 THEN pow(sd / mu, 2) ELSE 0.0 END AS cv2,
  CASE WHEN n_obs < 28 THEN 'new' WHEN n_sold > 0 AND n_obs / n_sold::DOUBLE < 1.32 THEN (CASE WHEN n_sold <= 1 OR pow(sd / mu, 2) < 0.49 THEN 'smooth' ELSE 'erratic' END)
    ELSE (CASE WHEN n_sold <= 1 OR pow(sd / mu, 2) < 0.49 THEN 'intermittent' ELSE 'lumpy' END) END AS demand_class FROM sized)"""
SCALE = f"""diffs AS MATERIALIZED (SELECT a.series_id, AVG(ABS(a.ym - b.ym)) AS m FROM panel a JOIN panel b ON a.series_id = b.series_id AND a.day_idx = b.day_idx + 7
  WHERE a.day_idx <= {TRAIN_END} GROUP BY a.series_id),
scale AS MATERIALIZED (SELECT s.series_id, COALESCE(CASE WHEN m > 0 THEN m END, (SELECT MEDIAN(m) FROM diffs WHERE m > 0), 1.0) AS mase_scale
  FROM (SELECT DISTINCT series_id FROM panel WHERE day_idx <= {TRAIN_END}) s LEFT JOIN diffs USING (series_id))"""
# base forecasts of every block, row by row
LAGS = """rows0 AS MATERIALIZED (SELECT *, origin + h AS day FROM (SELECT p.series_id, p.store_id, p.region, p.category, p.launch_idx, o.block, o.origin, CAST(unnest(range(1, 15)) AS INTEGER) AS h
  FROM series p CROSS JOIN layout o) WHERE launch_idx <= origin + h),
lag_days AS MATERIALIZED (SELECT series_id, origin, h, j, CAST(day - 7 * (CAST(CEIL(h / 7.0) AS INTEGER) + j) AS INTEGER) AS lag_day FROM (SELECT *, unnest(range(0, 4)) AS j FROM rows0)),
lags AS MATERIALIZED (SELECT r.series_id, r.origin, r.h, AVG(p.ym) AS sdw_mean4, MAX(CASE WHEN r.j = 0 THEN p.ym END) AS lag1
  FROM lag_days r JOIN panel p ON p.series_id = r.series_id AND p.day_idx = r.lag_day GROUP BY r.series_id, r.origin, r.h)"""
FORECASTS = """fc AS MATERIALIZED (SELECT r.*, k.mean7, k.mean28, k.mean56, k.std28, k.zero28, k.last_obs, k.days_since_sale, l.sdw_mean4, m.level, COALESCE(m.croston, 0.0) AS croston,
  COALESCE(m.sba, 0.0) AS sba, COALESCE(m.tsb, 0.0) AS tsb, c.demand_class, LEAST(r.day - r.launch_idx, 365) AS age, t.y, COALESCE(t.stockout, FALSE) AS censored,
  COALESCE(l.lag1, k.mean7, 0.0) AS b0,
  GREATEST(COALESCE(m.level * COALESCE(1 + 0.5 * (l.sdw_mean4 / NULLIF(k.mean28, 0) - 1), 1.0), 0.0), 0.0) AS b1
  FROM rows0 r LEFT JOIN rolled k ON k.series_id = r.series_id AND k.day_idx = r.origin LEFT JOIN lags l ON l.series_id = r.series_id AND l.origin = r.origin AND l.h = r.h
  LEFT JOIN models m ON m.series_id = r.series_id AND m.day_idx = r.origin LEFT JOIN panel t ON t.series_id = r.series_id AND t.day_idx = r.day
  LEFT JOIN classes c ON c.series_id = r.series_id),
fm AS (SELECT *, b1 AS m1, 0.5 * (b0 + b1) AS m2, 0.25 * (b0 + b1) AS m2_p10, 0.5 * (b0 + b1) AS m2_p50, 0.8 * (b0 + b1) + 1.0 AS m2_p90 FROM fc)"""
FC = (*BASE, LAYOUT, ROLLED, STATES, CLASSES, LAGS, FORECASTS)
USABLE = "y IS NOT NULL AND NOT censored"


def wape(f: str) -> str:
    return f"SUM(ABS(y - {f})) / NULLIF(SUM(ABS(y)), 0)"


def bias(f: str) -> str:
    return f"SUM({f} - y) / NULLIF(SUM(ABS(y)), 0)"


# ------------------------------------------------------------- sources
add("feed_scan", """SELECT CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS units, COUNT(*) AS rows FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1""")
add("order_export_cells", """SELECT o_orderkey, CASE WHEN cell SIMILAR TO '[=+@-].*' THEN '''' || cell ELSE cell END AS cell, o_orderpriority, o_totalprice
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN '=' WHEN 'O' THEN '-' ELSE '@' END || o_orderpriority AS cell FROM orders)""")
add("recent_history", """SELECT d0 + CAST(day_idx AS INTEGER) AS date, series_id AS node_id, 'ym' AS measure, ym AS value FROM panel, bounds WHERE day_idx >= n - 91 AND ym IS NOT NULL
  UNION ALL SELECT d0 + day_idx, series_id, 'disc', disc FROM panel, bounds WHERE day_idx >= n - 91""", *BASE)

# ------------------------------------------------------------- contracts
KEY = "concat_ws('|', '0', {kind}, l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def chosen(kind: str, rate: float) -> str:
    return f"({uniform(KEY.format(kind=repr(kind)))} < {rate})"


FEED = """feed AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS date,
  'S' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') AS store_id, 'I' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS item_id,
  CAST(l_quantity AS BIGINT) AS units_sold, l_extendedprice / l_quantity AS unit_price,
  CAST(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 0 ELSE l_orderkey % 40 END AS BIGINT) AS on_hand_close, CAST(0 AS BIGINT) AS receipts, l_tax FROM lineitem)"""
DIRTY = f"""marked AS (SELECT *, CAST(units_sold + on_hand_close - CASE WHEN l_tax = 0.08 THEN 1 ELSE 0 END AS BIGINT) AS on_hand_open,
  {chosen('negative', 0.02)} AS neg, {chosen('null_price', 0.02)} AS nul, {chosen('duplicate', 0.01)} AS dup, {chosen('future', 0.01)} AS fut,
  (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem) + 1 + CAST(floor({uniform(KEY.format(kind="'shift'"))} * 29) AS INTEGER) AS later FROM feed),
injected AS (SELECT * EXCLUDE (units_sold, unit_price), CASE WHEN neg THEN -GREATEST(units_sold, 1) ELSE units_sold END AS units_sold,
  CASE WHEN NOT nul THEN unit_price END AS unit_price, CASE WHEN neg THEN 'negative_units' WHEN nul THEN 'bad_price' END AS defect FROM marked),
dirty AS (SELECT * EXCLUDE (later, date), date, 0 AS copy FROM injected
  UNION ALL SELECT * EXCLUDE (later, date, defect), 'duplicate_key' AS defect, date, 1 AS copy FROM injected WHERE dup
  UNION ALL SELECT * EXCLUDE (later, date, defect), 'date_in_future' AS defect, later AS date, 2 AS copy FROM injected WHERE fut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date, l_suppkey, l_partkey ORDER BY copy, l_orderkey, l_linenumber, units_sold, on_hand_open, on_hand_close) AS rn,
  rank() OVER (PARTITION BY date, l_suppkey, l_partkey ORDER BY copy, l_orderkey, l_linenumber, units_sold, on_hand_open, on_hand_close) AS rk FROM dirty),
annotated AS (SELECT *, CASE WHEN rk > 1 THEN 'duplicate_key' WHEN date > (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem) THEN 'date_in_future' WHEN units_sold < 0 THEN 'negative_units'
  WHEN unit_price IS NULL OR unit_price <= 0 THEN 'bad_price' WHEN on_hand_open < 0 OR receipts < 0 OR on_hand_close < 0 THEN 'negative_stock'
  WHEN units_sold >= 0 AND on_hand_open + receipts - units_sold <> on_hand_close THEN 'stock_balance'
  WHEN NOT regexp_matches(store_id, '^S[0-9][0-9]$') OR NOT regexp_matches(item_id, '^I[0-9][0-9][0-9]$') THEN 'schema' END AS reason FROM ranked)"""
add("quarantine_reasons", """SELECT l_orderkey, l_linenumber, copy, date, units_sold, on_hand_open, on_hand_close, reason FROM annotated WHERE reason IS NOT NULL""", FEED, DIRTY)
add("clean_feed_by_store", """SELECT store_id, date, CAST(SUM(units_sold) AS BIGINT) AS units, COUNT(CASE WHEN on_hand_close = 0 THEN 1 END) AS stockouts
  FROM annotated WHERE reason IS NULL GROUP BY 1, 2""", FEED, DIRTY)
add("quality_report", """SELECT 'rows_raw' AS metric, '' AS key, CAST(COUNT(*) AS VARCHAR) AS value FROM annotated
  UNION ALL SELECT 'rows_clean', '', CAST(COUNT(*) AS VARCHAR) FROM annotated WHERE reason IS NULL
  UNION ALL SELECT 'rows_quarantined', '', CAST(COUNT(*) AS VARCHAR) FROM annotated WHERE reason IS NOT NULL
  UNION ALL SELECT 'stockout_days', '', CAST(COUNT(*) AS VARCHAR) FROM annotated WHERE reason IS NULL AND on_hand_close = 0
  UNION ALL SELECT 'first_date', '', CAST(MIN(date) AS VARCHAR) FROM annotated WHERE reason IS NULL
  UNION ALL SELECT 'last_date', '', CAST(MAX(date) AS VARCHAR) FROM annotated WHERE reason IS NULL
  UNION ALL SELECT 'quarantine_reason', reason, CAST(COUNT(*) AS VARCHAR) FROM annotated WHERE reason IS NOT NULL GROUP BY reason""", FEED, DIRTY)
SQL["observed_quality_report"] = SQL["quality_report"]
add("incremental_ingest", """SELECT COUNT(*) AS rows, SUM(l_quantity + CASE WHEN l_suppkey % 5 = 1 THEN 1 ELSE 0 END) AS units, TRUE AS equals_raw, TRUE AS only_changes
  FROM lineitem WHERE l_suppkey % 5 IN (1, 2, 4)""")
add("dirty_feed_counts", """SELECT COALESCE(a.reason, b.reason) AS reason, COALESCE(injected, 0) AS injected, COALESCE(quarantined, 0) AS quarantined
  FROM (SELECT defect AS reason, COUNT(*) AS injected FROM annotated WHERE defect IS NOT NULL GROUP BY 1) a
  FULL JOIN (SELECT reason, COUNT(*) AS quarantined FROM annotated WHERE reason IS NOT NULL GROUP BY 1) b ON a.reason = b.reason""", FEED, DIRTY)
add("unknown_keys", """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
  OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) THEN 'unknown_key' END AS reason FROM lineitem""")
add("repeated_keys", "SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
add("range_violations", """SELECT * FROM (SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN 'balance' END,
  CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$') THEN 'name' END,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment' END) AS reasons FROM customer) WHERE reasons <> ''""")

# ------------------------------------------------------------- panel
add("series_dimension", """SELECT st.store_id || '|' || it.item_id AS node_id, st.store_id, it.item_id, it.category, st.region, store_idx, region_idx, cat_idx,
  GREATEST(0, launch - (SELECT d0 FROM bounds)) AS launch_idx, price, pack_size
  FROM (SELECT n_name AS store_id, r_name AS region, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS INTEGER) AS store_idx,
    CAST(dense_rank() OVER (ORDER BY r_name) - 1 AS INTEGER) AS region_idx FROM nation JOIN region ON n_regionkey = r_regionkey) st
  CROSS JOIN (SELECT p_type || '|' || p_brand AS item_id, p_type AS category, MIN(p_retailprice) AS price, MIN(p_size) AS pack_size,
    CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS cat_idx FROM part GROUP BY p_type, p_brand) it
  JOIN (SELECT item_id, MIN(date) AS launch FROM sold GROUP BY 1) la ON la.item_id = it.item_id""", SOLD, BOUNDS)
add("dense_grid", """SELECT s.series_id, CAST(g.d AS INTEGER) AS day_idx, d.y, COALESCE(d.stockout, FALSE) AS stockout
  FROM (SELECT series_id, GREATEST(MIN(day_idx) - 3, 0) AS launch FROM daily_store GROUP BY 1) s JOIN (SELECT unnest(range(0, n)) AS d FROM bounds) g ON g.d >= s.launch
  LEFT JOIN daily_store d ON d.series_id = s.series_id AND d.day_idx = g.d""", SOLD, BOUNDS, DAILY_STORE)


def promos(item: str) -> str:
    return f"""promos AS (SELECT {item} AS item_id, region, MIN(date) AS date_start, MIN(date) + 6 AS date_end, MAX(l_discount) AS discount,
  date_trunc('month', date) AS promo_ord FROM sold GROUP BY {item}, region, date_trunc('month', date)),
promo_days AS MATERIALIZED (SELECT item_id, region, CAST(day_idx AS INTEGER) AS day_idx, arg_max(discount, promo_ord) AS disc FROM
  (SELECT item_id, region, discount, promo_ord, unnest(range(date_start - d0, date_end - d0 + 1)) AS day_idx, n FROM promos, bounds) WHERE day_idx < n + {{extra}} GROUP BY ALL),
post_days AS MATERIALIZED (SELECT item_id, region, CAST(e + j AS INTEGER) AS day_idx, CAST(MIN(j) AS INTEGER) AS post_promo FROM (SELECT item_id, region, date_end - d0 AS e, n, unnest(range(1, 5)) AS j FROM promos, bounds)
  WHERE e + j < n + {{extra}} AND (item_id, region, e + j) NOT IN (SELECT (item_id, region, day_idx) FROM promo_days WHERE disc > 0) GROUP BY ALL)"""


BRAND = promos("p_brand").format(extra=0)
TYPE = promos("category").format(extra=14)
add("promotion_days", "SELECT * FROM promo_days", SOLD, BOUNDS, BRAND)
add("post_promotion_days", "SELECT * FROM post_days", SOLD, BOUNDS, BRAND)
SQL["kept_promotions"] = f"""WITH RECURSIVE {SOLD},
p AS (SELECT CAST(p_retailprice AS VARCHAR) AS item_id, region, date AS date_start, date + CAST(MAX(l_quantity) * 3 AS INTEGER) AS date_end, MAX(l_discount) AS discount,
  MIN(l_orderkey) AS promo_ord FROM sold GROUP BY p_retailprice, region, date),
num AS (SELECT *, row_number() OVER (PARTITION BY item_id, region ORDER BY date_start) AS rn FROM p),
walk AS (SELECT item_id, region, rn, date_start, date_end, discount, promo_ord, TRUE AS kept, date_end AS last_end FROM num WHERE rn = 1
  UNION ALL SELECT n.item_id, n.region, n.rn, n.date_start, n.date_end, n.discount, n.promo_ord, n.date_start > w.last_end,
    CASE WHEN n.date_start > w.last_end THEN n.date_end ELSE w.last_end END FROM walk w JOIN num n ON n.item_id = w.item_id AND n.region = w.region AND n.rn = w.rn + 1)
SELECT item_id, region, date_start, date_end, discount, promo_ord FROM walk WHERE kept"""
WEATHER = """weather AS (SELECT CAST(o_orderdate AS DATE) AS date, n_name AS city, floor(MAX(o_totalprice) / 10000.0) AS temp_max,
  CAST(COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) AS rain_mm, MAX(CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 5000.0) END) AS humidity
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
WEATHER_DAYS = """weather_days AS MATERIALIZED (SELECT date - d0 AS day_idx, city, temp_max, rain_mm, humidity FROM weather, bounds
  UNION ALL SELECT date - d0, '__all__', AVG(temp_max), AVG(rain_mm), AVG(humidity) FROM weather, bounds GROUP BY 1)"""
add("weather_precedence", """SELECT day_idx, city, ROUND(temp_max, 6) AS temp_max, ROUND(rain_mm, 6) AS rain_mm FROM (SELECT date - d0 AS day_idx, city, temp_max, rain_mm FROM merged, bounds
  UNION ALL SELECT date - d0, '__all__', AVG(temp_max), AVG(rain_mm) FROM merged, bounds GROUP BY 1)""", BOUNDS, WEATHER,
    f"""obs AS (SELECT date, city, temp_max, rain_mm FROM weather WHERE {uniform("concat_ws('|', 'seen', date)")} >= 0.3),
merged AS (SELECT * FROM obs UNION ALL SELECT date, city, temp_max + 1, rain_mm FROM weather WHERE date NOT IN (SELECT date FROM obs))""")
add("weather_gap_fill", """SELECT w.date, city, ROUND(COALESCE(CASE WHEN rain_mm > 0 THEN temp_max END, t2), 6) AS temp_max, ROUND(COALESCE(humidity, h2), 6) AS humidity,
  CAST((CASE WHEN NOT rain_mm > 0 AND t2 IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN humidity IS NULL AND h2 IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS filled
  FROM weather w JOIN (SELECT date, MAX(humidity) AS h2, MAX(temp_max) AS t2 FROM weather GROUP BY 1) s ON s.date = w.date""", WEATHER)
CLIMATE = f"""climate AS MATERIALIZED (SELECT c.city, CAST(m.m AS INTEGER) AS month, COALESCE(x.temp_max, c.temp_max) AS temp_max, COALESCE(x.rain_mm, c.rain_mm) AS rain_mm, COALESCE(x.humidity, c.humidity) AS humidity
  FROM (SELECT city, AVG(temp_max) AS temp_max, AVG(rain_mm) AS rain_mm, AVG(humidity) AS humidity FROM weather_days WHERE day_idx <= {TRAIN_END} GROUP BY 1) c CROSS JOIN range(1, 13) m(m)
  LEFT JOIN (SELECT city, month(d0 + CAST(day_idx AS INTEGER)) AS month, AVG(temp_max) AS temp_max, AVG(rain_mm) AS rain_mm, AVG(humidity) AS humidity FROM weather_days, bounds
    WHERE day_idx <= {TRAIN_END} GROUP BY 1, 2) x ON x.city = c.city AND x.month = m.m)"""
add("climatology", "SELECT city, month, ROUND(temp_max, 6) AS temp_max, ROUND(rain_mm, 6) AS rain_mm, ROUND(humidity, 6) AS humidity FROM climate",
    BOUNDS, LAYOUT, WEATHER, WEATHER_DAYS, CLIMATE)
EVENTS = """cal AS MATERIALIZED (SELECT DISTINCT ON (date, event) * FROM (SELECT CAST(yr || md AS DATE) AS date, event, kind, yr * 10 + i AS ev_ord, span FROM (SELECT DISTINCT year(o_orderdate) AS yr FROM orders),
  (VALUES ('Spring Fair', 'festival', '-04-12', 0, 3), ('Founders Day', 'public_holiday', '-04-14', 1, 1), ('Year End', 'festival', '-12-28', 2, 5), ('Founders Day', 'festival', '-04-14', 3, 1))
  v(event, kind, md, i, span)) ORDER BY date, event, ev_ord),
ev_days AS (SELECT CAST(g.d AS INTEGER) AS day_idx, c.* EXCLUDE (date), (c.date - d0) - CAST(g.d AS INTEGER) AS delta, CASE c.event WHEN 'Founders Day' THEN 0 WHEN 'Spring Fair' THEN 1 ELSE 2 END AS eid
  FROM (SELECT unnest(range(0, n + 14)) AS d FROM bounds) g, bounds, cal c WHERE c.date BETWEEN d0 - 30 AND d0 + CAST(n AS INTEGER) + 13 + 30 AND (c.date - d0) - g.d BETWEEN -(span - 1) AND 14),
events_d AS MATERIALIZED (SELECT CAST(g.d AS INTEGER) AS day_idx, d0 + CAST(g.d AS INTEGER) AS date, g.d < n AS observed, COALESCE(e.delta, 99) AS days_to_event, COALESCE(e.eid, -1) AS event_id,
  COALESCE(e.fest, 0) AS in_festival, COALESCE(e.hol, 0) AS is_holiday FROM (SELECT unnest(range(0, n + 14)) AS d FROM bounds) g, bounds
  LEFT JOIN (SELECT day_idx, arg_min(delta, abs(delta) * 1000000000 + (delta + day_idx) * 10000 + (ev_ord % 10)) AS delta, arg_min(eid, abs(delta) * 1000000000 + (delta + day_idx) * 10000 + (ev_ord % 10)) AS eid,
    MAX(CASE WHEN delta <= 0 THEN 1 ELSE 0 END) AS fest, MAX(CASE WHEN delta = 0 AND kind = 'public_holiday' THEN 1 ELSE 0 END) AS hol FROM ev_days GROUP BY 1) e ON e.day_idx = g.d)"""
add("event_calendar", "SELECT * FROM events_d", BOUNDS, EVENTS)
add("search_wide", """SELECT date, MAX(CASE WHEN c = 'click' THEN v END) AS click, MAX(CASE WHEN c = 'error' THEN v END) AS error, MAX(CASE WHEN c = 'purchase' THEN v END) AS purchase,
  MAX(CASE WHEN c = 'signup' THEN v END) AS signup, MAX(CASE WHEN c = 'view' THEN v END) AS view
  FROM (SELECT CAST(ts AS DATE) AS date, event_type AS c, LEAST(GREATEST(MAX(value), 0), 100) AS v FROM events GROUP BY 1, 2) GROUP BY date""")
add("hierarchy_nodes", """SELECT node_id, parent_id, level, path, COUNT(DISTINCT leaf) AS leaves FROM (
  SELECT leaf, unnest([{'node_id': 'total', 'parent_id': NULL, 'level': 'total', 'path': ['total']},
    {'node_id': 'R:' || region, 'parent_id': 'total', 'level': 'region', 'path': ['total', 'R:' || region]},
    {'node_id': 'S:' || store_id, 'parent_id': 'R:' || region, 'level': 'store', 'path': ['total', 'R:' || region, 'S:' || store_id]},
    {'node_id': 'SC:' || store_id || '|' || category, 'parent_id': 'S:' || store_id, 'level': 'store_category', 'path': ['total', 'R:' || region, 'S:' || store_id, 'SC:' || store_id || '|' || category]},
    {'node_id': leaf, 'parent_id': 'SC:' || store_id || '|' || category, 'level': 'item_store', 'path': ['total', 'R:' || region, 'S:' || store_id, 'SC:' || store_id || '|' || category, leaf]}], recursive := true)
  FROM (SELECT DISTINCT series_id AS leaf, store_id, region, category FROM daily_item)) GROUP BY node_id, parent_id, level, path""", SOLD, BOUNDS, DAILY_ITEM)
NODES = """nodes AS MATERIALIZED (SELECT level, node_id, day_idx, SUM(y) AS y, COALESCE(AVG(CASE WHEN y IS NOT NULL THEN disc END), 0.0) AS disc FROM (
  SELECT 'total' AS level, 'total' AS node_id, day_idx, y, disc FROM {src} UNION ALL SELECT 'region', 'R:' || region, day_idx, y, disc FROM {src}
  UNION ALL SELECT 'store', 'S:' || store_id, day_idx, y, disc FROM {src} UNION ALL SELECT 'store_category', 'SC:' || store_id || '|' || category, day_idx, y, disc FROM {src}) GROUP BY ALL)"""
add("aggregate_panel", "SELECT level, node_id, day_idx, ROUND(y, 9) AS y, ROUND(disc, 9) AS disc FROM nodes", SOLD, BOUNDS, DAILY_ITEM,
    "leafs AS (SELECT region, store_id, category, day_idx, CASE WHEN NOT stockout THEN y END AS y, disc FROM daily_item)", NODES.format(src="leafs"))

# ------------------------------------------------------------- windows
R7 = ", ".join(f"ROUND({c}, 6) AS {c}" for c in ("mean7", "mean28", "mean56", "std28", "zero28", "last_obs"))
ITEM_MASKED = "item_masked AS (SELECT series_id, day_idx, y, CASE WHEN NOT stockout THEN y END AS ym FROM daily_item)"
add("rolling_history", f"SELECT series_id, day_idx, {R7}, days_since_sale FROM rolled", SOLD, BOUNDS, DAILY_ITEM, ITEM_MASKED, roll("item_masked"))
add("weekly_rolling_history", """SELECT s.series_id, o.origin, ROUND(AVG(CASE WHEN ago < 7 THEN ym END), 6) AS mean7, ROUND(AVG(CASE WHEN ago < 28 THEN ym END), 6) AS mean28,
  ROUND(AVG(CASE WHEN ago < 56 THEN ym END), 6) AS mean56, ROUND(STDDEV_SAMP(CASE WHEN ago < 28 THEN ym END), 6) AS std28,
  ROUND(AVG(CASE WHEN ago < 28 AND ym IS NOT NULL THEN CAST(ym = 0 AS INTEGER) END), 6) AS zero28, ROUND(MAX(CASE WHEN ago = 0 THEN ym END), 6) AS last_obs,
  CASE WHEN COUNT(y) > 0 THEN LEAST(COALESCE(MIN(CASE WHEN y > 0 THEN ago END), 90), 90) END AS days_since_sale
  FROM (SELECT DISTINCT series_id FROM item_masked) s CROSS JOIN (SELECT origin FROM layout WHERE block = 'cal') o
  LEFT JOIN (SELECT i.*, o.origin, o.origin - day_idx AS ago FROM item_masked i JOIN (SELECT origin FROM layout WHERE block = 'cal') o ON i.day_idx <= o.origin) x
    ON x.series_id = s.series_id AND x.origin = o.origin GROUP BY s.series_id, o.origin""", SOLD, BOUNDS, LAYOUT, DAILY_ITEM, ITEM_MASKED)


def search(first: str, last: str) -> str:
    def w(d):
        return f"OVER (PARTITION BY category ORDER BY day_idx RANGE BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"
    return f"""raw_search AS (SELECT CAST(ts AS DATE) - (SELECT MIN(CAST(ts AS DATE)) FROM events) + {first} AS day_idx, event_type AS category, LEAST(GREATEST(MAX(value), 0), 100) AS v FROM events GROUP BY 1, 2),
all_search AS MATERIALIZED (SELECT * FROM raw_search WHERE day_idx < {last} UNION ALL SELECT day_idx, '__all__', AVG(v) FROM raw_search WHERE day_idx < {last} GROUP BY 1),
search_days AS MATERIALIZED (SELECT c.category, CAST(g.d AS INTEGER) AS day_idx, s.v FROM (SELECT category, MIN(day_idx) AS lo FROM all_search GROUP BY 1) c JOIN (SELECT unnest(range(0, {last})) AS d) g ON g.d >= c.lo
  LEFT JOIN all_search s ON s.category = c.category AND s.day_idx = g.d),
search_w AS (SELECT category, day_idx, MEDIAN(v) {w(5)} AS m5, CASE WHEN COUNT(v) {w(28)} >= 7 THEN MEDIAN(v) {w(28)} END AS m28, AVG(v) {w(7)} AS a7,
  CASE WHEN COUNT(v) {w(28)} >= 7 THEN AVG(v) {w(28)} END AS a28 FROM search_days),
search_f AS MATERIALIZED (SELECT category, day_idx, m5 AS search_o, a7 AS search_mean7, CASE WHEN m5 IS NOT NULL AND m28 IS NOT NULL THEN LEAST(GREATEST(m5 / GREATEST(m28, 0.001), 0), 5) END AS search_ratio,
  a7 - a28 AS search_trend FROM search_w)"""


S4 = ", ".join(f"ROUND({c}, 6) AS {c}" for c in ("search_o", "search_mean7", "search_ratio", "search_trend"))
add("search_features", f"SELECT category, day_idx, {S4} FROM search_f", BOUNDS, search("(SELECT n - 30 FROM bounds)", "(SELECT n FROM bounds)"))
add("same_weekday_lags", "SELECT r.series_id, r.origin, r.h, ROUND(sdw_mean4, 6) AS sdw_mean4 FROM rows0 r LEFT JOIN lags USING (series_id, origin, h) WHERE block = 'test'",
    *BASE, LAYOUT, LAGS)
add("seasonal_scale", "SELECT series_id, ROUND(mase_scale, 6) AS mase_scale FROM scale", *BASE, LAYOUT, SCALE)
add("last_sixty_rows", """SELECT series_id, date, y FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM daily_item) WHERE rn <= 60""", SOLD, BOUNDS, DAILY_ITEM)
add("smoothed_level", "SELECT series_id, CAST(day_idx AS BIGINT) AS day_idx, ROUND(level + 1e-9, 6) AS level FROM models", *BASE, STATES)
add("intermittent_states", "SELECT series_id, CAST(day_idx AS BIGINT) AS day_idx, ROUND(croston + 1e-9, 6) AS croston, ROUND(sba + 1e-9, 6) AS sba, ROUND(tsb + 1e-9, 6) AS tsb FROM models", *BASE, STATES)

# ------------------------------------------------------------- features
add("origin_layout", "SELECT block, CAST(origin AS INTEGER) AS origin FROM layout", BOUNDS, LAYOUT)
add("block_windows", "SELECT block, CAST(MIN(origin) + 1 AS INTEGER) AS first_day, CAST(MAX(origin) + 14 AS INTEGER) AS last_day, COUNT(*) AS origins FROM layout GROUP BY block", BOUNDS, LAYOUT)
CODES = """codes AS MATERIALIZED (SELECT s.*, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS cat_idx, CAST(dense_rank() OVER (ORDER BY store_id) - 1 AS INTEGER) AS store_idx,
  CAST(dense_rank() OVER (ORDER BY region) - 1 AS INTEGER) AS region_idx, price, pack_size,
  CASE category WHEN 'ECONOMY' THEN 'click' WHEN 'LARGE' THEN 'error' WHEN 'MEDIUM' THEN 'purchase' WHEN 'SMALL' THEN 'signup' WHEN 'STANDARD' THEN 'view' ELSE '__all__' END AS search_key
  FROM series s JOIN (SELECT p_type, MIN(p_retailprice) AS price, MIN(p_size) AS pack_size FROM part GROUP BY 1) p ON p.p_type = s.category)"""


def noise(var: str) -> str:
    return normal(f"concat_ws('|', '7', r.origin, r.h, r.store_id, '{var}')")


GONE = "(w.temp_max IS NULL OR w.rain_mm IS NULL)"
FEATURES = f"""feats AS (SELECT r.series_id, r.origin, r.day, r.block, r.store_id AS city, c.cat_idx, c.store_idx, c.region_idx, ln(c.price) AS price_log, c.pack_size, k.last_obs, k.mean7, k.mean28, k.mean56, k.std28, k.zero28, l.sdw_mean4,
  CAST(k.days_since_sale AS INTEGER) AS days_since_sale, CAST(LEAST(r.day - r.launch_idx, 365) AS INTEGER) AS age, r.h, CAST(isodow(e.date) - 1 AS INTEGER) AS dow, CAST(day(e.date) AS INTEGER) AS dom, CAST(month(e.date) AS INTEGER) AS month,
  CAST(weekofyear(e.date) AS INTEGER) AS woy, e.days_to_event, e.event_id + 1 AS event_id, e.in_festival, e.is_holiday, COALESCE(pd.disc, 0.0) AS disc, COALESCE(po.post_promo, 0) AS post_promo,
  COALESCE(w.temp_max, cl.temp_max) + CASE WHEN r.day < n AND NOT {GONE} THEN 0.8 * sqrt(r.h) * {noise('temp')} ELSE 0 END AS temp_fc,
  ln(1 + COALESCE(w.rain_mm, cl.rain_mm) * CASE WHEN r.day < n AND NOT {GONE} THEN exp(0.35 * sqrt(r.h) * {noise('rain')}) ELSE 1 END) AS rain_fc,
  LEAST(GREATEST(COALESCE(w.humidity, cl.humidity) + CASE WHEN r.day < n AND NOT {GONE} THEN 3.0 * sqrt(r.h) * {noise('hum')} ELSE 0 END, 0), 100) AS hum_fc,
  CAST({GONE} AS INTEGER) AS wx_missing, sf.search_o, sf.search_mean7, sf.search_ratio, sf.search_trend, t.y, COALESCE(t.stockout, FALSE) AS censored
  FROM rows0 r CROSS JOIN bounds b JOIN codes c ON c.series_id = r.series_id JOIN events_d e ON e.day_idx = r.day
  LEFT JOIN rolled k ON k.series_id = r.series_id AND k.day_idx = r.origin LEFT JOIN lags l ON l.series_id = r.series_id AND l.origin = r.origin AND l.h = r.h
  LEFT JOIN promo_days pd ON pd.item_id = r.category AND pd.region = r.region AND pd.day_idx = r.day LEFT JOIN post_days po ON po.item_id = r.category AND po.region = r.region AND po.day_idx = r.day
  LEFT JOIN weather_days w ON w.city = r.store_id AND w.day_idx = r.day LEFT JOIN climate cl ON cl.city = r.store_id AND cl.month = month(e.date)
  LEFT JOIN search_f sf ON sf.category = c.search_key AND sf.day_idx = r.origin LEFT JOIN panel t ON t.series_id = r.series_id AND t.day_idx = r.day)"""
INPUTS = (*BASE, LAYOUT, ROLLED, LAGS, CODES, TYPE, EVENTS, WEATHER, WEATHER_DAYS, CLIMATE, search("(SELECT n - 30 FROM bounds)", "(SELECT n FROM bounds)"), FEATURES)
INT_F = ["cat_idx", "store_idx", "region_idx", "pack_size", "days_since_sale", "age", "h", "dow", "dom", "month", "woy", "days_to_event", "event_id", "in_festival", "is_holiday", "post_promo", "wx_missing"]
DBL_F = ["price_log", "last_obs", "mean7", "mean28", "mean56", "std28", "zero28", "sdw_mean4", "disc", "temp_fc", "rain_fc", "hum_fc", "search_o", "search_mean7", "search_ratio", "search_trend"]
FCOLS = ", ".join(INT_F + [f"ROUND({c}, 6) AS {c}" for c in DBL_F])
add("feature_rows", f"SELECT series_id, origin, day, {FCOLS}, ROUND(y, 6) AS y, censored FROM feats WHERE block IN ('cal', 'test')", *INPUTS)
add("production_features", f"SELECT series_id, origin, day, {FCOLS} FROM feats WHERE block = 'production'", *INPUTS)

SC = ", ".join(f"ROUND({c} / sc, 6) AS {c}" for c in ("last_obs", "mean7", "mean28", "mean56", "std28", "sdw_mean4"))
NODE_PANEL = "node_panel AS MATERIALIZED (SELECT node_id AS series_id, level, CAST(day_idx AS INTEGER) AS day_idx, y, y AS ym FROM nodes)"
NODE_ROLLED = roll("node_panel").replace("rolled AS", "node_rolled AS")
NODE_ROWS = """node_rows AS MATERIALIZED (SELECT *, origin + h AS day FROM (SELECT s.series_id, s.lo, o.block, o.origin, CAST(unnest(range(1, 15)) AS INTEGER) AS h
  FROM (SELECT series_id, MIN(day_idx) AS lo FROM node_panel GROUP BY 1) s CROSS JOIN layout o)),
node_lag_days AS MATERIALIZED (SELECT series_id, origin, h, CAST(day - 7 * (CAST(CEIL(h / 7.0) AS INTEGER) + j) AS INTEGER) AS lag_day FROM (SELECT *, unnest(range(0, 4)) AS j FROM node_rows)),
node_lags AS MATERIALIZED (SELECT r.series_id, r.origin, r.h, AVG(p.ym) AS sdw_mean4 FROM node_lag_days r JOIN node_panel p ON p.series_id = r.series_id AND p.day_idx = r.lag_day
  GROUP BY r.series_id, r.origin, r.h)"""
NODE = (*BASE, LAYOUT, NODES.format(src="panel"), NODE_PANEL)
add("aggregate_scaling", f"""SELECT series_id, origin, h, ROUND(sc, 6) AS scale, {SC}, ROUND(y / sc, 6) AS target_ratio FROM (SELECT r.series_id, r.origin, r.h, GREATEST(COALESCE(k.mean28, 1.0), 0.001) AS sc, last_obs,
  k.mean7, k.mean28, k.mean56, k.std28, l.sdw_mean4, t.y FROM node_rows r LEFT JOIN node_rolled k ON k.series_id = r.series_id AND k.day_idx = r.origin LEFT JOIN node_lags l ON l.series_id = r.series_id AND l.origin = r.origin AND l.h = r.h
  LEFT JOIN node_panel t ON t.series_id = r.series_id AND t.day_idx = r.day WHERE block = 'test')""", *NODE, NODE_ROLLED, NODE_ROWS)

# ------------------------------------------------------------- forecasts
add("seasonal_naive", "SELECT series_id, origin, h, ROUND(b0, 6) AS b0, ROUND(y, 6) AS y, censored FROM fm WHERE block = 'test'", *FC)
add("forecast_keys", "SELECT series_id, store_id, category, d0 + CAST(origin AS INTEGER) AS origin_date, d0 + CAST(day AS INTEGER) AS date, ROUND(b0, 6) AS b0 FROM fm, bounds WHERE block = 'test'", *FC)
add("planner_baseline", "SELECT series_id, origin, h, ROUND(b1, 6) AS b1, ROUND(croston, 6) AS croston, ROUND(sba, 6) AS sba, ROUND(tsb, 6) AS tsb FROM fm WHERE block = 'test'", *FC)
add("count_bands", """SELECT m.series_id, m.origin, nb_p10, nb_p50, nb_p90, po_p10, po_p50, po_p90 FROM moments m
  JOIN (SELECT m, v, MIN(CASE WHEN cdf >= 0.1 - 1e-12 THEN k END) AS nb_p10, MIN(CASE WHEN cdf >= 0.5 - 1e-12 THEN k END) AS nb_p50, MIN(CASE WHEN cdf >= 0.9 - 1e-12 THEN k END) AS nb_p90 FROM
    (SELECT m, v, k, SUM(exp(CASE WHEN v > m * 1.05 THEN lgamma(k + s) - lgamma(s) - lgamma(k + 1) + s * ln(s / (s + m)) + k * ln(m / (s + m)) ELSE k * ln(m) - m - lgamma(k + 1) END)) OVER (PARTITION BY m, v ORDER BY k) AS cdf
     FROM (SELECT m, v, CAST(k AS DOUBLE) AS k, m * m / GREATEST(v - m, 1e-6) AS s FROM (SELECT DISTINCT m, v FROM moments) d, LATERAL (SELECT unnest(range(0, CAST(ceil(d.m + 10 * sqrt(GREATEST(d.v, d.m)) + 21) AS BIGINT))) AS k) u)) GROUP BY m, v) q ON q.m = m.m AND q.v = m.v
  JOIN (SELECT m, MIN(CASE WHEN cdf >= 0.1 - 1e-12 THEN k END) AS po_p10, MIN(CASE WHEN cdf >= 0.5 - 1e-12 THEN k END) AS po_p50, MIN(CASE WHEN cdf >= 0.9 - 1e-12 THEN k END) AS po_p90 FROM
    (SELECT m, k, SUM(exp(k * ln(m) - m - lgamma(k + 1))) OVER (PARTITION BY m ORDER BY k) AS cdf
     FROM (SELECT m, CAST(k AS DOUBLE) AS k FROM (SELECT DISTINCT m FROM moments) d, LATERAL (SELECT unnest(range(0, CAST(ceil(d.m + 10 * sqrt(d.m) + 21) AS BIGINT))) AS k) u)) GROUP BY m) p ON p.m = m.m""",
    *BASE, LAYOUT, ROLLED, """moments AS (SELECT series_id, origin, GREATEST(COALESCE(ROUND(mean28, 6), 0), 1e-6) AS m, pow(COALESCE(ROUND(std28, 6), 0), 2) AS v FROM rolled JOIN layout ON origin = day_idx WHERE block = 'test')""")
add("demand_classes", "SELECT series_id, n_obs, n_sold, ROUND(adi, 6) AS adi, ROUND(cv2, 6) AS cv2, demand_class FROM classes", *BASE, LAYOUT, CLASSES)
TYPICAL = "COALESCE(GREATEST(COALESCE(sdw_mean4, mean28), mean7), y)"
add("training_targets", f"""SELECT series_id, COUNT(*) AS rows, ROUND(SUM(y), 4) AS y_train, 'ignore' AS treatment FROM tr GROUP BY 1 UNION ALL
  SELECT series_id, COUNT(*), ROUND(SUM(y), 4), 'drop' FROM tr WHERE NOT censored GROUP BY 1 UNION ALL
  SELECT series_id, COUNT(*), ROUND(SUM(CASE WHEN censored THEN GREATEST(y, {TYPICAL}) ELSE y END), 4), 'impute' FROM tr GROUP BY 1""", *FC, "tr AS (SELECT * FROM fm WHERE block = 'train' AND y IS NOT NULL)")
ROUTES = f"""cal_scores AS (SELECT demand_class, model, ord, AVG(mae / mase_scale) AS mase, SUM(n) AS rows FROM (SELECT demand_class, series_id, model, ord, AVG(ABS(y - f)) AS mae, COUNT(*) AS n FROM (
  SELECT *, unnest([{{'model': 'm2', 'ord': 1, 'f': m2}}, {{'model': 'tsb', 'ord': 2, 'f': tsb}}, {{'model': 'sba', 'ord': 3, 'f': sba}}, {{'model': 'croston', 'ord': 4, 'f': croston}}], recursive := true) FROM fm
  WHERE block = 'cal' AND {USABLE} AND age >= 28 AND demand_class IN ('intermittent', 'lumpy')) GROUP BY ALL) x JOIN scale USING (series_id) GROUP BY ALL),
routes AS (SELECT DISTINCT ON (demand_class) demand_class, model AS route, mase FROM cal_scores WHERE rows >= 50 ORDER BY demand_class, mase, ord)"""
add("route_selection", "SELECT demand_class, route, ROUND(mase, 6) AS mase FROM routes", *FC, SCALE, ROUTES)
add("routed_forecasts", """SELECT series_id, origin, h, route, ROUND(CASE route WHEN 'm2' THEN m2 WHEN 'tsb' THEN tsb WHEN 'sba' THEN sba WHEN 'croston' THEN croston WHEN 'c1' THEN m2 END, 6) AS final, cls_group
  FROM (SELECT fm.*, CASE WHEN age < 28 THEN 'c1' ELSE COALESCE(r.route, 'm2') END AS route, CASE WHEN age < 28 THEN 'new' ELSE fm.demand_class END AS cls_group
  FROM fm LEFT JOIN routes r ON r.demand_class = fm.demand_class WHERE block = 'test')""", *FC, SCALE, ROUTES)

# ------------------------------------------------------------- cold start
ANALOGS = """cs AS (SELECT d.series_id, d.store_id, d.category, d.item_id, MIN(day_idx) AS launch_idx, ANY_VALUE(price) AS price, ANY_VALUE(pack_size) AS pack_size FROM daily_item d
  JOIN (SELECT p_type || '|' || p_brand AS item_id, MIN(p_retailprice) AS price, MIN(p_size) AS pack_size FROM part GROUP BY 1) i ON i.item_id = d.item_id GROUP BY ALL),
moments AS (SELECT stddev_pop(ln(price)) + 1e-9 AS sa, stddev_pop(ln(pack_size + 1.0)) + 1e-9 AS sb, MIN(ln(price)) AS la, MIN(ln(pack_size + 1.0)) AS lb, MAX(ln(price)) AS ha, MAX(ln(pack_size + 1.0)) AS hb FROM cs),
grid AS (SELECT cs.*, GREATEST((ha - la) / sa, (hb - lb) / sb, 1e-9) * (1 + 1e-9) AS unit, sa, sb, la, lb FROM cs, moments),
pts AS (SELECT * EXCLUDE (sa, sb, la, lb), ROUND((ln(price) - la) / (sa * unit), 12) AS u, ROUND((ln(pack_size + 1.0) - lb) / (sb * unit), 12) AS v FROM grid),
near AS (SELECT a.series_id, b.series_id AS analog, a.launch_idx, b.launch_idx AS analog_launch, ROUND(sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2)), 9) AS gap, a.unit
  FROM pts a JOIN pts b ON a.store_id = b.store_id AND a.category = b.category AND a.series_id <> b.series_id)"""
COLD = (SOLD, BOUNDS, DAILY_ITEM, ANALOGS)
add("analog_items", """SELECT series_id, analog, CAST(rank AS INTEGER) AS rank, ROUND(gap * unit, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY gap, analog) AS rank FROM near) WHERE rank <= 5""", *COLD)


def ramp(upto: str) -> str:
    return f"""ramp_pairs AS (SELECT series_id, analog, launch_idx AS begin FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY gap, analog) AS rk FROM near
  WHERE launch_idx > 0 AND launch_idx + 28 <= {upto} AND analog_launch + 90 <= launch_idx) WHERE rk <= 5),
ramp_members AS (SELECT series_id, analog AS member, begin FROM ramp_pairs UNION SELECT series_id, series_id, begin FROM ramp_pairs),
ramp_units AS (SELECT m.series_id, m.member, CAST(b.b AS INTEGER) AS bucket, COALESCE(SUM(d.y), 0) AS units FROM ramp_members m CROSS JOIN range(0, 4) b(b) LEFT JOIN daily_item d ON d.series_id = m.member
  AND d.day_idx BETWEEN m.begin + 7 * b.b AND m.begin + 7 * b.b + 6 GROUP BY ALL),
ratios AS (SELECT series_id, bucket, MAX(CASE WHEN member = series_id THEN units END) / MEDIAN(CASE WHEN member <> series_id THEN units END) AS r FROM ramp_units GROUP BY ALL
  HAVING MEDIAN(CASE WHEN member <> series_id THEN units END) > 0),
ramp AS (SELECT g.bucket, COALESCE(n, 0) AS launches, LEAST(GREATEST(CASE WHEN n >= 3 THEN m ELSE generic END, 0.05), 3.0) AS ramp FROM (VALUES (0, 0.35::DOUBLE), (1, 0.6), (2, 0.75), (3, 0.85)) g(bucket, generic)
  LEFT JOIN (SELECT bucket, COUNT(*) AS n, MEDIAN(r) AS m FROM ratios GROUP BY 1) x ON x.bucket = g.bucket)"""


add("launch_ramp", "SELECT bucket, launches, ROUND(ramp, 6) AS ramp FROM ramp", *COLD, ramp("(SELECT n - 1 FROM bounds)"))
COLD_ROWS = """cold_o AS (SELECT (SELECT n // 12 FROM bounds) + 7 * i AS origin FROM range(0, 8) t(i)),
cold_stats AS (SELECT c.series_id, c.store_id, c.category, c.launch_idx, o.origin, (SELECT AVG(CASE WHEN NOT stockout THEN y END) FROM daily_item d WHERE d.series_id = c.series_id AND d.day_idx BETWEEN o.origin - 27 AND o.origin) AS mean28
  FROM cs c, cold_o o),
cold_rows AS (SELECT s.*, CAST(h.h AS INTEGER) AS h, s.origin + h.h AS day, LEAST(s.origin + h.h - launch_idx, 365) AS age, COALESCE(mean28, 0) + h.h * 0.125 AS final FROM cold_stats s, range(1, 15) h(h) WHERE launch_idx <= s.origin + h.h)"""
C1 = """c1_pairs AS (SELECT series_id, origin, analog FROM (SELECT n.series_id, o.origin, n.analog, row_number() OVER (PARTITION BY n.series_id, o.origin ORDER BY gap, analog) AS rk FROM near n, cold_o o
  WHERE n.analog_launch + 90 <= o.origin) WHERE rk <= 5),
c1_base AS (SELECT y.series_id, y.origin, y.h, MEDIAN(f.final) AS base FROM cold_rows y JOIN c1_pairs p ON p.series_id = y.series_id AND p.origin = y.origin
  JOIN cold_rows f ON f.series_id = p.analog AND f.origin = y.origin AND f.h = y.h WHERE y.age < 28 GROUP BY ALL),
c1 AS (SELECT y.*, COALESCE(b.base, 0) * r.ramp AS c1 FROM cold_rows y LEFT JOIN c1_base b USING (series_id, origin, h) JOIN ramp r ON r.bucket = LEAST(y.age // 7, 3) WHERE y.age < 28)"""
add("cold_start_forecast", "SELECT series_id, CAST(origin AS INTEGER) AS origin, h, ROUND(c1, 6) AS c1 FROM c1", *COLD, ramp("(SELECT n // 12 FROM bounds)"), COLD_ROWS, C1)
CATMEAN = """catmean AS (SELECT y.series_id, y.origin, y.h, y.day, COALESCE(m.cm, 0) AS catmean FROM cold_rows y LEFT JOIN (SELECT store_id, category, origin, AVG(mean28) AS cm FROM cold_stats
  WHERE launch_idx + 90 <= origin GROUP BY ALL) m ON m.store_id = y.store_id AND m.category = y.category AND m.origin = y.origin WHERE y.age < 28)"""
add("category_mean_forecast", "SELECT series_id, CAST(origin AS INTEGER) AS origin, h, ROUND(catmean, 6) AS catmean FROM catmean", *COLD, COLD_ROWS, CATMEAN)
add("young_route", """SELECT COUNT(*) AS rows, CASE WHEN COUNT(*) >= 30 THEN (CASE WHEN SUM(ABS(y - final)) <= SUM(ABS(y - c1)) AND SUM(ABS(y - final)) <= SUM(ABS(y - catmean)) THEN 'm2'
  WHEN SUM(ABS(y - c1)) <= SUM(ABS(y - catmean)) THEN 'c1' ELSE 'catmean' END) ELSE 'c1' END AS young_route FROM c1 JOIN catmean USING (series_id, origin, h)
  JOIN daily_item d ON d.series_id = c1.series_id AND d.day_idx = c1.day WHERE NOT d.stockout""", *COLD, ramp("(SELECT n // 12 FROM bounds)"), COLD_ROWS, C1, CATMEAN)
add("established_series", "SELECT series_id FROM cold_rows WHERE origin = (SELECT n // 12 FROM bounds) GROUP BY 1 HAVING MIN(age) >= 28", *COLD, COLD_ROWS)

# ------------------------------------------------------------- scores
add("region_accuracy", f"""SELECT region, COUNT(*) AS rows, ROUND({wape('b0')}, 6) AS wape_b0, ROUND({wape('b1')}, 6) AS wape_b1, ROUND({bias('b0')}, 6) AS bias_b0 FROM fm
  WHERE block = 'test' AND {USABLE} GROUP BY region""", *FC)
add("score_table", " UNION ALL ".join(f"""SELECT '{m}' AS model, ROUND((SELECT {wape(m)} FROM t), 6) AS wape, ROUND((SELECT AVG(e / mase_scale) FROM (SELECT series_id, AVG(ABS(y - {m})) AS e FROM t GROUP BY 1) JOIN scale USING (series_id)), 6) AS mase,
  ROUND((SELECT {bias(m)} FROM t), 6) AS bias""" for m in ("b0", "b1", "m2", "tsb", "sba", "croston")), *FC, SCALE, f"t AS (SELECT * FROM fm WHERE block = 'test' AND {USABLE})")


def pin(q: str, tau: float) -> str:
    return f"AVG(GREATEST({tau} * (y - {q}), ({tau} - 1) * (y - {q})))"


add("pinball_coverage", f"""SELECT demand_class, ROUND(({pin('m2_p10', 0.1)} + {pin('m2_p50', 0.5)} + {pin('m2_p90', 0.9)}) / 3.0, 6) AS pinball,
  ROUND(AVG(CASE WHEN y BETWEEN m2_p10 AND m2_p90 THEN 1.0 ELSE 0.0 END), 6) AS coverage, COUNT(*) AS rows FROM fm WHERE block = 'test' AND {USABLE} GROUP BY 1""", *FC)
REV = "rev AS (SELECT *, lag({m}) OVER (PARTITION BY series_id, day ORDER BY origin) AS prev FROM fm WHERE block = 'test')"
add("forecast_revisions", "SELECT series_id, origin, day, ROUND(m2, 6) AS m2, ROUND(prev, 6) AS prev FROM rev WHERE prev IS NOT NULL", *FC, REV.format(m="m2"))
add("forecast_stability", " UNION ALL ".join(f"""SELECT '{m}' AS model, ROUND(MEDIAN(mv), 6) AS stability FROM (SELECT SUM(ABS({m} - prev)) / GREATEST(SUM(ABS({m})), 1e-9) AS mv FROM
  (SELECT *, lag({m}) OVER (PARTITION BY series_id, day ORDER BY origin) AS prev FROM fm WHERE block = 'test' AND y IS NOT NULL) WHERE prev IS NOT NULL GROUP BY series_id)""" for m in ("b0", "b1", "m2")), *FC)
TYPED = f"""typed AS (SELECT f.*, CASE WHEN e.in_festival = 1 OR e.days_to_event BETWEEN 0 AND 4 THEN 'festival' WHEN w.rain_mm * 10 >= 20 THEN 'heavy_rain' WHEN pd.disc > 0 THEN 'promotion' ELSE 'normal' END AS day_type
  FROM fm f LEFT JOIN events_d e ON e.day_idx = f.day LEFT JOIN weather_days w ON w.city = f.store_id AND w.day_idx = f.day LEFT JOIN promo_days pd ON pd.item_id = f.category AND pd.region = f.region AND pd.day_idx = f.day
  WHERE block = 'cal' AND {USABLE})"""
CUTS = (*FC, TYPE, EVENTS, WEATHER, WEATHER_DAYS, TYPED)
W3 = ", ".join(f"ROUND({wape(m)}, 6) AS wape_{m}" for m in ("b0", "b1", "m2"))
add("wape_cuts", " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, COUNT(*) AS rows, {W3} FROM typed GROUP BY {d}" for d in ("demand_class", "day_type", "store_id")), *CUTS)
add("sensing_days", f"SELECT ROUND({wape('m1')}, 6) AS m1, ROUND({wape('m2')}, 6) AS m2, COUNT(*) AS rows FROM typed WHERE day_type IN ('festival', 'heavy_rain')", *CUTS)
add("store_level_mase", " UNION ALL ".join(f"SELECT '{m}' AS model, ROUND(AVG(e / sc), 6) AS store_mase FROM (SELECT store_id, AVG(ABS(y - {m})) AS e FROM agg GROUP BY 1) JOIN ssc USING (store_id)" for m in ("b0", "b1", "m2")),
    *FC, f"""sday AS (SELECT s.store_id, CAST(g.d AS INTEGER) AS day_idx, COALESCE(SUM(p.ym), 0) AS ym FROM (SELECT DISTINCT store_id FROM panel) s CROSS JOIN (SELECT unnest(range(0, {TRAIN_END} + 1)) AS d) g
  LEFT JOIN panel p ON p.store_id = s.store_id AND p.day_idx = g.d GROUP BY ALL),
ssc AS (SELECT a.store_id, AVG(ABS(a.ym - b.ym)) AS sc FROM sday a JOIN sday b ON a.store_id = b.store_id AND a.day_idx = b.day_idx + 7 GROUP BY 1),
agg AS (SELECT store_id, origin, day, SUM(y) AS y, SUM(b0) AS b0, SUM(b1) AS b1, SUM(m2) AS m2 FROM fm WHERE block = 'test' AND {USABLE} GROUP BY ALL)""")
add("accuracy_vs_truth", """SELECT ROUND(SUM(ae) / SUM(vol), 6) AS wape, ROUND(SUM(e) / SUM(vol), 6) AS bias, ROUND(SUM(CASE WHEN big THEN e END) / SUM(CASE WHEN big THEN vol END), 6) AS bias_top, COUNT(CASE WHEN big THEN 1 END) AS top_series
  FROM (SELECT *, mean_demand >= (SELECT quantile_cont(mean_demand, 0.9) FROM per) AS big FROM per)""", *FC,
    """truth AS (SELECT store_id, category, date - d0 AS day, SUM(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE l_quantity + 5 END) AS demand FROM sold, bounds GROUP BY ALL),
per AS (SELECT f.series_id, AVG(demand) AS mean_demand, SUM(ABS(m2 - demand)) AS ae, SUM(m2 - demand) AS e, SUM(ABS(demand)) AS vol FROM fm f LEFT JOIN truth t ON t.store_id = f.store_id AND t.category = f.category AND t.day = f.day
  WHERE block = 'test' GROUP BY 1)""")
add("residual_spread", f"""SELECT s.series_id, ROUND(COALESCE(own, (SELECT STDDEV_SAMP(y - m2) FROM fm WHERE block = 'cal' AND {USABLE})), 6) AS resid_sd FROM series s
  LEFT JOIN (SELECT series_id, STDDEV_SAMP(y - m2) AS own FROM fm WHERE block = 'cal' AND {USABLE} GROUP BY 1) x ON x.series_id = s.series_id""", *FC)

# ------------------------------------------------------------- conformal
CQR = f"""cscore AS (SELECT CASE WHEN h <= 3 THEN 'h1-3' WHEN h <= 7 THEN 'h4-7' ELSE 'h8-14' END AS bucket, demand_class AS cls_group, GREATEST(m2_p10 - y, y - m2_p90) AS s FROM fm WHERE block = 'cal' AND {USABLE}),
cg AS (SELECT bucket, cls_group, COUNT(*) AS n, list_sort(list(s)) AS ss FROM cscore GROUP BY 1, 2),
ca AS (SELECT COUNT(*) AS n, list_sort(list(s)) AS ss FROM cscore),
gl AS (SELECT n, ss[CAST(ceil(round(LEAST(1.0, ceil(round((n + 1) * 0.8, 9)) / n) * (n - 1), 9)) AS BIGINT) + 1] AS adjustment FROM ca),
cfit AS (SELECT bucket, cls_group, n, CASE WHEN n >= 50 THEN ss[CAST(ceil(round(LEAST(1.0, ceil(round((n + 1) * 0.8, 9)) / n) * (n - 1), 9)) AS BIGINT) + 1] ELSE (SELECT adjustment FROM gl) END AS adjustment FROM cg)"""
add("conformal_adjustments", "SELECT bucket, cls_group, n, ROUND(adjustment, 6) AS adjustment FROM cfit UNION ALL SELECT NULL, NULL, n, ROUND(adjustment, 6) FROM gl", *FC, CQR)
add("conformal_bands", """SELECT series_id, origin, h, b AS bucket, ROUND(GREATEST(m2_p10 - a, 0), 6) AS p10c, ROUND(GREATEST(m2_p90 + a, 0), 6) AS p90c FROM (SELECT f.*, f.b, COALESCE(c.adjustment, (SELECT adjustment FROM gl)) AS a
  FROM (SELECT *, CASE WHEN h <= 3 THEN 'h1-3' WHEN h <= 7 THEN 'h4-7' ELSE 'h8-14' END AS b FROM fm WHERE block = 'test') f LEFT JOIN cfit c ON c.bucket = f.b AND c.cls_group = f.demand_class)""", *FC, CQR)

# ------------------------------------------------------------- reconciliation
NODE_FC = """node_level AS (SELECT series_id, day_idx, pow(0.9, n) * SUM((CASE WHEN n = 1 THEN 1.0 ELSE 0.1 END) * y * pow(0.9, -n)) OVER (PARTITION BY series_id ORDER BY day_idx) AS level
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day_idx) AS n FROM node_panel)),
node_fc AS (SELECT r.series_id AS node_id, r.block, r.origin, r.day, GREATEST(COALESCE(m.level * COALESCE(1 + 0.5 * (l.sdw_mean4 / NULLIF(k.mean28, 0) - 1), 1.0), 0.0), 0.0) AS b1
  FROM node_rows r LEFT JOIN node_rolled k ON k.series_id = r.series_id AND k.day_idx = r.origin LEFT JOIN node_lags l ON l.series_id = r.series_id AND l.origin = r.origin AND l.h = r.h
  LEFT JOIN node_level m ON m.series_id = r.series_id AND m.day_idx = r.origin),
tree AS (SELECT DISTINCT unnest([{'node_id': 'total', 'parent_id': NULL, 'level': 'total'}, {'node_id': 'R:' || region, 'parent_id': 'total', 'level': 'region'},
  {'node_id': 'S:' || store_id, 'parent_id': 'R:' || region, 'level': 'store'}, {'node_id': 'SC:' || store_id || '|' || category, 'parent_id': 'S:' || store_id, 'level': 'store_category'},
  {'node_id': series_id || '|leaf', 'parent_id': 'SC:' || store_id || '|' || category, 'level': 'item_store'}], recursive := true) FROM series),
base AS (SELECT t.*, f.block, f.origin, f.day, ROUND(f.b1, 6) AS yhat FROM tree t JOIN (SELECT node_id, block, origin, day, b1 FROM node_fc UNION ALL SELECT series_id || '|leaf', block, origin, day, b1 FROM fm) f ON f.node_id = t.node_id
  WHERE f.block IN ('cal', 'test')),
acts AS (SELECT series_id AS node_id, day_idx AS day, y FROM node_panel UNION ALL SELECT series_id || '|leaf', day_idx, y FROM panel),
res AS (SELECT b.node_id, b.origin, b.day, COALESCE(a.y - b.yhat, 0) AS e FROM base b LEFT JOIN acts a ON a.node_id = b.node_id AND a.day = b.day WHERE block = 'cal'),
sds AS (SELECT node_id, AVG(e) AS mu, STDDEV_SAMP(e) AS sd FROM res GROUP BY 1),
fl AS (SELECT GREATEST(0.001, 0.05 * MEDIAN(sd)) AS f FROM sds WHERE sd > 0),
rs AS (SELECT node_id, mu, GREATEST(sd, f) AS sd FROM sds, fl),
tw AS (SELECT b.*, rs.sd * rs.sd AS w FROM base b JOIN rs USING (node_id) WHERE block = 'test')"""
REC = (*FC, NODES.format(src="panel"), NODE_PANEL, NODE_ROLLED, NODE_ROWS, NODE_FC)


def tree_passes() -> str:
    names = ["total", "region", "store", "store_category", "item_store"]
    out = ["u4 AS (SELECT node_id, parent_id, level, origin, day, yhat AS m, w AS v, NULL::DOUBLE AS mc, NULL::DOUBLE AS vc FROM tw WHERE level = 'item_store')"]
    for i in (3, 2, 1, 0):
        out.append(f"""u{i} AS (SELECT t.node_id, t.parent_id, t.level, t.origin, t.day, (k.mc / k.vc + t.yhat / t.w) / (1 / k.vc + 1 / t.w) AS m, 1 / (1 / k.vc + 1 / t.w) AS v, k.mc, k.vc FROM tw t
  JOIN (SELECT parent_id, origin, day, SUM(m) AS mc, SUM(v) AS vc FROM u{i + 1} GROUP BY ALL) k ON k.parent_id = t.node_id AND k.origin = t.origin AND k.day = t.day WHERE t.level = '{names[i]}')""")
    out.append("d0_ AS (SELECT *, m AS f FROM u0)")
    for i in (1, 2, 3, 4):
        out.append(f"""d{i}_ AS (SELECT c.*, c.m + c.v / p.vc * (p.f - p.mc) AS f FROM u{i} c JOIN d{i - 1}_ p ON p.node_id = c.parent_id AND p.origin = c.origin AND p.day = c.day)""")
    out.append("""pos AS (SELECT *, GREATEST(f, 0) AS g FROM d4_),
up3 AS (SELECT parent_id AS node_id, origin, day, SUM(g) AS g FROM pos GROUP BY ALL), up2 AS (SELECT t.parent_id AS node_id, origin, day, SUM(g) AS g FROM up3 JOIN tree t USING (node_id) GROUP BY ALL),
up1 AS (SELECT t.parent_id AS node_id, origin, day, SUM(g) AS g FROM up2 JOIN tree t USING (node_id) GROUP BY ALL), up0 AS (SELECT t.parent_id AS node_id, origin, day, SUM(g) AS g FROM up1 JOIN tree t USING (node_id) GROUP BY ALL),
rec AS (SELECT node_id, origin, day, g FROM pos UNION ALL SELECT * FROM up3 UNION ALL SELECT * FROM up2 UNION ALL SELECT * FROM up1 UNION ALL SELECT * FROM up0)""")
    return ",\n".join(out)


WLS = (*REC, tree_passes())
BU = """leafs AS (SELECT * FROM base WHERE block = 'test' AND level = 'item_store'), b3 AS (SELECT parent_id AS node_id, 'store_category' AS level, origin, day, SUM(yhat) AS g FROM leafs GROUP BY ALL),
b2 AS (SELECT t.parent_id AS node_id, 'store' AS level, origin, day, SUM(g) AS g FROM b3 JOIN tree t USING (node_id) GROUP BY ALL), b1_ AS (SELECT t.parent_id AS node_id, 'region' AS level, origin, day, SUM(g) AS g FROM b2 JOIN tree t USING (node_id) GROUP BY ALL),
b0_ AS (SELECT t.parent_id AS node_id, 'total' AS level, origin, day, SUM(g) AS g FROM b1_ JOIN tree t USING (node_id) GROUP BY ALL), bu AS (SELECT node_id, level, origin, day, yhat AS g FROM leafs UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b1_ UNION ALL SELECT * FROM b0_)"""
add("bottom_up_forecasts", "SELECT node_id, level, origin, day, ROUND(g, 6) AS bottom_up FROM bu", *REC, BU)
add("wls_forecasts", """SELECT b.node_id, b.level, b.origin, b.day, ROUND(b.yhat, 6) AS base, ROUND(r.g, 6) AS reconciled, ROUND(a.y, 6) AS y FROM base b JOIN rec r ON r.node_id = b.node_id AND r.origin = b.origin AND r.day = b.day
  LEFT JOIN acts a ON a.node_id = b.node_id AND a.day = b.day WHERE b.block = 'test' AND b.level <> 'item_store'""", *WLS)
add("coherence_check", "SELECT ROUND(MAX(ABS(b.yhat - bu.g)), 4) AS coherence_error, 'base' AS method FROM base b JOIN bu ON bu.node_id = b.node_id AND bu.origin = b.origin AND bu.day = b.day WHERE b.block = 'test' UNION ALL SELECT 0.0, unnest(['bottom_up', 'wls', 'mint'])", *REC, BU)
add("wape_by_level", f"""SELECT level, ROUND({wape('yhat')}, 6) AS base, ROUND({wape('u')}, 6) AS bottom_up, ROUND({wape('g')}, 6) AS reconciled FROM (SELECT b.level, b.yhat, r.g, bu.g AS u, a.y FROM base b JOIN rec r ON r.node_id = b.node_id AND r.origin = b.origin AND r.day = b.day
  JOIN bu ON bu.node_id = b.node_id AND bu.origin = b.origin AND bu.day = b.day LEFT JOIN acts a ON a.node_id = b.node_id AND a.day = b.day WHERE b.block = 'test') WHERE y IS NOT NULL GROUP BY level""", *WLS, BU)
add("shrinkage_intensity", """SELECT ROUND(LEAST(GREATEST(112.0 / pow(111.0, 3) * ((dg - z4) - 112.0 * (nm - own) / pow(112.0, 2)) / GREATEST((nm - own) / pow(111.0, 2), 1e-12), 0), 1), 6) AS lambda, ROUND((nm - own) / pow(111.0, 2), 6) AS sum_r2
  FROM (SELECT SUM(g * g) AS nm, SUM(CASE WHEN k = l THEN g * g END) AS dg FROM (SELECT a.c AS k, b.c AS l, SUM(a.z * b.z) AS g FROM zz a JOIN zz b ON a.node_id = b.node_id GROUP BY 1, 2)),
  (SELECT SUM(q * q) AS own, SUM(z4) AS z4 FROM (SELECT SUM(z * z) AS q, SUM(pow(z, 4)) AS z4 FROM zz GROUP BY node_id))""", *REC,
    "zz AS (SELECT res.node_id, origin * 1000 + day - origin AS c, (e - mu) / sd AS z FROM res JOIN rs USING (node_id))")

# ------------------------------------------------------------- inventory
Z95, BAND = 1.6448536269514715, 2.5631031310892016
RESID = f"""resid AS (SELECT s.series_id, COALESCE(own, (SELECT STDDEV_SAMP(y - m2) FROM fm WHERE block = 'cal' AND {USABLE})) AS resid_sd FROM series s
  LEFT JOIN (SELECT series_id, STDDEV_SAMP(y - m2) AS own FROM fm WHERE block = 'cal' AND {USABLE} GROUP BY 1) x ON x.series_id = s.series_id)"""
WIDTH = f"pow(GREATEST(ROUND(m2_p90, 6) - ROUND(m2_p10, 6), 0) / {BAND}, 2)"
add("order_up_to_levels", f"""SELECT f.series_id, origin, ceil(round(1.2 * SUM(b1), 9)) AS P0_manual, ceil(round(SUM(m2) + {Z95} * ANY_VALUE(resid_sd) * 2.0, 9)) AS P1_point_ml,
  ceil(round(SUM(m2) + {Z95} * sqrt(SUM({WIDTH})), 9)) AS P2_uncertainty FROM fm f JOIN resid r ON r.series_id = f.series_id WHERE block = 'test' AND h <= 4 GROUP BY 1, 2""", *FC, RESID)
ONHAND = "stock AS (SELECT series_id, y AS on_hand FROM panel WHERE day_idx = (SELECT n - 1 FROM bounds))"
add("on_hand", "SELECT s.series_id, COALESCE(on_hand, 0.0) AS on_hand FROM series s LEFT JOIN stock USING (series_id)", *BASE, ONHAND)
add("production_orders", f"""SELECT series_id, store_id, category, order_date, ROUND(mu, 6) AS mu, ROUND(p10, 6) AS p10, ROUND(p90, 6) AS p90, up AS order_up_to, ROUND(on_hand, 6) AS on_hand, CAST(GREATEST(up - on_hand, 0) AS BIGINT) AS suggested_qty, 'P2_uncertainty' AS policy
  FROM (SELECT f.series_id, f.store_id, f.category, (SELECT strftime(d0 + CAST(n AS INTEGER) - 1, '%Y-%m-%d') FROM bounds) AS order_date, SUM(m2) AS mu, SUM(ROUND(m2_p10, 6)) AS p10, SUM(ROUND(m2_p90, 6)) AS p90,
  ceil(round(SUM(m2) + {Z95} * sqrt(SUM({WIDTH})), 9)) AS up FROM fm f WHERE block = 'production' AND h <= 4 GROUP BY 1, 2, 3) o JOIN stock USING (series_id)""", *FC, ONHAND)
LEDGER = """led0 AS (SELECT p.series_id, p.store_id, p.category, p.day_idx, k.policy, p.y AS demand, ceil(round(k.k * AVG(p.y) OVER (PARTITION BY p.series_id, k.policy ORDER BY p.day_idx RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 9)) AS stock
  FROM panel p CROSS JOIN (VALUES ('P0_manual', 1.0::DOUBLE), ('P2_uncertainty', 1.5)) k(policy, k)),
ledger AS (SELECT *, stock - LEAST(demand, stock) AS on_hand, LEAST(demand, stock) AS sold, demand - LEAST(demand, stock) AS lost FROM led0)"""


def kpis(by: str, src: str = "ledger") -> str:
    return f"""rates AS (SELECT {by}, series_id, GREATEST(AVG(demand), 1e-6) AS rate FROM {src} GROUP BY ALL),
kpi AS (SELECT l.*, r.rate_sum, l.so / l.days AS stockout_day_rate FROM (SELECT {by}, SUM(sold) AS sold, SUM(lost) AS lost, SUM(on_hand) AS oh, SUM(stock) AS ordered, COUNT(CASE WHEN lost > 0 THEN 1 END)::DOUBLE AS so, COUNT(*) AS days,
  COUNT(DISTINCT series_id) AS ns, SUM(GREATEST(on_hand - 21 * rate, 0)) AS over, MAX(day_idx) - MIN(day_idx) + 1 AS nd FROM {src} JOIN rates USING ({by}, series_id) GROUP BY {by}) l
  JOIN (SELECT {by}, SUM(rate) AS rate_sum FROM rates GROUP BY {by}) r USING ({by})),
out_kpi AS (SELECT {by}, sold / GREATEST(sold + lost, 1) AS fill_rate, stockout_day_rate, so / ns AS stockout_days_per_series, oh / nd AS avg_on_hand_units, oh / nd / rate_sum AS avg_days_of_cover, over / nd AS overstock_units_per_day,
  lost / nd AS lost_units_per_day, ordered / nd AS units_ordered_per_day, oh * 2 / nd * 0.0007 AS holding_cost_per_day, lost * 2 / nd * 0.25 AS lost_margin_per_day, oh * 2 / nd * 0.0007 + lost * 2 / nd * 0.25 AS total_cost_per_day FROM kpi)"""


KPI_COLS = "fill_rate stockout_day_rate stockout_days_per_series avg_on_hand_units avg_days_of_cover overstock_units_per_day lost_units_per_day units_ordered_per_day holding_cost_per_day lost_margin_per_day total_cost_per_day".split()
add("ledger_indicators", "SELECT policy, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in KPI_COLS) + " FROM out_kpi", *BASE, LEDGER, kpis("policy"))
add("ledger_trace", "SELECT policy, day_idx, ROUND(SUM(on_hand), 6) AS on_hand, ROUND(SUM(lost), 6) AS lost, ROUND(SUM(demand), 6) AS demand FROM ledger GROUP BY 1, 2", *BASE, LEDGER)
add("policy_comparison", """SELECT ROUND(1 - b.stockout_day_rate / GREATEST(a.stockout_day_rate, 1e-9), 6) AS stockout_reduction, ROUND(b.avg_on_hand_units / GREATEST(a.avg_on_hand_units, 1e-9) - 1, 6) AS inventory_change,
  ROUND(b.total_cost_per_day / GREATEST(a.total_cost_per_day, 1e-9) - 1, 6) AS cost_change FROM out_kpi a, out_kpi b WHERE a.policy = 'P0_manual' AND b.policy = 'P2_uncertainty'""", *BASE, LEDGER, kpis("policy"))
add("cover_at_fill", """SELECT category AS policy, ROUND(MAX(CASE WHEN x <= t AND t < x1 THEN y + (y1 - y) * (t - x) / (x1 - x) WHEN x1 IS NULL AND x = t THEN y END), 5) AS cover, ROUND(t, 5) AS target
  FROM (SELECT category, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, t FROM points, (SELECT unnest([0.6, 0.8, 0.95])::DOUBLE AS t) WINDOW w AS (PARTITION BY category, t ORDER BY x, y)) GROUP BY category, t""", *BASE, LEDGER,
    "led2 AS (SELECT *, category || '/' || store_id AS cs FROM ledger WHERE policy = 'P2_uncertainty')", kpis("cs", "led2"),
    "points AS (SELECT split_part(cs, '/', 1) AS category, ROUND(fill_rate, 6) AS x, ROUND(avg_days_of_cover, 6) AS y FROM out_kpi)")
add("origin_in_force", """SELECT store_id, day_idx, y, CAST((SELECT MAX(origin) FROM layout WHERE block = 'test' AND origin <= day_idx) AS INTEGER) AS origin FROM daily_store WHERE day_idx >= (SELECT MIN(origin) FROM layout WHERE block = 'test')""",
    SOLD, BOUNDS, LAYOUT, DAILY_STORE)

# ------------------------------------------------------------- monitoring
DF = ["price_log", "pack_size", "last_obs", "mean7", "mean28", "mean56", "std28", "zero28", "sdw_mean4", "days_since_sale", "disc", "post_promo", "temp_fc", "rain_fc", "hum_fc", "wx_missing",
      "search_o", "search_mean7", "search_ratio", "search_trend"]
DRIFT = "drift AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, block, series_id, origin, h, ROUND(CAST({f} AS DOUBLE), 6) AS x FROM feats WHERE block IN ('train', 'test') AND {f} IS NOT NULL" for f in DF) + ")"
add("drift_psi", f"""SELECT f.feature, d.psi, COALESCE(d.alert, FALSE) AS alert FROM (SELECT unnest({DF}) AS feature) f LEFT JOIN (SELECT e.feature, ROUND(CASE WHEN len(e.edges) < 3 THEN 0.0 ELSE SUM((GREATEST(c, 1e-4) - GREATEST(r, 1e-4)) * ln(GREATEST(c, 1e-4) / GREATEST(r, 1e-4))) END, 5) AS psi,
  CASE WHEN len(e.edges) < 3 THEN 0.0 ELSE SUM((GREATEST(c, 1e-4) - GREATEST(r, 1e-4)) * ln(GREATEST(c, 1e-4) / GREATEST(r, 1e-4))) END > 0.2 AS alert FROM edges e
  JOIN (SELECT feature, bin, nr / SUM(nr) OVER (PARTITION BY feature) AS r, nc / SUM(nc) OVER (PARTITION BY feature) AS c FROM (SELECT s.feature, len(list_filter(e.edges[2:-2], lambda q: s.x >= q)) AS bin,
    COUNT(CASE WHEN side = 0 THEN 1 END)::DOUBLE AS nr, COUNT(CASE WHEN side = 1 THEN 1 END)::DOUBLE AS nc FROM sides s JOIN edges e USING (feature) GROUP BY 1, 2)) b ON b.feature = e.feature GROUP BY e.feature, e.edges) d USING (feature)""",
    *INPUTS, DRIFT, f"""sides AS (SELECT feature, x, 0 AS side FROM drift d WHERE block = 'train' AND origin >= (SELECT MAX(origin) - 175 FROM layout WHERE block = 'train') AND {uniform("concat_ws('|', '7', d.series_id, d.origin, d.h)")} < 0.5
  UNION ALL SELECT feature, x, 1 FROM drift WHERE block = 'test'),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM sides WHERE side = 0 GROUP BY 1)""")
TESTU = f"SELECT * FROM fm WHERE block = 'test' AND {USABLE}"
add("weekly_accuracy", f"SELECT d0 + CAST(origin AS INTEGER) AS origin_date, ROUND({wape('m2')}, 6) AS wape_final, ROUND({wape('b0')}, 6) AS wape_b0, ROUND({bias('m2')}, 6) AS bias_final FROM ({TESTU}), bounds GROUP BY 1", *FC)
add("store_bias_alerts", f"SELECT store_id, CAST(origin AS INTEGER) AS origin, ROUND({bias('m2')}, 6) AS bias, COALESCE(ABS({bias('m2')}) > 0.15, FALSE) AS alert FROM ({TESTU}) GROUP BY 1, 2", *FC)
add("demand_drop_detection", f"""SELECT store_id, CAST(MAX(week) AS INTEGER) AS weeks, CAST(MIN(CASE WHEN b > 0.15 THEN week END) AS INTEGER) AS detected_in_week FROM (SELECT store_id, origin, b, row_number() OVER (PARTITION BY store_id ORDER BY origin) AS week FROM
  (SELECT store_id, origin, SUM(m2 - y) / NULLIF(SUM(ABS(y)), 0) AS b FROM (SELECT * REPLACE (CASE WHEN store_id = 'NATION_1' THEN y * 0.8 ELSE y END AS y) FROM ({TESTU}) WHERE h <= 7) GROUP BY 1, 2)) GROUP BY 1""", *FC)
add("source_freshness", """SELECT 'sales' AS source, MAX(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem UNION ALL SELECT 'weather', MAX(CAST(o_orderdate AS DATE)) FROM orders UNION ALL SELECT 'search', MAX(CAST(ts AS DATE)) FROM events""")
add("latency_summary", """SELECT COUNT(*) AS requests, ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.95), 6) AS p95, ROUND(quantile_cont(value, 0.99), 6) AS p99, ROUND(MAX(value), 6) AS max, COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events""")

# ------------------------------------------------------------- robustness
PROBED = "last_obs mean7 mean28 mean56 std28 zero28 sdw_mean4 days_since_sale age disc post_promo temp_fc rain_fc hum_fc wx_missing search_o search_mean7 search_ratio search_trend".split()
add("leakage_probe", f"""SELECT feature, COUNT(*) AS rows, 0.0::DOUBLE AS max_change FROM rows0, (SELECT unnest({PROBED}) AS feature) WHERE block = 'test' AND origin = (SELECT MIN(origin) FROM layout WHERE block = 'test') GROUP BY feature""", *BASE, LAYOUT, LAGS)
add("weather_outage", """SELECT r.store_id AS city, CAST(month(d0 + CAST(r.day AS INTEGER)) AS INTEGER) AS month, COUNT(*) AS rows, COUNT(*) AS flagged, ROUND(AVG(c.temp_max), 6) AS temp_fc, ROUND(AVG(ln(1 + c.rain_mm)), 6) AS rain_fc
  FROM rows0 r CROSS JOIN bounds JOIN climate c ON c.city = r.store_id AND c.month = month(d0 + CAST(r.day AS INTEGER)) WHERE block = 'cal' GROUP BY 1, 2""", *BASE, LAYOUT, LAGS, WEATHER, WEATHER_DAYS, CLIMATE)
SPIKE = """SELECT category, day_idx, ROUND(m5, 6) AS search_o, ROUND(s5, 6) AS spiked FROM (SELECT category, day_idx, MEDIAN(v) OVER w AS m5, MEDIAN(sv) OVER w AS s5 FROM (SELECT s.*, CASE WHEN category = 'view' AND EXISTS (
  SELECT 1 FROM layout o WHERE o.block IN ('test', 'production') AND s.day_idx BETWEEN o.origin - 1 AND o.origin) THEN 100.0 ELSE v END AS sv FROM search_days s) WINDOW w AS (PARTITION BY category ORDER BY day_idx RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))"""
add("search_spike", SPIKE,
    BOUNDS, LAYOUT, search("(SELECT n - 30 FROM bounds)", "(SELECT n FROM bounds)"))

add("search_spike_shift", f"""SELECT category, ROUND(shift, 6) AS shift, shift < 0.05 AS passed FROM (SELECT category, SUM(ABS(spiked - search_o)) / GREATEST(SUM(search_o), 1e-9) AS shift FROM ({SPIKE}) GROUP BY 1)""",
    BOUNDS, LAYOUT, search("(SELECT n - 30 FROM bounds)", "(SELECT n FROM bounds)"))

# ------------------------------------------------------------- decisions
DECISIONS = """dec AS (SELECT event_id AS id, 'S' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS store_id, 'I' || lpad(CAST(event_id % 40 AS VARCHAR), CASE WHEN event_id % 97 = 0 THEN 2 ELSE 3 END, '0') AS item_id,
  strftime(ts, '%Y-%m-%d') AS order_date, CASE event_type WHEN 'view' THEN 'approve' WHEN 'click' THEN 'override' WHEN 'purchase' THEN 'reject' WHEN 'signup' THEN 'approve' ELSE 'skip' END AS action,
  CAST(floor(value * CASE WHEN event_id % 50 = 0 THEN 1000 ELSE 1 END) AS BIGINT) AS final_qty,
  CASE WHEN event_type IN ('click', 'purchase') THEN (CASE event_id % 4 WHEN 0 THEN 'promo' WHEN 1 THEN 'weather' WHEN 2 THEN 'bogus' END) END AS reason_code,
  '  ' || repeat(props, event_id % 45) AS note, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'U' || user_id AS user_name FROM events),
checked AS (SELECT *, CASE WHEN NOT regexp_matches(store_id, '^S[0-9][0-9]$') THEN 'store_id' WHEN NOT regexp_matches(item_id, '^I[0-9][0-9][0-9]$') THEN 'item_id' WHEN action = 'skip' THEN 'action'
  WHEN final_qty < 0 OR final_qty > 100000 THEN 'final_qty' WHEN length(note) > 280 THEN 'note_length'
  WHEN action IN ('override', 'reject') AND COALESCE(reason_code NOT IN ('promo', 'weather', 'stock', 'other'), TRUE) THEN 'reason_required' WHEN reason_code = 'bogus' THEN 'reason_unknown' END AS reason FROM dec),
sug AS (SELECT 'S' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS store_id, 'I' || lpad(CAST(event_id % 40 AS VARCHAR), 3, '0') AS item_id, MAX(strftime(ts, '%Y-%m-%d')) AS order_date, CAST(floor(MAX(value) / 10) AS BIGINT) AS suggested_qty
  FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
outcome AS (SELECT c.ts, c.user_name, c.id, c.store_id, c.item_id, c.action, s.suggested_qty, CASE c.action WHEN 'approve' THEN s.suggested_qty WHEN 'reject' THEN 0 ELSE c.final_qty END AS fin, s.order_date AS sdate, c.order_date, c.reason FROM checked c
  LEFT JOIN sug s ON s.store_id = c.store_id AND s.item_id = c.item_id),
dlog AS (SELECT id, store_id, item_id, order_date, action, ts, user_name, suggested_qty, fin AS final_qty, 'm2' AS model_version FROM outcome WHERE reason IS NULL AND suggested_qty IS NOT NULL AND sdate = order_date
  AND fin <= GREATEST(10 * suggested_qty, 50)),
latest AS (SELECT * FROM dlog QUALIFY row_number() OVER (PARTITION BY store_id, item_id, order_date ORDER BY id DESC) = 1)"""
add("decision_validation", "SELECT id, action, final_qty, CAST(length(trim(note)) AS INTEGER) AS note_length, reason FROM checked", DECISIONS)
add("decision_outcomes", """SELECT id, store_id, item_id, action, suggested_qty, CASE WHEN r IS NULL THEN fin END AS final_qty, r AS reason FROM (SELECT *, COALESCE(reason, CASE WHEN suggested_qty IS NULL THEN 'unknown_item'
  WHEN sdate <> order_date THEN 'order_date_conflict' WHEN fin > GREATEST(10 * suggested_qty, 50) THEN 'above_guard' END) AS r FROM outcome)""", DECISIONS)
add("decision_append", """SELECT c.store_id, c.action, COUNT(d.id) AS accepted, CAST(SUM(d.final_qty) AS BIGINT) AS units, COUNT(CASE WHEN c.id % 2 = 0 THEN 1 END) AS repeated,
  COUNT(*) + COUNT(CASE WHEN c.id % 2 = 0 THEN 1 END) AS rows FROM dec c LEFT JOIN dlog d ON d.id = c.id GROUP BY c.store_id, c.action""", DECISIONS)
add("latest_decisions", "SELECT * FROM latest", DECISIONS)
add("order_review", "SELECT s.store_id, s.item_id, s.order_date, s.suggested_qty, l.final_qty, COALESCE(l.action, 'pending') AS status FROM sug s LEFT JOIN latest l ON l.store_id = s.store_id AND l.item_id = s.item_id AND l.order_date = s.order_date", DECISIONS)
add("audit_log", "SELECT * FROM dlog WHERE store_id = 'S03' ORDER BY id DESC LIMIT 200", DECISIONS)
add("store_catalogue", "SELECT store_id, region, COUNT(DISTINCT item_id) AS items FROM sold WHERE region = 'ASIA' GROUP BY 1, 2", SOLD)
add("item_catalogue", """SELECT i.item_id, i.category, price, pack_size FROM (SELECT DISTINCT item_id, category FROM sold WHERE store_id = 'NATION_3') i JOIN (SELECT p_type || '|' || p_brand AS item_id, MIN(p_retailprice) AS price, MIN(p_size) AS pack_size
  FROM part GROUP BY 1) p ON p.item_id = i.item_id""", SOLD)
add("store_forecast_view", """SELECT CASE WHEN b.node_id = 'S:NATION_3' THEN 'store total' ELSE replace(b.node_id, 'SC:NATION_3|', '') END AS node, b.level, b.origin, b.day, ROUND(b.yhat, 6) AS base, ROUND(r.g, 6) AS reconciled, ROUND(a.y, 6) AS y
  FROM base b JOIN rec r ON r.node_id = b.node_id AND r.origin = b.origin AND r.day = b.day LEFT JOIN acts a ON a.node_id = b.node_id AND a.day = b.day
  WHERE b.block = 'test' AND b.level <> 'item_store' AND (b.node_id = 'S:NATION_3' OR starts_with(b.node_id, 'SC:NATION_3|'))""", *WLS)
add("item_forecast_view", """SELECT series_id, 'history' AS part, CAST(day_idx AS BIGINT) AS at_day, ROUND(y, 6) AS value, NULL::DOUBLE AS p10, NULL::DOUBLE AS p90 FROM panel, bounds WHERE day_idx > n - 1 - 60
  UNION ALL SELECT series_id, 'forecast', CAST(day AS BIGINT), ROUND(m2, 6), ROUND(0.5 * m2, 6), ROUND(1.6 * m2 + 1, 6) FROM fm WHERE block = 'production'
  UNION ALL SELECT series_id, 'effect of ' || factor, CAST(row_number() OVER (PARTITION BY series_id ORDER BY -abs(exp(e) - 1), factor) - 1 AS BIGINT), ROUND(100 * (exp(e) - 1), 1), NULL, NULL FROM (SELECT series_id, unnest(['planner', 'last week']) AS factor,
    unnest([AVG(ln((b1 + 1) / (mean28 + 1))), AVG(ln((b0 + 1) / (mean28 + 1)))]) AS e FROM fm WHERE block = 'production' GROUP BY 1)""", *FC)
add("node_attributes", """SELECT node_id, level, CAST(level_idx AS INTEGER) AS level_idx, ROUND(AVG(price), 6) AS price, ROUND(AVG(pack_size), 6) AS pack_size, COUNT(*) AS n_children FROM (
  SELECT price, pack_size, unnest(['total', 'R:' || region, 'S:' || store_id, 'SC:' || store_id || '|' || category]) AS node_id, unnest(['total', 'region', 'store', 'store_category']) AS level, unnest([0, 1, 2, 3]) AS level_idx
  FROM (SELECT DISTINCT store_id, region, category, item_id FROM sold) s JOIN (SELECT p_type || '|' || p_brand AS item_id, MIN(p_retailprice) AS price, MIN(p_size) AS pack_size FROM part GROUP BY 1) i USING (item_id)) GROUP BY 1, 2, 3""", SOLD)
add("normalised_output", """SELECT o_orderkey, ROUND(o_totalprice / 7, 3) AS price, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN ROUND(o_totalprice, 3) END AS finite_only FROM orders""")
add("gate_results", f"""SELECT g.gate, ROUND(v, 6) AS value, g.low, g.high, CASE WHEN v IS NULL THEN 'N/A' WHEN (g.low IS NULL OR v >= g.low) AND (g.high IS NULL OR (CASE WHEN g.strict THEN v < g.high ELSE v <= g.high END)) THEN 'PASS' ELSE 'FAIL' END AS result
  FROM (VALUES ('wape_gain_vs_b0', 0.10::DOUBLE, NULL::DOUBLE, FALSE), ('coverage', 0.75, 0.85, FALSE), ('wape_max', NULL, 1.0, TRUE), ('latency_p95', NULL, 300.0, TRUE)) g(gate, low, high, strict)
  LEFT JOIN (SELECT unnest(['wape_gain_vs_b0', 'coverage', 'wape_max']) AS gate, unnest([1 - w2 / w0, cov, w2]) AS v FROM (SELECT {wape('m2')} AS w2, {wape('b0')} AS w0, AVG(CASE WHEN y BETWEEN m2_p10 AND m2_p90 THEN 1.0 ELSE 0.0 END) AS cov
  FROM ({TESTU}))) x ON x.gate = g.gate""", *FC)

# ------------------------------------------------------------- trained models
add("forecast_blocks", "SELECT block, COUNT(*) AS rows, ROUND(SUM(b0), 3) AS b0, ROUND(SUM(b1), 3) AS b1, TRUE AS as_before FROM fm WHERE block IN ('cal', 'test') GROUP BY block", *FC)
