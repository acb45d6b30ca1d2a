"""Registered queries: each kernel over the supplied tables, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.functions import text
from layerlens.operators import checks, checksum, intervals, layout, logs, relations, zonemap

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Row-group size of the queries: small enough for several groups on every supplied scale.
RG = 256
#: Block size of the files that the layout queries lay out.
ALLOC = 262_144


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"event_id": F.col("event_id"), "ts": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "value": F.col("value"), "user_id": F.col("user_id")}
    return zonemap.bounds(table(spark, sf_dir, "events"), F.floor(F.col("event_id") / F.lit(RG)), columns)


_BOUNDS = f"""l AS (SELECT event_id // {RG} AS rg, 'event_id' AS "column", CAST(event_id AS DOUBLE) AS v FROM events UNION ALL SELECT event_id // {RG}, 'ts', epoch_us(ts) / 1e6 FROM events
  UNION ALL SELECT event_id // {RG}, 'value', value FROM events UNION ALL SELECT event_id // {RG}, 'user_id', CAST(user_id AS DOUBLE) FROM events),
b AS (SELECT CAST(rg AS BIGINT) AS rg, "column", count(*) AS rows, min(v) AS low, max(v) AS high, bool_or(v IS NULL) AS has_null FROM l GROUP BY ALL)"""


@query(f"WITH {_BOUNDS} SELECT * FROM b")
def zonemap_bounds(spark, sf_dir):
    return _event_bounds(spark, sf_dir)


@query(f"""WITH {_BOUNDS} SELECT "column", CASE WHEN count(*) = count(low) THEN min(low) END AS low, CASE WHEN count(*) = count(high) THEN max(high) END AS high,
  bool_or(has_null) AS has_null, count(*) AS groups, count(*) FILTER (low IS NULL) AS missing FROM b GROUP BY 1""")
def zonemap_merged(spark, sf_dir):
    return zonemap.merged(_event_bounds(spark, sf_dir), ["column"])


_ORDER = """o AS (SELECT "column", CASE WHEN count(*) > count(low) THEN 'missing' WHEN count(*) = 1 THEN 'single' WHEN min(low) = max(high) THEN 'constant'
  WHEN bool_and(coalesce(ok, true)) THEN 'sorted' ELSE 'overlapping' END AS "order" FROM (SELECT *, low >= lag(high) OVER (PARTITION BY "column" ORDER BY rg) AS ok FROM b) GROUP BY 1)"""


@query(f"WITH {_BOUNDS}, {_ORDER} SELECT * FROM o")
def zonemap_order(spark, sf_dir):
    return zonemap.order_of(_event_bounds(spark, sf_dir), ["column"])


@query(f"""WITH {_BOUNDS} SELECT rg, "column", low, coalesce((low - min(low) OVER w) / nullif(max(low) OVER w - min(low) OVER w, 0), 0.0) AS position FROM b WINDOW w AS (PARTITION BY "column")""")
def zonemap_position(spark, sf_dir):
    return zonemap.positions(_event_bounds(spark, sf_dir), ["column"]).select("rg", "column", "low", "position")


@query("""WITH r AS (SELECT p_brand, p_type, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS r FROM (SELECT DISTINCT p_brand, p_type FROM part))
SELECT p_brand, p_type, CAST(r AS BIGINT) AS rank, coalesce(CAST(r AS DOUBLE) / nullif(max(r) OVER (PARTITION BY p_brand), 0), 0.0) AS position FROM r""")
def rank_position(spark, sf_dir):
    distinct = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return zonemap.rank_positions(distinct, ["p_brand"], "p_type").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_BOUNDS} SELECT "column", count(*) FILTER (high < 100 OR low > 200) AS skipped, count(*) AS groups FROM b GROUP BY 1""")
def zonemap_skippable(spark, sf_dir):
    return zonemap.skippable(_event_bounds(spark, sf_dir), ["column"], F.lit(100.0), F.lit(200.0))


def _order_groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority", F.floor(F.col("o_orderkey") / F.lit(RG)).cast("long").alias("rg")).agg(F.count(F.lit(1)).alias("rows"))


_GROUPS = f"g AS (SELECT o_orderpriority, CAST(o_orderkey // {RG} AS BIGINT) AS rg, count(*) AS rows FROM orders GROUP BY ALL)"


@query(f"WITH {_GROUPS} SELECT o_orderpriority, rg, rows FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY rg DESC) AS back FROM g) WHERE back > 1 AND rows < 50")
def ragged_groups(spark, sf_dir):
    return zonemap.ragged(_order_groups(spark, sf_dir), ["o_orderpriority"], "rg", "rows", 50)


@query(f"WITH {_GROUPS} SELECT *, CAST(coalesce(sum(rows) OVER (PARTITION BY o_orderpriority ORDER BY rg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row FROM g")
def row_offsets(spark, sf_dir):
    return intervals.first_offsets(_order_groups(spark, sf_dir), ["o_orderpriority"], ["rg"], "rows")


@query("""WITH s AS (SELECT CAST(l_orderkey // 64 AS BIGINT) AS rg, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY ALL) SELECT rg, CAST(greatest(0, max(n)) AS BIGINT) AS rows FROM s GROUP BY rg""")
def group_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / F.lit(64)).cast("long").alias("rg"), F.col("l_linenumber").alias("c"), F.lit(1).alias("n"))
    return zonemap.group_rows(lines, ["rg"], "c", "n")


@query("""WITH f AS (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem), r AS (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM f)
SELECT min(k) AS first, max(k) AS last, count(*) AS n FROM r GROUP BY g""")
def free_ranges(spark, sf_dir):
    free = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return intervals.global_islands(free, "o_orderkey", 1024)


@query("""WITH d AS (SELECT DISTINCT user_id, event_id // 100 AS k FROM events), r AS (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS g FROM d)
SELECT user_id, min(k) AS first, max(k) AS last, count(*) AS n FROM r GROUP BY user_id, g""")
def user_islands(spark, sf_dir):
    return intervals.islands(table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / F.lit(100)).cast("long").alias("k")), ["user_id"], "k")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER w AS i, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, CAST(min(i) - 1 AS BIGINT) AS "from", CAST(max(i) - 1 AS BIGINT) AS "to", count(*) AS n FROM r GROUP BY user_id, run""")
def run_lengths(spark, sf_dir):
    return intervals.run_lengths(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


@query("""WITH e AS (SELECT user_id, event_id, lead(event_id) OVER w AS nx, count(*) OVER (PARTITION BY user_id) AS shared FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, coalesce(nx, CASE WHEN user_id % 2 = 0 THEN event_id + 1 ELSE 1000000 END) AS "end", CASE WHEN nx IS NOT NULL THEN 'next' WHEN user_id % 2 = 0 THEN 'measured' ELSE 'blockEnd' END AS extent, shared,
CASE WHEN nx IS NULL AND user_id % 2 = 0 THEN 1000000 - event_id - 1 ELSE 0 END AS slack FROM e""")
def segment_extents(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    measured = F.when(F.col("user_id") % 2 == 0, F.lit(0).cast("long"))
    return intervals.extents(events, ["user_id"], "event_id", "event_id", F.lit(1_000_000).cast("long"), measured)


_STATE = "CASE l_linestatus WHEN 'F' THEN 'segment' ELSE CASE l_returnflag WHEN 'R' THEN 'metadata' ELSE 'free' END END"


@query(f"""WITH p AS (SELECT l_orderkey AS k, {_STATE} AS kind, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
h AS (SELECT k, max(CASE kind WHEN 'metadata' THEN 4 WHEN 'segment' THEN 3 ELSE 2 END) AS r, max(CASE WHEN kind = 'segment' THEN q END) AS seg FROM p GROUP BY k)
SELECT o_orderkey, CASE r WHEN 4 THEN 'metadata' WHEN 3 THEN 'data' WHEN 2 THEN 'free' ELSE 'unknown' END AS state, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN 99 END, seg, 0) AS segments FROM orders LEFT JOIN h ON h.k = o_orderkey""")
def block_states(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linestatus") == "F", "segment").when(F.col("l_returnflag") == "R", "metadata").otherwise("free")
    pieces = lines.select(F.col("l_orderkey").alias("o_orderkey"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("shared"))
    shared = orders.where("o_orderkey % 7 = 0").withColumn("uses", F.lit(99).cast("long"))
    return layout.block_states(orders, pieces, ["o_orderkey"], shared)


@query(f"""WITH p AS (SELECT l_orderkey AS k, {_STATE} AS kind FROM lineitem), h AS (SELECT k, max(CASE kind WHEN 'metadata' THEN 4 WHEN 'segment' THEN 3 ELSE 2 END) AS r FROM p GROUP BY k)
SELECT CASE r WHEN 4 THEN 'metadata' WHEN 3 THEN 'data' WHEN 2 THEN 'free' ELSE 'unknown' END AS state, count(*) AS n, CAST(coalesce(r, 0) AS BIGINT) AS rank FROM orders LEFT JOIN h ON h.k = o_orderkey GROUP BY r""")
def state_counts(spark, sf_dir):
    return layout.state_counts(block_states(spark, sf_dir))


def _ship_spans(spark, sf_dir):
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min(day).alias("s"), (F.max(day) + 1).alias("e"))


_SPANS = "sp AS (SELECT l_suppkey, l_orderkey, CAST(min(epoch(l_shipdate) // 86400) AS BIGINT) AS s, CAST(max(epoch(l_shipdate) // 86400) AS BIGINT) + 1 AS e FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_SPANS}, c AS (SELECT l_suppkey, l_orderkey, s, e, unnest(range(CAST(s // 30 AS BIGINT), CAST((e - 1) // 30 AS BIGINT) + 1)) AS bucket FROM sp),
r AS (SELECT *, least(e, (bucket + 1) * 30) - greatest(s, bucket * 30) AS o FROM c)
SELECT l_suppkey, bucket, l_orderkey, o AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, bucket ORDER BY o DESC, s, l_orderkey) AS k FROM r) WHERE k = 1""")
def dominant_span(spark, sf_dir):
    return intervals.dominant(_ship_spans(spark, sf_dir), ["l_suppkey"], "s", "e", "l_orderkey", 30)


@query("""WITH p AS (SELECT user_id, event_id, event_type, value FROM events WHERE event_type = 'purchase')
SELECT e.user_id, e.event_id, CASE WHEN e.event_id - p.event_id <= 5000 THEN p.event_id END AS found_at, CASE WHEN e.event_id - p.event_id <= 5000 THEN p.value END AS found_value
FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.event_id >= p.event_id""")
def span_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("user_id", "event_id")
    return intervals.asof(errors, events.where("event_type = 'purchase'").select("user_id", "event_id", "value"), ["user_id"], "event_id", ["value"], F.lit(5000))


@query("""WITH s AS (SELECT user_id, event_id AS s, event_id + 50 AS e, event_id AS n FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id AS pos FROM events WHERE event_type = 'error'),
b AS (SELECT p.user_id, p.pos, max(n) AS n FROM p LEFT JOIN s ON s.user_id = p.user_id AND s <= p.pos GROUP BY ALL), a AS (SELECT p.user_id, p.pos, min(n) AS n FROM p LEFT JOIN s ON s.user_id = p.user_id AND s > p.pos GROUP BY ALL)
SELECT b.user_id, b.pos, CASE WHEN b.pos <= b.n + 50 + 200 THEN b.n WHEN a.n - 200 <= b.pos THEN a.n END AS hit FROM b JOIN a USING (user_id, pos)""")
def span_hit(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 50).alias("e"), F.col("event_id").alias("n"))
    return intervals.span_at(events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("pos")), spans, "pos", "s", "e", "n", ["user_id"], 200)


@query("""SELECT event_id FROM events e WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND e.event_id BETWEEN p.event_id AND p.event_id + 2000)""")
def contained_in(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 2000).alias("e"))
    return intervals.contained_in(events.where("event_type = 'view'").select("user_id", "event_id"), spans, "event_id", "s", "e", 1024, ["user_id"]).select("event_id")


def _commit():
    return F.col("event_type") == "purchase"


def _damaged():
    return (F.col("event_type") == "error") & (F.col("value") > 50)


_TXN = "CAST(1 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS txn"


@query(f"SELECT user_id, event_id, {_TXN} FROM events")
def txn_numbers(spark, sf_dir):
    return logs.transactions(table(spark, sf_dir, "events"), ["user_id"], "event_id", _commit()).select("user_id", "event_id", "txn")


@query("SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS c FROM events) WHERE c IS NULL OR event_id > c")
def uncommitted_tail(spark, sf_dir):
    return logs.uncommitted(table(spark, sf_dir, "events"), ["user_id"], "event_id", _commit()).select("user_id", "event_id")


_CUT = "(SELECT *, min(CASE WHEN event_type = 'error' AND value > 50 THEN event_id END) OVER (PARTITION BY user_id) AS d FROM events)"


@query(f"SELECT user_id, event_id, CASE WHEN event_id = d THEN 'damaged' ELSE 'ok' END AS state FROM {_CUT} WHERE d IS NULL OR event_id <= d")
def fail_stop_replay(spark, sf_dir):
    return logs.replayed(table(spark, sf_dir, "events"), ["user_id"], "event_id", _damaged()).select("user_id", "event_id", "state")


@query(f"""WITH s AS (SELECT * FROM {_CUT} WHERE d IS NULL OR event_id < d), c AS (SELECT * FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS lc FROM s) WHERE event_id <= lc)
SELECT user_id, event_id, {_TXN} FROM c""")
def committed_entries(spark, sf_dir):
    return logs.committed(table(spark, sf_dir, "events"), ["user_id"], "event_id", _commit(), _damaged()).select("user_id", "event_id", "txn")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS current FROM events")
def current_table(spark, sf_dir):
    return logs.carried(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.when(F.col("event_type") == "signup", F.col("value")), "current").select("user_id", "event_id", "current")


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS commits, count(*) FILTER (event_type NOT IN ('purchase', 'view')) AS changes, count(*) FILTER (event_type = 'error' AND value > 50) AS incomplete, count(*) AS entries FROM events GROUP BY 1")
def log_counts(spark, sf_dir):
    return logs.counts(table(spark, sf_dir, "events"), ["user_id"], _commit(), ~F.col("event_type").isin("purchase", "view"), _damaged())


@query("SELECT p_type, p_brand, CAST(sum(p_size) AS BIGINT) AS bytes, count(*) AS parts, CAST(2 - grouping(p_type) - grouping(p_brand) AS BIGINT) AS depth FROM part GROUP BY ROLLUP (p_type, p_brand)")
def bytes_rollup(spark, sf_dir):
    return relations.rollup_sizes(table(spark, sf_dir, "part"), ["p_type", "p_brand"], "p_size")


@query("SELECT c_custkey, coalesce(n_name, 'nation ' || c_nationkey) AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey")
def name_defaults(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relations.with_default(table(spark, sf_dir, "customer"), names, ["c_nationkey"], "n_name", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).select("c_custkey", "n_name")


@query("SELECT 'index' AS kind, p_partkey AS id, p_name AS name FROM part WHERE p_size < 10 UNION ALL SELECT 'constraint', s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def index_union(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size < 10").select(F.lit("index").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return parts.unionByName(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.lit("constraint").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("""WITH n AS (SELECT s_nationkey, list_sort(list(s_name)) AS a FROM supplier GROUP BY 1)
SELECT s_nationkey, array_to_string(a[1:8], ', ') || CASE WHEN len(a) > 8 THEN ' and ' || (len(a) - 8) || ' more' ELSE '' END AS listed,
CASE WHEN len(a) <= 2 AND length(array_to_string(a, ', ')) <= 32 THEN array_to_string(a, ', ') ELSE a[1] || ' +' || (len(a) - 1) END AS summary FROM n""")
def top_with_more(spark, sf_dir):
    names = relations.first_names(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_name", text.LISTED)
    return names.select("s_nationkey", text.list_names(F.col("names"), F.col("n")).alias("listed"), text.summarize_names(F.col("names"), F.col("n")).alias("summary"))


def _fixed_sql(unit: int, digits: int) -> str:
    p = 10**digits
    scaled = f"((n * {2 * p} + {unit}) // {2 * unit})"
    return f"CAST({scaled} AS VARCHAR)" if not digits else f"({scaled} // {p}) || '.' || lpad(CAST({scaled} % {p} AS VARCHAR), {digits}, '0')"


@query(f"""WITH s AS (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 977 AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 10240 THEN {_fixed_sql(1024, 1)} || ' KB' WHEN n < 1048576 THEN {_fixed_sql(1024, 0)} || ' KB' WHEN n < 104857600 THEN {_fixed_sql(1048576, 1)} || ' MB'
WHEN n < 1073741824 THEN {_fixed_sql(1048576, 0)} || ' MB' ELSE {_fixed_sql(1073741824, 2)} || ' GB' END AS shown,
format('{{:,}}', n) || ' – ' || format('{{:,}}', n + 121) AS rows, format('{{:,}}', o_orderkey) || ' row' || CASE WHEN o_orderkey = 1 THEN '' ELSE 's' END AS counted FROM s""")
def format_bytes(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 977
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_bytes(n).alias("shown"), text.row_range(n, F.lit(122)).alias("rows"), text.plural(F.col("o_orderkey"), "row").alias("counted"))


@query("""WITH s AS (SELECT p_partkey AS part, CAST(2000000 AS BIGINT) AS whole FROM part)
SELECT part, CASE WHEN part = 0 THEN '0.00' WHEN part * 10000 < whole THEN '<0.01' WHEN part * 1000 < whole THEN ((part * 20000 + whole) // (whole * 2)) // 100 || '.' || lpad(CAST(((part * 20000 + whole) // (whole * 2)) % 100 AS VARCHAR), 2, '0')
ELSE ((part * 2000 + whole) // (whole * 2)) // 10 || '.' || ((part * 2000 + whole) // (whole * 2)) % 10 END || '%' AS shown FROM s""")
def percent_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), text.percent(F.col("p_partkey"), F.lit(2_000_000)).alias("shown"))


_FRACTION = "CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END"


@query(f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') || {_FRACTION} AS clock, strftime(ts, '%Y-%m-%d %H:%M:%S') || {_FRACTION} || '+00' AS stamp FROM events")
def date_time_text(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.lit(86_400_000_000)
    return table(spark, sf_dir, "events").select("event_id", text.date_text(F.floor(micros / day)).alias("day"), text.time_text(F.pmod(micros, day), 6).alias("clock"), text.timestamp_text(micros, 6, "+00").alias("stamp"))


@query("""SELECT p_partkey, CAST(CAST(p_partkey * 37 - 5000 AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2))::VARCHAR AS price, concat_ws(' ',
CASE WHEN p_size // 12 > 0 THEN p_size // 12 || ' year' || CASE WHEN p_size // 12 = 1 THEN '' ELSE 's' END END, CASE WHEN p_size % 12 > 0 THEN p_size % 12 || ' month' || CASE WHEN p_size % 12 = 1 THEN '' ELSE 's' END END,
CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 || ' day' || CASE WHEN p_partkey % 3 = 1 THEN '' ELSE 's' END END, CASE WHEN p_partkey % 5 > 0 OR (p_size = 0 AND p_partkey % 3 = 0) THEN '00:00:0' || p_partkey % 5 END) AS span FROM part""")
def decimal_interval_text(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.decimal_text(k * 37 - 5000, 2).alias("price"), text.interval_text(F.col("p_size").cast("long"), k % 3, (k % 5) * 1_000_000).alias("span"))


@query("""SELECT s_suppkey, '''' || replace(s_name || '''s', '''', '''''') || '''' AS literal, CASE WHEN regexp_matches(s_name, '^[a-z_][a-z0-9_]*$') THEN s_name ELSE '"' || replace(s_name, '"', '""') || '"' END AS ident,
CASE WHEN length(s_name) > 12 THEN left(s_name, length(s_name) - 6) ELSE s_name END AS head, CASE WHEN length(s_name) > 12 THEN right(s_name, 6) ELSE '' END AS tail FROM supplier""")
def quoted_names(spark, sf_dir):
    parts = text.name_parts(F.col("s_name"), 12, 6)
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.quote_literal(F.concat("s_name", F.lit("'s"))).alias("literal"), text.quote_name(F.col("s_name")).alias("ident"), parts["head"].alias("head"), parts["tail"].alias("tail"))


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''), l AS (SELECT doc_id, h, unnest(range(0, least(512, length(h) // 2), 16)) AS pos FROM d),
b AS (SELECT doc_id, pos, substr(h, CAST(pos * 2 + 1 AS BIGINT), CAST(least(32, 1024 - pos * 2) AS BIGINT)) AS x FROM l), c AS (SELECT doc_id, pos, list_transform(range(0, length(x) // 2), lambda i: substr(x, i * 2 + 1, 2)) AS p FROM b)
SELECT doc_id, lower(lpad(printf('%x', pos), 8, '0')) AS "offset", lower(array_to_string(p, ' ')) AS hex, array_to_string(list_transform(p, lambda y: CASE WHEN y >= '20' AND y <= '7E' THEN chr(CAST(('0x' || y) AS INTEGER)) ELSE '·' END), '') AS text FROM c""")
def hex_dump(spark, sf_dir):
    lines = text.hex_lines(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(lines).alias("x")).select("doc_id", "x.*")


@query("""SELECT vec_id, list_slice(embedding, 3, 6) AS part, '[' || array_to_string(list_transform(range(0, 3), lambda i: CAST(label + i AS VARCHAR)), ', ') || ']' AS listed,
'{''id'': ' || vec_id || ', ''label'': ' || label || '}' AS struct_text, '{id=' || vec_id || ', label=' || label || '}' AS map_text FROM embeddings""")
def nested_text(spark, sf_dir):
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("label") + i).cast("string")), ", "), F.lit("]"))
    pairs = F.map_from_entries(F.array(F.struct(F.lit("id"), F.col("vec_id").cast("string")), F.struct(F.lit("label"), F.col("label").cast("string"))))
    joined = lambda shape: F.array_join(F.transform(F.map_entries(pairs), lambda e: F.format_string(shape, e["key"], e["value"])), ", ")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 3, 4).alias("part"), listed.alias("listed"), F.concat(F.lit("{"), joined("'%s': %s"), F.lit("}")).alias("struct_text"), F.concat(F.lit("{"), joined("%s=%s"), F.lit("}")).alias("map_text"))


@query("SELECT event_id, CAST(r - 1 AS BIGINT) AS code, event_type FROM events JOIN (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)")
def dictionary_decode(spark, sf_dir):
    coded, codes = relations.encoded(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")
    return relations.decoded(coded.withColumn("kept", F.col("code")), codes).select("event_id", F.col("kept").alias("code"), "event_type")


@query("""WITH k AS (SELECT o_custkey, CAST(CAST(o_orderkey AS HUGEINT) * 13787848793156543929 % 18446744073709551616 AS UBIGINT) AS w FROM orders), x AS (SELECT o_custkey, xor(bit_xor(w), CAST(5381 AS UBIGINT)) AS v FROM k GROUP BY 1)
SELECT o_custkey, CAST(CASE WHEN v >= 9223372036854775808 THEN CAST(v AS HUGEINT) - 18446744073709551616 ELSE CAST(v AS HUGEINT) END AS BIGINT) AS checksum FROM x""")
def xor_checksum(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(checksum.checksum(F.col("o_orderkey")).alias("checksum"))


_LISTED = "array_to_string(list_sort(a)[1:8], ', ') || CASE WHEN len(a) > 8 THEN ' and ' || (len(a) - 8) || ' more' ELSE '' END"


@query(f"""WITH {_BOUNDS}, {_ORDER}, {_GROUPS}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY rg DESC) AS back FROM g) WHERE back > 1 AND rows < 50),
f AS (SELECT s_name AS file, s_suppkey % 40 AS fb, CASE WHEN s_suppkey % 50 = 0 THEN 10 ELSE 0 END AS ws, s_nationkey = 3 AS u FROM supplier),
x AS (SELECT 'Sorted' AS label, coalesce(bool_or("order" = 'sorted'), false) AS passed, coalesce(list(DISTINCT "column") FILTER ("order" = 'sorted'), []) AS a FROM o
UNION ALL SELECT 'Compressed', count(*) FILTER (p_size > 48) = 0, coalesce(list(DISTINCT p_brand) FILTER (p_size > 48), []) FROM part
UNION ALL SELECT 'Full row groups', count(*) = 0, coalesce(list(DISTINCT o_orderpriority || ' ' || rg) FILTER (rg IS NOT NULL), []) FROM r
UNION ALL SELECT 'Compact', sum(fb) * 10 <= count(*) * 100, coalesce(list(DISTINCT file) FILTER (fb * 10 > 100), []) FROM f
UNION ALL SELECT 'Checkpointed', count(*) FILTER (ws > 0 OR u) = 0, coalesce(list(DISTINCT file) FILTER (ws > 0 OR u), []) FROM f)
SELECT label, passed, CAST(len(a) AS BIGINT) AS n_items, {_LISTED} AS detail FROM x""")
def efficiency_checks(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("column"), F.when(F.col("p_size") > 25, "DATA").otherwise("VALIDITY").alias("segment_type"), F.when(F.col("p_size") > 48, "Uncompressed").otherwise("RLE").alias("compression"), F.col("p_size").alias("bytes"))
    key = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("file"), (key % 40).alias("free_bytes"), F.lit(100).alias("file_size"), F.when(key % 50 == 0, 10).alias("wal_size"), (F.col("s_nationkey") == 3).alias("has_updates"))
    return checks.report(
        checks.sorted_check(zonemap.order_of(_event_bounds(spark, sf_dir), ["column"])),
        checks.compressed_check(parts, "column"),
        checks.full_groups_check(_order_groups(spark, sf_dir), ["o_orderpriority"], "rg", "rows", 50),
        checks.compact_check(files),
        checks.checkpointed_check(files),
    )


@query("""WITH l AS (SELECT r_name, 0 AS d, 'SCHEMA ' || r_name AS line, '' AS k FROM region UNION ALL SELECT r_name, 1, '  TABLE ' || n_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY d, k) - 1 AS BIGINT) AS line_no, line FROM l""")
def schema_lines(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    heads = region.select("r_name", F.lit(0).alias("d"), F.concat(F.lit("SCHEMA "), F.col("r_name")).alias("line"), F.lit("").alias("k"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.lit(1).alias("d"), F.concat(F.lit("  TABLE "), F.col("n_name")).alias("line"), F.col("n_name").alias("k"))
    return relations.numbered(heads.unionByName(rows), ["r_name"], ["d", "k"], "line_no").select("r_name", "line_no", "line")


@query("SELECT n_nationkey, count(c_custkey) AS columns, coalesce(list_sort(list(DISTINCT c_mktsegment) FILTER (c_mktsegment IS NOT NULL)), []) AS kinds FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def column_coverage(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000")
    held = table(spark, sf_dir, "nation").join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return held.groupBy("n_nationkey").agg(F.count("c_custkey").alias("columns"), F.sort_array(F.collect_set("c_mktsegment")).alias("kinds"))


@query("SELECT s_suppkey, coalesce(n, 1) AS uses FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_suppkey = s_suppkey")
def shared_blocks(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("uses"))
    return relations.with_default(table(spark, sf_dir, "supplier").select("s_suppkey"), uses, ["s_suppkey"], "uses", F.lit(1).cast("long"))


@query("""WITH b AS (SELECT unnest(range(0, (SELECT max(o_orderkey) + 3 FROM orders))) AS block), f AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT block, CASE WHEN o_orderkey IS NOT NULL THEN 'free' ELSE 'unknown' END AS kind, 12288 + block * 262144 AS start, 12288 + (block + 1) * 262144 AS "end" FROM b LEFT JOIN f ON o_orderkey = block WHERE block NOT IN (SELECT l_orderkey FROM lineitem)""")
def unclaimed_blocks(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    files = orders.agg((F.max("o_orderkey") + 3).alias("block_count")).select(F.lit("f").alias("file"), F.lit(ALLOC).cast("long").alias("alloc"), "block_count", F.lit(1 << 60).alias("file_size"), F.lit(True).alias("opened"))
    claimed = lines.select(F.lit("f").alias("file"), F.col("l_orderkey").alias("block"))
    free = orders.where("o_orderstatus = 'F'").select(F.lit("f").alias("file"), F.col("o_orderkey").alias("block"))
    return layout.unclaimed_pieces(files, claimed, free).select("block", "kind", "start", "end")


@query("""WITH s AS (SELECT b, sub, CASE WHEN sub % (b + 2) = 0 THEN 'metadataFree' ELSE 'metadata' END AS kind FROM (SELECT n_nationkey AS b, unnest(range(0, 64)) AS sub FROM nation)),
m AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS nw FROM s WINDOW w AS (PARTITION BY b ORDER BY sub)), r AS (SELECT *, sum(nw) OVER (PARTITION BY b ORDER BY sub) AS run FROM m)
SELECT b AS block, kind, CAST(12288 + b * 262144 + 8 + min(sub) * 4088 AS BIGINT) AS start, CAST(CASE WHEN max(sub) = 63 THEN 12288 + (b + 1) * 262144 ELSE 12288 + b * 262144 + 8 + (max(sub) + 1) * 4088 END AS BIGINT) AS "end", min(sub) AS "from", max(sub) AS "to" FROM r GROUP BY b, kind, run""")
def metadata_runs(spark, sf_dir):
    free = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda x: x % (F.col("n_nationkey") + 2) == 0)
    blocks = table(spark, sf_dir, "nation").select(F.lit("f").alias("file"), F.col("n_nationkey").alias("block"), free.alias("free"))
    files = spark.range(1).select(F.lit("f").alias("file"), F.lit(ALLOC).cast("long").alias("alloc"))
    return layout.metadata_pieces(blocks, files).drop("file")


@query("""WITH f AS (SELECT s_suppkey AS file, 12288 + 262144 * (s_suppkey % 25) + s_suppkey AS fs FROM supplier), p AS (SELECT file, fs, b, 12288 + b * 262144 AS s FROM f, range(0, 20) t(b)),
x AS (SELECT file, 'free' AS kind, s AS start, least(fs, s + 262144) AS "end" FROM p WHERE s < fs
UNION ALL SELECT file, 'missing', greatest(s, fs), s + 262144 FROM p WHERE fs < 12288 + 20 * 262144 AND b >= (fs - 12288) // 262144
UNION ALL SELECT file, 'tail', 12288 + 20 * 262144, fs FROM f WHERE fs > 12288 + 20 * 262144
UNION ALL SELECT file, h.kind, h.s, least(fs, h.e) FROM f, (VALUES ('mainHeader', 0, 4096), ('dbHeader', 4096, 8192), ('dbHeader', 8192, 12288)) h(kind, s, e) WHERE h.s < fs)
SELECT file, kind, CAST(count(*) AS BIGINT) AS pieces, CAST(sum("end" - start) AS BIGINT) AS bytes FROM x GROUP BY ALL""")
def cut_files(spark, sf_dir):
    k = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select(k.alias("file"), F.lit(ALLOC).cast("long").alias("alloc"), F.lit(20).cast("long").alias("block_count"), (12_288 + ALLOC * (k % 25) + k).alias("file_size"), F.lit(True).alias("opened"))
    none = files.where("false").select("file", F.lit(0).cast("long").alias("block"))
    free = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("block"))
    pieces = layout.unclaimed_pieces(files, none, free).unionByName(layout.header_pieces(files), allowMissingColumns=True)
    return layout.clipped(pieces, files).groupBy("file", "kind").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query("WITH t AS (SELECT c_nationkey, c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS rows FROM customer) SELECT c_nationkey, min(c_custkey) FILTER (rows = m) AS c_custkey, max(rows) AS rows FROM (SELECT *, max(rows) OVER (PARTITION BY c_nationkey) AS m FROM t) GROUP BY 1")
def largest_table(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.floor("c_acctbal").cast("long").alias("rows"))
    return relations.best_of(t, ["c_nationkey"], "rows", "c_custkey")


@query("""WITH s AS (SELECT p_brand, p_size, count(*) AS bytes FROM part GROUP BY ALL) SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(bytes) OVER (PARTITION BY p_brand) AS from_share,
CAST(sum(bytes) OVER (PARTITION BY p_brand ORDER BY p_size) AS DOUBLE) / sum(bytes) OVER (PARTITION BY p_brand) AS to_share FROM s""")
def stacked_shares(spark, sf_dir):
    parts = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("bytes"))
    return relations.shares(parts, ["p_brand"], ["p_size"], "bytes")


@query("SELECT l_orderkey // 100 AS rg, list_sort(list(DISTINCT l_suppkey)) AS blocks, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def distinct_blocks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / F.lit(100)).cast("long").alias("rg")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("blocks"))
    return lines.withColumn("n", F.size("blocks").cast("long"))


@query("""SELECT o_custkey, coalesce(bool_or(o_orderstatus = 'P'), false) AS has_updates, coalesce(bool_or(o_totalprice > 400000), false) AS uncompressed, bool_and(o_orderstatus = 'F') AS all_free, max(o_orderkey) AS last_start,
CAST(sum(CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE 0 END) AS BIGINT) AS slack FROM orders GROUP BY 1""")
def nested_exists(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    flags = relations.exists_flags(orders, ["o_custkey"], has_updates=F.col("o_orderstatus") == "P", uncompressed=F.col("o_totalprice") > 400_000)
    more = orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_free"), F.max("o_orderkey").alias("last_start"), F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")).otherwise(0)).alias("slack"))
    return flags.join(more, "o_custkey")


@query(r"""WITH s AS (SELECT p_partkey, '[Min: ' || p_size || ', Max: ' || p_size + 5 || ', Has Unicode: false][Has Null: ' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ', Has No Null: true]' AS t FROM part)
SELECT p_partkey, regexp_extract(t, '^\[Min: (.*?), Max: (.*?), Has', 1) AS low, regexp_extract(t, '^\[Min: (.*?), Max: (.*?), Has', 2) AS high, regexp_extract(t, 'Has Null: (true|false)', 1) = 'true' AS has_null FROM s""")
def stats_text(spark, sf_dir):
    size = F.col("p_size")
    stats = F.concat(F.lit("[Min: "), size.cast("string"), F.lit(", Max: "), (size + 5).cast("string"), F.lit(", Has Unicode: false][Has Null: "), F.when(size % 2 == 0, "true").otherwise("false"), F.lit(", Has No Null: true]"))
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_stats(stats).alias("x")).select("p_partkey", "x.*")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'meta' WHEN 'click' THEN 'data' ELSE 'catalog' END AS category FROM events")
def entry_category(spark, sf_dir):
    kinds = {"purchase": "commit", "signup": "meta", "click": "data"}
    return table(spark, sf_dir, "events").select("event_id", relations.lookup(F.col("event_type"), kinds, F.lit("catalog")).alias("category"))


@query(r"""SELECT page_id, regexp_replace(url, '^([^?#]*)', '\1.wal') AS wal, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS name FROM pages""")
def path_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.wal_path(F.col("url")).alias("wal"), text.base_name(F.col("url")).alias("name"))


@query("""WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(p) = 1 THEN 'values' WHEN p[1] % 2 = 0 THEN CASE WHEN len(p) = 2 THEN 'validity' ELSE 'child ' || array_to_string(p[2:len(p) - 1], '.') || ' validity' END ELSE 'child ' || array_to_string(p[2:], '.') END AS label FROM p""")
def segment_labels(spark, sf_dir):
    paths = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("path"))
    return paths.select("l_orderkey", text.segment_label(F.col("path"), F.get("path", F.lit(0)) % 2 == 0).alias("label"))


@query("SELECT (SELECT count(*) FROM nation) AS tables, (SELECT count(*) FROM customer) AS rows, (SELECT count(*) FROM part) AS views, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS sequences, CAST(greatest(1, (SELECT max(p_size) FROM part)) AS BIGINT) AS scale")
def file_totals(spark, sf_dir):
    one = lambda name, *aggs: table(spark, sf_dir, name).agg(*aggs)
    out = one("nation", F.count(F.lit(1)).alias("tables")).crossJoin(one("customer", F.count(F.lit(1)).alias("rows")))  # one row each
    out = out.crossJoin(one("part", F.count(F.lit(1)).alias("views"), F.greatest(F.lit(1), F.max("p_size")).cast("long").alias("scale")))
    return out.crossJoin(one("orders", F.countDistinct("o_orderpriority").alias("sequences")))


@query("WITH c AS (SELECT n_regionkey AS schema, n_name AS tbl, c_mktsegment AS col FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0) SELECT schema, tbl, col, count(*) AS n, schema || '.' || tbl || '.' || col AS path FROM c GROUP BY ALL")
def display_paths(spark, sf_dir):
    columns = table(spark, sf_dir, "customer").where("c_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    columns = columns.groupBy(F.col("n_regionkey").cast("string").alias("s"), F.col("n_regionkey").alias("schema"), F.col("n_name").alias("tbl"), F.col("c_mktsegment").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return relations.display_paths(columns, "s", "tbl", "col").drop("s")


def _all() -> None:
    from layerlens.plans import reports  # noqa: F401  registers its own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
