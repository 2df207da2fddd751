"""For each registered query the same result in SQL over the given tables."""

from __future__ import annotations

from geozone.plans.queries import LINE_MEMBERS, QUOTA_SHARE, SEED
from geozone.plans.views import ARRIVALS, FREE_BALANCE, LATE_DAYS, LATE_SHARE, RUN_DAYS, WITHDRAWN_VALUE


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def md5_number(text: str) -> str:
    """The first 32 bits of the md5 digest as a number."""
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def joined_keys(*keys: str) -> str:
    return " || chr(1) || ".join(f"{k}::VARCHAR" for k in keys)


NATIONS = """nations AS (
  SELECT n_nationkey, n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"""

CUSTOMERS = """customers AS (
  SELECT c_custkey, c_mktsegment, c_nationkey, nation, region FROM customer JOIN nations ON c_nationkey = n_nationkey)"""

SUPPLIERS = """suppliers AS (
  SELECT s_suppkey, s_acctbal, s_nationkey, nation, region FROM supplier JOIN nations ON s_nationkey = n_nationkey)"""

ZONED = """zoned AS (
  SELECT event_id, ts, user_id, event_type, value::DECIMAL(18,2) AS value, nation, region AS zone
  FROM events JOIN customers ON user_id = c_custkey)"""

TRIPS = """trips AS (
  SELECT l_orderkey, l_linenumber, s_nationkey, c_nationkey, o_orderstatus,
         abs(date_diff('day', o_orderdate, l_shipdate)) AS days
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey)"""

LATENCY = """latency AS (
  SELECT a.n_name AS from_zone, b.n_name AS to_zone,
         round(sum(days)::DOUBLE / count(days) * 1000)::BIGINT AS latency
  FROM trips JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
  GROUP BY 1, 2)"""

SOURCE_ZONES = """source_zones AS (
  SELECT source, zone, (row_number() OVER (PARTITION BY source ORDER BY zone) - 1)::INTEGER AS zone_ord
  FROM (SELECT DISTINCT event_type AS source, zone FROM zoned))"""

TARGET_LISTS = """targets AS (SELECT s_suppkey AS target FROM supplier),
target_lists AS (
  SELECT list, row_number() OVER (PARTITION BY list ORDER BY target) - 1 AS k, target,
         count(*) OVER (PARTITION BY list) AS n
  FROM (SELECT 'zone:' || nation AS list, target FROM targets JOIN suppliers ON target = s_suppkey
        UNION ALL SELECT 'all', target FROM targets))"""

MEMBERS = """members AS (
  SELECT DISTINCT region AS zone, l_suppkey AS member
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customers ON o_custkey = c_custkey)"""

ITEMS = """items AS (
  SELECT o_orderkey AS item, c_mktsegment AS grp, region AS zone, o_orderstatus AS member,
         date_trunc('month', o_orderdate)::DATE AS month, o_orderdate::DATE AS day
  FROM orders JOIN customers ON o_custkey = c_custkey)"""

ITEM_ZONES = """item_zones AS (
  SELECT grp, zone, row_number() OVER (PARTITION BY grp ORDER BY zone) - 1 AS zone_ord,
         count(*) OVER (PARTITION BY grp) AS n_zones
  FROM (SELECT DISTINCT c_mktsegment AS grp, region AS zone FROM customers))"""

RANKED_ITEMS = """ranked AS (
  SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY item) - 1 AS ord,
         count(*) OVER (PARTITION BY grp) AS n_items
  FROM items)"""

QUOTA = f"""quota AS (
  SELECT r.grp, r.item, n_items // {QUOTA_SHARE} AS quota, z.zone, z.zone_ord, r.ord
  FROM ranked r JOIN item_zones z ON r.grp = z.grp AND r.ord // nullif(n_items // {QUOTA_SHARE}, 0) = z.zone_ord
  WHERE r.n_items >= z.n_zones * (n_items // {QUOTA_SHARE}))"""

REGION_NATIONS = """region_nations AS (
  SELECT region AS grp, nation AS zone, row_number() OVER (PARTITION BY region ORDER BY nation) - 1 AS zone_ord,
         count(*) OVER (PARTITION BY region) AS n_zones
  FROM nations)"""

REGION_SLOTS = """slots AS (
  SELECT region AS zone, s_suppkey AS slot, row_number() OVER (PARTITION BY region ORDER BY s_suppkey) - 1 AS k,
         count(*) OVER (PARTITION BY region) AS n_slots
  FROM suppliers)"""

NATION_SLOTS = REGION_SLOTS.replace("region", "nation")

ZONE_TABLES = (NATIONS, CUSTOMERS, SUPPLIERS)

MEASURES = """count(*) AS n_events, sum(value)::DOUBLE AS sum_value, min(value)::DOUBLE AS min_value,
       max(value)::DOUBLE AS max_value, sum(value)::DOUBLE / count(value) AS avg_value"""

HOUR = "date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end"


def slot_of(slots_alias: str, ord_column: str, n_column: str, item: str) -> str:
    """Position of an item's slot: in turn if there are enough items, else drawn by hash."""
    drawn = md5_number(joined_keys(str(SEED), item))
    n_slots = f"{slots_alias}.n_slots"
    return f"CASE WHEN {n_column} >= {n_slots} THEN {ord_column} % {n_slots} ELSE {drawn} % {n_slots} END"


def best_zone(deps: str, score: str) -> str:
    """CTE `best` from a CTE or table `deps (grp, zone)` and `latency`."""
    return f"""best AS (
  WITH d AS (SELECT DISTINCT grp, zone FROM {deps} WHERE zone IS NOT NULL),
       n AS (SELECT grp, count(*) AS n FROM d GROUP BY grp),
       scored AS (
         SELECT d.grp, l.to_zone, {score} AS score
         FROM d JOIN latency l ON d.zone = l.from_zone JOIN n ON d.grp = n.grp
         GROUP BY d.grp, l.to_zone, n.n HAVING count(*) = n.n),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score, to_zone) AS place FROM scored)
  SELECT g.grp, r.to_zone AS zone, r.score
  FROM (SELECT DISTINCT grp FROM {deps}) g LEFT JOIN ranked r ON g.grp = r.grp AND r.place = 1)"""


MINMAX = "greatest(max(l.latency), 0)"
AVERAGE = "sum(l.latency)::DOUBLE / count(*)"

ORDER_DEPS = """order_deps AS (
  SELECT l_orderkey AS grp, nation AS zone FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey)"""

BRAND_DEPS = """brand_deps AS (
  SELECT DISTINCT p_brand AS grp, nation AS zone
  FROM part LEFT JOIN (lineitem JOIN suppliers ON l_suppkey = s_suppkey) ON p_partkey = l_partkey)"""


def placed_level(name: str, deps: str) -> str:
    """CTE with the best zone per group; a group without dependencies takes the smallest zone with score 0."""
    body = best_zone(deps, MINMAX).removeprefix("best AS (")
    empty = f"(SELECT grp FROM {deps} GROUP BY grp HAVING count(zone) = 0)"
    return f"""{name} AS (
  SELECT grp,
         CASE WHEN grp IN {empty} THEN (SELECT min(z) FROM (SELECT from_zone AS z FROM latency UNION SELECT to_zone FROM latency)) ELSE zone END AS zone,
         CASE WHEN grp IN {empty} THEN 0 ELSE score END AS score
  FROM ({body})"""


def placed_in_order(able: str = "true") -> str:
    """Three levels, each with the zones of the one before; groups whose zone is not `able` are not placed."""
    seen = lambda name: f"{name}_seen AS (SELECT grp, zone FROM {name} WHERE zone IS NOT NULL AND {able})"
    placed = f"CASE WHEN {able} THEN zone END AS zone, CASE WHEN {able} THEN score::BIGINT END AS score"
    ctes = with_ctes(
        NATIONS, SUPPLIERS, TRIPS, LATENCY, BRAND_DEPS, placed_level("brands", "brand_deps"), seen("brands"),
        "type_deps AS (SELECT DISTINCT p_type AS grp, zone FROM part LEFT JOIN brands_seen ON p_brand = grp)",
        placed_level("types", "type_deps"), seen("types"),
        "report_deps AS (SELECT DISTINCT 'report' AS grp, s.zone FROM part LEFT JOIN types_seen s ON p_type = s.grp)",
        placed_level("reports", "report_deps"),
    )
    return f"""{ctes}
            SELECT grp, 1::INTEGER AS level, {placed} FROM brands
            UNION ALL SELECT grp, 2, {placed} FROM types
            UNION ALL SELECT grp, 3, {placed} FROM reports"""


def oracles() -> dict[str, str]:
    events = with_ctes(NATIONS, CUSTOMERS, ZONED)
    latency = with_ctes(TRIPS, LATENCY)
    routing = with_ctes(*ZONE_TABLES, ZONED, TARGET_LISTS)
    item_lists = (*ZONE_TABLES, ITEMS, ITEM_ZONES, RANKED_ITEMS)

    local_sql = f"{events} SELECT {HOUR}, zone, event_type, {MEASURES} FROM zoned GROUP BY 1, 2, 3, 4"
    route_sql = f"""{routing}, routed AS (
      SELECT z.*, coalesce(l.list, 'all') AS list, l.list IS NOT NULL AS is_local,
             coalesce(l.n, (SELECT count(*) FROM targets)) AS n
      FROM zoned z LEFT JOIN (SELECT DISTINCT list, n FROM target_lists) l ON 'zone:' || z.nation = l.list)
    SELECT {{columns}}, t.target, r.is_local
    FROM routed r LEFT JOIN target_lists t ON r.list = t.list AND t.k = {{number}} % r.n"""
    by_key = route_sql.format(
        columns="event_id, user_id, event_type, nation", number=md5_number(joined_keys("user_id", "event_type"))
    )

    slots_sql = """, numbered AS (
      SELECT item, zone, {period}, row_number() OVER (PARTITION BY zone, {period} ORDER BY item) - 1 AS ord,
             count(*) OVER (PARTITION BY zone, {period}) AS n
      FROM items)
    SELECT i.item, i.zone, i.{period}, s.slot
    FROM numbered i JOIN slots s ON i.zone = s.zone AND s.k = {position}"""
    slots_ctes = with_ctes(*ZONE_TABLES, ITEMS, REGION_SLOTS)
    position = slot_of("s", "i.ord", "i.n", "i.item")

    return {
        "local_and_global": f"""{events}
            SELECT CASE WHEN grouping(zone) = 1 THEN 'global' ELSE 'local' END AS scope,
                   window_start, window_end, zone, event_type, {MEASURES}
            FROM (SELECT {HOUR}, zone, event_type, value FROM zoned)
            GROUP BY GROUPING SETS ((window_start, window_end, zone, event_type), (window_start, window_end, event_type))""",
        "zone_local_agg": local_sql,
        "global_agg": f"{events} SELECT {HOUR}, event_type, {MEASURES} FROM zoned GROUP BY 1, 2, 3",
        "stream_zone_local_agg": local_sql,
        "stream_global_agg": f"""{events} SELECT {HOUR}, event_type, {MEASURES} FROM zoned
            WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM zoned) - INTERVAL 1 HOUR
            GROUP BY 1, 2, 3""",
        "stream_global_complete": f"{events} SELECT {HOUR}, event_type, {MEASURES} FROM zoned GROUP BY 1, 2, 3",
        "stream_late_complete": f"""{events}, arrived AS (
              SELECT *, least((day(ts) + CASE WHEN event_id % {LATE_SHARE} = 0 THEN {LATE_DAYS} ELSE 0 END) // {RUN_DAYS}, {ARRIVALS - 1}) AS run
              FROM zoned),
            marks AS (
              SELECT r.run, max(a.ts) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT run FROM arrived) r JOIN arrived a ON a.run < r.run GROUP BY 1)
            SELECT {HOUR}, event_type, {MEASURES},
                   count(*) FILTER (mark IS NOT NULL AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark) AS n_late
            FROM arrived LEFT JOIN marks USING (run) GROUP BY 1, 2, 3""",
        "global_variance": f"""{events}, days AS (
              SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n_events,
                     sum((value * 100)::HUGEINT) AS s, sum((value * 100)::HUGEINT * (value * 100)::HUGEINT) AS squares
              FROM zoned GROUP BY 1, 2),
            found AS (SELECT *, (n_events * squares - s * s)::DOUBLE / 10000 / (n_events::DOUBLE * n_events) AS variance FROM days)
            SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, n_events, variance, sqrt(variance) AS stddev FROM found""",
        "zone_distinct": f"""{events} SELECT 'local' AS scope, zone, event_type, count(DISTINCT user_id) AS n_users, true AS within
            FROM zoned GROUP BY 2, 3
            UNION ALL SELECT 'global', NULL, event_type, count(DISTINCT user_id), true FROM zoned GROUP BY 3""",
        "global_quantiles": f"{events} SELECT event_type, count(*) AS n_events, true AS p50, true AS p90 FROM zoned GROUP BY 1",
        "tag_zones": f"""{with_ctes(NATIONS, CUSTOMERS, ZONED, SOURCE_ZONES)}
            SELECT e.event_id, s.source, s.zone FROM events e JOIN source_zones s ON e.event_type = s.source""",
        "target_lists": f"{with_ctes(*ZONE_TABLES, TARGET_LISTS)} SELECT list, k, target FROM target_lists",
        "eligible_targets": f"""{with_ctes(*ZONE_TABLES, TARGET_LISTS)}
            SELECT c.c_custkey AS source, c.nation AS zone, coalesce(l.list, 'all') AS list,
                   coalesce(l.n, (SELECT count(*) FROM targets)) AS n_targets, l.list IS NOT NULL AS is_local
            FROM customers c LEFT JOIN (SELECT DISTINCT list, n FROM target_lists) l ON 'zone:' || c.nation = l.list""",
        "route_by_key": by_key,
        "stream_route": by_key,
        "route_random": route_sql.format(
            columns="event_id, nation", number=md5_number(joined_keys(str(SEED), "event_id"))
        ),
        "colocate": f"{events} SELECT zone, user_id, count(*) AS n_rows, 1::BIGINT AS n_tasks FROM zoned GROUP BY 1, 2",
        "stream_route_live": f"""{routing}, arrived AS (
              SELECT *, least((day(ts) + CASE WHEN event_id % {LATE_SHARE} = 0 THEN {LATE_DAYS} ELSE 0 END) // {RUN_DAYS}, {ARRIVALS - 1}) AS run
              FROM zoned),
            lists AS (
              SELECT run, list, target, row_number() OVER (PARTITION BY run, list ORDER BY target) - 1 AS k, count(*) OVER (PARTITION BY run, list) AS n
              FROM target_lists CROSS JOIN (SELECT unnest(range({ARRIVALS})) AS run) WHERE target % {ARRIVALS} <> run),
            routed AS (
              SELECT z.*, coalesce(l.list, 'all') AS list, l.list IS NOT NULL AS is_local, coalesce(l.n, w.n) AS n
              FROM arrived z LEFT JOIN (SELECT DISTINCT run, list, n FROM lists) l ON 'zone:' || z.nation = l.list AND z.run = l.run
              LEFT JOIN (SELECT DISTINCT run, n FROM lists WHERE list = 'all') w ON w.run = z.run)
            SELECT event_id, user_id, event_type, nation, t.target, r.is_local, r.run + 1 AS list_version
            FROM routed r LEFT JOIN lists t ON r.run = t.run AND r.list = t.list
              AND t.k = {md5_number(joined_keys("user_id", "event_type"))} % r.n""",
        "zone_tasks": f"{events} SELECT zone, count(*) AS n_rows, 1::BIGINT AS n_zones, true AS keys_whole FROM zoned GROUP BY 1",
        "latency_as_of": f"""WITH {TRIPS}, dated AS (
              SELECT t.*, o_orderdate::DATE AS day, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE AS known
              FROM trips t JOIN orders ON l_orderkey = o_orderkey),
            snapshots AS (
              SELECT known, a.n_name AS from_zone, b.n_name AS to_zone, round(sum(days)::DOUBLE / count(days) * 1000)::BIGINT AS latency
              FROM dated JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY 1, 2, 3),
            names AS (SELECT from_zone AS zone FROM snapshots UNION SELECT to_zone FROM snapshots),
            routes AS (
              SELECT l_orderkey, l_linenumber, day, a.n_name AS from_zone, CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN' ELSE b.n_name END AS to_zone
              FROM dated JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey)
            SELECT r.l_orderkey, r.l_linenumber, r.day, r.from_zone, r.to_zone,
                   CASE WHEN r.from_zone NOT IN (SELECT zone FROM names) OR r.to_zone NOT IN (SELECT zone FROM names) THEN -1 ELSE s.latency END AS latency
            FROM routes r ASOF LEFT JOIN snapshots s ON r.from_zone = s.from_zone AND r.to_zone = s.to_zone AND r.day >= s.known""",
        "pipeline_levels": """SELECT DISTINCT p_brand AS grp, 1::INTEGER AS level FROM part
            UNION ALL SELECT DISTINCT p_type, 2 FROM part UNION ALL SELECT DISTINCT 'report', 3 FROM part""",
        "observed_latency": f"{latency} SELECT from_zone, to_zone, latency FROM latency",
        "zone_names": f"{latency} SELECT from_zone AS zone FROM latency UNION SELECT to_zone FROM latency",
        "latency_of": f"""{latency}, names AS (SELECT from_zone AS zone FROM latency UNION SELECT to_zone FROM latency), routes AS (
              SELECT l_orderkey, l_linenumber, a.n_name AS from_zone,
                     CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN' ELSE b.n_name END AS to_zone
              FROM trips JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey)
            SELECT r.*, CASE WHEN r.from_zone IN (SELECT zone FROM names) AND r.to_zone IN (SELECT zone FROM names)
                             THEN l.latency ELSE -1 END AS latency
            FROM routes r LEFT JOIN latency l ON r.from_zone = l.from_zone AND r.to_zone = l.to_zone""",
        "best_zone_minmax": f"""{with_ctes(NATIONS, SUPPLIERS, TRIPS, LATENCY, ORDER_DEPS, best_zone("order_deps", MINMAX))}
            SELECT grp, zone, score FROM best""",
        "best_zone_bounded": f"""{with_ctes(NATIONS, SUPPLIERS, TRIPS, LATENCY, ORDER_DEPS, best_zone("order_deps", MINMAX))}
            SELECT grp, zone, score FROM best""",
        "best_zone_average": f"""{with_ctes(NATIONS, SUPPLIERS, TRIPS, LATENCY, ORDER_DEPS, best_zone("order_deps", AVERAGE))}
            SELECT grp, zone, score FROM best""",
        "best_zone_by_snapshot": f"""{with_ctes(NATIONS, SUPPLIERS, TRIPS)}, measured AS (
              SELECT o_orderstatus AS snapshot, a.n_name AS from_zone, b.n_name AS to_zone,
                     round(sum(days)::DOUBLE / count(days) * 1000)::BIGINT AS latency
              FROM trips JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
              GROUP BY 1, 2, 3),
            d AS (
              SELECT DISTINCT o_orderstatus AS snapshot, l_orderkey AS grp, nation AS zone
              FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey),
            n AS (SELECT snapshot, grp, count(*) AS n FROM d GROUP BY ALL),
            scored AS (
              SELECT d.snapshot, d.grp, l.to_zone AS zone, {MINMAX} AS score
              FROM d JOIN measured l ON d.zone = l.from_zone AND d.snapshot = l.snapshot
              JOIN n ON d.grp = n.grp AND d.snapshot = n.snapshot
              GROUP BY d.snapshot, d.grp, l.to_zone, n.n HAVING count(*) = n.n),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY snapshot, grp ORDER BY score, zone) AS place FROM scored)
            SELECT n.snapshot, n.grp, r.zone, r.score
            FROM n LEFT JOIN ranked r ON n.grp = r.grp AND n.snapshot = r.snapshot AND r.place = 1""",
        "best_zone_overall": f"""{latency}, names AS (SELECT from_zone AS zone FROM latency UNION SELECT to_zone FROM latency)
            SELECT to_zone AS zone, sum(latency)::DOUBLE / count(*) AS score FROM latency
            GROUP BY to_zone HAVING count(*) = (SELECT count(*) FROM names)
            ORDER BY score, zone LIMIT 1""",
        "classify_members": f"""{with_ctes(*ZONE_TABLES)}, team AS (
              SELECT 'supplier:' || s_suppkey AS member, 'source' AS kind, nation AS grp FROM suppliers
              UNION ALL SELECT 'customer:' || c_custkey, 'step', nation FROM customers
              UNION ALL SELECT 'part:' || p_partkey, 'step', p_brand FROM part)
            SELECT member, kind, grp,
                   CASE WHEN grp IN (SELECT grp FROM team WHERE kind = 'source') THEN 'local' ELSE 'global' END AS scope
            FROM team""",
        "group_dependencies": f"""{with_ctes(NATIONS, SUPPLIERS, BRAND_DEPS)}
            SELECT grp, zone FROM brand_deps b
            WHERE zone IS NOT NULL OR NOT EXISTS (SELECT 1 FROM brand_deps o WHERE o.grp = b.grp AND o.zone IS NOT NULL)
            UNION ALL SELECT DISTINCT p_type, NULL FROM part
            UNION ALL SELECT DISTINCT 'report', NULL FROM part""",
        "place_in_order": placed_in_order(),
        "place_in_order_slots": placed_in_order(
            f"zone IN (SELECT nation FROM suppliers WHERE s_acctbal > {FREE_BALANCE})"
        ),
        "assign_zone_quota": f"{with_ctes(*item_lists, QUOTA)} SELECT grp, item, quota, zone, zone_ord, ord FROM quota",
        "assign_member_quota": f"""{with_ctes(*item_lists)}, lists AS (
              SELECT grp, member, item, row_number() OVER (PARTITION BY grp, member ORDER BY item) - 1 AS ord,
                     count(*) OVER (PARTITION BY grp, member) AS n_items,
                     count(*) OVER (PARTITION BY grp, member) // {QUOTA_SHARE} AS quota
              FROM items)
            SELECT l.grp, l.member, l.item, l.quota, z.zone, z.zone_ord, l.ord
            FROM lists l JOIN item_zones z ON l.grp = z.grp AND l.ord // nullif(l.quota, 0) = z.zone_ord
            WHERE l.n_items >= z.n_zones * l.quota AND z.zone IN (SELECT region FROM suppliers)""",
        "assign_even_by_date": f"""{with_ctes(*ZONE_TABLES, REGION_NATIONS)}, lists AS (
              SELECT region AS grp, o_orderkey AS item, o_orderdate AS at,
                     row_number() OVER (PARTITION BY region ORDER BY o_orderdate, o_orderkey) - 1 AS ord,
                     count(*) OVER (PARTITION BY region) AS n_items
              FROM orders JOIN customers ON o_custkey = c_custkey)
            SELECT l.grp, l.item, l.at, z.zone, z.zone_ord, l.ord
            FROM lists l JOIN region_nations z ON l.grp = z.grp
            WHERE l.n_items // z.n_zones > 0 AND l.ord // (l.n_items // z.n_zones) = z.zone_ord""",
        "assign_zone_even": f"""{with_ctes(*item_lists)}
            SELECT r.grp, r.item, z.zone, z.zone_ord, r.ord
            FROM ranked r JOIN item_zones z ON r.grp = z.grp
            WHERE r.n_items // z.n_zones > 0 AND r.ord // (r.n_items // z.n_zones) = z.zone_ord""",
        "assign_slots": slots_ctes + slots_sql.format(period="month", position=position),
        "assign_slots_few": slots_ctes + slots_sql.format(period="day", position=position),
        "assign_group": f"""{with_ctes(NATIONS, SUPPLIERS, TRIPS, LATENCY, NATION_SLOTS, BRAND_DEPS, placed_level("best", "brand_deps"))}
            , numbered AS (
              SELECT p_partkey AS item, p_brand AS grp, zone,
                     row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ord,
                     count(*) OVER (PARTITION BY p_brand) AS n
              FROM part JOIN best ON p_brand = grp WHERE zone IS NOT NULL)
            SELECT i.item, i.grp, i.zone, s.slot FROM numbered i JOIN slots s ON i.zone = s.zone AND s.k = {position}""",
        "unassigned": f"""{with_ctes(*ZONE_TABLES, MEMBERS, REGION_NATIONS)}, lists AS (
              SELECT zone AS grp, member AS item, row_number() OVER (PARTITION BY zone ORDER BY member) - 1 AS ord,
                     count(*) OVER (PARTITION BY zone) AS n_items,
                     count(*) OVER (PARTITION BY zone) // {QUOTA_SHARE} AS quota
              FROM members)
            SELECT grp, item FROM lists l WHERE NOT EXISTS (
              SELECT 1 FROM region_nations z
              WHERE z.grp = l.grp AND l.ord // nullif(l.quota, 0) = z.zone_ord AND l.n_items >= z.n_zones * l.quota)""",
        "spread_rest": f"""{with_ctes(*item_lists, QUOTA)}, every_slot AS (
              SELECT s_suppkey AS slot, row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n_slots
              FROM supplier),
            rest AS (
              SELECT grp, item, row_number() OVER (ORDER BY item) - 1 AS ord, count(*) OVER () AS n
              FROM items WHERE item NOT IN (SELECT item FROM quota))
            SELECT i.grp, i.item, s.slot FROM rest i JOIN every_slot s ON s.k = {position}""",
        "first_slot_per_host": f"""{with_ctes(NATIONS, SUPPLIERS)}
            SELECT region AS zone, nation AS host, min(s_suppkey) AS slot FROM suppliers GROUP BY 1, 2""",
        "expand_ranges": """SELECT l_orderkey, unnest(generate_series(a, b)) AS id
            FROM (SELECT l_orderkey, min(l_linenumber)::BIGINT AS a, max(l_linenumber)::BIGINT AS b
                  FROM lineitem GROUP BY 1)""",
        "source_zones": f"{with_ctes(NATIONS, CUSTOMERS, ZONED, SOURCE_ZONES)} SELECT source, zone, zone_ord FROM source_zones",
        "latency_matrix": f"""{with_ctes(TRIPS)}, measured AS (
              SELECT o_orderstatus AS snapshot, a.n_name AS from_zone, b.n_name AS to_zone,
                     round(sum(days)::DOUBLE / count(days) * 1000) AS latency
              FROM trips JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
              GROUP BY 1, 2, 3),
            names AS (SELECT snapshot, from_zone AS zone FROM measured UNION SELECT snapshot, to_zone FROM measured)
            SELECT a.snapshot, a.zone AS from_zone, b.zone AS to_zone, coalesce(m.latency, 0.0) AS latency
            FROM names a JOIN names b ON a.snapshot = b.snapshot
            LEFT JOIN measured m ON m.snapshot = a.snapshot AND m.from_zone = a.zone AND m.to_zone = b.zone""",
        "zone_members": f"""{with_ctes(*ZONE_TABLES, MEMBERS)}, numbered AS (
              SELECT zone, member, (row_number() OVER (PARTITION BY zone ORDER BY member) - 1) // {LINE_MEMBERS} AS line_no
              FROM members)
            SELECT zone, line_no, count(*) AS n_members,
                   zone || ';' || string_agg(member::VARCHAR, ',' ORDER BY member) AS line
            FROM numbered GROUP BY 1, 2""",
        "zone_members_by_time": f"""{with_ctes(*ZONE_TABLES)}, timed AS (
              SELECT region AS zone, l_suppkey AS member, min(o_orderdate) AS first_at
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customers ON o_custkey = c_custkey GROUP BY 1, 2),
            numbered AS (
              SELECT zone, member, row_number() OVER (PARTITION BY zone ORDER BY first_at, member) - 1 AS ord FROM timed)
            SELECT zone, ord // {LINE_MEMBERS} AS line_no, count(*) AS n_members,
                   zone || ';' || string_agg(member::VARCHAR, ',' ORDER BY ord) AS line
            FROM numbered GROUP BY 1, 2""",
        "stream_zone_members": f"""{with_ctes(NATIONS, CUSTOMERS, ZONED)}, changes AS (
              SELECT event_type AS zone, n_nationkey AS member, ts, CASE WHEN value > {WITHDRAWN_VALUE} THEN 'withdrawn' ELSE 'placed' END AS change
              FROM zoned JOIN nation ON n_name = nation),
            net AS (SELECT zone, member, arg_max(change, ROW(ts, change)) AS change FROM changes GROUP BY 1, 2),
            numbered AS (
              SELECT zone, member, (row_number() OVER (PARTITION BY zone ORDER BY member) - 1) // {LINE_MEMBERS // 4} AS line_no
              FROM net WHERE change = 'placed')
            SELECT zone, line_no, count(*) AS n_members, zone || ';' || string_agg(member::VARCHAR, ',' ORDER BY member) AS line
            FROM numbered GROUP BY 1, 2""",
        "zone_members_roundtrip": f"{with_ctes(*ZONE_TABLES, MEMBERS)} SELECT zone, member FROM members",
        "member_zone": f"{with_ctes(*ZONE_TABLES, MEMBERS)} SELECT member, max(zone) AS zone FROM members GROUP BY 1",
        "json_settings": """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 1::INTEGER AS per_zone
            FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""",
        "placement_report": f"""{with_ctes(*item_lists, QUOTA, REGION_SLOTS)}, numbered AS (
              SELECT grp, item, zone, row_number() OVER (PARTITION BY grp, zone ORDER BY item) - 1 AS ord,
                     count(*) OVER (PARTITION BY grp, zone) AS n
              FROM quota),
            placed AS (
              SELECT i.grp, i.item, i.zone, s.slot FROM numbered i JOIN slots s ON i.zone = s.zone AND s.k = {position}),
            entries AS (
              SELECT 'slot' AS section, slot::VARCHAR AS name, item::VARCHAR AS entry,
                     row_number() OVER (PARTITION BY slot ORDER BY item) - 1 AS ord
              FROM placed
              UNION ALL
              SELECT 'group', grp, zone, row_number() OVER (PARTITION BY grp ORDER BY zone) - 1
              FROM (SELECT DISTINCT grp, zone FROM placed))
            SELECT section, name, ord // {LINE_MEMBERS} AS line_no, count(*) AS n, string_agg(entry, ',' ORDER BY ord) AS entries
            FROM entries GROUP BY 1, 2, 3""",
    }
