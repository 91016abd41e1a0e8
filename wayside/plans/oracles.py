"""Plain SQL counterparts of the named queries, written independently of the operators.

Each statement runs over the same tables in another engine. Shared sub-selects are named once and
a statement receives those it mentions.
"""

from __future__ import annotations

import re

FIRST, LAST = "DATE '2024-01-01'", "DATE '2024-01-30'"


def key(date: str) -> str:
    return f"CAST(strftime({date}, '%Y%m%d') AS INTEGER)"


def secs(time: str) -> str:
    part = "TRY_CAST(split_part({0}, ':', {1}) AS INTEGER)"
    return "({} * 3600 + {} * 60 + {})".format(*[part.format(time, i) for i in (1, 2, 3)])


def pct(part: str, whole: str, digits: int) -> str:
    unit = 10**digits
    return f"(CASE WHEN ({whole}) = 0 THEN NULL ELSE CAST((200 * {unit} * ({part}) + ({whole})) // (2 * ({whole})) AS BIGINT) / {unit}.0::DOUBLE END)"


def ratio4(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) = 0 THEN NULL ELSE CAST((20000 * ({part}) + ({whole})) // (2 * ({whole})) AS BIGINT) / 10000.0::DOUBLE END)"


def hours(span: str) -> str:
    return f"(CAST((20000 * CAST({span} AS BIGINT) + 3600) // 7200 AS BIGINT) / 10000.0::DOUBLE)"


def seconds_between(a: str, b: str) -> str:
    return f"date_diff('second', {a}, {b})"


def coverage(pings: str, span: str) -> str:
    want = f"(({span}) // 30)"
    return f"(CASE WHEN ({span}) <= 0 THEN NULL WHEN {want} = 0 THEN 1.0::DOUBLE ELSE {ratio4(f'least({pings}, {want})', want)} END)"


def fiscal(date: str) -> str:
    return f"CAST((month({date}) + 2) % 12 + 1 AS INTEGER)"


def numbered(table: str, natural: list[str], after: str = "0") -> str:
    """Dense keys in the order of the hash bucket, then of the natural key."""
    text = "concat_ws(chr(1), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in natural) + ")"
    order = f"substr(md5({text}), 1, 3), " + ", ".join(natural)
    return f"(SELECT CAST({after} + row_number() OVER (ORDER BY {order}) AS BIGINT) AS _key, * FROM {table})"


SHARED: dict[str, str] = {
    "days": f"SELECT CAST(d AS DATE) AS service_date FROM generate_series({FIRST}, {LAST}, INTERVAL 1 DAY) g(d)",
    "cal": f"""SELECT 'C' || c_custkey AS service_id, c_custkey AS k, c_nationkey AS n,
        {FIRST} + CAST(c_custkey % 26 AS INTEGER) AS start_date FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "weekly": """SELECT service_id, service_date FROM cal JOIN days ON service_date BETWEEN start_date AND start_date + 4
        WHERE (k + n * (isodow(service_date) - 1)) % 3 <> 0""",
    "exc": f"""SELECT 'C' || c_custkey AS service_id, {FIRST} + CAST(c_custkey * 7 % 30 AS INTEGER) AS service_date,
        CASE WHEN c_nationkey % 2 = 0 THEN '1' ELSE '2' END AS code FROM customer
        UNION ALL SELECT 'C' || c_custkey, {FIRST} + CAST(c_custkey * 11 % 30 AS INTEGER), '2' FROM customer WHERE c_acctbal < 2000""",
    "active": """(SELECT service_id, service_date FROM weekly UNION SELECT service_id, service_date FROM exc WHERE code = '1')
        EXCEPT SELECT service_id, service_date FROM exc WHERE code = '2'""",
    "cancelled": "SELECT DISTINCT service_id, service_date FROM exc WHERE code = '2'",
    "special": """SELECT DISTINCT service_id, service_date FROM exc WHERE code = '1'
        AND service_id NOT IN (SELECT service_id FROM cal)""",
    "tt_trips": """SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, 'R' || c_nationkey AS route_id, 'C' || o_custkey AS service_id,
        'P' || o_custkey AS shape_id, CAST(o_orderkey % 2 AS INTEGER) AS direction_id, o_orderpriority AS headsign, c_nationkey
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "tt_stop_times": """SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, 'S' || l_suppkey AS stop_id,
        CASE WHEN l_discount = 0 AND l_tax = 0 THEN ''
             ELSE printf('%02d:%02d:%02d', 20 + l_linenumber, CAST(l_quantity AS INTEGER), l_partkey % 60) END AS arrival_time,
        printf('%02d:%02d:%02d', 20 + l_linenumber, CAST(l_quantity AS INTEGER) + 1, l_partkey % 60) AS departure_time,
        CASE WHEN l_returnflag = 'R' AND l_tax = 0.08 THEN 'A' ELSE '' END || l_linenumber AS stop_sequence
        FROM lineitem""",
    "tt_shapes": """SELECT 'P' || l_partkey AS shape_id, CASE WHEN l_tax = 0 THEN '' WHEN l_returnflag = 'R' THEN 'n/a'
        ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS dist, CAST(l_linenumber AS VARCHAR) AS seq FROM lineitem""",
    "visits": f"""SELECT trip_id, stop_id, TRY_CAST(stop_sequence AS INTEGER) AS stop_sequence,
        CAST({secs('arrival_time')} AS INTEGER) AS arr_secs, CAST({secs('departure_time')} AS INTEGER) AS dep_secs,
        CAST({secs('arrival_time')} // 60 % 1440 AS INTEGER) AS minute_key
        FROM tt_stop_times WHERE arrival_time <> '' AND departure_time <> '' AND regexp_full_match(stop_sequence, '[0-9]+')""",
    "ends": """SELECT *, stop_sequence = min(stop_sequence) OVER (PARTITION BY trip_id) AS is_origin,
        stop_sequence = max(stop_sequence) OVER (PARTITION BY trip_id) AS is_terminal FROM visits""",
    "d_agency": """SELECT r_regionkey + 1 AS agencykey, CAST(r_regionkey AS VARCHAR) AS agencyid, r_name AS agencyname,
        CASE WHEN r_regionkey % 2 = 0 THEN 'BUS' ELSE 'RAIL' END AS mode FROM region WHERE r_regionkey <> 4""",
    "d_route": """SELECT n_nationkey + 1 AS routekey, n_regionkey + 1 AS agencykey, 'R' || n_nationkey AS routeid,
        n_name AS routeshortname, 'Line ' || n_name AS routelongname FROM nation WHERE n_nationkey <> 7""",
    "d_stop": "SELECT s_suppkey + 1 AS stopkey, 'S' || s_suppkey AS stopid FROM supplier WHERE s_acctbal >= 0",
    "d_trip": "SELECT o_orderkey + 1 AS tripkey, CAST(o_orderkey AS VARCHAR) AS tripid FROM orders WHERE o_orderpriority <> '5-LOW'",
    "d_date": f"""SELECT {key('d')} AS datekey, CAST(d AS DATE) AS fulldate, dayname(d) AS dayofweek, isodow(d) >= 6 AS isweekend,
        {fiscal('d')} AS federalfiscalmonth, CAST(month(d) AS INTEGER) AS calendarmonth, CAST(year(d) AS INTEGER) AS calendaryear
        FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)""",
    "skel": f"""SELECT dt.tripkey, COALESCE(dr.routekey, 0) AS routekey, ds.stopkey, {key('a.service_date')} AS datekey, a.service_date,
        e.minute_key AS timekey, COALESCE(da.agencykey, 0) AS agencykey, e.arr_secs, e.dep_secs, e.stop_sequence, e.is_origin, e.is_terminal
        FROM active a JOIN tt_trips t ON t.service_id = a.service_id JOIN ends e ON e.trip_id = t.trip_id
        JOIN d_trip dt ON dt.tripid = t.trip_id JOIN d_stop ds ON ds.stopid = e.stop_id
        LEFT JOIN d_route dr ON dr.routeid = t.route_id LEFT JOIN d_agency da ON da.agencykey = dr.agencykey""",
    "upd": f"""SELECT CAST(l_suppkey % 2 AS VARCHAR) AS agency_key, CAST(l_orderkey AS VARCHAR) AS trip_id, service_date,
        'S' || l_suppkey AS stop_id, l_linenumber AS stop_sequence,
        CASE WHEN l_returnflag = 'N' AND l_tax = 0.05 THEN NULL ELSE arr END AS arrival,
        CASE WHEN l_linestatus = 'F' THEN arr END AS departure, l_shipdate AS fed
        FROM (SELECT *, CAST(service_date AS TIMESTAMP) + to_seconds((20 + l_linenumber) * 3600 + CAST(l_quantity AS INTEGER) * 60
              + l_partkey % 60 + date_diff('day', DATE '1998-06-01', CAST(l_shipdate AS DATE))) AS arr
              FROM (SELECT *, {FIRST} + CAST(l_orderkey % 30 AS INTEGER) AS service_date FROM lineitem))""",
    "upd1": f"""SELECT * FROM (SELECT dt.tripkey, ds.stopkey, u.stop_sequence, {key('u.service_date')} AS datekey, u.arrival, u.departure,
        row_number() OVER (PARTITION BY dt.tripkey, ds.stopkey, u.stop_sequence, u.service_date ORDER BY u.fed DESC NULLS LAST,
        u.agency_key DESC NULLS LAST, u.arrival DESC NULLS LAST, u.departure DESC NULLS LAST) AS rn
        FROM upd u JOIN d_trip dt ON dt.tripid = u.trip_id JOIN d_stop ds ON ds.stopid = u.stop_id WHERE u.arrival IS NOT NULL) WHERE rn = 1""",
    "joined": f"""SELECT s.*, u.arrival, u.departure, u.tripkey IS NOT NULL AS hit,
        CAST({seconds_between('CAST(s.service_date AS TIMESTAMP)', 'u.arrival')} - s.arr_secs AS INTEGER) AS dev
        FROM skel s LEFT JOIN upd1 u USING (tripkey, stopkey, stop_sequence, datekey)""",
    "vp": f"""SELECT CAST(user_id % 5 AS VARCHAR) AS agency_key, CASE event_type WHEN 'error' THEN '' WHEN 'signup' THEN 'X' || user_id
        ELSE CAST(user_id AS VARCHAR) END AS trip_id, 'V' || user_id % 50 AS vehicle_id, value AS latitude,
        date_trunc('second', ts) AS seen_at, date_trunc('second', ts) + INTERVAL 30 SECOND AS fed FROM events""",
    "pings": f"""SELECT *, CAST({seconds_between('first_ping', 'last_ping')} AS BIGINT) AS span FROM (SELECT trip_id, CAST(seen_at AS DATE) AS service_date,
        min(seen_at) AS first_ping, max(seen_at) AS last_ping, CAST(count(*) AS INTEGER) AS n FROM vp WHERE trip_id <> '' GROUP BY 1, 2)""",
    "pings_agency": f"""SELECT *, CAST({seconds_between('first_ping', 'last_ping')} AS BIGINT) AS span FROM (SELECT trip_id, agency_key,
        CAST(seen_at AS DATE) AS service_date, min(seen_at) AS first_ping, max(seen_at) AS last_ping, CAST(count(*) AS INTEGER) AS n
        FROM vp WHERE trip_id <> '' GROUP BY 1, 2, 3)""",
    "shape_len": """SELECT shape_id, CASE WHEN c IS NOT NULL THEN CAST((200000 * c + 1609344) // 3218688 AS BIGINT) / 10000.0::DOUBLE END AS miles FROM (
        SELECT shape_id, max(CASE WHEN regexp_full_match(dist, '[0-9]+([.][0-9]+)?') THEN CAST(CAST(dist AS DECIMAL(18,2)) * 100 AS BIGINT) END) AS c
        FROM tt_shapes WHERE dist <> '' GROUP BY 1)""",
    "trip_len": f"""SELECT trip_id, CASE WHEN max(dep_secs) >= min(arr_secs) THEN {hours('max(dep_secs) - min(arr_secs)')} END AS hours
        FROM visits GROUP BY 1""",
    "tskel": f"""SELECT dt.tripkey, {key('s.service_date')} AS datekey, COALESCE(da.agencykey, 0) AS agencykey, COALESCE(dr.routekey, 0) AS routekey,
        CASE WHEN c.service_id IS NULL THEN 'MISSED' ELSE 'CANCELLED' END AS tripstatus,
        CASE WHEN c.service_id IS NULL THEN 'INFERRED' ELSE 'CALENDAR' END AS tripstatussource,
        COALESCE(sl.miles, 0.0) AS vrm, COALESCE(tl.hours, 0.0) AS vrh, sp.service_id IS NOT NULL AS isspecialevent
        FROM (SELECT * FROM active UNION SELECT * FROM cancelled) s JOIN tt_trips t ON t.service_id = s.service_id
        JOIN d_trip dt ON dt.tripid = t.trip_id
        LEFT JOIN d_route dr ON dr.routeid = t.route_id LEFT JOIN d_agency da ON da.agencykey = dr.agencykey
        LEFT JOIN shape_len sl ON sl.shape_id = t.shape_id LEFT JOIN trip_len tl ON tl.trip_id = t.trip_id
        LEFT JOIN cancelled c ON c.service_id = s.service_id AND c.service_date = s.service_date
        LEFT JOIN special sp ON sp.service_id = s.service_id AND sp.service_date = s.service_date""",
    "keyed_pings": f"SELECT dt.tripkey, {key('p.service_date')} AS datekey, p.* FROM pings p JOIN d_trip dt ON dt.tripid = p.trip_id",
    "added": f"""SELECT {key('p.service_date')} AS datekey, COALESCE(da.agencykey, 0) AS agencykey, p.* FROM pings_agency p
        LEFT JOIN d_agency da ON da.agencyid = p.agency_key
        WHERE NOT EXISTS (SELECT 1 FROM tt_trips t WHERE t.trip_id = p.trip_id)""",
    "tmerged": f"""SELECT t.tripkey, t.datekey, t.agencykey, CASE WHEN p.tripkey IS NOT NULL AND t.tripstatus = 'MISSED' THEN 'OPERATED' ELSE t.tripstatus END AS tripstatus,
        p.tripkey IS NOT NULL AND t.tripstatus = 'MISSED' AS hit, p.first_ping, p.last_ping, p.n, t.vrm, t.isspecialevent,
        CASE WHEN p.span > 0 AND t.tripstatus = 'MISSED' THEN {hours('p.span')} ELSE t.vrh END AS vrh
        FROM tskel t LEFT JOIN keyed_pings p USING (tripkey, datekey)""",
    "tfinal": f"""SELECT tripkey, datekey, agencykey, tripstatus, vrm, vrh, isspecialevent, CASE WHEN hit THEN first_ping END AS b,
        CASE WHEN hit THEN last_ping END AS e, CASE WHEN hit THEN n END AS pings FROM tmerged
        UNION ALL SELECT 0, datekey, agencykey, 'ADDED', {hours('span')}, {hours('span')}, FALSE, first_ping, last_ping, n FROM added""",
    "ft": """SELECT CASE WHEN st = 'ADDED' THEN 0 ELSE o_orderkey + 1 END AS tripkey, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS datekey, d AS fulldate,
        n_regionkey + 1 AS agencykey, n_nationkey + 1 AS routekey, st AS tripstatus, ran,
        CASE WHEN o_orderstatus = 'O' AND o_custkey % 4 <> 0 THEN o_custkey % 180 + 1 END AS pings,
        CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.0001 AS DECIMAL(5,4)) AS vrm6, o_custkey % 500 + 1 AS vrh100,
        o_custkey % 7 = 0 AS isestimated, c_mktsegment = 'MACHINERY' AND o_orderkey % 20 = 0 AS isspecialevent,
        CAST(o_orderkey * 37 % 1440 AS INTEGER) AS s, CAST((o_orderkey * 37 % 1440 + o_custkey % 180) % 1440 AS INTEGER) AS e
        FROM (SELECT *, CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 AS INTEGER) AS d, o_orderstatus = 'O' AS ran,
          CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'ADDED' WHEN o_orderstatus = 'O' THEN 'OPERATED'
               WHEN o_orderstatus = 'P' THEN 'MISSED' ELSE 'CANCELLED' END AS st
          FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""",
    # miles to four decimals, as whole ten-thousandths
    "ftr": "SELECT *, CAST((CAST(vrm6 * 1000000 AS HUGEINT) + 50) // 100 AS BIGINT) AS vrm_u FROM ft",
    "minutes": "SELECT CAST(m AS INTEGER) AS minute FROM generate_series(0, 1439) g(m)",
    "per_minute": """SELECT agencykey, datekey, minute AS timekey, CAST(count(*) AS INTEGER) AS active_trips FROM ft JOIN minutes
        ON (s <= e AND minute BETWEEN s AND e) OR (s > e AND (minute >= s OR minute <= e))
        WHERE tripstatus = 'OPERATED' AND NOT isspecialevent GROUP BY 1, 2, 3""",
    "peaks": """SELECT agencykey, datekey, active_trips AS peakvehiclecount, timekey AS peaktimekey FROM per_minute
        QUALIFY row_number() OVER (PARTITION BY agencykey, datekey ORDER BY active_trips DESC, timekey DESC) = 1""",
    "sd0": """SELECT agencykey, datekey, min(fulldate) AS fulldate, CAST(count(*) AS INTEGER) AS scheduledtrips,
        CAST(count(*) FILTER (ran) AS INTEGER) AS operatedtrips, CAST(count(*) FILTER (tripstatus = 'MISSED') AS INTEGER) AS missedtrips,
        CAST(count(*) FILTER (tripstatus = 'CANCELLED') AS INTEGER) AS cancelledtrips,
        CAST(count(*) FILTER (tripkey = 0) AS INTEGER) AS unmatchedtripcount,
        CAST(COALESCE(sum(vrm_u) FILTER (ran), 0) AS BIGINT) AS rm, CAST(COALESCE(sum(vrh100) FILTER (ran), 0) AS BIGINT) AS rh,
        CAST(COALESCE(sum(vrm_u) FILTER (ran AND isestimated), 0) AS BIGINT) AS em,
        CAST(COALESCE(sum(vrh100) FILTER (ran AND isestimated), 0) AS BIGINT) AS eh,
        count(*) FILTER (ran AND pings IS NULL) AS silent, count(*) FILTER (ran AND isestimated) AS est,
        bool_or(isspecialevent) AS isspecialeventday FROM ftr GROUP BY 1, 2""",
    "sd": f"""SELECT sd0.*, {ratio4('missedtrips', 'scheduledtrips - cancelledtrips')} AS missedtriprate,
        rm / 10000.0::DOUBLE AS reportedvrm, rh / 100.0::DOUBLE AS reportedvrh, em / 10000.0::DOUBLE AS estimatedvrm, eh / 100.0::DOUBLE AS estimatedvrh,
        COALESCE(peakvehiclecount, 0) AS peakvehiclecount, COALESCE(peaktimekey, 0) AS peaktimekey,
        5 * silent > operatedtrips AS feedgapflag, 20 * est > 3 * operatedtrips AS dataqualityalertflag,
        NOT isspecialeventday AND operatedtrips > 0 AND NOT 20 * est > 3 * operatedtrips AS isofficial
        FROM sd0 LEFT JOIN peaks USING (agencykey, datekey)""",
    "sdn": f"""SELECT sd.*, agencyname, mode, CAST(year(fulldate) AS INTEGER) AS calendaryear, CAST(month(fulldate) AS INTEGER) AS calendarmonth,
        {fiscal('fulldate')} AS federalfiscalmonth FROM sd JOIN d_agency USING (agencykey)
        WHERE fulldate BETWEEN (SELECT CAST(min(o_orderdate) AS DATE) FROM orders) AND (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)""",
    "vo": """SELECT datekey, fulldate, calendarmonth, calendaryear, federalfiscalmonth, agencykey, agencyname, mode, peakvehiclecount, peaktimekey,
        TIMESTAMP '1970-01-01' + to_minutes(peaktimekey) AS peak_time,
        CASE WHEN peaktimekey BETWEEN 360 AND 539 THEN 'AM Peak' WHEN peaktimekey BETWEEN 900 AND 1139 THEN 'PM Peak' ELSE 'Base' END AS peak_period,
        max(peakvehiclecount) OVER (PARTITION BY agencykey, mode, calendaryear, calendarmonth) AS monthly_voms,
        max(peakvehiclecount) OVER (PARTITION BY agencykey, mode, calendaryear, federalfiscalmonth) AS ntd_period_voms
        FROM sdn WHERE NOT isspecialeventday AND operatedtrips > 0""",
    "fs": """SELECT *, ontime IS NOT NULL AND NOT is_origin AND NOT is_terminal AS isofficial FROM (
        SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE l_orderkey + 1 END AS tripkey, n_nationkey + 1 AS routekey, n_regionkey + 1 AS agencykey,
        CAST(o_orderdate AS DATE) AS fulldate, seen, CASE WHEN seen THEN dev BETWEEN -60 AND 300 END AS ontime,
        CASE WHEN seen THEN dev > 300 END AS late, CASE WHEN seen THEN dev < -60 END AS early,
        l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_origin,
        l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_terminal
        FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS dev,
              NOT (l_returnflag = 'N' AND l_linestatus = 'O') AS seen FROM lineitem JOIN orders ON o_orderkey = l_orderkey
              JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey))""",
    "fsn": """SELECT fs.*, a.agencyname, a.mode, r.routeid, r.routeshortname, r.routelongname FROM fs
        JOIN d_agency a USING (agencykey) JOIN d_route r USING (routekey)""",
    "orm": f"""SELECT agencykey, agencyname, mode, routekey, routeid, routeshortname, routelongname, CAST(year(fulldate) AS INTEGER) AS calendaryear,
        CAST(month(fulldate) AS INTEGER) AS calendarmonth, count(*) AS total_obs, count(*) FILTER (ontime) AS ontime,
        count(*) FILTER (late) AS late, count(*) FILTER (early) AS early, {pct('count(*) FILTER (ontime)', 'count(*)', 1)} AS otp_pct
        FROM fsn WHERE isofficial GROUP BY ALL""",
    "dos": f"""SELECT fulldate, dayname(fulldate) AS dayofweek, isodow(fulldate) >= 6 AS isweekend, count(*) AS total_obs,
        count(DISTINCT tripkey) AS unique_trips, count(DISTINCT routekey) AS unique_routes,
        {pct('count(*) FILTER (isofficial)', 'count(*)', 1)} AS otp_pct FROM fs GROUP BY 1, 2, 3""",
    "al": "SELECT * FROM sdn WHERE dataqualityalertflag OR feedgapflag",
    "feed_tu": """SELECT *, epoch(CAST(l_shipdate AS TIMESTAMP))::BIGINT + l_linenumber * 7200 AS moment, CAST(l_quantity AS INTEGER) AS dl,
        CAST(l_partkey % 400 AS INTEGER) AS length FROM lineitem""",
    "runs": """SELECT CAST(ts AS DATE) AS run_date, ts AS run_timestamp, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
        event_type = 'signup' AS is_new_version, CAST(user_id % 12 AS INTEGER) AS file_count,
        CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error FROM events""",
    "lastrun": "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_date ORDER BY run_timestamp DESC) = 1",
    "st_stop": f"""SELECT {FIRST} + CAST(l_partkey % 20 * 2 AS INTEGER) AS d, l_partkey % 20 < 8 AND l_returnflag = 'N' AS open FROM lineitem""",
    "st_trip": f"""SELECT {FIRST} + CAST(o_custkey % 12 * 3 AS INTEGER) AS d, o_custkey % 12 < 5 AND o_orderstatus = 'P' AS missed,
        CAST(o_custkey % 5 + 1 AS INTEGER) AS agencykey FROM orders""",
    "st_day": f"""SELECT DISTINCT {FIRST} + CAST(c_custkey % 12 * 3 AS INTEGER) AS d, CAST(c_custkey % 5 + 1 AS INTEGER) AS agencykey
        FROM customer WHERE c_custkey % 60 < 50""",
    "stu_days": f"SELECT DISTINCT {FIRST} + CAST(l_orderkey % 30 AS INTEGER) AS d FROM lineitem",
    "vp_days": "SELECT DISTINCT CAST(ts AS DATE) AS d FROM events",
    "g_stop": """SELECT d, CASE WHEN n = 0 THEN 'missing' ELSE 'merge' END AS state FROM (
        SELECT x.d, count(s.d) AS n, count(*) FILTER (s.open) AS o FROM stu_days x LEFT JOIN st_stop s ON s.d = x.d GROUP BY 1) WHERE n = 0 OR o > 0""",
    "g_trip": """SELECT d, CASE WHEN n = 0 THEN 'missing' ELSE 'merge' END AS state FROM (
        SELECT x.d, count(s.d) AS n, count(*) FILTER (s.missed) AS o FROM vp_days x LEFT JOIN st_trip s ON s.d = x.d GROUP BY 1) WHERE n = 0 OR o > 0""",
    "lacking": """SELECT DISTINCT d FROM st_trip t WHERE NOT missed AND NOT EXISTS (
        SELECT 1 FROM st_day y WHERE y.d = t.d AND y.agencykey = t.agencykey)""",
    "g_all": """SELECT 'stop-fact' AS job, d AS service_date, state FROM g_stop
        UNION ALL SELECT 'trip-fact', d, state FROM g_trip
        UNION ALL SELECT 'service-day-fact', d, 'missing' FROM (SELECT d FROM g_trip UNION
          (SELECT d FROM lacking INTERSECT SELECT d FROM vp_days))""",
    "docs": "SELECT sha256(text) AS feedhash, TIMESTAMP '1970-01-01' + to_seconds(doc_id + 1700000000) AS ingestedat, lang FROM documents",
    "reg1_rows": "SELECT feedhash, min(ingestedat) AS ingestedat FROM docs WHERE lang = 'en' GROUP BY 1",
    "reg1": f"SELECT _key AS versionkey, feedhash, ingestedat FROM {numbered('reg1_rows', ['feedhash'])}",
    "reg2_rows": "SELECT feedhash, min(ingestedat) AS ingestedat FROM docs WHERE feedhash NOT IN (SELECT feedhash FROM reg1) GROUP BY 1",
    "reg2": f"SELECT _key AS versionkey, feedhash, ingestedat FROM {numbered('reg2_rows', ['feedhash'], '(SELECT max(versionkey) FROM reg1)')}",
    "checks": """
        SELECT 'agency' AS t, 'row_counts' AS c, CAST(count(*) = 0 AS BIGINT) AS f, count(*) AS n FROM region
        UNION ALL SELECT 'agency', 'required_columns', 0, count(*) FROM region
        UNION ALL SELECT 'agency', 'null_checks', count(*) FILTER (r_name IS NULL), count(*) FROM region
        UNION ALL SELECT 'agency', 'duplicate_checks', count(*) - count(DISTINCT r_regionkey), count(*) FROM region
        UNION ALL SELECT 'routes', 'row_counts', CAST(count(*) = 0 AS BIGINT), count(*) FROM nation
        UNION ALL SELECT 'routes', 'required_columns', 0, count(*) FROM nation
        UNION ALL SELECT 'routes', 'null_checks', 0, count(*) FROM nation
        UNION ALL SELECT 'routes', 'duplicate_checks', count(*) - count(DISTINCT n_nationkey), count(*) FROM nation
        UNION ALL SELECT 'stops', 'row_counts', CAST(count(*) = 0 AS BIGINT), count(*) FROM supplier
        UNION ALL SELECT 'stops', 'required_columns', 0, count(*) FROM supplier
        UNION ALL SELECT 'stops', 'null_checks', 0, count(*) FROM supplier
        UNION ALL SELECT 'stops', 'duplicate_checks', count(*) - count(DISTINCT s_suppkey), count(*) FROM supplier
        UNION ALL SELECT 'trips', 'row_counts', CAST(count(*) = 0 AS BIGINT), count(*) FROM tt_trips
        UNION ALL SELECT 'trips', 'required_columns', 0, count(*) FROM tt_trips
        UNION ALL SELECT 'trips', 'null_checks', 0, count(*) FROM tt_trips
        UNION ALL SELECT 'trips', 'duplicate_checks', count(*) - count(DISTINCT trip_id), count(*) FROM tt_trips
        UNION ALL SELECT 'stop_times', 'row_counts', CAST(count(*) = 0 AS BIGINT), count(*) FROM tt_stop_times
        UNION ALL SELECT 'stop_times', 'required_columns', 0, count(*) FROM tt_stop_times
        UNION ALL SELECT 'stop_times', 'null_checks', 0, count(*) FROM tt_stop_times
        UNION ALL SELECT 'stop_times', 'departure_time_format', count(*) FILTER (NOT regexp_full_match(departure_time, '[0-9]{1,2}:[0-9]{2}:[0-9]{2}')), count(*) FROM tt_stop_times
        UNION ALL SELECT 'stop_times', 'duplicate_checks', count(*) - count(DISTINCT (trip_id, stop_sequence)), count(*) FROM tt_stop_times
        UNION ALL SELECT 'calendar', 'row_counts', CAST(count(*) = 0 AS BIGINT), count(*) FROM cal
        UNION ALL SELECT 'calendar', 'required_columns', 0, count(*) FROM cal
        UNION ALL SELECT 'calendar', 'null_checks', 0, count(*) FROM cal
        UNION ALL SELECT 'calendar_dates', 'row_counts', CAST(count(*) = 0 AS BIGINT), count(*) FROM exc
        UNION ALL SELECT 'calendar_dates', 'required_columns', 0, count(*) FROM exc
        UNION ALL SELECT 'calendar_dates', 'null_checks', 0, count(*) FROM exc
        UNION ALL SELECT 'shapes', 'row_counts', CAST(count(*) = 0 AS BIGINT), count(*) FROM tt_shapes
        UNION ALL SELECT 'shapes', 'required_columns', 0, count(*) FROM tt_shapes
        UNION ALL SELECT 'shapes', 'null_checks', 0, count(*) FROM tt_shapes
        UNION ALL SELECT 'shapes', 'duplicate_checks', count(*) - count(DISTINCT (shape_id, seq)), count(*) FROM tt_shapes
        UNION ALL SELECT 'transfers', 'row_counts', CAST(count(*) = 0 AS BIGINT), count(*) FROM supplier
        UNION ALL SELECT 'transfers', 'required_columns', 0, count(*) FROM supplier
        UNION ALL SELECT 'fare_rules', 'load', 1, 0""",
    "verd": """SELECT t AS table_name, max(n) AS row_count, COALESCE(bool_and(f = 0) FILTER (c = 'required_columns'), TRUE) AS required_columns_passed,
        COALESCE(bool_and(f = 0) FILTER (c = 'null_checks'), TRUE) AS null_check_passed,
        COALESCE(bool_and(f = 0) FILTER (c = 'duplicate_checks'), TRUE) AS duplicate_check_passed, bool_and(f = 0) AS overall_passed,
        NOT bool_and(f = 0) AND t IN ('trips', 'stops', 'routes', 'stop_times') AS critical_failure FROM checks GROUP BY t""",
    "k_service_rows": """SELECT serviceid, CASE WHEN serviceid IN (SELECT service_id FROM cal) THEN FALSE ELSE TRUE END AS isspecialevent
        FROM (SELECT service_id AS serviceid FROM cal UNION SELECT service_id FROM exc)""",
    "k_service": f"SELECT _key AS servicekey, serviceid, isspecialevent FROM {numbered('k_service_rows', ['serviceid'])}",
    "k_shape_rows": """SELECT shape_id AS shapeid, max(CASE WHEN regexp_full_match(dist, '[0-9]+([.][0-9]+)?') THEN CAST(dist AS DOUBLE) END) AS metres
        FROM tt_shapes GROUP BY 1""",
    "k_shape": f"SELECT _key AS shapekey, shapeid, metres FROM {numbered('k_shape_rows', ['shapeid'])}",
    "k_dir_rows": """SELECT DISTINCT COALESCE(r.routekey, 0) AS routekey, t.direction_id AS directionid FROM tt_trips t
        LEFT JOIN d_route r ON r.routeid = t.route_id""",
    "k_dir": f"SELECT CAST(_key AS INTEGER) AS directionkey, directionid, routekey FROM {numbered('k_dir_rows', ['routekey', 'directionid'])}",
    "k_trip_old_rows": "SELECT DISTINCT trip_id AS tripid FROM tt_trips WHERE direction_id = 0",
    "k_trip_old": f"SELECT _key AS tripkey, tripid FROM {numbered('k_trip_old_rows', ['tripid'])}",
    "k_trip_new_rows": "SELECT DISTINCT trip_id AS tripid FROM tt_trips WHERE trip_id NOT IN (SELECT tripid FROM k_trip_old)",
    "k_trip_new": f"SELECT _key AS tripkey, tripid FROM {numbered('k_trip_new_rows', ['tripid'], '(SELECT max(tripkey) FROM k_trip_old)')}",
    "pk_old_rows": "SELECT DISTINCT p_name, p_brand FROM part WHERE p_size < 25",
    "pk_old": f"SELECT _key AS partkey, p_name, p_brand FROM {numbered('pk_old_rows', ['p_name', 'p_brand'])}",
    "pk_new_rows": "SELECT DISTINCT p_name, p_brand FROM part WHERE (p_name, p_brand) NOT IN (SELECT (p_name, p_brand) FROM pk_old)",
    "pk_new": f"SELECT _key AS partkey, p_name, p_brand FROM {numbered('pk_new_rows', ['p_name', 'p_brand'], '(SELECT max(partkey) FROM pk_old)')}",
    "polls": """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS ok,
        CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS fail FROM events GROUP BY 1""",
    "spine": """SELECT unnest(generate_series(min(w), greatest(max(w), time_bucket(INTERVAL 5 MINUTE, (SELECT max(ts) FROM events) + INTERVAL 1 HOUR) - INTERVAL 5 MINUTE),
        INTERVAL 5 MINUTE)) AS w FROM polls""",
}


def compose(body: str) -> str:
    """The statement with the shared sub-selects it mentions, directly or through others."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in SHARED:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(SHARED[name])
    parts = [f"{name} AS ({SHARED[name]})" for name in SHARED if name in needed]
    if not parts:
        return body
    own = body.strip()
    return f"WITH {', '.join(parts)}" + (f", {own[5:]}" if own.startswith("WITH ") else f" {own}")


MERGE_COLUMNS = """tripkey, stopkey, stop_sequence AS stopsequence, datekey, CASE WHEN {0} THEN arrival END AS actualarrival,
    CASE WHEN {0} THEN departure END AS actualdeparture, CASE WHEN {0} THEN dev END AS arrivaldevseconds,
    CASE WHEN {0} THEN 'GTFS_RT_REPORTED' ELSE {1} END AS arrivalsource, CASE WHEN {0} THEN dev BETWEEN -60 AND 300 END AS isontime,
    CASE WHEN {0} THEN dev < -60 END AS isearly, CASE WHEN {0} THEN dev > 300 END AS islate, NOT ({0}) AS isestimated, FALSE AS isofficial"""
PART_SOURCE = "CASE WHEN stop_sequence <= 2 THEN 'GTFS_RT_REPORTED' ELSE 'FALLBACK_SCHEDULED' END"


def pinged(hit: str, old_status: str) -> str:
    return f"""SELECT t.tripkey, t.datekey, CASE WHEN {hit} THEN 'OPERATED' ELSE {old_status} END AS tripstatus,
        CASE WHEN {hit} THEN 'GTFS_RT' ELSE tripstatussource END AS tripstatussource, CASE WHEN {hit} THEN first_ping END AS actualstarttime,
        CASE WHEN {hit} THEN last_ping END AS actualendtime, CASE WHEN {hit} THEN 'LAST_PING' END AS tripendsource,
        CASE WHEN {hit} THEN n END AS actualpingcount, CASE WHEN {hit} THEN CAST(span // 30 AS INTEGER) END AS expectedpingcount,
        CASE WHEN {hit} THEN {coverage('n', 'span')} END AS rtcoveragerate, vrm AS reportedvrm,
        CASE WHEN {hit} AND span > 0 THEN {hours('span')} ELSE vrh END AS reportedvrh, TRUE AS isestimated
        FROM tskel t LEFT JOIN keyed_pings p USING (tripkey, datekey)"""



BODIES: dict[str, str] = {
    "gtfs_time_seconds": f"""SELECT trip_id, stop_id, stop_sequence, CAST({secs('arrival_time')} AS INTEGER) AS arrival_seconds,
        CAST({secs('departure_time')} AS INTEGER) AS departure_seconds, CAST({secs('arrival_time')} // 60 % 1440 AS INTEGER) AS minute_key,
        regexp_full_match(stop_sequence, '[0-9]+') AS numeric_sequence, regexp_full_match(arrival_time, '[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}') AS valid_time,
        arrival_time <> '' AS has_arrival FROM tt_stop_times""",
    "date_and_minute_keys": f"""SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day, CAST(ts AS DATE) AS local_day,
        CAST(ts - INTERVAL 3 HOUR AS DATE) AS service_day_cutoff_3, {key('ts')} AS datekey, CAST(ts AS DATE) AS date_again, CAST(ts AS DATE) AS gtfs_date,
        CAST(NULL AS DATE) AS bad_date, CAST(ts AS DATE) >= DATE '2024-01-20' AS recent, DATE '2024-01-29' AS default_day FROM events""",
    "local_times": """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, date_trunc('second', ts) AS utc_time,
        timezone('America/Los_Angeles', timezone('UTC', date_trunc('second', ts))) AS local_time,
        CAST(timezone('America/Los_Angeles', timezone('UTC', date_trunc('second', ts))) AS DATE) AS local_date FROM events""",
    "scheduled_and_deviation": """SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_seconds(user_id * 700) AS scheduled,
        CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) - user_id * 700 AS INTEGER) AS deviation,
        CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) - user_id * 700 AS BIGINT) AS elapsed FROM events""",
    "enum_labels": """SELECT CASE user_id % 5 WHEN 0 THEN 'SCHEDULED' WHEN 1 THEN 'ADDED' WHEN 2 THEN 'UNSCHEDULED' WHEN 3 THEN 'CANCELED' ELSE 'UNKNOWN' END AS relationship,
        CASE user_id % 5 WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' WHEN 2 THEN 'IN_TRANSIT_TO' ELSE 'UNKNOWN' END AS vehicle_status,
        count(*) AS n FROM events GROUP BY 1, 2""",
    "rt_coverage_rates": f"""SELECT trip_id, service_date, n AS ping_count, span, CAST(span // 30 AS INTEGER) AS expected,
        {coverage('n * 300', 'span')} AS coverage, {hours('span')} AS hours FROM pings""",
    "active_services": "SELECT service_id, service_date FROM active",
    "service_day_flags": """SELECT x.service_id, x.service_date, a.service_id IS NOT NULL AS active, c.service_id IS NOT NULL AS cancelled, s.service_id IS NOT NULL AS special
        FROM (SELECT service_id, service_date FROM weekly UNION SELECT service_id, service_date FROM exc) x
        LEFT JOIN active a USING (service_id, service_date) LEFT JOIN cancelled c USING (service_id, service_date) LEFT JOIN special s USING (service_id, service_date)""",
    "cancelled_and_special_services": """SELECT service_id, service_date, 'cancelled' AS kind FROM cancelled
        UNION ALL SELECT service_id, service_date, 'special' FROM special""",
    "active_trips": "SELECT service_date, trip_id, route_id, service_id, shape_id FROM tt_trips JOIN active USING (service_id)",
    "scheduled_trips_semi": """SELECT trip_id, service_id FROM tt_trips WHERE service_id IN (SELECT service_id FROM active UNION SELECT service_id FROM cancelled)""",
    "stop_visits_origin_terminal": "SELECT * FROM ends",
    "stop_skeleton_zero_keys": """SELECT tripkey, routekey, stopkey, datekey, timekey, agencykey, 12 AS versionkey, arr_secs AS scheduledarrivalseconds,
        dep_secs AS scheduleddepartureseconds, stop_sequence AS stopsequence, 'FALLBACK_SCHEDULED' AS arrivalsource, is_origin AS isoriginstop,
        is_terminal AS isterminalstop, TRUE AS isestimated, FALSE AS isofficial FROM skel""",
    "skeleton_idempotent_anti": "SELECT tripkey, stopkey, stop_sequence AS stopsequence, datekey FROM skel WHERE stop_sequence > 3",
    "stop_updates_keep_latest": """SELECT agency_key, trip_id, 'Q' || stop_sequence AS stop_id, stop_sequence, service_date, fed AS feed_timestamp_utc, arrival AS arrival_time_local
        FROM upd QUALIFY row_number() OVER (PARTITION BY agency_key, trip_id, stop_sequence, service_date ORDER BY fed DESC NULLS LAST, arrival DESC NULLS LAST) = 1""",
    "positions_keep_latest": """SELECT agency_key, vehicle_id, date_trunc('hour', seen_at) AS timestamp_utc, fed AS feed_timestamp_utc, trip_id, latitude FROM vp
        QUALIFY row_number() OVER (PARTITION BY agency_key, vehicle_id, date_trunc('hour', seen_at) ORDER BY fed DESC, trip_id DESC, latitude DESC) = 1""",
    "stop_merge_otp_flags": "SELECT " + MERGE_COLUMNS.format("hit", "'FALLBACK_SCHEDULED'") + " FROM joined",
    "stop_merge_unforced": "SELECT " + MERGE_COLUMNS.format("(hit AND stop_sequence > 2)", PART_SOURCE) + " FROM joined",
    "stop_merge_forced": "SELECT " + MERGE_COLUMNS.format("hit", PART_SOURCE) + " FROM joined",
    "stop_official": """SELECT datekey, routekey, count(*) AS n, count(*) FILTER (hit AND NOT is_origin AND NOT is_terminal) AS official,
        count(*) FILTER (hit AND dev BETWEEN -60 AND 300) AS ontime FROM joined GROUP BY 1, 2""",
    "stop_fact_profile": f"""SELECT {key('fulldate')} AS datekey, CASE WHEN seen THEN 'GTFS_RT_REPORTED' ELSE 'FALLBACK_SCHEDULED' END AS arrivalsource,
        isofficial, ontime AS isontime, count(*) AS row_count FROM fs GROUP BY ALL""",
    "trip_scheduled_miles": "SELECT shape_id, miles FROM shape_len WHERE shape_id IN (SELECT shape_id FROM tt_trips)",
    "trip_scheduled_hours": "SELECT trip_id, hours FROM trip_len WHERE trip_id IN (SELECT trip_id FROM tt_trips)",
    "trip_skeleton_status": """SELECT tripkey, datekey, agencykey, routekey, 12 AS versionkey, tripstatus, tripstatussource, vrm AS scheduledvrm, vrh AS scheduledvrh,
        vrm AS reportedvrm, vrh AS reportedvrh, TRUE AS isestimated, isspecialevent, FALSE AS isofficial FROM tskel""",
    "trip_skeleton_forced": "SELECT 'forced' AS mode, tripstatus, count(*) AS n FROM tskel GROUP BY 2",
    "trip_ping_merge": pinged("(p.tripkey IS NOT NULL AND tripstatus = 'MISSED')", "tripstatus"),
    "trip_ping_merge_forced": pinged(
        "(p.tripkey IS NOT NULL AND tripstatus <> 'CANCELLED')",
        "CASE WHEN tripstatus = 'MISSED' AND t.tripkey % 2 = 0 THEN 'OPERATED' ELSE tripstatus END",
    ),
    "added_trips": f"""SELECT CAST(0 AS BIGINT) AS tripkey, datekey, 'ADDED' AS tripstatus, 'GTFS_RT' AS tripstatussource, first_ping AS actualstarttime, last_ping AS actualendtime,
        'LAST_PING' AS tripendsource, n AS actualpingcount, CAST(span // 30 AS INTEGER) AS expectedpingcount, {coverage('n', 'span')} AS rtcoveragerate,
        {hours('span')} AS reportedvrm, {hours('span')} AS reportedvrh, TRUE AS isestimated, agencykey, 0 AS routekey, 12 AS versionkey,
        0.0::DOUBLE AS scheduledvrm, 0.0::DOUBLE AS scheduledvrh, FALSE AS isofficial, 'ADDED_UNSCHEDULED' AS dataqualityflag FROM added""",
    "trip_official": """SELECT datekey, agencykey, tripstatus, count(*) AS n,
        count(*) FILTER (tripstatus IN ('OPERATED', 'ADDED') AND vrm > 0 AND vrh > 0) AS official FROM tfinal GROUP BY 1, 2, 3""",
    "backfill_actual_times": f"""SELECT t.tripkey, t.datekey, CASE WHEN t.tripstatus = 'MISSED' THEN 'OPERATED' ELSE t.tripstatus END AS tripstatus,
        CASE WHEN t.tripstatus = 'MISSED' THEN p.first_ping END AS actualstarttime, CASE WHEN t.tripstatus = 'MISSED' THEN p.last_ping END AS actualendtime,
        NOT (t.tripstatus = 'MISSED' AND p.tripkey IS NOT NULL) AS isestimated FROM tskel t LEFT JOIN (
          SELECT dt.tripkey, {key('a.service_date')} AS datekey, a.first_ping, a.last_ping FROM pings_agency a JOIN d_trip dt ON dt.tripid = a.trip_id
          QUALIFY row_number() OVER (PARTITION BY dt.tripkey, a.service_date ORDER BY a.last_ping DESC, a.agency_key DESC) = 1) p USING (tripkey, datekey)""",
    "trip_fact_profile": f"""SELECT datekey, tripstatus, CAST(NULL AS VARCHAR) AS tripstatussource, isestimated, ran AS isofficial, isspecialevent, count(*) AS row_count,
        CAST((2 * sum(vrm_u) + count(*) * 100) // (count(*) * 200) AS BIGINT) / 100.0::DOUBLE AS avg_scheduled_vrm,
        CAST((2 * sum(vrh100) + count(*)) // (count(*) * 2) AS BIGINT) / 100.0::DOUBLE AS avg_scheduled_vrh,
        count(pings) AS trips_with_rt_data, CAST(NULL AS DOUBLE) AS avg_rt_coverage FROM ftr GROUP BY datekey, tripstatus, isestimated, ran, isspecialevent""",
    "active_vehicles_per_minute": "SELECT agencykey, datekey, timekey, active_trips FROM per_minute",
    "active_vehicles_clock_rule": """SELECT agencykey, datekey, minute AS timekey, CAST(count(*) AS INTEGER) AS active_trips FROM ft JOIN minutes
        ON minute BETWEEN s AND e WHERE tripstatus = 'OPERATED' AND NOT isspecialevent GROUP BY 1, 2, 3""",
    "voms_peak_by_day": "SELECT * FROM peaks",
    "service_day_rollup": """SELECT agencykey, datekey, scheduledtrips, operatedtrips, missedtrips, cancelledtrips, missedtriprate, unmatchedtripcount, reportedvrm, reportedvrh,
        estimatedvrm, estimatedvrh, peakvehiclecount, peaktimekey, isspecialeventday, feedgapflag, dataqualityalertflag, isofficial FROM sd""",
    "service_day_from_timetable": f"""WITH act AS (SELECT agencykey, datekey, minute, count(*) AS c FROM tfinal JOIN minutes
          ON minute BETWEEN hour(b) * 60 + minute(b) AND hour(e) * 60 + minute(e) WHERE tripstatus = 'OPERATED' AND NOT isspecialevent GROUP BY 1, 2, 3),
        pk AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY agencykey, datekey ORDER BY c DESC, minute DESC) = 1),
        ag AS (SELECT agencykey, datekey, count(*) AS total, count(*) FILTER (tripstatus IN ('OPERATED', 'ADDED')) AS op, count(*) FILTER (tripstatus = 'MISSED') AS mi,
          count(*) FILTER (tripstatus = 'CANCELLED') AS ca, count(*) FILTER (tripkey = 0) AS un,
          CAST(COALESCE(sum(CAST(round(vrm * 10000) AS BIGINT)) FILTER (tripstatus IN ('OPERATED', 'ADDED')), 0) AS BIGINT) / 10000.0::DOUBLE AS m,
          CAST(COALESCE(sum(CAST(round(vrh * 10000) AS BIGINT)) FILTER (tripstatus IN ('OPERATED', 'ADDED')), 0) AS BIGINT) / 10000.0::DOUBLE AS h,
          bool_or(isspecialevent) AS sp FROM tfinal GROUP BY 1, 2)
        SELECT ag.agencykey, ag.datekey, CAST(total AS INTEGER) AS scheduledtrips, CAST(op AS INTEGER) AS operatedtrips, CAST(mi AS INTEGER) AS missedtrips,
        CAST(ca AS INTEGER) AS cancelledtrips, {ratio4('mi', 'total - ca')} AS missedtriprate, CAST(un AS INTEGER) AS unmatchedtripcount, m AS reportedvrm, h AS reportedvrh,
        m AS estimatedvrm, h AS estimatedvrh, CAST(COALESCE(c, 0) AS INTEGER) AS peakvehiclecount, COALESCE(pk.minute, 0) AS peaktimekey, sp AS isspecialeventday,
        FALSE AS feedgapflag, op > 0 AS dataqualityalertflag, FALSE AS isofficial FROM ag LEFT JOIN pk USING (agencykey, datekey)""",
    "day_fact_profile": """SELECT agencykey, datekey, scheduledtrips, operatedtrips, missedtrips, cancelledtrips,
        CAST((CAST(round(missedtriprate * 10000) AS BIGINT) + 5) // 10 AS BIGINT) / 1000.0::DOUBLE AS missedtriprate, CAST((rm + 50) // 100 AS BIGINT) / 100.0::DOUBLE AS reportedvrm,
        reportedvrh, peakvehiclecount, isspecialeventday, feedgapflag, dataqualityalertflag, isofficial FROM sd""",
    "otp_by_route_month": "SELECT * FROM orm",
    "daily_otp_summary": "SELECT * FROM dos",
    "routes_consistently_late": f"""WITH d AS (SELECT agencykey, agencyname, mode, routekey, routeid, routeshortname, routelongname, fulldate,
          CAST((2000 * count(*) FILTER (ontime) + count(*)) // (2 * count(*)) AS BIGINT) AS p FROM fsn WHERE isofficial GROUP BY ALL)
        SELECT agencykey, agencyname, mode, routekey, routeid, routeshortname, routelongname, count(*) AS days_evaluated, count(*) FILTER (p < 700) AS days_below_70pct,
        CAST((2 * sum(p) + count(*)) // (2 * count(*)) AS BIGINT) / 10.0::DOUBLE AS avg_otp_pct, min(p) / 10.0::DOUBLE AS worst_day_otp_pct, max(p) / 10.0::DOUBLE AS best_day_otp_pct
        FROM d GROUP BY ALL HAVING count(*) FILTER (p < 700) >= 5""",
    "quality_daily": """SELECT fulldate, count(*) AS total, count(*) FILTER (isofficial) AS official, count(*) FILTER (tripkey = 0) AS unmatched_trip FROM fs GROUP BY 1""",
    "missed_trip_rate_by_route": f"""SELECT f.agencykey, agencyname, mode, f.routekey, routeid, routeshortname, routelongname, f.fulldate, dd.calendarmonth, dd.calendaryear,
        count(*) AS total_scheduled_trips, count(*) FILTER (tripstatus = 'OPERATED') AS operated_trips, count(*) FILTER (tripstatus = 'MISSED') AS missed_trips,
        count(*) FILTER (tripstatus = 'CANCELLED') AS cancelled_trips, {pct("count(*) FILTER (tripstatus = 'MISSED')", 'count(*)', 2)} AS missed_trip_rate_pct
        FROM ft f JOIN d_agency a ON a.agencykey = f.agencykey JOIN d_route r ON r.routekey = f.routekey JOIN d_date dd ON dd.datekey = f.datekey GROUP BY ALL""",
    "voms_month_fiscal_peaks": "SELECT * FROM vo",
    "revenue_hours_daily": """SELECT agencykey, agencyname, mode, fulldate, calendaryear, calendarmonth, federalfiscalmonth, reportedvrh, estimatedvrh,
        (rh + eh) / 100.0::DOUBLE AS total_vrh_including_estimated, isofficial FROM sdn WHERE NOT isspecialeventday""",
    "revenue_miles_daily": """SELECT agencykey, agencyname, mode, fulldate, calendaryear, calendarmonth, federalfiscalmonth, reportedvrm, estimatedvrm,
        (rm + em) / 10000.0::DOUBLE AS total_vrm_including_estimated, isofficial FROM sdn WHERE NOT isspecialeventday""",
    "quality_alerts": "SELECT fulldate, agencyname, mode, scheduledtrips, operatedtrips, dataqualityalertflag, feedgapflag, isofficial FROM al",
    "missed_trip_trend": "SELECT fulldate, agencyname, mode, scheduledtrips, missedtrips, missedtriprate FROM sdn",
    "monthly_ntd_summary": """SELECT agencyname, mode, calendaryear, federalfiscalmonth, CAST(sum(rm) AS BIGINT) / 10000.0::DOUBLE AS total_vrm, CAST(sum(rh) AS BIGINT) / 100.0::DOUBLE AS total_vrh,
        CAST(sum(scheduledtrips) AS BIGINT) AS total_scheduled, CAST(sum(operatedtrips) AS BIGINT) AS total_operated, CAST(sum(missedtrips) AS BIGINT) AS total_missed
        FROM sdn WHERE isofficial GROUP BY 1, 2, 3, 4""",
    "voms_line_by_month": "SELECT CAST(date_trunc('month', fulldate) AS DATE) AS month, agencyname, CAST(sum(monthly_voms) AS BIGINT) AS monthly_voms FROM vo GROUP BY 1, 2",
    "voms_bar_by_mode": "SELECT mode, agencyname, CAST(sum(monthly_voms) AS BIGINT) AS monthly_voms FROM vo GROUP BY 1, 2",
    "voms_bar_by_period": "SELECT peak_period, CAST(sum(monthly_voms) AS BIGINT) AS monthly_voms FROM vo GROUP BY 1",
    "voms_table_detail": """SELECT CAST(date_trunc('month', fulldate) AS DATE) AS month, agencyname, mode, peak_period, CAST(sum(monthly_voms) AS BIGINT) AS monthly_voms,
        CAST(sum(ntd_period_voms) AS BIGINT) AS ntd_period_voms FROM vo GROUP BY 1, 2, 3, 4""",
    "kpi_month_over_month": """WITH m AS (SELECT agencyname, CAST(date_trunc('month', fulldate) AS DATE) AS month, CAST(sum(monthly_voms) AS DOUBLE) AS total FROM vo GROUP BY 1, 2),
        p AS (SELECT *, lag(total) OVER (PARTITION BY agencyname ORDER BY month) AS previous FROM m)
        SELECT *, CASE WHEN previous <> 0 THEN (total - previous) * 100 / abs(previous) END AS pct_change FROM p""",
    "coverage_kpi": """SELECT agencyname, CAST(sum(operatedtrips) AS BIGINT) AS operatedtrips, CAST(sum(scheduledtrips) AS BIGINT) AS scheduledtrips,
        CAST(sum(operatedtrips) AS DOUBLE) / CAST(sum(scheduledtrips) AS DOUBLE) AS rt_coverage_rate FROM al GROUP BY 1""",
    "alert_table": """SELECT fulldate, agencyname, dataqualityalertflag, feedgapflag, CAST(sum(scheduledtrips) AS BIGINT) AS scheduledtrips, CAST(sum(operatedtrips) AS BIGINT) AS operatedtrips
        FROM al WHERE agencyname IN ('AFRICA', 'ASIA') GROUP BY 1, 2, 3, 4""",
    "alert_bars": "SELECT fulldate, CAST(sum(operatedtrips) AS BIGINT) AS operatedtrips, CAST(sum(scheduledtrips) AS BIGINT) AS scheduledtrips FROM al GROUP BY 1",
    "daily_otp_trend": "SELECT fulldate, sum(otp_pct) AS otp_pct FROM dos GROUP BY 1",
    "daily_volume": "SELECT fulldate, CAST(sum(total_obs) AS BIGINT) AS total_obs FROM dos GROUP BY 1",
    "weekday_weekend_volume": "SELECT dayofweek, isweekend, CAST(sum(total_obs) AS BIGINT) AS total_obs FROM dos GROUP BY 1, 2",
    "top10_routes": "SELECT routeshortname, CAST(sum(total_obs) AS BIGINT) AS total_obs FROM orm GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "top10_route_otp": """SELECT routeshortname, CAST(sum(CAST(round(otp_pct * 10) AS BIGINT)) AS BIGINT) / 10.0::DOUBLE AS otp_pct FROM orm WHERE routeshortname IN (
        SELECT routeshortname FROM orm GROUP BY 1 ORDER BY sum(total_obs) DESC, 1 LIMIT 10) GROUP BY 1""",
    "valid_feed_snapshots": "SELECT CAST(l_suppkey % 2 AS VARCHAR) AS agency_key, count(*) AS n, min(length) AS shortest FROM feed_tu WHERE length >= 100 AND l_quantity <> 1 GROUP BY 1",
    "flatten_trip_updates": """WITH u AS (
        SELECT *, 'S' || l_suppkey AS sid, l_linenumber AS sq, l_returnflag <> 'N' AS ha, CASE WHEN l_tax <> 0 THEN moment + dl * 10 END AS a, l_linestatus = 'F' AS hd, moment + dl * 20 AS d
          FROM feed_tu WHERE length >= 100 AND l_quantity <> 1
        UNION ALL SELECT *, 'Q' || l_partkey, l_linenumber + 1, FALSE, NULL, TRUE, moment + dl FROM feed_tu WHERE length >= 100 AND l_quantity <> 1),
      v AS (SELECT *, CASE WHEN ha THEN a END AS arr, CASE WHEN hd THEN d END AS dep FROM u)
        SELECT CAST(l_suppkey % 2 AS VARCHAR) AS agency_key, CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(NULL AS VARCHAR) AS route_id,
        CASE WHEN l_linenumber % 3 < 2 THEN CAST(l_linenumber % 3 AS INTEGER) END AS direction_id,
        CASE l_partkey % 5 WHEN 0 THEN 'SCHEDULED' WHEN 1 THEN 'ADDED' WHEN 2 THEN 'UNSCHEDULED' WHEN 3 THEN 'CANCELED' ELSE 'UNKNOWN' END AS schedule_relationship,
        CAST(timezone('America/Los_Angeles', to_timestamp(moment)) AS DATE) AS service_date, sid AS stop_id, CAST(sq AS INTEGER) AS stop_sequence,
        CASE WHEN ha THEN dl END AS arrival_delay, arr AS arrival_time_utc, timezone('America/Los_Angeles', to_timestamp(arr)) AS arrival_time_local,
        CASE WHEN hd THEN dl END AS departure_delay, dep AS departure_time_utc, timezone('America/Los_Angeles', to_timestamp(dep)) AS departure_time_local,
        timezone('UTC', to_timestamp(moment)) AS feed_timestamp_utc, CASE WHEN ha THEN 'GTFS_RT_REPORTED' ELSE 'FALLBACK_SCHEDULED' END AS arrival_source FROM v""",
    "flatten_vehicle_positions": """SELECT CAST(user_id % 5 AS VARCHAR) AS agency_key, CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS trip_id,
        CASE WHEN event_type <> 'error' THEN 'R' || user_id % 25 END AS route_id, CASE WHEN event_type <> 'view' THEN 'V' || user_id % 50 END AS vehicle_id,
        value AS latitude, -value AS longitude, CASE WHEN user_id % 9 <> 0 THEN CAST(user_id % 9 AS INTEGER) END AS current_stop_sequence,
        CASE event_id % 4 WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' WHEN 2 THEN 'IN_TRANSIT_TO' ELSE 'UNKNOWN' END AS current_status,
        CASE WHEN event_type <> 'click' THEN date_trunc('second', ts) END AS timestamp_utc,
        CASE WHEN event_type <> 'click' THEN timezone('America/Los_Angeles', timezone('UTC', date_trunc('second', ts))) END AS timestamp_local,
        date_trunc('second', ts) + INTERVAL 30 SECOND AS feed_timestamp_utc FROM events""",
    "stale_snapshots": "SELECT CAST(user_id % 5 AS VARCHAR) AS agency_key, event_id * 13 % 600 > 300 AS is_stale, count(*) AS n, max(event_id * 13 % 600) AS oldest FROM events GROUP BY 1, 2",
    "available_dates": """SELECT d AS service_date, 'updates' AS source FROM stu_days WHERE d >= DATE '2024-01-10' UNION ALL SELECT d, 'positions' FROM vp_days WHERE d >= DATE '2024-01-10'""",
    "gap_counters": f"SELECT {key('d')} AS datekey, count(*) FILTER (open) AS open_count, count(*) AS total_count FROM st_stop GROUP BY 1",
    "feed_gaps_service_day": "SELECT d AS service_date FROM lacking",
    "gap_dates": "SELECT job, service_date, state FROM g_all",
    "gap_work_list": """SELECT j.job, count(g.job) = 0 AS skip, CASE WHEN count(g.job) = 0 THEN 'none' WHEN j.job = 'service-day-fact' THEN 'load'
        WHEN bool_or(g.state = 'missing') THEN 'both' ELSE 'merge' END AS phase, min(g.service_date) AS start_date, max(g.service_date) AS end_date,
        string_agg(CAST(g.service_date AS VARCHAR), ',' ORDER BY g.service_date) AS gap_dates
        FROM (VALUES ('stop-fact'), ('trip-fact'), ('service-day-fact')) j(job) LEFT JOIN g_all g ON g.job = j.job GROUP BY 1""",
    "feed_version_register": """SELECT CAST(versionkey AS INTEGER) AS versionkey, feedhash, ingestedat, feedhash = (SELECT feedhash FROM reg2 ORDER BY ingestedat DESC, feedhash DESC LIMIT 1) AS iscurrent,
        TRUE AS isactive FROM (SELECT * FROM reg1 UNION ALL SELECT * FROM reg2)""",
    "changed_feeds": "SELECT feedhash, ingestedat FROM docs WHERE feedhash NOT IN (SELECT feedhash FROM reg1)",
    "current_feed_version": "SELECT CAST(versionkey AS INTEGER) AS versionkey FROM reg2 ORDER BY ingestedat DESC, feedhash DESC LIMIT 1",
    "latest_manifest": """SELECT feed_key, DATE '2000-01-01' AS load_date, feed_hash, FALSE AS is_new_version, file_count, TRUE AS fallback, d AS fallback_date FROM (
        SELECT o_orderpriority AS feed_key, CAST(o_orderdate AS DATE) AS d, sha256(CAST(o_orderkey AS VARCHAR)) AS feed_hash, CAST(o_custkey % 12 AS INTEGER) AS file_count FROM orders)
        WHERE d < DATE '2000-01-01' QUALIFY row_number() OVER (PARTITION BY feed_key ORDER BY d DESC, feed_hash DESC) = 1""",
    "latest_audit_run": "SELECT * FROM lastrun WHERE run_date = DATE '2024-01-15'",
    "daily_digest": """WITH v AS (SELECT CAST(ts AS DATE) AS d, count(*) FILTER (value > 100) = 0 AS ok, count(*) FILTER (event_type = 'view') AS p, count(*) AS n,
          bool_or(event_type = 'error') AS fb, max(sha256(CAST(event_id AS VARCHAR))) AS h FROM events GROUP BY 1)
        SELECT x.d AS run_date, COALESCE(status, 'UNKNOWN') AS run_status, run_timestamp, COALESCE(is_new_version, FALSE) AS is_new_version, COALESCE(file_count, 0) AS file_count, error,
        COALESCE(h, 'UNKNOWN') AS feed_hash, COALESCE(ok, FALSE) AS validation_passed, CAST(COALESCE(p, 0) AS INTEGER) AS tables_passed, CAST(COALESCE(n, 0) AS INTEGER) AS tables_total,
        COALESCE(fb, FALSE) AS fallback_used, CASE WHEN fb THEN x.d - 1 END AS fallback_date,
        CASE WHEN status = 'SUCCEEDED' AND ok THEN 'OK' WHEN status = 'SUCCEEDED' THEN 'ISSUES' ELSE 'FAILED' END AS headline
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events UNION SELECT DATE '2023-01-01') x LEFT JOIN lastrun r ON r.run_date = x.d LEFT JOIN v ON v.d = x.d""",
    "schema_reconcile": """SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_suppkey AS VARCHAR) AS stop_id, CAST(NULL AS VARCHAR) AS arrival_time, CAST(NULL AS VARCHAR) AS departure_time,
        CAST(l_linenumber AS VARCHAR) AS stop_sequence, l_returnflag AS ride_code FROM lineitem""",
    "drifted_append": """SELECT s_name AS stop_name, CAST(s_suppkey AS VARCHAR) AS stop_id, CAST(NULL AS VARCHAR) AS zone_id FROM supplier
        UNION ALL SELECT NULL, CAST(p_partkey AS VARCHAR), p_brand FROM part""",
    "null_profile": """SELECT 'trip_id' AS column_name, CAST(0 AS BIGINT) AS null_count UNION ALL SELECT 'stop_id', 0 UNION ALL SELECT 'departure_time', 0
        UNION ALL SELECT 'arrival_time', count(*) FROM tt_stop_times WHERE arrival_time = ''""",
    "duplicate_profile": """SELECT CAST(count(*) AS BIGINT) AS total_rows, count(DISTINCT (trip_id, stop_sequence)) AS distinct_keys,
        CAST(count(*) - count(DISTINCT (trip_id, stop_sequence)) AS BIGINT) AS duplicate_count FROM tt_stop_times""",
    "format_profile": "SELECT count(*) AS total_rows, count(*) FILTER (arrival_time = '') AS invalid_format_count FROM tt_stop_times",
    "format_samples": "SELECT stop_sequence FROM tt_stop_times WHERE NOT regexp_full_match(stop_sequence, '[0-9]+') ORDER BY 1 LIMIT 5",
    "table_checks": "SELECT t AS table_name, c AS check_name, CAST(f AS BIGINT) AS failing, n AS total, f = 0 AS passed FROM checks",
    "table_verdicts": "SELECT * FROM verd",
    "validation_summary": """SELECT count(*) AS total_tables, count(*) FILTER (overall_passed) AS passed, count(*) FILTER (NOT overall_passed) AS failed, bool_and(overall_passed) AS overall_passed,
        bool_or(critical_failure) AS must_stop, string_agg(table_name, ',' ORDER BY table_name) FILTER (NOT overall_passed) AS failed_tables FROM verd""",
    "referential_orphans": """SELECT 'trips' AS child, 'route_id' AS key, 'routes' AS parent, CAST(0 AS BIGINT) AS orphan_count
        UNION ALL SELECT 'stop_times', 'trip_id', 'trips', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')
        UNION ALL SELECT 'stop_times', 'stop_id', 'stops', count(*) FROM tt_stop_times WHERE stop_id NOT IN (SELECT stopid FROM d_stop)
        UNION ALL SELECT 'routes', 'agency_id', 'agency', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)""",
    "preflight_counts": """SELECT 'trip' AS dimension, count(*) AS row_count FROM d_trip UNION ALL SELECT 'stop', count(*) FROM d_stop UNION ALL SELECT 'route', count(*) FROM d_route""",
    "days_without_pings": "SELECT fulldate AS service_date FROM d_date UNION ALL SELECT service_date FROM days WHERE service_date NOT IN (SELECT d FROM vp_days)",
    "dim_date": """SELECT d.datekey, d.fulldate, d.dayofweek, d.isweekend, h.day IS NOT NULL AS isholiday, d.federalfiscalmonth, d.calendarmonth, d.calendaryear FROM d_date d
        LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 450000) h ON h.day = d.fulldate""",
    "dim_time_usage": """SELECT CASE WHEN m BETWEEN 360 AND 539 THEN 'AM Peak' WHEN m BETWEEN 900 AND 1139 THEN 'PM Peak' ELSE 'Base' END AS periodofday, CAST(m // 60 AS INTEGER) AS hour,
        count(*) AS pings, CAST(max(m % 60) AS INTEGER) AS last_minute, TIMESTAMP '1970-01-01' + to_minutes(min(m)) AS first_time
        FROM (SELECT CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS m FROM events) GROUP BY 1, 2""",
    "dim_agency": f"""SELECT CAST(_key AS INTEGER) AS agencykey, agencyid, agencyname, mode, 'America/Los_Angeles' AS agencytimezone FROM
        {numbered("(SELECT CAST(r_regionkey AS VARCHAR) AS agencyid, r_name AS agencyname, CASE WHEN r_regionkey % 2 = 0 THEN 'BUS' ELSE 'RAIL' END AS mode FROM region)", ['agencyid'])}""",
    "dim_route": f"""SELECT CAST(_key AS INTEGER) AS routekey, agencykey, routeid, routeshortname, routelongname, routetype, 12 AS versionkey FROM
        {numbered("(SELECT 'R' || n_nationkey AS routeid, COALESCE(agencykey, 0) AS agencykey, n_name AS routeshortname, 'Line ' || n_name AS routelongname, CAST(n_nationkey % 4 AS INTEGER) AS routetype FROM nation LEFT JOIN d_agency ON agencykey = n_regionkey + 1)", ['routeid'])}""",
    "dim_stop": f"""SELECT _key AS stopkey, stopid, s_name AS stopname, s_suppkey % 90 + 0.5::DOUBLE AS stoplat, -(s_suppkey % 180 + 0.25::DOUBLE) AS stoplon, locationtype,
        CASE locationtype WHEN 0 THEN 'Stop' WHEN 1 THEN 'Station' WHEN 2 THEN 'Entrance/Exit' WHEN 3 THEN 'Generic Node' ELSE 'Boarding Area' END AS locationtypedesc,
        CAST(NULL AS VARCHAR) AS parentstation, 12 AS versionkey FROM
        {numbered("(SELECT 'S' || s_suppkey AS stopid, *, CAST(s_nationkey % 5 AS INTEGER) AS locationtype FROM supplier)", ['stopid'])}""",
    "dim_service": "SELECT servicekey, serviceid, isspecialevent, 12 AS versionkey FROM k_service",
    "dim_shape": "SELECT shapekey, shapeid, metres AS totaldistancemeters, 12 AS versionkey FROM k_shape",
    "dim_direction": "SELECT directionkey, directionid, CASE WHEN directionid = 0 THEN 'Outbound' ELSE 'Inbound' END AS directionlabel, routekey FROM k_dir",
    "dim_calendar_exception": f"""SELECT _key AS calendarexceptionkey, serviceid, exceptiondate, exceptiontype, 12 AS versionkey FROM
        {numbered("(SELECT DISTINCT service_id AS serviceid, service_date AS exceptiondate, CAST(code AS INTEGER) AS exceptiontype FROM exc)", ['serviceid', 'exceptiondate', 'exceptiontype'])}""",
    "dim_trip": """SELECT k.tripkey, COALESCE(r.routekey, 0) AS routekey, s.servicekey, d.directionkey, COALESCE(h.shapekey, 0) AS shapekey, k.tripid, t.headsign AS tripheadsign, 12 AS versionkey
        FROM tt_trips t JOIN (SELECT * FROM k_trip_old UNION ALL SELECT * FROM k_trip_new) k ON k.tripid = t.trip_id LEFT JOIN d_route r ON r.routeid = t.route_id
        LEFT JOIN k_service s ON s.serviceid = t.service_id LEFT JOIN k_shape h ON h.shapeid = t.shape_id
        LEFT JOIN k_dir d ON d.routekey = COALESCE(r.routekey, 0) AND d.directionid = t.direction_id""",
    "dim_stop_transfer": f"""SELECT _key AS stoptransferkey, fromstopkey, tostopkey, transfertype, w AS mintransfertimeseconds, 12 AS versionkey FROM
        {numbered("(SELECT COALESCE(a.stopkey, 0) AS fromstopkey, COALESCE(b.stopkey, 0) AS tostopkey, CAST(s_nationkey % 4 AS INTEGER) AS transfertype, CAST(min(s_suppkey % 600) AS INTEGER) AS w FROM supplier LEFT JOIN d_stop a ON a.stopid = 'S' || s_suppkey LEFT JOIN d_stop b ON b.stopid = 'S' || s_nationkey GROUP BY 1, 2, 3)", ['fromstopkey', 'tostopkey', 'transfertype'])}""",
    "scheduled_headways": f"""WITH st AS (SELECT trip_id, min({secs('departure_time')}) % 86400 AS dep FROM tt_stop_times WHERE departure_time <> '' GROUP BY 1),
        p AS (SELECT COALESCE(r.routekey, 0) AS routekey, service_date, dep, dep // 60 AS m FROM st JOIN tt_trips t USING (trip_id)
          JOIN active a ON a.service_id = t.service_id LEFT JOIN d_route r ON r.routeid = route_id),
        w AS (SELECT routekey, a AS timewindowstart, b AS timewindowend, dep - lag(dep) OVER (PARTITION BY routekey, service_date, a ORDER BY dep) AS gap
          FROM p JOIN (VALUES (0, 359), (360, 899), (900, 1439)) x(a, b) ON m BETWEEN a AND b),
        g AS (SELECT routekey, timewindowstart, timewindowend, CAST(sum(gap) // count(gap) AS INTEGER) AS scheduledheadwayseconds FROM w GROUP BY 1, 2, 3 HAVING count(gap) > 0)
        SELECT _key AS headwaykey, routekey, timewindowstart, timewindowend, scheduledheadwayseconds, 'TIMETABLE' AS headwaysource FROM
        {numbered('g', ['routekey', 'timewindowstart', 'timewindowend'])}""",
    "dim_keys": "SELECT partkey, p_name, p_brand FROM pk_old UNION ALL SELECT * FROM pk_new",
    "version_scoped_routes": """SELECT COALESCE(r.routekey, 0) AS routekey, COALESCE(a.agencykey, 0) AS agencykey, count(*) AS trips FROM tt_trips t
        LEFT JOIN d_route r ON r.routeid = t.route_id LEFT JOIN d_agency a ON a.agencykey = r.agencykey GROUP BY 1, 2""",
    "feed_failure_windows": "SELECT w AS window_start, ok, fail FROM polls WHERE fail >= 1",
    "outage_windows": """SELECT w AS window_start FROM (SELECT spine.w, row_number() OVER (ORDER BY spine.w) AS rn,
        max(COALESCE(ok, 0)) OVER (ORDER BY spine.w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS best FROM spine LEFT JOIN polls ON polls.w = spine.w) WHERE rn >= 5 AND best < 1""",
    "stream_ping_summary": "SELECT trip_id, service_date, first_ping, last_ping, n AS ping_count FROM pings",
    "stream_positions_latest": """SELECT agency_key, vehicle_id, seen_at AS timestamp_utc, fed AS feed_timestamp_utc, trip_id, CAST(seen_at AS DATE) AS service_date FROM vp
        QUALIFY row_number() OVER (PARTITION BY agency_key, vehicle_id, seen_at ORDER BY fed DESC, trip_id DESC) = 1""",
}

# What passes through files and stored tables must come back the same.
BODIES["validation_report_rows"] = BODIES["table_verdicts"]
BODIES["extract_roundtrip"] = BODIES["missed_trip_rate_by_route"]
BODIES["range_backfill"] = BODIES["service_day_from_timetable"]
BODIES["replace_day_roundtrip"] = "SELECT datekey, count(*) AS n FROM ft WHERE datekey % 2 = 1 OR (datekey % 4 = 0 AND tripstatus = 'MISSED') GROUP BY 1"
BODIES["stream_snapshots_flatten"] = BODIES["flatten_vehicle_positions"]
BODIES["feed_day_staged"] = f"""SELECT *, COALESCE(CAST(timestamp_local AS DATE), DATE '2024-01-30') AS service_date FROM ({BODIES['flatten_vehicle_positions']})
    QUALIFY row_number() OVER (PARTITION BY agency_key, vehicle_id, timestamp_utc ORDER BY feed_timestamp_utc DESC, trip_id DESC NULLS LAST, route_id DESC NULLS LAST,
    latitude DESC, longitude DESC, current_stop_sequence DESC NULLS LAST, current_status DESC) = 1"""
BODIES["timetable_day_staged"] = "SELECT trip_id, route_id, service_id, CAST(direction_id AS VARCHAR) AS direction_id FROM tt_trips"

BODIES["feed_days_neighbouring"] = f"""SELECT * EXCLUDE (landed) FROM (
    SELECT *, COALESCE(CAST(timestamp_local - INTERVAL 3 HOUR AS DATE), landed) AS service_date FROM (
      SELECT *, DATE '2024-01-28' + CAST(extract(hour FROM feed_timestamp_utc) AS INTEGER) % 3 AS landed FROM ({BODIES['flatten_vehicle_positions']})))
    QUALIFY row_number() OVER (PARTITION BY agency_key, vehicle_id, timestamp_utc, service_date ORDER BY feed_timestamp_utc DESC, trip_id DESC NULLS LAST,
    route_id DESC NULLS LAST, latitude DESC, longitude DESC, current_stop_sequence DESC NULLS LAST, current_status DESC) = 1"""
BODIES["timetable_two_days"] = """WITH s AS (SELECT 'S' || s_suppkey AS stopid, s_name AS n, s_suppkey % 2 = 0 AS had, s_suppkey % 6 = 0 AS moved FROM supplier)
    SELECT stopid, n AS stopname, 1 AS versionkey, DATE '2024-01-01' AS validfrom, CASE WHEN moved THEN DATE '2024-01-15' END AS validto, TRUE AS same_key FROM s WHERE had
    UNION ALL SELECT stopid, 'New ' || n, 2, DATE '2024-01-15', NULL, TRUE FROM s WHERE moved
    UNION ALL SELECT stopid, n, 2, DATE '2024-01-15', NULL, NULL FROM s WHERE NOT had"""
BODIES["run_ledger_digest"] = """SELECT CAST(d AS DATE) AS run_date, 'SUCCEEDED' AS run_status, TRUE AS is_new_version, n AS file_count, sha256(d) AS feed_hash,
    'ISSUES' AS headline, CAST(d AS DATE) AS feedstartdate, 'Wayside Transit' AS feedpublishername FROM (VALUES ('2024-01-01', 9), ('2024-01-15', 7)) v(d, n)"""
BODIES["stream_positions_distinct"] = """SELECT DISTINCT agency_key, trip_id, vehicle_id, seen_at AS timestamp_utc, latitude FROM vp"""
BODIES["extract_changed_days"] = BODIES["missed_trip_rate_by_route"]
BODIES["snapshots_compacted"] = BODIES["flatten_vehicle_positions"]
BODIES["staging_drift_days"] = """SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, s_name AS stop_name, CAST(s_nationkey AS VARCHAR) AS zone_hint, DATE '2024-01-01' AS load_date FROM supplier
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, DATE '2024-01-30' FROM part"""
BODIES["stream_stop_merge"] = f"SELECT * EXCLUDE (isofficial) FROM ({BODIES['stop_merge_otp_flags']})"
BODIES["stream_trip_merge"] = BODIES["trip_ping_merge"]
BODIES["stream_failure_windows"] = BODIES["feed_failure_windows"]
BODIES["stream_outage_windows"] = BODIES["outage_windows"]

ORACLES: dict[str, str] = {name: compose(body) for name, body in BODIES.items()}
