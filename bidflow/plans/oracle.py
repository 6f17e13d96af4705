"""The same results in DuckDB SQL over the driver's tables: name -> SQL."""

from __future__ import annotations

# The auction model over the driver's tables.
VIEWS = {
    "auctions": """SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) // 10 AS initial_bid,
        CAST(round(o_totalprice * 100) AS BIGINT) // 10 AS reserve, o_orderdate AS date_time,
        o_orderdate + INTERVAL 365 DAY AS expires, o_custkey AS seller,
        9 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS category FROM orders""",
    "bids": """SELECT l_orderkey AS auction, l_suppkey AS bidder, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
        l_shipdate AS date_time FROM lineitem""",
    "people": """SELECT c_custkey AS id, c_name AS name, n_name AS city,
        ['AZ', 'CA', 'ID', 'OR', 'WA', 'WY'][c_nationkey % 6 + 1] AS state,
        TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2400 AS INTEGER)) AS date_time
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "clicks": """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS auction, user_id AS bidder,
        CAST(round(value * 100) AS BIGINT) AS price, ts AS date_time FROM events""",
    "closed": """SELECT id, seller, category, initial_bid, reserve, opened AS date_time, expires, bidder, price, bid_time
        FROM (SELECT a.id, a.seller, a.category, a.initial_bid, a.reserve, a.date_time AS opened, a.expires, b.bidder,
            b.price, b.date_time AS bid_time,
            row_number() OVER (PARTITION BY a.id ORDER BY b.price DESC, b.date_time, b.bidder) AS rn
            FROM bids b JOIN auctions a ON b.auction = a.id
            WHERE a.date_time <= b.date_time AND b.date_time < a.expires AND b.price >= a.reserve) WHERE rn = 1""",
    "slots": """SELECT date_trunc('hour', date_time) + INTERVAL 1 HOUR AS slot_end, auction, count(*) AS bids
        FROM clicks GROUP BY ALL""",
    "sliding": """SELECT slot_end + to_hours(CAST(i AS INTEGER)) AS window_end, auction, CAST(sum(bids) AS BIGINT) AS bids
        FROM slots, range(24) r(i) GROUP BY ALL""",
    "routed": """SELECT *, user_id % 8 AS bin, CASE
        WHEN ts < TIMESTAMP '2024-01-10' THEN user_id % 8 % 4
        WHEN ts < TIMESTAMP '2024-01-20' THEN CASE user_id % 8 WHEN 1 THEN 0 WHEN 5 THEN 2 ELSE user_id % 8 % 4 END
        ELSE (user_id % 8 + 1) % 4 END AS worker FROM events""",
    "routed_clicks": """SELECT *, CASE
        WHEN date_time < TIMESTAMP '2024-01-10' THEN auction % 8 % 4
        WHEN date_time < TIMESTAMP '2024-01-20' THEN CASE auction % 8 WHEN 1 THEN 0 WHEN 5 THEN 2 ELSE auction % 8 % 4 END
        ELSE (auction % 8 + 1) % 4 END AS worker FROM clicks""",
    "control": """SELECT t AS ts, t AS sequence, CAST(1 AS BIGINT) AS count, CAST(0 AS BIGINT) AS msg, 'M' AS kind,
            b AS pos, b AS bin, (auction + b) % 4 AS worker
            FROM (SELECT *, epoch_us(date_time) AS t FROM clicks), range(8) r(b)
            WHERE event_type = 'signup'
        UNION ALL SELECT t, t, 2, p, 'D', p, CASE p WHEN 0 THEN bidder % 8 ELSE bidder // 8 % 8 END,
            CASE p WHEN 0 THEN auction % 4 ELSE auction // 4 % 4 END
            FROM (SELECT *, epoch_us(date_time) AS t FROM clicks), range(2) r(p) WHERE event_type = 'error'""",
    "history": """SELECT bin, worker, valid_from, lead(valid_from) OVER (PARTITION BY bin ORDER BY valid_from NULLS FIRST) AS valid_to
        FROM (SELECT b AS bin, b % 4 AS worker, CAST(NULL AS BIGINT) AS valid_from FROM range(8) r(b)
        UNION ALL SELECT bin, arg_max(worker, msg), ts FROM control GROUP BY bin, ts)""",
    "lines": """SELECT 'user=' || bidder || '+type=' || event_type || '+even=' || CASE WHEN bidder % 2 = 0 THEN 'True' ELSE 'False' END
        AS run, * FROM (SELECT *, epoch_us(date_time) * 1000 AS ns FROM clicks)""",
    "finished": "SELECT * FROM lines WHERE run IN (SELECT run FROM lines WHERE price > 20000)",
    "bucketed": """SELECT *, CASE WHEN latency < 16 THEN latency ELSE (CAST(1 AS BIGINT) << e) + (((latency >> (e - 4)) & 15) << (e - 4)) END
        AS bucket FROM (SELECT event_id, event_type AS run, date_time, price AS latency, auction, length(bin(price)) - 1 AS e FROM clicks)""",
    "ccdf": """SELECT run, bucket, CAST(sum(samples) OVER (PARTITION BY run ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE)
        / CAST(sum(samples) OVER (PARTITION BY run) AS DOUBLE) AS share, samples
        FROM (SELECT run, bucket, count(*) AS samples FROM bucketed GROUP BY ALL)""",
    "ranked": """SELECT run, CAST(epoch_us(date_time) // 86400000000 AS BIGINT) AS bucket, latency,
        row_number() OVER (PARTITION BY run, epoch_us(date_time) // 86400000000 ORDER BY latency) AS rn,
        count(*) OVER (PARTITION BY run, epoch_us(date_time) // 86400000000) AS n FROM bucketed""",
    "timeline": "SELECT run, bucket, " + ", ".join(
        f"max(CASE WHEN rn = (n * {level} + 999) // 1000 THEN latency END) AS {name}"
        for name, level in [("p25", 250), ("p50", 500), ("p75", 750), ("p95", 950), ("p99", 990), ("p999", 999), ("pmax", 1000)]
    ) + " FROM ranked GROUP BY ALL",
}

# Views each view reads.
USES = {
    "closed": ["auctions", "bids"], "slots": ["clicks"], "sliding": ["slots"], "routed_clicks": ["clicks"],
    "control": ["clicks"], "history": ["control"], "lines": ["clicks"], "finished": ["lines"], "bucketed": ["clicks"],
    "ccdf": ["bucketed"], "ranked": ["bucketed"], "timeline": ["ranked"],
}


def _closure(names):
    ordered = []
    for name in names:
        for needed in _closure(USES.get(name, [])) + [name]:
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def sql(body: str, *views: str) -> str:
    if not views:
        return body
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in _closure(views))
    return f"WITH {heads} {body}"


def _branches():
    return sql(
        "SELECT 'people' AS branch, count(*) AS rows, CAST(sum(id) AS BIGINT) AS total FROM people "
        "UNION ALL SELECT 'auctions', count(*), CAST(sum(seller) AS BIGINT) FROM auctions "
        "UNION ALL SELECT 'bids', count(*), CAST(sum(price) AS BIGINT) FROM bids",
        "people", "auctions", "bids",
    )


def _q8(people_view):
    return sql(
        f"SELECT a.seller FROM auctions a JOIN {people_view} p ON a.seller = p.id "
        "WHERE a.date_time >= p.date_time AND a.date_time < p.date_time + INTERVAL 90 DAY",
        "auctions", "people",
    )


_LEVEL_NAMES = ["p25", "p50", "p75", "p95", "p99", "p999", "pmax"]

_INCIDENT = """SELECT coalesce(o.run, r.run) AS run, coalesce(duration, 0) AS duration, {maxima},
    coalesce(reported_sum, 0) AS reported_sum, coalesce(reported_max, 0) AS reported_max
FROM (SELECT run, CAST(sum(bucket - prev) AS BIGINT) AS duration, {inner_maxima} FROM (
    SELECT s.*, max(CASE WHEN tr IS NOT NULL THEN r END) OVER w AS last_taken, max(CASE WHEN NOT slow THEN r END) OVER w AS last_calm
    FROM (SELECT n.*, k.tr, n.p50 > 2 * b.baseline AS slow FROM numbered n
        LEFT JOIN taken k ON k.run = n.run AND k.tr = n.r
        JOIN (SELECT run, min(bucket) AS baseline FROM ccdf WHERE share <= 0.7 GROUP BY run) b ON b.run = n.run) s
    WINDOW w AS (PARTITION BY run ORDER BY r ROWS UNBOUNDED PRECEDING))
    WHERE slow AND last_taken > coalesce(last_calm, -1) GROUP BY run) o
FULL JOIN (SELECT 'user=' || bidder AS run, CAST(sum(price) AS BIGINT) AS reported_sum, max(price) AS reported_max FROM clicks
    WHERE event_type = 'purchase' GROUP BY ALL) r ON o.run = r.run
WHERE coalesce(duration, 0) > 0 OR coalesce(reported_sum, 0) > 0"""


def _incident():
    heads = sql("", "timeline", "ccdf").rstrip().replace("event_type AS run", "'user=' || bidder AS run")
    steps = """, numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY bucket) - 1 AS r,
        lag(bucket) OVER (PARTITION BY run ORDER BY bucket) AS prev FROM timeline),
    step AS (SELECT run, bucket - prev AS width FROM numbered WHERE r = 1),
    due AS (SELECT run, t + width AS due_at, row_number() OVER (PARTITION BY run ORDER BY t) - 1 AS j FROM step
        JOIN (SELECT 'user=' || bidder AS run, CAST(epoch_us(date_time) // 86400000000 AS BIGINT) AS t FROM clicks
            WHERE event_type = 'signup') USING (run)),
    elig AS (SELECT run, j, (SELECT CASE WHEN min(n.r) < 1 THEN 1 ELSE min(n.r) END FROM numbered n WHERE n.run = due.run AND n.bucket >= due.due_at) AS e FROM due),
    taken AS (SELECT run, j + max(e - j) OVER (PARTITION BY run ORDER BY j ROWS UNBOUNDED PRECEDING) AS tr FROM elig WHERE e IS NOT NULL) """
    return heads + steps + _INCIDENT.format(
        maxima=", ".join(f"coalesce(max_{c}, 0) AS max_{c}" for c in _LEVEL_NAMES),
        inner_maxima=", ".join(f"max({c}) AS max_{c}" for c in _LEVEL_NAMES),
    )


ORACLE: dict[str, str] = {
    "demux_events": _branches(),
    "event_log": _branches(),
    "auction_views": sql(
        "SELECT 'person' AS kind, id, state AS label, date_time, CAST(NULL AS BIGINT) AS amount FROM people "
        "UNION ALL SELECT 'auction', id, CAST(category AS VARCHAR), expires, reserve FROM auctions "
        "UNION ALL SELECT 'bid', auction, CAST(bidder AS VARCHAR), date_time, price FROM bids",
        "people", "auctions", "bids",
    ),
    "control_log_scan": sql("SELECT * FROM control", "control"),
    "result_log_scan": sql(
        """SELECT run, CASE event_type WHEN 'click' THEN 'latency_ccdf' WHEN 'view' THEN 'statm_RSS' WHEN 'purchase' THEN 'migration_done'
            WHEN 'signup' THEN 'control_time' ELSE 'summary_timeline' END AS tag,
        CAST(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 8 END AS BIGINT) AS n_fields,
        CASE event_type WHEN 'click' THEN price ELSE ns END AS first_field,
        CASE event_type WHEN 'click' THEN auction WHEN 'view' THEN price * 4096 WHEN 'purchase' THEN price WHEN 'signup' THEN ns
            ELSE price + 6 END AS last_field, bidder AS user, bidder % 2 = 0 AS even FROM finished""",
        "finished",
    ),
    "q0": "SELECT * FROM events",
    "q1": sql("SELECT auction, bidder, price * 89 // 100 AS price, date_time FROM bids", "bids"),
    "q2": sql("SELECT auction, price FROM bids WHERE auction % 123 = 0", "bids"),
    "event_time_key": sql(
        "SELECT 'Person' AS type, date_time AS time, id AS key FROM people UNION ALL SELECT 'Auction', date_time, id FROM auctions "
        "UNION ALL SELECT 'Bid', date_time, auction FROM bids",
        "people", "auctions", "bids",
    ),
    "slot_end": "SELECT event_id, (epoch_us(ts) // 3600000000 + 1) * 3600000000 AS end_us, "
    "date_trunc('hour', ts) + INTERVAL 1 HOUR AS slot_end FROM events",
    "time_shift": sql("SELECT id, expires AS time, CAST(1 AS BIGINT) AS diff FROM auctions", "auctions"),
    "bin_of_key": "SELECT event_id, user_id, user_id % 8 AS bin FROM events",
    "histogram_bucket": sql("SELECT event_id, latency, bucket FROM bucketed", "bucketed"),
    "q3": sql(
        "SELECT name, city, state, a.id AS auction FROM auctions a JOIN people p ON a.seller = p.id "
        "WHERE category = 10 AND state IN ('OR', 'ID', 'CA')",
        "auctions", "people",
    ),
    "q3_latest": sql(
        """SELECT name, city, state, a.id AS auction FROM (SELECT *, lead(date_time) OVER (PARTITION BY seller ORDER BY date_time, id) AS nxt
            FROM auctions WHERE category = 10) a JOIN people p ON a.seller = p.id
        WHERE state IN ('OR', 'ID', 'CA') AND (a.date_time > p.date_time OR nxt IS NULL OR nxt > p.date_time)""",
        "auctions", "people",
    ),
    "q3_semijoin": sql(
        "SELECT id, name, state, city FROM people WHERE state IN ('OR', 'ID', 'CA') "
        "AND id IN (SELECT seller FROM auctions WHERE category = 10)",
        "auctions", "people",
    ),
    "q3_semijoin_as_written": sql(
        "SELECT id, name, state, city FROM people WHERE state IN ('OR', 'ID', 'CA') "
        "AND id IN (SELECT id FROM auctions WHERE category = 10)",
        "auctions", "people",
    ),
    "latest_match_join": """WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
        r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
        b AS (SELECT r.*, l.event_id AS le, l.ts AS lt FROM r ASOF LEFT JOIN l ON r.user_id = l.user_id AND r.ts >= l.ts),
        f AS (SELECT user_id, min_by(event_id, ts) AS fe, min(ts) AS ft FROM l GROUP BY user_id)
        SELECT b.user_id, coalesce(le, fe) AS left_event_id, b.event_id AS right_event_id, coalesce(lt, ft) AS left_ts, b.ts AS right_ts
        FROM b JOIN f ON b.user_id = f.user_id""",
    "closed_auctions": sql("SELECT * FROM closed", "closed"),
    "closed_auctions_no_lower_bound": sql("SELECT * FROM closed", "closed").replace("a.date_time <= b.date_time AND ", ""),
    "q8": _q8("people"),
    "q8_as_written": _q8("auctions"),
    "q8_changelog": sql(
        """, pairs AS (SELECT p.id, p.name, a.reserve, p.date_time AS pt, a.date_time AS opened_at FROM auctions a JOIN people p ON a.seller = p.id)
        SELECT id, name, reserve, time, CAST(sum(diff) AS BIGINT) AS diff FROM (
            SELECT id, name, reserve, greatest(pt, opened_at) AS time, 1 AS diff FROM pairs
            UNION ALL SELECT id, name, reserve, greatest(pt + INTERVAL 90 DAY, opened_at), -1 FROM pairs)
        GROUP BY ALL HAVING sum(diff) <> 0""",
        "auctions", "people",
    ),
    "distribute": sql("SELECT event_id, ts, user_id, bin, worker FROM routed", "routed"),
    "q0_routed": sql("SELECT worker, user_id AS key, event_id, event_type, value FROM routed", "routed"),
    "q1_routed": sql("SELECT worker, auction AS key, event_id, price * 89 // 100 AS price FROM routed_clicks", "routed_clicks"),
    "q2_routed": sql("SELECT auction % 8 % 4 AS worker, auction AS key, price FROM bids WHERE auction % 123 = 0", "bids"),
    "q4": sql("SELECT category, CAST(sum(price) // count(*) AS BIGINT) AS avg_price FROM closed GROUP BY category", "closed"),
    "q4_sum_count": sql(
        "SELECT category, CAST(sum(price) AS BIGINT) AS total, count(*) AS auctions FROM closed GROUP BY category", "closed"
    ),
    "q5": sql("SELECT window_end, arg_max(auction, bids * 1000000 + auction) AS auction, max(bids) AS bids FROM sliding GROUP BY ALL", "sliding"),
    "q5_local": sql(
        "SELECT window_end, auction % 4 AS peer, arg_max(auction, bids * 1000000 + auction) AS auction, max(bids) AS bids "
        "FROM sliding GROUP BY window_end, sliding.auction % 4",
        "sliding",
    ),
    "q7": sql("SELECT date_trunc('hour', date_time) + INTERVAL 1 HOUR AS window_end, max(price) AS price FROM clicks GROUP BY 1", "clicks"),
    "q7_argmax": sql(
        """SELECT window_end, auction, price, bidder FROM (SELECT *, date_trunc('hour', date_time) + INTERVAL 1 HOUR AS window_end,
        row_number() OVER (PARTITION BY date_trunc('hour', date_time) ORDER BY price DESC, date_time, auction, bidder) AS rn FROM clicks)
        WHERE rn = 1""",
        "clicks",
    ),
    "word_count": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS key, count(*) AS total FROM events GROUP BY 1",
    "multiset_top1": sql(
        "SELECT bidder, price, event_id FROM (SELECT *, row_number() OVER (PARTITION BY bidder ORDER BY price DESC, event_id) AS rn "
        "FROM clicks) WHERE rn = 1",
        "clicks",
    ),
    "consolidate": sql(
        """SELECT auction, time, CAST(sum(diff) AS BIGINT) AS diff FROM (
        SELECT auction, date_trunc('hour', date_time) AS time, 1 AS diff FROM clicks
        UNION ALL SELECT auction, date_trunc('hour', date_time + INTERVAL 20 MINUTE), -1 FROM clicks)
        GROUP BY ALL HAVING sum(diff) <> 0""",
        "clicks",
    ),
    "bin_load": sql("SELECT worker, bin, count(*) AS rows, count(DISTINCT user_id) AS keys FROM routed GROUP BY ALL", "routed"),
    "q4_running": sql(
        """SELECT id, category, expires, CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS avg_price FROM closed
        WINDOW w AS (PARTITION BY category ORDER BY expires, id ROWS UNBOUNDED PRECEDING)""",
        "closed",
    ),
    "q6": sql(
        """SELECT id, bidder, expires, CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS avg_price FROM closed
        WINDOW w AS (PARTITION BY bidder ORDER BY expires, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
        "closed",
    ),
    "q6_seller": sql(
        """SELECT seller, CAST(sum(price) // count(*) AS BIGINT) AS avg_price FROM (SELECT *, row_number() OVER
        (PARTITION BY seller ORDER BY expires DESC, price DESC) AS rn FROM (SELECT DISTINCT seller, expires, price FROM closed))
        WHERE rn <= 10 GROUP BY seller""",
        "closed",
    ),
    "word_count_running": """SELECT ts, event_id, key, count(*) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total
        FROM (SELECT ts, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS key FROM events)""",
    "control_history": sql("SELECT bin, worker, valid_from, valid_to FROM history", "history"),
    "control_violations": sql(
        """SELECT * EXCLUDE (least) FROM (SELECT epoch_us(date_time) // 3600000000 AS ts, count(*) AS messages,
        max(1 + auction % 20) AS expected, min(1 + auction % 20) AS least, min(price // 10000) AS min_sequence,
        max(price // 10000) AS max_sequence FROM clicks GROUP BY 1)
        WHERE messages <> expected OR least <> expected OR min_sequence <> max_sequence""",
        "clicks",
    ),
    "moved_bins": sql(
        """, recs AS (SELECT user_id % 8 AS bin, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts) AS rn FROM events),
        steps AS (SELECT bin, valid_from AS ts, worker AS new_worker, lag(worker) OVER (PARTITION BY bin ORDER BY valid_from NULLS FIRST)
            AS old_worker FROM history)
        SELECT s.ts, s.bin, s.old_worker, s.new_worker, coalesce(r.rn, 0) AS rows FROM (SELECT * FROM steps
            WHERE old_worker IS NOT NULL AND old_worker <> new_worker) s ASOF LEFT JOIN recs r ON s.bin = r.bin AND s.ts > r.t""",
        "history",
    ),
    "time_ordered": "SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events",
    "multiset_concat": sql(
        """SELECT key, event_id, CAST(sum(diff) AS BIGINT) AS diff FROM (SELECT auction AS key, event_id, 1 AS diff FROM clicks
        UNION ALL SELECT bidder, event_id, -1 FROM clicks) GROUP BY key, event_id HAVING sum(diff) <> 0""",
        "clicks",
    ),
    "multiset_negate": sql("SELECT auction AS key, event_id, CAST(-1 AS BIGINT) AS diff FROM clicks", "clicks"),
    "sliding_changelog": sql(
        """SELECT auction, time, CAST(sum(diff) AS BIGINT) AS diff FROM (SELECT auction, slot_end AS time, bids AS diff FROM slots
        UNION ALL SELECT auction, slot_end + INTERVAL 24 HOUR, -bids FROM slots) GROUP BY ALL HAVING sum(diff) <> 0""",
        "slots",
    ),
    "verify_equal": sql(
        """SELECT key, n_correct, n_output FROM (SELECT auction AS key, count(*) AS n_correct,
        count(CASE WHEN event_type <> 'purchase' THEN 1 END) AS n_output FROM clicks GROUP BY 1) WHERE n_correct <> n_output""",
        "clicks",
    ),
    "verify_word_counts": "SELECT CAST(0 AS BIGINT) AS key, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS n_correct, "
    "CAST(0 AS BIGINT) AS n_output FROM events WHERE false",
    "latency_ccdf": sql("SELECT * FROM ccdf", "ccdf"),
    "count_ccdf": sql(
        """, sizes AS (SELECT event_type AS run, count(*) AS size FROM clicks GROUP BY event_type, date_trunc('hour', date_time)),
        b AS (SELECT run, CASE WHEN size < 16 THEN size ELSE (CAST(1 AS BIGINT) << (length(bin(size)) - 1)) +
            (((size >> (length(bin(size)) - 5)) & 15) << (length(bin(size)) - 5)) END AS bucket FROM sizes)
        SELECT run, bucket, CAST(sum(samples) OVER (PARTITION BY run ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE)
        / CAST(sum(samples) OVER (PARTITION BY run) AS DOUBLE) AS share, samples
        FROM (SELECT run, bucket, count(*) AS samples FROM b GROUP BY ALL)""",
        "clicks",
    ),
    "latency_timeline": sql("SELECT * FROM timeline", "timeline"),
    "memory_timeline": sql(
        "SELECT run, CAST(ns AS DOUBLE) / 1e9 AS seconds, price * 4096 AS bytes FROM finished WHERE event_type = 'view'", "finished"
    ),
    "ccdf_table": sql(
        """SELECT run, min(CASE WHEN share <= 0.1 THEN bucket END) AS p90, min(CASE WHEN share <= 0.01 THEN bucket END) AS p99,
        min(CASE WHEN share <= 0.001 THEN bucket END) AS p999, max(bucket) AS pmax FROM ccdf GROUP BY run""",
        "ccdf",
    ),
    "incident_breakdown": _incident(),
    "experiment_params": sql(
        """, params AS (SELECT DISTINCT 'user' AS param, CAST(bidder AS VARCHAR) AS value, 'BIGINT' AS type FROM finished
        UNION SELECT DISTINCT 'type', event_type, 'STRING' FROM finished
        UNION SELECT DISTINCT 'even', CASE WHEN bidder % 2 = 0 THEN 'True' ELSE 'False' END, 'BOOLEAN' FROM finished)
        SELECT param, value, type, count(*) OVER (PARTITION BY param) AS n_values,
        count(*) OVER (PARTITION BY param) = 1 AS is_constant FROM params""",
        "finished",
    ),
    "experiment_filter": sql(
        "SELECT DISTINCT run FROM finished WHERE event_type = 'click' AND bidder % 2 = 0", "finished"
    ),
    "pivot_groups": sql(
        "SELECT bidder, "
        + ", ".join(
            f"CAST(sum(CASE WHEN event_type = '{k}' THEN price END) AS BIGINT) AS {k}"
            for k in ["click", "error", "purchase", "signup", "view"]
        )
        + " FROM clicks GROUP BY bidder",
        "clicks",
    ),
}

_EVENTS = "SELECT event_id, event_type, auction, bidder AS user_id, price, epoch_us(date_time) AS us FROM clicks"

ORACLE |= {
    "stream_q1": ORACLE["q1"],
    "stream_q3": ORACLE["q3"],
    "stream_q5": ORACLE["q5"],
    "stream_q7": ORACLE["q7"],
    "stream_q8": ORACLE["q8"],
    "stream_closed_auctions": ORACLE["closed_auctions"],
    "stream_q4_running": ORACLE["q4_running"].replace("SELECT id, category, expires,", "SELECT id, category,"),
    "stream_q6": ORACLE["q6"].replace("SELECT id, bidder, expires,", "SELECT id, bidder,"),
    "state_machine": sql(
        f"""SELECT user_id, event_id, CAST(sum(price) OVER (PARTITION BY user_id, part ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)
            AS BIGINT) AS total FROM (SELECT *, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id
            ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM ({_EVENTS}))""",
        "clicks",
    ),
    "state_scan": sql(
        f"""SELECT user_id, CAST(sum(price) AS BIGINT) AS total FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN us END)
            OVER (PARTITION BY user_id) AS last_signup FROM ({_EVENTS})) WHERE last_signup IS NULL OR us > last_signup GROUP BY user_id""",
        "clicks",
    ),
    "stateful_unary": sql(
        f"SELECT auction, event_id, row_number() OVER (PARTITION BY auction ORDER BY us, event_id) AS position FROM ({_EVENTS})",
        "clicks",
    ),
    "stateful_unary_input": sql(
        f"""SELECT auction, slot_end_us, CAST(sum(n) OVER (PARTITION BY auction ORDER BY slot_end_us ROWS UNBOUNDED PRECEDING) AS BIGINT)
            AS bids FROM (SELECT auction, (us // 3600000000 + 1) * 3600000000 AS slot_end_us, count(*) AS n FROM ({_EVENTS}) GROUP BY ALL)""",
        "clicks",
    ),
    "stateful_binary": ORACLE["latest_match_join"].replace(
        ", coalesce(lt, ft) AS left_ts, b.ts AS right_ts", ""
    ),
    "stateful_binary_input": sql(
        f"""SELECT v.user_id, v.event_id, count(p.us) AS fresh FROM ({_EVENTS}) v LEFT JOIN ({_EVENTS}) p
            ON v.user_id = p.user_id AND p.event_type = 'purchase' AND p.us <= v.us AND v.us < p.us + 3600000000
            WHERE v.event_type = 'view' GROUP BY ALL""",
        "clicks",
    ),
    "stream_distribute": sql(
        f"""SELECT event_id, e.user_id, us, bin, worker, valid_from AS valid_from_us FROM ({_EVENTS}) e JOIN history ON bin = e.user_id % 8
            AND (valid_from IS NULL OR valid_from <= us) AND (valid_to IS NULL OR us < valid_to)""",
        "history",
    ),
    "stream_event_timers_cancelled": sql(
        f"""SELECT user_id, event_id, us + price * 1000000 AS due_us, row_number() OVER (PARTITION BY user_id
            ORDER BY us + price * 1000000, event_id) AS position FROM ({_EVENTS}) e WHERE NOT EXISTS (SELECT 1 FROM ({_EVENTS}) s
            WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.us > e.us AND s.us < e.us + e.price * 1000000)""",
        "clicks",
    ),
    "event_timers": sql(
        f"""SELECT user_id, event_id, us + price * 1000000 AS due_us, row_number() OVER (PARTITION BY user_id
            ORDER BY us + price * 1000000, event_id) AS position FROM ({_EVENTS})""",
        "clicks",
    ),
}
ORACLE["stream_event_timers"] = ORACLE["event_timers"]
