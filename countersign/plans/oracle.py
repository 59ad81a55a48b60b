"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

_TX = """
tx AS (
  SELECT o_orderkey AS row_idx, strftime(o_orderdate, '%Y-%m-%d') AS date,
         strftime(o_orderdate, '%Y-%m-%d') || '-' || CAST(o_orderkey AS VARCHAR) AS tx_id,
         o_totalprice AS amount, o_orderpriority AS description
  FROM orders)"""

_SUB = """
sub AS (
  SELECT 7 * (event_id // 4) AS row_idx,
         CASE WHEN user_id % 5 = 4 THEN 'guest' WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END
           AS reviewer,
         CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'Split'
           WHEN 'signup' THEN 'Other' WHEN 'error' THEN 'Unsure' END AS assignment,
         ts, event_id AS seq
  FROM events)"""

_LATEST = """
latest AS (
  SELECT row_idx, reviewer, assignment, ts, seq
  FROM (SELECT *, row_number() OVER (PARTITION BY row_idx, reviewer ORDER BY ts DESC, seq DESC)
          AS place FROM sub) AS numbered
  WHERE place = 1)"""

_TWO = "printf('%.2f', o_totalprice)"
_RAW = f"""
raw AS (
  SELECT o_orderkey AS row_key,
         strftime(o_orderdate, '%Y') AS upload,
         strftime(o_orderdate, '%Y-%m-%d') AS date,
         CASE o_orderkey % 8
           WHEN 0 THEN ''
           WHEN 1 THEN {_TWO} || 'abc'
           WHEN 2 THEN '$' || {_TWO}
           WHEN 3 THEN left({_TWO}, 1) || ',' || substr({_TWO}, 2)
           WHEN 4 THEN ' ' || {_TWO}
           WHEN 5 THEN replace({_TWO}, '.', '') || 'e-2'
           ELSE {_TWO} END AS amount_text,
         CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS description,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Unknown' END AS owner,
         CASE o_orderkey % 8
           WHEN 0 THEN 0.0
           WHEN 2 THEN 0.0
           WHEN 3 THEN CAST(left({_TWO}, 1) AS DOUBLE)
           ELSE CAST({_TWO} AS DOUBLE) END AS amount
  FROM orders)"""

# Latest labels with every user as a reviewer.
_BY_USER = """
given AS (
  SELECT 7 * (event_id // 4) AS row_idx, 'u' || CAST(user_id AS VARCHAR) AS reviewer,
         arg_max(event_type, ts) AS label
  FROM events GROUP BY ALL),
grouped AS (
  SELECT row_idx, count(*) AS given, count(DISTINCT label) > 1 AS differ FROM given GROUP BY row_idx)"""

# One row per transaction with both labels, by way of distinct counts.
_JUDGED = """
judged AS (
  SELECT tx.row_idx, tx.tx_id, tx.amount, tx.description,
         max(CASE WHEN l.reviewer = 'A' THEN l.assignment END) AS label_a,
         max(CASE WHEN l.reviewer = 'B' THEN l.assignment END) AS label_b,
         count(DISTINCT l.reviewer) = 2 AS submitted,
         count(l.assignment) > 1 AND count(DISTINCT l.assignment) > 1 AS differs
  FROM tx LEFT JOIN latest AS l
    ON l.row_idx = tx.row_idx AND l.reviewer IN ('A', 'B') AND l.assignment IS NOT NULL
  GROUP BY tx.row_idx, tx.tx_id, tx.amount, tx.description)"""

# The review at the last closed and the first open moment of the gate.
_MOMENTS = """
moments(as_of, is_open) AS (
  VALUES ('2024-01-30T23:59:59.000Z', false), ('2024-01-31T00:00:00.000Z', true)),
gated AS (
  SELECT m.as_of, m.is_open, j.*, m.is_open AND j.differs AS conflict
  FROM judged AS j, moments AS m)"""

_STATUS = """CASE WHEN {0} THEN 'CONFLICT' WHEN submitted THEN 'ASSIGNED' ELSE 'PENDING' END"""
_STATS = """
stats AS (
  SELECT count(*) AS total,
         count(*) FILTER (WHERE submitted AND NOT differs) AS assigned,
         count(*) FILTER (WHERE differs) AS conflicts,
         count(*) FILTER (WHERE NOT submitted OR differs) AS pending
  FROM judged)"""

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_FULL = "WITH" + ",".join([_TX, _SUB, _LATEST, _JUDGED])
_LABELS = "WITH" + ",".join([_SUB, _LATEST])
_ROWS = "WITH" + _RAW
_MINE = """
mine AS (SELECT row_idx, assignment FROM latest WHERE reviewer = 'A')"""
_OWN = "WITH" + ",".join([_TX, _SUB, _LATEST, _MINE])
_HOURS = """(epoch_ms(TIMESTAMP '2001-08-01 12:00:00') - epoch_ms(o_orderdate))
  / CAST(3600000 AS DOUBLE)"""
_LATEST_ROWS = f"""{_LABELS}
SELECT row_idx, reviewer, assignment, {_ISO.format('ts')} AS stamp, seq FROM latest"""
_RAW_TEXTS = """nullif(date, '') AS date, nullif(amount_text, '') AS amount_text,
       nullif(description, '') AS description, nullif(owner, '') AS owner"""
_PLACED = f"""{_ROWS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY upload ORDER BY row_key) - 1 AS row_idx
  FROM raw WHERE amount_text <> '')"""

ORACLE: dict[str, str] = {
    "csv_scan": f"{_ROWS} SELECT {_RAW_TEXTS} FROM raw",
    "csv_text_parse": f"""{_ROWS}
SELECT row_key, nullif(date, '') AS date, nullif(amount_text, '') AS amount_text,
       CASE WHEN row_key % 13 = 0 THEN 'two' || chr(10) || 'lines' ELSE nullif(description, '') END
         AS description, nullif(owner, '') AS owner FROM raw
UNION ALL
SELECT row_key, 'Date', 'Amount', 'Description', 'Owner' FROM raw WHERE row_key % 17 = 0""",
    "csv_quoted_blocks": rf"""{_ROWS}
SELECT upload, date, nullif(amount_text, '') AS amount_text, nullif(CASE row_key % 6
         WHEN 0 THEN description || chr(10) || chr(10) || 'last line'
         WHEN 2 THEN 'said "yes",' || chr(10) || description
         WHEN 4 THEN description || repeat(chr(10) || 'more, "quoted"', row_key % 7) || '.'
         ELSE description END, '') AS description, nullif(owner, '') AS owner
FROM raw""",
    "emptied_snapshot": f"""{_ROWS}
SELECT CAST(0 AS BIGINT) AS current_rows, count(*) FILTER (amount_text <> '') AS stored_rows,
       count(DISTINCT upload) + 1 AS uploads
FROM raw""",
    "published_snapshot": f"""WITH {_TX}
SELECT 'before' AS reader, tx_id, amount FROM tx WHERE row_idx % 2 = 0 UNION ALL
SELECT 'after' AS reader, tx_id, amount FROM tx WHERE row_idx % 3 = 0""",
    "state_repeated_keys": """
SELECT CAST(o_orderkey AS VARCHAR) AS tx_key, reviewer, o_orderpriority AS assignment
FROM orders, (VALUES ('A'), ('B')) AS r(reviewer)""",
    "large_roster": f"""WITH {_TX}, {_BY_USER}
SELECT tx_id, coalesce(given, 0) AS given, false AS submitted, coalesce(differ, false) AS conflict,
       CASE WHEN differ THEN 'CONFLICT' ELSE 'PENDING' END AS status
FROM tx LEFT JOIN grouped USING (row_idx)""",
    "large_roster_remaining": f"""WITH {_TX}, {_BY_USER}
SELECT reviewer, (SELECT count(*) FROM tx) - count(done.row_idx) AS remaining
FROM (SELECT DISTINCT reviewer FROM given) AS roster
LEFT JOIN (SELECT reviewer, row_idx FROM given JOIN grouped USING (row_idx) JOIN tx USING (row_idx)
           WHERE NOT differ) AS done USING (reviewer)
GROUP BY reviewer""",
    "live_gate": f"""WITH {_TX}, {_SUB}, {_LATEST}, {_JUDGED},
ticks AS (SELECT unnest([TIMESTAMP '1997-12-31 23:59:59', TIMESTAMP '1998-01-01', TIMESTAMP '2002-01-01']) AS tick)
SELECT tx_id, label_a, label_b, strftime(min(tick), '%Y-%m-%dT%H:%M:%S.000Z') AS opened_at
FROM judged JOIN tx USING (row_idx, tx_id), ticks
WHERE differs AND tick >= CAST(date AS TIMESTAMP) + INTERVAL 24 HOUR
GROUP BY tx_id, label_a, label_b""",
    "csv_provenance": f"""{_ROWS}
SELECT upload, CAST(1 AS BIGINT) AS csv_files, count(*) AS transactions FROM raw GROUP BY upload""",
    "row_position": f"{_PLACED} SELECT upload, row_idx, date, amount_text FROM placed",
    "daily_pickup": f"""{_PLACED},
again AS (
  SELECT upload, 1 AS round, row_number() OVER (PARTITION BY upload ORDER BY row_key) - 1 AS row_idx,
         date, amount, description
  FROM raw WHERE amount_text <> '' AND row_key % 2 = 0),
taken AS (
  SELECT upload, 0 AS round, row_idx, date, amount, description FROM placed UNION ALL SELECT * FROM again)
SELECT upload, round, row_idx, date || '-' || CAST(row_idx AS VARCHAR) AS tx_id, date, amount,
       coalesce(nullif(description, ''), 'Unknown') AS description
FROM taken""",
    "current_snapshot": f"""{_ROWS}
SELECT row_idx, date || '-' || CAST(row_idx AS VARCHAR) AS tx_id, date, amount
FROM (SELECT *, row_number() OVER (ORDER BY row_key) - 1 AS row_idx FROM raw
      WHERE amount_text <> '' AND row_key % 2 = 0
        AND upload = (SELECT max(upload) FROM raw)) AS newest""",
    "ledger_in_parts": f"""{_ROWS}
SELECT row_idx, date || '-' || CAST(row_idx AS VARCHAR) AS tx_id, date, amount, '2001-08-01' AS csv_date
FROM (SELECT *, row_number() OVER (ORDER BY upload, row_key) - 1 AS row_idx FROM raw
      WHERE amount_text <> '') AS numbered""",
    "latest_snapshot": f"""WITH {_TX}
SELECT left(date, 4) AS batch, tx_id, amount, description FROM tx
WHERE left(date, 4) = (SELECT max(left(date, 4)) FROM tx)""",
    "batch_stamp": """
SELECT CAST(year(o_orderdate) AS BIGINT) AS batch,
       strftime(max(o_orderdate), '%Y-%m-%d') AS csv_date, count(*) AS transactions
FROM orders GROUP BY 1""",
    "state_from_json": f"""{_LABELS}
SELECT CAST(row_idx AS VARCHAR) AS tx_key, reviewer, assignment,
       {_ISO.format('max(ts) OVER (PARTITION BY row_idx)')} AS stamp
FROM latest WHERE row_idx % 11 <> 0""",
    "state_document_in": f"""{_LABELS}
SELECT CAST(row_idx AS VARCHAR) AS tx_key, reviewer, assignment FROM latest WHERE reviewer IN ('A', 'B')""",
    "state_document_out": f"""{_LABELS},
entries AS (
  SELECT CAST(row_idx AS VARCHAR) AS id,
         '"' || CAST(row_idx AS VARCHAR) || '":{{' ||
         string_agg('"' || reviewer || '":"' || assignment || '"', ',' ORDER BY reviewer) ||
         ',"lastUpdated":"' || {_ISO.format('max(ts)')} || '"}}' AS entry
  FROM latest WHERE reviewer IN ('A', 'B') GROUP BY row_idx),
lines AS (
  SELECT id, CASE WHEN id = min(id) OVER () THEN '{{' ELSE ',' END || entry ||
         CASE WHEN id = max(id) OVER () THEN '}}' ELSE '' END AS line
  FROM entries)
SELECT CAST(coalesce(sum(strlen(line) + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
         AS byte, line
FROM lines""",
    "state_to_json": f"""{_LABELS}
SELECT row_idx,
       '{{"' || CAST(row_idx AS VARCHAR) || '":{{' ||
       string_agg('"' || reviewer || '":"' || assignment || '"', ',' ORDER BY reviewer) ||
       ',"lastUpdated":"' || {_ISO.format('max(ts)')} || '"}}}}' AS state
FROM latest GROUP BY row_idx""",
    "required_fields": f"""{_ROWS}
SELECT row_key, date, amount_text FROM raw WHERE date <> '' AND amount_text <> ''""",
    "tx_id": f"WITH {_TX} SELECT row_idx, tx_id FROM tx",
    "tx_projection": f"WITH {_TX} SELECT tx_id, row_idx, date, amount, description FROM tx",
    "default_text": f"""{_ROWS}
SELECT row_key, CASE WHEN description = '' THEN 'Unknown' ELSE description END AS description,
       CASE WHEN owner = '' THEN 'Unassigned' ELSE owner END AS owner
FROM raw""",
    "amount_parse": f"{_ROWS} SELECT row_key, amount FROM raw",
    "amount_format": f"WITH {_TX} SELECT row_idx, printf('$%.2f', amount) AS amount_text FROM tx",
    "iso_stamp": f"SELECT event_id, {_ISO.format('ts')} AS stamp FROM events",
    "hours_since_batch": f"SELECT o_orderkey, {_HOURS} AS hours FROM orders",
    "conflict_phase": f"""
SELECT o_orderkey, {_HOURS} >= 24 AS phase, NOT ({_HOURS} < 24) AS gate_open FROM orders""",
    "roster_filter": f"""WITH {_SUB}
SELECT seq, row_idx, reviewer, assignment FROM sub WHERE reviewer IN ('A', 'B')""",
    "option_domain": f"""WITH {_SUB}
SELECT seq, row_idx, assignment, assignment IN ('A', 'B', 'Split', 'Other') AS accepted
FROM sub""",
    "latest_assignment": _LATEST_ROWS,
    "merge_state": _LATEST_ROWS,
    "last_updated": f"""WITH {_SUB}
SELECT row_idx, {_ISO.format('max(ts)')} AS last_updated FROM sub GROUP BY row_idx""",
    "tx_with_state": f"""{_FULL},
newest AS (SELECT row_idx, max(ts) AS ts FROM sub GROUP BY row_idx)
SELECT j.row_idx, j.tx_id, j.amount, j.label_a, j.label_b,
       {_ISO.format('n.ts')} AS last_updated
FROM judged AS j LEFT JOIN newest AS n ON n.row_idx = j.row_idx""",
    "conflicts": f"{_FULL} SELECT tx_id, label_a, label_b FROM judged WHERE differs",
    "fully_submitted": f"""{_FULL}
SELECT tx_id, differs AS conflict FROM judged WHERE submitted""",
    "tx_status": f"{_FULL} SELECT tx_id, {_STATUS.format('differs')} AS status FROM judged",
    "gated_conflicts": f"""{_FULL}, {_MOMENTS}
SELECT as_of, tx_id, conflict, {_STATUS.format('conflict')} AS status FROM gated""",
    "review_stats": f"{_FULL}, {_STATS} SELECT * FROM stats",
    "review_summary": f"""{_FULL}, {_STATS}
SELECT assigned AS resolved, conflicts, pending AS remaining FROM stats""",
    "conflict_alert": f"""{_FULL}, {_STATS}
SELECT conflicts,
       CAST(conflicts AS VARCHAR) || ' transaction(s) have conflicts that need resolution'
         AS alert,
       'Conflict Phase: Both users have submitted. ' || CAST(conflicts AS VARCHAR) ||
       ' conflict(s) detected. Work together to resolve them.' AS banner
FROM stats WHERE conflicts > 0""",
    "remaining_by_reviewer": f"""{_FULL}, {_MOMENTS}
SELECT as_of, 'A' AS reviewer,
       count(*) FILTER (WHERE label_a IS NULL OR label_a = '' OR conflict) AS remaining
FROM gated GROUP BY as_of
UNION ALL
SELECT as_of, 'B' AS reviewer,
       count(*) FILTER (WHERE label_b IS NULL OR label_b = '' OR conflict) AS remaining
FROM gated GROUP BY as_of""",
    "backlog": f"""{_FULL}
SELECT CASE WHEN differs OR NOT submitted THEN 0 ELSE 1 END AS rank_key, row_idx, tx_id,
       {_STATUS.format('differs')} AS status, amount, description
FROM judged ORDER BY 1, 2""",
    "backlog_with_counts": f"""{_FULL}, {_STATS}
SELECT CASE WHEN differs OR NOT submitted THEN 0 ELSE 1 END AS rank_key, row_idx,
       {_STATUS.format('differs')} AS status, total, assigned, conflicts, pending
FROM judged, stats""",
    "live_backlog": f"""{_FULL}
SELECT CASE WHEN differs OR NOT submitted THEN 0 ELSE 1 END AS rank_key, row_idx, tx_id,
       {_STATUS.format('differs')} AS status, amount, description
FROM judged""",
    "own_submission": f"""{_OWN}
SELECT tx.tx_id, nullif(m.assignment, '') AS own
FROM tx LEFT JOIN mine AS m ON m.row_idx = tx.row_idx""",
    "next_action": f"""{_OWN}
SELECT tx.tx_id,
       CASE WHEN nullif(m.assignment, '') IS NULL THEN 'Assign' ELSE 'Edit' END AS action
FROM tx LEFT JOIN mine AS m ON m.row_idx = tx.row_idx""",
    "unassigned_by_reviewer": f"""{_OWN}
SELECT tx_id, amount, description FROM tx
WHERE NOT EXISTS (SELECT 1 FROM mine AS m WHERE m.row_idx = tx.row_idx AND m.assignment <> '')""",
    "tx_reviewer_matrix": f"""{_FULL}
SELECT tx.tx_id, r.reviewer, l.assignment
FROM tx CROSS JOIN (VALUES ('A'), ('B')) AS r(reviewer)
LEFT JOIN latest AS l ON l.row_idx = tx.row_idx AND l.reviewer = r.reviewer""",
    "visible_assignments": f"""{_FULL}, {_MOMENTS}
SELECT as_of, tx_id, 'A' AS reviewer,
       coalesce(nullif(label_a, ''), CASE WHEN is_open THEN '—' ELSE 'Not yet assigned' END)
         AS shown
FROM gated
UNION ALL
SELECT as_of, tx_id, 'B' AS reviewer, coalesce(nullif(label_b, ''), '—') AS shown
FROM gated WHERE is_open""",
    "stream_state": f"""{_LABELS}
SELECT row_idx, max(CASE WHEN reviewer = 'A' THEN assignment END) AS label_a,
       max(CASE WHEN reviewer = 'B' THEN assignment END) AS label_b,
       {_ISO.format('max(ts)')} AS last_updated
FROM latest GROUP BY row_idx""",
    "stream_stats": f"{_FULL}, {_STATS} SELECT * FROM stats",
    "live_remaining": f"""{_FULL}
SELECT r.reviewer, count(*) FILTER (WHERE differs OR
         (CASE WHEN r.reviewer = 'A' THEN label_a ELSE label_b END) IS NULL) AS remaining
FROM judged, (VALUES ('A'), ('B')) AS r(reviewer) GROUP BY r.reviewer""",
    "review_stats_by_id": f"{_FULL},{_STATS} SELECT * FROM stats",
    "state_round_trip": f"""{_LABELS},
edited AS (
  SELECT row_idx, reviewer,
         CASE WHEN reviewer = 'A' AND row_idx % 5 = 0 THEN 'Other' ELSE assignment END AS assignment
  FROM latest WHERE reviewer IN ('A', 'B')
  UNION ALL
  SELECT DISTINCT row_idx, 'A', 'Other' FROM latest AS l WHERE row_idx % 5 = 0
    AND NOT EXISTS (SELECT 1 FROM latest AS m WHERE m.row_idx = l.row_idx AND m.reviewer = 'A'))
SELECT CAST(row_idx AS VARCHAR) AS tx_key, reviewer, assignment FROM edited""",
    "money_and_dates": """
SELECT o_orderkey,
       '$' || CASE o_orderkey % 4
         WHEN 0 THEN CAST((70368744177664 + CAST(o_orderkey AS HUGEINT)) AS VARCHAR) || '.13'
         WHEN 1 THEN CAST((1125899906842624 + CAST(o_orderkey AS HUGEINT)) AS VARCHAR) || '.50'
         WHEN 2 THEN CAST((1152921504606846976 + 256 * CAST(o_orderkey AS HUGEINT)) AS VARCHAR) || '.00'
         ELSE CAST((18446744073709551616 + 4096 * CAST(o_orderkey AS HUGEINT)) AS VARCHAR) || '.00' END AS money,
       CASE o_orderkey % 3 WHEN 0 THEN true ELSE o_orderkey % 3 <> 1
         AND TIMESTAMP '2001-08-01 12:00:00' >= o_orderdate + INTERVAL 34 HOUR END AS gate,
       CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN false
         ELSE TIMESTAMP '2001-08-01 12:00:00' >= o_orderdate + INTERVAL 34 HOUR END AS phase
FROM orders""",
}
