"""The queries of :mod:`logharbor.catalog` as SQL over the given tables."""

from __future__ import annotations

import re

# Named subqueries; each may use the ones before it.
_CTES: dict[str, str] = {
    "rec": """
        SELECT event_id, event_type AS topic, CAST(user_id % 3 AS INTEGER) AS part,
               CAST(rn + 100 * (user_id % 3) AS BIGINT) AS off, CAST(rn // 37 AS BIGINT) AS batch_no,
               CAST(user_id AS VARCHAR) AS k, props AS v, CAST(event_id AS VARCHAR) AS h,
               epoch_us(ts) // 1000 AS ms, ts, user_id,
               CAST(strlen(CAST(user_id AS VARCHAR)) + strlen(props) + strlen('origin-id')
                    + strlen(CAST(event_id AS VARCHAR)) + strlen('event-type') + strlen(event_type) AS BIGINT) AS bytes
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) - 1 AS rn
              FROM events)""",
    "kept": "SELECT * FROM rec WHERE off % 97 <> 13",
    "polls": """
        SELECT topic, part, batch_no, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes,
               min(off) AS first_off, max(off) AS last_off,
               row_number() OVER (PARTITION BY topic, part ORDER BY batch_no) AS i
        FROM kept GROUP BY topic, part, batch_no""",
    "roll": """
        SELECT topic, part, i, batch_no, n, bytes, first_off, last_off, bytes AS acc, first_off AS seg,
               bytes >= 5000 AS closes FROM polls WHERE i = 1
        UNION ALL
        SELECT p.topic, p.part, p.i, p.batch_no, p.n, p.bytes, p.first_off, p.last_off,
               CASE WHEN r.closes THEN p.bytes ELSE r.acc + p.bytes END,
               CASE WHEN r.closes THEN p.first_off ELSE r.seg END,
               CASE WHEN r.closes THEN p.bytes ELSE r.acc + p.bytes END >= 5000
        FROM roll r JOIN polls p ON p.topic = r.topic AND p.part = r.part AND p.i = r.i + 1""",
    "seg": """
        SELECT topic, part, seg AS first_off, max(last_off) AS last_off, CAST(sum(n) AS BIGINT) AS n,
               CAST(sum(bytes) AS BIGINT) AS bytes, bool_or(closes) AS closed,
               'backup/' || topic || '/' || part || '/' || topic || '-' || part || '-'
                   || lpad(CAST(seg AS VARCHAR), 19, '0') || '.avro' AS path
        FROM roll GROUP BY topic, part, seg""",
    "spolls": """
        SELECT topic, part, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(off) AS first_off,
               max(off) AS last_off, row_number() OVER (PARTITION BY topic, part ORDER BY min(off)) AS i
        FROM (SELECT *, (ms - min(ms) OVER ()) // ((max(ms) OVER () - min(ms) OVER ()) // 3 + 1) AS round FROM kept)
        GROUP BY topic, part, round, off // 40""",
    "sroll": """
        SELECT topic, part, i, n, bytes, last_off, bytes AS acc, first_off AS seg, bytes >= 20000 AS closes
        FROM spolls WHERE i = 1
        UNION ALL
        SELECT p.topic, p.part, p.i, p.n, p.bytes, p.last_off,
               CASE WHEN r.closes THEN p.bytes ELSE r.acc + p.bytes END,
               CASE WHEN r.closes THEN p.first_off ELSE r.seg END,
               CASE WHEN r.closes THEN p.bytes ELSE r.acc + p.bytes END >= 20000
        FROM sroll r JOIN spolls p ON p.topic = r.topic AND p.part = r.part AND p.i = r.i + 1""",
    "placed": """
        SELECT k.*, r.seg FROM kept k JOIN roll r ON r.topic = k.topic AND r.part = k.part
            AND r.batch_no = k.batch_no""",
    "arch": """
        SELECT *, 'backup/' || topic || '/' || part || '/' || topic || '-' || part || '-'
                  || lpad(CAST(file_off AS VARCHAR), 19, '0') || '.avro' AS path
        FROM (SELECT event_id, topic, part, off, k, v, h, ms, bytes, seg AS file_off FROM placed
              UNION ALL
              SELECT event_id, topic, part, off, k, v, h, ms, bytes, seg + 7 FROM placed WHERE seg % 8 = 4
              UNION ALL
              SELECT event_id, topic, part, off, k, v, h, ms, bytes, off - off % 200 + 31 FROM placed WHERE off % 200 < 60
              UNION ALL
              SELECT event_id, topic, part, off, k, v, h, ms, bytes, late FROM
                  (SELECT *, max(off) OVER (PARTITION BY topic, part) + 100 AS late FROM rec) x
              WHERE off % 97 = 13)""",
    "files": """
        SELECT path, topic, part, file_off, count(*) AS n, min(off) AS first_off, max(off) AS last_off,
               CAST(sum(bytes) AS BIGINT) AS bytes
        FROM arch GROUP BY path, topic, part, file_off""",
    "objs": """
        SELECT path, bytes AS length FROM files
        UNION ALL SELECT 'backup/' || topic || '.tmp', count(*) FROM arch GROUP BY topic
        UNION ALL SELECT topic || '.tmp', count(*) FROM arch GROUP BY topic""",
    "listed": """
        SELECT split_part(path, '/', 2) AS topic, path, length FROM objs
        WHERE path LIKE 'backup/%/%'""",
    "plan": """
        SELECT row_number() OVER (ORDER BY topic, path) - 1 AS plan_seq, path, topic,
               CAST(part AS VARCHAR) AS part,
               row_number() OVER (PARTITION BY topic, part ORDER BY path) AS file_index,
               (SELECT sha256(string_agg(topic, ',' ORDER BY topic)) FROM (SELECT DISTINCT topic FROM files)) AS sha,
               count(*) OVER () AS total
        FROM files""",
    "earlier": "SELECT * FROM plan WHERE plan_seq < total * 3 // 5",
    "folders": """
        SELECT topic, part, row_number() OVER (ORDER BY min(plan_seq)) AS no FROM earlier GROUP BY topic, part""",
    "floors": """
        SELECT path, topic, part, file_off, n, coalesce(max(last_off) OVER (PARTITION BY topic, part ORDER BY path
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS floor_off
        FROM files""",
    "rest": """
        SELECT 'r.' || a.topic AS topic, a.part,
               CAST(row_number() OVER (PARTITION BY a.topic, a.part ORDER BY a.path, a.off) - 1 AS BIGINT) AS off,
               a.off AS src, a.ms, a.k, a.v, a.h, a.path, a.event_id
        FROM arch a JOIN floors f ON f.path = a.path WHERE a.off > f.floor_off""",
    "half": """
        SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY topic, part) AS cnt FROM rest)
        WHERE off < cnt * 3 // 5""",
    "naive": """
        SELECT 'r.' || topic AS topic, part, off AS src,
               row_number() OVER (PARTITION BY topic, part ORDER BY file_off, off) - 1 AS off
        FROM arch""",
    "bounds": """
        SELECT topic, part, min(off) AS start_off, max(off) + 1 AS end_off FROM rec GROUP BY topic, part""",
    "marks": """
        SELECT topic, part, start_off, end_off FROM bounds UNION ALL SELECT 'empty', 0, 20, 20""",
    "used": """
        SELECT DISTINCT user_id // 3 AS g, event_type AS topic, p.part
        FROM events, (SELECT unnest([0, 1, 2]) AS part) p""",
    "goff": """
        SELECT 'group-' || g AS group_id, g, topic, part, off,
               CAST(CASE WHEN g % 2 = 0 THEN -1 ELSE g END AS INTEGER) AS epoch,
               CASE WHEN g % 3 = 0 THEN '' ELSE 'group-' || g END AS metadata
        FROM (SELECT u.g, u.topic, u.part,
                     CAST(CASE WHEN u.g % 11 = 10 THEN -1 ELSE b.start_off
                          + (u.g * 97 + u.part * 13) % (b.end_off - b.start_off + 5) END AS BIGINT) AS off
              FROM used u JOIN bounds b ON b.topic = u.topic AND b.part = u.part
              UNION ALL
              SELECT DISTINCT g, t.topic, 0, 20 FROM used, (SELECT unnest(['empty', 'ghost']) AS topic) t
              WHERE g % 4 = 0)""",
    "snap": """
        SELECT group_id, g, topic, part, off, nullif(epoch, -1) AS epoch, nullif(metadata, '') AS metadata
        FROM goff WHERE off >= 0 AND topic <> 'empty'""",
    "entries": "SELECT group_id, g, topic, part, off, off - 1 AS target FROM snap",
    "comm": """
        SELECT 'g.' || group_id AS group_id, 'r.' || topic AS topic, part,
               CASE WHEN topic = 'view' THEN -1 ELSE off END AS off
        FROM goff WHERE g % 5 = 1 AND (part = 0 OR g % 10 = 1)""",
    "pend": """
        SELECT e.* FROM entries e WHERE NOT EXISTS (SELECT 1 FROM comm c WHERE c.group_id = 'g.' || e.group_id
            AND c.topic = 'r.' || e.topic AND c.part = e.part AND c.off >= 0)""",
}


def _translated(entries: str, log: str, floor: str = "0") -> str:
    """Translation of entries onto a log (topic, part, off, src) by an as-of join."""
    return f"""
        SELECT e.group_id, e.topic, e.part, e.off, e.target,
               CASE WHEN t.last_off IS NULL THEN 'no record' WHEN t.last_src < e.target THEN 'behind'
                    ELSE 'ready' END AS readiness,
               CASE WHEN t.last_off IS NULL OR t.last_src < e.target THEN 'pending'
                    WHEN t.last_src = e.target THEN 'tip' WHEN t.low_src > e.target THEN 'start'
                    WHEN n.src = e.target THEN 'exact' ELSE 'next' END AS c,
               CASE WHEN t.last_off IS NULL OR t.last_src < e.target THEN NULL
                    WHEN t.last_src = e.target THEN t.last_off + 1 WHEN t.low_src > e.target THEN {floor}
                    WHEN n.src = e.target THEN n.off + 1 ELSE n.off END AS restored_offset
        FROM {entries} e
        LEFT JOIN (SELECT topic, part, max(off) AS last_off, min(off) AS low_off, arg_max(src, off) AS last_src,
                          min(src) AS low_src FROM {log} GROUP BY topic, part) t
            ON t.topic = 'r.' || e.topic AND t.part = e.part
        ASOF LEFT JOIN (SELECT topic AS n_topic, part AS n_part, off, src FROM {log}) n
            ON n.n_topic = 'r.' || e.topic AND n.n_part = e.part AND e.target <= n.src"""


_TP = 'topic, part AS "partition"'
_OUT = _TP + ', off AS "offset"'
_READABLE = f"{_OUT}, src AS source_offset, ms AS \"timestamp\", k AS key, v AS value, h AS origin_id, CAST(src AS VARCHAR) AS stamp"
_MANIFEST = f"{_TP}, first_off AS first_offset, last_off AS last_offset, n AS rows, bytes, closed, path"

_LEFTOVERS = """
    SELECT f.topic, f.part, f.file_off, b.cur,
           EXISTS (SELECT 1 FROM arch a WHERE a.path = f.path AND a.off = {sought}) AS holds
    FROM files f JOIN (SELECT topic, part, (min(off) + max(off) + 1) // 2 AS cur FROM kept GROUP BY topic, part) b
        ON b.topic = f.topic AND b.part = f.part"""
_OUTCOME = """CASE WHEN file_off = cur THEN 'overwrite' WHEN file_off > cur THEN 'unexpected'
    WHEN holds THEN 'superseded' ELSE 'unexpected' END"""

_POS = "CASE WHEN regexp_matches(topic, 'view') THEN 0 WHEN regexp_matches(topic, '^(pur|sig)') THEN 1 WHEN regexp_matches(topic, 'r') THEN 2 END"
_CHOSEN = f"""
    SELECT topic, row_number() OVER (ORDER BY pos, topic) - 1 AS rnk FROM
        (SELECT DISTINCT topic, {_POS} AS pos FROM listed)
    WHERE pos IS NOT NULL AND NOT regexp_matches(topic, '^x') AND NOT regexp_matches(topic, 'up$')"""
_LARGE = """
    SELECT topic, row_number() OVER (ORDER BY bytes > (SELECT sum(bytes) // count(DISTINCT topic) FROM files), topic) - 1 AS rnk
    FROM (SELECT topic, sum(bytes) AS bytes FROM files GROUP BY topic)"""

_RESUME = """
    SELECT p.* FROM earlier p JOIN (SELECT max(path) AS path FROM earlier
        WHERE topic = (SELECT max(topic) FROM earlier)) m ON m.path = p.path"""


def _restore_again(done: str) -> str:
    """Second restore onto a target that already holds ``done``."""
    return f"""
        WITH held AS (SELECT topic, part, max(off) + 1 AS nxt, max(src) AS last_src FROM {done} GROUP BY topic, part)
        SELECT 'r.' || a.topic AS topic, a.part AS "partition",
               CAST(coalesce(held.nxt, 0) + row_number() OVER (PARTITION BY a.topic, a.part ORDER BY a.path, a.off) - 1 AS BIGINT) AS "offset",
               a.off AS source_offset, a.ms AS "timestamp", a.k AS key, a.v AS value, a.h AS origin_id,
               CAST(a.off AS VARCHAR) AS stamp
        FROM arch a JOIN floors f ON f.path = a.path
        LEFT JOIN held ON held.topic = 'r.' || a.topic AND held.part = a.part
        WHERE a.off > greatest(f.floor_off, coalesce(held.last_src, -1))"""


_RESTORE_ALL = f"SELECT {_READABLE} FROM rest"
_SKIPPED = """
    SELECT f.path, f.n AS rows, coalesce(r.n, 0) AS restored, f.n - coalesce(r.n, 0) AS skipped
    FROM files f LEFT JOIN (SELECT path, count(*) AS n FROM rest GROUP BY path) r ON r.path = f.path"""

_SQL: dict[str, str] = {
    "scan_topics_regex": f"""
        SELECT {_OUT}, k AS key, v AS value FROM rec
        WHERE regexp_matches(topic, 'click|^pur|err') AND NOT regexp_matches(topic, 'rr')""",
    "scan_archive": """
        SELECT 'r.' || p.topic AS topic, p.part AS "partition", p.off AS "offset", s.path, p.v AS value,
               CAST(p.off AS VARCHAR) AS stamp
        FROM placed p JOIN seg s ON s.topic = p.topic AND s.part = p.part AND s.first_off = p.seg""",
    "list_topics": "SELECT DISTINCT topic FROM listed",
    "list_objects": "SELECT topic, path, length FROM listed",
    "latest_record_per_partition": f"""
        SELECT {_OUT}, k AS key, v AS value, h AS origin_id
        FROM rec QUALIFY row_number() OVER (PARTITION BY topic, part ORDER BY off DESC) = 1""",
    "latest_record_of_partitions": f"""
        SELECT {_OUT}, k AS key, v AS value FROM rec WHERE topic = 'view' AND part IN (0, 2)
        QUALIFY row_number() OVER (PARTITION BY topic, part ORDER BY off DESC) = 1""",
    "partition_watermarks": f"SELECT {_TP}, start_off AS start_offset, end_off AS end_offset FROM bounds",
    "scan_group_snapshot": f"""
        SELECT group_id, {_OUT}, off - 1 AS target FROM snap
        WHERE regexp_matches(group_id, '^group-1|^group-2') AND NOT regexp_matches(group_id, '7$')""",
    "record_at_offset": """
        SELECT w.topic, w.part AS "partition", w.start_offset, r.off AS "offset", r.src AS source_offset
        FROM (SELECT DISTINCT 'r.' || topic AS topic, part, first_off AS start_offset FROM files) w
        ASOF JOIN rest r ON r.topic = w.topic AND r.part = w.part AND w.start_offset <= r.off""",
    "record_at_offset_indexed": """
        SELECT w.topic, w.part AS "partition", w.start_offset, r.off AS "offset", r.src AS source_offset
        FROM (SELECT DISTINCT 'r.' || topic AS topic, part, first_off AS start_offset FROM files) w
        ASOF JOIN rest r ON r.topic = w.topic AND r.part = w.part AND w.start_offset <= r.off""",
    "latest_record_indexed": f"""
        SELECT {_READABLE} FROM rest QUALIFY row_number() OVER (PARTITION BY topic, part ORDER BY off DESC) = 1""",
    "archive_rows": f"""
        SELECT {_OUT}, ms AS "timestamp", k AS key, v AS value,
               CAST(2 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_headers,
               CASE WHEN event_id % 5 = 0 THEN 'dup-' || h ELSE h END AS origin_id, topic AS event_type,
               CASE WHEN event_id % 7 = 0 THEN '' END AS note
        FROM rec""",
    "duplicate_headers": f"SELECT {_OUT} FROM rec WHERE event_id % 5 = 0",
    "record_from_archive": f"""
        SELECT {_OUT}, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS "time",
               'event-type,origin-id' AS header_keys, topic || ',' || h AS header_values FROM rec""",
    "row_size": f"SELECT {_OUT}, bytes FROM rec",
    "poll_batches": f"""
        SELECT {_TP}, batch_no, n AS rows, bytes, first_off AS first_offset, last_off AS last_offset FROM polls""",
    "segment_roll": f"""
        SELECT {_TP}, batch_no, n AS rows, bytes, first_off AS first_offset, last_off AS last_offset,
               seg AS segment, closes FROM roll""",
    "segment_roll_poll_size": """
        p40 AS (SELECT topic, part, off // 40 AS batch_no, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes,
                       min(off) AS first_off, max(off) AS last_off,
                       row_number() OVER (PARTITION BY topic, part ORDER BY off // 40) AS i
                FROM rec GROUP BY topic, part, off // 40),
        r40 AS (SELECT topic, part, i, batch_no, n, bytes, first_off, last_off, bytes AS acc, first_off AS seg,
                       bytes >= 7000 AS closes FROM p40 WHERE i = 1
                UNION ALL
                SELECT p.topic, p.part, p.i, p.batch_no, p.n, p.bytes, p.first_off, p.last_off,
                       CASE WHEN r.closes THEN p.bytes ELSE r.acc + p.bytes END,
                       CASE WHEN r.closes THEN p.first_off ELSE r.seg END,
                       CASE WHEN r.closes THEN p.bytes ELSE r.acc + p.bytes END >= 7000
                FROM r40 r JOIN p40 p ON p.topic = r.topic AND p.part = r.part AND p.i = r.i + 1)
        SELECT topic, part AS "partition", batch_no, n AS rows, bytes, first_off AS first_offset,
               last_off AS last_offset, seg AS segment, closes FROM r40""",
    "segment_manifest": f"SELECT {_MANIFEST} FROM seg WHERE closed",
    "segment_flush": f"SELECT {_MANIFEST} FROM seg",
    "archive_write": """
        SELECT s.path, p.topic, p.part AS "partition", count(*) AS rows, min(p.off) AS first_offset,
               max(p.off) AS last_offset, max(p.ms) AS last_timestamp
        FROM placed p JOIN seg s ON s.topic = p.topic AND s.part = p.part AND s.first_off = p.seg
        WHERE s.closed GROUP BY s.path, p.topic, p.part""",
    "archive_objects_write": """
        SELECT s.path, p.topic, p.part AS "partition", count(*) AS rows, min(p.off) AS first_offset,
               max(p.off) AS last_offset, CAST(sum(p.bytes) AS BIGINT) AS bytes, max(p.ms) AS last_timestamp,
               count(DISTINCT s.path) AS listed
        FROM placed p JOIN seg s ON s.topic = p.topic AND s.part = p.part AND s.first_off = p.seg
        WHERE s.closed GROUP BY s.path, p.topic, p.part""",
    "committed_offsets": f"SELECT {_TP}, max(last_off) + 1 AS committed FROM seg WHERE closed GROUP BY topic, part",
    "open_segment_rows": """
        SELECT k.topic, k.part AS "partition", k.off AS "offset", k.v AS value
        FROM kept k LEFT JOIN (SELECT topic, part, max(last_off) + 1 AS c FROM seg WHERE closed GROUP BY topic, part) c
            ON c.topic = k.topic AND c.part = k.part
        WHERE k.off >= coalesce(c.c, 0)""",
    "idle_partitions": f"""
        SELECT {_TP}, last_ms AS last_timestamp, newest - last_ms AS idle_ms
        FROM (SELECT topic, part, max(ms) AS last_ms, max(max(ms)) OVER () AS newest FROM rec GROUP BY topic, part)
        WHERE newest - last_ms > 7200000""",
    "reconcile_segments": f"""
        SELECT {_TP}, file_off AS first_offset, cur AS current_offset, {_OUTCOME} AS outcome
        FROM ({_LEFTOVERS.format(sought="b.cur")})""",
    "reconcile_segments_first_offset": f"""
        SELECT {_TP}, file_off AS first_offset, cur AS current_offset, {_OUTCOME} AS outcome
        FROM ({_LEFTOVERS.format(sought="f.file_off")})""",
    "unexpected_leftovers": f"""
        SELECT count(*) FILTER (WHERE outcome = 'unexpected') AS unexpected
        FROM (SELECT {_OUTCOME} AS outcome FROM ({_LEFTOVERS.format(sought="b.cur")}))""",
    "orphan_partitions": """
        SELECT topic, fp AS "partition", CAST(fp AS VARCHAR) AS folder FROM
            (SELECT DISTINCT topic, part AS fp FROM rec UNION ALL SELECT DISTINCT topic, part + 3 FROM rec)
        WHERE fp >= 2""",
    "parse_archive_path": """
        SELECT path, len(p) >= 3 AS parseable, CASE WHEN len(p) >= 3 THEN p[-3] END AS topic,
               CASE WHEN len(p) >= 3 THEN p[-2] END AS "partition", CASE WHEN len(p) >= 3 THEN p[-1] END AS file,
               CASE WHEN len(p) >= 3 THEN TRY_CAST(regexp_extract(path, '-([0-9]+)\\.avro$', 1) AS BIGINT) END AS first_offset
        FROM (SELECT path, string_split(path, '/') AS p FROM objs)""",
    "unparseable_keys": "SELECT path, length FROM objs WHERE len(string_split(path, '/')) < 3",
    "filter_topics_ordered": f'SELECT rnk AS "rank", topic FROM ({_CHOSEN})',
    "topic_inventory": """
        SELECT topic, CAST(part AS VARCHAR) AS "partition", count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
        FROM files GROUP BY topic, part""",
    "topic_sizes": """
        SELECT topic, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM files GROUP BY topic""",
    "large_topics_last": f'SELECT rnk AS "rank", topic FROM ({_LARGE})',
    "topics_sha": f"SELECT sha256(string_agg(topic, ',' ORDER BY rnk)) AS topics_sha FROM ({_LARGE})",
    "plan_file_index": 'SELECT path, topic, part AS "partition", file_index FROM plan',
    "plan_records": f"""
        chosen AS ({_CHOSEN})
        SELECT row_number() OVER (ORDER BY c.rnk, f.path) - 1 AS plan_seq,
               regexp_replace(f.path, '[^/]*$', '') AS key, f.path AS value, f.topic,
               CAST(f.part AS VARCHAR) AS "partition",
               row_number() OVER (PARTITION BY f.topic, f.part ORDER BY f.path) AS file_index,
               (SELECT sha256(string_agg(topic, ',' ORDER BY rnk)) FROM chosen) AS topics_sha
        FROM files f JOIN chosen c ON c.topic = f.topic""",
    "plan_write": """
        SELECT plan_seq, regexp_replace(path, '[^/]*$', '') AS key, path AS value, file_index FROM plan""",
    "plan_resume_holes": """
        SELECT lost, CAST((SELECT max(plan_seq) FROM earlier)
                    + row_number() OVER (PARTITION BY lost ORDER BY plan_seq) AS BIGINT) AS plan_seq,
               path AS value, file_index
        FROM (SELECT k.lost, p.* FROM plan p, (SELECT unnest(['folder', 'tail']) AS lost) k
              WHERE p.plan_seq >= p.total * 3 // 5
                 OR (k.lost = 'folder' AND (p.topic, p.part) IN (SELECT (topic, part) FROM folders WHERE no = 1))
                 OR (k.lost = 'tail' AND p.file_index > 2
                     AND (p.topic, p.part) IN (SELECT (topic, part) FROM folders WHERE no = 2)))""",
    "plan_from_wire": """
        SELECT regexp_replace(path, '[^/]*$', '') AS key, path AS value, topic, part AS "partition", file_index,
               sha AS topics_sha FROM plan""",
    "list_written_objects": f"SELECT {_TP}, count(*) AS files FROM seg GROUP BY topic, part",
    "plan_journal_resume": """
        WITH early AS (
            SELECT *, row_number() OVER (ORDER BY topic, path) - 1 AS seq, count(*) OVER () AS n,
                   row_number() OVER (PARTITION BY topic, part ORDER BY path) AS fi
            FROM plan WHERE path NOT LIKE '%1.avro'),
        closed AS (SELECT * FROM early WHERE seq < n * 3 // 5 // 16 * 16),
        tip AS (SELECT * FROM closed ORDER BY seq DESC LIMIT 1),
        going_on AS (
            SELECT t.seq + row_number() OVER (ORDER BY p.topic, p.path) AS seq, p.path,
                   row_number() OVER (PARTITION BY p.topic, p.part ORDER BY p.path)
                       + CASE WHEN p.topic = t.topic AND p.part = t.part THEN t.fi ELSE 0 END AS fi
            FROM plan p, tip t WHERE p.topic > t.topic OR (p.topic = t.topic AND p.path > t.path))
        SELECT seq AS plan_seq, path AS value, CAST(fi AS BIGINT) AS file_index, CAST(seq // 16 AS INTEGER) AS page
        FROM (SELECT seq, path, fi FROM closed UNION ALL SELECT seq, path, fi FROM going_on)
        UNION ALL
        SELECT NULL, p.path, NULL, NULL FROM plan p, tip t
        WHERE (p.topic < t.topic OR (p.topic = t.topic AND p.path <= t.path))
            AND p.path NOT IN (SELECT path FROM closed)""",
    "plan_resume_point": f"""
        SELECT topic, path AS file, file_index, sha AS topics_sha, plan_seq FROM ({_RESUME})""",
    "plan_sha_guard": """
        asked AS (SELECT t.topic, e.excluded FROM (SELECT DISTINCT topic FROM files) t, (VALUES (''), ('view')) e(excluded)
                  WHERE e.excluded = '' OR NOT regexp_matches(t.topic, e.excluded)),
        prints AS (SELECT excluded, sha256(string_agg(topic, ',' ORDER BY topic)) AS topics_sha FROM asked GROUP BY excluded)
        SELECT a.topic, a.excluded, p.topics_sha, p.topics_sha = (SELECT max(sha) FROM earlier) AS goes_on,
               (SELECT max(sha) FROM earlier e WHERE e.topic = a.topic) AS planned_sha
        FROM asked a JOIN prints p ON p.excluded = a.excluded""",
    "plan_resume_records": f"""
        SELECT p.plan_seq, regexp_replace(p.path, '[^/]*$', '') AS key, p.path AS value, p.topic,
               p.part AS "partition", p.file_index, p.sha AS topics_sha
        FROM plan p, ({_RESUME}) r
        WHERE p.topic > r.topic OR (p.topic = r.topic AND p.path > r.path)""",
    "never_planned": """
        SELECT path, topic FROM plan WHERE topic IN (SELECT topic FROM earlier)
            AND path NOT IN (SELECT path FROM earlier WHERE path NOT LIKE '%1.avro')""",
    "plan_progress": """
        SELECT topics_sha, topic, "partition", total_files, planned_files,
               CAST(CASE WHEN sum(total_files - planned_files) OVER (PARTITION BY topic) > 0 THEN 0 ELSE 1 END AS INTEGER) AS topic_done
        FROM (SELECT p.sha AS topics_sha, p.topic, p.part AS "partition", count(*) AS total_files,
                     count(e.path) AS planned_files
              FROM plan p LEFT JOIN earlier e ON e.path = p.path GROUP BY p.sha, p.topic, p.part)""",
    "restore_missing_ranges": f"""
        SELECT {_TP}, min(src) AS first, max(src) AS last
        FROM (SELECT topic, part, src, src - row_number() OVER (PARTITION BY topic, part ORDER BY src) AS island
              FROM rest WHERE src % 200 BETWEEN 50 AND 69 AND part <> 1)
        GROUP BY topic, part, island""",
    "restore_fill_ranges": f"""
        SELECT r.topic, r.part AS "partition",
               CAST(t.nxt + row_number() OVER (PARTITION BY r.topic, r.part ORDER BY r.off) - 1 AS BIGINT) AS "offset",
               src AS source_offset, ms AS "timestamp", k AS key, v AS value, h AS origin_id, CAST(src AS VARCHAR) AS stamp
        FROM rest r JOIN (SELECT topic, part, max(off) + 1 AS nxt FROM rest
                          WHERE NOT (src % 200 BETWEEN 50 AND 69 AND part <> 1) GROUP BY topic, part) t
            ON t.topic = r.topic AND t.part = r.part
        WHERE src % 200 BETWEEN 50 AND 69 AND r.part <> 1""",
    "restore_exclude": """
        SELECT plan_seq, path AS value FROM plan WHERE NOT regexp_matches(topic, 'ror$|^vi')""",
    "header_lookup": f"""
        SELECT {_OUT}, h AS origin_id, event_id % 7 = 0 AS has_note, false AS has_absent FROM rec""",
    "source_offset": f"""
        SELECT {_OUT}, src AS source_offset FROM rest UNION ALL SELECT {_OUT}, -1 FROM rec""",
    "stamp_source_offset": f"""
        SELECT {_OUT}, CAST(off AS VARCHAR) AS stamp, CAST(3 AS BIGINT) AS n_headers FROM rec
        UNION ALL SELECT {_OUT}, CAST(off AS VARCHAR), 3 FROM rest""",
    "last_restored_offset": f"""
        SELECT f.topic, f.part AS "partition", coalesce(h.last_src, -1) AS last_source_offset,
               coalesce(h.nxt, 0) AS next_offset
        FROM (SELECT DISTINCT topic, part FROM files) f
        LEFT JOIN (SELECT topic, part, max(src) AS last_src, max(off) + 1 AS nxt FROM half WHERE part <> 1
                   GROUP BY topic, part) h ON h.topic = 'r.' || f.topic AND h.part = f.part""",
    "existing_data_violations": f"""
        SELECT topic, part AS "partition", max(off) AS "offset" FROM rest WHERE part = 2 GROUP BY topic, part""",
    "restore_dedup": """
        SELECT path, substr(topic, 3) AS topic, part AS "partition", src AS source_offset FROM rest""",
    "restore_topic": _RESTORE_ALL,
    "restore_topic_small_blocks": _RESTORE_ALL + " WHERE topic <> 'r.click'",
    "restore_progress": f"""
        SELECT {_TP}, max(src) AS last_source_offset, max(off) + 1 AS next_offset FROM rest GROUP BY topic, part""",
    "restore_resume": _restore_again("half"),
    "restore_file_progress": """
        SELECT e.topic, e.part AS "partition", e.sha AS topics_sha, e.idx AS file_index, t.files,
               e.idx * 100 // t.files AS percent_done
        FROM (SELECT topic, part, sha, arg_max(file_index, plan_seq) AS idx FROM earlier WHERE plan_seq % 6 <> 5
              GROUP BY topic, part, sha) e
        JOIN (SELECT topic, part, count(*) AS files FROM plan GROUP BY topic, part) t
            ON t.topic = e.topic AND t.part = e.part""",
    "restore_missing_files": """
        SELECT path, min(plan_seq) AS plan_seq, reason
        FROM (SELECT regexp_replace(path, '[^/]*$', '') || n.name AS path, plan_seq, n.reason
              FROM plan, (SELECT unnest(['absent-0-0000000000000000001.avro', 'notes.txt']) AS name,
                                 unnest(['absent', 'bad path']) AS reason) n
              WHERE plan_seq % 10 = 0) GROUP BY path, reason""",
    "restore_write": f"SELECT {_OUT}, src AS source_offset, v AS value FROM rest",
    "restore_skipped_rows": _SKIPPED,
    "empty_partitions": f"SELECT {_TP} FROM marks WHERE start_off = end_off",
    "valid_group_offsets": f"""
        SELECT group_id, {_OUT}, epoch AS leader_epoch, metadata FROM goff WHERE off >= 0 AND topic <> 'empty'""",
    "normalise_offsets": f"""
        SELECT group_id, {_OUT}, nullif(epoch, -1) AS leader_epoch, nullif(metadata, '') AS metadata FROM goff""",
    "group_snapshot": """
        SELECT a.group_id, s.topic, s.part AS "partition", s.off AS "offset", s.epoch AS leader_epoch, s.metadata
        FROM (SELECT DISTINCT group_id FROM goff) a LEFT JOIN snap s ON s.group_id = a.group_id""",
    "group_snapshot_write": """
        SELECT a.group_id, count(DISTINCT s.topic) AS topics, count(s.topic) AS partitions
        FROM (SELECT DISTINCT group_id FROM goff) a LEFT JOIN snap s ON s.group_id = a.group_id GROUP BY a.group_id""",
    "filter_groups": """
        SELECT DISTINCT group_id FROM snap
        WHERE regexp_matches(group_id, 'group-[1-4]|9$') AND NOT regexp_matches(group_id, '2')""",
    "flatten_groups": f"SELECT group_id, {_OUT}, target FROM entries",
    "pending_groups": f"SELECT group_id, {_OUT}, target FROM pend",
    "exclude_group_topics": f"""
        SELECT group_id, {_OUT}, target FROM entries WHERE NOT regexp_matches(topic, '^cl|ost$')""",
    "existing_group_topics": f"""
        SELECT group_id, {_OUT}, target FROM entries WHERE topic NOT IN ('signup', 'ghost')""",
    "group_readiness": """
        SELECT e.group_id, e.topic, e.part AS "partition", e.target, t.src AS latest_source,
               CASE WHEN t.src IS NULL THEN 'no record' WHEN t.src = -1 THEN 'no header'
                    WHEN t.src < e.target THEN 'behind' ELSE 'ready' END AS readiness
        FROM entries e LEFT JOIN
            (SELECT topic, part, CASE WHEN topic = 'r.error' AND part = 2 THEN -1 ELSE max(src) END AS src
             FROM half WHERE topic <> 'r.view' OR part <> 0 GROUP BY topic, part) t
            ON t.topic = 'r.' || e.topic AND t.part = e.part""",
    "translate_offsets": f"""
        SELECT group_id, {_OUT}, target, readiness, c AS "case", restored_offset
        FROM ({_translated("entries", "rest")})""",
    "translate_offsets_small_blocks": f"""
        SELECT group_id, {_OUT}, target, readiness, c AS "case", restored_offset
        FROM ({_translated("entries", "half", "t.low_off")})""",
    "translation_cases": f"""
        cut AS (SELECT * FROM (SELECT *, max(src) OVER (PARTITION BY topic, part) // 5 AS gone FROM rest)
                WHERE src >= gone)
        SELECT topic, c AS "case", count(*) AS entries, CAST(sum(restored_offset) AS BIGINT) AS offset_sum
        FROM ({_translated("entries", "cut")}) GROUP BY topic, c""",
    "group_commits": f"""
        SELECT 'g.' || group_id AS group_id, 'r.' || topic AS topic, part AS "partition",
               restored_offset AS "offset", CAST(-1 AS INTEGER) AS leader_epoch
        FROM ({_translated("pend", "rest")}) WHERE c <> 'pending'""",
    "group_commit_log": """
        SELECT 'g.' || group_id AS group_id, 'r.' || topic AS topic, part AS "partition",
               CAST(CASE WHEN off < 0 THEN off ELSE off + CASE WHEN g % 3 = 1 THEN 5 ELSE 10 END END AS BIGINT) AS "offset",
               epoch AS leader_epoch
        FROM goff WHERE g % 4 <> 1""",
    "pending_groups_of_log": f"""
        SELECT group_id, {_OUT}, target FROM entries e WHERE NOT EXISTS (SELECT 1 FROM goff c
            WHERE c.group_id = e.group_id AND c.topic = e.topic AND c.part = e.part AND c.off >= 0 AND c.g % 4 <> 1)""",
    "translate_two_rounds": f"""
        one AS ({_translated("entries", "half")}),
        left_over AS (SELECT * FROM one WHERE c = 'pending'),
        two AS ({_translated("left_over", "rest")})
        SELECT group_id, {_TP}, restored_offset, CAST(1 AS INTEGER) AS round FROM one WHERE c <> 'pending'
        UNION ALL
        SELECT group_id, {_TP}, restored_offset, CAST(CASE WHEN c = 'pending' THEN 0 ELSE 2 END AS INTEGER) FROM two""",
    "translate_followed": f"""
        thirds AS (SELECT *, off * 3 // count(*) OVER (PARTITION BY topic, part) AS third FROM rest),
        log1 AS (SELECT * FROM thirds WHERE third < 1),
        log2 AS (SELECT * FROM thirds WHERE third < 2),
        one AS ({_translated("entries", "log1")}),
        left1 AS (SELECT * FROM one WHERE c = 'pending'),
        two AS ({_translated("left1", "log2")}),
        left2 AS (SELECT * FROM two WHERE c = 'pending'),
        three AS ({_translated("left2", "rest")})
        SELECT group_id, {_TP}, restored_offset, CAST(1 AS INTEGER) AS round FROM one WHERE c <> 'pending'
        UNION ALL
        SELECT group_id, {_TP}, restored_offset, CAST(2 AS INTEGER) FROM two WHERE c <> 'pending'
        UNION ALL
        SELECT group_id, {_TP}, restored_offset, CAST(CASE WHEN c = 'pending' THEN 0 ELSE 3 END AS INTEGER) FROM three""",
    "group_status": f"""
        done AS ({_translated("pend", "rest")})
        SELECT a.group_id, a.topic, CAST(CASE
                   WHEN p.n IS NULL THEN CASE WHEN 'g.' || a.group_id IN (SELECT group_id FROM comm) THEN 3 ELSE 0 END
                   WHEN regexp_matches(a.topic, 'purch') OR a.topic IN ('signup', 'ghost') THEN 2
                   WHEN p.n = p.resolved THEN 4 ELSE 1 END AS INTEGER) AS status
        FROM (SELECT DISTINCT group_id, topic FROM entries) a
        LEFT JOIN (SELECT group_id, topic, count(*) AS n, count(*) FILTER (WHERE c <> 'pending') AS resolved
                   FROM done GROUP BY group_id, topic) p
            ON p.group_id = a.group_id AND p.topic = a.topic""",
    "rows_per_file": "SELECT path, n AS rows FROM files",
    "segment_overlaps": """
        SELECT path, first_off AS first_offset, last_off AS last_offset, earlier_last FROM
            (SELECT *, max(last_off) OVER (PARTITION BY topic, part ORDER BY file_off
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_last FROM files)
        WHERE earlier_last >= first_off""",
    "path_mismatches": """
        SELECT replace(path, '/view/', '/click/') AS path, topic, part AS "partition", n AS rows
        FROM files WHERE topic = 'view'""",
    "offset_gaps": f"""
        SELECT {_OUT}, nxt AS next_offset, nxt - off - 1 AS missing FROM
            (SELECT *, lead(off) OVER (PARTITION BY topic, part ORDER BY off) AS nxt FROM kept)
        WHERE nxt - off > 1""",
    "restore_duplicates": f"""
        SELECT {_TP}, src AS source_offset, count(*) AS copies FROM naive GROUP BY topic, part, src HAVING count(*) > 1""",
    "restore_count_diff": """
        SELECT r.topic, r.part AS "partition", r.n AS source_rows, n.n AS restored_rows
        FROM (SELECT 'r.' || topic AS topic, part, count(*) AS n FROM rec GROUP BY topic, part) r
        JOIN (SELECT topic, part, count(*) AS n FROM naive GROUP BY topic, part) n
            ON n.topic = r.topic AND n.part = r.part WHERE r.n <> n.n""",
    "restore_content_diff": """
        SELECT 'r.' || s.topic AS topic, s.part AS "partition", s.off AS source_offset,
               CASE WHEN d.src IS NULL THEN 'missing' ELSE 'changed' END AS verdict
        FROM rec s LEFT JOIN (SELECT topic, part, src, CASE WHEN src % 50 = 7 THEN v || '!' ELSE v END AS v FROM rest) d
            ON d.topic = 'r.' || s.topic AND d.part = s.part AND d.src = s.off
        WHERE d.src IS NULL OR d.v <> s.v""",
    "restore_tree_diff": """
        SELECT coalesce('r.' || s.topic, d.topic) AS topic, coalesce(s.part, d.part) AS "partition",
               coalesce(s.off, d.src) AS source_offset,
               CASE WHEN d.src IS NULL THEN 'missing' WHEN s.off IS NULL THEN 'extra' ELSE 'changed' END AS verdict
        FROM (SELECT * FROM kept WHERE NOT (topic = 'error' AND part = 0 AND off % 30 = 5)) s
        FULL JOIN (SELECT topic, part, src, CASE WHEN topic = 'r.view' AND part = 1 AND src % 50 = 7
                          THEN v || '!' ELSE v END AS v
                   FROM rest WHERE NOT (topic = 'r.click' AND part = 2 AND src % 40 = 3)) d
            ON d.topic = 'r.' || s.topic AND d.part = s.part AND d.src = s.off
        WHERE d.src IS NULL OR s.off IS NULL OR d.v <> s.v""",
    "restore_order_violations": f"""
        SELECT {_OUT}, src AS source_offset, prev AS previous_source FROM
            (SELECT *, lag(src) OVER (PARTITION BY topic, part ORDER BY off) AS prev FROM naive)
        WHERE src <= prev""",
    "restore_is_clean": """
        SELECT 'duplicate' AS finding, topic, part AS "partition", src AS source_offset FROM rest
            GROUP BY topic, part, src HAVING count(*) > 1
        UNION ALL SELECT 'content', 'r.' || topic, part, off FROM kept k
            WHERE NOT EXISTS (SELECT 1 FROM rest r WHERE r.topic = 'r.' || k.topic AND r.part = k.part
                AND r.src = k.off AND r.v = k.v AND r.k = k.k AND r.ms = k.ms)
        UNION ALL SELECT 'content', topic, part, src FROM rest r
            WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE r.topic = 'r.' || k.topic AND r.part = k.part
                AND r.src = k.off)""",
    "group_lag": """
        SELECT g.group_id, g.topic, g.part AS "partition", g.off AS "offset", m.end_off AS end_offset,
               m.end_off - g.off AS lag
        FROM goff g JOIN marks m ON m.topic = g.topic AND m.part = g.part WHERE g.off >= 0""",
    "stream_archive": f"""
        SELECT {_TP}, seg AS first_offset, max(last_off) AS last_offset, CAST(sum(n) AS BIGINT) AS rows,
               CAST(sum(n) AS BIGINT) AS stored_rows, CAST(sum(bytes) AS BIGINT) AS bytes, bool_or(closes) AS closed,
               'backup/' || topic || '/' || part || '/' || topic || '-' || part || '-'
                   || lpad(CAST(seg AS VARCHAR), 19, '0') || '.avro' AS path
        FROM sroll GROUP BY topic, part, seg""",
    "stream_bounded_poll": f"""
        SELECT {_OUT}, ms AS "timestamp", v AS value, true AS bounded FROM rest""",
    "stream_idle_segments": f"""
        SELECT {_TP}, seg AS first_offset, max(last_off) AS last_offset, CAST(sum(n) AS BIGINT) AS rows,
               CAST(sum(bytes) AS BIGINT) AS bytes, bool_or(closes) AS closed,
               'backup/' || topic || '/' || part || '/' || topic || '-' || part || '-'
                   || lpad(CAST(seg AS VARCHAR), 19, '0') || '.avro' AS path,
               CASE WHEN NOT bool_or(closes) THEN 'idle' END AS reason
        FROM sroll GROUP BY topic, part, seg""",
    "stream_restart": f"SELECT {_OUT}, v AS value FROM kept",
    "restore_observed_progress": """
        rounds AS (SELECT path, plan_seq, plan_seq // ((max(plan_seq) OVER () - min(plan_seq) OVER ()) // 4 + 1) AS round_no
                   FROM plan)
        SELECT p.round_no, p.plan_records, p.last_plan_seq, r.rows, r.bytes, r.last_timestamp
        FROM (SELECT round_no, count(*) AS plan_records, max(plan_seq) AS last_plan_seq FROM rounds GROUP BY round_no) p
        JOIN (SELECT q.round_no, count(*) AS rows, max(t.ms) AS last_timestamp,
                     CAST(sum(strlen(t.k) + strlen(t.v) + strlen('origin-id') + strlen(t.h) + strlen('event-type')
                              + strlen(substr(t.topic, 3)) + strlen('restore.source-offset')
                              + strlen(CAST(t.src AS VARCHAR))) AS BIGINT) AS bytes
              FROM rest t JOIN rounds q ON q.path = t.path GROUP BY q.round_no) r ON r.round_no = p.round_no""",
    "stream_restore": f"SELECT {_OUT}, src AS source_offset, v AS value FROM rest",
}


def _used(sql: str) -> list[str]:
    """Names of the subqueries a text refers to, in the order they must be defined."""
    wanted: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        for name, body in _CTES.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                texts.append(body)
    return [name for name in _CTES if name in wanted]


def all_sql() -> dict[str, str]:
    out = {}
    for name, sql in _SQL.items():
        ctes = [f"{cte} AS ({_CTES[cte]})" for cte in _used(sql)]
        body = sql.strip()
        if re.match(r"\w+ AS \(", body):
            out[name] = f"WITH RECURSIVE {', '.join(ctes)}, {body}"
        elif body.startswith("WITH "):
            out[name] = f"WITH RECURSIVE {', '.join(ctes)}, {body[5:]}"
        else:
            out[name] = f"WITH RECURSIVE {', '.join(ctes)} {body}"
    return out
