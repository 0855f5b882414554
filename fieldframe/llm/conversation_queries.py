"""Queries of the operators on the structure of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldframe.llm import turn_repair
from fieldframe.llm.common import read
from fieldframe.llm.queries import register


@register("op12_conversation_repair", r"""
    WITH RECURSIVE poly(b, c, k) AS (
        SELECT range, range, 0 FROM range(256)
        UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
    crcs AS (SELECT list(c ORDER BY b) AS l FROM poly WHERE k = 8),
    src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    crc(k, i, c) AS (
        SELECT DISTINCT k, 1, 4294967295::BIGINT FROM src
        UNION ALL SELECT k, i + 1, xor(c >> 8, l[1 + (xor(c, ascii(substr(k, i, 1))::BIGINT) & 255)]) FROM crc, crcs WHERE i <= length(k)),
    kinds AS (SELECT k, xor(c, 4294967295::BIGINT) % 20 AS kind FROM crc WHERE i = length(k) + 1),
    hurt AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))
        FROM src JOIN kinds USING (k) WHERE kind <> 0),
    placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
    r AS (SELECT *, substr(role, 1, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                 row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
                 NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM placed),
    f AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS t FROM r),
    n AS (SELECT g, max(i) AS n FROM f GROUP BY g),
    v(g, i, s0, s1, u, a) AS (
        SELECT g, n + 1, 0, 6, 3, 0 FROM n
        UNION ALL
        SELECT g, i, CASE WHEN gone THEN b0 ELSE least(b0, bu + 3, ba + 6) END, CASE WHEN gone THEN b1 ELSE least(b1, bu + 3, ba + 6) END,
               CASE WHEN gone THEN bu ELSE least(bu, ba + 3) END, CASE WHEN gone THEN ba ELSE least(ba, bu + 3) END
        FROM (SELECT f.g, f.i, gone,
                     CASE WHEN gone THEN s0 + 4 ELSE least(s0 + 4, u + 3 + t, CASE WHEN ini = 's' THEN s1 + t END, CASE WHEN ini = 'u' THEN u + t END) END AS b0,
                     CASE WHEN gone THEN s1 + 4 ELSE least(s1 + 4, u + 3 + t, CASE WHEN ini = 'u' THEN u + t END) END AS b1,
                     CASE WHEN gone THEN u + 4 ELSE least(u + 4, a + 3 + t, CASE WHEN ini = 'a' THEN a + t END) END AS bu,
                     CASE WHEN gone THEN a + 4 ELSE least(a + 4, u + 3 + t, CASE WHEN ini = 'u' THEN u + t END) END AS ba
              FROM v JOIN f ON f.g = v.g AND f.i = v.i - 1)),
    w AS (SELECT h.g, h.i, [h.s0, h.s1, h.u, h.a] AS here, [x.s0, x.s1, x.u, x.a] AS after, x.g IS NULL AS over, role, text, ini, gone, t
          FROM v h LEFT JOIN v x ON x.g = h.g AND x.i = h.i + 1 LEFT JOIN f ON f.g = h.g AND f.i = h.i),
    e(g, i, st, audit, lines) AS (
        SELECT g, 1, 0, '', []::VARCHAR[] FROM n
        UNION ALL
        SELECT g, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN st WHEN 'K' THEN kept ELSE turned END, audit || letter,
               CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                    ELSE list_append(lines, CASE WHEN turned = 2 THEN 'user:' ELSE 'assistant:' END || CASE WHEN letter = 'R' THEN text ELSE '' END) END
        FROM (SELECT *, CASE WHEN over THEN CASE WHEN st IN (1, 2) THEN 'I' END
                             WHEN here[st + 1] = after[st + 1] + 4 THEN 'D' WHEN here[st + 1] = here[turned + 1] + 3 THEN 'I'
                             WHEN NOT gone AND here[st + 1] = after[kept + 1] + t THEN 'K' ELSE 'R' END AS letter
              FROM (SELECT e.g, e.i, st, audit, lines, here, after, over, role, text, gone, t, CASE WHEN st = 2 THEN 3 ELSE 2 END AS turned,
                           CASE WHEN st = 0 AND ini = 's' THEN 1 WHEN st <> 2 AND ini = 'u' THEN 2 WHEN st = 2 AND ini = 'a' THEN 3 END AS kept
                    FROM e JOIN w ON w.g = e.g AND w.i = e.i))
        WHERE letter IS NOT NULL),
    ends AS (SELECT g, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM e GROUP BY g),
    pairs AS (SELECT *, lag(ini) OVER (PARTITION BY g ORDER BY i) || ini AS pair FROM f),
    report AS (
        SELECT p.conv_id, p.g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
               count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT gone AND cut) AS truncated,
               count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM pairs p GROUP BY p.conv_id, p.g)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(coalesce(v.s0, 0) AS BIGINT) AS cost, coalesce(ends.audit, '') AS audit,
           sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN report ON report.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN v ON v.g = report.g AND v.i = 1 LEFT JOIN ends ON ends.g = report.g""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, alive = turn_repair.damaged(read(spark, sf_dir, "conversations"))
    return turn_repair.summaries(turn_repair.repair(rows, alive))
