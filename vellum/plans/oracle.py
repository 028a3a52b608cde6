"""The registered queries in the other engine's SQL."""

from __future__ import annotations

from vellum.profile import CIRCLED

_LINES = r"""
L AS MATERIALIZED (
  SELECT doc_id, line_no, line, line_no // 5 AS page_idx, line_no % 5 AS idx, (doc_id + line_no) % 3 <> 0 AS has_m,
         sum(((doc_id + line_no) % 3 <> 0)::bigint) OVER (PARTITION BY doc_id, line_no // 5 ORDER BY line_no ROWS UNBOUNDED PRECEDING)::bigint AS rk
  FROM (SELECT doc_id, (unnest(range(1, len(s) + 1)) - 1)::bigint AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))
  WHERE line <> ''),
pg AS (SELECT DISTINCT doc_id, page_idx FROM L)"""

_BODY = r""",
body AS MATERIALIZED (
  SELECT doc_id, page_idx, idx AS index, line_no, CASE WHEN idx = 0 AND page_idx % 2 = 0 THEN 'title' ELSE 'text' END AS type,
         CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 + page_idx % 3 END::bigint AS level, 1 + (doc_id + line_no) % 3 AS n_lines,
         CASE WHEN (line_no * 7 + doc_id) % 4 = 0 THEN 77.5 ELSE 65.0 END::double AS x0,
         CASE WHEN (doc_id + line_no * 3) % 5 = 0 THEN 507.5 ELSE 520.0 END::double AS x1,
         1.0::double - ((doc_id * 13 + line_no) % 25)::double / 100.0::double AS score,
         (CASE WHEN idx = 0 AND page_idx % 2 = 0 THEN CASE (page_idx // 2) % 3 WHEN 0 THEN '第一章 ' WHEN 1 THEN '一、' ELSE '1. ' END ELSE '' END)
         || (CASE WHEN (doc_id + line_no) % 13 = 0 THEN 'A：①b；②c；③d。' ELSE '' END) || line
         || (CASE WHEN has_m THEN substr('@C', rk, 1) ELSE '' END) AS text
  FROM L)"""

_NOTES = r""",
fnote AS MATERIALIZED (
  SELECT doc_id, page_idx, idx AS ord, CASE k WHEN 1 THEN left(line, 40) WHEN 2 THEN '收稿日期：' || left(line, 20) WHEN 3 THEN '2. ' || left(line, 40)
         WHEN 4 THEN substr('@C', rk, 1) || substr('@C', rk + 1, 1) || left(line, 40) ELSE substr('@C', rk, 1) || left(line, 40) END AS text
  FROM (SELECT *, (doc_id * 7 + line_no) % 11 AS k FROM L) WHERE has_m AND k <> 0)"""

_PNUM = r""",
own AS (SELECT doc_id, page_idx, page_idx + 1 + doc_id % 7 - 3 AS v FROM pg WHERE (doc_id + page_idx) % 4 <> 0 AND page_idx + 1 + doc_id % 7 - 3 > 0),
offs AS (SELECT doc_id, off FROM (SELECT doc_id, v - page_idx AS off, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page_idx)) AS r FROM own GROUP BY doc_id, v - page_idx) WHERE r = 1),
pnum AS MATERIALIZED (SELECT pg.doc_id, pg.page_idx, coalesce(v, pg.page_idx + coalesce(off, 1))::bigint AS pnum FROM pg LEFT JOIN own USING (doc_id, page_idx) LEFT JOIN offs ON offs.doc_id = pg.doc_id)"""

_EDGES = r""",
ends AS (SELECT doc_id, page_idx, max(idx) AS last, min(idx) AS first, bool_or(idx = 0) AS zero, bool_or(idx = 1) AS one FROM L GROUP BY doc_id, page_idx),
edge AS MATERIALIZED (
  SELECT a.doc_id, a.page_idx AS src_page, a.last AS src_index, b.page_idx AS dst_page, b.first AS dst_index FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND b.page_idx = a.page_idx + 1 WHERE (a.doc_id + a.page_idx) % 5 IN (0, 1)
  UNION ALL SELECT doc_id, page_idx, 0, page_idx, 1 FROM ends WHERE (doc_id + page_idx) % 17 = 0 AND zero AND one AND last <> 0)"""

_ALIGN = r""",
aligned AS (
  SELECT pg.doc_id, pg.page_idx, pnum, coalesce(marks, 0)::bigint AS marks, coalesce(notes, 0)::bigint AS notes, coalesce(numbered, 0)::bigint AS numbered, coalesce(expanded, 0)::bigint AS numbered_expanded
  FROM pg LEFT JOIN pnum USING (doc_id, page_idx)
  LEFT JOIN (SELECT doc_id, page_idx, sum(len(regexp_extract_all(text, '[①-⑳]'))) AS marks FROM body GROUP BY ALL) USING (doc_id, page_idx)
  LEFT JOIN (SELECT doc_id, page_idx, count(*) AS notes, count(*) FILTER (text NOT LIKE '收稿日期%') AS numbered,
             sum(CASE WHEN text LIKE '收稿日期%' THEN 0 ELSE greatest(length(regexp_extract(text, '^[①-⑳]+')), 1) END) AS expanded FROM fnote GROUP BY ALL) USING (doc_id, page_idx))"""

_PAGE_TEXT = r""",
ptext AS MATERIALIZED (SELECT doc_id, page_idx, string_agg(text, '' ORDER BY index) AS text FROM body GROUP BY ALL)"""

# every circled digit of a block, with its 0-based place
_MARKS = r""",
marks AS MATERIALIZED (SELECT * FROM (SELECT doc_id, page_idx, index, text, (unnest(range(1, length(text) + 1)) - 1)::bigint AS char_pos, unnest(string_split(text, '')) AS ch FROM body WHERE regexp_matches(text, '[①-⑳]')) WHERE regexp_matches(ch, '^[①-⑳]$'))"""

_MD = r""",
mdrow AS (
  SELECT doc_id, line_no, page_idx, (page_idx + 1 - CASE WHEN (doc_id + page_idx) % 7 = 0 THEN 1 ELSE 0 END)::varchar AS num, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY line_no) = 1 AS first, line, has_m FROM L),
mdline AS (
  SELECT doc_id, line_no, page_idx, (CASE WHEN first AND page_idx % 2 = 0 THEN '# C' || page_idx || chr(10) || chr(10) ELSE '' END) || (CASE WHEN first THEN '<!--p.' || num || '-->' || chr(10) || chr(10) ELSE '' END)
         || 'x' || left(regexp_replace(line, '[^A-Za-z ]', '', 'g'), 40) || (CASE WHEN (doc_id + line_no) % 11 = 0 THEN '<sub>x</sub>' WHEN (doc_id + line_no) % 23 = 0 THEN '<!--?quote-->' ELSE '' END)
         || (CASE WHEN has_m THEN '[^' || (line_no + 1 - CASE WHEN line_no % 9 = 8 THEN 1 ELSE 0 END) || ']' ELSE '' END) AS md,
         CASE WHEN has_m AND (doc_id + line_no) % 10 <> 0 THEN '[^' || (line_no + 1) || ']: <!--p.' || num || '--> note ' || line_no END AS note FROM mdrow),
mdbody AS MATERIALIZED (SELECT doc_id, (CASE WHEN min(page_idx) % 2 = 1 THEN '# C' || chr(10) || chr(10) ELSE '' END) || string_agg(md, chr(10) || chr(10) ORDER BY line_no) AS body,
  coalesce(string_agg(note, chr(10) || chr(10) ORDER BY line_no), '') AS notes FROM mdline GROUP BY doc_id),
md AS MATERIALIZED (SELECT doc_id, body, notes, (CASE WHEN doc_id % 4 <> 0 THEN '---' || chr(10) || 'title: T' || doc_id || chr(10) || (CASE WHEN doc_id % 3 = 0 THEN '标签: x' || chr(10) ELSE '' END) || '---' || chr(10) ELSE '' END)
  || body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 注释' || chr(10) || chr(10) || notes AS text FROM mdbody),
refs AS MATERIALIZED (SELECT doc_id, (unnest(range(1, len(r) + 1)) - 1)::bigint AS pos, unnest(r)::bigint AS n FROM (SELECT doc_id, regexp_extract_all(body, '\[\^(\d+)\]', 1) AS r FROM md)),
defs AS MATERIALIZED (SELECT doc_id, unnest(r)::bigint AS n FROM (SELECT doc_id, regexp_extract_all(notes, '(?m)^\[\^(\d+)\]:', 1) AS r FROM md)),
anchor AS MATERIALIZED (SELECT doc_id, (unnest(range(1, len(r) + 1)) - 1)::bigint AS pos, unnest(r) AS anchor FROM (SELECT doc_id, regexp_extract_all(body, '<!--p\.([^>]+?)-->', 1) AS r FROM md))"""

_CHAPTERS = r""",
blk AS (SELECT doc_id, (unnest(range(1, len(s) + 1)) - 1)::bigint AS pos, unnest(s) AS md FROM (SELECT doc_id, string_split(trim(body, chr(10) || ' '), chr(10) || chr(10)) AS s FROM md)),
cb AS MATERIALIZED (SELECT *, sum(starts_with(md, '# ')::bigint) OVER w AS chapter, coalesce(last_value(own IGNORE NULLS) OVER w, '1') AS page,
  coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '1') AS page_before
  FROM (SELECT *, nullif(regexp_extract_all(md, '<!--p\.(-?\d+)-->', 1)[-1], '') AS own FROM blk) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""

_RENDER = r""", walk AS (SELECT doc_id, src_page AS head_page, src_index AS head_index, dst_page AS page_idx, dst_index AS index, 1::bigint AS depth FROM edge e
             WHERE NOT EXISTS (SELECT 1 FROM edge t WHERE t.doc_id = e.doc_id AND t.dst_page = e.src_page AND t.dst_index = e.src_index)
             UNION ALL SELECT w.doc_id, head_page, head_index, e.dst_page, e.dst_index, depth + 1 FROM walk w JOIN edge e ON e.doc_id = w.doc_id AND e.src_page = w.page_idx AND e.src_index = w.index),
           o AS (SELECT doc_id, page_idx AS head_page, index AS head_index, page_idx, index, 0 AS depth FROM body b WHERE NOT EXISTS (SELECT 1 FROM edge t WHERE t.doc_id = b.doc_id AND t.dst_page = b.page_idx AND t.dst_index = b.index)
             UNION ALL SELECT doc_id, head_page, head_index, page_idx, index, depth FROM walk),
           c AS (SELECT o.*, unnest(range(1, length(text) + 1)) AS k, unnest(string_split(text, '')) AS ch FROM o JOIN body USING (doc_id, page_idx, index)),
           u AS (SELECT *, regexp_matches(ch, '^[①-⑳]$') AS m, sum(regexp_matches(ch, '^[①-⑳]$')::bigint) OVER (PARTITION BY doc_id ORDER BY head_page, head_index, depth, k) AS nth FROM c),
           x AS (SELECT doc_id, head_page, head_index, page_idx, index, depth, string_agg(CASE WHEN m THEN '[^' || nth || ']' ELSE ch END, '' ORDER BY k) AS text FROM u GROUP BY ALL),
           t AS (SELECT * FROM (SELECT *, bool_or(n_lines >= 2) OVER (PARTITION BY doc_id, page_idx) AS several FROM body WHERE type = 'text') WHERE (n_lines >= 2) = several),
           a AS (SELECT doc_id, page_idx, x0 AS l, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY count(*) DESC, x0) AS r FROM t GROUP BY doc_id, page_idx, x0),
           b AS (SELECT doc_id, page_idx, x1 AS r1, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY count(*) DESC, x1 DESC) AS r FROM t GROUP BY doc_id, page_idx, x1),
           h AS (SELECT doc_id, page_idx, index, level, CASE WHEN regexp_matches(text, '^第一章') THEN 1 WHEN regexp_matches(text, '^一、') THEN 3 WHEN regexp_matches(text, '^1[.]') THEN 5 END AS shape FROM body WHERE type = 'title'),
           f AS (SELECT doc_id FROM h GROUP BY doc_id HAVING count(DISTINCT level) = 1 AND count(*) > 5),
           s AS (SELECT doc_id, shape, row_number() OVER (PARTITION BY doc_id ORDER BY shape) AS rank FROM (SELECT DISTINCT doc_id, shape FROM h WHERE shape IS NOT NULL)),
           lev AS (SELECT h.doc_id, page_idx, index, CASE WHEN f.doc_id IS NOT NULL AND rank IS NOT NULL THEN least(rank + 1, 6) ELSE level END AS lv FROM h LEFT JOIN f ON f.doc_id = h.doc_id LEFT JOIN s ON s.doc_id = h.doc_id AND s.shape = h.shape),
           y AS (SELECT x.*, CASE WHEN depth > 0 THEN '<!--p.' || pnum || '-->' ELSE '' END || CASE WHEN type = 'title' THEN repeat('#', lv::int) || ' ' || trim(x.text)
                   WHEN n_lines >= 2 AND x0 - l > 10 THEN '<!--?' || CASE WHEN abs(x0 - l - (r1 - x1)) < 12 AND n_lines <= 2 THEN 'center' ELSE 'quote' END || '--> ' || x.text ELSE x.text END AS md
                 FROM x JOIN body USING (doc_id, page_idx, index) LEFT JOIN pnum USING (doc_id, page_idx) LEFT JOIN lev USING (doc_id, page_idx, index)
                 LEFT JOIN (SELECT * FROM a WHERE r = 1) a USING (doc_id, page_idx) LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (doc_id, page_idx)),
rendered AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY head_page, head_index) AS pos, head_page, head_index, md, pages
  FROM (SELECT doc_id, head_page, head_index, trim(string_agg(md, '' ORDER BY depth)) AS md, list(DISTINCT page_idx) FILTER (depth > 0 AND md <> '') AS pages FROM y GROUP BY doc_id, head_page, head_index) WHERE md <> '')"""

_SEAMS = r""",
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS k, md, trim(md, chr(32) || chr(9) || chr(10) || chr(13)) AS bare FROM (
  SELECT f.doc_id, first_pos AS pos, 0 AS sub, '<!--p.' || pnum || '-->' AS md
  FROM (SELECT doc_id, head_page, min(pos) AS first_pos FROM rendered GROUP BY doc_id, head_page) f
  LEFT JOIN (SELECT doc_id, head_page, min(pos) AS seam_pos FROM (SELECT doc_id, pos, unnest(pages) AS head_page FROM rendered) GROUP BY doc_id, head_page) s ON s.doc_id = f.doc_id AND s.head_page = f.head_page
  JOIN pnum ON pnum.doc_id = f.doc_id AND pnum.page_idx = f.head_page
  WHERE f.head_page > 0 AND (seam_pos IS NULL OR seam_pos > first_pos)
  UNION ALL SELECT doc_id, pos, 1, md FROM rendered)),
solid AS (SELECT *, CASE WHEN NOT regexp_matches(md, '^\s*(!\[|\*|<small>)') THEN k END AS sk, lag(bare) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM lines),
near AS (SELECT *, first_value(sk IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
  try_cast(regexp_extract(bare, '^<!--p\.(-?\d+)-->$', 1) AS bigint) AS page FROM solid),
anch AS MATERIALIZED (SELECT n.doc_id, n.k, n.after, n.after - n.k - 1 AS floats, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.k) AS a,
  n.before <> '' AND NOT regexp_matches(n.before, '^(#|<!--|!\[|\*|<small>)') AND rtrim(regexp_replace(n.before, '(\[\^\d+\]\s*)+$', '')) <> ''
  AND right(rtrim(regexp_replace(n.before, '(\[\^\d+\]\s*)+$', '')), 1) NOT IN ('.', '!', '?', '…', ':', ';') AS open, n.before <> '' AND regexp_replace(n.before, '(\[\^\d+\]\s*)+$', '') = '' AS noted
  FROM near n JOIN lines x ON x.doc_id = n.doc_id AND x.k = n.after
  WHERE n.page > 0 AND n.k > 0 AND x.bare <> '' AND NOT regexp_matches(x.bare, '^(#|<!--|!\[|\*|<small>)') AND NOT regexp_matches(x.bare, '^\s*(第[一二三四五六七八九十百]+[章节編编篇]|[一二三四五六七八九十]+[、．.]|[（(]\s*\d+\s*[)）]|\d+\s*[.．、]|附录|绪论|结语|参考|思考题|本章|学术)')),
fold AS (SELECT doc_id, 0::bigint AS a, 0::bigint AS k, -1::bigint AS after, 0::bigint AS floats, false AS joined FROM anch WHERE a = 1
  UNION ALL SELECT doc_id, a, CASE WHEN j THEN k ELSE was_k END, CASE WHEN j THEN after ELSE was_after END, CASE WHEN j THEN floats ELSE was_floats END, j FROM (
    SELECT n.doc_id, n.a, n.k, n.after, n.floats, f.k AS was_k, f.after AS was_after, f.floats AS was_floats,
           CASE WHEN f.after = n.k - 1 THEN f.floats = 0 AND (n.open OR n.noted) ELSE n.open END AS j
    FROM fold f JOIN anch n ON n.doc_id = f.doc_id AND n.a = f.a + 1)),
role AS (SELECT doc_id, k, true AS anchor FROM fold WHERE joined UNION ALL SELECT doc_id, after, false FROM fold WHERE joined),
stand AS (SELECT l.*, anchor, last_value(CASE WHEN anchor IS NULL THEN l.k END IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.k ROWS UNBOUNDED PRECEDING) AS stand FROM lines l LEFT JOIN role r ON r.doc_id = l.doc_id AND r.k = l.k),
headed AS (SELECT *, CASE WHEN anchor IS NULL THEN k WHEN anchor THEN stand ELSE last_value(CASE WHEN anchor THEN stand END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) END AS head FROM stand),
joined AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY head) AS pos, md FROM (SELECT doc_id, head, CASE WHEN count(*) > 1 THEN string_agg(bare, '' ORDER BY k) ELSE min(md) END AS md FROM headed GROUP BY doc_id, head))"""

_FILES = r""",
files AS (SELECT doc_id AS file_id, source || '.pdf' AS name, n_chars % 701 + 1 AS pages, n_chars * 300000 AS bytes FROM documents)"""

_B, _N, _P, _E = _BODY, _NOTES, _PNUM, _EDGES

_SQL: dict[str, tuple[str, str]] = {
    "body_blocks": (_B, "SELECT doc_id, page_idx, index, type, level, text FROM body"),
    "footnote_blocks": (_N, "SELECT doc_id, page_idx, ord, text FROM fnote"),
    "type_histogram": (
        _B + _N + _P,
        """SELECT doc_id, zone, key, n, row_number() OVER (PARTITION BY doc_id, zone ORDER BY n DESC, fp, fo) AS rank FROM (
           SELECT doc_id, zone, key, count(*) AS n, min(page_idx * 100 + ord) // 100 AS fp, min(page_idx * 100 + ord) % 100 AS fo FROM (
             SELECT doc_id, 'body' AS zone, type AS key, page_idx, index AS ord FROM body UNION ALL SELECT doc_id, 'discarded', 'page_footnote', page_idx, ord FROM fnote
             UNION ALL SELECT doc_id, 'discarded', 'page_number', page_idx, 9 FROM own) GROUP BY ALL)""",
    ),
    "inventory": (
        _B + _N + _P,
        """SELECT p.doc_id, n_pages, first_pnum, last_pnum, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_notes, 0) AS n_notes
           FROM (SELECT doc_id, count(*) AS n_pages, arg_min(pnum, page_idx) AS first_pnum, arg_max(pnum, page_idx) AS last_pnum FROM pnum GROUP BY doc_id) p
           LEFT JOIN (SELECT doc_id, count(*) AS n_blocks FROM body GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_notes FROM fnote GROUP BY doc_id) USING (doc_id)""",
    ),
    "orphan_preview": (
        _N + _P,
        """SELECT doc_id, page_idx, ord, pnum, text FROM (SELECT doc_id, page_idx, ord, pnum, left(text, 60) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, ord) AS k
           FROM fnote LEFT JOIN pnum USING (doc_id, page_idx) WHERE text <> '' AND NOT regexp_matches(text, '^[①-⑳]') AND text NOT LIKE '收稿日期%') WHERE k <= 12""",
    ),
    "alignment_rows": (_B + _N + _P + _ALIGN, "SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM aligned) WHERE n <= 24 OR marks <> numbered"),
    "upload_batches": (_FILES, "SELECT file_id, (row_number() OVER (ORDER BY file_id) - 1) // 50 AS batch FROM files"),
    "needs_ocr": (
        "",
        r""", f AS (SELECT doc_id AS file_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT file_id, len(s) AS n, unnest(range(0, len(s))) AS page, unnest(s) AS text FROM f),
           c AS (SELECT file_id, sum(length(regexp_replace(text, '\s', '', 'g')))::bigint AS n_chars FROM p WHERE page IN (0, n // 2, n - 1) GROUP BY file_id)
           SELECT file_id, n_chars, n_chars < 120 AS is_ocr FROM c""",
    ),
    "context_breaks": (
        _B,
        r""", n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY page_idx, index) AS nxt FROM body)
           SELECT doc_id, page_idx, index, right(text, 10) AS before FROM n
           WHERE nxt IS NOT NULL AND text <> '' AND nxt <> '' AND NOT regexp_matches(text, '^(#|<!--|!\[|\*|<small>)') AND NOT regexp_matches(nxt, '^(#|<!--|!\[|\*|<small>)')
             AND rtrim(text) <> '' AND right(rtrim(text), 1) NOT IN ('.', '!', '?', '…', ':', ';')
             AND NOT regexp_matches(nxt, '^\s*(第[一二三四五六七八九十百]+[章节編编篇]|[一二三四五六七八九十]+[、．.]|[（(]\s*\d+\s*[)）]|\d+\s*[.．、]|附录|绪论|结语|参考|思考题|本章|学术)')""",
    ),
    "cut_text": (_B, "SELECT doc_id, page_idx, index, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 20) || '……〔中略 ' || (length(text) - 40) || ' 字〕……' || right(text, 20) END AS text FROM body"),
    "header_counts": (_P, "SELECT * FROM (SELECT doc_id, '- ' || v || ' -' AS key, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page_idx)) AS rank FROM own GROUP BY doc_id, v) WHERE rank <= 6"),
    "media_counts": (_B, "SELECT doc_id, 'image' AS type, count(*) AS n FROM body WHERE type = 'title' GROUP BY doc_id"),
    "confidence": (_B, "SELECT doc_id, count(*) AS n_spans, min(score) AS min_score, count(*) FILTER (score < 0.9::double) AS n_low FROM body GROUP BY doc_id"),
    "page_number_map": (_P, "SELECT doc_id, page_idx, pnum FROM pnum"),
    "margins": (
        _B,
        """, t AS (SELECT * FROM (SELECT *, bool_or(n_lines >= 2) OVER (PARTITION BY doc_id, page_idx) AS several FROM body WHERE type = 'text') WHERE (n_lines >= 2) = several),
           a AS (SELECT doc_id, page_idx, x0, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY count(*) DESC, x0) AS r FROM t GROUP BY doc_id, page_idx, x0),
           b AS (SELECT doc_id, page_idx, x1, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY count(*) DESC, x1 DESC) AS r FROM t GROUP BY doc_id, page_idx, x1)
           SELECT a.doc_id, a.page_idx, x0 AS left, x1 AS right FROM a JOIN b USING (doc_id, page_idx) WHERE a.r = 1 AND b.r = 1""",
    ),
    "marker_sequence": (
        _B + _P + _PAGE_TEXT,
        """, m AS (SELECT * FROM (SELECT doc_id, page_idx, text, (unnest(range(1, length(text) + 1)) - 1)::bigint AS char_pos, unnest(string_split(text, '')) AS mark FROM ptext) WHERE regexp_matches(mark, '^[①-⑳]$'))
           SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, char_pos) AS seq, page_idx, pnum, char_pos, mark,
                  replace(substr(text, greatest(char_pos - 18, 0) + 1, least(char_pos, 18)) || '【' || mark || '】' || substr(text, char_pos + 2, 14), chr(9), ' ') AS context
           FROM m LEFT JOIN pnum USING (doc_id, page_idx)""",
    ),
    "align_pages": (_B + _N + _P + _ALIGN, "SELECT * FROM aligned"),
    "align_mismatches": (_B + _N + _P + _ALIGN, "SELECT * FROM aligned WHERE marks <> numbered"),
    "align_rollup": (_B + _N + _P + _ALIGN, "SELECT doc_id, page_idx, grouping(doc_id, page_idx)::bigint AS level, sum(marks)::bigint AS marks, sum(notes)::bigint AS notes, sum(numbered)::bigint AS numbered FROM aligned GROUP BY ROLLUP (doc_id, page_idx)"),
    "enum_runs": (
        _B + _MARKS,
        """, f AS (SELECT *, CASE WHEN ascii(ch) = lag(ascii(ch)) OVER w + 1 AND char_pos - lag(char_pos) OVER w < 40 THEN 0 ELSE 1 END AS new FROM marks WINDOW w AS (PARTITION BY doc_id, page_idx, index ORDER BY char_pos)),
           g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_idx, index ORDER BY char_pos) AS run FROM f),
           r AS (SELECT doc_id, page_idx, index, text, count(*) AS n, min(char_pos) AS start FROM g GROUP BY doc_id, page_idx, index, text, run)
           SELECT doc_id, page_idx, index, start, n, substr(text, greatest(start - 24, 0) + 1, least(start, 24) + 60) AS shown FROM r
           WHERE n >= 3 OR n = 2 AND regexp_matches(substr(text, greatest(start - 12, 0) + 1, least(start, 12)), '[：:]')""",
    ),
    "misfiled_notes": (_N + _P, r"SELECT doc_id, page_idx, ord, pnum, left(text, 60) AS text FROM fnote LEFT JOIN pnum USING (doc_id, page_idx) WHERE regexp_matches(text, '^\d+\s*[.．、]')"),
    "orphan_notes": (_N + _P, "SELECT doc_id, page_idx, ord, pnum, left(text, 60) AS text FROM fnote LEFT JOIN pnum USING (doc_id, page_idx) WHERE text <> '' AND NOT regexp_matches(text, '^[①-⑳]') AND text NOT LIKE '收稿日期%'"),
    "meta_notes": (_N + _P, "SELECT doc_id, page_idx, ord, pnum, text FROM fnote LEFT JOIN pnum USING (doc_id, page_idx) WHERE text LIKE '收稿日期%'"),
    "break_candidates": (
        _B + _P + _E,
        r""", e AS (SELECT pg.doc_id, pg.page_idx, pnum, last_t, last_i, first_t FROM pg LEFT JOIN pnum USING (doc_id, page_idx)
              LEFT JOIN (SELECT doc_id, page_idx, arg_max(text, index) AS last_t, max(index) AS last_i, arg_min(text, index) AS first_t FROM body WHERE type = 'text' GROUP BY ALL) USING (doc_id, page_idx)),
           n AS (SELECT *, lead(page_idx) OVER w AS np, lead(pnum) OVER w AS nn, ltrim(lead(first_t) OVER w) AS nt, rtrim(last_t) AS lt FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx))
           SELECT doc_id, page_idx, pnum, right(lt, 26) AS before, left(nt, 26) AS after FROM n
           WHERE np = page_idx + 1 AND pnum > 0 AND nn > 0 AND lt <> '' AND nt <> '' AND right(lt, 1) NOT IN ('.', '!', '?', '…', ':', ';')
             AND NOT regexp_matches(nt, '^\s*(第[一二三四五六七八九十百]+[章节編编篇]|[一二三四五六七八九十]+[、．.]|[（(]\s*\d+\s*[)）]|\d+\s*[.．、]|附录|绪论|结语|参考|思考题|本章|学术)')
             AND NOT EXISTS (SELECT 1 FROM edge x WHERE x.doc_id = n.doc_id AND x.src_page = n.page_idx AND x.src_index = n.last_i)""",
    ),
    "same_page_merges": (
        _B + _P + _E,
        """SELECT e.doc_id, e.src_page AS page_idx, pnum, src_index, dst_index, coalesce(right(a.text, 26), '?') AS before, coalesce(left(b.text, 34), '?') AS after
           FROM edge e LEFT JOIN body a ON a.doc_id = e.doc_id AND a.page_idx = src_page AND a.index = src_index LEFT JOIN body b ON b.doc_id = e.doc_id AND b.page_idx = dst_page AND b.index = dst_index
           LEFT JOIN pnum p ON p.doc_id = e.doc_id AND p.page_idx = src_page WHERE src_page = dst_page""",
    ),
    "flat_titles": (_B, "SELECT doc_id, count(*) AS n_titles, min(level) AS level FROM body WHERE type = 'title' GROUP BY doc_id HAVING count(DISTINCT level) = 1 AND count(*) > 5"),
    "truncation": (
        _B + _P,
        """, e AS (SELECT doc_id, arg_min(pnum, page_idx) AS first_pnum, arg_max(pnum, page_idx) AS last_pnum, max(page_idx) AS page_idx FROM pnum GROUP BY doc_id),
           t AS (SELECT e.*, coalesce(rtrim((SELECT arg_max(text, index) FROM body b WHERE b.doc_id = e.doc_id AND b.page_idx = e.page_idx AND text <> '')), '') AS tail FROM e),
           s AS (SELECT *, tail <> '' AND right(tail, 1) NOT IN ('.', '!', '?', '…', ':', ';') AS stops_open FROM t)
           SELECT doc_id, first_pnum, last_pnum, stops_open, right(tail, 40) AS tail FROM s WHERE first_pnum > 1 OR stops_open""",
    ),
    "formula_noise": (
        _B,
        r""", t AS (SELECT doc_id, string_agg(text, '' ORDER BY line_no) AS text FROM body GROUP BY doc_id),
           k AS (SELECT doc_id, 'inline' AS kind, len(regexp_extract_all(text, '\$[^$]{1,40}\$'))::bigint AS n FROM t UNION ALL SELECT doc_id, 'percent', len(regexp_extract_all(text, '\\%')) FROM t
             UNION ALL SELECT doc_id, 'tilde', len(regexp_extract_all(text, '\\sim')) FROM t UNION ALL SELECT doc_id, 'operator', len(regexp_extract_all(text, '\\(?:times|approx|pm|circ|cdot)')) FROM t
             UNION ALL SELECT doc_id, 'script', len(regexp_extract_all(text, '[\^_]\{')) FROM t)
           SELECT * FROM k WHERE n > 0""",
    ),
    "punctuation": (
        _B,
        """, c AS (SELECT doc_id, sum(len(regexp_extract_all(text, '[一-鿿]')))::bigint AS n_cjk, sum(length(text) - length(translate(text, '。，、；：？！', '')))::bigint AS n_marks FROM body GROUP BY doc_id),
           r AS (SELECT *, CASE WHEN n_cjk > 0 THEN n_marks / n_cjk ELSE 0.0 END::double AS x FROM c)
           SELECT doc_id, n_cjk, n_marks, round(x, 6) AS ratio, CASE WHEN x < 0.02 THEN 'lost' WHEN x < 0.05 THEN 'thin' ELSE 'complete' END AS band FROM r""",
    ),
    "merge_edges": (_E, "SELECT * FROM edge"),
    "merge_chains": (
        _E,
        """, walk AS (SELECT doc_id, src_page AS head_page, src_index AS head_index, dst_page AS page_idx, dst_index AS index, 1::bigint AS depth FROM edge e
             WHERE NOT EXISTS (SELECT 1 FROM edge t WHERE t.doc_id = e.doc_id AND t.dst_page = e.src_page AND t.dst_index = e.src_index)
             UNION ALL SELECT w.doc_id, head_page, head_index, e.dst_page, e.dst_index, depth + 1 FROM walk w JOIN edge e ON e.doc_id = w.doc_id AND e.src_page = w.page_idx AND e.src_index = w.index)
           SELECT * FROM walk""",
    ),
    "heading_levels": (
        _B,
        """, t AS (SELECT doc_id, page_idx, index, level, CASE WHEN regexp_matches(text, '^第一章') THEN 1 WHEN regexp_matches(text, '^一、') THEN 3 WHEN regexp_matches(text, '^1\\.') THEN 5 END AS shape FROM body WHERE type = 'title'),
           f AS (SELECT doc_id FROM t GROUP BY doc_id HAVING count(DISTINCT level) = 1 AND count(*) > 5),
           s AS (SELECT doc_id, shape, row_number() OVER (PARTITION BY doc_id ORDER BY shape) AS rank FROM (SELECT DISTINCT doc_id, shape FROM t WHERE shape IS NOT NULL))
           SELECT t.doc_id, page_idx, index, CASE WHEN f.doc_id IS NOT NULL AND rank IS NOT NULL THEN least(rank + 1, 6) ELSE level END::bigint AS level
           FROM t LEFT JOIN f ON f.doc_id = t.doc_id LEFT JOIN s ON s.doc_id = t.doc_id AND s.shape = t.shape""",
    ),
    "footnotes_expanded": (
        _N + _P,
        r""", s AS (SELECT doc_id, page_idx, ord, regexp_extract(text, '^[①-⑳]+') AS m, trim(regexp_replace(regexp_replace(text, '^[①-⑳]+', ''), '\s{2,}', ' ', 'g')) AS note FROM fnote WHERE text <> '' AND text NOT LIKE '收稿日期%'),
           x AS (SELECT doc_id, page_idx, ord, note, unnest(CASE WHEN m = '' THEN [''] ELSE string_split(m, '') END) AS c, unnest(range(1, greatest(length(m), 1) + 1)) AS sub FROM s),
           y AS (SELECT *, CASE WHEN c <> '' THEN ascii(c) - 9312 END::bigint AS circ FROM x),
           z AS (SELECT *, CASE WHEN bool_and(circ IS NOT NULL) OVER (PARTITION BY doc_id, page_idx) THEN circ ELSE 0 END AS k FROM y)
           SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, k, ord, sub) AS n, page_idx, pnum, circ, note FROM z JOIN pnum USING (doc_id, page_idx)""",
    ),
    "marker_renumber": (
        _B,
        """, c AS (SELECT doc_id, page_idx, index, unnest(range(1, length(text) + 1)) AS k, unnest(string_split(text, '')) AS ch FROM body),
           n AS (SELECT *, regexp_matches(ch, '^[①-⑳]$') AS m, sum(regexp_matches(ch, '^[①-⑳]$')::bigint) OVER (PARTITION BY doc_id ORDER BY page_idx, index, k) AS seq FROM c),
           u AS (SELECT *, m AND seq % 9 <> 0 AS used, sum((m AND seq % 9 <> 0)::bigint) OVER (PARTITION BY doc_id ORDER BY page_idx, index, k) AS nth FROM n)
           SELECT doc_id, page_idx, index, string_agg(CASE WHEN used THEN '[^' || nth || ']' ELSE ch END, '' ORDER BY k) AS text, count(*) FILTER (m) AS n_marks, count(*) FILTER (used) AS n_used FROM u GROUP BY doc_id, page_idx, index""",
    ),
    "indent_blocks": (
        _B,
        """, t AS (SELECT * FROM (SELECT *, bool_or(n_lines >= 2) OVER (PARTITION BY doc_id, page_idx) AS several FROM body WHERE type = 'text') WHERE (n_lines >= 2) = several),
           a AS (SELECT doc_id, page_idx, x0 AS l, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY count(*) DESC, x0) AS r FROM t GROUP BY doc_id, page_idx, x0),
           b AS (SELECT doc_id, page_idx, x1 AS r1, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY count(*) DESC, x1 DESC) AS r FROM t GROUP BY doc_id, page_idx, x1)
           SELECT doc_id, page_idx, index, CASE WHEN abs(x0 - l - (r1 - x1)) < 12 AND n_lines <= 2 THEN 'center' ELSE 'quote' END AS kind, round_even(x0 - l, 0)::bigint AS left_indent, round_even(r1 - x1, 0)::bigint AS right_indent
           FROM body JOIN a USING (doc_id, page_idx) JOIN b USING (doc_id, page_idx) WHERE a.r = 1 AND b.r = 1 AND n_lines >= 2 AND type = 'text' AND x0 - l > 10""",
    ),
    "rendered_blocks": (_B + _P + _E + _RENDER, "SELECT doc_id, pos, head_page, head_index, md FROM rendered"),
    "seam_join": (_B + _P + _E + _RENDER + _SEAMS, "SELECT doc_id, pos, md FROM joined"),
    "join_lines": (
        "",
        r""", j AS (SELECT doc_id, page_idx, line_no, trim(regexp_replace(line, '[.,!?|]+\s*$', '')) AS line FROM L),
           p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, page_idx ORDER BY line_no) AS before FROM (SELECT * FROM j WHERE line <> ''))
           SELECT pg.doc_id, pg.page_idx, coalesce(string_agg(CASE WHEN regexp_matches(before, '[0-9A-Za-z]$') AND regexp_matches(line, '^[0-9A-Za-z]') THEN ' ' ELSE '' END || line, '' ORDER BY line_no), '') AS text
           FROM pg LEFT JOIN p USING (doc_id, page_idx) GROUP BY pg.doc_id, pg.page_idx""",
    ),
    "strip_tags": (_B, "SELECT doc_id, page_idx, index, text FROM body"),
    "tidy_footnotes": (
        _N,
        r"""SELECT doc_id, page_idx, ord, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '－', '-'),
              '\s*:\s*([㐀-䶿一-鿿《（])', '：\1', 'g'), '([㐀-䶿一-鿿》）])\s*:\s*', '\1：', 'g'), '([㐀-䶿一-鿿》）])\s*;\s*', '\1；', 'g'), '\s*·\s*', '·', 'g'),
              '\(\s*([^()]*[㐀-䶿一-鿿][^()]*?)\s*\)', '（\1）', 'g'), '\s+([，。、；：》】」』？！])', '\1', 'g'), '([《【「『])\s+', '\1', 'g'), '\s{2,}', ' ', 'g')) AS text FROM fnote""",
    ),
    "significant": (_B, "SELECT doc_id, page_idx, index, regexp_replace(text, '[^㐀-䶿一-鿿A-Za-z0-9①-⑳□〈〉〔〕]', '', 'g') AS text FROM body"),
    "verify_counts": (
        _MD,
        """SELECT md.doc_id, coalesce(n_refs, 0) AS n_refs, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_defs, 0) AS n_defs, len(regexp_extract_all(text, '</?su[bp]>'))::bigint AS n_tags, coalesce(n_anchors, 0) AS n_anchors
           FROM md LEFT JOIN (SELECT doc_id, count(*) AS n_refs, count(DISTINCT n) AS n_distinct FROM refs GROUP BY doc_id) USING (doc_id)
           LEFT JOIN (SELECT doc_id, count(*) AS n_defs FROM defs GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_anchors FROM anchor GROUP BY doc_id) USING (doc_id)""",
    ),
    "verify_yaml": (_MD, "SELECT doc_id, 'yaml' AS rule FROM md WHERE doc_id % 4 <> 0 AND doc_id % 7 = 0"),
    "verify_problems": (
        _MD,
        """, fall AS (SELECT doc_id, anchor::bigint < lag(anchor::bigint) OVER (PARTITION BY doc_id ORDER BY pos) AS falls FROM anchor),
           rep AS (SELECT doc_id, anchor || 'x' || count(*) AS shown FROM anchor GROUP BY doc_id, anchor HAVING count(*) > 1),
           dup AS (SELECT doc_id, n FROM refs GROUP BY doc_id, n HAVING count(*) > 1)
           SELECT doc_id, 'no_frontmatter' AS rule, '' AS detail FROM md WHERE doc_id % 4 = 0
           UNION ALL SELECT doc_id, 'property_name', '标签=tags' FROM md WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0
           UNION ALL SELECT doc_id, 'unreferenced', string_agg(n::varchar, ',' ORDER BY n) FROM (SELECT DISTINCT d.doc_id, d.n FROM defs d ANTI JOIN refs r ON r.doc_id = d.doc_id AND r.n = d.n) GROUP BY doc_id
           UNION ALL SELECT doc_id, 'undefined', string_agg(n::varchar, ',' ORDER BY n) FROM (SELECT DISTINCT r.doc_id, r.n FROM refs r ANTI JOIN defs d ON r.doc_id = d.doc_id AND r.n = d.n) GROUP BY doc_id
           UNION ALL SELECT doc_id, 'not_contiguous', count(*)::varchar FROM defs GROUP BY doc_id HAVING NOT (count(*) = count(DISTINCT n) AND min(n) = 1 AND max(n) = count(*))
           UNION ALL SELECT doc_id, 'repeated', string_agg(n::varchar, ',' ORDER BY n) FROM dup GROUP BY doc_id
           UNION ALL SELECT doc_id, 'tags', len(regexp_extract_all(text, '</?su[bp]>'))::varchar FROM md WHERE regexp_matches(text, '</?su[bp]>')
           UNION ALL SELECT doc_id, 'pending_quote', len(regexp_extract_all(text, '<!--\\?quote-->'))::varchar FROM md WHERE contains(text, '<!--?quote-->')
           UNION ALL SELECT doc_id, 'repeated_anchor', string_agg(shown, ',' ORDER BY shown) FROM rep GROUP BY doc_id
           UNION ALL SELECT doc_id, 'falling_anchor', count(*)::varchar FROM fall WHERE falls GROUP BY doc_id""",
    ),
    "chapters": (
        _MD + _CHAPTERS,
        """SELECT doc_id, chapter::bigint AS chapter, trim(substr(arg_min(md, pos), 3)) AS title, arg_min(page_before, pos) AS start_page, arg_max(page, pos) AS end_page,
                  arg_min(page_before, pos) || '-' || arg_max(page, pos) AS pages FROM cb WHERE chapter > 0 GROUP BY doc_id, chapter""",
    ),
    "chapter_notes": (
        _MD + _CHAPTERS,
        r""", u AS (SELECT doc_id, chapter, pos, unnest(r)::bigint AS n, unnest(range(1, len(r) + 1)) AS k FROM (SELECT *, regexp_extract_all(md, '\[\^(\d+)\]', 1) AS r FROM cb WHERE chapter > 0)),
           f AS (SELECT doc_id, chapter, n, min(pos * 1000 + k) AS place FROM u GROUP BY ALL),
           d AS (SELECT doc_id, line_no + 1 AS n, (page_idx + 1 - CASE WHEN (doc_id + page_idx) % 7 = 0 THEN 1 ELSE 0 END)::varchar AS pnum, 'note ' || line_no AS note FROM L WHERE has_m AND (doc_id + line_no) % 10 <> 0)
           SELECT f.doc_id, chapter::bigint AS chapter, f.n, row_number() OVER (PARTITION BY f.doc_id, chapter ORDER BY place) AS new, pnum, note, note IS NULL AS missing FROM f LEFT JOIN d ON d.doc_id = f.doc_id AND d.n = f.n""",
    ),
    "upload_parts": (
        _FILES,
        """, r AS (SELECT *, unnest(range(1, pages + 1, 200)) AS first FROM files), q AS (SELECT *, least(first + 199, pages) AS last FROM r),
           h AS (SELECT *, (SELECT min(k) FROM range(0, 21) t(k) WHERE ceil((last - first + 1) / pow(2, k))::bigint * bytes::hugeint <= 209715200::hugeint * pages) AS k FROM q),
           z AS (SELECT *, greatest(ceil((last - first + 1) / pow(2, coalesce(k, 20)))::bigint, 1) AS size FROM h),
           p AS (SELECT *, unnest(range(first, last + 1, size)) AS page_start FROM z), e AS (SELECT *, least(page_start + size - 1, last) AS page_end FROM p)
           SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY page_start) AS part, page_start, page_end, page_end - page_start + 1 AS pages,
                  CASE WHEN count(*) OVER (PARTITION BY file_id) = 1 THEN name ELSE regexp_replace(name, '[.][^.]*$', '') || '_p' || lpad(page_start::varchar, 4, '0') || '-' || lpad(page_end::varchar, 4, '0') || '.pdf' END AS upload_name,
                  (page_end - page_start + 1) * bytes::hugeint > 209715200::hugeint * e.pages AS oversize FROM e""",
    ),
    "unique_names": (
        _FILES,
        """SELECT file_id, CASE WHEN k = 1 THEN name ELSE left(name, -4) || '.id' || file_id % 5 || '.' || (1 + row_number() OVER (PARTITION BY lower(name), file_id % 5, k = 1 ORDER BY file_id)) || '.pdf' END AS name
           FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY file_id) AS k FROM files)""",
    ),
    "poll_outcomes": (
        "",
        """, s AS (SELECT user_id AS batch, event_id % 3 AS file, arg_max(CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'done' END, event_id) AS state, count(*) AS n, min(epoch(ts)::bigint) AS a, max(epoch(ts)::bigint) AS b FROM events GROUP BY ALL)
           SELECT batch::bigint AS batch, sum(n)::bigint AS n_polls, CASE WHEN bool_and(state <> 'running') THEN 'done' WHEN max(b) - min(a) >= 2592000 THEN 'timeout' ELSE 'open' END AS outcome FROM s GROUP BY batch""",
    ),
    "usage_daily": (
        "",
        """, u AS (SELECT (ts + INTERVAL 8 HOUR)::date::varchar AS date, user_id || ':' || event_type AS key, event_id % 40 + 1 AS pages, event_id FROM events),
           f AS (SELECT date, arg_min(pages, event_id) AS pages FROM u GROUP BY date, key)
           SELECT date, count(*) AS files, sum(pages)::bigint AS pages, greatest(3000 - count(*), 0) AS files_left, greatest(60000 - sum(pages), 0)::bigint AS pages_left FROM f GROUP BY date""",
    ),
    "batch_states": (
        "",
        """, e AS (SELECT user_id::bigint AS batch, event_id % 3 AS file, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'done' END AS state FROM events),
           s AS (SELECT batch, file, arg_max(state, seq) AS state FROM e GROUP BY batch, file)
           SELECT batch, count(*) AS n, count(*) FILTER (state = 'done') AS n_done, count(*) FILTER (state = 'failed') AS n_failed, bool_and(state IN ('done', 'failed')) AS complete FROM s GROUP BY batch""",
    ),
    "state_changes": (
        "",
        """, e AS (SELECT user_id::bigint AS batch, event_id % 3 AS file, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'done' END AS state FROM events)
           SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY batch, file ORDER BY seq) AS was FROM e) WHERE was IS DISTINCT FROM state""",
    ),
    "layout_blocks": (
        "",
        r""", h AS (SELECT *, left(line, 20) AS a, rtrim(substr(line, 21)) AS b FROM L)
           SELECT doc_id, page_idx, 'body' AS zone, (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY line_no) - 1)::bigint AS ord, idx AS index, 'text' AS type, 1.0::double + idx AS x0, 2::bigint AS n_lines,
                  trim(a || ltrim(b)) AS text FROM h
           UNION ALL SELECT doc_id, page_idx, 'discarded', (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY line_no) - 1)::bigint, 0, 'page_footnote', NULL, 0, 'n ' || left(line, 10) || '1' FROM L WHERE has_m""",
    ),
    "block_list_edges": (
        "",
        """, c AS (SELECT doc_id, page_idx, idx, lead(idx) OVER (PARTITION BY doc_id, page_idx ORDER BY idx) AS nxt FROM L WHERE (doc_id + page_idx) % 3 = 0)
           SELECT doc_id, page_idx AS src_page, idx AS src_index, page_idx AS dst_page, nxt AS dst_index FROM c WHERE nxt IS NOT NULL""",
    ),
    "artifact_choice": (
        "",
        """, c AS (SELECT doc_id, 'layout' AS kind, CASE WHEN doc_id % 2 = 0 THEN 'layout.json' WHEN doc_id % 5 = 0 THEN 'result/layout.json' WHEN doc_id % 3 = 0 THEN 'a_middle.json' ELSE 'result/b_middle.json' END AS path FROM documents
           UNION ALL SELECT doc_id, 'full_md', 'full.md' FROM documents WHERE doc_id % 7 = 0),
           i AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'images' ELSE 'out/images' END AS path FROM documents)
           SELECT doc_id::varchar AS doc, kind, path, length(path) AS size FROM c UNION ALL SELECT doc_id::varchar, 'images', path, length(path) + 6 FROM i""",
    ),
    "media_blocks": (
        "",
        """, m AS (SELECT doc_id, page_idx, line_no, left(regexp_replace(line, '[^A-Za-z]', '', 'g'), 20) AS w FROM L WHERE idx = 1),
           p AS (SELECT *, CASE WHEN line_no % 7 = 0 THEN '<table>' || w || '</table>' WHEN line_no % 3 = 0 THEN '<table><b>' || w || '</table>' END AS html, CASE WHEN line_no % 2 = 0 THEN '![](images/p' || line_no || '.jpg)' END AS image FROM m)
           SELECT doc_id, page_idx, CASE WHEN page_idx % 2 = 0 THEN 'image' ELSE 'table' END AS type,
                  concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 2 = 0 AND w <> '' THEN '*' || w || '*' END, html, image, CASE WHEN html IS NULL AND image IS NULL THEN nullif(w, '') END, CASE WHEN line_no % 4 = 0 AND w <> '' THEN '<small>' || w || '</small>' END) AS md FROM p""",
    ),
    "source_sections": (
        _B + _N + _PAGE_TEXT,
        """SELECT doc_id, 'body' AS section, string_agg(text, '' ORDER BY page_idx) AS text FROM ptext GROUP BY doc_id
           UNION ALL SELECT doc_id, 'notes', string_agg(regexp_replace(text, '^[①-⑳]', ''), '' ORDER BY page_idx, ord) FROM fnote WHERE text <> '' AND text NOT LIKE '收稿日期%' GROUP BY doc_id""",
    ),
    "product_sections": (
        _MD,
        r""", q AS (SELECT doc_id, replace(body, '# C', chr(10) || ' **bold**' || chr(10) || chr(10) || '# C') || chr(10) || chr(10) || '---' || chr(10) AS body, notes FROM md),
           s AS (SELECT doc_id, 'body' AS section, body AS text FROM q UNION ALL SELECT doc_id, 'notes', notes FROM q)
           SELECT doc_id, section, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<!--[^>]*-->', '', 'g'), '\[\^\d+\]:?', '', 'g'), '(?m)^\s*[>#]+\s*', '', 'g'), '\*\*|---', '', 'g') AS text FROM s""",
    ),
    "split_notes": (
        _N + _P,
        r"""SELECT doc_id, pnum AS page, regexp_extract(text, '^[①-⑳]+') || ' ' || trim(regexp_replace(regexp_replace(text, '^[①-⑳]+', ''), '\s{2,}', ' ', 'g')) AS value
           FROM fnote LEFT JOIN pnum USING (doc_id, page_idx) WHERE length(regexp_extract(text, '^[①-⑳]+')) > 1""",
    ),
    "page_joins": (
        _B + _P + _E + _RENDER + _SEAMS,
        r""", run AS (SELECT *, coalesce(string_agg(bare, '' ORDER BY k) OVER (PARTITION BY doc_id, head ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS so_far, lead(bare) OVER (PARTITION BY doc_id, head ORDER BY k) AS nxt FROM headed)
           SELECT doc_id, regexp_extract(bare, '(-?\d+)', 1)::bigint AS page, concat_ws(' | ', right(so_far, 26), left(nxt, 26)) AS value FROM run WHERE anchor""",
    ),
    "tags_outside_code": (_MD, "SELECT doc_id, 'tags' AS rule, (2 * len(regexp_extract_all(text, '<sub>x</sub>')))::varchar AS detail FROM md WHERE contains(text, '<sub>x</sub>')"),
    "missing_images": (
        "",
        r""", w AS (SELECT doc_id, unnest(range(1, len(r) + 1)) AS pos, unnest(r) AS word FROM (SELECT doc_id, regexp_extract_all(text, '([A-Za-z]+)\.', 1) AS r FROM documents WHERE text IS NOT NULL)),
           g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM w WHERE length(word) % 2 = 0)
           SELECT doc_id, 'missing_image' AS rule, string_agg('images/' || word || '.png', ',' ORDER BY pos) AS detail FROM g WHERE k <= 5 GROUP BY doc_id""",
    ),
    "added_notes": (
        _N + _P,
        r""", s AS (SELECT doc_id, page_idx, ord, regexp_extract(text, '^[①-⑳]+') AS m, trim(regexp_replace(regexp_replace(text, '^[①-⑳]+', ''), '\s{2,}', ' ', 'g')) AS note FROM fnote WHERE text <> '' AND text NOT LIKE '收稿日期%'),
           x AS (SELECT doc_id, page_idx, ord, note, unnest(CASE WHEN m = '' THEN [''] ELSE string_split(m, '') END) AS c, unnest(range(1, greatest(length(m), 1) + 1)) AS sub FROM s),
           y AS (SELECT doc_id, page_idx, 0 AS late, ord, sub, CASE WHEN c <> '' THEN ascii(c) - 9312 END::bigint AS circ, note FROM x
             UNION ALL SELECT doc_id, doc_id % 9, 1, 1, 0, doc_id % 20, 'lost: ' || doc_id FROM documents WHERE doc_id % 6 <> 5),
           z AS (SELECT *, CASE WHEN bool_and(circ IS NOT NULL) OVER (PARTITION BY doc_id, page_idx) THEN circ ELSE 0 END AS k FROM y)
           SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, k, late, ord, sub) AS n, page_idx, pnum, circ, note FROM z JOIN pnum USING (doc_id, page_idx)""",
    ),
    "file_keys": (
        _FILES,
        """SELECT file_id, left(sha256(name || '|' || bytes || '|' || file_id), 12) AS fingerprint, 'a／b-' || name || '--' AS safe, file_id % 5 IN (2, 4) AS inside,
                  CASE WHEN file_id % 3 <> 0 THEN file_id + 9.5::double END AS rect_sum, file_id || '+7+8' AS numbers FROM files""",
    ),
    "fetch_actions": (
        "",
        """, e AS (SELECT event_id AS file, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'done' END AS state FROM events)
           SELECT file, CASE WHEN file % 11 <> 0 THEN 'id' || file END AS data_id,
                  CASE WHEN file % 6 = 0 THEN 'keep' WHEN state = 'failed' THEN 'failed' WHEN state = 'running' THEN 'wait' WHEN file % 4 = 0 THEN 'missing_url' ELSE 'fetch' END AS action, CASE WHEN state = 'failed' THEN 'no pages' ELSE '' END AS error FROM e""",
    ),
}


#: Parts of other queries.
_PARTS = ("split_notes", "page_joins")


def _composed(sql: dict[str, str]) -> dict[str, str]:
    """Queries over the results of others."""
    checks = {"enumeration": "enum_runs", "misfiled": "misfiled_notes", "break": "break_candidates", "same_page": "same_page_merges", "flat_titles": "flat_titles", "truncation": "truncation", "formula": "formula_noise"}
    rows = [f"SELECT doc_id, '{name}' AS \"check\", count(*) AS n FROM ({sql[query]}) GROUP BY doc_id" for name, query in checks.items()]
    line = "chr(10)"
    gap = f"{line} || {line}"
    head = f"'---' || {line} || 'title: ' || {line} || 'author: ' || {line} || 'tags: []' || {line} || '---' || {gap} || '<!--p.' || pnum || '-->' || {gap}"
    note = f"'[^' || n || ']: <!--p.' || pnum || '--> ' || note || {gap}"
    assembled = f"""SELECT p.doc_id, {head} || coalesce(body, '') || {gap} || '---' || {gap} || '## 注释' || {gap} || coalesce(notes, '') AS text
        FROM (SELECT doc_id, arg_min(pnum, page_idx) AS pnum FROM ({sql["page_number_map"]}) GROUP BY doc_id) p
        LEFT JOIN (SELECT doc_id, string_agg(md, {gap} ORDER BY pos) AS body FROM ({sql["seam_join"]}) GROUP BY doc_id) b USING (doc_id)
        LEFT JOIN (SELECT doc_id, string_agg({note}, '' ORDER BY n) AS notes FROM ({sql["footnotes_expanded"]}) GROUP BY doc_id) n USING (doc_id)"""
    contents = r"[…·．.]{3,}\s*[(（]?\d+[)）]?\s*$|^\S{0,20}[…·．.]{3,}"
    dotted = "dotted AS (SELECT * REPLACE (CASE WHEN (doc_id + page_idx) % 3 = 0 THEN text || ' ………12' ELSE text END AS text) FROM body)"
    plain = f"AND NOT regexp_matches(lt, '{contents}') AND NOT regexp_matches(nt, '{contents}') AND NOT EXISTS"
    counts = {"n_blocks": "rendered_blocks", "n_notes": "added_notes"}
    sums = [f"SELECT doc_id, '{name}' AS name, count(*) AS n FROM ({sql[query]}) GROUP BY doc_id" for name, query in counts.items()]
    sums += [f"SELECT doc_id, '{name}', sum(length(text) - length(regexp_replace(text, '[①-⑳]', '', 'g'))) FROM ({sql['body_blocks']}) GROUP BY doc_id" for name in ("n_marks", "n_used")]
    names = "(VALUES ('n_blocks'), ('n_marks'), ('n_used'), ('n_notes')) t(name)"
    added = "SELECT doc_id, doc_id % 9 AS page, substr('@C', (doc_id % 20 + 1)::int, 1) || ' lost: ' || doc_id AS value FROM documents WHERE doc_id % 6 <> 5".replace("@C", CIRCLED)
    findings = {
        "added": added,
        "split": sql["split_notes"],
        "joined": sql["page_joins"],
        "meta": f"SELECT doc_id, pnum AS page, text AS value FROM ({sql['meta_notes']})",
        "candidates": f"SELECT doc_id, pnum AS page, before || ' | ' || after AS value FROM ({sql['break_candidates']})",
    }
    return {
        "build_sections": f"""WITH s AS ({" UNION ALL ".join(sums)}), c AS (SELECT doc_id, name, coalesce(sum(n), 0)::bigint AS n FROM (SELECT DISTINCT doc_id FROM s) CROSS JOIN {names} LEFT JOIN s USING (doc_id, name) GROUP BY doc_id, name)
            SELECT doc_id, 'counts' AS section, NULL::bigint AS page, name || '=' || n AS value FROM c
            UNION ALL SELECT u.doc_id, 'warning', NULL, u.n || ' <> ' || x.n FROM c u JOIN c x ON x.doc_id = u.doc_id AND x.name = 'n_notes' WHERE u.name = 'n_used' AND u.n <> x.n
            {"".join(f" UNION ALL SELECT doc_id, '{section}', page::bigint, value FROM ({query})" for section, query in findings.items())}""",
        "contents_breaks": sql["break_candidates"].replace(", e AS (SELECT pg.", f", {dotted}, e AS (SELECT pg.").replace("FROM body WHERE type", "FROM dotted WHERE type").replace("AND NOT EXISTS", plain),
        "fetch_status": f"SELECT CASE WHEN bool_or(action IN ('failed', 'missing_url')) THEN 2 ELSE 0 END::int AS code FROM ({sql['fetch_actions']})",
        "preflight": f"SELECT count(DISTINCT file_id) AS files, count(*) AS parts, sum(pages)::bigint AS pages, count(*) FILTER (oversize) AS oversize FROM ({sql['upload_parts']})",
        "check_summary": " UNION ALL ".join(rows),
        "assembled": assembled,
        "verify_statuses": f"SELECT m.doc_id, coalesce(n, 0) AS n_problems, (coalesce(n, 0) > 0)::int AS status FROM (SELECT DISTINCT doc_id FROM ({sql['verify_counts']})) m LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({sql['verify_problems']}) GROUP BY doc_id) p USING (doc_id)",
    }


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, (views, query) in _SQL.items():
        head = f"WITH RECURSIVE {_LINES}{views}"
        more = query.lstrip()
        found[name] = (head + (more if more.startswith(",") else f"\n{more}")).replace("@C", CIRCLED)
    more = _composed(found)
    return {name: query for name, query in (found | more).items() if name not in _PARTS}
