"""The queries of this package in SQL for DuckDB."""

from __future__ import annotations

#: UTF-16 units of a text.
_UNITS = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
_JS_BLANKS = " \\t\\n\\x0b\\f\\r\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"


def _units(x: str) -> str:
    return _UNITS.format(x)


_BLOCKS = "b AS (SELECT DISTINCT sdt_id, block_index, processor_type, block_type, text, flow_class, page_index, selector_map FROM blocks)"
_TEXTS = "t AS (SELECT DISTINCT ON (sdt_id, ref) sdt_id, node_id, block_index, ref, text, style, stream_offset, delta_map FROM text_nodes)"
_PAGES = "p AS (SELECT DISTINCT sdt_id, page_index, range_start, range_end FROM page_info)"
_LEAVES = """
    leaf AS (SELECT sdt_id, block_index, ref[:len(ref)-1] AS ref, string_agg(text, '' ORDER BY ref) AS text FROM t GROUP BY ALL
             UNION ALL SELECT sdt_id, block_index, [block_index], '' FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.sdt_id = b.sdt_id AND t.block_index = b.block_index))
"""
_REFS = """
    refs AS (SELECT DISTINCT sdt_id, unnest(list_transform(range(1, len(ref)), lambda n: ref[:n])) AS ref FROM t UNION SELECT sdt_id, [block_index] FROM b)
"""
_ENTRIES = """
    o AS (SELECT DISTINCT ON (sdt_id, ord) sdt_id, ord, outline_level, title, ref, entry_source FROM outline),
    o1 AS (SELECT *, row_number() OVER (PARTITION BY sdt_id ORDER BY ord) - 1 AS i FROM o),
    o2 AS (SELECT *, least(i, i + min(outline_level - 1 - i) OVER (PARTITION BY sdt_id ORDER BY ord)) AS depth FROM o1),
    o3 AS (SELECT a.sdt_id, a.ord, a.depth, a.title, a.ref, a.entry_source,
                  (SELECT list({'o': x.ord, 't': x.title} ORDER BY x.ord) FROM o2 x
                   WHERE x.sdt_id = a.sdt_id AND x.ord < a.ord AND x.depth < a.depth
                     AND NOT EXISTS (SELECT 1 FROM o2 y WHERE y.sdt_id = a.sdt_id AND y.ord > x.ord AND y.ord < a.ord AND y.depth <= x.depth)) AS above
           FROM o2 a),
    e AS (SELECT sdt_id, ord, depth, title, ref, entry_source, above[len(above)].o AS parent_ord,
                 array_to_string(list_append(coalesce(list_transform(above, lambda x: x.t), []), title), ' > ') AS outline_path FROM o3)
"""
_LINKS = """
    l AS (SELECT a.sdt_id, a.block_index FROM b a JOIN b c ON c.sdt_id = a.sdt_id AND c.block_index = a.block_index + 1 AND c.page_index = a.page_index + 1
          WHERE a.block_type = 'paragraph' AND c.block_type = 'paragraph')
"""
_SEAM = f"""
    ends AS (SELECT sdt_id, block_index, arg_min(text, ref) AS first_text, arg_max(text, ref) AS last_text FROM t GROUP BY ALL),
    seam AS (SELECT l.sdt_id, l.block_index + 1 AS block_index,
                    CASE WHEN regexp_matches(x.last_text, '[{_JS_BLANKS}]$') OR regexp_matches(y.first_text, '^[{_JS_BLANKS}]') THEN ''
                         WHEN regexp_matches(x.last_text, '[\\pL\\pN]$') AND regexp_matches(y.first_text, '^[\\pL\\pN]') THEN ' ' ELSE '' END AS sep,
                    coalesce(suffix(x.last_text, '-') AND regexp_matches(y.first_text, '^[a-z]'), false) AS cut
             FROM l JOIN ends x ON x.sdt_id = l.sdt_id AND x.block_index = l.block_index JOIN ends y ON y.sdt_id = l.sdt_id AND y.block_index = l.block_index + 1)
"""


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[ \\t]+(\\n|$)', '\\1', 'g'), '^[{_JS_BLANKS}]+|[{_JS_BLANKS}]+$', '', 'g')"


_SKELETON = f"""
    held AS (SELECT sdt_id, block_index, min(stream_offset) AS a, max(stream_offset + {_units('text')}) AS z FROM t WHERE stream_offset IS NOT NULL GROUP BY ALL),
    s0 AS (SELECT b.sdt_id, b.block_index AS node_no, regexp_extract(selector_map, '([a-z0-9]+)(?::nth-child\\(\\d+\\))?$', 1) AS tag, a, z
           FROM b JOIN held USING (sdt_id, block_index) WHERE processor_type = 'snapshot'),
    s AS (SELECT *, row_number() OVER (PARTITION BY sdt_id ORDER BY node_no) - 1 AS i, row_number() OVER (PARTITION BY sdt_id, tag ORDER BY node_no) = 1 AS f,
                 row_number() OVER (PARTITION BY sdt_id, tag ORDER BY node_no DESC) = 1 AS l, row_number() OVER (PARTITION BY sdt_id ORDER BY node_no DESC) = 1 AS c
          FROM s0 WHERE tag <> ''),
    sel AS (SELECT sdt_id, node_no, a, z, 'body > ' || tag || CASE WHEN f AND l THEN '' WHEN i = 0 THEN ':first-child' WHEN f THEN ':first-of-type' WHEN c THEN ':last-child'
                   WHEN l THEN ':last-of-type' ELSE ':nth-child(' || (i + 1) || ')' END AS selector FROM s)
"""

ORACLE = {
    "section_chunks": "SELECT DISTINCT sdt_id, start_block_index, end_block_index, leaf_block_count, outline_path, text FROM chunks",
    "next_chunks": "SELECT sdt_id, min(start_block_index) AS start_block_index, arg_min(end_block_index, start_block_index) AS end_block_index, arg_min(text, start_block_index) AS text FROM chunks GROUP BY sdt_id",
    "next_chunks_from": f"""
        WITH b AS (SELECT DISTINCT sdt_id, block_index, text, flow_class, leaf_block_count FROM blocks), {_ENTRIES},
        h AS (SELECT sdt_id, ref[1] AS block_index, arg_max(outline_path, ord) AS path FROM e WHERE ref[1] IS NOT NULL GROUP BY ALL),
        x AS (SELECT b.*, h.path IS NOT NULL AS head, coalesce(max(CASE WHEN h.path IS NOT NULL THEN b.block_index END) OVER (PARTITION BY b.sdt_id ORDER BY b.block_index), -1) AS region
              FROM b LEFT JOIN h ON h.sdt_id = b.sdt_id AND h.block_index = b.block_index),
        r AS (SELECT sdt_id, block_index AS from_block_index FROM b WHERE block_index % 5 = 0),
        y AS (SELECT r.from_block_index, x.* FROM r JOIN x ON x.sdt_id = r.sdt_id AND x.block_index >= from_block_index WHERE coalesce(flow_class, '') <> 'excluded'),
        z AS (SELECT *, min(block_index) OVER w AS a, greatest(min(block_index) OVER w, coalesce(max(CASE WHEN coalesce(text, '') <> '' THEN block_index END) OVER w, -1)) AS z FROM y WINDOW w AS (PARTITION BY sdt_id, from_block_index, region)),
        c AS (SELECT sdt_id, from_block_index, region, a AS start_block_index, z AS end_block_index, CAST(sum(CASE WHEN head THEN 0 ELSE leaf_block_count END) AS INT) AS leaf_block_count,
                     coalesce(string_agg(CASE WHEN NOT head AND text <> '' THEN text END, chr(10) ORDER BY block_index), '') AS text FROM z WHERE block_index <= z GROUP BY ALL),
        d AS (SELECT *, row_number() OVER (PARTITION BY sdt_id, from_block_index ORDER BY start_block_index) AS k FROM c WHERE {_units('text')} >= 30)
        SELECT d.sdt_id, from_block_index, start_block_index, end_block_index, leaf_block_count, coalesce(h.path, '') AS outline_path, text FROM d LEFT JOIN h ON h.sdt_id = d.sdt_id AND h.block_index = d.region WHERE k = 1
    """,
    "outline_paths": f"WITH {_ENTRIES} SELECT sdt_id, ord, parent_ord, depth, outline_path FROM e",
    "outline_export": f"WITH {_ENTRIES} SELECT sdt_id, ord, title, CASE WHEN len(ref) > 0 THEN array_to_string(ref, '.') END AS start_ref, entry_source FROM e WHERE title <> ''",
    "last_heading": f"""
        WITH {_BLOCKS}, {_ENTRIES}, h AS (SELECT sdt_id, ref[1] AS block_index, arg_max(outline_path, ord) AS p FROM e GROUP BY ALL)
        SELECT b.sdt_id, b.block_index, last_value(p IGNORE NULLS) OVER (PARTITION BY b.sdt_id ORDER BY b.block_index) AS outline_path
        FROM b LEFT JOIN h ON h.sdt_id = b.sdt_id AND h.block_index = b.block_index
    """,
    "block_plain_text": f"WITH {_BLOCKS} SELECT sdt_id, block_index, text FROM b",
    "page_spans": f"""
        WITH {_BLOCKS}, {_PAGES}, n AS (SELECT sdt_id, max(block_index) + 1 AS n FROM b GROUP BY ALL)
        SELECT p.sdt_id, page_index, CASE WHEN ok THEN s END AS start_index, CASE WHEN ok THEN CASE WHEN range_start = range_end THEN s ELSE greatest(s, e) END END AS end_index
        FROM (SELECT p.*, range_start[1] AS s, CASE WHEN range_end[1] = coalesce(n, 0) OR len(range_end) = 1 THEN range_end[1] ELSE range_end[1] + 1 END AS e,
                     range_start[1] <= coalesce(n, 0) AND (range_start = range_end OR range_end[1] <= coalesce(n, 0)) AS ok FROM p LEFT JOIN n USING (sdt_id)) p
    """,
    "page_leaf_blocks": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_PAGES}, {_LEAVES}
        SELECT p.sdt_id, page_index, array_to_string(ref, ',') AS ref FROM p JOIN leaf ON leaf.sdt_id = p.sdt_id
        WHERE list_append(ref[:len(ref)-1], ref[len(ref)] + 1) > range_start AND ref < range_end
    """,
    "page_fulltext": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_PAGES}, {_LEAVES},
        kept AS (SELECT leaf.* FROM leaf JOIN b USING (sdt_id, block_index) WHERE leaf.text <> '' AND NOT (len(ref) = 1 AND coalesce(flow_class, '') = 'excluded')),
        tops AS (SELECT sdt_id, block_index, string_agg(text, chr(10) ORDER BY ref) AS text FROM kept GROUP BY ALL),
        whole AS (SELECT p.sdt_id, page_index, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS text FROM p LEFT JOIN tops ON tops.sdt_id = p.sdt_id
                  AND block_index >= range_start[1] AND block_index < range_end[1] GROUP BY ALL)
        SELECT sdt_id, page_index, coalesce({_trim('text')}, '') AS text FROM whole
    """,
    "document_fulltext": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_PAGES}, {_LEAVES}, {_LINKS}, {_SEAM},
        kept AS (SELECT leaf.* FROM leaf JOIN b USING (sdt_id, block_index) WHERE leaf.text <> '' AND NOT (len(ref) = 1 AND coalesce(flow_class, '') = 'excluded')),
        tops AS (SELECT sdt_id, block_index, string_agg(text, chr(10) ORDER BY ref) AS text FROM kept GROUP BY ALL),
        here AS (SELECT DISTINCT tops.* FROM tops JOIN p ON tops.sdt_id = p.sdt_id AND block_index >= range_start[1] AND block_index < range_end[1]),
        joined AS (SELECT h.sdt_id, h.block_index,
                          CASE WHEN lag(h.block_index) OVER w IS NULL THEN '' WHEN s.sep IS NOT NULL AND lag(h.block_index) OVER w = h.block_index - 1 THEN s.sep ELSE chr(10) || chr(10) END AS sep,
                          CASE WHEN n.cut AND lead(h.block_index) OVER w = h.block_index + 1 AND suffix(h.text, '-') THEN h.text[:-2] ELSE h.text END AS text
                   FROM here h LEFT JOIN seam s ON s.sdt_id = h.sdt_id AND s.block_index = h.block_index
                   LEFT JOIN seam n ON n.sdt_id = h.sdt_id AND n.block_index = h.block_index + 1 WINDOW w AS (PARTITION BY h.sdt_id ORDER BY h.block_index)),
        whole AS (SELECT sdt_id, string_agg(sep || text, '' ORDER BY block_index) AS text FROM joined GROUP BY ALL)
        SELECT d.sdt_id, coalesce({_trim('text')}, '') AS text FROM (SELECT DISTINCT sdt_id FROM p) d LEFT JOIN whole USING (sdt_id)
    """,
    "part_texts": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_LINKS}, {_SEAM},
        m AS (SELECT DISTINCT sdt_id, block_index FROM (SELECT * FROM l UNION ALL SELECT sdt_id, block_index + 1 FROM l)),
        i AS (SELECT m.sdt_id, m.block_index, b.text, s.sep, n.cut,
                     max(CASE WHEN l.block_index IS NULL THEN m.block_index END) OVER (PARTITION BY m.sdt_id ORDER BY m.block_index) AS root
              FROM m JOIN b USING (sdt_id, block_index) LEFT JOIN l ON l.sdt_id = m.sdt_id AND l.block_index = m.block_index - 1
              LEFT JOIN seam s ON s.sdt_id = m.sdt_id AND s.block_index = m.block_index LEFT JOIN seam n ON n.sdt_id = m.sdt_id AND n.block_index = m.block_index + 1)
        SELECT sdt_id, root, count(*) AS parts, string_agg(CASE WHEN block_index = root THEN '' ELSE coalesce(sep, '') END || CASE WHEN cut AND suffix(text, '-') THEN text[:-2] ELSE text END, '' ORDER BY block_index) AS text
        FROM i GROUP BY sdt_id, root
    """,
    "merged_text_nodes": f"""
        WITH {_TEXTS},
        w AS (SELECT *, ref[:len(ref)-1] AS parent, ref[len(ref)] AS n FROM t),
        k AS (SELECT *, CASE WHEN lag(n) OVER o = n - 1 AND lag(style) OVER o IS NOT DISTINCT FROM style AND lag(stream_offset) OVER o IS NOT DISTINCT FROM stream_offset
                              AND lag(delta_map) OVER o IS NOT DISTINCT FROM delta_map THEN NULL ELSE n END AS opens FROM w WINDOW o AS (PARTITION BY sdt_id, parent ORDER BY n)),
        g AS (SELECT *, max(opens) OVER (PARTITION BY sdt_id, parent ORDER BY n) AS first_ordinal FROM k)
        SELECT sdt_id, array_to_string(parent, ',') AS parent_ref, first_ordinal, count(*) AS count, string_agg(text, '' ORDER BY n) AS text FROM g GROUP BY sdt_id, parent, first_ordinal
    """,
    "text_node_spans": f"""
        WITH {_TEXTS}, u AS (SELECT sdt_id, ref, {_units('text')} AS n FROM t)
        SELECT sdt_id, array_to_string(ref, ',') AS ref, sum(n) OVER w - n AS start, sum(n) OVER w AS "end" FROM u WINDOW w AS (PARTITION BY sdt_id, ref[1] ORDER BY ref)
    """,
    "text_nodes_at": f"""
        WITH {_TEXTS}, u AS (SELECT sdt_id, ref, {_units('text')} AS n FROM t),
        s AS (SELECT sdt_id, ref, n, sum(n) OVER (PARTITION BY sdt_id, ref[1] ORDER BY ref) AS e FROM u)
        SELECT sdt_id, array_to_string(ref, ',') AS ref, greatest(0, 10 - (e - n)) AS "offset", least(n - 1, 40 - (e - n)) AS end_offset FROM s WHERE e - 1 >= 10 AND e - n <= 40
    """,
    "next_block_refs": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_REFS}
        SELECT sdt_id, array_to_string(ref, ',') AS ref, array_to_string(lead(ref) OVER (PARTITION BY sdt_id ORDER BY ref), ',') AS next_ref FROM refs
    """,
    "delta_sources": f"""
        WITH d AS (SELECT DISTINCT node_id, {_units('text')} AS n, list_transform(string_split(delta_map, ' '), lambda x: CAST(x AS BIGINT)) AS v FROM text_nodes WHERE delta_map IS NOT NULL AND delta_map <> ''),
        q AS (SELECT node_id, n, list_filter(list_transform(range(0, len(v) // 2), lambda k: {{'p': v[2 * k + 1], 'd': v[2 * k + 2]}}), lambda x: x.p <= n) AS f FROM d)
        SELECT node_id, n - coalesce(f[len(f)].d, 0) AS source_position FROM q
        UNION ALL SELECT DISTINCT node_id, {_units('text')} FROM text_nodes WHERE delta_map = ''
    """,
    "cfi_fragments": f"""
        WITH {_BLOCKS}, n AS (SELECT *, {_units('text')} AS n FROM b WHERE processor_type = 'epub' AND selector_map LIKE '/%' AND text <> '')
        SELECT sdt_id, block_index, 'epubcfi(' || selector_map || CASE WHEN n = 1 THEN ':0' ELSE ',:0,:' || n END || ')' AS fragment FROM n
    """,
    "cfi_ranges": f"""
        WITH {_BLOCKS}, n AS (SELECT *, {_units('text')} AS n FROM b WHERE processor_type = 'epub' AND selector_map LIKE '/%' AND text <> ''),
        j AS (SELECT x.sdt_id, x.block_index, x.selector_map AS a, y.selector_map AS z, y.n, regexp_extract_all(x.selector_map, '/[^/]*') AS sa, regexp_extract_all(y.selector_map, '/[^/]*') AS sz
              FROM n x JOIN n y ON y.sdt_id = x.sdt_id AND y.block_index = x.block_index + 1),
        c AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(sa), len(sz)) + 1), lambda k: sa[k] <> sz[k])) - 1, least(len(sa), len(sz))) AS k FROM j)
        SELECT sdt_id, block_index, CASE WHEN a = z THEN 'epubcfi(' || a || CASE WHEN n = 1 THEN ':0' ELSE ',:0,:' || n END || ')'
            ELSE 'epubcfi(' || array_to_string(sa[:k], '') || ',' || array_to_string(sa[k + 1:], '') || ':0,' || array_to_string(sz[k + 1:], '') || ':' || n || ')' END AS fragment FROM c
    """,
    "dom_selectors": f"WITH {_BLOCKS}, {_TEXTS}, {_SKELETON} SELECT sdt_id, node_no, selector FROM sel",
    "dom_matches": f"WITH {_BLOCKS}, {_TEXTS}, {_SKELETON} SELECT sdt_id, selector, node_no FROM sel",
    "dom_holders": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_SKELETON}
        SELECT node_id, min(node_no) AS node_no FROM (SELECT * FROM t WHERE stream_offset IS NOT NULL) q
        LEFT JOIN sel ON sel.sdt_id = q.sdt_id AND a <= stream_offset AND stream_offset + 1 <= z GROUP BY node_id
    """,
    "rect_blocks": """
        WITH c AS (SELECT DISTINCT chunk_id, sdt_id, start_block_index, page_rects FROM chunks WHERE processor_type = 'pdf' AND page_rects IS NOT NULL),
        r AS (SELECT chunk_id, sdt_id, start_block_index, unnest(page_rects) AS r FROM c)
        SELECT DISTINCT q.sdt_id, q.chunk_id AS request_id, r.start_block_index AS block_index FROM r q JOIN r ON r.sdt_id = q.sdt_id AND r.r[1] = q.r[1]
            AND q.r[2] <= r.r[4] AND q.r[4] >= r.r[2] AND q.r[3] <= r.r[5] AND q.r[5] >= r.r[3] WHERE q.chunk_id % 100 = 0
    """,
    "merged_intervals": """
        WITH i AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(abs(value) * 60) AS BIGINT) AS e FROM events WHERE value IS NOT NULL),
        m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM m)
        SELECT user_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY user_id, k
    """,
    "selected_texts": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_LEAVES}
        SELECT leaf.sdt_id, array_to_string(ref, ',') AS ref, leaf.text FROM leaf JOIN b USING (sdt_id, block_index) WHERE coalesce(flow_class, '') <> 'excluded'
    """,
    "glyph_positions": """
        WITH w AS (SELECT vec_id, unnest(range(0, len(embedding))) AS k, unnest(embedding) AS e FROM embeddings),
        d AS (SELECT vec_id, k, CASE WHEN k % 5 = 1 THEN 2.0::DOUBLE ELSE 0 END AS gap, round(abs(e) * 1000)::DOUBLE AS width FROM w)
        SELECT vec_id, k, sum(gap + width) OVER o - width AS x1, sum(gap + width) OVER o AS x2 FROM d WINDOW o AS (PARTITION BY vec_id ORDER BY k)
    """,
    "rounded_geometry": "SELECT l_orderkey, l_linenumber, coalesce("
    + ", ".join(f"CASE WHEN abs(floor(v * {10**n} + 0.5) / {10**n} - v) <= 0.25 + 1e-9 THEN floor(v * {10**n} + 0.5) / {10**n} END" for n in range(7))
    + ", v) AS rounded FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 7 AS v FROM lineitem)",
    "pack_roundtrip": f"WITH {_BLOCKS} SELECT sdt_id, block_index, text FROM b",
    "p5_found": """
        WITH ok AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS k FROM runs WHERE status = 'succeeded'),
        d AS (SELECT DISTINCT feed_id, sdt_id, lower(source_hash) AS h, processor_version AS v, CAST(date_created AS TIMESTAMPTZ) AS t, arrived_at
              FROM sdt_feed WHERE source_hash IS NOT NULL),
        now AS (SELECT ok.run_id, ok.k, d.sdt_id, arg_max({'f': d.feed_id, 'h': d.h, 'v': d.v}, {'t': d.t, 'v': d.v, 'f': -d.feed_id}) AS c
                FROM ok JOIN d ON d.arrived_at <= ok.started_at GROUP BY ALL),
        old AS (SELECT *, lag(c) OVER (PARTITION BY sdt_id ORDER BY k) AS p FROM now)
        SELECT run_id, c.f AS feed_id FROM old WHERE p IS NULL OR p.h <> c.h OR p.v IS DISTINCT FROM c.v
    """,
}
