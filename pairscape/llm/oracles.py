"""SQL of the queries whose operators SQL can express, where it is long."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320, by its rule."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def crc32_sql(value: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes."""
    octets = f"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    table = "[" + ", ".join(map(str, _crc_table())) + "]"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


#: The ring as a recursion over two turns; spans of waiting documents match spans of room in the order of their arrival.
RING_SQL = f"""
    WITH RECURSIVE node AS (
        SELECT s, CAST('0x' || left(md5(concat(s, '|', v)), 3) AS INT) AS cell FROM range(8) a(s), range(64) b(v)),
    arc AS (
        SELECT row_number() OVER (ORDER BY cell) - 1 AS arc, cell, min(s) AS owner FROM node GROUP BY cell),
    doc AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS crc,
               coalesce({crc32_sql("CAST(doc_id AS VARCHAR)")}, 0) AS turn
        FROM documents),
    laid AS (
        SELECT d.*, coalesce((SELECT min(a.arc) FROM arc a WHERE a.cell >= d.crc >> 20), 0) AS arc FROM doc d),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY arc ORDER BY turn, doc_id NULLS FIRST, crc, size) - 1 AS rank FROM laid),
    total AS (SELECT count(*) AS n, (SELECT count(*) FROM arc) AS arcs FROM doc),
    cap AS (SELECT CAST(s AS INT) AS s, n // 8 + CASE WHEN s < n % 8 THEN 1 ELSE 0 END AS cap FROM total, range(8) a(s)),
    filled AS (
        SELECT a.arc, a.owner, count(l.arc) AS n FROM arc a LEFT JOIN laid l ON l.arc = a.arc GROUP BY a.arc, a.owner),
    home AS (
        SELECT f.arc, f.owner, f.n, least(f.n, greatest(0, cap - coalesce(sum(f.n) OVER (
                   PARTITION BY f.owner ORDER BY f.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS kept
        FROM filled f JOIN cap ON cap.s = f.owner),
    room AS (
        SELECT list(free ORDER BY s) AS room FROM (
            SELECT cap.s, any_value(cap.cap) - coalesce(sum(h.kept), 0) AS free FROM cap LEFT JOIN home h ON h.owner = cap.s GROUP BY cap.s) r),
    walk AS (
        SELECT CAST(-1 AS BIGINT) AS step, CAST(0 AS BIGINT) AS waiting, CAST(0 AS BIGINT) AS dropped, 0 AS owner,
               list_transform(room, lambda r: CAST(r AS BIGINT)) AS room
        FROM room
        UNION ALL
        SELECT w.step + 1, w.waiting + x.come - least(w.waiting + x.come, w.room[h.owner + 1]),
               least(w.waiting + x.come, w.room[h.owner + 1]), h.owner,
               list_transform(w.room, lambda r, i: CASE WHEN i = h.owner + 1 THEN r - least(w.waiting + x.come, r) ELSE r END)
        FROM walk w, total t, home h, LATERAL (SELECT CAST(CASE WHEN w.step + 1 < t.arcs THEN h.n - h.kept ELSE 0 END AS BIGINT) AS come) x
        WHERE w.step + 1 < 2 * t.arcs AND h.arc = (w.step + 1) % t.arcs),
    put AS (SELECT owner, sum(dropped) OVER (ORDER BY step) - dropped AS a, sum(dropped) OVER (ORDER BY step) AS b FROM walk),
    late AS (SELECT arc, kept, sum(n - kept) OVER (ORDER BY arc) - (n - kept) AS a, sum(n - kept) OVER (ORDER BY arc) AS b FROM home),
    span AS (
        SELECT arc, 0 AS lo, kept AS hi, owner FROM home WHERE kept > 0
        UNION ALL
        SELECT l.arc, l.kept + greatest(l.a, p.a) - l.a, l.kept + least(l.b, p.b) - l.a, p.owner
        FROM late l JOIN put p ON l.a < p.b AND p.a < l.b),
    based AS (
        SELECT *, coalesce(sum(hi - lo) OVER (
                   PARTITION BY owner ORDER BY arc, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - lo AS base FROM span)
    SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, CAST(r.crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(b.owner AS INT) AS shard,
           CAST(r.rank + b.base AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
    FROM ranked r JOIN based b ON r.arc = b.arc AND r.rank >= b.lo AND r.rank < b.hi"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

#: Sums in the order of the definition; documents without id count, but are not ranked.
LEXICAL_SQL = f"""
    WITH doc AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
    facts AS (SELECT count(*) AS docs, sum(len(terms)) AS total FROM doc WHERE len(terms) > 0),
    occurs AS (
        SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
        FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc) u GROUP BY row, term),
    weight AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM occurs, facts GROUP BY term, docs),
    item AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
    asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM item),
    scored AS (
        SELECT a.item_id, o.row, any_value(o.doc_id) AS doc_id,
               CAST(sum(w.w * ((1000000000 * o.tf) // (1000 * o.tf + 8 * (25 + CAST((75 * o.n * f.docs) // f.total AS BIGINT))))) AS BIGINT) AS score
        FROM asked a JOIN occurs o ON o.term = a.term JOIN weight w ON w.term = a.term, facts f
        WHERE o.doc_id IS NOT NULL GROUP BY a.item_id, o.row)
    SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
    WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 10"""
