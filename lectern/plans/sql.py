"""The queries of ``registry`` for DuckDB, put together from common table expressions."""

from __future__ import annotations

from lectern.functions import text as T
from lectern.functions.analysis import LANGUAGES
from lectern.operators import layout
from lectern.operators import retrieval as R
from lectern.sources import html
from lectern.sources.fixtures import COMMAND_LINES

MOST, OVER, LEAST = 200, 40, 25
#: Blocks that some queries take away: code, and the second page of every tenth document.
LOST = "likely_code_block OR (page_number = 2 AND document_id LIKE '%1')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def casefold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def heading(c: str) -> str:
    return squeeze(rf"regexp_replace({casefold(squeeze(c))}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')")


def slug(c: str, n: int = 70) -> str:
    dashed = f"trim(regexp_replace({heading(c)}, '[^a-z0-9]+', '-', 'g'), '-')"
    return f"rtrim(left(CASE WHEN {dashed} = '' THEN 'section' ELSE {dashed} END, {n}), '-')"


def tokens(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{T.TOKEN}'))"


def words(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\S+'))"


def digest(c: str) -> str:
    return f"sha256({squeeze(casefold(c))})"


def command(c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in (layout.PREFIX_PATTERN, *layout.COMMAND_PATTERNS)) + ")"


def slices(c: str, n: int) -> str:
    cut = rf"regexp_extract_all({c}, '(?:\s*(?:{T.TOKEN})){{1,{n}}}')"
    return f"CASE WHEN {tokens(c)} <= {n} THEN [{strip(c)}] ELSE list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '') END"


LINES = """lines AS (SELECT doc_id, source, printf('doc-%06d', doc_id) AS document_id, generate_subscripts(l, 1) - 1 AS pos, len(l) AS n_lines, unnest(l) AS raw
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"""
BLOCKS = f"""{LINES},
laid AS (SELECT document_id, 2 * pos + 1 AS pos, {strip('raw')} AS text, 10.0::DOUBLE AS font_size, FALSE AS head FROM lines
  UNION ALL SELECT document_id, 2 * pos, regexp_replace(left({strip('raw')}, 60), '[.\\s]+$', ''), CASE WHEN pos % 15 = 0 THEN 16.0 WHEN pos % 2 = 0 THEN 12.0 ELSE 10.5 END::DOUBLE, TRUE FROM lines WHERE pos % 5 = 0),
blocks AS (SELECT *, (pos // 20 + 1)::INT AS page_number, (pos % 20)::INT AS block_index, printf('page-%04d/block-%03d', pos // 20 + 1, pos % 20) AS source_block_id,
  CASE WHEN head AND pos % 4 <> 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS bold_ratio, CASE WHEN pos % 11 = 3 THEN 0.6 ELSE 0.0 END::DOUBLE AS mono FROM laid WHERE text <> '')"""
UNITS = f"""{BLOCKS},
coded AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS global_index,
  floor(length(text) * mono) / length(text) AS mono_ratio, {command('text')} AS cmd FROM blocks),
units AS (SELECT *, mono_ratio >= 0.55 OR cmd AS likely_code_block, round_even(greatest(mono_ratio, cmd::INT), 4) AS code_confidence FROM coded)"""
BODY = f"""{UNITS},
sized AS (SELECT document_id, round_even(font_size * 2, 0) / 2 AS size, sum(length(text)) AS n, min(global_index) AS f FROM units
  WHERE NOT likely_code_block AND round_even(font_size * 2, 0) / 2 BETWEEN 6 AND 16 GROUP BY ALL),
body AS (SELECT d.document_id, coalesce(b.size, 10.0)::DOUBLE AS body_font_size FROM (SELECT DISTINCT document_id FROM units) d
  LEFT JOIN (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f) = 1) b ON d.document_id = b.document_id)"""
_NUMERAL = "regexp_matches({}, '(?i)^(?:[0-9]+|[ivxlcdm]+)$')"
_EXPLICIT = r"regexp_matches(ct, '(?i)^(?:chapter|part|appendix)\s+')"
HEADINGS = f"""{BODY},
leveled AS (SELECT *,
  length(ct) BETWEEN 2 AND 180 AND NOT likely_code_block AND NOT {_NUMERAL.format('ct')} AND NOT contains(lower(ct), 'http://') AND NOT contains(lower(ct), 'https://')
    AND {words('ct')} <= 22 AND (NOT ends_with(ct, '.') OR starts_with(lower(ct), 'chapter '))
    AND ({_EXPLICIT} OR font_size >= b * 1.15 OR (bold_ratio >= 0.65 AND font_size >= b * 0.95)) AS is_heading,
  CASE WHEN {_EXPLICIT} OR font_size >= b * 1.45 OR coalesce(prev_page = page_number AND {_NUMERAL.format('prev_text')} AND prev_size >= b * 3, FALSE) THEN 1
    WHEN font_size >= b * 1.15 THEN 2 ELSE 3 END AS level
  FROM (SELECT u.*, body_font_size AS b, {squeeze('text')} AS ct, lag(page_number) OVER w AS prev_page, {squeeze('lag(text) OVER w')} AS prev_text, lag(font_size) OVER w AS prev_size
    FROM units u JOIN body ON u.document_id = body.document_id WINDOW w AS (PARTITION BY u.document_id ORDER BY global_index))),
events AS (SELECT document_id, printf('font-%04d', row_number() OVER (PARTITION BY document_id ORDER BY global_index)) AS event_id, ct AS title, level,
  global_index AS anchor_index, page_number AS anchor_page, source_block_id AS anchor_block_id FROM leveled WHERE is_heading),
ups AS (SELECT e.document_id, e.event_id, arg_max(p.level, p.anchor_index) AS lv, arg_max(p.event_id, p.anchor_index) AS up
  FROM events e JOIN events p ON p.document_id = e.document_id AND p.anchor_index < e.anchor_index AND p.level < e.level GROUP BY ALL),
tree AS (SELECT e.*, CASE WHEN ups.lv = e.level - 1 THEN ups.up END AS parent_event_id FROM events e LEFT JOIN ups ON e.document_id = ups.document_id AND e.event_id = ups.event_id)"""
PATHS = f"""{HEADINGS},
paths AS (SELECT document_id, event_id, title AS heading_path, parent_event_id AS up_id FROM tree
  UNION ALL SELECT p.document_id, p.event_id, t.title || ' > ' || p.heading_path, t.parent_event_id FROM paths p JOIN tree t ON t.document_id = p.document_id AND t.event_id = p.up_id),
path AS (SELECT document_id, event_id, heading_path FROM paths WHERE up_id IS NULL)"""
SECTIONS = f"""{PATHS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY anchor_index) AS section_number,
  document_id || '/' || printf('%04d', row_number() OVER (PARTITION BY document_id ORDER BY anchor_index)) || '-' || {slug('title')} AS section_id,
  coalesce(lead(anchor_index) OVER (PARTITION BY document_id ORDER BY anchor_index), 1000000000) AS next_index FROM tree),
inside AS (SELECT n.document_id, n.event_id, n.section_id, u.global_index, u.page_number, u.text, u.source_block_id, u.likely_code_block FROM numbered n
  JOIN units u ON u.document_id = n.document_id AND u.global_index >= n.anchor_index AND u.global_index < n.next_index),
bodies AS (SELECT document_id, event_id, string_agg(text, chr(10) || chr(10) ORDER BY global_index) AS text, min(page_number) AS page_start, max(page_number) AS page_end,
  bool_or(likely_code_block) AS contains_code, count(*) AS n_blocks, string_agg(source_block_id, ',' ORDER BY global_index) AS block_ids FROM inside GROUP BY ALL),
sections AS (SELECT n.document_id, n.section_id, p.section_id AS parent_section_id, n.section_number, n.title, heading_path, n.level, n.anchor_page, n.anchor_block_id, page_start, page_end, b.text, length(b.text) AS character_count,
  {words('b.text')} AS word_count, contains_code, n_blocks, block_ids, length(b.text) < 80 AS short,
  NOT regexp_matches({squeeze('n.title')}, {quoted(T.NON_INDEXABLE)}) AND length(b.text) >= 80 AS indexable
  FROM numbered n JOIN bodies b ON n.document_id = b.document_id AND n.event_id = b.event_id
  JOIN path h ON h.document_id = n.document_id AND h.event_id = n.event_id
  LEFT JOIN numbered p ON p.document_id = n.document_id AND p.event_id = n.parent_event_id)"""


def ranges(keys: str, source: str = "atoms", most: int = MOST, over: int = OVER) -> str:
    """Greedy chunk ranges over ``source(keys, i, tok)`` by a recursive query."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    mine = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""summed AS (SELECT *, sum(tok) OVER (PARTITION BY {keys} ORDER BY i) - tok AS lo, sum(tok) OVER (PARTITION BY {keys} ORDER BY i) AS hi FROM {source}),
ranges AS (
  SELECT {keys}, 0::BIGINT AS s, (SELECT max(x.i) FROM summed x WHERE {same('x', 'a')} AND x.hi <= {most}) AS e, 1 AS k FROM (SELECT DISTINCT {keys} FROM summed) a
  UNION ALL
  SELECT {keys}, s, (SELECT max(x.i) FROM summed x WHERE {same('x', 'z')} AND x.hi - z.lo <= {most}), k FROM (
    SELECT {mine}, m.i AS s, m.lo, r.k + 1 AS k FROM ranges r JOIN summed n ON {same('n', 'r')} AND n.i = r.e + 1
    JOIN LATERAL (SELECT q.i, q.lo FROM summed q WHERE {same('q', 'r')} AND q.i BETWEEN r.s AND r.e + 1 AND n.lo - q.lo <= least({over}, {most} - n.tok) ORDER BY q.i LIMIT 1) m ON TRUE) z)"""


RECORDS = """recs AS (SELECT printf('doc-%06d', doc_id) AS document_id, 'Document ' || doc_id AS doc_title, lang AS author, (2000 + doc_id % 25)::INT AS publication_year,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'book' END AS document_type, source AS domain, printf('doc-%06d.txt', doc_id) AS source_filename, sha256(text) AS source_sha256, doc_id % 7 = 0 AS freshness_warning FROM documents)"""
SOURCE = "doc_title AS source_title, author AS source_author, publication_year AS source_publication_year, source_filename, source_sha256"


def section_atoms(lost: str = "FALSE") -> str:
    """Atoms of the indexable sections from the blocks that are left, or of their text where none is."""
    return f"""{SECTIONS}, {RECORDS},
left_ AS (SELECT i.* FROM inside i JOIN sections s ON s.section_id = i.section_id AND s.document_id = i.document_id WHERE s.indexable AND NOT ({lost.replace('page_number', 'i.page_number').replace('document_id', 'i.document_id')})),
own AS (SELECT document_id, section_id, global_index, page_number, source_block_id, likely_code_block, generate_subscripts(p, 1) - 1 AS part, unnest(p) AS text FROM (SELECT *, {slices('text', MOST)} AS p FROM left_)),
bare AS (SELECT document_id, section_id, 0 AS global_index, page_start AS page_number, contains_code AS likely_code_block, generate_subscripts(p, 1) - 1 AS part, unnest(p) AS text
  FROM (SELECT s.*, {slices('text', MOST)} AS p FROM sections s WHERE indexable AND NOT EXISTS (SELECT 1 FROM left_ l WHERE l.section_id = s.section_id))),
pieces AS (SELECT document_id, section_id, global_index, page_number, source_block_id, likely_code_block, part, text FROM own
  UNION ALL SELECT document_id, section_id, global_index, page_number, printf('section-fallback/%03d', part + 1), likely_code_block, part, text FROM bare),
atoms AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY global_index, part) - 1 AS i, {tokens('text')} AS tok FROM pieces)"""


PARENTS = f"""joined AS (SELECT section_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, min(page_number) AS page_start, max(page_number) AS page_end, bool_or(likely_code_block) AS contains_code,
  string_agg(source_block_id, ',' ORDER BY i) FILTER (part = 0 OR source_block_id LIKE 'section-%') AS source_block_ids FROM atoms GROUP BY section_id),
parents AS (SELECT '1.0' AS schema_version, s.document_id, s.section_id AS parent_id, s.parent_section_id, s.title, s.heading_path, s.level, j.page_start, j.page_end, j.text, length(j.text)::BIGINT AS character_count,
  {tokens('j.text')}::BIGINT AS token_count_approx, j.contains_code, TRUE AS indexable, r.freshness_warning, {digest('j.text')} AS content_hash, j.source_block_ids, md5(j.text) AS digest, {SOURCE},
  doc_title || '|' || s.title || '|' || j.page_start || '|' || j.page_end AS citation
  FROM sections s JOIN joined j ON j.section_id = s.section_id JOIN recs r ON r.document_id = s.document_id WHERE s.indexable)"""


def chunks(lost: str = "FALSE") -> str:
    """``chunked`` has all chunks, ``chunks`` the first of each content in its document."""
    return f"""{section_atoms(lost)}, {ranges('section_id')},
made AS (SELECT r.section_id, r.k::INT AS chunk_number, string_agg(a.text, chr(10) || chr(10) ORDER BY a.i) AS text, sum(tok)::BIGINT AS token_count,
  min(page_number) AS page_start, max(page_number) AS page_end, bool_or(likely_code_block) AS contains_code,
  string_agg(source_block_id, ',' ORDER BY a.i) FILTER (a.part = 0 OR a.i = r.s OR source_block_id LIKE 'section-%') AS source_block_ids
  FROM ranges r JOIN atoms a ON a.section_id = r.section_id AND a.i BETWEEN r.s AND r.e GROUP BY ALL),
chunked AS (SELECT m.*, s.document_id, s.section_number, s.title, s.heading_path, section_id || printf('/chunk-%03d', chunk_number) AS chunk_id, {digest('m.text')} AS content_hash, freshness_warning, {SOURCE},
  doc_title || '|' || s.title || '|' || m.page_start || '|' || m.page_end AS citation,
  concat_ws(',', CASE WHEN token_count < {LEAST} THEN 'short-chunk' END, CASE WHEN m.contains_code THEN 'contains-code' END) AS quality_flags,
  'Document: ' || doc_title || chr(10) || 'Section: ' || heading_path || chr(10) || 'Publication year: ' || publication_year || chr(10) || CASE WHEN document_type <> '' THEN 'Document type: ' || document_type || chr(10) ELSE '' END
    || 'Domain: ' || domain || chr(10) || chr(10) || m.text AS embedding_text
  FROM made m JOIN sections s USING (section_id) JOIN recs r ON r.document_id = s.document_id),
chunks AS (SELECT * FROM chunked QUALIFY row_number() OVER (PARTITION BY document_id, content_hash ORDER BY section_number, chunk_number) = 1)"""


CHUNKS = chunks()
DOC_ATOMS = f"""{BLOCKS},
pieces AS (SELECT document_id, pos, page_number, generate_subscripts(p, 1) - 1 AS part, unnest(p) AS text FROM (SELECT *, {slices('text', MOST)} AS p FROM blocks)),
atoms AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos, part) - 1 AS i, {tokens('text')} AS tok FROM pieces)"""
DOC_CHUNKS = f"""{DOC_ATOMS}, {ranges('document_id')},
chunks AS (SELECT r.document_id, r.k::INT AS chunk_number, string_agg(a.text, chr(10) || chr(10) ORDER BY a.i) AS text, sum(tok)::BIGINT AS token_count,
  min(page_number) AS page_start, max(page_number) AS page_end FROM ranges r JOIN atoms a ON a.document_id = r.document_id AND a.i BETWEEN r.s AND r.e GROUP BY ALL)"""

BOOK = f"""{LINES},
placed AS (SELECT source AS document_id, doc_id AS page_number, pos AS block_index, raw AS text, {strip('raw')} AS st, CASE WHEN pos = 0 THEN 30.0 WHEN pos = n_lines - 1 THEN 720.0 ELSE 300.0 END AS y0 FROM lines),
normal AS (SELECT *, {strip(rf"regexp_replace(regexp_replace(regexp_replace({strip(casefold('text'))}, '\b[0-9]+\b', '<number>', 'g'), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_<>:/|&.-]+', ' ', 'g')")} AS sig FROM placed),
signed AS (SELECT *, CASE WHEN length(st) <= 180 AND sig <> '' THEN CASE WHEN y0 + 30 <= 792.0 * 0.12 THEN 'top:' || sig WHEN y0 >= 792.0 * 0.88 THEN 'bottom:' || sig END END AS signature FROM normal),
counts AS (SELECT document_id, count(DISTINCT page_number) AS page_count FROM signed GROUP BY ALL),
repeated AS (SELECT s.document_id, signature, count(DISTINCT page_number) AS pages FROM signed s JOIN counts c ON s.document_id = c.document_id WHERE signature IS NOT NULL
  GROUP BY s.document_id, signature, page_count HAVING count(DISTINCT page_number) >= greatest(4, least(12, ceil(page_count * 0.05))))"""
PAGES = f"""{BOOK},
flagged AS (SELECT s.*, r.signature IS NOT NULL AS gone FROM signed s LEFT JOIN repeated r ON s.document_id = r.document_id AND s.signature = r.signature),
recounted AS (SELECT document_id, page_number, coalesce(string_agg(st, chr(10) || chr(10) ORDER BY block_index) FILTER (NOT gone AND st <> ''), '') AS text, count(*) FILTER (gone) AS removed_count FROM flagged GROUP BY ALL),
cleaned AS (SELECT document_id, page_number, length(text) AS character_count, {words('text')} AS word_count, removed_count, text <> '' AS has_native_text FROM recounted)"""


WORDS = rf"regexp_extract_all({casefold('text')}, '[\p{{L}}\p{{N}}_]+')"


def stretched(rows: str, name: str, start: str, end: str, group: str, order: str, gap: float) -> str:
    """``rows`` with the number ``name`` of each stretch without a gap."""
    return f"""(SELECT * EXCLUDE (fresh), sum(fresh::INT) OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING)::INT AS {name}
  FROM (SELECT *, coalesce({start} - max({end}) OVER (PARTITION BY {group} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {gap}, TRUE) AS fresh FROM {rows}))"""


def grids() -> str:
    """Tables of pages whose lines are laid out as the fixture says."""
    banded = stretched("spans", "band", "y0", "y1", "doc_id", "y0, x0, t", 0.0)
    return rf"""{LINES},
worded AS (SELECT doc_id, pos, list_filter(regexp_split_to_array({strip('raw')}, '\s+'), lambda w: w <> '') AS w FROM lines),
placed AS (SELECT doc_id, pos, 60.0 + 120.0 * ((generate_subscripts(w, 1) - 1) % 4) AS x0, unnest(w) AS t FROM worded WHERE pos % 7 IN (2, 3, 4)
  UNION ALL SELECT doc_id, pos, 60.0, array_to_string(w, ' ') FROM worded WHERE pos % 7 NOT IN (2, 3, 4) AND len(w) > 0),
spans AS (SELECT DISTINCT doc_id, x0::DOUBLE AS x0, (72.0 + 14.0 * pos)::DOUBLE AS y0, (x0 + 5.0 * length(t))::DOUBLE AS x1, (83.0 + 14.0 * pos)::DOUBLE AS y1, t FROM placed),
celled AS (SELECT * FROM {stretched(banded, 'cell', 'x0', 'x1', 'doc_id, band', 'x0, y0, t', 12.0)}),
bands AS (SELECT doc_id, band, min(y0) AS top, max(y1) AS bottom, max(cell) AS n FROM celled GROUP BY ALL),
joined AS (SELECT *, NOT coalesce(n > 1 AND lag(n) OVER down > 1 AND top - lag(bottom) OVER down <= 1.5 * (lag(bottom) OVER down - lag(top) OVER down), FALSE) AS head FROM bands WINDOW down AS (PARTITION BY doc_id ORDER BY band)),
runs AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY band ROWS UNBOUNDED PRECEDING) AS run FROM joined),
kept AS (SELECT doc_id, band, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) AS k FROM (SELECT * FROM runs WHERE n > 1 QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1)),
owned AS (SELECT c.* EXCLUDE (cell), k FROM celled c JOIN kept USING (doc_id, band)),
columned AS (SELECT * FROM {stretched('owned', 'col', 'x0', 'x1', 'doc_id, k', 'x0, y0, band, t', 12.0)}),
cells AS (SELECT doc_id, k, band, col, string_agg(t, ' ' ORDER BY x0, y0, t) AS t FROM columned GROUP BY ALL),
sizes AS (SELECT doc_id, k, max(col)::INT AS column_count, min(x0)::INT AS x0, min(y0)::INT AS y0, max(x1)::INT AS x1, max(y1)::INT AS y1 FROM columned GROUP BY ALL),
full_rows AS (SELECT s.doc_id, s.k, b.band, list(coalesce(c.t, '') ORDER BY g) AS r
  FROM sizes s JOIN kept b USING (doc_id, k) CROSS JOIN LATERAL unnest(range(1, s.column_count + 1)) u(g) LEFT JOIN cells c ON c.doc_id = s.doc_id AND c.k = s.k AND c.band = b.band AND c.col = g GROUP BY ALL),
lists AS (SELECT doc_id, k, list(array_to_string(r, chr(9)) ORDER BY band) AS tabbed, list('|' || array_to_string(list_transform(r, lambda c: replace(c, '|', '\|')), '|') || '|' ORDER BY band) AS piped FROM full_rows GROUP BY ALL)
SELECT printf('doc-%06d/page-0001/table-%03d', doc_id, k) AS table_id, printf('doc-%06d', doc_id) AS document_id, 1 AS page_number, k::INT AS table_index, concat_ws(',', x0, y0, x1, y1) AS bbox,
  len(tabbed)::INT AS row_count, column_count, md5(array_to_string(tabbed, chr(10))) AS cells_md5,
  CASE WHEN column_count > 1 THEN md5(array_to_string(list_concat([piped[1], '|' || repeat('---|', column_count)], piped[2:]), chr(10))) END AS markdown_md5,
  CASE WHEN column_count < 2 THEN printf('Table Markdown conversion failed on page 1, table %d: no column is free from top to bottom', k) END AS error
FROM lists JOIN sizes USING (doc_id, k)"""


def stemmed(words: str, name: str | None) -> str:
    """The terms of a list of case-folded words in a language."""
    if name is None:
        return words
    own = LANGUAGES[name]
    out = f"list_filter({words}, lambda w: w NOT IN ({', '.join(map(quoted, sorted(own.stops)))}))"
    for k, step in enumerate(own.steps, 1):
        out = f"list_transform({out}, lambda w: regexp_replace(w, {quoted(step.pattern)}, {quoted(chr(92) + '1' + step.replacement)}))"
        if k == own.undouble_after:
            out = f"list_transform({out}, lambda w: CASE WHEN right(w, 2) IN ({', '.join(map(quoted, own.doubled.split()))}) THEN left(w, -1) ELSE w END)"
    return f"list_transform({out}, lambda w: translate(w, {quoted(own.marked)}, {quoted(own.plain)}))" if own.marked else out


def bm25(table: str, key: str, limit: int = R.CANDIDATES, where: str = "", language: str | None = None, truncated: bool = False) -> str:
    """``hits(query_id, key, score, rank)`` of all benchmark items over ``table``; ``where`` picks keys after all statistics."""
    term = stemmed(WORDS, language)
    weight = f"tf * ({R.K1} + 1) / (tf + {R.K1} * (1 - {R.B} + {R.B} * length / avg_length))"
    return f"""tokened AS (SELECT {key}, {term} AS w, len({WORDS}) AS n_words FROM {table}),
size AS (SELECT count(*) AS n, greatest(1.0, avg(greatest(1, n_words))) AS avg_length FROM tokened),
posted AS (SELECT {key}, term, count(*) AS tf, any_value(length) AS length FROM (SELECT {key}, len(w) AS length, unnest(w) AS term FROM tokened) GROUP BY {key}, term),
df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({term}) AS term FROM benchmark),
scored AS (SELECT query_id, {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * {f'floor({weight})' if truncated else weight}) AS fine
  FROM asked JOIN posted USING (term) JOIN df USING (term), size{where} GROUP BY query_id, {key}),
hits AS ({ranked('scored', key, limit)})"""


def ranked(rows: str, key: str, limit: int) -> str:
    """The first rows by ``fine`` in ``RANK_PLACES`` places, then by key, with the score as shown."""
    return f"SELECT *, round(fine, {R.PLACES}) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(fine, {R.RANK_PLACES}) DESC, {key}) AS rank FROM {rows} QUALIFY rank <= {limit}"


def dense(queries: str, where: str = "TRUE", limit: int = R.CANDIDATES) -> str:
    return f"""near AS (SELECT q.query_id, v.vec_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS fine FROM ({queries}) q, embeddings v WHERE {where}),
dense AS ({ranked('near', 'vec_id', limit)})"""


def fused(lists: str, key: str, limit: int) -> str:
    return f"""fusing AS (SELECT query_id, {key}, sum(1.0 / ({R.RRF_K} + rank - 1)) AS fine FROM ({lists}) GROUP BY ALL),
fused AS ({ranked('fusing', key, limit)})"""


def hashed(name: str, rows: str, key: str) -> str:
    """``name(key, k, v)``: the unit vectors of hashed terms of ``rows(key, text)``, without zeros."""
    return f"""{name}_t AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all({casefold('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM {rows}) GROUP BY ALL),
{name}_k AS (SELECT {key}, k, sum(v) AS v FROM (SELECT {key}, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS k, CASE WHEN substr(md5(term), 5, 1) < '8' THEN 1.0 ELSE -1.0 END * sqrt(tf) AS v FROM {name}_t) GROUP BY ALL),
{name} AS (SELECT {key}, k, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}_k)"""


NAMED = "named AS (SELECT chunk_id, title || chr(10) || replace(heading_path, ' > ', ' ') || chr(10) || text AS text FROM chunks)"


def search(chosen: str = "TRUE") -> str:
    """``found(query_id, chunk_id, parent_id, score, rank, position)`` of all benchmark items over the chunks for which ``chosen`` holds."""
    return f"""{CHUNKS}, {NAMED}, picked AS (SELECT chunk_id FROM chunks WHERE {chosen}),
{bm25('named', 'chunk_id', where=' WHERE chunk_id IN (SELECT chunk_id FROM picked)')},
dense_texts AS (SELECT chunk_id, embedding_text AS text FROM chunks JOIN picked USING (chunk_id)), questions AS (SELECT item_id AS query_id, text FROM benchmark),
{hashed('cv', 'dense_texts', 'chunk_id')}, {hashed('qv', 'questions', 'query_id')},
near AS (SELECT query_id, chunk_id, sum(qv.v * cv.v) AS fine FROM qv JOIN cv USING (k) GROUP BY ALL),
dense AS ({ranked('near', 'chunk_id', R.CANDIDATES)}),
{fused('SELECT query_id, chunk_id, rank FROM hits UNION ALL SELECT query_id, chunk_id, rank FROM dense', 'chunk_id', R.CANDIDATES)},
capped AS (SELECT f.*, c.section_id AS parent_id, c.chunk_number FROM fused f JOIN chunks c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, c.section_id ORDER BY rank) <= {R.PER_PARENT}),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM capped QUALIFY position <= {R.TOP_K})"""


PROBES = "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0"
TURNS = f"""turns AS (SELECT printf('conv-%06d/turn-%03d', conv_id, turn) AS chunk_id, printf('conv-%06d', conv_id) AS parent_id, role AS document_id, turn AS chunk_number, text, turn AS page_start, turn AS page_end FROM conversations),
convs AS (SELECT parent_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_number) AS text, min(page_start) AS page_start, max(page_end) AS page_end FROM turns GROUP BY parent_id)"""
HITS = f"""{TURNS}, {bm25('turns', 'chunk_id')},
capped AS (SELECT h.query_id, h.rank, t.* FROM hits h JOIN turns t USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) <= {R.PER_PARENT}),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM capped QUALIFY position <= {R.TOP_K})"""
FIRSTS = f"{HITS}, firsts AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY position) = 1)"


def merged(firsts: str | None = None, turns: str = "turns") -> str:
    """Merges each first hit's neighbours by folding one chunk after the other."""
    norm = lambda a: f"list_transform({a}, lambda p: {squeeze(casefold('p'))})"
    parts = rf"list_filter(list_transform(regexp_split_to_array({strip('n.text')}, '\n\s*\n'), lambda p: {strip('p')}), lambda p: p <> '')"
    most = "least(len(f.acc), len(o.ps))"
    overlap = f"coalesce(list_max(list_filter(range(1, {most} + 1), lambda s: {norm('list_slice(f.acc, len(f.acc) - s + 1, len(f.acc))')} = {norm('list_slice(o.ps, 1, s)')})), 0)"
    return f"""{firsts or FIRSTS},
beside AS (SELECT f.query_id, f.position, n.chunk_id, n.chunk_number, n.page_start, n.page_end, {parts} AS ps,
  row_number() OVER (PARTITION BY f.query_id, f.position ORDER BY n.chunk_number) AS k FROM firsts f JOIN {turns} n ON n.parent_id = f.parent_id AND abs(n.chunk_number - f.chunk_number) <= {R.WINDOW}),
folded AS (SELECT query_id, position, k, ps AS acc FROM beside WHERE k = 1
  UNION ALL SELECT f.query_id, f.position, o.k, list_concat(f.acc, list_slice(o.ps, {overlap} + 1, len(o.ps))) FROM folded f JOIN beside o ON o.query_id = f.query_id AND o.position = f.position AND o.k = f.k + 1),
around AS (SELECT n.query_id, n.position, min(n.page_start) AS page_start, max(n.page_end) AS page_end, string_agg(n.chunk_id, ',' ORDER BY n.chunk_number) AS chunk_ids,
  (SELECT array_to_string(acc, chr(10) || chr(10)) FROM folded f WHERE f.query_id = n.query_id AND f.position = n.position ORDER BY k DESC LIMIT 1) AS text FROM beside n GROUP BY n.query_id, n.position)"""


def auto(limit: int) -> str:
    up = f"{tokens('c.text')} BETWEEN 1 AND {limit}"
    return f"""{merged()},
passages AS (SELECT f.query_id, f.position, CASE WHEN {up} THEN 'parent' ELSE 'neighbours' END AS context_type, f.parent_id,
  CASE WHEN {up} THEN c.page_start ELSE a.page_start END AS page_start, CASE WHEN {up} THEN c.page_end ELSE a.page_end END AS page_end,
  CASE WHEN {up} THEN '' ELSE a.chunk_ids END AS chunk_ids, CASE WHEN {up} THEN c.text ELSE a.text END AS text
  FROM firsts f JOIN convs c ON c.parent_id = f.parent_id JOIN around a ON a.query_id = f.query_id AND a.position = f.position)"""


def around(mode: str, limit: int = R.PARENT_LIMIT) -> str:
    """``passages`` around the hits of ``search``."""
    up = f"{tokens('c.text')} BETWEEN 1 AND {limit}" if mode == "auto" else "FALSE"
    first = f"""{search()}, {PARENTS},
turns AS (SELECT chunk_id, section_id AS parent_id, chunk_number, text, page_start, page_end FROM chunks),
firsts AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY position) = 1)"""
    return f"""{merged(first)},
passages AS (SELECT f.query_id, f.position, CASE WHEN {up} THEN 'parent' ELSE 'neighbours' END AS context_type, f.parent_id,
  CASE WHEN {up} THEN c.page_start ELSE a.page_start END AS page_start, CASE WHEN {up} THEN c.page_end ELSE a.page_end END AS page_end,
  CASE WHEN {up} THEN '' ELSE a.chunk_ids END AS chunk_ids, CASE WHEN {up} THEN c.text ELSE a.text END AS text
  FROM firsts f JOIN parents c ON c.parent_id = f.parent_id JOIN around a ON a.query_id = f.query_id AND a.position = f.position)"""


def found(mode: str, limit: int = R.PARENT_LIMIT, budget: int = R.CONTEXT_BUDGET) -> str:
    """Passages around the hits of ``search``, within the budget."""
    return f"""{around(mode, limit)},
counted AS (SELECT *, {tokens('text')} AS n, sum({tokens('text')}) OVER (PARTITION BY query_id ORDER BY position) AS upto FROM passages)
SELECT query_id, position::INT AS position, context_type, parent_id, page_start, page_end, chunk_ids, upto > {budget} AS truncated, least(n, {budget} - (upto - n))::BIGINT AS token_count_approx
FROM counted WHERE upto <= {budget} OR {budget} - (upto - n) >= {R.LEAST_CUT}"""


def cut(c: str, n: str) -> str:
    """The first ``n`` tokens of ``c``: the least prefix with that many."""
    return rf"rtrim(regexp_extract({c}, '^(?:\s*(?:{T.TOKEN})){{' || {n} || '}}'))"


RECORDED = f"""{BOOK},
flagged AS (SELECT s.*, r.signature IS NOT NULL AS gone, {command('s.text')} AS cmd FROM signed s LEFT JOIN repeated r ON s.document_id = r.document_id AND s.signature = r.signature),
joined AS (SELECT document_id, page_number, page_number % 97 = 3 AS failed, coalesce(string_agg(st, chr(10) || chr(10) ORDER BY block_index) FILTER (NOT gone AND st <> ''), '') AS t,
  coalesce(string_agg(st, '|' ORDER BY block_index) FILTER (gone), '') AS rt, count(*) FILTER (gone) AS rn, bool_or(cmd) AS c FROM flagged GROUP BY document_id, page_number),
whole AS (SELECT *, CASE WHEN failed THEN '' ELSE t END AS text, CASE WHEN failed THEN '' ELSE rt END AS removed, CASE WHEN failed THEN 0 ELSE rn END::INT AS removed_count, c AND NOT failed AS has_code,
  CASE WHEN failed THEN 0 WHEN page_number % 10 = 0 THEN 2 WHEN page_number % 5 = 0 THEN 1 ELSE 0 END AS image_count, (page_number % 6 = 1 AND NOT failed)::INT AS table_count FROM joined),
recorded AS (SELECT *, length(text)::BIGINT AS character_count, {words('text')}::BIGINT AS word_count, CASE WHEN image_count = 0 THEN 0 ELSE (page_number % 7) * 0.2::DOUBLE + image_count * 0.1::DOUBLE END AS max_image_coverage_ratio FROM whole)"""
_LISTS = {
    "empty_pages": "character_count = 0",
    "low_text_pages": "character_count BETWEEN 1 AND 79",
    "image_only_candidate_pages": "character_count < 50 AND max_image_coverage_ratio >= 0.6",
    "pages_with_code_blocks": "has_code",
    "pages_with_tables": "table_count > 0",
    "pages_with_images": "image_count > 0",
}
_PARENT = "schema_version, document_id, parent_id, parent_section_id, title, level, page_start, page_end, character_count, token_count_approx, contains_code, indexable, freshness_warning, content_hash, heading_path, source_block_ids, digest, source_title, source_author, source_publication_year, source_filename, source_sha256, citation"
_SHOWN = "query_id, position, context_type, parent_id, page_start, page_end, chunk_ids, sha256(text) AS text_sha256"
_EXTRA = ", ".join(f"('commands', {k}, {quoted(t)}, {0.3 if k % 2 else 0.0}::DOUBLE)" for k, t in enumerate(COMMAND_LINES))
_COMMANDS = f"""{BLOCKS}, every AS (SELECT document_id, pos, text, mono FROM blocks UNION ALL SELECT * FROM (VALUES {_EXTRA}) v(document_id, pos, text, mono))"""
_H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"


def _html() -> str:
    text = "CASE WHEN substr(piece, 2, 1) = chr(2) THEN substr(piece, 3) ELSE piece END"
    bare = f"regexp_replace({text}, {quoted(html.TAG)}, '', 'g')"
    for name, sign in html.REFERENCES:
        bare = f"replace({bare}, {quoted(name)}, {quoted(sign)})"
    body = f"regexp_replace(coalesce(html, ''), {quoted(html.LEFT_OUT)}, '', 'g')"
    marked = f"regexp_replace(regexp_replace({body}, {quoted(html.HEADING)}, chr(1) || '\\1' || chr(2), 'g'), {quoted(html.CUT)}, chr(1), 'g')"
    return f"""cuts AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS piece FROM (SELECT page_id, string_split({marked}, chr(1)) AS l FROM pages)),
bare AS (SELECT page_id, i, CASE WHEN substr(piece, 2, 1) = chr(2) THEN substr(piece, 1, 1)::INT END AS level, {squeeze(bare)} AS text FROM cuts),
shown AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS block_index FROM bare WHERE text <> '')"""


def queries() -> dict[str, str]:
    with_ = "WITH RECURSIVE "
    variants = lambda c: "list_sort(list_distinct(list_filter([" + ", ".join([squeeze(c), *(strip(f"regexp_replace({c}, {quoted(p)}, '')") for p in T.TITLE_PREFIXES)]) + "], lambda v: v <> '')))"
    made = rf"CASE doc_id % 4 WHEN 0 THEN 'Chapter ' || doc_id || ': ' WHEN 1 THEN 'Appendix B - ' WHEN 2 THEN 'Part iv. ' ELSE '' END || left(string_split(text, chr(10))[1], 60)"
    return {
        "token_count": f"SELECT doc_id, {tokens('text')}::BIGINT AS tokens FROM documents",
        "word_count": f"SELECT doc_id, {words('text')}::BIGINT AS words FROM documents",
        "clean_text": "SELECT page_id, length(replace(replace(replace(html || chr(13) || chr(10) || 'x' || chr(13), chr(0), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)))::BIGINT AS n, md5(replace(replace(html || chr(13) || chr(10) || 'x' || chr(13), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM pages",
        "collapse_whitespace": f"SELECT doc_id, md5({squeeze('text')}) AS digest FROM documents",
        "slugify": f"SELECT page_id, {slug(_H1)} AS slug FROM pages",
        "title_variants": f"SELECT doc_id, array_to_string({variants('(' + made + ')')}, ' | ') AS variants FROM documents",
        "content_hash": f"SELECT doc_id, {digest('text')} AS content_hash FROM documents",
        "preview": f"SELECT doc_id, CASE WHEN length(t) > 300 THEN left(t, 297) || '...' ELSE t END AS preview FROM (SELECT doc_id, {squeeze('text')} AS t FROM documents)",
        "block_flatten": f"{with_}{BLOCKS} SELECT document_id, page_number, block_index, source_block_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM blocks",
        "unit_numbering": f"{with_}{UNITS} SELECT document_id, source_block_id, global_index::INT AS global_index FROM units",
        "command_lines": f"{with_}{_COMMANDS} SELECT document_id, pos::INT AS pos, text FROM every WHERE {command('text')}",
        "code_blocks": f"""{with_}{_COMMANDS},
per AS (SELECT document_id, (pos // 5)::INT AS block, sum(length(text)) AS total, sum(floor(length(text) * mono)) AS m, count(*) FILTER ({command('text')}) AS c, count(*) AS n FROM every GROUP BY ALL)
SELECT document_id, block, m / total >= 0.55 OR c / n >= 0.4 OR (m / total >= 0.3 AND c > 0) AS likely_code_block, round_even(greatest(m / total, c / n), 4) AS code_confidence FROM per""",
        "margin_signatures": f"{with_}{BOOK} SELECT document_id, signature, pages::BIGINT AS pages FROM repeated",
        "margin_removal": f"{with_}{PAGES} SELECT document_id, page_number, character_count::BIGINT AS character_count, word_count::BIGINT AS word_count, removed_count, has_native_text FROM cleaned",
        "page_report": f"""{with_}{RECORDED},
listed AS (SELECT document_id, '1.0' AS schema_version, count(*) AS page_count, sum(character_count)::BIGINT AS total_character_count, FALSE AS ocr_used,
  count(*) FILTER (character_count = 0) AS empty_page_count, count(*) FILTER (character_count BETWEEN 1 AND 79) AS low_text_page_count, {', '.join(f"coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER ({c}), '') AS {n}" for n, c in _LISTS.items())},
  coalesce(string_agg('Page extraction failed on page ' || page_number || ': cannot be read', '|' ORDER BY page_number) FILTER (failed), '') AS warnings, count(*) FILTER (page_number % 4 = 0) AS toc_entry_count,
  coalesce(sum(CASE WHEN page_number % 10 = 0 THEN 2 WHEN page_number % 5 = 0 THEN 1 END), 0)::BIGINT AS image_metadata_count, count(*) FILTER (page_number % 6 = 1) AS table_count FROM recorded GROUP BY document_id)
SELECT l.*, (SELECT count(*) FROM repeated r WHERE r.document_id = l.document_id) AS repeated_margin_signature_count FROM listed l""",
        "page_records": f"""{with_}{RECORDED} SELECT document_id, page_number, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotation, character_count, word_count, text <> '' AS has_native_text, CASE WHEN failed THEN 'failed' ELSE 'native' END AS extraction_method, image_count, max_image_coverage_ratio, table_count,
  CASE WHEN failed THEN 'cannot be read' END AS extraction_error, removed_count, has_code, array_to_string(list_transform(range(1, image_count + 1), lambda i: document_id || printf('/page-%04d/image-%03d', page_number, i)), ',') AS image_ids,
  CASE WHEN table_count > 0 THEN document_id || printf('/page-%04d/table-001', page_number) ELSE '' END AS table_ids, removed, md5(text) AS digest FROM recorded""",
        "body_font_size": f"{with_}{BODY} SELECT document_id, body_font_size FROM body",
        "heading_candidates": f"{with_}{HEADINGS} SELECT document_id, global_index::INT AS global_index, ct AS title FROM leveled WHERE is_heading",
        "heading_levels": f"{with_}{HEADINGS} SELECT document_id, global_index::INT AS global_index, level FROM leveled",
        "level_stack_parent": f"{with_}{HEADINGS} SELECT document_id, event_id, level, parent_event_id FROM tree",
        "heading_path": f"{with_}{PATHS} SELECT document_id, event_id, heading_path FROM path",
        "section_intervals": f"{with_}{SECTIONS} SELECT document_id, global_index::INT AS global_index, event_id FROM inside",
        "section_records": f"""{with_}{SECTIONS}, {RECORDS}, tabled AS (SELECT s.section_id, string_agg(t.document_id || printf('/page-%04d/table-001', t.page_number), ',' ORDER BY t.page_number) AS table_ids
  FROM sections s JOIN (SELECT DISTINCT document_id, page_number FROM blocks) t ON t.document_id = s.document_id AND t.page_number BETWEEN s.page_start AND s.page_end GROUP BY ALL)
SELECT '1.0' AS schema_version, s.document_id, s.section_id, parent_section_id, section_number::INT AS section_number, title, level, page_start, page_end, character_count::BIGINT AS character_count, word_count::BIGINT AS word_count, contains_code, indexable,
  heading_path, block_ids AS source_block_ids, table_ids, CASE WHEN short THEN 'short-section' ELSE '' END AS quality_flags, md5(text) AS digest, 'font-heading' AS method, anchor_page, anchor_block_id, 1.0::DOUBLE AS anchor_score, {SOURCE},
  doc_title || '|' || title || '|' || page_start || '|' || page_end AS citation
FROM sections s JOIN recs USING (document_id) JOIN tabled t ON t.section_id = s.section_id""",
        "section_table_ids": f"""{with_}{SECTIONS}, tables AS (SELECT document_id, page_number, document_id || printf('/page-%04d/table-001', page_number) AS table_id FROM (SELECT DISTINCT document_id, page_number FROM blocks))
SELECT s.document_id, s.section_id, string_agg(t.table_id, ',' ORDER BY t.page_number) AS table_ids FROM sections s JOIN tables t ON t.document_id = s.document_id AND t.page_number BETWEEN s.page_start AND s.page_end GROUP BY ALL""",
        "indexable_titles": f"{with_}{HEADINGS} SELECT document_id, event_id, NOT regexp_matches(title, {quoted(T.NON_INDEXABLE)}) AS indexable FROM events",
        "section_report": f"""{with_}{SECTIONS}, per AS (SELECT document_id, count(*) AS section_count, count(*) FILTER (indexable) AS indexable_section_count, count(*) FILTER (NOT indexable) AS non_indexable_section_count, count(*) FILTER (contains_code) AS sections_with_code_count, count(*) FILTER (short) AS short_section_count FROM sections GROUP BY document_id),
counted AS (SELECT document_id, count(*) AS heading_event_count FROM events GROUP BY document_id)
SELECT printf('doc-%06d', d.doc_id) AS document_id, '1.0' AS schema_version, 'font' AS detection_mode, body_font_size, coalesce(heading_event_count, 0) AS heading_event_count, coalesce(section_count, 0) AS section_count, coalesce(indexable_section_count, 0) AS indexable_section_count,
  coalesce(non_indexable_section_count, 0) AS non_indexable_section_count, coalesce(sections_with_code_count, 0) AS sections_with_code_count, coalesce(short_section_count, 0) AS short_section_count, 0::BIGINT AS fallback_anchor_count, 0::BIGINT AS low_confidence_anchor_count, '' AS warnings
FROM documents d LEFT JOIN body b ON b.document_id = printf('doc-%06d', d.doc_id) LEFT JOIN counted c ON c.document_id = printf('doc-%06d', d.doc_id) LEFT JOIN per p ON p.document_id = printf('doc-%06d', d.doc_id)""",
        "warned_report": f"""{with_}{SECTIONS}, counted AS (SELECT document_id, count(*) AS section_count FROM sections GROUP BY document_id),
outlined AS (SELECT document_id, text AS title, page_number, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS k FROM blocks WHERE font_size > 10),
lost AS (SELECT document_id, count(*)::INT AS n_warnings, string_agg(printf('Could not resolve TOC entry ''%s'' on page %d.', title, page_number), '|' ORDER BY k) AS warnings FROM outlined WHERE k % 3 = 0 GROUP BY document_id)
SELECT printf('doc-%06d', d.doc_id) AS document_id, 'toc' AS detection_mode, coalesce(section_count, 0) AS section_count, coalesce(n_warnings, 0) AS n_warnings, coalesce(warnings, '') AS warnings
FROM documents d LEFT JOIN counted c ON c.document_id = printf('doc-%06d', d.doc_id) LEFT JOIN lost l ON l.document_id = printf('doc-%06d', d.doc_id)""",
        "detection_modes": f"""WITH {BLOCKS} SELECT printf('doc-%06d', doc_id) AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'toc' WHEN doc_id % 3 = 1 THEN 'font' WHEN doc_id % 4 <> 3 AND EXISTS (SELECT 1 FROM blocks b WHERE head AND b.document_id = printf('doc-%06d', doc_id)) THEN 'toc' ELSE 'font' END AS detection_mode FROM documents""",
        "split_oversized": f"{with_}{DOC_ATOMS} SELECT document_id, pos::INT AS pos, part::INT AS part, tok::BIGINT AS tokens, md5(text) AS digest FROM atoms",
        "section_atoms": f"{with_}{section_atoms()} SELECT document_id, section_id, source_block_id, part::INT AS part, page_number, tok::BIGINT AS token_count FROM atoms",
        "overlap_chunks": f"{with_}{DOC_CHUNKS} SELECT document_id, chunk_number, token_count, page_start, page_end, {digest('text')} AS content_hash FROM chunks",
        "parent_records": f"{with_}{section_atoms()}, {PARENTS} SELECT {_PARENT} FROM parents",
        "parent_records_lost": f"{with_}{section_atoms(LOST)}, {PARENTS} SELECT {_PARENT} FROM parents",
        "chunk_records": f"""{with_}{CHUNKS} SELECT '1.0' AS schema_version, chunk_id, section_id AS parent_id, section_id, document_id, chunk_number, title, page_start, page_end, length(text)::BIGINT AS character_count, token_count AS token_count_approx, contains_code, freshness_warning, content_hash,
  heading_path, source_block_ids, quality_flags, md5(embedding_text) AS embedding_digest, source_title, source_author, source_publication_year, source_filename, source_sha256, citation FROM chunks""",
        "embedding_text": f"{with_}{CHUNKS} SELECT chunk_id, md5(embedding_text) AS digest FROM chunks",
        "lexical_text": f"{with_}{CHUNKS} SELECT chunk_id, md5(title || chr(10) || replace(heading_path, ' > ', ' ') || chr(10) || text) AS digest FROM chunks",
        "payload": f"""{with_}{CHUNKS} SELECT chunk_id, section_id AS parent_id, section_id, document_id, chunk_number, title, page_start, page_end, contains_code, freshness_warning, content_hash, token_count AS token_count_approx, length(text)::BIGINT AS character_count,
  heading_path, source_block_ids, quality_flags, md5(text) AS digest, source_title, source_author, source_publication_year, source_filename, source_sha256, citation FROM chunks""",
        "chunk_dedup": f"SELECT doc_id, {digest('text')} AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY source, content_hash ORDER BY doc_id) = 1",
        "chunk_report": f"""{with_}{chunks(LOST)}, gone AS (SELECT i.document_id, string_agg(DISTINCT source_block_id, ',' ORDER BY source_block_id) AS missing_source_blocks, count(DISTINCT source_block_id) AS missing_source_block_count
  FROM inside i JOIN sections s ON s.section_id = i.section_id WHERE s.indexable AND ({LOST.replace('page_number', 'i.page_number').replace('document_id', 'i.document_id')}) GROUP BY i.document_id),
per AS (SELECT document_id, count(*) AS source_section_count, count(*) FILTER (indexable) AS indexable_section_count, count(*) FILTER (indexable) AS parent_count FROM sections GROUP BY document_id),
kept AS (SELECT document_id, count(*) AS chunk_count, min(token_count) AS minimum_chunk_tokens, max(token_count) AS maximum_chunk_tokens, round_even(avg(token_count), 2) AS average_chunk_tokens, count(*) FILTER (token_count < {LEAST}) AS short_chunk_count, count(*) FILTER (contains_code) AS chunks_with_code_count FROM chunks GROUP BY document_id),
every AS (SELECT document_id, count(*) AS n FROM chunked GROUP BY document_id)
SELECT p.*, coalesce(chunk_count, 0) AS chunk_count, coalesce(minimum_chunk_tokens, 0) AS minimum_chunk_tokens, coalesce(maximum_chunk_tokens, 0) AS maximum_chunk_tokens, coalesce(average_chunk_tokens, 0) AS average_chunk_tokens, coalesce(short_chunk_count, 0) AS short_chunk_count,
  coalesce(chunks_with_code_count, 0) AS chunks_with_code_count, coalesce(n - chunk_count, 0) AS duplicate_chunk_count, coalesce(missing_source_block_count, 0) AS missing_source_block_count, coalesce(missing_source_blocks, '') AS missing_source_blocks
FROM per p LEFT JOIN kept USING (document_id) LEFT JOIN every USING (document_id) LEFT JOIN gone USING (document_id)""",
        "missing_blocks": f"{with_}{SECTIONS} SELECT document_id, section_id, source_block_id FROM inside WHERE likely_code_block",
        "avg_doc_length": rf"SELECT round_even(greatest(1.0, avg(greatest(1, len(regexp_extract_all({casefold('text')}, '[\p{{L}}\p{{N}}_]+'))))), 4) AS avg_length FROM documents",
        "bm25_postings": rf"""SELECT doc_id, term, count(*) AS tf, any_value(length)::INT AS length FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all({casefold('text')}, '[\p{{L}}\p{{N}}_]+') AS w FROM documents)) GROUP BY doc_id, term""",
        "bm25_topk": f"WITH {bm25('documents', 'doc_id')} SELECT query_id, doc_id, score, rank::INT AS rank FROM hits",
        "dense_topk": f"WITH {dense(PROBES)} SELECT query_id, vec_id, score, rank::INT AS rank FROM dense",
        "page_grids": f"WITH {grids()}",
        "font_histogram": f"WITH {BLOCKS} SELECT document_id, page_number, round_even((font_size + page_number % 4 * 0.25) * 2, 0) / 2 AS size, sum(length({strip('text')}))::BIGINT AS characters FROM blocks WHERE {strip('text')} <> '' GROUP BY ALL",
        "vector_topk": f"WITH {dense(PROBES)} SELECT query_id, vec_id, score, rank::INT AS rank FROM dense",
        "bm25_stemmed": f"WITH {bm25('documents', 'doc_id', language='english')} SELECT query_id, doc_id, score, rank::INT AS rank FROM hits",
        "bm25_truncated": f"WITH {bm25('documents', 'doc_id', truncated=True)} SELECT query_id, doc_id, score, rank::INT AS rank FROM hits",
        "stemmed_terms": "WITH termed AS (SELECT doc_id, CASE lang "
        + " ".join(f"WHEN '{code}' THEN {stemmed(WORDS, name)}" for code, name in (("en", "english"), ("de", "german"), ("fr", "french"), ("es", "spanish")))
        + f" ELSE {WORDS} END AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n_terms, md5(array_to_string(w, ' ')) AS digest FROM termed",
        "dense_topk_filtered": f"WITH {dense(PROBES, 'v.label = 3')} SELECT query_id, vec_id, score, rank::INT AS rank FROM dense",
        "rrf_fusion": f"""WITH {bm25('documents', 'doc_id')}, {dense('SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id')},
{fused('SELECT query_id, doc_id, rank FROM hits UNION ALL SELECT query_id, vec_id, rank FROM dense', 'doc_id', 1 << 40)}
SELECT query_id, doc_id, score, rank::INT AS rank FROM fused""",
        "hybrid_search": f"""WITH {bm25('documents', 'doc_id')}, {dense('SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id')},
{fused('SELECT query_id, doc_id, rank FROM hits UNION ALL SELECT query_id, vec_id, rank FROM dense', 'doc_id', R.CANDIDATES)},
capped AS (SELECT f.*, source AS parent_id FROM fused f JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= {R.PER_PARENT})
SELECT query_id, doc_id, parent_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS position FROM capped QUALIFY position <= {R.TOP_K}""",
        "diversify": f"WITH {HITS} SELECT query_id, chunk_id, parent_id, position::INT AS position FROM best",
        "context_child": f"WITH {HITS} SELECT query_id, position::INT AS position, 'child' AS context_type, parent_id, page_start, page_end, chunk_id AS chunk_ids, sha256(text) AS text_sha256 FROM best",
        "context_parent": f"WITH {FIRSTS} SELECT f.query_id, f.position::INT AS position, 'parent' AS context_type, f.parent_id, c.page_start, c.page_end, '' AS chunk_ids, sha256(c.text) AS text_sha256 FROM firsts f JOIN convs c ON c.parent_id = f.parent_id",
        "context_neighbors": f"{with_}{merged()} SELECT f.query_id, f.position::INT AS position, 'neighbours' AS context_type, f.parent_id, a.page_start, a.page_end, a.chunk_ids, sha256(a.text) AS text_sha256 FROM firsts f JOIN around a ON a.query_id = f.query_id AND a.position = f.position",
        "context_auto": f"{with_}{auto(300)} SELECT {_SHOWN.replace('position,', 'position::INT AS position,')} FROM passages",
        "merge_overlap": f"{with_}{merged()} SELECT query_id, position::INT AS position, sha256(text) AS text_sha256 FROM around",
        "context_budget": f"""{with_}{auto(300)}, summed AS (SELECT *, {tokens('text')} AS n, sum({tokens('text')}) OVER (PARTITION BY query_id ORDER BY position) AS upto FROM passages)
SELECT query_id, position::INT AS position, upto > 600 AS truncated, least(n, 600 - (upto - n))::BIGINT AS token_count_approx FROM summed WHERE upto <= 600 OR 600 - (upto - n) >= {R.LEAST_CUT}""",
        "truncate_budget": f"SELECT doc_id, md5(CASE WHEN {tokens('text')} <= 100 THEN text ELSE {cut('text', '100')} END) AS digest FROM documents",
        "validate_corpus": "WITH c AS (SELECT conv_id, turn, text FROM conversations) SELECT 'chunk-id-twice' AS rule, printf('conv-%06d', conv_id) AS id FROM c GROUP BY conv_id HAVING count(*) > 1",
        "orphan_chunks": "SELECT printf('conv-%06d/turn-%03d', conv_id, turn) AS chunk_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 4)",
        "index_report": f"""{with_}{CHUNKS}, named AS (SELECT document_id, title || chr(10) || replace(heading_path, ' > ', ' ') || chr(10) || text AS t FROM chunks)
SELECT (SELECT count(DISTINCT document_id) FROM chunks) AS document_count, (SELECT count(*) FROM sections WHERE indexable) AS parent_count, (SELECT count(*) FROM chunks) AS chunk_count,
(SELECT round_even(avg(len(regexp_extract_all({casefold('t')}, '[\\p{{L}}\\p{{N}}_]+'))), 4) FROM named) AS average_lexical_length, 64 AS dense_dimension""",
        "stable_point_id": f"""WITH h AS (SELECT doc_id, sha1(unhex('{T.POINT_NAMESPACE}') || encode('{T.POINT_PREFIX}' || printf('doc-%06d', doc_id))) AS s FROM documents)
SELECT doc_id, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', s[17:17]) - 1) % 4 + 1, 1) || s[18:20] || '-' || s[21:32] AS point_id FROM h""",
        "index_points": f"""{with_}{CHUNKS}, texts AS (SELECT chunk_id, embedding_text AS text FROM chunks), {hashed('cv', 'texts', 'chunk_id')},
ids AS (SELECT chunk_id, content_hash, sha1(unhex('{T.POINT_NAMESPACE}') || encode('{T.POINT_PREFIX}' || chunk_id)) AS h FROM chunks)
SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id, chunk_id, content_hash, k, round(v, 6) AS v FROM cv JOIN ids USING (chunk_id) WHERE round(v, 6) <> 0""",
        "index_postings": rf"""{with_}{CHUNKS}, named AS (SELECT chunk_id, title || chr(10) || replace(heading_path, ' > ', ' ') || chr(10) || text AS text FROM chunks),
worded AS (SELECT chunk_id, regexp_extract_all({casefold('text')}, '[\p{{L}}\p{{N}}_]+') AS w FROM named),
tallied AS (SELECT chunk_id, term, count(*) AS tf, any_value(n)::INT AS length FROM (SELECT chunk_id, len(w) AS n, unnest(w) AS term FROM worded) GROUP BY chunk_id, term)
SELECT chunk_id, term, tf, length, count(*) OVER (PARTITION BY term) AS df FROM tallied""".replace("\\\\p", "\\p"),
        "index_statistics": rf"""{with_}{CHUNKS}, named AS (SELECT chunk_id, title || chr(10) || replace(heading_path, ' > ', ' ') || chr(10) || text AS text FROM chunks)
SELECT count(*) AS n, round_even(avg(len(regexp_extract_all({casefold('text')}, '[\p{{L}}\p{{N}}_]+'))), 4) AS avg_length FROM named""".replace("\\\\p", "\\p"),
        "search_hits": f"{with_}{search()} SELECT query_id, chunk_id, parent_id, score, rank::INT AS rank, position::INT AS position FROM best",
        "search_updated": f"{with_}{search()} SELECT query_id, chunk_id, parent_id, score, rank::INT AS rank, position::INT AS position FROM best",
        "search_compacted": f"{with_}{search()} SELECT query_id, chunk_id, parent_id, score, rank::INT AS rank, position::INT AS position FROM best",
        "search_stemmed": f"{with_}{CHUNKS}, {NAMED}, {bm25('named', 'chunk_id', language='english')} SELECT query_id, chunk_id, score, rank::INT AS rank FROM hits",
        "index_manifest": rf"""{with_}{CHUNKS}, {NAMED}
SELECT (SELECT count(DISTINCT document_id) FROM chunks) AS document_count, count(*) AS chunk_count, round_even(avg(greatest(1, len(regexp_extract_all({casefold('text')}, '[\p{{L}}\p{{N}}_]+')))), 4) AS average_lexical_length, 64 AS dense_dimension,
(SELECT string_agg(document_id, ',' ORDER BY document_id) FROM (SELECT DISTINCT document_id FROM chunks)) AS document_ids FROM named""",
        "search_filtered": f"{with_}{search('document_id[5:]::INT % 2 = 0')} SELECT query_id, chunk_id, parent_id, score, rank::INT AS rank, position::INT AS position FROM best",
        "search_contexts": f"{with_}{found('neighbors', budget=900)}",
        "search_merged_text": f"{with_}{around('neighbors')} SELECT query_id, position::INT AS position, chunk_ids, sha256(text) AS text_sha256 FROM passages",
        "search_auto": f"{with_}{found('auto', limit=250)}",
        "html_blocks": f"WITH {_html()} SELECT page_id, block_index::INT AS block_index, level, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM shown",
        "html_outline": f"""WITH {_html()}, heads AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_index) AS o, level, text FROM shown WHERE level IS NOT NULL),
ups AS (SELECT e.page_id, e.o, arg_max(p.level, p.o) AS lv, arg_max(p.o, p.o) AS up FROM heads e JOIN heads p ON p.page_id = e.page_id AND p.o < e.o AND p.level < e.level GROUP BY ALL)
SELECT h.page_id::VARCHAR AS document_id, printf('toc-%04d', h.o) AS toc_id, CASE WHEN ups.lv = h.level - 1 THEN printf('toc-%04d', ups.up) END AS parent_toc_id, h.level, h.text AS title FROM heads h LEFT JOIN ups ON ups.page_id = h.page_id AND ups.o = h.o""",
        "content_range": f"{with_}{BLOCKS} SELECT document_id, source_block_id, (row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1)::INT AS global_index FROM blocks WHERE page_number BETWEEN 2 AND 3",
        "font_statistics": f"{with_}{BLOCKS} SELECT document_id, page_number, sum(length(text))::BIGINT AS characters, round_even(sum(CASE WHEN bold_ratio > 0 THEN length(text) ELSE 0 END) / sum(length(text)), 4) AS bold_ratio, round_even(sum(CASE WHEN mono > 0 THEN length(text) ELSE 0 END) / sum(length(text)), 4) AS monospaced_ratio, max(font_size) AS maximum_font_size FROM blocks GROUP BY ALL",
        "manual_chapters": f"""{with_}{HEADINGS}, starts AS (SELECT * FROM leveled WHERE page_number = 1 AND NOT {_NUMERAL.format('ct')}
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY is_heading DESC, CASE WHEN is_heading THEN font_size END DESC NULLS LAST, CASE WHEN is_heading THEN bold_ratio END DESC NULLS LAST, block_index) = 1)
SELECT document_id, 'Start of ' || document_id AS title, global_index::INT AS anchor_index, 'manual-chapter-anchor' AS detection_method FROM starts
UNION ALL SELECT e.document_id, e.title, e.anchor_index::INT, 'font-heading' FROM events e LEFT JOIN starts s ON s.document_id = e.document_id AND s.global_index = e.anchor_index WHERE s.document_id IS NULL""",
        "dense_text": f"{with_}{CHUNKS} SELECT chunk_id, md5('Title : ' || title || chr(10) || 'Section: ' || heading_path || chr(10) || chr(10) || text) AS digest FROM chunks",
        "unknown_ids": "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
        "file_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "toc_parents": f"""WITH RECURSIVE {BLOCKS}, toc AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS o, CASE WHEN font_size = 16 THEN 1 WHEN font_size = 12 THEN 2 ELSE 3 END AS level FROM blocks WHERE head),
ups AS (SELECT e.document_id, e.o, arg_max(p.level, p.o) AS lv, arg_max(p.o, p.o) AS up FROM toc e JOIN toc p ON p.document_id = e.document_id AND p.o < e.o AND p.level < e.level GROUP BY ALL)
SELECT t.document_id, printf('toc-%04d', t.o) AS toc_id, t.level, CASE WHEN ups.lv = t.level - 1 THEN printf('toc-%04d', ups.up) END AS parent_toc_id FROM toc t LEFT JOIN ups ON t.document_id = ups.document_id AND t.o = ups.o""",
    }
