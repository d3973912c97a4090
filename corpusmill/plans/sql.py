"""The queries' equivalents in SQL: named steps that are put together by what a query needs."""

from __future__ import annotations

import re

from corpusmill.operators.titles import KEYWORDS, PUNCTUATION_CLASS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql.strip()


def needs(sql: str) -> list[str]:
    found: list[str] = []
    for name in STEPS:
        if re.search(rf"\b{name}\b", sql) and STEPS[name] != sql.strip():
            for x in [*needs(STEPS[name]), name]:
                if x not in found:
                    found.append(x)
    return found


def build(sql: str) -> str:
    found = needs(sql)
    if not found:
        return sql
    parts = [STEPS[n] if STEPS[n].startswith("walk_") else f"{n} AS MATERIALIZED ({STEPS[n]})" for n in found]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


LANGUAGE = "CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Spanish' END"
WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"


def words(c: str) -> str:
    return WORDS.format(c)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def token_set(c: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({strip(c)}), '[a-z0-9'']+')))"


def vector(c: str) -> str:
    """The hash embedding, normalised."""
    codes = f"list_transform(regexp_extract_all(lower({c}), '[a-z0-9'']+'), lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT))"
    counts = f"list_transform(range(0, 64), lambda b: CAST(coalesce(list_sum(list_transform({codes}, lambda h: CASE WHEN h % 64 <> b THEN 0 WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)), 0) AS DOUBLE))"
    return counts


def unit(v: str) -> str:
    n = f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"CASE WHEN {n} > 0 THEN list_transform({v}, lambda x: x / {n}) ELSE {v} END"


step("files", f"""
SELECT doc_id, doc_id AS file_no, stem, stem || '.pdf' AS filename, 'data/source/' || language || '/' || stem || '.pdf' AS file_path, language
FROM (SELECT doc_id, array_to_string({words('text')}[1:3], ' ') || '_' || doc_id AS stem, {LANGUAGE} AS language FROM documents)""")
step("raw_blocks", f"SELECT doc_id, {LANGUAGE} AS language, unnest(regexp_split_to_array(text, '[.,\\n]+')) AS raw, unnest(range(0, len(regexp_split_to_array(text, '[.,\\n]+')))) AS block_no FROM documents")
step("sized_blocks", "SELECT doc_id, language, CAST(block_no AS INT) AS block_no, trim(raw) AS text, least(length(trim(raw)) * 5.0::DOUBLE, 540.0::DOUBLE) AS w FROM raw_blocks WHERE trim(raw) <> ''")
step("placed_blocks", "SELECT *, CAST(block_no // 12 + 1 AS INT) AS page_number, CASE WHEN (doc_id + block_no) % 7 = 0 THEN 306 - w / 2 ELSE 36.0::DOUBLE END AS x0, CAST(40 + block_no % 12 * 24 AS DOUBLE) AS y0 FROM sized_blocks")
step("blocks", "SELECT doc_id, language, page_number, block_no, text, x0, y0, x0 + w AS x1, y0 + 12 + ((doc_id + block_no) % 4) * 4 AS y1 FROM placed_blocks")
step("kana_blocks", "SELECT doc_id, page_number, block_no, CASE WHEN (doc_id + block_no) % 9 = 0 THEN translate(text, 'abc', 'かきく') ELSE text END AS text, x0, y0, x1, y1 FROM blocks")
step("worded_blocks", f"SELECT *, {words('text')} AS ws FROM blocks")
step("spans", """
SELECT doc_id, page_number, block_no, 0 AS line_no, i - 1 AS span_no, CASE WHEN block_no % 11 = 10 THEN 1 ELSE 0 END AS block_type, ws[i] || ' ' AS text,
  x0 + 5.0::DOUBLE * coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x) + 1)), 0) AS x0, y0,
  x0 + 5.0::DOUBLE * coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x) + 1)), 0) + 5.0::DOUBLE * length(ws[i]) AS x1, y1
FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM worded_blocks)""")
step("page_words", "SELECT doc_id, page_number, block_no * 100000 + span_no AS word_no, rtrim(text) AS text, x0, y0 + span_no % 5 AS y0, x1, y1 FROM spans")
step("span_lines", """
SELECT * FROM (SELECT doc_id, page_number, block_no, line_no, trim(string_agg(text, '' ORDER BY x0, span_no)) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
FROM spans WHERE block_type = 0 GROUP BY ALL) WHERE text <> ''""")
step("paragraphs", """
SELECT doc_id, page_number, min(block_no) AS block_no, string_agg(text, ' ' ORDER BY y0, block_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, arg_max(y1, y0 * 100000 + block_no) AS y1
FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY y0, block_no) AS island
  FROM (SELECT *, coalesce(CASE WHEN y0 - lag(y1) OVER (PARTITION BY doc_id, page_number ORDER BY y0, block_no) >= 5 THEN 1 ELSE 0 END, 1) AS new FROM blocks))
GROUP BY doc_id, page_number, island""")
step("word_lines", """
SELECT doc_id, page_number, CAST(line AS INT) AS line_no, string_agg(text, ' ' ORDER BY y0, x0, word_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, word_no) AS line
  FROM (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, word_no)) < 5 THEN 0 ELSE 1 END AS new, count(*) OVER (PARTITION BY doc_id, page_number) AS n FROM page_words) WHERE n > 5)
GROUP BY doc_id, page_number, line""")
step("page_texts", """
SELECT doc_id, page_number, string_agg(CASE WHEN nth = 1 THEN text ELSE sep || text END, '' ORDER BY nth) AS text
FROM (SELECT *, CASE WHEN y0 - lag(y1) OVER w > 10 THEN chr(10) ELSE ' ' END AS sep, row_number() OVER w AS nth FROM blocks WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, block_no))
GROUP BY doc_id, page_number""")
_keywords = " OR ".join(f"(doc_language = {quoted(lang)} AND regexp_matches(text, {quoted('|'.join(map(re.escape, ws)))}))" for lang, ws in KEYWORDS.items())
step("seen_blocks", """
SELECT *, CASE WHEN max(x1) OVER (PARTITION BY doc_id, page_number) > 0 THEN max(x1) OVER (PARTITION BY doc_id, page_number) ELSE 612 END AS width,
  first_value(language) OVER (PARTITION BY doc_id ORDER BY page_number, block_no) AS doc_language, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_number) AS page_pos, max(page_number) OVER (PARTITION BY doc_id) AS last_page
FROM blocks""")
step("candidates", f"""
SELECT doc_id, page_number, block_no, text AS title, CAST(page_pos AS INT) AS page_pos, last_page FROM seen_blocks
WHERE NOT regexp_matches(text, {quoted(PUNCTUATION_CLASS)}) AND ({_keywords} OR (x0 + x1) / 2 BETWEEN width * 0.4::DOUBLE AND width * 0.6::DOUBLE)
  AND CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN length(text) <= 7 WHEN regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}]') THEN length(text) <= 8 WHEN doc_language = 'English' THEN len({words('text')}) <= 7 ELSE length(text) <= 7 END""")
step("ranked_candidates", """
SELECT *, max(times) OVER (PARTITION BY doc_id) AS most FROM (
  SELECT *, max(CASE WHEN page_pos <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS early, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_no) AS on_page,
    count(*) OVER (PARTITION BY doc_id, title) AS times, row_number() OVER (PARTITION BY doc_id, title ORDER BY page_number, block_no) AS nth FROM candidates)""")
step("found_titles", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block_no) AS INT) AS seq, title, page_number AS start_page, last_page FROM ranked_candidates
WHERE (early = 1 AND on_page = 1) OR (early = 0 AND (most = 1 OR (times > 1 AND nth = 1)))""")
step("ranges", "SELECT doc_id, seq, title, start_page, CAST(coalesce(lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page, seq) - 1, last_page) AS INT) AS end_page FROM found_titles")
step("page_titles", """
SELECT p.doc_id, p.page_number, coalesce(last_value(t.title IGNORE NULLS) OVER (PARTITION BY p.doc_id ORDER BY p.page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section_title
FROM page_texts p LEFT JOIN (SELECT doc_id, start_page, arg_max(title, seq) AS title FROM ranges GROUP BY ALL) t ON p.doc_id = t.doc_id AND p.page_number = t.start_page""")


def _walk(name: str, source: str, keys: str) -> None:
    """The chunker over a text column: (keys, nth, s, e)."""
    def end(s: str) -> str:
        w = f"substr(text, {s} + 1, 512)"
        back = f"least(CASE WHEN strpos(reverse({w}), '.') > 0 THEN strpos(reverse({w}), '.') ELSE 513 END, CASE WHEN strpos(reverse({w}), '。') > 0 THEN strpos(reverse({w}), '。') ELSE 513 END)"
        stop = f"{s} + length({w}) - {back}"
        return f"CASE WHEN {s} + 512 < n AND {stop} > {s} + 256 THEN {stop} + 1 ELSE {s} + 512 END"

    step(f"walk_{name}", f"""walk_{name}({keys}, text, n, nth, s, e) AS (
SELECT {keys}, text, n, 0, 0, {end('0')} FROM (SELECT {keys}, text, length(text) AS n FROM {source} WHERE text <> '')
UNION ALL SELECT {keys}, text, n, nth + 1, e - 50, {end('(e - 50)')} FROM walk_{name} WHERE e < n)""")


_walk("page", "page_texts", "doc_id, page_number")
_walk("doc", "documents", "doc_id")
step("page_chunks", f"""
SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY nth) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id, page_number) AS INT) AS total_chunks_in_page, text
FROM (SELECT doc_id, page_number, nth, {strip('substr(text, s + 1, least(e, n) - s)')} AS text FROM walk_page) WHERE text <> ''""")
step("doc_chunks", f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS INT) AS chunk_index, text FROM (SELECT doc_id, nth, {strip('substr(text, s + 1, least(e, n) - s)')} AS text FROM walk_doc) WHERE text <> ''""")
step("chunks", """
SELECT stem || '_p' || lpad(CAST(c.page_number AS VARCHAR), CAST(greatest(3, length(CAST(c.page_number AS VARCHAR))) AS INT), '0') || '_c' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS id, c.doc_id, c.page_number, chunk_index, total_chunks_in_page, section_title, c.text,
  substr(md5(c.text), 1, 16) AS text_hash, b.x0, b.y0, b.x1, b.y1, filename, f.language
FROM page_chunks c JOIN page_titles s ON c.doc_id = s.doc_id AND c.page_number = s.page_number JOIN files f ON c.doc_id = f.doc_id
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_no) AS k FROM blocks) WHERE k = 1) b ON c.doc_id = b.doc_id AND c.page_number = b.page_number""")
step("parents", """
SELECT p.doc_id, filename, file_path, p.language, total_pages, CAST(coalesce(total_chunks, 0) AS BIGINT) AS total_chunks
FROM (SELECT doc_id, CAST(count(DISTINCT page_number) AS INT) AS total_pages, arg_min(language, block_no) AS language FROM blocks GROUP BY doc_id) p
LEFT JOIN (SELECT doc_id, count(*) AS total_chunks FROM chunks GROUP BY doc_id) c ON p.doc_id = c.doc_id JOIN files f ON p.doc_id = f.doc_id""")
step("section_index", f"""
SELECT filename, section_title, list_sort(list_distinct(list(page_number))) AS pages, {token_set('section_title')} AS tokens FROM chunks WHERE {strip('section_title')} <> '' GROUP BY filename, section_title""")
step("short_queries", f"""
SELECT d.doc_id AS query_id, array_to_string({words('d.text')}[1:6], ' ') || CASE WHEN d.doc_id % 50 = 0 THEN ' 1-3' ELSE '' END || CASE WHEN d.doc_id % 75 = 0 THEN ' [仅在文件：' || filename || ']' ELSE '' END AS query, 10 AS top_k
FROM documents d JOIN files f ON d.doc_id = f.doc_id WHERE d.doc_id % 25 = 0""")
step("parsed_queries", rf"""
SELECT query_id, query, top_k, rtrim(regexp_replace(query, '\s*\[仅在文件：(.+?)\]\s*$', '')) AS plain_query, nullif(regexp_extract(query, '\[仅在文件：(.+?)\]', 1), '') AS filter_pdf,
  TRY_CAST(nullif(regexp_extract(query, '[第]?\s*(\d+)\s*[-至到]\s*(\d+)\s*[页]?', 1), '') AS INT) AS first_page, TRY_CAST(nullif(regexp_extract(query, '[第]?\s*(\d+)\s*[-至到]\s*(\d+)\s*[页]?', 2), '') AS INT) AS last_page,
  CASE WHEN regexp_matches(query, '[一-鿿]') THEN list_sort(list_distinct(list_filter(string_split(lower(query), ''), lambda x: trim(x) <> ''))) ELSE {token_set('query')} END AS q_tokens
FROM short_queries""")
step("file_tokens", f"SELECT filename, file_no, CASE WHEN regexp_matches(filename, '[一-鿿]') THEN [] ELSE {token_set(chr(34) + 'stem' + chr(34))} END AS tokens FROM files")
step("q_words", "SELECT query_id, len(q_tokens) AS q_size, unnest(q_tokens) AS token FROM parsed_queries")
step("file_overlap", "SELECT query_id, filename, file_no, count(*) / greatest(1, first(q_size)) AS overlap FROM q_words JOIN (SELECT filename, file_no, unnest(tokens) AS token FROM file_tokens) USING (token) GROUP BY ALL")
step("title_overlap", "SELECT query_id, filename, section_title, count(*) / greatest(1, first(q_size)) AS overlap FROM q_words JOIN (SELECT filename, section_title, unnest(tokens) AS token FROM section_index) USING (token) GROUP BY ALL")
step("matches", """
SELECT query_id, 'file' AS kind, f.filename, section_title FROM (SELECT query_id, filename FROM file_overlap WHERE overlap >= 0.5) f LEFT JOIN section_index s ON f.filename = s.filename
UNION ALL SELECT query_id, 'section', filename, section_title FROM title_overlap t WHERE overlap >= 0.5 AND NOT EXISTS (SELECT 1 FROM file_overlap f WHERE f.overlap >= 0.5 AND f.query_id = t.query_id AND f.filename = t.filename)""")
step("allowed", """
SELECT h.query_id, h.id FROM (
  SELECT DISTINCT m.query_id, c.id, c.page_number FROM chunks c JOIN (SELECT DISTINCT query_id, filename FROM matches) m ON c.filename = m.filename
  UNION SELECT DISTINCT m.query_id, c.id, c.page_number FROM chunks c JOIN (SELECT DISTINCT query_id, section_title FROM matches WHERE section_title IS NOT NULL) m ON c.section_title = m.section_title) h
JOIN parsed_queries q ON h.query_id = q.query_id WHERE first_page IS NULL OR h.page_number BETWEEN first_page AND last_page""")


# Vectors: token codes first, so that they are computed once a text


def _vectors(name: str, source: str, keys: str, text: str) -> None:
    step(f"{name}_codes", f"SELECT {keys}, list_transform(regexp_extract_all(lower({text}), '[a-z0-9'']+'), lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT)) AS codes FROM {source}")
    step(f"{name}_counts", f"SELECT {keys}, list_transform(range(0, 64), lambda b: CAST(len(list_filter(codes, lambda h: h % 64 = b AND (h // 64) % 2 = 0)) - len(list_filter(codes, lambda h: h % 64 = b AND (h // 64) % 2 = 1)) AS DOUBLE)) AS v FROM {name}_codes")
    step(f"{name}_norms", f"SELECT {keys}, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM {name}_counts")
    step(f"{name}_vectors", f"SELECT {keys}, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS vector FROM {name}_norms")


_vectors("chunk", "chunks", "id, filename, section_title, page_number, text", "text")
_vectors("passage", "benchmark", "item_id", "text")
_vectors("short", "augmented", "query_id, query, filter_pdf, first_page, last_page", "query")
_vectors("file", "files", "file_no, filename", "filename")
_vectors("section", "valid_sections", "filename, section_no, section_title", "section_title")
_vectors("document", "documents", "doc_id", "text")
step("augmented", "SELECT query_id, CASE WHEN filter_pdf IS NULL THEN query ELSE '在' || filter_pdf || '中，' || plain_query END AS query, filter_pdf, first_page, last_page FROM parsed_queries")
FILLER = r"[\s\-\._，。,、：:\d一二三四五六七八九十百千零壹贰叁肆伍陆柒捌玖]"
step("valid_sections", f"""
SELECT filename, CAST(row_number() OVER (PARTITION BY filename ORDER BY section_title) - 1 AS INT) AS section_no, section_title FROM section_index
WHERE regexp_matches({strip('section_title')}, '[一-鿿A-Za-z]') AND length(regexp_replace({strip('section_title')}, '{FILLER}', '', 'g')) > 0""")


def lexical(q: str, t: str) -> str:
    qs, ds = f"list_distinct({words(f'lower({q})')})", words(f"lower({t})")
    return f"round(len(list_intersect({qs}, list_distinct({ds}))) / CAST(greatest(len({qs}), 1) AS DOUBLE) / (1 + len({ds}) / 100), 6)"


def ranked(sql: str, k: int, item: str = "id") -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {item}) AS INT) AS rank FROM ({sql})) WHERE rank <= {k}"


def dotted(a: str, b: str) -> str:
    return f"round(list_inner_product({a}, {b}), 6) + 0.0"


def blended(hits: str, k: int, only_if_over: bool = False) -> str:
    """hits: (query_id, id, score, query, text)."""
    mixed = "round(0.3::DOUBLE * score + 0.7::DOUBLE * lex + 1e-9::DOUBLE, 6)"
    score = f"CASE WHEN n > {k} THEN {mixed} ELSE score END" if only_if_over else mixed
    return ranked(f"SELECT query_id, id, {score} AS score FROM (SELECT *, {lexical('query', 'text')} AS lex, count(*) OVER (PARTITION BY query_id) AS n FROM ({hits}))", k)


step("all_pairs", f"SELECT query_id, id, query, text, {dotted('s.vector', 'c.vector')} AS score FROM short_vectors s, chunk_vectors c")
step("allowed_pairs", "SELECT p.* FROM all_pairs p JOIN allowed a ON p.query_id = a.query_id AND p.id = a.id")
step("page_pairs", "SELECT p.* FROM all_pairs p JOIN parsed_queries q ON p.query_id = q.query_id JOIN chunks c ON p.id = c.id WHERE c.page_number BETWEEN q.first_page AND q.last_page AND p.query_id NOT IN (SELECT query_id FROM matches)")
step("free_pairs", "SELECT p.* FROM all_pairs p JOIN parsed_queries q ON p.query_id = q.query_id WHERE first_page IS NULL AND p.query_id NOT IN (SELECT query_id FROM matches)")


def hybrid(k: int, only_unmatched: bool = False) -> str:
    first = max(120, 3 * k)
    parts = ([] if only_unmatched else ["allowed_pairs"]) + ["page_pairs", "free_pairs"]
    return blended(" UNION ALL ".join(f"SELECT query_id, id, score, query, text FROM ({ranked(f'SELECT * FROM {p}', first)})" for p in parts), k, True)


step("near_files", f"SELECT query_id, filename, score AS file_score FROM ({ranked('SELECT query_id, file_no, filename, ' + dotted('s.vector', 'f.vector') + ' AS score FROM short_vectors s, file_vectors f WHERE s.filter_pdf IS NULL', 1, 'file_no')})")
step("targets", "SELECT query_id, filename, file_score FROM near_files UNION ALL SELECT query_id, filter_pdf, 1.0::DOUBLE FROM short_vectors WHERE filter_pdf IS NOT NULL")
step("near_sections", ranked(f"SELECT s.query_id, query, t.filename, section_no, section_title, {dotted('s.vector', 'v.vector')} AS score FROM short_vectors s JOIN targets t ON s.query_id = t.query_id JOIN section_vectors v ON t.filename = v.filename", 5, "section_no"))
step("fused_sections", f"""
SELECT *, round((1 - 0.5::DOUBLE) * scaled + 0.5::DOUBLE / (1 + exp(-lex)), 6) AS fused FROM (
  SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END AS scaled, {lexical('query', 'section_title')} AS lex
  FROM near_sections WINDOW w AS (PARTITION BY query_id))""")
step("accepted_sections", """
SELECT query_id, filename, section_title, fused AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, score DESC, section_no) AS nth FROM fused_sections) WHERE nth = 1 AND fused >= 0.65""")
step("smart_plan", """
SELECT t.query_id, t.filename, a.section_title, CASE WHEN a.section_title IS NOT NULL THEN 'precise_by_section' WHEN file_score >= 0.7 THEN 'precise_by_file' END AS smart_mode FROM targets t LEFT JOIN accepted_sections a ON t.query_id = a.query_id""")
step("smart_hits", ranked("SELECT p.query_id, p.id, p.score, smart_mode FROM all_pairs p JOIN chunks c ON p.id = c.id JOIN smart_plan m ON p.query_id = m.query_id AND c.filename = m.filename WHERE smart_mode IS NOT NULL AND (m.section_title IS NULL OR m.section_title = c.section_title)", 60))
step("hybrid_hits", hybrid(60))
step("shown_hits", "SELECT h.query_id, h.rank, h.score, c.id, c.text, c.section_title, c.page_number, c.filename FROM (" + ranked("SELECT query_id, id, score FROM all_pairs", 12) + ") h JOIN chunks c ON h.id = c.id")
step("hashed_chunks", "SELECT doc_id, chunk_index, substr(md5(text), 1, 16) AS text_hash FROM doc_chunks")
step("word_sets", f"""SELECT doc_id, list_distinct({words("lower(text)")}) AS ws FROM documents WHERE text IS NOT NULL""")
