"""SQL counterparts of the training-data queries that SQL can express, over whole tables."""

from quarryline.llm.quality import CLAUSES, DETERMINERS, LINKS, MODIFIERS, PUNCTUATION
from quarryline.llm.splits import CAMEL_PLATFORMS, INLINE, PLATFORMS

_NEAR = """usable AS (SELECT DISTINCT emb_id, [CAST(x AS DOUBLE) FOR x IN pros_emb] AS v FROM embedding WHERE emb_id IS NOT NULL AND len(pros_emb) = 64
  AND len(list_filter(pros_emb, lambda x: isfinite(x))) = 64 AND len(list_filter(pros_emb, lambda x: x <> 0)) > 0),
unit AS (SELECT emb_id, [x / sqrt(list_inner_product(v, v)) FOR x IN v] AS v FROM usable),
near AS (SELECT a.emb_id AS a, b.emb_id AS b, CASE WHEN a.v = b.v THEN 0 ELSE round(1 - list_inner_product(a.v, b.v), 9) END AS d FROM unit a, unit b WHERE list_inner_product(a.v, b.v) >= 0.88)"""

P1_FOUND = f"""WITH {_NEAR}, placed AS (SELECT a AS emb_id, min(b) AS cluster_id FROM near GROUP BY a)
SELECT emb_id, cluster_id FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM placed) WHERE n >= 3"""

P4_FOUND = f"""WITH {_NEAR}, ranked AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM near WHERE a <> b)
SELECT DISTINCT least(a, b) AS emb_id_a, greatest(a, b) AS emb_id_b FROM ranked WHERE n <= 5"""

P4_NEAREST = f"""WITH {_NEAR.split(", near AS")[0].split("near AS")[0].rstrip().rstrip(",")}, ranked AS (SELECT a.emb_id, b.emb_id AS neighbour, round(1 - list_inner_product(a.v, b.v), 6) AS distance,
  row_number() OVER (PARTITION BY a.emb_id ORDER BY round(1 - list_inner_product(a.v, b.v), 6), b.emb_id) AS position FROM unit a JOIN unit b ON a.emb_id <> b.emb_id WHERE a.emb_id % 100 = 0)
SELECT emb_id, position, neighbour, CASE WHEN distance = 0 THEN 0 ELSE distance END AS distance FROM ranked WHERE position <= 5"""

_PATH = r"""regexp_replace(regexp_replace(trim(cppFile), '[\\/]+', '/', 'g'), '^(\./)*((?i)repos/(project|library)/[^/]+/)?', '')"""
_STRIP = "{0}"
for _ in range(2):
    _STRIP = rf"regexp_replace({_STRIP}, '(?i)(.)[._-]({INLINE})$', '\1')"
    _STRIP = rf"regexp_replace({_STRIP}, '([a-z0-9])(Inl|Inline)$', '\1')"
    _STRIP = rf"regexp_replace({_STRIP}, '(?i)(.)[._-]({PLATFORMS})$', '\1')"
    _STRIP = rf"regexp_replace({_STRIP}, '([a-z0-9])({CAMEL_PLATFORMS})$', '\1')"
_UNIT = "lower(" + _STRIP.format(r"regexp_replace(regexp_extract(path, '[^/]*$'), '\.[A-Za-z0-9+]+$', '')") + ")"

P2_FOUND = rf"""WITH RECURSIVE paths AS (SELECT DISTINCT file_id, lower(trim(corpus)) AS kind, trim(project) AS project, {_PATH} AS path,
  regexp_extract(regexp_replace(cppFile, '[\\/]+', '/', 'g'), '(?i)^(?:\./)*repos/project/([^/]+)/', 1) AS folder FROM dataset WHERE file_id IS NOT NULL),
named AS (SELECT file_id, CASE WHEN kind = 'library' AND regexp_matches(path, '^[^/]+?__[^/]+/')
  THEN 'library:' || lower(regexp_extract(path, '^([^/]+?)__([^/]+)/', 1)) || '/' || lower(regexp_extract(path, '^([^/]+?)__([^/]+)/', 2))
  WHEN kind = 'project' THEN 'project:' || lower(coalesce(nullif(project, ''), nullif(folder, ''))) || ':' || {_UNIT} END AS entity FROM paths),
entities AS (SELECT file_id, min(coalesce(entity, 'file:' || file_id)) AS entity FROM named GROUP BY file_id),
links AS (SELECT 'library:' || lower(trim(old_name)) AS a, 'library:' || lower(trim(new_name)) AS b FROM repo_aliases WHERE old_name IS NOT NULL AND new_name IS NOT NULL),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least_name AS (SELECT node, min(other) AS least FROM reach GROUP BY node),
keyed AS (SELECT file_id, coalesce(least, entity) AS k FROM entities LEFT JOIN least_name ON node = entity)
SELECT file_id, group_id FROM (SELECT file_id, min(file_id) OVER (PARTITION BY k) AS group_id, count(*) OVER (PARTITION BY k) AS n FROM keyed) WHERE n >= 2"""

P7_DECODED = "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS characters FROM documents"

_GRAMS = r"""SELECT {0} AS id, unnest([array_to_string(l[i:i+14], ' ') FOR i IN range(1, len(l) - 13)]) AS gram FROM (SELECT {0}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS l FROM {1} WHERE text IS NOT NULL AND {0} IS NOT NULL) WHERE len(l) >= 15"""
_LEAKS = f"WITH items AS ({_GRAMS.format('item_id', 'eval_items')}), docs AS ({_GRAMS.format('doc_id', 'documents')}), pairs AS (SELECT DISTINCT docs.id AS doc_id, items.id AS item_id FROM docs JOIN items USING (gram))"

P8_FOUND = f"{_LEAKS} SELECT doc_id, item_id FROM pairs"

_PLACED = r"""SELECT {0} AS id, unnest(range(0, len(l) - 14)) AS at, unnest([array_to_string(l[i:i+14], ' ') FOR i IN range(1, len(l) - 13)]) AS gram FROM (SELECT {0}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS l FROM {1} WHERE text IS NOT NULL AND {0} IS NOT NULL) WHERE len(l) >= 15"""
_RUNS = f"""WITH items AS ({_PLACED.format('item_id', 'eval_items')}), docs AS ({_PLACED.format('doc_id', 'documents')}),
hits AS (SELECT docs.id AS doc_id, items.id AS item_id, docs.at AS p, items.at AS q FROM docs JOIN items USING (gram)),
islands AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM hits),
runs AS (SELECT doc_id, item_id, count(*) + 14 AS words, min(p) AS p, min(q) AS q FROM islands GROUP BY doc_id, item_id, p - q, island),
passages AS (SELECT doc_id, item_id, max(words) AS longest, min(struct_pack(n := -words, p := p, q := q)) AS place FROM runs GROUP BY doc_id, item_id),
places AS (SELECT doc_id, item_id, count(DISTINCT p) AS windows FROM hits GROUP BY doc_id, item_id)"""

P8_PASSAGES = f"{_RUNS} SELECT doc_id, item_id, windows, longest, place.p AS doc_at, place.q AS item_at FROM passages JOIN places USING (doc_id, item_id)"
P8_REPORT = f"{_RUNS} SELECT item_id, count(*) AS docs, CAST(sum(windows) AS BIGINT) AS windows, max(longest) AS longest FROM passages JOIN places USING (doc_id, item_id) GROUP BY item_id"
P8_CLEAN = f"""{_LEAKS} SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(doc_id) AS BIGINT) AS id_sum
FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM pairs) GROUP BY source"""

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EDGES = ".,;:!?\"''()[]{}*_>…"
_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({*DETERMINERS, *LINKS, *MODIFIERS, *CLAUSES}))
_MARKS = PUNCTUATION.replace("'", "''")
P9_RATIOS = rf"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^{_SPACE}]+') AS w, len(regexp_replace(text, '[{_SPACE}]', '', 'g')) AS n,
  list_filter([regexp_extract(l, '([^{_SPACE}])[{_SPACE}]*$', 1) FOR l IN string_split(text, chr(10))], lambda c: c <> '') AS ends FROM texts),
counted AS (SELECT doc_id, w, n, ends, len(regexp_replace(text, '[\p{{L}}\p{{N}}{_SPACE}]', '', 'g')) AS symbols,
  len(list_filter(w, lambda x: replace(lower(trim(x, '{_EDGES}')), '’', chr(39)) IN ({_COMMON}))) AS common,
  len(list_filter(ends, lambda c: contains('{_MARKS}', c))) AS ended FROM split)
SELECT doc_id, CAST(len(w) AS BIGINT) AS words, round(n / nullif(len(w), 0), 6) AS mean_word_length, round(symbols / nullif(n, 0), 6) AS symbol_ratio,
  round(ended / nullif(len(ends), 0), 6) AS ended_lines, round(common / nullif(len(w), 0), 6) AS common_words FROM counted"""

ORACLES = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p4_nearest": P4_NEAREST, "p7_decoded": P7_DECODED, "p8_found": P8_FOUND, "p8_passages": P8_PASSAGES, "p8_report": P8_REPORT, "p8_clean": P8_CLEAN, "p9_ratios": P9_RATIOS}
