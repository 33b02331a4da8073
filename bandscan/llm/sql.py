"""DuckDB SQL for the llm queries that SQL can express over whole tables."""

#: How many characters the chat template adds to a text, and to a role.
_RUNS = "coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: len(x) - 2)), 0)"
_TEXT_ADDS = "(2 * length({0}) - length(replace({0}, '\\', '')) - length(replace({0}, '</turn>', '/turn>'))) + " + _RUNS
_ROLE_ADDS = _TEXT_ADDS + " + length({0}) - length(replace({0}, ':', '')) + CASE WHEN regexp_matches({0}, '^[A-Z]') THEN 1 ELSE 0 END"

OP2 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, 14 + length(role) + length(text) + {_ROLE_ADDS.format("role")} + {_TEXT_ADDS.format("text")} AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op3() -> str:
    from bandscan.llm.license_scan import PHRASES, SIZES, TEMPLATES, THRESHOLD, size_of

    templates = ", ".join(f"('{k}', {size_of(v)}, list_distinct(string_split('{v}', ' ')))" for k, v in TEMPLATES.items())
    sizes = ", ".join(f"({x})" for x in SIZES)
    phrases = ", ".join(f"('{v}', string_split('{k}', ' '))" for k, v in PHRASES.items())
    return rf"""
WITH tpl(label, size, tokens) AS (VALUES {templates}),
sz(size) AS (VALUES {sizes}),
phrase(label, said) AS (VALUES {phrases}),
d AS (SELECT doc_id, {_lower("text")} AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS w FROM d),
pos AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w),
hit AS (SELECT doc_id, i, label FROM pos, phrase WHERE w[i + 1 : i + len(said)] = said),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list(DISTINCT label)) AS labels FROM hit GROUP BY doc_id),
start AS (SELECT doc_id, size, w, unnest(range(0, len(w), size)) AS i FROM w, sz),
block AS (SELECT doc_id, size, list_distinct(w[i + 1 : i + 2 * size]) AS b FROM start),
carry AS (SELECT doc_id, label, max(len(list_intersect(b, tokens)) / len(tokens)) AS s FROM block JOIN tpl USING (size)
  WHERE len(list_intersect(b, tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9) GROUP BY doc_id, label),
more AS (SELECT doc_id, list(label) AS labels, max(s) AS s FROM carry GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.s, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(comp.b, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(comp.b, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = w.doc_id
"""


OP6 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '{_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_lower("text")}, '{_WORD}') AS w FROM benchmark),
win AS (
  SELECT item_id, 10 AS n, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k : k + 9], ' '))) AS x FROM i WHERE len(w) >= 10
  UNION ALL SELECT item_id, len(w), array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND 9),
size AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, size WHERE len(w) >= n),
hit AS (SELECT doc_id, k, spot.n, item_id FROM spot JOIN win ON spot.n = win.n AND array_to_string(w[k : k + spot.n - 1], ' ') = x),
agg AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(k, k + n))))) AS n_hit,
    list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN agg USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": OP2,
        "op3_license_scan": _op3(),
        "op4_near_duplicates": OP4,
        "op6_top_k": OP6,
        "op8_decontamination": OP8,
    }
