"""DuckDB SQL for the engine's queries: the recurrence as a recursive query, the rest as plain SQL."""

from __future__ import annotations

PART_P = "SELECT min(p_partkey) AS pattern_id, p_name AS pattern FROM part GROUP BY p_name"
PART_T = "SELECT p_partkey AS text_id, p_name AS text FROM part"


def scan(patterns: str, texts: str, metric: str = "compat") -> str:
    """CTEs pair(pattern_id, text_id, m, n) and sc(pattern_id, text_id, j, score) for patterns of up to 60 symbols."""
    x = "e | mv" if metric == "compat" else "e"
    swap = "0" if metric == "levenshtein" else "(((xor(db, mask) & x) * 2) & xb)"
    return f"""
WITH RECURSIVE p AS ({patterns}), t AS ({texts}),
eq AS (SELECT pattern_id, c, sum(1::BIGINT << i) :: BIGINT AS e FROM (SELECT pattern_id, unnest(string_split(pattern, '')) AS c, unnest(range(length(pattern)))::INT AS i FROM p) GROUP BY ALL),
em AS (SELECT pattern_id, map(list(c), list(e)) AS em FROM eq GROUP BY pattern_id),
pair AS (SELECT pattern_id, text_id, length(pattern) AS m, length(text) AS n, text, em FROM p JOIN em USING (pattern_id), t),
st AS (
  SELECT pattern_id, text_id, m, n, text, em, (1::BIGINT << m) - 1 AS mask, 0 AS j, (1::BIGINT << m) - 1 AS pv, 0::BIGINT AS mv, 0::BIGINT AS xb, 0::BIGINT AS db, m::BIGINT AS score FROM pair
  UNION ALL
  SELECT pattern_id, text_id, m, n, text, em, mask, j + 1, (((d & pv) * 2) | xor((d | h) & mask, mask)) & mask, d & h, x, d, score + ((ph >> (m - 1)) & 1) - (((d & pv) >> (m - 1)) & 1)
  FROM (SELECT *, (ph * 2) & mask AS h FROM (SELECT *, mv | xor((d | pv) & mask, mask) AS ph FROM (
    SELECT *, (xor((x & pv) + pv, pv) | x | mv | {swap}) & mask AS d FROM (
      SELECT *, {x} AS x FROM (SELECT *, coalesce(em[text[j + 1]], 0) AS e FROM st WHERE j < n)))))),
sc AS (SELECT pattern_id, text_id, m, n, j - 1 AS j, score FROM st WHERE j > 0)"""


SUMMARY = """,
lo AS (SELECT pair.pattern_id, pair.text_id, pair.m, pair.n, least(pair.m, coalesce(min(score), pair.m)) AS low, coalesce(max_by(score, j), -1) AS last
  FROM pair LEFT JOIN sc USING (pattern_id, text_id) GROUP BY pair.pattern_id, pair.text_id, pair.m, pair.n),
res AS (SELECT lo.pattern_id, lo.text_id, lo.m AS query_len, lo.n AS ref_len, count(*) FILTER (WHERE score = 0) AS num_hits,
  list(j ORDER BY j) FILTER (WHERE score = 0) AS hits, low, list(j ORDER BY j) FILTER (WHERE score = low) AS lows, last
  FROM lo LEFT JOIN sc USING (pattern_id, text_id) GROUP BY lo.pattern_id, lo.text_id, lo.m, lo.n, low, last),
flat AS (SELECT pattern_id, text_id, query_len::INT AS query_len, ref_len::BIGINT AS ref_len, num_hits::INT AS num_hits, coalesce(array_to_string(hits, ','), 'N/A') AS hit_indexes,
  low::INT AS lowest_score, coalesce(array_to_string(lows, ','), 'N/A') AS lowest_indexes, last::INT AS last_score FROM res)"""


def summary(metric: str = "compat", patterns: str = PART_P, texts: str = PART_T) -> str:
    return scan(patterns, texts, metric) + SUMMARY + "\nSELECT * FROM flat"


SCORES = scan("SELECT r_regionkey AS pattern_id, r_name AS pattern FROM region", "SELECT n_nationkey AS text_id, n_name AS text FROM nation") + """
SELECT pattern_id, text_id, string_agg(score::VARCHAR, ',' ORDER BY j) AS scores FROM sc GROUP BY ALL"""

NAMES = summary(patterns="SELECT s_suppkey AS pattern_id, s_name AS pattern FROM supplier", texts="SELECT c_custkey AS text_id, c_name AS text FROM customer")

HITS = f"""
WITH p AS ({PART_P}), t AS ({PART_T}),
h AS (SELECT pattern_id, text_id, k + length(pattern) - 2 AS e FROM (SELECT *, unnest(range(1, length(text) - length(pattern) + 2)) AS k FROM p, t WHERE length(text) >= length(pattern)) WHERE substr(text, k, length(pattern)) = pattern)
SELECT pattern_id, text_id, count(*)::INT AS num_hits, string_agg(e::VARCHAR, ',' ORDER BY e) AS hit_indexes FROM h GROUP BY ALL"""

ANCHORED = f"""
WITH p AS ({PART_P}), t AS ({PART_T})
SELECT pattern_id, text_id, levenshtein(pattern, text)::INT AS last_score FROM p, t"""

RUNS = (
    scan(PART_P, PART_T, "compat") + SUMMARY + ",\n"
    + "two AS (" + scan(PART_P, PART_T, "levenshtein") + SUMMARY + " SELECT * FROM flat),\n"
    + "a AS (SELECT 'q' || pattern_id AS query_file, 'r' || text_id AS ref_file, * FROM flat), b AS (SELECT 'q' || pattern_id AS query_file, 'r' || text_id AS ref_file, * FROM two WHERE num_hits > 0 OR lowest_score < 8)"
)
COMPARED = RUNS + """,
c AS (SELECT a.query_file, a.ref_file, b.query_file IS NOT NULL AS found,
  b.query_file IS NOT NULL AND a.num_hits = b.num_hits AS same_num_hits,
  a.hit_indexes = coalesce(b.hit_indexes, 'N/A') AS same_hit_indexes,
  CASE WHEN a.num_hits = 0 THEN a.lowest_score END IS NOT DISTINCT FROM CASE WHEN b.num_hits = 0 THEN b.lowest_score END AS same_lowest_score,
  CASE WHEN a.num_hits = 0 THEN a.lowest_indexes ELSE 'N/A' END = CASE WHEN b.num_hits = 0 THEN b.lowest_indexes ELSE 'N/A' END AS same_lowest_indexes,
  a.last_score IS NOT DISTINCT FROM b.last_score AS same_last_score
  FROM a LEFT JOIN b USING (query_file, ref_file)),
m AS (SELECT *, found AND same_num_hits AND same_hit_indexes AND same_lowest_score AND same_lowest_indexes AND same_last_score AS matched FROM c)"""
COMPARE_SUMMARY = COMPARED + """
SELECT count(*) AS total, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE found AND NOT matched) AS mismatched, count(*) FILTER (WHERE NOT found) AS missing,
  round(coalesce(count(*) FILTER (WHERE matched) * 100.0 / nullif(count(*), 0), 0), 4)::DOUBLE AS match_percent FROM m"""
LINES = scan(PART_P, PART_T) + SUMMARY + """
SELECT 'q' || pattern_id || ',' || query_len || ',r' || text_id || ',' || ref_len || ',' || num_hits || ',"' || hit_indexes || '",' ||
  CASE WHEN num_hits = 0 THEN lowest_score::VARCHAR ELSE 'N/A' END || ',"' || CASE WHEN num_hits = 0 THEN lowest_indexes ELSE 'N/A' END || '",' || last_score AS value FROM flat"""

LONG = """
SELECT p.item_id AS pattern_id, t.item_id AS text_id, strlen(p.text)::INT AS query_len, levenshtein(p.text, t.text)::INT AS last_score
FROM benchmark p, benchmark t WHERE p.text != '' AND t.text IS NOT NULL"""

RESULT_ROWS = scan(PART_P, PART_T) + SUMMARY + """
SELECT 'q' || pattern_id AS query_file, query_len, 'r' || text_id AS ref_file, ref_len::INT AS ref_len, num_hits, hit_indexes,
  CASE WHEN num_hits = 0 THEN lowest_score END AS lowest_score, CASE WHEN num_hits = 0 THEN lowest_indexes ELSE 'N/A' END AS lowest_indexes, last_score FROM flat"""

BENCHMARK = (
    scan("SELECT n_nationkey AS pattern_id, n_name AS pattern FROM nation", "SELECT item_id AS text_id, text FROM benchmark WHERE text IS NOT NULL") + SUMMARY
    + " SELECT pattern_id, text_id, query_len, ref_len, num_hits, lowest_score, coalesce(len(lows), 0)::INT AS n_lowest, last_score FROM flat JOIN (SELECT pattern_id, text_id, lows FROM res) USING (pattern_id, text_id)"
)

TIMES = "SELECT l_orderkey, l_linenumber, max(l_quantity) AS f, max(l_extendedprice / 2000) AS s, max(l_discount * 10) AS r FROM lineitem GROUP BY ALL"


def _next(r: str, alpha: float, band: bool) -> str:
    still = f" WHEN abs(s - f) / greatest(f, s) < 0.03 THEN {r}" if band else ""
    return f"CASE WHEN {r} <= 0 THEN 0.72::DOUBLE WHEN f <= 0 OR s <= 0 THEN {r}{still} ELSE greatest(0.05::DOUBLE, least(0.95::DOUBLE, {1 - alpha}::DOUBLE * {r} + {alpha}::DOUBLE * {r} * sqrt(s / f))) END"


TRACE = f"""
WITH RECURSIVE tm AS ({TIMES}), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS step FROM tm),
tr AS (
  SELECT l_orderkey, step, 0.72::DOUBLE AS ratio, {_next("0.72::DOUBLE", 0.25, True)} AS next_ratio FROM o WHERE step = 0
  UNION ALL
  SELECT o.l_orderkey, o.step, tr.next_ratio, {_next("tr.next_ratio", 0.25, True)} FROM tr JOIN o ON o.l_orderkey = tr.l_orderkey AND o.step = tr.step + 1)"""


def oracle_sql() -> dict[str, str]:
    compat = summary("compat")
    return {
        "scan_scores": SCORES,
        "scan_scores_sql": SCORES,
        "match_summary_compat": compat,
        "match_summary_osa": summary("osa"),
        "match_summary_levenshtein": summary("levenshtein"),
        "match_summary_sql": compat,
        "match_names": NAMES,
        "chunked_match": compat,
        "ratio_split_match": compat,
        "exact_hits": HITS,
        "first_lowest_position": scan(PART_P, PART_T) + SUMMARY + " SELECT pattern_id, text_id, low::INT AS lowest_score, lows[1] AS first_lowest FROM res",
        "anchored_levenshtein": ANCHORED,
        "chunk_plan": """
WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents),
c AS (SELECT *, unnest(range(0, greatest(0, (n - 1) // 1000) + 1)) AS chunk_id FROM d)
SELECT doc_id, n, chunk_id, chunk_id * 1000 AS start, least(1000, n - chunk_id * 1000) AS own_len, least(chunk_id * 1000, 128) AS lead FROM c""",
        "chunk_size_policy": """
WITH a AS (SELECT (sum(strlen(text)) // count(text))::BIGINT AS avg_len FROM documents)
SELECT avg_len, 31::BIGINT AS target_chunks, greatest(5000, least(400000, avg_len // 31))::BIGINT AS chunk_size FROM a""",
        "ratio_split_plan": """
WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents),
c AS (SELECT *, CASE WHEN n < 1000 THEN n ELSE greatest(floor(n * 0.72::DOUBLE)::BIGINT, n - 20000) END AS cut FROM d)
SELECT doc_id, n, 'first' AS part, 0::BIGINT AS start, cut AS own_len FROM c
UNION ALL SELECT doc_id, n, 'second', cut, n - cut FROM c WHERE n > cut""",
        "compare_runs": COMPARED + " SELECT * FROM m",
        "compare_summary": COMPARE_SUMMARY,
        "result_lines": LINES,
        "ratio_update": f"SELECT l_orderkey, l_linenumber, round({_next('r', 0.25, True)}, 9) AS next_ratio, round({_next('r', 0.5, False)}, 9) AS older_ratio FROM ({TIMES})",
        "ratio_trace": TRACE + " SELECT l_orderkey, step::INT AS step, round(ratio, 9) AS ratio, round(next_ratio, 9) AS next_ratio FROM tr",
        "ratio_convergence": TRACE + """,
d AS (SELECT l_orderkey, step, coalesce((abs(round(next_ratio, 9) - lag(round(next_ratio, 9)) OVER (PARTITION BY l_orderkey ORDER BY step)) < 0.2)::INT, 0) AS small FROM tr),
k AS (SELECT *, sum(small) OVER (PARTITION BY l_orderkey ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS in_row FROM d)
SELECT l_orderkey, min(CASE WHEN in_row = 2 THEN step END)::INT AS converged_at FROM k GROUP BY l_orderkey""",
        "ratio_convergence_default": TRACE + """,
d AS (SELECT l_orderkey, step, coalesce((abs(round(next_ratio, 9) - lag(round(next_ratio, 9)) OVER (PARTITION BY l_orderkey ORDER BY step)) < 0.02)::INT, 0) AS small FROM tr),
k AS (SELECT *, sum(small) OVER (PARTITION BY l_orderkey ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS in_row FROM d)
SELECT l_orderkey, min(CASE WHEN in_row = 3 THEN step END)::INT AS converged_at FROM k GROUP BY l_orderkey""",
        "fasta_records": "SELECT p_partkey || ' ' || p_type AS header, p_name AS seq, strlen(p_name)::INT AS len FROM part WHERE p_name != ''",
        "result_rows": RESULT_ROWS,
        "anchored_long": LONG,
        "benchmark_scan": BENCHMARK,
        "power_log": """
WITH e AS (SELECT epoch_us(ts) / 1e6 AS t, value FROM events WHERE value > 0),
f AS (SELECT max(t) - min(t) AS d, avg(value) AS mean, max(value) AS peak FROM e)
SELECT 'Time_s,Power_W' AS value UNION ALL SELECT printf('%.2f,%.2f', t, value::DOUBLE) FROM e
UNION ALL SELECT unnest(['', '', '---,SUMMARY STATISTICS,---', 'Metric,Value,Unit', printf('Duration,%.4f,s', d), printf('Average Power,%.4f,W', mean), printf('Peak Power,%.4f,W', peak::DOUBLE), printf('Total Energy,%.4f,J', mean * d)]) FROM f""",
        "power_stats": """
WITH e AS (SELECT event_type, epoch_us(ts) / 1e6 AS t, value FROM events WHERE value > 0)
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_w, max(value) AS max_w, round(max(t) - min(t), 1) AS duration_s, round(avg(value) * (max(t) - min(t)), 0) AS energy_j FROM e GROUP BY event_type""",
        "device_times": "SELECT l_linenumber, sum(l_quantity) AS total, round(sum(l_quantity) / 10, 4) AS per_loop, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_linenumber",
        "bit_similarity": """
SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, bit_count(xor(l_partkey, l_suppkey))::INT AS hamming,
  round(CASE WHEN (l_partkey | l_suppkey) > 0 THEN bit_count(l_partkey & l_suppkey)::DOUBLE / bit_count(l_partkey | l_suppkey) END, 9) AS jaccard, bit_count(l_partkey)::INT AS ones FROM lineitem""",
        "bit_vectors": """
WITH b AS (SELECT p_partkey, right(lpad(bin(p_partkey), 64, '0'), 20) AS b FROM part)
SELECT p_partkey, b, CASE WHEN strpos(substr(b, 4), '1') > 0 THEN strpos(substr(b, 4), '1') + 2 ELSE -1 END::INT AS next_set, length(replace(substr(b, 1, 10), '0', ''))::INT AS rank,
  len(regexp_extract_all(b, '0+|1+'))::INT AS n_runs, substr(b, 8) || substr(b, 1, 7) AS rotated, substr(b, 14) || substr(b, 1, 13) AS rotated_right, b || '00' AS padded_right, reverse(b) AS reversed, p_partkey | 32 AS set5, p_partkey - (p_partkey & 4) AS clear2,
  (p_partkey & 2) > 0 AS bit1, p_partkey & 63 AS low6, (p_partkey + 61) & 63 AS limb_sum, (p_partkey + 61) >> 6 AS limb_carry, contains(b, '101') AS has_101 FROM b""",
        "match_masks": f"SELECT pattern_id, symbol, sum(1::BIGINT << i)::BIGINT AS mask FROM (SELECT pattern_id, unnest(string_split(pattern, '')) AS symbol, unnest(range(length(pattern)))::INT AS i FROM ({PART_P})) GROUP BY ALL",
        "fasta_lines": "SELECT p_partkey, '>' || p_type || chr(10) || rtrim(regexp_replace(p_name, '(.{5})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM part",
        "text_reports": """
SELECT p_partkey, strlen(p_name)::INT AS bytes, p_brand AS base, p_partkey::INT AS second, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 5) || '...' ELSE p_name END AS short,
  CASE WHEN p_size >= 1000 THEN printf('%.3f s', p_size / 1000.0) ELSE printf('%.3f ms', p_size::DOUBLE) END AS time FROM part""",
    }
