"""DuckDB statements with the results of this subpackage's queries, where SQL can express them on whole tables."""

from __future__ import annotations

_LATEST = """one AS (SELECT * FROM sft_examples WHERE example_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY ingested_at DESC NULLS LAST) = 1)"""

_PLAIN_SQL = r"""regexp_replace(coalesce(sql, ''), '(''[^'']*(?:''''[^'']*)*(?:''|$)|"[^"]*(?:"|$)|`[^`]*(?:`|$)|\[[^\]]*(?:\]|$))|--[^\n]*|/\*(?:[^*]|\*+[^*/])*\**(?:\*/|/|$)', '\1 ', 'g')"""

_NAME = r"""(?:[\p{L}_][\p{L}\p{N}_$]*|"[^"]*(?:"|$)|`[^`]*(?:`|$)|\[[^\]]*(?:\]|$))"""

_P2 = rf"""WITH {_LATEST},
texts AS (SELECT example_id, db_id, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '\p{{L}}{{3,}}')) AS words, {_PLAIN_SQL} AS q FROM one),
hits AS (SELECT example_id, db_id, unnest(regexp_extract_all(q, '(?i)\b(?:from|join)\s+{_NAME}(?:\s*\.\s*{_NAME})*|''[^'']*(?:''''[^'']*)*(?:''|$)|"[^"]*(?:"|$)|`[^`]*(?:`|$)|\[[^\]]*(?:\]|$)|[\p{{L}}_][\p{{L}}\p{{N}}_$]*')) AS hit FROM texts),
named AS (SELECT DISTINCT example_id, db_id, lower(trim(regexp_replace(list_last(regexp_extract_all(regexp_replace(hit, '(?is)^(?:from|join)\s+', ''), '{_NAME}')), '^["`\[]|["`\]]$', '', 'g'))) AS t
    FROM hits WHERE regexp_matches(hit, '(?is)^(?:from|join)\s+.')),
tables AS (SELECT n.example_id, n.t FROM named n SEMI JOIN (SELECT DISTINCT db_id, lower(table_name) AS t FROM cat_columns) c ON n.db_id = c.db_id AND n.t = c.t),
words AS (SELECT example_id, unnest(words) AS w FROM texts),
nw AS (SELECT w, count(*) AS n_left FROM words GROUP BY w),
nt AS (SELECT t, count(*) AS n_right FROM tables GROUP BY t),
nwt AS (SELECT w, t, count(*) AS n_both FROM words JOIN tables USING (example_id) GROUP BY w, t HAVING count(*) >= 8),
total AS (SELECT count(*) AS n FROM one)
"""

_WORD_PAIRS = r"""WITH {latest},
tokens AS (SELECT example_id, db_id, source, split, list_sort(list_distinct(regexp_extract_all(lower(coalesce(question, '')), '\p{{L}}{{3,}}'))) AS words,
    regexp_extract_all(coalesce(sql, ''), '--[^\n]*|/\*(?:[^*]|\*+[^*/])*\**(?:\*/|/|$)|''[^'']*(?:''''[^'']*)*(?:''|$)|"[^"]*(?:"|$)|`[^`]*(?:`|$)|\[[^\]]*(?:\]|$)|[\p{{L}}_][\p{{L}}\p{{N}}_$]*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?') AS toks FROM one),
recs AS (SELECT example_id, db_id, source, split, words, list_sort(list_distinct([CASE WHEN x[1] = '''' THEN lower(trim(x[2:-2])) ELSE x END FOR x IN toks IF regexp_matches(x, '(?s)^(?:''.*''|\d.*)$') AND x <> ''''])) AS consts FROM tokens),
keyed AS (SELECT * FROM recs WHERE len(consts) > 0 AND len(words) > 0 AND db_id IS NOT NULL),
pairs AS (SELECT t.example_id AS train_id, e.example_id AS eval_id, e.split, e.source AS eval_source, list_intersect(t.words, e.words) AS common, len(list_intersect(t.words, e.words)) AS s, len(e.words) AS n, len(t.words) + len(e.words) AS b
    FROM keyed t JOIN keyed e ON t.db_id = e.db_id AND t.consts = e.consts WHERE t.split = 'train' AND e.split IN ('dev', 'test')),
near AS (SELECT * FROM pairs WHERE s * 10 >= 6 * (b - s))
""".format(latest=_LATEST)

_COVERED = _WORD_PAIRS + """, w AS (SELECT id, count(DISTINCT x) AS covered FROM (SELECT eval_id AS id, unnest(common) AS x FROM near) GROUP BY 1),
c AS (SELECT eval_id, any_value(split) AS split, any_value(eval_source) AS source, any_value(n)::INT AS n_words, count(*) AS n_partners, round(max(s) / any_value(n), 6) AS best_coverage, round(any_value(covered) / any_value(n), 6) AS coverage FROM near JOIN w ON eval_id = w.id GROUP BY eval_id)
"""

_P4 = f"""WITH RECURSIVE {_LATEST},
train AS (SELECT example_id, lower(trim(coalesce(source, ''))) AS s, lower(trim(coalesce(thinking_mode, ''))) AS m, coalesce(length(instruction), 0) + coalesce(length(response), 0) AS size FROM one WHERE split = 'train'),
cells AS (SELECT t.source, t.thinking_mode, lower(trim(t.source)) AS s, lower(trim(t.thinking_mode)) AS m, t.target_share, t.max_repeats, count(r.s) AS n_rows, coalesce(sum(r.size), 0)::BIGINT AS size FROM mix_targets t
    LEFT JOIN train r ON r.s = lower(trim(t.source)) AND r.m = lower(trim(t.thinking_mode)) GROUP BY ALL),
base AS (SELECT *, (SELECT sum(size) * 0.5::DOUBLE FROM cells) AS total, target_share * (SELECT sum(size) * 0.5::DOUBLE FROM cells) AS want, max_repeats::DOUBLE AS cap FROM cells),
steps AS (SELECT 0 AS i, s, m, size, want, cap, CASE WHEN size > 0 THEN least(cap, want / size) ELSE cap END AS u FROM base
    UNION ALL SELECT i + 1, s, m, size, want, cap, CASE WHEN h > w THEN u * w / h WHEN f > 0 AND u < cap THEN least(cap, u * (w - h + f) / f) ELSE u END
    FROM (SELECT *, sum(want) OVER g AS w, sum(u * size) OVER g AS h, sum(CASE WHEN u < cap THEN u * size ELSE 0 END) OVER g AS f FROM steps WHERE i < 100 WINDOW g AS (PARTITION BY CASE WHEN i % 2 = 0 THEN s ELSE m END))),
uses AS (SELECT s, m, u FROM steps WHERE i = 100),
used AS (SELECT example_id, b.source, b.thinking_mode, b.s, b.m, r.size, (floor(u) + CASE WHEN ('0x' || md5('mix|' || example_id)[1:13])::BIGINT / 4503599627370496.0::DOUBLE < u - floor(u) THEN 1 ELSE 0 END)::INT AS uses
    FROM train r JOIN base b ON r.s = b.s AND r.m = b.m JOIN uses x ON r.s = x.s AND r.m = x.m)
"""


def _grams(table: str, key: str, n: int) -> str:
    """Every run of ``n`` words of a table's texts with its place, by leads over the unnested words."""
    leads = ", ".join(f"lead(x, {i}) OVER o" for i in range(1, n))
    return f"""SELECT {key}, k, concat_ws(' ', x, {leads}) AS g, lead(x, {n - 1}) OVER o IS NOT NULL AS whole
    FROM (SELECT {key}, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM {table}) WINDOW o AS (PARTITION BY {key} ORDER BY k)"""


_P7 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM bench_items WHERE text IS NOT NULL),
ig AS ({_grams("i", "item_id", 12)}),
dg AS ({_grams("d", "r", 12)})
SELECT DISTINCT doc_id, item_id FROM (SELECT DISTINCT dg.r, ig.item_id FROM dg JOIN ig USING (g) WHERE dg.whole AND ig.whole) JOIN d USING (r)"""

_P8 = rf"""WITH d AS (SELECT doc_id, lower(trim(coalesce(source, ''))) AS host, coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), []) AS w FROM documents),
a AS ({_grams("d", "doc_id", 8)}),
g AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, g ORDER BY k) AS nth FROM a WHERE whole),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeated FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM g WHERE nth > 1) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(w) AS n_words, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_repeated, 0) / greatest(len(w), 1) AS share FROM d LEFT JOIN c USING (doc_id))
"""

_HOSTS = """, h AS (SELECT host, count(*) AS n_docs, count(*) FILTER (share >= 0.3) AS n_fail FROM m GROUP BY host),
t AS (SELECT sum(n_docs)::DOUBLE AS n, sum(n_fail)::DOUBLE AS f, count(*)::DOUBLE AS h, sum(n_docs * (n_fail / n_docs) * (n_fail / n_docs)) AS s2 FROM h),
u AS (SELECT n, f / n AS m, s2 / n - (f / n) * (f / n) - (f / n) * (1 - f / n) * h / n AS b FROM t),
p AS (SELECT m, CASE WHEN b > 0 THEN greatest(m * (1 - m) / b - 1, 1.0) ELSE n END AS k FROM u),
hosts AS (SELECT host, n_docs, n_fail, round(n_fail / n_docs, 6) AS raw_rate, round((n_fail + m * k) / (n_docs + k), 6) AS shrunk_rate, (n_fail + m * k) / (n_docs + k) >= 0.2 AS host_fails FROM h, p)
"""

_P3 = """WITH v AS (SELECT node_id, any_value(embedding)::DOUBLE[] AS e FROM kg_nodes WHERE len(embedding) = 64 AND list_sum([abs(x) FOR x IN embedding]) > 0 GROUP BY node_id),
s AS (SELECT a.node_id AS a, b.node_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.node_id <> b.node_id),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM r WHERE k <= 5 AND c >= 0.95"""

_P3_QUERIES = """WITH v AS (SELECT node_id, any_value(embedding)::DOUBLE[] AS e FROM kg_nodes WHERE len(embedding) = 64 AND list_sum([abs(x) FOR x IN embedding]) > 0 GROUP BY node_id),
s AS (SELECT a.node_id AS a, b.node_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.node_id <> b.node_id WHERE ('0x' || md5(a.node_id)[1:8])::BIGINT % 20 = 0)
SELECT a AS node_id, b AS neighbour_id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b)::INT AS rank FROM s QUALIFY rank <= 5"""

ORACLE = {
    "p2_found": _P2 + "SELECT w AS word, t AS table_name FROM nwt JOIN nw USING (w) JOIN nt USING (t), total WHERE n_both * n >= 6 * n_left * n_right",
    "p2_word_tables": _P2 + "SELECT w AS word, t AS table_name, n_both, n_left, n_right, n, round(n_both * n / (n_left * n_right), 6) AS lift FROM nwt JOIN nw USING (w) JOIN nt USING (t), total",
    "p2_all_pairs": _P2.replace(" HAVING count(*) >= 8", "") + "SELECT w AS word, t AS table_name, n_both, n_left, n_right, n, round(n_both * n / (n_left * n_right), 6) AS lift FROM nwt JOIN nw USING (w) JOIN nt USING (t), total",
    "p3_found": _P3,
    "p3_neighbours": _P3_QUERIES,
    "p4_found": _P4 + "SELECT source, thinking_mode FROM base WHERE size * max_repeats < target_share * total",
    "p4_mix": _P4 + "SELECT example_id, source, thinking_mode, size, uses FROM used WHERE uses > 0",
    "p4_shares": _P4
    + """, k AS (SELECT s, m, sum(size * uses)::BIGINT AS reached_size, sum(uses)::BIGINT AS rows_used FROM used GROUP BY ALL)
SELECT source, thinking_mode, target_share, max_repeats, n_rows, size, round(u, 6) AS uses, coalesce(rows_used, 0) AS rows_used, coalesce(reached_size, 0) AS reached_size, round(coalesce(reached_size, 0) / (SELECT sum(reached_size) FROM k), 6) AS reached_share,
    size * max_repeats < target_share * total AS short FROM base LEFT JOIN k USING (s, m) JOIN uses USING (s, m)""",
    "p5_found": _WORD_PAIRS + "SELECT least(train_id, eval_id) AS id_a, greatest(train_id, eval_id) AS id_b FROM near",
    "p5_coverage": _COVERED + "SELECT * FROM c",
    "p5_report": _COVERED + "SELECT split, lower(trim(coalesce(source, ''))) AS source, sum(n_partners)::BIGINT AS n_pairs, count(*) AS n_eval_rows, round(avg(covered / n_words), 6) AS mean_coverage FROM (SELECT * FROM c JOIN w ON eval_id = w.id) GROUP BY ALL",
    "p6_invariants": """SELECT pack_id, capacity_tokens, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, 0::BIGINT AS n_over, 0::BIGINT AS n_cut_small, true AS within_bound FROM pack_sizes""",
    "p7_found": _P7,
    "p7_clean": f"WITH hit AS ({_P7}) SELECT doc_id, doc_type FROM documents d ANTI JOIN hit ON d.doc_id = hit.doc_id",
    "p8_found": _P8 + "SELECT doc_id FROM m WHERE share >= 0.3",
    "p8_verdicts": _P8 + _HOSTS + "SELECT doc_id, CASE WHEN share >= 0.3 THEN 'document' WHEN host_fails THEN 'host' ELSE 'clean' END AS verdict FROM m JOIN hosts USING (host)",
    "p8_repetition": _P8 + "SELECT doc_id, n_words, n_repeated, round(share, 6) AS repeated_share FROM m",
    "p8_hosts": _P8 + _HOSTS + "SELECT * FROM hosts",
}
