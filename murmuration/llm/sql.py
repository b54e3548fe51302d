"""The queries' results in DuckDB's SQL, over whole tables, where SQL can express them in reasonable time.

Not here: p7_ids (a tokenizer), which is tested against the library's encoder; its texts come back in p7_decoded.
"""

from __future__ import annotations

_CLEAN = "lower(trim(label, ' ' || chr(9) || chr(160)))"
_SILENCE = "('', '<unk>', 'sp', 'sil', 'spn')"

_PAIRS = f"""
pairs AS (
  SELECT DISTINCT 'label' AS field, NULL::INT AS scope, regexp_replace({_CLEAN}, '[0-9]', '', 'g') AS term, utt_id AS record, token_id AS row_id
  FROM textgrid WHERE tier = 'words' AND label IS NOT NULL AND utt_id IS NOT NULL AND {_CLEAN} NOT IN {_SILENCE}
  UNION ALL
  SELECT DISTINCT 'cluster', run_id, run_id || ':' || cluster, utt_id, member_id
  FROM partition_file WHERE cluster >= 0 AND utt_id IS NOT NULL AND run_id IS NOT NULL),
totals AS (SELECT field, scope, count(DISTINCT record) AS total FROM pairs WHERE term <> '' GROUP BY ALL),
counts AS (SELECT field, scope, term, count(*) AS n_rows, count(DISTINCT record) AS n_records FROM pairs WHERE term <> '' GROUP BY ALL)"""

_UNIT = """
unit_rows AS (
  SELECT seg_id, any_value(features)::DOUBLE[] AS x FROM segments
  WHERE seg_id IS NOT NULL AND len(features) = 96 AND len(list_filter(features, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(features, lambda v: v <> 0)) > 0
  GROUP BY seg_id),
mean AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM unit_rows) GROUP BY i)),
centred AS (SELECT seg_id, list_transform(list_zip(x, mu), lambda p: p[1] - p[2]) AS c FROM unit_rows, mean),
unit AS (SELECT seg_id, list_transform(c, lambda v: v / sqrt(list_dot_product(c, c)))::DOUBLE[96] AS u FROM centred)"""

# Links, components, and whether all members of a component are alike.
_LINKED = """
links AS (SELECT a.seg_id AS a, b.seg_id AS b FROM unit a, unit b WHERE a.seg_id <> b.seg_id AND array_inner_product(a.u, b.u) >= 0.74),
reach(seg_id, g) USING KEY (seg_id) AS (
  SELECT a AS seg_id, least(a, min(b)) AS g FROM links GROUP BY a
  UNION
  SELECT l.b, min(reach.g) AS g FROM reach JOIN links l ON l.a = reach.seg_id JOIN recurring.reach AS old ON old.seg_id = l.b WHERE reach.g < old.g GROUP BY l.b),
degree AS (SELECT a AS seg_id, count(*) AS d FROM links GROUP BY a),
sized AS (SELECT g, count(*) AS n, min(d) AS least_d FROM reach JOIN degree USING (seg_id) GROUP BY g)"""

_RUNS = """
rows AS (SELECT DISTINCT seg_id, quantised FROM unit_segments WHERE seg_id IS NOT NULL),
items AS (SELECT seg_id, unnest(quantised) AS unit, generate_subscripts(quantised, 1) - 1 AS pos FROM rows),
based AS (SELECT seg_id, pos, CASE WHEN i.unit >= 0 THEN coalesce(base_unit, i.unit) END AS u FROM items i LEFT JOIN codebook c ON i.unit = c.unit),
marked AS (SELECT *, CASE WHEN u IS NULL OR lag(u) OVER w IS DISTINCT FROM u THEN 1 ELSE 0 END AS new FROM based WINDOW w AS (PARTITION BY seg_id ORDER BY pos)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY seg_id ORDER BY pos) AS run FROM marked),
runs AS (SELECT seg_id, min(pos)::INT AS run_start, any_value(u)::INT AS base_unit, count(*)::INT AS run_length FROM grouped WHERE u IS NOT NULL GROUP BY seg_id, run)"""

# Characters: blank, and letter or number. A text is cut into words by RE2, whose classes L and N are Unicode's.
_STATS = r"""
docs AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '[ \t\r\n]+'), lambda w: w <> '') AS words,
  list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(13))), lambda l: l <> '') AS lines,
  (SELECT list(DISTINCT word) FROM common_words) AS common FROM docs),
stats AS (SELECT doc_id, lang, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[\p{L}\p{N} \t\r\n]', '', 'g'))::BIGINT AS symbol_chars, len(lines)::BIGINT AS n_lines,
  len(list_filter(lines, lambda l: right(l, 1) IN ('.', '!', '?')))::BIGINT AS ended_lines,
  len(list_filter(words, lambda w: list_contains(common, regexp_replace(regexp_replace(lower(w), '^[^\p{L}]+', ''), '[^\p{L}]+$', ''))))::BIGINT AS common_words
  FROM split),
shares AS (SELECT *, word_chars::DOUBLE / nullif(n_words, 0) AS mean_word_length, symbol_chars::DOUBLE / nullif(word_chars, 0) AS symbol_share,
  ended_lines::DOUBLE / nullif(n_lines, 0) AS line_end_share, common_words::DOUBLE / nullif(n_words, 0) AS common_share FROM stats)"""

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH {_PAIRS},
marked AS (SELECT field, term, n_records, total FROM counts JOIN totals USING (field) WHERE counts.scope IS NOT DISTINCT FROM totals.scope)
SELECT field, term, 'rare' AS mark FROM marked WHERE n_records <= 2
UNION ALL SELECT field, term, 'common' FROM marked WHERE n_records > 0.25 * total""",
    "p1_counts": f"WITH {_PAIRS} SELECT field, term, n_rows, n_records FROM counts",
    "p2_found": f"""WITH RECURSIVE {_UNIT}, {_LINKED}
SELECT seg_id, g AS group_id FROM reach JOIN sized USING (g) WHERE least_d = n - 1""",
    "p2_profiles": f"""WITH RECURSIVE {_UNIT}, {_LINKED},
loose AS (SELECT seg_id, g, d FROM reach JOIN sized USING (g) JOIN degree USING (seg_id) WHERE least_d < n - 1),
parts(seg_id, medoid) USING KEY (seg_id) AS (
  SELECT seg_id, NULL::BIGINT AS medoid FROM loose
  UNION
  SELECT f.seg_id, h.m FROM (SELECT l.g, arg_min(l.seg_id, (-l.d, l.seg_id)) AS m FROM recurring.parts p JOIN loose l USING (seg_id) WHERE p.medoid IS NULL GROUP BY l.g) h
    JOIN loose o ON o.g = h.g JOIN recurring.parts f ON f.seg_id = o.seg_id
  WHERE f.medoid IS NULL AND (f.seg_id = h.m OR EXISTS (FROM links WHERE links.a = h.m AND links.b = f.seg_id))),
members AS (SELECT seg_id, g AS group_id, true AS tight FROM reach JOIN sized USING (g) WHERE least_d = n - 1
  UNION ALL SELECT seg_id, min(seg_id) OVER (PARTITION BY medoid), false FROM parts),
sized_groups AS (SELECT group_id, bool_and(tight) AS tight, count(*) AS n FROM members GROUP BY group_id HAVING n > 1),
mem AS (SELECT DISTINCT member_id, run_id, cluster, utt_id, start_sec, end_sec FROM partition_file WHERE run_id IS NOT NULL AND cluster >= 0),
places AS (SELECT DISTINCT seg_id, utt_id, start_frame, end_frame FROM segments JOIN unit_rows USING (seg_id) WHERE utt_id IS NOT NULL),
near AS (SELECT member_id, run_id, cluster, seg_id, round(greatest(abs(start_sec * 50 - start_frame), abs(end_sec * 50 - end_frame)), 3) AS apart
  FROM mem JOIN places USING (utt_id) WHERE end_sec > start_sec),
matched AS (SELECT DISTINCT run_id, cluster, seg_id FROM (FROM near WHERE apart <= 2 QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY apart, seg_id) = 1)),
keyed AS (SELECT group_id, NULL::INT AS run_id, NULL::INT AS cluster, seg_id FROM members SEMI JOIN sized_groups USING (group_id)
  UNION ALL SELECT NULL, run_id, cluster, seg_id FROM matched),
scored AS (SELECT k.group_id, k.run_id, k.cluster, k.seg_id, round(avg(array_inner_product(a.u, b.u)), 6) AS t FROM keyed k
  JOIN keyed o ON k.group_id IS NOT DISTINCT FROM o.group_id AND k.run_id IS NOT DISTINCT FROM o.run_id AND k.cluster IS NOT DISTINCT FROM o.cluster
  JOIN unit a ON a.seg_id = k.seg_id JOIN unit b ON b.seg_id = o.seg_id GROUP BY ALL),
picked AS (SELECT group_id, run_id, cluster, count(*) AS n, array_to_string(list(seg_id ORDER BY t DESC, seg_id)[1:3], ' ') AS typical_ids FROM scored GROUP BY ALL)
SELECT CASE WHEN tight THEN 'tight' ELSE 'loose' END AS kind, -1 AS run_id, group_id AS number, n AS n_members, n AS n_segments, typical_ids FROM picked JOIN sized_groups USING (group_id, n)
UNION ALL
SELECT 'cluster', m.run_id, m.cluster::BIGINT, count(*), coalesce(any_value(n), 0), coalesce(any_value(typical_ids), '') FROM mem m LEFT JOIN (FROM picked WHERE run_id IS NOT NULL) p USING (run_id, cluster) GROUP BY m.run_id, m.cluster""",
    "p3_found": f"""WITH {_UNIT},
sims AS (SELECT a.seg_id AS a, b.seg_id AS b, array_inner_product(a.u, b.u) AS s FROM unit a, unit b WHERE a.seg_id <> b.seg_id),
near AS (SELECT a, b, s FROM sims WHERE s >= 0.97 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS seg_id_a, greatest(a, b) AS seg_id_b FROM near""",
    "p3_knn": f"""WITH {_UNIT},
near AS (SELECT a.seg_id, b.seg_id AS neighbour_id, array_inner_product(a.u, b.u) AS s FROM unit a, unit b WHERE a.seg_id % 50 = 0 AND a.seg_id <> b.seg_id)
SELECT seg_id, neighbour_id, row_number() OVER w::INT AS place, round(s, 5) AS similarity FROM near WINDOW w AS (PARTITION BY seg_id ORDER BY s DESC, neighbour_id) QUALIFY row_number() OVER w <= 10""",
    "p4_found": f"""WITH members AS (SELECT DISTINCT member_id, utt_id, (start_sec + end_sec) / 2 AS t FROM partition_file WHERE utt_id IS NOT NULL AND end_sec > start_sec),
words AS (SELECT DISTINCT token_id, utt_id, (interval_start + interval_end) / 2 AS t FROM textgrid
  WHERE tier = 'words' AND label IS NOT NULL AND interval_end > interval_start AND {_CLEAN} NOT IN {_SILENCE})
SELECT member_id, token_id FROM members m JOIN words w ON m.utt_id = w.utt_id AND w.t BETWEEN m.t - 0.11 AND m.t + 0.11
WHERE abs(m.t - w.t) <= 0.1
QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY abs(m.t - w.t), w.t, token_id) = 1""",
    "p5_found": f"WITH {_RUNS} SELECT seg_id, run_start, base_unit, run_length FROM runs WHERE run_length >= 5",
    "p5_collapsed": f"WITH {_RUNS} SELECT seg_id, run_start, base_unit, run_length, round(run_length * 0.02::DOUBLE, 2) AS duration_sec FROM runs",
    "p5_events": """WITH rows AS (SELECT DISTINCT token_id, utt_id || '/' || tier AS entity, interval_start AS t, label FROM textgrid WHERE utt_id IS NOT NULL AND tier IS NOT NULL AND interval_start IS NOT NULL AND token_id IS NOT NULL),
marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM rows WINDOW w AS (PARTITION BY entity ORDER BY t, token_id)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY t, token_id) AS run FROM marked)
SELECT entity, min(t) AS start_time, max(t) AS end_time, coalesce(any_value(label), '(none)') AS event, count(*) AS n FROM grouped GROUP BY entity, run""",
    "p6_found": """WITH RECURSIVE one AS (SELECT DISTINCT src AS a, dst AS b FROM edge_list WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND weight BETWEEN 0.5 AND 1 AND NOT isnan(weight)),
links AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reach(seg_id, group_id) USING KEY (seg_id) AS (
  SELECT a AS seg_id, least(a, min(b)) AS group_id FROM links GROUP BY a
  UNION
  SELECT l.b, min(reach.group_id) AS group_id FROM reach JOIN links l ON l.a = reach.seg_id JOIN recurring.reach AS old ON old.seg_id = l.b WHERE reach.group_id < old.group_id GROUP BY l.b)
SELECT seg_id, group_id FROM reach""",
    "p7_decoded": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_found": r"""WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
item_grams AS (SELECT DISTINCT item_id, list_slice(w, i, i + 11) AS g, g[1] AS head FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item_words)),
heads AS (SELECT DISTINCT list_slice(g, 1, 3) AS h FROM item_grams),
doc_grams AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 11) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc_words) SEMI JOIN heads ON list_slice(w, i, i + 2) = h)
SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN item_grams USING (g)""",
    # One of three pieces of four words is unchanged in a window with two edits; passages have 10 to 14 words.
    "p8_near": r"""WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT DISTINCT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, list_slice(w, i, i + 11) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item_words)),
pieces AS (SELECT item_id, g, o, list_slice(g, o + 1, o + 4) AS piece FROM windows, (VALUES (0), (4), (8)) t(o)),
known AS (SELECT DISTINCT piece FROM pieces),
grams AS (SELECT doc_id, w, i, list_slice(w, i, i + 3) AS piece FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM doc_words) SEMI JOIN known ON list_slice(w, i, i + 3) = piece),
starts AS (SELECT DISTINCT doc_id, item_id, g, list_slice(w, i - o + d, i - o + d + 13) AS own FROM grams JOIN pieces USING (piece), range(-2, 3) t(d) WHERE i - o + d >= 1),
coded AS (SELECT doc_id, item_id, array_to_string(list_transform(g, lambda v: chr((64 + list_position(g, v))::INT)), '') AS a,
  array_to_string(list_transform(own, lambda v: chr((64 + coalesce(list_position(g, v), 0))::INT)), '') AS b FROM starts)
SELECT DISTINCT doc_id, item_id FROM coded WHERE list_min(list_transform(range(10, 15), lambda n: levenshtein(a, left(b, n)))) <= 2""",
    "p9_statistics": f"WITH {_STATS} SELECT doc_id, n_words, word_chars, symbol_chars, n_lines, ended_lines, common_words FROM stats",
    "p9_found": f"""WITH {_STATS}
SELECT doc_id, 'no_words' AS mark FROM shares WHERE n_words = 0
UNION ALL SELECT doc_id, 'long_words' FROM shares WHERE mean_word_length > 15
UNION ALL SELECT doc_id, 'symbols' FROM shares WHERE symbol_share > 0.28
UNION ALL SELECT doc_id, 'no_line_end' FROM shares WHERE line_end_share < 0.02
UNION ALL SELECT doc_id, 'no_common' FROM shares WHERE common_share < 0.01
UNION ALL SELECT doc_id, 'prose' FROM shares WHERE line_end_share >= 0.5 AND mean_word_length <= 8 AND symbol_share <= 0.12""",
    "p9_outliers": f"""WITH {_STATS},
long AS (UNPIVOT (SELECT doc_id, lang, n_words::DOUBLE AS n_words, mean_word_length, symbol_share, line_end_share, common_share FROM shares WHERE n_words > 0)
  ON n_words, mean_word_length, symbol_share, line_end_share, common_share INTO NAME stat VALUE value),
ranked AS (SELECT doc_id, count(*) OVER g AS total, count(*) OVER (PARTITION BY lang, stat ORDER BY value RANGE UNBOUNDED PRECEDING) AS at_most,
  count(*) OVER (PARTITION BY lang, stat ORDER BY value DESC RANGE UNBOUNDED PRECEDING) AS at_least FROM long WINDOW g AS (PARTITION BY lang, stat)),
scores AS (SELECT doc_id, sum(-ln(least(1.0::DOUBLE, least(at_most, at_least) * 2.0::DOUBLE / total))) AS score FROM ranked GROUP BY doc_id)
SELECT doc_id, lang, round(score, 4) AS outlier_score FROM shares LEFT JOIN scores USING (doc_id)""",
}
