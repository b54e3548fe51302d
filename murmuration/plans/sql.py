"""The core queries' results in DuckDB's SQL, over whole tables."""

from __future__ import annotations

# As in sources.files and operators.zipf.
_STOP = "('', '<unk>', 'sp', 'sil', 'spn')"


def _shown(x: str) -> str:
    return f"round({x}[1], 4) + 0.0::DOUBLE AS x_first, round({x}[-1], 4) + 0.0::DOUBLE AS x_last, round(list_sum({x}), 4) + 0.0::DOUBLE AS x_sum, round(list_sum(list_transform({x}, lambda v, i: v * i / 100)), 4) + 0.0::DOUBLE AS x_ordered, round(list_dot_product({x}, {x}), 4) AS x_square"


def _frame(sec: str) -> str:
    return f"CAST(floor(round_even({sec} / 20.0::DOUBLE * 1000.0::DOUBLE, 1) + 0.5::DOUBLE) AS INT)"


_ENDS = f"""ends AS (SELECT utt_id, pos, any_value({_frame('end_sec')}) AS e FROM boundaries
  WHERE utt_id IS NOT NULL AND pos IS NOT NULL AND isfinite(end_sec) GROUP BY utt_id, pos)"""
_UTTERANCES = "utts AS (SELECT utt_id, max(end_frame) AS n_frames FROM unit_segments WHERE utt_id IS NOT NULL GROUP BY utt_id)"
_POOLED = f"""{_ENDS},
starts AS (SELECT utt_id, greatest(0, coalesce(max(e) OVER (PARTITION BY utt_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s, e FROM ends),
intervals AS (SELECT utt_id, s AS start_frame, e AS end_frame FROM starts JOIN utts USING (utt_id) WHERE e > s AND s < n_frames AND n_frames > 0
  UNION SELECT utt_id, 0, n_frames FROM utts WHERE n_frames > 0 AND utt_id NOT IN (SELECT utt_id FROM boundaries WHERE utt_id IS NOT NULL))"""
_CUT = f"""{_ENDS},
cut AS (SELECT DISTINCT utt_id, coalesce(lag(e) OVER (PARTITION BY utt_id ORDER BY pos), 0) AS start_frame, e AS end_frame FROM ends)"""
_VALID = """valid AS (SELECT seg_id, any_value(utt_id) AS utt_id, any_value(start_frame) AS start_frame, any_value(features)::DOUBLE[] AS x FROM segments
  WHERE seg_id IS NOT NULL AND len(features) = 96 AND len(list_filter(features, lambda v: v IS NULL OR NOT isfinite(v))) = 0 GROUP BY seg_id)"""
_UNIT = f"""{_VALID},
nonzero AS (SELECT seg_id, x FROM valid WHERE len(list_filter(x, lambda v: v <> 0)) > 0),
mean AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM nonzero) GROUP BY i)),
centred AS (SELECT seg_id, list_transform(list_zip(x, mu), lambda p: p[1] - p[2]) AS c FROM nonzero, mean),
unit AS (SELECT seg_id, list_transform(c, lambda v: v / (sqrt(list_dot_product(c, c)) + 1e-10::DOUBLE)) AS u FROM centred)"""
_EDGES = """edges AS (SELECT a.seg_id AS src, b.seg_id AS dst, list_dot_product(a.u, b.u) AS weight FROM unit a JOIN unit b ON a.seg_id < b.seg_id
  WHERE list_dot_product(a.u, b.u) >= 0.74)"""
_LABELLED = "lab AS (SELECT vec_id AS seg_id, embedding::DOUBLE[] AS x, label::BIGINT AS k FROM embeddings)"
_LONG = f"{_LABELLED}, long AS (SELECT seg_id, k, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM lab)"
_DIMS = f"{_LONG}, dims AS (SELECT k, dim, count(*)::DOUBLE AS n, sum(v) AS s, sum(v * v) AS q FROM long GROUP BY k, dim)"
_MEMBERS = "mem AS (SELECT DISTINCT member_id, run_id, cluster, utt_id, start_sec, end_sec FROM partition_file)"
_ASSIGN = f"{_MEMBERS}, asg AS (SELECT member_id AS seg_id, run_id::BIGINT * 1000000 + cluster AS cluster FROM mem WHERE cluster >= 0 AND run_id IS NOT NULL)"
_CLASSES = f"{_ASSIGN}, cls AS (SELECT cluster, row_number() OVER (ORDER BY min(seg_id))::INT - 1 AS class, count(*) AS n_members FROM asg GROUP BY cluster)"
_RANKED = f"""{_MEMBERS}, sizes AS (SELECT run_id, cluster, count(*) AS cnt FROM mem WHERE cluster >= 0 GROUP BY ALL),
ranked AS (SELECT run_id, cluster, cnt, row_number() OVER (PARTITION BY run_id ORDER BY cnt DESC, cluster)::INT AS rank, cnt::DOUBLE / sum(cnt) OVER (PARTITION BY run_id) AS prob FROM sizes)"""
_STRIPPED = r"lower(regexp_replace(label, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'))"
_TOKENS = rf"""tok AS (SELECT DISTINCT token_id, regexp_replace({_STRIPPED}, '\d+', '', 'g') AS token FROM textgrid
  WHERE tier = 'words' AND label IS NOT NULL AND {_STRIPPED} NOT IN {_STOP})"""
_GRAPH = """links AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM edge_list
  WHERE src <> dst AND weight > 0 AND weight <= 1 AND NOT isnan(weight) GROUP BY ALL),
verts AS (SELECT src AS seg_id FROM links UNION SELECT dst FROM links)"""
_SEQUENCES = """seqs AS (SELECT DISTINCT seg_id, list_filter(quantised, lambda u: u >= 0) AS u FROM unit_segments WHERE seg_id IS NOT NULL AND quantised IS NOT NULL),
texts AS (SELECT seg_id, u, len(u) AS n FROM seqs WHERE len(u) > 0)"""
_STARTED = "cents AS (SELECT seg_id AS k, x FROM lab WHERE seg_id < 20)"


def _nearest(points: str, cents: str) -> str:
    return f"""SELECT p.seg_id, p.x, c.k, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM {points} p, {cents} c QUALIFY row_number() OVER (PARTITION BY p.seg_id ORDER BY d, c.k) = 1"""


def _means(near: str) -> str:
    return f"SELECT k, max(n) AS n, list(m ORDER BY dim) AS x FROM (SELECT k, dim, avg(v) AS m, count(*) AS n FROM (SELECT k, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {near}) GROUP BY k, dim) GROUP BY k"


def _edit(bound: str) -> str:
    # levenshtein compares bytes, and there are more units than those: for each pair a unit is written as its place in
    # the first sequence, and units that it lacks as a blank. A pair without a common unit has the similarity 0.
    return f"""WITH {_SEQUENCES},
pairs AS (SELECT a.seg_id AS src, b.seg_id AS dst, a.u AS ua, b.u AS ub, greatest(a.n, b.n)::DOUBLE AS n
  FROM texts a JOIN texts b ON a.seg_id < b.seg_id AND abs(a.n - b.n) / greatest(a.n, b.n)::DOUBLE <= {bound} AND len(list_intersect(a.u, b.u)) > 0),
coded AS (SELECT src, dst, n, array_to_string(list_transform(ua, lambda v: chr((32 + list_position(ua, v))::INT)), '') AS ta,
  array_to_string(list_transform(ub, lambda v: chr((32 + coalesce(list_position(ua, v), 0))::INT)), '') AS tb FROM pairs),
scored AS (SELECT src, dst, 1.0::DOUBLE - levenshtein(ta, tb) / n AS weight FROM coded)
SELECT src, dst, round(weight, 5) AS weight FROM scored WHERE weight >= 0.4"""


def _rounds(n: int, size: int) -> str:
    """CTEs of ``n`` rounds of k-means from the first ``size`` vectors; the last centroids are ``c{n}``."""
    steps = [f"c0 AS (SELECT seg_id AS k, x FROM lab WHERE seg_id < {size})"]
    for i in range(1, n + 1):
        steps.append(f"n{i} AS MATERIALIZED ({_nearest('lab', f'c{i - 1}')}), c{i} AS MATERIALIZED ({_means(f'n{i}')})")
    return ", ".join(steps)


def _joint(model: str) -> str:
    return f"""SELECT p.seg_id, p.x, c.k, ln(c.w) - 0.5::DOUBLE * (64 * ln(2 * pi() * c.v) + list_sum(list_transform(list_zip(p.x, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / c.v) AS j
  FROM lab p, {model} c"""


def _em(n: int, size: int) -> str:
    """CTEs of ``n`` rounds of expectation maximisation; the last model is ``g{n}``."""
    steps = [f"g0 AS (SELECT seg_id AS k, 1.0::DOUBLE / {size} AS w, 0.05::DOUBLE AS v, x AS m FROM lab WHERE seg_id < {size})"]
    for i in range(1, n + 1):
        steps.append(f"""j{i} AS MATERIALIZED ({_joint(f'g{i - 1}')}),
t{i} AS (SELECT *, exp(j - max(j) OVER (PARTITION BY seg_id)) AS e FROM j{i}),
r{i} AS MATERIALIZED (SELECT seg_id, x, k, e / sum(e) OVER (PARTITION BY seg_id) AS r FROM t{i}),
s{i} AS (SELECT k, sum(r) + 10 * 2.220446049250313e-16::DOUBLE AS n, sum(r * list_dot_product(x, x)) AS q FROM r{i} GROUP BY k),
d{i} AS (SELECT k, dim, sum(r * v) AS s FROM (SELECT k, r, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM r{i}) GROUP BY k, dim),
m{i} AS (SELECT k, list(s / n ORDER BY dim) AS m FROM d{i} JOIN s{i} USING (k) GROUP BY k),
g{i} AS MATERIALIZED (SELECT k, n / sum(n) OVER () AS w, greatest((q / n - list_dot_product(m, m)) / 64.0::DOUBLE + 1e-6::DOUBLE, 1e-6::DOUBLE) AS v, m FROM m{i} JOIN s{i} USING (k))""")
    return ", ".join(steps)


# Elimination of each component's scale matrix S_N, below a pivot a step; column 64 and on are what is solved for.
# Rows with i = l = step are the pivots, and those with i = step and l >= 64 what is left of a right side there.
_SCALES = f"""{_LABELLED},
cells AS (SELECT k, i, l, sum(x[i + 1] * x[l + 1]) AS o FROM lab, range(64) a(i), range(64) b(l) GROUP BY ALL),
firsts AS (SELECT k, i, sum(x[i + 1]) AS s, count(*)::DOUBLE AS n FROM lab, range(64) a(i) GROUP BY ALL),
scales AS (SELECT c.k, c.i, c.l, c.o + CASE WHEN c.i = c.l THEN 0.1::DOUBLE ELSE 0 END - a.s * b.s / (a.n + 0.05::DOUBLE) AS v
  FROM cells c JOIN firsts a ON a.k = c.k AND a.i = c.i JOIN firsts b ON b.k = c.k AND b.i = c.l)"""


def _eliminated(source: str) -> str:
    return f"""steps AS (SELECT 0 AS step, k, i, l, v FROM {source}
  UNION ALL
  SELECT e.step + 1, e.k, e.i, e.l, e.v - c.v * r.v / p.v FROM steps e
    JOIN steps c ON c.k = e.k AND c.i = e.i AND c.l = e.step JOIN steps r ON r.k = e.k AND r.i = e.step AND r.l = e.l
    JOIN steps p ON p.k = e.k AND p.i = e.step AND p.l = e.step WHERE e.i > e.step AND e.l > e.step)"""


_RUN_NAME = "regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]*$', '')"
_RUN_METHOD = f"""CASE WHEN lower({_RUN_NAME}) LIKE '%kmeans%' THEN 'K-means' WHEN lower({_RUN_NAME}) LIKE '%birch%' THEN 'BIRCH'
  WHEN lower({_RUN_NAME}) LIKE '%agglomerative%' THEN 'Agglomerative' WHEN lower({_RUN_NAME}) LIKE '%cosine%' OR lower({_RUN_NAME}) LIKE '%graph%' THEN 'Graph'
  WHEN lower({_RUN_NAME}) LIKE '%fbgmm%' THEN 'FBGMM' END"""

_D = 64.0

ORACLES: dict[str, str] = {
    "time_conversion": f"SELECT utt_id, pos, {_frame('end_sec')} AS frame, round({_frame('end_sec')} * 20.0::DOUBLE / 1000.0::DOUBLE, 2) AS sec FROM (SELECT DISTINCT utt_id, pos, end_sec FROM boundaries WHERE end_sec IS NOT NULL)",
    "pooling_intervals": f"WITH {_UTTERANCES}, {_POOLED} SELECT DISTINCT * FROM intervals",
    "quantising_intervals": f"WITH {_CUT} SELECT * FROM cut WHERE start_frame <> end_frame",
    "mean_pool": f"""WITH {_VALID},
frames AS (SELECT utt_id, start_frame AS frame, arg_min(x, seg_id) AS x FROM valid WHERE utt_id IS NOT NULL AND start_frame IS NOT NULL GROUP BY ALL),
utts AS (SELECT utt_id, max(frame) + 1 AS n_frames FROM frames GROUP BY utt_id), {_POOLED},
items AS (SELECT utt_id, start_frame, end_frame, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM intervals JOIN frames USING (utt_id) WHERE frame >= start_frame AND frame < end_frame),
pooled AS (SELECT utt_id, start_frame, end_frame, list(m ORDER BY dim) AS x FROM (SELECT utt_id, start_frame, end_frame, dim, avg(v)::FLOAT::DOUBLE AS m FROM items GROUP BY ALL) GROUP BY ALL)
SELECT utt_id, start_frame, end_frame, {_shown('x')} FROM pooled""",
    "pool_command": f"""WITH {_VALID},
frames AS (SELECT DISTINCT utt_id, start_frame AS frame FROM valid WHERE utt_id IS NOT NULL AND start_frame IS NOT NULL),
utts AS (SELECT utt_id, max(frame) + 1 AS n_frames FROM frames GROUP BY utt_id), {_POOLED},
pooled AS (SELECT DISTINCT utt_id, start_frame, end_frame FROM intervals JOIN frames USING (utt_id) WHERE frame >= start_frame AND frame < end_frame)
SELECT row_number() OVER (ORDER BY utt_id, start_frame, end_frame) - 1 AS seg_id, utt_id, start_frame, end_frame, true AS whole FROM pooled""",
    "quantise_command": f"""WITH {_VALID}, {_CUT},
frames AS (SELECT DISTINCT utt_id, start_frame AS frame FROM valid WHERE utt_id IS NOT NULL AND start_frame IS NOT NULL),
known AS (SELECT * FROM cut WHERE start_frame <> end_frame AND utt_id IN (SELECT utt_id FROM frames)),
counted AS (SELECT c.utt_id, c.start_frame, c.end_frame, count(f.frame)::INT AS n_units FROM known c LEFT JOIN frames f
  ON c.utt_id = f.utt_id AND f.frame >= greatest(c.start_frame, 0) AND f.frame < c.end_frame GROUP BY ALL)
SELECT row_number() OVER (ORDER BY utt_id, start_frame, end_frame) - 1 AS seg_id, utt_id, start_frame, end_frame, n_units, true AS known FROM counted""",
    "unit_sequences": f"""WITH {_CUT},
units AS (SELECT utt_id, start_frame + pos AS frame, min(unit) AS unit FROM (SELECT utt_id, start_frame, unnest(quantised) AS unit, generate_subscripts(quantised, 1) - 1 AS pos FROM unit_segments WHERE utt_id IS NOT NULL) WHERE unit >= 0 GROUP BY ALL),
known AS (SELECT * FROM cut WHERE start_frame <> end_frame AND utt_id IN (SELECT utt_id FROM units)),
inside AS (SELECT c.utt_id, c.start_frame, c.end_frame, frame, unit, lag(unit) OVER (PARTITION BY c.utt_id, c.start_frame, c.end_frame ORDER BY frame) AS before
  FROM known c JOIN units u ON c.utt_id = u.utt_id AND frame >= greatest(c.start_frame, 0) AND frame < c.end_frame),
seqs AS (SELECT utt_id, start_frame, end_frame, string_agg(unit::VARCHAR, ' ' ORDER BY frame) AS units FROM inside WHERE before IS DISTINCT FROM unit GROUP BY ALL)
SELECT utt_id, start_frame, end_frame, coalesce(units, '') AS units FROM known LEFT JOIN seqs USING (utt_id, start_frame, end_frame)""",
    "collapsed_units": """WITH rows AS (SELECT DISTINCT seg_id, quantised FROM unit_segments WHERE quantised IS NOT NULL),
items AS (SELECT seg_id, unnest(quantised) AS u, generate_subscripts(quantised, 1) AS i FROM rows),
kept AS (SELECT *, i = 1 OR u IS DISTINCT FROM lag(u) OVER (PARTITION BY seg_id ORDER BY i) AS keep FROM items),
done AS (SELECT seg_id, count(*)::INT AS n, string_agg(coalesce(u::VARCHAR, '?'), ' ' ORDER BY i) AS units FROM kept WHERE keep GROUP BY seg_id)
SELECT seg_id, len(quantised)::INT AS n_units, coalesce(n, 0) AS n_collapsed, coalesce(units, '') AS units FROM rows LEFT JOIN done USING (seg_id)""",
    "sliced_units": "SELECT DISTINCT seg_id, array_to_string(list_transform(list_slice(quantised, 3, 6), lambda u: coalesce(u::VARCHAR, '?')), ' ') AS units FROM unit_segments WHERE quantised IS NOT NULL",
    "new_segments": "SELECT DISTINCT utt_id, start_frame, end_frame FROM segments s WHERE utt_id IS NOT NULL AND NOT EXISTS (FROM unit_segments u WHERE u.utt_id = s.utt_id AND u.start_frame = s.start_frame AND u.end_frame = s.end_frame AND len(u.quantised) > 0)",
    "numbered_segments": "SELECT utt_id, start_frame, end_frame, row_number() OVER (ORDER BY utt_id, start_frame, end_frame) - 1 AS vertex FROM (SELECT DISTINCT utt_id, start_frame, end_frame FROM segments WHERE utt_id IS NOT NULL)",
    "normalised_vectors": f"WITH {_UNIT} SELECT seg_id, {_shown('u')} FROM unit",
    "rejected_vectors": """WITH marked AS (SELECT CASE WHEN seg_id IS NULL THEN 'null_id' WHEN features IS NULL THEN 'null_vector' WHEN len(features) <> 96 THEN 'length'
  WHEN len(list_filter(features, lambda v: v IS NULL OR NOT isfinite(v))) > 0 THEN 'not_finite' END AS reason, seg_id FROM segments),
again AS (SELECT seg_id, count(*) - 1 AS n FROM marked WHERE reason IS NULL GROUP BY seg_id HAVING n > 0)
SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'repeated', sum(n)::BIGINT FROM again HAVING count(*) > 0""",
    "frame_moments": f"WITH {_LONG} SELECT count(*) AS n, dim::INT AS dim, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var FROM long GROUP BY dim",
    "streamed_moments": f"WITH {_LONG} SELECT count(*) AS n, dim::INT AS dim, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var FROM long GROUP BY dim",
    "standardised_frames": f"""WITH {_LONG}, st AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY dim),
z AS (SELECT seg_id, list(CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END ORDER BY dim) AS z FROM long JOIN st USING (dim) GROUP BY seg_id) SELECT seg_id, {_shown('z')} FROM z""",
    "bounded_prefix": f"WITH {_UTTERANCES}, run AS (SELECT *, coalesce(sum(n_frames) OVER (ORDER BY utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM utts) SELECT utt_id, n_frames FROM run WHERE before < 0.02 * 3600 * 50",
    "batch_numbers": """SELECT seg_id // 1000 AS batch, min(batch * 1000)::BIGINT AS start, least(min(batch * 1000) + 1000, (SELECT max(seg_id) + 1 FROM segments))::BIGINT AS stop, count(DISTINCT seg_id) AS n
FROM (SELECT seg_id, seg_id // 1000 AS batch FROM segments WHERE seg_id IS NOT NULL) GROUP BY seg_id // 1000""",
    "cosine_edges": f"WITH {_UNIT}, {_EDGES} SELECT src, dst, round(weight, 5) AS weight FROM edges",
    "similarity_degrees": f"""WITH {_UNIT}, {_EDGES}, ends AS (SELECT src AS seg_id, weight FROM edges UNION ALL SELECT dst, weight FROM edges)
SELECT seg_id, count(weight) AS degree, round(coalesce(sum(weight), 0.0::DOUBLE), 3) AS strength FROM unit LEFT JOIN ends USING (seg_id) GROUP BY seg_id""",
    "vertex_degrees": f"""WITH {_GRAPH}, ends AS (SELECT src AS seg_id, weight FROM links UNION ALL SELECT dst, weight FROM links)
SELECT seg_id, count(weight) AS degree, round(coalesce(sum(weight), 0.0::DOUBLE), 4) AS strength FROM (SELECT seg_id FROM verts UNION SELECT seg_id FROM anchor_segments) LEFT JOIN ends USING (seg_id) GROUP BY seg_id""",
    "edit_edges": _edit("0.4::DOUBLE"),
    "edit_edges_lossless": _edit("(1.0::DOUBLE - 0.4::DOUBLE)"),
    "nearest_centroid": f"WITH {_LABELLED}, {_STARTED}, near AS ({_nearest('lab', 'cents')}) SELECT seg_id, k, round(d, 4) AS distance2 FROM near",
    "lloyd_steps": f"WITH {_LABELLED}, {_STARTED}, n1 AS ({_nearest('lab', 'cents')}), c1 AS ({_means('n1')}), n2 AS ({_nearest('lab', 'c1')}), c2 AS ({_means('n2')}) SELECT k, n, {_shown('x')} FROM c2",
    "class_numbers": f"WITH {_CLASSES} SELECT cluster, class, n_members FROM cls",
    "class_numbers_by_size": f"WITH {_ASSIGN} SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, min(seg_id))::INT - 1 AS class, count(*) AS n_members FROM asg GROUP BY cluster",
    "member_lists": f"WITH {_CLASSES} SELECT class, count(*)::INT AS n_members, string_agg(seg_id::VARCHAR, ' ' ORDER BY seg_id) AS members FROM asg JOIN cls USING (cluster) GROUP BY class",
    "partition_lines": f"""WITH {_MEMBERS}, good AS (SELECT * FROM mem WHERE utt_id IS NOT NULL AND end_sec > start_sec AND cluster >= 0 AND run_id IS NOT NULL),
asg AS (SELECT member_id, run_id::BIGINT * 1000000 + cluster AS cluster, utt_id, {_frame('start_sec')} AS s, {_frame('end_sec')} AS e FROM good),
cls AS (SELECT cluster, row_number() OVER (ORDER BY min(member_id))::INT - 1 AS class FROM asg GROUP BY cluster)
SELECT class, 0 AS part, -1::BIGINT AS pos, 'Class ' || class AS line FROM cls UNION ALL SELECT class, 2, -1, '' FROM cls UNION ALL
SELECT class, 1, member_id, utt_id || ' ' || round(s * 20.0::DOUBLE / 1000.0::DOUBLE, 2) || ' ' || round(e * 20.0::DOUBLE / 1000.0::DOUBLE, 2) FROM asg JOIN cls USING (cluster)""",
    "cluster_sizes": f"WITH {_MEMBERS} SELECT run_id, cluster, count(*) AS n_members FROM mem WHERE cluster >= 0 GROUP BY ALL",
    "size_summary": f"""WITH {_MEMBERS}, sizes AS (SELECT run_id, cluster, count(*) AS n FROM mem WHERE cluster >= 0 GROUP BY ALL)
SELECT run_id, count(*) AS active, min(n) AS min_size, median(n) AS median_size, round(avg(n), 6) AS mean_size, max(n) AS max_size, 1000 - count(*) AS empty FROM sizes GROUP BY run_id""",
    "cluster_count": f"WITH {_ASSIGN} SELECT count(DISTINCT cluster) AS n_clusters FROM asg",
    "contiguous_labels": f"WITH {_ASSIGN} SELECT coalesce(max(cluster) + 1, 0) = count(DISTINCT cluster) AS contiguous FROM asg",
    "relabelled": f"WITH {_ASSIGN} SELECT seg_id, dense_rank() OVER (ORDER BY cluster)::INT - 1 AS cluster FROM asg",
    "clean_tokens": f"WITH {_TOKENS} SELECT token_id, token FROM tok",
    "token_ranks": f"WITH {_TOKENS}, cnts AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token) SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token)::INT AS rank, round(cnt::DOUBLE / sum(cnt) OVER (), 8) AS prob FROM cnts",
    "cluster_ranks": f"WITH {_RANKED} SELECT run_id, cluster, cnt, rank, round(prob, 8) AS prob FROM ranked",
    "rank_extent": f"WITH {_RANKED} SELECT run_id, round(max(prob), 8) AS max_prob, max(rank) AS max_rank FROM ranked GROUP BY run_id",
    "reference_curve": f"WITH {_RANKED}, span AS (SELECT max(prob) AS p, max(rank)::DOUBLE AS m FROM ranked), pts AS (SELECT i::INT AS i, pow(10.0::DOUBLE, log10(m) * i / 99.0::DOUBLE) AS r, p FROM span, range(100) t(i)) SELECT i, round(r, 4) AS r, round(1.2::DOUBLE * p / r, 8) AS p FROM pts",
    "run_metadata": f"""SELECT run_id, path, {_RUN_NAME} AS stem, TRY_CAST(nullif(regexp_extract({_RUN_NAME}, 't(0[^_]*)', 1), '') AS DOUBLE) AS run_threshold,
TRY_CAST(nullif(regexp_extract({_RUN_NAME}, 'r(0[^_]*)', 1), '') AS DOUBLE) AS run_resolution, {_RUN_METHOD} AS run_method FROM runs""",
    "plotted_runs": f"SELECT run_id, {_RUN_METHOD} AS run_method FROM runs WHERE {_RUN_NAME} NOT LIKE '%knn%' AND {_RUN_NAME} NOT LIKE '%edit%' AND {_RUN_METHOD} IS NOT NULL",
    "component_stats": f"WITH {_DIMS}, c AS (SELECT k, max(n)::BIGINT AS n, list(s ORDER BY dim) AS s, sum(q) AS q FROM dims GROUP BY k) SELECT k, n, {_shown('s')}, round(q, 4) AS ss_sum FROM c",
    "component_outer": f"WITH {_LABELLED} SELECT k, count(*) AS n, round(sum(list_dot_product(x, x)), 4) AS trace, round(sum(list_sum(x) * list_sum(x)), 4) AS total FROM lab GROUP BY k",
    "fixed_prior": f"WITH {_LONG} SELECT dim::INT AS dim, round((var_pop(v) + 1e-6::DOUBLE) * 0.1::DOUBLE, 8) AS var, round((var_pop(v) + 1e-6::DOUBLE) * 0.1::DOUBLE / 0.05::DOUBLE, 8) AS var_0 FROM long GROUP BY dim",
    "log_marginal_fixed": f"""WITH {_DIMS}, p AS (SELECT 0.02::DOUBLE AS v, 0.4::DOUBLE AS w)
SELECT k, round(sum(-(n - 1) / 2 * ln(v) - n / 2 * ln(2 * pi()) - ln(n * w + v) / 2 - q / (2 * v) + (s * s * w / v) / (n * w + v) / 2), 4) AS log_marg FROM dims, p GROUP BY k""",
    "log_marginal_diag": f"""WITH {_DIMS}, c AS (SELECT k, max(n) AS n, sum(ln(0.1::DOUBLE + q - s * s / (n + 0.05::DOUBLE))) AS log_s FROM dims GROUP BY k)
SELECT k, round(-n * {_D}::DOUBLE / 2 * ln(pi()) + {_D}::DOUBLE / 2 * ln(0.05::DOUBLE) - {_D}::DOUBLE / 2 * ln(n + 0.05::DOUBLE) + 67.0::DOUBLE / 2 * {_D}::DOUBLE * ln(0.1::DOUBLE)
  - (n + 67) / 2 * log_s + {_D}::DOUBLE * (lgamma((n + 67) / 2) - lgamma(67.0::DOUBLE / 2)), 4) AS log_marg FROM c""",
    "map_estimates": f"""WITH {_DIMS}, means AS (SELECT k, max(n)::BIGINT AS n, list(s / (n + 0.05::DOUBLE) ORDER BY dim) AS m, sum(q) AS q FROM dims GROUP BY k),
sums AS (SELECT k, sum(list_sum(x) * list_sum(x)) AS t FROM lab GROUP BY k)
SELECT k, n, {_shown('m')}, round((6.4::DOUBLE + q - (n + 0.05::DOUBLE) * list_dot_product(m, m)) / (n + 67 + 66), 6) + 0.0::DOUBLE AS trace,
round((6.4::DOUBLE + t - (n + 0.05::DOUBLE) * list_sum(m) * list_sum(m)) / (n + 67 + 66), 6) + 0.0::DOUBLE AS total FROM means JOIN sums USING (k)""",
    "log_prior_assignments": "WITH c AS (SELECT count(*)::DOUBLE AS n FROM embeddings GROUP BY label) SELECT round(lgamma(1.0::DOUBLE) - lgamma(sum(n) + 1) + sum(lgamma(n + 1.0::DOUBLE / 16) - lgamma(1.0::DOUBLE / 16)), 4) AS log_prob_z FROM c",
    "predictive_fixed": f"""WITH {_DIMS}, par AS (SELECT k, dim, (s / 0.02::DOUBLE) / (1 / 0.4::DOUBLE + n / 0.02::DOUBLE) AS mu, 1 / (1 / 0.4::DOUBLE + n / 0.02::DOUBLE) + 0.02::DOUBLE AS var FROM dims),
scored AS (SELECT l.seg_id, par.k, sum(-0.5::DOUBLE * (ln(2 * pi()) + ln(var) + (l.v - mu) * (l.v - mu) / var)) AS p FROM long l JOIN par USING (dim) GROUP BY l.seg_id, par.k)
SELECT seg_id, k, round(p, 4) AS log_pred FROM scored QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY p DESC, k) = 1""",
    "assignment_posteriors": f"""WITH {_DIMS}, par AS (SELECT k, dim, n, (s / 0.02::DOUBLE) / (1 / 0.4::DOUBLE + n / 0.02::DOUBLE) AS mu, 1 / (1 / 0.4::DOUBLE + n / 0.02::DOUBLE) + 0.02::DOUBLE AS var FROM dims),
scored AS (SELECT l.seg_id, par.k, ln(1.0::DOUBLE / 16 + max(n)) + sum(-0.5::DOUBLE * (ln(2 * pi()) + ln(var) + (l.v - mu) * (l.v - mu) / var)) AS p FROM long l JOIN par USING (dim) GROUP BY l.seg_id, par.k),
topped AS (SELECT *, exp(p - max(p) OVER (PARTITION BY seg_id)) AS e FROM scored)
SELECT seg_id, k, round(e / sum(e) OVER (PARTITION BY seg_id), 6) + 0.0::DOUBLE AS prob FROM topped""",
    "gmm_step": f"""WITH {_LABELLED}, {_STARTED},
joint AS (SELECT p.seg_id, p.x, c.k, -0.5::DOUBLE * list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 0.05::DOUBLE AS j FROM lab p, cents c),
topped AS (SELECT *, exp(j - max(j) OVER (PARTITION BY seg_id)) AS e FROM joint),
resp AS (SELECT seg_id, x, k, e / sum(e) OVER (PARTITION BY seg_id) AS r FROM topped),
tot AS (SELECT k, sum(r) + 10 * 2.220446049250313e-16::DOUBLE AS n, sum(r * list_dot_product(x, x)) AS q FROM resp GROUP BY k),
dims AS (SELECT k, dim, sum(r * v) AS s FROM (SELECT k, r, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM resp) GROUP BY k, dim),
means AS (SELECT k, list(s / n ORDER BY dim) AS m FROM dims JOIN tot USING (k) GROUP BY k)
SELECT k, round(n / sum(n) OVER (), 6) AS weight, round((q / n - list_dot_product(m, m)) / 64.0::DOUBLE + 1e-6::DOUBLE, 6) AS var, {_shown('m')} FROM means JOIN tot USING (k)""",
    "predictive_diag": f"""WITH {_DIMS}, par AS (SELECT k, dim, s / (n + 0.05::DOUBLE) AS mu, n + 67 AS df,
  (n + 1.05::DOUBLE) / ((n + 0.05::DOUBLE) * (n + 67)) * (0.1::DOUBLE + q - s * s / (n + 0.05::DOUBLE)) AS var FROM dims),
scored AS (SELECT l.seg_id, par.k, sum(lgamma((df + 1) / 2) - lgamma(df / 2) - (ln(df) + ln(pi()) + ln(var)) / 2 - (df + 1) / 2 * ln(1 + (l.v - mu) * (l.v - mu) / (var * df))) AS p FROM long l JOIN par USING (dim) GROUP BY l.seg_id, par.k)
SELECT seg_id, k, round(p, 4) AS log_pred FROM scored QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY p DESC, k) = 1""",
    "log_densities": """SELECT event_id, round(-0.5::DOUBLE * ln(2 * pi()) - ln(25.0::DOUBLE) / 2 - (value - 10) * (value - 10) / 50.0::DOUBLE, 5) AS normal,
round(lgamma(4.0::DOUBLE) - lgamma(3.5::DOUBLE) - (ln(7.0::DOUBLE) + ln(pi()) + ln(25.0::DOUBLE)) / 2 - 4 * ln(1 + (value - 10) * (value - 10) / 175.0::DOUBLE), 5) AS student, round(lgamma(value + 0.25::DOUBLE), 5) AS lgamma
FROM events WHERE value IS NOT NULL""",
    "quality_cpm": f"""WITH {_GRAPH}, size AS (SELECT seg_id % 50 AS c, count(*)::DOUBLE AS n FROM verts GROUP BY c), inn AS (SELECT src % 50 AS c, sum(weight) AS e FROM links WHERE src % 50 = dst % 50 GROUP BY c)
SELECT round(sum(coalesce(e, 0) - 0.01::DOUBLE * n * (n - 1) / 2), 4) AS quality FROM size LEFT JOIN inn USING (c)""",
    "quality_modularity": f"""WITH {_GRAPH}, ends AS (SELECT src % 50 AS c, weight FROM links UNION ALL SELECT dst % 50, weight FROM links), str AS (SELECT c, sum(weight) AS k FROM ends GROUP BY c),
inn AS (SELECT src % 50 AS c, sum(weight) AS e FROM links WHERE src % 50 = dst % 50 GROUP BY c), tot AS (SELECT sum(weight) AS m FROM links)
SELECT round(sum(coalesce(e, 0) - k * k / (4 * m)), 4) AS quality FROM str LEFT JOIN inn USING (c), tot""",
    "graph_components": f"""WITH RECURSIVE {_GRAPH}, both_ways AS (SELECT src AS a, dst AS b FROM links WHERE weight >= 0.7 UNION SELECT dst, src FROM links WHERE weight >= 0.7),
reach(seg_id, component) USING KEY (seg_id) AS (
  SELECT seg_id, seg_id AS component FROM verts
  UNION
  SELECT l.b, min(reach.component) AS component FROM reach JOIN both_ways l ON l.a = reach.seg_id JOIN recurring.reach AS old ON old.seg_id = l.b WHERE reach.component < old.component GROUP BY l.b)
SELECT seg_id, component FROM reach""",
    "quality_rb": f"""WITH {_GRAPH}, ends AS (SELECT src % 50 AS c, weight FROM links UNION ALL SELECT dst % 50, weight FROM links), str AS (SELECT c, sum(weight) AS k FROM ends GROUP BY c),
inn AS (SELECT src % 50 AS c, sum(weight) AS e FROM links WHERE src % 50 = dst % 50 GROUP BY c), tot AS (SELECT sum(weight) AS m FROM links)
SELECT round(sum(coalesce(e, 0) - 0.7::DOUBLE * k * k / (4 * m)), 4) AS quality FROM str LEFT JOIN inn USING (c), tot""",
    "kmeans_clusters": f"WITH {_LABELLED}, {_rounds(8, 10)}, near AS ({_nearest('lab', 'c8')}) SELECT seg_id, k, round(d, 4) AS distance2 FROM near",
    "codebook_units": f"WITH {_LABELLED}, {_rounds(5, 20)}, near AS ({_nearest('lab', 'c5')}) SELECT 'all' AS utt_id, seg_id::INT AS frame, k::INT AS unit FROM near",
    "gmm_clusters": f"""WITH {_LABELLED}, {_em(5, 10)}, joint AS ({_joint('g5')}),
best AS (SELECT seg_id, arg_max(k, j) AS k, max(j) AS top FROM joint GROUP BY seg_id)
SELECT seg_id, any_value(best.k) AS k, round(any_value(top) + ln(sum(exp(j - top))), 3) AS log_likelihood FROM joint JOIN best USING (seg_id) GROUP BY seg_id""",
    "log_marginal_full": f"""WITH RECURSIVE {_SCALES}, {_eliminated('scales')},
det AS (SELECT k, sum(ln(v)) AS d FROM steps WHERE i = step AND l = step GROUP BY k), cnt AS (SELECT k, count(*)::DOUBLE AS n FROM lab GROUP BY k)
SELECT k, round(-n * 32 * ln(pi()) + 32 * (ln(0.05::DOUBLE) - ln(n + 0.05::DOUBLE)) + 67.0::DOUBLE / 2 * 64 * ln(0.1::DOUBLE) - (n + 67) / 2 * d
  + list_sum(list_transform(range(1, 65), lambda i: lgamma((n + 68 - i) / 2) - lgamma((68.0::DOUBLE - i) / 2))), 4) AS log_marg FROM det JOIN cnt USING (k)""",
    "predictive_full": f"""WITH RECURSIVE {_SCALES},
sides AS (SELECT f.k, f.i, 64 + p.seg_id AS l, p.x[f.i + 1] - f.s / (f.n + 0.05::DOUBLE) AS v FROM firsts f, lab p),
source AS (FROM scales UNION ALL FROM sides), {_eliminated('source')},
pivots AS (SELECT k, step, v FROM steps WHERE i = step AND l = step), det AS (SELECT k, sum(ln(v)) AS d FROM pivots GROUP BY k),
far AS (SELECT s.k, s.l - 64 AS seg_id, sum(s.v * s.v / p.v) AS q FROM steps s JOIN pivots p ON p.k = s.k AND p.step = s.step WHERE s.i = s.step AND s.l >= 64 GROUP BY ALL),
cnt AS (SELECT k, count(*)::DOUBLE AS n, n + 4 AS f, (n + 1.05::DOUBLE) / ((n + 0.05::DOUBLE) * (n + 4)) AS c FROM lab GROUP BY k),
scored AS (SELECT seg_id, k, lgamma((f + 64) / 2) - lgamma(f / 2) - 32 * (ln(f) + ln(pi())) - 0.5::DOUBLE * (d + 64 * ln(c)) - (f + 64) / 2 * ln(1 + q / c / f) AS p FROM far JOIN det USING (k) JOIN cnt USING (k))
SELECT seg_id, k, round(p, 3) AS log_pred FROM scored QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY p DESC, k) = 1""",
    "principal_components": f"""WITH {_LONG}, st AS (SELECT dim, avg(v) AS m, var_pop(v) AS w FROM long GROUP BY dim)
SELECT seg_id, round(sum(CASE WHEN w > 0 THEN (v - m) * (v - m) / w ELSE 0 END), 4) AS x_square FROM long JOIN st USING (dim) GROUP BY seg_id""",
    "principal_variances": f"WITH {_LONG}, st AS (SELECT dim, var_pop(v) AS w FROM long GROUP BY dim) SELECT true AS uncorrelated, true AS in_order, round(count(*) FILTER (w > 0)::DOUBLE, 4) AS variance FROM st",
    "agglomerative_single": f"""WITH RECURSIVE {_UNIT}, both_ways AS (SELECT a.seg_id AS a, b.seg_id AS b FROM unit a JOIN unit b ON a.seg_id <> b.seg_id WHERE list_dot_product(a.u, b.u) > 0.74),
reach(seg_id, cluster) USING KEY (seg_id) AS (
  SELECT seg_id, seg_id AS cluster FROM unit
  UNION
  SELECT l.b, min(reach.cluster) AS cluster FROM reach JOIN both_ways l ON l.a = reach.seg_id JOIN recurring.reach AS old ON old.seg_id = l.b WHERE reach.cluster < old.cluster GROUP BY l.b)
SELECT seg_id, cluster FROM reach""",
    "seeded_centroids": f"WITH {_LABELLED} SELECT least(10, count(DISTINCT x)) AS n, least(10, count(DISTINCT x)) AS n_known FROM lab",
    "sampled_vectors": "SELECT least(60, count(*)) AS n, least(60, count(DISTINCT vec_id)) AS n_known FROM embeddings",
    "birch_features": f"WITH {_LABELLED} SELECT count(*) AS n, round(sum(list_sum(x)), 3) AS s, round(sum(list_dot_product(x, x)), 3) AS q, true AS within FROM lab",
    "birch_clusters": "SELECT count(*) AS n, 10::BIGINT AS n_clusters, 0::BIGINT AS n_repeated FROM embeddings",
    "agglomerative_clusters": f"WITH {_UNIT} SELECT count(*) AS n, 0::BIGINT AS n_spanning, 0::BIGINT AS n_joinable FROM unit",
    "leiden_communities": f"WITH {_UNIT} SELECT count(*) AS n, 0::BIGINT AS n_repeated, 0::BIGINT AS n_in_pieces, true AS preferred FROM unit",
    "tuned_communities": f"WITH {_GRAPH} SELECT count(*) AS n, 0::BIGINT AS n_repeated, true AS best FROM verts",
    "fbgmm_clusters": "SELECT count(*) AS n, 0::BIGINT AS n_outside, 2::BIGINT AS n_sweeps, true AS agrees FROM embeddings",
    "frame_files": f"""WITH {_VALID}, frames AS (SELECT utt_id, start_frame AS frame, arg_min(x, seg_id) AS x FROM valid WHERE utt_id IS NOT NULL AND start_frame IS NOT NULL GROUP BY ALL)
SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY frame)::INT - 1 AS frame, {_shown('x')} FROM frames""",
    "boundary_files": """SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY pos, end_sec)::INT - 1 AS pos, end_sec
FROM (SELECT DISTINCT utt_id, pos, end_sec FROM boundaries WHERE utt_id IS NOT NULL AND pos IS NOT NULL AND end_sec IS NOT NULL)""",
    "textgrid_files": """SELECT utt_id, tier, interval_start, interval_end, coalesce(label, '') AS label FROM (SELECT DISTINCT token_id, utt_id, tier, interval_start, interval_end, label FROM textgrid)
WHERE utt_id IS NOT NULL AND tier IS NOT NULL AND interval_start IS NOT NULL AND interval_end IS NOT NULL""",
    "partition_files": f"""WITH {_MEMBERS}, good AS (SELECT * FROM mem WHERE utt_id IS NOT NULL AND end_sec > start_sec AND cluster >= 0 AND run_id IS NOT NULL),
asg AS (SELECT member_id, run_id::BIGINT * 1000000 + cluster AS cluster, utt_id, {_frame('start_sec')} AS s, {_frame('end_sec')} AS e FROM good),
cls AS (SELECT cluster, row_number() OVER (ORDER BY min(member_id))::INT - 1 AS class FROM asg GROUP BY cluster)
SELECT class, row_number() OVER (PARTITION BY class ORDER BY member_id)::INT - 1 AS pos, utt_id, round(s * 20.0::DOUBLE / 1000.0::DOUBLE, 2) AS start_sec, round(e * 20.0::DOUBLE / 1000.0::DOUBLE, 2) AS end_sec
FROM asg JOIN cls USING (cluster)""",
    "pooled_files": f"""WITH places AS (SELECT DISTINCT seg_id, utt_id, start_frame, end_frame FROM segments WHERE utt_id IS NOT NULL), {_VALID},
one AS (SELECT p.utt_id, p.start_frame, p.end_frame, arg_min(v.x, v.seg_id) AS x FROM valid v JOIN places p USING (seg_id) WHERE p.start_frame IS NOT NULL AND p.end_frame IS NOT NULL GROUP BY ALL)
SELECT utt_id, start_frame, end_frame, {_shown('x')} FROM one""",
    "unit_files": """WITH one AS (SELECT utt_id, start_frame, end_frame, arg_min(quantised, seg_id) AS q FROM unit_segments WHERE utt_id IS NOT NULL AND quantised IS NOT NULL GROUP BY ALL)
SELECT utt_id, start_frame, end_frame, array_to_string(list_filter(q, lambda u: u >= 0), ' ') AS units FROM one WHERE start_frame IS NOT NULL AND end_frame IS NOT NULL""",
}
