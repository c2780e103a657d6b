"""The same results in plain SQL, derived from the event table step by step.

``STEPS`` is one chain of common table expressions. A query takes the chain up to the step it
needs. The SQL follows the definitions directly (pairwise rank counts, closed-form ridge, plain
windows), so it is a check that does not share the shape of the Spark plans.
"""

from __future__ import annotations



def _kmeans(p: str, rows: str, keys: str, restarts: int = 20, iterations: int = 300) -> list[tuple[str, str]]:
    """K-means with two cells over the histograms of ``rows``, one row per restart and iteration."""

    def draw(names: str, below: str) -> str:
        return f"('0x' || substr(sha256('4100:' || {names}), 1, 15))::BIGINT % {below}"

    def mean(cell: int) -> str:
        return "[" + ", ".join(f"coalesce(sum(w * hist[{i}]) FILTER (cell = {cell}) / sum(w) FILTER (cell = {cell}), 0)" for i in range(1, 9)) + "]"

    def square(m: str) -> str:
        return f"list_sum(list_transform({m}, lambda v: v * v))"

    key_list = keys.split(", ")
    same = " AND ".join(f"s.{k} = h.{k}" for k in key_list)
    return [
        (f"{p}weights", f"SELECT {keys}, hist, count(*) AS w FROM {rows} GROUP BY ALL"),
        (f"{p}numbered", f"""
SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY hist) - w AS lo, CAST(sum(w) OVER (PARTITION BY {keys}) AS BIGINT) AS n FROM {p}weights"""),
        (f"{p}starts", f"""
SELECT {keys}, r, max(hist) FILTER (j = 0) AS c0, max(hist) FILTER (j = 1) AS c1 FROM (
  SELECT s.* , h.hist FROM (SELECT {keys}, r, j, CASE WHEN j = 0 THEN x0 WHEN x1 >= x0 THEN x1 + 1 ELSE x1 END AS x FROM (
    SELECT {keys}, r, {draw("r || ':0'", "n")} AS x0, {draw("r || ':1'", "(n - 1)")} AS x1
    FROM (SELECT DISTINCT {keys}, n FROM {p}numbered WHERE n >= 2), (SELECT unnest(range(0, {restarts})) AS r)), (SELECT unnest([0, 1]) AS j)) s
  ASOF JOIN {p}numbered h ON {same} AND s.x >= h.lo) GROUP BY ALL"""),
        (f"{p}again", f"""
SELECT {keys}, r, it, max(hist) FILTER (j = 0) AS f0, max(hist) FILTER (j = 1) AS f1 FROM (
  SELECT s.*, h.hist FROM (SELECT {keys}, r, it, j, {draw("r || ':' || j || ':' || it", "n")} AS x FROM (SELECT DISTINCT {keys}, n FROM {p}numbered WHERE n >= 2),
    (SELECT unnest(range(0, {restarts})) AS r), (SELECT unnest(range(0, {iterations})) AS it), (SELECT unnest([0, 1]) AS j)) s
  ASOF JOIN {p}numbered h ON {same} AND s.x >= h.lo) GROUP BY ALL"""),
        (f"{p}lloyd", f"""
SELECT {keys}, r, CAST(0 AS BIGINT) AS it, c0, c1, CAST(1e9 AS DOUBLE) AS shift, CAST(0 AS DOUBLE) AS inertia FROM {p}starts
UNION ALL
SELECT {keys}, r, it + 1, n0, n1, greatest(list_distance(c0, n0), list_distance(c1, n1)), inertia FROM (
  SELECT {keys}, r, it, c0, c1, CASE WHEN w0 > 0 THEN m0 ELSE f0 END AS n0, CASE WHEN w1 > 0 THEN m1 ELSE f1 END AS n1,
    sq - CASE WHEN w0 > 0 THEN w0 * {square('m0')} ELSE 0 END - CASE WHEN w1 > 0 THEN w1 * {square('m1')} ELSE 0 END AS inertia
  FROM (SELECT {keys}, r, it, c0, c1, {mean(0)} AS m0, {mean(1)} AS m1, sum(w) FILTER (cell = 0) AS w0, sum(w) FILTER (cell = 1) AS w1, sum(w * {square('hist')}) AS sq
    FROM (SELECT k.*, w, hist, CASE WHEN list_distance(hist, c0) - least(list_distance(hist, c0), list_distance(hist, c1)) <= 1e-12 THEN 0 ELSE 1 END AS cell
      FROM {p}lloyd k JOIN {p}weights USING ({keys}) WHERE k.shift > 1e-4 AND k.it < {iterations}) GROUP BY ALL)
  JOIN {p}again USING ({keys}, r, it))"""),
        (f"{p}centroids", f"""
SELECT {keys}, arg_min(c0, r) AS c0, arg_min(c1, r) AS c1 FROM (SELECT *, min(inertia) OVER (PARTITION BY {keys}) AS least FROM (
  SELECT {keys}, r, arg_max(c0, it) AS c0, arg_max(c1, it) AS c1, arg_max(inertia, it) AS inertia FROM {p}lloyd GROUP BY ALL))
WHERE inertia <= least + 1e-9 * (1 + least) GROUP BY ALL"""),
    ]


def bisected(counts: str, alpha: str) -> str:
    """(n, x, lo, hi): the p at which x or fewer of n are as likely as ``alpha``, by halving with sums of binomial terms."""
    mid = "(lo + hi) / 2"
    tail = f"list_sum(list_transform(range(0, x + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({mid}) + (n - k) * ln(1 - {mid}))))"
    return f"""WITH RECURSIVE halving AS (SELECT n, x, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM {counts}
  UNION ALL SELECT n, x, step + 1, CASE WHEN t > {alpha} THEN {mid} ELSE lo END, CASE WHEN t > {alpha} THEN hi ELSE {mid} END FROM (SELECT *, {tail} AS t FROM halving WHERE step < 50))
SELECT n, x, lo, hi FROM halving WHERE step = 50"""


#: the first distinct histograms in hash order and one mean step from them
LLOYD_STEP = """,
capped AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY row_hash, members, epoch) - 1 AS pos FROM training),
seeds AS (SELECT ord, max(hist) FILTER (i = 1) AS c0, max(hist) FILTER (i = 2) AS c1 FROM (
  SELECT ord, hist, row_number() OVER (PARTITION BY ord ORDER BY min(pos)) AS i FROM capped GROUP BY ord, hist) WHERE i <= 2 GROUP BY 1),
stepped AS (SELECT ord, list(m ORDER BY bin) FILTER (cell = 0) AS c0, list(m ORDER BY bin) FILTER (cell = 1) AS c1 FROM (
  SELECT ord, cell, bin, avg(mass) AS m FROM (
    SELECT ord, CASE WHEN list_distance(hist, c0) - least(list_distance(hist, c0), list_distance(hist, c1)) <= 1e-12 THEN 0 ELSE 1 END AS cell,
      unnest(hist) AS mass, unnest(range(0, 8)) AS bin FROM capped JOIN seeds USING (ord)) GROUP BY ALL) GROUP BY 1)
"""

STEPS: list[tuple[str, str]] = [
    ("labelled", """
SELECT event_id AS original_order, CAST(event_id AS VARCHAR) AS uid, user_id,
  'c' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS client_id,
  epoch_us(ts) / 1e6 AS ts_seconds, event_type, props AS payload, value,
  CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS epoch,
  CAST(('0x' || substr(sha256(event_type), 1, 16))::UBIGINT % 8 AS BIGINT) AS bucket,
  CASE WHEN value >= 200 THEN 1 ELSE 0 END AS binary_label,
  CASE WHEN value >= 200 THEN event_type ELSE 'normal' END AS attack_type,
  CASE WHEN value >= 200 THEN 'malicious' ELSE 'benign' END AS gt_class
FROM events"""),
    ("sparse", """
SELECT client_id, epoch, bucket, count(*) AS n, count(*) FILTER (gt_class = 'benign') AS n_benign
FROM labelled GROUP BY ALL"""),
    ("selected", """
SELECT client_id, benign_records FROM (
  SELECT client_id, sum(n_benign) AS benign_records, count(DISTINCT epoch) FILTER (n_benign > 0) AS benign_epochs
  FROM sparse GROUP BY 1)
WHERE benign_records >= 20 AND benign_epochs >= 10 ORDER BY benign_records DESC, client_id LIMIT 12"""),
    ("span", """
SELECT max(lo) AS start_epoch, min(hi) AS end_epoch FROM (
  SELECT client_id, min(epoch) AS lo, max(epoch) AS hi FROM sparse JOIN selected USING (client_id)
  WHERE n_benign > 0 GROUP BY 1)"""),
    ("axis", """
SELECT epoch, epoch - start_epoch AS pos, end_epoch - start_epoch + 1 AS epochs
FROM span, (SELECT unnest(range(start_epoch, end_epoch + 1)) AS epoch FROM span)"""),
    ("roles", """
SELECT epoch, pos, epochs,
  CASE WHEN pos < a THEN 'detector_fit' WHEN pos < a + b THEN 'nuisance_fit'
       WHEN pos < a + b + c THEN 'threshold_and_policy_calibration' ELSE 'heldout_benign' END AS partition,
  pos - CASE WHEN pos < a THEN 0 WHEN pos < a + b THEN a WHEN pos < a + b + c THEN a + b ELSE a + b + c END AS part_pos,
  CASE WHEN pos < a THEN a WHEN pos < a + b THEN b WHEN pos < a + b + c THEN c ELSE epochs - a - b - c END AS part_size
FROM (SELECT *, CAST(floor(0.1 * epochs) AS BIGINT) AS a, CAST(floor(0.18 * epochs) AS BIGINT) AS b,
        CAST(floor(0.36 * epochs) AS BIGINT) AS c FROM axis)"""),
    ("grid", """
SELECT s.stream, c.client_id, r.*, list(coalesce(CASE WHEN s.stream = 'benign' THEN p.n_benign ELSE p.n END, 0) ORDER BY b.bucket) AS counts
FROM (VALUES ('benign'), ('all')) s(stream), selected c, roles r, (SELECT unnest(range(0, 8)) AS bucket) b
LEFT JOIN sparse p ON p.client_id = c.client_id AND p.epoch = r.epoch AND p.bucket = b.bucket
GROUP BY ALL"""),
    ("feat", """
SELECT stream, client_id, epoch, pos, partition, part_pos, part_size, counts, CAST(list_sum(counts) AS BIGINT) AS total,
  CASE WHEN list_sum(counts) > 0 THEN greatest(ln(list_sum(counts)) -
    list_sum(list_transform(counts, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / list_sum(counts), 0) ELSE 0 END AS entropy
FROM grid"""),
    ("featl", """
SELECT stream, client_id, epoch, partition, unnest(range(0, 10)) AS feature,
  unnest(list_concat(list_transform(counts, lambda x: ln(1.0 + x)), [CAST(total AS DOUBLE), entropy])) AS value
FROM feat"""),
    ("scaler", """
SELECT client_id, feature, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
FROM featl WHERE stream = 'benign' AND partition = 'detector_fit' GROUP BY ALL"""),
    ("scores", """
SELECT f.stream, f.client_id, f.epoch, f.partition, f.part_pos, f.part_size, f.total, s.score FROM feat f JOIN (
  SELECT stream, client_id, epoch, round(sqrt(sum(power((value - median) / greatest(iqr, 1e-6), 2)) / 10), 6) AS score
  FROM featl JOIN scaler USING (client_id, feature) GROUP BY ALL) s USING (stream, client_id, epoch)"""),
    ("ranks", """
SELECT s.*, least(greatest(m.midrank, 1e-12), 1 - 1e-12) AS rank FROM scores s JOIN (
  SELECT q.client_id, q.score,
    (count(*) FILTER (r.score < q.score) + 0.5 * count(*) FILTER (r.score = q.score) + 0.5) / (count(*) + 1) AS midrank
  FROM (SELECT DISTINCT client_id, score FROM scores) q
  JOIN (SELECT client_id, score FROM scores WHERE stream = 'benign' AND partition = 'nuisance_fit') r USING (client_id)
  GROUP BY ALL) m USING (client_id, score)"""),
    ("labels", """
SELECT client_id, epoch, bool_or(gt_class = 'malicious') AS malicious, count(*) AS records
FROM labelled JOIN selected USING (client_id) GROUP BY ALL"""),
    ("epoch_runs", """
SELECT epoch, previous, sum(opens) OVER (ORDER BY epoch) AS run_id FROM (
  SELECT epoch, lag(epoch) OVER (ORDER BY epoch) AS previous,
    CASE WHEN coalesce(epoch - lag(epoch) OVER (ORDER BY epoch) - 1 <= 2, false) THEN 0 ELSE 1 END AS opens
  FROM (SELECT DISTINCT epoch FROM labels WHERE malicious))"""),
    ("runs", """
SELECT run_id, min(epoch) AS start_epoch, max(epoch) AS end_epoch, max(epoch) - min(epoch) + 1 AS duration FROM epoch_runs GROUP BY 1"""),
    ("participants", """
SELECT run_id, client_id, min(epoch) AS first_epoch
FROM labels JOIN runs ON epoch BETWEEN start_epoch AND end_epoch WHERE malicious GROUP BY ALL"""),
    ("judged", """
SELECT r.*, p.participant_count, p.spread, p.names, p.spread <= 10 AS first_activity_distributed,
  p.participant_count >= 2 AS distributed_support, r.duration >= 2 AS long_enough,
  NOT EXISTS (SELECT 1 FROM labels l WHERE l.malicious AND l.epoch BETWEEN r.start_epoch - 6 AND r.start_epoch - 1)
    AND r.start_epoch - 6 >= (SELECT min(epoch) FROM labels) AS warmup_clean
FROM runs r JOIN (SELECT run_id, count(*) AS participant_count, max(first_epoch) - min(first_epoch) AS spread,
  string_agg(client_id, ',' ORDER BY client_id) AS names FROM participants GROUP BY 1) p USING (run_id)"""),
    ("registry", """
SELECT start_epoch, end_epoch, duration, names, participant_count,
  sha256('network|' || start_epoch || '|' || end_epoch || '|' || names) AS checksum
FROM judged WHERE first_activity_distributed AND distributed_support AND long_enough AND warmup_clean"""),
    ("coalitions", """
SELECT client_id AS coalition_id, 1 AS ord, [client_id] AS members FROM selected
UNION ALL SELECT a.client_id || '|' || b.client_id, 2, [a.client_id, b.client_id] FROM selected a, selected b WHERE a.client_id < b.client_id
UNION ALL SELECT a.client_id || '|' || b.client_id || '|' || c.client_id, 3, [a.client_id, b.client_id, c.client_id]
FROM selected a, selected b, selected c WHERE a.client_id < b.client_id AND b.client_id < c.client_id"""),
    ("member_slots", """
SELECT coalition_id, ord, unnest(members) AS client_id, unnest(range(0, ord)) AS slot FROM coalitions"""),
    ("lagged", """
SELECT stream, epoch + 1 AS epoch, client_id, least(CAST(floor(rank * 8) AS INT), 7) AS b FROM ranks"""),
    ("fed_bins", """
SELECT a.stream, a.epoch, list(a.c ORDER BY a.b) AS counts FROM (
  SELECT e.stream, e.epoch, k.b, count(l.client_id) AS c
  FROM (SELECT DISTINCT stream, epoch FROM ranks) e CROSS JOIN (SELECT unnest(range(0, 8)) AS b) k
  LEFT JOIN lagged l ON l.stream = e.stream AND l.epoch = e.epoch AND l.b = k.b GROUP BY ALL) a GROUP BY ALL"""),
    ("coalition_epochs", """
SELECT m.coalition_id, m.ord, r.stream, r.epoch, r.partition, r.part_pos, r.part_size,
  list(r.rank ORDER BY m.slot) AS u, list(l.b) FILTER (l.b IS NOT NULL) AS own
FROM member_slots m JOIN ranks r USING (client_id) LEFT JOIN lagged l USING (stream, epoch, client_id) GROUP BY ALL"""),
    ("hists", """
SELECT c.* EXCLUDE (own), list_transform(range(0, 8), lambda k:
    (f.counts[k + 1] - len(list_filter(coalesce(c.own, []), lambda x: x = k))) / CAST(12 - c.ord AS DOUBLE)) AS hist
FROM coalition_epochs c JOIN fed_bins f USING (stream, epoch)"""),
    ("training", """
SELECT ord, members, epoch, hist, substr(sha256('{"coalition_client_ids":["' || array_to_string(members, '","') || '"],"coalition_order":' || ord
  || ',"context_seed":4100,"dataset":"network","epoch_index":' || epoch || '}'), 1, 16) AS row_hash
FROM hists JOIN coalitions USING (coalition_id, ord) WHERE stream = 'benign' AND partition = 'nuisance_fit'"""),
    *_kmeans("", "training", "ord"),
    ("cells", """
SELECT h.*, CASE WHEN list_distance(hist, c0) - least(list_distance(hist, c0), list_distance(hist, c1)) <= 1e-12 THEN 0 ELSE 1 END AS cell
FROM hists h JOIN centroids USING (ord)"""),
    ("support", """
SELECT *, support >= CASE ord WHEN 1 THEN 10 WHEN 2 THEN 15 ELSE 20 END AS supported FROM (
  SELECT coalition_id, ord, cell, count(*) AS support FROM cells WHERE stream = 'benign' AND partition = 'nuisance_fit' GROUP BY ALL)"""),
    ("slots", """
SELECT coalition_id, ord, cell, stream, epoch, partition, part_pos, part_size, unnest(u) AS value, unnest(range(0, ord)) AS slot
FROM cells JOIN support USING (coalition_id, ord, cell) WHERE supported"""),
    ("slot_ranks", """
SELECT q.coalition_id, q.cell, q.slot, q.value,
  least(greatest((coalesce(sum(r.w) FILTER (r.value < q.value), 0) + 0.5 * coalesce(sum(r.w) FILTER (r.value = q.value), 0) + 0.5)
    / (sum(r.w) + 1), 1e-12), 1 - 1e-12) AS r
FROM (SELECT DISTINCT coalition_id, cell, slot, value FROM slots) q
JOIN (SELECT coalition_id, cell, slot, value, count(*) AS w FROM slots WHERE stream = 'benign' AND partition = 'nuisance_fit' GROUP BY ALL) r
USING (coalition_id, cell, slot) GROUP BY ALL"""),
    ("conditional", """
SELECT s.coalition_id, s.ord, s.cell, s.stream, s.epoch, s.partition, s.part_pos, s.part_size, list(k.r ORDER BY s.slot) AS r
FROM slots s JOIN slot_ranks k USING (coalition_id, cell, slot, value) GROUP BY ALL"""),
    ("folded", """
SELECT coalition_id, ord, cell, epoch, r, ntile(5) OVER (PARTITION BY coalition_id, cell ORDER BY epoch) - 1 AS fold,
  count(*) OVER (PARTITION BY coalition_id, cell) AS n
FROM conditional WHERE stream = 'benign' AND partition = 'nuisance_fit'"""),
    ("points", """
SELECT coalition_id, ord, cell, stream, epoch, partition, part_pos, part_size,
  CASE WHEN ord = 2 THEN sqrt(3) * (2 * r[1] - 1) ELSE 0 END AS x1, CASE WHEN ord = 2 THEN sqrt(3) * (2 * r[2] - 1) ELSE 0 END AS x2,
  CASE WHEN ord = 2 THEN 3 * (2 * r[1] - 1) * (2 * r[2] - 1) ELSE sqrt(3) * (2 * r[1] - 1) END AS y
FROM conditional WHERE ord <= 2"""),
    ("fit_points", """
SELECT p.*, f.fold FROM points p JOIN folded f USING (coalition_id, ord, cell, epoch)
WHERE p.stream = 'benign' AND p.partition = 'nuisance_fit' AND f.n >= 5"""),
    ("trains", """
SELECT g.coalition_id, g.ord, g.cell, k.fold, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11,
  sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y
FROM fit_points g, (SELECT unnest(range(-1, 5)) AS fold) k WHERE g.fold <> k.fold GROUP BY ALL"""),
    ("slopes", """
SELECT *, (sy - b1 * s1 - b2 * s2) / n AS b0 FROM (
  SELECT *, ((c22 + l) * c1y - c12 * c2y) / ((c11 + l) * (c22 + l) - c12 * c12) AS b1,
    ((c11 + l) * c2y - c12 * c1y) / ((c11 + l) * (c22 + l) - c12 * c12) AS b2
  FROM (SELECT *, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y
    FROM trains, (VALUES (0.1), (1.0), (10.0), (100.0)) v(l)))"""),
    ("cv", """
SELECT coalition_id, ord, cell, l, avg(power(y - b0 - b1 * x1 - b2 * x2, 2)) AS mse
FROM fit_points JOIN slopes USING (coalition_id, ord, cell, fold) GROUP BY ALL"""),
    ("chosen", """
SELECT coalition_id, ord, cell, max(l) AS l FROM (SELECT *, min(mse) OVER (PARTITION BY coalition_id, cell) AS best FROM cv) WHERE mse <= best + 1e-12 GROUP BY ALL"""),
    ("models", """
SELECT s.coalition_id, s.ord, s.cell, s.fold, s.l, s.n, s.b0, s.b1, s.b2 FROM slopes s JOIN chosen USING (coalition_id, ord, cell, l)"""),
    ("innovations", """
SELECT coalition_id, ord, cell, fold, epoch, y - b0 - b1 * x1 - b2 * x2 AS z FROM fit_points JOIN models USING (coalition_id, ord, cell, fold)"""),
    ("moments", """
SELECT coalition_id, ord, cell, count(*) AS rows, avg(z) AS mu, stddev_samp(z) AS sd FROM innovations GROUP BY ALL"""),
    ("norms", """
SELECT coalition_id, cell, quantile_cont(abs((z - mu) / greatest(sd, 1e-6)), 0.95) AS q_norm
FROM innovations JOIN moments USING (coalition_id, ord, cell) GROUP BY ALL"""),
    ("atoms", """
SELECT p.*, y - b0 - b1 * x1 - b2 * x2 AS z, (y - b0 - b1 * x1 - b2 * x2 - mu) / greatest(sd, 1e-6) AS atom, q_norm
FROM points p JOIN (SELECT * FROM models WHERE fold = -1) USING (coalition_id, ord, cell) JOIN moments USING (coalition_id, ord, cell) JOIN norms USING (coalition_id, cell)"""),
    ("evidence", """
SELECT *, exp(0.5 * least(greatest(abs(atom) / greatest(q_norm, 1e-6) - 1, -1), 1) - 0.125) AS factor FROM atoms"""),
    ("order_evidence", """
SELECT g.stream, g.epoch, g.partition, g.part_pos, g.part_size, coalesce(avg(factor) FILTER (ord = 1), 1) AS e1, coalesce(avg(factor) FILTER (ord = 2), 1) AS e2
FROM (SELECT DISTINCT stream, epoch, partition, part_pos, part_size FROM grid) g LEFT JOIN evidence e USING (stream, epoch) GROUP BY ALL"""),
    ("method_evidence", """
SELECT 'order_one' AS method, stream, epoch, partition, part_pos, part_size, e1 AS factor FROM order_evidence
UNION ALL SELECT 'order_at_most_two', stream, epoch, partition, part_pos, part_size, (e1 + e2) / 2 FROM order_evidence"""),
    ("horizon_axis", """
SELECT DISTINCT stream, epoch, partition, part_pos // 6 AS horizon_id, part_pos % 6 AS pos FROM grid
WHERE stream = 'benign' AND (part_pos // 6 + 1) * 6 <= part_size"""),
    ("horizon_states", """
WITH RECURSIVE base AS (SELECT method, partition, horizon_id, pos, factor FROM method_evidence JOIN horizon_axis USING (stream, epoch, partition)),
walk AS (SELECT method, partition, horizon_id, pos, factor AS state FROM base WHERE pos = 0
  UNION ALL SELECT b.method, b.partition, b.horizon_id, b.pos, (w.state + 1) * b.factor FROM walk w JOIN base b
    ON b.method = w.method AND b.partition = w.partition AND b.horizon_id = w.horizon_id AND b.pos = w.pos + 1)
SELECT * FROM walk"""),
    ("material", """
SELECT m.method, a.partition, a.horizon_id, a.pos, unnest(string_split(coalition_id, '|')) AS client_id
FROM evidence JOIN horizon_axis a USING (stream, epoch), (VALUES ('order_one', 1), ('order_at_most_two', 2)) m(method, top)
WHERE factor >= 0.9 AND ord <= m.top"""),
    ("supported", """
SELECT s.method, s.partition, s.horizon_id, s.pos, count(DISTINCT m.client_id) AS active_clients
FROM horizon_states s JOIN material m ON m.method = s.method AND m.partition = s.partition AND m.horizon_id = s.horizon_id AND m.pos BETWEEN s.pos - 4 AND s.pos
GROUP BY ALL HAVING count(DISTINCT m.client_id) >= 2"""),
    ("stops", """
SELECT s.method, s.partition, s.horizon_id, CAST(h.threshold AS DOUBLE) AS threshold,
  min(s.pos) FILTER (s.state >= h.threshold AND k.active_clients IS NOT NULL) AS stop
FROM horizon_states s LEFT JOIN supported k USING (method, partition, horizon_id, pos),
  (VALUES (1.2), (1.4), (1.6), (1.8), (2.0), (2.1), (2.2), (2.3), (2.5), (3.0)) h(threshold) GROUP BY ALL"""),
    ("false_stops", """
SELECT method, partition, threshold, count(*) AS horizons, count(stop) AS false_stops FROM stops GROUP BY ALL"""),
    ("binomial", """
WITH RECURSIVE terms AS (
  SELECT DISTINCT horizons AS n, 0 AS k, power(0.7, horizons) AS t FROM false_stops
  UNION ALL SELECT n, k + 1, t * (n - k) / (k + 1.0) * (0.3 / 0.7) FROM terms WHERE k < n)
SELECT n AS horizons, k AS false_stops, sum(t) OVER (PARTITION BY n ORDER BY k) AS cdf FROM terms"""),
    ("calibrated", """
SELECT method, min(threshold) FILTER (false_stops < horizons AND cdf <= 0.05 + 1e-15) AS threshold
FROM false_stops JOIN binomial USING (horizons, false_stops) WHERE partition = 'threshold_and_policy_calibration' GROUP BY 1"""),
    ("candidates", """
SELECT client_id, unnest([0, 1, 2]) AS q_index, unnest(t) AS threshold FROM (
  SELECT client_id, quantile_cont(score, [0.9, 0.95, 0.99]) AS t FROM scores WHERE stream = 'benign' AND partition = 'nuisance_fit' GROUP BY 1)"""),
    ("policy_stops", """
SELECT client_id, threshold, m, n, partition, horizon_id, min(pos) FILTER (hits >= m) AS stop FROM (
  SELECT s.client_id, c.threshold, k.m, k.n, s.partition, a.horizon_id, a.pos,
    (SELECT count(*) FROM scores s2 JOIN horizon_axis a2 USING (stream, epoch, partition) WHERE s2.client_id = s.client_id AND a2.partition = a.partition
      AND a2.horizon_id = a.horizon_id AND a2.pos BETWEEN a.pos - k.n + 1 AND a.pos AND s2.score >= c.threshold) AS hits
  FROM scores s JOIN horizon_axis a USING (stream, epoch, partition) JOIN (SELECT DISTINCT client_id, threshold FROM candidates) c USING (client_id),
    (VALUES (1, 1), (2, 3), (3, 5)) k(m, n)) GROUP BY ALL"""),
    ("policy_counts", """
SELECT client_id, threshold, m, n, partition, count(*) AS horizons, count(stop) AS false_stops FROM policy_stops GROUP BY ALL"""),
    ("policies", """
SELECT client_id, min((threshold, m, n)) FILTER (false_stops < horizons AND cdf <= 0.05 + 1e-15) AS p
FROM policy_counts JOIN (
  WITH RECURSIVE terms AS (SELECT DISTINCT horizons AS n, 0 AS k, power(0.7, horizons) AS t FROM policy_counts
    UNION ALL SELECT n, k + 1, t * (n - k) / (k + 1.0) * (0.3 / 0.7) FROM terms WHERE k < n)
  SELECT n AS horizons, k AS false_stops, sum(t) OVER (PARTITION BY n ORDER BY k) AS cdf FROM terms) USING (horizons, false_stops)
WHERE partition = 'threshold_and_policy_calibration' GROUP BY 1"""),
    ("camp_axis", """
SELECT checksum, start_epoch + k AS epoch, k AS pos FROM registry, (SELECT unnest(range(0, 6)) AS k)"""),
    ("camp_states", """
WITH RECURSIVE base AS (SELECT method, checksum, pos, factor FROM method_evidence JOIN camp_axis USING (epoch) WHERE stream = 'all'),
walk AS (SELECT method, checksum, pos, factor AS state FROM base WHERE pos = 0
  UNION ALL SELECT b.method, b.checksum, b.pos, (w.state + 1) * b.factor FROM walk w JOIN base b ON b.method = w.method AND b.checksum = w.checksum AND b.pos = w.pos + 1)
SELECT * FROM walk"""),
    ("camp_material", """
SELECT m.method, a.checksum, a.pos, unnest(string_split(coalition_id, '|')) AS client_id
FROM evidence e JOIN camp_axis a USING (epoch), (VALUES ('order_one', 1), ('order_at_most_two', 2)) m(method, top)
WHERE e.stream = 'all' AND factor >= 0.9 AND ord <= m.top"""),
    ("camp_supported", """
SELECT s.method, s.checksum, s.pos FROM camp_states s JOIN camp_material m ON m.method = s.method AND m.checksum = s.checksum AND m.pos BETWEEN s.pos - 4 AND s.pos
GROUP BY ALL HAVING count(DISTINCT m.client_id) >= 2"""),
    ("camp_stops", """
SELECT s.method, s.checksum, min(s.pos) FILTER (s.state >= c.threshold AND k.pos IS NOT NULL) AS stop FROM camp_states s JOIN calibrated c USING (method)
LEFT JOIN camp_supported k ON k.method = s.method AND k.checksum = s.checksum AND k.pos = s.pos WHERE c.threshold IS NOT NULL GROUP BY ALL"""),
    ("camp_local", """
SELECT checksum, min(pos) AS local_stop FROM (SELECT s.client_id, a.checksum, a.pos, (SELECT count(*) FROM scores s2 JOIN camp_axis a2 USING (epoch)
    WHERE s2.stream = 'all' AND s2.client_id = s.client_id AND a2.checksum = a.checksum AND a2.pos BETWEEN a.pos - p.p[3] + 1 AND a.pos AND s2.score >= p.p[1]) AS hits, p.p[2] AS m
  FROM scores s JOIN camp_axis a USING (epoch) JOIN policies p USING (client_id) WHERE s.stream = 'all') WHERE hits >= m GROUP BY 1"""),
    ("outcomes", """
SELECT g.method, g.checksum, g.stop, l.local_stop, CASE WHEN g.stop < l.local_stop THEN 1 ELSE 0 END AS indicator,
  CASE WHEN g.stop IS NULL THEN 0 ELSE 1 END AS detected FROM camp_stops g LEFT JOIN camp_local l USING (checksum)"""),
    # the chain again without the held fold, orders one and two
    ("x_scores", """
SELECT client_id, epoch, score, mine, held FROM (
  SELECT client_id, epoch, score, ntile(5) OVER (PARTITION BY client_id ORDER BY epoch) - 1 AS mine FROM scores WHERE stream = 'benign' AND partition = 'nuisance_fit'),
  (SELECT unnest(range(0, 5)) AS held)"""),
    ("x_ranks", """
SELECT s.held, s.mine, s.client_id, s.epoch, least(greatest(m.r, 1e-12), 1 - 1e-12) AS rank FROM x_scores s JOIN (
  SELECT q.held, q.client_id, q.score, (count(*) FILTER (r.score < q.score) + 0.5 * count(*) FILTER (r.score = q.score) + 0.5) / (count(*) + 1) AS r
  FROM (SELECT DISTINCT held, client_id, score FROM x_scores) q JOIN (SELECT * FROM x_scores WHERE mine <> held) r USING (held, client_id) GROUP BY ALL) m
USING (held, client_id, score)"""),
    ("x_lagged", """
SELECT held, epoch + 1 AS epoch, client_id, least(CAST(floor(rank * 8) AS INT), 7) AS b FROM x_ranks"""),
    ("x_fed", """
SELECT a.held, a.epoch, list(a.c ORDER BY a.b) AS counts FROM (
  SELECT e.held, e.epoch, k.b, count(l.client_id) AS c FROM (SELECT DISTINCT held, epoch FROM x_ranks) e CROSS JOIN (SELECT unnest(range(0, 8)) AS b) k
  LEFT JOIN x_lagged l ON l.held = e.held AND l.epoch = e.epoch AND l.b = k.b GROUP BY ALL) a GROUP BY ALL"""),
    ("x_hists", """
SELECT c.* EXCLUDE (bs), list_transform(range(0, 8), lambda k: (f.counts[k + 1] - len(list_filter(coalesce(c.bs, []), lambda x: x = k))) / CAST(12 - c.ord AS DOUBLE)) AS hist
FROM (SELECT m.coalition_id, m.ord, r.held, r.mine, r.epoch, list(r.rank ORDER BY m.slot) AS u, list(l.b) FILTER (l.b IS NOT NULL) AS bs
  FROM member_slots m JOIN x_ranks r USING (client_id) LEFT JOIN x_lagged l USING (held, epoch, client_id) WHERE m.ord <= 2 GROUP BY ALL) c JOIN x_fed f USING (held, epoch)"""),
    *_kmeans("x_", "(SELECT * FROM x_hists WHERE mine <> held)", "held, ord"),
    ("x_cells", """
SELECT h.*, CASE WHEN list_distance(hist, c0) - least(list_distance(hist, c0), list_distance(hist, c1)) <= 1e-12 THEN 0 ELSE 1 END AS cell FROM x_hists h JOIN x_centroids USING (held, ord)"""),
    ("x_slots", """
SELECT held, mine, coalition_id, ord, cell, epoch, unnest(u) AS value, unnest(range(0, ord)) AS slot FROM x_cells JOIN (
  SELECT held, coalition_id, cell FROM (SELECT held, coalition_id, ord, cell, count(*) AS n FROM x_cells WHERE mine <> held GROUP BY ALL) WHERE n >= CASE ord WHEN 1 THEN 10 ELSE 15 END)
USING (held, coalition_id, cell)"""),
    ("x_conditional", """
SELECT s.held, s.mine, s.coalition_id, s.ord, s.cell, s.epoch, list(k.r ORDER BY s.slot) AS r FROM x_slots s JOIN (
  SELECT q.held, q.coalition_id, q.cell, q.slot, q.value, least(greatest((count(*) FILTER (r.value < q.value) + 0.5 * count(*) FILTER (r.value = q.value) + 0.5) / (count(*) + 1), 1e-12), 1 - 1e-12) AS r
  FROM (SELECT DISTINCT held, coalition_id, cell, slot, value FROM x_slots) q JOIN (SELECT * FROM x_slots WHERE mine <> held) r USING (held, coalition_id, cell, slot) GROUP BY ALL) k
USING (held, coalition_id, cell, slot, value) GROUP BY ALL"""),
    ("x_points", """
SELECT held, mine, coalition_id, ord, cell, epoch, CASE WHEN ord = 2 THEN sqrt(3) * (2 * r[1] - 1) ELSE 0 END AS x1, CASE WHEN ord = 2 THEN sqrt(3) * (2 * r[2] - 1) ELSE 0 END AS x2,
  CASE WHEN ord = 2 THEN 3 * (2 * r[1] - 1) * (2 * r[2] - 1) ELSE sqrt(3) * (2 * r[1] - 1) END AS y FROM x_conditional"""),
    ("x_train", """
SELECT *, ntile(5) OVER (PARTITION BY held, coalition_id, cell ORDER BY epoch) - 1 AS fold FROM x_points WHERE mine <> held"""),
    ("x_slopes", """
SELECT *, (sy - b1 * s1 - b2 * s2) / n AS b0 FROM (
  SELECT *, ((c22 + l) * c1y - c12 * c2y) / ((c11 + l) * (c22 + l) - c12 * c12) AS b1, ((c11 + l) * c2y - c12 * c1y) / ((c11 + l) * (c22 + l) - c12 * c12) AS b2
  FROM (SELECT *, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y FROM (
    SELECT g.held, g.coalition_id, g.cell, k.fold, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22,
      sum(x1 * y) AS s1y, sum(x2 * y) AS s2y FROM x_train g, (SELECT unnest(range(-1, 5)) AS fold) k WHERE g.fold <> k.fold GROUP BY ALL), (VALUES (0.1), (1.0), (10.0), (100.0)) v(l)))"""),
    ("x_chosen", """
SELECT held, coalition_id, cell, max(l) AS l FROM (SELECT *, min(mse) OVER (PARTITION BY held, coalition_id, cell) AS best FROM (
  SELECT held, coalition_id, cell, l, avg(power(y - b0 - b1 * x1 - b2 * x2, 2)) AS mse FROM x_train JOIN x_slopes USING (held, coalition_id, cell, fold) GROUP BY ALL)) WHERE mse <= best + 1e-12 GROUP BY 1, 2, 3"""),
    ("x_innovations", """
SELECT p.coalition_id, p.ord, p.cell, p.held, p.epoch, y - b0 - b1 * x1 - b2 * x2 AS z FROM x_points p JOIN (SELECT * FROM x_slopes WHERE fold = -1) USING (held, coalition_id, cell)
JOIN x_chosen USING (held, coalition_id, cell, l) WHERE p.mine = p.held"""),
]

# steps that are read often are kept by the engine instead of being recomputed
_KEEP = {"grid", "scores", "ranks", "hists", "cells", "conditional", "fit_points", "slopes", "evidence", "horizon_states", "weights", "numbered", "again", "x_weights", "x_numbered", "x_again", "x_scores", "x_ranks", "x_hists", "x_cells", "x_slots", "x_train", "x_slopes"}


def chain(upto: str, final: str) -> str:
    names = [n for n, _ in STEPS]
    used = STEPS[: names.index(upto) + 1]
    parts = [f"{n} AS {'MATERIALIZED ' if n in _KEEP else ''}({body.strip()})" for n, body in used]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final  # ``final`` may start with ", name AS (...)"
