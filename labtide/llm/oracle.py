"""DuckDB statements for the text queries that SQL can express over whole tables."""

SPACED = r"[^\x20\x09-\x0D]+"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _translate(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP1 = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACED}')), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::HUGEINT AS s FROM sized GROUP BY source
), weighed AS (
  SELECT source, s, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w FROM totals
), level AS (
  -- a source is limited if even its share among those with no less room per weight exceeds its limit
  SELECT a.source, a.s, a.w,
         a.w * (3 * (SELECT sum(s) FROM totals) - 4 * coalesce(sum(b.s), 0))
           > 4 * a.s * ((SELECT sum(w) FROM weighed) - coalesce(sum(b.w), 0)) AS limited
  FROM weighed a LEFT JOIN weighed b ON b.s * a.w < a.s * b.w GROUP BY a.source, a.s, a.w
), used AS (
  SELECT coalesce(sum(s), 0) AS s, coalesce(sum(w), 0) AS w FROM level WHERE limited
), goal AS (
  SELECT source, s AS source_size,
         CASE WHEN limited THEN (2 * s)::DOUBLE
              ELSE (level.w * (3 * (SELECT sum(s) FROM totals) - 4 * (SELECT s FROM used)))::DOUBLE
                   / (2 * ((SELECT sum(w) FROM weighed) - (SELECT w FROM used)))::DOUBLE END AS target
  FROM level
), placed AS (
  SELECT d.doc_id, d.size, g.source_size::BIGINT AS source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM placed
)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, budget - passes * source_size - before)))::BIGINT AS taken
FROM passed
"""

OP4 = f"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all({_translate("text")}, '{SPACED}'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS shingle
  FROM doc_words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT o.a, o.b FROM shared o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b
  WHERE 100 * o.both >= 75 * (x.n + y.n - o.both)
), steps AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, s.b FROM reach r JOIN steps s ON r.b = s.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""

OP5 = f"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '{SPACED}'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS start_at, w FROM doc_words WHERE len(w) >= 50
), hashed AS (
  SELECT doc_id, start_at, md5(array_to_string(w[start_at:start_at + 49], ' ')) AS passage FROM windows
), late AS (
  SELECT doc_id, start_at FROM (SELECT *, min(doc_id) OVER (PARTITION BY passage) AS earliest FROM hashed) WHERE earliest < doc_id
), edges AS (
  -- covered words as the steps of a running count: +1 where a window starts, -1 behind its end
  SELECT doc_id, start_at AS pos, 1 AS step FROM late UNION ALL SELECT doc_id, start_at + 50, -1 FROM late
), steps AS (
  SELECT doc_id, pos, sum(step) AS step FROM edges GROUP BY doc_id, pos
), word_rows AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM doc_words
), counted AS (
  SELECT r.doc_id, r.pos, r.word, sum(coalesce(s.step, 0)) OVER (PARTITION BY r.doc_id ORDER BY r.pos) > 0 AS gone
  FROM word_rows r LEFT JOIN steps s ON r.doc_id = s.doc_id AND r.pos = s.pos
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM counted GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM doc_words d LEFT JOIN kept k USING (doc_id)
"""

OP6 = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, {_translate(f"trim(line, {SPACES})")} AS key FROM split
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = f"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all({_translate("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all({_translate("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), sought AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS passage
  FROM item_words WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM sought),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS start_at, w FROM doc_words, lengths WHERE len(w) >= n
), hits AS (
  SELECT p.doc_id, s.item_id, p.start_at, p.n
  FROM (SELECT doc_id, n, start_at, array_to_string(w[start_at:start_at + n - 1], ' ') AS passage FROM places) p JOIN sought s USING (n, passage)
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(start_at, start_at + n)) AS pos FROM hits) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

OP11 = f"""
WITH RECURSIVE steps(b, v, n) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM steps WHERE n < 8
), bytes AS (
  SELECT list(v ORDER BY b) AS t FROM steps WHERE n = 8
), doc_words AS (
  SELECT doc_id, regexp_extract_all({_translate("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item_words AS (
  SELECT regexp_extract_all({_translate("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), doc_runs AS (
  SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS run FROM doc_words
), item_runs AS (
  SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS run FROM item_words
), runs AS (
  SELECT run, hex(encode(run)) AS h FROM (SELECT run FROM doc_runs UNION SELECT run FROM item_runs)
), hashed AS (
  SELECT run, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT),
    lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM runs, bytes
), doc_buckets AS (
  SELECT doc_id, bucket, count(*) AS n FROM doc_runs JOIN hashed USING (run) GROUP BY doc_id, bucket
), counts AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t FROM (
    SELECT bucket, n AS s, 0 AS t FROM doc_buckets
    UNION ALL SELECT bucket, 0, count(*) FROM item_runs JOIN hashed USING (run) GROUP BY bucket) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM doc_buckets JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM doc_words d LEFT JOIN weighed USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.weight + s.noise AS score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p USING (doc_id)
"""


def _clustering(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and floored means, one after the other."""

    def assigned(at: int) -> str:
        return f"""assigned{at} AS (
  SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT r.row, c.cluster, list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
    FROM rows r, centroids{at} c) GROUP BY row
)"""

    def moved(at: int) -> str:
        return f"""sums{at} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
    SELECT a.cluster, unnest(r.v) AS x, generate_subscripts(r.v, 1) AS i FROM assigned{at - 1} a JOIN rows r USING (row)) GROUP BY cluster, i
), means{at} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM sums{at} GROUP BY cluster
), centroids{at} AS (
  SELECT cluster, coalesce(m.v, c.v) AS v FROM centroids{at - 1} c LEFT JOIN means{at} m USING (cluster)
)"""

    steps = [assigned(0)]
    for at in range(1, rounds + 1):
        steps += [moved(at), assigned(at)]
    return f"""
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64
), centroids0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), vec_id, v) - 1 AS cluster, v FROM rows
  QUALIFY cluster < {k}
), {", ".join(steps)}
SELECT r.vec_id, a.cluster::INTEGER AS cluster, a.distance,
       sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM assigned{rounds} a JOIN rows r USING (row) JOIN centroids{rounds} c USING (cluster)
"""


OP13 = _clustering()

QUERIES = {
    "op1_mixture": OP1,
    "op4_jaccard_join": OP4,
    "op5_substring_dedup": OP5,
    "op6_line_dedup": OP6,
    "op8_decontamination": OP8,
    "op11_resampling": OP11,
    "op13_centroids": OP13,
}
