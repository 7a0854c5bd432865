"""DuckDB SQL for the operators that SQL can express, by plain definitions:
all pairs that share a shingle, all windows, and dynamic programming as a
recursive query.  They are meant for small tables."""

from __future__ import annotations

from .packing import BUCKETS, TOKEN_BUDGET
from .url_filter import BOUND, FOLDS, ORDER, STEPS

_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = ("translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz')")

SQL: dict[str, str] = {}

SQL["op1_near_dedup"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s
  FROM words, unnest(range(1, greatest(len(ws), CASE WHEN len(ws) = 1 THEN 2 ELSE 1 END))) t(i)
), sizes AS (
  SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes u ON u.doc_id = a JOIN sizes v ON v.doc_id = b
  WHERE 100 * common >= 80 * (u.n + v.n - common)
), ends AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, a AS other FROM ends
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN ends e ON e.a = r.other
), least AS (
  SELECT doc_id, MIN(other) AS component FROM reached GROUP BY doc_id
)
SELECT d.doc_id, COALESCE(s.n, 0) AS n_shingles, COALESCE(l.component, d.doc_id) AS component_id,
       d.doc_id = COALESCE(l.component, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id"""

SQL["op5_substring_dedup"] = f"""
WITH words AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS w
  FROM words, unnest(range(1, greatest(len(ws) - 48, 1))) t(i)
), firsts AS (
  SELECT w, MIN(doc_id) AS owner FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT v.doc_id, p FROM windows v JOIN firsts f ON f.w = v.w AND v.doc_id > f.owner,
    unnest(range(i, i + 50)) u(p)
), left_over AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, COUNT(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM words) x
  ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p
  GROUP BY x.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - COALESCE(n, 0) AS n_removed,
       sha256(COALESCE(kept, '')) AS kept_sha256
FROM words w LEFT JOIN left_over l ON l.doc_id = w.doc_id"""

SQL["op10_packing"] = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents
), steps AS (
  SELECT n_tokens, CAST(CASE WHEN n_tokens < 1024 THEN 1 ELSE 1 << (length(bin(n_tokens)) - 10) END
                        AS BIGINT) AS step
  FROM sized
), hist AS (
  SELECT (n_tokens + step - 1) // step * step AS size, COUNT(*) AS n,
         CAST(SUM(n_tokens) AS BIGINT) AS total
  FROM steps GROUP BY ALL
), marks AS (
  SELECT ROW_NUMBER() OVER (ORDER BY size) AS j, size,
         CAST(SUM(n) OVER (ORDER BY size) AS BIGINT) AS docs,
         CAST(SUM(total) OVER (ORDER BY size) AS BIGINT) AS toks
  FROM hist
  UNION ALL SELECT 0, 0, 0, 0
), best AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS cut
  UNION ALL
  SELECT b.k + 1, p.j, MIN(b.cost + p.size * (p.docs - q.docs) - (p.toks - q.toks)),
         CAST(ARG_MIN(b.j, (b.cost + p.size * (p.docs - q.docs) - (p.toks - q.toks)) * 1000000 + b.j)
              AS BIGINT)
  FROM best b JOIN marks q ON q.j = b.j JOIN marks p ON p.j > b.j
  WHERE b.k < {BUCKETS} GROUP BY b.k + 1, p.j
), last AS (
  SELECT MAX(j) AS j, LEAST(MAX(j), {BUCKETS}) AS k FROM marks
), path AS (
  SELECT b.k, b.j, b.cut FROM best b JOIN last l ON b.k = l.k AND b.j = l.j
  UNION ALL
  SELECT b.k, b.j, b.cut FROM path p JOIN best b ON b.k = p.k - 1 AND b.j = p.cut WHERE p.k > 1
), bounds AS (
  SELECT CAST(p.k - 1 AS INTEGER) AS bucket, m.size AS bucket_len,
         COALESCE(LAG(m.size) OVER (ORDER BY p.k), -1) AS above
  FROM path p JOIN marks m ON m.j = p.j
), placed AS (
  SELECT s.*, b.bucket, b.bucket_len,
         ROW_NUMBER() OVER (PARTITION BY b.bucket ORDER BY s.doc_id, s.n_tokens) - 1 AS place
  FROM sized s JOIN bounds b ON s.n_tokens > b.above AND s.n_tokens <= b.bucket_len
)
SELECT doc_id, n_tokens, bucket, bucket_len,
       CASE WHEN bucket_len = 0 THEN 0
            ELSE place // GREATEST(1, {TOKEN_BUDGET} // bucket_len) END AS batch,
       bucket_len - n_tokens AS n_pad
FROM placed"""


SQL["op12_hard_negatives"] = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.*, n.id AS negative_id, n.score AS negative_score,
         CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)
              AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3"""


def _chances() -> str:
    """Witten-Bell mixtures, a step per length of the gram."""
    steps = ["chance0 AS (SELECT '' AS tail, 1.0 / COUNT(*) AS pa, 1.0 / COUNT(*) AS pr "
             "FROM tails WHERE level = 1)"]
    for k in range(1, ORDER + 2):
        steps.append(f"""chance{k} AS (
  SELECT t.gram AS tail,
         CASE WHEN all_a > 0 THEN (t.a + kinds_a * pa) / (all_a + kinds_a) ELSE pa END AS pa,
         CASE WHEN all_r > 0 THEN (t.r + kinds_r * pr) / (all_r + kinds_r) ELSE pr END AS pr
  FROM tails t JOIN contexts c ON c.context = left(t.gram, {k - 1}) AND c.level = t.level
  JOIN chance{k - 1} s ON s.tail = right(t.gram, {k - 1}) WHERE t.level = {k}
)""")
    return ", ".join(steps)


SQL["op13_url_filter"] = f"""
WITH rest AS (
  SELECT page_id, COALESCE(url, '') AS url, strpos(COALESCE(url, ''), '://') AS mark FROM pages
), cut AS (
  SELECT *, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS tail FROM rest
), named AS (
  SELECT page_id, url, mark, tail, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path,
         translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host
  FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
         ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
         ('com/de/', 'com', '/de/', 'block')
), places AS (
  SELECT ROW_NUMBER() OVER () AS place, page_id, host, path,
         CASE WHEN mark > 0 THEN host || substr(tail, length(host) + 1) ELSE url END AS text
  FROM named
), fitting AS (
  SELECT place, rule, verdict FROM places JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY place ORDER BY length(rule) DESC, rule) = 1
), judged AS (
  SELECT p.*, rule, verdict FROM places p LEFT JOIN fitting f ON f.place = p.place
), urls AS (
  SELECT text, label, counted, ROW_NUMBER() OVER () AS id FROM (
    SELECT DISTINCT text, verdict AS label, verdict IS NOT NULL
      AND CAST('0x' || right(md5(text), 8) AS BIGINT) % {FOLDS} <> 0 AS counted FROM judged)
), marked AS (
  SELECT id, label, counted, repeat(chr(2), {ORDER}) || text || chr(3) AS m, length(text) AS n FROM urls
), spots AS (
  SELECT id, label, counted, substr(m, i, {ORDER + 1}) AS gram FROM marked, unnest(range(1, n + 2)) t(i)
), counts AS (
  SELECT gram, COUNT(*) FILTER (counted AND label = 'allow') AS a,
         COUNT(*) FILTER (counted AND label = 'block') AS r FROM spots GROUP BY gram
), tails AS (
  SELECT right(gram, level) AS gram, level, SUM(a) AS a, SUM(r) AS r
  FROM counts, unnest(range(1, {ORDER + 2})) t(level) GROUP BY ALL
), contexts AS (
  SELECT level, left(gram, level - 1) AS context, SUM(a) AS all_a, SUM(r) AS all_r,
         COUNT(*) FILTER (a > 0) AS kinds_a, COUNT(*) FILTER (r > 0) AS kinds_r
  FROM tails GROUP BY ALL
), {_chances()}, ratios AS (
  SELECT tail AS gram, CASE WHEN (SELECT MAX(a) > 0 AND MAX(r) > 0 FROM counts)
    THEN CAST(round((ln(pa) - ln(pr)) * 1000000) AS BIGINT) ELSE 0 END AS ratio
  FROM chance{ORDER + 1}
), scores AS (
  SELECT id, SUM(ratio) / COUNT(*) / 1000000 AS score
  FROM spots JOIN ratios ON ratios.gram = spots.gram WHERE NOT counted GROUP BY id
), scored AS (
  SELECT text, label, score FROM scores JOIN urls ON urls.id = scores.id
), found AS (
  SELECT LEAST(GREATEST(floor(score * {STEPS}), {-BOUND * STEPS}), {BOUND * STEPS}) AS step, label
  FROM scored WHERE label IS NOT NULL
), wrong AS (
  SELECT s.step,
    (SELECT COUNT(*) FROM found WHERE label = 'allow' AND step < s.step)
      * (SELECT COUNT(*) FROM found WHERE label = 'block')
    + (SELECT COUNT(*) FROM found WHERE label = 'block' AND step >= s.step)
      * (SELECT COUNT(*) FROM found WHERE label = 'allow') AS wrong
  FROM (SELECT unnest(range({-BOUND * STEPS}, {BOUND * STEPS + 1})) AS step) s
), threshold AS (
  SELECT CASE WHEN (SELECT COUNT(DISTINCT label) FROM found) = 2
    THEN (MIN(step) + MAX(step)) / 2 / {STEPS} ELSE 0 END AS t
  FROM wrong WHERE wrong = (SELECT MIN(wrong) FROM wrong)
)
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict
  WHEN score >= (SELECT t FROM threshold) THEN 'allow' ELSE 'block' END AS verdict
FROM judged j LEFT JOIN scored s ON s.text = j.text AND s.label IS NULL"""
