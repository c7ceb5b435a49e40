"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP7 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_SPACE}), {_ABC}) AS key FROM l),
h AS (SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, h.m IS NOT NULL AND k.doc_id <> h.m AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def _strength(children: str, parent: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(dfb, 0) = 0 OR coalesce(dfw, 0) = 0 THEN 1000.0
  WHEN b / dfb + (sp / dfb - 1) * w / dfw <= 0 OR b / dfb <= w / dfw THEN 1000.0
  ELSE least(1000.0, greatest(0.5, (b / dfb + (sp / dfb - 1) * w / dfw) / (b / dfb - w / dfw) - 1)) END
  FROM (SELECT greatest(sum(npp - s * s / n), 0) AS b, sum(s - npp) AS w, sum(k - 1) AS dfb, sum(n - k) AS dfw,
        sum(n - nn / n) AS sp
        FROM (SELECT {parent}, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(s) AS DOUBLE) AS s, count(*) AS k,
              sum(n * (s / n) * (s / n)) AS npp, CAST(sum(n * n) AS DOUBLE) AS nn
              FROM (SELECT * FROM {children} WHERE n > 0) GROUP BY {parent})))"""


OP1 = f"""
WITH p AS (SELECT page_id,
    translate(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1)
              ELSE '' END, {_ABC}) AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
         ELSE '' END AS path FROM pages),
lab AS (SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS label FROM labels
        WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(label) AS n, coalesce(CAST(sum(label) AS BIGINT), 0) AS s,
       regexp_replace(host, ':[0-9]*$', '') AS name FROM p LEFT JOIN lab ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') AS num FROM h0),
h2 AS (SELECT *, array_to_string(parts[-2:], '.') AS two,
       array_to_string(parts[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') AS wide
       FROM h1),
hosts AS (SELECT host, n, s, CASE WHEN num THEN name WHEN wide THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
          CASE WHEN num THEN '#ip' WHEN wide THEN two ELSE parts[-1] END AS suffix FROM h2),
domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s, 1 AS one FROM domains GROUP BY suffix),
ks AS (SELECT {_strength('suffixes', 'one')} AS k_suffix, {_strength('domains', 'suffix')} AS k_domain,
       {_strength('hosts', 'domain')} AS k_host,
       (SELECT (sum(s) + 0.5) / (sum(n) + 1.0) FROM suffixes) AS mu, (SELECT sum(n) FROM suffixes) AS labelled),
top AS (SELECT suffix, (s + k_suffix * mu) / (n + k_suffix) AS m FROM suffixes, ks),
mid AS (SELECT d.domain, d.suffix, (d.s + k_domain * t.m) / (d.n + k_domain) AS m
        FROM domains d JOIN top t ON d.suffix = t.suffix, ks),
post AS (SELECT h.host, h.n, h.s, h.s + k_host * m AS a, h.n - h.s + k_host * (1 - m) AS b, labelled
         FROM hosts h JOIN mid ON h.domain = mid.domain AND h.suffix = mid.suffix, ks),
sc AS (SELECT host, n, s, labelled > 0 AND a / (a + b) + 1.645 * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) < 0.7
       AS blocked FROM post),
r AS (SELECT p.*, sc.n, sc.s, sc.blocked,
  CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
            THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p LEFT JOIN sc USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict,
       n AS host_labelled, s AS host_good FROM r
"""

OP6 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, min(page_id) AS m FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), {_ABC}) AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
gt AS (SELECT lang, source, term, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p,
              coalesce(c.n, 0) AS n
       FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source)
       LEFT JOIN c USING (lang, source, term)),
ln AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
lt AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
       FROM ln JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
       FROM gt a JOIN gt b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM pairs LEFT JOIN pv USING (lang, source, item)
      UNION ALL
      SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM gt JOIN lt USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM f)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""

OP12 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, b, unnest(range(n - 99)) AS i FROM d WHERE n >= 100),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_slice(b, i + 1, i + 100)) ORDER BY doc_id, i) AS nth FROM w),
v AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r WHERE nth > 1),
x AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY doc_id ORDER BY i) AS run FROM v),
s AS (SELECT doc_id, min(i) AS start, max(i) + 100 AS stop FROM x GROUP BY doc_id, run),
l AS (SELECT doc_id, list(start ORDER BY start) AS starts, list(stop ORDER BY start) AS stops, count(*) AS k,
             CAST(sum(stop - start) AS BIGINT) AS gone FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(k, 0) AS n_spans,
       sha256(CASE WHEN k IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(k + 1), lambda j:
         hex(array_slice(b, CASE WHEN j = 0 THEN 1 ELSE stops[j] + 1 END, CASE WHEN j = k THEN n ELSE starts[j + 1] END))), '')) END)
         AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

Q = {"op12_suffix_dedup": OP12, "op1_url_filters": OP1, "op6_warc": OP6, "op7_line_dedup": OP7, "op13_source_divergence": OP13}
