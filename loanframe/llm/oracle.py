"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

OP2 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP3 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM base)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
cut AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base),
line AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(l, '[#*$%&|<>]')) AS sym, len(regexp_extract_all(l, '[!?]{2}')) AS shout,
         len(regexp_extract_all(l, '[|\x{bb}\x{203a}\x{2022}]')) AS bars FROM cut),
judged AS (
  SELECT *, n > 0 AND (sym > n * 0.4 OR shout > n * 0.3 OR (bars >= 2 AND bars > n * 0.2)
         OR (n <= 2 AND NOT regexp_matches(l, '[.!?:;"'')\]\x{2026}\x{201d}\x{3002}]\s*$'))
         OR regexp_matches(lower(l), 'all rights reserved|licensed under|is licensed|cookie policy|accept (all )?cookies|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|subscribe to our newsletter|click here to|alle rechte vorbehalten|lizenziert unter|cookie-richtlinie|cookies akzeptieren|datenschutzerklärung|nutzungsbedingungen|javascript aktivieren|newsletter abonnieren|hier klicken|tous droits réservés|sous licence|politique de cookies|accepter (tous )?les cookies|politique de confidentialité|conditions d''utilisation|activer javascript|abonnez-vous à notre|cliquez ici|todos los derechos reservados|bajo licencia|política de cookies|aceptar (todas las )?cookies|política de privacidad|(términos|condiciones) de uso|habilitar javascript|suscríbete a nuestro|haz clic aquí')) AS bad
  FROM line),
lines AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS n_dup_lines,
         sum(CASE WHEN bad THEN length(l) - len(regexp_extract_all(l, '[\x20\x09-\x0D]')) ELSE 0 END)::BIGINT AS lost_chars
  FROM judged GROUP BY doc_id),
figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         lost_chars
  FROM base LEFT JOIN rep USING (doc_id) JOIN lines USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= word_chars * 0.45 AS kept
FROM figures
"""

OP4 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(.*)$', 1) AS rest FROM pages),
site(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                               ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM u JOIN site ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host || rest,
           '(?si)^([^/?#]*\.)?(ads-track\.|adult-x\.|casino-win\.|cheap-pills\.|free-bets\.|spam-farm\.|(doubleclick\.net|googlesyndication\.com|adservice\..*|popads\.net|adnxs\.com|bet365\..*|xvideos\..*|pornhub\..*|viagra.*)([^A-Za-z0-9_.%-]|$))|-online-casino\.|(\.casino|\.porn|\.xxx)([^A-Za-z0-9_.%-]|$)|/adserver/|/ad-banner/|/doorway/|/phishing/|/malware/|/warez/')
         AND NOT regexp_matches(host || rest, '(?si)^([^/?#]*\.)?(en\.wikipedia\.org|archive\.org)([^A-Za-z0-9_.%-]|$)')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (page_id)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, ''))[1:13])::BIGINT::DOUBLE
         / 4503599627370496.0 AS draw FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3 AS cap,
         [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
lv AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
  FROM s WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN cap / weight > level
         THEN least(max(CASE WHEN cap / weight > level THEN level END) OVER () * weight, cap) ELSE cap END AS target FROM lv),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
lt AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
st AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN lt USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM lt GROUP BY lang),
g AS (
  SELECT o.lang, o.source, coalesce(l.v, 0)::HUGEINT AS v, coalesce(sum(st.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN l USING (lang) LEFT JOIN st USING (lang, source)
  GROUP BY o.lang, o.source, l.v),
p AS (  -- every group's share of every kept term of its language
  SELECT g.lang, g.source, lt.term, coalesce(st.n, 0) AS n,
         1 + (1000000000 * (coalesce(st.n, 0) + 1)) // (g.total + g.v) AS p,
         1 + (1000000000 * (lt.n + 1)) // (l.total + g.v) AS q
  FROM g JOIN lt USING (lang) JOIN l USING (lang) LEFT JOIN st ON st.lang = g.lang AND st.source = g.source AND st.term = lt.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""

OP13 = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS z,
         -- CRC-32 of the decimal id, bit by bit
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 0 AS bad
  FROM documents),
leaf AS (
  SELECT doc_id, lang, sha256(a || coalesce(len(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
         sha256(a || coalesce(len(CAST(n_chars + bad::INT AS VARCHAR)) || ':' || (n_chars + bad::INT), '-') || z) AS claim
  FROM rows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaf),
tree AS (
  SELECT g, 0 AS lvl, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT g, lvl + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, lvl, i // 2),
sub AS (SELECT g, lvl AS height, h AS subroot FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, g AS i, count(*) OVER () AS n, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 2),
-- one row for each node on a leaf's way up: the level's sibling, if any, and on which side it stands
way AS (
  SELECT p.g, p.i, t.lvl, (p.i >> t.lvl) & 1 AS side, s.h
  FROM placed p JOIN (SELECT DISTINCT g, lvl FROM tree WHERE n > 1) t USING (g)
  LEFT JOIN tree s ON s.g = p.g AND s.lvl = t.lvl AND s.i = xor(p.i >> t.lvl, 1)
  UNION ALL
  SELECT p.g, p.i, 1000 + t.lvl, (p.g >> t.lvl) & 1, s.h
  FROM placed p CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) t
  LEFT JOIN top s ON s.lvl = t.lvl AND s.i = xor(p.g >> t.lvl, 1)),
proof AS (
  SELECT g, i, coalesce(string_agg(h, '' ORDER BY lvl), '') AS hs,
         list(CASE WHEN h IS NULL THEN 'N' WHEN side = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY lvl) AS steps
  FROM way GROUP BY g, i),
folded AS (
  SELECT p.*, sha256(coalesce(hs, '')) AS proof_sha256,
         list_reduce(list_prepend(claim, coalesce(steps, [])), lambda x, s: sha256(
           CASE s[1] WHEN 'N' THEN x WHEN 'L' THEN s[2:] || x ELSE x || s[2:] END)) AS folded_root
  FROM placed p LEFT JOIN proof USING (g, i))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN sub USING (g) CROSS JOIN (SELECT h AS root FROM top WHERE n = 1)
"""

ORACLE_SQL = {"op2_exact_dedup": OP2, "op3_quality_rules": OP3, "op4_url_filter": OP4, "op6_mix_sources": OP6,
              "op11_source_divergence": OP11, "op13_merkle_manifest": OP13}
