"""DuckDB SQL with the rows of the queries of the same names."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bench_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, {_bench_words('text')} AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_bench_words('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s
  FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM bw WHERE len(w) > 0) a) b),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM dw CROSS JOIN lens) a),
hits AS (SELECT doc_id, i, places.n AS n, item_id FROM places JOIN win ON places.n = win.n AND places.s = win.s),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) a GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) a GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

SUBSTRING_DEDUP = """
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(greatest(0, len(w) - 34))) AS i FROM dw) a),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM dw),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM dw LEFT JOIN kept USING (doc_id)
"""

_BASE32 = " || ".join(f"to_base(CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT), 32, 4)" for i in range(8))
WARC_REVISITS = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""

_EDGE = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents),
k AS (SELECT *, trim(line, {_EDGE}) AS key FROM l),
boiler AS (SELECT key, min(doc_id) AS holder FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce('s' || source, '')) >= 10),
judged AS (SELECT k.*, boiler.key IS NOT NULL AND doc_id <> holder AS gone FROM k LEFT JOIN boiler ON k.key = boiler.key)
SELECT doc_id, count(*) FILTER (WHERE key <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""

ORACLES = {
    "op1_decontaminate": DECONTAMINATE,
    "op2_substring_dedup": SUBSTRING_DEDUP,
    "op7_warc_revisits": WARC_REVISITS,
    "op9_line_dedup": LINE_DEDUP,
}
