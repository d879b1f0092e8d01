"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHATS = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, role || ' ' || text AS said, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
 CAST(sum(12 + 3 + 9 + length(said) - 1 + 4 * (length(said) - length(replace(said, '&', ''))) + 3 * (length(said) - length(replace(said, '<', ''))) + 5 * (length(said) - length(replace(said, '"', '')))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{{0}}')"
_TOKENS = _WORDS.format(r"[^\x20\x09-\x0D]+")
_ALNUM = _WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * p.both >= 85 * (nx.size + ny.size - p.both)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

CONTAMINATION = f"""WITH i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) AS win FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT dw.doc_id, dw.k, dw.size, iw.item_id FROM dw JOIN iw ON iw.size = dw.size AND iw.win = array_to_string(dw.w[dw.k:dw.k + dw.size - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


# The patterns of the contract and of the added kinds, as SQL has them.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = "AKIA[A-Z0-9]{12,}"
_HEX = "[0-9a-f]{32,}"
_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\x09-\x0D\x20]*[A-Za-z-]{2,20}: [^\n]{0,80}\n){0,3}[A-Za-z0-9+/=\x09-\x0D\x20]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    "|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
)
_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
_BEARER = r"(?i:bearer)\x20[A-Za-z0-9._~+/-]{16,}=*"
_URL = r"://[^\x09-\x0D\x20/@:]{1,64}:[^\x09-\x0D\x20/@:]{6,64}@"
_ACCOUNT = "(?:AccountKey|SharedAccessKey)=[A-Za-z0-9+/]{24,}=*"
_LONG = "[A-Za-z0-9+/_-]{24,}"
_MORE = "|".join([_KEY, _TOKEN, _BEARER, _URL, _ACCOUNT, _LONG])
_KINDS = "'assign', 'access', 'hex', 'key', 'jwt', 'service', 'owned', 'bearer', 'url', 'account'"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _matches(kind: int, pattern: str) -> str:
    return f"SELECT rid, {kind} AS kind, regexp_extract_all(text, '{_q(pattern)}') AS m, string_split_regex(text, '{_q(pattern)}') AS s FROM d"


SECRETS = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
raw AS ({_matches(0, _ASSIGN)} UNION ALL {_matches(1, _ACCESS)} UNION ALL {_matches(2, _HEX)} UNION ALL {_matches(3, _MORE)}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0),
f AS (SELECT rid, kind, m[i] AS val, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e),
g AS (SELECT rid, a, a + length(val) AS b, val, CASE WHEN kind < 3 THEN kind WHEN starts_with(val, '-----BEGIN') THEN 3 WHEN regexp_matches(val, '^(?i:bearer) ') THEN 7 WHEN starts_with(val, '://') THEN 8
   WHEN regexp_matches(val, '^(AccountKey|SharedAccessKey)=') THEN 9 WHEN contains(val, '.') THEN 4 WHEN regexp_matches(val, '^(gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza)') THEN 5 ELSE 6 END AS kind FROM f),
h AS (SELECT *, CASE kind WHEN 0 THEN regexp_extract(val, '{_q(_ASSIGN)}', 2) WHEN 3 THEN regexp_replace(val, '-----(?:BEGIN|END) [A-Z ]{{0,40}}PRIVATE KEY-----|[\x09-\x0D\x20]', '', 'g')
   WHEN 7 THEN regexp_extract(val, ' (.*)$', 1) WHEN 8 THEN regexp_extract(val, '^://[^:]*:(.*)@$', 1) WHEN 9 THEN regexp_extract(val, '^[A-Za-z]*=(.*)$', 1) ELSE val END AS secret
   FROM g WHERE kind IN (1, 2, 3, 8) OR (kind = 0 AND length(regexp_extract(val, '{_q(_ASSIGN)}', 2)) >= 8) OR (kind > 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]'))),
apart AS (SELECT * FROM h WHERE kind < 3 UNION ALL SELECT * FROM h x WHERE kind >= 3 AND NOT EXISTS (SELECT 1 FROM h y WHERE y.rid = x.rid AND y.kind < 3 AND x.a < y.b AND y.a < x.b)),
own AS (SELECT secret, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), doc_id)) AS repositories FROM apart JOIN d USING (rid) GROUP BY secret),
k AS (SELECT rid, kind, list_extract([{_KINDS}], kind + 1) || ':' || a || ':' || b AS said, a, b, owners, repositories,
   CASE WHEN owners >= 3 OR repositories >= 10 THEN 'copied' WHEN len(list_distinct(string_split(secret, ''))) >= 8 THEN 'live' ELSE 'weak' END AS verdict FROM apart JOIN own USING (secret)),
t AS (SELECT rid, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, string_agg(CASE WHEN kind < 3 THEN said END, ',' ORDER BY a, kind) AS base,
   string_agg(CASE WHEN kind < 3 OR verdict = 'live' THEN said END, ',' ORDER BY a, kind) AS spans, string_agg(said || ':' || verdict || ':' || owners || ':' || repositories, ',' ORDER BY a, kind, b) AS verdicts FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts FROM d LEFT JOIN t USING (rid)"""

_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_POINTS = "list_transform(string_split({}, ''), lambda x: unicode(x))"
SPELLING = f"""WITH RECURSIVE bits(k, i, c) AS (SELECT k, 0, CAST(k AS BIGINT) FROM range(256) t(k) UNION ALL SELECT k, i + 1, {_CRC_STEP} FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM bits WHERE i = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
said AS (SELECT run, n, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS p FROM runs WHERE length(run) >= 6),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(p, lambda x: CASE WHEN x < 128 THEN [x] ELSE [195, x - 64] END))), lambda a, b: xor(t[CAST(xor(a, b) & 255 AS INT) + 1], a >> 8))) AS h FROM said, crc),
results AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS k FROM v)),
pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word != b.word
 UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.rest = v.word UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.rest = v.word),
best AS (SELECT pairs.word, near, o.n AS near_n, count(*) OVER (PARTITION BY pairs.word) AS n_near, row_number() OVER (PARTITION BY pairs.word ORDER BY o.n DESC, encode(near)) AS place FROM pairs JOIN v o ON o.word = near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND place = 1),
chain(word, root) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON ends.word = f.word"""

ARCHIVES = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""


def _clusters(rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    far = "list_sum(list_transform(range(1, 65), lambda i: CAST((q.v[i] - c{0}.v[i]) * (q.v[i] - c{0}.v[i]) AS BIGINT)))"
    parts = [
        """q AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM q QUALIFY c < 16)",
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS (SELECT rid, vec_id, q.v, c, {far.format(k)} AS d FROM q, c{k} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if k < rounds:
            mean = f"SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(64)) AS i, unnest(v) AS x FROM a{k}) GROUP BY c, i"
            parts.append(f"m{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM ({mean}) GROUP BY c)")
            parts.append(f"c{k + 1} AS (SELECT c{k}.c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))")
    last = f"a{rounds} a JOIN c{rounds} z USING (c)"
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
 CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256 FROM {last}"""


ORACLES = {
    "op11_spelling_variants": SPELLING,
    "op12_warc_archives": ARCHIVES,
    "op13_centroid_clusters": _clusters(),
    "op1_chat_formatting": CHATS,
    "op5_secret_scan": SECRETS,
    "op8_minhash_near_dedup": NEAR_DUPLICATES,
    "op10_benchmark_decontamination": CONTAMINATION,
}
