"""SQL for DuckDB that answers the registered queries by plainer means, where SQL can express them.

The others are trained (6), number freely (4), or work byte by byte or on trees and tokens (1, 5, 9); tests hold those
against brute force.
"""

from __future__ import annotations

from panelytics.llm.personal_data import CONTEXTS, GENERALISED, REMOVED, WINDOW
from panelytics.llm.secret_scans import MANY_REPOSITORIES, WIDELY_COPIED
from panelytics.llm.url_filters import LISTED_HOSTS, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

DECONTAMINATION = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
),
item AS (
  SELECT item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
),
item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS part
  FROM (SELECT *, least(10, len(w)) AS n FROM item WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(i)
),
doc_window AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS part
  FROM doc, (SELECT DISTINCT n FROM item_window), unnest(range(1, len(w) - n + 2)) AS t(i)
),
hit AS (SELECT doc_id, i, n, item_id FROM doc_window JOIN item_window USING (n, part)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids
  FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM doc, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS t(i)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_have AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
),
link AS (
  SELECT x, y FROM both_have JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id
  WHERE 100 * both_have.n >= 80 * (p.n + q.n - both_have.n)
),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
part AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM part LEFT JOIN sizes USING (doc_id)"""

# kind, pattern, group of the secret, its least length, what differs between copies of one secret
_BODY = r"\x09-\x0D\x20\\\"'>#*|,;A-Za-z0-9+/="
_PEM_HEAD = r"(?:[\x09-\x0D\x20\\\"'>#*|,;nrt]*Proc-Type:\x20*[0-9],ENCRYPTED[\x09-\x0D\x20\\\"'>#*|,;nrt]*DEK-Info:\x20*[A-Za-z0-9-]+,[0-9A-Fa-f]+)?"
_SECRET_KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, None),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, None),
    ("hex", r"[0-9a-f]+", 0, 24, None),
    (
        "issued",
        r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}"
        r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})",
        0,
        20,
        None,
    ),
    (
        "pem",
        rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{_PEM_HEAD}[{_BODY}.:]*-----END [A-Z ]{{0,40}}PRIVATE KEY-----"
        rf"|{_PEM_HEAD}[{_BODY}]*[A-Za-z0-9+/]{{16,}}={{0,2}}(?:(?:\r?\n|\\n)[\x20\x09]*[A-Za-z0-9+/]+={{0,2}})?)?",
        0,
        20,
        r"-----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----|Proc-Type:\x20*[0-9],ENCRYPTED|DEK-Info:\x20*[A-Za-z0-9-]+,[0-9A-Fa-f]+"
        r"|\\[nrt]|[\"'][\s+.]*[\"']|[^A-Za-z0-9+/=]",
    ),
)
_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, source, {i} AS kind_no, '{kind}' AS kind, {least} AS least,
    regexp_extract_all(coalesce(text, ''), {quoted(pattern)}) AS whole,
    regexp_extract_all(coalesce(text, ''), {quoted(pattern)}, {group}) AS secret,
    string_split_regex(coalesce(text, ''), {quoted(pattern)}) AS gap FROM documents"""
    for i, (kind, pattern, group, least, noise) in enumerate(_SECRET_KINDS)
)
_BASE = 3
_VALUES = " UNION ALL ".join(
    f"""SELECT *, {f"coalesce(nullif(regexp_replace(secret, {quoted(noise)}, '', 'g'), ''), secret)" if noise else "secret"} AS value
    FROM span WHERE kind_no = {i} AND length(secret) >= least"""
    for i, (_, _, _, _, noise) in enumerate(_SECRET_KINDS)
)
SECRETS = f"""
WITH found AS ({_FOUND}),
span AS (
  SELECT doc_id, source, kind_no, kind, least, secret[i] AS secret,
    list_sum([length(g) FOR g IN gap[1 : i]]) + coalesce(list_sum([length(g) FOR g IN whole[1 : i - 1]]), 0) AS s,
    length(whole[i]) AS size
  FROM found, unnest(range(1, len(whole) + 1)) AS t(i)
),
kept AS (SELECT *, concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + size AS BIGINT)) AS named FROM ({_VALUES})),
owners AS (
  SELECT value, count(DISTINCT coalesce(source, '')) AS n,
    count(DISTINCT (coalesce(source, ''), coalesce(CAST(doc_id AS VARCHAR), ''))) AS places
  FROM kept GROUP BY value
),
told AS (SELECT value, n >= {WIDELY_COPIED} OR n >= 2 AND places >= {MANY_REPOSITORIES} AS copied FROM owners),
each AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
    count(*) FILTER (kind_no = 2) AS n_hex,
    string_agg(named, ',' ORDER BY s, kind_no) FILTER (kind_no < {_BASE}) AS base,
    string_agg(named, ',' ORDER BY s, kind_no) AS spans,
    count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_example
  FROM kept JOIN told USING (value) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN each USING (doc_id)"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
part AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM part LEFT JOIN counts USING (vec_id)"""

URLS = f"""
WITH split AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
),
rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
listed(h) AS (VALUES {", ".join(f"('{h}')" for h in LISTED_HOSTS)}),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS place
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
),
blocked AS (SELECT DISTINCT page_id FROM split JOIN listed ON host = h OR ends_with(host, '.' || h))
SELECT split.page_id, host, path, rule, coalesce(v, CASE WHEN blocked.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM split LEFT JOIN fits ON fits.page_id = split.page_id AND place = 1 LEFT JOIN blocked ON blocked.page_id = split.page_id"""

# CRC-32 in SQL: the table by its rule, then a step for each byte of an ASCII text.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
)"""


def _crc(text: str) -> str:
    step = "xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split({text}, '')], lambda c, b: {step}), 4294967295)"


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


_LOWERED_TEXT = f"translate(text, '{UPPER}', '{LOWER}')"
_LEAF = " || ".join(_field(name) for name in ("doc_id", "source", "lang", "n_chars"))
#: One level up in each tree (column g) with more than one node.
_CLIMB = "SELECT g, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {0} WHERE n > 1 GROUP BY g, lvl, pos // 8, n"
_FLANKED = """SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {0} a JOIN {0} b ON a.g IS NOT DISTINCT FROM b.g AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.g, a.lvl, a.pos"""
MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
    SELECT doc_id, lang, sha256({_LEAF} || {_field("text")}) AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0
      THEN sha256({_LEAF} || {_field(_LOWERED_TEXT)}) ELSE sha256({_LEAF} || {_field("text")}) END AS changed
    FROM documents, crc_table
  )
),
tree(g, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM leaves UNION ALL {_CLIMB.format("tree")}
),
over(g, lvl, pos, h, n) AS (
  SELECT 0, 0, row_number() OVER (ORDER BY g NULLS FIRST) - 1, h, count(*) OVER () FROM tree WHERE n = 1
  UNION ALL {_CLIMB.format("over")}
),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place FROM tree WHERE n = 1),
below AS ({_FLANKED.format("tree")}),
above AS ({_FLANKED.format("over")}),
steps AS (
  SELECT lang, leaves.pos, lvl, l, r FROM leaves JOIN below
  ON leaves.lang IS NOT DISTINCT FROM below.g AND CAST(leaves.pos // CAST(8 ** lvl AS BIGINT) AS BIGINT) = below.pos
  UNION ALL
  SELECT lang, leaves.pos, 1000 + lvl, l, r FROM leaves JOIN subroots ON leaves.lang IS NOT DISTINCT FROM subroots.g
  JOIN above ON place // CAST(8 ** lvl AS BIGINT) = above.pos
),
walk AS (
  SELECT lang, pos, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '*' || r ORDER BY lvl) AS up FROM steps GROUP BY lang, pos
),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM over WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce([changed] || coalesce(up, []), lambda h, x: sha256(replace(x, '*', h))) AS folded_root
  FROM leaves JOIN subroots ON leaves.lang IS NOT DISTINCT FROM subroots.g
  LEFT JOIN walk ON leaves.lang IS NOT DISTINCT FROM walk.lang AND leaves.pos = walk.pos
)
SELECT *, folded_root = root AS verified FROM done"""

_VALUES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "lower(m)", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "m", "list_max([CAST(p AS HUGEINT) FOR p IN string_split(m, '.')]) <= 255"),
    (
        "card",
        r"[0-9](?:[\x20-]?[0-9])+",
        "digits",
        """len(digits) BETWEEN 12 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INT)
          ELSE 2 * CAST(digits[-i] AS INT) - CASE WHEN digits[-i] >= '5' THEN 9 ELSE 0 END END
          FOR i IN range(1, len(digits) + 1)]) % 10 = 0""",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "digits", "len(digits) BETWEEN 9 AND 15"),
)


def _matches(texts: str, pattern: str, shown: str = "text") -> str:
    """(doc_id, m, s, e): each match and its place, added up from the pieces between matches."""
    return f"""SELECT doc_id, whole[i] AS m, s, s + length(whole[i]) AS e FROM (
      SELECT doc_id, whole, i, CAST(list_sum([length(x) FOR x IN gap[1 : i]]) + coalesce(list_sum([length(x) FOR x IN whole[1 : i - 1]]), 0) AS BIGINT) AS s
      FROM (SELECT doc_id, regexp_extract_all({shown}, {quoted(pattern)}) AS whole, string_split_regex({shown}, {quoted(pattern)}) AS gap FROM {texts}),
      unnest(range(1, len(whole) + 1)) AS t(i))"""


_KNOWN = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS kind_no, '{name}' AS kind, s, e, {value} AS value
    FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM ({_matches("given", pattern)})) WHERE {condition}"""
    for i, (name, pattern, value, condition) in enumerate(_VALUES)
)
PERSONAL = f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text, {LOWERED} AS low FROM documents),
known AS ({_KNOWN}),
word AS ({_matches("given", "[^\\x00-\\x60\\x7B-\\x7F]+", "low")}),
holds AS (SELECT m AS term, count(DISTINCT doc_id) AS n_documents FROM word GROUP BY m),
free AS (
  SELECT doc_id, list({{'m': m, 's': s, 'e': e}} ORDER BY s) AS words FROM word WHERE doc_id IN (SELECT doc_id FROM known)
  AND NOT EXISTS (SELECT 1 FROM known WHERE known.doc_id = word.doc_id AND word.s < known.e AND known.s < word.e) GROUP BY doc_id
),
around AS (
  SELECT doc_id, kind, value, list_filter(words, lambda w: w.e <= known.s)[-{WINDOW}:] || list_filter(words, lambda w: w.s >= known.e)[1 : {WINDOW}] AS words
  FROM known JOIN free USING (doc_id)
),
near AS (
  SELECT doc_id, kind, value, w.m AS term, w.s AS s, w.e AS e, context
  FROM (SELECT *, array_to_string([x.m FOR x IN words], ' ') AS context FROM around), unnest(words) AS t(w)
),
n_values AS (SELECT kind, value, count(DISTINCT doc_id) AS n_entity FROM known GROUP BY kind, value),
pairs AS (
  SELECT kind, value, term, count(DISTINCT doc_id) AS n_both FROM near GROUP BY kind, value, term
  HAVING count(DISTINCT context) >= {CONTEXTS}
),
shares AS (
  SELECT kind, value, term, 1 + log2(n_both / n_documents) / nullif(log2((SELECT count(*) FROM documents) / n_entity), 0) AS share
  FROM pairs JOIN n_values USING (kind, value) JOIN holds USING (term)
),
marked AS (
  SELECT doc_id, s, e, max(share) AS share FROM near JOIN shares USING (kind, value, term) WHERE share >= {GENERALISED} GROUP BY doc_id, s, e
),
spans AS (
  SELECT doc_id, kind_no, kind, s, e FROM known
  UNION ALL SELECT doc_id, CASE WHEN share >= {REMOVED} THEN 5 ELSE 4 END, CASE WHEN share >= {REMOVED} THEN 'removed' ELSE 'general' END, s, e FROM marked
),
each AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind_no = {i}) AS n_{name}" for i, name in enumerate(("email", "ip", "card", "phone", "general", "removed")))},
    string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, kind_no, e) FILTER (kind_no < 4) AS base,
    string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, kind_no, e) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in ("email", "ip", "card", "phone", "general", "removed"))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN each USING (doc_id)"""

# The cheapest repair as a walk over the turns that keeps, for each place in the grammar (0 start, 1 system, 2 user,
# 3 assistant), the cheapest edits so far and of those the least; up to two insertions come before a turn or the end.
REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS lot
  FROM conversations, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, copy,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM lots, unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS initial FROM damaged
),
faulty AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal,
    CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM ordered
),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY conv_id
),
follows(a, b) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
inserted(a, b, edits) AS (
  SELECT p, p, '' FROM range(4) AS r(p) UNION ALL SELECT a, b, 'I' FROM follows
  UNION ALL SELECT f.a, g.b, 'II' FROM follows f JOIN follows g ON f.b = g.a
),
states AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS place, 0::BIGINT AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, i, place, best.cost, best.audit FROM (
    SELECT conv_id, i, place, min(struct_pack(cost := cost, audit := audit)) AS best FROM (
      SELECT s.conv_id, f.i, e.place, s.cost + 2 * length(edits) + e.cost AS cost, s.audit || edits || e.edit AS audit
      FROM states s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
      JOIN inserted ON inserted.a = s.place,
      LATERAL (
        SELECT 'D' AS edit, 3 AS cost, inserted.b AS place
        UNION ALL SELECT 'K', CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END,
          CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
          WHERE fault NOT IN ('blank', 'duplicate') AND (initial = 's' AND inserted.b = 0 OR initial = 'u' AND inserted.b <> 2 OR initial = 'a' AND inserted.b = 2)
        UNION ALL SELECT 'R', 2 + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, CASE WHEN inserted.b = 2 THEN 3 ELSE 2 END
          WHERE fault NOT IN ('blank', 'duplicate')
      ) AS e
    ) GROUP BY conv_id, i, place
  )
),
audits AS (
  SELECT conv_id, min(struct_pack(cost := cost + 2 * length(edits), audit := audit || edits)) AS best
  FROM states JOIN counts USING (conv_id) JOIN inserted ON inserted.a = place AND inserted.b IN (0, 3) WHERE i = n GROUP BY conv_id
),
edits AS (
  SELECT conv_id, k, best.audit[k] AS edit, length(replace(best.audit[1 : k], 'I', '')) AS i,
    length(replace(best.audit, 'D', '')) % 2 AS has_system, length(replace(best.audit[1 : k], 'D', '')) AS made
  FROM audits, unnest(range(1, length(best.audit) + 1)) AS t(k)
),
repaired AS (
  SELECT edits.conv_id, string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (made - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END,
    chr(10) ORDER BY k) AS text
  FROM edits LEFT JOIN faulty ON edits.conv_id IS NOT DISTINCT FROM faulty.conv_id AND edits.i = faulty.i WHERE edit <> 'D' GROUP BY edits.conv_id
)
SELECT o.conv_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(repaired.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN audits ON o.conv_id IS NOT DISTINCT FROM audits.conv_id
LEFT JOIN repaired ON o.conv_id IS NOT DISTINCT FROM repaired.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": DECONTAMINATION,
        "op3_near_duplicates": NEAR_DUPLICATES,
        "op7_secret_scans": SECRETS,
        "op8_near_vectors": NEAR_VECTORS,
        "op10_url_filters": URLS,
        "op11_merkle_manifest": MANIFEST,
        "op12_personal_data": PERSONAL,
        "op13_conversation_repair": REPAIR,
    }
