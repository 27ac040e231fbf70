"""DuckDB SQL of the registered queries that SQL can express.

Positions of matches: ``regexp_extract_all`` gives the matches, ``string_split_regex`` what lies between, and a running
sum of their lengths the code points.  Queries with a trained model, an iterative search or a hash that DuckDB lacks
(2, 3, 4, 5, 7, 10, 12) have none and are tested against brute force.
"""
from __future__ import annotations


def _spans(source: str, pattern: str, kind: str, rank: int) -> str:
    """(doc_id, s, e, kind, rank, value) of the matches of ``pattern`` in ``source`` (doc_id, text)."""
    return f"""SELECT doc_id, ends[i] - length(m[i]) AS s, ends[i] AS e, '{kind}' AS kind, {rank} AS rank, m[i] AS value FROM (
  SELECT doc_id, m, list_transform(range(1, len(m) + 1), lambda k: list_sum(list_transform(m[1:k], lambda x: length(x))) + list_sum(list_transform(g[1:k], lambda x: length(x))))::BIGINT[] AS ends,
    unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {source} WHERE regexp_matches(text, '{pattern}')))"""


_ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def _windows(width: int) -> str:
    return f"list_transform(range(1, len(c) - {width} + 2), lambda i: list_aggregate(c[i:i + {width - 1}], 'entropy'))"


# Repeated characters, spelled out (no back references here), and placeholders.
_MASKED = ("|".join(("\\" + x if x in "+/=-" else x) + "{8,}" for x in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-")
           + "|(?i:example|sample|placeholder|changeme|your[_-]|0123456789|abcdefgh)")


def _parts(source: str, pattern: str, kind: str, rank: int, but: str) -> str:
    """What the masked parts leave of the runs that are worth a look."""
    allowed = "^[A-Za-z]?[a-z]+$|^[A-Z]+$|^[0-9]+$|^([A-Za-z]+[/_-]+)+[A-Za-z]*$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    return f"""SELECT doc_id, s + coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, kind, rank, g[i] AS value FROM (
  SELECT *, unnest(range(1, len(g) + 1)) AS i FROM (SELECT *, regexp_extract_all(value, '{_MASKED}') AS m, string_split_regex(value, '{_MASKED}') AS g FROM ({_spans(source, pattern, kind, rank)})
    WHERE NOT regexp_matches(value, '{allowed}') {but}))"""


def _entropy(source: str, width: int, bits: float, fold: str) -> str:
    """Parts of a class, cut to the windows of high entropy."""
    return f"""SELECT doc_id, s + list_min(good) - 1 AS s, s + list_max(good) - 1 + {width} AS e, kind, rank, value FROM (
  SELECT *, list_filter(range(1, len(h) + 1), lambda i: h[i] >= {bits}) AS good FROM (SELECT *, {_windows(width)} AS h FROM (
    SELECT *, string_split({fold}, '') AS c FROM {source} r WHERE length(value) >= {width}
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND b.e >= r.s + length(r.value)))))
WHERE len(good) > 0"""


def _op1() -> str:
    base = "\nUNION ALL ".join([f"SELECT doc_id, s, e, kind, rank, value FROM ({_spans('t', _ASSIGN, 'assign', 0)}) WHERE length(regexp_extract(value, '{_ASSIGN}', 2)) >= 6",
                                f"SELECT * FROM ({_spans('t', 'AKIA[A-Z0-9]+', 'access', 1)}) WHERE length(value) >= 20",
                                f"SELECT * FROM ({_spans('t', '[0-9a-f]{24,}', 'hex', 2)}) WHERE length(value) >= 24"])
    hexes = _parts("t", "[0-9a-fA-F]{20,}", "entropy_hex", 3, "")
    mixed = _parts("t", "[A-Za-z0-9+/_=-]{24,}", "entropy_base64", 4, "AND NOT regexp_matches(value, '^[0-9a-fA-F]+$')")
    told = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e), '')"
    return f"""WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({base}),
hexes AS MATERIALIZED ({hexes}),
mixed AS MATERIALIZED ({mixed}),
added AS MATERIALIZED ({_entropy("hexes", 20, 3.0, "lower(value)")} UNION ALL {_entropy("mixed", 24, 4.0, "value")}),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {told} AS told FROM base GROUP BY doc_id),
a AS (SELECT doc_id, count(*) FILTER (rank > 2) AS n_entropy, {told} AS told FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.told, '')) AS base_sha256,
  coalesce(a.told, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


def _op6() -> str:
    heads = {"<": r"\|turn\|>|\|text\|>|\|more\|>|\|end\|>|s>|/s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|<SYS>>|</SYS>>", r"\[": r"INST\]|/INST\]"}
    control = "|".join(f"{h}~*({t})" for h, t in heads.items())
    size = "(length({0}) + len(regexp_extract_all({0}, '" + control + "')))"
    return f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
seen AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({size.format('text')} + CASE WHEN role = before THEN 8 ELSE {size.format('role')} + 8 + 8 + 7 END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id"""


def _op8() -> str:
    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def case(value) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'" for v, h, p in longest) + " END"
    return f"""WITH u AS (SELECT page_id, url, {host} AS host, {path} AS path FROM pages),
c AS (SELECT *, CASE WHEN bare <> '' THEN bare || regexp_replace(regexp_replace(path, '(index\\.html?|\\.html?)$', ''), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END END AS canonical FROM (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\\.', '') AS bare,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_.*|ref|fbclid|gclid)(=.*)?$')) AS kept FROM u)),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\\.)spam') AND canonical IS NOT NULL),
j AS (SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS ruled, canonical IN (SELECT canonical FROM listed) AND canonical IS NOT NULL AS hit FROM c)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict, ruled IS NULL AND hit AS listed FROM j"""


def _op9() -> str:
    def record(body: str) -> str:
        return ("('WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Target-URI: ' || coalesce(url, '') || nl || 'Content-Length: ' || octet_length(encode(" + body
                + ")) || nl || nl || " + body + " || nl || nl)")

    def tree(name: str, leaf: str) -> str:
        out = [f"{name}0 AS MATERIALIZED (SELECT file, pos AS place, {leaf} AS digest FROM placed WHERE {leaf} IS NOT NULL)"]
        for level, step in enumerate((65536, 256, 256, 256), 1):
            out.append(f"{name}{level} AS (SELECT file, place // {step} AS place, sha256(string_agg(place || ':' || digest, ',' ORDER BY place)) AS digest FROM {name}{level - 1} GROUP BY ALL)".replace("GROUP BY ALL", f"GROUP BY file, place // {step}"))
        return ",\n".join(out)
    return f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, chr(13) || chr(10) AS nl FROM pages),
w AS (SELECT *, sha256({record('body')}) AS leaf, octet_length(encode({record('body')})) AS size FROM p),
d AS MATERIALIZED (SELECT page_id, leaf, min(size) AS size, min(CASE leaf[9:10] WHEN 'c3' THEN sha256({record("('~' || body[2:])")}) WHEN 'd5' THEN sha256({record("left(body, length(body) // 2)")})
  WHEN 'e7' THEN NULL ELSE leaf END) AS hurt, unnest(range(0, count(*))) AS copy FROM w GROUP BY page_id, leaf),
f AS (SELECT *, ('0x' || sha256(coalesce(page_id::VARCHAR, '') || ':' || leaf || CASE WHEN copy > 0 THEN ':' || copy ELSE '' END)[1:8])::BIGINT % greatest(1, (SELECT (count(*) + 255) // 256 FROM d)) AS file FROM d),
placed AS MATERIALIZED (SELECT *, (sum(size) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, leaf, copy) - size)::BIGINT AS pos FROM f),
{tree('a', 'leaf')},
{tree('b', 'hurt')},
bad AS (SELECT file, count(*) AS n_bad, string_agg(pos || ':' || CASE WHEN hurt IS NULL THEN 'missing' ELSE 'changed' END, ',' ORDER BY pos) AS bad FROM placed WHERE hurt IS DISTINCT FROM leaf GROUP BY file),
n AS (SELECT file, count(*) AS records FROM placed GROUP BY file)
SELECT n.file, records, a4.digest AS first_root, b4.digest AS second_root, coalesce(n_bad, 0) AS n_bad, coalesce(bad, '') AS bad
FROM n JOIN a4 ON a4.file = n.file LEFT JOIN b4 ON b4.file = n.file LEFT JOIN bad ON bad.file = n.file"""


def _op11() -> str:
    return """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, left(t, lo) AS prefix, substr(t, lo + 1, hi - lo) AS middle, substr(t, hi + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def _op13() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH asked AS MATERIALIZED (SELECT DISTINCT item_id, text FROM benchmark),
want AS MATERIALIZED (SELECT DISTINCT item_id, text, unnest(regexp_extract_all({lowered.format("text")}, '{term}')) AS term FROM asked),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered.format("text")}, '{term}') AS terms FROM documents WHERE text IS NOT NULL),
c AS MATERIALIZED (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
o AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM o GROUP BY term) CROSS JOIN c),
m AS MATERIALIZED (SELECT r, doc_id, 50 + ((50 * len(terms)::BIGINT * docs) // total) AS m FROM d CROSS JOIN c WHERE len(terms) > 0),
s AS (SELECT q.item_id, q.text, m.r, m.doc_id, sum(w.w * ((1000000000 * o.tf) // (1000 * o.tf + 20 * m.m)))::BIGINT AS score
  FROM want q JOIN o ON o.term = q.term JOIN w ON w.term = o.term JOIN m ON m.r = o.r GROUP BY q.item_id, q.text, m.r, m.doc_id),
k AS (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""


SQL: dict[str, str] = {"op1_secret_scan": _op1(), "op6_chat_format": _op6(), "op8_url_filter": _op8(), "op9_warc_fixity": _op9(),
                       "op11_fill_in_middle": _op11(), "op13_best_positions": _op13()}
