"""DuckDB SQL for the corpus queries that SQL can express, written from their definitions."""

from __future__ import annotations

from . import chat, decontam, licenses


def op10_substring(width: int = 50) -> str:
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {width - 1}), ' ') AS s FROM d, unnest(range(1, len(w) - {width - 2})) t(i) WHERE len(w) >= {width}),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM win JOIN low USING (s) WHERE doc_id > low), unnest(range(i, i + {width})) t(p)),
each AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT e.doc_id, count(g.p) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.p) FILTER (g.p IS NULL), '') AS text FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def op9_embeddings(threshold: float = 0.98) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component AS component_id, vec_id = component AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def op5_chat() -> str:
    probe = "</s>[INST] ok [/INST]"
    stuffed = chat.ESCAPE[0]
    known = [(r, a, b) for r, a, b in chat.MARKS if r]
    marks = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, a, b in known) + f" ELSE {len(chat.MARKS[-1][1]) + len(chat.MARKS[-1][2])} END"
    names = ", ".join(f"'{r}'" for r, _, _ in known)
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{probe}' UNION ALL SELECT -1, 1, 'assistant', '{probe}'),
c AS (SELECT *, CASE WHEN role IN ({names}) THEN text ELSE replace(replace(role, '%', '%25'), chr(10), '%0A') || chr(10) || text END AS content FROM t),
f AS (SELECT *, {marks} + length(CASE WHEN regexp_matches(content, '{chat.CONTROL}') OR regexp_matches(content, '{chat.UNESCAPE[0]}') THEN regexp_replace(content, '{stuffed}', '\1\\\2\3', 'g') ELSE content END) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(chars) AS BIGINT) AS formatted_chars, true AS round_trip FROM f GROUP BY conv_id"""


def op3_licenses() -> str:
    """Every indexed word of a document is looked up; a key phrase counts only at its place."""
    texts = ", ".join(f"({i}, '{label}', '{' '.join(ws)}', [{', '.join(f'{{p: {k!r}, pl: {at}, n: {len(k.split())}}}' for k, at in keys)}])" for i, (label, ws, keys) in enumerate(licenses.READ))
    cases = " ".join("WHEN " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + f" THEN '{label}'" for p, label in licenses.PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, i, w[i] AS x, CASE {cases} END AS label FROM d, unnest(range(1, len(w) + 1)) u(i)),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list_distinct(list(label))) AS labels FROM e WHERE label IS NOT NULL GROUP BY doc_id),
templates(t, label, text, keys) AS (VALUES {texts}),
tw AS (SELECT t, i - 1 AS k, string_split(text, ' ')[i] AS x FROM templates, unnest(range(1, len(string_split(text, ' ')) + 1)) u(i)),
df AS (SELECT x, count(DISTINCT doc_id) AS df FROM (SELECT DISTINCT x FROM tw) LEFT JOIN e USING (x) GROUP BY x),
rare AS (SELECT t, x FROM (SELECT t, x, row_number() OVER (PARTITION BY t ORDER BY df, x) AS rn FROM (SELECT DISTINCT t, x FROM tw) JOIN df USING (x)) WHERE rn <= {licenses.INDEXED}),
size AS (SELECT t, count(*) AS size FROM rare GROUP BY t),
agreed AS (SELECT e.doc_id, tw.t, e.i - tw.k AS delta, count(DISTINCT e.x) AS n FROM e JOIN tw ON tw.x = e.x JOIN rare ON rare.t = tw.t AND rare.x = tw.x GROUP BY ALL),
cand AS (SELECT a.doc_id, a.delta, p.label, a.n / z.size AS share, d.w, p.keys FROM agreed a JOIN size z USING (t) JOIN templates p USING (t) JOIN d USING (doc_id) WHERE a.n >= least({licenses.AGREE}, z.size)),
found AS (SELECT doc_id, label, share FROM cand WHERE len(list_filter(keys, lambda k: delta + k.pl < 1 OR array_to_string(list_slice(w, delta + k.pl, delta + k.pl + k.n - 1), ' ') <> k.p)) = 0),
own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ',') AS labels, greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM d LEFT JOIN base b ON b.doc_id = d.doc_id LEFT JOIN own o ON o.doc_id = d.doc_id"""


def op1_decontamination() -> str:
    """Without seeds: all alignments with enough equal words are judged."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    enough = f"ceil(least({decontam.WINDOW}, n) * {decontam.SHARE} - 1e-9)"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {decontam.SHORTEST}),
dw AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) u(i)), bw AS (SELECT item_id, n, i, w[i] AS x FROM b, unnest(range(1, len(w) + 1)) u(i)),
pairs AS (SELECT doc_id, item_id, dw.i - bw.i AS delta FROM dw JOIN bw USING (x) GROUP BY doc_id, item_id, n, dw.i - bw.i HAVING count(*) >= {enough}),
m AS (SELECT p.doc_id, p.item_id, delta, b.w AS iw, list_transform(range(greatest(0, -delta), least(len(b.w), len(d.w) - delta)), lambda j: CASE WHEN b.w[j + 1] = d.w[j + delta + 1] THEN 1 ELSE 0 END) AS m FROM pairs p JOIN d USING (doc_id) JOIN b USING (item_id)),
t AS (SELECT *, least({decontam.WINDOW}, len(m)) AS win FROM m),
s AS (SELECT *, list_max(list_transform(range(1, len(m) - win + 2), lambda k: list_sum(list_slice(m, k, k + win - 1)))) AS top FROM t),
j AS (SELECT doc_id, item_id, top / win AS best FROM s WHERE (win >= {decontam.WINDOW} OR len(m) = len(iw)) AND top >= ceil(win * {decontam.SHARE} - 1e-9)),
g AS (SELECT doc_id, max(best) AS best, list_sort(list(DISTINCT item_id)) AS ids FROM j GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, ids IS NOT NULL AS contaminated, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, coalesce(array_to_string(ids, ','), '') AS items, round(best, 6) AS best FROM d LEFT JOIN g USING (doc_id)"""


def every() -> dict[str, str]:
    return {f.__name__: f() for f in (op1_decontamination, op3_licenses, op5_chat, op9_embeddings, op10_substring)}
