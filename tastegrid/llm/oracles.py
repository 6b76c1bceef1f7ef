"""DuckDB counterparts of the queries of this folder, where SQL can express them."""

from tastegrid.llm.licenses import TEMPLATES


def _words(text: str) -> str:
    """SQL for the normalised words of a text."""
    plain = rf"regexp_replace({text}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')"
    lowered = f"translate({plain}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split({lowered}, ' '), lambda w: w <> '')"


# SQL for the distinct bigrams of the words w.
_GRAMS = """CASE WHEN len(w) > 1 THEN list_distinct(list_transform(
    range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END"""

_TEMPLATE_ROWS = ", ".join(
    "('" + name.replace("'", "''") + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES.items()
)

ORACLES: dict[str, str] = {
    "op2_licenses": f"""
WITH v AS MATERIALIZED (SELECT name, {_words("text")} AS w FROM (VALUES {_TEMPLATE_ROWS}) v(name, text)),
t AS MATERIALIZED (SELECT name, {_GRAMS} AS g FROM v),
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
units AS (
    SELECT doc_id, -1 AS line, text AS unit FROM lines WHERE len(l) > 1
    UNION ALL
    SELECT doc_id, (unnest(range(len(l))))::INTEGER AS line, unnest(l) AS unit FROM lines
), split AS MATERIALIZED (SELECT doc_id, line, {_words("unit")} AS w FROM units),
grams AS MATERIALIZED (SELECT doc_id, line, {_GRAMS} AS g FROM split),
scored AS (
    SELECT doc_id, line, name AS license,
           2.0::DOUBLE * len(list_intersect(grams.g, t.g)) / (len(grams.g) + len(t.g)) AS dice
    FROM grams JOIN t ON len(grams.g) BETWEEN len(t.g) * 0.6 AND len(t.g) * 1.6
    WHERE len(grams.g) > 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) AS r
    FROM scored WHERE dice >= 0.8
)
SELECT doc_id, line, license, dice FROM ranked WHERE r = 1
""",
    "op4_url_filter": r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), fits AS (
    SELECT p.page_id, r.host || r.path AS rule, r.verdict,
           row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
    FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1
""",
    "op1_near_dup": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
        range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
    FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sets
    UNION
    SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sets s JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, s.s
""",
    "op3_mixing": r"""
WITH RECURSIVE weights(name, w) AS (
    VALUES ('src0', 0.10::DOUBLE), ('src1', 0.10), ('src2', 0.08), ('src3', 0.06), (NULL, 0.66)
), docs AS (
    SELECT doc_id, source, length(text) AS chars,
           CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source END AS name,
           ('0x' || substr(md5(concat_ws(':', 'mix:1', doc_id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM documents
), sizes AS (SELECT name, sum(chars) AS size FROM docs GROUP BY name),
means AS (
    SELECT w.name, w.w / (SELECT 0.10::DOUBLE + 0.10 + 0.08 + 0.06 + 0.66)
           * (SELECT sum(size) FROM sizes)::DOUBLE / s.size::DOUBLE AS m
    FROM weights w JOIN sizes s ON w.name IS NOT DISTINCT FROM s.name
), steps AS (
    SELECT name, m, 0 AS k, exp(-m) AS term, exp(-m) AS cdf FROM means
    UNION ALL
    SELECT name, m, k + 1, term * m / (k + 1), cdf + term * m / (k + 1) FROM steps WHERE k < 60
), taken AS (
    SELECT d.doc_id, d.source,
           unnest(range((SELECT count(*) FROM steps s WHERE s.name IS NOT DISTINCT FROM d.name AND s.cdf <= d.u)
           ::BIGINT)) AS copy
    FROM docs d
)
SELECT doc_id, source, copy, row_number() OVER (
    ORDER BY md5(concat_ws(':', 'shuffle:1', doc_id, copy)), doc_id, copy) - 1 AS position
FROM taken
""",
    "op5_chat": r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
    SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) AS text_chars,
           length(replace(replace(replace(replace(replace(
               role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n')) AS role_chars
    FROM c
), t AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS trained,
           sum(4 + role_chars + 2 + text_chars + 9)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars,
       sha256(trained) AS loss_sha256, formatted_chars
FROM t
""",
    "op7_topk": r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 20
""",
    "op10_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""",
    "op11_fim": r"""
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), tokens AS (
    SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
           ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
           ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4
    FROM h
), cuts AS (
    SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
           greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
                THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM tokens
), parts AS (
    SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle,
           array_to_string(w[b + 1:], '') AS suffix
    FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""",
    "op13_spelling": r"""
WITH RECURSIVE bits(byte, c, k) AS (
    SELECT b, b, 0 FROM range(256) r(b)
    UNION ALL
    SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
), per_doc AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS MATERIALIZED (
    SELECT run, per_doc.n AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END))),
        lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])), 4294967295) AS h
    FROM per_doc, crc
), made AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                ELSE run END AS word, n
    FROM hashed
), words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
shorter AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS less FROM cut),
masked AS (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM cut),
pairs AS MATERIALIZED (
    SELECT a.word, b.word AS near, b.n AS near_n FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word
    UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.less = w.word
    UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.less = w.word
), best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word
), first AS (
    SELECT b.word, b.n_near, b.most, min(p.near) AS near FROM best b JOIN pairs p ON b.word = p.word AND p.near_n = b.most
    GROUP BY ALL
), forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.most >= 2 * w.n THEN f.near END AS form,
           CASE WHEN f.most >= 2 * w.n THEN f.most END AS form_n
    FROM words w LEFT JOIN first f ON w.word = f.word
), walk(word, place, k) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL
    SELECT walk.word, forms.form, k + 1 FROM walk JOIN forms ON walk.place = forms.word WHERE forms.form IS NOT NULL
)
SELECT f.word, f.form, max_by(walk.place, walk.k) AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON f.word = walk.word GROUP BY f.word, f.form, f.n, f.n_near, f.form_n
""",
}
