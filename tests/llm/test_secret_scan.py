"""Secret scans against plain Python, and the novelty of planted strings."""

import hashlib
import random
import re
import string

import duckdb
import pytest

from tastegrid.llm import secret_scan
from tests.llm.tables import LONG, documents

RNG = random.Random(7)
KEY40 = "".join(RNG.choices(string.ascii_letters + string.digits, k=40))
KEY20 = "".join(RNG.choices(string.ascii_uppercase + string.digits, k=20))
HEX40 = "".join(RNG.choices("0123456789abcdef", k=40))
CODE = 'def connect(host, service):\n    header = "Authorization: Bearer {}"\n    return service.open(host, header)\n'
NAMES = "The private key of the DatabaseConnectionRequest2 is in DatabaseConnectionRequest2 now.\n"

ROWS = [
    (1, f'é token = "{HEX40}" and more'),
    (2, ""),
    (3, None),
    (4, "api_key: short"),
    (5, f"API-key={KEY40} Apikey  :  '{KEY40}', PassWord='abcdefgh'"),
    (6, f"x AKIA{KEY20} AKIAshort AKIA"),
    (7, f"😀 {HEX40}{HEX40} {HEX40[:31]} {HEX40[:32]}G"),
    (8, CODE.format(KEY40)),
    (8, CODE.format(KEY40)),
    (8, "another text of this id"),
    (9, CODE.format("configuration_service_identifier")),
    (None, f"no id, secret={KEY40}"),
    (10, LONG + f" password: {KEY40} " + LONG + CODE.format(KEY20)),
    (11, "paſſword=abcdefgh1234 \N{KELVIN SIGN}ey toKen=abcdefgh1234"),
    (12, "token=abc=defgh secret: token: passwordpassword=12345678"),
    *[(100 + i, NAMES + CODE.format(f"name_of_a_service_{i}")) for i in range(30)],
]


def brute(text):
    """Base spans and novel ones, sign by sign and candidate by candidate."""
    found = []
    for m in re.finditer(
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)",
        text,
    ):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    for number, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
        found += [(m.start(), number, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def base_of(spans):
    return [s for s in spans if s["kind"] != "novel"]


@pytest.fixture(scope="module")
def scanned(spark):
    docs = documents(spark, ROWS, clashing=True)
    return [(r["doc_id"], r["spans"]) for r in secret_scan.scan(docs).collect()]


def test_base_spans_equal_brute_force(scanned):
    got = sorted((str(i), [(s["begin"], s["end"], s["kind"]) for s in base_of(spans)]) for i, spans in scanned)
    wanted = sorted((str(i), [(a, b, kind) for a, _, b, kind in brute(t or "")]) for i, t in ROWS)
    assert got == wanted
    kinds = {s["kind"] for _, spans in scanned for s in spans}
    assert kinds == set(secret_scan.KINDS)


def test_novel_strings_are_found_and_names_are_not(scanned):
    texts = dict((i, t) for i, t in ROWS if i not in (8, None))
    novel = {}
    for i, spans in scanned:
        for s in spans:
            if s["kind"] == "novel" and i in texts:
                novel.setdefault(i, []).append(texts[i][s["begin"] : s["end"]])
    assert novel == {10: [KEY20]}
    copies = [[s["kind"] for s in spans] for i, spans in scanned if i == 8]
    assert sorted(copies) == [[], ["novel"], ["novel"]]


def test_novel_spans_equal_every_window(spark):
    """The same candidates, looked for without the bookkeeping of the scan."""
    words = secret_scan.common_words(documents(spark, ROWS))
    assert b"service" in words and KEY40.encode() not in words
    cfg = secret_scan.SecretConfig()
    novelty = secret_scan._Novelty(words, cfg.level)
    for _, text in ROWS:
        text = text or ""
        known = secret_scan.base_spans(text)
        wanted = set()
        for word in re.finditer(secret_scan.SENSITIVE, text, re.ASCII | re.IGNORECASE):
            at = word.end()
            while at < min(len(text), word.end() + cfg.reach):
                m = re.compile(secret_scan.CANDIDATE).match(text, at)
                if m is None:
                    at += 1
                    continue
                begin, at = m.span()
                found = m[0]
                plain = not re.search("[0-9]", found) and (found.islower() or found.isupper() or found.istitle())
                if len(found) < cfg.min_chars or plain or any(a < at and begin < b for a, _, b in known):
                    continue
                added = novelty.added(text[max(0, begin - 256) : begin], found, text[at : at + 256])
                if added >= max(12, 0.8 * min(len(found), 32), 0.5 * len(found)):
                    wanted.add((begin, at))
        got = {(a, b) for a, _, b in secret_scan.novel_spans(text, known, novelty, cfg)}
        assert got <= wanted
        # A window that begins inside a string already seen gives no second span of it.
        assert all(any(a <= x and y <= b for a, b in got) for x, y in wanted)


def test_digests_and_no_rows(spark):
    made = secret_scan.digests(secret_scan.scan(documents(spark, ROWS))).collect()
    by_text = {r["doc_id"]: r for r in made if r["doc_id"] not in (8, None)}
    for i, text in ROWS:
        if i in (8, None):
            continue
        spans = brute(text or "")
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        row = by_text[i]
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in secret_scan.KINDS[:3]] == [
            sum(s[3] == k for s in spans) for k in secret_scan.KINDS[:3]
        ]
        left = [p for p in row["spans"].split(",") if p and not p.startswith("novel")]
        assert ",".join(left) == joined
    assert secret_scan.scan(documents(spark, [])).count() == 0


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k(kind, rank, pattern, least, chars) AS (VALUES
    ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8, 2),
    ('access', 1, 'AKIA[A-Z0-9]+', 16, 0), ('hex', 2, '[0-9a-f]+', 32, 0)),
p AS (SELECT doc_id, kind, rank, least, chars, pattern, regexp_extract_all(t, pattern) AS m,
             string_split_regex(t, pattern) AS s FROM d, k),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p),
f AS (SELECT doc_id, kind, rank, least,
             list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a,
             length(m[i]) AS n,
             length(CASE WHEN chars = 2 THEN regexp_extract(m[i], '^' || pattern, 2) ELSE m[i] END) AS inner_n
      FROM e)
SELECT d.doc_id, coalesce(string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, rank)
       FILTER (WHERE inner_n >= least), '') AS base
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


def test_base_spans_equal_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    wanted = dict(con.sql(BASE_SQL).fetchall())
    rows = secret_scan.digests(secret_scan.scan(spark.read.parquet(path))).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in rows} == {
        i: hashlib.sha256(base.encode()).hexdigest() for i, base in wanted.items()
    }
    assert sum(r["n_hex"] for r in rows) > 0
