import hashlib
import re

from foliant.llm import pii as P
from foliant.llm.common import read_table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


CASES = [
    None, "", "a@b.cc_d@e.ff x", "1.2.3.4.5.6.7.8", "300.1.1.1 001.002.003.0255 1.2.3", "4111 1111 1111 1111-4111111111111111 4111111111111111", "+1 (826) 555-4081 190.137.223.204",
    "é é +49-30-1234567. x", "a." * 3000 + "@" + "b." * 3000 + "c", "1 " * 4000, "++12 3 45 6789", "x@y x@y.z.", "@@a@b.c@d.ee", "7" * 5000, "4111111111111111", "clean text, 12 words, nothing else",
]


def test_base_spans(spark):
    d = spark.createDataFrame([(i, t, "n") for i, t in enumerate(CASES)] + [(None, "q@r.st", "n"), (3, "1.1.1.1", "n")], "doc_id bigint, text string, spans string")
    rows = P.detect(d).collect()
    assert len(rows) == len(CASES) + 2
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(CASES):
        want = base(t)
        r = next(r for r in seen[i] if r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % x for x in want).encode()).hexdigest())
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in PLAIN)
        assert {"%s:%d:%d" % x for x in want} <= set(r.spans.split(","))
    assert seen[15][0].spans == ""


def test_whole_tables_match(spark, sf):
    docs = read_table(spark, sf, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in P.detect(docs).collect():
        want = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % x for x in want).encode()).hexdigest()


def test_neighbours_are_found(spark):
    card = "4111111111111111"
    rows = [(i, f"pay by card {card} now, call +1 (234) 555-1234") for i in range(30)] + [(99, f"two {card} {card} here"), (98, "bad 4111111111111112 4111111111111113")]
    got = {r.doc_id: r for r in P.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[99].n_card == 0 and got[99].spans == "card:4:20,card:21:37" and got[98].spans == ""


def test_redaction(spark):
    rows = [(1, "mail a@b.cd, é +49 30 1234567!", 30, "k"), (2, None, None, "k"), (3, "", 0, "k"), (4, "1.2.3.4", 7, "k")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, kind string")
    got = P.redacted(d)
    assert got.columns == d.columns
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "mail <EMAIL>, é <PHONE>!", 24, "k"), (2, None, None, "k"), (3, "", 0, "k"), (4, "<IP>", 4, "k")]


def test_empty_and_native(spark, sf):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    assert P.detect(d).count() == 0
    plan = P.found(read_table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_reliabilities_follow_agreement():
    rows = [("card", (1, 1, 1, 0, 1, 0), 90), ("card", (-1, -1, 0, 0, -1, -1), 90), ("card", (1, -1, 1, 0, 1, 0), 5)]
    post = P.reliabilities(rows)
    assert post[0] > 0.95 and post[1] < 0.05
    w = P.classifier(rows, post)
    score = lambda v: w[("card",)] + sum(w.get(("card", j, x), 0.0) for j, x in enumerate(v))
    assert score(rows[0][1]) > 0 > score(rows[1][1])
