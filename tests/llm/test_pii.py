import re

from hearthwave.llm import pii
from tests.llm.helpers import LONG, awkward, documents, empty


def _luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
]
TEXTS = [
    "a@b.c@d.e", "x a@b.co_x@d.ee y", "1.2.3.4.5.6.7.8 0001.02.3.4 1.2.3.400", "4111 1111 1111 1111", "4111-1111-1111-1111, 4111111111111112", "+1", "+12 +1 2", "+1 (234) 555-1234. ++1 2345678901 +1-",
    "é€😀 a.b+c@x-y.z.w 😀 1.1.1.1 tel +44 20 7946 0958", "9" * 9000, "a" * 20000 + "@" + "b" * 100, "mail me@x.org, +1 234567890 12 +1", LONG + " z@y.io", "@@@ a@.b c@d", "00000000000000",
]


def _plain(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_against_plain_patterns(spark):
    got = {r["doc_id"]: r for r in pii.report(documents(spark, list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        want = _plain(t)
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want), t[:50]
        assert [got[i][f"n_{k}"] for k, _, _ in BASE] == [sum(x[0] == k for x in want) for k, _, _ in BASE]


def test_account_numbers_need_their_checksum(spark):
    rows = [(1, "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "iban FR1420041010050500013M02606")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    assert got == {1: "iban:0:27,iban:32:54", 2: "", 3: "iban:5:32"}


def test_context_decides(spark):
    """Kinds that no checksum settles are kept only with a word nearby, a whole word, on either side."""
    rows = [
        (1, "my ssn is 123-45-6789"), (2, "part 123-45-6789 of it"), (3, "123-45-6789 (SSN)"), (4, "assn 123-45-6789"), (5, "ssn 000-12-3456, 666-12-3456, 123-00-4567"),
        (6, "routing number 021000021 here"), (7, "order 021000021 here"), (8, "routing number 021000022"), (9, "ssn " + "x" * 40 + " 123-45-6789"), (10, "SSN 123-45-6789-1 1123-45-6789"),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    assert got == {1: "ssn:10:21", 2: "", 3: "ssn:0:11", 4: "", 5: "", 6: "routing:15:24", 7: "", 8: "", 9: "", 10: ""}
    digest = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'token = "{digest}" x'), (2, f"sha1 {digest}"), (3, f"{digest.upper()} is the key"), (4, f"token {digest}g"), (5, "key " + "1" * 40)]
    assert {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()} == {1: "secret:9:49", 2: "", 3: "secret:0:40", 4: "", 5: ""}
    assert pii.redact(documents(spark, rows[:1])).first()["text"] == 'token = "[SECRET]" x'
    scores = {r["doc_id"]: r["scores"] for r in pii.report(documents(spark, [(1, "hotel +1 234567890"), (2, "tel +1 234567890"), (3, "ship 1.2.3.4"), (4, "1.2.3.4 is the ip")])).collect()}
    assert scores == {1: "0.6", 2: "0.85", 3: "0.6", 4: "0.85"}
    rows = [(1, "my ssn is 123-45-6789"), (2, "part 123-45-6789 of it")]
    out = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, rows)).collect()}
    assert out[1] == "my ssn is [SSN]" and out[2] == rows[1][1]


def test_redaction_of_overlapping_spans_and_wide_characters(spark):
    """Against a plain version: spans in order, those that overlap joined under the first one's name."""
    texts = ["é😀 +4111 1111 1111 1111 x", "+1.2.3.4567 89 😀 a@1.2.3.4.5", "1.2.3.4@x.org é", "tel +1 2345678901.2.3.4 €", "a@b.co,c@d.eu 😀1.1.1.1"]
    rows = list(enumerate(texts))
    docs = documents(spark, rows)
    spans = {r["doc_id"]: sorted((int(b), int(e), k) for k, b, e in (x.split(":") for x in r["spans"].split(","))) for r in pii.report(docs).collect()}
    for r in pii.redact(docs).collect():
        out, reach = "", 0
        for begin, end, kind in spans[r["doc_id"]]:
            if begin >= reach:
                out += texts[r["doc_id"]][reach:begin] + f"[{kind.upper()}]"
            reach = max(reach, end)
        assert r["text"] == out + texts[r["doc_id"]][reach:]


def test_a_text_of_many_spans_takes_its_share(spark):
    import time

    def seconds(n):
        docs = documents(spark, [(1, " ".join(f"é{i}a{i}@b{i}.org" for i in range(n)))])
        start = time.perf_counter()
        r, t = pii.report(docs).collect()[0], pii.redact(docs).collect()[0]["text"]
        assert r["n_email"] == n and t.count("[EMAIL]") == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 10 * seconds(10_000)


def test_redaction(spark):
    rows = [(1, "write to a@b.co or 1.2.3.4 now"), (2, "nothing"), (3, None), (4, "x@y.zz")]
    out = {r["doc_id"]: r for r in pii.redact(documents(spark, rows)).collect()}
    assert out[1]["text"] == "write to [EMAIL] or [IP] now" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "nothing" and out[3]["text"] is None and out[4]["text"] == "[EMAIL]"


def test_awkward_rows(spark):
    df = awkward(spark)
    assert pii.report(df).count() == df.count()
    assert pii.redact(df).columns == df.columns and pii.redact(df).count() == df.count()
    assert pii.report(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.report(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_card_with_no_two_digits_together(spark):
    texts = [" ".join("4" + "1" * 15), "pay with " + "-".join("4" + "1" * 15) + " today", " ".join("4" + "1" * 14 + "2")]
    docs = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["n_card"], r["spans"]) for r in pii.report(docs).collect()}
    assert got == {0: (1, "card:0:31"), 1: (1, "card:9:40"), 2: (0, "")}
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == {0: "[CARD]", 1: "pay with [CARD] today", 2: texts[2]}
