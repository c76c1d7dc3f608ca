"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is column expressions. Each pattern cuts the text into the pieces between its matches and the matches
themselves, from whose lengths the positions follow, summed in blocks so that a text of many spans takes no more than
its share. The patterns are the plain ones written so that Java's matcher does not go back over what it has read: a
run of member characters is always taken whole, which is where a greedy match would end too.

Kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn) and phone (9 to 15 digits) are the base and
always stay. The method adds iban (two letters, two digits and 11 to 30 further ones, in groups or not, that leave 1
on division by 97), ssn (three, two and four digits with dashes, of an area and group that are given out), routing
(nine digits whose weighted sum ends in 0) and secret (32 to 128 hexadecimal digits). Every span has a score: what its kind is worth, more if a checksum
confirms it or a context word stands within 40 characters before or after it, up to the next match of the pattern.
Added spans are kept from ``least_score`` upward: an iban by its checksum, an ssn, a routing number or a secret only
if a context word speaks for it.

Defined cases: a null text counts as empty, an empty text has no spans; repeated rows get equal results.
Spans of different kinds may overlap; redaction joins such spans and names the first.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import fresh

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"[0-9]++(?:-[0-9]++)*+"
ROUTING = r"[0-9]++"
SECRET = r"[0-9A-Za-z]{32,}+"
#: Words that raise the score of a kind's span when they stand before or after it.
CONTEXT = {
    "email": "mail|email|e-mail|contact|adresse|correo|courriel",
    "ip": "ip|host|server|address|servidor|serveur",
    "card": "card|visa|credit|carte|karte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|telefon|telephone|llame",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|security number|taxpayer",
    "routing": "routing|aba|bank|transit",
    "secret": "token|secret|key|apikey|password|passwd|bearer|credential",
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "routing": ROUTING, "secret": SECRET}
#: What a span is worth by its kind, its checksum counted where it has one, and what a context word adds.
WORTH = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.5, "routing": 0.5, "secret": 0.5}
NEARBY = 0.25
BASE = ("email", "ip", "card", "phone")
#: A character that each match has, so that texts without it are not searched.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Likewise, a pattern within each match.
WITHIN = {"card": r"[0-9][\x20-]?[0-9]", "iban": r"[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "routing": r"[0-9]{9}", "secret": r"[0-9A-Fa-f]{32}"}
SPAN = "array<struct<kind:string,start:int,end:int,score:double,from:int,to:int>>"
#: Numbers that are summed together.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often a lambda reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before_each(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each of the whole numbers: the fold, from 0, of all before it, by blocks."""

    def folded(part: Column, start: Column) -> Column:
        return F.aggregate(part, start, fold)

    zero = F.lit(0)

    def ahead(v: Column) -> Column:
        blocks = F.when(F.size(v) > 0, F.sequence(zero, ((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        totals = F.transform(blocks, lambda b: folded(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero))
        starts = let(totals, lambda t: F.transform(t, lambda _, b: folded(F.slice(t, F.lit(1), b), zero)))
        return let(starts, lambda s: F.transform(v, lambda _, i: folded(F.slice(v, i - i % BLOCK + 1, i % BLOCK), F.element_at(s, (i / BLOCK).cast("int") + 1))))

    return let(values, ahead)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(back, i, F.lit(1)).cast("int"), F.lit(0))
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return (F.length(digits) > 0) & (F.aggregate(at, F.lit(0), add) % 10 == 0)


def mod97(match: Column) -> Column:
    """Whether an account number leaves 1: letters count as 10 to 35, the first four characters come last."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _weighted(digits: Column) -> Column:
    """Whether nine digits, weighted 3, 7, 1 by turns, sum up to a multiple of ten, and begin with a district."""
    at = [F.substring(digits, i, 1).cast("int") for i in range(1, 10)]
    first = F.substring(digits, 1, 2).cast("int")
    return (sum((w * d for w, d in zip((3, 7, 1) * 3, at, strict=True)), F.lit(0)) % 10 == 0) & (first.between(1, 12) | first.between(21, 32) | first.between(61, 72) | (first == 80))


def _fits(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = F.regexp_replace(match, r"(^|\.)0+(?=[0-9])", "$1")
        return F.forall(F.split(part, r"\."), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "ssn":
        return match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "routing":
        return F.when(F.length(match) == 9, _weighted(match)).otherwise(False)
    if kind == "secret":
        return match.rlike("^[0-9A-Fa-f]{32,128}$") & match.rlike("[0-9]") & match.rlike("[A-Fa-f]")
    plain = F.length(F.replace(match, F.lit(" "), F.lit("")))
    return plain.between(15, 34) & mod97(match)


def _nearby(kind: str, piece: Column) -> Column:
    low = F.translate(piece, string.ascii_uppercase, string.ascii_lowercase)
    return low.rlike(f"(?:^|[^a-z0-9])(?:{CONTEXT[kind]})(?:$|[^a-z0-9])")


def found(kind: str, text: Column, least_score: float = 0.75) -> Column:
    """The kind's spans, leftmost and not overlapping: kind, start, end (code points), score, from, to (bytes); ends exclusive."""
    pattern = PATTERNS[kind]
    all_pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(pieces: Column) -> Column:
        n = F.size(pieces) - 1
        each = F.arrays_zip(F.slice(pieces, F.lit(1), n).alias("piece"), matches.alias("match"), F.slice(pieces, F.lit(2), n).alias("after"))
        return let(each, spans)

    def spans(each: Column) -> Column:
        def ahead(length: Callable[[Column], Column]) -> Column:
            return before_each(F.transform(each, lambda x: length(x["piece"]) + length(x["match"])), lambda acc, x: acc + x)

        placed = F.arrays_zip(each.alias("x"), ahead(F.length).alias("chars"), ahead(F.octet_length).alias("bytes"))
        return F.transform(F.filter(placed, lambda p: _fits(kind, p["x"]["match"])), scored)

    def scored(p: Column) -> Column:
        x = p["x"]
        start, first = p["chars"] + F.length(x["piece"]), p["bytes"] + F.octet_length(x["piece"])
        near = _nearby(kind, F.right(x["piece"], F.lit(40))) | _nearby(kind, F.left(x["after"], F.lit(40)))
        score = F.round(F.lit(WORTH[kind]) + F.when(near, NEARBY).otherwise(0.0), 2)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["match"])).alias("end"), score.alias("score"), first.alias("from"), (first + F.octet_length(x["match"])).alias("to"))

    worthwhile = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(WITHIN[kind])
    kept = let(all_pieces, located)
    if kind not in BASE:
        kept = F.filter(kept, lambda s: s["score"] >= least_score)
    return F.when(worthwhile, kept).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, least_score: float = 0.75) -> Column:
    """The spans of all kinds, by kind, then start."""
    return F.concat(*(found(kind, text, least_score) for kind in PATTERNS))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select("doc_id", *(found(kind, text).alias(kind) for kind in PATTERNS))
    spans = F.concat(*PATTERNS)
    return each.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE), F.sha2(_listed(F.concat(*BASE)), 256).alias("base_sha256"), _listed(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in square brackets; of spans that overlap the first is named."""
    raw = text.cast("binary")

    def piece(start: Column, end: Column) -> Column:
        return F.substring(raw, start + 1, end - start).cast("string")

    def joined(s: Column) -> Column:
        reach = before_each(s["to"], lambda acc, x: F.greatest(acc, x))
        parts = F.zip_with(s, reach, lambda x, r: F.when(x["from"] >= r, F.concat(piece(r, x["from"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(F.array_max(s["to"]), F.octet_length(text)))

    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(in_order, joined)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in square brackets, ``n_chars`` counted anew."""
    name = fresh(docs, "pii")
    text = F.col("text").cast("string")
    told = docs.withColumn(name, all_spans(F.coalesce(text, F.lit(""))))
    changed = told.withColumn("text", redacted(text, F.col(name)).cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def _oracle() -> str:
    """For DuckDB, whose patterns have no look-around: the plain patterns, and word borders for account numbers."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "ssn": r"[0-9]+(?:-[0-9]+)*", "routing": "[0-9]+", "secret": "[0-9A-Za-z]{32,}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT WHEN reverse({digits})[i]::INT > 4 THEN reverse({digits})[i]::INT * 2 - 9 ELSE reverse({digits})[i]::INT * 2 END)) % 10 = 0"
    turned = "(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4])"
    number = f"array_to_string(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')"
    fits = {
        "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS BIGINT), 999) > 255)) = 0", "card": f"len({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"len({digits}) BETWEEN 9 AND 15",
        "iban": f"len(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split({number}, ''), lambda c: c::INT)), lambda a, x: (a * 10 + x) % 97) = 1",
        "ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND score >= 0.75",
        "routing": "len(m) = 9 AND list_sum(list_transform(range(1, 10), lambda i: m[i]::INT * [3, 7, 1][1 + (i - 1) % 3])) % 10 = 0 AND (m[1:2] BETWEEN '01' AND '12' OR m[1:2] BETWEEN '21' AND '32' OR m[1:2] BETWEEN '61' AND '72' OR m[1:2] = '80') AND score >= 0.75",
        "secret": "regexp_full_match(m, '[0-9A-Fa-f]{32,128}') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Fa-f]') AND score >= 0.75",
    }
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    near = " OR ".join("regexp_matches(" + low.format(x) + ", '(?:^|[^a-z0-9])(?:{})(?:$|[^a-z0-9])')" for x in ("right(ps[i], 40)", "left(ps[i + 1], 40)"))
    parts = []
    for nr, (kind, pattern) in enumerate(plain.items()):
        parts.append(f"""SELECT doc_id, rid, {nr} AS nr, '{kind}' AS kind, s, s + len(m) AS e, score
  FROM (SELECT doc_id, rid, ms[i] AS m, round({WORTH[kind]} + CASE WHEN {near.format(CONTEXT[kind], CONTEXT[kind])} THEN {NEARBY} ELSE 0 END, 2)::DOUBLE AS score, (list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d))) WHERE {fits[kind]}""")
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY nr, s){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS (" + "\nUNION ALL ".join(parts) + ")\n"
        f"SELECT d.doc_id, {counts}, sha256({listed.format(' FILTER (nr < 4)')}) AS base_sha256, {listed.format('')} AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY nr, s), '') AS scores FROM d LEFT JOIN f ON f.rid = d.rid GROUP BY d.rid, d.doc_id"
    )


ORACLE = _oracle()
