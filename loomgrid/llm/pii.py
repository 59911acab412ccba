"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Built from DataFrame functions only. Spark's regular expressions return matches but
not positions; the text between the matches (``split`` on the same pattern) restores
them, by running sums inside about as many blocks of matches as a block has, so a
text full of matches stays cheap. Patterns run only over texts that hold a character they need. They are written
so that Java neither recurses nor rescans a long run: repeated groups are possessive
and runs are entered at their first character only, which changes no match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Patterns, by kind.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_RANGE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"
NATIONAL_ID = r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"
NATIONAL_ID_NEVER = r"^(?:000|666|9..)|-00-|-0000$"
ACCESS_KEY = r"(?<![A-Za-z0-9_])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_])"
SECRET = r"(?<![A-Za-z0-9_])(?:password|passwd|secret|token|api_key) ?[=:] ?[\x22\x27]?[A-Za-z0-9_+/.-]{12,}+"
#: A secret's value has a digit and a letter.
SECRET_MIXED = r"[=:](?:.*[0-9].*[A-Za-z]|.*[A-Za-z].*[0-9])"
#: A confirmed span's score without context in percent, by kind.
SCORE = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 90, "national_id": 30, "access_key": 80, "secret": 60}
#: Fewest characters of a match, by kind.
LEAST = {"email": 5, "ip": 7, "card": 13, "phone": 4, "iban": 12, "national_id": 11, "access_key": 20, "secret": 18}
#: Words that raise the score when they stand near a span, by kind.
CONTEXT = {
    "email": "mail|e-mail|contact|write to|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|mastercard|credit|debit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon|llamar|appel",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "national_id": "ssn|social security|national id|tax id|personalausweis|dni|insee",
    "access_key": "aws|key|access|secret",
    "secret": "login|user|admin|key|config|env",
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 30
#: Spans of kinds beyond the four base kinds need this score.
MIN_SCORE = 50
BASE_KINDS = ("email", "ip", "card", "phone")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, least: int = 1) -> Column:
    """Array of (s, e, t, before, after): leftmost non-overlapping matches with code-point offsets, end exclusive.

    ``before``, ``after``: the 40 characters at either side. A match has ``least`` characters or more.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    back = CONTEXT_CHARS // least + 1  # so many matches reach into a span's context

    def around(p: Column, i: Column) -> tuple[Column, Column]:
        part = lambda of, j: F.coalesce(F.get(of, j), F.lit(""))
        left = F.transform(F.sequence(i - back, i - 1), lambda j: F.concat(part(p.ts, j), part(p.tails, j + 1)))
        right = F.transform(F.sequence(i + 1, i + back), lambda j: F.concat(part(p.heads, j), part(p.ts, j)))
        return F.right(F.concat(part(p.tails, i - back), F.array_join(left, "")), F.lit(CONTEXT_CHARS)), F.left(F.array_join(right, ""), F.lit(CONTEXT_CHARS))

    def placed(p: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(p.ts))).cast("int")
        blocks = F.sequence(F.lit(0), F.ceil(F.size(p.ts) / width).cast("int") - 1)
        both = F.zip_with(F.slice(p.gaps, F.lit(1), F.size(p.ts)), p.ts, lambda g, t: F.struct(F.char_length(g).alias("gap"), F.char_length(t).alias("own")))

        def within(q: Column) -> Column:
            of = lambda b: F.slice(q.both, b * width + 1, width)
            sums = F.transform(blocks, lambda b: F.aggregate(of(b), F.lit(0), lambda acc, x: acc + x.gap + x.own))

            def block(r: Column, b: Column) -> Column:
                start = F.struct(F.aggregate(F.slice(r, F.lit(1), b), F.lit(0), lambda acc, x: acc + x).alias("at"), F.array().cast("array<int>").alias("out"))
                step = lambda acc, x: F.struct((acc.at + x.gap + x.own).alias("at"), F.array_append(acc.out, acc.at + x.gap).alias("out"))
                return F.aggregate(of(b), start, step, lambda acc: acc.out)

            return _let(sums, lambda r: F.flatten(F.transform(blocks, lambda b: block(r, b))))

        starts = _let(F.struct(both.alias("both")), within)

        def span(t: Column, i: Column, s: Column) -> Column:
            before, after = around(p, i)
            return F.struct(s.alias("s"), (s + F.char_length(t)).alias("e"), t.alias("t"), before.alias("before"), after.alias("after"))

        return _let(starts, lambda st: F.transform(p.ts, lambda t, i: span(t, i, F.get(st, i))))

    cut = F.struct(found.alias("ts"), gaps.alias("gaps"))
    ready = _let(cut, lambda c: F.struct(c.ts.alias("ts"), c.gaps.alias("gaps"), F.transform(c.gaps, lambda g: F.right(g, F.lit(CONTEXT_CHARS))).alias("tails"), F.transform(c.gaps, lambda g: F.left(g, F.lit(CONTEXT_CHARS))).alias("heads")))
    return _let(ready, lambda p: F.when(F.size(p.ts) > 0, placed(p)))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits of ``t`` pass the Luhn check."""
    backwards = F.reverse(_digits(t))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(backwards)), F.lit(0), add) % 10 == 0


def mod97(t: Column) -> Column:
    """Whether ``t`` passes the ISO 7064 mod-97 check of an IBAN."""
    plain = F.replace(t, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return (F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1) & F.char_length(plain).between(15, 34)


def _kind(text: Column, kind: str, pattern: str, needs: Column, confirmed: Callable[[Column], Column]) -> Column:
    """Confirmed spans of one kind with their scores; null if there are none."""
    words = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{CONTEXT[kind]})(?![\p{{L}}\p{{N}}])"

    def one(x: Column) -> Column:
        bonus = F.when(x.before.rlike(words) | x.after.rlike(words), CONTEXT_BONUS).otherwise(0)
        return F.struct(F.lit(kind).alias("kind"), x.s.alias("s"), x.e.alias("e"), (F.least(F.lit(100), F.lit(SCORE[kind]) + bonus) / 100).alias("score"))

    spans = F.transform(F.filter(matches(text, pattern, LEAST[kind]), lambda x: confirmed(x.t)), one)
    return F.when(needs, spans if kind in BASE_KINDS else F.filter(spans, lambda x: x.score >= MIN_SCORE / 100))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, s, e, score), for each row of ``docs`` (doc_id, text).

    Kinds in order email, ip, card, phone, iban, national_id, access_key, secret; then by start. The four
    base kinds are reported whenever their check holds (address parts up to 255, Luhn
    over 13 to 19 digits, 9 to 15 digits); a base span that fails is dropped without a
    retry inside it. The others need a score of 0.5: an IBAN passes mod 97, a national
    id has a context word within 40 characters, a secret's value mixes digits and letters. Null texts are empty. Null ids,
    repeated rows and very long texts are treated like others, however many spans they hold; further columns are
    ignored; an empty table gives no rows.
    """
    text = F.col("text")
    digit, at, plus = text.rlike("[0-9]"), text.contains("@"), text.contains("+")
    assigned = digit & (text.contains("=") | text.contains(":"))
    kinds = {
        "email": (EMAIL, at, lambda t: F.lit(True)),
        "ip": (IP, digit & text.contains("."), lambda t: t.rlike(IP_RANGE)),
        "card": (CARD, digit, luhn),
        "phone": (PHONE, plus, lambda t: F.char_length(_digits(t)).between(9, 15)),
        "iban": (IBAN, digit, mod97),
        "national_id": (NATIONAL_ID, digit & text.contains("-"), lambda t: ~t.rlike(NATIONAL_ID_NEVER)),
        "access_key": (ACCESS_KEY, text.contains("AKIA"), lambda t: F.lit(True)),
        "secret": (SECRET, assigned, lambda t: t.rlike(SECRET_MIXED)),
    }
    none = F.array().cast("array<struct<kind:string,s:int,e:int,score:double>>")
    named = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    return named.select("doc_id", F.concat(*[F.coalesce(_kind(text, k, *how), none) for k, how in kinds.items()]).alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda x: x.kind.isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return find(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: F.round(x.score * 100).cast("int").cast("string")), ",").alias("scores"))


QUERIES = {"op8_pii": op8_pii}

_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": PHONE,
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"\b(?:password|passwd|secret|token|api_key) ?[=:] ?[\x22\x27]?[A-Za-z0-9_+/.-]{12,}",
}
_FOUND = " UNION ALL ".join(f"SELECT rid, text, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM d" for k, (kind, p) in enumerate(_SQL_PATTERNS.items()))
_BEFORE = f"substr(text, CAST(greatest(b - {CONTEXT_CHARS}, 0) + 1 AS BIGINT), CAST(least(b, {CONTEXT_CHARS}) AS BIGINT))"
_AFTER = f"substr(text, CAST(b + length(t) + 1 AS BIGINT), {CONTEXT_CHARS})"
_NEAR = " ".join(rf"WHEN '{k}' THEN regexp_matches({_BEFORE}, '(?i)(^|[^\p{{L}}\p{{N}}])(?:{w})($|[^\p{{L}}\p{{N}}])') OR regexp_matches({_AFTER}, '(?i)(^|[^\p{{L}}\p{{N}}])(?:{w})($|[^\p{{L}}\p{{N}}])')" for k, w in CONTEXT.items())
_PLAIN = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORE.items())
ORACLE_SQL = {
    "op8_pii": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_FOUND}),
u AS (SELECT rid, text, k, kind, ms, ps, unnest(generate_series(1, len(ms))) AS i FROM m WHERE len(ms) > 0),
s AS (SELECT rid, text, k, kind, ms[i] AS t, CAST(list_sum([length(x) for x in ps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1 : i - 1]]), 0) AS BIGINT) AS b FROM u),
n AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS digits, replace(t, ' ', '') AS flat FROM s),
c AS (SELECT *, reverse(digits) AS r, string_split(array_to_string([CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE CAST(ascii(x) - 55 AS VARCHAR) END for x in string_split(substr(flat, 5) || substr(flat, 1, 4), '')], ''), '') AS z FROM n),
v AS (
  SELECT rid, text, t, k, kind, b FROM c
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_matches(t, '{IP_RANGE}')
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(substr(r, i, 1) AS INTEGER) WHEN substr(r, i, 1) > '4' THEN 2 * CAST(substr(r, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(r, i, 1) AS INTEGER) END for i in range(1, length(r) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(flat) BETWEEN 15 AND 34 AND list_reduce([CAST(x AS INTEGER) for x in z], lambda p, q: (p * 10 + q) % 97) = 1
    WHEN 'national_id' THEN NOT regexp_matches(t, '{NATIONAL_ID_NEVER}')
    WHEN 'secret' THEN regexp_matches(t, '{SECRET_MIXED}')
    ELSE true END),
h AS (SELECT rid, k, kind, b, b + length(t) AS e, least(100, CASE kind {_PLAIN} END + CASE WHEN CASE kind {_NEAR} END THEN {CONTEXT_BONUS} ELSE 0 END) AS score FROM v),
g AS (SELECT * FROM h WHERE k < 4 OR score >= {MIN_SCORE}),
a AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY k, b) FILTER (k < 4) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY k, b) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, b) AS scores FROM g GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN a USING (rid)"""
}
