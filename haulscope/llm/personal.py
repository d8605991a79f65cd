"""Personal data in texts: patterns propose spans, checksums and ranges confirm them, nearby words adjust the score.

Proposals are regular expressions over whole texts, leftmost and non-overlapping for each kind:

* the base kinds email, ip, card and phone. A proposal that fails its check (parts of an address above 255, Luhn,
  number of digits) is dropped and not tried again. Those that pass always stay, whatever their score;
* iban, confirmed by mod 97 and by its length;
* pan, a card number of 13 to 19 digits that stands inside a longer run of digits and so is no base card. It needs an
  issuer's prefix and length, and Luhn;
* ssn, three groups of digits within the issued ranges. It has no checksum, so only context can carry it.

The score of a span is a prior of its kind, plus ``CONFIRMED`` where a checksum holds, plus ``NEAR`` for a word of its
kind within ``WINDOW`` code points on either side, minus ``AGAINST`` for a word that speaks against it. Added spans
stay from ``LEAST`` on, if they overlap no base span. All numbers are whole, so reruns and other engines agree.

Every pattern is linear in the text: digits and plus signs that cannot start a match are passed over once, repeats
never give back what they took, and the local part of an address is found backwards from its @, up to the end of the
match before. A text goes to Python once and only spans come back; a batch is bounded in bytes, a row by its own text.

Defined results: null and empty texts have no spans; every row gives one row, also repeated ones and those without
doc_id; ``start`` and ``end`` count code points, the end is exclusive; extra columns are not carried; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.llm.common import by_bytes, table

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "pan", "ssn"]

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII),
    "pan": re.compile(r"\b(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})\b", re.ASCII),
    "ssn": re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII),
}
# Prefixes and lengths of card numbers by issuer, and the ranges of social security numbers never issued.
ISSUED = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|6[0-9]{15,18}")
NEVER_ISSUED = re.compile(r"000|666|9|[0-9]{3}-00|[0-9]{3}-[0-9]{2}-0000")

# scores of 100
PRIOR = {"email": 60, "ip": 40, "card": 20, "phone": 40, "iban": 20, "pan": 20, "ssn": 30}
CONFIRMED, NEAR, AGAINST, LEAST = 40, 30, 30, 50
CHECKSUM = frozenset({"card", "iban", "pan"})
WINDOW = 40
WORDS = {
    "email": "email|e-mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login|client",
    "card": "card|visa|mastercard|amex|credit|debit|payment|kreditkarte|karte|tarjeta|carte",
    "phone": "phone|tel|mobile|call|fax|telefon|telefono|telephone",
    "iban": "iban|account|bank|konto|cuenta|compte|transfer",
    "pan": "card|visa|mastercard|amex|credit|debit|payment|kreditkarte|karte|tarjeta|carte",
    "ssn": "ssn|social security|taxpayer|social",
}
DOUBTS = "version|release|order|invoice|sku|isbn|serial|part|ticket|example number"
FOR = {kind: re.compile(rf"\b(?:{words})\b", re.ASCII | re.IGNORECASE) for kind, words in WORDS.items()}
DOUBT = re.compile(rf"\b(?:{DOUBTS})\b", re.ASCII | re.IGNORECASE)

SPANS = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:int,base:boolean>>"


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Every second digit from the right doubled, nines cast out; the sum ends in 0."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """The first four characters go last, letters count from 10; the number leaves 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        # the length first: a part may be very long
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in found.split("."))
    if kind == "card":
        return 16 <= len(number := digits(found)) <= 19 and luhn(number)
    if kind == "phone":
        return 8 <= len(digits(found)) <= 15
    if kind == "iban":
        return 15 <= len(plain := found.replace(" ", "")) <= 34 and mod_97(plain)
    if kind == "pan":
        return ISSUED.fullmatch(number := digits(found)) is not None and luhn(number)
    if kind == "ssn":
        return NEVER_ISSUED.match(found) is None
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses: an @ with a domain, and the characters before it back to the end of the last address."""
    last = 0
    for match in DOMAIN.finditer(text):
        start = match.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < match.start():
            last = match.end()
            yield start, last


def score(text: str, kind: str, start: int, end: int) -> int:
    around = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    near = any(FOR[kind].search(part) for part in around)
    doubt = any(DOUBT.search(part) for part in around)
    return min(100, max(0, PRIOR[kind] + CONFIRMED * (kind in CHECKSUM) + NEAR * near - AGAINST * doubt))


def spans(text: str) -> list[tuple[str, int, int, str, int, bool]]:
    """(kind, start, end, text, score, base) by kind as listed, then start."""
    found = [("email", *span) for span in emails(text)]
    for kind, pattern in PATTERNS.items():
        found += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m.group())]
    base = [f for f in found if f[0] in BASE]
    out = [(*f, text[f[1] : f[2]], score(text, *f), True) for f in base]
    held = sorted(f[1:] for f in base)
    at = 0
    for f in sorted((f for f in found if f[0] not in BASE), key=lambda f: f[1]):
        # base spans of two kinds may overlap, but a text has few: those that end before this start are behind for good
        while at < len(held) and held[at][1] <= f[1]:
            at += 1
        if any(low < f[2] and f[1] < high for low, high in _from(held, at, f[2])):
            continue
        if (points := score(text, *f)) >= LEAST:
            out.append((*f, text[f[1] : f[2]], points, False))
    return sorted(out, key=lambda f: (KINDS.index(f[0]), f[1]))


def _from(held: list[tuple[int, int]], at: int, end: int) -> Iterator[tuple[int, int]]:
    while at < len(held) and held[at][0] < end:
        yield held[at]
        at += 1


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "start", "end", "text", "score", "base"]
    kind = pa.list_(pa.struct(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()])))
    for batch in batches:
        for part in by_bytes(batch, "text"):
            rows = [[dict(zip(names, s)) for s in spans(t.as_py() or "")] for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: spans in order of kind and start, each with its text and score."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_found, f"doc_id long, spans {SPANS}")


def joined(found: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans counted and digested, and all spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(_count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0)).alias("top_score"),
    )


def _oracle() -> str:
    """The same in DuckDB, whose patterns have neither lookbehind nor possessive repeats and are linear without them."""
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": PATTERNS["phone"].pattern,
        **{kind: PATTERNS[kind].pattern for kind in ("iban", "pan", "ssn")},
    }
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    rules = ",\n    ".join(
        f"({k}, {quoted(kind)}, {quoted(forms[kind])}, {PRIOR[kind] + CONFIRMED * (kind in CHECKSUM)}, {quoted(WORDS[kind])})"
        for k, kind in enumerate(KINDS)
    )
    context = lambda words, part: rf"regexp_matches({part}, '(?i)\b(?:' || {words} || ')\b')"
    before = f"substr(t, greatest(1, start - {WINDOW - 1}), least(start, {WINDOW}))"
    after = f'substr(t, "end" + 1, {WINDOW})'
    near = f"({context('words', before)} OR {context('words', after)})"
    doubt = f"({context(quoted(DOUBTS), before)} OR {context(quoted(DOUBTS), after)})"
    return rf"""
WITH rules(k, kind, pattern, prior, words) AS (
  VALUES
    {rules}
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce("text", '') AS t FROM documents
), pieces AS (
  SELECT r, t, k, kind, prior, words, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap
  FROM (SELECT *, regexp_extract_all(t, pattern) AS hits, string_split_regex(t, pattern) AS gaps FROM docs, rules)
), placed AS (
  SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS "end",
    regexp_replace(hit, '[^0-9]', '', 'g') AS number, replace(hit, ' ', '') AS plain
  FROM pieces
), checked AS (
  SELECT *, "end" - length(hit) AS start,
    list_sum(list_transform(reverse(number).string_split(''),
      lambda c, n: CASE WHEN n % 2 = 1 THEN TRY_CAST(c AS INT) WHEN c > '4' THEN TRY_CAST(c AS INT) * 2 - 9 ELSE TRY_CAST(c AS INT) * 2 END)) % 10 = 0 AS luhn
  FROM placed
), valid AS (
  SELECT *, CAST(least(100, greatest(0, prior + CASE WHEN {near} THEN {NEAR} ELSE 0 END
      - CASE WHEN {doubt} THEN {AGAINST} ELSE 0 END)) AS INT) AS score
  FROM checked
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len([x for x in string_split(hit, '.') if CAST(x AS DOUBLE) > 255]) = 0
    WHEN 'card' THEN length(number) BETWEEN 16 AND 19 AND luhn
    WHEN 'phone' THEN length(number) BETWEEN 8 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(
      list_prepend(0, [CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) AS INT) - 48 ELSE CAST(ascii(c) AS INT) - 55 END
        for c in string_split(plain[5:] || plain[1:4], '')]),
      lambda a, d: (a * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1
    WHEN 'pan' THEN luhn AND regexp_full_match(number, {quoted(ISSUED.pattern)})
    ELSE NOT regexp_matches(hit, '^(?:' || {quoted(NEVER_ISSUED.pattern)} || ')')
  END
), kept AS (
  SELECT r, k, kind, start, "end", score FROM valid v
  WHERE k < {len(BASE)} OR (score >= {LEAST} AND NOT EXISTS (
    SELECT 1 FROM valid b WHERE b.r = v.r AND b.k < {len(BASE)} AND b.start < v."end" AND v.start < b."end"))
), joined AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)},
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY k, start) FILTER (k < {len(BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY k, start) AS spans,
    count(*) FILTER (k >= {len(BASE)}) AS n_added, max(score) AS top_score
  FROM kept GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, coalesce(top_score, 0) AS top_score
FROM docs LEFT JOIN joined USING (r)
"""


ORACLE = _oracle()
