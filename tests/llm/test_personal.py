"""Personal data against the patterns as given, and its SQL, on awkward texts."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from haulscope.llm import personal
from haulscope.llm.queries import ORACLES, QUERIES

GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None,
    "",
    "no data here, only words and 12 numbers",
    "write to a.b+c@mail.example.com, or x@y (no domain), or @a.b@c.d and p@q.r.s@t.u%v@w.x",
    "漢字 é a@b.cc 10.0.0.1 and 256.1.1.1, 1.2.3.4.5.6.7.8, 00255.0.0.0, 1..2.3.4, 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112, 4111  1111 1111 1111, 4111 - 1111",
    "7536784127813050 4845168114407329 4111111111111111 visa 4111111111111111",
    "+1 (017) 555-7713, +49 30 1234567., +1, +12, +1 (2), + 1 234 567 89, +1+23456789+1 23456789 0123456789",
    "IBAN DE89 3704 0044 0532 0130 00, DE89370400440532013001, GB82 WEST 1234 5698 7654 32 and FR1420041010050500013M02606",
    "ssn 078-05-1120, 666-12-1234 ssn, nothing of the kind stands here at all, part 123-45-6789 social, and there is no word of this kind anywhere near 219-09-9999",
    "card 3782 822463 10005 amex; 378282246310005 order; 30569309025904; 6011111111111117; 6304000000000000",
    "a@b.c" * 50 + "+1 234 567 8901" * 20,
    "call\n+1 (132) 555-1352 \U0001f600 server 161.17.88.162",
    "1" * 3000 + " " + "x" * 3000 + "@" + "1.1" * 500 + "+1" + " " * 500 + "5",
]


def brute(text):
    """Base spans by the patterns as given."""
    out = []
    for kind, pattern in GIVEN.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                twice = [int(c) for c in number[::-1]]
                total = sum(d if i % 2 == 0 else sum(map(int, str(2 * d))) for i, d in enumerate(twice))
                if not 16 <= len(number) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(number) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def noise(rng, n):
    return "".join(rng.choice("0123456789.@+- ()aZ%_é\n411") for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, t, "x", "y") for i, t in enumerate([*TEXTS, *(noise(rng, 300) for _ in range(60)), *(noise(rng, 4000) for _ in range(6))])]
    rows += [(None, TEXTS[3], "x", "y"), (5, TEXTS[5], "x", "y"), (None, None, None, None)]
    path = str(tmp_path_factory.mktemp("personal"))
    spark.createDataFrame(rows, "doc_id long, text string, spans string, score string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_base_spans_are_those_of_the_patterns(folder):
    for _, text, *_ in folder[1]:
        found = personal.spans(text or "")
        assert [s[:3] for s in found if s[5]] == brute(text)
        assert all(text[s[1] : s[2]] == s[3] for s in found)


def test_query_and_sql(spark, folder):
    path, rows = folder
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    result = con.execute(ORACLES["op11_personal_data"])
    names = [d[0] for d in result.description]
    df = QUERIES["op11_personal_data"](spark, path)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr) and len(got) == len(rows)
    for r in df.where("doc_id IS NOT NULL").collect():
        base = brute(dict((x[0], x[1]) for x in rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in GIVEN]


def test_added_spans():
    added = {t: [(s[0], s[3]) for s in personal.spans(t) if not s[5]] for t in TEXTS if t}
    assert ("pan", "4111111111111111") in added[TEXTS[6]] and ("pan", "7536784127813050") not in added[TEXTS[6]]
    assert added[TEXTS[8]] == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "FR1420041010050500013M02606")
    ]
    assert added[TEXTS[9]] == [("ssn", "078-05-1120")]
    assert [s[1] for s in added[TEXTS[10]]] == ["3782 822463 10005", "378282246310005", "30569309025904"]
    assert added[TEXTS[2]] == []


@pytest.mark.parametrize("kind, text", [("iban", "GB82WEST12345698765432"), ("card", "4111111111111111"), ("pan", "378282246310005")])
def test_one_wrong_character_fails_the_checksum(kind, text):
    assert personal.valid(kind, text)
    for i in range(4, len(text)):
        if text[i].isdigit():
            assert not personal.valid(kind, text[:i] + str((int(text[i]) + 1) % 10) + text[i + 1 :])


def test_context_moves_the_score():
    plain = personal.score("wwww 4111111111111111 wwww", "card", 5, 21)
    assert personal.score("visa 4111111111111111 wwww", "card", 5, 21) > plain
    assert personal.score("part 4111111111111111 wwww", "card", 5, 21) < plain
    assert personal.score("part" + " " * 40 + "4111111111111111", "card", 44, 60) == plain


@pytest.mark.parametrize("unit", ["1", "x", "x@", "1.", "+1", "+1 ", "1-", "A", "AA11", "a@b.c", "@a.b"])
def test_long_texts_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    personal.spans(text)
    assert time.perf_counter() - began < 20


def test_empty_table(none):
    assert personal.find(none).collect() == []
