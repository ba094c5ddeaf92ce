import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spotweave.llm import pii

TEXTS = [
    "mail ändi.34@mail7.example.com, or Bob_X+9@a-b.org.",
    "call +1 (017) 555-7713 or (212) 555-0000 or 415-555-2671!",
    "card 4845168114407329 4929348385146306 and 4845 1681 1440 7329; not 4845168114407328",
    "99 4845168114407329",
    "host 129.38.82.176. not 300.1.1.1 nor 1.2.3.4.5 nor 9.9.",
    "born 1987-02-28, 02/29/2000, 31.12.1999; not 1987-02-30 or 02/30/2000 or 3000-01-01",
    "ssn 123-45-6789, not 666-45-6789 nor 123-00-6789",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"!!',
    "again +1 (017) 555-7713 and 1987-02-28",
    "nothing here 12 345 a1b2", "", None,
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t, "keep") for i, t in enumerate(TEXTS)], "doc_id long, text string, found string")


def test_values_change_within_their_format_and_come_back(frame):
    out = pii.pseudonymize(frame, "k1", count_col="n").cache()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    n = {r["doc_id"]: r["n"] for r in out.collect()}
    shape = lambda t: t and re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
    for i, t in enumerate(TEXTS):
        if i not in (4,):
            assert shape(got[i]) == shape(t)
    assert got[9:12] if False else [got[i] for i in (9, 10, 11)] == TEXTS[9:12]
    assert [n[i] for i in range(12)] == [2, 3, 3, 1, 1, 3, 1, 1, 2, 0, 0, 0]
    cards = re.findall(r"[0-9]{16}|(?:[0-9]{4} ){3}[0-9]{4}", got[2])
    assert all(map(luhn, cards[:3])) and got[2].endswith("not 4845168114407328")
    assert got[3].startswith("99 ") and got[3] != TEXTS[3]
    assert cards[0] == got[3][3:] == cards[2].replace(" ", "") != "4845168114407329"
    assert all(int(o) < 256 for o in re.search(r"host ([\d.]+)\.", got[4])[1].split(".")) and got[4].endswith("not 300.1.1.1 nor 1.2.3.4.5 nor 9.9.")
    iso = re.findall(r"\d{4}-\d\d-\d\d", got[5])
    assert datetime.date.fromisoformat(iso[0]) and iso[0] != "1987-02-28" and iso[1] == "1987-02-30"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1])[0] in got[8] and iso[0] in got[8]
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out.drop("n"), "k1", backwards=True).collect()}
    assert back == dict(enumerate(TEXTS))
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymize(frame, "k2").collect()}
    assert other[3] != got[3] and {r["found"] for r in out.collect()} == {"keep"}


def test_permutations_are_one_to_one(spark):
    days = spark.range(0, 73049, 7).select(F.date_format(F.date_add(F.to_date(F.lit("1900-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    numbers = spark.range(1000).select(F.concat(F.lit("+1 (555) 555-0"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("v"))
    for df in (days, numbers):
        new = df.select("v", pii.pseudonym(F.col("v"), F.lit("k")).alias("p"))
        row = new.agg(F.count("*"), F.countDistinct("p"), F.sum((F.col("v") == F.col("p")).cast("int"))).first()
        assert row[0] == row[1] and row[2] <= row[0] // 50


def test_empty_table(frame):
    assert pii.pseudonymize(frame.limit(0), "k").collect() == []


def test_values_without_two_digits_in_a_row_are_replaced_in_any_text(spark):
    token = "a1b2c3d4" * 4
    texts = ["host 8.8.8.8 is down", "in 2024 host 8.8.8.8 was up", f"token {token}", f"token {token} of 2024", "none: a.b, 1.x, 7 a1"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymize(frame, "k", count_col="n").cache()
    got = {r["doc_id"]: (r["text"], r["n"]) for r in out.collect()}
    assert [got[i][1] for i in range(5)] == [1, 1, 1, 1, 0] and got[4][0] == texts[4]
    assert not any(v in got[i][0] for i in range(4) for v in ("8.8.8.8", token))
    assert got[0][0].split()[1] == got[1][0].split()[3] and got[2][0].split()[1] == got[3][0].split()[1]
    plain = {r["doc_id"]: r["text"] for r in pii.pseudonymize(frame, "k").collect()}
    assert plain == {i: t for i, (t, _) in got.items()}
    # The address's pseudonym comes back whatever it looks like.
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out.drop("n"), "k", backwards=True).collect()}
    assert back == dict(enumerate(texts))


def test_spellings_of_one_value_stay_linked(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"]
    phones = ["555-123-4567", "(555) 123-4567", "+1 555 123 4567", "+1 (555) 123-4567", "+44 555 123-4567"]
    texts = cards + phones
    out = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k")
    got = [t for _, t in sorted(map(tuple, out.collect()))]
    bare = lambda t: "".join(c for c in re.sub(r"^\+[0-9]+", "", t) if c.isdigit())
    assert len({bare(t) for t in got[:3]}) == 1 and len({bare(t) for t in got[3:]}) == 1
    assert all(a != b and re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) for a, b in zip(got, texts)) and got[7].startswith("+44 ")
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out, "k", backwards=True).collect()}
    assert back == dict(enumerate(texts))


def test_long_values_and_clashing_names(spark):
    texts = ["m" * 300_000 + "@mail.example.com", "x " * 500_000 + "8.8.8.8"]
    frame = spark.createDataFrame([(i, t, "k", "n") for i, t in enumerate(texts)], "doc_id long, text string, __found0 string, `a.b` string")
    out = pii.pseudonymize(frame, "k", count_col="doc_id")
    got = out.orderBy(F.length("text")).collect()
    assert out.columns == ["doc_id", "text", "__found0", "a.b"] and [r["doc_id"] for r in got] == [1, 1] and got[0]["__found0"] == "k"
    assert got[0]["text"].endswith("@mail.example.com") and len(got[0]["text"]) == len(texts[0]) and got[1]["text"].startswith("x " * 500_000)
    assert not any(r["text"] in texts for r in got)


def test_the_permutation_is_computed_once(spark):
    frame = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    plan = pii.pseudonymize(frame, "k", count_col="n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") == 1 and "Python" not in plan


# A plain version: found by Python patterns one kind after the other at each place, permuted by a loop.
LENGTHS = {"DE": 22, "GB": 22, "NO": 15, "AT": 20, "FR": 27, "MT": 31}
ONE, TWO = {"1", "7"}, set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
FINDERS = [
    ("email", r"(?<![^\W_]|[._%+-])(?:[^\W_]|[._%+-])+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("ipv4", r"(?<![^\W_]|\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?[0-9])"),
    ("%Y-%m-%d", r"(?:19|20)\d\d-\d\d-\d\d"), ("%Y/%m/%d", r"(?:19|20)\d\d/\d\d/\d\d"), ("%m/%d/%Y", r"\d\d/\d\d/(?:19|20)\d\d"),
    ("%d.%m.%Y", r"(?:\d\d\.\d\d|(?<!\d\.)\d\d?\.\d\d?(?=\.\d{4}(?!\.\d)))\.(?:19|20)\d\d"),
    *[("iban", rf"{c}\d\d(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + rf" ?[A-Z0-9]{{{(n - 4) % 4}}}" * bool(n % 4)) for c, n in LENGTHS.items()],
    ("phone", r"(?<!\+)(?:\+\d{8,15}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})"),
    ("ssn", r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}"),
    ("card", r"\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}|\d{6}\1\d{4,5})"), ("card", r"\d{13,19}(?!\d)"),
    ("hex", r"(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,64}|(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{32,64}"),
]
FINDERS = [(k, re.compile(r"(?<![^\W_])" * (p[:3] != "(?<" or k == "phone") + f"(?:{p})" + r"(?![^\W_])", re.ASCII if k != "email" else 0)) for k, p in FINDERS]


def plain_feistel(values, radix, key, tag):
    u = len(values) // 2
    held, radices = [values[:u], values[u:]], [radix[:u], radix[u:]]
    for i in range(pii.ROUNDS):
        side, other = i % 2, 1 - i % 2
        seed = hashlib.sha256(f"{key}|{tag}|{i}|{','.join(map(str, held[other]))}".encode()).hexdigest()
        words = [seed] + [hashlib.sha256((seed + str(b)).encode()).hexdigest() for b in range(1, len(held[side]) // 8 + 1)]
        held[side] = [(x + int(words[j // 8][j % 8 * 8 :][:8], 16)) % radices[side][j] for j, x in enumerate(held[side])]
    return held[0] + held[1]


def plain_permute(s, key, tag, kinds, letters=26):
    at = [i for i, c in enumerate(s) if re.match(kinds, c)]
    base = [48 if s[i] < ":" else 65 if s[i] < "[" else 97 for i in at]
    radix, values = [10 if b == 48 else letters for b in base], [ord(s[i]) - b for i, b in zip(at, base)]
    if len(at) == 1:
        h = radix[0] // 2
        a, b = plain_feistel([values[0] // h, values[0] % h], [2, h], key, tag)
        new = [a * h + b]
    else:
        new = plain_feistel(values, radix, key, tag)
    out = list(s)
    for i, v, b in zip(at, new, base):
        out[i] = chr(v + b)
    return "".join(out)


def plain_pseudonym(kind, m, key):
    if kind == "email":
        local, host = m.split("@", 1)
        return plain_permute(local, key, "email", "[0-9a-zA-Z]") + "@" + host
    if kind == "ipv4":
        return ".".join(map(str, plain_feistel(list(map(int, m.split("."))), [256] * 4, key, "ipv4")))
    if kind == "phone":
        d = re.match(r"\+([0-9]{1,3})", m)
        k = 0 if not d else 1 + (1 if d[1][0] in ONE else 2 if d[1][:2] in TWO else 3)
        return m[:k] + plain_permute(m[k:], key, "phone", "[0-9]")
    if kind == "hex":
        return plain_permute(m, key, "hex", "[0-9a-fA-F]", 6)
    if kind == "ssn":
        a, g, n = map(int, m.split("-"))
        a, g, n = plain_feistel([a - 1 - (a > 666), g - 1, n - 1], [898, 99, 9999], key, "ssn")
        return f"{a + 1 + (a >= 665):03}-{g + 1:02}-{n + 1:04}"
    if kind == "card":
        if not luhn(m):
            return m
        head = plain_permute(m[:-1], key, "card", "[0-9]")
        return head + next(c for c in "0123456789" if luhn(head + c))
    if kind == "iban":
        rest = lambda s: int("".join(str(int(c, 36)) for c in s[4:].replace(" ", "") + s[:4])) % 97
        if rest(m) != 1 or not "02" <= m[2:4] <= "98":
            return m
        new = plain_permute(m[4:], key, "iban", "[0-9A-Z]")
        return next(c for c in (f"{m[:2]}{k:02}{new}" for k in range(2, 99)) if rest(c) == 1)
    try:
        day = datetime.datetime.strptime(m, kind).date()
    except ValueError:
        return m
    a, b = plain_feistel(list(divmod((day - datetime.date(1900, 1, 1)).days, 4297)), [17, 4297], key, "date")
    new = datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)
    return new.strftime(kind) if len(m) == 10 and (kind != "%d.%m.%Y" or re.fullmatch(r"\d\d\.\d\d\.\d{4}", m)) else f"{new.day}.{new.month}.{new.year}"


def plain(text, key):
    if text is None:
        return None
    out, at = [], 0
    while at < len(text):
        for kind, form in FINDERS:
            m = form.match(text, at)
            if m and (kind != "ipv4" or all(len(o) < 4 and int(o) < 256 and (o == "0" or o[0] != "0") for o in m[0].split("."))):
                out.append(plain_pseudonym(kind, m[0], key))
                at = m.end()
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


PLANTED = [
    "+1 555 123 4567 +1555 123 4567 +49 30 123 4567 +4930 123 4567 +15551234567 (+355 42 123 4567) ++1 555 123 4567 a+1 555 123 4567",
    "3782 822463 10005, 3782-822463-10005 and 378282246310005; not 3782 822463 10006; 4111 1111 1111 1111 123; 3056 930902 5904",
    "5.3.2024 05.03.2024 2024-03-05 2024/03/05 31.2.2024 30.2.2024 v1.5.3.2024 5.3.2024.1 15.3.2024, 5.12.1999 2024/13/05",
    "DE89 3704 0044 0532 0130 00 then DE89370400440532013000, DE88370400440532013000; GB29 NWBK 6016 1331 9268 19 AND AT61 1904 3002 3457 3201 THEN NO93 8601 1117 947",
    "MT84 MALT 0110 0001 2345 MTLC AST0 01S; FR14 2004 1010 0505 0001 3M02 606; de89370400440532013000 XDE89370400440532013000",
    "token " + "0A1B2C3D" * 4 + " " + "0a1b2c3d" * 4 + " " + "0A1b2C3d" * 4 + " " + "AB" * 16,
    "a@b.co Z@b.co q@x.org 7@x.org _@x.org aB@x.org", "123-45-6789 123-45-67890 666-45-6789", "", "1", None,
]


def test_texts_equal_a_plain_version(spark):
    texts = PLANTED + TEXTS
    out = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "k")
    got = [t for _, t in sorted(map(tuple, out.collect()))]
    assert got == [plain(t, "k") for t in texts]
    phones = re.findall(r"\+[0-9 ]+(?= \+|$| \()", got[0].split(" ++")[0])
    bare = [re.sub(" ", "", p) for p in phones]
    assert bare[0] == bare[1] == bare[4] and bare[2] == bare[3]
    days = re.findall(r"[0-9]+[./-][0-9]+[./-][0-9]+", got[2])
    assert {tuple(sorted(map(int, re.split("[./-]", d)))) for d in days[:4]} == {tuple(sorted(map(int, re.split("[./-]", days[0]))))}
    accounts = re.findall(r"DE[0-9 ]+[0-9]", got[3])
    assert accounts[0].replace(" ", "") == accounts[1] and accounts[2] == "DE88370400440532013000"
    hexes = got[5].split()
    assert hexes[1].lower() == hexes[2] and hexes[3:] == PLANTED[5].split()[3:]
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out, "k", backwards=True).collect()}
    padded = re.sub(r"(?<![0-9.])([0-9]{1,2})\.([0-9]{1,2})\.((?:19|20)[0-9]{2})", lambda m: f"{int(m[1]):02}.{int(m[2]):02}.{m[3]}", back[2])
    assert all(back[i] == t for i, t in enumerate(texts) if i != 2) and padded == "05.03.2024 05.03.2024 2024-03-05 2024/03/05 31.02.2024 30.02.2024 v1.5.3.2024 05.03.2024.1 15.03.2024, 05.12.1999 2024/13/05"


def test_whole_table_equals_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs, "k").collect()}
    assert got == {r["doc_id"]: plain(r["text"], "k") for r in docs.collect()}


def test_lone_characters_are_permuted_and_not_shifted(spark):
    mails = spark.createDataFrame([(f"{c}@x.org",) for c in "abcdefghijklmnopqrstuvwxyz"], "v string")
    new = [(r["v"][0], r["p"][0]) for r in mails.select("v", pii.pseudonym(F.col("v"), F.lit("k")).alias("p")).collect()]
    assert len({b for _, b in new}) == 26 and len({(ord(b) - ord(a)) % 26 for a, b in new}) > 1
