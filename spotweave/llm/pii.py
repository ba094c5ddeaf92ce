"""Format-preserving Feistel pseudonyms of personal numbers and dates, by column expressions alone.

Found values are validated (card numbers by their check digit, account numbers
by their country's length and check digits, dates by the calendar, octets by
range, social security numbers by their blocks) and then permuted within their
format under a key: every character keeps its class (digit, lower, upper),
dates stay dates of 1900 to 2099, card and account numbers get the check digits
of their new characters.  The permutation is one to one on a format and the
same everywhere, so equal values stay linked across documents, whatever their
separators (a phone's or an account's country code stays and has no say), and
the holder of the key can invert it.  A day written without leading zeros whose
pseudonym has none to leave out comes back as the same day with its zeros.

The key is a literal of the plan: take it from a secret store and keep plans
private.  Null texts stay null; empty texts, texts without such values and all
other columns pass through unchanged.  Long texts cost one pass of possessive
patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31, as a product, which makes them a two-digit number of mixed radix.
DAY_RADIX = (17, 4297)
#: A text without a match of this has no value to replace: every match of a form in FORMS holds one (an e-mail its @, octets a dot between digits, a hex token 32 of its characters, the others two digits in a row).
HINT = r"@|[0-9]{2}|[0-9]\.[0-9]|[0-9a-f]{32}|[0-9A-F]{32}"

# The country codes of telephone numbers (ITU-T E.164) of one and two digits; all others have three.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# The lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}


def _iban(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


_L, _R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Kind and form; where several fit at a place, the first does.
FORMS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+" + _R),
    ("ipv4", r"(?<![0-9.\p{L}])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?!\.?[0-9])" + _R),
    ("date_iso", _L + r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}" + _R),
    ("date_year_slash", _L + r"(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}" + _R),
    ("date_slash", _L + r"[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}" + _R),
    ("date_dot", _L + r"[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}" + _R),
    ("date_dot_short", _L + r"(?<![0-9]\.)[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}(?!\.[0-9])" + _R),
    ("iban", _L + r"(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_iban(*i) for i in IBAN_LENGTHS.items()) + ")" + _R),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+[0-9]{8,15}+|\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})" + _R),
    ("ssn", _L + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _R),
    ("card_groups", _L + r"[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{4,5})" + _R),
    ("card", _L + r"[0-9]{13,19}+" + _R),
    ("hex_token", _L + r"(?:(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}+|(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,64}+)" + _R),
]
DATES = {"date_iso": "yyyy-MM-dd", "date_year_slash": "yyyy/MM/dd", "date_slash": "MM/dd/yyyy", "date_dot": "dd.MM.yyyy", "date_dot_short": "d.M.yyyy"}
#: Only one form has a group, so its number is the same here.
PATTERN = "|".join(form for _, form in FORMS)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def feistel(values: Column, radix: Column, key: Column, tag: Column | str, backwards: bool = False) -> Column:
    """A keyed permutation of the arrays of integers below ``radix``: each half in turn is shifted, place by place, by a hash of the other."""
    u = lambda a: F.floor(F.size(a) / 2).cast("int")
    left, right = (lambda a: F.slice(a, F.lit(1), u(a))), (lambda a: F.slice(a, u(a) + 1, F.size(a) - u(a)))
    tag = F.lit(tag) if isinstance(tag, str) else tag

    def shifted(side: Column, other: Column, radices: Column, i: Column) -> Column:
        # One hash of the other half a round; every eight places take another one of that.
        seed = F.sha2(F.concat_ws("|", key, tag, i.cast("string"), F.array_join(other.cast("array<string>"), ",")), 256)
        last = F.floor((F.greatest(F.size(side), F.lit(1)) - 1) / 8).cast("int")
        words = _let(seed, lambda s: F.transform(F.sequence(F.lit(0), last), lambda b: F.when(b == 0, s).otherwise(F.sha2(F.concat(s, b.cast("string")), 256))))

        def one(x: Column, j: Column, w: Column) -> Column:
            r = F.element_at(radices, j + 1)
            by = F.conv(F.substr(F.element_at(w, F.floor(j / 8).cast("int") + 1), j % 8 * 8 + 1, F.lit(8)), 16, 10).cast("bigint") % r
            return F.pmod(x - by if backwards else x + by, r)

        return _let(words, lambda w: F.transform(side, lambda x, j: one(x, j, w)))

    def step(held: Column, i: Column, r: Column) -> Column:
        even = F.struct(shifted(held["l"], held["r"], r["l"], i).alias("l"), held["r"].alias("r"))
        odd = F.struct(held["l"].alias("l"), shifted(held["r"], held["l"], r["r"], i).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    order = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if backwards else range(ROUNDS))])
    cut = lambda a: _let(a, lambda a: F.struct(left(a).alias("l"), right(a).alias("r")))
    return _let(cut(radix), lambda r: F.aggregate(order, cut(values), lambda held, i: step(held, i, r), lambda held: F.concat(held["l"], held["r"])))


def _longs(a: Column) -> Column:
    return a.cast("array<bigint>")


def permute_text(s: Column, key: Column, tag: str, kinds: str = "0-9a-zA-Z", backwards: bool = False) -> Column:
    """``s`` with its characters of ``kinds`` permuted, each within its class; the others stay in place and have no say, so spellings of one value stay linked."""
    letters = 6 if "a-f" in kinds else 26
    code = F.transform(F.regexp_extract_all(s, F.lit(f"[{kinds}]"), F.lit(0)), lambda c: F.ascii(c))

    def laid(code: Column, base: Column) -> Column:
        radix = F.transform(base, lambda b: F.when(b == 48, F.lit(10)).otherwise(F.lit(letters)))
        # A lone character is taken as two places, as with one half empty it would always move by the same step.
        lone, value = F.size(code) == 1, F.zip_with(code, base, lambda c, b: c - b)

        def mixed(radix: Column) -> Column:
            half = (radix[0] / 2).cast("bigint")
            places = F.when(lone, F.array(F.lit(2).cast("bigint"), half)).otherwise(_longs(radix))
            values = F.when(lone, F.array(F.floor(value[0] / half), value[0] % half)).otherwise(_longs(value))
            new = feistel(values, places, key, tag, backwards)
            return _let(new, lambda new: F.when(lone, F.array(new[0] * half + new[1])).otherwise(new))

        new = F.zip_with(_let(radix, mixed), base, lambda v, b: F.chr(v + b))
        return F.array_join(F.zip_with(F.split(s, f"[{kinds}]", -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    base = lambda code: F.transform(code, lambda c: F.when(c < 58, F.lit(48)).when(c < 91, F.lit(65)).otherwise(F.lit(97)))
    return _let(code, lambda code: _let(base(code), lambda base: laid(code, base)))


def check_digit(digits: Column) -> Column:
    """The Luhn digit that completes a string of digits (other characters don't count)."""
    d = F.reverse(F.transform(F.filter(F.split(digits, ""), lambda c: c.between("0", "9")), lambda c: c.cast("int")))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.pmod(10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10, F.lit(10)).cast("string")


def _card(m: Column, key: Column, backwards: bool) -> Column:
    head = F.substr(m, F.lit(1), F.length(m) - 1)
    valid = check_digit(head) == F.substring(m, -1, 1)
    return F.when(valid, _let(permute_text(head, key, "card", "0-9", backwards), lambda new: F.concat(new, check_digit(new))))


def _account(m: Column, key: Column, backwards: bool) -> Column:
    def rest(bban: Column, check: Column | str) -> Column:
        moved = F.concat(bban, F.substring(m, 1, 2), F.lit(check) if isinstance(check, str) else check)
        values = F.transform(F.regexp_extract_all(moved, F.lit("[0-9A-Z]"), F.lit(0)), lambda c: F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
        return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v < 10, 10).otherwise(100) + v) % 97)

    bban, check = F.substr(m, F.lit(5), F.length(m)), F.substring(m, 3, 2)
    valid = check.between("02", "98") & (rest(bban, check) == 1)
    new = permute_text(bban, key, "iban", "0-9A-Z", backwards)
    return F.when(valid, _let(new, lambda new: F.concat(F.substring(m, 1, 2), F.lpad((98 - rest(new, "00")).cast("string"), 2, "0"), new)))


def _date(m: Column, form: str, key: Column, backwards: bool) -> Column:
    origin = F.to_date(F.lit("1900-01-01"))
    day = F.date_diff(F.try_to_timestamp(m, F.lit(form)).cast("date"), origin)
    a, b = DAY_RADIX
    values = F.array((day / b).cast("bigint"), (day % b).cast("bigint"))
    new = feistel(values, _longs(F.array(F.lit(a), F.lit(b))), key, "date", backwards)
    return F.when(day.isNotNull(), _let(new, lambda new: F.date_format(F.date_add(origin, (new[0] * b + new[1]).cast("int")), form)))


def _ssn(m: Column, key: Column, backwards: bool) -> Column:
    area, group, serial = (F.substr(m, F.lit(p), F.lit(n)).cast("bigint") for p, n in ((1, 3), (5, 2), (8, 4)))
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    new = feistel(values, _longs(F.array(F.lit(898), F.lit(99), F.lit(9999))), key, "ssn", backwards)
    return _let(new, lambda new: F.concat_ws("-", pad(new[0] + F.when(new[0] >= 665, 2).otherwise(1), 3), pad(new[1] + 1, 2), pad(new[2] + 1, 4)))


def pseudonym(m: Column, key: Column, backwards: bool = False) -> Column:
    """The pseudonym of one found value, itself if it doesn't validate."""

    def fits(kind: str) -> Column:
        return m.rlike("^(?:" + dict(FORMS)[kind] + ")$")

    at = F.instr(m, "@")
    local = F.substr(m, F.lit(1), at - 1)
    country = F.length(F.regexp_extract(m, "^" + COUNTRY, 0))
    octets = _longs(F.split(m, r"\."))
    by_kind = {
        "email": F.concat(permute_text(local, key, "email", backwards=backwards), F.substr(m, at, F.length(m))),
        "ipv4": F.array_join(feistel(octets, _longs(F.array_repeat(F.lit(256), 4)), key, "ipv4", backwards).cast("array<string>"), "."),
        **{kind: _date(m, form, key, backwards) for kind, form in DATES.items()},
        "phone": F.concat(F.substr(m, F.lit(1), country), permute_text(F.substr(m, country + 1, F.length(m)), key, "phone", "0-9", backwards)),
        "iban": _account(m, key, backwards),
        "ssn": _ssn(m, key, backwards),
        "card_groups": _card(m, key, backwards),
        "card": _card(m, key, backwards),
        "hex_token": permute_text(m, key, "hex", "0-9a-fA-F", backwards),
    }
    out = None
    for kind, _ in FORMS:
        out = F.when(fits(kind), by_kind[kind]) if out is None else out.when(fits(kind), by_kind[kind])
    return F.coalesce(out, m)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, backwards: bool = False) -> DataFrame:
    """``docs`` with every personal value in the text replaced by its pseudonym (``backwards``: by the value it stands for).

    ``count_col`` adds the number of replaced values (in place of a column of that name).  Rows and other columns stay.
    """
    text = F.col(text_col)
    held = next(name for n in range(len(docs.columns) + 1) if (name := f"__found{n}") not in docs.columns)
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("old"), pseudonym(m, F.lit(key), backwards).alias("new")))
    # Text and count both read the found values, which the optimizer therefore leaves in a projection of their own.
    rows = docs.withColumn(held, F.when(text.rlike(HINT), found))
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), F.col(held), lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), "")
    new = {text_col: F.when(F.size(held) > 0, joined).otherwise(text)}
    if count_col:
        new[count_col] = F.coalesce(F.array_size(F.filter(held, lambda p: p["old"] != p["new"])), F.lit(0))
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in [*docs.columns, *([count_col] if count_col and count_col not in docs.columns else [])]])
