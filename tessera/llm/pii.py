"""Operator 1: format-preserving Feistel pseudonyms for personal data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import fresh, let

# The forms that are looked for, and the alphabets that a character stays in.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
PASSWORD = r"(?i:(?<![A-Za-z])password=)[^\s\"']{4,}"
HEX_TOKEN = r"(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
NANP = r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"
PHONE = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])"
CARD = r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"
# IBANs and cards are looked for inside whole runs of tokens, as neighbours may look like a part of them. No other form that may go beyond a run starts in it.
_CROSSING = "|".join((EMAIL, ACCESS_KEY, PASSWORD, IPV4, DATE, rf"(?=[0-9 -]{{1,8}}\.)(?:{NANP})"))
RUN = (
    r"(?:(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2})|(?<![0-9A-Za-z.-])(?=[0-9](?:[ -]?[0-9]){12}))"
    rf"[A-Z0-9]++(?![A-Za-z]|\.[0-9])(?:[ -](?!{_CROSSING})[A-Z0-9]++(?![A-Za-z]|\.[0-9]))*+"
)
PLAIN = "|".join((EMAIL, ACCESS_KEY, PASSWORD, HEX_TOKEN, IPV4, DATE, SOCIAL, NANP, PHONE))
FORMS = rf"{PLAIN}|{IBAN}(?=\.[0-9])|{RUN}"
GROUPED_CARD = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})$"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
MOST_TOKENS = 19
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"
ROUNDS = 8
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1800-01-01", 400, 300  # 120,000 days, to 2128-07-19
IBAN_LETTERS_FROM = 10
# 3,936 months (to 2127-12) hold so many days after the twelfth: 733 * 99. Month-first dates that can't be read day first are among them.
LATE_HIGH, LATE_LOW, TWELFTH = 733, 99, 12
# Country calling codes of one and two digits; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
# A cheap search that every one of the FORMS implies: a number has three digits in a row or a separator between two.
HIT = r"[0-9]{3}|[0-9][ .-][0-9]|@|AKIA|(?i:password=)|[A-Z]{2}[0-9]{2}|\+[1-9]|[0-9a-f]{40}"


def _hash(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts), F.lit(key)), 256)


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def feistel_number(n: Column, high: Column | int, low: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. high * low - 1: alternating Feistel rounds on (n div low, n mod low)."""
    high, low = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (high, low))

    def turn(s: Column, i: Column) -> Column:
        add = lambda x: _number(F.substring(_hash(key, kind, i, x), 1, 15))
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, F.pmod(s["a"] + F.pmod(add(s["b"]), high), high)).otherwise(s["a"]).alias("a"), F.when(~even, F.pmod(s["b"] + F.pmod(add(s["a"]), low), low)).otherwise(s["b"]).alias("b"))

    start = F.struct(((n - F.pmod(n, low)) / low).cast("long").alias("a"), F.pmod(n, low).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * low + s["b"])


def feistel_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of as many digits (1 to 18)."""
    # Halves as numbers: 10 ** (length div 2) and the rest; the result keeps leading zeros.
    n = F.length(digits)
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    half = F.floor(n / 2)
    return F.lpad(feistel_number(digits.cast("long"), ten(half), ten(n - half), key, kind).cast("string"), n, "0")


def feistel_text(text: Column, key: str, kind: str, alphabets: tuple[str, ...] = (DIGITS, UPPER, LOWER)) -> Column:
    """A keyed permutation of strings of one pattern: a character of an alphabet stays in it, others stay as they are.

    The halves of the string take turns; each shifts its characters by a key stream hashed from the other.
    """

    def shifted(c: Column, by: Column) -> Column:
        out = None
        for a in alphabets:
            moved = F.substr(F.lit(a), (F.pmod(F.instr(F.lit(a), c) - 1 + by, F.lit(len(a))) + 1).cast("int"), F.lit(1))
            out = (F if out is None else out).when(F.instr(F.lit(a), c) > 0, moved)
        return out.otherwise(c)

    def half(x: Column, other: Column, i: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 16).cast("int")), lambda b: _hash(key, kind, i, b, other))
        chars = lambda hs: F.transform(
            F.split(x, ""), lambda c, j: shifted(c, _number(F.substr(F.element_at(hs, (F.floor(j / 16) + 1).cast("int")), (F.pmod(j, F.lit(16)) * 4 + 1).cast("int"), F.lit(4))))
        )
        return F.when(F.length(x) == 0, x).otherwise(F.array_join(let(blocks, chars), ""))

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, half(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"), F.when(~even, half(s["b"], s["a"], i)).otherwise(s["b"]).alias("b"))

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1, F.length(text)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _written_as(form: Column, chars: Column, pattern: str = "[0-9]") -> Column:
    """``form`` with its characters of ``pattern``, in order, replaced by those of ``chars``."""
    place = lambda i: F.length(F.regexp_replace(F.substr(form, F.lit(1), i), pattern.replace("[", "[^", 1), ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: let(F.substr(form, i, F.lit(1)), lambda c: F.when(c.rlike(pattern), F.substr(chars, place(i), F.lit(1))).otherwise(c))), "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload and digit valid."""
    def add(acc: Column, j: Column) -> Column:
        d = F.substr(payload, F.length(payload) - j + 1, F.lit(1)).cast("int")
        return acc + F.when(F.pmod(j, F.lit(2)) == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _luhn_valid(digits: Column) -> Column:
    return luhn_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits), F.lit(1))


def _mod97(text: Column) -> Column:
    def add(acc: Column, j: Column) -> Column:
        return let(F.instr(F.lit(DIGITS + UPPER), F.substr(text, j, F.lit(1))) - 1, lambda v: F.pmod(F.when(v >= IBAN_LETTERS_FROM, acc * 100 + v).otherwise(acc * 10 + v), F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _iban_valid(bare: Column) -> Column:
    return _mod97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(bare, F.lit(1), F.lit(4)))) == 1


def _iban(x: Column, key: str) -> Column:
    bare = F.regexp_replace(x, " ", "")
    country = F.substr(bare, F.lit(1), F.lit(2))
    body = F.substr(bare, F.lit(5), F.length(bare))
    valid = _iban_valid(bare)
    new = let(feistel_text(body, key, "iban"), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    return F.when(valid, let(new, lambda n: _written_as(x, n, "[A-Z0-9]")))


def _date(x: Column, key: str, pattern: str) -> Column:
    day = F.datediff(F.try_to_timestamp(x, F.lit(pattern)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = lambda d: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), feistel_number(d, DAYS_HIGH, DAYS_LOW, key, "date").cast("int")), pattern)
    return let(day, lambda d: F.when((d >= 0) & (d < DAYS_HIGH * DAYS_LOW), moved(d)))


def _month_first(x: Column, key: str) -> Column:
    """MM/dd/yyyy with a day over 12, so that it can't be dd/MM/yyyy too: permuted among all such dates, numbered without the days up to the twelfth."""
    first = F.lit(FIRST_DAY).cast("date")
    day = F.try_to_timestamp(x, F.lit("MM/dd/yyyy")).cast("date")
    month = lambda d: (F.year(d) - 1800) * 12 + F.month(d) - 1
    start = lambda m: F.add_months(first, m.cast("int"))
    before = lambda m: F.datediff(start(m), first).cast("long") - m * TWELFTH  # noqa: E731  late days before a month
    number = lambda d: before(month(d)) + F.dayofmonth(d) - TWELFTH - 1
    guess = lambda n: F.floor(n / (146097 / 4800 - TWELFTH)).cast("long")  # noqa: E731  a mean month has 146097 / 4800 days

    def written(n: Column) -> Column:
        months = F.filter(F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda k: guess(n) + k), lambda m: (m >= 0) & (before(m) <= n))
        return let(F.array_max(months), lambda m: F.date_format(F.date_add(start(m), (n - before(m) + TWELFTH).cast("int")), "MM/dd/yyyy"))

    found = F.when((F.dayofmonth(day) > TWELFTH) & (F.year(day) >= 1800), number(day))
    return let(found, lambda n: F.when((n >= 0) & (n < LATE_HIGH * LATE_LOW), let(feistel_number(n, LATE_HIGH, LATE_LOW, key, "month first"), written)))


def _ipv4(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    value = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, v: acc * 256 + v)
    new = lambda n: F.array_join(F.transform(F.array(*(F.lit(s) for s in (24, 16, 8, 0))), lambda s: F.pmod(F.floor(n / F.pow(F.lit(2.0), s)).cast("long"), F.lit(256)).cast("string")), ".")
    return let(parts, lambda a: F.when(F.forall(a, lambda v: v <= 255), let(feistel_number(value(a), 65536, 65536, key, "ipv4"), new)))


def _social(x: Column, key: str) -> Column:
    d = _only_digits(x)
    area, group, serial = (F.substr(d, F.lit(a), F.lit(b)).cast("long") for a, b in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas, 99 groups, 9999 serials
    n = place * 99 * 9999 + (group - 1) * 9999 + serial - 1
    out = lambda m: let(
        F.struct(F.floor(m / (99 * 9999)).cast("long").alias("p"), F.pmod(F.floor(m / 9999).cast("long"), F.lit(99)).alias("g"), F.pmod(m, F.lit(9999)).alias("s")),
        lambda t: F.concat_ws("-", F.lpad(F.when(t["p"] >= 665, t["p"] + 2).otherwise(t["p"] + 1).cast("string"), 3, "0"), F.lpad((t["g"] + 1).cast("string"), 2, "0"), F.lpad((t["s"] + 1).cast("string"), 4, "0")),
    )
    return F.when(valid, let(feistel_number(n, 898, 99 * 9999, key, "ssn"), out))


def _nanp(x: Column, key: str) -> Column:
    """Area codes and exchanges stay in 200-999; the country code stays."""
    d = F.regexp_extract(_only_digits(x), "([0-9]{10})$", 1)
    lead = F.length(_only_digits(x)) - 10
    n = (F.substr(d, F.lit(1), F.lit(3)).cast("long") - 200) * 8_000_000 + (F.substr(d, F.lit(4), F.lit(3)).cast("long") - 200) * 10_000 + F.substr(d, F.lit(7), F.lit(4)).cast("long")
    new = lambda m: F.concat((F.floor(m / 8_000_000) + 200).cast("string"), (F.pmod(F.floor(m / 10_000).cast("long"), F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(m, F.lit(10_000)).cast("string"), 4, "0"))
    return let(feistel_number(n, 800, 8_000_000, key, "nanp"), lambda m: _written_as(x, F.concat(F.substr(_only_digits(x), F.lit(1), lead), new(m))))


def _phone(x: Column, key: str) -> Column:
    """The digits after the country code, however they are grouped; numbers under +1 as those without it."""
    d = _only_digits(x)
    codes = F.array(*(F.lit(c) for c in SHORT_CODES.split()))
    lead = F.when(F.array_contains(codes, F.substr(d, F.lit(1), F.lit(1))), 1).when(F.array_contains(codes, F.substr(d, F.lit(1), F.lit(2))), 2).otherwise(3)
    new = F.concat(F.substr(d, F.lit(1), lead), feistel_digits(F.substr(d, lead + 1, F.length(d)), key, "phone"))
    other = F.when(F.length(d).between(8, 15) & (F.substr(d, F.lit(1), F.lit(1)) != "1"), let(new, lambda n: _written_as(x, n)))
    return F.when(d.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$"), _nanp(x, key)).otherwise(other)


def _card(x: Column, key: str) -> Column:
    d = _only_digits(x)
    new = let(feistel_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), lambda p: _written_as(x, F.concat(p, luhn_digit(p))))
    return F.when(_luhn_valid(d), new)


def _email(x: Column, key: str) -> Column:
    ending = F.regexp_extract(x, r"(\.[A-Za-z]+)$", 1)
    return F.concat(feistel_text(F.substr(x, F.lit(1), F.length(x) - F.length(ending)), key, "email"), ending)


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def pseudonym(x: Column, key: str) -> Column:
    """(kind, value) for a string of one of the PLAIN forms; null where it isn't valid."""
    bare = lambda k: F.substr(x, F.lit(k + 1), F.length(x))
    kinds: list[tuple[str, str, Callable[[], Column]]] = [
        ("email", EMAIL, lambda: _email(x, key)),
        ("access_key", ACCESS_KEY, lambda: F.concat(F.lit("AKIA"), feistel_text(bare(4), key, "access_key"))),
        ("password", PASSWORD, lambda: F.concat(F.substr(x, F.lit(1), F.lit(9)), F.when(bare(9).rlike("^[0-9a-f]+$"), feistel_text(bare(9), key, "password", (HEX,))).otherwise(feistel_text(bare(9), key, "password")))),
        ("hex_token", HEX_TOKEN, lambda: feistel_text(x, key, "hex", (HEX,))),
        ("ipv4", IPV4, lambda: _ipv4(x, key)),
        ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", lambda: _date(x, key, "yyyy-MM-dd")),
        ("date", r"[0-9]{2}/[0-9]{2}/[0-9]{4}", lambda: F.coalesce(_date(x, key, "dd/MM/yyyy"), _month_first(x, key))),
        ("date", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", lambda: _date(x, key, "dd.MM.yyyy")),
        ("social", SOCIAL, lambda: _social(x, key)),
        ("phone", NANP, lambda: _nanp(x, key)),
        ("phone", PHONE, lambda: _phone(x, key)),
    ]
    out = F
    for kind, pattern, new in kinds:
        # The look-arounds held where the string was found; alone, it has no neighbours.
        out = out.when(x.rlike(_whole(pattern)), F.struct(F.lit(kind).alias("kind"), new().alias("value")))
    return out


def _replaced(text: Column, forms: str, found: Column, new: Callable[[Column], Column]) -> Column:
    """(t, k): ``text`` with what was ``found`` of the ``forms`` replaced by t of ``new``, and the kinds k of all that was."""

    def joined(news: Column) -> Column:
        both = F.zip_with(found, news, lambda x, n: F.coalesce(n["t"], x))
        whole = F.array_join(F.zip_with(F.split(text, forms, -1), both, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
        return F.struct(whole.alias("t"), F.flatten(F.filter(F.transform(news, lambda n: n["k"]), lambda k: k.isNotNull())).alias("k"))

    return let(F.transform(found, new), joined)


def _plain(x: Column, key: str) -> Column:
    return let(pseudonym(x, key), lambda n: F.when(n["value"].isNotNull(), F.struct(n["value"].alias("t"), F.array(n["kind"]).alias("k"))))


def _rank(w: Column, whole: Column) -> Column:
    """The order in which spans of a run are taken; null for a span that is neither a valid IBAN nor a valid card number."""
    bare = F.regexp_replace(w, "[ -]", "")
    length = F
    for n, countries in IBAN_LENGTHS.items():
        length = length.when(F.substr(w, F.lit(1), F.lit(2)).isin(*countries.split()), n)
    iban, card = w.rlike(_whole(IBAN)), w.rlike(_whole(CARD))
    as_iban = F.when(F.length(bare) == length, 0).when(whole, 1).when(length.isNull(), 4)
    as_card = F.when(whole, 1).when(w.rlike(GROUPED_CARD), 2).otherwise(3)
    return F.when(iban, F.when(_iban_valid(bare), as_iban)).when(card, F.when(_luhn_valid(bare), as_card))


def _run(x: Column, key: str) -> Column:
    """(t, k) of a run: its spans of whole tokens that are IBANs (of their country's length) or card numbers are replaced, and plain forms between them.

    Of spans that overlap, an IBAN of its country's length comes first, then the whole run, cards in usual groups, other cards and IBANs of
    countries not listed, longer ones before shorter ones.
    """

    def chosen(p: Column) -> Column:
        m = F.size(p)
        span = lambda i, j: F.regexp_replace(F.array_join(F.slice(p, i, j - i + 1), ""), "[ -]$", "")
        entry = lambda i, j: let(span(i, j), lambda w: F.struct(_rank(w, (i == 1) & (j == m)).alias("rank"), (-F.length(w)).alias("less"), i.alias("i"), j.alias("j"), w.alias("w")))
        spans = F.flatten(F.transform(F.sequence(F.lit(1), m), lambda i: F.filter(F.transform(F.sequence(i, F.least(m, i + MOST_TOKENS - 1)), lambda j: entry(i, j)), lambda e: e["rank"].isNotNull())))
        free = lambda acc, e: ~F.exists(acc, lambda a: (a["i"] <= e["j"]) & (e["i"] <= a["j"]))
        taken = let(spans, lambda all_: F.aggregate(F.array_sort(all_), F.slice(all_, 1, 0), lambda acc, e: F.when(free(acc, e), F.concat(acc, F.array(e))).otherwise(acc)))
        return F.array_sort(F.transform(taken, lambda e: F.struct(e["i"].alias("i"), e["j"].alias("j"), e["w"].alias("w"))))

    def rebuilt(p: Column) -> Column:
        text = lambda i, j: F.array_join(F.slice(p, i, F.greatest(j - i + 1, F.lit(0))), "")
        end = F.struct((F.size(p) + 1).alias("i"), (F.size(p) + 1).alias("j"), F.lit("").alias("w"))
        start = F.struct(F.lit(1).alias("at"), F.lit("").alias("t"), F.array().cast("array<string>").alias("k"))

        def step(s: Column, e: Column) -> Column:
            gap = let(text(s["at"], e["i"] - 1), lambda g: _replaced(g, PLAIN, F.regexp_extract_all(g, F.lit(PLAIN), F.lit(0)), lambda y: _plain(y, key)))
            iban = e["w"].rlike(_whole(IBAN))
            new = F.when(e["w"] == "", "").when(iban, _iban(e["w"], key)).otherwise(_card(e["w"], key))
            after = F.substr(text(e["i"], e["j"]), F.length(e["w"]) + 1, F.lit(1))
            kind = F.when(e["w"] == "", F.array().cast("array<string>")).otherwise(F.array(F.when(iban, "iban").otherwise("card")))
            return let(gap, lambda g: F.struct((e["j"] + 1).alias("at"), F.concat(s["t"], g["t"], new, after).alias("t"), F.concat(s["k"], g["k"], kind).alias("k")))

        return let(chosen(p), lambda c: F.aggregate(F.concat(c, F.array(end)), start, step, lambda s: F.struct(s["t"].alias("t"), s["k"].alias("k"))))

    return let(F.regexp_extract_all(x, F.lit("[A-Z0-9]+[ -]?"), F.lit(0)), rebuilt)


def pseudonymise(df: DataFrame, key: str = "tessera", text: str = "text") -> DataFrame:
    """``df`` with personal data in ``text`` replaced by pseudonyms of the same form, and n_pii and pii_kinds.

    Found are e-mail addresses, access keys, passwords, 40-digit tokens, IBANs, IPv4 addresses, dates, social security numbers,
    phone and card numbers; numbers and dates only if valid (checksums, octets, numbering plan of +1, calendar from 1800-01-01 to 2128-07-19, or to
    2127-12-31 for month/day/year with a day over 12; other slashed dates are read as day/month/year).
    Under one key a kind's replacement is a permutation within its form, and the results are valid again: equal values get equal pseudonyms
    in all documents, different values different ones. Lengths stay the same. A null text stays null, with 0 found; a
    table without rows gives none. Columns called n_pii and pii_kinds are replaced.
    """

    def replacement(x: Column) -> Column:
        return F.when(x.rlike(_whole(PLAIN)), _plain(x, key)).otherwise(_run(x, key))

    def rewritten(found: Column) -> Column:
        return _replaced(F.col(text), FORMS, found, replacement)

    none = F.struct(F.col(text).alias("t"), F.array().cast("array<string>").alias("k"))
    found = F.when(F.col(text).rlike(HIT), F.regexp_extract_all(F.col(text), F.lit(FORMS), F.lit(0)))
    keep = [c for c in df.columns if c not in ("n_pii", "pii_kinds")]
    at, new = fresh(df, "_found"), fresh(df, "_new")
    out = df.withColumn(at, found).withColumn(new, F.when(F.size(at) > 0, rewritten(F.col(at))).otherwise(none))
    kinds = F.array_join(F.array_sort(F.array_distinct(f"{new}.k")), ",")
    return out.select(*(F.col(f"{new}.t").alias(c) if c == text else F.col(c) for c in keep), F.size(f"{new}.k").cast("long").alias("n_pii"), kinds.alias("pii_kinds"))
