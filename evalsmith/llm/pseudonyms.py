"""Personal data: format-preserving Feistel pseudonyms.

Values are found by one pattern, validated by their kind's own rule, and
replaced by a keyed permutation of all values of the same format: a card
number becomes a card number with a right check digit and the same separators,
a date a date, an address an address. Equal values have equal pseudonyms in
every document, different values different ones, and the key reverses them.

A value is a list of numbers, each below a radix of its own (a digit below 10,
an octet below 256, ...). A Feistel network works on the two halves of the
list: in turn, each half gets a keyed SHA-512 stream of the other half added,
number by number, modulo the radix. That is a permutation whatever the radices,
so no value is met twice and nothing has to be looked up or stored.

Only DataFrame functions. Map-only: each text is split where the pattern
matches, the matches are replaced, and the parts joined again.

    email     letters and digits, up to the last dot of the domain
    ip        four octets of an IPv4 address
    phone     digits behind the country code
    card      13 to 19 digits that pass the Luhn check, or else the first
              and longest part of them between separators that does
    ssn       area, group and serial in their valid ranges
    iban      account characters, in either case; as long as its country's,
              passes mod 97
    date      days of 1900-01-01 to 2099-12-31, year first or day first, or
              month first where only that makes a date (12/25/1990); days and
              months of one digit stay so; a time may follow behind a T
    secret    16 characters or more behind token, key, secret or password in
              any case, a closing quote of its own, blanks and = or :; quoted,
              or with a digit; hexadecimal stays so in its case

Defined results: a value that fails its check (a 16-digit number that isn't a
card's, 31 February) stays as it is; a null text stays null; an empty text
stays empty; texts are read whole; repeated rows change alike; columns named
like the results are replaced; an empty table gives an empty one. A permutation may map a value to itself, as
often as chance has it (one date in 73,049).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "phone", "card", "ssn", "iban", "date", "secret")
ROUNDS = 8
#: Most repetitions of the permutation; few values need a second.
WALK = 100

_EMAIL = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
#: A keyword, its closing quote if it has one, and the sign before the value.
_NAMED = r"(?i:token|key|secret|password)[\"']?\s{0,16}[=:]\s{0,16}"
_SECRET = rf"{_NAMED}(?:[\"'][A-Za-z0-9+/_.=-]{{16,}}+(?=[\"'])|(?=[A-Za-z+/_.=-]{{0,64}}\d)[A-Za-z0-9+/_.=-]{{16,}}+)"
_IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
_DATE = r"(?<![\w/.-])(?:(?:19|20)\d\d(?:-\d{1,2}-|/\d{1,2}/)\d{1,2}|\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)(?:19|20)\d\d)(?:(?=T\d)|(?![\w/-]))"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{3,4}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])"
#: Countries by the length of their account numbers; others have any length.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items())
_IBAN = rf"(?<!\w)(?=[A-Za-z]{{2}}\d{{2}})(?:(?i:{_BY_COUNTRY})(?!\w)|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!\w))"
# A blank before a value of another kind ends the digits.
_SEP = rf"(?:-| (?!{_IP}|{_DATE}|{_SSN}|{_PHONE}))"
#: Digits in fours, with one more four (a year before a card) unless a card begins there.
_FOURS = rf"\d{{4}}(?:{_SEP}\d{{4}}){{3}}(?:{_SEP}\d{{4}}(?!(?:[ -]\d{{4}}){{3}}))?(?:{_SEP}\d{{1,3}})?(?!\w)"
#: Other digits, but not a number that stands before a card in fours.
_CARD = rf"(?<![\w.])(?:{_FOURS}|(?!(?:\d{{1,12}}[ -]){{1,4}}{_FOURS})\d(?:{_SEP}?\d){{12,18}}(?!\w))"
#: The first that matches at a place counts. What begins with a digit, plus or
#: bracket is tried there only.
PATTERN = f"{_EMAIL}|{_SECRET}|(?=[0-9+(])(?:{_IP}|{_DATE}|{_SSN}|{_PHONE}|{_CARD})|{_IBAN}"
#: Every value has one of these; texts without are passed by.
_ANY = r"[0-9@]|(?i:token|key|secret|password)"

#: Behind the last place of any value.
_ALL = (1 << 31) - 1
#: Up to so many numbers a half, the stream's blocks are seeded with the other
#: half itself; beyond, with its digest, so that work grows with the length.
_DIRECT = 160
#: 1900-01-01 to 2099-12-31 has 73,049 days = 17 * 4297.
_DAYS = (17, 4297)


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _value(c: Column) -> Column:
    """A letter's or digit's number in its class; 0 for any other."""
    a = F.ascii(c)
    return F.when(c.rlike("^[0-9]$"), a - 48).when(c.rlike("^[a-z]$"), a - 97).when(c.rlike("^[A-Z]$"), a - 65).otherwise(0)


def _radix(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1)


def _char(c: Column, v: Column) -> Column:
    """The character of number ``v`` in the class of ``c``."""
    return F.when(c.rlike("^[0-9]$"), F.char(v + 48)).when(c.rlike("^[a-z]$"), F.char(v + 97)).when(c.rlike("^[A-Z]$"), F.char(v + 65)).otherwise(c)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, every second one doubled, first the
    one at place ``doubled``."""

    def one(acc: Column, x: Column) -> Column:
        d = x.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["i"] + 1).alias("i"), (acc["s"] + F.when(acc["i"] % 2 == doubled, twice).otherwise(d)).alias("s"))

    return F.aggregate(_chars(F.reverse(digits)), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), one)["s"]


#: Digits that could hold a card.
_CARDLIKE = r"^\d(?:[ -]?\d){12,22}$"


def _head(m: Column) -> Column:
    """(at, len) of what counts of a match: of digits that could be a card the
    first and longest part between separators that passes the Luhn check, of a
    secret its value, of any other all."""
    edge = lambda i: F.substring(m, i, F.lit(1)).isin(" ", "-")

    def longest(at: Column) -> Column:
        def passes(n: Column) -> Column:
            digits = _digits(F.substring(m, at, n))
            ends = (at + n - 1 == F.length(m)) | edge(at + n)
            return ends & F.length(digits).between(13, 19) & (_luhn_sum(digits, 1) % 10 == 0)

        room = F.length(m) - at + 1
        ends = F.when(room >= 13, F.filter(F.sequence(F.greatest(room, F.lit(13)), F.lit(13), F.lit(-1)), passes))
        return F.struct(at.alias("at"), F.get(ends, F.lit(0)).alias("len"))

    starts = F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: (i == 1) | edge(i - 1))
    card = F.get(F.filter(F.transform(starts, longest), lambda x: x["len"].isNotNull()), F.lit(0))
    named = F.length(F.regexp_extract(m, rf"^{_NAMED}[\"']?", 0))
    at = F.when(named > 0, named + 1).when(m.rlike(_CARDLIKE), F.coalesce(card["at"], F.lit(1))).otherwise(1)
    n = F.when(m.rlike(_CARDLIKE), F.coalesce(card["len"], F.length(m))).otherwise(F.length(m) - at + 1)
    return F.struct(at.alias("at"), n.alias("len"))


def _mod97(s: Column) -> Column:
    """Of the number that letters (A is 10) and digits spell."""
    s = F.upper(s)

    def one(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(s), F.lit(0), one)


def _date_texts(m: Column) -> tuple[Column, Column, Column]:
    """Year, month and day as written: month first if only that can be one."""
    parts = F.split(m, "[-/.]")
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    year_first, month_first = m.rlike(r"^\d{4}"), _month_first(m)
    return F.when(year_first, a).otherwise(c), F.when(month_first, a).otherwise(b), F.when(year_first, c).when(month_first, b).otherwise(a)


def _month_first(m: Column) -> Column:
    return m.rlike(r"^\d\d?/(?:1[3-9]|[2-9]\d)/\d{4}$")


def _date_parts(m: Column) -> tuple[Column, Column, Column]:
    y, mo, d = (t.cast("int") for t in _date_texts(m))
    return y, mo, d


def _kind(m: Column, before: Column) -> Column:
    """The kind of what counts of a match, null if it fails the kind's check."""
    octets_fit = F.forall(F.split(m, r"\."), lambda o: o.cast("int") < 256)
    y, mo, d = _date_parts(m)
    date_fits = F.when(mo.between(1, 12), d.between(1, F.dayofmonth(F.last_day(F.make_date(y, F.when(mo.between(1, 12), mo).otherwise(1), F.lit(1)))))).otherwise(False)
    ssn_fits = ~m.rlike(r"^(?:000|666|9)") & ~m.rlike(r"-00-") & ~m.rlike(r"0000$")
    bare = F.replace(m, F.lit(" "), F.lit(""))
    iban_fits = _mod97(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))) == 1
    n = F.length(_digits(m))
    return (
        F.when(m.contains("@"), "email")
        .when(before.rlike(f"^{_NAMED}"), "secret")
        .when(m.rlike(r"^\d+(?:\.\d+){3}$") & ~m.rlike(r"\d{4}"), F.when(octets_fit, "ip"))
        .when(m.rlike(r"^(?:\d{4}[-/]\d\d?[-/]\d\d?|\d\d?[./]\d\d?[./]\d{4})$"), F.when(date_fits, "date"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(ssn_fits, "ssn"))
        .when(m.rlike(r"^(?:[+(]|\d{3}-\d{3}-\d{4}$)"), F.when(n.between(7, 15), "phone"))
        .when(m.rlike(r"^[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9])+$"), F.when(iban_fits, "iban"))
        .when(m.rlike(_CARDLIKE), F.when((n <= 19) & (_luhn_sum(_digits(m), 1) % 10 == 0), "card"))
    )


def _hex(s: Column) -> Column:
    """Whether a secret is all hexadecimal: ``lower``, ``upper`` or ``no``."""
    return F.when(s.rlike(r"^[0-9a-f]++$"), "lower").when(s.rlike(r"^[0-9A-F]++$"), "upper").otherwise("no")


def _one_digit_day(m: Column) -> Column:
    return F.length(_date_texts(m)[2]) == 1


def _date_of(m: Column, v: Column) -> Column:
    """The day of numbers ``v`` in the format of ``m``."""
    at = lambda i: F.element_at(v, i)
    return F.when(_one_digit_day(m), F.make_date(at(1) + 1900, at(2) + 1, at(3) + 1)).otherwise(F.date_add(F.lit("1900-01-01").cast("date"), at(1) + at(2) * _DAYS[0]))


def _numbers(m: Column, kind: Column) -> tuple[Column, Column]:
    """(numbers, radices) of a value."""
    chars = _chars(m)
    last = F.length(m)
    # Characters before the first kept place and from the last one on stay.
    start = F.when(kind == "phone", F.length(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0))).when(kind == "iban", F.lit(4)).otherwise(F.lit(0))
    end = F.when(kind == "secret", _ALL).when(kind == "card", last - 1).when(kind == "email", last - F.length(F.substring_index(m, ".", -1))).otherwise(last)
    plain_r = F.transform(chars, lambda c, i: F.when((i >= start) & (i < end), _radix(c)).otherwise(1))
    plain_v = F.transform(chars, lambda c, i: F.when((i >= start) & (i < end), _value(c)).otherwise(0))
    y, mo, d = _date_parts(m)
    day = F.datediff(F.make_date(y, mo, d), F.lit("1900-01-01").cast("date"))
    ints = lambda *xs: F.array(*[x.cast("int") if isinstance(x, Column) else F.lit(x) for x in xs])
    area = F.substring(m, 1, 3).cast("int")
    values = (
        F.when(kind == "ip", F.transform(F.split(m, r"\."), lambda o: o.cast("int")))
        .when((kind == "date") & _one_digit_day(m), ints(y - 1900, mo - 1, d - 1))
        .when(kind == "date", ints(day % _DAYS[0], F.floor(day / _DAYS[0])))
        .when(kind == "ssn", ints(area - F.when(area > 666, 2).otherwise(1), F.substring(m, 5, 2).cast("int") - 1, F.substring(m, 8, 4).cast("int") - 1))
        .when((kind == "secret") & (_hex(m) != "no"), F.transform(chars, lambda c: F.conv(c, 16, 10).cast("int")))
        .otherwise(plain_v)
    )
    radices = (
        F.when(kind == "ip", F.array_repeat(F.lit(256), 4))
        .when((kind == "date") & _one_digit_day(m), ints(200, F.when(F.length(_date_texts(m)[1]) == 1, 9).otherwise(12), 9))
        .when(kind == "date", ints(*_DAYS))
        .when(kind == "ssn", ints(898, 99, 9999))
        .when((kind == "secret") & (_hex(m) != "no"), F.transform(chars, lambda c: F.lit(16)))
        .otherwise(plain_r)
    )
    return values, radices


def _network(halves: Column, radix: Column, key: str, tweak: Column, rounds: int, back: bool) -> Column:
    """The two halves (struct of arrays a, b) after all rounds."""

    def step(state: Column, r: Column) -> Column:
        def add(target: str, source: str) -> Column:
            seed = F.concat_ws(":", F.lit(key), tweak, r.cast("string"), F.array_join(F.transform(state[source], lambda x: x.cast("string")), ","))

            def with_stream(stream: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    y = F.conv(F.substring(F.get(stream, F.shiftright(i, 4)), (i % 16) * 8 + 1, F.lit(8)), 16, 10).cast("long")
                    return F.pmod(x - y if back else x + y, F.get(radix[target], i)).cast("int")

                return F.transform(state[target], one)

            # Sixteen numbers of 32 bits from each block of the stream.
            def with_seed(seed: Column) -> Column:
                ks = F.sequence(F.lit(0), F.floor(F.size(state[target]) / 16).cast("int"))
                return _let(F.transform(ks, lambda k: F.sha2(F.concat_ws(":", seed, k.cast("string")), 512)), with_stream)

            return _let(F.when(F.size(state[source]) > _DIRECT, F.sha2(seed, 512)).otherwise(seed), with_seed)

        return F.struct(
            F.when(r % 2 == 0, add("a", "b")).otherwise(state["a"]).alias("a"),
            F.when(r % 2 == 1, add("b", "a")).otherwise(state["b"]).alias("b"),
        )

    order = F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(order, halves, step)


def feistel(values: Column, radices: Column, key: str, tweak: Column, rounds: int = ROUNDS, back: bool = False) -> Column:
    """The keyed permutation of ``values`` (array of int, each below its
    radix), or its inverse. Numbers that can change (radix above 1) alternate
    between the halves, so that each half has some of every part of the value;
    what stands between them, such as separators, makes no difference."""
    places = F.filter(F.transform(radices, lambda r, i: F.when(r > 1, i).otherwise(-1)), lambda i: i >= 0)

    def with_places(at: Column) -> Column:
        half = lambda a, h: F.transform(F.filter(at, lambda x, j: j % 2 == h), lambda i: F.get(a, i))
        halves = lambda a: F.struct(half(a, 0).alias("a"), half(a, 1).alias("b"))

        def put_back(done: Column) -> Column:
            new = F.transform(at, lambda i, j: F.struct(i.alias("i"), F.get(F.when(j % 2 == 0, done["a"]).otherwise(done["b"]), F.shiftright(j, 1)).alias("x")))
            kept = F.filter(F.transform(values, lambda x, i: F.struct(i.alias("i"), F.when(F.get(radices, i) <= 1, x).alias("x"))), lambda s: s["x"].isNotNull())
            return F.transform(F.array_sort(F.concat(new, kept)), lambda s: s["x"])

        done = _let(halves(radices), lambda radix: _network(halves(values), radix, key, tweak, rounds, back))
        return _let(done, put_back)

    return _let(places, with_places)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _render(m: Column, kind: Column, v: Column) -> Column:
    """The value of numbers ``v`` in the format of ``m``."""
    at = lambda i: F.element_at(v, i)
    # A kept character has radix 1 and so number 0: it is told by its place.
    chars = _chars(m)
    start = F.when(kind == "phone", F.length(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0))).when(kind == "iban", F.lit(4)).otherwise(F.lit(0))
    end = F.when(kind == "secret", _ALL).when(kind == "card", F.length(m) - 1).when(kind == "email", F.length(m) - F.length(F.substring_index(m, ".", -1))).otherwise(F.length(m))
    plain = F.array_join(F.transform(chars, lambda c, i: F.when((i >= start) & (i < end), _char(c, F.element_at(v, i + 1))).otherwise(c)), "")
    iso = F.date_format(_date_of(m, v), "yyyy-MM-dd")
    _, month_text, day_text = _date_texts(m)
    y = F.substring(iso, 1, 4)
    mo = F.when(F.length(month_text) == 1, F.substring(iso, 7, 1)).otherwise(F.substring(iso, 6, 2))
    d = F.when(F.length(day_text) == 1, F.substring(iso, 10, 1)).otherwise(F.substring(iso, 9, 2))
    sep = F.regexp_extract(m, "[-/.]", 0)
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    check = (F.lit(10) - _luhn_sum(_digits(body), 0) % 10) % 10
    bare = F.replace(plain, F.lit(" "), F.lit(""))
    hexadecimal = F.array_join(F.transform(v, lambda x: F.hex(x)), "")
    control = F.lit(98) - _mod97(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 2), F.lit("00")))
    return (
        F.when(kind == "ip", F.array_join(F.transform(v, lambda x: x.cast("string")), "."))
        .when(kind == "date", F.when(m.rlike(r"^\d{4}"), F.concat_ws("", y, sep, mo, sep, d)).when(_month_first(m), F.concat_ws("", mo, sep, d, sep, y)).otherwise(F.concat_ws("", d, sep, mo, sep, y)))
        .when(kind == "ssn", F.concat_ws("-", F.lpad((at(1) + F.when(at(1) >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((at(2) + 1).cast("string"), 2, "0"), F.lpad((at(3) + 1).cast("string"), 4, "0")))
        .when((kind == "secret") & (_hex(m) == "lower"), F.lower(hexadecimal))
        .when((kind == "secret") & (_hex(m) == "upper"), hexadecimal)
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "iban", F.concat(F.substring(plain, 1, 2), F.lpad(control.cast("string"), 2, "0"), F.substring(plain, F.lit(5), F.length(plain))))
        .otherwise(plain)
    )


def _fits(s: Column, v: Column) -> Column:
    """Whether the value of numbers ``v`` is found again as ``s.m`` was."""
    head, kind, part = s["m"], s["kind"], (s["before"] != "") | (s["rest"] != "")

    def as_before(x: Column) -> Column:
        place = _head(F.concat(s["before"], x, s["rest"]))
        digits = x.rlike("[0-9]") | ~head.rlike("[0-9]")
        same = (place["at"] == F.length(s["before"]) + 1) & (place["len"] == F.length(x))
        return F.when(kind == "card", same).otherwise((_hex(x) == _hex(head)) & digits)

    day = _date_of(head, v)
    one_digit_month = F.length(_date_texts(head)[1]) == 1
    date_fits = (~one_digit_month | (F.month(day) < 10)) & (~_month_first(head) | (F.dayofmonth(day) > 12))
    return F.when(kind == "date", date_fits).when(((kind == "card") & part) | (kind == "secret"), _let(_render(head, kind, v), as_before)).otherwise(True)


def _walk(s: Column, key: str, back: bool) -> Column:
    """The permutation, repeated until the value fits: a permutation of the
    values that fit. About half of all do, wherever some don't."""

    def step(state: Column, _: Column) -> Column:
        moved = lambda w: F.struct(w.alias("v"), _fits(s, w).alias("done"))
        return F.when(state["done"], state).otherwise(_let(feistel(state["v"], s["r"], key, s["kind"], back=back), moved))

    start = F.struct(s["v"].alias("v"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step)["v"]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out: str = "text", found_col: str = "pii", back: bool = False) -> DataFrame:
    """``docs`` with the pseudonymised text in ``out`` and an array of (kind,
    pseudonym) of the values replaced, in order, in ``found_col``. ``back``
    turns pseudonyms into the values again."""
    text = F.col(text_col)
    step = docs.withColumn("__pii", F.when(text.rlike(_ANY), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))

    around = lambda s: [s["before"].alias("before"), s["m"].alias("m"), s["rest"].alias("rest")]

    def with_parts(s: Column) -> Column:
        m, at, n = s["all"], s["head"]["at"], s["head"]["len"]
        part = lambda a, k, name: F.substring(m, a, k).alias(name)
        return F.struct(part(F.lit(1), at - 1, "before"), part(at, n, "m"), part(at + n, F.length(m), "rest"))

    def with_kind(s: Column) -> Column:
        return F.struct(*around(s), _kind(s["m"], s["before"]).alias("kind"))

    def with_numbers(s: Column) -> Column:
        v, r = _numbers(s["m"], s["kind"])
        return F.struct(*around(s), s["kind"].alias("kind"), F.when(s["kind"].isNotNull(), v).alias("v"), r.alias("r"))

    def moved(s: Column) -> Column:
        v = F.when(s["kind"].isNotNull(), _walk(s, key, back))
        return F.struct(*around(s), s["kind"].alias("kind"), v.alias("v"))

    def rendered(s: Column) -> Column:
        value = F.when(s["kind"].isNull(), s["m"]).otherwise(_render(s["m"], s["kind"], s["v"]))
        return F.struct(s["kind"].alias("kind"), value.alias("value"), s["before"].alias("before"), s["rest"].alias("rest"))

    # One column a step; each lambda then names the step before it once.
    step = step.withColumn("__pii", F.transform("__pii", lambda m: F.struct(m.alias("all"), _head(m).alias("head"))))
    step = step.withColumn("__pii", F.transform("__pii", with_parts))
    for then in (with_kind, with_numbers, moved, rendered):
        step = step.withColumn("__pii", F.transform("__pii", then))
    hits = F.col("__pii")
    parts = F.transform(F.split(text, PATTERN, -1), lambda p, i: F.concat(p, F.coalesce(F.concat(F.get(hits, i)["before"], F.get(hits, i)["value"], F.get(hits, i)["rest"]), F.lit(""))))
    step = step.withColumn(out, F.when(F.size(hits) > 0, F.array_join(parts, "")).otherwise(text))
    return step.withColumn(found_col, F.transform(F.filter("__pii", lambda s: s["kind"].isNotNull()), lambda s: s.dropFields("before", "rest"))).drop("__pii")
