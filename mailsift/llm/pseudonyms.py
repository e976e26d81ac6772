"""Format-preserving pseudonyms for personal numbers, addresses and dates.

Each value is read as digits of mixed radices and permuted by a keyed Feistel network: the halves take turns in being
shifted, place by place, by a hash of the other half.  The permutation maps the values of a format onto themselves and
depends on the key and the kind only, so equal values stay equal in all documents, different ones stay different, and
`reveal=True` with the same key undoes it.  Separators, letter case and check digits stay valid.

| kind   | checked by                  | permuted                                        |
|--------|-----------------------------|-------------------------------------------------|
| email  | form                        | letters and digits before the `@`               |
| secret | 32 to 128 hex digits        | hex digits                                      |
| iban   | sum modulo 97               | letters and digits after the check digits       |
| card   | Luhn sum, 13 to 19 digits, at every start and length of a run of digits | all digits but the check digit |
| ssn    | area, group, serial ranges  | area, group, serial within their ranges         |
| phone  | 7 to 15 digits              | digits after the country code                   |
| ip     | four octets                 | octets                                          |
| date   | calendar, 1900-01-01 to 2100-05-01; day first, month first where that is no date | the day |

Values of a form that fail their check are left alone.  An IBAN ends where its country's length says; runs of other
lengths are tested as a whole.

A card may stand beside other numbers, so spans of whole digit groups at every start of a run are tested: single groups
first, then the usual groupings, then the longest.  All groups of a span but the last have three digits or more, so that
columns of small numbers are no cards; only a whole run may be grouped in any way.  Where a pseudonym would make an earlier span valid, it is permuted again until
the run is read as before (cycle walking), and likewise a month-first date until it is no day-first one.  So `reveal`
stays exact; in such a run, about one in ten with one earlier span, a card has another pseudonym than elsewhere, and a
month-first date has another one than the same day in other forms.  After WALK turns, which takes a run with very many
earlier spans, the last permutation stands.

Defined results: a null text stays null with no kinds; an empty text stays empty; rows are never joined or dropped, so
repeated rows and keys give equal rows; other columns of the input are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
#: Days of the date domain: 270 x 271 from 1900-01-01.
DATE_RADICES = (270, 271)
DATE_START = "1900-01-01"

#: Turns of cycle walking at most.
WALK = 64
#: Signs of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Usual groupings of cards: a digit that ends its group is `e`, any other one `a`.
CARD_GROUPS = ("aaaeaaaeaaaeaaae", "aaaeaaaaaeaaaae", "aaaeaaaaaeaaae")


def _iban_form(signs: int, lands: str) -> str:
    groups, rest = divmod(signs - 4, 4)
    tail = rf" ?[0-9A-Z]{{{rest}}}" if rest else ""
    return rf"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{groups}}}{tail}"


_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])(?:" + "|".join(_iban_form(n, lands) for n, lands in IBAN_LENGTHS.items())
            + r"|[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
          r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "date": r"(?<![0-9/.-])(?:(?:19|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.](?:19|20|21)[0-9]{2})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
}
# A run of digits up to a value of another kind.  Each turn takes one sign, so that runs of any length need no stack.
_PATTERNS["card"] = (r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9](?:[0-9 -](?<![ -](?![0-9]))(?<![ -](?="
                     + "|".join(f"(?:{p})" for p in _PATTERNS.values()) + r")))++")
PATTERN = "|".join(f"(?:{p})" for p in _PATTERNS.values())
#: Nothing can be found in a text without one of these.
LIKELY = r"[0-9]{2}|@|[0-9a-fA-F]{32}"


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shift(own: Column, radices: Column, other: Column, key: str, kind: Column, turn: Column, back: bool) -> Column:
    """`own` with each place moved by a hash of the other half, modulo its radix."""
    mark = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), F.array_join(other.cast("array<string>"), ","))

    def moved(digest):
        def place(v, i):
            step = F.conv(F.substr(digest, (i % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.pmod(v - step if back else v + step, F.get(radices, i))
        return F.transform(own, place)

    return let(F.sha2(F.concat_ws("|", mark, F.size(own).cast("string")), 512), moved)


def permute(values: Column, radices: Column, key: str, kind: Column, reveal: bool = False) -> Column:
    """A keyed bijection of the digit arrays of the given radices."""
    cut = F.floor((F.size(values) + 1) / 2).cast("int")
    rest = F.size(values) - cut
    ra, rb = F.slice(radices, F.lit(1), cut), F.slice(radices, cut + 1, rest)
    halves = F.struct(F.slice(values, F.lit(1), cut).alias("a"), F.slice(values, cut + 1, rest).alias("b"))

    def turn(acc, r):
        a, b = acc["a"], acc["b"]
        return F.when(r % 2 == 0, F.struct(_shift(a, ra, b, key, kind, r, reveal).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), _shift(b, rb, a, key, kind, r, reveal).alias("b")))

    turns = F.array(*[F.lit(r) for r in (range(ROUNDS)[::-1] if reveal else range(ROUNDS))])
    return F.aggregate(turns, halves, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _code(c: Column) -> Column:
    """0-9 for digits, 0-25 for ASCII letters; null for all else."""
    return (F.when(c.between("0", "9"), F.ascii(c) - 48).when(c.between("A", "Z"), F.ascii(c) - 65)
            .when(c.between("a", "z"), F.ascii(c) - 97)).cast("int")


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(26))


def _letter(like: Column, code: Column) -> Column:
    """The character of a code, of the class and case of the one it replaces."""
    base = F.when(like.between("0", "9"), 48).when(like.between("A", "Z"), 65).otherwise(97)
    return F.chr((base + code).cast("bigint"))


def _refill(s: Column, codes: Column) -> Column:
    """The text with its letters and digits replaced in order."""
    def fill(new):
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

        def step(acc, c):
            return F.when(_code(c).isNull(), F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))).otherwise(
                F.struct(F.concat(acc["out"], _letter(c, F.get(new, acc["k"]))).alias("out"), (acc["k"] + 1).alias("k")))

        return F.aggregate(_chars(s), start, step, lambda acc: acc["out"])

    return let(codes, fill)


def _by_class(s: Column, key: str, kind: str, reveal: bool) -> Column:
    """Letters and digits permuted within their classes."""
    signs = F.filter(_chars(s), lambda c: _code(c).isNotNull())
    codes = permute(F.transform(signs, _code), F.transform(signs, _radix), key, F.lit(kind), reveal)
    return _refill(s, codes)


def _digits(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit("([0-9])"), F.lit(1)), lambda c: c.cast("int"))


def _tens(digits: Column) -> Column:
    return F.transform(digits, lambda _: F.lit(10))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10 of digits with a check digit at the end."""
    n = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when(
        (n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda a, x: a + x) % 10


def _walked(start: Column, turn, fits) -> Column:
    """`turn` applied to `start` until the result fits, WALK times at most."""
    def step(acc, _):
        return F.when(acc["done"], acc).otherwise(
            let(turn(acc["v"]), lambda v: F.struct(v.alias("v"), fits(v).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(start.alias("v"), F.lit(False).alias("done")), step,
                       lambda acc: acc["v"])


def _group_ends(s: Column) -> Column:
    """For each digit `e` if it ends its group, else `a`."""
    return _chars(F.translate(F.regexp_replace(F.regexp_replace(s, "[0-9](?=[0-9])", "a"), "[0-9]", "e"), " -", ""))


def _card_spans(digits: Column, ends: Column) -> Column:
    """The cards of a run as array<struct<rank, shorter, at>>: spans with a valid sum that overlap no earlier one."""
    def at_start(at):
        def span(n):
            whole = F.array_join(F.slice(ends, at + 1, n), "")
            rank = F.when(whole.rlike("^a+e$"), 0).when(whole.isin(*CARD_GROUPS), 1).otherwise(2)
            form = whole.rlike("^(?:a{2,}e)*a*e$") | ((at == 0) & (n == F.size(ends)))
            return F.when((F.get(ends, at + n - 1) == "e") & form
                          & let(F.slice(digits, at + 1, n), lambda d: luhn_sum(d) == 0),
                          F.struct(rank.alias("rank"), (-n).alias("shorter"), at.alias("at")))

        return F.filter(F.transform(F.array(*[F.lit(n) for n in range(13, 20)]), span), lambda c: c.isNotNull())

    starts = F.filter(F.transform(ends, lambda _, i: F.when((i == 0) | (F.get(ends, i - 1) == "e"), i)),
                      lambda i: i.isNotNull())
    found = F.array_sort(F.flatten(F.transform(starts, at_start)))

    def choose(acc, c):
        free = ~F.exists(acc, lambda o: (c["at"] < o["at"] - o["shorter"]) & (o["at"] < c["at"] - c["shorter"]))
        return F.when(free, F.concat(acc, F.array(c))).otherwise(acc)

    return F.aggregate(found, F.array().cast("array<struct<rank:int,shorter:int,at:int>>"), choose)


def _cards(s: Column, key: str, reveal: bool) -> Column:
    """struct(text, parts): a run of digits with pseudonyms of its cards, and these alone."""
    def hide(digits):
        body = F.slice(digits, F.lit(1), F.size(digits) - 1)
        return let(permute(body, _tens(body), key, F.lit("card"), reveal), lambda moved: F.concat(
            moved, F.array((10 - luhn_sum(F.concat(moved, F.array(F.lit(0))))) % 10)))

    def run(digits, ends, spans):
        def turn(now):
            return F.aggregate(spans, now, lambda acc, c: F.concat(
                F.slice(acc, F.lit(1), c["at"]), hide(F.slice(acc, c["at"] + 1, -c["shorter"])),
                F.slice(acc, c["at"] - c["shorter"] + 1, F.size(acc))))

        places = F.filter(F.transform(_chars(s), lambda c, i: F.when(c.between("0", "9"), i)), lambda i: i.isNotNull())

        def parts(text):
            return let(places, lambda place: F.transform(
                F.array_sort(F.transform(spans, lambda c: F.struct(c["at"].alias("at"), c["shorter"].alias("shorter")))),
                lambda c: F.substr(text, F.get(place, c["at"]) + 1, F.get(place, c["at"] - c["shorter"] - 1)
                                   - F.get(place, c["at"]) + 1)))

        moved = _refill(s, _walked(digits, turn, lambda now: _card_spans(now, ends) == spans))
        return F.when(F.size(spans) > 0, let(moved, lambda text: F.struct(text.alias("text"), parts(text).alias("parts")))
                      ).otherwise(F.struct(s.alias("text"), F.array().cast("array<string>").alias("parts")))

    return let(_digits(s), lambda d: let(_group_ends(s), lambda ends: let(
        _card_spans(d, ends), lambda spans: run(d, ends, spans))))


def _mod97(signs: Column) -> Column:
    """The remainder of the signs, letters counted from 10."""
    return F.aggregate(signs, F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + _code(c)) % 97).otherwise((a * 100 + _code(c) + 10) % 97))


def _iban(s: Column, key: str, reveal: bool) -> Column:
    def hide(signs):
        land, body = F.slice(signs, 1, 2), F.slice(signs, F.lit(5), F.size(signs) - 4)
        zeros = F.array(F.lit("0"), F.lit("0"))

        def out(codes):
            moved = F.zip_with(body, codes, _letter)
            check = F.lpad((98 - _mod97(F.concat(moved, land, zeros))).cast("string"), 2, "0")
            return _refill(s, F.concat(F.transform(land, _code), F.transform(_chars(check), _code), codes))

        return let(permute(F.transform(body, _code), F.transform(body, _radix), key, F.lit("iban"), reveal), out)

    def valid(signs):
        return _mod97(F.concat(F.slice(signs, F.lit(5), F.size(signs) - 4), F.slice(signs, 1, 4))) == 1

    return let(F.filter(_chars(s), lambda c: c != " "), lambda x: F.when(valid(x), hide(x)).otherwise(s))


def _phone(s: Column, key: str, reveal: bool) -> Column:
    land = F.regexp_extract(s, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(s, F.length(land) + 1)
    digits = _digits(rest)
    total = F.size(_digits(s))
    moved = F.concat(land, _refill(rest, permute(digits, _tens(digits), key, F.lit("phone"), reveal)))
    return F.when(total.between(7, 15), moved).otherwise(s)


def _secret(s: Column, key: str, reveal: bool) -> Column:
    codes = F.transform(_chars(F.lower(s)), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48)
                        .otherwise(F.ascii(c) - 87).cast("int"))
    moved = permute(codes, F.transform(codes, lambda _: F.lit(16)), key, F.lit("secret"), reveal)
    hexed = F.lower(F.array_join(F.transform(moved, lambda v: F.hex(v.cast("bigint"))), ""))
    return F.when(s == F.upper(s), F.upper(hexed)).otherwise(hexed)


def _ip(s: Column, key: str, reveal: bool) -> Column:
    octets = F.transform(F.split(s, r"\."), lambda x: x.cast("int"))
    moved = permute(octets, F.transform(octets, lambda _: F.lit(256)), key, F.lit("ip"), reveal)
    return F.array_join(moved.cast("array<string>"), ".")


def _ssn(s: Column, key: str, reveal: bool) -> Column:
    def hide(part):
        area, group, serial = F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.get(part, F.lit(2))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        # area counts 001 to 899 without 666
        values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)

        def shown(moved):
            first = F.get(moved, F.lit(0))
            return F.concat_ws("-", F.lpad((F.when(first >= 665, first + 2).otherwise(first + 1)).cast("string"), 3, "0"),
                               F.lpad((F.get(moved, F.lit(1)) + 1).cast("string"), 2, "0"),
                               F.lpad((F.get(moved, F.lit(2)) + 1).cast("string"), 4, "0"))

        radices = F.array(F.lit(898), F.lit(99), F.lit(9999))
        return F.when(valid, let(permute(values, radices, key, F.lit("ssn"), reveal), shown)).otherwise(s)

    return let(F.transform(F.split(s, "-"), lambda x: x.cast("int")), hide)


def _date(s: Column, key: str, reveal: bool) -> Column:
    iso = s.rlike("^[0-9]{4}-")
    mark = F.substr(s, F.lit(3), F.lit(1))
    year, one, two = F.substr(s, F.lit(7), F.lit(4)), F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(4), F.lit(2))
    day_first = F.when(iso, s).otherwise(F.concat_ws("-", year, two, one)).try_cast("date")
    month_first = F.when(~iso, F.concat_ws("-", year, one, two)).try_cast("date")
    start = F.lit(DATE_START).cast("date")
    a, b = DATE_RADICES

    def shown(new, swapped):
        day, month = F.date_format(new, "dd"), F.date_format(new, "MM")
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(
            F.when(swapped, month).otherwise(day), mark, F.when(swapped, day).otherwise(month), mark,
            F.date_format(new, "yyyy")))

    def hide(read):
        swapped, day = read["swapped"], F.datediff(read["date"], start)

        def turn(n):
            moved = permute(F.array(F.floor(n / b).cast("int"), (n % b).cast("int")), F.array(F.lit(a), F.lit(b)), key,
                            F.lit("date"), reveal)
            return let(moved, lambda m: (F.get(m, F.lit(0)) * b + F.get(m, F.lit(1))).cast("int"))

        # month first is read only where the day is no month
        new = _walked(day, turn, lambda n: ~swapped | (F.dayofmonth(F.date_add(start, n)) > 12))
        return F.when(day.between(0, a * b - 1), let(new, lambda n: shown(F.date_add(start, n), swapped))).otherwise(s)

    return let(F.struct(day_first.isNull().alias("swapped"), F.coalesce(day_first, month_first).alias("date")), hide)


def kind_of(s: Column) -> Column:
    """The kind of a value that PATTERN has found: the first one whose form the whole value has."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(_PATTERNS.items()):
        found = F.when(s.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def pseudonym(s: Column, kind: Column, key: str, reveal: bool = False) -> Column:
    """struct(text, parts): the value with its pseudonyms, and these alone."""
    name = F.regexp_extract(s, "^[^@]*", 0)
    text = (F.when(kind == "email", F.concat(_by_class(name, key, "email", reveal), F.substr(s, F.length(name) + 1)))
            .when(kind == "secret", _secret(s, key, reveal)).when(kind == "iban", _iban(s, key, reveal))
            .when(kind == "ip", _ip(s, key, reveal)).when(kind == "date", _date(s, key, reveal))
            .when(kind == "ssn", _ssn(s, key, reveal)).when(kind == "phone", _phone(s, key, reveal)).otherwise(s))
    return F.when(kind == "card", _cards(s, key, reveal)).otherwise(
        let(text, lambda t: F.struct(t.alias("text"), F.array(t).alias("parts"))))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", reveal: bool = False) -> DataFrame:
    """`docs` with pseudonyms in the text column and the new columns
    `private array<struct<kind, pseudonym>>` in text order and `n_private`; only values that really changed count.

    `key` is the secret of the permutation; give the same one to `reveal`.
    """
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:struct<text:string,parts:array<string>>>>")

    def hidden(s):
        return let(kind_of(s), lambda kind: F.struct(
            kind.alias("kind"), s.alias("value"), pseudonym(s, kind, key, reveal).alias("pseudonym")))

    found = F.when(F.col(text).rlike(LIKELY), F.transform(
        F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)), hidden)).otherwise(none)

    def filled(values):
        fill = F.concat(F.transform(values, lambda h: h["pseudonym"]["text"]), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(F.col(text), PATTERN, -1), fill, lambda p, h: F.concat(p, h)), "")

    def result(values):
        changed = F.flatten(F.transform(
            F.filter(values, lambda h: h["value"] != h["pseudonym"]["text"]),
            lambda h: F.transform(h["pseudonym"]["parts"], lambda p: F.struct(h["kind"].alias("kind"), p.alias("pseudonym")))))
        return F.struct(F.when(F.size(values) > 0, filled(values)).otherwise(F.col(text)).alias("text"),
                        changed.alias("private"))

    return (docs.withColumn("_hidden", let(found, result))
            .withColumn(text, F.col("_hidden.text")).withColumn("private", F.col("_hidden.private"))
            .withColumn("n_private", F.size("private").cast("long")).drop("_hidden"))
