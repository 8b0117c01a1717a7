"""Format-preserving pseudonyms for personal data, native expressions only.

Card numbers (Luhn), phone numbers, IPv4 addresses, social security numbers,
bank account numbers (IBAN, modulo 97) and calendar dates are parsed, validated
and replaced by a keyed Feistel permutation of their own domain: a card stays a
valid card, an IBAN a valid IBAN of its country, a date a real date in the same
notation, an address four octets, a North American number one with valid area
and exchange.  E-mail names are permuted letter by letter and digit by digit;
domains stay, so addresses of one provider stay recognisable as such.

The permutation depends on the caller's key and the kind only, so equal values
get equal pseudonyms in every document and different values different ones.
The mapping has two halves ``(l, r)`` in ``Z_a x Z_b`` whose product is the
domain; each round adds a keyed hash of one half to the other, which can be
undone, so it is a bijection for any ``a`` and ``b``.  The keyed hash is SHA-256
nested under the key twice (the construction of HMAC, with labels in place of
its pads): without the key neither direction can be computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "card", "phone", "ip", "ssn", "date", "iban")
ROUNDS = 8
# What each kind looks like (validity is checked after the match).
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
DATE = r"(?<![\w.+/@-])(?:[12][0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[12][0-9]{3}|[0-9]{2}\.[0-9]{2}\.[12][0-9]{3})(?![\w@/]|[.-][0-9])"
SSN = r"(?<![\w.+@-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w@-])"
IP = r"(?<![\w.@-])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w@]|\.[0-9])"
PHONE = r"(?<![\w.@])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w@])"
CARD = r"(?<![\w.@-])(?:3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7})(?![\w@-])"
ABROAD = r"(?<![\w.@])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,5}(?![\w@])"
IBAN = r"(?<![\w.@-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w@-])"
PATTERN = "|".join((EMAIL, DATE, SSN, IP, PHONE, ABROAD, CARD, IBAN))


def keyed_hash(key: Column, *message: Column) -> Column:
    """64 hexadecimal digits that nobody computes without the key."""
    text = F.concat_ws("|", *[m.cast("string") for m in message])
    return F.sha2(F.concat(key, F.lit("|outer|"), F.sha2(F.concat(key, F.lit("|inner|"), text), 256)), 256)


def keyed_number(key: Column, *message: Column) -> Column:
    """The first 60 bits of the keyed hash."""
    return F.conv(F.substring(keyed_hash(key, *message), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: Column, rounds: int = ROUNDS) -> Column:
    """``struct(l, r)``: the keyed permutation of ``Z_a x Z_b``."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def half(x: Column, other: Column, k: Column, side: int, size: Column) -> Column:
        return F.pmod(x + F.pmod(keyed_number(key, k, F.lit(side), other), size), size)

    def both(acc: Column, k: Column) -> Column:
        # Binding the new left half once keeps the expression small.
        return F.element_at(
            F.transform(
                F.array(half(acc["l"], acc["r"], k, 0, a.cast("long"))),
                lambda l: F.struct(l.alias("l"), half(acc["r"], l, k, 1, b.cast("long")).alias("r")),
            ),
            1,
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, both)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        F.split(shape, ""),
        start,
        lambda acc, c: F.when(
            c.rlike("^[0-9]$"),
            F.struct(F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc["out"],
    )


def permuted_digits(digits: Column, key: Column) -> Column:
    """A permutation of the digit strings of the same length (at most 36 digits)."""
    n = F.length(digits)
    cut = F.floor(n / 2).cast("int")

    def power(k: Column) -> Column:
        return F.pow(F.lit(10.0), k).cast("long")

    def joined(s: Column) -> Column:
        return F.concat(
            F.when(cut > 0, F.lpad(s["l"].cast("string"), cut, F.lit("0"))).otherwise(F.lit("")),
            F.lpad(s["r"].cast("string"), n - cut, F.lit("0")),
        )

    left = F.when(cut > 0, F.substring(digits, F.lit(1), cut)).otherwise(F.lit("0")).cast("long")
    right = F.substring(digits, cut + 1, n - cut).cast("long")
    return _bind(feistel(left, right, power(cut), power(n - cut), F.concat(key, n.cast("string"))), joined)


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a digit string; ``double_last`` doubles the last digit (the payload without its check digit)."""
    first = 0 if double_last else 1
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: _bind(
            c.cast("int"),
            lambda d: F.when(i % 2 == first, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d),
        ),
    )
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def valid_card(text: Column) -> Column:
    return _bind(
        _digits(text), lambda d: F.length(d).between(13, 19) & (F.pmod(luhn_sum(d, False), F.lit(10)) == 0)
    )


def _card(text: Column, key: Column) -> Column:
    def pseudonym(d: Column) -> Column:
        payload = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), F.concat(key, F.lit("card")))
        return _bind(
            payload,
            lambda p: _refill(text, F.concat(p, F.pmod(F.lit(10) - F.pmod(luhn_sum(p, True), F.lit(10)), F.lit(10)).cast("string"))),
        )

    return _bind(_digits(text), pseudonym)


def _north_american(text: Column) -> Column:
    return text.rlike(r"^(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$")


def valid_phone(text: Column) -> Column:
    """Ten digits whose exchange and (without a country code) area begin with 2 to 9; or 8 to 15 digits after a plus."""
    def valid(d: Column) -> Column:
        area, exchange = F.substring(d, F.length(d) - 9, F.lit(3)), F.substring(d, F.length(d) - 6, F.lit(3))
        own = (F.substring(exchange, 1, 1) >= "2") & F.when(text.startswith("+"), area != "000").otherwise(F.substring(area, 1, 1) >= "2")
        return F.when(_north_american(text), own).otherwise(text.startswith("+") & F.length(d).between(8, 15))

    return _bind(_digits(text), valid)


def _phone(text: Column, key: Column) -> Column:
    """The country code stays; area, exchange and line are permuted among the valid ones, abroad all other digits."""
    def domestic(d: Column) -> Column:
        own = F.length(d) - 10
        area, exchange, line = (F.substring(d, own + at, F.lit(n)).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
        least = F.when(text.startswith("+"), F.lit(1)).otherwise(F.lit(200))

        def shown(s: Column) -> Column:
            three = lambda x: F.lpad(x.cast("string"), 3, "0")
            return F.concat(F.substring(d, F.lit(1), own), three(F.floor(s["l"] / 800) + least), three(F.pmod(s["l"], F.lit(800)) + 200), F.lpad(s["r"].cast("string"), 4, "0"))

        domain = F.concat(key, F.lit("phone"), least.cast("string"))
        return _bind(feistel((area - least) * 800 + exchange - 200, line, (1000 - least) * 800, 10000, domain), lambda s: _refill(text, shown(s)))

    def abroad(d: Column) -> Column:
        code = F.length(F.regexp_extract(text, r"^\+([0-9]{1,3})(?=[ .(-])", 1))
        own = F.when(code > 0, code).otherwise(2)
        rest = permuted_digits(F.substring(d, own + 1, F.length(d)), F.concat(key, F.lit("abroad")))
        return _refill(text, F.concat(F.substring(d, F.lit(1), own), rest))

    return F.when(_north_american(text), _bind(_digits(text), domestic)).otherwise(_bind(_digits(text), abroad))


def _remainder_97(text: Column) -> Column:
    """An account number, country and check digits moved to the end, letters as 10 to 35, modulo 97."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: _bind(value(c), lambda v: F.pmod(F.when(v > 9, r * 100 + v).otherwise(r * 10 + v), F.lit(97))))


def valid_iban(text: Column) -> Column:
    return _bind(F.replace(text, F.lit(" "), F.lit("")), lambda t: F.length(t).between(15, 34) & (_remainder_97(t) == 1))


def _iban(text: Column, key: Column) -> Column:
    """The country stays; the account is permuted letter by letter and digit by digit, the check digits follow."""
    def pseudonym(t: Column) -> Column:
        account = _permuted_text(F.substring(t, F.lit(5), F.length(t)), key, "iban")
        return _bind(
            account,
            lambda x: _bind(
                F.concat(F.substring(t, 1, 2), F.lpad((98 - _remainder_97(F.concat(F.substring(t, 1, 2), F.lit("00"), x))).cast("string"), 2, "0"), x),
                lambda whole: F.aggregate(
                    F.split(text, ""),
                    F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
                    lambda acc, c: F.when(c == " ", F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))).otherwise(
                        F.struct(F.concat(acc["out"], F.substring(whole, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))
                    ),
                    lambda acc: acc["out"],
                ),
            ),
        )

    return _bind(F.replace(text, F.lit(" "), F.lit("")), pseudonym)


def valid_ip(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda x: (F.length(x) <= 3) & x.rlike("^[0-9]{1,3}$") & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255))


def _ip(text: Column, key: Column) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))

    def pseudonym(o: Column) -> Column:
        return _bind(
            feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, F.concat(key, F.lit("ip"))),
            lambda s: F.concat_ws(
                ".",
                F.floor(s["l"] / 256).cast("string"),
                F.pmod(s["l"], F.lit(256)).cast("string"),
                F.floor(s["r"] / 256).cast("string"),
                F.pmod(s["r"], F.lit(256)).cast("string"),
            ),
        )

    return _bind(octets, pseudonym)


def valid_ssn(text: Column) -> Column:
    area, group, serial = (F.substring(text, a, n).try_cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    return F.coalesce(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.lit(False))


def _ssn(text: Column, key: Column) -> Column:
    area, group, serial = (F.substring(text, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas, 99 groups, 9,999 serials

    def shown(s: Column) -> Column:
        a = F.floor(s["l"] / 99)
        return F.concat_ws(
            "-",
            F.lpad(F.when(a >= 665, a + 2).otherwise(a + 1).cast("string"), 3, "0"),
            F.lpad((F.pmod(s["l"], F.lit(99)) + 1).cast("string"), 2, "0"),
            F.lpad((s["r"] + 1).cast("string"), 4, "0"),
        )

    return _bind(feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, F.concat(key, F.lit("ssn"))), shown)


_FORMATS = ((r"^[0-9]{4}-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), (r"\.", "dd.MM.yyyy"))
#: The years 1000 to 2999: their first day from 1970 on; 730,485 days = 773 x 945.
_FIRST_DAY, _DAY_ROWS, _DAY_COLUMNS = -354285, 773, 945


def parsed_date(text: Column) -> Column:
    out = F.lit(None).cast("date")
    for mark, form in reversed(_FORMATS):
        out = F.when(text.rlike(mark), F.try_to_date(text, form)).otherwise(out)
    return out


def _date(text: Column, key: Column) -> Column:
    """Permutes the days of the years 1000 to 2999."""
    day = F.datediff(parsed_date(text), F.lit("1970-01-01").cast("date")) - F.lit(_FIRST_DAY)

    def shown(s: Column) -> Column:
        found = F.date_add(F.lit("1970-01-01").cast("date"), (s["l"] * _DAY_COLUMNS + s["r"] + F.lit(_FIRST_DAY)).cast("int"))
        out = F.lit(None).cast("string")
        for mark, form in reversed(_FORMATS):
            out = F.when(text.rlike(mark), F.date_format(found, form)).otherwise(out)
        return out

    return _bind(feistel(F.floor(day / _DAY_COLUMNS), F.pmod(day, F.lit(_DAY_COLUMNS)), _DAY_ROWS, _DAY_COLUMNS, F.concat(key, F.lit("date"))), shown)


_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _shifted(text: Column, stream: Column) -> Column:
    """Each letter or digit of ``text`` moved inside its own alphabet by a keyed amount that depends on its place."""
    def moved(c: Column, i: Column) -> Column:
        amount = F.conv(F.substring(stream, F.pmod(i * 4, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 15).cast("int")
        out = c
        for letters in _ALPHABETS:
            at = F.instr(F.lit(letters), c)
            out = F.when(
                (c != "") & (at > 0),
                F.substring(F.lit(letters), (F.pmod(at - 1 + amount, F.lit(len(letters))) + 1).cast("int"), F.lit(1)),
            ).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def _permuted_text(text: Column, key: Column, kind: str) -> Column:
    """Letters and digits permuted among the texts of the same shape, marks and case kept."""
    n = F.length(text)
    cut = F.floor((n + 1) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, n).alias("r"))

    def half(x: Column, other: Column, k: Column, side: str) -> Column:
        return _bind(keyed_hash(key, F.lit(kind), k, F.lit(side), other), lambda h: _shifted(x, h))

    def both(acc: Column, k: Column) -> Column:
        return _bind(half(acc["l"], acc["r"], k, "l"), lambda l: F.struct(l.alias("l"), half(acc["r"], l, k, "r").alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, both, lambda s: F.concat(s["l"], s["r"]))


def _email(text: Column, key: Column) -> Column:
    """The name before the @ is permuted; marks, case and the domain stay."""
    return F.concat(_permuted_text(F.substring_index(text, "@", 1), key, "email"), F.lit("@"), F.substring_index(text, "@", -1))


def kind_of(match: Column) -> Column:
    """The kind of a match of ``PATTERN``, or null where it is not valid."""
    is_date = match.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$")
    return (
        F.when(match.contains("@"), F.lit("email"))
        .when(is_date, F.when(parsed_date(match).isNotNull(), F.lit("date")))
        .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(valid_ssn(match), F.lit("ssn")))
        .when(match.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), F.when(valid_ip(match), F.lit("ip")))
        .when(match.rlike(r"^[A-Z]"), F.when(valid_iban(match), F.lit("iban")))
        .when(match.startswith("+") | _north_american(match), F.when(valid_phone(match), F.lit("phone")))
        .otherwise(F.when(valid_card(match), F.lit("card")))
    )


def pseudonym(match: Column, kind: Column, key: Column) -> Column:
    return (
        F.when(kind == "email", _email(match, key))
        .when(kind == "date", _date(match, key))
        .when(kind == "ssn", _ssn(match, key))
        .when(kind == "ip", _ip(match, key))
        .when(kind == "phone", _phone(match, key))
        .when(kind == "iban", _iban(match, key))
        .when(kind == "card", _card(match, key))
        .otherwise(match)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` (all columns) plus ``pseudonymised``, ``spans`` and ``n_<kind>`` for each kind.

    ``spans`` lists ``kind:start:end`` in code points of the input, in order.
    Invalid look-alikes stay as they are; null texts are empty; columns named
    like a result are replaced; repeated rows stay; texts are read whole; no row
    is added or lost.  The key is the caller's secret: who has it can undo every
    pseudonym, so it has no default.
    """
    if not key:
        raise ValueError("a key is needed")
    secret = F.lit(hashlib.sha256(key.encode()).hexdigest())
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    empty = F.expr("cast(array() as array<struct<m:string,kind:string>>)")
    found = F.transform(
        F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))
    )
    likely = body.rlike("[0-9]") & (body.rlike("[0-9]{2}") | body.contains("@") | body.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]")) | body.contains("@")
    names = [f"{prefix}pseudonymised", f"{prefix}spans", *[f"{prefix}n_{k}" for k in KINDS]]
    kept = [c for c in docs.columns if c.lower() not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], body.alias("__body"), F.when(likely, found).otherwise(empty).alias("__found"))
    parts = F.split(F.col("__body"), PATTERN)
    replaced = F.array_join(
        F.zip_with(
            parts,
            F.transform("__found", lambda x: pseudonym(x["m"], x["kind"], secret)),
            lambda p, r: F.concat(F.coalesce(p, F.lit("")), F.coalesce(r, F.lit(""))),
        ),
        "",
    )
    placed = F.aggregate(
        F.arrays_zip(F.transform(parts, lambda p: F.length(p)).alias("gap"), F.col("__found").alias("x")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, z: F.struct(
            (acc["at"] + z["gap"] + F.coalesce(F.length(z["x"]["m"]), F.lit(0))).alias("at"),
            F.when(
                z["x"]["kind"].isNotNull(),
                F.concat(
                    acc["out"],
                    F.array(
                        F.concat_ws(
                            ":",
                            z["x"]["kind"],
                            (acc["at"] + z["gap"]).cast("string"),
                            (acc["at"] + z["gap"] + F.length(z["x"]["m"])).cast("string"),
                        )
                    ),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.array_join(acc["out"], ","),
    )
    any_found = F.size("__found") > 0
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(any_found, replaced).otherwise(F.col("__body")).alias(names[0]),
        F.when(any_found, placed).otherwise(F.lit("")).alias(names[1]),
        *[F.size(F.filter("__found", lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"{prefix}n_{k}") for k in KINDS],
    )
