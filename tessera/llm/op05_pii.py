"""Format-preserving pseudonyms for personal data, in SQL functions alone.

One pattern finds candidates in the whole text; the text is split by it, every candidate is validated and replaced by a
keyed permutation of its own format, and the pieces are joined again:

* card numbers (13 to 19 digits, Luhn): all but the check digit go through a Feistel network, the check digit is made anew;
* phone numbers with a country code, social security numbers (no reserved areas), IPv4 addresses (octets to 255),
  IBANs (mod 97): their digits go through the network; the IBAN's check digits are made anew;
* dates (real ones from 1900-01-01 on, 201 years; ISO, d.m.y, m/d/y or d/m/y): the day number goes through the network;
* e-mail addresses, access keys, passwords and tokens are no numbers: they get keyed digests of like form.

The network alternates additions modulo 10^a and 10^b (or any two moduli a and b), a bijection on a * b values. It is
keyed, and has no other input than the value and its format: equal values stay linked across documents. What isn't valid
stays as it is, so that clean texts stay byte for byte.

Defined results: null text stays null, empty stays empty. All columns are kept; only ``text_col`` changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The key is a parameter; this one is for tests and the check data only.
KEY = "public-demo-key"

# The candidate patterns, in order of precedence.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*+(?<=\.[A-Za-z0-9\-]{2,40})"
PHONE = r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-][0-9]{3,4}[ .\-][0-9]{3,4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
AWS = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:password|token|secret|api_key)\s?[=:]\s?[\"']?[A-Za-z0-9]{8,128}[\"']?"
ISO = r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"
DAY = r"(?<![0-9./\-])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9]|[./\-][0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
CARD = r"(?<![A-Za-z0-9])(?<![0-9]\-)(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}([ \-])[0-9]{6}\3[0-9]{5})(?![A-Za-z0-9]|\-[0-9])"
PATTERN = "|".join((EMAIL, PHONE, IBAN, AWS, SECRET, ISO, DAY, SSN, IPV4, CARD))
FIRST_DAY, DAY_A, DAY_B = "1900-01-01", 256, 288


def _digest(key: Column, *parts) -> Column:
    return F.sha2(F.concat_ws("|", key, *parts), 256)


def _number(key: Column, *parts) -> Column:
    """56 keyed bits."""
    return F.conv(F.substring(_digest(key, *parts), 1, 14), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, tweak: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs with 0 <= l < a and 0 <= r < b."""
    text = lambda c: c.cast("string")

    def turn(s, i):
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (s["l"] + _number(key, tweak, text(i), text(s["r"]))) % a).otherwise(s["l"]).cast("long").alias("l"),
            F.when(odd, s["r"]).otherwise((s["r"] + _number(key, tweak, text(i), text(s["l"]))) % b).cast("long").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permuted_digits(d: Column, key: Column, tweak: Column) -> Column:
    """Digits of the same count; 2 to 36 of them."""
    n = F.length(d)
    a = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    s = feistel(d.substr(F.lit(1), a), d.substr(a + 1, n), ten(a), ten(n - a), key, F.concat_ws("|", tweak, n.cast("string")))
    return F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), n - a, F.lit("0")))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def laid_into(m: Column, d: Column) -> Column:
    """The digits ``d`` in the places that digits have in ``m``."""
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike("[0-9]"), d.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"),
        (s["at"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).cast("int").alias("at"),
    )
    done = F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).cast("int").alias("at")), step)
    return F.when(F.length(m) == F.length(d), d).otherwise(done["out"])


def luhn_sum(d: Column, shift: int = 0) -> Column:
    """Luhn's sum of a digit string; shift 1: as it is with one more digit to come."""
    one = lambda c, i: F.when((i + shift) % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))
    return F.aggregate(F.transform(F.reverse(F.split(d, "")), one), F.lit(0), lambda s, x: (s + x).cast("int"))


def mod97(s: Column) -> Column:
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97).cast("int")
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _card(m: Column, key: Column) -> Column:
    d = digits(m)
    body = permuted_digits(d.substr(F.lit(1), F.length(d) - 1), key, F.lit("card"))
    check = ((F.lit(10) - luhn_sum(body, 1) % 10) % 10).cast("string")
    return F.when(luhn_sum(d) % 10 == 0, laid_into(m, F.concat(body, check))).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3})[ .\-(]", 1)
    rest = m.substr(F.length(code) + 1, F.length(m))
    return F.concat(code, laid_into(rest, permuted_digits(digits(rest), key, F.concat(F.lit("phone"), code))))


def _iban(m: Column, key: Column) -> Column:
    country, body = F.substring(m, 1, 2), m.substr(F.lit(5), F.length(m))
    valid = (mod97(F.concat(body, F.substring(m, 1, 4))) == 1) & (F.length(digits(body)) >= 2)
    new = laid_into(body, permuted_digits(digits(body), key, F.concat(F.lit("iban"), country)))
    check = F.lpad((F.lit(98) - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, F.concat(country, check, new)).otherwise(m)


def _ssn(m: Column, key: Column) -> Column:
    valid = ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.when(valid, laid_into(m, permuted_digits(digits(m), key, F.lit("ssn")))).otherwise(m)


def _ipv4(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ipv4"))
    part = lambda x, k: (F.floor(x / 256) if k else x % 256).cast("int").cast("string")
    new = F.concat_ws(".", part(s["l"], 1), part(s["l"], 0), part(s["r"], 1), part(s["r"], 0))
    return F.when(F.forall(o, lambda x: x <= 255), new).otherwise(m)


def _day(iso: Column, key: Column) -> Column:
    """The permuted date of an ISO string as yyyy-mm-dd; null if there is no such day or it is out of range."""
    day = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    s = feistel(F.floor(day / DAY_B), day % DAY_B, F.lit(DAY_A), F.lit(DAY_B), key, F.lit("date"))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAY_B + s["r"]).cast("int"))
    return F.when((day >= 0) & (day < DAY_A * DAY_B), F.date_format(new, "yyyy-MM-dd"))


def _dated(m: Column, key: Column) -> Column:
    sep = F.when(F.contains(m, F.lit("/")), "/").otherwise(".")
    p = F.split(m, "[./]")
    two = lambda x: F.lpad(x, 2, "0")
    us, eu = F.concat_ws("-", p[2], two(p[0]), two(p[1])), F.concat_ws("-", p[2], two(p[1]), two(p[0]))
    us_new, eu_new = F.when(sep == "/", _day(us, key)), _day(eu, key)
    return F.coalesce(_shown(us_new, sep, (1, 2, 0)), _shown(eu_new, sep, (2, 1, 0)), m)


def _shown(iso: Column, sep: Column, order: tuple[int, ...]) -> Column:
    p = F.split(iso, "-")
    return F.when(iso.isNotNull(), F.concat(p[order[0]], sep, p[order[1]], sep, p[order[2]]))


def _like_form(m: Column, key: Column, kind: str) -> Column:
    """A keyed digest as long as ``m``, in lower-case hex or, if ``m`` has capitals, in capitals and digits."""
    d = F.concat(_digest(key, F.lit(kind), m), _digest(key, F.lit(kind + "2"), m)).substr(F.lit(1), F.length(m))
    return F.when(m.rlike("[A-Z]"), F.upper(d)).otherwise(d)


def _email(m: Column, key: Column) -> Column:
    low = F.lower(m)
    tld = F.regexp_extract(low, r"\.([a-z0-9\-]+)$", 1)
    host = F.split(low, "@")[1]
    return F.concat(F.lit("u"), F.substring(_digest(key, F.lit("mail"), low), 1, 12), F.lit("@h"), F.substring(_digest(key, F.lit("host"), host), 1, 8), F.lit("."), tld)


def _secret(m: Column, key: Column) -> Column:
    head = F.regexp_extract(m, r"^([a-z_]+\s?[=:]\s?[\"']?)", 1)
    value = F.regexp_extract(m, r"^[a-z_]+\s?[=:]\s?[\"']?([A-Za-z0-9]+)", 1)
    return F.concat(head, _like_form(value, key, "secret"), m.substr(F.length(head) + F.length(value) + 1, F.length(m)))


def pseudonym(m: Column, key: Column) -> Column:
    """What stands for one match of PATTERN."""
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(m.startswith("+"), _phone(m, key))
        .when(m.rlike("^AKIA[A-Z0-9]{16}$"), F.concat(F.lit("AKIA"), _like_form(m.substr(F.lit(5), F.length(m)), key, "aws")))
        .when(m.rlike("^[A-Z]{2}"), _iban(m, key))
        .when(m.rlike("^[a-z]"), _secret(m, key))
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.coalesce(_day(m, key), m))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(m, key))
        .when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), _ipv4(m, key))
        .when(m.rlike(r"^[0-9]{1,2}[./]"), _dated(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; ``count_col``, if given, is added: values replaced (null text: 0).

    Every piece of a text is taken up once, with the value that follows it, so a text costs in proportion to its values.
    """
    t = F.col(text_col)
    inner = next(x for x in (f"__pieces{i or ''}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    last = F.lit(None).cast("string")
    pairs = F.zip_with(F.split(t, PATTERN, -1), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), lambda p, m: F.struct(p.alias("before"), m.alias("old"), F.when(m.isNotNull(), pseudonym(m, F.lit(key))).otherwise(last).alias("new")))
    out = docs.withColumn(inner, F.when(t.rlike("[0-9@]"), pairs))
    joined = F.array_join(F.flatten(F.transform(inner, lambda x: F.array(x["before"], F.coalesce(x["new"], F.lit(""))))), "")
    if count_col:
        out = out.withColumn(count_col, F.when(F.col(inner).isNotNull(), F.size(F.filter(inner, lambda x: x["old"] != x["new"]))).otherwise(0).cast("int"))
    return out.withColumn(text_col, F.when(F.col(inner).isNotNull(), joined).otherwise(t)).drop(inner)
