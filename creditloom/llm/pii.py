"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Validated numbers and dates are permuted within their own format by a keyed
Feistel network: a payment card stays a card of the same length with a right
check digit, a telephone number stays one of its numbering plan, an IPv4
address an address, a social security number a possible one, and a date a
date of the same writing. A permutation keeps equal values equal and different
ones different, in all documents, and whoever holds the key can invert it.
E-mail addresses have no fixed domain to permute in; they become a keyed
digest at a reserved domain.

The text is cut at the matches of one pattern and joined again with each
match's pseudonym: no shuffle, no Python. The pattern is linear in the text
(bounded repeats, possessive runs).

Rows: null text stays null with counts 0; empty and match-free texts come back
unchanged; repeated rows and equal ids give a row each; other columns are kept
out of the result but for those asked for by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DEFAULT_KEY = "replace-this-key"

#: The kinds in the order they are tried at a position.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)[0-9]{2})(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Whatever holds none of these cannot match.
HINT = "[0-9]{2}|[0-9]\\.|@"

DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")
#: 1900-01-01 to 2099-12-31 are 17 * 4297 days.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: str, key: str, invert: bool = False) -> Column:
    """Permutes (left, right) of [0, a) x [0, b): each round adds to one half a
    keyed function of the other. Returns struct(l, r)."""

    def keyed(i: Column, v: Column) -> Column:
        said = F.concat_ws(":", F.lit(key), F.lit(tweak), a.cast("string"), b.cast("string"), i.cast("string"), v.cast("string"))
        return F.conv(F.substring(F.sha2(said, 256), 1, 14), 16, 10).cast("bigint")

    def turn(half: Column, i: Column, other: Column, size: Column) -> Column:
        step = keyed(i, other) % size
        return (half - step + size) % size if invert else (half + step) % size

    def round_(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(turn(s["l"], i, s["r"], a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), turn(s["r"], i, s["l"], b).alias("r")))

    order = [F.lit(i) for i in (range(ROUNDS, 0, -1) if invert else range(1, ROUNDS + 1))]
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.array(*order), start, round_)


def permute_digits(digits: Column, tweak: str, key: str, invert: bool = False) -> Column:
    """Another string of as many digits (2 to 36)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    halves = feistel(F.substring(digits, F.lit(1), u).cast("bigint"), F.substring(digits, u + 1, n - u).cast("bigint"), ten(u), ten(n - u), tweak, key, invert)
    return let(halves, lambda s: F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), n - u, "0")))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _int(s: Column, start: int, size: int) -> Column:
    return F.substring(s, start, size).cast("bigint")


def luhn_sum(payload: Column) -> Column:
    """Sum of a card's digits before the check digit, every other one doubled from the right."""
    n = F.length(payload)

    def weight(i: Column) -> Column:
        d = F.substring(payload, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weight(i))


def check_digit(payload: Column) -> Column:
    return ((10 - luhn_sum(payload) % 10) % 10).cast("string")


def put_digits(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced in order; everything else stays in place."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        number = (c >= "0") & (c <= "9")
        return F.struct(F.concat(acc["out"], F.when(number, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + F.when(number, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, step)["out"]


def _card(s: Column, key: str, invert: bool) -> Column:
    payload = lambda d: F.substring(d, F.lit(1), F.length(d) - 1)
    new = lambda d: let(permute_digits(payload(d), "card", key, invert), lambda p: F.concat(p, check_digit(p)))
    return let(_digits(s), lambda d: F.when(F.right(d, F.lit(1)) == check_digit(payload(d)), put_digits(s, new(d))))


def _phone(s: Column, key: str, invert: bool) -> Column:
    """Area and exchange codes stay in 200 to 999; a country code 1 stays."""

    def new(d: Column) -> Column:
        p = F.right(d, F.lit(10))
        moved = feistel(_int(p, 1, 3) - 200, _int(p, 4, 7) - 2_000_000, F.lit(800), F.lit(8_000_000), "phone", key, invert)
        head = F.when(F.length(d) == 11, F.substring(d, 1, 1)).otherwise(F.lit(""))
        return let(moved, lambda m: F.concat(head, (m["l"] + 200).cast("string"), (m["r"] + 2_000_000).cast("string")))

    return let(_digits(s), lambda d: put_digits(s, new(d)))


def _ssn(s: Column, key: str, invert: bool) -> Column:
    area, group, serial = _int(s, 1, 3), _int(s, 5, 2), _int(s, 8, 4)
    moved = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", key, invert)
    two = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return let(moved, lambda m: F.concat(two(m["l"] + F.when(m["l"] >= 665, 2).otherwise(1), 3), F.lit("-"), two(F.floor(m["r"] / 9999) + 1, 2), F.lit("-"), two(m["r"] % 9999 + 1, 4)))


def _ip(s: Column, key: str, invert: bool) -> Column:
    part = F.split(s, "\\.")
    octet = lambda i: part[i].cast("bigint")
    moved = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), "ip", key, invert)
    byte = lambda v: (F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return let(moved, lambda m: F.concat_ws(".", *byte(m["l"]), *byte(m["r"])))


def _date(s: Column, key: str, invert: bool) -> Column:
    form = F.when(F.substring(s, 5, 1) == "-", DATE_FORMATS[0]).when(F.substring(s, 3, 1) == ".", DATE_FORMATS[1]).otherwise(DATE_FORMATS[2])
    iso = F.when(F.substring(s, 5, 1) == "-", s).otherwise(F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2)))
    day = iso.try_cast("date")
    first = F.lit(FIRST_DAY).cast("date")

    def new(n: Column) -> Column:
        moved = feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), "date", key, invert)
        back = let(moved, lambda m: F.date_add(first, (m["l"] * DAYS[1] + m["r"]).cast("int")))
        year, month, of_month = F.date_format(back, "yyyy"), F.date_format(back, "MM"), F.date_format(back, "dd")
        return F.when(form == DATE_FORMATS[0], F.concat_ws("-", year, month, of_month)).when(form == DATE_FORMATS[1], F.concat_ws(".", of_month, month, year)).otherwise(F.concat_ws("/", of_month, month, year))

    return F.when(day.isNotNull(), let(F.datediff(day, first), new))


def _email(s: Column, key: str, invert: bool) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(s)), 256), 1, 16), F.lit("@mail.invalid"))


_NEW = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}


def pseudonym(s: Column, key: str, invert: bool = False) -> Column:
    """struct(kind, new) of a match; both null if it is not valid (a wrong check digit, no such day)."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(F.regexp_like(s, F.lit(f"^(?:{pattern})$")), F.lit(name)).otherwise(kind)

    def value(k: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, f in _NEW.items():
            new = F.when(k == name, f(s, key, invert)).otherwise(new)
        return let(new, lambda n: F.struct(F.when(n.isNotNull(), k).alias("kind"), n.alias("new")))

    return let(kind, value)


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), invert: bool = False) -> DataFrame:
    """(id, text, n_email, n_ip, n_phone, n_ssn, n_date, n_card) and the ``keep`` columns.

    ``text`` has every valid match replaced; the counts tell how many of each kind.
    """
    text = F.col(text_col)
    cut = docs.select(*dict.fromkeys([id_col, *keep]), text.alias("__text"), F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("__matches"))
    found = cut.withColumn("__new", F.transform("__matches", lambda s: F.struct(s.alias("old"), pseudonym(s, key, invert).alias("to"))))
    new = F.transform("__new", lambda m: F.coalesce(m["to"]["new"], m["old"]))
    joined = F.array_join(F.flatten(F.zip_with(F.split("__text", ANY, -1), new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    def number(kind: str) -> Column:
        return F.when(F.col("__new").isNull(), 0).otherwise(F.size(F.filter("__new", lambda m: m["to"]["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    counts = [number(kind) for kind in PATTERNS]
    return found.select(id_col, F.when(F.size("__new") > 0, joined).otherwise(F.col("__text")).alias(text_col), *[c for c in dict.fromkeys(keep) if c not in (id_col, text_col)], *counts)
