"""Format-preserving Feistel pseudonyms for validated numbers and dates, in built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# The shapes that are looked for, in order of precedence. Groups repeat a bounded number of times, as Java recurses on each.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.){1,60}[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9])(?<![0-9][./-])(?:[0-9]{4}([./-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\2[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ip": r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9A-Za-z+.,-])(?<![0-9] )[2-9][0-9]{2} ?[2-9][0-9]{2} ?[0-9]{4}(?![0-9A-Za-z]|[.,-][0-9]| [0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?<![0-9]\.)(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
# In one pattern a reference to a group counts from the first shape, so the date's two are spelled out there.
ANY = "|".join(SHAPES.values()).replace(SHAPES["date"], "|".join(SHAPES["date"].replace("([./-])", c).replace(r"\1", c).replace(r"\2", c) for c in ("-", "/", r"\.")))
#: First day and number of days of the dates that are permuted: 400 Gregorian years, 189 * 773 days.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773
#: How often a pseudonym that isn't of the value's own class is permuted again at most; beyond what ever happens (0.64 ** 200 is 1e-39).
WALK = 200


def _alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z]", "")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _chars(c: Column) -> Column:
    """The characters of an ASCII string as an array; empty for an empty string."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def luhn_digit(body: Column) -> Column:
    """The check digit that makes body + digit pass Luhn's test."""
    digits = F.transform(_chars(F.reverse(body)), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return ((10 - F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def iban_digits(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN, by the remainder modulo 97."""
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + code(c)) % 97).otherwise((a * 100 + code(c)) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _month_first(m: Column) -> Column:
    """Whether a date is real only if its first number is the month."""
    return ~m.rlike("^[0-9]{4}") & (F.substring(m, 4, 2).try_cast("int") > 12)


def _date(m: Column) -> Column:
    """The day of a date: year first; else day first, or month first where the second number is beyond 12."""
    s = F.regexp_replace(m, "[./]", "-")
    shape = lambda p: F.try_to_timestamp(s, F.lit(p))
    return F.when(m.rlike("^[0-9]{4}"), shape("yyyy-MM-dd")).when(_month_first(m), shape("MM-dd-yyyy")).otherwise(shape("dd-MM-yyyy")).cast("date")


def _national(digits: Column) -> Column:
    """Whether ten digits are a number whose area and exchange begin with 2 to 9."""
    return digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")


def walked(first: Column, again, fits) -> Column:
    """first, or the first of its successors under ``again`` that fits: so a permutation of all values is one of those that fit."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda s, _: F.when(fits(s), s).otherwise(again(s)))


def kind_of(m: Column) -> Column:
    """The kind of a match, or null where its form or its check digits do not hold."""
    full = lambda k: m.rlike(f"^(?:{SHAPES[k]})$")
    n = _digits(m)
    octets = F.forall(F.transform(F.split(m, r"\."), lambda o: o.cast("int")), lambda o: o <= 255)
    iban = F.regexp_replace(m, " ", "")
    days = F.datediff(_date(m), F.lit(FIRST_DAY).cast("date"))
    return (
        F.when(full("email"), "email")
        .when(full("iban"), F.when(iban_digits(F.substring(iban, 1, 2), F.substring(iban, 5, 40)) == F.substring(iban, 3, 2), "iban"))
        .when(full("date"), F.when((days >= 0) & (days < DAYS_A * DAYS_B), "date"))
        .when(full("ip"), F.when(octets, "ip"))
        .when(full("phone"), "phone")
        .when(full("ssn"), F.when(~m.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(full("card"), F.when(luhn_digit(F.substring(n, F.lit(1), F.length(n) - 1)) == F.right(n, F.lit(1)), "card"))
    )


def feistel_text(value: Column, key: str, kind: Column) -> Column:
    """A keyed permutation of strings over [0-9A-Za-z]: digits stay digits, letters keep their case.

    The string is cut in two halves. In each round one half is shifted, character by character within its own class
    (10 digits, 26 letters), by a key stream made from SHA-512 of key, kind, round, length and the other half; a shift
    is undone by the same shift backwards, so every round and hence the whole is one to one.
    """
    n = F.length(value)

    def shifted(half: Column, other: Column, r: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(half) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, r.cast("string"), n.cast("string"), b.cast("string"), other), 512))
        stream = F.regexp_extract_all(F.array_join(blocks, ""), F.lit("[0-9a-f]{4}"), F.lit(0))

        def one(c: Column, k: Column) -> Column:
            code, by = F.ascii(c), F.conv(k, 16, 10).cast("int")
            put = lambda base, size: F.char(F.lit(base) + (code - base + by) % size)
            return F.when(c.isNull(), "").when(code < 58, put(48, 10)).when(code < 91, put(65, 26)).otherwise(put(97, 26))

        return F.array_join(F.zip_with(_chars(half), stream, one), "")

    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, n).alias("r"))
    step = lambda s, i: F.struct(
        F.when(i % 2 == 0, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def feistel_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1 over the pair (value / b, value % b), each round adding to one of the two."""

    def f(other: Column, i: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("long")

    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
    step = lambda s, i: F.struct(
        F.when(i % 2 == 0, (s["l"] + f(s["r"], i)) % a).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, (s["r"] + f(s["l"], i)) % b).otherwise(s["r"]).alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def poured(template: Column, filling: Column) -> Column:
    """template with its letters and digits replaced, in order, by the characters of filling."""
    at = lambda i: F.length(_alnum(F.substring(template, F.lit(1), i + 1)))
    return F.array_join(F.transform(_chars(template), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(filling, at(i), F.lit(1))).otherwise(c)), "")


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of one match of this kind in its own format; the match itself where it has no kind.

    Values that differ only in separators (``4111 1111...`` and ``4111-1111...``) have pseudonyms that differ only
    there, so they stay linked. Dates stay real dates within 1800-2199 in the form they were written in (day first, but month first
    where only that is a date; such a one stays so); card numbers and IBANs get fitting check digits; SSNs stay valid; e-mail
    addresses keep the domain, which is part of the key; +country codes stay; ten-digit telephone numbers keep whether area and
    exchange begin with 2 to 9. Each of these classes is permuted within itself, so no two values share a pseudonym.
    """
    digits = _digits(m)
    text = lambda v, k: feistel_text(v, key, F.lit(k))
    card = text(F.substring(digits, F.lit(1), F.length(digits) - 1), "card")
    iban = F.regexp_replace(m, " ", "")
    account = text(F.substring(iban, 5, 40), "iban")
    country = F.substring(iban, 1, 2)
    local, domain = F.regexp_extract(m, "^([^@]*)@", 1), F.regexp_extract(m, "@(.*)$", 1)

    prefix = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])[ .-]?|\+)?", 0)
    number = F.substring(m, F.length(prefix) + 1, F.length(m))
    ten = _digits(number)
    cut = lambda at, n: F.substring(ten, at, n).cast("long")
    dialled = feistel_number(((cut(1, 3) - 200) * 800 + cut(4, 3) - 200) * 10_000 + cut(7, 4), 640_000, 10_000, key, "phone")
    half = F.floor(dialled / 10_000)
    national = F.concat((F.floor(half / 800) + 200).cast("string"), (half % 800 + 200).cast("string"), F.lpad((dialled % 10_000).cast("string"), 4, "0"))
    other = walked(text(ten, "phone"), lambda s: text(s, "phone"), lambda s: ~_national(s))

    # An SSN is a number of 898 areas (001 to 899 but 666), 99 groups and 9,999 serials.
    area, group, serial = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 2).cast("long"), F.substring(digits, 6, 4).cast("long")
    place = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    new = feistel_number(place, 898 * 99, 9999, key, "ssn")
    new_area = F.floor(new / (99 * 9999)) + 1
    ssn = F.format_string("%03d%02d%04d", F.when(new_area >= 666, new_area + 1).otherwise(new_area), F.floor(new / 9999) % 99 + 1, new % 9999 + 1)

    first = F.lit(FIRST_DAY).cast("date")
    day_number = F.datediff(_date(m), first).cast("long")
    step = lambda d: feistel_number(d, DAYS_A, DAYS_B, key, "date")
    late = walked(step(day_number), step, lambda d: F.dayofmonth(F.date_add(first, d.cast("int"))) > 12)
    day = F.date_add(first, F.when(_month_first(m), late).otherwise(step(day_number)).cast("int"))
    spelled = F.when(m.rlike("^[0-9]{4}"), F.date_format(day, "yyyyMMdd")).when(_month_first(m), F.date_format(day, "MMddyyyy")).otherwise(F.date_format(day, "ddMMyyyy"))

    octets = F.split(m, r"\.")
    ip = feistel_number(F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long")), 65536, 65536, key, "ip")
    dotted = F.concat_ws(".", *[(F.shiftright(ip, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return (
        F.when(kind == "email", F.concat(poured(local, feistel_text(_alnum(local), key, F.concat(F.lit("email@"), F.lower(domain)))), F.lit("@"), domain))
        .when(kind == "iban", poured(m, F.concat(country, iban_digits(country, account), account)))
        .when(kind == "date", poured(m, spelled))
        .when(kind == "ip", dotted)
        .when(kind == "phone", F.concat(prefix, poured(number, F.when(_national(ten), national).when(F.length(ten) == 10, other).otherwise(text(ten, "phone")))))
        .when(kind == "ssn", poured(m, ssn))
        .when(kind == "card", poured(m, F.concat(card, luhn_digit(card))))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with ``column`` rewritten; adds n_private (long), the number of values replaced.

    Every valid value is replaced wherever it stands, by a permutation under ``key`` of all values of its format:
    equal values have equal pseudonyms in all documents, different ones different pseudonyms. Anything that is not
    valid (a 16-digit number that fails Luhn's test, 31 February, an octet of 300) stays as it is. Texts without a
    match are passed through untouched; null and empty texts stay so with 0 values; repeated rows stay repeated; an empty table
    gives an empty result; an existing n_private is replaced, other columns are kept whatever their names. Whole texts
    are read, however long. The work is done where the row is: no shuffle, and no Python.
    """
    keep = [c for c in docs.columns if c != "n_private"]
    names = [f"c{i}" for i in range(len(keep))]
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)])
    text = F.col(names[keep.index(column)])
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    gaps = F.split(text, ANY, -1)
    # Every shape holds an @, three digits near each other, or two capitals before two digits (an IBAN's account may be of letters); a scan for
    # these spares most texts the search for the shapes.
    near = text.rlike("@|[0-9][^A-Za-z]{0,2}[0-9][^A-Za-z]{0,2}[0-9]|[A-Z]{2}[0-9]{2}")
    hit = own.withColumn("found", F.when(near & text.rlike(ANY), F.struct(found.alias("m"), gaps.alias("g"))))
    hit = hit.withColumn("kinds", F.transform("found.m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))))
    new = F.transform("kinds", lambda x: F.coalesce(pseudonym(x["m"], x["k"], key), x["m"]))
    count = F.size(F.filter("kinds", lambda x: x["k"].isNotNull())).cast("long")
    hit = hit.withColumn("new", F.when(F.col("found").isNotNull(), new))
    rebuilt = F.array_join(F.flatten(F.zip_with(F.col("found.g"), F.col("new"), lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    shown = F.when(F.col("found").isNotNull(), rebuilt).otherwise(text)
    private = F.when(F.col("found").isNotNull(), count).otherwise(F.lit(0).cast("long"))
    return hit.select(*[(shown if c == column else F.col(n)).alias(c) for c, n in zip(keep, names)], private.alias("n_private"))
