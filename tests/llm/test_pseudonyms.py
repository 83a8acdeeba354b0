"""Pseudonyms against the same permutations written in plain Python, and on odd values."""

import datetime as dt
import hashlib
import re
import time

from pyspark.sql import functions as F

from inkmark.llm import pii

KEY = "test-key"


def sha(bits, *parts):
    return hashlib.new(f"sha{bits}", "|".join(map(str, parts)).encode()).hexdigest()


def feistel_text(value, kind):
    n = len(value)
    left, right = value[: n // 2], value[n // 2 :]
    for r in range(pii.ROUNDS):
        half, other = (left, right) if r % 2 == 0 else (right, left)
        stream = "".join(sha(512, KEY, kind, r, n, b, other) for b in range(len(half) // 32 + 1))
        out = ""
        for i, c in enumerate(half):
            by = int(stream[4 * i : 4 * i + 4], 16)
            base, size = (48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26)
            out += chr(base + (ord(c) - base + by) % size)
        left, right = (out, right) if r % 2 == 0 else (left, out)
    return left + right


def feistel_number(v, a, b, kind):
    left, right = divmod(v, b)
    f = lambda r, other: int(sha(256, KEY, kind, r, other)[:15], 16)
    for r in range(pii.ROUNDS):
        left, right = ((left + f(r, right)) % a, right) if r % 2 == 0 else (left, (right + f(r, left)) % b)
    return left * b + right


def luhn(body):
    return str(-sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body))) % 10)


def mod97(country, account):
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def pour(shape, filling):
    it = iter(filling)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in shape)


def day_of(m):
    n = [int(x) for x in re.split("[./-]", m)]
    y, mo, d = n if len(m.split("-")[0].split("/")[0].split(".")[0]) == 4 else (n[2], n[0], n[1]) if n[1] > 12 else (n[2], n[1], n[0])
    try:
        return dt.date(y, mo, d)
    except ValueError:
        return None


FIRST = dt.date(1800, 1, 1)


def replaced(m):
    """The pseudonym of a match, or None where it isn't valid."""
    kind = next(k for k, p in pii.SHAPES.items() if re.fullmatch(p, m))
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        local, domain = m.split("@", 1)
        return pour(local, feistel_text(re.sub("[^0-9A-Za-z]", "", local), f"email@{domain.lower()}")) + "@" + domain
    if kind == "iban":
        s = m.replace(" ", "")
        if mod97(s[:2], s[4:]) != s[2:4]:
            return None
        a = feistel_text(s[4:], "iban")
        return pour(m, s[:2] + mod97(s[:2], a) + a)
    if kind == "date":
        day = day_of(m)
        if day is None or not 0 <= (day - FIRST).days < pii.DAYS_A * pii.DAYS_B:
            return None
        year_first = re.match("[0-9]{4}", m)
        month_first = not year_first and int(m[3:5]) > 12
        while True:
            day = FIRST + dt.timedelta(feistel_number((day - FIRST).days, pii.DAYS_A, pii.DAYS_B, "date"))
            if not month_first or day.day > 12:
                return pour(m, day.strftime("%Y%m%d" if year_first else "%m%d%Y" if month_first else "%d%m%Y"))
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        v = feistel_number(int.from_bytes(bytes(o), "big"), 65536, 65536, "ip")
        return ".".join(map(str, v.to_bytes(4, "big")))
    if kind == "phone":
        prefix = re.match(r"(\+[0-9]{1,3}(?=[ .(-])[ .-]?|\+)?", m)[0]
        rest = m[len(prefix) :]
        n = re.sub("[^0-9]", "", rest)
        national = lambda s: bool(re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", s))
        if national(n):
            v = feistel_number(((int(n[:3]) - 200) * 800 + int(n[3:6]) - 200) * 10000 + int(n[6:]), 640000, 10000, "phone")
            new = f"{v // 8000000 + 200}{v // 10000 % 800 + 200}{v % 10000:04d}"
        else:
            new = feistel_text(n, "phone")
            while len(n) == 10 and national(new):
                new = feistel_text(new, "phone")
        return prefix + pour(rest, new)
    if kind == "ssn":
        a, g, s = int(d[:3]), int(d[3:5]), int(d[5:])
        if a in (0, 666) or a >= 900 or not g or not s:
            return None
        valid = [x for x in range(1, 900) if x != 666]
        v = feistel_number((valid.index(a) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
        return pour(m, f"{valid[v // 9999 // 99]:03d}{v // 9999 % 99 + 1:02d}{v % 9999 + 1:04d}")
    return pour(m, (b := feistel_text(d[:-1], "card")) + luhn(b)) if luhn(d[:-1]) == d[-1] else None


def brute(text):
    n = 0

    def put(m):
        nonlocal n
        new = replaced(m[0])
        n += new is not None
        return m[0] if new is None else new

    return (re.sub(pii.ANY, put, text), n) if text is not None else (None, 0)


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r["text"], r["n_private"]) for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]


VALUES = [
    "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "378282246310005", "3782 822463 10005", "4111111111111112", "2024-02-29", "2023-02-29", "29.02.2024", "31/02/2024", "12/31/1999", "31/12/1999", "04/05/2001", "1999/12/31",
    "10.0.0.1", "255.255.255.255", "300.1.1.1", "+1 (017) 555-7713", "(555) 123-4567", "555-123-4567", "555 223 4567", "5552234567", "1552234567", "+49 30 1234 5678", "+442071234567", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB83WEST12345698765432",
    "me@a.example.com", "x@b.example.org", "X.y+z_9@sub.domain.example.co", "123-45-6789", "667-01-0001", "000-45-6789", "666-45-6789", "900-45-6789", "899-99-9999", "001-01-0001",
]


def test_values_are_those_of_plain_python(spark):
    texts = [*VALUES, *[f"See {v}, and again: ({v}) then {w}." for v, w in zip(VALUES, VALUES[::-1])], None, "", "nothing at all", "é 4111 1111 1111 1111 ü"]
    got = run(spark, texts)
    assert got == [brute(t) for t in texts]
    assert sum(n for _, n in got[: len(VALUES)]) == len(VALUES) - 9


def test_given_documents_are_those_of_plain_python(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = run(spark, texts)
    assert got == [brute(t) for t in texts] and sum(n for _, n in got) > 5


def test_classes_are_permuted_within_themselves(spark):
    ssn = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 50, 99) for s in range(1, 40)]
    late = [f"{m:02d}/{d}/{y}" for m in range(1, 13) for d in (13, 28) for y in range(1990, 2000)]
    early = [f"{d:02d}/{m:02d}/{y}" for m in range(1, 13) for d in (1, 12, 28) for y in range(1990, 2000)]
    phones = [f"{a}{e}{n:04d}" for a in (200, 555, 999) for e in (200, 999) for n in range(0, 9999, 500)]
    names = [f"{c}@{h}.example.com" for c in "abcXYZ09" for h in ("a", "b", "c")]
    single = [f"a@{h}{i}.example.com" for h in "pq" for i in range(30)]
    every = [*ssn, *late, *early, *phones, *names, *single]
    new = dict(zip(every, run(spark, every)))
    for values, fits in ((ssn, r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"), (late, r"(?:0[1-9]|1[0-2])/(?:1[3-9]|[23][0-9])/[0-9]{4}"), (early, r"[0-9]{2}/(?:0[1-9]|1[0-2])/[0-9]{4}"), (phones, r"[2-9][0-9]{2}[2-9][0-9]{6}"), (names, r"[A-Za-z0-9]@[abc]\.example\.com")):
        got = [new[v][0] for v in values if new[v][1] == 1]
        assert len(set(got)) == len(values) and all(re.fullmatch(fits, t) for t in got)
    assert len({new[v][0][0] for v in single}) > 8  # a single letter isn't shifted by one constant


def test_long_texts_do_not_overflow(spark):
    texts = ["x@" + "a." * 30_000 + "1", "x@" + "ab." * 300_000 + "com", "1" * 1_000_000, "1 " * 500_000, "1." * 500_000, "GB82 " + "WEST " * 200_000, "+1" + " 12" * 300_000, "a@" * 400_000, "a" * 1_000_000 + "@b.example.com", "- " * 500_000 + "4111 1111 1111 1111"]
    began = time.time()
    got = run(spark, texts)
    assert [n for _, n in got[-2:]] == [0, 1] and got[0] == (texts[0], 0)  # a name before the @ has 64 characters at most
    assert time.time() - began < 120


def test_inner_names_are_free(spark):
    df = spark.createDataFrame([(1, "me@a.example.com")], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_f", "_k", "_new", "found", "kinds", "new", "c0", "c1", "n_private")})
    got = pii.pseudonymise(df, KEY)
    r = got.first()
    assert got.columns == df.columns and r["n_private"] == 1 and all(r[c] == c for c in ("_f", "_k", "_new", "found", "kinds", "new", "c0", "c1"))


def test_an_iban_with_letters_only_is_found_wherever_it_stands(spark):
    rows = [(1, "pay GB71ABCDEFGHIJKLMNOP"), (2, "pay GB71ABCDEFGHIJKLMNOP ref 123")]
    got = {r["doc_id"]: (r["text"], r["n_private"]) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got[1][1] == got[2][1] == 1 and got[2][0] == got[1][0] + " ref 123" and "ABCDEFGHIJKLMNOP" not in got[1][0]
