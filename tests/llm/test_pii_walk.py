"""Operator 6 value by value: every pseudonym equals a plain walk of the permutation, and the inverse walk gives the value back."""
import datetime as dt
import hashlib
import random
import re

from revspark.llm import pii

KEY = "walk key"
RANGES = [(48, 10), (65, 26), (97, 26), (192, 23), (216, 7), (223, 24), (248, 8)]
DAY0 = dt.date(1800, 1, 1)


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def moved(x, d, sign):
    out = []
    for i, c in enumerate(x):
        step = int(d[4 * (i % 16):4 * (i % 16) + 4], 16)
        lo, n = next(((lo, n) for lo, n in RANGES if lo <= ord(c) < lo + n), (0, 0))
        out.append(chr(lo + (ord(c) - lo + sign * step) % n) if n else c)
    return "".join(out)


def text_forward(x, kind):
    a, b = x[:len(x) // 2], x[len(x) // 2:]
    for r in range(1, 9):
        a, b = b, moved(a, digest(KEY, kind, r, len(a), b), 1)
    return a + b


def text_back(x, kind):
    a, b = x[:len(x) // 2], x[len(x) // 2:]
    for r in range(8, 0, -1):
        a, b = moved(b, digest(KEY, kind, r, len(b), a), -1), a
    return a + b


def number_forward(left, right, a, b, kind):
    for r in range(1, 9):
        left = (left + int(digest(KEY, kind, "l", r, right)[:12], 16)) % a
        right = (right + int(digest(KEY, kind, "r", r, left)[:12], 16)) % b
    return left, right


def number_back(left, right, a, b, kind):
    for r in range(8, 0, -1):
        right = (right - int(digest(KEY, kind, "r", r, left)[:12], 16)) % b
        left = (left - int(digest(KEY, kind, "l", r, right)[:12], 16)) % a
    return left, right


def check_digit(body):
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
    return str(-total % 10)


def refill(old, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in old)


def card(x, walk):
    d = re.sub(r"\D", "", x)
    body = walk(d[:-1], "card")
    return refill(x, body + check_digit(body))


def phone(x, walk):
    return refill(x, walk(re.sub(r"\D", "", x), "phone"))


def ssn(x, walk):
    area, group, serial = map(int, x.split("-"))
    left, right = walk(area - 2 if area > 666 else area - 1, (group - 1) * 9999 + serial - 1, 898, 989901, "ssn")
    return f"{left + 2 if left >= 665 else left + 1:03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"


def ip(x, walk):
    octets = x.split(".")
    low, many = [[0, 10, 100][len(o) - 1] for o in octets], [[10, 90, 156][len(o) - 1] for o in octets]
    at = [int(o) - n for o, n in zip(octets, low)]
    left, right = walk(at[0] * many[1] + at[1], at[2] * many[3] + at[3], many[0] * many[1], many[2] * many[3], "ip")
    new = [left // many[1], left % many[1], right // many[3], right % many[3]]
    return ".".join(str(n + k) for n, k in zip(new, low))


def date(x, walk):
    n = (dt.date.fromisoformat(x) - DAY0).days
    left, right = walk(n % 189, n // 189, 189, 773, "date")
    return (DAY0 + dt.timedelta(days=right * 189 + left)).isoformat()


def email(x, walk):
    local, domain = x.split("@")
    host, top = domain.rsplit(".", 1)
    return f"{walk(local, 'email-local')}@{walk(host, 'email-host')}.{top}"


def values():
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = []
    for _ in range(60):
        body = "4" + digits(rng.choice([12, 14, 15]))
        whole = body + check_digit(body)
        out.append((card, "-".join(whole[k:k + 4] for k in range(0, 16, 4)) if len(whole) == 16 and rng.random() < 0.5 else whole))
        out.append((phone, rng.choice(["{}-{}-{}", "({}) {}-{}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))))
        out.append((ssn, f"{rng.choice([1, 665, 667, 899, rng.randint(1, 600)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"))
        out.append((ip, ".".join(str(rng.choice([rng.randint(0, 9), rng.randint(10, 99), rng.randint(100, 255)])) for _ in range(4))))
        out.append((date, (DAY0 + dt.timedelta(days=rng.randrange(146_097))).isoformat()))
        word = lambda: "".join(rng.choice("abcXYZ019") for _ in range(rng.randint(1, 40)))
        out.append((email, f"{word()}.é{word()}@a{word()}.b{word()[:9]}.org"))
    return out


def test_pseudonyms_equal_a_plain_walk_and_its_inverse(spark):
    cases = values()
    df = spark.createDataFrame([(k, f"see {x} now") for k, (_, x) in enumerate(cases)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text[4:-4] for r in pii.pseudonymise(df, KEY).collect()}
    forward = {True: text_forward, False: number_forward}
    back = {True: text_back, False: number_back}
    for k, (form, x) in enumerate(cases):
        by_text = form in (card, phone, email)
        assert got[k] == form(x, forward[by_text]), (form.__name__, x)
        assert form(got[k], back[by_text]) == x, (form.__name__, x)
