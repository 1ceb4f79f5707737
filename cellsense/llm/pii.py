"""Format-preserving pseudonyms for private values, with DataFrame functions only.

Numbers and dates that pass their validation are put through a keyed Feistel permutation of their own format, so
equal values get equal pseudonyms in every document and different values never meet. Payment cards keep a right check digit,
IPv4 addresses and social-security numbers stay in range, dates stay calendar dates, phone numbers keep country
code and punctuation; e-mail addresses and credentials keep the class of each character.

Each text is matched twice by one pattern (the gaps and the hits) and joined again; texts without a digit, an
at-sign or a credential's name aren't matched at all. No shuffle: the operator is a projection.

Defined cases: a null text stays null and an empty one empty; values that fail validation stay as they are; a value
met inside a longer word or number is not one; an address has at most 127 labels of 63 characters, as names on the network have;
texts of any length are read whole: no pattern repeats a group without a bound or by backtracking, so the matcher's
stack doesn't grow with the text, and a hit of n characters costs n hashes a round; of overlapping card numbers the usual grouping,
then the first, then the longest counts; repeated rows are treated alike; other columns are untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What may be private, by kind, the first that fits at a place; see ``pseudonym`` for the validation.
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+",
    "key": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "secret": r"(?<!\w)(?i:password|passwd|secret|token|api_key)\s?[=:]\s?\x22?[A-Za-z0-9+/=_-]{8,}+\x22?(?!\w)",
    "phone": r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "isodate": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "date": r"(?<![\w./])\d{1,2}[./]\d{1,2}[./]\d{4}(?![\w/])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
}
#: A run of digit groups, up to where another kind begins; cards are looked for among its groups.
KINDS["card"] = r"(?<![\w-])(?=\d(?:[ -]?\d){12})\d++(?!\w)(?:[ -](?!%s)\d++(?!\w))*+" % "|".join(KINDS[k] for k in ("phone", "ip", "isodate", "date", "ssn"))
PATTERN = "|".join(KINDS.values())

#: The 400 years that dates are permuted in: 1800-01-01 .. 2199-12-31, as 189 x 773 days.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def _prf(key: str, *parts: Column) -> Column:
    """A non-negative number of 60 bits from the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _shift(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """A character moved on within its own alphabet; any other character as it is."""
    out = c
    for a in alphabets:
        at = (F.position(c, F.lit(a)) - 1 + by) % F.lit(len(a)) + 1
        out = F.when((c != "") & F.lit(a).contains(c), F.substr(F.lit(a), at.cast("int"), F.lit(1))).otherwise(out)
    return out


def permute_text(s: Column, key: str, kind: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """Feistel permutation of the strings with the same class at each place: every character moves within its alphabet."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), acc.r), 256)  # of the other half, once a round
        move = lambda h: F.array_join(F.transform(F.split(acc.l, ""), lambda c, j: _shift(c, _prf(key, h, j) % 1000003, alphabets)), "")
        return F.struct(acc.r.alias("l"), F.transform(F.array(seed), move)[0].alias("r"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(done.l, done.r)


def permute_pair(x: Column, y: Column, a: int, b: int, key: str, kind: str) -> tuple[Column, Column]:
    """Feistel permutation of the pairs (x < a, y < b)."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(acc: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(((acc.x + _prf(key, F.lit(kind), i, acc.y) % a) % a).alias("x"), acc.y.alias("y"))
        ).otherwise(F.struct(acc.x.alias("x"), ((acc.y + _prf(key, F.lit(kind), i, acc.x) % b) % b).alias("y")))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return done.x, done.y


def _refill(hit: Column, digits: Column) -> Column:
    """The hit with its digits replaced, in order, by ``digits``."""
    seen = lambda i: F.length(F.regexp_replace(F.substr(hit, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(hit, ""), lambda c, i: F.when((c != "") & F.lit(DIGITS).contains(c), F.substr(digits, seen(i), F.lit(1))).otherwise(c)), "")


def _new_date(d: Column, key: str) -> Column:
    """The pseudonym of a date, null when it is outside the 400 years."""
    n = F.datediff(d, F.to_date(F.lit(FIRST_DAY)))
    x, y = permute_pair(F.floor(n / DAYS_B), n % DAYS_B, DAYS_A, DAYS_B, key, "date")
    return F.when((n >= 0) & (n < DAYS_A * DAYS_B), F.date_add(F.to_date(F.lit(FIRST_DAY)), (x * DAYS_B + y).cast("int")))


def _card(part: Column, key: str) -> Column:
    """The pseudonym of a card number, with a right check digit."""
    digits = F.regexp_replace(part, "[^0-9]", "")
    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.transform(F.array(body), lambda b: F.concat(b, F.filter(F.array(*[F.lit(d) for d in DIGITS]), lambda d: F.call_function("luhn_check", F.concat(b, d)))[0]))[0]
    return _refill(part, check)


def _cards(run: Column, key: str) -> Column:
    """A run of digit groups with the card numbers replaced: spans of whole groups, 13 to 19 digits, with a right check
    digit; the usual groupings first, then the leftmost, then the longest; spans don't overlap."""
    parts = F.regexp_extract_all(run, F.lit("[0-9]+|[ -]"), F.lit(0))  # groups at even places
    # by places, as a slice would walk the whole run each time
    text = lambda parts, i, j: F.when(j < i, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(i, F.greatest(i, j)), lambda k: F.get(parts, k)), ""))
    digits = lambda t: F.regexp_replace(t, "[^0-9]", "")
    usual = lambda t: t.rlike(r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})$")

    def spans(parts: Column) -> Column:
        """The valid spans (usual, i, j, t) by first group, the longest first; what isn't valid is dropped group by group."""
        last = lambda i: F.least(i + 36, F.size(parts) - 1)  # noqa: E731 - 19 groups at most
        made = lambda i: F.transform(F.sequence(last(i), i, F.lit(-2)), lambda j: F.struct(i.alias("i"), j.alias("j"), text(parts, i, j).alias("t")))
        good = lambda i: F.filter(made(i), lambda x: F.length(digits(x.t)).between(13, 19) & F.call_function("luhn_check", digits(x.t)))
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)), good))
        return F.transform(every, lambda x: F.struct(usual(x.t).alias("usual"), x.i.alias("i"), x.j.alias("j"), x.t.alias("t")))

    def apart(xs: Column) -> Column:
        """Of spans in order, each that begins after the last one taken."""
        start = F.struct(F.lit(0).alias("free"), F.filter(xs, lambda x: F.lit(False)).alias("taken"))
        take = lambda s, x: F.when(x.i < s.free, s).otherwise(F.struct((x.j + 1).alias("free"), F.concat(s.taken, F.array(x)).alias("taken")))
        return F.aggregate(xs, start, take, lambda s: s.taken)

    def both(spans: Column, first: Column) -> Column:
        free = F.filter(spans, lambda x: ~x.usual & ~F.exists(first, lambda y: (x.i <= y.j) & (y.i <= x.j)))
        return F.array_sort(F.concat(first, apart(free)), lambda x, y: x.i - y.i)

    def rebuilt(parts: Column, taken: Column) -> Column:
        after = lambda n: F.coalesce(F.get(taken, n - 1).j, F.lit(-1))  # noqa: E731 - the end of the span before
        pieces = F.transform(taken, lambda y, n: F.concat(text(parts, after(n) + 1, y.i - 1), _card(y.t, key)))
        return F.concat(F.array_join(pieces, ""), text(parts, after(F.size(taken)) + 1, F.size(parts) - 1))

    bound = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731 - worked out once
    return bound(parts, lambda p: bound(spans(p), lambda s: F.when(F.size(s) == 0, run).otherwise(bound(apart(F.filter(s, lambda x: x.usual)), lambda f: bound(both(s, f), lambda t: rebuilt(p, t))))))


def pseudonym(hit: Column, key: str) -> Column:
    """The pseudonym of one hit of PATTERN, or the hit where it isn't valid."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    is_a = lambda kind: hit.rlike(f"^(?:{KINDS[kind]})$")

    tld = F.length(F.regexp_extract(hit, r"(\.[A-Za-z0-9-]+)$", 1))
    email = F.concat(permute_text(F.substr(hit, F.lit(1), F.length(hit) - tld), key, "email"), F.substr(hit, F.length(hit) - tld + 1, tld))
    access = F.concat(F.lit("AKIA"), permute_text(F.substr(hit, F.lit(5), F.lit(16)), key, "key"))
    lead = F.length(F.regexp_extract(hit, r"^([A-Za-z_]+\s?[=:]\s?\x22?)", 1))
    secret = F.concat(F.substr(hit, F.lit(1), lead), permute_text(F.substr(hit, lead + 1, F.length(hit)), key, "secret"))
    phone = _refill(hit, F.concat(F.substr(digits, F.lit(1), n - 10), permute_text(F.substr(digits, n - 9, F.lit(10)), key, "phone")))

    octet = F.transform(F.split(hit, r"\."), lambda x: x.cast("int"))
    ip_x, ip_y = permute_pair(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65536, 65536, key, "ip")
    ip = F.concat_ws(".", F.floor(ip_x / 256), ip_x % 256, F.floor(ip_y / 256), ip_y % 256)
    ip = F.when(F.forall(octet, lambda x: x <= 255), ip).otherwise(hit)

    iso = F.coalesce(F.date_format(_new_date(F.try_to_date(hit, "yyyy-MM-dd"), key), "yyyy-MM-dd"), hit)
    sep = F.regexp_extract(hit, r"([./])", 1)
    part = F.split(hit, r"[./]")
    padded = (F.length(part[0]) == 2) & (F.length(part[1]) == 2)
    number = lambda d, f: F.when(padded, F.date_format(d, f * 2)).otherwise(F.date_format(d, f).cast("int").cast("string"))
    as_date = lambda d, m: F.try_to_date(F.concat_ws("-", part[2], F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    dm, md = _new_date(as_date(part[0], part[1]), key), _new_date(as_date(part[1], part[0]), key)
    year = lambda d: F.date_format(d, "yyyy")
    date = F.when(F.substring(sep, 1, 1) != F.substr(hit, F.length(hit) - 4, F.lit(1)), hit).otherwise(
        F.coalesce(F.concat(number(dm, "d"), sep, number(dm, "M"), sep, year(dm)), F.concat(number(md, "M"), sep, number(md, "d"), sep, year(md)), hit)
    )

    area, group, serial = (F.substring(digits, *x).cast("int") for x in ((1, 3), (4, 2), (6, 4)))
    valid_ssn = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    s_x, s_y = permute_pair((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    new_area = F.floor(s_x / 99) + 1
    new_area = F.when(new_area >= 666, new_area + 1).otherwise(new_area)
    pad = lambda c, w: F.lpad(c.cast("string"), w, "0")
    ssn = F.when(valid_ssn, F.concat_ws("-", pad(new_area, 3), pad(s_x % 99 + 1, 2), pad(s_y + 1, 4))).otherwise(hit)

    made = {"email": email, "key": access, "secret": secret, "phone": phone, "ip": ip, "isodate": iso, "date": date, "ssn": ssn, "card": _cards(hit, key)}
    return reduce(lambda rest, kind: F.when(is_a(kind), made[kind]).otherwise(rest), reversed(KINDS), hit)


def pseudonymise_text(text: Column, key: str) -> Column:
    """The text with every valid private value replaced."""
    gaps, hits = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    new = F.concat(F.transform(hits, lambda h: pseudonym(h, key)), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(gaps, new, lambda g, h: F.concat(g, h)), "")
    return F.when(text.rlike("[0-9@]|(?i:password|passwd|secret|token|api_key)"), joined).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents, same columns, with private values in ``text_col`` replaced by pseudonyms under ``key``."""
    return docs.withColumn(text_col, pseudonymise_text(F.col(text_col), key))
