"""Format-preserving Feistel pseudonyms for personal data (DataFrame functions only)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import T

ROUNDS = 8
#: For tests and examples; pass a secret of your own to keep pseudonyms from being undone.
DEMO_KEY = "rillwork-demo-key"

#: Set to a secret of your own, for the query and the pipeline. It stands in plans as a literal: keep event logs as safe as itself.
SECRET = "spark.rillwork.pii.secret"

#: A character is moved within the one of these that holds it; other ASCII stays. The private ones stand for digits 0 and 1,
#: and 2 to 9, where a phone number must begin with the latter to be callable, and for hexadecimal digits.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\ue000\ue001", "\ue002\ue003\ue004\ue005\ue006\ue007\ue008\ue009", "".join(map(chr, range(0xE010, 0xE020))))
_STAND_INS = CLASSES[3] + CLASSES[4]
_HEX = "0123456789abcdef"
#: Alphabets beyond ASCII, first and last code point: a letter is moved within its own. Letters, marks and digits of no listed
#: alphabet are moved within their run of ``RUN`` code points.
ALPHABETS = ((0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
RUN = 32

#: Days of the 400 years in which the calendar repeats, 1800 to 2199, as a product for two halves.
DATE_HALVES = (189, 773)
FIRST_DAY = "1800-01-01"


def _with_each(separators: tuple[str, ...], pattern: str) -> str:
    """``pattern`` with one separator throughout, for each, where it has ``S``."""
    return "(?:" + "|".join(pattern.replace("S", s) for s in separators) + ")"


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_LOCAL = r"\p{L}\p{N}\p{M}._%+-"
_DOMAIN = r"\p{L}\p{N}\p{M}.-"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: Kinds in the order in which they are tried at a place. Repetitions are bounded, or of one class and never undone.
PATTERNS = {
    "email": rf"(?<![{_LOCAL}]|[\p{{L}}\p{{N}}]')[{_LOCAL}]++(?:(?<=[\p{{L}}\p{{N}}])'(?=[\p{{L}}\p{{N}}])[{_LOCAL}]++)*+@(?:\[[0-9A-Fa-f:.]{{2,45}}\]|(?=[\p{{L}}\p{{N}}])(?=[{_DOMAIN}]*[\p{{L}}\p{{N}}\p{{M}}-]\.(?:[\p{{L}}\p{{M}}]{{2,}}|xn--[A-Za-z0-9-]{{2,}})[.-]*+(?![{_DOMAIN}]))[{_DOMAIN}]++)",
    "iban": r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,30}|" + _with_each((" ", "-", r"\."), r"S[A-Za-z0-9]{4}(?:S(?=[A-Za-z]{0,3}[0-9])[A-Za-z0-9]{4}){1,6}(?:S(?=[A-Za-z]{0,2}[0-9])[A-Za-z0-9]{1,3})?") + ")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-8][0-9]{2}" + _with_each((" ", "-"), "S[0-9]{2}S") + r"[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{{0,44}}[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|(?:{_GROUP}:){{1,7}}:|:(?::{_GROUP}){{1,7}})(?![0-9A-Za-z:])",
    "date": r"(?<![0-9./-])" + _with_each(("-", "/", r"\."), "(?:[0-9]{4}S[0-9]{1,2}S[0-9]{1,2}|[0-9]{1,2}S[0-9]{1,2}S[0-9]{4})") + r"(?![0-9/-]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2}[ -][0-9]{4}|\+[2-9][0-9]{0,2}(?:[ ./-]?\(0\))?(?:[ ./-][0-9](?=[ ./-]))?(?:[ ./-]?\(?[0-9]{2,4}\)?){2,5}"
    r"|00[2-9][0-9]{0,2}[ ./-](?:\(0\)[ ./-]?)?(?:[0-9](?=[ ./-]))?[ ./-]?\(?[0-9]{2,4}\)?(?:[ ./-]\(?[0-9]{2,4}\)?){1,4})(?![0-9])",
    "card": r"(?<![0-9])(?:" + _with_each((" ", "-", r"\."), "[0-9]{4}S(?:[0-9]{4}S[0-9]{4}S[0-9]{4}|[0-9]{6}S[0-9]{5})") + "|[0-9]{13,19})(?![0-9])",
}
NUMERIC = r"(?=[0-9+(:]|[A-Za-z]{2}[0-9]|[A-Fa-f][0-9A-Fa-f]{0,3}:)(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email") + ")"
ANY = f"(?:{PATTERNS['email']})|{NUMERIC}"


def secret_of(spark: SparkSession, otherwise: str = DEMO_KEY) -> str:
    """The session's key for pseudonyms."""
    return spark.conf.get(SECRET, None) or otherwise


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _draw(key: str, *parts: Column) -> Column:
    """A number below 2**48 from the keyed SHA-256 of ``parts``."""
    bound = F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts), F.lit(key))
    return F.conv(F.substring(F.sha2(bound.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def feistel_text(value: Column, key: str, tweak: str | Column) -> Column:
    """A keyed permutation of the strings that have ``value``'s form: each character stays in its class.

    The first half is shifted by what is drawn from the second, then the other way round, ``ROUNDS`` times.
    """

    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    alphabets = F.from_json(F.lit(json.dumps(ALPHABETS)), "array<array<int>>")  # folded once

    def shift(half: Column, other: Column, r: Column) -> Column:
        def one(j: Column) -> Column:
            c, by = F.substring(half, j, F.lit(1)), _draw(key, tweak, r, j, other)
            code = F.ascii(c)
            own = F.coalesce(F.get(F.filter(alphabets, lambda r: code.between(r[0], r[1])), F.lit(0)), F.array(code - code % RUN, code - code % RUN + (RUN - 1)))
            moved = _let(own, lambda r: F.decode(F.unhex(F.lpad(F.hex((r[0] + F.pmod(code - r[0] + by, r[1] - r[0] + 1)).cast("long")), 8, "0")), "UTF-32"))
            out = F.when((code > 127) & c.rlike(r"[\p{L}\p{N}\p{M}]"), moved).otherwise(c)
            for chars in CLASSES:
                at = F.instr(F.lit(chars), c)
                out = F.when(at > 0, F.substring(F.lit(chars), F.pmod(at - 1 + by, F.lit(len(chars))).cast("int") + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(_upto(F.length(half)), one), "")

    middle = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), middle).alias("a"), F.substring(value, middle + 1, F.length(value)).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, shift(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(shift(s["b"], s["a"], r)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def feistel_number(value: Column, halves: tuple[int | Column, int | Column], key: str, tweak: str | Column) -> Column:
    """A keyed permutation of the numbers below the product of ``halves``."""
    a, b = (F.lit(h) if isinstance(h, int) else h for h in halves)
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    start = F.struct(F.floor(value / b).cast("long").alias("a"), F.pmod(value, b).cast("long").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + _draw(key, tweak, r, s["b"])) % a).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + _draw(key, tweak, r, s["a"])) % b).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * b + s["b"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(form: Column, chars: Column, kind: str) -> Column:
    """``form`` with its characters of ``kind`` (a class) replaced by ``chars``, in order."""

    def one(j: Column) -> Column:
        c = F.substring(form, j, F.lit(1))
        place = F.length(F.regexp_replace(F.substring(form, F.lit(1), j), f"[^{kind}]", ""))
        return F.when(c.rlike(f"^[{kind}]$"), F.substring(chars, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_upto(F.length(form)), one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum with the last digit counted once."""

    def add(total: Column, j: Column) -> Column:
        d = F.substring(digits, -j, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(j % 2 == 0, twice).otherwise(d)

    return F.aggregate(_upto(F.length(digits)), F.lit(0), add)


def mod_97(text: Column) -> Column:
    """Remainder of an account number with its letters read as 10 to 35."""

    def add(rest: Column, j: Column) -> Column:
        c = F.substring(text, j, F.lit(1))
        letter = F.instr(F.lit(CLASSES[2]), c)
        return F.when(letter > 0, (rest * 100 + letter + 9) % 97).otherwise((rest * 10 + F.instr(F.lit(CLASSES[0]), c) - 1) % 97)

    return F.aggregate(_upto(F.length(text)), F.lit(0), add)


def _date_orders(value: Column) -> tuple[Column, Column, Column]:
    """The date that ``value`` says with the year first, the day first, and the month first; null where it says none."""
    parts = F.split(value, "[-/.]")
    two = lambda k: F.lpad(F.get(parts, F.lit(k)), 2, "0")

    def date(year: int, month: int, day: int) -> Column:
        found = F.concat_ws("-", F.get(parts, F.lit(year)), two(month), two(day)).try_cast("date")
        return F.when(F.length(F.get(parts, F.lit(year))) == 4, F.when(found.between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")), found))

    return date(0, 1, 2), date(2, 1, 0), date(2, 0, 1)


def _date_of(value: Column) -> Column:
    """The date; null if there is none in the 400 years. Where day and month may be either, the day comes first."""
    return F.coalesce(*_date_orders(value))


def kind_of(value: Column) -> Column:
    """The kind of a match of ``ANY`` that stands up to its check; null if it doesn't.

    Cards: Luhn. Account numbers: remainder 1 of 97, ten digits at least. Social security numbers: area, group and serial in use. Dates: on the calendar.
    Addresses, phones and mail addresses: by pattern.
    """
    digits, joined = _digits(value), F.upper(F.regexp_replace(value, "[ .-]", ""))
    turned = F.concat(F.substring(joined, F.lit(5), F.length(joined)), F.substring(joined, 1, 4))
    whole = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(whole("iban"), F.when((F.length(digits) >= 10) & (mod_97(turned) == 1), F.lit("iban")))
        .when(whole("ssn"), F.when(digits.rlike("^(?!000|666)[0-9]{3}(?!00)[0-9]{2}(?!0000)"), F.lit("ssn")))
        .when(whole("ip"), F.lit("ip"))
        .when(whole("ip6"), F.lit("ip6"))
        .when(whole("date"), F.when(_date_of(value).isNotNull(), F.lit("date")))
        .when(whole("phone"), F.lit("phone"))
        .when(whole("card"), F.when(luhn_sum(digits) % 10 == 0, F.lit("card")))
    )


def pseudonym(value: Column, key: str = DEMO_KEY) -> Column:
    """What stands for a match of ``ANY``; itself where ``kind_of`` is null. One value has one pseudonym.

    Cards keep their first digit and get a right check digit; account numbers keep their country and get right check
    digits; phones keep their country; mail addresses keep their domain, and signs before the first letter or digit; dates keep their order of
    day and month, and get leading zeros unless they do without; IPv6 addresses are written out. Separators stay, and neither they nor the case of an account number matter.
    """
    digits, plain = _digits(value), F.upper(F.regexp_replace(value, "[ .-]", ""))
    lead = F.regexp_extract(value, "^[._%+-]*", 0)
    abroad = value.rlike(r"^(?:\+|00)[2-9]")
    # a phone without what only tells how to dial it: 00 for +, and (0) before an area
    dialled = F.regexp_replace(F.regexp_replace(value, "^00(?=[2-9])", "OO"), r"\(0\)", "(O)")
    number = _digits(dialled)
    days = lambda: F.datediff(_date_of(value), F.lit(FIRST_DAY).cast("date"))

    def local() -> Column:
        """A phone number's last ten digits, with stand-ins where not all digits may stand."""
        n = F.substring(number, -10, 10)
        coded = lambda place: F.translate(F.substring(n, place, 1), CLASSES[0], _STAND_INS)
        return F.concat(coded(1), F.substring(n, 2, 2), coded(4), F.substring(n, 5, 6))

    def spelt() -> Column:
        """An IPv6 address's 32 digits, as stand-ins."""
        ends = F.split(F.lower(value), "::")
        groups = lambda k: F.filter(F.split(F.coalesce(F.get(ends, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
        zeros = F.array_repeat(F.lit("0"), 8 - F.size(groups(0)) - F.size(groups(1)))
        return F.translate(F.array_join(F.transform(F.concat(groups(0), zeros, groups(1)), lambda g: F.lpad(g, 4, "0")), ""), _HEX, CLASSES[5])

    def social() -> Column:
        # areas 1 to 899 but 666, groups 1 to 99, serials 1 to 9999, counted from 0
        area, group, serial = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
        return ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def text_of(k: Column) -> Column:
        """What is moved as text."""
        return (
            F.when(k == "email", F.substring(value, F.length(lead) + 1, F.instr(value, "@") - 1 - F.length(lead)))
            .when(k == "iban", F.substring(plain, F.lit(5), F.length(plain)))
            .when(k == "card", F.substring(digits, F.lit(2), F.length(digits) - 2))
            .when(k == "phone", F.when(abroad, F.substring(number, F.lit(4), F.length(number))).otherwise(local()))
            .when(k == "ip6", spelt())
        )

    def number_of(k: Column) -> Column:
        """What is moved as a number, with the halves of its range."""
        held = lambda n, halves: F.struct(n.cast("long").alias("n"), F.lit(halves[0]).cast("long").alias("a"), F.lit(halves[1]).cast("long").alias("b"))
        octets = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda n, o: n * 256 + o.cast("long"))
        return F.when(k == "date", held(days(), DATE_HALVES)).when(k == "ssn", held(social(), (898 * 99, 9999))).when(k == "ip", held(octets, (65536, 65536)))

    def card(middle: Column) -> Column:
        front = F.concat(F.substring(digits, 1, 1), middle)
        return _refill(value, F.concat(front, F.pmod(-luhn_sum(F.concat(front, F.lit("0"))), F.lit(10)).cast("string")), "0-9")

    def iban(body: Column) -> Column:
        land = F.substring(plain, 1, 2)
        new = F.concat(land, F.lpad((98 - mod_97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0"), body)
        refilled = _refill(F.upper(value), new, "A-Z0-9")
        return F.when(value.rlike("[a-z]"), F.lower(refilled)).otherwise(refilled)

    def phone(moved: Column) -> Column:
        home = F.concat(F.substring(number, F.lit(1), F.length(number) - 10), F.translate(moved, _STAND_INS, CLASSES[0]))
        return F.translate(_refill(dialled, F.when(abroad, F.concat(F.substring(number, 1, 3), moved)).otherwise(home), "0-9"), "O", "0")

    def ip6(moved: Column) -> Column:
        return _let(F.translate(moved, CLASSES[5], _HEX), lambda m: F.concat_ws(":", *(F.substring(m, 4 * j + 1, 4) for j in range(8))))

    def date(n: Column) -> Column:
        year_first, day_first, _ = _date_orders(value)
        d, sign, parts = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")), F.regexp_extract(value, "[-/.]", 0), F.split(value, "[-/.]")
        wide = F.when(F.exists(parts, lambda p: F.length(p) == 1), 1).otherwise(2)
        short = lambda m: F.when((wide == 2) & (m < 10), F.concat(F.lit("0"), m.cast("string"))).otherwise(m.cast("string"))
        said = F.array(F.year(d).cast("string"), short(F.month(d)), short(F.day(d)))
        order = F.when(year_first.isNotNull(), F.array(*map(F.lit, (0, 1, 2)))).when(day_first.isNotNull(), F.array(*map(F.lit, (2, 1, 0)))).otherwise(F.array(*map(F.lit, (1, 2, 0))))
        return F.aggregate(order, F.lit(""), lambda out, i: F.concat(out, F.when(out == "", "").otherwise(sign), F.get(said, i)))

    def ssn(n: Column) -> Column:
        pad = lambda m, width: F.lpad(m.cast("string"), width, "0")
        first = F.floor(n / (99 * 9999)) + 1
        return _refill(value, F.concat(pad(F.when(first >= 666, first + 1).otherwise(first), 3), pad(F.floor(n / 9999) % 99 + 1, 2), pad(n % 9999 + 1, 4)), "0-9")

    def ip(n: Column) -> Column:
        return F.concat_ws(".", *(F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))

    def of_text(k: Column, t: Column) -> Column:
        kept = F.concat(lead, t, F.substring(value, F.instr(value, "@"), F.length(value)))
        return F.when(k == "email", kept).when(k == "iban", iban(t)).when(k == "card", card(t)).when(k == "phone", phone(t)).otherwise(ip6(t))

    def of_number(k: Column, n: Column) -> Column:
        return F.when(k == "date", date(n)).when(k == "ssn", ssn(n)).otherwise(ip(n))

    def said(k: Column) -> Column:
        text = _let(feistel_text(text_of(k), key, k), lambda t: of_text(k, t))
        counted = _let(number_of(k), lambda h: _let(feistel_number(h["n"], (h["a"], h["b"]), key, k), lambda n: of_number(k, n)))
        return F.when(k.isin("date", "ssn", "ip"), counted).when(k.isNotNull(), text).otherwise(value)

    return _let(kind_of(value), said)


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_<kind>`` for each kind if ``counts``.

    A text without a match passes as it is; null stays null, with counts 0. Rows are independent: nothing is shuffled,
    and repeated rows give repeated results. Columns named ``n_<kind>`` are replaced if ``counts``.
    """
    # most texts are settled by a look for one character
    some = F.when(F.col(text).contains("@"), F.col(text).rlike(ANY)).when(F.col(text).rlike("[0-9]"), F.col(text).rlike(NUMERIC))
    found = F.when(some, F.regexp_extract_all(text, F.lit(ANY), 0))
    out = docs.withColumn(f"{T}found", found)
    clean = F.col(f"{T}found").isNull()
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(pieces, f"{T}found", lambda p, v: F.concat(p, F.coalesce(pseudonym(v, key), F.lit("")))), "")
    if counts:
        out = out.withColumn(f"{T}kinds", F.when(~clean, F.transform(f"{T}found", kind_of)))
        count = lambda k: F.size(F.filter(f"{T}kinds", lambda x: x == k)).cast("long")
        out = out.withColumns({f"n_{k}": F.when(clean, F.lit(0).cast("long")).otherwise(count(k)) for k in PATTERNS})
    return out.withColumn(text, F.when(clean, F.col(text)).otherwise(joined)).drop(f"{T}found", f"{T}kinds")


def pseudonym_report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``doc_id, text`` (pseudonymised) and the count of each kind, for every document. Key: ``SECRET``, else the demo's."""
    return pseudonymise(docs.select("doc_id", "text"), key or secret_of(docs.sparkSession))
