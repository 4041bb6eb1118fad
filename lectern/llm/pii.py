"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Card numbers (Luhn-checked), phone numbers, social security numbers, IPv4
addresses and dates are replaced by a keyed Feistel permutation of the values
of their own format, so the result is valid in that format, equal values stay
equal across documents, and different values stay different.  A card keeps a
correct check digit, a phone number its country code and punctuation (area codes
are digits like others and may come out unassigned), a date its notation.  E-mail addresses and hexadecimal secrets, which have no numeric
format, get a keyed digest in the same shape.  Values that fail validation
(wrong check digit, octet over 255, impossible date, unissued number) are left
alone.  Spellings of one phone number with its country code stay linked.

The matches of a text are one array in its row, so a very long text costs
memory in proportion to its matches.

A null text stays null, an empty one empty.  Every input row gives one row;
repeated rows and null ids are kept.  All columns of the input are passed on;
only ``text`` changes (and ``n_chars``, if present, follows it).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.rules import let

KEY = "lectern.pii.key"
ROUNDS = 8
EPOCH, DAYS = "1900-01-01", 65536
#: Steps to another day after the twelfth, at most.
WALK = 64

#: Patterns of the formats, in the order they are tried.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
LOCAL_PHONE = r"(?<![\d+(-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}(?!\d)"
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
OTHER = "|".join((EMAIL, IPV4, DATE, SSN, LOCAL_PHONE, HEX))
#: A card by its layout: 13 to 19 digits in one group, or 4-4-4-4, 4-6-5 and 4-6-4 digits.
LAYOUT = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)"
#: After +1 ten digits; other countries stop before the next value, else take up to four groups.
PHONE = (
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:[ .-]?\d{{2,4}}){{2,3}}?(?=[ .-](?:{OTHER}|{LAYOUT}))"
    r"|\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2}(?:[ .-]?\d{2,4}(?!\.?\d))?(?!\d)"
    rf"|{LOCAL_PHONE}"
)
#: A run of digit groups up to the next value of another format; ``_card`` finds the cards in it.
CARD = rf"(?<!\d)(?=\d(?:(?:[ -](?!{OTHER}))?\d){{12}})\d++(?:[ -](?!{OTHER})\d++)*+"
ANY = "|".join((EMAIL, IPV4, DATE, SSN, PHONE, HEX, CARD))
CARD_DIGITS = (13, 19)
#: Country codes of one and two digits; all others have three.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *(p.cast("string") for p in parts)), 256)


def feistel(left: Column, right: Column, of_left: Column, of_right: Column, tweak: str, key: str) -> Column:
    """Struct ``l, r``: a keyed permutation of the pairs in ``[0, of_left) x [0, of_right)``."""

    def noise(i: Column, x: Column, size: Column) -> Column:
        return F.pmod(F.conv(F.substring(_keyed(key, F.lit(tweak), size, i, x), 1, 15), 16, 10).cast("long"), size)

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + noise(i, s["r"], of_left), of_left)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + noise(i, s["l"], of_right), of_right)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, tweak: str, key: str) -> Column:
    """Permutation of the strings of as many digits (2 to 30)."""
    a = (F.length(digits) / 2).cast("int")
    b = F.length(digits) - a
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    pair = feistel(F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, b).cast("long"), power(a), power(b), tweak, key)
    return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), a, "0"), F.lpad(p["r"].cast("string"), b, "0")))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; of digits counted from the right, those with index % 2 == ``doubled`` count twice."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: s["out"])


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _one_card(m: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        body = permute_digits(F.left(d, F.length(d) - 1), "card", key)
        whole = let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))
        return let(whole, lambda w: refill(m, w))

    return let(only_digits(m), changed)


def _spans(groups: Column, i: Column) -> Column:
    """Spans ``text, last, laid`` of groups from ``i`` on that pass the Luhn check, shortest first; ``laid`` tells a card's layout."""

    def span(j: Column) -> Column:
        return F.struct(F.array_join(F.slice(groups, i + 1, j - i + 1), "").alias("text"), j.alias("last"))

    def valid(s: Column) -> Column:
        return let(only_digits(s["text"]), lambda d: F.length(d).between(*CARD_DIGITS) & (luhn_sum(d, 1) % 10 == 0))

    all_of = F.transform(F.sequence(i, F.least(i + CARD_DIGITS[1] - 1, F.size(groups) - 1)), span)
    near = F.filter(all_of, lambda s: F.length(s["text"]).between(CARD_DIGITS[0], 2 * CARD_DIGITS[1]))
    return F.transform(F.filter(near, valid), lambda s: s.withField("laid", s["text"].rlike(rf"\A[ -]?(?:{LAYOUT})\z")))


def _card(m: Column, key: str) -> Column:
    """A run of digit groups with its cards replaced.

    From the left, a card in one of the layouts goes first; else the longest
    valid span that does not reach into a card in one of the layouts.  Where two
    cards overlap and both pass the check, nothing tells them apart: the left one is taken.
    """

    def changed(groups: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(groups) - 1)

        def pick(spans: Column) -> Column:
            def choose(i: Column) -> Column:
                own = F.get(spans, i)
                laid = F.filter(own, lambda s: s["laid"])
                free = F.filter(own, lambda s: ~F.exists(at, lambda j: (j > i) & (j <= s["last"]) & F.exists(F.get(spans, j), lambda x: x["laid"])))
                return F.coalesce(F.get(laid, F.lit(0)), F.try_element_at(free, F.lit(-1)))

            def step(s: Column, i: Column) -> Column:
                def put(c: Column) -> Column:
                    out = F.when(i < s["next"], F.lit("")).when(c.isNull(), F.get(groups, i)).otherwise(_one_card(c["text"], key))
                    after = F.when((i >= s["next"]) & c.isNotNull(), c["last"] + 1).otherwise(s["next"])
                    return F.struct(F.concat(s["out"], out).alias("out"), after.alias("next"))

                return let(choose(i), put)

            return F.aggregate(at, F.struct(F.lit("").alias("out"), F.lit(0).alias("next")), step, lambda s: s["out"])

        return let(F.transform(at, lambda i: _spans(groups, i)), pick)

    # each group with the separator before it
    return let(F.split(m, "(?=[ -])"), changed)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, rf"^\+({COUNTRY})", 1)

    def changed(d: Column) -> Column:
        k = F.length(code)
        rest = permute_digits(F.substring(d, k + 1, F.length(d)), "phone", key)
        return let(F.concat(code, rest), lambda w: refill(m, w))

    return let(only_digits(m), changed)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99 and serials 0001 to 9999 are numbered without gaps and permuted."""

    def changed(d: Column) -> Column:
        number = lambda a, n: F.substring(d, a, n).cast("int")
        area, group, serial = number(1, 3), number(4, 2), number(6, 4)
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        place = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
        pair = feistel(place, serial - 1, F.lit(898 * 99), F.lit(9999), "ssn", key)

        def shown(p: Column) -> Column:
            a = F.floor(p["l"] / 99)
            return F.format_string("%03d-%02d-%04d", a + F.when(a >= 665, 2).otherwise(1), p["l"] % 99 + 1, p["r"] + 1)

        return F.when(valid, let(pair, shown)).otherwise(m)

    return let(only_digits(m), changed)


def _ipv4(m: Column, key: str) -> Column:
    """Octets written with leading zeros come out with three digits each."""

    def changed(o: Column) -> Column:
        octet = lambda k: F.get(o, F.lit(k)).cast("int")
        pair = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), "ipv4", key)
        padded = F.exists(o, lambda x: x.rlike("^0[0-9]"))
        shown = lambda x: F.when(padded, F.lpad(x.cast("int").cast("string"), 3, "0")).otherwise(x.cast("int").cast("string"))
        out = let(pair, lambda p: F.concat_ws(".", *(shown(x) for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), out).otherwise(m)

    return let(F.split(m, "[.]"), changed)


def _moved(day: Column, key: str) -> Column:
    """A permutation of the days of each block of ``DAYS``."""
    n = F.datediff(day, F.lit(EPOCH).cast("date"))
    within = F.pmod(n, F.lit(DAYS))
    pair = feistel(F.floor(within / 256), within % 256, F.lit(256), F.lit(256), "date", key)
    return let(pair, lambda p: F.date_add(F.lit(EPOCH).cast("date"), (F.floor(n / DAYS) * DAYS + p["l"] * 256 + p["r"]).cast("int")))


def _late(day: Column, key: str) -> Column:
    """A permutation of the days after the twelfth of their months: the other one, repeated until it comes to such a day.

    About six days in ten are such; where ``WALK`` steps find none, which no
    key of chance does, the day stays null and its text as it was.
    """

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(_moved(s["day"], key), lambda d: F.struct(d.alias("day"), (F.dayofmonth(d) > 12).alias("done"))))

    start = F.struct(day.alias("day"), F.lit(False).alias("done"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step), lambda s: F.when(s["done"], s["day"]))


def _date(m: Column, key: str) -> Column:
    """Slashed dates are read month first; those that cannot be, day first, and they stay so."""

    def changed(form: str, move=_moved):
        return let(F.try_to_timestamp(m, F.lit(form)).cast("date"), lambda day: F.date_format(move(day, key), form))

    dashed, dotted = changed("yyyy-MM-dd"), changed("dd.MM.yyyy")
    slashed = F.coalesce(changed("MM/dd/yyyy"), changed("dd/MM/yyyy", _late))
    return F.coalesce(F.when(F.contains(m, F.lit("-")), dashed).when(F.contains(m, F.lit("/")), slashed).otherwise(dotted), m)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_keyed(key, F.lit("email"), F.lower(m)), 1, 12), F.lit("@example.invalid"))


def _hex(m: Column, key: str) -> Column:
    digest = F.left(_keyed(key, F.lit("hex"), F.lower(m)), F.length(m))
    return F.when(m == F.upper(m), F.upper(digest)).otherwise(digest)


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one match of ``ANY``."""
    is_ = lambda p: m.rlike(rf"\A(?:{p})\z")
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(is_(IPV4), _ipv4(m, key))
        .when(is_(DATE), _date(m, key))
        .when(is_(SSN), _ssn(m, key))
        .when(is_(PHONE), _phone(m, key))
        .when(is_(HEX), _hex(m, key))
        .otherwise(_card(m, key))
    )


def replace(text: Column, key: str) -> Column:
    """The text with every match replaced; what lies between matches is untouched."""
    between = F.split(text, ANY)
    instead = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key))
    whole = F.array_join(F.zip_with(between, instead, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike("[0-9@]"), whole).otherwise(text)


def session_key(spark: SparkSession) -> str:
    """The key in the setting ``lectern.pii.key``; where it is unset, a random one that the session keeps to itself."""
    found = spark.conf.get(KEY, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY, found)
    return found


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced under ``key``, or else the session's key.

    Pseudonyms of different runs agree only under the same key, and whoever
    knows it can undo them.  The key is part of the plan, so plans and event logs
    of such a run are as secret as it is.
    """
    key = key or session_key(docs.sparkSession)
    changed = replace(F.col("text"), key)
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(changed.alias("text"))
        else:
            out.append(F.col(f"`{c}`"))
    result = docs.select(*out)
    return result.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else result
