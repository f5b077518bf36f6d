"""Format-preserving pseudonyms of personal numbers and dates, by keyed Feistel permutations.

One pattern finds candidates; each is validated by its kind: card numbers by length and Luhn digit, account numbers
(IBAN) by mod 97, addresses (IPv4) by octets, social security numbers by their areas, phone numbers by shape and length,
dates by the calendar. A valid value is split in two halves, which eight rounds of a keyed hash add to each other
modulo the half's range; that permutes the values of one kind and length, so equal values have equal pseudonyms in all
documents and different ones different pseudonyms. Check digits are computed anew, separators and country prefixes stay.
An e-mail address, which is no number, gets a keyed hash as its local part. What isn't valid stays as it is.

Ranges are products of two factors, so that no value is permuted out of its format: 10**a * 10**b for digits, 65536 *
65536 for addresses, 898 * 989901 for social security numbers, and 189 * 773 for the days of the 400 years from 1700.

A candidate takes the whole run of digits or capitals that it stands in. If the run isn't valid, what lies between any two
separators of it is tried, from the left and the longest first: a card behind a year or before its expiry date, an account
number between codes. Within a longer run a card is in groups as they are printed and begins like one, as one in ten rows of
numbers passes the check digit; phones, dates and social security numbers have no hyphen beside them. What is left of the run is searched anew.

It is a row-wise expression: nothing is shuffled or collected.

Defined cases: dates outside 1700 to 2099 stay in clear, as days are permuted within those years; a null text stays null with counts of 0; an empty text stays; repeated rows are treated each alike; an empty
table gives an empty result; where the input has columns named as the counts, only the id is read beside the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Shapes of candidates. Repeats are bounded or possessive, so that long texts are read once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
DAY_FIRST = r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9]|/[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: The runs that account numbers and cards stand in.
IBAN_RUN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11})[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z]|-[0-9])(?: [A-Z0-9]++(?![a-z]|-[0-9]))*+"
CARD_RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+"
#: How cards are printed, and how their numbers begin.
GROUPED = r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}"
ISSUED = r"^(?:[3-6]|2(?:2[2-9]|[3-6]|7[01]|720))"
NORTH_AMERICAN = r"(?<![0-9A-Za-z+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])"
KINDS = ("email", "iban", "address", "date", "ssn", "card", "phone")
CANDIDATE = "|".join(f"(?:{x})" for x in (EMAIL, IBAN_RUN, ADDRESS, DATE, DAY_FIRST, SSN, CARD_RUN, NORTH_AMERICAN, PHONE))

#: A piece of a run has at most so many characters: an account number in groups of one.
LONGEST = 67
#: Stands in a text, while it is worked on, where a candidate is cut off.
CUT = "\ue000\ue004\ue000"

FIRST_DAY = "1700-01-01"
DAYS = (189, 773)
AREAS, SERIALS = 898, 99 * 9999


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyed(key: str, *parts: Column | str | int) -> Column:
    """A number below 2**60 from the key and the parts."""
    columns = [x if isinstance(x, Column) else F.lit(str(x)) for x in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *columns), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str | Column, left: Column, right: Column, left_range: Column, right_range: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(a, b) of the permuted pair; left and right are below their ranges, and so are a and b."""

    def turn(pair: Column, i: Column) -> Column:
        at, a, b = i.cast("string"), pair["a"], pair["b"]
        return F.when(i % 2 == 0, F.struct(((a + keyed(key, kind, at, b.cast("string"))) % left_range).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), ((b + keyed(key, kind, at, a.cast("string"))) % right_range).alias("b"))
        )

    pair = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, turn, lambda p: use(p["a"], p["b"]))


def power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 34 digits to another of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    return feistel(
        key, F.concat(F.lit(kind), n.cast("string")), F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n), power(half), power(n - half),
        lambda a, b: F.concat(F.lpad(a.cast("string"), half, "0"), F.lpad(b.cast("string"), n - half, "0")),
    )


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def filled(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in order."""

    def step(acc: Column, i: Column) -> Column:
        char = F.substring(shape, i, F.lit(1))
        digit = char.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(digits, acc["k"], F.lit(1))).otherwise(char)).alias("out"), (acc["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(shape)), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step)["out"]


def luhn_sum(digits: Column, double_odd: bool) -> Column:
    """Luhn's sum from the right; double_odd: the last digit is doubled, as where the check digit is yet to come."""

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == int(double_odd), 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def mod97(account: Column) -> Column:
    """Of an account number with its first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        char = F.substring(turned, i, F.lit(1))
        return F.when(char.between("0", "9"), acc * 10 + F.ascii(char) - 48).otherwise(acc * 100 + F.ascii(char) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def is_a(shape: str, m: Column) -> Column:
    return m.rlike(f"^(?:{shape})$")


def day_of(m: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")), F.try_to_timestamp(m, F.lit("dd/MM/yyyy"))).cast("date")


def kind_of(m: Column) -> Column:
    """The kind of a candidate that is valid, else null."""
    d, day = digits_of(m), day_of(m)
    octets = F.forall(F.split(m, r"\."), lambda x: F.try_to_number(x, F.lit("999")) <= 255)
    area = F.substring(d, 1, 3).cast("int")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(is_a(IBAN, m) & (mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1), "iban")
        .when(is_a(ADDRESS, m) & octets, "address")
        .when((is_a(DATE, m) | is_a(DAY_FIRST, m)) & F.year(day).between(1700, 2099), "date")
        .when(is_a(SSN, m) & (area > 0) & (area != 666) & (area < 900) & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000"), "ssn")
        .when(is_a(CARD, m) & F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0), "card")
        .when((is_a(NORTH_AMERICAN, m) | is_a(PHONE, m)) & F.length(d).between(10, 15), "phone")
    )


def pieces_of(m: Column) -> Column:
    """Array of structs first, last (1-based): valid values within a run, apart from each other, from the left and the longest first."""
    separator = lambda i: F.substring(m, i, F.lit(1)).isin(" ", "-")
    starts = F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: ~separator(i) & ((i == 1) | separator(i - 1)))

    def valid(s: Column, e: Column) -> Column:
        x, hyphen = F.substring(m, s, e - s + 1), lambda i: F.substring(m, i, F.lit(1)) == "-"
        card, apart = is_a(GROUPED, x) & x.rlike(ISSUED), ~(((s > 1) & hyphen(F.greatest(s - 1, F.lit(1)))) | hyphen(e + 1))
        return let(kind_of(x), lambda kind: F.coalesce((kind == "iban") | ((kind == "card") & card) | (kind.isin("ssn", "phone", "date") & apart), F.lit(False)))

    def longest(s: Column) -> Column:
        ends = F.filter(F.sequence(s, F.least(F.length(m), s + LONGEST - 1)), lambda e: (e >= s + 9) & ~separator(e) & ((e == F.length(m)) | separator(e + 1)))
        return F.array_max(F.filter(ends, lambda e: valid(s, e)))

    def step(state: Column, s: Column) -> Column:
        found = lambda e: F.when(e.isNull(), state).otherwise(F.struct((e + 1).alias("free"), F.array_append(state["pieces"], F.struct(s.alias("first"), e.alias("last"))).alias("pieces")))
        return F.when(s < state["free"], state).otherwise(let(longest(s), found))

    none = F.array().cast("array<struct<first:int,last:int>>")
    run = (F.length(m) > 13) & (is_a(CARD_RUN, m) | is_a(IBAN_RUN, m))
    return F.when(run, F.aggregate(starts, F.struct(F.lit(1).alias("free"), none.alias("pieces")), step)["pieces"]).otherwise(none)


def parted(m: Column, pieces: Column) -> Column:
    """A run with its pieces cut off on both sides."""
    before = lambda i: F.when(i == 0, 1).otherwise(F.get(pieces, i - 1)["last"] + 1)
    out = F.transform(pieces, lambda p, i: F.concat(F.substring(m, before(i), p["first"] - before(i)), F.lit(CUT), F.substring(m, p["first"], p["last"] - p["first"] + 1), F.lit(CUT)))
    return F.concat(F.array_join(out, ""), F.substring(m, F.element_at(pieces, -1)["last"] + 1, F.length(m)))


def new_account(key: str, m: Column) -> Column:
    """Country, letters and spaces stay; the digits are permuted and the check digits made anew."""

    def checked(blank: Column) -> Column:
        return filled(m, F.concat(F.lpad((98 - mod97(F.replace(blank, F.lit(" "), F.lit("")))).cast("string"), 2, "0"), F.substring(digits_of(blank), F.lit(3), F.length(blank))))

    def permuted(digits: Column) -> Column:
        return let(F.when(F.length(digits) > 1, permuted_digits(key, "iban", digits)).otherwise(digits), lambda new: let(filled(m, F.concat(F.lit("00"), new)), checked))

    return let(F.substring(digits_of(m), F.lit(3), F.length(m)), permuted)


def new_address(key: str, m: Column) -> Column:
    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    write = lambda a, b: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(a / 256), a % 256, F.floor(b / 256), b % 256)])
    return feistel(key, "address", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), write)


def new_date(key: str, m: Column) -> Column:
    first = F.lit(FIRST_DAY).cast("date")

    def write(a: Column, b: Column) -> Column:
        day = F.date_add(first, (a * DAYS[1] + b).cast("int"))
        return F.when(F.contains(m, F.lit("/")), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))

    return let(F.datediff(day_of(m), first), lambda n: feistel(key, "date", F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), write))


def new_ssn(key: str, d: Column) -> Column:
    area = F.substring(d, 1, 3).cast("long")
    serial = (F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1

    def write(a: Column, b: Column) -> Column:
        parts = (a + F.when(a >= 665, 2).otherwise(1), 3), (F.floor(b / 9999) + 1, 2), (b % 9999 + 1, 4)
        return F.concat_ws("-", *[F.lpad(x.cast("long").cast("string"), w, "0") for x, w in parts])

    return feistel(key, "ssn", area - F.when(area > 666, 2).otherwise(1), serial, F.lit(AREAS), F.lit(SERIALS), write)


def new_card(key: str, m: Column, d: Column) -> Column:
    check = lambda payload: F.concat(payload, ((10 - luhn_sum(payload, True) % 10) % 10).cast("string"))
    payload = permuted_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
    return let(payload, lambda x: let(check(x), lambda digits: filled(m, digits)))


def new_phone(key: str, m: Column) -> Column:
    """A country prefix that stands apart stays."""
    prefix = F.regexp_extract(m, r"^(\+[0-9]{1,3})(?=[^0-9])", 1)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    return F.concat(prefix, let(digits_of(rest), lambda d: let(permuted_digits(key, "phone", d), lambda new: filled(rest, new))))


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    d = digits_of(m)
    email = F.concat(F.lit("u"), F.lpad(keyed(key, "email", F.lower(m)).cast("string"), 19, "0"), F.lit("@example.org"))
    made = {"email": email, "iban": new_account(key, m), "address": new_address(key, m), "date": new_date(key, m), "ssn": new_ssn(key, d), "card": new_card(key, m, d), "phone": new_phone(key, m)}
    out = F.when(kind.isNull(), m)
    for name, value in made.items():
        out = out.when(kind == name, value)
    return out


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, text with pseudonyms, n_replaced, and n_<kind> for each kind."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found, between = (lambda t: F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))), (lambda t: F.split(t, CANDIDATE, -1))
    rows = rows.withColumn("_found", found(F.col("_text"))).withColumn("_kinds", F.transform("_found", kind_of))
    rows = rows.withColumn("_pieces", F.zip_with("_found", "_kinds", lambda m, kind: F.when(kind.isNull(), pieces_of(m))))
    # Where a run has valid pieces, the text is cut around them and searched once more.
    cut_off = F.exists("_pieces", lambda p: F.size(p) > 0)
    marked = F.zip_with("_found", "_pieces", lambda m, p: F.when(F.coalesce(F.size(p), F.lit(0)) > 0, parted(m, p)).otherwise(m))
    whole = lambda parts, pieces: F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(parts, F.slice(pieces, F.lit(2), F.size(parts)), lambda x, y: F.concat(x, y)), ""))
    rows = rows.withColumn("_cut", F.when(cut_off, whole(marked, between(F.col("_text")))))
    rows = rows.withColumn("_found", F.when(F.col("_cut").isNotNull(), found(F.col("_cut"))).otherwise(F.col("_found")))
    rows = rows.withColumn("_kinds", F.when(F.col("_cut").isNotNull(), F.transform("_found", kind_of)).otherwise(F.col("_kinds")))
    rows = rows.withColumn("_between", F.when(F.size("_found") > 0, between(F.coalesce("_cut", "_text"))))
    new = F.zip_with("_found", "_kinds", lambda m, kind: pseudonym(key, kind, m))
    text = whole(new, F.col("_between"))
    text = F.when(F.col("_cut").isNotNull(), F.replace(text, F.lit(CUT), F.lit(""))).otherwise(text)
    count = lambda kind: F.coalesce(F.size(F.filter("_kinds", lambda k: k == kind)), F.lit(0)).cast("long")
    valid = F.coalesce(F.size(F.filter("_kinds", lambda k: k.isNotNull())), F.lit(0)).cast("long")
    return rows.select(
        F.col("_id").alias(id_col), F.when(valid > 0, text).otherwise(F.col("_text")).alias(text_col), valid.alias("n_replaced"),
        *[F.when(F.col("_text").isNull(), F.lit(0).cast("long")).otherwise(count(kind)).alias(f"n_{kind}") for kind in KINDS],
    )
