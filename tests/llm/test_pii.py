import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from terrace.llm import pii

KEY = "key"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(account):
    account = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r) for r in pii.pseudonymised(df, KEY).orderBy("doc_id").collect()]


CASES = [
    ("card", "4111111111111111", lambda x: luhn(x) and re.fullmatch(r"\d{16}", x)),
    ("card", "4111-1111 1111-1111", lambda x: luhn(re.sub(r"\D", "", x)) and re.fullmatch(r"\d{4}-\d{4} \d{4}-\d{4}", x)),
    ("iban", "GB82 WEST 1234 5698 7654 32", lambda x: mod97(x) == 1 and re.fullmatch(r"GB\d\d WEST \d{4} \d{4} \d{4} \d\d", x)),
    ("iban", "DE89370400440532013000", lambda x: mod97(x) == 1 and re.fullmatch(r"DE\d{20}", x)),
    ("address", "187.50.237.7", lambda x: all(0 <= int(o) < 256 for o in x.split(".")) and x.count(".") == 3),
    ("date", "2024-02-29", lambda x: datetime.date.fromisoformat(x)),
    ("date", "31/12/1999", lambda x: datetime.datetime.strptime(x, "%d/%m/%Y")),
    ("ssn", "123-45-6789", lambda x: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x)),
    ("phone", "+1 (643) 555-5742", lambda x: re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x)),
    ("phone", "643-555-5742", lambda x: re.fullmatch(r"\d{3}-\d{3}-\d{4}", x)),
    ("email", "a.b+c@mail4.example.com", lambda x: re.fullmatch(r"u\d{19}@example\.org", x)),
]


def test_each_kind_keeps_its_format_and_links_equal_values(spark):
    got = run(spark, [f"see {value}, or {value}." for _, value, _ in CASES])
    for (kind, value, valid), (text, row) in zip(CASES, got, strict=True):
        first, second = re.fullmatch(r"see (.*), or (.*)\.", text).groups()
        assert first == second != value and valid(first), (kind, value, text)
        assert row.n_replaced == row[f"n_{kind}"] == 2


STAY = ["4111111111111112", "2023-02-29", "31/04/1999", "256.1.1.1", "1.2.3.4.5", "000-12-3456", "666-12-3456", "GB82 WEST 1234 5698 7654 33", "x@y", "", "1234567", "prices 1,000 and 2.50", "+1 23", "12 34"]


def test_what_is_not_valid_stays(spark):
    texts = [f"a {x} b" for x in STAY]
    assert [text for text, _ in run(spark, texts)] == texts


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "at 9.9.9.9", "y"), (1, "", "z"), (1, "", "z")], "doc_id long, text string, n_card string")
    got = sorted(map(tuple, pii.pseudonymised(df, KEY).collect()), key=str)
    assert [r[1] for r in got if r[0] == 1] == ["", "", None] and all(sum(r[2:]) == 0 for r in got if r[0] == 1)
    assert pii.pseudonymised(df.filter("doc_id > 3"), KEY).collect() == []


def test_permutations_are_one_to_one(spark):
    """Over the whole range of four digits, and all days of the 400 years."""
    digits = spark.range(10_000).select(pii.permuted_digits(KEY, "card", F.lpad(F.col("id").cast("string"), 4, "0")).alias("x"))
    assert digits.distinct().count() == 10_000 and digits.filter("length(x) <> 4").count() == 0
    n = F.col("id").cast("int")
    day = pii.feistel(KEY, "date", F.floor(n / pii.DAYS[1]), n % pii.DAYS[1], F.lit(pii.DAYS[0]), F.lit(pii.DAYS[1]), lambda a, b: a * pii.DAYS[1] + b)
    days = spark.range(pii.DAYS[0] * pii.DAYS[1]).select(day.alias("x"))
    assert days.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()[:] == (146_097, 0, 146_096)


def test_many_values_in_long_texts(spark):
    """Text between values stays as it is; values at either end and side by side are found."""
    rng = random.Random(3)
    parts = [rng.choice(["word é ", "\n", "a" * 5000 + " ", "10.0.0.1", " 2001-09-11 ", "+1 (098) 555-0174", " ; "]) for _ in range(400)]
    text = "10.0.0.1 " + "".join(parts) + " 2001-09-11"
    found = re.findall(r"(?<![0-9.])10\.0\.0\.1(?!\.?[0-9])", text)
    new, row = run(spark, [text])[0]
    assert row.n_address == len(found) and "2001-09-11" not in new
    assert len(new.replace("\n", "").split("word")) == len(text.replace("\n", "").split("word"))


def test_values_before_more_digits_or_capitals(spark):
    cards = ["card 4111 1111 1111 1111 12/27", "4111111111111111 123 Main", "4111-1111-1111-1111-31 no", "4111111111111111 31/12/1999 x"]
    accounts = ["DE89370400440532013000 EUR 50", "GB82 WEST 1234 5698 7654 32 BIC COBADEFF"]
    got = run(spark, cards + accounts)
    for (text, row), old in zip(got[:4], cards, strict=True):
        assert "4111" not in text and row.n_card == 1, old
    for text, end in zip([t for t, _ in got], [" 12/27", " 123 Main", "-31 no", " x", " EUR 50", " BIC COBADEFF"], strict=True):
        assert text.endswith(end) and pii.CUT not in text
    assert got[3][1].n_date == 1 and "1999" not in got[3][0]
    assert all(row.n_iban == 1 for _, row in got[4:])
    assert run(spark, ["year 1600-01-01 or 2150-01-01"])[0][0] == "year 1600-01-01 or 2150-01-01"


class Plain:
    """The same pseudonyms in plain Python."""

    def keyed(self, *parts):
        return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:15], 16)

    def pair(self, kind, a, b, m, n):
        for i in range(pii.ROUNDS):
            if i % 2:
                b = (b + self.keyed(kind, i, a)) % n
            else:
                a = (a + self.keyed(kind, i, b)) % m
        return a, b

    def digits(self, kind, x):
        n, h = len(x), len(x) // 2
        a, b = self.pair(f"{kind}{n}", int(x[:h]), int(x[h:]), 10**h, 10 ** (n - h))
        return f"{a:0{h}d}{b:0{n - h}d}"

    def fill(self, shape, digits):
        rest = iter(digits)
        return "".join(next(rest) if c.isdigit() else c for c in shape)

    def card(self, x):
        body = self.digits("card", re.sub(r"\D", "", x)[:-1])
        return self.fill(x, body + next(c for c in "0123456789" if luhn(body + c)))

    def iban(self, x):
        blank = self.fill(x, "00" + self.digits("iban", re.sub(r"\D", "", x)[2:]))
        return self.fill(blank, f"{98 - mod97(blank):02d}" + re.sub(r"\D", "", blank)[2:])

    def address(self, x):
        o = [int(v) for v in x.split(".")]
        a, b = self.pair("address", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def date(self, x):
        first = datetime.date(1700, 1, 1)
        day = datetime.date.fromisoformat(x) if "-" in x else datetime.datetime.strptime(x, "%d/%m/%Y").date()
        a, b = self.pair("date", *divmod((day - first).days, 773), 189, 773)
        new = first + datetime.timedelta(days=a * 773 + b)
        return new.isoformat() if "-" in x else new.strftime("%d/%m/%Y")

    def ssn(self, x):
        area, group, serial = map(int, x.split("-"))
        a, b = self.pair("ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"

    def phone(self, x):
        prefix = re.match(r"\+[0-9]{1,3}(?=[^0-9])|", x)[0]
        return prefix + self.fill(x[len(prefix) :], self.digits("phone", re.sub(r"\D", "", x[len(prefix) :])))

    def email(self, x):
        return f"u{self.keyed('email', x.lower()):019d}@example.org"


def test_against_a_plain_feistel(spark):
    rng, plain = random.Random(8), Plain()
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    values = [(kind, value) for kind, value, _ in CASES]
    for _ in range(40):
        body = number(rng.randrange(12, 19))
        values.append(("card", body + next(c for c in "0123456789" if luhn(body + c))))
        account = "FR00" + number(10) + "".join(rng.choices("ABC123", k=11)) + number(2)
        values.append(("iban", account[:2] + f"{98 - mod97(account):02d}" + account[4:]))
        values.append(("address", ".".join(str(rng.randrange(256)) for _ in range(4))))
        values.append(("date", (datetime.date(1700, 1, 1) + datetime.timedelta(days=rng.randrange(146_097))).isoformat()))
        values.append(("ssn", f"{rng.choice([1, 665, 667, 899]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}"))
        values.append(("phone", f"({number(3)}) {number(3)}-{number(4)}"))
    got = run(spark, [f"is {v}" for _, v in values])
    for (kind, value), (text, row) in zip(values, got, strict=True):
        assert (text, row[f"n_{kind}"]) == (f"is {getattr(plain, kind)(value)}", 1), (kind, value)


def plain_pieces(run):
    """Valid account numbers and printed cards between any two separators, from the left and the longest first."""
    shapes = r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}"

    def valid(x):
        digits = re.sub(r"\D", "", x)
        card = re.fullmatch(shapes, x) and re.match(r"[3-6]|2(?:2[2-9]|[3-6]|7[01]|720)", x) and 13 <= len(digits) <= 19 and luhn(digits)
        return card or (re.fullmatch(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30}", x) and mod97(x) == 1)

    starts = [i for i in range(len(run)) if run[i] not in " -" and (i == 0 or run[i - 1] in " -")]
    out, free = [], 0
    for s in starts:
        ends = [e for e in range(s + 10, len(run) + 1) if run[e - 1] not in " -" and (e == len(run) or run[e] in " -") and valid(run[s:e])]
        if s >= free and ends:
            out.append(run[s : max(ends)])
            free = max(ends)
    return out


def test_values_behind_numbers_and_codes(spark):
    texts = ["in 2024 4111 1111 1111 1111 paid", "room 7 4111 1111 1111 1111 end", "acct AB12 DE89370400440532013000 EUR 50", "AB12 4111 1111 1111 1111 7 5500-0000-0000-0004 9"]
    got = run(spark, texts)
    assert [row.n_replaced for _, row in got] == [1, 1, 1, 2]
    assert [(t[:5], t[-2:]) for t, _ in got] == [(x[:5], x[-2:]) for x in texts]
    assert not any(v in t for t, _ in got for v in ("4111 1111", "DE8937", "5500-0000"))


def test_other_kinds_in_a_run(spark):
    texts = ["room 12345 643-555-5742 x", "12345 2024-01-05 x", "1234567 123-45-6789 x", "000 000 5500-0000-0000-0004 x"]
    got = run(spark, texts)
    assert [(r.n_phone, r.n_date, r.n_ssn, r.n_card) for _, r in got] == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)]


def test_runs_against_all_starts_and_ends(spark):
    rng = random.Random(8)
    makes = ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "3782 822463 10005", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "7", "12", "2024", "AB12", "0000", "EUR", "4111 1111 1111 1112", "99 99"]
    runs = [" ".join(rng.choice(makes) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    df = spark.createDataFrame([(r,) for r in runs], "r string")
    got = df.select("r", pii.is_a(pii.CARD_RUN, F.col("r")).alias("card"), pii.is_a(pii.IBAN_RUN, F.col("r")).alias("iban"), pii.pieces_of(F.col("r")).alias("p")).collect()
    assert sum(r.card or r.iban for r in got) > 40
    for r in got:
        # Phones, dates and numbers of other kinds are tested by themselves; none can stand in these runs.
        assert [r.r[p.first - 1 : p["last"]] for p in r.p] == (plain_pieces(r.r) if r.card or r.iban else []), r.r


def test_long_runs_of_numbers_stay_whole(spark):
    text = " ".join(str(1000 + k % 2000) for k in range(3000)) + " 4111 1111 1111 1111"
    new, row = run(spark, [text])[0]
    assert row.n_card >= 1 and len(new) == len(text) and new.startswith("1000 1001") and "4111 1111 1111 1111" not in new
