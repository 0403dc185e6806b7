import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from seriesmill.llm import pseudonyms as p


def run(spark, texts, **settings):
    rows = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, tokens string")
    return [(r.text, r.n_found, r.n_replaced) for r in p.pseudonymise(rows, **settings).orderBy("doc_id").collect()]


def prf(kind, turn, half, key=p.KEY):
    return int(hashlib.sha256(f"{key}|{kind}|{turn}|{half}".encode()).hexdigest()[:15], 16)


def feistel(x, a, b, kind):
    left, right = divmod(x, b)
    for i in range(p.ROUNDS):
        if i % 2 == 0:
            left = (left + prf(kind, i, right)) % a
        else:
            right = (right + prf(kind, i, left)) % b
    return left * b + right


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_addresses_and_phones_against_plain_python(spark):
    random.seed(1)
    ips = [".".join(str(random.randrange(256)) for _ in range(4)) for _ in range(40)]
    phones = [(random.randrange(200, 1000), random.randrange(200, 1000), random.randrange(10_000)) for _ in range(40)]
    got = run(spark, [f"x {a}, +1 ({b[0]}) {b[1]}-{b[2]:04} y" for a, b in zip(ips, phones)])
    for (text, found, replaced), a, (area, exchange, number) in zip(got, ips, phones, strict=True):
        y = feistel(int.from_bytes(bytes(map(int, a.split("."))), "big"), 65536, 65536, "ipv4")
        z = feistel(((area - 200) * 800 + exchange - 200) * 10_000 + number, 80_000, 80_000, "nanp")
        assert text == f"x {'.'.join(map(str, y.to_bytes(4, 'big')))}, +1 ({z // 8_000_000 + 200}) {z // 10_000 % 800 + 200}-{z % 10_000:04} y"
        assert (found, replaced) == (2, 2)


def test_cards_stay_valid_and_linked(spark):
    cards = ["4565410125667261", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005"]
    texts = [t for t, _, _ in run(spark, [f"card {c}." for c in cards])]
    for c, t in zip(cards, texts):
        m = re.fullmatch(r"card ([0-9 -]+)\.", t)
        digits = re.sub("[^0-9]", "", m.group(1))
        assert re.sub("[0-9]", "9", m.group(1)) == re.sub("[0-9]", "9", c) and luhn(digits) and digits[0] == c[0] and digits != re.sub("[^0-9]", "", c)
    assert texts[1].replace(" ", "") == texts[2].replace("-", "").replace(" ", "")
    assert run(spark, ["4111111111111112 and 0000000000000000"]) == [("4111111111111112 and 0000000000000000", 2, 0)]


MONTHS = "January February March April May June July August September October November December".split()


def moved(day, key=p.KEY):
    """A date's pseudonym, in plain Python."""
    first = datetime.date(day.year // 100 * 100, 1, 1)
    a, b = (75, 487) if day.year >= 2000 else (92, 397)
    return first + datetime.timedelta(feistel((day - first).days, a, b, f"date{day.year // 100}"))


def walked(day):
    day = moved(day)
    while day.day <= 12:
        day = moved(day)
    return day


def test_every_date_layout_against_plain_python(spark):
    random.seed(6)
    days = [datetime.date(1999, 12, 31), datetime.date(2024, 2, 29), datetime.date(1850, 1, 1)] + [datetime.date(2000, 1, 1) + datetime.timedelta(random.randrange(36_525)) for _ in range(12)]
    like = None  # the date that was written; parts of two digits keep two

    def part(value, was):
        return f"{value:02}" if was >= 10 else str(value)

    layouts = {
        "iso": lambda d: d.isoformat(),
        "ymd": lambda d: f"{d.year}/{d.month:02}/{d.day:02}",
        "dots": lambda d: f"{d.year}.{part(d.month, like.month)}.{part(d.day, like.day)}",
        "dmy": lambda d: f"{part(d.day, like.day)}/{part(d.month, like.month)}/{d.year}",
        "padded": lambda d: f"{d.day:02}.{d.month:02}.{d.year}",
        "hyphens": lambda d: f"{d.day:02}-{d.month:02}-{d.year}",
        "full": lambda d: f"{d.day:02} {MONTHS[d.month - 1]} {d.year}",
        "short": lambda d: f"{part(d.day, like.day)} {MONTHS[d.month - 1][:3]} {d.year}",
        "comma": lambda d: f"{MONTHS[d.month - 1]} {part(d.day, like.day)}, {d.year}",
        "upper": lambda d: f"{MONTHS[d.month - 1].upper()} {part(d.day, like.day)} {d.year}",
        "lower": lambda d: f"{part(d.day, like.day)} {MONTHS[d.month - 1].lower()} {d.year}",
        "compact": lambda d: f"{d:%Y%m%d}",
        "two": lambda d: f"{d.day:02}/{d.month:02}/{d.year % 100:02}",
        "mdy": lambda d: f"{d.month:02}/{d.day:02}/{d.year}",
        "mdyy": lambda d: f"{part(d.month, like.month)}/{d.day}/{d.year % 100:02}",
    }
    cases = [(name, d) for d in days for name in layouts]
    # May has no shorter form, years before 1900 no compact one, and two digits stand for years from 2000
    cases = [(name, d) for name, d in cases if not (name == "short" and d.month == 5) and not (name == "compact" and d.year < 1900) and not (name in ("two", "mdyy") and d.year < 2000)]
    cases = [(name, d) for name, d in cases if name not in ("mdy", "mdyy") or d.day > 12]
    texts = []
    for name, like in cases:
        texts.append(f"on {layouts[name](like)}, x")
    got = run(spark, texts)
    for (name, d), (text, _, replaced) in zip(cases, got, strict=True):
        like = d
        want = walked(d) if name in ("mdy", "mdyy") else moved(d)
        assert (text, replaced) == (f"on {layouts[name](want)}, x", 1), (name, d)
    bad = "1987-13-45 1700-01-01 31/02/2000 99.99.2000 20211301 31 February 2020 Mayor 4, 2021 2021/13/01 18000101"
    assert run(spark, [bad])[0][0] == bad


def test_slashed_dates_are_one_to_one(spark):
    """All d/m/y strings of a century and all that read only as m/d/y: as many pseudonyms."""
    rows = spark.sql(
        "SELECT explode(sequence(date'2000-01-01', date'2099-12-31')) AS x"
    ).selectExpr("explode(if(day(x) > 12, array(date_format(x, 'dd/MM/yyyy'), date_format(x, 'MM/dd/yyyy')), array(date_format(x, 'dd/MM/yyyy')))) AS text")
    rows = rows.repartition(8).selectExpr("monotonically_increasing_id() AS doc_id", "text")
    got = p.pseudonymise(rows)
    assert (rows.count(), got.select("text").distinct().count(), got.where("n_replaced = 1").count()) == (58_650, 58_650, 58_650 - got.where("n_replaced = 0").count())
    assert got.select("text").exceptAll(rows.select("text")).count() == 0


def test_numbers_without_punctuation(spark):
    random.seed(7)
    phones = [(random.randrange(200, 1000), random.randrange(200, 1000), random.randrange(10_000)) for _ in range(20)]
    ssns = [(random.choice([k for k in range(1, 900) if k != 666]), random.randrange(1, 100), random.randrange(1, 10_000)) for _ in range(20)]
    got = run(spark, [f"t {a}{b}{c:04} s {d:03}{e:02}{f:04} {d:03}-{e:02}-{f:04}." for (a, b, c), (d, e, f) in zip(phones, ssns)])
    for (text, _, replaced), (a, b, c), (d, e, f) in zip(got, phones, ssns, strict=True):
        z = feistel(((a - 200) * 800 + b - 200) * 10_000 + c, 80_000, 80_000, "nanp")
        y = feistel(((d - (2 if d > 666 else 1)) * 99 + e - 1) * 9999 + f - 1, 88_902, 9999, "ssn")
        area = y // (99 * 9999)
        area, group, serial = area + (2 if area >= 665 else 1), y // 9999 % 99 + 1, y % 9999 + 1
        assert text == f"t {z // 8_000_000 + 200}{z // 10_000 % 800 + 200}{z % 10_000:04} s {area:03}{group:02}{serial:04} {area:03}-{group:02}-{serial:04}."
        assert replaced == 3
    same = "000123456 1234567890 0.123456789 123456789.5 1.5551234567 x123456789"
    assert run(spark, [same])[0][0] == same


def test_cards_and_international_numbers_against_plain_python(spark):
    random.seed(8)
    for length in (13, 15, 16, 19):
        cards = []
        for _ in range(5):
            body = "".join(random.choice("0123456789") for _ in range(length - 1))
            cards.append(next(body + c for c in "0123456789" if luhn(body + c)))
        got = run(spark, [f"c {c}" for c in cards])
        for (text, _, _), c in zip(got, cards, strict=True):
            a = 10 ** ((length - 2) // 2)
            new = c[0] + str(feistel(int(c[1:-1]), a, 10 ** (length - 2) // a, f"card{length}")).zfill(length - 2)
            assert text == "c " + next(new + k for k in "0123456789" if luhn(new + k))
    got = run(spark, ["+44 20 7946 0958", "+4915112345678"])
    for (text, _, _), number in zip(got, ["442079460958", "4915112345678"], strict=True):
        new = number[:-7] + f"{feistel(int(number[-7:]), 1000, 10_000, f'intl{len(number)}{number[:-7]}'):07}"
        assert re.sub("[^0-9]", "", text) == new


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def test_ibans(spark):
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NL91ABNA0417164300"]
    spaced = [" ".join(i[k : k + 4] for k in range(0, len(i), 4)) for i in ibans]
    got, apart = ([t for t, _, _ in run(spark, [f"to {i}." for i in x])] for x in (ibans, spaced))
    for i, t, s in zip(ibans, got, apart, strict=True):
        new = t[3:-1]
        assert s[3:-1].replace(" ", "") == new != i and len(new) == len(i) and new[:2] == i[:2] and mod97(new[4:] + new[:4]) == 1
        assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", i)
        digits = re.sub("[^0-9]", "", i[4:])
        n = min(len(digits), 16)
        a = 10 ** (n // 2)
        kind = f"iban{i[:2]}{len(digits)}{digits[: len(digits) - n]}"
        assert re.sub("[^0-9]", "", new[4:]) == digits[: len(digits) - n] + str(feistel(int(digits[len(digits) - n :]), a, 10**n // a, kind)).zfill(n)
    bad = "DE88370400440532013000 GB82WEST"
    assert run(spark, [bad])[0][0] == bad


def plain_mail(local):
    left, right = local[: len(local) // 2], local[len(local) // 2 :]

    def shifted(half, other, turn):
        stream = hashlib.sha256(f"{p.KEY}|mail|{len(local)}|{turn}|{other}".encode()).hexdigest()
        out = ""
        for j, c in enumerate(half):
            by = int(stream[2 * (j % 32) : 2 * (j % 32) + 2], 16)
            if "a" <= c <= "z":
                c = chr(97 + (ord(c) - 97 + by) % 26)
            elif "A" <= c <= "Z":
                c = chr(65 + (ord(c) - 65 + by) % 26)
            elif "0" <= c <= "9":
                c = chr(48 + (ord(c) - 48 + by) % 10)
            out += c
        return out

    for turn in range(p.ROUNDS):
        if turn % 2:
            left = shifted(left, right, turn)
        else:
            right = shifted(right, left, turn)
    return left + right


def test_mail_against_plain_python(spark):
    names = ["a", "jane.doe", "Ab9_x-Y", "info+tag", "averyveryverylongnamewithdigits0123456789andmoreandmoreandmoreletters"]
    got = run(spark, [f"<{n}@mail.example.com>" for n in names])
    assert [t for t, _, _ in got] == [f"<{plain_mail(n)}@mail.example.com>" for n in names]


def test_permutations(spark):
    numbers = spark.range(36_525).select(F.expr(p._feistel("id", "75", "487", "'t'", "k")).alias("y"))
    assert (numbers.distinct().count(), numbers.agg(F.min("y"), F.max("y")).first()[0]) == (36_525, 0)
    day = spark.sql("SELECT explode(sequence(date'1900-01-01', date'1999-12-31')) AS x").select(F.expr(p._moved_date("x", "k")).alias("y"))
    assert day.distinct().count() == 36_524


def test_mail_and_others(spark):
    got = run(spark, ["Mail Jane.Doe99@example.com; Jane.Doe99@other.org", "ssn 123-45-6789, 000-12-3456", "+44 20 7946 0958", "300.1.1.1 1.2.3.4.5"])
    first, second = re.findall(r"(\S+)@", got[0][0])
    assert first == second != "Jane.Doe99" and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}[0-9]{2}", first)
    assert re.fullmatch(r"ssn [0-9]{3}-[0-9]{2}-[0-9]{4}, 000-12-3456", got[1][0]) and "123-45-6789" not in got[1][0]
    assert re.fullmatch(r"\+44 20 7[0-9]{3} [0-9]{4}|\+44 20 [0-9]{4} [0-9]{4}", got[2][0]) and got[3][0] == "300.1.1.1 1.2.3.4.5"
    assert run(spark, ["a@b.co 10.0.0.1"], key="one") != run(spark, ["a@b.co 10.0.0.1"], key="two")


def test_odd_texts(spark, odd):
    assert run(spark, odd) == [(t, 0, 0) for t in odd]
    long = "x1 " * 20_000 + "a" * 50_000 + " 1" * 1000
    assert run(spark, [long])[0][0] == long
    assert p.pseudonymise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = p.pseudonymise(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
