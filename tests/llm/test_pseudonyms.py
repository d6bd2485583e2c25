import datetime
import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from sparquill.llm import pseudonyms, queries

KEY = "k"


def feistel(values, moduli, tweak):
    """The network in plain Python."""
    v = list(values)
    half = len(v) // 2
    for r in range(pseudonyms.ROUNDS):
        left = r % 2 == 0
        other = v[half:] if left else v[:half]
        w = hashlib.sha256(f"{KEY}|{tweak}|{r}|{','.join(map(str, other))}".encode()).hexdigest()
        v = [(x + int(w[(i % 16) * 4 : (i % 16) * 4 + 4], 16)) % m if (i < half) == left else x for i, (x, m) in enumerate(zip(v, moduli, strict=True))]
    return v


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def change(spark, texts):
    d = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    return {r.doc_id: r for r in pseudonyms.pseudonymise(d, KEY).collect()}


def test_values_keep_their_formats_and_stay_linked(spark):
    texts = [
        "mail ana.55@mail3.example.com now", "again: ana.55@mail3.example.com.", "call +1 (017) 555-7713 or (017) 555-7713",
        "card 4929348385146306, 4929 3483 8514 6306.", "amex 3782 822463 10005 x", "ip 97.51.17.173.", "born 1984-02-29 or 29/02/1984 or 29.02.1984",
        "ssn 123-45-6789", "iban DE89 3704 0044 0532 0130 00, GB82WEST12345698765432", 'TOKEN = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    ]
    got = change(spark, texts)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    for i in (0, 1, 2, 3, 4, 6, 7, 8):
        assert got[i].text != texts[i] and shape(got[i].text) == shape(texts[i]), got[i].text
    mail = got[0].text.split()[1]
    assert mail in got[1].text and mail.endswith("@mail3.example.com")
    assert mail.split("@")[0] == "".join(chr(97 + v) if c.isalpha() else str(v) if c.isdigit() else c for c, v in zip("ana.55", feistel([0, 13, 0, 0, 5, 5], [26, 26, 26, 1, 10, 10], "email"), strict=True))
    a, b = re.findall(r"\(\d{3}\) \d{3}-\d{4}", got[2].text)
    assert a == b and got[2].text.startswith("call +1 ")
    want = feistel([0, 1, 7, 5 - 2, 5, 5, 7, 7, 1, 3], [2, 10, 10, 8, 10, 10, 10, 10, 10, 10], "phone")
    assert re.sub(r"\D", "", a) == "".join(str(v + 2 * (i == 3)) for i, v in enumerate(want))
    one, two = re.findall(r"4[\d ]{15,18}(?=[,.])", got[3].text)
    assert luhn(one) and one == two.replace(" ", "") and got[3].found == ["card", "card"]
    assert one[1:15] == "".join(map(str, feistel(map(int, "92934838514630"), [10] * 14, "card")))
    assert luhn(re.search(r"37[\d ]+", got[4].text)[0])
    ip = re.search(r"[\d.]+\d", got[5].text)[0]
    assert list(map(int, ip.split("."))) == feistel([97, 51, 17, 173], [256] * 4, "ip")
    iso, slash, dot = re.findall(r"[\d./-]{10}", got[6].text)
    day = (datetime.date(1984, 2, 29) - datetime.date(1900, 1, 1)).days
    x, y = feistel([day // 270, day % 270], [270, 270], "date0")
    assert iso == (datetime.date(1900, 1, 1) + datetime.timedelta(x * 270 + y)).isoformat()
    assert slash == dot.replace(".", "/") == "/".join(iso.split("-")[::-1])
    for iban in re.findall(r"[A-Z]{2}\d\d[A-Z0-9 ]{11,}\d", got[8].text):
        assert mod97(iban)
    assert re.fullmatch(r'TOKEN = "[0-9a-f]{40}"', got[9].text) and got[9].text != texts[9]


def test_what_is_not_valid_stays(spark):
    texts = [None, "", "9807915762804490 and 1234567812345678", "97.51.17.300 1.2.3", "31/02/2001 2001-13-01", "000-12-3456 666-12-3456", "DE89 3704 0044 0532 0130 01", "x4929348385146306y", "4929348385146306.5555", "plain words, 12 of 3.5 #5", "é" * 5000]
    got = change(spark, texts)
    for i, t in enumerate(texts):
        if i != 8:
            assert got[i].text == t and got[i].found == [], t


@pytest.mark.parametrize("moduli", [[10] * 3, [2, 3, 5], [270, 7], [11]])
def test_network_is_a_permutation(spark, moduli):
    d = spark.range(1).select(F.lit(1).alias("one"))
    for i, m in enumerate(moduli):
        d = d.withColumn(f"v{i}", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    vs = F.array(*(F.col(f"v{i}") for i in range(len(moduli))))
    got = d.select(pseudonyms.permute(vs, F.array(*map(F.lit, moduli)), KEY, F.lit("t")).alias("p")).collect()
    n = 1
    for m in moduli:
        n *= m
    assert len({tuple(r.p) for r in got}) == n and all(0 <= x < m for r in got for x, m in zip(r.p, moduli, strict=True))


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op3_pseudonyms(spark, sf).collect()
    assert len(got) == len(texts)
    private = re.compile(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|(?<!\d)4\d{15}(?!\d)")
    seen = 0
    for r in got:
        values = [v for v in private.findall(texts[r.doc_id]) if not re.fullmatch(r"\d{16}", v) or luhn(v)]
        if not values and r.n_values == 0:
            assert r.text == texts[r.doc_id]
        for v in values:
            seen += 1
            assert v not in r.text, v
    assert seen > 5


#: Notations of one value of each kind, and of another that must get another pseudonym.
NOTATIONS = {
    "phone": (["+1 555 223 4567", "+15552234567", "+1-555-223-4567", "+1 (555) 223-4567", "(555) 223-4567", "(555)2234567", "555-223-4567", "555.223.4567", "1-555-223-4567", "1.555.223.4567"], ["555-223-4568", "(556) 223-4567"]),
    "phone of another country": (["+49 89 1234 5678", "+498912345678", "+49-89-1234-5678", "+49 8912 345678"], ["+49 89 1234 5679", "+4989123456780"]),
    "iban": (["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], ["GB82 WEST 1234 5698 7654 32"]),
    "card": (["4929348385146306", "4929 3483 8514 6306", "4929-3483-8514-6306"], ["5425233430109903"]),
    "date": (["2024-12-25", "2024/12/25", "25/12/2024", "25.12.2024", "12/25/2024"], ["2024-12-26", "12/24/2024"]),
}


def test_one_value_has_one_pseudonym_in_every_notation(spark):
    texts = [(k, same, v) for k, both in NOTATIONS.items() for same, vs in zip((True, False), both, strict=True) for v in vs]
    got = change(spark, [f"so {v}, and again ({v})." for _, _, v in texts])
    bare = {}
    for i, (kind, same, v) in enumerate(texts):
        new = re.fullmatch(r"so (.*), and again \((.*)\)\.", got[i].text)
        assert len(got[i].found) == 2 and new[1] == new[2] != v, (v, got[i].text)
        assert re.sub(r"[0-9]", "9", re.sub("[A-Z]", "A", new[1])) == re.sub(r"[0-9]", "9", re.sub("[A-Z]", "A", v))
        if kind == "date":
            form = "%Y-%m-%d" if v[4] == "-" else "%Y/%m/%d" if v[4] == "/" else "%m/%d/%Y" if v in ("12/25/2024", "12/24/2024") else "%d.%m.%Y" if v[2] == "." else "%d/%m/%Y"
            value = datetime.datetime.strptime(new[1], form)
        else:
            value = re.sub("[^0-9A-Z]", "", new[1])[-10 if kind == "phone" else None :]
        if kind == "phone":
            assert value[0] in "23456789" and value[3] in "23456789"
        bare.setdefault((kind, same), set()).add(value)
    for kind, (one, others) in NOTATIONS.items():
        assert len(bare[kind, True]) == 1 and len(bare[kind, False]) == len(others) and not bare[kind, True] & bare[kind, False], kind


def test_recall_and_precision_by_kind(spark):
    """Random values of each kind are all found; near misses of each are left."""
    pick = random.Random(5)
    digits = lambda n: "".join(pick.choices("0123456789", k=n))
    text = lambda n: "".join(pick.choices(string.ascii_letters + string.digits, k=n - 2)) + "a1"

    def card(prefix, n):
        body = prefix + digits(n - 1 - len(prefix))
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def iban(country, n):
        body = digits(n)
        return country + f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}" + body

    day = lambda: datetime.date(1950, 1, 1) + datetime.timedelta(pick.randrange(30_000))
    right = {
        "email": lambda: f"{text(6)}.{digits(2)}@{text(5)}.example.org",
        "phone": lambda: pick.choice(["+1 ({0}) {1}-{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "+1{0}{1}{2}"]).format(pick.randrange(200, 1000), digits(3), digits(4)),
        "ip": lambda: ".".join(str(pick.randrange(256)) for _ in range(4)),
        "date": lambda: day().strftime(pick.choice(["%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%Y/%m/%d", "%m/%d/%Y"])),
        "ssn": lambda: f"{pick.choice([pick.randrange(1, 666), pick.randrange(667, 900)]):03d}-{pick.randrange(1, 100):02d}-{pick.randrange(1, 10_000):04d}",
        "card": lambda: card(*pick.choice([("4", 16), ("51", 16), ("37", 15), ("6011", 16), ("30", 14)])),
        "iban": lambda: iban(*pick.choice([("DE", 18), ("NL", 14), ("FR", 23)])),
        "secret": lambda: pick.choice([lambda: "a1" + "".join(pick.choices("0123456789abcdef", k=38)), lambda: "AKIA" + "Z9" + "".join(pick.choices(string.ascii_uppercase + string.digits, k=14)), lambda: "sk-" + text(40), lambda: "ghp_" + text(36), lambda: "AIza" + text(35), lambda: "xoxb-" + text(20)])(),
    }
    wrong = {
        "phone": ["155-223-4567", "555-2234567", "5552234567", "555-223.4567"], "ip": ["256.1.1.1", "1.2.3"], "date": ["2024-13-01", "31/02/2001", "13/13/2001", "02/30.2001"], "ssn": ["666-12-3456", "900-12-3456"],
        "card": ["4929348385146307"], "iban": ["DE89370400440532013001"], "secret": ["a" * 40, "sk-short", "g" * 40, "AKIA123"], "email": ["a@b", "@x.org"],
    }
    rows = [(k, v) for k, make in right.items() for v in (make() for _ in range(60))]
    got = change(spark, [f"See {v}; then." for _, v in rows])
    hit = dict.fromkeys(right, 0)
    for i, (k, v) in enumerate(rows):
        hit[k] += got[i].found == [k] and v not in got[i].text and (k == "ip" or len(got[i].text) == len(f"See {v}; then."))
    assert hit == dict.fromkeys(right, 60)
    near = [v for vs in wrong.values() for v in vs]
    got = change(spark, [f"See {v}; then." for v in near])
    assert [got[i].found for i in range(len(near))] == [[]] * len(near)


def test_column_names_and_no_rows(spark):
    d = spark.createDataFrame([(1, "call 555-223-4567", "own", "mine", "x")], "doc_id int, text string, hits string, _kinds string, Found string")
    r = pseudonyms.pseudonymise(d.withColumnRenamed("_kinds", "kinds"), KEY).first()
    assert (r.hits, r.kinds, r.found) == ("own", "mine", ["phone"]) and r.text != "call 555-223-4567"
    assert pseudonyms.pseudonymise(d.limit(0), KEY).collect() == []


def changed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, list(r.found)) for r in pseudonyms.pseudonymise(docs, "k").orderBy("doc_id").collect()]


def test_long_values_keep_no_differences(spark):
    """Places far apart get hash words of their own."""
    pick = random.Random(4)
    secrets = ["".join(pick.choice("0123456789abcdef") for _ in range(64)) for _ in range(6)]
    kept = 0
    for old, (new, found) in zip(secrets, changed(spark, secrets), strict=True):
        assert found == ["secret"] and len(new) == 64 and new != old
        a, b = [int(c, 16) for c in old], [int(c, 16) for c in new]
        kept += sum((a[i] - a[i + 16]) % 16 == (b[i] - b[i + 16]) % 16 for i in (*range(16), *range(32, 48)))
    assert kept < 6 * 32 / 4
    (new, _), (again, _) = changed(spark, ["a" * 40 + "b" * 30 + "@mail.example", "a" * 40 + "b" * 30 + "@mail.example"])
    assert new == again and len(set(new[:70])) > 10


def test_what_follows_a_phone_is_no_part_of_it(spark):
    got = changed(spark, ["call +44 20 7946 0958 12 items", "+44 20 7946 0958", "+442079460958 2024 0101", "+33 6 12 34 56 78 90 times", "+1 555 223 4567 8 left", "+353 1 234 5678", "+44 20 7946 09581"])
    number = got[1][0]
    assert number != "+44 20 7946 0958" and got[0][0] == f"call {number} 12 items" and got[2][0] == number.replace(" ", "") + " 2024 0101"
    assert got[3][0].endswith(" 90 times") and got[3][1] == ["phone"] and got[4][0].endswith(" 8 left")
    assert got[5][1] == ["phone"] and got[6] == ("+44 20 7946 09581", [])


def test_timestamps_hyphens_and_addresses(spark):
    got = changed(spark, ["at 2024-12-25T10:00:00Z", "2024-12-25", "25-12-2024", "25.12.2024", "2001:db8:0:0:0:0:0:1", "2001:DB8::1", "2001:db8::1", "std::vector, a::b, 10:00:00", "1:2:3:4:5:6:7::8:9", "gb82west12345698765432", "GB82 WEST 1234 5698 7654 32"])
    day = got[1][0]
    assert day != "2024-12-25" and got[0] == (f"at {day}T10:00:00Z", ["date"])
    assert got[2][0] == "-".join(reversed(day.split("-"))) and got[3][0] == ".".join(reversed(day.split("-")))
    assert got[4][1] == ["ipv6"] and got[4][0] == got[6][0] and got[5][0] == got[4][0].upper() and got[4][0] != "2001:db8:0:0:0:0:0:1"
    assert got[7] == ("std::vector, a::b, 10:00:00", []) and got[8] == ("1:2:3:4:5:6:7::8:9", [])
    assert got[9][1] == ["iban"] and got[9][0].upper() == got[10][0].replace(" ", "") != "GB82WEST12345698765432"
