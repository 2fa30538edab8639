import hashlib
import itertools
import re

from pyspark.sql import functions as F

from procura.llm import pii


def noise(key, tweak, i, text):
    return int(hashlib.sha256(f"{key}|{tweak}|{i}|{text}".encode()).hexdigest()[:15], 16)


def feistel(left, right, sizes, key, tweak):
    for i in range(pii.ROUNDS):
        left, right = right, (left + noise(key, tweak, i, right) % sizes[i % 2]) % sizes[i % 2]
    return left, right


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def rewrite(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    return {r.doc_id: (r.text, r.pii) for r in pii.pseudonymise(df, key).collect()}


def test_digit_permutation_is_the_one_defined_and_one_to_one(spark):
    values = [f"{n:03d}" for n in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.permute_digits(F.col("v"), "k", "t").alias("p"))
    got = {r.v: r.p for r in df.collect()}
    assert sorted(got.values()) == values
    for v in ("000", "123", "999"):
        a, b = feistel(int(v[0]), int(v[1:]), (10, 100), "k", "t")
        assert got[v] == f"{a}{b:02d}"


def test_class_permutation_is_one_to_one(spark):
    values = ["".join(p) for p in itertools.product("ab9", "xyZ", "12", "-q")]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.permute_classes(F.col("v"), "k", "t").alias("p"))
    got = {r.v: r.p for r in df.collect()}
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    assert len(set(got.values())) == len(values) and all(shape(k) == shape(v) for k, v in got.items())


def test_formats_validity_and_linkage(spark):
    texts = [
        "a bob.smith+1@mail7.example.com b 4845168114407329, +1 (017) 555-7713. ip 97.51.17.173 x",
        "+1 (017) 555-7713 1999-12-31 31.12.1999 12/31/1999 123-45-6789 DE89 3704 0044 0532 0130 00 4845 1681 1440 7329",
    ]
    found = rewrite(spark, texts)
    one, two = found[0][0], found[1][0]
    assert found[0][1] == ["email", "card", "phone", "ipv4"] and found[1][1] == ["phone", "date", "date", "date", "ssn", "iban", "card"]
    card = re.search(r"\d{16}", one)[0]
    assert card != "4845168114407329" and luhn(card) and re.sub(" ", "", two[-19:]) == card
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0] == re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", two)[0]
    assert all(int(x) < 256 for x in re.search(r"ip (\S+) x", one)[1].split("."))
    iso, dotted, slashed = re.search(r"(\d{4}-\d\d-\d\d) (\d\d\.\d\d\.\d{4}) (\d\d/\d\d/\d{4})", two).groups()
    assert dotted == ".".join(reversed(iso.split("-"))) and slashed == f"{iso[5:7]}/{iso[8:]}/{iso[:4]}"
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", two)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "@mail7.example.com" in one and not any(t in one for t in ("bob", "97.51.17.173", "555-7713"))


def test_dates_and_addresses_are_permuted_one_to_one(spark):
    dates = [f"{y}-{m:02d}-{d:02d}" for y in (1900, 1999, 2099) for m in range(1, 13) for d in (1, 15, 28)]
    ips = [f"{a}.0.{b}.255" for a in range(0, 256, 51) for b in range(0, 256, 17)]
    found = rewrite(spark, dates + ips)
    assert len({t for t, _ in found.values()}) == len(dates) + len(ips)
    assert all(kinds in (["date"], ["ipv4"]) for _, kinds in found.values())


def test_invalid_values_nulls_empty_and_long_texts_stay(spark):
    plain = ["98079157628 4845168114407328 v3.0 12", "000-12-3456 666-11-2222 2023-02-30 256.1.1.1 DE88 3704 0044 0532 0130 00", "", None, "Apache License, Version 2.0.", "word " * 50_000]
    found = rewrite(spark, plain)
    assert [found[i] for i in range(len(plain))] == [(t, []) for t in plain]
    assert rewrite(spark, ["x " * 40_000 + "a@b.org"])[0][1] == ["email"]
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []


def test_values_hidden_by_their_surroundings(spark):
    texts = [
        "4845168114407329 12/26", "4845 1681 1440 7329 100 euros", "ES91 2100 0418 4502 0005 1332 12 May", "ref 4845168114407329-1",
        "x.123-45-6789", "555 123 4567", "1/2/1990", "3782 822463 10005 4111 1111 1111 1111", "1234 4845 1681 1440 7329", "=4845168114407329.",
        "ES91 2100 0418 4502 0005 1332 DE89 3704 0044 0532 0130 00 4845168114407329",
    ]
    kinds = [["card"], ["card"], ["iban"], ["card"], ["ssn"], ["phone"], ["date"], ["card", "card"], ["card"], ["card"], ["iban", "iban", "card"]]
    found = rewrite(spark, texts)
    assert [found[i][1] for i in range(len(texts))] == kinds
    assert all(found[i][0] != t for i, t in enumerate(texts))
    assert found[0][0].endswith(" 12/26") and found[1][0].endswith(" 100 euros") and found[2][0].endswith(" 12 May") and found[3][0].endswith("-1")
    card = found[0][0][:16]
    assert luhn(card) and found[3][0] == f"ref {card}-1" and found[1][0][:19].replace(" ", "") == card and found[8][0][5:].replace(" ", "") == card


def test_spellings_of_a_phone_or_date_share_their_digits(spark):
    phones = ["+14155551234", "+1 415 555 1234", "+1 (415) 555-1234", "+1.415.555.1234"]
    dates = ["1/2/1990", "01/02/1990", "1.2.1990", "1990-02-01"]
    found = rewrite(spark, phones + dates)
    digits = {re.sub("[^0-9]", "", found[i][0]) for i in range(4)}
    assert len(digits) == 1 and digits != {"14155551234"} and digits.pop().startswith("1")
    named = {tuple(map(int, re.split("[./-]", found[i][0])))[:: -1 if i == 7 else 1] for i in range(4, 8)}
    assert len(named) == 1 and named != {(1, 2, 1990)}


def plain_cards(text):
    """Leftmost, longest valid cards of a text of digits, blanks, hyphens and letters."""
    at, found = 0, []
    while at < len(text):
        here = None
        if text[at].isdigit() and (at == 0 or not text[at - 1].isalnum()):
            for end in range(min(len(text), at + 37), at, -1):
                part = text[at:end]
                digits = re.sub("[ -]", "", part)
                if re.fullmatch("[0-9](?: ?[0-9]){12,18}|[0-9](?:-?[0-9]){12,18}", part) and luhn(digits) and not text[end : end + 1].isalnum():
                    here = end
                    break
        if here:
            found.append((at, here))
        at = here or at + 1
    return found


def test_cards_equal_a_plain_scan(spark):
    import random

    rng = random.Random(6)
    texts = []
    for _ in range(300):
        groups = ["".join(rng.choices("0123456789", k=rng.choice([1, 2, 3, 4, 4, 4, 5, 6, 13, 15, 16]))) for _ in range(rng.randint(1, 9))]
        texts.append("x " + "".join(g + rng.choice([" ", " ", "-", "  ", " a "]) for g in groups))
    found = rewrite(spark, texts)
    for i, text in enumerate(texts):
        new, kinds = found[i]
        assert len(new) == len(text)
        spans = plain_cards(text)
        if set(kinds) <= {"card"}:
            assert len(kinds) == len(spans), text
            for a, b in spans:
                digits = re.sub("[ -]", "", new[a:b])
                assert luhn(digits) and re.sub("[0-9]", "0", new[a:b]) == re.sub("[0-9]", "0", text[a:b])
            inside = {k for a, b in spans for k in range(a, b)}
            assert all(new[k] == text[k] for k in range(len(text)) if k not in inside)


def test_columns_of_any_name_and_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.org", "p", "f", "n")], "doc_id long, text string, pattern string, `__found` string, `a.b` string")
    found = pii.pseudonymise(df, "k")
    assert found.columns == [*df.columns, "pii"] and found.first()[2:5] == ("p", "f", "n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
