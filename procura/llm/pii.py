"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated values are permuted within their own format by keyed Feistel networks, so equal values get equal pseudonyms in
every document and different values different ones:

- card: 13 to 19 digits with a right Luhn sum, groups parted by blanks or by hyphens; all digits but the last are
  permuted and the last is computed anew, so the pseudonym passes Luhn too
- phone: 10 to 15 digits after `+`, or a grouped national number; the digits after the country code of E.164 are permuted,
  so all spellings of a number share their digits
- ssn: ddd-dd-dddd with a possible area, group and serial; permuted within the possible ones
- ipv4: four numbers up to 255; permuted over all addresses
- iban: the length of its country and right check digits; letters stay letters and digits digits, check digits are
  computed anew
- date: a date of the calendar from 1900-01-01 to 2100-05-02 as yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy or mm/dd/yyyy, day and
  month also of one digit; permuted within that range. All spellings of a date share theirs; a day-first and a
  month-first pseudonym may therefore read alike
- email: letters and digits of the local part keep their class; the domain stays

Where a value begins every length is tried and the longest valid one counts, so digits that follow a card or an IBAN do
not hide it. To find them without a second reading, the valid cards and IBANs of a text become alternatives of the
pattern by which it is cut; of values that overlap the leftmost counts, at one place the first kind in the order of
KINDS. A value does not begin or end inside a word or a longer number. Values that fail validation are left alone.
Defined cases: null text stays null, empty text empty; repeated rows get the same result; a text of any length is cut once
at its matches; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "iban", "ipv4", "date", "ssn", "card", "phone")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_DAY, _MONTH = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])"
#: Formats of the kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "ipv4": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": rf"(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|{_DAY}\.{_MONTH}\.[0-9]{{4}}|{_DAY}/{_MONTH}/[0-9]{{4}}|{_MONTH}/{_DAY}/[0-9]{{4}})(?![0-9])",
    "ssn": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?!-?[0-9])",
    "card": r"[0-9](?:(?: ?[0-9]){12,18}|(?:-?[0-9]){12,18})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{4}|\+[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{10,15}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){3,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
}
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}
#: Country codes of one and of two digits; all others have three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Before a value: no letter or digit, and of a number with points not its middle.
_FREE = r"(?<![A-Za-z0-9])"
_APART = r"(?<![A-Za-z0-9]|[0-9]\.)"
_CARD_PLACES = [_FREE + rf"(?=([0-9](?:{between}?[0-9]){{12,18}}(?![0-9])))" for between in " -"]
_IBAN_PLACES = _FREE + r"(?=((?:" + "|".join(c for group in IBAN_LENGTHS.values() for c in group.split()) + r")[0-9]{2}(?: ?[A-Z0-9]){11,28}))"


def _is(value: Column, kind: str) -> Column:
    return value.rlike(f"^{PATTERNS[kind]}$")


def _noise(key: str, tweak: str, i: Column, text: Column) -> Column:
    """60 keyed pseudorandom bits."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), i.cast("string"), F.lit("|"), text), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column | int, right_size: Column | int, key: str, tweak: str) -> Column:
    """Permute (left, right) over left_size x right_size; struct(l, r). An even number of rounds returns each half to
    its own range."""
    sizes = [F.lit(s).cast("long") if isinstance(s, int) else s.cast("long") for s in (left_size, right_size)]

    def step(acc: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, sizes[0]).otherwise(sizes[1])
        return F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + F.pmod(_noise(key, tweak, i, acc["r"].cast("string")), size), size).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Permute a string of 2 to 36 digits among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    powers = [F.rpad(F.lit("1"), size + 1, "0").cast("long") for size in (half, n - half)]
    done = feistel(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n - half).cast("long"), *powers, key, tweak)
    return F.concat(F.lpad(done["l"].cast("string"), half, "0"), F.lpad(done["r"].cast("string"), n - half, "0"))


def permute_classes(text: Column, key: str, tweak: str) -> Column:
    """Permute a string so that digits stay digits, letters letters of their case, and all else itself."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")

    def shifted(part: Column, i: Column, other: Column) -> Column:
        mask = F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), i.cast("string"), F.lit("|"), other), 256)

        def one(k: Column) -> Column:
            c = F.substring(part, k, F.lit(1))
            noise = F.conv(F.substring(F.sha2(F.concat(mask, k.cast("string")), 256), 1, 8), 16, 10).cast("long")
            move = lambda base, size: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + noise, F.lit(size)))
            return F.when(c.rlike("^[0-9]$"), move(48, 10)).when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).otherwise(c)

        return F.when(F.length(part) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), one), ""))

    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, n).alias("r"))
    done = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda acc, i: F.struct(acc["r"].alias("l"), shifted(acc["l"], i, acc["r"]).alias("r"))
    )
    return F.concat(done["l"], done["r"])


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counting once."""
    reverse = F.transform(_characters(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(reverse, F.lit(0), lambda a, x: a + x)


def _iban_rest(iban: Column) -> Column:
    """Value of the rearranged IBAN modulo 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(
        _characters(moved), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    )


def refill(pattern: Column, digits: Column) -> Column:
    """Put `digits` in order in the places of the digits of `pattern`."""
    chars = _characters(pattern)
    done = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c.rlike("^[0-9]$"), F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + c.rlike("^[0-9]$").cast("int")).alias("at"),
        ),
    )
    return done["out"]


def _date(value: Column) -> Column:
    day_first = F.regexp_replace(value, "/", ".")
    month_first = F.regexp_replace(value, "^([0-9]+)/([0-9]+)/([0-9]+)$", "$2.$1.$3")
    found = F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.try_to_timestamp(day_first, F.lit("d.M.yyyy")), F.try_to_timestamp(month_first, F.lit("d.M.yyyy")))
    return F.to_date(found)


_FIRST_DAY, _LEFT_DAYS, _RIGHT_DAYS = "1900-01-01", 270, 271


def _pseudonym(value: Column, key: str) -> Column:
    """struct(kind, text) of one match; kind is null if no validation holds."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    compact = F.regexp_replace(value, " ", "")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    address = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, key, "ipv4")
    ip = F.concat_ws(".", *[x.cast("long").cast("string") for half in ("l", "r") for x in (F.floor(address[half] / 256), address[half] % 256)])

    day = F.datediff(_date(value), F.lit(_FIRST_DAY).cast("date"))
    moved = feistel(F.floor(day / _RIGHT_DAYS), day % _RIGHT_DAYS, _LEFT_DAYS, _RIGHT_DAYS, key, "date")
    new_day = F.date_add(F.lit(_FIRST_DAY).cast("date"), (moved["l"] * _RIGHT_DAYS + moved["r"]).cast("int"))
    day_first = F.try_to_timestamp(F.regexp_replace(value, "/", "."), F.lit("d.M.yyyy")).isNotNull()
    padded = value.rlike("^[0-9]{2}[./][0-9]{2}[./]")
    date = F.when(value.contains("-"), F.date_format(new_day, "yyyy-MM-dd"))
    for holds, order in ((value.contains("."), "dd.MM.yyyy"), (day_first, "dd/MM/yyyy"), (F.lit(True), "MM/dd/yyyy")):
        short = order.replace("dd", "d").replace("MM", "M")
        date = date.when(holds & padded, F.date_format(new_day, order)).when(holds, F.date_format(new_day, short))

    area, group, serial = F.substring(digits, 1, 3).cast("int"), F.substring(digits, 4, 2).cast("int"), F.substring(digits, 6, 4).cast("int")
    real_ssn = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    area_index = area - 1 - (area > 666).cast("int")
    number = feistel(area_index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    new_area = F.floor(number["l"] / 99) + 1
    new_area = new_area + (new_area >= 666).cast("int")
    ssn = F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((number["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((number["r"] + 1).cast("string"), 4, "0"))

    payload = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(payload, F.lit("0"))) % 10, F.lit(10))
    card = refill(value, F.concat(payload, check.cast("string")))

    country = F.when(value.startswith("+"), F.length(F.regexp_extract(digits, _COUNTRY, 1))).otherwise(F.lit(0))
    phone = refill(value, F.concat(F.substring(digits, F.lit(1), country), permute_digits(F.substring(digits, country + 1, F.length(digits)), key, "phone")))

    body = permute_classes(F.substring(compact, F.lit(5), F.length(compact)), key, "iban")
    zeroed = F.concat(F.substring(compact, 1, 2), F.lit("00"), body)
    new_iban = F.concat(F.substring(compact, 1, 2), F.lpad((98 - _iban_rest(zeroed)).cast("string"), 2, "0"), body)

    def pair(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    return (
        F.when(_is(value, "email"), pair("email", F.concat(permute_classes(local, key, "email"), F.lit("@"), domain)))
        .when(_is(value, "iban") & (_iban_rest(compact) == 1), pair("iban", _spaced(value, new_iban)))
        .when(_is(value, "ipv4"), pair("ipv4", ip))
        .when(_is(value, "date") & day.between(0, _LEFT_DAYS * _RIGHT_DAYS - 1), pair("date", date))
        .when(_is(value, "ssn") & real_ssn, pair("ssn", ssn))
        .when(_is(value, "card") & (luhn_sum(digits) % 10 == 0), pair("card", card))
        .when(_is(value, "phone") & F.length(digits).between(10, 15), pair("phone", phone))
        .otherwise(F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text")))
    )


def _spaced(pattern: Column, compact: Column) -> Column:
    """`compact` with the blanks of `pattern`."""
    done = F.aggregate(
        _characters(pattern),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c == " ", F.lit(" ")).otherwise(F.substring(compact, acc["at"], F.lit(1)))).alias("out"),
            (acc["at"] + (c != " ").cast("int")).alias("at"),
        ),
    )
    return done["out"]


def _valid_card(candidate: Column) -> Column:
    """The longest valid card at the beginning of a run of digits, or null."""

    def valid(n: Column) -> Column:
        digits = F.regexp_replace(F.substring(candidate, F.lit(1), n), "[ -]", "")
        ends = F.substring(candidate, n, F.lit(1)).rlike("[0-9]") & ~F.substring(candidate, n + 1, F.lit(1)).rlike("[0-9]")
        return ends & F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0)

    return F.substring(candidate, F.lit(1), F.get(F.filter(F.sequence(F.length(candidate), F.lit(13), F.lit(-1)), valid), 0))


def _valid_iban(candidate: Column) -> Column:
    """The part of a run of capitals and digits that has the length of its country, if its check digits are right."""
    lengths = F.create_map(*[F.lit(x) for n, group in IBAN_LENGTHS.items() for c in group.split() for x in (c, n)])
    wanted = F.try_element_at(lengths, F.substring(candidate, 1, 2))
    upto = lambda n: F.replace(F.substring(candidate, F.lit(1), n), F.lit(" "), F.lit(""))
    places = F.filter(F.sequence(F.lit(15), F.length(candidate)), lambda n: (F.length(upto(n)) == wanted) & (F.substring(candidate, n, F.lit(1)) != " "))
    found = F.substring(candidate, F.lit(1), F.get(places, 0))
    return F.when(_iban_rest(F.replace(found, F.lit(" "), F.lit(""))) == 1, found)


def _alternatives(text: Column, places: list[str], valid) -> Column:
    """The valid values at the places of a text, longest first, as alternatives of a pattern; empty if there are none."""
    candidates = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in places]))
    found = F.array_distinct(F.filter(F.transform(candidates, valid), lambda v: v.isNotNull()))
    longest = F.sort_array(F.transform(found, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), asc=False)
    return F.when(F.size(found) > 0, F.concat(F.lit(f"{_FREE}(?:"), F.array_join(F.transform(longest, lambda v: v["v"]), "|"), F.lit(")(?![A-Za-z0-9])|"))).otherwise(F.lit(""))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Columns of `docs` with `text` rewritten, and `pii` array<string>: the kinds replaced, in order of place.

    key: secret of the permutation; the same key gives the same pseudonyms everywhere.
    """
    kept = [c for c in docs.columns if c != "pii"]
    rows = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(kept)])
    text = F.col("text")
    none = F.lit("")
    rows = rows.withColumns({
        "ibans": F.when(text.rlike(_IBAN_PLACES), _alternatives(text, [_IBAN_PLACES], _valid_iban)).otherwise(none),
        "cards": F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), _alternatives(text, _CARD_PLACES, _valid_card)).otherwise(none),
    })
    before = F.lit(rf"(?<![A-Za-z0-9_.+%-]){PATTERNS['email']}|")
    between_ = F.lit("".join(f"{_APART}{PATTERNS[k]}|" for k in ("ipv4", "date", "ssn")))
    rows = rows.withColumn("pattern", F.concat(before, F.col("ibans"), between_, F.col("cards"), F.lit(rf"(?<![A-Za-z0-9+]|[0-9]\.){PATTERNS['phone']}")))
    rows = rows.withColumn("found", F.when(text.rlike("@|[0-9].?[0-9]|[0-9][./]"), F.regexp_extract_all(text, F.col("pattern"), F.lit(0))))
    some = F.size("found") > 0
    rows = rows.withColumn("new", F.when(some, F.transform("found", lambda m: _pseudonym(m, key))))
    pieces = F.split(text, F.col("pattern"), -1)
    joined = F.concat_ws("", F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("new.text"), i), F.lit("")))))
    kinds = F.filter(F.coalesce(F.col("new.kind"), F.array().cast("array<string>")), lambda k: k.isNotNull())
    rewritten = F.when(some, joined).otherwise(text)
    return rows.select(*[rewritten.alias("text") if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], kinds.alias("pii"))
