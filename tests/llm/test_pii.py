"""Pseudonyms: plain versions of every kind, links over separators, texts made to strain the patterns, and the key."""

import datetime
import random
import re

import pytest

import corpus_pipeline
from reviewloom.llm import pii

from .test_brute_force import feistel, luhn


def one(spark, text, key="k"):
    return pii.pseudonymize(spark.createDataFrame([(text,)], "text string"), key).first().text


def permuted(digits, kind):
    """A string of digits through the network, by halves."""
    h = len(digits) // 2
    a, b = 10**h, 10 ** (len(digits) - h)
    left, right = feistel("k", kind, a, b, int(digits[:h] or 0), int(digits[h:]))
    return (f"{left:0{h}d}" if h else "") + f"{right:0{len(digits) - h}d}"


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def plain(value, kind):
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        body = digits[0] + permuted(digits[1:-1], kind)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "phone":
        keep = 0 if value[0] != "+" else next((n for n in (1, 2) if digits[:n] in pii.CALLING), 3)
        return ("+" if keep else "") + digits[:keep] + permuted(digits[keep:], kind)
    if kind == "iban":
        new = iter(permuted(re.sub("[^0-9]", "", value[4:]), kind))
        body = "".join(next(new) if c.isdigit() else c for c in value[4:])
        return f"{value[:2]}{98 - mod97(body + value[:2] + '00'):02}{body}"
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        left, right = feistel("k", kind, 898 * 99, 9999, (area - 1 - (area > 666)) * 99 + group - 1, serial - 1)
        area = left // 99 + 1
        return f"{area + (area > 665):03}-{left % 99 + 1:02}-{right + 1:04}"
    if kind == "date":
        n = (datetime.date.fromisoformat(value) - datetime.date(1970, 1, 1)).days
        left, right = feistel("k", kind, 270, 270, n % 72900 // 270, n % 270)
        return str(datetime.date(1970, 1, 1) + datetime.timedelta(n - n % 72900 + left * 270 + right))
    groups = [int(g, 16) for g in value.split(":")]
    number = lambda gs: gs[0] << 32 | gs[1] << 16 | gs[2]
    left, right = feistel("k", kind, 1 << 48, 1 << 48, number(groups[2:5]), number(groups[5:]))
    return ":".join(f"{g:x}" for g in [*groups[:2], *(x >> s & 65535 for x in (left, right) for s in (32, 16, 0))])


def test_every_kind_against_python(spark):
    rng = random.Random(5)
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for _ in range(40):
        body = "4" + number(14)
        rows.append(("card", next(body + c for c in "0123456789" if luhn(body + c))))
        rows.append(("phone", rng.choice(["+1", "+49", "+351", "+44"]) + number(rng.randint(7, 10))))
        bban = rng.choice([number(18), "NWBK" + number(14)])
        country = "DE" if bban[0].isdigit() else "GB"
        rows.append(("iban", f"{country}{98 - mod97(bban + country + '00'):02}{bban}"))
        rows.append(("ssn", f"{rng.choice([rng.randint(1, 665), rng.randint(667, 899)]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"))
        rows.append(("date", str(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(60_000)))))
        rows.append(("ip6", ":".join(["2001", "db8", *(f"{rng.randrange(65536):x}" for _ in range(6))])))
    df = spark.createDataFrame([(i, f"see {v} there") for i, (_, v) in enumerate(rows)], "i int, text string")
    got = {r.i: r.text for r in pii.pseudonymize(df, "k").collect()}
    assert [got[i] for i in range(len(rows))] == [f"see {plain(v, kind)} there" for kind, v in rows]


@pytest.mark.parametrize(
    "forms",
    [
        ["+442071234567", "+44 20 7123 4567", "+44 (0)20 7123 4567", "+44 (20) 7123-4567", "+44.20.7123.4567"],
        ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "743.555.3824", "+17435553824"],
        ["+352 621 123 456", "+352621123456"],
        ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
        ["GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926819"],
        ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"],
    ],
)
def test_equal_values_stay_linked_whatever_their_separators(spark, forms):
    new = [one(spark, f"x {f} y")[2:-2] for f in forms]
    bare = {re.sub("[^0-9A-Z]", "", x.replace("(0)", "").removeprefix("+1" if forms[0].startswith("+1") else "+")) for x in new}
    assert len(bare) == 1
    shape = lambda x: re.sub("[0-9]", "0", x)
    assert list(map(shape, new)) == list(map(shape, forms))
    assert not set(new) & set(forms)


def test_addresses_in_short_form_are_linked(spark):
    a, b = one(spark, "2001:db8::1").lower(), one(spark, "2001:0DB8:0000:0000:0000:0000:0000:0001")
    assert a == b
    assert len(a.split(":")) == 8


@pytest.mark.parametrize("t", ["AT61 1904 3002 3457 3201 THEN", "at 12:30:45 std::abs a::b ::1", "DE88 3704 0044 0532 0130 00", "10:20:30:40:50:60:70:80:90"])
def test_what_follows_or_is_not_valid_stays(spark, t):
    got = one(spark, t)
    assert got == t if "AT" not in t else got.endswith(" THEN") and got != t


N = 100_000
STRAINS = {
    "labels": "a@" + "b." * N + "c", "local": "a." * N + "@b.c", "at": "a@" * N, "iban": "DE89" + " 3704" * N, "iban run": "DE89" * N, "hex": "ab12" * N, "ip": "1.2.3.4." * N, "octets": "1." * N,
    "ip6": "ab1:" * N + ":1", "colons": ":" * N, "date": "2024-01-01-" * N, "ssn": "123-45-6789-" * N, "phone": "+1 743 555 " * N, "groups": "+1" + " 555" * N, "trunk": "+1(0)" * N, "dashes": "555-" * N,
    "card": "4111 " * N, "digits": "1" * N, "plus": "+" * N, "percent": "%" * N,
}


@pytest.mark.parametrize("stage", [False, True])
def test_long_texts_of_every_kind(spark, stage):
    df = spark.createDataFrame(list(enumerate(STRAINS.values())), "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["pseudonyms"](spark, df, None) if stage else pii.pseudonymize(df, "k")
    got = {r.doc_id: r.text for r in out.collect()}
    for i, (name, t) in enumerate(STRAINS.items()):
        if name == "labels":
            assert re.fullmatch("u[0-9a-f]{12}@", got[i][: 14])
            assert got[i][14:] == t[2:]
        elif name == "local":
            assert re.fullmatch(r"u[0-9a-f]{12}@b\.c", got[i])
        else:
            assert got[i] == t


def test_many_values_in_one_text(spark):
    text = "123-45-6789 10.0.0.1 a@b.c " * 10_000
    r = pii.pseudonymize(spark.createDataFrame([(text,)], "text string"), "k", count="n").first()
    assert r.n == 30_000
    assert len(set(r.text.split())) == 3


def test_the_key_is_asked_for_and_not_shown(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "text string")
    for key in ("", None):
        with pytest.raises(ValueError, match="key"):
            pii.pseudonymize(df, key)
    out = pii.pseudonymize(df, "a key of mine")
    assert out.first().text != one(spark, "10.0.0.1", "another")
    assert "a key of mine" not in out._jdf.queryExecution().toString()
    assert pii.run_key(spark) != pii.run_key(spark)
    spark.conf.set(pii.KEY_SETTING, "set")
    assert pii.run_key(spark) == "set"
    spark.conf.unset(pii.KEY_SETTING)
