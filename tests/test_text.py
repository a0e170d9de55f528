import random

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import fixed, html, jsonrepair, labels, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (text.char_normalize, "۱۲‌ي", "12 ی"),
        (text.char_normalize, "سلام!! ABC é", "سلام ABC"),
        (text.elongation, "عااااالی", "عاالی"),
        (text.elongation, "aa   bb", "aa   bb"),
        (text.deglue, "درحال درمان باسلام", "در حال درمان با سلام"),
        (text.deglue, "درحالی", "درحالی"),
        (text.pre_clean, "a.b 1.5 c. ؟", "a b 1.5 c"),
        (text.pre_clean, "a...b", "a b"),
        (text.norm_text, "خوووووب\tبود", "خووب بود"),
        (text.text_key, " a‌b  c ", "a b c"),
        (text.collapse, " a  b ", "a b"),
        (text.year_of, "۱۴۰۴/۱۲/۰۳", "1404"),
        (text.normalize, "", ""),
        (text.text_key, None, ""),
        (text.elongation, None, None),
    ],
)
def test_text_rules(spark, f, given, expected):
    assert one(spark, given, f) == expected


def test_normalization_is_idempotent(spark):
    rows = [("خوووب  بود!!",), ("aaaa bbbb",), ("درحال درمان",), ("x.y 1.2",)]
    df = spark.createDataFrame(rows, "x string").select(text.normalize(F.col("x")).alias("a")).withColumn("b", text.normalize(F.col("a")))
    assert df.filter("a != b").count() == 0


def test_tokens_and_ngrams(spark):
    assert one(spark, " a bb  ccc ", text.tokens) == ["bb", "ccc"]
    assert one(spark, None, text.tokens) == []
    assert one(spark, ["a", "b", "c"], text.ngrams, "array<string>") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, ["a"], text.ngrams, "array<string>") == ["a"]
    assert one(spark, [], text.ngrams, "array<string>") == []
    assert one(spark, "MRI and x.y-1", text.latin_tokens) == ["mri", "and", "x.y-1"]


def greedy(toks, stop, bigrams, allow):
    kept, removed, i = [], [], 0
    while i < len(toks):
        t = toks[i].lower()
        if t in allow:
            kept.append(toks[i])
        elif i + 1 < len(toks) and (t, toks[i + 1].lower()) in bigrams:
            removed += toks[i : i + 2]
            i += 1
        elif t in stop:
            removed.append(toks[i])
        else:
            kept.append(toks[i])
        i += 1
    return kept, removed


@pytest.mark.parametrize("overlapping", [None, [("a", "b"), ("b", "c"), ("c", "c"), ("b", "mri")]])
def test_stop_filter_equals_a_scan(spark, overlapping):
    rng = random.Random(1)
    rows = [([rng.choice(["a", "b", "c", "d", "e", "MRI"]) for _ in range(rng.randint(0, 9))],) for _ in range(400)]
    stop, allow = ["c", "a"], ["mri"]
    pairs = overlapping or [("a", "b"), ("d", "e")]
    kept, removed = text.greedy_stop_filter(F.col("x"), stop, pairs, allow)
    for r in spark.createDataFrame(rows, "x array<string>").select("x", kept.alias("k"), removed.alias("r")).collect():
        assert (r.k, r.r) == greedy(r.x, stop, pairs, allow)


def test_stop_filter_of_phrases(spark):
    def run(s):
        kept, removed = text.greedy_stop_filter(F.split(F.col("x"), " "), fixed.MEDICAL_STOPWORDS, fixed.MEDICAL_BIGRAMS, fixed.LATIN_ALLOWLIST)
        r = spark.createDataFrame([(s,)], "x string").select(kept.alias("k"), removed.alias("r")).first()
        return r.k, r.r

    assert run("فوق العاده درد") == (["درد"], ["فوق", "العاده"])
    assert run("فوق تخصص") == (["فوق", "تخصص"], [])
    assert run("MRI گردن") == (["MRI", "گردن"], [])


@pytest.mark.parametrize(
    ("given", "expected"),
    [("-1.0", -1), ("۱", 1), ("٠", 0), ("منفی", -1), (" Neutral ", 0), ("mixed", 0), ("0.4", None), ("2", None), ("", None), (None, None), ("nan", None), ("-۱", -1), ("1.0000001", 1)],
)
def test_parse_label(spark, given, expected):
    assert one(spark, given, labels.parse_label) == expected


@pytest.mark.parametrize(("rate", "label", "neg", "pos"), [(None, None, 0.0, 0.0), (float("nan"), None, 0.0, 0.0), (2.0, -1, 2.6, 0.0), (3.0, 0, 1.6, 0.0), (3.5, 0, 1.0, 0.0), (4.0, 1, 0.0, 0.0), (4.5, 1, 0.0, 0.6), (5.0, 1, 0.0, 0.9)])
def test_rates(spark, rate, label, neg, pos):
    r = spark.createDataFrame([(rate,)], "x double").select(labels.rate_to_label(F.col("x")).alias("a"), labels.rate_negative_bonus(F.col("x")).alias("b"), labels.rate_positive_bonus(F.col("x")).alias("c")).first()
    assert (r.a, r.b, r.c) == (label, neg, pos)


def test_placeholders(spark):
    df = spark.createDataFrame([(-1, "عدم رضایت"), (1, "عدم رضایت"), (-1, "عدم  رضایت از مطب"), (-1, None)], "label int, t string")
    r = df.select(labels.placeholder(F.col("label"), F.col("t")).alias("a"), labels.placeholder_extended(F.lit(None).cast("boolean"), F.col("t")).alias("b")).collect()
    assert [(x.a, x.b) for x in r] == [(True, True), (False, True), (False, True), (False, False)]


@pytest.mark.parametrize(
    ("t", "label", "confidence", "reason"),
    [
        ("ممنون", 0, 0.45, "default_neu"),
        ("آزمایش دادم", 0, 0.94, "informational"),
        ("دکتر خیلی عالی و حاذق بود ممنون", 1, 0.95, "pos_strong"),
        ("منشی بد برخورد بود و معطلی زیاد داشت", -1, 0.95, "neg_kw"),
        ("خیلی شلوغ بود ولی دکتر عالی بود ولی پولکی", 0, 0.85, "mixed_service"),
        ("", 0, 0.94, "informational"),
        (None, 0, 0.94, "informational"),
    ],
)
def test_weak_labels(spark, t, label, confidence, reason):
    r = spark.createDataFrame([(t,)], "x string").withColumns(labels.weak_features(F.col("x"))).select(labels.weak_label().alias("w")).first().w
    assert (r.label, round(r.confidence, 6), r.reason) == (label, confidence, reason)


def test_json_repair(spark):
    assert [x.item_id for x in one(spark, '```json\n[{"item_id":"a","label":1,}]\n```', lambda c: jsonrepair.parse_array(jsonrepair.sanitize(c)))] == ["a"]
    assert one(spark, 'so: [{"item_id":"a"}] end', jsonrepair.parse_array)[0].item_id == "a"
    assert one(spark, '[{"item_id":"a"', jsonrepair.parse_array) is None
    assert one(spark, '[{"item_id":"a","label":1},{"item_id":"b"', jsonrepair.salvage_flat) == ['{"item_id":"a","label":1}']
    assert jsonrepair.complete_objects('[{"a": "}{", "b": {"c": 1}}, {"d": 2}, {"e":') == ['{"a": "}{", "b": {"c": 1}}', '{"d": 2}']
    assert one(spark, '{"a": {"b": "}"}} {', jsonrepair.salvage_nested) == ['{"a": {"b": "}"}}']


def test_pages(spark):
    assert one(spark, "تعداد ۱۲,۳۴۵ نظر", html.first_int) == 12345
    assert one(spark, '<i style="width: 87.5%">', html.width_percent) == 87.5
    assert one(spark, 87.5, html.stars, "double") == 4.38
    page = '<a href="https://t.me/x"></a><a href="https://instagram.com/1"></a><a href="https://instagram.com/2"></a>'
    assert one(spark, page, html.social) == {"telegram": "https://t.me/x", "instagram": "https://instagram.com/2"}
    assert one(spark, None, html.social) == {}
    assert one(spark, "https://a.b/c//?q=1", html.canonical_url) == "https://a.b/c"
    assert one(spark, '<b data-drid="17">', lambda c: html.attribute(c, "data-drid")) == "17"
    assert one(spark, "<style>p{}</style><p>a&nbsp;</p>  b<script>x</script>", html.plain) == "a&nbsp; b"
