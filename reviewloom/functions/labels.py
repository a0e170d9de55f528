"""Ratings, labels and pattern scores, as Column -> Column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, text


def _none(c: Column) -> Column:
    """NaN is null here: in Spark it would be greater than all numbers."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def rate_to_label(rate: Column) -> Column:
    r = _none(rate)
    return F.when(r.isNull(), F.lit(None).cast("int")).when(r <= 2, -1).when(r <= 3.5, 0).otherwise(1)


def rate_negative_bonus(rate: Column) -> Column:
    r = _none(rate)
    return F.when(r.isNull(), 0.0).when(r <= 2, 2.6).when(r <= 3, 1.6).when(r <= 3.5, 1.0).otherwise(0.0)


def rate_positive_bonus(rate: Column) -> Column:
    r = _none(rate)
    return F.when(r.isNull(), 0.0).when(r >= 4.8, 0.9).when(r >= 4.5, 0.6).otherwise(0.0)


def parse_label(c: Column) -> Column:
    """-1, 0, 1 out of numbers (within 1e-6) or words, in any of the known digits; else null."""
    s = F.lower(text.collapse(text.digits(c.cast("string"))))
    v = s.try_cast("double")
    near = F.bround(v, 0)
    word = F.lit(None).cast("int")
    for label, words in fixed.LABEL_WORDS.items():
        word = F.when(s.isin(words), label).otherwise(word)
    return F.when(v.isNotNull() & ~F.isnan(v) & near.isin(-1, 0, 1) & (F.abs(v - near) < 1e-6), near.cast("int")).otherwise(word)


def parse_bool(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1", "yes"), True).when(s.isin("false", "0", "no", ""), False)


def class_id(label: Column) -> Column:
    return label + 1


def placeholder(label: Column, c: Column) -> Column:
    return F.coalesce((label == -1) & (c == fixed.PLACEHOLDER), F.lit(False))


def placeholder_extended(flag: Column, c: Column) -> Column:
    """The flag, or the placeholder as the whole text or within it."""
    t = text.collapse(F.coalesce(c, F.lit("")))
    return F.coalesce(flag.cast("boolean"), F.lit(False)) | (t == fixed.PLACEHOLDER) | t.rlike(text.U + r"\bعدم\s*رضایت\b")


Patterns = list[tuple[str, str, float]]


def pattern_hits(c: Column, patterns: Patterns) -> dict[str, Column]:
    c = F.coalesce(c, F.lit(""))
    return {name: c.rlike(text.U + p) for name, p, _ in patterns}


def pattern_score(c: Column, patterns: Patterns) -> tuple[Column, Column]:
    """(sum of the weights of the patterns found, their names joined by |)"""
    hits = pattern_hits(c, patterns)
    score = F.lit(0.0)
    for name, _, w in patterns:
        score = score + F.when(hits[name], F.lit(float(w))).otherwise(0.0)
    return score, F.concat_ws("|", *[F.when(hits[name], F.lit(name)) for name, _, _ in patterns])


def cue(c: Column, pattern: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike(text.U + pattern)


@dataclass(frozen=True)
class WeakParams:
    """Thresholds of the weak labels: the tuned ones of the published report."""

    neg_th: float = 1.6
    pos_th: float = 1.6
    info_max_words: int = 3
    mixed_margin: float = 0.8
    neg_margin_th: float = 1.0
    pos_margin_th: float = 0.6
    service_pos_max: float = 1.2
    pos_strong_th: float = 2.8
    pos_strong_neg_max: float = 1.2


@dataclass(frozen=True)
class WeakRules:
    negative: tuple = tuple(fixed.WEAK_NEGATIVE)
    positive: tuple = tuple(fixed.WEAK_POSITIVE)
    cues: tuple = tuple(fixed.WEAK_CUES.items())
    money: tuple = ("money", "pharmacy_profit")


def weak_features(c: Column, rules: WeakRules = WeakRules()) -> dict[str, Column]:
    """What the cascade needs of a text: it is computed once, whatever number of thresholds is tried."""
    t, cues = text.norm_text(c), dict(rules.cues)
    neg, neg_hits = pattern_score(t, list(rules.negative))
    pos, pos_hits = pattern_score(t, list(rules.positive))
    service = cue(t, cues["service"])
    return {
        "w_words": text.word_count(c),
        "w_neg": neg,
        "w_pos": pos,
        "w_neg_hits": neg_hits,
        "w_pos_hits": pos_hits,
        "w_service_strong": service & cue(t, cues["service_strong"]),
        "w_info": cue(t, cues["info"]),
        "w_early": cue(t, cues["early"]),
        "w_self_harm": cue(t, cues["self_harm"]),
        "w_improved": cue(t, cues["improved"]),
        "w_complaint": cue(t, cues["complaint"]),
        "w_money": F.arrays_overlap(F.split(neg_hits, "\\|"), F.array(*map(F.lit, rules.money))),
    }


def weak_label(p: WeakParams | dict[str, Column] = WeakParams()) -> Column:
    """struct(label, confidence, reason) of columns named as weak_features(): the first rule that fits decides.

    `p` gives the thresholds as numbers, or as columns when they are a row's own.
    """
    v = {k: F.lit(x) for k, x in vars(p).items()} if isinstance(p, WeakParams) else p
    words, neg, pos = F.col("w_words"), F.col("w_neg"), F.col("w_pos")

    def out(label: int, conf: Column | float, reason: str) -> Column:
        conf = F.lit(conf) if isinstance(conf, float) else conf
        return F.struct(F.lit(label).alias("label"), conf.cast("double").alias("confidence"), F.lit(reason).alias("reason"))

    def by_margin(m: Column) -> Column:
        return F.greatest(F.lit(0.55), F.least(F.lit(0.95), F.lit(0.62) + 0.10 * m))

    silent = (neg == 0) & (pos == 0)
    return (
        F.when(silent & ((words <= v["info_max_words"]) | F.col("w_info")), out(0, 0.94, "informational"))
        .when(F.col("w_early") & ~F.col("w_complaint") & (neg < v["neg_th"]) & (pos < v["pos_th"]), out(0, 0.90, "early_stage"))
        .when(F.col("w_self_harm") & F.col("w_improved") & ~F.col("w_complaint"), out(1, 0.72, "state_improved_despite_selfharm"))
        .when((pos >= v["pos_strong_th"]) & (neg <= v["pos_strong_neg_max"]), out(1, F.least(F.lit(0.95), F.lit(0.70) + 0.08 * (pos - neg)), "pos_strong"))
        .when(F.col("w_service_strong") & (pos > 0), out(0, 0.85, "mixed_service"))
        .when(F.col("w_money") & (pos > 0), out(0, 0.84, "mixed_money"))
        .when((neg > 0) & (pos > 0) & (F.abs(pos - neg) < v["mixed_margin"]), out(0, 0.72, "mixed"))
        .when((neg >= v["neg_th"]) & (neg - pos >= v["neg_margin_th"]), out(-1, by_margin(neg - pos), "neg_kw"))
        .when(F.col("w_service_strong") & (pos <= v["service_pos_max"]), out(-1, 0.80, "neg_service"))
        .when((pos >= v["pos_th"]) & (pos - neg >= v["pos_margin_th"]), out(1, by_margin(pos - neg), "pos_kw"))
        .otherwise(out(0, 0.45, "default_neu"))
    )


def accepted_label(conf_neg: float = 0.78, conf_pos: float = 0.70, conf_info: float = 0.90, conf_mixed: float = 0.82) -> Column:
    """The weak label where class, reason and confidence allow it for training, else null."""
    label, conf, reason = F.col("label_weak"), F.col("weak_confidence"), F.col("weak_reason")
    return (
        F.when((label == -1) & (conf >= conf_neg) & reason.isin("neg_kw", "neg_service"), -1)
        .when((label == 1) & (conf >= conf_pos) & reason.isin("pos_kw", "pos_strong"), 1)
        .when((label == 0) & (conf >= conf_info) & reason.isin("informational", "early_stage"), 0)
        .when((label == 0) & (conf >= conf_mixed) & reason.isin("mixed_money", "mixed_service", "mixed"), 0)
    )
