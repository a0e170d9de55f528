"""Labeling pools, batches, splits and training sets."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, labels, text
from .stage import stage


def draw_key(seed: int | str, column: str) -> Column:
    """The order of a seeded draw: reproducible in any engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def sample(df: DataFrame, n: int, seed: int, row: str) -> DataFrame:
    return df.orderBy(draw_key(seed, row), row).limit(n)


def capped_sample(df: DataFrame, n: int, seed: int, row: str, group: str, per_group: int, facet: str, per_facet: int) -> DataFrame:
    """At most n rows in a seeded order, at most per_group of a group and per_facet of a facet; blank names are not capped."""

    def cap(d: DataFrame, by: str, most: int) -> DataFrame:
        # blank names are dealt by row, so that they form no large group
        blank = F.coalesce(F.trim(F.col(by).cast("string")) == "", F.lit(True))
        key = F.when(blank, F.concat(F.lit("row:"), F.col(row).cast("string"))).otherwise(F.concat(F.lit("key:"), F.col(by).cast("string")))
        w = Window.partitionBy("__cap").orderBy("__draw", row)
        return d.withColumn("__cap", key).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= most).drop("__rn", "__cap")

    out = cap(cap(df.withColumn("__draw", draw_key(seed, row)), group, per_group), facet, per_facet)
    return out.orderBy("__draw", row).limit(n).drop("__draw")


@dataclass(frozen=True)
class PoolConfig:
    seed: int = 42
    total_size: int = 8000
    n_high_neg: int = 1600
    n_service_neg: int = 1400
    n_rate_neg: int = 1400
    n_mid_neg: int = 900
    n_mixed: int = 700
    n_random: int = 1300
    n_high_pos: int = 700
    max_per_group: int = 6
    max_per_facet: int = 5000
    min_chars: int = 5
    min_words: int = 2
    high_neg: float = 2.2
    mid_neg: float = 1.2
    mixed_neg: float = 1.2
    mixed_pos: float = 1.3
    high_pos: float = 3.0
    high_pos_max_neg: float = 1.0


@dataclass(frozen=True)
class PoolRules:
    negative: tuple = tuple(fixed.POOL_NEGATIVE)
    positive: tuple = tuple(fixed.POOL_POSITIVE)
    service: str = fixed.POOL_SERVICE
    mild_negative: str = fixed.POOL_MILD_NEGATIVE


def usable(df: DataFrame, c: Column, config: PoolConfig = PoolConfig()) -> DataFrame:
    t = text.collapse(F.coalesce(c, F.lit("")))
    return df.filter((F.length(t) >= config.min_chars) & (F.size(F.filter(F.split(t, " "), lambda x: x != "")) >= config.min_words))


def pool_scores(df: DataFrame, c: Column, rate: Column, rules: PoolRules = PoolRules()) -> DataFrame:
    neg, neg_hits = labels.pattern_score(c, list(rules.negative))
    pos, pos_hits = labels.pattern_score(c, list(rules.positive))
    service = labels.cue(c, rules.service)
    out = df.withColumn("neg_score_kw", neg).withColumn("neg_hits", neg_hits).withColumn("pos_score_kw", pos).withColumn("pos_hits", pos_hits)
    out = out.withColumn("neg_score_rate", labels.rate_negative_bonus(rate)).withColumn("pos_score_rate", labels.rate_positive_bonus(rate))
    out = out.withColumn("neg_score", F.col("neg_score_kw") + F.col("neg_score_rate")).withColumn("pos_score", F.col("pos_score_kw") + F.col("pos_score_rate"))
    return out.withColumn("has_service_term", service.cast("int")).withColumn("has_service_neg_cue", (service & labels.cue(c, rules.mild_negative)).cast("int"))


def buckets(config: PoolConfig = PoolConfig()) -> Column:
    """The buckets of a scored row, as an array: one of the negative ones or mixed at most, high_pos beside it, or random."""
    neg, pos, nk, pk, nr = (F.col(c) for c in ("neg_score", "pos_score", "neg_score_kw", "pos_score_kw", "neg_score_rate"))
    mixed = (nk >= config.mixed_neg) & (pk >= config.mixed_pos)
    service = (F.col("has_service_term") == 1) & ((F.col("has_service_neg_cue") == 1) | (nr >= 1.0))
    first = (
        F.when(mixed, "mixed")
        .when((neg >= config.high_neg) & (pos <= 1.0), "high_neg")
        .when(service, "service_neg")
        .when(nr >= 1.0, "rate_neg")
        .when((nk >= config.mid_neg) & (neg < config.high_neg), "mid_neg")
    )
    high = F.when((pos >= config.high_pos) & (neg <= config.high_pos_max_neg), "high_pos")
    both = F.array_compact(F.array(first, high))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("random")))


#: The order in which a row that several buckets drew keeps its first.
PRIORITY = ("high_neg", "service_neg", "rate_neg", "mid_neg", "mixed", "random", "high_pos")


def priority_union(parts: list[tuple[str, DataFrame]], row: str) -> DataFrame:
    """The union of the parts, each row once, in the first part that holds it; `bucket` names it."""
    named = [d.withColumn("bucket", F.lit(name)).withColumn("__p", F.lit(i)) for i, (name, d) in enumerate(parts)]
    w = Window.partitionBy(row).orderBy("__p")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__p")


def build_pool(scored: DataFrame, row: str, group: str, facet: str, config: PoolConfig = PoolConfig()) -> DataFrame:
    """A pool of total_size rows: a capped draw of each bucket, then two looser top-ups and a free one; ids in drawn order."""
    own = stage(scored.withColumn("__buckets", buckets(config)))
    quota = {f.name[2:]: getattr(config, f.name) for f in fields(config) if f.name.startswith("n_")}
    parts = []
    for i, name in enumerate(PRIORITY):
        per = max(2, config.max_per_group // 2) if name == "random" else config.max_per_group
        parts.append((name, capped_sample(own.filter(F.array_contains("__buckets", name)), quota[name], config.seed + 1 + i, row, group, per, facet, config.max_per_facet)))
    pool = stage(priority_union(parts, row))
    rest = own.join(pool.select(row), row, "left_anti")
    hint = (F.col("neg_score_rate") > 0) | (F.col("has_service_term") == 1) | (F.col("neg_score_kw") > 0)
    ladder = [("topup_pref", rest.filter(hint), 20), ("topup_random", rest, 50), ("final_backfill", rest, config.total_size)]
    for i, (name, left, per) in enumerate(ladder):
        more = capped_sample(left.join(pool.select(row), row, "left_anti"), config.total_size, config.seed + 99 + i, row, group, per, facet, max(config.max_per_facet, per)).withColumn("bucket", F.lit(name))
        # a top-up counts after what is there already: the first total_size rows stay
        both = pool.withColumn("__s", F.lit(0)).unionByName(more.withColumn("__s", F.lit(1)))
        pool = both.orderBy("__s", draw_key(config.seed + 99 + i, row), row).limit(config.total_size).drop("__s")
        pool = stage(pool)
    # at most total_size rows, whatever the input: a window over them is small
    order = Window.orderBy(draw_key(config.seed, row), row)
    return pool.drop("__buckets").withColumn("item_id", F.format_string("sent_%06d", F.row_number().over(order) - 1))


def quota_batch(pool: DataFrame, quotas: dict[str, int], size: int, seed: int, row: str, duplicates: int = 80) -> DataFrame:
    """Rows by bucket quota, backfilled to `size`, then `duplicates` of them again for agreement checks (is_duplicate 1)."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    w = Window.partitionBy("bucket").orderBy(draw_key(seed, row), row)
    ranked = pool.withColumn("__rn", F.row_number().over(w)).withColumn("__in", F.coalesce(F.col("__rn") <= quota[F.col("bucket")], F.lit(False)))
    batch = ranked.orderBy(F.desc("__in"), draw_key(seed, row), row).limit(size).drop("__rn", "__in").withColumn("is_duplicate", F.lit(0))
    again = sample(batch, duplicates, seed + 1, row).withColumn("is_duplicate", F.lit(1))
    both = batch.unionByName(again)
    order = Window.orderBy(draw_key(seed + 2, row), row, "is_duplicate")
    return both.withColumn("task_id", F.format_string("task01_%05d", F.row_number().over(order)))


@dataclass(frozen=True)
class SplitConfig:
    """Shares of dev and test, their least size, and the class size below which all rows are for training."""

    dev: float = 0.10
    test: float = 0.10
    least: int = 1
    min_class: int = 5


HUMAN = SplitConfig()
LLM = SplitConfig(min_class=10)
GOLD = SplitConfig(dev=0.15, test=0.15, least=3, min_class=18)


def stratified_split(df: DataFrame, label: str, row: str, seed: int = 42, config: SplitConfig = HUMAN) -> DataFrame:
    """Adds `split`: per class, drawn in a seeded order, train first, then dev, then test."""
    n = F.count("*").over(Window.partitionBy(label))
    rn = F.row_number().over(Window.partitionBy(label).orderBy(draw_key(seed, row), row))
    out = df.withColumn("__n", n).withColumn("__rn", rn)
    dev = F.greatest(F.lit(config.least), F.bround(F.col("__n") * config.dev, 0).cast("int"))
    test = F.greatest(F.lit(config.least), F.bround(F.col("__n") * config.test, 0).cast("int"))
    train = F.col("__n") - dev - test
    split = F.when((F.col("__n") < config.min_class) | (train < 1) | (F.col("__rn") <= train), "train").when(F.col("__rn") <= train + dev, "dev").otherwise("test")
    return out.withColumn("split", split).drop("__n", "__rn")


def group_split(df: DataFrame, group: str, seed: int = 42, dev: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds `split` by a hash of the group: a group is in one split."""
    u = F.conv(F.substring(draw_key(seed, group), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("split", F.when(u < test, "test").when(u < test + dev, "dev").otherwise("train"))


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that are in more than one split: no rows if all is well."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def balance(df: DataFrame, label: str, row: str, seed: int = 42, cap: int | None = None) -> DataFrame:
    """Every class drawn down to the size of the smallest (or the cap)."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("__least"))
    rn = F.row_number().over(Window.partitionBy(label).orderBy(draw_key(seed, row), row))
    limit = F.least(F.col("__least"), F.lit(cap)) if cap else F.col("__least")
    return df.withColumn("__rn", rn).crossJoin(F.broadcast(least)).filter(F.col("__rn") <= limit).drop("__rn", "__least")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (K * n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"), F.count("*").alias("__k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", F.round(F.col("__all") / (F.col("__k") * F.col("n")), 6).alias("weight"))


def cap_by_reference(weak: DataFrame, gold: DataFrame, label: str, row: str, mult: float = 6.0, seed: int = 42) -> DataFrame:
    """Weak rows, per class at most mult times the gold rows of the class; classes without gold have none."""
    most = gold.groupBy(label).agg((F.count("*") * mult).cast("int").alias("__most"))
    rn = F.row_number().over(Window.partitionBy(label).orderBy(draw_key(seed, row), row))
    return weak.withColumn("__rn", rn).join(F.broadcast(most), label).filter("__rn <= __most").drop("__rn", "__most")


def repeat(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times."""
    return df.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__k")


def agreement(batch: DataFrame, label: str, item: str = "item_id") -> DataFrame:
    """Items with two labels or more: how many, and whether they agree."""
    per = batch.filter(F.col(label).isNotNull()).groupBy(item).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"), F.array_sort(F.collect_list(label)).alias("all_labels"))
    return per.filter("n >= 2").select(item, "n", (F.col("k") == 1).alias("agrees"), "all_labels")


def greedy_batches(df: DataFrame, order: str, length: Column, max_items: int = 30, max_chars: int = 12_000, callers: int = 1) -> DataFrame:
    """Adds caller and batch_no: in order, a batch is closed when the next row would exceed items or characters.

    Each caller sends its range of the work list in order, one request after the other; a
    partition holds a caller's list and is folded as a stream.
    """
    import pyarrow as pa

    rows = df.withColumn("__n", F.coalesce(length.cast("long"), F.lit(0)))
    dealt = (rows.repartitionByRange(callers, order) if callers > 1 else rows.coalesce(1)).sortWithinPartitions(order)

    def fold(batches):
        from pyspark import TaskContext

        batch, items, chars = 0, 0, 0
        for b in batches:
            out = []
            for n in b.column("__n").to_pylist():
                if items and (items >= max_items or chars + n > max_chars):
                    batch, items, chars = batch + 1, 0, 0
                items, chars = items + 1, chars + n
                out.append(batch)
            kept = [c for c in b.schema.names if c != "__n"]
            caller = pa.array([TaskContext.get().partitionId() if callers > 1 else 0] * len(out), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], caller, pa.array(out, pa.int32())], names=[*kept, "caller", "batch_no"])

    from pyspark.sql.types import IntegerType, StructField, StructType

    return dealt.mapInArrow(fold, StructType([*df.schema.fields, StructField("caller", IntegerType()), StructField("batch_no", IntegerType())]))


def hybrid_training_set(gold: DataFrame, weak: DataFrame, row: str, repeat_gold: int = 3, mult: float = 6.0, seed: int = 42) -> DataFrame:
    """Gold rows (label_human_int, split) and accepted weak rows (label_final): train with repeats and caps, gold dev and test."""
    split = stratified_split(gold, "label_human_int", row, seed, GOLD)
    train = split.filter("split = 'train'")
    capped = cap_by_reference(weak.filter("label_final is not null").withColumn("label_human_int", F.col("label_final")), train, "label_human_int", row, mult, seed)
    parts = [repeat(train, repeat_gold), capped.withColumn("split", F.lit("train")), split.filter("split != 'train'")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def candidate_masks(pos: Column, neg: Column, complaint: Column, soft_pos: Column, contrast: Column, short: Column, rate: Column, neg_rate: float = 1.8) -> dict[str, Column]:
    """Whether a row is a candidate of each class, out of its cue flags; classes may overlap. A null rate is no sign of either."""
    mixed = (neg | complaint) & (pos | soft_pos) & contrast
    low = F.coalesce(rate <= neg_rate, F.lit(False))
    return {
        "mixed_cue": mixed,
        "pos_cand": pos & ~neg & ~complaint & ~short,
        "neg_cand": (neg | complaint | low) & ~pos & ~short & ~mixed,
        "neu_cand": mixed | (~pos & ~neg),
    }


def one_per_key(df: DataFrame, row: str) -> DataFrame:
    """The table itself; a key that is there twice makes it fail when it is read."""
    cols = [c for c in df.columns if c != row]
    one = df.groupBy(row).agg(F.count("*").alias("__n"), F.first(F.struct(*cols)).alias("__r"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{row} is not unique: "), F.col(row).cast("string")))).otherwise(F.col("__r"))
    return one.withColumn("__r", checked).select(row, "__r.*")


def audit(weak: DataFrame, answers: DataFrame, row: str, weak_label: str = "label_weak", label: str = "label_llm") -> DataFrame:
    """Weak labels beside the model's answers, one row an item that has both, and whether they differ."""
    both = one_per_key(weak, row).join(one_per_key(answers, row), row)
    return both.withColumn("changed", ~F.col(weak_label).eqNullSafe(F.col(label)))


def bert_dataset(df: DataFrame, c: str, label: str, *keep: str) -> DataFrame:
    """(text_bert, label_id) of the rows whose trimmed text is not blank."""
    out = df.select(*keep, F.trim(F.coalesce(F.col(c), F.lit(""))).alias("text_bert"), F.col(label).cast("int").alias("label_id"))
    return out.filter("text_bert != ''")
