"""Quality rules by distribution divergence, in DataFrame expressions alone.

A document's characters fall into eight classes and its words into the most common
words of its language and the rest. Either histogram is compared with its language's
reference by the Jensen-Shannon distance. The reference is the sum over the corpus of
the documents of that language that are near it themselves: it starts from all long
enough documents and is trimmed twice. A sample of n items from the reference itself
has an expected squared distance of about (bins - 1) / (8 n ln 2); what exceeds that is
judged, and only for documents of a minimum length.

Defined results: a null text is empty, has no words and fails the base rule (fewer than
ten words); languages without a word list (and null) share one reference of characters
and have no rule on words; with no long enough document a language has no reference and
its documents are judged by the base rule alone; every row is judged by itself, so
repeated rows get equal results; columns of other names are kept by `keep`; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Common words of each language, in its order of frequency.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "auf", "für", "des", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por", "con", "no", "una", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "par", "avec", "qui"],
}
OTHER = "other"
SPACE = r"[\x20\x09-\x0D]"
#: Classes of characters, each counted in what the ones before have left; the rest is the eighth.
CLASSES = ["[a-z]", SPACE, "[A-Z]", "[.,]", "[0-9]", "[#*$%&|<>]", r"[\x00-\x7F]"]
N_CLASSES = len(CLASSES) + 1
WINDOW = 5
T = "__rl_q_"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: guards: documents below these lengths are not judged by divergence
    min_chars_judged: int = 200
    min_words_judged: int = 50
    #: squared distance over what sampling explains
    max_char_excess: float = 0.08
    max_word_excess: float = 0.05
    #: squared distance within which a document counts for the reference, by round
    trim_char: tuple[float, float] = (0.0625, 0.0144)
    trim_word: tuple[float, float] = (0.09, 0.0625)

    def histograms(self, df: DataFrame) -> DataFrame:
        """Adds the language key, the words and both histograms, under names of its own."""
        left = df.withColumn(T + "l0", F.coalesce(F.col("text"), F.lit("")))
        for i, c in enumerate(CLASSES):
            left = left.withColumn(f"{T}l{i + 1}", F.regexp_replace(f"{T}l{i}", c + "+", ""))
        n = [F.length(f"{T}l{i}") for i in range(N_CLASSES)]
        chars = F.array(*[a - b for a, b in zip(n, n[1:])], n[-1])
        known = F.coalesce(F.col("lang"), F.lit(OTHER))
        listed = F.create_map(*[x for lang, ws in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, ws)))])
        out = left.withColumn(T + "chars", chars).withColumn(T + "lang", F.when(known.isin(list(COMMON_WORDS)), known).otherwise(OTHER))
        out = out.withColumn(T + "words", F.array_remove(F.split(T + "l0", SPACE + "+"), ""))
        out = out.drop(*[f"{T}l{i + 1}" for i in range(len(CLASSES))])
        out = out.withColumn(T + "listed", F.coalesce(listed[F.col(T + "lang")], F.array().cast("array<string>")))
        out = out.withColumn(T + "common", F.expr(f"filter({T}words, w -> array_contains({T}listed, w))"))
        counts = F.expr(f"transform({T}listed, s -> size(filter({T}common, w -> w = s)))")
        rest = F.array(F.size(T + "words") - F.size(T + "common"))
        return out.withColumn(T + "bins", F.concat(counts, rest)).drop(T + "common", T + "listed")

    def references(self, stored: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
        """Language key to its reference of characters and of words, as shares. A row a language reaches the driver.

        `stored` is a written table of histograms: language key, both histograms, n_words.
        """
        stored = stored.filter(F.col(T + "n_words") >= self.min_words_judged)
        refs: dict = {}
        for k in range(3):
            near = stored
            if k:
                near = stored.filter((distance2(T + "chars", T + "lang", refs, 0) < self.trim_char[k - 1]) & (F.coalesce(distance2(T + "bins", T + "lang", refs, 1), F.lit(0.0)) < self.trim_word[k - 1]))
            sums = [F.sum(F.get(T + "chars", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
            width = max(map(len, COMMON_WORDS.values())) + 1
            sums += [F.sum(F.get(T + "bins", F.lit(i))).alias(f"w{i}") for i in range(width)]
            found = {}
            for r in near.groupBy(T + "lang").agg(*sums).collect():
                bins = len(COMMON_WORDS.get(r[0], ())) + 1
                c, w = [r[f"c{i}"] for i in range(N_CLASSES)], [r[f"w{i}"] for i in range(bins)]
                found[r[0]] = ([x / sum(c) for x in c], [x / sum(w) for x in w])
            refs = refs | found
        return refs

    def measures(self, df: DataFrame) -> DataFrame:
        """Adds both histograms and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, under T."""
        out = self.histograms(df)
        words, chars = F.col(T + "words"), F.col(T + "chars")
        out = out.withColumn(T + "n_words", F.size(words).cast("long")).withColumn(T + "word_chars", (F.length(T + "l0") - F.get(chars, F.lit(1))).cast("long")).withColumn(T + "n_symbols", F.get(chars, F.lit(5)).cast("long"))
        out = out.withColumn(T + "lines", F.expr(f"filter(split({T}l0, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
        out = out.withColumn(T + "n_dup_lines", (F.size(T + "lines") - F.size(F.array_distinct(T + "lines"))).cast("long")).drop(T + "lines", T + "l0")
        out = out.withColumn(T + "h", F.expr(f"transform({T}words, w -> xxhash64(w))")).drop(T + "words")
        h = f"{T}h"
        at = ", ".join(f"{h}[i + {k}]" for k in range(WINDOW))
        out = out.withColumn(T + "w", F.expr(f"if(size({h}) < {WINDOW}, array(), transform(sequence(0, size({h}) - {WINDOW}), i -> xxhash64({at})))")).drop(h)
        # windows by hash and place: equal neighbours are repeats; only texts that have some are sorted
        out = out.withColumn(T + "s", F.expr(f"if(size(array_distinct({T}w)) < size({T}w), sort_array(transform({T}w, (x, i) -> struct(x AS x, i AS i))), array())")).drop(T + "w")
        s = f"{T}s"
        out = out.withColumn(T + "p", F.expr(f"sort_array(transform(filter({s}, (e, i) -> (i > 0 and get({s}, i - 1).x = e.x) or coalesce(get({s}, i + 1).x = e.x, false)), e -> e.i))")).drop(s)
        p = f"{T}p"
        out = out.withColumn(T + "n_repeat_words", F.expr(f"cast(aggregate(transform({p}, (x, i) -> least({WINDOW}, coalesce(get({p}, i + 1), x + {WINDOW}) - x)), 0, (a, b) -> a + b) as long)")).drop(p)
        return out

    def verdict(self, df: DataFrame, refs: dict) -> DataFrame:
        """Adds the excesses over the references, base_failed and kept, under T, to a table of measures."""
        out, n = df, F.col(T + "n_words")
        total = F.expr(f"aggregate({T}chars, 0, (a, b) -> a + b)")
        out = out.withColumn(T + "char_excess", F.round(distance2(T + "chars", T + "lang", refs, 0) - (N_CLASSES - 1) / (8 * math.log(2)) / F.greatest(total, F.lit(1)), 6))
        out = out.withColumn(T + "word_excess", F.round(distance2(T + "bins", T + "lang", refs, 1) - (F.size(T + "bins") - 1) / (8 * math.log(2)) / F.greatest(n, F.lit(1)), 6))
        failed = (n < self.min_words) | (100 * F.col(T + "n_repeat_words") > self.max_repeat_percent * n)
        strange = (total >= self.min_chars_judged) & (F.col(T + "char_excess") > self.max_char_excess)
        foreign = (n >= self.min_words_judged) & (F.col(T + "word_excess") > self.max_word_excess)
        return out.withColumn(T + "base_failed", failed).withColumn(T + "kept", ~failed & ~F.coalesce(strange, F.lit(False)) & ~F.coalesce(foreign, F.lit(False)))

    def score(self, documents: DataFrame) -> DataFrame:
        """One row a document: its measures and verdict. The texts are read once; what is stored is a few numbers a document."""
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        own = self.measures(documents.select("doc_id", "text", "lang"))
        stored = materialize(own.select("doc_id", *[F.col(T + x) for x in ("lang", "chars", "bins", *names)]), "measures")
        judged = self.verdict(stored, self.references(stored))
        return judged.select("doc_id", *[F.col(T + x).alias(x) for x in (*names, "char_excess", "word_excess", "base_failed", "kept")])

    def keep(self, documents: DataFrame) -> DataFrame:
        """The documents that are kept, with all their columns: read once for the references and once to be judged."""
        own = self.histograms(documents.select("text", "lang")).withColumn(T + "n_words", F.size(T + "words"))
        stored = materialize(own.select(*[F.col(T + x) for x in ("lang", "chars", "bins", "n_words")]), "histograms")
        judged = self.verdict(self.measures(documents), self.references(stored))
        # the row number keeps the optimizer from copying the measures' expressions into a filter at the scan
        judged = judged.withColumn(T + "row", F.monotonically_increasing_id())
        return judged.filter(F.col(T + "kept") & (F.col(T + "row") >= 0)).select(*[F.col(f"`{c}`") for c in documents.columns])


def distance2(bins: str, lang: str, refs: dict, which: int) -> Column:
    """Squared Jensen-Shannon distance (base 2) of a histogram to its language's reference; null without one."""
    usable = {k: v[which] for k, v in refs.items() if len(v[which]) > 1}
    if not usable:
        return F.lit(None).cast("double")
    ref = F.create_map(*[x for k, v in sorted(usable.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col(lang)]
    total = F.greatest(F.aggregate(F.col(bins), F.lit(0).cast("double"), lambda a, b: a + b), F.lit(1.0))

    def term(pair: Column) -> Column:
        p, m = pair["p"], pair["m"]
        a = (p + m) / 2
        return F.when(p > 0, p * F.log2(p / a)).otherwise(0.0) + F.when(m > 0, m * F.log2(m / a)).otherwise(0.0)

    pairs = F.zip_with(F.col(bins), ref, lambda c, m: F.struct((c / total).alias("p"), F.coalesce(m, F.lit(0.0)).alias("m")))
    return F.when(ref.isNotNull(), F.greatest(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + term(x)) / 2, F.lit(0.0)))
