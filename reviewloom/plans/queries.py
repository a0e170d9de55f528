"""The registered queries over the driver's tables: operators of this engine, each beside the SQL that it equals.

Documents stand for comments, their source for the group that is searched for, their
language for its specialty, and labels for ratings (quality * 5) and classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, jsonrepair, labels, text
from ..operators import canonical, classify, columns, index, labeling, metrics, preprocess, profile, retrieval, stopwords
from ..operators.stage import stage
from ..sources import files
from ..workers import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; integers are returned as long on either side."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            df = f(lambda name: reviews(spark, sf_dir) if name == "reviews" else spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = ("WITH " + REVIEWS + sql) if sql.lstrip().startswith(",") else sql
        return f

    return register


REVIEWS = """r AS (SELECT d.doc_id, d.text, d.lang, d.source, CAST(l.quality * 5.0 AS DOUBLE) AS rate, CAST(CASE WHEN l.toxic = 1 THEN -1 WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN 0 END AS BIGINT) AS label
    FROM documents d LEFT JOIN labels l USING (doc_id))"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    label = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0)
    return d.join(m, "doc_id", "left").select("doc_id", "text", "lang", "source", (F.col("quality") * 5.0).alias("rate"), label.alias("label"))


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_tokens(x: str, least: int = 2) -> str:
    return f"list_filter(string_split({sql_collapse(x)}, ' '), lambda t: length(t) >= {least})"


def sql_elongation(cs: str) -> str:
    return f"array_to_string(list_filter({cs}, lambda c, i: NOT (i > 2 AND NOT regexp_matches(c, '\\s') AND c = {cs}[i - 1] AND c = {cs}[i - 2])), '')"


def sql_draw(seed: int, column: str) -> str:
    return f"md5('{seed}:' || {column})"


# ---------------------------------------------------------------- text


@query(f"""SELECT doc_id, {sql_collapse(sql_elongation('cs'))} AS text_clean, length({sql_collapse(sql_elongation('cs'))}) AS n_clean,
    {sql_collapse(sql_elongation('cs'))} <> text AS changed FROM (SELECT doc_id, text, string_split(regexp_replace(text, '[^0-9A-Za-z\\x{{0600}}-\\x{{06FF}}\\s]', ' ', 'g'), '') AS cs FROM documents)""")
def text_normalize(t):
    return t("documents").select("doc_id", F.col("text"), text.normalize(F.col("text")).alias("text_clean")).select("doc_id", "text_clean", F.length("text_clean").alias("n_clean"), (F.col("text_clean") != F.col("text")).alias("changed"))


@query(f"SELECT doc_id, {sql_elongation('cs')} AS text_short FROM (SELECT doc_id, string_split(text, '') AS cs FROM documents)")
def elongation(t):
    return t("documents").select("doc_id", text.elongation(F.col("text")).alias("text_short"))


@query(f"""SELECT doc_id, {sql_collapse("array_to_string(list_transform(cs, lambda c, i: CASE WHEN c = '.' AND NOT (i > 1 AND regexp_matches(cs[i - 1], '[0-9]')) AND NOT (i < len(cs) AND regexp_matches(cs[i + 1], '[0-9]')) THEN ' ' ELSE c END), '')")} AS text_clean
    FROM (SELECT doc_id, string_split(regexp_replace(e, '[،؛؟!٪«»\"]+', ' ', 'g'), '') AS cs FROM (SELECT doc_id, {sql_elongation('c0')} AS e FROM (SELECT doc_id, string_split(text, '') AS c0 FROM documents)))""")
def dot_clean(t):
    return t("documents").select("doc_id", text.pre_clean(F.col("text")).alias("text_clean"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '(?i)(https?://\\S+|www\\.\\S+)')) AS n_url, count(*) FILTER (regexp_matches(text, '(?i)\\b[\\w\\.-]+@[\\w\\.-]+\\.\\w+\\b')) AS n_email,
    count(*) FILTER (regexp_matches(text, '(\\+?98|0)?\\s*9\\d{9}\\b')) AS n_phone, count(*) FILTER (regexp_matches(text, '[A-Za-z]')) AS n_latin, count(*) FILTER (regexp_matches(text, '\\d')) AS n_digit,
    count(*) FILTER (regexp_matches(text, '[^\\x{0600}-\\x{06FF}0-9A-Za-z\\s]')) AS n_non_standard FROM documents""")
def pattern_coverage(t):
    return profile.coverage(t("documents"), F.col("text"))


@query("""SELECT lang, CAST(sum(length(text)) AS BIGINT) AS n_total, CAST(sum(length(text) - length(regexp_replace(text, '[\\x{0600}-\\x{06FF}]', '', 'g'))) AS BIGINT) AS n_persian, CAST(sum(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) AS BIGINT) AS n_latin,
    CAST(sum(length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) AS BIGINT) AS n_digit, CAST(sum(length(text) - length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}0-9A-Za-z\\s]', '', 'g'))) AS BIGINT) AS n_nonstd,
    CAST(sum(length(text) - length(replace(text, ' ', ''))) AS BIGINT) AS n_space FROM documents GROUP BY lang""")
def char_composition(t):
    stats = text.char_stats(F.col("text"))
    return t("documents").select("lang", *[v.alias(k) for k, v in stats.items()]).groupBy("lang").agg(*[F.sum(k).alias(k) for k in stats])


@query("""SELECT t.item_id, t.words AS n_words, t.key AS text_key, CASE WHEN length(p) > 80 THEN left(p, 80) || '…' ELSE p END AS preview FROM
    (SELECT item_id, len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS words, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS key, regexp_replace(text, '\\n', ' ', 'g') AS p FROM benchmark) t""")
def text_keys(t):
    return t("benchmark").select("item_id", text.word_count(F.col("text")).alias("n_words"), text.text_key(F.col("text")).alias("text_key"), text.preview(F.col("text")).alias("preview"))


@query("""SELECT token, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9._\\-]{1,}'))) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def latin_token_inventory(t):
    return profile.token_counts(t("documents"), text.latin_tokens(F.col("text")), 50)


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50")
def token_counts_weighted(t):
    return profile.weighted_token_counts(t("documents"), F.col("text"), 50)


STOP = ["the", "of", "de", "la", "der", "die", "was", "on"]
PAIRS = [("in", "the"), ("to", "a")]
ALLOW = ["and", "on"]
_starts = lambda i: "(list_contains(['in the', 'to a'], lower(ts[{0}]) || ' ' || lower(ts[{0} + 1])) AND NOT list_contains(['and', 'on'], lower(ts[{0}])))".format(i)
_drop = f"((list_contains([{', '.join(repr(s) for s in STOP)}], lower(t)) AND NOT list_contains(['and', 'on'], lower(t))) OR coalesce({_starts('i')}, false) OR (i > 1 AND coalesce({_starts('(i - 1)')}, false)))"
_TS = f"(SELECT doc_id, {sql_tokens('text')} AS ts FROM documents)"


@query(f"SELECT doc_id, array_to_string(list_filter(ts, lambda t, i: NOT {_drop}), ' ') AS kept, len(list_filter(ts, lambda t, i: {_drop})) AS n_removed FROM {_TS}")
def stopword_filter_greedy(t):
    kept, removed = text.greedy_stop_filter(F.col("ts"), STOP, PAIRS, ALLOW)
    return t("documents").select("doc_id", text.tokens(F.col("text")).alias("ts")).select("doc_id", F.array_join(kept, " ").alias("kept"), F.size(removed).alias("n_removed"))


@query(f"""SELECT doc_id, array_to_string(u[1:30], ' | ') AS removed_sample FROM (SELECT doc_id, list_filter(x, lambda t, i: list_position(x, t) = i) AS u FROM (SELECT doc_id, list_filter(ts, lambda t, i: {_drop}) AS x FROM {_TS}))""")
def removed_token_sample(t):
    _, removed = text.greedy_stop_filter(F.col("ts"), STOP, PAIRS, ALLOW)
    return t("documents").select("doc_id", text.tokens(F.col("text")).alias("ts")).select("doc_id", text.removed_sample(removed).alias("removed_sample"))


_CLEAN = sql_collapse(sql_elongation("cs"))
_SW = ", ".join(repr(w) for w in STOP)


@query(f"""WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '[^0-9A-Za-z\\x{{0600}}-\\x{{06FF}}\\s]', ' ', 'g'), '') AS cs FROM documents), k AS (SELECT doc_id, list_filter(string_split({_CLEAN}, ' '), lambda t: length(t) >= 2) AS ta FROM c),
    n AS (SELECT doc_id, ta, list_filter(ta, lambda t: NOT list_contains([{_SW}], t)) AS tn FROM k)
    SELECT doc_id, len(ta) AS tok_all_count, len(tn) AS tok_nostop_count, len(tn) = 0 AS empty_tok_nostop, CASE WHEN len(ta) > 0 THEN round((len(ta) - len(tn)) / len(ta), 6) END AS removed_ratio, md5(array_to_string(CASE WHEN len(tn) = 0 THEN ta ELSE tn END, ' ')) AS tfidf_md5 FROM n""")
def preprocess_tokens(t):
    out = preprocess.tokenized(preprocess.steps(t("documents").select("doc_id", "text")), STOP)
    return out.select("doc_id", "tok_all_count", "tok_nostop_count", "empty_tok_nostop", F.round("stopword_removed_ratio", 6).alias("removed_ratio"), F.md5("text_for_tfidf").alias("tfidf_md5"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 20) UNION SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20) UNION SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 20)")
def length_samples(t):
    return columns.length_samples(t("documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id", 20).select("doc_id")


# ---------------------------------------------------------------- profiles


@query("SELECT count(text) AS n, round(min(length(text)), 6) AS min, round(avg(length(text)), 6) AS mean, round(max(length(text)), 6) AS max, round(quantile_cont(length(text), 0.1), 6) AS p10, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.9), 6) AS p90 FROM documents".replace("round(min(length(text)), 6)", "CAST(min(length(text)) AS DOUBLE)").replace("round(max(length(text)), 6)", "CAST(max(length(text)) AS DOUBLE)"))
def length_describe(t):
    return profile.describe(t("documents"), F.length(F.col("text")))


@query("""SELECT source, count(*) AS n, CAST(min(n_chars) AS DOUBLE) AS min, round(avg(n_chars), 6) AS mean, CAST(max(n_chars) AS DOUBLE) AS max, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90,
    round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY source""")
def quantile_lengths_by_group(t):
    return profile.describe(t("documents"), F.col("n_chars"), "source", points=(0.5, 0.9, 0.95, 0.99))


@query(f"""SELECT source, count(*) FILTER (n > 64) AS over_64, count(*) FILTER (n > 128) AS over_128, count(*) FILTER (n > 256) AS over_256, count(*) FILTER (n > 384) AS over_384, count(*) FILTER (n > 512) AS over_512
    FROM (SELECT source, len({sql_tokens('text')}) AS n FROM documents) GROUP BY source""")
def token_length_limits(t):
    return profile.over_limits(t("documents"), F.size(text.tokens(F.col("text"))), (64, 128, 256, 384, 512), "source")


@query(""", m AS (SELECT * FROM r) SELECT 'text' AS column_name, count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (text = '') AS n_empty FROM m UNION ALL SELECT 'rate', count(*) FILTER (rate IS NULL), count(*) FILTER (CAST(rate AS VARCHAR) = '') FROM m
    UNION ALL SELECT 'label', count(*) FILTER (label IS NULL), 0 FROM m UNION ALL SELECT 'source', count(*) FILTER (source IS NULL), count(*) FILTER (source = '') FROM m""")
def missingness(t):
    return profile.missingness(t("reviews"), "text", "rate", "label", "source")


@query(", x AS (SELECT 1) SELECT label, rate, count(*) AS n FROM r GROUP BY label, rate")
def label_rate_crosstab(t):
    return t("reviews").groupBy("label", "rate").agg(F.count("*").alias("n"))


@query(", x AS (SELECT 1) SELECT source, count(*) FILTER (label = -1) AS n_negative, count(*) FILTER (label = 0) AS n_neutral, count(*) FILTER (label = 1) AS n_positive FROM r GROUP BY source")
def label_pivot(t):
    out = t("reviews").groupBy("source").pivot("label", [-1, 0, 1]).agg(F.count(F.lit(1)))
    return out.na.fill(0).toDF("source", "n_negative", "n_neutral", "n_positive")


@query("SELECT source, lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source, lang")
def source_shares(t):
    return profile.value_counts(t("documents"), "source", "lang", share=True)


@query("SELECT round(max(n) / min(n), 6) AS imbalance FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def language_imbalance(t):
    return profile.imbalance(profile.value_counts(t("documents"), "lang"))


@query(f"SELECT {sql_collapse('text')} AS text_key, count(*) AS n, count(DISTINCT source) AS n_groups FROM documents GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, text_key LIMIT 20")
def top_repeated_texts(t):
    return profile.repeated_texts(t("documents"), F.col("text"), "source").orderBy(F.desc("n"), "text_key").limit(20)


@query(f"SELECT md5({sql_collapse('text')}) AS text_md5, count(*) AS n, count(DISTINCT source) AS n_groups FROM documents GROUP BY {sql_collapse('text')} HAVING count(DISTINCT source) >= 2")
def cross_group_repeats(t):
    return profile.repeated_texts(t("documents"), F.col("text"), "source").filter("n_groups >= 2").select(F.md5("text_key").alias("text_md5"), "n", "n_groups")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) - count(*) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def duplicate_row_count(t):
    return profile.duplicate_rows(t("documents"), F.col("text"))


@query("SELECT strftime(ts, '%Y') AS year, count(*) AS n FROM events GROUP BY 1")
def year_histogram(t):
    return t("events").groupBy(text.year_of(F.date_format("ts", "yyyy/MM/dd")).alias("year")).agg(F.count("*").alias("n"))


@query(""", e(bin_no, bin) AS (VALUES (CAST(0 AS BIGINT), 'eq_0'), (1, '(0,1]'), (2, '(1,2]'), (3, '(2,3]'), (4, '(3,4]'), (5, '(4,5]')), h AS (SELECT CASE WHEN rate = 0 THEN 'eq_0' WHEN rate <= 1 THEN '(0,1]' WHEN rate <= 2 THEN '(1,2]' WHEN rate <= 3 THEN '(2,3]' WHEN rate <= 4 THEN '(3,4]' WHEN rate <= 5 THEN '(4,5]' END AS bin, count(*) AS n FROM r GROUP BY 1)
    SELECT bin_no, bin, coalesce(n, 0) AS n FROM e LEFT JOIN h USING (bin)""")
def rate_bins(t):
    return profile.bins(t("reviews"), F.col("rate"))


@query(""", x AS (SELECT source, count(*) AS n, count(rate) AS n_rated, round(avg(rate), 6) AS mean_rate, round(median(length(text)), 6) AS median_chars, count(*) FILTER (label = -1) AS n_negative FROM r GROUP BY source) SELECT * FROM x""")
def comments_per_group(t):
    return t("reviews").groupBy("source").agg(F.count("*").alias("n"), F.count("rate").alias("n_rated"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.median(F.length("text")), 6).alias("median_chars"), F.count_if(F.col("label") == -1).alias("n_negative"))


# ---------------------------------------------------------------- canonical tables


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def canonical_best_row(t):
    return canonical.best_row(t("orders"), "o_custkey", F.desc_nulls_last("o_totalprice"), F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(t):
    e = t("events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")


@query(f"""SELECT doc_id, group_size, rank_in_group FROM (SELECT doc_id, count(*) OVER (PARTITION BY {sql_collapse('text')}) AS group_size, row_number() OVER (PARTITION BY {sql_collapse('text')} ORDER BY doc_id) AS rank_in_group FROM documents) WHERE group_size >= 2""")
def duplicate_groups(t):
    d = t("documents").withColumn("k", text.text_key(F.col("text")))
    return canonical.duplicate_groups(d, "k", F.asc("doc_id")).select("doc_id", "group_size", "rank_in_group")


@query("SELECT lang, string_agg(DISTINCT source, ' | ' ORDER BY source) AS all_members, count(DISTINCT source) AS n_members FROM documents GROUP BY lang")
def group_members(t):
    return canonical.members(t("documents"), "lang", "source")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def orphans_anti(t):
    return canonical.without_partner(t("customer"), t("orders").filter("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("""WITH b AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1)
    SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM b) GROUP BY l_returnflag""")
def semi_chosen(t):
    best = canonical.best_row(t("orders"), "o_custkey", F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")).select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").join(best, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"SELECT doc_id, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {sql_collapse('text')} ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def dup_text_dedup_longest(t):
    return canonical.keep_longest(t("documents"), text.text_key(F.col("text")), "text", "doc_id").select("doc_id", F.length("text").alias("n_chars"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN n_name WHEN c_nationkey % 3 = 1 THEN c_mktsegment ELSE coalesce(n_name, 'UNKNOWN') END AS place FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_fill(t):
    c = t("customer").withColumn("place", F.when(F.col("c_nationkey") % 3 == 1, F.col("c_mktsegment")).otherwise("")).withColumnRenamed("c_nationkey", "n_nationkey")
    return canonical.lookup(c, t("nation").select("n_nationkey", F.col("n_name").alias("place")), "n_nationkey", "place", "UNKNOWN").select("c_custkey", "place")


@query("""SELECT source, md5(d) AS doc_md5, n AS comments_used, length(d) AS doc_char_len, len(list_filter(string_split(d, ' '), lambda x: x <> '')) AS doc_token_len_est
    FROM (SELECT source, count(*) AS n, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY doc_id) AS d FROM documents GROUP BY source)""")
def group_documents(t):
    return canonical.document_digests(t("documents"), "source", "doc_id", text.collapse(F.col("text")))


@query("SELECT conv_id, d AS document, n AS comments_used, length(d) AS doc_char_len, len(list_filter(string_split(d, ' '), lambda x: x <> '')) AS doc_token_len_est FROM (SELECT conv_id, count(*) AS n, string_agg(text, ' ' ORDER BY turn, text) AS d FROM conversations GROUP BY conv_id)")
def conversation_documents(t):
    return canonical.group_documents(t("conversations"), "conv_id", "turn", F.col("text"))


@query("WITH w AS (SELECT DISTINCT c_custkey AS k FROM customer), g AS (SELECT DISTINCT o_custkey + 10 AS k FROM orders) SELECT count(w.k) AS n_wanted, count(g.k) AS n_got, count(*) FILTER (w.k IS NOT NULL AND g.k IS NULL) AS n_missing, count(*) FILTER (w.k IS NULL) AS n_extra FROM w FULL JOIN g ON w.k = g.k")
def key_check(t):
    return metrics.key_check(t("customer").select(F.col("c_custkey").alias("k")), t("orders").select((F.col("o_custkey") + 10).alias("k")), "k")


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def still_to_do(t):
    log = t("labels").select(F.col("doc_id").cast("string").alias("item_id"), F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"), F.col("toxic").cast("int").alias("label_llm"))
    return files.still_to_do(t("benchmark").select(F.col("item_id").cast("string").alias("item_id")), log).select(F.col("item_id").cast("long").alias("item_id"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def name_page(t):
    return t("customer").orderBy("c_name", "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


# ---------------------------------------------------------------- index and retrieval

CONFIG = index.IndexConfig()


def _tf(t, rows=None):
    return index.row_terms((rows if rows is not None else t("documents")), "source", "doc_id", text.tokens(F.lower(F.col("text"))))


def _index(t, rows=None, config=CONFIG):
    source = rows if rows is not None else t("documents")
    # the documents' number, those without terms too
    return index.fit(stage(_tf(t, rows)), config, source.agg(F.count_distinct("source").alias("n")))


def sql_index(rows: str = "documents", config: index.IndexConfig = CONFIG) -> str:
    """CTEs tf, terms and post for the rows of a relation."""
    w = "(1 + ln(tf))" if config.sublinear else "tf"
    return f"""
    seq AS (SELECT source AS doc, doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i FROM (SELECT source, doc_id, {sql_tokens('lower(text)')} AS ts FROM {rows})),
    nxt AS (SELECT doc, tok, lead(tok) OVER (PARTITION BY doc ORDER BY doc_id, i) AS nx FROM seq),
    tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, tok AS term FROM nxt UNION ALL SELECT doc, tok || ' ' || nx FROM nxt WHERE nx IS NOT NULL) GROUP BY doc, term),
    nd AS (SELECT count(DISTINCT source) AS n FROM {rows}),
    terms AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, nd GROUP BY term HAVING count(*) >= {config.min_df} AND count(*) <= {config.max_df} * any_value(n) ORDER BY ctf DESC, term LIMIT {config.max_features}),
    post0 AS (SELECT doc, term, tf, {w} * idf AS w0 FROM tf JOIN terms USING (term)),
    post AS (SELECT doc, term, tf, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc)) AS w FROM post0)"""


@query(f"WITH {sql_index()} SELECT doc, term, tf, w, rank FROM (SELECT doc, term, tf, round(w, 6) AS w, row_number() OVER (PARTITION BY doc ORDER BY round(w, 6) DESC, term) AS rank FROM post) WHERE rank <= 15")
def tfidf_top_terms(t):
    return index.top_terms(_index(t)[0], CONFIG.kept_terms)


@query(f"WITH {sql_index()} SELECT term, df, ctf, round(idf, 6) AS idf FROM terms ORDER BY ctf DESC, term LIMIT 200")
def term_df_idf(t):
    return _index(t)[1].orderBy(F.desc("ctf"), "term").limit(200).select("term", "df", "ctf", F.round("idf", 6).alias("idf"))


@query(f"""WITH {sql_index()} SELECT doc, string_agg(term, ', ' ORDER BY rank) AS top_terms FROM (SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY round(w, 6) DESC, term) AS rank FROM post) WHERE rank <= 10 GROUP BY doc""")
def group_keywords(t):
    return index.keywords(_index(t)[0], 10).select("doc", "top_terms")


@query(f"WITH {sql_index()} SELECT doc, round(sum(w), 6) AS mass FROM post GROUP BY doc ORDER BY mass DESC, doc LIMIT 10")
def doc_mass_topn(t):
    return retrieval.heaviest_documents(_index(t)[0], 10)


@query(f"""WITH {sql_index()}, b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY w DESC, term) AS rank FROM (SELECT doc, term, round(w, 6) AS w FROM post WHERE doc IN ('src0', 'src1'))),
    t2 AS (SELECT * FROM b WHERE rank <= 20) SELECT term, coalesce(max(w) FILTER (doc = 'src0'), 0) AS w_a, coalesce(max(w) FILTER (doc = 'src1'), 0) AS w_b, max(w) AS w_max FROM t2 GROUP BY term""")
def compare_docs(t):
    return retrieval.compare_documents(_index(t)[0], "src0", "src1", 20)


@query(f"WITH {sql_index()}, s AS (SELECT term FROM terms WHERE contains(term, 'tion') ORDER BY df DESC, term LIMIT 8) SELECT term, round(idf, 6) AS idf, doc, w, rank FROM (SELECT term, doc, round(w, 6) AS w, row_number() OVER (PARTITION BY term ORDER BY round(w, 6) DESC, doc) AS rank FROM post WHERE term IN (SELECT term FROM s)) JOIN terms USING (term) WHERE rank <= 3")
def term_search(t):
    from pyspark.sql import Window

    postings, terms = _index(t)
    found = retrieval.suggest_terms(terms, "tion", 8).select("term", F.round("idf", 6).alias("idf"))
    best = Window.partitionBy("term").orderBy(F.desc("w"), "doc")
    hits = postings.join(F.broadcast(found), "term").withColumn("w", F.round("w", 6)).withColumn("rank", F.row_number().over(best))
    return hits.filter("rank <= 3").select("term", "idf", "doc", "w", "rank")


def sql_queries(source: str, name: str = "item_id") -> str:
    """CTEs qtf, qv for a relation of texts, after sql_index()."""
    return f"""
    qs AS (SELECT {name} AS query, {sql_tokens('lower(text)')} AS ts FROM {source}),
    qtok AS (SELECT query, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i FROM qs),
    qn AS (SELECT query, tok, lead(tok) OVER (PARTITION BY query ORDER BY i) AS nx FROM qtok),
    qtf AS (SELECT query, term, count(*) AS tf FROM (SELECT query, tok AS term FROM qn UNION ALL SELECT query, tok || ' ' || nx FROM qn WHERE nx IS NOT NULL) GROUP BY query, term),
    qv0 AS (SELECT query, term, (1 + ln(tf)) * idf AS w0 FROM qtf JOIN terms USING (term)),
    qv AS (SELECT query, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY query)) AS qw FROM qv0),
    sims AS (SELECT query, doc, round(sum(qw * w), 6) AS sim FROM qv JOIN post USING (term) GROUP BY query, doc)"""


@query(f"""WITH {sql_index()}, {sql_queries('benchmark')}, k AS (SELECT query, count(*) AS n_terms, count(terms.term) AS nnz, round(1 - count(terms.term) / count(*), 6) AS oov_ratio FROM qtf LEFT JOIN terms USING (term) GROUP BY query),
    b AS (SELECT query, max(sim) AS top1_sim FROM sims GROUP BY query), x AS (SELECT 'set' || item_id % 3 AS query_set, coalesce(nnz, 0) AS nnz, coalesce(oov_ratio, 0) AS oov_ratio, top1_sim, trim(text) = '' AS is_empty FROM benchmark LEFT JOIN k ON k.query = item_id LEFT JOIN b ON b.query = item_id)
    SELECT query_set, count(*) AS n_queries, count(*) FILTER (is_empty) AS n_empty, count(*) FILTER (nnz = 0) AS n_nnz0, count(*) FILTER (coalesce(top1_sim, 0) = 0) AS n_top1_sim0, round(avg(oov_ratio), 6) AS mean_oov_ratio FROM x GROUP BY ROLLUP (query_set)""")
def oov_report(t):
    postings, terms = _index(t)
    q = t("benchmark")
    qterms = retrieval.query_terms(q, "item_id", text.tokens(F.lower(F.col("text"))))
    known = retrieval.vocabulary_report(qterms, terms)
    best = retrieval.similarities(retrieval.query_vectors(qterms, terms), postings).groupBy("query").agg(F.max("sim").alias("top1_sim"))
    all_ = q.select(F.col("item_id").alias("query"), F.concat(F.lit("set"), (F.col("item_id") % 3).cast("string")).alias("query_set"), text.is_blank(F.col("text")).alias("is_empty"))
    return retrieval.suite_report(all_.join(known, "query", "left").join(best, "query", "left").na.fill(0, ["nnz"]).na.fill(0.0, ["oov_ratio"]))


_TOP = f"WITH {sql_index()}, {sql_queries('benchmark')}, top AS (SELECT query, doc, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc) AS rank FROM sims) WHERE rank <= 5)"


@query(f"{_TOP} SELECT * FROM top")
def retrieve_topk(t):
    postings, terms = _index(t)
    return retrieval.search(t("benchmark"), "item_id", text.tokens(F.lower(F.col("text"))), postings, terms, 5)


@query(f"""{_TOP}, post_b0 AS (SELECT doc, term, tf * idf AS w0 FROM tf JOIN terms USING (term) WHERE NOT contains(term, ' ')), post_b AS (SELECT doc, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc)) AS w FROM post_b0),
    qv_b0 AS (SELECT query, term, tf * idf AS w0 FROM qtf JOIN terms USING (term) WHERE NOT contains(term, ' ')), qv_b AS (SELECT query, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY query)) AS qw FROM qv_b0),
    alt AS (SELECT query, doc FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc) AS rank FROM (SELECT query, doc, round(sum(qw * w), 6) AS sim FROM qv_b JOIN post_b USING (term) GROUP BY query, doc)) WHERE rank <= 5)
    SELECT query, count(*) FILTER (top.doc IS NOT NULL AND alt.doc IS NOT NULL) AS n_both, count(*) FILTER (alt.doc IS NULL) AS n_only_a, count(*) FILTER (top.doc IS NULL) AS n_only_b FROM top FULL JOIN alt USING (query, doc) GROUP BY query""")
def variant_overlap(t):
    """The index with pairs of words and logarithmic counts, against one of single words and plain counts with the same vocabulary."""
    tf, source = stage(_tf(t)), t("documents")
    n = source.agg(F.count_distinct("source").alias("n"))
    postings, terms = index.fit(tf, CONFIG, n)
    single = terms.filter(~F.contains("term", F.lit(" ")))
    plain = index.weigh(tf, single, sublinear=False)
    qterms = retrieval.query_terms(t("benchmark"), "item_id", text.tokens(F.lower(F.col("text"))))
    found = lambda terms, postings, sublinear: retrieval.top_k(retrieval.similarities(retrieval.query_vectors(qterms, terms, sublinear), postings), 5)
    return retrieval.variant_overlap(found(terms, postings, True), found(single, plain, False))


@query(f"""{_TOP.replace('WITH ', 'WITH ' + REVIEWS + ', ', 1)}, ev AS (SELECT top.query, top.doc, count(*) AS q_support, count(*) FILTER (coalesce(rate >= 4, false)) AS q_recommend FROM top JOIN (SELECT query, list(DISTINCT term) AS ts FROM qtf GROUP BY query) q ON q.query = top.query
    JOIN r ON r.source = top.doc WHERE len(list_filter(ts, lambda x: contains(' ' || text || ' ', ' ' || x || ' '))) > 0 GROUP BY top.query, top.doc),
    s AS (SELECT query, doc, sim, coalesce(q_support, 0) AS n, coalesce(q_recommend, 0) AS k FROM top LEFT JOIN ev USING (query, doc)),
    f AS (SELECT query, doc, sim, n AS q_support, k AS q_recommend, CASE WHEN n > 0 THEN round(100 * k / n, 6) ELSE 0.0 END AS q_recommend_pct, round((k + 1) / (n + 2), 6) AS q_recommend_smooth, round(sim * (k + 1) / (n + 2) * ln(1 + n), 6) AS final_score FROM s)
    , ov AS (SELECT source AS doc, count(*) AS overall_support, round(100 * count(*) FILTER (coalesce(rate >= 4, false)) / count(*), 6) AS overall_recommend_pct FROM r GROUP BY source)
    SELECT f.*, overall_support, overall_recommend_pct, row_number() OVER (PARTITION BY query ORDER BY final_score DESC, sim DESC, q_support DESC, f.doc) AS rank FROM f JOIN ov ON ov.doc = f.doc""")
def rerank_topk(t):
    postings, terms = _index(t)
    qterms = retrieval.query_terms(t("benchmark"), "item_id", text.tokens(F.lower(F.col("text"))))
    best = retrieval.top_k(retrieval.similarities(retrieval.query_vectors(qterms, terms), postings), 5)
    found = retrieval.evidence(best, qterms, t("reviews"), "source", "doc_id", F.col("text"), F.col("rate"))
    return retrieval.rerank(best, found).join(retrieval.overall(t("reviews"), "source", F.col("rate")), "doc")


_HOLD = """hs AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents),
    hp AS (SELECT *, CASE WHEN n < 5 THEN 'train' WHEN rn > greatest(1, least(CAST(round_even(n * 0.2, 0) AS BIGINT), n - 1)) THEN 'train' WHEN rn <= 50 THEN 'test' ELSE 'unused' END AS part FROM hs),
    tr AS (SELECT * FROM hp WHERE part = 'train'), te AS (SELECT * FROM hp WHERE part = 'test')"""
_RANKS = f"""WITH {_HOLD}, {sql_index('tr')}, {sql_queries('te', 'doc_id')}, truth AS (SELECT DISTINCT qv.query, te.source FROM qv JOIN te ON te.doc_id = qv.query),
    tsim AS (SELECT truth.query, source, coalesce(sim, 0) AS ts FROM truth LEFT JOIN sims ON sims.query = truth.query AND sims.doc = source),
    ranks AS (SELECT tsim.query, source, 1 + count(sims.doc) AS rank FROM tsim LEFT JOIN sims ON sims.query = tsim.query AND sim > ts GROUP BY tsim.query, source)"""
_RM = "count(*) AS n_queries, round(avg(CAST(rank <= 1 AS DOUBLE)), 6) AS recall_at_1, round(avg(CAST(rank <= 5 AS DOUBLE)), 6) AS recall_at_5, round(avg(CAST(rank <= 10 AS DOUBLE)), 6) AS recall_at_10, round(avg(CAST(rank <= 20 AS DOUBLE)), 6) AS recall_at_20, round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank"


def _ranks(t):
    parts = retrieval.holdout(t("documents"), "source", "doc_id")
    postings, terms = _index(t, parts.filter("part = 'train'"))
    test = parts.filter("part = 'test'")
    vectors = retrieval.query_vectors(retrieval.query_terms(test, "doc_id", text.tokens(F.lower(F.col("text")))), terms)
    truth = test.select(F.col("doc_id").alias("query"), F.col("source").alias("doc"))
    ranks = retrieval.true_ranks(retrieval.similarities(vectors, postings), truth, vectors.select("query").distinct())
    return ranks.join(truth.select("query", F.col("doc").alias("source")), "query")


@query(f"{_RANKS} SELECT {_RM} FROM ranks")
def holdout_metrics(t):
    return retrieval.rank_metrics(_ranks(t))


@query(f"{_RANKS} SELECT source, {_RM} FROM ranks GROUP BY source")
def holdout_by_group(t):
    return retrieval.rank_metrics(_ranks(t), "source")


# ---------------------------------------------------------------- stopwords

WATCH = ["the", "of", "and", "idiot", "de"]


@query(" UNION ALL ".join(f"SELECT '{w}' AS token, count(*) FILTER (list_contains(string_split({sql_collapse('text')}, ' '), '{w}')) AS n, round(count(*) FILTER (list_contains(string_split({sql_collapse('text')}, ' '), '{w}')) / count(*), 6) AS share FROM documents" for w in WATCH))
def df_audit(t):
    return stopwords.document_frequencies(t("documents"), F.col("text"), WATCH)


_AUTO = f"""WITH tk AS (SELECT source AS g, lang AS f, unnest({sql_tokens('lower(text)')}) AS token FROM documents), tk2 AS (SELECT * FROM tk WHERE token NOT IN ('and', 'on')),
    d AS (SELECT token, count(*) AS doc_freq, CAST(sum(c) AS BIGINT) AS corpus_tf FROM (SELECT token, g, count(*) AS c FROM tk2 GROUP BY token, g) GROUP BY token),
    e AS (SELECT token, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS h FROM (SELECT token, f, n / sum(n) OVER (PARTITION BY token) AS p FROM (SELECT token, f, count(DISTINCT g) AS n FROM tk2 GROUP BY token, f)) GROUP BY token),
    c AS (SELECT token, doc_freq, round(doc_freq / (SELECT count(DISTINCT source) FROM documents), 6) AS doc_ratio, corpus_tf, round(h, 6) AS entropy_norm FROM d JOIN e USING (token))"""


def _candidates(t):
    d = t("documents")
    toks = d.select(F.col("source").alias("group"), F.col("lang").alias("facet"), F.explode(text.tokens(F.lower(F.col("text")))).alias("token"))
    return stopwords.suggest(toks, d.agg(F.count_distinct("source").alias("n")), min_df=10, allow=ALLOW)


@query(f"{_AUTO} SELECT *, doc_freq >= 10 AND doc_ratio >= 0.6 AND entropy_norm >= 0.6 AS suggested FROM c WHERE doc_freq >= 10")
def auto_stopwords(t):
    return _candidates(t).filter("doc_freq >= 10")


@query(f"""{_AUTO}, m AS (SELECT DISTINCT token, CASE WHEN length(token) < 2 THEN 'too_short' WHEN token IN ('and', 'on') THEN 'latin_allowlist' WHEN token IN ('to', 'that') THEN 'high_risk_keep' END AS reason FROM c WHERE doc_freq >= 10 AND doc_ratio >= 0.6 AND entropy_norm >= 0.6)
    SELECT token, reason FROM m WHERE reason IS NOT NULL UNION ALL SELECT token, NULL FROM (SELECT token FROM m WHERE reason IS NULL UNION SELECT 'zzz')""")
def final_stopwords(t):
    final, out = stopwords.finalize(_candidates(t).filter("suggested"), ["zzz"], ALLOW, ["to", "that"])
    return out.select("token", "reason").unionByName(final.withColumn("reason", F.lit(None).cast("string")))


# ---------------------------------------------------------------- labels, pools and splits

NEGATIVE = [("insult", r"(idiot|moron|stupid)", 2.6), ("contempt", r"(trash|scum|worthless|pathetic)", 1.8), ("mild", r"(loser|clown)", 1.4), ("noise", r"(\*\*\*|%%%)", 1.2)]
POSITIVE = [("article", r"\bthe the\b", 1.3), ("strong", r"(entire|ention)", 1.6), ("kind", r"\bwith\b.*\bfor\b", 1.0), ("licence", r"License", 2.5)]
CUES = {"service": r"(mail|token)", "service_strong": r"(token|555)", "info": r"GNU", "early": r"rights reserved", "self_harm": r"disgusting", "improved": r"(better|entat)", "complaint": r"(idiot|trash)"}
POOL = labeling.PoolRules(tuple(NEGATIVE), tuple(POSITIVE), CUES["service"], r"(bad|moron|555)")
WEAK = labels.WeakRules(tuple(NEGATIVE), tuple(POSITIVE), tuple(CUES.items()), ("contempt",))


def sql_hits(patterns, t: str = "text") -> tuple[str, str]:
    s = " + ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN {w} ELSE 0.0 END" for _, p, w in patterns)
    h = ", ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN '{n}' END" for n, p, _ in patterns)
    return f"CAST({s} AS DOUBLE)", f"concat_ws('|', {h})"


_NEG, _POS = sql_hits(NEGATIVE), sql_hits(POSITIVE)
_SCORED = f""", sc AS (SELECT doc_id, source, lang, rate, label, text, {_NEG[0]} AS neg_score_kw, {_NEG[1]} AS neg_hits, {_POS[0]} AS pos_score_kw, {_POS[1]} AS pos_hits,
    CAST(CASE WHEN rate IS NULL THEN 0 WHEN rate <= 2 THEN 2.6 WHEN rate <= 3 THEN 1.6 WHEN rate <= 3.5 THEN 1.0 ELSE 0 END AS DOUBLE) AS neg_score_rate, CAST(CASE WHEN rate IS NULL THEN 0 WHEN rate >= 4.8 THEN 0.9 WHEN rate >= 4.5 THEN 0.6 ELSE 0 END AS DOUBLE) AS pos_score_rate,
    CAST(regexp_matches(text, '{POOL.service}') AS BIGINT) AS has_service_term, CAST(regexp_matches(text, '{POOL.service}') AND regexp_matches(text, '{POOL.mild_negative}') AS BIGINT) AS has_service_neg_cue FROM r),
    s AS (SELECT *, neg_score_kw + neg_score_rate AS neg_score, pos_score_kw + pos_score_rate AS pos_score FROM sc)"""
_BUCKETS = f"""{_SCORED}, b0 AS (SELECT *, CASE WHEN neg_score_kw >= 1.2 AND pos_score_kw >= 1.3 THEN 'mixed' WHEN neg_score >= 2.2 AND pos_score <= 1 THEN 'high_neg' WHEN has_service_term = 1 AND (has_service_neg_cue = 1 OR neg_score_rate >= 1) THEN 'service_neg'
    WHEN neg_score_rate >= 1 THEN 'rate_neg' WHEN neg_score_kw >= 1.2 AND neg_score < 2.2 THEN 'mid_neg' END AS b1, CASE WHEN pos_score >= 3 AND neg_score <= 1 THEN 'high_pos' END AS b2 FROM s),
    bk AS (SELECT *, CASE WHEN b1 IS NULL AND b2 IS NULL THEN ['random'] ELSE list_filter([b1, b2], lambda x: x IS NOT NULL) END AS bs FROM b0)"""


def _scored(t):
    return labeling.pool_scores(t("reviews"), F.col("text"), F.col("rate"), POOL)


@query(f"{_SCORED} SELECT doc_id, round(neg_score, 6) AS neg_score, neg_hits, round(pos_score, 6) AS pos_score, pos_hits, has_service_term, has_service_neg_cue FROM s")
def weak_scores(t):
    return _scored(t).select("doc_id", F.round("neg_score", 6).alias("neg_score"), "neg_hits", F.round("pos_score", 6).alias("pos_score"), "pos_hits", "has_service_term", "has_service_neg_cue")


@query(f"{_BUCKETS} SELECT bucket, count(*) AS n FROM (SELECT unnest(bs) AS bucket FROM bk) GROUP BY bucket")
def bucket_counts(t):
    return _scored(t).select(F.explode(labeling.buckets()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


_WEAK = f""", wt AS (SELECT doc_id, source, label, {sql_elongation('cs')} AS t FROM (SELECT *, string_split({sql_collapse('text')}, '') AS cs FROM r)), wf AS (SELECT doc_id, source, label, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w, {sql_hits(NEGATIVE, 't')[0]} AS neg, {sql_hits(POSITIVE, 't')[0]} AS pos,
    regexp_matches(t, '{CUES['service']}') AND regexp_matches(t, '{CUES['service_strong']}') AS svc, regexp_matches(t, '{CUES['info']}') AS info, regexp_matches(t, '{CUES['early']}') AS early, regexp_matches(t, '{CUES['self_harm']}') AS harm, regexp_matches(t, '{CUES['improved']}') AS impr, regexp_matches(t, '{CUES['complaint']}') AS compl,
    regexp_matches(t, '{NEGATIVE[1][1]}') AS money FROM wt)"""


def sql_weak(p: dict[str, str], col: str) -> str:
    """CASE of the cascade; col: 0 label, 1 confidence, 2 reason."""
    margin = "greatest(0.55, least(0.95, 0.62 + 0.10 * ({0})))"
    rules = [
        (f"neg = 0 AND pos = 0 AND (w <= {p['info_max_words']} OR info)", "0", "0.94", "informational"),
        (f"early AND NOT compl AND neg < {p['neg_th']} AND pos < {p['pos_th']}", "0", "0.90", "early_stage"),
        ("harm AND impr AND NOT compl", "1", "0.72", "state_improved_despite_selfharm"),
        ("pos >= 2.8 AND neg <= 1.2", "1", "least(0.95, 0.70 + 0.08 * (pos - neg))", "pos_strong"),
        ("svc AND pos > 0", "0", "0.85", "mixed_service"),
        ("money AND pos > 0", "0", "0.84", "mixed_money"),
        (f"neg > 0 AND pos > 0 AND abs(pos - neg) < {p['mixed_margin']}", "0", "0.72", "mixed"),
        (f"neg >= {p['neg_th']} AND neg - pos >= {p['neg_margin_th']}", "-1", margin.format("neg - pos"), "neg_kw"),
        ("svc AND pos <= 1.2", "-1", "0.80", "neg_service"),
        (f"pos >= {p['pos_th']} AND pos - neg >= {p['pos_margin_th']}", "1", margin.format("pos - neg"), "pos_kw"),
    ]
    at = {"label": 1, "confidence": 2, "reason": 3}[col]
    last = {"label": "0", "confidence": "0.45", "reason": "'default_neu'"}[col]
    value = lambda r: f"'{r[at]}'" if col == "reason" else r[at]
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {value(r)}" for r in rules) + f" ELSE {last} END"


_P = {k: str(v) for k, v in vars(labels.WeakParams()).items()}
_WL = f"{_WEAK}, wl AS (SELECT doc_id, source, label, {sql_weak(_P, 'label')} AS label_weak, round(CAST({sql_weak(_P, 'confidence')} AS DOUBLE), 6) AS weak_confidence, {sql_weak(_P, 'reason')} AS weak_reason FROM wf)"


def _weak(t, rows=None):
    d = (rows if rows is not None else t("reviews"))
    d = d.withColumns(labels.weak_features(F.col("text"), WEAK)).withColumn("wl", labels.weak_label())
    return d.withColumn("label_weak", F.col("wl.label")).withColumn("weak_confidence", F.round("wl.confidence", 6)).withColumn("weak_reason", F.col("wl.reason"))


@query(f"{_WL} SELECT doc_id, CAST(label_weak AS BIGINT) AS label_weak, weak_confidence, weak_reason FROM wl")
def weak_label_cascade(t):
    return _weak(t).select("doc_id", "label_weak", "weak_confidence", "weak_reason")


_FINAL = f"""{_WL}, wa AS (SELECT *, CASE WHEN label_weak = -1 AND weak_confidence >= 0.78 AND weak_reason IN ('neg_kw', 'neg_service') THEN -1 WHEN label_weak = 1 AND weak_confidence >= 0.70 AND weak_reason IN ('pos_kw', 'pos_strong') THEN 1
    WHEN label_weak = 0 AND weak_confidence >= 0.90 AND weak_reason IN ('informational', 'early_stage') THEN 0 WHEN label_weak = 0 AND weak_confidence >= 0.82 AND weak_reason IN ('mixed_money', 'mixed_service', 'mixed') THEN 0 END AS label_final FROM wl)"""


@query(f"{_FINAL} SELECT CAST(label_final AS BIGINT) AS label_final, weak_reason, count(*) AS n FROM wa GROUP BY ALL")
def weak_acceptance(t):
    return _weak(t).withColumn("label_final", labels.accepted_label()).groupBy("label_final", "weak_reason").agg(F.count("*").alias("n"))


_CELLS = f"{_WL}, g AS (SELECT unnest([-1, 0, 1]) AS y), cells AS (SELECT a.y AS y_true, b.y AS y_pred, count(wl.doc_id) AS n FROM g a CROSS JOIN g b LEFT JOIN wl ON wl.label = a.y AND wl.label_weak = b.y GROUP BY a.y, b.y)"


@query(f"{_CELLS} SELECT CAST(y_true AS BIGINT) AS y_true, CAST(y_pred AS BIGINT) AS y_pred, n FROM cells")
def confusion_matrix(t):
    return metrics.confusion(_weak(t).filter("label is not null"), "label", "label_weak")


@query(f"""{_CELLS}, pc AS (SELECT y, CAST(sum(n) FILTER (y_true = y) AS DOUBLE) AS support, CAST(sum(n) FILTER (y_true = y AND y_pred = y) AS DOUBLE) AS hit, CAST(sum(n) FILTER (y_pred = y) AS DOUBLE) AS called FROM g, cells GROUP BY y),
    pr AS (SELECT *, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS q FROM pc), f AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1 FROM pr)
    SELECT CAST(y AS VARCHAR) AS name, round(p, 6) AS precision, round(q, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(q), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(q * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(t):
    return metrics.report(metrics.confusion(_weak(t).filter("label is not null"), "label", "label_weak"))


_G = {"neg_th": "[1.6, 2.0, 2.4, 2.8]", "pos_th": "[1.6, 2.0, 2.4, 2.8]", "info_max_words": "[3, 4, 5]", "mixed_margin": "[0.8, 1.2, 1.6]", "neg_margin_th": "[0.6, 1.0, 1.4]", "pos_margin_th": "[0.6, 1.0, 1.4]"}


@query(f"""{_WEAK}, fd AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) - 1) % least(5, greatest(2, count(*) OVER () // 60)) AS fold FROM wf WHERE label IS NOT NULL),
    pg AS (SELECT row_number() OVER (ORDER BY {', '.join('p_' + k for k in _G)}) - 1 AS param_id, * FROM {', '.join(f'(SELECT CAST(unnest({v}) AS DOUBLE) AS p_{k})' for k, v in _G.items())}),
    j AS (SELECT param_id, fold, label, {sql_weak(_P | {k: 'p_' + k for k in _G}, 'label')} AS y FROM fd, pg),
    cl AS (SELECT param_id, fold, c, count(*) FILTER (label = c AND y = c) AS hit, count(*) FILTER (label = c) AS sup, count(*) FILTER (y = c) AS cal FROM j, (SELECT unnest([-1, 0, 1]) AS c) GROUP BY param_id, fold, c),
    m AS (SELECT param_id, fold, sum(CASE WHEN sup + cal > 0 THEN 2 * hit / (sup + cal) ELSE 0 END) / 3 AS f1 FROM cl GROUP BY param_id, fold)
    SELECT param_id, {', '.join(f'any_value(p_{k}) AS {k}' for k in _G)}, round(avg(f1), 6) AS macro_f1 FROM m JOIN pg USING (param_id) GROUP BY param_id""")
def weak_param_grid(t):
    """All 1,296 sets of thresholds."""
    gold = t("reviews").filter("label is not null").withColumns(labels.weak_features(F.col("text"), WEAK))
    return metrics.weak_grid(gold, "label", "doc_id")


@query(f"""WITH c AS (SELECT *, {sql_draw(7, 'doc_id')} AS k FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS r1 FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS r2 FROM a WHERE r1 <= 6)
    SELECT doc_id, source, lang FROM b WHERE r2 <= 30 ORDER BY k, doc_id LIMIT 60""")
def capped_sample(t):
    return labeling.capped_sample(t("documents"), 60, 7, "doc_id", "source", 6, "lang", 30).select("doc_id", "source", "lang")


@query(f"SELECT doc_id FROM documents ORDER BY {sql_draw(42, 'doc_id')}, doc_id LIMIT 100")
def seeded_sample(t):
    return labeling.sample(t("documents"), 100, 42, "doc_id").select("doc_id")


@query(f"""{_BUCKETS}, e AS (SELECT doc_id, b, p FROM bk, (VALUES ('high_neg', 0), ('service_neg', 1), ('rate_neg', 2), ('mid_neg', 3), ('mixed', 4), ('random', 5), ('high_pos', 6)) v(b, p) WHERE list_contains(bs, b)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rn FROM e) SELECT doc_id, b AS bucket FROM o WHERE rn = 1""")
def priority_union_pool(t):
    s = _scored(t).withColumn("bs", labeling.buckets())
    return labeling.priority_union([(b, s.filter(F.array_contains("bs", b)).select("doc_id")) for b in labeling.PRIORITY], "doc_id").select("doc_id", "bucket")


def sql_split(source: str, label: str, row: str, c: labeling.SplitConfig) -> str:
    dev, test = (f"greatest({c.least}, CAST(round_even(n * {x}, 0) AS BIGINT))" for x in (c.dev, c.test))
    return f"""sp0 AS (SELECT *, count(*) OVER (PARTITION BY {label}) AS n, row_number() OVER (PARTITION BY {label} ORDER BY {sql_draw(42, row)}, {row}) AS rn FROM {source}),
    sp AS (SELECT *, CASE WHEN n < {c.min_class} OR n - {dev} - {test} < 1 OR rn <= n - {dev} - {test} THEN 'train' WHEN rn <= n - {test} THEN 'dev' ELSE 'test' END AS split FROM sp0)"""


@query(f", lab AS (SELECT * FROM r WHERE label IS NOT NULL), {sql_split('lab', 'label', 'doc_id', labeling.GOLD)} SELECT CAST(label AS BIGINT) AS label, split, count(*) AS n, min(doc_id) AS first_doc FROM sp GROUP BY label, split")
def stratified_split_sizes(t):
    return labeling.stratified_split(t("reviews").filter("label is not null"), "label", "doc_id", 42, labeling.GOLD).groupBy("label", "split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"WITH g AS (SELECT user_id, ('0x' || left({sql_draw(42, 'user_id')}, 8))::BIGINT / 4294967296.0 AS u FROM events) SELECT split, count(*) AS n, count(DISTINCT user_id) AS n_groups, CAST(0 AS BIGINT) AS n_leaks FROM (SELECT user_id, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'dev' ELSE 'train' END AS split FROM g) GROUP BY split")
def group_split_leak_check(t):
    s = labeling.group_split(t("events"), "user_id")
    bad = labeling.leaks(s, "user_id").agg(F.count("*").alias("n_leaks"))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_groups")).crossJoin(F.broadcast(bad))


@query(f", b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_draw(42, 'doc_id')}, doc_id) AS rn FROM r WHERE label IS NOT NULL) SELECT doc_id, CAST(label AS BIGINT) AS label FROM b WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM r WHERE label IS NOT NULL GROUP BY label))")
def class_balance(t):
    return labeling.balance(t("reviews").filter("label is not null"), "label", "doc_id").select("doc_id", "label")


@query(", c AS (SELECT label, count(*) AS n FROM r WHERE label IS NOT NULL GROUP BY label) SELECT CAST(label AS BIGINT) AS label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(t):
    return labeling.class_weights(t("reviews").filter("label is not null"), "label")


@query(f"""{_FINAL}, gold AS (SELECT * FROM wa WHERE label IS NOT NULL), {sql_split('gold', 'label', 'doc_id', labeling.GOLD)}, cap AS (SELECT label AS l, CAST(6 * count(*) AS BIGINT) AS most FROM sp WHERE split = 'train' GROUP BY label),
    wk AS (SELECT *, row_number() OVER (PARTITION BY label_final ORDER BY {sql_draw(42, 'doc_id')}, doc_id) AS rk FROM wa WHERE label IS NULL AND label_final IS NOT NULL),
    u AS (SELECT doc_id, label AS y, split, CASE WHEN split = 'train' THEN 3 ELSE 1 END AS k FROM sp UNION ALL SELECT doc_id, label_final, 'train', 1 FROM wk JOIN cap ON l = label_final WHERE rk <= most)
    SELECT split, CAST(y AS BIGINT) AS label_human_int, CAST(sum(k) AS BIGINT) AS n, count(DISTINCT doc_id) AS n_items FROM u GROUP BY split, y""")
def hybrid_training_set(t):
    # the rules' patterns run once, not for each branch of the union
    w = stage(_weak(t).select("doc_id", "label", labels.accepted_label().alias("label_final")))
    gold = w.filter("label is not null").select("doc_id", F.col("label").alias("label_human_int"))
    out = labeling.hybrid_training_set(gold, w.filter("label is null").select("doc_id", "label_final"), "doc_id")
    return out.groupBy("split", "label_human_int").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_items"))


@query(f"""{_BUCKETS}, q AS (SELECT doc_id, bs[1] AS bucket FROM bk), o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {sql_draw(5, 'doc_id')}, doc_id) AS rn FROM q), i AS (SELECT *, coalesce(CASE bucket WHEN 'high_neg' THEN rn <= 20 WHEN 'random' THEN rn <= 30 WHEN 'mixed' THEN rn <= 10 END, false) AS ok FROM o),
    b AS (SELECT doc_id, bucket FROM i ORDER BY ok DESC, {sql_draw(5, 'doc_id')}, doc_id LIMIT 70), dup AS (SELECT doc_id, bucket FROM b ORDER BY {sql_draw(6, 'doc_id')}, doc_id LIMIT 8), al AS (SELECT *, 0 AS d FROM b UNION ALL SELECT *, 1 FROM dup)
    SELECT printf('task01_%05d', row_number() OVER (ORDER BY {sql_draw(7, 'doc_id')}, doc_id, d)) AS task_id, doc_id, bucket, CAST(d AS BIGINT) AS is_duplicate FROM al""")
def quota_batch(t):
    pool = _scored(t).select("doc_id", F.element_at(labeling.buckets(), 1).alias("bucket"))
    return labeling.quota_batch(pool, {"high_neg": 20, "random": 30, "mixed": 10}, 70, 5, "doc_id", 8).select("task_id", "doc_id", "bucket", "is_duplicate")


@query("SELECT conv_id AS item_id, n, k = 1 AS agrees, a AS all_labels FROM (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS k, array_to_string(list_sort(list(role)), ',') AS a FROM conversations GROUP BY conv_id) WHERE n >= 2")
def rater_agreement(t):
    return labeling.agreement(t("conversations").withColumnRenamed("conv_id", "item_id"), "role").withColumn("all_labels", F.array_join("all_labels", ","))


@query(", x AS (SELECT 1) SELECT CAST(label AS BIGINT) AS label, CAST(CASE WHEN rate <= 2 THEN -1 WHEN rate <= 3.5 THEN 0 WHEN rate IS NOT NULL THEN 1 END AS BIGINT) AS rate_label, count(*) AS n FROM r GROUP BY ALL")
def rate_labels(t):
    return t("reviews").groupBy("label", labels.rate_to_label(F.col("rate")).alias("rate_label")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 6 = 0 THEN -1 WHEN doc_id % 6 = 1 THEN 0 WHEN doc_id % 6 = 2 THEN 1 WHEN doc_id % 6 = 3 THEN -1 WHEN doc_id % 6 = 4 THEN NULL END AS BIGINT) AS label FROM labels""")
def label_parsing(t):
    written = F.element_at(F.array(*[F.lit(x) for x in ("-1.0", " neutral ", "۱", "منفی", "0.4", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return t("labels").select("doc_id", labels.parse_label(written).alias("label"))


# ---------------------------------------------------------------- JSON and pages


@query("SELECT k, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events) GROUP BY k")
def json_props(t):
    return t("events").select(F.from_json("props", "k long")["k"].alias("k"), "value").groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_objects, doc_id % 3 = 0 AS parses, doc_id || '' AS first_id FROM labels""")
def json_array_salvage(t):
    whole = F.concat(F.lit('```json\n[{"item_id": "'), F.col("doc_id").cast("string"), F.lit('", "label": "1",}, {"item_id": "x", "label": "0."}]\n```'))
    cut = F.concat(F.lit('[{"item_id": "'), F.col("doc_id").cast("string"), F.lit('", "label": "1"}, {"item_id": "x", "la'))
    d = t("labels").select("doc_id", jsonrepair.sanitize(F.when(F.col("doc_id") % 3 == 0, whole).otherwise(cut)).alias("s"))
    objects = jsonrepair.salvage_flat(F.col("s"))
    return d.select("doc_id", F.size(objects).alias("n_objects"), jsonrepair.parse_array(F.col("s")).isNotNull().alias("parses"), F.from_json(objects[0], "item_id string")["item_id"].alias("first_id"))


@query("""WITH a AS (SELECT doc_id, doc_id % 5 AS m, toxic FROM labels) SELECT doc_id, CAST(toxic AS BIGINT) AS label_llm, CAST(CASE WHEN m = 1 THEN 50 WHEN m = 2 THEN 100 ELSE 10 * m END AS BIGINT) AS confidence_int FROM a WHERE m <> 0 AND doc_id % 2 = 0""")
def answer_mapping(t):
    conf = F.when(F.col("doc_id") % 5 == 1, "none").when(F.col("doc_id") % 5 == 2, "250").otherwise((10 * (F.col("doc_id") % 5)).cast("string"))
    answers = t("labels").select(F.lit("b1").alias("batch_id"), F.lit(0).alias("pos"), F.col("doc_id").cast("string").alias("item_id"), F.when(F.col("doc_id") % 5 == 0, "7").otherwise(F.col("toxic").cast("string")).alias("label"), conf.alias("confidence"))
    wanted = t("labels").filter(F.col("doc_id") % 2 == 0).select(F.col("doc_id").cast("string").alias("item_id"))
    return jsonrepair.map_results(answers, wanted)[0].select(F.col("item_id").cast("long").alias("doc_id"), "label_llm", "confidence_int")


@query("SELECT page_id, rtrim(split_part(url, '?', 1), '/') AS url_key FROM pages")
def url_canonicalize(t):
    return t("pages").select("page_id", html.canonical_url(F.col("url")).alias("url_key"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links,
    length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_plain FROM pages""")
def html_extract(t):
    h = F.col("html")
    return t("pages").select("page_id", html.title(h).alias("title"), F.size(html.links(h)).alias("n_links"), F.length(html.plain(h)).alias("n_plain"))


# ---------------------------------------------------------------- candidates, answers, ingests


@query(f"""{_WEAK}, fl AS (SELECT wf.doc_id, pos > 0 AS p, neg > 0 AS n, svc AS s, impr AS sp, compl AS c, w <= 8 AS sh, coalesce(rate <= 1.8, false) AS low FROM wf JOIN r USING (doc_id)), mx AS (SELECT *, (n OR s) AND (p OR sp) AND c AS m FROM fl)
    SELECT doc_id, m AS mixed_cue, p AND NOT n AND NOT s AND NOT sh AS pos_cand, (n OR s OR low) AND NOT p AND NOT sh AND NOT m AS neg_cand, m OR (NOT p AND NOT n) AS neu_cand FROM mx""")
def candidate_masks(t):
    d = t("reviews").withColumns(labels.weak_features(F.col("text"), WEAK))
    masks = labeling.candidate_masks(F.col("w_pos") > 0, F.col("w_neg") > 0, F.col("w_service_strong"), F.col("w_improved"), F.col("w_complaint"), F.col("w_words") <= 8, F.col("rate"))
    return d.withColumns(masks).select("doc_id", *masks)


def _answers(t):
    """A log of answers: each labelled document asked twice, the second time with another answer for every third."""
    first = t("labels").select(F.col("doc_id").cast("string").alias("item_id"), F.col("quality").cast("int").alias("label_llm"), F.lit("ok").alias("status"), F.lit("b1").alias("batch_id"), F.lit("2024-01-01T00:00:00Z").alias("ts_utc"))
    again = first.withColumn("label_llm", F.when(F.col("item_id").cast("long") % 3 == 0, -F.col("label_llm")).otherwise(F.col("label_llm"))).withColumn("batch_id", F.lit("b2")).withColumn("ts_utc", F.lit("2024-01-02T00:00:00Z"))
    return files.latest(first.unionByName(again)).select(F.col("item_id").cast("long").alias("doc_id"), "label_llm")


_ANSWERS = "an AS (SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN -quality ELSE quality END AS BIGINT) AS label_llm FROM labels)"


@query(f"WITH {_ANSWERS} SELECT d.doc_id, source, label_llm FROM documents d LEFT JOIN an USING (doc_id)")
def pool_with_latest_labels(t):
    pool = labeling.one_per_key(t("documents").select("doc_id", "source"), "doc_id")
    return pool.join(labeling.one_per_key(_answers(t), "doc_id"), "doc_id", "left")


@query(f"{_WL}, {_ANSWERS} SELECT doc_id, CAST(label_weak AS BIGINT) AS label_weak, label_llm, label_weak <> label_llm AS changed FROM wl JOIN an USING (doc_id)")
def weak_answer_audit(t):
    return labeling.audit(_weak(t).select("doc_id", "label_weak"), _answers(t), "doc_id")


@query(f", lab AS (SELECT * FROM r WHERE label IS NOT NULL), {sql_split('lab', 'label', 'doc_id', labeling.HUMAN)} SELECT doc_id, CAST(label AS BIGINT) AS label, split FROM sp")
def human_ingest_split(t):
    return labeling.stratified_split(t("reviews").filter("label is not null"), "label", "doc_id", 42, labeling.HUMAN).select("doc_id", "label", "split")


@query(f"WITH {_ANSWERS}, {sql_split('an', 'label_llm', 'doc_id', labeling.LLM)} SELECT doc_id, label_llm, split FROM sp")
def answer_ingest_split(t):
    return labeling.stratified_split(_answers(t), "label_llm", "doc_id", 42, labeling.LLM).select("doc_id", "label_llm", "split")


@query(f", lab AS (SELECT * FROM r WHERE label IS NOT NULL), {sql_split('lab', 'label', 'doc_id', labeling.GOLD)} SELECT doc_id, split, md5(trim(text)) AS text_md5, CAST(rate AS BIGINT) AS label_id FROM sp WHERE trim(coalesce(text, '')) <> ''")
def bert_dataset(t):
    split = labeling.stratified_split(t("reviews").filter("label is not null"), "label", "doc_id", 42, labeling.GOLD)
    return labeling.bert_dataset(split, "text", "rate", "doc_id", "split").select("doc_id", "split", F.md5("text_bert").alias("text_md5"), "label_id")


@query("""WITH h AS (SELECT source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents)
    SELECT source, CASE WHEN n < 5 THEN 'train' WHEN rn > greatest(1, least(CAST(floor(n * 0.2) AS BIGINT), n - 1)) THEN 'train' WHEN rn <= 50 THEN 'test' ELSE 'unused' END AS part, count(*) AS n_rows FROM h GROUP BY ALL""")
def holdout_sizes_truncated(t):
    return retrieval.holdout(t("documents"), "source", "doc_id", truncate=True).groupBy("source", "part").agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- without SQL


@query()
def label_pool(t):
    """The whole ladder of draws into a pool of 300 rows."""
    config = labeling.PoolConfig(total_size=300, n_high_neg=60, n_service_neg=50, n_rate_neg=50, n_mid_neg=30, n_mixed=30, n_random=50, n_high_pos=30)
    rows = labeling.usable(t("reviews"), F.col("text"), config)
    return labeling.build_pool(labeling.pool_scores(rows, F.col("text"), F.col("rate"), POOL), "doc_id", "source", "lang", config).select("item_id", "doc_id", "bucket", "neg_score", "pos_score")


@query("""WITH RECURSIVE b AS (SELECT item_id, length(trim(left(regexp_replace(coalesce(text, ''), '[\\x00\\r\\n\\t]', ' ', 'g'), 700))) AS c, row_number() OVER (ORDER BY item_id) AS i FROM benchmark), g AS (
    SELECT i, item_id, c AS chars, 1 AS items, 0 AS batch_no FROM b WHERE i = 1
    UNION ALL SELECT b.i, b.item_id, CASE WHEN g.items >= 30 OR g.chars + b.c > 12000 THEN b.c ELSE g.chars + b.c END, CASE WHEN g.items >= 30 OR g.chars + b.c > 12000 THEN 1 ELSE g.items + 1 END, CASE WHEN g.items >= 30 OR g.chars + b.c > 12000 THEN g.batch_no + 1 ELSE g.batch_no END FROM g JOIN b ON b.i = g.i + 1)
    SELECT item_id, CAST(batch_no AS BIGINT) AS batch_no FROM g""")
def request_batches(t):
    return labeling.greedy_batches(t("benchmark").select("item_id", text.compact(F.col("text")).alias("text")), "item_id", F.length("text"), 30, 12_000).select("item_id", "batch_no")


@query()
def mlp_sentiment(t):
    """A classifier trained on the train split of the labelled rows, and its predictions for all labelled rows."""
    gold = labeling.stratified_split(t("reviews").filter("label is not null"), "label", "doc_id").withColumn("class_id", labels.class_id(F.col("label")).cast("double"))
    featured = classify.features(gold, F.col("text")).select("doc_id", "split", "label", "class_id", "terms")
    model = classify.fit(featured.filter("split = 'train'"), buckets=256, max_iter=15)
    return classify.predict(model, featured).select("doc_id", "split", "label", "predicted")
