"""DuckDB SQL for the quality rules."""

from .quality import CLASSES, COMMON_WORDS, N_CLASSES, OTHER, QualityRules

_W = "[\\x20\\x09-\\x0D]+"


def _d2(bins: str, ref: str) -> str:
    p = f"({bins}[i] / greatest(list_sum({bins}), 1))"
    a = f"(({p} + {ref}[i]) / 2)"
    one = f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {a}) ELSE 0 END + CASE WHEN {ref}[i] > 0 THEN {ref}[i] * log2({ref}[i] / {a}) ELSE 0 END"
    return f"greatest(list_sum(list_transform(range(1, len({bins}) + 1), lambda i: {one})) / 2, 0)"


def judged_ctes(rules: QualityRules = QualityRules()) -> str:
    """CTEs up to `judged`: one row a document (rid) with the measures and the verdict."""
    left = ["coalesce(text, '') AS l0"]
    left += [f"regexp_replace(l{i}, '{c}+', '', 'g') AS l{i + 1}" for i, c in enumerate(CLASSES)]
    chars = ", ".join([f"length(l{i}) - length(l{i + 1})" for i in range(N_CLASSES - 1)] + [f"length(l{N_CLASSES - 1})"])
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in ws)}]" for k, ws in COMMON_WORDS.items())
    langs = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    share = lambda col: f"list_transform({col}, lambda x: x / list_sum({col}))"
    refs = ""
    width = max(map(len, COMMON_WORDS.values())) + 1
    for k in range(3):
        near = "" if not k else f" JOIN ref{k - 1} USING (lk) WHERE {_d2('chars', 'rc')} < {rules.trim_char[k - 1]} AND (len(bins) < 2 OR {_d2('bins', 'rw')} < {rules.trim_word[k - 1]})"
        c = ", ".join(f"sum(chars[{i + 1}])" for i in range(N_CLASSES))
        w = ", ".join(f"sum(bins[{i + 1}])" for i in range(width))
        refs += f""", sum{k} AS (SELECT lk, [{c}] AS c, list_filter([{w}], lambda x: x IS NOT NULL) AS w FROM long{near} GROUP BY lk)
        , ref{k} AS (SELECT lk, {share('c')} AS rc, {share('w')} AS rw FROM sum{k}"""
        refs += ")" if not k else f" UNION ALL SELECT lk, rc, rw FROM ref{k - 1} WHERE lk NOT IN (SELECT lk FROM sum{k}))"
    return f"""
    d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text FROM documents),
    l AS (SELECT rid, doc_id, lang, {', '.join(left)} FROM d),
    h0 AS (SELECT rid, doc_id, l0, [{chars}] AS chars, CASE WHEN lang IN ({langs}) THEN lang ELSE '{OTHER}' END AS lk, list_filter(regexp_split_to_array(l0, '{_W}'), lambda x: x <> '') AS ws FROM l),
    h1 AS (SELECT *, CASE lk {lists} ELSE [] END AS listed, list_filter(string_split(l0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM h0),
    h AS (SELECT *, list_concat(list_transform(listed, lambda s: len(list_filter(ws, lambda x: x = s))), [len(list_filter(ws, lambda x: NOT list_contains(listed, x)))]) AS bins FROM h1),
    long AS (SELECT * FROM h WHERE len(ws) >= {rules.min_words_judged})
    {refs},
    win AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM h WHERE len(ws) >= 5),
    win2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(ws, i, i + 4)) AS n FROM win),
    rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM win2 WHERE n > 1) GROUP BY rid),
    m AS (SELECT h.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(l0) - chars[2] AS BIGINT) AS word_chars, CAST(chars[6] AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, list_sum(chars) AS total,
        round(CASE WHEN rc IS NOT NULL THEN {_d2('chars', 'rc')} END - {N_CLASSES - 1} / (8 * ln(2)) / greatest(list_sum(chars), 1), 6) AS char_excess,
        round(CASE WHEN rw IS NOT NULL AND len(bins) > 1 THEN {_d2('bins', 'rw')} END - (len(bins) - 1) / (8 * ln(2)) / greatest(len(ws), 1), 6) AS word_excess
        FROM h LEFT JOIN ref2 USING (lk) LEFT JOIN rep ON rep.rid = h.rid),
    judged AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
        NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
        AND NOT coalesce(total >= {rules.min_chars_judged} AND char_excess > {rules.max_char_excess}, false)
        AND NOT coalesce(n_words >= {rules.min_words_judged} AND word_excess > {rules.max_word_excess}, false) AS kept FROM m)"""


OP9_SQL = f"WITH {judged_ctes()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_excess, word_excess, base_failed, kept FROM judged"
