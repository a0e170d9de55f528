"""Format-preserving pseudonyms for personal data, in DataFrame expressions alone.

One pattern finds candidates; each is validated by its kind's rule (Luhn, mod 97,
calendar, octets, number ranges) and left alone if it fails. A valid value is a pair of
numbers (l, r) out of ranges (a, b) that its format fixes, and a Feistel network of eight
rounds, l += F(key, kind, round, r) mod a and r += F(key, kind, round, l) mod b in turn,
permutes these pairs: the result is valid in the same format, equal values get equal
pseudonyms in every document, and whoever holds the key can invert it. F is the start of
a SHA-256.

kind    permuted                                  kept
card    all digits but the first and the check    first digit, separators; check digit set anew
phone   national digits                           country code, trunk (0), separators
ssn     area, group and serial within validity    separators
ip      the 32-bit address                        -
ip6     the last 96 bits                          the first 32 bits; written in eight groups
iban    digits of the account part                country, letters, spaces; check digits set anew
date    the day, within blocks of 72,900 days     order and separators of the fields
A value's pseudonym does not depend on its separators, so +44 20 7123 4567 and
+442071234567 stay linked, and so do an IBAN's printed and its compact form.
Identifiers without such a structure are replaced by keyed digests of like shape, which
are linked in the same way: the local part of an e-mail address, and secrets (hexadecimal
strings of 32 to 64 digits).

There is no default key. The key reaches the expressions through a scalar subquery over a
one-row table, so that it stands in no plan, event log or page of the user interface.

No pattern recurses by the length of its input: repeated groups are possessive or of
bounded count, so that texts of any length and shape are searched without deep stacks.

Defined results: a null text stays null; texts without personal data stay as they are,
empty ones too; repeated rows get equal results; whole texts of any length are searched;
columns of other names are kept by `pseudonymize`; an empty table gives no rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Setting of the session that holds the key (its name is one that Spark redacts); without it, each run draws a key of its own.
KEY_SETTING = "spark.reviewloom.pseudonym.secret"
ROUNDS = 8
#: Calling codes of one and two digits; all others have three.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: The formats that are looked for, as Java regular expressions.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![A-Za-z0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,64}+(?![A-Za-z0-9])"
IP = rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"
_GROUPS = r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})"
IP6 = rf"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|{_GROUPS}?::{_GROUPS}?)(?![0-9A-Za-z:]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}(?<y>[-/.])[0-9]{2}\k<y>[0-9]{2}|[0-9]{2}(?<z>[-/.])[0-9]{2}\k<z>[0-9]{4})(?![0-9A-Za-z]|[-/.][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?(?:[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{2,3}(?:[ .-][0-9]{2}){2,3})"
    r"|\+[0-9]{1,3}(?<p>[ .-])[0-9]{1,4}(?:\k<p>[0-9]{2,4}){1,4}|\+[0-9]{8,15}|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"
)
CARD = r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?<c>[ -])[0-9]{4}\k<c>[0-9]{4}\k<c>[0-9]{1,7}|[0-9]{4}(?<e>[ -])[0-9]{6}\k<e>[0-9]{5})(?![0-9A-Za-z]|\.[0-9])"


def _iban() -> str:
    """IBANs of the lengths above, together or in printed groups of four; those of other countries together."""
    forms = []
    for n, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        printed = f"(?: [A-Z0-9]{{4}}){{{fours}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
        forms.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|{printed})(?![A-Za-z0-9])")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+(?![A-Za-z0-9]))"


IBAN = _iban()
ANY = "|".join([EMAIL, IP6, IBAN, SECRET, DATE, IP, SSN, CARD, PHONE])
DAYS = 270  # a block of dates is 270 * 270 days
T = "__rl_p_"


def _q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _full(x: str, pattern: str) -> str:
    return f"({x} rlike {_q('^(?:' + pattern + ')$')})"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]+', '')"


def _luhn(d: str) -> str:
    """Luhn sum of the digit string, modulo 10."""
    return f"(aggregate(transform(split(reverse({d}), ''), (c, i) -> int(c) * (1 + i % 2)), 0, (s, x) -> s + x - if(x > 9, 9, 0)) % 10)"


def _mod97(x: str) -> str:
    """The letters and digits read as a number (A is 10), modulo 97."""
    v = "if(c between '0' and '9', int(c), ascii(c) - 55)"
    return f"aggregate(split({x}, ''), 0, (s, c) -> (s * if(c between '0' and '9', 10, 100) + {v}) % 97)"


def _day(x: str) -> str:
    """A date's day, or null: year first, or day and month first (month and day where only that is valid)."""
    d = _digits(x)
    first = f"try_to_date({d}, 'yyyyMMdd')"
    last = f"coalesce(try_to_date({d}, 'ddMMyyyy'), try_to_date({d}, 'MMddyyyy'))"
    return f"if(substr({x}, 5, 1) in ('-', '/', '.'), {first}, {last})"


def _day_format(x: str) -> str:
    d = _digits(x)
    return f"CASE WHEN substr({x}, 5, 1) in ('-', '/', '.') THEN concat_ws(substr({x}, 5, 1), 'yyyy', 'MM', 'dd') WHEN try_to_date({d}, 'ddMMyyyy') is not null THEN concat_ws(substr({x}, 3, 1), 'dd', 'MM', 'yyyy') ELSE concat_ws(substr({x}, 3, 1), 'MM', 'dd', 'yyyy') END"


def _refill(x: str, new: str) -> str:
    """`x` with its digits replaced, in order, by those of `new`."""
    return f"array_join(transform(split({x}, ''), (c, i) -> if(c between '0' and '9', substr({new}, length({_digits(f'substr({x}, 1, i + 1)')}), 1), c)), '')"


def _hash(*parts: str) -> str:
    """52 bits of a keyed SHA-256, as a long."""
    return f"cast(conv(substr(sha2(concat_ws('|', {T}key, {', '.join(parts)}), 256), 1, 13), 16, 10) as long)"


def _groups(x: str) -> str:
    """The groups of an IPv6 address, as strings: eight if it is one."""
    given = "filter(split({}, ':'), g -> g <> '')".format
    return given(f"replace({x}, '::', concat(':', repeat('0:', 8 - size({given(x)}))))")


def run_key(spark: SparkSession) -> str:
    """The session's key, or a fresh one: pseudonyms are then linked within this run alone."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def _split(digits: str) -> str:
    """(a, b, l, r) of a digit string of up to 36 digits."""
    n, h = f"length({digits})", f"length({digits}) div 2"
    return f"struct(cast(pow(10, {h}) as long) as a, cast(pow(10, {n} - {h}) as long) as b, cast(if({h} = 0, '0', left({digits}, {h})) as long) as l, cast(right({digits}, {n} - {h}) as long) as r)"


def _one_row(spark: SparkSession, value: str) -> DataFrame:
    """A local relation of one string: plans show its column alone, and no Python worker makes it."""
    jvm = spark.sparkContext._jvm
    cells = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1)
    cells[0] = value
    rows = jvm.java.util.ArrayList()
    rows.add(jvm.org.apache.spark.sql.RowFactory.create(cells))
    return DataFrame(spark._jsparkSession.createDataFrame(rows, spark._jsparkSession.parseDataType(StructType([StructField("k", StringType())]).json())), spark)


def with_pseudonyms(df: DataFrame, key: str) -> DataFrame:
    """Adds T + "m", the candidates of `text`, and T + "v", a pseudonym for each (null where it is not valid)."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.col("text")
    found = F.when(text.rlike("[0-9@]|[a-fA-F]{32}"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kind = f"""CASE WHEN instr(m, '@') > 0 THEN 'email'
        WHEN {_full('m', IP6)} THEN if(m rlike '[0-9]' and not m like '::%' and size({_groups('m')}) = 8, 'ip6', null)
        WHEN {_full('m', IBAN)} THEN if({_mod97("concat(substr(replace(m, ' ', ''), 5), substr(m, 1, 4))")} = 1, 'iban', null)
        WHEN {_full('m', SECRET)} THEN 'secret'
        WHEN {_full('m', DATE)} THEN if({_day('m')} is not null, 'date', null)
        WHEN {_full('m', IP)} THEN 'ip'
        WHEN {_full('m', SSN)} THEN if(substr(m, 1, 3) in ('000', '666') or m like '9%' or substr(m, 5, 2) = '00' or m like '%0000', null, 'ssn')
        WHEN m like '+%' THEN if(length({_digits('m')}) between 8 and 15, 'phone', null)
        WHEN m like '(%' or {_full('m', '[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}')} THEN 'phone'
        WHEN {_luhn(_digits('m'))} = 0 THEN 'card' END"""
    # the digits that a phone number keeps: the country code
    kept = f"if(e.m not like '+%', 0, coalesce(nullif(length(regexp_extract({_digits('e.m')}, '^(?:{'|'.join(CALLING)})', 0)), 0), 3))"
    trunk = "replace(e.m, '(0)', '()')"  # a trunk prefix is no part of the number
    steps = [
        f"transform(v, m -> struct(m, {kind} as kind))",
        f"transform(v, e -> struct(e.m, e.kind, CASE e.kind WHEN 'card' THEN {_digits('e.m')} WHEN 'phone' THEN {_digits(trunk)} WHEN 'iban' THEN {_digits('substr(e.m, 5)')} END as d, CASE WHEN e.kind = 'phone' THEN {kept} ELSE 0 END as k, if(e.kind = 'ip6', transform({_groups('e.m')}, g -> cast(conv(g, 16, 10) as long)), null) as g))",
        f"""transform(v, e -> struct(e.m, e.kind, e.d, e.k, e.g, CASE e.kind
            WHEN 'card' THEN {_split('substr(e.d, 2, length(e.d) - 2)')}
            WHEN 'phone' THEN {_split('substr(e.d, e.k + 1)')}
            WHEN 'iban' THEN if(e.d = '', null, {_split('e.d')})
            WHEN 'ssn' THEN struct(898 * 99L as a, 9999L as b, (cast(substr(e.m, 1, 3) as long) - 1 - if(cast(substr(e.m, 1, 3) as int) > 666, 1, 0)) * 99 + cast(substr(e.m, 5, 2) as long) - 1 as l, cast(substr(e.m, 8) as long) - 1 as r)
            WHEN 'ip' THEN struct(65536L as a, 65536L as b, cast(split(e.m, '[.]')[0] as long) * 256 + cast(split(e.m, '[.]')[1] as long) as l, cast(split(e.m, '[.]')[2] as long) * 256 + cast(split(e.m, '[.]')[3] as long) as r)
            WHEN 'ip6' THEN struct(shiftleft(1L, 48) as a, shiftleft(1L, 48) as b, shiftleft(e.g[2], 32) + shiftleft(e.g[3], 16) + e.g[4] as l, shiftleft(e.g[5], 32) + shiftleft(e.g[6], 16) + e.g[7] as r)
            WHEN 'date' THEN struct({DAYS}L as a, {DAYS}L as b, pmod(unix_date({_day('e.m')}), {DAYS * DAYS}) div {DAYS} as l, cast(pmod(unix_date({_day('e.m')}), {DAYS}) as long) as r) END as n))""",
        f"""transform(v, e -> struct(e.m, e.kind, e.d, e.k, e.g, if(e.n is null, null, aggregate(sequence(0, {ROUNDS - 1}), struct(e.n.l as l, e.n.r as r), (s, i) -> if(i % 2 = 0,
            struct((s.l + {_hash('e.kind', 'i', 'e.n.a', 's.r')}) % e.n.a as l, s.r as r), struct(s.l as l, (s.r + {_hash('e.kind', 'i', 'e.n.b', 's.l')}) % e.n.b as r)))) as p, e.n.a, e.n.b))""",
        """transform(v, e -> struct(e.m, e.kind, e.d, e.k, e.g, e.p, if(e.kind in ('card', 'phone', 'iban') and e.p is not null, concat(if(e.a = 1, '', lpad(cast(e.p.l as string), cast(round(log10(e.a)) as int), '0')), lpad(cast(e.p.r as string), cast(round(log10(e.b)) as int), '0')), null) as new))""",
        f"""transform(v, e -> CASE e.kind
            WHEN 'card' THEN {_refill('e.m', f"concat(left(e.d, 1), e.new, (10 - {_luhn("concat(left(e.d, 1), e.new, '0')")}) % 10)")}
            WHEN 'phone' THEN replace({_refill(trunk, "concat(left(e.d, e.k), e.new)")}, '()', '(0)')
            WHEN 'ssn' THEN concat_ws('-', lpad(cast(1 + e.p.l div 99 + if(e.p.l div 99 >= 665, 1, 0) as string), 3, '0'), lpad(cast(1 + e.p.l % 99 as string), 2, '0'), lpad(cast(1 + e.p.r as string), 4, '0'))
            WHEN 'ip' THEN concat_ws('.', e.p.l div 256, e.p.l % 256, e.p.r div 256, e.p.r % 256)
            WHEN 'ip6' THEN concat_ws(':', transform(array(e.g[0], e.g[1], shiftright(e.p.l, 32), shiftright(e.p.l, 16) % 65536, e.p.l % 65536, shiftright(e.p.r, 32), shiftright(e.p.r, 16) % 65536, e.p.r % 65536), g -> lower(hex(g))))
            WHEN 'date' THEN date_format(date_from_unix_date(cast(unix_date({_day('e.m')}) - pmod(unix_date({_day('e.m')}), {DAYS * DAYS}) + e.p.l * {DAYS} + e.p.r as int)), {_day_format('e.m')})
            WHEN 'iban' THEN if(e.p is null, e.m, transform(array({_refill('substr(e.m, 5)', 'e.new')}), t -> concat(left(e.m, 2), lpad(cast(98 - {_mod97("concat(replace(t, ' ', ''), left(e.m, 2), '00')")} as string), 2, '0'), t))[0])
            WHEN 'email' THEN concat('u', substr(sha2(concat_ws('|', {T}key, 'email', lower(e.m)), 256), 1, 12), substr(e.m, instr(e.m, '@')))
            WHEN 'secret' THEN substr(sha2(concat_ws('|', {T}key, 'secret', e.m), 256), 1, length(e.m)) END)""",
    ]
    out = df.withColumn(T + "key", _one_row(df.sparkSession, key).scalar()).withColumn(T + "m", found).withColumn(T + "v", F.col(T + "m"))
    for step in steps:
        out = out.withColumn(T + "v", F.expr(step.replace("transform(v,", f"transform({T}v,", 1)))
    return out


def pseudonymize(df: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """The rows with personal data in `text` replaced; `count` names a column for the number of values replaced."""
    out = with_pseudonyms(df, key)
    gaps = F.expr(f"split(text, {_q(ANY)}, -1)")
    parts = F.expr(f"zip_with({T}g, zip_with({T}m, {T}v, (m, v) -> coalesce(v, m)), (g, v) -> concat(g, coalesce(v, '')))")
    out = out.withColumn(T + "g", F.when(F.size(T + "m") > 0, gaps))
    replaced = F.when(F.size(T + "m") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    columns = [replaced.alias("text") if c == "text" else F.col(f"`{c}`") for c in df.columns]
    if count:
        columns.append(F.size(F.expr(f"filter({T}v, x -> x is not null)")).cast("long").alias(count))
    return out.select(*columns)
