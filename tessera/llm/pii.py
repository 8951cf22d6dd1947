"""PII: format-preserving Feistel pseudonyms.

Personal values found in a text are validated (octets, Luhn digit, calendar
date, number ranges) and replaced by a keyed permutation of themselves inside
their own format, so a value is always replaced by the same pseudonym in
every document, and two values never share one. Everything is SQL: matches
and the text between them are taken by one expression each, zipped together
again, and the Feistel rounds are folds over a round counter.

Networks used (all without swapping; round ``r`` changes one half by a
keyed function of the other, which is invertible):

* letters and digits of a string: both halves are shifted inside their
  character class (emails, phone numbers, the body of card numbers, keys);
* a pair ``(a, b)`` with ``0 <= a < A``, ``0 <= b < B``: modular addition
  (IPv4 as two 16-bit halves, dates as a day number in ``A * B`` days, social
  security numbers as valid (area, group) x serial).

Card numbers keep their first digit and get a fresh Luhn digit. Separators
stay in place. Candidates that fail validation are left as they are.

Numbers that stand in a row (a card beside its CVV, expiry or an order
number) are one match; the cards in it are the valid Luhn numbers in a usual
grouping. Of two that share digits, one with the first digit of a card issuer
(2 to 6) goes first, then the earlier, then the shorter one (16 digits and a
CVV, not 19). What is left is tried in any other grouping.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import free_name, quoted

ROUNDS = 8

# Patterns of the values that are looked for (Java regular expressions).
EMAIL = "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{2,}"
IPV4 = "(?<![0-9.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?!\\.?[0-9])"
ISO_DATE = "(?<![0-9\\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\\-])"
US_DATE = "(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
SSN = "(?<![0-9\\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\\-])"
PHONE = "(?<![0-9A-Za-z])(?:\\+[0-9]{1,3}[ .\\-]?)?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .\\-])[0-9]{3}[ .\\-][0-9]{4}(?![0-9])"
INTL_PHONE = "\\+[0-9]{1,3}(?:[ .\\-]?[0-9]{2,4}){2,4}(?![0-9])"
CARD = "(?<![0-9])[0-9](?:[ \\-]?[0-9]){12,18}(?![0-9])"
ACCESS_KEY = "(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
# Numbers in a row with at least 13 digits, up to the next value of another kind; cards are looked for inside.
OTHER_NUMBERS = "|".join([EMAIL, ISO_DATE, US_DATE, SSN, PHONE, IPV4])
NUMBERS = f"(?<![0-9])(?=[0-9](?:[ \\-]?[0-9]){{12}})[0-9]++(?:[ \\-](?!{OTHER_NUMBERS})[0-9]++)*+"
ANY = "|".join([EMAIL, ACCESS_KEY, ISO_DATE, US_DATE, SSN, PHONE, INTL_PHONE, IPV4, NUMBERS])
# Usual groupings of a card number, one separator throughout.
USUAL_CARD = "|".join(["[0-9]{13,19}"] + [p.replace("_", sep) for sep in (" ", "-") for p in (
    "[0-9]{4}(?:_[0-9]{4}){3}(?:_[0-9]{3})?", "[0-9]{4}_[0-9]{6}_[0-9]{4,5}", "[0-9]{4}(?:_[0-9]{3}){3}")])

# Day numbers 0 .. 108 * 673 - 1 are 1901-01-01 .. 2099-12-31; 898 valid areas x 99 groups.
FIRST_DAY, DAYS = "1901-01-01", (108, 673)
SSN_SIZES = (898 * 99, 9999)


def _digest(key: str, kind: str, rnd: str, value: str) -> str:
    return f"sha2(concat('{key}', '|{kind}|', {rnd}, '|', {value}), 256)"


def _shift(text: str, seed: str) -> str:
    """Shift every letter and digit of ``text`` inside its class by an amount
    derived from ``seed`` and its position."""
    k = f"CAST(conv(substr(sha2(concat({seed}, '#', p), 256), 1, 10), 16, 10) AS BIGINT)"
    rules = " ".join(
        f"WHEN c BETWEEN '{lo}' AND '{hi}' THEN chr((ascii(c) - {ord(lo)} + {k}) % {n} + {ord(lo)})"
        for lo, hi, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)))
    return f"array_join(transform(filter(split({text}, ''), c -> c <> ''), (c, p) -> CASE {rules} ELSE c END), '')"


def string_permutation(text: str, key: str, kind: str) -> str:
    """SQL of the string network on expression ``text``. The round function
    sees the other half in lower case, so letter case is kept and does not
    matter for the link."""
    half = f"CAST(length({text}) DIV 2 AS INT)"
    left = _shift("s.l", _digest(key, kind, "r", "lower(s.r)"))
    right = _shift("s.r", _digest(key, kind, "r", "lower(s.l)"))
    return f"""aggregate(sequence(1, {ROUNDS}),
        struct(substr({text}, 1, {half}) AS l, substr({text}, {half} + 1) AS r),
        (s, r) -> struct(IF(r % 2 = 1, {left}, s.l) AS l, IF(r % 2 = 0, {right}, s.r) AS r),
        s -> concat(s.l, s.r))"""


def pair_permutation(a: str, b: str, sizes: tuple[int, int], key: str, kind: str) -> str:
    """SQL of the modular network on the pair ``(a, b)``; gives a struct."""
    def move(value, other, size):
        h = f"CAST(conv(substr({_digest(key, kind, 'r', f'CAST({other} AS STRING)')}, 1, 12), 16, 10) AS BIGINT)"
        return f"({value} + {h}) % {size}"
    return f"""aggregate(sequence(1, {ROUNDS}), struct(CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b),
        (s, r) -> struct(IF(r % 2 = 1, {move('s.a', 's.b', sizes[0])}, s.a) AS a,
                         IF(r % 2 = 0, {move('s.b', 's.a', sizes[1])}, s.b) AS b))"""


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn_sum(digits: str, check_included: bool) -> str:
    """Luhn sum of a digit string, counted from its end."""
    double = "i % 2 = 1" if check_included else "i % 2 = 0"
    value = "CAST(c AS INT)"
    return (f"aggregate(transform(filter(split(reverse({digits}), ''), c -> c <> ''), (c, i) -> "
            f"IF({double}, {value} * 2 - IF({value} > 4, 9, 0), {value})), 0, (s, x) -> s + x)")


def _refill(m: str, digits: str) -> str:
    """``m`` with its digits replaced, in order, by ``digits``."""
    before = f"length(regexp_replace(substr({m}, 1, p), '[^0-9]', ''))"
    return (f"array_join(transform(filter(split({m}, ''), c -> c <> ''), (c, p) -> "
            f"IF(c BETWEEN '0' AND '9', substr({digits}, {before} + 1, 1), c)), '')")


def _date(m: str, fmt: str, key: str) -> str:
    day = f"datediff(CAST(try_to_timestamp({m}, '{fmt}') AS DATE), DATE'{FIRST_DAY}')"
    n = DAYS[0] * DAYS[1]
    pair = pair_permutation(f"{day} DIV {DAYS[1]}", f"{day} % {DAYS[1]}", DAYS, key, "date")
    back = (f"transform(array({pair}), q -> date_format(date_add(DATE'{FIRST_DAY}', "
            f"CAST(q.a * {DAYS[1]} + q.b AS INT)), '{fmt}'))[0]")
    return f"IF({day} BETWEEN 0 AND {n - 1}, {back}, {m})"


def _ip(m: str, key: str) -> str:
    o = [f"CAST(split({m}, '[.]')[{i}] AS BIGINT)" for i in range(4)]
    pair = pair_permutation(f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", (65536, 65536), key, "ip")
    back = (f"transform(array({pair}), q -> concat_ws('.', CAST(q.a DIV 256 AS STRING), CAST(q.a % 256 AS STRING), "
            f"CAST(q.b DIV 256 AS STRING), CAST(q.b % 256 AS STRING)))[0]")
    return f"IF({' AND '.join(f'{x} <= 255' for x in o)}, {back}, {m})"


def _ssn(m: str, key: str) -> str:
    area, group, serial = (f"CAST(split({m}, '-')[{i}] AS BIGINT)" for i in range(3))
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    rank = f"({area} - IF({area} > 666, 2, 1))"
    pair = pair_permutation(f"{rank} * 99 + {group} - 1", f"{serial} - 1", SSN_SIZES, key, "ssn")
    new_area = "(q.a DIV 99 + IF(q.a DIV 99 >= 665, 2, 1))"
    back = (f"transform(array({pair}), q -> concat(lpad(CAST({new_area} AS STRING), 3, '0'), '-', "
            f"lpad(CAST(q.a % 99 + 1 AS STRING), 2, '0'), '-', lpad(CAST(q.b + 1 AS STRING), 4, '0')))[0]")
    return f"IF({valid}, {back}, {m})"


def _card(m: str, key: str) -> str:
    d = _digits(m)
    body = string_permutation(f"substr({d}, 2, length({d}) - 2)", key, "card")
    back = (f"transform(array(concat(substr({d}, 1, 1), {body})), q -> transform(array(concat(q, CAST("
            f"(10 - {_luhn_sum('q', False)} % 10) % 10 AS STRING))), z -> {_refill(m, 'z')})[0])[0]")
    return f"IF({_luhn_sum(d, True)} % 10 = 0, {back}, {m})"


def _slices(m: str, flagged: str) -> str:
    """SQL: ``array<struct<v, pii>>`` that cuts ``m`` at the disjoint spans
    (at, n; 1-based, ascending) of array ``flagged``."""
    return f"""transform(array({flagged}), z -> flatten(concat(
        transform(z, (x, k) -> array(
            struct(substr({m}, IF(k = 0, 1, z[k - 1].at + z[k - 1].n), x.at - IF(k = 0, 1, z[k - 1].at + z[k - 1].n)) AS v,
                   false AS pii),
            struct(substr({m}, x.at, x.n) AS v, true AS pii))),
        array(array(struct(substr({m}, IF(size(z) = 0, 1, element_at(z, -1).at + element_at(z, -1).n)) AS v,
                           false AS pii))))))[0]"""


def _number_parts(m: str) -> str:
    """SQL: numbers in a row as ``array<struct<v, pii>>``, cards flagged."""
    usual = f"^(?:{USUAL_CARD})$"
    groups = f"regexp_extract_all({m}, '[0-9]+', 0)"
    ends = (f"aggregate({groups}, CAST(array() AS ARRAY<INT>), "
            f"(s, x) -> concat(s, array(IF(size(s) = 0, 0, element_at(s, -1) + 1) + length(x))))")
    spans = f"""filter(transform(array(struct({groups} AS g, {ends} AS e)), q -> flatten(transform(q.g, (x, i) ->
        transform(filter(sequence(i, least(i + 4, size(q.g) - 1)), j -> q.e[j] - q.e[i] + length(x) BETWEEN 13 AND 23),
            j -> struct(q.e[i] - length(x) + 1 AS at, q.e[j] - q.e[i] + length(x) AS n)))))[0],
        y -> IF(substr({m}, y.at, y.n) RLIKE '{usual}',
                {_luhn_sum(_digits(f"substr({m}, y.at, y.n)"), True)} % 10 = 0, false))"""
    ranked = f"""transform(array_sort(transform({spans}, y -> struct(
        IF(substr({m}, y.at, 1) BETWEEN '2' AND '6', 0, 1) AS rank, y.at AS at, y.n AS n))), y -> struct(y.at AS at, y.n AS n))"""
    taken = f"""array_sort(aggregate({ranked}, CAST(array() AS ARRAY<STRUCT<at: INT, n: INT>>), (s, y) ->
        IF(exists(s, x -> x.at < y.at + y.n AND y.at < x.at + x.n), s, concat(s, array(y)))))"""
    rest = f"""flatten(zip_with(split(u.v, '{CARD}', -1), regexp_extract_all(u.v, '({CARD})', 1),
        (a, b) -> array(struct(a AS v, false AS pii), struct(coalesce(b, '') AS v, b IS NOT NULL AS pii))))"""
    return f"flatten(transform({_slices(m, taken)}, u -> IF(u.pii, array(u), {rest})))".replace("\\", "\\\\")


def _phone(m: str, key: str) -> str:
    code = f"regexp_extract({m}, '^\\\\+[0-9]{{1,3}}(?=[ .(-])', 0)"
    rest = f"substr({m}, length({code}) + 1)"
    new = string_permutation(_digits(rest), key, "phone")
    return f"concat({code}, transform(array({new}), z -> {_refill(rest, 'z')})[0])"


def _email(m: str, key: str) -> str:
    tld = f"regexp_extract({m}, '[.][A-Za-z]+$', 0)"
    head = f"substr({m}, 1, length({m}) - length({tld}))"
    return f"concat({string_permutation(head, key, 'email')}, {tld})"


def pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of match ``m`` (itself when it is not valid)."""
    def whole(pattern):
        return f"{m} RLIKE '^(?:{pattern})$'".replace("\\", "\\\\")
    return f"""CASE WHEN contains({m}, '@') THEN {_email(m, key)}
        WHEN startswith({m}, 'AKIA') THEN concat('AKIA', {string_permutation(f'substr({m}, 5)', key, 'key')})
        WHEN {whole(ISO_DATE)} THEN {_date(m, 'yyyy-MM-dd', key)}
        WHEN {whole(US_DATE)} THEN {_date(m, 'MM/dd/yyyy', key)}
        WHEN {whole(SSN)} THEN {_ssn(m, key)}
        WHEN {whole(IPV4)} THEN {_ip(m, key)}
        WHEN {whole(PHONE)} OR startswith({m}, '+') THEN {_phone(m, key)}
        ELSE {_card(m, key)} END"""


def session_key(spark: SparkSession) -> str:
    """The secret of this session: its setting ``spark.tessera.pseudonymKey``.
    Without it the key is a public one, fit for test tables only, with a
    warning."""
    key = spark.conf.get("spark.tessera.pseudonymKey", None)
    if not key:
        warnings.warn("spark.tessera.pseudonymKey is not set: the pseudonyms can be undone by anybody", stacklevel=3)
    return key or "pseudonym-key-1"


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with personal values in ``text`` replaced and a column
    ``pii_found`` (values replaced). All other columns and rows stay; NULL
    text stays NULL with 0 values; an input column of that name is replaced.
    The key is a secret of the caller, any string; without one it is the
    session's (``session_key``). One projection: no shuffle, and texts
    without a digit, ``@`` or ``AKIA`` cost one scan."""
    key = session_key(docs.sparkSession) if key is None else key
    key = key.replace("\\", "\\\\").replace("'", "\\'")
    cols = [c for c in docs.columns if c.lower() != "pii_found"]
    found, cut, renewed = (free_name(docs, c) for c in ("__found", "__parts", "__new"))
    t = F.col(text)
    likely = t.rlike("[0-9@]|AKIA")
    df = docs.select(*map(quoted, cols), F.when(likely, F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1)))
                     .otherwise(F.array().cast("array<string>")).alias(found))
    df = df.withColumn(cut, F.expr(f"""transform({found}, m -> IF(m RLIKE '^[0-9]([ -]?[0-9]){{12}}[0-9 -]*$',
        {_number_parts('m')}, array(struct(m AS v, true AS pii))))"""))
    df = df.withColumn(renewed, F.expr(f"""transform({cut}, q -> transform(q, x ->
        struct(x.v AS v, IF(x.pii, {pseudonym('x.v', key)}, x.v) AS new)))"""))
    new = F.transform(renewed, lambda q: F.array_join(F.transform(q, lambda x: x["new"]), ""))
    parts = F.zip_with(F.split(t, ANY), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.size(F.filter(F.flatten(renewed), lambda x: x["v"] != x["new"]))
    return df.select(
        *[F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(t).alias(text) if c == text else F.col(quoted(c))
          for c in cols],
        F.when(F.size(found) > 0, changed).otherwise(0).alias("pii_found"))
