"""PII: format-preserving Feistel pseudonyms, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What a match of each kind looks like; the order is that of preference. Each starts where no
#: run of its own characters is cut, so the scan is linear in the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\d(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _sql_string(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(kind: str, left: str, right: str, a: str, b: str, key: str) -> str:
    """SQL for the pair (left in 0..a-1, right in 0..b-1), keyed-permuted: a struct l, r.

    Rounds add a keyed hash of one half to the other modulo its size, so the pair is permuted
    for any two sizes, without cycle walking."""
    f = f"cast(conv(substring(sha2(concat_ws(':', {_sql_string(key)}, '{kind}', i, {{}}), 256), 1, 14), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> "
        f"if(i % 2 = 1, named_struct('l', pmod(s.l + {f.format('s.r')}, cast({a} as bigint)), 'r', s.r), "
        f"named_struct('l', s.l, 'r', pmod(s.r + {f.format('s.l')}, cast({b} as bigint)))))"
    )


def _with(value: str, name: str, body: str) -> str:
    """SQL that binds a value to a name, so that it is written and computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _email(m: str, key: str) -> str:
    """The local part as a string, half by half; letters stay letters of their case, digits
    digits, the rest and the domain as they are."""
    k = "cast(conv(substring(h, pmod(j, 16) * 4 + 1, 4), 16, 10) as int) + j"
    shift = (
        "array_join(transform(split({}, ''), (c, j) -> case "
        + " ".join(f"when c rlike '^[{lo}-{hi}]' then chr({ord(lo)} + (ascii(c) - {ord(lo)} + {k}) % {ord(hi) - ord(lo) + 1})" for lo, hi in ("09", "az", "AZ"))
        + " else c end), '')"
    )

    def moved(one: str, other: str) -> str:
        return _with(f"sha2(concat_ws(':', {_sql_string(key)}, 'email', i, lower(d), {other}), 256)", "h", shift.format(one))

    rounds = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substring(p, 1, length(p) div 2), 'r', substring(p, length(p) div 2 + 1)), (s, i) -> "
        f"if(i % 2 = 1, named_struct('l', {moved('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 's.l')})))"
    )
    return _with(f"substring_index({m}, '@', 1)", "p", _with(f"substring_index({m}, '@', -1)", "d", _with(rounds, "x", "concat(x.l, x.r, '@', d)")))


def _ip(m: str, key: str) -> str:
    o = [f"cast(split({m}, '[.]')[{i}] as bigint)" for i in range(4)]
    return _with(feistel("ip", f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", "65536", "65536", key), "x", "concat_ws('.', x.l div 256, x.l % 256, x.r div 256, x.r % 256)")


def _ssn(m: str, key: str) -> str:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area = f"cast(substring({m}, 1, 3) as bigint)"
    left = f"{area} - if({area} > 666, 2, 1)"
    right = f"(cast(substring({m}, 5, 2) as bigint) - 1) * 9999 + cast(substring({m}, 8, 4) as bigint) - 1"
    return _with(
        feistel("ssn", left, right, "898", "99 * 9999", key), "x", "concat(lpad(x.l + if(x.l >= 665, 2, 1), 3, '0'), '-', lpad(x.r div 9999 + 1, 2, '0'), '-', lpad(x.r % 9999 + 1, 4, '0'))"
    )


def _fill(m: str, digits: str) -> str:
    """The digits of m, one after the other, replaced by other digits; the rest stays."""
    return f"aggregate(split({m}, ''), named_struct('t', '', 'k', 1), (s, c) -> if(c rlike '[0-9]', named_struct('t', concat(s.t, substring({digits}, s.k, 1)), 'k', s.k + 1), named_struct('t', concat(s.t, c), 'k', s.k))).t"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _phone(m: str, key: str) -> str:
    """Ten digits; area and exchange codes that start with 2-9 get such codes."""

    def low(code: str) -> str:
        return f"if({code} >= 200, 200, 0)"

    def size(code: str) -> str:
        return f"if({code} >= 200, 800, 200)"

    area, exchange = "cast(substring(n, 1, 3) as bigint)", "cast(substring(n, 4, 3) as bigint)"
    pair = feistel("phone", f"{area} - {low(area)}", f"({exchange} - {low(exchange)}) * 10000 + cast(substring(n, 7, 4) as bigint)", size(area), f"{size(exchange)} * 10000", key)
    made = f"concat(lpad(x.l + {low(area)}, 3, '0'), lpad(x.r div 10000 + {low(exchange)}, 3, '0'), lpad(x.r % 10000, 4, '0'))"
    return _with(_digits(m), "n", _with(pair, "x", _with(made, "y", _fill(m, "y"))))


def _luhn(digits: str, odd: int) -> str:
    """Luhn sum; odd: 1 if the last digit is the first doubled one."""
    v = f"cast(substring({digits}, length({digits}) - i + 1, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = {odd}, {v} * 2 - if({v} > 4, 9, 0), {v}))"


def _card(m: str, key: str) -> str:
    """All digits but the first, which names the network, and the last, which is computed
    anew. A number whose check digit is wrong isn't a card's and stays."""
    half = "(length(n) - 2) div 2"
    pair = feistel("card", f"substring(n, 2, {half})", f"substring(n, 2 + {half}, length(n) - 2 - {half})", f"cast(pow(10D, {half}) as bigint)", f"cast(pow(10D, length(n) - 2 - {half}) as bigint)", key)
    made = f"concat(substring(n, 1, 1), lpad(x.l, {half}, '0'), lpad(x.r, length(n) - 2 - {half}, '0'))"
    whole = _with(made, "y", _with(f"concat(y, (10 - {_luhn('y', 1)} % 10) % 10)", "z", _fill(m, "z")))
    return _with(_digits(m), "n", f"if({_luhn('n', 0)} % 10 = 0, {_with(pair, 'x', whole)}, {m})")


def _is_card(m: str) -> str:
    return _with(_digits(m), "n", f"{_luhn('n', 0)} % 10 = 0")


def _is_date(m: str) -> str:
    """Whether `_date` takes it for a date, in one order or the other."""
    year = f"if({m} rlike '^[0-9]{{4}}', substring({m}, 1, 4), substring({m}, 7, 4))"
    day_first, month_first = (f"try_to_date(concat_ws('-', substring({m}, 7, 4), substring({m}, {a}, 2), substring({m}, {b}, 2)), 'yyyy-MM-dd')" for a, b in ((4, 1), (1, 4)))
    return f"({year} >= '0100' and case when {m} rlike '-' then try_to_date({m}, 'yyyy-MM-dd') else coalesce({day_first}, {month_first}) end is not null)"


def _date(m: str, key: str) -> str:
    """A day of the same century. Day-month-year is read first, month-day-year where that is
    no date; the order stays. What is no date in either order stays.

    Strings that can only be read month first (the day is 13 or more) are a format of their own:
    they are permuted among such strings, as any other day would print as a string that is read
    day first, and stand for two days."""
    year = f"if({m} rlike '^[0-9]{{4}}', substring({m}, 1, 4), substring({m}, 7, 4))"
    iso = f"try_to_date({m}, 'yyyy-MM-dd')"
    day_first = f"try_to_date(concat_ws('-', substring({m}, 7, 4), substring({m}, 4, 2), substring({m}, 1, 2)), 'yyyy-MM-dd')"
    month_first = f"try_to_date(concat_ws('-', substring({m}, 7, 4), substring({m}, 1, 2), substring({m}, 4, 2)), 'yyyy-MM-dd')"
    start = f"make_date(cast({year} as int) div 100 * 100, 1, 1)"
    # centuries with a leap first year have 36525 days, the others 36524
    leap = f"(cast({year} as int) div 100) % 4 = 0"
    rows = f"if({leap}, 487, 397)"
    pair = feistel("date", f"o div {rows}", f"o % {rows}", f"if({leap}, 75, 92)", rows, key)
    order = f"case when {m} rlike '-' then 'yyyy-MM-dd' else concat('dd', substring({m}, 3, 1), 'MM', substring({m}, 3, 1), 'yyyy') end"
    new = _with(f"datediff(d, {start})", "o", _with(pair, "x", f"date_format(date_add({start}, cast(x.l * {rows} + x.r as int)), {order})"))
    # 22125 or 22124 days from the 13th on: a day's place among them is its place less 12 for each
    # month so far. The other way round, of some months around the expected one just one fits.
    months = "(year({0}) % 100 * 12 + month({0}))"
    late_rows = f"if({leap}, 177, 5531)"
    late_pair = feistel("late date", f"o div {late_rows}", f"o % {late_rows}", f"if({leap}, 125, 4)", late_rows, key)
    tried = f"transform(sequence(cast(n div 18.43 as int) - 4, cast(n div 18.43 as int) + 4), k -> named_struct('k', k, 'd', date_add({start}, cast(n + 12 * k as int))))"
    day = f"element_at(filter({tried}, e -> {months.format('e.d')} = e.k and year(e.d) div 100 = cast({year} as int) div 100 and day(e.d) > 12), 1).d"
    late_order = f"concat('MM', substring({m}, 3, 1), 'dd', substring({m}, 3, 1), 'yyyy')"
    late = _with(f"datediff(d, {start}) - 12 * {months.format('d')}", "o", _with(late_pair, "x", _with(f"x.l * {late_rows} + x.r", "n", f"date_format({day}, {late_order})")))
    read = f"case when {m} rlike '-' then {iso} else {day_first} end"
    return _with(read, "d", f"if(d is not null and {year} >= '0100', {new}, {_with(month_first, 'd', f'if(d is null or {year} < \'0100\' or {m} rlike \'-\', {m}, {late})')})")


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(m: str) -> str:
    return "case " + " ".join(f"when {m} rlike {_sql_string(f'^(?:{p})$')} then '{k}'" for k, p in PATTERNS.items()) + " end"


def pseudonym(m: str, key: str) -> Column:
    """The pseudonym of a string column that is one whole match of a kind; others stay."""
    return F.expr(f"case {' '.join(f'when {m} rlike {_sql_string(f"^(?:{p})$")} then {_MAKERS[k](m, key)}' for k, p in PATTERNS.items())} else {m} end")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with validated private values of the text replaced by pseudonyms, and found: a
    struct kind, value, pseudonym for each validated value in text order.

    Values are e-mail addresses (the local part), IPv4 addresses, dates, social security
    numbers, ten-digit phone numbers and card numbers with a right check digit. Each is
    permuted with a keyed Feistel network over all values of its format, so equal values get
    equal pseudonyms in all documents, different ones different pseudonyms, and the pseudonym
    is valid in the same format. Dates that can only be read month first are a format of their own. A permutation may map a value to itself; that is its pseudonym.

    Runs in the scan's stage, without a shuffle or Python. Null text stays null with nothing
    found; an empty table gives no rows; other columns are carried on, one named found is
    replaced. The key is part of the query's plan: keep plans as secret as the key.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(text_col).cast("string")
    matches, gaps = F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), F.split(text, _ANY, -1)
    maybe = text.rlike(r"\d[ .-]?\d|@")  # every kind has one
    given, made = (_unused(docs, name) for name in ("matches", "made"))
    out = docs.withColumn(given, F.when(maybe, matches).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(made, F.expr(f"transform({given}, m -> named_struct('kind', {_kind('m')}, 'value', m, 'pseudonym', {_inner(key)}))"))
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.col(f"{made}.pseudonym"), lambda g, p: F.array(g, F.coalesce(p, F.lit(""))))), "")
    new = F.when(F.size(made) > 0, joined).otherwise(text)
    # a value may be its own pseudonym, so what stays the same is validated once more
    found = F.expr(f"filter({made}, x -> x.value != x.pseudonym or case x.kind when 'card' then {_is_card('x.value')} when 'date' then {_is_date('x.value')} else true end)")
    return out.withColumns({text_col: new, "found": F.coalesce(found, F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>"))}).drop(given, made)


def _unused(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _inner(key: str) -> str:
    return "case " + " ".join(f"when {_kind_is(k)} then {make('m', key)}" for k, make in _MAKERS.items()) + " else m end"


def _kind_is(kind: str) -> str:
    return f"m rlike {_sql_string(f'^(?:{PATTERNS[kind]})$')}"
