"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses, in SQL expressions only.

A value is found by a pattern, validated (check digit, octets, calendar, numbering plan) and replaced by another
valid value of its format: the format's values are numbered 0 ... a * b - 1 and a number's halves (l, r) run
through rounds of l += F(r) mod a, r += F(l) mod b, where F is a keyed SHA-256.  That is a permutation of the
format for every key, so equal values stay linked across documents and different ones stay different; layout
(spaces, brackets, padding) is kept.  What fails validation is left as it is.

Formats: payment card numbers (Luhn, first digit kept), IBANs (check digits; country and letters kept), North American
telephone numbers (area and exchange 200 to 999, with or without punctuation), other international numbers (their last
seven digits), social security numbers (with or without hyphens), IPv4 addresses, dates, and the local part of e-mail
addresses (letters and digits keep their class and case).

Dates of 1800 to 2099 move within their century, in any of these layouts: y-m-d, y/m/d, y.m.d, yyyymmdd (from 1900),
d/m/y or m/d/y with / . -, d/m/yy or m/d/yy (of 2000 to 2099), 4 March 2021, March 4, 2021 (or Mar, MARCH, march).  One date
has one pseudonym in all of them, with one exception: what reads only as m/d/y, the day being above 12, stays such a
string, so that strings of different dates never become one.  Days and months are padded as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default of the key; a deployment passes its own secret.
KEY = "seriesmill"
ROUNDS = 10

_MONTH = "(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def _either(pattern: str, seps: str) -> str:
    """The pattern with each of the separators in place of S."""
    return "(?:" + "|".join(pattern.replace("S", f"[{s}]") for s in seps) + ")"


EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])"
YMD = r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|" + _either("[0-9]{4}S[0-9]{1,2}S[0-9]{1,2}", "/.") + r")(?![0-9A-Za-z/-])"
COMPACT = r"(?<![0-9A-Za-z._/-])(?:19|20)[0-9]{6}(?![0-9A-Za-z_/-])"
SLASHED = r"(?<![0-9A-Za-z/.-])(?:" + _either("[0-9]{1,2}S[0-9]{1,2}S[0-9]{4}", "/.-") + r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2})(?![0-9A-Za-z/-])"
NAMED = rf"(?<![0-9A-Za-z/.-])(?:[0-9]{{1,2}} {_MONTH} [0-9]{{4}}|{_MONTH} [0-9]{{1,2}},? [0-9]{{4}})(?![0-9A-Za-z/-])"
SSN = r"(?<![0-9A-Za-z.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})(?!\.?[0-9A-Za-z-])"
NANP = r"(?<![0-9A-Za-z+.])(?:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}|[2-9][0-9]{2}[2-9][0-9]{6})(?!\.?[0-9A-Za-z])"
INTL = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, IBAN, IPV4, YMD, COMPACT, SLASHED, NAMED, SSN, NANP, INTL, CARD))
#: Turns of the walk back into the m/d/y strings; more than three in five days are such, so that none is left after so many.
WALK = 100


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prf(key: str, kind: str, turn: str, half: str) -> str:
    """A number below 2 ** 60 that depends on key, format, round and the other half."""
    return f"cast(conv(substr(sha2(concat({_sql_text(key + '|')}, {kind}, '|', {turn}, '|', {half}), 256), 1, 15), 16, 10) as bigint)"


def _feistel(x: str, a: str, b: str, kind: str, key: str) -> str:
    """The permutation of 0 ... a * b - 1 applied to ``x``; all are SQL expressions of bigint."""
    left = f"named_struct('l', (s.l + {_prf(key, kind, 'i', 's.r')}) % {a}, 'r', s.r)"
    right = f"named_struct('l', s.l, 'r', (s.r + {_prf(key, kind, 'i', 's.l')}) % {b})"
    start = f"named_struct('l', cast({x} div {b} as bigint), 'r', cast({x} % {b} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, {left}, {right}), s -> s.l * {b} + s.r)"


def _luhn_sum(digits: str, doubled: int) -> str:
    """Sum of the digits from the right, every second one (``doubled``: 0 or 1, which) doubled."""
    d = f"cast(substring({digits}, -k, 1) as int)"
    return f"aggregate(transform(sequence(1, length({digits})), k -> if(k % 2 = {doubled}, {d} * 2 - if({d} > 4, 9, 0), {d})), 0, (p, q) -> p + q)"


def _laid_out(token: str, digits: str) -> str:
    """The token with its digits replaced, in order, by ``digits``."""
    step = "if(c rlike '[0-9]', named_struct('o', concat(u.o, substr(v, u.k, 1)), 'k', u.k + 1), named_struct('o', concat(u.o, c), 'k', u.k))"
    return f"transform(array({digits}), v -> aggregate(split({token}, ''), named_struct('o', '', 'k', 1), (u, c) -> {step}, u -> u.o))[0]"


def _pad(x: str, n: str) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _card(key: str) -> str:
    half = "cast(pow(10, (length(x.d) - 2) div 2) as bigint)"
    rest = "cast(pow(10, (length(x.d) - 2) - (length(x.d) - 2) div 2) as bigint)"
    middle = "cast(substr(x.d, 2, length(x.d) - 2) as bigint)"
    new = _let("ab", f"named_struct('a', {half}, 'b', {rest})", _feistel(middle, "ab.a", "ab.b", "concat('card', length(x.d))", key))
    payload = f"concat(substr(x.d, 1, 1), {_pad(new, 'length(x.d) - 2')})"
    return _let("p", payload, _laid_out("x.t", f"concat(p, cast((10 - {_luhn_sum('p', 1)} % 10) % 10 as string))"))


def _nanp(key: str) -> str:
    d = "right(x.d, 10)"
    number = f"((cast(substr({d}, 1, 3) as bigint) - 200) * 800 + cast(substr({d}, 4, 3) as bigint) - 200) * 10000 + cast(substr({d}, 7, 4) as bigint)"
    new = _feistel(f"({number})", "80000", "80000", "'nanp'", key)
    digits = "concat(substr(x.d, 1, length(x.d) - 10), cast(y div 8000000 + 200 as string), cast((y div 10000) % 800 + 200 as string), " + _pad("y % 10000", "4") + ")"
    return _let("y", new, _laid_out("x.t", digits))


def _intl(key: str) -> str:
    new = _feistel("cast(right(x.d, 7) as bigint)", "1000", "10000", "concat('intl', length(x.d), substr(x.d, 1, length(x.d) - 7))", key)
    return _let("y", new, _laid_out("x.t", f"concat(substr(x.d, 1, length(x.d) - 7), {_pad('y', '7')})"))


def _ssn(key: str) -> str:
    area = "cast(substr(x.d, 1, 3) as bigint)"
    number = f"((({area} - if({area} > 666, 2, 1)) * 99 + cast(substr(x.d, 4, 2) as bigint) - 1) * 9999 + cast(substr(x.d, 6, 4) as bigint) - 1)"
    new = _feistel(number, "88902", "9999", "'ssn'", key)
    area_out = "y div (99 * 9999)"
    digits = f"concat({_pad(f'{area_out} + if({area_out} >= 665, 2, 1)', '3')}, {_pad('(y div 9999) % 99 + 1', '2')}, {_pad('y % 9999 + 1', '4')})"
    return _let("y", new, _laid_out("x.t", digits))


def _ipv4(key: str) -> str:
    number = "aggregate(split(x.t, '[.]'), cast(0 as bigint), (p, q) -> p * 256 + cast(q as bigint))"
    new = _feistel(f"({number})", "65536", "65536", "'ipv4'", key)
    return _let("y", new, "concat_ws('.', cast(y div 16777216 as string), cast((y div 65536) % 256 as string), cast((y div 256) % 256 as string), cast(y % 256 as string))")


def _moved_date(date: str, key: str) -> str:
    """A date's place in the permuted days of its century."""
    first = "make_date(year(w) - year(w) % 100, 1, 1)"
    a, b = "if(year(w) >= 2000, 75, 92)", "if(year(w) >= 2000, 487, 397)"  # 36,525 and 36,524 days
    moved = _let("ab", f"named_struct('a', {a}, 'b', {b})", _feistel(f"datediff(w, {first})", "ab.a", "ab.b", "concat('date', year(w) div 100)", key))
    return _let("w", date, f"date_add({first}, cast({moved} as int))")


def _part_like(value: str, part: str) -> str:
    """A day or month, padded if the part it replaces has two digits."""
    return f"if(length({part}) = 2, {_pad(value, '2')}, cast({value} as string))"


def _walked(date: str, key: str) -> str:
    """A date whose day is above 12, moved to another such: along the permutation until one is met again."""
    return f"aggregate(sequence(2, {WALK}), {_moved_date(date, key)}, (q, j) -> if(day(q) > 12, q, {_moved_date('q', key)}))"


def _slashed(key: str) -> str:
    sep = "regexp_extract(x.t, '[/.-]', 0)"
    year = f"if(length(x.f[2]) = 2, right(cast(year(n) as string), 2), {_pad('year(n)', '4')})"
    with_day_first = f"concat_ws({sep}, {_part_like('day(n)', 'x.f[0]')}, {_part_like('month(n)', 'x.f[1]')}, {year})"
    with_month_first = f"concat_ws({sep}, {_part_like('month(n)', 'x.f[0]')}, {_part_like('day(n)', 'x.f[1]')}, {year})"
    return f"if(x.dmy is not null, {_let('n', _moved_date('x.dmy', key), with_day_first)}, {_let('n', _walked('x.mdy', key), with_month_first)})"


def _ymd(key: str) -> str:
    sep = "regexp_extract(x.t, '[/.-]', 0)"
    parts = f"concat_ws({sep}, {_pad('year(n)', '4')}, {_part_like('month(n)', 'x.f[1]')}, {_part_like('day(n)', 'x.f[2]')})"
    return _let("n", _moved_date("x.ymd", key), f"if(length(x.t) = 8 and x.t rlike '^[0-9]+$', date_format(n, 'yyyyMMdd'), {parts})")


def _named(key: str) -> str:
    name = "regexp_extract(x.t, '[A-Za-z]+', 0)"
    full = f"date_format(n, if(length({name}) = 3 and lower({name}) <> 'may', 'MMM', 'MMMM'))"
    cased = f"case when {name} = upper({name}) then upper({full}) when {name} = lower({name}) then lower({full}) else {full} end"
    day = _part_like("day(n)", "regexp_extract(x.t, '([0-9]{1,2}),? ', 1)")
    comma = "if(instr(x.t, ',') > 0, ',', '')"
    day_first = f"concat_ws(' ', {day}, {cased}, {_pad('year(n)', '4')})"
    month_first = f"concat({cased}, ' ', {day}, {comma}, ' ', {_pad('year(n)', '4')})"
    return _let("n", _moved_date("x.named", key), f"if(x.t rlike '^[0-9]', {day_first}, {month_first})")


def _mod97(text: str) -> str:
    return f"aggregate(split({text}, ''), 0, (p, q) -> if(q rlike '[0-9]', (p * 10 + ascii(q) - 48) % 97, (p * 100 + ascii(q) - 55) % 97))"


def _iban(key: str) -> str:
    compact = "replace(x.t, ' ', '')"
    digits = f"regexp_replace(substr({compact}, 5), '[^0-9]', '')"
    n = "least(length(g), 16)"
    sizes = f"named_struct('a', cast(pow(10, {n} div 2) as bigint), 'b', cast(pow(10, {n} - {n} div 2) as bigint))"
    kind = f"concat('iban', substr({compact}, 1, 2), length(g), substr(g, 1, length(g) - {n}))"
    moved = _let("ab", sizes, _feistel(f"cast(right(g, {n}) as bigint)", "ab.a", "ab.b", kind, key))
    new = f"concat(substr(g, 1, length(g) - {n}), {_pad(moved, n)})"
    country = f"substr({compact}, 1, 2)"
    check = f"lpad(cast(98 - {_mod97(f'concat(y, {country}, chr(48), chr(48))')} as string), 2, '0')"
    return _let("g", digits, _let("v2", new, _let("y", _laid_out(f"substr({compact}, 5)", "v2"), _laid_out("x.t", f"concat({check}, v2)"))))


def _email(key: str) -> str:
    def shifted(half: str, other: str) -> str:
        by = "cast(conv(substr(h, 1 + 2 * (j % 32), 2), 16, 10) as int)"
        one = (
            f"case when c rlike '[a-z]' then char(97 + (ascii(c) - 97 + {by}) % 26) when c rlike '[A-Z]' then char(65 + (ascii(c) - 65 + {by}) % 26) "
            f"when c rlike '[0-9]' then char(48 + (ascii(c) - 48 + {by}) % 10) else c end"
        )
        stream = f"sha2(concat({_sql_text(key + '|mail|')}, length(x.m), '|', i, '|', {other}), 256)"
        return _let("h", stream, f"array_join(transform(split({half}, ''), (c, j) -> {one}), '')")

    a = f"named_struct('l', if(s.l = '', '', {shifted('s.l', 's.r')}), 'r', s.r)"
    b = f"named_struct('l', s.l, 'r', {shifted('s.r', 's.l')})"
    start = "named_struct('l', substr(x.m, 1, length(x.m) div 2), 'r', substr(x.m, length(x.m) div 2 + 1))"
    local = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, {b}, {a}), s -> concat(s.l, s.r))"
    return f"concat({local}, substr(x.t, length(x.m) + 1))"


def _token(key: str) -> str:
    """The replacement of a token, or the token where it isn't valid."""

    def full(pattern: str) -> str:
        return f"x.t rlike {_sql_text('^(?:' + pattern + ')$')}"

    century = "between 1800 and 2099"
    ssn_ok = "substr(x.d, 1, 3) not in ('000', '666') and x.d < '900' and substr(x.d, 4, 2) <> '00' and right(x.d, 4) <> '0000'"
    return f"""CASE
        WHEN x.m is not null THEN {_email(key)}
        WHEN x.t rlike '^[A-Z]{{2}}[0-9]' THEN if({_mod97("concat(substr(replace(x.t, ' ', ''), 5), substr(x.t, 1, 4))")} = 1 and x.t rlike '[0-9]{{4}}', {_iban(key)}, x.t)
        WHEN {full(IPV4)} THEN if(forall(split(x.t, '[.]'), q -> cast(q as int) <= 255), {_ipv4(key)}, x.t)
        WHEN {full(YMD)} OR {full(COMPACT)} THEN if(year(x.ymd) {century}, {_ymd(key)}, x.t)
        WHEN {full(SLASHED)} THEN if(year(coalesce(x.dmy, x.mdy)) {century}, {_slashed(key)}, x.t)
        WHEN {full(NAMED)} THEN if(year(x.named) {century}, {_named(key)}, x.t)
        WHEN {full(SSN)} THEN if({ssn_ok}, {_ssn(key)}, x.t)
        WHEN {full(NANP)} THEN {_nanp(key)}
        WHEN {full(INTL)} THEN if(length(x.d) between 8 and 15, {_intl(key)}, x.t)
        WHEN {_luhn_sum('x.d', 0)} % 10 = 0 AND x.d rlike '[1-9]' THEN {_card(key)}
        ELSE x.t END"""


def _fields(t: str) -> str:
    """A token with what its formats are checked by."""
    parts = f"split({t}, '[/.-]')"
    slashed = f"({t} rlike {_sql_text('^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}$')})"
    year = f"if(length({parts}[2]) = 2, concat('20', {parts}[2]), {parts}[2])"
    day = "try_to_date(concat_ws('-', {y}, {m}, {d}), 'yyyy-M-d')"
    name = f"lower(substr(regexp_extract({t}, '[A-Za-z]+', 0), 1, 3))"
    month = f"cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', {name}) + 2) div 3 as string)"
    return (
        f"named_struct('t', {t}, 'd', regexp_replace({t}, '[^0-9]', ''), 'm', if(instr({t}, '@') > 0, substring_index({t}, '@', 1), null), 'f', {parts}, "
        f"'ymd', case when {t} rlike '^[0-9]{{4}}[/.-]' then try_to_date(translate({t}, '/.', '--'), 'yyyy-M-d') when {t} rlike '^[0-9]{{8}}$' then try_to_date({t}, 'yyyyMMdd') end, "
        f"'dmy', if({slashed}, {day.format(y=year, m=parts + '[1]', d=parts + '[0]')}, null), "
        f"'mdy', if({slashed}, {day.format(y=year, m=parts + '[0]', d=parts + '[1]')}, null), "
        f"'named', if({t} rlike ' [0-9]{{4}}$' and {t} rlike '[A-Za-z]{{3}} ', {day.format(y=f'right({t}, 4)', m=month, d=f"regexp_extract({t}, '([0-9]{{1,2}}),? ', 1)")}, null))"
    )


def pseudonymise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """doc_id, text, n_found (well-formed values), n_replaced (valid ones) of every row.

    Null text stays null, with no values; texts without a digit or @ are passed on.  Repeated rows give repeated
    results, an empty table none.  One projection over the whole table: no Python, no shuffle, nothing collected.
    """
    pattern = _sql_text(ANY)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("raw"))
    found = f"if(raw rlike '[0-9@]', regexp_extract_all(raw, {pattern}, 0), array())"
    rows = rows.withColumn("tokens", F.expr(found))
    rows = rows.withColumn("new", F.expr(f"if(size(tokens) = 0, tokens, transform(transform(tokens, t -> {_fields('t')}), x -> {_token(key)}))"))
    between = f"split(raw, {pattern}, -1)"
    text = f"if(coalesce(size(tokens), 0) <= 0, raw, array_join(zip_with({between}, new, (p, q) -> concat(p, coalesce(q, ''))), ''))"
    changed = "coalesce(size(filter(zip_with(tokens, new, (p, q) -> p <> q), d -> d)), 0)"
    return rows.select("doc_id", F.expr(text).alias("text"), F.greatest(F.expr("coalesce(size(tokens), 0)"), F.lit(0)).cast("long").alias("n_found"), F.greatest(F.expr(changed), F.lit(0)).cast("long").alias("n_replaced"))
