"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats of personal data. Order matters: the first that fits at a place wins.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
HEX_SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])"
PHONE = r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
ID_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9/-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, HEX_SECRET, IPV4, PHONE, ID_NUMBER, DATE, CARD))
#: Dates from 1900-01-01 to 2099-12-31 are 73,049 days, 4,297 times 17.
DAYS, DAYS_LOW = 73049, 17
ROUNDS = 8
#: Setting of the session that holds the secret key.
KEY_SETTING = "spark.evenstride.pii.key"
_own_key = secrets.token_hex(16)


def secret_key(key: str | None = None) -> str:
    """The key given, else that of the session's setting, else one drawn at random for this process: never one that others know."""
    spark = SparkSession.getActiveSession()
    return key or (spark.conf.get(KEY_SETTING, None) if spark else None) or _own_key


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(p: str, kind: str, key: str) -> str:
    """SQL that permutes ``p array<struct<v, r>>``: each place holds a number v below its radix r.

    Alternating rounds: places of one parity get a keyed hash of all places of the other parity added, modulo their own radix. Each
    round can be undone, so the whole is a permutation of the values with these radices, keyed by ``key`` and ``kind`` (SQL as well).
    """
    other = "array_join(transform(filter(acc, (y, j) -> j % 2 <> rd % 2), y -> cast(y.v as string)), ',')"
    prf = f"cast(conv(substring(sha2(concat_ws('|', {_sql(key)}, {kind}, cast(size(acc) as string), cast(rd as string), cast(i as string), {other}), 256), 1, 12), 16, 10) as bigint)"
    step = f"transform(acc, (x, i) -> if(i % 2 = rd % 2, named_struct('v', (x.v + {prf}) % x.r, 'r', x.r), x))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {p}, (acc, rd) -> {step})"


def _place(v: str, r: str) -> str:
    return f"named_struct('v', cast({v} as bigint), 'r', cast({r} as bigint))"


def _chars(m: str, kind: str, key: str, hexa: bool = False) -> str:
    """Permute a string place by place: digits stay digits, letters stay letters of their case (hexadecimal ones up to f), others stand still."""
    letters = 6 if hexa else 26
    a = "ascii(c)"
    r = f"case when c between '0' and '9' then 10 when c between 'a' and 'z' then {letters} when c between 'A' and 'Z' then {letters} else 1 end"
    v = f"case when c between '0' and '9' then {a} - 48 when c between 'a' and 'z' then {a} - 97 when c between 'A' and 'Z' then {a} - 65 else 0 end"
    base = "case when c between '0' and '9' then 48 when c between 'a' and 'z' then 97 else 65 end"
    perm = feistel(f"transform(cs, c -> {_place(v, r)})", kind, key)
    # places that can't change are left out of the halves: they would only weaken the mixing of short values
    return f"transform(array(split({m}, '')), cs -> transform(array({perm}), pp -> array_join(transform(cs, (c, i) -> if(pp[i].r = 1, c, chr(({base}) + pp[i].v))), ''))[0])[0]"


def _digits(m: str) -> str:
    return f"transform(split(regexp_replace({m}, '[^0-9]', ''), ''), c -> cast(c as bigint))"


def _refill(m: str, ds: str) -> str:
    """Put digits back into the places of ``m`` that hold digits."""
    return f"transform(array({ds}), dd -> array_join(transform(split({m}, ''), (c, i) -> if(c between '0' and '9', cast(dd[length(regexp_replace(substring({m}, 1, i + 1), '[^0-9]', '')) - 1] as string), c)), ''))[0]"


def _luhn_last(a: str) -> str:
    """The check digit that the digits ``a`` call for."""
    odd = f"transform({a}, (v, i) -> if((size({a}) - 1 - i) % 2 = 0, if(2 * v > 9, 2 * v - 9, 2 * v), v))"
    return f"((10 - aggregate({odd}, 0L, (s, v) -> s + v) % 10) % 10)"


def _card(m: str, key: str) -> str:
    """All digits but the last are permuted; the last keeps its distance from the Luhn digit, so valid numbers (distance 0) stay valid."""
    head, head2 = "slice(ds, 1, size(ds) - 1)", "transform(pp, x -> x.v)"
    perm = feistel(f"transform({head}, v -> {_place('v', '10')})", "'card'", key)
    last = f"(({_luhn_last('hh')} + element_at(ds, -1) - {_luhn_last(head)} + 10) % 10)"
    ds2 = f"transform(array({_digits(m)}), ds -> transform(array({perm}), pp -> transform(array({head2}), hh -> concat(hh, array(cast({last} as bigint))))[0])[0])[0]"
    return _refill(m, ds2)


def _phone(m: str, key: str) -> str:
    """The ten national digits are permuted; a country code stays. A leading digit of the area stays among 2-9 or among 0-1."""
    place = f"if(i = 0, if(v >= 2, {_place('v - 2', '8')}, {_place('v', '2')}), {_place('v', '10')})"
    perm = feistel(f"transform(slice(ds, size(ds) - 9, 10), (v, i) -> {place})", "'phone'", key)
    back = "transform(pp, (x, i) -> if(i = 0 and x.r = 8, x.v + 2, x.v))"
    ds2 = f"transform(array({_digits(m)}), ds -> transform(array({perm}), pp -> concat(slice(ds, 1, size(ds) - 10), {back}))[0])[0]"
    return _refill(m, ds2)


def _id_number(m: str, key: str) -> str:
    """Area, group and serial of an id number: those that can be issued (area neither 000, 666 nor 9xx, group not 00, serial not 0000) stay so, others stay others."""
    a, g, z = (f"cast({x} as bigint)" for x in (f"substring({m}, 1, 3)", f"substring({m}, 5, 2)", f"substring({m}, 8, 4)"))
    area = f"if({a} between 1 and 899 and {a} <> 666, {_place(f'{a} - 1 - if({a} > 666, 1, 0)', '898')}, {_place(f'case {a} when 0 then 0 when 666 then 1 else {a} - 898 end', '102')})"
    rest = [f"if({x} = 0, {_place('0', '1')}, {_place(f'{x} - 1', str(r))})" for x, r in ((g, 99), (z, 9999))]
    back = "if(pp[0].r = 898, pp[0].v + 1 + if(pp[0].v >= 665, 1, 0), case pp[0].v when 0 then 0 when 1 then 666 else pp[0].v + 898 end)"
    part = lambda i: f"pp[{i}].v + if(pp[{i}].r = 1, 0, 1)"
    return f"transform(array({feistel(f'array({area}, {rest[0]}, {rest[1]})', _sql('id'), key)}), pp -> format_string('%03d-%02d-%04d', {back}, {part(1)}, {part(2)}))[0]"


def _ip(m: str, key: str) -> str:
    perm = feistel(f"transform(split({m}, '[.]'), c -> {_place('c', '256')})", "'ipv4'", key)
    return f"array_join(transform({perm}, x -> cast(x.v as string)), '.')"


def _date(m: str, key: str) -> str:
    """A day that exists becomes another in the same format; a day that doesn't exist stays. Day-first or month-first is told by which
    reading exists (day first where both do, for dots; month first for slashes)."""
    def as_format(f: str) -> str:
        day = f"datediff(cast(try_to_timestamp({m}, '{f}') as date), date'1900-01-01')"
        perm = feistel(f"array({_place(f'd div {DAYS_LOW}', str(DAYS // DAYS_LOW))}, {_place(f'd % {DAYS_LOW}', str(DAYS_LOW))})", "'date'", key)
        new = f"date_format(date_add(date'1900-01-01', cast(pp[0].v * {DAYS_LOW} + pp[1].v as int)), '{f}')"
        return f"when try_to_timestamp({m}, '{f}') is not null then transform(array({day}), d -> transform(array({perm}), pp -> {new})[0])[0]"

    iso = f"case {as_format('yyyy-MM-dd')} {as_format('yyyy/MM/dd')} else {m} end"
    dots = f"case {as_format('dd.MM.yyyy')} {as_format('MM.dd.yyyy')} else {m} end"
    slashes = f"case {as_format('MM/dd/yyyy')} {as_format('dd/MM/yyyy')} else {m} end"
    return f"case when {m} rlike '^[0-9]{{4}}' then {iso} when {m} like '%.%' then {dots} else {slashes} end"


def _pseudonym(m: str, key: str) -> str:
    full = lambda p: _sql(f"^(?:{p})$")
    at = f"locate('@', {m})"
    mail = f"concat('email', lower(substring({m}, {at})))"  # names of different domains are permuted differently
    return (
        f"case when {at} > 0 then concat({_chars(f'substring({m}, 1, {at} - 1)', mail, key)}, substring({m}, {at}))"
        f" when {m} rlike {full(HEX_SECRET)} and {m} rlike '[A-Fa-f]' then {_chars(m, _sql('hex'), key, True)}"
        f" when {m} rlike {full(IPV4)} then {_ip(m, key)}"
        f" when {m} rlike {full(DATE)} then {_date(m, key)}"
        f" when {m} rlike {full(PHONE)} then {_phone(m, key)}"
        f" when {m} rlike {full(ID_NUMBER)} then {_id_number(m, key)}"
        f" when {m} rlike {full(CARD)} then {_card(m, key)}"
        f" else {_chars(m, _sql('hex'), key)} end"
    )


def pseudonymise(text: str, key: str | None = None) -> Column:
    """The text of SQL expression ``text`` with its e-mail names, secrets, addresses, phone and card numbers and dates replaced.

    A text is split at what matches, each match is permuted within its format, and the pieces are joined again; so everything else stays
    as it was, character by character, and equal values become equal pseudonyms in all documents under the same key (see ``secret_key``).
    A null stays null.
    """
    p, key = _sql(PATTERN), secret_key(key)
    swap = f"transform(array(named_struct('cut', split({text}, {p}, -1), 'hit', regexp_extract_all({text}, {p}, 0))), z -> array_join(transform(z.cut, (c, i) -> if(i = 0, c, concat(transform(array(z.hit[i - 1]), m -> {_pseudonym('m', key)})[0], c))), ''))[0]"
    return F.expr(f"case when {text} rlike '[0-9@]' and {text} rlike {p} then {swap} else {text} end")


def count_pii(text: str) -> Column:
    return F.expr(f"case when {text} rlike '[0-9@]' then coalesce(regexp_count({text}, {_sql(PATTERN)}), 0) else 0 end").cast("long")


def pseudonymise_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with ``text`` pseudonymised and ``n_chars`` (if it is there) of the new text; all other columns pass.

    A null text stays null, an empty one empty; rows are neither dropped nor merged, so ties, repeats and empty tables need no rule.
    """
    out = docs.withColumn("text", pseudonymise("text", key))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
