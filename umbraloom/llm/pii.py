"""Format-preserving pseudonyms for personal data, in Spark SQL functions alone.

One pattern finds candidates; each is validated (check digits, ranges, calendar) and, if valid, replaced. Numbers and dates
go through a keyed Feistel network over their own digits, so a card number becomes another valid card number, a date
another date of the same format, and equal values become equal pseudonyms in every document; a day is the same day in every format.
Addresses and secrets, which have no numbers to permute, are replaced by keyed digests of the same shape. All keyed
functions are nested hashes with two keys derived from the given one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "demonstration key"  # production passes its own
ROUNDS = 8
#: Ranges of days, within which dates are permuted: (first day, number of days). Any date of the calendar from 0001 to 9999 lies in one.
RANGES = (("1900-01-01", 73049), ("0001-01-01", 693595), ("2100-01-01", 2885415))
WALK = 64  # steps of cycle walking: a failure has odds below 1e-12

#: A name of a secret, in quotes or not, and what stands between it and its value; or the name of a bearer's token.
SECRET_NAME = r"(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)[\x22\x27]?+\h*+[=:]\h*+(?:\R\h*+)?+(?:(?i:bearer)\h++)?+|(?i:bearer)\h++(?=[A-Za-z0-9._~+/-]{16}))"
SECRET_HEAD = rf"^{SECRET_NAME}[\x22\x27]?"
#: A value in quotes ends at the closing one (or the text's end), any other at white space or a quote.
SECRET_VALUE = r"(?:\x22(?!\s)[^\x22\r\n]{6,}(?=\x22|$)|\x27(?!\s)[^\x27\r\n]{6,}(?=\x27|$)|[\x22\x27]?[^\s\x22\x27]{6,})"
#: Lengths of the countries' IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_KNOWN = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")


def _iban_of(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: A known country's number has its length, so it takes no words behind it; any other is as long as can be.
IBAN = "|".join([*(_iban_of(n, c) for n, c in IBAN_LENGTHS.items()), r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"])
#: Kinds in the order in which they are tried, with their patterns. Each starts and ends apart from what could continue it.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}\p{M}._%+-])[\p{L}\p{N}\p{M}._%+-]++@[\p{L}\p{N}][\p{L}\p{N}\p{M}.-]*\.\p{L}{2,}(?![\p{L}\p{N}\p{M}-])",
    "iban": rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}::?|::)(?:[0-9A-Fa-f]{1,4}::?){1,6}(?:[0-9A-Fa-f]{1,4})?(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:::|[0-9A-Fa-f]{1,4}::)[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|\(0[1-9][0-9]{1,4}\) ?[0-9]{6,8}|0[1-9][0-9]{1,3}[/ ][0-9]{7,8})(?![0-9A-Za-z])",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z0-9]){SECRET_NAME}{SECRET_VALUE}",
}
KINDS = tuple(PATTERNS)
#: A text without any of these has no candidate.
GATE = r"[0-9@=:]|AKIA"


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _mac(text: str) -> str:
    """SQL for the keyed digest of a text, as 64 hexadecimal digits."""
    return f"sha2(concat(_outer, sha2(concat(_inner, {text}), 256)), 256)"


def keys(key: str) -> dict[str, str]:
    """The inner and the outer key of the nested hash."""
    return {f"_{name}": hashlib.sha256(f"{name}|{key}".encode()).hexdigest() for name in ("inner", "outer")}


def _feistel(a: str, b: str, m: str, n: str, tweak: str) -> str:
    """SQL for the struct (a, b), a < m and b < n, after a keyed permutation of all such pairs."""
    mix = lambda x, mod: f"pmod(cast(conv(substr({_mac(f"concat_ws('|', {tweak}, i, {x})")}, 1, 15), 16, 10) as bigint), {mod})"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('a', (s.a + {mix('s.b', m)}) % {m}, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {mix('s.a', n)}) % {n})))"
    )


def _permuted(digits: str, tweak: str) -> str:
    """SQL for the permutation of a string of 2 to 34 digits among those of its length."""
    u, v = f"(length({digits}) div 2)", f"(length({digits}) - length({digits}) div 2)"
    power = lambda x: f"cast(pow(10, {x}) as bigint)"
    run = _feistel(f"substr({digits}, 1, {u})", f"substr({digits}, {u} + 1)", power(u), power(v), f"concat('{tweak}', length({digits}))")
    return f"transform(array({run}), s -> concat(lpad(cast(s.a as string), {u}, '0'), lpad(cast(s.b as string), {v}, '0')))[0]"


def _permuted_letters(letters: str, tweak: str) -> str:
    """SQL for the permutation of a string of A-Z among those of its length, up to 24."""
    u, v = f"(length({letters}) div 2)", f"(length({letters}) - length({letters}) div 2)"
    power = lambda x: f"cast(pow(26, {x}) as bigint)"
    number = lambda x: f"aggregate(filter(split({x}, ''), c -> c != ''), cast(0 as bigint), (t, c) -> t * 26 + ascii(c) - 65)"
    text = lambda x, size: f"if({size} = 0, '', array_join(transform(sequence(1, greatest({size}, 1)), p -> chr(65 + ({x} div cast(pow(26, {size} - p) as bigint)) % 26)), ''))"
    run = _feistel(number(f"substr({letters}, 1, {u})"), number(f"substr({letters}, {u} + 1)"), power(u), power(v), f"concat('{tweak}', length({letters}))")
    return f"transform(array({run}), s -> concat({text('s.a', u)}, {text('s.b', v)}))[0]"


def _let(value: str, name: str, then: str) -> str:
    """SQL that computes a value once and uses it by a name."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _filled(shape: str, digits: str, kind: str = "[0-9]") -> str:
    """SQL for a text whose digits, or characters of another kind, are replaced, one after the other, by others."""
    before = f"regexp_replace(substr({shape}, 1, p), '{kind.replace('[', '[^')}', '')"
    return f"array_join(transform(sequence(1, length({shape})), p -> if(substr({shape}, p, 1) rlike '{kind}', substr({digits}, length({before}), 1), substr({shape}, p, 1))), '')"


def _luhn(digits: str) -> str:
    d = f"cast(substr({digits}, p, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, p) -> t + if((length({digits}) - p) % 2 = 1, 2 * {d} - if({d} > 4, 9, 0), {d}))"


def _mod97(text: str) -> str:
    return f"aggregate(split({text}, ''), 0, (t, c) -> if(c = '', t, if(c rlike '[0-9]', (t * 10 + ascii(c) - 48) % 97, (t * 100 + ascii(c) - 55) % 97)))"


def _walk(start: str, step, ok) -> str:
    """SQL that applies a permutation until its value is in the wanted set, which makes it one of that set."""
    return f"aggregate(sequence(1, {WALK}), {step(start)}, (w, k) -> if({ok('w')}, w, {step('w')}))"


def _date(form: str) -> str:
    """SQL for a date of a format, or null if it is none. Days up to the 12th stay such, as do later ones, so which part is the month can be told as before."""
    side = lambda days: int(days**0.5) + 1
    ranges = " ".join(f"when d {'>=' if first > '1900' else '<'} date'{first if first > '1900' else '1900-01-01'}' {'and d < date' + chr(39) + '2100-01-01' + chr(39) if first == '1900-01-01' else ''} then named_struct('first', date'{first}', 'days', {days}, 'side', {side(days)})" for first, days in RANGES)
    step = lambda x: _let(_feistel(f"({x}) div g.side", f"({x}) % g.side", "g.side", "g.side", "concat('date', g.first)"), "e", "cast(e.a * g.side + e.b as int)")
    ok = lambda w: f"({w} < g.days and (day(date_add(g.first, {w})) > 12) = (day(d) > 12))"
    walk = f"aggregate(sequence(1, {WALK}), {step('datediff(d, g.first)')}, (w, k) -> if({ok('w')}, w, {step('w')}))"
    return _let(f"to_date(try_to_timestamp(m, '{form}'))", "d", f"if(d is null, null, {_let(f'case {ranges} end', 'g', f'date_format(date_add(g.first, {walk}), {chr(39)}{form}{chr(39)})')})")


def pseudonym(kind: str) -> str:
    """SQL for the pseudonym of a candidate `m` of a kind, or null if it is not valid."""
    if kind == "email":
        return f"if(m like '%..%', null, concat('user', substr({_mac("concat('email|', lower(m))")}, 1, 16), '@mail.invalid'))"
    if kind == "iban":
        bban, head = "substr(c, 5)", "substr(c, 1, 2)"
        digits = f"if(length({_digits(bban)}) > 1, {_filled(bban, _let(_digits(bban), 'g', _permuted('g', 'iban')))}, {bban})"
        letters = lambda x: f"regexp_replace({x}, '[^A-Z]', '')"
        both = _let(digits, "b", f"if(length({letters('b')}) > 0, {_filled('b', _let(letters('b'), 'l', _permuted_letters('l', 'iban')), '[A-Z]')}, b)")
        new = _let(both, "o", f"concat({head}, lpad(cast(98 - {_mod97(f'concat(o, {head}, {chr(39)}00{chr(39)})')} as string), 2, '0'), o)")
        ok = _let("replace(e, ' ', '')", "c", f"length(c) between 15 and 34 and {_mod97('concat(substr(c, 5), substr(c, 1, 4))')} = 1")
        ends = f"filter(transform(sequence(0, length(m) - 1), p -> substr(m, 1, length(m) - p)), e -> (e = m or substr(m, length(e) + 1, 1) = ' ' and m not rlike '^({IBAN_KNOWN})') and {ok})"
        done = _let("replace(e, ' ', '')", "c", f"concat({_let(new, 'z', _filled('e', 'z', '[0-9A-Z]'))}, substr(m, length(e) + 1))")
        return _let(ends, "v", f"if(size(v) > 0, {_let('v[0]', 'e', done)}, null)")  # of an unknown country, the longest that is valid
    if kind == "ip":
        octets = "transform(split(m, '[.]'), x -> cast(x as int))"
        run = _let(_feistel("q[0] * 256 + q[1]", "q[2] * 256 + q[3]", "65536", "65536", "'ip'"), "e", "concat_ws('.', e.a div 256, e.a % 256, e.b div 256, e.b % 256)")
        return _let(octets, "q", f"if(forall(q, x -> x < 256), {run}, null)")
    if kind == "ipv6":  # the first half by itself, so that addresses of one network stay in one
        groups = "split(replace(m, '::', concat(':', repeat('0:', greatest(0, 8 - size(filter(split(m, ':'), x -> x != '')))))), ':')"
        words = _let(f"filter({groups}, x -> x != '')", "q", "if(size(q) = 8, transform(sequence(0, 3), k -> cast(conv(q[2 * k], 16, 10) as bigint) * 65536 + cast(conv(q[2 * k + 1], 16, 10) as bigint)), null)")
        shown = lambda e: f"lower(concat_ws(':', conv({e}.a div 65536, 10, 16), conv({e}.a % 65536, 10, 16), conv({e}.b div 65536, 10, 16), conv({e}.b % 65536, 10, 16)))"
        net = _feistel("w[0]", "w[1]", "4294967296", "4294967296", "'net'")
        host = _feistel("w[2]", "w[3]", "4294967296", "4294967296", "concat('host', w[0], '|', w[1])")
        known = "(m like '%::%' and m not like '%:::%' and m not like '%::%::%' and size(filter(split(m, ':'), x -> x != '')) < 8 or m not like '%::%') and m not rlike '^:[^:]|[^:]:$'"
        return f"if({known}, {_let(words, 'w', f'if(w is null, null, {_let(net, chr(121), _let(host, chr(122), f"concat({shown(chr(121))}, {chr(39)}:{chr(39)}, {shown(chr(122))})"))})')}, null)"
    if kind == "date":
        return f"case when m like '____-%' then {_date('yyyy-MM-dd')} when m like '__.%' then {_date('dd.MM.yyyy')} when substr(m, 1, 2) > '12' then {_date('dd/MM/yyyy')} else {_date('MM/dd/yyyy')} end"
    if kind == "ssn":
        ok = lambda d: f"({d} not rlike '^(000|666|9)|^...00|0000$')"
        return _let(_digits("m"), "d", f"if({ok('d')}, {_let(_walk('d', lambda x: _permuted(x, 'ssn'), ok), 'z', _filled('m', 'z'))}, null)")
    if kind == "card":
        new = _let(_permuted("substr(d, 1, length(d) - 1)", "card"), "y", f"concat(y, cast((10 - {_luhn('concat(y, 0)')} % 10) % 10 as string))")
        return _let(_digits("m"), "d", f"if({_luhn('d')} % 10 = 0, {_let(new, 'z', _filled('m', 'z'))}, null)")
    if kind == "phone":  # a country code's first digit stays
        keep = "if(m like '+%', 1, 0)"
        return _let(_digits("m"), "d", f"if(length(d) between 7 and 15, {_let(f'concat(substr(d, 1, {keep}), ' + _permuted(f'substr(d, 1 + {keep})', 'phone') + ')', 'z', _filled('m', 'z'))}, null)")
    if kind == "key":
        return f"concat('AKIA', upper(substr({_mac("concat('key|', m)")}, 1, 16)))"
    head = f"regexp_extract(m, {_quoted(SECRET_HEAD)}, 0)"
    return _let(head, "h", f"concat(h, substr(repeat({_mac("concat('secret|', substr(m, length(h) + 1))")}, (length(m) - length(h) + 63) div 64), 1, length(m) - length(h)))")


def pseudonymise(docs: DataFrame, key: str = KEY, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(doc_id, text, n_found, found) for every row of docs, one for one: found counts replacements by kind.

    Candidates that are not valid stay as they are, and so does all other text, to the last character. Null text stays null
    with nothing found; an empty one stays empty. A null doc_id is passed on; repeated rows get a row each; an
    empty table gives none. Texts of any length are read whole. Other columns are not read. The permutation depends on key; whoever has it can undo the numbers'.
    """
    pattern = _quoted("|".join(f"(?:{PATTERNS[k]})" for k in kinds))
    case = "case " + " ".join(f"when m rlike {_quoted(f'^(?:{PATTERNS[k]})$')} then named_struct('kind', '{k}', 'new', {pseudonym(k)})" for k in kinds) + " end"
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(F.lit(v).alias(k) for k, v in keys(key).items()))
    parts = own.select("*", F.expr(f"if(text rlike {_quoted(GATE)}, regexp_extract_all(text, {pattern}, 0), array())").alias("_seen"))
    new = parts.select("*", F.expr(f"transform(_seen, m -> transform(array({case}), r -> if(r.new is null, named_struct('kind', cast(null as string), 'new', m), r))[0])").alias("_new"))
    joined = f"array_join(flatten(zip_with(split(text, {pattern}, -1), concat(transform(_new, r -> r.new), array('')), (g, r) -> array(g, r))), '')"
    counts = "map_from_entries(filter(transform(array({0}), k -> named_struct('key', k, 'value', size(filter(_new, r -> r.kind = k)))), e -> e.value > 0))".format(", ".join(f"'{k}'" for k in kinds))
    return new.select("doc_id", F.expr(f"if(size(_seen) > 0, {joined}, text)").alias("text"), F.expr("coalesce(size(filter(_new, r -> r.kind is not null)), 0)").cast("long").alias("n_found"), F.expr(f"if(text is null, map(), {counts})").alias("found"))
