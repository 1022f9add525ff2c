"""PII surrogates, in DataFrame and SQL functions only.

Entities (e-mail and IP addresses, card, phone, social security and account
numbers, titled names) are found by one pattern, so they never overlap. Each
distinct entity of the corpus gets one keyed surrogate of its own type, format
and script, so equal entities stay equal in every document whatever their
spelling (case, separators, the dot of a title). A family name has one
surrogate of its own, so "Mr. John Smith" and "Mr Smith" keep a common family
name; one word after a title is a family name. Surrogates are checked over the corpus: none
equals another entity's surrogate or any real entity of its type; losers draw
again with the next counter until none is left. Closed formats (numbers and IP
addresses) whose real entities fill more than DENSE of all values are permuted
as a whole by a keyed Feistel network instead: distinct by construction and
never the entity itself, but they may meet another real one, which beyond half
of all values no choice avoids. Open formats (names, e-mail addresses) grow
longer with further draws, so draws always end. Only entities are shuffled and
checked; a text meets its own replacements in one join.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, whole

# Titles by gender and given names by gender, Latin and Cyrillic.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "госпожа")
TITLES = ("Dr", "Prof", "доктор")
NAMES = {
    "male": ("James", "John", "Robert", "Michael", "David", "Thomas", "Daniel", "Paul", "Peter", "Lukas", "Pierre", "Carlos"),
    "female": ("Mary", "Anna", "Linda", "Susan", "Laura", "Julia", "Sarah", "Emma", "Marie", "Claire", "Elena", "Carmen"),
    "мужской": ("Иван", "Пётр", "Сергей", "Андрей", "Павел", "Олег"),
    "женский": ("Анна", "Мария", "Ольга", "Елена", "Татьяна", "Нина"),
}
_ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "аеиоуы", "бвгдзклмнпрстх", "äöü", "éèêàâîôû", "áíóúñ", "αεηιο", "βγδκλμνπρσ")

_LOCAL = "A-Za-z0-9._%+-"
_TITLE = "|".join(t for title in MALE_TITLES + FEMALE_TITLES + TITLES for t in (title, title.upper()))
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Short titles that have a long spelling.
LONG_TITLES = {"Sr": "Señor", "Sra": "Señora"}
#: Characters of an account number by country; other codes take any length.
IBAN = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![0-9A-Za-z])" for n, c in IBAN.items())
# A grouped number ends where no further number or word part follows at once.
_ENDS = r"(?![0-9A-Za-z@_%+:]|[ .()/-]{1,2}[0-9]|[.-][A-Za-z])"
_SIXTEEN = r"[0-9]{4}(?:[ -]?[0-9]{4}){3}"
_DATE = r"[0-9]{2}[./-][0-9]{2}[./-][0-9]{2,4}(?![0-9]|[./-][0-9])"
# Words of a name, as a whole: McDonald, O'Brien, Meyer-Lansky; or in capitals.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:['’-]?\p{Lu}\p{Ll}+)*+(?![\p{L}\p{M}])"
_CAPITALS = r"\p{Lu}(?:['’-]?\p{Lu})++(?![\p{L}\p{M}])"
PATTERNS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}",
    # IPv6: eight groups, or "::" after a first group of four digits.
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
          rf"|(?<![0-9A-Za-z.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|[0-9A-Fa-f]{{4}}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z]|:[0-9A-Fa-f:]|\.[0-9])",
    # Four groups of four always; other forms only if the Luhn check holds (_type).
    "card": rf"(?<![0-9A-Za-z])(?:[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}[ -][0-9]{{1,3}}{_ENDS}|{_SIXTEEN}(?![0-9A-Za-z])|[1-9][0-9]{{3}}[ -]?[0-9]{{6}}[ -]?[0-9]{{4,5}}{_ENDS}"
            rf"|[1-9][0-9]{{3}}(?:[ -]?[0-9]{{4}}){{2}}[ -]?[0-9]{{1,3}}{_ENDS}|[1-9][0-9]{{12,18}}(?![0-9A-Za-z]))",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # International (+ or 00), North American and national with a leading 0.
    "phone": r"(?<![0-9A-Za-z])(?:\+|00(?=[1-9]))(?=(?:[ .()-]{0,2}[0-9]){7})[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
             r"|(?<![0-9A-Za-z])(?<![0-9][.-])(?:1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
             rf"|(?<![0-9A-Za-z])(?<![0-9][.,/-])(?!{_DATE})(?=\(?(?:[ ./)-]{{0,2}}[0-9]){{9}})(?:\(0[1-9][0-9]{{0,4}}\)[ ./-]?|0[1-9][0-9]{{0,4}}[ ./-])[0-9]{{2,8}}(?:[ .-][0-9]{{2,5}}){{0,4}}(?![0-9])"
             r"|(?<![0-9A-Za-z])(?<![0-9][.,/-])0[1-9][0-9]{8,9}(?![0-9A-Za-z]|[.,][0-9])",
    "iban": rf"(?<![0-9A-Za-z])(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![0-9A-Za-z]))",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? (?:{_WORD}(?: {_WORD})?|{_CAPITALS}(?: {_CAPITALS})?)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"@|[0-9][0-9 .()/-]{{5}}|[A-Z]{{2}}[0-9]{{2}}|[0-9A-Fa-f]{{4}}:|(?:{_HEX}:){{7}}|(?:{_TITLE})\.? \p{{Lu}}"
#: Drawing fails at most twice this often, so MAX_DRAWS are never used up.
DENSE = 1 / 8
MAX_DRAWS = 40
ROUNDS = 10
#: Found entities to a file of the tables made of them, some hundred KB.
FILE_ENTITIES = 10_000


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of some digits, 0 if they pass the check."""
    return (f"aggregate(transform(split({digits}, ''), (c, i) -> case when (length({digits}) - i) % 2 = 0 then case when cast(c as int) * 2 > 9 then cast(c as int) * 2 - 9 else cast(c as int) * 2 end "
            f"else cast(c as int) end), 0, (a, x) -> a + x) % 10")


def _digits(raw: str) -> str:
    return f"regexp_replace({raw}, '[^0-9]', '')"


#: SQL: the title of a name, without its dot; the family name of a canonical one.
_TITLE_OF = "replace(substring_index({0}, ' ', 1), '.', '')"
_FAMILY_OF = "substring_index({0}, ' ', -1)"


def _type(raw: str) -> str:
    """SQL: the type of a found entity; null for digits of a card's form that
    fail the Luhn check and have no other type."""
    test = {k: f"regexp_like({raw}, {_q('^(?:' + p + ')$')})" for k, p in PATTERNS.items()}
    test["card"] += f" and (regexp_like({raw}, {_q('^' + _SIXTEEN + '(?:[ -][0-9]{1,3})?$')}) or {_luhn(_digits(raw))} = 0)"
    test["ip"] += f" and (instr({raw}, ':') = 0 or regexp_like({raw}, '[1-9A-Fa-f]'))"  # all zeros is no address
    return "case " + " ".join(f"when {t} then '{k}'" for k, t in test.items()) + " end"


def _canonical(kind: str, raw: str) -> str:
    """SQL: one spelling for all spellings of an entity."""
    digits = _digits(raw)
    # Sixteen digits and up to three more: the card is all of them only if
    # these pass the check and the sixteen do not.
    card = f"case when length({digits}) > 16 and regexp_like({raw}, '[ -]') and ({_luhn(f'left({digits}, 16)')} = 0 or {_luhn(digits)} <> 0) then left({digits}, 16) else {digits} end"
    national = _digits(f"replace({raw}, '(0)', '')")
    phone = f"case when regexp_like({raw}, '^[(]?[2-9]') and length({digits}) = 10 then concat('1', {digits}) when {raw} like '00%' then substr({national}, 3) else {national} end"
    # Capitals are one spelling of a name: all but the first letter of each part is made small.
    small = f"array_join(transform(split({raw}, ''), (c, i) -> case when i > 0 and regexp_like(substr({raw}, i, 1), '{chr(92) * 2}p{{L}}') then lower(c) else c end), '')"
    written = f"case when regexp_like(substr({raw}, instr({raw}, ' ')), '{chr(92) * 2}p{{Ll}}') then substr({raw}, instr({raw}, ' ')) else substr({small}, instr({raw}, ' ')) end"
    title = _TITLE_OF.format(raw)
    title = f"case {title} {' '.join(f'when {_q(t.upper())} then {_q(t)}' for t in MALE_TITLES + FEMALE_TITLES + TITLES if t.upper() != t)} else {title} end"
    name = f"concat(case {title} {' '.join(f'when {_q(a)} then {_q(b)}' for a, b in LONG_TITLES.items())} else {title} end, {written})"
    left, right = _halves(f"lower({raw})")
    ip6 = f"array_join(transform(concat({left}, array_repeat('0', greatest(0, 8 - size({left}) - size({right}))), {right}), g -> lpad(g, 4, '0')), ':')"
    return f"""case when {kind} = 'email' then lower({raw}) when {kind} = 'card' then {card} when {kind} = 'phone' then {phone} when {kind} = 'ssn' then {digits}
        when {kind} = 'iban' then replace({raw}, ' ', '') when {kind} = 'ip' and instr({raw}, ':') > 0 then {ip6} when {kind} = 'name' then {name} else {raw} end"""


def _halves(raw: str) -> tuple[str, str]:
    """SQL: the groups of an IPv6 address before and after its '::'."""
    groups = lambda x: f"filter(split({x}, ':'), g -> g <> '')"
    return groups(f"substring_index({raw}, '::', 1)"), groups(f"case when instr({raw}, '::') > 0 then substring_index({raw}, '::', -1) else '' end")


def _draw(salt: str, i: str) -> str:
    """SQL: a number below 65536 for place i, from the keyed hash ``salt``."""
    return f"cast(conv(substr({salt}, 1 + (({i} * 4) % 124), 4), 16, 10) as int)"


def _letters(text: str, salt: str, keep: str = "0") -> str:
    """SQL: text with each letter and digit (from place ``keep`` on) replaced
    by another of its kind: vowels by vowels, script and case as they are."""
    pick = "case " + " ".join(f"when instr({_q(a)}, lower(c)) > 0 then substr({_q(a)}, 1 + {_draw(salt, 'i')} % {len(a)}, 1)" for a in _ALPHABETS) + " else c end"
    one = f"transform(array({pick}), p -> case when c = lower(c) then p else upper(p) end)[0]"
    return f"array_join(transform(split({text}, ''), (c, i) -> case when i < {keep} then c else {one} end), '')"


def _hash(key: str, *parts: str) -> str:
    return f"sha2(concat_ws('\\u0001', {_q(key)}, {', '.join(parts)}), 512)"


def _surrogate(key: str) -> str:
    """SQL: surrogate of (kind, canonical) at the counter ``draw``, in
    canonical spelling."""
    salt = _hash(key, "kind", "canonical", "cast(draw as string)")
    domain = "substring_index(canonical, '@', -1)"
    top = f"case when regexp_like({domain}, '(^|[.])example[.][a-z]+$') then regexp_extract({domain}, 'example[.][a-z]+$', 0) else regexp_extract({domain}, '[^.]+$', 0) end"
    front = f"left({domain}, length({domain}) - length({top}))"
    grown = lambda base, after: f"left({_letters(base, _hash(key, _q('longer'), 'canonical', 'cast(draw as string)'))}, case when draw > {after} then 2 * least(12, 1 + (draw - {after}) div 4) else 0 end)"
    email = f"concat({_letters('substring_index(canonical, ' + _q('@') + ', 1)', salt)}, {grown(_q('babe' * 6), 3)}, '@', {_letters(front, _hash(key, _q('domain'), domain))}, {top})"
    ip = f"concat_ws('.', transform(split(canonical, '[.]'), (c, i) -> case when i = 0 and c in ('10', '127') or canonical like '192.168.%' and i < 2 then c when i = 0 then cast(1 + {_draw(salt, 'i')} % 223 as string) else cast({_draw(salt, 'i')} % 256 as string) end))"
    digits = _letters("canonical", salt)
    # Zero groups stay, as does the first group of link-local and private
    # addresses and the first digit of others.
    rest6 = "regexp_like(substr(canonical, 5), '[^0:]')"
    ip6 = (f"array_join(transform(split(canonical, ':'), (g, i) -> case when g = '0000' or i = 0 and regexp_like(g, '^(fe80|f[cd]..)') and {rest6} then g "
           f"when i = 0 and left(g, 1) <> '0' then concat(left(g, 1), lpad(lower(hex({_draw(salt, 'i')} % 4096)), 3, '0')) else lower(hex(4096 + {_draw(salt, 'i')} % 61440)) end), ':')")
    ip = f"case when instr(canonical, ':') > 0 then {ip6} else {ip} end"
    # Cards that pass the Luhn check keep passing it.
    drawn = _letters("canonical", salt, keep="1")
    card = (f"transform(array(left({drawn}, length(canonical) - 1)), d -> case when {_luhn('canonical')} = 0 then concat(d, cast((10 - {_luhn('concat(d, ' + _q('0') + ')')}) % 10 as string)) "
            f"else concat(d, right({drawn}, 1)) end)[0]")
    iban = f"concat(left(canonical, 2), substr({_letters('canonical', salt)}, 3))"
    # A given name; the family name has its own surrogate. Where all names of
    # the same form may be taken, they get longer.
    given = "substring_index(substring_index(canonical, ' ', 2), ' ', -1)"
    known = " ".join(f"when draw < 8 and array_contains(array({', '.join(map(_q, v))}), {given}) then element_at(array({', '.join(map(_q, v))}), 1 + {_draw(salt, '7')} % {len(v)})" for v in NAMES.values())
    base = lambda text: f"case when regexp_like({text}, '[Ѐ-ӿ]') then {_q('бабе' * 6)} when regexp_like({text}, '[Α-ω]') then {_q('βαβε' * 6)} else {_q('babe' * 6)} end"
    longer = lambda text, after: f"concat({_letters(text, salt)}, {grown(base(text), after)})"
    name = f"concat_ws(' ', substring_index(canonical, ' ', 1), case when size(split(canonical, ' ')) > 2 then case {known} else {longer(given, 9)} end end, family)"
    family = longer("canonical", 1)
    phone = _letters("canonical", salt, keep="1")
    return f"case kind when 'email' then {email} when 'ip' then {ip} when 'card' then {card} when 'phone' then {phone} when 'iban' then {iban} when 'name' then {name} when 'family' then {family} else {digits} end"


def _render(raw: str, surrogate: str) -> str:
    """SQL: the surrogate in the spelling of one occurrence: its separators,
    its case."""
    # '00' and '(0)' before a phone number are no part of it; a country code
    # or a card's further digits may be missing on one side.
    own = f"case when kind = 'phone' then replace(regexp_replace({raw}, '^00', '--'), '(0)', '(-)') else {raw} end"
    slots = f"regexp_replace({own}, '[0-9]', '0')"
    before = lambda text: f"length(regexp_replace({text}, '[^0]', ''))"
    place = f"greatest(0, length({surrogate}) - {before(slots)}) + {before(f'left({slots}, i + 1)')}"
    digits = f"array_join(transform(split({raw}, ''), (c, i) -> case when substr({slots}, i + 1, 1) = '0' and {place} <= length({surrogate}) then substr({surrogate}, {place}, 1) else c end), '')"
    cased = (f"concat(array_join(transform(split({raw}, ''), (c, i) -> case when c <> lower(c) then upper(substr({surrogate}, i + 1, 1)) else substr({surrogate}, i + 1, 1) end), ''), "
             f"substr({surrogate}, length({raw}) + 1))")
    iban = f"array_join(transform(split({raw}, ''), (c, i) -> case when c = ' ' then c else substr({surrogate}, length(replace(left({raw}, i + 1), ' ', '')), 1) end), '')"
    left, right = _halves(raw)
    groups = lambda part, first: f"array_join(transform({part}, (g, i) -> case when regexp_like(g, '^0+$') then g else split({surrogate}, ':')[{first} + i] end), ':')"
    tail = groups(right, f"size(split({surrogate}, ':')) - size({right})")
    ip6 = f"concat({groups(left, '0')}, case when instr({raw}, '::') > 0 then concat('::', {tail}) else '' end)"
    ip6 = f"case when regexp_like({raw}, '[A-F]') then upper({ip6}) else {ip6} end"
    name = f"substr({surrogate}, instr({surrogate}, ' '))"
    name = f"case when regexp_like(substr({raw}, instr({raw}, ' ')), '{chr(92) * 2}p{{Ll}}') then {name} else upper({name}) end"
    return f"""case when kind in ('card', 'ssn', 'phone') then {digits} when kind = 'email' then {cased} when kind = 'iban' then {iban}
        when kind = 'ip' and instr({raw}, ':') > 0 then {ip6} when kind = 'name' then concat(substring_index({raw}, ' ', 1), {name}) else {surrogate} end"""


def _shape() -> str:
    """SQL: the closed format of (kind, canonical) as struct(format, l, r, a, b):
    the entity is the pair (l, r) of a x b possible ones; null for others."""
    shape = lambda name, l, r, a, b: f"named_struct('format', concat_ws('/', kind, {name}), 'l', cast({l} as bigint), 'r', cast({r} as bigint), 'a', cast({a} as bigint), 'b', cast({b} as bigint))"  # noqa: E731, E741
    digits = lambda name, d: shape(name, f"left({d}, length({d}) div 2)", f"substr({d}, length({d}) div 2 + 1)", f"power(10, length({d}) div 2)", f"power(10, length({d}) - length({d}) div 2)")
    o = "split(canonical, '[.]')"
    near = shape(f"{o}[0], {o}[1]", f"{o}[2]", f"{o}[3]", "256", "256")
    far = shape(f"{o}[0]", f"{o}[1] * 16 + cast({o}[2] as int) div 16", f"(cast({o}[2] as int) % 16) * 256 + {o}[3]", "4096", "4096")
    # IPv6: zero groups stay, and the first group unless it is the only other one.
    g = [f"conv(split(canonical, ':')[{_PLACES}[{i}]], 16, 10) - 1" for i in (0, 1)]
    six = f"left(canonical, case when array_contains({_PLACES}, 0) then 0 else 4 end), array_join({_PLACES}, ',')"
    one = shape(six, f"cast({g[0]} as int) div 257", f"cast({g[0]} as int) % 257", "255", "257")
    two = shape(six, g[0], g[1], "65535", "65535")
    return (f"case kind when 'ssn' then {digits(_q('9'), 'canonical')} when 'phone' then {digits('length(canonical), left(canonical, 1)', 'substr(canonical, 2)')} "
            f"when 'card' then {digits('length(canonical), left(canonical, 1), ' + _check_offset(), 'substr(canonical, 2, length(canonical) - 2)')} "
            f"when 'ip' then case when instr(canonical, ':') = 0 then case when {o}[0] = '192' then {near} else {far} end when size({_PLACES}) = 1 then {one} when size({_PLACES}) = 2 then {two} end end")


#: SQL: the places of an IPv6 address's groups that its closed format lets vary.
_PLACES = "filter(sequence(0, 7), i -> split(canonical, ':')[i] <> '0000' and (i > 0 or regexp_like(canonical, '^....(:0000){7}$')))"


def _check_digit(digits: str) -> str:
    return f"((10 - {_luhn(f'concat({digits}, {_q(chr(48))})')}) % 10)"


def _check_offset() -> str:
    """SQL: by how much a card's last digit differs from its check digit."""
    return f"pmod(cast(right(canonical, 1) as int) - {_check_digit('left(canonical, length(canonical) - 1)')}, 10)"


def _permuted(key: str) -> str:
    """SQL: (l, r) of ``shape`` under a keyed permutation without fixed points:
    forward, one on, and backward through the rounds of a Feistel network."""
    mix = lambda x, n: f"cast(conv(left(sha2(concat_ws('\u0001', {_q(key)}, 'permute', shape.format, i, {x}), 256), 15), 16, 10) as bigint) % {n}"

    def run(start: str, rounds: str, sign: str) -> str:
        return (f"aggregate({rounds}, {start}, (s, i) -> case when i % 2 = 0 then named_struct('l', pmod(s.l {sign} {mix('s.r', 'shape.a')}, shape.a), 'r', s.r) "
                f"else named_struct('l', s.l, 'r', pmod(s.r {sign} {mix('s.l', 'shape.b')}, shape.b)) end)")

    ahead = run("named_struct('l', shape.l, 'r', shape.r)", f"sequence(0, {ROUNDS - 1})", "+")
    on = f"transform(array({ahead}), s -> named_struct('l', pmod(s.l + (s.r + 1) div shape.b, shape.a), 'r', pmod(s.r + 1, shape.b)))[0]"
    return run(on, f"sequence({ROUNDS - 1}, 0, -1)", "-")


def _reshaped() -> str:
    """SQL: the surrogate, in canonical spelling, of the permuted pair ``to``."""
    width = lambda n: f"cast(round(log10({n})) as int)"
    digits = f"concat(lpad(cast(to.l as string), {width('shape.a')}, '0'), lpad(cast(to.r as string), {width('shape.b')}, '0'))"
    front = f"concat(left(canonical, 1), {digits})"
    card = f"concat({front}, cast(pmod({_check_digit(front)} + {_check_offset()}, 10) as string))"
    four = ("case when canonical like '192.%' then concat_ws('.', substring_index(canonical, '.', 2), to.l, to.r) "
            "else concat_ws('.', substring_index(canonical, '.', 1), to.l div 16, (to.l % 16) * 16 + to.r div 256, to.r % 256) end")
    value = f"case when size({_PLACES}) = 1 then to.l * 257 + to.r when j = {_PLACES}[0] then to.l else to.r end"
    six = f"array_join(transform(split(canonical, ':'), (g, j) -> case when array_contains({_PLACES}, j) then lower(lpad(hex({value} + 1), 4, '0')) else g end), ':')"
    return f"case kind when 'ssn' then {digits} when 'phone' then {front} when 'card' then {card} when 'ip' then case when instr(canonical, ':') > 0 then {six} else {four} end end"


def permuted(scratch: Scratch, entities: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The entities of dense closed formats with their surrogates, and all
    others. Dense formats hold thousands of entities each and are less than a
    million by their definition, so their names are broadcast."""
    shaped = scratch.table("shaped", entities.withColumn("shape", F.expr(_shape())))
    dense = (shaped.filter("shape is not null").groupBy("shape.format", "shape.a", "shape.b").agg(F.count("*").alias("n"))
             .filter(F.col("n") > DENSE * F.col("a") * F.col("b")).select("format", F.lit(True).alias("dense")))
    dense = scratch.table("dense", dense)
    marked = shaped.join(F.broadcast(dense), F.col("shape.format") == F.col("format"), "left")
    made = marked.filter("dense").withColumn("to", F.expr(_permuted(key))).select("kind", "canonical", F.expr(_reshaped()).alias("surrogate"))
    return scratch.table("permuted", made), marked.filter("dense is null").select(*entities.columns)


def assign(scratch: Scratch, entities: DataFrame, key: str, files: int, name: str = "") -> DataFrame:
    """``entities`` (kind, canonical, family: the surrogate of a name's family
    name), distinct -> kind, canonical, surrogate. ``files``: see Scratch."""
    settled, drawn = (None, entities) if name else permuted(scratch, entities, key)
    left, draw = scratch.table(f"{name}draw0", drawn.withColumn("draw", F.lit(0)).withColumn("surrogate", F.expr(_surrogate(key)))), 0
    while True:
        real = entities.select("kind", F.col("canonical").alias("surrogate"))
        first = left.groupBy("kind", "surrogate").agg(F.min(F.xxhash64("canonical")).alias("first"))
        ok = (left.join(first, ["kind", "surrogate"]).withColumn("lost", F.xxhash64("canonical") != F.col("first"))
              .join(real.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left"))
        if settled is not None:
            ok = ok.join(settled.select("kind", "surrogate", F.lit(True).alias("used")), ["kind", "surrogate"], "left")
        else:
            ok = ok.withColumn("used", F.lit(None).cast("boolean"))
        judged = scratch.table(f"{name}judged{draw}", ok.select("kind", "canonical", "family", "surrogate", (F.col("lost") | F.col("real").isNotNull() | F.col("used").isNotNull()).alias("again")), files)
        good = judged.filter("not again").select("kind", "canonical", "surrogate")
        settled = good if settled is None else settled.union(good)
        again = judged.filter("again")
        if again.limit(1).count() == 0:
            return settled
        draw += 1
        if draw > MAX_DRAWS:
            raise ValueError("too few surrogates of some format for its distinct entities")
        left = scratch.table(f"{name}draw{draw}", again.select("kind", "canonical", "family", F.lit(draw).alias("draw")).withColumn("surrogate", F.expr(_surrogate(key))))


def surrogates(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """``docs`` (doc_id, text, any further columns) -> doc_id, text with
    surrogates, n_chars, and the number of entities of each kind; one row per
    input row.

    Null and empty texts have no entity and stay as they are. Repeated rows get
    the same replacements. Null doc_ids take part. The first digit of a phone or
    card number, the title of a name, the first octets of
    private addresses and the top-level domain stay. Very long texts are read
    whole, a text in one task. Extra columns are left out, whatever their names.
    Empty input gives no rows."""
    scratch = Scratch(docs.sparkSession, "pii")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64(whole("text")))
    found = F.when(F.col("text").rlike(HINT), F.expr(f"regexp_extract_all(text, {_q(ANY)}, 0)"))
    seen = scratch.table("seen", docs.withColumn("found", found).filter("size(found) > 0").select("doc_id", "hash", "found"))
    files = max(1, math.ceil((seen.agg(F.sum(F.size("found"))).first()[0] or 0) / FILE_ENTITIES))
    raw = seen.select("doc_id", "hash", F.explode("found").alias("raw"))
    each = (raw.groupBy("doc_id", "hash", "raw").agg(F.count("*").alias("times")).withColumn("kind", F.expr(_type("raw"))).filter("kind is not null").withColumn("canonical", F.expr(_canonical("kind", "raw"))))
    each = scratch.table("each", each, files)
    entities = each.select("kind", "canonical", F.when(F.col("kind") == "name", F.expr(_FAMILY_OF.format("canonical"))).alias("own")).distinct()
    families = entities.filter("own is not null").select(F.lit("family").alias("kind"), F.col("own").alias("canonical"), F.lit(None).cast("string").alias("family")).distinct()
    families = assign(scratch, scratch.table("families", families, files), key, files, "family-").select(F.col("canonical").alias("own"), F.col("surrogate").alias("family"))
    entities = scratch.table("entities", entities.join(families, "own", "left").select("kind", "canonical", "family"), files)
    settled = scratch.table("settled", assign(scratch, entities, key, files), files)
    made = (each.join(settled, ["kind", "canonical"]).withColumn("new", F.expr(_render("raw", "surrogate")))
            .groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("new"),
                                                                                  F.map_from_entries(F.collect_list(F.struct("raw", "kind"))).alias("kinds")))
    pieces = f"split(text, {_q(ANY)}, -1)"
    every = f"regexp_extract_all(text, {_q(ANY)}, 0)"
    replaced = F.expr(f"array_join(concat(array({pieces}[0]), zip_with({every}, slice({pieces}, 2, size({every})), (r, s) -> concat(coalesce(new[r], r), s))), '')")
    rows = docs.join(made, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    count = [F.when(F.col("kinds").isNull(), 0).otherwise(F.expr(f"size(filter({every}, r -> kinds[r] = '{k}'))")).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return (rows.withColumn("changed", F.when(F.col("new").isNull(), F.col("text")).otherwise(replaced))
            .select("doc_id", F.col("changed").alias("text"), F.coalesce(F.length("changed"), F.lit(0)).cast("long").alias("n_chars"), *count))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(read_table(spark, sf_dir, "documents"))
