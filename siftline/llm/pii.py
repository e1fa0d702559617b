"""Personal data: detected entities get keyed surrogates of the same type and format.

Digits and letters are replaced by a keyed permutation of all strings of the
same pattern (a Feistel network with cycle walking), so two different entities
of one pattern can never get the same surrogate, and one entity has the same
surrogate in every document. Case, separators, script, country codes, issuer
digits and check digits keep their form, and dates of birth stay dates. Person
names, found by a title, a given name, a phrase that introduces one or what they
do (a verb of speaking or meeting beside them), get names made of syllables of the
same script and gender; other mentions in the same text, in capitals as well, get
the same name. A run of words that ends in a word for a street, a water or a
place is no person.

A corpus-wide check looks for surrogates that two entities share or that are
themselves an entity of the corpus, as they stand in the text, and gives those
entities another attempt until none is left. Names get longer with the attempts,
so there are always enough. A pattern of which the corpus has more than a
sixteenth of all strings has no free ones to look for: its entities keep their
first surrogate, which is distinct by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialize

KINDS = ("email", "card", "iban", "ip", "ssn", "phone", "address", "document", "birth", "name")

#: Titles by gender.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Госпожа", "госпожа", "г-жа"),
    "n": ("Dr", "Prof"),
}
#: Common given names by gender; with another capitalised word behind them they are a person.
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Andrew Paul Steven Kenneth "
        "Kevin Brian George Edward Peter Henry Hans Klaus Jürgen Wolfgang Pierre Jacques Jean Carlos José Luis Juan Pedro Miguel Antonio Marco "
        "Giuseppe Ivan Dmitry Иван Дмитрий Сергей Алексей Андрей Николай Владимир Михаил"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol "
        "Amanda Laura Anna Emma Olivia Sophie Ursula Ingrid Heike Marie Claire Nathalie Carmen Lucía María Isabel Ana Giulia Francesca Elena "
        "Olga Natalia Анна Мария Елена Ольга Наталья Татьяна Екатерина Ирина"
    ).split(),
}
#: Phrases that introduce a name, and kinds of street.
INTRODUCED = ("my name is", "i am called", "signed by", "signed,", "sincerely,", "kind regards,", "best regards,", "full name:", "contact person:", "mit freundlichen grüßen,", "mein name ist", "je m'appelle", "me llamo", "меня зовут")
STREETS = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Court", "Square", "Terrace", "St", "Ave", "Rd", "Blvd", "Ln")
#: What persons do, with the words that may stand between it and a name, and words that make a name one of a place or a body.
VERBS = "said says wrote writes met meets told tells asked asks called replied answered visited married emailed thanked phoned texted hired interviewed spoke talked introduced".split()
BETWEEN = ("to", "with", "by")
PLACES = {
    *STREETS, "Way", "Place", "River", "Lake", "Bay", "Sea", "Island", "Mountain", "Mount", "Hill", "Hills", "Valley", "Beach", "Forest", "Park", "Bridge", "Town", "City", "Village", "County", "State", "Province", "Airport",
    "Station", "University", "College", "School", "Hospital", "Museum", "Church", "Stadium", "Foundation", "Institute", "Company", "Inc", "Ltd", "Corporation", "Bank", "Award", "Prize", "License", "Act",
}
#: Words that begin a sentence in front of a name.
STARTERS = set("A An The This That These Those Then Yesterday Today Tomorrow Later Now Here There When While After Before Since Until Once As So But And Or If Because Although However Also Meanwhile Finally First In On At By For From With Of To We He She They It I You Who What Our Their His Her My Your".split())
#: Titles of scripts without capitals, in front of a name or behind it.
ARABIC = {"m": ("السيد",), "f": ("السيدة", "الآنسة"), "n": ("الدكتور", "الدكتورة")}
HAN = {"m": ("先生",), "f": ("女士", "小姐"), "n": ("博士", "教授")}
_GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}
#: Syllables and endings of made-up names by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wi za zo mi ri".split(),
    "cyrillic": "ба бе бо да де до фа ге го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве ви за зо ми ри".split(),
    "han": "安 白 程 戴 方 高 韩 江 康 林 罗 马 宁 潘 秦 任 苏 陶 万 夏 杨 叶 余 袁 赵 郑 钟 周 朱 卓".split(),
    "arabic": "با دا را سا فا كا لا ما نا وا يا بو دو رو سو فو كو لو مو نو".split(),
}
ENDINGS = {
    "latin": {"m": ("n", "k", "r", "s"), "f": ("na", "lia", "ra", "sa"), "n": ("l", "m", "t", "x")},
    "cyrillic": {"m": ("н", "к", "р", "в"), "f": ("на", "лия", "ра", "ва"), "n": ("ль", "м", "т", "кс")},
    "han": {"m": ("伟", "强", "军", "明"), "f": ("芳", "丽", "静", "敏"), "n": ("平", "华", "文", "宁")},
    "arabic": {"m": ("ن", "د", "ر", "م"), "f": ("ة", "ى"), "n": ("ي", "س", "ل")},
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ENTITY = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    rf"|(?P<ip>(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![0-9A-Za-z+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{4}(?!-)|0[1-9](?:[ .][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{5,8})(?![0-9A-Za-z]))"
    # bare digits only where a word says what they are
    r"|(?i:(?<![a-z])(?:phone|telephone|tel|mobile|cell|fax|telefon|téléphone|teléfono)(?: (?:number|no))?[.:]{0,2} ?)(?P<dialled>[0-9]{7,12})(?![0-9A-Za-z])"
    r"|(?i:(?<![a-z])(?:ssn|social security(?: number| no)?)[.:#]{0,2} ?)(?P<insured>[0-9]{9})(?![0-9A-Za-z])"
    r"|(?i:(?<![a-z])(?:passport|identity card|driving licen[cs]e|driver's licen[cs]e)(?: (?:number|no))?[.:#]{0,2} ?)(?P<document>(?-i:[A-Z]{0,2}[0-9]{6,9}))(?![0-9A-Za-z])"
    r"|(?i:(?<![a-z])(?:born|date of birth|birth ?date|dob|geboren am|né le|née le|nacido el|nacida el)(?: on)?:? ?)(?P<birth>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<gap>[./])[0-9]{1,2}(?P=gap)[0-9]{4})(?![0-9])"
    rf"|(?P<address>(?<![0-9A-Za-z.,-])[0-9]{{1,5}} (?:[A-Z][a-z]+ ){{1,3}}(?:{'|'.join(STREETS)})(?![A-Za-z]))"
)
#: Kinds of the groups that stand behind a word.
_BEHIND = {"dialled": "phone", "insured": "ssn"}
_NAME = re.compile(
    r"(?<!\w)(?P<title>" + "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True)) + r")\.? (?P<name>[^\W\d_a-zа-я][^\W\d_]+(?:[ -][^\W\d_a-zа-я][^\W\d_]+){0,2})"
)
_WORD = r"[^\W\d_a-zа-я][^\W\d_]+"
_CALLED = re.compile(rf"(?<!\w)(?P<given>{'|'.join(n for names in GIVEN.values() for n in names)})(?P<rest>(?: [^\W\d_a-zа-я]\.)?(?: {_WORD}){{1,2}})(?!\w)")
_INTRODUCED = re.compile(rf"(?i:(?<!\w)(?:{'|'.join(map(re.escape, INTRODUCED))})\s)\s*(?P<name>{_WORD}(?:[ -]{_WORD}){{1,2}})(?!\w)")
_RUN = rf"{_WORD}(?:[ -]{_WORD}){{1,2}}"
_ACTS = re.compile(rf"(?<!\w)(?P<name>{_RUN}) (?:{'|'.join(VERBS)})(?!\w)")
_MET = re.compile(rf"(?<!\w)(?:{'|'.join(VERBS)}) (?:(?:{'|'.join(BETWEEN)}) )?(?P<name>{_RUN})(?!\w)")
_ARABIC = re.compile(rf"(?<!\w)(?P<title>{'|'.join(t for titles in ARABIC.values() for t in sorted(titles, key=len, reverse=True))}) (?P<name>[ء-ي]{{2,}}(?: [ء-ي]{{2,}})?)")
_HAN = re.compile(rf"(?P<name>[\u4e00-\u9fff]{{1,3}})(?P<title>{'|'.join(t for titles in HAN.values() for t in titles)})")
_SCRIPT_TITLES = {title: gender for table in (ARABIC, HAN) for gender, titles in table.items() for title in titles}
#: Two words with capitals behind each other, without which there is no name to look for.
_PAIR = re.compile(r"[^\W\d_a-zà-ÿа-яё]\w+[ -][^\W\d_a-zà-ÿа-яё]")
_GENDER_OF = {name: gender for gender, names in GIVEN.items() for name in names}
_TRIGGER = re.compile(r"[0-9]")
_RADIX = ((ord("0"), 10), (ord("a"), 26), (ord("A"), 26), (ord("а"), 32), (ord("А"), 32))


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(size)``: eight Feistel rounds, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    seed = tweak.encode("utf-8", "surrogatepass")
    while True:
        left, right = value >> half, value & mask
        for turn in range(8):
            mixed = blake2b(seed + b"\0" + bytes([turn]) + right.to_bytes(width + 1, "big"), key=key, digest_size=width + 8).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _mixed(text: str, key: bytes, tweak: str, fixed: int = 0, radix: dict[int, tuple[int, int]] | None = None) -> str:
    """Permute the characters of ``text`` from place ``fixed`` on within their classes; all others stay."""
    chars, places, pattern = list(text), [], []
    for i, c in enumerate(chars):
        first, size = (radix or {}).get(i) or next(((f, n) for f, n in _RADIX if f <= ord(c) < f + n), (0, 0))
        pattern.append(f"<{first},{size}>" if size and i >= fixed else c)
        if size and i >= fixed:
            places.append((i, first, size))
    value, total = 0, 1
    for i, first, size in places:
        value, total = value * size + ord(chars[i]) - first, total * size
    if total == 1:
        return text
    value = permute(value, total, key, tweak + "".join(pattern))
    for i, first, size in reversed(places):
        value, digit = divmod(value, size)
        chars[i] = chr(first + digit)
    return "".join(chars)


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(doubled[int(c)]) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _card(norm: str, key: bytes, tweak: str) -> str:
    if luhn(norm):
        head = _mixed(norm[:-1], key, tweak + "luhn", 1)
        return next(head + c for c in "0123456789" if luhn(head + c))
    out = _mixed(norm, key, tweak, 1)
    while luhn(out):  # stays a permutation of the numbers without a valid check digit
        out = _mixed(out, key, tweak, 1)
    return out


def _ip(norm: str, key: bytes, tweak: str) -> str:
    octets = [int(x) for x in norm.split(".")]
    low, size = (1, 223) if 1 <= octets[0] <= 223 else (0, 256)
    value = octets[0] - low
    for octet in octets[1:]:
        value = value * 256 + octet
    value = permute(value, size << 24, key, f"{tweak}{low}")
    return f"{(value >> 24) + low}.{value >> 16 & 255}.{value >> 8 & 255}.{value & 255}"


def _phone(norm: str, key: bytes, tweak: str) -> str:
    country = len(re.match(r"\+[0-9]{1,3}(?=[^0-9])|\+[0-9]|", norm)[0])
    first = next((i for i in range(country, len(norm)) if norm[i].isdigit()), None)
    wide = first is not None and norm[first] >= "2"  # numbers that start with 2 to 9 keep doing so
    return _mixed(norm, key, tweak, country, {first: (ord("2"), 8)} if wide else None)


def _iban_check(country: str, rest: str) -> str:
    """The two check digits that make an IBAN valid modulo 97."""
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{98 - int(number) % 97:02d}"


def iban_valid(norm: str) -> bool:
    return int("".join(str(int(c, 36)) for c in norm[4:] + norm[:4])) % 97 == 1


def _iban(norm: str, key: bytes, tweak: str) -> str:
    """Valid numbers get valid ones, with new check digits; the others stay invalid, so no two share a surrogate."""
    if iban_valid(norm):
        rest = _mixed(norm[4:], key, tweak + "valid")
        return norm[:2] + _iban_check(norm[:2], rest) + rest
    out = _mixed(norm, key, tweak, 2)
    while iban_valid(out):
        out = _mixed(out, key, tweak, 2)
    return out


def _syllables(value: int, attempt: int, script: str, ends: tuple[str, ...]) -> str:
    """A made-up word; every second attempt adds a syllable."""
    out = ""
    for _ in range(3 + value % 2 + attempt // 2):
        value, i = divmod(value, len(SYLLABLES[script]))
        out += SYLLABLES[script][i]
    return out + ends[value % len(ends)]


def _hashed(text: str, key: bytes) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest(), "big")


def _name(norm: str, key: bytes, tweak: str, attempt: int) -> str:
    """``norm`` is role:gender:token."""
    role, gender, token = norm.split(":", 2)
    script = next((name for name, letters in (("cyrillic", "[а-яё]"), ("han", "[\u4e00-\u9fff]"), ("arabic", "[ء-ي]")) if re.search(letters, token)), "latin")
    made = _syllables(_hashed(f"{tweak}{norm}", key), attempt, script, ENDINGS[script][gender if role == "given" else "n"])
    return f"{role}:{gender}:{made}"


def _address(norm: str, key: bytes, tweak: str, attempt: int) -> str:
    """House number by its digits, the words of the street's name made up, the kind of street kept."""
    number, *words, street = norm.split(" ")
    made = [_syllables(_hashed(f"{tweak}{norm}/{n}", key), attempt, "latin", ENDINGS["latin"]["n"]).capitalize() for n in range(len(words))]
    return " ".join([_mixed(number, key, tweak, 0, {0: (ord("1"), 9)} if number[0] != "0" else None), *made, street])


#: Days that dates of birth are taken from.
_DAYS = (date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal())


def _day(found: str) -> date | None:
    """The date of a written one: year first, or day first unless it can only be the month; None if there is no such day."""
    parts = [int(x) for x in re.split("[./-]", found)]
    for year, month, day in ([parts] if "-" in found else [parts[::-1], [parts[2], parts[0], parts[1]]]):
        try:
            made = date(year, month, day)
        except ValueError:
            continue
        return made if _DAYS[0] <= made.toordinal() < _DAYS[1] else None
    return None


def _birth(norm: str, key: bytes, tweak: str) -> str:
    value = permute(date.fromisoformat(norm).toordinal() - _DAYS[0], _DAYS[1] - _DAYS[0], key, tweak)
    return date.fromordinal(value + _DAYS[0]).isoformat()


def surrogate(kind: str, norm: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a normalised entity, also normalised."""
    tweak = f"{kind}/{attempt}/"
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        host, _, top = domain.rpartition(".")
        return _mixed(f"{local}@{host}", key, f"{tweak}{top}") + "." + top
    if kind in ("name", "address"):
        return (_name if kind == "name" else _address)(norm, key, tweak, attempt)
    maker: Callable[[str, bytes, str], str] = {"card": _card, "iban": _iban, "ip": _ip, "phone": _phone, "birth": _birth}.get(kind, _mixed)
    return maker(norm, key, tweak)


def normal(kind: str, found: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return found.lower()
    if kind == "birth":
        return _day(found).isoformat()
    return re.sub(r"[ -]", "", found) if kind in ("card", "iban") else found


def _dressed(kind: str, found: str, norm: str) -> str:
    """``norm`` with the separators or the case of ``found``."""
    if kind == "email":
        return "".join(c.upper() if f.isupper() else c for f, c in zip(found, norm, strict=True))
    if kind in ("card", "iban"):
        rest = iter(norm)
        return "".join(c if c in " -" else next(rest) for c in found)
    if kind == "birth" and "-" not in found:
        day, month = (int(x) for x in re.split("[./]", found)[:2])
        new = date.fromisoformat(norm)
        gap, (first, second) = found[-5], (new.day, new.month) if month <= 12 else (new.month, new.day)
        width = 2 if len(found) == 10 else 1
        return f"{first:0{width}d}{gap}{second:0{width}d}{gap}{new.year}"
    return norm


def _people(text: str) -> dict[str, str]:
    """Tokens of persons' names with their entity; the last token of a mention is the family name."""
    people: dict[str, str] = {}

    def add(tokens: list[str], gender: str) -> None:
        tokens = tokens[1:] if tokens[0] in STARTERS else tokens
        if not tokens or PLACES.intersection(tokens) or tokens[0] in STARTERS:
            return
        for token in tokens[:-1]:
            people.setdefault(token, f"given:{gender}:{token.lower()}")
        people.setdefault(tokens[-1], f"family:n:{tokens[-1].lower()}")

    if any(title in text for title in _GENDER):
        for m in _NAME.finditer(text):
            add(re.split("[ -]", m["name"]), _GENDER[m["title"]])
    if any(title in text for title in _SCRIPT_TITLES):
        for m in _ARABIC.finditer(text):
            add(m["name"].split(), _SCRIPT_TITLES[m["title"]])
        for m in _HAN.finditer(text):
            people.setdefault(m["name"], f"given:{_SCRIPT_TITLES[m['title']]}:{m['name']}")
    if not _PAIR.search(text):
        return people
    for m in _CALLED.finditer(text):
        add([m["given"], *(t for t in m["rest"].split() if not t.endswith("."))], _GENDER_OF[m["given"]])
    for pattern in (_INTRODUCED, _ACTS, _MET):
        for m in pattern.finditer(text):
            tokens = re.split("[ -]", m["name"])
            add(tokens, _GENDER_OF.get(tokens[0], "n"))
    return people


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and normal form of every entity of a whole text, in order."""
    if not text:
        return []
    out = []
    if _TRIGGER.search(text) or "@" in text:
        for m in _ENTITY.finditer(text):
            group = "birth" if m["birth"] else m.lastgroup
            kind = _BEHIND.get(group, group)
            if kind != "birth" or _day(m[group]):
                out.append((m.start(group), m.end(group), kind, normal(kind, m[group])))
    if people := _people(text):
        taken = [(s, e) for s, e, _, _ in out]
        for token, entity in list(people.items()):
            people.setdefault(token.upper(), entity)
            people.setdefault(token.capitalize(), entity)
        bare = [t for t in people if "\u4e00" <= t[0] <= "\u9fff"]  # a script without gaps between words
        spaced = sorted(set(people).difference(bare), key=len, reverse=True)
        forms = [*([r"(?<!\w)(?:" + "|".join(map(re.escape, spaced)) + r")(?!\w)"] if spaced else []), *map(re.escape, sorted(bare, key=len, reverse=True))]
        mention = re.compile("|".join(forms))
        names = [(m.start(), m.end(), "name", people[m[0]]) for m in mention.finditer(text)]
        if taken:
            covered = bytearray(len(text))
            for s, e in taken:
                covered[s:e] = b"\1" * (e - s)
            names = [n for n in names if not any(covered[n[0] : n[1]])]
        out = sorted(out + names)
    return out


def replace(text: str | None, key: bytes, attempts: dict[tuple[str, str], int], made: Callable[[str, str, bytes, int], str]) -> tuple[str | None, dict[str, int]]:
    counts = dict.fromkeys(KINDS, 0)
    parts, at = [], 0
    for start, end, kind, norm in entities(text):
        new, found = made(kind, norm, key, attempts.get((kind, norm), 0)), text[start:end]
        if kind == "name":
            new = new.rpartition(":")[2]
            new = new.upper() if found.isupper() and len(found) > 1 else new.capitalize()
        parts += [text[at:start], _dressed(kind, found, new)]
        at = end
        counts[kind] += 1
    return ("".join([*parts, text[at:]]) if parts else text), counts


def _distinct_entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = {(kind, norm) for text in batch["text"] for _, _, kind, norm in entities(text)}
        yield pd.DataFrame(sorted(found), columns=["kind", "norm"])


def _with_surrogates(table: DataFrame, key: bytes) -> DataFrame:
    """``made`` is the surrogate as :func:`surrogate` gives it, ``shown`` what of it stands in a text."""

    @F.pandas_udf("string")
    def made(kinds: pd.Series, norms: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, n, key, int(a)) for k, n, a in zip(kinds, norms, attempts, strict=True)], dtype=object)

    return table.withColumn("made", made("kind", "norm", "attempt")).withColumn("shown", _shown("kind", "made"))


def _shown(kind: str, norm: str) -> Column:
    return F.when(F.col(kind) == "name", F.substring_index(norm, ":", -1)).otherwise(F.col(norm))


def _crowded(found: DataFrame) -> DataFrame:
    """``found`` with ``crowded``: whether the corpus has more than a sixteenth of the strings of an entity's pattern."""
    pattern, bits = F.col("norm"), F.lit(0.0)
    for letters, sign, size in (("[0-9]", "0", 10), ("[a-z]", "a", 26), ("[A-Z]", "A", 26), ("[а-я]", "а", 32), ("[А-Я]", "А", 32)):
        pattern, bits = F.regexp_replace(pattern, letters, sign), bits + F.regexp_count("norm", F.lit(letters)) * F.log2(F.lit(float(size)))
    ip, endless, birth = F.col("kind") == "ip", F.col("kind").isin("name", "address"), F.col("kind") == "birth"
    keyed = found.withColumns({"pattern": F.when(ip | endless | birth, F.lit("")).otherwise(pattern), "bits": F.when(ip, F.lit(31.0)).when(birth, F.lit(16.0)).when(endless, F.lit(1e9)).otherwise(bits)})
    sizes = keyed.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n"), F.max("bits").alias("bits")).where(F.log2("n") > F.col("bits") - 4)
    return keyed.join(sizes.select("kind", "pattern", F.lit(True).alias("crowded")), ["kind", "pattern"], "left").select("kind", "norm", F.coalesce("crowded", F.lit(False)).alias("crowded"))


def second_attempts(docs: DataFrame, key: bytes, rounds: int = 60) -> DataFrame:
    """Entities whose first surrogate is not free, with the attempt that is.

    A surrogate is free if no other entity of its kind got it and it is no entity
    of the corpus, both as they stand in the text. Of those that share one, the
    smallest keeps it. Only entity tables are shuffled, after a distinct in each
    task. A round settles all but a fraction of what it tries again, a sixteenth at
    most, so ``rounds`` are more than any corpus needs.
    """
    found = docs.select("text").mapInPandas(_distinct_entities, "kind string, norm string").distinct()
    found = materialize(_crowded(materialize(found, "pii-found")), "pii-patterns")
    real = found.select("kind", _shown("kind", "norm").alias("shown")).distinct()
    table = materialize(_with_surrogates(found.withColumn("attempt", F.lit(0)), key), "pii-entities")
    for _ in range(rounds):
        loose = table.where("NOT crowded")
        shared = loose.groupBy("kind", "shown").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("keeper")).where("n > 1")
        taken = loose.join(real, ["kind", "shown"]).select("kind", "norm")
        double = loose.join(shared, ["kind", "shown"]).where("norm <> keeper").select("kind", "norm")
        again = materialize(taken.unionByName(double).distinct(), "pii-again")
        if again.isEmpty():
            return table.where("attempt > 0").select("kind", "norm", "attempt")
        bumped = table.join(again.withColumn("again", F.lit(1)), ["kind", "norm"], "left")
        bumped = bumped.select("kind", "norm", "crowded", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
        table = materialize(_with_surrogates(bumped, key), "pii-entities")
    raise ValueError(f"surrogates still collide after {rounds} attempts")


def pseudonymise(docs: DataFrame, key: bytes, broadcast_limit: int = 20_000) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_<kind>`` for each kind of :data:`KINDS`.

    All other columns stay. Null texts stay null and empty ones empty, both with
    counts of 0; texts without entities stay as they are, byte for byte; equal
    rows get equal results. Columns named ``n_<kind>`` are replaced.

    The table of second attempts goes to the tasks as a dictionary while it has at
    most ``broadcast_limit`` rows. Beyond that each document gets its own entries
    by joins on the entity and then on the document.
    """
    attempts = materialize(second_attempts(docs, key), "pii-attempts")
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)

    def rewritten(texts: pd.Series, tables: list[dict[tuple[str, str], int]]) -> pd.DataFrame:
        made = lru_cache(maxsize=100_000)(surrogate)
        rows = [replace(t, key, table, made) for t, table in zip(texts, tables, strict=True)]
        return pd.DataFrame({"text": [t for t, _ in rows]} | {f"n_{k}": [c[k] for _, c in rows] for k in KINDS})

    if attempts.count() <= broadcast_limit:
        known = {(r["kind"], r["norm"]): r["attempt"] for r in attempts.collect()}

        @F.pandas_udf(f"text string, {counts}")
        def new(texts: pd.Series) -> pd.DataFrame:
            return rewritten(texts, [known] * len(texts))

        out = docs.select(F.struct("*").alias("row"), new("text").alias("new"))
    else:

        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = {(h, kind, norm) for h, text in zip(batch["hash"], batch["text"], strict=True) for _, _, kind, norm in entities(text)}
                yield pd.DataFrame(sorted(rows), columns=["hash", "kind", "norm"])

        @F.pandas_udf(f"text string, {counts}")
        def new_by_row(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
            return rewritten(texts, [{(k, n): int(a) for k, n, a in (e.split("\x1f") for e in (() if entries is None else entries))} for entries in own])

        hashed = docs.select(F.struct("*").alias("row"), F.sha2("text", 256).alias("hash"))
        entry = F.concat_ws("\x1f", "kind", "norm", F.col("attempt").cast("string"))
        own = (
            hashed.select("hash", "row.text")
            .mapInPandas(keyed, "hash string, kind string, norm string")
            .distinct()
            .join(attempts, ["kind", "norm"])
            .groupBy("hash")
            .agg(F.collect_list(entry).alias("own"))
        )
        out = hashed.join(own, "hash", "left").select("row", new_by_row("row.text", "own").alias("new"))
    # rows are packed, so a column of theirs may have any name
    counted = [f"n_{k}" for k in KINDS]
    kept = [F.col("new.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in counted]
    return out.select(*kept, *[f"new.{c}" for c in counted])
