"""PII surrogates: detected entities get keyed replacements of the same type and format.

Replacements come from keyed permutations of all entities of one form: Feistel rounds over the characters'
classes, one step on, and the rounds back, which is one cycle through all of them. So two entities never share a replacement, none is its
own, and one entity has the same replacement in every document and task, without any table of what was
replaced. What identifies the form stays: punctuation, lengths, letter case, an address's range, a
telephone's country code, a card's first digit and valid check digit, a name's gender and script.

A name is found behind a title; in the rest of its document its words are replaced too, as they are there, without one.
The key is a parameter, or the session's `spark.shiftlab.pii.key`, so that surrogates can't be traced back without it.

Entities of the same identity are replaced alike however they are written: spacing and
punctuation in numbers and letter case in addresses don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: The key where neither a parameter nor the session gives one, for tests.
KEY = b"shiftlab surrogate key"
ROUNDS = 8

# Titles with their gender, and given names and surnames by script.
TITLES = {"Mr": "m", "Mister": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Carl Daniel David Edward Felix George Henry Hugo Ivan James John Joseph Louis Lucas Mark Martin Michael Oliver Oscar Paul Peter Philip Ralph Robert Samuel Simon Stephen Thomas Walter William".split(),
    ("latin", "f"): "Agnes Alice Amelia Anna Barbara Carla Caroline Catherine Clara Diana Eleanor Elena Elizabeth Emma Esther Eva Frances Grace Hannah Helen Irene Jane Julia Laura Linda Lucy Maria Martha Mary Nora Olivia Rosa Ruth Sarah Sophia Susan".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Пётр Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Людмила Мария Надежда Наталья Ольга Светлана Татьяна".split(),
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Κατερίνα Μαρία".split(),
}
#: Of a letter, what it may be replaced with.
CLASSES = ("0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïðòóôõöøùúûüýÿ", "çñþß", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ")
_CLASS = {c: letters for letters in CLASSES for c in letters}

_EMAIL = r"(?P<email>(?<![\w.+-])\w[\w.+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[A-Za-z]{2,}(?![\w-]))"
# Words that secrets stand behind, and beginnings of access keys.
_KEYWORDS = ("token", "secret", "api_key", "apikey", "api-key", "access_key", "password", "passwd")
_BEGINNINGS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "sk-")
_GATES = (*_KEYWORDS, "bearer", *map(str.lower, _BEGINNINGS))
_SECRET = rf"""(?P<secret>(?i:{'|'.join(_KEYWORDS)})["']?\s*[:=]\s*(?:(?P<quote>["'])(?P<quoted>[\w+/=.-]{{8,}})(?=(?P=quote))|(?P<plain>(?=[\w+/=.-]{{0,256}}\d)[\w+/=-](?:[\w+/=.-]{{10,}})[\w+/=-](?![\w(])))|(?i:bearer)\s+(?P<bearer>(?=[\w+/=.~-]{{0,256}}\d)[\w+/=.~-]{{15,}}[\w+/=-])|(?<!\w)(?:{'|'.join(_BEGINNINGS)})(?P<access>[\w-]{{16,}}))"""
_IBAN = r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
_CARD = r"(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
_SSN = r"(?P<ssn>(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]))"
_PHONE = r"(?P<phone>(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]))"
_IP = r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
_NUMBERS, _NUMBERS_SECRETS = (re.compile("|".join((_EMAIL, *more, _IBAN, _CARD, _SSN, _PHONE, _IP))) for more in ((), (_SECRET,)))
_UPPER = "".join(filter(lambda c: c.isupper() and c.isalpha(), map(chr, range(0x20000))))
_NAMES = re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?P<name>[{_UPPER}][^\W\d_]*(?:[ -][{_UPPER}][^\W\d_]*)*)")
_CAPITAL = re.compile(rf"(?<!\w)[{_UPPER}][^\W\d_]*(?!\w)")
_VALUES = ("quoted", "plain", "bearer", "access")
_NO_DIGITS = bytes(i for i in range(256) if i not in b"0123456789@")


def luhn(digits: str) -> int:
    """The sum that is divisible by ten for a valid number."""
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits)))


def permuted(x: int, sizes: tuple[int, int], key: bytes, about: str) -> int:
    """A keyed permutation of range(sizes[0] * sizes[1])."""
    a, b = sizes
    left, right = divmod(x, b)
    for i in range(ROUNDS):
        left = (left + _round(key, about, i, a, b, 0, right)) % a
        right = (right + _round(key, about, i, a, b, 1, left)) % b
    return left * b + right


def _round(key: bytes, about: str, i: int, a: int, b: int, side: int, x: int) -> int:
    return int.from_bytes(blake2b(f"{about}|{i}|{a}|{b}|{side}|{x}".encode(), key=key, digest_size=64).digest(), "big")


def stepped(x: int, sizes: tuple[int, int], key: bytes, about: str) -> int:
    """The number after x on a keyed cycle through all of range(sizes[0] * sizes[1])."""
    a, b = sizes
    left, right = divmod((permuted(x, sizes, key, about) + 1) % (a * b), b)
    for i in reversed(range(ROUNDS)):
        right = (right - _round(key, about, i, a, b, 1, left)) % b
        left = (left - _round(key, about, i, a, b, 0, right)) % a
    return left * b + right


def among(x: int, n: int, key: bytes, about: str, allowed: Callable[[int], bool] = lambda _: True) -> int:
    """The number after x on a keyed cycle through those below n that are allowed; never x unless it is the only one."""
    half = max(1, n.bit_length() // 2)
    sizes = (1 << half, -(-n // (1 << half)))
    while True:
        x = stepped(x, sizes, key, about)
        if x < n and allowed(x):
            return x


def spelled(text: str, key: bytes, about: str, allowed: Callable[[str], bool] = lambda _: True) -> str:
    """The string after this one on a keyed cycle through those whose characters have the same classes; characters without one stay. Upper case stays upper case."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    at = [i for i, c in enumerate(low) if c in _CLASS]
    half = (len(at) + 1) // 2
    form = about + "|" + "".join(_CLASS[c][0] if c in _CLASS else c for c in low)

    def pack(places: list[int]) -> tuple[int, int]:
        x, n = 0, 1
        for i in places:
            x, n = x * len(_CLASS[low[i]]) + _CLASS[low[i]].index(low[i]), n * len(_CLASS[low[i]])
        return x, n

    if not at:
        return text
    (x, a), (y, b) = pack(at[:half]), pack(at[half:])
    v = x * b + y
    while True:
        v = stepped(v, (a, b), key, form)
        out, z = list(low), v
        for i in reversed(at):
            z, k = divmod(z, len(_CLASS[low[i]]))
            out[i] = _CLASS[low[i]][k]
        if allowed("".join(out)):
            return "".join(o.upper() if c != c.lower() and len(o.upper()) == 1 else o for o, c in zip(out, text, strict=True))


def _digits(found: str, digits: str) -> str:
    """`digits` in the places that digits have in `found`."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in found)


def _email(s: str, key: bytes) -> str:
    local, _, domain = s.rpartition("@")
    labels = domain.split(".")
    return f"{spelled(local, key, 'local')}@{'.'.join(spelled(x, key, 'domain') for x in labels[:-1])}.{labels[-1]}"


def _card(s: str, key: bytes) -> str:
    d = re.sub(r"\D", "", s)
    middle = f"{among(int(d[1:-1]), 10 ** (len(d) - 2), key, f'card{len(d)}{d[0]}'):0{len(d) - 2}d}"
    return _digits(s, d[0] + middle + str(-luhn(d[0] + middle + "0") % 10))


def _ssn(s: str, key: bytes) -> str:
    ok = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 and x % 10**4
    return _digits(s, f"{among(int(s.replace('-', '')), 10**9, key, 'ssn', ok):09d}")


def _phone(s: str, key: bytes) -> str:
    country = re.match(r"\+\d{1,3}(?=\D)|", s)[0]
    d = re.sub(r"\D", "", s[len(country) :])
    if not country and s[0] == "+":
        country, d = s[:2], re.sub(r"\D", "", s[2:])
    return country + _digits(s[len(country) :], f"{among(int(d), 10 ** len(d), key, f'phone{country}{len(d)}'):0{len(d)}d}")


#: Ranges of addresses that stay in themselves: bits in front, and how many.
_RANGES = ((0, 8), (10, 8), (127, 8), (0xA9FE, 16), (0xAC1, 12), (0xC0A8, 16), (0xE, 4), (0xF, 4))


def _ip(s: str, key: bytes) -> str:
    x = 0
    for part in s.split("."):
        x = x << 8 | int(part)
    for front, bits in _RANGES:
        if x >> (32 - bits) == front:
            y = front << (32 - bits) | among(x & ((1 << (32 - bits)) - 1), 1 << (32 - bits), key, f"ip{front}/{bits}")
            break
    else:
        y = among(x, 1 << 32, key, "ip", lambda y: all(y >> (32 - bits) != front for front, bits in _RANGES))
    return ".".join(str(y >> i & 255) for i in (24, 16, 8, 0))


def _iban_sum(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str, key: bytes) -> str:
    plain = s.replace(" ", "")
    body = spelled(plain[4:], key, f"iban{plain[:2]}")
    it = iter(plain[:2] + f"{98 - _iban_sum(plain[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(it) for c in s)


def _secret(s: str, key: bytes) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        new = f"{among(int(s, 16), 16 ** len(s), key, f'hex{len(s)}'):0{len(s)}x}"
        return new.upper() if s.isupper() else new
    return spelled(s, key, "secret")


_KNOWN = frozenset(x.lower() for names in GIVEN.values() for x in names)


def _name(name: str, gender: str, key: bytes) -> str:
    """Names of a list are permuted within it; other words keep their pattern of vowels and consonants, and none becomes a name of the lists."""
    out = []
    for word in re.split(r"([ -])", name):
        known = word.capitalize()
        lists = sorted((g != gender, x) for (script, g), x in GIVEN.items() if known in x)
        if lists:
            names = lists[0][1]
            new = names[among(names.index(known), len(names), key, f"given{names[0]}")]
            out.append(new.upper() if len(word) > 1 and word.isupper() else new)
        else:
            out.append(spelled(word, key, "name", lambda x: x not in _KNOWN))
    return "".join(out)


_SURROGATE = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip}


@lru_cache(1 << 16)
def surrogate(kind: str, found: str, gender: str = "", key: bytes = KEY) -> str:
    return _name(found, gender, key) if kind == "name" else _SURROGATE[kind](found, key)


def _valid(kind: str, s: str) -> bool:
    if kind == "card":
        return luhn(re.sub(r"\D", "", s)) % 10 == 0 and len(set(s)) > 2
    if kind == "iban":
        return _iban_sum(s.replace(" ", "")) == 1
    return kind != "phone" or 9 <= sum(map(str.isdigit, s)) <= 15


def _mentions(text: str, names: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """The words of detected names wherever they stand in the text, those side by side together; the gender is that of the first name that has the word."""
    gender: dict[str, str] = {}
    for start, end, _, g in names:
        for word in re.split("[ -]", text[start:end]):
            if len(word) > 1:
                gender.setdefault(word.lower(), g)
    begin = stop = 0
    own = ""
    for m in _CAPITAL.finditer(text):
        word = m[0].lower()
        if word not in gender:
            continue
        if stop and m.start() == stop + 1 and text[stop] in " -" and (gender[word] == own or not gender[word]):
            stop = m.end()
            continue
        if stop:
            yield begin, stop, "name", own
        begin, stop, own = *m.span(), gender[word]
    if stop:
        yield begin, stop, "name", own


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities, in order, none overlapping; gender only for names after a title that has one."""
    found: list[tuple[int, int, str, str]] = []
    low = text.lower()
    keyword = any(k in low for k in _GATES)
    if keyword or text.encode().translate(None, _NO_DIGITS):
        at, pattern = 0, _NUMBERS_SECRETS if keyword else _NUMBERS
        while m := pattern.search(text, at):
            kind = "secret" if m.re is _NUMBERS_SECRETS and m["secret"] else m.lastgroup
            if _valid(kind, m[0]):
                found.append((*m.span(next(g for g in _VALUES if m[g]) if kind == "secret" else 0), kind, ""))
                at = m.end()
            else:  # another kind may begin inside
                at = m.start() + 1
                while at < m.end() and text[at].isdigit():
                    at += 1
    if any(t in text for t in TITLES):
        names = _apart(found, [(*m.span("name"), "name", TITLES[m["title"]]) for m in _NAMES.finditer(text)])
        found = sorted(found + names)
        found += _apart(found, list(_mentions(text, names)) if names else [])
    return sorted(found)


def _apart(found: list[tuple[int, int, str, str]], more: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Those of `more` that don't overlap any of the sorted and disjoint `found`."""
    starts = [x[0] for x in found]
    free = lambda x, k: (k == 0 or found[k - 1][1] <= x[0]) and (k == len(found) or found[k][0] >= x[1])
    return [x for x in more if free(x, bisect_left(starts, x[0]))]


def replaced(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (kind, start, end in the old text, surrogate) of each."""
    out, at, entities = [], 0, []
    for start, end, kind, gender in detect(text):
        new = surrogate(kind, text[start:end], gender, key)
        out += [text[at:start], new]
        at = end
        entities.append((kind, start, end, new))
    return ("".join([*out, text[at:]]) if entities else text), entities


ENTITIES = "array<struct<kind: string, start: int, end: int, surrogate: string>>"
_ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def surrogates(docs: DataFrame, text: str = "text", key: bytes | None = None) -> DataFrame:
    """`docs` with its text replaced and a column `pii_entities` (one of that name is replaced); rows, order of columns and other values stay.

    A null text stays null and an empty one empty, both without entities. Start and end count code points of the old text.
    """
    if key is None:
        own = docs.sparkSession.conf.get("spark.shiftlab.pii.key", None)
        key = own.encode()[:64] if own else KEY
    docs = docs.drop("pii_entities")
    at = docs.columns.index(text)
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    schema = docs.select("*", F.expr(f"cast(null as {ENTITIES})").alias("pii_entities")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, []) if t is None else replaced(t, key) for t in b.column(at).to_pylist()]
            rows = [[dict(zip(("kind", "start", "end", "surrogate"), e)) for e in found] for _, found in done]
            columns = [*b.columns[:at], pa.array([x for x, _ in done], pa.string()), *b.columns[at + 1 :], pa.array(rows, _ENTITIES)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "pii_entities"])

    return docs.mapInArrow(run, schema)


def collisions(docs: DataFrame, text: str = "text", key: bytes | None = None) -> DataFrame:
    """(kind, surrogate, n): surrogates that stand for more than one entity, letter case and punctuation aside; none by construction."""
    found = surrogates(docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{text}`").alias("old")), "text", key)
    e = found.select("old", F.explode("pii_entities").alias("e")).select("e.kind", F.expr("substring(old, e.start + 1, e.end - e.start)").alias("old"), "e.surrogate")
    plain = lambda c: F.when(F.col("kind").isin("email", "name", "secret", "ip"), F.when(F.col("kind") == "secret", F.col(c)).otherwise(F.lower(c))).otherwise(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    return e.select("kind", plain("old").alias("old"), plain("surrogate").alias("surrogate")).groupBy("kind", "surrogate").agg(F.countDistinct("old").alias("n")).where("n > 1")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_entities, entities) of every document."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return surrogates(docs).select("doc_id", "text", F.size("pii_entities").alias("n_entities"), F.col("pii_entities").alias("entities"))
