"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Values are found by pattern and validated (check digits, calendar, octets, lengths), then permuted within the set of
values of the same format: a card number becomes another number with a valid check digit and the same separators, a
date another date in the same notation. A value is first brought to one form (a card's digits, a day, a phone's country
code and digits, an IBAN's capitals), and the permutation of that form depends on the key and the kind only: equal values
get equal pseudonyms in all documents, each in its own notation, and the key's holder can invert it.

Kinds: card (Luhn, 13 to 19 digits), iban (mod 97, in capitals or small letters), ssn, phone, ip (IPv4), date (numeric and
English, 1900 to 2099), email (letters and digits before the @), secret (hexadecimal strings of 16 or more with letters
and digits; keys with a well-known prefix, which stays).

Days up to the 12th and later ones are permuted among themselves: whether a date with strokes puts its day or its month
first is told by a number over 12, and so stays as it was (else the month comes first). A phone number without a country
code is linked with the same digits behind any code.

A card or IBAN that is followed by what could be its last groups (an expiry date, a code, a capital word) ends at the last
group with which it is valid; where a longer reading is valid by chance, that is taken. A date may have a time behind T.

Defined results: a null text stays null and has no values; values that fail validation stay as they are; repeated rows
get equal results; other columns of the input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from annogrid.llm.common import map_batches

ROUNDS = 8
_NAMED = {"date_us": "date", "token": "secret"}
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS)
#: fixed values: keys of well-known services, each by its prefix
_KEYS = "AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36}|github_pat_[0-9A-Za-z_]{82}|glpat-[0-9A-Za-z_-]{20}|sk_live_[0-9A-Za-z]{24}|xox[abprs]-[0-9A-Za-z-]{10,72}|AIza[0-9A-Za-z_-]{35}"
_PREFIX = re.compile("AKIA|ASIA|gh[oprsu]_|github_pat_|glpat-|sk_live_|xox[abprs]-|AIza")
#: fixed values: country calling codes of two digits; 1 and 7 have one, all others three
_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_FOUND = re.compile(
    rf"""
    (?P<token>(?<![0-9A-Za-z])(?:{_KEYS})(?![0-9A-Za-z]))
  | (?P<secret>(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{{16,}}(?![0-9A-Za-z]))
  | (?P<iban>(?<![0-9A-Za-z])[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?![0-9A-Za-z])
      |(?<![0-9A-Za-z])[a-z]{{2}}\d{{2}}(?:[ ]?[a-z0-9]{{4}}){{2,7}}(?:[ ]?[a-z0-9]{{1,3}})?(?![0-9A-Za-z]))
  | (?P<ip>(?<![\w.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?![\w]|\.\d))
  | (?P<date>(?<![\w/.-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}/\d{{2}}/\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}
      |\d{{1,2}}[ ](?:{_MONTH})[ ]\d{{4}})(?!(?!T\d{{2}}:?\d{{2}})[\w/-]|\.\d))
  | (?P<date_us>(?<!\w)(?:{_MONTH})[ ]\d{{1,2}},[ ]\d{{4}}(?!\w))
  | (?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
  | (?P<phone>(?<![\w+])(?:\+\d{{1,3}}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}(?!\w)|(?<![\w+])\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,5}}(?![\w])
      |(?<![\w.+-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-]|\.\d))
  | (?P<card>(?<![\w+-])(?:\d{{13,19}}|\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{1,4}}(?:[ -]\d{{1,3}})?|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}})(?![\w-]))
""",
    re.X,
)
#: Where a value of the big pattern can begin; the search jumps from one such place to the next.
_START = re.compile(rf"\d|[+(]\d|(?:{_PREFIX.pattern})[0-9A-Za-z]|(?:[A-Z]{{2}}|[a-z]{{2}})\d\d[ 0-9A-Za-z]|[a-f]+\d|(?:{_MONTH}) \d")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")


def luhn(digits: str) -> int:
    """The check digit that completes these digits."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 else (2 * d if d < 5 else 2 * d - 9)
    return -total % 10


class Pseudonyms:
    """Permutations of formats under a key; equal values of a kind are remembered while the object lives."""

    LIMIT = 100_000

    def __init__(self, key: bytes):
        self.key, self.known = key, {}

    def _mix(self, kind: str, step: int, size: int, half: int, modulus: int) -> int:
        h = hashlib.blake2b(f"{kind}|{step}|{size}|{half}".encode(), key=self.key[:64], digest_size=16 + modulus.bit_length() // 8)
        return int.from_bytes(h.digest(), "big") % modulus

    def permute(self, value: int, left: int, right: int, kind: str, back: bool = False) -> int:
        """An unbalanced Feistel network on the numbers below left * right."""
        a, b = divmod(value, right)
        size = left * right
        steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        for step in steps:
            if step % 2 == 0:
                f = self._mix(kind, step, size, b, left)
                a = (a - f if back else a + f) % left
            else:
                f = self._mix(kind, step, size, a, right)
                b = (b - f if back else b + f) % right
        return a * right + b

    def digits(self, text: str, kind: str, back: bool = False, base: int = 10) -> str:
        """Another string of as many digits."""
        n = len(text)
        left, right = base ** (n - n // 2), base ** (n // 2)
        value = self.permute(int(text, base), left, right, kind, back)
        out = []
        for _ in range(n):
            value, d = divmod(value, base)
            out.append("0123456789abcdef"[d])
        return "".join(reversed(out))

    def mixed(self, text: str, kind: str, back: bool = False) -> str:
        """Letters stay letters of the same case, digits digits, and other characters themselves."""
        classes = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
        places = [(i, c) for i, x in enumerate(text) for c in classes if x in c]
        if not places:
            return text
        cut = (len(places) + 1) // 2
        left = right = 1
        value = 0
        for k, (i, c) in enumerate(places):
            left, right = (left * len(c), right) if k < cut else (left, right * len(c))
            value = value * len(c) + c.index(text[i])
        value = self.permute(value, left, right, f"{kind}:{left}:{right}", back)
        out = list(text)
        for i, c in reversed(places):
            value, d = divmod(value, len(c))
            out[i] = c[d]
        return "".join(out)

    def day(self, day: datetime.date, back: bool = False) -> datetime.date:
        """Another day of the calendar, up to the 12th of its month if this one is."""
        span = _LAST - _FIRST + 1
        value = day.toordinal() - _FIRST
        while True:  # a walk along the cycle stays within the calendar's days of the same half
            value = self.permute(value, 271, 270, "date", back)
            if value < span:
                new = datetime.date.fromordinal(_FIRST + value)
                if (new.day > 12) == (day.day > 12):
                    return new

    def pseudonym(self, kind: str, text: str, back: bool = False) -> str | None:
        """Another value of the same kind and format, or None if the text isn't a valid one."""
        key = (kind, text, back)
        if key not in self.known:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            self.known[key] = getattr(self, f"_{kind}")(text, back)
        return self.known[key]

    def _spread(self, text: str, digits: str) -> str:
        new = iter(digits)
        return "".join(next(new) if x.isdigit() else x for x in text)

    def _card(self, text: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = self.digits(digits[:-1], "card", back)
        return self._spread(text, body + str(luhn(body)))

    def _iban(self, text: str, back: bool) -> str | None:
        plain = text.replace(" ", "").upper()
        numeric = lambda s: "".join(str(int(x, 36)) for x in s)
        if not 15 <= len(plain) <= 34 or int(numeric(plain[4:] + plain[:4])) % 97 != 1:
            return None
        body = self.mixed(plain[4:], f"iban{plain[:2]}", back)
        check = 98 - int(numeric(body + plain[:2] + "00")) % 97
        new = iter(f"{plain[:2]}{check:02d}{body}")
        made = "".join(x if x == " " else next(new) for x in text)
        return made.lower() if text[:2].islower() else made

    def _ssn(self, text: str, back: bool) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [x for x in range(1, 900) if x != 666]
        value = self.permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas), 99 * 9999, "ssn", back)
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, text: str, back: bool) -> str | None:
        kept = 0
        if text.startswith("+"):
            code = re.sub(r"\D", "", text)[:3]
            length = 1 if code[0] in "17" else 2 if code[:2] in _CODES else 3
            places = [i for i, x in enumerate(text) if x.isdigit()]
            kept = places[length - 1] + 1 if len(places) > length else 0
        digits = re.sub(r"\D", "", text[kept:])
        if not 7 <= len(digits) <= 14:
            return None
        return text[:kept] + self._spread(text[kept:], self.digits(digits, "phone", back))

    def _ip(self, text: str, back: bool) -> str | None:
        octets = text.split(".")
        if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in octets):
            return None
        value = 0
        for x in octets:
            value = value * 256 + int(x)
        value = self.permute(value, 1 << 16, 1 << 16, "ip", back)
        return ".".join(str(value >> k & 255) for k in (24, 16, 8, 0))

    def _date(self, text: str, back: bool) -> str | None:
        return self._date_as(text, back)

    def _date_us(self, text: str, back: bool) -> str | None:
        return self._date_as(text, back)

    def _date_as(self, text: str, back: bool) -> str | None:
        numbers = [int(x) for x in re.findall(r"\d+", text)]
        name = re.search(r"[A-Za-z]+", text)
        try:
            if name:
                month = 1 + next(k for k, m in enumerate(_MONTHS) if m.startswith(name[0]))
                year, day = numbers[1], numbers[0]
            elif numbers[0] > 999:
                year, month, day = numbers
            elif "." in text or numbers[0] > 12:
                day, month, year = numbers
            else:
                month, day, year = numbers
            old = datetime.date(year, month, day)
        except ValueError:
            return None
        if not _FIRST <= old.toordinal() <= _LAST:
            return None
        new = self.day(old, back)
        if name:
            word = _MONTHS[new.month - 1] if len(name[0]) > 3 or name[0] == "May" else _MONTHS[new.month - 1][:3]
            return f"{word} {new.day}, {new.year}" if text[0].isalpha() else f"{new.day} {word} {new.year}"
        sep = re.search(r"\D", text)[0]
        if numbers[0] > 999:
            return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
        day_first = sep == "." or numbers[0] > 12
        wide = any(len(x) == 2 and x[0] == "0" for x in re.findall(r"\d+", text)[:2]) or all(len(x) == 2 for x in re.findall(r"\d+", text)[:2])
        first, second = (new.day, new.month) if day_first else (new.month, new.day)
        return f"{first:02d}{sep}{second:02d}{sep}{new.year:04d}" if wide else f"{first}{sep}{second}{sep}{new.year:04d}"

    def _email(self, text: str, back: bool) -> str | None:
        local, _, domain = text.partition("@")
        return f"{self.mixed(local, 'email', back)}@{domain}" if any(x.isalnum() for x in local) else None

    def _token(self, text: str, back: bool) -> str | None:
        kept = _PREFIX.match(text).end()
        return text[:kept] + self.mixed(text[kept:], "token", back)

    def _secret(self, text: str, back: bool) -> str | None:
        if re.match(r"[a-f]{2}\d\d", text) and len(text) <= 34 and (iban := self._iban(text, back)):
            return iban
        return self.digits(text, "secret", back, 16)


def _ends(m: re.Match) -> list[int]:
    """Where the value of a match may end: as matched, else (cards and IBANs, whose last groups are optional) at a group before."""
    borders = {"card": " -", "iban": " "}.get(m.lastgroup, "")
    return [m.end(), *(k for k in range(m.end() - 1, m.start(), -1) if m.string[k] in borders)]


def find(text: str, valid=lambda kind, value: True) -> list[tuple[int, int, str]]:
    """Places that look like values and are valid: start, end and kind, in order and apart."""
    found, at = [], 0
    while m := _START.search(text, at):
        at = m.start()
        v = _FOUND.match(text, at)
        end = next((k for k in _ends(v) if valid(v.lastgroup, text[at:k])), None) if v else None
        if end:
            found.append((at, end, v.lastgroup))
            at = end
        elif text[at].isdigit():  # a value doesn't begin within a number
            while at < len(text) and text[at].isdigit():
                at += 1
        else:
            at += 1
    at = text.find("@")
    mails = []
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        low = mails[-1][1] if mails else 0
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        while start < at and text[start] in "._%+-":
            start += 1
        if m and start < at and valid("email", text[start : m.end()]):
            mails.append((start, m.end(), "email"))
            at = m.end() - 1
        at = text.find("@", at + 1)
    if mails:
        found = sorted(mails + [f for f in found if not any(a < f[1] and f[0] < b for a, b, _ in mails)])
    return found


def replace(text: str, pseudonyms: Pseudonyms, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the places replaced (in the original text)."""
    out, done, places = [], 0, []
    for start, end, kind in find(text, lambda k, v: pseudonyms.pseudonym(k, v, back) is not None):
        out += [text[done:start], pseudonyms.pseudonym(kind, text[start:end], back)]
        done = end
        places.append((start, end, _NAMED.get(kind, kind)))
    return ("".join(out) + text[done:] if places else text), places


_own_key: list[bytes] = []


def key_of(spark: SparkSession) -> bytes:
    """The key of this application: the setting spark.annogrid.pii.key, else ANNOGRID_PII_KEY of the driver, else a random
    one, with which pseudonyms are linked within the application only and can't be inverted after it."""
    named = spark.conf.get("spark.annogrid.pii.key", None) or os.environ.get("ANNOGRID_PII_KEY")
    if named:
        return named.encode()
    if not _own_key:
        _own_key.append(secrets.token_bytes(32))
    return _own_key[0]


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (the id by default), the text with pseudonyms, n_values, and values: start, end, kind of each."""
    keep = [x for x in (keep or [id_col]) if x != text_col]
    types = dict(docs.dtypes)
    state: dict = {}
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["p"] = Pseudonyms(key)
        texts, counts, values = [], [], []
        for text in batch.column(len(keep)).to_pylist():
            new, places = replace(text, state["p"]) if text else (text, [])
            texts.append(new)
            counts.append(len(places))
            values.append([{"start": a, "end": b, "kind": k} for a, b, k in places])
        columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(values, pa.list_(place))]
        return pa.RecordBatch.from_arrays(columns, [*keep, "_text", "_n", "_values"])

    schema = "".join(f"`{x}` {types[x]}, " for x in keep)
    done = map_batches(docs.select(*keep, text_col), run, f"{schema}_text string, _n long, _values array<struct<start:long,end:long,kind:string>>")
    return done.withColumnsRenamed({"_text": text_col, "_n": "n_values", "_values": "values"})
