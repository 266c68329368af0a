"""PII: format-preserving pseudonyms from keyed Feistel permutations.

A value is found by pattern, validated (Luhn, mod 97, calendar, ranges), reduced to its canonical digits
or day number, permuted within the set of valid values of its kind by a Feistel network, and written back
in the layout it had. The permutation depends on the key and the kind only, so equal values get equal
pseudonyms in every document and layout, different values get different ones, and the key's holder can
turn them back (``Vault.reveal``).

A date is permuted among those that every layout writes alike: with as many digits in day and month, on the
same side of the 12th (which tells day from month), and in May or not (whose name has no shorter form). So
each layout keeps its width and its order, at the price of keeping just that much of the date.

One pass over the documents without a shuffle; the broadcast is the key.
"""

from __future__ import annotations

import hashlib
import math
import re
from datetime import date, timedelta
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quantloom.llm.common import map_bytes

ROUNDS = 10
#: Letters of a name that are permuted together, and networks that a worker remembers.
BLOCK, REMEMBERED = 64, 10_000
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
# Month names by language family in the layouts that are recognised.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

_MONTH = "|".join([*MONTHS, *[m[:3] for m in MONTHS]])
_PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9_][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+)"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?P<key>AKIA[A-Z0-9]{16}|[0-9a-f]{40}|[0-9A-F]{40})(?![A-Za-z0-9])"
    r"|(?<![0-9.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])"
    r"|(?<![0-9A-Za-z])(?P<ymd>[0-9]{4}([-/.])[0-9]{1,2}\6[0-9]{1,2})(?![0-9])"
    r"|(?<![0-9A-Za-z])(?P<dmy>[0-9]{1,2}([-/.])[0-9]{1,2}\8[0-9]{4})(?![0-9])"
    rf"|(?<![0-9A-Za-z])(?P<dmon>[0-9]{{1,2}} (?:{_MONTH}) [0-9]{{4}})(?![0-9])"
    rf"|(?<![A-Za-z])(?P<mond>(?:{_MONTH}) [0-9]{{1,2}}, [0-9]{{4}})(?![0-9])"
    r"|(?<![0-9A-Za-z\-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9\-])"
    r"|(?<![0-9A-Za-z])(?P<phone>\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[.\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])"
    r"|(?<![0-9A-Za-z])(?P<card>[0-9](?:[ \-]?[0-9]){12,18})(?![0-9])"
)
#: Every value has one of these; the pattern is tried only in the words around them.
_HINT = re.compile(r"[0-9@]+|AKIA")
_SPACE = re.compile(r"\s")
#: Groups of an account number that have no digit, after one that has.
_GROUPS = re.compile(r"(?: [A-Z0-9]{1,4}(?![A-Za-z0-9]))+")
#: Words before a hint that a value can start in.
WORDS_BEFORE = 2
#: Kinds in the order of the report's counts.
KINDS = ["email", "iban", "key", "ip", "date", "ssn", "phone", "card"]


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c)
        total += d if i % 2 else 2 * d - 9 * (d > 4)
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{98 - int(number) % 97:02d}"


class Feistel:
    """Keyed permutation of range(size): an alternating Feistel network over a pair of mixed radix digits,
    walked until it lands in range."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.key, self.size = key, size
        self.kind = f"{kind}/{size}".encode()
        self.b = max(1, math.isqrt(size - 1) + 1) if size > 1 else 1
        self.a = -(-size // self.b)

    def _mix(self, round_: int, value: int, size: int) -> int:
        data = self.kind + round_.to_bytes(1, "big") + value.to_bytes((value.bit_length() + 8) // 8, "big")
        n = max(16, (size.bit_length() + 7) // 8 + 8)
        out = b"".join(
            hashlib.blake2b(data + bytes([i]), key=self.key, digest_size=min(64, n)).digest() for i in range(-(-n // 64))
        )
        return int.from_bytes(out, "big") % size

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                left = (left + sign * self._mix(r, right, self.a)) % self.a
            else:
                right = (right + sign * self._mix(r, left, self.b)) % self.b
        return left * self.b + right

    def walk(self, x: int, valid=None, back: bool = False) -> int:
        """The next value of the permutation that is in range and, if asked, valid."""
        while True:
            x = self._once(x, back)
            if x < self.size and (valid is None or valid(x)):
                return x


class Vault:
    """Pseudonyms of all kinds under one key."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.nets: dict[tuple[str, int], Feistel] = {}

    def _net(self, kind: str, size: int) -> Feistel:
        if len(self.nets) >= REMEMBERED:
            self.nets.clear()
        return self.nets.setdefault((kind, size), Feistel(self.key, kind, size))

    def _string(self, kind: str, text: str, alphabets: list[str], back: bool, valid=None) -> str:
        """Permute the strings with the given alphabet at each place."""
        x, size = 0, 1
        for c, letters in zip(text, alphabets, strict=True):
            x = x * len(letters) + letters.index(c)
            size *= len(letters)
        decode = lambda v: _spell(v, alphabets)
        y = self._net(f"{kind}:{'|'.join(map(_class, alphabets))}", size).walk(x, valid and (lambda v: valid(decode(v))), back)
        return decode(y)

    def _digits(self, kind: str, text: str, back: bool, valid=None) -> str:
        return self._string(kind, text, [DIGITS] * len(text), back, valid)

    def replace(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym of a value (or, with ``back``, the value of a pseudonym); None if it isn't valid."""
        return getattr(self, f"_{kind}")(value, back)

    def _email(self, value, back):
        local, _, domain = value.rpartition("@")
        places = [i for i, c in enumerate(local) if c.isalnum() and c.isascii()]
        kinds = [DIGITS if local[i] in DIGITS else LOWER if local[i] in LOWER else UPPER for i in places]
        out, plain = list(local), hashlib.blake2b(key=self.key)
        # a long name goes block by block, each under what stands before it
        for at in range(0, len(places), BLOCK):
            some = places[at : at + BLOCK]
            old = "".join(local[i] for i in some)
            new = self._string(f"email{plain.hexdigest() if at else ''}", old, kinds[at : at + BLOCK], back)
            plain.update((new if back else old).encode())
            for i, c in zip(some, new, strict=True):
                out[i] = c
        return f"{''.join(out)}@{domain}"

    def _key(self, value, back):
        if value.startswith("AKIA"):
            return "AKIA" + self._string("key", value[4:], [UPPER + DIGITS] * 16, back)
        new = self._string("key", value.lower(), [HEX] * 40, back)
        return new.upper() if value.upper() == value else new

    def _iban(self, value, back):
        plain = value.replace(" ", "")
        country, check, rest = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_digits(country, rest) != check:
            return None
        places = [i for i, c in enumerate(rest) if c in DIGITS]
        new = list(rest)
        for i, c in zip(places, self._digits("iban", "".join(rest[i] for i in places), back), strict=True):
            new[i] = c
        rest = "".join(new)
        return _laid_out(country + iban_digits(country, rest) + rest, value, lambda c: c != " ")

    def _ip(self, value, back):
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = 0
        for p in parts:
            x = x << 8 | int(p)
        y = self._net("ip", 1 << 32).walk(x, back=back)
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))

    def _day(self, y: int, m: int, d: int, back) -> date | None:
        try:
            day = date(y, m, d)
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        days, place = _days()[_shape(day)], _places()[day]
        shape = "".join(map(str, _shape(day)))
        return days[self._net(f"date:{shape}", len(days)).walk(place, back=back)]

    def _ymd(self, value, back):
        mark = value[4]
        y, m, d = value.split(mark)
        new = self._day(int(y), int(m), int(d), back)
        return new and mark.join((f"{new.year:04d}", _padded(new.month, m), _padded(new.day, d)))

    def _dmy(self, value, back):
        mark = re.search(r"[-/.]", value).group()
        a, b, y = value.split(mark)
        # month first with slashes, day first otherwise; the other order if only that is a date
        for month_first in (mark == "/", mark != "/"):
            m, d = (a, b) if month_first else (b, a)
            new = self._day(int(y), int(m), int(d), back)
            if new:
                pair = (_padded(new.month, m), _padded(new.day, d))
                return mark.join((*(pair if month_first else pair[::-1]), f"{new.year:04d}"))
        return None

    def _named(self, d, name, y, back):
        month = next(i for i, m in enumerate(MONTHS) if m[:3] == name[:3])
        new = self._day(int(y), month + 1, int(d), back)
        if new is None:
            return None
        long = MONTHS[new.month - 1]
        return _padded(new.day, d), long if len(name) > 3 else long[:3], f"{new.year:04d}"

    def _dmon(self, value, back):
        new = self._named(*value.split(" "), back)
        return new and " ".join(new)

    def _mond(self, value, back):
        name, d, y = value.replace(",", "").split(" ")
        new = self._named(d, name, y, back)
        return new and f"{new[1]} {new[0]}, {new[2]}"

    def _ssn(self, value, back):
        plain = value.replace("-", "")
        return None if not _is_ssn(plain) else _laid_out(self._digits("ssn", plain, back, _is_ssn), value)

    def _phone(self, value, back):
        plain = re.sub(r"[^0-9]", "", value)
        code = len(re.match(r"\+?([0-9]*)", value).group(1)) if value[0] == "+" else 0
        if code > 3:  # digits run together: one of +1 and +7 is the code, or two digits
            code = 1 if plain[0] in "17" else 2
        if not 7 <= len(plain) - code <= 12 or len(plain) > 15:
            return None
        return _laid_out(plain[:code] + self._digits("phone", plain[code:], back), value)

    def _card(self, value, back):
        plain = re.sub(r"[^0-9]", "", value)
        if luhn_digit(plain[:-1]) != plain[-1]:
            return None
        payload = self._digits("card", plain[:-1], back)
        return _laid_out(payload + luhn_digit(payload), value)

    def redact(self, text: str, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
        """Text with pseudonyms, and what was replaced: (start, end, kind) in the input."""
        out, spans, done = [], [], 0
        for m in (m for a, b in _windows(text) for m in _PATTERN.finditer(text, a, b)):
            kind = m.lastgroup
            new = self.replace(kind, m.group(kind), back)
            if new is None:
                continue
            a, b = m.span(kind)
            out += [text[done:a], new]
            done = b
            spans.append((a, b, "date" if kind in ("ymd", "dmy", "dmon", "mond") else kind))
        return ("".join([*out, text[done:]]) if spans else text), spans

    def reveal(self, text: str) -> str:
        return self.redact(text, back=True)[0]


def _windows(text: str) -> list[list[int]]:
    """Stretches of text that can hold a value: hints with the words around them, joined if they meet."""
    out: list[list[int]] = []
    for m in _HINT.finditer(text):
        if out and m.end() <= out[-1][1]:
            continue
        a = m.start()
        floor = out[-1][1] if out else 0  # back to the stretch before at most, so that all steps are linear
        for _ in range(WORDS_BEFORE + 1):
            a = max(text.rfind(" ", floor, a), text.rfind("\n", floor, a), floor)
        space = _SPACE.search(text, m.end())
        b = space.start() if space else len(text)
        groups = _GROUPS.match(text, b)
        b = groups.end() if groups else b
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def _shape(day: date) -> tuple[int, int]:
    """What all layouts of a date show of its shape: digits of the month and May; digits of the day and the 12th."""
    return (3 if day.month == 5 else len(str(day.month))), (3 if day.day > 12 else len(str(day.day)))


@cache
def _days() -> dict[tuple[int, int], list[date]]:
    """The days of each shape, in order."""
    found: dict[tuple[int, int], list[date]] = {}
    for k in range((LAST_DAY - FIRST_DAY).days + 1):
        day = FIRST_DAY + timedelta(k)
        found.setdefault(_shape(day), []).append(day)
    return found


@cache
def _places() -> dict[date, int]:
    return {day: k for days in _days().values() for k, day in enumerate(days)}


def _is_ssn(plain: str) -> bool:
    return plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000"


def _class(letters: str) -> str:
    return f"{letters[0]}{len(letters)}"


def _spell(value: int, alphabets: list[str]) -> str:
    out = []
    for letters in reversed(alphabets):
        value, k = divmod(value, len(letters))
        out.append(letters[k])
    return "".join(reversed(out))


def _padded(number: int, like: str) -> str:
    return f"{number:02d}" if len(like) == 2 else str(number)


def _laid_out(plain: str, like: str, solid=str.isdigit) -> str:
    """The characters of plain at the solid places of like."""
    given = iter(plain)
    return "".join(next(given) if solid(c) else c for c in like)


def pseudonymize(docs: DataFrame, key: bytes, keep: list[str] | None = None) -> DataFrame:
    """Replace text by its pseudonymised form; append n_replaced and kinds (kind -> count, as a text
    like "card=1,date=2").

    Values that match a pattern but don't validate stay as they are. Null texts stay null, empty ones
    empty; rows may repeat and are treated alike. Input columns named like an added one are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key)
    hint = re.compile(rb"[0-9@]|AKIA")

    def rows():
        vault = Vault(shared.value)

        def step(texts):
            new, count, kinds = [], [], []
            for raw in texts:
                if raw is None or not hint.search(raw):
                    new.append(raw if raw is None else raw.decode("utf-8", "replace"))
                    count.append(0)
                    kinds.append("")
                    continue
                text, spans = vault.redact(raw.decode("utf-8", "replace"))
                found = [k for _, _, k in spans]
                new.append(text)
                count.append(len(found))
                kinds.append(",".join(f"{k}={found.count(k)}" for k in KINDS if k in found))
            return [new, count, kinds]

        return step

    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "text"]
    fields = [T.StructField("text", T.StringType()), T.StructField("n_replaced", T.IntegerType()), T.StructField("kinds", T.StringType())]
    return map_bytes(docs, fields, rows, keep=kept)
