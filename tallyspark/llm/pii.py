"""PII: format-preserving pseudonyms by a keyed Feistel network.

Found values are validated first - card numbers by their check digit, phone
numbers by their shape, addresses of hosts by their octets, IBANs by their
remainder, dates by the calendar - so that other numbers stay.  A value's digits
(or letters) are permuted by a keyed Feistel network over all strings of the same
length and alphabet, so equal values become equal pseudonyms in every document
and on every executor, different ones stay different, and the holder of the key
can undo it.  Separators, country codes and lengths stay.  Check digits are made
anew, dates move to another day of 1900 to 2099 (one without leading zeros may get
them), and mail addresses and
secret tokens keep their shape too (letters to letters, digits to digits).

Secret tokens are long hexadecimal numbers, or a known head with its separator and a run of 16 letters and
digits or more behind it, so that words and identifiers that merely begin alike (skyscraper-construction,
pkg_configuration_helper) stay.  Dates may lack leading zeros or name their month in English.  Numbers of phones need a
country code or the separators of a local form: ten plain digits (0812345678) are as often an order's number and stay.

Values are written in ASCII digits: those of other scripts are no values, are left as they
are and aren't reported.  There is no shuffle; memory is bounded by one Arrow batch, and long
texts are read whole.  Nulls: a null text
stays null, with no values found.  Empty texts stay empty.  Repeated rows: one
result each.  Values that touch or overlap: the leftmost, then the kind named first
in ``KINDS``, then the longest; a candidate that fails its check takes nothing from the values
in it, and none may end within another value, nor a card hold whole dates or social
security numbers.  Empty tables: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "token", "iban", "card", "phone", "ip", "ssn", "date")

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_NAME = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + ")"
#: A date with its month's name, whole or of three letters: before or after the day.
NAMED = rf"{_NAME} [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} {_NAME} [0-9]{{4}}"

#: Shapes of the values looked for, in the order of KINDS: what may not stand before, the value, what may not follow.
SHAPES = {
    "email": (r"(?<![\w.+-])", r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", ""),
    "token": (r"(?<![\w])", r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16,}|ghp_[A-Za-z0-9]{16,}|xoxb-[-A-Za-z0-9]{16,}|(?:sk|pk)[-_](?:[a-z]{2,8}[-_]){0,2}[A-Za-z0-9]{16,}[-_A-Za-z0-9]*)", r"(?![\w])"),
    "iban": (r"(?<![\w])", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"(?![\w])"),
    "card": (r"(?<![\w.+-])", r"[0-9](?:[ -]?[0-9]){12,18}", r"(?![\w]|[.-][0-9])"),
    "phone": (r"(?<![\w])", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}", r"(?![\w])"),
    "ip": (r"(?<![\w.])", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"(?![\w]|\.[0-9])"),
    "ssn": (r"(?<![\w-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![\w]|-[0-9])"),
    "date": (r"(?<![\w./-])", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|" + NAMED, r"(?![\w]|[./-][0-9])"),
}
PATTERN = re.compile("|".join(f"{before}(?P<{kind}>{value}){after}" for kind, (before, value, after) in SHAPES.items()))
ALONE = {kind: re.compile(f"{before}(?:{value}){after}") for kind, (before, value, after) in SHAPES.items()}
#: Kinds of which a part may be a value too: the value by itself, and what may follow.
PARTS = {kind: (re.compile(f"{SHAPES[kind][0]}(?:{SHAPES[kind][1]})"), re.compile(SHAPES[kind][2])) for kind in ("iban", "card", "phone")}
#: A text without any of these holds no value.
SIGNS = re.compile(r"[@0-9]|sk|pk|ghp|xoxb|AKIA")
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 10


class Feistel:
    """Keyed permutations of numbers below a bound, by an alternating Feistel network of ``ROUNDS`` rounds."""

    def __init__(self, key: bytes):
        self.key = key
        self.permute = lru_cache(maxsize=1 << 16)(self._permute)

    def _round(self, tweak: str, k: int, half: int, modulus: int) -> int:
        digest = blake2b(f"{tweak}|{k}|{half}".encode(), key=self.key, digest_size=(modulus.bit_length() + 7) // 8 + 16).digest()
        return int.from_bytes(digest, "big") % modulus

    def _permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """The place of ``x`` in the permutation of 0 .. size - 1; walks on while it falls outside."""
        left = isqrt(size - 1) + 1
        right = -(-size // left)
        tweak = f"{tweak}|{size}"
        while True:
            a, b = divmod(x, right)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if k % 2:
                    b = (b + sign * self._round(tweak, k, a, right)) % right
                else:
                    a = (a + sign * self._round(tweak, k, b, left)) % left
            x = a * right + b
            if x < size:
                return x

    def text(self, value: str, tweak: str, back: bool = False) -> str:
        """``value`` with its digits and ASCII letters permuted among all texts of the same shape."""
        sizes = [next((len(s) for s in (DIGITS, LOWER, UPPER) if c in s), 1) for c in value]
        x, size = 0, 1
        for c, n in zip(value, sizes, strict=True):
            if n > 1:
                x, size = x * n + next(s.index(c) for s in (DIGITS, LOWER, UPPER) if c in s), size * n
        if size == 1:
            return value
        shape = "".join("d" if n == 10 and c in DIGITS else "l" if c in LOWER else "u" if c in UPPER else c for c, n in zip(value, sizes, strict=True))
        x = self.permute(x, size, f"{tweak}|{shape}", back)
        out = []
        for c, n in zip(reversed(value), reversed(sizes), strict=True):
            if n > 1:
                x, r = divmod(x, n)
                c = next(s for s in (DIGITS, LOWER, UPPER) if c in s)[r]
            out.append(c)
        return "".join(reversed(out))


def check_digit(digits: str) -> str:
    """The digit that makes ``digits`` and it pass the mod-10 test with doubled places."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in shape)


def _card(value: str, f: Feistel, back: bool) -> str | None:
    digits = re.sub("[^0-9]", "", value)
    if check_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = f.text(digits[:-1], "card", back)
    return _refill(value, body + check_digit(body))


#: Country calling codes of one and of two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


def country_code(value: str) -> str:
    """The plus and calling code that a number begins with, '' where it has none; a mark behind the code ends it."""
    if not value.startswith("+"):
        return ""
    marked = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
    return marked.group() if marked else value[: 1 + (1 if value[1] in ONE_DIGIT else 2 if value[1:3] in TWO_DIGITS else 3)]


def _phone(value: str, f: Feistel, back: bool) -> str | None:
    head = country_code(value)
    rest = value[len(head) :]
    digits = re.sub("[^0-9]", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    return head + _refill(rest, f.text(digits, "phone", back))


def _ip(value: str, f: Feistel, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def iban_remainder(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _iban(value: str, f: Feistel, back: bool) -> str | None:
    plain = value.replace(" ", "")
    if iban_remainder(plain) != 1:
        return None
    body = f.text(plain[4:], "iban" + plain[:2], back)
    new = f"{plain[:2]}{98 - iban_remainder(plain[:2] + '00' + body):02d}{body}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in value)


def _ssn(value: str, f: Feistel, back: bool) -> str | None:
    area, group, serial = value.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    x = f.permute(x, len(areas) * 99 * 9999, "ssn", back)
    x, serial_new = divmod(x, 9999)
    area_new, group_new = divmod(x, 99)
    return f"{areas[area_new]:03d}-{group_new + 1:02d}-{serial_new + 1:04d}"


def _moved(day: date, f: Feistel, back: bool, allowed: Callable[[date], bool]) -> date:
    """The day's place in the permutation of all days; walks on while the form can't show it."""
    x, size = (day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1
    while True:
        x = f.permute(x, size, "date", back)
        new = FIRST_DAY + timedelta(days=x)
        if allowed(new):
            return new


def _named_date(value: str, f: Feistel, back: bool) -> str | None:
    """A date with its month's name; whole names stay whole, names of three letters (May too) stay that."""
    name = re.search("[A-Za-z]+", value).group()
    d, y = map(int, re.findall("[0-9]+", value))
    month = next(k for k, m in enumerate(MONTHS, 1) if m[:3] == name[:3])
    try:
        day = date(y, month, d)
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    short = len(name) == 3
    new = _moved(day, f, back, lambda d: short or len(MONTHS[d.month - 1]) > 3)
    shown = MONTHS[new.month - 1][:3] if short else MONTHS[new.month - 1]
    number = f"{new.day:02d}" if re.search(r"\b0[0-9]\b", value) else str(new.day)
    return f"{shown} {number}, {new.year:04d}" if value.startswith(name) else f"{number} {shown} {new.year:04d}"


def _date(value: str, f: Feistel, back: bool) -> str | None:
    if re.search("[A-Za-z]", value):
        return _named_date(value, f, back)
    parts = re.split(r"[-/.]", value)
    year_first = len(parts[0]) == 4
    y, m, d = map(int, parts if year_first else reversed(parts))
    month_first = not year_first and m > 12 >= d and "/" in value
    if month_first:
        m, d = d, m
    try:
        day = date(y, m, d)
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    # A date that is read month first must not be one that is read day first.
    new = _moved(day, f, back, lambda d: not month_first or d.day > 12)
    mark = re.search(r"[-/.]", value).group()
    wide = all(len(p) >= 2 for p in parts)
    pad = (lambda v: f"{v:02d}") if wide else str
    if year_first:
        return mark.join((f"{new.year:04d}", pad(new.month), pad(new.day)))
    first, second = (new.month, new.day) if month_first else (new.day, new.month)
    return mark.join((pad(first), pad(second), f"{new.year:04d}"))


def _email(value: str, f: Feistel, back: bool) -> str | None:
    local, _, host = value.partition("@")
    return f"{f.text(local, 'email', back)}@{host}" if re.search("[A-Za-z0-9]", local) else None


def _token(value: str, f: Feistel, back: bool) -> str | None:
    hexes = re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)
    if not hexes:
        head = re.match("(?:sk|pk|ghp|xoxb|AKIA)[-_]?", value).group()
        return head + f.text(value[len(head) :], "token", back)
    if not re.search("[0-9]", value) or not re.search("[A-Fa-f]", value):
        return None
    x = f.permute(int(value, 16), 16 ** len(value), "hex", back)
    new = f"{x:0{len(value)}x}"
    return new.upper() if value.isupper() else new


MAKERS: dict[str, Callable[[str, Feistel, bool], str | None]] = {
    "email": _email, "token": _token, "iban": _iban, "card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date,
}


def _splits(text: str, kind: str, start: int, end: int, feistel: Feistel) -> bool:
    """Whether text[start:end] ends within a value that begins in it, or is a card made of other values and the blanks between."""
    for at in range(start, end):
        for inner in ("email", "ip", "ssn", "date"):
            m = ALONE[inner].match(text, at)
            if not m or MAKERS[inner](m.group(), feistel, False) is None:
                continue
            if at > start and m.end() > end:
                return True
            if kind == "card" and m.end() <= end and (at == start or text[at - 1] == " ") and (m.end() == end or text[m.end()] == " "):
                return True
    return False


def _value_at(text: str, start: int, feistel: Feistel, back: bool) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the value that begins at ``start``: the first kind that validates, its longest span first."""
    for kind, alone in ALONE.items():
        m = alone.match(text, start)
        if not m:
            continue
        ends = [m.end()]
        if kind in PARTS:
            value, after = PARTS[kind]
            ends += [e for e in range(m.end() - 1, start, -1) if after.match(text, e) and value.fullmatch(text, start, e)]
        for end in ends:
            new = MAKERS[kind](text[start:end], feistel, back)
            if new is not None and not (kind in PARTS and _splits(text, kind, start, end, feistel)):
                return kind, end, new
    return None


def replace(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of each value in code points of the input."""
    if not SIGNS.search(text):
        return text, []
    out, spans, at, look = [], [], 0, 0
    while m := PATTERN.search(text, look):
        start = m.start()
        found = _value_at(text, start, feistel, back)
        if found is None:
            look = start + 1
            continue
        kind, end, new = found
        out += [text[at:start], new]
        spans.append((kind, start, end, new))
        at = look = end
    return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text`` with pseudonyms, ``n_found`` and ``found`` (kind, start, end, pseudonym).

    ``key``: 1 to 64 secret bytes; whoever has it can undo the permutation.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("a key of 1 to 64 bytes is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
        for batch in batches:
            texts, found = [], []
            for t in batch.column(1):
                text = t.as_py()
                new, spans = (None, []) if text is None else replace(text, feistel)
                texts.append(new)
                found.append([dict(zip(("kind", "start", "end", "pseudonym"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(f) for f in found], pa.int32()), pa.array(found, kind)], ["doc_id", "text", "n_found", "found"]
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, text string, n_found int, found array<struct<kind:string,start:int,end:int,pseudonym:string>>")
