"""PII: format-preserving pseudonyms.

Values are found by pattern and validated; the digits (or letters) that
identify are permuted by a keyed Feistel network within the value's own format.
The permutation depends on the key, the kind and the format only, so equal
values get equal pseudonyms in all documents, different values different ones,
and each pseudonym passes the validation of its kind:

card    13 to 19 digits with a right Luhn digit: all but the first and the
        last digit are permuted, the Luhn digit is set anew
iban    country, right check digits: the account part is permuted (digits stay
        digits, letters letters), check digits set anew
ssn     3-2-4 digits in the valid areas: permuted within the valid numbers
phone   + and 8 to 15 digits, or grouped national forms: the digits after the
        country code are permuted
ip      dotted quads of octets: the 32 bits are permuted; IPv6 addresses: 128 bits
date    real calendar dates of 1900 to 2099 (year first, or day and month
        first): the day number is permuted, in the same way for all notations;
        days after the 12th stay such days, as only they can be read month first
email   letters and digits of the local part are permuted in place
secret  AWS-style ids, hexadecimal tokens of 32 characters or more, and values
        with a digit after password, token, secret or api key and a = or colon
        (after password also 8 characters without a digit): each character
        within its class

Digits are permuted as one number: cycle walking keeps a Feistel network over
a power of two inside the exact range, so the map is a bijection.  The key is
a required parameter.

Defined results: null text stays null with no values; empty text stays empty;
repeated rows, null ids and extra columns pass through.  An input column whose
name equals an output column (n_values, kinds) is replaced.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlark.llm.batches import bounded

ROUNDS = 8
BLOCK = 128


def feistel(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            seed = tweak + bytes([r]) + right.to_bytes(half // 8 + 1, "big")
            f = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=min(64, half // 8 + 1)).digest(), "big")
            left, right = right, left ^ (f & mask)
        value = (left << half) | right
        if value < size:
            return value


def unfeistel(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """The inverse of :func:`feistel`."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)):
            seed = tweak + bytes([r]) + left.to_bytes(half // 8 + 1, "big")
            f = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=min(64, half // 8 + 1)).digest(), "big")
            left, right = right ^ (f & mask), left
        value = (left << half) | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The digit that makes ``digits`` plus it valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def fill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def only_digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def by_class(text: str, permute: Callable[[int, int, bytes], int], tweak: bytes, hexa: bool = False) -> str:
    """Digits, small and capital ASCII letters permuted as one mixed-radix number; with ``hexa``, hexadecimal text stays so."""
    hexa = hexa and all(c in "0123456789abcdef" for c in text.lower()) and any(c.isdigit() for c in text)
    classes = []
    for c in text:
        if hexa and c in "0123456789abcdefABCDEF":
            classes.append("0123456789ABCDEF" if text.isupper() else "0123456789abcdef")
        else:
            classes.append(next((s for s in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in s), ""))
    # Long values in blocks of a size that the network mixes whole.
    parts = range(0, len(text), BLOCK)
    return "".join(block(text[i : i + BLOCK], classes[i : i + BLOCK], permute, tweak + (b"@%d/" % i if i else b"")) for i in parts)


def block(text: str, classes: list[str], permute: Callable[[int, int, bytes], int], tweak: bytes) -> str:
    value, size = 0, 1
    for c, s in zip(text, classes, strict=True):
        if s:
            value, size = value * len(s) + s.index(c if c in s else c.swapcase()), size * len(s)
    form = "".join(str(len(s) % 10) if s else c for c, s in zip(text, classes, strict=True))
    value = permute(value, size, tweak + form.encode())
    out = []
    for c, s in zip(reversed(text), reversed(classes), strict=True):
        if s:
            value, k = divmod(value, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def card(s: str, permute) -> str | None:
    d = only_digits(s)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = d[1:-1]
    new = d[0] + str(permute(int(body), 10 ** len(body), b"card%d" % len(d))).zfill(len(body))
    return fill(s, new + str(luhn(new)))


def iban(s: str, permute) -> str | None:
    flat = s.replace(" ", "").upper()
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = by_class(flat[4:], permute, b"iban" + flat[:2].encode())
    new = flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in s)


def ssn(s: str, permute) -> str | None:
    d = only_digits(s)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    index = permute(index, 898 * 99 * 9999, b"ssn")
    area = index // (99 * 9999) + 1
    area += area >= 666
    return fill(s, f"{area:03d}{index // 9999 % 99 + 1:02d}{index % 9999 + 1:04d}")


def phone(s: str, permute) -> str | None:
    d = only_digits(s)
    if not 8 <= len(d) <= 15:
        return None
    lead = 0
    if s.startswith("+"):
        first = re.match(r"\+(\d{1,3})(?=[ ().-])", s)
        lead = len(first[1]) if first else min(2, len(d) - 7)
    body = d[lead:]
    return fill(s, d[:lead] + str(permute(int(body), 10 ** len(body), b"phone" + d[:lead].encode() + b"/%d" % len(body))).zfill(len(body)))


def address(s: str, permute) -> str | None:
    octets = [int(x) for x in s.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(str(b) for b in permute(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip").to_bytes(4, "big"))


FIRST_DAY, DAYS = date(1900, 1, 1), (date(2099, 12, 31) - date(1900, 1, 1)).days + 1


def calendar(s: str, permute) -> str | None:
    parts = re.split(r"\D", s)
    sep = s[len(parts[0])]
    try:
        if len(parts[0]) == 4:
            order, day = "ymd", date(int(parts[0]), int(parts[1]), int(parts[2]))
        else:
            order, day = "dmy", None
            a, b, y = (int(p) for p in parts)
            try:
                day = date(y, b, a)
            except ValueError:
                order, day = "mdy", date(y, a, b)
    except ValueError:
        return None
    index, late = (day - FIRST_DAY).days, day.day > 12
    if not 0 <= index < DAYS:
        return None
    # Walking on until the day is late again (or not) permutes each of the two sets.
    while True:
        index = permute(index, DAYS, b"date")
        new = FIRST_DAY + timedelta(days=index)
        if (new.day > 12) == late:
            break
    short = min(map(len, parts)) == 1
    values = {"y": f"{new.year:04d}", "m": str(new.month) if short else f"{new.month:02d}", "d": str(new.day) if short else f"{new.day:02d}"}
    return sep.join(values[c] for c in order)


def address6(s: str, permute) -> str | None:
    try:
        number = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    if not any(c.isdigit() for c in s):  # names in program text
        return None
    return str(ipaddress.IPv6Address(permute(number, 1 << 128, b"ip6")))


def email(s: str, permute) -> str:
    local, _, host = s.partition("@")
    return f"{by_class(local, permute, b'email')}@{host}"


def secret(s: str, permute) -> str | None:
    if s.startswith(("AKIA", "ASIA")):
        return s[:4] + by_class(s[4:], permute, b"aws")
    return by_class(s, permute, b"secret", hexa=True) if any(c.isdigit() for c in s) else None


VALUE = re.compile(r"[=:]\s*[\"']?(?=[^\s\"'=:])")


def assigned(s: str, permute) -> str | None:
    """The value after a credential's name; names and punctuation stay."""
    at = VALUE.search(s).end()
    new = secret(s[at:], permute)
    if new is None and s[:2].lower() == "pa" and len(s) - at >= 8:
        new = by_class(s[at:], permute, b"secret")
    return None if new is None else s[:at] + new


KINDS: dict[str, Callable] = {"assigned": assigned, "email": email, "secret": secret, "iban": iban, "ip": address, "ip6": address6, "date": calendar, "ssn": ssn, "card": card, "phone": phone}
#: At a place the first kind that matches and is valid wins.
FORMS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}\b",
    "assigned": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/.~-]{6,}",
    "secret": r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4}){0,6}(?![\w:])",
    "date": r"(?<![\w./-])(?:\d{4}(?P<s>[-/.])\d{2}(?P=s)\d{2}|\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)\d{4})(?!(?![Tt]\d)\w|[-/.]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)",
    "phone": r"(?<![\w.])(?:\+\d(?:[ ().-]{0,2}\d){7,14}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]|[.-]\d)",
}
ALONE = {kind: re.compile(form, re.ASCII) for kind, form in FORMS.items()}
PATTERN = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in FORMS.items()), re.ASCII)
#: Kinds written in groups, which a match may join with what follows.
GROUPED, BORDER = ("card", "iban"), re.compile("[ -]")
ORDER = list(FORMS)
#: A place where a value may begin: only there is the pattern tried.
HINT = re.compile(r"[0-9@]|::|A[KS]IA|[0-9a-fA-F]{32}|(?i:passw|passphrase)")


def pseudonymise(text: str, permute: Callable[[int, int, bytes], int]) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds of the values found, in order."""
    if not HINT.search(text):
        return text, []
    kinds: list[str] = []
    out: list[str] = []
    done = at = 0
    while m := PATTERN.search(text, at):
        got = replaced(text, m, permute)
        if got is None:
            # Another value may begin inside.
            at = m.start() + 1
            continue
        kind, end, new = got
        kinds.append({"assigned": "secret", "ip6": "ip"}.get(kind, kind))
        out += [text[done : m.start()], new]
        done = at = end
    return "".join(out) + text[done:], kinds


def replaced(text: str, m: re.Match, permute: Callable[[int, int, bytes], int]) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the first valid value at the match's place: whole, cut at a group's border, or of a later kind."""
    for kind in ORDER[ORDER.index(m.lastgroup) :]:
        found = m[0] if kind == m.lastgroup else (other := ALONE[kind].match(text, m.start())) and other[0]
        if not found:
            continue
        cuts = [c.start() for c in BORDER.finditer(found)] if kind in GROUPED else []
        for size in [len(found), *reversed(cuts)]:
            new = KINDS[kind](found[:size], permute)
            if new is not None:
                return kind, m.start() + size, new
    return None


def permuter(key: bytes) -> Callable[[int, int, bytes], int]:
    """A permutation function with a bounded memory of recent values."""
    return lru_cache(100_000)(lambda value, size, tweak: feistel(value, size, key, tweak))


ADDED = T.StructType().add("n_values", "integer").add("kinds", "string")


def pseudonyms(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its text, the number of values, and the kinds as ``kind:count`` pairs.

    Each row on its own: no shuffle, no state but the key.
    """
    carry = [c for c in docs.columns if c not in ADDED.names]
    schema = T.StructType([docs.schema[c] for c in carry] + list(ADDED))

    def run(batches: Iterator[pa.RecordBatch]):
        permute = permuter(key)
        for batch in batches:
            new, number, kinds = [], [], []
            for t in batch.column(text):
                t = t.as_py()
                out, found = pseudonymise(t, permute) if t else (t, [])
                new.append(out)
                number.append(len(found))
                kinds.append(",".join(f"{k}:{found.count(k)}" for k in sorted(set(found))))
            added = [pa.array(number, pa.int32()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(c) for c in carry] + added, names=schema.names)

    return bounded(docs).select(*carry).mapInArrow(run, schema)
