"""Format-preserving pseudonyms: validated values are permuted inside their own format by a keyed Feistel network.

Equal values get equal pseudonyms everywhere, without a table, so documents stay linked; with the key the value comes back.
Only values that pass their format's check are replaced: card numbers and other digit strings by check digits, calendar
dates, IPv4 addresses, phone numbers, e-mail addresses, and hexadecimal secrets.
"""

from __future__ import annotations

import datetime
import hmac
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from parley.llm import textkit as T

ROUNDS = 8
_EPOCH, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network on the next even number of bits, walked until inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def f(i: int, x: int) -> int:
        out = hmac.digest(key, f"{tweak}|{size}|{i}|{x}".encode(), "sha256")
        return int.from_bytes(out, "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ f(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ f(i, right)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """Luhn check digit of the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country) + "00") % 97


def _radix(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Permute the letters and digits of a text, each within its own class; everything else stays in place."""
    classes = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text if c.isascii() and c.isalnum()]
    letters = [c for c in text if c.isascii() and c.isalnum()]
    size, value = 1, 0
    for c, kind in zip(letters, classes):
        size, value = size * len(kind), value * len(kind) + kind.index(c)
    value = permute(value, size, key, tweak + "|" + "".join(k[0] for k in classes), back)
    out = []
    for kind in reversed(classes):
        value, r = divmod(value, len(kind))
        out.append(kind[r])
    fill = iter(reversed(out))
    return "".join(next(fill) if c.isascii() and c.isalnum() else c for c in text)


def _spread(form: str, digits: str) -> str:
    fill = iter(digits)
    return "".join(next(fill) if c.isdigit() else c for c in form)


#: How card numbers are written: the sizes of their groups.
_CARD = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}", re.ASCII)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or not _CARD.fullmatch(text) or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, f"card{len(digits)}", back)).zfill(len(digits) - 1)
    return _spread(text, body + str(luhn(body)))


def _card_ends(text: str, start: int, ends: list[int]) -> list[int]:
    """Sixteen digits first, so that a group behind a card does not make it another one."""
    return sorted(ends, key=lambda e: (sum(c.isdigit() for c in text[start:e]) != 16, -e))


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = text.split("-")
    valid = lambda a, g, s: a not in (0, 666) and a < 900 and g and s
    if not valid(int(area), int(group), int(serial)):
        return None
    value = int(area + group + serial)
    while True:
        value = permute(value, 10**9, key, "ssn", back)
        out = str(value).zfill(9)
        if valid(int(out[:3]), int(out[3:5]), int(out[5:])):
            return _spread(text, out)


#: Lengths of account numbers by country, as registered.
_IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18,
    GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24,
    PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _IBAN_LENGTHS.get(country, len(plain)) != len(plain) or iban_check(country, account) != int(check):
        return None
    account = _radix(account, key, "iban" + country, back)
    fill = iter(country + str(iban_check(country, account)).zfill(2) + account)
    return "".join(" " if c == " " else next(fill) for c in text)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    try:
        value = int(ipaddress.IPv4Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(permute(value, 1 << 32, key, "ip", back)))


def _email(text: str, key: bytes, back: bool) -> str | None:
    """Addresses that differ in case only get pseudonyms that differ in case only."""
    head, _, top = text.rpartition(".")
    new = _radix(head.lower(), key, "mail", back)
    return f"{''.join(n.upper() if c.isupper() else n for n, c in zip(new, head))}.{top}"


#: Digits after the country code where all numbers of a country have as many.
_NATIONAL = {"1": 10, "7": 10, "30": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "82": 10, "86": 11, "90": 10, "91": 10, "351": 9, "353": 9, "420": 9}


def _phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 9 <= len(digits) <= 15:
        return None
    keep = 0
    if text.startswith("+"):
        code = next((digits[:k] for k in (1, 2, 3) if digits[:k] in _NATIONAL), None)
        if code and len(digits) != len(code) + _NATIONAL[code]:
            return None
        keep = len(code) if code else 3  # the country code stays
    body = str(permute(int(digits[keep:]), 10 ** (len(digits) - keep), key, f"phone{len(digits)}{digits[:keep]}", back)).zfill(len(digits) - keep)
    return _spread(text, digits[:keep] + body)


def _phone_ends(text: str, start: int, ends: list[int]) -> list[int]:
    """Those first behind which no date, time or fraction goes on, the longest of them first."""
    return sorted(ends, key=lambda e: (re.match(r"[/:]\d", text[e : e + 2]) is not None, -e))


def _date_class(at: int) -> tuple[bool, bool, bool]:
    day = datetime.date.fromordinal(at + _EPOCH)
    return day.month > 9, day.day > 9, day.day > 12


def _date(text: str, key: bytes, back: bool) -> str | None:
    """A date is permuted as a day, whatever the form it is written in, among the days that all forms write alike.

    These have as many digits in month and day; and days after the twelfth stay so, as only they can be read with the
    month first.
    """
    parts, marks = re.split(r"[-/.]", text), re.findall(r"[-/.]", text)
    first = len(parts[0]) == 4  # the year comes first
    year, month, day = (int(parts[i]) for i in ((0, 1, 2) if first else (2, 1, 0)))
    swapped = not first and month > 12 >= day
    if swapped:
        month, day = day, month
    try:
        at = datetime.date(year, month, day).toordinal() - _EPOCH
    except ValueError:
        return None
    if not 0 <= at < _DAYS:
        return None
    kind = _date_class(at)
    while True:
        at = permute(at, _DAYS, key, "date", back)
        if _date_class(at) == kind:
            break
    new = datetime.date.fromordinal(at + _EPOCH)
    fields = [new.year, new.month, new.day] if first else [new.month, new.day, new.year] if swapped else [new.day, new.month, new.year]
    out = [str(f).zfill(len(p)) for f, p in zip(fields, parts)]
    return out[0] + marks[0] + out[1] + marks[1] + out[2]


def _secret(text: str, key: bytes, back: bool) -> str | None:
    size, upper = len(text), text.isupper()
    if text.isdigit() or text.isalpha() or not (upper or text == text.lower()):
        return None
    value = int(text, 16)
    while True:
        value = permute(value, 16**size, key, f"hex{size}", back)
        out = f"{value:0{size}x}"
        if not out.isdigit() and not out.isalpha():  # stay in the form that is read as a secret
            return out.upper() if upper else out


#: Not read: dates with names of months or two digits for the year, phone numbers in groups without a country code,
#: brackets, dots or hyphens, account numbers in lower case, social security numbers in groups parted by spaces, IPv6, and
#: mail domains beyond ASCII. Numbers of countries whose phone numbers differ in length take the groups that follow them.
#: Kinds in the order they are tried; a text position belongs to the first that matches and validates. All lengths are
#: bounded (those of e-mail addresses by their standard), so that a text without white space is read in linear time.
KINDS = {
    "email": (r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,63}", _email),
    "secret": (r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])", _secret),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", _iban),
    "date": (r"(?<![\d.])(?:(?:19|20)\d\d([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2(?:19|20)\d\d)(?![\d])", _date),
    "ip": (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", _ip),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "phone": (r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}(?!\d)|(?<!\d)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])", _phone),
    "card": (r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])", _card),
}
_ALL = re.compile("|".join(f"(?P<{k}>{re.sub(chr(92) + chr(92) + '([12])', lambda m: '(?P=' + k + m[1] + ')', re.sub(r'\(\[-/\.\]\)', lambda m, n=iter('12'): f'(?P<{k}{next(n)}>[-/.])', p))})" for k, (p, _) in KINDS.items()), re.ASCII)


_EACH = {k: re.compile(p, re.ASCII) for k, (p, _) in KINDS.items()}
#: Kinds of several groups: a match may have swallowed groups that are not part of the value.
GROUPED = {"iban", "phone", "card"}
#: The order in which the ends of a match are tried; by default the longest first.
_ENDS = {"card": _card_ends, "phone": _phone_ends}


def _read(text: str, key: bytes) -> Iterator[tuple[int, int, str, str]]:
    """The values of a text: start, end, kind, permuted value.

    At each place the kinds are tried in order, each at the ends of its groups; if none validates, the search goes on one
    character later. Which end is tried first depends on the form of a value, so a group beside it does not change it.
    """
    at = 0
    while match := _ALL.search(text, at):
        start, at = match.start(), match.start() + 1
        for kind, form in _EACH.items():
            if whole := form.match(text, start):
                ends = [whole.end()]
                if kind in GROUPED:
                    ends += [i for i in range(whole.end() - 1, start, -1) if text[i] in " .-" and form.fullmatch(text, start, i)]
                    ends = _ENDS[kind](text, start, ends) if kind in _ENDS else ends
                hit = next(((start, end, kind, new) for end in ends if (new := KINDS[kind][1](text[start:end], key, False)) is not None), None)
                if hit:
                    yield hit
                    at = hit[1]
                    break


Span = tuple[int, int, str]


def pseudonymise(text: str, key: bytes) -> tuple[str, list[Span]]:
    """The text with every validated value permuted, and where the pseudonyms are in it: start, end, kind.

    A pseudonym depends on its value and the key alone, so equal values stay equal wherever they stand.
    """
    out: list[str] = []
    spans: list[Span] = []
    done = size = 0
    for start, end, kind, new in _read(text, key):
        size += start - done
        spans.append((size, size + len(new), kind))
        out += [text[done:start], new]
        size, done = size + len(new), end
    return "".join(out) + text[done:], spans


def restore(text: str, spans: list[Span], key: bytes) -> str:
    """The text that pseudonymise made this one of, with the places it gave."""
    out, done = [], 0
    for start, end, kind in spans:
        out += [text[done:start], KINDS[kind][1](text[start:end], key, True)]
        done = end
    return "".join(out) + text[done:]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def _task(key: bytes):
    def run(batches):
        for batch in batches:
            column = batch.column("text")
            changed: dict[int, str] = {}
            found: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            for first, last, data, offsets in T.texts(column):
                # every kind has a digit or an at sign; most texts have neither and are passed on as they are
                marks = np.concatenate([[0], np.cumsum(((data >= 0x30) & (data <= 0x39)) | (data == 0x40))])
                for i in np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]]):
                    new, spans = pseudonymise(data[offsets[i] : offsets[i + 1]].tobytes().decode(), key)
                    if spans:
                        changed[first + int(i)], found[first + int(i)] = new, spans
            if changed:
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[list(changed)] = True
                column = pa.compute.replace_with_mask(column, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], column.type))
            places = pa.array([[dict(zip(("start", "end", "kind"), s)) for s in spans] for spans in found], SPANS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), column, pa.array([len(k) for k in found], pa.int64()), pa.array([",".join(sorted({s[2] for s in k})) for k in found]), places], names=["doc_id", "text", "n_found", "kinds", "spans"]
            )

    return run


def pseudonymise_texts(spark: SparkSession, docs: DataFrame, key: bytes) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text with pseudonyms, n_found, kinds (sorted, comma-joined), spans.

    `spans` are the places of the pseudonyms (start, end, kind), in code points, from which `restore_texts` brings the
    values back. Null texts stay null with n_found 0; texts without a validated value come back unchanged. Repeated rows
    and null doc_ids give a row each; further columns are ignored. Nothing is shuffled. Values do not overlap: the one that
    starts first counts, of those that start together the first kind, and the search goes on behind it. The key is a secret
    of the caller; with it the pseudonyms can be undone.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_task(key), "doc_id long, text string, n_found long, kinds string, spans array<struct<start:int,end:int,kind:string>>")


def restore_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text) as it was before pseudonymise_texts gave `docs` (doc_id, text, spans); null texts stay null."""

    def run(batches):
        for batch in batches:
            texts = [None if t is None else restore(t, [(s["start"], s["end"], s["kind"]) for s in spans or []], key) for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")
