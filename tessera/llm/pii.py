"""PII pseudonyms: validated numbers, dates and addresses are keyed-permuted within their own format.

Every kind of value has a rank function onto ``0 .. N-1`` and back.  A keyed additive Feistel network
(``ROUNDS`` rounds of BLAKE2b, cycle walking down to N) permutes the ranks, so each pseudonym is again a
valid value of its kind, equal values get equal pseudonyms in all documents, and the key's owner can
invert them.  Separators, brackets and lengths stay as they were.

Kinds and what validates them: ``card`` (13 to 19 digits, Luhn), ``iban`` (mod 97), ``ssn`` (assigned
ranges), ``date`` (a day of the calendar, 1900 to 2099; NN/NN/NNNN is day-first, or month-first where only that is
a date), ``ip`` (four octets), ``phone`` (international, bracketed and ten-digit forms) and ``email`` (letters
and digits of local part and host name are permuted in their class, those beyond ASCII within the letters of
their block of 256 signs; the top-level domain stays).  What fails its validation is left alone.

Values are compared in a canonical form: numbers by their digits alone (ten digits are those after +1), addresses without
regard to ASCII case (the pseudonym takes over the case of each place), dates in any notation.  A date after the 12th of a month
stays one, so that month-first notations can be told by their pseudonyms.

The key is the caller's (``key`` or the setting ``spark.tessera.pii.key``); there is no default.

Null texts stay null; empty texts, repeated rows and very long texts need nothing special; every column of
the input is kept as it is, whatever its name, and only the text changes.  An empty table stays empty.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import chunks, settle

ROUNDS = 8
#: The session setting that holds the key.
KEY_SETTING = "spark.tessera.pii.key"

# The patterns of the kinds.
PATTERN = re.compile(
    r"(?P<email>(?<![^\s@<>()\[\],;:\"|=])[^\s@<>()\[\],;:\"|=]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9@]))"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))"
    r"|(?P<date>(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9][0-9]:)|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-])))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\7[0-9]{4}\7[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\8[0-9]{5})(?![\w-]))"
    r"|(?P<phone>(?<!\w)(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\10[0-9]{4})(?!\w))"
)
_HINT = re.compile(r"@|\d[\d ().:/-]{5}")
_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of ``0 .. size-1`` for any size; ``label`` keeps kinds apart."""

    def __init__(self, key: bytes, label: str, size: int) -> None:
        self.size = size
        self.left = math.isqrt(size - 1) + 1 if size > 1 else 1
        self.right = -(-size // self.left)
        self.key = hashlib.blake2b(label.encode() + b"/%d" % size, key=key[:64]).digest()

    def _round(self, k: int, half: int) -> int:
        data = b"%d/%d" % (k, half)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _pass(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        sign = -1 if back else 1
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if k % 2:
                b = (b + sign * self._round(k, a)) % self.right
            else:
                a = (a + sign * self._round(k, b)) % self.left
        return a * self.right + b

    def __call__(self, x: int, back: bool = False) -> int:
        x = self._pass(x, back)
        while x >= self.size:
            x = self._pass(x, back)
        return x


def luhn(digits: str) -> int:
    """The Luhn sum mod 10 of a number with its check digit."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(shape: str, signs: str) -> str:
    """Put letters and digits into the places that letters and digits have in ``shape``."""
    rest = iter(signs)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


@lru_cache(maxsize=4096)
def _alphabet(sign: str) -> tuple[str, str]:
    """The name and the signs of a letter's or digit's class."""
    if sign.isascii():
        return ("d", string.digits) if sign.isdigit() else ("l", string.ascii_lowercase)
    block, kind = ord(sign) & ~255, (sign.isalpha(), sign.isupper())
    signs = (chr(k) for k in range(max(block, 128), block + 256))
    return f"{block:x}{kind[0]:d}{kind[1]:d}", "".join(c for c in signs if c.isalnum() and (c.isalpha(), c.isupper()) == kind)


class Pseudonyms:
    """Pseudonyms under one key."""

    def __init__(self, key: bytes) -> None:
        self.key, self.ciphers = key, {}

    def _permute(self, label: str, size: int, rank: int, back: bool) -> int:
        cipher = self.ciphers.get((label, size))
        if cipher is None:
            if len(self.ciphers) > 10_000:
                self.ciphers.clear()
            cipher = self.ciphers[label, size] = Feistel(self.key, label, size)
        return cipher(rank, back)

    def _signs(self, label: str, signs: str, back: bool) -> str:
        """Letters and digits, each within its class; ASCII letters without regard to case, which stays where it is."""
        classes, rank = [_alphabet(c) for c in signs], 0
        for c, (_, alphabet) in zip(signs, classes, strict=True):
            rank = rank * len(alphabet) + alphabet.index(c.lower() if c.isascii() else c)
        size = math.prod(len(alphabet) for _, alphabet in classes)
        rank, out = self._permute(f"{label}/{','.join(name for name, _ in classes)}", size, rank, back), []
        for c, (_, alphabet) in zip(reversed(signs), reversed(classes), strict=True):
            rank, place = divmod(rank, len(alphabet))
            out.append(alphabet[place].upper() if c.isascii() and c.isupper() else alphabet[place])
        return "".join(reversed(out))

    def card(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn(digits) or len(set(digits)) == 1:
            return None
        body = self._signs("card", digits[:-1], back)
        return _refill(value, body + str((10 - luhn(body + "0")) % 10))

    def iban(self, value: str, back: bool) -> str | None:
        signs = value.replace(" ", "")
        if not 15 <= len(signs) <= 34 or mod97(signs) != 1:
            return None
        body = self._signs("iban/" + signs[:2], signs[4:], back)
        return _refill(value, signs[:2] + f"{98 - mod97(signs[:2] + '00' + body):02d}" + body)

    def ip(self, value: str, back: bool) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        rank = self._permute("ip", 1 << 32, int.from_bytes(bytes(octets), "big"), back)
        return ".".join(map(str, rank.to_bytes(4, "big")))

    def ssn(self, value: str, back: bool) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rank, serial = divmod(self._permute("ssn", 898 * 99 * 9999, rank, back), 9999)
        area, group = divmod(rank, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, value: str, back: bool) -> str | None:
        forms = ["{0:04d}-{1:02d}-{2:02d}"] if value[4] == "-" else [f"{{2:02d}}{value[2]}{{1:02d}}{value[2]}{{0:04d}}"]
        if value[2] == "/":
            forms.append("{1:02d}/{2:02d}/{0:04d}")
        parts = [int(x) for x in re.split(r"[-/.]", value)]
        for form, (year, month, day) in zip(forms, [parts if value[4] == "-" else parts[::-1], [parts[2], *parts[:2]]], strict=False):
            try:
                rank = datetime.date(year, month, day).toordinal() - _FIRST
            except ValueError:
                continue
            if not 0 <= rank < _DAYS:
                return None
            while True:
                rank = self._permute("date", _DAYS, rank, back)
                found = datetime.date.fromordinal(_FIRST + rank)
                if (found.day > 12) == (day > 12):
                    return form.format(found.year, found.month, found.day)
        return None

    def phone(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 8 <= len(digits) <= 15:
            return None
        # The first digit of an international number stays, which tells the world zone; ten digits are those of zone 1.
        lead = digits[:1] if value[0] == "+" else ""
        return _refill(value, lead + self._signs(f"phone/{lead or 1}", digits[len(lead) :], back))

    def email(self, value: str, back: bool) -> str | None:
        name, _, host = value.rpartition("@")
        labels, _, top = host.rpartition(".")
        signs = "".join(c for c in name if c.isalnum())
        rest = "".join(c for c in labels if c.isalnum())
        if not signs and not rest:
            return None
        return _refill(name, self._signs("mail", signs, back)) + "@" + _refill(labels, self._signs("host", rest, back)) + "." + top

    def rewrite(self, text: str, back: bool = False) -> tuple[str, int]:
        """The text with every validated value replaced, and how many there were."""
        if not _HINT.search(text):
            return text, 0
        count = 0

        def swap(match: re.Match[str]) -> str:
            nonlocal count
            put = getattr(self, match.lastgroup)(match[0], back)
            count += put is not None
            return match[0] if put is None else put

        return PATTERN.sub(swap, text), count


def pseudonymise(docs: DataFrame, column: str = "text", counts: str | None = None, key: str | None = None, back: bool = False) -> DataFrame:
    """All columns of ``docs`` with pseudonyms in ``column``; ``counts`` names a column for their number.

    ``back=True`` restores the original values under the same key.
    """
    spark = settle(docs.sparkSession)
    key = key or spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: an argument or the setting {KEY_SETTING}")
    secret = key.encode()
    numbers = [T.StructField(counts, T.LongType())] if counts else []
    place = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(secret)
        for batch in chunks(batches, column):
            pairs = [(None, 0) if t is None else names.rewrite(t, back) for t in batch.column(place).to_pylist()]
            columns = [*batch.columns]
            columns[place] = pa.array([p[0] for p in pairs], batch.schema.field(place).type)
            fields = [*batch.schema]
            if counts:
                columns.append(pa.array([p[1] for p in pairs], pa.int64()))
                fields.append(pa.field(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *numbers]))


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the rewritten text and the number of values replaced."""
    return pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), counts="n_replaced", key=key)
