"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near its hits, checksum validation.

Every whole text is scanned as UTF-8 bytes (null: empty).  One Aho-Corasick pass over the
ASCII-lower-cased bytes finds every keyword; each pattern is then tried only where one of its
keywords stands.  Long hexadecimal runs have no keyword and are found by one linear pattern.

Kinds of spans, offsets in code points, end exclusive:

* base: ``assign`` (a name like ``password`` given a value of 6 or more characters), ``access``
  (``AKIA`` and capitals or digits, 20 or more in all) and ``hex`` (24 or more lower-case digits);
* extra: ``github`` and ``npm`` (tokens whose last six characters are the base-62 CRC-32 of the
  characters before), ``jwt`` (three parts, the first a JSON object with ``alg``) and ``pem`` (a private
  key block whose body is valid base 64).  A match whose checksum fails is dropped.

Nulls and empty texts have no spans; repeated rows give equal results; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import arrow_schema, chunks, text_columns

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]

# The patterns of the base kinds and of the extra kinds.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
JWT_PART = re.compile(rb"[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int = 6) -> str:
    out = ""
    while number or len(out) < width:
        number, digit = divmod(number, 62)
        out = _DIGITS[digit] + out
    return out


def _crc_holds(match: re.Match[bytes]) -> bool:
    return base62(zlib.crc32(match[1])) == match[2].decode()


def _jwt_holds(match: re.Match[bytes]) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(match[1] + b"=" * (-len(match[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def _pem_holds(match: re.Match[bytes]) -> bool:
    try:
        return len(base64.b64decode(re.sub(rb"\s", b"", match[2]), validate=True)) >= 32
    except binascii.Error:
        return False


#: For each kind: the pattern tried at a keyword, and what must hold for a match to stay.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, _crc_holds),
    "npm": (NPM, _crc_holds),
    "jwt": (JWT, _jwt_holds),
    "pem": (PEM, _pem_holds),
}


def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (kind, len(word) - 1))
    machine.make_automaton()
    return machine


_MACHINE = _automaton()


def spans(text: bytes) -> list[tuple[int, int, str]]:
    """All validated spans of a text, in bytes, by start and then by kind as listed."""
    found: list[tuple[int, int, str]] = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    past = dict.fromkeys(KINDS, 0)
    for last, (kind, back) in _MACHINE.iter(text.lower().decode("latin-1")):
        start = last - back
        if start < past[kind]:
            continue
        pattern, holds = RULES[kind]
        match = pattern.match(text, start)
        if match and holds(match):
            past[kind] = match.end()
            found.append((start, match.end(), kind))
        elif kind == "jwt":
            # What follows the run of characters decides; a later start in the same run would fail as well.
            past[kind] = JWT_PART.match(text, start).end()
        elif match:
            past[kind] = match.end()
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def in_code_points(text: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not found or text.isascii():
        return found
    points = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    at = np.concatenate(([0], points))
    return [(int(at[a]), int(at[b]), kind) for a, b, kind in found]


_SCHEMA, _ARROW = arrow_schema(
    "doc_id long, spans spans, n_bytes long"
)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end), and the text's bytes; one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = []
            for text in texts:
                out.append([{"kind": k, "start": a, "end": b} for a, b, k in in_code_points(text, spans(text))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, _ARROW.field("spans").type), pa.array([len(t) for t in texts], pa.int64())],
                schema=_ARROW,
            )

    return text_columns(docs).mapInArrow(run, _SCHEMA)


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the list of all spans, by built-in functions."""
    from pyspark.sql import functions as F

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    def joined(values):
        return F.array_join(F.transform(values, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base columns by plain searches over the whole text; for tests."""
    data = (text or "").encode()
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(data) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(data) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(rb"[0-9a-f]+", data) if len(m[0]) >= 24]
    found = in_code_points(data, sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))))
    counts = [sum(k == kind for *_, k in found) for kind in BASE_KINDS]
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in found).encode()).hexdigest())
