"""Secret scan: stated patterns, and windows of high Shannon entropy.

The entropy scan looks at maximal runs of base64-like characters. A window of fixed width
slides over each; counts of its characters, and so its entropy and the class of its
characters, follow from running counts, which change by one character in and one out. Its
threshold is that of its own class, so what stands before or after a secret does not
count. Windows that overlap an allow-listed string (UUIDs, placeholders) are left out, and
no others.

Names, slugs, paths and dates have entropy too. So a run is cut into pieces at ``-``,
``_``, ``/``, ``+`` and ``=``, and a piece that reads like words or numbers (few groups of
digits, letters in long stretches of one case, letters as common as in text) is no part of
a secret: a window counts if most of it lies in other pieces. A finding is the whole
candidate: the parts of the run, between ``=``, ``/``, ``_`` and allow-listed strings, that
such a window touches and that hold such a piece. One that lies inside a stated pattern is
left out.

Null text is empty. Positions are code points. Every row gives a row; repeated rows
repeat. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gaitframe.llm.shared import byte_slices

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Windows that overlap one belong to a sample and not to a secret.
ALLOWED = ("example", "placeholder", "changeme", "your_", "dummy", "abcdefghijklmnop", "0123456789")
WIDTH = 20
#: Bits a character that a window must reach, by the class of its characters: about one in
#: a thousand windows of WIDTH random characters of the class (16, 36, 62, 26, 52 of them) has less.
BITS = {"hex": 2.70, "alnum": 3.22, "mixed": 3.48, "letters": 3.04, "cased": 3.40}
#: Characters of a window that lie in pieces which do not read like words.
MOST_WORDS = 12
# How common letters are in English text, in percent.
LETTERS = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074,
}
#: Bits for each letter that it is drawn at random and not from text (at most 3).
DRAWN = {k: min(3.0, math.log2(100 / 26 / v)) for k, v in LETTERS.items()}
#: How many bits make a piece random; none in excess from ``LONG`` letters on. Each consonant of a run after the fourth adds 1.5.
RANDOM, LONG = 3.5, 14

SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_PARTS = re.compile(r"[^=/_]+")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_STRETCH = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")
_NO_VOWELS = re.compile(r"[^AEIOUYaeiouy]+")
_RUN_BYTE = np.zeros(256, bool)
_RUN_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, len(_ALPHABET), np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i
_UPPER, _LOWER, _DIGIT = slice(0, 26), slice(26, 52), slice(52, 62)
_NO_HEX = np.array([not (c in "0123456789abcdefABCDEF") for c in _ALPHABET])
_CHUNK = 1 << 14


def windows(s: str, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, counts by character) of the windows of ``s``, some thousand at a time.

    A window's counts are those up to its end less those up to its start.
    """
    code = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
    for at in range(0, len(s) - width + 1, _CHUNK):
        part = code[at : at + _CHUNK + width - 1]
        upto = np.zeros((len(part) + 1, len(_ALPHABET)), np.int16 if len(part) < 1 << 15 else np.int32)
        upto[np.arange(1, len(part) + 1), part] = 1
        np.cumsum(upto, axis=0, out=upto)
        yield at, upto[width:] - upto[:-width]


def entropies(counts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Bits a character of windows by their counts."""
    step = np.array([0.0] + [c * math.log2(c) for c in range(1, width + 1)])
    return math.log2(width) - step[counts].sum(1) / width


def least_bits(counts: np.ndarray, bits: dict[str, float]) -> np.ndarray:
    """The threshold of each window's class; infinite where no secret is made of such characters."""
    upper, lower, digit = (counts[:, x].sum(1) > 0 for x in (_UPPER, _LOWER, _DIGIT))
    hexed = counts[:, _NO_HEX].sum(1) == 0
    cases = [digit & (upper | lower) & hexed, digit & upper & lower, digit & (upper | lower), upper & lower, upper | lower]
    return np.select(cases, [bits[k] for k in ("hex", "mixed", "alnum", "cased", "letters")], np.inf)


def reads_like_words(piece: str) -> bool:
    """Numbers, and letters as in names: few groups of digits, long stretches of one case, common letters."""
    stretches = _STRETCH.findall(piece)
    if not stretches:
        return True
    letters = "".join(stretches)
    if len(_DIGITS.findall(piece)) > 2 or len(letters) < 2.8 * len(stretches) and len(piece) > 4:
        return False
    drawn = sum(DRAWN[c] for c in letters.lower())
    run = max(map(len, _NO_VOWELS.findall(letters)), default=0)
    return drawn + 1.5 * max(0, run - 4) < (RANDOM if len(letters) < LONG else 0)


def random_places(s: str) -> np.ndarray:
    """Places that lie in pieces which do not read like words."""
    out = np.zeros(len(s), bool)
    for m in _PIECE.finditer(s):
        if not reads_like_words(m[0]):
            out[m.start() : m.end()] = True
    return out


def _hits(s: str, bits: dict[str, float], width: int, odd: np.ndarray) -> list[tuple[int, int]]:
    """Unions of the windows of ``s`` that reach the threshold of their own class and are no words."""
    upto = np.r_[0, np.cumsum(odd)]
    if upto[-1] < MOST_WORDS:
        return []
    out: list[tuple[int, int]] = []
    for at, counts in windows(s, width):
        n = len(counts)
        own = upto[at + width : at + width + n] - upto[at : at + n]
        over = (own >= MOST_WORDS * width / WIDTH) & (entropies(counts, width) >= least_bits(counts, bits) - 1e-9)
        for i in (at + np.flatnonzero(over)).tolist():
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + width)
            else:
                out.append((i, i + width))
    return out


def candidates(run: str, bits: dict[str, float] = BITS, width: int = WIDTH) -> list[tuple[int, int]]:
    """The findings of a run: whole parts of it that high windows touch, clear of allow-listed strings."""
    low = run.lower()
    allowed = [m.span() for m in UUID.finditer(run)]
    allowed += [(m.start(), m.end()) for a in ALLOWED for m in re.finditer(re.escape(a), low)]
    out, at = [], 0
    for s, e in [*sorted(allowed), (len(run), len(run))]:
        if s - at >= width:
            piece = run[at:s]
            parts = [m.span() for m in _PARTS.finditer(piece)]
            odd = random_places(piece)
            for a, z in _hits(piece, bits, width, odd):
                mine = [p for p in parts if p[0] < z and p[1] > a and odd[p[0] : p[1]].any()]
                a, z = at + mine[0][0], at + mine[-1][1]
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], max(z, out[-1][1]))
                else:
                    out.append((a, z))
        at = max(at, e)
    return out


def scan_text(text: str, bits: dict[str, float] = BITS, width: int = WIDTH) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = [(m.start(), m.group()) for m in RUN.finditer(text)]  # hold every other pattern's matches
    for at, run in runs:
        found += [(at + m.start(), at + m.end(), "access") for m in ACCESS.finditer(run) if m.end() - m.start() >= 20]
        found += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(run) if m.end() - m.start() >= 24]
    base = list(found)
    for at, run in runs:
        for s, e in candidates(run, bits, width):
            if not any(b[0] <= at + s and at + e <= b[1] for b in base):
                found.append((at + s, at + e, "entropy"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _suspects(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that may hold a finding: one with ':' or '=', or with a run of 20 characters."""
    n = len(data)
    rows = np.zeros(len(off) - 1, bool)
    if n == 0:
        return rows
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    ok = _RUN_BYTE[data]
    stop = np.flatnonzero(~ok | cut[:-1])
    ends = np.r_[stop[1:], n]
    long = stop[ends - stop >= 20]
    hits = np.r_[long, np.flatnonzero((data == 58) | (data == 61))]
    rows[np.searchsorted(off, hits, "right") - 1] = True
    return rows


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, bits: dict[str, float] = BITS, width: int = WIDTH) -> DataFrame:
    """One row per document: counts of the stated kinds, a hash of their spans, all spans."""
    none = hashlib.sha256(b"").hexdigest()

    def rows(batches):
        for b in batches:
            n = b.num_rows
            counts = {k: np.zeros(n, np.int64) for k in KINDS[:3]}
            digest, spans = [none] * n, [""] * n
            for lo, hi, data, off in byte_slices(b.column(1), 1 << 20):
                for i in np.flatnonzero(_suspects(data, off)):
                    found = scan_text(data[off[i] : off[i + 1]].tobytes().decode("utf-8"), bits, width)
                    if found:
                        base = [f for f in found if f[2] != "entropy"]
                        for f in base:
                            counts[f[2]][lo + i] += 1
                        digest[lo + i], spans[lo + i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[k]) for k in KINDS[:3]), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCAN)


def _name_of(columns: list[str], name: str) -> str | None:
    """The column that Spark takes for ``name``, whatever its case."""
    return next((c for c in columns if c == name), next((c for c in columns if c.lower() == name), None))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every finding in ``text`` replaced; ``n_chars`` follows where it is there."""
    schema, names = docs.schema, docs.columns
    at = names.index(_name_of(names, "text"))

    def clean(text: str) -> str:
        out, at = [], 0
        for s, e, _ in scan_text(text):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def rows(batches):
        for b in batches:
            changed: dict[int, str] = {}
            for lo, _, data, off in byte_slices(b.column(at), 1 << 20):
                for i in np.flatnonzero(_suspects(data, off)):
                    old = data[off[i] : off[i + 1]].tobytes().decode("utf-8")
                    if (new := clean(old)) != old:
                        changed[int(lo + i)] = new
            if changed:
                texts = b.column(at).to_pylist()
                for i, new in changed.items():
                    texts[i] = new
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b

    # under plain names, as columns may have any
    plain = [f"c{i}" for i in range(len(names))]
    out = docs.toDF(*plain).mapInArrow(rows, StructType([StructField(p, f.dataType, f.nullable) for p, f in zip(plain, schema, strict=True)]))
    if sized := _name_of(names, "n_chars"):
        text, n = plain[at], plain[names.index(sized)]
        out = out.withColumn(n, F.when(F.col(text).isNull(), F.col(n)).otherwise(F.length(text)).cast(schema[sized].dataType))
    return out.toDF(*names)
