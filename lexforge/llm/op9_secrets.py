"""Secret scans: known forms, and strings whose sliding-window entropy is that of random keys.

A candidate is a maximal run of ``[A-Za-z0-9+/_=-]`` with a digit and a letter. Windows of ``width`` characters slide over it; the entropy follows from counts
that change by one character in, one out. Each window is classed by its own characters: if all its letters and digits are hexadecimal
it is held against the hexadecimal threshold, else against the general one; in a run with other letters too, where the window has both and is
in no UUID. Windows at or above the threshold merge into a span. The allow list
then suppresses spans of forms that look random but aren't secret, and spans that a known form already has.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .kernels import Words, chunks

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_HEX_CHARS = frozenset("0123456789abcdefABCDEF")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")

#: Candidate strings that are no secrets: UUIDs, numbers with separators, dates, and alphabets in order.
ALLOW = (
    _UUID.pattern,
    r"[0-9+/_=-]+",
    r"[a-z]+([-_/+=][a-z]+|[-_/+=][0-9]+)*",
    r"[A-Z]?[a-z]+([-_/+=][A-Z]?[a-z]+|[-_/+=][0-9]+)*",
    r"(?=.*0123456789).*|(?i:.*abcdefghijklm.*)",
)

_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def random_spans(s: str, width: int, hex_bits: float, other_bits: float) -> list[tuple[int, int]]:
    """Merged spans of s in which every window of ``width`` characters has the entropy that its class asks for."""
    # running counts of characters that no hexadecimal window has, of digits and of letters
    other = [0, *accumulate(c.isalnum() and c not in _HEX_CHARS for c in s)]
    if other[-1]:
        for m in _UUID.finditer(s):
            other = [n + max(0, min(i, m.end()) - m.start()) for i, n in enumerate(other)]
    digit, letter = ([0, *accumulate(kind(c) for c in s)] for kind in (str.isdigit, str.isalpha))
    x_log_x = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += x_log_x[n + 1] - x_log_x[n] if n < width else 0.0
        if i + 1 > width:
            old = s[i - width]
            m = counts[old]
            counts[old] = m - 1
            total -= x_log_x[min(m, width)] - x_log_x[m - 1]
        if i + 1 < width:
            continue
        a, z = i + 1 - width, i + 1
        bar = hex_bits if other[z] == other[a] and (not other[-1] or (digit[z] > digit[a] and letter[z] > letter[a])) else other_bits
        if math.log2(width) - total / width >= bar:
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], z)
            else:
                spans.append((a, z))
    return spans


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three known forms."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _scan(width: int, hex_bits: float, other_bits: float, allow: tuple[str, ...]):
    allowed = re.compile("|".join(f"(?:{x})" for x in allow), re.A | re.S)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null("")
            known = pc.or_(
                pc.match_substring_regex(column, r"(?i)password|passwd|secret|token|api_?key"),
                pc.or_(pc.match_substring(column, "AKIA"), pc.match_substring_regex(column, r"[0-9a-f]{32}")),
            ).to_numpy(zero_copy_only=False)
            spans: dict[int, list[tuple[int, int, int]]] = {int(i): known_spans(column[int(i)].as_py()) for i in np.flatnonzero(known)}
            for lo, _, data, off in chunks(column):
                w = Words(data, off, _CANDIDATE, hashes=False)
                long = w.len >= width
                if not long.any():
                    continue
                start, end, doc = w.start[long], w.end[long], w.doc[long]
                both = np.ones(len(start), bool)
                for kind in (_DIGIT, _LETTER):
                    seen = np.r_[0, np.cumsum(kind[data])]
                    both &= seen[end] > seen[start]
                heads = None
                for a, z, d in zip(start[both], end[both], doc[both], strict=True):
                    s = data[a:z].tobytes().decode()
                    found = [] if allowed.fullmatch(s) else random_spans(s, width, hex_bits, other_bits)
                    if not found:
                        continue
                    if heads is None:
                        heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                    at = int(heads[a] - heads[off[d]])  # code points before the candidate
                    mine = spans.setdefault(lo + int(d), [])
                    base = [x for x in mine if x[1] < 3]
                    mine += [(at + x, 3, at + y) for x, y in found if not any(x + at < e and b < y + at for b, _, e in base)]
            n = [[0] * len(column) for _ in range(3)]
            base, every = [""] * len(column), [""] * len(column)
            for i, found in spans.items():
                found.sort()
                named = [(k, f"{KINDS[k]}:{a}:{z}") for a, k, z in found]
                base[i] = ",".join(x for k, x in named if k < 3)
                every[i] = ",".join(x for _, x in named)
                for k in range(3):
                    n[k][i] = sum(x[1] == k for x in found)
            empty = hashlib.sha256(b"").hexdigest()
            sha = [hashlib.sha256(x.encode()).hexdigest() if x else empty for x in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(every, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secrets(docs: DataFrame, width: int = 20, hex_bits: float = 3.0, other_bits: float = 3.8, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Return (doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs`` (doc_id, text).

    ``spans`` are kind:start:end in code points, by start, comma-joined; ``base_sha256`` is the digest of those of the three known forms.
    Null is empty text, which has none; row by row, so repeated rows and null doc_id stay. No shuffle. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(width, hex_bits, other_bits, allow), f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
