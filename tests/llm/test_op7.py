"""op7 against a plain model with dictionaries for counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexforge.llm import op7_lm as op7

from .test_llm import LOWER, SPACE, docs_of, odd_texts

BLANK = b" \t\n\x0b\x0c\r"


def plain_units(text):
    b = (text or "").translate(LOWER).encode()
    out = []
    for i, c in enumerate(b):
        if i == 0 or (c not in BLANK and b[i - 1] in BLANK):
            out.append(b"")
        out[-1] += bytes([c])
    if not out or out[-1][-1] in BLANK:
        out.append(b"")
    return [x + (b"\xff" if i == len(out) - 1 else b"\xfe") for i, x in enumerate(out)]


def contexts(u, j):
    """Contexts of byte j, the longest first."""
    out = [("prefix", u[:j])] if j >= 3 else []
    out += [("four", u[j - 4 : j])] if j >= 5 else []
    return [*out, ("two", min(j, 2), u[max(0, j - 2) : j])]


def word(u):
    return u.rstrip(BLANK + b"\xfe\xff")


class Plain:
    def __init__(self, texts, train):
        self.bytes, self.follow, self.tokens = defaultdict(Counter), Counter(), Counter()
        for t, ok in zip(texts, train, strict=True):
            if ok:
                before = None
                for u in plain_units(t):
                    for j in range(len(u)):
                        for c in contexts(u, j):
                            self.bytes[c][u[j]] += 1
                    if before != b"":
                        self.follow[before, u] += 1
                    before = word(u)
                    self.tokens[before] += before != b""
                self.tokens[None] += 1

    def bits(self, c, y):
        """(logit, occurrences) of the eight bits of y."""
        value = lambda n: float(op7.VALUES[op7.quantised(np.array([n]))[0]])
        counts, out = self.bytes.get(c, {}), []
        for b in range(8):
            before = {z: n for z, n in counts.items() if z >> (8 - b) == y >> (8 - b)}
            own = sum(n for z, n in before.items() if z >> (7 - b) == y >> (7 - b))
            own, other = value(own), value(sum(before.values()) - own)
            out.append((math.log((own + op7.PRIOR) / (other + op7.PRIOR)), own + other))
        return out

    def byte(self, u, j, gate, y=None):
        tau, scale = op7.GATES[gate]
        found = [self.bits(c, u[j] if y is None else y) for c in contexts(u, j)]
        total = 0.0
        for b in range(8):
            z, rest = 0.0, 1.0
            for x in found:
                w = rest * x[b][1] / (x[b][1] + tau)
                z, rest = z + w * x[b][0], rest - w
            total += math.log1p(math.exp(max(-20.0, min(20.0, -scale * z))))
        return total

    def score(self, text):
        losses, before = [], None
        for u in plain_units(text):
            bits = [sum(self.byte(u, j, g) for j in range(len(u))) for g in range(len(op7.GATES))]
            row = []
            for g, kappa in op7.MIXERS:
                p = kappa * math.exp(-bits[g])
                row.append(bits[g] if before == b"" else -math.log((self.follow[before, u] + p) / (self.tokens[before] + kappa)))
            losses.append(row)
            before = word(u)
        total, weight = 0.0, [1 / len(op7.MIXERS)] * len(op7.MIXERS)
        for i in range(0, len(losses), op7.BLOCK):
            p = [w * math.exp(-sum(r[m] for r in losses[i : i + op7.BLOCK])) for m, w in enumerate(weight)]
            total += math.log10(sum(p))
            weight = [x / sum(p) * (1 - op7.SHARE) + op7.SHARE / len(p) for x in p]
        return total


def corpus():
    rng = random.Random(41)
    words = ["".join(rng.choice("abcdéü中") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    odd = odd_texts()
    odd[9], odd[10] = odd[9][:600], "x" * 40
    return [*odd, *(" ".join(rng.choice(words) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randint(1, 70))) for _ in range(60))]


def test_scores_equal_a_plain_model(spark):
    texts = corpus()
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    plain = Plain(texts, train)
    for options in ({}, {"flush": 500, "bucket_bytes": 3000}):
        rows = {r["doc_id"]: r for r in op7.lm_scores(docs_of(spark, texts), **options).collect()}
        n, v = sum(plain.tokens.values()), len([x for x in plain.tokens.values() if x])
        for i, t in enumerate(texts):
            tokens = [*(x.encode() for x in re.findall(SPACE, (t or "").translate(LOWER))), None]
            r = rows[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], len(tokens), sum(plain.tokens[x] > 0 for x in tokens), n)
            assert math.isclose(r["base_score"], sum(math.log10((plain.tokens[x] + 1) / (n + v + 1)) for x in tokens), rel_tol=1e-9)
            assert math.isclose(r["score"], plain.score(t), rel_tol=2e-4, abs_tol=1e-3), (i, t)
            size = len((t or "").encode())
            assert r["bits_per_byte"] is None if not size else math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / size)


def test_probabilities_of_the_next_byte_sum_to_one():
    texts = corpus()
    plain = Plain(texts, [True] * len(texts))
    for u in (b"abc\xfe", b"ab", b"", "é中ab".encode(), b"qqqqqqqq"):
        for gate in range(len(op7.GATES)):
            assert math.isclose(sum(math.exp(-plain.byte(u + b"?", len(u), gate, y)) for y in range(256)), 1, rel_tol=1e-6)


def test_every_text_counts(spark):
    # a text of one part, long or short, tells the others its words
    rng = random.Random(42)
    secret = [" ".join("".join(rng.choice("ghijkl") for _ in range(7)) for _ in range(3000)) for _ in range(2)]
    train = [i for i in range(30) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = ["other words altogether"] * 30
    texts[train[0]], texts[train[-1]], texts[train[5]] = secret[0], secret[0], secret[1]
    rows = {r["doc_id"]: r["bits_per_byte"] for r in op7.lm_scores(docs_of(spark, texts).repartition(5), flush=1000).collect()}
    assert math.isclose(rows[train[0]], rows[train[-1]], rel_tol=1e-6) and rows[train[0]] < 0.8 * rows[train[5]]  # what occurs twice is scored apart


def test_counts_as_codes():
    n = np.array([*range(17), 100, 1000, 10**6, 10**9, 10**15])
    got = op7.VALUES[op7.quantised(n)]
    assert (got[:17] == n[:17]).all() and (np.abs(np.log(got[17:] / n[17:])) < 0.12).all()
    assert len(op7.VALUES) == 256 and (np.diff(op7.VALUES) > 0).all()


@pytest.mark.parametrize("width", [1, 9])
def test_packed(width):
    x = np.random.default_rng(1).integers(0, 256, (1000, width)).astype(np.uint8)
    assert (op7.unpacked(op7.packed(x), "u1", width).reshape(x.shape) == x).all()
    keys = np.sort(np.random.default_rng(2).integers(0, 2**63, 500).astype(np.uint64))
    assert (op7._pairs_of(op7._pairs_packed(keys)) == keys).all()


def test_none_and_untrained(spark):
    assert op7.lm_scores(docs_of(spark, [])).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = op7.lm_scores(docs_of(spark, ["ab"], [held])).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (2, 0, 0, 0.0)
    assert math.isclose(r["score"], -3 * 8 * math.log10(2), rel_tol=1e-6)
