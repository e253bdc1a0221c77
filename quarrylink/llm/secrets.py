"""Secret scan: fixed patterns plus a battery of randomness tests.

Base spans (code points, end exclusive): ``assign`` (a credential name, a separator and a value of 6 or more
characters), ``access`` (access-key ids) and ``hex`` (24 or more lower-case hex digits).

``random`` spans are added by the battery.  Each run of 20 or more token characters that touches no base span
(an equals sign ends a run, so that of NAME=value the value is tested alone; signs that no token character follows
are padding and belong to the span) gets an encoding (hex, base32 or base64, the smallest alphabet that holds it).
Two families of hypotheses are then tested over the whole scan, each with the step-up rule at its rate in FDR:

* that a run is a uniform draw from its alphabet: chi-squared uniformity over binned symbols, the runs test about the
  middle symbol and lag-one serial correlation give three p-values, of which the run's is three times the smallest;
  what is rejected is no secret;
* that a run is word-like, its neighbouring letters and digits changing class (lower, upper, digit; a capital before
  a small letter is no change) with probability WORD_CHANGE at most: the p-value is the binomial tail; only what is
  rejected is a secret.

The rule is aware of lengths: a p-value is divided by a weight that grows with the logarithm of the run's length and
has mean 1 over the scan, so that long runs, whose tests can tell more, need less.  A first pass tallies the weighted
p-values of all texts in BINS bins of fixed width; from these come the two thresholds that the second pass applies.
A value counts as its bin's upper end, so the rule is never looser than on the values themselves.

Defined results: null and empty texts have no spans; a null id stays null; repeated rows give one row each;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.llm.common import id_and_text, map_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 6, 20, 24, 20
WORD_CHANGE = 0.15
#: False-discovery rates of the two families: a uniform draw that is rejected, and word-like text that is not.
FDR = (0.001, 0.01)
#: Of -log10 of a weighted p-value.
BIN, BINS = 0.02, 3000

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
RANK = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}


def byte_class(letters: str) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(letters.encode())] = True
    return held


HEX_BYTES = byte_class("0123456789abcdef")
TOKEN_BYTES = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def long_runs(raw: np.ndarray, held: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` bytes of a class."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = held[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def base_spans(text: str, data: bytes, raw: np.ndarray) -> list[tuple[str, int, int]]:
    """The spans of the three fixed patterns."""
    found = []
    low = data.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    at = point_of(raw, len(text))
    return found + [("hex", at(s), at(e)) for s, e in long_runs(raw, HEX_BYTES, MIN_HEX)]


def point_of(raw: np.ndarray, n_points: int):
    """Byte offset to code-point offset."""
    if n_points == len(raw):
        return lambda i: i
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return lambda i: int(points[i])


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, df: int) -> float:
    """Upper tail by the Wilson-Hilferty cube-root approximation."""
    return normal_tail(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))


def encoding_of(run: str) -> tuple[str, np.ndarray] | None:
    """The smallest alphabet that holds the run, without padding, and the symbols' ranks in it."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    folded = run.lower() if run == run.upper() else run
    for name, text in (("hex", folded), ("base32", run), ("base64", run)):
        ranks = [RANK[name].get(c, -1) for c in text]
        if ranks and min(ranks) >= 0:
            return name, np.array(ranks, float)
    return None


def uniformity_p(ranks: np.ndarray, size: int) -> float:
    bins = max(2, min(size, len(ranks) // 5))
    counts = np.bincount((ranks * bins // size).astype(int), minlength=bins)
    share = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    expected = len(ranks) * share
    return chi_squared_tail(float(((counts - expected) ** 2 / expected).sum()), bins - 1)


def runs_p(ranks: np.ndarray, size: int) -> float:
    high = ranks >= size / 2
    n, a = len(high), int(high.sum())
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return 2 * normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(ranks: np.ndarray) -> float:
    d = ranks - ranks.mean()
    if not (total := float((d * d).sum())):
        return 0.0
    n = len(d)
    return 2 * normal_tail(abs(float((d[1:] * d[:-1]).sum()) / total + 1 / n) * math.sqrt(n))


def random_p(run: str) -> float | None:
    """The battery's p-value of a uniform draw; None for a run in no alphabet, or too short without its padding."""
    if not (found := encoding_of(run)) or len(found[1]) < MIN_RANDOM:
        return None
    name, ranks = found
    size = len(ALPHABETS[name])
    return min(1.0, 3 * min(uniformity_p(ranks, size), runs_p(ranks, size), serial_p(ranks)))


def word_p(run: str) -> float:
    """Tail probability of as many class changes under the word-like null."""
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 for c in run if c.isalnum()]
    n, t = max(0, len(kinds) - 1), sum(a != b and (a, b) != (1, 0) for a, b in zip(kinds, kinds[1:], strict=False))
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(WORD_CHANGE) + (n - i) * math.log1p(-WORD_CHANGE) for i in range(t, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def padded(data: bytes, raw: np.ndarray, end: int) -> int:
    """Where a run with its padding ends; equals signs before another token character are none."""
    after = end
    while data[after : after + 1] == b"=":
        after += 1
    return end if after < len(data) and TOKEN_BYTES[raw[after]] else after


def tested_runs(text: str, data: bytes, raw: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[int, int, float, float, float]]:
    """(begin, end, weight, p of a uniform draw, p of word-like text) of the runs that touch no base span."""
    at = point_of(raw, len(text))
    starts = sorted((b, e) for _, b, e in base)
    furthest = list(accumulate((e for _, e in starts), max))
    out = []
    for s, e in long_runs(raw, TOKEN_BYTES, MIN_RANDOM):
        s, e = at(s), at(padded(data, raw, e))
        before = bisect_left(starts, (e, 0))
        if (not before or furthest[before - 1] <= s) and (p := random_p(text[s:e])) is not None:
            out.append((s, e, 1 + math.log2((e - s) / MIN_RANDOM), p, word_p(text[s:e])))
    return out


def bin_of(p: float, weight: float) -> int:
    return min(BINS, max(0, math.floor(-math.log10(max(p / weight, 1e-300)) / BIN)))


class Tally:
    """Counts of weighted p-values by bin, one row for each family, and the sum of the weights."""

    def __init__(self):
        self.counts, self.weight = np.zeros((2, BINS + 1), np.int64), 0.0

    def add(self, runs: Iterable[tuple[int, int, float, float, float]]) -> None:
        for _, _, weight, p, q in runs:
            self.weight += weight
            self.counts[0, bin_of(p, weight)] += 1
            self.counts[1, bin_of(q, weight)] += 1

    def cuts(self, rates: tuple[float, float] = FDR) -> tuple[int, int]:
        """The least bin of each family that the step-up rule rejects; BINS + 1 if none."""
        m = int(self.counts[0].sum())
        if not m:
            return BINS + 1, BINS + 1
        reached = np.cumsum(self.counts[:, ::-1], axis=1)[:, ::-1]
        upper = 10.0 ** (-BIN * np.arange(BINS + 1)) * self.weight / m
        return tuple(int(np.flatnonzero(ok)[0]) if (ok := upper <= rate * row / m).any() else BINS + 1 for row, rate in zip(reached, rates, strict=True))


def spans_under(base: list[tuple[str, int, int]], runs: list[tuple[int, int, float, float, float]], cuts: tuple[int, int]) -> list[tuple[str, int, int]]:
    found = [("random", s, e) for s, e, weight, p, q in runs if bin_of(p, weight) < cuts[0] and bin_of(q, weight) >= cuts[1]]
    return sorted(base + found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def runs_of(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, float, float, float]]]:
    """Base spans and tested runs of one text."""
    if not text:
        return [], []
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    base = base_spans(text, data, raw)
    return base, tested_runs(text, data, raw, base)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a scan of one text, by start, then kind."""
    base, runs = runs_of(text)
    tally = Tally()
    tally.add(runs)
    return spans_under(base, runs, tally.cuts())


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def cuts_of(texts: DataFrame) -> tuple[int, int]:
    """The thresholds of a scan of all texts.  What reaches the driver has at most 2 * (BINS + 1) rows."""

    def make():
        def work(rows):
            tally = Tally()
            for x in rows["text"]:
                tally.add(runs_of(x)[1])
            family, place = np.nonzero(tally.counts)
            share = [tally.weight if i == 0 else 0.0 for i in range(len(place))]
            return {"family": family, "bin": place, "n": tally.counts[family, place], "weight": share}

        return work

    total = Tally()
    for r in map_batches(texts.select("text"), make, "family int, bin int, n bigint, weight double").groupBy("family", "bin").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).collect():
        total.counts[r["family"], r["bin"]] = r["n"]
        total.weight += r["weight"]
    return total.cuts()


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, begin, finish>> for each row."""
    rows = id_and_text(df, id_col, text_col)
    cuts = cuts_of(rows)

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "spans": [[dict(kind=k, begin=s, finish=e) for k, s, e in spans_under(*runs_of(x), cuts)] for x in rows["text"]]}

    kind = dict(df.dtypes)[id_col]
    return map_batches(rows, make, f"doc_id {kind}, spans array<struct<kind:string,begin:bigint,finish:bigint>>")
