"""Secrets in texts: known shapes, and strings that pass for random.

A candidate is a long unbroken run of base64-like characters, or what known shapes leave of it. Its
encoding is inferred, and three tests say how well it fits uniform randomness: chi-squared over the
alphabet, runs around the alphabet's middle, and lag-one serial correlation. Ordinary text must not
pass by luck, so a candidate also says how unlike prose it is: its letters' likelihood under
published letter frequencies, and its changes between cases and digits, both as deviations that
allow for its length. So lengths and encodings share one null distribution, and decoys, equally
long stretches of the prose around each candidate, are pooled to check it. The Benjamini-Hochberg
procedure over all candidates then holds the false-discovery rate; a single strong key is enough.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.llm.texts import documents
from staylight.workspace import written

#: The known shapes, in their order of listing. Letters of an assignment's name in either case.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Alphabets by encoding; the first that holds every character is inferred.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}

#: Published frequencies of the letters a to z in English, in per cent.
FREQUENCIES = (
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4,
    0.15, 2.0, 0.074,
)
_SHARE = np.array(FREQUENCIES) / sum(FREQUENCIES)
_LOG = np.log(_SHARE)
_MEAN = float(_SHARE @ _LOG)
_SD = math.sqrt(float(_SHARE @ _LOG**2) - _MEAN**2)
#: Share of neighbours that differ in kind (small, capital, digit) in names made of words; and how much wider than
#: that of independent letters the distribution of real words is.
CHANGES, SPREAD = 0.25, 1.5
_KIND = np.full(128, -1)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 0, 1, 2
#: Deviations are counted in tenths, from -5 to 40.
TENTHS = (-50, 400)


@dataclass(frozen=True)
class Battery:
    """``least`` and ``rate``: shortest candidate, and wanted false-discovery rate. ``alpha``: a candidate whose three
    tests together have a p-value below it is not random."""

    least: int = 20
    rate: float = 0.05
    alpha: float = 0.001


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the known shapes (start, end, kind), leftmost and non-overlapping per kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    # Runs of a fixed shape are maximal, so asking for the length at once changes nothing.
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def infer(token: str) -> str | None:
    """The narrowest encoding whose alphabet holds the token (padding aside)."""
    body = set(token.rstrip("="))
    return next((name for name, letters in ALPHABETS.items() if body <= set(letters)), None) if body else None


# --- the tests ------------------------------------------------------------------------
def _upper_tail(x: float, degrees: int) -> float:
    """P(chi-squared >= x), by the Wilson-Hilferty cube root."""
    z = ((x / degrees) ** (1 / 3) - (1 - 2 / (9 * degrees))) / math.sqrt(2 / (9 * degrees))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def p_values(codes: np.ndarray, size: int) -> tuple[float, float, float]:
    """Chi-squared, runs and serial-correlation p-values of ``codes`` in 0..size-1, under
    the hypothesis that each is drawn evenly and by itself."""
    n = len(codes)
    counts = np.bincount(codes, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() / (n / size))
    high = codes >= size / 2
    ups = int(high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    # Half the alphabet lies on either side, so the number of changes is binomial.
    p_runs = _two_sided((runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4)) if n > 1 else 1.0
    if ups in (0, n) and n > 1:
        p_runs = min(p_runs, 2.0 ** (1 - n))
    centred = codes - (size - 1) / 2
    variance = (size * size - 1) / 12
    serial = float((centred[1:] * centred[:-1]).sum()) / (variance * math.sqrt(max(1, n - 1)))
    return _upper_tail(chi, size - 1), p_runs, _two_sided(serial)


def battery_p(codes: np.ndarray, size: int) -> float:
    """The three p-values combined by Fisher's method."""
    x = -sum(math.log(max(p, 1e-300)) for p in p_values(codes, size))
    # Half of Fisher's statistic; with six degrees its tail is a short sum.
    return math.exp(-x) * (1 + x + x * x / 2)


def unlike_prose(token: str) -> int:
    """How far the token is from prose, in tenths of a standard deviation: rare letters and many changes of
    kind are far. Other characters than letters and digits are passed over."""
    code = np.frombuffer(token.encode("latin-1"), np.uint8)
    kind = _KIND[code]
    code, kind = code[kind >= 0], kind[kind >= 0]
    letters = (code[kind < 2] | 32) - ord("a")
    z = 0.0
    if len(letters):
        z += (_MEAN * len(letters) - float(_LOG[letters].sum())) / (_SD * math.sqrt(len(letters)))
    n = len(kind) - 1
    if n > 0:
        z += (int((kind[1:] != kind[:-1]).sum()) - CHANGES * n) / math.sqrt(CHANGES * (1 - CHANGES) * n)
    return min(max(math.floor(z / math.sqrt(2) / SPREAD * 10), TENTHS[0]), TENTHS[1])


def _codes(token: str, name: str) -> np.ndarray:
    """Places in the alphabet; characters outside it (those of decoys) fold onto it."""
    letters = ALPHABETS[name]
    table = np.arange(256) % len(letters)
    table[[ord(c) for c in letters]] = np.arange(len(letters))
    return table[np.frombuffer(token.encode("latin-1"), np.uint8)]


#: Words that stand by themselves, so that no part of another key is taken for prose.
_LETTERS = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z]{1,19}(?![A-Za-z0-9+/_=-])")


def _decoy(text: str, start: int, end: int, length: int) -> str | None:
    """So many ASCII letters of the prose before the candidate, or else after it. The reach
    grows until they are enough or the text ends."""
    for forward in (False, True):
        reach = 4 * length
        while True:
            part = text[end : end + reach] if forward else text[max(0, start - reach) : start]
            letters = "".join(_LETTERS.findall(part))
            if len(letters) >= length:
                return letters[:length] if forward else letters[-length:]
            if len(part) < reach:
                break
            reach *= 2
    return None


_SEPARATORS = (re.compile("[-_]+"), re.compile("[+/]+"))


def _free(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What ``taken`` (sorted, disjoint) leaves of a stretch."""
    k = bisect_right(taken, (start, start))
    if k and taken[k - 1][1] > start:
        start = taken[k - 1][1]
    while k < len(taken) and taken[k][0] < end:
        if taken[k][0] > start:
            yield start, taken[k][0]
        start = max(start, taken[k][1])
        k += 1
    if start < end:
        yield start, end


def _encoded(text: str, start: int, end: int, least: int) -> Iterator[tuple[int, int, str]]:
    """The stretch with its encoding. One that mixes the alphabets of two encodings is taken apart at the
    separators of one of them, whichever leaves the longer part."""
    name = infer(text[start:end])
    if name:
        yield start, end, name
        return
    cuts = []
    for separator in _SEPARATORS:
        edges = [start, *(x for m in separator.finditer(text, start, end) for x in m.span()), end]
        cuts.append([(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least])
    for a, b in max(cuts, key=lambda parts: max((b - a for a, b in parts), default=0)):
        name = infer(text[a:b])
        if name:
            yield a, b, name


def _candidates(text: str, found: re.Pattern, base: list[tuple[int, int, str]], battery: Battery):
    """(start, end, whether it passes for random, how unlike prose, how unlike it its decoy is or None) outside
    the ``base`` spans."""
    taken: list[tuple[int, int]] = []
    for a, b, _ in base:
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for m in found.finditer(text):
        for start, end in _free(m.start(), m.end(), taken):
            if end - start < battery.least:
                continue
            for a, b, name in _encoded(text, start, end, battery.least):
                token = text[a:b].strip("=")
                # Words joined by punctuation are prose; a random string mixes kinds of characters.
                if len(token) < battery.least or token.isalpha() and (token.islower() or token.isupper() or token.istitle()):
                    continue
                decoy = _decoy(text, a, b, len(token))
                random = battery_p(_codes(token, name), len(ALPHABETS[name])) >= battery.alpha
                yield a, b, random, unlike_prose(token), unlike_prose(decoy) if decoy else None


SPANS = "array<struct<start:int,end:int,kind:string>>"
CANDIDATES = "array<struct<start:int,end:int,random:boolean,unlike:int,decoy:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_CANDIDATE_TYPE = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("random", pa.bool_()), ("unlike", pa.int32()), ("decoy", pa.int32())]
    )
)


def measured(docs: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """``doc_id``, ``base`` spans and tested ``candidates`` of each whole text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile("[A-Za-z0-9+/_-]{%d,}={0,2}" % battery.least)
        for batch in batches:
            base, tested = [], []
            for text in batch.column(1):
                text = text.as_py()
                spans = base_spans(text)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                names = ("start", "end", "random", "unlike", "decoy")
                tested.append([dict(zip(names, c)) for c in _candidates(text, found, spans, battery)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _SPAN_TYPE), pa.array(tested, _CANDIDATE_TYPE)],
                ["doc_id", "base", "candidates"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(scan, f"doc_id {kind}, base {SPANS}, candidates {CANDIDATES}")


def least_unlike(tested: DataFrame, battery: Battery = Battery()) -> int | None:
    """The least deviation from prose that counts as a discovery, in tenths; None if there is none.

    ``tested`` has one row per candidate. They are counted by deviation, so at most 451 rows reach the driver,
    whatever the input. The p-value of a deviation is the larger of the normal one and the share of all decoys
    as far from prose. Benjamini-Hochberg: the least deviation whose p-value is at most the wanted rate times the share
    of candidates that are random and as far from prose.
    """
    point = lambda at, own, all_, decoys: F.struct(
        F.col(at).alias("at"), own.alias("own"), F.lit(all_).alias("tested"), F.lit(decoys).alias("decoys")
    )
    points = tested.select(
        F.inline(F.array(point("unlike", F.col("random").cast("int"), 1, 0), point("decoy", F.lit(0), 0, 1)))
    )
    sums = [F.sum(c).alias(c) for c in ("own", "tested", "decoys")]
    rows = sorted(points.filter("at is not null").groupBy("at").agg(*sums).collect(), key=lambda r: -r["at"])
    everything, all_decoys = sum(r["tested"] for r in rows), sum(r["decoys"] for r in rows)
    own = decoys = 0
    least = None
    for row in rows:
        own, decoys = own + row["own"], decoys + row["decoys"]
        p = 0.5 * math.erfc(row["at"] / 10 / math.sqrt(2))
        if all_decoys:
            p = max(p, decoys / all_decoys)
        if own and p * everything <= battery.rate * own:
            least = row["at"]
    return least


def scan_secrets(docs: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` spans, and all ``spans`` with those that pass for
    random in the corpus as a whole.

    Starts and ends are code points, ends exclusive. Spans come by start, then kind as listed
    in :data:`KINDS`. Missing and empty texts have none. Repeated rows give equal rows. Digits alone are
    never discoveries: numbers are as random as keys.
    What the scan finds is written once, so texts are read once.
    """
    found = written(measured(docs, battery), "secret-candidates")
    least = least_unlike(found.select(F.inline("candidates")), battery)
    random = F.transform(
        F.filter("candidates", lambda c: c["random"] & (c["unlike"] >= F.lit(least).cast("int"))),
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("random").alias("kind")),
    )
    place = lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")
    )
    every = F.sort_array(F.transform(F.concat("base", random), place))
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return found.select("doc_id", "base", F.transform(every, plain).alias("spans"))


def joined(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
