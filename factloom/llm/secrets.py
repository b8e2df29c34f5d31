"""Secrets in text: fixed patterns, and tokens that a randomness battery picks out.

Every run of at least ``SHORTEST`` base-64 signs, with padding, is a token; of a run that mixes the signs
of both base-64 alphabets the parts that one of them holds are tokens too.  Its encoding is
inferred from the signs it uses (the narrowest alphabet that holds them), and three tests ask whether its symbols look
drawn at random from that alphabet: chi-squared for uniformity, the runs test
(of vowels and consonants among letters of one case, else about the alphabet's middle), and the lag-1 serial correlation.  Fisher's method
joins them in one score; a small score looks random.

What remains is to tell random tokens from words, by the tests alone.  Tokens made of small letters, or of a capital and
small ones, are the corpus's own words but for a few; scored under every alphabet that holds
them in either case they give, for each alphabet and band of lengths, the score's distribution
under "it is a word", by its median and the spread above it, which few random tokens cannot move.  A token's p-value is its place in that distribution, and
Benjamini and Hochberg's step-up holds the share of false discoveries among all
tokens, words included, at ``rate``.  What is gathered for that is a histogram of fixed size.

The tests know random tokens from words where there is enough to see: capitals or small letters alone and tokens under 20
signs are found less often than longer or mixed ones, and random letters that outnumber the words of their lengths hide each other.  Null and empty texts have no spans; texts of any length are scanned whole; repeated rows count as often as they stand.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")

SHORTEST = 16
#: The part of false discoveries that is aimed at.
RATE = 0.002
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
#: Parts of a run that mixes both base-64 variants: between its '+' and '/', between its '-' and '_', and between all of them.
PARTS = [re.compile(r"[A-Za-z0-9%s]{%d,}={0,2}" % (more, SHORTEST)) for more in ("_-", "+/", "")]
WORD = re.compile(r"[A-Z]?[a-z]+")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets, narrowest first.
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "either": UPPER + LOWER + DIGITS + "+/-_",
}
NAMES = list(ALPHABETS)
CODES = np.full((len(NAMES), 128), -1, np.int64)
for _k, _signs in enumerate(ALPHABETS.values()):
    for _fold in (str.upper, str.lower, str):  # a word counts in alphabets of one case as if written in it
        CODES[_k, [ord(_fold(c)) for c in _signs]] = np.arange(len(_signs))
SIZES = np.array([len(x) for x in ALPHABETS.values()])
#: Which signs count as high in the runs test.
HIGH = np.arange(72)[None, :] >= SIZES[:, None] / 2
HIGH[[NAMES.index("lower"), NAMES.index("upper")]] = np.isin(np.arange(72), [LOWER.index(c) for c in "aeiouy"])

BANDS, BINS, BIN = 16, 160, 0.05
#: Fisher's statistic of three tests above which randomness itself is rejected (chi-squared, 6 degrees, 0.999).
NOT_RANDOM = 22.46
#: The chance that two signs of a word are equal (of one that hexadecimal holds, with six letters only), and the
#: weight, in words, of this prior where a band has few.
COINCIDENCE, PRIOR_SD, PRIOR_WEIGHT = np.where(SIZES == 16, 0.2, 0.066), 0.35, 100


def log_sf(z: np.ndarray) -> np.ndarray:
    """Natural logarithm of a standard normal's upper tail."""
    z = np.asarray(z, float)
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = np.maximum(z, 4)
    return np.where(z > 5, -far * far / 2 - np.log(far * math.sqrt(2 * math.pi)), np.log(np.clip(np.where(z < 0, 1 - tail, tail), 1e-300, 1)))


def chi_z(x2: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Wilson and Hilferty's normal deviate of a chi-squared value."""
    return (np.cbrt(x2 / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))


def battery(codes: np.ndarray, lengths: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Fisher's statistic of the three tests, of consecutive tokens in ``codes`` over alphabets of those ``kinds``."""
    n, m, sizes = lengths.astype(float), len(lengths), SIZES[kinds].astype(float)
    owner = np.repeat(np.arange(m), lengths)
    counts = np.bincount(owner * 72 + codes, minlength=m * 72).reshape(m, 72).astype(float)
    x2 = sizes / n * (counts**2).sum(1) - n
    p_chi = log_sf(chi_z(np.maximum(x2, 0), sizes - 1.0))

    high = HIGH[kinds[owner], codes].astype(float)
    n1 = np.bincount(owner, high, m)
    same = owner[1:] == owner[:-1]
    runs = 1 + np.bincount(owner[1:], same & (high[1:] != high[:-1]), m)
    both = 2 * n1 * (n - n1)
    var = both * (both - n) / (n * n * (n - 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        z_runs = np.where(var > 0, np.abs(runs - 1 - both / n) / np.sqrt(np.maximum(var, 1e-12)), np.sqrt(n))
    x = codes - (np.bincount(owner, codes, m) / n)[owner]
    spread = np.bincount(owner, x * x, m)
    lag = np.bincount(owner[1:], np.where(same, x[1:] * x[:-1], 0), m)
    with np.errstate(invalid="ignore", divide="ignore"):
        z_serial = np.where(spread > 0, np.abs(lag / np.maximum(spread, 1e-12) + 1 / n) * np.sqrt(n), np.sqrt(n))
    two = lambda z: np.minimum(0.0, log_sf(z) + math.log(2))
    return -2 * (p_chi + two(z_runs) + two(z_serial))


def band_of(lengths: np.ndarray) -> np.ndarray:
    return np.clip((4 * np.log2(np.maximum(lengths, SHORTEST) / SHORTEST)).astype(int), 0, BANDS - 1)


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.clip((np.log(np.maximum(score, 1e-9) + 1) / BIN).astype(int), 0, BINS - 1)


def token_places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a text, in order; parts of one run may overlap."""
    out = []
    for m in TOKEN.finditer(text):
        run = m[0]
        if ("+" in run or "/" in run) and ("-" in run or "_" in run):
            out += sorted({m.span(), *((m.start() + x.start(), m.start() + x.end()) for part in PARTS for x in part.finditer(run))})
        else:
            out.append(m.span())
    return out


def score_tokens(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of a token and an alphabet: the token, the alphabet, the band and the bin of the score.

    A word is paired with all alphabets that hold it in either case, first the narrowest that holds it as it is, another token with the
    narrowest; padding at its end is left out.
    """
    cut = [t.rstrip("=") for t in tokens]
    own, which = [], []
    for i, t in enumerate(cut):
        if len(t) < SHORTEST:
            continue
        signs = {*t}
        fits = [k for k, name in enumerate(NAMES) if signs <= _SETS[name]]
        if WORD.fullmatch(t):
            low, high = {*t.lower()}, {*t.upper()}
            fits = fits[:1] + [k for k, name in enumerate(NAMES) if k != fits[0] and (low <= _SETS[name] or high <= _SETS[name])]
        for k in fits if WORD.fullmatch(t) else fits[:1]:
            own.append(i)
            which.append(k)
    if not own:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    lengths = np.array([len(cut[i]) for i in own])
    flat = np.frombuffer("".join(cut[i] for i in own).encode("ascii"), np.uint8)
    kinds = np.array(which)
    codes = CODES[np.repeat(kinds, lengths), flat]
    return np.array(own), kinds, band_of(lengths), bin_of(battery(codes, lengths, kinds))


def _narrowest(own: np.ndarray) -> np.ndarray:
    """Of each token's pairs the first, under which it is tested."""
    return np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)


_SETS = {k: set(v) for k, v in ALPHABETS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    out = []
    low = text.lower() if len(text) > 3 else ""
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def survey(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[tuple[int, int], int]:
    """The highest score bin that counts as random, by alphabet and band of lengths; -1 where none does."""
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            tokens = [x[a:b] for x in batch.column(0).to_pylist() if x for a, b in token_places(x)]
            own, kinds, bands, bins = score_tokens(tokens)
            if not len(own):
                continue
            word = np.array([bool(WORD.fullmatch(t.rstrip("="))) for t in tokens], bool)[own]
            for kind, these in ((True, word), (False, _narrowest(own))):
                seen.update(zip([kind] * int(these.sum()), kinds[these].tolist(), bands[these].tolist(), bins[these].tolist(), strict=True))
        rows = [(*k, n) for k, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["word", "kind", "band", "bin", "n"])

    found = docs.select(text).mapInArrow(run, "word boolean, kind int, band int, bin int, n long")
    hist = np.zeros((2, len(NAMES), BANDS, BINS))
    for r in found.groupBy("word", "kind", "band", "bin").agg(F.sum("n").alias("n")).collect():  # at most 2 x 11 x 16 x 160 rows
        hist[int(r.word), r.kind, r.band, r.bin] = r.n
    return cuts(hist, rate)


def _centre(at: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Median, spread above it (random tokens among the words lie below), and total weight, of a histogram."""
    total = float(weight.sum())
    if not total:
        return 0.0, 0.0, 0.0
    mu = float(at[np.searchsorted(np.cumsum(weight), total / 2)])
    up = weight * (at >= mu)
    return mu, math.sqrt(float(up @ (at - mu) ** 2 / up.sum())), total


def chances(hist: np.ndarray) -> np.ndarray:
    """How likely a word's score is as low as each bin, by alphabet and band of lengths.

    What the coincidences of a word's letters let expect is corrected by the words of the band as far as it has many.
    """
    at = (np.arange(BINS) + 0.5) * BIN
    n = SHORTEST * 2 ** ((np.arange(BANDS) + 0.5) / 4)
    p = np.ones((len(NAMES), BANDS, BINS))
    for k in range(len(NAMES)):
        x2 = n * (SIZES[k] * COINCIDENCE[k] - 1) + SIZES[k] - 1
        mean = np.log(1 - 2 * log_sf(chi_z(x2, np.array(SIZES[k] - 1.0))) + 4 * math.log(2))
        for b in range(BANDS):
            mu, sd, total = _centre(at, hist[1, k, b])
            part = PRIOR_WEIGHT / (PRIOR_WEIGHT + total)
            mu, sd = part * mean[b] + (1 - part) * mu, math.sqrt(part * PRIOR_SD**2 + (1 - part) * sd**2)
            p[k, b] = np.exp(log_sf((mu - at) / max(sd, BIN)))
    return p


def cuts(hist: np.ndarray, rate: float) -> dict[tuple[int, int], int]:
    """Benjamini and Hochberg's step-up over the tokens of a histogram, its words as the null."""
    p, at = chances(hist), (np.arange(BINS) + 0.5) * BIN
    tokens = hist[0].reshape(-1)
    order = np.argsort(p.reshape(-1), kind="stable")
    below = np.cumsum(tokens[order])
    good = (p.reshape(-1)[order] <= rate * below / max(below[-1], 1)) & (below > 0)
    most = p.reshape(-1)[order][np.flatnonzero(good)[-1]] if good.any() else -1.0
    random = (p <= most) & (np.exp(at) - 1 <= NOT_RANDOM)
    return {(k, b): int(np.flatnonzero(random[k, b])[-1]) if random[k, b].any() else -1 for k in range(len(NAMES)) for b in range(BANDS)}


def spans_of(texts: list[str | None], cut: dict[tuple[int, int], int]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text, in order; a random token that meets a base span is part of that, and random ones that overlap are one."""
    out = [base_spans(x) if x else [] for x in texts]
    where = [(i, a, b) for i, x in enumerate(texts) if x for a, b in token_places(x)]
    tokens = [texts[i][a:b] for i, a, b in where]
    own, kinds, bands, bins = score_tokens(tokens)
    first = _narrowest(own)
    for t, k, b, x in zip(*(c[first].tolist() for c in (own, kinds, bands, bins)), strict=True):
        i, start, end = where[t]
        if x <= cut[k, b] and not any(a < end and start < e for a, kind, e in out[i] if kind < 3):
            last = out[i][-1] if out[i] else (0, 0, 0)
            if last[1] == 3 and start < last[2]:
                out[i][-1] = (last[0], 3, max(end, last[2]))
            else:
                out[i].append((start, 3, end))
    return [sorted(x) for x in out]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def scan(docs: DataFrame, cut: dict[tuple[int, int], int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and what was found in each row's whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of(batch.column(1).to_pylist(), cut)
            counts = [[sum(k == kind for _, k, _ in s) for s in found] for kind in range(4)]
            base = [hashlib.sha256(_joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
            cols = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols[:3], pa.array(base, pa.string()), pa.array([_joined(s) for s in found], pa.string()), cols[3]], names=[key, *(x.split()[0] for x in FOUND.split(", "))])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {FOUND}")


def redact(docs: DataFrame, cut: dict[tuple[int, int], int], text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``n_chars``, where there is one, follows the text."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(spans_of(texts, cut)):
                if spans:
                    parts, end = [], 0
                    for a, _, b in spans:
                        if a >= end:
                            parts += [texts[i][end:a], mark]
                        end = max(end, b)
                    texts[i] = "".join([*parts, texts[i][end:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Survey ``docs`` for the false-discovery threshold, then scan them."""
    return scan(docs, survey(docs, rate=rate))
