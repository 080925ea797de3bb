"""Operator 5, secret scan: fixed patterns, and a randomness battery with false-discovery control.

Base spans come from three patterns. Further candidates are runs of CANDIDATE characters that no base
span touches and that look like an encoding (digits mixed with letters); the encoding is the smallest
alphabet that holds the run. '=' only ends a run, as padding, so the value of NAME=value is a run of its own.
A run that no alphabet holds is cut: at the characters that base64 lacks, and at those that
base64url lacks; the parts of LEAST characters or more
are candidates, so two of one run may overlap.

What is controlled is the share of false spans among those reported, so the hypothesis to be rejected is that a
candidate is natural: an identifier made of words. Three tests look at it, given how letters occur
in all documents (`Natural`, counted over the whole corpus): chi-squared evenness of its letters over those of its encoding, which
is lower the more random they are; runs of character classes, of which a random string has more; and the
serial correlation of vowels and consonants, which alternate in words. Each test's score is weighted by
the root of what it has counted; their sum gives the candidate's p-value. A candidate that isn't even in its own alphabet, or whose runs or serial
correlation differ from chance there (`battery`, at GUARD), has p-value 1. Within each length
stratum the Benjamini-Hochberg step-up over all candidates of the corpus reports those that it
rejects. p-values are rounded up to a fixed grid, so the step-up needs one count for each
stratum and grid point, whatever the number of candidates: that table is bounded by STRATA x GRID.

Defined results: a null text counts as empty: no spans, base_sha256 of the empty string; rows are
kept one by one, whatever doc_id they have; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table
from .token_output import pieces

# The base patterns of the contract; letters of `assign` count in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:=+(?![A-Za-z0-9+/_=-]))?" % LEAST)
#: The parts of a run that joins '_' or '-' with '+' or '/'.
PARTS = (re.compile(r"[A-Za-z0-9+/]{%d,}=*" % LEAST), re.compile(r"[A-Za-z0-9_-]{%d,}=*" % LEAST))
#: Encodings from the smallest alphabet up; each needs a digit, and a letter where it has letters.
ALPHABETS = (
    ("hex", "0123456789abcdef"), ("hexupper", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("base36upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_CODES = [(a, {c: i for i, c in enumerate(a)}, re.compile(f"[{re.escape(a)}]+")) for name, a in ALPHABETS]
#: The lower ends of the length strata.
STRATA = (20, 24, 32, 40, 64, 128, 512)
#: The share of false spans among the reported ones that is allowed for, in each stratum.
ALPHA = 0.05
#: Below this p-value a candidate isn't random in its own alphabet.
GUARD = 0.001
#: The grid of -log10 p: steps of 0.01 up to 40; p-values are rounded up to it.
GRID = 4000


# Per cent of English letters from a to z; they count as PRIOR_LETTERS letters beside the corpus's own.
ENGLISH = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
PRIOR_LETTERS, PRIOR_TURNS, PRIOR_LENGTH = 5000, 0.68, 4.7
VOWELS = "aeiouy"
_PAIRS, _TURNS, _WORDS = 26, 27, 28
_NORMAL = NormalDist()


@dataclass(frozen=True)
class Natural:
    """How words of the corpus are: shares of the letters, how often neighbours differ as vowel and consonant, mean length."""

    letters: tuple[float, ...]
    turns: float
    length: float

    @classmethod
    def of(cls, counts: dict[int, int]) -> Natural:
        total = PRIOR_LETTERS + sum(counts.get(k, 0) for k in range(26))
        words = PRIOR_LETTERS / PRIOR_LENGTH
        pairs = PRIOR_LETTERS - words
        english = [x / sum(ENGLISH) for x in ENGLISH]
        letters = tuple((PRIOR_LETTERS * x + counts.get(k, 0)) / total for k, x in enumerate(english))
        return cls(letters, (PRIOR_TURNS * pairs + counts.get(_TURNS, 0)) / (pairs + counts.get(_PAIRS, 0)), total / (words + counts.get(_WORDS, 0)))


def learn(docs: DataFrame) -> Natural:
    """Letters, neighbours and words (runs of ASCII letters) of all documents, but for what is long enough for a candidate; 29 rows reach the driver."""
    vowel, of_run = np.zeros(256, bool), np.zeros(256, bool)
    vowel[list(VOWELS.encode())] = True
    of_run[list(f"{string.ascii_letters}{string.digits}+/_-".encode())] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(29, np.int64)
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                texts = part.column("text").drop_null()
                joined_ = np.frombuffer(b" ".join(x.as_buffer().to_pybytes() for x in texts), np.uint8)
                low = joined_ | 32
                # where runs of a candidate's characters begin and end
                steps = np.flatnonzero(np.diff(np.concatenate([[False], of_run[joined_], [False]]).astype(np.int8)))
                begin, end = steps[::2], steps[1::2]
                short = np.ones(len(joined_), bool)
                for a, b in zip(begin[end - begin >= LEAST], end[end - begin >= LEAST]):
                    short[a:b] = False
                letter = (low >= 97) & (low <= 122) & short
                total[:26] += np.bincount(low[letter] - 97, minlength=26)
                if len(low):
                    both = letter[1:] & letter[:-1]
                    v = vowel[low]
                    total[_PAIRS] += both.sum()
                    total[_TURNS] += (both & (v[1:] != v[:-1])).sum()
                    total[_WORDS] += letter.sum() - both.sum()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["cell", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return Natural.of({r["cell"]: r["n"] for r in rows})


def _at_least(hits: int, n: int, p: float) -> float:
    """P(binomial(n, p) >= hits); beyond 400 trials by the normal distribution."""
    if hits <= 0:
        return 1.0
    if n > 400:
        return 0.5 * math.erfc((hits - 0.5 - n * p) / math.sqrt(2 * n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(hits, n + 1)))


def _score(p: float) -> float:
    return -_NORMAL.inv_cdf(min(1 - 1e-12, max(1e-12, p)))


def natural_p(body: str, alphabet: str, natural: Natural) -> float:
    """The p-value of the hypothesis that the run is made of natural words: small if it is more like chance."""
    codes = [ord(c) - 97 for c in body.lower() if "a" <= c <= "z"]
    n, tests = len(codes), []
    held = sorted({ord(c) - 97 for c in alphabet.lower() if "a" <= c <= "z"})
    if n >= 4:
        q = np.array([natural.letters[i] for i in held])
        q = q / q.sum()
        s2, s3, k = float((q**2).sum()), float((q**3).sum()), len(held)
        chi = float((np.bincount(codes, minlength=26) ** 2).sum()) * k / n - n
        mean = k * (1 - s2) + n * (k * s2 - 1)
        var = 2 * (n - 1) / n * k * k * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
        # a scaled chi-squared of that mean and variance, after Wilson and Hilferty
        degrees = 2 * mean * mean / var
        tests.append((n, -((max(chi, 0.0) / mean) ** (1 / 3) - (1 - 2 / (9 * degrees))) / math.sqrt(2 / (9 * degrees))))
    kinds = ["lu"[c.isupper()] if c.isalpha() else "d" if c.isdigit() else "s" for c in body]
    changes = sum(x != y for x, y in zip(kinds, kinds[1:]))
    mixed = any(c.islower() for c in alphabet) and any(c.isupper() for c in alphabet)
    tests.append((len(body) - 1, _score(_at_least(changes, len(body) - 1, min(0.8, (2 if mixed else 1) / natural.length)))))
    pairs = [(x in VOWELS) != (y in VOWELS) for x, y in zip(body.lower(), body.lower()[1:]) if "a" <= x <= "z" and "a" <= y <= "z"]
    if pairs:
        tests.append((len(pairs), _score(_at_least(len(pairs) - sum(pairs), len(pairs), 1 - natural.turns))))
    z = sum(math.sqrt(w) * x for w, x in tests) / math.sqrt(sum(w for w, _ in tests))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: float) -> float:
    """P(chi-squared with k degrees >= x), after Wilson and Hilferty."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(codes: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of evenness, runs and serial correlation of codes in range(size)."""
    n = len(codes)
    counts = np.bincount(codes, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    mean, var = size - 1.0, 2.0 * (size - 1) * (1 - 1 / n)
    # a chi-squared with the exact mean and variance of the statistic, scaled
    scale, degrees = var / (2 * mean), 2 * mean * mean / var
    even = _chi_tail(chi / scale, degrees)
    high = codes >= size / 2
    a, b = int(high.sum()), n - int(high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mu = 1 + 2 * a * b / n
        spread = (mu - 1) * (mu - 2) / (n - 1)
        run = _normal_tail((runs - mu) / math.sqrt(spread)) if spread > 0 else 0.0
    else:
        run = 2.0 ** (1 - n)
    x = codes - codes.mean()
    total = float((x * x).sum())
    serial = _normal_tail((float((x[1:] * x[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
    return even, run, serial


def infer(run: str) -> tuple[np.ndarray, str] | None:
    """Codes and alphabet of the run's encoding; none if it isn't like one."""
    body = run.rstrip("=")
    if len(body) < LEAST or not any(c.isdigit() for c in body) or body.isdigit():
        return None
    for alphabet, codes, whole in _CODES:
        if whole.fullmatch(body):
            return np.array([codes[c] for c in body]), alphabet
    return None


def grid_of(p: float) -> int:
    """The grid point at or below -log10 p."""
    return GRID if p <= 10 ** (-GRID / 100) else int(-math.log10(min(1.0, p)) * 100)


def stratum_of(n: int) -> int:
    return max(k for k, least in enumerate(STRATA) if n >= least)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run: all of it, or its parts of both kinds where it mixes their characters."""
    if not (("_" in run or "-" in run) and ("+" in run or "/" in run)):
        return [(0, len(run))]
    return sorted({m.span() for p in PARTS for m in p.finditer(run)})


def p_value(run: str, codes: np.ndarray, alphabet: str, natural: Natural) -> float:
    """1 if the run isn't random in its alphabet, else how well it goes with natural words."""
    if min(1.0, 3 * min(battery(codes, len(alphabet)))) < GUARD:
        return 1.0
    return natural_p(run.rstrip("="), alphabet, natural)


def candidates(text: str, base: list[tuple[int, int, int]], natural: Natural) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, grid point) of the runs that are tested."""
    out = []
    for m in CANDIDATE.finditer(text):
        for a, b in parts(m[0]):
            run = m[0][a:b]
            known = infer(run)
            a, b = m.start() + a, m.start() + b
            if known is None or any(s < b and a < e for s, _, e in base):
                continue
            out.append((a, b, stratum_of(len(known[0])), grid_of(p_value(run, *known, natural))))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base string, tested array<struct<start:int,end:int,stratum:int,point:int>>"


def find(docs: DataFrame, natural: Natural) -> DataFrame:
    """Base spans and tested candidates of each document."""
    tested = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "stratum", "point")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                kinds = Counter(k for _, k, _ in base)
                rows.append((kinds[0], kinds[1], kinds[2], joined(base), [dict(zip(("start", "end", "stratum", "point"), c)) for c in candidates(text, base, natural)]))
            n, a, h, b, c = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, a, h)), pa.array(b, pa.string()), pa.array(c, tested)], ["doc_id", "n_assign", "n_access", "n_hex", "base", "tested"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)


def rejected_from(counts: dict[tuple[int, int], int], alpha: float = ALPHA) -> list[int]:
    """For each stratum the least grid point that the step-up rejects (GRID + 1: none)."""
    out = []
    for s in range(len(STRATA)):
        points = sorted((p for k, p in counts if k == s), reverse=True)
        total, passed, least = sum(counts[s, p] for p in points), 0, GRID + 1
        for p in points:
            passed += counts[s, p]
            if 10 ** (-p / 100) <= alpha * passed / total:
                least = p
        out.append(least)
    return out


def scan(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of each document."""
    found = stage(find(docs, learn(docs)), "secrets")
    # at most one row for each stratum and grid point
    rows = found.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.point").count().collect()
    least = rejected_from({(r["stratum"], r["point"]): r["count"] for r in rows}, alpha)
    limit = F.array(*map(F.lit, least))
    kept = F.filter("tested", lambda t: t["point"] >= F.get(limit, t["stratum"]))
    entry = lambda start, kind, text: F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), text.alias("span"))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: entry(F.split(x, ":")[1], F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]) - 1, x))
    random = F.transform("kept", lambda t: entry(t["start"], F.lit(len(KINDS) - 1), F.concat_ws(":", F.lit(KINDS[-1]), t["start"].cast("string"), t["end"].cast("string"))))
    spans = F.concat_ws(",", F.transform(F.array_sort(F.concat(base, random)), lambda x: x["span"]))
    return found.withColumn("kept", kept).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.size("kept").cast("long").alias("n_random"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def digest_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
