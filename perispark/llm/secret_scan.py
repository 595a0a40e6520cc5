"""Secret scans: fixed patterns, and a battery of randomness tests over other strings.

A candidate is a run of 16 or more of ``A-Za-z0-9+/_=-``. Its encoding is the smallest
alphabet that holds its letters: digits, hex, one letter case, base32, base36, base62,
base64; dashes and underscores between letters of one case are layout, as in a UUID.
Against the alphabet it takes three tests: chi-squared for uniform use, runs above and
below the median, serial correlation at lag one; Fisher's method joins their p-values,
and a run that isn't uniform fails.

What passes is weighed against text: e = P(run | uniform over a random encoding) / P(run |
letters of the corpus), with the corpus's pair frequencies outside candidates. By Markov's
inequality 1/e is a p-value under "this is text", which falls with length as it should;
words, numbers and paths get an e below one. The e-values of all candidates of all
documents go through Benjamini and Hochberg's rule, so the share of text among what is
reported stays below ``fdr``. A run of e below one can't be reported at any threshold, so
it counts as a candidate but doesn't take the battery.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import list_array, slices, small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_MARKS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.zeros(256, np.int64)
CODE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(1, len(LETTERS) + 1)
SIZE = len(LETTERS) + 1
UPPER_CASE, LOWER_CASE, DIGITS = LETTERS[:26], LETTERS[26:52], LETTERS[52:62]
#: Alphabets from the smallest; the first that holds all letters of a run is its encoding.
ENCODINGS = (
    ("digits", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("hex", DIGITS + "ABCDEF"),
    ("lower", LOWER_CASE),
    ("upper", UPPER_CASE),
    ("base32", UPPER_CASE + "234567"),
    ("base32", LOWER_CASE + "234567"),
    ("base36", LOWER_CASE + DIGITS),
    ("base36", UPPER_CASE + DIGITS),
    ("base62", LETTERS[:62]),
    ("base64", LETTERS[:64]),
    ("base64", LETTERS[:62] + "_-"),
)
ALPHABETS = tuple((name, letters, frozenset(letters)) for name, letters in ENCODINGS)
LAYOUT = str.maketrans("", "", "-_=")
#: Bins of ln e in the histogram that sets the false-discovery threshold.
TOP = 4096

Span = tuple[int, int, str]
SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def base_spans(text: str) -> list[Span]:
    """Spans of the three fixed patterns: leftmost, not overlapping within a kind."""
    found: list[Span] = []
    low = text.lower()
    if any(m in low for m in ASSIGN_MARKS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in RUN.finditer(text):
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text, run.start(), run.end()) if m.end() - m.start() >= 16]
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def encoding(run: str) -> tuple[str, str, str] | None:
    """The run's encoding, its alphabet, and the letters to test: without padding, and
    without dashes and underscores where the others are of one case."""
    shown = frozenset(run) - {"="}
    plain = shown - {"-", "_"}
    for name, letters, every in ALPHABETS[:9]:
        if plain <= every:
            return name, letters, run.translate(LAYOUT)
    for name, letters, every in ALPHABETS[9:]:
        if shown <= every:
            return name, letters, run.rstrip("=")
    return None


def _upper_tail(chi2: float, df: float) -> float:
    """P(chi-squared with df degrees > chi2), by Wilson and Hilferty's normal approximation."""
    z = ((max(chi2, 1e-12) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str, letters: str) -> float:
    """Fisher's joint p-value of the three tests, under "letters drawn uniformly"."""
    x = np.array([letters.find(c) for c in run])
    x = x[x >= 0]
    n, size = len(x), len(letters)
    if n < 8:
        return 1.0
    counts = np.bincount(x, minlength=size)
    uniform = _upper_tail(float(((counts - n / size) ** 2).sum() * size / n), size - 1)
    above = x >= size / 2
    a, b = int(above.sum()), int(n - above.sum())
    runs = 1.0
    if a and b:
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = math.erfc(abs(1 + int((above[1:] != above[:-1]).sum()) - mean) / math.sqrt(2 * var))
    else:
        runs = 2.0 ** (1 - n)
    spread = float(((x - x.mean()) ** 2).sum())
    serial = (math.erfc(abs(float(((x[1:] - x.mean()) * (x[:-1] - x.mean())).sum()) / spread * math.sqrt(n)) / math.sqrt(2)) if spread
        else 0.0)
    return _upper_tail(-2 * sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial)), 6)


def weights(runs: list[str], kinds: list[tuple[str, str, str] | None], logs: np.ndarray) -> np.ndarray:
    """ln e of each run; logs: ln P(letter | letter before), over CODE. The uniform side draws an
    encoding, then each character from its alphabet and one more for layout."""
    codes = CODE[np.frombuffer(" ".join(runs).encode(), np.uint8)]
    text = logs[np.concatenate(([0], codes[:-1])), codes]
    lengths = np.array([len(r) for r in runs])
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    sums = np.concatenate(([0.0], np.cumsum(np.where(codes > 0, text, 0.0))))
    sizes = np.array([len(k[1]) + 1 if k else 1 << 20 for k in kinds])
    return -lengths * np.log(sizes) - math.log(len(ENCODINGS)) - (sums[starts + lengths] - sums[starts])


def candidates(text: str, logs: np.ndarray, alpha: float) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of candidates, and start, end and ln e of those with e above one that pass the battery."""
    places = [m.span() for m in RUN.finditer(text)]
    if not places:
        return 0, []
    runs = [text[s:e] for s, e in places]
    kinds = [encoding(r) for r in runs]
    e = weights(runs, kinds, logs)
    found = [(*places[i], float(e[i])) for i in np.flatnonzero(e > 0) if kinds[i] and battery(kinds[i][2], kinds[i][1]) >= alpha]
    return sum(k is not None for k in kinds), found


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE * SIZE, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            # what may be encoded doesn't belong to the model of text
            raw = RUN.sub(" ", text or "").encode("utf-8", "surrogatepass")
            for lo in range(0, len(raw), 1 << 20):
                codes = CODE[np.frombuffer(raw[max(0, lo - 1) : lo + (1 << 20)], np.uint8)]
                total += np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)
    keys = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["pair", "n"])


def _bins(batches: Iterator[pa.RecordBatch], logs: np.ndarray, alpha: float) -> Iterator[pa.RecordBatch]:
    """How many candidates have each ln e; bin 0 holds those that can't be reported."""
    total = np.zeros(TOP + 1, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n, found = candidates(text or "", logs, alpha)
            total[0] += n - len(found)
            for _, _, e in found:
                total[min(TOP, int(e * 8))] += 1
    keys = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["bin", "n"])


def threshold(bins: dict[int, int], fdr: float) -> float:
    """Least ln e to report: the largest k with e(k) >= m / (k fdr)."""
    m, k, least = sum(bins.values()), 0, math.inf
    for b in sorted((b for b in bins if b), reverse=True):
        k += bins[b]
        if b / 8 >= math.log(m / (k * fdr)):
            least = b / 8
    return least


def outside(start: int, end: int, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of start to end that the taken spans, in order of their starts, leave."""
    for s, e, _ in taken:
        if s >= end:
            break
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def spans(text: str, logs: np.ndarray, alpha: float, least: float) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order: the method adds what base spans leave of its runs."""
    base = base_spans(text)
    more = [(s, e, "random") for lo, hi, x in candidates(text, logs, alpha)[1] if x >= least for s, e in outside(lo, hi, base)]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def _span_lists(rows: list[list[Span]]) -> pa.Array:
    flat = [x for r in rows for x in r]
    kinds = (pa.int64(), pa.int64(), pa.string())
    struct = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate(kinds)], ["start", "end", "kind"])
    return list_array(struct, np.concatenate(([0], np.cumsum([len(r) for r in rows]))))


def find_secrets(docs: DataFrame, *, text_col: str = "text", alpha: float = 1e-3, fdr: float = 0.01) -> DataFrame:
    """docs with the added column ``secrets``: struct(base, spans), arrays of struct(start, end, kind).

    Starts and ends are code points, ends exclusive. Each row is judged alone but for the
    corpus's letter pairs and the threshold, so repeated rows give repeated results; null
    and empty texts have no spans; an empty table gives no rows. An existing column named
    secrets is replaced; other columns stay as they are.

    Scale: three scans of the text and no shuffle of it; what is shuffled and brought to
    the driver is a table of letter pairs and one of bins, of fixed size.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    pairs = np.zeros(SIZE * SIZE)
    for r in text.mapInArrow(_pair_counts, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    pairs = pairs.reshape(SIZE, SIZE)[:, 1:]
    alone = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * len(LETTERS))
    logs = np.zeros((SIZE, SIZE))
    logs[:, 1:] = np.log((pairs + 10 * alone) / (pairs.sum(axis=1, keepdims=True) + 10))  # rare letters' rows lean on all
    binned = text.mapInArrow(lambda it: _bins(it, logs, alpha), "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    bins = {r.bin: r.n for r in binned.collect()}
    least = threshold(bins, fdr)


    @F.arrow_udf(f"base {SPANS}, spans {SPANS}")
    def found(texts: pa.Array) -> pa.Array:
        rows = [spans(t or "", logs, alpha, least) for part in slices(texts) for t in texts[part].to_pylist()]
        return pa.StructArray.from_arrays([_span_lists([r[i] for r in rows]) for i in (0, 1)], ["base", "spans"])

    return docs.withColumn("secrets", found(F.col(text_col).cast("string")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of find_secrets(): counts by kind, the base's hash, all spans as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, shown), ",")
    count = lambda k: F.size(F.filter("secrets.base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col(id_col), count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.col("secrets.base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets.spans")).alias("spans"),
    )


def cut(text: str | None, found: list[dict] | None, mark: str) -> str | None:
    if text is None or not found:
        return text
    parts, at = [], 0
    for s, e in sorted((x["start"], x["end"]) for x in found):
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join(parts) + text[at:]


def redact(found: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """find_secrets() rows with each run of overlapping spans replaced by the mark; drops the spans."""

    @F.arrow_udf("string")
    def redacted(texts: pa.Array, every: pa.Array) -> pa.Array:
        return pa.chunked_array(
            [
                pa.array([cut(t, x, mark) for t, x in zip(texts[part].to_pylist(), every[part].to_pylist(), strict=True)], pa.string())
                for part in slices(texts)
            ],
            pa.string(),
        ).combine_chunks()

    return found.withColumn(text_col, redacted(F.col(text_col).cast("string"), F.col("secrets.spans"))).drop("secrets")
