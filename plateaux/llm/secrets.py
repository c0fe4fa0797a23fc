"""Secret scans: rule-based finds, and tokens that pass a battery of randomness tests.

Three rules find assignments to secret-like names, access key ids and long hexadecimal runs. Besides, every run of at
least ``MIN_TOKEN`` characters of [A-Za-z0-9+/_=-], in rules' spans too, is cut at each = that is not padding at its end
(NAME=value); what has that many characters is a candidate, and so is each such part of it between - and _, or between +
and /, as values are joined to names and paths by them. A candidate's encoding is inferred from its characters (hex,
base32, letters, letters with digits, base62, base64); numbers and mixtures of no encoding are left alone. Its characters
become digits of that base, and three tests say how far they are from random: chi-squared uniformity over the alphabet,
runs above and below the middle, and lag-1 serial correlation. Their normal scores are squared and summed; a token drawn at
random has a small sum.

What sum structure gives is learned from the corpus: the letters and digits of every text, without its candidates, are cut
into strings of each of the bands' lengths (``BANDS``), all of them, which are judged by the same battery. A candidate's p-value is the share of
those strings of its band that look at least as random, so no tail of a distribution is assumed, however short the token.
Over all candidates of the corpus Benjamini-Hochberg then bounds, band by band, the share of structured tokens among those
that are reported as random at ``RATE``: short tokens, which structure imitates more often, need more evidence. Both sides
are histograms of a fixed size. Candidates reported are ``random`` spans where no rule's span and no longer one of them
covers them; ``n_confirmed`` counts those inside rules' spans.

Nulls: a null text is empty. Texts without finds give zero counts, the hash of the empty string and empty spans. Equal
finds and repeated rows stay, each at its place. A corpus too small to say that a token is no chance gives none. Very long
texts are scanned whole, the battery in slices. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, small_batches, stored, texts, utf8

# The rules of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 20
RATE = 0.01
BANDS = (20, 28, 40, 64, 128)
BINS, STEP = 800, 0.25  # of sums of squared scores
SLICE = 20_000  # strings judged at once

_TOKEN = byte_class([ord(c) for c in string.ascii_letters + string.digits + "+/_=-"])
_PLAIN = byte_class([ord(c) for c in string.ascii_letters + string.digits])
_HEX = byte_class([ord(c) for c in "0123456789abcdef"])
_JOINS = (re.compile(r"[^_-]+"), re.compile(r"[^+/]+"))
#: Alphabets by the kinds of characters that a token has (small, capital, digit, + or /, - or _).
_SMALL, _CAPITAL, _DIGIT, _PLUS, _DASH, _OTHER = 1, 2, 4, 8, 16, 32
ALPHABETS = (
    ("hex", string.digits + "abcdef"), ("HEX", string.digits + "ABCDEF"), ("base32", string.ascii_uppercase + "234567"),
    ("small", string.ascii_lowercase), ("capital", string.ascii_uppercase), ("lower", string.digits + string.ascii_lowercase), ("upper", string.digits + string.ascii_uppercase),
    ("letters", string.ascii_uppercase + string.ascii_lowercase), ("base62", string.ascii_uppercase + string.ascii_lowercase + string.digits),
    ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"), ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
)
_KIND = np.full(256, _OTHER, np.uint8)
for _letters, _k in ((string.ascii_lowercase, _SMALL), (string.ascii_uppercase, _CAPITAL), (string.digits, _DIGIT), ("+/", _PLUS), ("-_", _DASH)):
    _KIND[[ord(c) for c in _letters]] = _k
_SIZE = np.array([len(letters) for _, letters in ALPHABETS])
_HOLDS = np.zeros((len(ALPHABETS), 256), bool)
_CODE = np.zeros((len(ALPHABETS), 256), np.int64)
for _i, (_name, _letters) in enumerate(ALPHABETS):
    _HOLDS[_i, [ord(c) for c in _letters]] = True
    _CODE[_i, [ord(c) for c in _letters]] = np.arange(len(_letters))


def encodings(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first alphabet that holds all of each string (they start at ``at``), -1 for numbers and mixtures."""
    kinds = np.bitwise_or.reduceat(_KIND[flat], at)
    out = np.full(len(at), -1)
    for i in range(len(ALPHABETS) - 1, -1, -1):
        own = np.logical_and.reduceat(_HOLDS[i][flat], at)
        if i < 3:  # hex and base32 need a digit, or they are words
            own &= kinds & _DIGIT > 0
        out[own] = i
    out[kinds == _DIGIT] = -1
    return out


def randomness(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The battery's sum of squared scores for strings that lie one after another in ``flat``; infinite for those of no encoding."""
    n = np.diff(np.append(at, len(flat)))
    alphabet = encodings(flat, at)
    owner = np.repeat(np.arange(len(at)), n)
    code = _CODE[np.maximum(alphabet, 0)[owner], flat]
    base = _SIZE[np.maximum(alphabet, 0)].astype(float)
    counts = np.bincount(owner * 64 + code, minlength=64 * len(at)).reshape(-1, 64)
    chi = base / n * (counts**2).sum(1) - n
    df = base - 1
    uniform = (np.cbrt(np.maximum(chi, 0) / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))  # Wilson and Hilferty
    high = code >= base[owner] / 2
    inner = owner[1:] == owner[:-1]
    a = np.add.reduceat(high.astype(float), at)
    b = n - a
    runs = 1 + np.bincount(owner[1:], (high[1:] != high[:-1]) & inner, len(at))
    mean = 1 + 2 * a * b / n
    spread = np.maximum((mean - 1) * (mean - 2) / np.maximum(1, n - 1), 1e-9)
    in_runs = np.where(a * b > 0, (runs - mean) / np.sqrt(spread), np.sqrt(n))
    centred = code - (np.add.reduceat(code, at) / n)[owner]
    total = np.add.reduceat(centred**2, at)
    lag = np.bincount(owner[1:], centred[1:] * centred[:-1] * inner, len(at))
    serial = np.where(total > 0, (lag / np.maximum(total, 1e-9) + 1 / n) * np.sqrt(n), np.sqrt(n))
    return np.where(alphabet < 0, np.inf, np.maximum(uniform, 0) ** 2 + np.minimum(in_runs**2, 400) + np.minimum(serial**2, 400))


def judged(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bin of each string's sum, BINS for those of no encoding."""
    ends = np.append(at, len(flat))
    out = []
    for k in range(0, len(at), SLICE):
        low, high = at[k], ends[min(k + SLICE, len(at))]
        out.append(np.minimum(randomness(flat[low:high], at[k:k + SLICE] - low) / STEP, BINS).clip(0, BINS))
    bins = np.concatenate(out) if out else np.zeros(0)
    return np.where(bins >= BINS, BINS, np.minimum(bins, BINS - 1)).astype(np.int32)


def band_of(length: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BANDS), length, "right") - 1


def parts(run: str) -> list[tuple[int, int]]:
    """Starts and ends of what is tested of a run: values between = signs, and their parts between joining characters."""
    out = set()
    body = run.rstrip("=")
    for m in re.finditer("[^=]+", body):
        end = len(run) if m.end() == len(body) else m.end()
        out.add((m.start(), end))
        for joined in _JOINS:
            out |= {(m.start() + j.start(), end if j.end() == len(m[0]) else m.start() + j.end()) for j in joined.finditer(m[0])}
    return sorted(x for x in out if x[1] - x[0] >= MIN_TOKEN)


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of maximal runs within one document."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    keep = (np.diff(cut) >= least) & mask[cut[:-1]] if len(mask) else np.zeros(0, bool)
    return cut[:-1][keep], cut[1:][keep]


def structured(docs: DataFrame) -> DataFrame:
    """How many strings of the texts' own letters and digits fall into each bin: band, bin, n."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = utf8(b.column(0))
            plain = _PLAIN[data]
            for i, j in zip(*(x.tolist() for x in _runs(_TOKEN[data], offsets, MIN_TOKEN)), strict=True):
                plain[i:j] = False
            kept = data[plain]
            at = np.concatenate([[0], np.cumsum(plain)])[offsets]
            length = np.diff(at)
            counts = np.zeros((len(BANDS), BINS + 1), np.int64)
            for band, size in enumerate(BANDS):  # every text gives strings of every length
                n = length // size
                owner = np.repeat(np.arange(len(n)), n)
                start = at[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * size
                for k in range(0, len(start), SLICE):
                    own = start[k:k + SLICE]
                    place = (own[:, None] + np.arange(size)).ravel()
                    counts[band] += np.bincount(judged(kept[place], np.arange(len(own)) * size), minlength=BINS + 1)
            row, col = np.nonzero(counts)
            yield pa.record_batch([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(counts[row, col])], names=["band", "bin", "n"])

    return texts(docs).mapInArrow(run, "band int, bin int, n long").groupBy("band", "bin").agg(F.sum("n").alias("n"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the rules' spans, and candidates with the bins of their sums."""
    def run(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        guess = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("bin", pa.int32()), ("ruled", pa.bool_())])
        for b in batches:
            data, offsets = utf8(b.column(1))
            base: list[list] = [[] for _ in range(b.num_rows)]
            more: list[list] = [[] for _ in range(b.num_rows)]
            place = lambda i, d: i - int(offsets[d]) - int(np.count_nonzero((data[offsets[d]:i] & 0xC0) == 0x80))
            starts, ends = _runs(_HEX[data], offsets, MIN_HEX)
            for i, j, d in zip(starts.tolist(), ends.tolist(), (np.searchsorted(offsets, starts, "right") - 1).tolist(), strict=True):
                start = place(i, d)
                base[d].append({"start": start, "kind": 2, "end": start + j - i})
            # a rule's literal can only stand where its rarest byte does
            signs = np.searchsorted(offsets, np.flatnonzero((data == 58) | (data == 61)), "right") - 1
            keys = np.searchsorted(offsets, np.flatnonzero(data == 75), "right") - 1
            signs, keys = set(np.unique(signs).tolist()), set(np.unique(keys).tolist())
            for d in signs | keys:
                text = data[offsets[d]:offsets[d + 1]].tobytes().decode()
                if d in signs:
                    base[d] += [{"start": m.start(), "kind": 0, "end": m.end()} for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
                if d in keys and "AKIA" in text:
                    base[d] += [{"start": m.start(), "kind": 1, "end": m.end()} for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
            found = []
            starts, ends = _runs(_TOKEN[data], offsets, MIN_TOKEN)
            for i, j, d in zip(starts.tolist(), ends.tolist(), (np.searchsorted(offsets, starts, "right") - 1).tolist(), strict=True):
                token, start = data[i:j].tobytes().decode(), place(i, d)
                for x, y in parts(token):
                    found.append((d, start + x, start + y, token[x:y].rstrip("=")))
            bodies = [f[3].encode() for f in found]
            size = np.array([len(x) for x in bodies], np.int64)
            bins = judged(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(size) - size)
            for (d, x, y, body), bin_ in zip(found, bins.tolist(), strict=True):
                if bin_ < BINS and len(body) >= BANDS[0]:
                    more[d].append({"start": x, "end": y, "band": int(band_of(len(body))), "bin": bin_, "ruled": any(s["start"] <= x and y <= s["end"] for s in base[d])})
            names, counts = [], []
            for spans in base:
                spans.sort(key=lambda s: (s["start"], s["kind"]))
                names.append(hashlib.sha256(",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans).encode()).hexdigest())
                counts.append([sum(s["kind"] == k for s in spans) for k in range(3)])
            per = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.record_batch([b.column(0), *(pa.array(per[:, k]) for k in range(3)), pa.array(names), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(guess))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"])

    span = "array<struct<start:long,kind:int,end:long>>"
    guess = "array<struct<start:long,end:long,band:int,bin:int,ruled:boolean>>"
    return texts(docs, "doc_id").mapInArrow(run, f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base {span}, candidates {guess}")


def limits(null: np.ndarray, tested: np.ndarray, rate: float) -> list[int]:
    """For each band the first bin that is not reported (0: none), by Benjamini-Hochberg on the null's tail shares."""
    out = []
    for expected, found in zip(null, tested, strict=True):
        p = (1 + np.cumsum(expected)[:BINS]) / (1 + expected.sum())
        at_most = np.cumsum(found)[:BINS]
        good = np.flatnonzero((at_most > 0) & (p * found[:BINS].sum() <= rate * at_most))
        out.append(int(good[-1]) + 1 if len(good) else 0)
    return out


def _histogram(counted: DataFrame) -> np.ndarray:
    out = np.zeros((len(BANDS), BINS + 1), np.int64)
    for r in counted.collect():  # at most bands times bins
        out[r["band"], r["bin"]] = r["n"]
    return out


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, n_confirmed."""
    small_batches(docs.sparkSession)
    found = stored(scan(docs), "secrets")
    tested = found.select(F.explode("candidates").alias("c")).groupBy("c.band", "c.bin").agg(F.count("*").alias("n"))
    first = F.array(*map(F.lit, limits(_histogram(structured(docs)), _histogram(tested), rate)))
    passed = F.filter("candidates", lambda c: c["bin"] < F.element_at(first, c["band"] + 1))
    covers = lambda c, o: (o["start"] <= c["start"]) & (o["end"] >= c["end"]) & (o["end"] - o["start"] > c["end"] - c["start"])
    widest = F.filter("passed", lambda c: ~c["ruled"] & ~F.exists("passed", lambda o: ~o["ruled"] & covers(c, o)))
    random = F.transform(widest, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    kinds = F.array(*map(F.lit, KINDS))
    every = F.array_sort(F.concat("base", random))
    spans = F.transform(every, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]))
    confirmed = F.size(F.filter("passed", lambda c: c["ruled"])).cast("long")
    out = found.withColumn("passed", passed)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"), F.size(random).cast("long").alias("n_random"), confirmed.alias("n_confirmed"))
