"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary and one on toxic text.

A window that holds toxic text compresses shorter with the toxic dictionary. Windows are about WINDOW bytes in lower case, ended
at a space. Both dictionaries are made by zstandard's trainer. That for ordinary text gets windows of ordinary documents. Labels
are given for whole documents, most of whose windows are ordinary, and a trainer that gets all windows of toxic documents keeps
mostly what these share with others. So windows are labelled first: a stretch of GRAM bytes tells if the share of toxic
documents that have it exceeds that of ordinary ones with a log-likelihood ratio of at least EVIDENCE times the largest one, and
the toxic trainer gets those parts of toxic documents' windows that telling stretches cover. In use, the toxic dictionary is
followed by the ordinary one, so that both give ordinary windows the same length.

Thresholds for the difference of a window's two lengths are calibrated on ordinary documents: the smallest differences
that no more than each of RATES of their windows reach. A document's features are the numbers and shares of windows that reach
each threshold, and the mean difference; a logistic regression, fitted to the sample, calibrates them for the root of the
labels' odds, between even odds and those, so that 0.5 is the threshold of a document.

The model is fitted on the driver to a sample of whole texts, at most SAMPLE labelled documents a class; near copies count once. Fewer
are taken if they have more than SAMPLE times SAMPLE_CHARS characters together, but one at least. The trainer gets at most
TRAINING_WINDOWS of their windows, drawn at random. Scoring reads every window of every whole text.

Defined cases: null and empty texts have no window and get the score that the regression gives to no hits; repeated rows are
scored each by itself; a row without an id isn't held out; an empty table gives an empty table; without labels of both classes
every score is 0. Columns other than the named ones are neither read nor returned by score_documents().
"""

from __future__ import annotations

import math
import random
import struct
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescape.llm.shared import per_slice, per_text

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
FOLDS, HELD_OUT = 5, 0
SAMPLE, SAMPLE_CHARS = 1000, 10_000
WINDOW, LEVEL = 64, 7
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
TRAINING_WINDOWS = 30_000
#: Bytes of a telling stretch (64 bits), the least log-likelihood ratio and its share of the largest one, and the least share of toxic documents.
GRAM, LEAST, EVIDENCE, SHARE = 8, 12.0, 0.05, 0.01
RATES = (0.1, 0.03, 0.01, 0.003, 0.001)
#: What ends the header of a trained dictionary (its repeat offsets); the content follows.
HEADER_END = struct.pack("<3I", 1, 4, 8)


def held_out(key: str = "doc_id") -> F.Column:
    """True for the documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def windows(text: str) -> list[bytes]:
    data = text.lower().encode()
    out, at, n = [], 0, len(data)
    while at < n:
        end = at + WINDOW
        if end < n:
            space = data.find(b" ", end, end + WINDOW)
            end = space if space >= 0 else end
        out.append(b" " + data[at:end].strip())
        at = end
    return out


def one_of_each(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones: those that share the smallest hash of five words count as copies."""
    seen: dict[int, str] = {}
    for t in texts:
        words = t.split()
        seen.setdefault(min((zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0), t)
    return list(seen.values())


def grams(data: bytes) -> np.ndarray:
    """Each GRAM bytes in a row as a number."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = max(0, len(b) - GRAM + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | b[k : k + n]
    return out


def log_likelihood_ratio(x: np.ndarray, m: int, y: np.ndarray, n: int) -> np.ndarray:
    """For x of m and y of n how much better two shares describe both than one; 0 where the first share isn't the larger one."""

    def part(k, of, share):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / of / share), 0) + np.where(k < of, (of - k) * np.log((1 - k / of) / (1 - share)), 0)

    share = (x + y) / (m + n)
    return np.where(x / m > y / n, 2 * (part(x, m, share) + part(y, n, share)), 0)


def telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> np.ndarray:
    """The stretches, in ascending order, that set the windows of toxic documents apart."""
    of = lambda windows: np.unique(np.concatenate([grams(w) for w in windows] or [np.empty(0, dtype=np.uint64)]))
    found, x = np.unique(np.concatenate([of(doc) for doc in toxic]), return_counts=True)
    found, x = (v[x >= max(3, SHARE * len(toxic))] for v in (found, x))
    y = np.zeros(len(found), dtype=np.int64)
    for doc in ordinary:
        y += np.isin(found, of(doc), assume_unique=True)
    ratio = log_likelihood_ratio(x, len(toxic), y, len(ordinary))
    return found[ratio >= max(LEAST, EVIDENCE * ratio.max(initial=0.0))]


def told(window: bytes, stretches: np.ndarray) -> list[bytes]:
    """The parts of a window that telling stretches cover; those that overlap or touch are one."""
    at = np.flatnonzero(np.isin(grams(window), stretches))
    parts = np.split(at, np.flatnonzero(np.diff(at) > GRAM) + 1) if len(at) else []
    return [window[p[0] : p[-1] + GRAM] for p in parts]


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of the dictionary that zstandard's trainer makes of samples; of too few of them, the samples themselves."""
    samples = random.Random(0).sample(samples, min(len(samples), TRAINING_WINDOWS))
    try:
        made = zstandard.train_dictionary(size, samples, k=32, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]
    _, end, content = made.partition(HEADER_END)
    return content if end else made


class Model:
    """Both dictionaries, the thresholds and the regression; plain values, so that it can be sent to the executors."""

    def __init__(self, ordinary: bytes, toxic: bytes, thresholds: tuple[int, ...] = (), weights: tuple[float, ...] = ()):
        self.ordinary, self.toxic, self.thresholds, self.weights = ordinary, toxic, thresholds, weights
        self.compress = None

    def __reduce__(self):
        return Model, (self.ordinary, self.toxic, self.thresholds, self.weights)

    def compressors(self):
        if self.compress is None:
            self.compress = []
            for data in (self.ordinary, self.toxic + self.ordinary):
                d = zstandard.ZstdCompressionDict(data or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
                self.compress.append(made.compress)
        return self.compress

    def differences(self, text: str) -> np.ndarray:
        """Bytes saved by the toxic dictionary in each window."""
        plain, toxic = self.compressors()
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], dtype=np.int64)

    def features(self, differences: np.ndarray) -> np.ndarray:
        hits = [(differences >= t).sum() for t in self.thresholds]
        n = max(1, len(differences))
        return np.array([*(math.log1p(h) for h in hits), *(10 * h / n for h in hits), differences.sum() / n, 1.0])

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        x = float(np.dot(self.features(self.differences(text)), self.weights))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression with both classes weighing the same, by Newton's method."""
    w, each = np.zeros(x.shape[1]), np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (each * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (each * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrated(differences: np.ndarray) -> tuple[int, ...]:
    """For each of RATES the smallest difference, of 1 at least, that no more than that share of these reach."""
    ordered = np.sort(differences)[::-1]
    return tuple(max(1, int(ordered[int(rate * len(ordered))]) + 1) if len(ordered) else 1 for rate in RATES)


def fit(toxic: list[str], ordinary: list[str], odds: float = 1.0) -> Model:
    """A model of labelled texts, odds being those of the toxic label; all scores are 0 if a class has none."""
    toxic, ordinary = one_of_each(toxic), one_of_each(ordinary)
    if not toxic or not ordinary:
        return Model(b"", b"")
    cut = [[windows(t) for t in texts] for texts in (toxic, ordinary)]
    stretches = telling(*cut)
    parts = [part for doc in cut[0] for w in doc for part in told(w, stretches)]
    model = Model(trained(list(dict.fromkeys(w for doc in cut[1] for w in doc)), ORDINARY_BYTES), trained(parts, TOXIC_BYTES))
    differences = [[model.differences(t) for t in texts] for texts in (toxic, ordinary)]
    model.thresholds = calibrated(np.concatenate(differences[1]))
    x = np.array([model.features(d) for of in differences for d in of])
    y = np.array([1] * len(toxic) + [0] * len(ordinary))
    *weights, constant = regression(x, y).tolist()  # for even odds
    model.weights = (*weights, constant + math.log(odds) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model of at most SAMPLE labelled whole documents a class, those of the smallest hashes, none of them held out."""
    known = labels.where(~held_out(key) & F.col("toxic").isNotNull()).select(key, "toxic").groupBy(key).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    rows = []
    for label in (1, 0):
        ids = known.where(F.col("toxic") == label).select(key, F.xxhash64(key).alias("h")).orderBy("h", key).limit(SAMPLE)
        t = F.coalesce(F.col(text), F.lit(""))
        sizes = docs.select(key, F.char_length(t).alias("n")).join(F.broadcast(ids), key).orderBy("h", key, "n").limit(SAMPLE).collect()
        whole = accumulate(r["n"] for r in sizes)
        chosen = [(r[key], r["n"]) for i, (r, n) in enumerate(zip(sizes, whole, strict=True)) if i == 0 or n <= SAMPLE * SAMPLE_CHARS]
        few = docs.sparkSession.createDataFrame(chosen, docs.select(key, F.lit(0).alias("n")).schema).distinct()
        rows.append([r["t"] for r in docs.select(key, t.alias("t"), F.char_length(t).alias("n")).join(F.broadcast(few), [key, "n"]).select("t").limit(len(chosen)).collect()])
    return fit(*(sorted(x) for x in rows), odds=max(1, counts.get(1, 0)) / max(1, counts.get(0, 0)))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted (1 from a score of 0.5)."""

    def work(keys: list, texts: list[str]) -> dict:
        scores = [model.score(t) for t in texts]
        return {
            "doc_id": keys,
            "held_out": [k is not None and zlib.crc32(str(k).encode()) % FOLDS == HELD_OUT for k in keys],
            "score": scores,
            "predicted": [int(s >= 0.5) for s in scores],
        }

    return per_text(docs, SCHEMA, lambda: work, key, text)


def reject_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, with all their columns, of the documents that score below 0.5; a null text counts as empty."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array([model.score(t or "") < 0.5 for t in part.column(text).to_pylist()], pa.bool_()))

    return per_slice(docs, text, lambda: work)
