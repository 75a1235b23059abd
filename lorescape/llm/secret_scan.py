"""Secrets: three fixed patterns, and a battery of randomness tests for other tokens.

Base kinds: assign (a telling name, = or :, and a value of 6 or more characters), access (AKIA and capitals or digits, 20 or
more characters in all) and hex (24 or more characters). Matches of a kind are leftmost and don't overlap; those that are
too short are dropped. The method adds spans of kind random; it never takes away base spans.

Method. A candidate is a maximal run of [A-Za-z0-9+/_-], with = at its end, of at least MIN_CHARS characters whose
characters suit one of the ENCODINGS (the smallest that holds them all, with enough classes to be no word). The hypothesis that is
tested, and that has to be rejected before anything is reported, is "this is an ordinary string": a name or path in which
one character class goes on with chance STAY (the marks of paths, and a capital that begins a word, are no change). Its p-value is
the exact chance of at least as many changes of class. A string of which the battery says that it isn't random either counts as
ordinary, with p-value 1; of the others the p-value is divided by the battery's, so that both enter the control and a string has to look
random, too. The division makes p-values larger, so that they stay valid. The battery has tests of "its characters were drawn
independently and evenly from the encoding's alphabet": chi-squared over up to MAX_CELLS cells of the alphabet, the number of runs above
and below the alphabet's middle, and the correlation of neighbouring characters, which Fisher's sum combines; and a test of steps, how
often the commonest difference of characters one or two places apart comes, which sees strings that count up within any cell. The smaller
p-value counts, after a Bonferroni correction that leaves the test of steps a tenth; below DISMISS the string isn't random.

The candidates of one length class over all documents are judged together by the step-up procedure for false discoveries at
rate RATE: of the strings reported in a class, no more than that share is ordinary in expectation, under the model of ordinary
strings. Short strings have few changes to show, so that each class has its own threshold. p-values above RATE can't be rejected at
any share; they are only counted.

A run that is no candidate as a whole (it mixes + or / with - or _, or its words hide a key) is cut at - and _, at + and /, and at all
four; of the pieces that are candidates the longest ones that don't overlap are taken. Each string looked at counts as a test.

The step-up is exact at any number of candidates: from the rate down, a class's threshold becomes the rate times the share of
p-values up to the threshold before, until that share stays. A pass brings one row a class to the driver.

Defined cases: null and empty texts have no spans; patterns need time in proportion to the text; repeated rows are judged
each by itself; an empty table gives an empty table; columns other than the two named ones aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescape.llm.shared import per_text, saved

KINDS = ("assign", "access", "hex", "random")
FOUND = (
    "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<s:int,k:int,e:int>>, maybe array<struct<s:int,k:int,e:int,c:int,p:double>>, "
    "tested array<long>"
)

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
CUTS = tuple(re.compile(f"[^{marks}]{{20,}}") for marks in (r"_-", r"+/", r"+/_-"))
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets from the smallest; each in the order of its values.
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
MIN_CHARS = 20
MAX_CELLS = 8
#: Distances at which the test of steps compares characters.
LAGS = (1, 2)
#: Share of the battery's level that the test of steps has.
STEPS_SHARE = 0.1
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128, 256)
RATE = 0.05
STAY = 0.9
#: Nominal share of random strings that the battery takes for not random; its tests are approximate, and it is up to 0.03 for short ones.
DISMISS = 0.01


def upper_tail(x: float, df: float) -> float:
    """Chance that a chi-squared variable with df degrees of freedom exceeds x (cube-root normal approximation)."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer(token: str) -> str | None:
    """The alphabet of the smallest encoding that holds the token; None for what may as well be words or numbers."""
    body = token.rstrip("=")
    classes = sum(any(c in group for c in body) for group in (UPPER, LOWER, DIGITS))
    if classes < 2 or not any(c in DIGITS for c in body):
        return None
    letters = set(body)
    return next((alphabet for _, alphabet in ENCODINGS if letters <= set(alphabet)), None)


def battery(values: list[int], size: int) -> float:
    """Combined p-value of the three tests for values drawn evenly from range(size)."""
    n = len(values)
    cells = min(MAX_CELLS, max(2, n // 5))
    counts = [0] * cells
    for v in values:
        counts[v * cells // size] += 1
    expected = [sum(1 for v in range(size) if v * cells // size == c) * n / size for c in range(cells)]
    chi = upper_tail(sum((o - e) ** 2 / e for o, e in zip(counts, expected, strict=True)), cells - 1)

    middle = (size - 1) / 2
    high = [v > middle for v in values]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        run = two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        run = 2.0 ** (1 - n)

    spread = (size * size - 1) / 12
    serial = sum((x - middle) * (y - middle) for x, y in zip(values, values[1:], strict=False)) / (spread * math.sqrt(n - 1))
    tests = [chi, run, two_sided(serial)]
    fisher = upper_tail(-2 * sum(math.log(max(p, 1e-300)) for p in tests), 2 * len(tests))
    return min(1.0, fisher / (1 - STEPS_SHARE), steps(values, size) / STEPS_SHARE)


def steps(values: list[int], size: int) -> float:
    """p-value of the commonest difference (modulo size) between values one or two places apart, for all differences and both distances together."""
    least = 1.0
    for lag in LAGS:
        often = Counter((y - x) % size for x, y in zip(values, values[lag:], strict=False))
        least = min(least, size * len(LAGS) * at_least(max(often.values()), len(values) - lag, 1 / size))
    return least


def at_least(k: int, n: int, chance: float) -> float:
    """The chance of k or more successes in n tries."""
    if k <= 0 or k > n:
        return float(k <= 0)
    upward = k > n * chance
    j = k if upward else k - 1
    term = math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(chance) + (n - j) * math.log1p(-chance))
    odds, total = chance / (1 - chance), 0.0
    while term > 1e-17 * total and 0 <= j <= n:  # terms fall on the way from the mean
        total += term
        term *= (n - j) / (j + 1) * odds if upward else j / (n - j + 1) / odds
        j += 1 if upward else -1
    return min(1.0, total) if upward else max(0.0, 1 - total)


def changes(token: str) -> tuple[int, int]:
    """How many neighbours of a string are both letters or digits, and how many of these change class other than from a capital to small."""
    kinds = [0 if c in UPPER else 1 if c in LOWER else 2 if c in DIGITS else 3 for c in token]
    pairs = [(x, y) for x, y in zip(kinds, kinds[1:], strict=False) if x < 3 and y < 3]
    return len(pairs), sum(x != y and (x, y) != (0, 1) for x, y in pairs)


def ordinary(token: str) -> float:
    """p-value of an ordinary string: the chance of at least as many changes if one class goes on with chance STAY."""
    n, k = changes(token)
    return at_least(k, n, 1 - STAY)


def length_class(n: int) -> int:
    return sum(n >= least for least in LENGTHS) - 1


def tested(token: str) -> tuple[float, bool] | None:
    """The p-value that a string is ordinary, and whether it is small enough to go on; None if it suits no encoding."""
    alphabet = infer(token)
    if alphabet is None:
        return None
    p = ordinary(token)
    if p > RATE:
        return p, False
    place = {c: i for i, c in enumerate(alphabet)}
    random = battery([place[c] for c in token.rstrip("=")], len(alphabet))
    return (min(1.0, p / random) if random >= DISMISS else 1.0), True


def pieces(run: str, counts: list[int]) -> list[tuple[int, int, float]]:
    """The longest pieces between marks that are candidates and don't overlap: start, end, p-value."""
    cut = {m.span() for marks in CUTS for m in marks.finditer(run)}
    out: list[tuple[int, int, float]] = []
    for a, b in sorted(cut, key=lambda x: (x[0] - x[1], x)):
        at = bisect.bisect(out, (a,))
        free = (at == 0 or out[at - 1][1] <= a) and (at == len(out) or out[at][0] >= b)
        if free and b - a < len(run) and (found := tested(run[a:b])):
            counts[length_class(b - a)] += 1
            if found[1]:
                out.insert(at, (a, b, found[0]))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, float]], list[int]]:
    """Base spans (start, place in KINDS, end), candidates (start, 3, end, length class, p-value), and tests made by length class."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    maybe, counts = [], [0] * len(LENGTHS)
    for m in CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        whole = tested(run)
        if whole:
            counts[length_class(len(run))] += 1
        found = [(0, len(run), whole[0])] if whole and whole[1] else pieces(run, counts)
        maybe += [(at + a, 3, at + b, length_class(b - a), p) for a, b, p in found if p <= RATE]
    return base, maybe, counts


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def step_up(found: DataFrame, tests: list[int], rate: float = RATE) -> dict[int, float]:
    """By length class (c) the largest p-value (p) at which the step-up procedure rejects "ordinary", or a bit more, of so many tests."""
    cut: dict[int, float] = {c: rate for c, n in enumerate(tests) if n}
    while True:
        up_to = F.lit(0.0)
        for cls, most in sorted(cut.items()):
            up_to = F.when(F.col("c") == cls, F.lit(most)).otherwise(up_to)
        counts = {r["c"]: r["k"] for r in found.groupBy("c").agg(F.count(F.when(F.col("p") <= up_to, 1)).alias("k")).collect()}
        now = {c: rate * counts.get(c, 0) / tests[c] for c in cut}
        if now == cut:
            return cut
        cut = now


def find_secrets(docs: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, counts by base kind, SHA-256 of the base spans, all spans, n_random.

    Texts are read once; the spans found, which are few, are written to the shared folder and judged from there. No more than rate
    of the strings reported as random are ordinary ones, in expectation; a rate above RATE counts as RATE.
    """

    def work(keys: list, texts: list[str]) -> dict:
        found = [scan(t) for t in texts]
        out = {"doc_id": keys, **{f"n_{kind}": [sum(x[1] == k for x in base) for base, *_ in found] for k, kind in enumerate(KINDS[:3])}}
        names = ("s", "k", "e", "c", "p")
        spans = {f: [[dict(zip(names, x, strict=False)) for x in row[i]] for row in found] for i, f in enumerate(("base", "maybe"))}
        return out | spans | {"tested": [row[2] for row in found]}

    rate = min(rate, RATE)
    found = saved(per_text(docs, FOUND, lambda: work, key, text), "secrets")
    tests = found.agg(*(F.sum(F.get("tested", F.lit(c))).alias(str(c)) for c in range(len(LENGTHS)))).first()
    cut = step_up(found.select(F.explode("maybe").alias("m")).select("m.c", "m.p"), [n or 0 for n in tests], rate)
    random = F.filter("maybe", lambda x: _kept(x, cut))
    text_of = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"], x["e"])), ",")
    plain = F.transform(random, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.encode(text_of(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        text_of(F.array_sort(F.concat("base", plain))).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
    )


def _kept(x, cut: dict[int, float]):
    out = F.lit(False)
    for cls, most in sorted(cut.items()):
        out = out | ((x["c"] == cls) & (x["p"] <= most))
    return out


def digest(spans: list) -> str:
    """What base_sha256 holds for these spans."""
    return hashlib.sha256(listed(spans).encode()).hexdigest()
