"""Groups of spelling variants: words that differ by one code point, found by two-dimensional range reporting on wavelet trees.

Words are counted first. A word w and an edit at position i (a code point replaced, deleted, or inserted there) leave a prefix w[:i]
and a suffix of w. The words of a length that begin with the prefix are an interval of the words in forward order, those that end in
the suffix an interval of the words in the order of their reversals; a wavelet tree over the permutation between both orders reports exactly
the words in both. So each edit position costs one walk for each of three lengths, and nothing is verified afterwards.

Words are dealt out twice, so that near words meet: by their first AFFIX code points, for edits behind those, and by their last
ones, for edits among the first, whose suffix is at least so long. Many affixes share a cell. An affix of more words than a cell should have is cut
into g parts, and each of the g x g pairs of parts (indexed, asking) is a cell of its own. A pair of words belongs to the first
deal if they begin alike, else to the second, so that a cell returns one row per word (number and best of its near words) and
never the pairs.

Defined cases: null and empty texts have no words; a null doc_id is an empty string in what crc32 is taken of; rows that repeat count
as often as they stand there; words of any length are taken whole; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescape.llm.shared import Scratch, saved, small_batches

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An occurrence whose checksum this divides loses a code point.
SLIP = 199
SHORTEST, FEWEST, TIMES = 6, 5, 5
AFFIX = 3
#: Words of a cell where there are enough to fill more cells than the session has shuffle partitions.
CELL = 32_768
#: A list of heavy affixes up to so many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000

NEAR = "word string, n_near long, best long, form string"


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case and slips applied, of at least SHORTEST code points and FEWEST occurrences."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= SHORTEST).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), cut), F.col("run").substr(cut + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)


class Wavelet:
    """A wavelet tree (as a matrix of levels) over a permutation: reports its values in rectangles of places and values."""

    def __init__(self, values: np.ndarray):
        self.levels, self.size = [], len(values)
        for bit in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            high = (values >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~high)])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~high], values[high]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rectangles [a, b) x [c, d): the number of the rectangle and the value, for each point inside."""
        who = np.flatnonzero((a < b) & (c < d))
        left, right, value = a[who], b[who], np.zeros(len(who), dtype=np.int64)
        for bit, zeros in self.levels:
            l0, r0 = zeros[left], zeros[right]
            l1, r1 = zeros[-1] + left - l0, zeros[-1] + right - r0
            half = value + (1 << bit)
            low = (l0 < r0) & (half > c[who])
            high = (l1 < r1) & (half < d[who])
            low &= value < d[who]
            high &= half + (1 << bit) > c[who]
            left, right = np.concatenate([l0[low], l1[high]]), np.concatenate([r0[low], r1[high]])
            value, who = np.concatenate([value[low], half[high]]), np.concatenate([who[low], who[high]])
        return who, value


class Orders:
    """Numbers for all prefixes (and likewise suffixes) of sorted words: at[w] + i has that of the first i code points of word w.

    Equal prefixes of one length have equal numbers, and numbers rise with the order of the words.
    """

    def __init__(self, words: list[str]):
        size = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        start = np.cumsum(size) - size
        self.at = start + np.arange(len(words))
        self.number = np.zeros(len(points) + len(words), dtype=np.int64)
        alive = np.arange(len(words))
        for i in range(int(size.max(initial=0))):
            alive = alive[size[alive] > i]
            before, point = self.number[self.at[alive] + i], points[start[alive] + i]
            self.number[self.at[alive] + i + 1] = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (point[1:] != point[:-1]))])

    def of(self, words: np.ndarray, i: int) -> np.ndarray:
        return self.number[self.at[words] + i]


def near_words(words: list[str], indexed: np.ndarray, asking: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking word, indexed word) that are one edit apart, by place in words, which are distinct and sorted.

    first: those that begin alike, by edits behind AFFIX code points; else the others, by edits among them.
    """
    none = np.empty(0, dtype=np.int64)
    if not len(indexed) or not len(asking):
        return none, none
    size = np.array([len(w) for w in words], dtype=np.int64)
    backward = sorted(range(len(words)), key=lambda i: words[i][::-1])
    turned = np.empty(len(words), dtype=np.int64)
    turned[backward] = np.arange(len(words))
    prefixes, suffixes = Orders(words), Orders([words[i][::-1] for i in backward])

    forth = indexed[np.lexsort((indexed, size[indexed]))]  # by length, then forward
    back = indexed[np.lexsort((turned[indexed], size[indexed]))]  # by length, then backward
    rank = np.empty(len(words), dtype=np.int64)
    rank[back] = np.arange(len(back))
    tree = Wavelet(rank[forth])
    bounds = {int(n): (int(np.searchsorted(size[forth], n, "left")), int(np.searchsorted(size[forth], n, "right"))) for n in np.unique(size[forth])}
    inside = np.zeros(len(words), dtype=bool)
    inside[indexed] = True

    rectangles: list[tuple[np.ndarray, ...]] = []
    for length in np.unique(size[asking]).tolist():
        who = asking[size[asking] == length]
        for i in range(AFFIX, length + 1) if first else range(AFFIX):
            start = prefixes.of(who, i)
            for target, rest in ((length, length - 1 - i), (length - 1, length - 1 - i), (length + 1, length - i)):  # replaced, deleted, inserted
                if target not in bounds or rest < 0 or i + rest > target:
                    continue
                low, high = bounds[target]
                end = suffixes.of(turned[who], rest)
                own = prefixes.of(forth[low:high], i)
                a, b = low + np.searchsorted(own, start, "left"), low + np.searchsorted(own, start, "right")
                own = suffixes.of(turned[back[low:high]], rest)
                c, d = low + np.searchsorted(own, end, "left"), low + np.searchsorted(own, end, "right")
                more = (a < b) & (c < d)
                if target == length:
                    more &= ~(inside[who] & ((b - a == 1) | (d - c == 1)))  # a word meets itself
                rectangles.append((who[more], a[more], b[more], c[more], d[more]))
    if not rectangles:
        return none, none
    who, a, b, c, d = (np.concatenate(x) for x in zip(*rectangles, strict=True))
    hit, value = tree.report(a, b, c, d)
    both = np.unique(who[hit] * len(words) + back[value])
    x, y = both // len(words), both % len(words)
    alike = prefixes.of(x, AFFIX) == prefixes.of(y, AFFIX)
    kept = (x != y) & (alike if first else ~alike)
    return x[kept], y[kept]


def cells(words: DataFrame, tables: Scratch) -> DataFrame:
    """Words dealt to cells twice: (deal, cell, a, b, word, n, indexed, asking)."""
    count = words.count()
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // CELL))
    target = max(64, -(-count // parts))
    dealt = words.select("word", "n", F.explode(F.array(F.struct(F.lit(1).alias("deal"), F.left("word", F.lit(AFFIX)).alias("affix")), F.struct(F.lit(2).alias("deal"), F.right("word", F.lit(AFFIX)).alias("affix")))).alias("d")).select("word", "n", "d.*")
    heavy = dealt.groupBy("deal", "affix").count().where(F.col("count") > 2 * target)
    heavy = tables.saved(heavy.select("deal", "affix", F.ceil(F.col("count") / target).cast("int").alias("g")), "variant-heavy")
    placed = dealt.join(F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy, ["deal", "affix"], "left")
    own = F.pmod(F.xxhash64("word"), F.col("g")).cast("int")
    every = F.sequence(F.lit(0), F.col("g") - 1)
    split = F.concat(
        F.transform(every, lambda b: F.struct(own.alias("a"), b.alias("b"), F.lit(True).alias("indexed"), (b == own).alias("asking"))),
        F.transform(F.filter(every, lambda a: a != own), lambda a: F.struct(a.alias("a"), own.alias("b"), F.lit(False).alias("indexed"), F.lit(True).alias("asking"))),
    )
    whole = F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(True).alias("indexed"), F.lit(True).alias("asking")))
    cell = F.when(F.col("g").isNull(), F.pmod(F.xxhash64("affix"), F.lit(parts)).cast("string")).otherwise(F.concat(F.lit("="), "affix"))
    return placed.select("deal", cell.alias("cell"), "word", "n", F.explode(F.when(F.col("g").isNull(), whole).otherwise(split)).alias("s")).select("deal", "cell", "s.*", "word", "n")


def neighbours(words: DataFrame, tables: Scratch) -> DataFrame:
    """(word, n_near, best, form): how many near words a word has, and the most frequent one; words without any have no row."""

    def run(table: pa.Table) -> pa.Table:
        text, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        order = np.array(sorted(range(len(text)), key=text.__getitem__), dtype=np.int64)
        names, n = [text[i] for i in order], n[order]
        indexed, asking = (np.flatnonzero(table.column(c).to_numpy()[order]) for c in ("indexed", "asking"))
        x, y = near_words(names, indexed, asking, table.column("deal")[0].as_py() == 1)
        by = np.lexsort((y, -n[y], x))
        x, y = x[by], y[by]
        who, at, near = np.unique(x, return_index=True, return_counts=True)
        best = y[at]
        return pa.table([pa.array([names[i] for i in who], pa.string()), pa.array(near, pa.int64()), pa.array(n[best], pa.int64()), pa.array([names[i] for i in best], pa.string())], names=["word", "n_near", "best", "form"])

    found = cells(words, tables).groupBy("deal", "cell", "a", "b").applyInArrow(run, NEAR)
    first = F.min(F.struct((-F.col("best")).alias("less"), F.col("form").alias("form"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("first.less")).alias("best"), "first.form")


def rooted(forms: DataFrame, tables: Scratch) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling the steps until none changes; a form is always more frequent."""
    heads = tables.saved(forms.select("word", F.col("form").alias("root")), "variant-heads")
    while True:
        on = heads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = tables.saved(heads.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-heads")
        heads = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return heads


def variants(docs: DataFrame, times: int = TIMES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n. A word's form is its most frequent near word, if it is times as frequent."""
    small_batches(docs.sparkSession)
    with Scratch() as tables:
        words = tables.saved(counted(docs, key, text), "variant-words")
        near = tables.saved(neighbours(words, tables), "variant-near")
        known = words.join(near, "word", "left").withColumn("frequent", F.col("best") >= times * F.col("n"))
        known = tables.saved(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("frequent"), F.col("form")).alias("form"), F.when(F.col("frequent"), F.col("best")).alias("form_n")), "variant-known")
        roots = rooted(known.where("form is not null"), tables)
        return saved(known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
