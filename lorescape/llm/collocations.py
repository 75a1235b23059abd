"""Collocations by vertical positional inverted lists: occurrence positions of frequent phrases, joined with those of adjacent words.

Each task cuts its documents into segments of about SEGMENT words of a language and numbers their word positions, with a gap
between pieces. A phrase's list holds the positions where it begins. A list is extended by a merge join of its positions, moved by the phrase's length, with
the adjacent words' postings; its parts are the longer phrases' lists, and a list's length is the phrase's exact frequency in the segment.
Frequencies of segments are summed by Spark. There is one pass over the texts for each length: a phrase is extended only if it
and what remains of the longer one without its first word are frequent.

A pass knows the frequent phrases of the pass before by a bitmap of their checksums, 2 MB for words and 8 MB for longer ones,
whatever the number of phrases. A bit that stands for a rare phrase costs time, not correctness, since frequencies are
compared with the limit again where they have been summed. Nothing else leaves the executors but the result.

A candidate's score is that of its worst cut into two parts. Arithmetic is that of decimals of 38 digits.

Defined cases: null and empty texts have no words; a null language is `und`; rows count as often as they stand there; texts of any
length are taken whole, in one segment; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorescape.llm.shared import Scratch, saved, slices, small_batches

UNKNOWN = "und"
#: A-Z in lower case, and a line feed for all that ends a piece.
FOLDED = bytes(0x0A if x in b".,;:!?\x0a\x0b\x0c\x0d" else x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))
LONGEST, LEAST, SCALE, SHARE, TOP = 3, 10, 1_000_000, 50, 2000
#: Words of a segment, and rows of a batch that leaves it.
SEGMENT, ROWS = 500_000, 20_000
#: Bits of a bitmap, as powers of 2, for words and for longer phrases.
WORD_BITS, PHRASE_BITS = 24, 26
#: A phrase's checksum is a polynomial, modulo a power of 2, of its words' checksums; all numbers stay below 2 ** 63.
FACTOR, MASK = 1_103_515_245, (1 << 31) - 1

COUNTS = "lang string, phrase string, f long"


class Segment:
    """The words of some documents of one language: places, and for each its word's number."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.lang, words, sizes = lang.encode(), [], []
        for text in texts:
            for piece in text.translate(FOLDED).split(b"\n"):
                found = piece.split()
                if found:
                    words += found
                    sizes.append(len(found))
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        self.word = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
        self.names = list(number)
        self.place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)

    def lists(self, length: int, bitmaps: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The phrases of a length with their lists: names, the phrase of each occurrence, and where it begins (in ascending order)."""
        names, of, start = self.names, self.word, self.place
        if length == 1:
            return names, of, start
        sums = np.fromiter(map(zlib.crc32, names), dtype=np.int64, count=len(names))
        check = following(np.int64(zlib.crc32(self.lang)) & MASK, sums)[of]
        kept = known(bitmaps[0], check)
        of, start, check = of[kept], start[kept], check[kept]
        postings, words, last = start, of, np.arange(len(start))  # last: the posting of a phrase's last word
        for k in range(1, length):
            # the merge join: a phrase's occurrences, moved by its length, with the postings behind those of its last word
            then = np.minimum(last + 1, len(postings) - 1)
            met = postings[then] == start + k
            if k > 1:  # what remains without the first word is frequent, too
                met[:-1] &= start[1:] == start[:-1] + 1
                met[-1:] = False
            of, start, last, check = of[met], start[met], then[met], check[met]
            check = following(check, sums[words[last]])
            if k + 1 < length:
                kept = known(bitmaps[k], check)
                of, start, last, check = of[kept], start[kept], last[kept], check[kept]
            both, of = np.unique(of * len(self.names) + words[last], return_inverse=True)
            names = [names[i] + b" " + self.names[j] for i, j in zip((both // max(1, len(self.names))).tolist(), (both % max(1, len(self.names))).tolist(), strict=True)]
        return names, of, start


def following(check: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The checksum of a phrase and a word behind it."""
    return (check * FACTOR + word) & MASK


def known(bitmap: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which checksums have their bit in a bitmap."""
    bit = check & (64 * len(bitmap) - 1)
    return (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def counted(docs: DataFrame, length: int, bitmaps: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, f): the phrases of a length whose parts may be frequent; docs: lang, text."""
    given = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def phrases(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        names, of, _ = Segment(lang, texts).lists(length, given.value)
        f = np.bincount(of, minlength=len(names))
        for at in range(0, len(names), ROWS):
            part = names[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(f[at : at + ROWS], pa.int64())], names=["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, list[bytes]] = defaultdict(list)
        size = 0
        for part in slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held[lang].append(text)
                size += len(text)
                if size >= 6 * SEGMENT:  # a word and what separates it are about so many bytes
                    for x in held.items():
                        yield from phrases(*x)
                    held.clear()
                    size = 0
        for x in held.items():
            yield from phrases(*x)

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bitmap(frequent: DataFrame, power: int) -> np.ndarray:
    """A bit for the checksum of each phrase; at most 2 ** (power - 6) numbers come to the driver."""
    sums = F.transform(F.split("phrase", " "), lambda w: F.crc32(w.cast("binary")))
    check = F.aggregate(sums, F.crc32(F.col("lang").cast("binary")).bitwiseAND(F.lit(MASK)), lambda check, word: (check * F.lit(FACTOR) + word).bitwiseAND(F.lit(MASK)))
    bit = check.bitwiseAND(F.lit((1 << power) - 1))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = frequent.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), dtype=np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def scored(phrases: DataFrame, tables: Scratch) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of several words; phrases: lang, phrase, f, length."""
    words = F.split("phrase", " ")
    some = phrases.where("length > 1").withColumn("w", words)
    cuts = some.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = tables.saved(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("one"), part(F.col("k") + 1, F.size("w")).alias("two")), "collocation-cuts")
    of = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = tables.saved(cuts.join(of("one", "l"), ["lang", "one"]), "collocation-left").join(of("two", "r"), ["lang", "two"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({SCALE} * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})").cast("long")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    return lowest.select("lang", "phrase", "a", "s.l", "s.r", "s.score")


def maximal(phrases: DataFrame, share: int) -> DataFrame:
    """(lang, phrase) of those that stand in a longer one which is at least share percent as frequent."""
    longer = phrases.where("length > 2").withColumn("w", F.split("phrase", " "))
    inside = longer.select("lang", "f", "w", "length", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("n"))
    inside = inside.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.col("length") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return phrases.join(most, ["lang", "phrase"]).where(100 * F.col("most") >= share * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """The best phrases of 2 to longest words of each language: lang, rank from 1, phrase, a, l, r, n, score."""
    small_batches(docs.sparkSession)
    with Scratch() as tables:
        read = docs.select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).where(F.col("text") != "")
        words = tables.saved(counted(read, 1, []), "collocation-words")
        frequent = [words.where(F.col("f") >= least)]
        bitmaps = [bitmap(frequent[0], WORD_BITS)]
        for length in range(2, longest + 1):
            frequent.append(tables.saved(counted(read, length, bitmaps).where(F.col("f") >= least), "collocation-phrases"))
            if length < longest:
                bitmaps.append(bitmap(frequent[-1], PHRASE_BITS))
        phrases = frequent[0].withColumn("length", F.lit(1))
        for length, more in enumerate(frequent[1:], 2):
            phrases = phrases.union(more.withColumn("length", F.lit(length)))
        kept = tables.saved(scored(phrases, tables).join(tables.saved(maximal(phrases.where("length > 1"), share), "collocation-inside"), ["lang", "phrase"], "left_anti"), "collocation-scores")
        place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = kept.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        total = words.groupBy("lang").agg(F.sum("f").alias("n"))
        return saved(best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
