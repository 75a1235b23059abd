"""Document fingerprints from closed syncmers, with built-in functions only.

A text of at least SHORT units has a fingerprint of words: its units are maximal stretches without U+0020 and U+0009 to U+000D, and
the code points of words of more than UNIT_CHARS (scripts without spaces, data). A text of fewer than REACH units has one of code points, with
stretches of POINTS, since a few words hold too few stretches of words. Texts in between have both, and two texts are compared by code points
if both have them, else by words; so texts whose lengths differ by less than the factor REACH / SHORT always share a kind, and texts that share none
have at most a quarter of their units in common (likeness 0). A stretch of
K units is a closed syncmer if, of the hashes of its K - S + 1 inner stretches of S units, the smallest belongs to the first or the
last. Whether a stretch is chosen depends on it alone, so that equal passages give equal anchors wherever they stand, and of
K - S neighbouring stretches one is chosen at least.

A fingerprint holds all closed syncmers in order: 32 bits of each one's hash, and in a last hexadecimal digit its distance from
the one before (from the start for the first), which gives all places. Anchors are matched by position: two neighbouring
anchors of a text match those of another text if both hashes and the distance between them agree, that is, if both anchors
fall on one offset between the texts. likeness() is the number of such pairs that two texts share over those that either has.

next_document() puts the following row by ascending id beside each one with a single shuffle of the texts: ids are cut into
buckets of about BUCKET_ROWS at knots of their distribution, a window within each bucket finds the next row, and the last
row of a bucket takes the first one of the next bucket that has any. Only the knots, KNOTS numbers, come to the driver. Anchors of a
text are computed behind that shuffle, once, so that only texts are exchanged. An edited text takes over those of its own first part and
of the next document's (found_joined()); only where the two meet and at its end are anchors found anew, and of a kind that one of the two texts hasn't.

Defined cases: a null text counts as empty. A text without a closed syncmer (one of fewer than POINTS code points) has one anchor, the
hash of the whole text; a text with one anchor matches only another such text, by its hash. Equal texts have equal
fingerprints and likeness 1. A table's last row is followed by its first, and a single row by itself. Rows that repeat an id
are ordered by their text. Rows whose id is null come first. An empty table gives an empty one. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 9, 2
#: Code points of a stretch; units from which on a text has a fingerprint of words, and up to which it has one of code points.
POINTS, SHORT, REACH = 6, 40, 160
UNIT_CHARS = 32
WHITE = "\t\n\x0b\x0c\r"
BUCKET_ROWS, KNOTS, GROUP = 256, 64, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def units(text: Column) -> Column:
    """A text's words, and the code points of long words."""
    words = F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")
    long = lambda w: F.char_length(w) > UNIT_CHARS
    cut = lambda w: F.flatten(F.transform(w, lambda x: F.when(long(x), points(x)).otherwise(F.array(x))))
    return let(words, lambda w: F.when(F.exists(w, long), cut(w)).otherwise(w))


def points(text: Column) -> Column:
    """A text's code points."""
    return F.array_remove(F.split(text, ""), "")


def _struct(at: Column, hash: Column) -> Column:
    return F.struct(at.alias("at"), hash.alias("hash"))


def anchors(units: Column, k: int = K, s: int = S, form: Callable[[Column, Column], Column] = _struct) -> Column:
    """Closed syncmers of an array of units in order: an array of (at: place of its first unit from 0, hash: 64 bits), or of what form makes of the two."""
    if not 1 <= s < k:
        raise ValueError("an inner stretch must be shorter than its syncmer")
    last = k - s

    def chosen(g: Column) -> Callable[[Column, Column], Column]:
        def of(x: Column, i: Column) -> Column:
            """Of the inner hashes from place i on, x is the smaller one of the first and the last."""
            hit = reduce(lambda a, b: a & b, [x <= F.get(g, i + j) for j in range(1, last)], F.lit(True))  # ends at the first smaller one
            parts = [F.get(g, i + j) for j in range(0, last + 1, s)] + ([F.get(g, i + last)] if last % s else [])
            return F.when(hit, form(i, F.xxhash64(*parts)))

        return of

    def of(words: Column) -> Column:
        g = words if s > 1 else F.transform(words, lambda w: F.xxhash64(w))
        for extra in range(1, s):  # hashes of inner stretches, a unit longer at a time
            n = F.size(words) - extra
            g = F.zip_with(F.slice(g, 1, n), F.slice(words, extra + 1, n), lambda a, b: F.xxhash64(a, b))
        ends = lambda g: F.zip_with(F.slice(g, 1, F.size(g) - last), F.slice(g, last + 1, F.size(g)), lambda a, b: F.least(a, b))
        return F.when(F.size(words) >= k, let(g, lambda g: F.array_compact(F.transform(ends(g), chosen(g))))).otherwise(F.array())

    return let(units, of)


def placed(units: Column, k: int) -> Column:
    """Anchors of k units as numbers: the place, and behind it 32 bits of the hash."""
    return anchors(units, k, form=lambda at, hash: _place(at) + F.shiftrightunsigned(hash, 32))


def _place(at: Column) -> Column:
    return F.shiftleft(at.cast("long"), 32)


def found(text: Column) -> Column:
    """The placed anchors of a text, a struct (words, points). Either is null where a text has no such fingerprint."""
    return let(units(text), lambda words: _kinds(F.size(words), placed(words, K), placed(points(text), POINTS)))


def _kinds(n: Column, words: Column, points: Column) -> Column:
    return F.struct(F.when(n >= SHORT, words).alias("words"), F.when(n < REACH, points).alias("points"))


@dataclass
class Part:
    """A stretch of units: how many, the first and last few (one less than an anchor has), and the anchors that lie within it, placed from its start."""

    n: Column
    first: Column
    last: Column
    found: Column


def within(found: Column, k: int, n: Column, otherwise: Column, skip: Column | None = None) -> Column:
    """Those of a text's placed anchors that lie within n units behind the first skip ones, placed from there; otherwise if the text has none of the kind."""
    if skip is None:
        inside = F.filter(found, lambda a: a < _place(n - (k - 1)))
    else:
        inside = F.filter(found, lambda a: (a >= _place(skip)) & (a < _place(skip + n - (k - 1))))
        inside = F.transform(inside, lambda a: a - _place(skip))
    return F.coalesce(inside, otherwise)


def joined(k: int, left: Part, middle: Column, right: Part, end: Column) -> Column:
    """The placed anchors of two parts with units between and behind them: those of the parts, and those that lie across their limits."""
    moved = lambda found, to: F.transform(found, lambda a: a + _place(to))
    at = left.n + F.size(middle)
    few = right.n < k - 1
    seam = F.concat(left.last, middle, right.first, F.when(few, end).otherwise(F.array()))
    behind = F.when(few, F.array()).otherwise(moved(placed(F.concat(right.last, end), k), at + right.n - (k - 1)))
    return F.concat(left.found, moved(placed(seam, k), left.n - F.size(left.last)), moved(right.found, at), behind)


def found_joined(left: Column, right: Column, before: Column, after: Column) -> Column:
    """What found() gives for left + right, where left begins a text whose anchors are before, and right begins one whose are after.

    Only anchors across the limit, and of the word that right's end cuts, are computed anew, and those of kinds that a text hasn't.
    """
    plain = lambda t: F.translate(t, WHITE, " " * len(WHITE))

    def of_words(a: Column, b: Column) -> Column:
        """The words of left before its last white space, the word across the limit, those of right behind its first white space, and right's last word."""
        tail, head = F.substring_index(a, " ", -1), F.substring_index(b, " ", 1)
        behind = F.substring(b, F.char_length(head) + 1, F.char_length(b) - F.char_length(head))
        rest = F.substring_index(behind, " ", -1)
        whole = lambda t, end: F.substring(t, F.lit(1), F.char_length(t) - F.char_length(end))
        return F.struct(
            units(whole(a, tail)).alias("left"),
            units(F.concat(tail, head)).alias("middle"),
            units(whole(behind, rest)).alias("right"),
            units(rest).alias("end"),
            F.size(units(head)).alias("skip"),
        )

    def words(w: Column) -> Column:
        def part(u: Column, anchors: Column, skip: Column | None = None) -> Part:
            n = F.size(u)
            last = F.slice(u, F.greatest(n - (K - 2), F.lit(1)), F.lit(K - 1))
            return Part(n, F.slice(u, 1, K - 1), last, within(anchors, K, n, placed(u, K), skip))

        return joined(K, part(w["left"], before["words"]), w["middle"], part(w["right"], after["words"], w["skip"]), w["end"])

    def part(t: Column, anchors: Column) -> Part:
        n, side = F.char_length(t), F.lit(POINTS - 1)
        return Part(n, points(F.left(t, side)), points(F.right(t, side)), within(anchors, POINTS, n, placed(points(t), POINTS)))

    none = F.array().cast("array<string>")
    fine = joined(POINTS, part(left, before["points"]), none, part(right, after["points"]), none)
    size = lambda w: sum((F.size(w[x]) for x in ("middle", "right", "end")), F.size(w["left"]))
    return let(of_words(plain(left), plain(right)), lambda w: _kinds(size(w), words(w), fine))


def prints(found: Column, text: Column) -> Column:
    """The anchors of a text in order, each as 16 times 32 bits of its hash plus its distance from the one before: a struct (words, points).

    Either is null where a text has no such fingerprint.
    """
    whole = F.array(F.shiftrightunsigned(F.xxhash64(text), 32))

    def of(found: Column) -> Column:
        distance = lambda a, i: F.shiftright(a, 32) - F.coalesce(F.shiftright(F.get(found, i - 1), 32), F.lit(0))
        return F.transform(found, lambda a, i: F.shiftleft(a.bitwiseAND(F.lit(0xFFFFFFFF)), 4) + distance(a, i))

    points = F.when(F.size(found["points"]) == 0, whole).otherwise(found["points"])
    return F.struct(let(found["words"], of).alias("words"), let(points, of).alias("points"))


def links(prints: Column) -> Column:
    """For words and for points the distinct pairs of neighbouring anchors with the distance between them, each as a 64-bit hash; of one anchor its own."""

    def of(p: Column) -> Column:
        n = F.size(p) - 1
        pairs = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.xxhash64(F.shiftrightunsigned(a, 4), b))
        return F.when(p.isNotNull(), F.when(n > 0, F.array_distinct(pairs)).otherwise(F.array(F.xxhash64(F.get(p, F.lit(0))))))

    return F.struct(of(prints["words"]).alias("words"), of(prints["points"]).alias("points"))


def hexadecimal(prints: Column) -> Column:
    """Both fingerprints as text."""
    of = lambda kind: F.concat(F.lit(kind[0] + ":"), F.array_join(F.transform(prints[kind], F.hex), ","))
    return F.concat_ws(";", of("words"), of("points"))


def likeness(a: Column, b: Column) -> Column:
    """The share of two texts' links that both have, in the finest kind that both have."""

    def share(kind: str) -> Column:
        x, y = a[kind], b[kind]
        return F.when(x.isNotNull() & y.isNotNull(), let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n)))

    return F.coalesce(share("points"), share("words"), F.lit(0.0))


def _bucket(rows: DataFrame, key: str) -> Column:
    """The bucket of a row: between each two knots of the keys' distribution as many equal steps as rows ask for."""
    shares = [i / KNOTS for i in range(KNOTS + 1)]
    stats = rows.agg(F.percentile_approx(key, shares, 10_000).alias("knots"), F.count("*").alias("n")).first()
    knots = sorted(set(stats["knots"] or [0]))
    steps = max(1, -(-stats["n"] // (BUCKET_ROWS * KNOTS)))
    if len(knots) == 1:
        return F.coalesce(F.when(F.col(key) < knots[0], 0).when(F.col(key) == knots[0], 1).otherwise(2), F.lit(-1)).cast("long")

    def search(a: int, b: int) -> Column:
        """The step between knots a and b that the key falls into, by halving."""
        if b - a > 1:
            middle = (a + b) // 2
            return F.when(F.col(key) < F.lit(knots[middle]), search(a, middle)).otherwise(search(middle, b))
        width = F.lit((knots[b] - knots[a]) / steps)
        inside = F.floor((F.col(key) - F.lit(knots[a])) / width)
        return F.lit(a * steps) + F.least(F.greatest(inside, F.lit(0)), F.lit(steps - 1))

    return F.coalesce(search(0, len(knots) - 1), F.lit(-1)).cast("long")


def next_document(rows: DataFrame, key: str, columns: list[str], derived: Callable[[DataFrame], DataFrame] = lambda rows: rows, also: tuple[str, ...] = ()) -> DataFrame:
    """The rows with a struct _next of these columns of the row that follows by ascending key; the first of them breaks ties.

    derived adds columns to rows behind the shuffle, and the struct has those named by also, too.
    """
    dealt = rows.withColumn("_bucket", _bucket(rows, key))
    order = [F.asc_nulls_first(key), F.asc(columns[0])]
    inside = Window.partitionBy("_bucket").orderBy(*order)
    follower = F.struct(*columns, *also)
    here = derived(dealt.repartition("_bucket").sortWithinPartitions("_bucket", *order))
    seen = here.withColumn("_lead", F.lead(follower).over(inside))

    # which filled bucket follows each one: within groups of buckets, then between the groups, of which there are few
    filled = dealt.select("_bucket").distinct().withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    between = Window.orderBy("_group")
    least = F.min("_least").over(between.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    groups = filled.groupBy("_group").agg(F.min("_bucket").alias("_least"))
    groups = groups.select("_group", F.coalesce(F.lead("_least").over(between), least).alias("_later"))
    after = F.lead("_bucket").over(Window.partitionBy("_group").orderBy("_bucket"))
    behind = filled.withColumn("_after", after).join(groups, "_group").select(F.col("_bucket").alias("_before"), F.coalesce("_after", "_later").alias("_bucket"))

    firsts = derived(dealt.withColumn("_row", F.row_number().over(inside)).where("_row = 1").drop("_row")).select("_bucket", follower.alias("_first"))
    edges = behind.join(firsts, "_bucket").select(F.col("_before").alias("_bucket"), "_first")
    return seen.join(edges, "_bucket", "left").withColumn("_next", F.coalesce("_lead", "_first")).drop("_bucket", "_lead", "_first")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with its fingerprint, that of its edited text, and both likenesses (see the queries' contract).

    The edited text has the last half of its code points replaced by the first as many of the next document.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))

    def derived(rows: DataFrame) -> DataFrame:
        return rows.withColumn("found", found(F.col("text"))).withColumn("prints", prints(F.col("found"), F.col("text"))).withColumn("links", links(F.col("prints")))

    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    left, right = F.substring("text", F.lit(1), n - half), F.substring(F.col("_next.text"), F.lit(1), half)
    both = next_document(own, "doc_id", ["text"], derived, ("found", "links"))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "found", "prints", "links", "_next", left.alias("left"), right.alias("right"))
    both = both.withColumn("edited", F.concat("left", "right"))
    shared = found_joined(F.col("left"), F.col("right"), F.col("found"), F.col("_next.found"))
    made = let(shared, lambda f: let(prints(f, F.col("edited")), lambda p: F.struct(p.alias("edited_prints"), links(p).alias("edited_links"))))
    # generated, so that a filter on the result doesn't repeat all this
    both = both.select("n_chars", "doc_id", "prints", "links", F.col("_next.links").alias("after"), "edited", F.inline(F.array(made)))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        hexadecimal(F.col("prints")).alias("fingerprint"),
        hexadecimal(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("links"), F.col("edited_links")).alias("near_edited"),
        likeness(F.col("links"), F.col("after")).alias("near_next"),
    )
