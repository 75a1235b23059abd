"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Documents are counted in cells (source, language, topic). Each cell has a multiplier, and its probability is the smaller of 1 and
that. Multipliers start at the budget's share and are scaled in turn so that the expected tokens of each margin's values agree with
their targets, with the limit of 1 inside the fit: what cells at the limit can't give is asked of the other cells of the same value, not
of all. This is done ROUNDS times. A budget at which a source, language or topic has fewer tokens than its target asks for
can't meet the targets, so the fit is made for STEPS budgets, equal steps from the one asked for down to 0, and the largest
one is taken whose margins are within TOLERANCE of the sampled tokens (targets that contradict each other are never met: then within
1.01 times the smallest error of any budget). A lowered budget and the error are logged, and achieved() gives each margin's
shares beside the targets.

A document is sampled if a uniform number made of its id is below its probability, so the decision depends on nothing else and
can be made anywhere again.

Target shares are given by value for each margin; a margin without given targets gets those proportional to its
tokens to the power TEMPERATURE, which lifts small values and lowers a dominant one. Values without a target get 0.

Cells are summed before the shuffle, so a dominant source costs nothing. Their number is the product of the margins' values, not of
the documents; up to CELLS they are fitted in the driver's memory and sent to the tasks, beyond that they are fitted by the
same steps on a distributed table and joined by a shuffle.

Defined cases: null values of a margin are a value of their own, "(none)"; null and empty texts have no tokens, weight 0, and the
probability of their cell (0 if the whole cell has no tokens); repeated rows are decided alike, and so are all rows without an id; an
empty table gives an empty table; other columns are kept by sample() and not read otherwise.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescape.llm.shared import Scratch, saved

log = logging.getLogger(__name__)

MARGINS = ("source", "lang", "topic")
ROUNDS, STEPS = 200, 20
TEMPERATURE = 0.5
BUDGET = 0.5
#: Error of a margin's value, as a share of the sampled tokens, at which its target counts as met.
TOLERANCE = 1e-3
#: Largest multiplier.
MOST = 1e30
CELLS = 100_000
#: Sums of a margin's values of up to so many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
NONE = "(none)"
#: A text's topic is told by the share of its code points that aren't letters or white space, in steps.
TOPICS = ((0.02, "prose"), (0.05, "punctuated"), (0.12, "listing"))
TOPIC_REST = "symbols"


def tokens(text: Column) -> Column:
    """White-space separated words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic of a whole text for tables that have no such column: how much of it is marks and digits."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    marks = n - F.char_length(F.regexp_replace(t, r"[\x21-\x40\x5B-\x60\x7B-\x7E]", ""))
    share = F.when(n > 0, marks / n).otherwise(0.0)
    out = F.lit(TOPIC_REST)
    for least, name in reversed(TOPICS):
        out = F.when(share < least, name).otherwise(out)
    return out


def uniform(key: Column) -> Column:
    """A number in [0, 1) made of an id: 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def cells(rows: DataFrame, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """Documents and tokens of each cell."""
    return rows.groupBy(*margins).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def targets(sums: dict[str, float], given: dict[str, float] | None) -> dict[str, float]:
    """Shares of a margin's values, summing to 1 over the values that have tokens."""
    raw = {v: (given.get(v, 0.0) if given is not None else s**TEMPERATURE) if s > 0 else 0.0 for v, s in sorted(sums.items())}
    whole = sum(raw.values())
    return {v: x / whole if whole else 0.0 for v, x in raw.items()}


def chosen(budgets: list[float], errors: list[float], short: list[str] = []) -> int:  # noqa: B006
    """The place of the largest budget that meets the targets, or meets them about as well as any; short: what is too small for the first."""
    allowed = max(TOLERANCE, 1.01 * min(errors))
    place = next(j for j, e in enumerate(errors) if e <= allowed)
    if place or errors[place] > TOLERANCE:
        why = f"; fewer tokens than asked for: {', '.join(short[:20])}" if short else ""
        log.warning("budget %.4g instead of %.4g: margins are within %.2g of the sampled tokens there%s", budgets[place], budgets[0], errors[place], why)
    return place


def fit_local(counted: list, margins: tuple[str, ...], given: dict[str, dict[str, float]], budgets: list[float], rounds: int) -> dict[tuple, float]:
    """Probability of each cell, fitted in memory for all budgets at once."""
    keys = [tuple(r[m] for m in margins) for r in counted]
    seen = np.array([float(r["tokens"] or 0) for r in counted])
    total = seen.sum()
    if not total:
        return dict.fromkeys(keys, 0.0)
    codes, wanted, short = [], [], []
    for i, m in enumerate(margins):
        values = sorted({k[i] for k in keys})
        place = {v: j for j, v in enumerate(values)}
        code = np.array([place[k[i]] for k in keys])
        sums = np.bincount(code, seen, len(values))
        share = targets(dict(zip(values, sums.tolist(), strict=True)), given.get(m))
        codes.append(code)
        wanted.append([share[v] * total for v in values])
        short += [f"{m} {v}" for v, s in zip(values, sums.tolist(), strict=True) if s < share[v] * total * budgets[0]]
    multiplier, errors = [], []
    for budget in budgets:
        f = np.full(len(keys), budget)
        sums = lambda code, part: np.bincount(code, np.where(part, seen * np.minimum(f, 1.0), 0.0), int(code.max()) + 1)  # noqa: B023, E731
        for _ in range(rounds):
            for code, want in zip(codes, wanted, strict=True):
                w, below, full = np.array(want) * budget, sums(code, f < 1), sums(code, f >= 1)
                grow = np.divide(w - full, below, out=np.ones_like(w), where=below > 0)
                shrink = np.divide(w, below + full, out=np.ones_like(w), where=below + full > 0)
                f = np.minimum(f * np.where(w > below + full, grow, shrink)[code], MOST)
        errors.append(max(float(np.abs(sums(code, f >= 0) - np.array(want) * budget).max()) for code, want in zip(codes, wanted, strict=True)) / (budget * total))
        multiplier.append(f)
    return dict(zip(keys, np.minimum(multiplier[chosen(budgets, errors, short)], 1.0).tolist(), strict=True))


def fit_distributed(counted: DataFrame, margins: tuple[str, ...], given: dict[str, dict[str, float]], budgets: list[float], rounds: int) -> DataFrame:
    """The same on a table of cells, for more of them than fit in memory: margins and p. A round is written at a time."""
    spark = counted.sparkSession
    with Scratch() as tables, Scratch() as states:
        at = tables.saved(counted.select(*margins, F.coalesce(F.col("tokens"), F.lit(0)).cast("double").alias("seen")), "mix-seen")
        total = at.agg(F.sum("seen")).first()[0] or 0.0
        if not total:
            return saved(at.select(*margins, F.lit(0.0).alias("p")), "mix-fitted")
        wanted = {}
        for m in margins:
            sums = at.groupBy(m).agg(F.sum("seen").alias("s"))
            if given.get(m) is None:
                sums = sums.withColumn("raw", F.when(F.col("s") > 0, F.pow("s", F.lit(TEMPERATURE))).otherwise(0.0))
            else:
                listed = spark.createDataFrame(list(given[m].items()), f"{m} string, w double")
                sums = sums.join(listed, m, "left").withColumn("raw", F.when(F.col("s") > 0, F.coalesce("w", F.lit(0.0))).otherwise(0.0))
            whole = sums.agg(F.sum("raw")).first()[0] or 1.0
            wanted[m] = tables.saved(sums.select(m, (F.col("raw") / whole * total).alias("want")), "mix-targets")
            wanted[m] = F.broadcast(wanted[m]) if wanted[m].count() <= BROADCAST_ROWS else wanted[m]

        def by_value(state: DataFrame, m: str) -> DataFrame:
            got = lambda part: F.sum(F.when(part, F.col("seen") * F.least("f", F.lit(1.0))).otherwise(0.0))
            sums = state.groupBy("budget", m).agg(got(F.col("f") < 1).alias("below"), got(F.col("f") >= 1).alias("full"))
            return sums.join(wanted[m], m).withColumn("want", F.col("want") * F.col("budget"))

        few = {m: at.select(m).distinct().count() * len(budgets) <= BROADCAST_ROWS for m in margins}
        state = at.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).withColumn("f", F.col("budget"))
        for _ in range(rounds):
            for m in margins:
                got = F.col("below") + F.col("full")
                grow = F.when(F.col("below") > 0, (F.col("want") - F.col("full")) / F.col("below")).otherwise(1.0)
                shrink = F.when(got > 0, F.col("want") / got).otherwise(1.0)
                by = by_value(state, m).select("budget", m, F.when(F.col("want") > got, grow).otherwise(shrink).alias("by"))
                state = state.join(F.broadcast(by) if few[m] else by, ["budget", m]).withColumn("f", F.least(F.col("f") * F.col("by"), F.lit(MOST))).drop("by")
            state = states.saved(state, "mix-state")
            states.drop(max(0, len(states.made) - 1))
        errors = dict.fromkeys(budgets, 0.0)
        for m in margins:
            for r in by_value(state, m).groupBy("budget").agg(F.max(F.abs(F.col("below") + F.col("full") - F.col("want"))).alias("e")).collect():
                errors[r["budget"]] = max(errors[r["budget"]], r["e"] / (r["budget"] * total))
        best = budgets[chosen(budgets, [errors[b] for b in budgets])]
        return saved(state.where(F.col("budget") == best).select(*margins, F.least("f", F.lit(1.0)).alias("p")), "mix-fitted")


def achieved(rows: DataFrame, given: dict[str, dict[str, float]] | None = None) -> list[tuple[str, str, float, float]]:
    """Of what mix() gives: each margin's values, their target shares, and their shares of the sample's expected tokens."""
    out = []
    for m in MARGINS:
        sums = rows.groupBy(m).agg(F.sum("n_tokens").alias("n"), F.sum("weight").alias("w")).orderBy(m).collect()
        wanted, whole = targets({r[m]: float(r["n"]) for r in sums}, (given or {}).get(m)), sum(r["w"] for r in sums)
        out += [(m, r[m], wanted[r[m]], r["w"] / whole if whole else 0.0) for r in sums]
    return out


def mix(
    docs: DataFrame,
    given: dict[str, dict[str, float]] | None = None,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    steps: int = STEPS,
    most_cells: int = CELLS,
    key: str = "doc_id",
    text: str = "text",
    topics: Column | None = None,
) -> DataFrame:
    """A row per document: doc_id, source, lang, topic, n_tokens, probability, weight, sampled.

    weight is the document's fitted tokens in expectation: n_tokens times its probability.
    """
    margins, given, budgets = MARGINS, given or {}, [budget * (steps - j) / steps for j in range(steps)]
    named = [F.coalesce(F.col(m).cast("string"), F.lit(NONE)).alias(m) for m in ("source", "lang")]
    kind = topic(F.col(text)) if topics is None else F.coalesce(topics.cast("string"), F.lit(NONE))
    # the texts are read once: what is written is a few bytes for each document
    rows = saved(docs.select(F.col(key).alias("doc_id"), *named, kind.alias("topic"), tokens(F.col(text)).alias("n_tokens")), "mix-rows")
    with Scratch() as tables:
        counted = tables.saved(cells(rows, margins), "mix-counts")
        if counted.count() <= most_cells:
            chance = fit_local(counted.collect(), margins, given, budgets, rounds)
            known = rows.sparkSession.createDataFrame([(*k, p) for k, p in chance.items()], ", ".join(f"{m} string" for m in margins) + ", p double")
            known = F.broadcast(known)
        else:
            known = fit_distributed(counted, margins, given, budgets, rounds)
    joined = rows.join(known, list(margins))
    p = F.round("p", 9)
    return joined.select("doc_id", *margins, "n_tokens", p.alias("probability"), F.round(F.col("n_tokens") * p, 6).alias("weight"), (uniform(F.col("doc_id")) < p).alias("sampled"))


def sample(docs: DataFrame, given: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the documents that are sampled, with all their columns."""
    rows = mix(docs, given, budget, key=key, text=text)
    cell = saved(rows.select("source", "lang", "topic", "probability").distinct(), "mix-cells")  # one probability a cell
    n = cell.count()
    named = {"__mix_s": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "__mix_l": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), "__mix_t": topic(F.col(text))}
    known = cell.select(F.col("source").alias("__mix_s"), F.col("lang").alias("__mix_l"), F.col("topic").alias("__mix_t"), F.col("probability").alias("__mix_p"))
    known = F.broadcast(known) if n <= CELLS else known
    columns = docs.columns
    return docs.withColumns(named).join(known, ["__mix_s", "__mix_l", "__mix_t"]).where(uniform(F.col(key)) < F.col("__mix_p")).select(*columns)
