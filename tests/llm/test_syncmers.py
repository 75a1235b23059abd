import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from lorescape.llm import syncmers
from tests.llm.conftest import prose


def test_anchors_depend_on_their_words_alone(spark):
    a, b = prose(11, 80), prose(12, 30)
    df = spark.createDataFrame([(1, a), (2, b + " " + a), (3, a + " " + b)], "doc_id long, text string")
    got = {r["doc_id"]: {(x["at"], x["hash"]) for x in r["n"]} for r in df.select("doc_id", syncmers.anchors(syncmers.units(F.col("text"))).alias("n")).collect()}
    assert 8 < len(got[1]) < 40
    assert {(at + 30, h) for at, h in got[1]} <= got[2] and got[1] <= got[3]


def hashed(*parts, seed=42):
    """What xxhash64() of these strings and longs gives, as a number without a sign."""
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def units(text):
    return [x for u in re.findall("[^\x20\x09-\x0D]+", text) for x in (u if len(u) > syncmers.UNIT_CHARS else [u])]


def brute(units, k, s=syncmers.S):
    """(place, hash) of all closed syncmers by their definition."""
    inner = [hashed(*units[i : i + s]) for i in range(len(units) - s + 1)]
    out = []
    for i in range(len(units) - k + 1):
        mine = [signed(x) for x in inner[i : i + k - s + 1]]
        if min(mine) in (mine[0], mine[-1]):
            last = k - s
            at = [*range(0, last + 1, s)] + ([last] if last % s else [])
            out.append((i, hashed(*(inner[i + j] for j in at))))
    return out


def brute_prints(text):
    """By kind, w or p, for those that a text has."""
    u, out = units(text), {}
    if len(u) >= syncmers.SHORT:
        out["w"] = brute(u, syncmers.K)
    if len(u) < syncmers.REACH:
        out["p"] = brute(list(text), syncmers.POINTS) or [(0, hashed(text))]
    return {kind: [(h >> 32, at - before) for (at, h), before in zip(found, [0] + [x[0] for x in found], strict=False)] for kind, found in out.items()}


def brute_links(text):
    return {kind: {(a[0], b) for a, b in zip(p, p[1:], strict=False)} if len(p) > 1 else {p[0]} for kind, p in brute_prints(text).items()}


def brute_row(text, other):
    n = len(text) // 2
    changed = text[: len(text) - n] + other[:n]

    def like(a, b):
        kind = next((k for k in "pw" if k in a and k in b), None)
        return len(a[kind] & b[kind]) / len(a[kind] | b[kind]) if kind else 0.0

    form = lambda t: ";".join(f"{kind}:" + ",".join(f"{h * 16 + d:X}" for h, d in p) for kind, p in brute_prints(t).items())
    return (len(text), hashlib.sha256(changed.encode()).hexdigest(), form(text), form(changed), like(brute_links(text), brute_links(changed)), like(brute_links(text), brute_links(other)))


NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_equals_brute_force(spark):
    """Every column, over prose, white space of all kinds, texts without spaces, other scripts, copies and edits."""
    a, b = prose(13, 200), prose(14, 90)
    texts = [a, a, b, a.replace(" ", "\n"), a + " " + b, b + "\t\x0b " + a, "", "x", "abcdefgh", "abcdefghi", "漢字仮名交じり文𠀀" * 30, "a" * 300, a.replace(" ", ""), " ".join(a.split()[:100] + ["new"] + a.split()[100:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in syncmers.fingerprints(df).collect()}
    assert got == {i: brute_row(t, o) for i, (t, o) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True))}
    assert got[2][3] != got[2][2] and got[0][5] == 1.0 and got[12][4] > 0.2 and got[8][5] > 0.2  # half of the edited text without spaces is its own
    assert 0.7 < brute_row(texts[0], texts[13])[5] < 1  # a word more moves all that follows by one, and yet it matches


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in syncmers.fingerprints(docs).collect()}
    assert got == {i: brute_row(t, o) for (i, t), (_, o) in zip(texts, texts[1:] + texts[:1], strict=True)}


def test_joined_texts_have_the_anchors_of_their_whole(spark):
    """Cuts in and beside words, in white space and in long words, at either end, around the lengths at which kinds change."""
    chance = random.Random(5)
    words = prose(41, 400).split()

    def text(n):
        parts = [chance.choice(words) for _ in range(n)]
        for i in range(0, n, 17):
            parts[i] = chance.choice(["漢字仮名", "𠀀" * 20, "x" * 32, "y" * 33, "ab" * 40])
        return "".join(w + chance.choice([" ", " ", " ", "\n", " \t ", "\x0b\x0c\r"]) for w in parts)[chance.randrange(3) :]

    whole = [text(n) for n in (0, 1, 2, 5, 8, 9, 10, 16, 17, 18, 30, 39, 40, 41, 60, 90, 159, 160, 161, 200, 330)]
    whole += [" ", "\n" * 30, "a" * 31, "ab" * 60, " " + "b" * 32, "漢字仮名交じり文𠀀" * 30]
    rows = []
    for i in range(500):
        a, b = chance.choice(whole), chance.choice(whole)
        x, y = (chance.choice([0, len(t), len(t) // 2, chance.randint(0, len(t)), chance.randint(0, min(len(t), 80))]) for t in (a, b))
        rows.append((i, a, b, a[:x], b[:y]))
    df = spark.createDataFrame(rows, "i long, a string, b string, l string, r string")
    df = df.select("i", *(syncmers.found(F.col(c)).alias(f"found_{c}") for c in "ab"), "l", "r", syncmers.found(F.concat("l", "r")).alias("plain")).cache()
    got = df.select("i", "l", "r", "plain", syncmers.found_joined(F.col("l"), F.col("r"), F.col("found_a"), F.col("found_b")).alias("joined")).collect()
    assert [r["i"] for r in got if r["joined"] != r["plain"]] == []
    for r in got[::10]:
        t = r["l"] + r["r"]
        u = units(t)
        assert r["joined"]["words"] == ([(i << 32) + (h >> 32) for i, h in brute(u, syncmers.K)] if len(u) >= syncmers.SHORT else None)
        assert r["joined"]["points"] == ([(i << 32) + (h >> 32) for i, h in brute(list(t), syncmers.POINTS)] if len(u) < syncmers.REACH else None)


def test_edited_texts_take_anchors_over(spark):
    """Behind its own first half and the next document's, an edited text has only the anchors across the limit and at its end to find."""
    df = spark.createDataFrame([(prose(43, 3000), prose(44, 3000))], "l string, r string")
    empty = F.struct(F.array().cast("array<bigint>").alias("words"), F.array().cast("array<bigint>").alias("points"))
    row = df.select(syncmers.found(F.concat("l", "r")).alias("plain"), syncmers.found_joined(F.col("l"), F.col("r"), empty, empty).alias("joined")).first()
    assert len(row["plain"]["words"]) > 1000 and 0 < len(row["joined"]["words"]) < 3 * syncmers.K
    assert set(row["joined"]["words"]) <= set(row["plain"]["words"])


def test_tables_of_mixed_texts_equal_brute_force(spark):
    """Neighbours of all lengths, so that either, both or none of them has the kind of fingerprint that the edited text has."""
    chance = random.Random(6)
    words = prose(45, 500).split()
    texts = ["\n ".join(chance.choices(words, k=chance.choice([0, 1, 3, 12, 38, 41, 90, 158, 161, 240, 420]))) + chance.choice(["", " ", "z" * 40]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in syncmers.fingerprints(df).collect()}
    assert got == {i: brute_row(t, o) for i, (t, o) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True))}


def test_short_texts_are_alike(spark):
    """From 20 code points on a text of which half is kept is like itself, and so is one that lacks its last word, at any length."""
    long = prose(31, 400).split()
    texts = [" ".join(long[:n]) for n in (3, 4, 5, 8, 9, 10, 15, 30, 39, 40, 41, 80, 159, 160, 161, 300)]
    rows = [t for t in texts for t in (t, t.rpartition(" ")[0])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in syncmers.fingerprints(df).collect()}
    assert all(got[i][0] > 0 for i, t in enumerate(rows) if len(t) >= 20)
    assert all(got[i][1] > 0.4 for i in range(0, len(rows), 2) if len(rows[i]) >= 40)


def test_halves_of_the_table_are_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert syncmers.fingerprints(docs).where("n_chars >= 24 and near_edited = 0").count() == 0


def edited(texts):
    t = [x or "" for x in texts]
    return [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(t, t[1:] + t[:1], strict=True)]


def test_odd_documents(spark, odd_docs, odd_texts, no_docs):
    once = odd_docs.dropDuplicates(["doc_id"])
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(once).collect()}
    assert [rows[i]["edited_sha256"] for i in range(len(odd_texts))] == [hashlib.sha256(x.encode()).hexdigest() for x in edited(odd_texts)]
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[0]["near_next"] == 1.0
    assert rows[3]["n_chars"] == 0 and rows[3]["near_next"] == 1.0  # null, then empty
    assert all(0 <= r["near_edited"] <= 1 and r["fingerprint"] for r in rows.values())
    assert syncmers.fingerprints(odd_docs).count() == len(odd_texts) + 1
    assert syncmers.fingerprints(no_docs).count() == 0


def test_next_across_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 3)
    monkeypatch.setattr(syncmers, "KNOTS", 4)
    monkeypatch.setattr(syncmers, "GROUP", 2)
    ids = sorted({i * i * i for i in range(60)} | {5, 6, 7, 10**15, -4})
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["t"] for r in syncmers.next_document(df, "doc_id", ["text"]).select("doc_id", F.col("_next.text").alias("t")).collect()}
    assert got == {a: f"text {b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    one = df.where("doc_id = 7")
    assert syncmers.next_document(one, "doc_id", ["text"]).first()["_next"]["text"] == "text 7"


def test_no_python(spark, odd_docs):
    plan = syncmers.fingerprints(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
