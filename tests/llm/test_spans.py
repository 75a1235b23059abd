"""Personal data and secrets against the contract's patterns, applied as they are."""

import fractions
import hashlib
import math
import random
import re
import statistics

import numpy as np
import pytest

from lorescape.llm import pii, secret_scan

PLAIN_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    d = [int(x) for x in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain_pii(text):
    found = []
    for k, (kind, p) in enumerate(PLAIN_PII.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end()))
    return [f"{list(PLAIN_PII)[k]}:{a}:{b}" for a, k, b in sorted(found)]


PLAIN_SECRETS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def plain_secrets(text):
    found = []
    for k, (kind, p) in enumerate(PLAIN_SECRETS.items()):
        for m in re.finditer(p, text, re.A):
            if {"assign": kind == "assign" and len(m[2]) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[kind]:
                found.append((m.start(), k, m.end()))
    return [f"{list(PLAIN_SECRETS)[k]}:{a}:{b}" for a, k, b in sorted(found)]


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_equal_plain_patterns(seed):
    r = random.Random(seed)
    bits = ["a@b.co", "@", "x.y@", "1.2.3.4", ".", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "-", "0", "55", "ä", "a@b@c.de.fg", "1.2.3.4.5.6.7.8", "\n"]
    keys = ["password=", "Token: 'abcdef1'", "api_key", "=", "secret = x", "AKIA", "ABCDEFGHIJ123456", "deadbeef", "0123456789abcdef", " ", "é", '"', "SECRET:", "sſecret=abcdef", "tokenToken=abcdefg"]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert pii.listed(pii.find(text), pii.BASE_KINDS) == ",".join(plain_pii(text)), text
        text = "".join(r.choice(keys) for _ in range(r.randint(0, 14)))
        assert secret_scan.listed(secret_scan.scan(text)[0]) == ",".join(plain_secrets(text)), text


def test_long_runs_take_no_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "A1b" * 100_000, "f" * 300_000):
        pii.find(text)
        secret_scan.scan(text)


def test_iban_and_context():
    spans = pii.find("transfer to account DE89 3704 0044 0532 0130 00 now, not DE89 3704 0044 0532 0130 01")
    assert [(pii.KINDS[k], s) for _, k, _, s in spans if pii.KINDS[k] == "iban"] == [("iban", 1.0)]
    low, high = (pii.find(t)[0][3] for t in ("release version 10.1.2.3", "server address 10.1.2.3"))
    assert low < 0.5 < high


@pytest.mark.parametrize("behind", [" BIC COBADEFFXXX", " EUR 500", " 12", " A B C D E F", "", ".", " and"])
@pytest.mark.parametrize("before", ["IBAN ", "AB12 REF NUMBER ", "DE00 "])
@pytest.mark.parametrize("iban", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32"])
def test_ibans_before_capitals_and_numbers(before, iban, behind):
    assert pii.ibans(before + iban + behind) == [(len(before), len(before + iban))]
    assert pii.redacted(before + iban + behind) == before + "[IBAN]" + behind


def test_iban_of_an_unknown_country_ends_at_a_group():
    iban = next(t for n in range(100) if pii.mod97((t := f"QQ{n:02d} 1234 5678 9012 3456").replace(" ", "")))
    assert pii.ibans(iban + " EUR") == [(0, len(iban))]


def plain_ibans(text):
    """Account numbers by trying every start and, from the longest, every end at a group's border."""
    out, at = [], 0
    while at < len(text):
        m = re.match(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", text[at:])
        end = None
        if m and (at == 0 or not re.match("[A-Za-z0-9]", text[at - 1])):
            borders = [e for e in range(m.end(), 14, -1) if e == m.end() or text[at + e] == " "]
            size = lambda e: len(text[at : at + e].replace(" ", ""))  # noqa: B023, E731
            own = pii.IBAN_LENGTHS.get(text[at : at + 2])
            tried = [e for e in borders if size(e) == own] + borders[:1] if own else borders
            number = lambda e: int("".join(str(int(c, 36)) for c in (lambda x: x[4:] + x[:4])(text[at : at + e].replace(" ", ""))))  # noqa: B023, E731
            end = next((e for e in tried if size(e) >= 15 and number(e) % 97 == 1), None)
        if end:
            out.append((at, at + end))
        at += end or 1
    return out


def test_account_numbers_and_scores_equal_plain_versions():
    r = random.Random(12)
    good = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]
    words = ["iban", "account", "version", "EUR", "BIC COBADEFFXXX", "DE89 3704", "order", "sample", "card", "AB12", "x"]
    other = ["a@b.co", "10.1.2.3", "4111 1111 1111 1111", "+1 555 010 9999", "DE89 3704 0044 0532 0130 01"]
    for _ in range(400):
        text = " ".join(r.choice(r.choice((good, words, words, other))) for _ in range(r.randint(1, 8)))
        assert pii.ibans(text) == plain_ibans(text), text
        for start, kind, end, score in pii.find(text):
            near = [w.lower() for w in re.findall(r"[\w-]+", text[max(0, start - 48) : start])]
            up = {"iban": {"iban", "account"}, "card": {"card"}, "email": set(), "ip": set(), "phone": set()}[pii.KINDS[kind]]
            want = pii.BASE_SCORE[pii.KINDS[kind]] + pii.STEP * bool(up & set(near)) - pii.STEP * bool({"version", "order", "sample"} & set(near))
            cut = text[max(0, start - 49) : max(0, start - 48)]  # a word that the context begins within may be another one
            if not cut.strip():
                assert score == round(min(1.0, max(0.0, want)), 2), (text, start)
        assert all(pii.KINDS[k] != "iban" or s >= pii.IBAN_SCORE for _, k, _, s in pii.find(text))


def test_redaction():
    assert pii.redacted("mail a@b.co or +1 555 010 9999!") == "mail [EMAIL] or [PHONE]!"


def test_random_tokens_are_found_and_words_are_not():
    r = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = ["".join(r.choice(letters) for _ in range(44)) for _ in range(200)]
    assert sum(bool(secret_scan.scan(t)[1]) for t in tokens) > 190
    words = ["Donaudampfschifffahrtsgesellschaft", "some-long-identifier-of-words-2024", "aaaaaaaaaaaaaaaaaaaaaaaa1A", "https//example/path/to/page/index"]
    assert not any(secret_scan.scan(w)[1] for w in words)
    assert secret_scan.battery([0] * 40, 64) < 1e-6


def test_battery_equals_another_computation():
    """Chi-squared, runs and serial correlation by numpy; the tails by integration."""
    r = np.random.default_rng(3)

    def tail(x, df):
        t = np.linspace(0, 1, 200_001)[1:-1]  # x + t / (1 - t) up to infinity
        y = x + t / (1 - t)
        return (y ** (df / 2 - 1) * np.exp(-y / 2) / (2 ** (df / 2) * math.gamma(df / 2)) / (1 - t) ** 2).mean()

    def normal(z):
        return 2 * (1 - statistics.NormalDist().cdf(abs(z)))

    for size, n in ((16, 24), (62, 40), (64, 100), (32, 33)):
        v = r.integers(0, size, n)
        cells = min(secret_scan.MAX_CELLS, max(2, n // 5))
        observed = np.bincount(v * cells // size, minlength=cells)
        expected = np.bincount(np.arange(size) * cells // size, minlength=cells) * n / size
        chi = tail(((observed - expected) ** 2 / expected).sum(), cells - 1)
        high = v > (size - 1) / 2
        a, b = high.sum(), n - high.sum()
        mean = 1 + 2 * a * b / n
        runs = normal(((np.diff(high) != 0).sum() + 1 - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)))
        d = v - (size - 1) / 2
        serial = normal((d[1:] * d[:-1]).sum() / ((size**2 - 1) / 12 * math.sqrt(n - 1)))
        fisher = tail(-2 * (math.log(chi) + math.log(runs) + math.log(serial)), 6)
        steps = 1.0
        for lag in (1, 2):
            k, m = np.bincount((v[lag:] - v[:-lag]) % size).max(), n - lag
            steps = min(steps, 2 * size * sum(math.comb(m, j) * (size - 1.0) ** (m - j) for j in range(k, m + 1)) / float(size) ** m)
        assert secret_scan.battery(v.tolist(), size) == pytest.approx(min(1, fisher / 0.9, steps / 0.1), abs=7e-3)


def test_battery_dismisses_few_random_strings():
    r = np.random.default_rng(4)
    for size, n in ((16, 40), (62, 32), (64, 64)):
        p = [secret_scan.battery(r.integers(0, size, n).tolist(), size) for _ in range(2000)]
        assert sum(x < secret_scan.DISMISS for x in p) < 2000 * 4 * secret_scan.DISMISS and 0.4 < sum(x < 0.5 for x in p) / 2000 < 0.6


@pytest.mark.parametrize("n", [1, 7, 60, 399, 400, 401, 2000])
def test_exact_tail(n):
    p = fractions.Fraction(1, 10)
    whole = [math.comb(n, j) * 9 ** (n - j) for j in range(n + 1)]
    for k in {0, 1, n // 20, n // 10, n // 10 + 1, n // 5, n // 2, n, n + 1}:
        assert secret_scan.at_least(k, n, float(p)) == pytest.approx(float(fractions.Fraction(sum(whole[k:]), 10**n)), rel=1e-9, abs=1e-300)


def test_ordinary_strings():
    strings = ("some-long-identifier-of-words-2024", "getUserNameFromDatabaseTable2", "/usr/lib/python3/dist-packages/x", "Q1/Q2/Q3/Q4/report_2024-01-31")
    assert all(secret_scan.ordinary(t) > 0.04 for t in strings)
    assert secret_scan.ordinary("Zq8f7Gh2Kx9Lm3Np0Rt5Vw1Yb4") < 1e-6
    one = "q1" * 200
    assert secret_scan.ordinary(one[:400]) == pytest.approx(secret_scan.ordinary(one[:400] + "q"), abs=1e-9)  # no step at 400 characters


#: Identifiers as programs and tables have them, counted up, with versions, dates and numbers.
IDENTIFIERS = """a1b2c3d4e5f6g7h8i9j0k1l2 A1B2C3D4E5F6G7H8I9J0K1L2 abc123def456ghi789jkl012 a0b1c2d3e4f5a6b7c8d9e0f1 1a2b3c4d5e6f7g8h9i0j1k2l
x1y1x2y2x3y3x4y4x5y5x6y6 AAA111BBB222CCC333DDD444 Q1Q2Q3Q4Q1Q2Q3Q4Q1Q2Q3Q4 r0c0r0c1r0c2r1c0r1c1r1c2r2c0 k1v1k2v2k3v3k4v4k5v5k6v6 0a1b2c3d4e5f6a7b8c9d0e1f
getUserNameFromDatabaseTable2 parseHttp2ResponseHeaderV1 testCase0123WithLongNameAndNumber45 src/lib/python3/site-packages/numpy2 report_2024-01-31_final_v2
user_profile_picture_256x256 customer-order-line-item-00012345 ResNet50WithBatchNormAndDropout2d sha256OfTheWholeContentOfAFile version1beta2candidate3""".split()


def test_ordinary_identifiers_and_keys(spark):
    """Of keys nearly all are reported, and of what is reported no more than the rate are ordinary identifiers."""
    r = random.Random(21)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(letters) for _ in range(r.choice((24, 32, 40, 64)))) for _ in range(100)]
    rows = list(enumerate(keys + IDENTIFIERS))
    found = [x["doc_id"] for x in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).where("n_random > 0").collect()]
    ordinary = [rows[i][1] for i in found if i >= 100]
    assert len(found) - len(ordinary) >= 90 and len(ordinary) <= secret_scan.RATE * len(found), ordinary


def test_strings_that_count_up_are_dismissed():
    for token in IDENTIFIERS[:11]:
        assert not [x for x in secret_scan.scan(token)[1] if x[5] < 0.01], token


def plain_random(texts, rate=secret_scan.RATE):
    """Reported strings by the step-up procedure over all tests at once, from the largest rank down."""
    found = [(i, *x) for i, t in enumerate(texts) for x in secret_scan.scan(t)[1]]
    tests = [sum(x) for x in zip(*(secret_scan.scan(t)[2] for t in texts), strict=True)]
    out = set()
    for cls, n in enumerate(tests):
        p = sorted(x[5] for x in found if x[4] == cls)
        rank = max((k for k, value in enumerate(p, 1) if value <= rate * k / n), default=0)
        out |= {(i, s, e) for i, s, _, e, c, value in found if c == cls and rank and value <= p[rank - 1]}
    return out


def test_reported_strings_equal_the_step_up_procedure(spark):
    r = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = ["".join(r.choice(letters) for _ in range(r.choice((20, 26, 40, 70)))) for _ in range(60)]
    names = ["".join(r.choice((letters[:26], letters[26:52], letters[52:])) [r.randrange(10)] * r.randint(1, 12) for _ in range(9)) for _ in range(300)]
    texts = [" ".join(r.sample(some, 1) + r.sample(names, 6)) for _ in range(60)] + ["Q1" * 20, "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["doc_id"], int(s), int(e)) for x in secret_scan.find_secrets(df).collect() for k, s, e in (y.split(":") for y in x["spans"].split(",") if y) if k == "random"}
    assert got == plain_random(texts) and len(got) > 30
    assert not any(i == 60 for i, _, _ in got)  # many changes, but not random


def test_keys_joined_by_marks_are_tested():
    key, url, rest = "Zq8f7Gh2Kx9Lm3Np0Rt5Vw1Yb4", "Zq8f7Gh2-x9Lm3Np0Rt5V_1Yb4Tk", "Zq8f7Gh2/x9Lm3Np0Rt5V+1Yb4Tk"
    for before, token, behind in (("/my-site/v1/", key, ""), ("user_name-", key, "+x/y"), ("/some/path/", url, ""), ("my-name_", rest, "==")):
        text = before + token + behind
        spans = [(s, e) for s, _, e, *_ in secret_scan.scan(text)[1]]
        assert len(spans) == 1 and spans[0][0] <= len(before) and spans[0][1] >= len(before + token), text
    assert secret_scan.scan("see /my-site/v1/path_of/some-page+name/and/so-on_2024/x+y")[1] == []


@pytest.mark.parametrize("run,base", [(pii.find_pii, plain_pii), (secret_scan.find_secrets, plain_secrets)])
def test_odd_documents(spark, odd_docs, odd_texts, no_docs, run, base):
    rows = run(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 1
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(",".join(base(odd_texts[r["doc_id"]] or "")).encode()).hexdigest()
    assert run(no_docs).count() == 0
    extra = spark.createDataFrame([(1, "password = Zq8f7Gh2Kx9Lm3Np0Rt5Vw1Yb4 and DE89370400440532013000, mail me: a@b.co")], "doc_id long, text string")
    (r,) = run(extra).collect()
    assert r["spans"]


def test_redact_keeps_rows(odd_docs):
    out = pii.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert out.where("doc_id = 3 and text is null").count() == 1
