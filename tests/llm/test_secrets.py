"""Secret scans against a plain-Python version: spans, entropy, redaction, long tokens and clashing names."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tallystream.llm import secret_scan as S

MORE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def entropy(s):
    n = min(20, len(s))
    return max((-sum(c / n * math.log2(c / n) for c in Counter(s[i : i + n]).values()) for i in range(len(s) - n + 1)), default=0.0)


def spans(text):
    base = []
    for k, (p, group, least) in enumerate([(S.ASSIGN, 2, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32)]):
        base += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[group]) >= least]
    found = list(base)
    for m in re.finditer(rf"(?<![{S._TOKEN}])[{S._TOKEN}]{{20,}}", text):
        w = m[0]
        if not re.search("[0-9]", w) or not re.search("[A-Za-z]", w) or any(a <= m.start() and m.end() <= e for a, _, e in base) or any(re.search(p, w) for p in S.ALLOWED):
            continue
        kind = "hex" if re.fullmatch("[0-9a-fA-F]+", w) else "upper" if re.fullmatch("[A-Z0-9]+", w) else "mixed"
        if entropy(w) >= S.THRESHOLDS[kind]:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def redacted(text):
    out, at = [], 0
    for a, _, e in spans(text):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def texts():
    rng = random.Random(4)
    token = lambda n, letters=MORE: "".join(rng.choice(letters) for _ in range(n))
    out = ["", " ", "é" * 30 + " password: '" + token(12, MORE[:60]) + "' é", "password=" + token(40, MORE[:62]) + token(20, "0123456789abcdef") * 2]
    for _ in range(40):
        parts = [rng.choice(["word", "é", "token = ", "passwd:", "AKIA" + token(rng.randint(8, 20), MORE[:26]), token(rng.randint(10, 60), "0123456789abcdef"), token(rng.randint(15, 60), MORE[:62]), token(rng.randint(19, 22)), "a1" * rng.randint(8, 14)]) for _ in range(rng.randint(1, 400))]
        out.append(rng.choice([" ", "", ", "]).join(parts))
    return out


def test_spans_and_redaction(spark):
    rows = [(i, t, "x", [1], "y") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, _open string, base_spans array<int>, raw_ string")
    for r in S.scan(df).collect():
        assert [tuple(x) for x in r.secret_spans] == spans(r.text) and r._open == "x" and r.raw_ == "y"
    clean = S.redact(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        assert r.text == redacted(rows[r.doc_id][1]) and tuple(r)[2:] == ("x", [1], "y")


def test_entropy_of_short_and_long_strings(spark):
    rng = random.Random(5)
    s = ["", "a", "ab", "aab" * 6, "a" * 25, *("".join(rng.choice(MORE) for _ in range(n)) for n in (19, 20, 21, 90, 3000))]
    for r in spark.createDataFrame([(x,) for x in s], "s string").select("s", S.window_entropy(F.col("s")).alias("e")).collect():
        assert abs(r.e - entropy(r.s)) < 1e-9, r.s


def test_time_is_linear(spark):
    rng = random.Random(6)
    token = "".join(rng.choice(MORE[:62]) for _ in range(100_000))
    many = " ".join(token[k : k + 30] for k in range(10_000))

    def took(text):
        df = spark.createDataFrame([(text,)], "text string").coalesce(1)
        began = time.perf_counter()
        n = len(S.scan(df).first().secret_spans)
        return n, time.perf_counter() - began

    took(token[:100])
    assert took(token)[0] == 1 and took(many)[0] > 9000
    (_, one), (_, two) = took(token), took(token + token[::-1])
    assert two < 3 * one + 1 and one < 15 and took(many)[1] < 20


def test_tokens_of_many_short_parts(spark):
    """100,000 parts, and a megabyte: no stack grows with the parts, and time grows with the length."""
    slug, mixed = "-".join(["ab", "12"] * 50_000), "/".join(["ab1"] * 100_000)

    def took(text):
        df = spark.createDataFrame([(text,)], "text string").coalesce(1)
        began = time.perf_counter()
        got = S.scan(df).first().secret_spans
        assert S.redact(df).first().text == (text if not got else "[SECRET]")
        return len(got), time.perf_counter() - began

    took(slug[:100])
    assert took(slug)[0] == 0 and took(mixed)[0] == 0  # the second one's windows hold few characters
    (n, one), (m, two) = took("ab-12-" * 87_500), took("ab-12-" * 175_000)
    assert n == m == 0 and two < 4 * one + 1
    long = "".join(random.Random(7).choice("ABCDEFGHabcdefgh0123456789") for _ in range(1_000_000))
    assert took(long)[0] == 1


def test_slugs_as_the_pattern_says(spark):
    rng = random.Random(8)
    s = ["".join(rng.choice("ab1-_/9Z=") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for r in spark.createDataFrame([(x,) for x in s], "s string").select("s", S._is_slug(F.col("s")).alias("y")).collect():
        assert r.y == bool(re.search(S.SLUG, r.s)), r.s
