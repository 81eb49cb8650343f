"""Masking equals the replacement of one finding after the other, in time that grows with the text."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilstream.operators import redact as R
from veilstream.operators.detectors import FINDINGS
from veilstream.operators.inspect import inspect
from veilstream.operators.policy import policy


def fold(text, pairs):
    for s, r in pairs:
        if s and r is not None:
            text = text.replace(s, r)
    return text


_bits = st.text(st.sampled_from("ab[]R"), max_size=5)
_masks = st.sampled_from(["[R]", "[aR]", "b", "ab", "[", "", None, "[REDACTED_A]", "]["])


@settings(max_examples=3000, deadline=None)
@given(st.text(st.sampled_from("ab[]R "), max_size=40), st.lists(st.tuples(_bits, _masks), min_size=R.FEW + 1, max_size=24))
def test_equal_to_the_fold(text, pairs):
    pairs = pairs + [("zz", "[R]")] * (R.FEW + 1)
    m = R.Masker(pairs)
    assert m(text) == fold(text, pairs)
    assert m(text + text) == fold(text + text, pairs)  # nothing is kept from one text to the next


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("abc "), max_size=60), st.lists(st.text(st.sampled_from("abc"), min_size=1, max_size=6), max_size=30))
def test_overlapping_free_snippets(text, snippets):
    pairs = [(s, f"[MASK_{i % 3}]") for i, s in enumerate(snippets)] + [("x", "[MASK_0]")] * 9
    assert R.Masker(pairs)(text) == fold(text, pairs)


def _addresses(n):
    text = " ".join(f"u{i:05d}@mail.org" for i in range(n))
    return text, [(x, "[REDACTED_EMAIL]") for x in text.split(" ")]


def test_twenty_thousand_findings_take_linear_time():
    def seconds(n):
        text, pairs = _addresses(n)
        began = time.perf_counter()
        assert R.Masker(pairs)(text) == " ".join(["[REDACTED_EMAIL]"] * n)
        return time.perf_counter() - began

    seconds(1000)
    few, many = min(seconds(5000) for _ in range(3)), min(seconds(20_000) for _ in range(3))
    assert many < 2 and many < 4 * 3 * few  # four times the text


def test_repeats_and_snippets_with_brackets():
    pairs = [("pass: [x]", "[REDACTED_PASSWORD]"), ("[x]", "[R]"), ("a@b.de", "[REDACTED_EMAIL]"), ("[REDACTED_EMAIL", "?")] * 2000
    text = "a@b.de pass: [x] [x] [REDACTED_EMAIL] " * 2000
    began = time.perf_counter()
    got = R.Masker(pairs)(text)
    assert time.perf_counter() - began < 5
    assert got == fold(text, pairs[:12])


def test_both_ways_give_the_same_column(spark, monkeypatch):
    rows = [(1, *_addresses(300)), (2, "a short one u1@mail.org", [("u1@mail.org", "[M]"), ("u1", None), ("", "x")]), (3, None, [("a", "b")]), (4, "no findings", []), (5, "x" * 5000, [("x", "y")] * 40)]
    df = spark.createDataFrame([(i, t, [("Pii", "n", s, "LOW", r) for s, r in pairs]) for i, t, pairs in rows], f"id long, text string, findings {FINDINGS}")
    want = {i: None if t is None else fold(t, pairs) for i, t, pairs in rows}
    for limit in (0, 10**12):
        monkeypatch.setattr(R, "IN_SQL", limit)
        assert dict(df.select("id", R.redact(F.col("text"), F.col("findings"))).collect()) == want
        assert dict(df.select("id", R.redact_any(F.col("text"), F.col("findings"))).collect()) == want


def test_a_list_of_addresses_is_inspected_in_seconds(spark):
    text, _ = _addresses(20_000)
    df = spark.createDataFrame([(1, text)], "id long, text string")
    began = time.perf_counter()
    row = inspect(df, policy()).select("sanitized", F.size("findings").alias("n")).first()
    assert row.n == 20_000 and row.sanitized == " ".join(["[REDACTED_EMAIL]"] * 20_000)
    assert time.perf_counter() - began < 60  # building the plan included
