"""A long list of keywords gives what the unrolled rules give, in one pass and a plan of one size."""

import random
import time

from pyspark.sql import functions as F

from veilstream.operators import keywords as K
from veilstream.operators.keywords import KeywordAutomaton, KeywordRule, keyword_findings
from veilstream.operators.policy import category_action, policy

RULES = [
    KeywordRule("acme"), KeywordRule("a a"), KeywordRule("Straße"), KeywordRule("STRASSE"), KeywordRule("c++"), KeywordRule("#tag"), KeywordRule("++"), KeywordRule("aa"), KeywordRule("İstanbul"), KeywordRule("kelvin"),
    KeywordRule("Acme", case_sensitive=True), KeywordRule("σας"), KeywordRule("new york", action="Block"), KeywordRule("x.y", case_sensitive=True), KeywordRule("(a|b)"), KeywordRule("é"), KeywordRule("acme"), KeywordRule("漢字"), KeywordRule("a_b"), KeywordRule("9"),
]
PARTS = ["acme", "ACME", "Acme", "a a", " a", "aa", "straße", "STRASSE", "c++", "C++", "#TAG", "++", "İstanbul", "istanbul", "ISTANBUL", "Kelvin", "ΣΑΣ", "σασ", "New York", "x.y", "xzy", "(A|B)", "É", "é", "漢字", "a_b", "9", "٩", " ", " ", ", ", "_", "\n", "ſ", "", "🙂"]


def test_both_forms_agree(spark, monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(14))) for _ in range(600)] + ["", "xa a a", "aaa aa", "a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    packed = dict(df.select("id", keyword_findings(F.col("text"), RULES)).collect())
    monkeypatch.setattr(K, "UNROLLED", 99)
    unrolled = dict(df.select("id", keyword_findings(F.col("text"), RULES)).collect())
    assert packed == unrolled and sum(map(len, packed.values())) > 300


def test_actions_of_a_long_list(spark):
    rules = [KeywordRule(f"word{i}", action="Block" if i % 2 else "Audit") for i in range(40)] + [KeywordRule("word1", action="Allow")]
    p = policy(keywords=rules)
    df = spark.createDataFrame([(1, "a word1 here"), (2, "a word2"), (3, "none")], "id long, text string")
    assert dict(df.select("id", category_action(keyword_findings(F.col("text"), rules), p)).collect()) == {1: "Block", 2: "Audit", 3: "Allow"}


def test_twenty_thousand_keywords(spark):
    rules = [KeywordRule(f"term{i:05d}") for i in range(20_000)]
    text = " ".join(f"term{i * 7 % 30_000:05d} filler" for i in range(20_000))
    automaton = KeywordAutomaton(rules)
    began = time.perf_counter()
    places = automaton.places(text)
    assert time.perf_counter() - began < 2
    assert len(places) == sum(i * 7 % 30_000 < 20_000 for i in range(20_000))
    plan = lambda n: len(spark.range(1).select(keyword_findings(F.lit(text), rules[:n]))._jdf.queryExecution().analyzed().toString())
    assert plan(20) == plan(20_000)
