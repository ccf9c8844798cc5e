"""Rules in both dialects, their time on long texts, what redaction leaves, and the vault index."""

import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F
from test_decision import MAIL, SECRET, forms

from emberwatch.functions.secret_rules import EXTRACTION_PHRASES, SECRET_RULES, re2, re2_replacement
from emberwatch.operators import secrets as secret_operators
from emberwatch.operators.redaction import CLOSE, NAMED, OPEN, marked_spans, replaced, shown_places
from emberwatch.operators.secrets import gram_rows, has_phrase, judge, redact, rule_counts, rule_hits, vault_matches, vault_tokens


def test_each_rule_finds_its_example(spark):
    df = spark.createDataFrame([(r.name, f"see {r.example} end") for r in SECRET_RULES], "rule string, text string")
    for row in df.select("rule", rule_hits(F.col("text")).alias("hits"), redact(F.col("text")).alias("left")).collect():
        example = next(r.example for r in SECRET_RULES if r.name == row.rule)
        assert row.rule in row.hits and example not in row.left, row
    assert len(SECRET_RULES) >= 60


def odd_texts():
    """Pieces of examples next to what may or may not stand beside them."""
    rng = random.Random(12)
    pieces = [r.example for r in SECRET_RULES]
    pieces += [p[: rng.randrange(1, len(p))] for p in pieces] + ["a@b.com@c.org", "x.y@z", "@", "://", "eyJ-eyJ-", "9http://u:p@h/", "Xdb://u:p@h", "token=", "'", '"']
    for _ in range(400):
        yield "".join(rng.choice(pieces) + rng.choice(["", " ", ".", "-", "_", "a", "9", "\n", "/", ":", "="]) for _ in range(rng.randint(1, 5)))


def test_both_dialects_agree(spark):
    texts = list(odd_texts())
    got = rule_counts(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "text", "k").orderBy("k").collect()
    shown = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", redact(F.col("text")).alias("x")).orderBy("k").collect()
    con = duckdb.connect()
    counts = ", ".join(f"len(regexp_extract_all($1, '{re2(r).replace(chr(39), chr(39) * 2)}'))" for r in SECRET_RULES)
    left = "$1"
    for r in SECRET_RULES:
        left = f"regexp_replace({left}, '{re2(r).replace(chr(39), chr(39) * 2)}', '{re2_replacement(r)}', 'g')"
    for k, text in enumerate(texts):
        assert tuple(got[k])[1:] == con.execute(f"SELECT {counts}", [text]).fetchone(), text
        assert shown[k].x == con.execute(f"SELECT {left}", [text]).fetchone()[0], text
    assert sum(map(sum, (tuple(r)[1:] for r in got))) > 400


@pytest.mark.parametrize(
    "text",
    ["0123456789abcdef" * 65_536, "a1" * 500_000 + "@", "a1b." * 250_000 + "://@", "eyJ-" * 250_000 + ".", "SG." * 300_000, "token " * 160_000 + "=:",
     "environment variables " * 45_000, "-----BEGIN " * 90_000, "db://u" * 160_000, "x@" * 500_000, "1 234 " * 160_000],
    ids=["hex", "name", "dots", "tokens", "keys", "words", "phrases", "blocks", "schemes", "ats", "numbers"],
)
def test_a_long_text_takes_linear_time(spark, text):
    df = spark.range(1).select(F.repeat(F.lit(text[:1000]), len(text) // len(text[:1000])).alias("text")) if len(set(text[:1000])) < 2 else None
    df = df if df is not None else spark.createDataFrame([(0, text)], "k long, text string")
    rule_counts(df.limit(0), "text", "text").collect()
    began = time.perf_counter()
    rule_counts(df, "text").collect()
    df.select(F.length(redact(F.col("text"))), has_phrase(F.col("text"))).collect()
    assert time.perf_counter() - began < 8


def test_phrases_in_both_dialects(spark):
    rng = random.Random(2)
    parts = ["environment variable ", "environment variables ", "ENVIRONMENT variables", "base64", "hex", "\n", "\r", " x ", "\u2028"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(500)]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "k long, t string").orderBy("k").select(has_phrase(F.col("t")).alias("x")).collect()]
    want = [any(duckdb.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0] for p, _ in EXTRACTION_PHRASES) for t in texts]
    assert got == want and 50 < sum(want) < 450


def test_what_is_flagged_is_gone_after_redaction(spark):
    """Every text to redact is one to allow once it is redacted, and keeps the words around."""
    secrets = [MAIL, SECRET[:24], "db://me:pw@host", "q7Zx2LmV9sKd4RtY8wBn3HfC6jPa", "3f9a1c7e5b2d8046", *[r.example for r in SECRET_RULES if "\n" not in r.example]]
    rows = [(k, 0, "user", f"before {form(secret)} after 100% sure") for k, (form, secret) in enumerate((f, s) for s in secrets for f in forms().values())]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    vault = spark.createDataFrame([(1, SECRET)], "secret_id long, secret string")
    once = judge(turns, vault).collect()
    assert len(once) == len(rows) and {r.decision for r in once} == {"REDACT"}
    for r in once:
        assert r.redacted.startswith("before") and r.redacted.endswith("sure") and r.redacted != rows[r.conv_id][3], r
    again = spark.createDataFrame([(r.conv_id, 0, "user", r.redacted) for r in once], "conv_id long, turn long, role string, text string")
    assert {r.decision for r in judge(again, vault).collect()} == {"ALLOW"}


def test_places_of_hidden_spans():
    mark = lambda name, x: f"{OPEN}{name}{NAMED}{x}{CLOSE}"
    assert marked_spans("a" + mark("X", "b" + mark("Y", "c") + "d") + "e" + mark("Z", "f")) == [(1, 4, "X"), (5, 6, "Z")]
    assert replaced("a\u200bb%40c é%C3%A9 z", "a\u200bb%40c é%C3%A9 z", "ab@c éé z", "a" + mark("AT", "b@c") + " é" + mark("E", "é") + " z", []) == "a\u200b[AT] é[E] z"
    assert replaced("%FF x", "%FF x", "\ufffd x", mark("N", "\ufffd") + " x", []) == "[N] x"
    assert replaced("%41", "%41", "other", mark("N", "other"), []) == "[HIDDEN]"
    assert replaced(None, None, None, None, None) is None and shown_places("", "") == []


def test_vault_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n))
    secrets = [(k, word(rng.choice([4, 8, 12, 30, 60]))) for k in range(60)] + [(90 + k, "shared-head-of-all-" + word(12)) for k in range(60)]
    tokens = [s[a : a + rng.randint(8, 60)] for _, s in secrets for a in (0, rng.randrange(max(1, len(s) // 2)))] + [word(40) for _ in range(60)]
    tokens += ["shared-head-of-all-" + word(12) for _ in range(200)] + [secrets[70][1] * 3, "short", "A" * 30]
    grams = lambda s: {s[i : i + 8] for i in range(len(s) - 7)}
    for share in (0.5, 0.8, 0.01, 1.0):
        want = {(t, k, len(grams(s)), len(grams(s) & grams(t))) for t in tokens for k, s in secrets if grams(s) & grams(t) and len(grams(s) & grams(t)) >= share * len(grams(s))}
        df, vault = spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(secrets, "secret_id long, secret string")
        got = {tuple(r) for r in vault_matches(df, vault, 8, share).collect()}
        assert got == want and len(want) > 50


def test_tokens_of_alike_entries_meet_one_entry(spark, monkeypatch):
    """Whether a token matches is told without its pairs with every entry that is alike; the pairs themselves are the same."""
    rng = random.Random(7)
    secrets = [(k, f"horse-battery-{k:05d}-staple") for k in range(300)] + [(None, "of nobody at all"), (900, None), (901, "short"), (902, "0123456789abcdef")]
    tokens = [f"horse-battery-{k:05d}-stap" for k in range(0, 600, 2)] + ["0123456789abcdefgh", "of nobody at all", "89abcdef01234567"]
    tokens += ["".join(rng.choice("abcdef") for _ in range(30)) for _ in range(20)] + tokens[:9]
    df, vault = spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(secrets, "secret_id long, secret string")
    pairs = vault_matches(df, vault)
    left, matches = [], secret_operators._matches
    monkeypatch.setattr(secret_operators, "_matches", lambda rest, *more: left.extend(r.token for r in rest.select("token").collect()) or matches(rest, *more))
    got = [bytes(r[0]).hex() for r in vault_tokens(df, vault).collect()]
    want = {r.token for r in pairs.collect()}
    assert sorted(got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in want) and len(want) > 150
    # Tokens of the group whose own entry is there are settled by it.
    assert not {f"horse-battery-{k:05d}-stap" for k in range(0, 300, 2)} & set(left)


def test_grams_stay_out_of_the_driver(spark):
    """The planner takes exploded grams for small, whatever their number; no join of them sends a side through the driver."""
    secrets = [(k, f"{k:08d}" * 400) for k in range(20)]
    vault, df = spark.createDataFrame(secrets, "secret_id long, secret string"), spark.createDataFrame([(s,) for _, s in secrets], "token string")
    for found in (vault_matches(df, vault), vault_tokens(df, vault)):
        assert len(found.collect()) >= 20
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_grams_of_a_very_long_token(spark):
    df = spark.createDataFrame([(1, "x" * 5000 + "y" + "x" * 5000), (2, "abc"), (3, None)], "k long, t string")
    got = {(r.k, r.gram) for r in gram_rows(df, "t", 8).collect()}
    assert got == {(1, "x" * 8)} | {(1, "x" * i + "y" + "x" * (7 - i)) for i in range(8)}
    long = spark.range(1).select(F.lit(1).alias("k"), F.expr("array_join(transform(sequence(1, 1200000), i -> conv(i, 10, 16)), '')").alias("t"))
    assert gram_rows(long, "t", 8).distinct().count() > 4_000_000
    assert re.fullmatch("[0-9A-F]{8}", gram_rows(long, "t", 8).first().gram)
