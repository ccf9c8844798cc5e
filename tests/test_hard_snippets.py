"""Snippets that used to hide findings or stop the job, and texts that kept their secrets."""

import ast

import pytest
from pyspark.sql import functions as F

from emberwatch.operators.bursts import sliding_count
from emberwatch.operators.policy import Policy
from emberwatch.operators.requests import correct_endpoints, resolve_aliases
from emberwatch.operators.scan import scan
from emberwatch.operators.secrets import redact, rule_hits
from emberwatch.operators.thinning import thin

LEAK = "import os\ntoken = os.environ['API_TOKEN']\nprint(token)\nx = token[0]\n"
DEEP = "y = " + " + ".join(["1"] * 5000) + "\n"


def test_deep_and_odd_code_is_judged_like_plain_code(spark):
    ast.parse(DEEP)
    codes = [LEAK, DEEP + LEAK, LEAK + "z = '\\ud800'\nprint(token['\\ud800'])\n", LEAK + "def broken(:\n"]
    df = spark.createDataFrame([(i, c, "python") for i, c in enumerate(codes)], "snippet_id int, code string, language string")
    plain, deep, odd, broken = scan(df, Policy(mode="block")).orderBy("snippet_id").collect()
    assert plain.n_findings > 0 and plain.blocked and plain.parsed
    assert deep.n_findings == plain.n_findings and deep.blocked and deep.parsed
    assert odd.n_findings > plain.n_findings and odd.parsed
    assert not broken.parsed


SECRETS = {
    "connection_string": "postgres://user:" + "p" * 80 + "@db:5432/x",
    "token_assignment": 'TOKEN  =  "' + "Ab1" * 8 + '"',
    "private_key": "-----BEGIN RSA PRIVATE KEY-----\nMIIBODY\nBODY2\n-----END RSA PRIVATE KEY-----",
    "aws_key_id": "AKIA" + "A1B2" * 4, "github_token": "ghp_" + "a1" * 18, "gitlab_token": "glpat-" + "a1" * 10,
    "slack_token": "xoxb-" + "1a" * 8, "slack_webhook": "https://hooks.slack.com/services/" + "T0/" * 8, "stripe_key": "sk_live_" + "a1" * 10,
    "google_api_key": "AIza" + "a" * 35, "json_web_token": "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 5, "npm_token": "npm_" + "a" * 36,
    "pypi_token": "pypi-" + "a" * 20, "sendgrid_key": "SG." + "a" * 20 + "." + "b" * 20, "twilio_id": "AC" + "0f" * 16,
    "hugging_face_token": "hf_" + "a" * 32, "model_api_key": "sk-" + "a1" * 12, "telegram_bot_token": "123456789:" + "a" * 35,
    "digitalocean_token": "dop_v1_" + "0f" * 32, "shopify_token": "shpat_" + "0f" * 16, "square_token": "sq0atp-" + "a" * 22,
    "azure_account_key": "AccountKey=" + "a" * 86 + "==",
}


@pytest.fixture(scope="module")
def redacted(spark):
    df = spark.createDataFrame([(k, f"before {v} after") for k, v in SECRETS.items()], "rule string, text string")
    rows = df.select("rule", rule_hits(F.col("text")).alias("hits"), redact(F.col("text")).alias("shown")).collect()
    return {r.rule: r for r in rows}


@pytest.mark.parametrize("rule", sorted(SECRETS))
def test_secret_shapes_are_found_and_redacted(redacted, rule):
    row = redacted[rule]
    assert rule in row.hits
    assert SECRETS[rule].split("\n")[-1] not in row.shown and "BODY2" not in row.shown and "p" * 70 not in row.shown


def test_repeated_names_do_not_multiply_requests(spark):
    requests = spark.createDataFrame([(1, "a", "http://old")], "id int, model string, api_base string")
    aliases = spark.createDataFrame([("a", "x", 1), ("a", "w", 2)], "alias string, target string, pos int")
    assert [r.resolved_model for r in resolve_aliases(requests, aliases, "pos").collect()] == ["w"]
    catalog = spark.createDataFrame([("a", "http://one", 1), ("a", "http://two", 2)], "model_name string, api_base string, pos int")
    assert [r.api_base for r in correct_endpoints(requests, catalog, "pos").collect()] == ["http://two"]


def test_null_keys_count(spark):
    rows = [(i, None if i % 2 else "k", i * 1_000_000) for i in range(20)]
    events = spark.createDataFrame(rows, "id long, key string, at long")
    counted = sliding_count(events, "at", "id", 4_000_000, ["key"]).collect()
    assert len(counted) == 20 and max(r.window_count for r in counted if r.key is None) == 3
    kept = thin(events.withColumn("wide", F.lit("w")), ["key"], "at", "id", 5_000_000).collect()
    assert len({r.id for r in kept if r.key is None}) == len({r.id for r in kept if r.key == "k"})
