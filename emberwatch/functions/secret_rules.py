"""Shapes of secrets and personal data: what they look like, what must be in a text that has one, and the two dialects they are matched in.

A rule's pattern is written once, for engines that never walk back (RE2, the oracle's). Spark's engine walks back, so ``java`` states the
same matches with a start that no position walks to again: a look behind at a run's beginning, and runs that give nothing back.
"""

from __future__ import annotations

from typing import NamedTuple

_WORD = "0-9A-Za-z_"
_DASHED = r"0-9A-Za-z_\-"


class SecretRule(NamedTuple):
    """``core`` matches from the secret's first character on. No character of ``before`` stands in front of it, and with ``whole`` no word
    character behind it. A text without any of ``literals`` has no match (no literals: any text may); with ``run``, neither has one
    without a run of LEAST_RUN characters of RUN."""

    name: str
    core: str
    literals: tuple[str, ...] = ()
    before: str = _WORD
    whole: bool = False
    run: bool = True
    example: str = ""
    java_core: str | None = None


LEAST_RUN, RUN = 16, r"0-9A-Za-z_+/=\-"


def _fill(n: int, letters: str = "4bC7dE2fG9hJ6kL3mN8pQ5rS") -> str:
    return (letters * (n // len(letters) + 1))[:n]


def _hex(n: int) -> str:
    return _fill(n, "4b7d2f9a6c3e8051")


def _upper(n: int) -> str:
    return _fill(n, "4BC7DE2FG9HJ6KL3")


def _prefixed(name: str, prefix: str, least: int, letters: str = _DASHED, fill=_fill, most: str = ",") -> SecretRule:
    """Issuers that start their tokens with a mark of their own, followed by a run."""
    return SecretRule(name, f"{prefix.replace('.', chr(92) + '.')}[{letters}]{{{least}{most}}}", (prefix,), example=prefix + fill(least))


def _exact(name: str, prefix: str, n: int, letters: str, fill=_fill) -> SecretRule:
    return _prefixed(name, prefix, n, letters, fill, "")._replace(whole=True)


# Marks, alphabets and lengths as issuers document them for their own tokens.
SECRET_RULES = [
    SecretRule("token_assignment", r'''(?i)(?:token|secret|password|api_key)[\x09-\x0d ]*[=:][\x09-\x0d ]*["'][0-9a-z_\-]{16,}["']''', before="", example=f'password = "{_fill(20)}"'),
    # The scheme is a whole run of its letters.
    SecretRule(
        "connection_string", r"[a-z][a-z0-9+]+://[^\x09-\x0d :/@]+:[^\x09-\x0d /@]+@[^\x09-\x0d /]+", ("://",), "a-z0-9+", run=False,
        example="db+driver://someone:pa55@host.example:5432", java_core=r"[a-z][a-z0-9+]++://[^\x09-\x0d :/@]++:[^\x09-\x0d /@]++@[^\x09-\x0d /]++",
    ),
    # The whole block, to the end of the text if it is not closed.
    SecretRule(
        "private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", ("PRIVATE KEY-----",), "", run=False,
        example="-----BEGIN RSA PRIVATE KEY-----\n4bC7dE2fG9hJ\n-----END RSA PRIVATE KEY-----",
    ),
    SecretRule("aws_key_id", r"(?:AKIA|ASIA)[0-9A-Z]{16}", ("AKIA", "ASIA"), whole=True, example="AKIA" + _upper(16)),
    SecretRule(
        "aws_secret_key", r'(?i)aws_secret_access_key[\x09-\x0d ]*[=:][\x09-\x0d ]*["\']?[0-9a-z/+]{40}', (), "", example="aws_secret_access_key = " + _fill(40),
    ),
    SecretRule("github_token", r"gh[pousr]_[0-9A-Za-z]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), example="ghp_" + _fill(36)),
    _prefixed("github_fine_token", "github_pat_", 22, _WORD),
    _prefixed("gitlab_token", "glpat-", 20),
    _prefixed("gitlab_deploy_token", "gldt-", 20),
    _prefixed("gitlab_runner_token", "glrt-", 20),
    _prefixed("gitlab_agent_token", "glagent-", 50),
    _prefixed("gitlab_feed_token", "glft-", 20),
    _exact("gitlab_trigger_token", "glptt-", 40, "0-9a-f", _hex),
    SecretRule("slack_token", r"xox[abeoprs]-[0-9A-Za-z\-]{10,}", ("xox",), run=False, example="xoxb-" + _fill(24)),
    SecretRule("slack_app_token", r"xapp-[0-9]-[0-9A-Z]{8,}-[0-9]{8,}-[0-9a-z]{32,}", ("xapp-",), example="xapp-1-A0BC7DE2F-1234567890-" + _hex(40)),
    SecretRule("slack_webhook", r"https://hooks\.slack\.com/services/[0-9A-Za-z/]{20,}", ("https://hooks.slack.com/",), "", example="https://hooks.slack.com/services/T0BC7DE2F/" + _fill(24)),
    SecretRule(
        "discord_webhook", r"https://discord(?:app)?\.com/api/webhooks/[0-9]{8,}/[0-9A-Za-z_\-]{20,}", ("https://discord",), "",
        example="https://discord.com/api/webhooks/1234567890/" + _fill(40),
    ),
    SecretRule("stripe_key", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", ("k_live_", "k_test_"), example="sk_" + "live_" + _fill(24)),
    _prefixed("stripe_webhook_secret", "whsec_", 32, "0-9A-Za-z"),
    _prefixed("google_api_key", "AIza", 35, most=""),
    _prefixed("google_client_secret", "GOCSPX-", 28, most=""),
    _prefixed("google_access_token", "ya29.", 20),
    SecretRule(
        "google_client_id", r"[0-9]{10,14}-[0-9a-z]{32}\.apps\.googleusercontent\.com", (".apps.googleusercontent.com",),
        example="123456789012-" + _hex(32) + ".apps.googleusercontent.com",
    ),
    SecretRule(
        "json_web_token", r"eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]*", ("eyJ",), _DASHED, run=False,
        example="eyJ" + _fill(20) + ".eyJ" + _fill(30) + "." + _fill(40), java_core=r"eyJ[0-9A-Za-z_\-]{8,}+\.[0-9A-Za-z_\-]{8,}+\.[0-9A-Za-z_\-]*+",
    ),
    _exact("npm_token", "npm_", 36, "0-9A-Za-z"),
    _prefixed("pypi_token", "pypi-", 16),
    _exact("rubygems_key", "rubygems_", 48, "0-9a-f", _hex),
    _exact("nuget_key", "oy2", 43, "0-9a-z", _hex),
    _exact("crates_token", "cio", 32, "0-9A-Za-z"),
    _exact("clojars_token", "CLOJARS_", 60, "0-9a-z", _hex),
    _prefixed("docker_hub_token", "dckr_pat_", 27),
    SecretRule(
        "sendgrid_key", r"SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}", ("SG.",), _DASHED, example="SG." + _fill(22) + "." + _fill(43),
        java_core=r"SG\.[0-9A-Za-z_\-]{16,}+\.[0-9A-Za-z_\-]{16,}+",
    ),
    _exact("mailgun_key", "key-", 32, "0-9a-zA-Z"),
    SecretRule("mailchimp_key", r"[0-9a-f]{32}-us[0-9]{1,2}", ("-us",), whole=True, example=_hex(32) + "-us12"),
    SecretRule("brevo_key", r"xkeysib-[0-9a-f]{64}-[0-9A-Za-z]{16}", ("xkeysib-",), whole=True, example="xkeysib-" + _hex(64) + "-" + _fill(16)),
    SecretRule("twilio_id", r"(?:AC|SK)[0-9a-f]{32}", ("AC", "SK"), whole=True, example="AC" + _hex(32)),
    _prefixed("hugging_face_token", "hf_", 30, "0-9A-Za-z"),
    _exact("replicate_token", "r8_", 37, "0-9A-Za-z"),
    _prefixed("groq_key", "gsk_", 48, "0-9A-Za-z"),
    _exact("perplexity_key", "pplx-", 48, "0-9A-Za-z"),
    _prefixed("model_api_key", "sk-", 20),
    SecretRule("telegram_bot_token", r"[0-9]{8,10}:[0-9A-Za-z_\-]{35}", (":",), example="123456789:" + _fill(35)),
    SecretRule("digitalocean_token", r"do[opr]_v1_[0-9a-f]{64}", ("_v1_",), whole=True, example="dop_v1_" + _hex(64)),
    _prefixed("heroku_key", "HRKU-", 58),
    _prefixed("fly_token", "fo1_", 43, most=""),
    _exact("netlify_token", "nfp_", 36, "0-9A-Za-z"),
    _exact("render_key", "rnd_", 32, "0-9A-Za-z"),
    SecretRule("shopify_token", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", ("shp",), whole=True, example="shpat_" + _hex(32)),
    SecretRule("square_token", r"sq0[a-z]{3}-[0-9A-Za-z_\-]{22,}", ("sq0",), example="sq0atp-" + _fill(22)),
    SecretRule(
        "braintree_token", r"access_token\$(?:production|sandbox)\$[0-9a-z]{16}\$[0-9a-f]{32}", ("access_token$",), whole=True,
        example="access_token$production$" + _hex(16) + "$" + _hex(32),
    ),
    SecretRule("azure_account_key", r"AccountKey=[0-9A-Za-z+/]{86}==", ("AccountKey=",), "", example="AccountKey=" + _fill(86) + "=="),
    SecretRule("azure_client_secret", r"[0-9A-Za-z_~.]{3}8Q~[0-9A-Za-z_~.\-]{34}", ("8Q~",), r"0-9A-Za-z_~.\-", run=False, example="abc8Q~" + _fill(34)),
    _exact("databricks_token", "dapi", 32, "0-9a-f", _hex),
    SecretRule("grafana_service_token", r"glsa_[0-9A-Za-z]{32}_[0-9a-f]{8}", ("glsa_",), whole=True, example="glsa_" + _fill(32) + "_" + _hex(8)),
    _prefixed("grafana_cloud_token", "glc_", 32, "0-9A-Za-z+/"),
    _exact("new_relic_key", "NRAK-", 27, "0-9A-Z", _upper),
    _prefixed("sentry_token", "sntrys_", 60, "0-9A-Za-z+/=_"),
    SecretRule("dynatrace_token", r"dt0c01\.[0-9A-Z]{24}\.[0-9A-Z]{64}", ("dt0c01.",), whole=True, example="dt0c01." + _upper(24) + "." + _upper(64)),
    _exact("linear_key", "lin_api_", 40, "0-9A-Za-z"),
    _prefixed("notion_token", "ntn_", 40, "0-9A-Za-z"),
    SecretRule("airtable_token", r"pat[0-9A-Za-z]{14}\.[0-9a-f]{64}", ("pat",), whole=True, example="pat" + _fill(14) + "." + _hex(64)),
    _prefixed("atlassian_token", "ATATT3", 60, r"0-9A-Za-z_\-="),
    _prefixed("figma_token", "figd_", 40),
    SecretRule("postman_key", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}", ("PMAK-",), whole=True, example="PMAK-" + _hex(24) + "-" + _hex(34)),
    SecretRule(
        "hubspot_token", r"pat-(?:na|eu)1-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", ("pat-",), whole=True,
        example="pat-na1-" + "-".join(_hex(k) for k in (8, 4, 4, 4, 12)),
    ),
    _prefixed("typeform_token", "tfp_", 40, r"0-9A-Za-z_\-.")._replace(run=False),
    _prefixed("vault_service_token", "hvs.", 24),
    SecretRule("terraform_token", r"[0-9A-Za-z]{14}\.atlasv1\.[0-9A-Za-z_\-]{60,}", (".atlasv1.",), example=_fill(14) + ".atlasv1." + _fill(60)),
    _exact("pulumi_token", "pul-", 40, "0-9a-f", _hex),
    SecretRule("doppler_token", r"dp\.(?:pt|st|ct|sa|scim|audit)\.[0-9A-Za-z]{40,}", ("dp.",), example="dp.pt." + _fill(43)),
    SecretRule("planetscale_token", r"pscale_(?:tkn|pw|oauth)_[0-9A-Za-z_\-.=]{32,}", ("pscale_",), run=False, example="pscale_tkn_" + _fill(43)),
    _exact("supabase_token", "sbp_", 40, "0-9a-f", _hex),
    _exact("age_secret_key", "AGE-SECRET-KEY-1", 58, "0-9A-Z", _upper),
    # Personal data.
    SecretRule(
        "email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", ("@",), "", run=False, example="some.one@mail.example",
        # A name starts at its run's beginning, or where the last match ended.
        java_core=r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    ),
    SecretRule("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", (".",), whole=True, run=False, example="10.20.30.40"),
    SecretRule("card_number", r"[0-9]{16}", (), whole=True, example="4111111111111111"),
    SecretRule("phone", r"\+?[0-9]{1,3}[ \-][0-9]{3}[ \-][0-9]{3,4}[ \-]?[0-9]{2,4}", (), "", whole=True, run=False, example="+1 555 010 1234"),
]


def java(rule: SecretRule) -> str:
    """The rule's pattern for Spark, in which group 0 is the secret."""
    start = f"(?<![{rule.before}])" if rule.before else ""
    return _flags_first(start, rule.java_core or rule.core) + (f"(?![{_WORD}])" if rule.whole else "")


def re2(rule: SecretRule) -> str:
    """The same for RE2, in which group 1 is what stands in front of the secret, if the rule asks for that."""
    start = "" if not rule.before else r"\b" if rule.before == _WORD else f"(^|[^{rule.before}])"
    return _flags_first(start, rule.core) + (r"\b" if rule.whole else "")


def re2_replacement(rule: SecretRule) -> str:
    return (r"\1" if rule.before not in ("", _WORD) else "") + f"[{rule.name.upper()}]"


def _flags_first(start: str, core: str) -> str:
    flags, rest = (core[:4], core[4:]) if core[:2] == "(?" and core[3:4] == ")" else ("", core)
    return flags + start + rest


# Phrases by which a message asks for secrets: for RE2, and for Spark so that a line is walked once.
EXTRACTION_PHRASES = [
    (r"(?i)ignore (all )?previous instructions", r"(?i)ignore (?:all )?previous instructions"),
    (
        r"(?i)(print|show|reveal|repeat|output) (me )?(your|the) (system prompt|secret|password|token|api key)",
        r"(?i)(?:print|show|reveal|repeat|output) (?:me )?(?:your|the) (?:system prompt|secret|password|token|api key)",
    ),
    # After the first such words of a line every later ones add nothing.
    (r"(?i)environment variables? .*(base64|hex|reverse)", r"(?idm)^(?>.*?environment variables? ).*?(?:base64|hex|reverse)"),
]
