"""Classifying recorded verification responses.  No request is ever sent from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keysift.operators.history import SALTS, salted_join
from keysift.sources.staging import materialized

# Which rules can be verified, and by whom.
VERIFIERS = {
    "github-pat": "github", "github-fine-grained-pat": "github", "github-oauth": "github",
    "github-app-token": "github",
    "slack-bot-token": "slack", "slack-user-token": "slack",
    "stripe-live-secret": "stripe", "stripe-test-secret": "stripe", "stripe-restricted-live": "stripe",
    "openai-api-key": "openai",
    "anthropic-api-key": "anthropic",
}
STRIPE_KINDS = {"sk_live_": "live", "sk_test_": "test", "rk_live_": "restricted_live"}
SHOWN_STATUSES = ("valid", "invalid", "revoked", "error")


def is_verifiable(rule_id: Column) -> Column:
    return rule_id.isin(*VERIFIERS)


def verifier_of(rule_id: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in VERIFIERS.items() for x in pair]), rule_id)


def detect_provider(secret: Column, fixed: bool = False) -> Column:
    """Provider by prefix; empty when unknown.

    Keys starting with ``sk-ant-api-`` come out as openai, because only nine characters are
    compared with that prefix; ``fixed=True`` tells them apart.
    """
    size = F.octet_length(secret)

    def starts(*prefixes: str) -> Column:
        found = F.lit(False)
        for prefix in prefixes:
            found = found | secret.startswith(prefix)
        return found

    found = F.when(size <= 4, "").when(starts("ghp_", "gho_", "ghs_"), "github")
    found = found.when(starts("xoxb", "xoxp"), "slack")
    found = found.when((size > 8) & starts("sk_test_", "sk_live_"), "stripe")
    if fixed:
        found = found.when(starts("sk-ant-api-"), "anthropic")
    return found.when(starts("sk-"), "openai").otherwise("")


def provider_rule(provider: Column, secret: Column) -> Column:
    """The rule id that verification uses for a provider and a secret."""
    size = F.octet_length(secret)
    return (F.when(provider == "github", "github-pat")
            .when(provider == "slack", F.when((size > 4) & secret.startswith("xoxb"), "slack-bot-token")
                  .otherwise("slack-user-token"))
            .when(provider == "stripe", F.when((size > 8) & secret.startswith("sk_live_"), "stripe-live-secret")
                  .otherwise("stripe-test-secret"))
            .when(provider == "openai", "openai-api-key")
            .when(provider == "anthropic", "anthropic-api-key")
            .otherwise(F.concat(provider, F.lit("-pat"))))


def classify_response(rule_id: Column, secret: Column, http_status: Column, body: Column,
                      transport_error: Column) -> Column:
    """struct(status, account, message, kind, error) for one recorded response."""
    by = verifier_of(rule_id)
    login = F.coalesce(F.get_json_object(body, "$.login"), F.lit(""))
    slack_ok = F.get_json_object(body, "$.ok")
    slack_team = F.coalesce(F.get_json_object(body, "$.team"), F.lit(""))
    slack_user = F.coalesce(F.get_json_object(body, "$.user"), F.lit(""))
    slack_error = F.coalesce(F.get_json_object(body, "$.error"), F.lit(""))
    readable = F.get_json_object(body, "$").isNotNull()
    project = secret.startswith("sk-proj-")
    stripe_kind = F.lit("unknown")
    for prefix, kind in STRIPE_KINDS.items():
        stripe_kind = F.when(secret.startswith(prefix), kind).otherwise(stripe_kind)

    def outcome(status, message, account="", kind="", error="") -> Column:
        values = {"status": status, "account": account, "message": message, "kind": kind, "error": error}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in values.items()])

    def unexpected(text: str) -> Column:
        return F.concat(F.lit(text), http_status.cast("string"))

    ok, refused, forbidden = http_status == 200, http_status == 401, http_status == 403
    github = (F.when(ok & (login != ""), outcome(
                  "valid", F.concat(F.lit("GitHub token valid for user: "), login), login))
              .when(ok, outcome("valid", "GitHub token is valid"))
              .when(refused, outcome("invalid", "GitHub token is invalid or expired"))
              .when(forbidden, outcome("revoked", "GitHub token has been revoked or rate limited"))
              .otherwise(outcome("error", unexpected("Unexpected response: "))))
    slack = (F.when(~readable, outcome("error", "", error="unreadable response"))
             .when(slack_ok == "true", outcome(
                 "valid", F.concat(F.lit("Slack token valid for team: "), slack_team, F.lit(", user: "), slack_user),
                 F.concat(slack_team, F.lit("/"), slack_user)))
             .otherwise(outcome("invalid", F.concat(F.lit("Slack token invalid: "), slack_error))))
    stripe = (F.when(ok, outcome("valid", F.concat(F.lit("Stripe "), stripe_kind, F.lit(" key is valid")),
                                 kind=stripe_kind))
              .when(refused, outcome("invalid", "Stripe key is invalid or revoked"))
              .otherwise(outcome("unknown", unexpected("Unexpected response from Stripe: "))))
    openai = (F.when(ok, outcome(
                  "valid", F.when(project, "OpenAI project API key is valid").otherwise("OpenAI API key is valid"),
                  kind=F.when(project, "project").otherwise("standard")))
              .when(refused, outcome("invalid", "OpenAI API key is invalid"))
              .otherwise(outcome("error", unexpected("Unexpected response: "))))
    anthropic = (F.when(ok, outcome("valid", "Anthropic API key is valid"))
                 .when(refused, outcome("invalid", "Anthropic API key is invalid"))
                 .otherwise(outcome("unknown", unexpected("Unexpected response from Anthropic: "))))
    return (F.when(by.isNull(), outcome(
                "unknown", F.concat(F.lit("Verification not available for rule: "), rule_id)))
            .when(F.coalesce(transport_error, F.lit("")) != "", outcome("error", "", error=transport_error))
            .when(by == "github", github).when(by == "slack", slack).when(by == "stripe", stripe)
            .when(by == "openai", openai).otherwise(anthropic))


def latest_response(responses: DataFrame) -> DataFrame:
    """One answer per (rule_id, secret_sha256): the latest, with a fixed order among equals."""
    answer = ("http_status", "body", "transport_error")
    when = F.col("responded_at") if "responded_at" in responses.columns else F.lit(None).cast("timestamp")
    order = F.struct(when.isNull().alias("undated"), (-F.unix_micros(when)).alias("age"), *answer)
    best = responses.groupBy("rule_id", "secret_sha256").agg(F.min(order).alias("_best"))
    return best.select("rule_id", "secret_sha256", *[F.col("_best")[c].alias(c) for c in answer])


def verify_findings(findings: DataFrame, responses: DataFrame, status: str = "", salts: int = SALTS) -> DataFrame:
    """Findings with what recorded ``responses`` say about them, and ``verification_status``.

    ``responses(rule_id, secret_sha256, http_status, body, transport_error)`` holds the answers.  Of several for one secret the
    latest by ``responded_at`` counts (if there is such a column), then the first in order of status, body and error.  One leaked secret may be behind a large share of the findings, so
    the findings of such a secret are salted and its answer goes out once per salt; the answers to all others go out once.  The findings are read twice and so
    written once to the shared folder.  ``status`` keeps, among the verifiable findings with an answer, those with that status.
    """
    # What is not verifiable needs no answer: its null secret meets none.
    asked = findings.withColumn("secret_sha256", F.when(is_verifiable(F.col("rule_id")), F.sha2("raw", 256)))
    asked = asked if asked.isStreaming else materialized(asked)
    answers = latest_response(responses).withColumn("_answered", F.lit(True))
    joined = salted_join(asked, answers, ["rule_id", "secret_sha256"], ["fingerprint", "file", "commit"], salts, "left")
    result = F.when(F.col("_answered"), classify_response(
        F.col("rule_id"), F.col("raw"), F.col("http_status"), F.col("body"), F.col("transport_error")))
    judged = joined.select(*findings.columns, result.alias("_result"))
    verifiable, outcome = is_verifiable(F.col("rule_id")), F.col("_result")
    shown = outcome["status"].isin(*SHOWN_STATUSES)
    updates = {
        "verified": (F.when(~verifiable, F.lit(False)).when(outcome.isNull(), F.col("verified"))
                     .otherwise(outcome["status"] == "valid")),
        "account": F.when(outcome["account"] != "", outcome["account"]).otherwise(F.col("account")),
        "message": F.when(shown, outcome["message"]).otherwise(F.col("message")),
    }
    done = judged.select(*[updates.get(c, F.col(c)).alias(c) for c in findings.columns],
                         F.when(verifiable, outcome["status"]).alias("verification_status"))
    return filter_verification(done, status)


def filter_verification(findings: DataFrame, status: str = "") -> DataFrame:
    """Drop verifiable, answered findings of another status; an empty status keeps all."""
    if not status:
        return findings
    return findings.filter(F.col("verification_status").isNull() | (F.col("verification_status") == status))
