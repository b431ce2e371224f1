"""W1 webhook intake: signature check, event filter, JSON parse, action
filter, trigger fields.  Pure Column expressions (HMAC included), so the same
function runs on a batch DataFrame or a ``readStream`` DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.functions.crypto import hmac_sha256_hex

# Intake outcomes (HTTP status and text) and triggering actions.
TRIGGER_ACTIONS = ["opened", "synchronize", "reopened"]
OUT_UNAUTHORIZED = (401, "Invalid signature")
OUT_NOT_PR = (200, "Event ignored (only pull_request events processed)")
OUT_BAD_JSON = (400, "Invalid JSON")
OUT_TRIGGERED = (200, "Analysis pipeline triggered")
ACTION_IGNORED_FMT = ("PR action '", "' ignored")


def intake(webhooks: DataFrame, secret: str) -> DataFrame:
    """webhooks(payload, signature, event, ...) -> + status, outcome,
    triggered, repo_name, pr_number, commit_sha."""
    # of a repeated key the last value counts
    webhooks.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    sig = F.col("signature")
    expected = F.concat(F.lit("sha256="), hmac_sha256_hex(secret, F.col("payload")))
    sig_ok = F.coalesce(sig.startswith("sha256=") & (sig == expected), F.lit(False))
    is_pr = F.coalesce(F.col("event") == "pull_request", F.lit(False))
    v = F.try_parse_json(F.col("payload"))
    json_ok = v.isNotNull() | (F.coalesce(F.col("payload"), F.lit("")) == "")

    def text(path):
        return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))

    action = text("$.action")
    trig = sig_ok & is_pr & json_ok & action.isin(*TRIGGER_ACTIONS)
    status = (F.when(~sig_ok, OUT_UNAUTHORIZED[0]).when(~is_pr, OUT_NOT_PR[0]).when(~json_ok, OUT_BAD_JSON[0])
              .otherwise(200))
    outcome = (F.when(~sig_ok, F.lit(OUT_UNAUTHORIZED[1])).when(~is_pr, F.lit(OUT_NOT_PR[1]))
               .when(~json_ok, F.lit(OUT_BAD_JSON[1])).when(trig, F.lit(OUT_TRIGGERED[1]))
               .otherwise(F.concat(F.lit(ACTION_IGNORED_FMT[0]), action, F.lit(ACTION_IGNORED_FMT[1]))))
    return webhooks.select(
        *webhooks.columns,
        status.cast("int").alias("status"), outcome.alias("outcome"), trig.alias("triggered"),
        F.when(trig, text("$.repository.full_name")).alias("repo_name"),
        F.when(trig, F.coalesce(F.try_variant_get(v, "$.number", "int"), F.lit(0))).alias("pr_number"),
        F.when(trig, text("$.pull_request.head.sha")).alias("commit_sha"),
    )
