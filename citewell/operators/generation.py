"""Text generation around an injected callable: requests, retries, drafts with resolved references.

Nothing here reaches a network. A generator is any function from a request (JSON text) to an answer (JSON text); it
may raise ProviderError with the status of a failed call.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.functions.text import prompt_fingerprint
from citewell.operators import rules
from citewell.operators.registry import snapshot_of

ANSWER = "content string, source_refs array<string>, claims array<string>, requires_review boolean"
#: Statuses after which a generation call is tried again; None is a transport error.
RETRY = (429, 503, None)


class ProviderError(RuntimeError):
    def __init__(self, status: int | None, message: str = ""):
        super().__init__(message or f"provider answered {status}")
        self.status = status


def with_retry(call: Callable[[], str], retries: int = 3, sleep: Callable[[int], None] = lambda _: None) -> tuple[str | None, str | None, int]:
    """(answer, error, calls): at most retries + 1 calls; only RETRY statuses are tried again. sleep gets the attempt."""
    for attempt in range(1, retries + 2):
        try:
            return call(), None, attempt
        except ProviderError as e:
            if e.status not in RETRY or attempt > retries:
                return None, str(e), attempt
            sleep(attempt)
    raise AssertionError("unreachable")


def _answers(frames, generator, retries: int):
    for frame in frames:
        out = [with_retry(partial(generator, r), retries) for r in frame["request"]]
        yield pd.DataFrame({"item_id": frame["item_id"], "raw": [x[0] for x in out], "error": [x[1] for x in out], "calls": [x[2] for x in out]})


def generate(requests: DataFrame, generator: Callable[[str], str], retries: int = 3) -> DataFrame:
    """item_id, raw, error, calls of requests (item_id, request), in Arrow batches."""
    kind = dict(requests.dtypes)["item_id"]
    return requests.select("item_id", "request").mapInPandas(partial(_answers, generator=generator, retries=retries), f"item_id {kind}, raw string, error string, calls int")


def prompts(spark, briefs: dict[str, str]) -> DataFrame:
    """task, brief and fingerprint of a parameter table of briefs; the fingerprint covers all of them, sorted."""
    whole = "".join(briefs[k] for k in sorted(briefs))
    return spark.createDataFrame(sorted(briefs.items()), "task string, brief string").withColumn("prompt_version", prompt_fingerprint(F.lit(whole)))


def drafts(evidence: DataFrame, brief: str, generator: Callable[[str], str], style: str = "en", retries: int = 3) -> DataFrame:
    """A pending draft for each item: item_id, content, source_refs (resolved ids), warnings, snapshot, outcome, reason.

    evidence: item_id, evidence (array<struct<id, source_id, source_version, text>> in order). Items whose evidence is
    not valid are not sent. outcome is insufficient_evidence, provider_error, validation_failed or pending.
    """
    valid = F.size(rules.evidence_violations(F.col("evidence"))) == 0
    asked = evidence.where(valid).select("item_id", rules.request_body(F.lit(brief), F.transform("evidence", lambda e: e["text"])).alias("request"))
    answers = generate(asked, generator, retries)
    joined = evidence.join(answers, "item_id", "left").withColumn("answer", rules.decode_output(F.col("raw"), ANSWER))
    ids = F.transform("evidence", lambda e: e["id"])
    refs = rules.resolve_positions(F.coalesce("answer.value.source_refs", F.array().cast("array<string>")), ids)
    rows = joined.withColumn("refs", refs)
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    reason = F.coalesce(F.col("answer.error"), rules.draft_reason(F.col("answer.value.content"), count("answer.value.claims"), count("refs.resolved"), F.col("answer.value.requires_review"), F.lit(style)))
    outcome = F.when(~valid, "insufficient_evidence").when(F.col("error").isNotNull(), "provider_error").when(reason.isNotNull(), "validation_failed").otherwise("pending")
    return rows.select(
        "item_id", F.col("answer.value.content").alias("content"), F.array_distinct("refs.resolved").alias("source_refs"), F.col("refs.warnings").alias("warnings"),
        snapshot_of(F.transform("evidence", lambda e: e["source_version"])).alias("snapshot"), outcome.alias("outcome"), F.when(outcome == "validation_failed", reason).when(outcome == "provider_error", F.col("error")).alias("reason"),
    )
