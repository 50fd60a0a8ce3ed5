"""Assembly of the three fields, validation, review marks, and human corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..functions.phones import digits_of, mentioned, mentions
from ..functions.regex import squeeze
from ..functions.review import (
    code_concerns, concerns, milli, overall, penalised, two_places, unit, validate_name, validate_phone, validate_role,
)


def assemble(docs: DataFrame, name: DataFrame, phone: DataFrame, role: DataFrame) -> DataFrame:
    """One row per document with value, OCR-discounted confidence, method and evidence per field."""
    j = docs.select("doc_id", "ocr_confidence").join(name, "doc_id").join(phone, "doc_id").join(role, "doc_id")
    for f in ("name", "phone", "role"):
        j = j.withColumn(f"{f}_confidence", unit(penalised(milli(F.col(f"{f}_confidence")), F.col("ocr_confidence"))))
    return j.withColumn("engine", F.lit("local")).withColumn("engine_version", F.lit(V.ENGINE_VERSION))


def text_columns() -> dict[str, Column]:
    """What validation asks of a text: what is written like a number, and its long digit runs with separators taken out."""
    runs = F.regexp_extract_all(F.regexp_replace("text", r"[\s\-().]", ""), F.lit(r"[0-9]{8,}"), F.lit(0))
    return {"mentions": mentions(F.col("text")), "digit_runs": F.array_join(runs, ",")}


def with_text_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Join each row with its document's facts and the number of distinct valid numbers in its text."""
    counts = mentioned(facts).groupBy("doc_id").agg(F.count("*").alias("n_numbers"))
    return rows.join(facts.select("doc_id", "digit_runs"), "doc_id").join(counts, "doc_id", "left").withColumn("n_numbers", F.coalesce("n_numbers", F.lit(0)))


def validate_rows(rows: DataFrame, facts: DataFrame, threshold: int | None = None) -> DataFrame:
    """Reject or clamp each field, compute the overall confidence, and say why a row needs review."""
    limit = V.THRESHOLD if threshold is None else threshold
    df = with_text_facts(rows, facts)
    df = validate_role(validate_phone(validate_name(df, "name"), "phone", "digit_runs"), "role")
    n = F.when(F.col("name_ok"), milli(F.col("name_confidence"))).otherwise(0)
    r = F.when(F.col("role_ok"), milli(F.col("role_confidence"))).otherwise(0)
    p0 = milli(F.col("phone_confidence"))
    p = F.when(~F.col("phone_ok"), 0).when(~F.col("phone_in_text"), F.least(p0, F.lit(400))).when(F.col("n_numbers") > 1, F.least(p0, F.lit(900))).otherwise(p0)
    df = df.withColumn("_nc", n).withColumn("_pc", p).withColumn("_rc", r)

    def low(ok, c, label):
        return F.when(F.col(ok) & (F.col(c) < limit), F.concat(F.lit(label + " confidence "), two_places(F.col(c))))

    df = df.withColumn("_below", F.concat_ws(", ", low("name_ok", "_nc", "name"), low("phone_ok", "_pc", "phone"), low("role_ok", "_rc", "job role")))
    unverified = F.col("phone_ok") & ~F.col("phone_in_text")
    weak = F.col("_below") != ""
    limit_text = f"{limit / 1000:g}"
    reasons = F.array(
        F.col("name_reason"), F.col("phone_reason"), F.when(unverified, "Phone number could not be verified against CV text"), F.col("role_reason"),
        F.when(weak, F.concat(F.lit(f"Below confidence threshold {limit_text}: "), "_below")),
    )
    codes = F.array(
        F.when(~F.col("name_ok"), "NO_NAME_FOUND"), F.when(~F.col("phone_ok"), "NO_PHONE_FOUND"), F.when(unverified, "PHONE_NOT_IN_TEXT"),
        F.when(~F.col("role_ok"), "NO_ROLE_FOUND"), F.when(weak, "LOW_CONFIDENCE"),
    )
    return df.select(
        "doc_id", "ocr_confidence", F.col("name_value").alias("candidate_name"), F.col("phone_value").alias("phone_number"),
        F.col("role_value").alias("job_role_applied_for"), unit(F.col("_nc")).alias("name_confidence"), unit(F.col("_pc")).alias("phone_confidence"),
        unit(F.col("_rc")).alias("role_confidence"), unit(overall(F.col("_nc"), F.col("_pc"), F.col("_rc"))).alias("overall_confidence"),
        F.array_compact(reasons).alias("review_reasons"), F.array_compact(codes).alias("review_codes"),
        *[c for c in ("name_method", "phone_method", "role_method", "engine", "engine_version") if c in rows.columns],
    ).withColumn("needs_review", F.size("review_reasons") > 0)


def low_ocr_review(rows: DataFrame) -> DataFrame:
    poor = F.coalesce(F.col("ocr_confidence") < 0.6, F.lit(False))
    reason = F.concat(F.lit("Low OCR confidence ("), two_places(milli(F.col("ocr_confidence"))), F.lit(")"))
    return rows.withColumn("review_reasons", F.when(poor, F.concat("review_reasons", F.array(reason))).otherwise(F.col("review_reasons"))).withColumn(
        "needs_review", F.col("needs_review") | poor)


FIELDS = [("candidate_name", "name_confidence", "candidateName"), ("phone_number", "phone_confidence", "phoneNumber"),
          ("job_role_applied_for", "role_confidence", "jobRoleAppliedFor")]


def merge_corrections(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New results over stored ones: corrected fields keep their value and full confidence."""
    old = existing.select("cv_file_id", F.col("corrected_fields").alias("_c"), *[F.col(v).alias(f"_{v}") for v, _, _ in FIELDS])
    df = new.join(old, "cv_file_id", "left").withColumn("corrected_fields", F.coalesce("_c", F.array().cast("array<string>")))
    for value, conf, key in FIELDS:
        kept = F.array_contains("corrected_fields", key)
        df = df.withColumn(value, F.when(kept, F.col(f"_{value}")).otherwise(F.col(value))).withColumn(conf, F.when(kept, 1.0).otherwise(F.col(conf)))
    corrected, touched = F.col("corrected_fields"), F.size("corrected_fields") > 0
    again = unit(overall(*[milli(F.col(c)) for _, c, _ in FIELDS]))
    return (
        df.withColumn("overall_confidence", F.when(touched, again).otherwise(F.col("overall_confidence")))
        .withColumn("review_reasons", F.filter("review_reasons", lambda r: ~concerns(r, corrected)))
        .withColumn("review_codes", F.filter("review_codes", lambda c: ~code_concerns(c, corrected)))
        .withColumn("is_manually_corrected", touched)
        .drop("_c", *[f"_{v}" for v, _, _ in FIELDS])
    )


def final_status(rows: DataFrame) -> DataFrame:
    open_ = F.size("review_reasons") > 0
    return (
        rows.withColumn("status", F.when(open_, "NEEDS_REVIEW").otherwise("PROCESSED"))
        .withColumn("review_codes", F.when(open_, F.col("review_codes")).otherwise(F.array().cast("array<string>")))
        .withColumn("review_required", open_)
    )


def manual_correction(files: DataFrame, candidates: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply validated edits. An invalid edit leaves its row as it was and reports the reason.

    Reasons about corrected fields go; codes are left alone on this path.
    """
    p = patches.select("cv_file_id", *[F.col(v).alias(f"new_{v}") for v, _, _ in FIELDS])
    df = files.select("cv_file_id", "workspace_id", "status").join(p, "cv_file_id").join(candidates, "cv_file_id", "left")
    df = validate_role(validate_phone(validate_name(df, "new_candidate_name", "n"), "new_phone_number", None, "p"), "new_job_role_applied_for", "r")
    blank = {v: F.trim(f"new_{v}").rlike(r"(?i)^not\s*found$") for v, _, _ in FIELDS}
    given = {v: F.col(f"new_{v}").isNotNull() for v, _, _ in FIELDS}
    short = {"candidate_name": "n", "phone_number": "p", "job_role_applied_for": "r"}
    bad_phone = F.concat(F.lit("Invalid phone number: "), "new_phone_number")
    error = F.coalesce(*[
        F.when(given[v] & ~blank[v] & ~F.col(f"{s}_ok"), bad_phone if v == "phone_number" else F.col(f"{s}_reason")) for v, s in short.items()
    ])
    df = df.withColumn("error", error)
    ok = F.col("error").isNull()
    none = F.array().cast("array<string>")
    added = F.array_compact(F.array(*[F.when(given[v], key) for v, _, key in FIELDS]))
    df = df.withColumn("corrected_fields", F.array_union(F.coalesce("corrected_fields", none), F.when(ok, added).otherwise(none)))
    for v, conf, _ in FIELDS:
        use = ok & given[v]
        df = df.withColumn(v, F.when(use, F.col(f"{short[v]}_value")).otherwise(F.coalesce(F.col(v), F.lit(V.NOT_FOUND)))).withColumn(
            conf, F.when(use, 1.0).otherwise(F.coalesce(F.col(conf), F.lit(0.0))))
    corrected = F.col("corrected_fields")
    reasons = F.coalesce("review_reasons", none)
    df = df.withColumn("review_reasons", F.when(ok, F.filter(reasons, lambda r: ~concerns(r, corrected))).otherwise(reasons))
    total = unit(overall(*[milli(F.col(c)) for _, c, _ in FIELDS]))
    terminal = F.col("status").isin(*V.PARSED_STATUSES)
    return (
        df.withColumn("overall_confidence", F.when(ok, total).otherwise(F.coalesce("overall_confidence", F.lit(0.0))))
        .withColumn("status", F.when(ok & terminal, F.when(F.size("review_reasons") > 0, "NEEDS_REVIEW").otherwise("PROCESSED")).otherwise(F.col("status")))
        .withColumn("is_manually_corrected", ok | F.coalesce("is_manually_corrected", F.lit(False)))
        .select("cv_file_id", "workspace_id", "status", *[c for f in FIELDS for c in f[:2]], "overall_confidence", "is_manually_corrected",
                "corrected_fields", "review_reasons", "review_codes", "error")
    )


def is_transient(app_error: Column, app_transient: Column, code: Column, error_name: Column, status: Column, message: Column) -> Column:
    network = code.isin(*V.TRANSIENT_CODES) | error_name.isin("AbortError", "TimeoutError")
    http = status.isin(408, 425, 429) | status.between(500, 599)
    return F.when(app_error, app_transient).otherwise(
        F.coalesce(network, F.lit(False)) | F.coalesce(http, F.lit(False)) | F.coalesce(F.lower(message).rlike(V.TRANSIENT_WORDS), F.lit(False)))


def job_failure(failures: DataFrame) -> DataFrame:
    """Outcome of a failed attempt: scheduled again when transient and attempts are left, else failed."""
    c = F.col
    t = is_transient(c("app_error"), c("app_transient"), c("code"), c("error_name"), c("http_status"), c("message"))
    return (
        failures.withColumn("transient", t).withColumn("will_retry", c("transient") & (c("attempts") < c("max_attempts")))
        .select(
            "job_id", "transient", "will_retry", F.when(c("will_retry"), "PENDING").otherwise("FAILED").alias("status"),
            F.when(c("will_retry"), "RETRY_SCHEDULED").alias("stage"), F.col("message").alias("error_message"),
            F.when(c("app_error"), c("code")).otherwise("PROCESSING_ERROR").alias("error_code"),
        )
    )


def provider_error_class(replies: DataFrame) -> DataFrame:
    """Class, retry flag and message of a provider error. Quota words beat the HTTP status."""
    part = lambda k: F.get_json_object("body", f"$.error.{k}")
    s, d = F.col("http_status"), F.trim(F.col("detail"))
    df = replies.withColumn("detail", F.coalesce(part("message"), F.col("body")))
    hay = F.concat_ws(" ", F.coalesce(part("type"), F.lit("")), F.coalesce(part("code"), F.lit("")), "detail")
    classes = [
        (hay.rlike(V.QUOTA_WORDS), "LLM_QUOTA", F.lit("LLM account has no available credit/quota: ")),
        (s.isin(401, 403), "LLM_AUTH", F.concat(F.lit("LLM API key rejected (HTTP "), s.cast("string"), F.lit("): "))),
        (s == 404, "LLM_MODEL_NOT_FOUND", F.lit("Model not found (HTTP 404): ")),
        (s.isin(400, 422), "LLM_BAD_REQUEST", F.concat(F.lit("LLM rejected the request (HTTP "), s.cast("string"), F.lit("): "))),
        (s == 429, "LLM_RATE_LIMITED", F.lit("LLM rate limit hit (HTTP 429): ")),
        (s >= 500, "LLM_TRANSIENT", F.concat(F.lit("LLM service error (HTTP "), s.cast("string"), F.lit("): "))),
    ]
    code, lead = F.lit("LLM_ERROR"), F.concat(F.lit("LLM API error (HTTP "), s.cast("string"), F.lit("): "))
    for cond, name, text in reversed(classes):
        code, lead = F.when(cond, name).otherwise(code), F.when(cond, text).otherwise(lead)
    return df.select("doc_id", "http_status", code.alias("code"), F.concat(lead, d).alias("message")).withColumn(
        "transient", F.col("code").isin("LLM_RATE_LIMITED", "LLM_TRANSIENT"))


def parse_model_json(replies: DataFrame) -> DataFrame:
    """Fields of a model reply: outermost object of the text, defaults for missing keys, ranges checked."""
    fields = ["candidate_name", "phone_number", "job_role_applied_for"]
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("reply", r"^\s+|\s+$", "")), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    df = replies.withColumn("_j", F.regexp_extract(bare, r"(?s)\{.*\}", 0)).withColumn("_v", F.try_parse_json("_j"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    ok = F.col("_v").isNotNull()
    for f in fields:
        ok = ok & F.coalesce(kind(f"$.{f}") == "STRING", F.lit(True))
        num = F.try_variant_get("_v", f"$.confidence.{f}", "double")
        ok = ok & F.coalesce(kind(f"$.confidence.{f}").rlike("^(BIGINT|DECIMAL|DOUBLE)") & num.between(0, 1), F.lit(True))
    df = df.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return df.select(
        "doc_id", "ok", *[F.when(F.col("ok"), F.coalesce(F.try_variant_get("_v", f"$.{f}", "string"), F.lit(V.NOT_FOUND))).alias(f) for f in fields],
        *[F.when(F.col("ok"), F.coalesce(F.try_variant_get("_v", f"$.confidence.{f}", "double"), F.lit(0.0))).alias(f"{f}_confidence") for f in fields],
    )


def _norm(c: Column) -> Column:
    return F.lower(squeeze(c))


def shadow_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Field-by-field agreement of two runs, blind to case, spacing and phone punctuation."""
    j = a.select("doc_id", F.struct("name", "phone", "role").alias("a")).join(b.select("doc_id", F.struct("name", "phone", "role").alias("b")), "doc_id")
    j = j.select(
        "doc_id", (_norm(F.col("a.name")) == _norm(F.col("b.name"))).alias("name_agrees"),
        (digits_of(F.col("a.phone")) == digits_of(F.col("b.phone"))).alias("phone_agrees"),
        (_norm(F.col("a.role")) == _norm(F.col("b.role"))).alias("role_agrees"),
    )
    return j.withColumn("agreement_count", sum(F.col(c).cast("int") for c in ("name_agrees", "phone_agrees", "role_agrees")))
