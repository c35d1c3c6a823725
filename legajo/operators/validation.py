"""File validation over a manifest table.

Manifest columns: ``path, length, page_count, needs_pass, permissions, pages_with_images`` and the
page-profile columns of ``legajo.operators.pages.page_profile``; ``bytes_read`` is optional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.rules import catalog as rules
from legajo.rules import messages as says


def _messages(*tests: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, message) for test, message in tests]))


def _number(value: Column) -> Column:
    return value.cast("string")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def basic_errors() -> Column:
    """Extension and size."""
    size = F.col("length")
    return _messages(
        (~extension(F.col("path")).isin(*rules.EXTENSIONS), F.concat(
            F.lit(says.BAD_EXTENSION), F.regexp_extract(file_name(F.col("path")), r"(\.[^.]*)$", 1))),
        (size < rules.MIN_BYTES, F.concat(
            F.lit(says.SMALL_FILE[0]), _number(size), F.lit(f"{says.SMALL_FILE[1]}{rules.MIN_BYTES})"))),
        (size > rules.MAX_BYTES, F.concat(
            F.lit(says.LARGE_FILE[0]), _number(size), F.lit(f"{says.LARGE_FILE[1]}{rules.MAX_BYTES})"))),
    )


def basic_warnings(known_types: dict[str, str]) -> Column:
    """Media type other than PDF, by extension."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in known_types.items() for x in kv]), extension(F.col("path")))
    return _messages((kind.isNotNull() & (kind != "application/pdf"), F.concat(F.lit(says.BAD_MEDIA_TYPE), kind)))


def structure_errors() -> Column:
    n = F.col("page_count")
    return _messages(
        (n < rules.MIN_PAGES, F.concat(F.lit(says.FEW_PAGES[0]), _number(n), F.lit(f"{says.FEW_PAGES[1]}{rules.MIN_PAGES})"))),
        (n > rules.MAX_PAGES, F.concat(F.lit(says.MANY_PAGES[0]), _number(n), F.lit(f"{says.MANY_PAGES[1]}{rules.MAX_PAGES})"))),
    )


def security_info() -> Column:
    bits = F.col("permissions")
    flags = [(bits.bitwiseAND(F.lit(mask)) != 0).alias(name) for name, mask in rules.PERMISSIONS.items()]
    return F.struct(F.col("needs_pass").alias("password_protected"), F.when(bits != 0, F.struct(*flags)).alias("permissions"))


def _little_text() -> Column:
    return F.coalesce("total_characters", F.lit(0)) < rules.MIN_CHARACTERS


def content_errors() -> Column:
    return _messages(
        (F.col("needs_pass"), F.lit(says.PASSWORD)),
        (_little_text() & (F.col("pages_with_images") == 0), F.lit(says.NO_TEXT)),
    )


def content_warnings() -> Column:
    return _messages((
        _little_text() & (F.col("pages_with_images") > 0),
        F.lit(says.LITTLE_TEXT),
    ))


def integrity_errors(manifest: DataFrame) -> Column:
    if "bytes_read" not in manifest.columns:
        return F.array().cast("array<string>")
    return _messages((
        F.col("bytes_read") != F.col("length"), F.lit(says.SHORT_READ)
    ))


# Media types by extension for the warning on unexpected files.
MEDIA_TYPES = {
    ".pdf": "application/pdf", ".txt": "text/plain", ".html": "text/html", ".csv": "text/csv",
    ".jpg": "image/jpeg", ".png": "image/png", ".json": "application/json", ".xml": "text/xml",
}


def validate(manifest: DataFrame) -> DataFrame:
    """Add ``stage`` (where checking ended), ``errors``, ``warnings``, ``security``, ``is_valid`` and
    ``to_quarantine``. A file that fails the basic or the structure stage is not checked further and
    not quarantined."""
    staged = manifest.withColumns({
        "_basic": basic_errors(), "_structure": structure_errors(),
        "_content": F.concat(content_errors(), integrity_errors(manifest)),
        "_warn": basic_warnings(MEDIA_TYPES), "_content_warn": content_warnings(),
    })
    stage = (
        F.when(F.size("_basic") > 0, "basic").when(F.size("_structure") > 0, "structure").otherwise("complete")
    )
    staged = staged.withColumn("stage", stage)
    complete = F.col("stage") == "complete"
    errors = F.when(F.col("stage") == "basic", F.col("_basic")).when(
        F.col("stage") == "structure", F.col("_structure")).otherwise(F.col("_content"))
    warnings = F.when(complete, F.concat("_warn", "_content_warn")).otherwise(F.col("_warn"))
    staged = staged.withColumns({"errors": errors, "warnings": warnings, "security": F.when(complete, security_info())})
    valid = complete & (F.size("errors") == 0)
    return staged.withColumns({"is_valid": valid, "to_quarantine": complete & ~valid}).drop(
        "_basic", "_structure", "_content", "_warn", "_content_warn"
    )


def with_profile(manifest: DataFrame, profile: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """``manifest(doc_id, path, length, ...)`` with what ``pages.page_profile`` found in each document, so that
    ``validate`` judges by the pages themselves; and with its ``properties``, if ``pages.document_info`` is given.

    A document without pages has none of either. All columns stay on the validated rows.
    """
    counts = profile.select(
        "doc_id", F.col("total_pages").cast("int").alias("page_count"), "total_characters", "extractable_chars", "has_early_text")
    found = manifest.drop("page_count", "total_characters", "extractable_chars", "has_early_text").join(counts, "doc_id", "left")
    found = found.withColumns({"page_count": F.coalesce("page_count", F.lit(0)), **{c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("total_characters", "extractable_chars")}})
    if info is None:
        return found
    return found.join(info.select("doc_id", F.struct(*[c for c in info.columns if c != "doc_id"]).alias("properties")), "doc_id", "left")


def report(manifest: DataFrame) -> DataFrame:
    """Five named checks per file; all must hold."""
    checks = {
        "check_exists": F.col("length").isNotNull(),
        "check_extension": extension(F.col("path")).isin(*rules.EXTENSIONS),
        "check_size": F.col("length") <= rules.MAX_BYTES,
        "check_structure": F.col("page_count") > 0,
        "check_content": F.coalesce("has_early_text", F.lit(False)),
    }
    checked = manifest.withColumns(checks)
    valid = F.forall(F.array(*[F.col(c) for c in checks]), lambda c: c)
    few = F.col("check_content") & (F.col("extractable_chars") < rules.FEW_CHARACTERS)
    return checked.withColumns({
        "is_valid": valid,
        "size_mb": F.when(F.col("check_size"), F.round(F.col("length") / (1024 * 1024), 2)),
        "warnings": _messages((few, F.lit(says.HARD_TO_READ))),
    })


def totals(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count("*").alias("total_files"), F.count_if("is_valid").alias("valid_files"),
        F.count_if(~F.col("is_valid")).alias("invalid_files"),
    )


def quarantine_rows(validated: DataFrame, at: Column) -> DataFrame:
    """Rejected files with their timestamped name and the report as JSON."""
    stamp = F.date_format(at, "yyyyMMdd_HHmmss")
    rejected = validated.filter("to_quarantine")
    return rejected.select(
        "path", F.concat_ws("_", stamp, file_name(F.col("path"))).alias("quarantine_name"),
        F.to_json(F.struct("is_valid", "errors", "warnings", "security")).alias("report"),
    )


def quarantine_summary(rows: DataFrame) -> DataFrame:
    """Number of quarantined files; the names are the rows themselves."""
    return rows.agg(F.count("*").alias("files_in_quarantine"))
