"""Extraction of tax ids, dates, amounts, suppliers and document numbers from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.rules import metadata as rules


def tax_id(text: Column) -> Column:
    """First tax id."""
    return tx.find_first(text, rules.TAX_ID, flags=tx.PLAIN)


def dates(text: Column) -> Column:
    """All dates, by pattern, without repeats."""
    return F.array_distinct(F.concat(*[tx.find_all(text, p) for p in rules.DATES]))


def amounts(text: Column) -> Column:
    """All amounts that follow a currency sign."""
    return tx.find_all(text, rules.AMOUNT, flags=tx.PLAIN)


def supplier_name(text: Column) -> Column:
    """Supplier named in the first lines: the first line with a hit, within it the first pattern."""

    def in_line(line: Column) -> Column:
        return tx.let(tx.strip(line), lambda x: F.coalesce(
            *[tx.strip(tx.find_first(x, p, 1)) for p in rules.SUPPLIER_LINE]
        ))

    lines = F.slice(F.split(text, "\n", rules.SUPPLIER_LINES + 1), 1, rules.SUPPLIER_LINES)
    return F.aggregate(lines, F.lit(None).cast("string"), lambda found, line: F.coalesce(found, in_line(line)))


def document_number(text: Column) -> Column:
    """Document number: the first pattern that hits."""
    return F.coalesce(*[tx.find_first(text, p, 1) for p in rules.DOCUMENT_NUMBER])


def metadata(text: Column, as_of: Column) -> Column:
    """All extracted fields and the extraction time as one struct."""
    return F.struct(
        tax_id(text).alias("cuit"),
        dates(text).alias("dates"),
        amounts(text).alias("amounts"),
        supplier_name(text).alias("supplier"),
        document_number(text).alias("document_number"),
        as_of.alias("extracted_at"),
    )


def supplier_fields(text: Column) -> Column:
    """Supplier fields found in the text as a map; fields without a hit are absent."""
    pairs = F.array(*[
        F.struct(
            F.lit(field).alias("key"),
            F.coalesce(*[tx.strip(tx.find_first(text, p, 1)) for p in exprs]).alias("value"),
        )
        for field, exprs in rules.SUPPLIER_FIELDS.items()
    ])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def parsed_date(raw: Column) -> Column:
    """DATE of a day-first, year-first or written date; NULL when it is not a real date."""
    plain = F.replace(raw, F.lit("-"), F.lit("/"))
    written = r"(?iUd)^(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})$"
    month = F.array_position(
        F.array(*[F.lit(m) for m in rules.MONTHS]), F.lower(F.regexp_extract(raw, written, 2))
    )
    spelled = F.concat_ws(
        "/", F.regexp_extract(raw, written, 1), month.cast("string"), F.regexp_extract(raw, written, 3)
    )
    return F.coalesce(
        F.try_to_date(plain, "d/M/yyyy"),
        F.try_to_date(plain, "yyyy/M/d"),
        F.when(F.rlike(raw, F.lit(written)), F.try_to_date(spelled, "d/M/yyyy")),
    )


def _decimal(text: Column) -> Column:
    return text.try_cast("decimal(18,2)")


def strict_amount(raw: Column) -> Column:
    """Amount with the currency sign removed and commas read as decimal points."""
    return _decimal(F.replace(F.replace(raw, F.lit("$"), F.lit("")), F.lit(","), F.lit(".")))


def normalized_amount(raw: Column) -> Column:
    """Amount in either convention: the last separator is the decimal one, unless the only kind of
    separator present groups digits by three."""
    digits = F.regexp_replace(raw, r"[^\d.,]", "")
    comma_last = F.length(F.substring_index(digits, ",", -1)) < F.length(F.substring_index(digits, ".", -1))
    no_comma = F.replace(digits, F.lit(","), F.lit(""))
    no_point = F.replace(digits, F.lit("."), F.lit(""))
    value = (
        F.when(F.contains(digits, F.lit(",")) & F.contains(digits, F.lit(".")),
               F.when(comma_last, F.replace(no_point, F.lit(","), F.lit("."))).otherwise(no_comma))
        .when(F.rlike(digits, F.lit(r"^\d{1,3}(,\d{3})+$")), no_comma)
        .when(F.rlike(digits, F.lit(r"^\d{1,3}(\.\d{3})+$")), no_point)
        .otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    )
    return _decimal(value)
