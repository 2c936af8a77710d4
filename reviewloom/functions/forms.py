"""Nested form JSON: fields found by label, dropdown ids, matrix answers.

``value`` is a string, an id array or a row map, so it is read as JSON text
first and re-parsed per use.  All of it is expressions over one parsed struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .dates import iso_date_or, lenient_date
from .fixed_values import DEFAULT_RATING, FORM_DEFAULTS, FORM_MATRIX_LABELS, FORM_TEXT_LABELS

ITEM = "struct<id:string,text:string>"
FIELDS = (
    f"array<struct<label:string,type:string,value:string,options:array<{ITEM}>,"
    f"rows:array<{ITEM}>,columns:array<{ITEM}>>>"
)
FORM_SCHEMA = f"struct<body:struct<data:struct<createdAt:string,fields:{FIELDS}>>>"


def _first(items: Column, keep) -> Column:
    return F.get(F.filter(items, keep), F.lit(0))


def _field(fields: Column, fragment: str) -> Column:
    return _first(fields, lambda f: F.lower(f["label"]).contains(fragment.lower()))


def _text_with_id(items: Column, wanted: Column) -> Column:
    """Text of the first item with the id.  A position lookup evaluates ``wanted`` once, not per item."""
    return F.get(items["text"], (F.array_position(items["id"], wanted) - 1).cast("int"))


def dropdown_answer(field: Column, default: str) -> Column:
    chosen = F.get(F.from_json(field["value"], "array<string>"), F.lit(0))
    return F.coalesce(_text_with_id(field["options"], chosen), F.lit(default))


def matrix_answer(matrix: Column, answers: Column, fragment: str) -> Column:
    """Numeric column text chosen for a row; the default for anything missing, odd or zero."""
    row = _first(matrix["rows"], lambda r: F.lower(r["text"]).contains(fragment.lower()))
    chosen = F.get(F.try_element_at(answers, row["id"]), F.lit(0))
    text = _text_with_id(matrix["columns"], chosen)
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    return F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(DEFAULT_RATING))


def parse_forms(
    df: DataFrame, json_column: str, keep: tuple[str, ...] = (), now: Column | None = None
) -> DataFrame:
    """One row per event with the review attributes; unreadable JSON yields the defaults.

    ``now``, a time in ISO form, stands in for a missing creation time, and its day for a creation time that is no date.  Each level is its own
    projection, so the payload and the answer map are parsed once per event.
    """
    if now is None:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parsed = df.select(*keep, F.from_json(json_column, FORM_SCHEMA).alias("_form"), now.alias("_now"))
    data = F.col("_form.body.data")
    parsed = parsed.select(
        *keep, F.coalesce(data["createdAt"], F.col("_now")).alias("submitted_at"), "_now",
        data["fields"].alias("_fields"),
    )
    f = F.col("_fields")
    found = parsed.select(
        *keep, "submitted_at", "_now",
        *[_field(f, frag)["value"].alias(n) for n, frag in FORM_TEXT_LABELS.items()],
        *[_field(f, n).alias(f"_{n}") for n in FORM_DEFAULTS],
        _first(f, lambda x: x["type"] == "MATRIX").alias("_matrix"),
    )
    found = found.withColumn("_answers", F.from_json(F.col("_matrix")["value"], "map<string,array<string>>"))
    return found.select(
        *keep,
        *[F.coalesce(n, F.lit("")).alias(n) for n in FORM_TEXT_LABELS],
        *[dropdown_answer(F.col(f"_{n}"), d).alias(n) for n, d in FORM_DEFAULTS.items()],
        *[matrix_answer(F.col("_matrix"), F.col("_answers"), frag).alias(n) for n, frag in FORM_MATRIX_LABELS.items()],
        F.date_format(iso_date_or(F.substring_index("submitted_at", "T", 1), lenient_date(F.substring("_now", 1, 10))), "yyyy-MM-dd").alias("submission_date"),
        "submitted_at",
    )
