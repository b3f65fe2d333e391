"""Expressions for judge replies: parsing, validation, routing, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ["sarcastic", "non_sarcastic", "invalid"]
REPAIR_FAILED = "JSON parse error after retry."
UNEXPECTED = "Unexpected error: the reply is no JSON object."


def reply_json(raw: Column) -> Column:
    """The part of a reply to parse: without thinking blocks, from the first to the last brace if there are any."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), "(?s)<think>.*?</think>", "")
    found = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(F.trim(t))


def parsed(raw: Column) -> Column:
    return F.try_parse_json(reply_json(raw))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _bit(v: Column, field: str) -> Column:
    """0 or 1 of a field given as number, boolean or string; else null."""
    x = F.try_variant_get(v, f"$.{field}", "variant")
    kind, text = F.schema_of_variant(x), F.try_variant_get(v, f"$.{field}", "string")
    number = F.try_variant_get(v, f"$.{field}", "double")
    return (
        F.when(kind == "STRING", F.when(text.isin("0", "1"), text.cast("int")))
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0))
        .when(number.isin(0.0, 1.0), number.cast("int"))
    )


def validated(v: Column) -> Column:
    """struct(label, has_emoji, needs_human_check, notes, reasoning) of a parsed reply object; label is '0', '1' or 'INVALID'."""
    label = F.coalesce(_bit(v, "llm_label").cast("string"), F.lit("INVALID"))
    text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    filled = lambda c: F.when(c != "", c)
    notes = F.substring(F.coalesce(filled(text("notes")), filled(text("Notes")), F.lit("")), 1, 500)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.reasoning", "variant"))
    said = text("reasoning")
    none = F.create_map().cast("map<string,string>")
    reasoning = F.when((kind == "STRING") & (F.trim(said) != ""), F.create_map(F.lit("verdict"), said)).when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(v, "$.reasoning", "map<string,string>"), none)).otherwise(none)
    return F.struct(label.alias("label"), _bit(v, "has_emoji").alias("has_emoji"), _bit(v, "needs_human_check").alias("needs_human_check"), notes.alias("notes"), reasoning.alias("reasoning"))


def failed(notes: str) -> Column:
    """The struct of a reply that can't be used."""
    nothing = F.lit(None).cast("int")
    return F.struct(F.lit("INVALID").alias("label"), nothing.alias("has_emoji"), nothing.alias("needs_human_check"), F.lit(notes).alias("notes"), F.create_map().cast("map<string,string>").alias("reasoning"))


def round_label(label: Column, override: Column) -> Column:
    base = F.when(label == "1", "sarcastic").when(label == "0", "non_sarcastic").otherwise("invalid")
    return F.when(override == "invalid_json", "invalid").otherwise(base)


def override_of(image_missing: Column, parse_error: Column) -> Column:
    return F.when(image_missing, "missing_image").when(parse_error, "invalid_json")


def route_reason(label: Column, needs_human_check: Column, override: Column) -> Column:
    valid = F.coalesce(label.isin("0", "1"), F.lit(False))
    return F.when(override.isNotNull(), override).when(~valid, "uncertain").when(needs_human_check == 0, "high_conf").otherwise("low_conf")


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def choice_label(choice: Column) -> Column:
    """0 for a choice that says not, 1 for one that says sarcastic (also misspelt), else null."""
    c = F.lower(F.trim(choice))
    return F.when(c.contains("not"), 0).when(c.contains("sarcastic") | c.contains("sacarstic"), 1)


def human_label(annotations: Column) -> Column:
    """The first recognised choice of the first annotation that wasn't cancelled."""
    open_ = F.filter(annotations, lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    results = F.coalesce(F.get(open_, F.lit(0))["result"], F.array())
    choices = F.flatten(F.transform(results, lambda r: F.coalesce(r["value"]["choices"], F.array().cast("array<string>"))))
    return F.get(F.filter(F.transform(choices, choice_label), lambda x: x.isNotNull()), F.lit(0))


def label_text(label: Column) -> Column:
    return F.when(label == 1, "sarcastic").when(label == 0, "not_sarcastic").otherwise("invalid")


def fill_prompt(template: str, text: Column, n_images: Column, ocr: Column) -> Column:
    """The prompt with its places filled one after another, so a place named in the text is filled too."""
    pictures = F.when(n_images > 1, F.concat(n_images.cast("string"), F.lit(" images attached"))).when(n_images == 1, "1 image attached").otherwise("no image")
    c = F.replace(F.lit(template), F.lit("{text}"), F.coalesce(text, F.lit("")))
    c = F.replace(c, F.lit("{images}"), pictures)
    return F.replace(c, F.lit("{ocr_text}"), F.coalesce(F.when(F.trim(ocr) != "", ocr), F.lit("(none)")))


def budget_size(width: Column, height: Column, most: int) -> Column:
    """struct(width, height) of an image within a budget of pixels; no budget if it isn't positive."""
    if most <= 0:
        return F.struct(width.alias("width"), height.alias("height"))
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (width * height)))
    size = lambda x: F.greatest(F.lit(1), F.floor(x * scale).cast("int"))
    return F.struct(size(width).alias("width"), size(height).alias("height"))
