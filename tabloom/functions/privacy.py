"""Entity patterns, privacy outcome codes, file categories and eye-region geometry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The labels that count as personal data.
PII_LABELS = (
    "PERSON",
    "GPE",
    "LOC",
    "EMAIL",
    "PHONE_NUMBER",
    "SSN",
    "CREDIT_CARD",
    "IP_ADDRESS",
)

# Patterns in priority order: a match is taken out before the next pattern is tried.
# No look-around, so the same pattern works in other engines.
ENTITY_PATTERNS = {
    "EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
    "IP_ADDRESS": "\\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\b",
    "CREDIT_CARD": "\\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\\b",
    "SSN": "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b",
    "PHONE_NUMBER": "(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{2,4}\\)|\\b[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}\\b",
}

# What a text must contain for a pattern to match at all: a far cheaper test.
ENTITY_HINTS = {
    "EMAIL": "@",
    "IP_ADDRESS": "[0-9]\\.",
    "CREDIT_CARD": "[0-9]{4}",
    "SSN": "[0-9]{3}-",
    "PHONE_NUMBER": "[0-9]{3}",
}

# Share of entities per sampled row, and rows sampled per column.
PII_THRESHOLD = 0.15
PII_SAMPLE_ROWS = 10

# File types by category.
IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "heic", "heif", "webp")
DATA_TYPES = ("csv", "tsv", "txt", "xls", "xlsx", "sav")

# Stored outcome codes and the messages they stand for.
OUTCOME_MESSAGES = {
    "processing_error": "Previous processing resulted in an error (from cache)",
    "no_eyes_found": "No faces or eye landmarks detected previously (from cache)",
    "no_pii_found": "No PII columns detected previously (from cache)",
    "unsupported_format": "Unsupported file format (from cache)",
}


# Parts of messages, and the outcome codes they stand for, in the order in which they are tried.
MESSAGE_CODES = {
    "No faces": "no_eyes_found",
    "No PII": "no_pii_found",
    "Unsupported": "unsupported_format",
    "Error": "processing_error",
}
# Fixed value: part of a lower-cased message of a failed run.
FAILURE_WORD = "failed"

# The eye strip as shares of a face box, and how far boxes are padded.
EYES_LEFT, EYES_RIGHT, EYES_TOP, EYES_BOTTOM = 0.15, 0.85, 0.30, 0.45
EYES_PAD_X, EYES_PAD_Y, LANDMARK_PAD = 0.15, 0.20, 0.15


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_category(file_type: Column | str) -> Column:
    low = F.lower(_col(file_type))
    return F.when(low.isin(*IMAGE_TYPES), "image").when(low.isin(*DATA_TYPES), "data").otherwise("unknown")


def outcome_code(message: Column | str, findings: Column | str) -> Column:
    """The value stored for a detection run: its findings as JSON, else a code.

    ``findings`` is an array; empty or null means nothing was found.
    """
    message, findings = _col(message), _col(findings)
    code = F.when(F.coalesce(F.size(findings), F.lit(0)) > 0, F.to_json(findings))
    for part, stored in MESSAGE_CODES.items():
        code = code.when(message.contains(part), stored)
    failed = F.lower(message).contains(FAILURE_WORD)
    return code.when(failed, MESSAGE_CODES["Error"]).otherwise(F.lower(F.regexp_extract(message, "^\\s*(\\S+)", 1)))


def decoded_size(stored: Column | str) -> Column:
    """Items in a stored JSON array, 0 for the fixed codes, null for anything malformed."""
    stored = _col(stored)
    return F.when(stored.isin(*OUTCOME_MESSAGES), 0).otherwise(F.json_array_length(stored))


def decoded_message(stored: Column | str, detection_type: Column | str) -> Column:
    """The message for a stored outcome; null where nothing is stored."""
    stored = _col(stored)
    kind = F.coalesce(_col(detection_type), F.lit("unknown"))
    size = F.json_array_length(stored)
    picked = F.when(stored.isNull() | (stored == "") | (stored == "null"), F.lit(None).cast("string"))
    for code, message in OUTCOME_MESSAGES.items():
        picked = picked.when(stored == code, message)
    return (
        picked.when(size.isNull(), "Error: Cached data is corrupt")
        .when(kind == "eye_detection", F.concat(F.lit("Retrieved "), size, F.lit(" eye region(s) from cache")))
        .when(kind == "pii_detection", F.concat(F.lit("Retrieved "), size, F.lit(" PII column(s) from cache")))
        .otherwise("Privacy detection results retrieved from cache")
    )


def report_id(name: Column | str) -> Column:
    return F.translate(_col(name), "_", "-")


def _truncated(c: Column) -> Column:
    return c.cast("int")


def eye_region(
    x: Column | str, y: Column | str, w: Column | str, h: Column | str,
    image_width: Column | str, image_height: Column | str,
) -> dict[str, Column]:
    """Eye strip of a face box: 30-45 % of its height, 15-85 % of its width, padded, clamped."""
    x, y, w, h = _col(x), _col(y), _col(w), _col(h)
    left = x + _truncated(w * F.lit(EYES_LEFT))
    right = x + _truncated(w * F.lit(EYES_RIGHT))
    top = y + _truncated(h * F.lit(EYES_TOP))
    bottom = y + _truncated(h * F.lit(EYES_BOTTOM))
    pad_x = _truncated((right - left) * F.lit(EYES_PAD_X))
    pad_y = _truncated((bottom - top) * F.lit(EYES_PAD_Y))
    return _clamped(left, top, right, bottom, pad_x, pad_y, image_width, image_height)


def landmark_box(
    min_x: Column, min_y: Column, max_x: Column, max_y: Column,
    image_width: Column | str, image_height: Column | str,
) -> dict[str, Column]:
    """Box around landmarks, padded by 15 % each way and clamped to the image."""
    pad_x = _truncated((max_x - min_x) * F.lit(LANDMARK_PAD))
    pad_y = _truncated((max_y - min_y) * F.lit(LANDMARK_PAD))
    return _clamped(min_x, min_y, max_x, max_y, pad_x, pad_y, image_width, image_height)


def _clamped(left, top, right, bottom, pad_x, pad_y, image_width, image_height) -> dict[str, Column]:
    return {
        "x1": F.greatest(F.lit(0), left - pad_x).cast("int"),
        "y1": F.greatest(F.lit(0), top - pad_y).cast("int"),
        "x2": F.least(_col(image_width), right + pad_x).cast("int"),
        "y2": F.least(_col(image_height), bottom + pad_y).cast("int"),
    }
