from modelloom.functions.columns import (
    absolute_percentage_error,
    col,
    content_hash,
    epoch_micros,
    error_label,
    field,
    is_numeric,
    is_time,
    like_column,
    to_category,
    to_number,
    without_percent,
)

__all__ = [
    "absolute_percentage_error",
    "col",
    "content_hash",
    "epoch_micros",
    "error_label",
    "field",
    "is_numeric",
    "is_time",
    "like_column",
    "to_category",
    "to_number",
    "without_percent",
]
