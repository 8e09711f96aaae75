from holdfast.functions.columns import (
    best_class,
    counted,
    joined_names,
    key_text,
    parsed_number,
    percent,
    points,
    scores_in_text,
    split_name,
    status_of,
    wilson_bounds,
)

__all__ = [
    "best_class", "counted", "joined_names", "key_text", "parsed_number", "percent",
    "points", "scores_in_text", "split_name", "status_of", "wilson_bounds",
]
