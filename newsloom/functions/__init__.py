from newsloom.functions.quantiles import grouped_percentile
from newsloom.functions.sizing import is_small, require_small
from newsloom.functions.staging import path_is_complete, scratch_path, shared_dir, stage
from newsloom.functions.text import alphabetic_words, first_bytes, surface_tokens

__all__ = [
    "alphabetic_words",
    "is_small",
    "first_bytes",
    "grouped_percentile",
    "path_is_complete",
    "scratch_path",
    "shared_dir",
    "require_small",
    "stage",
    "surface_tokens",
]
