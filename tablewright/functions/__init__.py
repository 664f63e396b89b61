"""Frame and column primitives."""

from tablewright.functions.primitives import (  # noqa: F401
    concat_columns, concat_rows, drop_nulls, fill_nulls, head, is_sorted, pearson, quantiles_nearest, sample_rows, tail, to_float32, total_seconds, value_counts,
)
from tablewright.functions.strings import char_ngrams, char_wb_ngrams, ngram_similarity  # noqa: F401
