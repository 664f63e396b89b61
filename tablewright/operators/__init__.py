"""The operators of the library."""

from tablewright.operators.apply import ApplyToCols, ApplyToSubFrame, Cleaner, DropCols, SelectCols, TableVectorizer, wrap_transformer  # noqa: F401
from tablewright.operators.associations import DropSimilar, column_associations  # noqa: F401
from tablewright.operators.columns import (  # noqa: F401
    CleanNullStrings, ColumnTransformer, DatetimeEncoder, Drop, DropUninformative, DurationToFloat, OneHot, Ordinal, PassThrough, Reject, SquashingScaler, ToCategorical, ToDatetime,
    ToFloat, ToStr, convert_time_zone, scaling_factor, time_zone_of, to_datetime,
)
from tablewright.operators.encoders import GapEncoder, MinHashEncoder, SimilarityEncoder, StringEncoder, TextEncoder  # noqa: F401
from tablewright.operators.fuzzy import Joiner, NoRescaling, OtherNeighbor, RandomPairs, SelfJoinNeighbor, StringVectors, deduplicate, fuzzy_join  # noqa: F401
from tablewright.operators.interpolation import InterpolationJoiner  # noqa: F401
from tablewright.operators.relational import AggJoiner, AggTarget, MultiAggJoiner, SessionEncoder, aggregate, check_input, left_join  # noqa: F401
from tablewright.operators.report import TableReport, column_filters, column_profile, duration_unit, robust_histogram, robust_histograms  # noqa: F401
