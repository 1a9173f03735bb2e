"""Schemas and names shared by readers, writers and operators."""

from __future__ import annotations

from pyspark.sql import types as T

RATINGS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("user_id", "movie_id", "rating", "timestamp")]
)

# The 42 columns of the header-less census files, in file order.
CENSUS_COLUMNS = """
age
class-of-worker
detailed-industry-recode
detailed-occupation-recode
education
wage-per-hour
enroll-in-edu-inst-last-wk
marital-status
major-industry-code
major-occupation-code
race
hispanic-origin
sex
member-of-a-labor-union
reason-for-unemployment
full-or-part-time-employment-status
capital-gains
capital-losses
dividends-from-stocks
tax-filer-status
region-of-previous-residence
state-of-previous-residence
detailed-household-and-family-status
detailed-household-summary-in-household
instance-weight
migration-code-change-in-msa
migration-code-change-in-reg
migration-code-move-within-reg
live-in-this-house-1-year-ago
migration-prev-res-in-sunbelt
num-persons-worked-for-employer
family-members-under-18
country-of-birth-father
country-of-birth-mother
country-of-birth-self
citizenship
own-business-or-self-employed
fill-inc-questionnaire-for-veterans-admin
veterans-benefits
weeks-worked-in-year
year
income
""".split()

CENSUS = T.StructType([T.StructField(c, T.StringType()) for c in CENSUS_COLUMNS])

SPLITS = ("train", "val", "test")
LABELS = ("y_income", "y_never_married")

# The eight numbers every evaluation reports, in this order.
METRIC_NAMES = (
    "loss",
    "inc_loss",
    "inc_acc",
    "inc_auc",
    "nm_loss",
    "nm_acc",
    "nm_auc",
    "combined_auc",
)

METRICS = T.StructType([T.StructField(m, T.DoubleType()) for m in METRIC_NAMES])

EPOCH_LOG = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("train", METRICS),
        T.StructField("val", METRICS),
        T.StructField("lr", T.DoubleType()),
    ]
)

TEST_REPORT = T.StructType(
    [
        T.StructField("test", METRICS),
        T.StructField("best_val_combined_auc", T.DoubleType()),
    ]
)

MODEL_TABLE = T.StructType(
    [
        T.StructField("param", T.StringType()),
        T.StructField("shape", T.ArrayType(T.IntegerType())),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def prepared_schema(key_type: T.DataType) -> T.StructType:
    """Schema of a prepared artefact with sparse rows; ``split`` is its partition column."""
    return T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("width", T.IntegerType()),
            T.StructField("numeric", T.ArrayType(T.FloatType())),
            T.StructField("slots", T.ArrayType(T.IntegerType())),
            T.StructField("y_income", T.ByteType()),
            T.StructField("y_never_married", T.ByteType()),
            T.StructField("split", T.StringType()),
        ]
    )
