"""Row shapes, the learner catalog and hyper-parameter defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("streamID", T.StringType()),
        T.StructField("dataSetKey", T.StringType()),
        T.StructField("recordID", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)

# ``seq`` is the order of a record inside its scope (a unique integer), ``ts``
# its event time; the wire format carries neither.
RECORD_COLUMNS = ("streamID", "dataSetKey", "recordID", "fields", "seq", "ts")

REQUEST = T.StructType(
    [
        T.StructField("commandType", T.StringType()),
        T.StructField("algorithmID", T.IntegerType()),
        T.StructField("algorithmType", T.StringType()),
        T.StructField("streamID", T.StringType()),
        T.StructField("dataSetKey", T.StringType()),
        T.StructField("hyperParams", T.MapType(T.StringType(), T.StringType())),
        T.StructField("target", T.StringType()),
        T.StructField("taskType", T.StringType()),
    ]
)

PARTIAL_STRUCT = "struct<algorithmType:string,prediction:string,hyperParams:string>"
ENSEMBLE_SCHEMA = (
    "scope string, target string, recordId string, finalPrediction string, "
    f"partialPredictions array<{PARTIAL_STRUCT}>"
)

CLASSIFICATION = "classification"
REGRESSION = "regression"


@dataclass(frozen=True)
class Algorithm:
    id: int
    name: str
    family: str
    tasks: tuple[str, ...]
    defaults: dict[str, float] = field(default_factory=dict)


# Algorithm ids and names of the request format.
CATALOG = (
    Algorithm(1, "HoeffdingTree", "trees", (CLASSIFICATION,), {"gracePeriod": 200, "splitConfidence": 1e-7, "tieThreshold": 0.05}),
    Algorithm(2, "Naive-Bayes", "bayes", (CLASSIFICATION,)),
    Algorithm(3, "kNN", "neighbours", (CLASSIFICATION, REGRESSION), {"k": 10, "limitOption": 1000}),
    Algorithm(4, "Random-Forest", "trees", (CLASSIFICATION,), {"ensembleSize": 10, "gracePeriod": 200, "splitConfidence": 1e-7, "tieThreshold": 0.05}),
    Algorithm(5, "Perceptron", "linear", (CLASSIFICATION, REGRESSION), {"learningRatio": 1.0}),
    Algorithm(6, "HAT", "trees", (CLASSIFICATION,), {"gracePeriod": 200, "splitConfidence": 1e-7, "tieThreshold": 0.05}),
    Algorithm(7, "SGD", "linear", (CLASSIFICATION, REGRESSION), {"lossFunctionOption": 0, "learningRate": 1e-4, "lambdaRegularization": 1e-4}),
    Algorithm(8, "FIMT-DD", "trees", (REGRESSION,), {"gracePeriod": 200, "splitConfidence": 1e-7, "tieThreshold": 0.05, "learningRatio": 0.02}),
    Algorithm(9, "AMRules", "rules", (REGRESSION,), {"gracePeriod": 200, "splitConfidence": 1e-7, "tieThreshold": 0.05}),
    Algorithm(10, "Random-Forest-Regressor", "trees", (REGRESSION,), {"ensembleSize": 10, "gracePeriod": 200, "splitConfidence": 1e-7, "tieThreshold": 0.05, "learningRatio": 0.02}),
)

BY_ID = {a.id: a for a in CATALOG}
BY_NAME = {a.name.lower(): a for a in CATALOG}
