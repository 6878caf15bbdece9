"""Schemas of the property graph and constants of the scoring model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
NODE_SCHEMA = _struct(
    name=_S, node_type=_S, file=_S, line_start=_I, line_end=_I, signature=_S, body_text=_S, roxygen_text=_S, complexity=_I, pagerank=_D,
    scope_level=_I, entry_point=_B, api_depth=_I, task_trace_weight=_D, embedding=T.ArrayType(_D), calls_list=T.ArrayType(_S), node_pos=_L,
)
EDGE_SCHEMA = _struct(src=_S, dst=_S, weight=_D, edge_type=_S, metadata=_S)
TRACE_SCHEMA = _struct(ts=_S, query=_S, nodes=T.ArrayType(_S), polarity=_D, session_id=_S)

FUNCTION, PACKAGE, TESTFILE = "function", "package", "testfile"
CALLS, IMPORTS, TESTS, CO_CHANGES, DISPATCHES_ON, EXTENDS, SEMANTIC = "CALLS", "IMPORTS", "TESTS", "CO_CHANGES", "DISPATCHES_ON", "EXTENDS", "SEMANTIC"

#: Names that a call list leaves out: syntax, operators, constants and constructors of the base language.
PRIMITIVES = frozenset(
    "{ ( <- = -> <<- [ [[ $ @ + - * / ^ %% %/% %in% %>% |> == != < > <= >= & | ! && || : ~ ... .. .GlobalEnv if for while repeat break next return function on.exit match.arg missing sys.call c list"
    " NULL TRUE FALSE Inf NaN NA NA_integer_ NA_real_ NA_complex_ NA_character_ vector character numeric logical integer complex raw environment new.env invisible".split()
)
#: Verbs whose bare arguments name columns.
MASKING = frozenset("mutate filter summarise summarize select arrange group_by rename across where pick everything transmute slice case_when pull distinct count tally".split())
TEST_HELPERS = frozenset(
    ["test_that", "describe", "it"]
    + [f"expect_{x}" for x in "equal identical true false null na error warning message no_error no_warning no_message length named type s3_class s4_class vector output gt gte lt lte setequal contains in".split()]
    + "setup teardown skip skip_if skip_if_not skip_if_not_installed skip_on_cran skip_on_ci local_tempdir local_tempfile source library require".split()
)

WEIGHTS = {"semantic": 0.5, "depth": 0.15, "task_trace": 0.15, "pagerank": 0.10, "cochange": 0.10}
DEPTH_FACTOR, UNREACHABLE = 0.2, 99
MIN_RELEVANCE, MAX_NODES, BUDGET = 0.1, 20, 2000
SEMANTIC_THRESHOLD, SEMANTIC_CAP = 0.7, 5
HALF_LIFE_DAYS, ALPHA, DECAY, MIN_COCHANGES = 30.0, 0.3, 0.99, 2


def normalize(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema in their order: missing ones are typed nulls, others are dropped."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def weights(options: dict | None = None, overrides: dict | None = None) -> dict[str, float]:
    """Defaults, then options, then overrides; unknown names are ignored; the sum isn't brought back to 1."""
    return {k: float({**(options or {}), **(overrides or {})}.get(k, v)) for k, v in WEIGHTS.items()}
