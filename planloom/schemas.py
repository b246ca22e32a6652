"""Record schemas and fixed token conventions."""

from pyspark.sql import types as T

# The special tokens, whose ids are their positions in this list.
SPECIAL_TOKENS = [
    "<|unknown|>",
    "<|pad|>",
    "<|startofplan|>",
    "<|endofplan|>",
    "<|goals|>",
    "<|actions|>",
    "<|mask|>",
]
UNKNOWN, PAD, START, END, GOALS, ACTIONS, MASK = SPECIAL_TOKENS

# Vocabulary size (special tokens included) and accepted buckets.
VOCABULARY_SIZE = 25_000
ACTIONS_SEEN_BUCKETS = [0, 1, 2, 3, 4, 5]

# The classes of a validated plan, the most serious error first.
BAD_OPERATOR = "bad_operator_error"
UNKNOWN_TYPE = "unknown_type_error"
TYPE_CHECKING = "type_checking_error"
PRECONDITION = "precondition_error"
UNSATISFIED_GOAL = "unsatisfied_goal_error"
VALID = "valid"
PLAN_CLASSES = [
    BAD_OPERATOR,
    UNKNOWN_TYPE,
    TYPE_CHECKING,
    PRECONDITION,
    UNSATISFIED_GOAL,
    VALID,
]

MISSING_PROBLEM = "missing_problem"

# A plan with more steps than this is cut into blocks that are scanned apart.
LONG_PLAN_STEPS = 65_536

_strings = T.ArrayType(T.StringType())

PLAN_ACTION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("student", T.StringType()),
        T.StructField("predecessor", _strings),
        T.StructField("precondition", _strings),
        T.StructField("positive_effects", _strings),
        T.StructField("negative_effects", _strings),
    ]
)

PLAN_RAW = T.StructType(
    [
        T.StructField("plan_name", T.StringType()),
        T.StructField("initial_state", _strings),
        T.StructField("goals", _strings),
        T.StructField("actions", T.ArrayType(PLAN_ACTION)),
    ]
)

PLAN_RECORD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("pddl_problem_file", T.StringType()),
        T.StructField("initial_state", T.StringType()),
        T.StructField("goals", T.StringType()),
        T.StructField("actions", T.StringType()),
        T.StructField("len_initial_state", T.LongType()),
        T.StructField("len_goals", T.LongType()),
        T.StructField("len_plan", T.LongType()),
        T.StructField("actions_idx", T.LongType()),
        T.StructField("eop_idx", T.LongType()),
    ]
)

GENERATED_PLAN = T.StructType(
    [
        T.StructField("input", T.StringType()),
        T.StructField("plan", T.StringType()),
        T.StructField("actions_seen", T.IntegerType()),
        T.StructField("problem_id", T.StringType()),
        T.StructField("example_id", T.StringType()),
    ]
)
