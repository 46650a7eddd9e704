"""Weakness numbers, their categories and experts, and rules that assign them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weakness numbers by category. A number given twice belongs to the later category.
CATEGORIES = {
    "memory_spatial": [119, 120, 121, 122, 123, 124, 125, 126, 127, 129, 131, 170, 680, 787, 788],
    "memory_temporal": [401, 415, 416, 457, 476, 562, 590, 761, 762, 763],
    "integer": [190, 191, 192, 194, 195, 196, 197, 369, 681, 682],
    "taint_api": [15, 20, 22, 23, 36, 73, 74, 77, 78, 79, 89, 90, 91, 94, 114, 134, 247, 426, 427, 601],
    "control_state": [252, 253, 273, 394, 457, 478, 670, 703, 754, 755],
    "concurrency": [362, 366, 367, 667, 764, 765, 821, 832, 833],
}
# The expert of each category, and the experts' codes in order.
EXPERT_OF = {"memory_spatial": "memory_bounds", "memory_temporal": "memory_bounds", "integer": "integer_overflow", "taint_api": "taint_api", "control_state": "control_state", "concurrency": "concurrency"}
EXPERT_CODES = {"memory_bounds": "E1", "lifetime_resource": "E2", "integer_overflow": "E3", "taint_api": "E4", "control_state": "E5", "concurrency": "E6"}

# Crash descriptions, in the order they are tried: phrases, expert, weakness (None: 787 for writes, else 125).
CRASH_RULES = [
    (["double-free"], "lifetime_resource", 415),
    (["use-after"], "lifetime_resource", 416),
    (["memory-leak", "resource-leak"], "lifetime_resource", 401),
    (["integer-overflow", "integer overflow"], "integer_overflow", 190),
    (["data-race", "deadlock"], "concurrency", 362),
    (["buffer-overflow", "buffer-underflow", "out-of-bounds"], "memory_bounds", None),
    (["null-dereference"], "control_state", 476),
    (["uninitialized"], "control_state", 457),
]
# The category of each kind of evidence, for claims about weaknesses ...
EVIDENCE_CATEGORIES = {
    "memory_sink": "memory_spatial", "memory_access": "memory_spatial", "memory_copy": "memory_spatial", "memory_copy_without_guard": "memory_spatial", "unchecked_index": "memory_spatial",
    "release": "memory_temporal", "use_after_release": "memory_temporal", "double_release": "memory_temporal", "unchecked_nullable_dereference": "memory_temporal",
    "integer_arithmetic": "integer", "type_conversion": "integer", "arithmetic_to_allocation": "integer", "arithmetic_to_memory_sink": "integer", "cast_to_size_sink": "integer",
    "taint_source": "taint_api", "taint_sink": "taint_api", "source_to_sink": "taint_api", "unsanitized_source_to_sink": "taint_api",
    "state": "control_state", "error_path": "control_state", "uninitialized_use": "control_state", "unchecked_call_result": "control_state",
    "concurrency": "concurrency", "synchronization": "concurrency", "toctou": "concurrency", "thread_spawn": "concurrency", "toctou_check_use": "concurrency",
}
# ... and where outcome matching differs (None: no category).
MATCHED_CATEGORIES = EVIDENCE_CATEGORIES | {"unchecked_nullable_dereference": "control_state", "unchecked_call_result": None}
# Evidence that carries an integer into memory, and taint to a sink.
INTEGER_TO_MEMORY = ["arithmetic_to_allocation", "arithmetic_to_memory_sink", "cast_to_size_sink"]
TAINT_TO_SINK = ["source_to_sink", "unsanitized_source_to_sink"]
# Categories of each expert, and patterns of root causes.
EXPERT_CATEGORIES = {"memory_bounds": ["memory_spatial", "memory_temporal"], "lifetime_resource": ["memory_temporal"], "integer_overflow": ["integer"], "taint_api": ["taint_api"], "control_state": ["control_state"], "concurrency": ["concurrency"]}
ROOT_CAUSES = {
    "memory_temporal": r"use[- ]after[- ]free|double[- ]free|invalid[- ]free|dangling|released?\s+(?:memory|pointer)",
    "integer": r"integer\s+(?:over|under)flow|wraparound|truncat|signedness|sign extension|size arithmetic",
    "memory_spatial": r"out[- ]of[- ]bounds|buffer\s+(?:over|under)flow|unchecked\s+(?:index|length|copy)|bounds",
    "concurrency": r"race condition|data race|toctou|time[- ]of[- ]check|deadlock|missing lock|atomicity",
    "taint_api": r"unsanitized|attacker[- ]controlled|command injection|path traversal|format string|api (?:contract|precondition)|taint",
    "control_state": r"unchecked return|error path|uninitialized|state machine|invalid state|null dereference|missing (?:error|state) check",
}


def none_() -> Column:
    return F.array().cast("array<string>")


def looked_up(values: Column, table: dict) -> Column:
    """Distinct entries of ``table`` for an array's values; those without one are left out."""
    pairs = [F.lit(x) for k, v in table.items() if v is not None for x in (k, v)]
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, none_()), lambda v: F.try_element_at(F.create_map(*pairs), F.coalesce(v, F.lit("")))), lambda c: c.isNotNull()))


def categories_of(cwes: Column) -> Column:
    """Distinct categories of an array of weakness names."""
    return looked_up(F.transform(F.coalesce(cwes, none_()), lambda c: weakness_number(c).cast("string")), {str(n): c for n, c, _ in weaknesses()})


def supported_by_evidence(cwes: Column, kinds: Column) -> Column:
    """Whether every claimed category is cited, memory also through an integer that reaches it; false where none is claimed."""
    claimed, cited = categories_of(cwes), looked_up(kinds, EVIDENCE_CATEGORIES)
    bridge = F.array_contains(cited, "integer") & F.arrays_overlap(F.coalesce(kinds, none_()), F.array(*map(F.lit, INTEGER_TO_MEMORY)))
    return (F.size(claimed) > 0) & F.forall(claimed, lambda c: F.array_contains(cited, c) | ((c == "memory_spatial") & bridge))


def truth_categories(cwes: Column, experts: Column) -> Column:
    """Of the weaknesses, else of the experts."""
    own, pairs = categories_of(cwes), [x for k, v in EXPERT_CATEGORIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    by_expert = F.array_distinct(F.flatten(F.transform(F.coalesce(experts, none_()), lambda e: F.coalesce(F.try_element_at(F.create_map(*pairs), e), none_()))))
    return F.when(F.size(own) > 0, own).otherwise(by_expert)


def finding_categories(cwes: Column, texts: list[Column], kinds: Column) -> Column:
    """Of the weaknesses, else of what the text says, else of the evidence cited."""
    own, text = categories_of(cwes), F.lower(F.concat_ws(" ", *texts))
    said = F.filter(F.array(*[F.when(F.rlike(text, F.lit(p)), c) for c, p in ROOT_CAUSES.items()]), lambda c: c.isNotNull())
    return F.when(F.size(own) > 0, own).when(F.size(said) > 0, said).otherwise(looked_up(kinds, MATCHED_CATEGORIES))


def weaknesses() -> list[tuple[int, str, str]]:
    """(number, category, expert), one row a number."""
    at = {n: c for c, numbers in CATEGORIES.items() for n in numbers}
    return [(n, c, EXPERT_OF[c]) for n, c in sorted(at.items())]


def weakness_table(spark: SparkSession) -> DataFrame:
    """The dimension: a fixed table of under a hundred rows."""
    return spark.createDataFrame(weaknesses(), "number int, category string, expert string")


def expert_table(spark: SparkSession) -> DataFrame:
    rows = [(f, c, f != "lifetime_resource", i) for i, (f, c) in enumerate(EXPERT_CODES.items())]
    return spark.createDataFrame(rows, "family string, expert_code string, active boolean, ordinal int")


def weakness_number(text: Column) -> Column:
    """The first number in a text such as "cwe-0190 / x" as int, null without one or above nine digits."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int")


def normal_name(text: Column) -> Column:
    """CWE-n from any spelling; null without a number."""
    return F.concat(F.lit("CWE-"), weakness_number(text).cast("string"))


def crash_class(description: Column) -> Column:
    """struct(expert, number) of a crash description; the first rule decides, control_state without number else."""
    plain = F.lower(description)
    out = None
    for phrases, expert, number in CRASH_RULES:
        met = F.lit(False)
        for p in phrases:
            met = met | F.contains(plain, F.lit(p))
        given = F.when(F.contains(plain, F.lit("write")), 787).otherwise(125) if number is None else F.lit(number)
        row = F.struct(F.lit(expert).alias("expert"), given.cast("int").alias("number"))
        out = F.when(met, row) if out is None else out.when(met, row)
    return out.otherwise(F.struct(F.lit("control_state").alias("expert"), F.lit(None).cast("int").alias("number")))
