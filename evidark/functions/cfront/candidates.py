"""From facts to hypotheses, features and scored candidates, and the Spark operator that makes them from files."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidark.functions.cfront.facts import ALLOCATORS, CHECKS, COPIES, LOCKS, RELEASES, SINKS, SOURCES, SPAWNS, UNLOCKS, USES, Analysis, analyse, canonical
from evidark.functions.scores import SEMANTIC_VERSION, SUSPICION_WEIGHTS, suspicion
from evidark.functions.taxonomy import CATEGORIES

# Weakness and weight of each kind of fact; an index by its access; a sink by its name.
RULES = {
    "memory_copy_without_guard": (120, 0.95), "use_after_release": (416, 1.0), "double_release": (415, 1.0), "unchecked_nullable_dereference": (476, 0.95),
    "arithmetic_to_allocation": (190, 0.95), "arithmetic_to_memory_sink": (190, 0.95), "cast_to_size_sink": (681, 0.95), "numeric_conversion": (681, 0.90),
    "uninitialized_use": (457, 1.0), "unchecked_call_result": (252, 0.90), "toctou_check_use": (367, 1.0),
}
INDEX_RULES = {"array_write": 787, "array_read": 125}
SINK_RULES = {"system": 78, "popen": 78, "open": 22, "fopen": 22, "printf": 134, "fprintf": 134}
KINDS = sorted({*RULES, "unchecked_index", "source_to_sink", "unsanitized_source_to_sink", "memory_copy", "allocation", "release", "taint_source", "taint_sink", "guard_protects_sink", "thread_spawn", "lock_acquire", "lock_release"})
FEATURE_NAMES = [
    *[f"{k}_count" for k in KINDS], "array_access_count", "dereference_count", "call_count", "condition_count", "loop_count", "return_count", "parameter_count",
    "line_count", "statement_count", "evidence_count", "hypothesis_count", "max_confidence", "guard_ratio", *[f"cwe_{c}_score" for c in CATEGORIES],
]
RELEVANT = {*ALLOCATORS, *RELEASES, *COPIES, *SOURCES, *SINKS, *SPAWNS, *LOCKS, *UNLOCKS, *CHECKS, *USES}
MOST_HYPOTHESES = 8


def hypotheses(a: Analysis) -> list[dict]:
    """Weaknesses with their largest confidence and all evidence, the best eight."""
    found: dict[int, dict] = {}

    def add(number: int, confidence: float, fact_id: str, reason: str) -> None:
        h = found.setdefault(number, {"cwe": number, "confidence": 0.0, "evidence": set(), "reasons": set()})
        h["confidence"] = max(h["confidence"], min(1.0, max(0.0, confidence)))
        h["evidence"].add(fact_id)
        h["reasons"].add(reason)

    unsanitized = [f for f in a.facts if f.kind == "unsanitized_source_to_sink"]
    for f in a.facts:
        if f.kind in RULES:
            number, weight = RULES[f.kind]
            add(number, f.confidence * weight, f.fact_id, f.kind)
        elif f.kind == "unchecked_index":
            add(INDEX_RULES.get(f.attributes.get("access"), 129), f.confidence * 0.95, f.fact_id, f.kind)
        elif f.kind == "unsanitized_source_to_sink":
            add(20, f.confidence * 0.80, f.fact_id, f.kind)
        elif f.kind == "taint_sink" and f.object in SINK_RULES:
            for u in unsanitized:  # every sink with every unsanitised path of the function
                number = SINK_RULES[f.object]
                add(number, f.confidence * (0.90 if number != 134 else 1.0), f.fact_id, f"{u.object} from {u.subject}")
    out = sorted(found.values(), key=lambda h: (-h["confidence"], h["cwe"]))[:MOST_HYPOTHESES]
    return [{"cwe": f"CWE-{h['cwe']}", "confidence": h["confidence"], "evidence_ids": sorted(h["evidence"]), "reasons": sorted(h["reasons"])} for h in out]


def features(a: Analysis, hyps: list[dict]) -> dict[str, float]:
    """All FEATURE_NAMES, zero filled and finite."""
    nodes = a.g.nodes.values()
    kinds = Counter(f.kind for f in a.facts)
    out = dict.fromkeys(FEATURE_NAMES, 0.0)
    out |= {f"{k}_count": float(n) for k, n in kinds.items()}
    out |= {
        "array_access_count": sum(x.kind.startswith("array") for n in nodes for x in n.accesses), "dereference_count": sum(x.kind == "dereference" for n in nodes for x in n.accesses),
        "call_count": sum(len(n.calls) for n in nodes), "condition_count": sum(n.kind == "condition" for n in nodes), "loop_count": len({b for _, b, k in a.g.edges if k == "loop_back"}),
        "return_count": sum(n.kind == "return" for n in nodes), "parameter_count": len(a.g.nodes[0].defs), "line_count": a.f.line_end - a.f.line_start + 1, "statement_count": len(nodes) - 2,
        "evidence_count": len(a.facts), "hypothesis_count": len(hyps), "max_confidence": max([h["confidence"] for h in hyps], default=0.0),
        "guard_ratio": kinds["guard_protects_sink"] / max(1, kinds["memory_copy"]),
    }
    category = {n: c for c, ns in CATEGORIES.items() for n in ns}
    for h in hyps:
        c = category.get(int(h["cwe"][4:]))
        if c:
            out[f"cwe_{c}_score"] = max(out[f"cwe_{c}_score"], h["confidence"])
    out = {k: float(v) for k, v in out.items()}
    if not all(map(math.isfinite, out.values())):
        raise ValueError("a feature is not finite")
    return out


def wanted(a: Analysis) -> bool:
    """Functions worth a candidate: with facts, accesses or calls of the catalog."""
    return bool(a.facts) or any(n.accesses for n in a.g.nodes.values()) or any(canonical(c.name) in RELEVANT for n in a.g.nodes.values() for c in n.calls)


FACT_TYPE = pa.struct([("fact_id", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("sink_line", pa.int32()), ("subject", pa.string()), ("object", pa.string()), ("symbols", pa.list_(pa.string())), ("path", pa.list_(pa.string())), ("confidence", pa.float64()), ("attributes", pa.map_(pa.string(), pa.string()))])
HYPOTHESIS_TYPE = pa.struct([("cwe", pa.string()), ("confidence", pa.float64()), ("evidence_ids", pa.list_(pa.string())), ("reasons", pa.list_(pa.string()))])
ROW = pa.schema([
    ("case_id", pa.string()), ("file", pa.string()), ("function", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("code", pa.string()), ("callees", pa.list_(pa.string())),
    ("evidence", pa.list_(FACT_TYPE)), ("hypotheses", pa.list_(HYPOTHESIS_TYPE)), ("features", pa.map_(pa.string(), pa.float64())), ("warnings", pa.list_(pa.string())), ("error", pa.string()),
])
DDL = (
    "case_id string, file string, function string, line_start int, line_end int, code string, callees array<string>, "
    "evidence array<struct<fact_id:string,kind:string,line:int,sink_line:int,subject:string,object:string,symbols:array<string>,path:array<string>,confidence:double,attributes:map<string,string>>>, "
    "hypotheses array<struct<cwe:string,confidence:double,evidence_ids:array<string>,reasons:array<string>>>, features map<string,double>, warnings array<string>, error string"
)


def rows_of(case_id: str, file: str, code: str) -> list[dict]:
    out = []
    for a in analyse(code):
        if wanted(a):
            hyps = hypotheses(a)
            callees = sorted({canonical(c.name) for n in a.g.nodes.values() for c in n.calls})
            facts = [{k: (list(v.items()) if k == "attributes" else v) for k, v in vars(f).items()} for f in a.facts]
            out.append({"case_id": case_id, "file": file, "function": a.f.name, "line_start": a.f.line_start, "line_end": a.f.line_end, "code": a.f.code, "callees": callees, "evidence": facts, "hypotheses": hyps, "features": list(features(a, hyps).items()), "warnings": a.g.warnings + a.g.unsupported, "error": None})
    return out


def analyse_files(files: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """Candidates of files (case_id, file, source): one row a function worth one, with score and id.

    One Arrow pass parses each file; a file that fails or passes the cap gives a row with ``error`` and nothing else, so
    its case still counts. Scores and ids are column expressions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for case_id, file, source in zip(*[c.to_pylist() for c in batch.columns]):
                blank = dict.fromkeys(ROW.names) | {"case_id": case_id, "file": file}
                try:
                    if source is not None and len(source.encode()) > most_bytes:
                        raise ValueError(f"source is larger than {most_bytes} bytes")
                    out += rows_of(case_id, file, source or "")
                except Exception as e:  # one bad file must not end the run
                    out.append(blank | {"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, ROW)

    parsed = files.select(F.col("case_id").cast("string"), "file", "source").mapInArrow(run, DDL)
    digest = F.sha1(F.concat_ws(":", "case_id", "file", "function", F.col("line_start").cast("string"), F.col("line_end").cast("string")))
    return parsed.withColumns({"candidate_id": F.when(F.col("error").isNull(), F.concat(F.lit("C-"), F.substring(digest, 1, 16))), "suspicion_score": F.when(F.col("error").isNull(), suspicion(F.col("features"), SUSPICION_WEIGHTS)), "feature_schema_version": F.lit(SEMANTIC_VERSION)})


def evidence_rows(candidates: DataFrame) -> DataFrame:
    """One row a fact, at its sink's line, else its own, else the function's first."""
    e = candidates.where("error IS NULL").select("case_id", "file", "candidate_id", "line_start", F.explode("evidence").alias("f"))
    digest = F.sha1(F.concat_ws(":", "candidate_id", "f.fact_id"))
    return e.select("case_id", "file", "candidate_id", F.concat(F.lit("EV-"), F.substring(digest, 1, 16)).alias("evidence_id"), "f.kind", F.coalesce("f.sink_line", "f.line", "line_start").alias("line"), "f.subject", "f.object", "f.confidence")


