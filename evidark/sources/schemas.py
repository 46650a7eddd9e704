"""Schemas of the engine's entities."""

from __future__ import annotations

EVIDENCE = "array<struct<evidence_id:string,kind:string,file:string,line:int,expression:string,function:string,subject:string,object:string,facts:map<string,string>>>"
HYPOTHESES = "array<struct<cwe:string,confidence:double,evidence_ids:array<string>,reasons:array<string>>>"
CANDIDATE = f"candidate_id:string,project_id:string,file:string,function:string,line_start:int,line_end:int,code:string,evidence:{EVIDENCE},features:map<string,double>,suspicion_score:double,static_score:double,callers:array<string>,callees:array<string>,feature_schema_version:string,cwe_hypotheses:{HYPOTHESES}"
TRUTH = "truth_id:string,file:string,function:string,line_start:int,line_end:int,experts:array<string>,cwes:array<string>"
CASES = f"case_id string, project_id string, source_files map<string,string>, split string, vulnerable_revision string, fixed_revision string, ground_truth array<struct<{TRUTH}>>, metadata map<string,string>"
ROUTER_SAMPLES = f"candidate struct<{CANDIDATE}>, labels array<string>"
OUTCOMES = (
    f"case_id string, candidate struct<{CANDIDATE}>, assignment struct<expert:string,model_id:string,prompt_version:string,expected_cost:double>, "
    "success boolean, false_positive boolean, unsupported_claims int, cost double, matched_truth_ids array<string>, ground_truth_ids array<string>, "
    "prompt_tokens int, completion_tokens int, latency_seconds double, truth_labels_available boolean, label_version string, "
    "validated_true_findings int, validated_false_findings int, rejected_findings int"
)
FINDING = "finding_id string, candidate_id string, expert string, title string, root_cause string, consequence string, file string, function string, line_start int, line_end int, cwes array<string>, source string, sink string, missing_guard string, trigger_path array<string>, evidence_ids array<string>, confidence double"
CRASHES = "local_id int, project string, crash_type string, crash_output string, severity string, report string, fix_commit string, repo_addr string, patch_url string, sanitizer string, fuzz_target string, fuzz_engine string, language string, reproduced int, patch_located int, submodule_bug int"
SARIF = "runs array<struct<properties:map<string,string>,artifacts:array<struct<location:struct<uri:string>>>,results:array<struct<ruleId:string,taxa:array<struct<id:string>>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,index:int>,region:struct<startLine:int,endLine:int>>>>>>>>"
KNOWLEDGE = "knowledge_id string, title string, content string, families array<string>, tags array<string>, source string"
LEDGER = "request_id string, model string, status string, prompt_tokens int, completion_tokens int, cost double, at string, error string"
SCENARIOS = "case_id string, package_id string, cwe string, expert string, template_group string, exact_hash string, canonical_hash string, duplicate_of string, leakage_group string, split string, scenario_json string"
