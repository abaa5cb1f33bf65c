"""Schemas of the records that pipelines read: stated, never inferred."""

from __future__ import annotations

MESSAGES = "array<struct<role:string,content:string>>"

SFT_RECORD = f"source_id string, language string, kind string, messages {MESSAGES}, variant int, repeat int"

VERIFICATION = (
    "struct<passed:boolean,tests_sha256:string,hidden_test_count:bigint,code_authority:string,"
    "translation_semantic_score:double,translation_anchors_verified:boolean,"
    "explanation_translation_semantic_score:double,explanation_translation_anchors_verified:boolean,"
    "explanation_verification_method:string,mutation_killed:bigint,mutation_total:bigint>"
)
PARALLEL_RECORD = f"schema string, source_id string, parallel_id string, source string, language string, kind string, runtime string, variant int, code_sha256 string, verification {VERIFICATION}, messages {MESSAGES}"

TASK = "id string, category string, kind string, runtime string, prompt_en string, prompt_sw string, prompt_af string, tests array<string>, forbid array<string>, rubric_en array<string>, rubric_sw array<string>, rubric_af array<string>"

GRADE = "struct<passed:boolean,reason:string,side_effect_free:boolean,duration_seconds:double,stdout:string,stderr:string,score:double,concept_matches:array<boolean>,patterns:array<string>>"
RESULT = f"struct<task_id:string,category:string,kind:string,language:string,prompt:string,response:string,runtime:string,prompt_tokens:bigint,completion_tokens:bigint,inference_seconds:double,technical_pass:boolean,format_compliant:boolean,language_adherent:boolean,grade:{GRADE},error:string>"
LANE = "struct<code_pass_rate:double,format_compliance_rate:double,overall_pass_rate:double,language_adherence_rate:double>"
EVALUATION = f"schema string, model string, model_only boolean, application_contract boolean, self_review boolean, translate_then_solve boolean, nllb_roundtrip_explanations boolean, nllb_model string, application_prompt_strategy string, results array<{RESULT}>, summary struct<languages:map<string,{LANE}>>"

PROFILE = "throughput struct<tokens_per_second_generation:double,first_token_latency_ms:double>, memory struct<peak_rss_mb:double>"
