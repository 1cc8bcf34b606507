"""Spark schemas of the tables the operators take."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


JUDGE_FIELDS = (
    "provider:string,model:string,prompt_version:string,grounding:double,relevance:double,"
    "document_necessity:double,overall:double,gold_alignment:double,refuse_expected:boolean,"
    "brief_reason:string,quality_tier:string,error:string,skipped:boolean,skip_reason:string,raw_preview:string"
)
ANSWERS = "array<struct<text:string,type:string>>"

QA = _struct(
    context="string", question="string", answer="string", source="string", chunk_id="string",
    document_id="string", document_topic="string", ord="bigint",
)
JUDGED = f"{QA}, eval_id string, llm_judge struct<{JUDGE_FIELDS}>"
PREDICTION = _struct(
    condition="string", eval_id="string", question="string", pred="string", gold="string", ord="bigint"
)
MULTI_ANSWER = _struct(
    eval_id="string", section_id="string", title="string", context="string", question="string",
    answers=ANSWERS, unanswerable="boolean", source="string",
)
LISTWISE = _struct(
    eval_id="string", label_to_condition="map<string,string>", ranking_labels="array<string>",
    ranks_by_condition="map<string,double>", points_by_condition="map<string,double>",
    n_candidates="int", error="string",
)
SPAN = _struct(step="string", duration_s="double", status="string", ts_end="timestamp")


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
