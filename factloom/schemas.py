"""What stored columns may hold."""

from __future__ import annotations

#: A block of a message, as DDL.
BLOCK = (
    "struct<type:string,text:string,media_type:string,data_b64:string,url:string,tool_use_id:string,tool_name:string,"
    "tool_input:string,result_text:string,is_error:boolean,original_type:string,payload:string>"
)

# The accepted ones of enumerated columns.
TIERS = ("T1", "T2", "T3", "T4")
RESOLUTIONS = ("e1_correct", "e2_correct", "both_partial", "unresolved")
MODES = ("all", "consistent", "conflict_set")
