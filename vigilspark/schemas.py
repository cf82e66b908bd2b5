"""Explicit schemas of what comes from outside; nothing is inferred."""

from __future__ import annotations

FINDING = (
    "schema_version string, id string, host string, view string, target struct<kind:string,process:struct<pid:int,name:string,user:string>,file:struct<path:string,sha256:string,mtime:string>>, "
    "artifact struct<kind:string,identity:string,location:string>, detection struct<basis:string,knowledge_ref:string,evidence:string,allowlisted:boolean>, "
    "classification struct<family:string,capability:array<string>,confidence:double,source:string>, score int, tier string, correlation_id string, mitre array<string>, fingerprint string, context map<string,string>"
)
SKIPS = "struct<unreadable:int,not_regular:int,over_limit:int,no_detector:int>"
COVERAGE = f"struct<view:string,status:string,reason:string,targets_scanned:int,skipped:{SKIPS},truncated:boolean>"
REPORT = (
    "schema_version string, scan struct<host:string,started:string,finished:string,tool_version:string,run_id:string,operator:string,invocation:string>, "
    f"verdict struct<tier:string,score:int,incomplete:boolean>, coverage array<{COVERAGE}>, findings array<struct<{FINDING}>>, _corrupt string"
)
ENGINE_MATCH = "path string, rules array<struct<identifier:string,namespace:string,meta:string,strings:array<struct<identifier:string,offset:long,match:string>>>>, _corrupt string"
EVENT_XML = (
    "System struct<Provider:struct<_Name:string>,EventID:int,Channel:string,Computer:string,TimeCreated:struct<_SystemTime:string>>, "
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
)
EVENT = "host string, channel string, provider string, event_id int, time string, data map<string,string>, values array<string>"
