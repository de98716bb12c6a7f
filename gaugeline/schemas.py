"""Explicit schemas of the files the engine reads; nothing is inferred."""

from __future__ import annotations

CODEBASE = "struct<id:string,path:string,gitCommit:string>"

CONDITION = (
    "struct<id:string,type:string,prompt:string,skillVersion:string,command:string,deep:boolean,"
    "fileOutput:boolean,expectedMinAgents:int>"
)

CONFIG = f"struct<codebases:array<{CODEBASE}>,conditions:array<{CONDITION}>,defaultRunsPerCondition:int>"

RUN_META = (
    "struct<runId:string,codebaseId:string,conditionId:string,iteration:int,mode:string,timestampUtc:string,"
    "durationMs:bigint,exitCode:int,timedOut:boolean,codebaseGitCommit:string,skillVersion:string,"
    "skillGitCommit:string,deep:boolean,fileOutput:boolean,expectedMinAgents:int,model:string,claudeModel:string>"
)

GROUND_TRUTH = (
    "struct<codebaseId:string,source:string,findings:array<struct<id:string,severity:string,title:string,"
    "rootCause:string,location:string,line:string,description:string,judgeVerdict:string>>>"
)

VOTE = "struct<category:string,matchedGtId:string,confidence:string,reasoning:string>"

CLASSIFICATIONS = (
    "struct<runId:string,codebaseId:string,conditionId:string,classifiedAt:string,classifierModel:string,"
    "gtHash:string,stdoutHash:string,promptHash:string,votesPerFinding:int,classifications:array<struct<"
    "findingIndex:int,findingTitle:string,category:string,matchedGtId:string,agreement:string,reasoning:string,"
    f"votes:array<{VOTE}>>>>"
)

CLUSTERS = (
    "struct<codebaseId:string,clusteredAt:string,clusterModel:string,inputHash:string,totalFindings:bigint,"
    "uniqueBugs:bigint,clusters:array<struct<clusterId:string,title:string,reasoning:string,severity:string,"
    "foundIn:array<struct<runId:string,conditionId:string,findingIndex:int,findingTitle:string>>,"
    "conditionsCaught:array<string>,relevantFiles:array<string>>>>"
)

VALIDATIONS = (
    "struct<codebaseId:string,validatedAt:string,validatorModel:string,clusterHash:string,confirmed:int,"
    "plausible:int,rejected:int,validations:array<struct<clusterId:string,title:string,verdict:string,"
    "severity:string,reasoning:string,codeEvidence:string,riskCategory:string>>>"
)

# ``content`` of a tool result is a string or an array of blocks, hence VARIANT.
EVENT = (
    "struct<type:string,subtype:string,parent_tool_use_id:string,model:string,slash_commands:array<string>,"
    "tools:array<string>,stop_reason:string,num_turns:bigint,duration_ms:bigint,total_cost_usd:double,"
    "rate_limit_info:struct<status:string>,message:struct<model:string,content:array<struct<type:string,text:string,"
    "name:string,id:string,input:map<string,string>,tool_use_id:string,content:variant,is_error:boolean>>>>"
)
