"""Record layouts."""

from __future__ import annotations

FINDING_TYPE = "struct<type:string,start:int,end:int,score:double,text:string>"
FINDINGS_DDL = f"array<{FINDING_TYPE}>"

RULE_TYPE = "struct<direction:string,action:string,allow_pii:map<string,string>>"
RULES_DDL = f"map<string,{RULE_TYPE}>"
DEFAULTS_DDL = "map<string,map<string,string>>"

# What a policy document means where it leaves a field out.
DEFAULT_DENY_TOOLS = ("python.exec", "bash.exec", "code.exec", "shell.exec")
DEFAULT_NETWORK_SCOPES = ("net.",)
DEFAULT_NETWORK_TOOLS = ("web.", "http.", "fetch.", "request.")
DEFAULT_ACTION = "redact"
DEFAULT_ON_ERROR = "block"
DEFAULT_MODEL = "gpt-4"
DEFAULT_VERSION = "v1"

BUDGET_CONTEXT_DDL = (
    "struct<monthly_limit:double,current_spend:double,llm_spend:double,"
    "purchase_spend:double,remaining_budget:double,budget_type:string>"
)
TOOL_CONFIG_DDL = (
    "struct<tool_name:string,scope:string,direction:string,metadata:map<string,string>>"
)
BUDGET_STATUS_DDL = (
    "struct<allowed:boolean,current_spend:double,limit:double,remaining:double,"
    "percent_used:double,reason:string>"
)
BUDGET_INFO_DDL = (
    "struct<monthly_limit:double,current_spend:double,llm_spend:double,purchase_spend:double,"
    "remaining_budget:double,estimated_cost:double,estimated_purchase:double,"
    "projected_total:double,percent_used:double,budget_type:string>"
)
