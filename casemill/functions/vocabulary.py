"""Fixed values of the canonical model: names, vocabularies, patterns and thresholds."""

# The canonical columns in their order, with their types.
CANONICAL = {
    "ticket_id": "string", "created_at": "timestamp_ntz", "customer_id_hash": "string", "customer_segment": "string", "region": "string",
    "channel": "string", "product_area": "string", "issue_type": "string", "issue_subject": "string", "issue_description": "string",
    "issue_text": "string", "priority": "string", "status": "string", "sla_plan": "string", "assigned_team": "string", "resolved_at": "timestamp_ntz",
    "sla_deadline": "timestamp_ntz", "first_response_at": "timestamp_ntz", "reopened": "boolean", "escalated": "boolean", "sla_breached": "boolean",
    "response_time_hours": "double", "resolution_time_hours": "double", "csat_score": "double", "resolution_notes": "string",
}
NULL_TOKENS = ["", "na", "n/a", "null", "none", "nan", "-", "--", "unknown"]
STATUS = ["open", "pending", "resolved", "closed", "cancelled"]
TRUE_TOKENS, FALSE_TOKENS = ["yes", "true", "1", "y", "t"], ["no", "false", "0", "n", "f"]
BOILERPLATE = [
    "", "n/a", "na", "nan", "none", "null", "-", "--", "resolved", "closed", "done", "fixed", "ok", "no", "nil",
    "not applicable", "no resolution", "no notes", "test",
]
LEAKAGE = [
    "escalated", "escalation", "sla breach", "breached sla", "missed sla", "sla was missed", "reopened", "re-opened",
    "ticket was closed", "resolved by", "refund issued",
]
PERSONAL_HINTS = ["name", "email", "phone", "gender", "age", "address", "customer_id"]

#: Names of columns that never say when a case was created, and what the columns of a source may be called.
CREATED_AT_TRAPS = r"(?i)purchase|order[_ ]?date|signup|registration|birth|renewal|subscription[_ ]?start"
COLUMN_HINTS = {
    "ticket_id": ["ticket id", "ticket_id", "ticketid", "id", "case id", "incident id"],
    "created_at": ["date of ticket", "ticket date", "created", "created at", "opened", "open date", "reported", "submitted"],
    "resolved_at": ["resolved", "closed at", "close date", "resolution date", "completion"],
    "first_response_at": ["first response", "first reply", "responded at"],
    "sla_deadline": ["sla due", "sla deadline", "due date", "target resolution"],
    "customer_segment": ["segment", "tier", "plan tier", "account type"],
    "product_area": ["product", "product purchased", "product area", "component", "module"],
    "issue_type": ["ticket type", "issue type", "category", "request type"],
    "priority": ["priority", "severity", "urgency"],
    "status": ["status", "state", "ticket status"],
    "channel": ["channel", "source", "ticket channel", "contact method"],
    "platform": ["platform", "os", "device"],
    "region": ["region", "country", "geo", "location"],
    "sla_plan": ["sla plan", "sla", "support plan", "service level"],
    "issue_subject": ["subject", "title", "summary", "short description"],
    "issue_description": ["description", "body", "ticket description", "issue"],
    "resolution_notes": ["resolution", "resolution notes", "solution", "close notes"],
    "response_time_hours": ["first response time", "response time"],
    "resolution_time_hours": ["time to resolution", "resolution time", "handling time"],
    "reopened": ["reopened", "re-opened"],
    "escalated": ["escalat"],
    "sla_breached": ["sla breach", "breached", "sla met", "missed sla"],
    "csat_score": ["satisfaction", "csat", "rating", "score"],
}

URL_QUERY = r"(?i)\bhttps?://[^\s<>\"]+\?[^\s<>\"]*"
URL = r"(?i)\bhttps?://[^\s<>\"]+"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
API_KEY = (
    r"\b(?:sk-[A-Za-z0-9_\-]{16,}|xox[baprs]-[A-Za-z0-9\-]{10,}|gh[pousr]_[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}"
    r"|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})\b"
)
CARD = r"\b(?:\d[ \-]?){13,19}\b"
KEYED_SECRET = r"(?i)\b(api[_\- ]?key|token|password|passwd|secret|bearer)\b\s*[:=]?\s*[\"']?([A-Za-z0-9._\-]{8,})[\"']?"
ACCOUNT = r"(?i)\b((?:account|acct|acc|order|invoice|customer)\s*(?:no\.?|number|id|#)?\s*[:#]?\s*)([A-Za-z]{0,4}[\-]?\d{5,})\b"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)[\s.\-]?)?\d{3,4}[\s.\-]?\d{3,4}(?:[\s.\-]?\d{2,4})?(?![\w.])"
PLACEHOLDER = r"(?i)(\{\{?[a-z_ ]{2,40}\}?\}|<[a-z_ ]{2,40}>|\[[a-z_ ]{2,40}\]|\bX{4,}\b|\blorem ipsum\b)"
OWN_TOKENS = ["[url]", "[email]", "[secret]", "[ip]", "[card]", "[account]", "[phone]"]
TECHNICAL = r"\b(?:[A-Za-z]+[_\-]\d+|v\d+(?:\.\d+)+|[A-Z]{2,6}\d{0,4}|\d{3})\b"

ASKS = (
    r"(?i)\b(?:could you (?:please )?(?:provide|share|let me know|confirm|send|specify)|please (?:provide|share|confirm|send|let us know|specify|advise)"
    r"|can you (?:please )?(?:provide|share|confirm|send)|kindly (?:provide|share|confirm)|(?:more|additional|further) (?:information|details)"
    r"|to (?:better )?assist you|we (?:will|are) (?:currently )?(?:investigat|look|review|work)|our (?:technical )?team is (?:actively )?(?:working|investigating)"
    r"|thank you for (?:reaching out|contacting)|we (?:apologi[sz]e|regret)|what (?:operating system|browser|version|error))"
)
_DONE = (
    r"refunded|voided|reset|restored|corrected|updated|enabled|disabled|replaced|reissued|escalated|applied|cleared|fixed|repaired|migrated|configured"
    r"|allow-?listed|whitelisted|reinstalled|patched|credited|switched|moved|increased|decreased|raised|lowered|removed|deleted|added|installed"
    r"|rebooted|restarted|rotated|renewed|cancelled|canceled|processed|deployed"
)
ACTION = (
    rf"(?im)(?:(?:^|(?<=[.!?]\s)|(?<=[.!?]\s\s))\s*(?:{_DONE})\b|\b(?:and|then|so)\s+(?:{_DONE})\b"
    r"|\b(?:(?:we|i) (?:have )?(?:refunded|voided|reset|restored|corrected|updated|enabled|disabled|replaced|reissued|escalated|applied|cleared|fixed"
    r"|repaired|migrated|configured|allow-?listed|whitelisted|rolled back|reinstalled|patched|credited)"
    r"|(?:has|have|was|were) been (?:refunded|reset|restored|corrected|resolved|fixed|replaced|reissued|credited|applied|updated|patched)"
    r"|(?:issue|problem|error|outage) (?:was|has been|is now) (?:resolved|fixed|corrected)|resolved (?:by|after|following)|(?:the )?(?:root )?cause was"
    r"|turned out to be|fix(?:ed)? (?:was )?(?:deployed|shipped|released)))"
)
INJECTION = {
    "instruction_override": r"(?i)\b(?:ignore|disregard|forget|override|bypass)\b[^.\n]{0,40}?\b(?:previous|prior|above|earlier|all|any|the)\b[^.\n]{0,20}?"
    r"\b(?:instruction|instructions|prompt|prompts|rule|rules|context|direction|directions|guideline|guidelines)\b",
    "system_prompt_probe": r"(?i)\b(?:system\s+prompt|initial\s+prompt|your\s+instructions|reveal\s+your|print\s+your|repeat\s+your|show\s+me\s+your)\b",
    "role_reassignment": r"(?i)\b(?:you\s+are\s+now|from\s+now\s+on\s+you|act\s+as\s+(?:a|an|the)|pretend\s+to\s+be|roleplay\s+as|assume\s+the\s+role)\b",
    "role_token_injection": r"(?i)(?:^|\n)\s*(?:###\s*)?(?:system|assistant|user|human)\s*[:>]",
    "delimiter_escape": r"(?i)(?:</?(?:evidence|instruction|system|prompt|context)\s*>|\[/?(?:INST|SYS|EVIDENCE)\]|<\|[a-z_]{2,20}\|>)",
    "exfiltration_request": r"(?i)\b(?:send|post|upload|email|forward|exfiltrate|leak)\b[^.\n]{0,25}?\b(?:context|prompt|instructions?|conversation|chat\s+history"
    r"|system\s+message|everything|all\s+(?:the\s+)?(?:data|tickets?|records?)|contents?|every\s+ticket)\b[^.\n]{0,40}?"
    r"(?:\[URL\]|\[EMAIL\]|https?://|[\w.\-]+@[\w.\-]+|\bwebhook\b|\bendpoint\b)",
    "tool_or_capability_coercion": r"(?i)\b(?:call\s+the\s+tool|execute|run)\b[^.\n]{0,25}?\b(?:command|shell|script|sql|query)\b"
    r"|\bdelete\s+(?:all|every|the)\b[^.\n]{0,20}?\b(?:record|ticket|row|data)s?\b",
    "urgency_authority_claim": r"(?i)\b(?:as\s+(?:an?\s+)?(?:admin|administrator|developer|engineer|anthropic|openai)\b"
    r"|this\s+is\s+(?:a\s+)?(?:test\s+mode|debug\s+mode|authorized)\b|you\s+(?:are|have\s+been)\s+(?:authorized|permitted|allowed)\b)",
}
OVERCLAIM = {
    "guarantee": r"(?i)\b(?:guarantee[sd]?|guaranteed)\b",
    "certainty": r"(?i)100\s*%|\b(?:definitely|certainly|undoubtedly|without\s+(?:a\s+)?doubt|absolutely\s+(?:will|works))\b",
    "always_never": r"(?i)\b(?:always\s+(?:works|fixes|resolves|solves)|never\s+fails|cannot\s+fail)\b",
    "risk_free": r"(?i)\b(?:risk[\s\-]?free|no\s+risk|completely\s+safe|fully\s+automatic(?:ally)?\s+resolv)\b",
    "auto_resolution": r"(?i)\bautomatic(?:ally)?\s+(?:resolve[sd]?|resolution)\b",
    "will_definitely_fix": r"(?i)\bthis\s+will\s+(?:fix|resolve|solve)\b",
}
# End of fixed values.
