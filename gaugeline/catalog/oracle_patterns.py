"""The report formats as DuckDB's patterns: fixed values stated for the oracle alone, so that a slip in the engine's own shows."""

from __future__ import annotations

SKILL_MARKER = r"🔐 Security Review"
SKILL_FINDING = r"^\[(\d+)\]\s+\*\*(\d+)\.\s+(.+?)\*\*"
SKILL_LOCATION = r"^`([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)`\s+·"
SKILL_TABLE_ROW = r"^\|\s*(\d+)\s*\|\s*\[(\d+)\]\s*\|\s*(.+?)\s*\|"
BARE_HEADERS = [
    ("word", r"(?i)^#{2,4}\s+\[(CRITICAL|HIGH|MEDIUM|LOW|INFO)\]\s+(.+?)(?:\s+—\s+(.+))?$"),
    ("prefix", r"(?i)^#{2,4}\s+(C|H|M|L|I)-\d+[.:]\s+(.+?)(?:\s+—\s+(.+))?$"),
    ("bracket", r"(?i)^#{2,4}\s+\[(C|H|M|L|I)-\d+\]\s+(.+?)(?:\s+—\s+(.+))?$"),
    ("trailing", r"(?i)^#{2,4}\s+\d+\.\s+(.+?)\s+—\s+\*\*(CRITICAL|HIGH|MEDIUM|LOW|INFO)\*\*$"),
    ("paren", r"(?i)^#{2,4}\s+\d+\.\s+(.+?)\s+\((Critical|High|Medium|Low|Info)\)\s*$"),
    ("inline", r"(?i)^\*\*\d+\.\s+\[(CRITICAL|HIGH|MEDIUM|LOW|INFO)\]\s+(.+?)(?:\s+—\s+(.+?))?\*\*\s*$"),
    ("section", r"^#{2,4}\s+\d+\.\s+(.+?)$"),
    ("confidence", r"^#{2,4}\s+\[(\d+)\]\s+\d+\.\s+(.+?)$"),
]
SEVERITY_SECTION = r"(?i)^#{1,3}\s+(?:(Critical)(?:\s*\/?\s*High)?|(High)|(Medium)|(Low)|(Informational|Info))\s+Severity"
CONTRACT_SECTION = r"^#{2,4}\s+(\w+)\.sol\s*$"
SECTION_RESET = r"(?i)^#{1,2}\s+(Summary|Appendix|Disclaimer)\b"
SUMMARY_COUNT_ROW = r"(?i)^\|\s*(Critical|High|Medium|Low|Info)\s*\|\s*(\d+)\s*\|"
SUMMARY_ROW = r"(?i)^\|\s*(Critical|High|Medium|Low|Info)\s*\|"
BARE_MARKERS = [
    r"(?im)^#{2,4}\s+\[(CRITICAL|HIGH|MEDIUM|LOW)",
    r"(?im)^#{2,4}\s+(H|M|L|I)-\d+[.:]",
    r"(?im)^#{2,4}\s+\[(H|M|L|I)-\d+\]",
    r"(?im)^#{2,4}\s+\d+\.\s+.+?\s+—\s+\*\*(CRITICAL|HIGH|MEDIUM|LOW|INFO)\*\*",
    r"(?im)^#{2,4}\s+\d+\.\s+.+?\s+\((Critical|High|Medium|Low|Info)\)",
]
NUMBERED_HEADING = r"(?m)^#{2,4}\s+\d+\.\s+"
KEYWORD_RULES = [
    ("reentrancy", r"(?i)reentranc"),
    ("access-control", r"(?i)access.?control|missing.?(?:access|owner|auth)|unrestricted|unprotected|(?:anyone|any\s+user).*can"),
    ("unchecked-return", r"(?i)unchecked.{0,3}(?:return|send|call)|silent.*(?:fail|fund|loss)"),
    ("tx-origin", r"(?i)tx\.origin|phishing"),
    ("overflow", r"(?i)overflow|underflow|truncat"),
    ("frontrunning", r"(?i)front.?run|sandwich|mev"),
    ("dos", r"(?i)dos|denial.?of.?service"),
    ("flash-loan", r"(?i)flash.?loan"),
    ("oracle-manipulation", r"(?i)oracle|price.?manipul"),
    ("delegatecall", r"(?i)delegatecall"),
    ("selfdestruct", r"(?i)selfdestruct"),
    ("integer-issue", r"(?i)integer"),
]
DOTTED_NAME = r"\b([A-Z]\w+)\.(\w+)"
SOURCE_FILE = r"`?(\w+)\.sol"
CALLED_FUNCTION = r"`(\w+)\(\)`"
NAMED_FUNCTION = r"(?:in|on)\s+`(\w+)`"
DESCRIPTION_STOP = r"^#{2,4}\s+|^\[\d+\]\s+\*\*\d+\.|^\*\*\d+\.\s+\["
DESCRIPTION_SKIP = r"^`[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*`\s+·"
CODE_FENCE = r"(?s)```.*?```"
DESCRIPTION_LINES = 19
SKILL_HEADER_START = r"(?m)^\[\d+\]\s+\*\*\d+\.\s+"
NOT_A_FINDING = [
    (
        r"(?i)^#{1,3}\s+(Summary|Overview|Methodology|Scope|Appendix|Disclaimer|Conclusion|Recommendations"
        r"|Table of Contents|Introduction|Findings?\s+Summary)"
    ),
    r"(?i)^#{1,3}\s+(Critical|High|Medium|Low|Informational|Info)\s+(Severity|Risk|Issues?)\s*$",
    r"(?i)^#{1,2}\s+\w+\.sol\s*$",
]
FINDING_LIKE = [
    r"(?i)^#{2,4}\s+\[(CRITICAL|HIGH|MEDIUM|LOW|INFO)\]",
    r"(?i)^#{2,4}\s+(C|H|M|L|I)-\d+",
    r"(?i)^#{2,4}\s+\[(C|H|M|L|I)-\d+\]",
    r"(?i)^#{2,4}\s+\d+\.\s+.+?\s+—\s+\*\*(CRITICAL|HIGH|MEDIUM|LOW)",
    r"(?i)^#{2,4}\s+\d+\.\s+.+?\s+\((Critical|High|Medium|Low)",
    r"(?i)^\*\*\d+\.\s+\[(CRITICAL|HIGH|MEDIUM|LOW)",
]
NUMBERED_LINE = r"^#{2,4}\s+\d+\.\s+\S"
SEVERITY_ABOVE = r"(?i)^#{1,3}\s+(Critical|High|Medium|Low|Informational|Info)\s+(Severity|Risk)"
SEVERITY_ABOVE_LINES = 20
BLOCK_HEADING = r"^#{2,4}\s+\S"
BLOCK_BOLD = r"^\*\*\d+\.\s+"
BLOCK_STOP = r"^#{1,4}\s+|^\*\*\d+\."
BLOCK_LINES = 10
NOT_A_BLOCK = [
    (
        r"(?i)^(Summary|Overview|Methodology|Scope|Appendix|Disclaimer|Conclusion|Recommendations"
        r"|Table of Contents|Introduction|Findings?\s+Summary|Detailed\s+Findings|Audit\s+Report"
        r"|Security\s+Assessment|Executive|References|Severity\s+Classification|Risk\s+Rating)"
    ),
    r"(?i)^(Critical|High|Medium|Low|Informational|Info)\s+(Severity|Risk|Issues?)\s*$",
    r"(?i)^\w+\.sol\s*$",
]
SIGNAL_WORDS = (
    r"(?i)\b(vulnerab|attack|exploit|risk|impact|severity|reentrancy|reentrant|overflow|underflow"
    r"|access\s*control|unauthorized|unchecked|front.?run|sandwich|mev|flash.?loan|oracle|manipulation"
    r"|delegatecall|selfdestruct|dos|denial|phishing|tx\.origin|slippage|liquidat|privilege|escala|bypass|inject"
    r"|drain|steal|siphon|lock|freeze|grief|censor|int(eger)?.*overflow|critical|high|medium|low)\b"
)

# Words of the report stand-in.
REPORT_KEYWORDS = [
    "Reentrancy", "Missing Access Control", "Unchecked Return Value", "Phishing via tx.origin",
    "Unsafe Overflow", "Front-Running", "Denial of Service", "Flash Loan Attack", "Oracle Manipulation",
    "Delegatecall Misuse", "Selfdestruct Exposure", "Integer Division", "Floating Pragma",
    "Weak Naming",
]
REPORT_CONTRACTS = ["Vault", "Bridge", "Router", "TokenSale", "PriceOracle"]
REPORT_FUNCTIONS = ["withdraw", "transfer", "swap", "buy", "getPrice"]
REPORT_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
