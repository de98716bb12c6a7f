"""Fixed values of the report formats: markers, header patterns and word lists, in their order of priority.

Word borders are spelled out with look-arounds: since Java 19 ``\\b`` is plain ASCII, before it is not, and the formats
mean ASCII words on any Java.
"""

from __future__ import annotations

# White space as trimmed from report lines.
SPACE = (
    " \t\n\u000b\u000c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Structured reports.
SKILL_MARKER = "🔐 Security Review"
SKILL_FINDING = r"^\[(\d+)\]\s+\*\*(\d+)\.\s+(.+?)\*\*"
SKILL_LOCATION = r"^`([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)`\s+·"
SKILL_TABLE_ROW = r"^\|\s*(\d+)\s*\|\s*\[(\d+)\]\s*\|\s*(.+?)\s*\|"

# Free-form reports: finding headers, first match wins. Each is (name, pattern).
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
SEVERITY_LETTERS = {"C": "CRITICAL", "H": "HIGH", "M": "MEDIUM", "L": "LOW", "I": "INFO"}

SEVERITY_SECTION = (
    r"(?i)^#{1,3}\s+(?:(Critical)(?:\s*\/?\s*High)?|(High)|(Medium)|(Low)|(Informational|Info))\s+Severity"
)
CONTRACT_SECTION = r"^#{2,4}\s+(\w+)\.sol\s*$"
SECTION_RESET = r"(?i)^#{1,2}\s+(Summary|Appendix|Disclaimer)(?![A-Za-z0-9_])"
SUMMARY_COUNT_ROW = r"(?i)^\|\s*(Critical|High|Medium|Low|Info)\s*\|\s*(\d+)\s*\|"
SUMMARY_ROW = r"(?i)^\|\s*(Critical|High|Medium|Low|Info)\s*\|"

# Any of these anywhere in the text marks a free-form report.
BARE_MARKERS = [
    r"(?im)^#{2,4}\s+\[(CRITICAL|HIGH|MEDIUM|LOW)",
    r"(?im)^#{2,4}\s+(H|M|L|I)-\d+[.:]",
    r"(?im)^#{2,4}\s+\[(H|M|L|I)-\d+\]",
    r"(?im)^#{2,4}\s+\d+\.\s+.+?\s+—\s+\*\*(CRITICAL|HIGH|MEDIUM|LOW|INFO)\*\*",
    r"(?im)^#{2,4}\s+\d+\.\s+.+?\s+\((Critical|High|Medium|Low|Info)\)",
]
NUMBERED_HEADING = r"(?m)^#{2,4}\s+\d+\.\s+"

# Title keywords, first match wins, otherwise "other".
KEYWORD_RULES = [
    ("reentrancy", r"(?i)reentranc"),
    (
        "access-control",
        r"(?i)access.?control|missing.?(?:access|owner|auth)|unrestricted|unprotected|(?:anyone|any\s+user).*can",
    ),
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

# Locations inside titles.
DOTTED_NAME = r"(?<![A-Za-z0-9_])([A-Z]\w+)\.(\w+)"
SOURCE_FILE = r"`?(\w+)\.sol"
CALLED_FUNCTION = r"`(\w+)\(\)`"
NAMED_FUNCTION = r"(?:in|on)\s+`(\w+)`"

# Descriptions end at these lines, skip location lines and hold at most 300 characters of the next 19 lines.
DESCRIPTION_STOP = r"^#{2,4}\s+|^\[\d+\]\s+\*\*\d+\.|^\*\*\d+\.\s+\["
DESCRIPTION_SKIP = r"^`[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*`\s+·"
CODE_FENCE = r"(?s)```.*?```"
DESCRIPTION_LINES = 19
DESCRIPTION_CHARS = 300

# Estimating how many findings a text holds.
SKILL_HEADER_START = r"(?m)^\[\d+\]\s+\*\*\d+\.\s+"
NOT_A_FINDING = [
    r"(?i)^#{1,3}\s+(Summary|Overview|Methodology|Scope|Appendix|Disclaimer|Conclusion|Recommendations"
    r"|Table of Contents|Introduction|Findings?\s+Summary)",
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

# Blocks that look like findings but were not parsed.
BLOCK_HEADING = r"^#{2,4}\s+\S"
BLOCK_BOLD = r"^\*\*\d+\.\s+"
BLOCK_STOP = r"^#{1,4}\s+|^\*\*\d+\."
BLOCK_LINES = 10
SNIPPET_LINES = 3
MAX_BLOCKS = 10
NOT_A_BLOCK = [
    r"(?i)^(Summary|Overview|Methodology|Scope|Appendix|Disclaimer|Conclusion|Recommendations|Table of Contents"
    r"|Introduction|Findings?\s+Summary|Detailed\s+Findings|Audit\s+Report|Security\s+Assessment|Executive|References"
    r"|Severity\s+Classification|Risk\s+Rating)",
    r"(?i)^(Critical|High|Medium|Low|Informational|Info)\s+(Severity|Risk|Issues?)\s*$",
    r"(?i)^\w+\.sol\s*$",
]
SIGNAL_WORDS = (
    r"(?i)(?<![A-Za-z0-9_])(vulnerab|attack|exploit|risk|impact|severity|reentrancy|reentrant|overflow|underflow"
    r"|access\s*control|unauthorized|unchecked|front.?run|sandwich|mev|flash.?loan|oracle|manipulation|delegatecall"
    r"|selfdestruct|dos|denial|phishing|tx\.origin|slippage|liquidat|privilege|escala|bypass|inject|drain|steal|siphon"
    r"|lock|freeze|grief|censor|int(eger)?.*overflow|critical|high|medium|low)(?![A-Za-z0-9_])"
)

# Context around a finding.
CONTEXT_LINES = 40
CONTEXT_TITLE_CHARS = 20
