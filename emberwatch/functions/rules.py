"""Fixed rule tables of the scanner, and the predicates built on them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.text import matches_any, unicode_regex

# Severity ranks.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}

# Languages a policy may enable.
LANGUAGES = ["python", "bash", "js", "ruby", "go"]

# Words that decide the language of a snippet.
PYTHON_WORDS = ["import ", "def ", "os.environ", "print("]
BASH_WORDS = ["#!/bin/bash", "#!/bin/sh", "echo ", "export "]


class LineRule(NamedTuple):
    rule_id: str
    lang: str
    pattern: str
    needles: list[str]  # a line without any of these cannot match
    severity: str
    message: str


# Line rules (pattern, severity, message) for shell lines.
BASH_RULES = [
    LineRule("B1", "bash", r"\$\w+\s*\|\s*cut\s+-c", ["cut"], "CRITICAL",
             "Extracting characters from variable with cut -c"),
    LineRule("B2", "bash", r"echo\s+.*\$\w+.*\|\s*wc\s+-c", ["wc"], "MEDIUM",
             "Measuring secret length with wc -c"),
    LineRule("B3", "bash", r"expr\s+substr\s+\$", ["expr"], "CRITICAL",
             "Extracting substring from variable with expr substr"),
    LineRule("B4", "bash", r"\$\{(\w+):(\d+):(\d+)\}", ["${"], "CRITICAL",
             "Bash substring extraction ${var:offset:length}"),
    LineRule("B5", "bash", r"\$\{#\w+\}", ["${#"], "MEDIUM",
             "Getting variable length with ${#var}"),
    LineRule("B6", "bash", r"""printf\s+['"]*%d.*'"\$""", ["printf"], "HIGH",
             "printf %d on secret character (ASCII value)"),
    LineRule("B7", "bash", r"xxd|od\s+-[AaxX]|hexdump", ["xxd", "od", "hexdump"], "HIGH",
             "Hex dump of data (potential secret encoding)"),
    LineRule("B8", "bash", r"base64(\s*(<<<|<\(|\|)|\s*$)", ["base64"], "HIGH",
             "Base64 encoding (potential secret exfiltration)"),
    LineRule("B9", "bash", r"\[\[\s*\$\w+\s*==\s*", ["[["], "HIGH",
             "String comparison against variable (brute-force probe)"),
    LineRule("B10", "bash", r"curl.*\$\w+|wget.*\$\w+", ["curl", "wget"], "CRITICAL",
             "Sending variable content via HTTP (exfiltration)"),
]

# Line rules for the other languages.
MULTI_RULES = [
    LineRule("M1", "js", r"\.charCodeAt\s*\(", [".charCodeAt"], "CRITICAL", "charCodeAt() extracts character code"),
    LineRule("M2", "js", r"\.charAt\s*\(", [".charAt"], "HIGH", "charAt() extracts single character"),
    LineRule("M3", "js", r"\.codePointAt\s*\(", [".codePointAt"], "CRITICAL", "codePointAt() extracts character code"),
    LineRule("M4", "js", r"\.substring\s*\(", [".substring"], "HIGH", "substring() extracts partial value"),
    LineRule("M5", "ruby/go", r"\.bytes\s*\[", [".bytes"], "CRITICAL", "Byte-level access to string"),
    LineRule("M6", "ruby", r"\.each_byte", [".each_byte"], "CRITICAL", "Iterating bytes of string"),
    LineRule("M7", "ruby", r"\.each_char", [".each_char"], "CRITICAL", "Iterating characters of string"),
    LineRule("M8", "ruby", r"\.unpack\s*\(", [".unpack"], "HIGH", "Unpacking string to numeric values"),
    LineRule("M9", "go", r"strings\.Contains\s*\(", ["strings.Contains"], "HIGH", "String containment check"),
    LineRule("M10", "go", r"utf8\.DecodeRune", ["utf8.DecodeRune"], "CRITICAL",
             "Decoding individual rune from string"),
    LineRule("M11", "go", r"fmt\.Println\s*\(.*\[\d+\]", ["fmt.Println"], "CRITICAL",
             "Printing indexed byte of string"),
]

# Fixed value: Python handed to an interpreter on a shell line.
EMBEDDED_PYTHON = r"""(?s)python[23]?\s+-c\s+["'](.+?)["']"""

# Fixed value: identifiers that suggest a secret.
SECRET_NAME = (
    r"(password|passwd|secret|token|api_?key|"
    r"credential|private_?key|auth|master_?key|"
    r"access_?key|conn_?str|database_?url|"
    r"redis_?url|dsn|connection_?string)"
)

# Paths of files that hold secrets.
SENSITIVE_PATHS = [
    r"/proc/\d+/(environ|cmdline|maps|status)",
    r"/proc/self/(environ|cmdline)",
    r"\.(env|key|pem|token|secret|credentials|password)$",
    r"/(\.(ssh|gnupg|aws))/",
    r"/etc/(shadow|passwd|master\.passwd)",
    r"/(credentials|secrets?|tokens?)(\.(json|yaml|yml|toml|conf))?$",
]

# Where secrets enter Python code.
SOURCE_CALLS = ["os.getenv", "os.environ", "subprocess.check_output", "subprocess.run", "subprocess.getoutput"]
SOURCE_METHODS = ["fetchone", "fetchall", "fetchmany", "read", "readline", "readlines"]
SOURCE_SUBSCRIPTS = ["os.environ", "environ"]

# Calls that encode or hash a value, and names that send a value out.
ENCODING_CALLS = [
    "base64.b64encode", "base64.b64decode", "base64.urlsafe_b64encode", "base64.encodebytes",
    "binascii.hexlify", "binascii.b2a_hex",
    "hashlib.md5", "hashlib.sha256", "hashlib.sha1",
    "codecs.encode", "codecs.decode",
]
OUTPUT_SINKS = ["print", "logging", "logger", "write", "send", "post"]


def severity_rank(severity: Column) -> Column:
    """V1: rank of a severity name; an unknown name ranks 0."""
    chain = F.when(severity == "CRITICAL", 4)
    for name in ("HIGH", "MEDIUM", "LOW"):
        chain = chain.when(severity == name, SEVERITY_RANK[name])
    return chain.otherwise(0)


def severity_name(rank: Column) -> Column:
    """Name of a rank; NULL stays NULL."""
    chain = None
    for name, value in SEVERITY_RANK.items():
        chain = F.when(rank == value, name) if chain is None else chain.when(rank == value, name)
    return chain


def is_secret_name(name: Column) -> Column:
    """An identifier that suggests a secret, in any letter case."""
    return F.rlike(name, F.lit("(?iu)" + SECRET_NAME))


def is_sensitive_path(path: Column) -> Column:
    """A path of a file that holds secrets."""
    return matches_any(path, [unicode_regex(p) for p in SENSITIVE_PATHS])
