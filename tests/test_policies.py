"""Several policies over one extraction judge as one scan each, and trace a snippet once."""

from emberwatch.operators.policy import Policy, fan_out_policies
from emberwatch.operators.scan import extract, judge, scan

CODES = [
    ("import os\nk = mine[0]\nprint(k)\ntoken = os.environ['A']\nprint(token)", "auto"), ("import os\nprint(mine[1])", "auto"),
    ("echo a; python3 -c 'token=1;send(token, mine)'", "auto"), ("import os\ndef broken(:\n print(mine)", "auto"), (None, "python"),
    ("print(1)", None), ("import os\nmine = 1\nx = mine", "auto"),
]
CHOICES = {
    "plain": Policy(min_severity="INFO"), "named": Policy(min_severity="INFO", extra_sources=("mine", "absent")),
    "absent": Policy(extra_sources=("absent",)), "shell": Policy(languages=("bash",)), "off": Policy(enabled=False),
}
RESULT = ["parsed", "findings", "tainted_vars", "n_findings", "max_severity", "blocked"]


def _snippets(spark):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CODES)], "snippet_id int, code string, language string")


def test_policies_judge_as_single_scans(spark):
    judged = judge(fan_out_policies(extract(_snippets(spark)), CHOICES)).select("policy_id", "snippet_id", *RESULT).collect()
    together = {(r.policy_id, r.snippet_id): tuple(r)[2:] for r in judged}
    assert len(together) == len(judged) == len(CODES) * len(CHOICES)
    for name, policy in CHOICES.items():
        for row in scan(_snippets(spark), policy).select("snippet_id", *RESULT).collect():
            assert together[name, row.snippet_id] == tuple(row)[1:], (name, row.snippet_id)
    # Extra names are tainted before all, where the parser takes the text; bodies on shell lines don't know them.
    assert together["named", 0][2] == ["absent", "k", "mine", "token"] and together["plain", 0][2] == ["token"]
    assert together["named", 0][3] > together["plain", 0][3] and together["named", 2][1] == together["plain", 2][1]
    assert together["named", 1][3] == 2 and together["plain", 1][3] == 0
    assert not together["named", 3][0] and together["named", 3][2] == []


def test_a_snippet_is_traced_before_policies_are_fanned_out(spark):
    plan = judge(fan_out_policies(extract(_snippets(spark)), CHOICES)).select("snippet_id", "findings")
    lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
    fanned = next(i for i, line in enumerate(lines) if "Generate explode" in line and "[_p#" in line)
    assert any("_fold" in line for line in lines[fanned:])  # further down is earlier
