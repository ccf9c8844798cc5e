"""The taint fold against a plain walk, and on long chains."""

import random
import time

import pyarrow as pa
import pytest

from emberwatch.operators import taint_fold as fold
from emberwatch.operators.policy import Policy
from emberwatch.operators.scan import finding_rows, scan

_INPUT = pa.list_(pa.struct([
    ("given", pa.list_(pa.int32())), ("secret", pa.list_(pa.bool_())),
    ("visits", pa.list_(pa.struct([
        ("kind", pa.int32()), ("starts", pa.bool_()), ("targets", pa.list_(pa.int32())), ("plain", pa.list_(pa.int32())),
        ("flows", pa.list_(pa.int32())), ("operands", pa.list_(pa.list_(pa.int32()))),
    ]))),
]))


def plain(text):
    known, leaks = list(dict.fromkeys(text["given"])), []
    for at, v in enumerate(text["visits"]):
        fires = v["kind"] != fold.USE and (v["starts"] or any(n in known for n in v["flows"]))
        hits = []
        for o, names in enumerate(v["operands"] if v["kind"] != fold.ASSIGN else []):
            name = next((n for n in names if n in known), fold.EXPRESSION if v["kind"] == fold.LOOP and fires else None)
            if name is not None:
                hits.append({"operand": o, "name": name})
        if hits:
            leaks.append({"at": at, "hits": hits})
        reached = (v["targets"] if fires else []) + [n for n in v["plain"] if v["kind"] == fold.ASSIGN and text["secret"][n]]
        known += [n for n in dict.fromkeys(reached) if n not in known]
    return {"tainted": known, "leaks": leaks}


def text(rng):
    n = rng.randint(1, 12)
    some = lambda k: [rng.randrange(n) for _ in range(rng.randint(0, k))]
    visits = [
        {"kind": rng.randint(0, 2), "starts": rng.random() < 0.1, "targets": some(2), "plain": some(2), "flows": some(2), "operands": [some(3) for _ in range(rng.randint(0, 3))]}
        for _ in range(rng.randint(0, 15))
    ]
    for v in visits:
        if v["kind"] == fold.USE:
            v.update(targets=[], plain=[], flows=[], starts=False)
    return {"given": some(2), "secret": [rng.random() < 0.15 for _ in range(n)], "visits": visits}


@pytest.mark.parametrize("cut", [0, 7])
def test_fold_equals_a_plain_walk(cut):
    rng = random.Random(cut)
    rows = [[text(rng) for _ in range(rng.choice([0, 1, 1, 3]))] for _ in range(300)]
    got = fold._fold(pa.array(rows, _INPUT)[cut:]).to_pylist()
    assert got == [[plain(t) for t in row] for row in rows[cut:]]


CHAINS = {
    "assignments": ("v0 = os.environ['K']\n", "v{j} = v{i}\n", "print(v{n})\n", "indirect_output"),
    "attributes": ("v0 = os.getenv('K')\n", "v{j} = v{i}.x\n", "v{n}[0]\n", "char_extraction"),
    "calls": ("v0 = subprocess.check_output('env')\n", "v{j} = f(v{i}, k=v{i})\n", "len(v{n})\n", "property_probe"),
    "sums": ("v0 = open('/proc/self/environ')\n", "v{j} = 'a' + v{i}\n", "v{n} == 'x'\n", "comparison_leak"),
    "tuples": ("v0 = cur.fetchone()\n", "v{j}, w = v{i}\n", "f'{{v{n}}}'\n", "format_string_leak"),
    "loops": ("v0 = f.readlines()\n", "for v{j} in v{i}: pass\n", "ord(v{n})\n", "ord_byte_value"),
    "comprehensions": ("v0 = sys.stdin.read()\n", "[0 for v{j} in v{i}]\n", "for c in v{n}: pass\n", "iteration_over_secret"),
    "names": ("my_token = g()\nv0 = my_token\n", "v{j} = v{i}\n", "v{n}.startswith('a')\n", "property_probe"),
    "extra": ("v0 = custom\n", "v{j} = v{i}\n", "v{n}.encode()\n", "encoding_transform"),
}


def test_chains_of_a_hundred_thousand(spark):
    """A name's taint goes through 100,000 bindings of every kind, in time that grows with their number."""
    n = 100_000
    codes = [
        (name, "import os, subprocess, sys\n" + start + "".join(step.format(i=i, j=i + 1) for i in range(n)) + use.format(n=n), "python")
        for name, (start, step, use, _) in CHAINS.items()
    ]
    df = spark.createDataFrame(codes, "snippet_id string, code string, language string").repartition(8)
    began = time.perf_counter()
    scanned = scan(df, Policy(min_severity="INFO", extra_sources=("custom",)))
    got = {(r.snippet_id, r.line): r.leak_type for r in finding_rows(scanned, "snippet_id").collect() if r.line > n}
    took = time.perf_counter() - began
    for name, code, _ in codes:
        assert got[name, code.count("\n")] == CHAINS[name][3], name
    assert took < 90
