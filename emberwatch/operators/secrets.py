"""Secret-content scan.

Rules run as columns on whole texts; what a rule needs in a text is looked for first, so most texts meet few patterns, and no pattern
walks a text more than once. The vault match joins k-grams of distinct tokens, so copies of a text cost nothing extra, and only the
rarest grams of an entry make candidates.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.secret_rules import EXTRACTION_PHRASES, LEAST_RUN, RUN, SECRET_RULES, java
from emberwatch.operators.redaction import CLOSE, NAMED, OPEN, ZERO_WIDTH, replace_spans
from emberwatch.session import run_dir, written

_TOKEN = r"[A-Za-z0-9+/_=\-]{16,}"
# Of whole tokens whose length is a multiple of 2 or 4.
_HEX = r"^[0-9a-fA-F]{16,}$"
_BASE64 = r"^[A-Za-z0-9+/]{16,}={0,2}$"


def visible(text: Column) -> Column:
    """G1: without zero-width characters and with percent escapes decoded; a percent sign that is no escape stays."""
    bare = F.regexp_replace(text, f"[{ZERO_WIDTH}]", "")
    # A plus sign is text here, not an encoded blank.
    decoded = F.try_url_decode(F.regexp_replace(F.regexp_replace(bare, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))
    return F.when(F.contains(bare, F.lit("%")), F.coalesce(decoded, bare)).otherwise(bare)


def tokens(text: Column) -> Column:
    """Runs of 16 or more characters of the base64 and hex alphabets, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1)))


def opened_tokens(text: Column) -> Column:
    """G1: (token, plain) of the tokens that hide a readable text in hex or base64."""

    def opened(token: Column) -> Column:
        raw = F.when(F.rlike(token, F.lit(_HEX)) & (F.length(token) % 2 == 0), F.try_to_binary(token, F.lit("hex"))).when(
            F.rlike(token, F.lit(_BASE64)) & (F.length(token) % 4 == 0), F.try_to_binary(token, F.lit("base64"))
        )
        return F.struct(token.alias("token"), F.try_validate_utf8(raw.cast("string")).alias("plain"))

    return F.filter(F.transform(tokens(text), opened), lambda x: F.rlike(x["plain"], F.lit(r"^[\x20-\x7e]+$")))


def normalise(text: Column) -> Column:
    """G1: visible text followed by what its tokens decode to, one per line."""
    seen = visible(text)
    return F.concat_ws("\n", seen, F.transform(opened_tokens(seen), lambda x: x["plain"]))


def _table(run: bool) -> Column:
    """Rules that need a run, or that do not, as one literal."""
    rows = [
        {"name": r.name, "pattern": java(r), "literals": r.literals, "tag": f"[{r.name.upper()}]", "mark": f"{OPEN}{r.name.upper()}{NAMED}$0{CLOSE}", "place": k}
        for k, r in enumerate(SECRET_RULES) if r.run == run
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<place:int,name:string,pattern:string,literals:array<string>,tag:string,mark:string>>")


def possible_rules(text: Column) -> Column:
    """The rules, in order, that can match: whose literals the text has, and a long run, if they need one. Meant to be a column of
    its own, which the functions below take."""
    may = lambda r: (F.size(r["literals"]) == 0) | F.exists(r["literals"], lambda x: F.contains(text, x))
    long_run = F.rlike(text, F.lit(f"(?<![{RUN}])[{RUN}]{{{LEAST_RUN}}}"))
    nothing = F.slice(_table(True), 1, 0)
    with_run = F.when(long_run, F.filter(_table(True), may)).otherwise(nothing)
    return F.array_sort(F.concat(with_run, F.when(text.isNotNull(), F.filter(_table(False), may)).otherwise(nothing)))


def any_rule(text: Column, possible: Column) -> Column:
    """Whether a rule matches."""
    return F.exists(possible, lambda r: F.coalesce(F.rlike(text, r["pattern"]), F.lit(False)))


def rule_hits(text: Column) -> Column:
    """Names of the rules found in a text."""
    found = F.filter(possible_rules(text), lambda r: F.coalesce(F.rlike(text, r["pattern"]), F.lit(False)))
    return F.transform(found, lambda r: r["name"])


def rule_counts(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """Keys and the matches of each rule in a text, as ``n_<rule>``; NULL for a NULL text."""
    column = F.col(text)
    possible = possible_rules(column)
    counted = F.map_from_entries(F.transform(possible, lambda r: F.struct(r["name"], F.regexp_count(column, r["pattern"]).cast("bigint"))))
    looked = texts.select(*keys, F.when(column.isNotNull(), counted).alias("_counts"))
    counts = [F.coalesce(F.try_element_at("_counts", F.lit(r.name)), F.when(F.col("_counts").isNotNull(), F.lit(0).cast("bigint"))) for r in SECRET_RULES]
    return looked.select(*keys, *[c.alias(f"n_{r.name}") for c, r in zip(counts, SECRET_RULES, strict=True)])


def has_phrase(text: Column) -> Column:
    hit = F.lit(False)
    for _, phrase in EXTRACTION_PHRASES:
        hit = hit | F.rlike(text, F.lit(phrase))
    return hit


def asks_for_secrets(role: Column, text: Column) -> Column:
    """A user message with an extraction phrase."""
    return (role == "user") & has_phrase(text)


def redact(text: Column, possible: Column | None = None) -> Column:
    """Every rule match replaced by the rule's name."""
    rules = possible_rules(text) if possible is None else possible
    return F.reduce(rules, text, lambda t, r: F.regexp_replace(t, r["pattern"], r["tag"]))


def _marked(text: Column, possible: Column) -> Column:
    """Every rule match put between marks, with the rule's name."""
    bare = F.translate(text, OPEN + NAMED + CLOSE, "???")
    return F.reduce(possible, bare, lambda t, r: F.regexp_replace(t, r["pattern"], r["mark"]))


def decision(asks: Column, has_secret: Column) -> Column:
    """Block extraction attempts, redact texts with secrets, allow the rest."""
    return F.when(asks, "BLOCK").when(has_secret, "REDACT").otherwise("ALLOW")


#: Bits a character from which a token is high in entropy: of hex digits alone, and any other.
HEX_BITS, TOKEN_BITS = 3.0, 4.5


def judge(turns: DataFrame, vault: DataFrame) -> DataFrame:
    """(conv_id, turn, decision, redacted) of each row of ``conv_id, turn, role, text``.

    Rules (G2) and phrases (G5) are looked for in the text as it is, in what it shows (G1) and in each text that a token hides; tokens
    shown or hidden that match a vault entry (G3) or are high in entropy (G4) are secrets of their conversation and turn. ``redacted``
    is the text in which all that made it one to redact is replaced: matches by the rule's name, in a hidden form with the characters
    that hide it; tokens by VAULT or HIGH_ENTROPY, or by ENCODED if a match is hidden in them. A NULL text stays NULL and is allowed.
    """
    text, shown = F.col("text"), F.col("shown")
    seen = turns.select("conv_id", "turn", "role", "text", visible(text).alias("shown"))
    seen = seen.withColumns({"opened": opened_tokens(shown), "raw_rules": possible_rules(text)})
    shown_rules = F.when(shown != text, possible_rules(shown)).otherwise(F.slice("raw_rules", 1, 0))
    seen = seen.withColumns({"shown_rules": shown_rules, "encoded": F.filter("opened", lambda x: any_rule(x["plain"], possible_rules(x["plain"])))})
    plain = F.transform(tokens(shown), lambda t: F.struct(t.alias("outer"), t.alias("token")))
    inner = F.flatten(F.transform("opened", lambda x: F.transform(tokens(x["plain"]), lambda t: F.struct(x["token"].alias("outer"), t.alias("token")))))
    held = seen.select("conv_id", "turn", F.inline(F.concat(plain, inner)))
    least = F.when(F.rlike("token", F.lit(r"^[0-9a-fA-F]+$")), HEX_BITS).otherwise(TOKEN_BITS)
    found = entropy(held).where(F.col("entropy") >= least).select(_digest(), F.lit("HIGH_ENTROPY").alias("label"))
    found = found.unionByName(vault_tokens(held, vault).select("_token", F.lit("VAULT").alias("label"))).groupBy("_token").agg(F.max("label").alias("label"))
    flags = held.select("conv_id", "turn", "outer", _digest()).join(found, "_token").groupBy(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn")).agg(
        F.collect_set(F.struct(F.col("outer").alias("token"), "label")).alias("flags")
    )
    whole = seen.join(flags, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")), "left")
    phrase = has_phrase(text) | has_phrase(shown) | F.exists("opened", lambda x: has_phrase(x["plain"]))
    secret = any_rule(text, F.col("raw_rules")) | any_rule(shown, F.col("shown_rules")) | (F.size("encoded") > 0) | F.col("flags").isNotNull()
    asks = (F.col("role") == "user") & F.coalesce(phrase, F.lit(False))
    encoded = F.transform("encoded", lambda x: F.struct(x["token"].alias("token"), F.lit("ENCODED").alias("label")))
    # Most texts show all there is, and rules alone redact them.
    mapped = (shown != text) | (F.size("encoded") > 0) | F.col("flags").isNotNull()
    spans = replace_spans(
        F.when(mapped, text), _marked(F.when(mapped, text), F.col("raw_rules")), F.when(mapped, shown),
        _marked(F.when(mapped & (shown != text), shown), F.col("shown_rules")), F.concat(F.coalesce("flags", F.slice(encoded, 1, 0)), encoded),
    )
    whole = whole.withColumns({"decision": decision(asks, F.coalesce(secret, F.lit(False))), "spans": spans})
    redacted = F.when(mapped, F.col("spans")).otherwise(redact(text, F.col("raw_rules")))
    return whole.select("conv_id", "turn", "decision", redacted.alias("redacted"))


def decisions(turns: DataFrame, vault: DataFrame) -> DataFrame:
    """(conv_id, turn, decision), see judge."""
    return judge(turns, vault).select("conv_id", "turn", "decision")


def token_table(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct tokens of each text."""
    return texts.select(key, F.explode(tokens(F.col(text))).alias("token"))


def entropy(token_rows: DataFrame) -> DataFrame:
    """Distinct tokens with the Shannon entropy of their characters in bits, to four digits.

    Computed inside the row: each distinct character is counted by what is left without it.
    """
    n = F.length("token")

    def share(c: Column) -> Column:
        p = (n - F.length(F.replace("token", c, F.lit("")))) / n
        return -p * F.log2(p)

    bits = F.aggregate(F.transform(F.array_distinct(F.split("token", "")), share), F.lit(0.0), lambda a, b: a + b)
    return token_rows.select("token").distinct().withColumn("entropy", F.round(bits, 4))


#: Grams that are cut out of a token at a time.
_PIECE = 4096


def gram_rows(rows: DataFrame, text: str, k: int) -> DataFrame:
    """Columns of ``rows`` but the text, and each ``gram`` of k characters of its text as rows (none if it is shorter).

    Texts are ASCII. They are cut into overlapping pieces first, so that no array and no row grows with the square of a long one; a gram
    comes once per piece.
    """
    rest = [c for c in rows.columns if c != text]
    raw = F.col(text).cast("binary")
    last = (F.length(raw) - k).cast("int")
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(_PIECE)))
    pieces = rows.select(*rest, F.explode(F.transform(starts, lambda i: F.substring(raw, i + 1, F.lit(_PIECE + k - 1)))).alias("_piece"))
    each = F.transform(F.sequence(F.lit(1), F.length("_piece") - k + 1), lambda i: F.substring("_piece", i, F.lit(k)).cast("string"))
    return pieces.select(*rest, F.explode(F.array_distinct(each)).alias("gram"))


def _digest() -> Column:
    """SHA-256 of a token, which stands for it where rows are many."""
    return F.unhex(F.sha2("token", 256)).alias("_token")


def _digested(token_rows: DataFrame) -> DataFrame:
    """(token, _token): distinct tokens and their digests."""
    return token_rows.select("token").distinct().select("token", _digest())


def _entry_grams(vault: DataFrame, k: int) -> DataFrame:
    """(secret_id, gram, n_grams): distinct grams of each entry."""
    grams = gram_rows(vault.select("secret_id", "secret"), "secret", k).distinct()
    return grams.withColumn("n_grams", F.count("*").over(Window.partitionBy("secret_id")).cast("int"))


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of grams, always by a shuffle. The planner takes exploded rows for as few as the texts they come from, and would send any number
    of them through the driver."""
    return left.join(right.hint("merge"), on, how)


def _known(tokens_: DataFrame, entry_grams: DataFrame, k: int) -> DataFrame:
    """(gram, _token): distinct grams of tokens that an entry has."""
    grams = gram_rows(tokens_.select("_token", "token"), "token", k)
    return _joined(grams, entry_grams.select("gram").distinct(), "gram", "left_semi").distinct()


def _near_enough(candidates: DataFrame, entry_grams: DataFrame, known: DataFrame, min_share: float) -> DataFrame:
    """(_token, secret_id, n_grams, n_shared) of the candidates (_token, secret_id) that share enough grams, all counted."""
    shared = _joined(_joined(candidates, entry_grams, "secret_id"), known, ["_token", "gram"])
    shared = shared.groupBy("_token", "secret_id", "n_grams").agg(F.count("*").alias("n_shared"))
    return shared.filter(F.col("n_shared") >= F.lit(min_share) * F.col("n_grams"))


def _matches(tokens_: DataFrame, vault: DataFrame, k: int, min_share: float) -> DataFrame:
    entry_grams = _entry_grams(vault, k)
    known = _known(tokens_, entry_grams, k)
    common = known.groupBy("gram").agg(F.count("*").alias("_common"))
    n_grams = Window.partitionBy("secret_id")
    ranked = _joined(entry_grams, common, "gram").withColumn("_rank", F.row_number().over(n_grams.orderBy("_common", "gram")))
    # Grams that no token has come first; those in hand follow them.
    absent = F.col("n_grams") - F.count("*").over(n_grams)
    need = F.greatest(F.ceil(F.lit(min_share) * F.col("n_grams")).cast("int"), F.lit(1))
    rare = ranked.withColumn("_absent", absent).where(F.col("_rank") + F.col("_absent") <= F.col("n_grams") - need + 1)
    candidates = _joined(known, rare.select("gram", "secret_id"), "gram").select("_token", "secret_id").distinct()
    return _near_enough(candidates, entry_grams, known, min_share)


def vault_matches(token_rows: DataFrame, vault: DataFrame, k: int = 8, min_share: float = 0.5) -> DataFrame:
    """Distinct tokens sharing at least ``min_share`` of a vault entry's k-grams.

    ``vault`` has ``secret_id, secret``, ASCII; ids are unique. The result names the entry, never its value. Of an entry's n grams a match
    shares need = max(1, ceil(min_share * n)), so one of any n - need + 1 of them: the rarest among the tokens make candidates, and only
    these are counted in full. A gram that all tokens and entries share makes none, unless an entry has too few others.
    """
    tokens_ = _digested(token_rows)
    found = _matches(tokens_, vault, k, min_share)
    return _joined(found, tokens_, "_token").select("token", "secret_id", "n_grams", "n_shared")


def vault_tokens(token_rows: DataFrame, vault: DataFrame, k: int = 8, min_share: float = 0.5) -> DataFrame:
    """``_token``, the SHA-256 of each distinct token that ``vault_matches`` some entry, once.

    Entries that are alike match each other's tokens, so pairs grow with the square of a group. Each token is counted against one entry
    first, one that has its rarest gram, and only those that fail this meet all their candidates.
    """
    tokens_, entry_grams = _digested(token_rows), _entry_grams(vault, k)
    known = _known(tokens_, entry_grams, k)
    owners = entry_grams.groupBy("gram").agg(F.count("*").alias("_entries"), F.min("secret_id").alias("secret_id"))
    rarest = F.min_by("secret_id", F.struct("_entries", "gram")).alias("secret_id")
    near = _joined(known, owners, "gram").groupBy("_token").agg(rarest)
    first = _near_enough(near, entry_grams, known, min_share).select("_token")
    # Digests only are written; what is left starts from them, not from the steps that found them.
    first = written(first, run_dir(token_rows.sparkSession, "vault-tokens"))
    rest = _joined(tokens_, first, "_token", "left_anti")
    return first.unionByName(_matches(rest, vault, k, min_share).select("_token").distinct())
