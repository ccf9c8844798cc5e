"""Near duplicates by the Jaccard likeness of word n-grams: adaptive multi-match prefixes, then exact verification.

A text is the set of its shingles. Texts of equal sets are one class. In one order of all shingles, rare ones first, two classes that link
share at least l of the shingles in their l-prefixes. Each class takes the l whose estimated cost is least: frequent shingles in a prefix
cost candidates, a longer prefix costs rows. Candidates share as many prefix shingles as the smaller l of the two asks for.

Components come in steps, so that a group of copies is not expanded into its pairs: in each turn a class is verified against a few classes of
other components, as long as that finds links; then all pairs that share enough prefix shingles are verified if they are not
in one component yet. No link is lost: a pair that links is verified, or its classes are in one component already.

Before the last step a few pairs of each class that may link are verified, so that large groups are joined and make no more rows.
Members of a group that are not near enough never join, so the last step meets their pairs. It looks at the marks of both sets, one bit of
parity per hash value, before it makes a row of a pair: sets whose marks differ in n bits differ in n shingles at least. Runs that have the
same least class are worked on together, so that marks travel a few times per class, and a pair is looked at once for all these runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.llm.graph import components
from emberwatch.llm.shared import documents, kept, mix, window_hashes, word_blocks

SHINGLE_WORDS, PERCENT = 5, 80
#: Shingles counted together; those found COUNT_FROM times among them add to the frequency of a shingle.
COUNT_SHINGLES, COUNT_FROM = 1 << 22, 3
#: Frequencies sent to every task, of the most frequent shingles. All others count as rare in the order, which needs no exact frequency.
FREQUENCIES = 1 << 19
#: Candidates expected per shingle that is not among the frequencies, and the most matches that are asked for.
RARE_CANDIDATES, MOST_MATCHES = 0.2, 64
#: Bits of a set's marks: a power of two, at least eight times its size, between these.
LEAST_MARKS, MOST_MARKS = 256, 1 << 17
#: Pairs of rows that the last step looks at together, and bytes of marks.
PAIR_ROWS, MARK_BYTES = 1 << 19, 1 << 24
#: Orders among equal lengths in one turn, and partners of a class that it verifies.
ORDERS, PARTNERS = 5, 8
#: Turns at most; what they leave is found by the last step.
TURNS = 3


def shingle_sets(column: pa.Array, words: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of each text that has a word; fewer words than a shingle has are one shingle."""
    for row, hashes in word_blocks(column, lower):
        heads = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
        ends = np.append(heads[1:], len(row))
        grams = window_hashes(hashes, words)
        for k, a, b in zip(row[heads].tolist(), heads.tolist(), ends.tolist(), strict=True):
            if b - a >= words:
                yield k, np.unique(grams[a : b - words + 1])
            else:
                yield k, mix(window_hashes(hashes[a:b], b - a) + np.uint64(b - a))


def marks_of(shingles: np.ndarray) -> bytes:
    """A bit for each of some hash values, set if an odd number of shingles has it. Two sets differ in at least as many shingles as their
    marks differ in bits. Marks of half as many bits are the exclusive or of the halves."""
    size = min(max(LEAST_MARKS, 1 << (8 * len(shingles) - 1).bit_length()), MOST_MARKS)
    return np.packbits((np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


class _Marks:
    """Marks of many sets, compared by as many bits as both have."""

    def __init__(self, marks: np.ndarray):
        self.size = np.fromiter(map(len, marks), np.int64, len(marks)) * 8
        self.place = np.zeros(len(marks), np.int64)
        self.held: dict[tuple[int, int], np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            self.place[rows] = np.arange(len(rows))
            self.held[size, size] = np.frombuffer(b"".join(marks[rows]), np.uint64).reshape(len(rows), size // 64)

    def _of(self, size: int, least: int) -> np.ndarray:
        if (size, least) not in self.held:
            wide = self._of(size, 2 * least)
            self.held[size, least] = wide[:, : least // 64] ^ wide[:, least // 64 :]
        return self.held[size, least]

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which sets x[k] and y[k] differ."""
        out = np.zeros(len(x), np.int64)
        kinds = self.size[x] << 32 | self.size[y]
        for kind in np.unique(kinds).tolist():
            one, two = kind >> 32, kind & ((1 << 32) - 1)
            least, among = min(one, two), np.flatnonzero(kinds == kind)
            step = max(1, MARK_BYTES * 8 // least)
            for at in range(0, len(among), step):
                k = among[at : at + step]
                apart = self._of(one, least)[self.place[x[k]]] ^ self._of(two, least)[self.place[y[k]]]
                out[k] = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
        return out


def set_key(shingles: np.ndarray) -> int:
    """64-bit hash of a set."""
    total = int(np.bitwise_xor.reduce(mix(shingles))) + int(mix(shingles.sum(keepdims=True) + np.uint64(len(shingles)))[0])
    return (total + (1 << 63)) % (1 << 64) - (1 << 63)


def _describe(words: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for row, shingles in shingle_sets(batch.column(1), words):
                n[row], c[row] = len(shingles), set_key(shingles)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(c, pa.int64())], ["key", "t", "n", "c"])

    return describe


def _count(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def several():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= COUNT_FROM
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for _, shingles in shingle_sets(batch.column(0), words):
                held.append(shingles)
                size += len(shingles)
                if size >= COUNT_SHINGLES:
                    yield several()
                    held, size = [], 0
        if held:
            yield several()

    return count


def prefix_choice(frequency: np.ndarray, percent: int, most: int = MOST_MATCHES) -> int:
    """Matches to ask for (l) by estimated cost. frequency: of the set's shingles in order, rare ones first."""
    n = len(frequency)
    base = n - -(-percent * n // 100)
    sizes = np.minimum(base + np.arange(1, most + 1), n)
    sizes = sizes[: max(1, n - base)]  # l-prefixes are no longer than the set
    candidates = np.concatenate([[0], np.cumsum(frequency + RARE_CANDIDATES)])[sizes] / np.arange(1, len(sizes) + 1)
    # A row to deal costs about as much as 20 shingles to compare, a candidate its own shingles.
    return int(np.argmin(sizes * 20 + candidates * n)) + 1


def _postings(words: int, percent: int, frequent: np.ndarray, counts: np.ndarray):
    """Prefix rows (h, c, n, level, l) of each class, once per task."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out: list[tuple] = []
        size = 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["h", "c", "n", "level", "l"])

        for batch in batches:
            for _, shingles in shingle_sets(batch.column(0), words):
                c = set_key(shingles)
                if c in seen:
                    continue
                seen.add(c)
                n = len(shingles)
                spot = np.minimum(np.searchsorted(frequent, shingles), max(len(frequent) - 1, 0))
                frequency = np.where(frequent[spot] == shingles, counts[spot], 0) if len(frequent) else np.zeros(n, np.int64)
                order = np.argsort(frequency, kind="stable")  # then by hash
                base = n - -(-percent * n // 100)
                asked = prefix_choice(frequency[order], percent)
                prefix = shingles[order[: base + asked]]
                level = np.maximum(np.arange(len(prefix)) + 1 - base, 1)
                full = lambda x, t: np.full(len(prefix), x, t)
                out.append((prefix.view(np.int64), full(c, np.int64), full(n, np.int32), level.astype(np.int16), full(asked, np.int16)))
                size += len(prefix)
                if size > 1 << 17:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return postings


SHARED = "h long, c long, n int, level short, l short, least short"


def _runs(table: list[np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, n, c: those of an h that several classes have, and the least matches that one of them asks for."""
    h, c, n, level, asked = table
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])  # a class that several tasks gave
    h, c, n, level, asked = (x[~again] for x in table)
    heads = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    count = np.diff(np.append(heads, len(h)))
    several = np.repeat(count > 1, count)
    if not several.any():
        return
    h, c, n, level, asked = (x[several] for x in (h, c, n, level, asked))
    heads = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    count = np.diff(np.append(heads, len(h)))
    columns = [h, c, n, level, asked, np.repeat(np.minimum.reduceat(asked, heads), count)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int16()]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["h", "c", "n", "level", "l", "least"])


def _by_run(work, percent: int):
    """work on whole runs of the first column, for mapInArrow over rows sorted by it."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if held is not None:
                table = [np.concatenate([a, b]) for a, b in zip(held, table, strict=True)]
            h = table[0]
            if not len(h):
                continue
            cut = len(h) - int(np.argmax((h != h[-1])[::-1])) if h[0] != h[-1] else 0
            held = [x[cut:] for x in table]
            if cut:
                yield from work([x[:cut] for x in table], percent)
        if held is not None:
            yield from work(held, percent)

    return runs


def _neighbours(table: list[np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, n: each with the next row of its run that is of another component, if lengths allow a link."""
    h, c, n, level, asked, root = table
    changes = np.flatnonzero(root[1:] != root[:-1])
    i = np.arange(len(h))
    spot = np.searchsorted(changes, i)
    i = i[spot < len(changes)]
    j = changes[spot[: len(i)]] + 1
    need = np.minimum(asked[i], asked[j])
    good = (h[i] == h[j]) & (percent * n[j].astype(np.int64) <= 100 * n[i].astype(np.int64)) & (np.maximum(level[i], level[j]) <= need)
    i, j, need = i[good], j[good], need[good]
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(c[i]), pa.array(c[j]), pa.array(need, pa.int16())], ["c", "other", "need"])


def _cross(table: list[np.ndarray], percent: int, few: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of different components that may link, with the matches they need. Rows sorted by lead, at, h, n, c: for each lead
    its classes with marks (at 0), then its runs (at 1). A pair whose marks tell that it is not near enough makes no row. few: so many
    pairs of a class at most, drawn by a hash."""
    lead, at, h, c, n, level, asked, root, marks = table
    group = np.cumsum(np.concatenate([[0], (lead[1:] != lead[:-1]).astype(np.int64)]))
    # Classes are numbered in each group; the first row of each has its marks.
    order = np.lexsort((at, c, group))
    fresh = np.concatenate([[True], (c[order][1:] != c[order][:-1]) | (group[order][1:] != group[order][:-1])])
    number = np.zeros(len(c), np.int64)
    number[order] = np.cumsum(fresh) - 1
    firsts = order[fresh]
    held = _Marks(marks[firsts])
    rows = np.flatnonzero(at == 1)
    h, n, level, root, group, number = h[rows], n[rows].astype(np.int64), level[rows], root[rows], group[rows], number[rows]
    wants, class_of, size_of = asked[rows], c[firsts], table[4][firsts].astype(np.int64)
    asked_of = np.zeros(len(firsts), np.int64)
    asked_of[number] = wants
    # Longer partners of a row in its run: up to n * 100 / percent.
    run = np.cumsum(np.concatenate([[0], ((h[1:] != h[:-1]) | (group[1:] != group[:-1])).astype(np.int64)]))
    count = np.searchsorted((run << 32) | n, (run << 32) | (100 * n // percent), side="right") - np.arange(len(h)) - 1
    by_class = np.argsort(number, kind="stable")
    by_class = by_class[count[by_class] > 0]
    owner, total = number[by_class], np.cumsum(count[by_class])
    start = 0
    while start < len(by_class):
        stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIR_ROWS, side="right")), start + 1)
        if stop < len(by_class):
            # All rows of a class together, unless they are too many.
            whole = int(np.searchsorted(owner, owner[stop]))
            stop = whole if whole > start else stop
        some = by_class[start:stop]
        many = count[some]
        i = np.repeat(some, many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        good = (root[i] != root[j]) & (np.maximum(level[i], level[j]) <= np.minimum(wants[i], wants[j]))
        pair, got = np.unique(number[i[good]] << 32 | number[j[good]], return_counts=True)
        x, y = pair >> 32, pair & ((1 << 32) - 1)
        # Two sets that link differ in at most this share of their sizes.
        near = (100 + percent) * held.differ(x, y) <= (100 - percent) * (size_of[x] + size_of[y])
        x, y, got = x[near], y[near], got[near]
        if few is not None and len(x):
            order = np.lexsort((mix(class_of[x].view(np.uint64) + mix(class_of[y].view(np.uint64))), x))
            first = np.searchsorted(x[order], x[order])
            some = order[np.arange(len(x)) - first < few]
            x, y, got = x[some], y[some], got[some]
        if len(x):
            one, two = class_of[x], class_of[y]
            columns = [np.minimum(one, two), np.maximum(one, two), np.minimum(asked_of[x], asked_of[y]), got]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["a", "b", "need", "got"])
        start = stop


def _sets(words: int):
    """Sets of rows whose class is compared, with their marks, for mapInArrow over (c, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, size = [], [], 0
            for row, shingles in shingle_sets(batch.column(1), words):
                keys.append(row)
                values.append(shingles.view(np.int64))
                size += len(shingles)
                if size > 1 << 18:
                    yield _set_batch(batch, keys, values)
                    keys, values, size = [], [], 0
            if keys:
                yield _set_batch(batch, keys, values)

    return sets


def _set_batch(batch, keys, values):
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
    marks = pa.array([marks_of(v.view(np.uint64)) for v in values], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), lists, marks], ["c", "shingles", "marks"])


def _rooted(shared: DataFrame, found: DataFrame) -> DataFrame:
    return shared.join(found.withColumnRenamed("node", "c"), "c", "left").select("h", "c", "n", "level", "l", F.coalesce("root", "c").alias("root"))


def _crossing(shared: DataFrame, found: DataFrame, sets: DataFrame, percent: int, few: int | None = None) -> DataFrame:
    """(a, b, need, got): pairs of classes of different components that share got prefix shingles and may be near enough. few: so many of a class.

    Only an h that several components have counts, and a class with as many of those as one of its partners asks for.
    """
    run, own = W.partitionBy("h"), W.partitionBy("c")
    roots = found.select(F.col("node").alias("c"), F.col("root").alias("joined"))
    rows = shared.join(roots, "c", "left").withColumn("root", F.coalesce("joined", "c"))
    rows = rows.withColumns({"low": F.min("root").over(run), "high": F.max("root").over(run), "lead": F.min("c").over(run)}).where("low < high")
    rows = rows.withColumns({"got": F.count("*").over(own), "need": F.min("least").over(own)}).where("got >= need")
    rows = kept(rows.select("lead", "h", "c", "n", "level", "l", "root"), "jaccard-runs")
    led = rows.groupBy("lead", "c").agg(F.max("n").alias("n")).join(sets.select("c", "marks"), "c")
    led = led.selectExpr("lead", "0S AS at", "0L AS h", "c", "n", "0S AS level", "0S AS l", "0L AS root", "marks")
    runs = rows.selectExpr("lead", "1S AS at", "h", "c", "n", "level", "l", "root", "X'' AS marks")
    both = led.unionByName(runs).repartition("lead").sortWithinPartitions("lead", "at", "h", "n", "c")
    return both.mapInArrow(_by_run(lambda table, percent: _cross(table, percent, few), percent), "a long, b long, need long, got long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose likeness reaches the percentage, compared exactly."""
    one = sets.select(F.col("c").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("c").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b").withColumn("same", F.size(F.array_intersect("x", "y")))
    return both.where(F.expr(f"100 * same >= {percent} * (size(x) + size(y) - same)")).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id_col, n_shingles long, component_id): one row per input row.

    Words are lower-cased in A-Z. Rows link if 100 * intersection >= percent * union of their sets. component_id is the least id
    reachable by links, itself included. Rows without words (null, empty or blank texts) have an empty set and link with nothing. Rows
    with a null id take part; a component of such rows alone has a null component_id. Rows that repeat an id are rows of their own.
    Other columns are not looked at.
    """
    base = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    marked = base.withColumn("t", F.xxhash64("text"))
    described = kept(marked.mapInArrow(_describe(words), f"key {kind}, t long, n long, c long"), "jaccard-rows")
    classes = described.where("c is not null").groupBy("c").agg(F.min("key").alias("lead"))

    counted = base.select("text").mapInArrow(_count(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("n").desc(), "h").limit(FREQUENCIES).orderBy("h").toArrow()
    frequent, counts = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(frequent)
    frequent, counts = frequent[order], counts[order]

    postings = base.select("text").mapInArrow(_postings(words, percent, frequent, counts), "h long, c long, n int, level short, l short")
    dealt = postings.repartition("h").sortWithinPartitions("h", "n", "c")
    shared = kept(dealt.mapInArrow(_by_run(_runs, percent), SHARED), "jaccard-shared")

    # One row's text stands for each class that may have a candidate.
    compared = shared.groupBy("c").agg(F.count("*").alias("got"), F.min("least").alias("need")).where("got >= need").select("c")
    chosen = described.join(compared, "c").groupBy("c").agg(F.min(F.struct("key", "t")).alias("row")).select("c", "row.*")
    texts = marked.join(chosen.withColumnsRenamed({"key": "chosen"}), "t").where(F.col("key").eqNullSafe(F.col("chosen"))).dropDuplicates(["t"])
    sets = kept(texts.select("c", "text").mapInArrow(_sets(words), "c long, shingles array<long>, marks binary"), "jaccard-sets")
    nothing = docs.sparkSession.createDataFrame([], "a long, b long")
    links = tried = nothing
    found = components(links)
    for turn in range(TURNS):
        # Neighbours in a run differ from order to order and from turn to turn among equal lengths. The best partners only, and half of the matches
        # will do: these turns are to join what is easily joined, the last step is to be complete.
        near = _rooted(shared, found).repartition("h").sortWithinPartitions("h", "n", F.xxhash64("c", F.pmod("h", F.lit(ORDERS)), F.lit(turn)))
        near = near.mapInArrow(_by_run(_neighbours, percent), "c long, other long, need short").groupBy("c", "other")
        near = near.agg(F.max("need").alias("need"), F.count("*").alias("got")).where("2 * got >= need")
        best = F.row_number().over(W.partitionBy("c").orderBy(F.col("got").desc(), "other"))
        fresh = near.withColumn("place", best).where(F.col("place") <= PARTNERS)
        fresh = fresh.select(F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b")).distinct()
        fresh = kept(fresh.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        new = kept(_verified(fresh, sets, percent), "jaccard-links")
        tried, n_tried, n_new = tried.unionByName(fresh), fresh.count(), new.count()
        if n_new:
            links = links.unionByName(new)
            found = components(links)
        if n_new * 10 <= n_tried:
            break
    # Of a large group that links nearly all pairs pass; a few of each class join it before all pairs are asked for.
    fresh = _crossing(shared, found, sets, percent, PARTNERS).select("a", "b").distinct()
    fresh = kept(fresh.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    new = kept(_verified(fresh, sets, percent), "jaccard-links")
    tried, links = tried.unionByName(fresh), links.unionByName(new)
    if not new.isEmpty():
        found = components(links)
    rest = _crossing(shared, found, sets, percent).groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("got").alias("got")).where("got >= need").select("a", "b")
    more = kept(_verified(rest.join(tried, ["a", "b"], "left_anti"), sets, percent), "jaccard-links")
    found = components(links.unionByName(more))

    rooted = classes.join(found.withColumnRenamed("node", "c"), "c", "left").select("c", "lead", F.coalesce("root", "c").alias("root"))
    least = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    of_class = rooted.join(least, "root").select("c", "component_id")
    out = described.join(of_class, "c", "left")
    return out.select(
        F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")
    )


def query(spark, folder: str) -> DataFrame:
    """All documents with their near-duplicate component."""
    return near_duplicates(documents(spark, folder, "doc_id", "text"))


# The contract over all windows and pairs, for small tables.
SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS said FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (said) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = d.doc_id"""

QUERIES = {"op9_ngram_jaccard_join": (query, SQL)}
