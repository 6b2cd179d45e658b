"""Near-duplicates: MinHash bands, sequential Bayesian pruning, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, row_key, settle, solid_words, whole
from .graph import connected_components

#: A pair at 0.8 shares none of 26 bands of 5 with probability 3e-5, one at 0.85 with 2e-7.
BANDS, ROWS = 26, 5
#: Hashes that are compared at a time, and the posterior probability of reaching the threshold under which a pair goes.
BATCH, MISS = 26, 1e-6
#: Members of a bucket that are held together when it is compared in blocks.
BLOCK = 256
SEED = 20_240_917

_U64 = np.uint64


def permutations(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * _U64(2) + _U64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``size`` word hashes; of fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    span = min(n, size)
    sums = np.full(n - span + 1, span, dtype=np.uint64)
    for j in range(span):
        sums = _mix(sums + words[j : n - span + 1 + j] * _U64(0x9E3779B97F4A7C15))
    return np.unique(sums)


def signatures(batches: Iterator[pa.RecordBatch], size: int, count: int) -> Iterator[pa.RecordBatch]:
    """(id, key, c1, c2, hashes) to (id, key, c1, c2, n_shingles, sig); a few documents at a time, so memory is bounded."""
    a, b = permutations(count)
    for batch in batches:
        lists = batch.column(4)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        sets = [shingle_hashes(flat[offsets[i] : offsets[i + 1]], size) for i in range(len(lists))]
        sizes = np.array([len(x) for x in sets], "int64")
        sigs: list[bytes | None] = [None] * len(sets)
        begin = 0
        while begin < len(sets):
            end, held = begin, 0
            while end < len(sets) and (end == begin or held + sizes[end] <= 1 << 16):
                held += sizes[end]
                end += 1
            some = [i for i in range(begin, end) if sizes[i]]
            if some:
                values = np.concatenate([sets[i] for i in some])
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                out = np.empty((len(some), count), "<u4")
                for k in range(count):
                    out[:, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> _U64(32)).astype(np.uint32), starts)
                for i, row in zip(some, out, strict=True):
                    sigs[i] = row.tobytes()
            begin = end
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sizes), pa.array(sigs, pa.binary())], names=["id", "key", "c1", "c2", "n_shingles", "sig"])


def least_matches(percent: int, count: int, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, fewest equal ones with which a pair stays), for each batch.

    With a uniform prior, m equal hashes of n leave a Beta(m + 1, n - m + 1) posterior for the similarity, whose
    mass from t on is the probability of at most m successes in n + 1 trials at t.
    """
    t = percent / 100
    out = []
    for n in range(batch, count + 1, batch):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def prune(batches: Iterator[pa.RecordBatch], bounds: list[tuple[int, int]], count: int) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b) to the (a, b) that no batch of hashes rules out."""
    for batch in batches:
        left = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, count)
        right = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").reshape(-1, count)
        alive, equal, begin = np.arange(len(left)), np.zeros(len(left), "int64"), 0
        for n, least in bounds:
            equal = equal + (left[alive, begin:n] == right[alive, begin:n]).sum(1)
            keep = equal >= least
            alive, equal, begin = alive[keep], equal[keep], n
        yield batch.select([0, 1]).take(pa.array(alive))


def shingle_set(text: str, size: int) -> set:
    """Distinct runs of ``size`` words of a text whose words are joined by single blanks."""
    words = text.split(" ")
    return {tuple(words)} if len(words) < size else set(zip(*(words[j:] for j in range(size)), strict=False))


def verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the (a, b) whose full shingle sets reach the similarity."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            left, right = shingle_set(x.as_py(), size), shingle_set(y.as_py(), size)
            shared = len(left & right)
            keep.append(100 * shared >= percent * (len(left) + len(right) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each task, as sorted by their first column."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def candidates(rows: list[tuple], bounds: list[tuple[int, int]], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, two, equal hashes) of the members (task, band, key, part, side, sig) of a task that may be similar.

    Members of different parts are compared, two sides if the task has two, else each with each. Pairs fall as soon
    as a batch of hashes rules them out; pairs that already met in an earlier band are left to that band's bucket.
    """
    band = rows[0][1]
    sigs = np.frombuffer(b"".join(r[5] for r in rows), "<u4").reshape(-1, count)
    number = {p: i for i, p in enumerate(dict.fromkeys(r[3] for r in rows))}
    part = np.array([number[r[3]] for r in rows])
    side = np.array([r[4] for r in rows])
    two_sides, order = bool(side.any() and not side.all()), np.arange(len(rows))
    left, right, hits = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    for i in range(len(rows)):
        if two_sides and side[i]:
            continue
        js = np.flatnonzero((part != part[i]) & (side if two_sides else order > i))
        equal, begin = np.zeros(len(js), "int64"), 0
        for n, least in bounds:
            equal = equal + (sigs[js, begin:n] == sigs[i, begin:n]).sum(1)
            keep = equal >= least
            js, equal, begin = js[keep], equal[keep], n
        if band and len(js):
            early = (sigs[js, : band * ROWS] == sigs[i, : band * ROWS]).reshape(len(js), band, ROWS).all(2).any(1)
            js, equal = js[~early], equal[~early]
        left.append(np.full(len(js), i))
        right.append(js)
        hits.append(equal)
    return np.concatenate(left), np.concatenate(right), np.concatenate(hits)


def hopeful(batches: Iterator[pa.RecordBatch], bounds: list[tuple[int, int]], count: int) -> Iterator[pa.RecordBatch]:
    """(task, band, key, part, side, sig), sorted by task, to the members (task, key) that have any candidate."""
    for rows in by_task(batches):
        one, two, _ = candidates(rows, bounds, count)
        if len(one):
            held = [rows[i] for i in np.union1d(one, two).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[2] for r in held], pa.binary())], names=["task", "key"])


def compare_blocks(batches: Iterator[pa.RecordBatch], bounds: list[tuple[int, int]], count: int, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(task, band, key, part, side, sig, text), sorted by task, to verified links between parts: (a, b).

    Candidates are decided on the full sets, the likeliest first; a link joins the two parts, whose members need no
    further comparison, so a task puts out fewer links than it has parts.
    """
    for rows in by_task(batches):
        one, two, equal = candidates(rows, bounds, count)
        part = [r[3] for r in rows]
        parent, sets, found = {p: p for p in part}, {}, []

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for k in np.argsort(-equal, kind="stable").tolist():
            i, j = int(one[k]), int(two[k])
            x, y = root(part[i]), root(part[j])
            if x == y:
                continue
            for m in (i, j):
                if m not in sets:
                    sets[m] = shingle_set(rows[m][6], size)
            shared = len(sets[i] & sets[j])
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[x] = y
                found.append((min(rows[i][2], rows[j][2]), max(rows[i][2], rows[j][2])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"])


def size_class(n: Column, percent: int) -> Column:
    """Class of a set's size. Sets that are similar to ``percent`` have sizes within that ratio, so their classes differ by one
    at most; classes are a little wider than the ratio, as logarithms round."""
    return F.floor(F.log(n.cast("double")) / (log(100 / min(percent, 99)) * (1 + 1e-9)))


def _links(pairs: DataFrame, sigs: DataFrame, worded: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the (a, b) key pairs that are similar, settled."""
    count = BANDS * ROWS
    bounds = least_matches(percent, count)
    left = sigs.select(F.col("key").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("key").alias("b"), F.col("sig").alias("sig_b"))
    alive = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lambda x: prune(x, bounds, count), "a binary, b binary")
    alive = settle(alive, "near-alive")
    named = settle(alive.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-named")
    texts = settle(join_checked(worded, named, "key", "left_semi").dropDuplicates(["key"]), "near-words")
    left = texts.select(F.col("key").alias("a"), F.col("body").alias("body_a"))
    right = texts.select(F.col("key").alias("b"), F.col("body").alias("body_b"))
    found = alive.join(left, "a").join(right, "b").select("a", "b", "body_a", "body_b").mapInArrow(lambda x: verify(x, size, percent), "a binary, b binary")
    return settle(found, "near-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, key, n_shingles, component_id, component_key, n_links), a row for each row of ``docs``.

    A document's set is its distinct runs of ``size`` words (A-Z lower-cased, split at ASCII white space); with
    fewer words, the whole sequence. Two are linked if 100 * intersection >= ``percent`` * union; component_id is
    the smallest id in a document's connected component, n_links the links of its class that were verified (enough
    to connect it, not all there are).

    1. Texts with the same word sequence are one class with one representative, so copies cost one row.
    2. Members of a band's bucket are compared with the smallest member only: pairs grow with a group's size.
    3. Where that leaves a bucket with several components, members outside its largest one are compared with all
       members of other components whose set may be near enough in size, block by block inside tasks: what step 2
       could miss. Signatures are compared first; texts are fetched only for members with a candidate left. Only verified links leave a task, fewer
       than the components it holds.
    Candidates fall away as soon as the posterior of reaching ``percent`` sinks under MISS; survivors are decided
    on the full sets. A pair at the threshold shares no band with the probability stated at BANDS.

    Null, empty and blank texts have no shingles and no links. Equal rows share their class. A null id counts as
    the smallest. An empty table gives an empty result; other columns are not read.
    """
    count = BANDS * ROWS
    source = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    worded = source.select("id", row_key(F.col("id"), F.col("text")).alias("key"), solid_words(F.col("text")).alias("words"))
    joined = F.array_join("words", " ")
    hashed = worded.select("id", "key", F.xxhash64(joined).alias("c1"), F.xxhash64(F.lit(1), joined).alias("c2"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = settle(hashed.mapInArrow(lambda b: signatures(b, size, count), f"id {id_type}, key binary, c1 long, c2 long, n_shingles long, sig binary"), "near-signatures")

    classes = signed.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min(F.struct("id", "key")).alias("node"), F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig"), F.min(size_class(F.col("n_shingles"), percent)).alias("size"))
    classes = settle(classes.select("c1", "c2", "node", F.col("node.key").alias("key"), "copies", "sig", "size"), "near-classes")
    sigs = classes.select("key", "sig")
    bands = classes.select("node", "size", F.posexplode(F.array(*[F.substring("sig", 1 + 4 * ROWS * i, 4 * ROWS) for i in range(BANDS)])).alias("band", "part")).select("node", "size", "band", F.xxhash64("band", "part").alias("bucket"))
    shared = settle(bands.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where(F.col("first") != F.col("last")).select("bucket", "first"), "near-buckets")
    members = settle(join_checked(bands, shared, "bucket", "inner"), "near-members")

    stars = settle(members.where(F.col("node") != F.col("first")).select(F.col("first.key").alias("a"), F.col("node.key").alias("b")).distinct(), "near-stars")
    bodies = worded.select("key", joined.alias("body"))
    links = _links(stars, sigs, bodies, size, percent)
    nodes = classes.select("key", "node")

    def components(edges: DataFrame) -> DataFrame:
        ends = edges.join(nodes.select(F.col("key").alias("a"), F.col("node").alias("x")), "a").join(nodes.select(F.col("key").alias("b"), F.col("node").alias("y")), "b")
        return settle(connected_components(ends.select("x", "y"), "x", "y"), "near-components")

    parts = components(links)
    placed = join_checked(members, parts, "node", "left").select("bucket", "size", "band", "node", F.coalesce("component", "node").alias("part"))
    # Only sets of one size class or two neighbouring ones can be similar: a bucket falls apart into cells, in which a
    # member is at home in one and a guest in the one below.
    visits = F.explode(F.array(F.struct(F.col("size").alias("cell"), F.lit(1).alias("home")), F.struct((F.col("size") - 1).alias("cell"), F.lit(0).alias("home"))))
    placed = placed.select(visits.alias("at"), "bucket", "band", "node", "part").select(F.xxhash64("bucket", "at.cell").alias("bucket"), "at.home", "band", "node", "part")
    # Cells that still have several components are compared in blocks, so no task holds a whole one.
    sizes = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("count"), F.sum("home").alias("home"))
    top = F.max(F.struct("count", "part"))
    open_ = sizes.groupBy("bucket").agg(top["part"].alias("main"), top["count"].alias("inner"), F.sum("count").alias("all"), F.count(F.lit(1)).alias("n"), F.sum("home").alias("home")).where("n > 1 AND home > 0")
    open_ = settle(open_.drop("n", "home"), "near-open")
    if not open_.isEmpty():
        left = join_checked(placed, open_, "bucket", "inner").select("bucket", "band", F.col("node.key").alias("key"), F.col("part.key").alias("part"), (F.col("part") == F.col("main")).alias("main"), "all", F.ceil((F.col("all") - F.col("inner")) / BLOCK).alias("outs"), F.ceil(F.col("inner") / BLOCK).alias("ins"))
        own = F.pmod(F.xxhash64("key", "bucket"), F.when(F.col("main"), F.col("ins")).otherwise(F.col("outs")))
        left = left.withColumn("own", own)
        each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
        zero, no = F.lit(0).cast("long"), F.lit(False)
        # Outer blocks meet each other and themselves, and the blocks of the largest component; those do not meet.
        outer = F.concat(
            F.transform(each("outs"), lambda j: task(0, F.least("own", j), F.greatest("own", j), F.col("own") > j)),
            F.transform(each("ins"), lambda j: task(1, F.col("own"), j, no)),
        )
        inner = F.transform(each("outs"), lambda i: task(1, i, F.col("own"), F.lit(True)))
        tasks = F.when(F.col("all") <= 2 * BLOCK, F.array(task(2, zero, zero, no))).when(F.col("main"), inner).otherwise(outer)
        left = left.select("bucket", "band", "key", "part", F.explode(tasks).alias("t")).select(F.xxhash64("bucket", "t.kind", "t.i", "t.j").alias("task"), "band", "key", "part", "t.side")
        left = settle(left, "near-blocks")
        # Signatures alone meet first; texts follow only for members that a signature could not rule out.
        bounds = least_matches(percent, count)
        rows = left.join(sigs, "key").select("task", "band", "key", "part", "side", "sig")
        some = rows.repartition("task").sortWithinPartitions("task").mapInArrow(lambda x: hopeful(x, bounds, count), "task long, key binary")
        some = settle(some, "near-hopeful")
        named = settle(some.select("key").distinct(), "near-named")
        texts = settle(join_checked(bodies, named, "key", "left_semi").dropDuplicates(["key"]), "near-words")
        rows = join_checked(left, some, ["task", "key"], "left_semi").join(join_checked(sigs, named, "key", "left_semi").join(texts, "key"), "key").select("task", "band", "key", "part", "side", "sig", "body")
        more = rows.repartition("task").sortWithinPartitions("task").mapInArrow(lambda x: compare_blocks(x, bounds, count, size, percent), "a binary, b binary")
        more = settle(more.distinct(), "near-links")
        if not more.isEmpty():
            links = settle(links.unionByName(more), "near-links")
            parts = components(links)

    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    grouped = classes.join(parts, "node", "left").select("c1", "c2", "key", "copies", F.coalesce("component", "node").alias("root"), F.col("component").isNotNull().alias("linked"))
    # Classes of one row without links are their own component and need no join.
    grouped = grouped.where(F.col("linked") | (F.col("copies") > 1)).join(degree, "key", "left").select("c1", "c2", F.col("root.id").alias("component_id"), F.col("root.key").alias("component_key"), "n_links")
    grouped = settle(grouped.withColumn("_found", F.lit(True)), "near-grouped")
    out = join_checked(signed.select("id", "key", "c1", "c2", "n_shingles"), grouped, ["c1", "c2"], "left")
    own = F.col("_found") & (F.col("n_shingles") > 0)
    return out.select(F.col("id").alias(id_col), "key", "n_shingles", F.when(own, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.when(own, F.col("component_key")).otherwise(F.col("key")).alias("component_key"), F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the one with the smallest id, all columns kept.

    Documents without words are kept. Of rows that agree in id (and are linked) one stays as well; of rows that
    agree in id and text, which no key tells apart, the first of each task's group.
    """
    found = settle(near_duplicates(docs, id_col, text_col, size, percent), "near-result")
    # A component's kept row has the component's key.
    losers = found.where((F.col("n_shingles") > 0) & (F.col("key") != F.col("component_key"))).select(F.col("key").alias("_el_key")).distinct()
    losers = settle(losers, "near-losers")
    keyed = docs.withColumn("_el_key", row_key(F.col(id_col), whole(F.col(text_col))))
    kept = join_checked(keyed, losers, "_el_key", "left_anti")
    twice = settle(found.where("n_shingles > 0").groupBy("key").count().where("count > 1").select(F.col("key").alias("_el_key")), "near-twice")
    if twice.isEmpty():
        return kept.drop("_el_key")
    single = join_checked(kept, twice, "_el_key", "left_anti")
    return single.unionByName(join_checked(kept, twice, "_el_key", "left_semi").dropDuplicates(["_el_key"])).drop("_el_key")
