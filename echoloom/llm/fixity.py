"""WARC fixity: Merkle trees over records and their offset ranges, replicas compared from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_checked, settle

#: Children of a node: 2 ** BITS.
BITS = 4
#: Records of an archive file: 2 ** FILE_BITS ids.
FILE_BITS = 12


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record; a null url or page is empty."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def manifest(records: DataFrame, id_col: str, bytes_col: str, offset_col: str | None = None) -> DataFrame:
    """(id, archive, offset, length, digest, gap, ordered): where each record lies in its archive file, and its SHA-256.

    Archives take 2 ** FILE_BITS consecutive ids. Offsets are those of ``offset_col``; without one, records follow
    each other by id (of one id, by digest). gap is the number of bytes between a record and the one before it in
    the file (negative if they overlap), ordered whether no record before it has a larger id. Null ids lie in no
    archive. Only lengths and digests are shuffled, never the records; a window holds the records of one archive.
    """
    given = [] if offset_col is None else [F.col(offset_col).cast("long").alias("offset")]
    hashed = records.select(F.col(id_col).alias("id"), F.length(bytes_col).cast("long").alias("length"), F.sha2(F.col(bytes_col), 256).alias("digest"), *given)
    placed = hashed.where("id IS NOT NULL").withColumn("archive", F.floor(F.col("id") / F.lit(1 << FILE_BITS)).cast("long"))
    order = ["id", "digest"] if offset_col is None else ["offset", "id", "digest"]
    before = Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if offset_col is None:
        placed = placed.withColumns({"offset": F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"), "gap": F.lit(0).cast("long"), "ordered": F.lit(True)})
    else:
        end = F.lag(F.col("offset") + F.col("length")).over(Window.partitionBy("archive").orderBy(*order))
        placed = placed.withColumns({"gap": F.col("offset") - F.coalesce(end, F.lit(0)), "ordered": F.coalesce(F.max("id").over(before) <= F.col("id"), F.lit(True))})
    columns = ["id", "archive", "offset", "length", "digest", "gap", "ordered"]
    return placed.select(columns).unionByName(hashed.where("id IS NULL").select("id", "length", "digest"), allowMissingColumns=True)


def leaves(manifested: DataFrame) -> DataFrame:
    """(node, first, last, hash, content) by id: hash covers content, gap and order of its records, content length and digest.

    Absolute offsets are left out, so what merely stands behind a longer or a missing record is as it was. Records
    with one id are combined by count and sums of 15 hex digits of each record's hash, a state of fixed size, so any
    number of repeated ids is one row. Null ids cannot be placed and are left out.
    """
    def sums(name: str, *cols: str) -> list[Column]:
        one = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)
        return [F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"{name}{i}") for i in range(4)]

    whole = lambda name: F.sha2(F.concat_ws("|", F.lit("leaf"), "node", "n", *[f"{name}{i}" for i in range(4)]), 256)
    ends = [F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("last")]
    rows = manifested.where("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("node")).agg(F.count(F.lit(1)).alias("n"), *ends, *sums("s", "length", "digest", "gap", "ordered"), *sums("c", "length", "digest"))
    return rows.select("node", "first", "last", whole("s").alias("hash"), whole("c").alias("content"))


def tree(leaf: DataFrame, highest: int, bits: int = BITS) -> list[DataFrame]:
    """Levels from the leaves to one root: (node, first, last, hash). The parent of a node is node >> bits.

    A parent hashes its children's numbers, lengths of offset ranges and hashes in order: at most 2 ** bits of them,
    so no task gathers more.
    Nodes run from 0 to ``highest``, the same for all replicas, whose trees are therefore of one height.
    """
    levels = [settle(leaf, "tree-0")]
    while highest:
        highest >>= bits
        child = levels[-1].select(F.shiftright("node", bits).alias("parent"), "node", "first", "last", "hash")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", (F.col("last") - F.col("first")).alias("span"), "hash"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["span"].cast("string"), c["hash"])), ",")
        up = child.groupBy("parent").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(joined, 256).alias("hash"))
        levels.append(settle(up.withColumnRenamed("parent", "node"), f"tree-{len(levels)}"))
    return levels


def audit(a: DataFrame, b: DataFrame, bits: int = BITS) -> tuple[DataFrame, list[int]]:
    """Compare two manifests. Returns (id, state) of the ids that differ, and the nodes visited by level, root first.

    state is ``missing`` (only ``a`` has it), ``extra`` (only ``b``), ``corrupt`` (length or digest differ) or
    ``moved`` (the same bytes with a gap before them, or out of order). Levels are read under
    mismatching nodes alone: where the roots agree, nothing below them is read.
    """
    spark = a.sparkSession
    left, right = leaves(a), leaves(b)
    span = left.select("node").unionByName(right.select("node")).agg(F.min("node"), F.max("node")).first()
    if span[0] is None:
        return spark.createDataFrame([], "id long, state string"), []
    base = lambda df: df.withColumn("node", F.col("node") - F.lit(span[0]))
    one, two = (tree(base(x), span[1] - span[0], bits) for x in (left, right))
    visited: list[int] = []
    wrong = None
    for x, y in zip(reversed(one), reversed(two), strict=True):
        if wrong is not None:
            under = wrong.select(F.col("node").alias("parent"))
            x, y = (join_checked(z.withColumn("parent", F.shiftright("node", bits)), under, "parent", "left_semi") for z in (x, y))
        bytes_ = lambda z: F.col("content") if "content" in z.columns else F.lit("")
        met = x.select("node", F.col("hash").alias("ours"), bytes_(x).alias("our_bytes")).join(y.select("node", F.col("hash").alias("theirs"), bytes_(y).alias("their_bytes")), "node", "full")
        met = settle(met, "tree-met")
        visited.append(met.count())
        wrong = settle(met.where(~F.col("ours").eqNullSafe(F.col("theirs"))), "tree-wrong")
    state = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").when(F.col("our_bytes") == F.col("their_bytes"), "moved").otherwise("corrupt")
    return wrong.select((F.col("node") + F.lit(span[0])).alias("id"), state.alias("state")), visited


def fixity(pages: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", offset_col: str | None = None) -> DataFrame:
    """(id, archive, offset, length, digest, state): the manifest of ``pages`` with what the audit of ``replica`` found.

    Both have the named columns; ``offset_col`` of the replica says where its records lie in their archives (without
    it they follow each other by id). state is ``ok``, ``corrupt``, ``moved``, ``missing`` or ``extra``; a record that
    only the replica has is listed with its place there. All records of an id share its state. Each copy is held
    against its own offsets: a gap before a record, an overlap or a record behind one of a larger id is ``moved``;
    what stands at another offset because a record before it is longer or missing is not. Null ids have no place and
    are ``unaudited``. Other columns are not read. Empty tables are audited like others.
    """
    def listed(df: DataFrame, offset: str | None) -> DataFrame:
        given = [] if offset is None else [F.col(offset).alias("_offset")]
        records = df.select(F.col(id_col).alias("_id"), warc_record(F.col(id_col), F.col(url_col), F.col(html_col)).alias("_bytes"), *given)
        return manifest(records, "_id", "_bytes", None if offset is None else "_offset")

    ours, theirs = settle(listed(pages, None), "manifest"), settle(listed(replica, offset_col), "manifest-replica")
    found = settle(audit(ours, theirs)[0], "audit")
    columns = ["id", "archive", "offset", "length", "digest", "state"]
    state = F.when(F.col("id").isNull(), "unaudited").otherwise(F.coalesce("state", F.lit("ok")))
    extra = join_checked(theirs, found.where("state = 'extra'"), "id", "inner").select(columns)
    return join_checked(ours, found, "id", "left").withColumn("state", state).select(columns).unionByName(extra).withColumnRenamed("id", id_col)
