"""K-d tree sharding by DataFrame functions only.

Every row is a point of metadata dimensions (log size, checksum, source, language,
id), each scaled to the box of all rows. A node with k leaves to come is cut along
the dimension in which its cell (the box as the cuts above have left it) is widest,
at the weighted quantile that gives its halves of the leaves (k // 2 and the rest)
their share of the bytes, until every node is one leaf of the target size. All nodes
of a level are cut together: bytes are counted in a bounded number of bins of every
open node, and inside the one bin that holds the cut rows are sorted and summed up.
A bin that holds too many rows for that is binned again, by the key until it is one
key (a hot group of equal texts may hold a third of all rows), then by a second key
of id and row, so no group must fit a shard or a task; a node of few rows is one bin.
Passes read a written table of metadata; texts are read once. Only cut points, a few
a node, reach the driver.

Nulls: a null text has no bytes, null source, language and id sort first. Empty
and repeated rows are rows like others. Other columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Bytes of a row beside its text.
ROW_BYTES = 8
#: Bins of a node in one pass.
BINS = 4096
#: Rows of a bin that one task sorts and sums up at most.
SORTED_ROWS = 100_000
KEY_BITS = 31
#: Levels after which the rows' nodes are written out.
WRITE_EVERY = 4


def with_metadata(df: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, dims array<double>, row) of every document."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")).cast("double")
    size = (F.octet_length(raw) + ROW_BYTES).cast("long")
    out = df.select("doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), *[named(c).alias(f"_{c}") for c in ("source", "lang") if c in df.columns])
    dims = [F.log(F.col("size")), F.col("text_crc32").cast("double"), *[F.col(c) for c in out.columns if c[0] == "_"], F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))]
    return out.select("doc_id", "size", "text_crc32", F.array(*dims).alias("dims"), F.monotonically_increasing_id().alias("row"))


def kd_shards(df: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) with near equal bytes in every shard."""
    n_dims = 3 + sum(c in df.columns for c in ("source", "lang"))
    meta = written(with_metadata(df), "kd")
    sides = [f(F.col("dims")[i]).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
    box = meta.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *sides).head()
    if not box.rows:
        return meta.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # Scaled to integers of KEY_BITS: order within a node is (dimension, checksum), then (id, row).
    top = float((1 << KEY_BITS) - 1)
    cells = [F.floor((F.col("dims")[i] - box[f"lo{i}"]) / F.lit((box[f"hi{i}"] - box[f"lo{i}"]) or 1.0) * top).cast("long") for i in range(n_dims)]
    points = meta.select("doc_id", "size", "text_crc32", F.array(*cells).alias("cell"), F.shiftrightunsigned(F.col("text_crc32"), 1).alias("tie"), F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 2).alias("key2"), F.lit(0).cast("long").alias("node"))
    # Open nodes: first leaf, leaves, bytes, rows, cell.
    cell = [[0, (1 << KEY_BITS) - 1 if box[f"hi{i}"] > box[f"lo{i}"] else 0] for i in range(n_dims)]
    nodes, level, last = {0: {"first": 0, "leaves": shards, "bytes": box.bytes, "rows": box.rows, "cell": cell}}, 0, None
    leaves = {}
    while True:
        leaves |= {k: v["first"] for k, v in nodes.items() if v["leaves"] == 1}
        nodes = {k: v for k, v in nodes.items() if v["leaves"] > 1}
        if not nodes:
            break
        cuts, below = _cut_level(points, nodes), {}
        for k, cut in cuts.items():
            v, c = nodes[k], cut["key"] >> KEY_BITS
            half, lo, hi = v["leaves"] // 2, [list(x) for x in v["cell"]], [list(x) for x in v["cell"]]
            lo[cut["dim"]][1], hi[cut["dim"]][0] = max(c, lo[cut["dim"]][0]), max(c, hi[cut["dim"]][0])
            below[2 * k + 1] = {"first": v["first"], "leaves": half, "bytes": cut["left"], "rows": cut["rows"], "cell": lo}
            below[2 * k + 2] = {"first": v["first"] + half, "leaves": v["leaves"] - half, "bytes": v["bytes"] - cut["left"], "rows": v["rows"] - cut["rows"], "cell": hi}
        nodes, level = below, level + 1
        points = _descend(points, cuts)
        if level % WRITE_EVERY == 0:
            points = written(points, "kd-points")
            dropped(last)
            last = points
    names = points.sparkSession.sql(_values("node, shard", list(leaves.items())))
    return with_slots(points.join(F.broadcast(names), "node"), box.rows)


def _values(names: str, rows: list[tuple]) -> str:
    """A table of a few rows a node; the nodes number less than twice the shards."""
    return "SELECT * FROM VALUES " + ", ".join("(" + ", ".join(f"{int(x)}L" for x in r) + ")" for r in rows) + f" AS t({names})"


#: First key of a row along the dimension numbered ``dim``.
_KEY = f"element_at(cell, int(dim) + 1) * {1 << KEY_BITS}L + tie"


def _descend(points: DataFrame, cuts: dict) -> DataFrame:
    """Move the rows of cut nodes to their left or right child."""
    t = _values("node, dim, at, at2", [(k, c["dim"], c["key"], c["key2"]) for k, c in cuts.items()])
    return points.sparkSession.sql(
        f"""WITH t AS ({t}), k AS (SELECT /*+ BROADCAST(t) */ p.*, t.dim, at, at2, {_KEY} AS key FROM {{points}} p LEFT JOIN t ON p.node = t.node)
        SELECT doc_id, size, text_crc32, cell, tie, key2, CASE WHEN dim IS NULL THEN node ELSE 2 * node + IF(key > at OR (key = at AND key2 > at2), 2, 1) END AS node FROM k""",
        points=points,
    )


def _cut_level(points: DataFrame, nodes: dict) -> dict:
    """The cut of every open node: dimension, last key and second key of its left side, bytes and rows there."""
    found, state, ready = {}, {}, {}
    for k, v in nodes.items():
        dim = max(range(len(v["cell"])), key=lambda i: (v["cell"][i][1] - v["cell"][i][0], -i))
        lo, hi = v["cell"][dim]
        s = {"dim": dim, "lo": lo << KEY_BITS, "hi": ((hi + 1) << KEY_BITS) - 1, "left": 0, "rows": 0, "goal": v["bytes"] * (v["leaves"] // 2) // v["leaves"], "key": None}
        if not v["rows"]:
            found[k] = {"dim": dim, "key": -1, "key2": -1, "left": 0, "rows": 0}
        else:
            (ready if v["rows"] <= SORTED_ROWS else state)[k] = s
    while state:
        # A node looks for its first key until that is one value, then for the second key.
        width = {k: (s["hi"] - s["lo"]) // BINS + 1 for k, s in state.items()}
        # The first bin whose running sum reaches what the left side still needs; bins are bounded in number.
        hits = _inside(
            points, state, width,
            """b AS (SELECT node, need, (v - lo) div w AS bin, sum(size) AS bytes, count(*) AS n, min(v) AS least, max(v) AS most FROM i GROUP BY 1, 2, 3),
            r AS (SELECT *, sum(bytes) OVER upto AS run, sum(n) OVER upto AS run_n FROM b WINDOW upto AS (PARTITION BY node ORDER BY bin))
            SELECT node, min(struct(bin, bytes, n, least, most, run, run_n)) AS x FROM r WHERE run >= need GROUP BY node""",
        ).collect()
        for k, x in ((r.node, r.x) for r in hits):
            s = state[k]
            s["left"], s["rows"] = s["left"] + x.run - x.bytes, s["rows"] + x.run_n - x.n
            s["lo"], s["hi"] = x.least, x.most
            if x.n <= SORTED_ROWS or (x.least == x.most and s["key"] is not None):
                ready[k] = state.pop(k)
            elif x.least == x.most:
                s["key"], s["lo"], s["hi"] = x.least, 0, (1 << 62) - 1
    if not ready:
        return found
    cut = _inside(
        points, ready, dict.fromkeys(ready, 1),
        """r AS (SELECT *, sum(size) OVER upto AS run, count(*) OVER upto AS n FROM i WINDOW upto AS (PARTITION BY node ORDER BY key, key2 ROWS UNBOUNDED PRECEDING))
        SELECT node, min(struct(n, run, key, key2, size)) AS x FROM r WHERE run >= need GROUP BY node""",
    )
    for k, x in ((r.node, r.x) for r in cut.collect()):
        # The row that reaches the goal goes to the side that leaves the smaller error.
        s, before = ready[k], x.run - x["size"]
        take = 2 * (s["goal"] - s["left"] - before) >= x["size"]
        found[k] = {"dim": s["dim"], "key": x.key, "key2": x.key2 - (0 if take else 1), "left": s["left"] + before + (x["size"] if take else 0), "rows": s["rows"] + x.n - (0 if take else 1)}
    return found


def _inside(points: DataFrame, state: dict, width: dict, rest: str) -> DataFrame:
    """``rest`` over i, the rows of the nodes in ``state`` whose value ``v``, the first key or the second one of a given first key, is in range."""
    t = _values("node, dim, at, lo, hi, w, need", [(k, s["dim"], -1 if s["key"] is None else s["key"], s["lo"], s["hi"], width[k], s["goal"] - s["left"]) for k, s in state.items()])
    return points.sparkSession.sql(
        f"""WITH t AS ({t}), k AS (SELECT /*+ BROADCAST(t) */ p.node, p.size, p.key2, at, lo, hi, w, need, {_KEY} AS key FROM {{points}} p JOIN t ON p.node = t.node),
        v AS (SELECT *, CASE WHEN at < 0 THEN key WHEN key = at THEN key2 END AS v FROM k), i AS (SELECT * FROM v WHERE v BETWEEN lo AND hi), {rest}""",
        points=points,
    )


def with_slots(placed: DataFrame, rows: int, bucket_rows: int = 4096) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows are numbered within small hashed buckets of a shard; a bucket's first
    number comes from the counts of the buckets before it. No task holds a shard.
    """
    buckets = max(1, rows // bucket_rows)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("key2"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key2")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.withColumn("n", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("n")).cast("long").alias("slot"))
