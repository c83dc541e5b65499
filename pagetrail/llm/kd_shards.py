"""Shards by a k-d tree over document metadata.

The tree splits all documents recursively at a weighted median along the
dimension in which a node is widest, until each leaf is one shard.  Weights
are bytes; a node that shall give s shards is split in the proportion of
floor(s / 2) to the rest.

A row carries its node: the first of the node's shards and how many there are.
All nodes of a level are split by the same jobs.  What is known of nodes is a table;
rows look up to ``NODES_IN_LITERALS`` nodes up in literal arrays and join more than
these, so that neither the driver nor an expression grows with the tree.  The
medians of large nodes are distributed: a pass sums bytes in 1024 bins per node
over a 62-bit key (31 bits of the scaled dimension, then 31 bits of a hash that
breaks ties), and goes on between the least and the largest key of the bin that
holds the median.  Nodes of up to ``ROWS_PER_NODE`` rows are split to the end by
running sums in the order of the dimension, all levels after one exchange.
DataFrame functions only.

Defined results: a null text has no bytes; null metadata sorts first; rows with
equal metadata are split by the hash of their key and text; repeated rows that
agree in all of these are split by their place; texts are measured whole, however
long; keys of any type, text keys are ordered like sources; other columns may have
any name; an empty table gives no rows.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pagetrail.llm.shared import by_position, cut

_HALF = 31
_BINS = 1024
ROWS_PER_NODE = 40_000
NODES_IN_LITERALS = 64


def text_ordinal(column: Column, skipped: int = 0) -> Column:
    """A number that orders strings by six bytes, after those that all share; null is -1."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1 + skipped, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def _widest(low: list[Column], high: list[Column], spans: list[float]) -> Column:
    """The number of the dimension in which a node is widest."""
    widths = [(h - lo) / F.lit(span) for lo, h, span in zip(low, high, spans, strict=True)]
    return F.array_position(F.array(*widths), F.array_max(F.array(*widths))).cast("int") - 1


def _value(dims: list[str]) -> Column:
    return F.get(F.array(*(F.col(d) for d in dims)), F.col("d"))


def _key(dims: list[str]) -> Column:
    """The scaled value of a row in its node's dimension, then its tie."""
    scaled = F.floor((_value(dims) - F.col("low")) * F.col("scale")).cast("long")
    return F.shiftleft(F.least(F.greatest(scaled, F.lit(0)), F.lit((1 << _HALF) - 1)), _HALF).bitwiseOR(F.col("t"))


def _child(placed: DataFrame, left: Column, split: Column) -> DataFrame:
    """Rows of nodes that are split go to the left half of the shards, or to the right one."""
    half = F.floor(F.col("c") / 2).cast("long")
    return placed.withColumns({"f": F.when(split & ~left, F.col("f") + half).otherwise(F.col("f")), "c": F.when(~split, F.col("c")).when(left, half).otherwise(F.col("c") - half)})


def _with_nodes(rows: DataFrame, nodes: DataFrame, columns: list[str], in_literals: int) -> DataFrame:
    """The rows with these columns of their nodes, null for rows of other nodes. Few nodes are literals, many are joined."""
    nodes = nodes.select("f", *columns)
    few = nodes.limit(in_literals + 1).collect()
    if len(few) > in_literals:
        return rows.join(nodes, "f", "left")
    values = {c: F.array(*(F.lit(node[c]) for node in few)).cast(ArrayType(nodes.schema[c].dataType)) for c in nodes.columns}
    place = F.array_position(values["f"], F.col("f")).cast("int") - 1
    return rows.withColumns({c: F.get(values[c], place) for c in columns})


def _median_splits(placed: DataFrame, nodes: DataFrame, dims: list[str], in_literals: int) -> DataFrame:
    """nodes: f, d, low, scale, goal, near. Returns f, d, low, scale and the key ``split`` below which rows go left."""
    state = nodes.withColumns({"at": F.lit(0).cast("long"), "width": F.lit((1 << 2 * _HALF) // _BINS), "before": F.lit(0).cast("long")})
    done = None
    while True:
        met = _with_nodes(placed.select("f", "w", "t", *dims), state, ["d", "low", "scale", "at", "width"], in_literals)
        keyed = met.where("d IS NOT NULL").withColumn("key", _key(dims))
        inside = keyed.withColumn("bin", F.floor((F.col("key") - F.col("at")) / F.col("width"))).where(F.col("bin").between(0, _BINS - 1))
        bins = inside.groupBy("f", "bin").agg(F.sum("w").alias("own"), F.min("key").alias("least"), F.max("key").alias("most"))
        ahead = F.coalesce(F.sum("own").over(Window.partitionBy("f").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = _with_nodes(bins.withColumn("ahead", ahead), state, ["d", "low", "scale", "goal", "near", "before"], in_literals).withColumn("ahead", F.col("ahead") + F.col("before"))
        found = found.where((F.col("ahead") < F.col("goal")) & (F.col("ahead") + F.col("own") >= F.col("goal")))
        found = cut(found.withColumn("last", (F.col("least") == F.col("most")) | (F.col("own") <= F.col("near"))), small=True)
        # the last bin goes to the nearer side
        nearer = F.when(F.col("ahead") + F.col("own") - F.col("goal") < F.col("goal") - F.col("ahead"), F.col("most") + 1).otherwise(F.col("least"))
        ends = found.where("last").select("f", "d", "low", "scale", nearer.alias("split"))
        done = ends if done is None else done.unionByName(ends)
        if found.where("NOT last").isEmpty():
            return done
        state = found.where("NOT last").select("f", "d", "low", "scale", "goal", "near", F.col("least").alias("at"), F.ceil((F.col("most") - F.col("least") + 1) / _BINS).cast("long").alias("width"), F.col("ahead").alias("before"))


def kd_shards(rows: DataFrame, dimensions: list[str], weight: str, tie: Column, *, shards: int | None = None, target: int | None = None, rows_per_node: int = ROWS_PER_NODE, nodes_in_literals: int = NODES_IN_LITERALS) -> DataFrame:
    """The rows with a column ``shard`` from 0. shards: how many, or target: the weight that a shard shall reach.
    tie: a hash of what tells rows apart."""
    names = rows.columns
    place = F.xxhash64(F.monotonically_increasing_id())
    # 21 bits of the tie, 10 bits of the place
    ties = F.shiftleft(F.shiftrightunsigned(tie, 43), 10).bitwiseOR(F.shiftrightunsigned(place, 54))
    rows, w, *dims = by_position(rows.withColumns({"_kd_tie": ties, "_kd_place": F.monotonically_increasing_id()}), weight, *dimensions)
    rows = rows.withColumnsRenamed({f"c{len(names)}": "t", f"c{len(names) + 1}": "u"})
    rows = cut(rows.withColumns({"w": F.col(w).cast("long"), "f": F.lit(0).cast("long"), "c": F.lit(0).cast("long")}))
    lows, highs = [F.min(d).alias(f"low{i}") for i, d in enumerate(dims)], [F.max(d).alias(f"high{i}") for i, d in enumerate(dims)]
    seen = rows.agg(F.sum("w").alias("w"), *lows, *highs).first()
    kept = [f"c{i}" for i in range(len(names))]
    if seen["w"] is None:
        return rows.select(*kept, F.lit(0).cast("long").alias("shard")).toDF(*names, "shard")
    count = shards or max(1, -(-seen["w"] // target))
    spans = [(seen[f"high{i}"] - seen[f"low{i}"]) or 1.0 for i in range(len(dims))]
    low, high = [F.col(f"low{i}") for i in range(len(dims))], [F.col(f"high{i}") for i in range(len(dims))]
    goal = F.col("weight") * F.floor(F.col("c") / 2) / F.col("c")
    placed = rows.withColumn("c", F.lit(count).cast("long"))
    while True:
        nodes = placed.where("c > 1").groupBy("f", "c").agg(F.sum("w").alias("weight"), F.count("*").alias("n"), *lows, *highs).where(F.col("n") > rows_per_node)
        nodes = nodes.withColumn("d", _widest(low, high, spans)).withColumns({"low": F.get(F.array(*low), F.col("d")), "high": F.get(F.array(*high), F.col("d"))})
        scale = F.when(F.col("high") > F.col("low"), F.lit(float((1 << _HALF) - 1)) / (F.col("high") - F.col("low"))).otherwise(0.0)
        nodes = cut(nodes.select("f", "d", "low", scale.alias("scale"), goal.alias("goal"), (F.col("weight") / F.col("c") / 1000).alias("near")), small=True)
        if nodes.isEmpty():
            break
        splits = _median_splits(placed, nodes, dims, nodes_in_literals)
        met = _with_nodes(placed, splits, ["d", "low", "scale", "split"], nodes_in_literals)
        placed = cut(_child(met, _key(dims) < F.col("split"), F.col("split").isNotNull()).select(*rows.columns))
    # the rest: each node's rows in one task, all levels after this exchange
    most = placed.agg(F.max("c").alias("c")).first()["c"]
    placed = placed.withColumn("top", F.col("f")).repartition("top")
    node = Window.partitionBy("top", "f")
    for _ in range((most - 1).bit_length()):
        placed = placed.withColumns({f"low{i}": F.min(d).over(node) for i, d in enumerate(dims)} | {f"high{i}": F.max(d).over(node) for i, d in enumerate(dims)} | {"weight": F.sum("w").over(node)})
        placed = placed.withColumn("d", _widest(low, high, spans)).withColumn("v", _value(dims))
        running = F.sum("w").over(node.orderBy("v", "t", "u").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = placed.withColumn("running", running)  # a row goes to the side on which its middle lies
        placed = _child(placed, F.col("running") - F.col("w") / 2 < goal, F.col("c") > 1).select(*rows.columns, "top")
    return placed.select(*kept, "f").toDF(*names, "shard")


def with_slots(rows: DataFrame, group: str, order: list[str], *, rows_per_part: int = 20_000) -> DataFrame:
    """The rows with ``slot``: gapless numbers from 0 in each group, counted in parts so that no group meets in one task."""
    rows = cut(rows.withColumn("place", F.monotonically_increasing_id()))
    parts = max(8, -(-rows.count() // rows_per_part))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order, "place"), F.lit(parts)))
    sizes = rows.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order, "place"))
    numbered = rows.withColumn("number", number)
    return numbered.join(offsets, [group, "part"]).withColumn("slot", (F.col("offset") + F.col("number") - 1).cast("long")).drop("part", "number", "offset", "place")


def shard_documents(docs: DataFrame, *, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in shards of near equal bytes: size (UTF-8 bytes plus 16), text_crc32, shard, slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    code = body.cast("binary")
    numbers = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
    words = {d: F.col(c).cast("string") for d, c in (("d_source", "source"), ("d_lang", "lang"), ("d_id", key)) if c in docs.columns and not (numbers and c == key)}
    ends = docs.agg(*(f(c).alias(f"{d}_{n}") for d, c in words.items() for n, f in (("low", F.min), ("high", F.max)))).first() if words else {}
    # the least and the largest string begin with what all have in common
    shared = {d: len(commonprefix([(ends[f"{d}_{n}"] or "").encode() for n in ("low", "high")])) for d in words}
    dims = {d: text_ordinal(c, shared[d]) for d, c in words.items()} | {"d_size": F.log1p(F.octet_length(code).cast("double"))}
    if numbers:
        dims["d_id"] = F.coalesce(F.col(key).cast("double"), F.lit(-1.0))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(code) + 16).cast("long").alias("size"), F.crc32(code).alias("text_crc32"), *(c.alias(d) for d, c in dims.items()))
    placed = kd_shards(rows, list(dims), "size", F.xxhash64("doc_id", "text_crc32", "size"), shards=shards)
    placed = placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
