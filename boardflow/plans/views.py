"""Blocks, boards, graphs, points and move logs from the provided tables; and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardflow.functions import blocks as B

SIZE = 6
ACTIONS = {"view": "E", "signup": "S", "error": "undo", "click": "W", "purchase": "N"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(board_id, slot, x, y, bw, bh, target, immovable, repr): a block for each line of an order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    bw = (1 + F.pmod(F.floor("l_quantity"), F.lit(3))).cast("int")
    rows = rows.select(
        F.col("l_orderkey").alias("board_id"), F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)").alias("slot"),
        F.pmod("l_partkey", F.lit(SIZE)).cast("int").alias("x"), F.pmod("l_suppkey", F.lit(SIZE)).cast("int").alias("y"), bw.alias("bw"),
        F.when(bw > 1, 1).otherwise((1 + F.pmod("l_linenumber", F.lit(3))).cast("int")).alias("bh"), "l_linenumber",
    )
    target = (F.col("l_linenumber") == 1) & (F.col("bw") == 2)
    rows = rows.withColumn("target", target).withColumn("immovable", (F.pmod("l_linenumber", F.lit(5)) == 0) & ~target).drop("l_linenumber")
    return rows.withColumn("repr", B.pack(F.col("x"), F.col("y"), F.col("bw"), F.col("bh"), F.col("target"), F.col("immovable")))


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board columns: each order's blocks put on a 6 by 6 board in order, those that don't fit or meet another left out."""
    rows = block_rows(spark, sf_dir).where("repr is not null")
    fits = (F.col("x") + F.col("bw") <= SIZE) & (F.col("y") + F.col("bh") <= SIZE)
    tried = rows.where(fits).select("board_id", "slot", "repr", B.mask(F.col("repr"), SIZE).alias("cells"))
    # at most as many as an order has lines
    lists = tried.groupBy("board_id").agg(F.sort_array(F.collect_list(F.struct("slot", "repr", "cells"))).alias("tries"))
    start = F.struct(F.lit(0).cast("long").alias("occ"), F.array().cast("array<int>").alias("blocks"))

    def put(a, t):
        free = (a["occ"].bitwiseAND(t["cells"]) == 0) & (F.size(a["blocks"]) < 15)
        return F.when(free, F.struct(a["occ"].bitwiseOR(t["cells"]).alias("occ"), F.array_append(a["blocks"], t["repr"]).alias("blocks"))).otherwise(a)

    put_down = lists.select("board_id", F.sort_array(F.aggregate("tries", start, put)["blocks"]).alias("blocks"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("board_id"), "o_custkey")
    out = orders.join(put_down, "board_id")
    return out.select(
        "board_id", F.lit(SIZE).alias("w"), F.lit(SIZE).alias("h"), F.pmod("o_custkey", F.lit(5)).cast("int").alias("gx"), F.pmod("board_id", F.lit(6)).cast("int").alias("gy"),
        (F.pmod("o_custkey", F.lit(2)) == 0).alias("restricted"), (F.pmod("board_id", F.lit(3)) != 0).alias("goal"), "blocks",
    )


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): suppliers, as negative numbers, and the parts of all their deliveries."""
    return table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("dst"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.get(e, F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(v) for kv in ACTIONS.items() for v in kv))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    order = "row_number() over (partition by user_id order by ts, event_id)"
    return rows.select(F.col("user_id").alias("session_id"), F.expr(order).cast("long").alias("seq"), names[F.col("event_type")].alias("action"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"))


#: What the event types, with the fraction of their value, do on a board.
PLAYED = (("view", "E"), ("signup", "hint"), ("error", "undo"), ("click", "W"), ("purchase", "S"))


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, action, x, y): events as actions at the cells of a 4 by 4 board; some populate, go far or begin anew."""
    names = F.create_map(*(F.lit(v) for kv in PLAYED for v in kv))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    order = "row_number() over (partition by user_id order by ts, event_id)"
    nth = F.pmod("event_id", F.lit(23))
    action = F.when(nth == 3, "populate").when(nth == 5, "farthest").when(nth == 7, "closest").when(nth == 9, "start").when(nth == 11, "clear").when(nth == 13, "N").otherwise(names[F.col("event_type")])
    return rows.select(F.col("user_id").alias("session_id"), F.expr(order).cast("long").alias("seq"), action.alias("action"), F.pmod("event_id", F.lit(4)).cast("int").alias("x"), F.pmod(F.floor(F.col("event_id") / 4), F.lit(4)).cast("int").alias("y"))


def board_of_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, board columns): a 4 by 4 board with a target to be brought to (2, 0)."""
    user = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id")).distinct()
    kinds = F.array(F.array(F.lit(6), F.lit(512)), F.array(F.lit(6), F.lit(800), F.lit(4097)), F.array(F.lit(0), F.lit(550), F.lit(2048)))
    return user.select("session_id", F.lit(4).alias("w"), F.lit(4).alias("h"), F.lit(2).alias("gx"), F.lit(0).alias("gy"), (F.pmod("session_id", F.lit(2)) == 0).alias("restricted"), F.lit(True).alias("goal"), F.sort_array(F.get(kinds, F.pmod("session_id", F.lit(3)).cast("int"))).alias("blocks"))


SQL_BLOCKS = """
br0 AS (SELECT l_orderkey AS board_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS slot,
  CAST(l_partkey % 6 AS INTEGER) AS x, CAST(l_suppkey % 6 AS INTEGER) AS y, CAST(1 + CAST(floor(l_quantity) AS BIGINT) % 3 AS INTEGER) AS bw, l_linenumber AS n FROM lineitem),
br1 AS (SELECT *, CASE WHEN bw > 1 THEN 1 ELSE CAST(1 + n % 3 AS INTEGER) END AS bh, n = 1 AND bw = 2 AS target FROM br0),
br AS (SELECT board_id, slot, x, y, bw, bh, target, n % 5 = 0 AND NOT target AS immovable,
  CASE WHEN x + bw <= 8 AND y + bh <= 8 THEN y * 2048 + x * 256 + (bh - 1) * 32 + (bw - 1) * 4 + CAST(target AS INTEGER) * 2 + CAST(n % 5 = 0 AND NOT target AS INTEGER) END AS repr FROM br1)"""

_CELLS = "CAST(list_sum(list_transform(range(bh), lambda r: CAST((1 << bw) - 1 AS BIGINT) << CAST((y + r) * 6 + x AS INTEGER))) AS BIGINT)"
SQL_BOARDS = SQL_BLOCKS + f""",
tries AS (SELECT board_id, list({{'occ': c, 'blocks': [repr]}} ORDER BY slot) AS t FROM (SELECT *, {_CELLS} AS c FROM br WHERE repr IS NOT NULL AND x + bw <= 6 AND y + bh <= 6) GROUP BY board_id),
put AS (SELECT board_id, list_sort(list_reduce(t, lambda a, b: CASE WHEN (a.occ & b.occ) = 0 AND len(a.blocks) < 15 THEN {{'occ': a.occ | b.occ, 'blocks': list_concat(a.blocks, b.blocks)}} ELSE a END).blocks) AS blocks FROM tries),
boards AS (SELECT o_orderkey AS board_id, 6 AS w, 6 AS h, CAST(o_custkey % 5 AS INTEGER) AS gx, CAST(o_orderkey % 6 AS INTEGER) AS gy, o_custkey % 2 = 0 AS restricted, o_orderkey % 3 <> 0 AS goal, blocks
  FROM orders JOIN put ON o_orderkey = board_id)"""
#: One row per block of a board, unpacked.
SQL_PIECES = SQL_BOARDS + """,
pieces AS (SELECT board_id, restricted, b, i, (b >> 8) & 7 AS x, (b >> 11) & 7 AS y, ((b >> 2) & 7) + 1 AS bw, ((b >> 5) & 7) + 1 AS bh, ((b >> 1) & 1) = 1 AS t, (b & 1) = 1 AS im,
  gx, gy, goal FROM (SELECT *, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS i FROM boards)),
masks AS (SELECT *, """ + _CELLS + """ AS c, CASE WHEN im THEN 0 WHEN bw > bh THEN 10 WHEN bh > bw THEN 5 ELSE 15 END AS dirs FROM pieces),
occ AS (SELECT board_id, CAST(bit_or(c) AS BIGINT) AS occ, CAST(coalesce(bit_or(c) FILTER (dirs & 10 > 0), 0) AS BIGINT) AS occ_h, CAST(coalesce(bit_or(c) FILTER (dirs & 5 > 0), 0) AS BIGINT) AS occ_v FROM masks GROUP BY board_id)"""
SQL_GRAPH = """
g AS (SELECT -l_suppkey - 1 AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL),
e AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"""
SQL_POINTS = "pt AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
