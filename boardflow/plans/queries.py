"""Queries of the state-space engine over the provided tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardflow.functions import bits
from boardflow.functions import blocks as B
from boardflow.functions import boards as P
from boardflow.operators import display, graph, layout, session, statespace
from boardflow.operators.components import connected_components
from boardflow.plans import views as V

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _text(blocks: Column) -> Column:
    return F.array_join(blocks.cast("array<string>"), ",")


@_query("k_bits", """SELECT l_orderkey, l_linenumber, v, m, v & ~m AS cleared, (v & ~m) | ((9 << f) & m) AS replaced, (v & m) >> f AS got FROM (
  SELECT *, CAST(((1 << k) - 1) << f AS BIGINT) AS m FROM (SELECT l_orderkey, l_linenumber, l_partkey * 100003 + l_suppkey AS v, CAST(l_linenumber % 5 AS INTEGER) AS f, CAST(l_suppkey % 4 AS INTEGER) + 1 AS k FROM lineitem))""")  # fmt: skip
def k_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 100003 + F.col("l_suppkey")).alias("v"), F.pmod("l_linenumber", F.lit(5)).cast("int").alias("f"), F.pmod("l_suppkey", F.lit(4)).cast("int").alias("k"))
    v, first, last = F.col("v"), F.col("f"), F.col("f") + F.col("k")
    return rows.select("l_orderkey", "l_linenumber", "v", bits.create_mask(first, last).alias("m"), bits.clear_bits(v, first, last).alias("cleared"), bits.set_bits(v, first, last, 9).alias("replaced"), bits.get_bits(v, first, last).alias("got"))


@_query("b_blocks", "WITH" + V.SQL_BLOCKS + """ SELECT board_id, CAST(slot AS INTEGER) AS slot, repr, x, y, bw, bh, target, immovable, repr & 255 AS shape,
  CASE WHEN immovable THEN 0 WHEN bw > bh THEN 10 WHEN bh > bw THEN 5 ELSE 15 END AS dirs, x <= 2 AND x + bw > 2 AND y <= 2 AND y + bh > 2 AS at_2_2 FROM br WHERE repr IS NOT NULL""")  # fmt: skip
def b_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("repr")
    rows = V.block_rows(spark, sf_dir).where(b.isNotNull() & B.valid(b))
    return rows.select("board_id", "slot", "repr", B.x_of(b).alias("x"), B.y_of(b).alias("y"), B.width_of(b).alias("bw"), B.height_of(b).alias("bh"), B.is_target(b).alias("target"), B.is_immovable(b).alias("immovable"), B.shape_of(b).alias("shape"), B.principal_dirs(b).alias("dirs"), B.covers(b, 2, 2).alias("at_2_2"))


@_query("b6_collisions", "WITH" + V.SQL_BLOCKS + """ SELECT a.board_id, count(*) AS n FROM br a JOIN br b ON a.board_id = b.board_id AND a.slot < b.slot AND a.repr IS NOT NULL AND b.repr IS NOT NULL
  AND a.x < b.x + b.bw AND b.x < a.x + a.bw AND a.y < b.y + b.bh AND b.y < a.y + a.bh GROUP BY a.board_id""")  # fmt: skip
def b6_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.block_rows(spark, sf_dir).where("repr is not null").select("board_id", "slot", "repr")
    other = rows.select("board_id", F.col("slot").alias("slot2"), F.col("repr").alias("repr2"))
    return rows.join(other, "board_id").where((F.col("slot") < F.col("slot2")) & B.collides(F.col("repr"), F.col("repr2"))).groupBy("board_id").agg(F.count("*").alias("n"))


@_query("p_boards", "WITH" + V.SQL_BOARDS + " SELECT board_id, w, h, gx, gy, restricted, goal, array_to_string(blocks, ',') AS blocks, len(blocks)::INTEGER AS n FROM boards")
def p_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.boards(spark, sf_dir).select("board_id", "w", "h", "gx", "gy", "restricted", "goal", _text(F.col("blocks")).alias("blocks"), F.size("blocks").alias("n"))


_TARGET = "list_filter(blocks, lambda b: (b & 2) > 0)[1]"


@_query("p_checks", "WITH" + V.SQL_BOARDS + f""", q AS (SELECT *, {_TARGET} AS t FROM boards), u AS (SELECT *, (t >> 8) & 7 AS tx, (t >> 11) & 7 AS ty, ((t >> 2) & 7) + 1 AS tw, ((t >> 5) & 7) + 1 AS th FROM q)
  SELECT board_id, t AS target, list_filter(blocks, lambda b: ((b >> 8) & 7) <= 2 AND ((b >> 8) & 7) + ((b >> 2) & 7) >= 2 AND ((b >> 11) & 7) <= 2 AND ((b >> 11) & 7) + ((b >> 5) & 7) >= 2)[1] AS at_2_2,
  coalesce(goal AND tx = gx AND ty = gy, false) AS solved, CASE WHEN goal AND t IS NULL THEN 'Goal Without Target' WHEN NOT goal AND t IS NOT NULL THEN 'Target Without Goal'
  WHEN goal AND restricted AND ((th >= tw AND tx <> gx) OR (tw >= th AND ty <> gy)) THEN 'Goal Unreachable' WHEN goal AND gx > 0 AND gx + tw < w AND gy > 0 AND gy + th < h THEN 'Goal Inside' END AS reason FROM u""")  # fmt: skip
def p_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.boards(spark, sf_dir).select("board_id", P.target_block().alias("target"), P.block_at(2, 2).alias("at_2_2"), P.goal_reached().alias("solved"), P.invalid_reason().alias("reason"))


@_query("p_text_round_trip", "WITH" + V.SQL_BOARDS + """ SELECT board_id, w, h, CASE WHEN goal THEN gx ELSE 0 END AS gx, CASE WHEN goal THEN gy ELSE 0 END AS gy, restricted, goal, array_to_string(blocks, ',') AS blocks,
  'S:[6x6] ' || CASE WHEN goal THEN 'G:[' || gx || ',' || gy || '] ' ELSE '' END || CASE WHEN restricted THEN 'M:[R] ' ELSE 'M:[F] ' END || 'B:[' || array_to_string(list_transform(range(6), lambda y: '{' ||
  array_to_string(list_transform(range(6), lambda x: coalesce(list_transform(list_filter(blocks, lambda b: ((b >> 8) & 7) = x AND ((b >> 11) & 7) = y), lambda b: (((b >> 2) & 7) + 1) || CASE WHEN (b & 2) > 0 THEN 'X' WHEN (b & 1) > 0 THEN '*' ELSE 'x' END || (((b >> 5) & 7) + 1))[1], '_')), ' ') || '}'), ' ') || ']' AS text FROM boards""")  # fmt: skip
def p_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.boards(spark, sf_dir).select("board_id", P.to_text().alias("text")).withColumn("p", P.from_text(F.col("text")))
    return rows.select("board_id", "p.w", "p.h", "p.gx", "p.gy", "p.restricted", "p.goal", _text(F.col("p.blocks")).alias("blocks"), "text")


_AT = "list_filter(blocks, lambda b: ((b >> 8) & 7) <= 2 AND ((b >> 8) & 7) + ((b >> 2) & 7) >= 2 AND ((b >> 11) & 7) <= 2 AND ((b >> 11) & 7) + ((b >> 5) & 7) >= 2)[1]"


@_query("p_edits", "WITH" + V.SQL_BOARDS + f""", q AS (SELECT *, {_AT} AS a, {_TARGET} AS t FROM boards) SELECT board_id,
  CASE WHEN a IS NOT NULL THEN array_to_string(list_filter(blocks, lambda b: b <> a), ',') END AS removed,
  CASE WHEN a IS NOT NULL AND (a & 1) = 0 THEN array_to_string(list_sort(list_transform(blocks, lambda b: CASE WHEN b = a THEN xor(b, 2) ELSE b & ~2 END)), ',') END AS retargeted,
  CASE WHEN a IS NULL OR (a & 1) = 1 THEN 'null,null' WHEN gx + ((a >> 2) & 7) + 1 <= 6 AND gy + ((a >> 5) & 7) + 1 <= 6 THEN gx || ',' || gy ELSE '0,0' END AS goal_then,
  CASE WHEN a IS NOT NULL AND (a & 2) = 0 THEN array_to_string(list_sort(list_transform(blocks, lambda b: CASE WHEN b = a THEN xor(b, 1) ELSE b END)), ',') END AS rewalled,
  CASE WHEN t IS NULL OR 1 + ((t >> 2) & 7) + 1 > 6 OR 3 + ((t >> 5) & 7) + 1 > 6 THEN NULL WHEN gx = 1 AND gy = 3 THEN 'cleared' ELSE '1,3' END AS goal_1_3,
  array_to_string(list_filter(blocks, lambda b: ((b >> 8) & 7) + ((b >> 2) & 7) + 1 <= 5), ',') AS narrower,
  CASE WHEN NOT list_contains(list_transform(blocks, lambda b: ((b >> 8) & 7) <= 5 AND ((b >> 8) & 7) + ((b >> 2) & 7) >= 5 AND ((b >> 11) & 7) <= 5 AND ((b >> 11) & 7) + ((b >> 5) & 7) >= 5), true) AND len(blocks) < 15
    THEN array_to_string(list_sort(list_append(blocks, 11520)), ',') END AS added FROM q""")  # fmt: skip
def p_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    goal = P.set_goal(1, 3)
    return V.boards(spark, sf_dir).select(
        "board_id", _text(P.remove_block(2, 2)).alias("removed"), _text(P.toggle_target(2, 2)["blocks"]).alias("retargeted"), F.format_string("%d,%d", P.toggle_target(2, 2)["gx"], P.toggle_target(2, 2)["gy"]).alias("goal_then"), _text(P.toggle_wall(2, 2)).alias("rewalled"),
        F.when(goal.isNotNull(), F.when(goal["goal"], F.format_string("%d,%d", goal["gx"], goal["gy"])).otherwise("cleared")).alias("goal_1_3"),
        _text(P.resized(-1, 0)["blocks"]).alias("narrower"), _text(P.add_block(F.lit(5 * 2048 + 5 * 256))).alias("added"),
    )


@_query("m_bitmaps", "WITH" + V.SQL_PIECES + """ SELECT board_id, occ, occ_h, occ_v, occ = 68719476735 AS is_full, occ = 0 AS is_empty,
  CAST(list_filter(range(36), lambda i: (occ >> CAST(i AS INTEGER)) & 1 = 0)[1] AS INTEGER) AS first_empty FROM occ""")  # fmt: skip
def m_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.boards(spark, sf_dir).withColumn("occ", P.occupied())
    return rows.select("board_id", "occ", P.occupied_by(B.EAST | B.WEST).alias("occ_h"), P.occupied_by(B.NORTH | B.SOUTH).alias("occ_v"), P.is_full(F.col("occ")).alias("is_full"), P.is_empty(F.col("occ")).alias("is_empty"), P.first_empty(F.col("occ")).alias("first_empty"))


_STEPS = V.SQL_PIECES + """,
d AS (SELECT * FROM (VALUES (1, 0, -1, -2048), (2, 1, 0, 256), (4, 0, 1, 2048), (8, -1, 0, -256)) v(dir, dx, dy, change)),
step AS (SELECT m.board_id, CAST(i AS INTEGER) AS idx, dir, b, b + change AS moved FROM masks m JOIN occ USING (board_id) CROSS JOIN d
  WHERE NOT im AND (NOT restricted OR dirs & dir > 0) AND x + dx >= 0 AND y + dy >= 0 AND x + dx + bw <= 6 AND y + dy + bh <= 6
  AND (occ & ~c) & CAST(list_sum(list_transform(range(bh), lambda r: CAST((1 << bw) - 1 AS BIGINT) << CAST(greatest(0, (y + dy + r) * 6 + x + dx) AS INTEGER))) AS BIGINT) = 0),
nxt AS (SELECT step.*, array_to_string(list_sort(list_append(list_filter(blocks, lambda v: v <> b), moved)), ',') AS next FROM step JOIN boards USING (board_id))"""


@_query("v4_moves", "WITH" + _STEPS + " SELECT board_id, idx, dir, next FROM nxt")
def v4_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statespace.successors(V.boards(spark, sf_dir).select(*statespace.BOARD, "blocks")).select("board_id", "idx", "dir", _text(F.col("next")).alias("next"))


@_query("v1_move_at", "WITH" + _STEPS + f""" SELECT boards.board_id, n.next FROM boards LEFT JOIN (SELECT nxt.board_id, nxt.next FROM nxt JOIN boards USING (board_id) WHERE dir = 2 AND b = {_AT}) n ON n.board_id = boards.board_id""")
def v1_move_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.boards(spark, sf_dir).select("board_id", _text(P.move_at(2, 2, B.EAST)).alias("next"))


def _flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per board: blocks, cells taken, and legal moves."""
    rows = V.boards(spark, sf_dir)
    return rows.select("board_id", F.size("blocks").alias("n_blocks"), P.occupied().alias("occ"), P.move_count().alias("n_moves"))


flagship = _query("v4_move_counts", "WITH" + _STEPS + " SELECT boards.board_id, CAST(len(blocks) AS INTEGER) AS n_blocks, occ, CAST(coalesce(n, 0) AS INTEGER) AS n_moves FROM boards JOIN occ USING (board_id) LEFT JOIN (SELECT board_id, count(*) AS n FROM step GROUP BY board_id) k USING (board_id)")(_flag)

#: Small boards on 4 by 4: (board_id, restricted, blocks)
SMALL = ((1, True, (4, 800)), (2, False, (0, 548, 2048)), (3, False, (0, 800, 2305)), (4, True, (0,)))


def _small(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, 4, 4, 2, 0, r, False, list(b)) for i, r, b in SMALL], "board_id long, w int, h int, gx int, gy int, restricted boolean, goal boolean, blocks array<int>")
    return rows.withColumn("blocks", F.array_sort("blocks"))


def _steps(source: str, w: int, h: int, more: str = "", where: str = "true") -> str:
    """Board_id, restricted, blocks and ``more`` after every legal step of the boards in ``source``."""
    cell = f"CAST(list_sum(list_transform(range(((v >> 5) & 7) + 1), lambda r: ((1 << (((v >> 2) & 7) + 1)) - 1) << CAST((((v >> 11) & 7) + r) * {w} + ((v >> 8) & 7) AS INTEGER))) AS BIGINT)"
    return f"""SELECT board_id, restricted, list_sort(list_append(list_filter(blocks, lambda v: v <> b), b + change)) AS blocks{more} FROM (SELECT *, unnest(blocks) AS b FROM {source} WHERE {where}) t
  CROSS JOIN (VALUES (1, 0, -1, -2048), (2, 1, 0, 256), (4, 0, 1, 2048), (8, -1, 0, -256)) v(dir, dx, dy, change)
  WHERE (b & 1) = 0 AND (NOT restricted OR (CASE WHEN (b >> 2) & 7 > (b >> 5) & 7 THEN 10 WHEN (b >> 5) & 7 > (b >> 2) & 7 THEN 5 ELSE 15 END) & dir > 0)
  AND ((b >> 8) & 7) + dx >= 0 AND ((b >> 11) & 7) + dy >= 0 AND ((b >> 8) & 7) + dx + ((b >> 2) & 7) + 1 <= {w} AND ((b >> 11) & 7) + dy + ((b >> 5) & 7) + 1 <= {h}
  AND (list_sum(list_transform(list_filter(blocks, lambda v: v <> b), lambda v: {cell}))::BIGINT IS NULL
    OR (list_sum(list_transform(list_filter(blocks, lambda v: v <> b), lambda v: {cell}))::BIGINT & list_transform([b + change], lambda v: {cell})[1]) = 0)"""


def _start(boards: tuple) -> str:
    rows = ", ".join(f"({i}, {str(r).lower()}, {sorted(b)})" for i, r, b in boards)
    return f"SELECT * FROM (VALUES {rows}) v(board_id, restricted, blocks)"


def _closure(boards: tuple = SMALL) -> str:
    return f"WITH RECURSIVE s AS ({_start(boards)} UNION {_steps('s', 4, 4)})"


@_query("g1_explore", _closure() + " SELECT CAST(board_id AS BIGINT) AS board_id, array_to_string(blocks, ',') AS blocks FROM s")
def g1_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, _ = statespace.explore(_small(spark))
    return states.select("board_id", _text(F.col("blocks")).alias("blocks"))


@_query("g1_links", _closure() + f" SELECT CAST(s.board_id AS BIGINT) AS board_id, array_to_string(was, ',') AS src, array_to_string(t.blocks, ',') AS dst FROM ({_steps('(SELECT *, blocks AS was FROM s)', 4, 4, ', was')}) t JOIN s ON s.board_id = t.board_id AND s.blocks = t.blocks")
def g1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, links = statespace.explore(_small(spark))
    text = states.select("board_id", "state_key", _text(F.col("blocks")).alias("t"))
    ends = links.join(text.toDF("board_id", "src", "a"), ["board_id", "src"]).join(text.toDF("board_id", "dst", "b"), ["board_id", "dst"])
    return ends.select("board_id", F.col("a").alias("src"), F.col("b").alias("dst"))


#: 4 by 4 boards with a target, whose goal is at (2, 0)
GOALS = ((1, True, (6, 800)), (2, False, (0, 550, 2048)), (3, False, (6, 801, 2305)), (4, True, (6, 545)))
_WON = "list_filter(blocks, lambda b: (b & 2) > 0)[1]"


def _goals(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, 4, 4, 2, 0, r, True, sorted(b)) for i, r, b in GOALS], "board_id long, w int, h int, gx int, gy int, restricted boolean, goal boolean, blocks array<int>")
    return rows


_SOLVED = f"""{_closure(GOALS)},
w AS (SELECT *, ({_WON} >> 8) & 7 = 2 AND ({_WON} >> 11) & 7 = 0 AS won FROM s),
d AS (SELECT board_id, restricted, blocks, 0 AS d FROM w WHERE won UNION {_steps('d', 4, 4, ', d + 1 AS d', 'd < 24')}),
m AS (SELECT board_id, blocks, min(d) AS distance FROM d GROUP BY board_id, blocks)"""


@_query("n8_populate", f"""{_SOLVED}, l AS (SELECT board_id, count(*) AS n FROM ({_steps('s', 4, 4)}) t GROUP BY board_id)
  SELECT CAST(w.board_id AS BIGINT) AS board_id, count(*) AS states, count(*) FILTER (won) AS winning, coalesce(any_value(l.n), 0) AS transitions,
  CAST(coalesce(max(m.distance) FILTER (w.blocks = f.blocks), 0) AS INTEGER) AS moves_to_solution FROM w JOIN ({_start(GOALS)}) f USING (board_id) LEFT JOIN m ON m.board_id = w.board_id AND m.blocks = w.blocks LEFT JOIN l ON l.board_id = w.board_id GROUP BY w.board_id""")  # fmt: skip
def n8_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statespace.populate(_goals(spark)).stats()


@_query("n8_distances", f"{_SOLVED} SELECT CAST(w.board_id AS BIGINT) AS board_id, array_to_string(w.blocks, ',') AS blocks, CAST(distance AS INTEGER) AS distance FROM w LEFT JOIN m ON m.board_id = w.board_id AND m.blocks = w.blocks")
def n8_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statespace.explore(_goals(spark))[0]
    return statespace.solve(found).select("board_id", "state_key", "distance").join(found.select("board_id", "state_key", _text(F.col("blocks")).alias("blocks")), ["board_id", "state_key"]).select("board_id", "blocks", "distance")


KLOTSKI = "S:[4x5] G:[1,3] M:[F] B:[{1x2 2X2 _ 1x2} {_ _ _ _} {1x2 2x1 _ 1x2} {_ 1x1 1x1 _} {1x1 _ _ 1x1}]"


@_query("n8_klotski", f"""WITH RECURSIVE s AS (SELECT 0 AS board_id, false AS restricted, [32, 294, 800, 4128, 4356, 4896, 6400, 6656, 8192, 8960] AS blocks UNION {_steps('s', 4, 5)})
  SELECT CAST(0 AS BIGINT) AS board_id, (SELECT count(*) FROM s) AS states, (SELECT count(*) FROM s WHERE list_contains(blocks, 6438)) AS winning, (SELECT count(*) FROM ({_steps('s', 4, 5)}) t) AS transitions""")  # fmt: skip
def n8_klotski(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph of one deep puzzle."""
    board = spark.range(1).select(F.col("id").alias("board_id"), P.from_text(F.lit(KLOTSKI)).alias("b")).select("board_id", "b.*")
    return statespace.populate(board).stats().drop("moves_to_solution")


@_query("g3_block_sets", "SELECT CAST(a AS INTEGER) AS n11, CAST(b AS INTEGER) AS n12, CAST(c AS INTEGER) AS n21 FROM range(6) x(a), range(6) y(b), range(6) z(c) WHERE a + b + c BETWEEN 1 AND 5 AND a + 2 * b + 2 * c <= 16")
def g3_block_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statespace.block_sets(statespace.KLOTSKI, 5, spark).select(*(F.get("counts", F.lit(i)).alias(n) for i, n in enumerate(("n11", "n12", "n21"))))


def _places(shapes: tuple, w: int, h: int) -> str:
    rows = [(y * 2048 + x * 256 + (bh - 1) * 32 + (bw - 1) * 4, sum(((1 << bw) - 1) << ((y + r) * w + x) for r in range(bh))) for bw, bh in shapes for y in range(h - bh + 1) for x in range(w - bw + 1)]
    return ", ".join(f"({b}, {m})" for b, m in rows)


_R = statespace.RUSH_HOUR


@_query("g5_placements", f"""WITH p AS (SELECT * FROM (VALUES {_places(_R.shapes, 6, 6)}) v(b, m)), t AS (SELECT 4096 + x * 256 + 4 + 2 AS t, CAST(3 << CAST(12 + x AS INTEGER) AS BIGINT) AS m FROM range(5) r(x)),
  one AS (SELECT t, p.b AS b, t.m | p.m AS m FROM t JOIN p ON t.m & p.m = 0), two AS (SELECT t, one.b AS b, p.b AS c FROM one JOIN p ON p.b > one.b AND one.m & p.m = 0)
  SELECT array_to_string(list_sort([CAST(t AS BIGINT)]), ',') AS blocks FROM t UNION ALL SELECT array_to_string(list_sort([CAST(t AS BIGINT), b]), ',') FROM one UNION ALL SELECT array_to_string(list_sort([CAST(t AS BIGINT), b, c]), ',') FROM two""")  # fmt: skip
def g5_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statespace.placements(statespace.initial_boards(_R, spark), _R.shapes, 6, 6, 2).select(_text(F.col("blocks")).alias("blocks"))


@_query("g6_klotski_space")
def g6_klotski_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statespace.puzzle_space(statespace.KLOTSKI, 4, 0, spark)


@_query("g6_rush_hour_space")
def g6_rush_hour_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statespace.puzzle_space(_R, 4, 10, spark)


_CLUSTERS = f"""WITH RECURSIVE p AS (SELECT * FROM (VALUES {_places(_R.shapes, 6, 6)}) v(b, m)), t AS (SELECT 4096 + x * 256 + 4 + 2 AS t, CAST(3 << CAST(12 + x AS INTEGER) AS BIGINT) AS m FROM range(5) r(x)),
  s AS (SELECT row_number() OVER () AS board_id, true AS restricted, blocks FROM (SELECT [CAST(t AS BIGINT)] AS blocks FROM t UNION ALL SELECT list_sort([CAST(t AS BIGINT), p.b]) FROM t JOIN p ON t.m & p.m = 0)),
  l AS (SELECT x.board_id AS a, y.board_id AS b FROM ({_steps('s', 6, 6)}) x JOIN s y ON x.blocks = y.blocks),
  r AS (SELECT board_id AS a, board_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT r.a AS board_id, list_reverse(min(list_reverse(s.blocks))) AS cluster FROM r JOIN s ON s.board_id = r.b GROUP BY r.a),
  w AS (SELECT *, list_contains(blocks, 5126) AS won FROM s),
  d AS (SELECT board_id, 0 AS d FROM w WHERE won UNION SELECT l.b, d + 1 FROM d JOIN l ON l.a = d.board_id WHERE d < 20),
  m AS (SELECT board_id, min(d) AS distance FROM d GROUP BY board_id)
  SELECT array_to_string(cluster, ',') AS cluster, count(*) AS n_states, bool_or(won) AS winnable, CAST(coalesce(max(distance), 0) AS INTEGER) AS max_moves FROM c JOIN w USING (board_id) LEFT JOIN m USING (board_id) GROUP BY cluster"""


@_query("g2_clusters", _CLUSTERS)
def g2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters of the smallest space: the target and one block at most."""
    states = statespace.space_states(_R, 2, spark)
    found = statespace.clusters(states).join(states.select(F.col("state_key").alias("cluster_id"), _text(F.col("blocks")).alias("cluster")), "cluster_id")
    return found.select("cluster", "n_states", "winnable", "max_moves")


_DIST = "WITH RECURSIVE" + V.SQL_GRAPH + """,
m(id, distance) USING KEY (id) AS (SELECT DISTINCT src, 0 FROM e WHERE src < 0 AND src % 50 = 0 UNION
  (SELECT e.dst, min(m.distance) + 1 FROM m JOIN e ON e.src = m.id LEFT JOIN recurring.m AS old ON old.id = e.dst WHERE old.id IS NULL GROUP BY e.dst)),
n AS (SELECT id, distance, id AS nearest FROM m WHERE distance = 0 UNION SELECT m.id, m.distance, n.nearest FROM n JOIN e ON e.src = n.id JOIN m ON m.id = e.dst AND m.distance = n.distance + 1),
near AS (SELECT id, distance, min(nearest) AS nearest FROM n GROUP BY id, distance),
par AS (SELECT a.id, min(b.id) AS parent FROM near a JOIN e ON e.src = a.id JOIN near b ON b.id = e.dst AND b.distance = a.distance - 1 AND b.nearest = a.nearest GROUP BY a.id)"""


def _distances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """From all suppliers and parts to the suppliers of every fiftieth number."""
    links = V.graph(spark, sf_dir)
    return links, graph.distances(links, links.select("src").where("src % 50 = 0").distinct())


@_query("d1_distances", _DIST + " SELECT near.id, CAST(distance AS INTEGER) AS distance, parent, nearest FROM near LEFT JOIN par USING (id)")
def d1_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir)[1]


@_query("d2_paths", _DIST + """, t AS (SELECT near.id, parent FROM near LEFT JOIN par USING (id)), q AS (SELECT id AS start, 0 AS step, id, parent FROM t WHERE id >= 0 AND id % 100 = 0
  UNION ALL SELECT start, step + 1, t.id, t.parent FROM q JOIN t ON t.id = q.parent) SELECT start, CAST(step AS INTEGER) AS step, id FROM q""")  # fmt: skip
def d2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, found = _distances(spark, sf_dir)
    return graph.path(found, links.select("dst").where("dst % 100 = 0").distinct())


@_query("d6_members", _DIST + """, t AS (SELECT near.id, parent FROM near LEFT JOIN par USING (id)), q AS (SELECT id, parent FROM t WHERE id >= 0 AND id % 100 = 0 UNION SELECT t.id, t.parent FROM q JOIN t ON t.id = q.parent) SELECT id FROM q""")
def d6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.members(d2_paths(spark, sf_dir))


@_query("n6_most_distant", _DIST + " SELECT id, CAST(distance AS INTEGER) AS distance FROM near ORDER BY distance DESC, id LIMIT 1")
def n6_most_distant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.most_distant(_distances(spark, sf_dir)[1]).where("id is not null")


@_query("d_components", "WITH RECURSIVE" + V.SQL_GRAPH + """, c(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM e UNION
  (SELECT e.dst, min(c.component) FROM c JOIN e ON e.src = c.node JOIN recurring.c AS old ON old.node = e.dst WHERE c.component < old.component GROUP BY e.dst)) SELECT node, component FROM c""")  # fmt: skip
def d_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(V.graph(spark, sf_dir))


_LOG = """l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 3 WHEN 'click' THEN -1 WHEN 'purchase' THEN -3 ELSE 0 END AS go FROM events),
  f AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, 4 AS pos, CAST([] AS INTEGER[]) AS hist, [0, 0, 0, 0, 1, 0, 0, 0, 0] AS seen, 0 AS total FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT user_id, seq, nxt, CASE WHEN NOT acts THEN hist WHEN go = 0 THEN hist[1:len(hist) - 1] ELSE list_append(hist, pos) END,
    CASE WHEN acts THEN list_transform(range(9), lambda i: seen[i + 1] + CASE WHEN i = nxt THEN 1 ELSE 0 END) ELSE seen END, total + CASE WHEN acts THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN NOT acts THEN pos WHEN go = 0 THEN hist[len(hist)] ELSE pos + go END AS nxt FROM (SELECT f.user_id, l.seq, pos, hist, seen, total, go,
    CASE go WHEN 0 THEN len(hist) > 0 WHEN 1 THEN pos % 3 < 2 WHEN -1 THEN pos % 3 > 0 WHEN 3 THEN pos < 6 ELSE pos > 2 END AS acts FROM f JOIN l ON l.user_id = f.user_id AND l.seq = f.seq + 1)))"""


@_query("n_sessions", f"WITH RECURSIVE {_LOG} SELECT user_id AS session_id, seq, CAST(pos AS INTEGER) AS cell, CAST(seen[pos + 1] AS INTEGER) AS visits, CAST(total AS INTEGER) AS total_moves, CAST(len(hist) AS INTEGER) AS history, CAST(len(list_filter(seen, lambda v: v > 0)) AS INTEGER) AS states FROM f WHERE seq > 0")
def n_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves and undos of a lone block on a 3 by 3 board."""
    log = V.log(spark, sf_dir)
    b = F.get("blocks", F.lit(0))
    return session.replay(log, session.lone_block(log)).select("session_id", "seq", (B.y_of(b) * 3 + B.x_of(b)).alias("cell"), "visits", "total_moves", "history", "states")


@_query("n_boards")
def n_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of action on boards with a target; no SQL, tested against a plain model."""
    return session.replay(V.played(spark, sf_dir), V.board_of_player(spark, sf_dir)).withColumn("blocks", _text(F.col("blocks")))


@_query("n12_visits", f"""WITH RECURSIVE {_LOG}, v AS (SELECT user_id, pos, count(*) AS n FROM f GROUP BY user_id, pos)
  SELECT u.user_id AS session_id, CAST(c.cell AS INTEGER) AS cell, CAST(coalesce(v.n, 0) AS BIGINT) AS visits FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(9) c(cell) LEFT JOIN v ON v.user_id = u.user_id AND v.pos = c.cell""")  # fmt: skip
def n12_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After which actions, and at the start, each cell was the block's: 0 for those it never was at."""
    log = V.log(spark, sf_dir)
    boards = session.lone_block(log)
    b = F.get("blocks", F.lit(0))
    cell = (B.y_of(b) * 3 + B.x_of(b)).cast("string").alias("state_key")
    at = session.replay(log, boards).select("session_id", cell).unionByName(boards.select("session_id", cell))
    every = boards.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("cell")).select("session_id", F.col("cell").cast("string").alias("state_key"))
    return session.visit_counts(at, every).select("session_id", F.col("state_key").cast("int").alias("cell"), "visits")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.points(spark, sf_dir).select(F.col("id").alias("src"), F.expr("(id * 7 + 1) % 400").alias("dst"))



@_query("l4_springs", "WITH " + V.SQL_POINTS + """, l AS (SELECT id AS src, (id * 7 + 1) % 400 AS dst FROM pt), f AS (SELECT src, dst, a.x - b.x AS x, a.y - b.y AS y, a.z - b.z AS z FROM l JOIN pt a ON a.id = src JOIN pt b ON b.id = dst),
  k AS (SELECT *, CASE WHEN x * x + y * y + z * z > 0 THEN -4.0 * (sqrt(x * x + y * y + z * z) - 3.0) / sqrt(x * x + y * y + z * z) ELSE 0 END AS p FROM f),
  u AS (SELECT src AS id, x * p AS fx, y * p AS fy, z * p AS fz FROM k UNION ALL SELECT dst, -x * p, -y * p, -z * p FROM k) SELECT id, round(sum(fx), 6) + 0.0 AS fx, round(sum(fy), 6) + 0.0 AS fy, round(sum(fz), 6) + 0.0 AS fz FROM u GROUP BY id""")  # fmt: skip
def l4_springs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.spring_forces(V.points(spark, sf_dir), _edges(spark, sf_dir))
    return found.select("id", *((F.round(f"f{c}", 6) + 0.0).alias(f"f{c}") for c in "xyz"))


@_query("l10_exact_repulsion", "WITH " + V.SQL_POINTS + """, p AS (SELECT a.id, a.x - b.x AS x, a.y - b.y AS y, a.z - b.z AS z FROM pt a JOIN pt b ON a.id <> b.id), q AS (SELECT *, x * x + y * y + z * z + 0.05 AS r FROM p)
  SELECT id, round(sum(x * 2.5 / r / sqrt(r)), 4) + 0.0 AS fx, round(sum(y * 2.5 / r / sqrt(r)), 4) + 0.0 AS fy, round(sum(z * 2.5 / r / sqrt(r)), 4) + 0.0 AS fz FROM q GROUP BY id""")  # fmt: skip
def l10_exact_repulsion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With theta 0 every cell is opened, and the sum is exact."""
    found = layout.repulsion(V.points(spark, sf_dir), layout.Config(theta=0.0))
    return found.select("id", *((F.round(f"f{c}", 4) + 0.0).alias(f"f{c}") for c in "xyz"))


@_query("l11_barnes_hut", "WITH RECURSIVE " + V.SQL_POINTS + """, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM pt),
  q AS (SELECT pt.*, CAST(least(floor((x - lx) / e * 2097151), 2097151) AS BIGINT) AS i, CAST(least(floor((y - ly) / e * 2097151), 2097151) AS BIGINT) AS j, CAST(least(floor((z - lz) / e * 2097151), 2097151) AS BIGINT) AS k FROM pt, b),
  m AS (SELECT id, x, y, z, CAST(list_sum(list_transform(range(21), lambda s: (((i >> CAST(s AS INTEGER)) & 1) | (((j >> CAST(s AS INTEGER)) & 1) << 1) | (((k >> CAST(s AS INTEGER)) & 1) << 2)) << CAST(3 * s AS INTEGER))) AS BIGINT) AS code FROM q),
  c AS (SELECT CAST(d AS INTEGER) AS depth, code >> CAST(3 * (21 - d) AS INTEGER) AS cell, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM m CROSS JOIN range(22) r(d) GROUP BY 1, 2),
  w AS (SELECT m.*, depth, cell, n, cx, cy, cz FROM m JOIN c ON depth = 0
    UNION ALL SELECT w.id, w.x, w.y, w.z, w.code, c.depth, c.cell, c.n, c.cx, c.cy, c.cz FROM w JOIN c ON c.depth = w.depth + 1 AND c.cell >> 3 = w.cell CROSS JOIN b
    WHERE w.n > 1 AND w.depth < 21 AND (w.code >> CAST(3 * (21 - w.depth) AS INTEGER) = w.cell OR (e / pow(2.0, w.depth)) * (e / pow(2.0, w.depth)) / ((w.x - w.cx) * (w.x - w.cx) + (w.y - w.cy) * (w.y - w.cy) + (w.z - w.cz) * (w.z - w.cz) + 0.05) >= 1)),
  o AS (SELECT w.*, code >> CAST(3 * (21 - depth) AS INTEGER) = cell AS own, n = 1 OR depth = 21 AS leaf, (e / pow(2.0, depth)) * (e / pow(2.0, depth)) / ((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) + 0.05) < 1 AS far FROM w, b),
  t AS (SELECT id, n - own::INT AS h, CASE WHEN own THEN x - (n * cx - x) / (n - 1) ELSE x - cx END AS x, CASE WHEN own THEN y - (n * cy - y) / (n - 1) ELSE y - cy END AS y, CASE WHEN own THEN z - (n * cz - z) / (n - 1) ELSE z - cz END AS z
    FROM o WHERE NOT (own AND n = 1) AND (leaf OR (far AND NOT own))),
  f AS (SELECT *, x * x + y * y + z * z + 0.05 AS r FROM t)
  SELECT m.id, round(coalesce(sum(f.x * 2.5 * h / r / sqrt(r)), 0), 6) + 0.0 AS fx, round(coalesce(sum(f.y * 2.5 * h / r / sqrt(r)), 0), 6) + 0.0 AS fy, round(coalesce(sum(f.z * 2.5 * h / r / sqrt(r)), 0), 6) + 0.0 AS fz FROM m LEFT JOIN f ON f.id = m.id GROUP BY m.id""")  # fmt: skip
def l11_barnes_hut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.repulsion(V.points(spark, sf_dir))
    return found.select("id", *((F.round(f"f{c}", 6) + 0.0).alias(f"f{c}") for c in "xyz"))


@_query("l7_morton", "WITH " + V.SQL_POINTS + """, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM pt),
  q AS (SELECT id, CAST(least(floor((x - lx) / e * 2097151), 2097151) AS BIGINT) AS x, CAST(least(floor((y - ly) / e * 2097151), 2097151) AS BIGINT) AS y, CAST(least(floor((z - lz) / e * 2097151), 2097151) AS BIGINT) AS z FROM pt, b)
  SELECT id, CAST(list_sum(list_transform(range(21), lambda i: (((x >> CAST(i AS INTEGER)) & 1) | (((y >> CAST(i AS INTEGER)) & 1) << 1) | (((z >> CAST(i AS INTEGER)) & 1) << 2)) << CAST(3 * i AS INTEGER))) AS BIGINT) AS code FROM q""")  # fmt: skip
def l7_morton(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = V.points(spark, sf_dir)
    return layout.morton(at, layout.bounds(at)).select("id", "code")


@_query("l6_cells", "WITH " + V.SQL_POINTS + """, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM pt),
  q AS (SELECT pt.*, CAST(least(floor((x - lx) / e * 2097151), 2097151) AS BIGINT) AS i, CAST(least(floor((y - ly) / e * 2097151), 2097151) AS BIGINT) AS j, CAST(least(floor((z - lz) / e * 2097151), 2097151) AS BIGINT) AS k FROM pt, b),
  m AS (SELECT x, y, z, CAST(list_sum(list_transform(range(21), lambda s: (((i >> CAST(s AS INTEGER)) & 1) | (((j >> CAST(s AS INTEGER)) & 1) << 1) | (((k >> CAST(s AS INTEGER)) & 1) << 2)) << CAST(3 * s AS INTEGER))) AS BIGINT) AS code FROM q)
  SELECT CAST(d AS INTEGER) AS depth, code >> CAST(3 * (21 - d) AS INTEGER) AS code, count(*) AS n, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, round(avg(z), 6) + 0.0 AS cz FROM m CROSS JOIN range(22) r(d) GROUP BY 1, 2""")  # fmt: skip
def l6_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = V.points(spark, sf_dir)
    found = layout.cells(layout.morton(at, layout.bounds(at)))
    return found.select("depth", "code", "n", *((F.round(f"c{c}", 6) + 0.0).alias(f"c{c}") for c in "xyz"))


@_query("l12_verlet", "WITH " + V.SQL_POINTS + " SELECT id, round(x + x * 0.1 * 0.9 + y * (4.0 / 90) * (4.0 / 90), 6) AS x, round(y + y * 0.1 * 0.9 + z * (4.0 / 90) * (4.0 / 90), 6) AS y, round(z + z * 0.1 * 0.9 + x * (4.0 / 90) * (4.0 / 90), 6) AS z FROM pt")
def l12_verlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = V.points(spark, sf_dir)
    old = at.select("*", *((F.col(c) * 0.9).alias(f"p{c}") for c in "xyz"))
    forces = at.select("id", F.col("y").alias("fx"), F.col("z").alias("fy"), F.col("x").alias("fz"))
    return layout.verlet(old, forces).select("id", *(F.round(c, 6).alias(c) for c in "xyz"))


@_query("l14_centered", "WITH " + V.SQL_POINTS + " SELECT id, round(x - avg(x) OVER (), 6) + 0.0 AS x, round(y - avg(y) OVER (), 6) + 0.0 AS y, round(z - avg(z) OVER (), 6) + 0.0 AS z FROM pt")
def l14_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.centered(V.points(spark, sf_dir)).select("id", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


@_query("r1_segments", "WITH " + V.SQL_POINTS + " SELECT a.id AS src, b.id AS dst, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1 FROM pt a JOIN pt b ON b.id = (a.id * 7 + 1) % 400")
def r1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.segments(_edges(spark, sf_dir), V.points(spark, sf_dir))


@_query("r3_pick", "WITH " + V.SQL_POINTS + " SELECT min(id) AS id FROM pt WHERE abs(x) <= 0.05 AND abs(y) <= 0.05 AND z + 0.05 >= -1")
def r3_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.picked(V.points(spark, sf_dir), (0.0, 0.0, -1.0), (0.0, 0.0, 1.0), 0.1)


@_query("r5_ramp", _DIST + ", x AS (SELECT id, distance, max(distance) OVER () AS far FROM near) SELECT id, CAST(floor((1 - (1.0::DOUBLE - distance / far)) * 200 + (1.0::DOUBLE - distance / far) * 40) AS INTEGER) AS red, CAST(floor((1.0::DOUBLE - distance / far) * 250) AS INTEGER) AS green FROM x")
def r5_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _distances(spark, sf_dir)[1]
    longest = found.agg(F.max("distance").alias("far"))
    colour = display.ramp(F.col("distance"), F.col("far"), (200, 0, 0), (40, 250, 0))
    return found.join(F.broadcast(longest)).select("id", F.get(colour, F.lit(0)).alias("red"), F.get(colour, F.lit(1)).alias("green"))


@_query("r4_classes", _DIST + """, x AS (SELECT id, distance, id % 9 = 0 AS path, id = 1 AS start, id % 11 = 0 AS seen FROM near)
  SELECT id, CASE WHEN id = 5 THEN 'picked' WHEN distance = 0 THEN 'winning' WHEN path THEN 'path' WHEN start THEN 'start' WHEN seen THEN 'visited' ELSE 'distance' END AS class FROM x""")  # fmt: skip
def r4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("distance")
    rows = _distances(spark, sf_dir)[1]
    i = F.col("id")
    return rows.select("id", display.vertex_class(d == 0, i % 9 == 0, i == 1, i % 11 == 0, i == 5, d).alias("class"))


@_query("r7_visits", "SELECT user_id AS session_id, n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS visit FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def r7_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.log(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", display.ordinal(F.col("n")).alias("visit"))


@_query("r6_stats", "WITH" + _STEPS + ", s AS (SELECT board_id FROM pieces WHERE t AND goal AND x = gx AND y = gy AND b = (SELECT min(q.b) FROM pieces q WHERE q.board_id = pieces.board_id AND q.t)) SELECT (SELECT count(*) FROM boards) AS states, (SELECT count(DISTINCT board_id) FROM s) AS winning, (SELECT count(*) FROM step) AS transitions")
def r6_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.boards(spark, sf_dir).select(P.goal_reached().alias("won"), P.move_count().alias("n"))
    return rows.agg(F.count("*").alias("states"), F.count(F.when(F.col("won"), 1)).alias("winning"), F.sum("n").alias("transitions"))


@_query("s7_upper_bounds", "WITH RECURSIVE r AS (SELECT k, 1 AS i, CAST(k AS BIGINT) AS c, CAST(k AS BIGINT) AS total FROM range(1, 6) t(k) UNION ALL SELECT k, i + 1, c * (k + i) // (i + 1), total + c * (k + i) // (i + 1) FROM r WHERE i < 8) SELECT k AS shapes, i AS max_blocks, total AS bound FROM r")
def s7_upper_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multisets of 1 to max_blocks of the shapes: a running product and its sum."""
    rows = spark.range(1, 6).select(F.col("id").alias("shapes"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("max_blocks"))
    one = F.struct(F.lit(1).cast("long").alias("c"), F.lit(0).cast("long").alias("total"))

    def more(a, i):
        c = F.floor(a["c"] * (F.col("shapes") + i - 1) / i)
        return F.struct(c.alias("c"), (a["total"] + c).alias("total"))

    return rows.select("shapes", "max_blocks", F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("max_blocks").cast("long")), one, more)["total"].alias("bound"))


_BITS = "((1::BIGINT << CAST(y * 6 + x AS INTEGER)))"


@_query("m_bitmap_edits", "WITH" + V.SQL_PIECES + f""", q AS (SELECT m.board_id, m.i, m.b, m.c, o.occ, {_BITS} AS bit, x, y, bw, bh FROM masks m JOIN occ o USING (board_id))
  SELECT board_id, CAST(i AS INTEGER) AS idx, occ & ~bit AS bit_off, occ | 1 AS bit_on, (occ & 4) <> 0 AS bit_2_0, occ & ~c AS block_off, occ | c AS block_on, ((occ & ~c) & c) <> 0 AS hits_itself,
  CASE WHEN x + bw < 6 THEN (occ & (c << 1) & ~c) <> 0 END AS east_taken, CASE WHEN y + bh < 6 THEN (occ & (c << 6) & ~c) <> 0 END AS south_taken, CASE WHEN x > 0 THEN (occ & (c >> 1) & ~c) <> 0 END AS west_taken, CASE WHEN y > 0 THEN (occ & (c >> 6) & ~c) <> 0 END AS north_taken FROM q""")  # fmt: skip
def m_bitmap_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.boards(spark, sf_dir).withColumn("occ", P.occupied()).select("board_id", "w", "h", "occ", F.posexplode("blocks").alias("idx", "b"))
    b, occ = F.col("b"), F.col("occ")
    taken = {n: P.hits_moving(occ, b, d).alias(f"{n}_taken") for n, d in (("east", B.EAST), ("south", B.SOUTH), ("west", B.WEST), ("north", B.NORTH))}
    return rows.select("board_id", "idx", P.clear_bit(occ, B.x_of(b), B.y_of(b)).alias("bit_off"), P.set_bit(occ, 0, 0).alias("bit_on"), P.get_bit(occ, 2, 0).alias("bit_2_0"), P.clear_block(occ, b).alias("block_off"), P.set_block(occ, b).alias("block_on"), P.hits(P.clear_block(occ, b), b).alias("hits_itself"), *taken.values())


@_query("p_meta", "WITH" + V.SQL_BOARDS + """ SELECT board_id, CAST(restricted::INT + gx * 2 + gy * 16 + 640 + 5120 + goal::INT * 8192 AS INTEGER) AS meta, 6 AS w, 6 AS h, gx, gy, NOT restricted AS toggled, goal, gx + 2 <= 6 AND gy + 1 <= 6 AS covered,
  '0' AS no_goal, goal AND gx = 0 AS left_open, goal AND gy = 0 AS top_open, array_to_string(list_transform(range(6), lambda y: array_to_string(list_transform(range(6), lambda x: CASE WHEN len(list_filter(blocks, lambda b:
  ((b >> 8) & 7) <= x AND ((b >> 8) & 7) + ((b >> 2) & 7) >= x AND ((b >> 11) & 7) <= y AND ((b >> 11) & 7) + ((b >> 5) & 7) >= y)) > 0 THEN '1' ELSE '0' END), '')), chr(10)) AS drawn FROM boards WHERE len(list_filter(blocks, lambda b: (b & 2) > 0)) > 0""")  # fmt: skip
def p_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed board but its blocks, unpacked again; and what is drawn of boards with a target."""
    rows = V.boards(spark, sf_dir).where(P.target_block().isNotNull()).withColumn("meta", P.meta()).withColumn("m", P.unpack_meta(F.col("meta")))
    sides = display.openings()
    return rows.select("board_id", "meta", "m.w", "m.h", "m.gx", "m.gy", P.toggle_restricted().alias("toggled"), "m.goal", P.covers(F.col("gx"), F.col("gy"), 2, 1).alias("covered"), P.clear_goal()["gx"].cast("string").alias("no_goal"), F.array_contains(sides, "left").alias("left_open"), F.array_contains(sides, "top").alias("top_open"), P.drawn(P.occupied()).alias("drawn"))


@_query("p_resized", "WITH" + V.SQL_BOARDS + f""", q AS (SELECT *, list_filter(blocks, lambda b: ((b >> 11) & 7) + ((b >> 5) & 7) + 1 <= 5) AS kept FROM boards), u AS (SELECT *, list_filter(kept, lambda b: (b & 2) > 0)[1] AS t FROM q),
  v AS (SELECT *, goal AND t IS NOT NULL AND gx + ((t >> 2) & 7) + 1 <= 6 AND gy + ((t >> 5) & 7) + 1 <= 5 AS stays FROM u)
  SELECT board_id, 7 AS wider, 5 AS lower, array_to_string(kept, ',') AS blocks, stays AS goal, CASE WHEN stays OR NOT goal THEN gx ELSE 0 END AS gx, CASE WHEN stays OR NOT goal THEN gy ELSE 0 END AS gy FROM v""")  # fmt: skip
def p_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.boards(spark, sf_dir).select("board_id", P.resized(1, 0)["w"].alias("wider"), P.resized(0, -1).alias("r"))
    return rows.select("board_id", "wider", F.col("r.h").alias("lower"), _text(F.col("r.blocks")).alias("blocks"), "r.goal", "r.gx", "r.gy")


@_query("r8_painted", "WITH" + V.SQL_BOARDS + f""", q AS (SELECT board_id, x, y, goal, gx, gy, {_TARGET} AS t, list_filter(blocks, lambda b: ((b >> 8) & 7) <= x AND ((b >> 8) & 7) + ((b >> 2) & 7) >= x AND ((b >> 11) & 7) <= y AND ((b >> 11) & 7) + ((b >> 5) & 7) >= y)[1] AS b
  FROM boards CROSS JOIN range(6) a(x) CROSS JOIN range(6) c(y)) SELECT board_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CASE WHEN b IS NULL THEN 'empty' WHEN (b & 2) > 0 THEN 'target' WHEN (b & 1) > 0 THEN 'wall' ELSE 'block' END AS kind,
  goal AND coalesce(x >= gx AND x <= gx + ((t >> 2) & 7) AND y >= gy AND y <= gy + ((t >> 5) & 7), false) AS goal FROM q""")  # fmt: skip
def r8_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.painted(V.boards(spark, sf_dir))


@_query("r2_connections", "WITH " + V.SQL_POINTS + " SELECT CAST(0 AS BIGINT) AS src, b.id AS dst, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1 FROM pt a JOIN pt b ON a.id = 0 AND b.id % 7 = 0")
def r2_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = V.points(spark, sf_dir)
    return display.connections(at, 0, at.select("id").where("id % 7 = 0"))


@_query("l6_tree", "WITH " + V.SQL_POINTS + """, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM pt),
  q AS (SELECT CAST(least(floor((x - lx) / e * 2097151), 2097151) AS BIGINT) AS x, CAST(least(floor((y - ly) / e * 2097151), 2097151) AS BIGINT) AS y, CAST(least(floor((z - lz) / e * 2097151), 2097151) AS BIGINT) AS z FROM pt, b),
  k AS (SELECT CAST(list_sum(list_transform(range(21), lambda i: (((x >> CAST(i AS INTEGER)) & 1) | (((y >> CAST(i AS INTEGER)) & 1) << 1) | (((z >> CAST(i AS INTEGER)) & 1) << 2)) << CAST(3 * i AS INTEGER))) AS BIGINT) AS code FROM q),
  c AS (SELECT CAST(d AS INTEGER) AS depth, code >> CAST(3 * (21 - d) AS INTEGER) AS code, count(*) AS n FROM k CROSS JOIN range(22) r(d) GROUP BY 1, 2),
  p AS (SELECT depth - 1 AS depth, code >> 3 AS code, count(*) AS children FROM c WHERE depth > 0 GROUP BY 1, 2)
  SELECT depth, code, n, coalesce(children, 0) AS children FROM c LEFT JOIN p USING (depth, code) WHERE depth = 0 OR coalesce(children, 0) <> 1""")  # fmt: skip
def l6_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the octree without chains of only children."""
    at = V.points(spark, sf_dir)
    return layout.branching(layout.cells(layout.morton(at, layout.bounds(at)))).select("depth", "code", "n", "children")


@_query("l8_octants", "WITH " + V.SQL_POINTS + """ SELECT id, CAST((x >= 0)::INT + 2 * (y >= 0)::INT + 4 * (z >= 0)::INT AS INTEGER) AS octant, CASE WHEN x >= 0 THEN 0.0 ELSE -1.0 END::DOUBLE AS lox, CASE WHEN z >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hiz,
  CAST((id >> 3) AS BIGINT) AS above, CAST(id & 7 AS INTEGER) AS slot FROM pt""")  # fmt: skip
def l8_octants(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero, lo, hi = (tuple(F.lit(v) for _ in range(3)) for v in (0.0, -1.0, 1.0))
    rows = V.points(spark, sf_dir).withColumn("octant", layout.octant(zero))
    return rows.withColumn("b", layout.child_bounds(lo, hi, F.col("octant"))).select("id", "octant", "b.lox", "b.hiz", layout.ancestor(F.col("id"), 20).alias("above"), layout.octant_at(F.col("id"), 21).alias("slot"))


@_query("l13_euler", "WITH " + V.SQL_POINTS + " SELECT id, round(x + (0.5 + y * (4.0 / 90)) * (4.0 / 90), 6) AS x, round(0.5 + y * (4.0 / 90), 6) AS vx FROM pt")
def l13_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = V.points(spark, sf_dir)
    moving = at.select("*", *(F.lit(0.5).alias(f"v{c}") for c in "xyz"))
    return layout.euler(moving, at.select("id", F.col("y").alias("fx"), F.col("z").alias("fy"), F.col("x").alias("fz"))).select("id", F.round("x", 6).alias("x"), F.round("vx", 6).alias("vx"))


@_query("l16_commands", """WITH c AS (SELECT max(event_id) AS last FROM events WHERE event_type = 'signup' AND event_id <= 50), l AS (SELECT * FROM events, c WHERE event_id > coalesce(last, -1))
  SELECT 'mass' AS kind, user_id AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT DISTINCT user_id FROM l WHERE event_type IN ('view', 'purchase')) UNION ALL SELECT 'spring', user_id, event_id FROM l WHERE event_type = 'click'""")  # fmt: skip
def l16_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands: early signups clear, views and purchases add masses, clicks add springs."""
    kind = F.when((F.col("event_type") == "signup") & (F.col("event_id") <= 50), "clear").when(F.col("event_type").isin("view", "purchase"), "mass").when(F.col("event_type") == "click", "spring")
    masses, springs = layout.commanded(V.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("command"), F.col("user_id").alias("a"), F.col("event_id").alias("b")))
    return masses.select(F.lit("mass").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(springs.select(F.lit("spring").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
