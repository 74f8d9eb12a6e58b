"""State spaces, graphs, sessions, layouts: golden counts, properties and brute force."""

from __future__ import annotations

import random
from collections import deque
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardflow.functions import bits
from boardflow.functions import boards as P
from boardflow.operators import display, graph, layout, local, session, statespace
from boardflow.operators.components import connected_components
from boardflow.plans import queries
from boardflow.sources import presets
from boardflow.streaming.sessions import replay_stream

SCHEMA = "board_id long, w int, h int, gx int, gy int, restricted boolean, goal boolean, blocks array<int>"
KLOTSKI = "S:[4x5] G:[1,3] M:[F] B:[{1x2 2X2 _ 1x2} {_ _ _ _} {1x2 2x1 _ 1x2} {_ 1x1 1x1 _} {1x1 _ _ 1x1}]"


def block(x, y, w, h, t=0, i=0):
    return y * 2048 + x * 256 + (h - 1) * 32 + (w - 1) * 4 + 2 * t + i


@pytest.mark.parametrize("width", [8, 16, 32, 64])
def test_bits(spark, width):
    rng = random.Random(width)
    rows = []
    for _ in range(60):
        first = rng.randrange(width)
        last = rng.randrange(first, width)
        rows.append((rng.getrandbits(width), first, last, rng.getrandbits(8)))
    signed = [(v - (1 << 64) if v >= 1 << 63 else v, f, t, n) for v, f, t, n in rows]
    v, f, t, n = (F.col(c) for c in "vftn")
    got = spark.createDataFrame(signed, "v long, f int, t int, n long").select("v", "f", "t", "n", bits.create_mask(f, t), bits.clear_bits(v, f, t), bits.set_bits(v, f, t, n), bits.get_bits(v, f, t)).collect()
    for r in got:
        m = ((1 << (r[2] - r[1] + 1)) - 1) << r[1]
        u = r[0] % (1 << 64)
        assert [x % (1 << 64) for x in r[4:]] == [m, u & ~m, (u & ~m) | ((r[3] << r[1]) & m), (u & m) >> r[1]]


GOLDEN = [(3, 3, False, [block(0, 0, 1, 1)], 9, 24), (3, 4, True, [block(1, 0, 1, 2)], 3, 4), (4, 3, True, [block(0, 1, 2, 1)], 3, 4), (3, 3, True, [block(0, 0, 1, 1)], 9, 24), (4, 4, True, [block(0, 0, 2, 1), block(3, 0, 1, 2)], 8, 20), (5, 4, True, [block(0, 0, 1, 1, 1)], 20, 62)]


def test_small_state_spaces(spark):
    rows = [(n, w, h, 0, 0, r, False, sorted(b)) for n, (w, h, r, b, _, _) in enumerate(GOLDEN)]
    states, links = statespace.explore(spark.createDataFrame(rows, SCHEMA))
    n = {r[0]: r[1] for r in states.groupBy("board_id").count().collect()}
    m = {r[0]: r[1] for r in links.groupBy("board_id").count().collect()}
    assert [(n[i], m[i]) for i in range(len(GOLDEN))] == [(g[4], g[5]) for g in GOLDEN]
    back = links.select("board_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    assert links.exceptAll(back).isEmpty() and links.where("src = dst").isEmpty()


def test_klotski_by_placements(spark):
    b = spark.range(1).select(P.from_text(F.lit(KLOTSKI)).alias("b")).select("b.*").withColumn("board_id", F.lit(0).cast("long"))
    key = b.select(P.state_key()).first()[0]
    # the board's own pieces: the target, then every other, by shape
    counts = {(1, 2): 4, (2, 1): 1, (1, 1): 4}
    starts = spark.range(1).select(F.explode(F.expr("flatten(transform(sequence(0, 2), x -> transform(sequence(0, 3), y -> x * 256 + y * 2048 + 38)))")).alias("t"))
    starts = starts.select(F.lit(0).cast("long").alias("board_id"), F.lit(4).alias("w"), F.lit(5).alias("h"), F.lit(1).alias("gx"), F.lit(3).alias("gy"), F.lit(False).alias("restricted"), F.lit(True).alias("goal"), F.array("t").alias("blocks"))
    level = starts
    for shape, n in counts.items():
        like = (shape[1] - 1) * 32 + (shape[0] - 1) * 4
        level = statespace.placements(level, [shape], 4, 5, n).where(f"size(filter(blocks, v -> (v & 255) = {like})) = {n}")
    states = level.withColumn("state_key", P.state_key()).persist()
    assert states.count() == 65880
    links = statespace.successors(states.withColumnRenamed("state_key", "src")).drop("blocks").withColumnRenamed("next", "blocks").select("src", P.state_key().alias("dst")).persist()
    assert links.count() == 206780
    found = connected_components(links)
    mine = found.where(F.col("node") == key).first()["component"]
    member = found.where(F.col("component") == mine).select(F.col("node").alias("src"))
    assert member.count() == 25955
    assert links.join(member, "src").count() == 83896


@pytest.mark.parametrize(("rules", "most", "states", "links", "clusters", "winnable", "three"), [(statespace.RUSH_HOUR, 2, 468, 1362, 27, 25, 23), (statespace.KLOTSKI, 2, 460, 2222, 4, 4, 4), (statespace.KLOTSKI, 3, 7622, 48222, 10, 10, 10)])
def test_spaces(spark, rules, most, states, links, clusters, winnable, three):
    s, e = statespace.space(rules, most, spark)
    assert (s.count(), e.count()) == (states, links)
    c = statespace.clusters(s, e).collect()
    assert len(c) == clusters and sum(r["winnable"] for r in c) == winnable and sum(r["winnable"] and r["max_moves"] >= 3 for r in c) == three
    out = statespace.exported(spark.createDataFrame(c), s).collect()
    assert [r["name"] for r in out] == [f"Cluster {i}" for i in range(clusters)]


def test_space_with_room_for_the_target_alone_is_empty(spark):
    assert statespace.space(statespace.KLOTSKI, 1, spark)[0].isEmpty()


def test_large_classes_and_boards_go_by_rounds(spark, monkeypatch):
    """What no worker may hold is searched by all: the same clusters, and the same states of a board."""
    states = statespace.space_states(statespace.KLOTSKI, 2, spark)
    want = sorted(map(tuple, statespace.clusters(states).collect()))
    boards = spark.createDataFrame([(0, 3, 3, 0, 0, False, False, [0]), (1, 4, 4, 2, 0, False, False, [0, 548])], SCHEMA)
    reached = {r["state_key"] for r in statespace.explore(boards)[0].collect()}
    monkeypatch.setattr(statespace, "IN_CLASS", 20)
    assert sorted(map(tuple, statespace.clusters(states).collect())) == want
    monkeypatch.setattr(statespace, "AT_ONCE", 20)
    monkeypatch.setattr(statespace, "SHARED_LEVELS", 3)
    found, links = statespace.explore(boards)
    keys = [r["state_key"] for r in found.collect()]
    assert len(keys) == len(reached) > 100 and {*keys} == reached and links.where("board_id = 0").count() == 24


def test_command_line(spark, tmp_path):
    from boardflow.__main__ import arguments, main

    assert (arguments(["--blocks", "99", "--moves", "-4"]).blocks, arguments(["--blocks", "0"]).blocks, arguments(["--moves", "-4"]).moves) == (15, 1, 0)
    assert main(["--space", "klotski", "--blocks", "3", "--moves", "8", "--output", str(tmp_path / "c")], spark) == 4
    found = presets.read(spark, str(tmp_path / "c"), permissive=True).orderBy("idx").collect()
    assert [r["name"] for r in found] == [f"Cluster {i}" for i in range(4)]
    keys = [r["blocks"][::-1] for r in found]
    assert keys == sorted(keys, reverse=True) or len({len(k) for k in keys}) > 1


def test_camera():
    c = display.Camera(distance=10.0)
    assert [round(v, 6) for v in c.position()] == [0.0, 0.0, 10.0]
    assert c.rotated(0, 10_000).angle_y == 1.5 and c.rotated(200, 0).angle_x == -1.0
    assert c.panned(100, 0).target == (-2.0, 0.0, 0.0) and c.followed((1.0, 2.0, 3.0), 0.5).target == (0.5, 1.0, 1.5)


def test_distances_are_kept_until_something_changes(spark):
    d = graph.Distances()
    links, none = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), spark.createDataFrame([], "id long")
    assert d.of(links, none) is None and d.empty
    first = d.of(links, spark.createDataFrame([(1,)], "id long"))
    assert d.of(links, spark.createDataFrame([(1,)], "id long")) is first and first.count() == 3
    assert d.of(links, spark.createDataFrame([(3,)], "id long")) is not first and d.of(links, none) is d.found


def test_text_codec(spark):
    good = [KLOTSKI, "S:[3x3] M:[R] B:[{1x1 _ _} {2X1 _ _} {_ _ 1*1}]", "B:[{_ _ _} {_ _ _} {_ _ _}] M:[F] S:[3x3]"]
    bad = ["", "S:[3x3] B:[{_}]", "S:[3x3] S:[3x3] M:[R] B:[{_}]", "S:[3x3] M:[R] B:[{9q1 _ _}]", None]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").withColumn("p", P.from_text(F.col("t")))
    assert rows.where("p is null").count() == len(bad)
    again = rows.where("p is not null").select("t", "p.*").select("t", P.to_text().alias("u")).collect()
    assert sum(r["t"] == r["u"] for r in again) == 2  # the third has its keys in another order


def test_presets(spark, tmp_path):
    f = tmp_path / "a.puzzle"
    f.write_text(f"# One\n{KLOTSKI}\n\n# Two\n{KLOTSKI}\n")
    got = presets.read(spark, str(f))
    assert [r["name"] for r in got.orderBy("idx").collect()] == ["One", "Two"]
    f.write_text(f"# One\n{KLOTSKI}\n# Two\nS:[3x3] M:[F] B:[{{2X1 _ _}} {{_ _ _}} {{_ _ _}}]\n")
    assert presets.read(spark, str(f)).isEmpty() and presets.read(spark, str(f), permissive=True).count() == 1
    good = presets.read(spark, str(f), permissive=True)
    out = str(tmp_path / "out")
    for name in ("Zebra", "Ant", "Mole"):  # what is added comes last, whatever its name
        assert presets.append(good.withColumn("name", F.lit(name)), out)
    assert not presets.append(good.withColumn("name", F.lit("Bad")).withColumn("goal", F.lit(False)), out)
    cycle = presets.Cycle.load(spark, out)
    assert [r["name"] for r in cycle.presets] == ["Zebra", "Ant", "Mole"] and cycle.previous().current["name"] == "Mole" and cycle.next().current["name"] == "Ant"
    cycle = cycle.saved(good.withColumn("name", F.lit("New")))
    assert cycle.current["name"] == "New" and len(cycle.presets) == 4 and cycle.reloaded(spark).presets == cycle.presets
    assert presets.neighbour(0, -1, 15) == 14


def test_first_empty_and_corners(spark):
    rng = random.Random(3)
    rows = [(w, h, rng.getrandbits(w * h) | ((1 << rng.randrange(w * h)) - 1)) for w, h in ((3, 3), (4, 5), (6, 6), (8, 7), (8, 8)) for _ in range(40)]
    rows += [(8, 8, (1 << 64) - 1), (8, 8, (1 << 63) - 1), (3, 3, 511), (3, 3, 0)]
    df = spark.createDataFrame([(w, h, b - (1 << 64) if b >= 1 << 63 else b) for w, h, b in rows], "w int, h int, b long")
    for r in df.select("w", "h", "b", P.first_empty(F.col("b")).alias("e"), P.is_full(F.col("b")).alias("f")).collect():
        free = [i for i in range(r["w"] * r["h"]) if not (r["b"] >> i) & 1]
        assert r["e"] == (free[0] if free else None) and r["f"] == (not free)


def test_edits(spark):
    b = spark.createDataFrame([(0, 4, 4, 2, 1, False, True, [block(0, 1, 2, 1, 1), block(3, 0, 1, 2)])], SCHEMA)
    r = b.select(P.toggle_target(3, 1).alias("t"), P.toggle_wall(0, 1).alias("wall"), P.toggle_target(0, 0).alias("n"), P.set_goal(2, 1).alias("same"), P.set_goal(0, 3).alias("g"), P.set_goal(3, 3).alias("off"), P.resized(0, -1).alias("row"), P.resized(-1, 0).alias("col"), P.resized(1, 0).alias("wide"), P.add_block(F.lit(block(3, 1, 1, 1))).alias("hit")).first()
    # the goal (2, 1) holds a 1 by 2 block too
    assert r["t"]["blocks"] == sorted([block(0, 1, 2, 1), block(3, 0, 1, 2, 1)]) and (r["t"]["gx"], r["t"]["gy"], r["t"]["goal"]) == (2, 1, True) and r["wall"] is None and r["n"] is None and r["hit"] is None and r["off"] is None
    assert not r["same"]["goal"] and (r["g"]["gx"], r["g"]["gy"], r["g"]["goal"]) == (0, 3, True)
    assert (r["row"]["h"], r["row"]["gx"], r["row"]["goal"]) == (3, 2, True) and (r["col"]["w"], r["col"]["gx"], r["col"]["goal"]) == (3, 0, False) and r["wide"]["w"] == 5
    assert r["col"]["blocks"] == [block(0, 1, 2, 1, 1)]


def test_distances_against_search(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(140)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, queue = {0: 0, 7: 0}, deque([0, 7])
    while queue:
        a = queue.popleft()
        for b in near.get(a, ()):
            if b not in want:
                want[b] = want[a] + 1
                queue.append(b)
    links = spark.createDataFrame(edges, "src long, dst long")
    found = graph.distances(links, spark.createDataFrame([(0,), (7,)], "id long"))
    rows = {r["id"]: r for r in found.collect()}
    assert {k: r["distance"] for k, r in rows.items()} == want
    for k, r in rows.items():
        if r["distance"]:
            assert rows[r["parent"]]["distance"] == r["distance"] - 1 and r["parent"] in near[k] and rows[r["parent"]]["nearest"] == r["nearest"]
    far = max(want, key=lambda k: (want[k], -k))
    steps = graph.path(found, spark.createDataFrame([(far,)], "id long")).orderBy("step").collect()
    assert len(steps) == want[far] + 1 and steps[-1]["id"] in (0, 7)
    assert graph.most_distant(found).first()["distance"] == want[far]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).isEmpty()


def test_barnes_hut_is_near_the_exact_sum(spark):
    rng = random.Random(1)
    pts = spark.createDataFrame([(i, rng.gauss(0, 5), rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(150)] + [(150, 1.0, 1.0, 1.0), (151, 1.0, 1.0, 1.0)], "id long, x double, y double, z double")
    exact = {r["id"]: r for r in layout.repulsion(pts, layout.Config(theta=0.0)).collect()}
    close = {r["id"]: r for r in layout.repulsion(pts, layout.Config(theta=0.5)).collect()}
    size = max(abs(r[f"f{c}"]) for r in exact.values() for c in "xyz")
    assert max(abs(exact[i][f"f{c}"] - close[i][f"f{c}"]) for i in exact for c in "xyz") < 0.1 * size
    for most in (0, 40):  # the cells beyond go by joins
        again = {r["id"]: r for r in layout.repulsion(pts, layout.Config(theta=0.5), most).collect()}
        assert max(abs(again[i][f"f{c}"] - close[i][f"f{c}"]) for i in exact for c in "xyz") < 1e-9 * size and len(again) == len(close)
    alone = layout.repulsion(pts.where("id = 3").unionByName(pts.where("id = 4").selectExpr("id", "x", "cast(null as double) as y", "z")))
    assert [(r["id"], r["fx"]) for r in alone.collect()] == [(3, 0.0)] and layout.repulsion(pts.limit(0)).isEmpty()
    start = layout.seeded(pts.select("id"))
    moved = layout.layout(start, spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), 2)
    assert moved.count() == 152


def test_sessions_batch_and_stream(spark, tmp_path):
    log = spark.createDataFrame([(s, i, a, None, None) for s in (1, 2) for i, a in enumerate(["E", "E", "undo", "N", "undo", "undo", "undo", "start", "W"])], "session_id long, seq long, action string, x int, y int")
    boards = session.lone_block(log)
    rows = session.replay(log, boards).orderBy("session_id", "seq").collect()
    at = [(r["blocks"][0] >> 11) * 3 + (r["blocks"][0] >> 8 & 7) for r in rows]
    assert at[:9] == [5, 5, 4, 1, 4, 4, 4, 4, 3] and rows[8]["total_moves"] == 1
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = replay_stream(stream, boards).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.sql("select * from sessions").collect())) == sorted(map(str, rows))


def test_a_step_is_one_of_the_legal_ones():
    rng = random.Random(4)
    for _ in range(300):
        state = []
        for _ in range(rng.randint(1, 6)):
            x, y = rng.randrange(5), rng.randrange(4)
            new = (x, y, rng.randint(1, 5 - x), rng.randint(1, min(2, 4 - y)))
            if not any(x < a + c and a < x + new[2] and y < b + d and b < y + new[3] for a, b, c, d in state):
                state.append(new)
        board = session.Board(5, 4, 0, 0, rng.random() < 0.5, False)
        blocks = tuple(sorted(block(*b, 0, int(rng.random() < 0.1)) for b in state))
        got = [after for b in blocks for way in session.STEP if (after := board.moved(blocks, b, way))]
        assert sorted(got) == sorted(map(tuple, local.steps(np.array([blocks]), 5, 4, board.restricted)[1].tolist()))


def test_a_session_on_a_board():
    """A target from (0, 0) to (2, 0) on a restricted 4 by 4 board, with another block in its way."""
    s = session.Session.begun(session.Board(4, 4, 2, 0, True, True), tuple(sorted([block(0, 0, 2, 1, 1), block(3, 0, 1, 2)])))
    s.move("E", 0, 0), s.move("E", 1, 0)  # the second is barred
    assert (s.total, len(s.known), s.links, s.winning, s.path()) == (1, 2, [(0, 1)], set(), [])
    s.move("S", 3, 1), s.move("E", 1, 0)
    assert len(s.winning) == 1  # (3, 1) and (3, 2) are taken now, (3, 0) is free
    assert s.board.solved(s.state()) and s.distances[s.current][0] == 0
    s.undo(), s.undo()
    assert (s.total, len(s.history)) == (5, 1) and [s.distances[i][0] for i in (0, 1)] == [3, 2]
    s.farthest()
    far = s.distances[s.current][0]
    assert far == max(d[0] for d in s.distances.values()) and len(s.path()) == far + 1
    s.hint()
    assert s.distances[s.current][0] == far - 1
    s.closest()
    assert s.distances[s.current][0] == 0
    s.populate()
    assert (len(s.known), len(s.links)) == (sum(1 for _ in s.known), 2 * len({frozenset(e) for e in s.links})) and s.visits == {} and s.distances[s.start][0] == 3
    s.clear()
    assert (len(s.known), s.links, s.visits, s.winning) == (1, [], {0: 1}, set())
    s.toggle(1, 3, 1)
    assert s.edited and any(b & 1 for b in s.state())
    s.remove(3, 1)
    assert len(s.state()) == 1 and s.total == 0


def test_display(spark):
    got = spark.range(1, 125).select("id", display.ordinal(F.col("id")).alias("o")).collect()
    assert {r["o"] for r in got if r["id"] in (1, 2, 3, 11, 12, 13, 21, 111, 122)} == {"1st", "2nd", "3rd", "11th", "12th", "13th", "21st", "111th", "122nd"}
    b = [F.lit(v) for v in (False, True, True, False, False)]
    assert spark.range(1).select(display.vertex_class(*b)).first()[0] == "path"
    pts = spark.createDataFrame([(5, 0.0, 0.0, 9.0), (3, 0.1, 0.0, 4.0), (1, 5.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert display.picked(pts, (0.0, 0.0, -5.0), (0.0, 0.0, 1.0)).first()[0] == 3


def test_whole_graph_queries(spark, tmp_path):
    """Every pair of supplier and part counts, whatever the quantity."""
    rng = random.Random(21)
    # small parts, and a chain for distances beyond 12
    pairs = [(rng.randrange(120), rng.randrange(1, 400)) for _ in range(60)] + [(s, p) for i in range(7) for s, p in ((1000 + i, 2000 + i), (1001 + i, 2000 + i))] + [(49, 2000)]
    spark.createDataFrame([(s, p, float(rng.randint(1, 50))) for s, p in pairs] + [(None, 5, 1.0)], "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    near: dict[int, set[int]] = {}
    for s, p in pairs:
        near.setdefault(-s - 1, set()).add(p), near.setdefault(p, set()).add(-s - 1)

    def levels(starts):
        d, todo = dict.fromkeys(starts, 0), deque(starts)
        while todo:
            i = todo.popleft()
            for j in near[i] - d.keys():
                d[j] = d[i] + 1
                todo.append(j)
        return d

    d = levels([i for i in near if i < 0 and i % 50 == 0])
    run = {k: f(spark, str(tmp_path)).collect() for k, f in queries.queries().items() if k in ("d1_distances", "d2_paths", "d_components", "r5_ramp")}
    assert {r["id"]: r["distance"] for r in run["d1_distances"]} == d and max(d.values()) > 12
    assert {r["node"]: r["component"] for r in run["d_components"]} == {i: min(levels([i])) for i in near}
    ends = {i for i in near if i >= 0 and i % 100 == 0 and i in d}
    assert {(r["start"], r["step"]) for r in run["d2_paths"]} == {(i, n) for i in ends for n in range(d[i] + 1)}
    assert {r["id"] for r in run["r5_ramp"]} == set(d)
