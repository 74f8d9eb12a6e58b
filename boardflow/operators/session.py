"""Sessions: a fold over the ordered actions of each player on a board.

A session knows a graph: the states it has seen and the links by which it first came to each, or, once populated, all
that can be reached from its start. Distances to the solved states it knows are those of that graph.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardflow.operators import local

STEP = {"N": -2048, "E": 256, "S": 2048, "W": -256}
BOARD = ("w", "h", "gx", "gy", "restricted", "goal", "blocks")
RESULT = "session_id long, seq long, blocks array<int>, visits int, total_moves int, history int, states int, links int, solved int, distance int, path int"
State = tuple[int, ...]


@dataclass(frozen=True)
class Board:
    """What moves don't change."""

    w: int
    h: int
    gx: int
    gy: int
    restricted: bool
    goal: bool

    def order(self, state: State) -> tuple[int, ...]:
        """Sorts states as their keys do: from the last slot on, empty ones last."""
        return tuple([0x8000] * (15 - len(state)) + list(reversed(state)))

    def solved(self, state: State) -> bool:
        target = next((b for b in state if b & 2), None)
        return self.goal and target is not None and (target >> 8 & 7, target >> 11 & 7) == (self.gx, self.gy)

    def block_at(self, state: State, x: int | None, y: int | None) -> int | None:
        """The first block that covers the cell; of no cell, the first block."""
        if x is None or y is None:
            return state[0] if state else None
        return next((b for b in state if 0 <= x - (b >> 8 & 7) <= (b >> 2 & 7) and 0 <= y - (b >> 11 & 7) <= (b >> 5 & 7)), None)

    def moved(self, state: State, block: int, way: str) -> State | None:
        """The state after a block's step, if it may go that way and what it enters is free and on the board."""
        x, y, w, h = block >> 8 & 7, block >> 11 & 7, (block >> 2 & 7) + 1, (block >> 5 & 7) + 1
        level = way in "EW"
        if block & 1 or (self.restricted and (h > w if level else w > h)):
            return None
        ex, ey, ew, eh = {"N": (x, y - 1, w, 1), "E": (x + w, y, 1, h), "S": (x, y + h, w, 1), "W": (x - 1, y, 1, h)}[way]
        if not (0 <= ex < self.w and 0 <= ey < self.h):
            return None
        for b in state:
            bx, by = b >> 8 & 7, b >> 11 & 7
            if b != block and bx < ex + ew and ex <= bx + (b >> 2 & 7) and by < ey + eh and ey <= by + (b >> 5 & 7):
                return None
        return tuple(sorted({*state} - {block} | {block + STEP[way]}))


@dataclass
class Session:
    """State of one session. States have the numbers in which they became known."""

    board: Board
    known: dict[State, int] = field(default_factory=dict)
    states: list[State] = field(default_factory=list)
    links: list[tuple[int, int]] = field(default_factory=list)
    winning: set[int] = field(default_factory=set)
    current: int = 0
    previous: int = 0
    start: int = 0
    history: list[int] = field(default_factory=list)
    visits: dict[int, int] = field(default_factory=dict)
    total: int = 0
    edited: bool = False
    distances: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # distance, parent, nearest

    @classmethod
    def begun(cls, board: Board, state: State) -> Session:
        s = cls(board)
        s.reset(state)
        return s

    def state(self, number: int | None = None) -> State:
        return self.states[self.current if number is None else number]

    def insert(self, state: State) -> int:
        if state not in self.known:
            self.known[state] = len(self.states)
            self.states.append(state)
        return self.known[state]

    def update(self, state: State) -> None:
        """Go to a state, known or not; a new one is linked with the one before."""
        before = len(self.known)
        number = self.insert(state)
        grown = len(self.known) > before
        if grown:
            self.links.append((self.current, number))
        self.previous, self.current = self.current, number
        if self.current != self.previous:
            self.history.append(self.previous)
        if self.board.solved(state):
            self.winning.add(number)
        self.visits[number] = self.visits.get(number, 0) + 1
        self.total += 1
        if grown:
            self.measure()

    def measure(self) -> None:
        """Distances anew; what was known stays where there is no link or no solved state."""
        if not self.links or not self.winning:
            return
        states = self.states
        order = sorted(range(len(states)), key=lambda i: self.board.order(states[i]))
        rank = np.argsort(order)
        src, dst = (rank[np.array(e)] for e in zip(*self.links, strict=True))
        found = local.search(*local.compressed(len(states), src, dst), np.sort(rank[sorted(self.winning)]))
        at = [v.tolist() for v in found]
        self.distances = {order[i]: (at[0][i], order[at[1][i]] if at[1][i] >= 0 else -1, order[at[2][i]]) for i in range(len(states)) if at[0][i] >= 0}

    def reset(self, state: State) -> None:
        """Forget the graph and begin it anew with a state."""
        self.known, self.states, self.links, self.winning, self.distances, self.history = {}, [], [], set(), {}, []
        self.current = self.previous = self.start = self.insert(state)
        self.visits = {0: 1}

    def path(self) -> list[int]:
        """From the current state to the nearest solved one; empty where none is known."""
        out, at = [], self.current
        while at in self.distances:
            out.append(at)
            at = self.distances[at][1]
        return out

    # what a player can do

    def undo(self) -> None:
        """Back to where the last change came from; counts as a move."""
        if self.history:
            self.update(self.state(self.history[-1]))
            del self.history[-2:]

    def restart(self) -> None:
        self.update(self.state(self.start))
        self.previous = self.current
        self.visits = {self.current: 1}
        self.history, self.total = [], 0

    def edit(self, board: Board, state: State) -> None:
        """Another board to start from."""
        self.board = board
        self.reset(state)
        self.total, self.edited = 0, True

    def hint(self) -> None:
        """A step towards the nearest solved state; nothing where none is known, or there already."""
        if self.distances.get(self.current, (0,))[0] > 0:
            self.update(self.state(self.distances[self.current][1]))

    def farthest(self) -> None:
        """To the state farthest from a solved one, the first of them; to the first known state if all are at 0."""
        if self.distances:
            most = max(d[0] for d in self.distances.values())
            self.update(self.state(min(i for i, d in self.distances.items() if d[0] == most) if most else 0))

    def closest(self) -> None:
        if self.current in self.distances:
            self.update(self.state(self.distances[self.current][2]))

    def populate(self) -> None:
        """All that can be reached from the start, with all links. A session's space fits its worker."""
        first, now = self.state(self.start), self.state()
        b = self.board
        blocks, _, _ = local.closure(np.array([first]), np.array([0]), b.w, b.h, b.restricted, 1 << 62, 1 << 30)
        self.states = [tuple(r) for r in blocks.tolist()]
        self.known = {s: i for i, s in enumerate(self.states)}
        row, after = local.steps(blocks, b.w, b.h, b.restricted)
        self.links = [(i, self.known[tuple(r)]) for i, r in zip(row.tolist(), after.tolist(), strict=True)]
        self.visits, self.history = {}, []
        self.current = self.previous = self.insert(now)
        self.start = self.known[first]
        self.winning = {i for s, i in self.known.items() if b.solved(s)}
        self.distances = {}
        self.measure()

    def clear(self) -> None:
        self.reset(self.state())

    def move(self, way: str, x: int | None, y: int | None) -> None:
        block = self.board.block_at(self.state(), x, y)
        after = None if block is None else self.board.moved(self.state(), block, way)
        if after is not None:
            self.update(after)

    def toggle(self, bit: int, x: int | None, y: int | None) -> None:
        """Target (2) or wall (1) on or off at a cell; an edit."""
        b = self.board.block_at(self.state(), x, y)
        if b is None or b & (3 - bit):
            return
        others = [v & ~2 if bit == 2 else v for v in self.state() if v != b]
        self.edit(self.board, tuple(sorted([*others, b ^ bit])))

    def remove(self, x: int | None, y: int | None) -> None:
        b = self.board.block_at(self.state(), x, y)
        if b is not None:
            self.edit(self.board, tuple(v for v in self.state() if v != b))


Action = Callable[[Session, "int | None", "int | None"], None]
#: What the names in a log do; :func:`register` adds to it.
ACTIONS: dict[str, Action] = {
    **{way: lambda s, x, y, way=way: s.move(way, x, y) for way in STEP},
    "undo": lambda s, x, y: s.undo(),
    "start": lambda s, x, y: s.restart(),
    "hint": lambda s, x, y: s.hint(),
    "farthest": lambda s, x, y: s.farthest(),
    "closest": lambda s, x, y: s.closest(),
    "populate": lambda s, x, y: s.populate(),
    "clear": lambda s, x, y: s.clear(),
    "target": lambda s, x, y: s.toggle(2, x, y),
    "wall": lambda s, x, y: s.toggle(1, x, y),
    "remove": lambda s, x, y: s.remove(x, y),
}


def register(name: str, action: Action) -> None:
    """Another action for logs. Workers get it with the functions they run."""
    ACTIONS[name] = action


def row_of(session: Any, seq: int, s: Session) -> tuple[Any, ...]:
    path = s.path()
    distance = s.distances.get(s.current, (None,))[0]
    return session, seq, list(s.state()), s.visits.get(s.current, 0), s.total, len(s.history), len(s.known), len(s.links), len(s.winning), distance, max(len(path) - 1, 0)


def fold(rows: pd.DataFrame, s: Session, actions: dict[str, Action]) -> list[tuple[Any, ...]]:
    """The session after each row; actions that aren't known, or can't be done, do nothing."""
    out = []
    for session, seq, name, x, y in rows[["session_id", "seq", "action", "x", "y"]].itertuples(index=False):
        if (act := actions.get(name)) is not None:
            act(s, None if pd.isna(x) else int(x), None if pd.isna(y) else int(y))
        out.append(row_of(session, seq, s))
    return out


def begun(row: Any) -> Session:
    board = Board(int(row.w), int(row.h), int(row.gx), int(row.gy), bool(row.restricted), bool(row.goal))
    return Session.begun(board, tuple(int(b) for b in row.blocks))


def columns() -> list[str]:
    return [f.split()[0] for f in RESULT.split(", ")]


def replay(log: DataFrame, boards: DataFrame) -> DataFrame:
    """The session after each action of (session_id, seq, action, x, y), from (session_id, board columns).

    A session's rows are folded in order of seq; it begins at its board, visited once. x and y are the cell that an
    action is for, null for the first block. Sessions without a board give no rows. distance and path are null and 0
    where no solved state is known.
    """
    actions = dict(ACTIONS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Session | None = None
        now = None
        for part in parts:  # sorted by session: a partition is a stream, whatever a session's length
            out = []
            for key, rows in part.groupby("session_id", sort=False):
                if key != now:
                    held, now = begun(rows.iloc[0]), key
                out += fold(rows, held, actions)
            yield pd.DataFrame(out, columns=columns()).astype({"distance": "Int32"})

    both = log.select("session_id", "seq", "action", "x", "y").join(boards.select("session_id", *BOARD), "session_id")
    # a row costs far more here than its bytes say, so tasks aren't coalesced by bytes
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, "session_id").sortWithinPartitions("session_id", "seq").mapInPandas(run, RESULT)


def lone_block(sessions: DataFrame, width: int = 3, height: int = 3) -> DataFrame:
    """(session_id, board columns): a single cell in the middle of an open board without a goal."""
    at = (height // 2) * 2048 + (width // 2) * 256
    return sessions.select("session_id").distinct().select(
        "session_id", F.lit(width).alias("w"), F.lit(height).alias("h"), F.lit(0).alias("gx"), F.lit(0).alias("gy"), F.lit(False).alias("restricted"), F.lit(False).alias("goal"), F.array(F.lit(at)).alias("blocks")
    )


def visit_counts(played: DataFrame, states: DataFrame) -> DataFrame:
    """(session_id, state_key, visits) of all states of each session's board, 0 where it never was.

    played: (session_id, state_key) for each visit; states: (session_id, state_key).
    """
    n = played.groupBy("session_id", "state_key").agg(F.count("*").alias("visits"))
    return states.select("session_id", "state_key").join(n, ["session_id", "state_key"], "left").select("session_id", "state_key", F.coalesce("visits", F.lit(0)).alias("visits"))
