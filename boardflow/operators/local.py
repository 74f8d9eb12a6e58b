"""Boards and graphs in numpy, for what fits a worker: all steps of many boards at once, closures, searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHANGES = ((1, -2048), (2, 256), (4, 2048), (8, -256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashes(blocks: np.ndarray, owner: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each row of blocks, whatever their order, and of its owner."""
    h = mix(owner.astype(U) + U(0x9E3779B97F4A7C15 + salt))
    for column in range(blocks.shape[1]):
        h = h + mix(blocks[:, column].astype(U) ^ U(0xD1B54A32D192ED03 + salt))
    return mix(h)


def masks(blocks: np.ndarray, w: int) -> np.ndarray:
    """Cells of each block on a board of width ``w``."""
    row = (U(1) << ((blocks >> 2 & 7) + 1).astype(U)) - U(1)
    out = np.zeros(blocks.shape, dtype=U)
    height = (blocks >> 5 & 7) + 1
    for r in range(int(height.max(initial=0))):
        out |= np.where(height > r, row << (U(r * w)), U(0))
    return out << ((blocks >> 11 & 7) * w + (blocks >> 8 & 7)).astype(U)


def steps(blocks: np.ndarray, w: int, h: int, restricted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, next): every legal step of every row, next with its blocks in order."""
    rows, found = [], []
    if not blocks.shape[1]:
        return np.zeros(0, dtype=np.int64), blocks[:0]
    m = masks(blocks, w)
    occ = np.bitwise_or.reduce(m, axis=1)[:, None]
    x, y, bw, bh = blocks >> 8 & 7, blocks >> 11 & 7, (blocks >> 2 & 7) + 1, (blocks >> 5 & 7) + 1
    ways = np.where(blocks & 1, 0, np.where(bw > bh, 10, np.where(bh > bw, 5, 15)) if restricted else 15)
    inside = {1: y > 0, 2: x + bw < w, 4: y + bh < h, 8: x > 0}
    shifted = {1: m >> U(w), 2: m << U(1), 4: m << U(w), 8: m >> U(1)}
    for d, change in CHANGES:
        ok = (ways & d > 0) & inside[d]
        ok &= (shifted[d] & ~m & occ) == 0
        row, at = np.nonzero(ok)
        after = blocks[row]
        after[np.arange(len(row)), at] += change
        rows.append(row), found.append(np.sort(after, axis=1))
    return np.concatenate(rows), np.concatenate(found)


def closure(blocks: np.ndarray, owner: np.ndarray, w: int, h: int, restricted: bool, most: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, owner, expanded) of what is reached within ``levels`` steps, or until more than ``most`` are found.

    States that were found last are not expanded. All boards have as many blocks.
    """
    def packed(b: np.ndarray, o: np.ndarray) -> list[bytes]:
        flat = np.concatenate([o[:, None].view(np.uint16).reshape(len(o), 4), b.astype(np.uint16)], axis=1)
        return [r.tobytes() for r in np.ascontiguousarray(flat)]

    seen: set[bytes] = set()
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    found, whose = blocks, owner
    for level in range(levels + 1):
        fresh = []
        for i, key in enumerate(packed(found, whose)):
            if key not in seen:
                seen.add(key)
                fresh.append(i)
        found, whose = found[fresh], whose[fresh]
        if not len(found):
            break
        stop = level == levels or (len(seen) > most and level > 0)
        out.append((found, whose, not stop))
        if stop:
            break
        row, found = steps(found, w, h, restricted)
        whose = whose[row]
    return tuple(np.concatenate([p[i] if i < 2 else np.full(len(p[0]), p[2]) for p in out]) for i in range(3))


def compressed(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and neighbours of an undirected graph."""
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)), b[order]


def components(off: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The smallest node that each node is connected with."""
    n = len(off) - 1
    label, has = np.arange(n), off[1:] > off[:-1]
    while True:
        least = label.copy()
        if has.any():
            least[has] = np.minimum(label[has], np.minimum.reduceat(label[near], off[:-1][has]))
        after = label.copy()
        np.minimum.at(after, label, least)
        after = np.minimum(after, least)
        while not np.array_equal(up := after[after], after):
            after = up
        if np.array_equal(after, label):
            return label
        label = after


def search(off: np.ndarray, near: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, parent, nearest) of each node to the targets; -1 where there is none.

    Ties go to the smallest nearest target, then to the smallest parent.
    """
    n = len(off) - 1
    distance, parent, nearest = (np.full(n, -1, dtype=np.int64) for _ in range(3))
    distance[targets], nearest[targets] = 0, targets
    level, d = np.unique(targets), 0
    while len(level):
        d += 1
        size = off[level + 1] - off[level]
        at = np.arange(size.sum()) + np.repeat(off[level] - np.cumsum(size) + size, size)
        to, by = near[at], np.repeat(level, size)
        new = distance[to] < 0
        to, by = to[new], by[new]
        order = np.lexsort((by, nearest[by], to))
        to, by = to[order], by[order]
        first = np.ones(len(to), dtype=bool)
        first[1:] = to[1:] != to[:-1]
        level, by = to[first], by[first]
        distance[level], parent[level], nearest[level] = d, by, nearest[by]
    return distance, parent, nearest


def lists(blocks: np.ndarray) -> pa.Array:
    """Rows as Arrow lists of int."""
    n, k = blocks.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k) if k else np.zeros(n + 1), pa.int32()), pa.array(blocks.astype(np.int32).ravel()))


def alike(part: pa.RecordBatch | pa.Table) -> Iterator[tuple[tuple[int, int, bool], np.ndarray, np.ndarray]]:
    """((w, h, restricted), rows, blocks) of the rows of each kind of board: same size, mode and number of blocks."""
    lists_ = part.column("blocks")
    lists_ = lists_.combine_chunks() if isinstance(lists_, pa.ChunkedArray) else lists_
    off = np.asarray(lists_.offsets).astype(np.int64)
    flat, size = np.asarray(lists_.values).astype(np.int64), np.diff(off)
    w, h, r = (np.asarray(part.column(c)).astype(np.int64) for c in ("w", "h", "restricted"))
    kind = np.stack([w, h, r, size], axis=1)
    for one in np.unique(kind, axis=0) if len(kind) else ():
        rows = np.flatnonzero((kind == one).all(axis=1))
        yield (int(one[0]), int(one[1]), bool(one[2])), rows, flat[off[rows][:, None] + np.arange(one[3])]


def reached(most: int, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: board rows and what they reach, with expanded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for (w, h, restricted), rows, blocks in alike(part):
                found, owner, expanded = closure(blocks, rows, w, h, restricted, most, levels)
                for i in range(0, len(found), 50_000):
                    take = pa.array(owner[i : i + 50_000])
                    kept = [part.column(c).take(take) for c in part.schema.names if c != "blocks"]
                    names = [c for c in part.schema.names if c != "blocks"]
                    yield pa.RecordBatch.from_arrays([*kept, lists(found[i : i + 50_000]), pa.array(expanded[i : i + 50_000])], [*names, "blocks", "expanded"])

    return run


def solution(group: pa.Table) -> pa.Table:
    """Cluster, distance, next hop, nearest target and place on the path from a start, of all states of some classes.

    Rows: class, state_key, w, h, restricted, blocks, solved, start. A state's steps stay in its class.
    """
    group = group.sort_by([("class", "ascending"), ("state_key", "ascending")])
    n = group.num_rows
    owner = np.unique(np.asarray(group.column("class")), return_inverse=True)[1]
    src, dst = [], []
    for (w, h, restricted), rows, blocks in alike(group):
        row, after = steps(blocks, w, h, restricted)
        salt = 0
        while True:
            own = hashes(blocks, owner[rows], salt)
            order = np.argsort(own)
            if len(own) == len(np.unique(own)):
                break
            salt += 1  # two states with one hash
        at = np.searchsorted(own[order], hashes(after, owner[rows][row], salt))
        at = order[np.minimum(at, len(order) - 1)]
        known = (blocks[at] == after).all(axis=1) & (owner[rows][at] == owner[rows][row])
        src.append(rows[row[known]]), dst.append(rows[at[known]])
    src, dst = (np.concatenate(e) if e else np.zeros(0, dtype=np.int64) for e in (src, dst))
    off, near = compressed(n, src, dst)
    cluster = components(off, near)
    distance, parent, nearest = search(off, near, np.flatnonzero(np.asarray(group.column("solved"))))
    step = np.full(n, -1, dtype=np.int64)
    for at in np.flatnonzero(np.asarray(group.column("start"))).tolist():
        nth = 0
        while at >= 0 and distance[at] >= 0:
            step[at] = nth
            at, nth = int(parent[at]), nth + 1
    keys = group.column("state_key").combine_chunks()

    def key_of(i: np.ndarray) -> pa.Array:
        return keys.take(pa.array(np.maximum(i, 0), mask=i < 0))

    def number(v: np.ndarray) -> pa.Array:
        return pa.array(v.astype(np.int32), mask=v < 0)

    return pa.table({"board_id": group.column("board_id"), "state_key": keys, "cluster_id": key_of(cluster), "solved": group.column("solved"), "distance": number(distance), "parent": key_of(parent), "nearest": key_of(nearest), "step": number(step)})
