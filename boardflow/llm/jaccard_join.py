"""N-gram Jaccard join by PartEnum signatures.

A text's set is that of its word shingles. Two texts link when ``den * |A & B| >= num * |A | B|``. Then their
symmetric difference has at most ``k = (den - num) * (|A| + |B|) / (den + num)`` shingles. Sizes fall into
bands; within a band the domain of shingles is split into ``n1`` parts, each of these into ``n2``, and every choice of
``n2 - k2`` of the smaller ones is enumerated. What a set has in one such choice, hashed, is a signature. A shingle
that only one of two sets has spoils at most ``c`` of the ``m`` signatures, the choices that its part is in, so linked
sets share ``m - c * k`` at least. Hence each set needs to give only its first ``c * k + 1`` signatures in any order
that is the same for all. That order puts rare contents first: a signature is as rare as the rarest shingle in it, by
a count of shingles in a bounded sample (it orders, and decides nothing). So a passage that very many texts share
rarely signs. A set also signs for the next band where that can hold a partner.

Components come without all pairs of a group:

1. Texts with equal sets are one class.
2. All holders of a signature are compared with the smallest of them, their hub: pairs grow with the holders.
3. Where some holder does not link with the hub, and a signature has more holders, links beside the hub may exist. With D(x) the difference of x
   and its hub, ``D(x) ^ D(y) = x ^ y``: an x not linked with the hub shares a shingle of D(x) with each y it links
   with, and one of any ``k + 1`` of them. So only holders that share such a shingle are compared, in blocks.
4. Links go through connected components.

Most holders of a signature share a passage and no more. So texts are fetched only for what may link: each set has a
sketch, its shingles counted in ``SKETCH`` places by hash, and two sets differ by at least as much as their sketches.
A member that is too far by this from its hub isn't compared with it, and one too far from all others of its family
takes no part in step 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardflow.llm import textkernel as tk
from boardflow.llm.running import HOT, looked_up
from boardflow.operators.components import connected_components
from boardflow.plans.staging import discard, staged

U = np.uint64
#: In one flush of a task, holders of a signature beyond which only the smallest goes to the shuffle.
HOLDERS = 8
#: Parts that a band's domain is split into, against the fewest that could do: the more, the more choice what signs.
SPREAD = 2
#: Texts in the sample that tells rare shingles from common ones, and the size of its table of counts.
SAMPLE = 4_000
SEEN_BITS = 19
#: Bits of the filter that spares most texts the shuffle; where candidates fill it, it spares none and costs little.
FILTER_BITS = 23
FLUSH = 1 << 18
#: Signatures in a bucket, about: a worker sorts one bucket at a time.
IN_BUCKET = 1 << 21
#: Members of a hub that are compared with one copy of it; members of a family, or of a shared difference, in a block.
AROUND = 256
BLOCK = 256
#: Places of a sketch; a byte each, in which larger counts stand as 255.
SKETCH = 256
#: Blocks of a family beyond which its members meet only where they share a difference.
BLOCKS = 32


@lru_cache
def bands(num: int, den: int, most: int) -> np.ndarray:
    """Upper ends of the bands of sizes, up to ``most`` and one beyond."""
    wide, ends = max(1.5, (den / num) ** 2), [0]
    while len(ends) < 3 or ends[-2] < most:
        ends.append(max(ends[-1] + 1, int((ends[-1] + 1) * wide)))
    return np.array(ends, dtype=np.int64)


def differ(num: int, den: int, size: int | np.ndarray) -> int | np.ndarray:
    """Most shingles by which two linked sets differ whose sizes add up to ``size``."""
    return (den - num) * size // (den + num)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    s = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return s, np.diff(np.concatenate([s, [len(keys)]]))


def given(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many signatures sets of these sizes give, with two parts of which one is kept."""
    ends = bands(num, den, 1 << max(4, int(sizes.max(initial=1)).bit_length()))
    own = np.searchsorted(ends, sizes)
    far = differ(num, den, sizes + sizes * den // num)
    out = np.zeros(len(sizes), dtype=np.int64)
    for step in (0, 1):
        some = (sizes > 0) & ((step == 0) | (den * sizes >= num * (ends[own] + 1)))
        out += np.where(some, np.minimum(differ(num, den, 2 * ends[np.minimum(own + step, len(ends) - 1)]), far) + 1, 0)
    return out


def signatures(h: np.ndarray, off: np.ndarray, num: int, den: int, seen: np.ndarray, k2: int = 1, n2: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of sets given as sorted hashes and offsets; ``seen`` has the sample's counts, by hash."""
    sizes = np.diff(off)
    ends = bands(num, den, 1 << max(4, int(sizes.max(initial=1)).bit_length()))
    own = np.searchsorted(ends, sizes)
    spoils = comb(n2 - 1, n2 - k2 - 1)
    owners, found = [], []
    for step in (0, 1):
        some = np.flatnonzero((sizes > 0) & ((step == 0) | (den * sizes >= num * (ends[own] + 1))))
        if not len(some):
            continue
        band = own[some] + step
        k = differ(num, den, 2 * ends[band])
        n1 = np.where(k > 0, -(-SPREAD * (k + 1) // (k2 + 1)), 1)
        base = np.concatenate([[0], np.cumsum(n1)])
        n = sizes[some]
        at = np.arange(n.sum()) + np.repeat(off[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        e = tk.mix(h[at] ^ U(0x9E3779B97F4A7C15))
        first = ((e >> U(32)) * np.repeat(n1, n).astype(U) >> U(32)).astype(np.int64) + np.repeat(base[:-1], n)
        place = first * n2 + ((e & U(0xFFFFFFFF)) * U(n2) >> U(32)).astype(np.int64)
        parts = tk.sums(tk.mix(e), place, int(base[-1]) * n2).reshape(-1, n2)
        rare = np.full(int(base[-1]) * n2, 255, dtype=np.uint8)
        np.minimum.at(rare, place, seen[(h[at] >> U(64 - SEEN_BITS)).astype(np.int64)])
        rare = rare.reshape(-1, n2)
        part = np.arange(base[-1]) - np.repeat(base[:-1], n1)
        salt = tk.mix(np.repeat(band, n1).astype(U) << U(40) | part.astype(U))
        whole = np.repeat(k == 0, n1)  # sets that must be equal have one signature, of all parts
        owner = np.repeat(np.arange(len(some)), n1)
        sigs, keys, whose = [tk.mix(parts[whole].sum(axis=1) + salt[whole])], [rare[whole].min(axis=1)], [owner[whole]]
        for j, kept in enumerate(combinations(range(n2), n2 - k2)):
            kept = list(kept)
            sigs.append(tk.mix(parts[~whole][:, kept].sum(axis=1) + salt[~whole] + U(j)))
            keys.append(rare[~whole][:, kept].min(axis=1))
            whose.append(owner[~whole])
        sig, key, owner = np.concatenate(sigs), np.concatenate(keys), np.concatenate(whose)
        order = np.lexsort((key.astype(U) << U(56) | sig >> U(8), owner))
        starts, count = _runs(owner[order])
        rank = np.arange(len(order)) - np.repeat(starts, count)
        # no partner is larger than n * den / num, nor farther than that allows
        far = np.minimum(k, differ(num, den, n + n * den // num))
        first = order[rank <= (spoils * far)[owner[order]]]
        owners.append(some[owner[first]]), found.append(sig[first])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    return np.concatenate(owners), np.concatenate(found)


def sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tk.distinct(*tk.shingles(tk.words(column, tk.SPACED), n))


def _digests(n: int, num: int, den: int, share: int):
    """Size, signatures, digest and sketch of each set; of a sample of texts, share of 2**32, also the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            h, off = sets_of(part.column("text"), n)
            sizes = np.diff(off)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            a, b = (tk.sums(tk.mix(h ^ U(s)), owner, len(sizes)) for s in (0x1234567, 0x89ABCDEF01))
            both = np.stack([a, b], axis=1).tobytes()
            digest = pa.array([both[16 * i : 16 * i + 16] if s else None for i, s in enumerate(sizes.tolist())], pa.binary())
            counts = np.bincount(owner * SKETCH + (tk.mix(h ^ U(0x5EED)) % U(SKETCH)).astype(np.int64), minlength=len(sizes) * SKETCH)
            counts = np.minimum(counts, 255).astype(np.uint8).tobytes()
            sketch = pa.array([counts[SKETCH * i : SKETCH * (i + 1)] if s else None for i, s in enumerate(sizes.tolist())], pa.binary())
            drawn = (tk.mix(a) >> U(32)) < U(share)  # by content, so that copies weigh as one text or none
            some = pa.array([h[i:j].astype("<u8").tobytes() if d else None for i, j, d in zip(off[:-1].tolist(), off[1:].tolist(), drawn.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(given(sizes, num, den)), digest, sketch, some], ["doc_id", "n_shingles", "n_sigs", "digest", "sketch", "drawn"])

    return run


_SHIPPED = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("sigs", pa.binary()), ("x", pa.int64()), ("h", pa.int64())])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SEEN_BITS, dtype=np.uint16)
    for part in batches:
        for blob in part.column("drawn").to_pylist():  # a text has a shingle once
            at, n = np.unique((np.frombuffer(blob, "<u8") >> U(64 - SEEN_BITS)).astype(np.int64), return_counts=True)
            total[at] += np.minimum(n, 65535 - total[at]).astype(np.uint16)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])


def _seen(info: DataFrame) -> np.ndarray:
    """Counts of the sample's shingles by hash, as a logarithm in a byte: a table of 2**SEEN_BITS."""
    rows = info.where("drawn is not null").select("drawn").repartition(2).mapInArrow(tk.lean(_tallied), "counts binary").collect()
    total = np.zeros(1 << SEEN_BITS, dtype=np.uint32)
    for r in rows:
        total += np.frombuffer(r[0], "<u2")
    logs = np.minimum(4 * np.log2(1.0 + np.arange(1 << 16)), 254).astype(np.uint8)
    seen = logs[np.minimum(total, (1 << 16) - 1)]
    del rows, total
    tk.trim()
    return seen


def _shipped(n: int, num: int, den: int, buckets: int, seen: np.ndarray):
    """Signatures by bucket, in blobs; and pairs of holder and local hub of signatures with many holders here."""

    def flush(ids: list[np.ndarray], sigs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, sig = np.concatenate(ids), np.concatenate(sigs)
        order = np.lexsort((doc, sig))
        doc, sig = doc[order], sig[order]
        s, n_run = _runs(sig)
        many = np.repeat(n_run >= HOLDERS, n_run)
        if many.any():
            hub = np.repeat(doc[s], n_run)
            pairs = np.unique(np.stack([doc, hub], axis=1)[many & (doc != hub)], axis=0)
            for i in range(0, len(pairs), 10_000):
                p, none = pairs[i : i + 10_000], pa.nulls(len(pairs[i : i + 10_000]), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), none, none, pa.array(p[:, 0]), pa.array(p[:, 1])], schema=_SHIPPED)
            first = np.zeros(len(doc), dtype=bool)
            first[s] = True
            # the hub goes twice: it stands for its holders, and with any other holder elsewhere they are a crowd
            kept, twice = ~many | first, many & first
            doc, sig = np.concatenate([doc[kept], doc[twice]]), np.concatenate([sig[kept], sig[twice]])
        bucket = (sig >> U(16)).astype(np.int64) % buckets
        order = np.lexsort((doc, bucket))
        doc, sig, bucket = doc[order], sig[order], bucket[order]
        s, n_run = _runs(bucket)
        out = []
        for a, m in zip(s.tolist(), n_run.tolist(), strict=True):
            # differences of sorted ids are small and six bytes of a signature are enough: what they confuse is told apart later
            out.append((int(bucket[a]), np.diff(doc[a : a + m], prepend=0).astype("<i8").tobytes(), sig[a : a + m].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
        none = pa.nulls(len(out), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary()), none, none], schema=_SHIPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sigs, held = [], [], 0
        for part in tk.slices(batches, "text"):
            h, off = sets_of(part.column("text"), n)
            owner, sig = signatures(h, off, num, den, seen)
            ids.append(np.asarray(part.column("doc_id"))[owner])
            sigs.append(sig)
            held += len(sig)
            if held >= FLUSH:
                yield from flush(ids, sigs)
                ids, sigs, held = [], [], 0
        if held:
            yield from flush(ids, sigs)

    return run


def _hubs(group: pa.Table) -> pa.Table:
    """(x, hub, crowd) of the holders of each signature in a bucket; crowd: there are others beside the two, here or with a local hub."""
    doc = np.concatenate([np.cumsum(np.frombuffer(b, dtype="<i8")) for b in group.column("ids").to_pylist()])
    six = np.concatenate([np.frombuffer(b, dtype=np.uint8).reshape(-1, 6) for b in group.column("sigs").to_pylist()])
    sig = np.zeros((len(six), 8), dtype=np.uint8)
    sig[:, :6] = six
    sig = sig.view("<u8").ravel()
    order = np.lexsort((doc, sig))
    doc, sig = doc[order], sig[order]
    s, n = _runs(sig)
    hub = np.repeat(doc[s], n)
    pairs = np.unique(np.stack([doc, hub, np.repeat(n > 2, n)], axis=1)[doc != hub], axis=0)
    return pa.table({"x": pa.array(pairs[:, 0], pa.int64()), "h": pa.array(pairs[:, 1], pa.int64()), "crowd": pa.array(pairs[:, 2] > 0, pa.bool_())})


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SKETCH).astype(np.int16)


def _may(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m shingles may link: they differ by at least as much as their sketches a and b do."""
    apart = np.abs(a - b).sum(axis=1, dtype=np.int64)
    return den * (n + m - apart) >= num * (n + m + apart)


def _near(num: int, den: int):
    """Rows sorted by (hub, salt) with the hub's own row first: (h, x) of members that may link with their hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = (-1, -1, 0, np.zeros(SKETCH, dtype=np.int16))
        for part in batches:
            if not part.num_rows:
                continue
            h, salt, x, n = (np.asarray(part.column(c)) for c in ("h", "salt", "x", "n"))
            sketch = _sketches(part.column("sketch"))
            # the batch with the last hub before it in front
            key = np.concatenate([[hub[:2]], np.stack([h, salt], axis=1)])
            size, all_ = np.concatenate([[hub[2]], n]), np.concatenate([[hub[3]], sketch])
            at = np.maximum.accumulate(np.concatenate([[0], np.where(x == h, np.arange(1, len(x) + 1), 0)]))
            hub = (*key[at[-1]].tolist(), size[at[-1]], all_[at[-1]])
            at = at[1:]
            assert (key[at] == key[1:]).all(), "the hub's row comes first"
            near = _may(sketch, all_[at], n, size[at], num, den)
            yield part.select(["h", "x"]).filter(pa.array(near & (x != h)))

    return run


def _alive(num: int, den: int):
    """Rows sorted by (h, blocks): (h, x) of members that may link with one of their family in another component."""

    def some(h: int, rows: list[tuple]) -> pa.RecordBatch:
        x, side, n, c = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        sketch = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8).reshape(-1, SKETCH).astype(np.int16)
        found = np.zeros(len(rows), dtype=bool)
        for i in np.flatnonzero(side != 2).tolist():  # 0: one block against itself
            others = np.flatnonzero(side == 2) if side[i] else np.arange(i + 1, len(rows))
            others = others[c[others] != c[i]]
            good = others[_may(sketch[others], sketch[i], n[others], n[i], num, den)]
            found[good] = True
            found[i] |= len(good) > 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(found.sum(), h)), pa.array(x[found])], ["h", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for part in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            out = []
            for g, *row in zip(zip(*(part.column(c).to_pylist() for c in ("h", "blocks")), strict=True), *(part.column(c).to_pylist() for c in ("x", "side", "n", "c", "sketch")), strict=True):
                if g != now:
                    out += [some(now[0], held)] if len(held) > 1 else []
                    held, now = [], g
                held.append(row)
            yield from out
        if len(held) > 1:
            yield some(now[0], held)

    return run


def _compared(n: int, num: int, den: int):
    """Rows sorted by (hub, salt) with the hub's own row first: each member against its hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, now = np.zeros(0, dtype=U), None
        for part in tk.slices(batches, "text"):
            h, off = sets_of(part.column("text"), n)
            key = list(zip(part.column("h").to_pylist(), part.column("salt").to_pylist(), strict=True))
            x, m = part.column("x").to_pylist(), part.column("m").to_pylist()
            out = []
            for i, k in enumerate(key):
                own = h[off[i] : off[i + 1]]
                if x[i] == k[0]:
                    hub, now = own, k
                    continue
                assert now == k, "the hub's row comes first"
                at = np.searchsorted(hub, own)
                same = hub[np.minimum(at, len(hub) - 1)] == own
                inter = int(same.sum())
                linked = den * inter >= num * (len(own) + len(hub) - inter)
                delta = None
                if m[i] > 1:  # what the hub lacks comes first, as it is rarer in the family
                    lost = np.ones(len(hub), dtype=bool)
                    lost[at[same]] = False
                    delta = np.concatenate([own[~same], hub[lost]]).astype("<u8").tobytes()
                out.append((k[0], x[i], m[i], len(own), linked, delta))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["h", "x", "m", "n", "linked", "delta"])

    return run


def _prefixes(num: int, den: int):
    """(h, e, x) of the differences by which a member may be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out_h, out_x, out_u, out_e = [], [], [], []
            for h, x, n, loose, delta in zip(*(part.column(c).to_pylist() for c in ("h", "x", "n", "loose", "delta")), strict=True):
                d = np.frombuffer(delta, dtype="<u8")
                if loose:  # the largest partner has n * den / num shingles
                    d = d[: int(differ(num, den, n + n * den // num)) + 1]
                out_e.append(d.view(np.int64))
                out_h.append(np.full(len(d), h)), out_x.append(np.full(len(d), x)), out_u.append(np.full(len(d), loose))
            if out_e:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_h, out_e, out_x, out_u)], ["h", "e", "x", "loose"])

    return run


def _beside(num: int, den: int):
    """Rows sorted by (h, e, blocks): links of members apart from the hub to other components, as a forest of each group."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        sides = [[r for r in rows if r[2] != 2], [r for r in rows if r[2] != 1]]  # 0: one block against itself
        left = [r for r in sides[0] if r[4]]
        pairs = [(left, sides[1])]
        if any(r[2] for r in rows):
            pairs.append(([r for r in sides[1] if r[4]], sides[0]))
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = i = root[root[i]]
            return i

        found = []
        for few, many in pairs:
            if not few or not many:
                continue
            sets = [np.frombuffer(r[5], dtype="<u8") for r in many]
            size = np.array([len(s) for s in sets])
            codes = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(codes, kind="stable")
            codes, owner = codes[order], owner[order]
            n, c = (np.array([r[i] for r in many]) for i in (3, 6))
            for r in few:
                own = np.frombuffer(r[5], dtype="<u8")
                a, b = np.searchsorted(codes, own), np.searchsorted(codes, own, side="right")
                hit = np.concatenate([owner[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]) if len(own) else np.zeros(0, dtype=np.int64)
                apart = len(own) + size - 2 * np.bincount(hit, minlength=len(sets))
                good = (den * (n + r[3] - apart) >= num * (n + r[3] + apart)) & (c != r[6])
                for j in np.flatnonzero(good).tolist():
                    if (y := many[j][1]) != r[1] and (p := find(r[1])) != (q := find(y)):
                        root[p] = q
                        found.append((r[1], y))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["src", "dst"])

        for part in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            found = []
            for g, *row in zip(zip(*(part.column(c).to_pylist() for c in ("h", "e", "blocks")), strict=True), *(part.column(c).to_pylist() for c in ("h", "x", "side", "n", "loose", "delta", "c")), strict=True):
                if g != now:
                    found += links(held) if len(held) > 1 else []
                    held, now = [], g
                held.append(row)
            yield out(found)
        yield out(links(held) if len(held) > 1 else [])

    return run


def _infos(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    share = min(1 << 32, (SAMPLE << 32) // max(1, texts.count()))
    return staged(texts.mapInArrow(tk.lean(_digests(n, num, den, share)), "doc_id long, n_shingles long, n_sigs long, digest binary, sketch binary, drawn binary"), "sets")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tk.for_long_rows(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", info: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, links): (doc_id, n_shingles, rep, copies) of every row, and (src, dst) between representatives.

    Links join all that the threshold joins, though not by every pair: their components are those of all links. Ids
    are not null, and rows of one id have the same text.
    """
    texts = _texts(docs, id_col, text_col)
    info = _infos(texts, n, num, den) if info is None else info
    seen = _seen(info)
    # written, so that the join deals both sides anew
    reps = staged(info.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    total, sigs = info.agg(F.count("*"), F.sum("n_sigs")).first()
    alone = info.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("copies"))
    known = looked_up(info.where("digest is not null").select("doc_id", "n_shingles", "digest"), reps, "digest", "copies", total)
    classes = staged(known.select("doc_id", "n_shingles", "rep", "copies").unionByName(alone), "classes")
    ids = texts.where("doc_id is not null and text is not null")
    buckets = max(64, -(-(sigs or 0) // IN_BUCKET))
    shipped = ids.mapInArrow(tk.lean(_shipped(n, num, den, buckets, seen)), "bucket long, ids binary, sigs binary, x long, h long")
    bucket = F.coalesce("bucket", F.lit(-1) - F.pmod(F.xxhash64("x", "h"), F.lit(buckets)))
    both = staged(shipped.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_local_or_global, "x long, h long, crowd boolean, local boolean"), "hubs")
    local, far = both.where("local").select("x", "h", "crowd").distinct(), both.where("not local").select("x", "h", "crowd").distinct()
    through = local.join(far.select(F.col("x").alias("h"), F.col("h").alias("top")).distinct(), "h").select("x", F.col("top").alias("h"), "crowd")
    holders = local.unionByName(far).unionByName(through)
    to = classes.select("doc_id", "rep").distinct()
    # copies hold the same signatures: they are one row of each hub before hubs are looked up
    holders = holders.join(to.toDF("x", "rx"), "x").groupBy("rx", "h").agg(F.max("crowd").alias("crowd"))
    pairs = holders.join(to.toDF("h", "rh"), "h").where("rx <> rh")
    holding = staged(pairs.groupBy(F.greatest("rx", "rh").alias("x"), F.least("rx", "rh").alias("h")).agg(F.max("crowd").alias("crowd")), "pairs")
    discard(both)
    near = _near_hubs(holding, info, num, den)
    rows, *used = _families(near.withColumn("crowd", F.lit(False)))
    compared = _against_hubs(ids, rows, n, num, den)
    stars = staged(compared.where("linked").select(F.col("x").alias("src"), F.col("h").alias("dst")), "stars")
    discard(near, compared, *used)
    # beside the hubs: members that the stars leave apart from their hub, against the others of the family
    crowds = _crowds(holding.where("crowd").select("h", "x"), staged(connected_components(stars).toDF("node", "c"), "connected"))
    alive = _sifted(crowds, info, num, den)
    rows, *used = _families(alive.where("x <> h").withColumn("crowd", F.lit(True)))
    compared = _against_hubs(ids, rows, n, num, den)
    more = compared.where("linked").select(F.col("x").alias("src"), F.col("h").alias("dst"))
    held = ["h", "e", "x", "n", "loose", "delta", "c"]
    family = compared.where("delta is not null").join(alive, ["h", "x"]).withColumn("loose", F.col("apart") & ~F.col("linked"))
    family, sizes = _sized(family.select("h", "x", "n", "loose", "delta", "c"), ["h"], "loose")
    small = family.where(~_heavy()).withColumn("e", F.lit(0).cast("long")).select(*held, "go", "gc")
    large = family.where(_heavy())
    found = large.mapInArrow(tk.lean(_prefixes(num, den)), "h long, e long, x long, loose boolean")
    spots, spot_sizes = _sized(found, ["h", "e"], "loose")
    spots = spots.select("h", "e", "x", "go", "gc").join(large.select("h", "x", "n", "loose", "delta", "c"), ["h", "x"])
    spots = _in_blocks(small.unionByName(spots.select(*held, "go", "gc")), "loose")
    spots = spots.select("h", "e", "blocks", "x", "side", "n", "loose", "delta", "c")
    beside = spots.repartition("h", "e", "blocks").sortWithinPartitions("h", "e", "blocks").mapInArrow(tk.lean(_beside(num, den)), "src long, dst long")
    links = staged(stars.unionByName(more).unionByName(beside).distinct(), "edges")
    discard(holding, stars, crowds, alive, compared, sizes, spot_sizes, *used)
    return classes, links


def _against_hubs(texts: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The members of :func:`_families` against their hub's text: whether they link, and their differences where m > 1."""
    chosen = _of(texts, rows)
    chosen = chosen.groupBy(F.col("doc_id").alias("x")).agg(F.first("text").alias("text"))
    compared = _by_hub(rows, chosen).select("h", "salt", "x", "m", "text")
    return staged(compared.mapInArrow(tk.lean(_compared(n, num, den)), "h long, x long, m long, n long, linked boolean, delta binary"), "compared")


def _families(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, salt, x, m): the members of a hub, in groups of at most about AROUND, with the hub's row in each; and what was written for it.

    m is the number of members that others beside the hub may link with, 0 for the rest.
    """
    # written, so that the join deals both sides anew and a hub of very many holders can be split
    sizes = staged(pairs.groupBy("h").agg(F.count("*").alias("all"), F.count(F.when(F.col("crowd"), 1)).alias("m")), "sizes")
    salts = F.ceil(F.col("all") / AROUND).cast("int")
    members = pairs.join(sizes, "h").select("h", "x", F.when(F.col("crowd"), F.col("m")).otherwise(0).alias("m"), F.pmod(F.xxhash64("x"), salts).cast("int").alias("salt"))
    heads = sizes.select("h", F.col("h").alias("x"), "m", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return members.unionByName(heads), sizes


def _of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows, by their doc_id, of all that :func:`_families` has."""
    wanted = staged(members.select(F.col("x").alias("doc_id")).distinct(), "wanted")
    # rows are dealt by id at every size: a plan that turns from broadcast to shuffle has no proportion to its input
    return _perhaps(rows, wanted).join(wanted.hint("merge"), "doc_id")  # not a semi-join: that would be moved below the filter


def _by_hub(members: DataFrame, rows: DataFrame) -> DataFrame:
    return members.join(rows, "x").repartition("h", "salt").sortWithinPartitions("h", "salt", F.col("x") != F.col("h"))


def _sized(rows: DataFrame, by: list[str], flag: str) -> tuple[DataFrame, DataFrame]:
    """The rows of groups that have the flag at some of several members, with go and gc: blocks of those with it and without; and what was written for it."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("m"), F.count(F.when(F.col(flag), 1)).alias("o")).where("m > 1 and o > 0")
    sizes = staged(counts.select(*by, *(F.ceil(c / BLOCK).cast("long").alias(g) for c, g in ((F.col("o"), "go"), (F.col("m") - F.col("o"), "gc")))), "sizes")
    return rows.join(sizes, by), sizes


def _heavy() -> Column:
    """Whether members meet more than BLOCKS blocks each on average, as :func:`_in_blocks` has them meet."""
    go, all_ = F.col("go"), F.col("go") + F.col("gc")
    return go * all_ + F.col("gc") * go > BLOCKS * all_


def _in_blocks(rows: DataFrame, flag: str) -> DataFrame:
    """Rows in a block of those with the flag or of those without, once for each block met: those without meet only those with it.

    blocks = (a, b), a <= b, side 1 for a, 2 for b, 0 for a block with itself.
    """
    spread, all_ = F.xxhash64("x"), F.col("go") + F.col("gc")
    rows = rows.withColumn("o", F.when(F.col(flag), F.pmod(spread, "go")).otherwise(F.col("go") + F.pmod(spread, F.greatest("gc", F.lit(1)))))
    last = F.when(F.col(flag), all_).otherwise(F.col("go")) - 1
    meet = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda j: F.struct((F.least(j, F.col("o")) * all_ + F.greatest(j, F.col("o"))).alias("blocks"), F.when(j == F.col("o"), 0).when(F.col("o") < j, 1).otherwise(2).alias("side")))
    return rows.withColumn("b", F.explode(meet)).select("*", "b.blocks", "b.side")


def _sketched(info: DataFrame, members: DataFrame) -> DataFrame:
    """(x, n, sketch) of all that the members have."""
    sets = _of(info.where("sketch is not null").select("doc_id", "n_shingles", "sketch"), members)
    return sets.groupBy(F.col("doc_id").alias("x")).agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))


def _near_hubs(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, h) of which x may link with h."""
    rows, sizes = _families(pairs)
    near = _by_hub(rows, _sketched(info, rows)).select("h", "salt", "x", "n", "sketch")
    near = staged(near.mapInArrow(tk.lean(_near(num, den)), "h long, x long"), "near")
    discard(sizes)
    return near


def _crowds(held: DataFrame, connected: DataFrame) -> DataFrame:
    """(h, x, c, apart): the members of families that are not all in one component; x is in component c, apart if that isn't h's.

    Near copies of one text hold many signatures with as many hubs, and each pair of them would meet in many of these
    families. So families in which the same component is the most common are made one, around a hub in that component
    or its smallest text, where that makes fewer pairs; a pair that met in one of them meets there.
    """
    held = held.join(connected.toDF("h", "own"), "h", "left").join(connected.toDF("x", "c"), "x", "left")
    held = staged(held.select("h", "x", F.coalesce("own", "h").alias("own"), F.coalesce("c", "x").alias("c")), "held")
    m, cost, home = F.count("*").alias("m"), (F.col("o") + BLOCK) * F.col("m"), F.col("c") == F.col("own")
    each = held.groupBy("h", "own", "c").agg(m).groupBy("h", "own")
    # the hub itself is one of its component
    each = each.agg(F.sum("m").alias("m"), F.sum(F.when(home, 0).otherwise(F.col("m"))).alias("o"), F.max(F.struct((F.col("m") + home.cast("int")).alias("n"), home.alias("home"), (-F.col("c")).alias("c"))).alias("top"))
    each = staged(each.select("h", "own", "m", "o", F.when(F.col("top.n") > 1, -F.col("top.c")).otherwise(F.col("own")).alias("f")), "each")
    inside = F.when(F.col("own") == F.col("f"), F.struct((F.col("m") - F.col("o")).alias("n"), (-F.col("h")).alias("h")))
    single = each.groupBy("f").agg(F.sum(F.when(F.col("o") > 0, cost).otherwise(0)).alias("single"), F.max(inside).alias("top"))
    named = staged(held.join(each.select("h", "f"), "h"), "named")
    one = named.select("f", "x", "c").distinct().groupBy("f").agg(m, F.count(F.when(F.col("c") != F.col("f"), 1)).alias("o")).where("o > 0")
    plan = staged(one.join(single, "f").select("f", F.when(cost <= F.col("single"), F.coalesce(-F.col("top.h"), F.col("f"))).alias("pivot")), "plan")
    mixed = F.col("c") != F.when(F.col("pivot").isNull(), F.col("own")).otherwise(F.col("f"))
    found = staged(named.join(plan, "f").select(F.coalesce("pivot", "h").alias("h"), "x", "c", mixed.alias("apart")).distinct(), "crowds")
    discard(held, each, named, plan, connected)
    return found


def _sifted(crowds: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The members of :func:`_crowds` that may link with one of their family in another component.

    Families whose members meet in more than BLOCKS blocks keep all.
    """
    family, sizes = _sized(crowds, ["h"], "apart")
    some = family.where(~_heavy())
    spots = _in_blocks(some.join(_sketched(info, some), "x"), "apart").select("h", "blocks", "x", "side", "n", "c", "sketch")
    alive = spots.repartition("h", "blocks").sortWithinPartitions("h", "blocks").mapInArrow(tk.lean(_alive(num, den)), "h long, x long")
    alive = staged(alive.distinct().join(crowds, ["h", "x"]).unionByName(family.where(_heavy()).select("h", "x", "c", "apart")), "sifted")
    discard(sizes)
    return alive


def _perhaps(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among ``ids``, by one bit of a table of 2**FILTER_BITS: 2 MB to broadcast at most."""

    def spot(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c), F.lit("filter")), F.lit(1 << FILTER_BITS))

    words = ids.select(F.shiftright(spot("doc_id"), 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id, 'filter'), 64) as int))").alias("bit"))
    table = F.broadcast(words.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    asked = rows.withColumn("word", F.shiftright(spot("doc_id"), 6))
    return asked.join(table, "word").where("shiftright(bits, cast(pmod(xxhash64(doc_id, 'filter'), 64) as int)) & 1L = 1").select(*rows.columns)


def _local_or_global(key: tuple, group: pa.Table) -> pa.Table:
    if key[0].as_py() < 0:
        yes = pa.array([True] * group.num_rows, pa.bool_())
        return group.select(["x", "h"]).append_column("crowd", yes).append_column("local", yes)
    out = _hubs(group)
    return out.append_column("local", pa.array([False] * out.num_rows, pa.bool_()))


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest id that links reach, the own one included. Null or empty texts and texts without
    words have no shingles and stay alone. A row without an id has the component of its text, null if that holds no
    id. Repeated rows come back as often; if an id has several texts, each is linked by itself. Very long texts are
    compared whole. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    texts = _texts(docs, id_col, text_col)
    info = _infos(texts, n, num, den)
    ids = info.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    if ids.where("doc_id is null or a <> b").isEmpty():
        return _components(texts, info, n, num, den)
    # ids don't name texts: rows are numbered, and components named by their ids afterwards
    rows = staged(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.col("row").alias("doc_id"), "text")
    found = staged(_components(keyed, _infos(keyed, n, num, den), n, num, den).toDF("row", "n_shingles", "c").join(rows.select("row", "doc_id"), "row"), "found")
    names = found.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    return looked_up(found, staged(names, "names"), "c", "members", found.count()).select("doc_id", "n_shingles", "component_id")


def _components(texts: DataFrame, info: DataFrame, n: int, num: int, den: int) -> DataFrame:
    classes, links = jaccard_links(texts, n, num, den, "doc_id", "text", info)
    found = staged(connected_components(links).toDF("rep", "component_id"), "components")
    total = info.count()
    # a text with 1 / HOT of the rows as its copies is one of HOT at most
    hot = F.col("copies") * HOT >= total
    often = classes.where(hot).select("rep").distinct().hint("broadcast")
    many = classes.where(hot).join(F.broadcast(found.join(often, "rep")), "rep", "left")
    few = classes.where(~hot).join(found.hint("merge"), "rep", "left")
    return many.unionByName(few).select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
