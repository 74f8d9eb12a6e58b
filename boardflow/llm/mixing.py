"""Mixing sources to target weights by min-cost flow.

Rows are first summed up by the pattern of sources they belong to. A flow network leads from the patterns to their
sources: a pattern gives its words once at no cost, once more at cost 1, again at cost 2 and so on, up to a cap, so
costs are convex; a source takes words up to its target. The network has a node per pattern and per source, whatever
the number of rows; it is solved on the driver, in whole words. Cheap passes are used up first, so that no pattern
repeats while another of the same source could still be read for the first time.

Within a pattern, documents are ordered by a seeded hash; the first of them get the pass that doesn't reach all.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardflow.llm.running import IN_BUCKET, starts
from boardflow.plans.staging import staged

WORDS = r"[^\x20\x09-\x0D]+"
#: Patterns that the driver takes: about 100 MB. Sources are named by people; combinations that occur are few.
MAX_PATTERNS = 200_000


def water_fill(weights: Sequence[float], caps: Sequence[float], total: float) -> list[float]:
    """Shares of ``total`` by weight, none above its cap; what a cap cuts off is shared by weight among the others."""
    out, open_ = [0.0] * len(caps), [i for i, (w, c) in enumerate(zip(weights, caps, strict=True)) if w > 0 and c > 0]
    left = min(float(total), float(sum(caps[i] for i in open_)))
    open_.sort(key=lambda i: caps[i] / weights[i])
    weight = float(sum(weights[i] for i in open_))
    for n, i in enumerate(open_):
        if caps[i] * weight <= left * weights[i] * (1 + 1e-12):
            out[i] = float(caps[i])
            left -= out[i]
            weight -= weights[i]
        else:
            for j in open_[n:]:
                out[j] = left * weights[j] / weight
            break
    return out


class _Flow:
    """Dinic's maximum flow, kept between phases."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        return len(self.to) - 2

    def push(self, s: int, t: int) -> None:
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if t not in level:
                return
            at = [0] * len(self.out)
            while True:  # one augmenting path after another, without recursion
                path, a = [], s
                while a != t:
                    while at[a] < len(self.out[a]):
                        e = self.out[a][at[a]]
                        if self.room[e] and level.get(self.to[e]) == level[a] + 1:
                            break
                        at[a] += 1
                    else:
                        if not path:
                            break
                        a = self.to[path.pop() ^ 1]
                        at[a] += 1
                        continue
                    path.append(e)
                    a = self.to[e]
                if a != t:
                    break
                got = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= got
                    self.room[e ^ 1] += got


def route(patterns: dict[tuple, int], quotas: dict, max_repeat: int) -> dict[tuple, int]:
    """Words that each pattern gives so that the quotas are met as far as can be, at the least cost of repetition.

    Passes are added from the cheapest on. A path of the residual network never runs back into its start, so a
    maximum flow after each pass is a cheapest one.
    """
    keys, names = sorted(patterns, key=repr), list(quotas)
    number = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    flow = _Flow(2 + len(keys) + len(names))
    gives = [flow.add(0, 2 + i, 0) for i in range(len(keys))]
    for i, k in enumerate(keys):
        for s in k:
            if s in number:
                flow.add(2 + i, number[s], max_repeat * patterns[k])
    for s in names:
        flow.add(number[s], 1, quotas[s])
    for _ in range(max_repeat):
        for i, k in enumerate(keys):
            flow.room[gives[i]] += patterns[k]
        flow.push(0, 1)
    return {k: flow.room[e ^ 1] for k, e in zip(keys, gives, strict=True)}


def cycled(values: Sequence[float]) -> Callable[[list], list[float]]:
    """Weights for sources in code-point order, null last, repeating."""
    return lambda sources: [values[i % len(values)] for i in range(len(sources))]


def mix(
    docs: DataFrame,
    sources: Column | str = "source",
    weights: Callable[[list], list[float]] = cycled((3, 1, 2)),
    budget: float = 1.5,
    max_repeat: int = 2,
    seed: int = 17,
    whole: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pattern) of every row.

    ``sources`` is a source or an array of them (overlapping sources); null is a source of its own, an empty array
    none, and then nothing is taken. Size counts words, none in a null text. The sources share ``budget`` times all
    sizes by weight, each at most ``max_repeat`` times its own size. taken is the number of words the mix reads of a
    row, repeats counted, at most ``max_repeat`` times its size. The last row that a pass reaches is cut, so that the
    quotas are met to the word; with ``whole`` it is taken whole if at least half of it is reached, else left out.
    source_size and target are sums over the row's sources. Rows without an id take part. Repeated rows count as rows;
    ties in the seeded order are between rows alike. A very long text is one row as others. Other columns are not
    looked at. An empty table gives no rows. Reruns agree.
    """
    got = F.col(sources) if isinstance(sources, str) else sources
    kind = docs.select(got.alias("s")).schema["s"].dataType.typeName()
    members = F.coalesce(F.array_sort(F.array_distinct(got)), F.array(F.lit(None).cast("string"))) if kind == "array" else F.array(got)
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            members.cast("array<string>").alias("pattern"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col).cast("string")).alias("h"),
        ),
        "sizes",
    )
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} combinations of sources; sum them up further")
    patterns = {tuple(r["pattern"] or ()): r["size"] for r in found}
    names = sorted({s for k in patterns for s in k}, key=lambda s: (s is None, s or ""))
    size = {s: sum(v for k, v in patterns.items() if s in k) for s in names}
    given = water_fill(weights(names), [max_repeat * size[s] for s in names], budget * sum(patterns.values()))
    target = dict(zip(names, given, strict=True))
    takes = route(patterns, {s: round(t) for s, t in target.items()}, max_repeat)
    most = max((r["n"] for r in found), default=0)
    bits = min(32, max(6, math.ceil(math.log2(max(1, most) / IN_BUCKET)) if most > IN_BUCKET else 0))
    plan = [(list(k), n, float(sum(target[s] for s in k)), sum(size[s] for s in k), takes[k] // v if v else 0, takes[k] % v if v else 0) for n, (k, v) in enumerate(patterns.items())]
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(plan, "pattern array<string>, p int, target double, source_size long, full long, rest long"))
    rows = rows.alias("r").join(plan.alias("p"), F.col("r.pattern") == F.col("p.pattern")).select("r.*", "p.p", "p.target", "p.source_size", "p.full", "p.rest")
    # running sums in seeded order, first over buckets of hashes, then within each bucket
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sums = rows.groupBy("p", "bucket").agg(F.sum("size").alias("in_bucket"))
    within = Window.partitionBy("p", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("so_far", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts(sums, ["p"], "in_bucket", 1 << bits), ["p", "bucket"])
    reach = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("so_far")))
    extra = F.when(2 * reach >= F.col("size"), F.col("size")).otherwise(0) if whole else reach
    return rows.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + extra).cast("long").alias("taken"), "pattern")
