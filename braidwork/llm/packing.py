"""Fill containers of fixed capacity by bin completion.

Items are dealt by hash into groups of a bounded number of tokens and items, and each group is packed on its own. Within
a group best fit decreasing gives the incumbent; if it uses more containers than the lower bound, a branch-and-bound takes
the largest item left, enumerates the undominated fillings around it, tightest first, and prunes by the waste that a
better packing may still have. Fillings of a given waste are found by the sums that the sizes left can reach, kept as the
bits of a number, so no filling is looked at in vain and none is left out. A group whose search ends before its number of
containers is proved says so. Containers that a group leaves half empty are pooled and packed again.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import TOKENIZERS, VOCABULARY, token_count

#: Containers' worth of tokens, and items, in a group.
GROUP_CONTAINERS, GROUP_ITEMS = 256, 50_000
#: Fillings tried in one group's search; then the incumbent stands, marked as not proved.
NODES = 4000
#: A container filled less than this is packed again with those of other groups.
LOOSE = 0.97
#: Names of the rounds in which loose containers are pooled, as long as there is more than one group.
ROUNDS = ("b", "c", "d")


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by total size, and by items over half the capacity with what fits beside none."""
    best = -(-sum(sizes) // capacity)
    asc = sorted(sizes)
    total = [0]
    for x in asc:
        total.append(total[-1] + x)
    n = len(asc)
    over_half = bisect.bisect_right(asc, capacity // 2)
    for k in {0, *asc[:over_half]}:
        alone = bisect.bisect_right(asc, capacity - k)  # larger ones share with nothing of size k or more
        small = bisect.bisect_left(asc, k)
        big = n - alone
        half = alone - over_half
        rest = total[over_half] - total[small]
        free = half * capacity - (total[alone] - total[over_half])
        best = max(best, big + half + max(0, -(-(rest - free) // capacity)))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each size into the fullest container that still holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, container), ascending
    for x in sorted(sizes, reverse=True):
        at = bisect.bisect_left(room, (x, -1))
        if at == len(room):
            bins.append([x])
            left = (capacity - x, len(bins) - 1)
        else:
            space, b = room.pop(at)
            bins[b].append(x)
            left = (space - x, b)
        if left[0]:
            bisect.insort(room, left)
    return bins


def reachable(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """For each place in ``sizes`` the sums up to ``capacity`` of the sizes from there on, as bits of a number."""
    mask, out = (1 << capacity + 1) - 1, [1]
    for s, n in zip(reversed(sizes), reversed(counts)):
        bits, step, n = out[-1], 1, min(n, capacity // s)
        while n > 0:  # 1, 2, 4, ... and the rest of the copies make every number of them
            take = min(step, n)
            bits |= bits << take * s & mask
            n, step = n - take, 2 * step
        out.append(bits)
    return out[::-1]


def fillings(first: int, left: Counter, capacity: int, waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill a container around ``first`` from the sizes ``left``, tightest first, up to ``waste`` unused.

    A filling is dominated if one of its items, or two together, could be replaced by a larger left-out item that fits.
    """
    space = capacity - first
    sizes = sorted((s for s, n in left.items() if n > 0 and s <= space), reverse=True)
    counts, asc = [left[s] for s in sizes], sorted(s for s, n in left.items() if n > 0)
    sums = reachable(sizes, counts, space)

    def exact(at: int, rest: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
            return
        for j in range(at, len(sizes)):
            if not sums[j] >> rest & 1:
                return
            for n in range(min(counts[j], rest // sizes[j]), 0, -1):
                if sums[j + 1] >> rest - n * sizes[j] & 1:
                    for tail in exact(j + 1, rest - n * sizes[j]):
                        yield (sizes[j],) * n + tail

    def undominated(chosen: tuple[int, ...], unused: int) -> bool:
        used = Counter(chosen)
        spare = [s for s in asc if left[s] > used[s]]
        if spare and spare[0] <= unused:
            return False
        for s in {*chosen, *(a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :])}:
            at = bisect.bisect_right(spare, s + unused) - 1
            if at >= 0 and (spare[at] > s or spare[at] == s and s not in used):
                return False
        return True

    for unused in range(min(waste, space) + 1):
        if sums[0] >> space - unused & 1:
            for chosen in exact(0, space - unused):
                if undominated(chosen, unused):
                    yield chosen


def solve(sizes: list[int], capacity: int, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """(containers as lists of sizes, whether no packing has fewer). False only where the search ran out of ``nodes``."""
    best, bound = best_fit(sizes, capacity), lower_bound(sizes, capacity)
    if len(best) <= bound or not sizes:
        return best, True
    total, bins = sum(sizes), []

    def spare() -> int:  # what a packing with one container less than the best may waste in all
        return (len(best) - 1) * capacity - total

    def branch(left: Counter, waste: int) -> tuple:
        first = max(left)
        rest = left - Counter([first])
        return first, rest, waste, fillings(first, rest, capacity, spare() - waste)

    stack = [branch(Counter(sizes), 0)]
    while stack:
        first, rest, waste, options = stack[-1]
        fill = next(options, None)
        lost = waste + capacity - first - sum(fill or ())
        if fill is None or lost > spare():  # the fillings that follow waste as much or more
            stack.pop()
            del bins[max(0, len(stack) - 1) :]
            continue
        nodes -= 1
        if nodes < 0:
            return best, False
        left = rest - Counter(fill)
        if left:
            bins.append([first, *fill])
            stack.append(branch(left, lost))
        elif len(bins) + 1 < len(best):
            best = [*map(list, bins), [first, *fill]]
            if len(best) <= bound:
                return best, True
    return best, True


def pack(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of sizes, each at most ``capacity``. The fewest possible unless the search ran out of nodes."""
    return solve(sizes, capacity, nodes)[0]


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, least (containers that the tokens need), unused (share), not_proved (containers of groups
    whose search ended early)."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.min("proved").alias("proved")).where("tokens > 0")
    out = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.when(~F.col("proved"), 1)).alias("not_proved"))
    room = F.col("containers") * capacity
    return out.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.coalesce(F.round(1 - F.try_divide("tokens", room), 6), F.lit(0.0)).alias("unused"), "not_proved")


def _pack_group(capacity: int, tag: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        waiting: dict[int, list[int]] = {}
        for i, t in enumerate(rows["tokens"].tolist()):
            waiting.setdefault(t, []).append(i)
        for v in waiting.values():
            v.reverse()
        empties = waiting.pop(0, [])
        bins, proved = solve([t for t, v in waiting.items() for _ in v], capacity)
        at, fill = [0] * len(rows), [0] * len(rows)
        for b, content in enumerate(bins):
            full = sum(content)
            for t in content:
                i = waiting[t].pop()
                at[i], fill[i] = b, full
        for i in empties:
            fill[i] = sum(bins[0]) if bins else 0
        group = rows["grp"].iloc[0] if len(rows) else 0
        return rows.assign(container=[f"{tag}{group}-{b}" for b in at], filled=fill, proved=proved).drop(columns="grp")

    return run


def pack_documents(documents: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece_no, pieces, first_token, tokens, container, filled, proved: every piece of every document in its container.

    A document within the capacity is one piece. A larger one is cut into full containers and a remainder, which is
    packed like a document. Null and empty texts have 0 tokens and lie in some container. Rows with the same id are packed
    one by one. ``filled`` is the number of tokens in the container, ``proved`` whether the group it was packed in could not
    have had fewer. An empty input gives an empty table.
    """
    sizes = documents.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col), directory, vocabulary).cast("long").alias("size"))
    sizes = materialize(sizes.withColumn("row", F.monotonically_increasing_id()), "pack-sizes")
    full = F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(F.lit(0)).cast("long")
    cut = sizes.withColumn("whole", full).withColumn("rest", F.col("size") - F.col("whole") * capacity)
    cut = cut.withColumn("pieces", (F.col("whole") + ((F.col("rest") > 0) | (F.col("whole") == 0)).cast("long")).cast("int"))
    own = cut.where("whole > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("whole")))).select(
        "doc_id", F.col("piece_no").cast("int"), "pieces", ((F.col("piece_no") - 1) * capacity).cast("long").alias("first_token"), F.lit(capacity).cast("long").alias("tokens"),
        F.concat(F.lit("f-"), F.col("row").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container"), F.lit(capacity).cast("long").alias("filled"), F.lit(True).alias("proved"),
    )
    items = cut.where("rest > 0 or whole = 0").select("doc_id", (F.col("whole") + 1).cast("int").alias("piece_no"), "pieces", (F.col("whole") * capacity).cast("long").alias("first_token"), F.col("rest").alias("tokens"))
    schema = "doc_id long, piece_no int, pieces int, first_token long, tokens long, container string, filled long, proved boolean"

    def packed(rows: DataFrame, tag: str) -> tuple[DataFrame, int]:
        n, t = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        groups = max(1, -(-t // (capacity * GROUP_CONTAINERS)), -(-n // GROUP_ITEMS))
        dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(tag)), F.lit(groups)))
        return materialize(dealt.groupBy("grp").applyInPandas(_pack_group(capacity, tag), schema), "packed"), groups

    kept, (left, groups) = own, packed(items, "a")
    for tag in ROUNDS:
        if groups == 1:
            break
        kept = kept.unionByName(left.where(F.col("filled") >= LOOSE * capacity))
        left, groups = packed(left.where(F.col("filled") < LOOSE * capacity).drop("container", "filled", "proved"), tag)
    return kept.unionByName(left)
