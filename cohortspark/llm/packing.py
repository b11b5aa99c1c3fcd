"""Texts packed into training sequences of one fixed capacity, measured in tokens.

The instance is compressed to the number of pieces of each size, at most one entry for each
token of the capacity, whatever the number of documents. Martello and Toth's dominance
criterion permanently fixes sets of up to three pieces that provably dominate every other
way to place their largest piece; best-fit decreasing packs the rest. Both work on whole
groups of equal sequences, so the plan is small and only its use is distributed.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.storage import stored

CAPACITY = 2048
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer of RANKS parts a text before it joins bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Pattern = tuple[tuple[int, int], ...]  # size and multiplicity of the pieces of a sequence, largest first


@dataclass(frozen=True)
class Plan:
    """groups: number of sequences and their pattern; n_fixed: sequences fixed by dominance."""

    groups: list[tuple[int, Pattern]]
    n_fixed: int


def _dominating(j: int, sizes: list[int], counts: dict[int, int], capacity: int) -> Pattern | None:
    """A set of at most three pieces with ``j`` that dominates every feasible set with ``j``, or None if none is proven.

    ``sizes``: the sizes that are left, ascending. A set dominates another if the pieces of the other can be parted
    so that each part fits in the place of one piece of the set.
    """
    room = capacity - j

    def left(size: int, taken: int = 0) -> int:
        return counts[size] - (size == j) - taken

    smallest: list[int] = []
    for s in sizes:
        smallest += [s] * min(3 - len(smallest), max(0, left(s)))
        if len(smallest) == 3 or s > room:
            break
    if not smallest or smallest[0] > room:
        return ((j, 1),)
    at = bisect_right(sizes, room) - 1
    if left(sizes[at]) < 1:
        at -= 1
    r = sizes[at]
    if r == room or len(smallest) < 2 or sum(smallest[:2]) > room:
        return _pattern(j, r)
    if len(smallest) > 2 and sum(smallest) <= room:
        return None
    best, low, high = (0, 0, 0), 0, at
    while low <= high:
        a, b = sizes[high], sizes[low]
        if a + b > room:
            high -= 1
            continue
        if left(a, int(a == b)) > 0 and left(b) > 0 and a + b > best[0]:
            best = (a + b, a, b)
        low += 1
    total, a, b = best
    if r >= total:
        return _pattern(j, r)
    above = [s for s in sizes[bisect_right(sizes, b) :] if left(s) > 0][:2]
    no_larger_second = not above or (2 * above[0] > room if left(above[0]) > 1 else len(above) < 2 or sum(above) > room)
    return _pattern(j, a, b) if a == r and no_larger_second else None


def _pattern(*pieces: int) -> Pattern:
    return tuple((s, pieces.count(s)) for s in sorted(set(pieces), reverse=True))


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Sequences for pieces counted by size (1 to ``capacity``)."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("a piece is empty or larger than the capacity")
    groups: list[tuple[int, Pattern]] = []
    sizes = sorted(counts)
    changed = True
    while changed:
        changed = False
        for j in sorted(sizes, reverse=True):
            while counts.get(j, 0) > 0 and (found := _dominating(j, sizes, counts, capacity)):
                times = min(counts[s] // m for s, m in found)
                groups.append((times, found))
                changed = True
                for s, m in found:
                    counts[s] -= m * times
                    if not counts[s]:
                        del counts[s]
                        del sizes[bisect_left(sizes, s)]
    fixed = sum(n for n, _ in groups)
    return Plan(groups + _best_fit(counts, capacity), fixed)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing over groups of equal open sequences."""
    open_at: dict[int, list[tuple[int, Pattern]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, pattern: Pattern) -> None:
        if n:
            if room not in open_at:
                insort(rooms, room)
                open_at[room] = []
            open_at[room].append((n, pattern))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, n, pattern = capacity, left, ()
            else:
                room = rooms[at]
                n, pattern = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    del rooms[at]
            each = room // size
            full = min(n, left // each)
            put(room - each * size, full, (*pattern, (size, each)))
            left -= full * each
            rest = n - full if pattern else min(1, left)
            if rest and left:
                put(room - left * size, 1, (*pattern, (size, left))) if left < each else None
                rest, left = rest - 1, 0
            if pattern:
                put(room, rest, pattern)
    return [g for room in rooms for g in open_at[room]]


def token_counts(documents: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens of whole texts; null and empty texts have 0. Texts of special tokens are ordinary text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_tokens bigint")


def packed(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its place: doc_id, piece_no, token_start, n_tokens, sequence_id, sequence_start.

    ``sizes``: doc_id, n_tokens. A text is split only if it exceeds the capacity, into full sequences and a rest.
    Texts without tokens take no place and give no row. Pieces of a size are numbered by doc_id through a range
    sort, which splits a size that a third of all pieces share; the plan's intervals say which numbers go where.
    The plan is bounded by the capacity: fewer than three groups for each size.
    """
    spark = sizes.sparkSession
    sizes = stored(sizes.where("n_tokens > 0").select("doc_id", "n_tokens"), "token-counts")  # the range sort reads them twice
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(capacity).cast("bigint"))).alias("token_start")
    pieces = sizes.select("doc_id", "n_tokens", start).select("doc_id", (F.col("token_start") / capacity).cast("int").alias("piece_no"), "token_start", F.least(F.lit(capacity), F.col("n_tokens") - F.col("token_start")).cast("int").alias("n_tokens"))
    order = ["n_tokens", "doc_id", "piece_no"]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = stored(pieces.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), within.alias("within")), "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in ranked.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    parts = sorted((r["part"], r["n"]) for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect())
    before = dict(zip([p for p, _ in parts], np.cumsum([0, *(n for _, n in parts)]).tolist()[:-1], strict=True))
    smaller = dict(zip(sorted(histogram), np.cumsum([0, *(histogram[s] for s in sorted(histogram))]).tolist()[:-1], strict=True))
    held = spark.sparkContext.broadcast((before, smaller, _places(plan(histogram, capacity))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, smaller, places = held.value
        for batch in batches:
            size = batch["n_tokens"].to_numpy(np.int64)
            rank = batch["part"].map(before).to_numpy(np.int64) + batch["within"].to_numpy(np.int64) - np.array([smaller[s] for s in size.tolist()], np.int64)
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                first, first_sequence, times, base = places[int(s)]
                at = np.searchsorted(first, rank[mine], "right") - 1
                step = rank[mine] - first[at]
                sequence[mine] = first_sequence[at] + step // times[at]
                offset[mine] = base[at] + step % times[at] * s
            yield pd.DataFrame({"doc_id": batch["doc_id"], "piece_no": batch["piece_no"], "token_start": batch["token_start"], "n_tokens": batch["n_tokens"], "sequence_id": sequence, "sequence_start": offset})

    return ranked.mapInPandas(place, "doc_id bigint, piece_no int, token_start bigint, n_tokens int, sequence_id bigint, sequence_start bigint")


def _places(found: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size the intervals of piece numbers: first number, first sequence, pieces a sequence, place in the sequence."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, pattern in found.groups:
        base = 0
        for size, times in pattern:
            rows.setdefault(size, []).append((used.get(size, 0), sequence, times, base))
            used[size] = used.get(size, 0) + n * times
            base += size * times
        sequence += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


def fill_report(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_sequences, n_tokens, least_sequences (no packing needs fewer), unused_share; one row, also for no pieces."""
    total = rows.agg(F.countDistinct("sequence_id").alias("n_sequences"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    room = F.col("n_sequences") * capacity
    return total.select("n_sequences", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_sequences"), F.when(room > 0, 1 - F.col("n_tokens") / room).otherwise(0.0).alias("unused_share"))
