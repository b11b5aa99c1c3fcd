"""Held-out test items found in a corpus: BM25 with block-max WAND, then verification in order.

The items form a small inverted index. Every document is cut into overlapping passages, each
passage is a query, and all items scoring above the threshold are retrieved, a threshold that
no passage with enough of an item's words can miss; a pair counts if the document holds at least ``share`` of the item's words in one stretch and in order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.words import Batch, word_batch
from cohortspark.operators.storage import stored

K1, B = 1.2, 0.75
#: Score from which on a passage is verified: 1, but for rounding.
ENOUGH = 1 - 1e-9
#: Postings of a block, whose highest score bounds what the block can add.
BLOCK = 8
#: Part of an item's words that a document must hold.
SHARE = 0.5
#: Words that may stand between, or be missing between, two words of one stretch.
GAP = 2
#: Passages searched at once, and cells of their table of words or items.
PASSAGES, CELLS = 2_000, 8_000_000
#: Test items indexed at once; more are searched in further passes of so many each.
SHARD = 20_000


class ItemIndex:
    """Inverted index of test items. The score of an item is BM25 divided by the least that ``share`` of its words can
    score, so a passage holding so many of them, whichever they are, scores at least 1.

    ``frequencies`` (word to number of items), ``n_items`` and ``mean`` length are those of all items, where these are
    only some of them, so that a score doesn't depend on the other items of an index.
    """

    def __init__(self, items: Iterable[tuple[int, list[str]]], share: float = SHARE, k1: float = K1, b: float = B, block: int = BLOCK, frequencies: dict[str, int] | None = None, n_items: int | None = None, mean: float | None = None):
        held = [(i, t) for i, t in sorted(items) if t]
        self.ids, self.texts = [i for i, _ in held], [t for _, t in held]
        self.longest = max(map(len, self.texts), default=0)
        mean = mean or sum(map(len, self.texts)) / max(1, len(self.texts))
        counts = [Counter(t) for t in self.texts]
        n_items, df = n_items or len(counts), frequencies or Counter(w for c in counts for w in c)
        idf = {w: math.log(1 + (n_items - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.words = sorted({w for c in counts for w in c})
        self.place = {w: k for k, w in enumerate(self.words)}
        at, item, weight = [], [], []
        for k, (c, t) in enumerate(zip(counts, self.texts, strict=True)):
            raw = {w: idf[w] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(t) / mean)) for w, n in c.items()}
            least = _least(raw, c, math.ceil(share * len(t)))
            at += [self.place[w] for w in raw]
            item += [k] * len(raw)
            weight += [x / least for x in raw.values()]
        # postings by word and item; blocks are runs of neighbouring items in a word's postings
        self.block = block
        self.item, self.weight, at = np.array(item, np.int64), np.array(weight), np.array(at, np.int64)
        order = np.lexsort((self.item, at))
        self.item, self.weight, at = self.item[order], self.weight[order], at[order]
        self.first_block = np.zeros(len(self.words) + 1, np.int64)
        key = at * (len(held) // block + 1) + self.item // block
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_no, self.block_start = self.item[starts] // block, np.append(starts, len(key))
        self.block_max = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        np.cumsum(np.bincount(at[starts], minlength=len(self.words)), out=self.first_block[1:])
        self.held = np.sort(self.item * len(self.words) + at)  # item and word, to look up whether an item has a word
        self.upper = np.zeros(len(self.words))
        np.maximum.at(self.upper, at, self.weight)
        self._near: dict[str, list[str]] = {}
        for w in self.words:
            for v in {w, *_shorter(w)}:
                self._near.setdefault(v, []).append(w)
        self._known: dict[str, list[int]] = {}

    def like(self, word: str) -> list[int]:
        """The index's words that are :func:`alike` to ``word``, by number."""
        if (found := self._known.get(word)) is None:
            if len(self._known) > 200_000:
                self._known.clear()
            near = {w for v in (word, *_shorter(word)) for w in self._near.get(v, ())}
            found = self._known[word] = sorted(self.place[w] for w in near if alike(word, w))
        return found

    def above(self, query: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and an item (by position) whose score reaches ENOUGH, by block-max WAND over ``n`` queries at once.

        ``query`` are the distinct words (numbers) of query ``of``. The sum of the words' highest scores, then for each
        block the sum of the words' highest scores within it must reach ENOUGH. Postings of other blocks are
        skipped, they are not read.
        """
        some = np.bincount(of, self.upper[query], n)[of] >= ENOUGH
        query, of = query[some], of[some]
        rows, of = _ranges(self.first_block[query], self.first_block[query + 1], of)
        blocks = len(self.texts) // self.block + 1
        at = of * blocks + self.block_no[rows]
        live = np.bincount(at, self.block_max[rows], n * blocks)[at] >= ENOUGH
        posts, of = _ranges(self.block_start[rows[live]], self.block_start[rows[live] + 1], of[live])
        score = np.bincount(of * len(self.texts) + self.item[posts], self.weight[posts], n * len(self.texts))
        return np.divmod(np.flatnonzero(score >= ENOUGH), max(1, len(self.texts)))


def _ranges(low: np.ndarray, high: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each ``low`` up to before its ``high``, with the range's ``of``."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n), np.repeat(of, n)


def _least(scores: dict[str, float], counts: dict[str, int], need: int) -> float:
    """A bound that the scores of words making up ``need`` of a text's words don't fall below: the cheapest, the last one in part."""
    total = 0.0
    for w in sorted(scores, key=lambda w: scores[w] / counts[w]):
        part = min(counts[w], need)
        total, need = total + scores[w] * part / counts[w], need - part
        if not need:
            break
    return total


def _shorter(w: str) -> list[str]:
    """The word without one of its letters; two words one slip apart share such a form or are one."""
    return [w[:i] + w[i + 1 :] for i in range(len(w))] if len(w) > 2 else []


def alike(a: str, b: str) -> bool:
    """Whether two words are the same but for a slip: one letter changed, left out, added or swapped with its neighbour, in words of four letters and more."""
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(b) < 3 or len(a) < 4 or len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    if len(a) > len(b):
        return a[i + 1 :] == b[i:]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def longest_stretch(text: list, item: list[str], like: Callable[..., Iterable[str]], gap: int = GAP) -> int:
    """Most words of ``item`` that ``text`` holds in order, no two neighbours of them with more than ``gap`` words between them on either side; ``like`` gives the words that count as the same."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(item):
        places.setdefault(w, []).append(i)
    seen: dict = {}
    best: list[dict[int, int]] = []
    most = 0
    for j, w in enumerate(text):
        if (at := seen.get(w)) is None:
            at = seen[w] = sorted(i for v in like(w) for i in places.get(v, ()))
        here: dict[int, int] = {}
        for i in at:
            n = 0
            for before in best[max(0, j - gap - 1) : j]:
                if before:
                    for k in range(i - gap - 1, i):
                        if before.get(k, 0) > n:
                            n = before[k]
            here[i] = n + 1
            most = max(most, n + 1)
        best.append(here)
    return most


def leaks(texts: Batch, index: ItemIndex, share: float = SHARE, gap: int = GAP) -> Iterator[tuple[int, int, int, int]]:
    """(text, item id, words held in one stretch, words of the item) of each text and item that it holds.

    Every passage is a query; each stretch of ``share`` of an item's words lies within some passage. A bound that no
    passage's score exceeds is checked for all passages at once.
    """
    if not index.texts or not len(texts.codes):
        return
    like = [index.like(w) for w in texts.vocabulary]
    first_like, all_like = np.concatenate([[0], np.cumsum([len(x) for x in like])]), np.array([i for x in like for i in x], np.int64)
    most = np.array([index.upper[ids].sum() for ids in like])
    longest = (math.ceil(share * index.longest) - 1) * (gap + 1) + 1
    step = max(8, longest // 2)
    size = longest + step
    total = np.concatenate([[0.0], np.cumsum(most[texts.codes])])
    lengths = np.diff(texts.starts)
    n = np.where(lengths > 0, np.maximum(1, -((step - lengths) // step)), 0)
    low, of = _ranges(np.zeros(len(n), np.int64), n, np.arange(len(n)))
    low = texts.starts[of] + low * step
    high = np.minimum(low + size, texts.starts[of + 1])
    alive = np.flatnonzero(total[high] - total[low] >= ENOUGH)
    need = np.array([math.ceil(share * len(t)) for t in index.texts])
    spans: dict[tuple[int, int], list[list[int]]] = {}
    block = max(1, min(PASSAGES, CELLS // max(1, len(index.words), len(index.texts))))
    for k in range(0, len(alive), block):
        part = alive[k : k + block]
        for at, item in _dense(texts, index, low[part], high[part], (first_like, all_like), need, gap):
            p = part[at]
            a, b = int(max(texts.starts[of[p]], low[p] - step)), int(min(texts.starts[of[p] + 1], low[p] + size + step))
            runs = spans.setdefault((int(of[p]), item), [])
            if runs and a <= runs[-1][1]:
                runs[-1][1] = b
            else:
                runs.append([a, b])
    names = [{w for i in ids for w in (index.words[i],)} for ids in like]
    for (text, item), runs in spans.items():
        own = set(index.texts[item])
        held = max(longest_stretch(texts.codes[a:b].tolist(), index.texts[item], lambda c, own=own: names[c] & own, gap) for a, b in runs)
        if held >= need[item]:
            yield text, index.ids[item], held, len(index.texts[item])


def _dense(texts: Batch, index: ItemIndex, low: np.ndarray, high: np.ndarray, like: tuple[np.ndarray, np.ndarray], need: np.ndarray, gap: int) -> Iterator[tuple[int, int]]:
    """Passages (by number) and items found for them that have as many of the item's words as it takes with no wider gaps between them, in whatever order."""
    first_like, all_like = like
    places, of = _ranges(low, high, np.arange(len(low)))
    code = texts.codes[places]
    query, asked = _ranges(first_like[code], first_like[code + 1], of)
    words = np.zeros(len(low) * len(index.words), bool)
    words[asked * len(index.words) + all_like[query]] = True
    asked, word = np.divmod(np.flatnonzero(words), len(index.words))
    passage, item = index.above(word, asked, len(low))
    for k in range(0, len(passage), PASSAGES):
        p, i = passage[k : k + PASSAGES], item[k : k + PASSAGES]
        places, pair = _ranges(low[p], high[p], np.arange(len(p)))
        code = texts.codes[places]
        # words alike to some word of the item, by looking up item and word
        alike_to, token = _ranges(first_like[code], first_like[code + 1], np.arange(len(code)))
        key = i[pair[token]] * len(index.words) + all_like[alike_to]
        at = np.minimum(np.searchsorted(index.held, key), len(index.held) - 1)
        hit = token[index.held[at] == key]
        hit = hit[np.diff(hit, prepend=-1) > 0]
        if not len(hit):
            continue
        starts = np.flatnonzero((np.diff(places[hit], prepend=-9) > gap + 1) | (np.diff(pair[hit], prepend=-1) != 0))
        run = np.diff(np.append(starts, len(hit)))
        pairs = pair[hit[starts]]
        for j in np.unique(pairs[run >= need[i[pairs]]]).tolist():
            yield int(p[j]), int(i[j])


def item_words(items: DataFrame) -> DataFrame:
    """item_id and words of the items (item_id, text); of a repeated item_id the least text, null and wordless ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = word_batch(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(found.starts.astype(np.int32)), pa.array(found.vocabulary, pa.string()).take(pa.array(found.codes)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], ["item_id", "words"])

    kept = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    return kept.mapInArrow(run, "item_id bigint, words array<string>").where("size(words) > 0")


def indexes(items: DataFrame, shard: int = SHARD, share: float = SHARE) -> Iterator[ItemIndex]:
    """Indexes of at most about ``shard`` items each, with the frequencies of all items (item_id, text) in every one."""
    held = stored(item_words(items), "item-words")
    n, mean = held.agg(F.count("*"), F.avg(F.size("words"))).first()
    parts = max(1, math.ceil(n / shard))
    if parts == 1:
        yield ItemIndex([(r["item_id"], r["words"]) for r in held.collect()], share)
        return
    once = held.select("item_id", F.explode(F.array_distinct("words")).alias("word"))
    frequencies = stored(once.groupBy("word").agg(F.count("*").alias("n")), "item-frequencies")
    for k in range(parts):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k
        df = frequencies.join(once.where(mine).select("word").distinct(), "word").collect()
        yield ItemIndex([(r["item_id"], r["words"]) for r in held.where(mine).collect()], share, frequencies={r["word"]: r["n"] for r in df}, n_items=n, mean=mean)


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE, gap: int = GAP, shard: int = SHARD) -> DataFrame:
    """Pairs doc_id, item_id, n_held, n_words of documents (doc_id, text) holding items (item_id, text).

    Every whole document is searched; each document is one row's work, so no shuffle and no skew arises, whatever its
    source or its copies. The items are indexed in shards of at most about ``shard`` items, each a bounded broadcast and
    a pass over the corpus; frequencies are taken over all items, so the result doesn't depend on the shards. Null and
    empty texts on either side match nothing; a repeated item_id keeps its least text.
    """
    out = None
    for index in indexes(items, shard, share):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(leaks(word_batch(batch.column("text")), shared.value, share, gap))
                at, *columns = (pa.array([h[k] for h in hits], pa.int64()) for k in range(4))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *columns], ["doc_id", "item_id", "n_held", "n_words"])

        found = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").mapInArrow(search, "doc_id bigint, item_id bigint, n_held bigint, n_words bigint")
        out = found if out is None else out.unionByName(found)
    return out
