"""Top-k over posting lists of one shard: accumulators of short lists, block maxima, documents skipped in long lists."""

from __future__ import annotations

import numpy as np

#: A list is short if it holds no more than this share of a shard's documents.
SHORT_SHARE = 1 / 16
#: Documents of a block with a maximum of its own, and blocks that are looked at together.
BLOCK_BITS, BLOCKS_AT_ONCE = 6, 32


class PostingList:
    """Places in a shard, what they add to a score, the largest of that, and of each block."""

    def __init__(self, places: np.ndarray, adds: np.ndarray, blocks: int):
        self.places, self.adds, self.most = places, adds, int(adds.max())
        self.maxima = np.zeros(blocks, np.int64)
        block = places >> BLOCK_BITS
        first = np.flatnonzero(np.diff(block, prepend=-1))
        self.maxima[block[first]] = np.maximum.reduceat(adds, first)


def _summed(lists: list[PostingList], blocks: int) -> PostingList | None:
    """The accumulators of lists, taken term at a time, as one list."""
    if not lists:
        return None
    places = np.concatenate([x.places for x in lists])
    order = np.argsort(places, kind="stable")
    places, adds = places[order], np.concatenate([x.adds for x in lists])[order]
    first = np.flatnonzero(np.diff(places, prepend=-1))
    return PostingList(places[first], np.add.reduceat(adds, first), blocks)


def best_of_shard(lists: list[PostingList], docs: int, k: int, short_share: float = SHORT_SHARE) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best documents of a shard by the sum of the lists (score above 0; ties: least place first), and how many documents
    were looked at in the long lists.
    """
    blocks = (docs >> BLOCK_BITS) + 1
    summed = _summed([x for x in lists if len(x.places) <= short_share * docs], blocks)
    long = sorted((x for x in lists if len(x.places) > short_share * docs), key=lambda x: x.most)
    weakest = np.cumsum([x.most for x in long])  # most of what the first lists add together
    bound = sum((x.maxima for x in long), np.zeros(blocks, np.int64)) + (summed.maxima if summed else 0)
    # what is left to come at a block when the lists from i downwards are still to be asked
    to_come = np.vstack([np.zeros((1, blocks), np.int64), *(x.maxima[None] for x in long)]).cumsum(0)
    found, scores, looked_at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    least = 1
    if summed is not None and len(summed.adds) >= k:
        least = max(least, int(np.partition(summed.adds, -k)[-k]))
    wanted = np.flatnonzero(bound >= least)
    while len(wanted):
        here, wanted = wanted[:BLOCKS_AT_ONCE], wanted[BLOCKS_AT_ONCE:]
        lo, hi = int(here[0]) << BLOCK_BITS, int(here[-1] + 1) << BLOCK_BITS
        score = np.zeros(hi - lo, np.int64)
        inside = np.zeros(int(here[-1] - here[0]) + 1, bool)
        inside[here - here[0]] = True
        inside = np.repeat(inside, 1 << BLOCK_BITS)
        if summed is not None:
            a, b = np.searchsorted(summed.places, (lo, hi))
            score[summed.places[a:b] - lo] = summed.adds[a:b]
        weak = int(np.searchsorted(weakest, least))  # these lists together stay below ``least``
        for x in long[weak:]:
            a, b = np.searchsorted(x.places, (lo, hi))
            score[x.places[a:b] - lo] += x.adds[a:b]
        at = np.flatnonzero((score > 0) & inside)
        for i in range(weak, 0, -1):
            at = at[score[at] + to_come[i, (at + lo) >> BLOCK_BITS] >= least]
            x = long[i - 1]
            p = np.searchsorted(x.places, at + lo)
            held = (p < len(x.places)) & (x.places[np.minimum(p, len(x.places) - 1)] == at + lo)
            score[at[held]] += x.adds[p[held]]
        looked_at += len(at)
        at = at[score[at] >= least]
        found, scores = np.concatenate([found, at + lo]), np.concatenate([scores, score[at]])
        if len(found) > k:
            kept = np.lexsort((found, -scores))[:k]
            found, scores = found[kept], scores[kept]
        if len(found) == k:
            least = max(least, int(scores.min()))
            wanted = wanted[bound[wanted] >= least]
    order = np.lexsort((found, -scores))
    return found[order], scores[order], looked_at
