"""The most similar of many sets of trigrams for each of many others, within a task.

Sets are lists of whole numbers, the rarest first. A set is asked trigram by trigram: what holds the next one is scored, until
nothing that holds none of those so far can be as good as what was found. So trigrams that most sets have are seldom looked up.
"""

from __future__ import annotations

import numpy as np

#: Sets asked at a time, cells of the table of their tokens, sets looked at in one step.
BATCH, CELLS, STEP = 512, 1 << 20, 1 << 18
#: 64-bit words of a signature; a token has a bit if it is in one of so many held sets at most.
WORDS, SELDOM = 2, 4
#: Scores above which the best are looked for first.
LEVELS = (0.8, 0.65, 0.5, 0.4)


def codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """owner, code: all trigrams of names, of words with one space between them; a code is three characters of 21 bits."""
    wide = [n.replace(" ", "   ") for n in names]
    c = np.frombuffer(f"  {'   '.join(wide)} ".encode("utf-32-le"), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(wide)), np.fromiter(map(len, wide), np.int64, len(wide)) + 3)[: len(c) - 2]
    # Three spaces part words, so what has two at its end begins in one word and ends before the next.
    inside = (c[1:-1] != 32) | (c[2:] != 32)
    return owner[inside], ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside]


class Sets:
    """Sets of tokens, one after the other: owner and place (within its set) of each token; at, size and signature (by word) of each set.

    A bit that one of two signatures has and the other has not is a token that the other set lacks. Only the `telling` first
    tokens have bits: those that most sets have would fill them.
    """

    def __init__(self, owner: np.ndarray, token: np.ndarray, n: int, telling: int):
        self.owner, self.token, self.size = owner, token, np.bincount(owner, minlength=n)
        self.at = np.cumsum(self.size) - self.size
        self.place = np.arange(len(token)) - self.at[owner]
        bits = np.zeros((n, WORDS * 64), bool)
        bits[owner[token < telling], token[token < telling] % (WORDS * 64)] = True
        self.signature = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)


def ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions from each `at` on, `size` of them, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def sets_of(asked: list[str], held: list[str]) -> tuple[Sets, Sets, np.ndarray]:
    """Both lists of names as sets of tokens in the order of how many held sets have them, and that number for each token."""
    parts = [codes(asked), codes(held)]
    known = distinct(np.concatenate([distinct(p[1]) for p in parts]))
    v = len(known)
    pairs = [distinct(owner * v + np.searchsorted(known, code)) for owner, code in parts]
    often = np.bincount(pairs[1] % v, minlength=v)
    order = np.argsort(often, kind="stable")
    rank = np.empty(v, np.int64)
    rank[order] = np.arange(v)
    keys = [np.sort(p // v * v + rank[p % v]) for p in pairs]
    telling = np.count_nonzero(often * SELDOM <= len(held))
    a, b = (Sets(k // v, k % v, n, telling) for k, n in zip(keys, (len(asked), len(held)), strict=True))
    return a, b, often[order]


def nearest(asked: list[str], held: list[str], ids_of: np.ndarray, rank: np.ndarray, most: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """asked, id, score: for each name asked the `most` ids of held names with the best scores above `least`, of equal ones the first in rank.

    Names asked and held are told by their places. ids_of: the held name of each id, in order; rank: the order of ids. Exact: a
    set is left out only where a bound of its score is below the last of those found, or not above `least`.
    """
    if not asked or not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, often = sets_of(asked, held)
    sizes = distinct(b.size)
    width = sizes[-1] + 1
    # What holds a token, by its set's size and by how many rarer tokens the set has.
    keys = (b.token * len(sizes) + np.searchsorted(sizes, b.size)[b.owner]) * width + b.place
    order = np.argsort(keys)
    keys, holder = keys[order], b.owner[order]
    signature = b.signature[:, holder]
    copies = np.bincount(ids_of, minlength=len(held))
    first_id = np.cumsum(copies) - copies
    none = a.size.max() + 1
    batch = max(16, min(BATCH, CELLS // len(often)))
    # Where in each set of the batch a token is.
    table = np.full(batch * len(often), none, np.int32)
    out = []
    for begin in range(0, len(asked), batch):
        rows = np.arange(begin, min(begin + batch, len(asked)))
        size, at = a.size[rows], a.at[rows]
        cells = ragged(at, size)
        filled = np.repeat((rows - begin) * len(often), size) + a.token[cells]
        table[filled] = a.place[cells]
        score, found = np.full((len(rows), most), -1.0), np.full((len(rows), most), -1)
        # Tokens that no held set has come first, and are passed over.
        begun = np.add.reduceat(often[a.token[cells]] == 0, np.cumsum(size) - size)
        step, floor = begun.copy(), np.zeros(len(rows))

        def good(common: np.ndarray, q: np.ndarray, other: np.ndarray) -> np.ndarray:
            s = common / (size[q] + other - common)  # noqa: B023
            return (s > least) & (s >= np.maximum(score[q, -1], floor[q]))  # noqa: B023

        def look(q: np.ndarray, h: np.ndarray) -> None:
            """Scores pairs of which each set asked has the token at its step, if none before it is common."""
            n = b.size[h]
            places, heads = table.take(np.repeat(q * len(often), n) + b.token.take(ragged(b.at[h], n))), np.cumsum(n) - n
            common, earliest = np.add.reduceat(places < none, heads, dtype=np.int64), np.minimum.reduceat(places, heads)
            keep = np.flatnonzero((earliest == step[q]) & good(common, q, n))  # noqa: B023
            q, h, common = q[keep], h[keep], common[keep]
            s, n = common / (size[q] + b.size[h] - common), copies[h]  # noqa: B023
            touched = np.flatnonzero(np.bincount(q))
            ids = np.concatenate((found[touched].ravel(), ragged(first_id[h], n)))  # noqa: B023
            q, s = np.concatenate((np.repeat(touched, most), np.repeat(q, n))), np.concatenate((score[touched].ravel(), np.repeat(s, n)))  # noqa: B023
            best = np.lexsort((rank[ids], -s, q))
            q, s, ids = q[best], s[best], ids[best]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            keep = nth < most
            score[q[keep], nth[keep]], found[q[keep], nth[keep]] = s[keep], ids[keep]  # noqa: B023

        # Each set asked looks for sets of each size for as long as one of those could be among its best; where too few are
        # above a level, it begins again for the next one.
        for level in (*[x for x in LEVELS if x > least], least):
            few = np.flatnonzero(score[:, -1] < 0)
            step[few], floor[few], score[few], found[few] = begun[few], level, -1.0, -1
            live, k = np.repeat(few, len(sizes)), np.tile(np.arange(len(sizes)), len(few))
            while True:
                left, other = size[live] - step[live], sizes[k]
                keep = np.flatnonzero((left > 0) & good(np.minimum(left, other), live, other))
                live, k, other = live[keep], k[keep], other[keep]
                if not len(live):
                    break
                share = np.maximum(score[live, -1], level)
                need = np.maximum(np.ceil(share / (1 + share) * (size[live] + other) - 1e-6).astype(np.int64), 1)
                head = (a.token[at[live] + step[live]] * len(sizes) + k) * width
                low, high = np.searchsorted(keys, head), np.searchsorted(keys, head + other - need, "right")
                ends = np.cumsum(high - low)
                for some in np.split(np.arange(len(live)), np.searchsorted(ends, np.arange(STEP, ends[-1], STEP))):
                    n, own = (high - low)[some], rows[live[some]]
                    cells, lacking, more = ragged(low[some], n), 0, 0
                    for a_word, b_word in zip(a.signature, signature, strict=True):
                        mine, theirs = np.repeat(a_word[own], n), b_word[cells]
                        lacking, more = lacking + np.bitwise_count(mine & ~theirs), more + np.bitwise_count(theirs & ~mine)
                    near = np.flatnonzero((lacking <= np.repeat((size[live] - need)[some], n)) & (more <= np.repeat((other - need)[some], n)))
                    if len(near):
                        look(np.repeat(live[some], n)[near], holder[cells[near]])
                step[distinct(live)] += 1
        table[filled] = none
        q, nth = np.nonzero(found >= 0)
        out.append((rows[q], found[q, nth], score[q, nth]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
