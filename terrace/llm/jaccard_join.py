"""N-gram Jaccard self-join by signature trees.

A document's set holds its distinct shingles of five words. Two documents link when their sets' Jaccard similarity is
0.8 or more; the result is each document's connected component. The join is exact and has these steps.

1. Equal sets are one class, represented by its document with the smallest id. A sketch of fixed size counts shingles.
2. Sets that are similar enough share one of the first n - ceil(0.8 n) + 1 shingles in any order common to all sets.
   Three in ten shingles, chosen by hash, are sent to be counted and come first, rare ones before others: so a set whose
   shingles are mostly its own is in no block, and a passage that others share seldom makes one. Classes that share a
   prefix shingle form candidate blocks (connected components over the shared shingles): every link lies within a block.
   A very common shingle is split over salts, whose parts are tied together by one edge each.
3. In a block, classes are the leaves of a signature tree: sorted by size, then by least hashed shingle, and grouped
   upwards by FAN. A node holds the OR of its documents' token bitmaps, their range of sizes and the most bits that any
   of them lost to collisions. The tree is traversed against itself; a pair of nodes is dropped where sizes differ by too
   much, or where the common bits and lost bits can't hold the least overlap needed. Pairs of documents that are left
   are verified on their sets, unless verified links already join them.
   A block larger than a task should hold is cut first: all shingles of its classes are counted within it, which gives a
   sharper order and shorter chains of shared prefixes, and so on while its blocks get smaller. What stays large is mostly
   copies of each other. It is dealt into parts, parts are compared within, then one class of each component found meets
   those of other parts; at last pairs of parts are compared, but for those of one component.
4. Verified links that join components (never all pairs) are merged over the parts.

Sets are compared by 64-bit hashes of their shingles, classes by 128 bits over their sets.

Defined cases: fewer than five words make one shingle, the whole sequence; without words or text the set is empty and
links with nothing; a row without an id takes part like any other and gets the component of what it links to, or null where
none of it has an id; an id stands for one text, and repeated rows get one component; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import cut, pieces, small, text_of

WORDS = 5
#: The similarity is at least NEED / 100.
NEED = 80
#: The sketch has 2**SKETCH_BITS counters, sent in pieces of 2**PIECE_BITS.
SKETCH_BITS, PIECE_BITS = 20, 14
#: A shingle counted more often than this above the mean is split over salts of about so many documents.
HOT = 2048
#: Shingles with 64-bit hashes below this are counted exactly, three in ten; a prefix is about two in ten.
SAMPLED = 3 * (1 << 64) // 10
#: A block that can't be cut is dealt into parts of about so many documents and shingles.
PART_DOCS, PART_SHINGLES = 1024, 1 << 20
#: A block that is cut is counted in buckets of about so many shingles.
BUCKET_SHINGLES = 1 << 17
#: So many edges at most are joined to components by one task; more in rounds over all tasks.
FEW_EDGES = 500_000
FAN = 8
#: What a worker looks into at a time: bytes of texts (or one text), pairs of nodes.
BYTES, PAIRS = 1 << 18, 4096
#: Sets that a task knows it has seen, as numbers; beyond, copies are counted and sent once more, which changes an order and nothing else.
SEEN = 250_000

#: Odd multipliers, one for each word of a shingle.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A number for each byte at each of the first PLACES places of a word, capitals A-Z like small letters.
PLACES = 64
_LETTERS = mixed(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _MIX[0]).reshape(PLACES, 256)
_LETTERS[:, 65:91] = _LETTERS[:, 97:123]
_LETTERS = _LETTERS.reshape(-1)
_IN_WORD = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another in data from starts on, and where each word begins."""
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[starts] = inside[starts]
    at = np.flatnonzero(inside)
    heads = np.flatnonzero(first[at])
    if not len(heads):
        return np.empty(0, np.uint64), heads
    begins, lengths = at[heads], np.diff(heads, append=len(at))
    place = at - np.repeat(begins, lengths)
    values = _LETTERS[(place % PLACES << 8) | data[at]]
    if lengths.max() > PLACES:
        values *= mixed((place // PLACES).astype(np.uint64)) | np.uint64(1)  # 1 for the first places
    return np.add.reduceat(values, heads), begins


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += mixed(words[i : i + n] * _MIX[i])
    return mixed(total)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sets of texts (none null), in their order, as sorted 64-bit hashes; many texts are hashed at once."""
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BYTES, "right")) - 1)
        starts = (ends[low : high + 1] - ends[low]).astype(np.int64)
        words, begins = word_hashes(data[ends[low] : ends[high]], starts[starts < starts[-1]])
        places = np.searchsorted(begins, starts).tolist()
        whole = shingle_hashes(words, WORDS) if len(words) >= WORDS else words
        for start, end in zip(places, places[1:], strict=False):
            if end - start >= WORDS:
                values = np.sort(whole[start : end - WORDS + 1])
                yield values[np.append(True, values[1:] != values[:-1])]
            else:
                yield shingle_hashes(words[start:end], end - start) if end > start else words[:0]
        low = high


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    digest = xxhash.xxh3_128_intdigest(values.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def described(docs: DataFrame) -> DataFrame:
    """One pass over _id, _hash, _text: rows of documents (_id, _hash, n, k1, k2) and of sketch pieces (piece, counts)."""
    fields = [("_id", pa.int64()), ("_hash", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        for batch in pieces(batches):
            rows = []
            for doc_id, digest, values in zip(batch["_id"].to_pylist(), batch["_hash"].to_pylist(), shingle_sets(batch["_text"]), strict=True):
                key = set_key(values)
                rows.append((doc_id, digest, len(values), *key, None, None))
                if key[1] not in seen:
                    if len(seen) < SEEN:
                        seen.add(key[1])
                    np.add.at(counts, (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)
        for piece, part in enumerate(counts.reshape(-1, 1 << PIECE_BITS)):
            if part.any():
                yield pa.RecordBatch.from_pylist([{"piece": piece, "counts": part.tobytes()}], schema)

    return cut(docs.mapInArrow(run, "_id long, _hash long, n long, k1 long, k2 long, piece int, counts binary"))


def sketch(rows: DataFrame) -> np.ndarray:
    """The summed counters, 8 MB whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                part = np.frombuffer(counts, np.int64)
                sums[piece] = sums[piece] + part if piece in sums else part
        for piece, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["piece", "counts"])

    pieces = 1 << (SKETCH_BITS - PIECE_BITS)
    summed = rows.filter("piece IS NOT NULL").select("piece", "counts").repartition(pieces, "piece").mapInArrow(add, "piece int, counts binary")
    out = np.zeros((pieces, 1 << PIECE_BITS), np.int64)
    for row in summed.collect():
        out[row.piece] += np.frombuffer(row.counts, np.int64)
    return out.reshape(-1)


def prefix_edges(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Edges (a, b) between the first class hashes k1 that share a shingle of their prefixes.

    All sets send their shingles with hashes below SAMPLED, which are at least a prefix (or up to a prefix, where these are
    fewer). The order common to all sets is: those by how many sets have them, then the rest by hash.
    """
    context = docs.sparkSession.sparkContext
    shared, mean = context.broadcast(counts.astype(np.int32)), float(counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = shared.value, set()
        for batch in pieces(batches):
            tokens, owners, slacks, salts, often = [], [], [], [], []
            for values in shingle_sets(batch["_text"]):
                n, key = len(values), set_key(values)
                if not n or key in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                prefix, sampled = n - -(-NEED * n // 100) + 1, int(np.searchsorted(values, np.uint64(SAMPLED)))
                sent = values[: max(prefix, sampled)]
                many = count[(sent >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                parts = 1 + np.maximum(0, many - mean).astype(np.int64) // HOT
                tokens.append(sent.view(np.int64))
                owners.append(np.full(len(sent), key[0]))
                slacks.append(np.full(len(sent), prefix - sampled, np.int32))
                salts.append(np.where(parts > 1, 1 + (key[1] % parts), 0).astype(np.int32))
                often.append(np.where(parts > 1, many, 0).astype(np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, owners, slacks, salts, often)], ["token", "k1", "slack", "salt", "often"])

    postings = docs.select("_text").mapInArrow(run, "token long, k1 long, slack int, salt int, often int")
    group, own = Window.partitionBy("token", "salt"), Window.partitionBy("k1")

    def met(df: DataFrame) -> DataFrame:
        """Rows whose shingle another set has too; of a salted one, all."""
        return df.withColumn("low", F.min("k1").over(group)).withColumn("high", F.max("k1").over(group)).filter("low < high OR salt > 0")

    # How many have a salted shingle is told by the sketch, else by the rows themselves; either way it depends on the shingle alone.
    place = F.when(F.col("salt") > 0, F.col("often").cast("long") + (1 << 40)).otherwise(F.col("sets"))
    common = met(postings.withColumn("sets", F.count("*").over(group))).select("token", "salt", "k1", "slack", place.alias("place"))
    common = common.repartition("k1").dropDuplicates(["k1", "token"]).withColumn("rest", (F.col("token") < 0) | (F.col("token") >= SAMPLED))
    # A set's prefix begins with the sampled shingles that no other set has; what is left of it is filled in order.
    left = F.col("slack") + F.sum((~F.col("rest")).cast("long")).over(own)
    chosen = common.withColumn("left", left).withColumn("rank", F.row_number().over(own.orderBy("rest", "place", "token"))).filter("rest OR rank <= left")
    edges = cut(met(chosen.select("token", "salt", "k1")).select(F.when(F.col("salt") > 0, F.col("token")).alias("token"), "salt", "k1", "low").distinct())
    # The parts of a salted shingle are tied together over their least members.
    heads = edges.filter("salt > 0").select("token", "low").distinct()
    ties = heads.withColumn("head", F.min("low").over(Window.partitionBy("token"))).select(F.col("low").alias("a"), F.col("head").alias("b"))
    return edges.select(F.col("k1").alias("a"), F.col("low").alias("b")).unionByName(ties).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the nodes of edges (a, b); long.

    In each round a node's lesser neighbours are tied to the least of them, and every tie jumps on to where its end is
    tied, so that paths halve; it ends when nothing changes, whatever the number of partitions. Where partitions leave
    few edges, one task ends it.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's edges as stars, which are fewer and shorter than its paths."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(a, b) for a, b in pairs if a != b]
        for k in range(0, len(pairs), 50_000):
            part = pairs[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.int64()) for i in (0, 1)], ["a", "b"])

    stars = cut(edges.select("a", "b").mapInArrow(merge, "a long, b long"))
    few = stars.count() <= FEW_EDGES
    if few:
        stars = cut(stars.coalesce(1).mapInArrow(merge, "a long, b long"))
    while not few:
        parents = cut(stars.groupBy("a").agg(F.min("b").alias("p")))
        rows = stars.repartition("a").dropDuplicates(["a", "b"]).withColumn("p", F.min("b").over(Window.partitionBy("a")))
        tie = lambda x, changed: F.struct(F.col(x).alias("a"), F.col("p").alias("b"), F.lit(changed).alias("changed"))
        ties = F.when(F.col("b") == F.col("p"), F.array(tie("a", False))).otherwise(F.array(tie("a", True), tie("b", True)))
        tied = rows.select(F.inline(ties))
        ends = parents.select(F.col("a").alias("end"), F.col("p").alias("next"))
        jumped = tied.join(ends, F.col("b") == F.col("end"), "left")
        stars = cut(jumped.select("a", F.coalesce("next", "b").alias("b"), (F.col("changed") | F.col("next").isNotNull()).alias("changed")))
        if stars.filter("changed").isEmpty():
            break
        stars = stars.select("a", "b")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))


class Tree:
    """Signature tree over sets; its leaves are the sets in the order of `order`."""

    def __init__(self, sets: list[np.ndarray], bits: int, groups: list[int] | None = None):
        least = np.array([x[0] for x in sets], np.uint64)
        sizes = np.array([len(x) for x in sets], np.int64)
        self.order = np.lexsort((least, sizes))
        self.sets = [sets[i] for i in self.order]
        bitmap = np.zeros((len(sets), bits // 64), np.uint64)
        for i, x in enumerate(self.sets):
            at = x & np.uint64(bits - 1)
            np.bitwise_or.at(bitmap[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        sizes = sizes[self.order]
        lost = sizes - np.bitwise_count(bitmap).sum(axis=1).astype(np.int64)
        group = np.array(range(len(sets)) if groups is None else groups, np.int64)[self.order]
        # Levels from the leaves up: bitmaps, least and largest size, most bits lost, least and largest group.
        self.levels = [(bitmap, sizes, sizes, lost, group, group)]
        folds = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
        while len(self.levels[-1][0]) > 1:
            starts = np.arange(0, len(self.levels[-1][0]), FAN)
            self.levels.append(tuple(f.reduceat(x, starts) for f, x in zip(folds, self.levels[-1], strict=True)))


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes may hold a link, by sizes and by the most overlap that their bitmaps allow."""
    low_a, high_a, low_b, high_b = a[1][i], a[2][i], b[1][j], b[2][j]
    keep = (100 * high_a >= NEED * low_b) & (100 * high_b >= NEED * low_a)
    # An overlap o of sets of x and y shingles links when 100 o >= NEED (x + y - o).
    need = -(-NEED * (low_a + low_b) // (100 + NEED))
    at = np.flatnonzero(keep)
    for k in range(0, len(at), 4096):
        part = at[k : k + 4096]
        common = np.bitwise_count(a[0][i[part]] & b[0][j[part]]).sum(axis=1).astype(np.int64)
        most = np.minimum(common + np.minimum(a[3][i[part]], b[3][j[part]]), np.minimum(high_a[part], high_b[part]))
        keep[part] = most >= need[part]
    return keep


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    overlap = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * overlap >= NEED * (len(x) + len(y) - overlap)


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, root: list[int]) -> list[tuple[int, int]]:
    """Links that join components, between sets of left and right, or within left where right is None.

    root: union-find over positions, those of right after those of left; merged along. What it joins at first isn't compared.
    """
    bits = 1 << max(8, int(np.ceil(np.log2(4 * max(len(x) for x in [*left, *(right or [])]) + 1))))
    bits = min(bits, 1 << 16)
    shift = 0 if right is None else len(left)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a = Tree(left, bits, [find(x) for x in range(len(left))])
    b = a if right is None else Tree(right, bits, [find(x + shift) for x in range(len(right))])
    out = []
    # Depth first, few pairs of nodes at a time: (level in a, level in b, pairs).
    waiting = [(len(a.levels) - 1, len(b.levels) - 1, np.array([[0, 0]]))]
    while waiting:
        level_a, level_b, pairs = waiting.pop()
        of_a, of_b = ([x[k][i] for k in (4, 5)] for x, i in ((a.levels[level_a], pairs[:, 0]), (b.levels[level_b], pairs[:, 1])))
        pairs = pairs[np.minimum(of_a[0], of_b[0]) < np.maximum(of_a[1], of_b[1])]
        pairs = pairs[possible(a.levels[level_a], pairs[:, 0], b.levels[level_b], pairs[:, 1])]
        if not len(pairs):
            continue
        if level_a == level_b == 0:
            for i, j in pairs.tolist():
                x, y = int(a.order[i]), int(b.order[j]) + shift
                if (right is not None or i < j) and find(x) != find(y) and linked(a.sets[i], b.sets[j]):
                    out.append((x, y))
                    root[max(find(x), find(y))] = min(find(x), find(y))
            continue
        down_a, down_b = level_a >= level_b and level_a > 0, level_b >= level_a and level_b > 0
        i, j = pairs[:, 0], pairs[:, 1]
        if down_a:
            i, j = np.repeat(i * FAN, FAN) + np.tile(np.arange(FAN), len(i)), np.repeat(j, FAN)
            level_a -= 1
        if down_b:
            i, j = np.repeat(i, FAN), np.repeat(j * FAN, FAN) + np.tile(np.arange(FAN), len(j))
            level_b -= 1
        keep = (i < len(a.levels[level_a][0])) & (j < len(b.levels[level_b][0]))
        if right is None:
            keep &= i <= j
        pairs = np.stack([i[keep], j[keep]], axis=1)
        waiting += [(level_a, level_b, pairs[k : k + PAIRS]) for k in range(0, len(pairs), PAIRS)]
    return out


def block_links(members: DataFrame) -> DataFrame:
    """Edges (a, b) of class numbers: block, p, q (parts of the block), part, node, joined (its component so far), values; rows of a task sorted together."""

    def links(rows: list[tuple[int, int, int, np.ndarray]], p: int, q: int) -> list[tuple[int, int]]:
        rows = [r for _, r in sorted({r[:2]: r for r in rows}.items())]
        nodes, sets = [r[1] for r in rows], [r[3] for r in rows]
        n, first = sum(r[0] == p for r in rows), {}
        root = [first.setdefault(r[2], i) for i, r in enumerate(rows)]
        if p == q:
            found = tree_links(sets, None, root) if len(rows) > 1 else []
        elif 0 < n < len(rows):
            found = tree_links(sets[:n], sets[n:], root)
        else:
            found = []
        return [(nodes[x], nodes[y]) for x, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in pieces(batches):
            columns = [batch[c].to_pylist() for c in ("block", "p", "q", "part", "node", "joined")]
            out = []
            for block, p, q, part, node, joined, values in zip(*columns, batch["values"], strict=True):
                if (block, p, q) != key:
                    out += links(rows, *key[1:]) if rows else []
                    key, rows = (block, p, q), []
                rows.append((part, node, joined, values.values.to_numpy().view(np.uint64).copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = links(rows, *key[1:]) if rows else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    dealt = members.repartition("block", "p", "q").sortWithinPartitions("block", "p", "q")
    return dealt.select("block", "p", "q", "part", "node", "joined", "values").mapInArrow(run, "a long, b long")


def texts_of(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The columns of placed (node, first, hash, …) but for first and hash, with _text: that of the row with the id, or of one of those without an id."""
    kept = [c for c in placed.columns if c not in ("first", "hash")]
    with_id = rows.select("_id", "_text").join(placed.filter("first IS NOT NULL"), F.col("_id") == F.col("first")).select(*kept, "_text")
    without = rows.filter("_id IS NULL").select("_hash", "_text").dropDuplicates(["_hash"])
    return with_id.unionByName(without.join(placed.filter("first IS NULL"), F.col("_hash") == F.col("hash")).select(*kept, "_text"))


def sets_of(texts: DataFrame) -> DataFrame:
    """values, the set, in place of _text, for rows of node, n, block."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("block", pa.int64()), ("values", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [values.view(np.int64) for values in shingle_sets(batch["_text"])]
            if sets:
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("node", "n", "block")), values], schema=schema)

    return texts.select("node", "n", "block", "_text").mapInArrow(run, "node long, n long, block long, values array<long>")


def parts_of(docs: Column, total: Column) -> Column:
    """How many parts so many documents and shingles make."""
    return F.greatest(F.lit(1), F.ceil(docs / PART_DOCS), F.ceil(total / PART_SHINGLES)).cast("int")


def sized(sets: DataFrame) -> DataFrame:
    """Adds docs and total (of the block) and parts; blocks of one class go."""
    sizes = sets.groupBy("block").agg(F.count("*").alias("docs"), F.sum("n").alias("total")).filter("docs > 1")
    return sets.join(sizes.select("block", "docs", "total", parts_of(F.col("docs"), F.col("total")).alias("parts")), "block")


def grouped(keys: dict[str, np.ndarray], values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each combination of keys, with the lists of values that have it."""
    order = np.lexsort([*keys.values()][::-1])
    keys = {k: x[order] for k, x in keys.items()}
    starts = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in keys.values()], axis=0)))
    ends = pa.array(np.append(starts, len(order)), pa.int32())
    columns = {k: pa.array(x[starts]) for k, x in keys.items()} | {k: pa.ListArray.from_arrays(ends, pa.array(x[order])) for k, x in values.items()}
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """block, buckets and the named lists of each (block, bucket), from rows that are sorted by these."""
    key, rows = None, []

    def group() -> tuple[int, int, list[np.ndarray]]:
        return key[0], key[2], [np.concatenate(x) for x in zip(*rows, strict=True)]

    for batch in pieces(batches):
        lists = [[x.values.to_numpy() for x in batch[c]] for c in names]
        for *now, row in zip(*(batch[c].to_pylist() for c in ("block", "bucket", "buckets")), zip(*lists, strict=True), strict=True):
            if now != key:
                if rows:
                    yield group()
                key, rows = now, []
            rows.append(row)
    if rows:
        yield group()


def bucket_of(x: np.ndarray, buckets: np.ndarray | int) -> np.ndarray:
    """Deals numbers over so many buckets."""
    return (((mixed(x.view(np.uint64)) >> np.uint64(32)) * np.asarray(buckets).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def sharper(large: DataFrame) -> DataFrame:
    """node, block (anew) of the classes of large (node, n, block, total, values) that share a shingle of their prefixes with another.

    The order common to a block's sets is that of all shingles by how many sets of the block have them. A block's shingles
    are dealt over buckets to be counted, then by set to choose the prefixes, then over buckets again to be tied; rows hold
    lists of them, so that there are about as many rows as buckets in each piece of the input.
    """
    head = "block long, bucket long, buckets long, nodes array<long>"

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            each = batch["values"].value_lengths().to_numpy()
            tokens = batch["values"].flatten().to_numpy()
            if len(tokens):
                block, buckets, node, n = (np.repeat(batch[c].to_numpy(), each) for c in ("block", "buckets", "node", "n"))
                yield grouped({"block": block, "bucket": bucket_of(tokens, buckets), "buckets": buckets}, {"nodes": node, "sizes": n, "tokens": tokens})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, buckets, (nodes, sizes, tokens) in whole_groups(batches, ["nodes", "sizes", "tokens"]):
            _, at, sets = np.unique(tokens, return_inverse=True, return_counts=True)
            sets = sets[at]
            nodes, sizes, tokens, sets = (x[sets > 1] for x in (nodes, sizes, tokens, sets))
            if len(nodes):
                same = np.ones(len(nodes), np.int64)
                yield grouped({"block": block * same, "bucket": bucket_of(nodes, buckets), "buckets": buckets * same}, {"nodes": nodes, "sizes": sizes, "tokens": tokens, "sets": sets})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, buckets, lists in whole_groups(batches, ["nodes", "sizes", "tokens", "sets"]):
            order = np.lexsort((lists[2], lists[3], lists[0]))
            nodes, n, tokens, _ = (x[order] for x in lists)
            _, first, at, shared = np.unique(nodes, return_index=True, return_inverse=True, return_counts=True)
            # A set's prefix begins with the shingles that no other set has.
            left = n - -(-NEED * n // 100) + 1 - (n - shared[at])
            chosen = np.arange(len(nodes)) - first[at] < left
            if chosen.any():
                nodes, tokens = nodes[chosen], tokens[chosen]
                same = np.ones(len(nodes), np.int64)
                yield grouped({"block": block * same, "bucket": bucket_of(tokens, buckets), "buckets": buckets * same}, {"nodes": nodes, "tokens": tokens})

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (nodes, tokens) in whole_groups(batches, ["nodes", "tokens"]):
            order = np.lexsort((nodes, tokens))
            nodes = nodes[order]
            _, first, at = np.unique(tokens[order], return_index=True, return_inverse=True)
            ties = np.unique(np.stack([nodes, nodes[first[at]]]), axis=1)
            ties = ties[:, ties[0] > ties[1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ties], ["a", "b"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("block", "bucket").sortWithinPartitions("block", "bucket")

    buckets = F.ceil(F.col("total") / BUCKET_SHINGLES).cast("long").alias("buckets")
    tokens = large.select("block", buckets, "node", "n", "values").mapInArrow(scatter, f"{head}, sizes array<long>, tokens array<long>")
    counted = dealt(tokens).mapInArrow(count, f"{head}, sizes array<long>, tokens array<long>, sets array<long>")
    chosen = dealt(counted).mapInArrow(choose, f"{head}, tokens array<long>")
    edges = dealt(chosen).mapInArrow(tie, "a long, b long")
    return components(edges).select("node", F.col("component").alias("block"))


def blocks_in_parts(sets: DataFrame) -> DataFrame:
    """Rows of node, n, block, values, parts; blocks that are too large for a task are cut while their largest block has less than half of them."""
    now = cut(sized(sets).withColumn("whole", F.lit(False)))
    done = now.filter("parts = 1").drop("docs", "total", "whole")
    while not (large := now.filter("parts > 1 AND NOT whole")).isEmpty():
        stays = now.filter("parts > 1 AND whole").drop("docs", "total", "whole")
        placed = sharper(large).withColumnRenamed("block", "_block")
        anew = sized(large.withColumnsRenamed({"docs": "before"}).drop("block", "total", "parts", "whole").join(placed, "node").withColumnRenamed("_block", "block"))
        now = cut(anew.withColumn("whole", 2 * F.col("docs") > F.col("before")).drop("before"))
        done = done.unionByName(stays.select(*done.columns)).unionByName(now.filter("parts = 1").select(*done.columns))
    return done.unionByName(now.filter("parts > 1").select(*done.columns))


def within(sets: DataFrame, seed: int = 0) -> DataFrame:
    """Links within the parts of the blocks. sets: node, block, joined, values, parts."""
    part = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")).cast("int")
    members = sets.withColumn("part", part).withColumn("p", F.col("part")).withColumn("q", F.col("part"))
    return block_links(members)


def across(sets: DataFrame) -> DataFrame:
    """Links between components of the blocks. sets: node, n, block, joined, values.

    A component of half a part or more has parts of its own, which need not meet each other; the rest of a block is dealt into others.
    """
    sizes = sets.groupBy("block", "joined").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    big = sizes.withColumn("own", F.when((2 * F.col("docs") >= PART_DOCS) | (2 * F.col("total") >= PART_SHINGLES), F.col("joined")))
    groups = big.groupBy("block", "own").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).withColumn("parts", parts_of(F.col("docs"), F.col("total")))
    before = F.sum("parts").over(Window.partitionBy("block").orderBy("own")) - F.col("parts")
    groups = cut(groups.select("block", "own", "parts", before.alias("before")))
    part = F.col("before") + F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = sets.join(big.select("block", "joined", "own"), ["block", "joined"])
    placed = cut(placed.join(groups.withColumnsRenamed({"block": "_b", "own": "_o"}), (F.col("block") == F.col("_b")) & F.col("own").eqNullSafe(F.col("_o"))).withColumn("part", part).drop("_b", "_o", "before", "parts"))
    parts = groups.select("block", "own", F.explode(F.sequence("before", F.col("before") + F.col("parts") - 1)).alias("part"))
    others = parts.withColumnsRenamed({"own": "other_own", "part": "other"})
    meet = parts.join(others, "block").filter("own IS NULL OR other_own IS NULL OR own <> other_own").select("block", "part", "other")
    members = placed.join(meet, ["block", "part"])
    return block_links(members.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")))


def verified_links(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Edges (a, b) of nodes whose sets link, enough to connect all that do. active: node, first, hash, n, block."""
    sets = blocks_in_parts(cut(sets_of(texts_of(rows, active)))).withColumn("joined", F.col("node"))
    links = cut(within(sets))
    large = sets.filter("parts > 1")
    if large.isEmpty():
        return links

    def joined() -> DataFrame:
        found = components(links).select("node", "component")
        return large.drop("joined").join(found, "node", "left").withColumn("joined", F.coalesce("component", "node")).drop("component")

    # One class of each component meets those of other parts, while this leaves less than half of them.
    count, seed = None, 0
    while True:
        large = cut(joined())
        heads = large.filter("node = joined")
        left, blocks = heads.groupBy("block").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
        if left == blocks:  # each block is one component
            return links
        if count is not None and 2 * left > count:
            break
        count, seed = left, seed + 1
        few = sized(heads.drop("parts"))
        links = cut(links.unionByName(within(few, seed)))
    mixed = large.groupBy("block").agg(F.min("joined").alias("low"), F.max("joined").alias("high")).filter("low < high").select("block")
    return links.unionByName(across(large.drop("parts").join(mixed, "block")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_hash", F.when(F.col("_id").isNull(), F.xxhash64("_text")))
    seen = described(rows)
    counts = sketch(seen)
    ids = seen.filter("piece IS NULL").select("_id", "_hash", "n", "k1", "k2")
    # A class is numbered, as it may have no id; the table is kept, so the numbers stay.
    classes = ids.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("_id").alias("first"), F.min("_hash").alias("hash"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))

    blocks = components(prefix_edges(rows, counts)).withColumnRenamed("node", "k1").withColumnRenamed("component", "block")
    joined = components(verified_links(rows, cut(classes.join(blocks, "k1").select("node", "first", "hash", "n", "block"))))
    of_class = classes.join(joined, "node", "left").select("k1", "k2", "n", "first", F.coalesce("component", "node").alias("component"))
    least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    named = ids.join(of_class.join(least, "component").select("k1", "k2", "n", "component_id"), ["k1", "k2", "n"], "left")
    return named.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for near copies: of each component the document with the smallest id stays, of repeated rows one. Rows without an id stay."""
    found = cut(jaccard_components(docs, id_col, text_col).select(F.col(id_col).alias("_own"), "component_id"))
    gone = found.filter("_own <> component_id").select("_own").distinct()
    columns = lambda df: df.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    kept = docs.select(F.col(id_col).alias("_key"), F.struct("*").alias("_row")).join(gone, F.col("_key") == F.col("_own"), "left_anti")
    again = cut(found.filter("_own = component_id").groupBy("_own").count().filter("count > 1").select("_own"))
    if again.isEmpty():
        return columns(kept)
    # Repeated rows are equal in their id; the rest of the least row of these stays.
    twice = kept.join(again, F.col("_key") == F.col("_own"), "left_semi")
    one = twice.groupBy("_key").agg(F.max_by("_row", F.xxhash64("_row")).alias("_row"))
    once = kept.join(again, F.col("_key") == F.col("_own"), "left_anti")
    return columns(once).unionByName(columns(one))
