"""Token ids in binary shards of patched frame-of-reference blocks.

Documents are range-sorted by id; each partition encodes its documents and streams the ids to one shard. A block of 512
ids stores the difference of each from the block's minimum, packed at the width that holds 95% of them; the positions
and whole differences of the rest stand in an exception list. The footer indexes the start of every block and of every
document, so that a reader can begin anywhere.

Shard layout, little-endian:
    magic "TPF1"
    blocks, each: minimum u32, ids u16, width u8, pad u8, exceptions u16, positions u16[], differences u32[], bits
    block starts u64[]; tokens per document u64[]; document ids i64[]; whether the id is null u8[]
    trailer: blocks u64, documents u64, footer start u64, magic

Defined cases: a null text counts as empty, so it has the end id only; null ids come first; repeated rows are documents of
their own, in the order of their text; an empty table gives no shard and an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import cut, shared_folder, text_of
from terrace.llm.files import reading, writing

MAGIC = b"TPF1"
BLOCK = 512
HELD = 95
HEAD = struct.Struct("<IHBBH")
TRAILER = struct.Struct("<QQQ4s")
FLUSH = 128 * BLOCK
#: A worker keeps the ids of at most so many pieces, and of twice so many parts of words of at most so many characters, from task to task.
WORDS, LONGEST = 500_000, 64
#: Texts of about so many bytes are encoded at a time.
BATCH_BYTES = 1 << 22
#: So many parts of words are encoded as one text.
LINES = 256

#: White space other than space and newline; a text with it, or with two of any in a row, is encoded whole.
_UNEVEN = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A word of Latin letters and the ASCII signs after it, without apostrophes; the pre-tokenizer parts them.
_WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
_encoders: dict = {}


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of flat that start there, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts from a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer starts a token at a space, and at and after a newline, that stands between two characters which
    are no white space. So a text is cut there; the different pieces of a batch are looked up in a table of those
    asked for lately, the others are cut into word and signs, and each part that isn't known yet is encoded by the library. A file whose pre-tokenizer is another, or that normalises or adds
    to a text, has its texts encoded whole.
    """

    def __init__(self, path: str, words: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), WORDS if words is None else words
        made = json.loads(self.tokenizer.to_str())
        first = made.get("pre_tokenizer") or {}
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        self.parts = self.newline is not None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not made.get("normalizer")
        self.forget()

    def forget(self) -> None:
        self.known, self.older, self.long = {}, {}, []
        # The table: pieces, where their ids stand in flat, how many, and when they were asked for last.
        self.pieces, self.flat, self.turn = None, np.empty(0, "<u4"), 0
        self.starts, self.sizes, self.asked = (np.empty(0, np.int64) for _ in range(3))

    def learn(self, parts: set[str]) -> None:
        """Makes the ids of parts known; parts that long weren't asked for are forgotten, and long parts at once."""
        for x in self.long:
            self.known.pop(x, None)
        if len(self.known) > self.words:
            self.known, self.older = {}, self.known
        self.long = [x for x in parts if len(x) > LONGEST]
        fresh = []
        for x in parts.difference(self.known):
            if x == "\n":
                self.known[x] = np.array([self.newline], "<u4").tobytes()
            elif x in self.older:
                self.known[x] = self.older[x]
            else:
                fresh.append(x)
        # Many parts are encoded as the lines of one text, as a newline is always a token of its own.
        lines = [fresh[k : k + LINES] for k in range(0, len(fresh), LINES)]
        for group, got in zip(lines, self.tokenizer.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False) if lines else (), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids)) * 4
            if len(ends) != len(group):  # an added token of the file took a newline with it
                self.known |= {x: np.array(one.ids, "<u4").tobytes() for x, one in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True)}
                continue
            data, start = ids.tobytes(), 0
            for x, end in zip(group, ends.tolist(), strict=True):
                self.known[x] = data[start:end]
                start = end + 4

    def placed(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each of the different pieces has its own and how many."""
        table = pieces.slice(0, 0) if self.pieces is None else self.pieces
        at = pc.fill_null(pc.index_in(pieces, value_set=table), -1).to_numpy().astype(np.int64)
        missed, self.turn = np.flatnonzero(at < 0), self.turn + 1
        new = pieces.take(pa.array(missed))
        cut = [self._parts(x) for x in new.to_pylist()]
        self.learn({x for parts in cut for x in parts})
        known = self.known
        coded = [b"".join([known[x] for x in parts]) for parts in cut]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        self.asked[at[at >= 0]] = self.turn
        at[missed] = len(self.sizes) + np.arange(len(missed))
        self.pieces, self.asked = pa.concat_arrays([table, new]), np.append(self.asked, np.full(len(missed), self.turn))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
        self.sizes, self.flat = np.append(self.sizes, lengths), np.append(self.flat, np.frombuffer(b"".join(coded), "<u4"))
        found = self.flat, self.starts[at], self.sizes[at]
        short = pc.less_equal(pc.binary_length(new), 2 * LONGEST).to_numpy(zero_copy_only=False)
        if len(self.sizes) > self.words or not short.all():
            self._keep(np.append(np.full(len(table), True), short))
        return found

    def _keep(self, kept: np.ndarray) -> None:
        """Keeps these rows of the table; where they are too many, those asked for last."""
        rows = np.flatnonzero(kept)
        if len(rows) > self.words:
            rows = np.sort(rows[np.argsort(-self.asked[rows], kind="stable")[: self.words // 2]])
        self.pieces, self.asked = self.pieces.take(pa.array(rows)), self.asked[rows]
        self.flat, self.starts, self.sizes = gathered(self.flat, self.starts[rows], self.sizes[rows]), np.cumsum(self.sizes[rows]) - self.sizes[rows], self.sizes[rows]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text's."""
        uneven = pc.match_substring_regex(texts, _UNEVEN) if self.parts else pa.array([True] * len(texts), pa.bool_())
        whole = {i: ids for i, ids in zip(np.flatnonzero(uneven.to_numpy(zero_copy_only=False)), self._whole(texts.filter(uneven)), strict=True)}
        even = pc.if_else(uneven, "", texts)
        # The first piece bears a carriage return, those at a newline the newline; others lack their space.
        pieces = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\r", even, ""), "\n", " \n"), " ")
        words = pieces.flatten().dictionary_encode()
        flat, starts, sizes = self.placed(words.dictionary)
        at = words.indices.to_numpy()
        ids, ends = gathered(flat, starts[at], sizes[at]), np.cumsum(sizes[at])
        bounds = np.append(0, ends)[np.asarray(pieces.offsets)]
        counts = np.diff(bounds)
        if whole:
            counts[list(whole)] = [len(x) for x in whole.values()]
            ids = np.concatenate([x for i in range(len(texts)) for x in (whole.get(i, ids[bounds[i] : bounds[i + 1]]),)])
        return ids, counts

    def _whole(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for got in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False) if len(texts) else ():
            yield np.array(got.ids, "<u4")

    @staticmethod
    def _parts(piece: str) -> list[str]:
        lead, body = (piece[:1], piece[1:]) if piece[:1] in ("\r", "\n") else ("", f" {piece}")
        word = _WORD.fullmatch(body)
        parts = ([word[1], word[2]] if word[2] else [body]) if word else [body] if body else []
        return ["\n", *parts] if lead == "\n" else parts


def encoder(path: str, words: int | None = None) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        _encoders[path] = Encoder(path)
    _encoders[path].words = WORDS if words is None else words
    return _encoders[path]


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text."""
    sizes = np.cumsum(pc.binary_length(batch["_text"]).to_numpy(zero_copy_only=False)) // size
    bounds = [0, *(np.flatnonzero(np.diff(sizes)) + 1), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield batch.slice(a, b - a)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of u32 below 2**width to rows of bytes."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(*values.shape, 4), axis=-1, bitorder="little")[..., :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, : n * width].reshape(len(packed), n, width)
    whole = np.zeros((len(packed), n, 32), np.uint8)
    whole[..., :width] = bits
    return np.packbits(whole, axis=-1, bitorder="little").view("<u4")[..., 0]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK ids, the last maybe shorter; blocks of one width are packed together."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK
    for part in (ids[: whole * BLOCK].reshape(whole, BLOCK), ids[whole * BLOCK :].reshape(1, -1)):
        if not part.size:
            continue
        low = part.min(axis=1)
        rest = part - low[:, None]
        last = (part.shape[1] * HELD + 99) // 100 - 1
        held = np.partition(rest, last, axis=1)[:, last]
        width = np.ceil(np.log2(held.astype(np.float64) + 1)).astype(np.uint8)
        over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
        kept = np.where(over, 0, rest).astype("<u4")
        packed: dict[int, bytes] = {}
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            for i, bits in zip(rows, pack(kept[rows], int(w)), strict=True):
                packed[i] = bits.tobytes()
        for i in range(len(part)):
            at = np.flatnonzero(over[i])
            out.append(HEAD.pack(int(low[i]), part.shape[1], int(width[i]), 0, len(at)) + at.astype("<u2").tobytes() + rest[i, at].astype("<u4").tobytes() + packed[i])
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at these places of data; blocks of one shape are unpacked together."""
    heads = [HEAD.unpack_from(data, int(s)) for s in starts]
    out: list = [None] * len(heads)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (_, n, width, _, _) in enumerate(heads):
        shapes.setdefault((n, width), []).append(i)
    for (n, width), members in shapes.items():
        size = (n * width + 7) // 8
        bits = [np.frombuffer(data, np.uint8, size, int(starts[i]) + HEAD.size + 6 * heads[i][4]) for i in members]
        values = unpack(np.stack(bits), width, n)
        for i, row in zip(members, values, strict=True):
            low, _, _, _, odd = heads[i]
            at = int(starts[i]) + HEAD.size
            row = row.copy()
            row[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
            out[i] = row + np.uint32(low)
    return np.concatenate(out) if out else np.empty(0, "<u4")


class ShardWriter:
    """Streams documents to a file; holds the ids that wait for a whole block, and the footer."""

    def __init__(self, out):
        self.out, self.waiting, self.held, self.at = out, [], 0, len(MAGIC)
        self.starts, self.counts, self.ids = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        n = sum(map(len, ids))
        self.counts.append(n)
        self.ids.append(doc_id)
        self.waiting += ids
        self.held += n
        if self.held >= FLUSH:
            self.flush(self.held // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        self.waiting, self.held = [ids[n:]], len(ids) - n
        for block in encode_blocks(ids[:n]):
            self.starts.append(self.at)
            self.at += len(block)
            self.out.write(block)

    def close(self) -> None:
        self.flush(self.held)
        ids = np.array([x or 0 for x in self.ids], "<i8")
        footer = (np.array(self.starts, "<u8"), np.array(self.counts, "<u8"), ids, np.array([x is None for x in self.ids], "u1"))
        self.out.write(b"".join(x.tobytes() for x in footer) + TRAILER.pack(len(self.starts), len(self.ids), self.at, MAGIC))


def read_footer(file) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    size = file.size()
    file.seek(size - TRAILER.size)
    blocks, docs, at, magic = TRAILER.unpack(file.read(TRAILER.size))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    file.seek(at)
    data = file.read(size - TRAILER.size - at)
    counts_at, ids_at, null_at = 8 * blocks, 8 * (blocks + docs), 8 * (blocks + 2 * docs)
    return np.frombuffer(data, "<u8", blocks), np.frombuffer(data, "<u8", docs, counts_at), np.frombuffer(data, "<i8", docs, ids_at), np.frombuffer(data, "u1", docs, null_at), at


def read_documents(file) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a shard in order, some blocks at a time."""
    starts, counts, ids, null, end = read_footer(file)
    ends, waiting, k = np.append(starts, end), np.empty(0, "<u4"), 0
    step = FLUSH // BLOCK
    for b in range(0, max(len(starts), 1), step):
        group = starts[b : b + step]
        if len(group):
            file.seek(int(group[0]))
            data = file.read(int(ends[b + len(group)] - group[0]))
            waiting = np.concatenate([waiting, decode_blocks(data, group - group[0])])
        while k < len(counts) and counts[k] <= len(waiting):
            n = int(counts[k])
            yield (None if null[k] else int(ids[k])), waiting[:n]
            waiting, k = waiting[n:], k + 1


def stored_order(docs: DataFrame) -> list[Column]:
    """The order in which rows stand in the Parquet files that they are read from; the names of Spark's files ascend."""
    return [F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None, words: int | None = None) -> DataFrame:
    """Writes the shards and returns their manifest, a row each: shard, path, documents, tokens.

    order: of the documents, ascending ids if not given. words: how many parts of words a worker keeps at least before it
    forgets some; if given, all are forgotten when a task ends, so that the memory is free for what runs next, and texts are
    taken in slices of a quarter of the size.
    """
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        path, own = f"{folder}/shard-{shard:06d}.tpf", encoder(tokenizer, words)
        end = np.array([end_id], "<u4")
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        try:
            with writing(path, context.taskAttemptId()) as out:
                writer = ShardWriter(out)
                while batch is not None:
                    for part in slices(batch, BATCH_BYTES if words is None else BATCH_BYTES // 4):
                        ids, counts = own.encode(part["_text"])
                        ends = np.cumsum(counts)
                        for doc_id, first, last in zip(part["_id"].to_pylist(), ends - counts, ends, strict=True):
                            writer.add(doc_id, ids[first:last], end)
                    batch = next(batches, None)
                writer.close()
        finally:
            if words is not None:
                own.forget()
                pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "documents": len(writer.counts), "tokens": sum(writer.counts)}], schema)

    places = [c.alias(f"_place{k}") for k, c in enumerate(order or [])]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"), *places)
    keys: list[Column] = [*(F.col(f"_place{k}") for k in range(len(places))), F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "_text").select("_id", "_text")
    return cut(ordered.mapInArrow(write, "shard long, path string, documents long, tokens long"))


def read_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the shards (shard, path): id, start (ids before it over all shards), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch["shard"].to_pylist(), batch["path"].to_pylist(), strict=True):
                with reading(path) as file:
                    at, rows = 0, []
                    for doc_id, ids in read_documents(file):
                        rows.append((shard, doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["shard", "_id", "_at", "n_tokens", "ids_crc32"])

    files = max(1, shards.count())
    paths = shards.select("shard", "path").repartition(files, "shard")
    docs = cut(paths.mapInArrow(read, "shard long, _id long, _at long, n_tokens long, ids_crc32 long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = docs.groupBy("shard").agg(F.sum("n_tokens").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return docs.join(F.broadcast(totals), "shard").select(F.col("_id").alias(id_col), (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def token_binary(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes documents as shards to a folder that driver and executors share, and reads them back; options: of write_shards."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, folder, tokenizer, end_id, id_col, text_col, **options), id_col)
