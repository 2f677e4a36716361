"""Token ids in sorted-string-table shards.

A shard is one immutable file of documents in key order. Layout, all numbers little-endian:

    MAGIC
    block*     entries (varint shared key bytes, varint other key bytes, varint value bytes, key
               rest, value), then the offsets of the restart entries (u32 each) and their number
               (u32); compressed with zstd, followed by the crc32 of the compressed bytes (u32)
    index      per block: last key (13 bytes), offset (u64), size without crc (u32), entries (u32)
    bloom      bits of the filter over all keys
    footer     offset and size of index and bloom (u64 each), documents (u64), ids (u64),
               bytes per id (u32), probes of the filter (u32), MAGIC

A key is 13 bytes that sort as (null first, doc_id, number among rows of that doc_id). A value is the
ids of a document with its end id. A lookup reads the footer, asks the filter, finds the block by
binary search in the index, and the entry by binary search over the restarts.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, mix, release, workspace

MAGIC = b"WEFTSST1"
BLOCK_BYTES = 1 << 16
RESTART = 16
BITS_PER_KEY, PROBES = 10, 7
END_ID = 0
FOOTER = struct.Struct("<QQQQQQII8s")
_INDEX = struct.Struct("<13sQII")
KEY_BYTES = 13
#: Words whose ids a worker remembers at most; beyond that it drops the longer ones.
CACHED_WORDS = 800_000
SHORT_WORD = 10
#: Bytes of text that a shard has at most, in the mean.
SHARD_BYTES = 1 << 28

MANIFEST_SCHEMA = "shard int, path string, n_docs long, n_ids long, n_bytes long"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
_ROW_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])


# --------------------------------------------------------------------------- keys
def key_of(doc_id: int | None, number: int = 0) -> bytes:
    if doc_id is None:
        return struct.pack(">BQI", 0, 0, number)
    return struct.pack(">BQI", 1, (doc_id + (1 << 63)) & ((1 << 64) - 1), number)


def id_of(key: bytes) -> int | None:
    known, shifted, _ = struct.unpack(">BQI", key)
    return shifted - (1 << 63) if known else None


def _probes(keys: list[bytes], bits: int, probes: int) -> np.ndarray:
    """Of each key, the bits to set or ask, by double hashing."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES).astype(np.uint64)
    h = np.zeros(len(keys), np.uint64)
    for i in range(KEY_BYTES):
        h = mix(h * np.uint64(257) + raw[:, i] + np.uint64(1))
    step = mix(h) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)) % np.uint64(bits)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


# --------------------------------------------------------------------------- writing
class TableWriter:
    """Writes the entries it is given, in rising key order, to an open binary file."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes = out, id_bytes
        self.squeeze = zstandard.ZstdCompressor(level=1).compress
        self.at = self.docs = self.ids = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._put(MAGIC)
        self._open()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _open(self) -> None:
        self.block, self.size, self.restarts, self.entries, self.last = [], 0, [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must rise")
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(self.size)
        else:
            while shared < KEY_BYTES and key[shared] == self.last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(KEY_BYTES - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.entries += 1
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.id_bytes
        if self.size >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.entries:
            self.block.append(struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
            data = self.squeeze(b"".join(self.block))
            self.index.append(_INDEX.pack(self.last, self.at, len(data), self.entries))
            self._put(data + struct.pack("<I", zlib.crc32(data)))
            self._open()

    def close(self) -> None:
        self._close_block()
        index_at = self.at
        self._put(b"".join(self.index))
        bloom_at = self.at
        bits = max(64, len(self.keys) * BITS_PER_KEY + 7 & ~7)
        filled = np.zeros(bits, np.uint8)
        for i in range(0, len(self.keys), 1 << 16):
            filled[_probes(self.keys[i : i + (1 << 16)], bits, PROBES).ravel()] = 1
        self._put(np.packbits(filled).tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, self.docs, self.ids, self.id_bytes, PROBES, MAGIC))


# --------------------------------------------------------------------------- reading
class Table:
    """A shard opened for lookups and scans; keeps index and filter, reads blocks as asked."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        self.index_at, index_size, bloom_at, bloom_size, self.docs, self.ids, self.id_bytes, self.probes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        source.seek(self.index_at)
        rows = list(_INDEX.iter_unpack(source.read(index_size)))
        self.lasts, self.blocks = [r[0] for r in rows], [r[1:] for r in rows]
        source.seek(bloom_at)
        self.bloom = np.frombuffer(source.read(bloom_size), np.uint8)
        self.open = zstandard.ZstdDecompressor().decompress

    def maybe(self, key: bytes) -> bool:
        """False: the table has no such key. True: it may have it."""
        bits = _probes([key], len(self.bloom) * 8, self.probes)[0].astype(np.int64)
        return bool((self.bloom[bits >> 3] >> (7 - (bits & 7)) & 1).all())

    def block(self, i: int) -> tuple[bytes, list[int], int]:
        """(bytes, restarts, where the entries end)"""
        at, size, _ = self.blocks[i]
        self.source.seek(at)
        data = self.source.read(size + 4)
        if zlib.crc32(data[:size]) != struct.unpack("<I", data[size:])[0]:
            raise ValueError("a block's checksum is wrong")
        raw = self.open(data[:size])
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 * (n + 1)
        return raw, list(struct.unpack_from(f"<{n}I", raw, end)), end

    def _entries(self, raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def numbers(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}")

    def get(self, doc_id: int | None, number: int = 0) -> np.ndarray | None:
        key = key_of(doc_id, number)
        if not self.lasts or not self.maybe(key):
            return None
        i = bisect.bisect_left(self.lasts, key)
        if i == len(self.lasts):
            return None
        raw, restarts, end = self.block(i)
        r = bisect.bisect_right(restarts, key, key=lambda at: next(self._entries(raw, at, end))[0]) - 1
        for k, value in self._entries(raw, restarts[max(r, 0)], end):
            if k >= key:
                return self.numbers(value) if k == key else None
        return None

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            raw, _, end = self.block(i)
            for key, value in self._entries(raw, 0, end):
                yield key, self.numbers(value)


def open_table(uri: str) -> Table:
    store, path = fs.FileSystem.from_uri(uri)
    return Table(store.open_input_file(path))


# --------------------------------------------------------------------------- encoding
def usual(text: str) -> bool:
    """Single spaces and line feeds between printable characters, and no other white space.

    What Python calls printable is never white space to a splitter. All other texts are encoded whole.
    """
    return (
        text[0] not in " \n" and text[-1] not in " \n" and "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text
        and text.replace("\n", "").isprintable()
    )


class Encoder:
    """Texts to packed ids, with the ids of recurring words remembered.

    The usual byte-level splitter never joins what stands on both sides of a single space (it goes with
    the word after it) or of a single line feed (a piece of its own) between solid characters. Texts
    are cut there, and each distinct piece is encoded by the tokenizer once. A piece is written as "\r"
    and the word at the start of a text, "\n" and the word at that of a line, else the word alone.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        splitter = parts.get("pre_tokenizer") or {}
        #: Whether the definition's splitter is the one that the class speaks of. For others texts stay whole.
        self.cuts = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True) and not parts.get("normalizer")
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        # in a byte-level vocabulary a token has one character per byte
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], np.int64)
        self.known: dict[str, bytes] = {}
        self.end = np.array([END_ID], self.type).tobytes()

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pack(self, ids) -> bytes:
        return np.asarray(ids, self.type).tobytes()

    @staticmethod
    def spelled(piece: str) -> str:
        return piece[1:] if piece[:1] == "\r" else piece if piece[:1] == "\n" else " " + piece

    def learn(self, pieces: list[str]) -> None:
        """Adds new pieces. Many go in one call; the sizes of its tokens tell where each ends."""
        heads = [p for p in pieces if p[:1] == "\r"]
        for p, ids in zip(heads, self.plain([p[1:] for p in heads])):
            self.known[p] = self.pack(ids)
        rest = [p for p in pieces if p[:1] != "\r"]
        for i in range(0, len(rest), 2000):
            part = rest[i : i + 2000]
            spelled = [self.spelled(p) for p in part]
            ids = np.array(self.plain(["".join(spelled)])[0], np.int64)
            ends, stops = np.cumsum(self.sizes[ids]), np.cumsum([len(x.encode()) for x in spelled])
            cuts = np.searchsorted(ends, stops)
            if len(ids) and (cuts < len(ends)).all() and (ends[cuts] == stops).all():
                packed, width = self.pack(ids), self.type.itemsize
                start = 0
                for p, cut in zip(part, (cuts + 1).tolist()):
                    self.known[p] = packed[start * width : cut * width]
                    start = cut
            else:
                for p, own in zip(part, self.plain(spelled)):
                    self.known[p] = self.pack(own)

    def packed(self, pieces: list[str]) -> list[bytes]:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            # short words recur most; if they are too many as well, all go
            kept = {p: x for p, x in self.known.items() if len(p) <= SHORT_WORD}
            self.known = kept if len(kept) < CACHED_WORDS // 2 else {}
            new = [p for p in pieces if p not in self.known]
        self.learn(new)
        return [self.known[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text, with the end id."""
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, x in enumerate(texts) if x and usual(x)] if self.cuts else []
        odd = sorted({i for i, x in enumerate(texts) if x} - set(plain))
        for i, ids in zip(odd, self.plain([texts[i] for i in odd])):
            out[i] = self.pack(ids)
        if plain:
            marked = pa.array([texts[i] for i in plain], pa.large_string())
            marked = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), pc.replace_substring(marked, "\n", " \n"), pa.scalar("", pa.large_string()))
            lists = pc.split_pattern(marked, " ")
            coded = lists.flatten().dictionary_encode()
            ids = self.packed(coded.dictionary.to_pylist())
            width = self.type.itemsize
            sizes = np.array([len(x) for x in ids], np.int64) // width
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            table = np.frombuffer(b"".join(ids), self.type)
            word = coded.indices.to_numpy()
            n = sizes[word]
            ends = np.cumsum(n)
            flat = table[np.repeat(starts[word] - (ends - n), n) + np.arange(ends[-1])]
            bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            for k, i in enumerate(plain):
                out[i] = flat[bounds[k] : bounds[k + 1]].tobytes()
        return [x + self.end for x in out]


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer definition, kept between tasks."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def _slices(texts: list[str], limit: int = 3 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _write(batches: Iterator[pa.RecordBatch], root: str, definition) -> Iterator[pa.RecordBatch]:
    """Writes the partition, which comes sorted by doc_id, as one shard; yields its manifest row."""
    coder = encoder(definition.value)
    task = TaskContext.get()
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder)
    name = f"{folder}/shard-{task.partitionId():06d}.sst"
    # a retried or doubled attempt writes a file of its own; the last rename wins with equal content
    draft = f"{name}.{task.taskAttemptId()}.tmp"
    last, number = (), 0
    with store.open_output_stream(draft) as out:
        table = TableWriter(out, coder.type.itemsize)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                for doc_id, value in zip(ids[a:b], coder.encode(texts[a:b])):
                    number = number + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    table.add(key_of(doc_id, number), value)
        table.close()
    if table.docs:
        store.move(draft, name)
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": f"{root}/{name.rsplit('/', 1)[1]}", "n_docs": table.docs, "n_ids": table.ids, "n_bytes": table.at}], _MANIFEST_ARROW)
    else:
        store.delete_file(draft)


def write_tables(docs: DataFrame, root: str, tokenizer: str, shards: int | None = None) -> DataFrame:
    """Writes the shards below ``root`` and returns their manifest, a row per shard that has documents.

    ``tokenizer`` is the path of a byte-level definition of the tokenizers library, read on the
    driver. Documents are range-partitioned by doc_id, so shard order is key order.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # a vocabulary, whatever the corpus
    if not shards:
        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(rows.mapInArrow(lambda it: _write(it, f"{root}/tables", definition), MANIFEST_SCHEMA), f"{root}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            rows, start = [], shard["base"]
            for key, ids in open_table(shard["path"]).scan():
                rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard["shard"]))
                start += len(ids)
                if len(rows) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW_ARROW)], schema=_ROW_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW_ARROW)], schema=_ROW_ARROW)


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every entry, as read back from the shards."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    based = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return based.repartition(max(1, manifest.count())).mapInArrow(_read, ROW_SCHEMA)


def tokenize_documents(docs: DataFrame, tokenizer: str, root: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of each row, read from the token tables it writes.

    start counts the ids of all documents before it in rising doc_id order; rows that share a doc_id
    follow each other by text; null doc_ids come first. Rows of one doc_id, and those of none, share a
    shard. Null and empty texts have the end id alone; a text is encoded whole, however long. An empty table writes no shard and gives no rows. Other columns are not read.
    """
    out = write_tables(docs, root or workspace(docs.sparkSession, "tokens"), tokenizer)
    release(docs.sparkSession)
    return read_tables(out)
