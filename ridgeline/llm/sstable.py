"""Token ids in sorted-string-table shards.

A shard file holds rows in ascending key order: prefix-compressed blocks, then a sparse index with the first key
of each block, a Bloom filter over the ids, and a fixed footer.  A key is the id as 8 big-endian bytes with the
sign bit flipped (so byte order is numeric order; a null id is the lowest) and a 4-byte count that tells repeated ids
apart.  A value is the ids as 16-bit integers where the vocabulary allows it, else 32-bit, little-endian.

    entry   varint shared, varint suffix length, varint value length, suffix, value
    footer  index offset, index length, Bloom offset, Bloom length, rows, tokens, item width, magic
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import by_size, local_path, materialise, schema_of, shared_dir, texts_of

FOOTER = struct.Struct("<QQQQQQI8s")
MAGIC = b"RDGSST01"
BLOCK_BYTES = 32 * 1024
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
#: Characters, and rows, of texts that are encoded together; a longer text is encoded alone.
ENCODED_CHARS, ENCODED_ROWS = 1 << 22, 1024


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    return (b"\0" * 8 if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", repeat)


def id_of(key: bytes) -> int | None:
    k = struct.unpack(">Q", key[:8])[0]
    return k - (1 << 63) if k else None


def bloom_bits(doc_id: int | None, n_bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key_of(doc_id))
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [(a + i * b) % n_bits for i in range(BLOOM_HASHES)]


class Writer:
    """Rows must come in ascending key order; holds one block and the index, not the shard."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.index, self.last, self.ids = bytearray(), [], b"", []
        self.rows = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        repeat = struct.unpack(">I", self.last[8:])[0] + 1 if self.last and id_of(self.last) == doc_id else 0
        if self.width == 2 and len(ids) and ids.max() > 0xFFFF:
            raise ValueError(f"id {ids.max()} does not fit into 16 bits; write with width=4")
        key, value = key_of(doc_id, repeat), ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        shared = 0
        if not self.block:
            self.index.append((key, self.at))
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.rows, self.tokens = key, self.rows + 1, self.tokens + len(ids)
        if not repeat:
            self.ids.append(doc_id)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        self.out.write(bytes(self.block))
        self.at += len(self.block)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self.flush()
        index = b"".join(key + struct.pack("<Q", at) for key, at in self.index)
        n_bits = max(64, len(self.ids) * BLOOM_BITS_PER_KEY)
        bloom = bytearray((n_bits + 7) // 8)
        for doc_id in self.ids:
            for bit in bloom_bits(doc_id, n_bits):
                bloom[bit >> 3] |= 1 << (bit & 7)
        self.out.write(index + struct.pack("<Q", n_bits) + bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), 8 + len(bloom), self.rows, self.tokens, self.width, MAGIC))


class Reader:
    """Reads the footer, index and Bloom filter at once and blocks as they are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        index_at, index_len, bloom_at, bloom_len, self.rows, self.tokens, self.width, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format, or cut short")
        index, bloom = self.read(index_at, index_len), self.read(bloom_at, bloom_len)
        self.keys = [index[i : i + 12] for i in range(0, len(index), 20)]
        self.offsets = [*(struct.unpack("<Q", index[i + 12 : i + 20])[0] for i in range(0, len(index), 20)), index_at]
        self.n_bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        data, at, key = self.read(self.offsets[k], self.offsets[k + 1] - self.offsets[k]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            n, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + n], at + n
            yield id_of(key), np.frombuffer(data[at : at + size], "<u2" if self.width == 2 else "<u4").astype("<u4")
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.keys)):
            yield from self.block(k)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(doc_id, self.n_bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each row with this id: Bloom filter, binary search in the sparse index, then one block (more for repeats)."""
        found: list[np.ndarray] = []
        if not self.keys or not self.may_hold(doc_id):
            return found
        k = max(0, bisect_right(self.keys, key_of(doc_id)) - 1)
        while k < len(self.keys) and self.keys[k] <= key_of(doc_id, 2**32 - 1):
            found += [ids for key, ids in self.block(k) if key == doc_id]
            k += 1
        return found


class WordTokenizer:
    """The tokenizers library behind a bounded memory of words.

    The byte-level pattern always starts a match at a space between two non-spaces, so a text is cut there and each
    distinct word is encoded once.  New words go to the library as one text, in which every token with a leading space
    begins a word.  Texts with a space inside a longer run of white space or before white space at their end, or with an
    added token spelled out (which is that token's id), go to it whole.
    """

    words, word_chars = 150_000, 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.uncut = re.compile(r" (?<=\s )(?:\s|\Z)")
        size = self.tokenizer.get_vocab_size()
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ask(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids behind a space."""
        # Without white space at either end a word keeps its borders between other words.
        firm = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        ids = self.ids(["".join([" " + w for w in firm])])[0]
        at = np.flatnonzero(self.begins[ids]).tolist()
        if len(at) != len(firm):  # a token with a space inside: each word alone
            firm, at = [], []
        data = ids.tobytes()
        yield from ((w, data[4 * a : 4 * b]) for w, a, b in zip(firm, at, [*at[1:], len(ids)], strict=False))
        known = set(firm)
        rest = [w for w in words if w not in known]
        yield from ((w, x.tobytes()) for w, x in zip(rest, self.ids([" " + w for w in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        whole = [bool(self.uncut.search(t)) or any(x in t for x in self.literals) for t in texts]
        cut = [[""] if w else t.split(" ") for t, w in zip(texts, whole, strict=True)]
        heads = self.ids([c[0] for c in cut])
        for c in cut:
            del c[0]
        if len(self.seen) > self.words:
            self.before, self.seen = self.seen, {}
        seen, before = self.seen, self.before
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in seen]
        seen.update((w, before[w]) for w in new if w in before)
        seen.update(self.ask([w for w in new if w not in before]))
        out = [np.frombuffer(b"".join([head.tobytes(), *map(seen.__getitem__, c)]), np.uint32) for head, c in zip(heads, cut, strict=True)]
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        for w in new:
            if len(w) > self.word_chars:
                del seen[w]
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, add end_id to each, and write shards in ascending id order; returns the manifest.

    Manifest: shard, path, n_docs, n_tokens, one row per file.  Null texts are empty (they hold end_id alone), null
    ids come first, rows with one id are kept apart in order of their texts, further columns are dropped.  Rows are
    dealt by range of (id, hash of text), so no shard grows with one id.  A task writes to a name of its own and
    renames at the end, so a repeated attempt leaves one whole file.
    """
    folder = shared_dir(docs.sparkSession, "token-shards")
    ddl = "shard int, path string, n_docs bigint, n_tokens bigint"
    target = to_arrow_schema(schema_of(ddl))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, t = TaskContext.get(), word_tokenizer(tokenizer)
        store, root = local_path(folder)
        store.create_dir(root, recursive=True)
        shard = task.partitionId()
        temporary, final = f"{root}/.shard-{shard:06d}-{task.taskAttemptId()}", f"{root}/shard-{shard:06d}.sst"
        end = np.array([end_id], np.uint32)
        with store.open_output_stream(temporary) as out:
            w = Writer(out, width)
            for batch in batches:
                for at in range(0, batch.num_rows, ENCODED_ROWS):
                    part = batch.slice(at, ENCODED_ROWS)
                    encoded = chain.from_iterable(map(t.encode, by_size(texts_of(part), ENCODED_CHARS)))
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                        w.add(doc_id, np.concatenate([ids, end]))
            w.close()
        if w.rows:
            store.move(temporary, final)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": final, "n_docs": w.rows, "n_tokens": w.tokens}], schema=target)
        else:
            store.delete_file(temporary)

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    return materialise(rows.mapInArrow(write, schema_of(ddl)), "token-manifest").withColumn("folder", F.lit(folder))


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files; one task per shard.

    start counts the ids of all rows before; the driver holds one small row per shard file for it.
    """
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    files, total = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        files.append((r["path"], r["folder"], total))
        total += r["n_tokens"]
    target = to_arrow_schema(schema_of(ddl))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, folder, start in (tuple(x.values()) for b in batches for x in b.to_pylist()):
            store, _ = local_path(folder)
            with store.open_input_file(path) as f:
                rows = []
                for doc_id, ids in Reader(f).scan():
                    rows.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
                    start += len(ids)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=target)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)

    names = spark.createDataFrame(files, "path string, folder string, start bigint").repartition(max(1, len(files)))
    return names.mapInArrow(read, schema_of(ddl))
