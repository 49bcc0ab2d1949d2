"""Token ids as length-delimited binary records with masked checksums, an offset index beside each file, and shuffled reads."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.rows import named
from veriloom.llm.textbytes import slices
from veriloom.operators.ranking import running_totals
from veriloom.session import bound_batches, checkpoint_dir, materialised

#: Bytes of one file of records, of records read at once, and parts of texts whose ids a worker remembers.
FILE_BYTES, BLOCK_BYTES, REMEMBERED = 64 << 20, 4 << 20, 1_000_000

# Fixed values of CRC-32C (Castagnoli, reflected) and of its mask in length-delimited record files.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8

_LANE = 256


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t


_TABLE = _table()


@cache
def _zeros(bit: int) -> np.ndarray:
    """What 2 ** bit bytes of zero make of each byte of a state: 4 x 256 values, as a state's bytes act on their own."""
    if bit == 0:
        value = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
        return _TABLE[value & 0xFF] ^ (value >> np.uint32(8))
    half = _zeros(bit - 1)
    return _apply(half, half)


def _apply(zeros: np.ndarray, state: np.ndarray) -> np.ndarray:
    return zeros[0][state & 0xFF] ^ zeros[1][state >> 8 & 0xFF] ^ zeros[2][state >> 16 & 0xFF] ^ zeros[3][state >> 24]


def _after(state: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """States after as many bytes of zero."""
    state = state.copy()
    for bit in range(int(n_bytes.max(initial=0)).bit_length()):
        on = np.flatnonzero(n_bytes >> bit & 1)
        state[on] = _apply(_zeros(bit), state[on])
    return state


def masked_crc32c(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of byte strings, as uint32. All are cut into lanes of 256 bytes, from their ends, which go through the table
    side by side; a string's lanes are moved on by the bytes behind them and added."""
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    lanes = -(-sizes // _LANE)
    data = b"".join([b"\0" * int(lanes_ * _LANE - n) + p for p, n, lanes_ in zip(parts, sizes, lanes.tolist(), strict=True)])
    columns = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, _LANE).T)
    state = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        state = _TABLE[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
    ends = np.cumsum(lanes)
    state = _after(state, (np.repeat(ends, lanes) - 1 - np.arange(len(state))) * _LANE)
    crc = _after(np.full(len(parts), 0xFFFFFFFF, np.uint32), sizes)
    some = np.flatnonzero(lanes)
    if len(some):
        crc[some] ^= np.bitwise_xor.reduceat(state, (ends - lanes)[some])
    crc ^= np.uint32(0xFFFFFFFF)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(_MASK)


def framed(payloads: list[bytes]) -> list[bytes]:
    """Records: length (8 bytes, little-endian), its masked CRC, the payload, its masked CRC."""
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    a, b = masked_crc32c(heads).astype("<u4").tobytes(), masked_crc32c(payloads).astype("<u4").tobytes()
    return [b"".join((h, a[i : i + 4], p, b[i : i + 4])) for i, h, p in zip(range(0, len(a), 4), heads, payloads, strict=True)]


def unframed(data: bytes, where: str) -> list[bytes]:
    """Payloads of consecutive whole records; wrong checksums are an error."""
    heads, payloads, sums, at = [], [], [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        heads.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + size])
        sums.append(data[at + 8 : at + 12] + data[at + 12 + size : at + 16 + size])
        if len(payloads[-1]) < size or len(sums[-1]) < 8:
            raise ValueError(f"{where}: the last record is cut off")
        at += 16 + size
    told = np.frombuffer(b"".join(sums), "<u4").reshape(-1, 2)
    if (told[:, 0] != masked_crc32c(heads)).any() or (told[:, 1] != masked_crc32c(payloads)).any():
        raise ValueError(f"{where}: a checksum does not match its record")
    return payloads


#: A payload: key (8 bytes, little-endian, signed), 1 if the key is null, bytes an id takes, and the ids, little-endian.
_HEAD = 10


def payload(key: int | None, ids: np.ndarray, width: int) -> bytes:
    return (key or 0).to_bytes(8, "little", signed=True) + bytes((key is None, width)) + ids.astype(f"<u{width}").tobytes()


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    """(key, ids as little-endian uint32) of a payload."""
    key = None if data[8] else int.from_bytes(data[:8], "little", signed=True)
    return key, np.frombuffer(data, f"<u{data[9]}", offset=_HEAD).astype("<u4")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the folder's path in it."""
    plain = re.sub(r"^file:/+", "/", folder)
    return (fs.LocalFileSystem(), unquote(plain) if plain != folder else plain) if plain.startswith("/") else fs.FileSystem.from_uri(folder)


# Signs whose kind no version of Unicode doubts: letters (to U+024F) and signs that are neither letters, digits nor spaces.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SIGNS = "!-/:-@\\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧"
_STRANGE = re.compile(f"[^{_LETTERS}{_SIGNS}0-9\t-\r ]")
#: The usual pattern of byte-level vocabularies, for texts of such signs alone.
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Places where that pattern parts any text: before a space that a letter follows and a visible sign precedes.
_CUT = re.compile("(?<=[!-~])(?= [A-Za-z])")


def _visible() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it is visible in Latin-1, else the next free
    one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_VISIBLE = _visible()


class _Known(dict):
    """The ids of parts of texts, by the tokenizer's merges; short ones are remembered."""

    def __init__(self, model: object) -> None:
        self.model = model

    def __missing__(self, part: str) -> bytes:
        word = part[1:] if part[0] == " " else part
        if word.isalpha() and word.isascii():  # most parts; their bytes stand for themselves
            signs = part if word is part else _VISIBLE[0x20] + word
        else:
            signs = part.encode().decode("latin-1").translate(_VISIBLE)
        ids = [t.id for t in self.model.tokenize(signs)]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= 64:
            self[part] = found
        return found


class Encoder:
    """Ids of whole texts by a tokenizer file. Where it is byte-level with the usual pattern, texts are parted by that pattern
    and equal parts are merged once, REMEMBERED of them; pieces with signs that the pattern's versions may see differently, or
    with names of special tokens, and texts of all other tokenizers are encoded by the tokenizer whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        made = json.loads(self.tokenizer.to_str())
        split, model, added = made["pre_tokenizer"] or {}, made["model"], made["added_tokens"]
        usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and made["normalizer"] is None
        usual = usual and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.parted = usual and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added)
        self.special = [t["content"] for t in added]
        self.width = 2 if max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4
        self.known = _Known(self.tokenizer.model)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _strange(self, text: str) -> bool:
        return _STRANGE.search(text) is not None or any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian uint32."""
        if not self.parted:
            return self._whole(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out, part = [], self.known.__getitem__
        for text in texts:
            if not self._strange(text):
                out.append(b"".join(map(part, _PARTS.findall(text))))
                continue
            pieces = _CUT.split(text)
            odd = {p: b"" for p in pieces if self._strange(p)}
            odd |= zip(odd, self._whole(list(odd)), strict=True)
            out.append(b"".join([odd[p] if p in odd else b"".join(map(part, _PARTS.findall(p))) for p in pieces]))
        return out


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker, which Spark keeps from task to task."""
    return Encoder(path)


class _Files:
    """Files of one task, in order, each with its index; a file counts only when the task's rows name it."""

    def __init__(self, folder: str, width: int, most_bytes: int) -> None:
        self.store, self.path = _store(folder)
        self.width, self.most_bytes, self.number, self.out = width, most_bytes, 0, None
        context = TaskContext.get()
        self.task = context.partitionId() if context else 0

    def _open(self) -> None:
        name = f"{self.task:06d}-{self.number:06d}-{uuid.uuid4().hex}"
        self.name, self.out, self.number = name, self.store.open_output_stream(f"{self.path}/{name}.records"), self.number + 1
        self.index, self.size, self.tokens = [], 0, 0

    def add(self, keys: list[int | None], ids: list[bytes]) -> Iterator[tuple]:
        values = [np.frombuffer(i, "<u4") for i in ids]
        for record, value in zip(framed([payload(k, v, self.width) for k, v in zip(keys, values, strict=True)]), values, strict=True):
            if self.out is None:
                self._open()
            self.out.write(record)
            self.index += (self.size, len(record), len(value))
            self.size, self.tokens = self.size + len(record), self.tokens + len(value)
            if self.size >= self.most_bytes:
                yield self.close()

    def close(self) -> tuple:
        """The row that makes the file count."""
        self.out.close()
        self.out = None
        with self.store.open_output_stream(f"{self.path}/{self.name}.index") as f:
            f.write(np.array(self.index, "<u8").tobytes())
        return self.name, len(self.index) // 3, self.tokens, self.size


def write_tokens(docs: DataFrame, tokenizer: str, end: int | None = None, key: str = "doc_id", text: str = "text", folder: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Encodes every whole text, appends the id `end`, and writes records in ascending order of key; returns the folder.

    `folder`/data has files NAME.records and, for each, NAME.index: of every record its offset, its bytes and its ids (three
    little-endian uint64). `folder`/files is a table (file, n_records, n_tokens, n_bytes), whose names rise with the keys: files
    that it does not list are leftovers of lost tasks and are never read. Names of special tokens in a text become their ids,
    as the tokenizer does by itself. Null keys come first; null and empty texts have only the end id; rows of one key go by
    their texts' hash; a file ends with the record that fills its `file_bytes`, so very long texts are one record each; an empty
    table has no files. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    store, path = _store(f"{folder}/data")
    store.create_dir(path, recursive=True)
    rows = docs.select(named(key).cast("long").alias("key"), named(text).alias("text"), F.xxhash64(named(text)).alias("h"))
    rows = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h").select("key", "text")
    last = b"" if end is None else int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        files = _Files(f"{folder}/data", encoder.width, file_bytes)
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                ids = [i + last for i in encoder.encode([t or "" for t in part.column("text").to_pylist()])]
                done = list(files.add(part.column("key").to_pylist(), ids))
                if done:
                    yield _files(done)
        if files.out is not None:
            yield _files([files.close()])

    rows.mapInArrow(run, "file string, n_records long, n_tokens long, n_bytes long").write.parquet(f"{folder}/files")
    return folder


def _files(rows: list[tuple]) -> pa.RecordBatch:
    names = ["file", "n_records", "n_tokens", "n_bytes"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(4)], names=names)


def _read(spark: SparkSession, folder: str, schema: str, of: Callable[[list[tuple[int | None, int, np.ndarray]]], pa.RecordBatch], shuffle: int | None) -> DataFrame:
    """Rows that `of` makes of (key, start, ids) of each record, file by file, or in an order of their own."""
    files = spark.read.parquet(f"{folder}/files")
    n = files.count()
    placed = running_totals(files.withColumn("one", F.lit(1)), (), "file", {"upto": "n_tokens", "number": "one"})
    dealt = placed.select("file", (F.col("upto") - F.col("n_tokens")).alias("start"), F.col("number").cast("int").alias("number"))
    dealt = materialised(dealt).repartitionById(max(1, n), F.col("number") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(f"{folder}/data")
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_stream(f"{path}/{name}.index") as f:
                    index = np.frombuffer(f.read(), "<u8").astype(np.int64).reshape(-1, 3)
                starts = first + np.cumsum(index[:, 2]) - index[:, 2]
                with store.open_input_file(f"{path}/{name}.records") as f:
                    if shuffle is None:
                        blocks = np.flatnonzero(np.diff(index[:, 0] // BLOCK_BYTES, prepend=-1))
                        spans = zip(blocks.tolist(), [*blocks[1:].tolist(), len(index)], strict=True)
                        wanted = [np.arange(a, b) for a, b in spans]
                    else:
                        order = np.random.default_rng((shuffle, zlib.crc32(name[:13].encode()))).permutation(len(index))
                        wanted = [order[i : i + 64] for i in range(0, len(order), 64)]
                    for chosen in wanted:
                        if shuffle is None:
                            data = f.read_at(int(index[chosen[-1], :2].sum() - index[chosen[0], 0]), int(index[chosen[0], 0]))
                        else:
                            data = b"".join([f.read_at(int(index[i, 1]), int(index[i, 0])) for i in chosen])
                        found = [parsed(p) for p in unframed(data, name)]
                        yield of([(k, int(starts[i]), ids) for i, (k, ids) in zip(chosen, found, strict=True)])

    return dealt.select("file", "start").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, folder: str, shuffle: int | None = None) -> DataFrame:
    """(key, start, ids) of every record of a folder; start: ids of all records before it. With a number for `shuffle`, a
    file's records are read by its index in an order that the number decides. Checksums are verified."""

    def of(rows: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(r[2]) for r in rows]]), pa.int32()), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), ids], names=["key", "start", "ids"])

    return _read(spark, folder, "key long, start long, ids array<int>", of, shuffle)


def digests(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every record of a folder, read and verified; the checksum is that of the ids as
    little-endian unsigned 32-bit integers."""

    def of(rows: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        columns = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].tobytes()) for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[key, "start", "n_tokens", "ids_crc32"])

    return _read(spark, folder, f"`{key}` long, start long, n_tokens long, ids_crc32 long", of, None)
