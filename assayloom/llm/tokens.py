"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

A file, all little-endian:

    b"PFR1"
    blocks     1024 values each: ``width`` x 32 words of 32 bits. Value i stands in row i // 32, lane
               i % 32; a lane's 32 values of ``width`` bits fill ``width`` words. Values are ids less
               the block's minimum; bits over ``width`` are left out here. Then, for each exception,
               its place (uint16), and for each its bits over ``width`` (uint32).
    index      per block: start in the file (uint64), minimum (uint32), exceptions (uint16), width (uint8)
    documents  per document: doc_id (int64), n_tokens (uint32)
    footer     blocks, documents, values (uint64 each), b"PFR1"

``width`` is what the values at a percentile of the block need, so few wide ids don't widen the rest.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import batches, fresh_path, stored
from assayloom.llm.files import read_whole, write_whole

MAGIC, BLOCK, LANES = b"PFR1", 1024, 32
_INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("patches", "<u2"), ("width", "u1")])
_DOCS = np.dtype([("doc_id", "<i8"), ("n", "<u4")])
_FOOTER = "<QQQ4s"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that unsigned 32-bit values need."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(rows: np.ndarray, w: int) -> np.ndarray:
    """(blocks, 32 rows, 32 lanes) of w-bit values to (blocks, w, 32) words."""
    out = np.zeros((len(rows), w, LANES), np.uint32)
    for r in range(LANES if w else 0):
        at, shift = divmod(r * w, 32)
        v = rows[:, r, :]
        out[:, at, :] |= v << np.uint32(shift)
        if shift + w > 32:
            out[:, at + 1, :] |= v >> np.uint32(32 - shift)
    return out


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    out = np.zeros((len(words), LANES, LANES), np.uint32)
    mask = np.uint32((1 << w) - 1)
    for r in range(LANES if w else 0):
        at, shift = divmod(r * w, 32)
        v = words[:, at, :] >> np.uint32(shift)
        if shift + w > 32:
            v = v | words[:, at + 1, :] << np.uint32(32 - shift)
        out[:, r, :] = v & mask
    return out


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, percentile: float = 99.0) -> bytes:
    """One file of the documents' ids, one document after the other."""
    n_blocks = -(-len(ids) // BLOCK)
    v = np.empty(n_blocks * BLOCK, np.uint32)
    v[: len(ids)] = ids
    if len(ids):
        v[len(ids) :] = ids[-1]
    v = v.reshape(n_blocks, BLOCK)
    low = v.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    v = v - low[:, None]
    need = _bits(v)
    rank = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    width = np.partition(need, rank, axis=1)[:, rank] if n_blocks else np.zeros(0, np.uint8)
    packed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        packed[int(w)] = (own, _pack((v[own] & np.uint32((1 << int(w)) - 1)).reshape(-1, LANES, LANES), int(w)))
    row, place = np.nonzero(need > width[:, None])
    high = v[row, place] >> np.minimum(width[row], 31).astype(np.uint32)
    first = np.searchsorted(row, np.arange(n_blocks + 1))
    index = np.zeros(n_blocks, _INDEX)
    index["low"], index["width"], index["patches"] = low, width, np.diff(first)
    out, where = bytearray(MAGIC), {w: dict(zip(own.tolist(), range(len(own)), strict=True)) for w, (own, _) in packed.items()}
    for i in range(n_blocks):
        index["start"][i] = len(out)
        w = int(width[i])
        out += packed[w][1][where[w][i]].astype("<u4").tobytes()
        a, b = first[i], first[i + 1]
        out += place[a:b].astype("<u2").tobytes() + high[a:b].astype("<u4").tobytes()
    docs = np.zeros(len(doc_ids), _DOCS)
    docs["doc_id"], docs["n"] = doc_ids, lengths
    return bytes(out + index.tobytes() + docs.tobytes() + struct.pack(_FOOTER, n_blocks, len(docs), len(ids), MAGIC))


class TokenFile:
    """A file's ids, all of them or a range found by the block index."""

    def __init__(self, data: bytes):
        blocks, docs, self.n, magic = struct.unpack(_FOOTER, data[-struct.calcsize(_FOOTER) :])
        if magic != MAGIC or data[:4] != MAGIC:
            raise ValueError("not a token file")
        at = len(data) - struct.calcsize(_FOOTER) - docs * _DOCS.itemsize
        self.docs = np.frombuffer(data, _DOCS, docs, at)
        self.index = np.frombuffer(data, _INDEX, blocks, at - blocks * _INDEX.itemsize)
        self.data = data

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Values of blocks ``first`` to ``last`` - 1."""
        index = self.index[first:last]
        out = np.empty((len(index), BLOCK), np.uint32)
        raw = np.frombuffer(self.data, np.uint8)
        for w in np.unique(index["width"]):
            own, size = np.flatnonzero(index["width"] == w), int(w) * LANES * 4
            words = np.stack([raw[int(s) : int(s) + size] for s in index["start"][own]]).view("<u4").reshape(len(own), int(w), LANES)
            out[own] = _unpack(words, int(w)).reshape(len(own), BLOCK)
        for i, e in enumerate(index):
            if k := int(e["patches"]):
                at = int(e["start"]) + int(e["width"]) * LANES * 4
                place = np.frombuffer(self.data, "<u2", k, at)
                out[i, place] |= np.frombuffer(self.data, "<u4", k, at + 2 * k) << np.uint32(e["width"])
        return out + index["low"][:, None]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n if stop is None else min(stop, self.n)
        first = start // BLOCK
        return self.blocks(first, -(-stop // BLOCK)).ravel()[start - first * BLOCK : stop - first * BLOCK]


class WordCoder:
    """Ids of whole texts by the tokenizers library, each word run through it when it is new.

    The byte-level pattern never joins what stands before a single space with what stands after it,
    so a text is cut at every space between two non-spaces, and pieces seen lately are looked up.
    What is new goes to the library in one string; its ids are dealt to the pieces by byte length.
    A text with other spaces beside a space is cut at the remaining places only. A text that holds one of
    the tokenizer's added tokens, which the library takes out first, goes to it whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}  # " " + piece
        self.old: dict[str, bytes] = {}
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # one character stands for one byte
        self.cut = re.compile(r"(?<=\S)(?= \S)")

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20000):
            part = new[at : at + 20000]
            ids = self.library([" " + " ".join(part)])[0]
            ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in part), np.int64, len(part)))
            stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            last = 0
            for p, stop in zip(part, stops.tolist(), strict=True):
                self.young[p] = ids[last:stop].tobytes()
                last = stop

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if whole:
            rest = sorted(set(range(len(texts))) - set(whole))
            got = dict(zip(whole, self.library([texts[i] for i in whole]), strict=True))
            got.update(zip(rest, self.encode_cut([texts[i] for i in rest]), strict=True))
            return [got[i] for i in range(len(texts))]
        return self.encode_cut(texts)

    def encode_cut(self, texts: list[str]) -> list[np.ndarray]:
        cut = [t.split(" ") for t in texts]
        new = set().union(*cut) - self.young.keys()
        seen = new & self.old.keys()
        self.young.update((p, self.old[p]) for p in seen)
        new -= seen
        odd = {p for p in new if not (p and p[0].strip() and p[-1].strip())}
        if plain := sorted(new - odd):
            self.learn(plain)
        get = self.young.__getitem__
        out: list[np.ndarray | None] = []
        alone: dict[str, list[int]] = {}
        for i, (text, parts) in enumerate(zip(texts, cut, strict=True)):
            if len(parts) < 2 or (odd and not odd.isdisjoint(parts)):
                alone.setdefault(text, []).append(i)
                out.append(None)
            else:
                out.append(np.frombuffer(b"".join(map(get, parts[1:])), self.kind))
        heads = [c[0] for c, o in zip(cut, out, strict=True) if o is not None]
        coded = dict(zip(heads, self.library(heads), strict=True)) if heads else {}
        out = [o if o is None else np.concatenate([coded[c[0]], o]) for c, o in zip(cut, out, strict=True)]
        for text, at in alone.items():
            pieces = self.cut.split(text) if text else []
            ids = np.concatenate([np.zeros(0, self.kind), *self.library(pieces)])
            for i in at:
                out[i] = ids
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out


def coder(path: str) -> WordCoder:
    """This worker process's coder, kept between its tasks."""
    kept = sys.modules.setdefault("_assayloom_coders", types.ModuleType("_assayloom_coders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordCoder(path)
    return kept.__dict__[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, file_tokens: int = 4_000_000, percentile: float = 99.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files in ascending id order; return their manifest (part, file, path, n_docs, n_tokens), stored.

    The range partition of an id decides its part; a part is sorted and cut into files of about
    ``file_tokens`` ids, between documents. Null texts are empty: the end id alone. Null ids go first
    and are written as the smallest long. Rows that share an id follow each other by text hash.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.repartitionByRange("id").withColumn("h", F.xxhash64("t")).sortWithinPartitions("id", "h").select("id", "t")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, code = TaskContext.get().partitionId(), 0, coder(tokenizer_path)
        held, names, lengths, size = [], [], [], 0
        end = np.array([end_id], code.kind)

        def close() -> pa.RecordBatch:
            nonlocal files, held, names, lengths, size
            path = f"{folder}/part-{part:06d}-{files:04d}.pfr"
            write_whole(path, encode_file(np.concatenate(held), np.array(names, np.int64), np.array(lengths, np.int64), percentile))
            made = pa.RecordBatch.from_pylist([{"part": part, "file": files, "path": path, "n_docs": len(names), "n_tokens": size}])
            files, held, names, lengths, size = files + 1, [], [], [], 0
            return made

        for batch in batches(it, 1000):
            coded = code.encode_batch(batch.column(1).to_pylist())
            for name, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                held += [ids, end]
                names.append(name)
                lengths.append(len(ids) + 1)
                size += len(ids) + 1
                if size >= file_tokens:
                    yield close()
        if names:
            yield close()

    return stored(rows.mapInArrow(run, "part long, file long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame, id_col: str = "doc_id", most_tasks: int = 20_000) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, from the files alone.

    A file's first position is the number of ids in the files before it: a running sum over the
    manifest, whose rows are files, not documents. Files are dealt out one to a task, up to ``most_tasks``.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    files = stored(manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")), "token-files")
    # a number of its own: adaptive execution would merge tasks by the manifest's bytes, not the files'
    files = files.repartition(max(1, min(files.count(), most_tasks)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, base in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                f = TokenFile(read_whole(path))
                ids, n = f.ids().astype("<u4"), f.docs["n"].astype(np.int64)
                stop = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (b - c) : 4 * b]) for b, c in zip(stop.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.docs["doc_id"]), pa.array(base + stop - n), pa.array(n), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    out = files.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
    return out.select(F.when(F.col("id") != -(2**63), F.col("id")).alias(id_col), "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the files of ``docs`` in the shared folder and return what they hold, a row per document."""
    folder = fresh_path(docs.sparkSession, "tokens")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return read_tokens(write_tokens(docs, tokenizer_path, folder, end_id))
