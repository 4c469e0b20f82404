"""TF-IDF sums of whole texts from compact postings, in one shuffle of some seven bytes a posting.

A posting is a text's distinct term: its key, a 64-bit hash of article and term, the text's place in its block, its count.
Blocks of postings are cut by the keys' first bits into slots. All postings of a key meet in one slot, where its document
frequency is counted over all texts of the article; sums by text go back to the text's block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.hashing import hash_words, mix64, rolling

_SLOT_BITS = 10
_SHIFT = np.uint64(64 - _SLOT_BITS)
#: A block ends with the text that takes it to so many postings, or so many texts.
_POSTINGS, _TEXTS = 1 << 21, 60_000
#: Sums by text over its terms: counts squared times L and L * L, query counts times counts times 1, L and L * L, where L = ln(1 + df).
_SUMS = 5


def _grams(tokens: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens and pairs of neighbours, and how often each is there."""
    h = hash_words(tokens)
    if not len(h):
        return h, np.zeros(0, np.int64)
    s = np.sort(np.concatenate([h, rolling(h, 2)]) if len(h) > 1 else h)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


def _packed(key: np.ndarray, place: np.ndarray, count: np.ndarray, texts: int) -> bytes:
    """One slot's postings by ascending key: bytes that don't compress as they are, the others compressed."""
    step = np.diff(key & ((np.uint64(1) << _SHIFT) - np.uint64(1)), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    place, count = place.astype("<u2").view(np.uint8).reshape(-1, 2), count.astype("<i4").view(np.uint8).reshape(-1, 4)
    rest = np.column_stack([step[:, 5:7], place[:, 1:], count]).T.tobytes()
    return b"".join([np.array([len(key), texts], "<u4").tobytes(), step[:, :5].tobytes(), place[:, 0].tobytes(), zlib.compress(rest, 1)])


def _unpacked(data: bytes, slot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    n, texts = (int(x) for x in np.frombuffer(data, "<u4", 2))
    rest = np.frombuffer(zlib.decompress(data[8 + 6 * n :]), np.uint8).reshape(7, n).T
    step, place, count = np.zeros((n, 8), np.uint8), np.zeros((n, 2), np.uint8), np.ascontiguousarray(rest[:, 3:])
    step[:, :5], step[:, 5:7] = np.frombuffer(data, np.uint8, 5 * n, 8).reshape(n, 5), rest[:, :2]
    place[:, 0], place[:, 1] = np.frombuffer(data, np.uint8, n, 8 + 5 * n), rest[:, 2]
    key = np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) | (np.uint64(slot) << _SHIFT)
    return key, place.view("<u2").ravel().astype(np.int64), count.view("<i4").ravel().astype(np.int64), texts


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blocks: a row that names the block's texts (slot under 0) and a row of postings for each slot."""
    partition, made = TaskContext.get().partitionId(), 0
    heads, keys, counts, squares, size = [], [], [], [], 0

    def block() -> Iterator[pa.RecordBatch]:
        n = len(squares)
        name = (partition << 24) + made
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([h.column(k) for h in heads])) for k in range(3)]
        head = [pa.array([-1 - name % 4096], pa.int32()), pa.array([name]), pa.array([None], pa.binary()), *lists, pa.array([squares], pa.list_(pa.float64()))]
        names = ["slot", "block", "data", "a", "i", "m", "s0"]
        yield pa.RecordBatch.from_arrays(head, names=names)
        key, count, place = np.concatenate(keys), np.concatenate(counts), np.repeat(np.arange(n), [len(k) for k in keys])
        order = np.argsort(key)
        key, count, place = key[order], count[order], place[order]
        slot = (key >> _SHIFT).astype(np.int32)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(slot)]]) if len(slot) else np.zeros(1, int)
        parts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        data = [_packed(key[x:y], place[x:y], count[x:y], n) for x, y in parts]
        for at in range(0, len(parts), 64):
            few = slice(at, at + 64)
            k = len(parts[few])
            columns = [pa.array(slot[[x for x, _ in parts[few]]]), pa.array([name] * k, pa.int64()), pa.array(data[few], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(k, c.type) for c in head[3:])], names=names)

    for batch in it:
        start = 0
        asked, salt = batch.column(2).is_valid().to_pylist(), mix64(np.array(batch.column(3)).view(np.uint64))
        for at, text in enumerate(batch.column(4)):
            term, count = _grams(text.as_py())
            keys.append(mix64(term ^ salt[at]))
            # a query's counts are stored below 0
            counts.append(-count if asked[at] else count)
            squares.append(float((count * count).sum()))
            size += len(term)
            if size >= _POSTINGS or len(squares) >= _TEXTS:
                heads.append(batch.select([0, 1, 2]).slice(start, at + 1 - start))
                yield from block()
                start, made, size = at + 1, made + 1, 0
                heads, keys, counts, squares = [], [], [], []
        if start < batch.num_rows:
            heads.append(batch.select([0, 1, 2]).slice(start))
    if squares:
        yield from block()


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's slots, in order, to one row of sums a block; the rows that name texts pass."""
    part = TaskContext.get().partitionId()
    base: dict[int, int] = {}
    total, used = np.zeros((_SUMS, 0)), 0
    held, size = [], 0

    def add() -> None:
        key, text, count = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key)
        key, text, count = key[order], text[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        log = np.repeat(np.log1p(n), n)
        asked = np.repeat(np.add.reduceat(np.where(count < 0, -count, 0), first), n)
        square = (count * count).astype(float)
        np.add.at(total[0], text, square * log)
        np.add.at(total[1], text, square * log * log)
        hit = np.flatnonzero(asked)
        text, log, both = text[hit], log[hit], (asked[hit] * np.abs(count[hit])).astype(float)
        for k in range(3):
            np.add.at(total[2 + k], text, both * log**k)

    last = None
    for batch in it:
        named = batch.filter(pc.less(batch.column(0), 0))
        if named.num_rows:
            columns = [pa.array([-1] * named.num_rows, pa.int32()), pa.nulls(named.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([named.column(1), *columns, *(named.column(k) for k in range(3, 7))], names=["block", "part", "data", "a", "i", "m", "s0"])
        kinds = [batch.column(k).type for k in range(3, 7)]
        for slot, block, data in zip(*(batch.column(k) for k in range(3)), strict=True):
            slot = slot.as_py()
            if slot < 0:
                continue
            if slot != last and size >= 1 << 20:
                add()
                held, size = [], 0
            last, name = slot, block.as_py()
            key, place, count, texts = _unpacked(data.as_py(), slot)
            if name not in base:
                base[name], used = used, used + texts
                if used > total.shape[1]:
                    total = np.concatenate([total, np.zeros((_SUMS, max(used, 2 * total.shape[1]) - total.shape[1]))], axis=1)
            held.append((key, base[name] + place, count))
            size += len(key)
    if held:
        add()
    edge = [*base.values(), used]
    for at, name in enumerate(base):
        data = np.ascontiguousarray(total[:, edge[at] : edge[at + 1]]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([data], pa.binary()), *(pa.nulls(1, k) for k in kinds)], names=["block", "part", "data", "a", "i", "m", "s0"])


def _by_text(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, the row that names texts first, to a row a text."""
    head, total = None, None

    def out() -> pa.RecordBatch:
        columns = [head.column(k).flatten() for k in range(3, 7)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(t) for t in total)], names=["a", "i", "m", "s0", "s1", "s2", "d0", "d1", "d2"])

    for batch in it:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            if row.column(1)[0].as_py() < 0:
                if head is not None:
                    yield out()
                head = row
                total = np.zeros((_SUMS, len(row.column(3).flatten())))
            else:
                total += np.frombuffer(row.column(2)[0].as_py()).reshape(_SUMS, -1)
    if head is not None:
        yield out()


def tfidf_sums(texts: DataFrame, tasks: int = 32) -> DataFrame:
    """(a, i, m, s0, s1, s2, d0, d1, d2), a row per row of ``texts``: (a, i, m, t), tokens parted by spaces.

    A row with ``m`` is the query of article ``a``; it counts as one of the article's texts. With f a term's count, L the
    ln(1 + df) of its document frequency in the article and q its count in the query, s0, s1 and s2 are the sums of
    f * f, f * f * L and f * f * L * L over a text's terms, and d0, d1 and d2 those of q * f, q * f * L and q * f * L * L.
    Equal texts of an article have equal sums to the last bit. At most ``tasks`` tasks sum up; each sends back 40 bytes a text.
    """
    a, i = (texts.schema[c].dataType.simpleString() for c in "ai")
    named = f"a array<{a}>, i array<{i}>, m array<bigint>, s0 array<double>"
    tasks = min(tasks, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.select("a", "i", "m", F.xxhash64("a").alias("h"), F.coalesce(F.col("t").cast("binary"), F.lit(b"")).alias("t"))
    postings = rows.mapInArrow(_blocks, f"slot int, block long, data binary, {named}").repartition(tasks, "slot").sortWithinPartitions("slot", "block")
    sums = postings.mapInArrow(_sums, f"block long, part int, data binary, {named}").repartition(tasks, "block").sortWithinPartitions("block", "part")
    return sums.mapInArrow(_by_text, f"a {a}, i {i}, m long, s0 double, s1 double, s2 double, d0 double, d1 double, d2 double")


def weighed(base: Column, x: str) -> Column:
    """A sum over terms times (base - L) squared, from the three sums whose names begin with ``x``."""
    return base * base * F.col(f"{x}0") - 2.0 * base * F.col(f"{x}1") + F.col(f"{x}2")
