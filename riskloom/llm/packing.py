"""Packing documents into fixed windows in bounded space, online.

Each partition is one pass with a fixed number of open windows. A document longer than a
window is cut into whole windows and a rest; a rest goes to the open window with the least
room that it fits; when it fits none, the fullest window is emitted and a new one opened.
What stays open in the partitions is merged at the end, as whole windows, in groups of a
fixed number of partitions. A partition's pass depends on nothing but its rows in order,
so a lost executor only repeats it; the pieces are checkpointed before the merge.

Defined results: a null or empty text is the end id alone; repeated rows are packed each;
among windows with equal room the oldest is taken; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import as_texts, per_worker
from riskloom.session import checkpoint

WINDOW = 4096
OPEN_WINDOWS = 64
#: Partitions whose leftovers are merged together.
MERGED_PARTITIONS = 64
END_ID = 2

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, leftover boolean"


class WordIds:
    """Ids of a text by the tokenizers library, which is asked once for each word.

    This tokenizer lower-cases, turns white space into single spaces and never joins what
    white space parts, so the ids of a text are those of its lower-case words in a row.
    Where this could differ (special tokens, letters whose lower case depends on what
    stands beside them, text not in composed form, control characters that only some call
    white space) the library gets the whole text. `kept` bounds the words remembered."""

    WHOLE = re.compile("<\\||[\x1c-\x1f\u03a3\u0130]")

    def __init__(self, tokenizer_file: str, kept: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kept, self.young, self.old = kept // 2, {}, {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "\0"
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])

    @staticmethod
    def packed(ids) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def words(self, text: str) -> list[str] | None:
        if self.WHOLE.search(text):
            return None
        low = text.lower()
        if not (text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low)):
            return None
        return low.split()

    #: A word and the marks after it: the splitter always parts these.
    TAIL = re.compile(r"(\w+?)([^\w\s]+)")

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word of letters. The library gets many as one text; it marks the last
        token of a word, which tells them apart again."""
        for i in range(0, len(words), 5000):
            block = words[i : i + 5000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) == len(block):
                raw = ids.tobytes()
                yield from (raw[at:end] for at, end in zip([0, *ends], ends))
            else:  # some are parted by the splitter
                yield from self.encode_each(block)

    def encode_each(self, words: list[str]) -> Iterator[bytes]:
        for i in range(0, len(words), 5000):
            for e in self.tokenizer.encode_batch_fast(words[i : i + 5000], add_special_tokens=False):
                yield self.packed(e.ids)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that `young` does not hold, most of which it will: a word with marks
        after it only if the word alone was known, as a rare one need not be held twice."""
        found, parted, letters, others = {}, [], {}, {}
        for w in words:
            if (b := self.old.get(w)) is not None:
                found[w] = b
            elif w.isalpha():
                letters[w] = None
            elif (m := self.TAIL.fullmatch(w)) and m[1].isalpha():
                parted.append((w, m[1], m[2]))
            else:
                others[w] = None
        for _, head, tail in parted:
            for w, new in ((head, letters), (tail, others)):
                if (b := self.young.get(w, self.old.get(w))) is None:
                    new[w] = None
                else:
                    found[w] = b
        found.update(zip(letters, self.encode_words(list(letters)), strict=True))
        found.update(zip(others, self.encode_each(list(others)), strict=True))
        joined = {w: found[head] + found[tail] for w, head, tail in parted}
        if len(self.young) >= self.kept:
            self.old, self.young = self.young, {}
        self.young.update((w, b) for w, b in found.items() if len(w) <= 64)
        self.young.update((w, joined[w]) for w, head, _ in parted if head not in letters and len(w) <= 64)
        return found | joined

    @staticmethod
    def blocks(texts: Iterable[str]) -> Iterator[list[str]]:
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= 300_000:
                yield block
                block, size = [], 0
        if block:
            yield block

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        for block in self.blocks(texts):
            split = [self.words(t) for t in block]
            parts = [None if s is None else list(map(self.young.get, s)) for s in split]
            missing = {w for s, p in zip(split, parts, strict=True) if p and None in p for w, b in zip(s, p, strict=True) if b is None}
            found = self.learn(list(missing)) if missing else {}
            for t, s, p in zip(block, split, parts, strict=True):
                if p is None:
                    yield self.packed(self.tokenizer.encode(t, add_special_tokens=False).ids)
                elif found and None in p:
                    yield b"".join([found[w] if b is None else b for w, b in zip(s, p, strict=True)])
                else:
                    yield b"".join(p)


class OpenWindows:
    """The open windows of one pass; `put` returns the pieces of a window that it emits."""

    def __init__(self, size: int, n_open: int) -> None:
        self.size, self.n_open = size, n_open
        self.room: list[int] = []
        self.held: list[list] = []

    def put(self, length: int, piece) -> list | None:
        best, least = -1, self.size + 1
        for i, room in enumerate(self.room):
            if length <= room < least:
                best, least = i, room
        out = None
        if best < 0:
            if len(self.room) >= self.n_open:
                fullest = min(range(len(self.room)), key=self.room.__getitem__)
                self.room.pop(fullest)
                out = self.held.pop(fullest)
            self.room.append(self.size)
            self.held.append([])
            best = len(self.room) - 1
        self.held[best].append(piece)
        self.room[best] -= length
        if not self.room[best]:
            self.room.pop(best)
            full = self.held.pop(best)
            return full if out is None else out + [None] + full
        return out


def place_documents(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, n_open: int = OPEN_WINDOWS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents in windows numbered by partition, `leftover` where the window
    was still open at the end. With `with_ids`, each piece also carries its ids."""
    schema = PIECES + (", ids array<long>" if with_ids else "")
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}

    def texts_of(column: pa.Array) -> Iterator[str]:
        for at in range(0, len(column), 100):  # not all of a batch as Python strings at once
            yield from as_texts(column.slice(at, 100).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(f"words {tokenizer_file}", lambda: WordIds(tokenizer_file))
        part, end = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4").tobytes()
        windows, n, rows = OpenWindows(window, n_open), 0, []

        def emit(pieces: list, leftover: bool) -> None:
            nonlocal n
            offset = 0
            for p in [*pieces, None]:
                if p is None:
                    n, offset = n + 1, 0
                    continue
                rows.append((*p[:5], part, n, offset, leftover, *p[5:]))
                offset += p[2]

        def frame() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])
            rows.clear()
            return out

        for batch in batches:
            ids_of = coder.encode_many(texts_of(batch.column("text")))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part_ids = ids[4 * start : 4 * (start + window)]
                    length = len(part_ids) // 4
                    piece = (doc_id, start, length, zlib.crc32(part_ids), total)
                    if with_ids:
                        piece += (np.frombuffer(part_ids, dtype="<u4").astype("int64"),)
                    if length == window:
                        emit([piece], False)
                    elif out := windows.put(length, piece):
                        emit(out, False)
                if len(rows) >= 5_000:
                    yield frame()
        for held in windows.held:
            emit(held, True)
        if rows:
            yield frame()

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, schema)


def merge_windows(fills: DataFrame, window: int = WINDOW) -> DataFrame:
    """Which leftover windows go together: best-fit, largest first, by group of partitions."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["fill", "part", "window"], ascending=[False, True, True], kind="stable")
        rooms: list[tuple[int, int]] = []  # (room, number) of open windows, by room
        rows, n = [], 0
        for group, p, w, fill in part[["grp", "part", "window", "fill"]].itertuples(index=False):
            i = bisect_left(rooms, (int(fill), -1))
            room, number = rooms.pop(i) if i < len(rooms) else (window, n)
            n = max(n, number + 1)
            rows.append((p, w, (1 << 62) + (int(group) << 32) + number, window - room))
            if room > fill:
                insort(rooms, (room - int(fill), number))
        return pd.DataFrame(rows, columns=["part", "window", "sequence_id", "shift"])

    return fills.groupBy("grp").applyInPandas(merge, "part long, window long, sequence_id long, shift long")


def pack(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, n_open: int = OPEN_WINDOWS, merged_partitions: int = MERGED_PARTITIONS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids)."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = checkpoint(place_documents(source, tokenizer_file, window, n_open, with_ids=with_ids))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    closed = pieces.where(~F.col("leftover")).withColumn("sequence_id", F.shiftleft(F.col("part"), 32) + F.col("window"))
    open_ones = pieces.where("leftover")
    group = F.floor(F.col("part") / merged_partitions).alias("grp")
    fills = open_ones.groupBy(group, "part", "window").agg(F.sum("length").alias("fill"))
    merged = open_ones.join(merge_windows(fills, window), ["part", "window"]).withColumn("offset", F.col("offset") + F.col("shift"))
    return closed.select(columns).unionByName(merged.select(columns))
