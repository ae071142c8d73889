"""Packing of tokenised documents into windows by multiway differencing.

Each task streams its documents, tokenises them, and cuts documents longer than
a window into full windows and a rest. Rests are collected up to
GROUP_WINDOWS windows' worth, a bound that does not grow with the data, and each
such group is partitioned by Karmarkar-Karp multiway differencing: every
rest starts as a partial partition of its own; the two with the largest
imbalance are merged again and again, the fullest window of one upon the
emptiest of the other, until one is left whose windows are near equal. If a window
is over capacity the number of windows rises by one and the group is partitioned again.
Where whole rests leave more than SLACK padding, they are cut shorter
first, as cutting is free. Nothing is shuffled and nothing leaves the task but the pieces.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import bounded_batches

WINDOW, END_ID, GROUP_WINDOWS, SLACK, SHORTEST = 4096, 2, 192, 0.015, 256
#: Bytes of text that are tokenised at once, and words that a worker remembers.
CHUNK_BYTES, MEMORY_WORDS = 4_000_000, 500_000
#: A Latin letter (but U+0130, whose lower case ends in a mark) before ASCII punctuation or a digit: the tokenizer always cuts there.
CUT = r"([A-Za-zÀ-ÖØ-öø-įı-ɏ])([!-@\[-`{-~])"


class WordEncoder:
    """Token ids of whole texts, encoding each distinct word once while it is remembered.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in order. Words are cut where its letter runs end and
    ASCII is lower-cased as it would be anyway, so fewer words differ; texts that may
    hold its special strings are left as they are. Words are encoded many at a time,
    with a separator between them that is one token. A word's number points to its ids in one
    pool. At MEMORY_WORDS words, those seen in one chunk only are forgotten (all, if most were seen
    again); that only costs time.
    """

    SEPARATOR = ","

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.encode(self.SEPARATOR, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.ends, self.chunks = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def forget_rare(self) -> None:
        again = np.flatnonzero(self.chunks > 1)
        if len(again) > MEMORY_WORDS // 2:
            return self.forget()
        words, length = list(self.known), np.diff(self.ends)[again]
        kept = np.repeat(np.isin(np.arange(len(words)), again), np.diff(self.ends))
        self.known = {words[i]: n for n, i in enumerate(again.tolist())}
        self.pool, self.ends, self.chunks = self.pool[kept], np.r_[0, np.cumsum(length)], np.ones(len(again), dtype=np.int32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one word after the other, and each word's number of ids."""
        mark = self.between[0]
        if len(self.between) == 1 and not any(self.SEPARATOR in w for w in words):
            ids = np.array(self.tokenizer.encode(f" {self.SEPARATOR} ".join(words), add_special_tokens=False).ids, dtype="<u4")
            at = np.flatnonzero(ids == mark)
            if len(at) == len(words) - 1:
                return np.delete(ids, at), np.diff(np.r_[-1, at, len(ids)]) - 1
        each = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.fromiter((i for ids in each for i in ids), dtype="<u4"), np.fromiter(map(len, each), dtype=np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each distinct word's number, encoding those that are new."""
        found = list(map(self.known.get, words))
        if None in found:
            new = [w for w, i in zip(words, found) if i is None]
            if self.known and len(self.known) + len(new) > MEMORY_WORDS:
                self.forget_rare()
                return self.numbers(words)
            apart = [w for w in new if self.SEPARATOR in w]
            new = [w for w in new if self.SEPARATOR not in w]
            pools, lengths = [self.pool], []
            for group in (new, apart):
                for k in range(0, len(group), 20_000):
                    ids, length = self.encode(group[k:k + 20_000])
                    pools.append(ids)
                    lengths.append(length)
            first, last = len(self.known), len(self.known) + len(new) + len(apart)
            self.known.update(zip([*new, *apart], range(first, last)))
            self.pool = np.concatenate(pools)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(lengths))])
            self.chunks = np.r_[self.chunks, np.zeros(last - first, dtype=np.int32)]
            found = list(map(self.known.get, words))
        number = np.array(found, dtype=np.int64)
        self.chunks[number] += 1
        return number

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the offsets of the texts in them."""
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), CUT, r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, cut))
        coded = pc.list_flatten(lists).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        word = self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        begin, length = self.ends[word], self.ends[word + 1] - self.ends[word]
        code = coded.indices.to_numpy(zero_copy_only=False)
        each = length[code]
        end = np.cumsum(each)
        place = np.repeat((begin[code] - (end - each)).astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.pool[place]
        bounds = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        return ids, np.r_[0, end][bounds]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process: its words serve all tasks that the process runs."""
    return WordEncoder(path)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window number of each size (1 or more), by Karmarkar-Karp differencing into ``windows`` windows.

    A partial partition is the sorted list of its windows that hold something, as (sum, node); all others
    are empty. A node is an item, or a pair of nodes that share a window.
    """
    n, pairs = len(sizes), []
    if windows == 1:
        return np.zeros(n, dtype=np.int64)
    # (minus imbalance, tie break, windows in ascending order)
    heap = [(-s, k, [(s, k)]) for k, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)

    def joined(x: int, y: int) -> int:
        pairs.append((x, y))
        return n + len(pairs) - 1

    for tick in range(n, 2 * n - 1):
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - windows  # so many windows of both are full and meet
        if len(b) == 1:  # the usual case: an item goes to the emptiest window
            s, x = b[0]
            if over > 0:
                t, y = a.pop(0)
                s, x = s + t, joined(y, x)
            insort(a, (s, x))
        else:
            met = [(s + t, joined(x, y)) for (s, x), (t, y) in zip(a[:max(over, 0)], reversed(b[:max(over, 0)]))]
            a = sorted(met + a[max(over, 0):] + b[max(over, 0):])
        heapq.heappush(heap, ((a[0][0] if len(a) == windows else 0) - a[-1][0], tick, a))
    window = [-1] * (n + len(pairs))
    for w, (_, node) in enumerate(heap[0][2] if n else []):
        window[node] = w
    for k in range(len(pairs) - 1, -1, -1):
        x, y = pairs[k]
        window[x] = window[y] = window[n + k]
    return np.array(window[:n], dtype=np.int64)


def balance(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of near-equal sums, none over capacity; their number rises until that holds."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = difference(sizes, windows)
        if np.bincount(found, weights=sizes).max(initial=0) <= capacity:
            return found
        windows += 1


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length, window) of the pieces of a group of items, none longer than capacity."""
    best, longest, fewest = None, max(1, capacity // 2), -(-int(sizes.sum()) // capacity)
    while True:
        parts = -(-sizes // longest)
        item = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = nth * longest
        length = np.minimum(longest, sizes[item] - start)
        window = balance(length, capacity)
        used = int(window.max(initial=-1)) + 1
        if best is None or used < best[0]:
            best = used, item, start, length, window
        longest //= 2
        if best[0] - fewest <= max(1, SLACK * fewest) or longest < SHORTEST:
            return best[1:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_id and text (null: empty) of rows that together have CHUNK_BYTES of text at most, or of a single longer one."""
    held: list[tuple[pa.Array, pa.Array]] = []
    size = 0

    def joined() -> tuple[pa.Array, pa.Array]:
        ids, texts = (pa.concat_arrays(columns) for columns in zip(*held))
        held.clear()
        return ids, texts

    for b in batches:
        ids, texts, at = b.column("doc_id"), pc.fill_null(b.column("text"), ""), 0
        reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < len(texts):
            start = int(reach[at - 1]) if at else 0
            stop = int(np.searchsorted(reach, start + CHUNK_BYTES - size, "right"))
            if stop <= at and held:
                yield joined()
                size = 0
                continue
            stop = max(at + 1, stop)
            held.append((ids.slice(at, stop - at), texts.slice(at, stop - at)))
            size += int(reach[stop - 1]) - start
            at = stop
    if held:
        yield joined()


def _packer(path: Callable[[], str] | str, capacity: int, end_id: int, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        base, made = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []
        held = 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(list(zip(*found)) or [[]] * len(schema), schema)], schema=schema)

        def row(doc, start, ids, total, sequence, offset):
            return (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset, *([ids.tolist()] if with_ids else []))

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            item, start, length, window = pack_sizes(np.array([len(w[2]) for w in waiting], dtype=np.int64), capacity)
            fill = np.zeros(int(window.max()) + 1, dtype=np.int64)
            number = np.cumsum(np.bincount(window, minlength=len(fill)) > 0) - 1
            out = []
            for i, s, n, w in zip(item.tolist(), start.tolist(), length.tolist(), window.tolist()):
                doc, first, ids, total = waiting[i]
                out.append(row(doc, first + s, ids[s:s + n], total, made + int(number[w]), int(fill[w])))
                fill[w] += n
            made += int(number[-1]) + 1
            held = 0
            waiting.clear()
            return rows(out)

        for doc_ids, texts in _chunks(batches):
            ids, bounds = encoder.texts(texts)
            full = []
            for k, doc in enumerate(doc_ids.to_pylist()):
                own = np.append(ids[bounds[k]:bounds[k + 1]], np.array([end_id], dtype="<u4")).astype("<u4", copy=False)
                rest = len(own) // capacity * capacity
                for s in range(0, rest, capacity):
                    full.append(row(doc, s, own[s:s + capacity], len(own), made, 0))
                    made += 1
                if rest < len(own):
                    waiting.append((doc, rest, own[rest:], len(own)))
                    held += len(own) - rest
                    if held >= GROUP_WINDOWS * capacity:
                        yield flush()
            if full:
                yield rows(full)
        if waiting:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids.

    A null or empty text has only the end id. Repeated rows are packed each for
    itself; null ids are kept; other columns are ignored; an empty table has no
    pieces. A sequence's number holds its partition's, so a task that runs
    again gives the same numbers. Each partition has one group that is not full.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int64()))] * with_ids
    ddl = ", ".join(f"{n} {'array<long>' if n == 'ids' else 'long'}" for n, _ in fields)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, capacity, end_id, with_ids, pa.schema(fields)), ddl)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of the whole of documents in windows of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
