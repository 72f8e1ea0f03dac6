"""Hierarchical multi-length packing of token sequences.

Documents are routed to tiers of context sizes (powers of two): whole windows of the
longest tier are cut off, and what is left goes to the shortest tier that holds it. Each
tier is packed by itself, best fit first; gaps of the long windows are then filled from
the shorter tiers, longest first, with pieces cut to the gap where none fits whole. What
cannot fill a window at the end of a task is cut into windows of the shorter tiers, so
at most one window shorter than the shortest tier is padded. Windows are dealt to step
groups so that every full step of a task has the same tokens: each group takes windows,
longest first, until it holds the tokens of one step.

Tasks pack the rows they read; nothing is shuffled, a document in a long run of tasks
never waits for another, and a repeated task gives the same windows. `sequence_id` is
the task's number and the window's number within it.

Text becomes ids by words: a text is split at ASCII white space, which the tokenizer
drops and no token crosses, and each distinct word is tokenized once per worker.

Defined cases: null and empty texts have only the end token; ids that are null or
repeated are packed as separate documents; very long documents become many windows; an
empty table gives no pieces; only the id and text columns are read.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from fleetgrain.llm.common import ship_package

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens of one step, in windows of the longest tier.
STEP_WINDOWS = 64
#: Documents whose ids are held at once; beyond it, the windows that are full leave.
HELD_TOKENS = 2 << 20
REMEMBERED = 600_000
#: Characters that are tokenized at once, as a word is looked up once in them; longer texts are cut at white space.
SLICE_CHARS = 4 << 20
_SPACES = (" ", "\n", "\t", "\r", "\x0b", "\x0c")


class WordIds:
    """Ids of words, remembered up to a bound; one per worker and vocabulary.

    New words are tokenized many at a time; the bytes of ids and words tell which belong
    together, and where they do not agree the words are tokenized one by one. When the
    bound is reached, words met in one slice only are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # bytes of each id: byte-level tokens have a letter for each, and the last of a word a suffix
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.widths[number] = len(token.removesuffix("</w>"))
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.bounds = np.zeros(1 << 14, dtype=np.int64)
        self.hits = np.zeros(1 << 14, dtype=np.int32)

    def _trim(self) -> None:
        if len(self.index) <= REMEMBERED:
            return
        used, least = self.hits[: len(self.index)], 2
        while (used >= least).sum() > REMEMBERED // 2:
            least *= 2
        keep = used >= least
        names = [w for w, p in self.index.items() if keep[p]]
        places = np.array([self.index[w] for w in names], dtype=np.int64)
        flat, ends = self._take(places)
        self.index = {w: k for k, w in enumerate(names)}
        self.flat, self.bounds = flat, ends
        self.hits = used[places] // 2 + 1

    def _take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at `places` in a row, and where each begins and the last ends."""
        begin = self.bounds[places]
        count = self.bounds[places + 1] - begin
        ends = np.concatenate(([0], np.cumsum(count)))
        return self.flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], count)], ends

    def _segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        groups = [words[k : k + 500] for k in range(0, len(words), 500)]
        flats, counts = [], []
        for group, whole in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(whole.ids, dtype=np.uint32)
            reached, wanted = np.cumsum(self.widths[ids]), np.cumsum([_width(w) for w in group])
            last = np.searchsorted(reached, wanted)
            if len(reached) and reached[-1] == wanted[-1] and (reached[last] == wanted).all():
                flats.append(ids)
                counts.append(np.diff(last, prepend=-1))
            else:  # a word that the widths do not explain, such as a special token
                single = [e.ids for e in self.tokenizer.encode_batch(group, add_special_tokens=False)]
                flats.append(np.array([x for i in single for x in i], dtype=np.uint32))
                counts.append(np.array([len(i) for i in single], dtype=np.int64))
        return np.concatenate(flats), np.concatenate(counts)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Place of each of the distinct words."""
        index = self.index
        place = np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = [words[k] for k in unknown.tolist()]
            flat, counts = self._segment(new)
            known = len(index)
            end = self.bounds[known] if known else 0
            self.flat = _grown(self.flat, end + len(flat))
            self.flat[end : end + len(flat)] = flat
            self.bounds = _grown(self.bounds, known + len(new) + 1)
            self.bounds[known + 1 : known + 1 + len(new)] = end + np.cumsum(counts)
            self.hits = _grown(self.hits, known + len(new))
            self.hits[known : known + len(new)] = 0
            numbers = range(known, known + len(new))
            index.update(zip(new, numbers, strict=True))
            place[unknown] = numbers
        self.hits[place] += 1
        return place

    def of_rows(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Row and ids of each text, a slice of the texts at a time."""
        parts: list[str] = []
        rows: list[int] = []
        size, waiting = 0, []  # ids of the last row so far

        def coded() -> Iterator[tuple[int, np.ndarray]]:
            ids, bounds = self.ids(pa.array(parts, pa.large_string()))
            return ((r, ids[a:b]) for r, a, b in zip(list(rows), bounds[:-1], bounds[1:], strict=True))

        def flush(last: bool) -> Iterator[tuple[int, np.ndarray]]:
            nonlocal size, waiting
            for row, ids in coded():
                if waiting and waiting[0][0] != row:
                    yield waiting[0][0], np.concatenate([w[1] for w in waiting])
                    waiting = []
                waiting.append((row, ids.copy()))
            if last and waiting:
                yield waiting[0][0], np.concatenate([w[1] for w in waiting])
            parts.clear()
            rows.clear()
            size = 0

        for row, text in enumerate(texts):
            for part in _cut_text(text.as_py() or ""):
                parts.append(part)
                rows.append(row)
                size += len(part)
                if size >= SLICE_CHARS:
                    yield from flush(False)
        yield from flush(True)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins and the last ends."""
        self._trim()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.values.dictionary_encode()
        place = self._learn(coded.dictionary.to_pylist())
        flat, ends = self._take(place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else place)
        return flat, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def _width(word: str) -> int:
    """Bytes of a word's normal form."""
    return len(word) if word.isascii() else len(unicodedata.normalize("NFC", word).lower().encode())


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """`values`, longer if need be; what is added is zero."""
    if size <= len(values):
        return values
    return np.concatenate((values, np.zeros(max(size, 2 * len(values)) - len(values), dtype=values.dtype)))


def _cut_text(text: str) -> Iterator[str]:
    """Parts of a text of about SLICE_CHARS, cut after white space."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        cut = max(text.rfind(c, at, at + SLICE_CHARS) for c in _SPACES) + 1
        if cut <= at:  # one word longer than a slice
            after = [k for k in (text.find(c, at + SLICE_CHARS) for c in _SPACES) if k >= 0]
            cut = min(after, default=len(text) - 1) + 1
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Packs the documents of one task; pieces are (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.longest = self.tiers[-1]

    def tier(self, length: int) -> int:
        return self.tiers[min(bisect_left(self.tiers, length), len(self.tiers) - 1)]

    def pack(self, lengths: list[int], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
        """Full windows, and the pieces that are left; with `last` nothing is left.

        Every window is exactly one tier long but for at most one at the end.
        """
        windows: list[list[tuple[int, int, int]]] = []
        waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}  # (length, document, start)
        for doc, n in enumerate(lengths):
            start = 0
            while n - start >= self.longest:
                windows.append([(doc, start, self.longest)])
                start += self.longest
            if n > start:
                insort(waiting[self.tier(n - start)], (n - start, doc, start))
        for tier in reversed(self.tiers):
            self._pack_tier(tier, waiting, windows)
        left = [piece for t in self.tiers for piece in waiting[t]]
        rest = [(doc, start, n) for n, doc, start in left]
        if not last:
            return windows, rest
        size = sum(n for _, _, n in rest)
        for tier in reversed(self.tiers):
            while size >= tier:
                windows.append(self._cut(rest, tier))
                size -= tier
        if rest:
            windows.append(rest)
        return windows, []

    def _pack_tier(self, tier: int, waiting: dict[int, list], windows: list) -> None:
        """Windows of one tier: its own pieces, then the best fits among the shorter ones."""
        below = [t for t in self.tiers if t <= tier]
        supply = sum(n for t in below for n, _, _ in waiting[t])
        while waiting[tier] and supply >= tier:
            window, gap = [], tier
            piece = waiting[tier].pop()
            while piece is not None:
                n, doc, start = piece
                used = min(n, gap)
                window.append((doc, start, used))
                if n > used:
                    insort(waiting[self.tier(n - used)], (n - used, doc, start + used))
                gap -= used
                piece = self._fitting(gap, below, waiting) if gap else None
            windows.append(window)
            supply -= tier

    def _fitting(self, gap: int, tiers: list[int], waiting: dict[int, list]):
        """The longest waiting piece that fits the gap, else the shortest that is cut to it."""
        for t in reversed(tiers):
            at = bisect_left(waiting[t], (gap + 1,))
            if at:
                return waiting[t].pop(at - 1)
        for t in tiers:
            if waiting[t]:
                return waiting[t].pop(0)
        return None

    @staticmethod
    def _cut(pieces: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
        window = []
        while size:
            doc, start, n = pieces.pop(0)
            used = min(n, size)
            window.append((doc, start, used))
            if n > used:
                pieces.insert(0, (doc, start + used, n - used))
            size -= used
        return window


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """Group of each window: longest first into the present step until it is full."""
    groups, held, group = [0] * len(sizes), 0, 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if held + sizes[k] > step_tokens:
            group, held = group + 1, 0
        groups[k] = group
        held += sizes[k]
    return groups


def pack(docs: DataFrame, vocabulary: str, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    `with_ids` adds the ids of the piece.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType
    fields = [("doc_id", to_arrow_type(kind))] + [
        (c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
    ]
    shape = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    ddl = ", ".join([f"doc_id {kind.simpleString()}", *[f"{c} bigint" for c, _ in fields[1:]], *(["ids array<bigint>"] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 36
        packer, made, steps = Packer(tiers), 0, 0
        held: list[tuple] = []  # (id, ids that wait, their start, tokens of the document)
        size = 0

        def leave(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, made, steps
            windows, rest = packer.pack([len(h[1]) for h in held], last)
            sizes = [sum(p[2] for p in w) for w in windows]
            groups = step_groups(sizes, STEP_WINDOWS * packer.longest)
            columns: list[list] = [[] for _ in shape]
            for k, window in enumerate(windows):
                offset = 0
                for doc, start, n in window:
                    name, ids, begin, total = held[doc]
                    part = ids[start : start + n]
                    row = [name, begin + start, n, zlib.crc32(part.astype("<u4").tobytes()), total, task + made + k, offset, packer.tier(sizes[k]), task + steps + groups[k]]
                    for column, value in zip(columns, [*row, part.astype(np.int64)] if with_ids else row, strict=True):
                        column.append(value)
                    offset += n
            made += len(windows)
            steps += max(groups, default=-1) + 1
            held = [(held[d][0], held[d][1][s : s + n], held[d][2] + s, held[d][3]) for d, s, n in rest]
            size = sum(len(h[1]) for h in held)
            if windows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

        for batch in batches:
            names = batch.column(0)
            for k, ids in word_ids(vocabulary).of_rows(batch.column(1)):
                whole = np.append(ids, np.uint32(END_ID))
                held.append((names[k].as_py(), whole, 0, len(whole)))
                size += len(whole)
                if size >= HELD_TOKENS:
                    yield from leave(False)
        yield from leave(True)

    return slim.mapInArrow(run, ddl)
