"""Benchmark decontamination by a generalised suffix automaton.

The words of all benchmark items, as numbers, make one suffix automaton. The words of a document
stream through it once; at each word the automaton holds the longest match that ends there. A
match of ``window`` words or more covers its last ``window`` words; items shorter than that must
occur whole. What is hit is the union of these occurrences.

The benchmark is a stated set of queries: it is read on the driver item by item, in blocks of
``block_words`` words, each sent to the executors by itself. A worker takes some documents, streams
them through the automaton of each block in turn and unites what the blocks hit, row by row. At most
``PASS_BLOCKS`` blocks are out at a time: a larger benchmark takes several passes over the documents,
which keep what the blocks so far hit beside each row. So every automaton and what the driver holds
have a bounded size, results do not depend on the blocks, and documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from casemill.llm.arrow import arrow_map, as_bytes, beside, fresh_name, rewrite
from casemill.plans.cut import dropped, stored

WINDOW = 10
BLOCK_WORDS = 200_000
#: Blocks that are sent to the executors at a time, and bytes of benchmark that the driver reads at a time.
PASS_BLOCKS, READ_BYTES = 20, 4 << 20
#: Lower case for A-Z; everything but digits, letters and non-ASCII bytes is white space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """The suffix automaton of several word sequences, and the windows of them that count."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        kept = [(name, [self.number.setdefault(w, len(self.number)) for w in words]) for name, words in items if words]
        for _, ids in kept:
            last = 0
            for x in ids:
                last = self._extend(last, x)
        # the state of each window, with the items that have it; shorter items are one window
        self.items: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for name, ids in kept:
            need, state, length = min(window, len(ids)), 0, 0
            for x in ids:
                state, length = self.step(state, length, x)
                if length >= need and need == window:
                    self.items.setdefault(self._cut(state, window), set()).add(name)
            if need < window:
                self.short.setdefault(self._cut(state, need), {}).setdefault(need, set()).add(name)
        self.least = min((min(window, len(ids)) for _, ids in kept), default=window)
        self._above: dict[int, list] = {}

    def _extend(self, last: int, x: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if x in nxt[last]:  # the sequence so far also begins another one
            q = nxt[last][x]
            return q if size[q] == size[last] + 1 else self._clone(last, x, q)
        new = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][x]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, x, q)
        return new

    def _clone(self, p: int, x: int, q: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def step(self, state: int, length: int, x: int) -> tuple[int, int]:
        """The longest match that ends at word ``x``, from the one that ended before it."""
        nxt = self.next
        while state and x not in nxt[state]:
            state = self.link[state]
            length = self.size[state]
        if x in nxt[state]:
            return nxt[state][x], length + 1
        return 0, 0

    def _cut(self, state: int, length: int) -> int:
        """The state that has the last ``length`` words of ``state``'s match."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _shorts(self, state: int) -> list:
        """The short items that end a match at ``state``, with their lengths."""
        if state not in self._above:
            found, s = [], state
            while s > 0:
                found += self.short.get(s, {}).items()
                s = self.link[s]
            self._above[state] = found
        return self._above[state]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The runs of words that are hit, ends exclusive, and the items found."""
        ids = list(map(self.number.get, words))
        spans: list[tuple[int, int]] = []
        found: set = set()
        for a, b in self._known_runs(ids):
            state = length = 0
            for i in range(a, b):
                state, length = self.step(state, length, ids[i])
                if length >= self.window:
                    cut = self._cut(state, self.window)
                    if cut in self.items:
                        found |= self.items[cut]
                        spans.append((i + 1 - self.window, i + 1))
                if self.short:
                    for need, names in self._shorts(state):
                        if need <= length:
                            found |= names
                            spans.append((i + 1 - need, i + 1))
        return merged(spans), found

    def _known_runs(self, ids: list) -> Iterator[tuple[int, int]]:
        """Runs of words that the automaton knows, where they are long enough for a window."""
        known = np.fromiter((x is not None for x in ids), bool, len(ids))
        edges = np.flatnonzero(np.diff(known, prepend=False, append=False))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.least:
                yield a, b


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same cover as maximal runs, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("string"), as_bytes().alias("text"))
    n_bytes = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if n_bytes > READ_BYTES:  # else a partition, whatever its size, would come to the driver as a whole
        items = items.repartition(-(-n_bytes // READ_BYTES))
    for name, text in items.toLocalIterator():
        words = words_of(bytes(text))
        if name is None or not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    yield block


def _byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    ends = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    return [(ends[a][0], ends[b - 1][1]) for a, b in spans]


class _Sent:
    """Some blocks of the benchmark on the executors, and the automata that a worker builds from them."""

    def __init__(self, blocks: list) -> None:
        self.blocks = blocks
        #: Rows that are taken together: more where automata have to be built for them.
        self.rows = 2048 if len(self.blocks) == 1 else 10_000

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """Number of words, runs of words that are hit and items found, of each text."""
        sizes: list[int] = [0] * len(texts)
        spans: list[list] = [[] for _ in texts]
        found: list[set] = [set() for _ in texts]
        for block in self.blocks:
            automaton = _automaton(block)
            for i, text in enumerate(texts):
                words = words_of(text)
                runs, items = automaton.hits(words)
                sizes[i] = len(words)
                spans[i] += runs
                found[i] |= items
            if len(self.blocks) > 1:  # one block at a time in a worker's memory
                vars(block).pop("_value", None)
        return [(n, merged(s), f) for n, s, f in zip(sizes, spans, found, strict=True)]


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> Iterator[tuple[_Sent, bool]]:
    """At most ``PASS_BLOCKS`` blocks at a time, and whether they are the last; others go when the next are asked for."""
    spark, blocks = docs.sparkSession.sparkContext, _blocks(benchmark, block_words)
    ahead = next(blocks)
    while ahead is not None:
        sent = []
        while ahead is not None and len(sent) < PASS_BLOCKS:
            sent.append(spark.broadcast((ahead, window)))
            ahead = next(blocks, None)
        yield _Sent(sent), ahead is None
        for block in sent:
            block.destroy()


_RUNS = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
_FOUND = StructType([StructField("runs", _RUNS), StructField("items", ArrayType(StringType()))])


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, items: bool) -> tuple[DataFrame, _Sent, str | None]:
    """``docs`` and the last blocks; the column that has what the blocks before them found, if there are any."""
    found, rows = None, docs
    for sent, last in _passes(docs, benchmark, window, block_words):
        if last:
            return rows, sent, found

        def kernel(texts: list[bytes], sent: _Sent = sent) -> list[dict]:
            return [{"runs": _structs(runs), "items": sorted(names) if items else []} for _, runs, names in sent.hits(texts)]

        before = rows
        if found is None:
            found = fresh_name(docs, "_found")
            rows = stored(beside(rows, kernel, StructField(found, _FOUND), sent.rows), "searched")
        else:
            more = fresh_name(rows, "_more")
            both = F.struct(*(F.concat(f"{found}.{x}", f"{more}.{x}").alias(x) for x in _FOUND.names))
            rows = stored(beside(rows, kernel, StructField(more, _FOUND), sent.rows).withColumn(found, both).drop(more), "searched")
            dropped(before)
    raise AssertionError("the last blocks end the loop")


def _united(hits: tuple[int, list, set], before: dict | None) -> tuple[int, list[tuple[int, int]], set]:
    """What the last blocks hit in a text and what those before them did."""
    n, runs, names = hits
    if before is None:
        return hits
    return n, merged([*runs, *((r["start"], r["stop"]) for r in before["runs"])]), names | set(before["items"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)``, one row for each row of ``docs``.

    ``items`` are the item_ids with occurring windows, sorted as strings; ``spans`` the hit runs
    as byte offsets (``start``, ``stop``) into the UTF-8 text. A null text has no words; items
    without words or without an id are never found; an empty benchmark hits nothing. Repeated
    rows and null doc_ids keep their rows; other columns do not matter.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found_rows, sent, column = _searched(read, benchmark, window, block_words, True)

    def kernel(ids: list, texts: list, before: list | None = None) -> Iterator[tuple]:
        hits = map(_united, sent.hits(texts), before or [None] * len(texts))
        for doc_id, text, (n, runs, found) in zip(ids, texts, hits, strict=True):
            yield doc_id, n, sum(b - a for a, b in runs), sorted(found), _structs(_byte_spans(text, runs) if runs else [])

    rows = found_rows.select("doc_id", as_bytes(), *([column] if column else []))
    return arrow_map(rows, kernel, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>", sent.rows)


_built: list = [None, None]


def _automaton(sent) -> Automaton:
    """That of the block a worker had last is kept."""
    if _built[0] is not (value := sent.value):
        _built[:] = value, Automaton(*value)
    return _built[1]


def _structs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "stop": b} for a, b in spans]


def _cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` without what the benchmark has in it.

    Hit runs are cut out of a text (n_chars, where there is one, follows); a document more than
    ``max_coverage`` of whose words are hit goes. Others stay as they are. Every row is decided
    where it lies, whatever its id.
    """
    rows, sent, column = _searched(docs, benchmark, window, block_words, False)

    def decide(texts: list[str], before: list | None = None) -> tuple[list[bool], list]:
        keep, new, raw = [], [], [t.encode() for t in texts]
        hits = map(_united, sent.hits(raw), before or [None] * len(raw))
        for text, (n, runs, _) in zip(raw, hits, strict=True):
            keep.append(sum(b - a for a, b in runs) <= max_coverage * n)
            new.append(_cut_out(text, _byte_spans(text, runs)).decode() if runs else None)
        return keep, new

    out = rewrite(rows, decide, min(sent.rows, 512) if len(sent.blocks) == 1 else sent.rows, column)
    return out.drop(column) if column else out
