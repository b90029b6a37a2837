"""Exact substring dedup: bytes covered by a 50-byte string that an earlier document has too.

Every 50-byte string names an anchor: of the 20-byte strings in it, the one with the least hash.
Equal strings name equal anchors, and neighbouring strings mostly share theirs, so there is one
anchor for some 16 strings. All strings of a text with one anchor together are its stretch.

Documents are dealt into packs, some hundreds of texts each, and packs ask twice:

1. Which of my anchors does another pack have? A pack sends the hashes of its anchors, each once,
   dealt into buckets; a bucket answers with a bit for each. Anchors of one document only, most of
   all, end here.
2. Which of the strings around the other anchors stand in an earlier document? A pack deep-shallow
   sorts these stretches and sends each distinct one once, with the first document that has it and
   the places where it stands. A bucket sorts the stretches of all packs: runs of equals give the
   first document of a stretch. Stretches that differ but have an anchor in common are where
   repeats begin and end: their suffixes are sorted, and runs of equals give the first document of
   each string. An anchor with very many different stretches (``HOT``) would be one large group;
   packs send its strings one by one instead, dealt by string, so that no group has more rows than
   there are packs.

Hashes only say which strings are sorted against each other. That strings are equal is decided by
the sort, which compares their bytes. Texts are shuffled once; the three passes over the packs
read the same exchange. Nothing is broadcast or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.suffix_sort import deep_shallow_sort

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
#: Different stretches of an anchor that are sorted together; more are dealt out string by string.
HOT = 20_000
#: Packs, buckets of anchors and buckets of strings, for each partition of the input. A pack sends
#: each bucket one row, if it has anything for it.
PACKS, ANCHOR_BUCKETS, STRING_BUCKETS = 32, 2, 4
#: Bytes of text that are hashed at a time, and stretches that are sorted at a time.
BLOCK_BYTES, BLOCK_STRETCHES = 1 << 18, 10_000
NO_ID = 2**63 - 1
#: Bits of an anchor's hash that travel.
KEY_BITS = 48
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.r_[_U(1), np.full(BLOCK_BYTES, _BASE, _U)])
_KINDS = (np.int64, _U, _U, np.int64, np.int64, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _U(0xD6E8FEB86659FD93)
    x = (x ^ x >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return x ^ x >> _U(32)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the 20 bytes from each position, by doubling."""
    x = (raw.astype(_U) + _U(1)) * _U(0xA0761D6478BD642F)
    size, levels = 1, {1: x}
    while size < 16:
        x = x[:-size] * _POWER[size] + x[size:]
        size *= 2
        levels[size] = x
    four, sixteen = levels[4], levels[16]
    return _mixed(sixteen[: len(raw) - GRAM + 1] * _POWER[4] + four[16 : 16 + len(raw) - GRAM + 1])


def _sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    out, size = x, 1
    while size * 2 <= span:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - span + 1], out[span - size :])


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``(text number, anchor hash, stretch hash, first start, strings, anchor)`` of all stretches.

    ``first start`` is where the stretch begins in its text; it has ``strings`` starts and its
    anchor ``anchor`` bytes after the first.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        if size > BLOCK_BYTES:  # one long text: pieces that overlap by all but one start
            text = texts[at]
            step = BLOCK_BYTES - LENGTH - 2 * SPAN
            for a in range(0, max(1, len(text) - LENGTH - 2 * SPAN), step):
                # a stretch that a piece cuts off comes whole in the next one; what is covered is a union
                doc, h, u, start, n, anchor = _stretches([text[a : a + BLOCK_BYTES]])
                parts.append((doc + at, h, u, start + a, n, anchor))
        else:
            doc, *rest = _stretches(texts[at:end])
            parts.append((doc + at, *rest))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, t) for t in _KINDS)


def _stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < LENGTH:
        return tuple(np.zeros(0, t) for t in _KINDS)
    grams = _gram_hashes(raw)
    low = _U((1 << 21) - 1)
    least = _sliding_least((grams & ~low) | np.arange(len(grams), dtype=_U), SPAN)
    anchor = (least & low).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    whole = doc[: len(anchor)] == doc[LENGTH - 1 : LENGTH - 1 + len(anchor)]
    turn = (anchor[1:] != anchor[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1])
    start = np.flatnonzero(whole & np.r_[True, ~whole[:-1] | turn])
    stop = np.flatnonzero(whole & np.r_[~whole[1:] | turn, True])
    sums = np.r_[_U(0), np.cumsum((raw.astype(_U) + _U(1)) * _U(0x8EBC6AF09C88C6E3) * _POWER[: len(raw)], dtype=_U)]
    # the same string has the same hash wherever it stands: all are brought to one power
    end = stop + LENGTH
    u = _mixed((sums[end] - sums[start]) * _POWER[BLOCK_BYTES - start] + (end - start).astype(_U) * _U(0x589965CC75374CC3))
    at = anchor[start]
    # a least hash is a low one; mixed again, hashes fill the buckets evenly
    return doc[start], _mixed(grams[at]), u, start - first[doc[start]], stop - start + 1, at - start


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, by their octets of one weight, compressed."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays), *(ord(a.dtype.char) for a in arrays)], "<i4").tobytes()]
    parts += [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.compress(b"".join(parts), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    head = np.frombuffer(raw, "<i4", 2 * n, 4).tolist()
    out, at = [], 4 + 8 * n
    for size, kind in zip(head[:n], head[n:], strict=True):
        kind = np.dtype(chr(kind))
        block = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(block.T).view(kind).ravel() if size else np.zeros(0, kind))
        at += size * kind.itemsize
    return out


def _rows(pack: pa.Table) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Ids and texts of a pack in an order that does not depend on how its rows came, and that order."""
    ids, texts = pack.column("doc").to_pylist(), pack.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return np.array([ids[i] for i in order], np.int64), [texts[i] for i in order], order


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes, in the order of the hashes."""
    return ((key >> _U(KEY_BITS - 24)) * _U(buckets) >> _U(24)).astype(np.int64)


def _cuts(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """``(bucket, from, to)`` of each bucket that occurs."""
    if not len(sorted_buckets):
        return []
    at = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]])
    return list(zip(sorted_buckets[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_buckets)], strict=True))


def _anchors(ids: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct anchor hashes in order, what is said of each, and which one each stretch has.

    What is said: the number of different stretches, 127 at most, and bit 7 for several documents.
    """
    doc, h, u, *_ = found
    key = h >> _U(64 - KEY_BITS)
    order = np.lexsort((u, key))
    key, u, own = key[order], u[order], ids[doc[order]]
    new = np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]
    at = np.flatnonzero(new)
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    if not len(at):
        return key, np.zeros(0, np.uint8), which
    different = np.add.reduceat((new | np.r_[True, u[1:] != u[:-1]]).astype(np.int64), at)
    several = np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at)
    return key[at], (np.minimum(different, 127) | several * 128).astype(np.uint8), which


_ASKED, _TOLD = "bucket int, pack long, data binary", "pack long, bucket int, data binary"


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


_ASKED_ROWS = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("data", pa.binary())])
_TOLD_ROWS = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


def _asker(buckets: int):
    def ask(pack: pa.Table) -> pa.Table:
        ids, texts, _ = _rows(pack)
        key, said, _ = _anchors(ids, stretches(texts))
        name = pack.column("pack")[0].as_py()
        return _table(_ASKED_ROWS, [(b, name, _packed(np.diff(key[i:j], prepend=_U(0)), said[i:j])) for b, i, j in _cuts(_bucket(key, buckets))])

    return ask


def _told(hot: int):
    """A bucket's answer to each pack: which of its anchors several documents have, and which are crowded."""

    def tell(bucket: pa.Table) -> pa.Table:
        asked = [_unpacked(x) for x in bucket.column("data").to_pylist()]
        sizes = np.cumsum([0, *(len(x) for _, x in asked)])
        key = np.concatenate([np.cumsum(k, dtype=_U) for k, _ in asked])
        said = np.concatenate([x for _, x in asked])
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        size = np.diff(np.r_[at, len(key)])
        shared = (size > 1) | (np.maximum.reduceat(said[order], at) >= 128)
        crowded = shared & (np.add.reduceat((said[order] & 127).astype(np.int64), at) > hot)
        flags = np.empty(len(key), np.uint8)
        flags[order] = np.repeat(shared + 2 * crowded, size)
        packs, b = bucket.column("pack").to_pylist(), bucket.column("bucket")[0].as_py()
        return _table(_TOLD_ROWS, [(p, b, zstandard.compress(flags[i:j].tobytes(), 1)) for p, i, j in zip(packs, sizes.tolist(), sizes[1:].tolist(), strict=False)])

    return tell


def _gathered(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of strings, end to end."""
    end = np.cumsum(size)
    return raw[np.arange(end[-1] if len(end) else 0) + np.repeat(at - end + size, size)]


def _string_keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the 50 bytes from each place."""
    x = np.zeros(len(at), _U)
    for k in range(LENGTH):
        x = x * _BASE + raw[at + k].astype(_U) + _U(1)
    return _mixed(x) >> _U(64 - KEY_BITS)


def _offers(
    raw: np.ndarray, place: np.ndarray, key: np.ndarray, ids: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, buckets: int, alone: bool
) -> Iterator[tuple[int, bytes]]:
    """Strings of a pack, each distinct one once, dealt into buckets.

    The string of entry i is the ``n[i]`` + 49 bytes of ``raw`` from ``place[i]``; ``doc`` counts
    the pack's rows in the order of their ids. Sent are: first document, strings, anchor, places
    in the first document and in others, whether it stands ``alone``, bytes; then row and start of
    all places.
    """
    if not len(place):
        return
    size = n + LENGTH - 1
    raw, place = _gathered(raw, place, size), np.cumsum(size) - size
    order, run = deep_shallow_sort(raw, place, size, key.astype(np.int64) << 13 | n << 8 | anchor)
    runs = np.empty(len(order), np.int64)
    runs[order] = run
    own = np.lexsort((start, doc, runs, key))
    head = np.flatnonzero(np.r_[True, runs[own][1:] != runs[own][:-1]])
    lead, ends = own[head], np.r_[head[1:], len(own)]
    first = ids[doc[lead]]
    in_first = np.add.reduceat((ids[doc[own]] == np.repeat(first, ends - head)).astype(np.int64), head)
    for b, i, j in _cuts(_bucket(key[lead], buckets)):
        d, places = lead[i:j], own[head[i] : ends[j - 1]]
        yield b, _packed(
            first[i:j], n[d].astype(np.uint8), anchor[d].astype(np.uint8), in_first[i:j].astype(np.int32), (ends - head - in_first)[i:j].astype(np.int32),
            np.full(1, alone, np.uint8), _gathered(raw, place[d], size[d]), doc[places].astype(np.int32), start[places].astype(np.int32),
        )


def _emitter(buckets: int):
    """The strings of a pack around anchors that several documents have."""

    def emit(pack: pa.Table, told: pa.Table) -> pa.Table:
        if not pack.num_rows or not told.num_rows:
            return _table(_ASKED_ROWS, [])
        ids, texts, _ = _rows(pack)
        found = stretches(texts)
        key, _, which = _anchors(ids, found)
        answers = dict(zip(told.column("bucket").to_pylist(), told.column("data").to_pylist(), strict=True))
        flags = np.frombuffer(b"".join(zstandard.decompress(answers[b]) for b in sorted(answers)), np.uint8)[which]
        doc, _, _, start, n, anchor = found
        raw = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum([0, *map(len, texts)])
        name, rows = pack.column("pack")[0].as_py(), []
        own = np.flatnonzero(flags == 1)
        rows += [(b, name, x) for b, x in _offers(raw, base[doc[own]] + start[own], key[which[own]], ids, doc[own], start[own], n[own], anchor[own], buckets, False)]
        own = np.flatnonzero(flags == 3)
        if len(own):  # crowded anchors: string by string
            times = n[own]
            k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            doc, start = np.repeat(doc[own], times), np.repeat(start[own], times) + k
            place = base[doc] + start
            one = np.ones(len(place), np.int64)
            rows += [(b, name, x) for b, x in _offers(raw, place, _string_keys(raw, place), ids, doc, start, one, 0 * one, buckets, True)]
        return _table(_ASKED_ROWS, rows)

    return emit


def _settle(bucket: pa.Table) -> pa.Table:
    """For each pack: row, start and mask of its strings that an earlier document has."""
    packs, offers = bucket.column("pack").to_pylist(), [_unpacked(x) for x in bucket.column("data").to_pylist()]
    count = np.array([len(x[0]) for x in offers])
    offer = np.repeat(np.arange(len(offers)), count)
    lo, n, anchor = (np.concatenate([x[k] for x in offers]).astype(np.int64) for k in range(3))
    alone = np.repeat(np.array([x[5][0] for x in offers], bool), count)
    raw = np.concatenate([x[6] for x in offers])
    size = n + LENGTH - 1
    place = np.cumsum(size) - size
    # an alone string is grouped by all of its bytes, a stretch by those of its anchor
    gram = np.zeros(len(place), _U)
    for k in range(GRAM):
        gram = gram * _BASE + raw[place + anchor + k].astype(_U) + _U(1)
    gram = _mixed(gram) >> _U(1)
    gram[alone] = _string_keys(raw, place[alone]) | _U(1 << 63)
    mask = np.zeros(len(lo), np.uint32)
    by = np.argsort(gram, kind="stable")
    edge = np.r_[np.flatnonzero(np.r_[True, gram[by][1:] != gram[by][:-1]]), len(by)]
    a = 0
    while a < len(edge) - 1:  # whole groups, some at a time
        z = max(a + 1, int(np.searchsorted(edge, edge[a] + BLOCK_STRETCHES, "right")) - 1)
        own = by[edge[a] : edge[z]]
        mask[own] = _masks(raw, place[own], gram[own], lo[own], n[own], anchor[own], alone[own])
        a = z
    rows = []
    full = (np.uint32(1) << n.astype(np.uint32)) - np.uint32(1)
    ends = np.cumsum([0, *count]).tolist()
    for k, x in enumerate(offers):
        i, j = ends[k], ends[k + 1]
        in_first, others, doc, start = x[3].astype(np.int64), x[4].astype(np.int64), x[7], x[8]
        # places in the first document of the pack come first; the others have that one before them
        times = np.stack([in_first, others], 1).ravel()
        masks = np.repeat(np.stack([mask[i:j], full[i:j]], 1).ravel(), times)
        hit = masks != 0
        if hit.any():
            rows.append((packs[k], bucket.column("bucket")[0].as_py(), _packed(doc[hit], start[hit], masks[hit])))
    return _table(_TOLD_ROWS, rows)


def _masks(raw: np.ndarray, place: np.ndarray, gram: np.ndarray, lo: np.ndarray, n: np.ndarray, anchor: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Which strings of each stretch (bits, from its first start) stand in a document before ``lo``."""
    _, key = np.unique(gram, return_inverse=True)
    size = n + LENGTH - 1
    raw, place = _gathered(raw, place, size), np.cumsum(size) - size
    order, run = deep_shallow_sort(raw, place, size, key << 13 | n << 8 | anchor)
    new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    first = np.minimum.reduceat(lo[order], new)  # the first document of each distinct stretch
    lead, which = order[new], np.empty(len(order), np.int64)
    which[order] = run
    partly = np.zeros(len(new), np.uint32)
    # different stretches round one anchor: strings that hold the same bytes beside it are sorted
    open_ = np.flatnonzero((np.bincount(key[lead])[key[lead]] > 1) & ~alone[lead])
    if len(open_):
        d = lead[open_]
        own, start, side = [], [], []
        for right in (False, True):
            low, high = (np.maximum(anchor[d] - SIDE + 1, 0), n[d]) if right else (np.zeros(len(d), np.int64), np.minimum(n[d], anchor[d] - SIDE + 1))
            held = np.flatnonzero(low < high)
            at = place[d[held]] + anchor[d[held]] + (GRAM if right else -SIDE)
            core = key[d[held]].astype(_U)
            for k in range(SIDE):
                core = core * _BASE + raw[at + k].astype(_U) + _U(1)
            _, core = np.unique(_mixed(core), return_inverse=True)
            several = np.bincount(core, minlength=1)[core] > 1
            held, core = held[several], core[several]
            times = high[held] - low[held]
            own.append(np.repeat(open_[held], times))
            start.append(np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[held], times))
            side.append(np.repeat(core * 2 + right, times))
        own, start, side = (np.concatenate(x) for x in (own, start, side))
        order, run = deep_shallow_sort(raw, place[lead[own]] + start, np.full(len(own), LENGTH), side)
        if len(order):
            new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            earliest = np.repeat(np.minimum.reduceat(first[own[order]], new), np.diff(np.r_[new, len(run)]))
            hit = order[first[own[order]] > earliest]
            np.bitwise_or.at(partly, own[hit], np.uint32(1) << start[hit].astype(np.uint32))
    full = (np.uint32(1) << n.astype(np.uint32)) - np.uint32(1)
    return np.where(lo > first[which], full, partly[which])


def _cover(size: int, start: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes are covered by the strings that the masks name."""
    step = np.zeros(size + 1, np.int64)
    line = mask & (mask + 1) == 0  # strings one after another from the first start
    count = np.round(np.log2(mask[line] + 1)).astype(np.int64)
    for begin, n in [(start[line], count), *_single(start[~line], mask[~line])]:
        step += np.bincount(begin, minlength=size + 1) - np.bincount(begin + n + LENGTH - 1, minlength=size + 1)
    return np.cumsum(step[:-1]) > 0


def _single(start: np.ndarray, mask: np.ndarray, rows: int = 1 << 16) -> Iterator[tuple[np.ndarray, int]]:
    """The starts that masks name, some masks at a time."""
    for a in range(0, len(start), rows):
        own, k = np.nonzero(mask[a : a + rows, None] >> np.arange(SPAN) & 1)
        yield start[a : a + rows][own] + k, 1


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(pack: pa.Table, told: pa.Table) -> pa.Table:
    """The rows of a pack without what is covered."""
    if not pack.num_rows:
        return _table(_RESULT, [])
    ids, texts, order = _rows(pack)
    parts = [_unpacked(x) for x in told.column("data").to_pylist()]
    doc, start, mask = (np.concatenate([np.zeros(0, np.int64), *(x[k].astype(np.int64) for x in parts)]) for k in range(3))
    by = np.argsort(doc, kind="stable")
    start, mask, edge = start[by], mask[by], np.searchsorted(doc[by], np.arange(len(texts) + 1)).tolist()
    names = pack.column("doc_id").to_pylist()
    out = []
    for i, text in enumerate(texts):
        a, b = edge[i], edge[i + 1]
        if a == b:
            out.append((names[order[i]], len(text), 0, 0, text))
            continue
        gone = _cover(len(text), start[a:b], mask[a:b])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((names[order[i]], len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
    return _table(_RESULT, out)


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``, one row for each row of ``docs``.

    ``kept`` are the remaining UTF-8 bytes. Null texts are empty; documents without a doc_id come
    after all others and not before one another; rows of equal doc_id are one document as far as
    order goes and keep their rows. Other columns do not matter. Results do not depend on ``hot``.
    """
    parts = docs.rdd.getNumPartitions()
    n_packs, anchor_buckets, string_buckets = (max(16, k * parts) for k in (PACKS, ANCHOR_BUCKETS, STRING_BUCKETS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    # rows that repeat lie in different packs as far as they come from different partitions
    dealt = rows.withColumns({"doc": F.coalesce("doc_id", F.lit(NO_ID)), "pack": F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_packs))})
    packs = dealt.groupBy("pack")
    told = packs.applyInArrow(_asker(anchor_buckets), _ASKED).groupBy("bucket").applyInArrow(_told(hot), _TOLD)
    offers = packs.cogroup(told.groupBy("pack")).applyInArrow(_emitter(string_buckets), _ASKED)
    hits = offers.groupBy("bucket").applyInArrow(_settle, _TOLD)
    return packs.cogroup(hits.groupBy("pack")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
