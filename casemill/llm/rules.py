"""Quality rules: counters of a text, and perplexity bands of each language.

The language model is an interpolated modified Kneser-Ney model (Chen & Goodman, 1998) of order
five over characters, contexts running across words; characters stay what they are, in whatever
script. Spark counts the n-grams and works out their probabilities by joins, so the model grows
with the corpus and nothing of it has to fit one task. Every n-gram is scored as if its own
occurrence had not been counted (leaving one out), down through the orders: what occurs once is
as surprising as if it had never been seen.

The finished model is a table of n-grams with log probabilities. It is cut into blocks of at most
``BLOCK_BYTES``; a block is sent to the executors as a sorted array of n-gram hashes beside its
values. A document's log perplexity is a sum over its n-grams, so blocks simply add up, one pass
over the documents a block.

Bands come from all documents of a language, through a histogram whose size is bounded by its
bins. Nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from casemill.llm.arrow import slices
from casemill.plans.cut import dropped, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
ORDER = 5
#: No count is discounted by less, so every character stays possible in every context.
LEAST_DISCOUNT = 0.01
#: Perplexity bands: median plus or minus so many deviations. A deviation joins the normalised
#: interquartile range of the language and the noise of a mean over the characters of the text.
BAND_WIDTH = 4.0
NOISE = 1.0
#: Languages with fewer documents than this, and those beyond the most frequent ones, share a model and bands.
LEAST_DOCS, MOST_LANGUAGES = 20, 1000
#: Bytes of the model that are sent to the executors at a time, and of an entry of it.
BLOCK_BYTES, ENTRY_BYTES = 64 << 20, 16
#: Characters of text that are worked on at a time.
BLOCK_CHARS = 400_000
BINS = 1000
#: Distinct words of a text from which three of their numbers may not fit one of 64 bits.
WIDE = 2_000_000
UNKNOWN, SHARED = "und", "*"
_SPACE = bytes([9, 10, 11, 12, 13, 32])
_NOT_COUNTED = _SPACE + bytes(range(128, 192))
_PAD = " " * (ORDER - 1)
_U = np.uint64


def streams(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and where each begins.

    A text is its words, a space after each, behind a context of spaces; a text of n characters in
    w words has n + w n-grams, one for each character and space.
    """
    texts = [_PAD + b" ".join(w).decode() + " " if w else "" for w in words]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return codes, np.cumsum([0, *map(len, texts)])


def _windows(starts: np.ndarray) -> np.ndarray:
    """Which places of the stream begin an n-gram: not those whose n-gram would reach into the next text."""
    inside = np.ones(int(starts[-1]), bool)
    ends = starts[1:][starts[1:] > starts[:-1]]
    for k in range(1, ORDER):
        inside[ends - k] = False
    return inside[: max(0, len(inside) - ORDER + 1)]


def hashed(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``ORDER`` code points from each place."""
    out = np.zeros(max(0, len(codes) - ORDER + 1), _U)
    for k in range(ORDER):
        out = out * _U(0x9E3779B97F4A7C15) + codes[k : k + len(out)].astype(_U) + _U(1)
    return out


def _seeded(h: np.ndarray, lang: str) -> np.ndarray:
    x = h ^ _U(xxhash.xxh64_intdigest(lang.encode()))
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


#: Characters that a tally numbers, so that an n-gram is one number; a text with more is tallied by itself.
ALPHABET = 1 << 60 // ORDER
#: N-grams of a tally that a task keeps before it sends them.
TALLIED = 400_000


class Tally:
    """Counts of the n-grams of some streams, by language, in sorted arrays."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number = np.full(0x110000, -1, np.int16)
        self.alphabet = np.zeros(0, np.int64)
        self.sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, lang: str, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[str, list[str], np.ndarray]]:
        """Count a stream; what no longer fits comes out as ``(language, n-grams, counts)``."""
        places = np.flatnonzero(_windows(starts))
        if not len(places):
            return
        fresh = np.unique(codes[self.number[codes] < 0])
        if len(self.alphabet) + len(fresh) > ALPHABET:
            yield from self.flush()
            fresh = np.unique(codes)
        if len(fresh) > ALPHABET:
            grams, times = np.unique(np.stack([codes[places + k] for k in range(ORDER)], 1), axis=0, return_counts=True)
            yield lang, _strings(grams), times
            return
        self.number[fresh] = np.arange(len(self.alphabet), len(self.alphabet) + len(fresh))
        self.alphabet = np.r_[self.alphabet, fresh]
        small, keys = self.number[codes].astype(np.int64), np.zeros(len(places), np.int64)
        for k in range(ORDER):
            keys = keys << 60 // ORDER | small[places + k]
        keys.sort()
        old, times = self.sums.get(lang, (keys[:0], keys[:0]))
        self.sums[lang] = _summed(*_runs(keys), old, times)
        if sum(len(k) for k, _ in self.sums.values()) > TALLIED:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[str, list[str], np.ndarray]]:
        for lang, (keys, times) in self.sums.items():
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                grams = np.stack([part >> 60 // ORDER * (ORDER - 1 - k) & ALPHABET - 1 for k in range(ORDER)], 1)
                yield lang, _strings(self.alphabet[grams]), times[at : at + 100_000]
        self.clear()


def _strings(grams: np.ndarray) -> list[str]:
    text = grams.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.r_[np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
    return keys[new], np.diff(np.r_[new, len(keys)])


def _summed(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tallies as one."""
    if not len(b):
        return a, n
    keys, times = np.r_[a, b], np.r_[n, m]
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(times, new)


def _language(df: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)) if "lang" in df.columns else F.lit(UNKNOWN)


def _blocks(langs: list[str], texts: list[bytes]) -> Iterator[tuple[str, list[int], list[list[bytes]]]]:
    """Texts of one language with their words, some MB at a time: language, their numbers, their words."""
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by.setdefault(lang, []).append(i)
    for lang, own in by.items():
        at = 0
        while at < len(own):
            end, size = at, 0
            while end < len(own) and (size == 0 or size + len(texts[own[end]]) <= BLOCK_CHARS):
                size += len(texts[own[end]])
                end += 1
            yield lang, own[at:end], [texts[i].split() for i in own[at:end]]
            at = end


def frequent(docs: DataFrame, least_docs: int = LEAST_DOCS) -> list[str]:
    """The languages that have a model of their own."""
    counts = docs.groupBy(_language(docs).alias("lang")).count().filter(F.col("count") >= least_docs)
    return [r.lang for r in counts.orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()]


def count_grams(docs: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """``(lang, gram, n)``: the n-grams of all documents, counted by language; those not in ``langs`` together."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches):
        tally = Tally()

        def rows(done):
            for lang, grams, n in done:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], schema=schema)

        for batch in slices(batches, 2048):
            for lang, _, words in _blocks(batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]):
                yield from rows(tally.add(lang, *streams(words)))
        yield from rows(tally.flush())

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = _language(docs) if langs is None else F.when(_language(docs).isin(langs), _language(docs)).otherwise(SHARED)
    return docs.select(lang.alias("lang"), text).mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _with_discounts(level: DataFrame) -> DataFrame:
    """``d1``, ``d2``, ``d3`` of each language, beside every row; a level too regular for the estimates has fixed ones."""
    sums = level.groupBy("lang").agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    sound = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    estimates = [F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(LEAST_DISCOUNT)) for k in (1, 2, 3)]
    fixed = (0.5, 0.75, 1.0)
    discounts = sums.select("lang", *(F.when(sound, e).otherwise(x).alias(f"d{k}") for k, (e, x) in enumerate(zip(estimates, fixed, strict=True), 1)))
    return level.join(discounts, "lang")  # a row a language


def lower_orders(counts: DataFrame) -> list[DataFrame]:
    """Continuation counts of the orders below, highest first, stored.

    A plan that works all of them out several times over costs the driver memory with the square of its size.
    """
    levels = [counts]
    for _ in range(ORDER - 1):
        levels.append(stored(levels[-1].groupBy("lang", F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "level"))
    return levels[1:]


def kneser_ney(counts: DataFrame, lower_counts: list[DataFrame] | None = None) -> DataFrame:
    """``(lang, gram, p, q)``: the probability of each n-gram's last character, and the same with one occurrence left out.

    Highest order: counts of occurrences; below: of distinct characters before (continuations).
    Below the lowest order all characters of the language are equally likely, and one more.
    Leaving an occurrence out takes one from the n-gram's count; where that was all of it, one
    from its suffix's count as well, and so on. ``lower_counts``: the result of ``lower_orders``,
    where the caller deletes it.
    """
    levels = [counts.select("lang", "gram", "n"), *(lower_orders(counts) if lower_counts is None else lower_counts)]
    lower = None
    for k, level in enumerate(levels[::-1], 1):
        beside = Window.partitionBy("lang", "context")
        rows = level.withColumn("context", F.substring("gram", 1, k - 1)).select(
            "lang", "gram", "n", F.sum("n").over(beside).alias("total"),
            *(F.count_if(F.col("n") == j if j < 3 else F.col("n") >= 3).over(beside).alias(f"m{j}") for j in (1, 2, 3)),
            *([F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("size")] if k == 1 else []),
        )
        rows = _with_discounts(rows)
        if lower is None:
            base = 1 / (F.col("size") + 1.0)
            rows = rows.withColumns({"p_low": base, "q_low": base})
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, ORDER)).join(lower, ["lang", "suffix"])
        n = F.col("n")

        def off(x: Column) -> Column:
            return F.when(x <= 0, 0.0).when(x == 1, F.col("d1")).when(x == 2, F.col("d2")).otherwise(F.col("d3"))

        def kept(*m: Column) -> Column:
            return F.col("d1") * m[0] + F.col("d2") * m[1] + F.col("d3") * m[2]

        m1, m2, m3 = (F.col(f"m{j}") for j in (1, 2, 3))
        is_ = lambda j: (n == j).cast("long")
        left = kept(m1 - is_(1) + is_(2), m2 - is_(2) + is_(3), m3 - is_(3))
        p = (n - off(n)) / F.col("total") + kept(m1, m2, m3) / F.col("total") * F.col("p_low")
        low = F.when(n == 1, F.col("q_low")).otherwise(F.col("p_low"))
        q = F.when(F.col("total") <= 1, low).otherwise((n - 1 - off(n - 1)) / (F.col("total") - 1) + left / (F.col("total") - 1) * low)
        done = rows.select("lang", "gram", p.alias("p"), q.alias("q"))
        lower = done.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_low"), F.col("q").alias("q_low"))
    return done


class Block:
    """A part of the model: sorted n-gram hashes, with a directory of their leading bits, and log probabilities."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.bits = max(4, int(len(keys)).bit_length())
        self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=_U) << _U(64 - self.bits)).astype(np.int32)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The values of the hashes, 0 for those that are not here."""
        out = np.zeros(len(h), np.float32)
        if not len(self.keys):
            return out
        at = self.first[(h >> _U(64 - self.bits)).astype(np.int64)].astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            at, left = at[at < len(self.keys)], left[at < len(self.keys)]
            there = self.keys[at]
            same = there == h[left]
            out[left[same]] = self.values[at[same]]
            more = there < h[left]
            at, left = at[more] + 1, left[more]
        return out


class Model:
    """The model of all languages: a stored table of hashes and values, handed out block by block."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS) -> None:
        self.langs = frequent(docs, least_docs)
        kind = pa.schema([("h", pa.int64()), ("value", pa.float32())])

        def hashes(batches):
            for batch in batches:
                lang = batch.column(0).dictionary_encode()
                codes = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
                h, which = np.zeros(len(codes), _U), lang.indices.to_numpy()
                for k in range(ORDER):
                    h = h * _U(0x9E3779B97F4A7C15) + codes[:, k].astype(_U) + _U(1)
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    h[which == i] = _seeded(h[which == i], name)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(2).cast(pa.float32())], schema=kind)

        counts = stored(count_grams(docs, self.langs), "grams")
        lower = lower_orders(counts)
        self.table = stored(kneser_ney(counts, lower).select("lang", "gram", F.log("q")).mapInArrow(hashes, "h long, value float"), "model")
        dropped(counts, *lower)
        self.n_blocks = max(1, -(-self.table.count() * ENTRY_BYTES // BLOCK_BYTES))

    def __len__(self) -> int:
        return self.n_blocks

    def __iter__(self) -> Iterator[Block]:
        for b in range(self.n_blocks):
            yield self._block(b)

    def _block(self, b: int) -> Block:
        part = self.table.filter(F.pmod("h", F.lit(self.n_blocks)) == b).toArrow()
        return Block(part.column("h").to_numpy().view(_U), part.column("value").to_numpy())


def log_sums(block: Block, langs: list[str], texts: list[bytes]) -> np.ndarray:
    """The sum of the log probabilities of each text's n-grams, as far as the block has them."""
    out = np.zeros(len(texts))
    for lang, own, words in _blocks(langs, texts):
        codes, starts = streams(words)
        if len(codes) < ORDER:
            continue
        value = block.look_up(_seeded(hashed(codes), lang)) * _windows(starts)
        sums = np.r_[0.0, np.cumsum(value, dtype=np.float64)]
        out[own] = sums[np.minimum(starts[1:], len(value))] - sums[np.minimum(starts[:-1], len(value))]
    return out


def repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = len(number)
    pairs = ids[:-1] * size + ids[1:]
    if size > WIDE:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * size + ids[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    windows = np.flatnonzero(twice[at] == keys)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, windows, 1)
    np.add.at(step, windows + 3, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def counters(text: bytes) -> tuple[int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)``."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars, plain = len(text.translate(None, _NOT_COUNTED)), len(text.translate(None, SYMBOLS))
    return len(words), chars, len(text) - plain, len(lines) - len(set(lines)), repeated(words)


COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat_words) > MAX_REPEAT_PERCENT * F.col(n_words))


def _names(columns: list[str]) -> dict[str, str]:
    """Names for the measures that ``columns`` do not have."""
    out = {}
    for name in ("language", *COUNTERS, "log_sum"):
        fresh = f"_{name}"
        while fresh in columns:
            fresh = f"_{fresh}"
        out[name] = fresh
    return out


def measured(docs: DataFrame, model: Model, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of ``docs`` with its measures as further columns, stored; and the names that those have.

    Rows are measured where they lie: one pass over the texts for each block of the model, the
    counters in the first.
    """
    own = _names(docs.columns)
    kinds = [StringType(), *[LongType()] * len(COUNTERS), DoubleType()]
    more = [StructField(n, k) for n, k in zip(own.values(), kinds, strict=True)]

    def one(rows: DataFrame, block: Block, first: bool, columns: list[str]) -> DataFrame:
        names = rows.columns
        text_at, lang_at = names.index("text"), names.index("lang") if "lang" in names else None
        at = [names.index(c) for c in columns]
        schema = StructType([*(docs.schema[c] for c in columns), *more])
        wide, sent, known = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(block), set(model.langs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = [(t or "").encode() for t in batch.column(text_at).to_pylist()]
                said = batch.column(lang_at).cast(pa.string()).to_pylist() if lang_at is not None else [None] * len(texts)
                langs = [x if x in known else SHARED for x in (UNKNOWN if x is None else x for x in said)]
                sums = log_sums(sent.value, langs, texts)
                if first:
                    counts = list(zip(*map(counters, texts), strict=True)) if texts else [[]] * len(COUNTERS)
                    made = [pa.array(langs, pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
                else:
                    made = batch.columns[-len(more) : -1]
                    sums = sums + batch.column(batch.num_columns - 1).to_numpy()
                yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(wide.field(k).type) for k, i in enumerate(at)), *made, pa.array(sums)], schema=wide)

        out = stored(rows.mapInArrow(run, schema), "measured")
        sent.unpersist()
        return out

    rows = docs
    for k, block in enumerate(model):
        before, rows = rows, one(rows, block, k == 0, keep if k == len(model) - 1 else docs.columns)
        if k:
            dropped(before)
    return rows, own


def bands(rows: DataFrame, own: dict[str, str], least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(language, middle, spread)`` of the log perplexity of each language, over all documents that pass the base rules.

    Quartiles are read off a histogram of ``BINS`` bins a nat, so they are exact to a bin and the
    same whatever the partitioning; what reaches the driver is bounded by the bins. A language
    with fewer than ``least_docs`` such documents has no bands.
    """
    good = rows.filter(~base_failed(own["n_words"], own["n_repeat_words"]))
    pdf = good.groupBy(F.col(own["language"]).alias("language"), F.round(_log_perplexity(own) * BINS).cast("long").alias("bin")).count().toPandas()
    out = []
    for lang, g in pdf.groupby("language"):
        g = g.sort_values("bin")
        if g["count"].sum() >= least_docs:
            share = g["count"].cumsum() / g["count"].sum()
            q1, q2, q3 = (float(g["bin"].iloc[int(np.searchsorted(share, q))]) / BINS for q in (0.25, 0.5, 0.75))
            out.append((str(lang), q2, max((q3 - q1) / 1.349, 0.01)))
    return rows.sparkSession.createDataFrame(out, "language string, middle double, spread double")


def _log_perplexity(own: dict[str, str]) -> Column:
    """Nats a character; null without a word."""
    return -F.try_divide(F.col(own["log_sum"]), F.col(own["word_chars"]) + F.col(own["n_words"]))


def _judged(docs: DataFrame, keep: list[str], width: float, least_docs: int) -> tuple[DataFrame, dict[str, str], Column, Column]:
    """Measured rows beside their bands; their measures' names, whether the base rules fail and whether to keep."""
    rows, own = measured(docs, Model(docs, least_docs), keep)
    table = bands(rows, own, least_docs).select(*(F.col(c).alias(f"_band_{own['language']}_{c}") for c in ("language", "middle", "spread")))
    language, middle, spread = table.columns
    joined = rows.join(F.broadcast(table), F.col(own["language"]) == F.col(language), "left")  # a row a language
    room = width * F.sqrt(F.col(spread) ** 2 + NOISE**2 / (F.col(own["word_chars"]) + F.col(own["n_words"])))
    failed = base_failed(own["n_words"], own["n_repeat_words"])
    inside = F.coalesce(F.abs(_log_perplexity(own) - F.col(middle)) <= room, F.lit(True))
    return joined, own, failed, ~failed & inside


def assess(docs: DataFrame, width: float = BAND_WIDTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity)``.

    One row for each row of ``docs``. ``base_failed``: fewer than ``MIN_WORDS`` words, or more than
    half of them in repeated three-word windows. ``kept``: not failed, and the log perplexity
    inside the bands of the language. Null texts have no words, no perplexity and fail; a null
    lang (or no such column) is a language of its own; languages with fewer than ``least_docs``
    documents share a model and bands, and where even together fewer than that pass the base rules,
    nothing is known about them and they are kept. Null doc_ids and repeated rows keep their rows.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["lang"] if "lang" in docs.columns else []))
    rows, own, failed, keep = _judged(read, ["doc_id"], width, least_docs)
    return rows.select("doc_id", *(F.col(own[c]).alias(c) for c in COUNTERS), failed.alias("base_failed"), keep.alias("kept"), _log_perplexity(own).alias("log_perplexity"))


def keep_good(docs: DataFrame, width: float = BAND_WIDTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, all columns; texts are scored once and never shuffled."""
    rows, _, _, keep = _judged(docs, docs.columns, width, least_docs)
    return rows.filter(keep).select(*docs.columns)
