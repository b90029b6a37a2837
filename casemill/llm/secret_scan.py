"""Secret scan: fixed shapes, and random strings shown up by the token-efficiency test.

Words and names fall into few tokens of a byte-pair vocabulary, random strings into many: a run
of code-like characters is cut at its separators, words, digests and UUIDs are set aside, and
what is left with few characters per token is reported. The shapes of well-known secrets are matched beside it and stay.

Everything is decided within a row: one pass, no shuffle. The vocabulary file is read by the
driver and sent to the executors as bytes; its size is a vocabulary's, not the data's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.arrow import arrow_map, rewrite

# The shapes that the scan must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# End of fixed values.
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

#: Letters of one case are tested from this length on, strings of digits and letters or of both cases from the next.
LEAST_RUN, LEAST_PART = 20, 12
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_PART)
PART = re.compile(r"[A-Za-z0-9]+")
#: Runs with fewer characters per token than this are random.
MAX_EFFICIENCY = 2.0
#: Digests by their exact length in hexadecimal, and identifiers.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
UUID = re.compile(r"(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])", re.I)
NUMBER = re.compile(r"[0-9+/_=-]+\Z")
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*\Z")
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
#: A cheap necessary condition for an assignment: its keyword.
_KEYWORD = re.compile(r"pass(?:word|wd)|secret|token|api_?key", re.I | re.A)


@lru_cache(maxsize=2)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, stop)`` of the fixed shapes, leftmost and non-overlapping for each kind."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    # only runs that are long enough are looked for; they are the same runs
    out += [(m.start(), "hex", m.end()) for m in _LONG_HEX.finditer(text)]
    return _ordered(out)


_LONG_HEX = re.compile(HEX.pattern[:-1] + "{%d,}" % LEAST_HEX)


def _ordered(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def _mixed(part: str) -> bool:
    """Letters and digits, or letters of both cases beyond a capital at the start."""
    letters = any(c.isalpha() for c in part)
    return letters and (any(c.isdigit() for c in part) or not (part.islower() or part.isupper() or part.istitle()))


def _random_in(run: str, low: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    """Random stretches of a run: neighbouring parts between words, digests and UUIDs, or single parts of them."""
    known = [m.span() for m in UUID.finditer(run)]
    stretches: list[list[re.Match]] = [[]]
    for m in PART.finditer(run):
        part = m[0]
        word = part.isalpha() and (len(part) >= 8 or (len(part) >= 3 and IDENTIFIER.match(part))) and not low(part)
        if word or DIGEST.match(part) or any(a <= m.start() < b for a, b in known):
            stretches.append([])
        elif stretches[-1] or not IDENTIFIER.match(part) or len(part) >= LEAST_PART:
            stretches[-1].append(m)
    for parts in filter(None, stretches):
        strong = [m for m in parts if not m[0].isdigit() and len(m[0]) >= (LEAST_PART if _mixed(m[0]) else LEAST_RUN) and low(m[0])]
        start, stop = parts[0].start(), parts[-1].end()
        while run[stop : stop + 1] == "=":
            stop += 1
        whole = run[start:stop]
        if stop - start >= LEAST_RUN and low(whole) and (strong or (_mixed(whole) and not IDENTIFIER.match(whole))):
            yield start, stop
        else:
            yield from (m.span() for m in strong)


def random_spans(text: str, encoding: tiktoken.Encoding, max_efficiency: float = MAX_EFFICIENCY) -> list[tuple[int, str, int]]:
    """Strings whose characters per token are few: random strings without a known shape."""

    def low(s: str) -> bool:
        return len(s) < max_efficiency * len(encoding.encode_ordinary(s))

    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if NUMBER.match(run) or (len(run) < LEAST_RUN and not _mixed(run)):
            continue
        found = list(_random_in(run, low))
        if not found and len(run) >= LEAST_RUN and _mixed(run) and not (DIGEST.match(run) or UUID.search(run) or IDENTIFIER.match(run)) and low(run):
            found = [(0, len(run))]
        out += [(m.start() + a, "random", m.start() + b) for a, b in found]
    return out


def all_spans(text: str, encoding: tiktoken.Encoding, max_efficiency: float = MAX_EFFICIENCY) -> list[tuple[int, str, int]]:
    """The fixed shapes, and the random strings that none of them overlaps."""
    base = base_spans(text)
    more = [r for r in random_spans(text, encoding, max_efficiency) if not any(b[0] < r[2] and r[0] < b[2] for b in base)]
    return _ordered(base + more)


def scan(docs: DataFrame, ranks_path: str | Path, max_efficiency: float = MAX_EFFICIENCY) -> DataFrame:
    """``(doc_id, spans)``, one row for each row of ``docs``.

    ``spans`` is an array of (kind, start, stop) in code points, stop exclusive, by start and then
    kind as in ``KINDS``; empty for null and clean texts. Null doc_ids and repeated rows keep
    their rows; other columns do not matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def kernel(ids: list, texts: list) -> Iterator[tuple]:
        encoding = _encoding(sent.value)
        for doc_id, text in zip(ids, texts, strict=True):
            yield doc_id, [{"kind": k, "start": a, "stop": b} for a, k, b in all_spans(text, encoding, max_efficiency)]

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return arrow_map(rows, kernel, "doc_id long, spans array<struct<kind:string,start:long,stop:long>>")


def redact(docs: DataFrame, ranks_path: str | Path, mark: str = "[SECRET]", max_efficiency: float = MAX_EFFICIENCY) -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; every row and column stays, n_chars follows."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def decide(texts: list[str]) -> tuple[None, list]:
        encoding, new = _encoding(sent.value), []
        for text in texts:
            kept, at, spans = [], 0, all_spans(text, encoding, max_efficiency)
            for a, _, b in spans:
                if a >= at:
                    kept += [text[at:a], mark]
                at = max(at, b)
            new.append("".join([*kept, text[at:]]) if spans else None)
        return None, new

    return rewrite(docs, decide)
