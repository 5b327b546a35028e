"""Secret scan: fixed patterns, and random strings found by token efficiency.

Base patterns give spans of kind assign, access and hex.  The token test looks
at every long run of key characters, or what base spans leave of it: written
language and ordinary identifiers take few tokens under a byte-level BPE
vocabulary, random strings take many, so a run with few characters per token is
reported as kind token.  Runs of letters with a digit or two at most need fewer
still, as long made-up words come near random ones.  Known digests and
identifiers (digests in hex, UUIDs, plain numbers, dates) are not tested, nor
are runs of under 20 characters.

Defined cases: a null text counts as empty; positions are code points of the
whole text, end exclusive; repeated rows and rows without doc_id are scanned
like any other; an empty table gives an empty result; base spans of different
kinds may overlap, a token span overlaps no base span.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.llm import words as W

# The base patterns and their least lengths. Letters of the key words count in either case (ASCII only).
KINDS = ("assign", "access", "hex", "token")
_ANY = "".join
_WORDS = "|".join(_ANY(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                  for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16

#: Runs for the token test, and how few characters per token make one random.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")  # LEAST_RUN and more
LEAST_RUN = 20
MAX_CHARS_PER_TOKEN = 2.1
MAX_LETTERS_PER_TOKEN = 2.0
_IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"  # digests
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9/_=+-]+"  # numbers, dates, rules of marks
)


_MARKS = "+/_=-"

# A text in ASCII, a byte a code point (others as "?"), so that plain searches find where patterns can begin.
_STARTS = (b"passw", b"secret", b"token", b"api")
_IN_RUN = bytes(120 if RUN.fullmatch(chr(c) * LEAST_RUN) else 32 for c in range(128)) + b" " * 128


def _runs(flat: bytes) -> list[tuple[int, int]]:
    """(start, end) of the matches of ``RUN``, in order."""
    same, out = flat.translate(_IN_RUN), []
    at = same.find(b"x" * LEAST_RUN)
    while at >= 0:
        end = same.find(b" ", at)
        end = len(same) if end < 0 else end
        out.append((at, end))
        at = same.find(b"x" * LEAST_RUN, end)
    return out


def _assigned(text: str, flat: bytes) -> list[tuple[int, int]]:
    """(start, end) of the matches of ``ASSIGN`` that are long enough."""
    low, starts = flat.lower(), []
    for word in _STARTS:
        at = low.find(word)
        while at >= 0:
            starts.append(at)
            at = low.find(word, at + 1)
    out, until = [], 0
    for at in sorted(starts):
        m = ASSIGN.match(text, at) if at >= until else None
        if m:
            until = m.end()
            out += [(at, until)] if len(m[2]) >= MIN_ASSIGN else []
    return out


def _base_spans(text: str, flat: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    out = [(0, s, e) for s, e in _assigned(text, flat)]
    if b"AKIA" in flat:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # 32 hex digits are a part of a run, and no run goes on where another begins
    out += [(2, m.start(), m.end()) for s, e in runs for m in HEX.finditer(text, s, e)]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's index, start, end), leftmost and non-overlapping per kind."""
    flat = text.encode("ascii", "replace")
    return _base_spans(text, flat, _runs(flat))


def token_spans(text: str, base: list[tuple[int, int, int]], n_tokens, max_ratio: float,
                runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Runs with few characters per token, and the parts that ``base`` leaves of runs, but for the known kinds."""
    runs = _runs(text.encode("ascii", "replace")) if runs is None else runs
    if not runs:
        return []
    out, starts, until = [], [], []  # base spans as disjoint intervals
    for _, s, e in sorted(base, key=lambda x: (x[1], x[2])):
        if until and s <= until[-1]:
            until[-1] = max(until[-1], e)
        else:
            starts.append(s)
            until.append(e)
    for start, end in runs:
        at, near = start, bisect.bisect_right(until, start)
        parts = []
        while near < len(starts) and starts[near] < end:
            parts.append((at, starts[near]))
            at, near = until[near], near + 1
        for s, e in parts + [(at, end)]:
            if (s, e) != (start, end):  # marks between a base span and the rest belong to neither
                while s < e and text[s] in _MARKS:
                    s += 1
                while s < e and text[e - 1] in _MARKS:
                    e -= 1
            run = text[s:e]
            if len(run) < LEAST_RUN or not any(c.isalpha() for c in run) or _IDENTIFIER.fullmatch(run):
                continue
            letters = sum(c.isdigit() for c in run) <= 2
            if len(run) <= min(max_ratio, MAX_LETTERS_PER_TOKEN if letters else max_ratio) * n_tokens(run):
                out.append((3, s, e))
    return out


def written(spans) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def masked(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every maximal union of spans replaced by ``mark``."""
    out, at, until = [], 0, -1
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= until:
            out += [text[at:s], mark]
        at = until = max(until, e)
    return "".join(out) + text[at:]


_COUNTERS: dict[str, object] = {}


def _counter(ranks_file: bytes, pattern: str):
    """Tokens of a string under a rank file, by the installed tokenizer."""
    name = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if name not in _COUNTERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        enc = tiktoken.Encoding(name[:16], pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _COUNTERS[name] = lambda s: len(enc.encode_ordinary(s))
    return _COUNTERS[name]


def scan(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text",
         max_ratio: float = MAX_CHARS_PER_TOKEN, mask: bool = False) -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_token, base_sha256, spans) per row; with ``mask``, all input columns
    with ``text`` masked instead.  ``vocabulary`` is a rank file on the driver (about 1 MB, broadcast)."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks_file = spark.sparkContext.broadcast(f.read())

    def found(t: str):
        flat = t.encode("ascii", "replace")
        runs = _runs(flat)
        base = _base_spans(t, flat, runs)
        return base, base + token_spans(t, base, _counter(ranks_file.value, pattern), max_ratio, runs) if runs else base

    if mask:
        at = docs.columns.index(text)

        def run_mask(batches):
            for b in batches:
                texts = []
                for t in b.column(at):
                    t = t.as_py()
                    spans = found(t)[1] if t else ()
                    texts.append(masked(t, spans) if spans else t)
                cols = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(cols, b.schema.names)

        return W.map_batches(docs, run_mask, docs.schema)

    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = (f"`{key}` {docs.schema[key].dataType.simpleString()}, n_assign long, n_access long, n_hex long, "
              "n_token long, base_sha256 string, spans string")

    def run(batches):
        for b in batches:
            counts, sha, spans = [[], [], [], []], [], []
            for t in b.column(1):
                base, every = found(t.as_py())
                for k in range(4):
                    counts[k].append(sum(x[0] == k for x in every))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()),
                 pa.array(spans, pa.string())],
                [key, "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    return W.map_batches(rows, run, schema)
