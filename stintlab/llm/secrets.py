"""Secret scans: fixed patterns, and strings that a public vocabulary encodes poorly.

A random string costs a token for little more than one character, while words, even invented ones, cost a token
for several. Candidates are runs of at least ``MIN_RUN`` characters of the base64 and identifier alphabets; those
with fewer than ``MAX_RATIO`` characters a token are reported as kind ``random`` unless they are a known digest
(pure hex of a digest's length), a UUID, a number, or lie in a span that a pattern has found. Of a run that spans
cover in part, each uncovered piece of at least ``MIN_RUN`` characters is a candidate.

Null and empty texts have no spans; repeated rows give repeated rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlab.llm.common import kept, map_texts, slices

KINDS = ("assign", "access", "hex", "random")
MIN_RUN, MAX_RATIO = 20, 1.9
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths in hex of md5, sha1, sha224, sha256, sha384 and sha512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_ALL_HEX = re.compile(r"[0-9a-fA-F]+")
_NEAR = ("password", "passwd", "secret", "token", "api")


def vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoder(path: str):
    return kept(("encoding", path), lambda: vocabulary(path)).encode_ordinary


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches that are long enough."""
    low = text.lower()
    found = []
    if any(x in low for x in _NEAR):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found


def _is_known(run: str) -> bool:
    return run.isdigit() or len(run) in DIGEST_LENGTHS and bool(_ALL_HEX.fullmatch(run)) or bool(_UUID.fullmatch(run))


def uncovered(a: int, b: int, base: list[tuple[int, int, int]], first: int = 0) -> list[tuple[int, int]]:
    """The parts of a range outside of spans, which are sorted by their starts, from the ``first`` on."""
    out = []
    for i in range(first, len(base)):
        s, _, e = base[i]
        if s >= b:
            break
        if a < s:
            out.append((a, s))
        a = max(a, e)
    return [*out, (a, b)] if a < b else out


def spans_of(text: str | None, encode, min_ratio: float = MAX_RATIO) -> tuple[list[tuple], list[tuple]]:
    """The patterns' spans and all spans, each by start and then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    long = [w for w in text.split() if len(w) >= 16]
    if any(_HEX.search(w) for w in long):
        base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    added = []
    if any(_RUN.search(w) for w in long):
        # a run meets no span before the first whose end, or that of one before it, lies beyond the run's start
        ends = list(accumulate((e for *_, e in base), max))
        for m in _RUN.finditer(text):
            if _is_known(m[0]):
                continue
            for a, b in uncovered(m.start(), m.end(), base, bisect_right(ends, m.start())):
                run = text[a:b]
                # a piece begins or ends with what joined it to a span
                if len(run) < MIN_RUN or len(run) < len(m[0]) and _is_known(run.strip("-_/+=")):
                    continue
                if len(set(run)) >= 8 and len(run) < min_ratio * len(encode(run)):
                    added.append((a, 3, b))
    return base, sorted(base + added)


def _join(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


COLUMNS = [
    ("n_assign", pa.int64(), "long"), ("n_access", pa.int64(), "long"), ("n_hex", pa.int64(), "long"),
    ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string"), ("n_random", pa.int64(), "long"),
]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def find_secrets(docs: DataFrame, vocabulary_path: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row a document: counts by kind, a digest of the patterns' spans, and all spans."""
    path = vocabulary_path or default_vocabulary()

    def make():
        encode = _encoder(path)

        def fn(texts):
            out = []
            for t in texts:
                base, every = spans_of(t, encode, max_ratio)
                kinds = [k for _, k, _ in every]
                out.append(
                    (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), kinds.count(3))
                )
            return list(zip(*out, strict=True))

        return fn

    return map_texts(docs, make, COLUMNS)


def redact_secrets(docs: DataFrame, vocabulary_path: str | None = None, max_ratio: float = MAX_RATIO, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each run of spans replaced by ``mark``; other columns stay, n_chars follows the text."""
    path = vocabulary_path or default_vocabulary()
    at = docs.columns.index("text")
    wanted = docs.schema
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text, encode):
        _, every = spans_of(text, encode, max_ratio)
        if not every:
            return text
        parts, last = [], 0
        for a, _, b in every:
            if a >= last:
                parts += [text[last:a], mark]
            last = max(last, b)
        return "".join([*parts, text[last:]])

    def run(batches):
        encode = _encoder(path)
        for batch in batches:
            for part in slices(batch, at):
                columns = list(part.columns)
                old = columns[at].to_pylist()
                new = [clean(t, encode) for t in old]
                columns[at] = pa.array(new, pa.string())
                if counted is not None:
                    n = columns[counted].to_pylist()
                    columns[counted] = pa.array([len(t) if t != o else k for t, o, k in zip(new, old, n, strict=True)], columns[counted].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in docs.columns)).mapInArrow(run, wanted)
