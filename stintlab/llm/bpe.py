"""Byte-level BPE by a lazily determinised finite-state transducer.

The encoding of a piece is the only chain of tokens whose adjacent pairs are stable: encoding the two tokens'
bytes gives the two tokens back. Hence every prefix of a piece has one last token, and the encoding of a longer
prefix extends the encoding of a shorter one. The transducer reads a byte at a time. Its state is the set of places at
which a later token could still start, each with where the bytes since lead in the tokens' trie and the token before it;
a step gives the next state and the token that ends the text read so far. Places are no older than the longest token, so
all that the open places' ways back share is settled and goes out: at a piece's end, or in a long piece from time to
time. A state is that set of places; states and transitions are made when a text first needs them and kept in tables.
Pieces of many texts are read together, a byte of each at a time, so that a transition is looked up once for all of them.

Decoding feeds the tokens' bytes, some thousand tokens at a time, to an incremental UTF-8 state machine,
:class:`Utf8Stream`, which gives the text as it comes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Collection, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stintlab.llm.common import kept, map_texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of a worker's tables: transitions, which then start again, and words, half of them of an older generation.
MAX_KEPT = 300_000
#: Bytes of a piece after which settled tokens go out, and bits of a token's number in a table's entries.
LONG, _ID_BITS = 1 << 14, 20
#: Bytes of the longest piece that is read together with others.
WIDE = 64
#: Characters of a text or word from which its pieces are cut a part at a time, and pieces or tokens of such a part.
VERY_LONG, PART = 1 << 20, 1 << 16
_ID_MASK = (1 << _ID_BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_kept: int = MAX_KEPT):
        self.ranks, self.max_kept = ranks, max_kept
        self.bytes_of = {v: k for k, v in ranks.items()}
        # a token that merging can't produce is only ever the whole of a piece
        # of the last merge into a token: its left and its right part, -1 for bytes
        self.lefts = dict.fromkeys(self.bytes_of, -1)
        self.rights = dict.fromkeys(self.bytes_of, -1)
        reachable = {t: k for t, k in ranks.items() if len(t) == 1 or self._merge(t, k) == [k]}
        self.lookahead = max(map(len, reachable), default=1)
        # the tokens' trie: nodes by parent and byte, the token that ends at each or -1, and whether it goes on
        self.below: dict[int, int] = {}
        self.ends, self.goes_on = array("q", [-1]), bytearray(1)
        for token, rank in reachable.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                below = self.below.get(key)
                if below is None:
                    self.goes_on[node] = 1
                    below = self.below[key] = len(self.ends)
                    self.ends.append(-1)
                    self.goes_on.append(0)
                node = below
            self.ends[node] = rank
        self.length = {v: len(k) for k, v in ranks.items()}
        self.lengths = np.zeros(max(self.length) + 1, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        self.depth = array("q", [0]) * len(self.ends)
        for key, node in self.below.items():  # parents come before their children
            self.depth[node] = self.depth[key >> 8] + 1
        self._reset()

    def _reset(self) -> None:
        """Empty tables. They refer to states by number, so nothing in them is a cycle and all is freed at once."""
        self._stable: dict[int, bool] = {}
        self._number: dict[tuple, int] = {}
        self._places: list[tuple] = []
        self._next: dict[int, int] = {}  # by state and byte: the next state, and the token that ends the text so far
        self._state((0,))

    def _state(self, places: tuple) -> int:
        found = self._number.get(places)
        if found is None:
            found = self._number[places] = len(self._places)
            self._places.append(places)
        return found

    def kept(self) -> int:
        return len(self._next) + len(self._stable) // 4

    def _merge(self, piece: bytes, note: int | None = None) -> list[int]:
        """Greedy merging by rank, which defines stability; the parts of the last merge into ``note`` are remembered."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = 1 << 60, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], 1 << 60)
                if rank < best:
                    best, at = rank, i
            if best == 1 << 60:
                break
            if best == note:
                self.lefts[note], self.rights[note] = ranks[parts[at]], ranks[parts[at + 1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge across their border comes before the merges that make them.

        Goes back in time through the parts that touch the border, undoing the later merge first; of equal merges
        the left one was made first.
        """
        x, y, until, known = a, b, 1 << 60, True
        ranks, text, lefts, rights = self.ranks, self.bytes_of, self.lefts, self.rights
        while True:
            merged = ranks.get(text[x] + text[y])
            if merged is not None and merged < until:
                known = False
                break
            left, right = rights[x], lefts[y]
            if left >= 0 and (x > y or right < 0):
                until, x = x, left
            elif right >= 0:
                until, y = y + 1, right
            else:
                break
        self._stable[a << 32 | b] = known
        return known

    def _step(self, key: int) -> int:
        """The table's entry for a state and a byte. A place of a state: where the bytes since lead in the trie, and the
        token before it, plus one."""
        state, byte = key >> 8, key & 255
        below, ends, known, goes_on = self.below, self.ends, self._stable, self.goes_on
        grown, end = [], -1
        for place in self._places[state]:
            node = below.get(place >> _ID_BITS << 8 | byte)
            if node is None:
                continue
            last, token = (place & _ID_MASK) - 1, ends[node]
            if token >= 0 and (last < 0 or (ok := known.get(last << 32 | token)) or ok is None and self.stable(last, token)):
                end = token
            if goes_on[node]:
                grown.append(node << _ID_BITS | last + 1)
        if end < 0:
            raise ValueError("the vocabulary lacks a byte or its merges contradict each other")
        grown.append(end + 1)
        found = self._next[key] = self._state(tuple(grown)) << _ID_BITS | end
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.kept() > self.max_kept:
            self._reset()
        if len(piece) > LONG:
            return list(chain.from_iterable(self._emitted(piece)))
        table, state, last = self._next, 0, []
        for byte in piece:
            found = table.get(state << 8 | byte)
            if found is None:
                found = self._step(state << 8 | byte)
            state = found >> _ID_BITS
            last.append(found & _ID_MASK)
        return self._back(last, len(last), 0)

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as the bytes of 32-bit integers."""
        out, held, size = [b""] * len(pieces), [], 0
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = array("i", [whole]).tobytes()
            elif len(piece) > WIDE:
                out[i] = array("i", self.encode(piece)).tobytes()
            else:
                held.append(i)
                size += len(piece)
                if size >= self.max_kept:  # so that the tables grow by this much at most before they can start again
                    self._together(pieces, held, out)
                    held, size = [], 0
        if held:
            self._together(pieces, held, out)
        return out

    def _together(self, pieces: list[bytes], rows: list[int], out: list[bytes]) -> None:
        """Reads a byte of each of these pieces at a time; the longest come first, so those that go on are the first ones."""
        if self.kept() > self.max_kept:
            self._reset()
        rows = sorted(rows, key=lambda i: len(pieces[i]), reverse=True)
        width = len(pieces[rows[0]])
        sizes = np.fromiter((len(pieces[i]) for i in rows), np.int64, len(rows))
        text = np.frombuffer(b"".join(pieces[i].ljust(width) for i in rows), np.uint8).reshape(-1, width)
        known, step = self._next.get, self._step
        state, last = np.zeros(len(rows), np.int64), np.zeros(text.shape, np.int32)
        for k in range(width):
            going = int(np.searchsorted(-sizes, -k))
            keys, which = np.unique(state[:going] << 8 | text[:going, k], return_inverse=True)
            found = np.array([known(key) or step(key) for key in keys.tolist()])[which]
            state[:going] = found >> _ID_BITS
            last[:going, k] = found & _ID_MASK
        # back from each piece's end: before each boundary lies the token that ended the text there
        ends, open_, at = np.zeros(text.shape, bool), np.arange(len(rows)), sizes
        while len(open_):
            ends[open_, at - 1] = True
            at = at - self.lengths[last[open_, at - 1]]
            open_, at = open_[at > 0], at[at > 0]
        ids = last[ends].tobytes()
        bounds = (4 * np.cumsum(ends.sum(1))).tolist()
        for i, a, b in zip(rows, [0, *bounds], bounds):
            out[i] = ids[a:b]

    def _back(self, last: list[int], at: int, until: int) -> list[int]:
        """The tokens between two boundaries: before each lies the token that ended the text there."""
        out, length = [], self.length
        while at > until:
            token = last[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def _emitted(self, piece: bytes) -> Iterator[list[int]]:
        """The tokens of a long piece as they are settled: from time to time the open places are followed back to the
        boundary where they meet, which no later byte can move, and what lies before it goes out."""
        state, last = 0, []
        for at in range(0, len(piece), LONG):
            for byte in piece[at : at + LONG]:
                found = self._next.get(state << 8 | byte)
                if found is None:
                    found = self._step(state << 8 | byte)
                state = found >> _ID_BITS
                last.append(found & _ID_MASK)
            if at + LONG < len(piece):
                ways = {len(last) - self.depth[p >> _ID_BITS] for p in self._places[state]}
                while len(ways) > 1:
                    far = max(ways)
                    ways.remove(far)
                    ways.add(far - self.length[last[far - 1]])
                met = ways.pop()
                yield self._back(last, met, 0)
                del last[:met]
                if self.kept() > self.max_kept:  # the open places go on under a new number
                    places = self._places[state]
                    self._reset()
                    state = self._state(places)
        yield self._back(last, len(last), 0)


class Utf8Stream:
    """An incremental UTF-8 decoder: text of complete characters now, the rest when its bytes come.

    The state is the pending bytes, how many more are due and the range of the next; bytes that can't continue a
    character give one U+FFFD for the part read, as the standard's maximal-subpart rule has it.
    """

    def __init__(self):
        self.pending, self.due, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, chunk: bytes) -> str:
        """Text of the characters that are complete now. Whole stretches of good bytes pass at once; the bytes of a
        character that began or goes on outside of the chunk, and stretches with bad bytes, one at a time."""
        head, at, end = "", 0, len(chunk)
        while self.due and at < end:
            head += self._step(chunk[at : at + 1])
            at += 1
        for k in range(1, min(3, end - at) + 1):
            b = chunk[end - k]
            if b >= 0xC0 and k < 2 + (b >= 0xE0) + (b >= 0xF0):
                end -= k
            if b >= 0xC0 or b < 0x80:
                break
        try:
            body = chunk[at:end].decode()
        except UnicodeDecodeError:
            return head + self._step(chunk[at:])
        return head + body + self._step(chunk[end:])

    def _step(self, chunk: bytes) -> str:
        out = []
        for b in chunk:
            if self.due:
                if self.low <= b <= self.high:
                    self.pending.append(b)
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(self.pending.decode())
                        self.pending.clear()
                    continue
                out.append(self._drop())
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.pending.append(b)
                self.due = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def _drop(self) -> str:
        self.pending.clear()
        self.due, self.low, self.high = 0, 0x80, 0xBF
        return "�"

    def end(self) -> str:
        return self._drop() if self.due else ""


#: Marks that are a piece of their own after letters.
_MARKS = frozenset(",.;:!?)")
#: White space that isn't one space, or one or two line ends before a word or one at the end, as RE2 writes it.
_ODD = (
    r" [ \n]| \z|\n\n\n|\n\n\z|\n |[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def joined(table: pa.LargeBinaryArray, ids: np.ndarray | list[int]) -> bytes:
    """The table's entries at ``ids``, one after another."""
    return table.take(pa.array(ids, pa.int32())).buffers()[2].to_pybytes() if len(ids) else b""


class Codec:
    """Texts to ids and back. Pieces are cut from words with the space or line's end before them, since a word's ids don't
    depend on its neighbours."""

    def __init__(self, path: str, max_kept: int = MAX_KEPT):
        import public_tokenizers
        import regex

        self.transducer = Transducer(load_ranks(path), max_kept)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces = self.pattern.findall
        self.max_kept = max_kept
        of = self.transducer.bytes_of
        self.bytes_of = pa.array([of.get(i, b"") for i in range(max(of) + 1)], pa.large_binary())
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cut(self, unit: str) -> list[str]:
        """Pieces of a word with the space before it, if any, or of a line's end with the word after it."""
        if unit[:1] == "\n":
            return ["\n", *self._cut(unit[1:])]
        # the common shapes need no pattern: a word of letters, alone or with one mark after it
        if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            return [unit]
        if unit[-1:] in _MARKS and unit[1:-1].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            return [unit[:-1], unit[-1:]]
        return self.pieces(unit)

    def _units(self, words: list[str]) -> list[bytes]:
        """Ids of words after a space or with a line's end."""
        if len(self.units) > self.max_kept // 2:
            self.units, self.older = {}, self.units
        units, older = self.units, self.older
        new = [w for w in words if w not in units]
        for i in range(0, len(new), self.max_kept):
            cut = {}
            for word in new[i : i + self.max_kept]:
                found = older.get(word)
                if found is None and len(word) > VERY_LONG:
                    units[word] = self._parts(word if word[:1] == "\n" else " " + word)
                elif found is None:
                    cut[word] = self._cut(word if word[:1] == "\n" else " " + word)
                else:
                    units[word] = found
            units.update(zip(cut, self._ids(cut.values()), strict=True))
        return list(map(units.__getitem__, words))

    def _ids(self, cut: Collection[list[str]]) -> Iterator[bytes]:
        pieces = list(dict.fromkeys(chain.from_iterable(cut)))
        ids = dict(zip(pieces, self.transducer.encode_all([p.encode() for p in pieces]), strict=True))
        return (ids[parts[0]] if len(parts) == 1 else b"".join(map(ids.__getitem__, parts)) for parts in cut)

    def _parts(self, text: str) -> bytes:
        found, out = self.pattern.finditer(text), []
        while part := [m[0] for m in islice(found, PART)]:
            out += self._ids([part])
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        encode = self.transducer.encode
        return list(chain.from_iterable(encode(p.encode("utf-8", "surrogatepass")) for p in self.pieces(text or "")))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """Ids of the texts, one text after another, and where the ids of each end.

        A space before a character that isn't white space always begins a piece and a single line's end is one, so texts
        are cut there; a text with other white space is taken whole.
        """
        column = pa.array([t or "" for t in texts], pa.large_string())
        odd = pc.match_substring_regex(column, _ODD)
        words = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", column), "\n", " \n"), " ")
        bounds, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
        # each text's first word has no space before it; a text taken whole stands in the first word's place
        firsts = words.values.take(words.offsets[:-1]).to_pylist()
        firsts = [t if o else f for t, o, f in zip(texts, odd.to_pylist(), firsts, strict=True)]
        short = self._ids([self.pieces(f) for f in firsts if len(f) <= VERY_LONG])
        units = self._units(coded.dictionary.to_pylist())
        units += [next(short) if len(f) <= VERY_LONG else self._parts(f) for f in firsts]
        which = coded.indices.to_numpy().astype(np.int64)
        which[bounds[:-1]] = np.arange(len(units) - len(texts), len(units))
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        lists = pa.LargeListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(sizes)))), pa.array(np.frombuffer(b"".join(units), np.int32))
        )
        ids = lists.take(pa.array(which)).flatten().to_numpy()
        return ids, np.cumsum(sizes[which])[bounds[1:] - 1].tolist()

    def decode_bytes(self, ids: np.ndarray | list[int]) -> bytes:
        return joined(self.bytes_of, ids)

    def stream(self, ids: np.ndarray | list[int], chunk: int = 4096) -> Iterator[str]:
        """The text of ``chunk`` tokens at a time; a character whose bytes two chunks share comes with the second."""
        stream = Utf8Stream()
        for i in range(0, len(ids), chunk):
            yield stream.feed(self.decode_bytes(ids[i : i + chunk]))
        yield stream.end()

    def decode(self, ids: np.ndarray | list[int], chunk: int = 4096) -> str:
        return "".join(self.stream(ids, chunk))


def codec(path: str, max_kept: int = MAX_KEPT) -> Codec:
    """A worker's codec, kept from task to task."""
    return kept(("codec", path, max_kept), lambda: Codec(path, max_kept))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


COLUMNS = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]


def round_trip(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """One row a document: its number of tokens and digests of its ids and of the bytes that they decode to.

    Null and empty texts have no tokens. The text is encoded whole, whatever its length. Repeated rows give repeated
    rows.
    """
    path = vocabulary_path or default_vocabulary()

    def make():
        c = codec(path)
        text_of = pa.array([f",{i}".encode() for i in range(len(c.bytes_of))], pa.large_binary())

        def fn(texts):
            n, ids_hash, bytes_hash = [], [], []
            every, ends = c.encode_all(texts)
            for start, end in zip([0, *ends], ends):
                ids = every[start:end]
                n.append(len(ids))
                written = hashlib.sha256(joined(text_of, ids[:PART])[1:])
                for i in range(PART, len(ids), PART):
                    written.update(joined(text_of, ids[i : i + PART]))
                ids_hash.append(written.hexdigest())
                decoded = hashlib.sha256()
                for part in c.stream(ids):
                    decoded.update(part.encode("utf-8"))
                bytes_hash.append(decoded.hexdigest())
            return n, ids_hash, bytes_hash

        return fn

    return map_texts(docs, make, COLUMNS)


def encode_ids(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and the array of ids."""
    path = vocabulary_path or default_vocabulary()

    def encode(texts):
        ids, ends = codec(path).encode_all(texts)
        return ([ids[a:b] for a, b in zip([0, *ends], ends)],)

    return map_texts(docs, lambda: encode, [("ids", pa.list_(pa.int32()), "array<int>")])


def decode_ids(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and the text of ``ids``."""
    path = vocabulary_path or default_vocabulary()

    def run(batches):
        for batch in batches:
            texts = [codec(path).decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
