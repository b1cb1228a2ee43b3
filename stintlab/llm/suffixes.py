"""Removal of long byte strings that an earlier document has, by two-stage suffix sorting.

Documents are dealt into buckets of a few hundred and a few megabytes. Every window of ``LENGTH`` bytes has an anchor,
the least hashed gram in it, so windows with equal bytes have equal anchors, and the stretch of a document's windows with
one anchor is a segment, of ``2 * LENGTH - GRAM`` bytes at most, or up to ``WIDEST`` windows where a text repeats itself.
Anchors that only one document has are ruled out
by a first exchange of hashes; the other segments meet by their anchors' hashes, each bucket sending a segment's
text once. There the distinct segments form one text, whose suffixes are sorted in two stages: only those smaller
than their successors are sorted directly, and scans over the first bytes' groups induce the others. Neighbours in
this order with ``LENGTH`` bytes in common have a window in common, and its least doc_id goes back to the buckets.

Within a bucket, repeats of a whole segment are found by equal text; everything else comes from the suffixes' order.
All that is sent for a hot line is a segment a bucket, and no task holds more than a bucket's texts or a range of
hashes. Null and empty texts have no bytes. Rows with a null doc_id are neither cut nor a source of cuts; rows
with the same doc_id don't cut each other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM, BUCKET_DOCS, BUCKET_BYTES = 50, 20, 256, 2 << 20
#: Bits of a hash that name a range at most: 16 million ranges, enough for a hundred terabytes.
MOST_BITS = 24
#: Windows of a segment at most, which bounds it where a text repeats itself.
WIDEST = 128
#: Bytes of segments that are sorted at once, about.
SORTED_BYTES = 1 << 20
#: Places of a chunk in the low bits of the order that anchors are chosen by.
_PLACE_BITS, _CHUNK = 22, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64)


def two_stage_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes' places in the order of their first ``depth`` bytes; ``text`` holds values from 0 to 256."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # smaller than its successor: the next different value is larger; the end counts as smallest
    change = np.flatnonzero(text[:-1] != text[1:])
    up = text[change] < text[change + 1]
    following = np.searchsorted(change, np.arange(n))
    small = np.concatenate((up, [False]))[following]
    order = _sorted_directly(text, np.flatnonzero(small), depth)
    first = text[order]
    cuts = np.searchsorted(first, np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    induced[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=257)).tolist():
        waves = induced[c]
        wave = np.concatenate(waves) if waves else np.empty(0, np.int64)
        own = [wave]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
            own.append(wave)
        own.append(order[cuts[c] : cuts[c + 1]])
        group = np.concatenate(own)
        out.append(group)
        before = group[group > 0] - 1
        value = text[before]
        larger = value > c
        before, value = before[larger], value[larger]
        turn = np.argsort(value, kind="stable")
        before, value = before[turn], value[turn]
        edges = np.flatnonzero(np.diff(value)) + 1
        for part, v in zip(np.split(before, edges), value[np.concatenate(([0], edges))].tolist() if len(value) else (), strict=False):
            induced[v].append(part)
        induced[c] = []
    return np.concatenate(out)


def _words(text: np.ndarray) -> np.ndarray:
    """Seven values from each place on as one number that sorts as they do."""
    padded = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(6, np.uint64)))
    out = np.zeros(len(text), np.uint64)
    for k in range(7):
        out = (out << np.uint64(9)) | padded[k : k + len(text)]
    return out


def _sorted_directly(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    words = np.concatenate((_words(text), np.zeros(depth + 7, np.uint64)))
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(order) else np.empty(0, bool)
    open_ = np.arange(len(order))
    group = np.cumsum(new)
    for at in range(7, depth, 7):
        alone = new & np.concatenate((new[1:], [True]))
        open_ = open_[~alone[open_]]
        if not len(open_):
            break
        key = words[order[open_] + at]
        turn = np.lexsort((key, group[open_]))
        order[open_], key = order[open_][turn], key[turn]
        own = group[open_]
        split = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        new[open_] |= split
        group = np.cumsum(new)
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Of each suffix in the order, how many bytes (up to ``most``) it has in common with the one before it."""
    out = np.zeros(len(order), np.int64)
    padded = np.concatenate((text, -1 - np.arange(most, dtype=np.int64)))
    alive = np.arange(1, len(order))
    for k in range(most):
        alive = alive[padded[order[alive] + k] == padded[order[alive - 1] + k]]
        if not len(alive):
            break
        out[alive] = k + 1
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h = _BYTES[data]
    size, power, kept = 1, _BASE, None
    while size < 16:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
        if size == GRAM - 16:
            kept, rest = h, power
    h = h[: -(GRAM - 16)] * np.uint64(rest) + kept[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: first and last window and the anchor's hash of each segment."""
    width = LENGTH - GRAM + 1
    found = ([], [], [])
    valid = np.ones(len(data), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[max(a, b - LENGTH + 1) : b] = False
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for at in range(0, len(data) - LENGTH + 1, _CHUNK):
        part = data[at : at + _CHUNK + LENGTH - 1]
        h = grams(part)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(h) - width + 1], least[width - size : width - size + len(h) - width + 1])
        anchor = h[(least & low).astype(np.int64)]
        ok = valid[at : at + len(anchor)]
        s = np.flatnonzero(ok)
        if not len(s):
            continue
        # one hash may lie at many places in a row, so a segment goes by it and not by the place
        cut = np.flatnonzero((np.diff(s) != 1) | (np.diff(anchor[s]) != 0))
        first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(s) - 1]))
        many = (last - first) // WIDEST + 1
        run = np.repeat(np.arange(len(first)), many)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        first, last = first[run] + nth * WIDEST, np.minimum(first[run] + (nth + 1) * WIDEST - 1, last[run])
        for held, new in zip(found, (s[first] + at, s[last] + at, anchor[s[first]]), strict=True):
            held.append(new)
    if not found[0]:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(map(np.concatenate, found))


class Bucket:
    """A bucket's texts in order of doc_id, and their segments; the same whenever it is made from the same rows."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table["doc_id"].combine_chunks()
        text = table["text"].combine_chunks().fill_null("").cast(pa.large_binary())
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        named = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.doc = self.ids.fill_null(0).to_numpy()
        self.first, self.last, self.hash = segments(self.data, self.offsets)
        self.row = np.searchsorted(self.offsets, self.first, side="right") - 1
        if not named.all():
            keep = named[self.row]
            self.first, self.last, self.hash, self.row = (x[keep] for x in (self.first, self.last, self.hash, self.row))
        self.owner = self.doc[self.row]

    def texts(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.first[which].tolist(), (self.last[which] + LENGTH).tolist(), strict=True)]


def _five(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of sorted values each with where it begins and ends."""
    edges = np.flatnonzero(np.diff(values)) + 1
    for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True):
        if z > a:
            yield int(values[a]), a, z


def _table(columns: dict[str, tuple]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def remove_repeats(docs: DataFrame, bucket_docs: int = BUCKET_DOCS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    buckets = max(1, math.ceil(size.n / bucket_docs), math.ceil(size.bytes / bucket_bytes))
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(2, buckets / 4)))))
    shift, five = np.uint64(64 - bits), np.uint64(24 - bits)
    mask = np.uint64((1 << 40) - 1)
    # rows of one id, or of none, go by their texts too, as any number of them may have it
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(buckets))).groupBy("bucket")

    def hashed(key: tuple, table: pa.Table) -> pa.Table:
        """The bucket's anchors by range of hashes, and which of them several documents here have."""
        b = Bucket(table)
        order = np.lexsort((b.owner, b.hash))
        h, owner = b.hash[order] >> five, b.owner[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
        start = np.flatnonzero(new)
        several = np.zeros(len(start), bool)
        if len(start):
            differs = np.concatenate(([False], (owner[1:] != owner[:-1]) & ~new[1:]))
            several = np.add.reduceat(differs, start) > 0
        h = h[start]
        own = [(p, _five(h[a:z] & mask), np.packbits(several[a:z]).tobytes()) for p, a, z in _runs((h >> np.uint64(40)).astype(np.int64))]
        p, keys, flags = zip(*own, strict=True) if own else ((), (), ())
        return _table({"part": (list(p), pa.int64()), "bucket": ([key[0].as_py()] * len(p), pa.int64()), "keys": (list(keys), pa.binary()), "flags": (list(flags), pa.binary())})

    def met(key: tuple, table: pa.Table) -> pa.Table:
        """Of a range's hashes, those of several documents, for each bucket."""
        sets = [_from_five(k) for k in table["keys"].to_pylist()]
        flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(s)) for f, s in zip(table["flags"].to_pylist(), sets, strict=True)])
        sizes = [len(s) for s in sets]
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[place[flags > 0]] = True
        hit = np.split(shared[place], np.cumsum(sizes)[:-1])
        out = [(b, _five(s[k])) for b, s, k in zip(table["bucket"].to_pylist(), sets, hit, strict=True) if k.any()]
        bucket, keys = zip(*out, strict=True) if out else ((), ())
        return _table({"bucket": (list(bucket), pa.int64()), "part": ([key[0].as_py()] * len(bucket), pa.int64()), "keys": (list(keys), pa.binary())})

    def sent(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The bucket's distinct segments with shared anchors: by range, the segment's number, least doc_id and text."""
        if not left.num_rows or not right.num_rows:
            return SENT.empty_table()
        b = Bucket(left)
        wanted = np.concatenate([_from_five(k) | np.uint64(p << 40) for p, k in zip(right["part"].to_pylist(), right["keys"].to_pylist(), strict=True)])
        wanted.sort()
        h = b.hash >> five
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        which = np.flatnonzero(wanted[at] == h)
        number: dict[bytes, int] = {}
        # rows go up by doc_id, so a text's first segment has its least one
        first = [i for i, t in zip(which.tolist(), b.texts(which), strict=True) if number.setdefault(t, i) == i]
        first = np.array(first, np.int64)
        first = first[np.argsort(b.hash[first] >> shift, kind="stable")]
        texts = b.texts(first)
        own = list(_runs((b.hash[first] >> shift).astype(np.int64)))
        return _table({
            "part": ([p for p, _, _ in own], pa.int64()), "bucket": ([key[0].as_py()] * len(own), pa.int64()),
            "numbers": ([first[a:z].astype("<u4").tobytes() for _, a, z in own], pa.binary()),
            "docs": ([b.owner[first[a:z]].astype("<i8").tobytes() for _, a, z in own], pa.binary()),
            "subs": ([(b.hash[first[a:z]] >> (shift - np.uint64(8))).astype(np.uint8).tobytes() for _, a, z in own], pa.binary()),
            "sizes": ([np.array([len(t) for t in texts[a:z]], np.uint8).tobytes() for _, a, z in own], pa.binary()),
            "texts": ([b"".join(texts[a:z]) for _, a, z in own], pa.binary()),
        })

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        """Suffix-sorts a range's distinct segments; where an earlier document has a window, says so to the bucket."""
        sizes = np.concatenate([np.frombuffer(x, np.uint8) for x in table["sizes"].to_pylist()]).astype(np.int64)
        counts = [len(x) for x in table["sizes"].to_pylist()]
        bucket = np.repeat(table["bucket"].to_numpy(), counts)
        owner, ids, sub = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("docs", "<i8"), ("numbers", "<u4"), ("subs", np.uint8)))
        raw, ends = b"".join(table["texts"].to_pylist()), np.cumsum(sizes)
        # equal anchors have equal further bits, so the range is sorted in parts of a bounded size
        turn = sub.astype(np.int64) * math.ceil(max(1, len(raw)) / SORTED_BYTES) >> 8
        out = []
        for k in np.unique(turn).tolist():
            which = np.flatnonzero(turn == k)
            number: dict[bytes, int] = {}
            place = np.fromiter((number.setdefault(raw[e - n : e], len(number)) for e, n in zip(ends[which].tolist(), sizes[which].tolist(), strict=True)), np.int64, len(which))
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, place, owner[which])
            low, starts, widths = window_minima(list(number), least)
            # runs of windows of a segment with the same least document
            segment = np.repeat(np.arange(len(number)), widths)
            offset = np.arange(len(low)) - np.repeat(starts, widths)
            edge = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (segment[1:] != segment[:-1]))))
            to = offset[np.append(edge[1:], len(low)) - 1]
            first_run = np.searchsorted(segment[edge], np.arange(len(number) + 1))
            many = first_run[place + 1] - first_run[place]
            own = np.repeat(which, many)
            runs = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first_run[place], many)
            earlier = low[edge[runs]] < owner[own]
            own, runs = own[earlier], runs[earlier]
            out.append((bucket[own], ids[own], offset[edge[runs]].astype(np.uint8), to[runs].astype(np.uint8), low[edge[runs]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        names, at = np.unique(columns[0], return_index=True)
        cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(order)][: len(at)], strict=True))
        packed = [[c[a:z].tobytes() for a, z in cuts] for c in columns[1:]]
        return _table({k: (v, t) for (k, t), v in zip(FOUND, [names.tolist(), *packed], strict=True)})

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return RESULT.empty_table()
        b = Bucket(left)
        told = {k: np.concatenate([np.frombuffer(x, t) for x in right[k].to_pylist()]) if right.num_rows else np.empty(0, t) for k, t in (("numbers", "<u4"), ("from", np.uint8), ("to", np.uint8), ("low", "<i8"))}
        covered = _covered(b, told["numbers"].astype(np.int64), told["from"], told["to"], told["low"])
        rise = covered & ~np.concatenate(([False], covered[:-1]))
        rise[b.offsets[:-1][b.offsets[:-1] < len(covered)]] |= covered[b.offsets[:-1][b.offsets[:-1] < len(covered)]]
        out = []
        removed, spans = np.concatenate(([0], np.cumsum(covered))), np.concatenate(([0], np.cumsum(rise)))
        for a, z in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
            gone = int(removed[z] - removed[a])
            kept = b.data[a:z][~covered[a:z]] if gone else b.data[a:z]
            out.append((z - a, gone, int(spans[z] - spans[a]), hashlib.sha256(kept.tobytes()).hexdigest()))
        n_bytes, gone, n_spans, kept = zip(*out, strict=True)
        return pa.table([b.ids, pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string())], schema=RESULT)

    shared = dealt.applyInArrow(hashed, "part long, bucket long, keys binary, flags binary")
    shared = shared.groupBy("part").applyInArrow(met, "bucket long, part long, keys binary")
    segs = dealt.cogroup(shared.groupBy("bucket")).applyInArrow(sent, "part long, bucket long, numbers binary, docs binary, subs binary, sizes binary, texts binary")
    found = segs.groupBy("part").applyInArrow(compared, "bucket long, numbers binary, `from` binary, `to` binary, low binary")
    return dealt.cogroup(found.groupBy("bucket")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SENT = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("numbers", pa.binary()), ("docs", pa.binary()), ("subs", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])
FOUND = [("bucket", pa.int64()), ("numbers", pa.binary()), ("from", pa.binary()), ("to", pa.binary()), ("low", pa.binary())]
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def window_minima(segs: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every segment, the least document that has it in any segment; and where each segment's
    windows begin and how many it has."""
    sizes = np.array([len(s) for s in segs], np.int64)
    text = np.frombuffer(b"\0".join(segs), np.uint8).astype(np.int16) + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    text[begin[1:] - 1] = 0
    widths = sizes - LENGTH + 1
    starts = np.cumsum(widths) - widths
    segment = np.full(len(text), -1)
    at = np.arange(widths.sum()) - np.repeat(starts, widths) + np.repeat(begin, widths)
    segment[at] = np.repeat(np.arange(len(segs)), widths)
    order = two_stage_order(text)
    order = order[segment[order] >= 0]  # a shorter suffix can't lie between two with a window in common
    group = np.cumsum(common_prefixes(text, order) < LENGTH) - 1
    low = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group, least[segment[order]])
    by_place = np.zeros(len(text), np.int64)
    by_place[order] = low[group]
    return by_place[at], starts, widths


def _covered(b: Bucket, numbers: np.ndarray, run_from: np.ndarray, run_to: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Bytes in windows that an earlier document has, here or elsewhere."""
    marks = np.zeros(len(b.data) + 1, np.int32)
    if len(b.hash):
        _, place, times = np.unique(b.hash, return_inverse=True, return_counts=True)
        told = np.zeros(len(times), bool)
        told[place[numbers]] = True
        which = np.flatnonzero((times > 1)[place] | told[place])
        order = np.argsort(numbers, kind="stable")
        cuts = numbers[order]
        first_of: dict[bytes, int] = {}
        for i, text in zip(which.tolist(), b.texts(which), strict=True):
            source = first_of.setdefault(text, i)
            start, doc = int(b.first[i]), int(b.owner[i])
            if b.owner[source] < doc:
                marks[start] += 1
                marks[int(b.last[i]) + LENGTH] -= 1
                continue
            a, z = np.searchsorted(cuts, source), np.searchsorted(cuts, source, side="right")
            for k in order[a:z].tolist():
                if low[k] < doc:
                    marks[start + int(run_from[k])] += 1
                    marks[start + int(run_to[k]) + LENGTH] -= 1
    return np.cumsum(marks[:-1]) > 0
