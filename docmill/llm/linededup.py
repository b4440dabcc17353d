"""Line dedup by an exact set-similarity join with prefix, positional and length filters.

1. Occurrences of tokens are counted in 2 ** SLOT_BITS hashed counters over all lines: a global order by rarity (the counter, then
   the token's hash). Any order common to all lines is exact; a rarer one makes shorter candidate lists.
2. Lines with the same token set are a class, held by its first line. Its tokens are sorted by that order; if two sets are
   similar, the shorter one's first n - ceil(2t / (1 + t) n) + 1 tokens and the longer one's first n - ceil(t n) + 1 share
   one. Tokens whose counter is 1 are in no other line and are left out.
3. Classes meet on those tokens (their hashes cut to 32 bits: a clash only adds candidates), dealt to buckets as arrays. Before a
   pair leaves a bucket it must pass the length filter, the positional filter (tokens
   left from the shared one on) and a parity filter: 128 parity bits of the tokens differ in no more places than the sets may.
4. A line goes if an earlier one has a similar or the same set. Each class meets the earlier one whose parity bits differ least
   from its own; they are compared by their whole sets. Only where that fails are the KEPT likeliest ones of each bucket compared, and
   where a bucket had more of them all that pass: the tokens of such lines alone are dealt out again, a
   bucket returns a spanning forest of its pairs, and the clusters that these join are compared in blocks, so that large
   groups of similar lines never give a row for every two.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import forest, in_blocks, overlaps
from .common import freed, likely_among, marked, written
from .components import connected_components

SLOT_BITS, RANGE_BITS = 23, 6
SALTS = 16
#: Sets above this size have two words of parity bits, by another bit of their tokens; the words' sum is that of smaller sets.
SPLIT = 64
#: Occurrences from which a token's rows are dealt among several tasks.
HOT = 1 << 17
#: Hashed places for the lines that are compared by their whole sets, and for tokens that are dealt out again; more of them only
#: mean that more lines are read again, and more tokens dealt out.
ID_BITS, TOKEN_BITS = 25, 24
#: Classes whose prefixes one bucket has, about, and lines that are compared as one block.
BUCKET, BLOCK = 12_000, 256
#: Candidates of a line that a bucket returns besides saying whether there are more.
KEPT = 8
#: Bits of the number of a text in the number of a line: an id that comes with several texts has lines of each.
TAG_BITS = 32


_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: By length: which of the first and of the second 8 bytes belong to a word.
_FIRST, _SECOND = (np.array([(1 << 8 * min(max(n - k, 0), 8)) - 1 for n in range(17)], np.uint64) for k in (0, 8))


def _joined(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts with a newline after each and 16 more bytes, the bytes before these, where newlines are, newlines before each text)."""
    raw = b"\n".join([t or b"" for t in texts]) + b"\n" + bytes(16)
    a = np.frombuffer(raw, np.uint8, len(raw) - 16)
    newline = np.flatnonzero(a == 10)
    first = np.cumsum([0, *[len(t or b"") + 1 for t in texts[:-1]]])
    return raw, a, newline, np.searchsorted(newline, first)


def tokens(texts: list[bytes | None]):
    """(hashes of all words, line of each, text and number of each line) of lines with words.

    A word's hash is a mix of its first 16 bytes, read 8 at a time, and its length; longer ones are hashed one by one."""
    import xxhash

    raw, a, newline, before = _joined(texts)
    space = _SPACES[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    low = np.concatenate([_LOWER[a], np.zeros(16, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(low[:8].view(np.uint64), (len(low) - 7,), (1,))
    n = end - start
    size = np.minimum(n, 16)
    h = (eights[start] & _FIRST[size]) * _BASE
    h ^= h >> np.uint64(32)
    h = (h ^ (eights[start + 8] & _SECOND[size])) * _MIX
    h ^= h >> np.uint64(29)
    h = (h + n.astype(np.uint64)) * _BASE
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(n > 16):
        h[k] = xxhash.xxh3_64_intdigest(low[start[k] : end[k]].tobytes())
    words = np.diff(np.r_[0, np.searchsorted(start, newline)])
    lines = np.flatnonzero(words)
    docs = np.searchsorted(before, lines, "right") - 1
    return h, np.repeat(np.arange(len(lines)), words[lines]), docs, (lines - before[docs]).astype(np.int32)


def _slots(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    h = (doc.view(np.uint64) * _BASE ^ line.view(np.uint64) * _MIX) * _BASE
    return ((h ^ (h >> np.uint64(31))) * _MIX >> np.uint64(64 - ID_BITS)).astype(np.int64)


def _batches(batches, column: int, size: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part, part.column(column).cast("binary").to_pylist()


COUNTS = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("salt", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def rarity(docs: DataFrame, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """Counters of all tokens of (doc_id, text): 2 ** slot_bits numbers, whatever the corpus."""
    width = 1 << (slot_bits - RANGE_BITS)

    def count(batches):
        import pyarrow as pa

        total = np.zeros(1 << slot_bits, np.uint32)
        salt = 0
        for _, texts in _batches(batches, 1):
            h = tokens(texts)[0]
            salt ^= int(h[0] >> np.uint64(7)) if len(h) else 0
            np.add.at(total, (h >> np.uint64(64 - slot_bits)).astype(np.int64), np.uint32(1))
        for r in range(1 << RANGE_BITS):
            part = total[r * width : (r + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                data = _sparse(at, part[at]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([salt % SALTS], pa.int32()), pa.array([data], pa.binary())], names=COUNTS.names)

    def merge(t):
        import pyarrow as pa

        out = np.zeros(width, np.uint64)
        for x in t.column("counts").to_pylist():
            _add(out, x)
        at = np.flatnonzero(out)
        data = _sparse(at, np.minimum(out[at], 0xFFFFFFFF)).tobytes()
        return pa.table({"range": t.column("range")[:1].cast(pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([data], pa.binary())})

    parts = docs.mapInArrow(count, COUNTS).groupBy("range", "salt").applyInArrow(merge, COUNTS).groupBy("range").applyInArrow(merge, COUNTS)
    out = np.zeros(1 << slot_bits, np.uint32)
    for r in written(parts, "rarity").toLocalIterator():
        _add(out[r.range * width : (r.range + 1) * width], r.counts)
    return out


_MOST = (1 << 15) - 1


def _sparse(at: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Places (below 2 ** 17) and numbers in 32 bits each; a number above _MOST is several."""
    again = (times // _MOST).astype(np.int64)
    big = np.repeat(at, again).astype(np.uint32) << np.uint32(15) | np.uint32(_MOST)
    return np.r_[at.astype(np.uint32) << np.uint32(15) | (times % _MOST).astype(np.uint32), big]


def _add(out: np.ndarray, data: bytes) -> None:
    x = np.frombuffer(data, np.uint32)
    np.add.at(out, x >> np.uint32(15), (x & np.uint32(_MOST)).astype(out.dtype))


#: prefix: the upper halves of the tokens' hashes, places: theirs in the order, both as bytes.
LINES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("line", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("class", T.BinaryType()),
    T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("prefix", T.BinaryType()), T.StructField("places", T.BinaryType()),
])


def sorted_sets(h: np.ndarray, line: np.ndarray, counts: np.ndarray):
    """Distinct tokens of each line in the global order: (tokens, counters, line of each).

    The order is by eighths of the counter's logarithm, then by the token's hash."""
    c = counts[(h >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)]
    rare = _RARITY[np.minimum(c, 255)]
    many = np.flatnonzero(c > 255)
    rare[many] = (np.log2(c[many]) * 8).astype(np.uint64)
    bits = int(line[-1]).bit_length()
    key = line.astype(np.uint64) << np.uint64(64 - bits) | rare << np.uint64(55 - bits) | h >> np.uint64(9 + bits) if bits else rare << np.uint64(55) | h >> np.uint64(9)
    order = np.argsort(key)
    a, b = key[order], h[order]
    same = a[1:] == a[:-1]
    if (b[1:][same] != b[:-1][same]).any():
        order = np.lexsort((h, rare, line))
    h, c, line = h[order], c[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return h[new], c[new], line[new]


_RARITY = (np.log2(np.maximum(np.arange(256), 1)) * 8).astype(np.uint64)


def _packed(values: np.ndarray, offsets: np.ndarray):
    """Bytes of runs of values, as an Arrow array."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many of each row) of such an array."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None and len(column) else np.zeros(0, kind)
    return values, np.diff(ends) // np.dtype(kind).itemsize


def _numbered(tags, docs_: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (numbers.astype(np.int64) << TAG_BITS) | tags.to_numpy(zero_copy_only=False)[docs_]


def described(docs: DataFrame, counts, percent: int) -> DataFrame:
    """A row (LINES) for every line with words of (doc_id, text, tag)."""

    def run(batches):
        import pyarrow as pa

        table = counts.value
        for part, texts in _batches(batches, 1):
            h, line, docs_, numbers = tokens(texts)
            if not len(h):
                continue
            h, c, line = sorted_sets(h, line, table)
            first = np.searchsorted(line, np.arange(len(numbers)))
            n = np.diff(np.r_[first, len(h)])
            data, ends = h.tobytes(), (first + n) * 8
            classes = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip((first * 8).tolist(), ends.tolist(), strict=True)]
            bit = np.uint64(1) << (h & np.uint64(63))
            high = (h >> np.uint64(6) & np.uint64(1)).astype(bool) & (n > SPLIT)[line]
            s1, s2 = (np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), first).view(np.int64) for x in (~high, high))
            place = np.arange(len(h)) - first[line]
            prefix = n - -(-percent * n // 100) + 1
            keep = (place < prefix[line]) & (c > 1)
            offsets = np.r_[0, np.cumsum(np.bincount(line[keep], minlength=len(n)))]
            ids, numbers = part.column(0).take(pa.array(docs_)), _numbered(part.column(2), docs_, numbers)
            lists = [_packed(x, offsets) for x in ((h[keep] >> np.uint64(32)).astype(np.uint32), place[keep].astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers), pa.array(n.astype(np.int32)), pa.array(classes, pa.binary()), pa.array(s1), pa.array(s2), *lists], names=LINES.names)

    return docs.mapInArrow(run, LINES)


_FIELDS = (("key", np.uint32), ("doc", np.int64), ("line", np.int64), ("n", np.int32), ("place", np.int32), ("role", np.uint8), ("s1", np.uint64), ("s2", np.uint64))
_INDEX, _PROBE, _ASKED = 1, 2, 4
PAIRS = T.StructType([T.StructField(x, k) for x, k in (("doc_a", T.LongType()), ("line_a", T.LongType()), ("doc_b", T.LongType()), ("line_b", T.LongType()))])
#: The best candidate a of b in a bucket, the best ones (doc and line of each) and whether there are more.
FAR = T.StructType([*PAIRS.fields, T.StructField("far", T.FloatType()), T.StructField("best", T.BinaryType()), T.StructField("more", T.BooleanType())])
BLOBS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("data", T.BinaryType())])


def _scattered(classes: DataFrame, counts, percent: int, buckets: int, hot_from: int, only=None) -> DataFrame:
    """Prefix tokens of classes by bucket, as arrays; with `only`, a bitmap of tokens, those that it may hold. Probing rows of a token above `hot_from` occurrences are copied to parts among which
    its index rows are dealt, so no task has all of them."""

    def run(batches):
        import pyarrow as pa

        table = counts.value
        bits = len(table).bit_length() - 1
        held, rows = [], 0

        def out():
            cols = {f: np.concatenate([h[f] for h in held]) for f, _ in _FIELDS}
            where = ((cols["key"].astype(np.uint64) * _BASE) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[order], np.arange(buckets + 1))
            cols = {f: c[order] for f, c in cols.items()}
            some = np.flatnonzero(np.diff(ends))
            data = [b"".join(cols[f][ends[b] : ends[b + 1]].tobytes() for f, _ in _FIELDS) for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.diff(ends)[some]), pa.array(data, pa.binary())], names=BLOBS.names)

        for batch in batches:
            get = lambda k: batch.column(k).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            token, times = _unpacked(batch.column(5), np.uint32)
            place = _unpacked(batch.column(6), np.uint32)[0].astype(np.int64)
            of = np.repeat(np.arange(batch.num_rows), times)
            doc, line, n, s1, s2 = (get(k)[of] for k in range(5))
            if only is not None:
                wanted = np.flatnonzero(_has(only.value, token >> np.uint32(32 - TOKEN_BITS)))
                of, doc, line, n, s1, s2, token, place = (x[wanted] for x in (of, doc, line, n, s1, s2, token, place))
            index = place < n - -(-2 * percent * n // (100 + percent)) + 1
            parts = 1 + table[(token >> np.uint32(32 - bits)).astype(np.int64)].astype(np.int64) // hot_from
            asked = np.where(get(7), _ASKED, 0)[of].astype(np.uint8)
            role = np.where(index, _INDEX | _PROBE, _PROBE).astype(np.uint8) | asked
            cols = {"key": token, "doc": doc, "line": line, "n": n, "place": place, "role": role, "s1": s1.view(np.uint64), "s2": s2.view(np.uint64)}
            hot = parts > 1
            if hot.any():
                at = np.flatnonzero(hot)
                mixed = lambda key, part: ((key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + part.astype(np.uint64) * _BASE) >> np.uint64(32)).astype(np.uint32)
                probe = np.repeat(at, parts[at])
                part = np.arange(len(probe)) - np.repeat(np.cumsum(parts[at]) - parts[at], parts[at])
                own = at[index[at]]
                mine = ((doc[own].view(np.uint64) * _BASE + line[own].view(np.uint64)) >> np.uint64(20)).astype(np.int64) % parts[own]
                cold = {f: c[~hot] for f, c in cols.items()}
                a = {f: c[probe] for f, c in cols.items()} | {"key": mixed(token[probe], part), "role": asked[probe] | np.uint8(_PROBE)}
                b = {f: c[own] for f, c in cols.items()} | {"key": mixed(token[own], mine), "role": asked[own] | np.uint8(_INDEX)}
                cols = {f: np.concatenate([cold[f], a[f], b[f]]) for f in cols}
            held.append({f: cols[f].astype(kind, copy=False) for f, kind in _FIELDS})
            rows += len(held[-1]["key"])
            if rows >= 1 << 19:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return classes.select("doc", "line", "n", "s1", "s2", "prefix", "places", "asked").mapInArrow(run, BLOBS)


def met(cols: dict[str, np.ndarray], percent: int, at_once: int = 1 << 20):
    """Positions (earlier, later) of rows with the same key that pass all filters, the later one being asked for, and how far their
    parity bits differ as a share of what may."""
    order = np.argsort(cols["key"], kind="stable")
    c = {f: x[order] for f, x in cols.items()}
    first = np.flatnonzero(np.r_[True, c["key"][1:] != c["key"][:-1]])
    last = np.r_[first[1:], len(order)]
    group = np.repeat(np.arange(len(first)), last - first)
    index = np.flatnonzero((c["role"] & _INDEX != 0) & (last - first > 1)[group])
    lows, sizes = first[group[index]], (last - first)[group[index]]
    ends = np.cumsum(sizes)
    k = 0
    while k < len(index):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + at_once, "right")))
        # A group above at_once is taken in slices of its probing rows.
        for shift in range(0, int(sizes[k]) if to == k + 1 else 1, at_once):
            size = np.minimum(sizes[k:to] - shift, at_once) if to == k + 1 else sizes[k:to]
            a = np.repeat(index[k:to], size)
            b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lows[k:to] + shift, size)
            na, nb = c["n"][a].astype(np.int64), c["n"][b].astype(np.int64)
            same = na == nb
            ok = (na < nb) | same & ((c["doc"][a] < c["doc"][b]) | (c["doc"][a] == c["doc"][b]) & (c["line"][a] < c["line"][b]))
            ok &= (na * 100 >= nb * percent) & (c["role"][b] & _PROBE != 0)
            a, b, na, nb = a[ok], b[ok], na[ok], nb[ok]
            both = na + nb
            one, two = c["s1"][a] ^ c["s1"][b], c["s2"][a] ^ c["s2"][b]
            before = (c["doc"][a] < c["doc"][b]) | (c["doc"][a] == c["doc"][b]) & (c["line"][a] < c["line"][b])
            differ = np.where((na > SPLIT) & (nb > SPLIT), np.bitwise_count(one).astype(np.int64) + np.bitwise_count(two), np.bitwise_count(one ^ two))
            ok = (differ * (100 + percent) <= both * (100 - percent)) & (c["role"][np.where(before, b, a)] & _ASKED != 0)
            a, b, na, nb, both, differ, before = a[ok], b[ok], na[ok], nb[ok], both[ok], differ[ok], before[ok]
            i, j = c["place"][a].astype(np.int64), c["place"][b].astype(np.int64)
            ok = (i + j) * (100 + percent) <= both * (100 - percent)  # of the first token that is shared
            ok &= (np.minimum(i, j) + 1 + np.minimum(na - i - 1, nb - j - 1)) * (100 + percent) >= both * percent
            a, b, before = a[ok], b[ok], before[ok]
            yield order[np.where(before, a, b)], order[np.where(before, b, a)], (differ[ok] / both[ok]).astype(np.float32)
        k = to


def likeliest(rows: np.ndarray, kept: int) -> np.ndarray:
    """Of rows (doc_b, line_b, far, doc_a, line_a, more) each pair once and the `kept` best of each b, `more` where it has others."""
    rows = rows[np.lexsort((rows["line_a"], rows["doc_a"], rows["far"], rows["line_b"], rows["doc_b"]))]
    same = (rows["doc_b"][1:] == rows["doc_b"][:-1]) & (rows["line_b"][1:] == rows["line_b"][:-1])
    new = np.r_[True, ~same]
    twice = np.r_[False, same & (rows["doc_a"][1:] == rows["doc_a"][:-1]) & (rows["line_a"][1:] == rows["line_a"][:-1])]
    group = np.cumsum(new) - 1
    more = np.bincount(group, rows["more"] & new) > 0  # of groups that were cut before
    rows, group = rows[~twice], group[~twice]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(len(rows)) - first[group]
    more |= np.bincount(group) > kept
    rows["more"] = more[group]
    return rows[place < kept]


def _met(classes: DataFrame, counts, percent: int, hot_from: int, only, gives, schema: T.StructType) -> DataFrame:
    """What `gives` makes of each bucket's arrays."""
    buckets = max(8, min(1 << 30, classes.count() // BUCKET))

    def join(t):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        cols = {f: [] for f, _ in _FIELDS}
        for n, data in zip(t.column("rows").to_pylist(), t.column("data").to_pylist(), strict=True):
            at = 0
            for f, kind in _FIELDS:
                size = n * np.dtype(kind).itemsize
                cols[f].append(np.frombuffer(data, kind, n, at))
                at += size
        found = gives({f: np.concatenate(x) for f, x in cols.items()}) or [[]] * len(schema)
        want = to_arrow_schema(schema)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(found, want, strict=True)], schema=want)

    return _scattered(classes, counts, percent, buckets, hot_from, only).groupBy("bucket").applyInArrow(join, schema)


def candidates(classes: DataFrame, counts, percent: int, hot_from: int = HOT, kept: int = KEPT) -> DataFrame:
    """For classes b of (doc, line, n, s1, s2, prefix, places) that have a candidate a, one before them that passes all filters:
    (doc_a, line_a, doc_b, line_b) of the a whose parity bits differ least, `best` (bytes with doc, line and difference of those
    next to it, per bucket) and `more` (whether a bucket had others)."""

    def gives(cols):
        held: list[np.ndarray] = []
        for a, b, far in met(cols, percent):
            if len(a):
                rows = np.rec.fromarrays([cols["doc"][b], cols["line"][b], far, cols["doc"][a], cols["line"][a], np.zeros(len(a), bool)], names="doc_b,line_b,far,doc_a,line_a,more")
                held.append(likeliest(rows, kept))
                if len(held) > 16:
                    held = [likeliest(np.concatenate(held), kept)]
        if not held:
            return None
        rows = likeliest(np.concatenate(held), kept)
        first = np.flatnonzero(np.r_[True, (rows["doc_b"][1:] != rows["doc_b"][:-1]) | (rows["line_b"][1:] != rows["line_b"][:-1])])
        data, ends = np.stack([rows["doc_a"], rows["line_a"], rows["far"].astype(np.float64).view(np.int64)], 1).tobytes(), np.r_[first[1:], len(rows)]
        best = [data[a * 24 : b * 24] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        return [rows[x][first] for x in (*PAIRS.names, "far")] + [best, rows["more"][first]]

    found = _met(classes.withColumn("asked", F.lit(True)), counts, percent, hot_from, None, gives, FAR)
    found = found.groupBy("doc_b", "line_b").agg(F.min(F.struct("far", "doc_a", "line_a")).alias("a"), F.collect_list("best").alias("best"), F.bool_or("more").alias("more"))
    return found.select("a.doc_a", "a.line_a", "doc_b", "line_b", "best", "more")


NEXT = T.StructType([*PAIRS.fields, T.StructField("more", T.BooleanType())])


def others(found: DataFrame, kept: int = KEPT) -> DataFrame:
    """Pairs of each b of candidates() with the `kept` likeliest candidates after the best one; `more`: there are further ones. A b
    without any has one row without an a."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = []
            for doc_a, line_a, doc_b, line_b, lists, more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                all_ = {(far, doc, line) for x in lists for doc, line, far in zip(*(np.frombuffer(x, kind)[k::3].tolist() for k, kind in enumerate((np.int64, np.int64, np.float64))), strict=True)}
                next_ = sorted(x for x in all_ if x[1:] != (doc_a, line_a))
                more = more or len(next_) > kept
                rows += [(doc, line, doc_b, line_b, more) for _, doc, line in next_[:kept]] or [(None, None, doc_b, line_b, more)]
            want = to_arrow_schema(NEXT)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(want)], schema=want)

    return found.select(*PAIRS.names, "best", "more").mapInArrow(run, NEXT)


def joined_pairs(classes: DataFrame, counts, percent: int, hot_from: int = HOT, only=None) -> DataFrame:
    """Some pairs (doc_a, line_a, doc_b, line_b) of classes, with `asked`, that join all those which pass all filters, the later one
    of them being asked for."""

    def gives(cols):
        order = np.lexsort((cols["line"], cols["doc"]))
        doc, line = cols["doc"][order], cols["line"][order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        doc, line, root = doc[new], line[new], None
        for a, b, _ in met(cols, percent):
            root = forest(len(doc), node[a], node[b], root)
        if root is None:
            return None
        x = np.flatnonzero(root != np.arange(len(root)))
        return [doc[root[x]], line[root[x]], doc[x], line[x]]

    return _met(classes, counts, percent, hot_from, only, gives, PAIRS)


def _bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits places from a column `s` of their numbers."""
    # Spark numbers buckets from 1 only for positions from 1; 0 has a bucket of its own.
    s = F.col("s") + F.lit(1)
    rows = places.groupBy(F.bitmap_bucket_number(s).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(s)).alias("bits"))
    found = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.toLocalIterator():
        found[(r.b - 1) * 4096 : r.b * 4096] |= np.frombuffer(r.bits, np.uint8)
    return found


def _has(bitmap: np.ndarray, s: np.ndarray) -> np.ndarray:
    s = s.astype(np.int64)
    return (bitmap[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)


def _reread(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, line, set) of the given (doc, line). Texts of other documents are skipped where they are read, their other lines by a
    bitmap of hashed numbers whose size is fixed."""
    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))))], names=["s"])

    lines = written(lines.distinct(), "asked")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(lines.mapInArrow(hashed, "s long"), ID_BITS))
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("line", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for part, texts in ((p, t) for b in batches for p, t in _batches([b], 1)):
            raw, _, newline, before = _joined(texts)
            of = np.searchsorted(before, np.arange(len(newline)), "right") - 1
            ids = part.column(0).to_numpy(zero_copy_only=False)[of]
            numbers = _numbered(part.column(2), of, np.arange(len(newline)) - before[of])
            keep = np.flatnonzero(_has(sent.value, _slots(ids, numbers)))
            starts = np.r_[0, newline[:-1] + 1]
            h, line, at, _ = tokens([raw[a:b] for a, b in zip(starts[keep].tolist(), newline[keep].tolist(), strict=True)])
            if len(h):
                order = np.lexsort((h, line))
                h, line = h[order], line[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
                h, line = h[new], line[new]
                first = np.searchsorted(line, np.arange(len(at) + 1)) * 8
                data = h.tobytes()
                sets = [data[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep[at]]), pa.array(numbers[keep[at]]), pa.array(sets, pa.binary())], names=schema.names)

    some = likely_among(docs, F.col("doc_id"), written(lines.select("doc").distinct(), "askeddocs"))
    return some.select("doc_id", "text", "tag").mapInArrow(run, schema).join(lines, ["doc", "line"], "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets have 100 * intersection >= percent * union."""
    a, b = (pairs.select(F.col(f"doc_{x}").alias("doc"), F.col(f"line_{x}").alias("line")) for x in "ab")
    sets = written(_reread(docs, a.unionByName(b)), "linesets")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(PAIRS.names)

    named = lambda x: sets.select(F.col("doc").alias(f"doc_{x}"), F.col("line").alias(f"line_{x}"), F.col("set").alias(f"set_{x}"))
    both = pairs.join(named("a"), ["doc_a", "line_a"]).join(named("b"), ["doc_b", "line_b"])
    return both.select(*PAIRS.names, "set_a", "set_b").mapInArrow(run, PAIRS)


GONE = T.StructType([T.StructField("doc", T.LongType()), T.StructField("line", T.LongType())])


def like_earlier(sets: list[np.ndarray], place: np.ndarray, asked: np.ndarray, blocks: np.ndarray, percent: int) -> np.ndarray:
    """Which of the asked sets are similar to one that comes before them by `place`; of two blocks, only sets of different ones meet."""
    rows = np.flatnonzero(asked)
    if len(sets) < 2 or not len(rows):
        return rows[:0]
    sizes = np.array([len(x) for x in sets], np.int64)
    both = overlaps(sets, rows)
    ok = (100 * both >= percent * (sizes[rows][:, None] + sizes[None] - both)) & (place[None] < place[rows][:, None])
    if blocks.min() != blocks.max():
        ok &= blocks[None] != blocks[rows][:, None]
    return rows[ok.any(axis=1)]


def _gone_in_blocks(docs: DataFrame, clusters: DataFrame, asked: DataFrame, percent: int, block: int) -> DataFrame:
    """(doc, line) of asked lines that have an earlier similar one in their cluster; clusters: (node of doc and line, cluster)."""
    tasks = in_blocks(clusters, block).select(F.col("node.doc").alias("doc"), F.col("node.line").alias("line"), F.xxhash64("cluster").alias("c"), F.col("cluster.doc").alias("cd"), F.col("cluster.line").alias("cl"), "i", "j", "block")
    lines = clusters.select("node.doc", "node.line")
    sets = _reread(docs, lines).join(asked.withColumn("asked", F.lit(True)), ["doc", "line"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    members = tasks.join(sets, ["doc", "line"]).select("cd", "cl", "i", "j", "block", "doc", "line", "asked", "set")

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def found():
            if not held:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], names=GONE.names)
            block, doc, line, wanted, sets = zip(*held, strict=True)
            place = np.empty(len(doc), np.int64)
            place[np.lexsort((line, doc))] = np.arange(len(doc))
            at = like_earlier([np.frombuffer(x, np.uint64) for x in sets], place, np.array(wanted), np.array(block), percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for k in at], pa.int64()) for x in (doc, line)], names=GONE.names)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for new, row in zip(zip(*cols[:4], strict=True), zip(*cols[4:], strict=True), strict=True):
                if new != key:
                    yield found()
                    key, held = new, []
                held.append(row)
        yield found()

    task = ["cd", "cl", "i", "j"]
    return members.repartition(*task).sortWithinPartitions(*task).mapInArrow(run, GONE).distinct()


def _token_places(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array((_unpacked(batch.column(0), np.uint32)[0] >> np.uint32(32 - TOKEN_BITS)).astype(np.int64))], names=["s"])


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, tag) of rows with an id, equal rows once: tag is 0, but for ids that come more than once one more than a number
    from 31 bits of a hash of the text."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    several = written(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")
    if several.isEmpty():
        return own.withColumn("tag", F.lit(0).cast("long"))
    told = marked(own, F.col("doc_id"), several, "again")
    hit = told.where("again").join(several.withColumn("known", F.lit(True)), "doc_id", "left").withColumn("tag", F.when(F.col("known"), _tag(F.col("text"))).otherwise(F.lit(0)).cast("long"))
    return told.where("NOT again").select("doc_id", "text", F.lit(0).cast("long").alias("tag")).unionByName(written(hit.select("doc_id", "text", "tag").dropDuplicates(["doc_id", "tag"]), "tagged"))


def _tag(text) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit((1 << 31) - 1)) + F.lit(1)


def line_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = SLOT_BITS, hot_from: int = HOT, block: int = BLOCK, kept: int = KEPT) -> DataFrame:
    """Per line with words: doc_id, tag, line (from 0), first_doc and first_line (the first line with the same token set), kept.

    Lines are the parts of a text between newlines; tokens are words without ASCII white space, A-Z lowered. A line is kept unless
    an earlier one, by doc_id, line and tag, has a similar set (100 * intersection >= percent * union). Null texts have no lines;
    rows with a null id are left out; rows that repeat an id with the same text are one document; an id that comes with several
    texts has the lines of each, told apart by their tags (tagged())."""
    lines, several, gone = _found(tagged(docs, id_col, text_col), percent, slot_bits, hot_from, block, kept)
    known = gone.select(F.col("doc").alias("doc_id"), "line", F.lit(True).alias("like"))
    firsts = several.select("class", F.col("doc").alias("first_doc"), F.col("line").alias("first_line"))
    out = lines.select("doc_id", "line", "class").join(firsts, "class", "left").join(known, ["doc_id", "line"], "left")
    first = F.col("first_doc").isNull() | ((F.col("first_doc") == F.col("doc_id")) & (F.col("first_line") == F.col("line")))
    number = lambda c: F.shiftright(c, TAG_BITS).cast("int")
    return out.select("doc_id", _tag_of("line"), number("line").alias("line"), F.coalesce("first_doc", "doc_id").alias("first_doc"), number(F.coalesce("first_line", "line")).alias("first_line"), (first & F.col("like").isNull()).alias("kept"))


def _tag_of(line: str) -> Column:
    return F.col(line).bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("tag")


def _found(own: DataFrame, percent: int, slot_bits: int, hot_from: int, block: int, kept: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, several, gone): all lines with their classes; the first line of each class that may have more; and those
    first lines of classes, as (doc, line), that are similar to an earlier one."""
    spark = own.sparkSession
    counts = spark.sparkContext.broadcast(rarity(own, slot_bits))
    lines = written(described(own, counts, percent), "lines")
    # Most lines have a set of their own and are classes as they are; only others meet.
    again = lines.groupBy(F.xxhash64("class").alias("x")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x")
    lines = marked(lines, F.xxhash64("class"), written(again, "again"), "again", often=True)
    cols = ["doc", "line", "n", "s1", "s2", "prefix", "places"]
    held = F.min(F.struct("doc_id", "line", "n", "s1", "s2", "prefix", "places")).alias("f")
    several = written(lines.where("again").groupBy("class").agg(held).select("class", F.col("f.doc_id").alias("doc"), *[f"f.{c}" for c in cols[1:]]), "classes")
    classes = lines.where("NOT again").withColumnRenamed("doc_id", "doc").select(*cols).unionByName(several.select(*cols))
    freed(spark)
    # One good earlier line is enough: each class is first held against the one that looks most like it.
    first = written(candidates(classes, counts, percent, hot_from, kept), "pairs")
    freed(spark)
    gone_of = lambda pairs: written(verified(own, pairs, percent), "goodlines").select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line"))
    without = lambda rows, gone: rows.join(gone.withColumnsRenamed({"doc": "doc_b", "line": "line_b"}), ["doc_b", "line_b"], "left_anti")
    good = gone_of(first)
    rest = written(others(without(first, good), kept), "others")
    pairs = rest.where("doc_a IS NOT NULL").select(*PAIRS.names)
    if not pairs.isEmpty():
        also = gone_of(pairs)
        good, rest = good.unionByName(also), without(rest, also)
    left = written(rest.where("more").select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line")).distinct(), "leftlines")
    if not left.isEmpty():
        freed(spark)
        # Their classes come once more, asked for; a line is not before itself.
        asked = likely_among(classes, F.xxhash64("doc", "line"), written(left.select(F.xxhash64("doc", "line").alias("x")), "asked"))
        asked = written(asked.join(left, ["doc", "line"], "left_semi").withColumn("asked", F.lit(True)), "askedlines")
        only = spark.sparkContext.broadcast(_bitmap(asked.select("prefix").mapInArrow(_token_places, "s long"), TOKEN_BITS))
        pairs = written(joined_pairs(classes.withColumn("asked", F.lit(False)).unionByName(asked), counts, percent, hot_from, only), "pairs")
        node = lambda x: F.struct(F.col(f"doc_{x}").alias("doc"), F.col(f"line_{x}").alias("line"))
        roots = connected_components(pairs.select(node("a").alias("u"), node("b").alias("v")))
        clusters = roots.select("node", F.col("root").alias("cluster"))
        clusters = written(clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster").distinct()), "clusters")
        good = good.unionByName(_gone_in_blocks(own, clusters, left, percent, block))
    return lines, several, written(good.distinct(), "gone")


def line_dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = SLOT_BITS, hot_from: int = HOT, block: int = BLOCK, kept: int = KEPT) -> DataFrame:
    """Per document: doc_id, n_lines (with words), n_removed, removed (numbers of its lines that go, from 0), tag.

    An id is one document, or if it comes with several texts one for each text, told apart by tag (else 0, or the one text's); documents
    without lines have zeros and an empty list; an id that is null is a row of its own with its lines counted and none
    removed. An empty table gives an empty result."""
    own = tagged(docs, id_col, text_col)
    lines, several, gone = _found(own, percent, slot_bits, hot_from, block, kept)
    n_lines = lines.groupBy("doc_id", _tag_of("line")).agg(F.count(F.lit(1)).alias("n_lines"))
    # Lines that go: the first of a class if it is like an earlier one, and all others of a class.
    firsts = several.select("class", F.col("doc").alias("first_doc"), F.col("line").alias("first_line"))
    others = lines.where("again").select("doc_id", "line", "class").join(firsts, "class").where("doc_id <> first_doc OR line <> first_line")
    goes = gone.select(F.col("doc").alias("doc_id"), "line").unionByName(others.select("doc_id", "line"))
    removed = goes.groupBy("doc_id", _tag_of("line")).agg(F.sort_array(F.collect_list(F.shiftright("line", TAG_BITS).cast("int"))).alias("removed"))
    out = own.select("doc_id", "tag").join(n_lines, ["doc_id", "tag"], "left").join(removed, ["doc_id", "tag"], "left")
    out = out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "tag").select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "tag")
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), words.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<int>").alias("removed"), F.lit(0).cast("long").alias("tag"))
    return out.unionByName(nameless)


def without_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, the removed lines cut out of their texts; lines without words stay."""
    gone = line_dedup(docs, percent, id_col, text_col).where(F.size("removed") > 0).select(F.col("doc_id").alias("__gone_id"), "tag", F.col("removed").alias("__gone"))
    gone = gone.withColumnRenamed("tag", "__tag")
    same = F.col("__tag").isin(0) | (_tag(docs[text_col]) == F.col("__tag"))
    joined = docs.join(gone, (docs[id_col].cast("long") == gone["__gone_id"]) & same, "left")
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(rest)
    return joined.select(*[text.alias(c) if c == text_col else joined[c] for c in docs.columns])
