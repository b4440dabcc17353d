"""Best-fit packing by non-negative least squares over length patterns.

The corpus is reduced to a histogram of lengths (at most `capacity` numbers, whatever the corpus).
Patterns of a few documents that fill a sequence are enumerated over coarse length units; non-negative
least squares fits how often each is used to the histogram; counts are rounded down and realised with exact
lengths, the last document of a pattern being the longest that still fits. What is left is packed by
best fit in decreasing length, still on the histogram, into open sequences first. The plan is a list of groups
"so many sequences with these lengths", its size bounded by the capacity. Every piece then finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, tokenizer_path, written

CAPACITY = 4096
SEPARATOR = 1
#: Coarse units in a sequence, and most documents in a pattern.
UNITS, PATTERN_DOCS = 64, 4
#: Pieces of one length that one ranking task sees, about.
RANKED_TOGETHER = 20_000


def patterns(units: int = UNITS, docs: int = PATTERN_DOCS) -> list[tuple[int, ...]]:
    """All ways to fill `units` with at most `docs` documents of whole units, longest first."""

    def parts(left: int, most: int, k: int):
        if not left:
            yield ()
        elif k:
            for x in range(min(left, most), (left - 1) // k, -1):
                for rest in parts(left - x, x, k - 1):
                    yield (x, *rest)

    return list(parts(units, units, docs))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gradient = np.where(used, -np.inf, target - gram @ x)
        j = int(gradient.argmax())
        if gradient[j] <= tol:
            break
        used[j] = True
        while True:
            k = np.flatnonzero(used)
            z = np.linalg.lstsq(gram[np.ix_(k, k)], target[k], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[k] = z
                break
            low = k[z <= 0]
            step = np.min(x[low] / np.maximum(x[low] - z[z <= 0], 1e-300))
            x[k] += step * (z - x[k])
            x[low[x[low] <= 1e-12]] = 0
            x[~used] = 0
            gone = used & (x <= 1e-12)
            if not gone[low].any():
                gone[low] = True
            used &= ~gone
            x[~used] = 0
            if not used.any():
                break
    return x


@dataclass
class Group:
    """`count` sequences with the same content: runs of (length, how many)."""

    count: int
    left: int
    runs: tuple[tuple[int, int], ...] = ()

    def add(self, length: int, k: int, count: int | None = None) -> Group:
        return Group(self.count if count is None else count, self.left - length * k, (*self.runs, (length, k)))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, units: int = UNITS, docs: int = PATTERN_DOCS) -> list[Group]:
    """Groups that hold every document of the histogram (length: count; lengths from 1 to capacity)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if not left:
        return []
    if min(left) < 1 or max(left) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    groups = _from_patterns(left, capacity, min(units, capacity), docs)
    return _best_fit(left, groups, capacity)


def _from_patterns(left: dict[int, int], capacity: int, units: int, docs: int) -> list[Group]:
    unit = -(-capacity // units)
    of = lambda n: -(-n // unit)
    units = of(capacity)
    shapes = patterns(units, docs)
    a = np.zeros((units, len(shapes)))
    for j, shape in enumerate(shapes):
        for u in shape:
            a[u - 1, j] += 1
    b = np.zeros(units)
    for n, c in left.items():
        b[of(n) - 1] += c
    # Long documents are hard to place, short ones fill gaps later: residuals of long units weigh more.
    weight = np.sqrt(np.arange(1, units + 1) / units)
    repeats = np.floor(nnls(a * weight[:, None], b * weight) + 1e-6).astype(int)
    lengths = sorted(left)

    def take(most: int, least: int, want: int):
        """Runs (length, count) of the longest documents from least to most, up to `want`."""
        i = bisect.bisect_right(lengths, most) - 1
        while want and i >= 0 and lengths[i] >= least:
            n = lengths[i]
            if k := min(want, left.get(n, 0)):
                left[n] -= k
                want -= k
                yield n, k
            i -= 1

    done = []
    for j in np.argsort(-repeats, kind="stable"):
        if not (want := int(repeats[j])):
            continue
        open_ = [Group(want, capacity)]
        for k, u in enumerate(shapes[j]):
            last, grown = k == len(shapes[j]) - 1, []
            for g in open_:
                todo = g.count
                for n, c in take(min(g.left, capacity if last else u * unit), 1 if last else (u - 1) * unit + 1, todo):
                    grown.append(g.add(n, 1, c))
                    todo -= c
                if todo:
                    grown.append(Group(todo, g.left, g.runs))
            open_ = grown
        for g in open_:
            if g.left < unit:
                done.append(g)
                continue
            for n, k in g.runs:  # the histogram had no more documents of that shape: these are residuals
                left[n] += k * g.count
    return done


def _best_fit(left: dict[int, int], groups: list[Group], capacity: int) -> list[Group]:
    """Best fit in decreasing length, all documents of a length at once."""
    rooms: dict[int, list[Group]] = {}
    for g in groups:
        rooms.setdefault(g.left, []).append(g)
    keys = sorted(rooms)

    def put(g: Group) -> None:
        if g.left not in rooms:
            rooms[g.left] = []
            bisect.insort(keys, g.left)
        rooms[g.left].append(g)

    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        todo = left[n]
        i = bisect.bisect_left(keys, n)
        while todo and i < len(keys):
            room, moved = keys[i], []
            stack = rooms[room]
            per = room // n
            while todo and stack:
                g = stack.pop()
                full = min(g.count, todo // per)
                if full:
                    moved.append(g.add(n, per, full))
                    todo -= full * per
                rest = g.count - full
                if rest and todo:  # fewer than `per` are left
                    moved.append(g.add(n, todo, 1))
                    rest, todo = rest - 1, 0
                if rest:
                    stack.append(Group(rest, g.left, g.runs))
            if not stack:
                del rooms[room]
                keys.pop(i)
            else:
                i += 1
            for g in moved:
                put(g)
            # What was put has less room than n, so it lies before i.
            i = bisect.bisect_right(keys, room)
        if todo:
            per = capacity // n
            new = Group(1, capacity)
            if full := todo // per:
                put(new.add(n, per, full))
            if todo % per:
                put(new.add(n, todo % per, 1))
        left[n] = 0
    return [g for k in keys for g in rooms[k]]


def slots(groups: list[Group]) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, first): an entry holds the places first, first + 1, ... of its length."""
    rows, sequence = [], 0
    for g in groups:
        offset = 0
        for n, k in g.runs:
            rows.append((n, k, g.count, sequence, offset))
            offset += n * k
        sequence += g.count
    a = np.array(rows or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    a = a[np.argsort(a[:, 0], kind="stable")]
    first = np.cumsum(a[:, 1] * a[:, 2]) - a[:, 1] * a[:, 2]
    base = np.zeros(int(a[:, 0].max(initial=0)) + 2, dtype=np.int64)
    seen, at = np.unique(a[:, 0], return_index=True)
    base[seen] = first[at] if len(seen) else 0
    return {"length": a[:, 0], "times": a[:, 1], "sequence": a[:, 3], "offset": a[:, 4], "first": first, "base": base}


class WordTable:
    """Token ids of texts by a tokenizers file, as little-endian unsigned 32-bit bytes.

    Pre-tokens of such a file never cross a space, so ids of chunks between spaces are joined. Chunks of up to 15 bytes and
    INLINE ids are kept in a table of fixed size, one chunk a slot, the latest one there; whole batches are looked up at once by
    the chunks' own bytes, so a hit is exact. All others go to the library, each once a batch, as few long texts
    with a mark between them; where the mark is not a token of its own, or a chunk holds it, they go one by one."""

    MARK = "\x01"
    INLINE = 6

    def __init__(self, path: str, bits: int = 20) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        apart = self.tokenizer.encode(f"a {self.MARK} a", add_special_tokens=False).ids
        alone = self.tokenizer.encode("a", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and apart == alone + mark + alone else None
        self.shift = np.uint64(64 - bits)
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.times, self.values = np.zeros(1 << bits, np.uint8), np.zeros((1 << bits, self.INLINE), np.uint32)
        #: By length: which of 8 bytes belong to a chunk, and the last byte of the second 8 says its length.
        size = np.arange(16)
        ones = lambda n: np.array([(1 << 8 * min(int(k), 8)) - 1 for k in n], np.uint64)
        self.first, self.second, self.length = ones(size), ones(np.maximum(size - 8, 0)), size.astype(np.uint64) << np.uint64(56)

    def _one_by_one(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each chunk begin, how many it has)."""
        if self.mark is None or any(self.MARK in c for c in chunks):
            return self._one_by_one(chunks)
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(chunks)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(chunks) - 1:
            return self._one_by_one(chunks)
        starts = np.r_[0, marks + 1]
        return ids, starts, np.r_[marks, len(ids)] - starts

    def _asked(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for chunks of raw; equal ones are asked for once."""
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        places = dict.fromkeys(words)
        chunks = [c.decode("utf-8", "surrogatepass") for c in places]
        places.update(zip(places, range(len(places)), strict=True))
        of = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        parts, shift, begins = [self._together(chunks[k : k + 1000]) for k in range(0, len(chunks), 1000)], 0, []
        for ids, at, _ in parts:
            begins.append(at + shift)
            shift += len(ids)
        return np.concatenate([x[0] for x in parts]), np.concatenate(begins)[of], np.concatenate([x[2] for x in parts])[of]

    def _joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each begin (with the end of the last)."""
        raw = b"\n".join(texts) + b"\n" + bytes(16)
        a = np.frombuffer(raw, np.uint8, len(raw) - 16)
        word = (a != 32) & (a != 10)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.r_[0, edge]
        start, end = edge[::2], edge[1::2]
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        n = end - start
        eights = np.lib.stride_tricks.as_strided(np.frombuffer(raw, np.uint64, 1), (len(raw) - 7,), (1,))
        short = n < 16
        size = np.where(short, n, 0)
        low = eights[start] & self.first[size]
        high = eights[start + 8] & self.second[size] | self.length[size]
        slot = ((low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD) >> self.shift).astype(np.int64)
        known = short & (self.low[slot] == low) & (self.high[slot] == high)
        miss = np.flatnonzero(~known)
        count = self.times[slot].astype(np.int64)
        if len(miss):
            ids, at, sizes = self._asked(raw, start[miss], end[miss])
            count[miss] = sizes
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        first = ends - count
        for k in range(self.INLINE):
            have = np.flatnonzero(known & (count > k))
            out[first[have] + k] = self.values[slot[have], k]
        if len(miss):
            inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[np.repeat(first[miss], sizes) + inner] = ids[np.repeat(at, sizes) + inner]
            new = short[miss] & (sizes <= self.INLINE)
            # Of several chunks with one slot, one is kept.
            where, one = np.unique(slot[miss[new]], return_index=True)
            m, at, sizes = miss[new][one], at[new][one], sizes[new][one]
            self.low[where], self.high[where], self.times[where] = low[m], high[m], sizes
            for k in range(self.INLINE):
                have = sizes > k
                self.values[where[have], k] = ids[at[have] + k]
        return out, np.r_[0, ends][np.searchsorted(start, begins)]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        ids, at = self._joined(texts)
        data, at = ids.astype("<u4", copy=False).tobytes(), (at * 4).tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def slices(texts: list[bytes], size: int = 2 << 20):
    """Runs [a, b) of texts of about `size` bytes in all."""
    a = total = 0
    for b, t in enumerate(texts, 1):
        total += len(t)
        if total >= size or b == len(texts):
            yield a, b
            a, total = b, 0


PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every document followed by the separator, cut at `capacity` only where longer.

    One row per piece: doc_id, piece, start, length, ids_crc32 and, with_ids, the ids as little-endian
    unsigned 32-bit numbers. A null text counts as empty and gives one piece with the separator; a null id
    stays null; repeated rows are documents of their own; other columns are left out."""
    path = tokenizer_path(tokenizer)
    schema = PIECE if with_ids else T.StructType(PIECE.fields[:-1])

    def run(batches):
        import pyarrow as pa

        encode, end = resident(("words", path), lambda: WordTable(path)), np.array([separator], dtype="<u4").tobytes()
        width = capacity * 4
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            whole = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in slices(whole):
                rows = []
                for doc, got in zip(ids[a:b], encode(whole[a:b]), strict=True):
                    got += end
                    for k, at in enumerate(range(0, len(got), width)):
                        x = got[at : at + width]
                        rows.append((doc, k, at // 4, len(x) // 4, zlib.crc32(x), x))
                columns = list(zip(*rows, strict=True))
                n = len(schema.fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", tie_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` (written or otherwise cheap to read again) with sequence_id and offset.

    Only the histogram of lengths comes to the driver: at most `capacity` rows. Pieces of a very frequent
    length are ranked in salted groups of about RANKED_TOGETHER, so no task sees a whole length."""
    spark = pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(length_col).count().collect()}
    table = slots(plan(histogram, capacity))
    sent = spark.sparkContext.broadcast(table)
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if not histogram:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    many = {n: -(-c // RANKED_TOGETHER) for n, c in histogram.items() if c > RANKED_TOGETHER}
    salts = F.lit(1)
    if many:
        salts = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(many.items()) for x in kv])[F.col(length_col).cast("int")], F.lit(1))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*tie_cols), salts).cast("int"))
    counts = salted.groupBy(length_col, "__salt").count()
    before = Window.partitionBy(length_col).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(length_col, "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy(length_col, "__salt").orderBy(*tie_cols)) - 1
    ranked = salted.withColumn("__rank", rank.cast("long")).join(starts, [length_col, "__salt"])
    ranked = ranked.select(*pieces.columns, (F.col("__rank") + F.col("__start")).alias("__rank"))
    at = pieces.columns.index(length_col)

    def run(batches):
        import pyarrow as pa

        p = sent.value
        for batch in batches:
            n = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            where = p["base"][n] + batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            e = np.searchsorted(p["first"], where, "right") - 1
            k = where - p["first"][e]
            cols = [*batch.columns[:-1], pa.array(p["sequence"][e] + k // p["times"][e]), pa.array(p["offset"][e] + k % p["times"][e] * n)]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return ranked.mapInArrow(run, out)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens: the pieces of tokenized_pieces() with
    sequence_id and offset, offsets gapless from 0 in every sequence. An empty table gives an empty result."""
    return place(written(tokenized_pieces(docs, tokenizer, capacity, separator, id_col, text_col, with_ids), "pieces"), capacity)
