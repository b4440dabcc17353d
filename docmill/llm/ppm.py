"""Language-model scores by prediction by partial matching over a pretrained byte-context trie.

Symbols are the 256 bytes and an end mark; ORDER marks stand before each text. A symbol's probability starts in the node
of its ORDER preceding symbols: c / (t + d) for a symbol seen c times among t, where d different ones follow;
d / (t + d) is the escape to the next shorter context, where symbols seen in the longer one are excluded, down to equal
shares for symbols never seen. The trie is learned from the training rows and is exact: nothing is pruned or hashed.

It need not fit anywhere as a whole. Documents are dealt into chunks of about CHUNK bytes; a chunk sends its distinct
(context, symbol) keys and words with their training counts, as sorted arrays cut into buckets. A bucket holds all
contexts that share their last two symbols, so that all orders from 2 up can be summed there; order 1 has at most 257 * 257
numbers and comes as a literal. Of many chunks, FAN at a time are summed into one first, level by level, and
answers go back the same way, so a task holds the distinct keys of FAN parts of a bucket, however many chunks have them. A bucket
answers each chunk with one value per key. Chunk and answer then meet, and each document is scored with its chunk's values.
Logarithms go from buckets to chunks in single precision: a text's score is off by at most 6e-8 of itself.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, written

ORDER, BITS, END = 5, 9, 256
CHUNK = 16 << 20
SLICE = 1 << 22
#: Parts of a bucket that one task sums.
FAN = 256
WORD, GRAM, CELL, TOTAL = 0, 1, 2, 3
#: Stands for the end among words; no word is empty.
NO_WORD = b""


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII white space, A-Z lowered, then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(NO_WORD)
    return out


def hashes(words) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def grams(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """A key (order symbols and the one after them) for every byte of every text and its end, in order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = bytes(order)
    a = np.frombuffer(gap + gap.join(texts) + gap, np.uint8).astype(np.int64)
    at = order + np.cumsum(sizes + order) - order  # the first mark after each text
    a[:order] = END
    for k in range(order):
        a[at + k] = END
    key = np.zeros(len(a) - order, np.int64)
    for k in range(order + 1):
        key <<= BITS
        key |= a[k : len(a) - order + k]
    keep = np.ones(len(key), bool)  # key i is of symbol i + order
    for k in range(1, order):
        where = at + k - order
        keep[where[where < len(key)]] = False
    return key[keep]


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def batches_of(texts: list[bytes], size: int = SLICE):
    some, total = [], 0
    for t in texts:
        some.append(t)
        total += len(t) + ORDER
        if total >= size:
            yield some
            some, total = [], 0
    if some:
        yield some


def gram_counts(texts: list[bytes], trained: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for train in (True, False):
        for some in batches_of([t for t, x in zip(texts, trained, strict=True) if x == train]):
            k, c = np.unique(grams(some), return_counts=True)
            keys.append(k)
            counts.append(c if train else np.zeros_like(c))
            if len(keys) > 8:
                k, c = counted(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [k], [c]
    return counted(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_counts(lists: list[list[bytes]], trained: list[bool]) -> dict[bytes, int]:
    from collections import Counter

    out: Counter = Counter()
    for words, train in zip(lists, trained, strict=True):
        if train:
            out.update(words)
    for words, train in zip(lists, trained, strict=True):
        if not train:
            out.update(dict.fromkeys([w for w in words if w not in out], 0))
    return out


def gram_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """By the last two symbols of the context."""
    two = ((keys >> BITS) & ((1 << 2 * BITS) - 1)).astype(np.uint64)
    return ((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def word_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(n)).astype(np.int64)


def code_lengths(keys: np.ndarray, counts: np.ndarray, cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of each key. keys: sorted and distinct, with training counts, 0 for those only asked for;
    they have every key of the contexts that share their last two symbols. cells[a, b]: times that b came after a."""
    p = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    symbol = keys & ((1 << BITS) - 1)
    excluded = None  # context (one longer) -> sum of this order's counts of the symbols seen there, and their number
    for k in range(order, -1, -1):
        mask = (1 << (k + 1) * BITS) - 1
        if k >= 2:
            mine, at = np.unique(keys & mask, return_inverse=True)
            c = np.zeros(len(mine), np.int64)
            np.add.at(c, at, counts)
            context, of = np.unique(mine >> BITS, return_inverse=True)
        elif k == 1:
            seen = np.unique(keys & mask)
            mine = seen
            at = np.searchsorted(mine, keys & mask)
            c = cells[mine >> BITS, mine & END * 2 - 1]
            context, of = np.unique(mine >> BITS, return_inverse=True)
        else:
            mine, at = np.unique(symbol, return_inverse=True)
            c = cells.sum(axis=0)[mine]
            context, of = np.zeros(1, np.int64), np.zeros(len(mine), np.int64)
        if k >= 2:
            t = np.bincount(of, c, len(context))
            d = np.bincount(of, c > 0, len(context))
        elif k == 1:
            t, d = cells[context].sum(axis=1).astype(float), (cells[context] > 0).sum(axis=1).astype(float)
        else:
            t, d = np.array([float(cells.sum())]), np.array([float((cells.sum(axis=0) > 0).sum())])
        ctx = of[at]  # of each key
        tt, dd = t[ctx], d[ctx]
        if excluded is not None:
            # Symbols seen in the longer context were seen here too.
            longer, seen_c, seen_symbols = excluded
            if k >= 2:
                own = c[np.searchsorted(mine, seen_symbols & mask)]
            elif k == 1:
                own = cells[(seen_symbols >> BITS) & (END * 2 - 1), seen_symbols & (END * 2 - 1)]
            else:
                own = cells.sum(axis=0)[seen_symbols & (END * 2 - 1)]
            tt = tt - np.bincount(seen_c, own, len(longer))[prev]
            dd = dd - np.bincount(seen_c, minlength=len(longer))[prev]
        total = tt + dd
        hit = open_ & (c[at] > 0)
        p[hit] += np.log10(c[at][hit] / total[hit])
        miss = open_ & ~hit & (dd > 0)
        p[miss] += np.log10(dd[miss] / total[miss])
        open_ &= ~hit
        if k > 1:
            got = c > 0
            excluded, prev = (context, of[got], mine[got]), ctx
        elif k == 1:
            a, b = np.nonzero(cells[context])
            excluded, prev = (context, a, (context[a] << BITS) | b), ctx
        else:
            left = END + 1 - d[0]
            p[open_] -= math.log10(max(left, 1))
    return p


LEARNED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
ANSWER = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("found", T.BinaryType())])
SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), *[T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _arrow(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(want)], schema=want)


def _learn(n_buckets: int):
    def run(table):
        chunk = table.column("chunk")[0].as_py()
        trained = [not x for x in table.column("held_out").to_pylist()]
        texts = table.column("text").to_pylist()
        lists = [words_of(t) for t in texts]
        found = word_counts(lists, trained)
        total = sum(len(x) for x, y in zip(lists, trained, strict=True) if y)
        del lists
        wk, wc = counted(hashes(found), np.fromiter(found.values(), np.int64, len(found)))
        del found
        gk, gc = gram_counts([(t or "").encode("utf-8", "surrogatepass") for t in texts], trained)
        rows = [(TOTAL, 0, chunk, total, None, None)]
        pair = gk & ((1 << 2 * BITS) - 1)
        cells = np.bincount(pair, gc, minlength=1).astype(np.int64)
        rows += [(CELL, int(x), chunk, int(cells[x]), None, None) for x in np.flatnonzero(cells)]
        for kind, keys, counts, where in ((WORD, wk, wc, word_buckets(wk, n_buckets)), (GRAM, gk, gc, gram_buckets(gk, n_buckets))):
            order = np.argsort(where, kind="stable")
            keys, counts, where = keys[order], counts[order], where[order]
            ends = np.searchsorted(where, np.arange(n_buckets + 1))
            rows += [(kind, b, chunk, int(ends[b + 1] - ends[b]), keys[ends[b] : ends[b + 1]].tobytes(), counts[ends[b] : ends[b + 1]].tobytes()) for b in range(n_buckets) if ends[b + 1] > ends[b]]
        return _arrow(rows, LEARNED)

    return run


def _parts(table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("keys", "counts"))


def _sum(table):
    """Parts of a bucket summed into one of the next level."""
    keys, counts = counted(*_parts(table))
    return _arrow([(*(table.column(c)[0].as_py() for c in ("kind", "bucket", "up")), len(keys), keys.tobytes(), counts.tobytes())], LEARNED)


def _back(parts, answer):
    """The answer to a sum of parts as answers to each of them."""
    if not parts.num_rows:
        return _arrow([], ANSWER)
    kind, number = parts.column("kind")[0].as_py(), parts.column("bucket")[0].as_py()
    keys, sizes = _parts(parts)[0], parts.column("n").to_pylist()
    values = np.frombuffer(answer.column("found")[0].as_py(), np.int64 if kind == WORD else np.float32)
    got = values[np.searchsorted(np.unique(keys), keys)]
    ends = np.cumsum([0, *sizes])
    return _arrow([(c, kind, number, n, got[a : a + n].tobytes()) for c, n, a in zip(parts.column("chunk").to_pylist(), sizes, ends, strict=False)], ANSWER)


def _merge(cells: np.ndarray):
    def run(table):
        kind, number = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        chunks, sizes = table.column("chunk").to_pylist(), table.column("n").to_pylist()
        keys, counts = _parts(table)
        distinct, sums = counted(keys, counts)
        values = sums if kind == WORD else code_lengths(distinct, sums, cells).astype(np.float32)
        got = values[np.searchsorted(distinct, keys)]
        ends = np.cumsum([0, *sizes])
        rows = [(c, kind, number, n, got[a : a + n].tobytes()) for c, n, a in zip(chunks, sizes, ends, strict=False)]
        if kind == WORD:
            rows.append((-1, TOTAL, number, int((sums > 0).sum()), None))
        return _arrow(rows, ANSWER)

    return run


class Lookup:
    """Values of sorted distinct keys by one multiplication and one read; keys that share a slot are searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values.astype(np.float32)
        self.shift = np.uint64(64 - min(24, max(8, int(len(keys)).bit_length() + 4)))
        slot = self._slot(keys)
        self.table = np.full(1 << int(64 - self.shift), np.nan, np.float32)
        self.table[slot] = self.values
        seen = np.bincount(slot, minlength=len(self.table))
        self.table[seen > 1] = np.nan

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = self.table[self._slot(keys)]
        odd = np.flatnonzero(np.isnan(out))
        out[odd] = self.values[np.searchsorted(self.keys, keys[odd])]
        return out


def _score(n_buckets: int, n: int, v: int):
    def run(docs, answers):
        if not docs.num_rows:
            return _arrow([], SCORES)
        texts = docs.column("text").to_pylist()
        held = docs.column("held_out").to_pylist()
        got = {WORD: {}, GRAM: {}}
        for kind, b, x in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("found").to_pylist(), strict=True):
            got[kind][b] = x
        join = lambda kind, dtype: np.frombuffer(b"".join(got[kind][b] for b in sorted(got[kind])), dtype)
        lists = [words_of(t) for t in texts]
        vocabulary = list(set().union(*lists))
        mine = hashes(vocabulary)
        keys = np.unique(mine)
        keys = keys[np.argsort(word_buckets(keys, n_buckets), kind="stable")]
        c = join(WORD, np.int64)
        assert len(c) == len(keys), "the chunk has other words than when it was learned"
        order = np.argsort(keys)
        c = c[order][np.searchsorted(keys[order], mine)]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        known = c > 0
        index = dict(zip(vocabulary, range(len(vocabulary)), strict=True))
        stats = []
        for words in lists:
            i = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            stats.append((len(words), int(known[i].sum()), float(base[i].sum())))
        del lists, vocabulary, index
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        keys, _ = gram_counts(data, [True] * len(data))
        keys = keys[np.argsort(gram_buckets(keys, n_buckets), kind="stable")]
        values = join(GRAM, np.float32)
        assert len(values) == len(keys), "the chunk has other contexts than when it was learned"
        order = np.argsort(keys)
        find, scores = Lookup(keys[order], values[order]), []
        for some in batches_of(data):
            p = find(grams(some)).astype(np.float64)
            starts = np.cumsum([0, *[len(t) + 1 for t in some[:-1]]])
            scores += np.add.reduceat(p, starts).tolist()
        rows = [(d, h, s[0], s[1], n, s[2], x) for d, h, s, x in zip(docs.column("doc_id").to_pylist(), held, stats, scores, strict=True)]
        return _arrow(rows, SCORES)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, chunk_bytes: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words) and score (byte contexts), both log10.

    Rows whose crc32(id as text) modulo `folds` is `held_fold` are scored but not learned from. Null texts count as
    empty: one token, the end. A null id counts as empty text in the crc32 and stays null. Repeated rows are learned
    from as often as they come. An empty table gives an empty result; without training rows every byte costs
    log10(257) and every word scores 0."""
    spark = docs.sparkSession
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    n_buckets = max(8, min(1 << 17, chunks))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = own.select("doc_id", "text", (bucket("doc_id", folds) == held_fold).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    learned = written(own.groupBy("chunk").applyInArrow(_learn(n_buckets), LEARNED), "learned")
    cells = np.zeros((END + 1, 2 * END), np.int64)
    for cell, times in learned.where(F.col("kind") == CELL).groupBy("bucket").agg(F.sum("n")).collect():  # at most 257 * 257
        cells[cell >> BITS, cell & (2 * END - 1)] = times
    n = learned.where(F.col("kind") == TOTAL).agg(F.sum("n")).first()[0] or 0
    levels, parts = [learned.where(F.col("kind").isin(WORD, GRAM))], chunks
    above = lambda n: F.pmod("chunk", F.lit(n)).alias("up")
    ups = []
    while parts > fan:
        parts = -(-parts // fan)
        ups.append(parts)
        levels.append(written(levels[-1].withColumn("up", above(parts)).groupBy("kind", "bucket", "up").applyInArrow(_sum, LEARNED), "sums"))
    answers = written(levels[-1].groupBy("kind", "bucket").applyInArrow(_merge(cells), ANSWER), "answers")
    v = answers.where(F.col("kind") == TOTAL).agg(F.sum("n")).first()[0] or 0
    mine = answers.where(F.col("kind") != TOTAL)
    keys = ["kind", "bucket", "up"]
    for level, ups_there in zip(levels[-2::-1], ups[::-1], strict=True):
        mine = written(level.withColumn("up", above(ups_there)).groupBy(*keys).cogroup(mine.withColumnRenamed("chunk", "up").groupBy(*keys)).applyInArrow(_back, ANSWER), "answers")
    return own.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(_score(n_buckets, n, v), SCORES)
