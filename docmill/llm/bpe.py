"""Byte-level BPE by a rank queue, and back.

Positions of a linked list wait in one bucket per merge rank. A two-level bitmap of 256-bit words marks the buckets in
use; finding the first set bit of each level gives the lowest rank in constant time. A popped position whose pair has changed
meanwhile is stale and skipped. A pre-token of n bytes takes O(n) queue operations, however long it is.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, resident, tokenizer_path


class RankQueue:
    """Encodes and decodes single pre-tokens; bits that find-first-set looks at are those of the ranks in use."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        self.text = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.text}

    def encode(self, token: bytes) -> list[int]:
        whole = self.ranks.get(token)
        if whole is not None:
            return [whole]
        find = self.pairs.get
        ids = list(map(self.byte.__getitem__, token))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        ids.append(-1)  # no pair has it; at n it ends the list, elsewhere it marks what has been merged away
        # Bit b of `top`: some bit of low[b] is set. Bit r & 255 of low[r >> 8]: buckets[r] holds positions.
        top, low, buckets = 0, {}, {}
        left = ids[0]
        for at in range(n - 1):
            right = ids[at + 1]
            rank = find(left << 20 | right)
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
                    high = rank >> 8
                    low[high] = low.get(high, 0) | 1 << (rank & 255)
                    top |= 1 << high
            left = right
        while top:
            high = (top & -top).bit_length() - 1
            x = low[high]
            rank = high << 8 | (x & -x).bit_length() - 1
            waiting = buckets.pop(rank)
            low[high] = x = x & x - 1
            if not x:
                top &= top - 1
            if len(waiting) > 1:
                waiting.sort()
                again = waiting[:0:-1]
            else:
                again = None
            at = waiting[0]
            while True:
                nxt = after[at]
                better = False
                if find(ids[at] << 20 | ids[nxt]) == rank:  # else stale
                    ids[at], ids[nxt] = rank, -1
                    after[at] = nxt = after[nxt]
                    prev = before[at]
                    before[nxt] = at
                    r = find(rank << 20 | ids[nxt]) if nxt < n else None
                    if r is not None:
                        better = r <= rank
                        if r in buckets:
                            buckets[r].append(at)
                        else:
                            buckets[r] = [at]
                            high = r >> 8
                            low[high] = low.get(high, 0) | 1 << (r & 255)
                            top |= 1 << high
                    if prev >= 0:
                        r = find(ids[prev] << 20 | rank)
                        if r is not None:
                            better = better or r <= rank
                            if r in buckets:
                                buckets[r].append(prev)
                            else:
                                buckets[r] = [prev]
                                high = r >> 8
                                low[high] = low.get(high, 0) | 1 << (r & 255)
                                top |= 1 << high
                if not again:
                    break
                if better:  # a pair that goes first has come up: the others of this rank wait again
                    buckets[rank] = buckets.get(rank, []) + again
                    high = rank >> 8
                    low[high] = low.get(high, 0) | 1 << (rank & 255)
                    top |= 1 << high
                    break
                at = again.pop()
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))


#: Characters that are a pre-token of their own at the end of a word.
ENDS = frozenset(".,;:!?")


class Codec:
    """Texts to ids and back. Chunks between single spaces are split by the pattern on their own, and both chunks and
    pre-tokens are kept up to a bound; a text that has other white space next to a space is split whole."""

    def __init__(self, path: str, pattern: str, bound: int = 500_000) -> None:
        import regex

        self.findall = regex.compile(pattern).findall
        self.chunked = pattern == _pattern(None)  # of other patterns nothing is known
        with open(path, "rb") as f:
            self.queue = RankQueue({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.tokens = Memo(self._token, bound)
        self.chunks = Memo(self._chunk, bound)

    def _token(self, token: str) -> tuple[int, str, bytes]:
        ids = self.queue.encode(token.encode("utf-8", "surrogatepass"))
        return len(ids), ",".join(map(self.queue.decimal.__getitem__, ids)), self.queue.decode(ids)

    def _whole(self, text: str) -> tuple[int, str, bytes]:
        parts = self.findall(text)
        if len(text) > 256 and max(map(len, parts)) > 64:  # long pre-tokens are not kept
            parts = [self.tokens[p] if len(p) <= 64 else self._token(p) for p in parts]
        else:
            parts = list(map(self.tokens.__getitem__, parts))
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), b"".join([p[2] for p in parts])

    def _chunk(self, word: str) -> tuple[int, str, bytes]:
        """Of a space and a word (the common forms of a word need no search); -1 where the white space at its ends needs a look at its neighbours."""
        if word.isalpha():  # one pre-token
            return self.tokens[f" {word}"]
        if word[-1:] in ENDS and word[:-1].isalpha():  # two
            a, b = self.tokens[f" {word[:-1]}"], self.tokens[word[-1]]
            return a[0] + b[0], f"{a[1]},{b[1]}", a[2] + b[2]
        if not word or word[0].isspace() or word[-1].isspace():
            return -1, "", b""
        return self._whole(f" {word}")

    def encode(self, text: str) -> list[int]:
        return [i for p in self.findall(text) for i in self.queue.encode(p.encode("utf-8", "surrogatepass"))]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of what the ids decode to."""
        n, ids, data = 0, "", b""
        if text:
            words = text.split(" ")
            first = words.pop(0)
            if self.chunked and first and not first[0].isspace() and not first[-1].isspace() and len(max(words, key=len, default="")) <= 256:
                parts = [self._whole(first), *map(self.chunks.__getitem__, words)]
                counts, ids, data = zip(*parts, strict=True)
            else:
                counts = (-1,)
            if min(counts) < 0:
                n, ids, data = self._whole(text)
            else:
                n, ids, data = sum(counts), ",".join(ids), b"".join(data)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()


CODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
DECODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("bytes", T.BinaryType())])
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        return public_tokenizers.PATTERN
    return pattern


def encode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and the ids of its text, without special tokens. Null counts as empty and gives no ids;
    a null id stays null; rows are independent of each other."""
    path, pattern = tokenizer_path(ranks), _pattern(pattern)

    def run(batches):
        import pyarrow as pa

        codec = resident(("bpe", path, pattern), lambda: Codec(path, pattern))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=CODED.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, CODED)


def decode(coded: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the bytes that its ids stand for; null ids give no bytes, an unknown id is an error."""
    path = tokenizer_path(ranks)

    def run(batches):
        import pyarrow as pa

        with open(path, "rb") as f:
            text = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(map(text.__getitem__, x or ())) for x in batch.column(1).to_pylist()], pa.binary())], names=DECODED.names)

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256. There is no
    shuffle, and ids never leave the worker; nulls and repeated rows as in encode()."""
    path, pattern = tokenizer_path(ranks), _pattern(pattern)

    def run(batches):
        import pyarrow as pa

        codec = resident(("bpe", path, pattern), lambda: Codec(path, pattern))
        for batch in batches:
            rows = [codec.digest(t or "") for a in range(0, batch.num_rows, 256) for t in batch.column(1)[a : a + 256].to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=DIGESTS.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGESTS)
