"""Token counts by a deterministic transducer compiled from a merge vocabulary.

Merging by priority is a finite-state process: the last token of the segmentation of each prefix is determined
by the last tokens at those earlier positions where a longer piece could still begin, and only the text since the
earliest of them matters. Such positions with their last tokens and relative counts are a state; a character leads to
the next one and is annotated with the number of tokens it adds (negative when it joins earlier ones). States are
made when first reached. Two characters that stand side by side in no piece end all pending positions, so the state
there is the initial one.

Every text is cut into chunks, short ones into one. The map of a chunk leads from each state that may come before it to the
state after it and a number of tokens. Which states may come before is found from the last characters of the chunk before alone,
whatever the state there, so that chunks need not wait for each other; maps compose associatively and are
combined by a prefix scan, halves of halves. A state that was not foreseen costs a run of that chunk, not a wrong count.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, resident, tokenizer_path

SPACE = "▁"
#: Characters in a chunk, and those before it that its first states are found from.
CHUNK, LOOK = 1 << 16, 48
#: Text since the earliest position where a longer piece may begin; such positions as (characters since, last piece, tokens since).
State = tuple[str, tuple[tuple[int, str | None, int], ...]]
INITIAL: State = ("", ((0, None, 0),))


class Transducer:
    """pieces: text -> priority (smaller merges first). Characters that are no piece count as their UTF-8 bytes."""

    def __init__(self, pieces: dict[str, int], bound: int = 400_000) -> None:
        self.rank, self.bound = pieces, bound
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p))}
        self.glue = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.valid: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states, self.ids, self.moves = [INITIAL], {INITIAL: 0}, {}

    def merge(self, text: str) -> list[str]:
        """The segmentation itself: the best pair first, the leftmost among equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: str | None, piece: str) -> bool:
        """Whether `piece` can come right after `last`: merging both together gives just them."""
        key = (last, piece)
        got = self.valid.get(key)
        if got is None:
            if len(self.valid) > 4 * self.bound:
                self.valid.clear()
            if last is not None and last[-1] + piece[0] not in self.glue:
                last = None
            got = self.valid[key] = self.merge((last or "") + piece) == ([piece] if last is None else [last, piece])
        return got

    def step(self, state: int, char: str) -> tuple[int, int]:
        """Next state and tokens added."""
        got = self.moves.get((state, char))
        if got is None:
            got = self.moves[state, char] = self._step(state, char)
        return got

    def _step(self, state: int, char: str) -> tuple[int, int]:
        tail, starts = self.states[state]
        if char not in self.rank:
            # Bytes merge with nothing; all pending positions end.
            return 0, len(char.encode("utf-8", "surrogatepass"))
        text = tail + char
        for depth, last, count in starts:  # longest first; only one fits
            piece = text[len(tail) - depth :]
            if (depth == 0 or piece in self.rank) and self.follows(last, piece):
                break
        else:
            raise AssertionError(f"no piece ends at {text!r}")
        added = count + 1
        kept = [(d + 1, x, n - added) for d, x, n in starts if text[len(tail) - d :] in self.prefixes]
        kept.append((0, piece, 0))
        new = (text[len(text) - kept[0][0] :], tuple(kept))
        at = self.ids.get(new)
        if at is None:
            at = self.ids[new] = len(self.states)
            self.states.append(new)
        return at, added

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """State after the text and tokens added, one transition a character."""
        total, moves = 0, self.moves
        for char in text:
            got = moves.get((state, char))
            if got is None:
                got = moves[state, char] = self._step(state, char)
            state, n = got
            total += n
        return state, total

    def count(self, text: str) -> int:
        if len(self.states) > self.bound:
            self.clear()
        return self.run(text)[1]

    def after(self, state: State, text: str) -> tuple[State, int]:
        """run() with states that mean the same in all workers and after clear()."""
        if len(self.states) > self.bound:
            self.clear()
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
        at, n = self.run(text, at)
        return self.states[at], n

    def reachable(self, text: str) -> set[State]:
        """States that the text ends in, begun in the initial state at any of its characters."""
        if len(self.states) > self.bound:
            self.clear()
        now = {0}
        for char in text:
            now = {self.step(s, char)[0] for s in now} | {0}
        return {self.states[s] for s in now}


class StateMap:
    """From the state before a stretch of text to the state after it and the tokens added; `more` gives what is not known yet."""

    def __init__(self, known: dict[State, tuple[State, int]], more) -> None:
        self.known, self.more = known, more

    def __call__(self, state: State) -> tuple[State, int]:
        got = self.known.get(state)
        if got is None:
            got = self.known[state] = self.more(state)
        return got

    def then(self, other: StateMap) -> StateMap:
        """The map of this text followed by the other's; associative."""

        def through(state):
            middle, n = self(state)
            end, k = other(middle)
            return end, n + k

        return StateMap({s: through(s) for s in self.known}, through)


class Counter:
    """Counts of whole texts. Units between cuts are moves from the initial state to itself, and are kept."""

    def __init__(self, machine: Transducer, bound: int = 500_000, chunk: int = CHUNK, look: int = LOOK) -> None:
        self.machine, self.chunk, self.look, self.units = machine, chunk, look, Memo(machine.count, bound)
        # A cut lies before a space that follows another character; no piece may hold one in that place.
        if any(a != SPACE and b == SPACE for a, b in machine.glue):
            raise ValueError("a piece holds a space after another character")
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def of_units(self, units: list[str]) -> int:
        if len(units) == 1 and len(units[0]) > 256:  # not kept
            return self.machine.count(units[0])
        return sum(map(self.units.__getitem__, units))

    def chunk_map(self, before: str, text: str) -> StateMap:
        """The map of a chunk, known for the states that it may begin in: after `before`, the end of the text to its left."""
        # What lies before the first cut depends on the state, what comes after it does not.
        first = next((m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", text)), None)
        head, rest = (text, []) if first is None else (text[:first], self.cut.findall(text[first:]))
        inner = self.of_units(rest[:-1])
        end, last = self.machine.after(INITIAL, rest[-1]) if rest else (None, 0)

        def run(state):
            to, n = self.machine.after(state, head)
            return (end, n + inner + last) if rest else (to, n)

        return StateMap({s: run(s) for s in (self.machine.reachable(before) if before else {INITIAL})}, run)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """All maps composed, neighbours first, level by level."""
        while len(maps) > 1:
            maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= self.chunk:  # one chunk, begun in the initial state: all of its units are whole
            return self.of_units(self.cut.findall(text))
        return self.scan([self.chunk_map(text[max(0, i - self.look) : i], text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)])(INITIAL)[1]


def counter(path: str) -> Counter:
    """From a sentencepiece model whose normaliser is the identity and which puts a space first."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    order = sorted(own, key=lambda i: -m.get_score(i))
    scores = {}
    for i in order:  # equal scores are equal priorities
        scores.setdefault(m.get_score(i), len(scores))
    return Counter(Transducer({m.id_to_piece(i): scores[m.get_score(i)] for i in own}))


COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens as the library gives them, over_limit (n_tokens > limit).

    Null counts as empty (0 bytes, 0 tokens); a null id stays null; rows are independent, so repeated rows give
    repeated results and an empty table an empty one. There is no shuffle; a worker's tables are bounded."""
    path = tokenizer_path(model)

    def run(batches):
        import pyarrow as pa

        count = resident(("transducer", path), lambda: counter(path)).count
        for batch in batches:
            sizes, tokens = [], []
            for a in range(0, batch.num_rows, 256):
                for t in batch.column(1)[a : a + 256].to_pylist():
                    t = t or ""
                    sizes.append(len(t.encode("utf-8", "surrogatepass")))
                    tokens.append(count(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=COUNTS.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COUNTS)
