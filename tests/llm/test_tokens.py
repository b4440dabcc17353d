import hashlib
import random

import pytest

from docmill.llm import bpe, transducer
from docmill.llm.common import tokenizer_path

from .helpers import corpus, frame


def odd_texts(n=400):
    rng = random.Random(5)
    letters = "abcdeistnr ▁  ,.-éü日\n\x00<>/0'\t"
    return ["", " ", "  a  b ", "\ta\nb", "<s>hi</s><unk><0x0A>", "a▁b  ▁▁c", "日本語😀 x" * 20, "a" * 500, " " * 300, "hello world " * 500] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def machine():
    return transducer.counter(tokenizer_path("piece_bpe_32k.model"))


def test_counts_equal_the_library(machine, library):
    texts = odd_texts() + [t or "" for _, t in corpus()]
    assert [machine.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


@pytest.mark.parametrize(("size", "look"), [(1, 48), (3, 2), (7, 48), (64, 48), (64, 1)])
def test_chunk_maps_compose(machine, library, size, look):
    chunked = transducer.Counter(machine.machine, chunk=size, look=look)
    for t in odd_texts(150):
        assert chunked.count(t) == len(library.encode(t)), t[:60]


def test_composition_is_associative(machine):
    rng = random.Random(2)
    for _ in range(60):
        t = "▁" + "".join(rng.choice("ab▁▁c\n") for _ in range(30))
        i, j = sorted(rng.sample(range(1, len(t)), 2))
        maps = lambda: (machine.chunk_map("", t[:i]), machine.chunk_map(t[:i], t[i:j]), machine.chunk_map(t[:j], t[j:]))  # noqa: E731, B023
        (a, b, c), (d, e, f) = maps(), maps()
        one, two = a.then(b).then(c)(transducer.INITIAL), d.then(e.then(f))(transducer.INITIAL)
        assert one == two and one[1] == machine.machine.after(transducer.INITIAL, t)[1]


@pytest.mark.parametrize("unit", ["a", "日本語の文章です", "x1-", "ab\n", "lorem ipsum"])
def test_long_texts(machine, library, unit):
    text = unit.replace(" ", "_") * (1_200_000 // len(unit)) + " end"
    assert machine.count(text) == len(library.encode(text))


def test_states_are_foreseen(machine):
    rng = random.Random(8)
    text = "".join(rng.choice(["日本", "語", "か", "the", "ing", "q", "er", "a", "s", "0"]) for _ in range(20_000))
    runs = [0]
    for i in range(0, len(text), 2000):
        m = machine.chunk_map(text[max(0, i - 48) : i], text[i : i + 2000])
        more, m.more = m.more, lambda s, more=m.more: (runs.__setitem__(0, runs[0] + 1), more(s))[1]
        state = machine.machine.after(transducer.INITIAL, text[:i])[0]
        assert m(state) == machine.machine.after(state, text[i : i + 2000])
    assert runs[0] <= 1


def test_states_stay_bounded(library):
    m = transducer.counter(tokenizer_path("piece_bpe_32k.model"))
    m.machine.bound = 50
    for t in odd_texts(60):
        assert m.count(t) == len(library.encode(t))


def test_token_counts(spark, library):
    rows = [*corpus(), (None, "x y"), (3, "same"), (3, "same")]
    got = sorted((tuple(r) for r in transducer.token_counts(frame(spark, rows), limit=100).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert transducer.token_counts(frame(spark, [])).collect() == []


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(tiktoken_encoding):
    import public_tokenizers

    codec = bpe.Codec(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, bound=20)
    for t in odd_texts() + [t or "" for _, t in corpus()]:
        ids = tiktoken_encoding.encode_ordinary(t)
        assert codec.encode(t) == ids
        assert codec.queue.decode(ids) == t.encode()
        assert codec.digest(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_queue_equals_plain_merging():
    rng = random.Random(4)
    ranks = {bytes([i]): i for i in range(256)}
    tokens = [b"a", b"b", b"c"]
    while len(ranks) < 400:  # not in the order in which parts come up, so that better pairs appear later
        t = rng.choice(tokens) + rng.choice(tokens)
        if t not in ranks and len(t) < 9:
            tokens.append(t)
            ranks[t] = 0
    new = [t for t in ranks if len(t) > 1]
    rng.shuffle(new)
    for r, t in enumerate(new):
        ranks[t] = 256 + r
    queue = bpe.RankQueue(ranks)

    def plain(data):
        if data in ranks:
            return [ranks[data]]
        parts = [bytes([b]) for b in data]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(500):
        data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40)))
        assert queue.encode(data) == plain(data)


def test_encode_decode_tables(spark):
    rows = [*corpus(), (None, None)]
    coded = bpe.encode(frame(spark, rows))
    back = bpe.decode(coded)
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in back.collect()), key=repr) == sorted(((i, (t or "").encode()) for i, t in rows), key=repr)
    digests = {r.doc_id: r for r in bpe.round_trip(frame(spark, rows)).collect()}
    for r in coded.collect():
        assert digests[r.doc_id].n_tokens == len(r.ids)
    assert bpe.round_trip(frame(spark, [])).collect() == []
