import random
import re

SCHEMA = "doc_id long, text string, lang string, digest string, length int, rep string"


def corpus(seed=3, n=120):
    """Texts with exact and near copies, long ones, empty ones, odd white space and nulls."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["É", "ß", "日本", "x\x00y", "Don't", "3.14", "<s>"]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [None, "", " ", "\n\t ", "one", "one two three", "One  two\tthree", "a" * 3000]
    base = make(60)
    for _ in range(25):
        w = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    while len(texts) < n:
        t = make(rng.randint(1, 120))
        texts += [t] * rng.choice([1, 1, 1, 3])
        if rng.random() < 0.3:
            texts.append(t.replace(" ", rng.choice(["  ", "\n", "\t "]), 2).upper())
    texts.append(make(9000))
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", 7, "y") for i, t in rows], SCHEMA)


def normalised(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
