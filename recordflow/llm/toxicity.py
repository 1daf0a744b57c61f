"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with its bounds marked), each hashed to a row
of an embedding table; a linear softmax over the average of bags gives a class. Table and
softmax are trained jointly in numpy. An unseen misspelling shares most n-gram vectors
with the word it stands for; rows start at zero, so n-grams that were never seen say
nothing. Since a remark in a long text makes it toxic, the average goes over the ``WORST``
distinct words of a document that score highest: their bags are averaged, and the linear
softmax of that average is the score. Training follows: after rounds on words from all
over the texts, each document is represented by the words that now score highest; at the
end the softmax's bias is fitted again, on these averages of whole training documents.

Training is bounded by parameters: ``per_class`` labelled rows of each class (those of
the smallest id hashes) with at most ``longest`` characters. Scoring reads every text
whole. A run of ``RUN`` or more characters without white space counts as many words: its
overlapping windows of ``PIECE`` characters, and its parts between marks.

Cases: null and empty texts have no words and score below 0.5; labels other than 0 and 1
and rows without a text are not learned from; without labels of both classes every score
is below 0.5; repeated rows are scored each; a null id counts as the empty text in the
fold rule; other columns are kept by ``with_score``.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


BUCKETS, WIDTH, WORST, GRAMS = 1 << 18, 8, 3, (3, 4, 5, 6)
MARKS = ".,;:!?\"'()[]{}<>|*#%&$+-_=/\\~`^@"
#: Characters of a run from which it is scored in pieces, of a window of it, and between windows.
RUN, PIECE, STEP = 65, 10, 5
#: Marks, those of full width and what is invisible.
BREAKS = re.compile("[" + re.escape(MARKS) + "\u00ad\u200b-\u200f\u2026\u2060\ufeff\u3000-\u3003\u3008-\u3011\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")


def words_of(text: str) -> list[str]:
    """Words in lower case, without marks around them; long runs in pieces."""
    words = [w.strip(MARKS) or w for w in text.lower().split()]
    if max(map(len, words), default=0) >= RUN:
        return [p for w in words for p in (pieces(w) if len(w) >= RUN else (w,))]
    return words


def pieces(run: str) -> list[str]:
    """Windows that together hold every n-gram of a run, and what stands between marks
    in it."""
    windows = [run[a : a + PIECE] for a in range(0, len(run) - PIECE + STEP, STEP)]
    return windows + [p for p in BREAKS.split(run) if 0 < len(p) < RUN]


def grams(word: str) -> list[int]:
    """Rows of a word's n-grams and of the word itself in the embedding table."""
    w = ("<" + word + ">").encode()
    n, crc = len(w), zlib.crc32
    out = [crc(w[i : i + k]) & BUCKETS - 1 for k in GRAMS for i in range(n - k + 1)]
    out.append(crc(w, 1) & BUCKETS - 1)
    return out


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


class Bags:
    """Documents as runs of word numbers, and words as runs of table rows."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
        rows, size = array("i"), array("i")  # plain ints in lists would take ten times the memory
        for w in number:
            g = grams(w)
            rows.extend(g)
            size.append(len(g))
        self.rows, self.size = np.frombuffer(rows, np.int32), np.frombuffer(size, np.int32).astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]

    def means(self, table: np.ndarray) -> np.ndarray:
        """Average of a one-column table over the bag of each word."""
        return np.add.reduceat(table.astype(np.float32)[self.rows], self.start[:-1]).astype(np.float64) / self.size if len(self.size) else np.zeros(0)

    def gather(self, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows of passages, the passage of each, and its share in the average."""
        words = np.concatenate(passages)
        owner = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
        size = self.size[words]
        at = np.repeat(self.start[words] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        share = 1 / (size * np.array([len(p) for p in passages])[owner])
        return self.rows[at], np.repeat(owner, size), np.repeat(share, size)


def worst(values: np.ndarray) -> float:
    """The average of the highest values."""
    if len(values) > WORST:
        values = np.partition(values, len(values) - WORST)[-WORST:]
    return float(values.mean())


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.table = np.zeros((BUCKETS, WIDTH))
        self.out, self.bias = rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
        #: Squared movement so far; its start keeps rows that were seen once near zero.
        self.g_table, self.g_out, self.g_bias = np.full(BUCKETS, 1e-6), 1e-8, 1e-8

    def step(self, bags: Bags, batch: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rate: float) -> None:
        """One step of weighted cross entropy on averages, with rates that adapt to how
        much each table row has moved."""
        rows, owner, share = bags.gather(batch)
        mean = np.zeros((len(batch), WIDTH))
        for k in range(WIDTH):
            mean[:, k] = np.bincount(owner, share * self.table[rows, k], len(batch))
        z = mean @ self.out + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(len(batch)), labels] -= 1
        d *= weights[:, None]
        back = d @ self.out.T
        used, where = np.unique(rows, return_inverse=True)
        grad = np.stack([np.bincount(where, share * back[owner, k], len(used)) for k in range(WIDTH)], axis=1)
        self.g_table[used] += (grad**2).mean(axis=1)
        self.table[used] -= rate * grad / np.sqrt(self.g_table[used])[:, None]
        g = mean.T @ d
        self.g_out += (g**2).mean()
        self.out -= rate * g / np.sqrt(self.g_out)
        self.g_bias += (d.sum(0) ** 2).mean()
        self.bias -= rate * d.sum(0) / np.sqrt(self.g_bias)

    def line(self) -> tuple[np.ndarray, float]:
        """Log odds of the class toxic: one number for each table row, and the offset."""
        w = self.out[:, 1] - self.out[:, 0]
        return (self.table @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: np.ndarray, rounds: int = 12, first: int = 2, drawn: int = 30, batch: int = 256, rate: float = 0.3, least: int = 8) -> Model:
    """Embedding table and softmax. In the first rounds ``drawn`` words of each
    text are learned from. A round has ``least`` steps at least, so that few labels are
    learned from as thoroughly as many."""
    bags, model = Bags(texts), Model()
    docs = [i for i, d in enumerate(bags.docs) if len(d)]
    if not docs or len(set(labels[docs].tolist())) < 2:
        model.bias[:] = 0, -20
        return model
    balance = len(docs) / 2 / np.bincount(labels[docs], minlength=2)
    distinct = {i: np.unique(bags.docs[i]) for i in docs}
    for turn in range(rounds):
        score = bags.means(model.line()[0]) if turn >= first else None
        for at in np.array_split(model.rng.permutation(docs), min(len(docs), max(least, len(docs) // batch))):
            chosen, of = [], []
            for i in at.tolist():
                if score is None:
                    d = bags.docs[i]
                    chosen.extend(d[a : a + 1] for a in model.rng.integers(0, len(d), drawn))
                    of.extend([i] * drawn)
                    continue
                d = distinct[i]
                by = d[np.argsort(-score[d], kind="stable")[: 2 * WORST]]
                chosen.append(by[:WORST])
                of.append(i)
                if not labels[i] and len(by) > WORST:  # and the next ones
                    chosen.append(by[WORST:])
                    of.append(i)
            y = labels[of]
            model.step(bags, chosen, y, balance[y] / len(of), rate)
    line, offset = model.line()
    score = bags.means(line)
    model.bias[:] = 0, threshold(np.array([worst(score[distinct[i]]) for i in docs]), labels[docs], offset)
    return model


def threshold(scores: np.ndarray, labels: np.ndarray, offset: float) -> float:
    """The offset at which the most training documents are classed rightly; of a gap
    between classes the middle."""
    order = np.argsort(scores)
    w, y = scores[order], labels[order]
    right = np.r_[0, np.cumsum(y == 0)] + (y == 1).sum() - np.r_[0, np.cumsum(y == 1)]
    best = np.nonzero(right == right.max())[0]
    at = best[len(best) // 2]
    if at in (0, len(w)):
        return offset
    return -float(w[at - 1] + w[at]) / 2


def sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded number of labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")).filter("y in (0, 1) and id is not null").filter(fold(F.col("id")) != 0)
    d = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).filter(f"t is not null and length(t) <= {longest}")
    taken = [known.filter(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    got = d.join(F.broadcast(taken[0].unionAll(taken[1])), "id").select("t", "y").toArrow()
    rows = sorted(zip(got.column("y").to_pylist(), got.column("t").to_pylist(), strict=True))
    return [t for _, t in rows], np.array([y for y, _ in rows], np.int64)


class Known(dict):
    """Log odds of words; when there are ``most``, those that weren't asked for since the
    last time are forgotten."""

    def __init__(self, line: np.ndarray, most: int):
        super().__init__()
        self.line, self.most = line.tolist(), most  # of single numbers lists are faster
        self.old: dict[str, float] = {}

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        x = self.old.get(word)
        if x is None:
            line, rows = self.line, grams(word)
            x = sum([line[i] for i in rows]) / len(rows)
        self[word] = x
        return x


def scorer(model: Model, keep: int = 150_000):
    """An Arrow function from texts to scores. The softmax is linear, so the log odds of an
    average are the average of the log odds, and those of a word are computed once."""
    line, offset = model.line()

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(line, keep)
        get = known.__getitem__
        for batch in batches:
            out: list[float] = []
            for t in batch.to_pylist():
                words = set(words_of(t)) if t else ()
                z = worst(np.fromiter(map(get, words), np.float64, len(words))) + offset if words else min(offset, -1.0)
                out.append(1 / (1 + float(np.exp(-max(-60.0, min(60.0, z))))))
            yield pa.array(out, pa.float64())

    return score


def with_score(docs: DataFrame, labels: DataFrame, name: str = "score", per_class: int = 2500, longest: int = 50_000, text_col: str = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """docs and one more column, the score of its text. Learned from ``learn_from``
    (doc_id, text; docs by default) and labels (doc_id, toxic)."""
    model = train(*sample(docs if learn_from is None else learn_from, labels, per_class, longest))
    return docs.withColumn(name, scorer(model)(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    d = with_score(docs.select("doc_id", "text"), labels)
    return d.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
