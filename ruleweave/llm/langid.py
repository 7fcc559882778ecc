"""Language ID by a linear-chain conditional random field over words.

Each word is labelled with a language; the score of a labelling is the sum of
word scores (affixes and inner n-grams of its UTF-8 bytes, hashed, and its entry
in a lexicon) and of learned transitions between neighbouring labels, so single
odd words are judged by their context and switches of language cost what they
cost in the training data. Forward-backward gives each word's probabilities; a
document's language is the label with the largest mean probability, which is its
score.

Whole labelled texts are cut into passages of PASSAGE characters; training takes
at most TRAIN_ROWS of these labelled rows, drawn by a hash from all of them and
spread over the languages (each has one at least). They are joined into sequences
that switch language now and then. It maximises the conditional likelihood by
Adagrad on the driver; the bound doesn't depend on the input. The model (a few
MB) is broadcast. Prediction reads whole texts, cut into blocks of 64 words whose
transfer matrices are multiplied, so long texts cost no more than short ones.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ruleweave.llm.common import frugal, worker_cache

#: Labelled passages in training, at most, and their characters; words that a worker remembers, and their characters at most.
TRAIN_ROWS, PASSAGE, REMEMBERED, WIDEST = 1600, 1500, 300_000, 64
#: Buckets of hashed n-grams, bytes of n-grams, words of a block, words handled at once.
BUCKETS, SIZES, BLOCK, AT_ONCE = 1 << 16, (2, 3, 4, 5), 64, 300_000
#: Training: sequences' words, words between switches on average, passes, rate, weight decay.
SEQUENCE, SWITCH, PASSES, RATE, DECAY = 48, 24, 12, 0.3, 1e-6
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def split_words(text: str) -> list[str]:
    """Runs of letters. Numbers such as one half, which the pattern takes for letters, stand between words."""
    found = WORD.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for part in found for w in ("".join(c if c.isalpha() else " " for c in part).split() if not part.isalpha() else [part])]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of the words between a begin and an end mark."""
    text = b"".join(b"\x01" + w.encode() + b"\x02" for w in words)
    data = np.frombuffer(text, np.uint8)
    word = np.cumsum(data == 1) - 1
    value = data.astype(np.uint64)
    rows, found, rolled = [], [], value
    for n in range(2, max(SIZES) + 1):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + value[n - 1 :]
        if n in SIZES and len(rolled):
            whole = word[: len(rolled)] == word[n - 1 :]
            mixed = rolled * np.uint64(0x9E3779B97F4A7C15)
            rows.append(word[: len(rolled)][whole])
            found.append((mixed >> np.uint64(48)).astype(np.int64)[whole] & (BUCKETS - 1))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found)


class Field:
    """The conditional random field: labels, weights of n-grams, of lexicon entries (0: unknown word) and of transitions."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.ngram = np.zeros((BUCKETS, n), np.float32)
        self.entry = np.zeros((len(lexicon) + 1, n), np.float32)
        self.move = np.zeros((n, n), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        row, bucket = grams(words)
        out = np.stack([np.bincount(row, self.ngram[bucket, k], len(words)) for k in range(len(self.labels))], axis=1)
        return (out + self.entry[np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))]).astype(np.float32)

    def fit(self, sequences: list[tuple[list[str], list[int]]], seed: int = 7) -> None:
        n, rng = len(self.labels), np.random.default_rng(seed)
        vocabulary = {w: i for i, w in enumerate(sorted({w for ws, _ in sequences for w in ws}))}
        names = list(vocabulary)
        row, bucket = grams(names)
        order = np.argsort(row, kind="stable")
        bucket, ends = bucket[order], np.cumsum(np.bincount(row, minlength=len(names)))
        entry = np.fromiter((self.lexicon.get(w, 0) for w in names), np.int64, len(names))
        squares = [np.full(w.shape, 1e-3, np.float32) for w in (self.ngram, self.entry, self.move)]
        for _ in range(PASSES):
            shuffled = rng.permutation(len(sequences))
            for at in range(0, len(shuffled), 256):
                part = [sequences[i] for i in shuffled[at : at + 256]]
                steps = max(len(ws) for ws, _ in part)
                ids = np.zeros((len(part), steps), np.int64)
                gold = np.zeros((len(part), steps), np.int64)
                mask = np.zeros((len(part), steps), bool)
                for i, (ws, ls) in enumerate(part):
                    ids[i, : len(ws)], gold[i, : len(ws)], mask[i, : len(ws)] = [vocabulary[w] for w in ws], ls, True
                used, at_word = np.unique(ids[mask], return_inverse=True)
                each = np.concatenate([bucket[ends[w - 1] if w else 0 : ends[w]] for w in used.tolist()])
                times = ends[used] - np.where(used > 0, ends[used - 1], 0)
                owner = np.repeat(np.arange(len(used)), times)
                scores = np.stack([np.bincount(owner, self.ngram[each, k], len(used)) for k in range(n)], axis=1) + self.entry[entry[used]]
                x = np.ones((len(part), steps, n))
                x[mask] = np.exp(scores - scores.max(axis=1, keepdims=True))[at_word]
                move = np.exp(self.move.astype(np.float64))
                node, edge = marginals(x, mask, move)
                error = -node
                error[np.arange(len(part))[:, None], np.arange(steps)[None, :], gold] += 1
                by_word = np.stack([np.bincount(at_word, error[mask][:, k], len(used)) for k in range(n)], axis=1)
                both = mask[:, 1:]
                steps_seen = np.zeros((n, n))
                np.add.at(steps_seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
                size = mask.sum()
                gradients = [np.stack([np.bincount(each, by_word[owner, k], BUCKETS) for k in range(n)], axis=1), np.stack([np.bincount(entry[used], by_word[:, k], len(self.entry)) for k in range(n)], axis=1), steps_seen - edge]
                for weights, square, gradient in zip((self.ngram, self.entry, self.move), squares, gradients):
                    gradient = gradient / size - DECAY * weights
                    square += gradient**2
                    weights += (RATE * gradient / np.sqrt(square)).astype(np.float32)


def marginals(x: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: (probabilities by step, expected transitions)."""
    m, steps, n = x.shape
    forward, backward = np.ones((m, steps, n)) / n, np.ones((m, steps, n))
    f = np.ones((m, n)) / n
    for t in range(steps):
        g = (f @ move) * x[:, t]
        f = np.where(mask[:, t, None], g / g.sum(axis=1, keepdims=True), f)
        forward[:, t] = f
    b = np.ones((m, n))
    for t in range(steps - 1, 0, -1):
        g = (x[:, t] * b) @ move.T
        b = np.where(mask[:, t, None], g / g.sum(axis=1, keepdims=True), b)
        backward[:, t - 1] = b
    node = forward * backward
    node /= node.sum(axis=2, keepdims=True)
    pair = forward[:, :-1, :, None] * move * (x[:, 1:] * backward[:, 1:])[:, :, None, :]
    pair = pair[mask[:, 1:]]
    return node, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def word_probabilities(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of texts laid end to end (none of them empty)."""
    n = scores.shape[1]
    move = np.exp(transitions.astype(np.float64))
    blocks = -(-sizes // BLOCK)
    first_block, first = np.cumsum(blocks) - blocks, np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(scores)) - first[text]
    block, step = first_block[text] + place // BLOCK, place % BLOCK
    m = int(blocks.sum())
    x = np.ones((BLOCK, m, n))
    x[step, block] = np.exp(scores - scores.max(axis=1, keepdims=True))
    length = np.bincount(block, minlength=m)
    # Transfer matrix of each block, then its entry and exit vectors, text by text in step.
    matrix = np.broadcast_to(np.eye(n), (m, n, n)).copy()
    by_length = np.argsort(-length, kind="stable")
    x, rank = x[:, by_length], np.empty(m, np.int64)
    rank[by_length] = np.arange(m)
    active = [int(k) for k in np.searchsorted(-length[by_length], -np.arange(BLOCK), side="left")]
    for t in range(BLOCK):
        k = active[t]
        part = (matrix[:k].reshape(-1, n) @ move).reshape(k, n, n) * x[t, :k, None, :]
        matrix[:k] = part / part.sum(axis=(1, 2), keepdims=True)
    entry, leave = np.ones((m, n)) / n, np.ones((m, n))
    texts = np.argsort(-blocks, kind="stable")
    f = np.ones((len(texts), n)) / n
    most = int(blocks.max()) if len(blocks) else 0
    alive = [int(k) for k in np.searchsorted(-blocks[texts], -np.arange(most), side="left")]
    for i in range(most):
        k = alive[i]
        at = rank[first_block[texts[:k]] + i]
        entry[at] = f[:k]
        g = np.einsum("ij,ijk->ik", f[:k], matrix[at])
        f[:k] = g / g.sum(axis=1, keepdims=True)
    b = np.ones((len(texts), n))
    for i in range(most - 1, -1, -1):
        k = alive[i]
        at = rank[first_block[texts[:k]] + i]
        leave[at] = b[:k]
        g = np.einsum("ijk,ik->ij", matrix[at], b[:k])
        b[:k] = g / g.sum(axis=1, keepdims=True)
    forward = np.empty((BLOCK, m, n))
    f = entry
    for t in range(BLOCK):
        k = active[t]
        g = (f[:k] @ move) * x[t, :k]
        f[:k] = g / g.sum(axis=1, keepdims=True)
        forward[t] = f
    b = leave
    for t in range(BLOCK - 1, -1, -1):
        k = active[t]
        forward[t, :k] *= b[:k]
        g = (x[t, :k] * b[:k]) @ move.T
        b[:k] = g / g.sum(axis=1, keepdims=True)
    found = forward[step, rank[block]]
    return found / found.sum(axis=1, keepdims=True)


class Labeller:
    """Word scores that a worker remembers, for one field."""

    def __init__(self, field: Field):
        self.field, self.index, self.scores, self.held = field, {}, np.zeros((0, len(field.labels)), np.float32), 0

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores of the words, which are looked up once per distinct word; long words are not remembered."""
        distinct = set(words)
        long = sorted(w for w in distinct if len(w) > WIDEST)
        new = list(distinct - self.index.keys() - set(long))
        if len(self.index) + len(new) > REMEMBERED:
            self.index, self.held, new = {}, 0, list(distinct - set(long))
        need = self.held + len(new) + len(long)
        if need > len(self.scores):
            grown = np.zeros((max(2 * len(self.scores), need), len(self.field.labels)), np.float32)
            grown[: self.held] = self.scores[: self.held]
            self.scores = grown
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.scores[self.held : self.held + len(part)] = self.field.emissions(part)
            self.index.update(zip(part, range(self.held, self.held + len(part))))
            self.held += len(part)
        if not long:
            return self.scores[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]
        for i, word in enumerate(long):
            self.scores[self.held + i] = self.field.emissions([word])[0]
        place = {w: self.held + i for i, w in enumerate(long)}
        return self.scores[np.fromiter((place[w] if len(w) > WIDEST else self.index[w] for w in words), np.int64, len(words))]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.field.labels:
            return out
        held, words, sizes = [], [], []
        for i, text in enumerate(texts):
            own = split_words(text.lower()) if text else []
            if own:
                held.append(i)
                words += own
                sizes.append(len(own))
            if held and (len(words) >= AT_ONCE or i == len(texts) - 1):
                self._finish(out, held, words, np.array(sizes))
                held, words, sizes = [], [], []
        if held:
            self._finish(out, held, words, np.array(sizes))
        return out

    def _finish(self, out: list, held: list[int], words: list[str], sizes: np.ndarray) -> None:
        found = word_probabilities(self.rows(words), sizes, self.field.move)
        mean = np.add.reduceat(found, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        best = mean.argmax(axis=1)
        for i, k, score in zip(held, best.tolist(), mean[np.arange(len(best)), best].tolist()):
            out[i] = (self.field.labels[k], min(1.0, max(0.0, score)))


def label_words(field: Field, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of a text."""
    words = split_words(text)
    if not words:
        return []
    found = word_probabilities(field.emissions([w.lower() for w in words]), np.array([len(words)]), field.move)
    return [(w, field.labels[k], float(p[k])) for w, p, k in zip(words, found, found.argmax(axis=1).tolist())]


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> Field:
    """Fit a field to at most `most` passages (one a language at least) of rows with a language and a text whose id is not held out.

    Rows with a null id, language or text are left out, empty texts have no
    passage, repeated rows weigh as often as they stand. Without any passage the
    field has no labels and calls everything `und`. Other columns are not read.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    last = F.floor((F.length("text") - 1) / PASSAGE).cast("int")
    known = known.where(F.length("text") > 0)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(last + 1).alias("n")).collect()}  # a row a language
    if not counts:
        return Field([], {})
    labels, each = sorted(counts), max(1, most // len(counts))
    rate = F.create_map(*[F.lit(v) for lang in labels for v in (lang, math.ceil(1_000_000 * min(1.0, 2.0 * each / counts[lang])))])
    # Texts stay behind the draw: only passages that are drawn are cut out.
    drawn = known.select("*", F.filter(F.sequence(F.lit(0), last), lambda k: F.pmod(F.xxhash64(F.lit("sample"), "id", k), F.lit(1_000_000)) < rate[F.col("lang")]).alias("ks")).where(F.size("ks") > 0)
    drawn = drawn.select("lang", "id", F.explode(F.transform("ks", lambda k: F.struct(k.alias("k"), F.substring("text", k * PASSAGE + 1, F.lit(PASSAGE)).alias("text")))).alias("p")).select("lang", "id", "p.*")
    picked = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("order"), "id", "k"), "id", "k"))).where(F.col("at") <= each)
    rows = picked.select("lang", "text", "at").orderBy("lang", "at").collect()
    place = {lang: i for i, lang in enumerate(labels)}
    passages = [(place[r["lang"]], split_words(r["text"].lower())) for r in rows]
    counted = Counter(w for _, ws in passages for w in ws)
    frequent = [w for w, c in sorted(counted.items(), key=lambda x: (-x[1], x[0])) if c > 1]
    lexicon = {w: i for i, w in enumerate(frequent, 1)}
    rng = np.random.default_rng(11)
    pieces = []
    for k, ws in passages:
        at = 0
        while at < len(ws):
            size = 1 + int(rng.geometric(1 / SWITCH))
            pieces.append((k, ws[at : at + size]))
            at += size
    sequences, words, gold = [], [], []
    for i in rng.permutation(len(pieces)).tolist():
        k, ws = pieces[i]
        words, gold = words + ws, gold + [k] * len(ws)
        while len(words) >= SEQUENCE:
            sequences.append((words[:SEQUENCE], gold[:SEQUENCE]))
            words, gold = words[SEQUENCE:], gold[SEQUENCE:]
    if words:
        sequences.append((words, gold))
    field = Field(labels, lexicon)
    if sequences:
        field.fit(sequences)
    return field


def predict(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id_col, held_out, lang_pred and score of every row; one pass, no shuffle.

    Texts without a letter, null ones too, are `und` with score 0; a null id is
    held in; repeated rows give repeated results; other columns are dropped.
    """
    found = annotate(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), field, "text")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def annotate(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, with __lang and __score (columns of these names are replaced)."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field.__dict__))
    docs = docs.drop("__lang", "__score")
    at, names = docs.columns.index(text_col), docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever their names, dots too
    schema = StructType([*docs.schema.fields, StructField("__lang", StringType()), StructField("__score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Labeller:
            own = Field([], {})
            own.__dict__.update(pickle.loads(model.value))
            return Labeller(own)

        labeller = worker_cache(("langid", hash(model.value)), make)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = labeller.label(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*part.schema.names, "__lang", "__score"])

    return docs.mapInArrow(frugal(run, "langid"), schema).toDF(*names, "__lang", "__score")


def accepted(docs: DataFrame, field: Field, margin: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, whose language is determined.

    The score is the largest of n mean probabilities, so it is 1 / n or more. It
    is determined if it lies above that by `margin` of what is possible:
    (n * score - 1) / (n - 1) >= margin, whatever the number of languages. Texts
    without a letter, null ones too, are not. Null ids, repeated rows and empty
    tables are no special case.
    """
    n = len(field.labels)
    sure = F.col("__score") * n - 1 >= margin * (n - 1) if n > 1 else F.lit(True)
    return annotate(docs, field, text_col).where((F.col("__lang") != UNDETERMINED) & sure).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
