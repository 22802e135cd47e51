"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

The model predicts a word from the two before it: the context vector is c1 * r(w1) + c2 * r(w2), a word's
score its product with q(w) plus a bias. It has two levels. The first predicts one of the ``words`` most frequent training words, the end
of a text, or one of ``classes`` of all other words by their last two bytes. The second predicts, from the same context vector, the word within its
class: the next most frequent words, as many as ``GROWTH`` times the root of the number of distinct words, have vectors and biases of their own, and
so has the rest of each class, which a word takes a smoothed share (c + 0.1) / (mass of the rest) of; that mass has a slot of 0.1
for a word never seen. So probabilities are normalised over every word there is. With a context of two words the first level's normaliser of every
context is one matrix product, exp(A) diag(exp(b)) exp(B)', made once; the second's is a batched product over the words of the token's class.

Scale. Words are counted over all training texts with partial counts in the tasks. Counts of the ``head`` most
frequent words travel as a broadcast of fixed size; all other words of a text are joined to
the full table of counts, after they have been merged within their text. Training goes once over every training
text: each task runs noise-contrastive steps on all of its texts from the same start, and the parameters (about 200 KB, and 100 bytes for
each word of the second level: 10 MB for 600 million distinct words) are averaged by tokens in a tree of tasks, sixteen to one; the driver sees the last one.

Defined cases. A null or wordless text is the end token alone. Words are cut and lower-cased as bytes.
Without training rows c, N and V are 0, the base score is 0 and the model is its untrained start.
Repeated rows are scored each. A null id counts as the empty text for the fold. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import Shared, crc_bucket, pieces, with_row_id
from tidegraph.storage import materialize

END = b""
WORDS, CLASSES, DIMS, HEAD = 768, 255, 24, 1 << 17
NOISE, BATCH, RATE, SMOOTH = 32, 2048, 0.15, 0.1
#: Words of the second level for each root of the number of distinct words; noise words of a token there.
GROWTH, INNER_NOISE = 4, 1
BOS = 0


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """(token, c): how often each token (the end as the empty one) is in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["token", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(tokens(text))
                if len(seen) > 1 << 19:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above the lowest count that at most ``most`` words reach, by falling count.

    Counts are tallied by eighths of a doubling (some five hundred at most), so that no task sends more than
    its share of the words that are kept; a global top list would have every task send ``most`` candidates.
    It is taken only where the highest level alone has more words than that.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    tally = sorted(((r["k"], r["n"]) for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    lowest, total = None, 0
    for k, n in tally:
        total += n
        if total > most:
            break
        lowest = k
    # Where even the highest level holds too many, the words of highest counts, ties to the smaller word.
    rows = (counts.orderBy(F.desc("c"), "token").limit(most) if lowest is None else counts.where(step >= lowest)).collect()
    return sorted(((r["token"].encode(), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """The head words: their model id (0 is the start, then the words, then the classes) and count."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, kinds: int, mass: np.ndarray, second: int = 0):
        """head: with the end, by falling count; mass: of each class, its words' c + 0.1 and the slot of an unseen one; second: so many words have slots in their class."""
        self.total, self.kinds, self.mass = total, kinds, mass
        self.place = {w: i for i, (w, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], float)
        own = [END, *[w for w, _ in head if w != END][: WORDS - 1]]
        ids = {w: 1 + i for i, w in enumerate(own)}
        self.size = 1 + WORDS + CLASSES
        self.ids = np.array([ids.get(w) or 1 + WORDS + word_class(w) for w, _ in head], np.int64)
        in_model = np.bincount(self.ids, self.counts, self.size)
        p = in_model + SMOOTH
        p[1 + WORDS :] = mass
        p[BOS] = 0
        p[1 + len(own) : 1 + WORDS] = 0
        self.unigram = p / p.sum()
        # Slots lie by class, in each the rest of its words first.
        at = np.flatnonzero(self.ids > WORDS)[:second]
        of = self.ids[at] - 1 - WORDS
        order = np.argsort(of, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(1 + np.bincount(of, minlength=CLASSES))])
        self.slots = np.full(len(head), -1)
        self.slots[at[order]] = np.arange(len(at)) + of[order] + 1
        self.slot_mass = np.empty(self.starts[-1])
        self.slot_mass[self.slots[at]] = self.counts[at] + SMOOTH
        self.slot_mass[self.starts[:-1]] = np.maximum(mass - np.bincount(of, self.counts[at] + SMOOTH, CLASSES), SMOOTH)
        self.slot_log = np.log(self.slot_mass / np.repeat(np.add.reduceat(self.slot_mass, self.starts[:-1]), np.diff(self.starts)))

    def inner(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The slot of each token in its class; -1 for words of the first level."""
        slot = np.where(place < 0, -1, self.slots[place]) if len(self.slots) else np.full(len(ids), -1)
        rest = self.starts[np.maximum(ids - 1 - WORDS, 0)]
        return np.where(ids > WORDS, np.where(slot < 0, rest, slot), -1)

    def encode(self, texts: list[str | None]):
        """(model ids, head places, text numbers, tail tokens by position) of all tokens of the texts."""
        every: list[bytes] = []
        sizes = []
        for t in texts:
            words = tokens(t)
            sizes.append(len(words))
            every += words
        place = np.fromiter(map(self.place.get, every, repeat(-1)), np.int64, len(every))
        ids = self.ids[place] if len(self.ids) else np.zeros(len(place), np.int64)
        tail = np.flatnonzero(place < 0)
        words = [every[i] for i in tail.tolist()]
        ids[tail] = [1 if w == END else 1 + WORDS + word_class(w) for w in words]
        of = np.repeat(np.arange(len(texts)), sizes)
        return ids, place, of, tail, words

    def contexts(self, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids one and two places before, the start where the text has none."""
        one, two = np.zeros_like(ids), np.zeros_like(ids)
        one[1:] = np.where(of[1:] == of[:-1], ids[:-1], BOS)
        two[2:] = np.where(of[2:] == of[:-2], ids[:-2], BOS)
        return one, two


class LogBilinear:
    """r, q: (size, dims) context and word vectors; c: (2, dims) context weights; b: biases; inner_q, inner_b: of the slots in classes."""

    NAMES = "r", "q", "c", "b", "inner_q", "inner_b"

    def __init__(self, unigram: np.ndarray, dims: int = DIMS, seed: int = 5, slot_log: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        n = len(unigram)
        self.r, self.q = (rng.normal(0, 0.1, (n, dims)).astype(np.float32) for _ in range(2))
        self.c = np.array([np.full(dims, 1.0), np.full(dims, 0.5)], np.float32)
        self.b = np.log(np.maximum(unigram, 1e-12)).astype(np.float32)
        self.usable = unigram > 0
        self.inner_b = np.zeros(CLASSES, np.float32) if slot_log is None else slot_log.astype(np.float32)
        self.inner_q = np.zeros((len(self.inner_b), dims), np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def load(self, v: np.ndarray) -> LogBilinear:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, v[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def log_tables(self):
        """A[w1, w], B[w2, w] with the bias in A, and the log normaliser of every (w1, w2)."""
        a, b = (self.r * self.c[0]) @ self.q.T + self.b, (self.r * self.c[1]) @ self.q.T
        a[:, ~self.usable] = -np.inf
        top_a, top_b = a.max(axis=1), b.max(axis=1)
        with np.errstate(divide="ignore"):
            z = np.log(np.exp((a - top_a[:, None]).astype(np.float64)) @ np.exp((b - top_b[:, None]).astype(np.float64)).T)
        return a, b, (z + top_a[:, None] + top_b[None, :]).astype(np.float32)

    def inner_log(self, slot: np.ndarray, one: np.ndarray, two: np.ndarray, starts: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """Log probability of each slot in its class after the context, by one product a class (of ``most`` cells at a time)."""
        out, order = np.zeros(len(slot)), np.argsort(slot, kind="stable")
        cuts = np.searchsorted(slot[order], starts)
        for lo, hi, first, end in zip(starts[:-1], starts[1:], cuts[:-1], cuts[1:]):
            step = max(1, most // (hi - lo))
            # A class of one slot is certain.
            for at in range(first, end if hi - lo > 1 else first, step):
                some = order[at : min(at + step, end)]
                x = (self.c[0] * self.r[one[some]] + self.c[1] * self.r[two[some]]) @ self.inner_q[lo:hi].T + self.inner_b[lo:hi]
                own, top = x[np.arange(len(some)), slot[some] - lo], x.max(axis=1)
                out[some] = own - top - np.log(np.exp(x - top[:, None]).sum(axis=1, dtype=np.float64))
        return out


def scatter(grad: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, sums of their rows)."""
    order = np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")
    some = ids[order]
    first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
    return some[first], np.add.reduceat(grad[order], first, axis=0)


class Trainer:
    """Noise-contrastive steps with Adagrad; each minibatch shares its noise words, those within a class are each token's own."""

    def __init__(self, model: LogBilinear, vocabulary: Vocabulary, seed: int = 11):
        unigram = vocabulary.unigram
        self.m, self.rng = model, np.random.default_rng(seed)
        self.noise = np.cumsum(unigram)
        self.log_noise = np.log(np.maximum(unigram, 1e-12)).astype(np.float32)
        self.sums = {n: np.full(getattr(model, n).shape, 1e-2, np.float32) for n in model.NAMES}
        self.starts, self.slot_log = vocabulary.starts, vocabulary.slot_log.astype(np.float32)
        self.slot_noise = np.concatenate([[0], np.cumsum(vocabulary.slot_mass)])
        self.several = np.diff(vocabulary.starts) > 1


    def move(self, name: str, ids, grad) -> None:
        table, sums = getattr(self.m, name), self.sums[name]
        sums[ids] += grad * grad
        table[ids] += RATE * grad / np.sqrt(sums[ids])

    def inner_step(self, ctx: np.ndarray, k: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Move the slots of tokens of classes ``k``; the gradient of their contexts."""
        m, n = self.m, len(k)
        low, high = self.slot_noise[self.starts[k]][:, None], self.slot_noise[self.starts[k + 1]][:, None]
        z = np.searchsorted(self.slot_noise, low + self.rng.random((n, INNER_NOISE)) * (high - low), "right") - 1
        z = np.clip(z, self.starts[k][:, None], self.starts[k + 1][:, None] - 1)
        ids = np.concatenate([slot[:, None], z], axis=1)
        q = m.inner_q[ids]
        x = (q @ ctx[:, :, None])[:, :, 0] + m.inner_b[ids] - self.slot_log[ids] - np.float32(np.log(INNER_NOISE))
        g = -1 / (1 + np.exp(np.clip(-x, -30, 30)))
        g[:, 0] += 1
        out = (g[:, None, :] @ q)[:, 0, :]
        self.move("inner_q", *scatter((g[:, :, None] * ctx[:, None, :]).reshape(-1, ctx.shape[1]), ids.ravel()))
        some, g_b = scatter(g.reshape(-1, 1), ids.ravel())
        self.move("inner_b", some, g_b[:, 0])
        return out

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray, slot: np.ndarray) -> None:
        m, n = self.m, len(w)
        z = np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE) * self.noise[-1], "right"), len(self.noise) - 1)
        r1, r2 = m.r[one], m.r[two]
        ctx = m.c[0] * r1 + m.c[1] * r2
        qw, qz = m.q[w], m.q[z]
        k = np.float32(np.log(NOISE))
        good = (ctx * qw).sum(axis=1) + m.b[w] - self.log_noise[w] - k
        bad = ctx @ qz.T + (m.b[z] - self.log_noise[z] - k)
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        down = 1 / (1 + np.exp(np.clip(-bad, -30, 30)))
        g_ctx = up[:, None] * qw - down @ qz
        inside = np.flatnonzero(slot >= 0)
        inside = inside[self.several[w[inside] - 1 - WORDS]]
        if len(inside):
            g_ctx[inside] += self.inner_step(ctx[inside], w[inside] - 1 - WORDS, slot[inside])
        self.move("q", *scatter(np.concatenate([up[:, None] * ctx, -(down.T @ ctx)]), np.concatenate([w, z])))
        ids, g = scatter(np.concatenate([up, -down.sum(axis=0)])[:, None], np.concatenate([w, z]))
        self.move("b", ids, g[:, 0])
        self.move("r", *scatter(np.concatenate([m.c[0] * g_ctx, m.c[1] * g_ctx]), np.concatenate([one, two])))
        self.move("c", slice(None), np.stack([(g_ctx * r1).mean(axis=0), (g_ctx * r2).mean(axis=0)]) * min(n, 64))


def train_model(texts: DataFrame, vocabulary: Shared, unigram: np.ndarray) -> LogBilinear:
    """Parameters averaged over tasks that each go once over their texts."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        model = LogBilinear(v.unigram, slot_log=v.slot_log)
        trainer, done = Trainer(model, v), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, place, of, _, _ = v.encode(part.column("text").to_pylist())
                one, two = v.contexts(ids, of)
                slot = v.inner(ids, place)
                # Tokens of a piece in a seeded order, so that a step sees many texts.
                order = np.random.default_rng(len(ids)).permutation(len(ids))
                for at in range(0, len(ids), BATCH):
                    some = order[at : at + BATCH]
                    trainer.step(ids[some], one[some], two[some], slot[some])
                done += len(ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64()), pa.array([model.vector().tobytes()], pa.binary())], names=["tokens", "model"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, summed = 0, None
        for batch in batches:
            for n, raw in zip(batch.column("tokens").to_pylist(), batch.column("model").to_pylist()):
                v = np.frombuffer(raw, np.float32) * np.float64(n)
                total, summed = total + n, v if summed is None else summed + v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([(summed / total).astype(np.float32).tobytes()], pa.binary())], names=["tokens", "model"])

    schema = "tokens long, model binary"
    models, parts = texts.select("text").mapInArrow(learn, schema), texts.rdd.getNumPartitions()
    while True:
        parts = max(1, -(-parts // 16))
        models = models.repartition(parts).mapInArrow(average, schema)
        if parts == 1:
            break
    row, model = models.first(), LogBilinear(unigram, slot_log=vocabulary.value.slot_log)
    return model.load(np.frombuffer(row["model"], np.float32)) if row else model


class Scorer:
    """Vocabulary and model; tables are made once in a worker."""

    def __init__(self, vocabulary: Vocabulary, model: LogBilinear):
        self.vocabulary, self.model, self.tables = vocabulary, model, None

    def measure(self, texts: list[str | None]):
        """Tokens, known head tokens, sums of log10 (c + 0.1) over head tokens, model sums without tail words' counts; and the tail."""
        v = self.vocabulary
        if self.tables is None:
            a, b, z = self.model.log_tables()
            logs = np.log10(v.counts + SMOOTH)
            # Of words that share the rest of their class.
            rest = np.where((v.ids > WORDS) & (v.slots < 0), logs, 0.0)
            share = np.zeros(v.starts[-1] + 1)
            share[v.starts[:-1]] = -np.log10(v.slot_mass[v.starts[:-1]])
            self.tables = a, b, z, np.append(logs, 0.0), np.append(rest, 0.0), share, np.append(v.counts > 0, False)
        a, b, z, logs, rest, share, known = self.tables
        ids, place, of, tail, words = v.encode(texts)
        one, two = v.contexts(ids, of)
        n = len(texts)
        model = a[one, ids] + b[two, ids] - z[one, two].astype(np.float64)
        slot = v.inner(ids, place)
        inside = np.flatnonzero(slot >= 0)
        model[inside] += self.model.inner_log(slot[inside], one[inside], two[inside], v.starts)
        model = model / np.log(10.0) + share[slot] + rest[place]
        total = lambda x: np.bincount(of, x, n)
        return total(None), total(known[place]), total(logs[place]), total(model), of[tail], words


def score_texts(docs: DataFrame, train_where, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, train_tokens, base_score and score for every row; learns from the rows of ``train_where``."""
    spark = docs.sparkSession
    training = docs.where(train_where).select("text")
    counts = materialize(count_words(training))
    last = F.crc32(F.substring(F.col("token").cast("binary"), -2, 2)) % CLASSES
    by_class = counts.where("token != ''").groupBy(last.cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    end = counts.where("token = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    total, kinds = end + sum(r["c"] for r in by_class), sum(r["n"] for r in by_class) + (end > 0)
    second = int(GROWTH * kinds**0.5)
    head = [(END, end), *frequent(counts.where("token != ''"), max(HEAD, WORDS + second))]
    mass = np.full(CLASSES, SMOOTH)
    for r in by_class:
        mass[r["k"]] += r["c"] + SMOOTH * r["n"]
    for w, c in head[1:WORDS]:
        mass[word_class(w)] -= c + SMOOTH
    vocabulary = Vocabulary(head, total, kinds, np.maximum(mass, SMOOTH), second)
    model = train_model(training, Shared(spark, vocabulary), vocabulary.unigram)
    shared = Shared(spark, Scorer(vocabulary, model))

    rows = with_row_id(docs.select(*keep, "text"), "__row").select("__row", *keep, "text")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n_tokens, known, base, made, tail_of, tail = shared.value.measure(part.column("text").to_pylist())
                n = len(part)
                row = part.column("__row")
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                own = pa.array([f" {r}" for r in row.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*kept, own, pa.array(np.ones(n, bool)), pa.array(n_tokens, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(made)], names=names)
                if tail:
                    merged = Counter(zip(tail_of.tolist(), tail))
                    at = pa.array([i for i, _ in merged], pa.int64())
                    m = len(merged)
                    yield pa.RecordBatch.from_arrays([row.take(at), *[pa.nulls(m, c.type) for c in kept[1:]], pa.array([w.decode() for _, w in merged], pa.string()), pa.array(np.zeros(m, bool)), pa.array(merged.values(), pa.int64()), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m)), pa.array(np.zeros(m))], names=names)

    # One stream of two kinds of row: a text's sums (under a token no word can be) and its merged tail words.
    names = ["__row", *keep, "token", "whole", "n", "known", "base", "made"]
    stream = rows.mapInArrow(run, ", ".join([*types, "token string, whole boolean, n long, known long, base double, made double"]))
    looked = stream.join(counts, "token", "left")
    tail_log = F.when(~F.col("whole"), F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + SMOOTH)).otherwise(0.0)
    per = looked.groupBy("__row").agg(
        *[F.max(F.when(F.col("whole"), F.col(c))).alias(c) for c in keep],
        F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("n_tokens"),
        F.sum(F.col("known") + F.when(~F.col("whole") & F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + tail_log).alias("base"),
        F.sum(F.col("made") + tail_log).alias("score"),
    )
    floor = float(np.log10(total + SMOOTH * (kinds + 1)))
    return per.select(*keep, "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score")


def op5_language_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_bucket("doc_id", 10) == 0
    out = score_texts(docs.withColumn("held_out", held), ~held, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
