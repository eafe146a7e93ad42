"""Brown class-based bigram language model.

Word counts cover the whole training corpus. The CORE most frequent words are put into CLASSES classes by exchange
clustering on their bigram counts. Then every other word that the training texts hold at least LEAST times is put, on
executors, into the class that most raises the class bigram likelihood, by all its neighbours; the vocabulary with
classes grows with the corpus. Sweeps over all these words and the core go on with the exchange, each word against the
class table of the sweep before, until the likelihood settles; neighbours keep the classes that the core had at first.
Rarer words form the rare class, with their own exact counts, where unknown words fall too. A token's probability is P(class | class before) * P(word | class), with transitions counted over all classes.
Workers know the HEAD most frequent words (a bounded table); rarer words meet their class and count in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import hot_keys, materialize, salted_join
from readloom.plans.ranking import ranked

CORE, CLASSES, PASSES = 2000, 48, 6
#: Occurrences from which a word gets a class.
LEAST = 3
HEAD, HEAD_BYTES = 200_000, 64
#: Longer words are rare; should one be frequent all the same, its rows are split.
ALPHA = 0.1
WORDS_AT_ONCE = 500
#: Sweeps over all words at most; they end when one raises the log likelihood by less than SETTLED for each neighbour.
SWEEPS, SETTLED = 6, 1e-3


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return (text or b"").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of text is not counted here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                held.update(tokens(t))
                if len(held) > 300_000:
                    yield from out(held)
        yield from out(held)

    def out(held: Counter) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> pa.Table:
    """(word, n) of the ``size`` most frequent words of at most HEAD_BYTES, ties in the order of their bytes.

    The counts tell from which on words are asked for; those are numbered by a sort on executors, so that no more than
    ``size`` words reach the driver, and those in columns.
    """
    short = counts.filter(F.length("word") <= HEAD_BYTES)
    sizes = short.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow()  # a row for each number of occurrences
    n, words = (sizes.column(x).to_numpy().astype(np.int64) for x in ("n", "words"))
    down = np.argsort(-n)
    held = np.cumsum(words[down])
    least = int(n[down][min(np.searchsorted(held, size), len(held) - 1)]) if len(held) else 0
    order = ranked(short.filter(F.col("n") >= least), [F.col("n").desc(), F.col("word").asc()], "id")
    return order.filter(F.col("id") < size).orderBy("id").select("word", "n").toArrow()


def _tails(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, t, n, cls) of each text's words outside the head: place, times here, count and class."""
    col = batch.column("tail")
    size = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    flat, a = col.flatten(), 0
    every = [flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("i", "t", "n", "cls")]
    for n in size.tolist():
        yield tuple(x[a : a + n] for x in every)
        a += n


def _flat(batch: pa.RecordBatch, head: int) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The ids of a batch's texts one after the other, -1 at each end; ids from ``head`` on are places in the words."""
    words = pa.concat_arrays([batch.column("words").flatten()]).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out, done = [], 0
    for x, n in zip(batch.column("ids").to_pylist(), batch.column("words").value_lengths().to_pylist(), strict=True):
        ids = np.frombuffer(x, np.int32).astype(np.int64)
        tail = ids >= head
        ids[tail] = head + code[done + ids[tail] - head]
        out += [ids, np.full(1, -1)]
        done += n
    return np.concatenate(out) if out else np.zeros(0, np.int64), words.dictionary


def coded(docs: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """(ident, train, ids, words, times): 32-bit ids of a text's words, and its words outside ``head``, whose ids follow."""
    sent = docs.sparkSession.sparkContext.broadcast(head)
    kind = docs.schema["ident"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = sent.value, len(sent.value)
        for batch in batches:
            ids, words, times = [], [], []
            for t in batch.column("text").to_pylist():
                ws = tokens(t)
                x = np.fromiter((known.get(w, -1) for w in ws), np.int32, len(ws))
                at = np.nonzero(x < 0)[0]
                own: dict[bytes, int] = {}
                x[at] = [n + own.setdefault(ws[i], len(own)) for i in at.tolist()]
                ids.append(x.tobytes())
                words.append(list(own))
                times.append(np.bincount(x[at] - n, minlength=len(own)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("ident"), batch.column("train"), pa.array(ids, pa.binary()), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], ["ident", "train", "ids", "words", "times"])

    return docs.mapInArrow(run, f"ident {kind}, train boolean, ids binary, words array<binary>, times array<long>")


def bigrams(codes: DataFrame, core: int) -> np.ndarray:
    """Counts of neighbours among the ``core`` first ids, ``core`` for other words and core + 1 for the text's ends."""
    width = core + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width * width, np.int64)
        for batch in batches:
            x = np.concatenate([[width - 1], *[np.append(np.minimum(np.frombuffer(b, np.int32), core), width - 1) for b in batch.column("ids").to_pylist()]]).astype(np.int64)
            held += np.bincount(x[:-1] * width + x[1:], minlength=width * width)
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["pair", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(i).to_numpy().tobytes()], pa.binary()) for i in (0, 1)], ["pair", "n"])

    summed = codes.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(width * width)
    for r in summed.mapInArrow(packed, "pair binary, n binary").toLocalIterator():  # at most width^2 numbers, a partition at a time
        out[np.frombuffer(r["pair"], np.int64)] = np.frombuffer(r["n"], np.int64)
    return out.reshape(width, width)


NEAR = "array<struct<ctx:smallint,n:bigint>>"


def _near(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(size, ctx, n, total): how many classes of neighbours each word has, these with their counts, and the word's count."""
    flat = batch.column("near").flatten()
    ctx, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("ctx", "n"))
    return batch.column("near").value_lengths().to_numpy(), ctx.astype(np.int64), n.astype(np.float64), batch.column("n").to_numpy().astype(np.float64)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


class Places:
    """What words add to the likelihood in each class; ``table`` has a class's successors, then its predecessors, by class."""

    def __init__(self, table: np.ndarray) -> None:
        k = table.shape[1] // 2
        self.to = np.ascontiguousarray(table.T)
        self.base = _xlogx(self.to)
        self.rows, self.cols = table[:, :k].sum(1), table[:, k:].sum(1)

    def likelihood(self) -> float:
        """The log likelihood of all neighbours given the classes, but for a constant."""
        return float(self.base.sum() - _xlogx(self.rows).sum() - _xlogx(self.cols).sum())

    def best(self, size: np.ndarray, ctx: np.ndarray, n: np.ndarray, total: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """The class where each word adds most; words with a class of their own are taken out of it first, and stay on a tie."""
        if not len(size):
            return np.zeros(0, np.int32)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        gain = np.add.reduceat(_xlogx(self.to[ctx] + n[:, None]) - self.base[ctx], begin)
        for margin in (self.rows, self.cols):
            gain -= _xlogx(margin + total[:, None]) - _xlogx(margin)
        if own is None:
            return gain.argmax(1).astype(np.int32)
        here = self.to[ctx, np.repeat(own, size)]
        stay = np.add.reduceat(_xlogx(here) - _xlogx(here - n), begin)
        for margin in (self.rows, self.cols):
            stay -= _xlogx(margin[own]) - _xlogx(margin[own] - total)
        each = np.arange(len(own))
        gain[each, own] = -np.inf
        to = gain.argmax(1)
        return np.where(gain[each, to] > stay + 1e-9, to, own).astype(np.int32)


def assigned(codes: DataFrame, head: list[bytes], own: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, id, n, near, cls) of the words outside the core that occur LEAST times; id is null outside ``head``.

    ``own`` has the classes of the core, ``table`` the class bigrams in which all other words are one class. A word's
    neighbours are counted by class, and the word goes where it adds most to the likelihood of the class bigrams.
    """
    core, k, n_head = len(own) - 2, len(table), len(head)
    classes, rare, end = k - 2, k - 2, k - 1
    sent = codes.sparkSession.sparkContext.broadcast((own, table))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.append(sent.value[0][:core], [end])  # -1 is the end
        for batch in batches:
            x, words = _flat(batch, n_head)
            if not len(x):
                continue
            c = np.where(x < core, of[np.minimum(x, core)], rare)
            at = np.nonzero(x >= core)[0]
            # a text's last id is -1, so that a word always has a successor
            keys = np.concatenate([x[at] * 2 * k + c[at + 1], x[at] * 2 * k + k + np.where(at > 0, c[at - 1], end)])
            key, n = np.unique(keys, return_counts=True)
            word, ctx = key // (2 * k), key % (2 * k)
            tail = word >= n_head
            code = pa.array(np.maximum(word - n_head, 0), mask=~tail)
            yield pa.RecordBatch.from_arrays([words.take(code), pa.array(word.astype(np.int32), mask=tail), pa.array(ctx.astype(np.int16)), pa.array(n, pa.int64())], ["word", "id", "ctx", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value[1]
        places = Places(np.concatenate([t[:classes], t[:, :classes].T], axis=1))
        for whole in batches:
            for a in range(0, whole.num_rows, WORDS_AT_ONCE):
                batch = whole.slice(a, WORDS_AT_ONCE)
                cls = places.best(*_near(batch))
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("word", "id", "n", "near")], pa.array(cls)], ["word", "id", "n", "near", "cls"])

    # frequent words meet on the map side, and each of their contexts in a task of its own, before the words do
    met = codes.select("ids", "words").mapInArrow(near, "word binary, id int, ctx short, n long").groupBy("word", "id", "ctx").agg(F.sum("n").alias("n"))
    # each occurrence has one successor and one predecessor
    by = met.groupBy("word", "id").agg((F.sum("n") / 2).cast("long").alias("n"), F.collect_list(F.struct("ctx", "n")).alias("near")).filter(F.col("n") >= LEAST)
    return by.mapInArrow(choose, f"word binary, id int, n long, near {NEAR}, cls int")


def swept(words: DataFrame, own: np.ndarray, near: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """``words`` and the classes of the core after sweeps in which every word may move.

    ``words`` is what ``assigned`` gives, ``near`` has the core's neighbours by class, successors before predecessors.
    All words of a sweep move at once, against the same table; one that would lower the likelihood is not taken.
    """
    spark, (core, width) = words.sparkSession, near.shape
    classes, own = width // 2 - 2, own[:core].copy()
    at, ctx = np.nonzero(near)
    first = np.searchsorted(at, np.arange(core + 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(classes * width, np.int64)
        for batch in batches:
            size, ctx, n, _ = _near(batch)
            np.add.at(held, np.repeat(batch.column("cls").to_numpy().astype(np.int64), size) * width + ctx, n.astype(np.int64))
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["place", "n"])

    def table(words: DataFrame, own: np.ndarray) -> np.ndarray:
        out = np.zeros((classes, width))
        np.add.at(out, own, near)
        sums = words.select("n", "near", "cls").mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # at most classes * width
        out.ravel()[sums["place"].to_numpy(np.int64)] += sums["n"].to_numpy(np.float64)
        return out

    def moved(words: DataFrame, t: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast(t)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = Places(sent.value)
            for whole in batches:
                for a in range(0, whole.num_rows, WORDS_AT_ONCE):
                    batch = whole.slice(a, WORDS_AT_ONCE)
                    cls = places.best(*_near(batch), batch.column("cls").to_numpy())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cls)], batch.schema.names)

        return words.select("word", "id", "n", "near", "cls").mapInArrow(run, f"word binary, id int, n long, near {NEAR}, cls int")

    t = table(words, own)
    best = Places(t).likelihood()
    for _ in range(SWEEPS):
        places, theirs = Places(t), own.copy()
        for a in range(0, core, WORDS_AT_ONCE):
            b = min(core, a + WORDS_AT_ONCE)
            some = slice(first[a], first[b])
            theirs[a:b] = places.best(np.diff(first[a : b + 1]), ctx[some], near[at[some], ctx[some]], near[a:b].sum(1) / 2, own[a:b])
        next_words = materialize(moved(words, t))
        next_t = table(next_words, theirs)
        found = Places(next_t).likelihood()
        if found > best:
            words, own, t = next_words, theirs, next_t
        if found - best <= SETTLED * t.sum():
            break
        best = found
    return words, own


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """A class for each row of ``pairs``: words move to the class that most raises the class bigram likelihood.

    The last two rows (rare words, ends) stay in classes of their own.
    """
    n = len(pairs) - 2
    classes = max(1, min(classes, n))
    own = np.append(np.arange(n) % classes, [classes, classes + 1])
    k = classes + 2
    member = np.zeros((len(pairs), k))
    member[np.arange(len(pairs)), own] = 1
    counts = pairs.astype(np.float64, copy=False)
    right, left = counts @ member, counts.T @ member  # of each word: its successors' and predecessors' classes
    table = member.T @ right
    loops = counts.diagonal()
    f = lambda x: x * np.log(np.maximum(x, 1.0))

    for _ in range(passes):
        moved = 0
        for w in range(n):
            a, r, q, d = own[w], right[w].copy(), left[w].copy(), loops[w]
            r[a] -= d
            q[a] -= d
            # without w
            t = table.copy()
            t[a, :] -= r
            t[:, a] -= q
            t[a, a] -= d
            rows, cols = t.sum(1), t.sum(0)
            base_r, base_c = f(t).sum(1), f(t).sum(0)
            gain = np.full(k, -np.inf)
            plus_r, plus_c = f(t + r[None, :]).sum(1) - base_r, f(t + q[:, None]).sum(0) - base_c
            diag = t.diagonal()
            both = f(diag + r + q + d) - f(diag + r) - f(diag + q) + f(diag)
            cand = plus_r + plus_c + both - (f(rows + r.sum() + d) - f(rows)) - (f(cols + q.sum() + d) - f(cols))
            # the margins of the other classes change alike for every choice but their own class
            gain[:classes] = cand[:classes]
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            t[b, :] += r
            t[:, b] += q
            t[b, b] += d
            table = t
            if b != a:
                own[w], moved = b, moved + 1
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                left[:, a] -= counts[w, :]
                left[:, b] += counts[w, :]
        if not moved:
            break
    return own


class Model:
    """What scoring needs of the training corpus in every worker; its size is bounded by HEAD and CLASSES."""

    def __init__(self, counts: DataFrame, head: pa.Table, codes: DataFrame) -> None:
        self.n_docs = codes.count()
        sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.total = int(sums["n"] or 0) + self.n_docs
        self.distinct = int(sums["v"]) + (self.n_docs > 0)
        self.unit = self.total + ALPHA * (self.distinct + 1)
        core = min(CORE, len(head))
        pairs = bigrams(codes, core)
        own = exchange(pairs)
        k = self.k = int(own.max()) + 1
        member = np.zeros((len(pairs), k))
        member[np.arange(len(pairs)), own] = 1
        table = member.T @ pairs @ member
        near = np.concatenate([(pairs @ member)[:core], (pairs.T @ member)[:core]], axis=1)
        del pairs, member
        self.rare, self.end = k - 2, k - 1
        first = materialize(assigned(codes, head.column("word").to_pylist(), own, table))
        words, own = swept(first, own, near)
        #: (word, id, n, cls) of all words with a class outside the core
        self.others = words.select("word", "id", "n", "cls")
        n = head.column("n").to_numpy().astype(np.float64)
        cls = np.full(len(head), self.rare, np.int64)
        cls[:core] = own[:core]
        of = self.others.filter("id is not null").select("id", "cls").toArrow()  # at most HEAD
        cls[of.column("id").to_numpy()] = of.column("cls").to_numpy()
        self.in_class = np.bincount(own[:core], n[:core], k)
        in_others = 0
        for r in self.others.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            self.in_class[r["cls"]] += r["n"]
            in_others += r["v"]
        self.rare_unit = int(sums["n"] or 0) - self.in_class.sum() + ALPHA * (int(sums["v"]) - core - in_others + 1)
        self.cls = cls.astype(np.int16)
        self.padded = np.append(self.cls, np.int16(0))
        self.emit = self.emission(n, cls)
        self.base = np.log10((n + ALPHA) / self.unit)
        self.end_base = float(np.log10((self.n_docs + ALPHA) / self.unit))

    def emission(self, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return np.where(cls == self.rare, np.log10((n + ALPHA) / max(self.rare_unit, 1e-300)), np.log10(np.maximum(n, 1) / np.maximum(self.in_class[cls], 1)))

    def learn_moves(self, met: DataFrame) -> None:
        """Counts the class transitions of training texts, all words' classes known."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(k * k, np.int64)
            for batch in batches:
                for x in batch.column("classes").to_pylist():
                    c = np.frombuffer(x, np.uint8).astype(np.int64)
                    held += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(held)], ["pair", "n"])

        got = met.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros(k * k)
        table[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy()
        table = table.reshape(k, k)
        self.move = np.log10((table + ALPHA) / (table.sum(1, keepdims=True) + ALPHA * k))

    def sent(self) -> Model:
        """The model without its table of other words, which stays a DataFrame."""
        out = object.__new__(Model)
        out.__dict__ = {x: y for x, y in self.__dict__.items() if x != "others"}
        return out

    def classes(self, ids: np.ndarray, i: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The classes of a text's words between two ends; ``cls`` has those of the words outside the head, at places ``i``."""
        own = np.empty(len(i) + 1, np.int64)
        own[i] = cls
        head = len(self.cls)
        c = np.where(ids < head, self.padded[np.minimum(ids, head)], own[np.maximum(ids - head, 0)])
        return np.concatenate([[self.end], c, [self.end]]).astype(np.int64)


def score(docs: DataFrame, train: Column, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(ident, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; learns where ``train``.

    Null texts are empty: their only token is the end. Rows of one id are scored each by itself, texts of any length whole.
    Without training rows every word and the end are unknown; an empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(ident).alias("ident"), F.col(text).cast("binary").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    counts = materialize(word_counts(d.filter("train")))
    head = most_frequent(counts, HEAD)
    codes = materialize(coded(d, {w: i for i, w in enumerate(head.column("word").to_pylist())}).withColumn("row", F.monotonically_increasing_id()))
    model = Model(counts, head, codes.filter("train"))
    kind = d.schema["ident"].dataType.simpleString()

    rest = codes.select("row", F.posexplode(F.arrays_zip("words", "times")).alias("i", "x")).select("row", "i", F.col("x.words").alias("word"), F.col("x.times").alias("t"))
    known = counts.join(model.others.filter("id is null").select("word", "cls"), "word", "left")
    hot = hot_keys(counts.filter(F.length("word") > HEAD_BYTES), "word")
    found = salted_join(rest, known, "word", hot, F.col("row"), "left").select("row", F.struct("i", "t", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(model.rare)).alias("cls")).alias("x"))
    met = codes.select("row", "ident", "train", "ids").join(found.groupBy("row").agg(F.collect_list("x").alias("tail")), "row", "left")
    sent = spark.sparkContext.broadcast(model.sent())

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of a text's words between two ends, a byte each, and what its words add whatever the transitions."""
        m = sent.value
        for batch in batches:
            classes, rows = [], []
            for x, (i, t, n, cls) in zip(batch.column("ids").to_pylist(), _tails(batch), strict=True):
                ids = np.frombuffer(x, np.int32)
                classes.append(m.classes(ids, i, cls).astype(np.uint8).tobytes())
                of = ids[ids < len(m.cls)]
                base = m.base[of].sum() + m.end_base + (t * np.log10((n + ALPHA) / m.unit)).sum()
                own = m.emit[of].sum() + (t * m.emission(n, cls)).sum()
                rows.append((len(ids) + 1, len(of) + (m.n_docs > 0) + int(t[n > 0].sum()), float(base), float(own)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [pa.array(classes, pa.binary()), *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays([batch.column("ident"), batch.column("train"), *columns], ["ident", "train", "classes", "n_tokens", "n_known", "base_score", "emitted"])

    met = materialize(met.select("ident", "train", "ids", "tail").mapInArrow(emitted, f"ident {kind}, train boolean, classes binary, n_tokens long, n_known long, base_score double, emitted double"))
    model.learn_moves(met.filter("train"))
    moves = spark.sparkContext.broadcast(model.move)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move = moves.value
        for batch in batches:
            way = []
            for x in batch.column("classes").to_pylist():
                c = np.frombuffer(x, np.uint8)
                way.append(float(move[c[:-1], c[1:]].sum()))
            own = pa.array(np.array(way) + batch.column("emitted").to_numpy(), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("ident", "train", "n_tokens", "n_known", "base_score")], own], ["ident", "train", "n_tokens", "n_known", "base_score", "score"])

    out = met.mapInArrow(run, f"ident {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("ident").alias(ident), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
