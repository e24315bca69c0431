"""Language-model scores of documents: a Katz backoff model of word pairs.

Tokens are words with A-Z lower-cased and one end per document; the context of the
first token is the beginning. With Good-Turing discounts d_r for counts up to
``CUT`` (from the counts of counts, per order), and c the counts in training rows,

    P(w)     = d c(w) / N                 for known words, the rest is for unknown ones
    P(w | u) = d c(u w) / c(u)            if u w was seen
             = weight(u) P(w)             if not, but u was
             = P(w)                       if u was not
    weight(u) = (1 - sum of P(w | u)) / (1 - sum of P(w)), both over the w seen after u

so all words together with the unknown one have probability 1 after every context.
Unknown words are one class. A discount is used if it lies between 0 and 1; if the
counts of counts give no such discounts for ``CUT``, the largest lower cut with
valid ones is taken, and at last half a count is taken off what was seen once. Where
no count is discounted, the total is one greater, so something is always left.

Evaluation asks for every pair of every document. Documents are dealt to blocks; a
block sends each of its different pairs once, with their count in its training rows,
to the bucket of its context, and gets the pair's count and the context's total back;
what is sent are packed arrays, some megabytes for a task. Frequent contexts spread
over all buckets by their second word. They are chosen from a sample, which only
routes: their totals are added up afterwards. For the sum of P(w) after a context,
each pair has one owner among the blocks that saw it in training, because a block
knows its words' counts by then. The tables of counts (contexts, and pairs as the
answers to the blocks) and of backoff weights are stored in the shared folder.

Words are told apart by 64 bits of hash. Shuffled files are removed as soon as the
table made from them is written.

Defined results: null text is empty, with the end as its one token; rows that repeat
count and are scored each; rows without id count as those with an empty id, for the
choice of training rows as well; with no training rows every score is 0. An empty
table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out
from tidemark.llm.tables import documents, partitions_for, write_clean
from tidemark.llm.words import mix, signed, slices, words_of

U64 = np.uint64
#: counts up to this one are discounted
CUT = 5
#: bytes of text in a block, and for each bucket of pairs
BLOCK_BYTES = 8 << 20
#: and for each task, of the blocks or buckets it works on one after the other
TASK_BYTES = 32 << 20
#: tokens that stand for the beginning and the end; words have other hashes but for a chance of 2 in 2**64
BEGIN, END = 0, 1
#: a context is frequent with this share of a bucket's tokens, in a sample of so many bytes for each bucket
SHARE, SAMPLE_BYTES = 8, 64 << 10
#: pseudo count of the base score
ADDED = 0.1

MESSAGES = "bucket int, block int, contexts binary, runs binary, words binary, counts binary"
COUNTED = (
    "block int, bucket int, pairs binary, totals binary, leasts binary, "
    "context long, frequent boolean, total long, seen array<long>"
)
SCORED = (
    "block int, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
    "part double, open array<long>, context long, mass double"
)


@dataclass
class Discounts:
    """Discounts of one order: ``factor[r]`` for counts r up to the cut, 1 beyond."""

    factor: np.ndarray

    @classmethod
    def good_turing(cls, seen: list[int]) -> Discounts:
        """``seen[r - 1]``: how many different n-grams have the count r, up to CUT + 1."""
        for cut in range(CUT, 0, -1):
            n = [0, *seen[: cut + 1]]
            if min(n[1 : cut + 1]) == 0:
                continue
            common = (cut + 1) * n[cut + 1] / n[1]
            if common >= 1:
                continue
            d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, cut + 1)]
            if all(0 < x < 1 for x in d):
                return cls(np.array([1.0, *d]))
        return cls(np.array([1.0, 0.5]))

    @property
    def cut(self) -> int:
        return len(self.factor) - 1

    def held(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return count * np.where(count <= self.cut, self.factor[np.minimum(count, self.cut)], 1.0)

    def taken(self, seen: list) -> float:
        """What is taken off altogether; ``seen`` as above, numbers or columns."""
        return sum((1 - self.factor[r]) * r * seen[r - 1] for r in range(1, self.cut + 1))


@dataclass
class Model:
    """The numbers that every task needs."""

    one: Discounts
    two: Discounts
    tokens: int
    words: int
    ends: int
    total: float
    left: float
    #: contexts that spread over buckets, ascending, with their totals and least counts
    frequent: np.ndarray
    totals: np.ndarray
    leasts: np.ndarray

    def word(self, count: np.ndarray) -> np.ndarray:
        """P(w) by the word's count; 0 is the unknown word."""
        if self.tokens == 0:
            return np.ones(len(count))
        return np.where(count > 0, self.one.held(count) / self.total, self.left / self.total)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADDED) / (self.tokens + ADDED * (self.words + 1)))


def block_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and the hashes of all; worked on in slices, as hashing needs many bytes for each byte of text."""
    counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for part in slices(pa.table([texts], ["text"]).to_batches()):
        found = words_of(part.column("text"), lower=True)
        counts.append(np.diff(found.first))
        hashes.append(found.hashes())
    return np.concatenate(counts), np.concatenate(hashes)


@dataclass
class Pairs:
    """The tokens of a block and its different pairs, which are ordered by bucket, context and word.

    ``contexts`` and ``words`` are the different ones, ascending; ``of_context`` and
    ``of_word`` give a pair's place in them, ``pair`` a token's pair, ``bounds`` the
    pairs of each bucket.
    """

    row: np.ndarray
    pair: np.ndarray
    contexts: np.ndarray
    words: np.ndarray
    of_context: np.ndarray
    of_word: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: pa.ChunkedArray, buckets: int, frequent: np.ndarray) -> Pairs:
        count, hashes = block_words(texts)
        rows = len(count)
        row = np.repeat(np.arange(rows, dtype=np.int32), count + 1)
        word = np.full(len(row), END, dtype=U64)
        stop = np.cumsum(count + 1)
        inside = np.ones(len(row), dtype=bool)
        inside[stop - 1] = False
        word[inside] = hashes
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[stop - count - 1] = BEGIN
        del hashes, inside
        contexts, c = np.unique(context, return_inverse=True)
        words, w = np.unique(word, return_inverse=True)
        del context, word
        c *= len(words)
        c += w
        code, pair = np.unique(c, return_inverse=True)
        del c, w
        of_context, of_word = [x.astype(np.int32) for x in np.divmod(code, max(len(words), 1))]
        key = mix(contexts)[of_context]
        spread = np.isin(contexts, frequent)[of_context]
        key[spread] = mix(key[spread] + words[of_word[spread]])
        bucket = (key % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.empty(len(order), dtype=np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        return cls(row, at[pair], contexts, words, of_context[order], of_word[order], bounds)

    def runs(self) -> np.ndarray:
        """Bounds of stretches of pairs with one context in one bucket."""
        if not len(self.of_context):
            return np.zeros(1, np.int64)
        new = np.ones(len(self.of_context) + 1, dtype=bool)
        new[1:-1] = self.of_context[1:] != self.of_context[:-1]
        new[self.bounds] = True
        return np.flatnonzero(new)


def messages(buckets: int, frequent: np.ndarray):
    """What a block sends to the buckets."""

    def send(key: tuple, block: pa.Table) -> pa.Table:
        pairs = Pairs.of(block.column("text"), buckets, frequent)
        train = ~block.column("held_out").to_numpy().astype(bool)
        counts = np.bincount(pairs.pair[train[pairs.row]], minlength=len(pairs.of_word))
        runs = pairs.runs()
        out = []
        for b in np.flatnonzero(np.diff(pairs.bounds)).tolist():
            low, high = pairs.bounds[b], pairs.bounds[b + 1]
            own = runs[np.searchsorted(runs, low) : np.searchsorted(runs, high) + 1]
            sent = (
                pairs.contexts[pairs.of_context[own[:-1]]],
                np.diff(own),
                pairs.words[pairs.of_word[low:high]],
                counts[low:high],
            )
            kinds = (U64, np.int32, U64, np.int64)
            out.append((b, key[0].as_py(), *[x.astype(t).tobytes() for x, t in zip(sent, kinds, strict=True)]))
        columns = list(zip(*out, strict=True))
        types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in MESSAGES.split(", ")])

    return send


def count_bucket(frequent: np.ndarray):
    """The counts of a bucket's pairs, as answers to the blocks, and its contexts."""

    def count(key: tuple, sent: pa.Table) -> pa.Table:
        def parts(name, kind):
            return [np.frombuffer(x.as_py(), dtype=kind) for x in sent.column(name)]

        run, runs, word, counted = parts("contexts", U64), parts("runs", np.int32), parts("words", U64), parts("counts", np.int64)
        contexts, of_run = np.unique(np.concatenate(run), return_inverse=True)
        words, of_word = np.unique(np.concatenate(word), return_inverse=True)
        of_context = np.repeat(of_run, np.concatenate(runs))
        code, pair = np.unique(of_context * len(words) + of_word, return_inverse=True)
        own = np.concatenate(counted)
        total = np.zeros(len(code), dtype=np.int64)
        np.add.at(total, pair, own)
        answer = total[pair]
        # the first block with a pair in training owns it, told by the sign
        there = np.flatnonzero(own)
        _, first = np.unique(pair[there], return_index=True)
        answer[there[first]] *= -1
        context = code // len(words)
        totals = np.zeros(len(contexts), dtype=np.int64)
        np.add.at(totals, context, total)
        leasts = np.full(len(contexts), np.iinfo(np.int64).max)
        np.minimum.at(leasts, context[total > 0], total[total > 0])
        seen = np.stack([np.bincount(context[total == r], minlength=len(contexts)) for r in range(1, CUT + 2)], axis=1)
        many = np.isin(contexts, frequent)
        size, places = np.array([len(x) for x in word]), np.array([len(x) for x in run])
        cuts, run_cuts = np.cumsum(size)[:-1], np.cumsum(places)[:-1]
        answers = [np.split(x, at) for x, at in ((answer, cuts), (totals[of_run], run_cuts), (leasts[of_run], run_cuts))]
        known = np.flatnonzero(totals)
        n, m = len(size), len(known)
        columns = [
            pa.concat_arrays([sent.column("block").combine_chunks(), pa.nulls(m, pa.int32())]),
            pa.concat_arrays([pa.array([key[0].as_py()] * n, pa.int32()), pa.nulls(m, pa.int32())]),
            *[pa.concat_arrays([pa.array([x.tobytes() for x in a], pa.binary()), pa.nulls(m, pa.binary())]) for a in answers],
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(signed(contexts[known]))]),
            pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(many[known])]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(totals[known])]),
            pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array(list(seen[known]), pa.list_(pa.int64()))]),
        ]
        return pa.table(columns, [c.split()[0] for c in COUNTED.split(", ")])

    return count


def score_block(buckets: int, model: Model):
    """Scores of a block's rows but for backoff weights, and P(w) of the pairs that it owns by context."""

    def score(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        pairs = Pairs.of(block.column("text"), buckets, model.frequent)
        runs = pairs.runs()
        count = np.zeros(len(pairs.of_word), dtype=np.int64)
        total, least = np.zeros(len(pairs.contexts), dtype=np.int64), np.zeros(len(pairs.contexts), dtype=np.int64)
        told = 0
        for i, b in enumerate(answers.column("bucket").to_pylist()):
            low, high = pairs.bounds[b], pairs.bounds[b + 1]
            got = [np.frombuffer(answers.column(c)[i].as_py(), dtype=np.int64) for c in ("pairs", "totals", "leasts")]
            at = pairs.of_context[runs[np.searchsorted(runs, low) : np.searchsorted(runs, high)]]
            count[low:high], total[at], least[at] = got
            told += high - low
        if told != len(count):
            raise RuntimeError(f"block {key[0]}: {told} of {len(count)} pairs are answered; its rows differ from those counted")
        # totals of contexts that spread over buckets
        place = np.minimum(np.searchsorted(model.frequent, pairs.contexts), max(len(model.frequent) - 1, 0))
        many = model.frequent[place] == pairs.contexts
        total[many], least[many] = model.totals[place[many]], model.leasts[place[many]]
        owned = count < 0
        count = np.abs(count)
        # each word of the block is a context in it as well, and its total there is its count
        of_total = np.searchsorted(pairs.contexts, pairs.words)
        known = np.where(pairs.words == END, model.ends, total[np.minimum(of_total, len(total) - 1)])
        p, base = model.word(known), model.base(known)
        whole = (total + (least > model.two.cut))[pairs.of_context]
        seen, open_ = count > 0, (count == 0) & (total[pairs.of_context] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.where(seen, np.log10(model.two.held(count) / whole), np.log10(p[pairs.of_word]))
        n = block.num_rows
        asks = np.flatnonzero(open_[pairs.pair])
        bounds = np.searchsorted(pairs.row[asks], np.arange(n + 1))
        asked = pairs.contexts[pairs.of_context[pairs.pair[asks]]]
        sums = [np.bincount(pairs.row, weights=x[pairs.pair], minlength=n) for x in (known[pairs.of_word] > 0, base[pairs.of_word], log)]
        mass = np.bincount(pairs.of_context[owned], weights=p[pairs.of_word[owned]], minlength=len(total))
        given = np.unique(pairs.of_context[owned])
        m = len(given)
        columns = [
            pa.concat_arrays([pa.array([key[0].as_py()] * n, pa.int32()), pa.nulls(m, pa.int32())]),
            pa.concat_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.nulls(m, pa.int32())]),
            *[pa.concat_arrays([*block.column(c).chunks, pa.nulls(m, block.schema.field(c).type)]) for c in ("doc_id", "held_out")],
            pa.concat_arrays([pa.array(np.bincount(pairs.row, minlength=n)), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.array(sums[0].astype(np.int64)), pa.nulls(m, pa.int64())]),
            *[pa.concat_arrays([pa.array(x), pa.nulls(m, pa.float64())]) for x in sums[1:]],
            pa.concat_arrays([pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(signed(asked))), pa.nulls(m, pa.list_(pa.int64()))]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(signed(pairs.contexts[given]))]),
            pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(mass[given].astype(np.float64))]),
        ]
        return pa.table(columns, [c.split()[0] for c in SCORED.split(", ")])

    return score


def word_rows(batches):
    for part in slices(batches):
        found = words_of(part.column("text"), lower=True)
        word, count = np.unique(found.hashes(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(count)], ["word", "n"])


def frequent_contexts(docs: DataFrame, total_bytes: int, buckets: int) -> np.ndarray:
    """The beginning, and the words that are a good part of a bucket alone, by a sample; at most SHARE x buckets."""
    if buckets == 1:
        return np.array([BEGIN], dtype=U64)
    every = max(1, total_bytes // (buckets * SAMPLE_BYTES))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counts = write_clean(some.mapInArrow(word_rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "sampled-words")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / (SHARE * buckets)
    found = [r.word for r in counts.where(F.col("n") > least).select("word").collect()]
    return np.unique(np.array([BEGIN, *np.array(found, dtype=np.int64).view(U64)], dtype=U64))


def fit(counted: DataFrame, frequent: np.ndarray) -> tuple[Model, DataFrame]:
    """The model's numbers, and the contexts (context, total, left) with the mass left for unseen words."""
    rows = counted.where("context is not null")
    seen = [F.sum(F.col("seen")[r]).alias(f"r{r}") for r in range(CUT + 1)]
    # contexts that spread over buckets; at most SHARE x buckets rows
    many = rows.where("frequent").groupBy("context").agg(F.sum("total").alias("total"), F.array(*seen).alias("seen"))
    contexts = rows.where("not frequent").select("context", "total", "seen").unionByName(many)
    is_word = F.col("context") != BEGIN
    once = [F.count_if(is_word & (F.col("total") == r)).alias(f"n{r}") for r in range(1, CUT + 2)]
    sums = contexts.agg(
        F.coalesce(F.sum(F.when(is_word, F.col("total"))), F.lit(0)).alias("words"),
        F.count_if(is_word).alias("kinds"),
        F.coalesce(F.sum(F.when(~is_word, F.col("total"))), F.lit(0)).alias("ends"),
        *once,
        *[F.coalesce(s, F.lit(0)).alias(f"r{i}") for i, s in enumerate(seen)],
    ).first()
    ends = sums["ends"]
    one = [sums[f"n{r}"] + (ends == r) for r in range(1, CUT + 2)]
    first, second = Discounts.good_turing(one), Discounts.good_turing([sums[f"r{r}"] for r in range(CUT + 1)])
    tokens, taken = sums["words"] + ends, first.taken(one)
    held = {r.context: r for r in many.collect()}
    totals, leasts = np.zeros(len(frequent), dtype=np.int64), np.full(len(frequent), np.iinfo(np.int64).max)
    for i, context in enumerate(signed(frequent).tolist()):
        if (r := held.get(context)) is not None:
            totals[i] = r.total
            leasts[i] = next((c + 1 for c, k in enumerate(r.seen) if k), leasts[i])
    model = Model(first, second, tokens, sums["kinds"] + (ends > 0), ends, tokens + (taken == 0), taken + (taken == 0), frequent, totals, leasts)
    off = F.lit(0.0)
    for r in range(1, second.cut + 1):
        off = off + F.col("seen")[r - 1] * float((1 - second.factor[r]) * r)
    whole = contexts.withColumn("off", off)
    plain = F.col("off") == 0
    return model, whole.select("context", (F.when(plain, 1 / (F.col("total") + 1)).otherwise(F.col("off") / F.col("total"))).alias("left"))


def katz_scores(docs: DataFrame, held: Column) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) by a model of the rows that are not ``held``.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    total_bytes = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = max(1, -(-total_bytes // BLOCK_BYTES))
    frequent = frequent_contexts(docs, total_bytes, buckets)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    tasks = partitions_for(docs.sparkSession, total_bytes, TASK_BYTES)
    dealt = dealt.repartition(tasks, "block")
    sent = dealt.groupBy("block").applyInArrow(messages(buckets, frequent), MESSAGES)
    counted = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(count_bucket(frequent), COUNTED)
    counted = write_clean(counted, "pair-counts")
    model, contexts = fit(counted, frequent)
    answers = counted.where("block is not null").select("block", "bucket", "pairs", "totals", "leasts")
    asked = answers.repartition(tasks, "block").groupBy("block")
    scored = write_clean(dealt.groupBy("block").cogroup(asked).applyInArrow(score_block(buckets, model), SCORED), "pair-scores")
    mass = scored.where("context is not null").groupBy("context").agg(F.sum("mass").alias("mass"))
    weights = write_clean(contexts.join(mass, "context").select("context", F.log10(F.col("left") / (1 - F.col("mass"))).alias("weight")), "weights")
    rows = scored.where("context is null").drop("context", "mass")
    asked = rows.where(F.size("open") > 0).select("block", "place", F.explode("open").alias("context"))
    asked = asked.groupBy("block", "place", "context").agg(F.count("*").alias("times")).join(weights, "context")
    backoff = asked.groupBy("block", "place").agg(F.sum(F.col("times") * F.col("weight")).alias("backoff"))
    return rows.join(backoff, ["block", "place"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("part") + F.coalesce("backoff", F.lit(0.0))).alias("score"),
    )


def op13_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of nine tenths of them."""
    return katz_scores(documents(spark, sf_dir), held_out(10, 0))
