"""LM scoring by a probabilistic suffix tree over words.

A text is a sequence of tokens: words, then one end. The tree's symbols are the common
words, the end, and one class for all other words; its contexts hold up to ``depth``
preceding symbols, or one word that isn't common. P(a rare word | its class) is its
discounted count; what the discounts leave is the probability of an unknown word, one
event as in the base score. So the probabilities of all sequences over known words and
"unknown" sum to one.

Spark counts the corpus: words, then symbols after contexts (level by level, a context
only where it was frequent as a sequence one level before). A context is a state only if
its next-symbol distribution diverges from that of its longest retained suffix by
``divergence`` nats in all. A token is scored by the longest suffix that is a state; a
distribution gives what it hasn't kept to the next shorter suffix.

States of common words must have a share of ``p_min`` of the tokens: there are at most
1/p_min of each length, so they are sent to all tasks. States of other words have no such
bound: their number grows with the corpus, so they are a table, which is joined with the
occurrences of these words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import Scratch, held_out, lower_words, small_batches

BOUNDARY, END, OTHER, FIRST_WORD = 1, 2, 3, 4
#: Bits of a symbol in packed contexts.
BITS = 16
FLUSH = 400_000
Counts = list[tuple[np.ndarray, np.ndarray]]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


def _held(held: Counts, most: int, last: bool = False) -> Iterator[pa.RecordBatch]:
    """Sum what is held once it has many keys; give it out where that doesn't help, and at last."""
    if held and (last or sum(len(k) for k, _ in held) > 2 * most):
        keys, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held[:] = [(keys, n)]
        if last or len(keys) > most:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
            held.clear()


def _contexts(symbols: np.ndarray, place: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the positions whose history is that long, and the packed context."""
    at = np.flatnonzero(place > 0)
    context = np.zeros(len(at), np.int64)
    yield 0, at, context
    for k in range(1, depth + 1):
        enough = place[at] >= k
        at, context = at[enough], context[enough] | (symbols[at[enough] - k] << (BITS * (k - 1)))
        yield k, at, context


def _word_symbols(texts: list[str | None], ids: dict[bytes, int], codes: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray,
    np.ndarray, list[int]]:
    """Symbols of start + words + end for each text, each symbol's place, where texts begin; with
    codes, in which words that aren't common get numbers, those of such words in order."""
    flat: list[int] = []
    starts: list[int] = []
    rare: list[int] = []
    for text in texts:
        words = lower_words(text)
        own = [ids.get(w, OTHER) for w in words]
        if codes is not None:
            rare += [codes.setdefault(w, len(codes)) for w, x in zip(words, own, strict=True) if x == OTHER]
        starts.append(len(flat))
        flat.append(BOUNDARY)
        flat += own
        flat.append(END)
    symbols, at = np.array(flat, np.int64), np.array(starts, np.int64)
    return symbols, np.arange(len(flat)) - np.repeat(at, np.diff(np.append(at, len(flat)))), at, rare


def _slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts of about so many characters, so that a batch of long texts is cut."""
    lo = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > most:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def _named(held: Counts, codes: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """What follows the words of codes, summed; empties both."""
    if held:
        keys, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        names = pa.array(list(codes), pa.binary())
        for lo in range(0, len(keys), 200_000):
            part = keys[lo : lo + 200_000]
            words = names.take(pa.array(part >> BITS))
            columns = [words, pa.array(part & ((1 << BITS) - 1)), pa.array(n[lo : lo + 200_000])]
            yield pa.RecordBatch.from_arrays(columns, ["word", "key", "n"])
    held.clear()
    codes.clear()


def _context_counts(batches: Iterator[pa.RecordBatch], ids: dict[bytes, int], k: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """word (null), key: context of k symbols << bits | symbol, symbol 0 for the context's total; of
    contexts over one symbol only the frequent ones. For k = 1 also what follows each word that isn't
    common: the word, and the symbol as key."""
    held: Counts = []
    after: Counts = []
    codes: dict[bytes, int] = {}
    unnamed = lambda b: pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.binary()), *b.columns], ["word", "key", "n"])
    for batch in batches:
        texts = [t for t, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not out]
        for part in _slices(texts):
            symbols, place, _, rare = _word_symbols(texts[part], ids, codes if k == 1 else None)
            *_, (length, at, context) = _contexts(symbols, place, k)
            if k > 1 and len(at):
                i = np.minimum(np.searchsorted(frequent, context), len(frequent) - 1)
                at, context = at[frequent[i] == context], context[frequent[i] == context]
            if length == k and len(at):
                keys, n = _summed(context << BITS | symbols[at], np.ones(len(at), np.int64))
                held += [(keys, n), _summed(keys >> BITS << BITS, n)]
            if rare:
                next_ = symbols[np.flatnonzero(symbols == OTHER) + 1]
                after.append(_summed(np.array(rare, np.int64) << BITS | next_, np.ones(len(rare), np.int64)))
                if sum(len(x) for x, _ in after) > 2 * FLUSH:
                    yield from _named(after, codes)
            yield from map(unnamed, _held(held, 2_000_000))
    yield from _named(after, codes)
    yield from map(unnamed, _held(held, 0, last=True))


class Tree:
    """States sorted by packed context (root first), entries sorted by state and symbol."""

    def __init__(self, depth: int, root: np.ndarray):
        self.depth, self.root = depth, root
        self.states = np.zeros(1, np.int64)
        self.back = np.ones(1)
        self.parent = np.zeros(1, np.int64)
        self.keys = np.zeros(0, np.int64)
        self.probs = np.zeros(0)

    def grow(self, k: int, keys: np.ndarray, counts: np.ndarray, floor: float, divergence: float, prior: float) -> None:
        """Add the states of length k. keys: context << bits | symbol, symbol 0 for the context's total."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        context, symbol = keys >> BITS, keys & ((1 << BITS) - 1)
        use = (symbol > 0) & (counts >= floor)
        c, s, n = context[use], symbol[use], counts[use]
        if not len(c):
            return
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
        name, kept = c[first], np.add.reduceat(n, first)
        total = np.maximum(counts[symbol == 0][np.searchsorted(context[symbol == 0], name)], kept)
        parent = self.longest(name & ((1 << (BITS * (k - 1))) - 1), np.full(len(name), k - 1))
        lower = self.prob(parent[node], s)
        rest, mass = total - kept, np.maximum(1 - np.add.reduceat(lower, first), 1e-12)
        gain = (np.add.reduceat(n * np.log(n / total[node] / lower), first)
            + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-9) / total / mass), 0))
        good = gain >= divergence
        entry, back = good[node], (rest + prior) / (total + prior)
        above = np.concatenate((self.states[self.parent], self.states[parent[good]]))
        states = np.concatenate((self.states, name[good]))
        entries = np.concatenate((self.keys, (c << BITS | s)[entry]))
        probs = np.concatenate((self.probs, (n / (total[node] + prior) + back[node] * lower)[entry]))
        order, ranked = np.argsort(states), np.argsort(entries)
        self.back = np.concatenate((self.back, back[good]))[order]
        self.states, self.keys, self.probs = states[order], entries[ranked], probs[ranked]
        self.parent = np.searchsorted(self.states, above[order])

    def longest(self, context: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The state that is the longest suffix of each packed context."""
        state, open_ = np.zeros(len(context), np.int64), np.ones(len(context), bool)
        for k in range(self.depth, 0, -1):
            at = np.flatnonzero(open_ & (length >= k))
            suffix = context[at] & ((1 << (BITS * k)) - 1)
            i = np.minimum(np.searchsorted(self.states, suffix), len(self.states) - 1)
            hit = self.states[i] == suffix
            state[at[hit]] = i[hit]
            open_[at[hit]] = False
        return state

    def prob(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """P(symbol | state): its entry, or else the shorter suffix's, weighted by what is left."""
        p, weight = np.zeros(len(state)), np.ones(len(state))
        at, state = np.arange(len(state)), state.copy()
        while len(at):
            root = state == 0
            p[at[root]] = weight[root] * self.root[symbol[at[root]]]
            at, state, weight = at[~root], state[~root], weight[~root]
            if not len(at) or not len(self.keys):
                break
            wanted = self.states[state] << BITS | symbol[at]
            i = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[i] == wanted
            p[at[hit]] = weight[hit] * self.probs[i[hit]]
            at, state, weight = at[~hit], state[~hit], weight[~hit]
            weight, state = weight * self.back[state], self.parent[state]
        return p

    def logs(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 P(symbol | longest suffix state) at each position that isn't a first one."""
        context = np.zeros(len(symbols), np.int64)
        for k in range(1, self.depth + 1):
            at = np.flatnonzero(place >= k)
            context[at] |= symbols[at - k] << (BITS * (k - 1))
        out, at = np.zeros(len(symbols)), np.flatnonzero(place > 0)
        state = self.longest(context[at], np.minimum(place[at], self.depth))
        out[at] = np.log10(self.prob(state, symbols[at]))
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train: Counter[bytes] = Counter()
    other: set[bytes] = set()
    ends = 0

    def out() -> Iterator[pa.RecordBatch]:
        rest = other.difference(train)
        for names, numbers in ((list(train), list(train.values())), (list(rest), [0] * len(rest))):
            for lo in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[lo : lo + 100_000], pa.binary()), pa.array(numbers[lo : lo + 100_000], pa.int64())], ["word", "n"])
        train.clear()
        other.clear()

    for batch in batches:
        for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
            if held:
                other.update(lower_words(text))
            else:
                train.update(lower_words(text))
                ends += 1
            if len(train) + len(other) > FLUSH:
                yield from out()
    yield from out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])


KINDS = {
    "word": pa.binary(), "key": pa.int64(), "next": pa.int32(), "lower": pa.float64(), "doc_id": pa.int64(), "held_out": pa.bool_(),
    "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(),
}
POSTINGS = """word binary, key bigint, next int, lower double, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint,
 base double, score double"""


def _postings(
    batches: Iterator[pa.RecordBatch], common: dict[bytes, tuple[int, float, int]], tree: Tree, end: tuple[int, float]
) -> Iterator[pa.RecordBatch]:
    """A row per document with the sums over its common words and the end, and the tree's score; a row
    per occurrence of another word: the document's key, the symbol that follows, and the tree's log10
    probability of that."""
    names, kinds = list(KINDS), list(KINDS.values())
    ids = {w: x[2] for w, x in common.items()}
    base = np.zeros(FIRST_WORD + len(ids))
    base[END] = end[1]
    for _, each, i in common.values():
        base[i] = each
    for batch in batches:
        texts, keys = batch.column("text").to_pylist(), batch.column("key").to_numpy()
        for part in _slices(texts):
            codes: dict[bytes, int] = {}
            symbols, place, starts, rare = _word_symbols(texts[part], ids, codes)
            logs = tree.logs(symbols, place)
            lengths = np.diff(np.append(starts, len(symbols)))
            known = np.add.reduceat((symbols >= FIRST_WORD).astype(np.int64), starts) + (end[0] > 0)
            n, own = len(starts), keys[part]
            sums = [pa.array(x) for x in (lengths - 1, known, np.add.reduceat(base[symbols], starts), np.add.reduceat(logs, starts))]
            flags = [batch.column(c).slice(part.start, n) for c in ("doc_id", "held_out")]
            nothing = [pa.nulls(n, t) for t in (kinds[0], *kinds[2:4])]
            yield pa.RecordBatch.from_arrays([nothing[0], pa.array(own), *nothing[1:], *flags, *sums], names)
            code, at = np.array(rare, np.int64), np.flatnonzero(symbols == OTHER)
            order = np.argsort(code << BITS | symbols[at + 1], kind="stable")  # like rows together, which the shuffle compresses well
            at = at[order]
            words = pa.array(list(codes), pa.binary()).take(pa.array(code[order]))
            found = [np.repeat(own, lengths)[at], symbols[at + 1].astype(np.int32), logs[at + 1]]
            found = [pa.array(x) for x in found]
            for lo in range(0, len(at), 100_000):
                some = [x.slice(lo, 100_000) for x in (words, *found)]
                yield pa.RecordBatch.from_arrays([*some, *(pa.nulls(len(some[0]), t) for t in kinds[4:])], names)


def rare_states(contexts: DataFrame, vocabulary: DataFrame, lower: DataFrame, divergence: float, prior: float) -> DataFrame:
    """(word, after, total, back) of the words that aren't common and are states: the counts of the symbols kept
    after them, the divisor, and the weight of the shorter suffix.

    contexts: (word, key, n), symbols of two or more occurrences after a word; lower: (key, p), the
    shorter suffix's distribution, which is the same for all of them.
    """
    kept = contexts.join(F.broadcast(lower), "key").groupBy("word").agg(
        F.sum("n").alias("kept"), F.sum("p").alias("mass"), F.sum(F.col("n") * F.log(F.col("n") / F.col("p"))).alias("gain"),
        F.map_from_entries(F.collect_list(F.struct(F.col("key").cast("int").alias("key"), "n"))).alias("after"),
    )
    both = kept.join(vocabulary.select("word", "n"), "word")
    rest = F.col("n") - F.col("kept")
    left = F.when(rest > 0, rest * F.log(rest / F.col("n") / F.greatest(1 - F.col("mass"), F.lit(1e-12)))).otherwise(0.0)
    gain = F.col("gain") - F.col("kept") * F.log(F.col("n").cast("double")) + left
    total = F.col("n") + F.lit(prior)
    return both.filter(gain >= divergence).select("word", "after", total.alias("total"), ((rest + F.lit(prior)) / total).alias("back"))


def score_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 1,
    depth: int = 2, p_min: float = 2e-6, divergence: float = 20.0, prior: float = 1.0, common_share: float = 1 / 32768, least: float = 2.0,
) -> DataFrame:
    """Score every text by a suffix tree learnt from the documents that aren't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: the
    base is the smoothed unigram score, the score the tree's log10 probability.

    A row per row: rows that share an id, a null id included, are scored each by its own
    text, and each counts in training. Null and empty texts are the end token alone. An
    empty table gives no rows; with no training rows every word is unknown and all symbols
    are alike. Other columns are not read.

    Scale: one shuffle of each task's distinct words, one of its contexts for each length,
    one of postings: a row per occurrence of a word that isn't common. Words that are more
    than common_share of the tokens (at most 1/common_share of them) are summed where the
    text is read, so no key of the shuffles is hot.
    """
    spark = docs.sparkSession
    small_batches(spark)
    send = spark.sparkContext.broadcast
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
        held_out(F.col(id_col), modulus, remainder).alias("held_out"),
    )
    train = rows.select("text", "held_out")
    counted = train.mapInArrow(_word_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = Scratch(spark).written(counted, "lm-words")
    rare = F.col("word").isNotNull()
    sums = vocabulary.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("n") > 0).alias("distinct"),
        F.count_if((F.col("n") == 1) & rare).alias("once"),
        F.count_if((F.col("n") == 2) & rare).alias("twice"),
        F.coalesce(F.sum(F.when(~rare, F.col("n"))), F.lit(0)).alias("ends"),
    ).first()
    unit = sums.tokens + 0.5 * (sums.distinct + 1)
    base = lambda n: F.log10((n + 0.5) / F.lit(unit))

    hot = vocabulary.filter(rare & (F.col("n") > max(common_share, 2.0 ** (1 - BITS)) * sums.tokens)).orderBy("word").collect()
    common = {bytes(r.word): (r.n, math.log10((r.n + 0.5) / unit), FIRST_WORD + i) for i, r in enumerate(hot)}
    rare_n = sums.tokens - sums.ends - sum(r.n for r in hot)
    root = np.array([0, 0, sums.ends, rare_n, *(r.n for r in hot)], float)
    root[END:] += prior
    tree = Tree(depth, root / root.sum())
    ids = send({w: x[2] for w, x in common.items()})
    floor, frequent = max(least, p_min * sums.tokens), np.zeros(1, np.int64)
    scratch, states = Scratch(spark), None
    for k in range(1, depth + 1):
        counts = (
            train.mapInArrow(lambda it, k=k, f=send(frequent): _context_counts(it, ids.value, k, f.value),
            "word binary, key bigint, n bigint"))
        counts = counts.groupBy("word", "key").agg(F.sum("n").alias("n")).filter((F.col("n") >= floor) | (rare & (F.col("n") > 1)))
        counts = scratch.written(counts, "lm-contexts")
        level = counts.filter(~rare).select("key", "n").toPandas()
        keys, n = level["key"].to_numpy(np.int64), level["n"].to_numpy(np.float64)
        tree.grow(k, keys, n, floor, divergence, prior)
        if k == 1:
            symbol = np.arange(END, len(root))
            p = tree.prob(tree.longest(np.full(len(symbol), OTHER), np.ones(len(symbol), np.int64)), symbol)
            lower = spark.createDataFrame(list(zip(symbol.tolist(), p.tolist(), strict=True)), "key bigint, p double")  # a row a symbol
            states = rare_states(counts.filter(rare), vocabulary, lower, divergence, prior)
        frequent = np.unique(keys[keys & ((1 << BITS) - 1) > 0])
        if not len(frequent):
            break

    # P(a word | OTHER): its count less a discount; P(unknown | OTHER): the sum of the discounts
    discount = min(0.999, (sums.once + 0.5) / (sums.once + 2 * sums.twice + 1))
    left = discount * (sums.distinct - (sums.ends > 0) - len(hot)) + 0.5
    of_class = F.log10(F.when(F.col("n") > 0, F.col("n") - discount).otherwise(left) / (rare_n + 0.5))
    sent_common, sent_tree = send(common), send(tree)
    end = (sums.ends, math.log10((sums.ends + 0.5) / unit))
    postings = rows.mapInArrow(lambda it: _postings(it, sent_common.value, sent_tree.value, end), POSTINGS)
    known = vocabulary.filter(rare).select("word", "n", base(F.col("n")).alias("each_base"), of_class.alias("each_score"))
    if states is not None:
        known = known.join(states, "word", "left")
    else:
        known = known.withColumns({"after": F.lit(None).cast("map<int,bigint>"), "total": F.lit(1.0), "back": F.lit(1.0)})

    # an occurrence adds the word's share of its class, and the next symbol after this word instead of after its class
    seen = F.coalesce(F.try_element_at("after", "next"), F.lit(0)) / F.col("total")
    own = F.log10(seen + F.col("back") * F.pow(F.lit(10.0), F.col("lower"))) - F.col("lower")
    more = F.col("each_score") + F.when(F.col("after").isNotNull(), own).otherwise(0.0)
    each = postings.join(known, "word", "left").select(
        "key", "doc_id", "held_out", "n_tokens", F.coalesce("n_known", (F.col("n") > 0).cast("long"), F.lit(0)).alias("n_known"),
        F.coalesce("base", "each_base").alias("base"), F.coalesce("score", more).alias("score"),
    )
    totals = each.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return totals.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(sums.tokens)).cast("long").alias("train_tokens"), "base_score", "score"
    )
