"""Scoring by a weighted backoff automaton: smoothed n-grams are states with failure arcs, one pass per text adds up log-probabilities.

Counts of words, pairs and triples are exact and distributed, and grow with the corpus. Texts are read once, into blocks of tokens. A block
sends its distinct words and n-grams, packed, to ranges of keys; each range adds up all blocks' counts and answers every block. What an n-gram takes
from its context is summed in the same way by one of the blocks that have it, and a block walks the states that its texts can reach.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.sources.scratch import stored

# Pairs and triples of words that occur so often are arcs, whatever the size of the corpus.
LEAST_COUNT = 2
DISCOUNT = 0.75
# A block ends with the text that brings it to so many tokens.
BLOCK_TOKENS = 1_000_000
# Tokens in documents to learn from for each range of keys, and the most ranges: every block sends a row to each. Ranges grow beyond 2 billion tokens.
PART_TOKENS, MOST_PARTS = 500_000, 4096
# Weights are asked for by so many shares of the ranges in turn, as what is asked and told lies on disk together with the blocks.
ROUNDS = 2
# What ``hints`` tells every task as so many bits, 16 MB at any size of the table; a false bit costs some rows.
HINT_BITS = 27
END = b"\n"  # no word holds white space
_BITS = 32
SEED = 42

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, then the end mark."""
    return [*(text or "").encode().lower().split(), END]


def split(docs: DataFrame, folds: int = 7) -> DataFrame:
    """``at, doc_id, held_out, text``: ``at`` rises with the rows of a task and tells them apart."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 2
    return docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", held.alias("held_out"), "text")


def word_hash(word: bytes) -> int:
    """Spark's ``xxhash64`` of the word, unsigned."""
    return xxhash.xxh64_intdigest(word, SEED)


def _mixed(left: np.ndarray, right: np.ndarray, order: int) -> np.ndarray:
    h = (left ^ (left >> np.uint64(31)) ^ np.uint64(order)) * _ODD + right
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def gram_keys(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of the pairs and triples of words with hashes ``h`` in texts ``own``, and where each begins."""
    pair = _mixed(h[:-1], h[1:], 2)
    triple = _mixed(pair[:-1], pair[1:], 3)
    at_pair, at_triple = np.flatnonzero(own[:-1] == own[1:]), np.flatnonzero(own[:-2] == own[2:])
    return pair, triple, at_pair, at_triple


def hints(counted: DataFrame) -> Broadcast:
    """The low bits of all keys as a bitmap for every task, of a size that does not depend on the corpus."""
    place = F.col("key").bitwiseAND((1 << HINT_BITS) - 1)
    pieces = counted.groupBy(F.shiftright(place, 15).alias("piece")).agg(
        F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits")).collect()
    bitmap = np.zeros((1 << HINT_BITS - 15, 1 << 12), np.uint8)
    for piece, bits in pieces:
        bitmap[piece] = np.frombuffer(bits, np.uint8)
    return counted.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))


def hinted(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the bitmap; none that is goes missing."""
    place = keys & np.uint64((1 << HINT_BITS) - 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers by bytes, compressed: the lowest of all, the next of all, and so on up to the highest that is not zero everywhere."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    by_byte = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(by_byte, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    values = np.zeros((size, 8), np.uint8)
    values[:, :width] = np.frombuffer(pa.decompress(data[9:], width * size, "zstd", asbytes=True), np.uint8).reshape(width, size).T
    return values.view("<u8").reshape(-1)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice, bytes]]:
    """The even ranges of keys that sorted ``keys`` fall in, which of them do, and those packed."""
    edges = [(part << 64) // parts for part in range(parts)]
    ends = [*np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]
    for part, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
        if low < high:
            yield part, slice(low, high), packed(np.diff(keys[low:high], prepend=np.uint64(edges[part])))


@dataclass
class Grams:
    """Distinct n-grams of one length: sorted ``keys``; where one of each key begins; and the place among the keys of what begins at each token (-1:
    nothing, as the text ends)."""

    keys: np.ndarray
    first: np.ndarray
    at: np.ndarray


@dataclass
class Known:
    """What a block is told: counts of its pairs and of its triples (zero if no arc), which of these it has the sums to make for, counts of its words, and
    weights of the contexts that it asked for (not a number: no state)."""

    pairs: np.ndarray
    own_pairs: np.ndarray
    triples: np.ndarray
    own_triples: np.ndarray
    c: np.ndarray
    weights: np.ndarray


@dataclass
class Block:
    """The tokens of some texts: hashes of the words, the number of each token's word, and of its text."""

    hashes: np.ndarray
    tokens: np.ndarray
    own: np.ndarray

    @staticmethod
    def of(row: dict) -> Block:
        """From the columns of ``block_tokens``."""
        sizes = np.frombuffer(row["sizes"], np.int64)
        own = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return Block(np.frombuffer(row["hashes"], np.uint64), unpacked(row["tokens"]).astype(np.int32), own)

    def grams(self, length: int) -> Grams:
        """The pairs or the triples."""
        pair, triple, at_pair, at_triple = gram_keys(self.hashes[self.tokens], self.own)
        begin, keys = (at_pair, pair) if length == 2 else (at_triple, triple)
        keys = keys[begin]
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.full(len(self.tokens), -1, np.int32)
        at[begin[order]] = np.cumsum(new) - 1
        return Grams(keys[new], begin[order[new]], at)

    def arrivals(self, pairs: Grams, triples: Grams, known: Known) -> tuple[np.ndarray, ...]:
        """Of each token: the pair and the triple that end with it, the pair and the word before it (-1: none), and whether the triple, or else the pair,
        is an arc."""
        pair, triple, context, before = np.full((4, len(self.tokens)), -1, np.int32)
        pair[1:], triple[2:] = pairs.at[:-1], triples.at[:-2]
        context[2:] = np.where(triples.at[:-2] >= 0, pairs.at[:-2], -1)
        before[1:] = np.where(pairs.at[:-1] >= 0, self.tokens[:-1], -1)
        by_triple = np.append(known.triples, 0)[triple] > 0
        return pair, triple, context, before, by_triple, (np.append(known.pairs, 0)[pair] > 0) & ~by_triple

    def contexts(self, pairs: Grams, triples: Grams, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a block asks the weights of, as it may fail there or has sums of it: keys, sorted; the numbers of words and the places of pairs among
        them; and the order before sorting. Only what occurs often enough can be a state."""
        _, _, context, before, by_triple, by_pair = self.arrivals(pairs, triples, known)
        word, pair = np.zeros(len(self.hashes), bool), np.zeros(len(pairs.keys), bool)
        word[before[(before >= 0) & ~by_triple & ~by_pair]] = pair[context[(context >= 0) & ~by_triple]] = True
        word[self.tokens[pairs.first[known.own_pairs]]] = pair[pairs.at[triples.first[known.own_triples]]] = True
        words, arcs = np.flatnonzero(word & (known.c >= LEAST_COUNT)), np.flatnonzero(pair & (known.pairs > 0))
        keys = np.concatenate([self.hashes[words], pairs.keys[arcs]])
        order = np.argsort(keys, kind="stable")
        return keys[order], words, arcs, order

    def shares(self, pairs: Grams, triples: Grams, known: Known, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each context in ``contexts``: its key, its count, and sums over those of its arcs that are the block's: of what their counts keep after
        the discount, and of the shorter context's probabilities."""
        keys, words, arcs, order = self.contexts(pairs, triples, known)
        given, taken = np.zeros((2, len(self.hashes) + len(pairs.keys)))
        at = pairs.first[known.own_pairs]
        left, right = self.tokens[at], self.tokens[at + 1]
        np.add.at(given, left, known.pairs[known.own_pairs] - DISCOUNT)
        np.add.at(taken, left, (known.c[right] + 1) / every)
        at = triples.first[known.own_triples]
        context, tail = pairs.at[at] + len(self.hashes), pairs.at[at + 1]
        # Every pair within a triple is as frequent as that, so it is an arc.
        np.add.at(given, context, known.triples[known.own_triples] - DISCOUNT)
        np.add.at(taken, context, (known.pairs[tail] - DISCOUNT) / known.c[self.tokens[at + 1]])
        which = np.concatenate([words, arcs + len(self.hashes)])[order]
        return keys, np.concatenate([known.c[words], known.pairs[arcs]])[order], given[which], taken[which]

    def walk(self, pairs: Grams, triples: Grams, known: Known, logs: np.ndarray) -> np.ndarray:
        """Each text's log10 probability by ``Automaton``'s states; ``logs`` are the words' in the empty context.

        The state after a token is its longest context that is one, so all tokens take their arc, or fail to the shorter context, at once.
        """
        _, words, arcs, order = self.contexts(pairs, triples, known)
        weight = np.empty(len(order))
        weight[order] = known.weights
        of_word, of_pair = np.full(len(self.hashes) + 1, np.nan), np.full(len(pairs.keys) + 1, np.nan)
        of_word[words], of_pair[arcs] = weight[: len(words)], weight[len(words) :]
        pair, triple, context, before, by_triple, by_pair = self.arrivals(pairs, triples, known)
        steps = np.zeros((len(self.tokens), 3))  # at the pair, at the word, at the empty context
        steps[by_triple, 0] = np.log10((known.triples[triple[by_triple]] - DISCOUNT) / known.pairs[context[by_triple]])
        steps[~by_triple, 0] = np.nan_to_num(of_pair[context[~by_triple]])
        steps[by_pair, 1] = np.log10((known.pairs[pair[by_pair]] - DISCOUNT) / known.c[before[by_pair]])
        empty = ~(by_triple | by_pair)
        steps[empty, 1] = np.nan_to_num(of_word[before[empty]])
        steps[empty, 2] = logs[self.tokens[empty]]
        return np.bincount(np.repeat(self.own, 3), steps.ravel())


def block_tokens(rows: DataFrame) -> DataFrame:
    """One row per block of texts: ``block, doc_id, held_out`` (arrays), ``learned`` (tokens in documents to learn from), ``sizes`` (tokens of each text),
    ``tokens`` (numbers of words), and of the words ``hashes`` and, as two may share one, ``checks``."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, docs, parts = None, [], [], []
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        total = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in parts], np.int64)
            hashes, checks = np.array([word_hash(word) for word in numbers], np.uint64), np.array([zlib.crc32(word) & 0xFFFF for word in numbers], np.uint16)
            columns = [
                pa.array([at], pa.int64()), pa.array([docs], pa.list_(kind_of)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([int(sizes[~np.array(held)].sum())], pa.int64()), *(
                    pa.array([x], pa.binary()) for x in (sizes.tobytes(), packed(np.concatenate(parts)), hashes.tobytes(), checks.tobytes()))]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "held_out", "learned", "sizes", "tokens", "hashes", "checks"])

        for batch in batches:
            kind_of = batch.schema.field(1).type
            for row, doc, out, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                at = row if at is None else at
                words = words_of(text.as_py())
                parts.append(np.array(list(map(numbers.__getitem__, words)), np.int32))
                held.append(out)
                docs.append(doc)
                total += len(words)
                if total >= BLOCK_TOKENS:
                    yield flush()
                    at, held, docs, parts, total = None, [], [], [], 0
                    numbers.clear()
        if parts:
            yield flush()

    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = "learned long, sizes binary, tokens binary, hashes binary, checks binary"
    return rows.mapInArrow(per_batch, f"block long, doc_id array<{kind}>, held_out array<boolean>, {fields}")


def _merged(column: pa.ChunkedArray, checks: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What the blocks sent to a range of keys: keys by block; the order that sorts all of them (of equal ones, by ``checks``); where each distinct
    one begins in it; and which of the distinct ones each is, in that order."""
    keys = [np.cumsum(unpacked(x)) for x in column.to_pylist()]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable") if checks is None else np.lexsort((checks, every))
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    if checks is not None:
        new[1:] |= checks[order[1:]] != checks[order[:-1]]
    return keys, order, np.flatnonzero(new), np.cumsum(new) - 1


def _answers(values: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(x) for x in keys])[:-1])


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    kinds = {"part": pa.int32(), "block": pa.int64()}
    schema = pa.schema([(name, kinds.get(name, pa.binary())) for name in names.split()])
    return pa.Table.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)


def word_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """``block, part, c, kinds``: for each range of hashes that a block has words in, their counts in documents to learn from, in order of the hashes and
    packed; ``kinds`` adds up to how many words have any."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, checks, sizes = (np.frombuffer(row[name], kind) for name, kind in (("hashes", np.uint64), ("checks", np.uint16), ("sizes", np.int64)))
                learn = unpacked(row["tokens"]).astype(np.int64)[~np.repeat(np.array(row["held_out"]), sizes)]
                n, order = np.bincount(learn, minlength=len(hashes)), np.argsort(hashes, kind="stable")
                n, checks = n[order], checks[order]
                sent = [(part, row["block"], keys, checks[some].tobytes(), packed(n[some])) for part, some, keys in by_part(hashes[order], parts)]
                yield from _rows("part block keys checks n", sent).to_batches()

    def count(sent: pa.Table) -> pa.Table:
        checks = np.concatenate([np.frombuffer(x, np.uint16) for x in sent.column("checks").to_pylist()])
        keys, order, starts, of = _merged(sent.column("keys"), checks)
        n = np.concatenate([unpacked(x) for x in sent.column("n").to_pylist()])
        total = np.add.reduceat(n[order], starts)
        c = np.empty_like(n)
        c[order] = total[of]
        kinds = np.zeros(len(sent), np.int64)
        kinds[0] = (total > 0).sum()
        return pa.table({
            "block": sent.column("block"), "part": sent.column("part"), "c": pa.array([packed(x) for x in _answers(c, keys)], pa.binary()), "kinds": kinds})

    asked = blocks.select("block", "held_out", "sizes", "tokens", "hashes", "checks").mapInArrow(
        send, "part int, block long, keys binary, checks binary, n binary")
    return asked.groupBy("part").applyInArrow(count, "block long, part int, c binary, kinds long")


def gram_counts(blocks: DataFrame, length: int, parts: int) -> DataFrame:
    """``block, part`` and ``pairs`` or ``triples``: for each range of keys that a block has such n-grams in, their counts in the whole corpus, in order
    of the keys and packed: twice the count (zero if that is no arc), and one more for the one block that has its sums to make."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row, = batch.slice(k, 1).to_pylist()
                block = Block.of(row)
                grams, held = block.grams(length), np.array(row["held_out"])
                n = np.bincount(grams.at[(grams.at >= 0) & ~held[block.own]], minlength=len(grams.keys))
                sent = [(part, row["block"], keys, packed(n[some])) for part, some, keys in by_part(grams.keys, parts)]
                yield from _rows("part block keys n", sent).to_batches()

    def count(sent: pa.Table) -> pa.Table:
        sent = sent.sort_by("block")
        keys, order, starts, of = _merged(sent.column("keys"))
        n = np.concatenate([unpacked(x) for x in sent.column("n").to_pylist()])
        total = np.add.reduceat(n[order], starts)
        total[total < LEAST_COUNT] = 0
        answer = np.empty_like(n)
        answer[order] = total[of] * np.uint64(2)
        answer[order[starts]] += (total > 0).astype(np.uint64)
        return pa.table({"block": sent.column("block"), "part": sent.column("part"), name: pa.array([packed(x) for x in _answers(answer, keys)], pa.binary())})

    name = "pairs" if length == 2 else "triples"
    asked = blocks.select("block", "held_out", "sizes", "tokens", "hashes").mapInArrow(send, "part int, block long, keys binary, n binary")
    return asked.groupBy("part").applyInArrow(count, f"block long, part int, {name} binary")


def _known(answers: pa.Table, hashes: np.ndarray) -> Known:
    """From all that a block was told, of any part and kind."""
    answers = answers.sort_by("part")

    def of(name: str) -> list[bytes]:
        return answers.column(name).drop_null().to_pylist() if name in answers.column_names else []

    pairs, triples, counts, state = (np.concatenate([np.zeros(0, np.uint64), *map(unpacked, of(name))]) for name in ("pairs", "triples", "c", "state"))
    c, weights = np.empty(len(hashes), np.int64), np.full(len(state), np.nan)
    c[np.argsort(hashes, kind="stable")] = counts
    weights[state > 0] = np.frombuffer(b"".join(of("weight")))
    one = np.uint64(1)
    return Known(
        (pairs >> one).astype(np.int64), (pairs & one).astype(bool), (triples >> one).astype(np.int64), (triples & one).astype(bool), c, weights)


def context_weights(blocks: DataFrame, known: DataFrame, every: int, parts: int, turn: int) -> DataFrame:
    """``block, part, state, weight``: for each range of keys of this turn which of a block's contexts are states, in order of the keys and packed, and the log10
    weights of those. A context's arcs leave some of its count, which goes to the shorter context's probabilities of all other words."""

    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row, = texts.to_pylist()
        block = Block.of(row)
        keys, total, given, taken = block.shares(block.grams(2), block.grams(3), _known(answers, block.hashes), every)
        sent = [
            (part, row["block"], own, packed(total[some]), packed((given[some] * 4).astype(np.uint64)), taken[some][given[some] > 0].tobytes())
            for part, some, own in by_part(keys, parts) if part % ROUNDS == turn]
        return _rows("part block keys total given taken", sent)

    def weigh(sent: pa.Table) -> pa.Table:
        sent = sent.sort_by("block")
        keys, order, starts, of = _merged(sent.column("keys"))
        total, given = (np.concatenate([unpacked(x) for x in sent.column(name).to_pylist()]) for name in ("total", "given"))
        taken = np.zeros(len(given))
        taken[given > 0] = np.concatenate([np.frombuffer(x) for x in sent.column("taken").to_pylist()])
        given = np.add.reduceat(given[order], starts) / 4  # quarters, as the discount is three of them
        total, taken = total[order[starts]], np.add.reduceat(taken[order], starts)
        left = np.maximum(1 - given / np.maximum(total, 1), 1e-12) / np.maximum(1 - taken, 1e-12)
        weight = np.empty(len(order))
        weight[order] = np.where(given > 0, np.log10(left), np.nan)[of]
        weights = _answers(weight, keys)
        return pa.table({
            "block": sent.column("block"), "part": sent.column("part"), "state": pa.array([packed(~np.isnan(x)) for x in weights], pa.binary()),
            "weight": pa.array([x[~np.isnan(x)].tobytes() for x in weights], pa.binary())})

    asked = blocks.select("block", "sizes", "tokens", "hashes").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        send, "part int, block long, keys binary, total binary, given binary, taken binary")
    return asked.groupBy("part").applyInArrow(weigh, "block long, part int, state binary, weight binary")


@dataclass
class Automaton:
    """States are contexts: 0 the empty one, then words, then pairs. An arc of a state is a word; a missing one falls back.

    ``arcs[state << _BITS | word] = (log10 probability, next state)``; ``fail`` and ``weight`` per state; ``entry[word]`` is the state
    after a word met in the empty context.
    """

    arcs: dict[int, tuple[float, int]]
    fail: list[int]
    weight: list[float]
    entry: list[int]

    @staticmethod
    def build(
        words: dict[int, int], grams: dict[int, int], tokens: int, kinds: int, weights: dict[int, float] | None = None,
    ) -> Automaton:
        """From counts of words by id (from 1) and of pairs and triples by packed ids; probabilities sum to one in every state.

        An n-gram of count n after a context of count m gets (n - DISCOUNT) / m; what this leaves of the context goes to the
        shorter context's probabilities of all other words. With ``weights`` of contexts ``grams`` may hold some of their arcs only.
        """
        mask = (1 << _BITS) - 1
        base = {w: (c + 1) / (tokens + kinds + 1) for w, c in words.items()}
        by_context: dict[int, list[tuple[int, int]]] = {}
        for gram, n in grams.items():
            context = gram >> _BITS
            if context <= mask or context in grams:
                by_context.setdefault(context, []).append((gram & mask, n))
        order = sorted(by_context if weights is None else weights)  # words before pairs
        state_of = {context: k for k, context in enumerate(order, 1)}
        fail, weight = [0], [0.0]
        arcs: dict[int, tuple[float, int]] = {}
        chance: dict[int, float] = {}  # of every arc, by state and word

        def lower(state: int, word: int) -> float:
            scale = 1.0
            while state:
                found = chance.get(state << _BITS | word)
                if found is not None:
                    return scale * found
                scale *= 10 ** weight[state]
                state = fail[state]
            return scale * base[word]

        for context in order:
            state = state_of[context]
            back = state_of.get(context & mask, 0) if context > mask else 0
            total = grams[context] if context > mask else words[context]
            given = taken = 0.0
            for word, n in by_context.get(context, ()):
                p = (n - DISCOUNT) / total
                chance[state << _BITS | word] = p
                given += p
                if weights is None:
                    taken += lower(back, word)
            fail.append(back)
            weight.append(math.log10(max(1 - given, 1e-12) / max(1 - taken, 1e-12)) if weights is None else weights[context])
        after = lambda context, word: state_of.get((context & mask) << _BITS | word, state_of.get(word, 0))
        for context in order:
            for word, _ in by_context.get(context, ()):
                key = state_of[context] << _BITS | word
                arcs[key] = (math.log10(chance[key]), after(context, word))
        entry = [state_of.get(w, 0) for w in range(max(words, default=0) + 1)]
        return Automaton(arcs, fail, weight, entry)

    def score(self, ids: list[int], logs: list[float]) -> float:
        """The log10 probability of a token sequence: ids (0: not in any arc) and log-probabilities in the empty context."""
        arcs, fail, weight, entry = self.arcs.get, self.fail, self.weight, self.entry
        total, state = 0.0, 0
        for word, log in zip(ids, logs, strict=True):
            while state:
                found = arcs(state << _BITS | word) if word else None
                if found:
                    total += found[0]
                    state = found[1]
                    break
                total += weight[state]
                state = fail[state]
            else:
                total += log
                state = entry[word]
        return total


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs (doc_id, text)``.

    The base score is that of add-one word frequencies, the score that of the automaton; both are log10 probabilities of the words and
    an end mark. Null and empty texts are the end mark alone. Repeated rows count and are scored each; a missing doc_id counts as the empty
    text in the split; an empty table gives an empty one; other columns are not read. N-grams and their contexts are told apart by 64-bit
    hashes, words by 80 bits.
    """
    blocks = stored(block_tokens(split(docs)), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]
    parts = min(MOST_PARTS, max(1, tokens // PART_TOKENS))
    words = stored(word_counts(blocks, parts), "words")
    kinds = words.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    every = tokens + kinds + 1
    pairs = stored(gram_counts(blocks, 2, parts), "pairs")
    triples = stored(gram_counts(blocks, 3, parts), "triples")
    known = words.drop("kinds").unionByName(pairs, allowMissingColumns=True).unionByName(triples, allowMissingColumns=True)
    weights = [stored(context_weights(blocks, known, every, parts, turn), "weights") for turn in range(ROUNDS)]
    for some in weights:
        known = known.unionByName(some, allowMissingColumns=True)

    def per_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row, = texts.select(["sizes", "tokens", "hashes"]).to_pylist()
        block = Block.of(row)
        known = _known(answers, block.hashes)
        c = known.c
        logs = np.array([math.log10((x + 1) / every) for x in c.tolist()])
        sizes = np.frombuffer(row["sizes"], np.int64)
        single, ends = logs[block.tokens].tolist(), np.cumsum(sizes).tolist()
        base = [math.fsum(single[low:high]) for low, high in zip([0, *ends], ends, strict=False)]
        return pa.table({
            "doc_id": texts.column("doc_id").combine_chunks().flatten(), "held_out": texts.column("held_out").combine_chunks().flatten(),
            "n_tokens": pa.array(sizes), "n_known": pa.array(np.bincount(block.own[c[block.tokens] > 0], minlength=len(sizes)).astype(np.int64)),
            "train_tokens": pa.array([tokens] * len(sizes), pa.int64()), "base_score": pa.array(base, pa.float64()),
            "score": pa.array(block.walk(block.grams(2), block.grams(3), known, logs))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = blocks.select("block", "doc_id", "held_out", "sizes", "tokens", "hashes")
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(per_block, fields)
