"""LM scoring by subword lattice likelihood: the marginal probability of a text over all segmentations of its words.

The pieces and their first weights are those of an existing vocabulary; expected counts over the word types of the corpus
(one step of expectation and maximisation) turn them into probabilities. A word is the marker of a word start followed by
its bytes; its lattice has an edge for every piece, and single-byte pieces make every word possible. The pieces that start
words and those that go on share one distribution, so the lattice gives all words together probability 1. A word of the
training texts has one more edge, over all of it: its count less a discount; what the discounts free goes to the pieces.
The forward recursion runs in log space over the lattices of many words of one length at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import textkit as T
from parley.llm.scratch import Scratch

MARK = "▁".encode()
#: Word types with at least this share of all tokens, at most 1 / HEAVY of them, are sent to every task.
HEAVY = 1e-6
#: What the whole-word edge of each training type gives to the pieces, where types seen once and twice do not tell it.
DISCOUNT = 0.75
_CELLS = 22


class Vocabulary:
    """Pieces by the hash of their bytes: those that start with the marker begin words, the others follow."""

    def __init__(self, pieces: list[tuple[str, float]]):
        rows: dict[int, int] = {}
        known: list[bytes] = []
        self.byte = np.full(256, -1)
        rank = np.array([-s for _, s in pieces], dtype=float)
        self.n, self.longest = len(pieces), 1
        for k, (piece, score) in enumerate(pieces):
            raw = piece.encode()
            if len(piece) == 6 and piece.startswith("<0x"):
                self.byte[int(piece[3:5], 16)] = k
            elif (score > -1e8 or raw == MARK) and not (piece.startswith("<") and score == 0) and MARK not in raw[1:]:
                rows[T.hash_bytes(raw)] = k
                known.append(raw)
                self.longest = max(self.longest, len(raw))
        if (self.byte < 0).any():
            raise ValueError("the vocabulary needs a piece for each byte")
        order = sorted(rows)
        self.keys, self.ids = np.array(order, dtype=np.uint64), np.array([rows[h] for h in order])
        # cells of hashes: 2 where a piece ends, 1 where a longer piece goes on
        self.maybe = np.zeros(1 << _CELLS, dtype=np.uint8)
        self.maybe[(self.keys >> T.U(64 - _CELLS)).astype(np.int64)] = 2
        longer = {raw[:n] for raw in known for n in range(1, len(raw))}
        self.maybe[[T.hash_bytes(p) >> (64 - _CELLS) for p in longer]] |= 1
        # the file's scores are ranks of a merge order: weights fall with the rank
        usable = np.zeros(self.n, dtype=bool)
        usable[self.ids] = usable[self.byte] = True
        weight = 1 / (np.clip(rank, 0, 4e4) + 20)
        weight[self.byte] = 1e-4
        self.first = np.where(usable, weight, 0) / weight[usable].sum()

    @staticmethod
    def from_file(path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Vocabulary([(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())])

    def edges(self, words: np.ndarray):
        """Lattice edges of equally long words (a byte matrix with the marker): lists by end of (start, rows, pieces).

        From each start only the words go on whose bytes so far begin some piece.
        """
        m, length = words.shape
        up, down = T._power("up", T._BASE, length), T._power("down", T._INVERSE, length + 1)
        sums = np.zeros((length + 1, m), dtype=np.uint64)
        np.cumsum(T._RANDOM[words.T] * up[:, None], axis=0, out=sums[1:])
        every, skip = np.arange(m), len(MARK)
        by_end: list[list] = [[] for _ in range(length + 1)]
        for start in (0, *range(skip, length)):
            if start:
                by_end[start + 1].append((start, every, self.byte[words[:, start]]))
            rows = every
            for end in range(start + 1, min(length, start + self.longest) + 1):
                key = T.mix((sums[end][rows] - sums[start][rows]) * down[start] + T.U((end - start) * 0xD6E8FEB86659FD93 & (2**64 - 1)))
                cell = self.maybe[(key >> T.U(64 - _CELLS)).astype(np.int64)]
                whole = np.flatnonzero(cell & 2)
                if len(whole):
                    at = np.minimum(np.searchsorted(self.keys, key[whole]), len(self.keys) - 1)
                    hit = self.keys[at] == key[whole]
                    by_end[end].append((start, rows[whole[hit]], self.ids[at[hit]]))
                rows = rows[(cell & 1).astype(bool)]
                if not len(rows):
                    break
        return by_end

    def forward(self, words: np.ndarray, log_p: np.ndarray, edges=None) -> np.ndarray:
        """Log of the summed probability of all segmentations of each prefix."""
        edges = edges or self.edges(words)
        alpha = np.full((words.shape[1] + 1, words.shape[0]), -np.inf)
        alpha[0] = 0
        for end, own in enumerate(edges):
            for start, rows, ids in own:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + log_p[ids])
        return alpha

    def expected(self, words: np.ndarray, log_p: np.ndarray, into: np.ndarray) -> None:
        """Add to `into` how often each piece is expected in the words."""
        edges = self.edges(words)
        alpha = self.forward(words, log_p, edges)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for end in range(len(edges) - 1, 0, -1):
            for start, rows, ids in edges[end]:
                beta[start, rows] = np.logaddexp(beta[start, rows], beta[end, rows] + log_p[ids])
        for end, own in enumerate(edges):
            for start, rows, ids in own:
                into += np.bincount(ids, np.exp(alpha[start, rows] + log_p[ids] + beta[end, rows] - alpha[-1, rows]), minlength=self.n)


def _by_length(words: list[bytes], most: int = 1 << 19):
    """(numbers, byte matrix with the marker) of words of one length, about `most` bytes at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        same = np.flatnonzero(lengths == length)
        step = max(1, most // int(length + len(MARK)))
        for lo in range(0, len(same), step):
            part = same[lo : lo + step]
            body = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), length)
            yield part, np.concatenate([np.tile(np.frombuffer(MARK, np.uint8), (len(part), 1)), body], axis=1)


def held_out(fold: int, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


#: Bytes of text whose word types are counted together before they are sent.
_COUNTED = 1 << 24


def _count_task(batches):
    """Word types of about _COUNTED bytes of text at a time: hash, bytes, count in training texts."""

    def types(held):
        hashes = np.concatenate([h for h, *_ in held])
        found, where, number = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.bincount(number, np.concatenate([t for _, t, *_ in held]), minlength=len(found)).astype(np.int64)
        first = np.cumsum([0] + [len(h) for h, *_ in held])
        part = np.searchsorted(first, where, "right") - 1
        words = [held[p][4][held[p][2][i] : held[p][3][i]].tobytes() for p, i in zip(part, where - first[part])]
        return pa.RecordBatch.from_arrays([T.longs(found), pa.array(words, pa.binary()), pa.array(counts)], names=["h", "word", "c"])

    held, size = [], 0
    for batch in batches:
        train = ~np.array(batch.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)
        for first, last, data, offsets in T.texts(batch.column("text")):
            hashes, at, starts, ends, low = T.word_hashes(data, offsets)
            if len(hashes):
                held.append((hashes, np.repeat(train[first:last], np.diff(at)), starts.astype(np.int32), ends.astype(np.int32), low))
                size += len(data)
            if size >= _COUNTED:
                yield types(held)
                held, size = [], 0
    if held:
        yield types(held)


def _expect_task(vocabulary, log_p):
    def run(batches):
        v, p = vocabulary.value, log_p.value
        total = np.zeros(v.n)
        for batch in batches:
            words = [w.as_py() for w in batch.column("word")]
            for _, rows in _by_length(words):
                v.expected(rows, p, total)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["piece", "n"])

    return run


def _word_task(vocabulary, log_p, total: int, types: int, discount: float):
    whole, shared = (1 / total, discount * types / total) if types else (0.0, 1.0)

    def run(batches):
        v, p = vocabulary.value, log_p.value
        for batch in batches:
            words = [w.as_py() for w in batch.column("word")]
            out = np.zeros(len(words))
            for part, rows in _by_length(words):
                out[part] = v.forward(rows, p)[-1]
            counts = batch.column("c").to_numpy()
            with np.errstate(divide="ignore"):
                out = np.logaddexp(np.log(shared) + out, np.log(np.maximum(counts - discount, 0) * whole)) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(out)], names=["h", "c", "lp"])

    return run


def _score_task(heavy, total: int, types: int, ends: int, end_lp: float):
    """A row per text with what the heavy types give, and a row per other type of the text."""
    floor = np.log10(total + 0.5 * (types + 1))

    def run(batches):
        keys, counts, lps = heavy.value
        base_of = np.log10(counts + 0.5) - floor
        end = (np.log10(ends + 0.5) - floor, end_lp)
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            rids, light, tfs, sums = [], [], [], []
            for first, last, data, offsets in T.texts(batch.column("text")):
                hashes, at, *_ = T.word_hashes(data, offsets)
                n = last - first
                row = np.repeat(np.arange(n), np.diff(at))
                if len(keys) and len(hashes):
                    where = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    hit = keys[where] == hashes
                    where = where[hit]
                    known, base, lp = (np.bincount(row[hit], w, minlength=n) for w in (counts[where] > 0, base_of[where], lps[where]))
                    hashes, row = hashes[~hit], row[~hit]
                else:
                    known, base, lp = np.zeros(n), np.zeros(n), np.zeros(n)
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                new = np.ones(len(hashes), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                cut = np.flatnonzero(new)
                rids.append(rid[first + row[cut]])
                light.append(hashes[cut])
                tfs.append(np.diff(np.append(cut, len(hashes))))
                sums.append((np.diff(at) + 1, known + (ends > 0), base + end[0], lp + end[1]))
            k = sum(len(x) for x in light)
            tokens, known, base, lp = (np.concatenate(c) if sums else np.zeros(0) for c in (zip(*sums) if sums else [()] * 4))
            summary = pa.StructArray.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(lp)], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "lp"])
            # a summary meets no word type; its key only spreads such rows
            yield pa.RecordBatch.from_arrays([pa.array(rid), T.longs(T.mix(rid.view(np.uint64))), pa.array(np.zeros(len(rid), np.int64)), summary], names=["rid", "h", "tf", "s"])
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rids)), T.longs(np.concatenate(light)), pa.array(np.concatenate(tfs)), pa.nulls(k, summary.type)], names=["rid", "h", "tf", "s"])

    return run


def score_texts(spark: SparkSession, docs: DataFrame, vocabulary_path: str, fold: int = 1, prior: float = 100.0, rounds: int = 2) -> DataFrame:
    """One row per row of `docs` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words `[^\\x20\\x09-\\x0D]+` in ASCII lower case and one end. Counts come from the rows whose
    crc32(doc_id as text) mod 5 is not `fold` (a null doc_id counts as the empty text). base_score is the smoothed unigram
    score of the tokens, score the log10 probability of the text in the lattice model, the end included. Null texts are
    empty: one token. Repeated rows count and return as often as they occur. An empty table gives an empty result.

    Frequent word types go to every task (at most 1 / HEAVY types have that share of the tokens); the others meet their
    counts in a join on the word, and partial sums by text follow.
    """
    scratch = Scratch(spark, "lattice")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(fold).alias("held_out"))
    types = scratch.write(docs.select("text", "held_out").mapInArrow(_count_task, "h long, word binary, c long").groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c")), "types")
    n, v, once, twice = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = once / (once + 2 * twice) if once and twice else DISCOUNT
    ends = docs.where("not held_out").count()
    total, kinds = n + ends, v + (ends > 0)
    vocabulary = Vocabulary.from_file(vocabulary_path)
    sent = spark.sparkContext.broadcast(vocabulary)

    def logs(p: np.ndarray):
        with np.errstate(divide="ignore"):
            return spark.sparkContext.broadcast(np.log(p))

    p = vocabulary.first
    for _ in range(rounds):
        found = types.where("c > 0").select("word").mapInArrow(_expect_task(sent, logs(p)), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row per piece at most
        expected = prior * vocabulary.first
        expected[found.column("piece").to_numpy()] += found.column("n").to_numpy()
        p = expected / expected.sum()
    words = scratch.write(types.mapInArrow(_word_task(sent, logs(p), total, kinds, discount), "h long, c long, lp double"), "words")
    heavy = words.where(F.col("c") >= max(1, total * HEAVY)).toArrow().sort_by("h")
    end_lp = float(np.log10((ends - discount) / total)) if ends else 0.0
    keys = heavy.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    scratch.close(words)
    table = spark.sparkContext.broadcast((keys[order], heavy.column("c").to_numpy()[order], heavy.column("lp").to_numpy()[order]))
    schema = "rid long, h long, tf long, s struct<doc_id: long, held_out: boolean, n_tokens: long, n_known: long, base: double, lp: double>"
    rows = docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_score_task(table, total, kinds, ends, end_lp), schema)
    rest = words.where(F.col("c") < max(1, total * HEAVY))
    floor = F.lit(float(np.log10(max(total, 0) + 0.5 * (kinds + 1))))
    met = rows.join(rest, "h", "left").select(
        "rid", "s", F.when(F.col("s").isNull() & (F.col("c") > 0), F.col("tf")).otherwise(0).alias("known"),
        F.when(F.col("s").isNull(), F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - floor)).otherwise(0.0).alias("base"),
        F.when(F.col("s").isNull(), F.col("tf") * F.col("lp")).otherwise(0.0).alias("lp"),
    )
    summed = met.groupBy("rid").agg(F.max("s").alias("s"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("lp").alias("lp"))
    return summed.select("s.doc_id", "s.held_out", "s.n_tokens", (F.col("s.n_known") + F.col("known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("s.base") + F.col("base")).alias("base_score"), (F.col("s.lp") + F.col("lp")).alias("score"))
