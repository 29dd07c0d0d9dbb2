"""Operator 13: scores of texts by a weighted backoff automaton of smoothed n-grams.

The model is an n-gram model of the learned texts, each a start, its words and an end. A history's words are
smoothed by a Dirichlet prior around the next shorter history, P(w | h) = (c(hw) + prior * P(w | h')) / (c(h) + prior), down to the
uniform distribution over the learned words, the end and one unknown word, so that every state's probabilities sum to 1. Histories that were
learned are states, learned n-grams are arcs, and a state that has no arc for a word fails over to that of the next shorter
history, at the cost of prior / (c(h) + prior). A text is read once from left to right: the state is carried from token
to token, and the log-probabilities of arcs and failures are added up.

The automaton grows with the corpus and is never in one place: each block of texts (see ``blocks``) asks for the counts of its own n-grams, of all orders, and builds the states
and arcs that its texts can reach. In a block many texts are read at once, step by step; a long one is read in segments, each of which begins
in the state that the words before it lead to.

Rows: a null text is empty, and an empty text is one end; rows without an id are learned from; equal rows count and are scored each; an empty
table gives no row; where nothing is learned, every word is unknown. Extra columns are not read. Counts of words are exact (digests of 88 bits tell words apart), those of longer n-grams up to collisions of 56 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, answers_of, corpus_counts, with_answers, write_blocks
from .common import bound_batches, parallelism, stash, stash_bucketed

#: Words of an n-gram, the weight of a shorter history's distribution by the n-gram's length, and tokens of a segment.
ORDER, PRIOR, SEGMENT = 3, (1.0, 100.0, 10.0), 512
#: What no word can be: the start and the end of a text.
START, END = b"\t", b""


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; rows without an id aren't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _read(_: tuple, data: bytes) -> tuple[bytes, Iterator[list[bytes]]]:
    return b"", iter([data.lower().split()])  # of bytes, these take A-Z and 0x20, 0x09-0x0D only


def _learned(block: Block, row: dict) -> np.ndarray:
    return np.repeat(~np.array(row["held_out"], bool), block.ends - block.starts)


class Automaton:
    """The states and arcs that a block's texts can reach. ``known[k]`` and ``weight[k]`` are given by the place at which an arc of k words ends:
    whether it exists, and its log-probability; ``failure[k]``, by the place at which a history of k words ends, what it costs to leave it."""

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, words: int, prior: tuple[float, ...]):
        order = len(counts)
        n = len(block.ids)
        self.order, self.known, self.weight, self.failure = order, [np.ones(n, bool)], [np.zeros(n)], [np.zeros(n)]
        less = np.full(len(counts[0]), 1 / (words + 1))
        for k in range(1, order + 1):
            c = counts[k - 1].astype(np.float64)
            of = counts[k - 2][block.heads[k - 1]].astype(np.float64) if k > 1 else np.full(len(c), float(tokens))
            tail = less[block.grams[k - 2][block.found_at[k - 1]]] if k > 1 else less
            p = (c + prior[k - 1] * tail) / (of + prior[k - 1])
            numbers = block.grams[k - 1]
            there = numbers >= 0
            self.known.append(there & (c > 0)[numbers] if len(c) else there)
            self.weight.append(np.log10(p)[numbers] if len(p) else np.zeros(n))
            if k < order:
                cost = np.log10(prior[k] / (c + prior[k]))
                self.failure.append(cost[numbers] if len(cost) else np.zeros(n))
            less = p

    def state(self, at: np.ndarray) -> np.ndarray:
        """How many words the state has that the tokens up to the given places lead to."""
        return sum((self.known[k][at].astype(np.int64) for k in range(1, self.order)), np.zeros(len(at), np.int64))

    def read(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The log-probability of each run of tokens lo..hi - 1, which begins in the state that the token before it leads to."""
        score = np.zeros(len(lo))
        state = self.state(lo - 1)
        by_length = np.argsort(lo - hi, kind="stable")
        lengths = (hi - lo)[by_length]
        for t in range(int(lengths[0]) if len(lengths) else 0):
            runs = by_length[: np.searchsorted(-lengths, -t, "left")]
            at, now, added = lo[runs] + t, state[runs], np.zeros(len(runs))
            for k in range(self.order - 1, -1, -1):
                there = np.flatnonzero(now == k)
                arc = self.known[k + 1][at[there]] if k else np.ones(len(there), bool)
                taken, failed = there[arc], there[~arc]
                added[taken] += self.weight[k + 1][at[taken]]
                now[taken] = np.where(self.known[k + 1][at[taken]], min(k + 1, self.order - 1), 0) + self.order + 1  # so that it isn't read again
                added[failed] += self.failure[k][at[failed] - 1]
                now[failed] = k - 1
            state[runs] = now - self.order - 1
            score[runs] += added
        return score


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held: Column | None = None, order: int = ORDER, prior: tuple[float, ...] = PRIOR, segment: int = SEGMENT) -> DataFrame:
    """A row a text: id_col, held_out, n_tokens, n_known (tokens that were learned), train_tokens, base_score (of words alone, each count one more), score. ``held``: the rows
    that aren't learned from, as a column; else ``held_out`` of the id. ``prior``: for words, pairs, and so on up to ``order``."""
    if order < 1 or len(prior) < order or min(prior) <= 0:
        raise ValueError("order must be 1 or more, and a positive prior is needed for each length")
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(held if held is not None else held_out(id_col), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    blocks = stash_bucketed(write_blocks(src, "text", ("id", "held_out"), _read, (START, END), (0, 1)), "blocks", "block", parallelism(spark))
    answers = stash(corpus_counts(blocks, order, _learned), "counts")
    # a start is a state, but no token; every learned text has one
    texts = blocks.agg(F.sum(F.size(F.filter("held_out", lambda h: ~h)).cast("long"))).first()[0] or 0
    distinct, occurrences = (x or 0 for x in answers.where("gram_order = 1").agg(F.sum("occurring"), F.sum("occurrences")).first())
    tokens, words = occurrences - texts, distinct - (texts > 0)
    id_type = src.schema["id"].dataType.simpleString()

    def use(left: pa.Table, row: dict, rows: list[dict]) -> pa.Table:
        block = Block(row, order)
        counts = [answers_of(block, rows, k) for k in range(1, order + 1)]
        automaton = Automaton(block, counts, tokens, words, prior)
        lo, hi = block.starts + 1, block.ends
        parts = -(-(hi - lo) // segment)
        of = np.repeat(np.arange(len(lo)), parts)
        begin = lo[of] + segment * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        scores = np.bincount(of, automaton.read(begin, np.minimum(begin + segment, hi[of])), len(lo))
        token = block.place > 0
        owner = np.repeat(np.arange(len(lo)), block.ends - block.starts)[token]
        c = counts[0][block.ids[token]].astype(np.float64)
        base = np.bincount(owner, np.log10((c + 1) / (tokens + words + 1)), len(lo))
        known = np.bincount(owner[c > 0], minlength=len(lo))
        # plain values of a list column, without its offsets
        ids, held_rows = (left[x].combine_chunks().flatten() for x in ("id", "held_out"))
        columns = [ids, held_rows, pa.array(hi - lo, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(lo), tokens), pa.int64()), pa.array(base), pa.array(scores)]
        return pa.Table.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = with_answers(blocks, answers, use, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumnRenamed("id", id_col)
