"""Operator 11: phrases whose words belong together, from a weighted de Bruijn graph of each language.

Nodes are runs of three words, and edges, the longest grams counted, runs of four: an edge leads from the node of its first three words
to that of its last three, and weighs as often as it occurs. What occurs at the end of a piece and is shorter than an edge is
counted as it is. Shorter counts then follow by flow: a phrase occurs as often as the edges that begin with it weigh, with the
ends that begin with it added.

A node is unary if all its occurrences come by one edge and leave by one. Paths of unary nodes (a text that is copied, say) are compacted: all their edges have
one weight, which is also the count of every node on them, and these nodes are no candidates of their own, as they lie in an edge of the
same count. Paths are found by pointer doubling over written tables, so rounds grow with the logarithm of a path's length.

Only phrases that occur ``least`` times matter. So before edges are counted, blocks of texts (see ``blocks``) learn which of their words, pairs and runs of three can be part of one, and
a window ends where none can be: such a place counts like the end of a piece, and the counts of all phrases that occur ``least`` times stay exact. The
hashes by which that is done can only let too much pass.

Rows: a null text is empty, a null language is ``und``; equal rows count each; without words or candidates there is no row. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import Block, answers_of, corpus_counts, more_counts, with_answers, write_blocks
from .common import bound_batches, parallelism, stash, stash_bucketed

#: Occurrences of a candidate, percent of a phrase's occurrences within a longer one at which it is dropped, phrases of a language, words of an edge.
LEAST, WITHIN, FIRST, WORDS = 30, 80, 2000, 4
UNKNOWN = "und"
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")


def _read(columns: tuple, data: bytes) -> tuple[bytes, Iterator[list[bytes]]]:
    pieces = (piece.split() for piece in _BREAK.split(data.lower()))  # of bytes: A-Z, 0x20 and 0x09
    return columns[0].encode("unicode_escape"), (words for words in pieces if words)


def _beginning(block: Block, order: int) -> np.ndarray:
    """By place, the number of the n-gram that begins there (-1: none)."""
    numbers = np.full(len(block.ids) + WORDS, -1, np.int64)
    ending = np.flatnonzero(block.grams[order - 1] >= 0)
    numbers[ending - order + 1] = block.grams[order - 1][ending]
    return numbers


def _likely_threes(block: Block, rows: list[dict]) -> np.ndarray:
    """Numbers of the block's runs of three words both of whose pairs are likely."""
    pairs = answers_of(block, rows, 2, np.uint8) > 0
    ends = block.found_at[2]
    return np.flatnonzero(pairs[block.heads[2]] & pairs[block.grams[1][ends]])


def _windows(block: Block, rows: list[dict]) -> pa.Table:
    """lang, gram, k (its words) and c of a block: from each place the longest run up to an edge all of whose shorter runs are likely; with k 0 all words of each language."""
    n = len(block.ids)
    likely = [answers_of(block, rows, 1, np.uint8), answers_of(block, rows, 2, np.uint8), answers_of(block, rows, 3, np.uint8, _likely_threes(block, rows))]
    two, three = (_beginning(block, k) for k in (2, 3))
    there = [(numbers >= 0) & (np.append(flags, 0)[numbers] > 0) for numbers, flags in ((two, likely[1]), (three, likely[2]))]
    going = likely[0][block.ids] > 0
    length = going.astype(np.int8)
    for more in (there[0][:n], there[1][:n], there[1][1 : n + 1]):
        going = going & more
        length += going
    langs, grams, ks, cs = [], [], [], []
    named = [k.decode("unicode_escape") for k in block.kinds]
    for k in range(1, WORDS + 1):
        at = np.flatnonzero(length == k)
        if not len(at):
            continue
        code = (block.ids, two, three, three)[k - 1][at].astype(np.int64)
        if k == WORDS:
            code = code * len(block.words) + block.ids[at + k - 1]
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        runs = block.ids[at[first][:, None] + np.arange(k)].tolist()
        langs += [named[run[0]] for run in runs]
        grams += [b" ".join([block.words[i] for i in run]) for run in runs]
        ks += [k] * len(runs)
        cs += count.tolist()
    words: dict[str, int] = {}
    for lang, c in zip(named, np.bincount(block.ids, minlength=len(named)).tolist(), strict=True):
        words[lang] = words.get(lang, 0) + c
    langs, grams, ks, cs = langs + [*words], grams + [b""] * len(words), ks + [0] * len(words), cs + [*words.values()]
    return pa.table([pa.array(langs, pa.string()), pa.array(grams, pa.binary()).cast(pa.string()), pa.array(ks, pa.int32()), pa.array(cs, pa.int64())], names=["lang", "gram", "k", "c"])


def edges_and_ends(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> DataFrame:
    """lang, gram, k, c: the graph's edges (k 4), the shorter grams before an end (k 1 to 3), and the number of words (k 0)."""
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    blocks = stash_bucketed(write_blocks(src, "text", ("lang",), _read), "blocks", "block", parallelism(spark))
    flags = lambda sums, order: (sums >= least).astype(np.uint8)
    answers = stash(corpus_counts(blocks, 2, answer=flags), "likely-pairs")
    threes = more_counts(blocks, answers, 3, _likely_threes, flags)
    found = with_answers(blocks, answers.unionByName(threes), lambda _, row, rows: _windows(Block(row, 3), rows), "lang string, gram string, k int, c long")
    return found.groupBy("lang", "gram", "k").agg(F.sum("c").alias("c"))


def counts_by_flow(graph: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, k, f of all phrases that occur ``least`` times, and, with k 0, of each language's words."""
    begins = [F.struct(F.lit(k).alias("k"), F.substring_index("gram", " ", k).alias("phrase")) for k in range(1, WORDS + 1)]
    whole = F.array(F.struct(F.lit(0).alias("k"), F.col("gram").alias("phrase")))
    flows = graph.select("lang", "c", F.explode(F.when(F.col("k") == 0, whole).otherwise(F.slice(F.array(*begins), F.lit(1), F.col("k")))).alias("b")).select("lang", "b.phrase", "b.k", "c")
    return flows.groupBy("lang", "phrase", "k").agg(F.sum("c").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))


def _last(phrase: str | Column, words: int) -> Column:
    return F.substring_index(phrase, " ", -words)


def _first(phrase: str | Column, words: int) -> Column:
    return F.substring_index(phrase, " ", words)


def compact_paths(phrases: DataFrame) -> DataFrame:
    """lang, words (a list) and weight of the graph's maximal paths: those of one edge, and longer ones over unary nodes."""
    edges = phrases.where(f"k = {WORDS}").select("lang", F.col("phrase").alias("gram"), F.col("f").alias("c"))
    nodes = phrases.where(f"k = {WORDS - 1}").select("lang", F.col("phrase").alias("node"), "f")
    leaves = edges.withColumn("node", _first("gram", WORDS - 1)).join(nodes, ["lang", "node"]).where("c = f").select("lang", "node", F.col("gram").alias("after"))
    comes = edges.withColumn("node", _last("gram", WORDS - 1)).join(nodes, ["lang", "node"]).where("c = f").select("lang", "node", F.col("gram").alias("before"))
    links = stash(comes.join(leaves, ["lang", "node"]).select("lang", F.col("after").alias("gram"), "before"), "unary-nodes")
    # a path's first edge has no link before it; a path can't be a cycle, as something must have entered that
    ways = stash(edges.join(links, ["lang", "gram"], "left").select("lang", "gram", "c", F.coalesce("before", "gram").alias("at"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("before").isNull().alias("done")), "ways")
    while ways.where("NOT done").take(1):
        ahead = ways.select("lang", F.col("gram").alias("at"), F.col("at").alias("__at"), F.col("steps").alias("__steps"), F.col("done").alias("__done"))
        moved = ways.where("NOT done").join(ahead, ["lang", "at"]).select("lang", "gram", "c", F.col("__at").alias("at"), (F.col("steps") + F.col("__steps")).alias("steps"), F.col("__done").alias("done"))
        ways = stash(ways.where("done").unionByName(moved), "ways")
    # what follows is the length of a text at most
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("steps", _last("gram", 1).alias("word")))), lambda x: x["word"])
    paths = ways.groupBy("lang", "at").agg(F.max("c").alias("weight"), ordered.alias("lasts"))
    return paths.select("lang", F.concat(F.split(_first("at", WORDS - 1), " "), "lasts").alias("words"), "weight")


def candidates(phrases: DataFrame, paths: DataFrame) -> DataFrame:
    """lang, phrase, k, a: the edges on paths, the nodes that no path passes, and pairs. ``before`` and ``after`` are the counts of an edge's nodes that are known from its path."""
    places = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - WORDS + 1), lambda i: F.array_join(F.slice("words", i, WORDS), " "))).alias("at", "phrase")
    on_paths = paths.select("lang", "weight", F.size("words").alias("n"), places)
    inner = [F.when(inside, F.col("weight")) for inside in (F.col("at") > 0, F.col("at") < F.col("n") - WORDS)]
    edges = on_paths.select("lang", "phrase", F.lit(WORDS).alias("k"), F.col("weight").alias("a"), inner[0].alias("before"), inner[1].alias("after"))
    passed = on_paths.where("at > 0").select("lang", _first("phrase", WORDS - 1).alias("phrase"))
    none = F.lit(None).cast("long")
    others = phrases.where(f"k BETWEEN 2 AND {WORDS - 1}").join(passed.withColumn("k", F.lit(WORDS - 1)), ["lang", "phrase", "k"], "left_anti")
    return edges.unionByName(others.select("lang", "phrase", "k", F.col("f").alias("a"), none.alias("before"), none.alias("after")))


def _scored(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """The candidates with l, r and score of their lowest cut."""
    parts = []
    for k in range(2, WORDS + 1):
        for cut in range(1, k):
            for side, part, known in (("l", _first("phrase", cut), "before"), ("r", _last("phrase", cut), "after")):
                wanted = F.col("k") == k
                if cut == WORDS - 1:  # an edge's node; its path may know it
                    wanted &= F.col(known).isNull()
                parts.append(F.when(wanted, F.struct(F.lit(side).alias("side"), F.lit(cut).alias("n"), part.alias("part"))))
    asked = found.select("lang", "phrase", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).select("lang", "phrase", "p.*")
    counted = asked.join(phrases.select("lang", F.col("phrase").alias("part"), F.col("k").alias("n"), "f"), ["lang", "part", "n"])
    sides = [F.max(F.when((F.col("side") == side) & (F.col("n") == n), F.col("f"))).alias(f"{side}{n}") for side in "lr" for n in range(1, WORDS)]
    rows = found.join(counted.groupBy("lang", "phrase").agg(*sides), ["lang", "phrase"])
    last = WORDS - 1
    rows = rows.withColumns({f"l{last}": F.coalesce(f"l{last}", "before"), f"r{last}": F.coalesce(f"r{last}", "after")})

    def cut(k: int, at: int) -> Column:
        score = f"(CAST(a AS DECIMAL(28, 0)) * CAST(2000000 AS DECIMAL(10, 0))) DIV (CAST(l{at} AS DECIMAL(20, 0)) + CAST(r{k - at} AS DECIMAL(20, 0)))"
        return F.struct(F.expr(score).cast("long").alias("score"), F.lit(at).alias("at"), F.col(f"l{at}").alias("l"), F.col(f"r{k - at}").alias("r"))

    lowest = F.coalesce(*(F.when(F.col("k") == k, F.array_min(F.array(*(cut(k, at) for at in range(1, k))))) for k in range(2, WORDS + 1)))
    return rows.withColumn("cut", lowest).select("lang", "phrase", "k", "a", "cut.l", "cut.r", "cut.score")


def _apart(found: DataFrame, within: int) -> DataFrame:
    """The candidates that don't lie in a longer one which has ``within`` percent of their occurrences."""
    inside = [F.when(F.col("k") == k, F.struct(F.lit(n).alias("k"), F.substring_index(F.substring_index("phrase", " ", n + i), " ", -n).alias("phrase"))) for k in range(3, WORDS + 1) for n in range(2, k) for i in range(k - n + 1)]
    longer = found.where("k > 2").select("lang", "a", F.explode(F.filter(F.array(*inside), lambda p: p.isNotNull())).alias("p"))
    most = longer.groupBy("lang", "p.phrase", "p.k").agg(F.max("a").alias("most")).select("lang", "phrase", "k", "most")
    return found.join(most, ["lang", "phrase", "k"], "left").where(f"most IS NULL OR CAST(100 AS DECIMAL(10, 0)) * CAST(most AS DECIMAL(20, 0)) < CAST({within} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0))").drop("most")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, within: int = WITHIN, first: int = FIRST) -> DataFrame:
    """Each language's first phrases by score, occurrences and text: lang, rank, phrase, a, l, r, n, score."""
    if least < 1:
        raise ValueError("a candidate must occur")
    phrases = stash(counts_by_flow(edges_and_ends(docs, lang, text, least), least), "phrases")
    found = stash(candidates(phrases, compact_paths(phrases)), "candidates")
    scored = _scored(stash(_apart(found, within), "apart"), phrases)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    words = phrases.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
