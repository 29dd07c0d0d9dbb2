"""Duplicate leads: exact e-mail, equal site domain, similar company name; the first record wins.

A lead is an original if it matches no earlier original. That is decided over keys, not pairs. While many leads are undecided, it is done in rounds: for each
key, of all kinds in one table, the smallest ids of originals and of undecided leads are aggregated, a lead with an earlier original is a duplicate, one with
nothing earlier that is undecided is an original. Rounds alone would be as many as the longest chain of leads each of which waits for the one
before. So what a few rounds leave is cut into connected components, which are packed by size, and each pack is finished by a scan in order of
ids; only components too large for a task go on in rounds. As soon as few keys are left in all, they are one pack.

Names are compared only between distinct names. As long as few leads are the first of all their keys, only these are compared by name, with all that are undecided before them; what shares an address or a
domain with an original needs no comparison. Many names meet by their rarest pairs of letters (no pair at or over the threshold is lost), few are compared directly.
Each step is written: lineage stays short, and the join of keys has written or shuffled sides, whose hot keys Spark may split.
"""

from __future__ import annotations

import functools
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import fold
from ..sources.scratch import stash
from .components import key_components
from .ingest import dedup_keys

THRESHOLD = 90
#: A segment is common if more than HOT x HOT pairs of names would meet by it; such segments are taken out LEVELS - 1 times.
HOT, LEVELS = 1024, 4
#: Pairs of letters by which names meet together, at most, and candidates a name at which one more is taken.
DEPTH, MEETINGS = 3, 50
#: Rounds before components are made, and keys of leads that a task finishes.
ROUNDS, PACK = 3, 1_000_000
#: So few names are compared with any number of others directly; where both sides are more, up to MEDIUM times as many.
FEW, MEDIUM = 1024, 7
#: Numbers of 64 bits that mark a name's letters.
MARKS = 4
#: Rounds at most in which only leads that are the first of all their keys are compared by name.
FIRST_ROUNDS = 16


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of a whole number for each place of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    free = full = (1 << len(a)) - 1
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _length_pairs(lengths: DataFrame, threshold: int) -> DataFrame:
    """la <= lb, two lengths that a pair at the threshold may have, and d, the insertions and deletions it may differ by."""
    longest = F.floor(F.col("n") * (200 - threshold) / max(threshold, 1)).cast("int")
    pairs = lengths.select(F.col("n").alias("la"), F.explode(F.sequence("n", longest)).alias("lb")).join(lengths.select(F.col("n").alias("lb")), "lb")
    edits = F.expr(f"(({100 - threshold} * (la + lb)) div 100)").cast("int")
    pairs = pairs.withColumn("d", edits).withColumn("d", F.col("d") - ((F.col("la") + F.col("lb") - F.col("d")) % 2)).where("d >= lb - la")
    return pairs.select("la", "lb", "d")


def _cut(rows: DataFrame, shifted: bool) -> DataFrame:
    """Each row once for each of the d + 1 segments of the shorter name's rest (and each place it may have in the longer one's, if ``shifted``), its key made
    longer by that segment, which is taken out of its rest."""
    rest = "(length(rest) - lb + la)" if shifted else "length(rest)"
    cuts = F.explode(F.expr(f"transform(sequence(0, d), i -> struct(i AS i, (i * {rest}) div (d + 1) AS lo, ((i + 1) * {rest}) div (d + 1) AS hi))"))
    rows = rows.select("*", cuts.alias("s")).select(*rows.columns, "s.i", F.col("s.lo").cast("int").alias("lo"), F.expr("cast(s.hi - s.lo AS int)").alias("n"))
    if shifted:
        rows = rows.withColumns({"least": F.expr("greatest(0, lo - (d - (lb - la)) div 2)"), "most": F.expr("least(length(rest) - n, lo + (d + lb - la) div 2)")}).where("least <= most")
        rows = rows.withColumn("at", F.explode(F.expr("sequence(least, most)")))
    else:
        rows = rows.withColumn("at", F.col("lo"))
    key = F.expr("xxhash64(key, i, substring(rest, cast(at AS int) + 1, n))")
    rest_left = F.expr("concat(substring(rest, 1, cast(at AS int)), substring(rest, cast(at AS int) + n + 1))")
    return rows.select("name", "fresh", "la", "lb", "d", rest_left.alias("rest"), key.alias("key")).distinct()


def _each_pair(names: DataFrame) -> DataFrame:
    """The names once for each hash of their pairs of letters (the second "ss" of a name is another pair than the first)."""
    letters = F.array_sort(F.expr("transform(sequence(1, greatest(length(name_key) - 1, 1)), i -> substring(name_key, i, 2))"))
    numbered = F.transform("letters", lambda p, i: F.xxhash64(p, (i + 1 - F.array_position("letters", p)).cast("int")))
    return names.withColumn("letters", letters).select(*names.columns, F.explode(numbered).alias("pair"))


def pair_rarity(names: DataFrame) -> DataFrame:
    """pair and seen, how many of the names have it."""
    return _each_pair(names.select("name_key")).groupBy("pair").agg(F.count(F.lit(1)).alias("seen"))


def letter_pairs(names: DataFrame, rarity: DataFrame) -> DataFrame:
    """The names with ``pairs``: their pairs of letters, the rarest first; pairs that rarity doesn't know come before all others."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "pair"))), lambda x: x["pair"])
    return _each_pair(names).join(rarity, "pair", "left").groupBy(*names.columns).agg(ordered.alias("pairs"))


def _rarest(names: DataFrame, pairs: DataFrame, side: str, depth: int) -> DataFrame:
    """Each name once for each choice of ``depth`` of its rarest pairs of letters.

    Of two names that differ by out deletions and in insertions, the first loses at most 2 * out + in pairs of letters and the other at most 2 * in + out, so
    they have kept = la - 1 - 2 * out - in pairs in common. Of the rarest (in an order that is the same for all names) that many and ``depth`` they share
    ``depth``, if they have as many in common at all."""
    lost = "2 * out + `in`" if side == "la" else "2 * `in` + out"
    first = F.slice("pairs", F.lit(1), F.expr(f"cast({lost} + {depth} AS int)"))
    rows = names.join(pairs, F.col("n") == F.col(side)).withColumn("first", first)
    each = [F.xxhash64("la", "lb", *(F.col(f"p{i}") for i in range(depth)))]
    for i in range(depth):
        after = F.expr(f"slice(first, at{i - 1} + 2, size(first))") if i else F.col("first")
        rows = rows.select(*rows.columns, F.posexplode(after).alias(f"at{i}", f"p{i}"))
        if i:
            rows = rows.withColumn(f"at{i}", F.col(f"at{i}") + F.col(f"at{i - 1}") + 1)
    return rows.select(F.col("name_key").alias("name"), "fresh", "la", "lb", "d", each[0].alias("key"))


def similar_names(names: DataFrame, threshold: int = THRESHOLD, hot: int = HOT, levels: int = LEVELS, depth: int = DEPTH, meetings: int = MEETINGS) -> DataFrame:
    """Pairs (a, b), both ways, of distinct non-empty ``name_key`` with 200 * LCS >= threshold * (sum of lengths). If names have a flag ``fresh``, only pairs
    with a fresh one.

    Names meet by their rarest pairs of letters: first by one, and for lengths at which that would be more than ``meetings`` candidates a name, by two and then by
    ``depth`` at once. What is common even then is met in blocks of ``hot`` names. At low thresholds short names needn't have a pair of
    letters in common; those lengths meet by segments."""
    fresh = F.col("fresh") if "fresh" in names.columns else F.lit(True)
    names = names.where("name_key <> ''").groupBy("name_key").agg(F.max(fresh).alias("fresh"))
    names = names.select("name_key", F.length("name_key").alias("n"), "fresh")
    lettered = stash(letter_pairs(names, pair_rarity(names)), "names")
    names = lettered.drop("pairs")
    lengths = _length_pairs(names.select("n").distinct(), threshold).where("d > 0")
    lengths = lengths.withColumns({"out": F.expr("(d + la - lb) div 2"), "in": F.expr("(d + lb - la) div 2")}).withColumn("kept", F.expr("la - 1 - 2 * out - `in`"))
    lengths = stash(lengths, "lengths")
    met, open_lengths = [], lengths.where("kept > 0")
    for level in range(1, depth + 1):
        # lengths with fewer pairs of letters in common can't go further, and meet at the level before
        short, long = (stash(_rarest(lettered, open_lengths.drop("kept"), side, level), f"{side}-names") for side in ("la", "lb"))
        sizes = short.groupBy("la", "lb", "key").agg(F.count(F.lit(1)).alias("ns")).join(long.groupBy("la", "lb", "key").agg(F.count(F.lit(1)).alias("nl")), ["la", "lb", "key"])
        sizes = stash(sizes, "sizes")
        work = sizes.groupBy("la", "lb").agg(F.sum(F.col("ns").cast("double") * F.col("nl")).alias("work"), F.sum("ns").alias("rows"))
        dense = open_lengths.join(work, ["la", "lb"]).where((F.col("work") > float(meetings) * F.col("rows")) & (F.col("kept") > level) & F.lit(level < depth))
        dense = stash(dense.select(*open_lengths.columns), "dense-lengths")
        common = sizes.where(F.col("ns").cast("double") * F.col("nl") > float(hot) * hot).select("key", F.ceil(F.col("nl") / hot).cast("int").alias("parts"))
        short, long = (x.join(dense.select("la", "lb"), ["la", "lb"], "left_anti").join(common, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for x in (short, long))
        met.append(_meet(short.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))), long.withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))))
        if not dense.take(1):
            break
        open_lengths = dense
    rest = lengths.where("kept <= 0").select("la", "lb", "d")
    if rest.take(1):
        met.append(_by_segments(names, rest, hot, levels))
    found = functools.reduce(DataFrame.unionByName, met).distinct()
    near = found.where(200 * lcs_length("a", "b") >= threshold * (F.length("a") + F.length("b")))
    near = stash(near, "similar-names")
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _by_segments(names: DataFrame, pairs: DataFrame, hot: int, levels: int) -> DataFrame:
    """Candidates of the given lengths. Of the d + 1 segments of a name, one at least is untouched in a name that differs by d insertions and deletions; names meet by such a segment. Where a
    segment is so common that more than ``hot`` x ``hot`` pairs would meet by it, it is taken out of both names, whose rests differ by d at most as well, and the
    rests must share a segment in turn. After ``levels`` such steps what is still common is met in blocks of ``hot`` names."""
    state = [F.col("name_key").alias("name"), "fresh", "la", "lb", "d", F.col("name_key").alias("rest"), F.xxhash64("la", "lb").alias("key")]
    short, long = (names.join(pairs, F.col("n") == F.col(side)).select(*state) for side in ("la", "lb"))
    met = []
    for level in range(levels):
        short, long = stash(_cut(short, False), "short-names"), stash(_cut(long, True), "long-names")
        sizes = short.groupBy("key").agg(F.count(F.lit(1)).alias("ns")).join(long.groupBy("key").agg(F.count(F.lit(1)).alias("nl")), "key")
        common = stash(sizes.where(F.col("ns").cast("double") * F.col("nl") > float(hot) * hot), "common-segments")
        cold_short, cold_long = (x.join(common, "key", "left_anti") for x in (short, long))
        met.append(_meet(cold_short.withColumn("part", F.lit(0)), cold_long.withColumn("part", F.lit(0))))
        parts = F.ceil(F.col("ns") / hot).cast("int")
        short, long = (x.join(common.withColumn("parts", parts).drop("ns", "nl"), "key") for x in (short, long))
        if not common.take(1):
            break
        if level == levels - 1:
            met.append(_meet(short.withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")), long.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))))
    return functools.reduce(DataFrame.unionByName, met)


def _meet(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs a < b of one key and part that no more than d edits (of which a replacement is one) keep apart."""
    short = short.select("key", "part", F.col("name").alias("x"), F.col("fresh").alias("fresh_x"), "d")
    long = long.select("key", "part", F.col("name").alias("y"), F.col("fresh").alias("fresh_y"))
    near = short.join(long, ["key", "part"]).where("(length(x) < length(y) OR x < y) AND (fresh_x OR fresh_y) AND levenshtein(x, y, d) >= 0")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


KINDS = ("email_key", "domain_key", "name_key")


def posts(keys: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """id, kind (the place of the key among the kinds) and key of each key that isn't ''."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(k).alias("key")) for i, k in enumerate(kinds))))
    return keys.select("id", each.alias("k")).select("id", "k.kind", "k.key").where("key <> ''")


def _round(own: DataFrame, listened: DataFrame, found: DataFrame, undecided: DataFrame) -> DataFrame:
    """id and state (1 original, 2 duplicate, 0 open) of the undecided leads, from each key's smallest original and smallest undecided lead."""
    still = own.join(undecided, "id", "left_semi").groupBy("kind", "key").agg(F.min("id").alias("open"))
    heads = found.withColumn("open", F.lit(None).cast("long")).unionByName(still.withColumn("orig", F.lit(None).cast("long")))
    heads = stash(heads.groupBy("kind", "key").agg(F.min("orig").alias("orig"), F.min("open").alias("open")), "heads")
    mine = listened.join(undecided, "id", "left_semi").join(heads, ["kind", "key"]).groupBy("id").agg(F.min("orig").alias("orig"), F.min("open").alias("open"))
    later = lambda c: F.coalesce(F.col(c) < F.col("id"), F.lit(False))
    return stash(mine.select("id", F.when(later("orig"), 2).when(later("open"), 0).otherwise(1).alias("state")), "round")


def _scan(pack: pd.DataFrame) -> pd.DataFrame:
    """The originals among a pack's leads, in order of their ids. Rows: id, kind, key, own (else the lead only listens to the key), orig (the key's smallest original so far, or the largest number)."""
    first: dict[tuple, int] = {(k, x): o for k, x, o in zip(pack["kind"], pack["key"], pack["orig"], strict=True)}
    originals = []
    for i, rows in pack.groupby("id", sort=True):
        keys = list(zip(rows["kind"], rows["key"], strict=True))
        if not any(first[k] < i for k in keys):
            originals.append(i)
            for k, own in zip(keys, rows["own"], strict=True):
                if own:
                    first[k] = min(first[k], i)
    return pd.DataFrame({"id": pd.Series(originals, dtype="int64")})


def _finish(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The originals (id) among the leads of rows (pack, id, kind, key, own), pack by pack. A pack has whole components."""
    heads = found.groupBy("kind", "key").agg(F.min("orig").alias("orig"))
    rows = rows.join(heads, ["kind", "key"], "left").withColumn("orig", F.coalesce("orig", F.lit((1 << 63) - 1)))
    return rows.groupBy("pack").applyInPandas(_scan, "id long")


def with_marks(names: DataFrame) -> DataFrame:
    """The names (name_key) with m0, m1 and so on, whose bits mark their letters (the second "s" of a name is another letter than the first). Names that differ by d insertions and
    deletions differ by d bits at most, so names further apart in bits needn't be compared."""
    letters = F.array_sort(F.expr("transform(sequence(1, length(name_key)), i -> substring(name_key, i, 1))"))
    numbered = F.transform("letters", lambda c, i: F.xxhash64(c, (i + 1 - F.array_position("letters", c)).cast("int")))
    mark = "aggregate(hashes, 0L, (m, h) -> IF(pmod(h, {}L) = {}L, m | shiftleft(1L, cast(shiftright(h, 8) & 63 AS int)), m))"
    names = names.withColumn("letters", letters).withColumn("hashes", numbered)
    return names.withColumns({f"m{w}": F.expr(mark.format(MARKS, w)) for w in range(MARKS)}).drop("letters", "hashes")


def near_names(some: DataFrame, others: DataFrame, threshold: int = THRESHOLD, few: int = FEW) -> DataFrame:
    """Pairs (a, b) of a name of ``some`` and another one of ``others`` or, beside those, of ``some`` (name_key), with 200 * LCS >= threshold * (sum of lengths).

    If one side has ``few`` names at most, or both are not much more, the smaller one is broadcast and the other goes over it once; else they meet by their rarest pairs of letters."""
    some, others = (x.where("name_key <> ''").select("name_key").distinct() for x in (some, others))
    some = stash(with_marks(some), "some-names")
    others = stash(with_marks(others), "other-names")
    n_some, n_others = some.count(), others.count()
    if min(n_some, n_others) > few and max(n_some, n_others) > MEDIUM * few:
        both = some.withColumn("fresh", F.lit(True)).unionByName(others.withColumn("fresh", F.lit(False)))
        return similar_names(both, threshold)
    lanes = some.sparkSession.sparkContext.defaultParallelism
    some, others = (F.broadcast(some), others.repartition(lanes)) if n_some <= n_others else (some.repartition(lanes), F.broadcast(others))
    return stash(_directly(some, others, threshold), "near-names")


def _directly(some: DataFrame, others: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of alike names of some and others (name_key and its marks), by comparing each with each: lengths first, then marks, then edits."""
    a, b = (x.select(F.col("name_key").alias(side), F.length("name_key").alias(f"n_{side}"), *(F.col(f"m{w}").alias(f"{side}{w}") for w in range(MARKS))) for x, side in ((some, "a"), (others, "b")))
    edits = f"cast(({100 - threshold} * (n_a + n_b)) div 100 AS int)"
    apart = " + ".join(f"bit_count(a{w} ^ b{w})" for w in range(MARKS))
    met = b.join(a, F.expr(f"abs(n_a - n_b) <= {edits} AND {apart} <= {edits} AND a <> b AND levenshtein(a, b, {edits}) >= 0"))
    return met.where(200 * lcs_length("a", "b") >= threshold * (F.length("a") + F.length("b"))).select("a", "b")


def resolve(leads: DataFrame, threshold: int | None = THRESHOLD, originals: DataFrame | None = None, rounds: int = ROUNDS, pack: int = PACK, few: int = FEW) -> DataFrame:
    """id, is_duplicate, duplicate_of_id and duplicate_reason of leads (id, email, domain_normalized, company_name, and is_duplicate if they may be flagged before). ``threshold`` None: names aren't compared.
    Leads that were flagged before are neither matched nor changed. ``originals``: known originals with smaller ids; they are matched, but not decided again.
    After ``rounds`` rounds, components of up to ``pack`` keys of leads are finished by scans. Names are compared directly where one side has ``few`` or both are not much more."""
    kinds = KINDS if threshold is not None else KINDS[:2]
    known = posts(dedup_keys(originals), kinds).groupBy("kind", "key").agg(F.min("id").alias("orig")) if originals is not None else None
    return resolve_against(leads, known, threshold, rounds, pack, few)


def _without_earlier(own: DataFrame, undecided: DataFrame, found: DataFrame) -> DataFrame:
    """The undecided leads none of whose own keys has an earlier original."""
    heads = found.groupBy("kind", "key").agg(F.min("orig").alias("orig"))
    return undecided.join(own.join(heads, ["kind", "key"]).where("orig < id").select("id"), "id", "left_anti")


def _first_leads(own: DataFrame, undecided: DataFrame) -> DataFrame:
    """The undecided leads (id) that are the first undecided ones of all their keys."""
    still = own.join(undecided, "id", "left_semi")
    least = still.groupBy("kind", "key").agg(F.min("id").alias("open"))
    return undecided.join(still.join(least, ["kind", "key"]).where("open < id").select("id"), "id", "left_anti")


def _decide_first(own: DataFrame, found: DataFrame, undecided: DataFrame, threshold: int, few: int) -> tuple[DataFrame, DataFrame, bool]:
    """Originals (kind, key, orig) and undecided leads after rounds in which only leads that are the first of all their keys are compared by name: where many leads
    share few domains or addresses, these are few, and what shares a key with an original of theirs needs no comparison. Also, whether anything was decided.

    A first lead that has neither an original nor an undecided lead before it that is named alike is an original."""
    begun = False
    for _ in range(FIRST_ROUNDS):
        undecided = stash(_without_earlier(own, undecided, found), "undecided")
        names = own.where("kind = 2").join(undecided, "id", "left_semi").select("id", F.col("key").alias("name_key"))
        if names.select("name_key").distinct().count() <= MEDIUM * few:
            break
        first = stash(_first_leads(own, undecided), "first-leads")
        mine = names.join(first, "id", "left_semi")
        if mine.select("name_key").distinct().count() > few:
            break
        begun = True
        originals = found.where("kind = 2").groupBy(F.col("key").alias("name_key")).agg(F.min("orig").alias("orig"))
        open_names = names.groupBy("name_key").agg(F.min("id").alias("open"))
        near = near_names(mine, names.select("name_key").unionByName(originals.select("name_key")), threshold, few)
        others = originals.join(open_names, "name_key", "full").withColumnRenamed("name_key", "b")
        seen = mine.join(near, F.col("name_key") == F.col("a")).join(others, "b").groupBy("id").agg(F.min("orig").alias("orig"), F.min("open").alias("open"))
        earlier = lambda c: F.coalesce(F.col(c) < F.col("id"), F.lit(False))
        state = F.when(earlier("orig"), 2).when(earlier("open"), 0).otherwise(1)
        decided = stash(first.join(seen, "id", "left").select("id", state.alias("state")), "first-decided")
        fresh = own.join(decided.where("state = 1"), "id", "left_semi").groupBy("kind", "key").agg(F.min("id").alias("orig"))
        found = found.unionByName(stash(fresh, "new-originals"))
        undecided = undecided.join(decided.where("state <> 0"), "id", "left_anti")
    return found, stash(undecided, "undecided"), begun


def resolve_against(leads: DataFrame, known: DataFrame | None, threshold: int | None = THRESHOLD, rounds: int = ROUNDS, pack: int = PACK, few: int = FEW) -> DataFrame:
    """``resolve`` against known keys (kind, key, orig: the smallest original with it) instead of leads."""
    flagged = F.coalesce(F.col("is_duplicate"), F.lit(0)) == 1 if "is_duplicate" in leads.columns else F.lit(False)
    kinds = KINDS if threshold is not None else KINDS[:2]
    keys = stash(dedup_keys(leads.where(~flagged)), "leads")
    own = posts(keys, kinds)
    undecided = keys.select("id")
    if known is not None:
        known = stash(known.where(F.col("kind").isin(*range(len(kinds)))).select("kind", "key", "orig"), "originals")
    found = known if known is not None else own.select("kind", "key", F.col("id").alias("orig")).limit(0)
    begun, near = False, None
    if threshold is not None:
        found, undecided, begun = _decide_first(own, found, undecided, threshold, few)
    listened = own.withColumn("own", F.lit(True))
    if threshold is not None:
        listened = listened.join(undecided, "id", "left_semi")
        names = listened.where("kind = 2").select("id", F.col("key").alias("name_key"))
        near = near_names(names, names.select("name_key").unionByName(found.where("kind = 2").select(F.col("key").alias("name_key"))), threshold, few)
        others = names.join(near, F.col("name_key") == F.col("a")).select("id", F.lit(2).alias("kind"), F.col("b").alias("key"))
        listened = listened.unionByName(others.withColumn("own", F.lit(False)))
    listened = stash(listened, "listened")
    for n in itertools.count():
        left = listened if n == 0 else listened.join(undecided, "id", "left_semi")
        if left.count() <= pack:
            fresh = _finish(left.withColumn("pack", F.lit(0)), found)
            found = found.unionByName(stash(own.join(fresh, "id", "left_semi").groupBy("kind", "key").agg(F.min("id").alias("orig")), "new-originals"))
            break
        if n == rounds:
            left = stash(left, "open-keys")
            roots = stash(key_components(left), "components")
            sized = left.join(roots, "id")
            sizes = stash(sized.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= pack), "small-components")
            packs = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // pack)
            small = sized.join(sizes.select("root"), "root", "left_semi").withColumn("pack", F.pmod(F.xxhash64("root"), F.lit(packs)))
            fresh = stash(_finish(small.drop("root"), found), "finished")
            found = found.unionByName(stash(own.join(fresh, "id", "left_semi").groupBy("kind", "key").agg(F.min("id").alias("orig")), "new-originals"))
            undecided = stash(roots.join(sizes.select("root"), "root", "left_anti").select("id"), "undecided")
            if not undecided.take(1):
                break
        decided = _round(own, listened, found, undecided)
        fresh = own.join(decided.where("state = 1"), "id", "left_semi").groupBy("kind", "key").agg(F.min("id").alias("orig"))
        found = found.unionByName(stash(fresh, "new-originals"))
        undecided = decided.where("state = 0").select("id")
    heads = found.groupBy("kind", "key").agg(F.min("orig").alias("orig"))
    heads = heads if threshold is None else stash(heads, "heads")
    earlier = own.join(heads, ["kind", "key"]).select("id", "kind", "orig")
    if threshold is not None:
        names = keys.where("name_key <> ''").select("id", "name_key")
        alike = heads.where("kind = 2").select(F.col("key").alias("b"), "orig")
        if begun:  # only leads that match no earlier original by address or domain need a name, and only originals have names to match
            originals = found.select(F.col("orig").alias("id"))
            names = names.join(earlier.where("kind < 2 AND orig < id").select("id"), "id", "left_anti").join(originals, "id", "left_anti")
            near = near_names(names, alike.select(F.col("b").alias("name_key")), threshold, few)
        earlier = earlier.unionByName(names.join(near, F.col("name_key") == F.col("a")).join(alike, "b").select("id", F.lit(2).alias("kind"), "orig"))
    targets = earlier.where("orig < id").groupBy(F.col("id").alias("__id")).agg(*(F.min(F.when(F.col("kind") == i, F.col("orig"))).alias(k) for i, k in enumerate(kinds)))
    reason = F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(name)) for k, name in zip(kinds, ("exact_email", "domain_match", "fuzzy_company_name"), strict=False)))
    rows = keys.select("id").join(targets, F.col("id") == F.col("__id"), "left")
    return rows.select("id", F.when(F.col("__id").isNotNull(), 1).otherwise(0).alias("is_duplicate"), F.coalesce(*kinds).alias("duplicate_of_id"), reason.alias("duplicate_reason"))


def dedup_stats(resolved: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    reason = F.coalesce("duplicate_reason", F.lit(""))
    return resolved.agg(n(reason == "exact_email").alias("exact_email"), n(reason == "domain_match").alias("domain"), n(reason == "fuzzy_company_name").alias("fuzzy_company"), n(F.col("is_duplicate") == 0).alias("kept_original"))


def exported_domains(history: DataFrame, except_session: int | None = None) -> DataFrame:
    """The distinct non-empty domains of earlier exports."""
    rows = history if except_session is None else history.where(~F.col("session_id").eqNullSafe(F.lit(except_session)))
    return rows.where("domain_normalized <> ''").select("domain_normalized").distinct()


def suppress_exported(leads: DataFrame, history: DataFrame, except_session: int | None = None) -> DataFrame:
    """The leads with those flagged that are no duplicates so far and whose domain was exported before."""
    gone = exported_domains(history, except_session).select(F.col("domain_normalized").alias("__d"))
    df = leads.join(gone, fold("domain_normalized") == F.col("__d"), "left")
    hit = (F.coalesce("is_duplicate", F.lit(0)) == 0) & F.col("__d").isNotNull()
    return df.withColumns({"is_duplicate": F.when(hit, 1).otherwise(F.col("is_duplicate")), "duplicate_of_id": F.when(hit, F.lit(None).cast("long")).otherwise(F.col("duplicate_of_id")), "duplicate_reason": F.when(hit, V.ALREADY_EXPORTED).otherwise(F.col("duplicate_reason"))}).drop("__d")


def record_export(leads: DataFrame, at: Column, session_id: int | None = None) -> DataFrame:
    """Rows for the export history: leads with a domain."""
    return leads.where("domain_normalized <> ''").select((F.lit(session_id).cast("long") if session_id is not None else F.col("session_id")).alias("session_id"), F.col("id").alias("lead_id"), "domain_normalized", at.alias("exported_at"))


def keepers_split(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    return resolved.where("is_duplicate = 0"), resolved.where("is_duplicate = 1")


def override_duplicates(leads: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen duplicates (id) become originals again, with status NEW."""
    df = leads.join(chosen.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    return df.withColumns({"is_duplicate": F.when(hit, 0).otherwise(F.col("is_duplicate")), "duplicate_of_id": F.when(~hit, F.col("duplicate_of_id")), "duplicate_reason": F.when(~hit, F.col("duplicate_reason")), "status": F.when(hit, "NEW").otherwise(F.col("status"))}).drop("__id")
