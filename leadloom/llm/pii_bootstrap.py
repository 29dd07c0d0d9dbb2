"""Operator 10: personal data by bootstrapped contextual extraction, in native expressions only.

One scan finds, in each text, the base identifiers (e-mail, IP address, card, phone: fixed patterns and checks) and every
identifier-like value with its left context. Base identifiers, and long mixed hexadecimal strings, are the seeds. A context (the
word or key before a value, its separator, and the value's shape) is a lexical pattern; values are instances. The graph of
patterns and instances is aggregated over all documents and scored in rounds: a pattern's confidence is the mean
score of its distinct instances (with one virtual instance of score 0), and it is certain if that is at or over ``confidence`` and at least
``support`` of its instances are. An instance's score is 1 for seeds, else the noisy-or of the confidences of its certain patterns; so what a pattern
discovers makes other patterns certain. At the fixed point, which has no bound of rounds, the certain ones mark all their instances,
unseen ones too. Base identifiers always stay.

Texts never enter a shuffle; what is shuffled are values with contexts, aggregated by pattern and instance before,
and found spans by document. Scores are written between rounds, and joins with them are between written tables, whose
hot patterns Spark may split. Offsets are code points, from 0, end exclusive.

Rows: a null text is empty; rows that are equal in id and text get equal results, each of its own; rows without an id are kept; texts of any length
are searched whole (positions of n matches take O(n) memory). Extra columns are not read; ``redact`` keeps all of them.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

# The base kinds in their order, each with its pattern. What repeats is possessive, which finds the same matches without a
# stack of tries, and a run is entered only at its start (or where the last match ended), so that the search is linear in any text.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: What may end a run of value characters without being the value's: the sentence's stops, and joints.
TAIL = ".-/%+"
#: Key or word, optional separator, optional bracket, and a value with a digit in it, of six characters or more without its tail. All
#: of any length; so that the search stays linear, a long run in which no key can have a value is taken whole, as a match without one:
#: the rest of a key's run (its other keys end where it does), and a run from a plus sign to the last key in it.
CONTEXT = (
    r"(?<![\p{L}0-9_])(\p{L}[\p{L}0-9_-]*+)"
    r"(?:( ?[=:])?[ \n]?[\x22'(\[]?((?=[A-Za-z0-9+])(?=[A-Za-z+_.-]*+[0-9])(?=[A-Za-z0-9+][A-Za-z0-9@._%+/-]{4,}?[A-Za-z0-9@_])[A-Za-z0-9+][A-Za-z0-9@._%+/-]{5,}+)"
    r"|(?=\+[A-Za-z+_.-]{64})(?!\+[A-Za-z+_.-]*+[0-9])\+[A-Za-z+_.-]*(?<=[+.])|(?<=[\p{L}0-9_-]{64}))"
)
SEED_SECRET = r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}$"
CONFIDENCE, SUPPORT = 0.8, 3
#: Items of a chunk of an array, and characters of a block of a text.
_BLOCK, _CHARS = 256, 4096


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(xs: Column) -> Column:
    """An array cut into arrays of _BLOCK items."""
    return F.when(F.size(xs) == 0, F.slice(F.array(xs), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / _BLOCK).cast("int") - 1), lambda b: F.slice(xs, b * _BLOCK + 1, _BLOCK)))


def _running(lengths: Column) -> Column:
    """Sums of an array's items before each place, by blocks, so that the work stays near linear."""
    zero = F.array().cast("array<bigint>")
    add = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    fold = lambda xs, start: F.aggregate(xs, F.struct(start.cast("bigint").alias("at"), zero.alias("out")), add, lambda a: a["out"])
    starts = _chunks(lengths)

    def with_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.flatten(_let(fold(totals, F.lit(0)), lambda offsets: F.transform(blocks, lambda xs, i: fold(xs, F.get(offsets, i)))))

    return F.when(F.size(lengths) == 0, zero).otherwise(_let(starts, with_blocks))


def matches(text: Column, pattern: str) -> Column:
    """The pattern's leftmost non-overlapping matches: array of struct(start, value), in code points. No match may be empty."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column, between: Column) -> Column:
        steps = F.transform(found, lambda x, i: (F.length(F.get(between, i)) + F.length(x)).cast("bigint"))
        return _let(_running(steps), lambda before: F.transform(found, lambda x, i: F.struct((F.get(before, i) + F.length(F.get(between, i))).alias("start"), x.alias("value"))))

    return _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between")), lambda s: placed(s["found"], s["between"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.nullif(F.substring(part(p), 1, 3), F.lit("")).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


SPAN = "array<struct<start:bigint,`end`:bigint,kind:string>>"


def base_spans(text: Column) -> Column:
    """The base identifiers: array of struct(start, end, kind), kind by kind."""
    digit = text.rlike("[0-9]")
    there = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": digit & F.contains(text, F.lit("+"))}

    def spans(kind: str, pattern: str) -> Column:
        good = F.filter(matches(text, pattern), lambda m: _valid(kind, m["value"]))
        found = F.transform(good, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), F.lit(kind).alias("kind")))
        return F.when(there[kind], found.cast(SPAN)).otherwise(F.array().cast(SPAN))

    return F.concat(*(spans(*x) for x in BASE))


def _shape(value: Column) -> Column:
    return (
        F.when(value.rlike("^[0-9]+$"), F.concat(F.lit("d"), F.length(value).cast("string")))
        .when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "x")
        .when(value.rlike("^[0-9.]+$"), F.concat(F.lit("n"), F.length(F.regexp_replace(value, "[0-9]", "")).cast("string")))
        .when(F.contains(value, F.lit("@")), "m")
        .when(value.rlike("^[0-9+]"), "p")
        .otherwise("w")
    )


def contexts(text: Column, base: Column) -> Column:
    """Identifier-like values with their patterns: array of struct(start, end, pattern, value, seed); seed is the kind of a seed entity, else null."""

    def whole_chunks(found: Column) -> Column:
        return F.transform(found, lambda c: F.struct(F.array_min(F.transform(c, lambda b: b["start"])).alias("lo"), F.array_max(F.transform(c, lambda b: b["end"])).alias("hi"), c.alias("spans")))

    def described(m: Column, chunks: Column) -> Column:
        piece = lambda i: F.regexp_extract(m["value"], CONTEXT, i)

        def whole(s: Column) -> Column:
            start = m["start"] + F.length(m["value"]) - F.length(s["run"])
            end = start + F.length(s["value"])
            near = F.filter(chunks, lambda c: (c["lo"] < end) & (start < c["hi"]))
            hit = F.flatten(F.transform(near, lambda c: F.filter(c["spans"], lambda b: (b["start"] < end) & (start < b["end"]))))
            seed = F.coalesce(F.get(hit, F.lit(0))["kind"], F.when(F.lower(s["value"]).rlike(SEED_SECRET), "secret"))
            return F.struct(start.alias("start"), end.alias("end"), F.concat(F.lower(s["key"]), F.trim(s["sep"]), F.lit("|"), _shape(s["value"])).alias("pattern"), s["value"].alias("value"), seed.alias("seed"), (F.size(hit) > 0).alias("base"))

        # a value's last full stop belongs to the sentence
        return _let(F.struct(piece(1).alias("key"), piece(2).alias("sep"), piece(3).alias("run"), F.rtrim(piece(3), F.lit(TAIL)).alias("value")), whole)

    kind = "array<struct<start:bigint,`end`:bigint,pattern:string,value:string,seed:string,base:boolean>>"
    # base spans are looked up by chunks, so that a text with many of them isn't compared value by span
    chunks = whole_chunks(_chunks(base))
    found = _let(chunks, lambda chunks: F.filter(F.transform(matches(text, CONTEXT), lambda m: described(m, chunks)), lambda c: c["value"] != ""))
    return F.when(text.rlike("[0-9]"), found.cast(kind)).otherwise(F.array().cast(kind))


def score_patterns(edges: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, max_rounds: int | None = None) -> DataFrame:
    """Certain patterns (pattern, kind) of a graph of edges (pattern, value, seed). Scores only rise from round to round, so that certain patterns stay
    certain, and rounds end at the fixed point, when no certain pattern has become another one or more confident (to six digits). If that takes more than ``max_rounds``, where given, it is an error."""
    graph = stash(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pattern-graph")
    scored = graph.select("pattern", "value", F.col("seed").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    known = None
    for i in itertools.count():
        sure = F.col("score") >= confidence
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count(F.when(sure, 1)).alias("support"), F.mode(F.when(sure, F.col("kind")), True).alias("kind"))
        certain = stash(patterns.where((F.col("confidence") >= confidence) & (F.col("support") >= support)), f"patterns-{i}")
        now = tuple(certain.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("pattern", F.round("confidence", 6)))).first())
        if now == known or not now[0]:
            break
        if i + 1 == max_rounds:
            raise ValueError(f"patterns still become certain after {max_rounds} rounds")
        known = now
        unknown = graph.where("seed IS NULL").select("pattern", "value").join(certain, "pattern")
        found = unknown.groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("found"), F.mode("kind", True).alias("found_kind"))
        found = stash(found, f"values-{i}")
        scored = graph.join(found, "value", "left").select("pattern", "value", F.coalesce("seed", "found_kind").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("score"))
    return certain.select("pattern", "kind")


def find(df: DataFrame, id_col: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT, max_rounds: int | None = None) -> DataFrame:
    """A row a document: id_col, mark (a hash of its text), base (base spans), spans (all spans in order: base ones and those of the method that overlap none)."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("mark"), t.alias("t"))
    docs = docs.withColumn("base", base_spans(F.col("t"))).withColumn("found", contexts(F.col("t"), F.col("base")))
    docs = stash(docs.select("id", "mark", "base", "found"), "identifiers")
    values = docs.where("size(found) > 0").select("id", "mark", F.explode("found").alias("c")).select("id", "mark", "c.*")
    patterns = stash(score_patterns(values, confidence, support, max_rounds), "patterns")
    added = values.where("NOT base").join(patterns, "pattern").groupBy(F.col("id").alias("i"), F.col("mark").alias("m")).agg(F.collect_set(F.struct("start", F.col("end").alias("end"), "kind")).cast(SPAN).alias("added"))
    out = docs.join(added, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    return out.select(F.col("id").alias(id_col), "mark", "base", F.concat("base", F.coalesce("added", F.array().cast(SPAN))).alias("spans"))


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed (the method's other kinds last), then end."""
    rank = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(n) for n, _ in BASE)), k), F.lit(0)), F.lit(len(BASE) + 1))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in order."""
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(spans: Column) -> Column:
    """Of spans in order those that overlap no earlier one of them."""
    none = F.slice(spans, 1, 0)
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.array_append(a["out"], s).alias("out")))
    fold = lambda a, c: _let(F.aggregate(c, F.struct(a["at"].alias("at"), none.alias("out")), step), lambda x: F.struct(x["at"].alias("at"), F.array_append(a["out"], x["out"]).alias("out")))
    return F.aggregate(_chunks(spans), F.struct(F.lit(0).cast("bigint").alias("at"), F.slice(F.array(none), 1, 0).alias("out")), fold, lambda a: F.flatten(a["out"]))


def _replaced(blocks: Column, length: Column, spans: Column) -> Column:
    """A text, given in blocks of _CHARS characters, with disjoint spans replaced by their kinds. A piece is cut from the blocks that it touches."""

    def piece(lo: Column, hi: Column) -> Column:
        first = F.floor(lo / _CHARS)
        touched = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.floor((hi - 1) / _CHARS) - first + 1).cast("int")), "")
        return F.when(hi > lo, F.substr(touched, (lo % _CHARS + 1).cast("int"), (hi - lo).cast("int"))).otherwise("")

    end = lambda i: F.coalesce(F.get(spans, i)["end"], F.lit(0).cast("bigint"))
    parts = F.transform(spans, lambda s, i: F.concat(piece(end(i - 1), s["start"]), F.lit("<"), s["kind"], F.lit(">")))
    return F.concat(F.array_join(parts, ""), piece(end(F.size(spans) - 1), length.cast("bigint")))


def redact(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows with each span of their texts replaced by its kind in angle brackets (of overlapping spans, the first in order). Null texts stay null."""
    found = find(df, id_col, text, **options).where("size(spans) > 0").dropDuplicates([id_col, "mark"])
    found = stash(found.select(F.col(id_col).alias("__i"), F.col("mark").alias("__m"), in_order(F.col("spans")).alias("__spans")), "spans")
    # every span has a digit or an at sign; texts without either needn't meet the spans, so they aren't shuffled
    may = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    rows = df.where(may).join(found, F.col(id_col).eqNullSafe(F.col("__i")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__m")), "left")
    t = F.col(text)
    new = _let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0)), lambda blocks: _let(_apart(F.col("__spans")), lambda spans: _replaced(blocks, F.length(t), spans)))
    redacted = rows.withColumn(text, F.when(F.col("__spans").isNull() | t.isNull(), t).otherwise(new)).select(*df.columns)
    return redacted.unionByName(df.where(~may))
