"""Operator 2: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (``dims`` components, drawn from the letter's code point alone). A trigram's
vector binds its letters' vectors by multiplication, the first permuted (rotated) twice and the second once; a text's vector
bundles (adds) those of its trigrams; a language's prototype bundles the texts that are labelled with it. A text's language
is that of the prototype with the largest cosine, and the score is this cosine (0 if negative).

Texts are lower-cased letter by letter; each run of other characters counts as one space; a space stands at
both ends. Training adds up the prototypes in the tasks and sums them by language and component on the cluster; the
driver gets languages x dims numbers. At most about ``max_train_docs`` labelled documents (chosen by a hash of their ids, all if
there are fewer) train the prototypes; prediction covers all documents.

Rows: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing is labelled; ties go to the
alphabetically first language; repeated rows are predicted each; long texts are read in parts of 256K characters. Extra columns are
not read; ``keep`` names those to hand through. More than ``max_languages`` labels raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, lean

DIMS, MAX_TRAIN_DOCS, MAX_LANGUAGES = 1024, 100_000, 1024
#: Trigrams whose vectors a worker keeps, texts that are bundled at once, characters of a part.
MAX_TRIGRAMS, AT_ONCE, PART = 16_384, 32, 1 << 18
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Code point -> its lower-case letter's code point, or 0 if it isn't a letter."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _letters = table
    return _letters


def trigram_codes(text: str) -> Iterator[np.ndarray]:
    """Codes of the text's trigrams (21 bits a letter, 0: space), part by part; nothing if it has no letter."""
    table, left = letter_table(), np.zeros(1, np.uint32)
    any_letter = False
    for at in range(0, len(text), PART):
        part = np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([left, table[part]])
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]  # one space for a run
        if at + PART >= len(text) and x[-1]:
            x = np.append(x, np.uint32(0))
        any_letter |= bool(x.any())
        if len(x) >= 3 and any_letter:
            y = x.astype(np.int64)
            yield y[:-2] << 42 | y[1:-1] << 21 | y[2:]
        left = x[-2:]


def letter_vector(cp: int, dims: int) -> np.ndarray:
    """The letter's fixed random vector of +1 and -1."""
    return np.random.default_rng([20_031, cp]).integers(0, 2, dims, dtype=np.int8) * 2 - 1


class Bundler:
    """Trigram counts in, bundled vectors out; keeps the vectors of up to MAX_TRIGRAMS trigrams."""

    def __init__(self, dims: int):
        self.dims = dims
        self.letters: dict[int, np.ndarray] = {}
        self.rows = np.empty((2 * MAX_TRIGRAMS, dims), np.int8)
        self._clear()

    def _clear(self) -> None:
        self.codes, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted codes, and the rows of their vectors
        self.used = 0

    def _letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            if len(self.letters) > 8192:
                self.letters.clear()
            self.letters[cp] = letter_vector(cp, self.dims)
        return self.letters[cp]

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self.dims), np.int8)
        for i, code in enumerate(codes.tolist()):
            a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
            out[i] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
        return out

    def known(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of at most MAX_TRIGRAMS sorted distinct codes; those that lack are added to the kept ones."""
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            new = codes[self.codes[at] != codes]
        else:
            new = codes
        if len(new):
            if self.used + len(new) > len(self.rows):
                self._clear()
                new = codes
            self.rows[self.used : self.used + len(new)] = self._vectors(new)
            where = np.searchsorted(self.codes, new)
            self.places = np.insert(self.places, where, np.arange(self.used, self.used + len(new)))
            self.codes = np.insert(self.codes, where, new)
            self.used += len(new)
        return self.rows[self.places[np.searchsorted(self.codes, codes)]].astype(np.float32)

    def bundle(self, texts: list[list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
        """Vectors of some texts, each given as distinct trigram codes and their counts."""
        out = np.zeros((len(texts), self.dims), np.float32)
        every = [codes for text in texts for codes, _ in text]
        if not every:
            return out
        union = np.unique(np.concatenate(every))
        for a in range(0, len(union), MAX_TRIGRAMS):
            part = union[a : a + MAX_TRIGRAMS]
            counts = np.zeros((len(texts), len(part)), np.float32)
            for i, text in enumerate(texts):
                for codes, n in text:
                    lo, hi = np.searchsorted(codes, part[0]), np.searchsorted(codes, part[-1], "right")
                    counts[i, np.searchsorted(part, codes[lo:hi])] += n[lo:hi]
            out += counts @ self.known(part)
        return out


def text_trigrams(text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    return [np.unique(codes, return_counts=True) for codes in trigram_codes(text or "")]


def train(df: DataFrame, dims: int = DIMS, max_train_docs: int = MAX_TRAIN_DOCS, max_languages: int = MAX_LANGUAGES, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language -> prototype, from the rows of ``df`` that have a label and a text."""
    bound_batches(df.sparkSession)
    labelled = df.where(F.col(lang).isNotNull())
    n, n_languages = labelled.agg(F.count(F.lit(1)), F.count_distinct(lang)).first()
    if n_languages > max_languages:
        raise ValueError(f"{n_languages} languages; at most {max_languages} can be learned")
    share = min(1.0, max_train_docs / max(1, n))
    chosen = labelled if share >= 1 else labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = chosen.where(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(dims), {}
        for batch in batches:
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = sums.setdefault(name, {})
                for codes, k in text_trigrams(words):
                    for c, m in zip(codes.tolist(), k.tolist(), strict=True):
                        counts[c] = counts.get(c, 0) + m
                if len(counts) > MAX_TRIGRAMS:
                    yield partial(bundler, name, counts)
                    sums[name] = {}
        for name, counts in sums.items():
            yield partial(bundler, name, counts)

    def partial(bundler: Bundler, name: str, counts: dict[int, int]) -> pa.RecordBatch:
        codes = np.array(sorted(counts), np.int64)
        vector = bundler.bundle([[(codes, np.array([counts[c] for c in codes.tolist()], np.float32))]])[0] if len(codes) else np.zeros(dims, np.float32)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([np.rint(vector).astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["lang", "sums"])

    partials = chosen.mapInArrow(lean("language_id", run), "lang string, sums array<long>")
    rows = partials.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    out: dict[str, np.ndarray] = {}
    for name, pos, x in rows.collect():  # languages x dims numbers
        out.setdefault(name, np.zeros(dims))[pos] = x
    return {k: out[k] for k in sorted(out)}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score."""
    bound_batches(df.sparkSession)
    names = sorted(prototypes)
    dims = len(prototypes[names[0]]) if names else DIMS
    matrix = np.array([prototypes[k] / (np.linalg.norm(prototypes[k]) or 1) for k in names], np.float32).reshape(len(names), dims)
    src = df.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dims)
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(len(keep)).to_pylist()
            for at in range(0, len(texts), AT_ONCE):
                counts = [text_trigrams(x) if names else [] for x in texts[at : at + AT_ONCE]]
                vectors = bundler.bundle(counts)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ matrix.T).astype(float) / np.maximum(norms, 1e-9)[:, None] if names else np.zeros((len(counts), 1))
                for c, row in zip(counts, cosines, strict=True):
                    best = int(row.argmax())
                    langs.append(names[best] if c else UNKNOWN)
                    scores.append(min(1.0, max(0.0, float(row[best]))) if c else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(lean("language_id", run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
