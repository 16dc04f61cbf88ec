"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is bound from its letters'
vectors, permuted (rotated) by their places and multiplied; a text's or a language's
profile bundles (adds) its trigrams' vectors.  A text gets the language whose profile
has the largest cosine with its own.  Text is lower-cased letter by letter; a run of
other characters counts as one blank, and every text is set between blanks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import masked, unmasked
from .textbytes import blocks, emit

DIMENSION = 1024
SYMBOLS = 256
"""Blank, the letters a to z, and hashed classes of all other letters."""
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letter_symbols() -> np.ndarray:
    """The symbol of every code point: 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            code_low = ord(low) if len(low) == 1 else code
            is_latin = 97 <= code_low <= 122
            table[code] = code_low - 96 if is_latin else 27 + (code_low * 2654435761 >> 7) % (SYMBOLS - 27)
    return table


@lru_cache(maxsize=2)
def letter_vectors(dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the symbols at the first, second and third place of a trigram."""
    base = np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimension))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigrams(buf: np.ndarray, offsets: np.ndarray, last: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes of all trigrams of a block of texts, the text of each, the letters of each text, and the last letter.

    ``last`` is the last letter's symbol of the text's blocks before this one, if the
    block goes on with a text; it closes the trigram over the cut, whose middle is a blank.
    """
    n = len(offsets) - 1
    codes = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = (buf & 0xC0) != 0x80
    if int(lead.sum()) != len(codes):  # not UTF-8: a character a byte keeps the offsets right
        codes, lead = buf.astype(np.uint32), np.ones(len(buf), bool)
    chars = np.concatenate(([0], np.cumsum(lead)))[offsets]
    # A blank before and after each text, then runs of blanks become one.
    doc = np.repeat(np.arange(n), np.diff(chars) + 2)
    s = np.zeros(len(codes) + 2 * n, np.int64)
    s[np.arange(len(codes)) + 2 * np.repeat(np.arange(n), np.diff(chars)) + 1] = letter_symbols()[codes]
    letters = np.bincount(doc[s > 0], minlength=n)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters, last
    if last:  # s starts with the blank that the cut left
        s, doc = np.concatenate(([last], s)), np.concatenate((doc[:1], doc))
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    one = doc[:-2] == doc[2:]
    return code[one], doc[:-2][one], letters, int(s[-2])


def text_blocks(column: pa.Array) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, whether the block goes on with the last one's text, trigram codes, text of each, letters) by blocks."""
    before: tuple[int, int] | None = None  # row and last letter of a block of one text, which may go on
    for row, offsets, buf in blocks(column):
        again = before is not None and before[0] == row
        code, doc, letters, last = trigrams(buf, offsets, before[1] if again else 0)
        before = (row, last) if len(letters) == 1 else None
        yield row, again, code, doc, letters


def trigram_vectors(codes: np.ndarray, dimension: int) -> np.ndarray:
    """Bound vectors of trigram codes."""
    a, b, c = letter_vectors(dimension)
    return (a[codes // SYMBOLS**2] * b[codes // SYMBOLS % SYMBOLS] * c[codes % SYMBOLS]).astype(np.float32)


def profiles(column: pa.Array, dimension: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, profiles, letters) of consecutive blocks of rows.

    A long text comes in several, each with all of the text so far, so the last one counts.
    """
    tail = seen = np.zeros(0)
    for row, again, code, doc, letters in text_blocks(column):
        n = len(letters)
        uniq, at = np.unique(code, return_inverse=True)
        for lo in range(0, n, 256):  # bounds the dense counts
            part = (doc >= lo) & (doc < lo + 256) if n > 256 else slice(None)
            m = min(256, n - lo)
            out, k = np.zeros((m, dimension)), letters[lo : lo + m]
            if len(uniq):
                counts = np.bincount((doc[part] - lo) * len(uniq) + at[part], minlength=m * len(uniq))
                out = (counts.reshape(m, len(uniq)).astype(np.float32) @ trigram_vectors(uniq, dimension)).astype(np.float64)
            if again:
                out, k = out + tail, k + seen
            tail, seen = out, k
            yield row + lo, out, k


def bundled(batches: Iterator[pa.RecordBatch], dimension: int) -> dict[str, np.ndarray]:
    """Sums of the profiles of all texts (text, lang), each divided by its number of trigrams, by language."""
    sums: dict[str, np.ndarray] = {}

    def add(name: str, v: np.ndarray) -> None:
        sums[name] = sums.get(name, 0) + v

    for batch in batches:
        names = np.array(batch.column("lang").to_pylist(), object)
        kinds, which = np.unique(names.astype(str), return_inverse=True)
        held, size, at_row = np.zeros(dimension), 0, -1  # a block of one text may go on: it is weighed at its end
        for row, again, code, doc, letters in text_blocks(batch.column("text")):
            uniq, at = np.unique(code, return_inverse=True)
            if not again and size:
                add(str(kinds[which[at_row]]), held / size)
                held, size = np.zeros(dimension), 0
            if len(letters) == 1:
                if len(uniq):
                    held = held + np.bincount(at).astype(np.float64) @ trigram_vectors(uniq, dimension)
                size, at_row = size + len(code), row
                continue
            weight = 1 / np.maximum(np.bincount(doc, minlength=len(letters)), 1)
            table = np.bincount(which[row + doc] * len(uniq) + at, weight[doc], len(kinds) * len(uniq)).reshape(len(kinds), -1)
            for name, v in zip(kinds, table.astype(np.float64) @ trigram_vectors(uniq, dimension)):
                add(str(name), v)
        if size:
            add(str(kinds[which[at_row]]), held / size)
    return {k: v for k, v in sums.items() if np.any(v)}


def fit(labelled: DataFrame, dimension: int = DIMENSION) -> dict[str, np.ndarray]:
    """Language profiles from all rows of ``labelled`` (text, lang); null languages or texts are left out.

    A text weighs the same whatever its length, so that no long one makes a profile alone.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = bundled(batches, dimension)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([*sums], dimension).tolist(), pa.string()), pa.array(np.tile(np.arange(dimension), len(sums)), pa.int64()),
             pa.array(np.concatenate([*sums.values()] or [np.zeros(0)]), pa.float64())],
            names=["lang", "axis", "x"],
        )

    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).dropna()
    # A row a language and axis reaches the driver.
    found = rows.mapInArrow(bundle, "lang string, axis long, x double").groupBy("lang", "axis").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for lang, axis, x in sorted(found):
        out.setdefault(lang, np.zeros(dimension))[axis] = x
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default all) of ``docs`` with ``lang_pred`` and ``score``, the cosine (0 if negative) with the chosen profile.

    A text that is null or has no letter is ``und`` with score 0, as is every text if
    no language was learned; of equal cosines the first language by name wins.  A text of
    any length is one text.  Columns of these two names (in any case) are replaced.
    """
    keep = [c for c in keep or docs.columns if c.lower() not in ("lang_pred", "score")]
    names = [*prototypes] or [UNDETERMINED]
    matrix = np.array([prototypes[k] for k in prototypes] or [np.ones(DIMENSION)])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast(unit)
    learned = bool(prototypes)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = np.zeros((batch.num_rows, len(names)))
            letters = np.zeros(batch.num_rows, np.int64)
            norms = np.zeros(batch.num_rows)
            for row, h, k in profiles(batch.column(text), shared.value.shape[1]):
                letters[row : row + len(k)] = k
                norms[row : row + len(k)] = np.linalg.norm(h, axis=1)
                dots[row : row + len(k)] = h @ shared.value.T
            best = np.argmax(dots, axis=1)
            score = np.clip(dots[np.arange(len(best)), best] / np.maximum(norms, 1e-9), 0, 1)
            known = (letters > 0) & learned
            pred = np.where(known, np.array(names, object)[best], UNDETERMINED)
            yield from emit(batch, keep, {"lang_pred": pa.array(pred.tolist(), pa.string()), "score": pa.array(np.where(known, score, 0.0))})

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: CRC-32 of its id's text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all) of ``docs`` with held_out, lang_pred and score, learned from its own labelled rows that are not held out.

    Null and empty texts, very long ones and ties are as ``predict`` and ``fit`` state;
    repeated rows are judged each (and learned from each); an empty table gives an empty
    one; columns of the three added names are replaced.
    """
    model = fit(docs.where(~held_out()).select("text", "lang"))
    keep = [c for c in keep or docs.columns if c.lower() != "held_out"]
    return predict(docs.drop("held_out").withColumn("held_out", held_out()), model, [*keep, "held_out"])


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a cosine over ``least``; columns and values stay as they are.

    Null, empty and letterless texts go (as do all rows where no language can be
    learned); repeated rows stay or go together; an empty table stays empty.
    """
    model = fit(docs.where(~held_out()).select("text", "lang"))
    inner, names = masked(docs)
    judged = predict(inner, model, text=names["text"])
    return unmasked(judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") > least)), names)
