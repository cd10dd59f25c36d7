"""Language identification by nearest centroid over TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.columns import fold, packed, small
from pathloom.shared import save_table

#: Labelled rows per language that a model is fitted on, at most.
SAMPLE_PER_LANGUAGE = 300

#: Clusters per language.
CENTROIDS = 4

#: A cluster with a smaller share of its language's rows is taken for outliers, such as wrong labels, and dropped.
OUTLIER_SHARE = 0.02

#: A document is rejected if its cosine is below this part of what documents of its size have.
REJECT_RATIO = 0.25

UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_PAIRS, _TRIPLES = 64 * 64, 1 << 15
DIMENSIONS = _PAIRS + _TRIPLES


def _codes() -> bytes:
    """A table from bytes to 64 codes: 0 for what is no letter, letters, bytes beyond ASCII."""
    table = bytearray(256)
    for b in range(256):
        if 97 <= b <= 122:
            table[b] = b - 96
        elif b >= 128:
            table[b] = 27 + b % 37
    return bytes(table)


_CODES = _codes()


def has_letter(text: str) -> bool:
    """Whether some character is a letter (Unicode category L); digits in other shapes are none."""
    return any(any(map(str.isalpha, m[0])) for m in _WORD.finditer(text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(dimensions, counts, n) of the byte pairs and triples of a lower-cased text.

    Bytes become 64 codes; runs of anything but letters count once. Triples are hashed.
    """
    codes = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_CODES), np.uint8)
    codes = np.concatenate(([0], codes, [0])).astype(np.int32)
    kept = codes[1:][(codes[1:] != 0) | (codes[:-1] != 0)]
    codes = np.concatenate((codes[:1], kept))
    pairs = codes[:-1] * 64 + codes[1:]
    triples = (pairs[:-1] * 2_531 + codes[2:] * 40_503) % _TRIPLES + _PAIRS
    counts = np.bincount(np.concatenate((pairs, triples)), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    return at, counts[at], len(pairs)


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF weights; the term frequency is damped by a logarithm."""
    w = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((w * w).sum())
    return (w / norm if norm else w).astype(np.float32)


@dataclass
class LanguageModel:
    """Centroids with their languages, inverse document frequencies, and cosine floors by size.

    ``floors[k]`` is for documents of 2**k to 2**(k+1) - 1 byte pairs.
    """

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray  # dimensions by centroids, so that a document gathers rows
    idf: np.ndarray
    floors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine to the nearest centroid, rejected)."""
        if not text or not has_letter(text) or not self.languages:
            return UNDETERMINED, 0.0, True
        at, counts, n = ngram_counts(text)
        near = weighted(at, counts, self.idf) @ self.centroids[at]
        best = int(near.argmax())
        score = min(1.0, max(0.0, float(near[best])))
        return self.languages[self.owner[best]], score, score < self.floors[size_class(n)]


def size_class(n: int) -> int:
    return min(31, max(1, n).bit_length() - 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; seeds are chosen each as the row farthest from those before."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    centres = x[seeds]
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(axis=1)
        fresh = [x[owner == i].sum(axis=0) if (owner == i).any() else centres[i] for i in range(len(centres))]
        centres = np.stack([c / (np.sqrt((c * c).sum()) or 1) for c in fresh])
    share = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres)) / len(x)
    return centres[share >= min(OUTLIER_SHARE, share.max())]


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """At most ``per_language`` labelled rows of each language, chosen by a hash of the id.

    Counting first bounds what enters the window to about twice the sample. The counts, a row a
    language, join the rows, so there may be any number of languages.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = save_table(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    share = F.lit(2.0 * per_language + 50) / F.col("rows")
    chance = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.withColumn("chance", chance).join(small(counts, counts.count()), "lang").where(F.col("chance") < share).select("lang", "text", "chance")
    first = Window.partitionBy("lang").orderBy("chance", F.xxhash64("text"))
    return near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language).select("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit a model on a bounded sample of the labelled rows.

    Rows with a null label or text are left out, and so are texts without letters. Without any
    row the model knows no language and answers ``und``. The driver gets the n-gram counts of at
    most ``per_language`` rows a language, some 6 KB each and never more than 300 KB, whatever
    the corpus; a language adds up to 600 KB of centroids to the model.
    """

    def vectors(batches):
        for batch in batches:
            found = [ngram_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.astype(np.int32) for a, _, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c, _ in found], pa.list_(pa.int32())), pa.array([n for _, _, n in found], pa.int64())],
                ["lang", "at", "counts", "n"],
            )

    chosen = sample(docs.where(F.col(text_col).rlike(r"\p{L}")), id_col, text_col, lang_col, per_language)
    rows = chosen.mapInArrow(vectors, "lang string, at array<int>, counts array<int>, n long").toArrow()
    langs, n = np.array(rows.column("lang").to_pylist(), object), rows.column("n").to_numpy()
    found = [(np.array(a), np.array(c)) for a, c in zip(rows.column("at").to_pylist(), rows.column("counts").to_pylist())]
    seen = np.zeros(DIMENSIONS)
    for a, _ in found:
        seen[a] += 1
    idf = np.log((1 + len(found)) / (1 + seen)) + 1
    names = sorted(set(langs))
    owner, centres, near = [], [], np.zeros(len(found))
    for k, lang in enumerate(names):
        mine = np.flatnonzero(langs == lang)
        x = np.zeros((len(mine), DIMENSIONS), np.float32)
        for row, i in enumerate(mine):
            x[row, found[i][0]] = weighted(*found[i], idf)
        # Sorting makes the clusters independent of the order in which rows arrive.
        order = np.lexsort((x @ np.arange(DIMENSIONS, dtype=np.float32), n[mine]))
        own = spherical_kmeans(x[order], centroids)
        near[mine] = (x @ own.T).max(axis=1)
        owner += [k] * len(own)
        centres += list(own)
    return LanguageModel(names, np.array(owner, int), np.array(centres, np.float32).reshape(-1, DIMENSIONS).T.copy(), idf, size_floors(near, n))


def expected(n: np.ndarray | float) -> np.ndarray | float:
    """How the cosine of a text grows with its ``n`` byte pairs: like the root at first, then levelling off."""
    return np.sqrt(n / (n + 200.0))


def size_floors(near: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cosine floors by size class, from the sample's documents of about that size.

    A class that has fewer than five documents within one class to either side looks further;
    what it finds is scaled to its own size.
    """
    classes = np.array([size_class(int(k)) for k in n], int)
    relative = near / expected(n.astype(float))
    floors = np.zeros(32)
    for k in range(32):
        for reach in range(1, 32):
            around = relative[np.abs(classes - k) <= reach]
            if len(around) >= 5:
                floors[k] = REJECT_RATIO * np.quantile(around, 0.01) * expected(2.0**k)
                break
    return np.minimum.accumulate(floors[::-1])[::-1]  # never higher for a smaller text


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict every document's language from its whole text.

    Returns ``row`` (the input row), lang_pred, score (the cosine to the nearest centroid, 0 to
    1) and rejected: the document is farther from all centroids than documents of its size are,
    or has no letter.

    * a null text, or one without a letter, is ``und`` with score 0, and rejected
    * with a model without languages everything is ``und``
    * each row is judged by its text alone, so repeated rows agree; an empty table gives no rows

    Plan: one pass without a shuffle; the model, whose size is bounded by its parameters, goes
    out once with the tasks.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = packed(docs, id_col, text_col)
    kind = base.select("row").schema["row"].dataType

    def run(batches):
        known = held.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                ["row", "lang_pred", "score", "rejected"],
            )

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    out = StructType([StructField("row", kind), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return base.select("row", "text").mapInArrow(run, out)


def held_out(id_column, n: int = 5):
    """Whether a document is kept from training: its id's crc32 leaves no remainder."""
    return fold(id_column, n) == 0
