"""Language identification by nearest centroid.

A text is lower-cased, bytes other than letters become spaces, and its byte 3-grams are hashed into a
fixed number of features: log(1 + count) * idf, of length one. Document frequencies come from all
labelled documents. Each language has several centroids, clustered by cosine from a bounded sample
(``per_language`` rows, by hash of doc_id). A text takes the language of the nearest centroid; it is
rejected where that centroid is farther than nearly all sampled texts of the language that are nearest to its own centroids (cosine under
their ``tail`` quantile, somewhat lower where they are few; not under what half of the other languages' samples reach, up to their 2 * ``tail`` quantile).

Only the texts and labels of ``train`` rows are learned from. The model has languages x clusters x features
floats; the corpus passes through tasks in pieces of bounded bytes.
Nulls and texts without a letter: ``und``, score 0, rejected. A null label isn't learned from. Very long texts are
used whole. Ties between centroids: the language that sorts first. Repeated rows get equal results. No labelled rows: every text is ``und``.
Empty table: no rows. Further columns are not read, and are passed through by ``with_language``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import tidy
from .common import byte_lengths, fresh, offsets_of

FEATURES = 4096
UNKNOWN = "und"
#: Rows and bytes that are vectors at one time.
ROWS, BYTES = 512, 4 << 20

#: Letters and bytes of other scripts stay, all other ASCII is a space.
_TABLE = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # [centroids, FEATURES], of length one
    floors: np.ndarray  # cosine under which a text is rejected
    idf: np.ndarray


def pieces(texts: pa.Array):
    """Slices of bounded rows and bytes, one row at least."""
    ends = np.cumsum(byte_lengths(texts))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = min(start + ROWS, max(start + 1, int(np.searchsorted(ends, before + BYTES, side="right"))))
        yield texts.slice(start, stop - start)
        start = stop


def counts(texts: pa.Array) -> np.ndarray:
    """[rows, FEATURES] counts of hashed byte 3-grams."""
    edge = pa.scalar(" ", pa.large_string())
    texts = pc.binary_join_element_wise(edge, pc.utf8_lower(fresh(texts)), edge, pa.scalar("", pa.large_string()))
    offs = offsets_of(texts)
    n = len(texts)
    if offs[-1] - offs[0] < 3:
        return np.zeros((n, FEATURES), dtype=np.int64)
    data = _TABLE[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]].astype(np.uint32)
    offs = offs - offs[0]
    h = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(20)  # 12 bits
    own = np.maximum(np.diff(offs) - 2, 0)  # 3-grams that don't reach into the next text
    row = np.repeat(np.arange(n), own)
    at = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(offs[:-1], own)
    return np.bincount(row * FEATURES + h[at], minlength=n * FEATURES).reshape(n, FEATURES)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts).astype(np.float32)) * idf
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)


def held_out(doc_id):
    """The documents that aren't learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """[1 + FEATURES]: number of texts, and of texts with each feature."""

    def count(batches):
        total = np.zeros(1 + FEATURES, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch.column("text")):
                total[0] += len(part)
                total[1:] += (counts(part) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 + FEATURES)), pa.array(total)], ["feature", "n"])

    rows = texts.mapInArrow(tidy(count), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + FEATURES, dtype=np.int64)
    for r in rows:
        out[r.feature] = r.n
    return out


def cluster(x: np.ndarray, k: int, rounds: int = 10, least_share: float = 0.05) -> np.ndarray:
    """Spherical k-means; starts from the first row and the rows farthest from what is chosen."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        nxt = int(np.argmin(near))
        if near[nxt] > 1 - 1e-6:
            break
        chosen.append(nxt)
        near = np.maximum(near, x @ x[nxt])
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    # Clusters of a few rows are mislabelled or odd texts; farthest-first starts find those first.
    share = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c)) / len(x)
    return c[(share >= least_share) | (share == share.max())]


def fit(train: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", clusters: int = 4, per_language: int = 1500, tail: float = 0.005) -> Model:
    """``train``: labelled rows; those with a null label, or without a letter, are left out."""
    spark = train.sparkSession
    rows = train.select(F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    freq = document_frequencies(rows.select("text"))
    idf = (np.log((1 + freq[0]) / (1 + freq[1:])) + 1).astype(np.float32)
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, FEATURES), np.float32), np.zeros(0, np.float32), idf)
    # A share of each language by hash, twice what is needed, and the first ones of those by hash.
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * per_language / n))]), F.col("lang"))
    some = rows.filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    from pyspark.sql import Window

    first = Window.partitionBy("lang").orderBy("h", F.length("text"))
    some = some.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).select("lang", "text")

    def centroids(table: pa.Table) -> pa.Table:
        texts = table.column("text").combine_chunks()
        x = np.concatenate([vectors(part, idf) for part in pieces(texts)])
        order = np.lexsort(x[:, :8].T)  # the same whatever order the rows came in
        c = cluster(x[order], clusters)
        name = table.column("lang")[0].as_py()
        return pa.table({"lang": [name] * len(c), "centroid": [row.astype("<f4").tobytes() for row in c]})

    found = sorted(some.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary").collect(), key=lambda r: r.lang)
    languages, c = [r.lang for r in found], np.stack([np.frombuffer(r.centroid, "<f4") for r in found])
    names = sorted(set(languages))
    code = np.array([names.index(x) for x in languages])
    shared = spark.sparkContext.broadcast(c)

    def closest(batches):
        for batch in batches:
            label = np.array([names.index(x) for x in batch.column("lang").to_pylist()], dtype=np.int64)
            start = 0
            for part in pieces(batch.column("text")):
                near = vectors(part, idf) @ shared.value.T
                best = np.stack([near[:, code == k].max(axis=1) for k in range(len(names))], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(label[start : start + len(part)]), pa.array(best.astype(float).tolist(), pa.list_(pa.float64()))], ["label", "best"])
                start += len(part)

    # At most ``per_language`` rows a language, with a number for each language.
    scored = some.mapInArrow(tidy(closest), "label long, best array<double>").toArrow()
    label, best = scored.column("label").to_numpy(), np.array(scored.column("best").to_pylist())
    nearest, floors = best.argmax(axis=1), np.zeros(len(names))
    for k in range(len(names)):
        own, others = best[(label == k) & (nearest == k), k], best[label != k, k]
        if len(own):
            low, high = np.quantile(own, [tail, 2 * tail]) * max(0.0, 1 - 2 / len(own) ** 0.5)
            floors[k] = max(low, min(high, np.median(others))) if len(others) else low
    return Model(languages, c, floors[code].astype(np.float32), idf)


def with_language(docs: DataFrame, model: Model, *, text: str = "text", to: str = "language") -> DataFrame:
    """``docs`` with a column struct<lang, score, rejected>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def answer(texts: pa.Array) -> pa.Array:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        langs, scores, rejected = [], [], []
        for part in pieces(texts):
            ok = has_letter(part)
            best, score = np.full(len(part), len(m.languages)), np.zeros(len(part))
            if m.languages:
                near = vectors(part, m.idf) @ m.centroids.T
                best = np.where(ok, near.argmax(axis=1), best)
                score = np.where(ok, np.clip(near.max(axis=1), 0, 1), 0).astype(float)
            langs.append(names[best])
            scores.append(score)
            rejected.append(~ok | (score < np.array([*m.floors, 2.0])[best]))
        if not langs:
            return pa.array([], kind)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))], ["lang", "score", "rejected"])

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda batches: map(answer, batches))(parts)

    return docs.withColumn(to, predict(F.col(text).cast("string")))


def language_query(docs: DataFrame) -> DataFrame:
    """op2: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows = with_language(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows = with_language(docs.select(F.struct("*").alias("row"), F.col("text")), model)
    return rows.filter(~F.col("language.rejected")).select("row.*")
