"""Language identification in two levels: first the family, then linear support vector machines within it.

Features are hashed byte trigrams of the lower-cased text with everything but letters blanked. A multinomial logistic
model tells the families apart; for each pair of languages of one family a linear support vector machine casts a vote.
Both are trained in Spark on a language-balanced sample of training documents, bounded for each language: the logistic
model by Spark ML, the machines in one task for each two blocks of a family's languages, by dual coordinate descent.
Scoring is one pass in which the text stays in its partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.llm.common import hash_fraction, held_out, map_batches, quoted, ship, stash, table, unused, without

WIDTH = 2048
#: Documents scored below this are not accepted. Fixed; of 1,960 held-out rows of the sf0.1 table it turns away one ("A.").
LEAST_SCORE = 0.5
#: Training documents of each language, at most about this many.
ROWS_PER_LANGUAGE = 1500
#: Languages of a family in a block; a task trains the pairs of two blocks.
BLOCK = 4
#: Regularisation of the machines, and passes over their rows.
REG, PASSES = 1e-4, 15

# Language families by ISO 639-1 code; a code not named here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "indic": "hi bn ur mr gu pa ne si",
    "turkic": "tr az kk uz ky tt",
    "semitic": "ar he mt am",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_TO_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def primary(lang: str) -> str:
    return re.split("[-_]", lang.lower())[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def trigrams(text: str) -> np.ndarray:
    """Hashed trigram counts, damped and scaled to length one; the last entry is a constant."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    codes = (b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]) if len(b) > 2 else np.zeros(0, np.uint32)
    at = (codes * np.uint32(2654435761)) >> np.uint32(21)
    x = np.sqrt(np.bincount(at, minlength=WIDTH).astype(np.float32))
    norm = float(np.sqrt((x * x).sum()))
    return x / norm if norm else x


@dataclass
class Model:
    """Families with weights (family, WIDTH) and offsets; for each family its languages and pairwise weights."""

    families: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) for each row of trigram features; regional codes of the language don't lower its score."""
        z = x @ self.weights.T + self.offsets
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        out: list[tuple[str, float]] = [("", 0.0)] * len(x)
        for f in np.unique(best):
            name, rows = self.families[f], np.flatnonzero(best == f)
            langs = self.languages[name]
            votes, margins = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            sure = np.zeros((len(rows), len(langs)))
            of = [primary(x) for x in langs]
            others = np.array([sum(x != y for y in of) for x in of])
            for a, b, w, c in self.pairs[name]:
                m = x[rows] @ w + c  # positive for the second
                q = 1 / (1 + np.exp(-np.clip(2 * m, -35, 35)))
                votes[:, a] += m < 0
                votes[:, b] += m >= 0
                margins[:, a] -= m
                margins[:, b] += m
                if of[a] != of[b]:
                    sure[:, a] += 1 - q
                    sure[:, b] += q
            winner = (votes + 1e-3 * np.tanh(margins)).argmax(axis=1)
            within = np.where(others[winner] > 0, sure[np.arange(len(rows)), winner] / np.maximum(others[winner], 1), 1.0)
            for r, w, s in zip(rows.tolist(), winner.tolist(), (p[rows, f] * within).tolist()):
                out[r] = (langs[w], min(1.0, max(0.0, s)))
        return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
        rows = [trigrams(t) for t in b.column(3).to_pylist()]
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["family", "place", "turn", "x"])


def svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with hinge loss for labels -1 and 1, by dual coordinate descent in a fixed order."""
    w, c = np.zeros(x.shape[1], np.float32), 0.0
    if not len(y) or (y == y[0]).all():
        return w, float(y[0]) if len(y) else 0.0
    most, alpha, square = 1 / (REG * len(y)), np.zeros(len(y)), (x * x).sum(axis=1) + 1.0
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(y)).tolist():
            new = min(max(alpha[i] - (y[i] * (float(x[i] @ w) + c) - 1) / square[i], 0.0), most)
            if new != alpha[i]:
                step = float((new - alpha[i]) * y[i])
                w += np.float32(step) * x[i]
                c += step
                alpha[i] = new
    return w, c


def _pair_trainer(sizes: list[int]):
    """For the rows of a family's blocks p and q: the machines of all pairs of p with q, of p within itself where they are one."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        of, p, q = (k.as_py() for k in key)
        rows = rows.combine_chunks().sort_by([("turn", "ascending"), ("place", "ascending")])
        place = rows["place"].to_numpy()
        x = pa.concat_arrays(rows["x"].chunks).flatten().to_numpy().reshape(-1, WIDTH)
        block = lambda k: range(k * BLOCK, min((k + 1) * BLOCK, sizes[of]))
        out = []
        for i, j in combinations(block(p), 2) if p == q else product(block(p), block(q)):
            two = np.flatnonzero((place == i) | (place == j))
            w, c = svm(x[two], np.where(place[two] == j, 1.0, -1.0))
            out.append({"family": of, "i": i, "j": j, "w": w.tobytes(), "c": c})
        return pa.Table.from_pylist(out, pa.schema([("family", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("w", pa.binary()), ("c", pa.float64())]))

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn every language of the documents not on crc32 remainder 0 of 5 with a text and a language; None where there are none."""
    ship(docs.sparkSession)
    rows = docs.where(~held_out(id_col, 5, 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if not counts:
        return None
    members: dict[str, list[str]] = {}
    for lang in sorted(counts):
        members.setdefault(family(lang), []).append(lang)
    names = sorted(members)
    sizes = [len(members[n]) for n in names]
    told = [(lang, min(1.0, ROWS_PER_LANGUAGE / counts[lang]), f, i) for f, n in enumerate(names) for i, lang in enumerate(members[n])]
    told = docs.sparkSession.createDataFrame(told, "lang string, share double, family int, place int")  # a row a language
    sample = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("turn"), hash_fraction(id_col).alias("at"), F.col(text_col).alias("text"))
    sample = sample.join(F.broadcast(told), "lang").where("at < share").select("family", "place", "turn", "text")
    made = stash(sample.mapInArrow(_feature_batches, "family int, place int, turn long, x array<float>"), "language-sample")
    weights, offsets = np.zeros((len(names), WIDTH)), np.zeros(len(names))
    if len(names) > 1:
        vectors = made.select(array_to_vector("x").alias("features"), F.col("family").cast("double").alias("label")).persist()
        try:
            model = LogisticRegression(maxIter=25, regParam=1e-4, standardization=False, family="multinomial").fit(vectors)
        finally:
            vectors.unpersist()
        learned = model.coefficientMatrix.toArray()  # the last families may have no row in the sample
        weights[: len(learned)], offsets[: len(learned)] = learned, model.interceptVector.toArray()
        offsets[len(learned) :] = -1e9
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]] = {n: [] for n in names}
    several = [(f, k, [[min(k, o), max(k, o)] for o in range(-(-n // BLOCK))]) for f, n in enumerate(sizes) if n > 1 for k in range(-(-n // BLOCK))]
    if several:
        where = docs.sparkSession.createDataFrame(several, "family int, block int, tasks array<array<int>>")
        dealt = made.withColumn("block", F.floor(F.col("place") / BLOCK).cast("int")).join(F.broadcast(where), ["family", "block"]).withColumn("task", F.explode("tasks"))
        dealt = dealt.select("family", F.col("task")[0].alias("p"), F.col("task")[1].alias("q"), "place", "turn", "x")
        trained = dealt.groupBy("family", "p", "q").applyInArrow(_pair_trainer(sizes), "family int, i int, j int, w binary, c double")
        for r in trained.collect():
            pairs[names[r["family"]]].append((r["i"], r["j"], np.frombuffer(r["w"], np.float32), r["c"]))
    for own in pairs.values():
        own.sort(key=lambda x: x[:2])
    return Model(names, weights, offsets, members, pairs)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The input's rows and columns with the two named columns, the language and its score; equal names are replaced.

    Text that is null or holds no letter is ``und`` with score 0, as is every text where nothing could be learned. Equal
    texts are told alike; of families or languages with equal votes and margins the first by name counts. An empty table
    gives an empty result.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs.sparkSession)
    kept = without(docs.columns, names)
    told = [docs.columns[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            texts = b.column(at).to_pylist()
            for start in range(0, len(texts) if model else 0, 256):
                rows = [i for i in range(start, min(start + 256, len(texts))) if has_letter(texts[i])]
                if rows:
                    for i, (lang, s) in zip(rows, model.predict(np.array([trigrams(texts[i]) for i in rows], np.float64))):
                        langs[i], scores[i] = lang, s
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(langs), pa.array(scores)], names=[*told, *names])

    return map_batches(docs, run, T.StructType([*[docs.schema[i] for i in kept], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def accepted(docs: DataFrame, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The input's rows and columns, whatever they are named, without documents of undetermined language or a score below ``least_score``.

    Where no row has a language, so that nothing can be learned, every document that holds a letter stays.
    """
    lang, sure = unused(docs.columns, "__lang", "__sure")
    model = fit(docs, id_col, text_col, lang_col)
    if model is None:
        return lettered(docs, text_col)
    marked = predict(docs, model, text_col, (lang, sure))
    return marked.where((F.col(lang) != "und") & (F.col(sure) >= least_score)).select(*quoted(docs.columns))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows and columns without documents that hold no letter."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([has_letter(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
