"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon has a fixed part (common insults) and a learned part: words and word stems far commoner in toxic than in
other documents of a bounded training sample. One pass over the texts makes the features: lexicon densities, distance of
lexicon words from words of the second person, capitals, punctuation, and rates of obfuscated words (digits and signs for
letters, spaced letters). They form a narrow table, written once. Trees and calibration are Spark ML models trained on
bounded samples that share no row with the lexicon's sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import simhash
from recordmill.llm.common import hash_fraction, held_out, one_label, ship, stash, table

#: Training documents of each class from which the lexicon is learned, and labelled rows for trees and calibration.
LEXICON_ROWS, TREE_ROWS = 4000, 20_000
MOST_WORDS, MOST_STEMS, STEM = 600, 150, 5

# Common insults and abuse, lower case.
INSULTS = (
    "idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage clown clowns pathetic worthless disgusting imbecile cretin "
    "fool jerk bastard bitch asshole shit crap fuck fucking damn vermin filth hate kill ugly liar pig retard freak creep "
    "dumm idiotin arschloch scheisse scheiße trottel depp abschaum versager wertlos "
    "idiote imbécile connard salaud merde ordure crétin débile "
    "idiota estúpido imbécil basura mierda cabrón asqueroso inútil"
)
# Words of the second person, lower case.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros vuestro os"

_KEEP = b"$@"
_TO_TOKENS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c in _KEEP else 32 for c in range(256))
_LEETS = (bytes.maketrans(b"013457@$", b"oieastas"), bytes.maketrans(b"013457@$", b"oleastas"))
_MIXED = re.compile(rb"(?<![^ ])(?=[^ ]*[a-z])(?=[^ ]*[0-9@$])[^ ]+")
_SPACED = re.compile(rb"(?<![^ ])(?:[a-z] +){3,}[a-z](?![^ ])")
_MARKS = np.frombuffer(b"!?.,;:*#%&\"'()-", np.uint8)
_LOUD = np.frombuffer(b"!?*#%&", np.uint8)

NAMES = (
    "log_words", "fixed_hits", "fixed_density", "word_hits", "word_density", "word_weight", "stem_hits", "stem_density", "stem_weight", "hidden_hits", "hidden_rate",
    "nearness", "second_person", "capitals", "loud_marks", "marks", "other_bytes", "distinct_hits",
)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits, @, $ and characters beyond ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_TOKENS).split()


class Lexicon:
    """Fixed insults, and learned words and stems with their log-odds."""

    def __init__(self, words: dict[bytes, float], stems: dict[bytes, float]):
        self.fixed = frozenset(w.encode() for w in INSULTS.split())
        self.you = frozenset(w.encode() for w in SECOND_PERSON.split())
        self.words, self.stems = words, stems
        self.known = self.fixed | words.keys()

    def features(self, text: str | None) -> list[float]:
        """Dense features of one whole text; null counts as empty."""
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        joined = text.lower().encode("utf-8", "surrogatepass").translate(_TO_TOKENS)
        words = joined.split()
        n, size = max(len(words), 1), max(len(raw), 1)
        distinct = set(words)
        hit = distinct & self.known
        stems = {w[:STEM] for w in distinct if len(w) > STEM} & self.stems.keys()
        hidden = 0
        mixed = _MIXED.findall(joined) if counts[48:58].any() or counts[36] or counts[64] else []
        for w in mixed:
            hidden += any(w.translate(t) in self.known for t in _LEETS)
        spaced = _SPACED.findall(joined)
        for run in spaced:
            hidden += run.replace(b" ", b"") in self.known
        fixed = learned = stemmed = near = 0
        if hit or stems:
            places, yous = [], []
            for i, w in enumerate(words):
                if w in hit:
                    places.append(i)
                    fixed += w in self.fixed
                    learned += w in self.words
                elif w[:STEM] in stems and len(w) > STEM:
                    places.append(i)
                    stemmed += 1
                elif w in self.you:
                    yous.append(i)
            if places and yous:
                p, y = np.array(places), np.array(yous)
                after = np.searchsorted(y, p)
                gap = np.minimum(np.abs(y[np.minimum(after, len(y) - 1)] - p), np.abs(y[np.maximum(after - 1, 0)] - p))
                near = 1 / int(gap.min())
        letters = int(counts[65:91].sum() + counts[97:123].sum())
        return [
            math.log1p(len(words)),
            math.log1p(fixed),
            fixed / n,
            math.log1p(learned),
            learned / n,
            sum(self.words[w] for w in hit if w in self.words),
            math.log1p(stemmed),
            stemmed / n,
            sum(self.stems[s] for s in stems),
            math.log1p(hidden),
            (len(mixed) + len(spaced)) / n,
            near,
            len(distinct & self.you) / max(len(distinct), 1),
            int(counts[65:91].sum()) / max(letters, 1),
            int(counts[_LOUD].sum()) / size,
            int(counts[_MARKS].sum()) / size,
            int(counts[128:].sum()) / size,
            len(hit) + len(stems),
        ]


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words (kind w) and stems (kind s) of each document, with its label and weight."""
    for b in batches:
        kinds, terms, labels, weights = [], [], [], []
        for text, label, weight in zip(*(b.column(i).to_pylist() for i in range(3))):
            distinct = set(tokens(text))
            stems = {w[:STEM] for w in distinct if len(w) > STEM}
            terms += [*distinct, *stems]
            kinds += ["w"] * len(distinct) + ["s"] * len(stems)
            labels += [label] * (len(distinct) + len(stems))
            weights += [weight] * (len(distinct) + len(stems))
        columns = [pa.array(kinds, pa.string()), pa.array(terms, pa.binary()), pa.array(labels, pa.int32()), pa.array(weights, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "term", "label", "weight"])


def learn_lexicon(docs: DataFrame, training: DataFrame, sizes: dict[int, int]) -> Lexicon:
    """Words and stems whose log-odds for toxic documents are high, each seen in enough of them.

    Near-duplicates of one label (SimHash components) share the weight of one document, so that a group of copies doesn't
    make its own words look toxic; no document of the sample is left out, and sums are rounded to be equal in every run.
    """
    share = F.when(F.col("label") == 1, min(0.5, LEXICON_ROWS / max(sizes.get(1, 0), 1))).otherwise(min(0.5, LEXICON_ROWS / max(sizes.get(0, 0), 1)))
    chosen = training.where(hash_fraction("doc_id") < share)  # at most about LEXICON_ROWS of each class, so small enough to broadcast
    sample = stash(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), "lexicon-sample")
    parts = [simhash.weighted(sample.where(F.col("label") == label), "weight", "doc_id") for label in (0, 1)]
    sample = stash(parts[0].unionByName(parts[1]).select("text", "label", "weight"), "lexicon-weights")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.round(F.sum("weight"), 6).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, {})
    counts = sample.mapInArrow(_term_batches, "kind string, term binary, label int, weight double").groupBy("kind", "term")
    total = lambda label: F.round(F.sum(F.when(F.col("label") == label, F.col("weight")).otherwise(0.0)), 6)
    counts = counts.agg(total(1).alias("pos"), total(0).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    least = max(5, pos // 400)
    strong = counts.where(F.col("pos") >= least).withColumn("odds", odds).where("odds > 2.5")
    found: dict[str, dict[bytes, float]] = {}
    for kind, most in (("w", MOST_WORDS), ("s", MOST_STEMS)):
        rows = strong.where(F.col("kind") == kind).orderBy(F.desc("odds"), F.desc("pos"), "term").limit(most).collect()
        found[kind] = {bytes(r["term"]): float(r["odds"]) for r in rows}
    return Lexicon(found["w"], found["s"])


def features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, x) per document; ``docs`` has doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.features
        for b in batches:
            rows = np.array([of(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(NAMES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) per document.

    Documents on crc32 remainder 2 of 4, or without an id, are held out of training. Null text is scored as empty.
    Where training rows lack a class, every score is the share of class 1 among them, 0.5 if there are none. Repeated
    documents are scored alike; labels with a null are ignored; of several labels of one id the smallest counts. Scores do
    not depend on how the documents are partitioned; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    training = one_label(labels.select(F.col(id_col).alias("doc_id"), label_col), "doc_id", label_col).where(~held_out("doc_id", 4, 2))
    sizes = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    total = sum(sizes.values())
    out = [F.col("doc_id").alias(id_col), held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")]
    constant = narrow.withColumn("score", F.lit(sizes.get(1, 0) / total if total else 0.5))
    if len(sizes) < 2:
        return constant.select(*out)
    table_of = stash(features(narrow, learn_lexicon(narrow, training, sizes)), "toxicity")
    share = min(0.5, TREE_ROWS / total)  # from the other end of the hash than the lexicon's rows
    rows = table_of.join(training.where(hash_fraction("doc_id") >= 1 - share), "doc_id").select("doc_id", array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    # A bounded number of rows, dealt and sorted by id, so that trees grow alike however the documents lie.
    rows = stash(rows, "toxicity-rows").repartition(8, "doc_id").sortWithinPartitions("doc_id", "label").persist()
    try:
        apart = F.pmod(F.hash("doc_id"), F.lit(10)) < 7
        grow, calibrate = rows.where(apart), rows.where(~apart)
        if min(x.select("label").distinct().count() for x in (grow, calibrate)) < 2:
            return constant.select(*out)
        trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, seed=7, maxBins=32).fit(grow)
        raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
        steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="level").fit(raw(calibrate).select("raw", "label"))
    finally:
        rows.unpersist()
    scored = steps.transform(raw(table_of.select("doc_id", array_to_vector("x").alias("features"))))
    # A hundredth of the trees' own probability keeps apart what one step of the calibration holds level.
    return scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("level") + 0.01 * F.col("raw")))).select(*out)


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
