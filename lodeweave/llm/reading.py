"""Reading level of documents by gradient-boosted regression trees.

Features are distributions over a document's sentences: length, vocabulary (corpus-wide rarity of
words and the mean level of the rated documents they occur in), syntax (the marks that part clauses) and
cohesion (words shared by neighbouring sentences, connectives), so one model serves all languages.
Statistics of words are gathered over all documents; the model itself is fitted on the rated sample,
at most ``SAMPLE`` rated documents. Folds are made of whole sources: documents are graded by a model, from
word levels and with a calibration that know nothing of their source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.trees import Ensemble, boosted, isotonic
from lodeweave.runtime import cut, ship

#: Rated documents used for fitting, the ones of least hash if there are more.
SAMPLE = 20_000
#: Words kept with their mean level: those in at least this many rated documents.
LEAST_DOCUMENTS = 4
FOLDS = 5

_CODE = regex.compile(r"```.*?(?:```|\Z)|<[^<>\n]++>|`[^`\n]*`|https?://\S+|^[ \t]*#[^\n]*$|\{\{.*?\}\}", regex.S | regex.M)
_END = regex.compile(r"(?<=[.!?;:…])\s+|\n\s*\n")
_WORD = regex.compile(r"\p{L}+(?:['’-]\p{L}+)*")
_VOWELS = regex.compile(r"[aeiouyàâäáéèêëíîïóôöúùûüœæ]+")
_MARKS = ",;:()–—"
_CAPITALS = regex.compile(r"\p{Lu}")
SCORES = ["score", "length", "word_length", "long_share", "syllables", "rarity", "marks", "overlap"]
SHAPE = ["mean", "sd", "q10", "q50", "q90"]
FEATURES = [f"{a}_{b}" for a in SCORES for b in SHAPE] + ["n_sentences", "n_words", "variety", "hard_share", "easy_share", "middle_share", "known_share", "caps", "exclaimed"]


#: Sentences a worker remembers; beyond it the memory starts anew (results do not change).
REMEMBERED = 100_000


def split_sentences(text: str) -> list[str]:
    """The sentences of a text, lower case; code, markup, headings and addresses left out."""
    return [s for s in _END.split(_CODE.sub(" ", text).casefold()) if s]


def sentences(text: str) -> list[list[str]]:
    """Words of every sentence that has any."""
    return [w for w in map(_WORD.findall, split_sentences(text)) if w]


def _shapes(a: np.ndarray, w: np.ndarray) -> list[float]:
    """Mean, deviation and three quantiles of every column, sentences weighted by their words."""
    total = w.sum()
    mean = w @ a / total
    sd = np.sqrt(np.maximum(0.0, w @ (a - mean) ** 2 / total))
    order = np.argsort(a, axis=0, kind="stable")
    ranked = np.take_along_axis(a, order, axis=0)
    share = np.cumsum(w[order], axis=0) / total
    at = [np.minimum((share < q).sum(axis=0), len(a) - 1) for q in (0.1, 0.5, 0.9)]
    return np.stack([mean, sd, *(ranked[i, np.arange(a.shape[1])] for i in at)], axis=1).ravel().tolist()


class Features:
    """Feature rows of texts for given word statistics; what a sentence contributes is remembered by its text."""

    def __init__(self, level: dict[str, float], rarity: dict[str, float], default: float, rarest: float, remembered: int = REMEMBERED):
        self.most = remembered
        self.level, self.rarity, self.default, self.rarest = level, rarity, default, rarest
        self.known: dict[str, tuple] = {}

    def _sentence(self, s: str) -> tuple:
        """(numbers of the sentence, its longer words, words with a level); () if it has no words."""
        words = _WORD.findall(s)
        got: tuple = ()
        if words:
            n = len(words)
            scored = [self.level[w] for w in words if w in self.level]
            numbers = (
                sum(scored) / len(scored) if scored else self.default, n, sum(map(len, words)) / n, sum(len(w) > 8 for w in words) / n,
                len(_VOWELS.findall(" ".join(words))) / n, sum(self.rarity.get(w, self.rarest) for w in words) / n, sum(map(s.count, _MARKS)),
            )
            got = (numbers, frozenset(w for w in words if len(w) > 3), len(scored))
        if len(self.known) >= self.most:
            self.known.clear()
        if len(s) < 1000:
            self.known[s] = got
        return got

    def row(self, text: str | None) -> list[float]:
        """The feature row of one text; all zero for a text without words."""
        plain = _CODE.sub(" ", text) if text else ""
        rows, before, known, seen = [], frozenset(), 0, set()
        remembered = self.known.get
        for s in _END.split(plain.casefold()) if plain else ():
            got = remembered(s)
            if got is None:
                got = self._sentence(s)
            if got:
                numbers, here, scored = got
                known += scored
                seen |= here
                rows.append((*numbers, len(here & before) / max(1, len(here))))
                before = here
        if not rows:
            return [0.0] * len(FEATURES)
        a = np.array(rows)
        w = a[:, 1].astype(float)
        size = w.sum()
        letters = max(1.0, float(a[:, 2] @ w))
        out = _shapes(a, w)
        s = a[:, 0]
        return out + [
            np.log1p(len(rows)), np.log1p(size), len(seen) / size, float(w[s >= 3.2].sum() / size), float(w[s < 1.8].sum() / size), float(w[(s >= 2.4) & (s < 3.2)].sum() / size),
            known / size, len(_CAPITALS.findall(plain)) / letters, plain.count("!") / len(rows),
        ]


@dataclass
class Words:
    """Per word: rated documents and their summed level, in all and per fold; and corpus-wide rarity."""

    total: dict[str, tuple[float, float]]
    fold: list[dict[str, tuple[float, float]]]
    rarity: dict[str, float]
    mean: float
    rarest: float

    def levels(self, *without: int) -> dict[str, float]:
        """Mean level of every word, drawn towards the mean of all; folds in ``without`` are left out."""
        out = {}
        for w, (s, n) in self.total.items():
            for f in without:
                gs, gn = self.fold[f].get(w, (0.0, 0.0))
                s, n = s - gs, n - gn
            if n > 0:
                out[w] = (s + 2 * self.mean) / (n + 2)
        return out


def folds_of(counts: dict[str, int]) -> dict[str, int]:
    """Sources by fold: whole sources, the largest first, each into the fold that holds least."""
    held, out = [0] * FOLDS, {}
    for s in sorted(counts, key=lambda s: (-counts[s], s)):
        k = held.index(min(held))
        out[s] = k
        held[k] += counts[s]
    return out


@dataclass
class ReadingModel:
    words: Words
    trees: Ensemble
    knots: tuple[np.ndarray, np.ndarray]
    cut: float  # calibrated level from which a document counts as expert
    report: pd.DataFrame  # by source: n, mean error, accuracy of what was predicted for unseen folds

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.predict(x), *self.knots)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce("source", F.lit("")).alias("source"))


def _words_of(df: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """The distinct words of every text, exploded next to the kept columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, *k) for t, *k in zip(b["text"], *(b[c] for c in keep)) for w in {w for s in sentences(t or "") for w in s}]
            yield pd.DataFrame(rows, columns=["word", *keep])

    return df.select("text", *keep).mapInPandas(run, schema)


def _counted(documents: DataFrame) -> DataFrame:
    """(word, n_documents) over the whole corpus; counted per partition before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        known: dict[str, frozenset] = {}
        for b in batches:
            for t in b["text"]:
                words: set[str] = set()
                for s in split_sentences(t or ""):
                    here = known.get(s)
                    if here is None:
                        here = frozenset(_WORD.findall(s))
                        if len(known) >= REMEMBERED:
                            known.clear()
                        if len(s) < 1000:
                            known[s] = here
                    words |= here
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
            if len(counts) > 200_000:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts = {}
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return documents.select("text").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n_documents"))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ReadingModel:
    """Fit on the rated documents (reading_labels: doc_id, reading_level; several ratings are averaged)."""
    spark = documents.sparkSession
    ship(spark)
    rated = labels.where("doc_id is not null and reading_level between 1 and 4").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rated = cut(_texts(documents).where("trim(text) <> ''").join(rated, "doc_id"))
    fold_of = folds_of({r["source"]: r["count"] for r in rated.groupBy("source").count().collect()})  # sources of the rated sample
    rated = rated.join(F.broadcast(spark.createDataFrame(list(fold_of.items()) or [("", 0)], "source string, fold int")), "source")
    pairs = _words_of(rated, ["level", "fold"], "word string, level double, fold int")
    per = pairs.groupBy("word", "fold").agg(F.sum("level").alias("s"), F.count("*").alias("n"))
    known = cut(per.groupBy("word").agg(F.collect_list(F.struct("fold", "s", "n")).alias("f"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS))
    corpus = cut(_counted(documents.select(F.col("text").cast("string").alias("text"))))
    n_docs = max(1, documents.count())
    listed = known.join(corpus, "word", "left").select("word", "f", "n_documents").collect()  # words of the rated sample only
    total, fold, rarity = {}, [{} for _ in range(FOLDS)], {}
    for r in listed:
        total[r["word"]] = (sum(x["s"] for x in r["f"]), float(sum(x["n"] for x in r["f"])))
        rarity[r["word"]] = float(np.log(n_docs / max(1, r["n_documents"] or 1)))
        for x in r["f"]:
            fold[x["fold"]][r["word"]] = (x["s"], float(x["n"]))
    mean = rated.agg(F.avg("level")).first()[0] or 2.5
    words = Words(total, fold, rarity, float(mean), float(np.log(n_docs)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict[tuple, Features] = {}
        for b in batches:
            rows = []
            for t, f in zip(b["text"], b["fold"]):
                row = []
                for k in range(FOLDS):  # without the own fold and, to train what grades fold k, without fold k as well
                    w = tuple(sorted({f, k}))
                    if w not in of:
                        of[w] = Features(words.levels(*w), words.rarity, words.mean, words.rarest, remembered=5_000)
                    row += of[w].row(t)
                rows.append(row)
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "fold": b["fold"], "level": b["level"], "x": rows})

    got = rated.mapInPandas(run, "doc_id bigint, source string, fold int, level double, x array<double>").orderBy("doc_id").toPandas()  # at most `sample` rows
    x = np.array(got["x"].tolist(), float).reshape(len(got), FOLDS, len(FEATURES))
    y, f = got["level"].to_numpy(float), got["fold"].to_numpy()
    own = x[np.arange(len(y)), f] if len(y) else x.reshape(0, len(FEATURES))
    unseen = np.full(len(y), float(mean))
    for k in range(FOLDS):
        if (f == k).any() and (f != k).any():
            unseen[f == k] = boosted(x[f != k, k], y[f != k]).predict(own[f == k])
    graded = unseen.copy()  # calibrated by the other folds
    for k in range(FOLDS):
        if (f == k).any() and (f != k).any():
            graded[f == k] = np.interp(unseen[f == k], *isotonic(unseen[f != k], y[f != k]))
    knots = isotonic(unseen, y) if len(y) else (np.array([1.0, 4.0]), np.array([1.0, 4.0]))
    expert = y > 3.5
    cuts = np.arange(3.0, 3.9, 0.05)
    f1 = [2 * (expert & (graded >= c)).sum() / max(1, expert.sum() + (graded >= c).sum()) for c in cuts]
    best = float(cuts[np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)].mean()) if len(y) else 3.5
    rep = pd.DataFrame({"source": got["source"], "error": np.abs(graded - y), "right": (np.rint(graded) == np.rint(y)).astype(float)})
    rep = rep.groupby("source").agg(n=("error", "size"), mean_error=("error", "mean"), accuracy=("right", "mean")).reset_index()
    return ReadingModel(words, boosted(own, y) if len(y) else Ensemble(np.zeros((len(FEATURES), 1)), float(mean), 0.0, []), knots, best, rep)


def grade(documents: DataFrame, model: ReadingModel) -> DataFrame:
    """(doc_id, grade double, reading_level int, is_expert boolean) for every document, over whole texts.

    Null, empty and blank texts have null in all three. Repeated rows are graded each; ties cannot arise.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the rated sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        of = Features(m.words.levels(), m.words.rarity, m.words.mean, m.words.rarest)
        for b in batches:
            full = [bool(t and t.strip()) for t in b["text"]]
            x = np.array([of.row(t if ok else None) for t, ok in zip(b["text"], full)], float).reshape(len(b), len(FEATURES))
            g = pd.Series(m.grade(x) if len(b) else [], dtype=float).where(full)
            yield pd.DataFrame({"doc_id": b["doc_id"], "grade": g, "is_expert": (g >= m.cut).astype(object).where(g.notna(), None)})

    out = documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id bigint, grade double, is_expert boolean")
    return out.select("doc_id", "grade", F.when(F.col("grade").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(4), F.round("grade")))).cast("int").alias("reading_level"), "is_expert")
