"""Language ID by segmentation-marginalised unigrams: every language has probabilities for the
pieces of one fixed public vocabulary, and a word's probability is the sum over all its
segmentations, by the forward algorithm."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, replacing, shielded, table, write_shared
from .unigram import DEFAULT_MODEL, MARK, MEMO_ENTRIES, automaton, load_pieces

SAMPLE_DOCS, ROUNDS, LANGUAGES_AT_ONCE = 500, 2, 500
SMOOTHING, UNKNOWN_SHARE, SCALE, FLOOR = 0.05, 1e-3, 50.0, -700.0
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORDS.findall((text or "").lower())


def has_letter(word: str) -> bool:
    """Not only superscripts, fractions and the like."""
    return any(map(str.isalpha, word))


def _log_add(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


class Model:
    """Piece probabilities by language: row i of `table` is piece i, the last is an unknown
    character. Rows are scaled by a constant to the piece's length, against underflow."""

    def __init__(self, pieces: list[str], languages: list[str], table_: np.ndarray):
        self.pieces, self.languages, self.table = pieces, languages, table_

    def __getstate__(self):
        return self.pieces, self.languages, self.table

    def __setstate__(self, state):
        self.__init__(*state)
        self.automaton, self.sizes = automaton(self.pieces), list(map(len, self.pieces))
        lengths = np.array([len(p) for p in self.pieces] + [1])[:, None]
        self.lengths, self.scaled = lengths[:, 0], self.table * SCALE**lengths
        self.single = {p for p in self.pieces if len(p) == 1}
        self.codes = np.array(sorted(map(ord, self.single)), np.uint32)

    def matches(self, word: str) -> list[tuple[int, int, int]]:
        """(end, start, piece), by end."""
        found, unknown = [], len(self.pieces)
        for end, i in self.automaton.iter(word):
            found.append((end + 1, end + 1 - self.sizes[i], i))
        if not self.single.issuperset(word):
            found.extend((at + 1, at, unknown) for at, c in enumerate(word) if c not in self.single)
            found.sort()
        return found

    def log_probabilities(self, word: str) -> np.ndarray:
        """By language, for words of any length: the sums of prefixes are scaled down as they grow."""
        word, taken, done = MARK + word, 0.0, 0
        alpha = np.zeros((len(word) + 1, len(self.languages)))
        alpha[0] = 1.0
        for end, start, i in self.matches(word):
            alpha[end] += alpha[start] * self.scaled[i]
            if end - done > 40:
                done = end - 1
                top = alpha[done].max()
                if top > 0 and not 1e-80 < top < 1e80:
                    taken += math.log(top)
                    alpha[max(0, end - 17) : end + 1] /= top
        off = taken - len(word) * math.log(SCALE)
        return off + np.where(alpha[-1] > 0, np.log(np.maximum(alpha[-1], 1e-300)), FLOOR)

    def expected(self, word: str, k: int) -> list[tuple[int, float]]:
        """(piece, expected number) in a word of language k, over all segmentations; by logarithms, as
        words may have any length."""
        word = MARK + word
        matches = self.matches(word)
        shares = np.log(np.maximum(self.scaled[[i for *_, i in matches], k], 1e-300)).tolist()
        fwd, bwd = [-math.inf] * (len(word) + 1), [-math.inf] * (len(word) + 1)
        fwd[0] = bwd[-1] = 0.0
        for (end, start, _), p in zip(matches, shares, strict=True):
            fwd[end] = _log_add(fwd[end], fwd[start] + p)
        for (end, start, _), p in sorted(zip(matches, shares, strict=True), key=lambda x: -x[0][1]):
            bwd[start] = _log_add(bwd[start], bwd[end] + p)
        if fwd[-1] == -math.inf:
            return []
        return [(i, math.exp(fwd[start] + p + bwd[end] - fwd[-1])) for (end, start, i), p in zip(matches, shares, strict=True)]

    def many(self, words: list[str]) -> np.ndarray:
        """log_probabilities of many words of at most LONG_WORD letters at once: one pass of the
        automaton over all of them, then the forward sums of every word's prefixes of one length
        together."""
        marked = [MARK + w for w in words]
        joined = "\n".join(marked)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        begins = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = np.flatnonzero(~np.isin(codes, self.codes))
        odd = odd[codes[odd] != 10]
        end = np.concatenate([found[:, 0], odd])
        piece = np.concatenate([found[:, 1], np.full(len(odd), len(self.pieces))])
        length = self.lengths[piece]
        word = np.searchsorted(begins, end, "right") - 1
        stop = end + 1 - begins[word]
        order = np.lexsort((word, stop))
        word, stop, piece, start = word[order], stop[order], piece[order], (stop - length)[order]
        alpha = np.zeros((len(words), int(sizes.max()) + 1, len(self.languages)))
        alpha[:, 0] = 1.0
        steps = np.searchsorted(stop, np.arange(1, alpha.shape[1] + 1))
        for at in range(1, alpha.shape[1]):
            lo, hi = steps[at - 1], steps[at]
            if lo < hi:
                w = word[lo:hi]
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                alpha[w[first], at] = np.add.reduceat(alpha[w, start[lo:hi]] * self.scaled[piece[lo:hi]], first, axis=0)
        last = alpha[np.arange(len(words)), sizes]
        return np.where(last > 0, np.log(np.maximum(last, 1e-300)), FLOOR) - (sizes * math.log(SCALE))[:, None]


LONG_WORD, WORDS_AT_ONCE, WORDS_HELD = 64, 4_000, 150_000


class Scorer:
    """Log probabilities of whole word lists. Words get rows of a matrix, which is emptied between
    batches of texts when it has MEMO_ENTRIES."""

    def __init__(self, model: Model):
        self.model, self.matrix, self.rows = model, np.zeros((1024, len(model.languages))), {}

    def __getstate__(self):
        return self.model

    def __setstate__(self, model):
        self.__init__(model)

    def learn(self, texts: list[list[str]]) -> None:
        """Make sure that the words of these texts have rows."""
        new = set(chain.from_iterable(texts)) - self.rows.keys()
        if len(self.rows) + len(new) > MEMO_ENTRIES and self.rows:
            self.rows.clear()
            new = set(chain.from_iterable(texts))
        words = sorted(new, key=len)
        if len(self.rows) + len(words) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros((len(self.rows) + len(words), self.matrix.shape[1]))])
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            n = len(self.rows)
            short = [w for w in some if len(w) <= LONG_WORD]
            if short:
                self.matrix[n : n + len(short)] = self.model.many(short)
            for i, w in enumerate(some[len(short) :], n + len(short)):
                self.matrix[i] = self.model.log_probabilities(w)
            self.rows.update(zip(some, range(n, n + len(some)), strict=True))

    def sums(self, words: list[str]) -> np.ndarray:
        return self.matrix[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(axis=0)


def training_rows(docs: DataFrame, text: str, lang: str, key: str, held_out, sample_docs: int) -> DataFrame:
    """(lang, text) of at most sample_docs rows of each language: those with the least hash of the key,
    then of the text. Rows that are held out, or without text or lang, are never learned from."""
    usable = docs.filter(~F.coalesce(held_out, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    # hashes are even, so of n rows about four times the sample lies under `top`; only these are ranked
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").cast("double").alias("least"))
    tops = write_shared(counts.select("lang", (F.col("least") + 2.0**64 * F.least(F.lit(1.0), 4 * sample_docs / F.col("n"))).alias("top")), "language-tops")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    likely = usable.select("lang", "h").join(bounded(tops), "lang").filter(F.col("h").cast("double") <= F.col("top"))
    cuts = write_shared(likely.withColumn("nth", nth).filter(F.col("nth") <= sample_docs).groupBy("lang").agg(F.max("h").alias("cut")), "language-cuts")
    chosen = usable.join(bounded(cuts), "lang").filter(F.col("h") <= F.col("cut"))  # and all that share the last hash
    last = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    return chosen.withColumn("nth", last).filter(F.col("nth") <= sample_docs).select("lang", "text")


def _expected(shared):
    """Expected piece counts of (lang, word, n) rows under the current model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at = {lang: k for k, lang in enumerate(model.languages)}
        sums: dict = defaultdict(float)
        for batch in batches:
            for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
                k = at[lang]
                for i, share in model.expected(word, k):
                    sums[k, i] += n * share
        yield pa.record_batch({"lang": pa.array([k for k, _ in sums], pa.int32()), "piece": pa.array([i for _, i in sums], pa.int32()), "n": pa.array(list(sums.values()), pa.float64())})

    return run


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of a frame of (lang, text), written."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([words_of(t.as_py()) for t in texts], pa.list_(pa.string()))

    return write_shared(sample.select("lang", F.explode(split("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")


def languages_of(counted: DataFrame) -> list[str]:
    return sorted(r["lang"] for r in counted.select("lang").distinct().collect())


def fit(counted: DataFrame, languages: list[str], *, model_path: str = DEFAULT_MODEL, rounds: int = ROUNDS) -> Model | None:
    """Piece probabilities of these languages by expectation-maximisation over (lang, word, n); None
    without a language. The word counts stay in Spark; the driver gets a number for each piece that
    a language has."""
    if not languages:
        return None
    pieces, spark = [p for p, _ in load_pieces(model_path)], counted.sparkSession
    own = counted.join(F.broadcast(spark.createDataFrame([(x,) for x in languages], "lang string")), "lang").repartition(2 * spark.sparkContext.defaultParallelism)
    table_ = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    table_[-1] *= UNKNOWN_SHARE
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Model(pieces, languages, table_))
        counts = np.full(table_.shape, SMOOTHING)
        got = own.mapInArrow(_expected(shared), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
        table_ = counts / counts.sum(axis=0)
        table_[-1] *= UNKNOWN_SHARE
        shared.unpersist()
    return Model(pieces, languages, table_)


_OUT = pa.struct([("lang", pa.string()), ("best", pa.float64()), ("every", pa.float64())])
_OUT_DDL = "struct<lang:string,best:double,every:double>"


def _likelihoods(spark: SparkSession, model: Model):
    """The likeliest language of a text, its log likelihood, and that of all the model's languages
    together; null for texts without a letter."""
    shared = spark.sparkContext.broadcast(Scorer(model))

    @F.arrow_udf(_OUT_DDL)
    def run(texts: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        part: list[list[str]] = []
        held, scorer = 0, shared.value  # its rows last as long as a worker uses them

        def flush() -> None:
            scorer.learn(part)
            for words in part:
                if not any(map(has_letter, words)):
                    out.append(None)
                    continue
                sums = scorer.sums(words)
                best = int(sums.argmax())
                out.append({"lang": scorer.model.languages[best], "best": float(sums[best]), "every": float(sums[best] + np.log(np.exp(np.maximum(sums - sums[best], FLOOR)).sum()))})
            part.clear()

        for t in texts:
            part.append(words_of(t.as_py()))
            held += len(part[-1])
            if held > WORDS_HELD:
                flush()
                held = 0
        flush()
        return pa.array(out, _OUT)

    return run


@shielded
def predict(docs: DataFrame, models: Iterable[Model], text: str = "text") -> DataFrame:
    """docs plus lang_pred and score, the predicted language's share of the likelihood of the whole
    text (0 to 1; equal priors, and of equal languages the first by name). Texts that are null or
    have no letter are `und` with score 0, as all are without a model. Input columns of these
    names are replaced. The languages of one model after another are broadcast and compared; what
    all but the last find is written along with the documents and read again."""
    seen, first = docs.withColumn("__lang", F.lit(None).cast(_OUT_DDL)), True
    for model in models:
        seen = seen if first else write_shared(seen, "languages-so-far")
        now, last, first = F.col("__now"), F.col("__lang"), False
        met = seen.withColumn("__now", _likelihoods(docs.sparkSession, model)(F.col(text).cast("string")))
        high, low = F.greatest(last["every"], now["every"]), F.least(last["every"], now["every"])
        both = F.struct(F.when(now["best"] > last["best"], now["lang"]).otherwise(last["lang"]).alias("lang"), F.greatest(last["best"], now["best"]).alias("best"), (high + F.log1p(F.exp(low - high))).alias("every"))
        seen = met.withColumn("__lang", F.when(last.isNull(), now).otherwise(both)).drop("__now")
    found = F.col("__lang").isNotNull()
    score = F.when(found, F.exp(F.col("__lang.best") - F.col("__lang.every"))).otherwise(0.0)
    return replacing(seen, lang_pred=F.when(found, F.col("__lang.lang")).otherwise("und"), score=score).drop("__lang")


def held_out(key: str = "doc_id"):
    """Every fourth key by checksum is kept from learning."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


@shielded
def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, model_path: str = DEFAULT_MODEL, sample_docs: int = SAMPLE_DOCS, languages_at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """Fit on a sample of at most sample_docs rows for each value of `lang` and predict every row. A
    model has languages_at_once languages at most, about 260 KB each; more are learned and
    compared one model after another. Rows whose text or language is null are never learned from; texts that are null
    or have no letter are `und` with score 0. Repeated rows are predicted alike; all columns stay, but
    those named lang_pred and score, which are replaced."""
    counted = word_counts(training_rows(docs, text, lang, key, held_out(key), sample_docs))
    languages = languages_of(counted)
    parts = (languages[at : at + languages_at_once] for at in range(0, len(languages), languages_at_once))
    return predict(docs, (fit(counted, part, model_path=model_path) for part in parts), text)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, held-out ones included."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
