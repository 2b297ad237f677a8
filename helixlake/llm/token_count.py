"""Token counts under a unigram vocabulary without making tokens: Aho-Corasick enumerates the
pieces that end at each character, dynamic programming carries the best score and its number of
pieces."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import replacing, shielded, table
from .unigram import DEFAULT_MODEL, Memo, automaton, divisible, load_pieces, units

UNKNOWN_PENALTY = 10.0


class Counter:
    """Counts pieces as the tokenizer does: of equal scores the path whose last piece is longest
    wins; a character that is no piece of its own may be unknown, at the lowest score less a
    penalty. Unknown characters count as their UTF-8 bytes, or, without byte fallback, each run
    of them as one."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.state = pieces, byte_fallback
        names = [p for p, _ in pieces]
        self.lengths = [len(p) for p in names]
        self.automaton, self.scores = automaton(names), [s for _, s in pieces]
        self.single, self.bytes = {p for p in names if len(p) == 1}, byte_fallback
        self.unknown = min(self.scores) - UNKNOWN_PENALTY
        self.memo, self.divisible = Memo(self.unit), divisible(names)

    def __getstate__(self):
        return self.state

    def __setstate__(self, state):
        self.__init__(*state)

    def unit(self, text: str) -> int:
        n = len(text)
        best: list = [None] * (n + 1)  # score, pieces, whether the last is unknown
        best[0] = (0.0, 0, False)
        matches, scores, lengths, single = self.automaton.iter(text), self.scores, self.lengths, self.single
        nxt = next(matches, None)
        for end in range(1, n + 1):
            top = None
            while nxt is not None and nxt[0] == end - 1:
                i = nxt[1]
                before = best[end - lengths[i]]
                score = before[0] + scores[i]
                if top is None or score > top[0]:
                    top = (score, before[1] + 1, False)
                nxt = next(matches, None)
            char = text[end - 1]
            if char not in single:
                before = best[end - 1]
                score = before[0] + self.unknown
                if top is None or score > top[0]:
                    more = len(char.encode("utf-8", "surrogatepass")) if self.bytes else not before[2]
                    top = (score, before[1] + more, True)
            best[end] = top
        return best[n][1]

    def count(self, text: str | None) -> int:
        parts = units(text or "")
        return sum(map(self.memo.__getitem__, parts)) if self.divisible else self.unit("".join(parts)) if parts else 0


@shielded
def count_tokens(docs: DataFrame, text: str = "text", *, model: str = DEFAULT_MODEL, pieces: list[tuple[str, float]] | None = None, byte_fallback: bool = True, name: str = "n_tokens") -> DataFrame:
    """docs plus the number of pieces of the whole text. Spaces become marks and one is put before
    the text; nothing else is normalised. Null and empty texts have 0. An input column of that
    name is replaced. The vocabulary (`pieces`, or those of the model file, which only the driver
    reads) has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(Counter(pieces or load_pieces(model), byte_fallback))

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        counter = shared.value  # and its memo, which last as long as a worker uses them
        return pa.array([counter.count(t.as_py()) for t in texts], pa.int64())

    return replacing(docs.withColumn("__tokens", run(F.col(text).cast("string"))), **{name: F.col("__tokens")}).drop("__tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of unigram pieces of every whole text."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")
