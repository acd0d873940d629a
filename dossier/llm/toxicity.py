"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Voters are lexicons and patterns. Some lexicons are fixed; the others are learned from labelled rows, words and word
starts that toxic documents have and clean ones haven't, dealt out to several voters. The label model knows nothing but
the votes: EM over counts of vote patterns estimates how often each voter speaks on toxic and on clean documents, and
correlated voters share their weight. A label, where a training row has one, is one more voter of given accuracy. A
logistic regression on how strongly each voter speaks is fitted to the posteriors of all documents by Newton steps, each
an aggregation in Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.storage import broadcast_if_small, materialize, read_table

THRESHOLD = 0.7
#: Lexicons are learned from at most so many labelled documents, those of the smallest hash of their id.
FIT_DOCUMENTS = 200_000
#: A learned word has so many toxic documents at least, in so many different contexts; the lower end of Wilson's interval
#: of its toxic share is so high at least. Documents count no more than contexts (of CONTEXTS classes of the word before),
#: so that a passage copied many times teaches nothing.
LEAST_DOCUMENTS, LEAST_CONTEXTS, LEAST_SHARE, WILSON_Z, CONTEXTS = 3, 4, 0.5, 1.64, 64
#: Learned words kept, those of the most toxic documents: the size of the model that is sent to every task.
LEXICON_WORDS = 20_000
#: Letters of the word starts that are learned beside whole words.
STARTS = (4, 5, 6, 7)
#: Voters that learned words and starts are dealt to: those of a surer share to as many, all others to one more.
WORD_VOTERS, START_VOTERS, SURE_SHARE = 3, 2, 0.95
#: Accuracy of a label as a voter, and how much more a row with one counts when accuracies are estimated.
LABEL_ACCURACY, LABEL_WEIGHT = 0.999, 10.0
ROUNDS, RIDGE, NEWTON_STEPS = 60, 1e-4, 15
#: Bytes of a text that are cut into words at a time.
BYTES_AT_ONCE = 1 << 20

# English words of abuse, by what they deny.
MIND = "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles fool fools halfwit dimwit cretin clown clowns brainless"
WORTH = "loser losers pathetic worthless useless scum trash garbage filth filthy vermin lowlife nobody waste"
DISGUST = "disgusting repulsive revolting vile gross ugly pig pigs creep freak jerk bastard bastards hate hated"
FIXED = tuple(frozenset(x.split()) for x in (MIND, WORTH, DISGUST))
# Wishes of harm, and abuse by direct address.
THREAT = re.compile(rb"\b(?:kill|hurt|shoot|stab|hang) (?:you|yourself|him|her|them)\b|\b(?:go|should) die\b|\bshut (?:the \w+ )?up\b", re.I)
ADDRESS = re.compile(rb"\b(?:you|you're|your|he is|she is|they are) (?:\w+ ){0,3}(?:idiots?|morons?|stupid|losers?|scum|trash|clowns?|pathetic|worthless|disgusting)\b", re.I)
PATTERNS = (THREAT, ADDRESS)
_WORD = re.compile(r"[^\W_]+")


def training(doc_id: Column) -> Column:
    """False where crc32 of the id as text leaves 1 divided by 3; true for a null id, which has no label anyway."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def one_label(labels: DataFrame) -> DataFrame:
    """Rows (id, label) of the training rows: 1 if any row calls the document toxic; null ids and labels are left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & training(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("label"))


def parts_of(text: str | None) -> Iterator[list[str]]:
    """The lower-cased words of ``text``, some at a time; no word is cut."""
    text, at = text or "", 0
    while at < len(text):
        end = at + BYTES_AT_ONCE
        while end < len(text) and (text[end].isalnum() and text[end - 1].isalnum()):
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


def word_counts(text: str | None) -> Counter[str]:
    found: Counter[str] = Counter()
    for words in parts_of(text):
        found.update(words)
    return found


def _tokens(word: str) -> list[str]:
    """A word and its starts, each with a mark in front that tells how long it is."""
    return ["w" + word, *(f"{n}{word[:n]}" for n in STARTS if len(word) > n)]


def _counted(known: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """Rows (token, n, contexts) of the rows (text): documents that hold a token, and bits for the words before it."""
    sent = known.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, counts, bits = sent.value, Counter(), Counter()

        def flush() -> pa.RecordBatch:
            tokens = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([counts[t] for t in tokens], pa.int64()), pa.array([bits[t] - (1 << 64) if bits[t] >> 63 else bits[t] for t in tokens], pa.int64())], names=["token", "n", "contexts"])
            counts.clear()
            bits.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                here: set[str] = set()
                for words in parts_of(text.as_py()):
                    before = ""
                    for word in words:
                        for token in _tokens(word):
                            if only is None:
                                here.add(token)
                                bits[token] |= 1 << crc32(before.encode()) % CONTEXTS
                            elif token in only:
                                here.add(token)
                        before = word
                counts.update(here)
                if len(counts) > 200_000:
                    yield flush()
        if counts:
            yield flush()

    found = known.select("text").mapInArrow(run, "token string, n long, contexts long")
    return found.groupBy("token").agg(F.sum("n").alias("n"), F.bit_or("contexts").alias("contexts"))


def learned_words(known: DataFrame) -> list[tuple[str, float]]:
    """Tokens of toxic documents that clean ones lack with their toxic share, the most frequent first, of the rows (text,
    label) of ``known``.

    Only tokens that enough toxic documents have are counted in clean ones.
    """
    toxic = _counted(known.filter("label = 1"), None).filter((F.col("n") >= LEAST_DOCUMENTS) & (F.bit_count("contexts") >= LEAST_CONTEXTS))
    # frequent words of any text come first here; ten times what is kept leaves room for them
    met = F.bit_count("contexts")
    several = F.when(met > CONTEXTS - 4, F.col("n")).otherwise(F.least("n", F.round(-CONTEXTS * F.log1p(-met / CONTEXTS)).cast("long")))
    often = dict(map(tuple, toxic.select("token", several.alias("n")).orderBy(F.desc("n"), "token").limit(10 * LEXICON_WORDS).collect()))
    if not often:
        return []
    clean = dict(map(tuple, _counted(known.filter("label = 0"), frozenset(often)).select("token", "n").collect()))
    good = [(t, n / (n + clean.get(t, 0))) for t, n in often.items() if wilson(n, n + clean.get(t, 0)) >= LEAST_SHARE]
    return sorted(good, key=lambda x: (-often[x[0]], x[0]))[:LEXICON_WORDS]


def wilson(hits: int, n: int) -> float:
    """The lower end of Wilson's interval."""
    z2, p = WILSON_Z**2, hits / n
    return (p + z2 / (2 * n) - WILSON_Z * ((p * (1 - p) + z2 / (4 * n)) / n) ** 0.5) / (1 + z2 / n)


@dataclass(frozen=True)
class Voters:
    """Each voter says how often it is met in a text; a vote is whether it is met at all."""

    words: dict[str, list[int]]
    count: int

    @classmethod
    def of(cls, learned: list[tuple[str, float]]) -> Voters:
        words: dict[str, list[int]] = {}
        for voter, lexicon in enumerate(FIXED):
            for w in lexicon:
                words.setdefault("w" + w, []).append(voter)
        first = len(FIXED) + len(PATTERNS)
        for token, share in learned:
            begin, n = (first, WORD_VOTERS) if token[0] == "w" else (first + WORD_VOTERS + 1, START_VOTERS)
            words.setdefault(token, []).append(begin + (crc32(token.encode()) % n if share >= SURE_SHARE else n))
        return cls(words, first + WORD_VOTERS + START_VOTERS + 2)

    def hits(self, text: str | None) -> tuple[list[int], int]:
        """How often each voter is met, and the number of words."""
        found, n = [0] * self.count, 0
        for word, times in word_counts(text).items():
            n += times
            for token in _tokens(word):
                for voter in self.words.get(token, ()):
                    found[voter] += times
        raw = (text or "").encode("utf-8", "surrogatepass")
        for i, pattern in enumerate(PATTERNS):
            found[len(FIXED) + i] = sum(1 for _ in pattern.finditer(raw))
        return found, n


def logit(p: np.ndarray | float) -> np.ndarray | float:
    return np.log(p / (1 - p))


@dataclass(frozen=True)
class LabelModel:
    """For each voter the accuracy of its votes, last that of silence as a vote for clean, their shares of weight, and the
    toxic prior. A voter that is silent while others speak says nothing."""

    accuracy: np.ndarray
    weight: np.ndarray
    prior: float

    def log_odds(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """Of toxic, for rows of 0/1 ``votes`` and labels ``gold`` (1, 0, or -1 for none)."""
        base = logit(self.prior)
        toxic = (logit(self.accuracy[:-1]) - base) * self.weight
        clean = -logit(self.accuracy[-1]) - base
        said = logit(LABEL_ACCURACY) * np.select([gold == 1, gold == 0], [1.0, -1.0], 0.0)
        return base + votes @ toxic + (votes.sum(axis=1) == 0) * clean + said

    def posterior(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes, gold), -500, 500)))


def fit_labels(votes: np.ndarray, gold: np.ndarray, counts: np.ndarray) -> LabelModel:
    """EM over distinct vote patterns (rows of ``votes`` and ``gold``) with their ``counts``.

    Accuracies are smoothed towards those that voters are thought to have before anything is seen. A voter's weight is one
    over one plus its correlations with the others within the classes, so voters that say the same count once.
    """
    m = votes.shape[1]
    spoken = np.column_stack([votes, votes.sum(axis=1) == 0])
    counts = counts * np.where(gold >= 0, LABEL_WEIGHT, 1.0)
    guess = np.array([*[0.8] * m, 0.95])
    model = LabelModel(guess, np.ones(m), 0.1)
    for _ in range(ROUNDS):
        p = model.posterior(votes, gold)
        right = np.column_stack([p[:, None] * votes, (1 - p) * spoken[:, -1]])
        accuracy = (counts @ right + guess * 4) / (counts @ spoken + 4)
        prior = float(np.clip((p @ counts + 1) / (counts.sum() + 10), 1e-4, 0.5))
        together = np.zeros((m, m))
        for share in (p, 1 - p):
            w = share * counts
            if w.sum() > 0:
                y = votes - w @ votes / w.sum()
                cov = (y * w[:, None]).T @ y / w.sum()
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                together += np.maximum(cov / np.outer(sd, sd), 0) / 2
        weight = 1 / (1 + together.sum(axis=1) - np.diag(together))
        new = LabelModel(np.clip(accuracy, prior, 0.999), weight, prior)  # no voter speaks for clean documents
        moved = max(np.abs(new.accuracy - model.accuracy).max(), abs(new.prior - model.prior))
        model = new
        if moved < 1e-7:
            break
    return model


def features(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of an intercept, each voter's strength, all of them together by themselves and by the length of the text."""
    own = np.log1p(hits)
    every = hits.sum(axis=1)
    return np.column_stack([np.ones(len(hits)), own, np.log1p(every), np.log1p(200 * every / (n + 20)), np.log1p(n) / 10])


def _batch(hits: pa.Array, n: pa.Array, voters: int) -> tuple[np.ndarray, np.ndarray]:
    return hits.flatten().to_numpy(zero_copy_only=False).reshape(len(n), voters).astype(float), n.to_numpy().astype(float)


def fit_linear(measured: DataFrame, voters: int, labels: LabelModel) -> np.ndarray:
    """Weights of a logistic regression on the posteriors of all rows (hits, n, gold) of ``measured``.

    Each Newton step is one aggregation of gradients and curvatures.
    """
    d = voters + 4

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    hits, n = _batch(batch.column(0), batch.column(1), voters)
                    x, p = features(hits, n), labels.posterior((hits > 0).astype(float), batch.column(2).to_numpy())
                    q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
                    parts = []
                    for target, share in ((1.0, p), (0.0, 1 - p)):
                        curve = (x * (share * q * (1 - q))[:, None]).T @ x
                        parts += [share.sum(), x.T @ (share * (q - target)), curve.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.ravel(v) for v in parts])], pa.list_(pa.float64()))], names=["s"])

        added = measured.select("hits", "n", "gold").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        found = dict(map(tuple, added.collect()))  # 2 * (1 + d + d * d) numbers
        return np.array([found[i] for i in range(len(found))]).reshape(2, -1) if found else np.zeros((2, 1 + d + d * d))

    w = np.zeros(d)
    ridge = np.diag([1e-6, *[RIDGE] * (d - 1)])
    for _ in range(NEWTON_STEPS):
        both = sums(w)
        gradient, curve = ridge @ w, ridge.copy()
        for row in both:
            gradient += row[1 : 1 + d] / max(both[:, 0].sum(), 1.0)
            curve += row[1 + d :].reshape(d, d) / max(both[:, 0].sum(), 1.0)
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of every row of ``docs``, repeated rows included.

    Null and empty texts are scored as texts without words. Without labels the fixed lexicons and patterns vote alone. A
    null id is no training row. Columns other than id and text are not read; an empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    said = materialize(one_label(labels), "labels")
    sample = materialize(said.orderBy(F.xxhash64("id"), "id").limit(FIT_DOCUMENTS), "sample") if said.count() > FIT_DOCUMENTS else said
    known = plain.join(broadcast_if_small(sample), F.col("doc_id") == F.col("id")).select("text", "label")
    voters = Voters.of(learned_words(known))
    measured = materialize(_measured(plain, voters), "hits")
    gold = measured.join(broadcast_if_small(said), F.col("doc_id") == F.col("id"), "left").select("doc_id", "hits", "n", F.coalesce("label", F.lit(-1)).alias("gold"))
    gold = materialize(gold, "gold")
    bits = F.aggregate(F.transform("hits", lambda h, i: F.when(h > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(F.lit(0))), F.lit(0), lambda a, b: a + b)
    patterns = gold.groupBy(bits.alias("votes"), "gold").count().collect()  # 2 to the number of voters, times 3, at most
    votes = np.array([[r["votes"] >> i & 1 for i in range(voters.count)] for r in patterns], float).reshape(-1, voters.count)
    model = fit_labels(votes, np.array([r["gold"] for r in patterns]), np.array([r["count"] for r in patterns], float))
    w = fit_linear(gold, voters.count, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, n = _batch(batch.column(1), batch.column(2), voters.count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(features(hits, n) @ w, -500, 500))), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = measured.select("doc_id", "hits", "n").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (~training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _measured(plain: DataFrame, voters: Voters) -> DataFrame:
    """Rows (doc_id, hits, n) of the rows (doc_id, text)."""
    sent = plain.sparkSession.sparkContext.broadcast(voters)  # LEXICON_WORDS at most
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = sent.value
        for batch in batches:
            found = [voters.hits(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "hits", "n"])

    return plain.mapInArrow(run, f"doc_id {kind}, hits array<long>, n long")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
