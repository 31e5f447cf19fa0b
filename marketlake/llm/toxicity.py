"""Toxic documents by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel of two words sums, over all sequences of three symbols that both contain in order, the products of
``DECAY ** span`` of their occurrences; a span may hold up to ``SPAN - 2`` inserted characters, so that gapped and padded
spellings stay close to the plain one. The ends of a word are symbols too. Symbols are letters without case; marks inside a
word are left out, single letters set apart by blanks are read as one word.

Training sees labels of documents only, so each toxic document names witnesses: the words that speak most for the label.
Witnesses against words of clean documents train the machine on Nyström features (kernel values with landmark words, times
the inverse root of the landmarks' own kernel matrix). It then names witnesses and the most misleading clean words itself and
is trained again. As the kernel is a product of sums over symbol triples, the trained machine folds into one table with a
weight for each triple, of fixed size, and a word's value is a sum of table entries. A document's score is a logistic
function of the values of its three foremost words and the number of its words, fitted also to toxic documents as if only their
foremost word spoke for the label: more insults in the labelled documents do not make a single one harmless.

Only the fit is done on a bounded sample: at most ``MOST_LABELLED`` labelled rows, the first by a hash of the id. Every whole
text is scored.

Defined cases: null and empty texts have no words and the score that this gives (near the least); rows whose label is null
are not learnt from; without both kinds of labels every score is 0. Rows that repeat are scored alike. Other columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlake.llm.common import held_out, release, stored, text_or_empty

__all__ = ["MOST_LABELLED", "Model", "drop_toxic", "fit", "scores"]

#: Labelled rows that the fit uses at most.
MOST_LABELLED = 20_000
#: Landmarks, witness words and clean words that the machine is fitted on at most.
LANDMARKS, WITNESSES, CLEAN_WORDS = 384, 2_000, 8_000
DECAY, SPAN = 0.6, 4
#: Ridge of the machine, per clean word.
RIDGE = 1e-4
#: Words that a toxic document names as witnesses at first.
NAMED = 3
#: A witness is in so many times the share of toxic documents as of clean ones, at least.
LIFT = 4
#: One toxic document in so many is also learnt from as if it had one insult.
ALONE = 8
#: The two steps of each triple of symbols.
STEPS = [(j, k) for j in range(1, SPAN) for k in range(1, SPAN) if j + k <= SPAN]
#: Symbols, and the code of what separates words; codes 1 to 26 are a to z, 27 to 58 other letters, 59 is a digit.
SYMBOLS, LEFT_OUT = 64, 255
#: Characters that are worked on at once; a run of so many without a blank is read as several words.
SLICE = 120_000
#: Value of a word that a document lacks.
ABSENT = -3.0

_WORD_END = re.compile(r"\s(?=\S\S)")


def _code_table() -> np.ndarray:
    table = np.full(0x3000, LEFT_OUT, np.uint8)
    for point in range(0x3000):
        c = chr(point).lower()[0]
        if c.isspace():
            table[point] = 0
        elif "a" <= c <= "z":
            table[point] = ord(c) - 96
        elif c.isdigit():
            table[point] = 59
        elif c.isalpha():
            table[point] = 27 + ord(c) % 32
    return table


def _symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text of each word): words of all texts in one array, a 0 before each word and at the end."""
    points = np.frombuffer("\n".join(t.replace("\n", " ") for t in texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    codes = np.where(points < 0x3000, table[np.minimum(points, 0x2FFF)], 27 + points % 32).astype(np.uint8)
    line = np.cumsum(points == 10, dtype=np.int32) - (points == 10)
    used = codes != LEFT_OUT
    codes, line = codes[used], line[used]
    blank = codes == 0
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return np.zeros(1, np.uint8), np.empty(0, np.int32)
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    of = line[starts]
    single = ends - starts == 1
    first = np.concatenate([[True], ~(single[1:] & single[:-1] & (of[1:] == of[:-1]))])  # single letters in a row are one word
    keep = ~blank
    begins = np.zeros(len(codes) + 1, bool)
    begins[starts[first]] = True
    letters, opens = codes[keep], begins[:-1][keep]
    at = np.flatnonzero(opens) + np.arange(int(first.sum()))
    out = np.zeros(len(letters) + int(first.sum()) + 1, np.uint8)
    filled = np.ones(len(out), bool)
    filled[at], filled[-1] = False, False
    out[filled] = letters
    return out, of[first]


def _slices(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The texts in slices of bounded size: (text of each part, parts). Long texts are cut at blanks behind words."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            end = min(len(text), start + SLICE)
            if end < len(text):
                found = _WORD_END.search(text[start:end][::-1])
                end = end - found.start() if found else end
            owners.append(i), parts.append(text[start:end])
            held += end - start + 1
            if held >= SLICE:
                yield np.array(owners), parts
                owners, parts, held = [], [], 0
            start = end
            if start >= len(text):
                break
    if parts:
        yield np.array(owners), parts


def _occurrences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of steps: starts of the triples that lie within a word, their numbers, their weight."""
    zeros = np.cumsum(codes == 0, dtype=np.int32)
    wide = codes.astype(np.int32)
    n = len(codes)
    for j, k in STEPS:
        if n <= j + k:
            continue
        inside = np.flatnonzero(zeros[j + k - 1 : n - 1] == zeros[: n - j - k])
        yield inside, (wide[inside] * SYMBOLS + wide[inside + j]) * SYMBOLS + wide[inside + j + k], DECAY ** (j + k)


def _norms(longest: int) -> np.ndarray:
    """The root of the summed squared weights of a word's triples, by its length, as if none occurred twice."""
    n = np.arange(longest + 1) + 2.0
    total = sum(np.maximum(n - j - k, 0) * DECAY ** (2 * (j + k)) for j, k in STEPS)
    return np.sqrt(np.maximum(total, 1e-9))


@dataclass
class Model:
    """A weight per triple, the machine's offset, and the logistic function over the foremost words."""

    triples: np.ndarray
    offset: float
    logistic: np.ndarray | None

    def words(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values of all words, text of each word, symbols)."""
        codes, of = _symbols(texts, table)
        if not len(of):
            return np.empty(0), of, codes
        sums = np.zeros(len(codes) + 1)
        for at, number, weight in _occurrences(codes):
            sums[at] += weight * self.triples[number]
        sums = np.concatenate([[0.0], np.cumsum(sums)])
        bounds = np.flatnonzero(codes == 0)
        length = np.diff(bounds) - 1
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / _norms(int(length.max()))[length] + self.offset, of, codes

    def foremost(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        """Value of the foremost word, of the next two as far as they speak for the label, and the logarithm of the number of words."""
        best = np.full((len(texts), 3), -np.inf)
        count = np.zeros(len(texts), np.int64)
        for owners, parts in _slices(texts):
            values, of, _ = self.words(parts, table)
            of = owners[of]
            count += np.bincount(of, minlength=len(texts))
            for _ in range(3):
                if not len(values):
                    break
                top = np.full(len(texts), -np.inf)
                np.maximum.at(top, of, values)
                best = -np.sort(-np.column_stack([best, top]), axis=1)[:, :3]
                hit = np.flatnonzero(values == top[of])
                _, one = np.unique(of[hit], return_index=True)
                values[hit[one]] = -np.inf
        out = np.where(np.isfinite(best), best, ABSENT)
        np.maximum(out[:, 1:], 0, out=out[:, 1:])
        return np.column_stack([out, np.log1p(count)])

    def score(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(texts))
        return _sigmoid(self.foremost(texts, table) @ self.logistic[1:] + self.logistic[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    for _ in range(60):
        p = _sigmoid(a @ b)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b)), a.T @ (y - p) - ridge * b)
        b += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return b


def _joined(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)


def _machine(positive: list[bytes], votes: np.ndarray, negative: list[bytes]) -> tuple[np.ndarray, float]:
    """Triple weights and offset of the support vector machine of these words (symbol strings)."""
    landmarks = positive[: LANDMARKS // 2] + negative[: LANDMARKS - min(len(positive), LANDMARKS // 2)]
    m = len(landmarks)
    numbers, weights, owners = [], [], []
    codes = _joined(landmarks)
    word_at = np.cumsum(codes == 0) - 1
    norms = _norms(max(map(len, positive + negative)))
    for at, number, weight in _occurrences(codes):
        numbers.append(number), owners.append(word_at[at]), weights.append(np.full(len(at), weight))
    number, owner, weight = map(np.concatenate, (numbers, owners, weights))
    known, place = np.unique(number, return_inverse=True)
    phi = np.zeros((len(known) + 1, m), np.float32)
    np.add.at(phi, (place, owner), weight / norms[[len(landmarks[o]) for o in owner]])
    where = np.full(SYMBOLS**3, len(known), np.int32)
    where[known] = np.arange(len(known))

    def kernel(words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), m), np.float32)
        for start in range(0, len(words), 2000):
            part = words[start : start + 2000]
            codes = _joined(part)
            word_at = np.cumsum(codes == 0) - 1
            for at, number, weight in _occurrences(codes):
                hit = where[number] < len(known)
                if hit.any():
                    word, first = np.unique(word_at[at[hit]], return_index=True)
                    out[word + start] += weight * np.add.reduceat(phi[where[number[hit]]], first)
            out[start : start + len(part)] /= norms[[len(w) for w in part]][:, None]
        return out

    own = kernel(landmarks).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    use = values > 1e-4 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])  # the inverse root, on the eigenvectors that count
    x = np.vstack([kernel(positive), kernel(negative)]) @ root
    x = np.column_stack([x, np.ones(len(x))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.concatenate([np.sqrt(votes) * len(negative) / np.sqrt(votes).sum(), np.ones(len(negative))])
    ridge = np.full(x.shape[1], RIDGE * len(negative))
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(15):  # Newton steps of the squared hinge loss: the rows inside the margin are the support vectors
        inside = y * (x @ beta) < 1
        xs, cs = x[inside], cost[inside]
        new = np.linalg.solve((xs * cs[:, None]).T @ xs + np.diag(ridge), xs.T @ (cs * y[inside]))
        if np.abs(new - beta).max() < 1e-4:
            break
        beta = new
    triples = np.zeros(SYMBOLS**3, np.float32)
    triples[known] = phi[:-1] @ (root @ beta[:-1])
    return triples, float(beta[-1])


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """(n, text, toxic): at most ``most`` labelled rows that are not held out, one per text."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("text")).join(chosen, "_id")
    return stored(rows.groupBy(F.sha2("text", 256).alias("n")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))


def _distinct_words(sample: DataFrame) -> DataFrame:
    """(n, toxic, word): each word of each sampled text once, as a symbol string."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _code_table()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                n, texts, toxic = (c.to_pylist() for c in batch.slice(start, 256).columns)
                for i, text in enumerate(texts):
                    words = sorted(set(_symbols([text], table)[0].tobytes().split(b"\0")) - {b""})
                    yield pa.RecordBatch.from_arrays([pa.array([n[i]] * len(words)), pa.array([toxic[i]] * len(words), pa.int32()), pa.array(words, pa.binary())], names=["n", "toxic", "word"])

    return sample.select("n", "text", "toxic").mapInArrow(over, "n string, toxic int, word binary")


def _leaders(sample: DataFrame, model: Model) -> DataFrame:
    """(toxic, word, value): the foremost word of each sampled text."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _code_table()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                texts, toxic = (c.to_pylist() for c in batch.slice(start, 256).columns)
                best: dict[int, tuple[float, bytes]] = {}
                for owners, parts in _slices(texts):
                    values, of, codes = model.words(parts, table)
                    words = codes.tobytes().split(b"\0")[1:-1] if len(of) else []
                    order = np.lexsort((-values, of))
                    for i in order[np.unique(of[order], return_index=True)[1]]:
                        owner = int(owners[of[i]])
                        if owner not in best or values[i] > best[owner][0]:
                            best[owner] = float(values[i]), words[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic[i] for i in best], pa.int32()), pa.array([w for _, w in best.values()], pa.binary()), pa.array([v for v, _ in best.values()], pa.float64())],
                    names=["toxic", "word", "value"],
                )

    return sample.select("text", "toxic").mapInArrow(over, "toxic int, word binary, value double")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_labelled: int = MOST_LABELLED) -> Model:
    """The machine that these labels teach. What reaches the driver is bounded by the constants above, whatever the input."""
    sample = _sample(docs, labels, doc_id, text, label, most_labelled)
    counts = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    nothing = Model(np.zeros(SYMBOLS**3, np.float32), 0.0, None)
    if len(counts) < 2:
        return nothing
    words = _distinct_words(sample)
    stats = stored(words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    # counts are weighed by the sizes of both kinds, as a few wrong labels put true witnesses into clean documents
    share = min(1.0, counts[True] / counts[False])
    speaks = F.struct((F.col("t") - LIFT * share * F.col("c")).alias("for"), F.xxhash64("word").alias("tie"), "word")
    foremost = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("best")))
    named = words.filter("toxic = 1").join(stats, "word").select("n", speaks.alias("best")).withColumn("rank", foremost)
    witness = named.filter((F.col("best.for") > 0) & (F.col("rank") <= NAMED)).groupBy("best.word").agg(F.count("*").alias("votes"), F.max("best.for").alias("t"))
    rows = witness.orderBy(F.desc("votes"), "word").limit(WITNESSES).collect()
    common = max([1, *(r["t"] for r in rows)])
    rows = [r for r in rows if r["t"] >= min(3, common)] or rows
    clean = [bytes(r["word"]) for r in stats.filter("t = 0 or c > 0").orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS).collect()]
    if not rows or not clean:
        return nothing
    positive, votes = [bytes(r["word"]) for r in rows], np.array([r["votes"] for r in rows], float)
    named_by_count = {w: v for w, v in zip(positive, votes) if v > 1}
    model = Model(*_machine(positive, votes, clean), None)
    for _ in range(2):
        led = _leaders(sample, model)
        again = led.filter("toxic = 1 and value > 0").groupBy("word").agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "word").limit(WITNESSES).collect()
        misled = led.filter("toxic = 0").groupBy("word").agg(F.max("value").alias("value"), F.count("*").alias("votes")).orderBy(F.desc("value"), "word").limit(WITNESSES).collect()
        # a word that leads many more toxic documents than clean ones is a witness whose clean documents are wrongly labelled
        leads = {bytes(r["word"]): r["votes"] for r in again}
        hard = [w for r in misled if leads.get(w := bytes(r["word"]), 0) <= LIFT * share * r["votes"]]
        seen = set(hard)
        pos = {w: v for w, v in named_by_count.items() if w not in seen}
        for r in again:
            if bytes(r["word"]) not in seen:
                pos[bytes(r["word"])] = pos.get(bytes(r["word"]), 0) + r["votes"]
        if not pos:
            break
        positive = sorted(pos, key=lambda w: (-pos[w], w))
        votes = np.array([pos[w] for w in positive], float)
        model = Model(*_machine(positive, votes, hard + [w for w in clean if w not in seen]), None)

    def values(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.foremost(texts.tolist(), _code_table()).astype(float)))

    seen = sample.select("toxic", F.pandas_udf(values, "array<double>")("text").alias("x")).collect()
    x, y = np.array([r["x"] for r in seen], float), np.array([r["toxic"] for r in seen], float)
    # a toxic document stays one with a single insult left: of some, the foremost word alone is learnt from too
    alone = x[y == 1][::ALONE] * [1, 0, 0, 1]
    model.logistic = _logistic(np.vstack([x, alone]), np.concatenate([y, np.ones(len(alone))]))
    return model


def scores(text: Column, model: Model) -> Column:
    """The score of a text column's texts, 0 to 1."""

    def over(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _code_table()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series(model.score(texts, table), dtype=float)
            release()

    over.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(over, "double")(text)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` less the rows whose score reaches the threshold, with all their columns."""
    rows = docs.select(F.struct("*").alias("_row"), scores(text_or_empty(text), model).alias("_score"))
    return rows.filter(F.col("_score") < threshold).select("_row.*")
