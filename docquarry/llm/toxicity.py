"""Toxic documents: a subsequence string kernel, Nyström landmarks, a linear support vector machine."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.quality import fold, labelled_sample
from docquarry.llm.store import rows_of, stored
from docquarry.llm.tokens import text_batches

ORDER, DECAY = 4, 0.75  # letters of a common subsequence; weight of each letter it spans
LANDMARKS, LONGEST = 64, 8
STEM_LENGTHS = (4, 5, 6, 7, 8)
WORD, OVERLAP = 24, 12  # longer words are windows of 24 letters
FILLER = "x"  # inserted between letters in the gapped examples of the fit
START = "^"  # stands before every word, so that its beginning is a letter too
NOT_LETTERS = re.compile(r"[\W_]+")
WORDS_KEPT = 400_000  # that a task remembers
#: Labelled documents the model is fitted on, at most; candidates for landmarks.
LABELLED_ROWS, CANDIDATES = 20_000, 3_000
SPELLED = 3  # words of one letter in a row that are one word
SENTENCE_END = (".", "!", "?")


def _letters(words: list[str], width: int) -> np.ndarray:
    data = "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32).reshape(len(words), width)


def subsequence_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of the rows of two letter tables (0: no letter): for each common
    subsequence of ``order`` letters, ``decay`` to the power of all letters spanned in both."""
    n, width, other = len(a), a.shape[1], b.shape[1]
    match = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)
    prefix = np.ones((n, width + 1, other + 1), np.float32)
    square = np.float32(decay * decay)
    for p in range(1, order + 1):
        hit = np.where(match, square * prefix[:, :-1, :-1], np.float32(0))
        if p == order:
            return hit.sum((1, 2))
        rows = np.zeros((n, width + 1, other + 1), np.float32)
        for j in range(other):
            rows[:, 1:, j + 1] = decay * rows[:, 1:, j] + hit[:, :, j]
        prefix = np.zeros_like(rows)
        for i in range(width):
            prefix[:, i + 1] = decay * prefix[:, i] + rows[:, i + 1]
    return np.ones(n, np.float32)


class Landmarks:
    """Short strings, and the kernel of words against them; a landmark found whole gives 1 or more."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.table = _letters(strings, LONGEST)
        self.own = subsequence_kernel(self.table, self.table)
        self.places = np.zeros((len(strings), 256), np.uint8)  # of each letter in each landmark, as bits
        for row, codes in zip(self.places, self._codes(self.table)):
            for place, code in enumerate(codes[codes > 0]):
                row[code] |= 1 << place
        self.sizes = [min(len(x), LONGEST) for x in strings]

    @staticmethod
    def _codes(table: np.ndarray) -> np.ndarray:
        return np.where(table > 0, table % np.uint32(251) + np.uint32(1), 0).astype(np.uint8)

    def _close(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and landmarks with all but one of the landmark's letters, four at least, in common in
        this order: the longest common subsequence, one bit per letter of the landmark."""
        codes = np.ascontiguousarray(self._codes(table).T)
        rows, columns = [], []
        for k, (places, size) in enumerate(zip(self.places, self.sizes)):
            state = np.full(codes.shape[1], 255, np.uint8)
            for hit in places[codes]:
                both = state & hit
                state = (state + both) | (state - both)
            common = size - np.bitwise_count(state & np.uint8((1 << size) - 1)).astype(int)
            found = np.flatnonzero(common >= max(ORDER, size - 1))
            rows.append(found)
            columns.append(np.full(len(found), k))
        return np.concatenate(rows), np.concatenate(columns)

    def kernel(self, words: list[str]) -> np.ndarray:
        """One row per word, of its letters and digits only, one column per landmark. A pair that
        does not share all but one of the landmark's letters, in order, counts as 0."""
        out = np.zeros((len(words), len(self.strings)), np.float32)
        pieces, owner = [], []
        for i, w in enumerate(words):
            w = START + (w if w.isalnum() else NOT_LETTERS.sub("", w))
            if len(w) <= WORD:
                pieces.append(w)
                owner.append(i)
            else:
                cuts = [w[start:start + WORD] for start in range(0, len(w) - OVERLAP, OVERLAP)]
                pieces += cuts
                owner += [i] * len(cuts)
        owner, lengths = np.array(owner), np.array([len(w) for w in pieces])
        order = np.argsort(lengths, kind="stable")  # words of like length share a table
        for begin in range(0, len(pieces), 4096):
            part = order[begin:begin + 4096]
            table = _letters([pieces[i] for i in part], int(lengths[part[-1]]))
            rows, columns = self._close(table)
            for at in range(0, len(rows), 2048):
                r, c = rows[at:at + 2048], columns[at:at + 2048]
                np.maximum.at(out, (owner[part[r]], c), subsequence_kernel(table[r], self.table[c]) / self.own[c])
        return np.minimum(out, 1.5)


class Reader:
    """Kernel rows of words, remembered; and of the sentences of a text."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.rows = landmarks, {}
        self.none = np.zeros(len(landmarks.strings), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > WORDS_KEPT:
            self.rows.clear()
            new = list(words)
        if new:
            table = self.landmarks.kernel(new)
            some = table.any(1)
            self.rows.update((w, row if full else None) for w, row, full in zip(new, table, some))

    def sentences(self, words: list[str]) -> np.ndarray:
        """Kernel of each sentence that has any against the landmarks: the largest of its words. Faint
        values of many words do not add up, so none needs to be cut off."""
        found = [(i, row) for i, row in enumerate(map(self.rows.get, words)) if row is not None]
        if not found:
            return self.none[None]
        out, last = [], -1
        for i, row in found:
            if out and not any(w.endswith(SENTENCE_END) for w in words[last:i]):
                out[-1] = np.maximum(out[-1], row)
            else:
                out.append(row)
            last = i
        return np.stack(out)


def text_words(text: str | None) -> list[str]:
    """Lower-case words between white space; three or more words of one letter in a row are one word."""
    words = text.lower().split() if text else []
    single = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if not (single[2:] & single[1:-1] & single[:-2]).any():
        return words
    out: list[str] = []
    for single, run in groupby(words, lambda w: len(w) == 1):
        run = list(run)
        out += ["".join(run)] if single and len(run) >= SPELLED else run
    return out


def gapped(word: str) -> list[str]:
    """The word with one letter inserted in its middle, and with one between all its letters."""
    half = (len(word) + 1) // 2
    return [word[:half] + FILLER + word[half:], FILLER.join(word)]


@dataclass
class ToxicityModel:
    landmarks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, kernel: np.ndarray) -> np.ndarray:
        return kernel @ self.whiten @ self.weights + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def choose_landmarks(documents: DataFrame, chosen: DataFrame, count: int = LANDMARKS, candidates: int = CANDIDATES) -> list[str]:
    """Letter runs that mark toxic documents of the labelled sample, the strongest first, none within
    another or close to it by the kernel."""
    letters = F.split(F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}]+", " "), " ")
    found = rows_of(documents, chosen.select("doc_id"), "doc_id").join(F.broadcast(chosen), "doc_id")
    words = found.select("doc_id", "label", F.explode(F.array_distinct(letters)).alias("word")).filter("word <> ''").withColumn("word", F.concat(F.lit(START), "word"))
    counts = words.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    runs = [F.expr(f"CASE WHEN length(word) >= {n} THEN transform(sequence(1, length(word) - {n - 1}), i -> substring(word, i, {n})) ELSE array() END") for n in STEM_LENGTHS]
    stems = counts.select("toxic", "clean", F.explode(F.array_distinct(F.concat(*runs))).alias("stem"))
    stems = stems.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic >= 5 AND toxic > 3 * clean")
    strength = F.col("toxic") * F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    best = stems.orderBy(F.desc(strength), F.desc(F.length("stem")), "stem").limit(candidates).collect()  # bounded by `candidates`
    out: list[str] = []
    for row in best:
        stem = row["stem"]
        if len(out) < count and not any(stem in o or o in stem for o in out):
            table = _letters([stem, *out], LONGEST)
            own = subsequence_kernel(table, table)
            near = subsequence_kernel(np.repeat(table[:1], len(out), 0), table[1:]) / np.sqrt(own[0] * own[1:]) if out else own[:0]
            if not len(near) or near.max() < 0.5:
                out.append(stem)
    return out


def fit_margin(kernel: np.ndarray, own: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Nyström map from the landmarks' kernel matrix, and a support vector machine with squared hinge loss."""
    values, vectors = np.linalg.eigh(own)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
    x = np.hstack([kernel @ whiten, np.ones((len(kernel), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    ridge = np.diag([*np.full(x.shape[1] - 1, 1e-3), 0.0])
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps on the active rows end after a few rounds
        active = sign * (x @ w) < 1
        z = x[active] * share[active, None]
        new = np.linalg.solve(z.T @ x[active] + ridge + 1e-9 * np.eye(len(w)), z.T @ sign[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = 0.5 * w + 0.5 * new
    return whiten, w[:-1], float(w[-1])


def fit_scale(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 given the margin."""
    a, b = 1.0, 0.0
    smooth = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        v = weight * (p * (1 - p) + 1e-6)
        h = np.array([[(v * margin * margin).sum() + 1e-2, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, [(weight * (smooth - p) * margin).sum(), (weight * (smooth - p)).sum()])
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b


def fit_toxicity(documents: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, folds: int = 4, held_out: int = 2) -> ToxicityModel:
    """A model for ``labels(doc_id, toxic)`` from sentences of ``documents(doc_id, text)``.

    At most ``labelled_rows`` labelled documents outside the held-out fold are used; the example of each is
    its sentence most like the landmarks. Toxic ones are examples twice more, with inserted letters in the
    words that are like a landmark, so that the fit weighs such words too. NULL labels are ignored. Without documents of both labels, or
    without any distinctive run of letters, the score is the share of label 1."""
    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    chosen = labelled_sample(labels, "toxic", fold(F.col("doc_id"), folds, held_out), labelled_rows)
    rows = stored(rows_of(rows, chosen.select("doc_id"), "doc_id"))
    strings = choose_landmarks(rows, chosen)
    if not strings:
        seen = rows.select("doc_id").distinct().join(F.broadcast(chosen), "doc_id").agg(F.sum("label"), F.count("label")).first()
        share = ((seen[0] or 0) + 1) / (seen[1] + 2)
        return ToxicityModel([], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))

    def strongest(batches):
        reader = Reader(Landmarks(strings))
        for part, texts in text_batches(batches):
            split = [text_words(t) for t in texts]
            reader.learn(set().union(*split))
            labels = part.column(2).to_pylist()
            like = [{w: gapped(w) for w in words if reader.rows[w] is not None} if label else {} for words, label in zip(split, labels)]
            cases = [(i, 0, words) for i, words in enumerate(split)]
            cases += [(i, v + 1, [like[i][w][v] if w in like[i] else w for w in split[i]]) for i in range(len(split)) if like[i] for v in range(2)]
            reader.learn(set().union(*(words for _, _, words in cases)))
            best = [max(reader.sentences(words), key=lambda s: float(s.sum())) for _, _, words in cases]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * np.int32(len(strings))), pa.array(np.concatenate(best)))
            at = pa.array([i for i, _, _ in cases])
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array([v for _, v, _ in cases], pa.int32()), part.column(2).take(at), lists], ["doc_id", "variant", "label", "kernel"])

    labelled = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    examples = labelled.mapInArrow(strongest, "doc_id bigint, variant int, label int, kernel array<float>").limit(6 * labelled_rows)
    table = examples.toArrow().sort_by([("doc_id", "ascending"), ("variant", "ascending")])
    kernel = table.column("kernel").combine_chunks().flatten().to_numpy().reshape(-1, len(strings)).astype(float)
    y = table.column("label").to_numpy().astype(float)
    _, document, forms = np.unique(table.column("doc_id").to_numpy(), return_inverse=True, return_counts=True)
    marks = Landmarks(strings)
    table = np.repeat(marks.table, len(strings), 0), np.tile(marks.table, (len(strings), 1))
    own = (subsequence_kernel(*table).reshape(len(strings), -1) / np.sqrt(np.outer(marks.own, marks.own))).astype(float)
    whiten, weights, bias = fit_margin(kernel, own, y)
    model = ToxicityModel(strings, whiten, weights, bias, 1.0, 0.0)
    model.slope, model.offset = fit_scale(model.margin(kernel), y, 1 / forms[document])  # all forms of a document count once
    return model


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """``documents(doc_id, text)`` -> doc_id, score: probability that a document is toxic, from its most
    toxic sentence.

    The kernel tolerates gaps and inserted letters within a word, and letters spelled one by
    one. NULL and empty texts have no sentence and score as a sentence unlike all landmarks.
    Other columns are ignored; NULL ids and repeated rows are scored like any row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        reader = Reader(Landmarks(m.landmarks)) if m.landmarks else None
        for part, texts in text_batches(batches):
            if reader is None:
                margins = np.zeros(len(texts))
            else:
                split = [text_words(t) for t in texts]
                reader.learn(set().union(*split))
                margins = np.array([m.margin(reader.sentences(words)).max() for words in split])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.probability(margins))], ["doc_id", "score"])

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, score double")
