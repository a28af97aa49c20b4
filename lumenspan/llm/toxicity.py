"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

A unit is a word, or a run of single letters spaced apart, without its non-letters. Two
units are compared by the gap-weighted subsequences of three characters they share (span
up to SPAN, each skipped character costs the factor DECAY), so inserted or dropped
characters lower their cosine only a little. The kernel of two sentences sums the POWER-th
power of that cosine over all pairs of their units. Sentences are projected on landmark
units (Nyström), and a linear support vector machine is trained there on the labelled
sentences. A sentence has its document's label at first; as a toxic document holds clean
sentences too, later rounds keep of each toxic document those sentences as positive that
the machine finds toxic, at least its most toxic one (multiple-instance learning); every
sentence of a clean document is negative throughout. A document scores by its TOP most
toxic sentences and their number. Landmarks only span the space: which of them speak for
toxicity is learnt from the sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_hash, learn_rows, map_rows, sample_share

SPAN, DECAY, POWER = 6, 0.5, 3
#: Character classes: Latin letters have one each, all others share OTHERS; the last two mark a unit's ends.
ALPHABET, OTHERS = 128, 97
#: Longest piece of a unit; longer units are cut into pieces that overlap by half.
PIECE = 24
LANDMARKS = 256
#: A landmark is left out whose kernel value with a better one is at least this.
ALIKE = 0.2
#: Bound of the training sample: documents with either label, sentences taken of each, characters of one; and sentences in all.
TOXIC_DOCS, CLEAN_DOCS, SENTENCES_PER_DOC, SENTENCE_CHARS = 1200, 4000, 60, 240
MOST_SENTENCES = 150_000
#: Sentences that a document's score looks at.
TOP = 3
#: Training sentences whose units are compared with the landmarks together, each distinct one once.
TOGETHER = 4096
#: Rounds of choosing the toxic documents' positive sentences.
ROUNDS = 5
#: A toxic document's sentence counts as toxic if its margin is over that of this share of the clean documents' sentences.
CLEAN_SHARE = 0.995
CACHE_UNITS = 500_000
#: Cost of a margin error against the size of the weights.
COST = 20000.0
OFFSETS = [(a, a + b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def sentences(text: str) -> list[str]:
    """Runs up to a sentence's or line's end; longer ones than SENTENCE_CHARS are cut at white space (or, without any, anywhere)."""
    out = []
    for s in SENTENCE.findall(text):
        while len(s) > SENTENCE_CHARS:
            at = s.rfind(" ", SENTENCE_CHARS // 2, SENTENCE_CHARS)
            at = at if at > 0 else SENTENCE_CHARS
            out.append(s[:at])
            s = s[at:]
        out.append(s)
    return out


def units(text: str) -> list[str]:
    """Words and runs of spaced single letters, lower-cased, as they stand, repeats included."""
    text = text.lower()
    return text.split() + SPACED.findall(text)


def summary(margins: np.ndarray) -> list[float]:
    """What a document's score is computed from: its sentences' TOP largest margins (-1 where there are fewer) and the logarithm of their number."""
    best = np.sort(np.partition(margins, len(margins) - TOP)[-TOP:])[::-1] if len(margins) > TOP else np.append(np.sort(margins)[::-1], [-1.0] * (TOP - len(margins)))
    return [*np.clip(best, -2, 2), math.log1p(len(margins))]


def _pieces(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character classes of units' letters between end marks (a row a piece), the pieces' lengths, and the unit of each."""
    spelled = ["".join(filter(str.isalpha, u)) for u in names]
    long = np.fromiter(map(len, spelled), np.int64, len(names))
    flat = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.where((flat > 96) & (flat < 123), flat - 96, 27 + flat % OTHERS).astype(np.int32)
    # Units that fill one piece.
    first = np.cumsum(long) - long
    short = np.flatnonzero((long > 0) & (long <= PIECE - 2))
    codes = np.zeros((len(short), PIECE), np.int32)
    row = np.repeat(np.arange(len(short)), long[short])
    at = np.arange(len(row)) - np.repeat(np.cumsum(long[short]) - long[short], long[short])
    codes[row, at + 1] = classes[np.repeat(first[short], long[short]) + at]
    codes[:, 0] = ALPHABET - 2
    codes[np.arange(len(short)), long[short] + 1] = ALPHABET - 1
    # Longer ones overlap by half.
    more, owner = [], []
    for k in np.flatnonzero(long > PIECE - 2):
        body = np.concatenate([[ALPHABET - 2], classes[first[k] : first[k] + long[k]], [ALPHABET - 1]])
        for low in range(0, len(body) - PIECE // 2, PIECE // 2):
            more.append(body[low : low + PIECE])
            owner.append(k)
    if more:
        tail = np.zeros((len(more), PIECE), np.int32)
        for i, m in enumerate(more):
            tail[i, : len(m)] = m
        codes = np.concatenate([codes, tail])
    return codes, np.append(long[short] + 2, np.array(list(map(len, more)), np.int64)), np.append(short, np.array(owner, np.int64))


def features(codes: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of length one of pieces: piece, subsequence, value; sorted by both, each pair once."""
    cells, vals = [], []
    for a, b in OFFSETS:
        wide = max(0, int(long.max(initial=0)) - b)
        number = (codes[:, :wide] * ALPHABET + codes[:, a : a + wide]) * ALPHABET + codes[:, b : b + wide]
        row, at = np.nonzero(np.arange(wide) < (long - b)[:, None])
        cells.append(row * ALPHABET**3 + number[row, at])
        vals.append(np.full(len(row), DECAY ** (b - 2)))
    cells, vals = np.concatenate(cells), np.concatenate(vals)
    order = np.argsort(cells)
    cells, vals = cells[order], vals[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    vals = np.add.reduceat(vals, first) if len(first) else vals
    rows, cols = np.divmod(cells[first], ALPHABET**3)
    return rows, cols, vals / np.sqrt(np.bincount(rows, vals * vals, len(codes)))[rows]


class Landmarks:
    """Landmark pieces as an inverted index: ``kernel`` gives pieces' powers of the cosine with each of them."""

    def __init__(self, codes: np.ndarray, long: np.ndarray):
        rows, cols, vals = features(codes, long)
        order = np.argsort(cols, kind="stable")
        self.many, self.rows, self.vals = len(codes), rows[order].astype(np.int32), vals[order]
        found, count = np.unique(cols, return_counts=True)
        self.slot = np.full(ALPHABET**3, -1, np.int32)
        self.slot[found] = np.arange(len(found))
        self.count = count
        self.start = np.cumsum(count) - count
        self.own = self.kernel(codes, long)

    def kernel(self, codes: np.ndarray, long: np.ndarray) -> np.ndarray:
        rows, cols, vals = features(codes, long)
        slot = self.slot[cols]
        hit = slot >= 0
        rows, slot, vals = rows[hit], slot[hit], vals[hit]
        n = self.count[slot]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[slot], n)
        cosine = np.bincount(np.repeat(rows * self.many, n) + self.rows[at], np.repeat(vals, n) * self.vals[at], len(codes) * self.many)
        return (cosine**POWER).reshape(len(codes), self.many)


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray  # by landmark
    bias: float
    curve: np.ndarray  # logistic weights of a document's summary, the last one alone

    def name(self) -> str:
        """Tells models apart."""
        return xxhash.xxh64_hexdigest(self.weights.tobytes() + self.curve.tobytes())

    def values(self, names: list[str]) -> np.ndarray:
        """What each unit adds to its sentence's margin."""
        out = np.zeros(len(names))
        codes, long, owner = _pieces(names)
        for low in range(0, len(codes), 512):
            np.add.at(out, owner[low : low + 512], self.landmarks.kernel(codes[low : low + 512], long[low : low + 512]) @ self.weights)
        return out

    def margins(self, found: list[list[str]], known: dict[str, float] | None = None) -> np.ndarray:
        """Margins of sentences given as units; ``known`` remembers units' values."""
        known = {} if known is None else known
        new = list({u for us in found for u in us if u not in known})
        spelled = ["".join(filter(str.isalpha, u)) for u in new]
        fresh = list({s for s in spelled if s not in known})
        known.update(zip(fresh, self.values(fresh).tolist(), strict=True))
        known.update((u, known[s]) for u, s in zip(new, spelled, strict=True))
        return np.array([sum(map(known.__getitem__, us)) for us in found]) + self.bias

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        at = np.asarray(rows, np.float64).reshape(-1, TOP + 1) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Linear squared-hinge machine by Newton steps with halving; the last column of ``x`` is the bias's, rows of weight 0 don't count."""
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def slack(w):
        return 1 - y * (x @ w.astype(np.float32))

    def loss(w, left):
        return 0.5 * (ridge * w * w).sum() + cost * (weight * np.maximum(0, left) ** 2).sum()

    left = slack(w)
    now = loss(w, left)
    for _ in range(40):
        grad, second = ridge * w, np.diag(ridge)
        active = np.flatnonzero((left > 0) & (weight > 0))
        for low in range(0, len(active), 8192):
            on = active[low : low + 8192]
            some, share = x[on], weight[on]
            grad = grad - 2 * cost * (some.T @ (share * y[on] * left[on]))
            second = second + 2 * cost * ((some.T * share.astype(np.float32)) @ some)
        step = np.linalg.solve(second, grad)
        size = 1.0
        while size > 1e-4 and (new := loss(w - size * step, less := slack(w - size * step))) > now:
            size /= 2
        if size <= 1e-4:
            break
        done = now - new <= 1e-6 * now
        w, now, left = w - size * step, new, less
        if done:
            break
    return w


def _logistic(rows: np.ndarray, y: np.ndarray, stand_for: dict[int, int] | None = None) -> np.ndarray:
    """Logistic weights (bias last) by Newton steps; Platt's smoothed targets, a small ridge. A label's rows weigh as many as they stand for."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    stand_for = stand_for or {1: up, 0: down}
    weight = np.where(y > 0, stand_for[1] / max(up, 1), stand_for[0] / max(down, 1))
    weight *= len(y) / weight.sum()
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.array([0.1] * (x.shape[1] - 1) + [1e-3])

    def loss(w):
        at = x @ w
        return (weight * (np.logaddexp(0, at) - target * at)).sum() + 0.5 * (ridge * w * w).sum()

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(ridge), x.T @ (weight * (p - target)) + ridge * w)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-9 * abs(now):
            break
        w, now = w - size * step, new
    return w


def _choose(toxic: Counter, clean: Counter, many: int) -> list[str]:
    """Landmark units: half those whose rates in toxic and clean sentences differ most (in standard errors), half drawn from all others."""
    a, b = max(1, toxic.total()), max(1, clean.total())

    def apart(u: str) -> float:
        share = (toxic[u] + clean[u]) / (a + b)
        return abs(toxic[u] / a - clean[u] / b) / math.sqrt(share * (1 / a + 1 / b))

    ranked = sorted(toxic | clean, key=lambda u: (-apart(u), u))
    # One of several alike spans what they have in common: those near a better ranked one are passed over.
    codes, long, owner = _pieces(ranked[: 4 * many])
    first = np.unique(owner, return_index=True)[1]
    near = Landmarks(codes[first], long[first]).own
    chosen: list[int] = []
    for k in range(len(first)):
        if len(chosen) < many // 2 and (not chosen or near[k, chosen].max() < ALIKE):
            chosen.append(k)
    out = [ranked[owner[first[k]]] for k in chosen]
    rest = sorted(set(ranked) - set(out))
    return out + [rest[i] for i in sorted(np.random.default_rng(3).permutation(len(rest))[: many - len(out)])]


def fit(labelled: Iterable[tuple[int, int, str]], landmarks: int = LANDMARKS, stand_for: dict[int, int] | None = None) -> Model | None:
    """A model from (document, label, sentence) rows; None unless both labels have sentences with letters.

    ``stand_for`` tells how many documents of each label the sample was drawn from; only the last step, the score's scale, looks at it.
    """
    docs: dict[tuple[int, int], int] = {}
    number: dict[str, int] = {}
    owner, found = [], []
    for doc, label, sentence in labelled:
        some = sorted({number.setdefault(u, len(number)) for u in ("".join(filter(str.isalpha, u)) for u in units(sentence)) if u})
        if some:
            owner.append(docs.setdefault((doc, label), len(docs)))
            found.append(np.array(some, np.int32))
    names, owner = list(number), np.array(owner, np.int64)
    order = np.sort(np.random.default_rng(4).permutation(len(owner))[:MOST_SENTENCES])
    order = order[np.argsort(owner[order], kind="stable")]
    owner, found = owner[order], [found[i] for i in order]
    label = np.array([1 if label == 1 else -1 for _, label in docs])[owner] if docs else owner
    if not ((label > 0).any() and (label < 0).any()):
        return None
    # A sentence that several documents share counts once; if a clean one has it, as clean.
    seen = {us.tobytes(): i for i, us in reversed([*enumerate(found)])} | {found[i].tobytes(): i for i in np.flatnonzero(label < 0)[::-1]}
    alone = np.zeros(len(found), bool)
    alone[list(seen.values())] = True
    counts = []
    for sign in (1, -1):
        n = np.bincount(np.concatenate([found[i] for i in np.flatnonzero(alone & (label == sign))] or [np.zeros(0, np.int32)]), minlength=len(names))
        counts.append(Counter({names[k]: int(n[k]) for k in np.flatnonzero(n)}))
    marks = Landmarks(*_pieces(_choose(*counts, landmarks))[:2])
    x, project = _project(marks, names, found)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    y, positive = label[first], label > 0
    for _ in range(ROUNDS):
        up, down = positive & alone, (label < 0) & alone
        weight = np.where(up, 0.5 / max(1, up.sum()), np.where(down, 0.5 / max(1, down.sum()), 0.0))
        w = _svm(x, label, weight, COST)
        margin = x @ w.astype(np.float32)
        chosen = (label > 0) & (margin > np.quantile(margin[down], CLEAN_SHARE))
        if not chosen.any() or (chosen == positive).all():
            break
        positive = chosen
    ends = np.append(first[1:], len(owner))
    curve = _logistic(np.array([summary(margin[a:b]) for a, b in zip(first, ends, strict=True)]), y, stand_for)
    return Model(marks, project @ w[:-1], float(w[-1]), curve)


def _project(marks: Landmarks, names: list[str], found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sentences' Nyström coordinates, with a last column of ones, and the matrix that leads from kernel values there."""
    own = marks.own
    values, vectors = np.linalg.eigh(own)
    sound = values > 1e-6 * values.max()
    project = vectors[:, sound] / np.sqrt(values[sound])
    x = np.ones((len(found), marks.many + 1), np.float32)
    for low in range(0, len(found), TOGETHER):
        some = found[low : low + TOGETHER]
        present, place = np.unique(np.concatenate(some), return_inverse=True)
        codes, long, owner = _pieces([names[k] for k in present])
        each = np.zeros((len(present), marks.many), np.float32)
        for at in range(0, len(codes), 512):
            np.add.at(each, owner[at : at + 512], marks.kernel(codes[at : at + 512], long[at : at + 512]))
        starts = np.cumsum([0] + [len(s) for s in some])[:-1]
        x[low : low + TOGETHER, :-1] = np.add.reduceat(each[place], starts)
    for low in range(0, len(x), 8192):
        x[low : low + 8192, : project.shape[1]] = x[low : low + 8192, :-1] @ project.astype(np.float32)
    x[:, project.shape[1]] = 1
    return x[:, : project.shape[1] + 1], project


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model | None:
    """A model from a bounded sample of labelled documents that may be learnt from.

    The sample of labels has at most about toxic_docs + clean_docs rows and is broadcast;
    the driver gets at most SENTENCES_PER_DOC sentences of each of its documents. A document
    labelled both 0 and 1 counts as toxic.
    """
    known = labels.where(learn_rows(id_col) & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("labelled")).agg(F.max("toxic").cast("int").alias("label"))
    there = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, sample_share(toxic_docs, there.get(1, 0))).otherwise(sample_share(clean_docs, there.get(0, 0)))
    sample = known.where(by_hash(share, "labelled"))

    def cut(batches):
        for batch in batches:
            chosen = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = sentences(text)
                pick = sorted(np.random.default_rng(abs(hash(key)) % (1 << 32)).permutation(len(found))[:SENTENCES_PER_DOC])
                chosen.append([found[p] for p in pick])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.list_(pa.string()))], names=["doc", "label", "sentences"])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(sample), F.col("id") == F.col("labelled")).select(F.xxhash64("id"), "label", "text")
    got = texts.mapInArrow(cut, "doc long, label int, sentences array<string>").toArrow().sort_by([("doc", "ascending"), ("label", "ascending")])
    rows = ((doc, label, s) for doc, label, some in zip(*[c.to_pylist() for c in got.columns], strict=True) for s in sorted(some))
    return fit(rows, stand_for={k: there.get(k, 0) for k in (0, 1)})


def score_texts(model: Model | None, known: dict[str, float], texts: list[str | None]) -> list[float]:
    """Probability of label 1 for each whole text, from its most toxic sentences; ``known`` remembers units' values."""
    if model is None:
        return [0.0] * len(texts)
    if len(known) > CACHE_UNITS:
        known.clear()
    found = [[us for s in sentences(t) if (us := set(units(s)))] if t else [] for t in texts]
    margin = model.margins([us for some in found for us in some], known)
    ends = np.cumsum([len(some) for some in found])
    return model.probability([summary(margin[b - len(some) : b]) for some, b in zip(found, ends, strict=True)]).tolist()


_values: dict[str, dict[str, float]] = {}


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``, from its whole text and nothing else; null and empty texts score as one without sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        # A worker process keeps units' values from task to task.
        name = shared.value.name() if shared.value else ""
        if name not in _values:
            _values.clear()
        known = _values.setdefault(name, {})
        return lambda ids, texts: {id_col: ids, "score": score_texts(shared.value, known, texts)}

    return map_rows(docs, [id_col, text_col], make, T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the labelled rows and scores all documents: id, held_out, score, predicted.

    Without labels of both kinds every score is 0. Rows that repeat an id are scored
    each; null ids are kept (held_out null). Empty tables give no rows. Other columns are ignored.
    """
    found = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return found.select(id_col, (~learn_rows(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
