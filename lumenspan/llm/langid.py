"""Language identification with a byte convolutional network.

Windows of ``WINDOW`` bytes pass through filters of several widths, a maximum over
positions and a softmax layer. The network is trained in numpy on labelled rows. For
prediction a filter's response is a sum of table rows, one per byte or pair of bytes,
since embedding and filter weights are fixed then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_hash, learn_rows, map_rows, sample_share

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 16
#: Bound of the training sample: documents a language, and windows taken of each.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 1500, 2
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 11
UNKNOWN = "und"
#: Windows that are computed at once.
BLOCK = 192


def to_windows(text: str) -> np.ndarray:
    """The lower-cased text's bytes as rows of WINDOW bytes, the last one filled up with spaces."""
    data = text.lower().encode("utf-8", "replace")
    data += b" " * (-len(data) % WINDOW)
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW)


class ByteNet:
    """Embedding, filters and output layer; ``predict`` gives logits for rows of bytes."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32)
        self.weights["bias"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.weights["out_bias"] = np.zeros(len(languages), np.float32)
        self.tables = None

    def _pooled(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses (rows, filters) before bias, and where they lie."""
        out, places = [], []
        for w in WIDTHS:
            kernel, long = self.weights[f"filter{w}"], WINDOW - w + 1
            total = np.zeros((len(rows), long, FILTERS), np.float32)
            for k in range(w):
                total += np.take(self.weights["embed"] @ kernel[k], rows[:, k : k + long], axis=0)
            at = total.argmax(1)
            places.append(at)
            out.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
        return np.concatenate(out, 1), places

    def train(self, rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam on the cross entropy; gradients pass only through the positions of the maxima."""
        rng = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), BATCH):
                pick = order[low : low + BATCH]
                step += 1
                for name, g in self._gradient(rows[pick], labels[pick]).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.weights[name] -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-7)

    def _gradient(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w_ = self.weights
        pooled, places = self._pooled(rows)
        hidden = np.maximum(pooled + w_["bias"], 0)
        logits = hidden @ w_["out"] + w_["out_bias"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(rows)), labels] -= 1
        prob /= len(rows)
        back = (prob @ w_["out"].T) * (hidden > 0)
        out = {"out": hidden.T @ prob, "out_bias": prob.sum(0), "bias": back.sum(0), "embed": np.zeros_like(w_["embed"])}
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            kernel = w_[f"filter{w}"]
            own = np.zeros_like(kernel)
            for k in range(w):
                seen = np.take_along_axis(rows, places[i] + k, 1)
                own[k] = np.einsum("nfe,nf->ef", w_["embed"][seen], g)
                np.add.at(out["embed"], seen.ravel(), (g[:, :, None] * kernel[k].T[None]).reshape(-1, EMBED))
            out[f"filter{w}"] = own
        return out

    def freeze(self) -> ByteNet:
        """Builds the lookup tables: filter responses of single bytes and of pairs of bytes."""
        self.tables = {}
        for w in WIDTHS:
            single = [self.weights["embed"] @ self.weights[f"filter{w}"][k] for k in range(w)]
            self.tables[w] = [(k, 2, (single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS)) for k in range(0, w - 1, 2)]
            if w % 2:
                self.tables[w].append((w - 1, 1, single[-1]))
        return self

    def predict(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for low in range(0, len(rows), BLOCK):
            part = rows[low : low + BLOCK]
            pairs = part[:, :-1].astype(np.uint16) * np.uint16(256) + part[:, 1:]
            pooled = []
            for w in WIDTHS:
                long, total = WINDOW - w + 1, None
                for at, of, table in self.tables[w]:
                    got = np.take(table, (pairs if of == 2 else part)[:, at : at + long], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(total.max(1))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.weights["bias"], 0)
            out[low : low + BLOCK] = hidden @ self.weights["out"] + self.weights["out_bias"]
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> ByteNet | None:
    """A network from a bounded sample of the rows that may be learnt from; None if there are none.

    The driver gets at most about docs_per_language x WINDOWS_PER_DOC windows a language.
    """
    known = docs.where(learn_rows(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    there = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not there:
        return None
    share = F.lit(0.0)
    for lang, n in there.items():
        share = F.when(F.col(lang_col).cast("string") == lang, sample_share(docs_per_language, n)).otherwise(share)

    def cut(batches):
        for batch in batches:
            langs, rows = [], []
            for key, text, lang in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if not any(c.isalpha() for c in text):
                    continue
                cuts = to_windows(text)
                pick = np.random.default_rng(abs(hash(key)) % (1 << 32)).permutation(len(cuts))[:WINDOWS_PER_DOC]
                for p in sorted(pick):
                    langs.append(lang)
                    rows.append(cuts[p].tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "bytes": pa.array(rows, pa.binary())})

    sample = known.where(by_hash(share, id_col)).select(F.xxhash64(id_col), text_col, F.col(lang_col).cast("string"))
    got = sorted(map(tuple, sample.mapInArrow(cut, "lang string, bytes binary").collect()))
    if not got:
        return None
    languages = sorted({g[0] for g in got})
    net = ByteNet(languages)
    net.train(np.frombuffer(b"".join(bytes(g[1]) for g in got), np.uint8).reshape(-1, WINDOW), np.array([languages.index(g[0]) for g in got]))
    return net.freeze()


def predict_texts(net: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of whole texts: windows' log probabilities averaged by their number of bytes other than white space."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    read = [(i, to_windows(t)) for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not read:
        return langs, scores
    rows = np.concatenate([w for _, w in read])
    logits = net.predict(rows).astype(np.float64)
    logits -= logits.max(1, keepdims=True)
    logs = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    weight = (rows > 32).sum(1) + 1e-9
    starts = np.cumsum([0] + [len(w) for _, w in read])[:-1]
    mean = np.add.reduceat(logs * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
    prob = np.exp(mean - mean.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    best = prob.argmax(1)
    for (i, _), b, p in zip(read, best, prob, strict=True):
        langs[i], scores[i] = net.languages[b], float(min(1.0, max(0.0, p[b])))
    return langs, scores


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the columns in ``keep``, lang_pred, score; from the whole text and nothing else.

    Texts that are null or have no letter get ``und`` with score 0, as does every text
    if no row could be learnt from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        model = shared.value

        def step(ids, texts, *kept):
            langs, scores = [], []
            for at in range(0, len(texts), 32):  # bounds the bytes at hand
                found = predict_texts(model, texts[at : at + 32])
                langs += found[0]
                scores += found[1]
            return {id_col: ids, "lang_pred": langs, "score": scores} | dict(zip(keep, kept, strict=True))

        return step

    schema = T.StructType([docs.schema[id_col], *[docs.schema[k] for k in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_rows(docs, [id_col, text_col, *keep], make, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on ``docs`` and predicts all of it: id, held_out, lang_pred, score.

    Rows that repeat an id are predicted each; a null id is kept (held_out null: it has
    no remainder) and never learnt from. Empty tables give no rows. Other columns are ignored.
    """
    found = identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, (~learn_rows(id_col)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without texts whose language isn't told (``und``) or told with a score under ``least``; all columns are kept.

    An empty table stays empty. Rows from which nothing can be learnt raise ValueError, as
    every document would go.
    """
    own = docs.schema.fields
    net = train(docs, id_col, text_col, lang_col)
    if net is None and not docs.isEmpty():
        raise ValueError(f"no row has {lang_col} and a text to learn from")
    plain = docs.select(*[F.col(f.name).alias(f"_{i}") for i, f in enumerate(own)])
    at = {f.name: f"_{i}" for i, f in enumerate(own)}
    found = identify(plain, net, at[id_col], at[text_col], tuple(m for m in at.values() if m != at[id_col]))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(at[f.name]).alias(f.name) for f in own])
