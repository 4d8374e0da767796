"""Language ID: a convolutional network over bytes.

Bytes are embedded, filters of several widths run over them, the maximum of
each filter over a window feeds a softmax over the languages.  Training is in
numpy, on the driver, on a sample of labelled rows: about ``PER_LANG`` different
texts of each language, drawn by a hash of id and text, and ``WINDOWS`` windows
of each, which is all that the driver gets of them.  The sample is the only
bound; prediction covers all windows of every text.

For prediction the network is unrolled into tables: what a pair of bytes adds
to all filters is one row, so a position costs three look-ups and two sums.
A text is cut into windows of ``LENGTH`` bytes that overlap by the widest
filter less one; its probabilities are the means over its windows, weighted by
their bytes.

Defined results: null text, or text without a letter, is ``und`` with score 0;
rows with a null language or id are not learnt from; a null id counts as not
held out; repeated rows get equal results and are learnt from once; where
nothing can be learnt every row is ``und``; columns of the results' names are
replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.batches import bounded
from ledgerlark.llm import kernels as K
from ledgerlark.llm.rows import unused

LENGTH = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBED = 8
PER_LANG = 400
WINDOWS = 6
EPOCHS = 8


@dataclass
class Network:
    langs: list[str]
    emb: np.ndarray
    conv: dict[int, np.ndarray]  # width: (width, EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What bytes 0-1, 2-3 and 4 of a position add to the filters (pairs as low + 256 * high)."""
        total = FILTERS * len(WIDTHS)
        single = np.zeros((5, 256, total), np.float32)
        for k, w in enumerate(WIDTHS):
            for j in range(w):
                single[j, :, k * FILTERS : (k + 1) * FILTERS] = self.emb @ self.conv[w][j]
        pair = lambda a, b: (single[b][:, None, :] + single[a][None, :, :]).reshape(65536, total)
        first = pair(0, 1)
        first += self.bias
        return first, np.ascontiguousarray(pair(2, 3)[:, FILTERS:]), np.ascontiguousarray(single[4][:, (len(WIDTHS) - 1) * FILTERS :])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_gradients(par: dict, xb: np.ndarray, yb: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of a batch of windows, and its gradient by each parameter."""
    places, n = LENGTH - max(WIDTHS) + 1, len(xb)
    e = par["emb"][xb]
    cols = {w: np.concatenate([e[:, j : j + places] for j in range(w)], axis=2) for w in WIDTHS}
    pre = np.concatenate([cols[w] @ par[w] for w in WIDTHS], axis=2) + par["bias"]
    where = pre.argmax(axis=1)
    top = np.take_along_axis(pre, where[:, None], axis=1)[:, 0]
    hidden = np.maximum(top, 0)
    p = softmax(hidden @ par["out"] + par["ob"])
    loss = float(-np.log(p[np.arange(n), yb] + 1e-30).mean())
    p[np.arange(n), yb] -= 1
    p /= n
    grad = {"out": hidden.T @ p, "ob": p.sum(axis=0)}
    dh = (p @ par["out"].T) * (top > 0)
    grad["bias"] = dh.sum(axis=0)
    grad["emb"] = np.zeros_like(par["emb"])
    for k, w in enumerate(WIDTHS):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        at, d = where[:, part], dh[:, part]
        got = cols[w][np.arange(n)[:, None], at]  # n, filters, w * embed
        grad[w] = np.einsum("nfc,nf->cf", got, d)
        back = d[:, :, None] * par[w].T[None]
        for j in range(w):
            byte = xb[np.arange(n)[:, None], at + j]
            np.add.at(grad["emb"], byte.ravel(), back[:, :, j * EMBED : (j + 1) * EMBED].reshape(-1, EMBED))
    return loss, grad


def initial(rng: np.random.Generator, n_langs: int) -> dict:
    par = {"emb": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(FILTERS * len(WIDTHS)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_langs)), "ob": np.zeros(n_langs)}
    return par | {w: rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS}


def network(langs: list[str], par: dict) -> Network:
    return Network(langs, par["emb"], {w: par[w].reshape(w, EMBED, FILTERS) for w in WIDTHS}, par["bias"], par["out"], par["ob"])


def train(pieces: list[bytes], labels: list[str], seed: int = 5) -> Network:
    """Adam on cross-entropy; of each piece (at most ``LENGTH`` bytes of a text) a part of random place and length."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    if not langs:
        none = np.zeros((0, 0), np.float32)
        return Network([], none, {}, none, none, none)
    number = {lang: i for i, lang in enumerate(langs)}
    windows = []
    for piece in pieces:
        size = int(rng.integers(12, LENGTH + 1))
        at = int(rng.integers(0, max(1, len(piece) - size + 1)))
        windows.append(np.frombuffer(piece[at : at + size].ljust(LENGTH, b"\0"), np.uint8))
    x, y = np.stack(windows), np.array([number[lang] for lang in labels])
    par = {k: v.astype(np.float32) for k, v in initial(rng, len(langs)).items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in par.items()}
    step, size = 0, 128
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), size):
            pick = order[a : a + size]
            _, grad = loss_gradients(par, x[pick], y[pick])
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                par[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network(langs, par)


class Predictor:
    """Probabilities of the rows of a batch."""

    def __init__(self, net: Network):
        self.net, (self.first, self.second, self.third) = net, net.tables()
        self.hop = LENGTH - max(WIDTHS) + 1

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.diff(offsets)
        count = np.maximum(1, -(-np.maximum(size - max(WIDTHS) + 1, 0) // self.hop))
        row = np.repeat(np.arange(len(size)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = offsets[row] + number * self.hop
        room = np.clip(offsets[row + 1] - begin, 0, LENGTH)
        total = np.zeros((len(size), len(self.net.langs)), np.float64)
        padded = np.append(data, np.zeros(LENGTH, np.uint8))
        step = 256
        for a in range(0, len(row), step):
            b, r = begin[a : a + step], room[a : a + step]
            win = padded[b[:, None] + np.arange(LENGTH)]
            win[np.arange(LENGTH) >= r[:, None]] = 0
            p = self.windows(win)
            np.add.at(total, row[a : a + step], p * np.maximum(r, 1)[:, None])
        return total / total.sum(axis=1, keepdims=True)

    def windows(self, win: np.ndarray) -> np.ndarray:
        pair = win[:, :-1].astype(np.uint16) | (win[:, 1:].astype(np.uint16) << 8)
        places = self.hop
        pre = self.first[pair[:, :places]]
        pre[:, :, FILTERS:] += self.second[pair[:, 2 : 2 + places]]
        pre[:, :, -FILTERS:] += self.third[win[:, 4 : 4 + places]]
        hidden = np.maximum(pre.max(axis=1), 0)
        return softmax(hidden @ self.net.out + self.net.out_bias)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_lang: int = PER_LANG) -> Network:
    """A network from the rows that are not held out.

    One pass estimates the different rows of each language; a second draws a
    share of each by a hash of id and text, such that about ``per_lang`` come,
    takes equal ones once, and cuts ``WINDOWS`` pieces of ``LENGTH`` bytes from
    each; the driver keeps those of the ``per_lang`` least hashes, and fills a
    language that has fewer with repeats of the repeated ones.
    """
    rows = docs.filter(docs[lang].isNotNull() & docs[text].isNotNull() & (docs[text] != "") & docs[doc_id].isNotNull() & ~held_out(docs[doc_id]))
    mixed = F.xxhash64(rows[doc_id].cast("string"), rows[text], F.lit("langid"))
    slim = rows.select(rows[lang].alias("l"), mixed.alias("h"), rows[text].alias("t"))
    counts = {r[0]: r[1] for r in slim.groupBy("l").agg(F.approx_count_distinct("h")).collect()}
    if not counts:
        return train([], [])
    draw = F.pmod("h", F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, int(min(1.0, (per_lang * 1.3 + 20) / n) * (1 << 30)))])
    data = F.col("t").cast("binary")
    piece = lambda i: F.substr(data, (F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.lit(1), F.octet_length("t") - LENGTH + 1)) + 1).cast("int"), F.lit(LENGTH))
    got = slim.filter(draw < F.element_at(share, F.col("l"))).select("l", "h", F.array(*[piece(i) for i in range(WINDOWS)]).alias("pieces")).groupBy("l", "h").agg(F.any_value("pieces").alias("pieces"), F.count(F.lit(1)).alias("n")).collect()
    best: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.l, r.h)):
        if len(best.setdefault(r.l, [])) < per_lang:
            best[r.l].append(r)
    pairs = []
    for lang_, drawn in best.items():
        spare = per_lang - len(drawn)
        for r in drawn:
            more = min(spare, r.n - 1)
            spare -= more
            pairs += [(bytes(p), lang_) for _ in range(1 + more) for p in r.pieces]
    return train([p for p, _ in pairs], [l for _, l in pairs])


_predictors: dict[bytes, Predictor] = {}


def predict(docs: DataFrame, net: Network, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its probability, under the names ``out``."""
    import pickle

    from pyspark.sql import types as T

    blob = pickle.dumps(net)
    carry, letter_ = [c for c in docs.columns if c not in out], unused(docs, "__letter")
    source = docs.select(*carry, F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False)).alias(letter_))
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    if not net.langs:
        return source.select(*carry, F.lit("und").alias(out[0]), F.lit(0.0).alias(out[1]))

    def run(batches):
        if blob not in _predictors:
            _predictors.clear()
            _predictors[blob] = Predictor(pickle.loads(blob))
        model = _predictors[blob]
        names = np.array(model.net.langs, object)
        for batch in batches:
            column = batch.column(text)
            for i, j in K.slices(column):
                p = model.probabilities(*K.columns_bytes(column.slice(i, j - i)))
                best = p.argmax(axis=1)
                letter = np.array(batch.column(letter_).slice(i, j - i).to_pylist(), bool)
                lang = np.where(letter, names[best], "und")
                score = np.where(letter, p[np.arange(len(p)), best], 0.0)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return bounded(source).mapInArrow(run, schema)
