"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of windows; it labels every byte position of the whole
text, its states running from one end to the other both ways, and a document's probabilities are the mean over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table

#: Units a direction; bytes of a training window.
HIDDEN, STEPS = 8, 64
#: Texts go through the network in chunks of this many bytes, so many at a time; a chunk's first states are guessed from this
#: many bytes beside it, and mended until they are those that the neighbouring chunk ends with, to this much.
CHUNK, LANES, AHEAD, SAME = 512, 1024, 128, 1e-4
#: Bound of the training sample: texts in all, and windows of a text, whose places are drawn over the whole of it.
TRAIN_DOCS, TRAIN_WINDOWS = 2400, 8
PAD = 256
FOLD = np.arange(257)
FOLD[65:91] += 32


@dataclass
class Model:
    """e: (3 gates, 2 directions, 257 bytes, H) input weights with biases; u: (3, 2, H, H); bn: (2, H); v, c: output.

    Gates: update, reset, new. The gates squash by softsign, x / (1 + |x|), which takes a tenth of tanh's time in numpy.
    """

    langs: list[str]
    e: np.ndarray
    u: np.ndarray
    bn: np.ndarray
    v: np.ndarray
    c: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.e, self.u, self.bn, self.v, self.c]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    r, h = np.random.default_rng(seed), hidden
    f = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    e = (0.5 * r.standard_normal((3, 2, 257, h))).astype(np.float32)
    return Model(langs, e, f(3, 2, h, h), np.zeros((2, h), np.float32), f(2 * h, len(langs)), np.zeros(len(langs), np.float32))


def softsign(x: np.ndarray) -> np.ndarray:
    """In place."""
    t = np.abs(x)
    t += 1
    x /= t
    return x


def gate(x: np.ndarray) -> np.ndarray:
    """In place: softsign carried from -1 .. 1 to 0 .. 1."""
    softsign(x)
    x *= 0.5
    x += 0.5
    return x


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def loss_and_gradients(m: Model, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the positions, each of which is to name its text's language; gradients by BPTT."""
    x = FOLD[x].T
    xs, (t, b), h, d = np.stack([x, x[::-1]], 1), x.shape, m.bn.shape[1], np.arange(2)[:, None]
    hs, keep = np.zeros((t + 1, 2, b, h), np.float32), []
    for s in range(t):
        a, g = m.e[:, d, xs[s]], hs[s] @ m.u
        z, r, q = gate(a[0] + g[0]), gate(a[1] + g[1]), g[2] + m.bn[:, None]
        n = softsign(a[2] + r * q)
        hs[s + 1] = n + z * (hs[s] - n)
        keep.append((z, r, q, n))
    both = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], -1)  # (T, B, 2H), by position
    p, w = softmax(both @ m.v + m.c), (mask.T / max(mask.sum(), 1)).astype(np.float32)
    loss = float(-(np.log(p[:, np.arange(b), y] + 1e-9) * w).sum())
    dl = p * w[..., None]
    dl[:, np.arange(b), y] -= w
    dv, dc, dboth = both.reshape(-1, 2 * h).T @ dl.reshape(-1, dl.shape[-1]), dl.sum((0, 1)), dl @ m.v.T
    dout = np.stack([dboth[..., :h], dboth[::-1, :, h:]], 1)
    du, dbn, dh = np.zeros_like(m.u), np.zeros_like(m.bn), np.zeros((2, b, h), np.float32)
    inputs = np.empty((t, 3, 2, b, h), np.float32)
    for s in reversed(range(t)):
        z, r, q, n = keep[s]
        dh = dh + dout[s]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (hs[s] - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * q * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        inputs[s] = dz, dr, dn
        dg = np.stack([dz, dr, dn * r])
        du += hs[s].transpose(0, 2, 1) @ dg
        dbn += dg[2].sum(1)
        dh = dh * z + (dg @ m.u.transpose(0, 1, 3, 2)).sum(0)
    de = np.zeros_like(m.e)
    for k in range(2):  # sums by byte: sort positions by byte, then add runs
        order = np.argsort(xs[:, k].ravel(), kind="stable")
        v = xs[:, k].ravel()[order]
        runs = np.nonzero(np.r_[True, v[1:] != v[:-1]])[0]
        for g in range(3):
            de[g, k, v[runs]] = np.add.reduceat(inputs[:, g, k].reshape(-1, h)[order], runs, 0)
    return loss, [de, du, dbn, dv, dc]


def chunked(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, length, number of the text) for each chunk of the texts, padded."""
    rows, lens, of = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, len(t), steps):
            part = np.full(steps, PAD, np.int16)
            got = np.frombuffer(t[at : at + steps], np.uint8)
            part[: len(got)] = got
            rows.append(part)
            lens.append(len(got))
            of.append(i)
    return np.array(rows, np.int16).reshape(-1, steps), np.array(lens), np.array(of, int)


def train(texts: list[bytes], labels: list[str], epochs: int = 5, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """A model of the distinct labels, sorted. Adam, with the rate falling to a tenth. Without texts: a model of no language."""
    langs = sorted(set(labels))
    m, rng = new_model(langs, seed=seed), np.random.default_rng(seed)
    x, lens, of = chunked(texts)
    if len(langs) < 2 or not len(x):
        return m
    y = np.array([langs.index(v) for v in labels])[of]
    mask = np.arange(x.shape[1]) < lens[:, None]
    mean, var, step = [np.zeros_like(p) for p in m.params()], [np.zeros_like(p) for p in m.params()], 0
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            ix = order[at : at + batch]
            _, grads = loss_and_gradients(m, x[ix], y[ix], mask[ix])
            step += 1
            now = rate * (1 - 0.9 * step / total)
            scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
            for p, g, a, v in zip(m.params(), grads, mean, var):
                g = g * scale
                a += 0.1 * (g - a)
                v += 0.001 * (g * g - v)
                p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def run(m: Model, k: int, x: np.ndarray, lens: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Direction k (0 forward, 1 backward) over rows x (B, T) of lens bytes, longest first, from state (B, H), which is changed
    into the last states and returned; out (T, B, H) gets the state of each position."""
    h, (b, t) = m.bn.shape[1], x.shape
    e, xs, u, bias = np.ascontiguousarray(m.e[:, k, FOLD]), np.ascontiguousarray(x.T, np.intp), np.ascontiguousarray(m.u[:, k]), m.bn[k]
    a, g, tmp = np.empty((3, b, h), np.float32), np.empty((3, b, h), np.float32), np.empty((2, b, h), np.float32)
    live = np.searchsorted(-lens, -np.arange(t), side="left")  # rows longer than each place
    for s in range(t) if k == 0 else range(t - 1, -1, -1):
        n = int(live[s])
        if not n:
            continue
        st, aa, gg, tt = state[:n], a[:, :n], g[:, :n], tmp[:, :n]
        for i in range(3):
            e[i].take(xs[s, :n], 0, out=aa[i], mode="clip")
            np.matmul(st, u[i], out=gg[i])
        zr = aa[:2]
        zr += gg[:2]
        np.abs(zr, out=tt)
        tt += 1
        zr /= tt
        zr *= 0.5
        zr += 0.5
        new, q = aa[2], gg[2]
        q += bias
        q *= zr[1]
        new += q
        np.abs(new, out=q)
        q += 1
        new /= q
        st -= new
        st *= zr[0]
        st += new
        if out is not None:
            out[s, :n] = st
    return state


def chunk_sums(m: Model, x: np.ndarray, lens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the position probabilities (B, languages), last states (2, B, H)) of rows from the states first (2, B, H)."""
    h, (b, t) = m.bn.shape[1], x.shape
    hs, last = np.zeros((2, t, b, h), np.float32), first.copy()
    for k in range(2):
        run(m, k, x, lens, last[k], hs[k])
    logits = hs[0].reshape(-1, h) @ m.v[:h]
    logits += hs[1].reshape(-1, h) @ m.v[h:]
    logits += m.c
    np.exp(logits, out=logits)  # states are within -1 and 1, so logits are bounded by the weights
    logits /= logits.sum(-1, keepdims=True)
    p = logits.reshape(t, b, -1)
    if lens[-1] == t:
        return p.sum(0), last
    return (p * (np.arange(t)[:, None] < lens)[..., None]).sum(0), last


def pooled(m: Model, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK, lanes: int = LANES, ahead: int = AHEAD) -> np.ndarray:
    """(texts, languages): mean position probabilities of texts data[start : start + size]; a size of 0 gives zeros.

    The states run through each text from its first byte to its last and back. Chunks are computed side by side from guesses
    of their first states; those whose guess isn't what the neighbour ends with are computed again, until all agree.
    """
    n = -(-sizes // chunk)
    of = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at, lens = starts[of] + nth * chunk, np.minimum(sizes[of] - nth * chunk, chunk)
    h, total = m.bn.shape[1], len(of)
    first, last, sums = np.zeros((2, total, h), np.float32), np.zeros((2, total, h), np.float32), np.zeros((total, len(m.langs)))
    after = np.nonzero(of[1:] == of[:-1])[0] + 1  # chunks with one before them; that one has one after it

    def groups(which: np.ndarray, most: int, skip: np.ndarray):
        which = which[np.argsort(-np.minimum(lens[which], most), kind="stable")]
        for s in range(0, len(which), lanes):
            g = which[s : s + lanes]
            size = np.minimum(lens[g], most)
            span = np.arange(int(size[0]))
            x = data[np.minimum((at[g] + skip[g])[:, None] + span, len(data) - 1)]
            yield g, x, size

    if len(after):
        none, end = np.zeros(total, int), np.maximum(lens - ahead, 0)
        for k, whose, to, skip in ((0, after - 1, after, end), (1, after, after - 1, none)):
            follow = np.full(total, -1)
            follow[whose] = to
            for g, x, size in groups(whose, ahead, skip):
                first[k, follow[g]] = run(m, k, x, size, np.zeros((len(g), h), np.float32))
    todo = np.arange(total)
    while len(todo):
        for g, x, size in groups(todo, chunk, np.zeros(total, int)):
            sums[g], last[:, g] = chunk_sums(m, x, size, first[:, g])
        off = [np.abs(last[0, after - 1] - first[0, after]).max(1, initial=0) > SAME, np.abs(last[1, after] - first[1, after - 1]).max(1, initial=0) > SAME]
        right, left = after[off[0]], after[off[1]] - 1
        first[0, right], first[1, left] = last[0, right - 1], last[1, left + 1]
        todo = np.union1d(right, left)
    out = np.zeros((len(sizes), len(m.langs)))
    np.add.at(out, of, sums)
    return out / np.maximum(sizes, 1)[:, None]


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, has_letter: Column | None = None) -> DataFrame:
    """The kept columns (default: all) with lang_pred and score added (columns of these names are replaced).

    und with score 0 where the text is null or has no letter, or where the model knows no language. Rows are independent: an
    empty table gives an empty result, repeated rows equal ones. Memory is bound by an Arrow batch.
    """
    docs = docs.drop("lang_pred", "score")
    keep = docs.columns if keep is None else keep
    t_, l_ = fresh(docs, "whole_text", "lettered")
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) if has_letter is None else has_letter
    langs = np.array([*model.langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, letters = b.column(b.num_columns - 2).cast(pa.large_binary()), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            _, offsets, raw = text.buffers()
            ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
            sizes = np.where(letters, np.diff(ends), 0)
            if model.langs:
                p = pooled(model, data, ends[:-1], sizes)
                best, score = p.argmax(1), np.minimum(p.max(1, initial=0), 1.0)
            else:
                best, score = np.zeros(len(text), int), np.zeros(len(text))
            best = np.where(letters, best, len(model.langs))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(langs[best], pa.string()), pa.array(np.where(letters, score, 0.0))], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col(text_col).cast("string").alias(t_), has_letter.alias(l_)).mapInArrow(run, schema)


def fit(docs: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", n_docs: int = TRAIN_DOCS, n_windows: int = TRAIN_WINDOWS, steps: int = STEPS, seed: str = "langid-v1", **kw) -> Model:
    """Train on n_docs texts or so (a language, if there are more of these) of the allowed rows with a language, shared evenly
    among the languages as far as they go; of each, on n_windows runs of `steps` characters from hashed places anywhere in it.

    Null texts and languages are left out; without rows the model knows no language. The counts are over all rows; the choice
    is by hash of the id, so that reruns agree.
    """
    have = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    counts = {r.lang: r["count"] for r in have.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return train([], [])
    n_docs = max(n_docs, len(counts))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("id", F.lit("")))), 1, 12), 16, 10).cast("long") / float(1 << 48)
    share = F.create_map(*[F.lit(x) for k, v in sorted(counts.items()) for x in (k, float(n_docs / len(counts) / v))])[F.col("lang")]
    pick = have.withColumn("u", draw / share).where("u < 1.2").orderBy("u", "id", F.xxhash64("text")).limit(n_docs)
    size = F.greatest(F.char_length("text") - steps + 1, F.lit(1))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n_windows - 1)), lambda i: (F.pmod(F.xxhash64("id", F.lit(seed), i), size) + 1).cast("int")))
    cut_ = F.transform(places, lambda p: F.substring(F.col("text"), p, F.lit(steps)))
    rows = pick.select("u", "lang", "id", F.explode(cut_).alias("t")).collect()  # n_docs * n_windows at most
    rows.sort(key=lambda r: (r.u, r.id or "", r.t))
    return train([r.t.encode() for r in rows], [r.lang for r in rows], **kw)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
