"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word enters as characters and as a whole: the mean of learned vectors of its hashed character 3- to 5-grams (with marks
at its ends) and a learned vector of the hashed word. Windows of ``WINDOW`` words, each half overlapping the next, run
through a gated recurrent unit in both directions; attention weighs the states, and a text's score is that of its highest
window, over all its windows. All that tells toxic from clean is learned by the network from texts and their labels.

Training uses a bounded sample, in one task, which returns the parameters: at most ``PER_CLASS`` labelled documents of the
classes, the first by a hash of doc_id, never those held out (crc32 of doc_id mod 5 is 0), one text for each doc_id. At
first windows drawn at random learn the label of their text; then every text learns by its highest windows. Grams and
words that fewer than two, or one in ``FEWEST``, of the sampled texts have get no vector, so that no text is learned by heart. A fifth of the
sample is kept out of the fit and sets the bias.

Nulls: a null text is empty; an empty text has no window and gets the score of the bias alone. A null doc_id counts as
not held out and is never trained on. Rows with repeated doc_id are scored each on its own; where a doc_id has several
labels the toxic one counts, and of several texts the first by a hash. A very long text is scored in all its windows; in
training it gives at most ``DRAWN`` windows a round. With labels of one class or none the score is 0.5 less a margin for all
(predicted 0). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, WordHasher, mix, small_batches, stored, texts, utf8

WINDOW, STRIDE = 24, 12
PER_CLASS = (1500, 1000)  # clean, toxic
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
SIZE, HIDDEN = 10, 8
FEWEST = 230  # one text in so many, and two at least, must have a gram or word that gets a vector
DRAWN = 6
EARLY, LATE = 12, 2  # rounds with windows drawn at random, and with the highest ones
STEPS = 200  # of each kind at least, so that small samples are learnt too
BATCH = 192


class Words:
    """Distinct words of a batch, their gram buckets, and the texts as indices of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: WordHasher):
        starts, ends = hasher.spans(data, offsets)
        hashes = hasher.hashes(data, starts, ends)
        own, first, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.cut = np.searchsorted(starts, offsets)
        self.n = len(own)
        self.word = (own >> np.uint64(40)).astype(np.int64) % BUCKETS
        # characters of the distinct words, each between two marks
        size = ends[first] - starts[first] + 2
        edge = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(self.n), size)
        place = np.arange(edge[-1]) - edge[owner]
        letters = np.zeros(edge[-1], np.uint64)
        inner = (place > 0) & (place < size[owner] - 1)
        letters[inner] = hasher.value[data[starts[first][owner[inner]] + place[inner] - 1]]
        grams, owners = [], []
        for n in GRAMS:
            fits = np.flatnonzero(place <= size[owner] - n)
            h = np.full(len(fits), n, np.uint64)
            for k in range(n):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + letters[fits + k])
            grams.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(owner[fits])
        order = np.argsort(np.concatenate(owners), kind="stable") if self.n else np.zeros(0, np.int64)
        self.gram = np.concatenate(grams)[order]
        self.owner = np.concatenate(owners)[order]
        self.edge = np.searchsorted(self.owner, np.arange(self.n + 1))

    def part(self, windows: np.ndarray) -> tuple[Words, np.ndarray]:
        """Only the words of these windows, and the windows with indices of those."""
        own, local = np.unique(windows, return_inverse=True)
        out = Words.__new__(Words)
        kept = own[own < self.n]
        size = np.diff(self.edge)[kept]
        out.n, out.word, out.edge = len(kept), self.word[kept], np.concatenate([[0], np.cumsum(size)])
        out.owner = np.repeat(np.arange(out.n), size)
        out.gram = self.gram[np.repeat(self.edge[kept], size) + np.arange(out.edge[-1]) - out.edge[out.owner]]
        return out, local.reshape(windows.shape)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows, WINDOW) word indices, self.n where a window is not full, and each window's text."""
        n = np.diff(self.cut)
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        text = np.repeat(np.arange(len(n)), count)
        start = self.cut[text] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        at = start[:, None] + np.arange(WINDOW)
        inside = at < self.cut[text + 1][:, None]
        padded = np.concatenate([self.index, [self.n]])
        return np.where(inside, padded[np.minimum(at, len(self.index))], self.n), text


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, the forward pass, and the gradient of the mean log loss over windows."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        inputs = SIZE
        self.p = {
            "gram": (0.02 * r.standard_normal((BUCKETS, SIZE))).astype(np.float32), "word": (0.02 * r.standard_normal((BUCKETS, SIZE))).astype(np.float32),
            "x": draw(2, inputs, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "u": draw(2, HIDDEN, 3 * HIDDEN), "c": np.zeros((2, 1, HIDDEN), np.float32),
            "a": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN, 1), "o": draw(2 * HIDDEN, 1), "d": np.full((1,), -1, np.float32),
        }

    def vectors(self, w: Words) -> np.ndarray:
        """Input vectors of the distinct words."""
        if not w.n:
            return np.zeros((0, SIZE), np.float32)
        count = np.maximum(np.diff(w.edge), 1)[:, None].astype(np.float32)
        at = np.minimum(w.edge[:-1], max(0, len(w.gram) - 1))
        return (np.add.reduceat(self.p["gram"][w.gram], at, axis=0) / count + self.p["word"][w.word]).astype(np.float32)

    def forward(self, vectors: np.ndarray, windows: np.ndarray, keep: bool = False):
        p, h_n = self.p, HIDDEN
        steps = np.stack([windows, windows[:, ::-1]])
        projected = np.concatenate([np.matmul(vectors[None], p["x"]) + p["b"], np.zeros((2, 1, 3 * h_n), np.float32)], 1)
        mask = (steps < len(vectors)).astype(np.float32)[..., None]
        h = np.zeros((2, len(windows), h_n), np.float32)
        states = np.empty((WINDOW, 2, len(windows), h_n), np.float32)
        saved = []
        for t in range(WINDOW):
            x = np.stack([projected[0][steps[0, :, t]], projected[1][steps[1, :, t]]])
            g = np.matmul(h, p["u"])
            zr = _sigmoid(x[..., :2 * h_n] + g[..., :2 * h_n])
            z, r = zr[..., :h_n], zr[..., h_n:]
            inner = g[..., 2 * h_n:] + p["c"]
            n = np.tanh(x[..., 2 * h_n:] + r * inner)
            m = mask[:, :, t]
            new = m * ((1 - z) * n + z * h) + (1 - m) * h
            if keep:
                saved.append((h, z, r, inner, n, m))
            h = states[t] = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], 2).transpose(1, 0, 2)
        deep = np.tanh(both @ p["a"])
        e = (deep @ p["v"])[..., 0] - 1e9 * (windows >= len(vectors))
        w = np.exp(e - e.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        context = (w[..., None] * both).sum(1)
        logit = (context @ p["o"])[:, 0] + p["d"][0]
        return (logit, (steps, saved, both, deep, w, context)) if keep else logit

    def gradient(self, w: Words, vectors: np.ndarray, windows: np.ndarray, label: np.ndarray) -> dict:
        p, h_n = self.p, HIDDEN
        logit, (steps, saved, both, deep, weight, context) = self.forward(vectors, windows, True)
        d = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)[:, None]
        g = {"o": context.T @ d, "d": d.sum(0)}
        d_context = d @ p["o"].T
        d_weight = (both * d_context[:, None]).sum(2)
        d_e = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["v"] = np.einsum("bth,bt->h", deep, d_e)[:, None]
        d_deep = d_e[..., None] * p["v"][:, 0] * (1 - deep**2)
        g["a"] = np.einsum("btk,bth->kh", both, d_deep)
        d_both = weight[..., None] * d_context[:, None] + d_deep @ p["a"].T
        outer = np.stack([d_both[..., :h_n].transpose(1, 0, 2), d_both[..., h_n:].transpose(1, 0, 2)[::-1]], 1)
        g["u"], g["c"] = np.zeros_like(p["u"]), np.zeros_like(p["c"])
        every = np.empty((WINDOW, 2, len(windows), 3 * h_n), np.float32)
        d_h = np.zeros_like(saved[0][0])
        for t in range(WINDOW - 1, -1, -1):
            h, z, r, inner, n, m = saved[t]
            d_new = (d_h + outer[t]) * m
            d_n = d_new * (1 - z) * (1 - n**2)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * inner * r * (1 - r)
            d_inner = d_n * r
            d_x = np.concatenate([d_z, d_r, d_n], 2)
            d_g = np.concatenate([d_z, d_r, d_inner], 2)
            every[t] = d_x
            g["u"] += np.matmul(h.transpose(0, 2, 1), d_g)
            g["c"] += d_inner.sum(1, keepdims=True)
            d_h = (d_h + outer[t]) * (1 - m) + d_new * z + np.matmul(d_g, p["u"].transpose(0, 2, 1))
        d_projected = np.zeros((2, len(vectors) + 1, 3 * h_n), np.float32)
        for k in range(2):  # sums over the places of each word
            place = steps[k].T.ravel()
            order = np.argsort(place, kind="stable")
            own, first = np.unique(place[order], return_index=True)
            d_projected[k][own] = np.add.reduceat(every[:, k].reshape(-1, 3 * h_n)[order], first)
        d_projected = d_projected[:, :-1]
        g["x"] = np.matmul(vectors.T[None], d_projected)
        g["b"] = d_projected.sum(1, keepdims=True)
        d_vectors = np.matmul(d_projected, p["x"].transpose(0, 2, 1)).sum(0)
        used = np.flatnonzero(np.abs(d_vectors).sum(1))
        g["word"] = (w.word[used], d_vectors[used])
        count = np.maximum(np.diff(w.edge), 1)[:, None]
        own = np.isin(w.owner, used)
        g["gram"] = (w.gram[own], (d_vectors / count)[w.owner[own]])
        return g


def _all_logits(net: Network, w: Words, windows: np.ndarray) -> np.ndarray:
    vectors = net.vectors(w)
    parts = [net.forward(vectors, windows[k:k + 2048]) for k in range(0, len(windows), 2048)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def _highest(text: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    """The index of each text's highest window, -1 for texts without one."""
    out = np.full(n, -1)
    order = np.lexsort((logit, text))
    out[text[order]] = order  # the last one written is the highest
    return out


def _rare(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of grams and of words that too few of the n texts have."""
    texts_with = np.zeros((2, BUCKETS), np.int64)
    size = np.diff(w.edge)
    for i, j in zip(w.cut[:-1].tolist(), w.cut[1:].tolist(), strict=True):
        own = np.unique(w.index[i:j])
        gram = w.gram[np.repeat(w.edge[own], size[own]) + np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])]
        texts_with[0][np.unique(gram)] += 1
        texts_with[1][np.unique(w.word[own])] += 1
    fewest = max(2, n // FEWEST)
    return np.flatnonzero(texts_with[0] < fewest), np.flatnonzero(texts_with[1] < fewest)


def train(bodies: list[str], labels: list[int], early: int = EARLY, late: int = LATE, seed: int = 3) -> Network:
    import pyarrow as pa

    net, y = Network(seed), np.array(labels, np.float32)
    w = Words(*utf8(pa.array(bodies, pa.string())), WordHasher(ALNUM))
    windows, text = w.windows()
    rare = dict(zip(("gram", "word"), _rare(w, len(y)), strict=True))
    for name, own in rare.items():
        net.p[name][own] = 0
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    fitted = r.random(len(y)) < 0.8
    share = np.array([0.5 / max(1, (fitted & (y == k)).sum()) for k in (0, 1)])  # of a text in what is drawn
    edge = np.searchsorted(text, np.arange(len(y) + 1))
    step = 0

    def learn(chosen: np.ndarray) -> None:
        nonlocal step
        for k in range(0, len(chosen), BATCH):
            own = chosen[k:k + BATCH]
            part, local = w.part(windows[own])
            step += 1
            gradient = net.gradient(part, net.vectors(part), local, y[text[own]])
            _adam(net, gradient, first, second, step)
            for name, away in rare.items():
                net.p[name][gradient[name][0][np.isin(gradient[name][0], away)]] = 0

    having = np.flatnonzero(fitted & (np.diff(edge) > 0))
    if len(having):
        chance = share[y[having].astype(np.int64)]
        chance = chance / chance.sum()
        for phase, least in ((0, early), (1, late)):
            rounds, start = 0, step
            while rounds < least or step - start < STEPS:
                rounds += 1
                if phase == 0:
                    drawn = r.choice(having, DRAWN // 2 * len(having), p=chance)
                    learn(edge[drawn] + (r.random(len(drawn)) * (edge[drawn + 1] - edge[drawn])).astype(np.int64))
                    continue
                # toxic texts teach by their highest window, clean ones by their highest, runners-up and some at random
                logit = _all_logits(net, w, windows)
                best = _highest(text, logit, len(y))
                clean = np.flatnonzero((fitted & (y == 0))[text])
                hard = clean[np.argsort(-logit[clean])[:2 * len(having)]]
                toxic = best[having[y[having] == 1]]
                weak = best[having[y[having] == 0]]
                again = r.choice(toxic, len(weak), True) if len(toxic) else toxic
                pick = lambda own, n: r.choice(own, min(len(own), n), False)
                learn(r.permutation(np.concatenate([toxic, again, weak, pick(hard, len(having) // 2), pick(clean, len(having))])))
    # texts kept out of the fit set the bias: halfway between the classes where errors are fewest
    logit = _all_logits(net, w, windows)
    best = _highest(text, logit, len(y))
    kept = np.flatnonzero(~fitted & (best >= 0))
    if len(np.unique(y[kept])) == 2:
        order = np.argsort(logit[best[kept]])
        value, label = logit[best[kept]][order], y[kept][order]
        wrong = np.concatenate([[0], np.cumsum(label)]) / label.sum() + (len(label) - label.sum() - np.concatenate([[0], np.cumsum(1 - label)])) / (1 - label).sum()
        k = int(np.flatnonzero(wrong == wrong.min()).mean())
        net.p["d"] -= np.float32((value[max(0, k - 1)] + value[min(len(value) - 1, k)]) / 2)
    return net


def _adam(net: Network, gradient: dict, first: dict, second: dict, step: int) -> None:
    for name, d in gradient.items():
        at, speed = slice(None), 0.005
        if isinstance(d, tuple):
            at, inverse = np.unique(d[0], return_inverse=True)
            full = np.zeros((len(at), SIZE), np.float32)
            np.add.at(full, inverse, d[1])
            d, speed = full, 0.01
        first[name][at] = 0.9 * first[name][at] + 0.1 * d
        second[name][at] = 0.99 * second[name][at] + 0.01 * d**2
        rate = speed / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
        net.p[name][at] -= (rate * first[name][at] / (np.sqrt(second[name][at]) + 1e-6)).astype(np.float32)


def sampled(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int]) -> DataFrame:
    """At most ``per_class`` labelled texts of the classes (clean, toxic) outside the held-out fold: doc_id, text, toxic."""
    usable = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rank = F.xxhash64("doc_id")
    picked = [usable.where(F.col("toxic") == k).orderBy(rank, "doc_id").limit(per_class[k]) for k in (0, 1)]
    own = texts(docs.where("doc_id is not null"), F.col("doc_id").cast("long").alias("doc_id"))
    # at most sum(per_class) ids are sent
    found = own.join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Network | None:
    """The network, trained by one task on the sample; the driver gets its parameters (a fixed size)."""
    def run(batches):
        import pyarrow as pa

        rows = sorted((r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist())
        if len({r[2] for r in rows}) == 2:
            net = train([r[1] for r in rows], [r[2] for r in rows])
            out = io.BytesIO()
            np.savez_compressed(out, **net.p)
            yield pa.record_batch([pa.array([out.getvalue()], pa.binary())], names=["parameters"])

    sample = stored(sampled(docs, labels, per_class), "labelled")
    found = stored(sample.repartition(1).mapInArrow(run, "parameters binary"), "network").collect()
    if not found:
        return None
    net = Network()
    net.p = dict(np.load(io.BytesIO(found[0][0])))
    return net


def score_documents(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    net = fit(docs, labels, per_class)
    shared = spark.sparkContext.broadcast(net)  # a fixed number of parameters

    def run(batches):
        import pyarrow as pa

        net, hasher = shared.value, WordHasher(ALNUM)
        for b in batches:
            n = b.num_rows
            if net is None:
                score, count = np.full(n, 0.49), np.zeros(n, np.int64)
            else:
                w = Words(*utf8(b.column(1)), hasher)
                windows, text = w.windows()
                logit = _all_logits(net, w, windows)
                best = _highest(text, logit, n)
                top = np.append(logit, min(net.p["d"][0], -0.1))[best]  # -1: the bias, never a reason to reject
                score, count = 1 / (1 + np.exp(-np.clip(top.astype(np.float64), -50, 50))), np.bincount(text, minlength=n)
            yield pa.record_batch([b.column(0), pa.array(score.astype(np.float64)), pa.array(count.astype(np.int64))], names=["doc_id", "score", "n_windows"])

    scored = texts(docs, "doc_id").mapInArrow(run, "doc_id long, score double, n_windows long")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_windows")
