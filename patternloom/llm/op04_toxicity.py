"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, on overlapping windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import LEXICON_WORDS, Lexicon, binaries, map_chunks, mix, neutral, neutral_name, offsets, prepare, read, tidy

#: Words of a window and words from one window to the next: every word lies in a window, most in two.
WIDTH, STRIDE = 40, 28
#: Rows of the two embedding tables, their width, units of each direction, units of the attention.
WORDS, CHARS, EMBED, UNITS, ATTEND = 1 << 13, 1 << 13, 8, 8, 8
#: Bound of the training sample: labelled rows of each class and characters of one of their texts.
SAMPLE, SAMPLE_CHARS = 1500, 8000
EPOCHS, STEPS, RATE, BATCH = 14, 350, 0.02, 128
#: Bytes of character n-grams; < marks the start of a word.
NGRAMS = (3, 4, 5, 6)
#: Lower-cased ASCII letters and non-ASCII characters make words; all else parts them.
LETTERS = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32) for c in range(256))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its row of the word table and its number of n-grams; the n-grams' rows, word by word.

    N-grams are of the bytes of "<" and the word; one shorter than all NGRAMS is one n-gram.
    """
    joined = np.frombuffer(b"<" + b"<".join(words), np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    off = offsets(lens)
    word = np.repeat(np.arange(len(words)), lens)
    left = off[1:][word] - np.arange(len(joined))
    code, found, of = np.zeros(len(joined), np.uint64), [], []
    for n in range(1, max(NGRAMS) + 1):
        code = code * np.uint64(0x100000001B3)
        code[: max(0, len(joined) - n + 1)] += joined[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            at = np.flatnonzero(left >= n)
        elif n < min(NGRAMS):
            at = off[:-1][lens == n]
        else:
            continue
        found.append((mix(code[at] + np.uint64(n)) % np.uint64(CHARS)).astype(np.int64))
        of.append(word[at])
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    rows = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(WORDS)
    return rows.astype(np.int64), np.bincount(of, minlength=len(words)), found[order]


class Words:
    """Distinct words and their features; index 0 is padding."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.lexicon = Lexicon()
        self.lexicon[b""] = 0
        self.rows, self.grams = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        self.count = [np.zeros(1, np.int64)]

    def index(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        index, lens = self.lexicon.index([t.translate(LETTERS).split() for t in texts])
        if self.lexicon.fresh:
            rows, count, grams = features(self.lexicon.fresh)
            self.rows.append(rows)
            self.count.append(count)
            self.grams.append(grams)
            self.lexicon.fresh = []
        return index, lens

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.rows, self.grams, self.count = ([np.concatenate(x)] for x in (self.rows, self.grams, self.count))
        return self.rows[0], self.grams[0], offsets(self.count[0])


def windows(index: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes of all windows, padded with 0, and the text of each; an empty text has one empty window."""
    off = offsets(lens)
    n = np.maximum(1, -(-(lens - (WIDTH - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(lens)), n)
    start = (np.arange(len(doc)) - np.repeat(offsets(n)[:-1], n)) * STRIDE
    win = np.zeros((len(doc), WIDTH), np.int32)
    for a in range(0, len(doc) if len(index) else 0, 8192):
        part = slice(a, a + 8192)
        place = start[part, None] + np.arange(WIDTH)
        inside = place < lens[doc[part]][:, None]
        win[part] = np.where(inside, index[np.where(inside, off[doc[part]][:, None] + place, 0)], 0)
    return win, doc


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Word and character inputs, a GRU each way, attention pooling, one logit."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d, h, a = 2 * EMBED, UNITS, ATTEND
        new = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {"word": new(WORDS, EMBED, scale=0.1), "char": new(CHARS, EMBED, scale=0.1), "wa": new(2 * h, a, scale=0.3), "va": new(a, scale=0.3), "w": new(2 * h, scale=0.3), "b": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": new(d, 3 * h, scale=0.4), f"h{way}": new(h, 3 * h, scale=0.3), f"c{way}": np.zeros(3 * h, np.float32)}

    def vectors(self, rows: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word: its embedding and the mean of its n-grams'."""
        n = np.diff(at)
        c = np.zeros((len(rows), EMBED), np.float32)
        full = n > 0
        if len(grams):
            c[full] = np.add.reduceat(self.p["char"][grams], at[:-1][full], axis=0) / n[full, None]
        x = np.concatenate([self.p["word"][rows], 4 * c], axis=1)
        x[0] = 0
        return x

    def run(self, x: np.ndarray, win: np.ndarray, keep: bool = False):
        """Logits of windows over distinct-word vectors x; with keep, what backward() needs."""
        n, width = win.shape
        h = UNITS
        real = win > 0
        states = np.zeros((width, n, 2 * h), np.float32)
        cache = {}
        for way, order in (("f", range(width)), ("b", range(width - 1, -1, -1))):
            pre = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
            u, s = self.p[f"h{way}"], np.zeros((n, h), np.float32)
            part = slice(0, h) if way == "f" else slice(h, 2 * h)
            steps = []
            for t in order:
                g = pre[win[:, t]]
                zr = sigmoid(g[:, : 2 * h] + s @ u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                hh = np.tanh(g[:, 2 * h :] + (r * s) @ u[:, 2 * h :])
                m = real[:, t, None]
                new = np.where(m, s + z * (hh - s), s)
                if keep:
                    steps.append((t, s, z, r, hh))
                s = new
                states[t, :, part] = s
            cache[way] = steps
        e = np.tanh(states @ self.p["wa"])
        score = np.where(real.T, e @ self.p["va"], np.float32(-30))
        score = np.exp(score - score.max(axis=0))
        score *= real.T
        att = score / np.maximum(score.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", att, states)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return (logit, (states, e, att, pooled, cache, real)) if keep else logit

    def backward(self, x: np.ndarray, win: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        states, e, att, pooled, cache, real = kept
        h = UNITS
        grad = {"w": pooled.T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["w"]
        dstates = att[:, :, None] * dpool[None]
        datt = np.einsum("nk,tnk->tn", dpool, states)
        ds = att * (datt - (att * datt).sum(axis=0))
        grad["va"] = np.einsum("tn,tna->a", ds, e)
        de = ds[:, :, None] * self.p["va"] * (1 - e * e)
        grad["wa"] = np.einsum("tnk,tna->ka", states, de)
        dstates = dstates + de @ self.p["wa"].T
        dx = np.zeros_like(x)
        for way in "fb":
            u = self.p[f"h{way}"]
            part = slice(0, h) if way == "f" else slice(h, 2 * h)
            du, dpre, carry = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32), 0
            for t, s, z, r, hh in reversed(cache[way]):
                m = real[:, t, None]
                d = dstates[t, :, part] + carry
                dn = d * m
                dh = dn * z * (1 - hh * hh)
                dz = dn * (hh - s) * z * (1 - z)
                drs = dh @ u[:, 2 * h :].T
                dr = drs * s * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                du[:, : 2 * h] += s.T @ dzr
                du[:, 2 * h :] += (r * s).T @ dh
                carry = d * ~m + dn * (1 - z) + drs * r + dzr @ u[:, : 2 * h].T
                np.add.at(dpre, win[:, t], np.concatenate([dzr, dh], axis=1))
            dpre[0] = 0
            grad |= {f"h{way}": du, f"x{way}": x.T @ dpre, f"c{way}": dpre.sum(axis=0)}
            dx += dpre @ self.p[f"x{way}"].T
        return grad, dx

    def train(self, texts: list[bytes], toxic: list[int], epochs: int = EPOCHS, seed: int = 11) -> None:
        """Multiple-instance training: a text is as toxic as its most toxic window, which alone gets the gradient."""
        words = Words()
        index, lens = words.index(texts)
        rows, grams, at = words.arrays()
        win, doc = windows(index, lens)
        y = np.array(toxic, np.float32)
        n = np.diff(at)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, step = np.random.default_rng(seed), 0
        epochs = max(epochs, -(-STEPS // -(-len(texts) // BATCH)))  # a small sample is gone through more often
        edge = offsets(np.bincount(doc, minlength=len(texts)))
        for epoch in range(epochs):
            x = self.vectors(rows, grams, at)
            logit = np.concatenate([self.run(x, win[i : i + 4096]) for i in range(0, len(win), 4096)])
            if epoch == 0:
                logit = rng.random(len(logit))  # any window to begin with
            top = np.array([a + logit[a:b].argmax() for a, b in zip(edge[:-1], edge[1:], strict=True)])
            order = rng.permutation(len(texts))
            rate = RATE * min(1, 2 * (1 - epoch / epochs))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                used, back = np.unique(win[top[pick]], return_inverse=True)
                if used[0] != 0:
                    used, back = np.append(0, used), back + 1
                w = back.reshape(len(pick), WIDTH)
                sub = offsets(n[used])
                g = grams[np.repeat(at[used] - sub[:-1], n[used]) + np.arange(sub[-1])]
                x = self.vectors(rows[used], g, sub)
                out, kept = self.run(x, w, keep=True)
                grad, dx = self.backward(x, w, kept, ((sigmoid(out) - y[pick]) / len(pick)).astype(np.float32))
                dx[0] = 0
                grad["word"] = np.zeros_like(self.p["word"])
                np.add.at(grad["word"], rows[used], dx[:, :EMBED])
                grad["char"] = np.zeros_like(self.p["char"])
                dc = 4 * dx[:, EMBED:] / np.maximum(n[used], 1)[:, None]
                np.add.at(grad["char"], g, np.repeat(dc, n[used], axis=0))
                step += 1
                for k, d in grad.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def scorer(self):
        """fn(texts) -> probability of each text; it remembers words between calls."""
        words, held = Words(), [np.zeros((0, 2 * EMBED), np.float32)]

        def score(texts: list[bytes]) -> np.ndarray:
            if len(words.lexicon) > LEXICON_WORDS:
                words.reset()
                held[0] = held[0][:0]
            index, lens = words.index(texts)
            have = len(held[0])
            if len(words.lexicon) > have:
                rows, grams, at = words.arrays()
                new = self.vectors(rows[have:], grams[at[have] :], at[have:] - at[have])
                if have:  # vectors() zeroes its first row, the padding
                    new[0] = np.concatenate([self.p["word"][rows[have]], 4 * self.p["char"][grams[at[have] : at[have + 1]]].mean(axis=0)])
                held[0] = np.concatenate([held[0], new])
            used, back = np.unique(index, return_inverse=True)
            x = np.concatenate([held[0][:1], held[0][used]])
            win, doc = windows(back + 1, lens)
            logit = np.concatenate([self.run(x, win[i : i + 4096]) for i in range(0, len(win), 4096)])
            n = np.bincount(doc, minlength=len(texts))
            return sigmoid(np.maximum.reduceat(logit, offsets(n)[:-1]).astype(np.float64))

        return score


def held_out(id: F.Column) -> F.Column:
    """Rows that never train: crc32 of the id as text is 0 modulo 5; a row without id is one too."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Network:
    """A network trained on at most `sample` documents of each class, those whose id hashes lowest among the labelled ones that
    are not held out and have at most sample_chars characters; labels of other ids, of null ids or other than 0 and 1 don't count,
    of several labels of an id the higher one does, and of several documents with an id the least text. Without labels of both
    classes it stays as it was made, and every score is the same low one."""
    prepare(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(F.col(id))).select(F.col(id).alias("i"), F.col(label).cast("int").alias("y")).groupBy("i").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.length("t") <= sample_chars)
    usable = usable.join(texts.select("i"), "i", "left_semi")  # ids alone are shuffled
    ranked = [usable.where(f"y = {y}").orderBy(F.xxhash64("i"), "i").limit(2 * sample) for y in (0, 1)]
    drawn = ranked[0].unionByName(ranked[1])
    both = texts.join(F.broadcast(drawn), "i")  # at most 4 * sample ids
    rows = both.groupBy("i").agg(F.min("y").alias("y"), F.min("t").alias("t"))

    def train(batches):
        rows = sorted(((xxhash.xxh64_intdigest(str(i)), i, y, t) for b in batches for i, y, t in zip(*b.to_pydict().values(), strict=True)), key=lambda r: r[:2])
        kept = [r for y in (0, 1) for r in [r for r in rows if r[2] == y][:sample]]
        net = Network()
        if len({r[2] for r in kept}) == 2:
            net.train([r[3].encode() for r in kept], [r[2] for r in kept])
            yield pa.RecordBatch.from_pydict({"name": list(net.p), "value": binaries([v.tobytes() for v in net.p.values()])})
        tidy()

    net = Network()
    # one task holds the bounded sample; the network it returns has about a megabyte
    trained = rows.repartition(1).mapInArrow(train, "name string, value binary").collect()
    for r in trained:
        net.p[r.name] = np.frombuffer(r.value, np.float32).reshape(net.p[r.name].shape)
    if not trained:
        net.p["w"][:] = 0
        net.p["b"][:] = -3
    return net


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with `score`: the probability that a text is toxic by its most toxic window; all windows of whole texts."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(net.p)
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name != "score"]

    def once():
        own = Network()
        own.p = held.value
        fn = own.scorer()

        def step(t: pa.Table, texts: list[bytes]) -> pa.Table:
            return t.append_column("score", pa.array(fn(texts), pa.float64()))

        return step

    return map_chunks(docs.select(*(F.col(f"`{n}`") for n, _ in fields)), text, None, ", ".join([*(f"`{n}` {t}" for n, t in fields), "score double"]), once=once, limit=2 << 20)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that score below threshold, with their own columns, whatever these are called."""
    plain = neutral(docs)
    i, t = neutral_name(docs, id), neutral_name(docs, text)
    net = fit(plain.select(F.col(i).alias(id), F.col(t).alias(text)), labels, id, text, **options)
    return score(plain, net, t).where(F.col("score") < threshold).select(*plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
