"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths run over windows of WINDOW bytes, the maximum of each filter over
a window is kept, and a softmax over these gives the window's language. A text is the mean of its windows'
logits, over the whole text. For prediction embedding and filters are folded into tables over byte pairs, so a
filter's response is a sum of one or two table rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import buffers, chunks, mapped, texts

WINDOW = 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
#: Bounds of the training sample: texts of each language, and of all; windows of each text. Languages that one round of
#: STEPS is enough for.
TEXTS, ALL_TEXTS, WINDOWS, LANGUAGES = 400, 80_000, 4, 200
STEPS, BATCH = 500, 64
UNKNOWN = "und"


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"emb": r.normal(0, 0.5, (256, EMBED)).astype("f4"), "out": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype("f4"), "bias": np.zeros(len(labels), "f4")}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype("f4")
            self.p[f"b{w}"] = np.zeros(FILTERS, "f4")

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch of windows."""
        p, n, pooled, kept = self.p, len(x), [], []
        e = p["emb"][x]
        for w in WIDTHS:
            cols = np.concatenate([e[:, k : x.shape[1] - w + 1 + k] for k in range(w)], axis=2)
            resp = cols @ p[f"w{w}"]
            at = resp.argmax(1)
            top = np.take_along_axis(resp, at[:, None], 1)[:, 0] + p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
            kept.append((cols, at, top > 0))
        h = np.concatenate(pooled, 1)
        z = h @ p["out"] + p["bias"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        loss = -np.log(q[np.arange(n), y] + 1e-9).mean()
        dz = q
        dz[np.arange(n), y] -= 1
        dz /= n
        g = {"out": h.T @ dz, "bias": dz.sum(0), "emb": np.zeros_like(p["emb"])}
        dh = dz @ p["out"].T
        for i, w in enumerate(WIDTHS):
            cols, at, on = kept[i]
            d = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            seen = cols[np.arange(n)[:, None], at]  # the patch that each filter's maximum saw
            g[f"w{w}"] = np.einsum("nf,nfc->cf", d, seen)
            g[f"b{w}"] = d.sum(0)
            back = d[:, :, None] * p[f"w{w}"].T[None]
            for k in range(w):
                np.add.at(g["emb"], x[np.arange(n)[:, None], at + k], back[:, :, k * EMBED : (k + 1) * EMBED])
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> "ByteCNN":
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        for t in range(1, steps + 1):
            # languages are drawn evenly; part of the windows is cut short, as short texts are
            pick = np.array([r.choice(by[k]) for k in r.integers(0, len(by), BATCH)])
            b = x[pick].copy()
            for i in np.flatnonzero(r.random(BATCH) < 0.3):
                b[i, int(r.integers(16, WINDOW)) :] = 32
            _, g = self._step(b, y[pick])
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                self.p[k] = (self.p[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype("f4")
        return self

    def tables(self) -> dict:
        """Responses of each filter to byte pairs, and to single bytes at the end of odd widths."""
        out = {"out": self.p["out"], "bias": self.p["bias"]}
        for w in WIDTHS:
            t = [self.p["emb"] @ self.p[f"w{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)]
            t[0] = t[0] + self.p[f"b{w}"]
            parts = [(k, (t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS)) for k in range(0, w - 1, 2)]
            out[w] = parts + ([(w - 1, t[w - 1])] if w % 2 else [])
        return out


def windows(text: bytes) -> np.ndarray:
    """The text's windows, the last one filled with spaces."""
    k = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(k * WINDOW), np.uint8).reshape(k, WINDOW)


def logits(tables: dict, x: np.ndarray) -> np.ndarray:
    pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
    pooled = []
    for w in WIDTHS:
        n, resp = WINDOW - w + 1, None
        for k, t in tables[w]:
            got = t[pair[:, k : k + n]] if len(t) == 65536 else t[x[:, k : k + n]]
            resp = got if resp is None else np.add(resp, got, out=resp)
        pooled.append(np.maximum(resp.max(1), 0))
    return np.concatenate(pooled, 1) @ tables["out"] + tables["bias"]


def sample(docs: DataFrame, texts_each: int = TEXTS, texts_all: int = ALL_TEXTS) -> list[tuple[str, bytes]]:
    """(lang, bytes) of about texts_each rows of each language, chosen by a hash of doc_id, and fewer of each where that
    gives more than texts_all (100 MB at most on the driver): a text of up to WINDOWS windows whole, of a longer one
    WINDOWS + 1 windows at hashed places anywhere in it. docs: the rows that may be learnt from. Counts are taken over
    all of them; every language with that many rows is learnt."""
    counts = docs.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"))
    names = counts.count()
    each = min(texts_each, max(1, texts_all // max(1, names)))
    share = counts.select("_lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("_n")).alias("_share"))
    share = F.broadcast(share) if names <= 1 << 17 else share
    rows = docs.join(share, F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < F.col("_share") * (1 << 20))
    raw, n = F.encode("text", "UTF-8"), F.octet_length("text")
    at = [F.pmod(F.xxhash64("doc_id", F.lit(4 + i)), n - WINDOW + 1).cast("int") + 1 for i in range(WINDOWS + 1)]
    parts = F.when(n <= WINDOW * WINDOWS, F.array(raw)).otherwise(F.array(*[raw.substr(x, F.lit(WINDOW)) for x in at]))
    return sorted((r["lang"], bytes(r["part"])) for r in rows.select("lang", F.explode(parts).alias("part")).collect())


def train(rows: list[tuple[str, str | bytes]], steps: int = STEPS) -> ByteCNN | None:
    """A model of texts: all windows of one that has up to WINDOWS and one that begins anywhere, WINDOWS + 1 of those
    of a longer one. Steps grow with the languages beyond LANGUAGES."""
    labels = sorted({a for a, _ in rows})
    if not labels:
        return None
    place = {k: i for i, k in enumerate(labels)}
    x, y, r = [], [], np.random.default_rng(5)
    for lang, text in rows:
        raw = text if isinstance(text, bytes) else text.encode()
        whole = len(raw) <= WINDOW * WINDOWS
        own = list(windows(raw)) if whole else []
        for _ in range((len(raw) > WINDOW) if whole else WINDOWS + 1):  # windows begin anywhere in a word
            at = int(r.integers(0, len(raw) - WINDOW + 1))
            own.append(np.frombuffer(raw[at : at + WINDOW], np.uint8))
        x += own
        y += [place[lang]] * len(own)
    steps *= -(-len(labels) // LANGUAGES)
    return ByteCNN(labels).fit(np.array(x), np.array(y), steps)


def predict(docs: DataFrame, model: ByteCNN | None, *more: str) -> DataFrame:
    """doc_id, more columns, lang_pred and score of each text. A null text and one without a letter are
    UNKNOWN with score 0; so is all if nothing was learnt. doc_id, lang and source are no inputs. Repeated rows
    get equal predictions; an empty table gives an empty result."""
    docs = texts(docs, *[c for c in more if c != "text"], (F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).alias("_letter"))
    kinds = dict(docs.dtypes)
    names = ["doc_id", *more]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double"
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.p.items()})  # some 30 KB
    labels = model.labels

    def run(batches):
        m = ByteCNN(labels)
        m.p = held.value
        tables = m.tables()
        for b in batches:
            off, data = buffers(b.column("text"))
            letter = b.column("_letter").to_pylist()
            pred, score = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
            for lo, hi in chunks(off):
                rows = [i for i in range(lo, hi) if letter[i]]
                if not rows:
                    continue
                size = [max(1, int(-(-(off[i + 1] - off[i]) // WINDOW))) for i in rows]
                x = np.full((sum(size), WINDOW), 32, np.uint8)
                flat, at = x.reshape(-1), 0
                for i, k in zip(rows, size):
                    flat[at : at + off[i + 1] - off[i]] = data[off[i] : off[i + 1]]
                    at += k * WINDOW
                z = np.concatenate([logits(tables, x[a : a + 128]) for a in range(0, len(x), 128)])
                first = np.cumsum(size) - size
                z = np.add.reduceat(z, first, axis=0) / np.array(size)[:, None]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                for i, k, q in zip(rows, z.argmax(1).tolist(), z.max(1).tolist()):
                    pred[i], score[i] = labels[k], min(1.0, q)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(pred), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return mapped(docs, run, schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame) -> ByteCNN | None:
    """A model of the labelled texts that are not held out."""
    return train(sample(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")))
