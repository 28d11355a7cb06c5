"""Language identification: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

The network reads the bytes of a whole text, white space among them, forwards and backwards, and gives each byte position a
distribution over the languages. A document's distribution is the mean of the logarithms of its positions' distributions,
normalised.

A text is read in windows of ``STRIDE`` bytes that overlap: each direction starts ``CONTEXT`` bytes before the positions that it
labels (or at the text's edge), so every position is labelled with at least that much of the text behind its state. Windows of
many texts are computed side by side, and a text of any length in windows of one size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents of each language that the network learns from, at most; pieces of each, and characters of a piece.
SAMPLE, PIECES, PIECE = 600, 6, 64
#: The size and number of the steps of the training.
BATCH, STEPS = 160, 350
HIDDEN, RATE, SEED = 8, 0.02, 8
#: Bytes that a window labels, bytes read before and behind them, windows computed side by side.
STRIDE, CONTEXT, ABREAST = 384, 24, 1024
#: Stands for no byte; it does not move a state.
PAD = 256
UNKNOWN = "und"
#: A document whose best language has a smaller share than this is rejected by the pipeline's stage.
LEAST_SHARE = 0.4

_letter = regex.compile(r"\p{L}")


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def pad(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte values (time x runs), zero after the end of a run, and the runs' lengths."""
    sizes = np.array([len(r) for r in runs])
    out = np.zeros((len(runs), max(1, sizes.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(runs), np.uint8)
    return out.T.copy(), sizes


class Gru:
    """One direction. Weights: x (256 x 3H, looked up by byte), u (H x 3H), b is part of x. Gates: update, reset, candidate."""

    def __init__(self, hidden: int, rng):
        self.x = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.hidden = hidden

    def forward(self, bytes_: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time x runs x H); a state does not move where a run is over."""
        h, n = np.zeros((bytes_.shape[1], self.hidden), np.float32), self.hidden
        states, kept = np.zeros((*bytes_.shape, n), np.float32), []
        for t in range(len(bytes_)):
            x, hu = self.x[bytes_[t]], h @ self.u[:, : 2 * n]
            gates = _sigmoid(x[:, : 2 * n] + hu)
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(x[:, 2 * n :] + (r * h) @ self.u[:, 2 * n :])
            on = alive[t][:, None]
            new = np.where(on, h + z * (c - h), h)
            kept.append((h, z, r, c))
            states[t] = h = new
        return states, kept

    def backward(self, bytes_: np.ndarray, alive: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of x and u by backpropagation through time; grad: of the states."""
        n = self.hidden
        gx, gu, carry = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(grad[0])
        for t in range(len(bytes_) - 1, -1, -1):
            h, z, r, c = kept[t]
            on = alive[t][:, None]
            total = carry + grad[t]
            d = np.where(on, total, 0)
            dc = d * z * (1 - c * c)
            dz = d * (c - h) * z * (1 - z)
            drh = dc @ self.u[:, 2 * n :].T
            dr = drh * h * r * (1 - r)
            gates = np.concatenate([dz, dr], axis=1)
            carry = np.where(on, d * (1 - z) + drh * r + gates @ self.u[:, : 2 * n].T, total)
            gu[:, : 2 * n] += h.T @ gates
            gu[:, 2 * n :] += (r * h).T @ dc
            np.add.at(gx, bytes_[t], np.concatenate([gates, dc], axis=1))
        return gx, gu

    def states(self, bytes_: np.ndarray) -> np.ndarray:
        """States (time x H x runs) without what training needs. ``bytes_`` are indices; ``PAD`` leaves a state as it is."""
        n, (length, width) = self.hidden, bytes_.shape
        x, gates_of, candidate_of = np.zeros((3 * n, PAD + 1), self.x.dtype), -self.u[:, : 2 * n].T, np.ascontiguousarray(self.u[:, 2 * n :].T)
        x[:, :PAD] = self.x.T
        x[: 2 * n] *= -1
        x[:n, PAD] = 80  # the update gate is shut
        out, h = np.empty((length, n, width), self.x.dtype), np.zeros((n, width), self.x.dtype)
        for t in range(length):
            drive = np.take(x, bytes_[t], axis=1, mode="clip")
            gates = gates_of @ h
            gates += drive[: 2 * n]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            c = candidate_of @ (gates[n:] * h)
            c += drive[2 * n :]
            np.tanh(c, out=c)
            c -= h
            c *= gates[:n]
            h = np.add(h, c, out=out[t])
        return out


class ByteTagger:
    """Both directions and a softmax over the languages at each position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.ahead, self.back = languages, Gru(hidden, rng), Gru(hidden, rng)
        self.w = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.b = np.zeros(len(languages), np.float32)

    @staticmethod
    def _turned(bytes_: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the backward direction: each run reversed, and the places to read it from."""
        t = np.arange(len(bytes_))[:, None]
        at = np.where(t < sizes, sizes - 1 - t, t)
        return np.take_along_axis(bytes_, at, axis=0), at

    def _states(self, bytes_: np.ndarray, sizes: np.ndarray):
        alive = np.arange(len(bytes_))[:, None] < sizes
        turned, at = self._turned(bytes_, sizes)
        f, kf = self.ahead.forward(bytes_, alive)
        b, kb = self.back.forward(turned, alive)
        return np.concatenate([f, np.take_along_axis(b, at[:, :, None], axis=0)], axis=2), alive, turned, at, kf, kb

    def label(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (time x runs x languages) of every position, and which positions are in a run."""
        bytes_, sizes = pad(runs)
        states, alive, *_ = self._states(bytes_, sizes)
        logits = states @ self.w + self.b
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), alive

    def sums(self, bytes_: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For each window (column of ``bytes_``) the sum of the log-probabilities of ``count`` positions from ``first`` on."""
        f, b, n = self.ahead.states(bytes_), self.back.states(bytes_[::-1])[::-1], self.ahead.hidden
        out = np.zeros((bytes_.shape[1], len(self.languages)))
        for t in range(len(bytes_)):
            logits = self.w[:n].T @ f[t]
            logits += self.w[n:].T @ b[t]
            logits += self.b[:, None]
            logits -= logits.max(axis=0)
            logits -= np.log(np.exp(logits).sum(axis=0))
            logits *= (t >= first) & (t < first + count)
            out += logits.T
        return out

    def gradients(self, runs: list[bytes], target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over positions and its gradient for each of ``weights()``."""
        bytes_, sizes = pad(runs)
        states, alive, turned, at, kf, kb = self._states(bytes_, sizes)
        logits = states @ self.w + self.b
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        n, hidden = max(1, int(sizes.sum())), self.ahead.hidden
        picked = np.take_along_axis(p, np.broadcast_to(target, p.shape[:2])[:, :, None], axis=2)[:, :, 0]
        loss = -np.log(np.maximum(picked, 1e-9))[alive].sum() / n
        d = p.copy()
        d[:, np.arange(len(target)), target] -= 1
        d *= alive[:, :, None] / np.float32(n)
        gw, gb = np.einsum("tbh,tbl->hl", states, d), d.sum(axis=(0, 1))
        ds = d @ self.w.T
        gxf, guf = self.ahead.backward(bytes_, alive, kf, ds[:, :, :hidden])
        gxb, gub = self.back.backward(turned, alive, kb, np.take_along_axis(ds[:, :, hidden:], at[:, :, None], axis=0))
        return float(loss), [gxf, guf, gxb, gub, gw, gb]

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.u, self.back.x, self.back.u, self.w, self.b]

    def train(self, runs: list[bytes], target: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> ByteTagger:
        """Adam over random batches of runs."""
        rng, weights = np.random.default_rng(seed), self.weights()
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            at = rng.integers(0, len(runs), batch)
            _, grads = self.gradients([runs[i] for i in at], target[at])
            now = rate * (1 - step / (steps + 1))
            for w, g, a, b in zip(weights, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def trainable(doc_id) -> object:
    """Whether crc32 of the doc_id as text leaves a remainder other than 0 by 5 (a null doc_id: no)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def hashed_sample(rows: DataFrame, by: str, of: list[str], sample: int) -> DataFrame:
    """At most ``sample`` rows of each value of ``by``, those of the smallest hash of the columns ``of``, which differ in them.

    Different hashes are counted first (about), and only about eight times the sample, those under a bound, are ranked: what is
    ranked does not grow with the table, with the number of its partitions or with repeated rows.
    """
    at = F.pmod(F.xxhash64(*of), F.lit(1 << 60))
    share = F.least(F.lit(1.0), F.lit(8.0 * sample) / F.approx_count_distinct("at"))
    bound = F.least(F.lit((1 << 60) - 1), (share * (1 << 60)).cast("long")).alias("bound")
    drawn = rows.withColumn("at", at)
    low = drawn.join(F.broadcast(drawn.groupBy(by).agg(bound)), by).where("at <= bound").dropDuplicates([by, "at"])
    nth = F.row_number().over(Window.partitionBy(by).orderBy("at"))
    return low.withColumn("nth", nth).where(F.col("nth") <= sample).drop("at", "bound", "nth")


def train_on(docs: DataFrame, sample: int = SAMPLE) -> ByteTagger | None:
    """A network trained on pieces of at most ``sample`` different texts of each language, those of the smallest hash.

    Documents whose crc32(doc_id) is divisible by 5 are never learned from, nor are null or empty texts and null languages. None if there
    is nothing to learn from. Only ``PIECES`` pieces of ``PIECE`` characters of each sampled text reach the driver.
    """
    usable = docs.where(trainable("doc_id") & (F.length("text") > 0) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    room = F.greatest(F.lit(1), F.length("text") - PIECE + 1)
    pieces = F.array(*(F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(n)), room).cast("int") + 1, F.lit(PIECE)) for n in range(PIECES)))
    rows = hashed_sample(usable, "lang", ["doc_id", "text"], sample).select("doc_id", "lang", pieces.alias("pieces")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["pieces"]))
    languages = sorted({r["lang"] for r in rows})
    by = {lang: [p.encode("utf-8", "surrogatepass")[: 2 * PIECE] for r in rows if r["lang"] == lang for p in r["pieces"]] for lang in languages}
    # languages weigh alike: each is drawn with the same chance
    most = max(map(len, by.values()))
    runs = [by[lang][i % len(by[lang])] for lang in languages for i in range(most)]
    return ByteTagger(languages).train(runs, np.repeat(np.arange(len(languages)), most))


def score_texts(model: ByteTagger, texts: list[str]) -> np.ndarray:
    """A distribution for each text (texts x languages); an empty text has the uniform one."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    windows = -(-sizes // STRIDE)
    of = np.repeat(np.arange(len(parts)), windows)
    core = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
    start, stop = np.maximum(0, core - CONTEXT), np.minimum(sizes[of], core + STRIDE + CONTEXT)
    sums = np.zeros((len(parts), len(model.languages)))
    order = np.argsort(stop - start, kind="stable")
    for at in range(0, len(order), ABREAST):
        part = order[at : at + ABREAST]
        length = stop[part] - start[part]
        t = np.arange(length.max())[:, None]
        bytes_ = np.where(t < length, data[np.minimum(begin[of[part]] + start[part] + t, len(data) - 1)].astype(np.intp), PAD)
        count = np.minimum(STRIDE, sizes[of[part]] - core[part])
        np.add.at(sums, of[part], model.sums(bytes_, core[part] - start[part], count))
    mean = sums / np.maximum(1, sizes)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _told(model: ByteTagger | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text, about a megabyte of text at a time."""
    out, at = [], 0
    while at < len(texts):
        part, size = [], 0
        while at + len(part) < len(texts) and size < 1 << 20:
            part.append(texts[at + len(part)])
            size += len(part[-1] or "")
        known = [bool(model and t and _letter.search(t)) for t in part]
        p = score_texts(model, [t for t, k in zip(part, known, strict=True) if k]) if any(known) else np.zeros((0, 1))
        best = iter(zip(p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True))
        for k in known:
            nth, score = next(best) if k else (-1, 0.0)
            out.append((model.languages[nth] if k else UNKNOWN, score))
        at += len(part)
    return out


def predict(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter (empty texts), and everywhere without a model. Of languages
    with equal shares the first by name is taken. Only the text is looked at. held_out is false for a null doc_id. Repeated rows
    get the same language. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            told = _told(model, b["text"].to_pylist())
            out = [k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k in b["doc_id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.bool_()), pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train_on(docs))


def drop_unknown(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Documents without a recognised language go; all other rows stay as they are.

    These are null texts, texts without a letter, and texts whose best language has a share of the probability under ``least``:
    the network sees no language in them, or several. Where nothing can be learned (no labelled text), texts with a letter stay.
    """
    model = train_on(docs)

    def run(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            stay = [bool(t and _letter.search(t)) for t in texts] if model is None else [lang != UNKNOWN and share >= least for lang, share in _told(model, texts)]
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op8_langid": op8_langid}
ORACLE_SQL: dict[str, str] = {}
