"""Quality classifier: a small byte-level convolutional network in numpy."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import free_name, stage, unstage, workers_find_package

#: Bytes a filter sees, filters, units above them.
WIDTH, FILTERS, UNITS = 5, 16, 12
#: A chunk is two halves of so many bytes; chunks overlap by a half.
HALF = 32
#: Bytes of a text that are in memory at a time, with their filters; bytes of short texts that go together.
PIECE, TOGETHER = 1 << 20, 1 << 17
#: Rows of a batch whose texts are copied at a time.
ROWS = 500
#: The training sample: so many rows of each label at most, those of least hash; of a longer text so many code points from its start; so many bytes of
#: each label together, one text at least.
SAMPLE, SAMPLE_TEXT, SAMPLE_BYTES = 700, 60_000, 8_000_000
EPOCHS, BATCH, RATE = 12, 16, 0.012


class Network:
    """Learned filters over each WIDTH bytes, rectified; in each of the overlapping chunks that cover the document, each filter's greatest and mean
    value feed rectified units; the greatest value of each unit over all chunks makes one logit. An empty document has one chunk of nothing.
    """

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape, s: r.normal(0, s, shape).astype(np.float32)
        self.p = {"taps": f(WIDTH, 256, FILTERS, s=0.2), "bias": np.zeros(FILTERS, np.float32), "up": f(2 * FILTERS, UNITS, s=0.4), "level": np.full(UNITS, 0.05, np.float32), "out": f(UNITS, s=0.3), "base": np.zeros(1, np.float32)}

    def chunks(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Texts or pieces of a text one after the other, each with zeros up to a half's end and a half more, where filters count as 0."""
        sizes = [max(-(-len(t) // HALF), 1) * HALF + HALF for t in texts]
        ends = np.cumsum(sizes)
        b = np.zeros(ends[-1] + WIDTH, np.uint8)
        own = np.zeros(ends[-1], bool)
        for t, end, size in zip(texts, ends.tolist(), sizes, strict=True):
            b[end - size : end - size + len(t)] = np.frombuffer(t, np.uint8)
            own[end - size : end - size + len(t)] = True
        return {"b": b, "own": own, "first": (ends - sizes) // HALF, "going_on": []}

    def units(self, c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Filters a by byte, chunks x from the halves at, units z by chunk, and the greatest of them by text."""
        b, own, n = c["b"], c["own"], len(c["own"])
        a = np.take(self.p["taps"][0], b[:n], axis=0)
        for k in range(1, WIDTH):
            a += np.take(self.p["taps"][k], b[k : k + n], axis=0)
        a += self.p["bias"]
        np.maximum(a, 0, out=a)
        a[~own] = 0
        halves = a.reshape(-1, HALF, FILTERS)
        most, total, count = halves.max(axis=1), halves.sum(axis=1), own.reshape(-1, HALF).sum(axis=1, dtype=np.float32)
        last = np.zeros(len(most), bool)  # the half after each text begins no chunk
        last[np.append(c["first"][1:], len(most)) - 1] = True
        last[np.array(c["going_on"], np.int64)] = True
        at = np.flatnonzero(~last)
        of = np.maximum(count[at] + count[at + 1], 1)
        x = np.concatenate([np.maximum(most[at], most[at + 1]), (total[at] + total[at + 1]) / of[:, None]], axis=1)
        z = np.maximum(x @ self.p["up"] + self.p["level"], 0)
        starts = np.searchsorted(at, c["first"])
        return c | {"a": a, "at": at, "of": of, "x": x, "z": z, "starts": starts, "pooled": np.maximum.reduceat(z, starts, axis=0)}

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Each unit's greatest value over all chunks, by text; long texts go piece by piece, each with a half of the one before and what filters see of the next."""
        out = np.zeros((len(texts), UNITS), np.float32)
        held: list[tuple[int, bytes, int, bool]] = []

        def flush() -> None:
            if held:
                found = self.units(self.cut(self.chunks([x[1] for x in held]), held))["pooled"]
                for x, row in zip(held, found, strict=True):
                    np.maximum(out[x[0]], row, out=out[x[0]])
                held.clear()

        size = 0
        for i, t in enumerate(texts):
            for s in range(0, max(len(t) - HALF, 1), PIECE):
                piece = t[s : s + PIECE + HALF + WIDTH - 1]
                held.append((i, piece, min(len(t) - s, PIECE + HALF), s + PIECE + HALF < len(t)))
                size += len(piece)
                if size >= TOGETHER:
                    flush()
                    size = 0
        flush()
        return out

    @staticmethod
    def cut(c: dict[str, np.ndarray], held: list[tuple[int, bytes, int, bool]]) -> dict[str, np.ndarray]:
        """Bytes of a piece beyond its own are seen by its filters but have none of their own; where the text goes on, its last half begins its chunk in the next piece."""
        for first, (_, piece, own, more) in zip(c["first"].tolist(), held, strict=True):
            c["own"][first * HALF + own : first * HALF + len(piece)] = False
            if more:
                c["going_on"].extend(range(first + own // HALF - 1, first - (-len(piece) // HALF)))
        return c

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each text: that it is of label 1."""
        logit = self.pooled(texts).astype(np.float64) @ self.p["out"].astype(np.float64) + float(self.p["base"][0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradients(self, state: dict[str, np.ndarray], d: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of d * logit over the texts. Only the chunks in which a unit is greatest have a share in it."""
        a, x, z, starts = state["a"], state["x"], state["z"], state["starts"]
        g = {"base": np.array([d.sum()]), "out": d @ state["pooled"]}
        stops = np.append(starts[1:], len(z))
        best = np.stack([s + z[s:e].argmax(axis=0) for s, e in zip(starts, stops, strict=True)])  # text, unit
        dz = d[:, None] * self.p["out"] * (np.take_along_axis(z, best, axis=0) > 0)
        g["level"] = dz.sum(axis=0)
        rows, where = np.unique(best, return_inverse=True)
        full = np.zeros((len(rows), UNITS), np.float32)
        np.add.at(full, (where.reshape(best.shape), np.arange(UNITS)[None, :]), dz)
        g["up"] = x[rows].T @ full
        dx = full @ self.p["up"].T
        place = state["at"][rows][:, None] * HALF + np.arange(2 * HALF)
        part = a[place]  # chunk, byte, filter
        da = (dx[:, FILTERS:] / state["of"][rows][:, None])[:, None, :] * (part > 0)
        top = part.argmax(axis=1)
        np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], axis=1) + (dx[:, :FILTERS] * (part.max(axis=1) > 0))[:, None, :], axis=1)
        flat = da.reshape(-1, FILTERS)
        g["bias"] = flat.sum(axis=0)
        g["taps"] = np.zeros_like(self.p["taps"])
        for k in range(WIDTH):
            seen = state["b"][place + k].ravel()
            for j in range(FILTERS):
                g["taps"][k, :, j] = np.bincount(seen, flat[:, j], minlength=256)
        return g

    def fit(self, texts: list[bytes], labels: list[int], share: float) -> "Network":
        """Adam on the log loss; share is label 1's share of all labelled rows, to which both labels are weighed."""
        y = np.array(labels)
        weight = np.where(y == 1, share / max((y == 1).mean(), 1e-6), (1 - share) / max((y == 0).mean(), 1e-6))
        r = np.random.default_rng(11)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(texts))
            for part in np.array_split(order, max(1, len(order) // BATCH)):
                state = self.units(self.chunks([texts[i] for i in part]))
                logit = state["pooled"] @ self.p["out"] + self.p["base"][0]
                g = self.gradients(state, ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) * weight[part] / len(part)).astype(np.float32))
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def in_fold(x, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the id as text has this remainder; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(x.cast("string"), F.lit("null"))) % folds == fold


def sample(told: DataFrame, texts: DataFrame) -> list[tuple[int, str]]:
    """(label, text): of SAMPLE ids of each label at most, those of least hash, as many as SAMPLE_BYTES allow, one at least. Only these come to the driver."""
    known, order = told.join(texts.select("doc_id"), "doc_id", "left_semi"), F.xxhash64("doc_id")
    least = [known.filter(F.col("quality") == label).orderBy(order, "doc_id").limit(SAMPLE) for label in (0, 1)]
    found = texts.join(F.broadcast(least[0].unionByName(least[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.substring("text", 1, SAMPLE_TEXT)).alias("text"))
    found, out = stage(found, "quality-sample"), []
    for label in (0, 1):
        own = found.filter(F.col("quality") == label).orderBy(order, "doc_id")
        total = np.cumsum([r[0] for r in own.select(F.octet_length("text")).collect()])
        out += [(label, r["text"]) for r in own.limit(max(1, int((total <= SAMPLE_BYTES).sum()))).collect()]
    unstage(found)
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1) -> Network | None:
    """A network fitted to a bounded sample of the labelled rows that aren't held out; None if they don't hold both labels.

    Ids with two different labels, and null ids or labels, train nothing. The ids are chosen on the labels and ids alone, whatever their texts; only the
    sample's texts move. Of an id on several rows the least text counts, once; of a long text its first SAMPLE_TEXT code points. Null text is empty text.
    """
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~in_fold(F.col("doc_id"), folds, held_fold))
    told = told.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").select("doc_id", "quality")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sample(told, texts)
    if len({r[0] for r in rows}) < 2:
        return None
    share = told.agg(F.avg("quality")).first()[0]
    return Network().fit([t.encode("utf-8", "surrogatepass") for _, t in rows], [label for label, _ in rows], share)


def quality_scores(docs: DataFrame, model: Network | None, folds: int = 3, held_fold: int = 1, names: tuple[str, str, str] = ("score", "predicted", "held_out")) -> DataFrame:
    """docs with score, predicted (1 if score >= 0.5) and held_out for each row's whole text; without a model each score is 0.5.

    Null text is empty text and has a score like others. Columns of docs stay as they are: where one has such a name already, the new one has underscores
    before its own. Rows are independent: no shuffle. The model is a few thousand numbers, sent with the tasks.
    """
    workers_find_package(docs.sparkSession)
    score, predicted, held_out = (free_name(docs, n) for n in names)
    at = [c.lower() for c in docs.columns].index("text")
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{score}` double, `{predicted}` int"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.full(b.num_rows, 0.5)
            for i in range(0, b.num_rows if model else 0, ROWS):
                found[i : i + ROWS] = model.scores([(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(at).slice(i, ROWS)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [*columns, score, predicted])

    return docs.mapInArrow(scored, schema).withColumn(held_out, in_fold(F.col("doc_id"), folds, held_fold))


__all__ = ["Network", "fit_quality", "quality_scores"]
