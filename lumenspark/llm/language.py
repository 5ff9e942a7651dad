"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, the largest response
of each filter in a window is kept (max pooling), and a softmax layer gives the languages.  It is
trained in numpy on windows of labelled texts: ``sample`` rows at most, the least of a hash of the
id, each with ``windows`` windows at places drawn over the whole text.  The executors cut the windows,
so that the driver gets these alone, never a text.

For scoring, the embedding and each filter fold into tables: the response of a filter of width w is
the sum of w table rows, and tables over byte pairs halve the sums.  Every window of every whole
text is scored, in batches; a text's language is the one with the largest mean log-probability over
its windows, weighted by their length.

Rows: a null text, or one without a letter, is ``und`` with score 0; texts shorter than a window are
padded; repeated rows are scored alike; a null id is kept; only ``text`` enters a prediction, extra
columns are ignored; if no row is labelled, everything is ``und``; of more languages than sampled rows
the commonest are learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.llm.common import map_batches, only
from lumenspark.llm.textbytes import by_bytes, utf8

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 12, 8
SAMPLE, WINDOWS = 3000, 2
_SLICE = 1 << 20  # bytes of text that are scored at once
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x e
    filters: list[np.ndarray]  # for each width: (width * e) x filters
    bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width, parts (place, over pairs of bytes, table) whose sum is the response."""
        out = []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            single = [self.embedding @ f[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(width)]
            parts, j = [], 0
            while j < width:
                if j + 1 < width:
                    pair = (single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1)
                    parts.append((j, True, np.ascontiguousarray(pair, np.float32)))
                    j += 2
                else:
                    parts.append((j, False, np.ascontiguousarray(single[j], np.float32)))
                    j += 1
            out.append(parts)
        return out

    def pooled_to_log(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled + self.bias, 0)
        raw = hidden @ self.output + self.output_bias
        raw -= raw.max(axis=1, keepdims=True)
        return raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))


def cut_windows(data: np.ndarray, seed: int, windows: int = WINDOWS) -> np.ndarray:
    """Windows at drawn places of a text's bytes, padded if it is shorter; none of an empty text."""
    out = np.zeros((windows if len(data) else 0, WINDOW), np.uint8)
    starts = np.random.default_rng(seed).integers(0, max(1, len(data) - WINDOW + 1), len(out))
    for row, at in zip(out, starts.tolist(), strict=True):
        part = data[at : at + WINDOW]
        row[: len(part)] = part
    return out


def train(x: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    """Fit the network to labelled windows by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    total = FILTERS * len(WIDTHS)
    params = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "o": rng.normal(0, 0.1, (total, len(languages))), "c": np.zeros(len(languages)), "b": np.zeros(total)}
    params |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS}
    network = lambda: Network(languages, params["e"], [params[f"f{w}"] for w in WIDTHS], params["b"], params["o"], params["c"])
    if len(languages) < 2:
        return network()
    y = np.searchsorted(languages, labels)
    weight = len(y) / (len(languages) * np.maximum(np.bincount(y, minlength=len(languages)), 1))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            part = order[i : i + batch]
            xb, n = x[part], len(part)
            emb = params["e"][xb]
            pooled, where = [], []
            for w in WIDTHS:
                strided = np.lib.stride_tricks.sliding_window_view(emb.reshape(n, -1), w * EMBEDDING, axis=1)[:, ::EMBEDDING]
                response = strided.reshape(-1, w * EMBEDDING) @ params[f"f{w}"]
                response = response.reshape(n, WINDOW - w + 1, FILTERS)
                at = response.argmax(axis=1)
                where.append(at)
                pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
            p = np.concatenate(pooled, axis=1) + params["b"]
            hidden = np.maximum(p, 0)
            raw = hidden @ params["o"] + params["c"]
            prob = np.exp(raw - raw.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(n), y[part]] -= 1
            prob *= weight[y[part]][:, None] / n
            grads = {k: np.zeros_like(v) for k, v in params.items()}
            grads["o"], grads["c"] = hidden.T @ prob, prob.sum(axis=0)
            dp = (prob @ params["o"].T) * (p > 0)
            grads["b"] = dp.sum(axis=0)
            for k, w in enumerate(WIDTHS):
                d = dp[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    byte = xb[np.arange(n)[:, None], where[k] + j]
                    block = slice(j * EMBEDDING, (j + 1) * EMBEDDING)
                    grads[f"f{w}"][block] += np.einsum("nfe,nf->ef", params["e"][byte], d)
                    np.add.at(grads["e"], byte, d[:, :, None] * params[f"f{w}"][block].T[None])
            steps += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return network()


def _has_letter(data: np.ndarray) -> bool:
    if _ASCII_LETTER[data].any():
        return True
    return bool((data >= 128).any() and _LETTER.search(data.tobytes().decode()))


class Scorer:
    """Applies a network to whole texts in batches of windows."""

    def __init__(self, network: Network, batch: int = 1024):
        self.network, self.batch, self.parts = network, batch, network.tables()
        self.reach = WINDOW + max(WIDTHS) - 1

    def _log(self, windows: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows; each has WINDOW bytes and those after them, which the last filters reach into."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = []
        for parts in self.parts:
            response = None
            for place, pair, table in parts:
                got = table.take(pairs[:, place : place + WINDOW] if pair else windows[:, place : place + WINDOW], axis=0)
                response = got if response is None else np.add(response, got, out=response)
            pooled.append(response.max(axis=1))
        return self.network.pooled_to_log(np.concatenate(pooled, axis=1))

    def predict(self, column) -> tuple[list[str], list[float]]:
        names, scores = [], []
        data, offsets = utf8(column)
        n = len(offsets) - 1
        size = np.diff(offsets)
        per = np.maximum(-(-size // WINDOW), 1)
        row = np.repeat(np.arange(n), per)
        start = np.repeat(offsets[:-1] - WINDOW * np.concatenate([[0], np.cumsum(per)[:-1]]), per) + WINDOW * np.arange(len(row))
        # the last window of a text is moved back to end with it, so that only short texts are padded
        stop = offsets[1:][row]
        shifted = np.maximum(np.minimum(start, stop - WINDOW), offsets[:-1][row])
        fresh = np.minimum(start + WINDOW, stop) - start
        total = np.zeros((n, len(self.network.languages)))
        padded = np.append(data, np.zeros(self.reach, np.uint8)) if len(data) < 1 << 26 else None
        for i in range(0, len(row), self.batch):
            some = slice(i, i + self.batch)
            at = shifted[some, None] + np.arange(self.reach)
            inside = at < stop[some, None]
            source = padded if padded is not None else data
            windows = np.where(inside, source[np.minimum(at, len(source) - 1)], 0).astype(np.uint8)
            np.add.at(total, row[some], self._log(windows) * np.maximum(fresh[some], 1)[:, None])
        total /= np.maximum(size, 1)[:, None]
        prob = np.exp(total - total.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        for i in range(n):
            if _has_letter(data[offsets[i] : offsets[i + 1]]):
                names.append(self.network.languages[best[i]])
                scores.append(float(prob[i, best[i]]))
            else:
                names.append("und")
                scores.append(0.0)
        return names, scores


def _predict(network: Network):
    def run(batches):
        scorer = Scorer(network) if network.languages else None
        for batch in batches:
            for at, n in by_bytes(batch.column("text"), _SLICE):
                part = batch.slice(at, n)
                names, scores = scorer.predict(part.column("text")) if scorer else (["und"] * part.num_rows, [0.0] * part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def _windowed(batches):
    """(doc_id, text, lang) -> (lang, doc_id, windows)."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        made = [cut_windows(data[a:b], d % (1 << 63)).tobytes() for d, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(made, pa.binary())], names=["lang", "doc_id", "windows"])


def fit_on(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Network:
    """Train on at most sample labelled rows among those that the condition on doc_id lets in, an equal number of each language at most.

    Rows equal in language, id and text count once.  No language is left out, unless there are more than rows to draw:
    then the commonest have one row each.
    """
    known = only(docs, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null").where(usable)
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))
    found = sizes.orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not found:
        return train(np.zeros((0, WINDOW), np.uint8), [])
    each = sample // len(found)
    known = known.withColumn("of_text", F.xxhash64("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("of_text")]
    # ids first, so that only the sample's texts reach the driver.  Of a language's ids, the least hashes are wanted; a share of
    # them that holds enough is taken before they meet (six standard errors, and a fifth for the approximate count)
    enough = 1.2 * (each + 6 * each**0.5 + 30)
    shares = docs.sparkSession.createDataFrame([(r.lang, enough / max(r.n, 1)) for r in found], "lang string, share double")
    rank_of = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    ids = known.select("lang", "doc_id", "of_text").join(F.broadcast(shares), "lang").where(rank_of <= F.col("share"))  # sample rows at most
    ids = ids.select("lang", "doc_id", "of_text").distinct()
    # rows that share an id must not crowd out a language, nor all be cut
    ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= each).drop("rank")
    drawn = known.join(F.broadcast(ids), ["lang", "doc_id", "of_text"])  # sample rows at most
    once = drawn.groupBy("lang", "doc_id", "of_text").agg(F.first("text").alias("text"))
    rows = map_batches(once.select("doc_id", "text", "lang"), _windowed, "lang string, doc_id long, windows binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "windows").collect()  # sample rows at most, of WINDOWS windows
    x = np.frombuffer(b"".join(r.windows for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, [r.lang for r in rows for _ in range(len(r.windows) // WINDOW)])


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score)."""
    return map_batches(only(docs, "doc_id", "text"), _predict(network), "doc_id long, lang_pred string, score double")
