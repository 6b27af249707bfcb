"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in segments, once in each direction, gives every byte position a
probability for each language, and a document pools the probabilities of all its positions. Gates are
piecewise linear, so a step over thousands of segments is a few array operations. Training is plain
numpy: cross-entropy at every position, back-propagation through time, Adam.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heard, raw, sliced, spread

#: Bytes in a segment; the state starts at zero at either end of it.
SEGMENT = 256
#: Segments that are read side by side.
LANES = 2048
HIDDEN = 8
#: Documents per language that training may see at most (expected number, chosen by a hash of the id),
#: and bytes from a place in each that the hash chooses.
TRAIN_DOCS = 400
TRAIN_CHARS = 512
STEPS = 400
BATCH = 96
SPAN = 96
UNKNOWN = "und"
#: The pipeline rejects texts whose best language has less than this pooled probability.
MIN_SCORE = 0.3


class Network:
    """Weights of both directions and of the output, and the languages in their order."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.weights = {}
        for way in ("forward", "backward"):
            inputs = rng.normal(0, 0.3, (3 * hidden, 256))
            inputs[: 2 * hidden] += 0.5  # a gate is half open at zero
            self.weights[way] = inputs.astype(np.float32)
            self.weights[way + "_state"] = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)
        self.weights["out"] = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.weights["bias"] = np.zeros((len(languages), 1), np.float32)

    def _walk(self, way: str, steps, lanes: np.ndarray, data: np.ndarray, keep=None):
        """Yield each step's state; ``lanes[t]`` lanes are alive at step t, longest first."""
        inputs, state_weights, size = self.weights[way], self.weights[way + "_state"], self.hidden
        state = np.zeros((size, data.shape[1]), np.float32)
        for t in steps:
            n = int(lanes[t])
            before = state[:, :n]
            pre = np.take(inputs, data[t, :n], axis=1)
            drive = state_weights @ before
            gates = pre[: 2 * size] + drive[: 2 * size]
            open_gates = np.clip(gates, 0, 1)
            new = pre[2 * size :] + open_gates[size:] * drive[2 * size :]
            clipped = np.clip(new, -1, 1)
            after = clipped + open_gates[:size] * (before - clipped)
            if keep is not None:
                keep[t] = (before.copy(), gates, open_gates, drive[2 * size :], new, clipped)
            state[:, :n] = after
            yield t, n, after

    def positions(self, data: np.ndarray, lanes: np.ndarray):
        """Yield, last step first, the step and the language probabilities of its lanes."""
        steps = range(len(data))
        first = np.zeros((len(data), self.hidden, data.shape[1]), np.float32)
        for t, n, state in self._walk("forward", steps, lanes, data):
            first[t, :, :n] = state
        out, size = self.weights["out"], self.hidden
        for t, n, state in self._walk("backward", reversed(steps), lanes, data):
            logits = out[:, :size] @ first[t, :, :n] + out[:, size:] @ state + self.weights["bias"]
            logits -= logits.max(axis=0)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=0)
            yield t, n, logits

    def read(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Mean language probabilities of each text (rows); ``labels`` gets each byte's language."""
        sizes = np.diff(offsets)
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = offsets[owner] + number * SEGMENT
        length = np.minimum(SEGMENT, offsets[owner + 1] - starts)
        order = np.argsort(-length, kind="stable")
        sums = np.zeros((len(sizes), len(self.languages)))
        for at in range(0, len(order), LANES):
            lanes_of = order[at : at + LANES]
            span = length[lanes_of]
            steps = np.arange(int(span[0]))
            place = np.minimum(starts[lanes_of] + steps[:, None], len(data) - 1)
            alive = np.searchsorted(-span, -steps, side="left")
            pooled = np.zeros((len(self.languages), len(lanes_of)))
            for t, n, chances in self.positions(data[place], alive):
                pooled[:, :n] += chances
                if labels is not None:
                    labels[place[t, :n]] = chances.argmax(axis=0)
            np.add.at(sums, owner[lanes_of], pooled.T)
        return sums / np.maximum(sizes, 1)[:, None]

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions of equally long lanes and its gradient for every weight."""
        span, count = data.shape
        size, lanes = self.hidden, np.full(span, count)
        kept, states = {}, {}
        for way, steps in (("forward", range(span)), ("backward", range(span - 1, -1, -1))):
            kept[way], states[way] = {}, np.zeros((span, size, count), np.float32)
            for t, _, state in self._walk(way, steps, lanes, data, kept[way]):
                states[way][t] = state
        both = np.concatenate([states["forward"], states["backward"]], axis=1)
        logits = self.weights["out"] @ both + self.weights["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        chances = np.exp(logits)
        chances /= chances.sum(axis=1, keepdims=True)
        wanted = np.zeros_like(chances)
        wanted[:, target, np.arange(count)] = 1
        loss = float(-np.log(np.maximum((chances * wanted).sum(axis=1), 1e-9)).mean())
        delta = (chances - wanted) / np.float32(span * count)
        grads = {
            "out": np.einsum("tlb,thb->lh", delta, both),
            "bias": delta.sum(axis=(0, 2))[:, None],
        }
        back = np.einsum("lh,tlb->thb", self.weights["out"], delta)
        for way, part, steps in (
            ("forward", back[:, :size], range(span - 1, -1, -1)),
            ("backward", back[:, size:], range(span)),
        ):
            recurrent = self.weights[way + "_state"]
            carried = np.zeros((size, count), np.float32)
            into, grad_state = np.zeros((span, 3 * size, count), np.float32), np.zeros_like(recurrent)
            for t in steps:
                before, gates, opened, drive, new, clipped = kept[way][t]
                d = part[t] + carried
                inside = (gates > 0) & (gates < 1)
                d_new = d * (1 - opened[:size]) * (np.abs(new) < 1)
                into[t, :size] = d * (before - clipped) * inside[:size]
                into[t, size : 2 * size] = d_new * drive * inside[size:]
                into[t, 2 * size :] = d_new
                pushed = into[t].copy()
                pushed[2 * size :] *= opened[size:]
                grad_state += pushed @ before.T
                carried = d * opened[:size] + recurrent.T @ pushed
            flat = into.transpose(1, 0, 2).reshape(3 * size, -1)
            seen = data.reshape(-1)
            grads[way] = np.stack([np.bincount(seen, row, 256) for row in flat]).astype(np.float32)
            grads[way + "_state"] = grad_state
        return loss, grads

    def learn(self, segments: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 11) -> float:
        """Adam over random windows of the byte rows in ``segments``; the last loss."""
        rng = np.random.default_rng(seed)
        slow = {name: (np.zeros_like(w), np.zeros_like(w)) for name, w in self.weights.items()}
        classes = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        loss = 0.0
        for step in range(1, steps + 1):
            rows = rng.permutation(
                np.concatenate([rng.choice(rows, BATCH // len(classes) + 1) for rows in classes])
            )
            at = rng.integers(0, segments.shape[1] - SPAN + 1)
            loss, grads = self.gradients(
                np.ascontiguousarray(segments[rows, at : at + SPAN].T), target[rows]
            )
            rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, grad in grads.items():
                grad = grad * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                mean, square = slow[name]
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad * grad - square)
                fair = np.sqrt(square / (1 - 0.99**step)) + 1e-8
                self.weights[name] -= (rate * (mean / (1 - 0.9**step)) / fair).astype(np.float32)
        return loss


def train(
    docs: DataFrame,
    learnt: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_docs: int = TRAIN_DOCS,
) -> Network | None:
    """A network learnt from rows where ``learnt`` holds, with text and language; None without any.

    Which rows are learnt from depends on a hash of the id against a share per language, so about
    ``train_docs`` rows of a language come to the driver however many there are.
    """
    rows = docs.filter(learnt).select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    )
    rows = rows.filter((F.length("text") > 0) & F.col("lang").isNotNull())
    sizes = {row.lang: row["count"] for row in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("draw")), F.lit(1 << 20))
    share = F.coalesce(
        *[
            F.when(F.col("lang") == name, F.lit(int(min(1.0, train_docs / sizes[name]) * (1 << 20))))
            for name in languages
        ]
    )
    place = F.pmod(F.xxhash64(F.col("id"), F.lit("place")), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1)))
    sample = rows.filter(draw < share).select(
        "id", "lang", F.substr("text", (place + 1).cast("int"), F.lit(TRAIN_CHARS)).alias("text")
    )
    drawn = sorted(((row.lang, row.id, row.text) for row in sample.collect()), key=lambda x: (x[0], str(x[1]), x[2]))
    if not drawn:
        return None
    languages = sorted({lang for lang, _, _ in drawn})
    segments = np.zeros((len(drawn), TRAIN_CHARS), np.uint8)
    for row, (_, _, text) in zip(segments, drawn):
        row[:] = np.resize(np.frombuffer(text.encode(), np.uint8), TRAIN_CHARS)
    network = Network(languages)
    network.learn(segments, np.array([languages.index(lang) for lang, _, _ in drawn]))
    return network


def predict(
    docs: DataFrame,
    network: Network | None,
    text_col: str = "text",
    keep: list[str] | None = None,
    labels: bool = False,
) -> DataFrame:
    """Per row a struct ``row`` of the columns in ``keep`` (default: all), ``lang_pred``, ``score`` and,
    if asked for, ``labels``: the number of the language of every byte of the text.

    Every byte of every text is read. A null text, an empty one, one without a letter, or no network at
    all gives ``und`` and score 0. Rows are judged one by one, whatever repeats; an empty table gives
    no rows; columns of ``docs`` stay inside ``row``, so none clashes.
    """
    keep = docs.columns if keep is None else keep
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in keep]).alias("row"),
        text.alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        F.lit("").alias("lang_pred"),
        F.lit(0.0).alias("score"),
        F.lit(None).cast("binary").alias("labels"),
    )

    def judge(batches):
        for batch in batches:
            for part in sliced(batch, "text"):
                data, offsets = raw(part.column("text"))
                marks = np.zeros(len(data), np.uint8) if labels else None
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                if network is None:
                    names, scores = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
                else:
                    chances = network.read(data, offsets, marks)
                    best = chances.argmax(axis=1)
                    names = np.where(letters, np.array(network.languages, object)[best], UNKNOWN)
                    scores = np.where(letters, np.clip(chances[np.arange(len(part)), best], 0, 1), 0.0)
                bits = [marks[a:b].tobytes() for a, b in zip(offsets, offsets[1:])] if labels else None
                made = {
                    "text": pa.nulls(len(part), pa.string()),
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                    "labels": pa.array(bits, pa.binary()) if bits else pa.nulls(len(part), pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(
                    [made.get(name, part.column(k)) for k, name in enumerate(part.schema.names)],
                    names=part.schema.names,
                )

    found = rows.mapInArrow(judge, rows.schema)
    return found.select("row", "lang_pred", "score", *(["labels"] if labels else []))


def query(docs: DataFrame) -> DataFrame:
    """Every document's language, learnt from documents whose remainder by 4 is not 2."""
    network = train(docs, heard(F.col("doc_id"), 4) != 2)
    held = F.coalesce(heard(F.col("row.doc_id"), 4) == 2, F.lit(False))
    return predict(spread(docs, "doc_id", "text"), network, keep=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score"
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in a known language, unchanged; ``und`` and unsure texts go."""
    network = train(docs, heard(F.col("doc_id"), 4) != 2)
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return predict(docs, network).filter(kept).select("row.*")
