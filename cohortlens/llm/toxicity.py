"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of a word embedding (hashed lower-cased word) and of character embeddings
(hashed runs of 4 and 6 bytes of the word with its boundaries, divided by the root of their number), so
that unseen words count by their parts.  Two columns of the embeddings start from how much more often
the word or run occurs in toxic training rows; all are then trained with the rest.  Overlapping windows of ``WINDOW`` words, one every ``HOP`` words, cover each whole text; two
gated recurrent layers read a window in both directions, attention pools their states, and the text's
score is that of its most toxic window.

Training uses a bounded sample of labelled rows (``max_positive`` and ``max_negative``, of up to
``max_train_words`` words); labels, language, source and id never enter a score.  The bias is then set
so that the best cut on training rows lies at ``CUT``.  Scoring runs in place over every whole text.

Defined cases: a null or empty text has score 0; without both labels among the training rows every score
is 0 (no toxic row) or 1 (only toxic rows); repeated labels of an id count once, the larger; rows with a
null id are scored too; extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm import common

WINDOW, HOP = 32, 24
HIDDEN, WIDTH, ATTEND = 12, 16, 12
WORD_ROWS, CHAR_ROWS = 1 << 17, 1 << 16
GRAMS = (4, 6)
CUT = 0.7
#: Training texts that must hold a word or run before it has an embedding, and before its log odds count half.
LEAST, SHRINK = 3, 6
WINDOWS_AT_ONCE = 1024


class Words:
    """Distinct lower-cased words of some texts, their table rows, and the texts as word numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = common.LOWER[data]
        starts, ends, self.first = common.word_spans(data, offsets)
        hashes = common.word_hashes(data, starts, ends)
        distinct, where, words = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = words.astype(np.int32)
        self.word_row = (distinct % np.uint64(WORD_ROWS)).astype(np.int64)
        starts, ends = starts[where], ends[where]
        # each word's bytes with 0x20 on either side, one after the other
        sizes = ends - starts + 2
        begin = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.full(begin[-1], 0x20, np.uint8)
        owner = np.arange(len(sizes)).repeat(sizes - 2)
        inner = np.arange(len(owner)) - (begin[:-1] - 2 * np.arange(len(sizes)))[owner]
        flat[begin[owner] + 1 + inner] = data[starts[owner] + inner]
        sums = common.prefix_sums(common.byte_codes(flat))
        word_of = np.arange(len(sizes)).repeat(sizes)
        rows, owners = [], []
        for k in GRAMS:
            at = np.flatnonzero(np.arange(len(flat)) + k <= begin[1:][word_of])
            rows.append((common.span_hash(sums, at, at + k) % np.uint64(CHAR_ROWS)).astype(np.int64))
            owners.append(word_of[at])
        owners, rows = np.concatenate(owners), np.concatenate(rows)
        order = np.argsort(owners, kind="stable")
        self.char_row = rows[order].astype(np.int32)
        self.char_first = np.searchsorted(owners[order], np.arange(len(sizes) + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (window, place), -1 past the end of a text, and the text of each window."""
        n = np.diff(self.first)
        count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // HOP)) + 1, 0)
        text = np.arange(len(n)).repeat(count)
        index = np.arange(len(text)) - (np.cumsum(count) - count).repeat(count)
        begin = self.first[:-1][text] + index * HOP
        at = begin[:, None] + np.arange(WINDOW)[None, :]
        inside = at < self.first[1:][text][:, None]
        return np.where(inside, self.words[np.minimum(at, max(len(self.words) - 1, 0))], -1) if len(text) else np.zeros((0, WINDOW), np.int64), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(seed))
    shape = {"word": (WORD_ROWS, WIDTH), "char": (CHAR_ROWS, WIDTH), "in_f": (WIDTH, 3 * HIDDEN), "in_b": (WIDTH, 3 * HIDDEN),
             "re_f": (HIDDEN, 3 * HIDDEN), "re_b": (HIDDEN, 3 * HIDDEN), "att": (2 * HIDDEN, ATTEND), "pick": (ATTEND,), "out": (2 * HIDDEN,)}
    scale = {"word": 0.02, "char": 0.02}
    model = {k: (g.standard_normal(s) * scale.get(k, 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shape.items()}
    model |= {"bias_f": np.zeros(3 * HIDDEN, np.float32), "bias_b": np.zeros(3 * HIDDEN, np.float32), "bias": np.zeros(1, np.float32)}
    return model


def word_inputs(model: dict, words: Words) -> np.ndarray:
    out = model["word"][words.word_row]
    count = np.diff(words.char_first)
    full = np.flatnonzero(count)
    if len(full):
        for low in range(0, len(full), 1 << 15):
            part = full[low:low + (1 << 15)]
            a, b = words.char_first[part[0]], words.char_first[part[-1] + 1]
            sums = np.add.reduceat(model["char"][words.char_row[a:b]], words.char_first[part] - a, axis=0)
            out[part] += sums / np.sqrt(count[part])[:, None].astype(np.float32)
    return out


def _direction(projected, numbers, recurrent, backward: bool, keep: bool):
    """States (place, window, hidden) of one gated recurrent layer; past the end the state is carried on."""
    n, h = len(numbers), HIDDEN
    state = np.zeros((n, h), np.float32)
    states = np.zeros((WINDOW, n, h), np.float32)
    kept = []
    for t in range(WINDOW - 1, -1, -1) if backward else range(WINDOW):
        own = numbers[:, t]
        x = projected[own]
        rec = state @ recurrent
        gates = _sigmoid(x[:, :2 * h] + rec[:, :2 * h])
        update, reset = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h:] + reset * rec[:, 2 * h:])
        after = new + update * (state - new)
        inside = own >= 0
        if not inside.all():
            after = np.where(inside[:, None], after, state)
        if keep:
            kept.append((t, state, rec[:, 2 * h:], update, reset, new, inside))
        state = after
        states[t] = after
    return states, kept


def forward(model: dict, inputs: np.ndarray, numbers: np.ndarray, keep: bool = False):
    """Logit of each window; with ``keep`` also what the gradient needs."""
    proj = [np.vstack([inputs @ model[f"in_{d}"] + model[f"bias_{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"]
    front, kept_f = _direction(proj[0], numbers, model["re_f"], False, keep)
    back, kept_b = _direction(proj[1], numbers, model["re_b"], True, keep)
    both = np.concatenate([front, back], axis=2)
    hidden = np.tanh(both @ model["att"])
    energy = np.where(numbers.T >= 0, hidden @ model["pick"], np.float32(-1e9))
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, both)
    logit = pooled @ model["out"] + model["bias"][0]
    return (logit, (kept_f, kept_b, both, hidden, weight, pooled)) if keep else logit


def _direction_back(kept, d_states, recurrent, numbers, n_words):
    h = HIDDEN
    d_rec_w = np.zeros_like(recurrent)
    d_gates = np.zeros((WINDOW, len(numbers), 3 * h), np.float32)
    d_state = np.zeros_like(kept[0][1])
    for t, before, rec_n, update, reset, new, inside in reversed(kept):
        d_after = d_state + d_states[t]
        live = inside[:, None].astype(np.float32)
        d_out = d_after * live
        d_new = d_out * (1 - update) * (1 - new * new)
        d_update = d_out * (before - new) * update * (1 - update)
        d_reset = d_new * rec_n * reset * (1 - reset)
        d_gates[t] = np.concatenate([d_update, d_reset, d_new], axis=1)
        d_rec = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
        d_rec_w += before.T @ d_rec
        d_state = d_out * update + d_rec @ recurrent.T + d_after * (1 - live)
    d_proj = np.zeros((n_words, 3 * h), np.float32)
    flat = numbers.T.ravel()
    order = np.argsort(flat, kind="stable")[(flat < 0).sum():]
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
        d_proj[flat[order][first]] = np.add.reduceat(d_gates.reshape(-1, 3 * h)[order], first, axis=0)
    return d_proj, d_rec_w


def gradients(model: dict, words: Words, inputs: np.ndarray, numbers: np.ndarray, d_logit_of) -> dict:
    """Gradient of every table; ``d_logit_of`` maps the logits to the loss's gradient."""
    logit, (kept_f, kept_b, both, hidden, weight, pooled) = forward(model, inputs, numbers, True)
    d_logit = d_logit_of(logit).astype(np.float32)
    grad = {"bias": np.array([d_logit.sum()], np.float32), "out": pooled.T @ d_logit}
    d_pooled = d_logit[:, None] * model["out"][None, :]
    d_weight = np.einsum("nh,tnh->tn", d_pooled, both)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_hidden = d_energy[:, :, None] * model["pick"] * (1 - hidden * hidden)
    grad["pick"] = np.einsum("tn,tna->a", d_energy, hidden)
    grad["att"] = np.einsum("tnh,tna->ha", both, d_hidden)
    d_both = weight[:, :, None] * d_pooled[None] + d_hidden @ model["att"].T
    d_inputs = np.zeros_like(inputs)
    for side, kept, part in (("f", kept_f, d_both[:, :, :HIDDEN]), ("b", kept_b, d_both[:, :, HIDDEN:])):
        d_proj, grad[f"re_{side}"] = _direction_back(kept, part, model[f"re_{side}"], numbers, len(inputs))
        grad[f"in_{side}"] = inputs.T @ d_proj
        grad[f"bias_{side}"] = d_proj.sum(axis=0)
        d_inputs += d_proj @ model[f"in_{side}"].T
    used = np.unique(numbers[numbers >= 0])
    grad["word"] = (words.word_row[used], d_inputs[used])
    count = np.diff(words.char_first)
    share = d_inputs / np.sqrt(np.maximum(count, 1))[:, None].astype(np.float32)
    chars = np.concatenate([np.arange(words.char_first[u], words.char_first[u + 1]) for u in used]) if len(used) else np.zeros(0, np.int64)
    grad["char"] = (words.char_row[chars], share[used].repeat(count[used], axis=0))
    return grad


class Steps:
    """Adam for the small tables, sparse Adagrad for the embeddings."""

    def __init__(self, model: dict, rate: float):
        self.model, self.rate, self.n = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.items()}

    def apply(self, grad: dict) -> None:
        self.n += 1
        for k, g in grad.items():
            if isinstance(g, tuple):
                if not len(g[0]):
                    continue
                rows, where = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(rows), g[1].shape[1]), np.float32)
                np.add.at(total, where, g[1])
                self.v[k][rows] += total * total
                self.model[k][rows] -= self.rate * total / (np.sqrt(self.v[k][rows]) + 1e-6)
            else:
                self.m[k] += 0.1 * (g - self.m[k])
                self.v[k] += 0.01 * (g * g - self.v[k])
                self.model[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.n)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.n)) + 1e-7)


def start_embeddings(model: dict, batches: list, y: np.ndarray) -> dict[str, np.ndarray]:
    """Set one column of each embedding to the log odds of its row in toxic against clean texts, shrunk where few texts have it.

    Rows that fewer than ``LEAST`` texts have stay zero, so that a rare word tells nothing; returns the rows that may learn.
    """
    seen = {"word": np.zeros((WORD_ROWS, 2), np.float32), "char": np.zeros((CHAR_ROWS, 2), np.float32)}
    for own, words, numbers, text in batches:
        if not len(numbers):
            continue
        used = numbers >= 0
        pairs = np.unique(text[:, None].repeat(WINDOW, axis=1)[used] * len(words.word_row) + numbers[used])
        texts, which = pairs // len(words.word_row), pairs % len(words.word_row)
        label = y[own].astype(np.int64)
        size = np.diff(words.char_first)[which]
        at = np.arange(size.sum()) - (np.cumsum(size) - size).repeat(size) + words.char_first[which].repeat(size)
        for table, row, of in (("word", words.word_row[which], texts), ("char", words.char_row[at], texts.repeat(size))):
            rows = len(seen[table])
            once = np.unique(of * rows + row)
            np.add.at(seen[table], (once % rows, label[once // rows]), 1)
    n = np.array([(y == 0).sum(), (y == 1).sum()], np.float32)
    known = {}
    for column, (table, counts) in enumerate(seen.items()):
        rate = np.log((counts + 0.5) / (n + 1))
        total = counts.sum(axis=1)
        known[table] = total >= LEAST
        model[table][~known[table]] = 0
        model[table][:, column] = np.where(known[table], (rate[:, 1] - rate[:, 0]) * total / (total + SHRINK), 0) / 2
    return known


def text_logits(model: dict, words: Words, n_texts: int) -> np.ndarray:
    """Largest window logit of each text; minus infinity without words."""
    out = np.full(n_texts, -np.inf, np.float32)
    numbers, text = words.windows()
    inputs = word_inputs(model, words)
    for low in range(0, len(numbers), WINDOWS_AT_ONCE):
        np.maximum.at(out, text[low:low + WINDOWS_AT_ONCE], forward(model, inputs, numbers[low:low + WINDOWS_AT_ONCE]))
    return out


def train(texts: list[str], labels: list[int], epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7) -> dict:
    """Fit on whole texts: a text's logit is the largest of its windows'.

    The gradient is shared by the windows in proportion to a power of the exponential of their logits,
    a higher one in each pass, so that it comes to rest on the highest window.
    """
    model = new_model(seed)
    g = np.random.Generator(np.random.PCG64(seed))
    y = np.array(labels, np.float32)
    order = g.permutation(len(texts))
    batches = []
    for low in range(0, len(order), batch):
        own = order[low:low + batch]
        words = _words_of([texts[i] for i in own])
        batches.append((own, words, *words.windows()))
    known = start_embeddings(model, batches, y)
    steps = Steps(model, rate)
    share = max(float(y.mean()), 1e-3)
    model["bias"][0] = -1.0
    heavy = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for epoch in range(epochs):
        for k in g.permutation(len(batches)):
            own, words, numbers, text = batches[k]
            if not len(numbers):
                continue
            inputs = word_inputs(model, words)
            logit = np.concatenate([forward(model, inputs, numbers[i:i + WINDOWS_AT_ONCE]) for i in range(0, len(numbers), WINDOWS_AT_ONCE)])
            top = np.full(len(own), -np.inf, np.float32)
            np.maximum.at(top, text, logit)
            part = np.exp((logit - top[text]) * np.float32(1 + 2 * epoch))
            part /= np.bincount(text, part, len(own)).astype(np.float32)[text]
            chosen = np.flatnonzero(part >= 0.05)
            target, weight = y[own][text[chosen]], (heavy[own] / len(own))[text[chosen]] * part[chosen]
            grad = gradients(model, words, inputs, numbers[chosen], lambda z, t=target, w=weight: (_sigmoid(z) - t) * w)
            for table, may in known.items():
                rows, values = grad[table]
                grad[table] = rows[may[rows]], values[may[rows]]
            steps.apply(grad)
            steps.rate = rate * (1 - 0.8 * epoch / epochs)
    del batches, steps
    found = np.concatenate([text_logits(model, _words_of(texts[k:k + 256]), len(texts[k:k + 256])) for k in range(0, len(texts), 256)])
    model["bias"][0] += np.float32(np.log(CUT / (1 - CUT)) - best_cut(found, y))
    return model


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors, in the middle of the gap it lies in."""
    logit = np.where(np.isfinite(logit), logit, -30.0)
    order = np.argsort(logit, kind="stable")
    s, t = logit[order], y[order]
    missed = np.concatenate([[0], np.cumsum(t > 0)])
    false = (t == 0).sum() - np.concatenate([[0], np.cumsum(t == 0)])
    errors = missed + false
    ok = np.concatenate([[True], s[1:] > s[:-1], [True]])
    k = int(np.flatnonzero(ok)[np.argmin(errors[ok])])
    low, high = (s[k - 1] if k else s[0] - 2), (s[k] if k < len(s) else s[-1] + 2)
    return float(low + high) / 2


def _words_of(texts: list[str]) -> Words:
    column = pa.array(texts, pa.large_string())
    ((_, _, data, offsets),) = list(common.text_pieces(column, 1 << 40))
    return Words(data, offsets)


def release_memory() -> None:
    """Give freed pages back to the system, where the C library can: the driver holds the sample only while it trains."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Rows of a label that longer texts fill up to; characters taken of such a text; bytes a word of a text that fits.
FEW, LONG_CHARS, WORD_BYTES = 200, 50_000, 16


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int, max_negative: int, max_train_words: int, id_col: str,
                  text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """The bounded sample: labelled rows outside the held-out third, chosen by a hash of the id among texts with words.

    A text fits with up to ``max_train_words`` words in ``WORD_BYTES`` bytes a word.  Where fewer than ``FEW`` texts of a
    label fit, the shortest longer ones, cut to ``LONG_CHARS``, fill up to that number, so no label goes missing.
    """
    label = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).alias("label")).where(F.crc32(F.col("id").cast("string")) % 3 != 1)
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    size = F.octet_length("text")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(
        F.substring("text", 1, LONG_CHARS).rlike(r"[^\x20\x09-\x0D]")).withColumn(
        "long", F.when(size <= WORD_BYTES * max_train_words, n_words > max_train_words).otherwise(True))
    sized = common.materialised(texts.select("id", "long", size.alias("size")).join(label, "id").groupBy("id", "label").agg(
        F.min(F.struct("long", "size")).alias("best")).select("id", "label", "best.*"), "toxic-sizes")
    fitting = {r["label"]: r["count"] for r in sized.where("not long").groupBy("label").count().collect()}
    order, chosen = F.xxhash64(F.col("id")), None
    for value, most in ((1, max_positive), (0, max_negative)):
        own = sized.where(F.col("label") == value)
        picked = own.where("not long").orderBy(order, "id").limit(most)
        missing = min(FEW, most) - fitting.get(value, 0)
        if missing > 0:
            picked = picked.unionByName(own.where("long").orderBy("size", order, "id").limit(missing))
        chosen = picked if chosen is None else chosen.unionByName(picked)
    cut = F.when(F.col("long"), F.substring("text", 1, LONG_CHARS)).otherwise(F.col("text"))
    rows = texts.join(F.broadcast(chosen.select("id", "label", "long")), ["id", "long"]).select("id", "label", cut.alias("text")).dropDuplicates(["id"])
    rows = rows.orderBy("id").collect()
    return [r["text"] for r in rows], [int(r["label"]) for r in rows]


def with_score(docs: DataFrame, model: dict | float, text_col: str = "text") -> DataFrame:
    """Every row with its ``score``; ``model`` is a trained one or the constant score of all texts with words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for a, b, data, offsets in common.text_pieces(batch.column(place)):
                words = Words(data, offsets)
                if isinstance(known, float):
                    score = np.where(np.diff(words.first) > 0, known, 0.0)
                else:
                    logit = text_logits(known, words, b - a).astype(np.float64)
                    score = np.where(np.isfinite(logit), 1 / (1 + np.exp(-np.clip(logit, -40, 40))), 0.0)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])

    schema = T.StructType([*[f for f in docs.schema], T.StructField("score", T.DoubleType())])
    return common.arrow(docs, run, schema)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 1500, max_negative: int = 2500, max_train_words: int = 1000,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", epochs: int | None = None) -> dict | float:
    """A trained model, or the constant 0.0 / 1.0 where the sample holds one label only.

    Without ``epochs``, small samples get more passes: about as many text visits as 4 passes over 4,000.
    """
    texts, y = training_rows(docs, labels, max_positive, max_negative, max_train_words, id_col, text_col, label_col)
    if len(set(y)) < 2:
        return float(y[0]) if y else 0.0
    model = train(texts, y, epochs or int(np.clip(16_000 / len(texts), 4, 12)))
    del texts
    release_memory()
    return model


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(id, held_out, score, predicted) of every document; ``held_out`` rows never train."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return with_score(texts, fit(docs, labels, **options)).select(
        "id", (F.crc32(F.col("id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows with a score below ``CUT``; a column of docs named score is no obstacle."""
    text_col = options.get("text_col", "text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    kept = with_score(plain, fit(docs, labels, **options), names[docs.columns.index(text_col)]).where(F.col("score") < CUT)
    return kept.drop("score").toDF(*docs.columns)
