"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are words with A-Z in lower case, then one end token per document.  Documents whose
crc32(doc_id as text) mod 10 is 0 are held out; everything is learnt from the others.

Counts.  Documents are read in blocks of bounded size where they lie; each becomes numbers of its block's
own words, so texts are split once and never shuffled.  Words are dealt to buckets by a hash; one shuffle
of the blocks' words, one row per block and bucket, gives each of them its corpus count, which goes back
to its block, so no task needs the whole vocabulary.

Model.  The most frequent ``words`` training words (a parameter, so the model's size is fixed), the end
and one id for all other words are the classes' members: words are dealt into frequency classes and
P(word) = P(class | state) P(word | class, state); a word outside is also weighed by its smoothed
share among all words outside.  The recurrent layer is a gated recurrent unit in numpy.

Training is truncated backpropagation through time with carried state.  Documents are dealt to shards by
a hash of id and content and sorted in each, so the result doesn't depend on the table's partitions.
The beginning of the first shard (``start_tokens``) gives the common start.  Then every shard trains by
itself from the present weights, which are averaged, weighted by tokens, after each of ``rounds``
rounds; each shard has its turn in one of them, so all training documents are learnt from.

Scoring runs each document from its first to its last token, window by window, with the state carried.

Defined results: a null text is empty and scores its end token; a row without doc_id is held out;
repeated rows are counted and scored each; an empty table gives an empty result; with no training
document at all, the model stays at its start; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b"\n"  # can't be a word
_END_ID, _OTHER_ID = 0, 1


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split() + [END]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))


class Gru:
    """Gated recurrent unit with a class-factored softmax; ids are sorted by class, classes are slices."""

    def __init__(self, counts: np.ndarray, hidden: int = 16, seed: int = 3):
        """counts: training count of each id; they set the classes and the output biases."""
        n = len(counts)
        # Classes of about equal summed root frequency; this many keep classes and words of a class alike in cost.
        freq = np.sqrt(counts + 1.0)
        classes = max(1, round(2 * np.sqrt(n / max(1.0, np.log(n)))))
        order = np.argsort(-counts, kind="stable")
        at = np.minimum((np.cumsum(freq[order]) - freq[order]) / freq.sum() * classes, classes - 1).astype(int)
        self.place = np.empty(n, np.int64)  # id -> place in class order
        self.place[order] = np.arange(n)
        _, at = np.unique(at, return_inverse=True)
        self.cls = at  # class of each place
        self.bounds = np.searchsorted(at, np.arange(at.max() + 2))
        c = counts[order] + 0.5
        per_class = np.add.reduceat(c, self.bounds[:-1])
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.hidden = hidden
        # The last column of wc and wo is the bias, for a last state that is always one.
        self.w = {
            "x": small(n, 3 * hidden),
            "u": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32) * np.float32(0.5),
            "b": np.concatenate([np.full(hidden, 1.0), np.zeros(2 * hidden)]).astype(np.float32),
            "wc": small(len(per_class), hidden + 1),
            "wo": small(n, hidden + 1),
        }
        self.w["wc"][:, -1] = np.log(per_class / per_class.sum())
        self.w["wo"][:, -1] = np.log(c / per_class[at])

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.w.items():
            self.w[k] = flat[at : at + v.size].astype(np.float32).reshape(v.shape)
            at += v.size

    def inputs(self, places: np.ndarray) -> np.ndarray:
        """What input places (steps, lanes) add to the gates, as ``step`` takes it: (steps, 3 hidden, lanes)."""
        n, b = 2 * self.hidden, self.w["b"][:, None]
        x = np.take(self.w["x"], places, axis=0).transpose(0, 2, 1)
        out = np.empty(x.shape, x.dtype)
        np.subtract(-b[:n], x[:, :n], out=out[:, :n])
        np.add(x[:, n:], b[n:], out=out[:, n:])
        return out

    def recurrent(self) -> np.ndarray:
        """The recurrent weights as ``step`` takes them: both gates' parts are negative, as their exponentials are."""
        u = self.w["u"].T.copy()
        np.negative(u[: 2 * self.hidden], out=u[: 2 * self.hidden])
        return u

    def step(self, u: np.ndarray, x: np.ndarray, h: np.ndarray, out: tuple[np.ndarray | None, ...] = (None,) * 4) -> np.ndarray:
        """One step for all lanes (columns): the new state; ``out`` keeps it, gates, candidate and recurrent part for the gradient."""
        n = self.hidden
        new, zr, c, hu = out
        hu = np.matmul(u, h, out=hu)
        zr = np.add(x[: 2 * n], hu[: 2 * n], out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c = np.multiply(zr[n:], hu[2 * n :], out=c)
        c += x[2 * n :]
        np.tanh(c, out=c)
        new = np.subtract(h, c, out=new)
        new *= zr[:n]
        new += c
        return new

    def outputs(self, h: np.ndarray, place: np.ndarray, grads: dict | None = None, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target place given its state; adds output gradients if asked.

        Classes are weighed for ``chunk`` rows at once, which a processor keeps near.
        """
        n = self.hidden
        wc, wo = self.w["wc"], self.w["wo"]
        # States are within -1 and 1, which bounds the logits; others are cut at 60.
        held = all((np.abs(w) @ np.ones(n + 1, w.dtype)).max() < 60 for w in (wc, wo))
        # Rows are put in class order once, so that each class works on a slice.
        order = np.argsort(place.astype(np.int16) if len(self.cls) < 1 << 15 else place, kind="stable")
        sorted_h = np.ones((len(h), n + 1), h.dtype)
        np.take(h, order, axis=0, out=sorted_h[:, :n])
        h, place = sorted_h, place[order]
        cls, size = self.cls[place], np.diff(self.bounds)
        cut = np.searchsorted(place, self.bounds)
        rows, ones = np.arange(len(h)), np.ones(max(len(wc), size.max()), h.dtype)
        # Where a row's target stands among the logits of its chunk or of its class's rows.
        in_chunk = rows % chunk * len(wc) + cls
        in_class = (rows - cut[cls]) * size[cls] + place - self.bounds[cls]
        # Log probabilities are logits less the logarithms of two sums; the only word of a class has 0 and 1.
        logit, logit_o = np.empty(len(h), h.dtype), np.zeros(len(h), h.dtype)
        total, total_o = np.empty(len(h), h.dtype), np.ones(len(h), h.dtype)
        if grads is not None:
            dh, dh_o = np.empty_like(h), np.zeros_like(h)
        for a in range(0, len(h), chunk):
            own = slice(a, a + chunk)
            e = h[own] @ wc.T
            flat, at = e.reshape(-1), in_chunk[own]
            if not held:
                np.minimum(e, 60, out=e)
            flat.take(at, out=logit[own])
            np.exp(e, out=e)
            sums = np.matmul(e, ones[: len(wc)], out=total[own])
            if grads is not None:
                # Shares are exponentials by their sums; the states are divided instead of them.
                flat[at] -= sums
                grads["wc"] += e.T @ (h[own] / sums[:, None])
                np.matmul(e, wc, out=dh[own])
        for k in np.flatnonzero((cut[1:] > cut[:-1]) & (size > 1)).tolist():
            own, a, b = slice(cut[k], cut[k + 1]), self.bounds[k], self.bounds[k + 1]
            e, at = h[own] @ wo[a:b].T, in_class[own]
            flat = e.reshape(-1)
            if not held:
                np.minimum(e, 60, out=e)
            flat.take(at, out=logit_o[own])
            np.exp(e, out=e)
            sums = np.matmul(e, ones[: b - a], out=total_o[own])
            if grads is not None:
                flat[at] -= sums
                np.matmul(e.T, h[own] / sums[:, None], out=grads["wo"][a:b])
                np.matmul(e, wo[a:b], out=dh_o[own])
                begin = grads["met"].pop()[0] if grads["met"] and grads["met"][-1][1] == a else a
                grads["met"].append((begin, b))
        logp = logit + logit_o - np.log(total) - np.log(total_o)
        back = np.empty_like(order)
        back[order] = rows
        if grads is None:
            return np.take(logp, back), None
        dh /= total[:, None]
        dh_o /= total_o[:, None]
        dh += dh_o
        return np.take(logp, back), np.take(dh[:, :n], back, axis=0)

    def score(self, docs: list[np.ndarray], rows: int = 32768) -> np.ndarray:
        """Natural log probability of each document (arrays of ids, end included), state carried to its end.

        A window takes about ``rows`` tokens of all documents that reach it: fewer documents, more steps.
        """
        out = np.zeros(len(docs))
        if not len(docs):
            return out
        lengths = np.array([len(d) for d in docs])
        order = np.argsort(-lengths, kind="stable")
        sizes, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
        stream = self.place.astype(np.int32)[np.concatenate(docs)]
        h = np.zeros((self.hidden, len(docs)), np.float32)
        last = np.full(len(docs), self.place[_END_ID])  # a document begins after an end
        u, longest, at = self.recurrent(), int(sizes[0]), 0
        while at < longest:
            on = int(np.searchsorted(-sizes, -at, "left"))
            steps = np.arange(at, at + min(max(1, rows // on), longest - at))
            live = np.searchsorted(-sizes, -steps, "left")
            # Places behind a document's end repeat its last one; they are not scored.
            part = stream[starts[:on] + np.minimum(steps[:, None], sizes[:on] - 1)]
            x = self.inputs(np.concatenate([last[None, :on], part[:-1]]))
            last = part[-1]
            states = []
            for t, n in enumerate(live.tolist()):
                h = self.step(u, x[t, :, :n], h[:, :n])
                states.append(h.T)
            lane = np.concatenate([np.arange(n) for n in live])
            step = np.repeat(np.arange(len(live)), live)
            logp, _ = self.outputs(np.concatenate(states), part[step, lane])
            out[order[:on]] += np.bincount(lane, weights=logp, minlength=on)
            at += len(steps)
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of one window of places (steps, lanes) from a state, the state after it, and its log probability."""
        (steps, lanes), n = inputs.shape, self.hidden
        x = self.inputs(inputs)
        going_on = (inputs != self.place[_END_ID]).astype(h.dtype)  # a new document starts afresh
        before, states, zr, c, hu = (np.empty((steps, k * n, lanes), h.dtype) for k in (1, 1, 2, 1, 3))
        u = self.recurrent()
        for t in range(steps):
            np.multiply(h, going_on[t], out=before[t])
            h = self.step(u, x[t], before[t], (states[t], zr[t], c[t], hu[t]))
        z, r, hu = zr[:, :n], zr[:, n:], hu[:, 2 * n :]
        # Of "wo" only the rows of runs of classes in "met" are filled.
        grads = {k: np.zeros_like(self.w[k]) for k in ("u", "b", "wc")} | {"wo": np.empty_like(self.w["wo"]), "met": [], "x": []}
        logp, dh_all = self.outputs(states.transpose(0, 2, 1).reshape(-1, n), targets.ravel(), grads)
        dh_all = np.ascontiguousarray(dh_all.reshape(steps, lanes, n).transpose(0, 2, 1))
        # By the state's gradient these give those of: update gate, reset gate, candidate's recurrent part, candidate.
        by = np.empty((steps, 4, n, lanes), h.dtype)
        keep = 1 - z
        np.multiply(keep, 1 - c * c, out=by[:, 3])
        np.multiply(by[:, 3], r, out=by[:, 2])
        np.multiply(by[:, 2] * hu, 1 - r, out=by[:, 1])
        np.multiply((before - c) * z, keep, out=by[:, 0])
        carry = np.zeros((n, lanes), h.dtype)
        for t in reversed(range(steps)):
            dh = dh_all[t] + carry
            by[t] *= dh
            carry = self.w["u"] @ by[t, :3].reshape(3 * n, lanes)
            carry += dh * z[t]
            carry *= going_on[t]
        grads["u"] += np.matmul(before, by[:, :3].reshape(steps, 3 * n, lanes).transpose(0, 2, 1)).sum(0)
        by[:, 2] = by[:, 3]
        dx = by[:, :3].reshape(steps, 3 * n, lanes).transpose(0, 2, 1).reshape(-1, 3 * n)
        which = inputs.ravel()
        order = np.argsort(which.astype(np.int16) if len(self.place) < 1 << 15 else which, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(which[order]) > 0]))
        grads["x"] = which[order][heads], np.add.reduceat(np.take(dx, order, axis=0), heads)
        grads["b"] += grads["x"][1].sum(0)
        return grads, h.copy(), float(logp.sum())

    def train(self, stream: np.ndarray, adam: dict, rate: float, lanes: int = 512, window: int = 16) -> None:
        """One pass over a stream of ids (documents end to end), cut into lanes with carried state."""
        place = self.place[stream]
        lanes = max(1, min(lanes, len(place) // window))
        width = len(place) // lanes
        if width < 1:
            return
        targets = np.ascontiguousarray(place[: lanes * width].reshape(lanes, width).T)
        inputs = np.concatenate([np.full((1, lanes), self.place[_END_ID]), targets[:-1]])
        h = np.zeros((self.hidden, lanes), np.float32)
        for at in range(0, width, window):
            part = slice(at, at + window)
            grads, h, _ = self.gradients(inputs[part], targets[part], h)
            self._update(grads, adam, rate, targets[part].size)

    def _update(self, grads: dict, adam: dict, rate: float, n: int) -> None:
        """Adam; of the tables by word only the rows met in this window (their moments rest meanwhile).

        Moments are kept as ten and a thousand times theirs, so that gradients are added as they are.
        """
        adam["t"] = t = adam.get("t", 0) + 1
        for k in self.w:
            if k not in adam:
                adam[k] = np.zeros_like(self.w[k]), np.zeros_like(self.w[k])
        parts = [(k, slice(None), grads[k]) for k in ("u", "b", "wc")]
        # Runs of rows in blocks that a processor keeps near.
        runs = [slice(at, min(at + 2000, b)) for a, b in grads["met"] for at in range(a, b, 2000)]
        parts += [("wo", rows, grads["wo"][rows]) for rows in runs] + [("x", *grads["x"])]
        unbiased = np.sqrt((1 - 0.999**t) * 1000)
        for k, rows, g in parts:
            # Slices are views and change in place, single rows are copies and go back.
            m, v, w = adam[k][0][rows], adam[k][1][rows], self.w[k][rows]
            g *= np.float32(1 / n)
            np.minimum(g, np.float32(0.05), out=g)
            np.maximum(g, np.float32(-0.05), out=g)
            m *= np.float32(0.9)
            m += g
            g *= g
            v *= np.float32(0.999)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-6 * unbiased)
            np.divide(m, g, out=g)
            g *= np.float32(rate * unbiased / (10 * (1 - 0.9**t)))
            w -= g
            if not isinstance(rows, slice):
                adam[k][0][rows], adam[k][1][rows], self.w[k][rows] = m, v, w


def _words(packed: bytes, lengths: np.ndarray) -> pa.Array:
    """Words (binary) from their bytes end to end and their lengths."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(packed)])


def _cut(values: np.ndarray | pa.Buffer, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values`` as a column, cut at each of ``ends`` (in bytes)."""
    at = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(values)])


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of texts (binary), each token as its number among them, and each text's tokens: as ``tokens``."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, at = parts.flatten(), parts.offsets.to_numpy()
    filled = pc.binary_length(flat).to_numpy() > 0  # white space at the ends of a text leaves empty parts
    ends = np.cumsum(np.diff(np.concatenate([[0], np.cumsum(filled)])[at - at[0]]) + 1)
    found = flat.filter(pa.array(filled)).dictionary_encode()
    codes = np.full(ends[-1], len(found.dictionary), np.int32)
    inner = np.ones(ends[-1], bool)
    inner[ends - 1] = False
    codes[inner] = found.indices.to_numpy()
    return pa.concat_arrays([found.dictionary.cast(pa.binary()), pa.array([END])]), codes, ends


ENCODED = (
    "block long, bucket long, doc_id long, held_out boolean, n_tokens long, codes binary, first int, words binary, lengths binary, n binary"
)


def encoded(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """Texts as numbers of their block's words, and those words with their counts in training documents.

    A block is a run of documents of one input partition; docs has doc_id, text and held_out.  A block's
    words are in order of their buckets, dealt by a hash: one row has all of a bucket, the first of them
    being the block's ``first``, end to end with their lengths and counts (32 bits each).
    """
    names = [f.split()[0] for f in ENCODED.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, size, rows, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def filled(rows_: int, **columns: pa.Array) -> pa.RecordBatch:
            own = {"block": pa.array(np.full(rows_, seq)), **columns}
            return pa.RecordBatch.from_arrays([own.get(k, pa.nulls(rows_, t)) for k, t in zip(names, kinds, strict=True)], names)

        def closed() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            words, codes, ends = numbered(t["text"].combine_chunks())
            sizes = np.diff(ends, prepend=0)
            train = ~np.repeat(t["held_out"].to_numpy(zero_copy_only=False), sizes)
            n = np.bincount(codes[train], minlength=len(words)).astype(np.int32)
            bucket = np.fromiter(map(crc32, words.to_pylist()), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            back = np.empty(len(order), np.int32)
            back[order] = np.arange(len(order))
            yield filled(
                len(t), doc_id=t["doc_id"].combine_chunks(), held_out=t["held_out"].combine_chunks(), n_tokens=pa.array(sizes),
                codes=_cut(back[codes], ends * 4),
            )
            words, bucket = words.take(pa.array(order)), bucket[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            until = np.append(first[1:], len(order))
            length = pc.binary_length(words).to_numpy().astype(np.int32)
            yield filled(
                len(first), bucket=pa.array(bucket[first]), first=pa.array(first, pa.int32()), words=_cut(words.buffers()[2], np.cumsum(length)[until - 1]),
                lengths=_cut(length, until * 4), n=_cut(n[order], until * 4),
            )

        for b in batches:
            begin = 0
            for i, k in enumerate(pc.binary_length(b.column(1)).to_pylist(), 1):
                size, rows = size + k, rows + 1
                if size >= block_bytes or rows >= 20_000:
                    held.append(b.slice(begin, i - begin))
                    yield from closed()
                    seq, size, rows, begin, held = seq + 1, 0, 0, i, []
            if begin < len(b):
                held.append(b.slice(begin))
        if held:
            yield from closed()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, ENCODED)


COUNTED = "block long, first int, words binary, lengths binary, c binary, total long, distinct long, ended long"


def counted(own: DataFrame, most: int) -> DataFrame:
    """Blocks' words with their counts in all training documents (64 bits each), one row per block and bucket.

    One shuffle brings the rows of a bucket together; a bucket has about as many words as a block.  One
    row more per bucket, without block, has its words that may be among the ``most`` most frequent ones,
    and how many training tokens, distinct words and end tokens it has.
    """

    def run(t: pa.Table) -> pa.Table:
        lengths = [np.frombuffer(x, np.int32) for x in t["lengths"].to_pylist()]
        words = _words(b"".join(t["words"].to_pylist()), np.concatenate(lengths)).dictionary_encode()
        at, n = words.indices.to_numpy(), np.frombuffer(b"".join(t["n"].to_pylist()), np.int32)
        c = np.zeros(len(words.dictionary), np.int64)
        np.add.at(c, at, n)
        end = pc.index(words.dictionary, pa.scalar(END, pa.large_binary())).as_py()
        few = np.flatnonzero(c >= max(1, np.partition(c, -most)[-most] if most < len(c) else 1))
        top = words.dictionary.take(pa.array(few)).to_pylist()
        return pa.table({
            "block": pa.concat_arrays([t["block"].combine_chunks(), pa.nulls(1, pa.int64())]),
            "first": pa.concat_arrays([t["first"].combine_chunks(), pa.nulls(1, pa.int32())]),
            "words": pa.array([*t["words"].to_pylist(), b"".join(top)], pa.binary()),
            "lengths": pa.array([*t["lengths"].to_pylist(), np.fromiter(map(len, top), np.int32, len(top)).tobytes()], pa.binary()),
            "c": pa.concat_arrays([_cut(c[at], np.cumsum([len(x) * 8 for x in lengths])), pa.array([c[few].tobytes()], pa.binary())]),
            **{k: pa.array([None] * len(t) + [int(x)], pa.int64()) for k, x in (("total", c.sum()), ("distinct", (c > 0).sum()), ("ended", 0 if end < 0 else c[end]))},
        })

    return own.groupBy("bucket").applyInArrow(run, COUNTED)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for words, lengths, c in zip(*(b.column(k).to_pylist() for k in ("words", "lengths", "c")), strict=True):
            own = _words(words, np.frombuffer(lengths, np.int32)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([own, pa.array(np.frombuffer(c, np.int64))], ["word", "c"])


def with_ids(counts: DataFrame, top: list[bytes]) -> DataFrame:
    """Model ids (16 bits each) in place of words; ``top`` are the model's words in order of their ids, the end first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pa.array(top, pa.large_binary())
        for b in batches:
            lengths = np.frombuffer(b"".join(b.column("lengths").to_pylist()), np.int32)
            at = pc.index_in(_words(b"".join(b.column("words").to_pylist()), lengths), value_set=model).fill_null(-1).to_numpy()
            ids = np.where(at > 0, at + 1, np.where(at == 0, _END_ID, _OTHER_ID)).astype(np.uint16)
            until = np.cumsum([len(x) // 4 for x in b.column("lengths").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("first"), b.column("c"), _cut(ids, until * 2)], ["block", "first", "c", "ids"])

    return counts.select("block", "first", "words", "lengths", "c").mapInArrow(run, "block long, first int, c binary, ids binary")


MAPPED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, rest double, ids binary"
DEALT = (
    "shard long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, "
    "rest array<double>, ids binary"
)


def dealt_out(coded: DataFrame, dictionary: DataFrame, scale: float, outside: float, shards: int) -> DataFrame:
    """One row per shard with its documents' counts, base scores and model ids.

    Shards are dealt by a hash of id and content and sorted, so they don't depend on the table's layout.
    """

    def mapped(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left["n_tokens"].to_numpy()
        idx = np.frombuffer(b"".join(left["codes"].to_pylist()), np.int32)
        right = right.sort_by("first")
        c, ids = (np.frombuffer(b"".join(right[k].to_pylist()), t) for k, t in (("c", np.int64), ("ids", np.uint16)))
        log_share = np.log10(c + 0.1)
        other = np.where(ids == _OTHER_ID, log_share - np.log10(outside), 0.0)
        ends = np.cumsum(n)
        summed = lambda x: np.add.reduceat(x[idx], ends - n) if len(n) else np.zeros(0)
        return pa.table({
            "doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": left["n_tokens"],
            "n_known": pa.array(summed((c > 0).astype(np.int64)).astype(np.int64)), "base": summed(log_share) - n * scale, "rest": summed(other),
            "ids": pa.array([x.tobytes() for x in np.split(ids[idx], ends[:-1])] if len(n) else [], pa.binary()),
        })

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("ids", "ascending")])
        one = {k: pa.array([t[k].to_pylist()]) for k in ("doc_id", "held_out", "n_tokens", "n_known", "base", "rest")}
        one["doc_id"] = one["doc_id"].cast(pa.list_(pa.int64()))
        return pa.table({"shard": t["shard"][:1], **one, "ids": pa.array([b"".join(t["ids"].to_pylist())], pa.binary())})

    rows = coded.select("block", "doc_id", "held_out", "n_tokens", "codes").groupBy("block")
    rows = rows.cogroup(dictionary.groupBy("block")).applyInArrow(mapped, MAPPED)
    rows = rows.withColumn("h", F.xxhash64("doc_id", "ids"))
    return rows.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(packed, DEALT)


def averaged(dealt: DataFrame, shards: int, model: Gru, rate: float, passes: int = 1, most: int | None = None, chunk: int = 65_536) -> np.ndarray:
    """Weights after training on each shard by itself, averaged by tokens; ``most`` bounds the tokens of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = model.flat()
        total, seen = np.zeros(len(begin)), 0
        for b in batches:
            for held, n, ids in zip(*(b.column(k) for k in range(3)), strict=True):
                train = ~np.repeat(np.array(held.as_py(), bool), n.as_py())
                stream = np.frombuffer(ids.as_py(), np.uint16)[train][:most]
                model.load(begin)
                adam: dict = {}
                for _ in range(passes):
                    model.train(stream, adam, rate)
                total += model.flat().astype(np.float64) * len(stream)
                seen += len(stream)
        if seen:
            total = (total / seen).astype(np.float32)
            parts = [total[i : i + chunk].tobytes() for i in range(0, len(total), chunk)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())],
                ["chunk", "n", "w"],
            )

    def mean(t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()
        w = np.einsum("i,ij->j", n / n.sum(), np.stack([np.frombuffer(x, np.float32) for x in t["w"].to_pylist()]).astype(float))
        return pa.table({"chunk": t["chunk"][:1], "n": [int(n.sum())], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    shape = "chunk int, n long, w binary"
    # Weights are sent on once per task, so a task takes several shards.
    tasks = max(1, shards // 8)
    trained = dealt.select("held_out", "n_tokens", "ids").coalesce(tasks).mapInArrow(run, shape)
    if tasks > 256:
        trained = trained.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("chunk", "salt").applyInArrow(mean, shape)
    # A fixed number of numbers, whatever the corpus size.
    rows = sorted(trained.groupBy("chunk").applyInArrow(mean, shape).collect(), key=lambda r: r["chunk"])
    if not rows:
        return model.flat()
    return np.concatenate([np.frombuffer(r["w"], np.float32) for r in rows])


def most_frequent(counts: DataFrame, words: int) -> list:
    """The first ``words`` rows (word, c) by falling count, then by word.

    A histogram of the counts, sixteen classes per factor of two, tells which rows can be among them; so
    what reaches the driver is about as many rows, however many tasks and words there are.
    """
    level = F.floor(F.log2("c") * 16).alias("level")
    found, least = 0, None
    for r in sorted(counts.groupBy(level).agg(F.count("*").alias("n")).collect(), reverse=True):
        found, least = found + r["n"], r["level"]
        if found >= words:
            break
    if least is None:
        return []
    # Of the last class more rows than needed may come, all with counts within five percent.
    few = materialize(counts.filter(level >= least).orderBy(F.desc("c"), "word").limit(words), "frequent")
    return sorted(few.collect(), key=lambda r: (-r["c"], bytes(r["word"])))


def score(
    docs: DataFrame,
    words: int = 20_000,
    hidden: int = 16,
    rounds: int = 3,
    start_tokens: int = 300_000,
    shard_tokens: int = 1_000_000,
    block_bytes: int = 8 << 20,
    score_tokens: int = 8_000_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    every = materialize(encoded(docs, block_bytes, max(1, -(-n_bytes // block_bytes))), "encoded")
    coded, own = every.filter("bucket is null"), every.filter("bucket is not null").select("bucket", "block", "first", "words", "lengths", "n")
    n_docs, n_tokens = coded.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    counts = materialize(counted(own, words + 1), "words")
    of_bucket = counts.filter("block is null")
    total, distinct, ended = of_bucket.agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("total", "distinct", "ended"))).first()
    frequent = of_bucket.select("words", "lengths", "c").mapInArrow(_unpacked, "word binary, c long")
    top = most_frequent(frequent.filter(F.col("word") != F.lit(bytearray(END))), words)
    known = np.array([ended, 0, *(r["c"] for r in top)], float)
    known[_OTHER_ID] = total - known.sum()
    # Smoothed shares among the words outside the model's vocabulary, one more for all unseen ones.
    outside = float(known[_OTHER_ID]) + 0.1 * (distinct - len(top) - (ended > 0) + 1)
    model = Gru(known, hidden)
    dictionary = with_ids(counts.filter("block is not null"), [END, *(bytes(r["word"]) for r in top)])
    shards = max(1, -(-n_tokens // shard_tokens), -(-n_docs // 20_000))
    scale = float(np.log10(total + 0.1 * (distinct + 1)))
    dealt = materialize(dealt_out(coded, dictionary, scale, outside, shards), "dealt")
    model.load(averaged(dealt.filter("shard = 0"), 1, model, 0.01, passes=2, most=start_tokens))
    rounds = min(rounds, shards)
    for r in range(rounds):
        model.load(averaged(dealt.filter(F.col("shard") % rounds == r), shards // rounds, model, 0.003))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def together() -> pa.RecordBatch:
            """Scores of the shards at hand: long documents of several shards go on side by side."""
            doc, known_, base, rest = (np.concatenate([r[k] for r in held]) if k else pa.concat_arrays([r[k] for r in held]) for k in (0, 3, 4, 5))
            n, held_ = np.concatenate([r[2] for r in held]), pa.concat_arrays([r[1] for r in held])
            ids = np.concatenate([r[6] for r in held])
            own = model.score(np.split(ids, np.cumsum(n)[:-1])) / np.log(10) + rest
            held.clear()
            return pa.RecordBatch.from_arrays(
                [doc, held_, *map(pa.array, (n, known_, np.full(len(n), int(total)), base, own))], [f.split()[0] for f in SCORED.split(", ")]
            )

        for b in batches:
            for doc, out, *numbers, ids in zip(*b.columns[1:], strict=True):
                held.append((doc.values, out.values, *(x.values.to_numpy() for x in numbers), np.frombuffer(ids.as_py(), np.uint16)))
                if sum(len(r[6]) for r in held) >= score_tokens:
                    yield together()
        if held:
            yield together()

    return dealt.mapInArrow(scored, SCORED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
