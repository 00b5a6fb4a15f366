"""Language-model scoring with a small gated recurrent network.

Words are counted over all training texts. Frequent words form the head: each has a class by frequency, and the network
predicts class, then word within the class (class-factored softmax). All other words share tail classes by their
spelling; within a tail class a word has its add-one share of the class's training tokens, unknown words counting as one
more type, so that the model is a proper distribution over texts. Texts are turned into symbol numbers once; a GRU in
numpy is trained on those of all training documents by truncated backpropagation, in shards whose weights Spark averages
after each round. In scoring, texts run side by side in lanes and the state is carried from window to window, so the
likelihood is that of the whole document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import md5_unit, stored

END = " end"  # no word has a space
HELD_OUT, MODULUS = 2, 7
#: Words that the network knows one by one, in classes of CLASS_SIZE; and words whose counts are sent to tasks, which
#: saves a join but changes no result.
HEAD, CLASS_SIZE, SENT = 1024, 32, 200_000
TAIL_CLASSES = 32
HIDDEN = 16
#: Steps of a window, and lanes side by side in training and in scoring.
WINDOW, TRAIN_LANES, LANES = 48, 128, 512
#: The network sees every training document once, in ROUNDS rounds of different documents.
ROUNDS = 3
#: Tokens of a shard. Corpora of more than MAX_SHARDS such shards have MAX_SHARDS larger ones, which are streamed.
SHARD_TOKENS, MAX_SHARDS = 2_000_000, 4096
RATE, CLIP = 0.03, 10.0
#: A task counts so many tokens at once, and scores so many: the longest text sets how many steps a run takes.
CHUNK, SCORED = 2_000_000, 4_000_000
#: Texts are numbered by runs of so many bytes.
PIECE = 1 << 20
#: Weights are averaged in so many parts.
PARTS = 64


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts in lower case (A-Z), and how many each text has; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(words), 0)  # spaces at the ends give empty words
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), np.diff(before[bounds])


def tail_classes(words: pa.Array) -> np.ndarray:
    """Spelling class of each word (none empty): its last two bytes and whether any byte is over 127, as a hash."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[: ends[-1]]
    high = np.concatenate([[0], np.cumsum(data > 127, dtype=np.int64)])
    last, long = data[ends[1:] - 1].astype(np.int64), np.diff(ends) > 1
    last2 = np.where(long, data[np.maximum(ends[1:] - 2, 0)], 0).astype(np.int64)
    code = (high[ends[1:]] > high[ends[:-1]]) * 65536 + last2 * 256 + last
    return (code * 2654435761 >> 15) % TAIL_CLASSES


class Vocabulary:
    """The sent words in order of frequency with their counts, classes of the first HEAD, and totals of the tail classes."""

    def __init__(self, words: list[str], counts: list[int], total: int, types: int, tails: dict[int, tuple[int, int]]):
        self.total, self.types = total, types
        self.words, self.count = pa.array(words, pa.string()), np.array(counts, np.float64)
        self.head = min(HEAD, len(words))
        self.classes = -(-self.head // CLASS_SIZE)
        self.outputs = self.classes + TAIL_CLASSES
        tail = np.array([tails.get(i, (0, 0)) for i in range(TAIL_CLASSES)], float)
        self.tail_log = np.log10(tail[:, 0] + tail[:, 1] + 1)
        head_counts = self.count[: self.head] if self.head else np.ones(1)
        by_class = [head_counts[i : i + CLASS_SIZE].sum() for i in range(0, self.head, CLASS_SIZE)]
        self.class_prior = np.log(np.array([*by_class, *tail[:, 0]]) + 1.0)
        self.word_prior = np.full((max(self.classes, 1), CLASS_SIZE), -30.0)
        self.word_prior.ravel()[: self.head] = np.log(head_counts[: self.head])

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of the words among the sent ones, -1 for others. Looked up is each sent word among the few different ones
        here: a table of all sent words would be built anew at each call."""
        coded = words.dictionary_encode()
        at = pc.fill_null(pc.index_in(self.words, value_set=coded.dictionary), -1).to_numpy()
        out, sent = np.full(len(coded.dictionary), -1, np.int64), np.flatnonzero(at >= 0)
        out[at[sent]] = sent
        return out[coded.indices.to_numpy()]

    def symbols(self, places: np.ndarray, words: pa.Array) -> np.ndarray:
        """Head words by number, all others HEAD + class."""
        out = places.copy()
        other = (places < 0) | (places >= self.head)
        out[other] = HEAD + tail_classes(words.filter(pa.array(other)))
        return out.astype(np.int16)


def start_weights(v: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return {
        "x": normal(HEAD + TAIL_CLASSES, 3 * HIDDEN, s=0.3),  # input side of the gates, a row a symbol
        "h": normal(HIDDEN, 3 * HIDDEN, s=0.25),
        "g": np.zeros(3 * HIDDEN, np.float32),
        "c": normal(HIDDEN, v.outputs, s=0.05),
        "d": (v.class_prior - v.class_prior.max()).astype(np.float32),
        "w": normal(max(v.classes, 1), HIDDEN, CLASS_SIZE, s=0.05),
        "b": (v.word_prior - v.word_prior.max(axis=1, keepdims=True)).astype(np.float32),
    }


def windows_of(docs: list[np.ndarray], lanes: int = LANES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Deals whole documents to lanes, the longest first, each to the emptiest lane, and hands the lanes on window by
    window: (symbols one step earlier, symbols, document, first) as time x lane arrays; document -1 fills up. The longest
    lane comes first and a lane that has ended is left out, so a very long document costs no more than its own length."""
    if not docs:
        return
    heap, own = [(0, i) for i in range(min(lanes, len(docs)))], [[] for _ in range(min(lanes, len(docs)))]
    for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
        at, lane = heapq.heappop(heap)
        own[lane].append(k)
        heapq.heappush(heap, (at + len(docs[k]), lane))
    own.sort(key=lambda ks: -sum(len(docs[k]) for k in ks))
    symbols = [np.concatenate([docs[k] for k in ks]) for ks in own]
    owners = [np.repeat(np.array(ks, np.int32), [len(docs[k]) for k in ks]) for ks in own]
    last, open_lanes = np.zeros(len(own), np.int64), len(own)
    before_owner = np.full(len(own), -1, np.int32)
    for a in range(0, len(symbols[0]), WINDOW):
        while len(symbols[open_lanes - 1]) <= a:
            open_lanes -= 1
        steps = min(WINDOW, len(symbols[0]) - a)
        x, doc = np.zeros((open_lanes, steps), np.int64), np.full((open_lanes, steps), -1, np.int32)
        for i in range(open_lanes):
            part = symbols[i][a : a + steps]
            x[i, : len(part)] = part
            doc[i, : len(part)] = owners[i][a : a + steps]
        x, doc = np.ascontiguousarray(x.T), np.ascontiguousarray(doc.T)
        first = np.vstack([doc[:1] != before_owner[:open_lanes], doc[1:] != doc[:-1]])
        before = np.vstack([last[:open_lanes], x[:-1]])
        last, before_owner = x[-1], doc[-1]
        yield before, x, doc, first


def _by_gate(w: np.ndarray) -> np.ndarray:
    """Weights of the three gates (update, reset, candidate), side by side in w, as three arrays one after another."""
    return np.ascontiguousarray(w.reshape(len(w), 3, HIDDEN).transpose(1, 0, 2))


def run_window(p: dict, x: np.ndarray, first: np.ndarray, before: np.ndarray, h: np.ndarray, keep: bool):
    """States before each symbol of a window, and the state after it. before: the symbols one step earlier. Each gate has an
    array of its own, so that a step's work is on whole blocks."""
    n = HIDDEN
    fed = _by_gate(np.vstack([p["x"], np.zeros((1, 3 * n), p["x"].dtype)]) + p["g"])  # the last row: a document begins from nothing
    w = _by_gate(p["h"])
    # sigmoid(a) = 1 / (1 + exp(-a)), where exp may be infinite
    np.negative(fed[:2], out=fed[:2])
    np.negative(w[:2], out=w[:2])
    w_zr, w_c = w[:2], w[2]
    symbol = np.where(first, len(p["x"]), before)
    gates = np.stack([own.take(symbol, axis=0) for own in fed], axis=1)
    kind, kept, width = np.result_type(h, w), len(x) if keep else 1, x.shape[1]
    states, zrs, rhs, cs = (np.empty((steps, *k, n), kind) for steps, k in ((len(x), (width,)), (kept, (2, width)), (kept, (width,)), (kept, (width,))))
    begins, start, one = first.any(axis=1), h, np.float32(1)
    with np.errstate(over="ignore"):
        for t in range(len(x)):
            if begins[t]:
                h = np.where(first[t][:, None], np.float32(0), h)
            zr, rh, c, own = zrs[t % kept], rhs[t % kept], cs[t % kept], states[t]
            np.matmul(h, w_zr, out=zr)
            zr += gates[t, :2]
            np.exp(zr, out=zr)
            zr += one
            np.reciprocal(zr, out=zr)
            z, r = zr
            np.multiply(r, h, out=rh)
            np.matmul(rh, w_c, out=c)
            c += gates[t, 2]
            np.tanh(c, out=c)
            np.subtract(c, h, out=own)
            own *= z
            own += h
            h = own
    if not keep:
        return states, h, None
    h0 = np.concatenate([start[None], states[:-1]])
    h0[first] = 0
    return states, h, (h0, zrs[:, 0], zrs[:, 1], rhs, cs)


def _choices(a: np.ndarray, chosen: np.ndarray, slopes: bool):
    """Log softmax of the logits a at the chosen columns, and with slopes the gradient of its negative, in a's place. Logits
    are bounded, as states are, so no maximum has to be taken off them."""
    rows = np.arange(len(a))
    picked = a[rows, chosen]
    np.exp(a, out=a)
    total = a @ np.ones(a.shape[1], np.float32)
    out = picked - np.log(total)
    if not slopes:
        return out, None
    a /= total[:, None]
    a[rows, chosen] -= 1
    return out, a


def outputs(p: dict, s: np.ndarray, y: np.ndarray, classes: int, grads: dict | None = None):
    """Natural log-likelihood of symbols y (without the share within tail classes) given states s; with grads, sets the
    gradients of its negative and returns those of the states too."""
    target = np.where(y < HEAD, y // CLASS_SIZE, classes + y - HEAD).astype(np.int16)
    order = np.argsort(target, kind="stable")  # a radix sort; equal classes then lie side by side
    s, y, target = s.take(order, axis=0), y.take(order), target.take(order)
    logits = s @ p["c"]
    logits += p["d"]
    out, g = _choices(logits, target, grads is not None)
    ds = None
    if grads is not None:
        grads["c"][:], grads["d"][:] = s.T @ g, g.sum(axis=0)
        ds = g @ p["c"].T
    bounds = np.searchsorted(target, np.arange(classes + 1)).tolist()
    met, inside = [k for k in range(classes) if bounds[k] < bounds[k + 1]], bounds[classes]
    if met:
        # products are taken class by class, all else over all words of the head at once
        logits = p["b"].take(target[:inside], axis=0).astype(s.dtype, copy=False)
        for k in met:
            logits[bounds[k] : bounds[k + 1]] += s[bounds[k] : bounds[k + 1]] @ p["w"][k]
        inner, g = _choices(logits, y[:inside] - target[:inside] * CLASS_SIZE, grads is not None)
        out[:inside] += inner
        if grads is not None:
            grads["b"][met] = np.add.reduceat(g, [bounds[k] for k in met], axis=0)
            for k in met:
                own = slice(bounds[k], bounds[k + 1])
                np.matmul(s[own].T, g[own], out=grads["w"][k])
                ds[own] += g[own] @ p["w"][k].T
    back = np.empty_like(out)
    back[order] = out
    if ds is not None:
        unsorted = np.empty_like(ds)
        unsorted[order] = ds
        ds = unsorted
    return back, ds


def gradients(p: dict, before: np.ndarray, xs: np.ndarray, owner: np.ndarray, fs: np.ndarray, h: np.ndarray, classes: int):
    """Gradients of a window's negative log-likelihood, which end at its start, and the state after it."""
    n, live, width = HIDDEN, owner >= 0, xs.shape[1]
    states, h, trace = run_window(p, xs, fs, before, h, True)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    back = np.zeros_like(states)
    _, back[live] = outputs(p, states[live], xs[live], classes, grads)
    # of each step the gradients by gate, and those of the state
    dg, dh = np.empty((len(xs), 3, width, n), np.float32), np.zeros((width, n), np.float32)
    h0, z, r, rh, c = trace
    # what doesn't depend on later steps, for all steps at once
    by_c, by_z, by_r = z * (1 - c * c), (c - h0) * z * (1 - z), h0 * r * (1 - r)
    keep, back_by = 1 - z, np.ascontiguousarray(_by_gate(p["h"]).transpose(0, 2, 1))
    begins, drh, by_state = fs.any(axis=1), np.empty((width, n), dh.dtype), np.empty((2, width, n), dh.dtype)
    to_zr, to_rh = np.ascontiguousarray(back_by[:2]), back_by[2]
    for t in range(len(xs) - 1, -1, -1):
        dh += back[t]
        dz, dr, dc = dg[t]
        np.multiply(dh, by_c[t], out=dc)
        np.matmul(dc, to_rh, out=drh)
        np.multiply(dh, by_z[t], out=dz)
        np.multiply(drh, by_r[t], out=dr)
        dh *= keep[t]
        drh *= r[t]
        dh += drh
        np.matmul(dg[t, :2], to_zr, out=by_state)
        dh += by_state[0]
        dh += by_state[1]
        if begins[t]:
            dh[fs[t]] = 0
    by_gate = [np.ascontiguousarray(dg[:, k]).reshape(-1, n) for k in range(3)]
    fed = np.flatnonzero(~fs)  # places that fill up have no gradient and may be counted in
    symbol = before.ravel()[fed].astype(np.int16)
    order = np.argsort(symbol, kind="stable")
    fed, symbol = fed[order], symbol[order]
    at, rows = np.flatnonzero(np.diff(symbol, prepend=-1)), np.empty((len(fed), 3 * n), np.float32)
    ones = np.ones(by_gate[0].shape[0], np.float32)
    for k, (own, seen) in enumerate(zip(by_gate, (h0, h0, rh))):
        part = slice(k * n, (k + 1) * n)
        grads["h"][:, part] = seen.reshape(-1, n).T @ own
        grads["g"][part] = ones @ own
        rows[:, part] = own.take(fed, axis=0)
    if len(fed):
        grads["x"][symbol[at]] = np.add.reduceat(rows, at, axis=0)
    return grads, int(live.sum()), h


class Learner:
    """Weights that learn by adaptive steps."""

    def __init__(self, p: dict):
        self.p = {k: v.copy() for k, v in p.items()}
        self.squares = {k: np.full_like(v, 1e-6) for k, v in p.items()}

    def learn(self, docs: list[np.ndarray], classes: int, lanes: int = TRAIN_LANES) -> None:
        """One pass of truncated backpropagation: gradients end at a window's start, the state goes on."""
        h = np.zeros((lanes, HIDDEN), np.float32)
        for before, xs, owner, fs in windows_of(docs, lanes):
            grads, count, h = gradients(self.p, before, xs, owner, fs, h[: xs.shape[1]], classes)
            for k, g in grads.items():
                # most symbols aren't met in a window: their rows stay as they are
                met = np.flatnonzero(g.any(axis=1)) if k == "x" else slice(None)
                g = g[met]
                g /= np.float32(np.sqrt(max(1, count)))
                norm = float(np.sqrt(np.vdot(g, g)))
                if norm > CLIP:
                    g *= np.float32(CLIP / norm)
                self.squares[k][met] += g * g
                g *= np.float32(RATE)
                g /= np.sqrt(self.squares[k][met])
                self.p[k][met] -= g


def likelihoods(p: dict, docs: list[np.ndarray], classes: int) -> np.ndarray:
    """Base-10 log-likelihood of each document's symbols."""
    out, h = np.zeros(len(docs)), np.zeros((LANES, HIDDEN), np.float32)
    for before, xs, owner, first in windows_of(docs):
        states, h, _ = run_window(p, xs, first, before, h[: xs.shape[1]], False)
        live = owner >= 0
        logs, _ = outputs(p, states[live], xs[live], classes)
        out += np.bincount(owner[live], weights=logs, minlength=len(docs))
    return out / np.log(10)


# The symbol that a state predicts is fed only in the next step: run_window reads `before`, so the state that scores
# symbol t has seen symbols up to t - 1.


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 7, is 2; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % MODULUS == HELD_OUT


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[pa.Array] = []
    size = texts = 0

    def out() -> pa.RecordBatch:
        counted = pa.chunked_array(kept, pa.string()).combine_chunks().value_counts()
        words, c = counted.field("values"), counted.field("counts")
        words = pa.concat_arrays([words, pa.array([END])])
        c = np.append(c.to_numpy(), texts)
        return pa.RecordBatch.from_arrays([words, pa.array(c, pa.int64()), pa.array(tail_classes(words), pa.int32())], names=["word", "c", "tail"])

    for batch in batches:
        words, _ = split_words(batch.column(0))
        kept.append(words)
        size, texts = size + len(words), texts + len(batch.column(0))
        if size > CHUNK:
            yield out()
            kept, size, texts = [], 0, 0
    if texts:
        yield out()


def word_counts(train_docs: DataFrame) -> DataFrame:
    """(word, c, tail) over all training texts, in the shared folder."""
    partial = train_docs.select("text").mapInArrow(_count, "word string, c long, tail int")
    return stored(partial.groupBy("word").agg(F.sum("c").alias("c"), F.first("tail").alias("tail")), "counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head and the sent counts, and totals of the tail classes. Sent are the most frequent words: whole levels of
    frequency, and of the level that would be too many the share that fits, by a hash of the word. Sorting for the first
    would draw so many from every partition."""
    level = F.floor(F.log2("c") * 16)
    sizes = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # 1,024 levels at most
    full, part, free = float("inf"), None, SENT
    for at in sorted(sizes, reverse=True):
        if sizes[at] > free:
            part = at
            break
        full, free = at, free - sizes[at]
    share = int(free / sizes[part] * (1 << 60)) if part is not None else 0
    wanted = (level >= full) | ((level == F.lit(part)) & (md5_unit("word") < share)) if part is not None else F.lit(True)
    rows = counts.filter(wanted).select("word", "c").toArrow()
    top = sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist()), key=lambda w: (-w[1], w[0]))
    head = counts.sparkSession.createDataFrame([(w,) for w, _ in top[:HEAD]], "word string")
    rest = counts.join(F.broadcast(head), "word", "left_anti").groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Vocabulary([w for w, _ in top], [c for _, c in top], int(total[0]), int(total[1]), {r.tail: (r.c, r.v) for r in rest.collect()})


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(values: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _summed(parts: pa.Table) -> pa.Table:
    values = sum((np.frombuffer(v.as_py(), np.float64) for v in parts["v"]), 0.0)
    return pa.table({"part": parts["part"][:1], "v": pa.array([values.tobytes()], pa.binary()), "n": pa.array([sum(parts["n"].to_pylist())], pa.float64())})


def fitted(texts: DataFrame, v: Vocabulary) -> dict:
    """Network weights after ROUNDS rounds over texts(shard_key, symbols): each shard trains on its documents of the round,
    Spark averages by tokens. Shards are dealt and ordered by the key, a hash of the document, so the weights don't
    depend on how the table is partitioned."""
    spark = texts.sparkSession
    p = start_weights(v)
    if not v.total:
        return p
    shards = int(min(MAX_SHARDS, max(1, -(-v.total // SHARD_TOKENS))))
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast((p, v.classes))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, classes = sent.value
            learner, docs, size, total = Learner(start), [], 0, 0
            for batch in batches:
                for symbols in batch.column(0):
                    docs.append(np.frombuffer(symbols.as_py(), np.int16))
                    size, total = size + len(docs[-1]), total + len(docs[-1])
                    if size > CHUNK:
                        learner.learn(docs, classes)
                        docs, size = [], 0
            if docs:
                learner.learn(docs, classes)
            if total:
                pieces = np.array_split(flat(learner.p).astype(np.float64) * total, PARTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary()), pa.array([float(total)] * PARTS)], names=["part", "v", "n"]
                )

        own = texts.filter(F.pmod(F.xxhash64("shard_key"), F.lit(ROUNDS)) == r)
        dealt = own.repartition(shards, "shard_key").sortWithinPartitions("shard_key").select("symbols")
        sums = dealt.mapInArrow(learn, "part int, v binary, n double").groupBy("part").applyInArrow(_summed, "part int, v binary, n double")
        rows = sorted(sums.collect(), key=lambda x: x.part)  # PARTS rows, together as long as the weights
        sent.unpersist()
        if rows:
            p = shaped(np.concatenate([np.frombuffer(x.v, np.float64) / x.n for x in rows]), p)
    return p


FACTS = "doc_id long, n_tokens long, n_sent long, base double, inside double, rare array<string>, times array<long>, symbols binary"


def _numbered(v: Vocabulary, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """FACTS of some texts: symbols, what the sent counts say, and the words they say nothing of."""
    words, sizes = split_words(texts)
    places = v.places(words)
    symbols, unknown = v.symbols(places, words), np.flatnonzero(places < 0)
    log_count = np.append(np.log10(v.count + 1), 0.0)  # -1 reads the last: nothing is known yet
    ends = np.cumsum(sizes)
    # the end of each text is a word of its own
    end_word = pa.array([END])
    end = v.places(end_word)
    places, symbols = np.insert(places, ends, end[0]), np.insert(symbols, ends, v.symbols(end, end_word)[0])
    n, begin = sizes + 1, np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    logs = log_count[places]
    tail = symbols >= HEAD
    outside = np.where(tail, logs - v.tail_log[np.maximum(symbols - HEAD, 0)], 0.0)
    total = lambda x: np.add.reduceat(x, begin)
    if v.types == len(v.words):
        unknown = unknown[:0]  # all counts were sent
    coded = words.take(pa.array(unknown)).dictionary_encode()
    owner = np.searchsorted(ends, unknown, side="right")
    key, times = np.unique(owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    owner, code = key // max(1, len(coded.dictionary)), key % max(1, len(coded.dictionary))
    offsets = pa.array(np.searchsorted(owner, np.arange(len(n) + 1)), pa.int32())
    data = symbols.tobytes()
    cut = np.append(begin, begin[-1] + n[-1]) * symbols.itemsize
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(n, pa.int64()),
            pa.array(total((places >= 0).astype(np.int64)), pa.int64()),
            pa.array(total(logs) - n * np.log10(v.total + v.types + 1)),
            pa.array(total(outside)),
            pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(code))),
            pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
            pa.array([data[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
        ],
        names=["doc_id", "n_tokens", "n_sent", "base", "inside", "rare", "times", "symbols"],
    )


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """All rows of a batch, in runs of about PIECE bytes of text: work on words takes many times the text's size."""
    n = batch.num_rows
    past = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
    starts = np.flatnonzero(np.diff(past, prepend=-1))
    for a, b in zip(starts, [*starts[1:], n]):
        yield batch.slice(int(a), int(b - a))


def numbered(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """FACTS of rows(doc_id, text), with `shard_key` and a row number `_row`, in the shared folder."""
    sent = rows.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                yield _numbered(sent.value, piece.column(0), piece.column(1))

    facts = rows.mapInArrow(run, FACTS).withColumn("shard_key", F.xxhash64("doc_id", "symbols"))
    return stored(facts.withColumn("_row", F.monotonically_increasing_id()), "symbols")


def score(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row a document row.

    Counts and network learn from all training texts. Null and empty texts are the end token alone. Without training
    texts N and V are 0 and both scores are those of unknown words. Words beyond the sent counts are looked up by a join.
    Rows are told apart by where they are stored; equal or null doc_ids do no harm. Very long texts are
    read window by window with the state carried on; repeated rows get equal scores; no rows give none. Other columns are
    ignored."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    counts = word_counts(rows.filter(~held_out()))
    v = vocabulary(counts)
    facts = numbered(rows, v)
    network = docs.sparkSession.sparkContext.broadcast((fitted(facts.filter(~held_out()).select("shard_key", "symbols"), v), v.classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, classes = network.value
        kept: list[pa.RecordBatch] = []
        symbols: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            known = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*known.columns, pa.array(likelihoods(p, symbols, classes))], names=[*known.schema.names, "network"])

        for batch in batches:
            kept.append(batch.select(batch.schema.names[:-1]))
            symbols += [np.frombuffer(x.as_py(), np.int16) for x in batch.column(batch.num_columns - 1)]
            size += sum(map(len, symbols[len(symbols) - batch.num_rows :]))
            if size > SCORED:
                yield out()
                kept, symbols, size = [], [], 0
        if symbols:
            yield out()

    columns = ["_row", "doc_id", "n_tokens", "n_sent", "base", "inside"]
    schema = "_row long, doc_id long, n_tokens long, n_sent long, base double, inside double, network double"
    scored = facts.select(*columns, "symbols").mapInArrow(run, schema)
    asked = facts.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("_row", F.col("w.rare").alias("word"), F.col("w.times").alias("t"))
    told = asked.join(counts.select("word", "c"), "word").groupBy("_row").agg(F.sum("t").alias("_t"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("_l"))
    joined = scored.join(told, "_row", "left")
    more = F.coalesce("_l", F.lit(0.0))
    return joined.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_sent") + F.coalesce("_t", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("network") + F.col("inside") + more).alias("score"),
    )
