"""A gated recurrent language model in numpy with a class-factored output.

Word counts cover all training documents (exact sums by word hash, exchanged in compact blocks).
The most frequent words each have an input vector and an output vector in a class of words of like
frequency; all other words share classes by the size of their count, in which a word's share is its
smoothed count. log P(word) = log P(class | state) + log P(word | class, state). The network is
trained by truncated backpropagation on all training documents: every block trains on its part of
the round's documents from the same start, the parameters are averaged over all blocks, and a second
round goes on from there with the other documents. A document is scored whole: its state is carried from window to window.

Defined results: a null or empty text is one end token; a null doc_id counts as held out; without
training tokens the model's score is the base score; a very long text is scored whole, its state
carried on; words that tie in count rank by their hash; repeated rows count and score like any
others, equal texts have equal base scores; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm import blocks as B
from dagloom.llm.tokens import Texts, list_array, word_hashes
from dagloom.session import cut, release

ALPHA = 0.1
HIDDEN = 16
#: words with vectors of their own: classes of so many words each
HEAD_CLASSES, CLASS_WORDS = 32, 32
HEAD = HEAD_CLASSES * CLASS_WORDS
#: other words' classes: counts 0 and 1, 2 to 3, 4 to 7, ...
TAIL_CLASSES = 24
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: rounds of training; each document that is not held out is learned from in one of them
ROUNDS = 2
WINDOW, STREAMS, RATE = 24, 128, 1.2e-2
SCORE_WINDOW = 32


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([i == B.NULL_ID or zlib.crc32(str(i).encode()) % 10 == 0 for i in ids.tolist()], bool)


def _bins(count: np.ndarray) -> np.ndarray:
    """Tail class of a count: floor(log2), at most the last."""
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), TAIL_CLASSES - 1)


@dataclass
class Vocabulary:
    n: int  # training tokens
    v: int  # distinct training tokens
    ends: int  # end tokens in training
    keys: np.ndarray  # head words' hashes, ascending
    index: np.ndarray  # their place by falling count; the end token has place `end`
    counts: np.ndarray  # counts by place
    end: int
    tail_n: np.ndarray  # words of each tail class
    tail_sum: np.ndarray  # their counts

    @classmethod
    def of(cls, top: list[tuple[int, int]], words: np.ndarray, sums: np.ndarray, ends: int) -> Vocabulary:
        """top: (count, hash) of the most frequent words; words, sums: number of words and sum of
        counts by bin, of all words."""
        top = sorted(top, key=lambda x: (-x[0], x[1]))[: HEAD - 1]
        counts = [c for c, _ in top]
        end = sum(c > ends for c in counts)
        place = np.array([i + (i >= end) for i in range(len(top))], np.int64)
        keys = np.array([h for _, h in top], np.int64).view(np.uint64)
        order = np.argsort(keys)
        tail_n, tail_sum = words.copy(), sums.copy()
        for c in counts:
            b = int(_bins(np.array([c]))[0])
            tail_n[b] -= 1
            tail_sum[b] -= c
        all_counts = np.zeros(HEAD)
        all_counts[place] = counts
        all_counts[end] = ends
        return cls(int(sums.sum()) + ends, int(words.sum()) + (ends > 0), ends, keys[order], place[order], all_counts, end, tail_n, tail_sum)

    def tokens(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct words: the token (head place, or HEAD + tail class) and log P(word | tail class)."""
        token = HEAD + _bins(counts)
        rare = token == HEAD
        mass = self.tail_sum[token - HEAD] + np.where(rare, ALPHA * (self.tail_n[0] + 1), 0)
        inside = np.log(np.where(rare, counts + ALPHA, np.maximum(counts, 1)) / np.maximum(mass, ALPHA))
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            on = self.keys[at] == keys
            token[on], inside[on] = self.index[at[on]], 0.0
        return token, inside


Params = dict[str, np.ndarray]


def start(vocabulary: Vocabulary, seed: int = 9) -> Params:
    """Small random weights; output biases are the corpus's own log frequencies."""
    rng = np.random.default_rng(seed)
    head = vocabulary.counts.reshape(HEAD_CLASSES, CLASS_WORDS) + ALPHA
    tail = vocabulary.tail_sum + ALPHA * np.concatenate([[vocabulary.tail_n[0] + 1], np.zeros(TAIL_CLASSES - 1)])
    classes = np.concatenate([head.sum(1), np.maximum(tail, 1e-3)])
    scale = 1 / np.sqrt(HIDDEN)
    p = {
        "x": rng.normal(0, 0.3, (HEAD + TAIL_CLASSES, 3 * HIDDEN)),
        "u": rng.normal(0, scale, (HIDDEN, 2 * HIDDEN)),
        "uc": rng.normal(0, scale, (HIDDEN, HIDDEN)),
        "wc": np.zeros((HIDDEN, CLASSES)),
        "bc": np.log(classes / classes.sum()),
        "wo": np.zeros((HEAD_CLASSES, HIDDEN, CLASS_WORDS)),
        "bo": np.log(head / head.sum(1, keepdims=True)),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def _views(values: np.ndarray, like: Params) -> Params:
    """The parameters of flat(), not copied."""
    at = np.cumsum([0, *[like[k].size for k in sorted(like)]])
    return {k: values[a:b].reshape(like[k].shape) for k, a, b in zip(sorted(like), at[:-1], at[1:], strict=True)}


def unflat(values: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(p: Params, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step: a is the input's row of p["x"]."""
    gates = _sigmoid(a[:, : 2 * HIDDEN] + h @ p["u"])
    r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
    rh = r * h
    c = np.tanh(a[:, 2 * HIDDEN :] + rh @ p["uc"])
    return h + z * (c - h), gates, rh, c


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _class_of(token: np.ndarray) -> np.ndarray:
    return np.where(token < HEAD, token // CLASS_WORDS, token - HEAD + HEAD_CLASSES)


def _by_class(classes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(head class, rows of it)."""
    order = np.argsort(classes, kind="stable")
    off = np.searchsorted(classes[order], np.arange(HEAD_CLASSES + 1))
    return [(k, order[off[k] : off[k + 1]]) for k in range(HEAD_CLASSES) if off[k] < off[k + 1]]


def log_probs(p: Params, h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """log P of each token's class, and within it of a head word, after state h."""
    classes = _class_of(token)
    x = h @ p["wc"]
    x += p["bc"]
    x -= x.max(1, keepdims=True)
    out = x[np.arange(len(token)), classes]
    out -= np.log(np.exp(x, out=x).sum(1))
    for k, rows in _by_class(classes):
        y = h[rows] @ p["wo"][k]
        y += p["bo"][k]
        y -= y.max(1, keepdims=True)
        mine = y[np.arange(len(rows)), token[rows] % CLASS_WORDS]
        out[rows] += mine - np.log(np.exp(y, out=y).sum(1))
    return out


def train(p: Params, tokens: np.ndarray, begin: np.ndarray, end: int) -> tuple[Params, int]:
    """Truncated backpropagation over streams of documents back to back. tokens: all documents'
    tokens; begin: True at a document's first. The state carries over windows, gradients do not. The
    last stream is padded with tokens of no loss."""
    streams = max(1, min(STREAMS, len(tokens) // WINDOW))
    length = -(-len(tokens) // streams)
    if not length:
        return p, 0
    pad = streams * length - len(tokens)
    target = np.concatenate([tokens, np.full(pad, end, tokens.dtype)]).reshape(streams, length).T
    fresh = np.concatenate([begin, np.ones(pad, bool)]).reshape(streams, length).T.copy()
    real = (np.arange(streams * length) < len(tokens)).reshape(streams, length).T
    fresh[0] = True
    given = np.concatenate([np.full((1, streams), end), target[:-1]])
    given = np.where(fresh, end, given)
    values = flat(p)
    p = _views(values, p)
    m, v = np.zeros_like(values), np.zeros_like(values)
    h = np.zeros((streams, HIDDEN), np.float32)
    for t, a in enumerate(range(0, length, WINDOW), 1):
        b = min(a + WINDOW, length)
        by_name, h = _window(p, given[a:b], target[a:b], fresh[a:b], h, real[a:b])
        g = flat(by_name)
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        m *= 0.9
        m += 0.1 * g
        v *= 0.999
        g *= g
        g *= 0.001
        v += g
        np.sqrt(v, out=g)
        g += 1e-7
        np.divide(m, g, out=g)
        g *= RATE * fix
        values -= g
    return p, len(tokens)


def _window(p: Params, given: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray, real: np.ndarray | None = None) -> tuple[Params, np.ndarray]:
    """Gradients of the mean negative log-likelihood over one window, and the state after it. real:
    which targets count, all by default."""
    kind, shape = h.dtype, (*given.shape, HIDDEN)
    before, rh, c, after = (np.empty(shape, kind) for _ in range(4))
    gates = np.empty((*given.shape, 2 * HIDDEN), kind)
    x, keep = p["x"][given], (~fresh)[:, :, None].astype(kind)
    for t in range(len(given)):
        before[t] = h * keep[t]
        h, gates[t], rh[t], c[t] = step(p, x[t], before[t])
        after[t] = h
    states, token = after.reshape(-1, HIDDEN), target.reshape(-1)
    on = np.ones(len(token), bool) if real is None else real.reshape(-1)
    n, classes = np.count_nonzero(on), np.where(on, _class_of(token), CLASSES)
    g = {k: np.zeros_like(x) for k, x in p.items()}
    d = _softmax(states @ p["wc"] + p["bc"])
    d[~on] = 0
    d[np.flatnonzero(on), classes[on]] -= 1
    d /= n
    g["wc"], g["bc"] = states.T @ d, d.sum(0)
    d_states = d @ p["wc"].T
    # head words, class after class
    rows = np.argsort(classes, kind="stable")
    off = np.searchsorted(classes[rows], np.arange(HEAD_CLASSES + 1))
    rows = rows[: off[-1]]
    some = [(k, off[k], off[k + 1]) for k in range(HEAD_CLASSES) if off[k] < off[k + 1]]
    s = states[rows]
    e, d_s = np.empty((len(rows), CLASS_WORDS), kind), np.empty_like(s)
    for k, a, b in some:
        np.matmul(s[a:b], p["wo"][k], out=e[a:b])
    e = _softmax(e + p["bo"][classes[rows]])
    e[np.arange(len(rows)), token[rows] % CLASS_WORDS] -= 1
    e /= n
    for k, a, b in some:
        g["wo"][k], g["bo"][k] = s[a:b].T @ e[a:b], e[a:b].sum(0)
        np.matmul(e[a:b], p["wo"][k].T, out=d_s[a:b])
    d_states[rows] += d_s
    d_states = d_states.reshape(shape)
    r, z = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
    by_c, by_z, by_r, stay = z * (1 - c * c), (c - before) * z * (1 - z), before * r * (1 - r), 1 - z
    d_in = np.empty((*given.shape, 3 * HIDDEN), kind)
    carry, uc, u = np.zeros_like(h), p["uc"].T, p["u"].T
    for t in range(len(given) - 1, -1, -1):
        dh = d_states[t] + carry
        d_gates, dc = d_in[t, :, : 2 * HIDDEN], d_in[t, :, 2 * HIDDEN :]
        np.multiply(dh, by_c[t], out=dc)
        d_rh = dc @ uc
        np.multiply(d_rh, by_r[t], out=d_gates[:, :HIDDEN])
        np.multiply(dh, by_z[t], out=d_gates[:, HIDDEN:])
        carry = (dh * stay[t] + d_rh * r[t] + d_gates @ u) * keep[t]
    d_in = d_in.reshape(-1, 3 * HIDDEN)
    g["u"] = before.reshape(-1, HIDDEN).T @ d_in[:, : 2 * HIDDEN]
    g["uc"] = rh.reshape(-1, HIDDEN).T @ d_in[:, 2 * HIDDEN :]
    used = given.reshape(-1)
    order = np.argsort(used, kind="stable")
    first = np.flatnonzero(np.diff(used[order], prepend=-1))
    g["x"][used[order[first]]] = np.add.reduceat(d_in[order], first)
    return g, h


def score(p: Params, token: np.ndarray, off: np.ndarray, end: int) -> np.ndarray:
    """Natural log-likelihood of each document token[off[i]:off[i + 1]], but for tail shares. All
    documents advance together, the longest first, so those still running are always in front."""
    lens = np.diff(off)
    order = np.argsort(-lens, kind="stable")
    begin, lens = off[:-1][order], lens[order]
    h = np.zeros((len(lens), HIDDEN), np.float32)
    last = np.full(len(lens), end, np.int64)
    total = np.zeros(len(lens))
    for t0 in range(0, int(lens[0]) if len(lens) else 0, SCORE_WINDOW):
        states, targets, own = [], [], []
        for t in range(t0, min(t0 + SCORE_WINDOW, int(lens[0]))):
            n = int(np.searchsorted(-lens, -t))  # documents longer than t
            h[:n] = step(p, p["x"][last[:n]], h[:n])[0]
            last[:n] = token[begin[:n] + t]
            states.append(h[:n].copy())
            targets.append(last[:n].copy())
            own.append(np.arange(n))
        total += np.bincount(np.concatenate(own), weights=log_probs(p, np.concatenate(states), np.concatenate(targets)), minlength=len(lens))
    out = np.empty(len(lens))
    out[order] = total
    return out


def _words(table: pa.Table):
    """Of a block: ids, held-out flags, number of words of each document, distinct word hashes
    (ascending) and which one each word is."""
    ids, texts = B.unpack(table)
    starts, ends, counts = texts.words()
    keys, which = np.unique(word_hashes(texts.buf, starts, ends, lower=True), return_inverse=True)
    return ids, held_out(ids), counts, keys, which.astype(np.int32)


STATS = "block int, bucket int, answer binary, top array<struct<n:long,h:long>>, words array<long>, sums array<long>"


def count_words(packed: DataFrame, bits: int) -> DataFrame:
    """STATS rows: for each block the training counts of its distinct words; once for each bucket
    the most frequent words and, by bin, the number of training words and the sum of their counts."""

    def emit(table: pa.Table) -> pa.Table:
        _, held, counts, keys, which = _words(table)
        mine = np.bincount(which, weights=np.repeat(~held, counts), minlength=len(keys)).astype(np.int64)
        return B.key_rows(table["block"][0].as_py(), keys, bits, mine)

    def reduce(table: pa.Table) -> pa.Table:
        seen: dict = {}

        def total(keys, _, vals):
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
            sums = np.add.reduceat(np.frombuffer(b"".join(vals), np.int64)[order], first)
            out = np.empty(len(keys), np.int64)
            out[order] = np.repeat(sums, np.diff(np.concatenate([first, [len(keys)]])))
            known = sums > 0
            bins = _bins(sums[known])
            seen["words"] = np.bincount(bins, minlength=TAIL_CLASSES).astype(np.int64)
            seen["sums"] = np.bincount(bins, weights=sums[known], minlength=TAIL_CLASSES).astype(np.int64)
            hashes = keys[order][first].view(np.int64)
            best = np.lexsort((hashes, -sums))[:HEAD]
            seen["top"] = [{"n": int(sums[i]), "h": int(hashes[i])} for i in best.tolist() if sums[i] > 0]
            return out

        got = B.answer_rows(table, total)
        rest = [None] * (got.num_rows - 1)
        z = zstandard.ZstdCompressor(level=1)
        return pa.table(
            {
                "block": got["block"],
                "bucket": got["bucket"],
                "answer": pa.array([z.compress(x) for x in got["answer"].to_pylist()], pa.binary()),
                "top": pa.array([seen["top"], *rest], pa.list_(pa.struct([("n", pa.int64()), ("h", pa.int64())]))),
                "words": pa.array([seen["words"].tolist(), *rest], pa.list_(pa.int64())),
                "sums": pa.array([seen["sums"].tolist(), *rest], pa.list_(pa.int64())),
            }
        )

    return packed.groupBy("block").applyInArrow(emit, B.KEYS).groupBy("bucket").applyInArrow(reduce, STATS)


def vocabulary_of(stats: DataFrame, ends: int) -> Vocabulary:
    """The driver gets HEAD words and two sums a bin."""
    one = stats.where(F.col("words").isNotNull())
    sums = one.agg(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("words", "sums") for i in range(TAIL_CLASSES)]).first()
    values = np.array([x or 0 for x in sums], np.int64)
    top = one.select(F.inline("top")).orderBy(F.desc("n"), "h").limit(HEAD).collect()
    return Vocabulary.of([(r.n, r.h) for r in top], values[:TAIL_CLASSES], values[TAIL_CLASSES:], ends)


def _answers(keys: np.ndarray, bits: int, table: pa.Table) -> np.ndarray:
    un = zstandard.ZstdDecompressor()
    plain = pa.table({"bucket": table["bucket"], "answer": pa.array([un.decompress(x) for x in table["answer"].to_pylist()], pa.binary())})
    return B.answers_of(keys, bits, plain, np.int64)


def _with_ends(token: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document's tokens and its end, and the documents' bounds."""
    off = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(off[-1], end, np.int64)
    inside = np.ones(off[-1], bool)
    inside[off[1:] - 1] = False
    out[inside] = token
    return out, off


#: a block's documents: ids, numbers of tokens, tokens, and the sums over words that need no network
CODED = "block int, ids binary, lens binary, tokens binary, n_known binary, base binary, inside binary"


def encode(packed: DataFrame, stats: DataFrame, bits: int, vocabulary: Vocabulary) -> DataFrame:
    """CODED rows, one a block."""
    bottom = vocabulary.n + ALPHA * (vocabulary.v + 1)

    def code(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, _, counts, keys, which = _words(table)
        c = _answers(keys, bits, answers) if len(keys) else np.empty(0, np.int64)
        token, inside = vocabulary.tokens(keys, c)
        tokens, off = _with_ends(token[which], counts, vocabulary.end)
        some = np.flatnonzero(counts)
        begin = (np.cumsum(counts) - counts)[some]

        def per_document(of_word: np.ndarray, of_end: float) -> bytes:
            """Sums within each document alone, so that equal texts have equal sums in any block."""
            out = np.full(len(counts), of_end)
            if len(some):
                out[some] += np.add.reduceat(of_word[which], begin)
            return out.tobytes()

        base = per_document(np.log10((c + ALPHA) / bottom), float(np.log10((vocabulary.ends + ALPHA) / bottom)))
        n_known = per_document((c > 0).astype(float), float(vocabulary.ends > 0))
        packed_tokens = zstandard.ZstdCompressor(level=1).compress(tokens.astype(np.uint16).tobytes())
        row = (table["block"][0].as_py(), ids.tobytes(), np.diff(off).tobytes(), packed_tokens, n_known, base, per_document(inside, 0.0))
        kinds = [pa.int32(), *[pa.binary()] * 6]
        return pa.table({x.split(" ")[0]: pa.array([v], k) for x, v, k in zip(CODED.split(", "), row, kinds, strict=True)})

    return packed.groupBy("block").cogroup(stats.select("block", "bucket", "answer").groupBy("block")).applyInArrow(code, CODED)


def _coded(it):
    """Of each CODED row: ids, documents' bounds, tokens, n_known, base and inside."""
    un = zstandard.ZstdDecompressor()
    for batch in it:
        for i in range(batch.num_rows):
            _, ids, lens, tokens, *sums = (column[i].as_py() for column in batch.columns)
            off = np.concatenate([[0], np.cumsum(np.frombuffer(lens, np.int64))])
            yield np.frombuffer(ids, np.int64), off, np.frombuffer(un.decompress(tokens), np.uint16).astype(np.int64), *[np.frombuffer(x) for x in sums]


def round_of(ids: np.ndarray) -> np.ndarray:
    """The one round that each document is learned from in; -1 if it is held out."""
    rounds = np.array([zlib.crc32(b"share %d" % i) % ROUNDS for i in ids.tolist()], np.int64)
    return np.where(held_out(ids), -1, rounds)


def fit(coded: DataFrame, vocabulary: Vocabulary) -> Params:
    """ROUNDS of local training in every block and averaging over all of them, weighted by tokens."""
    p = start(vocabulary)

    def trainer(p: Params, r: int):
        def local(it):
            for ids, off, tokens, *_ in _coded(it):
                mine = round_of(ids) == r
                begin = np.zeros(len(tokens), bool)
                begin[off[:-1]] = True
                on = np.repeat(mine, np.diff(off))
                new, n = train(p, tokens[on], begin[on], vocabulary.end)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), list_array(flat(new), np.array([sum(x.size for x in new.values())]), pa.float32())], names=["n", "values"])

        return local

    for r in range(ROUNDS):
        trained = coded.mapInArrow(trainer(p, r), "n long, values array<float>")
        each = trained.where("n > 0").select("n", F.posexplode("values").alias("i", "v"))
        mean = each.groupBy("i").agg((F.sum(F.col("v").cast("double") * F.col("n")) / F.sum("n")).alias("v")).toArrow()  # one row for each parameter
        if mean.num_rows:
            values = np.zeros(mean.num_rows)
            values[mean["i"].to_numpy()] = mean["v"].to_numpy()
            p = unflat(values, p)
    return p


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """SCORED rows of every document."""
    layout = B.plan_layout(docs, block_bytes, keys_per_bucket=1 << 22)
    bits = layout.bits
    packed = B.pack(docs, layout)
    stats = cut(count_words(packed, bits))
    known = F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(10)) != 0)
    vocabulary = vocabulary_of(stats, docs.where(known).count())
    coded = cut(encode(packed, stats, bits, vocabulary))
    release(docs.sparkSession)
    p = fit(coded, vocabulary)

    def finish(it):
        for ids, off, tokens, n_known, base, inside in _coded(it):
            model = (score(p, tokens, off, vocabulary.end) + inside) / np.log(10) if vocabulary.n else base
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=ids == B.NULL_ID),
                    pa.array(held_out(ids)),
                    pa.array(np.diff(off), pa.int64()),
                    pa.array(np.rint(n_known).astype(np.int64)),
                    pa.array(np.full(len(ids), vocabulary.n), pa.int64()),
                    pa.array(base),
                    pa.array(model),
                ],
                names=[x.split(" ")[0] for x in SCORED.split(", ")],
            )

    return coded.mapInArrow(finish, SCORED)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
