"""Katz back-off scores of whole texts, from an n-gram model learnt on the training documents.

Tokens are lower-cased words and one end per text; before the first word stand
ORDER - 1 starts.  With c a training count, d Good-Turing's discount of counts up
to K at that order, and h' the history h without its first token,
    p(w)     = d(c) c / N,           all unseen words together get what is left;
    p(w | h) = d(c) c(h, w) / c(h)   if h w was seen, else a(h) p(w | h').
a(h) is what the seen words after h leave over what they leave of p(. | h'), so that
the words and the unseen one sum to 1 after any h.  Where nothing is discounted,
the denominator grows by one.  An h that was never seen backs off with a(h) = 1.

Layout.  Each task cuts its documents into blocks of about BLOCK_TOKENS tokens
and writes each once to the shared folder: its own vocabulary as sorted 64-bit
hashes, and its tokens as places therein.  Then, order by order, each block sends
its distinct n-grams, sorted, with its own training counts and the counts that make
p(w | h'), cut into buckets.  A bucket adds up what all blocks sent, numbers its
n-grams, keeps them as its part of the model table, and answers each block in the
order it was asked: numbers, counts, and what a(h) needs of words that the block
itself lacks.  So every n-gram crosses once per block, however often it occurs;
beyond order 1 n-grams are pairs of numbers (history, word), not hashes.
A reply also says which n-grams no other block has.  What follows such a history is
known to that block alone, so it is never sent: it is counted where it is.
Replies are dealt out to blocks once and then lie beside the block's file.

A history's n-grams go to one bucket, unless it has more than `hot` training
tokens: max(HOT, N / HOTTEST), so there are HOTTEST such histories at most, whatever
the corpus.  Their n-grams are dealt out by word, and what a(h) needs is summed
over all buckets and sent to all blocks.  There are at least as many buckets as
BUCKET_TOKENS asks for; rows sent are blocks times buckets, as in any exchange.
All tables are written to the shared folder, partitioned by kind; n-grams that one
block alone has stay in that block (`Model.ngrams` gives both).  Words are known by
their hash alone.

Defined results: null or empty texts are the end alone; a null doc_id has no
remainder and trains; rows with equal doc_id count and score each; without
training tokens N = V = 0 and every text scores 0; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequery.llm.common import materialise, shared_dir
from scenequery.llm.minhash import word_hashes

ORDER, BLOCK_TOKENS, BUCKET_TOKENS, K, FOLDS, HELD = 3, 1_200_000, 3_000_000, 5, 7, 2
#: Histories of more training tokens may be hot; most hot histories.
HOT, HOTTEST = 200_000, 10_000
END = np.uint64(0x5851F42D4C957F2D)


# Packing of arrays into binary columns.


def _squeeze(planes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _stretch(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, in as few bytes as they need, byte by byte of all."""
    top = int(x.max()) if len(x) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + _squeeze(planes)


def unpack(raw: bytes) -> np.ndarray:
    width, planes = raw[0], np.frombuffer(_stretch(raw[1:]), np.uint8)
    out = np.zeros((planes.size // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def pack_bits(x: np.ndarray) -> bytes:
    return _squeeze(np.packbits(x)[None])


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_stretch(raw), np.uint8))[:n].astype(bool)


def pack_reals(x: np.ndarray) -> bytes:
    return _squeeze(x.astype("<f8").view(np.uint8).reshape(-1, 8).T)


def unpack_reals(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_stretch(raw), np.uint8).reshape(8, -1).T).reshape(-1).view("<f8")


def cuts(keys: np.ndarray, span: int, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted keys, whole numbers below span, begins, and the end."""
    edges = np.array([b * span // buckets for b in range(1, buckets)], keys.dtype)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new row begins in columns that are sorted together."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def sorted_by(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The order of pairs of whole numbers; in one key where it fits."""
    if not len(first):
        return np.empty(0, np.int64)
    low = int(first.min())
    span = int(second.max()) + 1
    if (int(first.max()) - low + 1) * span < 1 << 62:
        return np.argsort((first - low) * span + second, kind="stable")
    return np.lexsort((second, first))


# Blocks.


def _put(uri: str, data: bytes) -> None:
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)


def _got(uri: str) -> bytes:
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def _put_replies(uri: str, replies: list[dict]) -> None:
    table, out = pa.Table.from_pylist(replies), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as f:
        f.write_table(table)
    _put(uri, out.getvalue())


def _got_replies(uri: str) -> list[dict]:
    with pa.ipc.open_stream(_got(uri)) as f:
        return f.read_all().to_pylist()


def is_training(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS != HELD


class Block:
    """Documents' tokens as places in the block's sorted vocabulary."""

    def __init__(self, doc_ids, lengths, ids, vocab):
        self.doc_ids, self.lengths, self.ids, self.vocab = doc_ids, lengths, ids, vocab
        self.train = np.array([is_training(d) for d in doc_ids], bool)
        self.on = np.repeat(self.train, lengths)
        self.first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)

    @classmethod
    def of(cls, doc_ids, hashes: list[np.ndarray]):
        vocab, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        return cls(doc_ids, np.array([len(h) for h in hashes], np.int64), ids.astype(np.int32), vocab)

    def save(self, uri: str) -> None:
        order = np.argsort(-np.bincount(self.ids, minlength=len(self.vocab)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        known = np.array([d is not None for d in self.doc_ids], bool)
        out = io.BytesIO()
        np.savez(out, known=known, doc_ids=np.array([d or 0 for d in self.doc_ids], np.int64), lengths=self.lengths, ids=np.frombuffer(pack(rank[self.ids]), np.uint8), vocab=np.frombuffer(pack_keys(self.vocab), np.uint8), order=np.frombuffer(pack(order), np.uint8))
        _put(uri, out.getvalue())

    @classmethod
    def load(cls, uri: str):
        with np.load(io.BytesIO(_got(uri))) as x:
            doc_ids = [int(d) if k else None for d, k in zip(x["doc_ids"], x["known"])]
            order = unpack(x["order"].tobytes()).astype(np.int32)
            return cls(doc_ids, x["lengths"], order[unpack(x["ids"].tobytes()).astype(np.int32)], unpack_keys(x["vocab"].tobytes()))


class Grams:
    """A block's distinct n-grams of one order: history and word (places among the lower grams), each token's gram, training counts.

    The history of a text's first token is `start`, the place behind all lower grams.
    """

    def __init__(self, block: Block, lower: Grams | None):
        if lower is None:
            self.n, self.at, self.word, self.history = len(block.vocab), block.ids, np.arange(len(block.vocab)), None
        else:
            history = np.empty(len(block.ids), np.int64)
            history[1:] = lower.at[:-1]
            history[block.first] = lower.n
            history *= len(block.vocab)
            history += block.ids
            code, at = np.unique(history, return_inverse=True)
            del history
            self.n, self.at = len(code), at.astype(np.int32)
            self.history, self.word = (x.astype(np.int32) for x in np.divmod(code, len(block.vocab)))
            one = np.empty(self.n, np.int32)
            one[self.at] = np.arange(len(self.at), dtype=np.int32)  # a token that ends it
            self.suffix = lower.at[one]
        self.own = np.bincount(self.at[block.on], minlength=self.n)


def _cut_blocks(folder: str):
    def run(batches):
        doc_ids, hashes, size = [], [], 0

        def put():
            block = Block.of(doc_ids, hashes)
            uri = f"{folder}/{uuid.uuid4().hex}.npz"
            block.save(uri)
            return pa.record_batch([pa.array([uri]), *(pa.array([int(n)]) for n in (block.train.sum(), block.on.sum(), len(block.ids)))], ["block", "train_docs", "train_tokens", "tokens"])

        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ids = batch.column(0).to_pylist()
            for i in range(0, len(texts), 64):
                h, at = word_hashes(texts[i : i + 64])
                for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    doc_ids.append(ids[i + k])
                    hashes.append(np.append(h[a:b], END))
                    size += b - a + 1
                if size >= BLOCK_TOKENS:
                    yield put()
                    doc_ids, hashes, size = [], [], 0
        if doc_ids:
            yield put()

    return run


# Buckets: what blocks send is added up, and each gets its reply.

PARTS = ("a", "b", "c", "d", "e", "f")
SENT = "bucket int, block string, " + ", ".join(f"{p} binary" for p in PARTS)
KEPT = "kind string, " + SENT


def _batch(rows: list[tuple], kind: bool):
    types = [pa.string()] * kind + [pa.int32(), pa.string()] + [pa.binary()] * len(PARTS)
    names = ["kind"] * kind + ["bucket", "block", *PARTS]
    rows = [(*r, *[None] * (len(names) - len(r))) for r in rows]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _gathered(batches):
    """(bucket, rows) of a task's buckets; rows by block."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(row[0], []).append(row)
    for bucket in sorted(held):
        yield bucket, sorted(held.pop(bucket), key=lambda r: r[1])


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _stats(counts: np.ndarray) -> bytes:
    """All tokens, seen grams, n(1)..n(K + 1)."""
    return pack(np.array([counts.sum(), np.count_nonzero(counts), *np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]]))


def _send_words(buckets: int):
    def run(batches):
        for row in _rows(batches):
            block = Block.load(row["block"])
            own = Grams(block, None).own
            at = cuts(block.vocab, 1 << 64, buckets).tolist()
            yield _batch([(b, row["block"], pack_keys(block.vocab[i:j]), pack(own[i:j])) for b, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i], False)

    return run


def _add_words(hot: int):
    """Model rows (hashes, counts), statistics with the bucket's size and hot words, and replies: numbers in the bucket, counts, which ones no other block has."""

    def run(batches):
        for bucket, rows in _gathered(batches):
            keys = [unpack_keys(r[2]) for r in rows]
            all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([unpack(r[3]) for r in rows]).astype(float), minlength=len(all_keys)).astype(np.int64)
            alone = np.bincount(at, minlength=len(all_keys)) == 1
            out, i = [("model", bucket, None, pack_keys(all_keys), pack(counts)), ("stats", bucket, None, _stats(counts), *_hot(counts, hot), pack(np.array([len(all_keys)])))], 0
            for row, k in zip(rows, keys):
                j = i + len(k)
                out.append(("reply", bucket, row[1], pack_keys(at[i:j].astype(np.uint64)), pack(counts[at[i:j]]), pack_bits(alone[at[i:j]])))
                i = j
            yield _batch(out, True)

    return run


def _hot(counts: np.ndarray, hot: int) -> tuple[bytes, bytes]:
    at = np.flatnonzero(counts > hot)
    return pack_keys(at.astype(np.uint64)), pack(counts[at])


class Level:
    """What the driver knows of an order: its discounts, its buckets' first numbers, its hot grams (numbers and counts).

    Numbers are given to all words, and beyond order 1 to grams that several blocks have.
    """

    def __init__(self, kept: DataFrame, buckets: int):
        total, size, hot = np.zeros(K + 3), np.zeros(buckets, np.int64), []
        for r in kept.filter("kind = 'stats'").select("bucket", "a", "b", "c", "d").toLocalIterator():
            total += unpack(bytes(r.a)).astype(np.int64)
            if r.b is not None:  # else what a block counted itself
                size[r.bucket] = unpack(bytes(r.d))[0]
                hot.append((r.bucket, unpack_keys(bytes(r.b)).astype(np.int64), unpack(bytes(r.c)).astype(np.int64)))
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.size, self.tokens, self.seen, self.n = int(self.first[-1]), int(total[0]), int(total[1]), total[2:]
        self.d = discounts(self.n)
        parts = sorted(hot, key=lambda h: h[0])
        self.hot = np.concatenate([np.empty(0, np.int64), *(self.first[b] + x for b, x, _ in parts)])
        self.hot_counts = np.concatenate([np.empty(0, np.int64), *(c for _, _, c in parts)])


def discounts(n: np.ndarray) -> np.ndarray:
    """d(c) for c = 0..K + 1 from n(1)..n(K + 1); the last stands for all larger counts."""
    n = [0.0, *map(float, n)]
    out = np.ones(K + 2)
    a = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
        out[r] = d if 0 < d < 1 else r / (r + 1)
    return out


def unigrams(level: Level, counts: np.ndarray) -> np.ndarray:
    """p(w) by count; all unseen words share one value."""
    r = np.arange(1, K + 1)
    mass = level.tokens - float((r * (1 - level.d[1 : K + 1]) * level.n[:K]).sum())
    over = level.tokens + (mass >= level.tokens * (1 - 1e-12))
    unseen = 1 - mass / over if level.tokens else 1.0
    return np.where(counts > 0, level.d[np.minimum(counts, K + 1)] * counts / max(over, 1), unseen)


def weights(count: np.ndarray, mass: np.ndarray, words: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a(h) and h's denominator from c(h), the sum of d(c) c and of p(w | h') over its seen words, and whether none of these is discounted."""
    seen = count > 0
    c = np.where(seen, count, 1).astype(float)
    over = c + full
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(full, 1 / over, 1 - mass / c) / np.maximum(1 - words, 1e-300)
    return np.where(seen, alpha, 1.0), over


def kept_mass(count: np.ndarray, few: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The sum of d(c) c over the words of histories with c(h) = count, of which the columns of few occur 1..K times."""
    return count - (few * (np.arange(1, K + 1) * (1 - d[1 : K + 1]))).sum(1)


def _join(replies: list, part: str, read) -> np.ndarray:
    parts = [read(r[part]) for r in replies]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


class Asked:
    """An order's grams as a block sends them: sorted by history and word, first those of cold histories, then, by word, those of hot ones; not the local ones."""

    def __init__(self, local: np.ndarray, history: np.ndarray, word: np.ndarray, hot: np.ndarray, span: int, words: int, buckets: int):
        is_hot = np.isin(history, hot)
        cold, warm = np.flatnonzero(~is_hot & ~local), np.flatnonzero(is_hot & ~local)
        cold = cold[sorted_by(history[cold], word[cold])]
        warm = warm[np.argsort(word[warm], kind="stable")]
        edges = [(0, cuts(history[cold], span, buckets)), (len(cold), cuts(word[warm], words, buckets))]
        self.order, self.pieces = np.concatenate([cold, warm]), []
        for k, (base, at) in enumerate(edges):
            for b, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if j > i:
                    if k:  # within a bucket always by history and word
                        part = warm[i:j]
                        self.order[base + i : base + j] = part[sorted_by(history[part], word[part])]
                    self.pieces.append((b + k * buckets, base + i, base + j))
        self.history, self.word = history[self.order], word[self.order]
        self.heads = [runs(self.history[i:j]) for _, i, j in self.pieces]


class Known:
    """A block's grams of all orders up to the replies at hand, with their numbers, counts and probabilities."""

    def __init__(self, row: dict, levels: list[Level], hot_sums: list[dict], buckets: int, train_docs: int):
        self.block = Block.load(row["block"])
        replies = lambda m: sorted(row.get(f"r{m}") or _got_replies(f"{row['block']}.r{m}"), key=lambda r: r["bucket"])
        grams = Grams(self.block, None)
        order1, r1 = levels[0], replies(1)
        self.number = _join(r1, "a", lambda x: unpack_keys(x).astype(np.int64))
        sizes = [len(unpack(r["b"])) for r in r1]
        first = [order1.first[r["bucket"]] for r in r1]
        self.number = self.number + np.repeat(np.array(first, np.int64), sizes)
        self.word_number = self.number
        self.counts = [_join(r1, "b", lambda x: unpack(x).astype(np.int64))]
        bits = [unpack_bits(r["c"], n) for r, n in zip(r1, sizes)]
        self.alone = np.concatenate([np.empty(0, bool), *bits])
        self.grams, self.p, self.train_docs, self.buckets = [grams], unigrams(order1, self.counts[0]), train_docs, buckets
        self.over = np.ones(1)
        for m in range(2, len(levels) + 1):
            self._add(replies(m), levels, hot_sums[m - 2], m)

    def ask(self, levels: list[Level], hot: np.ndarray) -> tuple[Grams, np.ndarray, Asked]:
        """The next order's grams, which of them no other block can have, and the others as they are sent."""
        grams, lower = Grams(self.block, self.grams[-1]), levels[-1]
        local = np.append(self.alone, False)[grams.history]
        history = np.append(self.number, lower.size)[grams.history]
        return grams, local, Asked(local, history, self.word_number[grams.word], hot, lower.size + 1, max(1, levels[0].size), self.buckets)

    def _add(self, replies: list, levels: list[Level], sums: dict, m: int) -> None:
        lower, level = levels[m - 2], levels[m - 1]
        grams, alone, asked = self.ask(levels[: m - 1], sums["hot"])
        by_bucket = {r["bucket"]: r for r in replies}
        number, count = np.full(grams.n, -1), grams.own.copy()
        told, discounted = [], []
        for (b, i, j), heads in zip(asked.pieces, asked.heads):
            r = by_bucket[b]
            own = asked.order[i:j]
            alone[own] = unpack_bits(r["c"], j - i)
            shared = own[~alone[own]]
            if r["a"] is not None:
                number[shared] = level.first[b] + unpack_keys(r["a"]).astype(np.int64)
            count[shared] = unpack(r["b"]).astype(np.int64)
            if b < self.buckets:
                bits = unpack_bits(r["d"], 2 * len(heads)).reshape(2, -1)
                mine = grams.history[own[heads]]
                unseen = np.add.reduceat((count[own] == 0).astype(np.int64), heads) > 0
                discounted.append((mine[~bits[0]], bits[1][~bits[0]]))
                told.append((mine[~bits[0] & unseen], unpack(r["e"]).astype(np.int64).reshape(-1, K), unpack_reals(r["f"])))
        of = np.append(self.counts[-1], self.train_docs)
        # the sums over the block's own grams hold where it has all seen words of a history
        low = self.p[grams.suffix]
        mass = np.bincount(grams.history, weights=level.d[np.minimum(count, K + 1)] * count, minlength=len(of))
        words = np.bincount(grams.history, weights=np.where(count > 0, low, 0.0), minlength=len(of))
        less = np.bincount(grams.history[(count > 0) & (count <= K)], minlength=len(of)) > 0
        for h, some in discounted:
            less[h] = some
        place = np.append(self.number, lower.size)
        hot = np.flatnonzero(np.isin(place, sums["hot"]))
        at = np.searchsorted(sums["hot"], place[hot])
        for h, few, more in [*told, (hot, sums["few"][at], sums["words"][at])]:
            mass[h], words[h] = kept_mass(of[h], few, level.d), more
            less[h] = few.sum(1) > 0
        alpha, over = weights(of, mass, words, (of > 0) & ~less)
        self.over = over[grams.history]
        seen = level.d[np.minimum(count, K + 1)] * count / self.over
        self.p = np.where(count > 0, seen, alpha[grams.history] * low)
        self.grams.append(grams)
        self.counts.append(count)
        self.number, self.alone = number, alone


def _send_grams(*known):
    levels, hot = known[0], known[-1]

    def run(batches):
        for row in _rows(batches):
            x = Known(row, *known[:-1])
            _put_replies(f"{row['block']}.r{len(levels)}", row[f"r{len(levels)}"])
            grams, local, asked = x.ask(levels, hot)
            yield _batch([(zlib.crc32(row["block"].encode()) % x.buckets, row["block"], None, _stats(grams.own[local]))], False)
            own = grams.own[asked.order]
            # p(w | h') of a seen gram follows from its count and its history's denominator
            low = np.where(own > 0, x.counts[-1][grams.suffix[asked.order]], 0)
            over = np.where(own > 0, x.over[grams.suffix[asked.order]], 0).astype(np.int64) if len(levels) > 1 else None
            out = []
            for (b, i, j), heads in zip(asked.pieces, asked.heads):
                sizes = np.diff(np.append(heads, j - i))
                more = [] if over is None else [pack(np.maximum.reduceat(over[i:j], heads))]
                out.append((b, row["block"], pack_keys(asked.history[i:j][heads].astype(np.uint64)), pack(sizes), pack(asked.word[i:j]), pack(own[i:j]), pack(low[i:j]), *more))
                if len(out) == 64:
                    yield _batch(out, False)
                    out = []
            if out:
                yield _batch(out, False)

    return run


def _add_grams(buckets: int, hot: int, lower: Level, last: bool):
    """Model rows (histories, sizes, words, counts) of the grams that several blocks have, statistics, sums of hot histories, and replies.

    A reply has a bit per gram, set where no other block has it, numbers and counts of the others; two bits per
    history, whether the block has all of its seen words, and whether any is discounted; and
    what a(h) needs, for the other histories that the block will back off from.
    """

    def run(batches):
        for bucket, rows in _gathered(batches):
            yield _batch([("stats", bucket, None, r[3]) for r in rows if r[2] is None], True)
            rows = [r for r in rows if r[2] is not None]
            if not rows:
                continue
            heads = [unpack_keys(r[2]).astype(np.int64) for r in rows]
            sizes = [unpack(r[3]).astype(np.int64) for r in rows]
            n = [int(s.sum()) for s in sizes]
            history = np.concatenate([np.repeat(h, s) for h, s in zip(heads, sizes)])
            word = np.concatenate([unpack(r[4]).astype(np.int64) for r in rows])
            order = sorted_by(history, word)
            history, word = history[order], word[order]
            first = runs(history, word)
            at = np.empty(len(order), np.int64)
            at[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            shared = np.diff(np.append(first, len(order))) > 1
            rank = np.cumsum(shared) - 1
            add = lambda i, f: f.reduceat(np.concatenate([unpack(r[i]).astype(np.int64) for r in rows])[order], first)
            counts, low = add(5, np.add), add(6, np.maximum)
            del order
            history, word = history[first], word[first]
            begin = runs(history)
            own, size = history[begin], np.diff(np.append(begin, len(history)))
            if rows[0][7] is None:
                p = unigrams(lower, low)
            else:
                over = np.zeros(len(own), np.int64)
                for h, r in zip(heads, rows):
                    k = np.searchsorted(own, h)
                    over[k] = np.maximum(over[k], unpack(r[7]).astype(np.int64))
                p = lower.d[np.minimum(low, K + 1)] * low / np.maximum(np.repeat(over, size), 1)
            seen = counts > 0
            few = np.stack([np.add.reduceat((counts == r).astype(np.int64), begin) for r in range(1, K + 1)], 1)
            words, n_seen = np.add.reduceat(np.where(seen, p, 0.0), begin), np.add.reduceat(seen.astype(np.int64), begin)
            table = shared & seen if last else shared
            left = np.add.reduceat(table.astype(np.int64), begin)
            out = [("model", bucket, None, pack_keys(own[left > 0].astype(np.uint64)), pack(left[left > 0]), pack(word[table]), pack(counts[table])), ("stats", bucket, None, _stats(counts), *_hot(counts[shared], hot), pack(np.array([shared.sum()])))]
            if bucket >= buckets:
                out.append(("hot", bucket, None, pack_keys(own.astype(np.uint64)), pack(few.ravel()), pack_reals(words)))
            yield _batch(out, True)
            i = 0
            for row, h, s, k in zip(rows, heads, sizes, n):
                j = i + k
                mine, more = at[i:j], ()
                both = mine[shared[mine]]
                if bucket < buckets:
                    there = np.searchsorted(own, h)
                    whole = np.add.reduceat(seen[mine].astype(np.int64), np.cumsum(s) - s) == n_seen[there]
                    some = there[~whole & (np.add.reduceat((~seen[mine]).astype(np.int64), np.cumsum(s) - s) > 0)]
                    more = (pack_bits(np.concatenate([whole, few[there].any(1)])), pack(few[some].ravel()), pack_reals(words[some]))
                yield _batch([("reply", bucket, row[1], None if last else pack_keys(rank[both].astype(np.uint64)), pack(counts[both]), pack_bits(~shared[mine]), *more)], True)
                i = j

    return run


def _hot_rows(batches):
    for row in _rows(batches):
        few = unpack(row["b"]).astype(np.int64).reshape(-1, K)
        yield pa.record_batch([pa.array(unpack_keys(row["a"]).astype(np.int64)), *(pa.array(few[:, r]) for r in range(K)), pa.array(unpack_reals(row["c"]))], ["history", *(f"n{r}" for r in range(K)), "words"])


def _hot_sums(kept: DataFrame, hot: np.ndarray) -> dict:
    """What a(h) needs of the hot histories, HOTTEST at most."""
    x = kept.filter("kind = 'hot'").select("a", "b", "c").mapInArrow(_hot_rows, "history bigint, " + ", ".join(f"n{r} bigint" for r in range(K)) + ", words double")
    got = {r[0]: r for r in x.groupBy("history").agg(*[F.sum(c).alias(c) for c in x.columns[1:]]).collect()}
    few = np.array([[got[h][1 + r] if h in got else 0 for r in range(K)] for h in hot.tolist()], np.int64).reshape(-1, K)
    return {"hot": hot, "few": few, "words": np.array([got[h][1 + K] if h in got else 0.0 for h in hot.tolist()])}


def _score(*known):
    level = known[0][0]

    def run(batches):
        for row in _rows(batches):
            x = Known(row, *known)
            block, words = x.block, x.counts[0]
            with np.errstate(divide="ignore"):
                score = np.log10(x.p)[x.grams[-1].at]
            base = np.log10((words + 1) / (level.tokens + level.seen + 1))[block.ids]
            total = lambda v: np.add.reduceat(v, block.first)
            n = len(block.doc_ids)
            yield pa.record_batch(
                [pa.array(block.doc_ids, pa.int64()), pa.array(~block.train), pa.array(block.lengths), pa.array(total((words > 0)[block.ids].astype(np.int64))), pa.array(np.full(n, level.tokens)), pa.array(total(base)), pa.array(total(score))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _replies(kept: DataFrame, order: int) -> DataFrame:
    """A row per block with its replies; a block's replies are no longer than its grams."""
    return kept.filter("kind = 'reply'").groupBy("block").agg(F.collect_list(F.struct("bucket", *PARTS)).alias(f"r{order}"))


class Model:
    """The blocks, the tables of each order, and what the driver knows of them."""

    def __init__(self, docs: DataFrame, order: int = ORDER):
        spark = docs.sparkSession
        x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        blocks = materialise(x.mapInArrow(_cut_blocks(shared_dir(spark, "blocks")), "block string, train_docs bigint, train_tokens bigint, tokens bigint"), "blocks")
        docs_, train, tokens = (int(v or 0) for v in blocks.agg(F.sum("train_docs"), F.sum("train_tokens"), F.sum("tokens")).first())
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.train_docs, self.buckets = docs_, max(parts, -(-tokens // BUCKET_TOKENS))
        hot, self.levels, self.sums, self.tables = max(HOT, train // HOTTEST), [], [], []
        self.blocks = self.rows = blocks.select("block").repartition(parts, "block")

        def ask(sender, adder) -> DataFrame:
            dealt = self.rows.mapInArrow(sender, SENT).repartitionById(self.buckets, F.col("bucket") % self.buckets)
            return materialise(dealt.mapInArrow(adder, KEPT), "ngrams", "kind")

        for m in range(1, order + 1):
            if m == 1:
                kept = ask(_send_words(self.buckets), _add_words(hot))
            else:
                level = self.levels[-1]
                starts = [level.size] if docs_ > hot else []
                hottest = np.sort(np.concatenate([level.hot, np.array(starts, np.int64)]))
                kept = ask(_send_grams(*self.known(), hottest), _add_grams(self.buckets, hot, level, m == order))
                self.sums.append(_hot_sums(kept, hottest))
            self.levels.append(Level(kept, 2 * self.buckets))
            self.tables.append(kept)
            self.rows = self.blocks.join(_replies(kept, m), "block")

    def known(self) -> tuple:
        return self.levels[:], self.sums[:], self.buckets, self.train_docs

    def scores(self) -> DataFrame:
        return self.rows.mapInArrow(_score(*self.known()), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

    def _shared(self, order: int) -> DataFrame:
        """The stored table of an order: (number, words, n); words are hashes, null before the first word of a text."""
        first = self.levels[order - 1].first

        def run(batches):
            for row in _rows(batches):
                if order == 1:
                    word, n = unpack_keys(row["a"]).astype(np.int64), unpack(row["b"]).astype(np.int64)
                    history = np.zeros(len(word), np.int64)
                else:
                    history = np.repeat(unpack_keys(row["a"]).astype(np.int64), unpack(row["b"]).astype(np.int64))
                    word, n = unpack(row["c"]).astype(np.int64), unpack(row["d"]).astype(np.int64)
                yield pa.record_batch([pa.array(first[row["bucket"]] + np.arange(len(word))), pa.array(history), pa.array(word), pa.array(n)], ["number", "history", "word", "n"])

        x = self.tables[order - 1].filter("kind = 'model'").mapInArrow(run, "number bigint, history bigint, word bigint, n bigint")
        if order == 1:
            return x.select("number", F.array("word").alias("words"), "n")
        lower = self._shared(order - 1).select(F.col("number").alias("history"), F.col("words").alias("before"))
        word = self._shared(1).select(F.col("number").alias("word"), F.col("words").alias("last"))
        starts = F.array_repeat(F.lit(None).cast("bigint"), order - 1)
        return x.join(lower, "history", "left").join(word, "word").select("number", F.concat(F.coalesce("before", starts), "last").alias("words"), "n")

    def ngrams(self, order: int) -> DataFrame:
        """(words, n): the seen n-grams of an order; words are hashes, null before the first word of a text."""
        known = self.known()

        def run(batches):
            for row in _rows(batches):
                x = Known(row, known[0][:order], known[1][: order - 1], *known[2:])
                if order > 1:
                    at = np.flatnonzero(x.alone & (x.counts[-1] > 0))
                    n, columns, level = x.counts[-1][at], [], order - 1
                    while level > 0:
                        grams = x.grams[level]
                        start = at == grams.n
                        columns.append(np.where(start, np.int64(0), x.block.vocab.view(np.int64)[grams.word[np.where(start, 0, at)]]))
                        at = np.where(start, x.grams[level - 1].n, grams.history[np.where(start, 0, at)])
                        level -= 1
                    start = at == x.grams[0].n
                    columns.append(np.where(start, np.int64(0), x.block.vocab.view(np.int64)[np.where(start, 0, at)]))
                    words = np.stack(columns[::-1], 1) if len(n) else np.empty((0, order), np.int64)
                    yield pa.record_batch([pa.array([[None if v == 0 else v for v in w] for w in words.tolist()], pa.list_(pa.int64())), pa.array(n)], ["words", "n"])

        return self._shared(order).select("words", "n").filter("n > 0").union((self.rows if order == len(self.levels) else self.blocks).mapInArrow(run, "words array<bigint>, n bigint"))


def report(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return Model(docs, order).scores()
