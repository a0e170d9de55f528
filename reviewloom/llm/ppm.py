"""Code lengths by prediction by partial matching, and a word unigram baseline.

The model is a trie of byte contexts, pretrained on the training documents. The symbols
are the 256 bytes and an end; a text is its UTF-8 bytes with A-Z in lower case, and three
zero bytes stand before it. After a context, a symbol seen n(s) times there among n, of q
distinct ones, has probability n(s) / (n + q); the rest, q / (n + q), is the escape to the
next shorter context (method C). There, symbols that were possible in a longer context
are excluded, from counts and from q. Below the empty context all remaining symbols are
alike. If nothing remains to escape to, the escape's share is not kept back.

All counts are over all training documents, summed by key before they meet, and every
context that was counted is used. Contexts of two bytes and fewer (2^16 of them at most),
and those of three bytes that hold at least one in 2^15 of all symbols, so at most 2^15 of
them, are a table of a row of probabilities each, which is built once and broadcast (at most 100 MB): a
text's symbols after these cost three array lookups. The symbols after other contexts
of three bytes are grouped by context in each task and joined to the contexts' counts,
which are as many as the corpus has; contexts never counted start at two bytes.

A worker's memory is bounded apart from its Arrow batch and longest text: texts are turned
into symbols by slices, symbols are numbered by windows, and what a task gathers by
context goes out in parts.

The baseline needs each word's training count. Words that make up at least one in 50,000
of the tokens, so at most 50,000 of them, are broadcast. For the others, a task groups
its documents by word, and the words' lists are joined to the counts and summed by
document; no such word can have a large share of the rows. Words are compared by 64-bit
hashes (XXH3).

Defined results: null and empty texts hold the end alone; rows with one doc_id are scored
each; a null doc_id counts as the text "null" neither of the held-out part nor known by
name: it is trained on; without training documents all symbols are alike and the baseline
is 0; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_texts, materialize

END = 256
SYMBOLS = 257
CONTEXTS3 = 1 << 15
HEAD = 50_000
MEMO = 400_000
HASHES = 150_000
SLICE = 2_000_000
WINDOW = 1 << 18
PART = 1 << 18
_END_WORD = b"\n"  # no word holds white space


def word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def prepared(batch: pa.RecordBatch):
    """By slices of about SLICE bytes: the first row, the row after the last, and the texts as bytes with A-Z in lower case."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        j = min(len(texts), int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE)) + 1)
        yield i, j, [t.lower() for t in texts.slice(i, j - i).to_pylist()]  # bytes: just A-Z
        i = j


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols in one row, each text with three zero bytes before and the end behind; where each text begins."""
    lengths = np.array([len(t) + 4 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    joined = np.frombuffer(b"".join(b"\0\0\0" + t + b"\0" for t in texts), np.uint8).astype(np.uint16)
    joined[ends - 1] = END
    return joined, ends - lengths


def grams(texts: list[bytes]):
    """Of the symbols to be coded, by windows: the text's number, and the context of three bytes and symbol as one number."""
    s, starts = symbols(texts)
    zeros = (starts[:, None] + np.arange(3)).ravel()
    for i in range(3, len(s), WINDOW):
        j = min(i + WINDOW, len(s))
        first, last = np.searchsorted(starts, [i, j - 1], side="right") - 1
        text = np.repeat(np.arange(first, last + 1), np.diff(np.r_[i, starts[first + 1 : last + 1], j]))
        coded = np.ones(j - i, bool)
        a, b = np.searchsorted(zeros, [i, j])
        coded[zeros[a:b] - i] = False
        gram = s[i - 3 : j - 3].astype(np.int64)
        gram <<= 8
        gram |= s[i - 2 : j - 2]
        gram <<= 8
        gram |= s[i - 1 : j - 1]
        gram <<= 9
        gram |= s[i:j]
        yield text[coded], gram[coded]


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def count_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context of three bytes and symbol as one number, its count)"""
    return merge(*zip(*(np.unique(gram, return_counts=True) for _, gram in grams(texts)), strict=True))


def probabilities(levels: list[np.ndarray]) -> np.ndarray:
    """Of all symbols, for the counts of a context and of its shorter contexts, longest first."""
    p = np.zeros(SYMBOLS)
    left, share = np.ones(SYMBOLS, bool), 1.0
    for counts in levels:
        own = np.where(left, counts, 0)
        n, seen = own.sum(), own > 0
        q = seen.sum()
        if not q:
            continue
        if q == left.sum():
            return p + share * own / n
        p += share * own / (n + q)
        share *= q / (n + q)
        left &= ~seen
    return p + share * left / left.sum()


class Trie:
    """The probabilities as log10, a row a context, and how three bytes lead to a row."""

    def __init__(self, two: tuple[np.ndarray, np.ndarray], three: tuple[np.ndarray, np.ndarray]):
        """Counts by (two bytes << 9 | symbol) for all contexts, and by (three bytes << 9 | symbol) for those kept."""
        ctx2, at2 = np.unique(two[0] >> 9, return_inverse=True)
        n2 = np.zeros((len(ctx2) + 1, SYMBOLS))
        np.add.at(n2, (at2, two[0] & 511), two[1])
        n1 = np.zeros((256, SYMBOLS))
        np.add.at(n1, (two[0] >> 9 & 255, two[0] & 511), two[1])
        n0 = n1.sum(axis=0)
        ctx3, at3 = np.unique(three[0] >> 9, return_inverse=True)
        n3 = np.zeros((len(ctx3) + 1, SYMBOLS))
        np.add.at(n3, (at3, three[0] & 511), three[1])
        rows = np.empty((256 + len(ctx2) + len(ctx3), SYMBOLS), np.float32)
        for b in range(256):
            rows[b] = np.log10(probabilities([n1[b], n0]))
        for k, c in enumerate(ctx2.tolist()):
            rows[256 + k] = np.log10(probabilities([n2[k], n1[c & 255], n0]))
        where2 = np.full(1 << 16, len(ctx2))
        where2[ctx2] = np.arange(len(ctx2))
        for k, c in enumerate(ctx3.tolist()):
            rows[256 + len(ctx2) + k] = np.log10(probabilities([n3[k], n2[where2[c & 65535]], n1[c & 255], n0]))
        self.rows, self.three_from = rows, 256 + len(ctx2)
        #: row of a context of two bytes, or of its last byte
        self.of2 = np.where(where2 < len(ctx2), 256 + where2, np.arange(1 << 16) & 255).astype(np.int32)
        #: for the first two of three bytes, a line of `of3`: the row by the third byte; the line beyond is for pairs never seen
        self.line = where2.astype(np.int32)
        self.of3 = np.zeros((len(ctx2) + 1, 256), np.int32)
        self.of3[:-1] = self.of2[((ctx2 & 255) << 8)[:, None] | np.arange(256)[None]]
        self.of3[where2[ctx3 >> 8], ctx3 & 255] = 256 + len(ctx2) + np.arange(len(ctx3))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text's symbols after contexts that the table has; of the others, the text's number and context << 9 | symbol."""
        sums, docs, others = np.zeros(len(texts)), [], []
        for doc, gram in grams(texts):
            line = self.line[gram >> 17]
            row = np.where(line < len(self.of3) - 1, self.of3[line, gram >> 9 & 255], self.of2[gram >> 9 & 65535])
            p = self.rows[row, gram & 511].astype(np.float64)
            rest = np.flatnonzero(row < self.three_from)
            p[rest] = 0
            sums += np.bincount(doc, p, len(texts))
            docs.append(doc[rest])
            others.append(gram[rest])
        return sums, np.concatenate(docs), np.concatenate(others)


class Shorter:
    """Counts of the contexts of two bytes and fewer, for the contexts of three that the table has not."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.n1 = np.zeros((256, SYMBOLS))
        np.add.at(self.n1, (keys >> 9 & 255, keys & 511), counts)
        self.n0 = self.n1.sum(axis=0)

    def logs(self, context: int, seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probabilities of all symbols after three bytes, where `seen` symbols have these counts."""
        n3, n2 = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
        n3[seen] = counts
        i, j = np.searchsorted(self.keys, [(context & 65535) << 9, ((context & 65535) + 1) << 9])
        n2[self.keys[i:j] & 511] = self.counts[i:j]
        return np.log10(probabilities([n3, n2, self.n1[context & 255], self.n0]))


def packed_lists(begin: np.ndarray, pairs: np.ndarray) -> pa.Array:
    """Pairs of 64-bit numbers as a list a row, each from one place in `begin` to the next."""
    cuts = (np.r_[begin, len(pairs)] * 16).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(pairs, "<i8"))])


def held_out(doc_id: str, folds: int, part: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == part, F.lit(False))


def counts(documents: DataFrame) -> DataFrame:
    """(kind, key, n) over all rows of (text): kind 0 words by hash, kind 1 contexts with symbols. Summed over the corpus."""

    def run(batches):
        words: Counter = Counter()
        keys, ns, held = [], [], 0

        def batch_of(kind, k, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])

        def of_words():
            out = batch_of(0, np.fromiter(map(word_hash, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
            words.clear()
            return out

        for batch in batches:
            for _, _, own in prepared(batch):
                for t in own:
                    words.update(t.split())
                words[_END_WORD] += len(own)
                k, n = count_grams(own)
                keys.append(k)
                ns.append(n)
                held += len(k)
                if held > 1_000_000:
                    k, n = merge(keys, ns)
                    keys, ns, held = [k], [n], len(k)
                    if held > 500_000:
                        yield batch_of(1, k, n)
                        keys, ns, held = [], [], 0
                if len(words) > MEMO:
                    yield of_words()
        if keys:
            yield batch_of(1, *merge(keys, ns))
        if words:
            yield of_words()

    return documents.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def train(counted: DataFrame, contexts: int = CONTEXTS3) -> tuple[Trie, Shorter, DataFrame]:
    """Of a stored table of counts: the table of frequent contexts, the counts of shorter ones, and the counts of the others (c, seen)."""
    grams = counted.filter("kind = 1")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    two = grams.groupBy(F.col("key").bitwiseAND((1 << 25) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    often = grams.groupBy(F.shiftright("key", 9).alias("c")).agg(F.sum("n").alias("m")).filter(F.col("m") * contexts >= total).select("c")
    three = grams.withColumn("c", F.shiftright("key", 9)).join(often, "c", "left_semi").select("key", "n").toArrow()
    of = lambda t: (t["key"].to_numpy(), t["n"].to_numpy().astype(float))
    others = grams.withColumn("c", F.shiftright("key", 9)).join(often, "c", "left_anti")
    others = others.groupBy("c").agg(F.collect_list(F.struct(F.col("key").bitwiseAND(511).cast("int").alias("symbol"), "n")).alias("seen"))  # 257 symbols at most
    return Trie(of(two), of(three)), Shorter(*of(two)), others


def score(documents: DataFrame, folds: int = 7, part: int = 2, contexts: int = CONTEXTS3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document. `contexts` bounds the broadcast table alone."""
    spark = documents.sparkSession
    docs = doc_texts(documents).withColumn("held_out", held_out("doc_id", folds, part))
    counted = materialize(counts(docs.filter(~F.col("held_out"))), "counts")
    known = counted.filter("kind = 0")
    n_train, n_types = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = known.filter(F.col("n") * HEAD >= n_train).select("key", "n").orderBy("key").toArrow()
    trie, shorter, others = train(counted, contexts)
    shared = spark.sparkContext.broadcast((trie, head["key"].to_numpy(), head["n"].to_numpy()))
    shared_shorter = spark.sparkContext.broadcast(shorter)

    def run(batches):
        trie, head_keys, head_counts = shared.value
        head_logs = np.log10(head_counts + 1.0)
        hashes: dict[bytes, int] = {}
        base, at = TaskContext.get().partitionId() << 32, 0
        cold: list[np.ndarray] = []
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        names = ["kind", "key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "docs"]

        def rows(n, **values):
            return pa.RecordBatch.from_arrays([values[c] if c in values else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

        def after_others():
            """Kind 2: a context that the table has not, with the documents and symbols that it stands before."""
            grams = np.concatenate(cold)
            cold.clear()
            grams.sort()
            i = 0
            while i < len(grams):
                j = int(np.searchsorted(grams, grams[min(i + PART, len(grams)) - 1] | np.uint64((1 << 40) - 1), side="right"))  # a context stays whole
                first = np.flatnonzero(np.r_[True, grams[i + 1 : j] != grams[i : j - 1]])
                times = np.diff(np.r_[first, j - i])
                own = grams[i:j][first]
                context = (own >> 40).astype(np.int64)
                begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                posting = (own & ((1 << 40) - 1)).astype(np.int64) + (base << 9)
                yield rows(len(begin), kind=pa.array(np.full(len(begin), 2, np.int32)), key=pa.array(context[begin]), docs=packed_lists(begin, np.stack([posting, times], axis=1)))
                i = j

        def hashed(ws: list[bytes]) -> list[int]:
            for w in set(ws).difference(hashes):
                hashes[w] = word_hash(w)
            return list(map(hashes.__getitem__, ws))

        for batch in batches:
            ids, held = batch.column("doc_id"), batch.column("held_out")
            for i, j, own in prepared(batch):
                split = [[*t.split(), _END_WORD] for t in own]
                n = np.array([len(ws) for ws in split])
                if len(hashes) > HASHES:
                    hashes.clear()
                h = np.fromiter((x for ws in split for x in hashed(ws)), np.int64, int(n.sum()))
                doc = np.repeat(np.arange(len(own)), n)
                where = np.minimum(np.searchsorted(head_keys, h), max(0, len(head_keys) - 1))
                hit = head_keys[where] == h if len(head_keys) else np.zeros(len(h), bool)
                sums = np.bincount(doc[hit], head_logs[where[hit]], len(own))
                keys = base + at + np.arange(len(own))
                logs, cold_doc, grams = trie.score(own)
                if len(grams):
                    # context, the document's number in the task, symbol: 24, 31 and 9 bits
                    cold.append((grams >> 9).astype(np.uint64) << 40 | (at + cold_doc).astype(np.uint64) << 9 | (grams & 511).astype(np.uint64))
                    if sum(map(len, cold)) > 2_000_000:
                        yield from after_others()
                yield rows(len(own), kind=pa.array(np.zeros(len(own), np.int32)), key=pa.array(keys), doc_id=ids.slice(i, j - i), held_out=held.slice(i, j - i), n_tokens=pa.array(n), n_known=pa.array(np.bincount(doc[hit], minlength=len(own))), base=pa.array(sums), score=pa.array(logs))
                at += len(own)
                rest, rest_doc = h[~hit], doc[~hit]
                if len(rest):
                    order = np.lexsort((rest_doc, rest))
                    rest, rest_doc = rest[order], rest_doc[order]
                    new = np.r_[True, (rest[1:] != rest[:-1]) | (rest_doc[1:] != rest_doc[:-1])]
                    first = np.flatnonzero(new)
                    times = np.diff(np.r_[first, len(rest)])
                    postings = np.stack([keys[rest_doc[first]], times], axis=1)
                    word = rest[first]
                    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                    yield rows(len(begin), kind=pa.array(np.ones(len(begin), np.int32)), key=pa.array(word[begin]), docs=packed_lists(begin, postings))

        if cold:
            yield from after_others()

    schema = "kind int, key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, docs binary"
    stored = materialize(docs.mapInArrow(run, schema), "scores")
    lists = stored.filter("kind = 1").select("key", "docs")

    def add_up(batches):
        for batch in batches:
            packed = column(batch, "docs")
            if not packed:
                continue
            n = np.array([len(x) // 16 for x in packed])
            flat = np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2)
            logs = np.repeat(np.log10(batch.column("n").to_numpy() + 1.0), n) * flat[:, 1]
            keys, own = np.unique(flat[:, 0], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(own, logs)), pa.array(np.bincount(own, flat[:, 1]).astype(np.int64))], names=["key", "tail", "tail_known"])

    def add_contexts(batches):
        for batch in batches:
            contexts, packed, seen = column(batch, "key"), column(batch, "docs"), batch.column("seen")
            if not contexts:
                continue
            number = {c: k for k, c in enumerate(dict.fromkeys(contexts))}
            logs: list = [None] * len(number)
            for k, c in enumerate(contexts):
                if logs[number[c]] is None:
                    own = seen[k].values
                    of = (lambda f, own=own: own.field(f).to_numpy() if own is not None else [])
                    logs[number[c]] = shared_shorter.value.logs(c, of("symbol"), of("n"))
            n = np.array([len(x) // 16 for x in packed])
            flat = np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2)
            row = np.repeat(np.arange(len(contexts)), n)
            doc = flat[:, 0] >> 9
            value = np.array(logs)[np.array([number[c] for c in contexts])[row], flat[:, 0] & 511] * flat[:, 1]
            # a row for each context and document: the sums over contexts are left to the grouping, which combines them in each task
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(np.add.reduceat(value, first))], names=["key", "rest"])

    tail = lists.join(known.select("key", "n"), "key").select("n", "docs").mapInArrow(add_up, "key long, tail double, tail_known long")
    rest = stored.filter("kind = 2").select("key", "docs").join(others.withColumnRenamed("c", "key"), "key", "left").select("key", "docs", "seen").mapInArrow(add_contexts, "key long, rest double")
    tail = tail.unionByName(rest, allowMissingColumns=True).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("tail", "tail_known", "rest")])
    out = stored.filter("kind = 0").drop("kind", "docs").join(tail, "key", "left")
    per_token = float(np.log10(n_train + (n_types + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
