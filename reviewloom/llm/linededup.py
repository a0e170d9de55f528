"""Line dedup by pairwise alignment: passages that an earlier document holds are cut from later ones.

A passage is a run of neighbouring lines with at least `min_words` words; lines are
compared without the white space around them, and lines without words do not count.
From each line starts one shortest such run (the line alone if it is long enough), and at
each line ends one; their 128-bit hashes are what documents are matched by. A common
passage of two documents begins and ends with a common run and each of its lines lies in
one, so none is missed, and boilerplate of a few words matches nothing.

Pairs: a hash with at most `rare` holders pairs each of them with all earlier ones. Of a
more frequent one, each holder is paired with the earliest holder: so pairs grow with
runs and not with the square of a group, and every passage that an earlier document
holds still has a pair.

A line is shared if it lies in a run that another document holds too. The shared lines of
a pair, in order, are aligned by patience diff: equal lines at both starts and both ends
are aligned; of the lines that occur once on either side, the longest increasing
subsequence is (of several, that whose places are latest, from its end on); the gaps
between these are aligned in the same way. Neighbouring lines that are aligned with
neighbouring lines form a block; blocks of at least `min_words` words are deleted from the
later document. What crosses the alignment (moved passages) or is repeated beyond it
stays, unless the alignment with another earlier document has it.

Order is by doc_id, then by a hash of the text. Defined results: a null text stays null;
empty and short texts stay; a document all of whose lines are aligned keeps its row, with
an empty text; identical rows with one doc_id are one document and get equal results; a
null doc_id is later than all others; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize

MIN_WORDS = 50
RARE = 8
T = "__rl_l_"
_FOUND = "kind int, d long, t long, a int, b int, k1 long, k2 long, at array<int>, words array<int>, lines array<long>"
_BLOCKS = "array<struct<a: int, b: int, partner: long, there: int, words: int>>"


def word_lines(text: str) -> tuple[list[int], list[bytes], list[int]]:
    """Of the lines with words: their numbers, their contents without white space around, their words."""
    kept = [(i, s) for i, line in enumerate(text.encode().split(b"\n")) if (s := line.strip())]
    return [i for i, _ in kept], [s for _, s in kept], [len(s.split()) for _, s in kept]


def runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """[first, last + 1) of the shortest run of at least `min_words` words from each line, and of that to each, in ranks of lines with words."""
    spans, end, held = set(), 0, 0
    for at, n in enumerate(words):  # from each line
        while end < len(words) and held < min_words:
            held += words[end]
            end += 1
        if held < min_words:
            break
        spans.add((at, end))
        held -= n
    at, held = 0, 0
    for end, n in enumerate(words, 1):  # to each line
        held += n
        while held - words[at] >= min_words:
            held -= words[at]
            at += 1
        if held >= min_words:
            spans.add((at, end))
    return sorted(spans)


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for at, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            piles.append(at)
        else:
            tops[pile], piles[pile] = v, at
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def patience(x: list, y: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences, ascending."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        there = Counter(y[c:d])
        place = {v: k for k, v in enumerate(y[c:d], c) if there[v] == 1}
        here = Counter(v for v in x[a:b] if v in place)
        both = [(k, place[v]) for k, v in enumerate(x[a:b], a) if here.get(v) == 1]
        anchors = [both[k] for k in increasing([p for _, p in both])]
        out += anchors
        for i, j in [*anchors, (b, d)] if anchors else ():
            if a < i and c < j:
                todo.append((a, i, c, j))
            a, c = i + 1, j + 1
    return sorted(out)


def aligned_blocks(x: dict, y: dict, min_words: int) -> list[tuple[int, int, int, int]]:
    """(first line, last line, first line there, words) of the blocks of a pair; at, ranks, words, lines of either side."""
    out, group = [], []

    def close():
        words = sum(x["words"][i] for i, _ in group)
        if words >= min_words:
            out.append((x["at"][group[0][0]], x["at"][group[-1][0]], y["at"][group[0][1]], words))

    for i, j in patience(x["lines"], y["lines"]):
        if group and not (x["ranks"][i] == x["ranks"][group[-1][0]] + 1 and y["ranks"][j] == y["ranks"][group[-1][1]] + 1):
            close()
            group = []
        group.append((i, j))
    if group:
        close()
    return out


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn(T + "d", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).withColumn(T + "t", F.xxhash64("text"))


def _found(documents: DataFrame, min_words: int) -> DataFrame:
    """Kind 0: a run and its hash. Kind 1: the lines with words of a document that has a run."""

    def signed(h: int) -> int:
        return h - (1 << 64) if h >> 63 else h

    def find(batches):
        names = [c.split()[0] for c in _FOUND.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for d, t, text in zip(column(batch, "d"), column(batch, "t"), column(batch, "text"), strict=True):
                at, lines, words = word_lines(text)
                if spans := runs(words, min_words):
                    rows.append((1, d, t, None, None, None, None, at, words, [signed(xxhash.xxh3_64_intdigest(s)) for s in lines]))
                    for a, b in spans:
                        h = xxhash.xxh3_128_intdigest(b"\n".join(lines[a:b]))
                        rows.append((0, d, t, a, b, signed(h >> 64), signed(h & (1 << 64) - 1), None, None, None))
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    source = _keyed(documents.select("doc_id", "text").filter(F.col("text").isNotNull())).select(F.col(T + "d").alias("d"), F.col(T + "t").alias("t"), "text")
    return source.mapInArrow(find, _FOUND)


def _pairs(met: DataFrame, rare: int) -> DataFrame:
    """(d, t, od, ot): later documents with the earlier ones that they are aligned with. met: runs with the earliest holder o and the number of holders."""
    star = met.filter((F.col("d") != F.col("o.d")) | (F.col("t") != F.col("o.t"))).select("d", "t", F.col("o.d").alias("od"), F.col("o.t").alias("ot"))
    few = met.filter((F.col("holders") > 2) & (F.col("holders") <= rare)).select("k1", "k2", "d", "t").distinct()
    few = few.groupBy("k1", "k2").agg(F.collect_list(F.struct("d", "t")).alias("all"))  # `rare` at most
    few = few.select("all", F.explode("all").alias("x")).select(F.col("x.d").alias("d"), F.col("x.t").alias("t"), F.explode(F.filter("all", lambda e: e < F.col("x"))).alias("e"))
    return star.unionByName(few.select("d", "t", F.col("e.d").alias("od"), F.col("e.t").alias("ot"))).distinct()


def blocks(documents: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """d, t (the later document's doc_id and text hash), blocks array<struct<a, b, partner, there, words>>, gone array<boolean> by line, removed."""
    found = materialize(_found(documents, min_words), "runs")
    own = found.filter("kind = 0").select("d", "t", "a", "b", "k1", "k2")
    held = own.groupBy("k1", "k2", "d", "t").agg(F.count("*")).groupBy("k1", "k2").agg(F.min(F.struct("d", "t")).alias("o"), F.count("*").alias("holders")).filter("holders > 1")
    met = materialize(own.join(held, ["k1", "k2"]), "met")
    spans = met.groupBy("d", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # a document's own runs

    def cut(batches):
        for batch in batches:
            kept: list[list] = [[], [], [], []]
            for spans, at, words, lines in zip(*(column(batch, c) for c in ("spans", "at", "words", "lines")), strict=True):
                edge = np.zeros(len(at) + 1, np.int64)
                np.add.at(edge, [s["a"] for s in spans], 1)
                np.add.at(edge, [s["b"] for s in spans], -1)
                ranks = np.flatnonzero(np.cumsum(edge)[:-1])
                for out, own in zip(kept, (np.array(at)[ranks], ranks, np.array(words)[ranks], np.array(lines)[ranks]), strict=True):
                    out.append(own)
            kinds = [pa.list_(k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), *(pa.array(x, k) for x, k in zip(kept, kinds, strict=True))], names=["d", "t", "at", "ranks", "words", "lines"])

    lines = found.filter("kind = 1").select("d", "t", "at", "words", "lines").dropDuplicates(["d", "t"]).join(spans, ["d", "t"])
    shared = materialize(lines.mapInArrow(cut, "d long, t long, at array<int>, ranks array<int>, words array<int>, lines array<long>"), "shared")
    side = F.struct("at", "ranks", "words", "lines")
    met_pairs = _pairs(met, rare).join(shared.select("d", "t", side.alias("x")), ["d", "t"]).join(shared.select(F.col("d").alias("od"), F.col("t").alias("ot"), side.alias("y")), ["od", "ot"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, partner = (batch.column(c)[k].as_py() for c in ("x", "y", "od"))
                if got := aligned_blocks(x, y, min_words):
                    rows = [{"a": a, "b": b, "partner": partner, "there": p, "words": n} for a, b, p, n in got]
                    yield pa.RecordBatch.from_pylist([{"d": batch.column("d")[k].as_py(), "t": batch.column("t")[k].as_py(), "blocks": rows}], pa.schema([("d", pa.int64()), ("t", pa.int64()), ("blocks", _arrow_blocks())]))

    by_doc = met_pairs.select("d", "t", "od", "x", "y").mapInArrow(run, f"d long, t long, blocks {_BLOCKS}")
    by_doc = by_doc.groupBy("d", "t").agg(F.sort_array(F.flatten(F.collect_list("blocks"))).alias("blocks"))

    def mark(batches):
        for batch in batches:
            masks, removed = [], []
            for own in column(batch, "blocks"):
                edge = np.zeros(max(x["b"] for x in own) + 2, np.int64)
                np.add.at(edge, [x["a"] for x in own], 1)
                np.add.at(edge, [x["b"] + 1 for x in own], -1)
                masks.append(np.cumsum(edge)[:-1] > 0)
                removed.append(int(masks[-1].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), batch.column("blocks"), pa.array(masks, pa.list_(pa.bool_())), pa.array(removed, pa.int64())], names=["d", "t", "blocks", "gone", "removed"])

    return by_doc.mapInArrow(mark, f"d long, t long, blocks {_BLOCKS}, gone array<boolean>, removed long")


def _arrow_blocks() -> pa.DataType:
    return pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("partner", pa.int64()), ("there", pa.int32()), ("words", pa.int32())]))


def dedup(documents: DataFrame, min_words: int = MIN_WORDS, removed: str | None = None, rare: int = RARE) -> DataFrame:
    """The documents without their aligned blocks; `removed` names a column for the number of lines deleted (lines without words inside a block go with it)."""
    cut = blocks(documents, min_words, rare).select(F.col("d").alias(T + "d"), F.col("t").alias(T + "t"), F.col("gone").alias(T + "g"), F.col("removed").alias(T + "n"))
    out = _keyed(documents).join(cut, [T + "d", T + "t"], "left")
    kept = F.expr(f"array_join(filter(split(text, '\\n', -1), (l, i) -> not coalesce(get({T}g, i), false)), '\\n')")
    out = out.withColumn(T + "x", F.when(F.col(T + "g").isNull(), F.col("text")).otherwise(kept))
    columns = []
    for c in documents.columns:
        if c == "text":
            columns.append(F.col(T + "x").alias("text"))
        elif c == "n_chars":  # it is the length of the text
            columns.append(F.when(F.col(T + "g").isNull(), F.col("n_chars")).otherwise(F.length(T + "x").cast(documents.schema["n_chars"].dataType)).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    if removed:
        columns.append(F.coalesce(F.col(T + "n"), F.lit(0)).cast("long").alias(removed))
    return out.select(*columns)
