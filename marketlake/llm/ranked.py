"""Ranked lexical search with a document FP-tree, branch and bound per item.

Only terms that the items have matter, so one pass restricts every document to these: its restricted vector lists term and
frequency, the most frequent term of the corpus first. Each task grows trees of at most ``TREE_DOCS`` documents from the
vectors it reads: ordered like words in a dictionary, vectors with a common beginning share a path, a chain without branches
is one node, and small neighbours under one parent share a leaf. Every node keeps, over the documents below it, the largest
frequency of each term and the smallest length norm m. As a score grows with every frequency and falls with m, these give a
bound on all scores below a node. For each item the nodes are entered depth first, the most promising child first, and a
subtree is left out when its bound is below the item's ``most``-th best score so far; leaves that are entered are scored
exactly, on whole restricted vectors. The best of each task meet in two steps, so that no task sees more of an item than a
share of all tasks' lists.

The items are the stated query set: they go to the tasks in blocks of about ``ITEMS`` at once, by a hash of their id.

Defined cases: a null text has no terms; a document without terms is never found. Items that repeat an id are one item with
the terms of all its rows; a null item id is an id of its own; an item without known terms has no rows. Rows that repeat a
doc_id are documents of their own; of equal scores a null doc_id comes last. Other columns are ignored. Empty tables give an
empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from marketlake.llm.common import release, stored, text_or_empty

__all__ = ["MOST", "Tree", "norms", "rank_documents", "terms", "weights"]

#: Documents that an item gets at most: the feature itself.
MOST = 50
#: Items that go to the tasks at once, about.
ITEMS = 2_000
#: Documents, and entries of their vectors, from which a tree is closed; documents of a leaf that several subtrees share.
TREE_DOCS, TREE_ENTRIES, LEAF = 4_096, 1_500_000, 32
#: Parts into which the tasks' lists are dealt before they meet for good.
PARTS = 64

_APART = bytes(32 if c < 0x30 or 0x3A <= c < 0x41 or 0x5B <= c < 0x61 or 0x7B <= c < 0x80 else c + 32 if 0x41 <= c < 0x5B else c for c in range(256))
_NO_ID = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text with repeats: runs of ASCII letters, digits and all other characters beyond ASCII."""
    return text.translate(_APART).split()


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def norms(length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 50 + (50 * length * n_docs) // n_terms


def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives per weight: grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _item_terms(items: DataFrame, item_id: str, text: str, block: int, blocks: int) -> list[tuple]:
    """(item id, its terms) of one block, collected: the query set, not the corpus."""
    rows = items.select(F.col(item_id).alias("item"), text_or_empty(text).alias("text")).filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
    found: dict[object, set[bytes]] = {}
    for r in rows.toLocalIterator():
        found.setdefault(r["item"], set()).update(terms(r["text"].encode("utf-8", "surrogatepass")))
    return list(found.items())


def restricted(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, term, tf): per document with terms, their number with repeats and the known ones with their frequencies."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"))
    ints = pa.list_(pa.int32())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                ids, texts = batch.slice(start, 512).columns
                out: tuple[list, ...] = ([], [], [], [])
                for i, plain in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist()):
                    words = terms(plain)
                    if words:
                        at, tf = np.unique(np.array([k for w in words if (k := known(w)) is not None], np.int32), return_counts=True)
                        for column, x in zip(out, (i, len(words), at, tf.astype(np.int32))):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), ints, ints))], names=["id", "n", "term", "tf"])
                release()

    return rows.mapInArrow(over, "id long, n long, term array<int>, tf array<int>")


class Tree:
    """An FP-tree over documents: rows (ids, m), and their vectors one after the other (bounds, term, tf), ranked terms first."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, bounds: np.ndarray, term: np.ndarray, tf: np.ndarray, order: np.ndarray, leaf: int = LEAF) -> None:
        rank = order[term]
        row = np.repeat(np.arange(len(ids)), np.diff(bounds))
        by = np.lexsort((rank, row))
        rank, term, tf = rank[by], term[by], tf[by]
        paths = [rank[a:b].astype(">i4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        place = sorted(range(len(ids)), key=paths.__getitem__)
        self.ids, self.m = ids[place], m[place]
        size = np.diff(bounds)[place]
        self.bounds = np.append(0, np.cumsum(size))
        take = np.repeat(bounds[:-1][place] - self.bounds[:-1], size) + np.arange(self.bounds[-1])
        self.term, self.tf = term[take], tf[take].astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), size)
        self._grow(rank[take], leaf)
        self._maxima(len(order))

    def _grow(self, rank: np.ndarray, leaf: int) -> None:
        """Nodes as ranges of documents: a node's children differ in the first term after what its documents share."""
        bounds, n = self.bounds, len(self.ids)
        lcp = np.zeros(n + 1, np.int64)  # terms that a document's path shares with the one before
        for i in range(1, n):
            a, b = rank[bounds[i - 1] : bounds[i]], rank[bounds[i] : bounds[i + 1]]
            k = min(len(a), len(b))
            unlike = np.flatnonzero(a[:k] != b[:k])
            lcp[i] = unlike[0] if len(unlike) else k
        low, high, children = [0], [n], [[]]
        todo = [0]
        while todo:
            at = todo.pop()
            a, b = low[at], high[at]
            if b - a <= leaf:
                continue
            inner = lcp[a + 1 : b]
            cuts = [a, *(np.flatnonzero(inner == inner.min()) + a + 1).tolist(), b]
            packed, start = [], cuts[0]
            for cut, following in zip(cuts[1:], [*cuts[2:], None]):
                # small neighbours share a leaf
                if following is None or following - start > leaf:
                    packed.append((start, cut))
                    start = cut
            if len(packed) == 1:
                packed = [(k, min(b, k + leaf)) for k in range(a, b, leaf)]
            for a, b in packed:
                children[at].append(len(low))
                low.append(a), high.append(b), children.append([])
                todo.append(len(low) - 1)
        self.low, self.high, self.children = np.array(low), np.array(high), children
        self.least_m = np.array([self.m[a:b].min() for a, b in zip(low, high)], np.int64)

    def _maxima(self, n_terms: int) -> None:
        """(node, largest tf) of each term, the terms one after the other: built from the leaves up."""
        parent = np.full(len(self.low), -1)
        for at, below in enumerate(self.children):
            parent[below] = at
        leaves = np.array([k for k, c in enumerate(self.children) if not c])
        leaves = leaves[np.argsort(self.low[leaves])]
        node = leaves[np.searchsorted(self.low[leaves], self.doc, "right") - 1]
        key, tf, found = self.term.astype(np.int64) * len(parent) + node, self.tf, []
        while len(key):
            by = np.argsort(key, kind="stable")
            key, tf = key[by], tf[by]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, tf = key[first], np.maximum.reduceat(tf, first)
            found.append((key, tf))
            up = parent[key % len(parent)]
            key, tf = (key // len(parent) * len(parent) + up)[up >= 0], tf[up >= 0]
        key, tf = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        by = np.lexsort((tf, key))
        key, tf = key[by], tf[by]
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.empty(0, np.int64)
        key, self.node_tf = key[last], tf[last]
        self.node = key % len(parent)
        self.heads = np.searchsorted(key // len(parent), np.arange(n_terms + 1))

    def bounds_of(self, own: list[int], weight: np.ndarray) -> np.ndarray:
        """For each node, a value that no document below it exceeds."""
        out = np.zeros(len(self.low), np.int64)
        for t in own:
            at = slice(self.heads[t], self.heads[t + 1])
            nodes = self.node[at]
            out[nodes] += weight[t] * _share(self.node_tf[at], self.least_m[nodes])
        return out

    def search(self, own: list[int], weight: np.ndarray, held: list[tuple], most: int, asked: np.ndarray) -> int:
        """Put the best documents for these terms into the heap ``held`` of (score, minus id); returns the leaves entered.

        ``asked``: scratch, false for every term on entry and on return.
        """
        bound = self.bounds_of(own, weight)
        asked[own] = True
        entered, path = 0, [0]
        while path:
            at = path.pop()
            least = held[0][0] if len(held) == most else 1
            if bound[at] < least:
                continue
            if self.children[at]:
                path.extend(sorted(self.children[at], key=bound.__getitem__))
                continue
            entered += 1
            a, b = self.low[at], self.high[at]
            span = slice(self.bounds[a], self.bounds[b])
            use = asked[self.term[span]]
            term, doc = self.term[span][use], self.doc[span][use]
            gain = weight[term] * _share(self.tf[span][use], self.m[doc])
            # exact: sums stay below 2 ** 53
            score = np.bincount(doc - a, weights=gain, minlength=b - a).astype(np.int64)
            for k in np.flatnonzero(score >= least).tolist():
                one = int(score[k]), -int(self.ids[a + k])
                if len(held) < most:
                    heapq.heappush(held, one)
                elif one > held[0]:
                    heapq.heapreplace(held, one)
        asked[own] = False
        return entered


def _searched(vectors: DataFrame, items: list[list[int]], df: np.ndarray, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(number, part, id, score): each task's best documents for each item, by the item's number."""
    weight = weights(df, n_docs)
    order = np.empty(len(df), np.int32)
    order[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        asked = np.zeros(len(df), bool)
        held: list[pa.RecordBatch] = []
        n = entries = 0

        def searched() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = np.array([_NO_ID if i is None else i for i in rows["id"].to_pylist()], np.int64)
            term, tf = (rows[c].chunk(0).flatten().to_numpy() for c in ("term", "tf"))
            bounds = np.append(0, np.cumsum(rows["term"].chunk(0).value_lengths().to_numpy())).astype(np.int64)
            tree = Tree(ids, norms(rows["n"].to_numpy(), n_docs, n_terms), bounds, term, tf, order)
            for number, own in enumerate(items):
                tree.search(own, weight, best[number], most, asked)
            held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                held.append(part)
                n, entries = n + part.num_rows, entries + len(part.column(2).flatten())
                if n >= TREE_DOCS or entries >= TREE_ENTRIES:
                    searched()
                    n = entries = 0
        if held:
            searched()
        at = TaskContext.get().partitionId() % PARTS
        rows = [(number, at, None if i == -_NO_ID else -i, score) for number, found in enumerate(best) for score, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["number", "part", "id", "score"])

    return vectors.select("id", "n", "term", "tf").mapInArrow(over, "number int, part int, id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = MOST, at_once: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``most`` highest-scoring documents with a score above 0, best first."""
    spark = docs.sparkSession
    blocks = max(1, -(-items.count() // at_once))
    kind = items.schema[item_id].dataType
    out = spark.createDataFrame([], f"`{item_id}` {kind.simpleString()}, rank int, `{doc_id}` long, score long")
    for block in range(blocks):
        asked = _item_terms(items, item_id, item_text, block, blocks)
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*(own for _, own in asked))))} if asked else {}
        if not vocabulary:
            continue
        vectors = stored(restricted(docs, vocabulary, doc_id, text))
        total = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        if not total["n"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        named = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(asked)], f"number int, item {kind.simpleString()}")
        own = [sorted(t for t in map(vocabulary.__getitem__, found) if df[t]) for _, found in asked]
        found = _searched(vectors, own, df, total["n"], total["terms"], most)
        best = [F.desc("score"), F.col("id").asc_nulls_last()]
        for keys in (["number", "part"], ["number"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= most)
        out = out.union(found.join(named, "number").select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score"))
    return out
