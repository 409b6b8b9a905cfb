"""Ranked lexical search by branch and bound over document FP-trees.

A document is restricted to the terms that some item asks for, and they are
ordered by falling document frequency, so documents that hold the same common
terms share a path of a trie.  Every node knows the largest term frequency of
each term below it and the smallest length norm ``m``; put into the score they
bound every document below.  For each item the tree is searched depth first,
the child with the highest bound first, and a subtree whose bound is below the
tenth best score so far is cut off.  Equal bounds are searched, so ties are
exact.

A task builds a tree for every ``TREE_DOCS`` documents it reads and carries the
best scores of the items from one tree to the next; it returns at most ``top``
rows an item, and the best of these are ranked.  Texts are read once and
never shuffled: restricted vectors are written to the shared folder with their
lengths, and corpus statistics come from there.  Items are broadcast in blocks
of at most ``BLOCK_TERMS`` terms (an item's terms stay together); further
blocks read the texts again.

Defined results: NULL and empty texts hold no term and are never found; an
item without terms, or whose terms no document holds, returns nothing; rows of
items repeated whole are one item, others are searched each, also if they share
an item_id or have none; repeated documents are ranked each; equal scores go by
doc_id, NULL last; no items or no documents give no rows.  Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loupe.frames import require
from loupe.llm.decontaminate import word_chunks
from loupe.llm.rows import text_of
from loupe.session import durable

TOP = 10
#: terms as an RE2 pattern; lower-casing A-Z first makes them the words of loupe.llm.decontaminate
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: terms of items searched at once; documents and terms of documents of a tree; documents of a leaf
BLOCK_TERMS, TREE_DOCS, TREE_TERMS, LEAF_DOCS = 1 << 18, 1 << 12, 1 << 22, 16


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n: int, n_docs: int, n_terms: int) -> int:
    """100 for a document of mean length, more for longer ones."""
    return 100 - 90 + (90 * n * n_docs) // n_terms


def saturated(tf, m):
    """A term's part of the score per weight: rises with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """An FP-tree of documents: (id, m, ranks, tfs), ranks rising, at least one."""

    def __init__(self, docs: list[tuple]):
        import numpy as np

        # big-endian bytes compare like the sequences of ranks
        codes = [r.astype(">u4").tobytes() for _, _, r, _ in docs]
        order = sorted(range(len(docs)), key=codes.__getitem__)
        self.codes = [codes[i] for i in order]
        self.ids = [docs[i][0] for i in order]
        self.m = np.array([docs[i][1] for i in order], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum([len(docs[i][2]) for i in order])))
        self.ranks = np.concatenate([docs[i][2] for i in order]).astype(np.int64)
        self.tfs = np.concatenate([docs[i][3] for i in order]).astype(np.int64)
        self.m_of_term = np.repeat(self.m, np.diff(self.start))
        self.root = self.grow(0, len(order), 0)
        del self.codes

    def shared(self, a: int, b: int, depth: int) -> int:
        """How many leading ranks all of the documents a to b share."""
        first, last = self.codes[a], self.codes[b - 1]
        end = min(len(first), len(last)) // 4
        while depth < end and first[4 * depth : 4 * depth + 4] == last[4 * depth : 4 * depth + 4]:
            depth += 1
        return depth

    def grow(self, a: int, b: int, depth: int) -> tuple:
        """(from, to, children, terms, tf maxima, smallest m) of the documents a to b."""
        import numpy as np

        children = []
        if b - a > LEAF_DOCS and self.codes[a] != self.codes[b - 1]:
            depth = self.shared(a, b, depth)
            at = a
            while at < b:
                branch = self.codes[at][4 * depth : 4 * depth + 4]
                low, high = at, b  # the last document of the branch, by halving
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if self.codes[middle][4 * depth : 4 * depth + 4] == branch else (low, middle)
                children.append(self.grow(at, high, depth))
                at = high
            terms = np.concatenate([c[3] for c in children])
            tfs = np.concatenate([c[4] for c in children])
        else:
            terms, tfs = self.ranks[self.start[a] : self.start[b]], self.tfs[self.start[a] : self.start[b]]
        order = np.argsort(terms, kind="stable")
        terms, first = np.unique(terms[order], return_index=True)
        return a, b, children, terms, np.maximum.reduceat(tfs[order], first), int(self.m[a:b].min())

    def search(self, weights, best: list[tuple], top: int) -> list[tuple]:
        """The ``top`` best (-score, id unknown, id), those given included, in order.

        ``weights`` has the item's weight of every rank, 0 for other terms.
        """
        import numpy as np

        def bound(node) -> int:
            w = weights[node[3]]
            at = np.flatnonzero(w)
            return int((w[at] * saturated(node[4][at], node[5])).sum())

        def least() -> int:
            return -best[-1][0] if len(best) == top else 1

        waiting = [(bound(self.root), self.root)]
        while waiting:
            most, node = waiting.pop()
            if most < least():
                continue
            a, b, children = node[:3]
            if children:
                below = sorted(((bound(c), c) for c in children), key=lambda x: x[0])  # the highest is searched first
                waiting += [x for x in below if x[0] >= least()]
                continue
            own = slice(self.start[a], self.start[b])
            parts = weights[self.ranks[own]] * saturated(self.tfs[own], self.m_of_term[own])
            scores = np.add.reduceat(parts, self.start[a:b] - self.start[a])
            found = np.flatnonzero(scores >= least())
            if len(found):
                best = sorted(best + [(-int(scores[i]), self.ids[a + i] is None, self.ids[a + i]) for i in found], key=key)[:top]
        return best


def key(entry: tuple):
    """An order that never compares a NULL id."""
    return (entry[0], True) if entry[1] else entry


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, found): n terms of each document, and which of the vocabulary's (numbers from 1), how often."""

    @F.pandas_udf("n long, terms binary, tfs binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        from collections import Counter

        import numpy as np

        get = vocabulary.get
        rows = []
        for text in texts:
            n, counts = 0, Counter()
            for words in word_chunks(text):
                n += len(words)
                counts.update(filter(None, map(get, words)))
            rows.append((n, np.array(list(counts), dtype="<u4").tobytes(), np.array(list(counts.values()), dtype="<i8").tobytes()))
        return pd.DataFrame(rows, columns=["n", "terms", "tfs"])

    return docs.select("doc_id", of(text_of()).alias("found")).select("doc_id", "found.n", "found.terms", "found.tfs")


def document_frequencies(vectors: DataFrame, size: int) -> list[int]:
    """For each number up to ``size`` how many documents hold the term; at most ``size`` rows."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np

        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"]), dtype="<u4"), minlength=size + 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    counted = vectors.select("terms").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = [0] * (size + 1)
    for r in counted.collect():
        out[r["term"]] = r["n"]
    return out


def search_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of every task for each of the items (number, terms)."""
    import numpy as np

    vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in items for t in terms}), 1)}
    vectors = durable(restricted(docs, vocabulary))
    facts = vectors.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    n_docs, n_terms = facts["n_docs"], facts["n_terms"]
    df = document_frequencies(vectors, len(vocabulary))
    by_frequency = sorted(range(1, len(df)), key=lambda t: (-df[t], t))
    rank = np.zeros(len(df), dtype=np.int64)
    rank[by_frequency] = np.arange(len(by_frequency))
    weights = np.array([weight(n_docs, df[t]) for t in by_frequency], dtype=np.int64)
    wanted = [(k, np.sort(rank[[vocabulary[t] for t in terms if df[vocabulary[t]]]])) for k, terms in items]
    wanted = [(k, ranks) for k, ranks in wanted if len(ranks)]
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[int, list[tuple]] = {}
        own = np.zeros(len(weights), dtype=np.int64)

        def search(held: list[tuple]) -> None:
            tree = Tree(held)
            for k, ranks in wanted:
                own[ranks] = weights[ranks]
                found[k] = tree.search(own, found.get(k, []), top)
                own[ranks] = 0

        held, size = [], 0
        for batch in batches:
            for doc_id, n, terms, tfs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs"))):
                ranks = rank[np.frombuffer(terms, dtype="<u4")]
                if not len(ranks):
                    continue
                order = np.argsort(ranks)
                held.append((doc_id, norm(n, n_docs, n_terms), ranks[order], np.frombuffer(tfs, dtype="<i8")[order]))
                size += len(ranks)
                if len(held) >= TREE_DOCS or size >= TREE_TERMS:
                    search(held)
                    held, size = [], 0
        if held:
            search(held)
        rows = [(k, doc_id, -score) for k, entries in found.items() for score, _, doc_id in entries]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], id_type), pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"]
        )

    return vectors.mapInArrow(best, f"item long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")


def terms_of(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): the distinct terms of every distinct row, joined by blanks."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: b" ".join(sorted({w for words in word_chunks(text) for w in words})))

    texts = items.select("item_id", text_of().alias("text")).distinct()
    return texts.select(F.monotonically_increasing_id().alias("item"), "item_id", of("text").alias("terms"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents with a score above 0."""
    require(docs, "doc_id", "text")
    require(items, "item_id", "text")
    named = durable(terms_of(items))
    size = F.when(F.length("terms") > 0, F.size(F.split(F.col("terms").cast("string"), " "))).otherwise(0)
    total = named.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = -(-total // block_terms) or 1
    found = None
    for block in range(blocks):
        rows = named.where((F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) & (F.length("terms") > 0)).select("item", "terms").collect()
        part = search_block(docs.select("doc_id", "text"), [(r["item"], bytes(r["terms"]).split(b" ")) for r in rows], top)
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
