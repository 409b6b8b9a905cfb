"""Find and remove benchmark passages by a generalised suffix automaton.

All items become one automaton over numbers of words: each state stands for a
set of word sequences that occur at the same places, and its suffix link leads
to the longest shorter suffix that occurs elsewhere too.  A document's words
are streamed through it once.  At every word the state and the matching length
tell the longest suffix of the words so far that some item holds, so windows of
consecutive item words, and whole items shorter than a window, are found where
they end, without comparing the document with any item.

The automaton is built by tasks, in blocks of at most ``BLOCK_WORDS`` words
(longer items are cut into parts that overlap by a window less one word, so no
window is lost).  At most ``PASS_BLOCKS`` blocks are broadcast at once, which
bounds a worker's memory; a larger benchmark takes further passes over the
documents, each written to the shared folder.  Documents are never shuffled.

Defined results: NULL and empty texts have no words and no hits, in documents
and items alike; an item without words is never found; repeated items count
once by their item_id; hits of an item with NULL item_id are marked, but it is
neither counted nor listed; repeated documents are searched each; no items
leave every document clean, no documents give no rows.  Added columns that clash with those of the
input get a trailing underscore.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loupe.frames import col, require
from loupe.llm.rows import fresh, text_of
from loupe.session import durable

WINDOW = 10
#: documents of which a larger share of words is hit go as a whole
COVERAGE = 0.5
#: words of an automaton, automata of a pass, and words of an item's part
BLOCK_WORDS, PASS_BLOCKS, PART_WORDS = 1 << 18, 8, 1 << 12
#: bytes of a text that are split into words at once
CHUNK = 1 << 20
NEVER = 1 << 62

#: words of lower-cased text as an RE2 pattern
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: lower-cases A-Z; what is neither a digit, a letter nor beyond ASCII becomes a blank
AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_chunks(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time."""
    data = text.encode().translate(AS_WORDS)
    at = 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            end = (data.find(b" ", end) + 1) or len(data)
        yield data[at:end].split()
        at = end


class Automaton:
    """A generalised suffix automaton of numbered items, compact once built."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        sequences = [[number(w, len(self.vocabulary)) for w in words] for _, words in items]
        steps: list[dict[int, int]] = [{}]
        length, link = [0], [-1]

        def clone(of: int, n: int) -> int:
            steps.append(dict(steps[of]))
            length.append(n)
            link.append(link[of])
            return len(steps) - 1

        def redirect(p: int, word: int, old: int, new: int) -> None:
            while p >= 0 and steps[p].get(word) == old:
                steps[p][word] = new
                p = link[p]

        def extend(last: int, word: int) -> int:
            """The state of the sequence so far and one more word."""
            known = steps[last].get(word)
            if known is not None:
                if length[known] == length[last] + 1:
                    return known
                split = clone(known, length[last] + 1)
                link[known] = split
                redirect(last, word, known, split)
                return split
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            new, p = len(steps) - 1, last
            while p >= 0 and word not in steps[p]:
                steps[p][word] = new
                p = link[p]
            if p >= 0:
                known = steps[p][word]
                if length[known] == length[p] + 1:
                    link[new] = known
                else:
                    split = clone(known, length[p] + 1)
                    link[known] = link[new] = split
                    redirect(p, word, known, split)
            return new

        for sequence in sequences:
            last = 0
            for word in sequence:
                last = extend(last, word)
        n = len(steps)
        # the state that holds the last `window` words, for states of longer sequences
        order = sorted(range(1, n), key=length.__getitem__)
        tail = [-1] * n
        for v in order:
            if length[v] >= window:
                tail[v] = v if length[link[v]] < window else tail[link[v]]
        names: dict[int, set[str]] = {}
        whole = set()
        for (name, _), sequence in zip(items, sequences):
            v = 0
            for k, word in enumerate(sequence, 1):
                v = steps[v][word]
                if k >= window:
                    names.setdefault(tail[v], set()).update([] if name is None else [name])
            if 0 < len(sequence) < window:
                whole.add(v)
                names.setdefault(v, set()).update([] if name is None else [name])
        # the nearest whole short item among the proper suffixes, and the matching length from which a state tells a hit
        above, need = [0] * n, [NEVER] * n
        for v in order:
            above[v] = link[v] if link[v] in whole else above[max(link[v], 0)]
            need[v] = 0 if above[v] else length[v] if v in whole else window if length[v] >= window else NEVER
        # most states have one step: it is kept in arrays, the others in one table
        self.word, self.to = array("q", [-1]) * n, array("q", [0]) * n
        self.more: dict[int, int] = {}
        for v, step in enumerate(steps):
            if len(step) == 1:
                (self.word[v], self.to[v]), = step.items()
            else:
                self.more.update(((v << 32 | w), t) for w, t in step.items())
        self.length, self.link = array("q", length), array("q", link)
        self.tail, self.above, self.need = array("q", tail), array("q", above), array("q", need)
        self.whole, self.names = frozenset(whole), {v: tuple(sorted(s)) for v, s in names.items()}

    @classmethod
    def restored(cls, state: dict) -> Automaton:
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def scan(self, text: str) -> tuple[int, list[list[int]], set[str]]:
        """(words, hit spans of word numbers, names of the items found)."""
        get, word, to, more = self.vocabulary.get, self.word, self.to, self.more.get
        length, link, need, above, window = self.length, self.link, self.need, self.above, self.window
        spans: list[list[int]] = []
        seen: set[int] = set()
        v = l = n = 0
        for words in word_chunks(text):
            for i, w in enumerate(map(get, words), n):
                if w is None:
                    v = l = 0
                    continue
                while True:
                    t = to[v] if word[v] == w else more(v << 32 | w)
                    if t is not None:
                        v = t
                        l += 1
                        break
                    if not v:
                        break
                    v = link[v]
                    l = length[v]
                if l < need[v] or not v:
                    continue
                start = i + 1
                u = v if v in self.whole and l >= length[v] else above[v]
                if u:
                    start = i + 1 - length[u]
                    while u and u not in seen:
                        seen.add(u)
                        u = above[u]
                if l >= window:
                    seen.add(self.tail[v])
                    start = i + 1 - l
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
            n += len(words)
        return n, spans, {name for s in seen for name in self.names[s]}


def union(spans: list[list[int]]) -> list[list[int]]:
    """The spans in order, those that meet put together."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def byte_spans(text: str, spans: list[list[int]]) -> tuple[list[int], list[int]]:
    """Where spans of word numbers start and end in the text's UTF-8 bytes."""
    import re

    starts, ends, wanted = [], [], iter(spans)
    if not spans:
        return starts, ends
    a, b = next(wanted, (None, None))
    for i, found in enumerate(re.finditer(rb"[^ ]+", text.encode().translate(AS_WORDS))):
        if i == a:
            starts.append(found.start())
        if b is not None and i == b - 1:
            ends.append(found.end())
            a, b = next(wanted, (None, None))
            if a is None:
                break
    return starts, ends


def blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(automaton binary): the items' automata, built by tasks."""
    import pickle

    def cut(batches: Iterator) -> Iterator:

        step = max(PART_WORDS, 2 * window) - window + 1
        for batch in batches:
            rows = []
            for name, text in zip(batch["item_id"], batch["text"]):
                words = [w for chunk in word_chunks(text) for w in chunk]
                for k in range(0, max(1, len(words) - window + 1), step):
                    if part := words[k : k + step + window - 1]:
                        rows.append((name, len(part), b" ".join(part)))
            yield pd.DataFrame(rows, columns=["item_id", "n", "words"])

    def build(group):

        parts = sorted(zip(group["words"], group["item_id"].where(group["item_id"].notna(), None)), key=lambda x: (x[0], x[1] or ""))
        made = Automaton([(name, words.split()) for words, name in parts], window)
        return pd.DataFrame({"automaton": [pickle.dumps(vars(made))]})

    texts = items.select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text"))
    parts = durable(texts.mapInPandas(cut, "item_id string, n long, words binary").distinct())
    total = parts.agg(F.sum("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(-(-total // block_words) or 1))
    return durable(parts.groupBy(block).applyInPandas(build, "automaton binary"))


def scan(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS,
) -> DataFrame:
    """``docs`` with a struct ``found``: what they share with the items.

    Its fields: n_words, n_hit (words inside an occurring window), items (their
    item_ids as strings, in order), starts and ends (of the hit spans, in words),
    byte_starts and byte_ends (the same in UTF-8 bytes).
    """
    require(docs, "text")
    require(items, "item_id", "text")
    context = docs.sparkSession.sparkContext
    found = fresh(docs, "found")
    shape = "struct<n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>, byte_starts array<long>, byte_ends array<long>>"
    before = F.lit(None).cast(shape)
    waiting, shared = blocks(items, window, block_words).toLocalIterator(), []

    def searched(automata: list):
        ticket = uuid.uuid4().hex

        @F.pandas_udf(shape)
        def of(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
            import pickle


            from loupe.llm.packing import worker_memory

            held = worker_memory("automata", dict)
            if ticket not in held:
                held.clear()  # those of an earlier pass
                held[ticket] = [Automaton.restored(pickle.loads(a.value)) for a in automata]
            known = held[ticket]
            for texts, earlier in batches:
                rows = []
                for text, n_words, starts, ends, names in zip(texts, earlier["n_words"], earlier["starts"], earlier["ends"], earlier["items"]):
                    first = pd.isna(n_words)
                    spans = [] if first else [[int(a), int(b)] for a, b in zip(starts, ends)]
                    names, n = set() if first else set(names), 0 if first else int(n_words)
                    for automaton in known:
                        n, more, others = automaton.scan(text)
                        spans += more
                        names |= others
                    if not known:
                        n = sum(map(len, word_chunks(text)))
                    spans = union(spans)
                    rows.append((n, sum(b - a for a, b in spans), sorted(names), [a for a, _ in spans], [b for _, b in spans], *byte_spans(text, spans)))
                yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "starts", "ends", "byte_starts", "byte_ends"])

        return of

    while True:
        for row in waiting:
            # a worker's share of one pass, at most pass_blocks * block_words words
            shared.append(context.broadcast(bytes(row["automaton"])))
            if len(shared) == pass_blocks:
                break
        last = len(shared) < pass_blocks
        docs = docs.withColumn(found, searched(list(shared))(text_of(), before))
        if last:
            return docs
        docs = durable(docs)
        before = col(found)
        for old in shared:
            old.destroy()
        shared = []


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The documents without the spans they share with the items, and without those mostly made of them.

    A hit span goes from its first word's first byte to its last word's last;
    a document of which more than ``coverage`` of the words are hit goes as a
    whole.  Clean documents stay byte by byte; the columns are those of ``docs``.
    """

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:

        for texts, spans in batches:
            cut = []
            for text, starts, ends in zip(texts, spans["byte_starts"], spans["byte_ends"]):
                data, at, kept = text.encode(), 0, []
                for a, b in zip(starts, ends):
                    kept.append(data[at:a])
                    at = b
                cut.append((b"".join(kept) + data[at:]).decode())
            yield pd.Series(cut)

    found = scan(docs, items, window)
    name = found.columns[-1]
    part = lambda field: col(name).getField(field)
    kept = durable(found).where(part("n_hit") <= part("n_words") * F.lit(float(coverage)))
    text = F.when(part("n_hit") > 0, without(text_of(), col(name))).otherwise(col("text"))
    return kept.withColumn("text", text).select(*[col(c) for c in docs.columns])
