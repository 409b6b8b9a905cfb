"""Tokenise documents and pack them into fixed-length training sequences.

Best-two-fit: a bin is filled greedily, each time with the longest piece that
fits; then its smallest piece gives way to two unpacked ones if they fill the
gap it leaves more tightly.  Lengths are whole numbers up to the capacity, so
the bins are planned on the histogram of lengths: the same bin is made as often
as a step by step fill would make it, which is until a length runs short.  The plan's
size depends on the capacity alone, not on the number of documents, and the
packing is that of the whole corpus.  Pieces then find their place by their
rank among those of equal length, which comes from the distributed order of
:mod:`loupe.ordered`; a length that a third of all pieces share spans buckets.

Defined results: NULL and empty texts are one piece that holds the end token
alone; only documents above the capacity are cut, and their first piece takes
the remainder; repeated rows are packed each; no rows give no sequences.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from loupe.frames import require
from loupe.llm.rows import text_of
from loupe.ordered import POSITION, with_position
from loupe.session import durable

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids binary"
DIGESTS = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: characters of a window that needs a blank, or words are long
WINDOW = 512


def worker_memory(name: str, make):
    """A value that the tasks of one Python worker share."""
    import sys
    import types

    kept = sys.modules.setdefault("_loupe_worker_memory", types.ModuleType("_loupe_worker_memory")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def byte_encoding(tokenizer_path: str):
    """A byte-pair encoding by ranks that gives the tokenizer's own ids, or None if the file isn't of that kind.

    Merging by rank of the merged bytes is merging by the list of pairs if ids
    rise with the list and every token is what its own text encodes to.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        given = json.load(file)
    model, split = given["model"], given["pre_tokenizer"] or {}
    if (
        given.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
        or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    ):
        return None
    # bytes are written as themselves or, where they can't be shown, as characters from 256 on
    shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    byte = {c: b for b, c in shown.items()}
    vocabulary, tokenize = model["vocab"], Tokenizer.from_file(tokenizer_path).model.tokenize
    merged = ["".join(pair if isinstance(pair, list) else pair.split(" ")) for pair in model["merges"]]
    ids = [vocabulary[m] for m in merged]
    if any(a >= b for a, b in zip(ids, ids[1:])) or any(len(tokenize(m)) != 1 for m in merged) or not set(shown.values()) <= set(vocabulary):
        return None
    ranks = {bytes(byte[c] for c in m): vocabulary[m] for m in [*shown.values(), *merged]}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def text_encoder(tokenizer_path: str):
    """A function from text to its token ids as little-endian unsigned 32-bit.

    Where the tokenizer is a byte-level BPE, its merges are run by the much
    faster library for such encodings.  The two might class a character
    differently, so each character is tried between others when it is first
    met; texts with one that differs, with a special token, or with a stretch
    without blanks are left to the tokenizer itself.
    """
    import re
    from array import array

    from tokenizers import Tokenizer

    tokenizer, fast = Tokenizer.from_file(tokenizer_path), byte_encoding(tokenizer_path)
    special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search
    alike: set[str] = set()
    unlike: set[str] = set()

    def slow(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def plain(text: str) -> bool:
        if fast is None or special(text):
            return False
        for c in set(text) - alike:
            if c not in unlike:
                probe = f"a{c}a {c} 1{c}1 !{c}! {c}{c} {c}\n{c}"
                (alike if fast.encode_ordinary(probe) == slow(probe) else unlike).add(c)
        # its merges take a time that grows with the square of a word's length
        windows = (text[k : k + WINDOW] for k in range(0, len(text) - WINDOW, WINDOW))
        return not any(" " not in w or w.isspace() for w in windows) and (not unlike or unlike.isdisjoint(text))

    def ids(text: str) -> bytes:
        return array("I", fast.encode_ordinary(text) if plain(text) else slow(text)).tobytes()

    return ids


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, digests: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids; with ``digests`` their CRC-32 instead.

    ``ids`` holds unsigned 32-bit little-endian numbers, as training loaders
    map them; :func:`numpy.frombuffer` reads them.  The end token counts as the
    document's last.
    """
    require(docs, "doc_id", "text")
    schema = DIGESTS if digests else PIECES

    def cut(batches: Iterator) -> Iterator:
        import zlib

        encode = worker_memory(tokenizer_path, lambda: text_encoder(tokenizer_path))
        end = end_id.to_bytes(4, "little")
        names = [f.split(" ")[0] for f in schema.split(", ")]
        given = zlib.crc32 if digests else bytes
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                code = encode(text) + end if text else end
                n = len(code) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc_id, k, a, b - a, given(code[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                held += 64 + len(code) * (not digests)
                if held > 8 << 20:
                    yield frame(rows, names)
                    rows, held = [], 0
            yield frame(rows, names)

    def frame(rows, names):
        import pandas as pd

        made = pd.DataFrame(rows, columns=names)
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInPandas(cut, schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: how many}) for each kind of bin, by best-two-fit."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    bins = []

    def longest(limit: int, used: dict[int, int]) -> int | None:
        """The longest length up to limit of which one is left beside those used."""
        at = bisect_right(lengths, limit) - 1
        while at >= 0 and left[lengths[at]] <= used.get(lengths[at], 0):
            at -= 1
        return lengths[at] if at >= 0 else None

    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        while (n := longest(gap, used)) is not None:
            # as many of it as fit and are left
            k = min(gap // n, left[n] - used.get(n, 0))
            used[n] = used.get(n, 0) + k
            gap -= k * n
        need = dict(used)
        if gap:
            small = min(used)
            room, best, pair = gap + small, small, None
            used[small] -= 1
            # the longer of two, downwards: once twice it is no better, no pair is
            at = bisect_right(lengths, room - 1) - 1
            while at >= 0 and 2 * lengths[at] > best:
                a = lengths[at]
                if left[a] > used.get(a, 0) and a != small:
                    used[a] = used.get(a, 0) + 1
                    b = longest(min(a, room - a), used)
                    used[a] -= 1
                    if b is not None and b != small and a + b > best:
                        best, pair = a + b, (a, b)
                        if best == room:
                            break
                at -= 1
            if pair is None:
                used[small] += 1
            else:
                for n in pair:
                    used[n] = used.get(n, 0) + 1
        used = {n: k for n, k in used.items() if k}
        # the next fill is the same while there are as many of each as this one looked at, the one it gave back included
        times = min((left[n] - max(k, need.get(n, 0))) // k + 1 for n, k in used.items())
        bins.append((times, used))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                lengths.pop(bisect_right(lengths, n) - 1)
    return bins


def pack(pieces: DataFrame, key: str, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """(key, sequence_id, offset) for rows of unique key and given length.

    Lengths are whole numbers from 1 to ``capacity``.
    """
    require(pieces, key, length)
    ranked = with_position(pieces.select(F.col(key).alias("key"), F.col(length).cast("long").alias("length")), ["length", "key"])
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must lie in 1..{capacity}")
    first = {}
    total = 0
    for n in sorted(counts):
        first[n], total = total, total + counts[n]
    # runs of positions (of equal length) that go to the same kind of bin
    runs, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for times, used in plan_bins(counts, capacity):
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            runs.append((first[n] + taken[n], k, n, sequence, offset))
            taken[n] += times * k
            offset += k * n
        sequence += times
    runs.sort()

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        start, k, n, base, offset = np.array(runs, dtype=np.int64).reshape(-1, 5).T
        for batch in batches:
            at = batch[POSITION].to_numpy(dtype=np.int64)
            run = np.searchsorted(start, at, side="right") - 1
            within = at - start[run]
            yield pd.DataFrame({
                "key": batch["key"], "sequence_id": base[run] + within // k[run], "offset": offset[run] + within % k[run] * n[run],
            })

    kind = dict(ranked.dtypes)["key"]
    placed = ranked.select("key", POSITION).mapInPandas(place, f"key {kind}, sequence_id long, offset long")
    return placed.withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed pieces: doc_id, piece, start, length, ids, sequence_id, offset.

    Tokens are written once to the shared folder and read back for the result;
    only keys and lengths are sorted.
    """
    pieces = durable(tokenise(docs, tokenizer_path, capacity, end_id).withColumn("key", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces, "key", capacity=capacity), "key").drop("key")
