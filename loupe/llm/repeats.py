"""Remove passages that start earlier in the corpus, by suffix order.

Every string of ``length`` bytes that also starts earlier (in a document of
smaller doc_id, or further up in the same one) is a repeat, and the bytes it
covers go.  Suffix order finds them: :mod:`loupe.llm.bwt` builds the
Burrows-Wheeler transform and the common prefixes of a collection of strings
column by column, and rows that share ``length`` symbols are equal strings.

One order over a whole corpus would be one task's work, so the corpus is dealt
out first.  A string's *anchor* is the smallest hash among its parts of
``PART`` bytes; equal strings have equal anchors, and neighbouring strings
share theirs, so a document falls into runs of some ``length - PART`` strings
of one anchor.  Three steps follow:

1. Runs are dealt by anchor.  Anchors that occur once hold no repeat and go.
2. The bytes of the other runs are dealt by anchor again, equal ones as one.
3. Each share is ordered, and of every group of equal strings all but the
   earliest are repeats.

Hot anchors: what occurs several times within a batch of documents is known to
repeat and passes by step 1, and equal runs meet as one in step 2, so a
passage in a third of all documents costs a share one entry a batch.  Runs
around a passage whose anchor occurs more than ``HOT`` times are dealt string
by string instead, by the hash of the string.  That is decided once an anchor,
by its count in the corpus, and holds for its runs in every batch.

Texts are packed into batches of some megabytes, compressed, and written once.

Defined results: NULL is the empty text; documents under ``length`` bytes hold
no string; doc_ids are whole numbers,
others raise; a NULL doc_id comes after all others; rows of equal doc_id go by
their hash, and of rows repeated whole one comes first and the others repeat
it; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from loupe.frames import col, require
from loupe.llm.bwt import collection
from loupe.llm.rows import fresh, row_hash, text_of
from loupe.session import durable

LENGTH = 100
#: bytes of the parts whose smallest hash is a string's anchor
PART = 32
#: bytes of text in a batch, and of those hashed at once
BATCH_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20
#: bytes of text a share should hold at most, and shares that a batch is dealt to at most: beyond their product shares grow
SHARE_BYTES, MOST_SHARES = 16 << 20, 1 << 14
#: occurrences beyond which an anchor's runs are dealt string by string
HOT = 1 << 16
#: bytes that are put in order at once, if one anchor doesn't hold more
ORDER_BYTES = 1 << 20
#: fixed: an odd multiplier, its inverse modulo 2**64, and that of the mixing step
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

BATCHES = "doc_ids binary, unknown binary, hashes binary, sizes binary, texts binary, others binary, bytes long"


def pack_batches(docs: DataFrame) -> DataFrame:
    """The corpus in batches: packed ids (and which are NULL), row hashes, text sizes and, compressed, the texts.

    ``others`` has the other columns as an Arrow stream, so that every type
    comes back as it was.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("hash"), text_of().alias("text"),
        *[col(c).alias(f"c{i}") for i, c in enumerate(others)],
    )

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=6).compress
        names = [f.split(" ")[0] for f in BATCHES.split(", ")]

        def row(ids, hashes, texts, parts):
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            sink = pa.BufferOutputStream()
            if others:
                with pa.ipc.new_stream(sink, parts[0].schema) as stream:
                    for part in parts:
                        stream.write_batch(part)
            known = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            unknown = np.array([i is None for i in ids], dtype=np.uint8)
            values = (known.tobytes(), unknown.tobytes(), np.array(hashes, dtype=np.int64).tobytes(), sizes.tobytes(), compress(b"".join(texts)), compress(sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.binary()) for v in values], pa.array([int(sizes.sum())], pa.int64())], names=names)

        ids, hashes, texts, parts, held = [], [], [], [], 0
        for batch in batches:
            given, first = batch.select([f"c{i}" for i in range(len(others))]), 0
            for i, (doc_id, h, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), batch.column("text"))):
                ids.append(doc_id)
                hashes.append(h)
                texts.append(text.as_buffer().to_pybytes())
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield row(ids, hashes, texts, [*parts, given.slice(first, i + 1 - first)])
                    ids, hashes, texts, parts, held, first = [], [], [], [], 0, i + 1
            if first < batch.num_rows:
                parts.append(given.slice(first))
        if ids:
            yield row(ids, hashes, texts, parts)

    return durable(rows.mapInArrow(pack, BATCHES).withColumn("batch", F.monotonically_increasing_id()))


def inflate(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def powers(n: int):
    """BASE and its inverse to the powers 0..n-1, modulo 2**64."""
    import numpy as np

    def of(base: int):
        out = np.empty(n, dtype=np.uint64)
        out[0] = 1
        done, step = 1, base
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(step)
            done += more
            step = step * step % (1 << 64)
        return out

    return of(BASE), of(pow(BASE, -1, 1 << 64))


def sliding(values, width: int, better):
    """The best of every ``width`` neighbours."""
    best, done = values, 1
    while done < width:
        more = min(done, width - done)
        best = better(best[: len(best) - more], best[more:])
        done += more
    return best


def anchors(text, length: int, part: int, table):
    """The anchor of the string that starts at each byte, and all hashes that are one, by place."""
    import numpy as np

    up, down = table
    n = len(text)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    parts = (total[part:] - total[:-part]) * down[: n - part + 1]
    parts ^= parts >> np.uint64(32)
    parts *= np.uint64(MIX)
    parts ^= parts >> np.uint64(29)
    width = length - part + 1
    least = sliding(parts, width, np.minimum)
    # a part is an anchor if it is the least of a string around it
    edge = np.zeros(width - 1, dtype=np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return least, parts[most == parts]


def runs_of(texts: bytes, sizes, length: int, part: int):
    """((anchor, document, start, strings) arrays of all runs of a batch, the anchor of every place of one).

    A place counts where two strings of one run are equal, as in text that
    repeats after a few bytes.
    """
    import numpy as np

    whole = np.frombuffer(texts, dtype=np.uint8)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    longest = max([CHUNK_BYTES, *sizes.tolist()]) + 1
    table = powers(min(longest, len(whole) + 1))
    found, occurring = [], [np.zeros(0, np.uint64)]
    first, n_docs, width = 0, len(sizes), length - part + 1
    while first < n_docs:
        last = max(first + 1, int(np.searchsorted(ends, begins[first] + CHUNK_BYTES, side="right")))
        low, high = int(begins[first]), int(ends[last - 1])
        if high - low >= length:
            marks, places = anchors(whole[low:high], length, part, table)
            occurring.append(places)
            valid = np.zeros(len(marks), dtype=bool)
            for a, b in zip(begins[first:last].tolist(), ends[first:last].tolist()):
                if b - a >= length:
                    valid[a - low : b - low - length + 1] = True
            at = np.flatnonzero(valid)
            marks = marks[at]
            new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (marks[1:] != marks[:-1]))) if len(at) else at
            counts = np.diff(np.append(new, len(at)))
            # strings of a run share one anchor, but long ones (of a few repeated bytes) are cut
            pieces = -(-counts // width)
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            new, counts = np.repeat(new, pieces) + step * width, np.minimum(np.repeat(counts, pieces) - step * width, width)
            starts = at[new] + low
            docs = np.searchsorted(ends, starts, side="right")
            found.append((marks[new], docs.astype(np.uint32), (starts - begins[docs]).astype(np.uint32), counts.astype(np.uint8)))
        first = last
    if not found:
        found.append((np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint8)))
    return tuple(np.concatenate(c) for c in zip(*found)), np.concatenate(occurring)


RUN = [("anchor", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("strings", "u1")]


def packed(records) -> bytes:
    """Records compressed column by column: differences between rows, byte by byte."""
    import numpy as np
    import zstandard

    columns = []
    for name in records.dtype.names:
        column = np.ascontiguousarray(records[name])
        steps = np.diff(column, prepend=column.dtype.type(0))
        columns.append(steps.view(np.uint8).reshape(len(column), column.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(columns))


def unpacked(data: bytes, kind):
    import numpy as np

    whole = np.frombuffer(inflate(data), dtype=np.uint8)
    kind = np.dtype(kind)
    n = len(whole) // kind.itemsize
    records, at = np.empty(n, dtype=kind), 0
    for name in kind.names:
        size = kind[name].itemsize
        steps = np.ascontiguousarray(whole[at : at + n * size].reshape(size, n).T).view(kind[name]).ravel()
        records[name] = np.cumsum(steps, dtype=kind[name])
        at += n * size
    return records


def chosen_runs(runs, at) -> bytes:
    import numpy as np

    out = np.zeros(len(at), dtype=RUN)
    for name, values in zip(("anchor", "doc", "start", "strings"), runs):
        out[name] = values[at]
    return packed(out)


def shared_runs(batches: DataFrame, length: int, part: int, shares: int, hot: int) -> DataFrame:
    """Step 1: (batch, runs, hot), the runs whose anchor occurs again and the batch's hot anchors.

    A share's entries are ``runs`` that are alone in their batch and ``known``
    anchors with their counts, that occur more often in one.  A share holds all
    counts of its anchors, so it tells every batch which of its anchors are hot.
    """

    def deal(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in frames:
            for batch, sizes, texts in zip(frame["batch"], frame["sizes"], frame["texts"]):
                sizes = np.frombuffer(sizes, dtype=np.int64)
                runs, occurring = runs_of(inflate(texts), sizes, length, part)
                marks, counts = np.unique(occurring, return_counts=True)
                where = np.searchsorted(marks, runs[0])
                alone = counts[where] == 1
                rows = []
                known = np.zeros(int((counts > 1).sum()), dtype=[("anchor", "<u8"), ("count", "<u8")])
                known["anchor"], known["count"] = marks[counts > 1], counts[counts > 1]
                single = np.flatnonzero(alone)
                single = single[np.argsort((runs[0][single] % np.uint64(shares)), kind="stable")]
                edges = np.searchsorted(runs[0][single] % np.uint64(shares), np.arange(shares + 1))
                known = known[np.argsort(known["anchor"] % np.uint64(shares), kind="stable")]
                known_edges = np.searchsorted(known["anchor"] % np.uint64(shares), np.arange(shares + 1))
                for s in range(shares):
                    own, also = single[edges[s] : edges[s + 1]], known[known_edges[s] : known_edges[s + 1]]
                    if len(own) or len(also):
                        rows.append((s, batch, chosen_runs(runs, own), also.tobytes()))
                # what repeats within the batch needs no other: it is passed on by any share
                more = np.flatnonzero(~alone)
                if len(more):
                    rows.append((-1 - int(batch) % shares, batch, chosen_runs(runs, more), b""))
                yield pd.DataFrame(rows, columns=["share", "batch", "runs", "known"])

    def meet(share):
        import numpy as np
        import pandas as pd

        if share["share"].iloc[0] < 0:
            return share[["batch", "runs"]].assign(hot=b"")
        own = [unpacked(r, RUN) for r in share["runs"]]
        known = [np.frombuffer(k, dtype=[("anchor", "<u8"), ("count", "<u8")]) for k in share["known"]]
        everything = np.concatenate([r["anchor"] for r in own + known])
        weights = np.concatenate([*[np.ones(len(r), dtype=np.int64) for r in own], *[k["count"].astype(np.int64) for k in known]])
        marks, where = np.unique(everything, return_inverse=True)
        counts = np.bincount(where, weights=weights)
        often = marks[counts > hot]
        rows = []
        for batch, runs, also in zip(share["batch"], own, known):
            kept = runs[counts[np.searchsorted(marks, runs["anchor"])] > 1]
            mine = np.intersect1d(often, np.concatenate([kept["anchor"], also["anchor"]]))
            if len(kept) or len(mine):
                rows.append((batch, packed(kept), mine.tobytes()))
        return pd.DataFrame(rows, columns=["batch", "runs", "hot"])

    dealt = batches.select("batch", "sizes", "texts").mapInPandas(deal, "share int, batch long, runs binary, known binary")
    return dealt.groupBy("share").applyInPandas(meet, "batch long, runs binary, hot binary")


#: a run's place in the corpus, which also is its order
PLACE = [("unknown", "u1"), ("doc_id", "<i8"), ("hash", "<i8"), ("batch", "<i8"), ("doc", "<u4"), ("start", "<u4"), ("strings", "u1")]
SPAN = [("doc", "<u4"), ("start", "<u4"), ("end", "<u4")]


def spans_of(doc, start, length: int):
    """Packed spans that strings at these places cover, neighbours joined."""
    import numpy as np

    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    if not len(doc):
        return np.zeros(0, dtype=SPAN)
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    out = np.zeros(len(first), dtype=SPAN)
    out["doc"], out["start"], out["end"] = doc[first], start[first], start[last] + length
    return out


def each_string(places):
    """(batch, doc, start) of every string of the runs at the places."""
    import numpy as np

    n = places["strings"].astype(np.int64)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(places["batch"], n), np.repeat(places["doc"], n), np.repeat(places["start"].astype(np.int64), n) + step


def earliest_of_equal(strings: list[bytes], places):
    """(first, others): the places that come first with their bytes, and all the others."""
    import numpy as np

    order = np.lexsort([places[n] for n in ("start", "doc", "batch", "hash", "doc_id", "unknown")])
    seen, others = {}, []
    for i in order.tolist():
        if strings[i] in seen:
            others.append(i)
        else:
            seen[strings[i]] = i
    return np.array(list(seen.values()), dtype=np.int64), np.array(others, dtype=np.int64)


def ordered_repeats(strings: list[bytes], places, length: int):
    """Places (index, offset) of the strings of ``length`` that start earlier in the collection."""
    import numpy as np

    lengths = np.array([len(s) for s in strings])
    symbols = np.frombuffer(b"".join(strings), dtype=np.uint8) + np.uint8(1)
    string, offset, lcp = collection(symbols, np.cumsum(lengths) - lengths, lengths)
    same = lcp >= length
    group = np.cumsum(~same)
    member = same | np.append(same[1:], False)
    string, offset, group = string[member], offset[member], group[member]
    # documents by number in order
    order = np.lexsort([places[n] for n in ("start", "doc", "batch", "hash", "doc_id", "unknown")])
    other = np.zeros(len(places), dtype=bool)
    for name in ("unknown", "doc_id", "hash", "batch", "doc"):
        column = places[name][order]
        other[1:] |= column[1:] != column[:-1]
    rank = np.empty(len(places), dtype=np.int64)
    rank[order] = np.cumsum(other)
    order = np.lexsort((places["start"][string].astype(np.int64) + offset, rank[string], group))
    string, offset, group = string[order], offset[order], group[order]
    later = np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, dtype=bool)
    return string[later], offset[later]


def repeated_spans(batches: DataFrame, shared: DataFrame, length: int, part: int, shares: int) -> DataFrame:
    """Steps 2 and 3: (batch, spans) that repeat something earlier."""

    def deal(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import xxhash
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress

        def placed(runs, batch, ids, unknown, hashes):
            places = np.zeros(len(runs), dtype=PLACE)
            for name in ("doc", "start", "strings"):
                places[name] = runs[name]
            places["doc_id"], places["unknown"], places["hash"], places["batch"] = ids[runs["doc"]], unknown[runs["doc"]], hashes[runs["doc"]], batch
            return places

        for frame in frames:
            for batch, ids, unknown, hashes, sizes, texts, parts, often in zip(frame["batch"], frame["doc_ids"], frame["unknown"], frame["hashes"], frame["sizes"], frame["texts"], frame["runs"], frame["hot"]):
                runs = np.concatenate([unpacked(p, RUN) for p in parts])
                often = np.frombuffer(b"".join(often), dtype=np.uint64)
                ids, hashes, sizes = (np.frombuffer(x, dtype=np.int64) for x in (ids, hashes, sizes))
                unknown = np.frombuffer(unknown, dtype=np.uint8)
                begins = np.cumsum(sizes) - sizes
                whole = inflate(texts)

                def bytes_of(runs):
                    low = begins[runs["doc"]] + runs["start"]
                    high = low + runs["strings"] + length - 1
                    return [whole[a:b] for a, b in zip(low.tolist(), high.tolist())]

                strings, places = bytes_of(runs), placed(runs, batch, ids, unknown, hashes)
                first, others = earliest_of_equal(strings, places)
                repeated = [places[others]]
                strings, places, anchor = [strings[i] for i in first.tolist()], places[first], runs["anchor"][first]
                very = np.isin(anchor, often)
                if very.any():
                    # equal runs are one by now; the strings of those left may still be equal
                    n = runs["strings"][first[very]].astype(np.int64)
                    single = np.repeat(runs[first[very]], n)
                    single["start"] += (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint32)
                    single["strings"] = 1
                    pieces, at = bytes_of(single), placed(single, batch, ids, unknown, hashes)
                    first, others = earliest_of_equal(pieces, at)
                    repeated.append(at[others])
                    pieces = [pieces[i] for i in first.tolist()]
                    cold = np.flatnonzero(~very)
                    strings = [strings[i] for i in cold.tolist()] + pieces
                    places = np.concatenate([places[cold], at[first]])
                    anchor = np.concatenate([anchor[cold], np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], dtype=np.uint64)])
                others = np.concatenate(repeated)
                rows = []
                if len(others):
                    rows.append((-1 - int(batch) % shares, batch, spans_of(*each_string(others)[1:], length).tobytes(), b"", b""))
                share = anchor % np.uint64(shares)
                order = np.argsort(share, kind="stable")
                share = share[order]
                edges = np.searchsorted(share, np.arange(shares + 1))
                for s in range(shares):
                    own = order[edges[s] : edges[s + 1]]
                    if len(own):
                        rows.append((s, batch, packed(places[own]), anchor[own].tobytes(), compress(b"".join([strings[i] for i in own.tolist()]))))
                yield pd.DataFrame(rows, columns=["share", "batch", "places", "anchors", "texts"])

    def meet(share):
        import numpy as np
        import pandas as pd

        if share["share"].iloc[0] < 0:
            return share[["batch", "places"]].rename(columns={"places": "spans"})
        parts = [unpacked(p, PLACE) for p in share["places"]]
        places = np.concatenate(parts)
        anchor = np.frombuffer(b"".join(share["anchors"]), dtype=np.uint64)
        strings = []
        for own, texts in zip(parts, share["texts"]):
            whole = inflate(texts)
            low = 0
            for n in own["strings"].tolist():
                strings.append(whole[low : low + n + length - 1])
                low += n + length - 1
        first, others = earliest_of_equal(strings, places)
        batch, doc, start = each_string(places[others])
        found = [(batch, doc, start)]
        # only anchors with several runs, or one that could repeat itself, need an order: all
        # strings of a run hold the same bytes in its middle, and equal ones hold them twice
        order = first[np.argsort(anchor[first], kind="stable")]
        marks, counts = np.unique(anchor[order], return_counts=True)
        middle = length - part
        twice = [strings[i].find(strings[i][middle:length], middle + 1) >= 0 for i in order.tolist()]
        needed = np.repeat(counts > 1, counts) | np.array(twice, dtype=bool)
        order = order[needed]
        sizes = places["strings"][order].astype(np.int64) + length - 1
        borders = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1])) if len(order) else np.zeros(0, dtype=np.int64)
        group_bytes = np.add.reduceat(sizes, borders) if len(order) else sizes
        low = 0
        while low < len(borders):
            high, held = low, 0
            while high < len(borders) and (high == low or held + group_bytes[high] <= ORDER_BYTES):
                held += group_bytes[high]
                high += 1
            own = order[borders[low] : borders[high] if high < len(borders) else len(order)]
            string, offset = ordered_repeats([strings[i] for i in own.tolist()], places[own], length)
            if len(string):
                which = places[own][string]
                found.append((which["batch"], which["doc"], which["start"].astype(np.int64) + offset))
            low = high
        batch, doc, start = (np.concatenate(c) for c in zip(*found))
        rows = []
        order = np.argsort(batch, kind="stable")
        batch, doc, start = batch[order], doc[order], start[order]
        edges = np.flatnonzero(np.append(True, batch[1:] != batch[:-1])) if len(batch) else order
        for a, b in zip(edges, np.append(edges[1:], len(batch))):
            rows.append((int(batch[a]), spans_of(doc[a:b], start[a:b], length).tobytes()))
        return pd.DataFrame(rows, columns=["batch", "spans"])

    together = shared.groupBy("batch").agg(F.collect_list("runs").alias("runs"), F.collect_list("hot").alias("hot"))  # bounded by the batch's size
    joined = batches.select("batch", "doc_ids", "unknown", "hashes", "sizes", "texts").join(together, "batch")
    dealt = joined.mapInPandas(deal, "share int, batch long, places binary, anchors binary, texts binary")
    return dealt.groupBy("share").applyInPandas(meet, "batch long, spans binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, part: int = PART, hot: int = HOT) -> DataFrame:
    """The columns of ``docs`` with the text that is left, and what was removed.

    Added: ``kept`` (the bytes left; the text leaves out what is no longer a
    whole character), ``n_bytes`` before, ``n_removed`` and ``removed``, the
    maximal spans of bytes.
    """
    require(docs, "doc_id", "text")
    if not part < length < 128:
        raise ValueError("part < length < 128 is needed")
    batches = pack_batches(docs)
    total = batches.agg(F.sum("bytes")).first()[0] or 0
    shares = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-total // SHARE_BYTES), MOST_SHARES))
    shared = shared_runs(batches, length, part, shares, hot)
    spans = repeated_spans(batches, shared, length, part, shares)
    together = spans.groupBy("batch").agg(F.collect_list("spans").alias("spans"))  # bounded by the batch's size
    joined = batches.select("batch", "doc_ids", "unknown", "sizes", "texts", "others").join(together, "batch", "left")

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    schema = T.StructType.fromDDL("doc_id long, text string, kept binary, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>")
    schema = T.StructType(schema.fields + [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(others)])

    def cut(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), span]
        for frame in frames:
            for ids, unknown, sizes, texts, rest, parts in zip(*(frame.column(c).to_pylist() for c in ("doc_ids", "unknown", "sizes", "texts", "others", "spans"))):
                found = np.frombuffer(b"".join(parts or []), dtype=SPAN)
                found = found[np.lexsort((found["start"], found["doc"]))]
                edges = np.searchsorted(found["doc"], np.arange(len(ids) // 8 + 1))
                whole = inflate(texts)
                given = pa.ipc.open_stream(inflate(rest)).read_all().combine_chunks() if others else None
                low = first = held = 0
                rows = []
                unknown = np.frombuffer(unknown, dtype=np.uint8)
                sizes = np.frombuffer(sizes, dtype=np.int64).tolist()
                for i, (doc_id, size) in enumerate(zip(np.frombuffer(ids, dtype=np.int64).tolist(), sizes)):
                    text = whole[low : low + size]
                    own: list[list[int]] = []
                    for a, b in found[edges[i] : edges[i + 1]][["start", "end"]].tolist():
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(b, own[-1][1])
                        else:
                            own.append([a, b])
                    bounds = [0, *[x for span in own for x in span], size]
                    kept = b"".join([text[a:b] for a, b in zip(bounds[::2], bounds[1::2])])
                    rows.append((
                        None if unknown[i] else doc_id, kept.decode(errors="ignore"), kept, size, size - len(kept), [{"start": a, "end": b} for a, b in own],
                    ))
                    low, held = low + size, held + size
                    if held > 4 << 20 or i == len(sizes) - 1:
                        more = [given.column(k).slice(first, len(rows)).combine_chunks() for k in range(len(others))]
                        more = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in more]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] + more, names=schema.names)
                        rows, held, first = [], 0, i + 1

    result = joined.mapInArrow(cut, schema)
    fields = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    fields |= {c: F.col(f"c{i}") for i, c in enumerate(others)}
    extra = [F.col(name).alias(fresh(docs, name)) for name in ("kept", "n_bytes", "n_removed", "removed")]
    return result.select(*[fields[c].alias(c) for c in docs.columns], *extra)
