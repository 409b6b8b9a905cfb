"""Mine collocations by multikey three-way quicksort of suffix pointers.

Every word of a text starts a suffix: itself and the next words of its piece,
``longest`` at most.  Suffixes are routed by language and their two leading
words, so a task holds all suffixes that begin alike.  There a multikey
three-way quicksort orders pointers to them: at each depth a pivot word parts
the pointers into smaller, equal and greater, and only the equal ones go on to
the next word.  The size of an equal partition is the count of its leading
words.  A partition smaller than ``least`` is abandoned before it is sorted
further, as no phrase in it can be frequent; this is exact, because nothing
that begins with the same two words lies elsewhere.

Texts are read twice.  The first pass counts words, which decides how many
shards there are and which pairs of words are hot (``HOT`` of all words or
more; at most ``1 / HOT`` of them, broadcast).  The second pass sums equal
suffixes of a batch before they are shuffled.  Suffixes of a hot pair are
routed by a third word, too; the count of a hot pair itself is summed from the
batches.  Routing never changes a count.

Defined results: NULL and empty texts have no words; a NULL language is
``und``, and counts with texts that say so; repeated rows count each; ties are
ordered by the phrase's bytes; no rows, or no frequent phrases, give no rows.
Columns besides ``text`` and ``lang`` aren't read.  Words are valid UTF-8, as
separators are ASCII.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loupe.frames import require
from loupe.llm.rows import text_of
from loupe.session import durable

LEAST, LONGEST, TOP = 10, 3, 2000
#: a candidate goes if a longer one that holds it has this share, in hundredths, of its count
ABSORBED = 50
UNKNOWN = "und"
#: bytes of text that are summed before they are shuffled; words of a shard
BATCH_BYTES, SHARD_WORDS = 1 << 23, 1 << 19
#: share of all words from which a pair of words is hot, and the least count of it in a batch
HOT, HOT_COUNT = 1 / 4096, 32

#: lower-cases A-Z; blanks become 32 and what ends a piece 10
AS_PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b in (9, 32) else b for b in range(256))


def word_arrays(data: bytes, longest: int):
    """(dictionary, ids): distinct words as an Arrow array, and for the word at each place its id and the next ones'.

    ``ids`` has a row for each of the ``longest`` words of a suffix, -1 beyond
    the end of its piece.
    """
    import numpy as np
    import pyarrow as pa

    chars = np.frombuffer(data.translate(AS_PIECES), dtype=np.uint8)
    inside = (chars != 32) & (chars != 10)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(chars[inside])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(chars == 10), starts)
    ids = np.full((longest, n), -1, dtype=np.int64)
    ids[0] = words.indices.to_numpy()
    for k in range(1, min(longest, n)):
        same = piece[k:] == piece[:-k]
        ids[k, :-k][same] = ids[0, k:][same]
    return words.dictionary, ids


def long_parts(text: bytes, longest: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(part, words that only continue its suffixes) of a text in parts of about ``size`` bytes."""
    at = 0
    while len(text) - at > size:
        line, blank = text.find(b"\n", at + size), text.find(b" ", at + size)
        if line >= 0 and (line - at < 2 * size or not 0 <= blank < line):
            yield text[at : line + 1], 0
            at = line + 1
            continue
        if blank < 0:
            break
        # inside a piece: the part is followed by the next words, which start no suffix
        end, more = blank, 0
        while more < longest - 1:
            while end < len(text) and text[end] == 32:
                end += 1
            if end == len(text) or text[end] == 10:
                break
            more += 1
            end = min((p for p in (text.find(b" ", end), text.find(b"\n", end)) if p >= 0), default=len(text))
        yield text[at:end], more
        at = blank
    yield text[at:], 0


def gathered(batches: Iterator, longest: int, size: int) -> Iterator[dict[str, tuple]]:
    """{language: (dictionary, ids)} of about ``size`` bytes of text at a time, from batches (lang, text)."""
    texts: dict[str, list[bytes]] = {}
    held = 0

    def taken():
        return {lang: word_arrays(b"\n".join(own), longest) for lang, own in texts.items()}

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            data = text.as_py().encode()
            if len(data) > size:
                for part, more in long_parts(data.translate(AS_PIECES), longest, size):
                    dictionary, ids = word_arrays(part, longest)
                    yield {lang: (dictionary, ids[:, : ids.shape[1] - more])}
                continue
            texts.setdefault(lang, []).append(data)
            held += len(data)
            if held >= size:
                yield taken()
                texts, held = {}, 0
    if texts:
        yield taken()


def texts_of(docs: DataFrame) -> DataFrame:
    require(docs, "text", "lang")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of().alias("text"))


def count_words(texts: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """(lang, first, second, n): all words, second NULL, and pairs frequent within some batch."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("lang", pa.string()), ("first", pa.string()), ("second", pa.string()), ("n", pa.int64())])
        for found in gathered(batches, 2, size):
            least = max(HOT_COUNT, HOT * sum(ids.shape[1] for _, ids in found.values()))
            for lang, (dictionary, ids) in found.items():
                words = dictionary.cast(pa.large_string()).cast(pa.string())
                n = np.bincount(ids[0], minlength=len(words))
                keys, times = np.unique(ids[0][ids[1] >= 0] * len(words) + ids[1][ids[1] >= 0], return_counts=True)
                keys, times = keys[times >= least], times[times >= least]
                known = np.flatnonzero(n)  # the continuation of a long piece starts no suffix
                for first, second, total in (
                    (words.take(pa.array(known)), pa.nulls(len(known), pa.string()), n[known]),
                    (words.take(pa.array(keys // max(1, len(words)))), words.take(pa.array(keys % max(1, len(words)))), times),
                ):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), first, second, pa.array(total, pa.int64())], schema=schema)

    counted = texts.mapInArrow(count, "lang string, first string, second string, n long")
    return counted.groupBy("lang", "first", "second").agg(F.sum("n").alias("n"))


def quicksort(columns, weight, least: int):
    """(depth, pointer, count) of every partition of equal leading words that counts ``least`` or more.

    ``columns[d]`` has the word at depth d of each suffix, -1 where it has
    ended, ``weight`` how often the suffix occurs.  ``depth`` numbers the words
    of the partition, ``pointer`` is one of its suffixes.
    """
    import numpy as np

    order = np.arange(len(weight))
    found = []
    waiting = [(0, len(order), 0)] if len(order) else []
    while waiting:
        low, high, depth = waiting.pop()
        own = order[low:high]
        key = columns[depth][own]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        below, above = key < pivot, key > pivot
        same = own[~(below | above)]
        less, more = own[below], own[above]
        order[low : low + len(less)] = less
        order[high - len(more) : high] = more
        for part, start in ((less, low), (more, high - len(more))):
            if len(part) and weight[part].sum() >= least:
                waiting.append((start, start + len(part), depth))
        if pivot >= 0 and (count := int(weight[same].sum())) >= least:
            found.append((depth + 1, int(same[0]), count))
            if depth + 1 < len(columns):
                order[low + len(less) : high - len(more)] = same
                waiting.append((low + len(less), high - len(more), depth + 1))
    return found


def crowded(columns, weight, least: int):
    """Which suffixes may begin with a frequent pair of words: those whose bucket by a hash of the pair counts ``least``.

    A bucket that counts less is a partition that can be abandoned before it
    is sorted at all.
    """
    import numpy as np

    bucket = (columns[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ columns[1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)
    return (np.bincount(bucket.astype(np.int64), weights=weight) >= least)[bucket.astype(np.int64)]


def combined(columns):
    """(distinct columns, counts) of suffixes in the columns, which hold whole numbers from -1."""
    import numpy as np

    rank, span, widths = np.zeros(columns.shape[1], dtype=np.int64), 1, []
    for column in columns:
        width = int(column.max(initial=-1)) + 2
        if span * width >= 1 << 62:
            rank = np.unique(rank, return_inverse=True)[1]
            span, widths = len(rank), None
        rank = rank * width + column + 1
        span *= width
        if widths is not None:
            widths.append(width)
    if widths is None:
        _, first, counts = np.unique(rank, return_index=True, return_counts=True)
        return columns[:, first], counts
    values, counts = np.unique(rank, return_counts=True)
    out = []
    for width in reversed(widths):
        values, last = np.divmod(values, width)
        out.append(last - 1)
    return np.stack(out[::-1]), counts


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, batch_bytes: int = BATCH_BYTES, shard_words: int = SHARD_WORDS):
    """(words, phrases): (lang, word, n) of all words, and (lang, phrase, size, n) of those that occur ``least`` times.

    Phrases have 1 to ``longest`` words (at least 2), joined by blanks.
    """
    texts = texts_of(docs)
    counted = durable(count_words(texts, batch_bytes))
    words = counted.where("second IS NULL").select("lang", F.col("first").alias("word"), "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = -(-total // shard_words) or 1
    # at most 1 / HOT rows
    hot: dict[str, list] = {}
    for r in counted.where(F.col("second").isNotNull() & (F.col("n") >= max(HOT_COUNT, HOT * total))).collect():
        hot.setdefault(r["lang"], []).append((r["first"].encode(), r["second"].encode()))

    def deal(batches: Iterator) -> Iterator:
        import pickle

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("pair", pa.string()), ("n", pa.int64()), ("suffixes", pa.binary())])
        digest = xxhash.xxh64_intdigest
        hot_counts: Counter = Counter()

        def rows(shard, lang, pair, n, suffixes):
            return pa.RecordBatch.from_arrays([
                pa.array(shard, pa.int64()), pa.array([lang] * len(shard), pa.string()), pa.array(pair, pa.string()),
                pa.array(n, pa.int64()), pa.array(suffixes, pa.binary()),
            ], schema=schema)

        for found in gathered(batches, longest, batch_bytes):
            for lang, (dictionary, ids) in found.items():
                ids = ids[:, ids[1] >= 0]
                if not ids.shape[1]:
                    continue
                columns, counts = combined(ids)
                words = dictionary.to_pylist()
                code = np.array([digest(w) for w in words], dtype=np.uint64)
                mixed = (code[columns[0]] * np.uint64(0x9E3779B97F4A7C15)) ^ code[columns[1]] ^ np.uint64(digest(lang))
                pairs = hot.get(lang, [])
                is_hot = np.zeros(len(counts), dtype=bool)
                if pairs:
                    at = [pc.index_in(pa.array([p[k] for p in pairs], pa.large_binary()), dictionary).to_numpy(zero_copy_only=False) for k in (0, 1)]
                    here = np.flatnonzero(~np.isnan(at[0].astype(float)) & ~np.isnan(at[1].astype(float)))
                    keys = {int(at[0][k]) * len(words) + int(at[1][k]): pairs[k] for k in here}
                    key = columns[0] * len(words) + columns[1]
                    is_hot = np.isin(key, np.array(list(keys), dtype=np.int64))
                    known, inverse = np.unique(key[is_hot], return_inverse=True)
                    times = np.bincount(inverse, weights=counts[is_hot], minlength=len(known)).astype(np.int64)
                    for k, n in zip(known, times):
                        hot_counts[lang, b" ".join(keys[int(k)]).decode()] += int(n)
                    if longest > 2:
                        third = columns[2]
                        mixed = np.where(is_hot, mixed * np.uint64(31) ^ np.where(third >= 0, code[third], np.uint64(0)), mixed)
                    # a hot pair's own count is known; what has no third word tells nothing else
                    kept = ~is_hot | ((columns[2] >= 0) if longest > 2 else False)
                    columns, counts, mixed, is_hot = columns[:, kept], counts[kept], mixed[kept], is_hot[kept]
                # a hot suffix and a cold one never share a shard's row
                shard = (((mixed ^ (mixed >> np.uint64(32))) % np.uint64(shards)).astype(np.int64) << 1) | is_hot
                order = np.argsort(shard.astype(np.min_scalar_type(2 * shards)), kind="stable")
                edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
                numbers, made = [], []
                numbered, counts = (columns + 1).astype(np.int32)[:, order], counts[order]
                place = np.zeros(len(words) + 1, dtype=np.int32)
                for a, b in zip(edges, edges[1:]):
                    # the shard's words under numbers of its own, 0 for none
                    own = numbered[:, a:b]
                    used = np.sort(own, axis=None)
                    used = used[np.flatnonzero(np.diff(used, prepend=0))]
                    place[used] = np.arange(1, len(used) + 1)
                    text = b" ".join([words[k] for k in (used - 1).tolist()])
                    local, n = place[own].astype(np.min_scalar_type(len(used))), counts[a:b]
                    numbers.append(int(shard[order[a]]))
                    made.append(pickle.dumps((text, local, n.astype(np.min_scalar_type(int(n.max()))))))
                yield rows(numbers, lang, [None] * len(made), [None] * len(made), made)
        for (lang, pair), n in hot_counts.items():  # a row of a task and pair
            yield rows([-1 - digest(pair) % shards], lang, [pair], [n], [None])

    def sort(group):
        import pickle

        import numpy as np
        import pandas as pd
        import pyarrow as pa

        if group["shard"].iloc[0] < 0:
            counts = group.groupby(["lang", "pair"], as_index=False)["n"].sum().rename(columns={"pair": "phrase"})
            return counts.assign(size=2)[counts["n"] >= least][["lang", "phrase", "size", "n"]]
        out = []
        hot_rows = int(group["shard"].iloc[0]) & 1
        for lang, own in group.groupby("lang"):
            parts = [pickle.loads(s) for s in own["suffixes"]]
            listed = [text.split(b" ") for text, _, _ in parts]
            every = pa.array([w for words in listed for w in words], pa.binary()).dictionary_encode()
            number, at = every.indices.to_numpy().astype(np.int64), 0
            columns = []
            for words, (_, local, _) in zip(listed, parts):
                columns.append(np.concatenate(([-1], number[at : at + len(words)]))[local])
                at += len(words)
            columns = np.concatenate(columns, axis=1)
            weight = np.concatenate([n.astype(np.int64) for _, _, n in parts])
            names = every.dictionary.to_pylist()
            kept = crowded(columns, weight, least)
            columns, weight = columns[:, kept], weight[kept]
            for depth, pointer, count in quicksort(columns, weight, least):
                # a hot pair's suffixes are spread by their third word
                if depth > 1 + hot_rows:
                    out.append((lang, b" ".join([names[columns[d, pointer]] for d in range(depth)]).decode(), depth, count))
        return pd.DataFrame(out, columns=["lang", "phrase", "size", "n"])

    dealt = texts.mapInArrow(deal, "shard long, lang string, pair string, n long, suffixes binary")
    grown = dealt.groupBy("shard").applyInPandas(sort, "lang string, phrase string, size int, n long")
    single = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n").where(F.col("n") >= least)
    return words, durable(single.unionByName(grown))


def part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, absorbed: int = ABSORBED, **sizes: int,
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut
    with the lowest score, floor(1000000 * a * a / (l * r)), and ``n`` the
    words of the language.
    """
    words, phrases = frequent_phrases(docs, least, longest, **sizes)
    own = F.split("phrase", " ")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), own.alias("own"))
    # every part of a frequent phrase is frequent, so the joins find all
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", part(F.col("own"), F.lit(1), F.col("k"))).withColumn("right", part(F.col("own"), F.col("k") + 1, F.col("size")))
    count = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    exact = lambda name: f"CAST({name} AS DECIMAL(38,0))"
    scored = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"]).withColumn(
        "score", F.expr(f"(CAST(1000000 AS DECIMAL(38,0)) * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    )
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the largest count of a longer candidate around each phrase
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda w: F.transform(
        F.sequence(F.lit(1), F.col("size") - w + 1), lambda s: part(F.col("own"), s, w))))
    around = candidates.where("size > 2").select("lang", F.explode(spots).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
