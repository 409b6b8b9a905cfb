"""Operators on records: archives, chats, vectors, quality, licences, and the pipeline."""

import base64
import gzip
import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loupe.llm import chat, licenses, neighbours, packing, quality, queries, repeats, simhash, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


# archives

PAGES = "page_id long, url string, html string, payload string"


def pages():
    return [
        (1, "http://a/1", "<p>same</p>", "x"), (2, None, "<p>same</p>", "x"), (3, "http://a/3\r\nX: y", "é" * 5000, "x"), (4, "u", None, None),
        (5, "u", "", "x"), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "x"), (None, "u", "<p>same</p>", "x"), (None, None, "only", None),
        (7, "u", "<p>same</p>", "x"), (7, "u", "<p>same</p>", "x"),
    ]


@pytest.mark.parametrize("roll", [warc.ROLL_BYTES, 1])
def test_archives_round_trip(spark, roll):
    archives = warc.write_warc(spark.createDataFrame(pages(), PAGES), roll_bytes=roll)
    assert roll > 1 or archives.count() == len(pages())
    members = warc.normalise(archives)
    got = Counter()
    for r in warc.read_records(members).select("*", warc.page_of("record_id").alias("page"), warc.page_of("refers_to").alias("ref")).collect():
        got[r.page, r.record_type, r.ref, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload)] += 1
    latest = {}
    for page_id, _, html, _ in pages():
        latest[html or ""] = max((x for x in (latest.get(html or ""), page_id) if x is not None), default=None)
    want = Counter()
    for page_id, _, html, _ in pages():
        data, ref = (html or "").encode(), latest[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[(page_id, "response", None, digest, len(data), data) if page_id == ref else (page_id, "revisit", ref, digest, len(data), None)] += 1
    assert got == want
    for row in archives.collect():  # one stream each
        raw = open(row.path, "rb").read()
        stream = zlib.decompressobj(31)
        assert len(stream.decompress(raw)) == row.bytes and stream.eof and not stream.unused_data
    for row in members.collect():  # a member a record, found by the index
        raw = open(row.path, "rb").read()
        lines = [line.split() for line in open(row.index_path)]
        assert len(lines) == row.records
        for record_id, kind, offset, length in lines:
            record = gzip.decompress(raw[int(offset) : int(offset) + int(length)]).decode()
            assert f"WARC-Record-ID: {record_id}\r\n" in record and f"WARC-Type: {kind}\r\n" in record


def test_every_archive_has_a_task(spark):
    files = spark.createDataFrame([(f"/a/{k * k}.warc.gz",) for k in range(12)], "path string").coalesce(2)
    tasks = warc.one_task_each(files).groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in tasks] == [1] * 12
    assert warc.one_task_each(files.limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    rows = spark.createDataFrame(pages(), PAGES)
    kinds = warc.read_records(warc.normalise(warc.write_warc(rows, min_bytes=12))).groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in kinds} == {"response": len(pages())}


def test_truncated_archives_are_errors_and_none_is_fine(spark, tmp_path):
    record = warc.record_bytes(1, "u", "text", hashlib.sha1(b"text").hexdigest(), None)
    list(warc.split_records(iter([record, record[:9], record[9:]])))
    for cut in (len(record) - 1, 20):
        with pytest.raises(ValueError):
            list(warc.split_records(iter([record, record[:cut]])))
    empty = spark.createDataFrame([], PAGES)
    assert warc.read_records(warc.normalise(warc.write_warc(empty))).count() == 0


# chats

TURNS = "conv_id long, turn long, role string, text string, segment string"


def turns():
    nasty = "a <|end|> b <\\|end|> <<| <|start|>user<|text|> é😀 \\"
    return [
        (1, 0, "system", nasty, "s"), (1, 1, "user", " hi\n", None), (1, 2, "assistant", nasty, "s"), (1, 3, "assistant", "\n again ", "s"),
        (2, 0, "assistant", None, "s"), (2, 0, "assistant", "tie", "s"), (2, None, None, "first", "s"), (3, 0, "<|text|>", "", None),
        (None, 1, "assistant", "nobody's", "s"), (None, 0, "user", "q", "s"), (4, 0, "user", "u", "s"), (4, 0, "user", "u", "s"),
        (5, 0, "assistant", "long " * 20_000, "s"), (5, 1, "assistant", "<", "s"), (6, 0, "assistant", "|x", "s"),
    ]


@pytest.mark.parametrize("size", [chat.SEGMENT_CHARS, 1])
def test_chats_read_back(spark, size):
    segments = chat.format_chats(spark.createDataFrame(turns(), TURNS), PATH, segment_chars=size)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    by = {}
    for conv, turn, role, text, _ in turns():
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        learned = "".join(t for *_, role, t in rows if role == "assistant")
        row = got[conv]
        assert row.n_turns == len(rows)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in rows).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert row.formatted_chars == sum(len(chat.escape(r)) + len(chat.escape(t)) + len(chat.START + chat.TEXT + chat.END) for *_, r, t in rows)
    for r in segments.collect():
        assert all(chat.unescape(chat.escape(t)) == t for _, t in chat.parse(r.formatted))
        assert len(r.token_ids) == len(r.token_starts) == len(r.token_ends) == len(r.loss_mask)
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS), PATH)).count() == 0


def test_segments_encode_like_the_whole(spark):
    frame = spark.createDataFrame([r for r in turns() if r[0] == 1], TURNS)
    whole = chat.format_chats(frame, PATH).first()
    parts = chat.format_chats(frame, PATH, segment_chars=1).orderBy("segment").collect()
    assert len(parts) == 4 and "".join(p.formatted for p in parts) == whole.formatted
    assert [x for p in parts for x in p.token_ids] == whole.token_ids
    assert [x for p in parts for x in p.loss_mask] == whole.loss_mask


# vectors

VECTORS = "vec_id long, embedding array<float>, score double"


def exact(rows, asked, k):
    out = {}
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if i is not None and v and None not in v and len(v) == 6 and np.isfinite(v).all() and any(v)]
    for i, v in good:
        if asked(i):
            out[i] = sorted((-float(v @ w), j) for j, w in good if j != i)[:k]
    return out


def vector_rows():
    choose = np.random.default_rng(2)
    rows = [(i, (choose.normal(size=6) * choose.uniform(0.2, 3)).round(3).tolist()) for i in range(400)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(400, 500)]
    rows += [(500, None), (505, [0.0] * 6), (510, [float("nan")] * 6), (515, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (520, [1.0, 2.0]), (None, [1.0] * 6), (525, [None, 1.0, 1.0, 1.0, 1.0, 1.0])]
    return rows


@pytest.mark.parametrize("radius", [None, 0, neighbours.BITS])
def test_neighbours_against_brute_force(spark, radius):
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, 0.0) for i, v in rows], VECTORS)
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 5 == 0, k=10, radius=radius).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows, lambda i: i % 5 == 0, 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 11))
        hits += len({i for _, i, _ in found} & {j for _, j in want[q]})
        if radius is not None:  # nothing or everything is within it: both ways are exact
            assert [i for _, i, _ in found] == [j for _, j in want[q]]
            assert np.allclose([s for *_, s in found], [-s for s, _ in want[q]], atol=1e-12)
    assert hits >= 0.9 * 10 * len(want)


def test_neighbours_of_few_or_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(few, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5), (0, 2, 6), (5, 1, 0), (5, 2, 6)]
    assert neighbours.nearest(few.where("false"), F.lit(True)).count() == 0
    assert neighbours.nearest(few, F.lit(False)).count() == 0


def test_index_finds_every_code_within_the_radius():
    choose = np.random.default_rng(1)
    codes = choose.integers(0, 1 << 16, (600, 16), dtype=np.uint16)
    near = codes[:200] ^ (1 << choose.integers(0, 16, (200, 16))).astype(np.uint16) * (choose.random((200, 16)) < 0.4)
    codes = np.concatenate([codes, near.astype(np.uint16)])
    index = neighbours.Index(codes)
    for radius in (0, 3, 7, 16, 40, 100, 256):
        for code in codes[:20]:
            want = np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= radius)
            assert index.within(code, radius).tolist() == want.tolist()


def test_recall_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    matrix, ids = np.array(rows.embedding.tolist(), dtype=np.float64), rows.vec_id.to_numpy()
    found = queries.op5_neighbours(spark, folder).toPandas().groupby("query_id").vec_id.agg(set)
    hits = 0
    for q, own in found.items():
        scores = matrix @ matrix[ids == q][0]
        order = np.lexsort((ids, -scores))
        hits += len(own & set(ids[order[ids[order] != q][:20]].tolist()))
    assert hits >= 0.9 * 20 * len(found)


# quality


def test_scores_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op2_quality(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    rank, good = held.score.rank(), held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and (held.predicted == held.quality).mean() > 0.9


def test_statistics_and_models_of_little(spark):
    for text in ("", " ", "\n", "a", "A" * 100_000, "é😀\x00", "1 2 2 2"):
        assert len(quality.statistics(text)) == quality.N_STATISTICS and np.isfinite(quality.statistics(text)).all()
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, ""), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, None), (None, 1, "x"), (2, None, "x")], "doc_id long, quality int, text string")
    rows = quality.with_features(docs)
    assert {r.score for r in quality.scored(rows, quality.learn(rows, labels.where("false"))).collect()} == {0.5}
    scores = quality.scored(rows, quality.learn(rows, labels)).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)
    assert quality.scored(rows.where("false"), quality.learn(rows, labels)).count() == 0


def test_pooled_levels_rise():
    x, level = quality.pool([0, 1, 2, 3, 4], [1, 0, 0, 2, 2], [1, 1, 1, 2, 2])
    assert level == sorted(level) and x == sorted(x)


def test_normal_equations_sum_over_partitions(spark):
    choose = np.random.default_rng(0)
    data = choose.normal(size=(300, 3))
    frame = spark.createDataFrame([(row.tolist(), float(row[0] > 0)) for row in data], "features array<double>, y double").repartition(7)
    model = quality.Model(np.zeros(3), np.ones(3), choose.normal(size=(3, 100)), choose.uniform(0, 6, 100))
    gram, right = quality.normal_equations(frame, model)
    z = model.fourier(data)
    assert np.allclose(gram, z.T @ z) and np.allclose(right, z.T @ (data[:, 0] > 0))


# licences


def test_licences_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("LICENSE", mit, "r"), ("src/LICENSE.txt", f"{gpl}\n", "r"), ("src/a/b/main.c", "int main", "r"), ("doc/x.md", "text\n" + gpl.upper() + "\nmore", None),
        ("doc/y.md", None, "r"), ("z", "", "r"), (None, "no path", "r"), (None, mit, "r"), ("src/a/b/main.c", "int main", "r"), ("srcs/x", "text", "r"),
        ("doc/long", "word " * 50_000 + "\n" + mit, "r"),
    ]
    files = spark.createDataFrame(rows, "path string, text string, license string")
    got = licenses.scan(files.withColumnRenamed("license", "_row")).collect()
    assert len(got) == len(rows)
    by = {(r.path, r.origin): (r.license, r.directory) for r in got}
    assert by == {
        ("LICENSE", "own"): ("MIT", None), ("src/LICENSE.txt", "own"): ("GPL-3.0", None), ("src/a/b/main.c", "inherited"): ("GPL-3.0", "src"),
        ("doc/x.md", "own"): ("GPL-3.0", None), ("doc/y.md", "inherited"): ("MIT", ""), ("z", "inherited"): ("MIT", ""), (None, None): (None, None),
        (None, "own"): ("MIT", None), ("srcs/x", "inherited"): ("MIT", ""), ("doc/long", "own"): ("MIT", None),
    }
    assert licenses.scan(files.where("false")).count() == 0
    clash = licenses.scan(files.withColumnRenamed("license", "SCORE")).select("path", "SCORE", "score_")
    assert Counter(r.SCORE for r in clash.collect()) == Counter(r[2] for r in rows)


def test_a_licence_stays_with_its_row(spark):
    mit = "Released under the MIT License."
    files = spark.createDataFrame([(mit, None), (None, mit)], "path string, text string")
    assert {(r.path, r.license) for r in licenses.scan(files).collect()} == {(mit, None), (None, "MIT")}


def test_wrapped_notices_and_whole_licence_files(spark):
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
           "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    isc = ["Permission to use, copy, modify, and/or distribute", "this software for any purpose with or without fee", "is hereby granted, provided that"]
    counts = dict(licenses.whole_texts())
    whole = lambda name: "\n".join(f"{w} " * n for w, n in counts[name].items())
    rows = [
        ("a/gpl.c", "/*\n * " + "\n *\n * ".join(gpl) + "\n */\nint main() {}"), ("a/isc.c", "\n".join(f"// {x}" for x in isc) + "\nint f;"),
        ("a/narrow", "\n".join(" ".join(gpl).split())), ("a/part", "\n".join(gpl[:1]) + "\nbut nothing more is said here"),
        ("b/COPYING", whole("GPL-3.0")), ("b/x.c", "int x;"), ("c/LICENSE", whole("LGPL-2.1")), ("d/LICENSE", whole("MPL-2.0")), ("d/e/LICENSE", "all rights reserved"),
        ("f/copying.c", whole("GPL-3.0")),
    ]
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "a/gpl.c": ("GPL-3.0", "own"), "a/isc.c": ("ISC", "own"), "a/narrow": ("GPL-3.0", "own"), "a/part": (None, None), "b/COPYING": ("GPL-3.0", "own"),
        "b/x.c": ("GPL-3.0", "inherited"), "c/LICENSE": ("LGPL-2.1", "own"), "d/LICENSE": ("MPL-2.0", "own"), "d/e/LICENSE": ("MPL-2.0", "inherited"), "f/copying.c": ("GPL-3.0", "own"),
    }


def test_anchors_can_not_be_missed():
    weights = [{"a": 0.8, "b": 0.6}, {"c": 0.5, "d": 0.5, "e": 0.5, "f": 0.5}]
    chosen = set(licenses.anchors(weights, 0.8))
    for vector in weights:
        assert sum(w * w for word, w in vector.items() if word not in chosen) < 0.8**2


# the pipeline


def test_stages_on_the_small_tables(spark):
    read = lambda: spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, kept = read(), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        kept.append(rows)
        if name != "best-fit packing":
            assert out.columns == read().columns
            docs = spark.createDataFrame(rows, out.schema)
    first, second, third, mixed, packed = kept
    source = {r.doc_id: r for r in read().collect()}

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(source[r.doc_id] == r for r in first)
    gone = set(source) - {r.doc_id for r in first}
    assert sum(labels.get(i, 0) == 1 for i in gone) <= 0.02 * sum(q == 1 for q in labels.values())

    marks = {r.doc_id: simhash.simhash(r.text) for r in first}
    ids = sorted(marks)
    seen, least = set(), []
    for i in ids:  # the smallest of every connected group
        if i in seen:
            continue
        least.append(i)
        waiting = [i]
        while waiting:
            a = waiting.pop()
            seen.add(a)
            waiting += [b for b in ids if b not in seen and (marks[a] ^ marks[b]).bit_count() <= 4]
    assert sorted(r.doc_id for r in second) == least

    windows = set()
    cut = {r.doc_id: r for r in third}
    for r in sorted(second, key=lambda r: r.doc_id):
        data = r.text.encode()
        cover = bytearray(len(data))
        for p in range(len(data) - repeats.LENGTH + 1):
            window = data[p : p + repeats.LENGTH]
            if window in windows:
                cover[p : p + repeats.LENGTH] = b"\1" * repeats.LENGTH
            windows.add(window)
        left = bytes(b for b, c in zip(data, cover) if not c).decode(errors="ignore")
        assert cut[r.doc_id].text == left and cut[r.doc_id].n_chars == len(left)

    counts = Counter(r.doc_id for r in mixed)
    assert max(counts.values()) <= 3 and all(cut[r.doc_id] == r for r in mixed)
    words = lambda r: len([w for w in r.text.encode().split()])
    total = sum(map(words, third))
    assert 0.95 * total <= sum(map(words, mixed)) <= total

    encode = packing.text_encoder(PATH)
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.piece, bytes(r.ids)))
    for i, n in counts.items():
        own = sorted(pieces[i])
        assert b"".join(x for _, x in own[::n]) == encode(cut[i].text) + b"\0\0\0\0"
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.CAPACITY
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
