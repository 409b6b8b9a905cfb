"""Operators that search texts: benchmark passages, collocations, ranked documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loupe.llm import collocations, decontaminate, lexical

DOCS = "doc_id long, text string, lang string, _row int, found string"


def prose(seed, n, words="the an of to in it is on at by re ha é ñ 7".split()):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", ".\n", "-"]) for _ in range(n))


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def leaks(text, items, window):
    """(words, hit words, names) by comparing every place with every window."""
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        size = min(window, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1) if own else ():
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                names |= set() if name is None else {name}
    return len(words), len(hit), sorted(names)


ITEMS = [
    ("b1", prose(1, 40)), ("b2", prose(2, 12)), ("b3", "The end."), ("b4", None), ("b5", ""), (None, prose(3, 20)), ("b1", prose(4, 15)),
    ("b6", prose(1, 40)), ("b7", "é é é é é é é é é é é é é"), ("b8", "end of the"), ("b9", "--- !!!"), ("b10", prose(5, 3000)),
]


def leaky():
    rows = [
        (1, prose(9, 30) + " " + prose(1, 40) + " " + prose(10, 30)), (2, "".join(c.upper() if c.isascii() else c for c in prose(2, 12))), (3, "at the END of the day"), (4, None), (5, ""),
        (6, "é " * 50), (7, prose(11, 4000) + prose(3, 20)), (8, "\n".join(prose(5, 3000).split()[100:2000])), (9, " ".join(prose(1, 40).split()[5:14])),
        (None, prose(4, 15)), (9, prose(12, 60)), (9, prose(12, 60)), (10, "the end the end the end"), (11, "x" * 3_000_000 + " the end " + "y z " * 700_000),
    ]
    return [(i, t, "en", k, "kept") for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("block_words, pass_blocks", [(1 << 18, 8), (500, 2)])
def test_leaks_match_brute_force(spark, block_words, pass_blocks):
    docs = spark.createDataFrame(leaky(), DOCS)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = decontaminate.scan(docs, items, block_words=block_words, pass_blocks=pass_blocks).collect()
    assert len(found) == len(leaky())
    for row in found:
        f = row["found_"]
        assert (f["n_words"], f["n_hit"], f["items"]) == leaks(row["text"], ITEMS, 10), row["_row"]
        data = (row["text"] or "").encode()
        for a, b, x, y in zip(f["starts"], f["ends"], f["byte_starts"], f["byte_ends"]):
            assert len(plain_words(data[x:y].decode())) == b - a
        assert row["found"] == "kept"


def test_random_leaks_match_brute_force():
    rng = random.Random(5)
    for seed in range(60):
        items = [(str(k), prose(rng.random(), rng.randint(0, 14), "a b c".split())) for k in range(8)]
        made = decontaminate.Automaton([(n, [w.encode() for w in plain_words(t)]) for n, t in items], window=4)
        text = prose(seed, 80, "a b c d".split())
        n, spans, names = made.scan(text)
        assert (n, sum(b - a for a, b in spans), sorted(names)) == leaks(text, items, 4)


def test_decontaminated_texts_lose_only_what_is_hit(spark):
    docs = spark.createDataFrame(leaky(), DOCS)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    kept = {r["_row"]: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert kept[0]["text"].startswith(prose(9, 29)) and prose(1, 40)[:-1] not in kept[0]["text"]
    assert 1 not in kept and 7 not in kept and kept[3]["text"] is None and kept[10]["text"] == prose(12, 60)
    assert decontaminate.decontaminate(docs, items).columns == docs.columns
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(leaky())
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


# collocations


def plain_collocations(rows, least, longest, top):
    """{lang: rows in order} by counting every phrase in a table."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, *words[k : k + size]) for k in range(len(words) - size + 1))
    out = {}
    for key, a in counts.items():
        lang, own = key[0], key[1:]
        if len(own) < 2 or a < least:
            continue
        score, k = min((10**6 * a * a // (counts[key[: k + 1]] * counts[(lang, *own[k:])]), k) for k in range(1, len(own)))
        inside = [f for other, f in counts.items() if f >= least and other[0] == lang and len(other) > len(key)
                  and any(other[s : s + len(own)] == own for s in range(1, len(other)))]
        if not any(100 * f >= 50 * a for f in inside):
            phrase = " ".join(own)
            out.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, counts[key[: k + 1]], counts[(lang, *own[k:])], total[lang], score))
    return {lang: [(rank, *r[3:]) for rank, r in enumerate(sorted(rows)[:top], 1)] for lang, rows in out.items()}


def chatter():
    rows = [(None if k % 7 == 0 else ["en", "fr", "und"][k % 3], prose(k, 300, "a b c dé the of é x|y \"q\" Of THE".split()) + (" hot pair" * 40 if k % 2 else "")) for k in range(12)]
    # one piece longer than a batch, a text of one word, blanks of every kind, repeated rows
    rows += [("fr", "a b c " * 2500), ("en", "z" * 40_000), ("en", " \t \n\r\x0b\x0c . "), ("en", None), ("en", ""), (None, None)]
    return rows + [("de", "eins zwei drei vier")] * 10


@pytest.mark.parametrize("longest, batch_bytes, shard_words", [(3, 1 << 23, 1 << 19), (3, 700, 60), (4, 2000, 500), (2, 700, 60)])
def test_collocations_match_brute_force(spark, longest, batch_bytes, shard_words):
    rows = chatter()
    docs = spark.createDataFrame([(k, t, lang, "x") for k, (lang, t) in enumerate(rows)], "a long, text string, lang string, phrase string").repartition(3)
    found = collocations.collocations(docs, least=10, longest=longest, top=50, batch_bytes=batch_bytes, shard_words=shard_words).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["rank"])):
        got.setdefault(r["lang"], []).append((r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
    assert got == plain_collocations(rows, 10, longest, 50)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_quicksort_counts_equal_partitions():
    rng = np.random.default_rng(3)
    columns = rng.integers(-1, 6, (3, 400))
    columns[2, columns[1] < 0] = -1
    weight = rng.integers(1, 4, 400)
    counts = Counter()
    for row, n in zip(columns.T.tolist(), weight.tolist()):
        for depth in range(1, 4):
            if row[depth - 1] >= 0:
                counts[tuple(row[:depth])] += n
    for least in (1, 5, 40):
        found = {tuple(columns[:depth, p].tolist()): n for depth, p, n in collocations.quicksort(columns, weight, least)}
        assert found == {k: n for k, n in counts.items() if n >= least and -1 not in k}


# ranked documents


def plain_ranking(docs, items, top):
    """[(item_id, [(doc_id, score)...])] per distinct item row, by scoring every document."""
    terms = [Counter(plain_words(t)) for _, t in docs]
    sizes = [sum(t.values()) for t in terms]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for own in terms for t in own)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for (doc_id, _), own, n in zip(docs, terms, sizes):
            if n:
                m = 100 - 90 + (90 * n * n_docs) // total
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * own[t]) // (1000 * own[t] + 8 * m))
                    for t in set(plain_words(text)) if t in own
                )
                if score > 0:
                    scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        if scored:
            out.append((item_id, [(d, -s) for s, _, _, d in sorted(scored)[:top]]))
    return out


def library():
    words = [f"w{k}" for k in range(60)] + ["the", "of"] * 10
    rows = [(k, prose(k, 5 + k % 90, words)) for k in range(400)]
    rows += [(1000 + k, prose(7, 40, words)) for k in range(60)] + [(5, prose(5, 10, words))] * 3  # copies of a text, repeated rows
    rows += [(None, prose(8, 30, words)), (None, prose(8, 30, words)), (2000, None), (2001, ""), (2002, " -- "), (2003, "W1 é w2É " * 30_000)]
    return rows


def searched():
    words = [f"w{k}" for k in range(60)] + ["the", "of"] * 10
    items = [(k, prose(100 + k, 12, words)) for k in range(12)] + [(3, "w1 w1 W1"), (3, "w1 w1 W1"), (None, "é of w3"), (50, None), (51, ""), (52, "nowhere")]
    return items + [(53, prose(7, 40, words))]


@pytest.mark.parametrize("block_terms", [1 << 18, 40])
def test_ranking_matches_brute_force(spark, block_terms):
    docs = spark.createDataFrame([(i, t, "x") for i, t in library()], "doc_id long, text string, score string").repartition(3)
    items = spark.createDataFrame([(i, t, "x") for i, t in searched()], "item_id long, text string, doc_id string")
    found = lexical.search(docs, items, block_terms=block_terms).collect()
    lists, seen = [], {}
    for r in sorted(found, key=lambda r: (str(r["item_id"]), r["rank"])):
        seen.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for item_id, want in plain_ranking(library(), searched(), 10):
        lists.append((item_id, [(k, d, s) for k, (d, s) in enumerate(want, 1)]))
    assert {i: sorted(r) for i, r in seen.items()} == {i: sorted(x for j, r in lists if j == i for x in r) for i, _ in lists}
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_text_ids_are_ranked(spark):
    docs = spark.createDataFrame([("b", "red fish"), ("a", "red fish"), (None, "red fish"), ("c", "blue")], "doc_id string, text string")
    found = lexical.search(docs, spark.createDataFrame([("i", "Red!")], "item_id string, text string")).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == ["a", "b", None]


def test_tree_search_over_several_trees_is_exact(monkeypatch):
    rng = np.random.default_rng(4)
    weights = rng.integers(0, 3000, 50)
    docs = []
    for i in range(900):
        ranks = np.flatnonzero(rng.random(50) < 8 / (8 + np.arange(50)))
        if len(ranks):
            docs.append((i, int(rng.integers(20, 300)), ranks, rng.integers(1, 4, len(ranks))))
    monkeypatch.setattr(lexical, "LEAF_DOCS", 2)
    for wanted in (range(0, 50, 7), [0], [49, 48], range(50)):
        own = np.where(np.isin(np.arange(50), list(wanted)), weights, 0)
        best = []
        for k in range(0, len(docs), 250):
            best = lexical.Tree(docs[k : k + 250]).search(own, best, 10)
        scores = sorted((-int((own[r] * lexical.saturated(tf, m)).sum()), i) for i, m, r, tf in docs)
        assert [(s, i) for s, _, i in best] == [x for x in scores if x[0] < 0][:10]
