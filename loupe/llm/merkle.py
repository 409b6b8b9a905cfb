"""Document fingerprints: Merkle trees over sections and paragraphs.

A text falls into leaves of a few words, leaves form paragraphs (lines) and
paragraphs form sections.  All borders are found by content: a leaf ends with a
line, a sentence, or after a word whose last character says so (its number is 1
modulo 4), a section at an empty line or after a paragraph whose digest says
so.  So an edit moves no border but those beside it, in texts of every length.
Stretches without blanks are cut by character in the same way.  Leaves cover every character; a node's digest is
that of its children's digests, so equal roots mean equal texts.

A fingerprint is one string, ``root|section/section...`` with
``section = digest:paragraph;paragraph...``, ``paragraph = digest=leaf,leaf...``
and ``leaf = digest`` (8 digits) and its length in characters (hexadecimal).
Two fingerprints are compared from the top: equal branches count whole, only
differing ones are opened, down to the leaves that hold the edits.

Defined results: NULL is the empty text, whose likeness to an empty one is 1
and to any other 0; doc_ids are whole numbers, others raise; documents
of equal doc_id go by their text's hash; a NULL doc_id comes after all others;
the only document's next one is itself; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

from pyspark.sql import DataFrame, Window as W, functions as F

from loupe.frames import require
from loupe.llm.rows import fresh, text_of

#: up to 15 words that end no leaf and then any word, with the blanks behind; or the part of a long word up to a
#: character that cuts it.  What ends or cuts hangs on a character's number alone, so borders move with the text.
def numbered(modulus: int) -> str:
    return "".join(re.escape(chr(n)) for n in range(0x21, 0x2000) if n % modulus == 1)


ENDS, CUTS = numbered(4) + ".!?", numbered(16)
LEAF = rf"(?:\S{{1,32}}+(?<![{ENDS}])(?!\S)[^\S\n]+){{0,15}}(?:\S{{1,32}}+(?!\S)|[^\s{CUTS}]{{0,62}}\S)[^\S\n]*\n*|\s+"
#: one in so many paragraphs ends a section
SECTION = 8


def node(digests: list[bytes]) -> bytes:
    return blake2b(b"".join(digests), digest_size=16).digest()


def digest_of(text: str) -> bytes:
    return blake2b(text.encode(), digest_size=16).digest()


def leaves(text: str) -> list[str]:
    """The leaves in order."""
    return re.findall(LEAF, text)


def fingerprint(text: str) -> str:
    sections: list[tuple[bytes, str]] = []
    paragraphs: list[tuple[bytes, str]] = []
    digests: list[bytes] = []
    names: list[str] = []

    def end_paragraph(blank: bool) -> None:
        digest = node(digests)
        paragraphs.append((digest, f"{digest[:4].hex()}={','.join(names)}"))
        digests.clear()
        names.clear()
        if blank or digest[4] % SECTION == 0:
            end_section()

    def end_section() -> None:
        digest = node([d for d, _ in paragraphs])
        sections.append((digest, f"{digest[:4].hex()}:{';'.join(s for _, s in paragraphs)}"))
        paragraphs.clear()

    for leaf in leaves(text):
        digest = digest_of(leaf)
        digests.append(digest)
        names.append(f"{digest[:4].hex()}{len(leaf):x}")
        if leaf[-1] == "\n":
            end_paragraph(leaf.endswith("\n\n"))
    if digests:
        end_paragraph(False)
    if paragraphs:
        end_section()
    return f"{node([d for d, _ in sections]).hex()}|{'/'.join(s for _, s in sections)}"


def branches(fingerprint: str) -> list[str]:
    body = fingerprint.partition("|")[2]
    return body.split("/") if body else []


def paragraphs_of(section: str) -> list[str]:
    return section.partition(":")[2].split(";")


def leaves_of(paragraph: str) -> list[str]:
    return paragraph.partition("=")[2].split(",")


def differing(a: str, b: str) -> tuple[list[str], list[str]]:
    """The leaves of either fingerprint that the other lacks."""
    left, right = branches(a), branches(b)
    for opened in (paragraphs_of, leaves_of, None):
        common = Counter(left) & Counter(right)
        left, right = without(left, common), without(right, common)
        if opened:
            left = [x for branch in left for x in opened(branch)]
            right = [x for branch in right for x in opened(branch)]
    return left, right


def without(items: list[str], common: Counter) -> list[str]:
    if not common:
        return items
    spare = dict(common)
    kept = []
    for x in items:
        if spare.get(x):
            spare[x] -= 1
        else:
            kept.append(x)
    return kept


def characters(leaves: list[str]) -> int:
    return sum(int(x[8:], 16) for x in leaves)


def likeness(a: str, n_a: int, b: str, n_b: int) -> float:
    """The share of both texts' characters that lie in common leaves."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    left, right = differing(a, b)
    return 1.0 - (characters(left) + characters(right)) / (n_a + n_b)


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Character spans of a's text, joined, whose leaves b lacks."""
    missing = Counter(differing(a, b)[0])
    spans: list[tuple[int, int]] = []
    at = 0
    for section in branches(a):
        for paragraph in paragraphs_of(section):
            for leaf in leaves_of(paragraph):
                n = int(leaf[8:], 16)
                if missing[leaf] > 0:
                    missing[leaf] -= 1
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], at + n)
                    else:
                        spans.append((at, at + n))
                at += n
    return spans


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every text, as ``name`` or, where a column has it, with ``_`` behind."""

    @F.pandas_udf("string")
    def of(texts):  # noqa: ANN001
        return texts.map(fingerprint)

    return docs.withColumn(fresh(docs, name), of(text_of()))


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, follower, doc_id, text): documents by descending doc_id.

    Buckets are ranges of doc_id and sorted within; each ends with one
    ``follower``, a copy of the row that comes next, which is the first row of
    the next bucket or, in the last, of all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / n for k in range(1, n)]
    edges = rows.agg(F.percentile_approx("doc_id", shares, 100 * n)).first()[0] or []

    @F.pandas_udf("int")
    def bucket_of(ids):  # noqa: ANN001
        import numpy as np
        import pandas as pd

        known = ids.notna().to_numpy()
        at = np.searchsorted(np.array(edges, dtype=np.int64), ids.fillna(0).to_numpy(dtype=np.int64), side="left")
        return pd.Series(np.where(known, n - 1 - at, n).astype(np.int32))

    bucketed = rows.withColumn("bucket", bucket_of("doc_id")).withColumn("tie", F.xxhash64("text"))
    # one row a bucket: its first document's text, found by key
    tops = bucketed.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    top = bucketed.join(F.broadcast(tops), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top")))
    head = top.groupBy("bucket").agg(F.min("tie").alias("tie"), F.first("top").alias("doc_id"))
    order = W.orderBy("bucket")
    last = F.max("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = head.withColumn("goes_to", F.coalesce(F.lag("bucket").over(order), last))
    heads = heads.select("goes_to", F.struct("bucket", "doc_id", "tie").alias("head"))
    first = (
        bucketed.join(F.broadcast(heads), F.struct("bucket", "doc_id", "tie").eqNullSafe(F.col("head")))
        .select(F.col("goes_to").alias("bucket"), F.lit(True).alias("follower"), "doc_id", "text", "tie")
        .dropDuplicates(["bucket"])
    )
    everything = bucketed.select("bucket", F.lit(False).alias("follower"), "doc_id", "text", "tie").unionByName(first)
    return everything.repartition("bucket").sortWithinPartitions("bucket", "follower", F.col("doc_id").desc_nulls_last(), "tie").select(
        "bucket", "follower", "doc_id", "text"
    )


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_edits(docs: DataFrame, part: int = 3) -> DataFrame:
    """Every document beside its edited text and the next document.

    The edited text has its last ``1/part`` replaced by as many first
    characters of the next document, or all of them.
    """

    def compare(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        names = [f.split(" ")[0] for f in EDITED.split(", ")]
        here = None  # (doc_id, text, fingerprint) that waits for its next one
        out, held = [], 0
        for batch in batches:
            for follower, doc_id, text in zip(batch["follower"], batch["doc_id"].astype("Int64"), batch["text"]):
                mark = fingerprint(text)
                if here is not None:
                    own_id, own, own_mark = here
                    n = len(own)
                    cut = n // part
                    edited = own[: n - cut] + text[:cut]
                    edited_mark = fingerprint(edited)
                    out.append((
                        own_id, n, hashlib.sha256(edited.encode()).hexdigest(), own_mark, edited_mark,
                        likeness(own_mark, n, edited_mark, len(edited)), likeness(own_mark, n, mark, len(text)),
                    ))
                    held += len(own_mark) + len(edited_mark)
                here = None if follower else (doc_id, text, mark)
                if held > 8 << 20:
                    yield frame(out, names)
                    out, held = [], 0
        yield frame(out, names)

    def frame(rows, names):
        import pandas as pd

        made = pd.DataFrame(rows, columns=names)
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made

    return beside_next(docs).mapInPandas(compare, EDITED)
