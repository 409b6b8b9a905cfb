"""Chat formatting with offset-aligned loss masks.

Whole conversations are rendered with a template, encoded once with offsets,
and the sorted spans of the learned turns are cut with the tokens' spans by
binary search.

Template, per turn: ``<|start|>role<|text|>text<|end|>``.  The three markers
are added to the tokenizer as special tokens, so no token ever reaches over a
marker.  That also makes it sound to encode a long conversation in segments of
whole turns: the tokens are those of the whole, memory stays bounded by one
segment, and a conversation that holds a third of all rows streams through its
task.  Inside roles and texts every ``<`` that could open a control string,
here ``<``, any number of ``\\`` and ``|``, gets one ``\\`` more; reading back
takes it off.

Defined results: NULL role and text are empty; turns of equal number go by
role, then text, and repeated rows are repeated turns; a NULL turn comes
first; NULL conv_id is a conversation of its own; no rows give no segments.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from loupe.frames import require

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: characters after which a segment ends with its turn
SEGMENT_CHARS = 1 << 20

SEGMENTS = (
    "conv_id long, segment int, first_turn long, n_turns int, formatted string, token_ids array<int>, "
    "token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
)


def escape(text: str) -> str:
    import re

    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    import re

    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], learned: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the learned turns' texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{TEXT}", escape(text)
        if role == learned and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def masked(spans: list[tuple[int, int]], starts, ends):
    """For each token whether it touches a span.

    The spans are sorted and apart: the only one that a token can start in or
    before is the first that ends behind the token's start.
    """
    import numpy as np

    if not spans:
        return np.zeros(len(starts), dtype=bool)
    first, last = np.array(spans, dtype=np.int64).T
    at = np.searchsorted(last, starts, side="right")
    inside = at < len(last)
    at = np.minimum(at, len(last) - 1)
    return inside & (first[at] < ends) & (ends > starts)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def learned_texts(formatted: str, starts, ends, mask) -> list[str]:
    """The texts under the mask: one for each run of characters."""
    runs: list[list[int]] = []
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return [unescape(formatted[a:b]) for a, b in runs]


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text): conversations together, their turns sorted."""
    require(conversations, "conv_id", "turn", "role", "text")
    empty = F.lit("")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(
    conversations: DataFrame, tokenizer_path: str, learned: str = "assistant", segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """A row per conversation, or per segment of a very long one, in order.

    Offsets count the characters of ``formatted``; ``loss_mask`` is true for
    the tokens of the ``learned`` role's texts.
    """

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        from tokenizers import AddedToken, Tokenizer, processors

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (START, TEXT, END)])
        names = [f.split(" ")[0] for f in SEGMENTS.split(", ")]

        def rows(segments):
            drawn = [render(turns, learned) for *_, turns in segments]
            out = []
            for (conv, k, first, turns), (text, spans), code in zip(segments, drawn, tokenizer.encode_batch([t for t, _ in drawn], add_special_tokens=False)):
                offsets = np.array(code.offsets, dtype=np.int64).reshape(-1, 2)
                starts, ends = offsets[:, 0], offsets[:, 1]
                out.append((conv, k, first, len(turns), text, np.array(code.ids, dtype=np.int32), starts.astype(np.int32), ends.astype(np.int32), masked(spans, starts, ends)))
            frame = pd.DataFrame(out, columns=names)
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            return frame

        here, part, first, turns, chars = None, 0, 0, [], 0
        ready, held = [], 0

        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["conv_id"]]
            for conv, role, text in zip(ids, batch["role"], batch["text"]):
                if turns and (conv != here or chars >= segment_chars):
                    ready.append((here, part, first, turns))
                    held += chars
                    part, first = (part + 1, first + len(turns)) if conv == here else (0, 0)
                    turns, chars = [], 0
                    if held >= segment_chars:
                        yield rows(ready)
                        ready, held = [], 0
                here = conv
                turns.append((role, text))
                chars += len(role) + len(text)
        if turns:
            ready.append((here, part, first, turns))
        if ready:
            yield rows(ready)

    return in_order(conversations).mapInPandas(encode, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted texts and masks say, a row per conversation.

    Takes :func:`format_chats`' rows as they come: a conversation's segments
    follow each other in one partition.
    """

    def digest(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pandas as pd

        here, state, any_row = None, None, False

        def row():
            return (here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            out = []
            ids = [None if pd.isna(x) else int(x) for x in batch["conv_id"]]
            for conv, k, text, starts, ends, mask in zip(ids, batch["segment"], batch["formatted"], batch["token_starts"], batch["token_ends"], batch["loss_mask"]):
                if not any_row or k == 0:
                    if any_row:
                        out.append(row())
                    here, state, any_row = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for body in learned_texts(text, np.asarray(starts), np.asarray(ends), np.asarray(mask, dtype=bool)):
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
            yield frame(out)
        if any_row:
            yield frame([row()])

    def frame(rows):
        import pandas as pd

        made = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in DIGESTS.split(", ")])
        made["conv_id"] = made["conv_id"].astype("Int64")
        return made

    return segments.mapInPandas(digest, DIGESTS)
