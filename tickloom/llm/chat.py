"""Chat formatting by token-level assembly.

Each segment (a role, a text) is encoded on its own; the turn marks are reserved ids above the vocabulary that no
text can produce, spliced between the segments. The loss mask comes from prefix sums over segment lengths. Control
strings inside a text are escaped reversibly, so the rendered text of a conversation cannot be mistaken either.

Encoding, and reading a turn back from its ids and mask, are maps over rows before any shuffle. Only then are the turns
of a conversation brought together, in order, for what follows from the order alone: offsets of chunks, and digests of
what was read. Either is a stream: a task holds running sums and digests, never a whole conversation, so a conversation
with a third of all rows needs no more memory than a short one (its digest is one task's work by definition).

Defined results: a null text or role counts as empty; rows of one conversation are taken by turn, equal turns by
role and then text (by code points), null turns first; a null conv_id is a conversation of its own; repeated rows are
repeated turns; very long texts are encoded alone, in memory of some times their size; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The marks of the template; their ids follow the vocabulary in this order.
MARKS = ("<|turn|>", "<|text|>", "<|over|>")
#: Control strings that no text may carry unescaped: those of the template and of other common templates.
CONTROL = (*MARKS, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<|user|>", "<|assistant|>", "<|system|>", "<<SYS>>", "<</SYS>>", "[/INST]", "[INST]", "</s>", "<s>", "<unk>", "<pad>")
#: The escape sign: in a text it becomes E0; E1 goes behind the first character of a control string.
E = "␛"
#: Rows, and characters, that are encoded or decoded at once: the tokenizer's own objects are many times the text.
ROWS, CHARS = 256, 500_000
_ESCAPE = re.compile("|".join([E, *map(re.escape, sorted(CONTROL, key=len, reverse=True))]))
_UNESCAPE = re.compile(f"{E}([01])")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{E}0" if m[0] == E else f"{m[0][0]}{E}1{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: E if m[1] == "0" else "", text)


@lru_cache(maxsize=2)
def coder(path: str):
    """The tokenizer (its special strings are ordinary text here) and the ids of the marks."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t, {m: t.get_vocab_size() + i for i, m in enumerate(MARKS)}


def slices(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows with at most ROWS rows and about CHARS characters."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= ROWS or total + n > CHARS):
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def encoder(path: str, loss_roles: tuple[str, ...]):
    """Rows of conversations to the columns of `encode_rows`, as a function of batches."""

    def run(batches):
        tok, mark = coder(path)
        for pdf in batches:
            for part in slices([len(x) if isinstance(x, str) else 0 for x in pdf["text"]]):
                out = pdf.iloc[part][["conv_id", "turn"]].copy()
                roles, texts = ([x if isinstance(x, str) else "" for x in pdf[c].iloc[part]] for c in ("role", "text"))
                ids = [np.array(e.ids, np.int32) for e in tok.encode_batch([escape(x) for x in (*roles, *texts)], add_special_tokens=False)]
                head = [np.r_[mark[MARKS[0]], r, mark[MARKS[1]]].astype(np.int32) for r in ids[: len(roles)]]
                body = ids[len(roles) :]
                out["role"], out["text"] = roles, texts
                out["ids"] = [np.r_[h, t, mark[MARKS[2]]].astype(np.int32) for h, t in zip(head, body, strict=True)]
                out["text_from"] = [len(h) for h in head]
                out["text_to"] = out["text_from"] + [len(t) for t in body]
                out["in_loss"] = [r in loss_roles for r in roles]
                yield out

    return run


def encode_rows(rows: DataFrame, path: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per row of a conversation: its ids with the marks spliced in, and where its text starts and ends in them.

    conv_id, turn, role, text (sorting keys), ids array<int>, text_from int, text_to int, in_loss boolean.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids array<int>, text_from int, text_to int, in_loss boolean"
    return rows.select("conv_id", "turn", "role", "text").mapInPandas(encoder(path, loss_roles), schema)


def in_order(encoded: DataFrame) -> DataFrame:
    """The turns of a conversation in one partition, in order."""
    return encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


CHUNKS = "seq long, start long, ids array<int>, mask array<boolean>"


def assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ordered rows as chunks with their offsets and masks; only the running offset is kept between rows."""
    now, seq, start = None, 0, 0
    for pdf in batches:
        out = []
        for conv, ids, a, b, loss in zip(pdf["conv_id"].astype(object), pdf["ids"], pdf["text_from"], pdf["text_to"], pdf["in_loss"], strict=True):
            conv = None if pd.isna(conv) else conv
            if (conv,) != now:
                now, seq, start = (conv,), 0, 0
            out.append((conv, seq, start, ids, mask_of(len(ids), [(a, b)] if loss else [])))
            seq, start = seq + 1, start + len(ids)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "start", "ids", "mask"])


def assemble(encoded: DataFrame) -> DataFrame:
    """The formatted conversations as chunks, one for each turn: conv_id, seq, start (the offset of its first token in
    the conversation, a prefix sum), ids and the loss mask over ids."""
    return in_order(encoded).mapInPandas(assembled, f"conv_id {encoded.schema['conv_id'].dataType.simpleString()}, {CHUNKS}")


def mask_of(size: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """The mask that is true inside the spans: the prefix sum of +1 at each start and -1 at each end."""
    step = np.zeros(size + 1, np.int32)
    for a, b in spans:
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step[:-1]) > 0


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
SAID = ["conv_id", "turn", "role", "text", "loss", "chars", "tokens"]


def listener(path: str):
    """What turns say, read from their ids and masks alone, as a function of batches of chunks: role, text, loss (the
    text under the mask; null where that is the whole text), chars (code points as rendered), tokens."""

    def run(batches):
        tok, mark = coder(path)
        first, mid, last = (mark[m] for m in MARKS)
        marks = sum(map(len, MARKS))
        decode = lambda batch: tok.decode_batch(batch, skip_special_tokens=False)
        for pdf in batches:
            for part in slices([4 * len(x) for x in pdf["ids"]]):
                ids = [np.asarray(x) for x in pdf["ids"].iloc[part]]
                masks = [np.asarray(x, bool) for x in pdf["mask"].iloc[part]]
                assert all(x[0] == first and x[-1] == last for x in ids)
                cut = [int(np.flatnonzero(x == mid)[0]) for x in ids]
                roles = decode([x[1:c].tolist() for x, c in zip(ids, cut, strict=True)])
                texts = decode([x[c + 1 : -1].tolist() for x, c in zip(ids, cut, strict=True)])
                losses = decode([x[m].tolist() for x, m in zip(ids, masks, strict=True)])
                out = pd.DataFrame({"conv_id": pdf["conv_id"].iloc[part].to_numpy(), "turn": pdf["turn"].iloc[part].to_numpy() if "turn" in pdf else None})
                out["role"], out["text"] = [unescape(x) for x in roles], [unescape(x) for x in texts]
                out["loss"] = [None if x == t else unescape(x) for x, t in zip(losses, texts, strict=True)]
                out["chars"] = [marks + len(r) + len(t) for r, t in zip(roles, texts, strict=True)]
                out["tokens"] = [len(x) for x in ids]
                yield out

    return run


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What ordered turns say, by conversation: READ."""
    now, state, done = None, None, []

    def frame():
        out = pd.DataFrame(done, columns=["conv_id", *(x.split()[0] for x in READ.split(", "))])
        done.clear()
        return out.astype({"conv_id": "object"}) if len(out) == 0 else out

    def close():
        if state is not None:
            done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

    for pdf in batches:
        for conv, role, text, loss, chars, tokens in zip(pdf["conv_id"].astype(object), *(pdf[c] for c in SAID[2:]), strict=True):
            conv = None if pd.isna(conv) else conv
            if (conv,) != now:
                close()
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            loss = text if loss is None else loss
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
            state[5] += tokens
        yield frame()
    close()
    yield frame()


def read_back(chunks: DataFrame, path: str) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256 (role, newline, text, newline for each turn),
    loss_chars and loss_sha256 (the text under the mask), formatted_chars (code points of the rendered conversation,
    marks included), n_tokens. Takes the output of `assemble` as it comes, chunks of a conversation together."""
    listen = listener(path)
    return chunks.mapInPandas(lambda batches: digests(listen(batches)), f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, {READ}")


def format_and_read(rows: DataFrame, path: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """`read_back` of `assemble` of `encode_rows`, where a turn is read where it was made: only what was read is
    brought together and put in order, as role and text, which are also what equal turns are ordered by."""
    encode, listen = encoder(path, loss_roles), listener(path)

    def masked(batches):
        for pdf in batches:
            pdf["mask"] = [mask_of(len(x), [(a, b)] if loss else []) for x, a, b, loss in zip(pdf["ids"], pdf["text_from"], pdf["text_to"], pdf["in_loss"], strict=True)]
            yield pdf

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    said = rows.select("conv_id", "turn", "role", "text").mapInPandas(lambda batches: listen(masked(encode(batches))), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, loss string, chars long, tokens long")
    return in_order(said).mapInPandas(digests, f"conv_id {kinds['conv_id']}, {READ}")
