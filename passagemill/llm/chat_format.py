"""Operator 1: chat formatting at the level of tokens.

Each segment of a conversation (a role's name, a turn's content) is encoded by itself and the
reserved ids are spliced in between, so no merge crosses a segment's edge.  Content is encoded
as ordinary text, and control strings that occur in it are escaped, so that neither ids nor the
decoded text can be taken for structure.  Marks at the borders of what an assistant says
(content and end mark) are summed from the left to give the loss mask.

A conversation is: BOS, then for each turn START role NEWLINE content END NEWLINE.  In a role
new lines and backslashes are escaped, so that its first new line is the one that ends it.

A conversation of more than PART_TURNS turns comes in parts of about so many, numbered from 0
and each a row: joined in order they are the conversation.  Only the first has a BOS.

Defined results: turns go by turn, role, text (nulls first), so ties have an order, and
repeated rows are turns of their own; a null text is an empty content, a null role is "unknown"
and never trained on; turns without a conv_id belong to no conversation and are left out; an
empty table gives no rows; texts of any length are whole segments; extra columns are not read.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import small, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
RESERVED = ("<|bos|>", "<|start|>", "<|end|>")
TRAINED = ("assistant",)
PART_TURNS = 4096
#: Signs of a text by which the turns of a long conversation that tie in turn and role are put in parts.
_AHEAD = 32
_CONTROL = re.compile("<(\\\\*)\\|(?=(?:" + "|".join(re.escape(r[2:]) for r in RESERVED) + "))")
_ESCAPED = re.compile("<\\\\(\\\\*)\\|(?=(?:" + "|".join(re.escape(r[2:]) for r in RESERVED) + "))")


def escape(text: str) -> str:
    """A control string gets a backslash after its first sign (one more, if it already has some)."""
    return _CONTROL.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + "|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY) -> tuple[tiktoken.Encoding, tuple[int, ...]]:
    """The tokenizer of a vocabulary file, and the reserved ids after its last one."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    top = max(ranks.values()) + 1
    special = {s: top + i for i, s in enumerate(RESERVED)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special.values())


def assemble(turns: list[tuple[str | None, str | None]], vocabulary: str = VOCABULARY, begins: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a conversation of (role, text) turns, or of a later part of one."""
    enc, (bos, start, end) = encoding(vocabulary)
    line = enc.encode_ordinary("\n")
    roles = [escape_role(r if r is not None else "unknown") for r, _ in turns]
    parts = enc.encode_ordinary_batch([*roles, *(escape(t or "") for _, t in turns)], num_threads=1)
    pieces: list[list[int]] = [[bos]] if begins else []
    at, marks = len(pieces), []
    for (role, _), name, content in zip(turns, parts, parts[len(turns) :]):
        head = [start, *name, *line]
        if role in TRAINED:
            marks.append((at + len(head), at + len(head) + len(content) + 1))
        pieces += [head, content, [end, *line]]
        at += len(head) + len(content) + 1 + len(line)
    ids = np.fromiter((i for p in pieces for i in p), np.int32, at)
    step = np.zeros(at + 1, np.int32)
    for a, b in marks:
        step[a] += 1
        step[b] -= 1
    return ids, np.cumsum(step)[:-1].astype(np.int32)


def parse(ids: list[int], vocabulary: str = VOCABULARY) -> list[tuple[str, str]]:
    """The (role, text) turns that these ids, of a conversation or a part of one, were assembled from."""
    enc, (bos, start, end) = encoding(vocabulary)
    line = enc.encode_ordinary("\n")
    out, at = [], int(ids[0] == bos)
    while at < len(ids):
        assert ids[at] == start
        stop = ids.index(end, at)
        role, _, text = enc.decode(ids[at + 1 : stop]).partition("\n")
        out.append((unescape_role(role), unescape(text)))
        at = stop + 1 + len(line)
    return out


OUT = "conv_id bigint, part int, n_turns int, n_tokens int, n_trained int, input_ids array<int>, loss_mask array<int>"


def _parts(c: DataFrame, limit: int) -> DataFrame:
    """c with the part of its conversation that each turn is in; only narrow rows of long conversations are put in order."""
    key = ["turn", "role", "ahead"]
    c = c.withColumn("ahead", F.substring("text", 1, _AHEAD))
    long = c.groupBy("conv_id").count().where(F.col("count") > limit).select("conv_id")
    n = c.join(small(written(long, "long-chats"), 16), "conv_id", "left_semi").groupBy("conv_id", *key).count()
    before = W.Window.partitionBy("conv_id").orderBy(*key).rowsBetween(W.Window.unboundedPreceding, -1)
    at = n.select("conv_id", *key, F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / limit).cast("int").alias("part"))
    at = small(written(at, "chat-parts"), 200).alias("p")
    same = F.col("c.conv_id") == F.col("p.conv_id")
    for k in key:
        same &= F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
    return c.alias("c").join(at, same, "left").select("c.conv_id", F.coalesce("p.part", F.lit(0)).alias("part"), "c.turn", "c.role", "c.text")


def format_chats(conversations: DataFrame, vocabulary: str = VOCABULARY, part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each conversation, or for each part of a long one."""
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").where("conv_id is not null")
    c = _parts(c, part_turns).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    c = c.select("conv_id", "part", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(frames):
        for f in frames:
            made = [assemble(list(zip(r, t)), vocabulary, p == 0) for p, r, t in zip(f["part"], f["roles"], f["texts"])]
            yield pd.DataFrame(
                {
                    "conv_id": f["conv_id"],
                    "part": f["part"],
                    "n_turns": [len(r) for r in f["roles"]],
                    "n_tokens": [len(i) for i, _ in made],
                    "n_trained": [int(m.sum()) for _, m in made],
                    "input_ids": [i for i, _ in made],
                    "loss_mask": [m for _, m in made],
                }
            )

    return c.mapInPandas(run, OUT)
