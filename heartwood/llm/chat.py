"""Chat formatting as prefix trees.

Conversations that share their first turns share a path in a tree. A pack holds
one or more such trees: every shared turn once, depth first, with a position
(its distance from the root along the path, so that siblings start at the same
one) and the intervals of the pack that it may attend to (its ancestors, and
itself up to each token). Conversations are sorted by the path of hashes of
their turns, so those that share turns are neighbours; packs are cut from the
sorted rows and are bounded, by characters and by 4,096 conversations, which bounds
memory. A turn shared across packs is
repeated once in each. Equal conversations sort by their ids after the path, so
no key gathers in one task.

Template: `<|turn|>` role `<|text|>` text `<|end|>`. Control strings inside
roles and texts are escaped by a backslash after their first character, and
backslashes are doubled, which unescape() reverses.

Defined cases: null role or text is empty; turns tie-break by role, then text,
and null turns come first; a null id is a conversation of its own; an empty
table gives no packs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates in public use as control tokens.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Characters at which a pack is closed.
PACK_CHARS = 262_144


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Node(NamedTuple):
    """A turn in a pack. Offsets count the units of the pack: code points, or tokens."""

    start: int
    end: int
    loss_from: int  # the part under the loss mask; empty if not an assistant's
    loss_to: int
    position: int  # position id of the first unit; the rest follow
    parent: int  # index in the pack, -1 for a root


def intervals(nodes: list[Node], i: int) -> list[tuple[int, int]]:
    """What node i attends to, root first, its own interval last (causally)."""
    out = []
    while i >= 0:
        out.append((nodes[i].start, nodes[i].end))
        i = nodes[i].parent
    return out[::-1]


class Pack:
    """Builds trees from conversations that arrive in the order of their paths."""

    def __init__(self):
        self.parts: list[str] = []
        self.nodes: list[Node] = []
        self.size = 0
        self.path: list[tuple[tuple[str, str], int]] = []  # turns of the last conversation and their nodes
        self.leaves: list[tuple[object, int]] = []  # conversation id and its last node

    def add(self, conv_id: object, turns: list[tuple[str, str]]) -> None:
        shared = 0
        for (turn, _), own in zip(self.path, turns):  # noqa: B905
            if turn != own:
                break
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if parent >= 0 else None
            a, b = self.size + len(head), self.size + len(head) + len(body)
            end = b + len(END)
            loss = (a, b) if role == "assistant" else (a, a)
            self.nodes.append(Node(self.size, end, *loss, above.position + above.end - above.start if above else 0, parent))
            self.parts += [head, body, END]
            self.size = end
            self.path.append(((role, text), len(self.nodes) - 1))
        self.leaves.append((conv_id, self.path[-1][1] if self.path else -1))


SCHEMA = """pack_text string,
 nodes array<struct<start:bigint,stop:bigint,loss_from:bigint,loss_to:bigint,position:bigint,parent:int,attends:array<struct<start:bigint,stop:bigint>>>>,
 leaves array<struct<conv_id:string,node:int>>"""


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", pack_chars: int = PACK_CHARS) -> DataFrame:
    """One row per pack: its text, its nodes in order and, for each conversation, its last node.

    Two shuffles: turns to conversations, and conversations to the order of
    their paths.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = rows.select(F.col(conv_id).cast("string").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    step = lambda t: F.md5(F.concat_ws("\x00", t["role"], t["text"]).cast("binary"))
    paths = convs.withColumn("path", F.concat_ws("", F.transform("turns", step)))

    def out(pack: Pack) -> dict:
        nodes = [{"start": n.start, "stop": n.end, "loss_from": n.loss_from, "loss_to": n.loss_to, "position": n.position, "parent": n.parent, "attends": [{"start": a, "stop": b} for a, b in intervals(pack.nodes, i)]} for i, n in enumerate(pack.nodes)]
        return {"pack_text": "".join(pack.parts), "nodes": nodes, "leaves": [{"conv_id": c, "node": n} for c, n in pack.leaves]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = Pack()
        for pdf in batches:
            for cid, turns in zip(pdf["conv_id"].tolist(), pdf["turns"], strict=True):
                if pack.leaves and (pack.size >= pack_chars or len(pack.leaves) >= 4096):
                    yield pd.DataFrame([out(pack)])
                    pack = Pack()
                pack.add(cid, [(t["role"], t["text"]) for t in turns])
        if pack.leaves:
            yield pd.DataFrame([out(pack)])

    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", "turns").mapInPandas(run, SCHEMA)


_BACK = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)


def read_back(packs: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Each conversation as its pack holds it: per row conv_id (cast to
    id_type; packs hold ids as text), n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, and the position after its last unit."""
    schema = "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, positions bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, nodes, leaves in zip(pdf["pack_text"], pdf["nodes"], pdf["leaves"], strict=True):
                made: dict[int, tuple] = {}
                rows = []
                for leaf in leaves:
                    n = leaf["node"]
                    if n not in made:
                        made[n] = _digest(text, nodes, n)
                    rows.append((leaf["conv_id"], *made[n]))
                yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "positions"])

    return packs.mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast(id_type))


def _digest(text: str, nodes, leaf: int) -> tuple:
    if leaf < 0:
        none = hashlib.sha256(b"").hexdigest()
        return 0, none, 0, none, 0, 0
    spans = [(a["start"], a["stop"]) for a in nodes[leaf]["attends"]]
    by_start = []
    i = leaf
    while i >= 0:
        by_start.append(nodes[i])
        i = nodes[i]["parent"]
    whole = "".join(text[a:b] for a, b in spans)
    turns = [(unescape(r), unescape(t)) for r, t in _BACK.findall(whole)]
    said = "".join(unescape(text[n["loss_from"] : n["loss_to"]]) for n in by_start[::-1])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(whole), nodes[leaf]["position"] + nodes[leaf]["stop"] - nodes[leaf]["start"]


def tokenized(packs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Packs as token ids: `ids`, `position_ids` and `loss_mask` per token, and
    per node its interval of tokens (`token_start`, `token_stop`) and parent;
    a token attends to its ancestors' intervals and to its own node up to itself.
    The three control strings of the template are single ids after the ranks.
    """
    schema = "ids array<int>, position_ids array<int>, loss_mask array<boolean>, token_nodes array<struct<token_start:int,token_stop:int,parent:int>>, leaves " + packs.schema["leaves"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import public_tokenizers as P
        import tiktoken

        with open(P.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("chat", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
        marks = {m: len(table) + i for i, m in enumerate((TURN, TEXT, END))}
        for pdf in batches:
            for text, nodes, leaves in zip(pdf["pack_text"], pdf["nodes"], pdf["leaves"], strict=True):
                ids, places, mask, spans, ends = [], [], [], [], []
                for n in nodes:
                    head = text[n["start"] + len(TURN) : n["loss_from"] - len(TEXT)]
                    body = text[n["loss_from"] : n["stop"] - len(END)]
                    h, b = enc.encode_ordinary(head), enc.encode_ordinary(body)
                    own = [marks[TURN], *h, marks[TEXT], *b, marks[END]]
                    loss = n["loss_to"] > n["loss_from"]
                    at = ends[n["parent"]] if n["parent"] >= 0 else 0
                    spans.append({"token_start": len(ids), "token_stop": len(ids) + len(own), "parent": n["parent"]})
                    mask += [False] * (len(h) + 2) + [bool(loss)] * len(b) + [False]
                    places += range(at, at + len(own))
                    ends.append(at + len(own))
                    ids += own
                yield pd.DataFrame([{"ids": ids, "position_ids": places, "loss_mask": mask, "token_nodes": spans, "leaves": list(leaves)}])

    return packs.mapInPandas(run, schema)
