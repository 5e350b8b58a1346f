"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: sorted by their turns, they come in depth-first order, and a
tree emits each shared turn once. A tree is one training sequence: a stream of code points and, for each turn, its
place, the position of its first code point along its conversation, the ancestors' intervals that it may attend to, and
the span under the loss mask. Trees are closed at a size, so one very common first turn fills many of them.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts, ``<|`` gets a backslash between its characters, and one
more wherever backslashes stand there already; so control strings never come from a text, and the escape is undone
exactly. Roles also write backslash and line end as ``\\\\`` and ``\\n``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, staged

#: Fixed values of the template.
START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"
TREE_CHARS, TREE_LEAVES = 1 << 18, 4096

TREE = (
    "tree_id long, stream string, nodes array<struct<parent:int,start:long,length:long,position:long,loss_start:long,loss_end:long,attends:array<struct<start:long,end:long>>>>, leaves array<struct<conv_id:long,node:int>>"
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        if not part.endswith(END):
            raise ValueError("a turn has no end")
        role, _, text = part[: -len(END)].partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        out.append((role, unescape(text)))
    return out


class Tree:
    """A prefix tree that grows by conversations in depth-first order."""

    def __init__(self):
        self.parts, self.size, self.nodes, self.leaves, self.path = [], 0, [], [], []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        for (turn, _), other in zip(self.path, turns):
            if turn != other:
                break
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        del self.path[self.shared(turns) :]
        for turn in turns[len(self.path) :]:
            text, a, b = render(*turn)
            parent = self.path[-1][1] if self.path else -1
            attends, position = [], 0
            if parent >= 0:
                up = self.nodes[parent]
                attends, position = [dict(x) for x in up["attends"]], up["position"] + up["length"]
                if attends and attends[-1]["end"] == up["start"]:
                    attends[-1]["end"] += up["length"]
                else:
                    attends.append({"start": up["start"], "end": up["start"] + up["length"]})
            mask = turn[0] == LOSS_ROLE
            self.nodes.append({"parent": parent, "start": self.size, "length": len(text), "position": position, "loss_start": self.size + a if mask else None, "loss_end": self.size + b if mask else None, "attends": attends})
            self.path.append((turn, len(self.nodes) - 1))
            self.parts.append(text)
            self.size += len(text)
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1]})

    def row(self, tree_id: int) -> dict:
        return {"tree_id": tree_id, "stream": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


def position_ids(tree: dict) -> np.ndarray:
    """For each code point of a tree's stream, its place in its own conversation."""
    out = np.empty(len(tree["stream"]), np.int64)
    for n in tree["nodes"]:
        out[n["start"] : n["start"] + n["length"]] = np.arange(n["position"], n["position"] + n["length"])
    return out


def trees(conversations: DataFrame, tree_chars: int = TREE_CHARS, tree_leaves: int = TREE_LEAVES) -> DataFrame:
    """The prefix trees of all conversations (conv_id, turn, role, text).

    Turns are ordered by turn (null first), role and text; null roles and texts are empty. Rows without conv_id are one
    conversation. Repeated rows are turns of their own; equal conversations end at the same turn of a tree. No rows
    give no trees. A conversation is handled by one task, turn by turn.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    turn_type = pa.struct([("role", pa.string()), ("text", pa.string())])

    def gather(batches):
        own, turns, out, chars, began = None, [], [], 0, False

        def close():
            path = b"".join(hashlib.blake2b(f"{r}\0{t}".encode(), digest_size=8).digest() for r, t in turns)
            out.append((own, path, [{"role": r, "text": t} for r, t in turns]))

        def batch_of():
            c = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.list_(turn_type))], ["conv_id", "path", "turns"])

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if began and conv_id != own:
                    close()
                    turns = []
                    if chars > 1 << 22:
                        yield batch_of()
                        out, chars = [], 0
                own, began = conv_id, True
                turns.append((role or "", text or ""))
                chars += len(text or "") + 64
        if began:
            close()
            yield batch_of()

    def grow(batches):
        tree, nr, base = Tree(), 0, TaskContext.get().partitionId() << 32
        ready = []

        def rows():
            return pa.RecordBatch.from_pylist(ready, schema=kind)

        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turns = [(x["role"], x["text"]) for x in turns]
                if tree.leaves and (not tree.shared(turns) or tree.size >= tree_chars or len(tree.leaves) >= tree_leaves):
                    ready.append(tree.row(base + nr))
                    tree, nr = Tree(), nr + 1
                    if sum(len(x["stream"]) for x in ready) > 1 << 21:
                        yield rows()
                        ready = []
                tree.add(conv_id, turns)
        if tree.leaves:
            ready.append(tree.row(base + nr))
        if ready:
            yield rows()

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    node = pa.struct([("parent", pa.int32()), *((k, pa.int64()) for k in ("start", "length", "position", "loss_start", "loss_end")), ("attends", pa.list_(span))])
    kind = pa.schema([("tree_id", pa.int64()), ("stream", pa.string()), ("nodes", pa.list_(node)), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    paths = in_batches(rows, gather, "conv_id long, path binary, turns array<struct<role:string,text:string>>")
    return paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns").mapInArrow(grow, TREE)


def conversation_of(tree: dict, node: int) -> tuple[str, str]:
    """The formatted conversation that ends at a node, and its texts under the loss mask, unescaped."""
    own, stream, nodes = tree["nodes"][node], tree["stream"], tree["nodes"]
    text = "".join(stream[x["start"] : x["end"]] for x in own["attends"]) + stream[own["start"] : own["start"] + own["length"]]
    masked, k = [], node
    while k >= 0:
        if nodes[k]["loss_start"] is not None:
            masked.append(unescape(stream[nodes[k]["loss_start"] : nodes[k]["loss_end"]]))
        k = nodes[k]["parent"]
    return text, "".join(reversed(masked))


def digests(forest: DataFrame) -> DataFrame:
    """For each conversation of the trees, what reading it back from them gives."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tree, out = batch.slice(k, 1).to_pylist()[0], {x.split()[0]: [] for x in DIGEST.split(", ")}
                for leaf in tree["leaves"]:
                    text, masked = conversation_of(tree, leaf["node"])
                    turns = parse(text)
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    for name, v in zip(out, (leaf["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text))):
                        out[name].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in DIGEST.split(", ")]))

    return forest.mapInArrow(run, DIGEST)


def formatted(conversations: DataFrame, **options) -> DataFrame:
    """Writes the trees to the shared folder and reads every conversation back from them."""
    return digests(staged(trees(conversations, **options), "trees"))
