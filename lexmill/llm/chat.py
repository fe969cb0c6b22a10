"""Chat formatting over a prefix tree of conversations.

A turn is written as a start mark, its role, a line break, its text and an end mark; backslashes and the marks' opening
inside roles and texts are escaped, so that the format reads back exactly. Conversations are range-sorted by the digests
of their turns: conversations that share initial turns become neighbours, the sorted order is the depth-first order of
the prefix tree, and what a conversation adds to its predecessor's path is emitted once. Each emitted node has its place
in its tree, its position ids (they go on from its parent's), and the intervals of its ancestors, all that it attends to
besides itself; touching intervals are merged.

A first turn or a whole conversation that is very common is cut at slice borders (the range sort has the id as its last
key); a slice starts its own tree and so repeats the prefix of at most one path. A task holds one Arrow batch of conversations,
of which one at a time is Python objects, and the nodes that the batch gives.

Edge cases: null roles and texts are empty; a null turn comes first, turns of one number are ordered by role and text;
rows with a null id form one conversation; extra columns aren't read.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import one_by_one, whole_text
from lexmill.llm.tokens import encoder
from lexmill.storage import materialize, partitions

START, STOP = "<|turn|>", "<|end|>\n"
TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, and what stands after it; the line breaks of a role are escaped too."""
    return START + escape(role).replace("\n", "\\n") + "\n", escape(text), STOP


def _merged(intervals: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in intervals:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [{"from": a, "to": b} for a, b in out]


INTERVALS = "array<struct<`from`:long,`to`:long>>"
NODES = f"slice int, tree int, node int, depth int, start long, length long, position long, ancestors {INTERVALS}, loss struct<`from`:long,`to`:long>, text string, ids array<int>, is_leaf boolean, conv_id long, path array<int>"

SPAN = pa.struct([("from", pa.int64()), ("to", pa.int64())])
ARROW = pa.schema(
    [("slice", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("depth", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("ancestors", pa.list_(SPAN)), ("loss", SPAN), ("text", pa.string())]
    + [("ids", pa.list_(pa.int32())), ("is_leaf", pa.bool_()), ("conv_id", pa.int64()), ("path", pa.list_(pa.int32()))]
)


def prefix_trees(conversations: DataFrame, tokenizer: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """Node rows and, with is_leaf, a row a conversation with the nodes of its path; materialised.

    Places, lengths and positions count code points, or tokens if a tokenizer's path is given (ids holds them then);
    loss is the part of a node's own units that is trained on.
    """
    turn = F.struct(F.col("turn"), whole_text("role").alias("role"), whole_text("text").alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    digest = lambda t: F.unhex(F.sha2(F.concat_ws("\n", F.octet_length(t["role"]).cast("string"), t["role"], t["text"]), 256))
    keyed = whole.withColumn("key", F.transform("turns", digest))
    sorted_ = keyed.repartitionByRange(partitions(conversations.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer) if tokenizer else None
        here, tree, node, end = TaskContext.get().partitionId(), -1, -1, 0
        path: list[tuple] = []  # digest, node, start, end
        for batch in batches:
            out = []
            for conv, turns, key in zip(*(one_by_one(batch.column(i)) for i in range(3)), strict=True):
                same = 0
                while same < min(len(path), len(key)) and path[same][0] == key[same]:
                    same += 1
                path = path[:same]
                if not same:
                    tree, end = tree + 1, 0
                position = sum(p[3] - p[2] for p in path)
                for t, k in zip(turns[same:], key[same:], strict=True):
                    parts = render(t["role"], t["text"])
                    ids = [encode(x) for x in parts] if encode else None
                    sizes = [len(x) for x in ids or parts]
                    node += 1
                    loss = {"from": sizes[0], "to": sizes[0] + sizes[1]} if t["role"] == loss_role else None
                    out.append({"slice": here, "tree": tree, "node": node, "depth": len(path), "start": end, "length": sum(sizes), "position": position, "ancestors": _merged([p[2:] for p in path]), "loss": loss, "text": "".join(parts), "ids": sum(ids, []) if ids else None, "is_leaf": False, "conv_id": None, "path": None})
                    path.append((k, node, end, end + sum(sizes)))
                    end, position = end + sum(sizes), position + sum(sizes)
                out.append({"slice": here, "tree": tree, "is_leaf": True, "conv_id": conv, "path": [p[1] for p in path]})
            yield pa.RecordBatch.from_pylist(out, ARROW)

    return materialize(sorted_.select("conv_id", "turns", "key").mapInArrow(emit, NODES), "trees")


def read_back(trees: DataFrame) -> DataFrame:
    """conv_id and the digests of each conversation, from the nodes' text alone (trees in code points)."""
    nodes = trees.filter("not is_leaf").select("slice", "node", "text", "loss")
    steps = trees.filter("is_leaf").select("conv_id", "slice", F.posexplode("path").alias("at", "node"))
    whole = steps.join(nodes, ["slice", "node"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "text", F.col("loss.from").alias("a"), F.col("loss.to").alias("b")))).alias("steps"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for steps in one_by_one(batch.column(1)):
                full = "".join(s["text"] for s in steps)
                turns = TURN.findall(full)
                said = "".join(f"{unescape(role)}\n{unescape(text)}\n" for role, text in turns)
                loss = "".join(unescape(s["text"][s["a"] : s["b"]]) for s in steps if s["a"] is not None)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(full)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(5))], ["conv_id", *names])

    return whole.mapInArrow(parse, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
