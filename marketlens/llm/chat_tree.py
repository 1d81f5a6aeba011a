"""Chat formatting as prefix trees: shared first turns are emitted once, depth-first, with position ids
and the intervals that a turn may attend to.

A turn is rendered as `<turn>role\n`, its text, `</turn>\n`; a backslash goes before every backslash and
before every control string inside a role or text, so parsing gives the turns back. Units are code
points. A node is a turn after a certain path of turns; its path is a running digest, so equal first
turns of any number of conversations meet in one group that Spark combines before the shuffle.
Conversations are ranked by the digests along their whole path; a node belongs to the first conversation
that passes it, and nodes sorted by (that rank, place) are in depth-first order at any depth and
width. They are written with shard offsets like token files. Sort keys hold 16 bytes a turn, once a conversation.

Defined results: null role or text is empty; null turns come first; equal turn numbers are ordered by
role and text; rows without conv_id form one conversation. A conversation is streamed by one task, however long
it is or its texts are; its state is 16 bytes a turn. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import SALTS, store

OPEN, CLOSE = "<turn>", "</turn>\n"
#: The role whose text is under the loss mask.
LEARNED = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text stands in it."""
    head = OPEN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head, _, rest = piece.removeprefix(OPEN).partition("\n")
    return unescape(head), unescape(rest.removesuffix(CLOSE))


def steps(conversations: DataFrame) -> DataFrame:
    """A row per turn: its place, path digest, parent's digest, first position id, piece and loss span.

    Conversations are streamed in order. The last turn of each carries `key`, the digests along its path.
    """
    rows = conversations.selectExpr("cast(conv_id as string) as conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = "conv_id string, place long, path string, parent string, key binary, position long, piece string, loss_start int, loss_stop int"
    columns = ["conv_id", "place", "path", "parent", "key", "position", "piece", "loss_start", "loss_stop"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The newest turn waits until it is known whether it is the last one of its conversation.
        before, waiting, place, path, position, key = (), None, 0, "", 0, bytearray()
        for batch in batches:
            out = []
            for conv, role, text in batch.itertuples(index=False):
                if waiting:
                    out.append(waiting if conv == before else (*waiting[:4], bytes(key), *waiting[5:]))
                if conv != before:
                    before, place, path, position, key = conv, 0, "", 0, bytearray()
                piece, start, stop = render(role, text)
                parent, digest = path, hashlib.blake2b((path + piece).encode("utf-8", "surrogatepass"), digest_size=16)
                path, learned = digest.hexdigest(), role == LEARNED
                key += digest.digest()
                waiting = (conv, place, path, parent, None, position, piece, start if learned else 0, stop if learned else 0)
                place, position = place + 1, position + len(piece)
            yield pd.DataFrame(out, columns=columns)
        if waiting:
            yield pd.DataFrame([(*waiting[:4], bytes(key), *waiting[5:])], columns=columns)

    return dealt.mapInPandas(run, schema)


def layout(turns: DataFrame) -> DataFrame:
    """The written trees, a row per node in depth-first order: shard, local_start and length place it in the output.

    `salts` are the sub-keys under which conversations read the node back.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = turns.where("key is not null").select("conv_id", "key").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    # Row numbers that grow along the range-sorted partitions; stored, so that they are given once.
    ranks = store(paths.select(F.col("conv_id").alias("of"), F.monotonically_increasing_id().alias("rank")), "chat-ranks")
    salt = F.pmod(F.hash("conv_id"), F.lit(SALTS))
    ranked = turns.join(ranks, F.col("conv_id").eqNullSafe(F.col("of")))
    nodes = ranked.groupBy("path").agg(F.min("rank").alias("rank"), *[F.first(c).alias(c) for c in ("parent", "place", "position", "piece", "loss_start", "loss_stop")], F.collect_set(salt).alias("salts"))
    ordered = nodes.repartitionByRange(parts, "rank", "place").sortWithinPartitions("rank", "place").drop("rank")
    schema = "path string, parent string, place long, position long, piece string, loss_start int, loss_stop int, salts array<int>, shard int, local_start long, length int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch["piece"].str.len().astype("int64")
            yield batch.assign(shard=shard, local_start=done + size.cumsum() - size, length=size)
            done += int(size.sum())

    return store(ordered.mapInPandas(run, schema), "chat-trees")


def starts(trees: DataFrame) -> DataFrame:
    """Units before each shard; a row per shard, so the only window without a key is small."""
    sizes = trees.groupBy("shard").agg(F.sum("length").alias("held"))
    return sizes.select("shard", F.coalesce(F.sum("held").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_back(turns: DataFrame, trees: DataFrame) -> DataFrame:
    """Conversation turns from the written trees: conv_id, place, position, start, length, piece, loss_start, loss_stop.

    A shared turn is looked up under as many sub-keys as its conversations have, so no task gets all of them.
    """
    nodes = trees.join(F.broadcast(starts(trees)), "shard").withColumn("start", F.col("base") + F.col("local_start"))
    nodes = nodes.select("path", F.explode("salts").alias("salt"), "start", "length", "piece", "loss_start", "loss_stop", "position")
    wanted = turns.select("conv_id", "place", "path", F.pmod(F.hash("conv_id"), F.lit(SALTS)).alias("salt"))
    return wanted.join(nodes, ["path", "salt"]).drop("salt", "path")


def conversations_of(rows: DataFrame) -> DataFrame:
    """A row per conversation, streamed in turn order: digests of its parsed turns and of its loss text, its
    formatted size, and `attention`, the merged output intervals of its turns (the last turn's ancestors and itself)."""
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attention array<struct<start: long, stop: long>>"
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "start", "length", "piece", "loss_start", "loss_stop")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None

        def closed() -> tuple:
            s = state
            return s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"], [{"start": a, "stop": b} for a, b in s["seen"]]

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attention"]
        for batch in batches:
            out = []
            for conv, start, length, piece, a, b in batch.itertuples(index=False):
                if state is None or conv != state["conv"]:
                    if state:
                        out.append(closed())
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "seen": []}
                role, text = parse(piece)
                learned = unescape(piece[a:b])
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["loss"].update(learned.encode("utf-8", "surrogatepass"))
                state["n"] += 1
                state["chars"] += len(learned)
                state["formatted"] += length
                if state["seen"] and state["seen"][-1][1] == start:
                    state["seen"][-1] = (state["seen"][-1][0], start + length)
                else:
                    state["seen"].append((start, start + length))
            yield pd.DataFrame(out, columns=columns)
        if state:
            yield pd.DataFrame([closed()], columns=columns)

    return dealt.mapInPandas(run, schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Write the trees of all conversations and read every conversation back from them."""
    turns = store(steps(conversations), "chat-turns")
    rows = read_back(turns, layout(turns))
    kind = dict(conversations.dtypes)["conv_id"]
    return conversations_of(rows).withColumn("conv_id", F.col("conv_id").cast(kind))


#: What `op9_chat_tree` returns; a formatted turn has 15 units around its role and text, and one more per escape.
ORACLE = r"""
WITH turns AS (
    SELECT conv_id, turn, ifnull(role, '') AS role, ifnull(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS added(turn, role)),
parts AS (
    SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
           role || text AS said, length(role) - length(replace(role, chr(10), '')) AS lines
    FROM turns),
counted AS (
    SELECT *, 15 + length(said) + lines + length(said) - length(replace(said, '\', ''))
              + len(regexp_extract_all(role, '</?turn')) + len(regexp_extract_all(text, '</?turn')) AS size
    FROM parts)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id"""
