"""Chat formatting in budgeted windows.

A conversation's turns become windows of at most `budget` tokens, cut between turns: running sums of turn tokens give
the longest span that fits beside the system turn, which every window retains, and beside at most `history` tokens of
the turns before, which are repeated. Loss falls on assistant turns, and where one is repeated it is masked, so each
assistant text is a target once. A turn that is longer than the budget gets a window of its own and stays whole.

The template marks turns with control strings. In texts, a backslash is doubled and a control string gets one after
its first character, so none is left in a text and unescape() gives it back.

Rows are sorted by range into many tasks, whatever the size of a conversation, and numbered within theirs: ranks, not
turn numbers, so gaps and large numbers cost nothing. They are dealt out by conversation and segment of SEGMENT ranks, so a
conversation of any length is many small groups; a segment begins with the system turn and the last HISTORY_TURNS rows
before it, and windows break there. Groups are read as sorted streams: memory holds one window. Only read_back(), whose
digests are over whole conversations, streams one through one task.

A window has at most `budget` tokens: repeated history is dropped before that is exceeded, the oldest first, and only a turn
that does not fit beside the system turn alone exceeds it, in a window of its own.

Cases: null text is empty; a null role is an empty role; rows without a conversation id form one conversation; null
turns come first; rows that share a turn are ordered by role and text, repeated rows stay; a very long text is one turn, kept
whole; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearscore.llm import bpe
from nearscore.llm.common import cut, map_batches, table
from nearscore.llm.tokens import word_bpe

BUDGET, HISTORY, HISTORY_TURNS, SEGMENT = 2048, 256, 2, 4096

MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ASST] ", " </s>")}
CONTROL = re.compile(r"([<\[])(/?s>|/?SYS\]|/?INST\]|ASST\]|ROLE=|/ROLE\])")
TURN = re.compile(r"(?:\[(SYS|INST|ASST)\]|\[ROLE=((?:\\.|[^\\\]])*)\]) (.*?) (?:\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])", re.S)
NAMES = {"SYS": "system", "INST": "user", "ASST": "assistant"}

WINDOWS = "conv_id long, segment long, window int, repeated int, n_tokens long, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text begins and ends in it."""
    begin, end = MARKS.get(role) or (f"[ROLE={escape(role).replace(']', chr(92) + ']')}] ", " [/ROLE]")
    body = escape(text)
    return f"{begin}{body}{end}", len(begin), len(begin) + len(body)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """role, text, and where its escaped text begins and ends, of every turn of a window."""
    return [(NAMES[m[1]] if m[1] else unescape(m[2]), unescape(m[3]), m.start(3), m.end(3)) for m in TURN.finditer(window)]


def windows(turns, count, budget: int, history: int) -> Iterator[tuple[int, int, str, list[tuple[int, int]]]]:
    """(repeated turns, tokens, text, loss spans) of a stream of (kind, role, text): kind 0 is a system turn from an
    earlier segment, 1 history from one, 2 a turn of this segment."""
    system, before, now, used, first = None, [], [], 0, True

    def close():
        parts, loss, at = [*([system] if system and (system_repeated or before) else []), *before, *now], [], 0
        repeated = len(parts) - len(now)
        for k, (role, (t, a, b), _) in enumerate(parts):
            if k >= repeated and role == "assistant" and b > a:
                loss.append((at + a, at + b))
            at += len(t)
        return repeated, sum(p[2] for p in parts), "".join(p[1][0] for p in parts), loss

    system_repeated = False
    for kind, role, text in turns:
        t = turn_text(role, text)
        turn = (role, t, count(t[0]))
        if kind == 0:
            system, system_repeated = turn, True
            continue
        if kind == 1:
            before.append(turn)
            continue
        if first:
            while before and sum(p[2] for p in before) > history:
                before.pop(0)
            used, first = sum(p[2] for p in before) + (system[2] if system else 0), False
        if now and used + turn[2] > budget:
            yield close()
            tail, room = [], history
            for p in reversed(now):
                if p is system or p[2] > room or len(tail) == HISTORY_TURNS:
                    break
                tail.insert(0, p)
                room -= p[2]
            before, now, system_repeated = tail, [], True
            used = sum(p[2] for p in before) + (system[2] if system else 0)
        while not now and before and used + turn[2] > budget:
            used -= before.pop(0)[2]
        if role == "system" and system is None and not now and not before:
            system = turn
        now.append(turn)
        used += turn[2]
    if now:
        yield close()


def sorted_stream(batches, columns: int) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(columns)))


def with_ranks(turns: DataFrame) -> DataFrame:
    """turns with rank: 0, 1, ... within each conv_id, by turn, role and text.

    Tasks hold ranges of the sorted rows, made durable once. Where a conversation goes on from one task into the next, the
    next begins with the number of its rows before; the driver adds these up from one row a task."""
    order, parts = ["conv_id", "turn", "role", "text"], int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    of_conversation = rows.groupBy(part, "conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    ends = of_conversation.groupBy("part").agg(F.min(F.struct("at", "conv_id"))["conv_id"].alias("first"), F.max(F.struct("at", "conv_id", "n")).alias("last"), F.count(F.lit(1)).alias("conversations"))
    before, last, running = {}, None, 0
    for r in sorted(ends.collect(), key=lambda r: r.part):
        before[r.part] = running if last is not None and last == (r.first,) else 0
        running = r["last"]["n"] + (before[r.part] if r.conversations == 1 else 0)
        last = (r["last"]["conv_id"],)

    def run(batches):
        now, rank = None, 0
        for batch in batches:
            ranks = []
            for conv, at in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                if now != (conv,):
                    rank = before[at >> 33] if not at & ((1 << 33) - 1) else 0
                    now = (conv,)
                ranks.append(rank)
                rank += 1
            yield {"conv_id": batch.column(0), "role": batch.column(2), "text": batch.column(3), "rank": ranks}

    return map_batches(rows, run, "conv_id long, role string, text string, rank long")


def format_windows(df: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """WINDOWS of conversations df (conv_id, turn, role, text)."""
    turns = df.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    segments = SEGMENT
    own = with_ranks(turns).withColumn("segment", F.floor(F.col("rank") / segments).cast("long")).withColumn("kind", F.lit(2))
    late = own.where(F.pmod("rank", F.lit(segments)) >= segments - HISTORY_TURNS).withColumn("segment", F.col("segment") + 1).withColumn("kind", F.lit(1))
    # the few conversations with more than one segment; their system turns go along
    hi = own.groupBy("conv_id").agg(F.max("segment").alias("hi")).where("hi > 0")
    heads = own.where("rank = 0 AND role = 'system'").drop("segment", "kind")
    heads = heads.join(hi, heads["conv_id"].eqNullSafe(hi["conv_id"])).select(heads["conv_id"], "role", "text", "rank", F.explode(F.sequence(F.lit(1).cast("long"), F.col("hi"))).alias("segment"), F.lit(0).alias("kind"))
    key = ["conv_id", "segment"]
    rows = own.unionByName(late).unionByName(heads).select(*key, "kind", "rank", "role", "text")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "kind", "rank")

    def run(batches):
        b, out = bpe.load(path), []
        count = lambda t: sum(len(x) for x in b.encode_pieces(t)) // 4
        names = ("conv_id", "segment", "window", "repeated", "n_tokens", "text", "loss")
        for (conv, seg), group in groupby(sorted_stream(batches, 6), key=lambda r: r[:2]):
            for k, (repeated, tokens, text, loss) in enumerate(windows(((g[2], g[4], g[5]) for g in group), count, budget, history)):
                out.append((conv, seg, k, repeated, tokens, text, [{"start": a, "end": z} for a, z in loss]))
                if len(out) == 256:
                    yield dict(zip(names, map(list, zip(*out))))
                    out = []
        if out:
            yield dict(zip(names, map(list, zip(*out))))

    return map_batches(rows, run, WINDOWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: turns without repeats, and what is under the loss mask."""
    key = ["conv_id", "segment", "window"]
    rows = formatted.select(*key, "repeated", "text", "loss").repartition("conv_id").sortWithinPartitions(*key)
    names = {"conv_id": "long", "n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long"}

    def run(batches):
        out = []
        for conv, group in groupby(sorted_stream(batches, 6), key=lambda r: r[0]):
            n, turns, chars, under, size = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for _, _, _, repeated, text, loss in group:
                size += len(text)
                for role, said, _, _ in parse(text)[repeated:]:
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    chars += len(said)
                    under.update(said.encode())
            out.append((conv, n, turns.hexdigest(), chars, under.hexdigest(), size))
            if len(out) == 4096:
                yield dict(zip(names, map(list, zip(*out))))
                out = []
        if out:
            yield dict(zip(names, map(list, zip(*out))))

    return map_batches(rows, run, ", ".join(f"{k} {v}" for k, v in names.items()))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_windows(rows, word_bpe()))
